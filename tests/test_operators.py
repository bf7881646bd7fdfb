"""Ledger operators against plain Python on small and random input."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import dates, money, text
from ledgerloom.functions.dates import Period
from ledgerloom.operators import cards, cascade, components, counted, intervals, matching, proof, rules
from ledgerloom.plans.ask import Query, answer
from ledgerloom.sources import files
from ledgerloom.streaming import imports

DAY = dt.date(2024, 1, 1)


def one(spark, *columns):
    return list(spark.range(1).select(*columns).first())


def test_money(spark):
    got = one(spark, *[money.signed_cents(F.lit(t)) for t in ("1,234.50", "₹ 12 Cr", "(5.05)", "-7", "abc", "Rs. 3.1 Dr")])
    assert got == [123450, -1200, -505, -700, None, 310]
    assert one(spark, money.cents(F.lit(10264.6)), money.round_up(F.lit(-2.5), 0), money.round_even(F.lit(2.5), 0), money.share(F.lit(1), F.lit(0))) == [1026460, -2.0, 2.0, 0.0]


def test_names(spark):
    got = one(spark, text.normal_name(F.lit("Razorpay*Joe's  Cafe Pvt Ltd 00123")), text.compact(F.lit("A-b C1")), text.person_name(F.lit("Paid to Mr. Ann  Lee")), text.plain(F.lit("Café Ñandú")),
              text.place_name(F.lit(" new  town ")), text.last_digits(F.lit("XX12 3456")), text.most_mentioned(F.lit("visa rupay visa"), {"rupay": "rupay", "visa": "visa"}))
    assert got == ["joes cafe", "abc1", "ann lee", "cafe nandu", "New Town", "3456", "visa"]
    assert one(spark, text.payee_matches(F.lit("Green Grocers"), "groc"), text.payee_matches(F.lit("Big Bazaar"), "igbaz"), text.payee_matches(F.lit("Big Bazaar"), "baz"), text.payee_matches(F.lit("Big Bazaar"), "aar")) == [True, True, True, False]


def test_dates(spark):
    assert one(spark, *[dates.read_date(F.lit(t)) for t in ("05/03/2024", "5 Mar 2024", "2024-03-05", "31/02/2024", "x")])[2:] == [dt.date(2024, 3, 5), None, None]
    assert one(spark, dates.read_date(F.lit("05/03/2024")), dates.excel_date(F.lit(45000)), dates.fiscal_year(F.lit(dt.date(2025, 3, 31))), dates.fiscal_year(F.lit(dt.date(2024, 4, 1)))) == [dt.date(2024, 3, 5), dt.date(2023, 3, 15), 2025, 2025]
    assert Period.year(2024).before() == Period.year(2023) and Period.month(2024, 3).before() == Period.month(2024, 2)
    assert Period.fiscal(2025) == Period(dt.date(2024, 4, 1), dt.date(2025, 3, 31)) and Period.season("winter", 2023).last == dt.date(2024, 2, 29)
    assert Period(dt.date(2024, 1, 10), dt.date(2024, 1, 12)).before() == Period(dt.date(2024, 1, 7), dt.date(2024, 1, 9))


def test_cycle_ends(spark):
    rows = [(DAY + dt.timedelta(d), k) for d in range(0, 400, 3) for k in (1, 15, 29, 30, 31)]
    got = spark.createDataFrame(rows, "day date, k int").select("day", "k", dates.cycle_end("day", "k").alias("e"), dates.cycle_start(dates.cycle_end("day", "k"), "k").alias("s")).collect()

    def ends(day, k):
        while True:
            last = (day.replace(day=28) + dt.timedelta(4)).replace(day=1) - dt.timedelta(1)
            if day.day == min(k, last.day):
                return day
            day -= dt.timedelta(1)

    for r in got:
        assert r["e"] == ends(r["day"], r["k"]) and r["s"] == ends(r["e"] - dt.timedelta(1), r["k"]) + dt.timedelta(1)


def test_usual_day_is_circular(spark):
    days = spark.createDataFrame([("a", dt.date(2024, 1, 31)), ("a", dt.date(2024, 3, 2)), ("a", dt.date(2024, 3, 1)), ("b", dt.date(2024, 5, 10))], "card string, d date")
    got = dict(map(tuple, days.groupBy("card").agg(intervals.usual_day(F.col("d"))).collect()))
    assert got == {"a": 1, "b": 10}


def test_estimates_equal_a_fold(spark):
    rng = random.Random(1)
    bills, moves, want = [], [], {}
    for card in "abcde":
        start, carry = DAY, 0
        for k in range(30):
            if rng.random() < 0.15:
                start, carry = start + dt.timedelta(40), 0
            last = start + dt.timedelta(rng.randint(27, 30))
            paid, charges = rng.randint(0, 500), 0
            for _ in range(rng.randint(0, 3)):
                cents, back = rng.randint(1, 300), rng.random() < 0.2
                charges += -cents if back else cents
                moves.append((len(moves), start + dt.timedelta(rng.randint(0, (last - start).days)), cents, "credit" if back else "debit", "card", card, "food", 1 if back else None))
            bills.append((card, start, last, paid))
            counted_ = charges + carry
            want[card, start] = (charges, counted_, max(0, paid - counted_))
            carry = max(0, counted_ - paid)
            start = last + dt.timedelta(1)
    got = intervals.estimates(spark.createDataFrame(bills, "card string, cycle_first date, cycle_last date, cents bigint"),
                              spark.createDataFrame(moves, "id bigint, day date, cents bigint, direction string, channel string, card string, category string, refund_of bigint"))
    assert {(r["card"], r["cycle_first"]): (r["charges"], r["counted"], r["estimate"]) for r in got.collect()} == want


def test_refunds_equal_a_fold(spark):
    rng = random.Random(2)
    at = lambda: dt.datetime(2024, 1, 1) + dt.timedelta(hours=rng.randint(0, 24 * 60))
    side = lambda n, top: [(i, at(), rng.choice([100, 200, 300, top]), rng.choice("pqr"), rng.choice("xyz"), rng.choice([None, None, f"r{rng.randint(0, 9)}"])) for i in range(n)]
    payments, refunds = side(60, 900), side(50, 150)
    left, want = {p[0]: p[2] for p in payments}, {}
    for r in sorted(refunds, key=lambda r: (r[1], r[0])):
        near = lambda p: p[1] <= r[1] and p[1] >= r[1] - dt.timedelta(30) and left[p[0]] >= r[2]  # noqa: E731, B023
        by_ref = [p for p in payments if r[5] and p[5] == r[5] and left[p[0]] >= r[2]]
        by_shop = sorted((p for p in payments if p[3] == r[3] and near(p)), key=lambda p: (p[2] != r[2], -p[1].timestamp(), p[0]))
        by_card = sorted((p for p in payments if p[4] == r[4] and p[2] == r[2] and near(p)), key=lambda p: (-p[1].timestamp(), p[0]))
        by_ref.sort(key=lambda p: (p[2] != r[2], -p[1].timestamp(), p[0]))
        for tier, found in ((1, by_ref), (2, by_shop), (3, by_card)):
            if found:
                left[found[0][0]] -= r[2]
                want[r[0]] = (found[0][0], tier)
                break
    schema = "id bigint, ts timestamp_ntz, cents bigint, shop string, card string, ref string"
    got = matching.assign_refunds(spark.createDataFrame(payments, schema), spark.createDataFrame(refunds, schema), days=30)
    assert {r["refund"]: (r["payment"], r["tier"]) for r in got.collect()} == want


def test_bills_are_linked_once(spark):
    t = dt.datetime(2024, 1, 1)
    payments = [(1, t, 1000), (2, t + dt.timedelta(minutes=5), 1000), (3, t, 9999)]
    bills = [(11, t + dt.timedelta(minutes=1), 1000), (12, t + dt.timedelta(minutes=2), 1020), (13, t + dt.timedelta(minutes=16), 9999)]
    schema = "id bigint, ts timestamp_ntz, cents bigint"
    got = matching.link_bills(spark.createDataFrame(payments, schema), spark.createDataFrame(bills, schema))
    assert sorted(map(tuple, got.collect())) == [(1, 11), (2, 12)]


def test_bills_of_one_large_component_equal_a_fold(spark):
    rng = random.Random(6)
    pairs = list({(rng.randint(1, 60), rng.randint(1, 60)): rng.randint(0, 9) for _ in range(600)}.items())
    want, lefts, rights = set(), set(), set()
    for (a, b), _ in sorted(pairs, key=lambda p: (p[1], *p[0])):
        if a not in lefts and b not in rights:
            want.add((a, b)), lefts.add(a), rights.add(b)
    got = matching.one_to_one(spark.createDataFrame([(a, b, n) for (a, b), n in pairs], "l bigint, r bigint, apart int"), "l", "r", ["apart"])
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    assert "InPandas" not in got._jdf.queryExecution().toString()


def test_refunds_of_one_shop_are_not_one_group(spark):
    t = dt.datetime(2024, 1, 1)
    payments = [(1, t, 1000, "p", "x", None), (2, t + dt.timedelta(hours=1), 250, "p", "x", None)]
    refunds = [(10 + i, t + dt.timedelta(hours=2 + i), 100, "p", "x", None) for i in range(14)]
    schema = "id bigint, ts timestamp_ntz, cents bigint, shop string, card string, ref string"
    got = matching.assign_refunds(spark.createDataFrame(payments, schema), spark.createDataFrame(refunds, schema), days=30)
    assert {r["refund"]: r["payment"] for r in got.collect()} == {10: 2, 11: 2} | {10 + i: 1 for i in range(2, 12)}
    assert "InPandas" not in got._jdf.queryExecution().toString()


def test_components_of_links(spark):
    links = [(i, i + 1) for i in range(12)] + [(20, 5), (30, 31)]
    got = {r["v"]: r["root"] for r in components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {**dict.fromkeys([*range(13), 20], 0), 30: 30, 31: 30}


def test_merge_retract_and_ids(spark):
    schema = "id bigint, ts timestamp_ntz, cents bigint, direction string, payee string, card string, category string, refs map<string,string>, sources array<string>"
    t = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([(1, t, 5, "debit", "a", None, "x", {"utr": "U"}, ["f"]), (2, t, 5, "debit", "b", "c", "y", {"utr": "U"}, ["g", "f"]), (3, t, 5, "debit", "z", None, None, {}, ["g"])], schema)
    got = {r["id"]: r for r in matching.merged(rows).collect()}
    assert (got[1]["payee"], got[1]["card"], got[1]["sources"], got[1]["records"]) == ("a", "c", ["f", "g"], 2) and len(got) == 2
    assert {r["id"] for r in matching.retracted(rows, "g").collect()} == {1, 2}
    assert matching.unique_ids(rows.withColumn("id", F.lit(7))).select("id").distinct().count() == 3


def test_cascade_of_rules(spark):
    rows = [(1, "Shell Fuel", None, "debit", None, None), (2, "Ann Lee", None, "debit", None, None), (3, "Acme", "xx 1234", "debit", None, None), (4, "Acme", None, "credit", "cashback", None),
            (5, "Joe's Cafe Ltd", None, "debit", None, None), (6, "???", None, "debit", None, None), (7, "Acme", None, "credit", None, None), (8, "Zed 9", None, "debit", None, None)]
    moves = spark.createDataFrame(rows, "id bigint, payee string, payee_handle string, direction string, kind string, note string")
    got = rules.decide(moves, spark.createDataFrame([(6, "gifts")], "id bigint, category string"), spark.createDataFrame([("joes cafe", "food.coffee")], "name string, category string"),
                       spark.createDataFrame([("1234",)], "digits string"), spark.createDataFrame([("Zed 9", "hobby", "user"), ("zed 9", "wrong", "model")], "name string, category string, by string"))
    assert {r["id"]: r["category"] for r in got.collect()} == {1: "travel.fuel", 2: "transfers.p2p", 3: "transfers.self", 4: "income.cashback", 5: "food.coffee", 6: "gifts", 7: "income.received", 8: "hobby"}
    kept = rules.remember(spark.createDataFrame([("A", "x", "user", 1), ("a", "y", "model", 9), ("B", "z", "model", 1), ("b", "w", "model", 2)], "name string, category string, by string, ts int"))
    assert dict(map(tuple, kept.select("name", "category").collect())) == {"a": "x", "b": "w"}


def test_proof_of_random_statements(spark):
    rng = random.Random(3)
    rows, heads, want = [], [], {}
    for s in range(60):
        convention = rng.choice(proof.CONVENTIONS)
        truth = [(DAY + dt.timedelta(rng.randint(0, 29)), rng.randint(100, 99999), rng.random() < 0.3) for _ in range(rng.randint(2, 8))]
        for reading in ("wide", "narrow"):
            for k, (day, cents, credit) in enumerate(truth):
                wrong = reading == "narrow" and k == 0
                mark = "Cr" if credit and convention == "marked" else None
                sign = {"minus": "-", "plus": "+"}.get(convention) if credit else None
                rows.append((s, reading, day, cents + 777 * wrong, mark, sign))
        debits, credits = sum(c for _, c, b in truth if not b), sum(c for _, c, b in truth if b)
        printed = s % 5 != 0
        previous = rng.randint(0, 10**6)
        heads.append((s, previous if printed else None, previous - credits + debits if printed else None, None, None))
        want[s] = ("proven", debits, credits) if printed else ("nothing to check by", None, None)
    got = proof.prove(spark.createDataFrame(rows, "statement int, reading string, day date, cents bigint, mark string, sign string"),
                      spark.createDataFrame(heads, "statement int, previous bigint, due bigint, printed_debits bigint, printed_credits bigint"))
    assert {r["statement"]: (r["status"], r["debits"], r["credits"]) for r in got.collect()} == want


def test_counting_nets_refunds_on_their_payment(spark):
    schema = "id bigint, day date, cents bigint, direction string, channel string, payee string, shop string, card string, category string, refund_of bigint, ts timestamp_ntz"
    t = dt.datetime(2024, 1, 5)
    rows = [(1, DAY, 1000, "debit", "card", "p", "s", "c", "food.out", None, t), (2, dt.date(2025, 1, 1), 400, "credit", "upi", "q", "t", None, "food.out", 1, t), (3, DAY, 50, "credit", "upi", "z", "z", None, "food.out", 99, t)]
    got = counted.counted(spark.createDataFrame(rows, schema))
    r = {x["id"]: x for x in got.collect()}
    assert (r[2]["eff_day"], r[2]["signed"], r[2]["n"], r[2]["owner_payee"], r[2]["bucket"]) == (DAY, -400, 0, "p", "spent") and r[3]["owner_payee"] == "z"
    total = answer(spark, got, Query(period=Period.year(2024))).first()
    assert (total["amount"], total["payments"]) == (5.5, 1)
    assert answer(spark, got, Query("average", Period.year(1990))).first()["average"] is None
    with pytest.raises(ValueError):
        answer(spark, got, Query("poem"))


def test_files(spark, tmp_path):
    (tmp_path / "card.csv").write_text("Txn Date;Narration;Withdrawal Amt;Deposit Amt\n05/03/2024;Cafe;12.50;\n06/03/2024;Refund;;3.00\n;note;;\n")
    got = files.card_rows(files.read_delimited(spark, str(tmp_path / "card.csv"))).orderBy("day").collect()
    assert [tuple(r) for r in got] == [(dt.date(2024, 3, 5), "Cafe", 1250, False), (dt.date(2024, 3, 6), "Refund", 300, True)]
    (tmp_path / "upi.txt").write_text("header\nMar 05, 2024\n10:15 am\nPaid to Ann\nTransaction ID T1\nUTR No. U1\nDEBIT ₹1,200\nMar 06, 2024\nReceived from Bob\nCREDIT ₹7\n")
    got = files.read_activity(spark, str(tmp_path / "upi.txt")).orderBy("record").collect()
    assert [(r["payee"], r["txn_id"], r["utr"], r["direction"], r["amount"]) for r in got] == [("Ann", "T1", "U1", "DEBIT", "1,200"), ("Bob", None, None, "CREDIT", "7")]
    (tmp_path / "x.json").write_text('[{"Title": "a", "value": 1}, {"Title": "b", "value": null}]')
    got = files.read_json_records(spark, str(tmp_path / "x.json"), {"name": ["payee", "title"], "amount": ["value"]}).orderBy("name").collect()
    assert [tuple(r) for r in got] == [("a", "1"), ("b", None)]
    with pytest.raises(ValueError):
        files.card_rows(spark.createDataFrame([("x",)], "nothing string"))
    assert one(spark, files.file_kind(F.lit("Transaction ID 1, UTR 2, paid to x")), files.file_kind(F.lit("hello")), files.redacted(F.lit("acc 123456789 me@x.org"))) == ["upi", None, "acc XXXXX6789 hidden@x.org"]


def test_store_by_year(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = spark.createDataFrame([(1, dt.datetime(2023, 1, 1)), (2, dt.datetime(2024, 1, 1))], "id bigint, ts timestamp_ntz")
    files.save_by_year(rows, path)
    files.save_by_year(rows.filter("id = 2").withColumn("id", F.lit(5).cast("bigint")), path)
    assert sorted(r["id"] for r in files.load_by_year(spark, path).collect()) == [1, 5]
    assert files.load_by_year(spark, path, [2023]).count() == 1


def test_intervals(spark):
    rows = spark.createDataFrame([(1, dt.date(2024, 1, 30), dt.date(2024, 3, 1)), (2, DAY, DAY), (3, DAY, dt.date(2023, 1, 1))], "id int, a date, b date")
    got = sorted((r["id"], r["month"], r["days"]) for r in dates.prorated(rows, "a", "b").collect())
    assert got == [(1, "2024-01", 2), (1, "2024-02", 29), (1, "2024-03", 1), (2, "2024-01", 1)]


def test_streams(spark, tmp_path):
    schema = "id bigint, ts timestamp, cents bigint, bucket string, refund_of bigint"
    t = dt.datetime(2024, 1, 1)
    rows = [(1, t, 100, "spent", None), (1, t, 100, "spent", None), (2, t + dt.timedelta(hours=3), 50, "spent", None), (3, t + dt.timedelta(days=9), 40, "in", 1)]
    spark.createDataFrame(rows, schema).repartition(1).write.parquet(str(tmp_path / "in"))

    def run(name, plan):
        query = plan.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination(120)
        return spark.table(name).collect()

    source = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    assert sorted(r["id"] for r in run("once", imports.once(source()))) == [1, 2, 3]
    days = run("days", imports.daily_totals(source()))
    assert [(r["cents"], r["rows"]) for r in days] == [(250, 3)]
    linked = run("linked", imports.refunds_of(source().filter("refund_of is null"), source().filter("refund_of is not null")))
    assert {(r["refund"], r["payment"]) for r in linked} == {(3, 1)}


def test_choices_in_turn_equal_a_fold(spark):
    rng = random.Random(9)
    pairs = {(rng.randint(1, 40), rng.randint(100, 130)): rng.randint(0, 9) for _ in range(300)}
    at = {i: rng.randint(0, 20) for i in range(1, 41)}
    want, used = {}, set()
    for left in sorted(at, key=lambda i: (at[i], i)):
        for apart, right in sorted((n, r) for (a, r), n in pairs.items() if a == left):
            if right not in used:
                want[left] = right
                used.add(right)
                break
    frame = spark.createDataFrame([(a, b, at[a], n) for (a, b), n in pairs.items()], "l bigint, r bigint, at int, apart int")
    got = cards.in_turn(frame, "l", "r", ["at"], ["apart"])
    assert {r["l"]: r["r"] for r in got.collect()} == want and got.count() == len(want)


def test_imports_join_what_their_match_has_joined(spark):
    """Four records of one payment: the second finds the first by its time, the third the second by its number, the fourth the
    card's row; a fifth of another number is another payment, though it is as near to the first."""
    t = dt.datetime(2024, 1, 5, 10)
    schema = "id bigint, ts timestamp_ntz, cents bigint, direction string, payee string, channel string, card string, paid_from string, file string, refs map<string,string>, arrived bigint"
    rows = [
        (1, t, 500, "debit", "Acme", "upi", None, "XXXX34", "a", {}, 1), (2, t + dt.timedelta(minutes=5), 500, "debit", "Acme Ltd", "upi", None, None, "a", {"txnId": "T"}, 2),
        (3, t + dt.timedelta(hours=8), 500, "debit", "zz", "upi", None, None, "b", {"txnId": "T"}, 3), (4, t + dt.timedelta(days=1), 500, "debit", "POS", "card", "c", "XX1234", "s", {"cardRow": "r"}, 4),
        (5, t + dt.timedelta(minutes=6), 500, "debit", "Acme", "upi", None, None, "b", {"txnId": "U"}, 5), (6, t, 501, "debit", "Acme", "upi", None, None, "a", {}, 6),
    ]
    new = spark.createDataFrame(rows, schema)
    got = {r["id"]: (r["root"], r["tier"]) for r in cascade.linked(new.limit(0).drop("arrived"), new).collect()}
    assert got == {1: (1, None), 2: (1, 2), 3: (3, None), 4: (1, 3), 5: (5, None), 6: (6, None)}


def test_a_folder_is_shared_only_where_machines_share_it():
    class Session:
        def __init__(self, **settings):
            self.conf, self.settings = self, settings

        def get(self, name, default):
            return self.settings.get(name.split(".")[1], default)

    assert components.shared_folder(Session(checkpoint="/shared/")) == "/shared"
    own = components.shared_folder(Session(master="local[2]"))
    assert own and own == components.shared_folder(Session(master="local[2]"))
    with pytest.raises(ValueError):
        components.shared_folder(Session(master="yarn"))


def test_forgetting_touches_only_what_it_reaches(spark):
    """Links out of reach of what is gone are taken as they are, even where they are not what would be decided today."""
    schema = "id bigint, ts timestamp_ntz, cents bigint, shop string, card string, ref string"
    day = lambda n: dt.datetime(2024, 1, n)
    payments = spark.createDataFrame([(1, day(1), 500, "a", "c", None), (2, day(2), 500, "a", "c", None), (3, day(1), 700, "b", "d", None), (4, day(2), 700, "b", "d", None)], schema)
    refunds = spark.createDataFrame([(11, day(5), 500, "a", "c", None), (12, day(6), 700, "b", "d", None)], schema)
    before = spark.createDataFrame([(11, 2, 2), (12, 3, 2)], "refund bigint, payment bigint, tier int")
    got = {r["refund"]: r["payment"] for r in matching.reassigned(payments, refunds, before, spark.createDataFrame([(2,)], "id bigint")).collect()}
    assert got == {11: 1, 12: 3}
    assert {r["refund"] for r in matching.reassigned(payments, refunds, before, spark.createDataFrame([(12,)], "id bigint")).collect()} == {11}


@pytest.mark.parametrize("tolerance, spread", [(100, 300), (100, 12_000), (7, 60), (3, 40), (2, 30)])
def test_mutually_unique_against_all_pairs(spark, tolerance, spread):
    """Dense and sparse amounts, equal ones, amounts at the edges of cells, and days at both ends of the window."""
    rng = random.Random(tolerance * spread)
    sides = [[(i + 1000 * k, DAY + dt.timedelta(rng.randrange(12)), rng.choice([rng.randrange(spread), rng.randrange(spread // 10 + 1) * (tolerance // 2)])) for i in range(60)] for k in (0, 1)]
    payments, bills = (spark.createDataFrame(s, "id bigint, day date, cents bigint") for s in sides)
    pairs = [(p[0], b[0]) for p in sides[0] for b in sides[1] if abs(p[2] - b[2]) <= tolerance and 0 <= (p[1] - b[1]).days <= 5]
    want = [x for x in pairs if sum(y[0] == x[0] for y in pairs) == 1 and sum(y[1] == x[1] for y in pairs) == 1]
    assert sorted(map(tuple, matching.mutually_unique(payments, bills, tolerance).collect())) == sorted(want)


def test_mutually_unique_pairs_no_crowds(spark):
    """Thirty thousand payments and bills of one day and amount are two rows, not 900 million pairs; a pair apart is still found."""
    crowd = spark.range(30_000).select("id", F.lit(DAY).alias("day"), F.lit(5000).cast("bigint").alias("cents"))
    two = lambda i: spark.createDataFrame([(i, DAY, 9000)], "id bigint, day date, cents bigint")
    out = matching.mutually_unique(crowd.unionByName(two(40_000)), crowd.unionByName(two(40_001)))
    assert [tuple(r) for r in out.collect()] == [(40_000, 40_001)]
