"""Imports against one plain fold over all rows, on batches whose rows want the same records."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import cascade

SCHEMA = "id bigint, ts timestamp_ntz, cents bigint, direction string, kind string, payee string, payee_handle string, channel string, app string, card string, paid_from string, category string, merchant_category string, note string, file string, refs map<string,string>, sources array<string>, arrived bigint"
T = dt.datetime(2024, 3, 5, 10)
NAMES = [x.split(" ")[0] for x in SCHEMA.split(", ")]


def row(i, minutes=0, payee="Acme", refs=None, arrived=None, **more):
    out = dict.fromkeys(NAMES) | {"id": i, "ts": T + dt.timedelta(minutes=minutes), "cents": 500, "direction": "debit", "kind": "spend", "payee": payee, "channel": "upi", "refs": refs or {}, "sources": ["a"], "file": "a", "arrived": arrived} | more
    return tuple(out[n] for n in NAMES)


def run(spark, old, new):
    links, records = cascade.imported(spark.createDataFrame(old, SCHEMA).drop("arrived"), spark.createDataFrame(new, SCHEMA))
    return {r["id"]: (r["root"], r["tier"]) for r in links.collect()}, {r["id"]: r for r in records.collect()}


# The plain fold: one list of records, each new row held against all of them.
def clean(name):
    return "".join(c for c in (name or "").lower() if c in "abcdefghijklmnopqrstuvwxyz0123456789")


def words(r):
    import re

    return {w for w in re.findall("[a-z]{4,}", f"{r['payee'] or ''} {r['note'] or ''}".lower()) if w not in cascade.NO_NAMES}


def rows_of(r):
    return [v for k, v in r["refs"].items() if k.startswith("cardRow")]


def plain_fits(a, b):
    if (a["direction"], a["cents"]) != (b["direction"], b["cents"]):
        return False
    if a["refs"].get("utr") is not None and a["refs"].get("utr") == b["refs"].get("utr"):
        return True
    if rows_of(a) and rows_of(b) and not set(rows_of(a)) & set(rows_of(b)):
        return False
    return not any(k in b["refs"] and b["refs"][k] != v for k, v in a["refs"].items() if "cardRow" not in k)


def plain_names(a, b):
    x, y = clean(a["payee"]), clean(b["payee"])
    return bool(x) and bool(y) and (x in y or y in x)


def plain_tier(e, r):
    """The tier of a record that is not found by a key, or None."""
    seconds, days = abs((e["ts"] - r["ts"]).total_seconds()), abs((e["ts"].date() - r["ts"].date()).days)
    if seconds <= 600 and plain_fits(e, r) and plain_names(e, r):
        return 2
    sides = sorted((e, r), key=lambda x: "cardRow" in x["refs"])
    app, card = sides
    if "cardRow" in card["refs"] and "cardRow" not in app["refs"] and plain_fits(app, card):
        import re

        m = re.fullmatch("X{4}([0-9]{2})", app["paid_from"] or "")
        if m and (card["paid_from"] or "").endswith(m[1]) and days <= (1 if app["channel"] == "upi" else 3):
            return 3
    if (e["direction"], e["cents"]) == (r["direction"], r["cents"]) and rows_of(e) and rows_of(r) and not set(rows_of(e)) & set(rows_of(r)) and e["card"] and e["card"] == r["card"] and days <= 3 and not set(e["sources"]) & set(r["sources"]):
        apart = any(e["refs"].get(k) and r["refs"].get(k) and e["refs"][k] != r["refs"][k] for k in ("utr", "txnId"))
        if not apart and clean(e["payee"]) and clean(r["payee"]) and (plain_names(e, r) or words(e) & words(r)):
            return 4
    return None


def plain_keys(r):
    found = [f"utr:{r['refs']['utr']}"] if "utr" in r["refs"] else []
    found += [f"txn:{r['refs']['txnId']}"] if "txnId" in r["refs"] else []
    return [*found, *sorted(f"row:{x}" for x in rows_of(r)), f"{r['ts']:%Y%m%d%H%M} {clean(r['payee'])}"]


def plain_merge(e, r):
    reading = ("ts", "channel", "paid_from", "payee")
    if e["refs"].get("cardRow") and e["refs"].get("cardRow") == r["refs"].get("cardRow"):
        from_app = e["app"] or [k for k in e["refs"] if k != "cardRow"]
        e |= {"kind": r["kind"], "note": r["note"], "card": r["card"] or e["card"], "merchant_category": r["merchant_category"] or e["merchant_category"]}
        e |= {} if from_app else {k: r[k] for k in reading}
    elif ("cardRow" in e["refs"]) is not ("cardRow" in r["refs"]):
        app = r if "cardRow" in e["refs"] else e
        e |= {k: app[k] for k in reading} | {k: app[k] or e[k] for k in ("payee_handle", "app")} | {k: e[k] or r[k] for k in ("card", "merchant_category")}
    for x in sorted(set(rows_of(r)) - set(rows_of(e))):
        n = 1
        while (k := f"cardRow{n if n > 1 else ''}") in e["refs"]:
            n += 1
        e["refs"][k] = x
    if e["kind"] == "income" and r["kind"] in ("refund", "cashback"):
        e |= {k: r[k] for k in ("kind", "payee", "category")}
        if r["refs"].get("txnId"):
            e["refs"]["txnId"] = r["refs"]["txnId"]
    e["sources"] += [s for s in r["sources"] if s not in e["sources"]]
    for k, v in r["refs"].items():
        if "cardRow" not in k:
            e["refs"].setdefault(k, v)
    e |= {k: e[k] or r[k] for k in ("payee_handle", "paid_from")}


def plain_import(old, new):
    copy = lambda r: r | {"refs": dict(r["refs"]), "sources": list(r["sources"])}
    records = [copy(r) for r in sorted(old, key=lambda r: (r["ts"], r["id"]))]
    index = {(r["direction"], r["cents"], k): r for r in records for k in plain_keys(r)}
    links = {r["id"]: (r["id"], None) for r in old}
    for r in sorted(new, key=lambda r: r["arrived"]):
        hits = [e for k in plain_keys(r) if (e := index.get((r["direction"], r["cents"], k))) is not None and plain_fits(e, r)]
        tiers = [(plain_tier(e, r), abs((e["ts"] - r["ts"]).total_seconds()), e) for e in records]
        loose = [e for t, _, e in tiers if t == 2]
        on_card = [(s, n, e) for n, (t, s, e) in enumerate(tiers) if t == 3]
        files = [(s, n, e) for n, (t, s, e) in enumerate(tiers) if t == 4]
        e, tier = (hits[0], 1) if hits else (loose[0], 2) if loose else (min(on_card)[2], 3) if on_card else (min(files)[2], 4) if files else (None, None)
        if e is None:
            e = copy(r)
            records.append(e)
            index |= {(r["direction"], r["cents"], k): e for k in plain_keys(r)}
        else:
            plain_merge(e, r)
        links[r["id"]] = (e["id"], tier)
    return links, {e["id"]: e for e in records}


def random_batch(rng, base, size):
    """Rows of one amount within days, with few payees, references, cards and files, so that most want the records of others."""
    rows = []
    for k in range(size):
        listed = rng.random() < 0.45
        refs = {n: f"{base}{n}{rng.randint(1, 4)}" for n, p in (("utr", 0.25), ("txnId", 0.3), ("orderId", 0.1)) if rng.random() < p}
        if listed:
            refs["cardRow"] = f"{base}r{rng.randint(1, 9)}"
        file = rng.choice(["s1", "s2"] if listed else ["p", "g"])
        rows.append(dict(zip(NAMES, row(
            base * 1000 + k, rng.choice([0, 3, 9, 14, 600, 1500, 3000, 4400]) + rng.randint(0, 8), rng.choice(["Acme", "Acme Ltd", "acme online", "Beta tools", "Tools beta", "Zed", "", None]), refs, None,
            cents=base * 10 + rng.choice([0, 0, 0, 1]), direction=rng.choice(["debit"] * 4 + ["credit"]), kind=rng.choice(["spend", "income", "refund", "cashback"]), channel="card" if listed else rng.choice(["upi", "card"]), app=None if listed else rng.choice([None, "p"]), card=rng.choice(["c1", "c2"]) if listed else None,
            paid_from=rng.choice(["XX1234", "XX5634", "XX1299"]) if listed else rng.choice(["XXXX34", "XXXX99", None]), category=f"k{k % 3}", note=rng.choice([None, "tools for acme", "online store"]), payee_handle=rng.choice([None, "h@x"]), sources=[file], file=file), strict=True)))
    cut = rng.randint(0, size // 2)
    new = rows[cut:]
    rng.shuffle(new)
    return [r | {"arrived": None} for r in rows[:cut]], [r | {"arrived": base * 1000 + n} for n, r in enumerate(new)]


def test_a_thousand_random_batches(spark):
    """Batches have amounts of their own, so that one import of all of them is as many imports."""
    rng = random.Random(11)
    old, new, want, records = [], [], {}, {}
    for base in range(1, 1001):
        a, b = random_batch(rng, base, rng.randint(2, 14))
        links, states = plain_import(a, b)
        old, new, want, records = old + a, new + b, want | links, records | states
    to = lambda rows: [tuple(r[n] for n in NAMES) for r in rows]
    got, kept = run(spark, to(old), to(new))
    assert {i: (got.get(i), w) for i, w in want.items() if got.get(i) != w} == {}
    assert {t for _, t in want.values()} == {None, 1, 2, 3, 4} and sum(t is not None for _, t in want.values()) > 1500
    assert kept.keys() == records.keys()
    for i, e in records.items():
        for n in NAMES:
            if n not in ("file", "arrived"):
                assert kept[i][n] == e[n], (i, n, kept[i][n], e[n])


def test_two_rows_of_one_statement_do_not_share_a_record(spark):
    old = [row(1, paid_from="XXXX34")]
    card = lambda i, r: row(i, 200, "POS", {"cardRow": r}, i, channel="card", card="c", paid_from="XX1234", sources=["s"], file="s")
    got, kept = run(spark, old, [card(2, "r1"), card(3, "r2")])
    assert got == {1: (1, None), 2: (1, 3), 3: (3, None)} and kept[1]["refs"] == {"cardRow": "r1"} and kept[1]["card"] == "c" and kept[1]["payee"] == "Acme"


def test_two_teas(spark):
    got, _ = run(spark, [row(1)], [row(2, 0, "Acme", {"utr": "u1"}, 1), row(3, 0, "Acme", {"utr": "u2"}, 2), row(4, 1, "Acme", {"utr": "u2"}, 3)])
    assert got == {1: (1, None), 2: (1, 1), 3: (3, None), 4: (3, 1)}


def test_a_state_reaches_rows_that_no_single_row_does(spark):
    """The statement's row takes the time of an app's record found by its number, days away, and is then found by its time."""
    got, _ = run(spark, [row(1, 0, "POS", {"cardRow": "r", "utr": "u"}, channel="card", card="c", paid_from="XX1234", sources=["s"])],
                 [row(2, 50000, "Acme", {"utr": "u"}, 1), row(3, 50004, "Acme Ltd", {}, 2), row(4, 3, "POS", {}, 3)])
    assert got == {1: (1, None), 2: (1, 1), 3: (1, 2), 4: (4, None)}


def test_odd_rows_of_an_import(spark):
    nothing = [dict.fromkeys(NAMES) | {"id": i, "arrived": i} for i in (1, 2)]
    got, kept = run(spark, [], [tuple(r[n] for n in NAMES) for r in nothing])
    assert got == {1: (1, None), 2: (2, None)} and len(kept) == 2
    assert run(spark, [], []) == ({}, {})


@pytest.mark.parametrize("order", [(2, 3), (3, 2)])
def test_the_first_to_come_takes_the_record(spark, order):
    new = [row(i, 5, "Acme", {"txnId": f"t{i}"}, order.index(i)) for i in order]
    got, _ = run(spark, [row(1)], new)
    assert got[order[0]] == (1, 2) and got[order[1]] == (order[1], None)


def test_many_small_groups_go_to_python_together(spark):
    """Groups beside each other, a null key's among them, and more than go at once: each is given whole, and none is its own call."""
    from pyspark.sql.types import StructType

    rows = spark.range(3000).select(F.when(F.col("id") >= 5, F.col("id") % 700).alias("k"), "id")
    run = lambda k, rows: [{"k": k, "n": len(rows), "ids": sum(r["id"] for r in rows)}]
    out = cascade._by_group(rows, "k", run, StructType.fromDDL("k bigint, n bigint, ids bigint"))
    want = rows.groupBy("k").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))
    assert sorted(map(str, out.collect())) == sorted(map(str, want.collect()))
    assert "FlatMapGroups" not in out._jdf.queryExecution().toString()
