"""Imports: each new record finds the record of the same movement by ordered tiers, and what is found becomes one record.

An import is a fold: each row is held against the records as they have become, with the references, statement rows, files,
time and payee they have taken over from the rows before it. Only rows of one direction and amount ever meet, so these are
shuffled to one task and folded there, in order of arrival. Of a direction and amount with too many rows for that, rows that
could ever meet are linked first (joins on equal keys), chains of links are the components of that graph, and each component
is folded by itself. What records have become may reach rows outside: their states are joined against all rows again, and
components that would meet are folded anew as one, until none do. The result is that of one fold over all rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from ..functions.labels import statement_rows
from ..functions.text import compact, long_words
from .components import components, cut
from .matching import CARD_DAYS, FILE_DAYS, LOOSE_MINUTES, UPI_DAYS, match_keys

#: The columns of a record that the tiers look at.
FIELDS = ["id", "ts", "cents", "direction", "payee", "channel", "card", "paid_from", "file", "refs"]
#: What else a record is made of; those that a table lacks are null.
MORE = {"kind": "string", "payee_handle": "string", "app": "string", "category": "string", "merchant_category": "string", "note": "string", "sources": "array<string>"}
#: Words that say nothing about which shop it was (fixed values).
NO_NAMES = (
    "payment", "purchase", "india", "private", "limited", "store", "stores", "online", "services", "retail", "bangalore", "bengaluru", "mumbai", "delhi", "pune", "chennai", "hyderabad", "kolkata", "gurgaon", "noida",
)


def _side(rows: DataFrame, p: str) -> DataFrame:
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    return rows.select(
        F.col("id").alias(f"{p}_id"), "cents", "direction", seconds.alias(f"{p}_at"), F.unix_date(F.to_date("ts")).alias(f"{p}_day"), compact("payee").alias(f"{p}_key"), long_words("payee").alias(f"{p}_words"), F.col("channel").alias(f"{p}_channel"),
        F.col("card").alias(f"{p}_card"), F.col("paid_from").alias(f"{p}_from"), F.col("file").alias(f"{p}_file"), F.col("refs")["utr"].alias(f"{p}_utr"), F.col("refs")["txnId"].alias(f"{p}_txn"), statement_rows("refs").alias(f"{p}_rows"),
    )


def compatible() -> Column:
    """Whether no reference tells a pair apart: an equal bank reference makes it one whatever else differs; rows of two
    statements are two unless they share one."""
    apart = lambda c: F.coalesce(F.col(f"old_{c}") != F.col(f"new_{c}"), F.lit(False))
    same_utr = F.coalesce(F.col("old_utr") == F.col("new_utr"), F.lit(False))
    two_rows = (F.size("old_rows") > 0) & (F.size("new_rows") > 0) & ~F.arrays_overlap("old_rows", "new_rows")
    return same_utr | ~(apart("utr") | apart("txn") | two_rows)


def _near(old: DataFrame, new: DataFrame, on: list[str], unit: str, width: int) -> DataFrame:
    """Pairs of equal keys whose times (`unit`: at in seconds, or day) are at most `width` apart, by spans of that width."""
    span = lambda p: F.floor(F.col(f"{p}_{unit}") / width)
    spread = old.withColumn("_span", F.explode(F.array(*[span("old") + k for k in (-1, 0, 1)])))
    return new.withColumn("_span", span("new")).join(spread, [*on, "_span"]).filter(F.abs(F.col(f"old_{unit}") - F.col(f"new_{unit}")) <= width)


def candidates(old: DataFrame, new: DataFrame) -> DataFrame:
    """(new_id, old_id, tier, apart): the records that a new one may be the same movement as, of equal direction and cents.

    1: a key in common (bank reference, transaction, statement row, or minute and payee); 2: within minutes, one payee inside
    the other; 3: a statement's row and the app's record of a payment by that card, a day apart by UPI, else three; 4: rows
    of two files of a card, three days apart, payees alike. `apart` is in seconds.
    """
    # Every tier reads both sides; what it takes to make them is done once.
    a, b = cut(_side(old, "old")), cut(_side(new, "new"))
    apart = F.abs(F.col("old_at") - F.col("new_at"))
    keep = lambda pairs, tier: pairs.select("new_id", "old_id", F.lit(tier).alias("tier"), (F.col("rank") if tier == 1 else F.lit(0)).alias("rank"), apart.alias("apart"))
    keyed = match_keys(new).withColumnRenamed("id", "new_id").join(match_keys(old).select(F.col("id").alias("old_id"), "key"), "key").groupBy("new_id", "old_id").agg(F.min("rank").alias("rank"))
    exact = keyed.join(a, "old_id").join(b, ["new_id", "direction", "cents"]).filter(compatible())
    alike = (F.col("old_key") != "") & (F.col("new_key") != "") & (F.col("old_key").contains(F.col("new_key")) | F.col("new_key").contains(F.col("old_key")))
    loose = _near(a, b, ["direction", "cents"], "at", LOOSE_MINUTES * 60).filter(alike & compatible())
    # A card's row ends in the two digits that an app writes behind its mask.
    digits = lambda p: F.when(F.size(f"{p}_rows") > 0, F.right(f"{p}_from", F.lit(2))).otherwise(F.regexp_extract(f"{p}_from", "^X{4}([0-9]{2})$", 1))
    on_card = _near(a.withColumn("_digits", digits("old")), b.withColumn("_digits", digits("new")), ["direction", "cents", "_digits"], "day", CARD_DAYS)
    app = F.when(F.size("old_rows") > 0, F.col("new_channel")).otherwise(F.col("old_channel"))
    one_row = (F.size("old_rows") > 0) != (F.size("new_rows") > 0)
    within = F.abs(F.col("old_day") - F.col("new_day")) <= F.when(app == "upi", UPI_DAYS).otherwise(CARD_DAYS)
    on_card = on_card.filter((F.col("_digits") != "") & one_row & within & compatible())
    files = _near(a, b.withColumn("old_card", F.col("new_card")), ["direction", "cents", "old_card"], "day", FILE_DAYS)
    words = alike | F.arrays_overlap("old_words", "new_words")
    refs = ~F.coalesce(F.col("old_utr") != F.col("new_utr"), F.lit(False)) & ~F.coalesce(F.col("old_txn") != F.col("new_txn"), F.lit(False))
    files = files.filter((F.size("old_rows") > 0) & (F.size("new_rows") > 0) & ~F.arrays_overlap("old_rows", "new_rows") & (F.col("old_file") != F.col("new_file")) & words & refs)
    return keep(exact, 1).unionByName(keep(loose, 2)).unionByName(keep(on_card, 3)).unionByName(keep(files, 4))


def matches(old: DataFrame, new: DataFrame) -> DataFrame:
    """(new_id, old_id, tier): for each new record the old one of the first tier that has any: the surest key, the nearest in
    time, then the smallest id."""
    best = F.min(F.struct("tier", "rank", "apart", "old_id")).alias("_b")
    return candidates(old, new).groupBy("new_id").agg(best).select("new_id", "_b.old_id", "_b.tier")


def prepared(old: DataFrame, new: DataFrame) -> DataFrame:
    """All records with their place in the order of the fold (`_seq`: negative for old ones) and those columns of a record that
    the tables have."""
    every = old.withColumn("arrived", F.lit(None).cast("bigint")).unionByName(new, allowMissingColumns=True)
    have = {c.lower() for c in every.columns}
    files = F.coalesce(*["sources"] * ("sources" in have), F.when(F.col("file").isNotNull(), F.array("file")), F.array().cast("array<string>"))
    refs = F.coalesce(F.map_filter("refs", lambda k, v: v.isNotNull()), F.create_map().cast("map<string,string>"))
    return every.select(*FIELDS[:-2], *[c for c in MORE if c != "sources" and c in have], refs.alias("refs"), files.alias("sources"), F.coalesce("arrived", F.lit(-1)).alias("_seq"))


def formed(rows: DataFrame) -> DataFrame:
    """Prepared rows with every column of a record and the normal forms that tiers compare: put on behind a shuffle, not before."""
    ref = lambda name, prefix: F.concat(F.lit(prefix), F.col("refs")[name])
    prints = F.concat_ws(":", F.lit("print"), F.date_format("ts", "yyyyMMddHHmm"), "cents", "direction", F.coalesce(compact("payee"), F.lit("")))
    keys = F.array_compact(F.concat(F.array(ref("utr", "utr:"), ref("txnId", "txn:")), F.transform(statement_rows("refs"), lambda r: F.concat(F.lit("row:"), r)), F.array(prints)))
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    words = lambda c: F.coalesce(long_words(c, NO_NAMES), F.array().cast("array<string>"))
    more = rows.withColumns({c: F.lit(None).cast(kind) for c, kind in MORE.items() if c not in rows.columns})
    return more.select(*FIELDS[:-2], *[c for c in MORE if c != "sources"], "refs", "sources", "_seq", seconds.alias("_at"), F.unix_date(F.to_date("ts")).alias("_day"),
                       F.coalesce(compact("payee"), F.lit("")).alias("_key"), words("payee").alias("_words"), words("note").alias("_noted"), keys.alias("_keys"))


def _reaches(states: DataFrame, rows: DataFrame, keys: bool) -> DataFrame:
    """(a, b): rows that a state of a record could take, by the tiers' conditions on times, cards, names and references."""
    side = lambda d, p: d.select(
        F.col("id").alias(f"{p}_id"), "direction", "cents", F.col("_seq").alias(f"{p}_seq"), F.col("_at").alias(f"{p}_at"), F.col("_day").alias(f"{p}_day"), F.col("_key").alias(f"{p}_key"), F.array_union("_words", "_noted").alias(f"{p}_words"), F.col("channel").alias(f"{p}_channel"),
        F.col("card").alias(f"{p}_card"), F.col("paid_from").alias(f"{p}_from"), F.col("sources").alias(f"{p}_files"), F.col("refs").alias(f"{p}_refs"), F.col("refs")["utr"].alias(f"{p}_utr"), F.col("refs")["txnId"].alias(f"{p}_txn"), statement_rows("refs").alias(f"{p}_rows"),
    )
    a, b = side(states, "old"), side(rows.filter("_seq >= 0"), "new")
    differs = lambda c: F.coalesce(F.col(f"old_{c}") != F.col(f"new_{c}"), F.lit(False))
    other = F.exists(F.map_entries("old_refs"), lambda e: ~e["key"].startswith("cardRow") & F.coalesce(F.col("new_refs")[e["key"]] != e["value"], F.lit(False)))
    listed = lambda p: F.size(f"{p}_rows") > 0
    shared = F.arrays_overlap("old_rows", "new_rows")
    fits = F.coalesce(F.col("old_utr") == F.col("new_utr"), F.lit(False)) | ~(other | (listed("old") & listed("new") & ~shared))
    alike = (F.col("old_key") != "") & (F.col("new_key") != "") & (F.col("old_key").contains(F.col("new_key")) | F.col("new_key").contains(F.col("old_key")))
    digits = lambda p: F.when(listed(p), F.right(f"{p}_from", F.lit(2))).otherwise(F.regexp_extract(f"{p}_from", "^X{4}([0-9]{2})$", 1))
    later = F.col("old_seq") < F.col("new_seq")
    loose = _near(a, b, ["direction", "cents"], "at", LOOSE_MINUTES * 60).filter(alike & fits & later)
    on_card = _near(a.withColumn("_digits", digits("old")), b.withColumn("_digits", digits("new")), ["direction", "cents", "_digits"], "day", CARD_DAYS).filter((F.col("_digits") != "") & (listed("old") != listed("new")) & fits & later)
    files = _near(a.filter(listed("old")), b.filter(listed("new")).withColumn("old_card", F.col("new_card")), ["direction", "cents", "old_card"], "day", FILE_DAYS)
    files = files.filter(~shared & ~F.arrays_overlap("old_files", "new_files") & (alike | F.arrays_overlap("old_words", "new_words")) & ~differs("utr") & ~differs("txn") & later)
    out = [x.select(F.col("old_id").alias("a"), F.col("new_id").alias("b")) for x in (loose, on_card, files)]
    if keys:
        # Rows of one key are linked to the smallest of them: the fold looks at all of a component anyway.
        keyed = rows.select("id", "_seq", "direction", "cents", F.explode("_keys").alias("_k"))
        first = keyed.groupBy("_k", "direction", "cents").agg(F.min("id").alias("a"), F.max("_seq").alias("_last")).filter("_last >= 0")
        out.append(keyed.join(first, ["_k", "direction", "cents"]).filter("id <> a").select("a", F.col("id").alias("b")))
    every = out[0]
    for x in out[1:]:
        every = every.unionByName(x)
    return every


#: What a record takes over together with another's reading: when it was and how it was paid, with the forms of these.
_READING = ("ts", "_at", "_day", "channel", "paid_from")
_NAMED = ("payee", "_key", "_words")


def _listed(refs: dict) -> set:
    return {v for k, v in refs.items() if k.startswith("cardRow") and v}


def _fits(a: dict, b: dict) -> bool:
    """No reference tells two rows of one direction and amount apart."""
    x, y = a["refs"], b["refs"]
    if x.get("utr") and x.get("utr") == y.get("utr"):
        return True
    if (p := _listed(x)) and (q := _listed(y)) and not p & q:
        return False
    return all(y.get(k, v) == v for k, v in x.items() if not k.startswith("cardRow"))


def _alike(a: dict, b: dict) -> bool:
    return bool(a["_key"] and b["_key"]) and (a["_key"] in b["_key"] or b["_key"] in a["_key"])


def _loose(a: dict, b: dict) -> bool:
    return abs(a["_at"] - b["_at"]) <= LOOSE_MINUTES * 60 and _alike(a, b) and _fits(a, b)


def _on_card(a: dict, b: dict) -> bool:
    if ("cardRow" in a["refs"]) == ("cardRow" in b["refs"]):
        return False
    card, app = (a, b) if "cardRow" in a["refs"] else (b, a)
    mask, paid = app["paid_from"] or "", card["paid_from"] or ""
    masked = len(mask) == 6 and mask.startswith("XXXX") and mask[4:].isdigit() and paid.endswith(mask[4:])
    return masked and abs(a["_day"] - b["_day"]) <= (UPI_DAYS if app["channel"] == "upi" else CARD_DAYS) and _fits(a, b)


def _in_two_files(a: dict, b: dict) -> bool:
    if not a["card"] or a["card"] != b["card"]:
        return False
    p, q = _listed(a["refs"]), _listed(b["refs"])
    if not p or not q or p & q or set(a["sources"]) & set(b["sources"]) or abs(a["_day"] - b["_day"]) > FILE_DAYS:
        return False
    if any(a["refs"].get(k) and b["refs"].get(k) and a["refs"][k] != b["refs"][k] for k in ("utr", "txnId")):
        return False
    return bool(a["_key"] and b["_key"]) and (_alike(a, b) or bool({*a["_words"], *a["_noted"]} & {*b["_words"], *b["_noted"]}))


def absorbed(into: dict, row: dict) -> dict:
    """What a record becomes when it takes a row in."""
    out, refs = dict(into), dict(into["refs"])
    take = lambda source, *names: out.update({c: source[c] for c in names})
    prefer = lambda source, rest, *names: out.update({c: source[c] or rest[c] for c in names})
    if refs.get("cardRow") and refs["cardRow"] == row["refs"].get("cardRow"):  # the row again: what its file says is read anew
        take(row, "kind", "note", "_noted")
        prefer(row, into, "card", "merchant_category")
        if not into["app"] and not set(refs) - {"cardRow"}:  # but an app's own reading stays
            take(row, *_READING, *_NAMED)
    elif ("cardRow" in refs) != ("cardRow" in row["refs"]):  # a statement's row and an app's record: each for what it knows
        app = row if "cardRow" in refs else into
        take(app, *_READING, *_NAMED)
        prefer(app, into, "payee_handle", "app")
        prefer(into, row, "card", "merchant_category")
    for value in sorted(_listed(row["refs"]) - _listed(refs)):
        names = ["cardRow", *(f"cardRow{n}" for n in range(2, len(refs) + 3))]
        refs[next(k for k in names if k not in refs)] = value
    if out["kind"] == "income" and row["kind"] in ("refund", "cashback"):  # says more, and has its payment's number
        take(row, "kind", "category", *_NAMED)
        refs |= {"txnId": row["refs"]["txnId"]} if row["refs"].get("txnId") else {}
    out["sources"] = [*into["sources"], *(s for s in dict.fromkeys(row["sources"]) if s not in into["sources"])]
    out["refs"] = {k: v for k, v in row["refs"].items() if not k.startswith("cardRow")} | refs
    prefer(out, row, "payee_handle", "paid_from")
    return out


def fold(rows: list[dict]) -> tuple[list[tuple], list[tuple[int, dict]]]:
    """Rows of one component, in order, as ((id, root, tier) of each, (seq, state) of each record that has changed, by step).

    Tiers: a key of a record as it was first (the surest key, the last record that has it); the first record in order that is
    loosely the same; the nearest in time on the other side of a card; the nearest among other files' rows. Only records of
    the row's direction and amount are looked at.
    """
    links, steps = [], []
    keyed: dict[tuple, int] = {}
    on_day: dict[tuple, set[int]] = {}
    states: list[dict] = []

    def put(i: int, state: dict) -> None:
        on_day.setdefault((state["direction"], state["cents"], state["_day"]), set()).add(i)

    for row in rows:
        group = (row["direction"], row["cents"])
        found, tier = None, 1
        if row["_seq"] >= 0:
            found = next((i for k in row["_keys"] if (i := keyed.get((*group, k))) is not None and _fits(states[i], row)), None)
        if found is None and row["_seq"] >= 0:
            reach = max(CARD_DAYS, FILE_DAYS)
            near = sorted(set().union(*(on_day.get((*group, row["_day"] + k), ()) for k in range(-reach, reach + 1))))
            apart = lambda i, row=row: abs(states[i]["_at"] - row["_at"])
            tries = (
                lambda: next((i for i in near if _loose(states[i], row)), None),
                lambda: min((i for i in near if _on_card(states[i], row)), key=apart, default=None),
                lambda: min((i for i in near if _in_two_files(states[i], row)), key=apart, default=None),
            )
            for tier, look in enumerate(tries, 2):  # noqa: B007
                found = look()
                if found is not None:
                    break
        if found is None:
            states.append(row)
            put(len(states) - 1, row)
            keyed |= {(*group, k): len(states) - 1 for k in row["_keys"]}
            links.append((row["id"], row["id"], None))
        else:
            on_day[*group, states[found]["_day"]].discard(found)
            states[found] = absorbed(states[found], row)
            put(found, states[found])
            links.append((row["id"], states[found]["id"], tier))
            steps.append((row["_seq"], states[found]))
    return links, steps


#: Groups that are Python rows at a time.
AT_ONCE = 256


def _by_group(rows: DataFrame, key: str, run: Callable[[object, list[dict]], list[dict]], schema: StructType) -> DataFrame:
    """What `run` makes of the rows of each key. Groups are a few rows each and very many, so a batch of them goes to Python at once."""
    arrow = to_arrow_schema(schema)
    own = [c for c in rows.columns if c != key]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(at, AT_ONCE)
                out = []
                for k, group in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    out += run(k, [r | {key: k} for r in group])
                yield pa.RecordBatch.from_pylist(out, arrow)

    return rows.groupBy(key).agg(F.collect_list(F.struct(*own)).alias("_rows")).mapInArrow(each, schema)


def _folded(every: DataFrame, group: DataFrame) -> DataFrame:
    """Rows (part 0: id, root, tier) and states (part 1: the record as it is from _seq on) of all components."""
    schema = StructType([*every.drop("_keys").schema.fields, *StructType.fromDDL("_part int, _c " + group.schema["root"].dataType.simpleString() + ", root " + every.schema["id"].dataType.simpleString() + ", tier int").fields])
    for f in schema.fields:
        f.nullable = True
    names = set(schema.names)

    def run(key, rows):
        for r in rows:
            r["refs"] = dict(r["refs"])
        rows = _ordered(rows)
        links, steps = fold(rows)
        at = {r["id"]: r["_seq"] for r in rows}
        out = [{"id": i, "root": root, "tier": tier, "_part": 0, "_c": key, "_seq": at[i]} for i, root, tier in links]
        out += [{**{k: v for k, v in state.items() if k in names}, "_seq": seq, "_part": 1, "_c": key, "refs": list(state["refs"].items())} for seq, state in steps]
        return out

    grouped = every.join(group.select(F.col("v").alias("id"), F.col("root").alias("_c")), "id")
    return _by_group(grouped, "_c", run, schema)


#: Rows of one direction and amount that a task holds, as dicts; of more rows, those that could meet are linked first.
AT_MOST = 4096
#: Rows of a batch that are Python rows at a time.
ROWS_AT_ONCE = 2048
_AMOUNT = ["direction", "cents"]
_WHOLE = "ts IS NOT NULL AND cents IS NOT NULL AND direction IS NOT NULL"


def _values(column: pa.Array) -> list:
    """A column as Python values, maps as dicts; the parts of lists and maps are read in one go, which is several times as fast."""
    if column.null_count == len(column):
        return [None] * len(column)
    if column.null_count or not (pa.types.is_list(column.type) or pa.types.is_map(column.type)):
        return column.to_pylist(maps_as_pydicts="strict")
    ends = column.offsets.to_pylist()
    part = lambda child: _values(child.slice(ends[0], ends[-1] - ends[0]))
    runs = [(a - ends[0], b - ends[0]) for a, b in itertools.pairwise(ends)]
    if pa.types.is_map(column.type):
        keys, items = part(column.keys), part(column.items)
        return [dict(zip(keys[a:b], items[a:b], strict=True)) for a, b in runs]
    values = part(column.values)
    return [values[a:b] for a, b in runs]


def _dicts(batch: pa.RecordBatch) -> Iterator[dict]:
    names = batch.schema.names
    return (dict(zip(names, row, strict=True)) for row in zip(*map(_values, batch.columns), strict=True))


def _amounts_folded(rows: DataFrame, schema: StructType, run: Callable[[list[dict]], list[dict]]) -> DataFrame:
    """What `run` makes of the rows of each direction and amount, in order; a row without a time, amount or direction is given
    alone. One shuffle of the rows, ordered by amount, of which one amount at a time is held."""
    arrow = to_arrow_schema(schema)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, group, key = [], [], None
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                for row in _dicts(batch.slice(at, ROWS_AT_ONCE)):
                    own = (row["direction"], row["cents"])
                    if group and (own != key or None in own or row["ts"] is None or group[-1]["ts"] is None):
                        out += run(_ordered(group))
                        group = []
                    key = own
                    group.append(row)
                if len(out) >= ROWS_AT_ONCE:
                    yield pa.RecordBatch.from_pylist(out, arrow)
                    out = []
        yield pa.RecordBatch.from_pylist(out + (run(_ordered(group)) if group else []), arrow)

    # Rows that lack one are no group: they are dealt out by their ids, and stand behind those of their amount.
    place = [*_AMOUNT, F.when(~F.expr(_WHOLE), F.col("id"))]
    return formed(rows.repartition(*place).sortWithinPartitions(*place)).mapInArrow(each, schema)


def _ordered(rows: list[dict]) -> list[dict]:
    """Old ones in order of time, then new ones as they arrived."""
    return sorted(rows, key=lambda r: (r["_seq"] >= 0, r["_seq"], r["ts"], r["id"])) if len(rows) > 1 else rows


def _links(rows: list[dict]) -> list[dict]:
    if len(rows) == 1:  # a record of its own, with or without a time
        return [{"id": rows[0]["id"], "root": rows[0]["id"], "tier": None}]
    return [{"id": i, "root": root, "tier": tier} for i, root, tier in fold(rows)[0]]


def _records(rows: list[dict]) -> list[dict]:
    if len(rows) > 1:
        links, steps = fold(rows)
        own = {i for i, root, _ in links if i == root}
        rows = ({r["id"]: r for r in rows if r["id"] in own} | {state["id"]: state for _, state in steps}).values()
    return [r | {"refs": list(r["refs"].items())} for r in rows]


def imported(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links, records) of an import of `new` (with `arrived`, their order) into `old`; ids are distinct over both.

    links: (id, root, tier) for every row of both; root is the record that a row has become part of, tier how it was found.
    records: every record as it is after the import. Null texts match nothing; a row without a time or amount is a record
    of its own; columns of MORE that a table lacks are null; empty tables are fine. Nothing is written but for amounts of
    more than AT_MOST rows: links and records are each worked out when they are read, from tables that are read again.
    """
    every = prepared(old, new)
    number, record = every.schema["id"].dataType, [f for f in formed(every).schema.fields if not f.name.startswith("_")]
    linking, keeping = StructType().add("id", number).add("root", number).add("tier", "integer"), StructType([StructField(f.name, f.dataType) for f in record])
    many = cut(every.filter(_WHOLE).groupBy(*_AMOUNT).count().filter(F.col("count") > AT_MOST).select(*_AMOUNT))
    if many.isEmpty():
        return _amounts_folded(every, linking, _links), _amounts_folded(every, keeping, _records)
    few = every.join(many, _AMOUNT, "left_anti")
    links, records = _linked_first(cut(formed(every.join(many, _AMOUNT, "left_semi"))))
    return _amounts_folded(few, linking, _links).unionByName(links), _amounts_folded(few, keeping, _records).unionByName(records)


def _linked_first(whole: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same of rows with a time, amount and direction, of which very many may share these. A component is folded in one
    task: it holds rows that are chained by possible matches, each of which is close to the next in time or has a key in
    common with it."""
    edges = cut(_reaches(whole, whole, keys=True).distinct())
    while True:
        group = components(edges)
        told = cut(_folded(whole, group))
        # Only states that a record has come to count here: what it was at first is in the links already.
        later = _reaches(told.filter("_part = 1"), whole, keys=False).distinct()
        of = lambda c: group.select(F.col("v").alias(c), F.col("root").alias(f"_{c}"))
        later = later.join(of("a"), "a").join(of("b"), "b", "left").filter(~F.col("_a").eqNullSafe(F.col("_b"))).select("a", "b")
        later = cut(later)
        if later.isEmpty():
            break
        edges = cut(edges.unionByName(later))
    met = told.filter("_part = 0").select("id", "root", "tier")
    alone = whole.select("id").join(met, "id", "left_anti").select("id", F.col("id").alias("root"), F.lit(None).cast("int").alias("tier"))
    columns = [c for c in whole.columns if not c.startswith("_")]
    last = told.filter("_part = 1").groupBy("id").agg(F.max_by(F.struct(*columns[1:]), "_seq").alias("_s")).select("id", "_s.*")
    gone = met.filter("root <> id").select("id").unionByName(last.select("id"))
    records = whole.select(*columns).join(gone, "id", "left_anti").unionByName(last.select(*columns))
    return met.unionByName(alone), records


def linked(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, root, tier) for every record of both, after the import."""
    return imported(old, new)[0]


def folded(rows: DataFrame) -> DataFrame:
    """Records with a root (and id, ts, cents, direction, kind, payee, channel, paid_from, card, category, refs, sources) as one for
    each root, which takes the others in one after the other by their ids."""
    have = set(rows.columns)
    more = rows.withColumns({c: F.lit(None).cast(kind) for c, kind in MORE.items() if c not in have})
    names = ["id", "ts", "cents", "direction", "kind", "payee", "channel", "paid_from", "card", "category", "refs", "sources"]
    schema = StructType([*more.select(*names).schema.fields, *StructType.fromDDL("records bigint").fields])
    for f in schema.fields:
        f.nullable = True

    def run(key, rows):
        todo = [r | {"refs": {k: v for k, v in r["refs"] or () if v is not None}, "sources": r["sources"] or [], **dict.fromkeys(("_at", "_day", "_key", "_words", "_noted"))} for r in rows]
        todo.sort(key=lambda r: (r["id"] != r["root"], r["id"]))
        state = todo[0]
        for row in todo[1:]:
            state = absorbed(state, row)
        return [{c: state[c] for c in names} | {"id": key, "refs": list(state["refs"].items()), "records": len(todo)}]

    return _by_group(more.select("root", *dict.fromkeys([*names, *MORE])), "root", run, schema)
