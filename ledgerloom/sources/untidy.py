"""Folders of files that differ in everything: separator, encoding, where the header stands, how deep the list is.

Each file is read whole in one task, as text of its own encoding, and from there on is rows: what is found out about a file (its
separator, its header, its list) comes from aggregates over its own lines or nodes and is joined back to them, so one
folder may hold every dialect and nothing is collected. Files that are not understood are told, not skipped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import read_date
from ..functions.money import signed_cents
from .files import HEADER_WORDS, decoded

SEPARATORS = [",", ";", "\t", "|"]
#: Lines in which a separator and a header are looked for, and levels of a JSON file below its top.
HEAD_LINES, DEPTH = 60, 6
#: Larger files are told as too large.
MOST_BYTES = 64 << 20


def _texts(spark: SparkSession, path: str) -> DataFrame:
    """(file, text, large) of the files of a path."""
    found = spark.read.format("binaryFile").load(path)
    large = F.col("length") > MOST_BYTES
    return found.select(F.col("path").alias("file"), F.when(~large, decoded(F.col("content"))).alias("text"), large.alias("large"))


def split_line(text: Column, sep: str) -> Column:
    """The cells of a line; quotes around a cell go, doubled ones inside become one."""
    s = "\\" + sep if sep in "|" else sep
    cells = F.regexp_extract_all(F.concat(F.lit(sep), text), F.lit(f'{s}("(?:[^"]|"")*"|[^{s}]*)'), F.lit(1))
    return F.transform(cells, lambda c: F.trim(F.when(c.rlike('^".*"$'), F.replace(F.substr(c, F.lit(2), F.greatest(F.length(c) - 2, F.lit(0))), F.lit('""'), F.lit('"'))).otherwise(c)))


def table_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, cells, large) of every line with text of every file, cut at the file's own separator: the one on which most
    of its first lines agree, that is, that they have in the same number; of several the one that they have most of."""
    lines = _texts(spark, path).select("file", "large", F.posexplode_outer(F.split("text", "\r\n|\n|\r")).alias("line", "text")).filter("large OR trim(text) <> ''")
    bare = F.regexp_replace("text", '"[^"]*"', "")
    tried = lines.filter(F.col("line") < HEAD_LINES).select("file", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), (F.length(bare) - F.length(F.replace(bare, F.lit(s), F.lit("")))).alias("n")) for i, s in enumerate(SEPARATORS)])).alias("_s")).select("file", "_s.*").filter("n > 0")
    agreed = tried.groupBy("file", "i", "n").agg(F.count(F.lit(1)).alias("k")).groupBy("file").agg(F.max_by("i", F.struct("k", "n", -F.col("i"))).alias("_sep"))
    each = lines.join(agreed, "file", "left")
    cells = F.array(F.trim("text"))
    for i, s in enumerate(SEPARATORS):
        cells = F.when(F.col("_sep") == i, split_line(F.col("text"), s)).otherwise(cells)
    return each.select("file", F.col("line").cast("int").alias("line"), cells.alias("cells"), "large")


def meanings(cells: Column) -> Column:
    """{what a column holds: its place} for the cells of a header, as meaning() of files finds them: a word at a time, each column
    once."""
    words = F.array(*[F.struct(F.lit(what).alias("what"), F.array(*[F.lit(w) for w in of]).alias("words")) for what, of in HEADER_WORDS.items()])
    low = F.transform(cells, lambda c: F.lower(F.trim(c)))
    numbered = F.transform(low, lambda c, i: F.struct(c.alias("c"), i.alias("i")))

    def take(found: Column, x: Column) -> Column:
        free = F.filter(numbered, lambda c: ~F.array_contains(F.map_values(found), c["i"]))
        hits = F.transform(x["words"], lambda w: F.get(F.filter(free, lambda c: c["c"].contains(w)), F.lit(0))["i"])
        first = F.get(F.filter(hits, lambda h: h.isNotNull()), F.lit(0))
        return F.when(first.isNull(), found).otherwise(F.map_concat(found, F.create_map(x["what"], first)))

    return F.aggregate(words, F.create_map().cast("map<string,int>"), take)


def card_exports(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, files) of a folder of exported tables of any dialect.

    rows: (file, line, day, details, cents, credit), as card_rows() gives them. files: (file, state, header, rows): `read`, `no
    header` (none of the first lines names a date, details and an amount, so it is no card's export), `too large`; and the
    header's line. Files of white space have no header, those of no bytes Spark does not show; a header without rows below
    is read, with none.
    """
    lines = table_lines(spark, path)
    found = meanings(F.col("cells"))
    heads = lines.filter((F.col("line") < HEAD_LINES) & ~F.col("large")).select("file", "line", found.alias("_m"))
    whole = F.map_contains_key("_m", "date") & F.map_contains_key("_m", "details") & (F.map_contains_key("_m", "amount") | F.map_contains_key("_m", "debit") | F.map_contains_key("_m", "credit"))
    header = heads.filter(whole & (F.size("_m") >= 3)).groupBy("file").agg(F.min_by(F.struct(F.col("line").alias("header"), "_m"), "line").alias("_h")).select("file", "_h.*")
    body = lines.join(header, "file").filter("line > header")
    cell = lambda what: F.get("cells", F.col("_m")[what])
    both, out, back = signed_cents(cell("amount")), F.abs(signed_cents(cell("debit"))), F.abs(signed_cents(cell("credit")))
    cents = F.coalesce(F.when(out > 0, out), F.when(back > 0, back), F.abs(both))
    credit = F.coalesce(F.when(out > 0, F.lit(False)), F.when(back > 0, F.lit(True)), F.lower(cell("type")).startswith("c"), both < 0)
    rows = body.select("file", "line", read_date(cell("date")).alias("day"), F.trim(cell("details")).alias("details"), cents.alias("cents"), credit.alias("credit")).filter("day is not null and cents is not null")
    every = _texts(spark, path).select("file", "large").join(header.select("file", "header"), "file", "left").join(rows.groupBy("file").agg(F.count(F.lit(1)).alias("rows")), "file", "left")
    state = F.when(F.col("large"), "too large").when(F.col("header").isNull(), "no header").otherwise("read")
    return rows, every.select("file", state.alias("state"), "header", F.coalesce("rows", F.lit(0)).alias("rows"))


def json_objects(spark: SparkSession, path: str, synonyms: dict[str, list[str]], guard: str = ")]}'") -> DataFrame:
    """(file, item, a column for each of synonyms) of the first list of objects in each JSON file, at whatever depth it lies: the one
    nearest to the top, of several there the first. A file may begin with a guard, hold one object a line, or be one
    object without any list, which is then its only item; names are held in any case. What is no JSON gives nothing.
    """
    text = _texts(spark, path).filter("text is not null").select("file", F.trim(F.regexp_replace("text", r"^\s*" + "".join("\\" + c for c in guard), "")).alias("text"))
    # One object a line, where the first line is one and others follow: read as a whole, such a file would end after it.
    lines = F.split("text", "\r?\n")
    by_line = (F.size(lines) > 1) & F.coalesce(F.schema_of_variant(F.try_parse_json(F.get(lines, F.lit(0)))).startswith("OBJECT"), F.lit(False))
    whole = text.select("file", F.when(~by_line, F.try_parse_json("text")).alias("v"), by_line.alias("_lines"), "text")
    lined = whole.filter("_lines").select("file", F.posexplode(F.split("text", "\r?\n")).alias("item", "_t")).select("file", "item", F.try_parse_json("_t").alias("v")).filter("v is not null")
    level = whole.filter("v is not null").select("file", F.lit("").alias("place"), "v")
    is_list = F.schema_of_variant("v").rlike("^ARRAY<OBJECT")
    lists, top = None, level
    for depth in range(DEPTH + 1):
        here = level.filter(is_list).select("file", F.lit(depth).alias("depth"), "place", "v")
        lists = here if lists is None else lists.unionByName(here)
        if depth < DEPTH:
            deeper = level.filter(F.schema_of_variant("v").rlike("^(?:ARRAY|OBJECT)") & ~is_list)
            level = deeper.lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).select("file", F.concat("place", F.lpad(F.col("pos").cast("string"), 9, "0")).alias("place"), F.col("value").alias("v"))
    best = lists.groupBy("file").agg(F.min(F.struct("depth", "place")).alias("_b"))
    chosen = lists.join(best, "file").filter((F.col("depth") == F.col("_b.depth")) & (F.col("place") == F.col("_b.place"))).select("file", "v")
    items = chosen.lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).select("file", F.col("pos").alias("item"), F.col("value").alias("v"))
    alone = top.filter(F.schema_of_variant("v").startswith("OBJECT")).join(best, "file", "left_anti").select("file", F.lit(0).alias("item"), "v")
    items = items.unionByName(alone).unionByName(lined.select("file", "item", "v"))
    fields = items.filter(F.schema_of_variant("v").startswith("OBJECT")).lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).select("file", "item", F.lower("key").alias("_key"), F.try_variant_get("value", "$", "string").alias("_value"))
    named = F.array(*[F.struct(F.lit(field).alias("field"), F.lit(i).alias("i"), F.lit(n.lower()).alias("name")) for field, names in synonyms.items() for i, n in enumerate(names)])
    hits = fields.withColumn("_n", F.explode(F.filter(named, lambda n: n["name"] == F.col("_key"))))
    cells = [F.min_by("_value", F.when((F.col("_n.field") == field) & F.col("_value").isNotNull(), F.col("_n.i"))).alias(field) for field in synonyms]
    return hits.groupBy("file", "item").agg(*cells)
