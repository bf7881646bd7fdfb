"""Text that is broken over lines: details and amounts of rows, undated rows, labels of figures, headers of tables.

Lines keep their places (file, line, text; a place is a number of characters), and those of a file are ordered by windows. A
row's lines are an island: the dated line and what follows until the next. What each line is follows from itself and the
island's first; where an island ends early is a running maximum over it. Cells (parts of a line with two spaces between)
meet cells of the next line by an equality join on its number and the overlap of their places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import read_date
from ..functions.money import signed_cents
from .components import cut
from .lines import BACK, COLUMNS, DATE, FIGURES, MONEY, TERMS, TIME

#: Edges so near line up (in characters).
GIVE = 1
#: Lines that may follow a row's first, and those of them that add to its details.
MORE_LINES, MORE_DETAILS = 3, 2
#: Words of a label's cell, at most, and of what may stand under it as its next line.
LABEL_WORDS = 4
_SECTION = "(?i)^(?:" + "|".join([TERMS, BACK, "debits?$", "credits?$", *FIGURES.values()]) + ")"


def _placed(text: Column, pattern: str) -> Column:
    """Structs of x0, x1 (behind the last character) and text of all finds of a pattern that looks at nothing before a find: each stands
    where its text is first met behind the find before it, so the pattern is tried once."""
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))

    def add(out: Column, t: Column) -> Column:
        x0 = F.call_function("locate", t, text, F.coalesce(F.try_element_at(out, F.lit(-1))["x1"], F.lit(0)) + 1) - 1
        return F.array_append(out, F.struct(x0.alias("x0"), (x0 + F.length(t)).alias("x1"), t.alias("text")))

    return F.aggregate(found, F.array().cast("array<struct<x0:int,x1:int,text:string>>"), lambda out, t: add(out, t).cast("array<struct<x0:int,x1:int,text:string>>"))


def _amounts(text: str) -> Column:
    """The amounts of a line, as _placed() gives them; a line without a point has none."""
    return F.when(F.col(text).contains("."), _placed(F.col(text), MONEY)).otherwise(F.array().cast("array<struct<x0:int,x1:int,text:string>>"))


def rows_wrapped(lines: DataFrame) -> DataFrame:
    """(file, line, table, day, clock, details, amounts), as placed() of columns has them, of dated lines with what follows them.

    Up to three lines that follow a dated one belong to it, until one that is blank, begins a part of the statement or stands
    left of the details: a clock alone is its time; amounts that do not stand under its own are more of its amounts, and
    words before them and text at its details' place more of its details, two lines of these at most. A line without a date
    whose amount ends under one of the row's is a row of the same day, and the last of them. Rows without any amount go.
    A header line begins a table.
    """
    line = Window.partitionBy("file").orderBy("line")
    low = F.lower("text")
    head = low.rlike(r"^\s*date\b") & low.rlike("amount|debit|credit|withdrawal|deposit|balance")
    # What a pattern needs is looked for first: most lines have no date, and many no amount.
    numbered = F.substr(F.ltrim("text", F.lit(" \t\n\x0b\f\r")), F.lit(1), F.lit(1)).between("0", "9")
    date = F.when(numbered, F.regexp_extract("text", rf"^(\s*(?:{DATE}))(?![0-9])", 1)).otherwise("")
    day = read_date(F.trim("_date"))
    rest = F.when(day.isNotNull(), F.expr("substr(text, length(_date) + 1)")).otherwise(F.col("text"))
    # Lines are ordered as they are and read behind that: what is shuffled is no wider than they are, and every file's task reads its own.
    ordered = lines.select("file", "line", "text").repartition("file").sortWithinPartitions("file", "line")
    each = ordered.withColumns({"_date": date, "_head": head.cast("int")}).withColumns({"day": day}).withColumn("_rest", rest)
    words = F.trim(F.regexp_replace(F.when(F.col("_rest").contains("."), F.regexp_replace("_rest", MONEY, " ")).otherwise(F.col("_rest")), r"\s+", " "))
    each = each.withColumns({"money": _amounts("text"), "_words": words, "_starts": F.col("day").isNotNull().cast("int")})
    each = each.withColumn("_x", F.length("text") - F.length(F.ltrim("_rest")))
    each = each.withColumns({"table": F.sum("_head").over(line), "_row": F.sum("_starts").over(line)}).filter("_row > 0")
    island = Window.partitionBy("file", "_row").orderBy("line")
    # Where a row's details begin; for one that has none on its first line, where those of its table usually do.
    own = F.when((F.col("_starts") == 1) & (F.col("_words") != ""), F.col("_x"))
    usual = F.percentile_approx(own, 0.5, 10_000).over(Window.partitionBy("file", "table"))
    first = lambda c: F.first(c).over(island)
    each = each.withColumns({"_k": F.row_number().over(island) - 1, "_at": F.coalesce(first(own), usual), "_money": first("money")})
    has = F.size("money") > 0
    under = F.exists("money", lambda t: F.exists("_money", lambda m: F.abs(t["x1"] - m["x1"]) <= GIVE))
    kind = (
        F.when(F.col("_k") == 0, "row").when((F.trim("text") == "") | F.trim("text").rlike(_SECTION) | (F.col("_head") == 1), "end").when(F.col("text").contains(":") & F.trim("text").rlike(f"^{TIME}$"), "clock")
        .when(has & under, "undated").when(has, "amounts").when(F.col("_x") >= F.col("_at") - GIVE, "details").otherwise("end")
    )
    each = each.select("file", "line", "table", "_row", "_k", "day", "text", "money", "_words", F.inline(F.array(F.struct(kind.alias("_kind")))))
    adds = (F.col("_kind").isin("amounts", "details") & (F.col("_words") != "")).cast("int")
    before = island.rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.coalesce(F.sum(adds).over(before), F.lit(0))
    ends = (F.col("_kind") == "end") | ((F.col("_kind") == "details") & (earlier >= MORE_DETAILS)) | (F.col("_k") > MORE_LINES)
    each = each.withColumns({"_ends": ends.cast("int"), "_earlier": earlier})
    over = F.max("_ends").over(island) + F.coalesce(F.max((F.col("_kind") == "undated").cast("int")).over(before), F.lit(0))
    each = each.withColumn("_over", over).filter("_over = 0")
    each = each.withColumn("_says", F.when((F.col("_kind") != "amounts") | (F.col("_earlier") < MORE_DETAILS), F.nullif("_words", F.lit(""))))
    part = F.struct("_k", "line", "_kind", "money", "_says", F.when(F.col("_kind") == "clock", F.regexp_replace(F.trim("text"), r"\s+", " ")).alias("text"))
    rows = each.groupBy("file", "_row").agg(F.min("table").alias("table"), F.max("day").alias("day"), F.array_sort(F.collect_list(part)).alias("_p"))
    own_lines = F.filter("_p", lambda p: ~p["_kind"].isin("undated", "clock"))
    whole = F.struct(
        F.get("_p", F.lit(0))["line"].alias("line"), F.get(F.filter("_p", lambda p: p["_kind"] == "clock"), F.lit(0))["text"].alias("clock"),
        F.array_join(F.transform(own_lines, lambda p: p["_says"]), " ").alias("details"), F.flatten(F.transform(own_lines, lambda p: p["money"])).alias("amounts"),
    )
    undated = F.transform(F.filter("_p", lambda p: p["_kind"] == "undated"), lambda p: F.struct(p["line"].alias("line"), F.lit(None).cast("string").alias("clock"), F.coalesce(p["_says"], F.lit("")).alias("details"), p["money"].alias("amounts")))
    out = rows.select("file", "table", "day", F.explode(F.concat(F.array(whole), undated)).alias("_r")).select("file", "_r.line", "table", "day", "_r.clock", "_r.details", "_r.amounts")
    return out.filter(F.size("amounts") > 0)


def celled(lines: DataFrame) -> DataFrame:
    """(file, line, cells, digits): the cells of each line that has any, from the left, as structs of x0, x1 and text, and whether there is
    a digit among them. A cell is a part of a line between two spaces or more; lines are numbered anew from 1, without gaps."""
    number = F.row_number().over(Window.partitionBy("file").orderBy("line"))
    each = lines.select("file", number.alias("line"), "text").filter(F.trim("text") != "")
    return each.select("file", "line", _placed(F.col("text"), r"[^ ]+(?: [^ ]+)*").alias("cells"), F.col("text").rlike("[0-9]").alias("digits"))


def cells(lines: DataFrame) -> DataFrame:
    """(file, line, x0, x1, text): the cells of celled(), a row each."""
    return celled(lines).select("file", "line", F.inline("cells"))


def _under(upper: DataFrame, parts: DataFrame, depth: Column | int = 1, reach: int = 2) -> DataFrame:
    """Cells of `upper` (with _end, the line they end on) beside those of the line below that overlap them."""
    low = parts.select("file", F.col("line").alias("_line"), F.col("x0").alias("_x0"), F.col("x1").alias("_x1"), F.col("text").alias("_text"))
    each = upper.withColumn("_line", F.col("_end") + depth)
    return each.join(low, ["file", "_line"]).filter((F.col("_x0") < F.col("x1") + reach) & (F.col("_x1") > F.col("x0") - reach))


def figures_wrapped(lines: DataFrame) -> DataFrame:
    """(file, a column for each of FIGURES): figures whose label is broken over two or three lines of a row of labels, as a summary
    box prints them; the figure is the money under the label, up to three lines further down.

    A row of labels has several cells of at most four words; what stands under one of them, of up to three words without
    digits, is more of it. A label that is whole on one line is no matter of this, nor is prose.
    """
    return labels_wrapped(lines, cut(celled(lines)))


def labels_wrapped(lines: DataFrame, each: DataFrame) -> DataFrame:
    """figures_wrapped() of lines whose celled() are at hand."""
    parts = each.select("file", "line", F.inline("cells"))
    short = F.forall("cells", lambda c: F.size(F.split(c["text"], " ")) <= LABEL_WORDS)
    box = each.filter((F.size("cells") >= 2) & short).select("file", "line", F.inline("cells"))
    label = box.select("file", "x0", "x1", "text", F.col("line").alias("_end"), F.lit(0).alias("_deep"))
    grown = None
    for _ in range(2):
        below = _under(label, parts.filter(~F.col("text").rlike("[0-9]") & (F.size(F.split("text", " ")) <= LABEL_WORDS - 1)))
        key = ["file", "_end", "x0", "x1", "text", "_deep"]
        joined = below.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("_x0", "_x1", "_text"))).alias("_u"))
        label = cut(joined.select("file", F.least("x0", F.array_min(F.transform("_u", lambda u: u["_x0"]))).alias("x0"), F.greatest("x1", F.array_max(F.transform("_u", lambda u: u["_x1"]))).alias("x1"), F.concat_ws(" ", "text", F.array_join(F.transform("_u", lambda u: u["_text"]), " ")).alias("text"), (F.col("_end") + 1).alias("_end"), (F.col("_deep") + 1).alias("_deep")))
        grown = label if grown is None else grown.unionByName(label)
    names = F.array(*[F.struct(F.lit(name).alias("name"), F.lower("text").rlike(f"^(?:{words})$").alias("is")) for name, words in FIGURES.items()])
    named = grown.select("*", F.explode(F.filter(names, lambda n: n["is"])).alias("_n")).select("file", "x0", "x1", "_end", F.col("_n.name").alias("name"))
    named = named.withColumn("_down", F.explode(F.array(*[F.lit(k) for k in (1, 2, 3)])))
    found = _under(named, parts.filter(F.col("text").rlike(f"^{MONEY}$")), F.col("_down"), reach=4).withColumn("_cents", signed_cents("_text"))
    best = found.groupBy("file", "name").agg(F.min_by("_cents", F.struct("_end", "_down", F.abs(F.col("_x1") - F.col("x1")))).alias("cents"))
    return lines.select("file").distinct().join(best.groupBy("file").pivot("name", list(FIGURES)).agg(F.first("cents")), "file", "left")


def headed(lines: DataFrame) -> DataFrame:
    """(file, line, header, day, details, debit, credit, amount, balance): rows under headers, each cell under the header's cell whose
    place it shares, so that columns may be blank; headers may be broken over two lines.

    A header names a date and two other columns at least and has no digits; where one line does not, the cells of the next
    line that stand under it complete it. Amounts are right under their header's, or end nearest to its end. Lines are
    numbered anew from 1.
    """
    return rows_below(cut(celled(lines)))


def rows_below(each: DataFrame) -> DataFrame:
    """headed() of lines whose celled() are at hand."""

    def what(text: Column) -> Column:
        out = F.lit(None).cast("string")
        for name, words in reversed(COLUMNS):
            out = F.when(F.lower(text).rlike(rf"\b(?:{words})"), F.lit(name)).otherwise(out)
        return out

    plain = each.filter("not digits").select("file", "line", F.inline("cells"))
    one = plain.select("file", F.col("line").alias("_from"), F.col("line").alias("_end"), "x0", "x1", "text")
    low = plain.select("file", F.col("line").alias("_line"), F.col("x0").alias("_x0"), F.col("x1").alias("_x1"), F.col("text").alias("_text"))
    both = one.join(low.select("file", "_line").distinct(), (one["file"] == low["file"]) & (one["_end"] + 1 == low["_line"]), "left_semi")
    both = both.withColumn("_line", F.col("_end") + 1).join(low, ["file", "_line"], "left").withColumn("_t", F.when((F.col("_x0") < F.col("x1") + 1) & (F.col("_x1") > F.col("x0") - 1), F.struct("_x0", "_x1", "_text")))
    two = both.groupBy("file", "_from", "_end", "x0", "x1", "text").agg(F.array_sort(F.collect_list("_t")).alias("_u"))
    two = two.select("file", "_from", (F.col("_end") + 1).alias("_end"), F.least("x0", F.array_min(F.transform("_u", lambda u: u["_x0"]))).alias("x0"), F.greatest("x1", F.array_max(F.transform("_u", lambda u: u["_x1"]))).alias("x1"), F.concat_ws(" ", "text", F.array_join(F.transform("_u", lambda u: u["_text"]), " ")).alias("text"))
    head = one.unionByName(two).withColumn("name", what(F.col("text"))).filter("name is not null")
    whole = head.groupBy("file", "_from", "_end").agg(F.max((F.col("name") == "date").cast("int")).alias("_date"), F.count_distinct("name").alias("_n"), F.array_sort(F.collect_list(F.struct("x0", "x1", "name"))).alias("_cols"))
    # One line goes before two; a header's second line is no header of its own.
    whole = cut(whole.filter("_date = 1 and _n >= 3").withColumn("_k", F.row_number().over(Window.partitionBy("file", "_from").orderBy("_end"))).filter("_k = 1"))
    # Headers have no digits and rows do, so they are stacked and not joined; of two headers that end on a line the longer counts.
    kind = whole.schema["_cols"].dataType
    rows = each.filter("digits").select("file", "line", F.col("cells").alias("_cells"), F.lit(None).cast("int").alias("_from"), F.lit(None).cast(kind).alias("_cols"))
    marks = rows.unionByName(whole.select("file", F.col("_end").alias("line"), F.lit(None).cast(each.schema["cells"].dataType).alias("_cells"), "_from", "_cols"))
    above = Window.partitionBy("file").orderBy("line", F.col("_from").desc()).rowsBetween(Window.unboundedPreceding, -1)
    rows = marks.withColumns({"header": F.last("_from", ignorenulls=True).over(above), "_above": F.last("_cols", ignorenulls=True).over(above)}).filter("_above is not null and _cols is null")

    # A line with a cell for each of the header's has them in its order; of any other a cell is under the header's cell that it shares most with.
    near = lambda c, h: F.greatest(c["x0"], h["x0"]) - F.least(c["x1"], h["x1"])
    best = lambda c: F.array_min(F.transform("_above", lambda h: F.struct(near(c, h).alias("d"), F.abs(c["x1"] - h["x1"]).alias("e"), h["name"].alias("name"))))["name"]
    names = F.when(F.size("_cells") == F.size("_above"), F.transform("_above", lambda h: h["name"])).otherwise(F.transform("_cells", best))
    rows = rows.select("file", "line", "header", "_cells", F.inline(F.array(F.struct(names.alias("_names")))))
    cell = lambda name: F.get("_cells", (F.array_position("_names", name) - 1).cast("int"))["text"]
    # Read as one array of a struct, so that a filter looks at what was read and does not read it again; days first.
    dated = rows.select("file", "line", "header", "_cells", "_names", F.inline(F.array(F.struct(read_date(cell("date")).alias("day"))))).filter("day is not null")
    read = F.struct(cell("details").alias("details"), *[signed_cents(cell(c)).alias(c) for c in ("debit", "credit", "amount", "balance")])
    out = dated.select("file", "line", "header", "day", F.inline(F.array(read)))
    return out.filter("coalesce(debit, credit, amount) is not null")
