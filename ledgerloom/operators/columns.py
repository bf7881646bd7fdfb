"""Amounts of a statement by the columns they stand in: where edges line up, which columns a row uses together, and the readings
that follow, as candidates of one proof beside the rows under a header.

Lines keep their places (file, line, text; a place is a number of characters). Edges are clustered file by file with one
window over a file's amounts; tables of a file that are printed a little to one side are moved into line; columns that share
no table are one. A layout says which columns are meant how; a file has a few columns, so a few layouts, and every row is
read once under each. Only arrays of a file's columns are ever gathered, never its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import read_date
from ..functions.money import signed_cents
from .components import cut
from .lines import DATE, FIGURES, MONEY, figures, outside_terms
from .proof import TABLE, decide
from .wrapped import GIVE, _placed, celled, labels_wrapped, rows_below, rows_wrapped

#: A table may be printed so far to one side of another (in characters).
SHIFT = 4
#: Rows that use two columns, of those that use either, from which these are an amount and its balance.
BESIDE = 0.6


def placed(lines: DataFrame) -> DataFrame:
    """(file, line, table, day, details, amounts): rows by shape, as in rows_by_shape(), with the places of their amounts: structs of
    x0, x1 (behind the last character) and text, from the left. A header line begins a table; so does a new value of a
    column `page`, if there is one."""
    amounts = _placed(F.col("text"), MONEY)
    low = F.lower("text")
    head = low.rlike(r"^\s*date\b") & low.rlike("amount|debit|credit|withdrawal|deposit|balance")
    by_page = F.col("page") if "page" in lines.columns else F.lit(1)
    line = Window.partitionBy("file").orderBy("line")
    new = head | F.coalesce(by_page != F.lag(by_page).over(line), F.lit(False)) if "page" in lines.columns else head
    rows = lines.withColumn("_new", new.cast("int")).withColumn("table", F.sum("_new").over(line))
    day = read_date(F.regexp_extract("text", rf"^\s*({DATE})\b", 1))
    rest = F.regexp_replace(F.regexp_replace("text", rf"^\s*(?:{DATE})\b", ""), MONEY, " ")
    rows = rows.select("file", "line", "table", day.alias("day"), F.trim(F.regexp_replace(rest, r"\s+", " ")).alias("details"), amounts.alias("amounts"))
    return rows.filter(F.col("day").isNotNull() & (F.size("amounts") > 0))


def _clusters(spots: DataFrame, keys: list[str], x: str) -> DataFrame:
    """(keys, edge, n): values (each `n` times) that follow each other at most GIVE apart, the middle of each group and its size."""
    line = Window.partitionBy(*keys).orderBy(x)
    each = spots.withColumn("_k", (F.coalesce(F.col(x) - F.lag(x).over(line), F.lit(0)) > GIVE).cast("int"))
    each = each.withColumn("_k", F.sum("_k").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    return each.groupBy(*keys, "_k").agg((F.sum(F.col(x) * F.col("n")) / F.sum("n")).alias("edge"), F.sum("n").alias("n")).drop("_k")


def _edges(rows: DataFrame) -> DataFrame:
    """(file, table, side, x, n): where the left (x0) and right (x1) edges of amounts stand, and how many do there."""
    each = rows.select("file", "table", F.explode("amounts").alias("_a"))
    sides = F.array(F.struct(F.lit("x0").alias("side"), F.col("_a.x0").alias("x")), F.struct(F.lit("x1").alias("side"), F.col("_a.x1").alias("x")))
    return each.select("file", "table", F.inline(sides)).groupBy("file", "table", "side", "x").agg(F.count(F.lit(1)).alias("n"))


def shifts(edges: DataFrame) -> DataFrame:
    """(file, table, side, shift): how far the amounts of a table must move to stand in the columns of the file's largest one; 0 for
    that, and where no move brings more of them into line than none does."""
    sizes = edges.groupBy("file", "side", "table").agg(F.sum("n").alias("_n"))
    main = sizes.groupBy("file", "side").agg(F.max_by(F.struct("table", "_n"), F.struct("_n", (-F.col("table")).alias("t"))).alias("_m")).select("file", "side", F.col("_m.table").alias("_main"), F.col("_m._n").alias("_all"))
    inside = edges.join(main, ["file", "side"]).filter("table = _main")
    usual = _clusters(inside, ["file", "side", "_all"], "x").filter(F.col("n") >= F.greatest(F.lit(2.0), 0.2 * F.col("_all"))).groupBy("file", "side").agg(F.collect_list("edge").alias("_usual"))
    moved = edges.join(main, ["file", "side"]).filter("table <> _main").join(usual, ["file", "side"]).withColumn("shift", F.explode(F.sequence(F.lit(-SHIFT), F.lit(SHIFT))))
    fit = lambda give: F.sum(F.exists("_usual", lambda e: F.abs(F.col("x") + F.col("shift") - e) <= give).cast("int") * F.col("n"))
    moved = moved.groupBy("file", "table", "side", "shift").agg(fit(GIVE).alias("_fit"), fit(0.5).alias("_exact"))
    best = moved.groupBy("file", "table", "side").agg(F.max_by("shift", F.struct("_fit", (F.col("shift") == 0).alias("_stays"), "_exact", (-F.abs("shift")).alias("_a"), "shift")).alias("shift"))
    return sizes.select("file", "table", "side").join(best, ["file", "table", "side"], "left").select("file", "table", "side", F.coalesce("shift", F.lit(0)).alias("shift"))


def columns(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(columns, cells) of the rows of placed().

    columns: (file, column, edge, side, rows, tables), from the left: where at least two amounts line up (one, in a file of
    three rows or fewer), on the side on which they do so in the fewest and fullest columns. An amount that ends a row with
    none in any column makes one as well. Neighbours at most SHIFT apart that share no table are one column.
    cells: (file, table, line, place, column) of every amount that stands in one.
    """
    out, each = _in_columns(rows)
    return out, each.select("file", "table", "line", F.inline("_cells"))


def _in_columns(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The columns of columns(), and the rows with `_cells`: structs of place and column of their amounts that stand in one.

    Edges are counted before anything is ordered, and a row meets what its file has (moves, edges, columns) as arrays.
    """
    # Small tables that several steps read are written once: a plan that holds them all would be very large.
    edges = cut(_edges(rows))
    moves = cut(shifts(edges))
    edges = edges.join(moves, ["file", "table", "side"]).groupBy("file", "side", (F.col("x") + F.col("shift")).alias("x")).agg(F.sum("n").alias("n"))
    need = F.when(F.col("_rows") > 3, 2).otherwise(1)
    counted = rows.groupBy("file").agg(F.count(F.lit(1)).alias("_rows"))
    sides = _clusters(edges, ["file", "side"], "x").groupBy("file", "side").agg(F.collect_list(F.struct("edge", "n")).alias("_found"))
    sides = counted.join(sides, "file", "left").withColumn("_found", F.filter("_found", lambda c: c["n"] >= need))
    full = F.aggregate("_found", F.lit(0).cast("bigint"), lambda s, c: s + c["n"] * c["n"])
    some = F.size("_found") > 0
    best = F.max_by(F.struct("side", "_found"), F.when(some, F.struct(full.alias("_s"), F.col("side").alias("_x"))))
    about = sides.groupBy("file").agg(best.alias("_b")).select("file", F.coalesce("_b.side", F.lit("x1")).alias("side"), F.coalesce("_b._found", F.array().cast("array<struct<edge:double,n:bigint>>")).alias("_found"))
    moved = moves.filter("shift <> 0").groupBy("file", "side").agg(F.map_from_entries(F.collect_list(F.struct("table", "shift"))).alias("_moves"))
    about = cut(about.join(moved, ["file", "side"], "left").select("file", "side", "_found", "_moves"))

    def laid(each: DataFrame) -> DataFrame:
        """Rows of a file with `_xs`: where their amounts stand."""
        shift = F.coalesce(F.try_element_at("_moves", F.col("table")), F.lit(0))
        return each.withColumn("_xs", F.transform("amounts", lambda a: F.when(F.col("side") == "x0", a["x0"]).otherwise(a["x1"]) + shift))

    near = lambda e: F.exists("_xs", lambda x: F.abs(e - x) <= GIVE)
    own = laid(rows.select("file", "table", "line", "amounts").join(about, "file"))
    orphans = own.filter(~F.exists("_found", lambda c: near(c["edge"]))).groupBy("file", F.element_at("_xs", -1).alias("x")).agg(F.count(F.lit(1)).alias("n"))
    alone = _clusters(orphans, ["file"], "x").groupBy("file").agg(F.collect_list("edge").alias("_alone"))
    about = about.join(alone, "file", "left").withColumn("_all", F.concat(F.transform("_found", lambda c: c["edge"]), F.coalesce("_alone", F.array().cast("array<double>"))))
    about = cut(about.select("file", "side", "_moves", "_all"))
    used = laid(rows.select("file", "table", "line", "amounts").join(about, "file")).select("file", "side", "table", "line", F.explode(F.filter("_all", near)).alias("edge"))
    used = cut(used.groupBy("file", "side", "edge").agg(F.collect_set("table").alias("tables"), F.count_distinct("line").alias("rows")))
    # Edges with the tables that use them, from the left; then neighbours without a common table become one.
    by_file = used.groupBy("file", "side").agg(F.array_sort(F.collect_list(F.struct("edge", "tables", "rows"))).alias("_e"))
    kind = "array<struct<edges:array<double>,tables:array<bigint>,rows:bigint,most:bigint,edge:double>>"
    one = lambda e: F.struct(F.array(e["edge"]).alias("edges"), e["tables"].alias("tables"), e["rows"].alias("rows"), e["rows"].alias("most"), e["edge"].alias("edge"))

    def joined(out: Column, e: Column) -> Column:
        last = F.try_element_at(out, F.lit(-1))
        near = F.coalesce((e["edge"] - F.array_max(last["edges"]) <= SHIFT) & ~F.arrays_overlap(e["tables"], last["tables"]), F.lit(False))
        more = e["rows"] > last["most"]
        both = F.struct(F.array_append(last["edges"], e["edge"]).alias("edges"), F.array_union(last["tables"], e["tables"]).alias("tables"), (last["rows"] + e["rows"]).alias("rows"), F.greatest(last["most"], e["rows"]).alias("most"), F.when(more, e["edge"]).otherwise(last["edge"]).alias("edge"))
        return F.when(near, F.concat(F.slice(out, 1, F.size(out) - 1), F.array(both))).otherwise(F.concat(out, F.array(one(e)))).cast(kind)

    merged = F.aggregate("_e", F.array().cast(kind), joined)
    out = cut(by_file.select("file", "side", F.posexplode(merged).alias("column", "_c")).select("file", "side", "column", "_c.edge", "_c.edges", "_c.rows", "_c.tables"))
    held = about.join(out.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("column", "edges"))).alias("_held")), "file").select("file", "side", "_moves", "_held")
    first = lambda x: F.get(F.filter("_held", lambda c: F.exists(c["edges"], lambda e: F.abs(e - x) <= GIVE)), F.lit(0))["column"]
    each = laid(rows.join(held, "file"))
    stand = F.filter(F.transform("_xs", lambda x, i: F.struct(i.alias("place"), first(x).alias("column"))), lambda c: c["column"].isNotNull())
    return out, each.withColumn("_cells", stand).select(*rows.columns, "_cells")


def layouts(held: DataFrame, cells: DataFrame) -> DataFrame:
    """(file, layout, amount, amount2, debit, credit, balance): every reasonable reading of the columns, from how rows use them together.

    A column alone is the amount; two that no row uses together are debits and credits, either way round (or, in tables of
    their own, one amount printed in two places); two that most rows use together are an amount and its balance.
    """
    return _ways(held, cells.groupBy("file", "line").agg(F.array_sort(F.collect_set("column")).alias("_cols")))


def _ways(held: DataFrame, lines: DataFrame) -> DataFrame:
    """layouts() from the columns that each line uses (file, _cols)."""
    none = F.lit(None).cast("int")
    name = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) and not p.startswith("=") else F.col(p[1:]).cast("string") if isinstance(p, str) else p for p in parts])
    row = lambda label, **use: F.struct(label.alias("layout"), *[(use[c] if c in use else none).alias(c) for c in ("amount", "amount2", "debit", "credit", "balance")])
    single = held.select("file", F.inline(F.array(row(name("amount@", "=column"), amount=F.col("column")))))
    used = lines.select("file", F.explode("_cols").alias("column")).groupBy("file", "column").agg(F.count(F.lit(1)).alias("_n"))
    pair = F.flatten(F.transform("_cols", lambda a: F.transform(F.filter("_cols", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    together = lines.select("file", F.explode(pair).alias("_p")).groupBy("file", "_p.a", "_p.b").agg(F.count(F.lit(1)).alias("_both"))
    side = lambda c, n, t: held.select("file", F.col("column").alias(c), F.col("tables").alias(t)).join(used.select("file", F.col("column").alias(c), F.col("_n").alias(n)), ["file", c])
    pairs = side("a", "_na", "_ta").join(side("b", "_nb", "_tb"), "file").filter("a < b").join(together, ["file", "a", "b"], "left").withColumn("_both", F.coalesce("_both", F.lit(0)))
    a, b = F.col("a"), F.col("b")
    apart, beside = F.col("_both") == 0, (F.col("_both") > 0) & (F.col("_both") >= BESIDE * (F.col("_na") + F.col("_nb") - F.col("_both")))
    own = apart & ~F.arrays_overlap("_ta", "_tb")
    ways = F.array(
        F.when(apart, row(name("debit@", "=a", "+credit@", "=b"), debit=a, credit=b)), F.when(apart, row(name("credit@", "=a", "+debit@", "=b"), debit=b, credit=a)), F.when(own, row(name("amount@", "=a", "|", "=b"), amount=a, amount2=b)),
        F.when(beside, row(name("amount@", "=a", "+balance@", "=b"), amount=a, balance=b)), F.when(beside, row(name("amount@", "=b", "+balance@", "=a"), amount=b, balance=a)),
    )
    return single.unionByName(pairs.select("file", F.inline(F.array_compact(ways))))


def shape_readings(rows: DataFrame) -> DataFrame:
    """(statement, reading, line, day, details, cents, mark, sign, balance): the rows of placed() under every layout of their file.

    Where the column says it is a debit or a credit it goes before a mark printed with the amount. A row with no amount in
    the layout's columns is no row of that reading, nor is one of zero. A balance marked as a credit is below zero.
    """
    rows = cut(rows)
    held, each = _in_columns(rows)
    # What an amount says is read once, before its row is read under every layout.
    mark = lambda t: F.nullif(F.lower(F.regexp_extract(t, r"(?i)(cr|dr)$", 1)), F.lit(""))
    sign = lambda t: F.nullif(F.regexp_replace(F.regexp_extract(t, r"^([-+(])", 1), r"\(", "-"), F.lit(""))
    said = F.transform("amounts", lambda a: F.struct(signed_cents(a["text"]).alias("cents"), mark(a["text"]).alias("mark"), sign(a["text"]).alias("sign")))
    each = cut(each.filter(F.size("_cells") > 0).select("file", "line", "day", "details", said.alias("_said"), "_cells"))
    told = _ways(held, each.select("file", F.array_sort(F.array_distinct(F.transform("_cells", lambda c: c["column"]))).alias("_cols")))
    each = each.join(told, "file")

    def said_in(*use: str) -> Column:
        """The first amount of the row in one of the layout's columns."""
        wanted = F.array_compact(F.array(*[F.col(c) for c in use]))
        return F.get("_said", F.array_min(F.transform(F.filter("_cells", lambda c: F.array_contains(wanted, c["column"])), lambda c: c["place"])))

    found = F.struct(said_in("debit").alias("d"), said_in("credit").alias("c"), said_in("amount", "amount2").alias("o"), F.when(F.col("balance").isNotNull(), said_in("balance")["cents"]).alias("balance"))
    each = each.select(F.col("file").alias("statement"), F.concat(F.lit("shape:"), F.col("layout")).alias("reading"), "line", "day", "details", F.col("debit").isNull().alias("_single"), F.inline(F.array(found)))
    one, debit, credit = F.coalesce("d", "c", "o"), F.col("d").isNotNull(), F.col("c").isNotNull()
    out = each.select("statement", "reading", "line", "day", "details", F.abs(one["cents"]).alias("cents"), F.when(debit, "dr").when(credit, "cr").otherwise(one["mark"]).alias("mark"), F.when(F.col("_single"), one["sign"]).alias("sign"), "balance")
    return out.filter("cents > 0")


def header_readings(rows: DataFrame) -> DataFrame:
    """Rows under headers, in the form of shape_readings(), as one reading called `table`."""
    cents = F.coalesce(F.nullif("debit", F.lit(0)), F.nullif("credit", F.lit(0)), F.col("amount"))
    mark = F.when(F.coalesce("debit", F.lit(0)) != 0, "dr").when(F.coalesce("credit", F.lit(0)) != 0, "cr").when(F.col("amount") < 0, "cr")
    out = rows.select(F.col("file").alias("statement"), F.lit(TABLE).alias("reading"), F.col("line").cast("bigint").alias("line"), "day", "details", F.abs(cents).alias("cents"), mark.alias("mark"), F.lit(None).cast("string").alias("sign"), "balance")
    return out.filter("cents > 0")


def statements_read(lines: DataFrame) -> DataFrame:
    """(statement, status, proof, reading, convention, debits, credits) of every file, from its lines alone: the rows under its headers
    and the rows by shape under every layout of its columns are candidates of one proof, by the figures it prints or by
    its running balance. Rows, labels and headers may be broken over lines. Lines between headings of terms, and page
    numbers, count for nothing; a file without rows or without figures is told so."""
    body = cut(outside_terms(lines).select("file", F.col("line").cast("bigint").alias("line"), "text"))
    each = cut(celled(body))
    rows = cut(shape_readings(rows_wrapped(body)).unionByName(header_readings(rows_below(each))))
    wrapped = labels_wrapped(body, each).select("file", *[F.col(c).alias(f"_{c}") for c in FIGURES])
    # Read by both proofs.
    printed = figures(body).join(wrapped, "file", "left").select(F.col("file").alias("statement"), *[F.coalesce(c, f"_{c}").alias(c) for c in FIGURES if c != "minimum"])
    return decide(rows, cut(printed))
