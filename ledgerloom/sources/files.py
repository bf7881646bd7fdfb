"""Readers and writers of ledgers: delimited text of unknown layout, records in text, JSON, and a store by year."""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dates import read_date
from ..functions.money import signed_cents

#: Words of a table's header and what their column holds (fixed values); the first that fits.
HEADER_WORDS = {
    "date": ["transaction date", "txn date", "value date", "date"], "details": ["description", "narration", "particulars", "details", "merchant", "remarks"],
    "debit": ["debit", "withdrawal"], "credit": ["credit", "deposit"], "amount": ["amount", "value"], "type": ["dr/cr", "type"], "card": ["card number", "card"],
}


def meaning(header: list[str]) -> dict[str, str]:
    """{what it holds: column} for the columns of a header that are understood; each column is used once.

    >>> meaning(["Txn Date", "Narration", "Withdrawal Amt", "Deposit Amt"])
    {'date': 'Txn Date', 'details': 'Narration', 'debit': 'Withdrawal Amt', 'credit': 'Deposit Amt'}
    """
    out: dict[str, str] = {}
    for what, words in HEADER_WORDS.items():
        for word in words:
            hit = next((h for h in header if h not in out.values() and word in h.strip().lower()), None)
            if hit is not None:
                out[what] = hit
                break
    return out


def separator(head: str) -> str:
    """The separator that lines agree on; a comma where they have none, as in a file of one column.

    >>> separator("a;b\\n1;2"), separator("a\\n1")
    (';', ',')
    """
    try:
        return csv.Sniffer().sniff(head, delimiters=",;\t|").delimiter
    except csv.Error:
        return ","


def decoded(content: Column) -> Column:
    """Bytes of a file as text: by its mark of order, else as UTF-8 where they are that, else as Western letters."""
    wide = F.hex(F.substring(content, 1, 2))
    text = F.when(wide.isin("FFFE", "FEFF"), F.decode(content, "UTF-16")).when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))
    return F.regexp_replace(text, "^\ufeff", "")


def read_delimited(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """A delimited file as text columns; the separator is the one that the first lines agree on."""
    head = [r[0] for r in spark.read.option("encoding", encoding).text(path).limit(60).collect()]
    return spark.read.csv(path, sep=separator("\n".join(head)), header=True, encoding=encoding, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, mode="PERMISSIVE")


def card_rows(table: DataFrame) -> DataFrame:
    """(day, details, cents, credit) of an exported table, by the meaning of its header. Lines without a date or an amount
    are no rows."""
    found = meaning(table.columns)
    if "date" not in found or "details" not in found or not {"amount", "debit", "credit"} & found.keys():
        raise ValueError(f"no date, details and amount among {table.columns}")
    col = lambda what: F.col(f"`{found[what]}`") if what in found else F.lit(None).cast("string")
    both = signed_cents(col("amount"))
    out, back = F.abs(signed_cents(col("debit"))), F.abs(signed_cents(col("credit")))
    marked = F.lower(col("type")).startswith("c")
    cents = F.coalesce(F.when(out > 0, out), F.when(back > 0, back), F.abs(both))
    credit = F.coalesce(F.when(out > 0, F.lit(False)), F.when(back > 0, F.lit(True)), marked, both < 0)
    rows = table.select(read_date(col("date")).alias("day"), F.trim(col("details")).alias("details"), cents.alias("cents"), credit.alias("credit"))
    return rows.filter("day is not null and cents is not null")


def records(lines: DataFrame, starts: str, fields: dict[str, str]) -> DataFrame:
    """Lines (file, line, text) to records: a line that matches `starts` begins one; each field is the first group of its
    pattern, from the first line of the record that has it. Lines before the first record are left out.

    Records are numbered by a running count inside their file, so files are read in parallel.
    """
    text = F.col("text")
    # From the last line up: where a record starts, the last find of a field is its first one, and its own if it stands above the next
    # start. One order of a file's lines serves all, its records among them; nothing is grouped. Lines are ordered as they are, and
    # what is found in them is looked for behind that, so that what is shuffled and sorted is no wider than they are.
    up = Window.partitionBy("file").orderBy(F.col("line").desc())
    so_far, below = up.rowsBetween(Window.unboundedPreceding, Window.currentRow), up.rowsBetween(Window.unboundedPreceding, -1)
    begins = text.rlike(starts)
    got = {f"_{i}": F.last(F.when(text.rlike(p), F.struct("line", F.regexp_extract("text", p, 1).alias("got"))), ignorenulls=True).over(so_far) for i, p in enumerate(fields.values())}
    ordered = lines.select("file", "line", "text").repartition("file").sortWithinPartitions("file", F.col("line").desc())
    heads = ordered.withColumns({"_start": begins, "_next": F.last(F.when(begins, F.col("line")), ignorenulls=True).over(below), **got}).filter("_start").drop("text", "_start")
    record = F.count(F.lit(1)).over(Window.partitionBy("file")) - F.row_number().over(up) + 1
    own = lambda i: F.when(F.col("_next").isNull() | (F.col(f"_{i}.line") < F.col("_next")), F.col(f"_{i}.got"))
    return heads.select("file", record.alias("record"), *[own(i).alias(name) for i, name in enumerate(fields)])


#: A payment of an activity statement: day and time begin it, the other lines follow (fixed patterns).
ACTIVITY_START = r"^[A-Z][a-z]{2} [0-9]{1,2}, [0-9]{4}"
ACTIVITY_FIELDS = {
    "day": r"^([A-Z][a-z]{2} [0-9]{1,2}, [0-9]{4})", "clock": r"([0-9]{1,2}:[0-9]{2} [APap][Mm])", "payee": r"^(?:Paid to|Received from) (.+)$", "txn_id": r"^Transaction ID\s*:?\s*(\S+)", "utr": r"^UTR No\.?\s*:?\s*(\S+)",
    "direction": r"^(DEBIT|CREDIT|Debit|Credit)", "amount": r"(?:₹|INR)\s*([0-9,]+(?:\.[0-9]{1,2})?)",
}


def read_activity(spark: SparkSession, path: str) -> DataFrame:
    """Text statements of payments as records; the order of lines is that of the file."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("line", "text"))
    return records(text.withColumn("text", F.trim("text")), ACTIVITY_START, ACTIVITY_FIELDS)


def read_json_records(spark: SparkSession, path: str, synonyms: dict[str, list[str]]) -> DataFrame:
    """Objects of JSON files (one, a list, or one a line), each field from the first of its synonyms that is there."""
    rows = spark.read.json(path, multiLine=True)
    have = {c.lower(): c for c in rows.columns}
    pick = lambda names: F.coalesce(*[F.col(f"`{have[n.lower()]}`").cast("string") for n in names if n.lower() in have], F.lit(None).cast("string"))
    return rows.select(*[pick(names).alias(field) for field, names in synonyms.items()])


def save_by_year(rows: DataFrame, path: str) -> None:
    """Movements as one folder for each year; only the years that `rows` has are written anew."""
    by_year = rows.withColumn("year", F.year("ts"))
    by_year.repartition("year", F.pmod(F.xxhash64("id"), F.lit(16))).write.option("partitionOverwriteMode", "dynamic").partitionBy("year").mode("overwrite").parquet(path)


def load_by_year(spark: SparkSession, path: str, years: list[int] | None = None) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows.filter(F.col("year").isin(years)) if years else rows


def new_files(files: DataFrame, seen: DataFrame) -> DataFrame:
    """Files (sha256, ...) that were not read before, each content once."""
    return files.dropDuplicates(["sha256"]).join(seen.select("sha256"), "sha256", "left_anti")


#: Words that tell the kind of a file (fixed values), and the least number of them that must be there.
FILE_MARKS = {
    "upi": ["transaction id", "utr", "debit", "paid to"], "card": ["total due", "minimum due", "statement date", "credit limit"], "bills": ["bill payment", "paid with", "card ending"], "export": ["withdrawal", "deposit", "narration", "balance"],
}


def file_kind(text: Column, least: int = 2) -> Column:
    """The kind whose marks a text has most of (the first listed on a tie), null below `least`."""
    low = F.lower(text)
    counts = [(k, sum((low.contains(w).cast("int") for w in words[1:]), low.contains(words[0]).cast("int"))) for k, words in FILE_MARKS.items()]
    best = F.greatest(*[n for _, n in counts])
    return F.when(best >= least, F.coalesce(*[F.when(n == best, F.lit(k)) for k, n in counts]))


def kind_confidence(text: Column) -> Column:
    """How sure file_kind() is: the share of the kind's marks that a text has, 0 to 1."""
    low = F.lower(text)
    return F.greatest(*[sum((low.contains(w).cast("int") for w in words[1:]), low.contains(words[0]).cast("int")) / F.lit(float(len(words))) for words in FILE_MARKS.values()])


def redacted_tokens(rows: DataFrame, column: str, salt: str) -> DataFrame:
    """Numbers of six digits or more, but for their last two, and names before an @ become tokens of their own: the same value
    the same token in every text, so that rows can still be told apart and joined."""
    t, parts = F.col(column), r"([0-9]{6,}|[A-Za-z0-9._%+-]+@|[^0-9A-Za-z._%+-]+|[0-9A-Za-z._%+-]+)"
    token = lambda x, n: F.left(F.sha2(F.concat(F.lit(salt), x), 256), n)
    number = lambda x: F.concat(token(x, F.length(x) - 2), F.right(x, F.lit(2)))
    hidden = lambda x: F.when(x.rlike("^[0-9]{6,}$"), number(x)).when(x.endswith("@"), F.concat(token(F.rtrim(F.translate(x, "@", "")), F.lit(9)), F.lit("@"))).otherwise(x)
    return rows.withColumn(column, F.array_join(F.transform(F.regexp_extract_all(t, F.lit(parts), F.lit(1)), hidden), ""))


def redacted(text: Column) -> Column:
    """Digits of numbers of six or more become X but for the last two, addresses before the @ go."""
    t = F.regexp_replace(text, r"[0-9](?=[0-9]{2,}[0-9]{2}\b)(?<=[0-9])", "X")
    return F.regexp_replace(t, r"[A-Za-z0-9._%+-]+@", "hidden@")
