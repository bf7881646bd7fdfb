"""Helpers that several training-data operators share: inputs, samples, written intermediate tables, per-word memos."""

from __future__ import annotations

import ctypes
import gc
import itertools
import tempfile
import uuid
from collections.abc import Callable, Iterable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

#: Rows of one Arrow batch handed to Python. Texts may be 100 KB long, so Spark's default of 10,000 rows is too many.
BATCH_ROWS = 2000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Lower the rows of an Arrow batch, unless the user set their own number."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def remainder(column: str, modulus: int) -> Column:
    """crc32 of the column's text modulo `modulus`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


#: The temporary folder of this process, for sessions on one machine that name none.
_OWN: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a session on one machine takes a temporary one; on a cluster,
    whose machines would each have their own, that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="shared-"))
        found = _OWN[0]
    return found.rstrip("/")


def numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The same rows with columns called c0, c1, ..., and the new name of each: names of one's own then clash with none."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), names


def written(df: DataFrame, label: str) -> DataFrame:
    """The same rows, written once as Parquet in the shared folder and read back.

    This cuts the lineage: a lost executor costs a re-read, and Python stages above are not run again by each use.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_sample(keys: DataFrame, stratum: str, per_stratum: int, id_column: str = "doc_id", salts: int = 64) -> DataFrame:
    """At most `per_stratum` rows of each stratum, the ones with the smallest id hash, so every run picks the same.

    `keys` is a narrow table (ids and the stratum). A hot stratum is cut in `salts` parts first, each of which keeps
    its own smallest rows, so that no task sorts a whole stratum.
    """
    order = [F.xxhash64(id_column), F.col(id_column)]
    by_salt = Window.partitionBy(stratum, F.pmod(F.xxhash64(id_column), F.lit(salts))).orderBy(*order)
    by_stratum = Window.partitionBy(stratum).orderBy(*order)
    first = keys.withColumn("_rank", F.row_number().over(by_salt)).filter(F.col("_rank") <= per_stratum)
    return first.withColumn("_rank", F.row_number().over(by_stratum)).filter(F.col("_rank") <= per_stratum).drop("_rank")


def bounded_texts(rows: DataFrame, stratum: str, characters: int, id_column: str = "doc_id") -> DataFrame:
    """Of rows with a text, in each stratum the first in order of id hash whose texts have at most so many characters
    together, whatever their number; at least one."""
    line = Window.partitionBy(stratum).orderBy(F.xxhash64(id_column), F.col(id_column), F.xxhash64("text")).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.length("text")).over(line), F.lit(0))
    return rows.withColumn("_before", before).filter((F.col("_before") == 0) | (F.col("_before") + F.length("text") <= characters)).drop("_before")


def give_back() -> None:
    """Hand the memory of a finished fit back to the system, where the C library can: the driver keeps it otherwise, while later
    stages need room beside it."""
    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


class WordMemo:
    """Values of distinct words, computed once per Python worker instead of once per occurrence.

    `compute(words)` gives one row of floats for each word. The memo is emptied when it holds `limit` words, so memory
    stays bounded whatever the vocabulary is; a later occurrence is then just computed again.
    """

    def __init__(self, compute: Callable[[Sequence[str]], np.ndarray], limit: int = 300_000):
        self.compute, self.limit = compute, limit
        self.index: dict[str, int] = {}
        self.values: np.ndarray | None = None

    def rows(self, documents: Sequence[Sequence[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(row of `values` for each word in order, number of words of each document)."""
        if len(self.index) > self.limit:
            self.index, self.values = {}, None
        new = [w for w in set().union(*documents) if w not in self.index]
        if new or self.values is None:
            fresh = np.asarray(self.compute(new))
            start, end = len(self.index), len(self.index) + len(new)
            self.index.update(zip(new, range(start, end), strict=True))
            if self.values is None or end > len(self.values):  # room for twice as many, so rows are copied once on average
                larger = np.zeros((max(1, 2 * end), *fresh.shape[1:]), fresh.dtype)
                larger[:start] = 0 if self.values is None else self.values[:start]
                self.values = larger
            self.values[start:end] = fresh
        counts = np.fromiter(map(len, documents), np.int64, len(documents))
        rows = np.fromiter(map(self.index.__getitem__, itertools.chain.from_iterable(documents)), np.int32, int(counts.sum()))
        return rows, counts


#: What this Python worker has learnt for the stage at hand, by model; workers serve many tasks, so it outlives the task that
#: began it.
_HELD: dict[str, object] = {}


def held(key: str, make: Callable[[], object]):
    """The object of a key, made once per worker; one of another key goes, and its memory with it."""
    if key not in _HELD:
        if _HELD:
            _HELD.clear()
            give_back()
        _HELD[key] = make()
    return _HELD[key]


def memo(key: str, compute: Callable[[Sequence[str]], np.ndarray]) -> WordMemo:
    return held(key, lambda: WordMemo(compute))


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of `values` (along axis 0); an empty run gives zero."""
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def texts_of(batch, column: str = "text") -> list[str]:
    """The texts of a pandas batch; null becomes the empty text."""
    return [t if isinstance(t, str) else "" for t in batch[column]]


def in_pieces(batches: Iterable, characters: int = 4_000_000, column: str = "text"):
    """Pandas batches cut again so that one holds about `characters` of text (or one longer document)."""
    for batch in batches:
        if not len(batch):
            continue
        sizes = np.fromiter((len(t) if isinstance(t, str) else 0 for t in batch[column]), np.int64, len(batch))
        piece = np.cumsum(sizes) // characters
        cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(batch)]
        for a, b in itertools.pairwise(cuts):
            if b > a:
                yield batch.iloc[a:b]


def _text_pieces(batches: Iterable[pa.RecordBatch], column: str, characters: int = 4_000_000):
    """(rows, their texts) of Arrow batches, cut again so that a piece has about `characters` of text."""
    for batch in batches:
        texts = [t if t is not None else "" for t in batch.column(column).to_pylist()]
        piece = np.cumsum([len(t) for t in texts]) // characters if texts else np.zeros(0)
        cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(texts)]
        for a, b in itertools.pairwise(cuts):
            if b > a:
                yield batch.slice(a, b - a), texts[a:b]


def map_texts(docs: DataFrame, keep: Sequence[str], text: str, ddl: str, compute: Callable[[list[str]], dict], characters: int = 4_000_000) -> DataFrame:
    """The `keep` columns of every row, untouched whatever their types and nulls, beside the columns of `ddl`, which
    `compute` works out from lists of texts (null becomes the empty text) of about so many `characters`. Clashing columns of `keep` are replaced."""
    small_batches(docs.sparkSession)
    added = StructType.fromDDL(ddl)
    names = [c for c in keep if c not in added.names]
    kinds = {f.name: to_arrow_type(f.dataType) for f in added.fields}
    narrow = docs.select(*names, F.col(text).alias("_text_"))

    def run(batches: Iterable[pa.RecordBatch]):
        for batch, texts in _text_pieces(batches, "_text_", characters):
            new = compute(texts)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *(new[n] if isinstance(new[n], pa.Array) else pa.array(new[n], kind) for n, kind in kinds.items())], [*names, *kinds])

    return narrow.mapInArrow(run, StructType([*docs.select(*names).schema.fields, *added.fields]))


def filter_texts(docs: DataFrame, text: str, keep: Callable[[list[str]], np.ndarray]) -> DataFrame:
    """The rows whose text `keep` marks as true, with all their columns as they are."""
    small_batches(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]):
        for batch, texts in _text_pieces(batches, text):
            yield batch.filter(pa.array(np.asarray(keep(texts), bool)))

    return docs.mapInArrow(run, docs.schema)
