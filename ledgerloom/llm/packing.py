"""Packing: best-fit decreasing into windows of equal size; documents longer than a window are first cut into full ones.

Lengths are whole numbers below the window, so best-fit decreasing over all pieces is best-fit decreasing over a
histogram: at most `window` lengths, each with a count. The driver works out the packing of that histogram, whose size
does not depend on the data: runs of windows with the same contents are kept as one entry with a multiplicity, and a
segment tree indexed by remaining capacity finds the tightest open run. The pieces then take their places by their
rank among the pieces of equal length, through a join with the list of runs. No piece ever passes through the driver.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import held, map_texts, read_table, written

VOCABULARY = "word_bpe_49k.json"
WINDOW = 2048
END_ID = 1
#: Pieces of one length that one task ranks, about: copies may give one length to a third of all pieces, and most pieces of a
#: corpus of long texts are full windows.
RANKED = 50_000
#: Characters of texts whose chunks are numbered together, about: more would be fewer distinct chunks, but more memory in a worker.
TOGETHER = 1_000_000

#: What no plain chunk holds. Plain chunks have visible ASCII characters and letters of Latin-1 and Latin Extended-A, which lower-case
#: one by one and never compose, and no special token of the vocabulary.
_ODD = r"[^!-~À-ÖØ-öø-įı-ſ]|<\|"
#: How the vocabulary's own splitter cuts plain chunks in lower case, here each with a line feed behind it.
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|\n|[^a-zß-öø-ſ0-9\n]+")
#: A text on which the rules here and a vocabulary's own splitter must agree; else every text is handed to the tokenizer.
_PROBE = "It's 12 o'clock, NAÏVE café_x don't/we'll 'Re-do 3.5% \x01 é\x02 b\u00ad\u0301 <|x|> ÿ9"
#: Stands behind the ids of a chunk; no vocabulary has it.
_MARK = 2**32 - 1


def _byte_names() -> dict[int, str]:
    """Byte-level vocabularies spell each byte as a visible character: printable Latin-1 stands for itself, the other
    bytes are numbered from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Ids:
    """Token ids of texts, as the public tokenizer gives them with add_special_tokens=False.

    That tokenizer works within chunks between white space. Arrow splits many texts at once and numbers their distinct
    chunks; only these are cut into words, and only words not remembered go through the vocabulary's merges. Chunks
    outside the common cases (letters beyond Latin, marks that compose, white space beyond ASCII, the vocabulary's special
    tokens) are handed to the tokenizer as they are, and remembered too.
    """

    #: Bytes that what is remembered may take, about. Half of it is what has been met since the other half was filled: words that
    #: keep coming are never forgotten.
    LIMIT, ENTRY = 96 << 20, 200

    def __init__(self, path: str | None = None):
        import public_tokenizers
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path or public_tokenizers.path(VOCABULARY))
        self.merge = self.whole.model.tokenize
        self.hidden = [(chr(b), name) for b, name in _byte_names().items() if chr(b) not in (name, "\n")]
        self.mark = {"\n": np.array([_MARK], "<u4").tobytes()}
        self.met, self.before = dict(self.mark), {}
        self.size = 0
        self.known = True
        self.known = self.of(_PROBE) == self._exact(_PROBE).tobytes()

    def _exact(self, text: str) -> np.ndarray:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4")

    def _remember(self, keys: list[str], ids: list[bytes]) -> None:
        self.met.update(zip(keys, ids, strict=True))
        self.size += sum(map(len, keys)) + sum(map(len, ids)) + self.ENTRY * len(keys)

    def _spelt(self, words: list[str]) -> list[str]:
        """As byte-level vocabularies spell words without line feeds."""
        lines = "\n".join(words)
        if not lines.isascii():
            lines = lines.encode().decode("latin-1")
            for byte, name in self.hidden:
                lines = lines.replace(byte, name)
        return lines.split("\n")

    def _meet(self, words: set[str], odd: list[str]) -> None:
        """Have the ids of these words and odd chunks in `met`."""
        if self.size > self.LIMIT // 2:
            self.met, self.before, self.size = dict(self.mark), self.met, 0
        new = words.union(odd).difference(self.met)
        again = [w for w in new if w in self.before] if self.before else []
        self._remember(again, [self.before[w] for w in again])
        new.difference_update(again)
        rest = new.intersection(odd)
        self._remember(list(rest), [self._exact(c).tobytes() for c in rest])
        new = list(new - rest)
        if new:
            tokens = [[t.id for t in self.merge(w)] for w in self._spelt(new)]
            data = np.fromiter(itertools.chain.from_iterable(tokens), "<u4").tobytes()
            ends = [0, *itertools.accumulate([4 * len(t) for t in tokens])]
            self._remember(new, [data[a:b] for a, b in itertools.pairwise(ends)])

    def _chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, where those of each chunk begin among them, how many they are) of distinct chunks."""
        odd = pc.match_substring_regex(chunks, _ODD)
        plain = pc.filter(chunks, pc.invert(odd))
        rest = pc.filter(chunks, odd).to_pylist()
        lines = pc.binary_join(pa.ListArray.from_arrays([0, len(plain)], plain), pa.scalar("\n", plain.type))[0].as_py() + "\n" if len(plain) else ""
        parts = _PARTS.findall(lines.lower())
        self._meet(set(parts), rest)
        for chunk in rest:
            parts += chunk, "\n"
        ids = np.frombuffer(b"".join([self.met[p] for p in parts]), "<u4")
        ends = np.flatnonzero(ids == _MARK)
        begin, number = np.zeros((2, len(chunks)), np.int64)
        at = np.argsort(odd.to_numpy(zero_copy_only=False), kind="stable")
        begin[at] = np.concatenate([[0], ends[:-1] + 1])[: len(ends)]
        number[at] = ends - begin[at]
        return ids, begin, number

    def of_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts behind each other, END_ID behind each text; where each text's end)."""
        if not self.known:
            ids = [np.append(self._exact(t), np.uint32(END_ID)) for t in texts]
            return np.concatenate([np.zeros(0, "<u4"), *ids]), np.cumsum([len(i) for i in ids], dtype=np.int64)
        split = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
        chunks = pc.dictionary_encode(split.values)
        ids, begin, number = self._chunks(chunks.dictionary)
        # The end is one more chunk, behind the last of each text.
        ends = split.offsets.to_numpy()[1:]
        use = np.insert(chunks.indices.to_numpy(), ends, len(number))
        ids, begin, number = np.append(ids, np.array([END_ID], "<u4")), np.append(begin, len(ids)), np.append(number, 1)
        number = number[use]
        upto = np.cumsum(number)
        total = int(upto[-1]) if len(upto) else 0
        kind = np.int32 if max(total, len(ids)) < 2**31 else np.int64
        at = np.repeat((begin[use] - upto + number).astype(kind), number)
        at += np.arange(total, dtype=kind)
        return ids[at], upto[ends + np.arange(len(texts))]

    def of(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of one text, without an end."""
        return self.of_all([text])[0][:-1].tobytes()


def ids_of(path: str | None = None) -> Ids:
    """One per Python worker; it serves many tasks of the stage."""
    return held(f"ids {path}", lambda: Ids(path))


_PIECE = "start: bigint, length: bigint, ids_crc32: bigint, doc_tokens: bigint"


def numbered_as_read(docs: DataFrame) -> DataFrame:
    """Adds _at: a row's number, from 0, in the order in which its Parquet files hold the rows; null for rows of no file."""
    try:
        rows = docs.withColumns({"_file": F.col("_metadata.file_path"), "_row": F.col("_metadata.row_index")})
    except AnalysisException:
        return docs.withColumn("_at", F.lit(None).cast("bigint"))
    files = rows.groupBy("_file").agg((F.max("_row") + 1).alias("_n"))
    before = files.select("_file", F.coalesce(F.sum("_n").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row a file
    return rows.join(F.broadcast(before), "_file").withColumn("_at", F.col("_before") + F.col("_row")).drop("_file", "_row", "_before")


def cut(docs: DataFrame, window: int = WINDOW, path: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """The pieces of all documents: full windows from the front, then the rest. Every document has a last id of its own,
    so null and empty texts have one piece of length 1. The columns of `keep` come with them."""

    def compute(texts: list[str]) -> dict:
        ids, ends = ids_of(path).of_all(texts)
        data, out = memoryview(ids).cast("B"), []
        for begin, end in itertools.pairwise([0, *ends.tolist()]):
            parts = [data[4 * a : 4 * min(a + window, end)] for a in range(begin, end, window)]
            out.append([{"start": k * window, "length": len(part) // 4, "ids_crc32": zlib.crc32(part), "doc_tokens": end - begin} for k, part in enumerate(parts)])
        return {"_pieces": out}

    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", *keep)
    return map_texts(narrow, ("doc_id", *keep), "text", f"_pieces array<struct<{_PIECE}>>", compute, TOGETHER).select("doc_id", *keep, F.inline("_pieces"))


class Capacities:
    """A segment tree over remaining capacities 0..size: which of them have an open run, and the tightest that fits."""

    def __init__(self, size: int):
        self.leaves = 1
        while self.leaves <= size:
            self.leaves *= 2
        self.open = [0] * (2 * self.leaves)

    def set(self, capacity: int, is_open: bool) -> None:
        i = capacity + self.leaves
        self.open[i] = int(is_open)
        while i > 1:
            i //= 2
            self.open[i] = self.open[2 * i] | self.open[2 * i + 1]

    def tightest(self, least: int) -> int | None:
        """The smallest open capacity of at least `least`."""
        i = least + self.leaves
        if i >= 2 * self.leaves:
            return None
        if self.open[i]:
            return least
        while i > 1:
            if i % 2 == 0 and self.open[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.open[2 * i] else 2 * i + 1
                return i - self.leaves
            i //= 2
        return None


def best_fit_decreasing(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """Places of all pieces as runs (length, rank_from, rank_to, first_window, offset): the pieces of that length with
    ranks rank_from..rank_to-1 lie at `offset` in consecutive windows from first_window on.

    Longest first; each piece goes to the open window with the least room that holds it, else to a new one. Equal
    windows are handled together: a length meets each group of equal open windows once and adds at most two, so the number
    of runs depends on the lengths and not on how many pieces there are (3,000 to 32,000 for all lengths below 2,048, the
    same at a million times the pieces). That table is what pack() broadcasts.

    >>> best_fit_decreasing({6: 2, 4: 3}, 10)
    [(6, 0, 2, 0, 0), (4, 0, 2, 0, 6), (4, 2, 3, 2, 0)]
    """
    tree = Capacities(window)
    runs: dict[int, list[tuple[int, int]]] = defaultdict(list)  # remaining capacity: (first window, number)
    out, windows = [], 0

    def put(capacity: int, first: int, n: int) -> None:
        runs[capacity].append((first, n))
        if len(runs[capacity]) == 1:
            tree.set(capacity, True)

    for length in sorted((x for x, n in histogram.items() if n), reverse=True):
        rank, left = 0, histogram[length]
        while left:
            capacity = tree.tightest(length)
            if capacity is None:
                # Each new window takes as many as fit: once one is opened, it is the tightest for the next piece.
                fit = window // length
                n = left // fit
                if n:
                    for k in range(fit):
                        out.append((length, rank, rank + n, windows, k * length))
                        rank += n
                    put(window - fit * length, windows, n)
                    windows, left = windows + n, left - n * fit
                if left:
                    for k in range(left):
                        out.append((length, rank, rank + 1, windows, k * length))
                        rank += 1
                    put(window - left * length, windows, 1)
                    windows, left = windows + 1, 0
                continue
            first, n = runs[capacity].pop()
            if not runs[capacity]:
                tree.set(capacity, False)
            # As before, a window that was just used is the tightest for the next piece while that fits.
            fit = capacity // length
            whole = min(n, left // fit)
            if whole:
                for k in range(fit):
                    out.append((length, rank, rank + whole, first, window - capacity + k * length))
                    rank += whole
                put(capacity - fit * length, first, whole)
                left -= whole * fit
            if whole < n:
                used = 0
                if left and left < fit:
                    for k in range(left):
                        out.append((length, rank, rank + 1, first + whole, window - capacity + k * length))
                        rank += 1
                    put(capacity - left * length, first + whole, 1)
                    left, used = 0, 1
                if n - whole - used:
                    put(capacity, first + whole + used, n - whole - used)
    return out


def pack(pieces: DataFrame, window: int = WINDOW, order: str | None = None) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, start, length, ...). Every piece lies in one sequence, and the
    offsets of a sequence are gapless from 0.

    Pieces of full length have sequences of their own, numbered after those of the packed ones. `pieces` is read
    several times; give it written. Rows that are equal in all columns are interchangeable. An empty table stays empty.

    With `order`, a column of numbers from 0, pieces of a length take their places in that order, and sequences, full ones too,
    are numbered by the first of their pieces: as many sequences with as little padding, in the order of the documents.
    """
    spark = pieces.sparkSession
    total = pieces.agg(F.max(order)).first()[0] if order else None
    if total is None:
        order = None
    # At most `window` rows.
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    runs = best_fit_decreasing({length: n for length, n in histogram.items() if length < window}, window)
    windows = max((first + b - a for _, a, b, first, _ in runs), default=0)
    # Ranks within a length: a count per (length, salt), its running sum over the salts, and a number within each. A length has
    # a salt for each RANKED of its pieces, so there are `window` salts and one more for each RANKED pieces at most.
    salts = spark.createDataFrame([(length, -(-n // RANKED)) for length, n in histogram.items()], "length bigint, _salts bigint")
    salt = F.floor(F.col(order) * F.col("_salts") / (total + 1)) if order else F.pmod(F.xxhash64("doc_id", "start"), F.col("_salts"))
    salted = pieces.join(F.broadcast(salts), "length").withColumn("_salt", salt.cast("int")).drop("_salts")
    counts = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    number = F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*[order] * bool(order), "doc_id", "start", "ids_crc32")) - 1
    ranked = salted.withColumn("_number", number).join(before, ["length", "_salt"]).withColumn("_rank", F.col("_before") + F.col("_number")).drop("_salt", "_number", "_before")
    by_length: dict[int, list] = defaultdict(list)
    for length, a, b, first, offset in runs:
        by_length[length].append((a, b, first, offset))
    by_length[window] = [(0, 2**62, windows, 0)]
    # The runs of one length in order of rank: their starts in one array, so that a place is found inside the row.
    rows = [(length, [p[0] for p in parts], [p[2] for p in parts], [p[3] for p in parts]) for length, parts in by_length.items()]
    table = spark.createDataFrame(rows, "length bigint, _from array<bigint>, _first array<bigint>, _offset array<bigint>")
    placed = ranked.join(F.broadcast(table), "length")
    # The last run whose start is not above the rank; a length has few runs, whatever the number of pieces.
    at = F.size(F.filter("_from", lambda a: a <= F.col("_rank"))) - 1
    placed = placed.withColumn("_run", at)
    placed = placed.select(
        *pieces.columns, (F.get("_first", F.col("_run")) + F.col("_rank") - F.get("_from", F.col("_run"))).alias("sequence_id"), F.get("_offset", F.col("_run")).alias("offset"),
    )
    return in_order(placed, order, total, -(-(windows + histogram.get(window, 0)) // RANKED)) if order else placed


def in_order(placed: DataFrame, order: str, total: int, ranges: int) -> DataFrame:
    """The sequences numbered anew, from 0, by the smallest `order` (up to `total`) of their pieces: ranked in so many ranges of it,
    each shifted by those before."""
    placed = written(placed, "placed")
    first = placed.groupBy("sequence_id").agg(F.min(order).alias("_first")).withColumn("_range", F.floor(F.col("_first") * ranges / (total + 1)).cast("int"))
    first = written(first, "firsts")
    counts = first.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # `ranges` rows
    number = F.row_number().over(Window.partitionBy("_range").orderBy("_first", "sequence_id")) - 1
    named = first.withColumn("_number", number).join(F.broadcast(before), "_range").select("sequence_id", (F.col("_before") + F.col("_number")).alias("_new"))
    return placed.join(named, "sequence_id").select(*[F.col("_new").alias(c) if c == "sequence_id" else F.col(c) for c in placed.columns])


def pack_documents(docs: DataFrame, window: int = WINDOW, path: str | None = None) -> DataFrame:
    """All pieces of `docs` (doc_id, text) with their places in sequences of `window` ids.

    Null and empty texts have one piece, of the last id alone; longer texts than a window are cut, none is shortened.
    Repeated rows are packed each; a null id stays null; other columns are left out; an empty table gives an empty result.
    """
    return pack(written(cut(docs, window, path), "pieces"), window)


def pack_in_order(docs: DataFrame, window: int = WINDOW, path: str | None = None) -> DataFrame:
    """As pack_documents(), for documents read from files in whose order they are meant to be seen: sequences are numbered so."""
    return pack(written(cut(numbered_as_read(docs), window, path, ("_at",)), "pieces"), window, "_at").drop("_at")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces of all documents with their places."""
    return pack_documents(read_table(spark, sf_dir, "documents"))
