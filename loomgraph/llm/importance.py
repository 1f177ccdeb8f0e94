"""Resampling towards a target distribution: hashed runs of words, bucket gains, Gumbel scores, the highest of them drawn.

The `tokenizers` library splits ASCII-lowered text into words by a regular expression (nothing is trained); windows over the
words' offset pairs give the runs, and the CRC-32 of a run its bucket. Each text is split once: its buckets are written to the
shared folder, two or four bytes a run, and both later steps (the histogram and the sums of gains) read those.

Defined cases: null, empty or wordless text has no run, weight 0 and is not eligible unless ``min_words`` is 0; a null id
counts as an empty one in the score's hash and comes last in ties; repeated rows each count and are each drawn; an empty
table gives an empty result, an empty target gives gains that only smooth; texts of any length are split whole, in pieces that
end between two words; other columns stay in the struct ``_row``, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Regex, pre_tokenizers

from ..numbering import running_number
from .common import cut, in_arrow

#: A word: no ASCII character but letters and digits; in ASCII-lowered text those are a-z and 0-9.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Characters that one call of the splitter gets at most, unless a single word is longer.
PIECE = 1 << 18
#: Distinct words whose buckets a task remembers.
REMEMBERED = 1 << 17


class Runs:
    """The buckets of all runs of 1 to `longest` consecutive words of a text."""

    def __init__(self, longest: int, buckets: int):
        self.longest, self.buckets = longest, buckets
        self.split = pre_tokenizers.Split(Regex(WORD), "removed", invert=True)
        self.known: dict[str, int] = {}

    def words(self, text: str) -> Iterator[list[tuple[str, tuple[int, int]]]]:
        """(word, offset pair in the piece), by pieces of ASCII-lowered text that are cut between two words."""
        low = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
        start = 0
        while start < len(low):
            stop = start + PIECE
            while stop < len(low) and not (low[stop] < "\x80" and not low[stop].isalnum()):
                stop += 1
            yield self.split.pre_tokenize_str(low[start:stop])
            start = stop

    def _bucket(self, word: str) -> int:
        b = zlib.crc32(word.encode("utf-8", "surrogatepass")) % self.buckets
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        self.known[word] = b
        return b

    def of(self, text: str | None) -> tuple[int, np.ndarray]:
        """(number of words, buckets of all runs)."""
        n, found, tail = 0, [], []
        known, bucket = self.known, self._bucket
        for piece in self.words(text or ""):
            n += len(piece)
            single = [known[w] if w in known else bucket(w) for w, _ in piece]
            found.append(np.array(single, np.int64))
            if self.longest > 1:  # a window over offset pairs: its words, joined by one space
                near = tail + [w for w, _ in piece]
                for size in range(2, self.longest + 1):
                    first = max(0, len(tail) - size + 1)
                    runs = (" ".join(near[i : i + size]) for i in range(first, len(near) - size + 1))
                    found.append(np.array([zlib.crc32(r.encode("utf-8", "surrogatepass")) % self.buckets for r in runs], np.int64))
                tail = near[-(self.longest - 1) :]
        return n, np.concatenate(found) if found else np.zeros(0, np.int64)


def bucketed(docs: DataFrame, text_col: str = "text", longest: int = 1, buckets: int = 10_000) -> DataFrame:
    """(_row, n_words, runs): each row of docs without its text, with the buckets of its runs as little-endian integers."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"
    packed = docs.select(docs[text_col].alias("_text"), F.struct(*[docs[c] for c in docs.columns if c != text_col]).alias("_row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Runs(longest, buckets)
        for batch in batches:
            got = [reader.of(t.as_py()) for t in batch.column(0)]
            counts = pa.array([n for n, _ in got], pa.int64())
            runs = pa.array([b.astype(kind).tobytes() for _, b in got], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(1), counts, runs], names=["_row", "n_words", "runs"])

    schema = T.StructType([packed.schema["_row"], T.StructField("n_words", T.LongType()), T.StructField("runs", T.BinaryType())])
    return in_arrow(packed, run, schema)


def histogram(rows: DataFrame, buckets: int = 10_000) -> np.ndarray:
    """How often each bucket occurs in the runs of all rows; tasks send at most one row a bucket."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            for x in batch.column(0):
                sums += np.bincount(np.frombuffer(x.as_py(), kind), minlength=buckets)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], names=["b", "n"])

    out = np.zeros(buckets, np.int64)
    for r in in_arrow(rows.select("runs"), run, "b long, n long").groupBy("b").agg(F.sum("n").alias("n")).collect():
        out[r.b] = r.n
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the target's smoothed share over the raw one's) of each bucket, in doubles."""
    s, t = raw.astype(float), target.astype(float)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + len(s)) / ((s + 1) * (t.sum() + len(t))))).astype(np.int64)


def weighted(rows: DataFrame, gain: np.ndarray) -> DataFrame:
    """(_row, n_words, n_features, weight): the floored mean of the gains of a row's runs, 0 where there are none."""
    shared = rows.sparkSession.sparkContext.broadcast(gain)
    kind = "<u2" if len(gain) <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = [np.frombuffer(x.as_py(), kind) for x in batch.column(2)]
            n = pa.array([len(x) for x in runs], pa.int64())
            mean = pa.array([int(shared.value[x].sum()) // len(x) if len(x) else 0 for x in runs], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), n, mean], names=["_row", "n_words", "n_features", "weight"])

    schema = T.StructType([*rows.schema.fields[:2], T.StructField("n_features", T.LongType()), T.StructField("weight", T.LongType())])
    return in_arrow(rows, run, schema)


def drawn(rows: DataFrame, percent: int, min_words: int, seed: int, doc_id: str = "doc_id") -> DataFrame:
    """rows of `weighted` with `score` and `rank`: rank counts the drawn rows by falling score, then id; others have none.

    A score is an integer, a weight plus a Gumbel draw, so that there are at most some hundred thousand different ones: their counts
    give the lowest score that is drawn. Only rows from there on are sorted, by ranges.
    """
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"_row.{doc_id}").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = cut(rows.withColumn("score", F.col("weight") + gumbel))
    enough = F.col("n_words") >= min_words
    counts = sorted(((r.score, r.n) for r in scored.where(enough).groupBy("score").agg(F.count("*").alias("n")).collect()), reverse=True)
    draw = percent * sum(n for _, n in counts) // 100
    least, seen = None, 0
    for score, n in counts:
        if seen >= draw:
            break
        least, seen = score, seen + n
    none = F.lit(None).cast("long").alias("rank")
    if least is None:
        return scored.select("*", none)
    top = enough & (F.col("score") >= least)
    ordered = running_number(scored.where(top), [F.desc("score"), F.asc_nulls_last(F.col(f"_row.{doc_id}"))], "rank", cut)
    return ordered.withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank"))).union(scored.where(~top).select("*", none))


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 10, longest: int = 1, buckets: int = 10_000, min_words: int = 20, seed: int = 2024, text_col: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """(_row, n_words, n_features, weight, score, rank) of each row of docs; `percent` of the rows with enough words are drawn."""
    rows = cut(bucketed(docs, text_col, longest, buckets))
    wanted = bucketed(target.select(text_col), text_col, longest, buckets)
    gain = gains(histogram(rows, buckets), histogram(wanted, buckets))
    return drawn(weighted(rows, gain), percent, min_words, seed, doc_id)
