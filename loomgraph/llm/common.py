"""What the text operators share: table paths, the scratch folder, the learning split, fixed-size bit filters."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of text that one numpy step handles at a time; longer texts are walked in pieces of this size.
STEP = 1 << 18
#: Bytes of an Arrow batch that Spark sends to a Python worker, about: a batch ends after the row that passes it.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only on one machine (a local master) and where that setting is absent, as in tests, a temporary folder is made, used
    and removed at exit.
    """
    if at := spark.conf.get("spark.checkpoint.dir", None):
        return at.rstrip("/")
    if (have := spark.sparkContext.getCheckpointDir()) is None:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="spark-scratch-")
        atexit.register(shutil.rmtree, at, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(at)
        have = f"file://{at}"
    return have.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, written once to the shared scratch folder; later reads don't run its plan again.

    They are written as Parquet: Spark then plans with the size of the files, where a checkpoint would keep the estimate
    of the plan that it cuts, which grows with each round of a loop.
    """
    at = f"{scratch(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def checkpointed(df: DataFrame) -> DataFrame:
    """As `cut`, in the form of rows that Spark checkpoints: for plans without loops, whose estimates stay small."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(scratch(df.sparkSession))
    return df.checkpoint(eager=True)


def _give_back() -> None:
    """Returns what a task no longer needs to the system: workers are kept for other tasks, and their memory adds up."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str) -> DataFrame:
    """df.mapInArrow with batches bounded by bytes; the worker's memory is given back at the end of a task.

    Spark takes the bound from the session when the plan runs, so it is lowered there.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        _give_back()

    return df.mapInArrow(whole, schema)


def held_out(doc_id: str | Column) -> Column:
    """True for a fifth of all ids, by the CRC-32 of the id as text; a null id is held out."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string")) % 5 == 0, F.lit(True))


def chosen(key: Column, share: Column | float) -> Column:
    """True for about that share of all rows: the same rows each time, evenly over all keys."""
    share = F.lit(float(share)) if isinstance(share, (int, float)) else share
    return F.pmod(F.xxhash64(key, F.lit(7)), F.lit(1 << 20)) < share * F.lit(1 << 20)


def sample_by_label(rows: DataFrame, label: str, per_label: int) -> DataFrame:
    """About per_label rows of each label, or all where there are fewer.

    The bound holds in expectation (rows are chosen by a hash of id and text). The labels and
    their counts come to the driver: one row for each distinct label.
    """
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect() if r[0] is not None}
    share = F.lit(0.0)
    for k, n in sorted(counts.items()):
        share = F.when(F.col(label) == F.lit(k), F.lit(min(1.0, per_label / n))).otherwise(share)
    return rows.where(F.col(label).isNotNull() & chosen(F.col("doc_id"), share))


def points(text: str) -> np.ndarray:
    """The code points of a text; lone surrogates stay as they are."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words that spreads every bit (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Rows of a lookup table that may be broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 200_000


def small_side(lookup: DataFrame, rows: int) -> DataFrame:
    """The lookup table of so many rows, marked for broadcast only where that is a bounded size."""
    return F.broadcast(lookup) if rows <= BROADCAST_ROWS else lookup


class Bits:
    """A Bloom filter of fixed size with two probes, built on executors and sent to all of them.

    Its size follows the expected number of keys up to ``cap_bits``; beyond that it only lets
    more keys through, so whoever uses it must check exactly afterwards.
    """

    def __init__(self, words: np.ndarray):
        self.words = words

    @staticmethod
    def width(n_keys: int, cap_bits: int, per_key: int = 16) -> int:
        """log2 of the number of bits."""
        return int(min(np.log2(cap_bits), max(15, np.ceil(np.log2(max(1, n_keys) * per_key)))))

    @staticmethod
    def build(keys: DataFrame, column: str, log2_bits: int) -> Bits:
        """keys: a DataFrame with a 64-bit column. At most 2**log2_bits / 8 bytes reach the driver."""
        mask = F.lit((1 << log2_bits) - 1)
        h = F.col(column)
        spots = keys.select(F.explode(F.array(h.bitwiseAND(mask), F.shiftrightunsigned(h, 64 - log2_bits))).alias("p"))
        rows = (
            spots.groupBy(F.bitmap_bucket_number(F.col("p") + 1).alias("b"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("p") + 1)).alias("m"))
            .collect()
        )
        words = np.zeros(1 << log2_bits >> 3, np.uint8)
        for r in rows:  # position p + 1 is bit p % 32768 of bucket p / 32768 + 1
            start = (int(r.b) - 1) * 4096
            words[start : start + 4096] |= np.frombuffer(bytes(r.m), np.uint8)[: len(words) - start]
        return Bits(words)

    def has(self, h: np.ndarray) -> np.ndarray:
        n = np.uint64(len(self.words) * 8 - 1)
        w = np.uint64(64 - int(len(self.words) * 8).bit_length() + 1)
        a, b = h & n, h >> w
        return self._bit(a) & self._bit(b)

    def _bit(self, p: np.ndarray) -> np.ndarray:
        return (self.words[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1



class Sieve:
    """A blocked Bloom filter as a table: (_w, _m), of each 64-bit word that has a bit its number and bits.

    A key has four bits in one word, so looking keys up is a join of a bounded table on one integer, in
    DataFrame functions, and the rows looked up stay where they are. There is a word for four keys (16 bits a key) up
    to MOST_WORDS; beyond that more keys pass, so whoever uses it checks exactly afterwards.
    """

    #: About 64 bytes a word once it is broadcast: 64 MB.
    MOST_WORDS = 1 << 20

    def __init__(self, keys: DataFrame, key: str, n: int):
        self.bits = max(4, min(self.MOST_WORDS.bit_length() - 1, (max(1, n) // 4).bit_length()))
        word, mask = self._spot(F.col(key))
        self.words = cut(keys.select(word.alias("_w"), mask.alias("_m")).groupBy("_w").agg(F.bit_or("_m").alias("_m")))

    def _spot(self, key: Column) -> tuple[Column, Column]:
        h = F.xxhash64(key, F.lit(29))
        bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, 6 * i).bitwiseAND(F.lit(63)).cast("int"))
        return F.shiftrightunsigned(h, 64 - self.bits), bit(0).bitwiseOR(bit(1)).bitwiseOR(bit(2)).bitwiseOR(bit(3))

    def marked(self, rows: DataFrame, key: Column, name: str = "_maybe") -> DataFrame:
        """rows with a column that is true where the key may be among the filter's keys."""
        word, mask = self._spot(key)
        names = rows.columns
        out = rows.join(F.broadcast(self.words), word == F.col("_w"), "left")
        return out.select(*[rows[c] for c in names], F.coalesce(F.col("_m").bitwiseAND(mask) == mask, F.lit(False)).alias(name))

    def passed(self, rows: DataFrame, key: Column) -> DataFrame:
        """The rows whose key may be among the filter's keys."""
        word, mask = self._spot(key)
        out = rows.join(F.broadcast(self.words), word == F.col("_w"))
        return out.where(F.col("_m").bitwiseAND(mask) == mask).select(*[rows[c] for c in rows.columns])


def without(rows: DataFrame, gone: DataFrame, keys: list[str], most: int = BROADCAST_ROWS) -> DataFrame:
    """rows without those whose key columns (not null) are in `gone`.

    A small `gone` is broadcast. Otherwise rows that a filter of its keys rules out stay where they are, and only the
    others are shuffled.
    """
    gone = gone.select(*keys)
    if (n := gone.count()) <= most:
        return rows.join(F.broadcast(gone), keys, "left_anti")
    marked = Sieve(gone.select(F.struct(*keys).alias("_k")), "_k", n).marked(rows, F.struct(*keys))
    some = marked.where("_maybe").drop("_maybe").join(gone, keys, "left_anti")
    return marked.where("not _maybe").drop("_maybe").union(some.select(*rows.columns))


def looked_up(rows: DataFrame, found: DataFrame, keys: list[str], most: int = BROADCAST_ROWS) -> DataFrame:
    """rows with the other columns of `found` (one row a key) or nulls; what is shuffled is as in `without`."""
    rest = [f for f in found.schema if f.name not in keys]
    if (n := found.count()) <= most:
        return rows.join(F.broadcast(found), keys, "left").select(*rows.columns, *[f.name for f in rest])
    marked = Sieve(found.select(F.struct(*keys).alias("_k")), "_k", n).marked(rows, F.struct(*keys))
    some = marked.where("_maybe").drop("_maybe").join(found, keys, "left").select(*rows.columns, *[f.name for f in rest])
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in rest]
    return marked.where("not _maybe").select(*rows.columns, *none).union(some)
