"""MinHash near-dedup: one-permutation hashing with optimal densification, banded buckets, stars.

1. Each text's set of word shingles is hashed once into BINS bins; an empty bin takes the value of another
   bin that a hash of (bin, attempt) picks, so similar sets borrow alike.
2. Documents with equal sets form one class; only its representative goes on.
3. BANDS bands of ROWS bins give the buckets. Of each bucket with two classes or more, every member
   gets one edge to the bucket's centre (the member that meets most others), never one to each other.
4. Edges are confirmed on full sets. Jaccard distance is a metric, so a confirmed or refuted edge also tells which
   other members of the bucket can still be near: those whose distance from the centre differs
   by no more than the threshold's. Shingles that no other such document has can't be shared, and the classes
   that the others fall in (a bitmap of a fixed size) bound what two of them share. Members that are still apart are
   tested with each other unless one of these exact bounds excludes it: the exact way for buckets in which the
   star does not settle everything; it has no cap.
5. Links make connected components.

Two sets that should be linked share no bucket with a probability of about 1e-8 at a threshold of 85 and 1e-5 at 80 (at the threshold; less above).

Defined cases: null and empty texts, and texts of white space, have no shingle, are linked with
nothing and kept; with fewer words than a shingle the whole text is one; a null id links with
nothing and is kept; rows of one id and text get equal results; ids that occur with different texts count
as one document of several sets; other columns are never looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import STEP, Sieve, cut, in_arrow, mixed, without
from .components import components

BANDS, ROWS = 48, 7
BINS = BANDS * ROWS
SHINGLE = 5
ATTEMPTS = 2048
#: Members of a star that are compared with its centre in one group; a larger star is dealt to several, each with the centre's set.
STAR_ROWS = 256
#: Words of the bitmap of a set's classes of shingles that bounds what two sets can share.
CLASS_WORDS = 32
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
BASE = 0xD1B54A32D192ED03


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n, from one pair of arrays that grows to the largest n asked for."""
    if len(_powers[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for i, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[i] = np.cumprod(x)
    return _powers[0][:n], _powers[1][:n]


@cache
def borrowed() -> np.ndarray:
    """[attempt, bin]: where an empty bin looks for a value."""
    at = np.arange(ATTEMPTS, dtype=np.uint64)[:, None] * np.uint64(BINS) + np.arange(BINS, dtype=np.uint64)
    return (mixed(at + np.uint64(0x5851F42D4C957F2D)) % np.uint64(BINS)).astype(np.int64)


@cache
def factors(k: int) -> np.ndarray:
    return mixed(np.arange(1, k + 1, dtype=np.uint64)) | np.uint64(1)


def word_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash of each word, in order: the polynomial of its bytes, spread."""
    x = np.frombuffer(raw, np.uint8)
    gap = np.concatenate([[True], SPACE[x], [True]])
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    start, end = edge[::2], edge[1::2]
    up, down = powers(len(raw) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((x.astype(np.uint64) + np.uint64(1)) * up[: len(x)], dtype=np.uint64)])
    return mixed((sums[end] - sums[start]) * down[start])


def pieces(raw: bytes) -> Iterator[bytes]:
    """A text in pieces of about STEP bytes that end between words."""
    k = 0
    while len(raw) - k > STEP:
        end = max(raw.rfind(c, k, k + STEP) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
        if end <= k:  # one word longer than a piece: it stays whole
            end = min((e for e in (raw.find(c, k + STEP) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")) if e >= 0), default=len(raw))
        yield raw[k:end]
        k = end
    yield raw[k:]


def shingles(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the text's k-word shingles; A-Z count as a-z."""
    raw = (text or "").encode("utf-8", "surrogatepass").lower()  # of bytes: ASCII only
    w = np.concatenate([word_hashes(p) for p in pieces(raw)])
    if not len(w):
        return w
    n = max(1, len(w) - k + 1)
    f = factors(k)
    out = np.zeros(n, np.uint64)
    for j in range(min(k, len(w))):
        out += w[j : j + n] * f[j]
    return np.unique(mixed(out + np.uint64(min(k, len(w)))))


def signature(s: np.ndarray) -> np.ndarray:
    """The lowest hash of each bin; an empty bin's value is that of the first full bin that it is sent to."""
    bins = (((s >> np.uint64(32)) * np.uint64(BINS)) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], bins[1:] != bins[:-1]]))
    out, full = np.zeros(BINS, np.uint64), np.zeros(BINS, bool)
    out[bins[first]], full[bins[first]] = s[first], True
    empty = np.flatnonzero(~full)
    for attempt in borrowed():
        if not len(empty):
            break
        source = attempt[empty]
        got = full[source]
        out[empty[got]] = out[source[got]]
        empty = empty[~got]
    return out


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """(documents, BANDS): the bucket of each band."""
    cells = signatures.reshape(len(signatures), BANDS, ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), cells.shape[:2]).copy()
    for j in range(ROWS):
        key = mixed(key ^ cells[:, :, j])
    return key.view(np.int64)


def least_size(threshold: int) -> int:
    """Sets below this size can only be linked with equal ones."""
    n = 1
    while 100 * n < threshold * (n + 1):
        n += 1
    return n


def sketches(docs: DataFrame, id_col: str, text_col: str, threshold: int) -> DataFrame:
    """(id, n, s1, s2, bands): set size, a 128-bit name of the set, its buckets (none for tiny sets)."""
    small = least_size(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, names, rows, at = [], [], [], []
            for i, text in enumerate(batch.column(1)):
                s = shingles(text.as_py())
                sizes.append(len(s))
                names.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                if len(s) >= small:
                    rows.append(signature(s))
                    at.append(i)
            name = np.frombuffer(b"".join(names), np.int64).reshape(-1, 2)
            counts = np.zeros(len(sizes) + 1, np.int32)
            counts[np.array(at, np.int64) + 1] = BANDS
            keys = band_keys(np.array(rows, np.uint64)).reshape(-1) if rows else np.zeros(0, np.int64)
            bands = pa.ListArray.from_arrays(pa.array(np.cumsum(counts, dtype=np.int32)), pa.array(keys))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(name[:, 0]), pa.array(name[:, 1]), bands], names=["id", "n", "s1", "s2", "bands"])

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("t"))
    schema = rows.select("id").schema.add("n", "long").add("s1", "long").add("s2", "long")
    return in_arrow(rows, run, schema.add("bands", T.ArrayType(T.LongType())))


def full_sets(docs: DataFrame, id_col: str, text_col: str, names: DataFrame) -> DataFrame:
    """(id, set): the sets of the documents in names (id, s1, s2), read from their own rows only, not from those of their copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t.as_py()) for t in batch.column(1)]
            name = np.frombuffer(b"".join(hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(name[:, 0]), pa.array(name[:, 1]), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["id", "s1", "s2", "set"])

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("t"))
    rows = Sieve(names, "id", names.count()).passed(rows, F.col("id"))
    sets = in_arrow(rows, run, rows.select("id").schema.add("s1", "long").add("s2", "long").add("set", T.ArrayType(T.LongType())))
    return sets.join(names, ["id", "s1", "s2"]).select("id", "set").dropDuplicates(["id"])


def _measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b) with common: how many shingles both have, na and nb: how many each has.

    One b may be in very many pairs: they are dealt to groups of about STAR_ROWS, and b's set goes to each group.
    """
    groups = cut(pairs.groupBy("b").agg(F.ceil(F.count("*") / STAR_ROWS).cast("int").alias("_g")))
    dealt = pairs.join(groups, "b").withColumn("_g", F.pmod(F.xxhash64("a"), F.col("_g")).cast("int"))
    a = sets.select(F.col("id").alias("a"), F.col("set").alias("_sa"))
    b = sets.join(groups.withColumnRenamed("b", "id"), "id").select(F.col("id").alias("b"), F.col("set").alias("_sb"), F.explode(F.sequence(F.lit(0), F.col("_g") - 1)).alias("_g"))
    joined = dealt.join(a, "a").join(b, ["b", "_g"])
    return joined.select(*pairs.columns, F.size(F.array_intersect("_sa", "_sb")).alias("common"), F.size("_sa").alias("na"), F.size("_sb").alias("nb"))


def _near(common: Column, na: Column, nb: Column, threshold: int) -> Column:
    return 100 * common >= threshold * (na + nb - common)


def _unsettled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """members (key, id, ...) of the buckets whose members have several labels, with label."""
    known = members.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    apart = known.groupBy("key").agg(F.min("label").alias("_l"), F.max("label").alias("_h")).where("_l <> _h").select("key")
    return known.join(cut(apart), "key")  # of a written table, so that a hot key of the join can be split


def link_pairs(docs: DataFrame, classes: DataFrame, id_col: str, text_col: str, threshold: int) -> DataFrame:
    """(a, b): confirmed links between representatives that connect all that is linked.

    Aggregates by bucket are written before they are joined with the bucket's members: a hot bucket of such a join can be split.
    """
    rows = classes.where(F.size("bands") > 0).select("id", "n", F.explode("bands").alias("key"))
    buckets = cut(rows.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"))
    members = cut(rows.join(buckets, "key"))
    met = members.groupBy("id").agg(F.sum("m").alias("met"))
    ranked = members.join(met, "id")
    centre = cut(ranked.groupBy("key").agg(F.min_by("id", F.struct(-F.col("met"), "id")).alias("c")))
    members = cut(members.join(centre, "key").select("key", "id", "n", "c"))
    edges = cut(members.where("id <> c").select(F.col("id").alias("a"), F.col("c").alias("b")).distinct())

    ends = members.select("id").distinct()
    names = cut(classes.join(ends, "id").select("id", "s1", "s2"))
    sets = cut(full_sets(docs, id_col, text_col, names))

    tested = cut(_measured(edges, sets))
    near = _near(F.col("common"), F.col("na"), F.col("nb"), threshold)
    links = tested.where(near).select("a", "b")
    labels = components(links)

    # What the stars leave open.
    apart = 1 - F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))
    far = tested.select(F.col("a").alias("id"), F.col("b").alias("c"), apart.alias("d"))
    rest = members.where("id <> c").join(far, ["id", "c"])
    limit = (100 - threshold) / 100 + 1e-9
    # A member has an open partner only if some member with another label is about as far from the centre.
    rest = cut(_unsettled(rest, labels))
    if rest.isEmpty():
        return links
    ids = rest.select("id").distinct()
    inside = sets.join(ids, "id").select("id", F.size("set").alias("size"), F.explode("set").alias("h"))
    shared = inside.select("id", "h").join(inside.groupBy("h").agg(F.count("*").alias("k")).where("k > 1"), "h", "left_semi")
    spot = F.shiftrightunsigned("h", 64 - (64 * CLASS_WORDS).bit_length() + 1)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), spot.bitwiseAND(F.lit(63)).cast("int"))
    words = [f"w{i}" for i in range(CLASS_WORDS)]
    shared = shared.groupBy("id").agg(F.count("*").alias("most"), *[F.bit_or(F.when(F.shiftright(spot, 6) == i, bit).otherwise(F.lit(0).cast("long"))).alias(w) for i, w in enumerate(words)])
    shared = shared.withColumn("extra", F.col("most") - sum(F.bit_count(w) for w in words))  # shingles beyond one a class
    # No partner has more of its shingles in common than `most`.
    smallest = cut(rest.groupBy("key").agg(F.min("n").alias("k"))).join(rest.select("key", "id"), "key").groupBy("id").agg(F.min("k").alias("least"))
    bands = classes.select("id", "bands")
    rest = rest.join(shared, "id").join(smallest, "id").join(bands, "id")
    possible = _near(F.col("most"), F.col("n"), F.greatest("least", "most"), threshold)
    rest = cut(_unsettled(rest.where(possible).drop("label", "least"), labels))
    x, y = rest.alias("x"), rest.alias("y")
    most = F.least("x.most", "y.most", "x.n", "y.n")
    classes_met = sum(F.bit_count(F.col(f"x.{w}").bitwiseAND(F.col(f"y.{w}"))) for w in words) + F.least("x.extra", "y.extra")
    once = F.col("x.key") == F.array_min(F.array_intersect("x.bands", "y.bands"))  # of the buckets that two share, one
    open_pairs = x.join(
        y,
        (F.col("x.key") == F.col("y.key")) & (F.col("x.id") < F.col("y.id")) & (F.col("x.label") != F.col("y.label"))
        & (F.abs(F.col("x.d") - F.col("y.d")) <= limit) & _near(most, F.col("x.n"), F.col("y.n"), threshold)
        & _near(F.least(most, classes_met), F.col("x.n"), F.col("y.n"), threshold) & once,
    ).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    more = cut(_measured(open_pairs, sets)).where(near).select("a", "b")
    return links.union(more)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 85) -> DataFrame:
    """A row for each row of docs: id, n_shingles, component_id (the smallest id of its group), kept.

    threshold: per cent of the union that two sets must have in common, compared in whole numbers.
    """
    rows = cut(sketches(docs, id_col, text_col, threshold))
    full = rows.where("n > 0 and id is not null")
    classes = cut(full.groupBy("s1", "s2").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("bands").alias("bands")))
    labels = components(link_pairs(docs, classes, id_col, text_col, threshold))
    named = classes.select("s1", "s2", "id").join(labels, "id", "left").select("s1", "s2", F.coalesce("label", "id").alias("label"))
    narrow = rows.select("id", "n", "s1", "s2")
    out = narrow.join(cut(named), ["s1", "s2"], "left")
    component = F.when(F.col("n") > 0, F.coalesce("label", "id")).otherwise(F.col("id"))
    component = F.when(F.col("id").isNotNull(), component)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 85) -> DataFrame:
    """docs with the row of the smallest id of each group; all columns stay as they are."""
    gone = cut(near_duplicates(docs, id_col, text_col, threshold).where("not kept").select(F.col(id_col)).distinct())
    return without(docs, gone, [id_col]).select(*docs.columns)
