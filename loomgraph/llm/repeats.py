"""Removal of long repeated byte strings with a sparse enhanced suffix array.

Every `least`-byte string has an anchor: the position in it whose ANCHOR-byte gram hashes lowest. Equal strings have
equal anchors, so repeated strings are found among the suffixes that start at anchors, about one position in 80.

1. A first pass counts the anchors' hashes; only anchors that occur more than once go on (a Bloom filter
   of bounded size tells them apart while texts are read; what it lets through wrongly matches nothing later).
2. A second pass sends each different surrounding of such an anchor: its suffix, and what precedes it, reversed.
   Spark partitions them by anchor and sorts the suffixes: a piece of the suffix array. A scan with a stack over
   the lengths of common prefixes visits the intervals of the common-prefix tree; in each, the members'
   preceding bytes are compared (left extensions): members that share enough on both
   sides are occurrences of one repeat, all of them, not just neighbours in the array.
3. What was found for each surrounding is joined with all its occurrences, and texts with their spans.

Surroundings that occur twice as a whole need no comparison, and are sent once by each batch of texts, so a group
of copies doesn't gather in one task. An anchor with more than HOT different rows is taken out of step 2 and
settled window by window with hashed counts instead: there the rows of one anchor spread over all tasks.

Defined cases: null and empty texts have 0 bytes and lose none; a text shorter than `least` loses none;
matches never cross texts and may overlap in one text; rows of equal text get equal results, and
each is an occurrence for the others; texts are walked in pieces of bounded size; an empty table gives an empty
result; other columns are carried along unseen, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_ROWS, STEP, Bits, cut, in_arrow, looked_up, mixed, small_side
from .decontam import text_key
from .minhash import powers

ANCHOR = 40
LEAST = 200
HOT = 200_000
#: Anchors, and surroundings with their bytes, that a task holds to tell equal ones once.
HELD_KEYS, HELD_ROWS = 500_000, 40_000
#: 64 MB at most.
CAP_BITS = 1 << 29


def _lowest(v: np.ndarray, width: int) -> np.ndarray:
    """The least value of each run of `width` neighbours."""
    m, span = v, 1
    while 2 * span <= width:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    n = len(v) - width + 1
    return np.minimum(m[:n], m[width - span : width - span + n])


class Anchors:
    """The anchors of one piece of a text: for anchor i, the strings that start in start[i]..last[i] have it at at[i]."""

    def __init__(self, x: np.ndarray, least: int):
        n = len(x)
        up, down = powers(n + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((x.astype(np.uint64) + np.uint64(1)) * up[:n], dtype=np.uint64)])
        self.down = down
        gram = mixed((self.sums[ANCHOR:] - self.sums[:-ANCHOR]) * down[: n - ANCHOR + 1])
        low = np.uint64((1 << 24) - 1)
        best = _lowest((gram & ~low) | np.arange(len(gram), dtype=np.uint64), least - ANCHOR + 1) & low
        self.start = np.flatnonzero(np.concatenate([[True], best[1:] != best[:-1]]))
        self.last = np.append(self.start[1:], len(best)) - 1
        self.at = best[self.start].astype(np.int64)
        self.key = gram[self.at].view(np.int64)
        self.end = self.last + least
        lead = (self.at - self.start).astype(np.uint64)
        self.around = mixed(self.hashed(self.start, self.end) + (lead << np.uint64(32)) + self.end.astype(np.uint64) - self.start.astype(np.uint64)).view(np.int64)

    def hashed(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start])


def pieces(text: str | None, least: int) -> Iterator[tuple[int, np.ndarray]]:
    """(offset, bytes) such that every string of `least` bytes starts in one piece and ends in it."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    for k in range(0, max(0, len(raw) - least + 1), STEP):
        yield k, raw[k : k + STEP + least - 1]


def _merged(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """The union of spans, as few as possible."""
    if not len(starts):
        return []
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.flatnonzero(np.concatenate([[True], starts[1:] > ends[:-1]]))
    return list(zip(starts[new].tolist(), ends[np.append(new[1:], len(ends)) - 1].tolist(), strict=True))


def _texts(docs: DataFrame, text_col: str) -> DataFrame:
    k1, k2 = text_key(docs[text_col])
    return docs.select(docs[text_col].alias("t"), k1.alias("k1"), k2.alias("k2")).where(F.octet_length("t") >= ANCHOR)


def _counted(texts: DataFrame, least: int) -> DataFrame:
    """(key, n): how often each anchor occurs, in rows that hold what a part of a task has of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for t in batch.column(0):
                for _, x in pieces(t.as_py(), least):
                    held.append(Anchors(x, least).key)
                    size += len(held[-1])
            if size >= HELD_KEYS:
                yield pack(held)
                held, size = [], 0
        yield pack(held)

    def pack(held: list[np.ndarray]) -> pa.RecordBatch:
        k, n = np.unique(np.concatenate([*held, np.zeros(0, np.int64)]), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(k), pa.array(n.astype(np.int32))], names=["key", "n"])

    return in_arrow(texts.select("t"), run, "key bigint, n int")


def _surroundings(texts: DataFrame, least: int, known: Bits) -> DataFrame:
    """(key, around, n, lead, size, suffix, before): each different surrounding of a repeated anchor, once for each part of a task."""
    shared = texts.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], list] = {}
        for batch in batches:
            for t in batch.column(0):
                for _, x in pieces(t.as_py(), least):
                    a = Anchors(x, least)
                    for i in np.flatnonzero(shared.value.has(a.key.view(np.uint64))).tolist():
                        name = int(a.key[i]), int(a.around[i])
                        if name in seen:
                            seen[name][0] += 1
                        else:
                            s, p, e = int(a.start[i]), int(a.at[i]), int(a.end[i])
                            seen[name] = [1, p - s, e - s, x[p:e].tobytes(), x[s:p][::-1].tobytes()]
                if len(seen) >= HELD_ROWS:
                    yield pack(seen)
                    seen = {}
        yield pack(seen)

    def pack(seen: dict) -> pa.RecordBatch:
        names = np.array([*seen], np.int64).reshape(-1, 2)
        columns = list(zip(*seen.values(), strict=True)) or [[]] * 5
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(names[:, 0]), pa.array(names[:, 1]), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["key", "around", "n", "lead", "size", "suffix", "before"])

    return in_arrow(texts.select("t"), run, "key bigint, around bigint, n int, lead int, size int, suffix binary, before binary")


def _occurrences(texts: DataFrame, least: int, known: Bits) -> DataFrame:
    """(key, around, k1, k2, start): where repeated anchors' surroundings are; a text that a task repeats is told once."""
    shared = texts.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[tuple[int, int]] = set()
        for batch in batches:
            if len(done) >= HELD_KEYS:
                done = set()
            parts = []
            for t, k1, k2 in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if (k1, k2) in done:
                    continue
                done.add((k1, k2))
                for k, x in pieces(t.as_py(), least):
                    a = Anchors(x, least)
                    i = shared.value.has(a.key.view(np.uint64))
                    n = int(i.sum())
                    parts.append((a.key[i], a.around[i], np.full(n, k1), np.full(n, k2), a.start[i] + k))
            columns = [np.concatenate([*(p[j] for p in parts), np.zeros(0, np.int64)]) for j in range(5)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "around", "k1", "k2", "start"])

    return in_arrow(texts, run, "key bigint, around bigint, k1 bigint, k2 bigint, start bigint")


def _common(a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many leading bytes rows of a and b share, `most` at most."""
    differ = a != b
    return np.minimum(np.where(differ.any(1), differ.argmax(1), a.shape[1]), most)


def _matrix(values: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(v) for v in values])
    out = np.zeros((len(values), width), np.uint8)
    out[np.arange(width) < np.minimum(sizes, width)[:, None]] = np.frombuffer(b"".join(v[:width] for v in values), np.uint8)
    return out, sizes


def intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """(first, last, depth) of each interval of the common-prefix tree; lcp[i] is of entries i - 1 and i, -1 between groups."""
    stack = [(-1, 0)]
    for i in range(1, len(lcp) + 1):
        depth, left = (lcp[i] if i < len(lcp) else -1), i - 1
        while stack[-1][0] > depth:
            d, left = stack.pop()
            yield left, i - 1, d
        if depth > stack[-1][0]:
            stack.append((depth, left))


def shared_spans(suffix: list[bytes], before: list[bytes], group: np.ndarray, least: int) -> list[set[tuple[int, int]]]:
    """For entries sorted by (group, suffix): the ranges (least, most) of bytes before the anchor with which a
    string of `least` bytes starts that another entry of the group has too."""
    right, right_size = _matrix(suffix, least)
    left, left_size = _matrix(before, least - ANCHOR)
    lcp = np.full(len(suffix), -1)
    near = _common(right[1:], right[:-1], np.minimum(right_size[1:], right_size[:-1]))
    lcp[1:] = np.where(group[1:] == group[:-1], near, -1)
    out: list[set[tuple[int, int]]] = [set() for _ in suffix]
    rank = np.empty(len(before), np.int64)
    rank[np.array(sorted(range(len(before)), key=before.__getitem__), np.int64)] = np.arange(len(before))
    for first, last, depth in intervals(lcp.tolist()):
        need = least - depth  # bytes before the anchor that must be shared
        if need > least - ANCHOR:
            continue
        members = np.arange(first, last + 1)
        members = members[np.argsort(rank[members])]
        # Left extensions: neighbours in this order share most; a member's best partner is one of its two.
        same = _common(left[members[1:]], left[members[:-1]], np.minimum(left_size[members[1:]], left_size[members[:-1]]))
        best = np.maximum(np.append(same, -1), np.insert(same, 0, -1))
        for i in np.flatnonzero(best >= need).tolist():
            out[int(members[i])].add((max(0, need), int(best[i])))
    return out


def maximal_groups(suffix: list[bytes], before: list[bytes], group: np.ndarray, least: int) -> Iterator[tuple[list[int], int, int]]:
    """(members, left, right) of each maximal repeat of entries sorted by (group, suffix): the entries that share `left` bytes before the anchor and `right` from it
    on, `least` or more together, no byte of which could be added on either side for all of them.

    The interval tree gives the sets that share what follows; inside each, a second scan over what precedes gives those that share
    it too, and a set whose members all go on alike to the right belongs to a deeper interval.
    """
    right, right_size = _matrix(suffix, max(map(len, suffix), default=1))
    left, left_size = _matrix(before, max([*map(len, before), 1]))
    lcp = np.full(len(suffix), -1)
    near = _common(right[1:], right[:-1], np.minimum(right_size[1:], right_size[:-1]))
    lcp[1:] = np.where(group[1:] == group[:-1], near, -1)
    rank = np.empty(len(before), np.int64)
    rank[np.array(sorted(range(len(before)), key=before.__getitem__), np.int64)] = np.arange(len(before))
    for first, last, depth in intervals(lcp.tolist()):
        members = np.arange(first, last + 1)
        members = members[np.argsort(rank[members])]
        same = _common(left[members[1:]], left[members[:-1]], np.minimum(left_size[members[1:]], left_size[members[:-1]]))
        for f, k, lead in intervals([-1, *same.tolist()]):
            some = members[f : k + 1]
            if lead + depth >= least and lcp[int(some.min()) + 1 : int(some.max()) + 1].min() == depth:
                yield sorted(some.tolist()), lead, depth
        if depth >= least and len(same) and not same.min():  # also those that share nothing before the anchor
            yield sorted(members.tolist()), 0, depth


def _settled(rows: DataFrame, least: int) -> DataFrame:
    """(key, around, spans): the parts of each surrounding that are repeated, as (from, to) within it."""
    fields = T.StructType.fromDDL("key bigint, around bigint, spans array<struct<from:int,to:int>>")
    span = pa.struct([("from", pa.int32()), ("to", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if len(held) >= 20_000 and row[0] != held[-1][0]:
                    yield solve(held)
                    held = []
                if held and held[-1][:2] == row[:2]:  # the same surrounding from another batch
                    held[-1] = (*row[:2], held[-1][2] + row[2], *row[3:])
                else:
                    held.append(row)
        if held:
            yield solve(held)

    def solve(held: list[tuple]) -> pa.RecordBatch:
        key, around, n, lead, size, suffix, before = zip(*held, strict=True)
        found = shared_spans(list(suffix), list(before), np.array(key), least)
        keep, spans = [], []
        for i, ranges in enumerate(found):
            if n[i] > 1:
                keep.append(i)
                spans.append([(0, size[i])])
            elif ranges:
                r = np.array([*ranges])
                hi = np.minimum(r[:, 1], lead[i])
                ok = hi >= r[:, 0]
                if ok.any():
                    keep.append(i)
                    spans.append(_merged(lead[i] - hi[ok], lead[i] - r[ok, 0] + least))
        rows = [[{"from": a, "to": b} for a, b in x] for x in spans]
        return pa.RecordBatch.from_arrays([pa.array([key[i] for i in keep], pa.int64()), pa.array([around[i] for i in keep], pa.int64()), pa.array(rows, pa.list_(span))], names=["key", "around", "spans"])

    sorted_rows = rows.repartition("key").sortWithinPartitions("key", "suffix", "around")
    return in_arrow(sorted_rows, run, fields)


def _settled_hot(rows: DataFrame, least: int) -> DataFrame:
    """As _settled, for anchors with very many surroundings: every window of each different one is counted by its hash."""
    fields = T.StructType.fromDDL("key bigint, around bigint, n bigint, size int, offset int, window bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for key, around, n, lead, size, suffix, before in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x = np.frombuffer(before[::-1] + suffix, np.uint8)
                up, down = powers(len(x) + 1)
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((x.astype(np.uint64) + np.uint64(1)) * up[: len(x)], dtype=np.uint64)])
                at = np.arange(size - least + 1)
                w = mixed(mixed((sums[at + least] - sums[at]) * down[at])).view(np.int64)
                parts.append([np.full(len(at), v) for v in (key, around, n, size)] + [at, w])
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
            columns = [np.concatenate([p[j] for p in parts]) if parts else np.zeros(0, np.int64) for j in range(6)]
            yield pa.RecordBatch.from_arrays([pa.array(c).cast(k) for c, k in zip(columns, kinds, strict=True)], names=fields.names)

    whole = rows.groupBy("key", "around").agg(F.sum("n").alias("n"), *(F.first(c).alias(c) for c in ("lead", "size", "suffix", "before")))
    windows = in_arrow(whole, run, fields)
    again = windows.groupBy("window").agg(F.sum("n").alias("times")).where("times > 1").select("window")
    hit = windows.join(again, "window", "left_semi").groupBy("key", "around").agg(F.array_sort(F.collect_list("offset")).alias("at"))
    return hit.select("key", "around", F.transform("at", lambda o: F.struct(o.alias("from"), (o + least).alias("to"))).alias("spans"))


def repeat_groups(docs: DataFrame, text_col: str = "text", least: int = LEAST) -> DataFrame:
    """(repeat, length, k1, k2, start): every maximal repeat of `least` bytes or more with all its occurrences, in texts by their key (see text_key).

    A repeat is named by a hash of its bytes. Each anchor's repeats reach as far as strings of `least` bytes around the anchor do; a longer passage
    appears as one repeat for each of its anchors. The surroundings of one anchor are sorted in one task.
    """
    texts = _texts(docs, text_col)
    keys = cut(_counted(texts, least).groupBy("key").agg(F.sum("n").alias("n")).where("n > 1"))
    known = Bits.build(keys, "key", Bits.width(keys.count(), CAP_BITS))
    rows = _surroundings(texts, least, known).groupBy("key", "around").agg(F.sum("n").alias("n"), *[F.first(c).alias(c) for c in ("lead", "size", "suffix", "before")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if len(held) >= 20_000 and row[0] != held[-1][0]:
                    yield from solve(held)
                    held = []
                held.append(row)
        if held:
            yield from solve(held)

    def solve(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        key, around, n, lead, size, suffix, before = zip(*held, strict=True)
        out: list[tuple] = []
        name = lambda b: int.from_bytes(hashlib.blake2b(b, digest_size=8).digest(), "little", signed=True)
        for members, left, right in maximal_groups(list(suffix), list(before), np.array(key), least):
            i = members[0]
            repeat = name(before[i][:left][::-1] + suffix[i][:right])
            out += [(key[i], around[m], repeat, left + right, lead[m] - left) for m in members]
            if len(out) >= HELD_KEYS:
                yield pack(out)
                out = []
        out += [(key[i], around[i], name(before[i][::-1] + suffix[i]), size[i], 0) for i in range(len(held)) if n[i] > 1]
        yield pack(out)

    def pack(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["key", "around", "repeat", "length", "offset"])

    found = in_arrow(rows.repartition("key").sortWithinPartitions("key", "suffix", "around"), run, "key bigint, around bigint, repeat bigint, length bigint, offset bigint")
    spots = _occurrences(texts, least, known).join(cut(found.distinct()), ["key", "around"])
    return spots.select("repeat", "length", "k1", "k2", (F.col("start") + F.col("offset")).alias("start")).distinct()


def repeated_spans(docs: DataFrame, text_col: str = "text", least: int = LEAST, hot: int = HOT) -> DataFrame:
    """(k1, k2, spans): for each different text with a repeat, the byte ranges (from, to) to remove, unmerged."""
    texts = _texts(docs, text_col)
    keys = cut(_counted(texts, least).groupBy("key").agg(F.sum("n").alias("n"), F.count("*").alias("batches")).where("n > 1"))
    known = Bits.build(keys, "key", Bits.width(keys.count(), CAP_BITS))
    rows = _surroundings(texts, least, known)
    often = cut(keys.where(F.col("n") > hot).select("key"))  # so many that they are at most all anchors / hot
    if often.isEmpty():
        settled = _settled(rows, least)
    else:
        side = small_side(often, often.count())
        settled = _settled(rows.join(side, "key", "left_anti"), least).union(_settled_hot(rows.join(side, "key", "left_semi"), least))
    settled = cut(settled)
    found = _occurrences(texts, least, known).join(settled, ["key", "around"])
    at = F.transform("spans", lambda s: F.struct((F.col("start") + s["from"]).alias("from"), (F.col("start") + s["to"]).alias("to")))
    return found.select("k1", "k2", F.explode(at).alias("s")).groupBy("k1", "k2").agg(F.collect_set("s").alias("spans"))


def remove_repeats(docs: DataFrame, text_col: str = "text", least: int = LEAST, keep_bytes: bool = True, hot: int = HOT) -> DataFrame:
    """(_row, cut): each row of docs without its text, with n_bytes, n_removed, n_spans, kept_sha256, spans and,
    if keep_bytes, the remaining bytes."""
    found = cut(repeated_spans(docs, text_col, least, hot))
    k1, k2 = text_key(docs[text_col])
    packed = docs.select(docs[text_col].alias("_t"), k1.alias("k1"), k2.alias("k2"), F.struct(*[docs[c] for c in docs.columns if c != text_col]).alias("_row"))
    size = found.agg(F.coalesce(F.sum(F.size("spans")), F.lit(0)).alias("n")).first().n  # bounds the bytes as well as the rows
    joined = looked_up(packed, found, ["k1", "k2"], most=BROADCAST_ROWS if size <= BROADCAST_ROWS else -1).select("_t", "spans", "_row")
    ddl = "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<from:bigint,to:bigint>>" + ", kept binary" * keep_bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("from", pa.int64()), ("to", pa.int64())])
        kinds = [("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(span))] + [("kept", pa.binary())] * keep_bytes
        for batch in batches:
            out = []
            for t, s in zip(batch.column(0), batch.column(1), strict=True):
                raw = (t.as_py() or "").encode("utf-8", "surrogatepass")
                at = np.array([(x["from"], x["to"]) for x in s.as_py() or []], np.int64).reshape(-1, 2)
                spans = _merged(at[:, 0], at[:, 1])
                h, rest, k = hashlib.sha256(), [], 0
                for a, b in [*spans, (len(raw), len(raw))]:
                    h.update(raw[k:a])
                    if keep_bytes:
                        rest.append(raw[k:a])
                    k = b
                row = [len(raw), sum(b - a for a, b in spans), len(spans), h.hexdigest(), [{"from": a, "to": b} for a, b in spans]]
                out.append(row + [b"".join(rest)] * keep_bytes)
            struct = pa.StructArray.from_arrays([pa.array([r[j] for r in out], k) for j, (_, k) in enumerate(kinds)], [n for n, _ in kinds])
            yield pa.RecordBatch.from_arrays([batch.column(2), struct], names=["_row", "cut"])

    return in_arrow(joined, run, joined.select("_row").schema.add("cut", T.StructType.fromDDL(ddl)))
