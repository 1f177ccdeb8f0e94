"""BPE encoding and decoding with a segment tree over the ranks of adjacent pairs.

A word starts as its characters. A segment tree over the ranks of its adjacent pairs has the
leftmost pair of lowest rank at the root; merging it changes at most two pairs, and each change
updates one path of the tree. That goes on until the root says that no pair can be merged.

The trees of all different words of a batch are rows of numpy arrays and take their steps together,
so a task needs a few array operations for each step, not for each word. Words of like length share
a tree width. A word of more than LONG bytes is first cut between bytes that no token of the vocabulary has
side by side, where no merge can ever happen; what can't be cut has a tree of its own and costs n log n
steps and some 40 bytes of memory a byte, so only an endless run of bytes that all belong together
(a hundred megabytes of one letter, say) needs much of a worker.

Ids and decoded text are those of the public `tokenizers` library for a vocabulary file of this kind:
NFC, white space, lower case, a split by pattern, byte symbols and an end-of-word mark.

Defined cases: a null or empty text has no ids and decodes to an empty text; lone characters,
marks and any bytes of UTF-8 have symbols, so nothing is unknown; the strings of special tokens
in a text are those tokens; repeated rows give equal results; other columns aren't touched.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_arrow

#: Characters of text whose words are encoded together; a longer text is a group of its own.
GROUP_CHARS = 1 << 19
#: Leaves of all trees of one step at most.
TREE_CELLS = 1 << 17
#: Bytes of ids and text in a batch that goes out, about.
OUT_BYTES = 2 << 20
#: Words that a task keeps between groups, at most.
KNOWN = 100_000
#: Bytes of a word beyond which it is cut where no merge can happen.
LONG = 4096
NONE = np.int64(1) << 62


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where it is printable, else the next free one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in shown}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(shown))
    return [out[b] for b in range(256)]


class Vocabulary:
    """A vocabulary file, read once on the driver and broadcast: bounded by the file's size."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        suffix = model["end_of_word_suffix"]
        ids: dict[str, int] = model["vocab"]
        self.tokens = {i: t for t, i in ids.items()} | {a["id"]: a["content"] for a in spec["added_tokens"]}
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        symbols = byte_symbols()
        self.inner = np.array([ids[c] for c in symbols], np.int64)
        self.last = np.array([ids[c + suffix] for c in symbols], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        key = np.array([ids[a] << 20 | ids[b] for a, b in pairs], np.int64)
        made = np.array([ids[a + b] for a, b in pairs], np.int64)
        self._index(key, made)
        byte = {c: b for b, c in enumerate(symbols)}
        self.together = np.zeros((256, 256), bool)  # [a, b]: some token has byte b right after byte a
        for t in ids:
            x = [byte[c] for c in t.removesuffix(suffix) if c in byte]
            self.together[x[:-1], x[1:]] = True

    def _index(self, key: np.ndarray, made: np.ndarray) -> None:
        """An open hash table from pair to rank and merged id; nine slots in ten stay free."""
        self.shift = np.uint64(64 - int(np.ceil(np.log2(max(8, 10 * len(key))))))
        size = 1 << (64 - int(self.shift))
        self.keys, self.values = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        todo = np.arange(len(key))[::-1]
        value = np.arange(len(key), dtype=np.int64) << 20 | made
        step = 0
        while len(todo):
            at = (self._slot(key[todo]) + step) % size
            free = self.keys[at] < 0
            self.keys[at[free]], self.values[at[free]] = key[todo[free]], value[todo[free]]
            todo = todo[self.keys[at] != key[todo]]
            step += 1
        self.probes = step

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """rank << 20 | merged id of each pair, -1 where it is no merge."""
        key = (left << 20 | right).ravel()
        at = self._slot(key)
        out = np.where(self.keys[at] == key, self.values[at], -1)
        todo = np.flatnonzero((self.keys[at] != key) & (self.keys[at] >= 0))
        for step in range(1, self.probes):
            if not len(todo):
                break
            at = (self._slot(key[todo]) + step) % len(self.keys)
            same = self.keys[at] == key[todo]
            out[todo[same]] = self.values[at[same]]
            todo = todo[~same & (self.keys[at] >= 0)]
        return out.reshape(left.shape)


def merge_all(v: Vocabulary, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of many words after all merges. ids: one word a row, `sizes` of its cells used, width a power of two.

    A tree's node holds rank << 32 | position of the best pair below it, so the smaller value is the
    lower rank and, among equal ranks, the one further left.
    """
    n, width = ids.shape
    rows = np.arange(n)
    tree = np.full((n, 2 * width), NONE, np.int64)
    made = np.zeros((n, width), np.int32)
    after = np.tile(np.arange(1, width + 1, dtype=np.int32), (n, 1))  # of each live position, the next one
    before = np.tile(np.arange(-1, width - 1, dtype=np.int32), (n, 1))
    live = np.arange(width) < sizes[:, None]
    if width > 1:
        found = v.ranks(ids[:, :-1], ids[:, 1:])
        good = (found >= 0) & live[:, 1:]
        tree[:, width : 2 * width - 1] = np.where(good, found >> 20 << 32 | np.arange(width - 1), NONE)
        made[:, :-1] = found & 0xFFFFF
    level = width
    while level > 1:
        tree[:, level >> 1 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
        level >>= 1

    flat, flat_ids, flat_made = tree.reshape(-1), ids.reshape(-1), made.reshape(-1)
    r = rows
    while len(r := r[tree[r, 1] < NONE]):
        p = tree[r, 1] & 0xFFFFFFFF
        q = after[r, p]  # joins p and goes
        flat_ids[r * width + p] = flat_made[r * width + p]
        live[r, q] = False
        after[r, p] = nxt = after[r, q]
        prev = before[r, p]
        has, had = np.flatnonzero(nxt < sizes[r]), np.flatnonzero(prev >= 0)
        before[r[has], nxt[has]] = p[has]
        # The pairs (p, next) and (previous, p) are new, q is no longer the start of one.
        row = np.concatenate([r[has], r[had]])
        left, right = np.concatenate([p[has], prev[had]]), np.concatenate([nxt[has], p[had]])
        found = v.ranks(flat_ids[row * width + left], flat_ids[row * width + right])
        flat_made[row * width + left] = found & 0xFFFFF
        base = 2 * width
        flat[np.concatenate([r * base + q, r * base + p]) + width] = NONE
        flat[row * base + left + width] = np.where(found >= 0, found >> 20 << 32 | left, NONE)
        top = np.concatenate([r, r, r[had]]) * base
        node = np.concatenate([q, p, prev[had]]) + width
        for _ in range(width.bit_length() - 1):  # the paths of all changed leaves, level by level
            node >>= 1
            down = top + 2 * node
            flat[top + node] = np.minimum(flat[down], flat[down + 1])
    return ids, live


def apart(v: Vocabulary, raw: bytes) -> list[bytes]:
    """A long word in parts of about LONG bytes or more, cut where no merge can happen."""
    x = np.frombuffer(raw, np.uint8)
    spots = np.flatnonzero(~v.together[x[:-1], x[1:]]) + 1
    ends, start = [], 0
    while len(raw) - start > LONG and (k := int(np.searchsorted(spots, start + LONG))) < len(spots):
        start = int(spots[k])
        ends.append(start)
    return [raw[a:b] for a, b in zip([0, *ends], [*ends, len(raw)], strict=True)]


def encode_words(v: Vocabulary, words: list[str]) -> list[tuple[bytes, str, int]]:
    """Of each word: its ids as little-endian 32-bit integers, its decoded text, how many ids."""
    raw = [w.encode("utf-8", "surrogatepass") for w in words]
    long = [i for i, b in enumerate(raw) if len(b) > LONG]
    if not long:
        return _encode_parts(v, raw, np.ones(len(raw), bool))
    parts = [apart(v, b) if len(b) > LONG else [b] for b in raw]
    counts = np.array([len(p) for p in parts])
    ends = np.cumsum(counts)
    final = np.zeros(int(ends[-1]), bool)
    final[ends - 1] = True
    found = _encode_parts(v, [b for p in parts for b in p], final)
    joined = (found[e - n : e] for n, e in zip(counts.tolist(), ends.tolist(), strict=True))
    return [x[0] if len(x) == 1 else (b"".join(y[0] for y in x), " ".join(y[1] for y in x), sum(y[2] for y in x)) for x in joined]


def _encode_parts(v: Vocabulary, raw: list[bytes], final: np.ndarray) -> list[tuple[bytes, str, int]]:
    """As encode_words, for parts of words; final: which of them end a word."""
    sizes = np.array([len(b) for b in raw])
    out: list = [(b"", "", 0)] * len(raw)
    widths = 1 << np.ceil(np.log2(np.maximum(sizes, 1))).astype(int)
    for width in np.unique(widths).tolist():
        group = np.flatnonzero(widths == width)
        for k in range(0, len(group), step := max(1, TREE_CELLS // width)):
            part = group[k : k + step]
            n = sizes[part]
            cells = np.zeros((len(part), width), np.uint8)
            cells[np.arange(width) < n[:, None]] = np.frombuffer(b"".join(raw[i] for i in part), np.uint8)
            ids = v.inner[cells]
            ends_word = np.flatnonzero(final[part])
            ids[ends_word, n[ends_word] - 1] = v.last[cells[ends_word, n[ends_word] - 1]]
            ids, live = merge_all(v, ids, n)
            flat, ends = ids[live].astype("<u4"), np.cumsum(live.sum(1)).tolist()
            data, tokens, a = flat.tobytes(), [v.tokens[i] for i in flat.tolist()], 0
            for i, b in zip(part.tolist(), ends, strict=True):
                out[i] = data[4 * a : 4 * b], " ".join(tokens[a:b]), b - a
                a = b
    return out


def lowered(text: str) -> str:
    """Lower case character by character, as the library has it: a final sigma is not special."""
    return text.lower() if "Σ" not in text else "".join(c.lower() for c in text)


class Codec:
    """Splits texts into words and puts ids and decoded text together; made once for each task."""

    def __init__(self, v: Vocabulary):
        self.v = v
        # The pattern's alternatives never take white space, so a space may stand for each run of it.
        self.word = regex.compile(v.pattern)
        self.plain = re.compile(v.pattern.replace("\\p{L}", "a-z").replace("\\p{N}", "0-9"), re.ASCII)  # for ASCII in lower case
        self.known = self._special()
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(v.special, key=len, reverse=True))) + ")")

    def words(self, text: str) -> list[str]:
        """The words of a text; special tokens stand between them as they are."""
        out: list[str] = []
        for part in self.cut.split(text) if "<|" in text else (text,):
            if part in self.v.special:
                out.append(part)
            elif part.isascii():
                out += self.plain.findall(part.lower())
            else:
                part = part if unicodedata.is_normalized("NFC", part) else unicodedata.normalize("NFC", part)
                out += self.word.findall(lowered(part))
        return out

    def learn(self, words: set[str]) -> None:
        """Encodes the words that aren't known yet; what is known stays below KNOWN words between groups."""
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > KNOWN:
            self.known, new = self._special(), [w for w in words if w not in self.v.special]
        self.known.update(zip(new, encode_words(self.v, new), strict=True))

    def _special(self) -> dict[str, tuple[bytes, str, int]]:
        return {s: (np.uint32(i).astype("<u4").tobytes(), s, 1) for s, i in self.v.special.items()}

    def groups(self, texts: Iterable[str | None]) -> Iterator[tuple[list[str], dict]]:
        """The words of each text, and what is known of all the words of its group."""
        held: list[list[str]] = []
        seen: set[str] = set()
        size = 0
        for text in texts:
            held.append(self.words(text or ""))
            seen.update(held[-1])
            size += len(text or "")
            if size >= GROUP_CHARS:
                self.learn(seen)
                yield from ((x, self.known) for x in held)
                held, seen, size = [], set(), 0
        self.learn(seen)
        yield from ((x, self.known) for x in held)


def _run(docs: DataFrame, text_col: str, vocabulary: str, fields: dict[str, tuple[str, pa.DataType]], make, size) -> DataFrame:
    """docs without the text, with a struct column `bpe` that make(words, known) gives; size(row) is about its bytes."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(vocabulary))
    packed = docs.select(docs[text_col].alias("_text"), F.struct(*[docs[c] for c in docs.columns if c != text_col]).alias("_row"))
    kinds = [kind for _, kind in fields.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value)
        for batch in batches:
            made, held, start = [], 0, 0
            for i, (words, known) in enumerate(codec.groups(x.as_py() for x in batch.column(0)), 1):
                made.append(make(words, known))
                held += size(made[-1])
                if held >= OUT_BYTES or i == batch.num_rows:  # small batches out: ids and texts are larger than what came in
                    struct = pa.StructArray.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*made, strict=True), kinds, strict=True)], list(fields))
                    yield pa.RecordBatch.from_arrays([batch.column(1).slice(start, len(made)), struct], names=["_row", "bpe"])
                    made, held, start = [], 0, i

    ddl = ", ".join(f"{name} {kind}" for name, (kind, _) in fields.items())
    return in_arrow(packed, run, packed.select("_row").schema.add("bpe", T.StructType.fromDDL(ddl)))


def encode(docs: DataFrame, vocabulary: str, text_col: str = "text") -> DataFrame:
    """(_row, bpe): each row of docs without its text, with n_tokens, ids array<int> and the decoded text."""

    def make(words: list[str], known: dict) -> tuple:
        found = [known[w] for w in words]
        ids = np.frombuffer(b"".join([x[0] for x in found]), "<u4")
        return len(ids), ids.astype(np.int32), " ".join([x[1] for x in found])

    fields = {"n_tokens": ("bigint", pa.int64()), "ids": ("array<int>", pa.list_(pa.int32())), "decoded": ("string", pa.string())}
    return _run(docs, text_col, vocabulary, fields, make, lambda row: 4 * row[0] + len(row[2]))


def digests(docs: DataFrame, vocabulary: str, text_col: str = "text") -> DataFrame:
    """(_row, bpe): each row of docs without its text, with n_tokens and the SHA-256 of ids and of decoded text."""

    def make(words: list[str], known: dict) -> tuple:
        found = [known[w] for w in words]
        ids = b"".join([x[0] for x in found])
        text = " ".join([x[1] for x in found])
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()

    fields = {"n_tokens": ("bigint", pa.int64()), "ids_sha256": ("string", pa.string()), "decoded_sha256": ("string", pa.string())}
    return _run(docs, text_col, vocabulary, fields, make, lambda row: 300)


def decode(rows: DataFrame, vocabulary: str, ids_col: str = "ids") -> DataFrame:
    """rows as they are, with `decoded`: the tokens of an id list joined by spaces; null ids decode to an empty text.

    The vocabulary is a table, and the lookup one expression for each id.
    """
    v = Vocabulary(vocabulary)
    tokens = [v.tokens.get(i, "") for i in range(max(v.tokens) + 1)]
    shared = rows.sparkSession.sparkContext.broadcast(tokens)

    @F.pandas_udf("string")
    def joined(ids):  # noqa: ANN001, ANN202
        return ids.map(lambda x: " ".join([shared.value[i] for i in x]) if x is not None else "")

    return rows.withColumn("decoded", joined(F.col(ids_col)))
