"""Language identification by multilingual mixture inference.

A text is taken as a mixture: each of its character trigrams was drawn from one of the languages,
with the document's own proportions. Expectation maximisation estimates the proportions from the
trigram likelihoods; which languages take part is chosen by penalised likelihood, one language more
as long as the likelihood it gains outweighs the penalty. As the likelihood is concave in the
proportions, the gain of any further language is at most N log(1 + largest directional derivative), so
that most texts are settled as one language without any iteration, and exactly so.

The model is a table of a fixed number of hashed trigrams for each language, learned from a bounded
sample of labelled rows (`per_language`), counted on the executors, and broadcast: at most
BUCKETS x languages numbers, whatever the input.

Defined cases: a null text or one without a letter is `und` with score 0 and no languages; rows with
a null language or id are never learned from; without any labelled text everything is `und`; texts of any
length are walked in pieces of bounded size; repeated rows get equal results; other columns are
carried along unseen, whatever their names.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import STEP, in_arrow, mixed, points, sample_by_label

BUCKETS = 1 << 16
#: Texts of each language to learn from, about.
PER_LANGUAGE = 3000
#: Log-likelihood that one language more must gain for each trigram beyond BIC's half log N: neighbouring
#: trigrams overlap, so they are not independent draws.
PENALTY = 12.0
SMOOTH = 0.5


@cache
def kinds() -> np.ndarray:
    """For each code point: 2 for a letter, 1 for a mark, else 0; made once in each worker."""
    return np.array([{"L": 2, "M": 1}.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)], np.uint8)


def has_letter(text: str | None) -> bool:
    """Whether there is a Unicode letter in the text."""
    return bool(text) and any((kinds()[points(text[k : k + STEP])] == 2).any() for k in range(0, len(text), STEP))


def grams(text: str) -> Iterator[np.ndarray]:
    """The hashed trigrams of a text in pieces: letters in lower case, everything else as one space."""
    last = np.array([32], np.uint32)  # what goes before the piece: no trigram is lost between pieces
    for k in range(0, len(text), STEP):
        p = points(text[k : k + STEP].lower())
        word = kinds()[p] > 0
        p = np.where(word, p, np.uint32(32))
        keep = word.copy()  # of a run of others, the first one stays, also where the run begins with the piece
        keep[1:] |= word[:-1]
        keep[0] |= last[-1] != 32
        p = np.concatenate([last, p[keep], np.array([32] * (k + STEP >= len(text)), np.uint32)])
        last = p[-2:]
        if len(p) >= 3:
            h = p[:-2].astype(np.uint64) << np.uint64(42)
            h |= p[1:-1].astype(np.uint64) << np.uint64(21)
            h |= p[2:].astype(np.uint64)
            yield (mixed(h) >> np.uint64(48)).astype(np.int64)


class Model:
    """languages; p[bucket, language]: the probability of the bucket in the language."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        total = counts + SMOOTH
        self.p = (total / total.sum(0)).astype(np.float32)
        self.log_p = np.log(self.p)

    def mixture(self, text: str | None) -> list[tuple[str, float]]:
        """The languages of a text with their shares, largest first; none if it has no letter."""
        if not self.languages or not has_letter(text):
            return []
        pieces = grams(text)
        if len(text) <= STEP:  # the usual case needs no table of counts
            seen = np.concatenate([*pieces])
            weight, n = np.ones(len(seen), np.float32), len(seen)
        else:
            counts, n = np.zeros(BUCKETS, np.int64), 0
            for g in pieces:
                counts += np.bincount(g, minlength=BUCKETS)
                n += len(g)
            seen = np.flatnonzero(counts)
            weight = counts[seen].astype(np.float32)
        alone = weight @ self.log_p[seen]
        chosen = [int(np.argmax(alone))]
        if len(self.languages) == 1:
            return [(self.languages[0], 1.0)]
        p = self.p[seen]
        fit, shares, price = float(alone[chosen[0]]), np.ones(1), PENALTY + 0.5 * np.log(n)
        while len(chosen) < len(self.languages):
            mix = p[:, chosen] @ shares.astype(np.float32)
            slope = (weight / mix) @ p / n  # 1 + directional derivative toward each language
            slope[chosen] = 0
            k = int(np.argmax(slope))
            if n * np.log(max(slope[k], 1.0)) <= price:  # no language can gain more than this
                break
            new, new_fit = self._em(p[:, [*chosen, k]], weight, n, np.append(shares * 0.9, 0.1))
            if new_fit - fit <= price:
                break
            chosen, shares, fit = [*chosen, k], new, new_fit
        order = np.lexsort((chosen, -shares))
        return [(self.languages[chosen[i]], float(min(1.0, shares[i]))) for i in order]

    @staticmethod
    def _em(p: np.ndarray, weight: np.ndarray, n: int, shares: np.ndarray, rounds: int = 40) -> tuple[np.ndarray, float]:
        before = -np.inf
        for _ in range(rounds):
            mix = p @ shares.astype(np.float32)
            fit = float(weight @ np.log(mix))
            if fit - before < 1e-3:
                break
            before = fit
            shares = shares * ((weight / mix) @ p) / n
            shares = shares / shares.sum()
        return shares, fit


def fit(labelled: DataFrame, label: str = "lang", text_col: str = "text", per_language: int = PER_LANGUAGE) -> Model:
    """labelled: rows to learn from, with doc_id. Counts are added up on the executors; the table comes to the driver."""
    rows = sample_by_label(labelled, label, per_language).select(F.col(label).alias("l"), F.col(text_col).alias("t"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if has_letter(text := text.as_py()):
                    for g in grams(text):
                        sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                        sums[lang] += np.bincount(g, minlength=BUCKETS)
        for lang, c in sums.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_pydict({"l": pa.array([lang] * len(at)), "g": pa.array(at.astype(np.int32)), "n": pa.array(c[at])})

    found = in_arrow(rows, count, "l string, g int, n bigint").groupBy("l", "g").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(found["l"].unique().tolist())
    table = np.zeros((BUCKETS, len(languages)))
    table[found["g"].to_numpy(np.int64), found["l"].map({x: i for i, x in enumerate(languages)}).to_numpy(np.int64)] = found["n"]
    return Model(languages, table)


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """(_row, found): each row of docs, with lang, score and all its languages with their shares."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    packed = docs.select(docs[text_col].alias("_text"), F.struct(*[docs[c] for c in docs.columns if c != text_col]).alias("_row"))
    ddl = "lang string, score double, languages array<string>, shares array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.float64())]
        for batch in batches:
            out = [shared.value.mixture(t.as_py()) for t in batch.column(0)]
            columns = [[x[0][0] if x else "und" for x in out], [x[0][1] if x else 0.0 for x in out], [[y[0] for y in x] for x in out], [[y[1] for y in x] for x in out]]
            struct = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["lang", "score", "languages", "shares"])
            yield pa.RecordBatch.from_arrays([batch.column(1), struct], names=["_row", "found"])

    return in_arrow(packed, run, packed.select("_row").schema.add("found", T.StructType.fromDDL(ddl)))
