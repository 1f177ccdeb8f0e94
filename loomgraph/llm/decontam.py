"""Benchmark decontamination with DataFrame functions only.

The hashes of all benchmark windows fill a filter of bounded size that is broadcast (common.Sieve: 64 MB hold four
million windows with one false hit in some hundred; more windows let more through). Every window of every document
is looked up in it where it is and never shuffled; only the few that hit are compared as words with the
benchmark's, then joined with the items they belong to. A document's result depends on its text alone, so rows with
equal texts share one decision, and a window that many items share is compared once for each text.

Words are runs of ASCII letters and digits and of all characters beyond ASCII, with A-Z in lower
case. A window is `n` consecutive words of an item; an item of fewer words is one window.

Defined cases: a null or empty text has no words and no hit; an item without words has no
window; a null item id hits words but is not listed; repeated rows get equal results; an empty
benchmark leaves every document clean; other columns are carried along unseen, whatever their names. The words of
one text are held in its row, with a row for each of its windows while it is looked at (some 100 bytes a word, as a stream).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Sieve, cut, looked_up, small_side, without

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words: ASCII that is neither a letter nor a digit.
GAP = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
WORD = "[0-9A-Za-z\\x{80}-\\x{10FFFF}]+"


def words(text: Column) -> Column:
    """The words of a text in their own case."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def text_key(text: Column) -> tuple[Column, Column]:
    """128 bits that stand for a text."""
    text = F.coalesce(text, F.lit(""))
    return F.xxhash64(text), F.xxhash64(F.lit(1), text)


def _windows(rows: DataFrame, lengths: list[int], n: int | None = None) -> DataFrame:
    """One row for each window of rows.w: keep, pos, len, joined (own case), key (of all in lower case)."""
    at = rows.select("keep", "w", F.posexplode("w").alias("pos", "_word"))
    if n:  # an item: windows of n words, or one of all its words
        size = F.least(F.size("w"), F.lit(n))
        at = at.where(F.col("pos") + size <= F.size("w")).withColumn("len", size)
    else:
        at = at.withColumn("len", F.lit(lengths[0]) if len(lengths) == 1 else F.explode(F.array(*map(F.lit, lengths))))
        at = at.where(F.col("pos") + F.col("len") <= F.size("w"))
    joined = F.array_join(F.slice("w", F.col("pos") + 1, F.col("len")), " ")
    return at.select("keep", "pos", "len", joined.alias("joined"), F.xxhash64(F.lower(joined)).alias("key"))


def _folded(joined: str) -> Column:
    return F.translate(F.col(joined), UPPER, LOWER)


def benchmark_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", n: int = 10) -> DataFrame:
    """(item, len, key, folded), without repeats."""
    rows = benchmark.select(benchmark[id_col].alias("keep"), words(benchmark[text_col]).alias("w"))
    return _windows(rows, [], n).select(F.col("keep").alias("item"), "len", "key", _folded("joined").alias("folded")).distinct()


def find(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", id_col: str = "item_id", item_text: str = "text", n: int = 10) -> DataFrame:
    """A row for each distinct text with a hit: k1, k2 (see text_key), n_hit, items (sorted as strings), spans.

    spans are (first word, words) in order, neither touching nor overlapping; all words of a
    document are looked at, and a word counts as hit inside any occurrence of any window.
    """
    known = cut(benchmark_windows(benchmark, id_col, item_text, n))
    lengths = sorted(r[0] for r in known.select("len").distinct().collect()) or [n]  # n values at most
    count = known.count()
    k1, k2 = text_key(docs[text_col])
    rows = docs.select(F.struct(k1.alias("k1"), k2.alias("k2")).alias("keep"), words(docs[text_col]).alias("w"))
    maybe = Sieve(known, "key", count).passed(_windows(rows, lengths), F.col("key"))
    # Equal texts give equal rows: they meet here, already reduced on the side that reads them.
    maybe = maybe.select("keep.k1", "keep.k2", "pos", "len", _folded("joined").alias("folded")).distinct()
    hits = cut(maybe.join(small_side(known.select("folded").distinct(), count), "folded", "left_semi"))
    spans = hits.groupBy("k1", "k2").agg(F.array_sort(F.collect_set(F.struct("pos", "len"))).alias("at"))
    merged = F.aggregate(
        "at",
        F.array().cast("array<struct<pos:int,len:int>>"),
        lambda out, x: F.when(
            (F.size(out) > 0) & (F.element_at(out, -1)["pos"] + F.element_at(out, -1)["len"] >= x["pos"]),
            F.concat(
                F.slice(out, 1, F.size(out) - 1),
                F.array(
                    F.struct(
                        F.element_at(out, -1)["pos"].alias("pos"),
                        (F.greatest(F.element_at(out, -1)["pos"] + F.element_at(out, -1)["len"], x["pos"] + x["len"]) - F.element_at(out, -1)["pos"]).alias("len"),
                    )
                ),
            ),
        ).otherwise(F.concat(out, F.array(x))),
    )
    spans = spans.select("k1", "k2", merged.alias("spans"))
    items = hits.select("k1", "k2", "folded").distinct().join(small_side(known.select("item", "folded"), count), "folded")
    items = items.groupBy("k1", "k2").agg(F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["len"])
    return cut(spans.join(items, ["k1", "k2"]).select("k1", "k2", hit.alias("n_hit"), "items", "spans"))


def _packed(docs: DataFrame, text_col: str) -> DataFrame:
    """docs as one column `_row`, with the key of its text."""
    k1, k2 = text_key(docs[text_col])
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), docs[text_col].alias("_text"), k1.alias("k1"), k2.alias("k2"))


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 10) -> DataFrame:
    """A row for each row of docs: id, n_words, n_hit, n_items, items, spans, contaminated."""
    found = find(docs, benchmark, text_col, n=n)
    k1, k2 = text_key(docs[text_col])
    narrow = docs.select(docs[id_col].alias(id_col), F.size(words(docs[text_col])).cast("long").alias("n_words"), k1.alias("k1"), k2.alias("k2"))
    count = found.count()
    if count > BROADCAST_ROWS:
        narrow = cut(narrow)  # the shuffle below moves ids and counts only
    out = narrow.join(small_side(found, count), ["k1", "k2"], "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    items = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(id_col, "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), items.alias("items"), "spans", (n_hit > 0).alias("contaminated"))


def drop_documents(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", n: int = 10) -> DataFrame:
    """docs without the rows in which a benchmark window occurs."""
    found = find(docs, benchmark, text_col, n=n)
    return without(_packed(docs, text_col).drop("_text"), found, ["k1", "k2"]).select("_row.*")


def drop_spans(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", n: int = 10) -> DataFrame:
    """docs with the words of every occurrence taken out of the text; what separates words stays."""
    found = find(docs, benchmark, text_col, n=n)
    out = looked_up(_packed(docs, text_col), found.select("k1", "k2", "spans"), ["k1", "k2"])
    parts = F.regexp_extract_all("_text", F.lit(f"({WORD}|{GAP})"))
    # Words and gaps alternate, so the part's number gives the word's number.
    first = F.when(F.col("_text").rlike(f"\\A{WORD}"), 0).otherwise(1)
    inside = lambda i: ((i - F.col("_first")) % 2 == 0) & F.exists("spans", lambda s: ((i - F.col("_first")) / 2 >= s["pos"]) & ((i - F.col("_first")) / 2 < s["pos"] + s["len"]))
    kept = F.array_join(F.filter("_parts", lambda p, i: ~inside(i)), "")
    out = out.withColumn("_first", first).withColumn("_parts", F.when(F.col("spans").isNotNull(), parts))
    text = F.when(F.col("spans").isNull(), F.col("_text")).otherwise(kept)
    return out.select(F.col("_row").withField(text_col, text).alias("_row")).select("_row.*")
