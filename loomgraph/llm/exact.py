"""Exact dedup: two-pass Bloom filtering, with DataFrame functions only.

Pass 1 finds the cells of a large hash table that two rows or more fall in: each partition counts its own rows by
cell, and one integer for each of its cells is shuffled, neither hashes nor texts. The marked cells fill a Bloom filter.
Pass 2 looks each row up in that filter: a row that misses is alone and passes straight through; only the others are
shuffled and grouped by the SHA-256 of their normalised text, so that a false hit never changes a result.

The filter is bounded (see common.Sieve): with more than some millions of repeated texts more rows than needed are shuffled as
hashes; results stay the same.

Defined cases: a null text counts as empty; empty texts equal each other; rows with the same text
and the same id are one document, all of them marked kept by `duplicates`, while
`drop_duplicates` leaves one row; a null id loses against any other on equal length; an empty
table gives an empty result; other columns are never looked at, whatever their names.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Sieve, cut, small_side

#: Cells of pass 1 for each row: one row in so many meets another one's cell by chance.
CELLS_PER_ROW = 32
#: Cells at most. It is no limit in practice and lets tests fill the table.
CAP_BITS = 1 << 56


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", "")


def _cell(sha: Column, bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(sha), 64 - bits)


def _repeated_cells(prints: DataFrame, bits: int) -> DataFrame:
    """(c): the cells that two rows or more fall in."""
    cells = prints.select(_cell(F.col("_sha"), bits).alias("c")).groupBy("c").agg(F.count("*").alias("n"))
    return cells.where("n > 1").select("c")


class _Found:
    """What pass 1 leaves behind: the filter, and the groups of two or more rows."""

    def __init__(self, prints: DataFrame, cap_bits: int):
        n = prints.count()
        self.bits = int(min(log2(cap_bits), max(16, ceil(log2(max(1, n) * CELLS_PER_ROW)))))
        cells = cut(_repeated_cells(prints, self.bits))
        self.sieve = Sieve(cells, "c", cells.count())
        some = self.sieve.passed(prints, _cell(F.col("_sha"), self.bits))
        longest = some.groupBy("_sha", "_len").agg(F.min("_id").alias("_id"), F.count("*").alias("n"))
        groups = longest.groupBy("_sha").agg(
            F.max_by("_id", "_len").alias("_keep_id"), F.max("_len").alias("_keep_len"), F.sum("n").alias("_size")
        )
        self.groups = cut(groups.where("_size > 1").withColumnRenamed("_sha", "_key"))
        self.n_groups = self.groups.count()

    def split(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(rows that are alone for sure, the others with the columns of their group or nulls)."""
        rows = self.sieve.marked(rows, _cell(F.col("_sha"), self.bits))
        others = rows.where("_maybe").join(small_side(self.groups, self.n_groups), F.col("_sha") == F.col("_key"), "left")
        return rows.where("not _maybe"), others


def _prints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(docs[text_col], F.lit(""))
    return docs.select(docs[id_col].alias("_id"), F.length(text).alias("_len"), F.sha2(normalised(text), 256).alias("_sha"))


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cap_bits: int = CAP_BITS) -> DataFrame:
    """A row for each row of docs: id, keep_id, group_size, kept, text_sha256.

    Of rows whose texts are equal without white space, the one with the most code points stays,
    then the one with the smallest id.
    """
    prints = cut(_prints(docs, id_col, text_col))  # narrow: whole texts are read once and never shuffled
    alone, others = _Found(prints, cap_bits).split(prints)
    own = F.col("_id")
    named = lambda keep, size, kept: [own.alias(id_col), keep.alias("keep_id"), size.cast("long").alias("group_size"), kept.alias("kept"), F.col("_sha").alias("text_sha256")]
    grouped = F.col("_key").isNotNull()
    return alone.select(named(own, F.lit(1), F.lit(True))).union(
        others.select(
            named(
                F.when(grouped, F.col("_keep_id")).otherwise(own),
                F.coalesce(F.col("_size"), F.lit(1)),
                ~grouped | own.eqNullSafe(F.col("_keep_id")),
            )
        )
    )


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cap_bits: int = CAP_BITS) -> DataFrame:
    """docs with one row of each group of equal texts, chosen as in `duplicates`; all columns stay as they are.

    Texts of rows that no other row can equal are not shuffled.
    """
    found = _Found(cut(_prints(docs, id_col, text_col)), cap_bits)
    text = F.coalesce(docs[text_col], F.lit(""))
    packed = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("_row"), docs[id_col].alias("_id"),
        F.length(text).alias("_len"), F.sha2(normalised(text), 256).alias("_sha"),
    )
    alone, others = found.split(packed)
    stay = F.col("_key").isNull() | (F.col("_id").eqNullSafe(F.col("_keep_id")) & (F.col("_len") == F.col("_keep_len")))
    once = others.where(stay).select("_sha", "_row").dropDuplicates(["_sha"])  # equal ids and texts: one row
    return alone.select("_row.*").union(once.select("_row.*"))
