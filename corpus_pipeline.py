"""A corpus pipeline: toxicity, exact dedup, near dedup, benchmark decontamination, BPE.

Each stage works on all that the stage before kept, and each is written and read again before the next one.
Scratch goes to the folder that spark.checkpoint.dir names.

Defined cases, of every stage: a null or empty text is a document like others (no toxic feature, equal to other empty texts, no shingle, no
word, no token); a row with a null doc_id is never learned from and goes through, except that of equal texts it stays only where none has an id;
rows of one doc_id and text are one document, of which exact dedup leaves one row; ties go to the smaller doc_id; texts
of any length are taken whole; an empty table gives an empty table; other columns are carried along whatever their
names, only the last stage replaces those that have the name of one of its own (n_tokens, ids, decoded_sha256).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import bpe, decontam, exact, minhash, toxicity
from loomgraph.llm.common import held_out, scratch, table
from loomgraph.llm.queries import tokenizer_file


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go; learned from the labels of documents that are not held out.

    Without labels of both kinds every text scores their share, so that nothing goes unless all labels are toxic.
    """
    learn = docs.where(~held_out("doc_id")).select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~held_out("doc_id"))
    return toxicity.drop_toxic(docs, toxicity.fit(learn, labels))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal without white space, the longest stays, then the smallest doc_id; empty and null texts are equal."""
    return exact.drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by near copies (a Jaccard similarity of 0.8 or more of five-word shingles), the one with the smallest doc_id stays.

    Texts without a word and rows without an id have no links and stay; of rows with one id all stay or go.
    """
    return minhash.drop_near_duplicates(docs, threshold=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go; an empty benchmark lets everything pass."""
    return decontam.drop_documents(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of docs without the text, with n_tokens, ids and the SHA-256 of the text that the ids decode to; no text has no tokens."""
    own = ("n_tokens", "ids", "decoded_sha256")
    out = bpe.encode(docs.drop(*own), tokenizer_file())
    rest = [F.col(f"_row.{c}") for c in docs.columns if c not in (*own, "text")]
    return out.select(*rest, "bpe.n_tokens", "bpe.ids", F.sha2("bpe.decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

#: A trained classifier and BPE are beyond SQL; tests/llm holds the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; the last one is left to whoever reads the result."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{scratch(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
