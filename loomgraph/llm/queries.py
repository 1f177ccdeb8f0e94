"""The registered queries of the text operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import anntree, hardneg, importance, langid, licenses, quality, toxicity, warc
from .bpe import digests
from .common import held_out, table
from .decontam import report
from .exact import duplicates
from .minhash import near_duplicates
from .repeats import remove_repeats


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(~held_out("doc_id")))
    out = langid.identify(docs.select("doc_id", "text"), model)
    return out.select(
        "_row.doc_id", held_out("_row.doc_id").alias("held_out"), F.col("found.lang").alias("lang_pred"), "found.score", "found.languages", "found.shares"
    )


def to_learn_from(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents and labels without the rows that are held out."""
    docs, labels = (table(spark, sf_dir, t).where(~held_out("doc_id")) for t in ("documents", "labels"))
    return docs.select("doc_id", "text"), labels


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = toxicity.fit(*to_learn_from(spark, sf_dir))
    out = toxicity.score(table(spark, sf_dir, "documents").select("doc_id", "text"), model)
    return out.select("_row.doc_id", held_out("_row.doc_id").alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as files: most lie in source/lang/block, some further up; those further up are named as licence files."""
    docs = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    folder = F.when(i % 50 == 0, F.array("source")).when(i % 10 == 0, F.array("source", "lang")).otherwise(F.array("source", "lang", F.floor(i / 1000).cast("string")))
    name = F.when(i % 10 == 0, F.concat(F.lit("LICENSE."), i.cast("string"))).otherwise(i.cast("string"))
    files = docs.select("doc_id", "text", F.array_join(F.concat(folder, F.array(name)), "/").alias("path"))
    return licenses.scan(files, "doc_id", "path", "text")


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    """A vocabulary file of the public tokenizers that are installed beside Python."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(docs, tokenizer_file()).select("_row.doc_id", "bpe.*")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates(table(spark, sf_dir, "documents"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256)
    return out.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write(table(spark, sf_dir, "pages"), warc.new_folder(spark))
    return warc.read(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_bytes=False)
    return out.select("_row.doc_id", "cut.n_bytes", "cut.n_removed", "cut.n_spans", "cut.kept_sha256")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = quality.fit(*to_learn_from(spark, sf_dir))
    out = quality.score(table(spark, sf_dir, "documents").select("doc_id", "text"), model)
    return out.select("_row.doc_id", held_out("_row.doc_id").alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").withColumn("label", label)
    return hardneg.mine(rows, rows.where("vec_id % 100 = 0"))


def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return anntree.search(rows, rows.where("vec_id % 100 = 0"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = importance.resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.select("_row.doc_id", "n_features", "weight", "score", "rank")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_toxicity": op2_toxicity,
    "op3_license_scan": op3_license_scan,
    "op4_minhash": op4_minhash,
    "op5_bpe": op5_bpe,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_warc": op8_warc,
    "op9_repeats": op9_repeats,
    "op10_quality": op10_quality,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_nearest_neighbours": op12_nearest_neighbours,
    "op13_importance_resampling": op13_importance_resampling,
}



def _license_sql() -> str:
    """The same scan in DuckDB: every unit of every file against every template."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    low = lambda c: f"translate(coalesce({c}, ''), '{licenses.UPPER}', '{licenses.LOWER}')"
    words = lambda c: f"list_filter(regexp_split_to_array({c}, '{licenses.GAP}'), lambda w: w <> '' AND NOT list_contains([{', '.join(map(quoted, licenses.STOP))}], w))"
    templates = ", ".join(f"({k}, {quoted(name)}, {quoted(text)})" for k, (name, text) in enumerate(licenses.TEMPLATES))
    own = "arg_min(template, (-cosine, template))"
    return f"""
        WITH f AS (SELECT doc_id, {low('text')} AS t, array_to_string([source, CASE WHEN doc_id % 50 <> 0 THEN lang END, CASE WHEN doc_id % 10 <> 0 THEN (doc_id // 1000)::VARCHAR END,
                          CASE WHEN doc_id % 10 = 0 THEN 'LICENSE.' ELSE '' END || doc_id::VARCHAR], '/') AS path FROM documents),
        n AS (SELECT count(*) AS n FROM f),
        df AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({words('t')})) AS term FROM f) GROUP BY 1),
        t AS (SELECT number, name, term, count(*) AS tf FROM (SELECT number, name, unnest({words(low('text'))}) AS term FROM (VALUES {templates}) AS x(number, name, text)) GROUP BY ALL),
        tw AS (SELECT number, name, t.term, tf * (ln((n + 1) / (coalesce(df, 0) + 1)) + 1) AS w FROM t CROSS JOIN n LEFT JOIN df ON df.term = t.term),
        tn AS (SELECT number, sqrt(sum(w * w)) AS size FROM tw GROUP BY 1),
        l AS (SELECT doc_id, t, string_split(t, chr(10)) AS x FROM f),
        u AS (SELECT doc_id, unnest(list_distinct(x || flatten(list_transform(x, lambda y: regexp_split_to_array(y, '{licenses.SENTENCE}'))) || regexp_split_to_array(t, '{licenses.BLANK}') || [regexp_extract(t, '{licenses.HEADER}', 1), t])) AS u FROM l),
        v AS (SELECT doc_id, u, term, count(*) AS tf FROM (SELECT doc_id, u, unnest({words('u')}) AS term FROM u) GROUP BY ALL),
        vw AS (SELECT doc_id, u, v.term, tf * (ln((n + 1) / (df + 1)) + 1) AS w FROM v JOIN df ON df.term = v.term CROSS JOIN n),
        vn AS (SELECT doc_id, u, sqrt(sum(w * w)) AS size FROM vw GROUP BY ALL),
        dot AS (SELECT vw.doc_id, vw.u, tw.number, max(tw.name) AS template, sum(vw.w * tw.w) AS d FROM vw JOIN tw ON tw.term = vw.term GROUP BY ALL),
        c AS (SELECT dot.doc_id, template, round(d / vn.size / tn.size, 6) AS cosine FROM dot JOIN vn ON vn.doc_id = dot.doc_id AND vn.u = dot.u JOIN tn ON tn.number = dot.number),
        own AS (SELECT doc_id, {own} AS own, max(cosine) AS score FROM c WHERE cosine >= {licenses.THRESHOLD} GROUP BY 1),
        r AS (SELECT f.doc_id, path, own, score, doc_id % 10 = 0 AS notice, regexp_replace(path, '/?[^/]*$', '') AS dir FROM f LEFT JOIN own USING (doc_id)),
        s AS (SELECT dir, arg_min(own, (-score, own)) AS spoken FROM r WHERE notice AND own IS NOT NULL GROUP BY 1),
        near AS (SELECT r.doc_id, arg_max(s.spoken, length(s.dir)) AS spoken, arg_max(s.dir, length(s.dir)) AS above FROM r JOIN s ON r.dir = s.dir OR s.dir = '' OR starts_with(r.dir, s.dir || '/') GROUP BY 1)
        SELECT r.doc_id, path, own AS own_license, score AS own_score, coalesce(own, spoken) AS license,
               CASE WHEN own IS NOT NULL AND notice THEN 'file' WHEN own IS NOT NULL THEN 'header' WHEN spoken IS NOT NULL THEN 'inherited' ELSE 'none' END AS found,
               CASE WHEN own IS NULL THEN above END AS from_dir
        FROM r LEFT JOIN near ON near.doc_id = r.doc_id"""


ORACLE_SQL: dict[str, str] = {
    "op3_license_scan": _license_sql(),
    "op4_minhash": r"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + least(len(w), 5) - 1], ' ') AS g FROM (SELECT *, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM d WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
        l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
        e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r AS (SELECT doc_id AS id, doc_id AS x FROM documents UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.x),
        m AS (SELECT id, min(x) AS component_id FROM r GROUP BY 1)
        SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d JOIN m ON m.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id""",
    "op6_exact_dedup": r"""
        WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS len,
                          sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS sha FROM documents)
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY sha) AS group_size,
               doc_id = first_value(doc_id) OVER w AS kept, sha AS text_sha256
        FROM n WINDOW w AS (PARTITION BY sha ORDER BY len DESC, doc_id)""",
    "op7_benchmark_decontamination": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                 '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        k AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS g
              FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
        t AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM k) WHERE len(w) >= n),
        h AS (SELECT t.doc_id, t.i, t.n, k.item_id FROM t JOIN k ON t.n = k.n AND array_to_string(t.w[t.i : t.i + t.n - 1], ' ') = k.g),
        c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY 1),
        s AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(x, ',' ORDER BY x)) AS sha
              FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM h) GROUP BY 1)
        SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               coalesce(sha, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN c USING (doc_id) LEFT JOIN s USING (doc_id)""",
    "op8_warc": r"""
        WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
        g AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top FROM p)
        SELECT page_id, payload_bytes,
               array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   (((('0x' || substr(h, ((i // 4) * 5 + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31) + 1)::INT, 1)), '') AS payload_digest,
               CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
        FROM g""",
    "op11_hard_negatives": """
        WITH e AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS l, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
                   FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.id AS a, b.id AS b, a.l = b.l AS same, list_inner_product(a.v, b.v)::BIGINT AS s FROM e a JOIN e b ON a.id % 100 = 0 AND a.id <> b.id AND len(a.v) = len(b.v)),
        p AS (SELECT a, b, s FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5),
        n AS (SELECT p.a, p.b AS pos, p.s AS ps, s.b AS neg, s.s AS ns, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.s DESC, s.b) AS r
              FROM p JOIN s ON s.a = p.a AND NOT s.same AND 80 * p.s <= 100 * s.s AND s.s <= p.s)
        SELECT a AS anchor_id, pos AS positive_id, r::INT AS rank, neg AS negative_id, ps AS positive_score, ns AS negative_score FROM n WHERE r <= 5""",
    "op13_importance_resampling": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        y AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS x FROM benchmark),
        u AS (SELECT doc_id, unnest(w) AS x FROM w),
        k AS (SELECT x, xor(4294967295, list_reduce(list_transform(range(len(hex(encode(x))) // 2), lambda i: ('0x' || substr(hex(encode(x)), 2 * i + 1, 2))::BIGINT),
                     lambda c, b: list_reduce(range(8), lambda d, i: xor(d >> 1, 3988292384 * (d & 1)), xor(c, b)), 4294967295::BIGINT)) % 10000 AS k
              FROM (SELECT x FROM u UNION SELECT x FROM y)),
        d AS (SELECT doc_id, k FROM u JOIN k USING (x)),
        s AS (SELECT k, count(*)::DOUBLE AS s FROM d GROUP BY 1),
        t AS (SELECT k, count(*)::DOUBLE AS t FROM y JOIN k USING (x) GROUP BY 1),
        g AS (SELECT b.k, floor(1000 * ln((coalesce(t, 0) + 1) * ((SELECT coalesce(sum(s), 0) FROM s) + 10000) / ((coalesce(s, 0) + 1) * ((SELECT coalesce(sum(t), 0) FROM t) + 10000)))) AS g
              FROM (SELECT unnest(range(10000)) AS k) b LEFT JOIN s ON s.k = b.k LEFT JOIN t ON t.k = b.k),
        m AS (SELECT doc_id, floor(sum(g) / count(*)) AS m FROM d JOIN g USING (k) GROUP BY 1),
        r AS (SELECT w.doc_id, len(w.w)::BIGINT AS n, coalesce(m, 0)::BIGINT AS m,
                     ('0x' || substr(sha256('2024:' || coalesce(w.doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM w LEFT JOIN m ON m.doc_id = w.doc_id),
        f AS (SELECT doc_id, n, m, m + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS s FROM r),
        z AS (SELECT *, CASE WHEN n >= 20 THEN row_number() OVER (PARTITION BY n >= 20 ORDER BY s DESC, doc_id) END AS rank FROM f)
        SELECT doc_id, n AS n_features, m AS weight, s AS score, CASE WHEN rank <= 10 * (SELECT count(*) FROM f WHERE n >= 20) // 100 THEN rank END AS rank FROM z""",
}
