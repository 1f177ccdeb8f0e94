"""The driver's tables as observations: one statement for each input, in SQL that both Spark and DuckDB read."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cooccurrence import sightings

#: Rows of order lines that a task makes pairs of, or of pairs that it counts.
TASK_ROWS = 250_000

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

STATEMENTS = {
    # Orders mention parts (sparse) or part names (dense).
    "mentions": """SELECT DISTINCT l_orderkey AS obs_id, o_orderdate AS ts, o_orderpriority AS task, concat('p', CAST(l_partkey AS STRING)) AS concept
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
    "name_mentions": """SELECT DISTINCT l_orderkey AS obs_id, o_orderdate AS ts, o_orderpriority AS task, p_name AS concept
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {part} ON l_partkey = p_partkey""",
    # Users are concepts; an error speaks against, anything else for them.
    "evidence": """SELECT concat('u', CAST(user_id AS STRING)) AS concept, ts, event_id AS obs_id, event_type AS source,
        CASE WHEN event_type = 'error' THEN 'weaken' ELSE 'activate' END AS kind FROM {events}""",
    # Suppliers support parts, nations are part of regions, customers and suppliers of nations.
    "typed": """SELECT concat('s', CAST(l_suppkey AS STRING)) AS src, concat('p', CAST(l_partkey AS STRING)) AS tgt, 'supports' AS label, l_shipdate AS ts, l_orderkey AS obs_id, l_linenumber AS ordinal FROM {lineitem}
        UNION ALL SELECT concat('n', CAST(n_nationkey AS STRING)), concat('r', CAST(n_regionkey AS STRING)), 'part_of', CAST('1992-01-01' AS TIMESTAMP), 0, 0 FROM {nation}
        UNION ALL SELECT concat('s', CAST(s_suppkey AS STRING)), concat('n', CAST(s_nationkey AS STRING)), 'part_of', CAST('1992-01-01' AS TIMESTAMP), 0, 0 FROM {supplier}""",
    "returns": """SELECT concat('s', CAST(l_suppkey AS STRING)) AS src, concat('p', CAST(l_partkey AS STRING)) AS tgt, 'positive' AS axis, l_shipdate AS ts, l_orderkey AS obs_id, l_linenumber AS ordinal
        FROM {lineitem} WHERE l_returnflag = 'R'""",
    # Supplies as events of their pair: a return weakens, the rest reinforces.
    "supply_events": """SELECT concat('s', CAST(l_suppkey AS STRING)) AS low, concat('p', CAST(l_partkey AS STRING)) AS high, l_shipdate AS ts, l_orderkey * 10 + l_linenumber AS obs_id,
        CASE WHEN l_returnflag = 'R' THEN 'weaken' ELSE 'reinforce' END AS kind FROM {lineitem}""",
    # The graph of parts that are ordered together.
    "concepts": """SELECT m.concept AS id, least(1e0, 15e-2 + sum(6e-2 / (1e0 + 8e-2 * m.n))) AS confidence, count(*) AS activation_count, max(m.ts) AS last_activated,
            min(p.p_brand) AS domain,
            CASE WHEN count(*) >= 35 THEN 'established' WHEN count(*) >= 28 THEN 'developing' ELSE 'embryonic' END AS maturity
        FROM (SELECT concept, ts, row_number() OVER (PARTITION BY concept ORDER BY ts, obs_id) AS n FROM ({mentions}) AS x) AS m
        JOIN (SELECT concat('p', CAST(p_partkey AS STRING)) AS pid, p_brand FROM {part}) AS p ON p.pid = m.concept GROUP BY m.concept""",
    "sightings": """SELECT a.concept AS a, b.concept AS b, count(*) AS n, max(a.ts) AS last_reinforced
        FROM ({mentions}) AS a JOIN ({mentions}) AS b ON a.obs_id = b.obs_id AND a.concept < b.concept GROUP BY a.concept, b.concept""",
    "edges": """SELECT s.a AS source_id, s.b AS target_id,
            CASE WHEN abs(x.p_size - y.p_size) > 40 THEN 'negative' WHEN abs(x.p_size - y.p_size) < 10 THEN 'positive' ELSE 'parallel' END AS axis,
            15e-2 + 1e-1 * (s.n - 2) + 1e-3 * (x.p_size + y.p_size) AS weight, 2e-1 + 1e-3 * (x.p_size + y.p_size) AS probability, 3e-1 + 1e-3 * x.p_size AS confidence,
            s.n - 2 AS reinforcement_count, s.last_reinforced AS last_reinforced, x.p_size > 25 AS is_explicit
        FROM ({sightings}) AS s JOIN (SELECT concat('p', CAST(p_partkey AS STRING)) AS pid, p_size FROM {part}) AS x ON x.pid = s.a
        JOIN (SELECT concat('p', CAST(p_partkey AS STRING)) AS pid, p_size FROM {part}) AS y ON y.pid = s.b WHERE s.n >= 2""",
    # Activation is a search: every order whose number is divisible by 20 is a query, against the whole graph.
    "seeds": """SELECT DISTINCT concat('q', CAST(o_orderkey AS STRING)) AS query_id, concat('p', CAST(l_partkey AS STRING)) AS id
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey WHERE o_orderkey % 20 = 0""",
    "colors": """SELECT m.concept AS id, m.task AS label, least(9e-1, 5e-2 * count(*)) AS strength FROM ({mentions}) AS m GROUP BY m.concept, m.task""",
}


def text(name: str, keep: tuple[str, ...] = ()) -> str:
    """A statement with the inputs that it uses written out; the driver's tables, and inputs to keep, stay in braces."""
    return re.sub(r"\{(\w+)\}", lambda m: m[0] if m[1] in TABLES or m[1] in keep else text(m[1], keep), STATEMENTS[name])


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An input, or one of the driver's tables, as a DataFrame."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name == "sightings":
        return _sightings(load(spark, sf_dir, "lineitem"), load(spark, sf_dir, "orders"))
    kept = tuple(n for n in ("sightings", "mentions") if n != name)
    sql = text(name, kept)
    used = {t: load(spark, sf_dir, t) for t in [*TABLES, *kept] if f"{{{t}}}" in sql}
    if name == "mentions":  # the join and the distinct rows stay where the orders are dealt
        n = _tasks(used["lineitem"])
        used |= {"lineitem": used["lineitem"].repartition(n, "l_orderkey"), "orders": used["orders"].repartition(n, "o_orderkey")}
    if name in ("concepts", "colors", "edges"):
        n = _tasks(load(spark, sf_dir, "lineitem"))
        if "mentions" in used:
            used["mentions"] = by_concept(spark, sf_dir, used["mentions"])
        if "part" in used:
            used["part"] = _dealt_parts(used["part"], n)
    return spark.sql(sql, **used)


def by_concept(spark: SparkSession, sf_dir: str, mentions: DataFrame) -> DataFrame:
    """Mentions, or what is made of them, dealt by concept to tasks whose number grows with the order lines."""
    return mentions.repartition(_tasks(load(spark, sf_dir, "lineitem")), "concept")


def _dealt_parts(part: DataFrame, tasks: int) -> DataFrame:
    """Parts dealt by the id of their concept, to be met by a merge join: their file is small, so that Catalyst would send all of them to every task."""
    return part.repartition(tasks, F.concat(F.lit("p"), F.col("p_partkey").cast("string"))).hint("merge")


def _tasks(lines: DataFrame) -> int:
    """Tasks for the order lines, by their number, which is in the files' footers."""
    return max(lines.sparkSession.sparkContext.defaultParallelism, lines.count() // TASK_ROWS + 1)


def _sightings(lines: DataFrame, orders: DataFrame) -> DataFrame:
    """The statement of that name, without a join of all mentions with themselves, in as many tasks as there are rows for."""
    seen = lines.select(F.col("l_orderkey").alias("obs_id"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("concept"))
    return sightings(seen, orders.select(F.col("o_orderkey").alias("obs_id"), F.col("o_orderdate").alias("ts"), F.col("o_orderpriority").alias("task")), _tasks(lines))


def duck(sql: str) -> str:
    """An oracle statement: inputs in braces become common table expressions."""
    names = [n for n in dict.fromkeys(re.findall(r"\{(\w+)\}", sql)) if n in STATEMENTS]
    plain = lambda s: re.sub(r"\{(\w+)\}", r"\1", s)
    ctes = ", ".join(f"{n} AS MATERIALIZED ({plain(text(n))})" for n in names)
    body = plain(sql).strip()
    if not names:
        return body
    return f"WITH {ctes}, {body[4:].strip()}" if body.upper().startswith("WITH ") else f"WITH {ctes} {body}"
