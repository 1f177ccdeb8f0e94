"""Registered queries against DuckDB on the smallest tables, and the shape of their plans."""

import os

import duckdb
import pytest

from loomgraph.plans import ORACLE_SQL, QUERIES
from loomgraph.plans.adapters import TABLES

SF = "/root/testdata/sf0.001"
QUICK = [
    "a04_record_sources", "a13_split_texts", "b02_identity_key", "b07_relation_spec", "b12_color_profile", "c01_resolve", "c05_find_similar", "c11_migrate_edges", "d02_fold_weaken", "d05_fold_relation_weaken",
    "d07_cooccurrence", "e04_evaluate_lifecycle", "f08_temporal_coupling", "f13_diffuse", "f17_node_entropy", "e10_batch_turns", "a08_export_graph", "a12_weakened", "c13_concept_cards", "d14_relation_feedback",
    "d15_world_status", "d18_ingest_edges", "e08_compact_sessions",
]
if os.environ.get("ALL_QUERIES"):  # a quarter of an hour
    QUICK = sorted(ORACLE_SQL)
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


def flat(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(flat, v))
    return v.isoformat() if hasattr(v, "isoformat") else v


@needs_data
@pytest.mark.parametrize("name", QUICK)
def test_same_rows(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    rel = db.sql(ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    ours = sorted((flat([r[c] for c in sorted(df.columns)]) for r in df.collect()), key=repr)
    names = list(rel.columns)
    theirs = sorted((flat([r[names.index(c)] for c in sorted(names)]) for r in rel.fetchall()), key=repr)
    assert ours == theirs


@needs_data
@pytest.mark.parametrize("name", ["d02_fold_weaken", "d07_cooccurrence", "f01_activate", "c05_find_similar", "f17_network_entropy"])
def test_plans_stay_in_the_jvm(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan


def test_every_oracle_has_a_query():
    assert set(ORACLE_SQL) <= set(QUERIES) and len(QUERIES) > 100
