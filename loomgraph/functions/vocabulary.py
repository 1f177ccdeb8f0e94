"""The relation vocabulary as small tables: axes, labels, strengths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Canonical relation, axis, structural strength, propagation strength.
SPECS = [
    ("membership", "positive", 0.94, 0.88),
    ("inclusion", "positive", 0.92, 0.86),
    ("proper_inclusion", "positive", 0.93, 0.87),
    ("functional_map", "positive", 0.90, 0.84),
    ("co_creation", "positive", 0.88, 0.82),
    ("mutual_reinforcement", "positive", 0.86, 0.82),
    ("future_coupling", "positive", 0.84, 0.78),
    ("enables", "positive", 0.82, 0.76),
    ("dependence", "positive", 0.78, 0.70),
    ("disjointness", "negative", 0.95, 0.05),
    ("complement", "negative", 0.88, 0.10),
    ("exclusion", "negative", 0.90, 0.08),
    ("incompatible_ontology", "negative", 0.90, 0.06),
    ("violates_constraint", "negative", 0.86, 0.08),
    ("conflict", "negative", 0.84, 0.10),
    ("instability", "negative", 0.78, 0.12),
    ("adversarial_prediction", "negative", 0.76, 0.10),
    ("equivalence", "parallel", 0.96, 0.92),
    ("quotient_map", "parallel", 0.93, 0.90),
    ("approximate_equivalence", "parallel", 0.82, 0.74),
    ("overlap", "parallel", 0.66, 0.60),
    ("similarity_kernel", "parallel", 0.70, 0.64),
    ("recursive_co_modeling", "parallel", 0.86, 0.78),
    ("persistent_attention", "parallel", 0.78, 0.70),
    ("co_membership", "parallel", 0.50, 0.45),
    ("generic_relation", "parallel", 0.55, 0.45),
]
# Other labels and the canonical relation that each stands for.
ALIASES = {
    "positive": "mutual_reinforcement",
    "attraction": "mutual_reinforcement",
    "trust": "mutual_reinforcement",
    "co-creation": "co_creation",
    "supports": "enables",
    "activates": "enables",
    "depends_on": "dependence",
    "precedes": "dependence",
    "derived_from": "dependence",
    "contains": "inclusion",
    "part_of": "membership",
    "negative": "conflict",
    "repulsion": "conflict",
    "contrasts": "conflict",
    "parallel": "generic_relation",
    "related_to": "generic_relation",
    "resonance": "overlap",
    "deep_conceptual_overlap": "overlap",
    "mutual_understanding": "equivalence",
    "persistent_attention_allocation": "persistent_attention",
    "similar_to": "similarity_kernel",
}
# How strongly each axis passes activation on.
AXIS_FACTOR = {"positive": 1.0, "parallel": 0.75, "negative": 0.60}

# What each axis is about.
AXIS_DESCRIPTIONS = {
    "positive": ["trust", "co-creation", "future coupling", "mutual reinforcement"],
    "negative": ["conflict", "incompatible ontology", "instability", "adversarial prediction"],
    "parallel": ["mutual understanding", "deep conceptual overlap", "recursive co-modeling", "persistent attention allocation"],
}

_AXIS = {name: axis for name, axis, _, _ in SPECS}
#: Labels that name an axis: the aliases, and the canonical relations that were labels of their own before.
AXIS_LABELS = {a: _AXIS[r] for a, r in ALIASES.items()} | {
    name: _AXIS[name]
    for name in ("co_creation", "future_coupling", "mutual_reinforcement", "conflict", "incompatible_ontology", "instability", "adversarial_prediction", "recursive_co_modeling")
}


def _map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def label_key(label: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_replace(F.coalesce(label, F.lit("")), r"^\s+|\s+$", "")), " ", "_")


def normalize_axis(label: Column) -> Column:
    """positive, negative or parallel; an unknown or empty label is parallel."""
    return F.coalesce(F.element_at(_map(AXIS_LABELS), label_key(label)), F.lit("parallel"))


def normalize_semantic(label: Column) -> Column:
    """The canonical relation of a label; an unknown one is generic_relation."""
    return F.coalesce(F.element_at(_map({name: name for name in _AXIS} | ALIASES), label_key(label)), F.lit("generic_relation"))


def is_known_label(label: Column) -> Column:
    return label_key(label).isin(sorted({*AXIS_LABELS, *ALIASES, *_AXIS}))


def axis_factor(axis: Column) -> Column:
    return F.coalesce(F.element_at(_map(AXIS_FACTOR), axis), F.lit(0.5))


def relation_specs(spark: SparkSession) -> DataFrame:
    """(relation, axis, structural, propagation): a fixed table."""
    return spark.createDataFrame(SPECS, "relation string, axis string, structural double, propagation double")


def relation_names(axis: Column | None = None) -> Column:
    """The canonical relations in alphabetical order: all, or those of the axis that a label stands for."""
    sorted_names = lambda of: F.array(*[F.lit(name) for name in sorted(_AXIS) if of in (None, _AXIS[name])])
    if axis is None:
        return sorted_names(None)
    return F.element_at(F.create_map(*[x for a in AXIS_DESCRIPTIONS for x in (F.lit(a), sorted_names(a))]), normalize_axis(axis))


def axis_descriptions(axis: Column) -> Column:
    """What the axis that a label stands for is about."""
    return F.element_at(F.create_map(*[x for a, words in AXIS_DESCRIPTIONS.items() for x in (F.lit(a), F.array(*map(F.lit, words)))]), normalize_axis(axis))


def with_spec(df: DataFrame, label: str) -> DataFrame:
    """df with relation, axis, structural and propagation of its label."""
    specs = F.broadcast(relation_specs(df.sparkSession))
    return df.withColumn("relation", normalize_semantic(F.col(label))).join(specs, "relation", "left")
