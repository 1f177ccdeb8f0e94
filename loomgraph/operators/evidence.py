"""Folding evidence into confidences.

Every step is a clamped affine map, x -> min(hi, max(lo, a x + d)) with a > 0, whose size depends on running counts only. Two such
maps make one of the same kind, so a key's steps are folded in chunks of a bounded number of rows and the chunks' results are folded
again. A relation's step maps three values (weight, confidence, probability), each from one of the three; that is closed too.

Running counts are prefix sums: events are dealt by ranges of key and order, sorted where they lie and written once; a chunk is a run of one
range, and what a key has in earlier chunks is added up from a count for each chunk. No key, hour or pair is ever gathered or sorted in one task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..numbering import in_ranges
from ..scratch import Cut, checkpointed

#: log2 of the rows of a chunk.
CHUNK_BITS = 12
#: Terms after which a sum of falling steps has passed every cap.
MOST_TERMS = 4096
INF = float("inf")


def _clamp(x: Column, lo: Column, hi: Column) -> Column:
    return F.least(hi, F.greatest(lo, x))


def _map(a: Column | float = 1.0, d: Column | float = 0.0, lo: Column | float = -INF, hi: Column | float = INF) -> Column:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    return F.struct(as_column(a).alias("a"), as_column(d).alias("d"), as_column(lo).alias("lo"), as_column(hi).alias("hi"))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once: inside a fold, expressions are not shared."""
    return F.transform(F.array(value), body)[0]


def _then(f: Column, g: Column) -> Column:
    """Map f followed by map g, as one map."""
    return _map(f["a"] * g["a"], g["a"] * f["d"] + g["d"], _clamp(g["a"] * f["lo"] + g["d"], g["lo"], g["hi"]), _clamp(g["a"] * f["hi"] + g["d"], g["lo"], g["hi"]))


def apply_map(x: Column, m: Column) -> Column:
    return _clamp(m["a"] * x + m["d"], m["lo"], m["hi"])


def _numbered(events: DataFrame, key: list[str], order: list[str], counts: dict[str, Column]) -> tuple[DataFrame, bool]:
    """events with `_n` (rises in order), `_chunk` and running counts (the row itself included) of the rows that fit each condition; whether each key is one chunk.

    Keys whose rows fit one chunk are numbered where their rows meet. Only the others (or what shares a hash with them) are dealt by ranges.
    """
    cut = checkpointed(events.sparkSession)
    events = events.dropna(subset=key)
    events = events.withColumn("_h", F.xxhash64(*key))
    long = cut(events.groupBy("_h").agg(F.count("*").alias("_c")).where(F.col("_c") > 1 << CHUNK_BITS).select("_h"))
    if long.isEmpty():
        cut.drop(long)
        return _in_one_chunk(events.drop("_h"), key, order, counts), True
    short = _in_one_chunk(events.join(long, "_h", "left_anti").drop("_h"), key, order, counts)
    return short.unionByName(_in_chunks(events.join(long, "_h", "left_semi").drop("_h"), key, order, counts, cut)), False


def _in_one_chunk(events: DataFrame, key: list[str], order: list[str], counts: dict[str, Column]) -> DataFrame:
    """_numbered of keys that have few rows; rows that are equal in order go by their hash."""
    by = Window.partitionBy(*key).orderBy(*order, F.xxhash64(*events.columns))
    until = by.rowsBetween(Window.unboundedPreceding, 0)
    rows = events.select("*", F.row_number().over(by).cast("long").alias("_n"), *[F.sum(F.when(c, 1).otherwise(0)).over(until).alias(n) for n, c in counts.items()])
    return rows.withColumn("_chunk", F.lit(0).cast("long"))


def _in_chunks(events: DataFrame, key: list[str], order: list[str], counts: dict[str, Column], cut: Cut) -> DataFrame:
    """_numbered of keys that have any number of rows."""
    ranged = in_ranges(events, key, [F.col(c) for c in order], cut).withColumn("_chunk", F.shiftright("_n", CHUNK_BITS))
    sums = ranged.groupBy(*key, "_chunk").agg(*[F.count_if(c).alias(f"_b{n}") for n, c in counts.items()])
    earlier = Window.partitionBy(*key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)  # a row a chunk
    before = sums.select(*key, "_chunk", *[F.coalesce(F.sum(f"_b{n}").over(earlier), F.lit(0)).alias(f"_b{n}") for n in counts])
    inside = Window.partitionBy(*key, "_chunk").orderBy("_n").rowsBetween(Window.unboundedPreceding, 0)  # a chunk is bounded
    rows = ranged.join(before, [*key, "_chunk"])
    return rows.select(*ranged.columns, *[(F.col(f"_b{n}") + F.sum(F.when(c, 1).otherwise(0)).over(inside)).alias(n) for n, c in counts.items()])


def _folded(rows: DataFrame, key: list[str], step: Column, then: Callable[[Column, Column], Column], counts: dict[str, Column], last: dict[str, Column], one: bool) -> DataFrame:
    """(key, step, counts, last): all steps of each key in order, as one step, first in each chunk, then over the chunks unless each key is `one`; how many
    rows fit each condition, and each column's greatest value. A fold begins with its first step, so a single step is taken as it is."""

    def fold(at: str) -> Column:
        rest = lambda x: F.aggregate(F.slice(x, 2, F.size(x)), x[0]["_s"], lambda acc, y: then(acc, y["_s"]))
        return _let(F.array_sort(F.collect_list(F.struct(at, "_s"))), rest)

    kept = rows.select(*key, "_chunk", "_n", step.alias("_s"), *[c.alias(n) for n, c in {**counts, **last}.items()])
    tops = [F.max(n).alias(n) for n in last]
    if one:
        return kept.groupBy(*key).agg(fold("_n").alias("step"), *[F.count_if(n).alias(n) for n in counts], *tops)
    parts = kept.groupBy(*key, "_chunk").agg(fold("_n").alias("_s"), *[F.count_if(n).alias(n) for n in counts], *tops)
    return parts.groupBy(*key).agg(fold("_chunk").alias("step"), *[F.sum(n).alias(n) for n in counts], *tops)


def fold_concepts(events: DataFrame, start: float = 0.15, key: str = "concept", order: tuple[str, ...] = ("ts", "obs_id"), state: DataFrame | None = None) -> DataFrame:
    """events (concept, ts, obs_id, kind activate or weaken) -> confidence, counts, last times.

    The n-th activation adds .06/(1+.08n) up to 1, the n-th weakening takes the same down to .01. `state` has the
    same columns from an earlier fold: its concepts go on from there, those without events stay as they are.
    """
    kinds = {"_a": F.col("kind") == "activate", "_w": F.col("kind") == "weaken"}
    rows, one = _numbered(events.select(key, *dict.fromkeys((*order, "ts", "kind"))), [key], list(order), kinds)
    if state is not None:
        was = state.select(key, F.col("activation_count").alias("_a0"), F.col("disconfirmation_count").alias("_w0"))
        rows = rows.join(was, key, "left").withColumns({c: F.col(c) + F.coalesce(f"{c}0", F.lit(0)) for c in ("_a", "_w")})
    up = F.col("kind") == "activate"
    d = F.when(up, 0.06 / (1 + 0.08 * F.col("_a"))).otherwise(-0.06 / (1 + 0.08 * F.col("_w")))
    counts = {"activation_count": kinds["_a"], "disconfirmation_count": kinds["_w"]}
    last = {"last_activated": F.when(kinds["_a"], F.col("ts")), "last_weakened": F.when(kinds["_w"], F.col("ts"))}
    steps = _folded(rows, [key], _map(1.0, d, F.when(up, -INF).otherwise(0.01), F.when(up, 1.0).otherwise(INF)), _then, counts, last, one)
    if state is None:
        return steps.select(key, apply_map(F.lit(start), F.col("step")).alias("confidence"), "activation_count", "disconfirmation_count", "last_activated", "last_weakened")
    was = state.select(key, *[F.col(c).alias(f"_{c}") for c in ("confidence", "activation_count", "disconfirmation_count", "last_activated", "last_weakened")])
    out = steps.join(was, key, "full_outer")
    begin = F.coalesce("_confidence", F.lit(start))
    total = lambda c: (F.coalesce(c, F.lit(0)) + F.coalesce(f"_{c}", F.lit(0))).alias(c)
    last = lambda c: F.greatest(c, f"_{c}").alias(c)
    return out.select(
        key, F.when(F.col("step").isNull(), begin).otherwise(apply_map(begin, F.col("step"))).alias("confidence"),
        total("activation_count"), total("disconfirmation_count"), last("last_activated"), last("last_weakened"),
    )


def summed(n: Column, term) -> Column:  # noqa: ANN001
    """term(1) + ... + term(n) of falling steps on the way to a cap: beyond MOST_TERMS the cap is passed."""
    terms = F.sequence(F.lit(1), F.least(F.greatest(n, F.lit(1)), F.lit(MOST_TERMS)).cast("int"))
    return F.when(n > 0, F.aggregate(terms, F.lit(0.0), lambda a, i: a + term(i))).otherwise(0.0)


def fold_activations(mentions: DataFrame, start: float = 0.15, key: str = "concept") -> DataFrame:
    """Activations alone have a closed form, a sum that needs their number only."""
    rows = mentions.groupBy(key).agg(F.count("*").alias("activation_count"), F.max("ts").alias("last_activated"))
    total = summed(F.col("activation_count"), lambda i: 0.06 / (1 + 0.08 * i))
    return rows.select(key, F.least(F.lit(1.0), F.lit(start) + total).alias("confidence"), "activation_count", "last_activated")


def discover_relations(rows: DataFrame) -> DataFrame:
    """rows (src, tgt, axis, relation, structural, propagation, ts, obs_id, ordinal) -> one edge for each unordered pair and axis.

    The first sighting gives the direction, the last label the strengths.
    """
    at = F.struct("ts", "obs_id", "ordinal")
    pair = [F.least("src", "tgt").alias("low"), F.greatest("src", "tgt").alias("high"), "axis"]
    first = F.min_by(F.struct("src", "tgt", "structural", "propagation"), at)
    last = F.max_by(F.struct("relation", "structural", "propagation"), at)
    out = rows.where(F.col("src") != F.col("tgt")).groupBy(*pair).agg(first.alias("f"), last.alias("l"), F.count("*").alias("sightings"), F.min("ts").alias("discovered_at"), F.max("ts").alias("last_reinforced"))
    return out.select(
        F.col("f.src").alias("source_id"), F.col("f.tgt").alias("target_id"), "axis", F.col("l.relation").alias("relation"), F.col("l.structural").alias("structural_strength"),
        F.col("l.propagation").alias("propagation_strength"), F.col("f.propagation").alias("birth_weight"), F.col("f.structural").alias("birth_confidence"), "sightings", "discovered_at", "last_reinforced",
    )


def reinforced(weight: Column, n: Column, explicit: bool) -> Column:
    """A weight after n reinforcements, in closed form over the running number."""
    step = (lambda i: 0.08 / (1 + 0.05 * i)) if explicit else (lambda i: 0.06 / (1 + 0.15 * i))
    return F.least(F.lit(1.0 if explicit else 0.7), weight + summed(n, step))


def _step(w: tuple[int, Column], c: tuple[int, Column], p: tuple[int, Column]) -> Column:
    """A step of a relation: of each value, which of (weight, confidence, probability) it comes from, and by which map."""
    return F.struct(*[F.struct(F.lit(source).alias("from"), m.alias("map")).alias(name) for name, (source, m) in zip("wcp", (w, c, p), strict=True)])


def _both(f: Column, g: Column) -> Column:
    """Step f followed by step g."""

    def part(name: str) -> Column:
        source = g[name]["from"]
        was = F.when(source == 0, f["w"]).when(source == 1, f["c"]).otherwise(f["p"])
        return _let(was, lambda x: F.struct(x["from"].alias("from"), _then(x["map"], g[name]["map"]).alias("map"))).alias(name)

    return F.struct(part("w"), part("c"), part("p"))


def fold_relations(
    events: DataFrame, births: DataFrame, key: list[str], order: tuple[str, ...] = ("ts", "obs_id"), keep: tuple[str, ...] = (), last: dict[str, Column] | None = None
) -> DataFrame:
    """Weight, confidence and probability of edges after events of kind reinforce, weaken or update.

    births: key, weight, confidence, and where they differ from an explicit edge without a past: is_explicit, probability (else the
    weight), reinforcement_count, disconfirmation_count, probability_observation_count. The n-th reinforcement of an explicit edge adds
    .08/(1+.05n) to weight and confidence, up to 1, of a found one .06/(1+.15n) up to .7; the n-th weakening takes .06/(1+.10n) down to .01 and
    sets the probability to the confidence it leaves. An update (columns prior, prior_strength, evidence, evidence_strength, null where there is
    none) sets all three to the mean of the probability, of strength max(1, 2 + all counts), with the prior and the evidence; evidence of .5 or more
    then counts as a reinforcement, less as a weakening. Of births also the columns `keep` come along, and of an edge's events the greatest values of `last`.
    """
    last = last or {}
    zero = F.lit(0).cast("long")
    usual = {"is_explicit": F.lit(True), "probability": F.col("weight"), "reinforcement_count": zero, "disconfirmation_count": zero, "probability_observation_count": zero}
    births = births.withColumns({c: v for c, v in usual.items() if c not in births.columns})
    none = F.lit(None).cast("double")
    update = {"prior": none, "prior_strength": F.lit(1.0), "evidence": none, "evidence_strength": F.lit(2.0)}
    events = events.withColumns({c: F.col(c).cast("double") if c in events.columns else v for c, v in update.items()})
    was = births.select(*key, F.col("is_explicit").alias("_x"), F.col("reinforcement_count").alias("_r0"), F.col("disconfirmation_count").alias("_k0"), F.col("probability_observation_count").alias("_o0"))
    told = (F.col("kind") == "update") & F.col("evidence").isNotNull() & (F.col("evidence_strength") > 0)
    kinds = {"_r": (F.col("kind") == "reinforce") | (told & (F.col("evidence") >= 0.5)), "_k": (F.col("kind") == "weaken") | (told & (F.col("evidence") < 0.5)), "_o": told}
    kept = events.select(*key, *[c for c in order if c not in key], "kind", *update)
    rows, one = _numbered(kept, key, list(order), kinds)
    rows = rows.join(was, key).withColumns({c: F.col(c) + F.coalesce(f"{c}0", zero) for c in kinds})
    up, down, r, k = F.col("kind") == "reinforce", F.col("kind") == "weaken", F.col("_rn"), F.col("_kn")
    given = lambda c: F.when(F.col(c).isNotNull() & (F.col(f"{c}_strength") > 0), F.col(f"{c}_strength")).otherwise(0.0)
    value = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(c, F.lit(0.0))))
    sp, se = given("prior"), given("evidence")
    # What was known before an update: the counts without what its own evidence adds, one to the observations and one to either other count.
    known = F.greatest(F.lit(1.0), (2 + r + k + F.col("_on") - F.when(told, 2).otherwise(0)).cast("double"))
    mean = _map(known / (known + sp + se), (value("prior") * sp + value("evidence") * se) / (known + sp + se), 0.0, 1.0)
    gain = F.when(F.col("_x"), 0.08 / (1 + 0.05 * r)).otherwise(0.06 / (1 + 0.15 * r))
    more = _map(1.0, gain, -INF, F.when(F.col("_x"), 1.0).otherwise(0.7))
    less = _map(1.0, -0.06 / (1 + 0.10 * k), 0.01, INF)
    step = F.when(up, _step((0, more), (1, more), (2, _map()))).when(down, _step((0, less), (1, less), (1, less))).otherwise(_step((2, mean), (2, mean), (2, mean)))
    steps = _folded(rows.withColumnsRenamed({c: f"{c}n" for c in kinds}), key, step, _both, kinds, last, one)
    out = births.join(steps, key, "left")

    def after(name: str, part: str) -> Column:
        source = F.col(f"step.{part}.from")
        was = F.when(source == 0, F.col("weight")).when(source == 1, F.col("confidence")).otherwise(F.col("probability"))
        return F.when(F.col("step").isNull(), F.col(name)).otherwise(apply_map(was, F.col(f"step.{part}.map"))).alias(name)

    total = lambda c, x: (F.col(c) + F.coalesce(x, zero)).alias(c)
    return out.select(
        *key, after("weight", "w"), after("confidence", "c"), after("probability", "p"),
        total("reinforcement_count", "_r"), total("disconfirmation_count", "_k"), total("probability_observation_count", "_o"), *keep, *last,
    )


def update_probability(p: Column, strength: Column, prior: Column, prior_strength: Column, evidence: Column, evidence_strength: Column) -> Column:
    """The weighted mean of what is known (strength: 2 plus all counts, 1 at least), of a prior and of evidence."""
    s = F.greatest(F.lit(1.0), strength)
    sp, se = F.when(prior.isNull(), 0.0).otherwise(prior_strength), F.when(evidence.isNull(), 0.0).otherwise(evidence_strength)
    total = p * s + F.coalesce(prior, F.lit(0.0)) * sp + F.coalesce(evidence, F.lit(0.0)) * se
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), total / (s + sp + se)))


def latest_description(rows: DataFrame, key: str, text: str, order: list[str]) -> DataFrame:
    """The last text of each key that isn't empty."""
    return rows.where(F.coalesce(F.trim(text), F.lit("")) != "").groupBy(key).agg(F.max_by(text, F.struct(*order)).alias("description"))


def fold_source_refs(rows: DataFrame, key: str = "concept") -> DataFrame:
    """(concept, source_id): first and last sight, count, first task and excerpt that aren't empty."""
    first = lambda c: F.min_by(F.when(F.col(c) != "", F.col(c)), F.when(F.col(c) != "", F.struct("ts", "obs_id")))
    return rows.groupBy(key, "source_id").agg(F.min("ts").alias("first_seen_at"), F.max("ts").alias("last_seen_at"), F.count("*").alias("n"), first("task").alias("task"), first("excerpt").alias("excerpt"))


def fold_token_refs(rows: DataFrame, key: str = "concept") -> DataFrame:
    """(concept, token, source, task): count, first and last sight, role; `merged` where the token isn't the concept's name."""
    out = rows.groupBy(key, F.lower(F.trim("token")).alias("token"), "source", "task").agg(F.count("*").alias("n"), F.min("ts").alias("first_seen_at"), F.max("ts").alias("last_seen_at"), F.min_by("role", F.struct("ts", "obs_id")).alias("role"))
    return out.withColumn("merged", F.col("token") != F.lower(F.col(key)))


def adjust(x: Column, delta: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.01), x + F.coalesce(delta, F.lit(0.0))))


def refine_type(edges: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """edges with the axis that `changes` (id, new_axis) gives."""
    return edges.join(changes, key, "left").withColumn("axis", F.coalesce("new_axis", "axis")).drop("new_axis")


def contradict(contradictions: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """contradictions (src, tgt, axis, ts, obs_id): weaken the edge of that pair and axis, or else both ends.

    Returns (edge events: low, high, axis, ...; concept events: concept, ...), all of kind weaken.
    """
    rows = contradictions.withColumn("low", F.least("src", "tgt")).withColumn("high", F.greatest("src", "tgt"))
    known = edges.select(F.least("source_id", "target_id").alias("low"), F.greatest("source_id", "target_id").alias("high"), "axis").distinct()
    hit = rows.join(known, ["low", "high", "axis"], "left_semi").withColumn("kind", F.lit("weaken"))
    miss = rows.join(known, ["low", "high", "axis"], "left_anti")
    ends = miss.select(F.explode(F.array("src", "tgt")).alias("concept"), "ts", "obs_id", F.lit("weaken").alias("kind"))
    return hit.select("low", "high", "axis", "ts", "obs_id", "kind"), ends
