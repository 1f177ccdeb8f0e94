"""Dialogue sessions: context windows, compaction, turn batches, recall.

messages: conv_id, turn, role, text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.scalars import STOPWORDS, excerpt, keyword_seeds, time_ago


def in_order() -> WindowSpec:
    return Window.partitionBy("conv_id").orderBy("turn")


def newest_first() -> WindowSpec:
    return Window.partitionBy("conv_id").orderBy(F.desc("turn"))


def needs_compaction(messages: DataFrame, threshold: int = 48, preserve: int = 16, min_new: int = 12) -> DataFrame:
    """(conv_id, n, needed) for sessions whose older messages would fill a summary; nothing is covered yet."""
    n = messages.groupBy("conv_id").agg(F.count("*").alias("n"))
    return n.select("conv_id", "n", ((F.col("n") > threshold) & (F.greatest(F.lit(0), F.col("n") - preserve) >= min_new)).alias("needed"))


def compact_sessions(messages: DataFrame, keep: int = 3, k: int = 6, turns: DataFrame | None = None, loops: int = 4) -> DataFrame:
    """(conv_id, goals, outcome, seeds, covered, open_loops): a summary without a model: last questions, last answer, key words, and of the turns
    (conv_id, turn, failure_class) the last ones that failed."""
    user = messages.where("role = 'user'").withColumn("r", F.row_number().over(newest_first()))
    goals = user.where(F.col("r") <= keep).groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", excerpt(F.col("text"), 120).alias("t")))), lambda x: x["t"]).alias("goals"))
    words = user.where("r <= 4").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", keyword_seeds(F.col("text"), 5).alias("w")))).alias("w"))
    seeds = words.select("conv_id", F.slice(F.array_distinct(F.flatten(F.transform("w", lambda x: x["w"]))), 1, k).alias("seeds"))
    last = messages.where("role = 'assistant'").groupBy("conv_id").agg(F.max_by(excerpt(F.col("text"), 160), "turn").alias("outcome"))
    n = messages.groupBy("conv_id").agg(F.count("*").alias("covered"))
    out = n.join(goals, "conv_id", "left").join(seeds, "conv_id", "left").join(last, "conv_id", "left")
    none = F.array().cast("array<string>")
    if turns is None:
        return out.withColumn("open_loops", none)
    failed = turns.where("failure_class <> 'none'").withColumn("r", F.row_number().over(newest_first())).where(F.col("r") <= loops)
    told = F.format_string("Turn %s ended with %s.", F.col("turn").cast("string"), "failure_class")
    open_ = failed.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", told.alias("t")))), lambda x: x["t"]).alias("open_loops"))
    return out.join(open_, "conv_id", "left").withColumn("open_loops", F.coalesce("open_loops", none))


def session_context(messages: DataFrame, summaries: DataFrame | None = None, most: int = 50, preserve: int = 16) -> DataFrame:
    """(conv_id, pos, role, content): a summary row where there is one, then the newest messages that fit, oldest first."""
    rows = messages.withColumns({"r": F.row_number().over(newest_first()), "n": F.count("*").over(Window.partitionBy("conv_id"))})
    if summaries is not None:
        rows = rows.join(summaries.select("conv_id", F.lit(True).alias("_c")), "conv_id", "left")
    used = F.coalesce(F.col("_c"), F.lit(False)) & (F.col("n") > preserve) if summaries is not None else F.lit(False)
    room = F.when(used, F.least(F.lit(preserve), F.lit(max(1, most - 1)))).otherwise(F.lit(max(1, most)))
    role = F.when(F.col("role") == "tool_result", "assistant").otherwise(F.col("role"))
    text = F.when(F.col("role") == "tool_result", F.concat(F.lit("[Tool Result] "), F.col("text"))).otherwise(F.col("text"))
    recent = rows.where((F.col("r") <= room) & F.col("role").isin("user", "assistant", "system", "tool_result")).select("conv_id", F.col("turn").alias("pos"), role.alias("role"), text.alias("content"))
    if summaries is None:
        return recent
    long = messages.groupBy("conv_id").agg(F.count("*").alias("n")).where(F.col("n") > preserve).select("conv_id")
    head = summaries.join(long, "conv_id", "left_semi").select("conv_id", F.lit(-1).cast("long").alias("pos"), F.lit("system").alias("role"), F.concat_ws(" | ", F.concat_ws("; ", "goals"), "outcome").alias("content"))
    return head.union(recent)


def list_sessions(messages: DataFrame, compacted: DataFrame | None = None, limit: int | None = 20, now: Column | None = None) -> DataFrame:
    """(conv_id, n, last_turn, last_role, state): the longest sessions first; limit is the listing's length, None for all of them.

    With `now` messages have a time ts: also (updated_at, age), the newest sessions first, those without a time last.
    """
    timed = [F.max("ts").alias("updated_at")] if now is not None else []
    out = messages.groupBy("conv_id").agg(F.count("*").alias("n"), F.max("turn").alias("last_turn"), F.max_by("role", "turn").alias("last_role"), *timed)
    state = F.when(F.col("last_role") == "user", "attention_needed").otherwise("active")
    if compacted is not None:
        out = out.join(compacted.select("conv_id", F.lit(True).alias("_c")), "conv_id", "left")
        state = F.when(F.col("last_role") == "user", "attention_needed").when(F.col("_c"), "compacted").otherwise("active")
    shown = [] if now is None else ["updated_at", time_ago(F.col("updated_at"), now).alias("age")]
    out = out.select("conv_id", "n", "last_turn", "last_role", state.alias("state"), *shown)
    first = F.desc("n") if now is None else F.desc_nulls_last("updated_at")
    return out if limit is None else out.orderBy(first, "conv_id").limit(limit)


def paired_turns(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, user, assistant): each user message with the assistant message right after it."""
    nxt = messages.select("conv_id", "turn", "role", "text", F.lead("role").over(in_order()).alias("r2"), F.lead("text").over(in_order()).alias("t2"))
    return nxt.where("role = 'user' and r2 = 'assistant'").select("conv_id", "turn", F.col("text").alias("user"), F.col("t2").alias("assistant"))


def batch_turns(messages: DataFrame, interval: int = 3) -> DataFrame:
    """(conv_id, batch, turns, document): every `interval` paired turns make one document; an incomplete batch stays pending."""
    t = paired_turns(messages).withColumn("batch", F.floor((F.row_number().over(in_order()) - 1) / interval))
    line = F.concat(F.lit("User: "), excerpt(F.col("user"), 2000), F.lit("\nAssistant: "), excerpt(F.col("assistant"), 3500))
    made = t.groupBy("conv_id", "batch").agg(F.count("*").alias("turns"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"]), "\n\n").alias("document"))
    return made.where(F.col("turns") == interval)


def lexical_recall(turns: DataFrame, queries: DataFrame, k: int = 4, recency: float = 0.02, phrase: str = "", bonus: float = 2.0) -> DataFrame:
    """(query_id, rank, turn_id, score): word overlap, a little for recency, a bonus for a phrase both have.

    turns: turn_id, idx, text; queries: query_id, text. Turns without a common word score by recency alone, so
    only as many of the newest ones are looked at as could be among the k best.
    """
    tokens = lambda c: F.array_distinct(F.filter(F.regexp_extract_all(F.lower(c), F.lit("[a-z][a-z0-9_/-]+"), F.lit(0)), lambda w: ~w.isin(STOPWORDS)))
    t = turns.select("turn_id", "idx", F.explode(tokens(F.col("text"))).alias("w"))
    hits = queries.select("query_id", F.explode(tokens(F.col("text"))).alias("w")).join(t, "w").groupBy("query_id", "turn_id", "idx").agg(F.count("*").alias("overlap"))
    newest = turns.orderBy(F.desc("idx"), "turn_id").limit(k).select("turn_id", "idx")
    rest = queries.select("query_id").join(F.broadcast(newest)).withColumn("overlap", F.lit(0).cast("long"))  # k rows for each query
    rows = hits.union(rest.select("query_id", "turn_id", "idx", "overlap")).groupBy("query_id", "turn_id", "idx").agg(F.max("overlap").alias("overlap"))
    score = F.col("overlap") + F.col("idx") * recency
    if phrase:
        rows = rows.join(queries.select("query_id", F.lower("text").contains(phrase).alias("_q")), "query_id").join(turns.select("turn_id", F.lower("text").contains(phrase).alias("_t")), "turn_id")
        score = score + F.when(F.col("_q") & F.col("_t"), bonus).otherwise(0.0)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "turn_id"))
    return rows.withColumn("score", score).where("score > 0").withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "turn_id", "score")
