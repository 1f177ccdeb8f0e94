"""Queries on sources, pages, sessions and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import sessions as D
from ..scratch import folder
from ..sources import tables as B
from ..sources import texts as T
from ..streaming import streams as I
from .registry import Inputs, query
from .sqltext import CUT, FIRST, SEEDS, STOPS

SOURCE = """src AS (SELECT DISTINCT substr(sha256(trim(lang) || chr(10) || trim(source) || chr(10) || text), 1, 16) AS id, sha256(text) AS content_hash, source, lang AS task, text FROM documents)"""


def _sources(t: Inputs):
    return T.record_sources(t.documents.select(F.col("text").alias("raw_text"), "source", F.col("lang").alias("task")))


@query("a04_record_sources", f"WITH {SOURCE} SELECT id, content_hash, source, task FROM src")
def record(t: Inputs):
    return _sources(t).select("id", "content_hash", "source", "task")


@query("a04_insert_sources", f"WITH {SOURCE} SELECT id, source = 'src0' AS known FROM src")
def insert(t: Inputs):
    """All texts onto a table that has those of one source: known ones stay as they are."""
    texts = t.documents.select(F.col("text").alias("raw_text"), "source", F.col("lang").alias("task"))
    stored = T.record_sources(texts.where("source = 'src0'")).withColumn("known", F.lit(True))
    return T.insert_sources(stored, texts).select("id", F.coalesce("known", F.lit(False)).alias("known"))


@query("a05_attach_extraction", f"WITH {SOURCE} SELECT id, CASE WHEN source = 'src0' THEN NULL ELSE [task, source] END AS concepts, CASE WHEN source = 'src0' THEN NULL ELSE 2 END AS relation_count FROM src")
def attach(t: Inputs):
    s = _sources(t)
    obs = s.where("source <> 'src0'").select(F.col("id").alias("source_id"), F.array("task", "source", F.lit(" "), "task").alias("concepts"), F.array(F.lit(1), F.lit(2)).alias("relations"))
    return T.attach_extraction(s, obs).select("id", "concepts", "relation_count")


TOKENS = r"tok AS (SELECT DISTINCT id, w AS token FROM (SELECT id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS w FROM src) WHERE len(w) >= 2)"


@query("a06_build_source_index", f"WITH {SOURCE}, {TOKENS} SELECT token, count(*) AS sources FROM tok GROUP BY 1")
def index(t: Inputs):
    return T.build_source_index(_sources(t)).groupBy("token").agg(F.count("*").alias("sources"))


@query("a07_search_sources", f"""WITH {SOURCE}, {TOKENS}, q AS (SELECT item_id AS query_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'), lambda x: len(x) >= 2))) AS token FROM benchmark),
    c AS (SELECT id, CASE WHEN source <> 'src0' THEN lower(task || ' ' || source || ' the text of ' || source) END AS names FROM src),
    s AS (SELECT query_id, id, count(*) AS score FROM (SELECT query_id, id FROM q JOIN tok USING (token) UNION ALL SELECT query_id, id FROM q JOIN c ON contains(names, token)) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) SELECT query_id, rank, id, score FROM r WHERE rank <= 10""")
def search(t: Inputs):
    s = _sources(t)
    obs = s.where("source <> 'src0'").select(F.col("id").alias("source_id"), F.array("task", "source", F.concat(F.lit("The text of "), "source")).alias("concepts"), F.array(F.lit(1)).alias("relations"))
    return T.search_sources(T.build_source_index(s), T.attach_extraction(s, obs), t.benchmark.select(F.col("item_id").alias("query_id"), "text")).select("query_id", "rank", "id", "score")


@query("a09_extract_page_text")
def page_text(t: Inputs):
    return T.extract_page_text(t.pages)


@query("a10_extract_links")
def links(t: Inputs):
    return T.extract_links(t.pages)


@query("a09_page_text_whole")
def whole_page_text(t: Inputs):
    return T.extract_page_text(t.pages, None)


@query("a10_all_links")
def all_links(t: Inputs):
    return T.extract_links(t.pages, None)


@query("a11_filter_by_domain", r"SELECT page_id FROM pages WHERE regexp_extract(lower(url), '^(?:[a-z][a-z0-9+.-]*://)?(?:www\.)?([^/?#:]*)', 1) IN (SELECT DISTINCT regexp_extract(lower(url), '^(?:[a-z][a-z0-9+.-]*://)?(?:www\.)?([^/?#:]*)', 1) FROM pages WHERE url LIKE 'https%')")
def by_domain(t: Inputs):
    return T.filter_by_domain(t.pages, t.pages.where("url like 'https%'").select(F.col("url").alias("domain"))).select("page_id")


@query("a12_observations_from_responses", "SELECT event_id AS obs_id, 'u' || user_id AS source, event_type AS target, 'related_to' AS label, false AS dropped FROM events")
def responses(t: Inputs):
    e = t.events
    raw = F.format_string('Here: ```json\n{"concepts": ["%s", {"name": "u%s", "uid": "x1", "kind": "user"}], "relations": [["X1", "%s"]]}\n```', "event_type", F.col("user_id").cast("string"), "event_type")
    _, rel = T.observations_from_responses(e.select(F.col("event_id").alias("obs_id"), raw.alias("raw")))
    return rel


SHAPES = """(SELECT event_id, user_id, event_type, event_id % 5 AS k FROM events)"""


def _shapes(t: Inputs):
    """Responses of several shapes: strings and objects, lists and objects, fences, ends that are no concepts, broken JSON."""
    e, k = t.events, F.col("event_id") % 5
    user, kind = F.concat(F.lit("u"), "user_id"), F.col("event_type")
    put = lambda text: F.replace(F.replace(F.lit(text), F.lit("USER"), user), F.lit("KIND"), kind)
    raw = F.when(k == 0, put('{"concepts": ["KIND", "USER"], "weakened": ["Kind", "USER"], "contradicted_relations": [["USER", "KIND", "supports"]]}'.replace("Kind", "KIND")))
    raw = raw.when(k == 1, put('Here: ```json\n{"concepts": [{"name": "KIND", "uid": "x1", "aliases": ["it"]}, "USER"], "weakened": ["X1", "stranger"], "contradicted_relations": [{"source": "it", "target": "USER", "label": "part_of"}]}\n```'))
    raw = raw.when(k == 2, put('{"concepts": ["USER"], "contradicted_relations": [["USER", "nobody", "supports"]]} and more'))
    raw = raw.when(k == 3, put('{"concepts": [broken')).otherwise(put('{"concepts": ["KIND"], "relations": [], "weakened": []}'))
    return e.select(F.col("event_id").alias("obs_id"), raw.alias("raw"))


@query("a12_weakened", f"""SELECT event_id AS obs_id, event_type AS name FROM {SHAPES} WHERE k IN (0, 1) UNION ALL SELECT event_id, 'u' || user_id FROM {SHAPES} WHERE k = 0 UNION ALL SELECT event_id, 'stranger' FROM {SHAPES} WHERE k = 1""")
def weakened(t: Inputs):
    return T.disconfirmations_from_responses(_shapes(t))[0]


@query("a12_contradicted", f"""SELECT event_id AS obs_id, 'u' || user_id AS source, event_type AS target, 'supports' AS label, false AS dropped FROM {SHAPES} WHERE k = 0
    UNION ALL SELECT event_id, event_type, 'u' || user_id, 'part_of', false FROM {SHAPES} WHERE k = 1 UNION ALL SELECT event_id, 'u' || user_id, 'nobody', 'supports', true FROM {SHAPES} WHERE k = 2""")
def contradicted(t: Inputs):
    return T.disconfirmations_from_responses(_shapes(t))[1]


@query("a12_response_report", f"""SELECT event_id AS obs_id, k <> 3 AS valid, CASE k WHEN 0 THEN 2 WHEN 1 THEN 2 WHEN 3 THEN 0 ELSE 1 END AS concepts, 0 AS relations, CASE WHEN k < 2 THEN 2 ELSE 0 END AS weakened, CASE WHEN k < 3 THEN 1 ELSE 0 END AS contradicted FROM {SHAPES}""")
def report(t: Inputs):
    return T.response_report(_shapes(t))


@query("a13_split_texts", r"SELECT doc_id, 'batch_' || i AS source, md5(x) AS chunk FROM (SELECT doc_id, unnest(l) AS x, unnest(range(len(l))) AS i FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda s: trim(s)), lambda s: s <> '') AS l FROM documents))")
def split(t: Inputs):
    return T.split_texts(t.documents.select("doc_id", "text"), sep="\n").select("doc_id", "source", F.md5("chunk").alias("chunk"))


@query("a02_world_snapshot", "SELECT id, confidence, maturity, domain FROM {concepts}")
def snapshot(t: Inputs):
    at = f"{folder(t.spark)}/world-{uuid.uuid4().hex}"
    B.write_world({"concepts": t.concepts.withColumn("space_id", F.lit("main"))}, at, 1)
    return B.read_world(t.spark, at, ["concepts"], 1)["concepts"].select("id", "confidence", "maturity", "domain")


@query("a01_read_observations", "SELECT obs_id::VARCHAR AS obs_id, task, '' AS domain, count(*) AS n FROM {mentions} GROUP BY 1, 2")
def observations(t: Inputs):
    at = f"{folder(t.spark)}/observations-{uuid.uuid4().hex}"
    t.mentions.groupBy(F.col("obs_id").cast("string").alias("obs_id"), "ts", "task").agg(F.collect_list("concept").alias("concepts")).write.json(at)
    return B.read_observations(t.spark, at).select("obs_id", "task", "domain", F.size("concepts").cast("long").alias("n"))


@query("a08_export_graph", """WITH d AS (SELECT id, count(*) AS connections FROM (SELECT unnest([source_id, target_id]) AS id FROM {edges}) GROUP BY 1), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY strength DESC, label) AS r FROM {colors}),
    p AS (SELECT id, round(max(strength), 4) AS domain_strength, array_to_string(list(label || '=' || printf('%.4f', strength) ORDER BY r) FILTER (r <= 6), ';') AS profile FROM k GROUP BY 1), t AS (SELECT concept AS id, array_to_string(list_sort(list(DISTINCT task))[1:10], ';') AS tasks, array_to_string(list_sort(list(DISTINCT obs_id % 7))[1:10], ';') AS sources FROM {mentions} GROUP BY 1)
    SELECT id, domain, replace(lower(id), '#', '-') || '.' || regexp_replace(regexp_replace(lower(domain), '[^a-z0-9_]+', '-', 'g'), '^-+|-+$', '', 'g') || '.' || id AS representation, round(confidence, 4) AS confidence, maturity, activation_count, coalesce(connections, 0) AS connections, strftime(last_activated, '%Y-%m-%d %H:%M') AS last_activated,
        domain_strength, profile, tasks, sources FROM {concepts} LEFT JOIN d USING (id) LEFT JOIN p USING (id) LEFT JOIN t USING (id)""")
def export(t: Inputs):
    log = t.by_concept(t.mentions.select("concept", "task", (F.col("obs_id") % 7).cast("string").alias("source")))
    nodes = B.export_nodes(t.concepts.withColumn("name", F.col("id")), t.edges, t.colors, log)
    shown = F.array_join(F.transform("domain_profile", lambda x: F.concat(x["domain"], F.lit("="), F.format_string("%.4f", x["strength"]))), ";")
    return nodes.select("id", "domain", "representation", "confidence", "maturity", "activation_count", "connections", "last_activated", "domain_strength", shown.alias("profile"), F.array_join("tasks", ";").alias("tasks"), F.array_join("sources", ";").alias("sources"))


@query("a08_export_edges", "SELECT source_id AS source, target_id AS target, axis AS relation_type, is_explicit, reinforcement_count, round(weight, 4) AS weight, round(probability, 4) AS probability, round(e.confidence, 4) AS confidence, upper(a.id) AS source_name, upper(b.id) AS target_name FROM {edges} e JOIN {concepts} a ON a.id = source_id JOIN {concepts} b ON b.id = target_id WHERE a.domain <> 'Brand#2' AND b.domain <> 'Brand#2'")
def export_edges(t: Inputs):
    return B.export_edges(t.concepts.where("domain <> 'Brand#2'").withColumn("name", F.upper("id")), t.edges)


@query("e07_needs_compaction", "SELECT conv_id, count(*) AS n, count(*) > 6 AND greatest(0, count(*) - 3) >= 2 AS needed FROM conversations GROUP BY 1")
def needs(t: Inputs):
    return D.needs_compaction(t.conversations, threshold=6, preserve=3, min_new=2)


@query("e06_session_context", "SELECT conv_id, turn AS pos, role, text AS content FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 4 AND role IN ('user', 'assistant', 'system')")
def context(t: Inputs):
    return D.session_context(t.conversations, most=4)


def _failures(t: Inputs):
    """Turns whose text speaks of an error count as failed."""
    return t.conversations.select("conv_id", "turn", F.when(F.col("turn") % 3 == 2, "llm_error").otherwise("none").alias("failure_class"))


SUMMARY = f"""u AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations WHERE role = 'user'),
    g AS (SELECT conv_id, list({CUT(120)} ORDER BY turn) AS goals FROM u WHERE r <= 3 GROUP BY 1), w AS (SELECT conv_id, flatten(list({SEEDS} ORDER BY turn)) AS w FROM u WHERE r <= 4 GROUP BY 1),
    k AS (SELECT conv_id, ({FIRST.format('w')})[1:6] AS seeds FROM w), o AS (SELECT conv_id, arg_max({CUT(160)}, turn) AS outcome FROM conversations WHERE role = 'assistant' GROUP BY 1),
    f AS (SELECT conv_id, list('Turn ' || turn || ' ended with llm_error.' ORDER BY turn) AS open_loops FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations WHERE turn % 3 = 2) WHERE r <= 4 GROUP BY 1),
    z AS (SELECT conv_id, covered, goals, seeds, outcome, coalesce(open_loops, []) AS open_loops FROM (SELECT conv_id, count(*) AS covered FROM conversations GROUP BY 1) LEFT JOIN g USING (conv_id) LEFT JOIN k USING (conv_id) LEFT JOIN o USING (conv_id) LEFT JOIN f USING (conv_id))"""


@query("e08_compact_sessions", f"WITH {SUMMARY} SELECT * FROM z")
def compact(t: Inputs):
    return D.compact_sessions(t.conversations, turns=_failures(t))


@query("e06_session_context_compacted", f"""WITH {SUMMARY}, n AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations JOIN n USING (conv_id))
    SELECT conv_id, turn AS pos, CASE WHEN role = 'tool_result' THEN 'assistant' ELSE role END AS role, text AS content FROM r WHERE r <= CASE WHEN n > 3 THEN 3 ELSE 6 END AND role IN ('user', 'assistant', 'system')
    UNION ALL SELECT conv_id, -1, 'system', concat_ws(' | ', coalesce(array_to_string(goals, '; '), ''), outcome) FROM z JOIN n USING (conv_id) WHERE n > 3""")
def compacted_context(t: Inputs):
    return D.session_context(t.conversations, D.compact_sessions(t.conversations), most=6, preserve=3)


@query("e09_session_states", "SELECT conv_id, count(*) AS n, max(turn) AS last_turn, arg_max(role, turn) AS last_role, CASE WHEN arg_max(role, turn) = 'user' THEN 'attention_needed' WHEN count(*) > 6 AND greatest(0, count(*) - 3) >= 2 THEN 'compacted' ELSE 'active' END AS state FROM conversations GROUP BY 1")
def states(t: Inputs):
    """All sessions; those that need a compaction count as compacted."""
    return D.list_sessions(t.conversations, D.needs_compaction(t.conversations, threshold=6, preserve=3, min_new=2).where("needed"), None)


@query("e09_list_sessions", "SELECT conv_id, count(*) AS n, max(turn) AS last_turn, arg_max(role, turn) AS last_role, CASE WHEN arg_max(role, turn) = 'user' THEN 'attention_needed' ELSE 'active' END AS state FROM conversations GROUP BY 1 ORDER BY n DESC, conv_id LIMIT 20")
def listing(t: Inputs):
    return D.list_sessions(t.conversations)


SENT = "m AS (SELECT c.conv_id, turn, role, ts FROM conversations c LEFT JOIN events e ON e.event_id = c.conv_id * 10 + c.turn)"


@query("e09_newest_sessions", f"""WITH {SENT}, s AS (SELECT conv_id, count(*) AS n, max(turn) AS last_turn, arg_max(role, turn) AS last_role, max(ts) AS updated_at FROM m GROUP BY 1),
    a AS (SELECT *, (epoch_us((SELECT max(ts) FROM m)) - epoch_us(updated_at)) // 60000000 AS past FROM s)
    SELECT conv_id, n, last_turn, last_role, CASE WHEN last_role = 'user' THEN 'attention_needed' ELSE 'active' END AS state, updated_at,
        CASE WHEN past < 60 THEN past || 'm ago' WHEN past < 1440 THEN past // 60 || 'h ago' ELSE past // 1440 || 'd ago' END AS age FROM a ORDER BY updated_at DESC NULLS LAST, conv_id LIMIT 50""")
def newest(t: Inputs):
    """Messages sent at the times of events: the newest sessions first, with their age at the last message."""
    sent = t.events.select(F.col("event_id").alias("_at"), F.col("ts").cast("timestamp").alias("ts"))
    messages = t.conversations.withColumn("_at", F.col("conv_id") * 10 + F.col("turn")).join(sent, "_at", "left")
    out = D.list_sessions(messages, None, 50, F.lit(messages.agg(F.max("ts")).first()[0]))
    return out.withColumn("updated_at", F.col("updated_at").cast("timestamp_ntz"))


@query("e10_batch_turns", r"""WITH p AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS r2, lead(text) OVER w AS t2 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), t AS (SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 2 AS batch FROM p WHERE role = 'user' AND r2 = 'assistant')
    SELECT conv_id, batch, count(*) AS turns FROM t GROUP BY 1, 2 HAVING count(*) = 2""")
def batches(t: Inputs):
    return D.batch_turns(t.conversations, 2).select("conv_id", "batch", "turns")


LEXICAL = f"list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z][a-z0-9_/-]+'), lambda w: NOT list_contains({STOPS}, w)))"


@query("j06_lexical_recall", f"""WITH t AS (SELECT conv_id || '-' || turn AS turn_id, turn AS idx, unnest({LEXICAL}) AS w FROM conversations), q AS (SELECT item_id AS query_id, unnest({LEXICAL}) AS w FROM benchmark),
    h AS (SELECT query_id, turn_id, idx, count(*) AS overlap FROM q JOIN t USING (w) GROUP BY ALL), z AS (SELECT item_id AS query_id, turn_id, idx, 0 AS overlap FROM benchmark, (SELECT conv_id || '-' || turn AS turn_id, turn AS idx FROM conversations ORDER BY turn DESC, 1 LIMIT 4)),
    a AS (SELECT query_id, turn_id, idx, max(overlap) AS overlap FROM (SELECT * FROM h UNION ALL SELECT * FROM z) GROUP BY ALL), s AS (SELECT query_id, turn_id, overlap + idx * 0.02::DOUBLE AS score FROM a),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, turn_id) AS rank FROM s WHERE score > 0) SELECT query_id, rank, turn_id, round(score, 6) AS score FROM r WHERE rank <= 4""")
def recall(t: Inputs):
    turns = t.conversations.select(F.concat_ws("-", "conv_id", "turn").alias("turn_id"), F.col("turn").alias("idx"), "text")
    return D.lexical_recall(turns, t.benchmark.select(F.col("item_id").alias("query_id"), "text")).withColumn("score", F.round("score", 6))


@query("i05_activity_windows", "SELECT concept, time_bucket(INTERVAL 1 DAY, ts) AS day, count(*) AS n FROM {evidence} GROUP BY 1, 2")
def activity(t: Inputs):
    return I.activity(t.evidence).select("concept", F.col("window.start").cast("timestamp_ntz").alias("day"), "n")


@query("i05_sliding_windows", """SELECT concept, time_bucket(INTERVAL 6 HOUR, ts) - k * INTERVAL 6 HOUR AS start, count(*) AS n FROM {evidence}, (SELECT unnest([0, 1, 2, 3]) AS k) GROUP BY 1, 2""")
def sliding(t: Inputs):
    """A day's activity, every six hours."""
    return I.activity(t.evidence, slide="6 hours").select("concept", F.col("window.start").cast("timestamp_ntz").alias("start"), "n")


@query("i05_sessions", """WITH g AS (SELECT concept, ts, coalesce(ts - lag(ts) OVER w > INTERVAL 6 HOUR, true) AS new FROM {evidence} WINDOW w AS (PARTITION BY concept ORDER BY ts)),
    s AS (SELECT concept, ts, sum(new::INT) OVER (PARTITION BY concept ORDER BY ts) AS s FROM g) SELECT concept AS source, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS until, count(*) AS n FROM s GROUP BY concept, s""")
def user_sessions(t: Inputs):
    """Each user's events without a pause of more than six hours."""
    own = t.evidence.select(F.col("concept").alias("source"), "ts")
    w = lambda c: F.col(f"session_window.{c}").cast("timestamp_ntz")
    return I.sessions(own, "6 hours").select("source", w("start").alias("start"), w("end").alias("until"), "n")


@query("i04_dedupe_sources", f"WITH {SOURCE} SELECT id FROM src")
def stream_dedupe(t: Inputs):
    """The documents as a stream, within one hour: each source once."""
    docs = I.table_stream(t.spark, t.sf_dir, "documents")
    texts = docs.select(F.col("text").alias("raw_text"), "source", F.col("lang").alias("task"), F.timestamp_seconds(F.col("doc_id") % 3600 + 1_700_000_000).alias("ts"))
    return I.collected(I.dedupe_sources(texts), "append").select("id")


@query("i01_stream_evidence", "SELECT concept, count(*) FILTER (kind = 'activate') AS activation_count, count(*) FILTER (kind = 'weaken') AS disconfirmation_count FROM {evidence} GROUP BY 1")
def stream(t: Inputs):
    """The events table as a stream: micro-batches fold into a table of counts that is written anew with each batch."""
    return I.stream_counts(t.spark, t.sf_dir)


@query("i04_stream_sources", f"WITH {SOURCE} SELECT id FROM src")
def stream_sources(t: Inputs):
    return I.stream_sources(t.spark, t.sf_dir)


@query("i02_stream_state", """WITH n AS (SELECT concept, ts, obs_id, kind, count(*) FILTER (kind = 'activate') OVER w AS a, count(*) FILTER (kind = 'weaken') OVER w AS k FROM {evidence} WINDOW w AS (PARTITION BY concept ORDER BY ts, obs_id ROWS UNBOUNDED PRECEDING)),
    l AS (SELECT concept, list(CASE WHEN kind = 'activate' THEN 6e-2 / (1 + 8e-2 * a) ELSE -6e-2 / (1 + 8e-2 * k) END ORDER BY ts, obs_id) AS d, count(*) AS n FROM n GROUP BY 1)
    SELECT concept, n, round(list_reduce(list_prepend(15e-2, d), lambda x, y: CASE WHEN y > 0 THEN least(1e0, x + y) ELSE greatest(1e-2, x + y) END), 4) AS confidence FROM l""")
def keyed_state(t: Inputs):
    """Confidences in Spark's keyed state; the last row of a concept is its result."""
    e = I.table_stream(t.spark, t.sf_dir, "events")
    kind = F.when(F.col("event_type") == "error", "weaken").otherwise("activate")
    rows = I.collected(I.evidence_state(e.select(F.concat(F.lit("u"), "user_id").alias("concept"), F.col("ts").cast("timestamp").alias("ts"), "event_id", kind.alias("kind"))), "update")
    last = rows.groupBy("concept").agg(F.max("n").alias("n"), F.max_by("confidence", "n").alias("confidence"))
    return last.select("concept", "n", F.round("confidence", 4).alias("confidence"))


@query("i03_pending_pairs", "SELECT l_partkey AS a, l_suppkey AS b, count(*) AS n FROM lineitem GROUP BY 1, 2")
def pending(t: Inputs):
    e = I.table_stream(t.spark, t.sf_dir, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), F.col("l_shipdate").cast("timestamp").alias("ts"))
    return I.collected(I.pending_pairs(e), "update").groupBy("a", "b").agg(F.max("n").alias("n"))


@query("i03_found_pairs", "SELECT l_partkey AS a, l_suppkey AS b, 2 AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) >= 2")
def found_pairs(t: Inputs):
    """Pairs that reach two sightings, in Spark's keyed state."""
    e = I.table_stream(t.spark, t.sf_dir, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), F.col("l_shipdate").cast("timestamp").alias("ts"))
    return I.collected(I.found_pairs(e), "append").select("a", "b", "n")


@query("i06_turn_batches", "SELECT conv_id, count(*) // 3 AS documents FROM conversations GROUP BY 1 HAVING count(*) >= 3")
def turn_batches(t: Inputs):
    e = I.table_stream(t.spark, t.sf_dir, "conversations").select("conv_id", "turn", "text")
    return I.collected(I.turn_batches(e), "append").groupBy("conv_id").agg(F.count("*").alias("documents"))
