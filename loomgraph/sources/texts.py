"""Source records, their index and search; pages and links; responses with extracted concepts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import host, source_tokens, strip


def record_sources(texts: DataFrame) -> DataFrame:
    """texts (raw_text, source, task) -> one source for each id: the hash of task, source and text."""
    raw = F.coalesce("raw_text", F.lit(""))
    name = F.substring(F.sha2(F.concat_ws("\n", strip(F.col("task")), strip(F.col("source")), raw), 256), 1, 16)
    rows = texts.select(name.alias("id"), raw.alias("raw_text"), F.sha2(raw, 256).alias("content_hash"), strip(F.col("source")).alias("source"), strip(F.col("task")).alias("task"))
    return rows.dropDuplicates(["id"])


def insert_sources(stored: DataFrame, texts: DataFrame) -> DataFrame:
    """stored with the sources it doesn't have yet; known ones stay as they are."""
    return stored.unionByName(record_sources(texts).join(stored.select("id"), "id", "left_anti"), allowMissingColumns=True)


def attach_extraction(sources: DataFrame, observations: DataFrame) -> DataFrame:
    """sources with the distinct concepts and the number of relations of their observation (source_id, concepts, relations)."""
    got = observations.select(F.col("source_id").alias("id"), F.array_distinct(F.filter("concepts", lambda c: strip(c) != "")).alias("concepts"), F.size("relations").alias("relation_count"))
    return sources.join(got, "id", "left")


def build_source_index(sources: DataFrame) -> DataFrame:
    """(token, id): an inverted index of the words of each source."""
    return sources.select("id", F.explode(source_tokens(F.col("raw_text"))).alias("token"))


def _grams(c):  # noqa: ANN001, ANN202
    """The distinct runs of two and three characters of a text."""
    at = F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1)))
    return F.array_distinct(F.filter(F.concat(F.transform(at, lambda i: F.substring(c, i, F.lit(2))), F.transform(at, lambda i: F.substring(c, i, F.lit(3)))), lambda g: F.length(g) >= 2))


def search_sources(index: DataFrame, sources: DataFrame, queries: DataFrame, limit: int = 10) -> DataFrame:
    """(query_id, rank, id, score): how many words of the query the source has, plus how many are part of its concepts' names; the best
    first, then the newest (where there is updated_at), ties by id.

    Names are looked up by the first three characters of a word (two of a shorter one) in an index of the names' character runs,
    then compared.
    """
    words = queries.select("query_id", F.explode(source_tokens(F.col("text"))).alias("token"))
    score = words.join(index, "token").groupBy("query_id", "id").agg(F.count("*").alias("score"))
    if "concepts" in sources.columns:
        names = sources.select(F.lower(F.array_join("concepts", " ")).alias("names"), "id").where("names <> ''")
        different = names.select("names").distinct()
        spots = different.select("names", F.explode(_grams(F.col("names"))).alias("g"))
        tokens = words.select("token").distinct().withColumn("g", F.substring("token", 1, 3))
        inside = tokens.join(spots, "g").where(F.col("names").contains(F.col("token"))).select("token", "names")
        more = words.join(inside, "token").join(names, "names").groupBy("query_id", "id").agg(F.count("*").alias("score"))
        score = score.union(more).groupBy("query_id", "id").agg(F.sum("score").alias("score"))
    order = [F.desc("score"), "id"]
    if "updated_at" in sources.columns:
        score, order = score.join(sources.select("id", "updated_at"), "id"), [F.desc("score"), F.desc("updated_at"), "id"]
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return score.withColumn("rank", rank).where(F.col("rank") <= limit)


def split_texts(df: DataFrame, text: str = "text", sep: str = "===") -> DataFrame:
    """Each text in pieces: trimmed, without empty ones, numbered as batch_i."""
    parts = F.filter(F.transform(F.split(text, sep), strip), lambda p: p != "")
    rest = [c for c in df.columns if c != text]
    return df.select(*rest, F.posexplode(parts).alias("i", "chunk")).select(*rest, F.concat(F.lit("batch_"), F.col("i")).alias("source"), "chunk")


# Named character references; &amp; comes last.
ENTITIES = {
    "&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&cent;": "¢", "&pound;": "£", "&yen;": "¥", "&euro;": "€", "&sect;": "§", "&copy;": "©", "&reg;": "®",
    "&trade;": "™", "&deg;": "°", "&plusmn;": "±", "&middot;": "·", "&para;": "¶", "&laquo;": "«", "&raquo;": "»", "&ndash;": "–", "&mdash;": "—", "&lsquo;": "‘", "&rsquo;": "’",
    "&ldquo;": "“", "&rdquo;": "”", "&bull;": "•", "&hellip;": "…", "&times;": "×", "&divide;": "÷", "&szlig;": "ß", "&auml;": "ä", "&ouml;": "ö", "&uuml;": "ü", "&Auml;": "Ä",
    "&Ouml;": "Ö", "&Uuml;": "Ü", "&eacute;": "é", "&egrave;": "è", "&agrave;": "à", "&ccedil;": "ç", "&ntilde;": "ñ", "&amp;": "&",
}


def _unescaped(c):  # noqa: ANN001, ANN202
    """Character references by name and by number as the characters they stand for; numbers beyond Unicode stay as they are."""
    parts = F.regexp_extract_all(c, F.lit("(?s)(&#[0-9]{1,7};|&#[xX][0-9a-fA-F]{1,6};|[^&]+|&)"), F.lit(1))

    def char(x):  # noqa: ANN001, ANN202
        digits = F.regexp_extract(x, "^&#[xX]?([0-9a-fA-F]+);$", 1)
        code = F.when(F.lower(x).startswith("&#x"), F.conv(digits, 16, 10)).otherwise(digits).cast("int")
        known = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        return F.when(F.coalesce(known, F.lit(False)), F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(x)

    c = F.when(c.contains("&#"), F.array_join(F.transform(parts, char), "")).otherwise(c)
    for name, char_ in ENTITIES.items():
        c = F.replace(c, F.lit(name), F.lit(char_))
    return c


def extract_page_text(pages: DataFrame, max_chars: int | None = 12000) -> DataFrame:
    """pages with title and text: no scripts, styles, comments and tags, white space collapsed, a mark where it is cut (not with None)."""
    html = F.coalesce("html", F.lit(""))
    title = F.trim(F.regexp_replace(_unescaped(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), r"\s+", " "))
    body = F.regexp_replace(html, r"(?is)<(script|style|noscript)\b.*?</\1\s*>|<!--.*?-->", " ")
    text = F.trim(F.regexp_replace(_unescaped(F.regexp_replace(body, r"(?s)<[^>]*>", " ")), r"\s+", " "))
    short = text if max_chars is None else F.when(F.length(text) > max_chars, F.concat(F.rtrim(F.substring(text, 1, max_chars)), F.lit(" [truncated]"))).otherwise(text)
    return pages.select("page_id", "url", F.when(title == "", F.col("url")).otherwise(title).alias("title"), short.alias("text"))


ANCHOR = r"(?is)<a\b[^>]*\bhref\s*=\s*[\"'][^\"']+[\"'][^>]*>.*?</a>"


def _plain(c):  # noqa: ANN001, ANN202
    return F.trim(F.regexp_replace(_unescaped(F.regexp_replace(c, r"(?s)<[^>]*>", " ")), r"\s+", " "))


def extract_links(pages: DataFrame, limit: int | None = 5, snippet: int = 160) -> DataFrame:
    """(page_id, rank, href, label, domain, snippet): the first different links of each page in order (all of them with None); the snippet is the
    text from the link to the next one."""
    anchors = F.regexp_extract_all("html", F.lit(f"({ANCHOR})"), F.lit(1))
    rows = pages.select("page_id", "url", F.split("html", ANCHOR).alias("after"), F.posexplode(anchors).alias("pos", "a"))
    href = F.regexp_extract("a", r"(?is)\bhref\s*=\s*[\"']([^\"']+)[\"']", 1)
    near = F.substring(_plain(F.get("after", F.col("pos") + 1)), 1, snippet)
    rows = rows.select("page_id", "pos", href.alias("href"), _plain(F.col("a")).alias("label"), host(F.when(href.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*://"), href).otherwise(F.col("url"))).alias("domain"), F.coalesce(near, F.lit("")).alias("snippet"))
    first = rows.groupBy("page_id", "href").agg(F.min_by(F.struct("pos", "label", "domain", "snippet"), "pos").alias("f"))
    rank = F.row_number().over(Window.partitionBy("page_id").orderBy("f.pos"))
    out = first.select("page_id", "href", "f.label", "f.domain", "f.snippet", rank.alias("rank"))
    return out if limit is None else out.where(F.col("rank") <= limit)


def filter_by_domain(pages: DataFrame, domains: DataFrame) -> DataFrame:
    """pages whose host is one of the domains (domain) once both are normalised."""
    wanted = domains.select(host(F.col("domain")).alias("_d")).where("_d <> ''").distinct()
    return pages.join(wanted, host(F.col("url")) == F.col("_d"), "left_semi")


RESPONSE = "struct<concepts:array<string>,relations:array<string>,weakened:array<string>,contradicted_relations:array<string>,descriptions:map<string,string>,domain:string>"


def _parsed(responses: DataFrame) -> DataFrame:
    """(obs_id, j): the outermost object of each response, without code fences."""
    body = F.regexp_extract(F.regexp_replace(F.coalesce("raw", F.lit("")), "(?s)```(?:json)?", ""), r"(?s)(\{.*\})", 1)
    return responses.select("obs_id", F.from_json(body, RESPONSE).alias("j"))


def _field(c: str, k: str):  # noqa: ANN202
    return F.get_json_object(c, f"$.{k}")


def _concepts(json: DataFrame) -> DataFrame:
    c = json.select("obs_id", F.posexplode("j.concepts").alias("pos", "c"))
    whole = F.col("c").startswith("{")
    own = lambda k: F.when(whole, _field("c", k)).alias(k)
    named = F.when(whole, _field("c", "name")).otherwise(F.col("c"))
    return c.select("obs_id", "pos", F.trim(named).alias("name"), own("uid"), own("kind"), own("description"), F.when(whole, F.from_json(_field("c", "aliases"), "array<string>")).alias("aliases")).where("name <> ''")


def _refs(concepts: DataFrame) -> DataFrame:
    """(obs_id, ref, name): what a concept is called within its observation; the first one wins."""
    none = F.array().cast("array<string>")
    refs = concepts.select("obs_id", "pos", "name", F.explode(F.array_compact(F.concat(F.array("uid", "name"), F.coalesce("aliases", none)))).alias("r"))
    return refs.groupBy("obs_id", F.lower(F.trim("r")).alias("ref")).agg(F.min_by("name", "pos").alias("name"))


def _relations(json: DataFrame, column: str, refs: DataFrame) -> DataFrame:
    """(obs_id, source, target, label, dropped) of objects or lists of three."""
    r = json.select("obs_id", F.explode(f"j.{column}").alias("r"))
    part = lambda k, i: F.when(F.col("r").startswith("["), F.get_json_object("r", f"$[{i}]")).otherwise(_field("r", k))
    rel = r.select("obs_id", part("source", 0).alias("source"), part("target", 1).alias("target"), F.coalesce(part("label", 2), _field("r", "relation_type"), F.lit("related_to")).alias("label"))
    for end in ("source", "target"):
        side = refs.select("obs_id", F.col("ref").alias("_ref"), F.col("name").alias(f"{end}_name"))
        rel = rel.withColumn("_ref", F.lower(F.trim(end))).join(side, ["obs_id", "_ref"], "left").drop("_ref")
    gone = F.col("source_name").isNull() | F.col("target_name").isNull()
    return rel.select("obs_id", F.coalesce("source_name", "source").alias("source"), F.coalesce("target_name", "target").alias("target"), "label", gone.alias("dropped"))


def observations_from_responses(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """responses (obs_id, raw) -> (concepts: obs_id, name, uid, kind, description, aliases; relations: obs_id, source, target, label, dropped).

    Code fences go and the outermost object is taken. A concept is a string or an object; its uid, name and aliases name it
    within the observation, the first one wins. A relation is an object or a list of three; one whose ends aren't
    concepts of the observation is marked dropped. Invalid JSON gives no rows.
    """
    json = _parsed(responses)
    concepts = _concepts(json)
    return concepts.drop("pos"), _relations(json, "relations", _refs(concepts))


def disconfirmations_from_responses(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """responses (obs_id, raw) -> (weakened: obs_id, name; contradicted: obs_id, source, target, label, dropped), under the names of their concepts
    where they name one; what is weakened may be a concept that the response doesn't list."""
    json = _parsed(responses)
    refs = _refs(_concepts(json))
    weak = json.select("obs_id", F.explode("j.weakened").alias("w")).withColumn("ref", F.lower(F.trim("w"))).where("ref <> ''")
    weak = weak.join(refs, ["obs_id", "ref"], "left").select("obs_id", F.coalesce("name", F.trim("w")).alias("name"))
    return weak.distinct(), _relations(json, "contradicted_relations", refs)


def response_report(responses: DataFrame) -> DataFrame:
    """(obs_id, valid, concepts, relations, weakened, contradicted): what each response holds, as counted before anything is resolved; invalid JSON is told."""
    json = _parsed(responses)
    size = lambda c: F.greatest(F.coalesce(F.size(f"j.{c}"), F.lit(0)), F.lit(0)).alias(c.replace("_relations", ""))
    any_ = F.coalesce("j.concepts", "j.relations", "j.weakened", "j.contradicted_relations").isNotNull()
    return json.select("obs_id", any_.alias("valid"), size("concepts"), size("relations"), size("weakened"), size("contradicted_relations"))
