"""Column expressions: names, tokens, identity keys, freshness, colour. All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that don't tell concepts apart.
STOPWORDS = [
    "a", "an", "the", "and", "or", "but", "if", "then", "of", "in", "on", "at", "to", "for", "with", "from", "by", "as", "is", "are", "was",
    "were", "be", "been", "being", "this", "that", "these", "those", "it", "its", "has", "have", "had", "not", "no", "do", "does", "did",
    "can", "will", "would", "should", "could", "may", "might", "than",
]
SALIENCE = ["core", "supporting", "background"]
#: Half-lives in hours that weigh freshness.
CONCEPT_HOURS, RELATION_HOURS = 168.0, 72.0


def strip(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")


def norm_identity(c: Column) -> Column:
    """Lower case; anything but letters and digits becomes one space."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def identity_key(name: Column, kind: Column, sense: Column, domain: Column, description: Column | None = None) -> Column:
    """ck_ and 16 hex digits that stand for name, kind, domain and sense; words of salience are no kind."""
    k = norm_identity(kind)
    k = F.when(k.isin(SALIENCE), "").otherwise(k)
    s = F.when(F.coalesce(sense, F.lit("")) == "", description).otherwise(sense) if description is not None else sense
    return F.concat(F.lit("ck_"), F.substring(F.sha1(F.concat_ws("\x1f", norm_identity(name), k, norm_identity(domain), norm_identity(s))), 1, 16))


def signature_tokens(*texts: Column) -> Column:
    """Distinct ASCII words of two characters or more, without stop words, sorted."""
    joined = F.lower(F.concat_ws(" ", *texts))
    words = F.filter(F.regexp_extract_all(joined, F.lit("[a-z0-9]+"), F.lit(0)), lambda w: F.length(w) >= 2)
    return F.array_sort(F.array_except(words, F.array(*map(F.lit, STOPWORDS))))


def source_tokens(text: Column) -> Column:
    """Distinct words of two characters or more in order of first sight."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: F.length(w) >= 2))


def representation_part(c: Column, fallback: str) -> Column:
    out = F.regexp_replace(F.regexp_replace(F.lower(strip(c)), r"[^\p{L}\p{N}_]+", "-"), "^-+|-+$", "")
    return F.when(out == "", fallback).otherwise(out)


def feature(name: Column, sense: Column, kind: Column, domain: Column, description: Column) -> Column:
    """The first telling one of sense, kind and domain; else a word of the description; else `concept`."""
    telling = lambda c: F.when(~norm_identity(c).isin(["", *SALIENCE]), norm_identity(c))
    words = F.array_min(F.array_except(signature_tokens(description), signature_tokens(name)))
    return F.coalesce(telling(sense), telling(kind), telling(domain), words, F.lit("concept"))


def representation(name: Column, uid: Column, sense: Column, kind: Column, domain: Column, description: Column) -> Column:
    parts = [representation_part(name, "concept"), representation_part(feature(name, sense, kind, domain, description), "concept"), representation_part(uid, "uid")]
    return F.concat_ws(".", *parts)


def hours_between(earlier: Column, later: Column) -> Column:
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / F.lit(3.6e9)


def concept_freshness(last: Column, as_of: Column, half_life: float = CONCEPT_HOURS, floor: float = 0.1) -> Column:
    h = hours_between(last, as_of)
    return F.when(h <= 0, 1.0).otherwise(F.greatest(F.lit(floor), F.pow(F.lit(0.5), h / half_life)))


def relation_freshness(last: Column, as_of: Column, reinforcements: Column, half_life: float = RELATION_HOURS, floor: float = 0.15) -> Column:
    h = hours_between(last, as_of)
    return F.when(h <= 0, 1.0).otherwise(F.greatest(F.lit(floor), F.pow(F.lit(0.5), h / (half_life * (1 + 0.5 * reinforcements)))))


def evidence_balance(positive: Column, negative: Column) -> Column:
    """Mean of the Beta posterior over confirmations and disconfirmations."""
    return (1 + positive) / (2 + positive + negative)


def signature_similarity(a: Column, b: Column, domain_a: Column, domain_b: Column) -> Column:
    jaccard = F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))
    apart = (strip(domain_a) != "") & (strip(domain_b) != "") & (F.lower(strip(domain_a)) != F.lower(strip(domain_b)))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.when(apart, jaccard * 0.3).otherwise(jaccard))


def sorted_profile(profile: Column) -> Column:
    """The entries of a colour profile, strongest first, ties by label."""
    return F.array_sort(F.map_entries(profile), lambda x, y: F.when(x["value"] > y["value"], -1).when(x["value"] < y["value"], 1).when(x["key"] < y["key"], -1).otherwise(1))


def color_purity(profile: Column) -> Column:
    values = F.map_values(profile)
    total = F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
    return F.when(F.coalesce(F.size(values), F.lit(0)) <= 0, 1.0).when(total <= 0, 1.0).otherwise(F.array_max(values) / total)


def is_bridge(profile: Column, ratio: float = 0.55, least: float = 0.08) -> Column:
    values = F.sort_array(F.map_values(profile), asc=False)
    top, second = F.get(values, F.lit(0)), F.get(values, F.lit(1))
    return F.coalesce((top > 0) & (second >= least) & (second / top >= ratio), F.lit(False))


def _byte(digest: Column, i: int) -> Column:
    return F.conv(F.substring(digest, 2 * i + 1, 2), 16, 10).cast("int")


def label_color(label: Column, spread: float = 0.15, empty: str = "#64748b") -> Column:
    """A colour that depends on the label alone: hue, saturation and lightness from its SHA-1."""
    d = F.sha1(F.lower(strip(label)))
    hue = F.pmod(_byte(d, 0) * 256 + _byte(d, 1), F.lit(360)) / 360.0
    s, light = 0.55 + _byte(d, 2) / 255.0 * spread, 0.48 + _byte(d, 3) / 255.0 * 0.12
    high = F.when(light <= 0.5, light * (1.0 + s)).otherwise(light + s - light * s)
    low = 2.0 * light - high

    def channel(shift: float) -> Column:
        h = F.pmod(hue + shift, F.lit(1.0))
        v = F.when(h < 1 / 6, low + (high - low) * h * 6.0).when(h < 0.5, high).when(h < 2 / 3, low + (high - low) * (2 / 3 - h) * 6.0).otherwise(low)
        return F.lpad(F.lower(F.hex(F.bround(v * 255).cast("int"))), 2, "0")

    color = F.concat(F.lit("#"), channel(1 / 3), channel(0.0), channel(-1 / 3))
    return F.when(strip(label) == "", empty).otherwise(color)


def normalize_domain_label(c: Column) -> Column:
    """A short lower-case domain: what stands before a colon if that is at most three words, 64 characters at most."""
    low = F.regexp_replace(F.lower(strip(c)), r"\s+", " ")
    head = F.substring_index(low, ":", 1)
    tail = F.substring(low, F.length(head) + 2, F.length(low))
    short = low.contains(":") & (head != "") & (F.size(F.split(F.trim(head), " ")) <= 3)
    low = F.when(short, F.when(F.trim(head) != "", F.trim(head)).otherwise(F.trim(tail))).otherwise(low)
    low = F.regexp_replace(F.regexp_replace(low, r"[^a-z0-9\x{4e00}-\x{9fff} _/-]+", ""), "^[ _/-]+|[ _/-]+$", "")
    return F.when(low.isin(["knowledge intake", "manual connection"]), "").otherwise(F.substring(low, 1, 64))


def excerpt(c: Column, limit: int) -> Column:
    """White space collapsed; a longer text is cut and ends in three dots."""
    flat = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, limit - 3)), F.lit("...")))


def keyword_seeds(query: Column, k: int = 5) -> Column:
    """The first k words of two characters or more that are not stop words; else all of more than three characters."""
    words = F.regexp_extract_all(F.lower(F.coalesce(query, F.lit(""))), F.lit(r"[a-z0-9]+|[\x{4e00}-\x{9fff}]+"), F.lit(0))
    telling = F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(STOPWORDS)))
    return F.when(F.size(telling) > 0, F.slice(telling, 1, k)).otherwise(F.array_distinct(F.filter(words, lambda w: F.length(w) > 3)))


def slugify(c: Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(out == "", "space").otherwise(out)


def has_task(tasks: Column, task: str) -> Column:
    """Whether any task contains the given one, whatever the case."""
    return F.exists(tasks, lambda t: F.lower(t).contains(task.strip().lower()))


def host(url: Column) -> Column:
    """The host of a URL without scheme, www., port and path."""
    return F.regexp_replace(F.regexp_extract(F.lower(strip(url)), r"^(?:[a-z][a-z0-9+.-]*://)?(?:www\.)?([^/?#:]*)", 1), r"^www\.", "")


def classify_failure(text: Column, context: Column) -> Column:
    """A failure class by context and keywords."""
    low, at = F.lower(F.coalesce(text, F.lit(""))), F.lower(F.coalesce(context, F.lit("")))
    fetch = F.when(at.isin("llm", "provider"), "provider_unavailable").otherwise("search_fetch_failed")
    rules = [
        (at == "session", "session_corrupt"),
        ((at == "mcp") | low.contains("mcp"), "mcp_unavailable"),
        (low.rlike("rate limit|429|quota"), "provider_rate_limit"),
        (low.rlike("api key|unauthorized|401|forbidden|authentication"), "provider_auth"),
        (low.rlike("timeout|timed out|connection|503|bad gateway|temporarily unavailable"), fetch),
        (at.isin("search", "fetch"), "search_fetch_failed"),
        (low.rlike("chat failed|api call failed"), "llm_error"),
        (at == "tool", "tool_runtime"),
    ]
    return F.coalesce(*[F.when(when, name) for when, name in rules], F.lit("unknown"))


# What helps against each class of failure; the others have nothing.
RECOVERY = {
    "llm_error": ["retry_same_operation"],
    "provider_auth": ["reconfigure_provider"],
    "provider_rate_limit": ["retry_same_operation"],
    "provider_unavailable": ["retry_same_operation"],
    "tool_runtime": ["retry_same_operation"],
    "mcp_unavailable": ["check_mcp_servers"],
    "search_fetch_failed": ["retry_without_focus", "retry_without_domains"],
    "session_corrupt": ["start_new_session"],
    "tool_round_limit": ["manual_compact"],
}


def recovery_actions(failure: Column) -> Column:
    """An array of what to do about a class of failure, the first thing first; empty for none, unknown and null."""
    known = F.create_map(*[x for name, actions in RECOVERY.items() for x in (F.lit(name), F.array(*map(F.lit, actions)))])
    return F.coalesce(F.element_at(known, failure), F.array().cast("array<string>"))


def time_ago(at: Column, now: Column) -> Column:
    """How long ago `at` was: minutes below an hour, hours below a day, else days, rounded down; null without a time."""
    minutes = F.floor((F.unix_micros(now) - F.unix_micros(at)) / F.lit(60_000_000))
    text = lambda n, unit: F.concat(F.floor(n).cast("string"), F.lit(f"{unit} ago"))
    return F.when(minutes < 60, text(minutes, "m")).when(minutes < 1440, text(minutes / 60, "h")).otherwise(text(minutes / 1440, "d"))


def is_retryable(failure: Column) -> Column:
    return failure.isin("llm_error", "provider_rate_limit", "provider_unavailable", "tool_runtime", "mcp_unavailable", "search_fetch_failed")
