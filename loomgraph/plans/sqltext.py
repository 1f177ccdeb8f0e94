"""Pieces of SQL that several oracles share: white space, excerpts, stop words, key words."""

from __future__ import annotations

from ..functions.scalars import STOPWORDS

SQUEEZE = r"trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))"
CUT = lambda n: f"CASE WHEN length({SQUEEZE}) <= {n} THEN {SQUEEZE} ELSE rtrim(substr({SQUEEZE}, 1, {n - 3})) || '...' END"
STOPS = "[" + ", ".join(f"'{w}'" for w in sorted(STOPWORDS) if "'" not in w) + "]"
WORDS = r"regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+|[\x{4e00}-\x{9fff}]+')"
TELLING = f"list_filter({WORDS}, lambda w: length(w) >= 2 AND NOT list_contains({STOPS}, w))"
FIRST = "list_transform(list_filter(list_zip({0}, range(1, len({0}) + 1)), lambda p: list_position({0}, p[1]) = p[2]), lambda p: p[1])"  # distinct, in order
SEEDS = f"CASE WHEN len({TELLING}) > 0 THEN (" + FIRST.format(TELLING) + ")[1:5] ELSE " + FIRST.format(f"list_filter({WORDS}, lambda w: length(w) > 3)") + " END"
