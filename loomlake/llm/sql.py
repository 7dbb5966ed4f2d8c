"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

import hashlib
import re

from .license_texts import DIGESTS, NOTICES, SPELLINGS, TEXTS
from .quality import RULES, STOP_WORDS, STRIPPED

_GAP = r"[\x20\x09-\x0D]+"
_limit = {r.name: r for r in RULES}
_stop = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
_marks = STRIPPED.replace("'", "''")

QUALITY_SQL = f"""
WITH w AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '{_GAP}'), lambda x: x <> '') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls
  FROM documents
), i AS (
  SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS k FROM w WHERE len(ws) >= 3
), g AS (
  SELECT rid, k, count(*) OVER (PARTITION BY rid, ws[k], ws[k + 1], ws[k + 2]) AS c FROM i
), r AS (
  SELECT rid, count(DISTINCT k + d) AS n FROM g, (SELECT unnest([0, 1, 2]) AS d) WHERE c > 1 GROUP BY rid
), f AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words,
         length(regexp_replace(t, '{_GAP}', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines,
         len(list_filter(ws, lambda x: translate(lower(x), '{_marks}', '') IN ({_stop}))) AS n_stop
  FROM w LEFT JOIN r USING (rid)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words
            OR word_chars / greatest(n_words, 1) < {_limit["word_length"].least} OR word_chars / greatest(n_words, 1) > {_limit["word_length"].most}
            OR n_symbols / greatest(n_words, 1) > {_limit["symbols"].most}
            OR n_stop / greatest(n_words, 1) < {_limit["stop_words"].least}
            OR n_dup_lines / greatest(n_lines, 1) > {_limit["repeated_lines"].most}) AS kept
FROM f
"""


#: Lines of a holder, and lines of a licence's own text that begin alike, as RE2 writes them.
_HOLDER = "^(portions )?(c )?copyright( |$)|^(copyright|c)( c)?( by)? ?([0-9]{4}|year|yyyy)|^all rights reserved$"
_TEXT = "^(portions )?(c )?copyright (holders?|notices?|owners?|laws?|licen[cs]es?|licensed|statements?|interests?|treaty|protection|and|or|in|is|to|of|on|for|as|may)( |$)"


def canonical(text: str) -> str:
    """The canonical form of a known text, worked out apart from the operator."""
    x = re.sub(r"[^a-z0-9\n]+", " ", text.lower().replace("©", " copyright "))
    for old, new in SPELLINGS:
        x = re.sub(rf"\b{old}\b", new, x)
    lines = [s.strip(" ") for s in x.split("\n")]
    return " ".join(s for s in lines if s and (not re.search(_HOLDER, s) or re.search(_TEXT, s)))


def LICENSES_SQL() -> str:
    x = "regexp_replace(replace(lower(coalesce(text, '')), '©', ' copyright '), '[^\\p{L}\\p{N}\\n]+', ' ', 'g')"
    for old, new in SPELLINGS:
        x = f"regexp_replace({x}, '\\b{old}\\b', '{new}', 'g')"

    def values(texts: dict) -> str:
        return ", ".join(f"('{hashlib.sha256(canonical(v).encode()).hexdigest()}', '{k}')" for k, v in texts.items())

    given = ", ".join(f"('{d}', '{k}')" for d, k in DIGESTS)
    return f"""
WITH known(d, id) AS (VALUES {values(TEXTS)}, {given}), grants(d, id) AS (VALUES {values(NOTICES)}),
c AS (
  SELECT row_number() OVER () AS rid, doc_id,
         list_filter(list_transform(string_split({x}, chr(10)), lambda s: trim(s, ' ')),
                     lambda s: s <> '' AND (NOT regexp_matches(s, '{_HOLDER}') OR regexp_matches(s, '{_TEXT}'))) AS ls
  FROM documents
), n AS (
  SELECT rid, string_agg(DISTINCT id, ',' ORDER BY id) AS notices
  FROM (SELECT rid, unnest(ls) AS s FROM c) JOIN grants ON sha256(s) = d GROUP BY rid
)
SELECT doc_id, sha256(array_to_string(ls, ' ')) AS license_digest, known.id AS license_id, coalesce(notices, '') AS notices
FROM c LEFT JOIN known ON known.d = sha256(array_to_string(ls, ' ')) LEFT JOIN n USING (rid)
"""
