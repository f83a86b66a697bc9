"""SQL that splits the packed fields of the keywords table, and the vocabulary made of them."""

from __future__ import annotations

_SP = r" \x{A0}\x{1680}\x{2000}-\x{200B}\x{202F}\x{205F}\x{2060}\x{3000}\x{FEFF}"
_CT = r"\x00-\x1F\x7F-\x{9F}\x{2028}\x{2029}"
_SEP = r",;|\x{FF0C}\x{FF1B}\x{3001}\x{FF5C}\x{A6}\x{2022}\x{2023}\x{25AA}\x{25CF}\x{25E6}\x{2219}\x{E000}\x{E001}" + _CT
_NUM = r"[-+]?[0-9]+(?:[.][0-9]+)?"
_DQ, _SQ = r'"(?:[^"\\]|\\(?s:.))*"', r"''(?:[^''\\]|\\(?s:.))*''"
_ELEMENT = rf"(?:{_DQ}|{_SQ}|{_NUM})[\s{_SP}]*"
_LITERAL = rf"^\[[\s{_SP}]*(?:{_ELEMENT}(?:,[\s{_SP}]*{_ELEMENT})*,?[\s{_SP}]*)?\]$"
_PIECE = rf'[{_SP}]*"(?:[^"]|"")*"[{_SP}]*(?:[{_SEP}]|$)|[^{_SEP}]*(?:[{_SEP}]|$)'


def _spaced(c: str, mark: str, stand: str) -> str:
    one = lambda x: rf"regexp_replace({x}, '([{_SP}]){mark}([{_SP}])', '\1{stand}\2', 'g')"
    return one(one(c))


_TRIM = lambda c: f"regexp_replace({c}, '^[{_SP}]+|[{_SP}]+$', '', 'g')"
_BACK = lambda c: f"replace(replace({c}, chr(57344), '/'), chr(57345), chr(183))"
_HEX = lambda c: rf"regexp_replace(replace({c}, '\''', ''''), '\\x([0-9a-fA-F]{{2}})', '\\u00\1', 'g')"
_QUOTES = lambda c: rf"""regexp_replace(regexp_replace({c}, '(^|[^\\])"', '\1\\"', 'g'), '(^|[^\\])"', '\1\\"', 'g')"""
_PARSED = lambda c: f"""coalesce(TRY(json_extract_string('["' || {c} || '"]', '$[0]')), r)"""
#: Defines ``pk (entry_id, field, pos, item)``.
PACKED = rf"""pk0 AS (SELECT DISTINCT entry_id, keywords, related_keywords, business_capability FROM keywords),
pk1 AS (SELECT entry_id, 'keywords' AS field, keywords AS x FROM pk0 UNION ALL SELECT entry_id, 'related_keywords', related_keywords FROM pk0 UNION ALL SELECT entry_id, 'business_capability', business_capability FROM pk0),
pk2 AS (SELECT entry_id, field, regexp_replace({_spaced(_spaced('x', '/', chr(0xE000)), chr(0xB7), chr(0xE001))}, '^[{_SP}{_CT}]+|[{_SP}{_CT}]+$', '', 'g') AS x FROM pk1 WHERE x IS NOT NULL),
pk3 AS (SELECT entry_id, field, x, regexp_matches(x, '{_LITERAL}') AS lit FROM pk2 WHERE x <> ''),
pk4 AS (SELECT entry_id, field, lit, unnest(p) AS p, generate_subscripts(p, 1) AS i FROM (SELECT entry_id, field, lit, CASE WHEN lit THEN regexp_extract_all(substring(x, 2, length(x) - 2), '{_DQ}|{_SQ}|{_NUM}') ELSE regexp_extract_all(x, '{_PIECE}') END AS p FROM pk3)),
pk5 AS (SELECT entry_id, field, i, lit, CASE WHEN lit THEN p ELSE {_TRIM(f"regexp_replace(p, '[{_SEP}]$', '')")} END AS p FROM pk4),
pk6 AS (SELECT entry_id, field, i, lit, left(p, 1) AS q, CASE WHEN lit AND left(p, 1) IN ('"', '''') THEN substring(p, 2, length(p) - 2) WHEN NOT lit AND regexp_full_match(p, '"(?:[^"]|"")*"') THEN replace(substring(p, 2, length(p) - 2), '""', '"') ELSE p END AS r FROM pk5),
pk7 AS (SELECT entry_id, field, i, CASE WHEN lit AND q IN ('"', '''') AND contains(r, '\') THEN CASE q WHEN '"' THEN {_PARSED(_HEX('r'))} ELSE {_PARSED(_QUOTES(_HEX('r')))} END ELSE r END AS r FROM pk6 WHERE regexp_matches(r, '[^{_SP}\x00-\x1F]')),
pk AS (SELECT entry_id, field, (row_number() OVER (PARTITION BY entry_id, field ORDER BY i) - 1)::INT AS pos, {_TRIM(_BACK('r'))} AS item FROM pk7)"""
#: Defines ``vocab`` after :data:`PACKED`.
VOCAB = f"""{PACKED},
vk AS (SELECT entry_id, coalesce(list(item ORDER BY pos) FILTER (field = 'keywords'), []) AS k, coalesce(list(item ORDER BY pos) FILTER (field = 'related_keywords'), []) AS r, coalesce(list(item ORDER BY pos) FILTER (field = 'business_capability'), []) AS c FROM pk GROUP BY entry_id),
vocab AS (SELECT e.entry_id AS entry, coalesce(k[1], '') AS canonical, coalesce(k, []) AS terms, coalesce(r, []) AS related, coalesce(c, []) AS capabilities, metadata AS category FROM (SELECT DISTINCT entry_id, metadata FROM keywords) e LEFT JOIN vk ON vk.entry_id = e.entry_id)"""
SQL = {"p1_found": f"WITH {PACKED} SELECT entry_id, field, pos, item FROM pk"}
