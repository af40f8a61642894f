"""DuckDB SQL for those queries that SQL can express over whole tables."""

from __future__ import annotations

import unicodedata

from hirelake.llm.canonical import FUZZY_LENGTH, SYNONYMS

_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"

_EXACT_MATCHES = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL),
     e AS (SELECT item_id, {_WORDS} AS w FROM eval_items WHERE text IS NOT NULL),
     dg AS (SELECT doc_id, array_to_string(w[i:i+12], ' ') AS g
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
     eg AS (SELECT item_id, array_to_string(w[i:i+12], ' ') AS g
            FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS i FROM e))
SELECT DISTINCT dg.doc_id, eg.item_id FROM dg JOIN eg USING (g)
"""

_SEQUENCE_SHARES = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL),
     g AS (SELECT doc_id, i, array_to_string(w[i:i+7], ' ') AS s
           FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
     r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id, s ORDER BY i) AS n FROM g) WHERE n > 1),
     c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (SELECT unnest(range(0, 8)) AS k) GROUP BY doc_id)
SELECT d.doc_id, c.n / len(d.w) AS share FROM d JOIN c USING (doc_id)
"""

# Variants and joined forms, separate accents, invisible characters, odd spaces, look-alikes in Latin words.
_ODD_CHARACTERS = (
    r"[\x{FF01}-\x{FF5E}\x{FB00}-\x{FB06}\x{1D400}-\x{1D7FF}\x{AD}\x{200B}-\x{200F}\x{2060}-\x{2064}\x{FEFF}"
    r"\x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}\t]|\p{L}\p{Mn}"
)
# Letters of other scripts and phonetic ones, and the Latin letters below them that they look like.
_ALIKE_LETTERS = (
    "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαικνορυχγϲϳАВЕЅІЈКМНОРСТУХҮԚԜавеѕіјкмнорстухүһԁԛԝӏӀѵѴɡɑɩɪʋᴀᴄᴏᴜᴠᴡᴢօսհոցՏՕՍ",
    "ABEZHIKMNOPTYXaikvopuxycjABESIJKMHOPCTYXYQWabesijkmhopctyxyhdqwlIvVgaiIvacouvwzouhngSOU",
)
_ALIKE = f"[{_ALIKE_LETTERS[0]}]"
_ODD_WORDS = rf"\p{{Latin}}\p{{L}}*{_ALIKE}|{_ALIKE}\p{{L}}*\p{{Latin}}"

_ODD_FIELDS = f"""
SELECT detail_id, field_name FROM (
    SELECT detail_id, 'title' AS field_name, title AS v FROM parsed_detail
    UNION ALL SELECT detail_id, 'description_raw', description_raw FROM parsed_detail)
WHERE regexp_matches(v, '{_ODD_CHARACTERS}') OR regexp_matches(v, '{_ODD_WORDS}')
"""


def _simple_variants() -> tuple[str, str]:
    """Width and style variants of single letters and digits, and what they become."""
    found = [(chr(c), unicodedata.normalize("NFKC", chr(c))) for low, high in ((0xFF01, 0xFF5E), (0x1D400, 0x1D7FF)) for c in range(low, high + 1)]
    pairs = [(a, b) for a, b in found if len(b) == 1 and a != b]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_VARIANTS = _simple_variants()
_JOINED = (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st"), ("ﬆ", "st"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _formed(v: str) -> str:
    """A text in the form of problem 4, up to the look-alikes in its words."""
    out = f"translate({v}, {_quoted(_VARIANTS[0])}, {_quoted(_VARIANTS[1])})"
    for joined, plain in _JOINED:
        out = f"replace({out}, '{joined}', '{plain}')"
    return f"nfc_normalize(regexp_replace({out}, '[\\x{{AD}}\\x{{34F}}\\x{{61C}}\\x{{180E}}\\x{{200B}}-\\x{{200F}}\\x{{202A}}-\\x{{202E}}\\x{{2060}}-\\x{{206F}}\\x{{FE00}}-\\x{{FE0F}}\\x{{FEFF}}]', '', 'g'))"


_LATIN_WORD = rf"lambda x: lower(CASE WHEN regexp_matches(x, '\p{{Latin}}') THEN translate(x, {_quoted(_ALIKE_LETTERS[0])}, {_quoted(_ALIKE_LETTERS[1])}) ELSE x END)"
_NEAR_PAIRS = rf"""
t AS (SELECT detail_id, list_transform(regexp_extract_all({_formed("concat(coalesce(title, ''), chr(10), coalesce(company, ''), chr(10), coalesce(description_raw, ''))")}, '[\p{{L}}\p{{N}}]+'), {_LATIN_WORD}) AS w
      FROM parsed_detail WHERE len(regexp_extract_all(description_raw, '[^\s\x1c-\x1f\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+')) >= 40),
g AS (SELECT DISTINCT detail_id, array_to_string(w[i:i+2], ' ') AS s FROM (SELECT detail_id, w, unnest(range(1, len(w) - 1)) AS i FROM t)),
n AS (SELECT detail_id, count(*) AS n FROM g GROUP BY detail_id),
p AS (SELECT a.detail_id AS detail_id_a, b.detail_id AS detail_id_b, count(*) AS n FROM g a JOIN g b ON a.s = b.s AND a.detail_id < b.detail_id GROUP BY 1, 2),
near AS (SELECT detail_id_a, detail_id_b FROM p JOIN n x ON detail_id_a = x.detail_id JOIN n y ON detail_id_b = y.detail_id WHERE p.n >= 0.5 * (x.n + y.n - p.n))
"""
_GROUPED = f"""
WITH RECURSIVE {_NEAR_PAIRS},
sides AS (SELECT * FROM near UNION ALL SELECT detail_id_b, detail_id_a FROM near),
reach(detail_id, r) AS (SELECT detail_id, detail_id FROM n UNION SELECT b.detail_id_b, reach.r FROM reach JOIN sides b ON b.detail_id_a = reach.detail_id)
SELECT detail_id, min(r) AS group_id FROM reach GROUP BY detail_id
"""


def _values(rows) -> str:
    return ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in row) + ")" for row in rows)


_PHRASE = (
    r"trim(regexp_replace(regexp_replace(regexp_replace(lower({v}), '\(?\b[mwdfx] ?/ ?[mwdfx] ?/ ?[mwdfx]\b\)?', ' ', 'g'),"
    r" '[0-9]+', '0', 'g'), '[^\p{{L}}0-9]+', ' ', 'g'))"
)


def _plain(v: str) -> str:
    return f"replace(replace(replace(replace({v}, 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss')"


# DuckDB compares bytes, so letters of two bytes become one byte each first.
_TWO_BYTES = "äöüßáàâéèêíóúñçąćęłńśźż"
_byte = lambda v: f"translate({v}, '{_TWO_BYTES}', '{''.join(chr(65 + n) for n in range(len(_TWO_BYTES)))}')"
_NEAR = f"(v = r OR (length(r) >= {FUZZY_LENGTH} AND damerau_levenshtein({_byte('v')}, {_byte('r')}) <= 1))"
_DISTANCE = f"CASE WHEN v = r THEN 0 ELSE levenshtein({_byte('v')}, {_byte('r')}) END"
_LETTERS = r"regexp_extract_all(lower({v}), '\p{{L}}+')"

_CANONICAL = f"""
WITH entered AS (
    SELECT * FROM (
        SELECT detail_id, 'location_raw' AS field_name, location_raw AS value FROM parsed_detail
        UNION ALL SELECT detail_id, 'employment_type_raw', employment_type_raw FROM parsed_detail
        UNION ALL SELECT detail_id, 'workplace_type_raw', workplace_type_raw FROM parsed_detail) x
    WHERE regexp_matches(value, '\\S') AND NOT EXISTS (SELECT 1 FROM canonical_values c WHERE c.field_name = x.field_name AND c.canonical_value = x.value)),
vals AS (SELECT DISTINCT field_name, value FROM entered),
syn(name, r) AS (VALUES {_values((n, s) for n, spelled in SYNONYMS.items() for s in spelled)}),
named AS (SELECT field_name, ref_id, r FROM canonical_values JOIN syn ON canonical_value = name
          UNION SELECT field_name, ref_id, {_PHRASE.format(v="canonical_value")} FROM canonical_values WHERE field_name <> 'location_raw'),
phrases AS (SELECT field_name, value, {_PHRASE.format(v="value")} AS v FROM vals WHERE field_name <> 'location_raw'),
near AS (SELECT p.field_name, value, ref_id, {_DISTANCE} AS d FROM phrases p JOIN named n ON p.field_name = n.field_name AND {_NEAR}),
whole AS (SELECT DISTINCT field_name, value, ref_id FROM near QUALIFY d = min(d) OVER (PARTITION BY field_name, value)),
words AS (SELECT field_name, value, unnest(string_split(v, ' ')) AS w FROM phrases WHERE (field_name, value) NOT IN (SELECT field_name, value FROM whole)),
by_word AS (SELECT DISTINCT w.field_name, value, ref_id FROM words w JOIN named n ON w.field_name = n.field_name AND w = r WHERE length(w) >= {FUZZY_LENGTH}),
few AS (SELECT field_name, value, min(ref_id) AS ref_id FROM (SELECT * FROM whole UNION ALL SELECT * FROM by_word) GROUP BY 1, 2 HAVING count(DISTINCT ref_id) = 1),
places AS (SELECT ref_id, {_LETTERS.format(v="canonical_value")} AS w, {_LETTERS.format(v="coalesce(other_name, '')")} AS o, {_LETTERS.format(v="coalesce(place_region, '')")} AS g FROM canonical_values WHERE field_name = 'location_raw'),
parts AS (SELECT ref_id, 'name' AS kind, w[1] AS base, w[1] AS word FROM places UNION ALL SELECT ref_id, 'name', w[1], o[1] FROM places
          UNION ALL SELECT ref_id, 'of', NULL, unnest(g) FROM places UNION ALL SELECT ref_id, 'of', NULL, w[len(w)] FROM places WHERE len(w) > 1),
known AS (SELECT DISTINCT ref_id, kind, base, unnest([word, {_plain("word")}]) AS r FROM parts WHERE word IS NOT NULL),
tokens AS (SELECT DISTINCT value, unnest({_LETTERS.format(v="value")}) AS v FROM vals WHERE field_name = 'location_raw'),
spelled AS (SELECT v, r FROM (SELECT DISTINCT v FROM tokens), (SELECT DISTINCT r FROM known) WHERE {_NEAR}
            QUALIFY {_DISTANCE} = min({_DISTANCE}) OVER (PARTITION BY v)),
hits AS (SELECT DISTINCT value, ref_id, kind, base FROM tokens JOIN spelled USING (v) JOIN known USING (r)),
judged AS (SELECT value, count(DISTINCT base) AS bases, count(*) AS n, count(*) FILTER (WHERE fits) AS fitting, min(ref_id) AS lone, min(ref_id) FILTER (WHERE fits) AS fit
           FROM (SELECT DISTINCT value, ref_id, base, (value, ref_id) IN (SELECT value, ref_id FROM hits WHERE kind = 'of') AS fits FROM hits WHERE kind = 'name') GROUP BY value),
found AS (SELECT * FROM few UNION ALL SELECT 'location_raw', value, CASE WHEN n = 1 THEN lone ELSE fit END FROM judged WHERE bases = 1 AND (n = 1 OR fitting = 1))
SELECT DISTINCT detail_id, e.field_name, coalesce(f.ref_id, -1) AS ref_id FROM entered e LEFT JOIN found f ON e.field_name = f.field_name AND e.value = f.value
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p4_found": _ODD_FIELDS,
        "p5_found": f"WITH {_NEAR_PAIRS} SELECT * FROM near",
        "p5_members": _GROUPED,
        "p6_found": _CANONICAL,
        "p9_found": _EXACT_MATCHES,
        "p9_kept": f"SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM ({_EXACT_MATCHES}))",
        "p10_found": f"SELECT doc_id FROM ({_SEQUENCE_SHARES}) WHERE share >= 0.3",
    }
