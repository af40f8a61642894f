"""Mapping free-entered values to a canonical list (problem 6): pigeonhole join, in SQL only.

Values are compared once per distinct spelling. Two strings at most K edits apart agree in one of K+1
segments of either, at nearly the same place: reference strings are cut into K+1 segments, values
into the substrings that could equal one of them, both are equality-joined on (length, segment, text)
and verified with levenshtein: one edit, or two that are a swap of neighbouring letters.

- Fields with few meanings (employment, workplace): the reference strings are the canonical values and
  their synonyms in six languages, compared with the whole value without punctuation, gender tags and
  numbers; a value without such a match is looked up word by word in the single-word synonyms, exactly.
- Places: the reference strings are the words of names, other names, regions and rivers, compared word
  by word. A value means the one listed place it names; regions and rivers decide between places of one
  name; several places, or a name they leave open, mean no single place.
- What matches nothing is found by anti-join and reported as -1.

Defined results: null and blank values and values that are letter for letter canonical are no case;
repeated rows keep their keys; an empty list makes every value unmatched; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hirelake.runtime import cut

K = 2
#: Shorter words and phrases are compared exactly.
FUZZY_LENGTH = 5

# What people write for the canonical values (numbers as 0, without punctuation).
SYNONYMS = {
    "Full-time": ("full time", "fulltime", "ft", "vz", "vollzeit", "vollzeitstelle", "vollzeitbeschäftigung",
                  "vollzeit unbefristet", "0 full time", "voltijd", "temps plein", "jornada completa", "tiempo completo",
                  "pełny etat", "unbefristete vollzeit", "full time permanent"),
    "Part-time": ("part time", "parttime", "pt", "tz", "teilzeit", "teilzeitstelle", "teilzeit flexibel",
                  "teilzeit 0 std", "part time mornings", "teilzeitbeschäftigung", "deeltijd", "temps partiel",
                  "media jornada", "tiempo parcial", "niepełny etat", "halbtags"),
    "Working student": ("working student", "workingstudent", "student job", "studentenjob", "werkstudent",
                        "werkstudentin", "werkstudent in", "werkstudierende", "werkstud", "werkstudententätigkeit",
                        "werkstudium", "student assistant"),
    "Internship": ("internship", "intern", "internship 0 months", "praktikum", "praktikum 0 monate", "praktikant",
                   "praktikantin", "praktikant in", "praktikumsstelle", "pflichtpraktikum", "freiwilliges praktikum",
                   "stage", "prácticas", "staż", "trainee praktikum"),
    "Thesis": ("thesis", "thesis work", "master thesis", "bachelor s thesis", "bachelor thesis", "master s thesis",
               "final thesis", "graduation thesis", "abschlussarbeit", "masterarbeit", "bachelorarbeit",
               "bachelor masterarbeit", "diplomarbeit"),
    "Apprenticeship": ("apprenticeship", "apprentice", "ausbildung", "ausbildung 0 jahre", "ausbildungsplatz",
                       "berufsausbildung", "azubi", "auszubildende", "auszubildender", "lehre", "lehrstelle"),
    "Freelance": ("freelance", "freelancer", "freelance project", "contractor", "freie mitarbeit", "freiberuflich",
                  "honorarbasis", "selbstständig", "selbständig", "freier mitarbeiter"),
    "Temporary": ("temporary", "temp", "temporary contract", "befristet", "befristet 0 monate", "zeitarbeit",
                  "leiharbeit", "aushilfe", "saisonstelle", "fixed term", "arbeitnehmerüberlassung"),
    "Mini-job": ("mini job", "minijob", "minijob basis", "mini job basis", "geringfügig", "geringfügige beschäftigung",
                 "0 euro job", "450 euro basis"),
    "Remote": ("remote", "0 remote", "fully remote", "vollständig remote", "remote work", "home office", "homeoffice",
               "work from home", "wfh", "mobiles arbeiten 0", "ortsunabhängig", "télétravail", "thuiswerk", "zdalnie",
               "praca zdalna", "teletrabajo", "von zu hause"),
    "Hybrid": ("hybrid", "hybride", "hybrid work", "hybrides arbeiten", "hybrid 0 tage büro", "partly remote",
               "teils remote teils vor ort", "teilweise homeoffice", "teilweise home office", "mixed office home",
               "0 days office 0 days home", "hybrydowo", "híbrido"),
    "On-site": ("on site", "onsite", "office based", "in office", "at our premises", "vor ort", "nur vor ort",
                "vor ort tätigkeit", "präsenz", "im büro", "op kantoor", "sur place", "presencial", "stacjonarnie"),
    "Field-based": ("field based", "field work", "field service", "on the road", "travelling", "traveling",
                    "außendienst", "aussendienst", "im außendienst", "im aussendienst", "reisetätigkeit",
                    "unterwegs beim kunden"),
}

#: Phrase of a value: lower case, words joined by blanks, numbers as 0, gender tags gone.
PHRASE = (
    r"trim(regexp_replace(regexp_replace(regexp_replace(lower({v}), '\\(?\\b[mwdfx] ?/ ?[mwdfx] ?/ ?[mwdfx]\\b\\)?', ' '),"
    r" '[0-9]+', '0'), '[^\\pL0-9]+', ' '))"
)


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def synonym_table(spark: SparkSession) -> DataFrame:
    """(name, phrase) of the synonyms known without a table of one's own."""
    return spark.createDataFrame([(name, s) for name, spelled in SYNONYMS.items() for s in spelled], "name string, phrase string")


def _segment_start(length: str, n: str) -> str:
    """0-based start of segment n of K+1 of a string, and by n+1 its end."""
    return f"cast(floor({n} * {length} / {K + 1}) as int)"


def _closest(spark: SparkSession, values: DataFrame, references: DataFrame) -> DataFrame:
    """(field_name, v, r) of values and their closest reference strings, at most one edit or swap apart."""
    begin, end = _segment_start("l", "s"), _segment_start("l", "s + 1")
    return cut(spark.sql(f"""
    WITH cut AS (
        SELECT field_name, r, l, s, substring(r, {begin} + 1, {end} - {begin}) AS part
        FROM (SELECT DISTINCT field_name, r, length(r) AS l FROM {{refs}} WHERE length(r) >= {FUZZY_LENGTH}) t
        LATERAL VIEW explode(sequence(0, {K})) e AS s
    ),
    probe AS (
        SELECT DISTINCT field_name, v, l, s, substring(v, {begin} + 1 + d, {end} - {begin}) AS part
        FROM (SELECT DISTINCT field_name, v FROM {{vals}} WHERE length(v) >= {FUZZY_LENGTH} - 1) t
        LATERAL VIEW explode(sequence(length(v) - 1, length(v) + 1)) e AS l
        LATERAL VIEW explode(sequence(0, {K})) e AS s
        LATERAL VIEW explode(sequence(-{K}, {K})) e AS d
        WHERE {begin} + d >= 0 AND {end} + d <= length(v)
    ),
    near AS (
        SELECT field_name, v, r, distance FROM (
            SELECT /*+ MERGE(p) */ DISTINCT p.field_name, p.v, c.r, levenshtein(p.v, c.r) AS distance
            FROM probe p JOIN cut c ON p.field_name = c.field_name AND p.l = c.l AND p.s = c.s AND p.part = c.part
        )
        WHERE distance <= 1 OR (distance = 2 AND length(v) = length(r) AND exists(sequence(1, length(v) - 1),
            i -> concat(substring(v, 1, i - 1), substring(v, i + 1, 1), substring(v, i, 1), substring(v, i + 2)) = r))
        UNION
        SELECT /*+ MERGE(a) */ DISTINCT a.field_name, a.v, b.r, 0 FROM {{vals}} a JOIN {{refs}} b ON a.field_name = b.field_name AND a.v = b.r
    )
    SELECT field_name, v, r FROM (
        SELECT field_name, v, r, distance, min(distance) OVER (PARTITION BY field_name, v) AS least FROM near)
    WHERE distance = least""", vals=values, refs=references))


def _fields(spark: SparkSession, rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    stacked = ", ".join(f"{_literal(f)}, `{f}`" for f in fields)
    return spark.sql(
        f"SELECT `{key}`, field_name, value FROM (SELECT `{key}`, stack({len(fields)}, {stacked}) AS (field_name, value) FROM {{rows}}) "
        r"WHERE value RLIKE '(?U)\\S'",
        rows=rows,
    )


def _few_meanings(spark: SparkSession, values: DataFrame, references: DataFrame, synonyms: DataFrame) -> DataFrame:
    """(field_name, value, ref_id) for fields whose meanings have synonyms."""
    phrases = cut(spark.sql(f"SELECT field_name, value, {PHRASE.format(v='value')} AS v FROM {{vals}}", vals=values))
    named = cut(
        spark.sql(
            f"""
            SELECT r.field_name, r.ref_id, {PHRASE.format(v="s.phrase")} AS r
            FROM {{refs}} r JOIN {{synonyms}} s ON r.canonical_value = s.name
            UNION
            SELECT field_name, ref_id, {PHRASE.format(v="canonical_value")} FROM {{refs}}
            """,
            refs=references,
            synonyms=synonyms,
        )
    )
    return spark.sql(
        f"""
        WITH whole AS (
            SELECT /*+ MERGE(c) */ p.field_name, p.value, n.ref_id
            FROM {{phrases}} p JOIN {{closest}} c ON p.field_name = c.field_name AND p.v = c.v
            JOIN {{named}} n ON c.field_name = n.field_name AND c.r = n.r
        ),
        by_word AS (
            SELECT /*+ MERGE(x) */ w.field_name, w.value, n.ref_id
            FROM (SELECT field_name, value, explode(split(v, ' ')) AS word FROM {{phrases}}) w
            JOIN {{named}} n ON w.field_name = n.field_name AND w.word = n.r
            LEFT ANTI JOIN whole x ON w.field_name = x.field_name AND w.value = x.value
            WHERE length(w.word) >= {FUZZY_LENGTH}
        )
        SELECT field_name, value, min(ref_id) AS ref_id
        FROM (SELECT * FROM whole UNION ALL SELECT * FROM by_word)
        GROUP BY field_name, value HAVING count(DISTINCT ref_id) = 1
        """,
        phrases=phrases,
        named=named,
        closest=_closest(spark, phrases, named),
    )


#: Letters and their spelling in plain ones.
def _plain(column: str) -> str:
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        column = f"replace({column}, '{a}', '{b}')"
    return column


def _places(spark: SparkSession, values: DataFrame, references: DataFrame) -> DataFrame:
    """(field_name, value, ref_id) for place names."""
    words = "regexp_extract_all(lower({c}), '(\\\\pL+)', 1)"
    tokens = cut(
        spark.sql(f"SELECT DISTINCT field_name, value, explode({words.format(c='value')}) AS v FROM {{vals}}", vals=values)
    )
    named = cut(
        spark.sql(
            f"""
            WITH parts AS (
            SELECT field_name, ref_id, 'name' AS kind, get({words.format(c="canonical_value")}, 0) AS base,
                   get({words.format(c="canonical_value")}, 0) AS word FROM {{refs}}
            UNION ALL
            SELECT field_name, ref_id, 'name', get({words.format(c="canonical_value")}, 0), get({words.format(c="other_name")}, 0) FROM {{refs}}
            UNION ALL
            SELECT field_name, ref_id, 'of', null, explode({words.format(c="place_region")}) FROM {{refs}}
            UNION ALL
            SELECT field_name, ref_id, 'of', null, element_at({words.format(c="canonical_value")}, -1) FROM {{refs}}
            WHERE size({words.format(c="canonical_value")}) > 1
        ),
        spelled AS (
            SELECT field_name, ref_id, kind, base, explode(array(word, {_plain("word")})) AS r FROM parts WHERE word IS NOT NULL
        )
        SELECT DISTINCT field_name, ref_id, kind, base, r FROM spelled
        """,
            refs=references,
        )
    )
    hits = cut(
        spark.sql(
            """
            SELECT /*+ MERGE(c) */ DISTINCT t.field_name, t.value, n.ref_id, n.kind, n.base
            FROM {tokens} t JOIN {closest} c ON t.field_name = c.field_name AND t.v = c.v
            JOIN {named} n ON c.field_name = n.field_name AND c.r = n.r
            """,
            tokens=tokens,
            named=named,
            closest=_closest(spark, tokens, named),
        )
    )
    return spark.sql(
        """
        WITH of AS (SELECT field_name, value, ref_id, 1 AS fits FROM {hits} WHERE kind = 'of' GROUP BY field_name, value, ref_id),
        candidates AS (
            SELECT /*+ MERGE(o) */ h.field_name, h.value, h.ref_id, h.base, coalesce(o.fits, 0) AS fits
            FROM (SELECT DISTINCT field_name, value, ref_id, base FROM {hits} WHERE kind = 'name') h
            LEFT JOIN of o ON h.field_name = o.field_name AND h.value = o.value AND h.ref_id = o.ref_id
        ),
        judged AS (
            SELECT field_name, value, count(DISTINCT base) AS bases, count(*) AS n, sum(fits) AS fitting,
                   min(ref_id) AS lone, min(CASE WHEN fits = 1 THEN ref_id END) AS fit
            FROM candidates GROUP BY field_name, value
        )
        SELECT field_name, value, CASE WHEN n = 1 THEN lone ELSE fit END AS ref_id
        FROM judged WHERE bases = 1 AND (n = 1 OR fitting = 1)
        """,
        hits=hits,
    )


def mapping(
    rows: DataFrame, references: DataFrame, key: str, fields: list[str], places: list[str], synonyms: DataFrame | None = None
) -> DataFrame:
    """(key, field_name, value, ref_id) of every value that isn't canonical letter for letter; -1: unmatched.

    references: ref_id, field_name, canonical_value, place_region, other_name. places: the fields of place names.
    synonyms: name (a canonical value), phrase; other spellings of values of the fields with few meanings.
    """
    spark = rows.sparkSession
    entered = spark.sql(
        "SELECT e.* FROM {entered} e LEFT ANTI JOIN {refs} r ON e.field_name = r.field_name AND e.value = r.canonical_value",
        entered=_fields(spark, rows, key, fields),
        refs=references,
    )
    values = cut(spark.sql("SELECT DISTINCT field_name, value FROM {entered}", entered=entered))
    references = cut(references.select("ref_id", "field_name", "canonical_value", "place_region", "other_name"))
    listed = ", ".join(map(_literal, places)) or "''"
    pick = lambda df, rule: spark.sql(f"SELECT * FROM {{df}} WHERE field_name {rule} ({listed})", df=df)
    found = spark.sql(
        "SELECT * FROM {a} UNION ALL SELECT * FROM {b}",
        a=cut(_few_meanings(spark, pick(values, "NOT IN"), pick(references, "NOT IN"), synonyms or synonym_table(spark))),
        b=cut(_places(spark, pick(values, "IN"), pick(references, "IN"))),
    )
    return spark.sql(
        f"""
        WITH meant AS (
            SELECT field_name, value, ref_id FROM {{found}}
            UNION ALL
            SELECT /*+ MERGE(f) */ v.field_name, v.value, -1 FROM {{values}} v
            LEFT ANTI JOIN {{found}} f ON v.field_name = f.field_name AND v.value = f.value
        )
        SELECT /*+ MERGE(m) */ e.`{key}`, e.field_name, e.value, m.ref_id
        FROM {{entered}} e JOIN meant m ON e.field_name = m.field_name AND e.value = m.value
        """,
        found=found,
        values=values,
        entered=entered,
    )
