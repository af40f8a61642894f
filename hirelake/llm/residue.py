"""Template residue and error-page text (problem 2): masked messages grouped across sources.

1. Titles and the lines of descriptions are messages. They are brought to the form of problem 4 and
   lower case; numbers, addresses and dates are masked, decoration is cut off.
2. Messages are grouped by exact hash over all records and sources. Tasks count their own messages
   before the shuffle, so a message that stands everywhere costs one row per task.
3. Every distinct message is classified once, with all rules, as a whole and by its sentences:

   - placeholder: an unfilled slot of a template language;
   - missing: a word that a program prints for a missing value;
   - filler: dummy text, in pseudo-Latin or by its wording;
   - notice: an error page, block page or notice about scripts; counts only where it is the whole title
     or stands in a description too short for a posting;
   - recurring: a message of such short descriptions that no rule names, but that stands in at least
     the share `RECURRING_SHARE` of them (and `RECURRING_RECORDS`) and in `RECURRING_SOURCES` sources.
4. The classes go back to the records by hash. A record is residue by recurrence only if all its lines
   are residue or recurring: a short posting has a line of its own.

Rules without recurrence also hold for messages that stand once: filler made at random never recurs.
A message that speaks about such things as part of the work (two different ones side by side, or one
beside a word of the craft) is no residue.

Defined results: null, empty and blank fields are no case; a text of any length is read whole; lines of
decoration only are no messages; a null source counts as no source; repeated rows give one row per key;
empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelake.llm.charform import form
from hirelake.runtime import cut, stored

#: Below this number of words a description is no posting.
POSTING_WORDS = 40
RECURRING_SHARE, RECURRING_RECORDS, RECURRING_SOURCES = 0.002, 3, 3
#: A task hands on its counts when they hold so many messages.
MOST_HELD = 200_000

# The rules by kind, over masked lower case. Every match of a pattern holds one of the
# signs before it, so a pattern is tried only where a sign of its own stands.
PLACEHOLDER = (
    (("{{",), r"\{\{[^{}\n]{1,60}\}\}"),
    (("${",), r"\$\{[^{}\n]{1,60}\}"),
    (("<<",), r"<<[^<>\n]{1,40}>>"),
    (("<%",), r"<%[^%\n]{1,40}%>"),
    (("{%",), r"\{%[^%\n]{1,40}%\}"),
    (("%%",), r"%%[^%\n]{1,40}%%"),
    (("%",), r"%[a-z][a-z_]{2,}%"),
    (("@@",), r"@@[^@\n]{1,40}@@"),
    (("__",), r"__[a-z][a-z_]*__"),
    (("#",), r"#[a-z][a-z_]{2,}#"),
    (("{0}",), r"\{0\}"),
    (("{",), r"\{[a-z]+[_.][a-z_.]+\}"),
    (("$",), r"\$[a-z][a-z_]+\b|\$\([a-z_]+\)"),
    (("%(",), r"%\([a-z_]+\)s"),
    (("<",), r"<(?![\s/])[^\W\d]{3,30}(?<!\s)>"),
    (("tbd_", "tba_", "todo_"), r"\b(tbd|tba|todo)_\w+"),
    (("[[",), r"\[\[[^\[\]\n]{1,40}\]\]"),
    (("[",), r"\[\s?(insert|enter|your|hier|bitte|job ?title|jobtitel|titel|title|position|stelle|firma|firmenname|company"
             r"|name|ansprechpartner|kontakt|contact|standort|ort|location|datum|date|gehalt|salary|text)\b[^\[\]\n]{0,40}\]"),
    (("[",), r"\[[^\[\]\n]{1,40}(einfügen|eintragen|eingeben|ergänzen|here)\s?\]"),
)
MISSING = (
    (("undefined", "null", "nan", "nil"), r"\b(undefined|null|nan|nil)\b"),
    (("[object ",), r"\[object \w+\]"),
    (("#n/a", "#ref!"), r"#n/a|#ref!"),
    (("xxxx",), r"\bxxxx+\b"),
)
FILLER = (
    (("lorem ipsum",), r"lorem ipsum"),
    (("blindtext",), r"\bblindtext\b"),
    (("dummy",), r"\bdummy(-| ?)(inhalt|text|copy|content)"),
    (("placeholder",), r"\bplaceholder (copy|text|content)"),
    (("platzhalter",), r"\bplatzhalter(text)?\b"),
    ((" goes here",), r"\b(text|content|copy) goes here"),
    (("bla",), r"\b(bla\W+){2,}"),
    (("asdf",), r"\basdf\b"),
    (("qwert",), r"\bqwert[zy]\b"),
    (("foo bar",), r"\bfoo bar\b"),
    (("beispiel",), r"\bbeispiel(absatz|text)\b"),
    (("sample ",), r"\bsample (description|text|copy)\b"),
    (("abc",), r"\b(abc\W+){2,}"),
    (("test",), r"\b(test\W+){2,}test\b"),
    (("hier steht ",), r"hier steht (später|bald|demnächst|der text|ihr text)"),
    ((" folgt",), r"\b(beschreibung|text|inhalt) folgt\b"),
    ((" to follow", " coming soon"), r"\b(description|details|text) (to follow|coming soon)\b"),
    (("todo:",), r"\btodo:"),
    (("write this section",), r"\bwrite this section\b"),
    (("muster",), r"\bmuster(text|absatz)\b"),
)
NOTICE = (
    (
        ("page", "site", "document", "link", "posting", "job", "ad", "anzeige", "seite", "stelle", "annonce", "strona", "oferta",
         "página", "pagina"),
        r"\b(page|site|document|link|posting|job|ad|anzeige|seite|stelle|annonce|strona|oferta|página|pagina)\b[^.]{0,40}"
        r"(not found|missing|broken|moved|expired|removed|no longer|does not exist|nicht gefunden|nicht (mehr )?verfügbar"
        r"|existiert nicht|abgelaufen|entfernt|gelöscht|n.existe plus|introuvable|nie istnieje|no existe|no encontrada"
        r"|niet gevonden|bestaat niet)",
    ),
    (("no longer available", "may have moved"), r"\bno longer available\b|\bmay have moved\b"),
    (("error 0", "fehler 0"), r"\b(error|fehler) 0"),
    (("server error", "something went wrong"), r"\bserver error\b|\bsomething went wrong\b"),
    (("service ",), r"\bservice (is busy|unavailable|temporarily)"),
    (("bad gateway", "gateway time"), r"\b(bad gateway|gateway time-?out)\b"),
    (("too many requests", "access denied", "zugriff verweigert"), r"\b(too many requests|access denied|zugriff verweigert)\b"),
    (("forbidden", "was blocked", "not a robot", "captcha"), r"\b(forbidden|was blocked|not a robot|captcha)\b"),
    (("are human", "are a human"), r"\bare (a )?human\b"),
    (("checking your browser", "attention required"), r"\b(checking your browser|attention required)\b"),
    (("just a ",), r"\bjust a (second|moment)\b"),
    (("session", "sitzung"), r"\b(session|sitzung)[^.]{0,20}(expired|abgelaufen)"),
    (("wartungs",), r"\bwartungs(arbeiten|modus)\b"),
    (("under maintenance", "under construction"), r"\bunder (maintenance|construction)\b"),
    (("script",), r"\b(enable|turn on|activate|switch on)[^.]{0,20}\b(java)?scripts?\b"
                  r"|\b(java)?scripts?\b[^.]{0,30}\b(aktivieren|einschalten|required|disabled)|\baktiviere[^.]{0,20}script"),
    (("browser ",), r"\bbrowser (wird nicht|is not|isn.t) (unterstützt|supported)"),
    (("loading",), r"\bloading(…|\.\.\.)"),
)
# Words of pseudo-Latin filler.
PSEUDO_LATIN = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor incididunt labore dolore magna aliqua enim"
    " minim veniam quis nostrud exercitation ullamco laboris nisi aliquip commodo consequat duis aute irure reprehenderit"
    " voluptate velit esse cillum fugiat nulla pariatur excepteur sint occaecat cupidatat proident sunt culpa officia"
    " deserunt mollit anim est laborum".split()
)
# Whole titles without a subject, over masked lower case without decoration.
TITLE_MISSING = r"undefined|null|nan|none|nil|n/?a|\[object object\]|x{3,}|not set|unknown title"
TITLE_FILLER = (
    r"lorem ipsum.*|(test\W*){2,}|asdf\w*|qwert[zy]\w*|untitled( document| page)?|unbenannt(e seite|es dokument)?"
    r"|(neue|new) (seite|page|post|job)|job ?title( here)?|your title here|stellentitel( eingeben)?|jobtitel( eingeben)?"
    r"|title|titel|headline|überschrift|dummy.*|sample( title| job)?|beispiel(titel)?|platzhalter|placeholder.*"
    r"|blindtext|foo( bar)?|(bla\W*)+|todo.*|tbd|tba|(abc\W*)+"
)
TITLE_NOTICE = (
    r"0|(error|fehler)( 0)?|(page|seite|anzeige|job|posting|stelle|document|link) [^.]{0,30}"
    r"(not found|missing|nicht gefunden|nicht (mehr )?verfügbar|no longer available|expired|abgelaufen|removed)"
    r"|page missing|not found|access denied|zugriff verweigert|forbidden|attention required!?|just a (second|moment)"
    r"|(service|temporarily) unavailable|(session|sitzung) (expired|abgelaufen)|too many requests|bad gateway"
    r"|gateway time-?out|internal server error|wartungs(arbeiten|modus)|maintenance|under construction"
    r"|are you (a )?(human|robot)|please wait|bitte warten|loading|checking your browser|captcha|robot check"
    r"|strona nie istnieje|page introuvable|página no encontrada|pagina niet gevonden"
)
# Words beside which a slot or a missing value is a subject of the work.
CRAFT = (
    r"\b(templates?|vorlagen?|placeholders?|platzhalter|checks?|handling|fields?(?! (service|sales|office|staff|work))|felder?|werte?n?|notes?|notizen"
    r"|run time|runtime|laufzeit|syntax|beispieltexte?|sample texts)\b"
)

_KINDS = (("placeholder", PLACEHOLDER), ("missing", MISSING), ("filler", FILLER), ("notice", NOTICE))
_RULES = [(kind, signs, re.compile(pattern)) for kind, rules in _KINDS for signs, pattern in rules]
_SLOTS = re.compile("|".join(f"(?:{pattern})" for _, pattern in (*PLACEHOLDER, *MISSING)))
_CRAFT = re.compile(CRAFT)
_TITLE_RULES = [(k, re.compile(p)) for k, p in (("missing", TITLE_MISSING), ("filler", TITLE_FILLER), ("notice", TITLE_NOTICE))]
_SENTENCE = re.compile(r"(?<=[.!?]) ")
_LATIN_WORD = re.compile(r"[^\W\d_]+")
_LONG = re.compile(rf"\s*(?:\S+\s+){{{POSTING_WORDS - 1}}}\S")

_ADDRESS = re.compile(r"https?://\S+|www\.\S+|\S+@\S+\.\w+")
_NUMBER = re.compile(r"\b(?=[0-9a-f]*\d)[0-9a-f]{4,}\b|\d+(?:[.,:/-]\d+)*")
_DECORATION = " \t*•·▪►–—|=~+-"
# What stands before or after a message without being part of it, over masked lower case.
_BEFORE = re.compile(r"^(\[!\] |(sorry|oops|whoops|ups|hinweis|entschuldigung|note|notice)\b[\s,.:!–—-]+)")
_AFTER = re.compile(r"\s*(\(id 0\)|\(ref\.? 0\)|:-\(|\| back|zur startseite|try again\.?)$")
# How those begin and end, for a look before the pattern.
_FIRST = ("[!]", "sorry", "oops", "whoops", "ups", "hinweis", "entschuldigung", "note", "notice")
_LAST = ("0)", ":-(", "| back", "zur startseite", "try again", "try again.")
_DIGIT = re.compile(r"\d")
_TAGS = re.compile(r"\s*[(\[]((\w{1,4}[/|]){1,3}\w{1,4}|gn|all genders|ref\.? ?\w+|id #?\d+|\d+)[)\]]|\s(m/w/d|w/m/d|m/f/d|f/m/x)\b")
_TITLE_ENDS = re.compile(r"^[\s–—|:-]+|(/ kennziffer)?\s+#?\d+\s*$|[\s–—|:.…!-]+$")


def mask(text: str) -> str:
    """What two copies of a message in form have in common."""
    text = text.lower()
    if "@" in text or "/" in text or "www." in text:
        text = _ADDRESS.sub("@", text)
    if _DIGIT.search(text):
        text = _NUMBER.sub("0", text)
    text = text.strip(_DECORATION)
    bare = _BEFORE.sub("", text) if text.startswith(_FIRST) else text
    return (_AFTER.sub("", bare) if bare.endswith(_LAST) else bare) or text


def bare_title(masked: str, source: str | None) -> str:
    """A masked title without gender tags, references and the source's name, nor dashes around it."""
    out = _TAGS.sub("", masked)
    if source:
        out = out.replace(source.lower(), "")
    return _TITLE_ENDS.sub("", _TITLE_ENDS.sub("", out))


def _automaton():
    """One pass over a message finds all signs in it."""
    import ahocorasick

    rules: dict[str, list[int]] = {}
    for n, (_, signs, _) in enumerate(_RULES):
        for sign in signs:
            rules.setdefault(sign, []).append(n)
    found = ahocorasick.Automaton()
    for sign, of in rules.items():
        found.add_word(sign, tuple(of))
    found.make_automaton()
    return found


def _pseudo_latin(text: str) -> bool:
    words = text.split()
    hits = sum(w in PSEUDO_LATIN for w in _LATIN_WORD.findall(text)) if len(words) > 2 else 0
    return hits >= 3 and hits >= 0.6 * len(words)


def _excused(kind: str, pattern: re.Pattern, text: str) -> bool:
    """The rest of the text shows that the match is a subject of the work."""
    if kind == "notice":
        return False
    return _CRAFT.search(pattern.sub(" ", text)) is not None or kind != "filler" and len({m.group() for m in _SLOTS.finditer(text)}) > 1


class Rules:
    """classify(message) -> the kinds of a masked line."""

    def __init__(self):
        self.signs = _automaton()

    def classify(self, message: str) -> set[str]:
        tried = {n for _, of in self.signs.iter(message) for n in of}
        parts = _SENTENCE.split(message)
        units = [message, *parts] if len(parts) > 1 else parts
        kinds: set[str] = set()
        for n in sorted(tried):
            kind, _, pattern = _RULES[n]
            if kind not in kinds and pattern.search(message) and any(pattern.search(u) and not _excused(kind, pattern, u) for u in units):
                kinds.add(kind)
        if not PSEUDO_LATIN.isdisjoint(_LATIN_WORD.findall(message)) and any(map(_pseudo_latin, units)):
            kinds.add("filler")
        return kinds

    def classify_title(self, message: str, bare: str) -> set[str]:
        for kind, signs, pattern in _RULES[: len(PLACEHOLDER)]:
            if pattern.search(message):
                return {kind}
        kinds = {kind for kind, pattern in _TITLE_RULES if pattern.fullmatch(bare)}
        return kinds | {"filler"} if _pseudo_latin(message) else kinds


def _hash(*parts: str) -> int:
    return xxhash.xxh3_64_intdigest("\x1f".join(parts)) - (1 << 63)


def _messages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per field with the hashes of its messages, and rows with the messages and their counts so far."""
    counts: dict[tuple, int] = {}
    texts: dict[int, tuple] = {}
    kind = None

    def rows(fields: list[tuple], held: dict[tuple, int]) -> pa.RecordBatch:
        none = [None] * len(fields)
        pad = [None] * len(held)
        ids, names, short, hashes = zip(*fields) if fields else ([],) * 4
        digest, source = zip(*held) if held else ([],) * 2
        name, brief, message, bare = zip(*(texts[d] for d in digest)) if held else ([],) * 4
        columns = (
            (kind, [*ids, *pad]), (pa.string(), [*names, *name]), (pa.bool_(), [*short, *brief]), (pa.list_(pa.int64()), [*hashes, *pad]),
            (pa.int64(), [*none, *digest]), (pa.string(), [*none, *message]), (pa.string(), [*none, *bare]),
            (pa.string(), [*none, *source]), (pa.int64(), [*none, *held.values()]),
        )
        names = ["id", "field_name", "short", "hashes", "hash", "message", "bare", "source", "records"]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for k, v in columns], names=names)

    for batch in batches:
        kind = batch.schema.field(0).type
        fields = []
        for key, source, title, text in zip(*(c.to_pylist() for c in batch.columns)):
            if title and not title.isspace():
                message = mask(form(title))
                if message:
                    bare = bare_title(message, source)
                    digest = _hash("t", message, bare)
                    texts[digest] = ("title", False, message, bare)
                    counts[digest, source] = counts.get((digest, source), 0) + 1
                    fields.append((key, "title", False, [digest]))
            if text and not text.isspace():
                text = form(text)
                short = _LONG.match(text) is None
                hashes = []
                for message in dict.fromkeys(map(mask, text.split("\n"))):
                    if message:
                        digest = _hash("s" if short else "d", message)
                        hashes.append(digest)
                        if digest not in texts:
                            texts[digest] = ("description_raw", short, message, "")
                        counts[digest, source] = counts.get((digest, source), 0) + 1
                fields.append((key, "description_raw", short, hashes))
        if len(counts) > MOST_HELD:
            yield rows(fields, counts)
            counts.clear()
            texts.clear()
        else:
            yield rows(fields, {})
    if counts:
        yield rows([], counts)


def _classifier(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rules = Rules()
    for batch in batches:
        kinds = []
        for name, short, message, bare in zip(*(batch.column(n).to_pylist() for n in ("field_name", "short", "message", "bare"))):
            if name == "title":
                found = rules.classify_title(message, bare)
            else:
                found = rules.classify(message)
                if not short:
                    found.discard("notice")
            kinds.append(sorted(found))
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(n) for n in ("hash", "short", "message", "records", "sources")), pa.array(kinds, pa.list_(pa.string()))],
            names=["hash", "short", "message", "records", "sources", "kinds"],
        )


class Residue:
    """messages: every distinct message that is residue or recurs; found(): the fields that hold residue."""

    def __init__(self, df: DataFrame, key: str, title: str, description: str, source: str):
        self.key = key
        kind = df.schema[key].dataType.simpleString()
        rows = df.select(F.col(key).alias("id"), F.col(source).alias("source"), F.col(title).alias("t"), F.col(description).alias("d"))
        self.read = stored(
            rows.mapInArrow(
                _messages,
                f"id {kind}, field_name string, short boolean, hashes array<bigint>, hash bigint, message string, bare string, "
                "source string, records bigint",
            ),
            "messages",
        )
        self.fields = self.read.where(F.col("hashes").isNotNull()).select("id", "field_name", "short", "hashes")
        short = self.fields.where(F.col("short")).count()
        one = ["hash", "field_name", "short", "message", "bare"]
        grouped = (
            self.read.where(F.col("hash").isNotNull())
            .repartition("hash")  # tasks have counted already
            .groupBy(*one, "source")
            .agg(F.sum("records").alias("records"))
            .groupBy(*one)
            .agg(F.sum("records").alias("records"), F.count("source").alias("sources"))
        )
        known = grouped.mapInArrow(_classifier, "hash bigint, short boolean, message string, records bigint, sources bigint, kinds array<string>")
        recurs = (
            F.col("short")
            & (F.col("records") >= max(RECURRING_RECORDS, short * RECURRING_SHARE))
            & (F.col("sources") >= RECURRING_SOURCES)
        )
        self.messages = cut(known.withColumn("recurs", recurs).where(F.col("recurs") | (F.size("kinds") > 0)))

    def found(self) -> DataFrame:
        """(key, field_name, kinds) of every field that holds residue."""
        lines = self.fields.select(
            "id", "field_name", F.xxhash64("hashes").alias("row"), F.size("hashes").alias("lines"), F.explode("hashes").alias("hash")
        )
        hit = lines.join(self.messages.select("hash", "kinds", "recurs"), "hash")
        ruled = F.array_distinct(F.flatten(F.collect_set("kinds")))
        whole = (F.count_distinct("hash") == F.first("lines")) & F.max("recurs")
        recurring = F.when(whole, F.array(F.lit("recurring"))).otherwise(F.array().cast("array<string>"))
        return (
            hit.groupBy("id", "field_name", "row")
            .agg(F.concat(ruled, recurring).alias("kinds"))
            .where(F.size("kinds") > 0)
            .groupBy(F.col("id").alias(self.key), "field_name")
            .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("kinds")))).alias("kinds"))
        )


def residue(df: DataFrame, key: str, title: str, description: str, source: str) -> DataFrame:
    """(key, field_name, kinds) of every field that holds residue."""
    return Residue(df, key, title, description, source).found()


def without_residue(df: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """The records none of whose fields hold residue."""
    return df.join(found.select(key).distinct(), key, "left_anti")
