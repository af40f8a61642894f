"""Text functions as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as white space, and where lines end.
SPACE = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
LINE_END = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85\u2028\u2029]"
# Folding of letters.
FOLDED = (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss"))


# The same characters one by one, for functions that are faster than patterns.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def blank_to_null(value: Column) -> Column:
    return F.when(value != "", value)


def first_filled(*values: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*(blank_to_null(v) for v in values))


def first_filled_array(*values: Column) -> Column:
    """The first array with elements, else an empty one."""
    return F.coalesce(*(F.when(F.size(v) > 0, v) for v in values), F.array().cast("array<string>"))


def collapse(value: Column) -> Column:
    """Runs of white space become one blank; none at the ends."""
    return F.trim(F.regexp_replace(value, SPACE + "+", " "))


def fold(value: Column) -> Column:
    """Lower case without umlauts; null is empty."""
    out = F.lower(F.coalesce(value, F.lit("")))
    for letter, plain in FOLDED:
        out = F.replace(out, F.lit(letter), F.lit(plain))
    return out


def normalize(value: Column) -> Column:
    return collapse(fold(value))


def slugify(value: Column) -> Column:
    out = F.lower(collapse(value))
    for a, b in (("+", "plus"), ("&", "and"), (" ", "-")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def first_literal(value: Column, literals: Sequence[str]) -> Column:
    """The first of the literals, in their order, that the value contains."""
    return F.coalesce(*(F.when(value.contains(x), F.lit(x)) for x in literals))


def first_pattern(value: Column, patterns: Sequence[str]) -> Column:
    """The first of the patterns, in their order, that occurs in the value."""
    return F.coalesce(*(F.when(value.rlike(x), F.lit(x)) for x in patterns))


def count_literals(value: Column, literals: Sequence[str]) -> Column:
    """How many of the literals the value contains."""
    total: Column = F.lit(0)
    for x in literals:
        total = total + value.contains(x).cast("int")
    return total


# Markers of German and of English postings.
GERMAN_MARKERS = (
    "wir suchen", "deine aufgaben", "qualifikationen", "deutschkenntnisse", "was wir dir bieten", "werkstudent",
    "kenntnisse", "studium", "stellenbeschreibung", "unternehmensbeschreibung",
)
ENGLISH_MARKERS = (
    "what you'll do", "what you will do", "what you'll need", "about the role", "requirements", "nice to have",
    "internship", "working student", "about the job", "bonus points",
)


def marker_vote(value: Column) -> Column:
    """The language with more markers, of two at least."""
    text = normalize(value)
    german, english = count_literals(text, GERMAN_MARKERS), count_literals(text, ENGLISH_MARKERS)
    return (
        F.when((german > english) & (german >= 2), "german")
        .when((english > german) & (english >= 2), "english")
        .otherwise("mixed_or_unknown")
    )


def lines(value: Column) -> Column:
    """Lines with collapsed white space, without empty ones."""
    parts = F.split(F.coalesce(value, F.lit("")), LINE_END)
    return F.filter(F.transform(parts, collapse), lambda x: x != "")


# Navigation phrases that stand alone on a line.
NAVIGATION = (
    "home", "my network", "jobs", "messaging", "notifications", "me", "for business", "try premium for €0",
    "skip to search", "skip to main content", "skip to primary content", "skip to aside", "skip to footer", "apply",
    "save",
)


def clean_lines(value: Column) -> Column:
    phrases = F.array(*map(F.lit, NAVIGATION))
    return F.filter(lines(value), lambda x: ~F.array_contains(phrases, F.lower(x)))


# Where a description begins, and what follows it on a page.
START_MARKERS = (
    "About the job", "Stellenbeschreibung", "Unternehmensbeschreibung", "Deine Aufgaben", "Ihre Aufgaben", "Tasks",
    "Aufgaben",
)
STOP_MARKERS = (
    "People also viewed", "Jobs you may like", "Similar jobs", "Recommended for you", "Browse jobs", "Ähnliche Jobs",
    "Weitere Jobs",
)
NOISE_MARKERS = (
    "People also viewed", "Jobs you may like", "Similar jobs", "Recommended for you", "Browse jobs", "Company photos",
    "More jobs", "Ähnliche Jobs", "Weitere Jobs", "Empfohlene Jobs",
)

def strip(value: Column) -> Column:
    return F.btrim(value, F.lit(SPACES))


def _with(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def trim_description(value: Column) -> Column:
    """From the first start marker, in their order, to the earliest stop marker; the whole where nothing is left."""
    start = F.coalesce(*(F.nullif(F.instr(value, m), F.lit(0)) for m in START_MARKERS), F.lit(1))

    def cut(tail: Column) -> Column:
        stops = [F.when(F.instr(tail, m) > 1, F.instr(tail, m)) for m in STOP_MARKERS]
        return F.coalesce(F.left(tail, F.least(*stops) - 1), tail)

    body = strip(_with(F.substr(value, start), cut))
    return F.when(value == "", value).otherwise(F.coalesce(blank_to_null(body), value))


def trim_noise(value: Column) -> Column:
    """Cut at each marker in turn, each time before its first occurrence."""

    def step(text: Column, marker: Column) -> Column:
        at = F.position(marker, text)
        return F.when(at > 1, strip(F.left(text, at - 1))).otherwise(text)

    return blank_to_null(F.aggregate(F.array(*map(F.lit, NOISE_MARKERS)), strip(value), step))


def inferred_types(value: Column, most_lines: int = 45) -> Column:
    """struct(workplace, employment) that the first lines mention; the lines are taken once for both."""

    def mentioned(chunk: Column) -> Column:
        has = lambda *words: F.greatest(*(chunk.contains(w) for w in words)) if len(words) > 1 else chunk.contains(words[0])
        workplace = F.when(has("remote"), "remote").when(has("hybrid"), "hybrid").when(has("on-site", "onsite", "vor ort"), "on-site")
        employment = (
            F.when(has("part-time", "teilzeit"), "part-time")
            .when(has("full-time", "vollzeit"), "full-time")
            .when(has("internship", "praktikum"), "internship")
        )
        return F.struct(workplace.alias("workplace"), employment.alias("employment"))

    return _with(F.lower(F.array_join(F.slice(clean_lines(value), 1, most_lines), " ")), mentioned)


def joined(values: Column) -> Column:
    """The filled elements of an array in one text."""
    return F.array_join(F.filter(values, lambda x: x.isNotNull() & (x != "")), ", ")


# Kinds of roles by the words they are named with, in order of precedence.
ROLE_WORDS = (
    ("internship", "praktikum|praktikant|internship|intern"),
    ("working_student", "werkstudent|werksstudent|working student|werkstudium"),
    ("hiwi", "hiwi|studentische hilfskraft|student assistant|research assistant"),
    ("thesis", "masterarbeit|bachelorarbeit|thesis"),
)
_EDGE = r"[^\p{L}\p{N}_]"


def role_kind(text: Column, employment: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    kind = F.lower(F.coalesce(employment, F.lit("")))
    out = None
    for label, words in ROLE_WORDS:
        hit = low.rlike(f"(^|{_EDGE})({words})({_EDGE}|$)")
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return (
        out.when(kind.contains("full") | kind.contains("vollzeit"), "full_time_or_regular")
        .when(kind.contains("part") | kind.contains("teilzeit"), "part_time_regular")
        .otherwise("other")
    )
