"""Excerpts of descriptions: sections, signal lines and a budget of characters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hirelake.functions.text import fold, lines

MOST_CHARACTERS = 2800
LEAST_CHARACTERS = 500
HEADING_LENGTH = 90

# Headings of sections to keep, headings that end them, and words that make any line worth keeping.
KEEP_HEADINGS = (
    "your responsibilities", "responsibilities", "what you'll do", "what you will do", "tasks", "your tasks",
    "requirements", "your profile", "profile", "qualifications", "skills", "what you bring", "what you'll need",
    "what you will need", "about you", "aufgaben", "deine aufgaben", "ihre aufgaben", "taetigkeiten", "anforderungen",
    "dein profil", "ihr profil", "profil", "qualifikation", "qualifikationen", "das bringst du mit",
    "das bringen sie mit", "was du mitbringst", "was sie mitbringen", "voraussetzungen", "kenntnisse",
)
STOP_HEADINGS = (
    "benefits", "your value", "your benefits", "what we offer", "we offer", "about us", "about the company", "company",
    "diversity", "equal opportunity", "apply now", "how to apply", "contact", "deine vorteile", "ihre vorteile",
    "dein mehrwert", "ihr mehrwert", "mehrwert", "was wir bieten", "was bieten wir", "unser angebot", "ueber uns",
    "unternehmen", "wer wir sind", "diversitaet", "chancengleichheit", "bewirb dich", "bewerben sie sich", "bewerbung",
    "kontakt", "dein ansprechpartner", "ihr ansprechpartner",
)
SIGNALS = (
    "python", "java", "c++", "sql", "javascript", "typescript", "rust", "backend", "frontend", "fullstack", "data",
    "daten", "machine learning", "ki", "ai", "llm", "power bi", "excel", "cloud", "docker", "linux", "api", "database",
    "postgres", "werkstudent", "working student", "praktikum", "internship", "hiwi", "thesis", "masterarbeit",
    "20 stunden", "20 hours", "teilzeit", "part-time", "remote", "hybrid", "on-site", "vor ort", "deutsch", "german",
    "englisch", "english", "b1", "b2", "c1", "c2", "a2",
)


def _any(line: Column, words: tuple[str, ...]) -> Column:
    """Whether a line holds one of the words; one pass over it."""
    escaped = "|".join("".join("\\" + c if c in "+.*?()[]{}|^$\\" else c for c in w) for w in words)
    return line.rlike(escaped)


def sections(parts: Column) -> Column:
    """The kept lines of an array of lines.

    A keep heading opens a section and stays; a stop heading after the first keep heading closes it and
    goes; within a section every line stays, outside only lines with a signal.
    """
    state = F.struct(
        F.array().cast("array<string>").alias("kept"), F.lit(False).alias("inside"), F.lit(False).alias("seen")
    )

    def marks(line: Column) -> Column:
        """What a line is, found once per line."""
        heading = F.length(line) <= HEADING_LENGTH
        folded = lambda words: _with(fold(line), lambda f: _any(f, words))
        return F.struct(
            line.alias("line"),
            (heading & folded(KEEP_HEADINGS)).alias("keep"),
            (heading & folded(STOP_HEADINGS)).alias("stop"),
            folded(SIGNALS).alias("signal"),
        )

    def step(s: Column, x: Column) -> Column:
        stop = x["stop"] & s["seen"] & ~x["keep"]
        inside = x["keep"] | (s["inside"] & ~stop)
        return F.struct(
            F.when(inside | (~stop & x["signal"]), F.concat(s["kept"], F.array(x["line"]))).otherwise(s["kept"]).alias("kept"),
            inside.alias("inside"),
            (s["seen"] | x["keep"]).alias("seen"),
        )

    return F.aggregate(F.transform(parts, marks), state, step, lambda s: s["kept"])


def _with(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def excerpt(text: Column) -> Column:
    """The kept lines; all lines where they have fewer than LEAST_CHARACTERS characters."""

    def choose(parts: Column) -> Column:
        kept = F.array_join(sections(parts), "\n")
        return _with(kept, lambda k: F.when(F.length(k) < LEAST_CHARACTERS, F.array_join(parts, "\n")).otherwise(k))

    return _with(lines(text), choose)


def compact(text: Column) -> Column:
    """The excerpt within the budget, cut after a whole line where there is one; null for null and empty."""

    def fit(body: Column) -> Column:
        head = F.left(body, F.lit(MOST_CHARACTERS))
        short = F.when(head.contains("\n"), F.regexp_replace(head, r"\n[^\n]*$", "")).otherwise(head)
        return F.when(F.length(body) <= MOST_CHARACTERS, body).otherwise(short)

    return F.when(text != "", _with(excerpt(text), fit))
