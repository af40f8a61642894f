"""Matching jobs across sources without a common key (problem 7): soft-logic linkage.

1. Titles, companies, places and addresses of both sides become attributes: role, level, subject,
   place and employer names. Misspelt words are corrected against bounded vocabularies (role and level
   words, title words on at least `LEAST_WORD_SHARE` of rows, the words of the place list). The subject
   is every title word that is none of the others, nor a slot of a template; rare ones are corrected by
   a join to the only word one edit away that is `OFTENER` times as frequent. What title or place don't
   say is taken from the words of the address.
2. Pairs that agree in three of the four attributes employer, role (with level), subject and place are
   candidates, if the fourth is unknown to one side or similar: the employer spelt differently, the
   subject with a word in common. All kinds of agreement are keys of one equi-join of (key, id) rows, and
   an unknown attribute makes the side that lacks it the rare one. Listings with equal attributes are one,
   so a posting meets as many of them as there are other words beside the one in common, however many
   postings there are. Employers spelt differently meet through
   the distinct names, by the forms that up to two deletions leave of their beginnings; beside an unknown
   attribute one letter amiss or two swapped are the most. Subjects meet by any two of their words.
3. Every candidate has a variable between 0 and 1, its confidence. Weighted rules become hinge losses:
   similar attributes support a match, dissimilar ones speak against it, by degree; no match is the
   default. Hard and quadratic terms tie variables together:
   - a posting has one job, so the variables of one reading sum to 1 at most (exclusivity);
   - a listing is one job, so what its postings say otherwise than it, and otherwise than one another,
     sums to 1 at most over the different things said (exclusivity);
   - readings of one page are one job, and so are postings on different pages and boards that say the
     same of one listing: their variables are drawn together (transitivity).
4. The convex problem is solved by alternating directions. Terms within a page are solved in the task
   that holds the page, with one copy of a variable per term. Terms across pages form a table of factors:
   each round averages the pages' variables per listing and thing said, projects the averages of a
   listing onto its bound, and hands them back to the pages as targets, with multipliers for what still
   differs; a round is shuffles of aggregates, and ends when no variable moves by `STILL`.

Copies (equal attributes on one page; equal attributes in the feed) are one reading and one job each
until the result is written out per pair of rows.

Defined results: null and empty fields say nothing; a null page is a page of its own; records of which two
or more attributes are unknown match nothing; more than `MOST_SUBJECT_WORDS` words are a text, not a
subject; repeated rows match like their originals; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelake.llm.boilerplate import frequent_words
from hirelake.llm.charform import form
from hirelake.llm.residue import PLACEHOLDER
from hirelake.runtime import cut, spread, stored

LEAST_WORD_SHARE = 0.01
MOST_PLACES = 200_000
LEAST_CONFIDENCE = 0.6
OFTENER = 3
MOST_SUBJECT_WORDS = 40
#: Names some edits apart share a form of so many first letters with as many left out at most.
NAME_START = 8

# One word or two per role, English first, then German.
ROLES = {
    "working student": ("werkstudent", "werkstudentin", "werkstudierende"),
    "internship": ("intern", "praktikum", "praktikant", "praktikantin"),
    "graduation thesis": ("thesis", "abschlussarbeit", "masterarbeit", "bachelorarbeit"),
    "student helper": ("hilfskraft",),
    "developer": ("entwickler", "entwicklerin"),
    "engineer": ("ingenieur", "ingenieurin"),
    "analyst": ("analystin",),
    "consultant": ("berater", "beraterin"),
    "clerk": ("sachbearbeiter", "sachbearbeiterin"),
    "coordinator": ("koordinator", "koordinatorin"),
    "technician": ("techniker", "technikerin"),
    "editor": ("redakteur", "redakteurin"),
    "administrator": ("administratorin",),
    "tester": ("testerin",),
    "manager": ("managerin", "leiter", "leiterin"),
}
LEVELS = {
    "senior": ("senior", "seniorin"),
    "junior": ("junior", "juniorin"),
    "leading": ("leading", "lead", "leitender", "leitende", "leitend"),
}
# Frequent words of titles that say nothing about the job.
NOISE = frozenset(
    "ab sofort wir suchen neu new now hiring in an der am all genders gn m w d f x und and team ref kennziffer stellen "
    "jobs job html http https www utm source trk mail a of for the für im bei title titel stelle position id view".split()
)

# Words of company names that say nothing about the trade.
LEGAL_FORMS = frozenset("gmbh kg ag se ltd group co e v g m b h mbh inc aktiengesellschaft karriere deutschland".split())

_WORD = re.compile(r"[^\W\d_]+")
_SLOT = re.compile("|".join(f"(?:{pattern})" for _, pattern in PLACEHOLDER), re.IGNORECASE)
_ADDRESS_PARTS = re.compile(r"[/?&=.#]|--+")


def _plain(word: str) -> str:
    return word.replace("ä", "ae").replace("ö", "oe").replace("ü", "ue").replace("ß", "ss")


def _shorter(word: str) -> Iterator[str]:
    for n in range(len(word)):
        yield word[:n] + word[n + 1 :]


def one_edit(a: str, b: str) -> bool:
    """At most one letter replaced, added, left out, or two neighbours swapped."""
    if a == b:
        return True
    if len(a) > len(b):
        a, b = b, a
    n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    if len(a) == len(b):
        return a[n + 1 :] == b[n + 1 :] or (a[n : n + 2] == b[n : n + 2][::-1] and a[n + 2 :] == b[n + 2 :])
    return len(b) == len(a) + 1 and a[n:] == b[n + 1 :]


class Spelling(dict):
    """word -> the known word it is at most one edit from, or itself; remembers what it was asked."""

    def __init__(self, words, shortest: int = 5, most: int = 200_000):
        super().__init__()
        self.known, self.shortest, self.most = frozenset(words), shortest, most
        self.near: dict[str, list[str]] = {}
        self.unclear: set[str] = set()
        for word in sorted(self.known):
            for key in {word, *_shorter(word)} if len(word) >= shortest else ():
                self.near.setdefault(key, []).append(word)

    def __missing__(self, word: str) -> str:
        if len(self) >= self.most:
            self.clear()
            self.unclear.clear()
        found = word
        if word not in self.known and len(word) >= self.shortest - 1:
            near = {k for key in {word, *_shorter(word)} for k in self.near.get(key, ()) if one_edit(word, k)}
            if len(near) == 1:
                found = near.pop()
            elif near:
                self.unclear.add(word)
        self[word] = found
        return found


class Places:
    """Places by the words of their names; regions and rivers decide between places of one name."""

    def __init__(self, rows: list[tuple[int, str, str | None, str | None]]):
        self.bases: dict[str, set[int]] = {}
        self.base_of: dict[int, str] = {}
        self.of: dict[str, set[int]] = {}
        for ref, name, region, other in rows:
            words = _WORD.findall(name.lower())
            if not words:
                continue
            self.base_of[ref] = words[0]
            for word in [words[0], *_WORD.findall((other or "").lower())[:1]]:
                for spelled in {word, _plain(word)}:
                    self.bases.setdefault(spelled, set()).add(ref)
            for word in [*_WORD.findall((region or "").lower()), *words[1:][-1:]]:
                for spelled in {word, _plain(word)}:
                    self.of.setdefault(spelled, set()).add(ref)
        self.spelling = Spelling([*self.bases, *self.of])

    def find(self, words: list[str]) -> int | None:
        words = [self.spelling[w] for w in words]
        found = [self.bases[w] for w in words if w in self.bases]
        if not found:
            return None
        refs = set.union(*found)
        if len({self.base_of[r] for r in refs}) > 1:
            return None
        if len(refs) > 1:
            for word in words:
                if word in self.of and refs & self.of[word]:
                    refs = refs & self.of[word]
        return next(iter(refs)) if len(refs) == 1 else None


class Reader:
    """Attributes of a job from its fields."""

    def __init__(self, frequent: list[str], places: Places):
        self.places = places
        self.role = {word: name for name, words in ROLES.items() for word in (*(() if " " in name else (name,)), *words)}
        self.pairs = {tuple(name.split()): name for name in ROLES if " " in name}
        self.level = {word: name for name, words in LEVELS.items() for word in words}
        parts = {w for pair in self.pairs for w in pair}
        self.taken = frozenset({*self.role, *self.level, *parts, *NOISE, *places.bases, *places.of})
        self.subjects = frozenset(w for w in frequent if w not in self.taken and len(w) > 2)
        self.spelling = Spelling([*self.role, *self.level, *parts, *self.subjects])

    def _subject(self, words: list[str], names: set[str], own: list[str]) -> list[str]:
        """The words that are neither role, level, place nor noise, nor name the employer or the board."""
        found: dict[str, None] = {}
        follow: list[str] = []
        for word in words:
            if any(one_edit(word, n) if len(n) >= 5 else word == n for n in names):
                follow = own[1:]
            elif follow and word == follow[0]:
                follow = follow[1:]
            else:
                follow, spelled = [], self.spelling[word]
                if word in self.spelling.unclear:
                    return []  # one of several known words, but not known which
                if len(word) > 2 and spelled not in self.taken and self.places.spelling[word] not in self.taken:
                    found[spelled] = None
        return sorted(found) if len(found) <= MOST_SUBJECT_WORDS else []

    def title(self, words: list[str], names: set[str], own: list[str]) -> tuple[str | None, str, str | None]:
        """(role, level, subject)."""
        subject = self._subject(words, names, own)
        words = [self.spelling[w] for w in words if w not in names]
        role = next((self.pairs[p] for p in zip(words, words[1:]) if p in self.pairs), None) or next(
            (self.role[w] for w in words if w in self.role), None
        )
        level = next((self.level[w] for w in words if w in self.level), "")
        return role, level, " ".join(subject) or None

    def read(self, title, company, location, address, employer_address):
        own = _WORD.findall(form(company).lower()) if company else []
        name = own[0] if own else None
        trade = next((w[:4] for w in own[1:2] if w not in LEGAL_FORMS), None)
        host = employer_name(employer_address)
        names = {n for n in (name, host, employer_name(address)) if n}
        words = _WORD.findall(_SLOT.sub(" ", form(title)).lower()) if title else []
        role, level, subject = self.title(words, names, own)
        place = self.places.find(_WORD.findall(form(location).lower())) if location else None
        path = re.sub(r"^[a-z]+://[^/]*", "", (address or "").lower())
        if role is None or subject is None:
            for part in _ADDRESS_PARTS.split(path):
                slug_role, slug_level, slug_subject = self.title(_WORD.findall(part), {_plain(n) for n in names}, [_plain(w) for w in own])
                if slug_role and slug_subject:
                    role, level, subject = slug_role, slug_level, slug_subject
                    break
        if place is None:
            place = self.places.find(_WORD.findall(form(title).lower())) if title else None
        if place is None:
            place = self.places.find(_WORD.findall(path))
        return role, level if role else None, subject, place, name, host, trade


def employer_name(address: str | None) -> str | None:
    """The name in an employer's own host: the label before the last one."""
    match = re.match(r"[a-z]+://([^/?#:]+)", (address or "").lower())
    labels = match.group(1).split(".") if match else []
    return labels[-2] if len(labels) > 1 else None


ATTRIBUTES = "role string, level string, subject string, place int, name string, host string, trade string"


def _reading(reader):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = reader.value.read
        for batch in batches:
            fields = [c.to_pylist() for c in batch.columns[2:]]
            found = list(zip(*(read(*row) for row in zip(*fields)))) if batch.num_rows else [[]] * 7
            kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(v, k) for v, k in zip(found, kinds))],
                names=["id", "page", "role", "level", "subject", "place", "name", "host", "trade"],
            )

    return run


def attributes(df: DataFrame, key: str, reader, employer_address: Column, page: Column) -> DataFrame:
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("id"), page.alias("page"), "title", "company", "location_raw", "source_job_url", employer_address.alias("own"))
    return spread(rows).mapInArrow(_reading(reader), f"id {kind}, page bigint, {ATTRIBUTES}")


#: Weights of the rules: (supports a match, speaks against it), by attribute.
WEIGHTS = {"employer": (1.0, 4.0), "role": (1.0, 4.0), "subject": (1.0, 4.0), "place": (1.0, 4.0)}
UNKNOWN = 0.25
DEFAULT = 0.3
EXCLUSIVE = 10.0
SAME_PAGE = 10.0
STEP, ROUNDS = 1.0, 60
#: Weight of the ties across pages; their rounds end when no variable moves by STILL.
TIE, MOST_TIE_ROUNDS, STILL = 1.0, 12, 0.01


def solve(
    similar: np.ndarray, weight: np.ndarray, reading: np.ndarray, listing: np.ndarray, page_job: np.ndarray, target: np.ndarray | None = None
) -> np.ndarray:
    """The variables: similar and weight by candidate and attribute (support, against in weight[..., 0:2]).

    reading: which candidates exclude one another, unless they are one job listed twice (listing);
    page_job: which are one job seen twice; target: where the ties across pages draw each.
    """
    n, k = similar.shape
    terms = k + 3 + (target is not None)
    copies = np.full((n, terms), 0.5)
    duals = np.zeros((n, terms))
    shared = np.full(n, 0.5) if target is None else np.clip(target, 0, 1)
    in_page = np.bincount(page_job)
    part = 1 / np.bincount(listing)[listing]  # a job listed n times counts once
    squares = np.bincount(reading, weights=part**2)
    for _ in range(ROUNDS):
        start = shared[:, None] - duals
        rules = start[:, :k]
        up = np.minimum(similar, rules + weight[..., 0] / STEP)
        down = np.maximum(similar, rules - weight[..., 1] / STEP)
        copies[:, :k] = np.where(rules < similar, up, down)
        copies[:, k] = start[:, k] - DEFAULT / STEP
        excess = np.bincount(reading, weights=part * start[:, k + 1]) - 1
        step = np.minimum(np.maximum(excess, 0) / squares, EXCLUSIVE / STEP)
        copies[:, k + 1] = start[:, k + 1] - part * step[reading]
        mean = np.bincount(page_job, weights=start[:, k + 2], minlength=len(in_page)) / np.maximum(in_page, 1)
        copies[:, k + 2] = mean[page_job] + (start[:, k + 2] - mean[page_job]) / (1 + 2 * SAME_PAGE / STEP)
        if target is not None:
            copies[:, k + 3] = (STEP * start[:, k + 3] + TIE * target) / (STEP + TIE)
        shared = np.clip((copies + duals).mean(axis=1), 0, 1)
        duals += copies - shared[:, None]
    return shared


def _solver(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates sorted by page; whole pages are solved together, many at a time. Adds value, replacing an older one."""
    waiting: list[pa.RecordBatch] = []
    size = 0

    def solved(rows: pa.Table) -> pa.RecordBatch:
        names = list(WEIGHTS)
        similar = np.stack([rows[n].to_numpy(zero_copy_only=False) for n in names], axis=1)
        unknown = np.isnan(similar)
        weight = np.broadcast_to(np.array([WEIGHTS[n] for n in names]), (*similar.shape, 2)).copy()
        weight[unknown] = UNKNOWN
        number = lambda *columns: np.unique(np.stack(columns, axis=1), axis=0, return_inverse=True)[1].ravel()
        a, f, page, job, target = (rows[c].to_numpy(zero_copy_only=False) for c in ("a", "f", "page", "job", "target"))
        tied = None if np.isnan(target).all() else np.where(np.isnan(target), 0.5, target)
        found = solve(np.where(unknown, 0.5, similar), weight, number(a), number(a, job), number(page, f), tied)
        return rows.set_column(rows.schema.get_field_index("value"), "value", pa.array(found)).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        waiting.append(batch)
        size += batch.num_rows
        if size >= 50_000:
            rows = pa.Table.from_batches(waiting).combine_chunks()
            pages = rows["page"].to_numpy()
            whole = int(np.searchsorted(pages, pages[-1]))
            if whole:
                yield solved(rows.slice(0, whole))
                rest = rows.slice(whole).to_batches()
                waiting, size = rest, sum(b.num_rows for b in rest)
    if waiting:
        yield solved(pa.Table.from_batches(waiting).combine_chunks())


def _by_page(rows: DataFrame) -> DataFrame:
    return rows.repartition("page").sortWithinPartitions("page").mapInArrow(_solver, rows.schema)


def confidences(candidates: DataFrame) -> DataFrame:
    """Candidates (page, a, f, job, said, similarities) with the value of their variables."""
    none = F.lit(float("nan"))
    rows = candidates.select("*", none.alias("target"), none.alias("value"), F.lit(0.0).alias("u"))
    now = stored(_by_page(rows), "round")
    for _ in range(MOST_TIE_ROUNDS):
        v = F.col("value") + F.col("u")
        said = now.groupBy("f", "said").agg(F.avg(v).alias("mean"))
        bound = said.groupBy("f").agg(F.sum("mean").alias("all"), F.count(F.lit(1)).alias("things"))
        excess = F.greatest(F.col("all") - 1, F.lit(0.0)) / F.col("things")
        agreed = said.join(bound.hint("shuffle_merge"), "f").select("f", "said", F.greatest(F.col("mean") - excess, F.lit(0.0)).alias("agreed"))
        tied = (
            now.join(agreed.hint("shuffle_merge"), ["f", "said"])
            .withColumn("u", v - F.col("agreed"))
            .withColumn("target", F.col("agreed") - F.col("u"))
            .withColumn("before", F.col("value"))
        )
        after = stored(_by_page(tied.select(*now.columns, "before")), "round")
        moved = after.agg(F.max(F.abs(F.col("value") - F.col("before")))).first()[0]
        now = after.drop("before")
        if moved is None or moved < STILL:
            break
    return now


def _employer_similarity() -> Column:
    """1 for the same name; less for misspelt ones, if the trades in the names don't differ."""
    trades = F.levenshtein("a_trade", "f_trade") > 2
    same = lambda x, y: (F.length(x) == F.length(y)) & (F.sort_array(F.split(x, "")) == F.sort_array(F.split(y, "")))
    best = lambda x, y: (
        F.when(F.col(x) == F.col(y), 1.0)
        .when((F.levenshtein(x, y) <= 2) & F.coalesce(trades, F.lit(False)), 0.0)
        .when((F.levenshtein(x, y) == 1) | ((F.levenshtein(x, y) == 2) & same(x, y)), 0.95)
        .when(F.levenshtein(x, y) == 2, F.when(F.length(x) >= 8, 0.8).otherwise(0.4))
        .when(F.col(x).isNotNull() & F.col(y).isNotNull(), 0.0)
    )
    return F.greatest(*(best(f"a_{x}", f"f_{y}") for x in ("name", "host") for y in ("name", "host")))


def _subject_similarity() -> Column:
    """1 for the same words, less where one side has more, half the share in common at other words. NaN: unknown."""
    a, f = F.split("a_subject", " "), F.split("f_subject", " ")
    common = F.size(F.array_intersect(a, f))
    return (
        F.when(F.col("a_subject").isNull() | F.col("f_subject").isNull(), F.lit(float("nan")))
        .when(F.col("a_subject") == F.col("f_subject"), 1.0)
        .when((common >= 2) & (common == F.least(F.size(a), F.size(f))), 0.9)
        .when((common == 1) & (F.least(F.size(a), F.size(f)) == 1), 0.55)
        .otherwise(0.5 * common / F.greatest(F.size(a), F.size(f)))
    )


def _all_similar() -> Column:
    """No attribute is known to be another."""
    return _all([F.nullif(F.col(c), F.lit(0.0)) for c in WEIGHTS])


def _said_otherwise() -> Column:
    """What a posting says otherwise than a listing; the same for all that say nothing otherwise."""
    other = lambda c, x: F.when(F.col(c) < 0.9, F.coalesce(x, F.lit(""))).otherwise(F.lit(""))
    return F.xxhash64(
        other("role", F.concat_ws(" ", "a_role", "a_level")), other("subject", F.col("a_subject")), other("place", F.col("a_place").cast("string")),
        other("employer", F.coalesce("a_name", "a_host")),
    )


def _keys(s: str) -> Column:
    """What a row of side s ("a" or "f") with an employer's name in who must share with a row of the other side.

    A key says which attribute may be unknown, and on which side; only rows that lack it have it there.
    """
    role, level, place, subject = (F.col(f"{s}_{c}") for c in ("role", "level", "place", "subject"))
    words = F.when(subject.isNull(), F.array().cast("array<string>")).otherwise(F.split(subject, " "))
    pairs = F.flatten(F.transform(words, lambda x: F.transform(F.filter(words, lambda y: y > x), lambda y: F.concat(x, F.lit(" "), y))))
    pairs = F.when(F.size(words) == 1, words).otherwise(pairs)
    none = F.array().cast("array<bigint>")

    def keys(name: str, condition: Column, among: Column, *of: Column) -> Column:
        return F.when(condition & _all(of), F.transform(among, lambda w: F.xxhash64(F.lit(name), w, *of))).otherwise(none)

    def lacking(name: str, attribute: Column, among: Column, *of: Column) -> list[Column]:
        """Keys for the attribute unknown to this side, and for it unknown to the other."""
        other = "f" if s == "a" else "a"
        return [
            keys(f"{name} {s}", F.col("close") & attribute.isNull(), among, *of),
            keys(f"{name} {other}", F.col("close"), among, *of),
        ]

    who = F.col("who")
    whole = F.array(F.lit(""))
    return F.array_distinct(
        F.concat(
            keys("all", who.isNotNull(), pairs, who, role, level, place),
            *lacking("place", place, pairs, who, role, level),
            *lacking("role", role, pairs, who, place),
            *lacking("subject", subject, whole, who, role, level, place),
            keys("word", F.col("close"), words, who, role, level, place),
            keys(f"employer {s}", F.col("nameless"), pairs, role, level, place),
            keys(f"employer {'f' if s == 'a' else 'a'}", F.col("first"), pairs, role, level, place),
        )
    )


def _all(columns) -> Column:
    """No column is null."""
    out = F.lit(True)
    for c in columns:
        out = out & c.isNotNull()
    return out


def _corrections(sides: list[DataFrame], known: DataFrame) -> DataFrame:
    """(subject, spelled) of the subjects that hold a rare word and a much more frequent one is one edit from it."""
    subjects = sides[0].select("subject").unionByName(sides[1].select("subject")).where(F.col("subject").isNotNull())
    of = subjects.select("subject", F.explode(F.split("subject", " ")).alias("word"))
    counted = cut(of.groupBy("word").agg(F.count(F.lit(1)).alias("rows")).where(F.length("word") >= 4))
    rare = counted.join(F.broadcast(known), "word", "left_anti")
    part = lambda df: df.withColumn("part", F.explode(_deletions(F.col("word"))))
    better = part(counted.where(F.length("word") >= 5)).select("part", F.col("word").alias("as"), F.col("rows").alias("more"))
    found = (
        part(rare)
        .join(better.hint("shuffle_merge"), "part")
        .where((F.col("more") >= OFTENER * F.col("rows")) & (F.col("word") != F.col("as")) & _one_edit("word", "as"))
        .groupBy("word")
        .agg(F.collect_set("as").alias("as"))
        .where(F.size("as") == 1)
        .select("word", F.col("as")[0].alias("as"))
    )
    wrong = of.distinct().join(found, "word").groupBy("subject").agg(F.map_from_entries(F.collect_list(F.struct("word", "as"))).alias("as"))
    words = F.transform(F.split("subject", " "), lambda w: F.coalesce(F.col("as")[w], w))
    return wrong.select("subject", F.array_join(F.array_sort(F.array_distinct(words)), " ").alias("spelled"))


def _deletions(name: Column, most: int = 1) -> Column:
    """The first letters of a name, and with up to `most` of them left out, but never all."""
    start = F.substring(name, 1, NAME_START)
    without = lambda x: F.transform(
        F.sequence(F.lit(1), F.length(x)), lambda n: F.concat(F.substring(x, F.lit(1), n - 1), F.substr(x, n + 1))
    )
    found = F.array(start)
    for _ in range(most):
        found = F.array_distinct(F.concat(found, F.flatten(F.transform(F.filter(found, lambda x: F.length(x) > 1), without))))
    return found


def _one_edit(x: str, y: str) -> Column:
    """At most one letter replaced, added or left out, or two swapped."""
    same = F.sort_array(F.split(x, "")) == F.sort_array(F.split(y, ""))
    distance = F.levenshtein(x, y)
    return (distance <= 1) | ((distance == 2) & (F.length(x) == F.length(y)) & same)


def near_names(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a_who, who, close) of every distinct name of left and name of right at most two edits from it; close: one."""
    sides = [
        df.select("who").where(F.col("who") != "").distinct().withColumn("part", F.explode(_deletions(F.col("who"), 2))).withColumnRenamed("who", name)
        for df, name in ((left, "a_who"), (right, "who"))
    ]
    found = sides[0].join(sides[1].hint("shuffle_merge"), "part").select("a_who", "who").distinct()
    return found.where(F.levenshtein("a_who", "who", 2) >= 0).withColumn("close", _one_edit("a_who", "who"))


class Linkage:
    """Jobs of two tables: left has many readings of pages, right one row per listed job."""

    def __init__(self, left: DataFrame, left_key: str, page: str, left_address: str, right: DataFrame, right_key: str, places: DataFrame):
        spark = left.sparkSession
        self.left_key, self.right_key = left_key, right_key
        listed = places.select("ref_id", "canonical_value", "place_region", "other_name").limit(MOST_PLACES + 1).collect()
        if len(listed) > MOST_PLACES:
            raise ValueError(f"more than {MOST_PLACES} listed places")
        titles = left.select("title").unionByName(right.select("title"))
        words = [r["word"] for r in frequent_words(titles, ["title"], LEAST_WORD_SHARE).collect()]  # 1 / share per title word
        reader = spark.sparkContext.broadcast(Reader(sorted(words), Places([tuple(r) for r in listed])))
        columns = ["role", "level", "subject", "place", "name", "host", "trade"]
        own_page = F.coalesce(F.when(F.col(page).isNotNull(), F.xxhash64(page)), F.xxhash64(F.lit("row"), left_key))
        mine = cut(attributes(left, left_key, reader, F.col(left_address), own_page))
        theirs = cut(attributes(right, right_key, reader, F.col("source_job_url"), F.lit(0).cast("bigint")))
        known = spark.createDataFrame([(w,) for w in words], "word string")
        spelled = cut(_corrections([mine, theirs], known))
        correct = lambda df: df.join(spelled.hint("shuffle_merge"), "subject", "left").withColumn("subject", F.coalesce("spelled", "subject")).drop("spelled")
        self.mine = cut(correct(mine).withColumn("a", F.xxhash64("page", *columns)))
        self.theirs = cut(correct(theirs).drop("page").withColumn("f", F.xxhash64(*columns)))
        self.columns = columns

    def candidates(self) -> DataFrame:
        """(page, a, f, job, said, similarities) of the pairs that agree in three attributes."""
        a = self.mine.select("a", "page", *(F.col(c).alias(f"a_{c}") for c in self.columns)).dropDuplicates(["a"])
        f = self.theirs.select("f", *(F.col(c).alias(f"f_{c}") for c in self.columns)).dropDuplicates(["f"])
        names = lambda s: F.array_distinct(F.array_compact(F.array(f"{s}_name", f"{s}_host")))
        # a row per name; the first of them also stands for the row where the other side has no name
        named = lambda df, s, name: df.select(
            "*", F.posexplode_outer(names(s)).alias("at", name)
        ).withColumns({"first": F.coalesce(F.col("at"), F.lit(0)) == 0, "nameless": F.col(name).isNull()}).drop("at")
        mine, theirs = named(a, "a", "a_who"), named(f, "f", "who").withColumn("close", F.lit(True))
        near = stored(near_names(mine.select(F.col("a_who").alias("who")), theirs), "names")
        # by the names that the feed has; rows whose names it hasn't can still lack a counterpart's name
        mine = mine.join(near.hint("shuffle_merge"), "a_who", "left").withColumn("close", F.coalesce("close", F.lit(True)))
        keyed = lambda df, s: df.select(s, F.explode(_keys(s)).alias("key")).distinct()
        # all of these grow with the rows: no side is broadcast because it is small once compressed
        found = keyed(mine, "a").join(keyed(theirs, "f").hint("shuffle_merge"), "key").select("a", "f").distinct()
        found = found.join(a.hint("shuffle_merge"), "a").join(f.hint("shuffle_merge"), "f")
        equal = lambda x, y: F.when(F.col(x).isNull() | F.col(y).isNull(), F.lit(float("nan"))).otherwise((F.col(x) == F.col(y)).cast("double"))
        # listings that only add to what a posting says are one job to it
        said = F.array_join(F.array_intersect(F.split("f_subject", " "), F.split("a_subject", " ")), " ")
        return (
            found.withColumn("employer", F.coalesce(_employer_similarity(), F.lit(float("nan"))))
            .withColumn(
                "role", F.when(F.col("a_level") == F.col("f_level"), equal("a_role", "f_role")).otherwise(
                    F.when(F.col("a_role").isNull() | F.col("f_role").isNull(), F.lit(float("nan"))).otherwise(F.lit(0.0))
                )
            )
            .withColumn("subject", _subject_similarity())
            .withColumn("place", equal("a_place", "f_place"))
            .where(_all_similar())
            .withColumn("said", _said_otherwise())
            .withColumn("job", F.xxhash64("f_role", "f_level", F.coalesce(said, "f_subject"), "f_place"))
            .select("page", "a", "f", "job", "said", *WEIGHTS)
        )

    def matches(self, least: float = LEAST_CONFIDENCE) -> DataFrame:
        """(left_key, right_key, confidence) of every pair of rows that are the same job."""
        found = confidences(self.candidates()).select("a", "f", F.col("value").alias("confidence")).where(F.col("confidence") >= least)
        return (
            found.join(self.mine.select("a", F.col("id").alias(self.left_key)).hint("shuffle_merge"), "a")
            .join(self.theirs.select("f", F.col("id").alias(self.right_key)).hint("shuffle_merge"), "f")
            .groupBy(self.left_key, self.right_key)
            .agg(F.max("confidence").alias("confidence"))
        )
