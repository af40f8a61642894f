"""Page boilerplate mixed with main content (problem 1): site template removal.

A description is a tree: blocks divided by empty lines, lines, and the segments of a line divided by
a menu separator. Subtrees (blocks of several lines, lines, segments) are hashed after masking (leading
marks, digits, the host's own name, letter case, the character form of problem 4) and counted per host:

1. On how many pages of its host each subtree stands, and how many of them are of one employer: what
   recurs only because one employer's posting was copied is no template. Where one employer has more
   than `MOST_OF_HOST` of a host's pages, and on pages without a company, different postings (other
   title columns or other longest lines) count instead of employers. A subtree recurs from the share
   `LEAST_SHARE` of its host's pages on, and from `LEAST_PAGES`; on hosts too small for that, from the
   share `LEAST_POOLED_SHARE` of the pages of all hosts it stands on, if these are several.
2. A block that recurs is deleted whole. Section headings and stock phrases of employers recur as lines
   do, so recurring lines are told apart by their surroundings on their host: template lines stand beside
   other template lines, a heading stands beside text that stands nowhere else. A line is furniture
   unless more than half of its occurrences touch text that doesn't recur, or mostly name the employer,
   on its host (if it stands there `LEAST_JUDGED` times) or over all hosts.
3. Lines are deleted that are furniture, that consist of furniture segments only, or that list other
   postings below a furniture heading. The entries of such lists differ on every page; they are known
   by their words, most of which are frequent in the title, company and place columns.

Candidates are a table of (host, subtree). Pages and candidates are brought together by host, candidates
first, so that a task holds the candidates of one host at a time: lines per page / least_share at most.
The pages of a large host are divided over several tasks, each with a copy of that host's candidates.
Nothing that grows with hosts reaches the driver. Frequent title words travel with the tasks: words per
title / least_word_share at most, which is checked.

Defined results: null and empty descriptions have no lines and stay as they are; empty lines are never
furniture; pages without a host share one nameless host; each row is treated on its own, also under a
repeated key; hosts on which nothing recurs come out unchanged; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelake.llm.charform import form
from hirelake.runtime import spread, stored

LEAST_SHARE = 0.008
LEAST_PAGES = 5
#: The same for subtrees counted over several hosts.
LEAST_POOLED_SHARE = 0.006
LEAST_POOLED_PAGES = 8
#: Share of a subtree's pages that must be of other employers than its most frequent one.
LEAST_VARIED = 0.3
#: Share of a host's pages from which on one employer is the host's own.
MOST_OF_HOST = 0.5
LEAST_WORD_SHARE = 0.0005
MOST_BESIDE_TEXT = 0.5
#: Occurrences of a line on a host from which on its surroundings there count by themselves.
LEAST_JUDGED = 20
LIST_WORDS = 0.5
MOST_WORDS = 200_000
#: Pages of a host that go to one task.
TASK_PAGES = 50_000

_LEAD = re.compile(r"^[\W_]+")
_DIGITS = re.compile(r"\d+")
_SEGMENTS = re.compile(r"\s+[^\w\s]+\s+|\s{2,}")
_LETTERS = re.compile(r"[^\W\d_]+")

_LONG = pa.int64()
_MASK = (1 << 63) - 1


def masked(line: str, brand: str) -> str:
    """What two copies of a template line have in common."""
    key = _DIGITS.sub("0", _LEAD.sub("", line).rstrip()).casefold()
    return key.replace(brand, "@") if brand else key


def hashed(key: str) -> int:
    return xxhash.xxh64_intdigest(key) >> 1 or 1


def runs(keys: list[int]) -> Iterator[tuple[int, int]]:
    """(first line, line after the last) of each block of several lines."""
    start = 0
    for n, key in enumerate([*keys, 0]):
        if not key:
            if n - start > 1:
                yield start, n
            start = n + 1


def block_key(keys: list[int]) -> int:
    return xxhash.xxh64_intdigest(b"".join(k.to_bytes(8, "little") for k in keys), seed=1) & _MASK or 1


def brand_of(host: str) -> str:
    parts = host.split(".")
    return parts[-2] if len(parts) > 1 else ""


class _Lines(dict):
    """(line, brand) -> (masked line, its hash, whether it may be an entry of a list, hashes of its segments).

    Template lines come again and again, so a task remembers what it has read, up to `most` lines.
    """

    def __init__(self, words: frozenset[str], most: int = 100_000):
        super().__init__()
        self.words, self.most = words, most

    def __missing__(self, of: tuple[str, str]):
        if len(self) >= self.most:
            self.clear()
        line, brand = of
        parts = line.split()
        key = masked(line, brand) if parts else ""
        segments = ()
        # a divider is a word of its own without a letter, or more than one blank
        if len(line) > len(" ".join(parts)) or not all(p[0].isalnum() for p in parts):
            between = _SEGMENTS.split(line.strip())
            if len(between) > 1:
                segments = tuple(hashed(k) for k in (masked(p, brand) for p in between) if k)
        self[of] = found = key, hashed(key) if key else 0, _looks_listed(key, self.words), segments
        return found


class _Page:
    """The lines of one page with their hashes; 0 for empty lines."""

    __slots__ = ("lines", "keys", "listed", "segments")

    def __init__(self, text: str, brand: str, known: _Lines):
        found = [known[line, brand] for line in form(text).split("\n")]
        self.lines, self.keys, self.listed, segments = map(list, zip(*found))
        self.segments = {n: s for n, s in enumerate(segments) if s}


def _rows(batch: pa.RecordBatch):
    return zip(*(column.to_pylist() for column in batch.columns))


def _employer(company: str | None) -> str:
    """The first word of a company's name."""
    found = _LETTERS.findall(form(company).casefold()) if company else []
    return found[0] if found else ""


def _looks_listed(key: str, words: frozenset[str]) -> bool:
    found = _LETTERS.findall(key)
    return 0 < len(found) <= 16 and sum(w in words for w in found) >= LIST_WORDS * len(found)


LISTED, NAMES_EMPLOYER = 1, 2


def _parser(words, keep_text: bool):
    """Pages as numbers: an element hash and flags per line, and the menu segments with their lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Lines(words.value)
        for batch in batches:
            ids, hosts, employers, postings, keys, blocks, flags, segments, at = [], [], [], [], [], [], [], [], []
            for key, host, text, company, titles in _rows(batch):
                name = _employer(company)
                page = _Page(text or "", brand_of(host), known)
                named = len(name) > 2
                ids.append(key)
                hosts.append(host)
                employers.append(hashed(name) if name else None)
                postings.append(_posting(titles, page))
                keys.append(page.keys)
                blocks.append([block_key(page.keys[i:j]) for i, j in runs(page.keys)])
                flags.append(
                    bytes(
                        LISTED * listed + NAMES_EMPLOYER * (named and name in line)
                        for line, listed in zip(page.lines, page.listed)
                    )
                )
                segments.append([k for found in page.segments.values() for k in found])
                at.append([n for n, found in page.segments.items() for _ in found])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, batch.schema.field(0).type),
                    pa.array(hosts, pa.string()),
                    pa.array(employers, _LONG),
                    pa.array(postings, _LONG),
                    pa.array(keys, pa.list_(_LONG)),
                    pa.array(blocks, pa.list_(_LONG)),
                    pa.array(flags, pa.binary()),
                    pa.array(segments, pa.list_(_LONG)),
                    pa.array(at, pa.list_(pa.int32())),
                    *([batch.column(2)] if keep_text else []),
                ],
                names=["id", "host", "employer", "posting", "keys", "blocks", "flags", "segments", "segment_lines", *(["text"] if keep_text else [])],
            )

    return run


def _posting(titles: str, page: _Page) -> int:
    """The same for copies of a posting in any furniture, short of a page whose longest lines are furniture."""
    longest = sorted(set(page.lines), key=lambda line: (-len(line), line))[:3]
    return hashed("\n".join((titles.casefold(), *longest)))


REMOVABLE, HEADS = 1, 2


def _surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per host and candidate line: occurrences, and how many of them touch text, stand before a list, name the employer."""
    at, here = None, set()
    seen: dict[tuple[str, int], list[int]] = defaultdict(lambda: [0, 0, 0, 0])

    def counted() -> pa.RecordBatch:
        rows = [(*k, *v) for k, v in seen.items()]
        columns = list(zip(*rows)) if rows else [[]] * 6
        seen.clear()
        kinds = [pa.string(), *[_LONG] * 5]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)], names=["host", "key", "n", "beside_text", "before_list", "names_employer"]
        )

    for batch in batches:
        for host, part, candidate, _, keys, flags in _rows(batch.select(["host", "part", "candidate", "mark", "keys", "flags"])):
            if (host, part) != at:
                at, here = (host, part), set()
            if candidate is not None:
                here.add(candidate)
                continue
            recurs = [k in here for k in keys]
            if True not in recurs:
                continue
            text = [bool(k) and not r and not f & LISTED for k, r, f in zip(keys, recurs, flags)] + [False]
            last = len(keys) - 1
            for n, recurring in enumerate(recurs):
                if recurring:
                    row = seen[host, keys[n]]
                    row[0] += 1
                    row[1] += text[n - 1] or text[n + 1]
                    row[2] += n < last and keys[n + 1] != 0 and not recurs[n + 1] and flags[n + 1] & LISTED > 0
                    row[3] += flags[n] & NAMES_EMPLOYER > 0
        if len(seen) > 100_000:
            yield counted()
    yield counted()


def _furniture(keys, blocks, flags, segments, segment_lines, marks: dict[int, int]) -> list[int]:
    """The furniture lines of a page by the marks of its host's candidates."""
    whole: set[int] = set()
    for (i, j), block in zip(runs(keys), blocks):
        if marks.get(block, 0) & REMOVABLE:
            whole.update(range(i, j))
    menus: dict[int, bool] = {}
    for n, k in zip(segment_lines, segments):
        menus[n] = menus.get(n, True) and marks.get(k, 0) & REMOVABLE > 0
    lines, inside = [], False
    for n, k in enumerate(keys):
        if not k:
            inside = False
            continue
        mark = marks.get(k)
        if mark is not None and mark & REMOVABLE or n in whole:
            inside = mark is not None and mark & HEADS > 0
            lines.append(n)
        elif inside and mark is None and flags[n] & LISTED:
            lines.append(n)
        else:
            inside = False
            if menus.get(n):
                lines.append(n)
    return lines


def _main(text: str | None, lines: list[int]) -> str | None:
    """The text without these lines and the empty lines that they leave."""
    if not lines:
        return text
    gone = set(lines)
    kept = "\n".join(line for n, line in enumerate(text.split("\n")) if n not in gone)
    return re.sub(r"\n{3,}", "\n\n", kept).strip("\n")


def _marker(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, marks = None, {}
        for batch in batches:
            ids, found = [], []
            columns = ["host", "part", "candidate", "mark", "id", "keys", "blocks", "flags", "segments", "segment_lines", *(["text"] if with_text else [])]
            for host, part, candidate, mark, key, keys, blocks, flags, segments, segment_lines, *text in _rows(batch.select(columns)):
                if (host, part) != at:
                    at, marks = (host, part), {}
                if candidate is not None:
                    marks[candidate] = mark
                    continue
                lines = _furniture(keys, blocks, flags, segments, segment_lines, marks)
                ids.append(key)
                found.append(_main(text[0], lines) if with_text else lines)
            kind = pa.string() if with_text else pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, batch.schema.field("id").type), pa.array(found, kind)], names=["id", "main" if with_text else "furniture_lines"]
            )

    return run


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def frequent_words(df: DataFrame, columns: list[str], least_share: float = LEAST_WORD_SHARE) -> DataFrame:
    """Words on at least that share of rows, and on 3; words per row / least_share at most."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.concat_ws(" ", *columns)), F.lit(r"(\p{L}+)"), 1))
    counted = df.select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("rows"))
    return counted.where(F.col("rows") >= max(df.count() * least_share, 3)).select("word")


class SiteTemplates:
    """The furniture of the hosts in a table of pages; `marked()` gives the furniture lines of each page."""

    def __init__(
        self,
        pages: DataFrame,
        key: str,
        url: str,
        text: str,
        company: str,
        titles: list[str],
        least_share: float = LEAST_SHARE,
        least_pages: int = LEAST_PAGES,
        task_pages: int = TASK_PAGES,
        keep_text: bool = False,
    ):
        self.spark, self.key, self.task_pages = pages.sparkSession, key, task_pages
        self.kind = pages.schema[key].dataType.simpleString()
        found = frequent_words(pages, titles).limit(MOST_WORDS + 1).collect()
        if len(found) > MOST_WORDS:
            raise ValueError(f"more than {MOST_WORDS} frequent title words")
        words = self.spark.sparkContext.broadcast(frozenset(r["word"] for r in found))
        rows = pages.select(
            F.col(key).alias("id"), host_of(F.col(url)).alias("host"), F.col(text).alias("text"), F.col(company).alias("company"),
            F.concat_ws("\n", *titles).alias("titles"),
        )
        ddl = (
            f"id {self.kind}, host string, employer bigint, posting bigint, keys array<bigint>, blocks array<bigint>, flags binary, "
            "segments array<bigint>, segment_lines array<int>" + (", text string" if keep_text else "")
        )
        self.parsed = stored(spread(rows).mapInArrow(_parser(words, keep_text), ddl), "pages")
        self.candidates = stored(self._recurring(least_share, least_pages), "candidates")

    def _recurring(self, least_share: float, least_pages: int) -> DataFrame:
        """(host, key, pooled) of subtrees on many pages of the host, or else of several hosts."""
        filled = self.parsed.where(F.size("keys") > 0)
        shares = filled.groupBy("host", "employer").agg(F.count(F.lit(1)).alias("pages")).groupBy("host")
        shares = stored(
            shares.agg(F.sum("pages").alias("all"), F.max(F.when(F.col("employer").isNotNull(), F.col("pages"))).alias("most")), "hosts"
        )
        own = F.col("most") > MOST_OF_HOST * F.col("all")
        source = F.when(F.coalesce(own, F.lit(False)) | F.col("employer").isNull(), F.col("posting")).otherwise(F.col("employer"))
        filled = filled.join(shares, "host").withColumn("employer", source)
        subtrees = F.array_distinct(F.filter(F.concat("keys", "segments", "blocks"), lambda k: k != 0))
        counted = (
            filled.select("host", "employer", F.explode(subtrees).alias("key"))
            .groupBy("key", "host", "employer")
            .agg(F.count(F.lit(1)).alias("pages"))
        )
        varied = F.col("pages") - F.col("most") >= LEAST_VARIED * F.col("pages")
        # over all employers of a host, and of a key
        of_host = counted.groupBy("key", "host").agg(F.sum("pages").alias("pages"), F.max("pages").alias("most"))
        of_host = of_host.join(shares.select("host", "all"), "host")
        enough = (F.col("pages") >= F.greatest(F.lit(least_pages), F.ceil(F.col("all") * least_share))) & varied
        own_hosts = of_host.where(enough).select("host", "key", F.lit(False).alias("pooled"))
        several = of_host.groupBy("key").agg(
            F.sum("pages").alias("pages"), F.sum("all").alias("all"), F.count(F.lit(1)).alias("hosts")
        )
        several = several.where(
            (F.col("hosts") > 1) & (F.col("pages") >= F.greatest(F.lit(LEAST_POOLED_PAGES), F.ceil(F.col("all") * LEAST_POOLED_SHARE)))
        ).select("key")
        by_employer = counted.join(several, "key", "left_semi").groupBy("key", "employer").agg(F.sum("pages").alias("pages"))
        pooled = by_employer.groupBy("key").agg(F.sum("pages").alias("pages"), F.max("pages").alias("most")).where(varied).select("key")
        elsewhere = counted.join(pooled, "key").select("host", "key").distinct().withColumn("pooled", F.lit(True))
        return own_hosts.unionByName(elsewhere).groupBy("host", "key").agg(F.min("pooled").alias("pooled"))

    def _by_host(self, candidates: DataFrame, columns: list[str]) -> DataFrame:
        """Candidates (host, key, mark) and pages with these columns, by host and part of the host, candidates first."""
        sizes = self.parsed.groupBy("host").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") > self.task_pages)
        large = stored(sizes.select("host", F.ceil(F.col("pages") / self.task_pages).cast("int").alias("parts")), "large")
        parts = F.coalesce("parts", F.lit(1))
        pages = self.parsed.select("host", *columns).join(large, "host", "left")
        spreading = F.pmod(F.xxhash64(*([c for c in ("id", "keys") if c in columns])), parts).cast("int")
        none = F.lit(None)
        pages = pages.select("host", spreading.alias("part"), none.cast("bigint").alias("candidate"), none.cast("int").alias("mark"), *columns)
        kinds = {f.name: f.dataType for f in self.parsed.schema.fields}
        first = (
            candidates.join(large, "host", "left")
            .select("host", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.col("key").alias("candidate"), "mark")
            .select("*", *(none.cast(kinds[c]).alias(c) for c in columns))
        )
        together = first.unionByName(pages).repartition("host", "part")
        return together.sortWithinPartitions("host", "part", F.col("candidate").isNull())

    def judged(self) -> DataFrame:
        """(host, key, mark) of the candidates: mark 0 where a line is no furniture after all."""
        seen = stored(
            self._by_host(self.candidates.withColumn("mark", F.lit(0)), ["keys", "flags"])
            .mapInArrow(_surroundings, "host string, key bigint, n bigint, beside_text bigint, before_list bigint, names_employer bigint")
            .groupBy("host", "key")
            .agg(*(F.sum(c).alias(c) for c in ("n", "beside_text", "before_list", "names_employer"))),
            "surroundings",
        )
        everywhere = seen.groupBy("key").agg(*(F.sum(c).alias(f"all_{c}") for c in ("n", "beside_text", "before_list", "names_employer")))

        def clear(of: str) -> Column:
            n = F.col(f"{of}n")
            return (F.col(f"{of}beside_text") <= MOST_BESIDE_TEXT * n) & (F.col(f"{of}names_employer") <= 0.5 * n)

        heads = lambda of: F.col(f"{of}before_list") > 0.5 * F.col(f"{of}n")
        found = self.candidates.join(seen, ["host", "key"], "left").join(everywhere, "key", "left")
        mark = F.when(F.col("all_n").isNull(), REMOVABLE)  # a block or a segment has no surroundings: recurring is enough
        mark = mark.when(clear("all_") & ((F.coalesce("n", F.lit(0)) < LEAST_JUDGED) | clear("")), REMOVABLE + HEADS * heads("all_").cast("int")).otherwise(0)
        return found.select("host", "key", mark.cast("int").alias("mark"))

    def _marked(self, with_text: bool) -> DataFrame:
        columns = ["id", "keys", "blocks", "flags", "segments", "segment_lines", *(["text"] if with_text else [])]
        kind = "main string" if with_text else "furniture_lines array<int>"
        rows = self._by_host(stored(self.judged(), "judged"), columns)
        return rows.mapInArrow(_marker(with_text), f"id {self.kind}, {kind}").withColumnRenamed("id", self.key)

    def marked(self) -> DataFrame:
        """(key, furniture_lines) of every page."""
        return self._marked(False)

    def main_texts(self) -> DataFrame:
        """(key, main) of every page: the text without its furniture and the empty lines it leaves; needs keep_text."""
        return self._marked(True)
