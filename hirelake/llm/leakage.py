"""Evaluation texts leaking into training text (problem 9): suffix arrays over corpus shards.

1. Each task lays documents end to end as word numbers, divided by a number no word has, up to
   `SHARD_WORDS` words, and sorts all positions by the words that follow them: prefix doubling over the
   whole shard up to 16 words, then over the positions that still tie. A shard is written once as a row
   with its words, its text and its sorted positions, in the shared folder; nothing is shuffled. Each row is
   a file of its own, so that a task holds one shard at a time, however large its part of the corpus is.
2. Every suffix of every test item is looked up in every shard by binary search, word by word, for all
   suffixes at once. Where `least` words occur, each occurrence is followed to its end; occurrences that a
   word before would make longer are parts of others and left out. What remains are all verbatim matches
   of `least` words and more, with their places.
3. Documents with a match are removed.

The test items travel with the tasks, as word numbers. Their size is checked: beyond `most_item_words` words they are
searched in several blocks, each under that bound, in the shards written once.

Defined results: null and empty texts and texts shorter than `least` words match nothing; items
shorter than `least` words match nothing; repeated items each get their matches; a document under
two keys gets matches under both; a document longer than a shard is a shard of its own; empty tables give
no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelake.llm.words import WordIds, split_words
from hirelake.runtime import stored

LEAST_WORDS = 13
SHARD_WORDS = 2_000_000
MOST_ITEM_WORDS = 2_000_000
#: Words by which all positions are sorted before only ties are.
FIRST_WORDS = 16


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The positions of text in the order of what follows them."""
    n = len(text)
    rank, size = text.astype(np.int64) + 1, 1  # 0 is beyond the end
    order = np.argsort(rank, kind="stable")
    while size < FIRST_WORDS and size < n:
        key = rank << 32
        key[: n - size] |= rank[size:]
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        first = np.ones(n, dtype=bool)
        first[1:] = ordered[1:] != ordered[:-1]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(first)
        size *= 2
    if size >= n:
        return order
    del key, ordered
    while True:
        # ranks become places, so that a group's members can be told apart without touching other groups
        place = np.flatnonzero(first)[np.cumsum(first) - 1]
        rank[order] = place + 1
        alone = first.copy()
        alone[:-1] &= first[1:]
        tied = np.flatnonzero(~alone)
        if not len(tied):
            return order
        at = order[tied]
        after = np.zeros(len(at), dtype=np.int64)
        inside = at + size < n
        after[inside] = rank[at[inside] + size]
        again = np.lexsort((after, place[tied]))
        order[tied] = at[again]
        new = np.ones(len(tied), dtype=bool)
        new[1:] = (place[tied][1:] != place[tied][:-1]) | (after[again][1:] != after[again][:-1])
        if new.all():
            return order
        first[tied] = new
        size *= 2


def _bound(text: np.ndarray, order: np.ndarray, low, high, depth: int, wanted, upper: bool) -> np.ndarray:
    """Per query the first place in [low, high) whose word at depth isn't below (or, upper, is above) the wanted one."""
    low, high = low.copy(), high.copy()
    while True:
        open_ = low < high
        if not open_.any():
            return low
        middle = (low + high) // 2
        at = order[np.minimum(middle, len(order) - 1)] + depth
        word = np.where(at < len(text), text[np.minimum(at, len(text) - 1)], -1)
        right = open_ & ((word <= wanted) if upper else (word < wanted))
        low = np.where(right, middle + 1, low)
        high = np.where(open_ & ~right, middle, high)


def find(text: np.ndarray, order: np.ndarray, query: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in text, place in query, words) of all verbatim matches of `least` words that can't begin a word earlier.

    0 in text and in query divides documents and items and matches nothing; -1 is a word text hasn't.
    """
    none = np.zeros(0, dtype=np.int64)
    starts = np.arange(max(0, len(query) - least + 1))
    low, high = np.zeros(len(starts), dtype=np.int64), np.full(len(starts), len(order), dtype=np.int64)
    for depth in range(least):
        wanted = query[starts + depth]
        known = wanted > 0
        starts, low, high, wanted = starts[known], low[known], high[known], wanted[known]
        if not len(starts):
            return none, none, none
        low, high = (_bound(text, order, low, high, depth, wanted, upper) for upper in (False, True))
        alive = low < high
        starts, low, high = starts[alive], low[alive], high[alive]
    counts = high - low
    q = np.repeat(starts, counts)
    t = order[np.repeat(low - np.concatenate(([0], np.cumsum(counts)))[:-1], counts) + np.arange(counts.sum())].astype(np.int64)
    earlier = (q > 0) & (t > 0) & (query[np.maximum(q - 1, 0)] == text[np.maximum(t - 1, 0)]) & (query[np.maximum(q - 1, 0)] > 0)
    q, t = q[~earlier], t[~earlier]
    length, growing = np.full(len(q), least, dtype=np.int64), np.arange(len(q))
    while len(growing):
        a, b = q[growing] + length[growing], t[growing] + length[growing]
        inside = (a < len(query)) & (b < len(text))
        growing, a, b = growing[inside], a[inside], b[inside]
        same = (query[a] == text[b]) & (query[a] > 0)
        growing = growing[same]
        length[growing] += 1
    return t, q, length


def laid_out(pieces: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(where each piece begins, the pieces end to end with 0 after each)."""
    begins = np.concatenate(([0], np.cumsum([len(p) + 1 for p in pieces], dtype=np.int64)))
    text = np.zeros(int(begins[-1]), dtype=np.int32)
    for begin, piece in zip(begins, pieces):
        text[begin : begin + len(piece)] = piece
    return begins[:-1].astype(np.int32), text


_SHARD = [("begins", pa.binary()), ("text", pa.binary()), ("order", pa.binary()), ("words", pa.list_(pa.string()))]


def _builder(least: int, shard_words: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, pieces, ids, size, kind = [], [], WordIds(), 0, None

        def shard() -> pa.RecordBatch:
            begins, text = laid_out(pieces)
            order = suffix_array(text).astype(np.int32)
            values = [begins.tobytes(), text.tobytes(), order.tobytes(), list(ids)]
            return pa.RecordBatch.from_arrays(
                [pa.array([keys], pa.list_(kind)), *(pa.array([v], t) for v, (_, t) in zip(values, _SHARD))], names=["keys", *(n for n, _ in _SHARD)]
            )

        for batch in batches:
            kind = batch.schema.field(0).type
            for key, text in zip(batch.column(0), batch.column(1)):
                words = split_words(text.as_py() or "")
                if len(words) < least:
                    continue
                if pieces and size + len(words) > shard_words:
                    yield shard()
                    keys, pieces, ids, size = [], [], WordIds(), 0
                keys.append(key.as_py())
                pieces.append(np.fromiter(map(ids.__getitem__, words), dtype=np.int32, count=len(words)))
                size += len(words)
        if pieces:
            yield shard()

    return build


def _searcher(block, least: int, item_kind: pa.DataType):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, begins_of, codes, item_words = block.value
        for batch in batches:
            for keys, begins, text, order, words in zip(*batch.columns):
                begins, text, order = (np.frombuffer(x.as_buffer(), dtype=np.int32) for x in (begins, text, order))
                known = pc.index_in(pa.array(item_words, words.type.value_type), value_set=words.values)
                query = np.concatenate(([0], pc.add(known, 1).fill_null(-1).to_numpy()))[codes]
                t, q, length = find(text, order, query, least)
                doc, item = np.searchsorted(begins, t, side="right") - 1, np.searchsorted(begins_of, q, side="right") - 1
                yield pa.RecordBatch.from_arrays(
                    [
                        keys.values.take(pa.array(doc)), pa.array([items[i] for i in item], item_kind), pa.array(length, pa.int32()),
                        pa.array(t - begins[doc], pa.int32()), pa.array(q - begins_of[item], pa.int32()),
                    ],
                    names=["doc", "item", "words", "doc_word", "item_word"],
                )

    return search


def item_blocks(items: DataFrame, item_key: str, item_text: str, most_words: int):
    """(items, where each begins, word numbers, words) of blocks under the bound, read block by block."""
    keys, pieces, ids, size = [], [], WordIds(), 0
    for row in items.select(item_key, item_text).toLocalIterator():
        words = split_words(row[1] or "")
        if keys and size + len(words) > most_words:
            yield keys, *laid_out(pieces), list(ids)
            keys, pieces, ids, size = [], [], WordIds(), 0
        keys.append(row[0])
        pieces.append(np.fromiter(map(ids.__getitem__, words), dtype=np.int32, count=len(words)))
        size += len(words)
    if keys:
        yield keys, *laid_out(pieces), list(ids)


class SuffixShards:
    """The suffix arrays of a corpus, written once; matches() searches them for test items."""

    def __init__(self, documents: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST_WORDS, shard_words: int = SHARD_WORDS):
        self.key, self.least, self.kind = key, least, documents.schema[key].dataType.simpleString()
        rows = documents.select(F.col(key).alias("id"), F.col(text).alias("text"))
        ddl = f"keys array<{self.kind}>, begins binary, text binary, order binary, words array<string>"
        self.shards = stored(rows.mapInArrow(_builder(least, shard_words), ddl), "suffixes", large_rows=True)

    def matches(self, items: DataFrame, item_key: str = "item_id", item_text: str = "text", most_item_words: int = MOST_ITEM_WORDS) -> DataFrame:
        """(key, item_key, words, doc_word, item_word) of all verbatim matches."""
        spark, kind = items.sparkSession, items.schema[item_key].dataType.simpleString()
        ddl = f"doc {self.kind}, item {kind}, words int, doc_word int, item_word int"
        arrow = {"int": pa.int32(), "string": pa.string()}.get(kind, pa.int64())
        found = spark.createDataFrame([], ddl)
        for block in item_blocks(items, item_key, item_text, most_item_words):
            found = found.unionByName(self.shards.mapInArrow(_searcher(spark.sparkContext.broadcast(block), self.least, arrow), ddl))
        return found.distinct().withColumnsRenamed({"doc": self.key, "item": item_key})


def matches(
    documents: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    least: int = LEAST_WORDS,
    shard_words: int = SHARD_WORDS,
    most_item_words: int = MOST_ITEM_WORDS,
) -> DataFrame:
    """(key, item_key, words, doc_word, item_word): the longest verbatim match of each leaking pair, of equal ones the first."""
    found = SuffixShards(documents, key, text, least, shard_words).matches(items, item_key, item_text, most_item_words)
    order = F.struct("words", (-F.col("doc_word")).alias("d"), (-F.col("item_word")).alias("i"))
    longest = found.groupBy(key, item_key).agg(F.max(order).alias("m"))
    return longest.select(key, item_key, F.col("m.words").alias("words"), (-F.col("m.d")).alias("doc_word"), (-F.col("m.i")).alias("item_word"))


def without_leaks(documents: DataFrame, found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The documents that hold no test passage."""
    return documents.join(found.select(key).distinct(), key, "left_anti")
