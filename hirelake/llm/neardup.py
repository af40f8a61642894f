"""Near-duplicate records (problem 5): universal hash minima, banding, verification, components.

1. Every record becomes the set of its three-word sequences (in the form of problem 4, lower case),
   and that set `BANDS * ROWS` minima under universal hash functions, kept to 16 bits each.
2. Records with the same set form one class; its least key represents it. Copies are never compared.
3. Representatives that agree in all rows of a band are candidates. Bands are compared by 64-bit keys
   of their number and all bits of their rows, so unrelated records practically never meet by chance.
   A 128-bit sketch (one bit of each of 128 minima) drops candidates far below the threshold, the minima
   decide the rest, and estimates near the threshold are decided by the exact sets.
4. Links join into groups by alternating large-star and small-star.

Pages of one site share its furniture, a tenth or fifth of their sequences; `ROWS` is as large as it is
to keep those apart. At similarity s a pair becomes a candidate with probability 1 - (1 - s^5)^80: 0.9985
at 0.6, 0.92 at 0.5, 0.006 at 0.15. The bucket join is an equi-join on band keys, whose two sides are one
exchange and which adaptive execution splits where a bucket is hot; the usual reason of a hot bucket,
exact copies, is one representative.

Defined results: null fields count as empty; records with fewer than `least_words` words in the
description take no part; rows under one key are one record that has the words of each; a record is
never paired with itself; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelake.llm.charform import form
from hirelake.llm.components import components
from hirelake.llm.words import WordHashes, hash_words, sequence_hashes, split_words
from hirelake.runtime import cut, spread, stored

BANDS, ROWS = 80, 5
SEQUENCE = 3
LEAST_WORDS = 40
THRESHOLD = 0.5
#: Minima that estimate a similarity; estimates within DOUBT of the threshold are decided exactly.
ESTIMATE, DOUBT = 240, 0.12
#: Equal bits out of 128 that a candidate needs: four deviations below the mean at similarity 0.6.
SKETCH_BITS, SKETCH_LEAST = 128, 84

_RNG = np.random.Generator(np.random.PCG64(7))
_A = _RNG.integers(1, 2**31, size=BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _RNG.integers(0, 2**32, size=BANDS * ROWS, dtype=np.uint32)


def sequences(parts: list[str | None], known: WordHashes) -> np.ndarray:
    """The distinct three-word sequences of the joined parts, as sorted hashes."""
    words = split_words(form("\n".join(p or "" for p in parts)))
    return np.unique(sequence_hashes(hash_words(words, known), SEQUENCE))


def minima(hashes: np.ndarray) -> np.ndarray:
    """16 bits of the least value of every hash function over the set, in blocks of bounded size."""
    short = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    least = np.full(len(_A), np.iinfo(np.uint32).max, dtype=np.uint32)
    for at in range(0, len(short), 256):
        block = short[at : at + 256, None] * _A
        block += _B
        np.minimum(least, block.min(axis=0), out=least)
    least = (least ^ (least >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return ((least ^ (least >> np.uint32(12))) >> np.uint32(16)).astype(np.uint16)


def _signer(least_words: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            keys, classes, lows, highs, signatures = [], [], [], [], []
            for key, *parts in zip(*(c.to_pylist() for c in batch.columns)):
                if len((parts[-1] or "").split()) < least_words:
                    continue
                hashes = sequences(parts, known)
                if not len(hashes):
                    continue
                values = minima(hashes)
                bits = np.packbits((values[:SKETCH_BITS] & 1).astype(np.uint8)).view(np.int64)
                keys.append(key)
                classes.append(xxhash.xxh3_128_digest(hashes.tobytes()))
                lows.append(int(bits[0]))
                highs.append(int(bits[1]))
                # all lower bytes, then all upper ones: the first of them are the estimate's part
                signatures.append((values & np.uint16(255)).astype(np.uint8).tobytes() + (values >> np.uint16(8)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys, batch.schema.field(0).type),
                    pa.array(classes, pa.binary()),
                    pa.array(lows, pa.int64()),
                    pa.array(highs, pa.int64()),
                    pa.array(signatures, pa.binary()),
                ],
                names=["id", "class", "low", "high", "signature"],
            )

    return sign


def _agreement(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_rows
        left, right = (
            np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=np.uint8).reshape(n, ESTIMATE)
            for i in (2, 3)
        )
        share = (left == right).mean(axis=1) if n else np.zeros(0)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(share)], names=["a", "b", "estimate"])


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = WordHashes()
    for batch in batches:
        shares = []
        for left, right in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            x, y = sequences([left], known), sequences([right], known)
            both = len(np.intersect1d(x, y, assume_unique=True))
            shares.append(both / max(1, len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(shares, pa.float64())], names=["a", "b", "estimate"]
        )


class NearDuplicates:
    """signatures, membership (id, class representative), links (between representatives), pairs, groups."""

    def __init__(self, records: DataFrame, key: str, parts: list[str], least_words: int = LEAST_WORDS, threshold: float = THRESHOLD):
        self.key, self.threshold = key, threshold
        self.kind = records.schema[key].dataType.simpleString()
        rows = records.select(F.col(key).alias("id"), *(F.col(p).alias(f"p{i}") for i, p in enumerate(parts)))
        self.texts = rows.select(
            "id", F.concat_ws("\n", *(F.coalesce(f"p{i}", F.lit("")) for i in range(len(parts)))).alias("text")
        )
        self.signed = stored(
            spread(rows).mapInArrow(
                _signer(least_words), f"id {self.kind}, class binary, low bigint, high bigint, signature binary"
            ),
            "signatures",
        )
        classes = self.signed.select("id", "class").distinct()
        least = classes.groupBy("class").agg(F.min("id").alias("rep"))
        self.membership = stored(classes.join(least, "class").select("id", "rep").distinct(), "membership")
        # small sides are written out first, so that their size decides the join before the large side moves
        copies = stored(self.membership.where(F.col("id") != F.col("rep")).select("id"), "copies")
        self.reps = self.signed.join(copies, "id", "left_anti")
        self.links = cut(self._links())

    def candidates(self) -> DataFrame:
        """(a, b) of representatives with a band in common, a < b."""
        width = BANDS * ROWS
        part = lambda i, upper: F.substring("signature", upper * width + i * ROWS + 1, ROWS)
        bands = F.array(*(F.xxhash64(F.lit(i), part(i, 0), part(i, 1)) for i in range(BANDS)))
        rows = self.reps.select("id", F.explode(bands).alias("band"))
        return (
            rows.select("band", F.col("id").alias("a"))
            .join(rows.select("band", F.col("id").alias("b")), "band")
            .where(F.col("a") < F.col("b"))
            .select("a", "b")
            .distinct()
        )

    def _links(self) -> DataFrame:
        small = self.reps.select("id", "low", "high")
        sketch = lambda side: small.select(
            F.col("id").alias(side), F.col("low").alias(f"{side}_low"), F.col("high").alias(f"{side}_high")
        )
        short = self.reps.select("id", F.substring("signature", 1, ESTIMATE).alias("s"))
        signature = lambda side: short.select(F.col("id").alias(side), F.col("s").alias(f"{side}_s"))
        differ = F.bit_count(F.col("a_low").bitwiseXOR(F.col("b_low"))) + F.bit_count(
            F.col("a_high").bitwiseXOR(F.col("b_high"))
        )
        near = (
            self.candidates()
            .join(sketch("a"), "a")
            .join(sketch("b"), "b")
            .where(differ <= SKETCH_BITS - SKETCH_LEAST)
            .select("a", "b")
        )
        estimated = cut(
            near.join(signature("a"), "a")
            .join(signature("b"), "b")
            .select("a", "b", "a_s", "b_s")
            .mapInArrow(_agreement, f"a {self.kind}, b {self.kind}, estimate double")
            .where(F.col("estimate") >= self.threshold - DOUBT)
        )
        sure = estimated.where(F.col("estimate") > self.threshold + DOUBT)
        doubt = cut(estimated.where(F.col("estimate") <= self.threshold + DOUBT).select("a", "b"))
        wanted = stored(doubt.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "wanted")
        texts = stored(self.texts.join(wanted, "id", "left_semi"), "texts")
        text = lambda side: texts.select(F.col("id").alias(side), F.col("text").alias(f"{side}_t")).hint("shuffle_merge")
        doubtful = (
            doubt.join(text("a"), "a")
            .join(text("b"), "b")
            .select("a", "b", "a_t", "b_t")
            .mapInArrow(_exact, f"a {self.kind}, b {self.kind}, estimate double")
            .where(F.col("estimate") >= self.threshold)
        )
        return sure.unionByName(doubtful).groupBy("a", "b").agg(F.max("estimate").alias("similarity"))

    def pairs(self) -> DataFrame:
        """Every pair of records over the threshold, the smaller key first."""
        of_a = self.membership.select(F.col("rep").alias("a"), F.col("id").alias("x"))
        of_b = self.membership.select(F.col("rep").alias("b"), F.col("id").alias("y"))
        across = self.links.select("a", "b").join(of_a, "a").join(of_b, "b").select("x", "y")
        within = (
            self.membership.select("rep", F.col("id").alias("x"))
            .join(self.membership.select("rep", F.col("id").alias("y")), "rep")
            .where(F.col("x") < F.col("y"))
            .select("x", "y")
        )
        return across.unionByName(within).select(
            F.least("x", "y").alias(f"{self.key}_a"), F.greatest("x", "y").alias(f"{self.key}_b")
        )

    def groups(self) -> DataFrame:
        """(key, class, group, links): one row per record; copies share a class, links are between classes."""
        found = components(self.links, "a", "b")
        ends = self.links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
        return (
            self.membership.join(found.withColumnRenamed("node", "rep"), "rep", "left")
            .join(ends, "rep", "left")
            .select(
                F.col("id").alias(self.key),
                F.col("rep").alias("class_id"),
                F.coalesce("component", "rep").alias("group_id"),
                F.coalesce("links", F.lit(0)).alias("links"),
            )
        )
