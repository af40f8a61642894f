"""Filling fixed-capacity containers with documents (problem 8): hierarchical multi-length packing.

1. Token counts of a public byte-pair vocabulary, one pass over the texts; only counts leave it.
   A document larger than the largest capacity is divided into pieces of that capacity; no other
   document is divided.
2. Documents are dealt to shards by hash. Their number follows from the counted tokens and items, so
   a shard has a bounded size whatever the data's.
3. In a shard every item is routed to the smallest tier that holds it. From the longest tier down,
   each container takes the largest waiting item of its tier, then fills its gap with the largest
   item that fits from the same or a shorter tier. From the shortest tier up, containers filled
   below `least_fill` are dissolved and their items repacked in the next longer tier, so that
   unused space remains only in the longest.
4. Containers of one kind are dealt in serpentine order of their content to step groups of
   `group_size`, which so carry about the same number of tokens.

Defined results: null and empty texts have 0 tokens and no container (nulls); capacities that are
null or below 1 are ignored, and without any capacity no document gets a container; repeated keys are
packed once per row; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import math
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelake.runtime import cut

VOCABULARY = os.environ.get("HIRELAKE_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Where a text is divided before byte pairs are merged; goes with that vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SHARD_TOKENS, SHARD_ITEMS = 4_000_000, 200_000
LEAST_FILL = 0.985
GROUP_SIZE = 8
MOST_KINDS = 1_000

_encoders: dict[str, object] = {}


def encoder(vocabulary: str):
    """The tokenizer of a rank file, kept per process."""
    if vocabulary not in _encoders:
        import tiktoken

        with open(vocabulary, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        _encoders[vocabulary] = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[vocabulary]


def _counter(vocabulary: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode_ordinary
        for batch in batches:
            sizes = [len(encode(t)) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["id", "tokens"])

    return count


class _Waiting:
    """Items by size, with the largest size not above a bound found by path compression."""

    def __init__(self, largest: int):
        self.items: list[list[int]] = [[] for _ in range(largest + 1)]
        self.below = list(range(largest + 1))  # a size, or a smaller one that may hold items; 0: none

    def add(self, size: int, item: int) -> None:
        self.items[size].append(item)

    def seal(self) -> None:
        for size in range(1, len(self.items)):
            if not self.items[size]:
                self.below[size] = size - 1

    def largest(self, bound: int) -> int:
        root = bound
        while root and self.below[root] != root:
            root = self.below[root]
        while bound and self.below[bound] != root and bound != root:
            self.below[bound], bound = root, self.below[bound]
        return root

    def take(self, size: int) -> int:
        item = self.items[size].pop()
        if not self.items[size]:
            self.below[size] = size - 1
        return item


def _fill(waiting: _Waiting, capacity: int, least: int, sizes: np.ndarray) -> list[list[int]]:
    """Containers that each start with an item above `least` and take what fits."""
    containers = []
    while (size := waiting.largest(capacity)) > least:
        content, gap = [], capacity
        while size:
            content.append(waiting.take(size))
            gap -= size
            size = waiting.largest(gap) if gap else 0
        containers.append(content)
    return containers


def pack(sizes: np.ndarray, capacities: list[int], least_fill: float = LEAST_FILL) -> list[tuple[int, list[int]]]:
    """(tier, items) of every container; capacities ascending, every size from 1 to the last of them."""
    waiting = _Waiting(capacities[-1])
    for item, size in enumerate(sizes):
        waiting.add(int(size), item)
    waiting.seal()
    tiers: list[list[list[int]]] = [[] for _ in capacities]
    for tier in reversed(range(len(capacities))):
        least = capacities[tier - 1] if tier else 0
        tiers[tier] = _fill(waiting, capacities[tier], least, sizes)
    packed: list[tuple[int, list[int]]] = []
    moved: list[int] = []
    for tier, capacity in enumerate(capacities):
        containers = tiers[tier]
        if moved:
            pool = _Waiting(capacity)
            for item in moved:
                pool.add(int(sizes[item]), item)
            pool.seal()
            containers = containers + _fill(pool, capacity, 0, sizes)
            moved = []
        for content in containers:
            if tier + 1 < len(capacities) and sizes[content].sum() < least_fill * capacity:
                moved.extend(content)
            else:
                packed.append((tier, content))
    return packed


def _packer(kinds: list[tuple[str, int]], least_fill: float, group_size: int):
    names, capacities = [k for k, _ in kinds], [c for _, c in kinds]

    def pack_shard(rows: pd.DataFrame) -> pd.DataFrame:
        sizes = rows["n_tokens"].to_numpy()
        shard = int(rows["shard"].iloc[0]) << 32
        packed = pack(sizes, capacities, least_fill)
        tier_of = np.zeros(len(rows), dtype=np.int64)
        container, group = np.zeros(len(rows), dtype=np.int64), np.zeros(len(rows), dtype=np.int64)
        first_group = 0
        for tier in range(len(kinds)):
            own = [c for t, c in packed if t == tier]
            own.sort(key=lambda content: -int(sizes[content].sum()))
            groups = max(1, math.ceil(len(own) / group_size))
            for n, content in enumerate(own):
                lap, place = divmod(n, groups)
                group[content] = first_group + (place if lap % 2 == 0 else groups - 1 - place)
            first_group += groups if own else 0
        for n, (tier, content) in enumerate(packed):
            tier_of[content], container[content] = tier, n
        return pd.DataFrame(
            {
                "id": rows["id"],
                "piece_no": rows["piece_no"],
                "token_start": rows["token_start"],
                "n_tokens": sizes,
                "container_kind": np.array(names, dtype=object)[tier_of],
                "container_id": container + shard,
                "step_group": group + shard,
            }
        )

    return pack_shard


def container_kinds(containers: DataFrame) -> list[tuple[str, int]]:
    """(kind, capacity), ascending; of equal capacities the first kind by name."""
    rows = (
        containers.where(F.col("capacity_tokens") >= 1)
        .groupBy("capacity_tokens")
        .agg(F.min("container_kind").alias("container_kind"))
        .orderBy("capacity_tokens")
        .limit(MOST_KINDS + 1)
        .collect()
    )
    if len(rows) > MOST_KINDS:
        raise ValueError(f"more than {MOST_KINDS} container sizes")
    return [(r["container_kind"], int(r["capacity_tokens"])) for r in rows]


def packing(
    documents: DataFrame,
    containers: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    vocabulary: str = VOCABULARY,
    shard_tokens: int = SHARD_TOKENS,
    least_fill: float = LEAST_FILL,
    group_size: int = GROUP_SIZE,
) -> DataFrame:
    """(key, piece_no, token_start, n_tokens, container_kind, container_id, step_group) of every piece."""
    kind = documents.schema[key].dataType.simpleString()
    kinds = container_kinds(containers)
    counted = cut(
        documents.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(
            _counter(vocabulary), f"id {kind}, tokens bigint"
        )
    )
    nothing = lambda rows: rows.select(
        "id",
        F.lit(0).alias("piece_no"),
        F.lit(0).cast("bigint").alias("token_start"),
        F.col("tokens").alias("n_tokens"),
        F.lit(None).cast("string").alias("container_kind"),
        F.lit(None).cast("bigint").alias("container_id"),
        F.lit(None).cast("bigint").alias("step_group"),
    )
    if not kinds:
        return nothing(counted).withColumnRenamed("id", key)
    largest = kinds[-1][1]
    last = F.floor((F.col("tokens") - 1) / F.lit(largest)).cast("int")
    pieces = (
        counted.where(F.col("tokens") > 0)
        .select("id", "tokens", F.explode(F.sequence(F.lit(0), last)).alias("piece_no"))
        .select("id", "piece_no", (F.col("piece_no").cast("bigint") * largest).alias("token_start"), "tokens")
        .select("id", "piece_no", "token_start", F.least(F.col("tokens") - F.col("token_start"), F.lit(largest)).alias("n_tokens"))
    )
    total = pieces.agg(F.sum("n_tokens"), F.count(F.lit(1))).first()
    shards = max(1, math.ceil((total[0] or 0) / shard_tokens), math.ceil(total[1] / SHARD_ITEMS))
    ddl = (
        f"id {kind}, piece_no int, token_start bigint, n_tokens bigint, container_kind string, "
        "container_id bigint, step_group bigint"
    )
    packed = (
        pieces.withColumn("shard", F.pmod(F.xxhash64("id", "piece_no", "n_tokens"), F.lit(shards)))
        .groupBy("shard")
        .applyInPandas(_packer(kinds, least_fill, group_size), ddl)
    )
    return packed.unionByName(nothing(counted.where(F.col("tokens") == 0))).withColumnRenamed("id", key)
