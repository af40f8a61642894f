"""Repetition inside a single document (problem 10): a ledger of rule bits and measurements.

Every rule is evaluated once per document. The ledger keeps, per document, one measurement per
rule and one integer whose bit r says that rule r failed at its recorded limit. Policies are
versioned masks over those bits: applying one, or asking what a policy would keep without one of
its rules (ablation), is bitwise arithmetic on the ledger and never reads the texts again.

Defined results: null texts and texts without words get zero measurements and no failure bits, so
no policy removes them; a text of any length is measured whole; extra columns are dropped except
the key; repeated keys give one ledger row each; an empty table gives an empty ledger.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelake.llm.words import WordHashes, hash_words, sequence_hashes, split_words

SEQUENCE_WORDS = 8

#: rule -> (bit, measurement, limit); a rule fails where the measurement reaches the limit.
RULES = {
    "repeated_sequence_words": (0, "sequence_share", 0.30),
    "duplicate_lines": (1, "line_share", 0.30),
    "duplicate_paragraphs": (2, "paragraph_share", 0.30),
    "duplicate_line_chars": (3, "line_char_share", 0.20),
    "dominant_word": (4, "top_word_share", 0.30),
}

#: policy version -> rules whose failure removes a document.
POLICIES = {
    "v1": ("repeated_sequence_words",),
    "v2": ("repeated_sequence_words", "duplicate_lines", "duplicate_paragraphs"),
    "v3": tuple(RULES),
}

MEASUREMENTS = tuple(m for _, m, _ in RULES.values())


def _repeated(parts: list[str]) -> tuple[int, int]:
    """How many parts occurred before, and their characters."""
    seen: set[str] = set()
    count = chars = 0
    for part in parts:
        if part in seen:
            count += 1
            chars += len(part)
        else:
            seen.add(part)
    return count, chars


def sequence_shares(ids: np.ndarray, lengths: np.ndarray, n: int = SEQUENCE_WORDS) -> np.ndarray:
    """Share of words in a sequence of n words that began earlier, for documents laid end to end."""
    covered = np.zeros(len(lengths))
    if len(ids) >= n:
        owner = np.repeat(np.arange(len(lengths)), lengths)
        hashes = sequence_hashes(ids, n)
        inside = np.flatnonzero(owner[: len(hashes)] == owner[n - 1 :])
        if len(inside):
            keys = hashes[inside] ^ (owner[inside].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            order = np.argsort(keys, kind="stable")
            ordered = keys[order]
            again = np.zeros(len(order), dtype=bool)
            again[1:] = ordered[1:] == ordered[:-1]
            starts = inside[order[again]]
            steps = np.zeros(len(ids) + 1, dtype=np.int32)
            np.add.at(steps, starts, 1)
            np.add.at(steps, starts + n, -1)
            marked = np.cumsum(steps[:-1]) > 0
            covered = np.bincount(owner[marked], minlength=len(lengths)).astype(float)
    return np.divide(covered, lengths, out=np.zeros(len(lengths)), where=lengths > 0)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = WordHashes()
    for batch in batches:
        texts = batch.column(1).to_pylist()
        words = [split_words(t) if t else [] for t in texts]
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        ids = [hash_words(w, known) for w in words]
        shares = sequence_shares(np.concatenate(ids) if ids else np.zeros(0, np.uint64), lengths)
        lines, chars, paragraphs, top = (np.zeros(len(words)) for _ in range(4))
        for i, text in enumerate(texts):
            if not text:
                continue
            rows = [x for x in (line.strip() for line in text.split("\n")) if x]
            blocks = [x for x in (block.strip() for block in text.split("\n\n")) if x]
            if len(rows) > 1:
                count, size = _repeated(rows)
                lines[i], chars[i] = count / len(rows), size / sum(map(len, rows))
            if len(blocks) > 1:
                paragraphs[i] = _repeated(blocks)[0] / len(blocks)
            if lengths[i]:
                ordered = np.sort(ids[i])
                bounds = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1], [True])))
                top[i] = np.diff(bounds).max() / lengths[i]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(lengths), *map(pa.array, (shares, lines, paragraphs, chars, top))],
            names=["doc_id", "n_words", *MEASUREMENTS],
        )


def rule_bit(rule: str) -> int:
    return 1 << RULES[rule][0]


def policy_mask(version: str) -> int:
    return sum(rule_bit(rule) for rule in POLICIES[version])


def ledger(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, n_words, the measurements, failed_bits."""
    kind = documents.schema[key].dataType.simpleString()
    fields = ", ".join(f"{m} double" for m in MEASUREMENTS)
    measured = documents.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        _measure, f"doc_id {kind}, n_words bigint, {fields}"
    )
    bits: Column = F.lit(0)
    for bit, measurement, limit in RULES.values():
        bits = bits.bitwiseOR(F.when(F.col(measurement) >= limit, F.lit(1 << bit)).otherwise(F.lit(0)))
    return measured.select(F.col("doc_id").alias(key), "n_words", *MEASUREMENTS, bits.alias("failed_bits"))


def apply_policy(rows: DataFrame, version: str) -> DataFrame:
    """The ledger's rows that a policy removes."""
    return rows.where(F.col("failed_bits").bitwiseAND(F.lit(policy_mask(version))) != 0)


def ablations(rows: DataFrame) -> DataFrame:
    """Per policy and left-out rule: documents removed, and documents only that rule removes."""
    kinds = rows.groupBy("failed_bits").agg(F.count(F.lit(1)).alias("n"))  # at most 2^rules rows
    parts = []
    for version, rules in POLICIES.items():
        mask = policy_mask(version)
        for rule in rules:
            rest = mask & ~rule_bit(rule)
            hit = F.col("failed_bits").bitwiseAND(F.lit(mask)) != 0
            kept_without = F.col("failed_bits").bitwiseAND(F.lit(rest)) == 0
            parts.append((version, rule, F.when(hit, F.col("n")), F.when(hit & kept_without, F.col("n"))))
    table = F.array(
        *(
            F.struct(F.lit(v).alias("policy"), F.lit(r).alias("rule"), a.alias("removed"), b.alias("only_by_rule"))
            for v, r, a, b in parts
        )
    )
    return (
        kinds.select(F.inline(table))
        .groupBy("policy", "rule")
        .agg(
            F.coalesce(F.sum("removed"), F.lit(0)).alias("removed"),
            F.coalesce(F.sum("only_by_rule"), F.lit(0)).alias("only_by_rule"),
        )
    )
