"""Missing or wrong language labels (problem 3): string kernels, Nyström landmarks, ridge regression.

Texts are compared by the blended spectrum presence kernel: the number of character n-grams
(n = 2, 3, 4; hashed to `WIDTH` features) that occur in both, over the root of the product of their
numbers. One-versus-rest kernel ridge regression is fitted on a bounded sample of labelled paragraphs
(`SAMPLE` records per language at most), with `LANDMARKS` of them per language as Nyström landmarks.
Labels contain errors, so the fit is repeated without the paragraphs on which it disagrees with the
label. As the kernel is an inner product, landmarks and weights fold into one feature-by-language
matrix; all texts are scored by products of presence matrices with it, batch by batch.

Every description and every paragraph gets a language and a confidence (softmax of the scores). The
language of a description is the one with most words over its paragraphs.

Defined results: null and blank descriptions have no language and no paragraphs; paragraphs without a letter
have none either and no vote; labels are read in
any spelling of the six names, codes or own names; other labels count as not known; without any usable
label every result is empty; repeated rows are kept; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hirelake.llm.charform import form
from hirelake.runtime import spread

LANGUAGES = ("dutch", "english", "french", "german", "polish", "spanish")
# Spellings of the languages' names, and their codes.
SPELLINGS = {
    "dutch": ("dutch", "nl", "nld", "dut", "nederlands", "niederländisch", "hollands", "néerlandais", "neerlandés", "holenderski"),
    "english": ("english", "en", "eng", "englisch", "engels", "anglais", "inglés", "ingles", "angielski"),
    "french": ("french", "fr", "fra", "fre", "français", "francais", "französisch", "frans", "francés", "francuski"),
    "german": ("german", "de", "deu", "ger", "deutsch", "duits", "allemand", "alemán", "aleman", "niemiecki"),
    "polish": ("polish", "pl", "pol", "polski", "polnisch", "pools", "polonais", "polaco"),
    "spanish": ("spanish", "es", "spa", "español", "espanol", "castellano", "spanisch", "spaans", "espagnol", "hiszpański"),
}

GRAMS = (2, 3, 4)
WIDTH = 8192
SAMPLE = 400
LANDMARKS = 40
RIDGE = 0.3
SHARPNESS = 8.0
DESCRIPTION_WORDS = 40
PARAGRAPH_WORDS = 15
_BATCH = 256

_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F], dtype=np.uint32)
_DROP = re.compile(r"[\W\d_]+")
_LETTER = re.compile(r"[^\W\d_]")


def label_of(label: Column) -> Column:
    """The language a label names, or null."""
    head = F.lower(F.trim(F.split(label, r"[-_]").getItem(0)))
    table = F.create_map(*(F.lit(x) for name, spelled in SPELLINGS.items() for s in spelled for x in (s, name)))
    return F.try_element_at(table, head)


def presence(texts: list[str]) -> np.ndarray:
    """Texts by features: 1 where the text holds an n-gram of that feature."""
    out = np.zeros((len(texts), WIDTH), dtype=np.uint8)
    cleaned = [" " + _DROP.sub(" ", t.lower()) + " \0\0\0" for t in texts]
    codes = np.frombuffer("".join(cleaned).encode("utf-32-le"), dtype=np.uint32)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in cleaned])
    for n in GRAMS:
        count = len(codes) - n + 1
        if count <= 0:
            continue
        mixed = codes[:count] * _MULTIPLIERS[0]
        for k in range(1, n):
            mixed = (mixed ^ (mixed >> np.uint32(15))) * _MULTIPLIERS[k] + codes[k : k + count]
        mixed ^= mixed >> np.uint32(13)
        mixed *= np.uint32(0x2C1B3C6D)
        whole = codes[n - 1 : n - 1 + count] != 0
        out[owner[:count][whole], (mixed[whole] >> np.uint32(19)).astype(np.intp)] = 1
    return out


def _kernel(texts: list[str], landmarks: np.ndarray) -> np.ndarray:
    parts = []
    for at in range(0, len(texts), _BATCH):
        found = presence(texts[at : at + _BATCH]).astype(np.float32)
        found /= np.sqrt(np.maximum(found.sum(axis=1, keepdims=True), 1))
        parts.append(found @ landmarks.T)
    return np.concatenate(parts)


def _ridge(kernel: np.ndarray, among: np.ndarray, targets: np.ndarray) -> np.ndarray:
    system = kernel.T @ kernel + RIDGE * among
    return np.linalg.solve(system + 1e-4 * np.eye(len(system)), kernel.T @ targets)


def fit(texts: list[str], labels: list[str]) -> np.ndarray:
    """The feature-by-language matrix of the languages among the labels; others score below all of them."""
    wanted = np.array([LANGUAGES.index(x) for x in labels])
    order = np.random.Generator(np.random.PCG64(3)).permutation(len(texts))
    chosen = np.concatenate([order[wanted[order] == k][:LANDMARKS] for k in range(len(LANGUAGES))])
    landmarks = presence([texts[i] for i in chosen]).astype(np.float32)
    landmarks /= np.sqrt(np.maximum(landmarks.sum(axis=1, keepdims=True), 1))
    kernel, among = _kernel(texts, landmarks), landmarks @ landmarks.T
    targets = np.where(wanted[:, None] == np.arange(len(LANGUAGES)), 1.0, -1.0)
    weights = _ridge(kernel, among, targets)
    agree = (kernel @ weights).argmax(axis=1) == wanted
    if agree.any():
        weights = _ridge(kernel[agree], among, targets[agree])
    matrix = (landmarks.T @ weights).astype(np.float32)
    matrix[:, ~np.isin(np.arange(len(LANGUAGES)), wanted)] = -np.inf
    return matrix


def score(texts: list[str], matrix: np.ndarray) -> np.ndarray:
    parts = [np.zeros((0, matrix.shape[1]), dtype=np.float32)]
    for at in range(0, len(texts), _BATCH):
        found = presence(texts[at : at + _BATCH]).astype(np.float32)
        norm = np.sqrt(np.maximum(found.sum(axis=1, keepdims=True), 1))
        known = np.isfinite(matrix[0])
        scores = np.full((len(found), matrix.shape[1]), -np.inf, dtype=np.float32)
        scores[:, known] = (found @ matrix[:, known]) / norm
        parts.append(scores)
    return np.concatenate(parts)


def paragraphs(text: str) -> list[str]:
    """Runs of non-empty lines."""
    runs, run = [], []
    for line in text.split("\n"):
        if line:
            run.append(line)
        elif run:
            runs.append("\n".join(run))
            run = []
    if run:
        runs.append("\n".join(run))
    return runs


_SENTENCE_END = re.compile(r"[.!?…][)\"'’”“»]*\s*$")


def in_sentences(paragraph: str) -> bool:
    """Every line ends as a sentence does and holds several words."""
    return all(_SENTENCE_END.search(line) and len(line.split()) > 4 for line in paragraph.split("\n"))


def _segmenter(matrix):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = matrix.value
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                rows, texts = [], []
                for n, text in enumerate(batch.column(1).to_pylist()):
                    if text and not text.isspace():
                        for number, part in enumerate(paragraphs(form(text)), 1):
                            if not _LETTER.search(part):
                                continue  # no n-grams, no language
                            rows.append((n, number, len(part.split()), in_sentences(part)))
                            texts.append(part)
                scores = score(texts, weights)
                odds = np.exp(SHARPNESS * (scores - scores.max(axis=1, keepdims=True))) if len(scores) else scores
                odds = odds / odds.sum(axis=1, keepdims=True) if len(scores) else odds
                owner = np.array([r[0] for r in rows], dtype=np.int64)
                words = np.array([r[2] for r in rows], dtype=np.int64)
                best = odds.argmax(axis=1) if len(odds) else owner
                votes = np.zeros((batch.num_rows, len(LANGUAGES)))
                np.add.at(votes, (owner, best), words)
                total = votes.sum(axis=1)
                main = votes.argmax(axis=1)
                ids = batch.column(0).to_pylist()
                named = np.array(LANGUAGES, dtype=object)
                own = np.flatnonzero(total > 0)
                trust = np.zeros(batch.num_rows)
                np.add.at(trust, owner, np.where(best == main[owner], words * odds.max(axis=1, initial=0), 0) if len(odds) else 0)
                out = {
                    "id": [ids[i] for i in own] + [ids[i] for i in owner],
                    "segment_no": [0] * len(own) + [r[1] for r in rows],
                    "words": [int(total[i]) for i in own] + [int(w) for w in words],
                    "text_words": [int(total[i]) for i in own] + [int(total[i]) for i in owner],
                    "sentences": [True] * len(own) + [r[3] for r in rows],
                    "language": [*named[main[own]], *named[best]],
                    "main": [*named[main[own]], *named[main[owner]]],
                    "confidence": [*(trust[own] / total[own]), *(odds.max(axis=1) if len(odds) else ())],
                }
                kinds = [batch.schema.field(0).type, pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.string(), pa.string(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds)], names=list(out))

    return run


def training_sample(
    texts: DataFrame, labels: DataFrame, key: str, text: str, label: str, sample: int = SAMPLE
) -> tuple[list[str], list[str]]:
    """At most `sample` labelled descriptions per language, in hash order, as paragraphs."""
    sizes = texts.select(key, F.length(text).alias("size")).where(F.col("size").between(200, 20_000))
    known = labels.select(key, label_of(F.col(label)).alias("language")).where(F.col("language").isNotNull())
    order = Window.partitionBy("language").orderBy(F.xxhash64(key), key)
    picked = known.join(sizes, key).withColumn("n", F.row_number().over(order)).where(F.col("n") <= sample)
    picked = picked.select(key, "language")  # at most `sample` rows per language
    rows = texts.select(key, F.col(text).alias("text")).join(F.broadcast(picked), key).collect()
    parts, named = [], []
    for row in sorted(rows, key=lambda r: (r["language"], str(r[key]))):
        for part in paragraphs(form(row["text"] or "")):
            if len(part.split()) >= PARAGRAPH_WORDS:
                parts.append(part)
                named.append(row["language"])
    return parts, named


def segments(texts: DataFrame, labels: DataFrame, key: str, text: str, label: str, sample: int = SAMPLE) -> DataFrame:
    """(key, segment_no, words, text_words, sentences, language, main, confidence); segment 0 is the description."""
    parts, named = training_sample(texts, labels, key, text, label, sample)
    kind = texts.schema[key].dataType.simpleString()
    if not parts:
        ddl = f"{key} {kind}, segment_no int, words int, text_words int, sentences boolean, language string, main string, confidence double"
        return texts.sparkSession.createDataFrame([], ddl)
    matrix = texts.sparkSession.sparkContext.broadcast(fit(parts, named))
    return (
        spread(texts.select(F.col(key).alias("id"), F.col(text).alias("text")))
        .mapInArrow(
            _segmenter(matrix),
            f"id {kind}, segment_no int, words int, text_words int, sentences boolean, language string, main string, "
            "confidence double",
        )
        .withColumnRenamed("id", key)
    )


def corrections(found: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """(key, segment_no, language, confidence) where a label is missing or wrong, or a paragraph differs."""
    foreign = (F.col("words") >= PARAGRAPH_WORDS) & F.col("sentences") & (F.col("language") != F.col("main"))
    named = labels.select(key, label_of(F.col(label)).alias("named"))
    return (
        found.where((F.col("text_words") >= DESCRIPTION_WORDS) & ((F.col("segment_no") == 0) | foreign))
        .join(named, key, "left")
        .where((F.col("segment_no") > 0) | ~F.col("named").eqNullSafe(F.col("language")))
        .select(key, "segment_no", "language", "confidence")
        .dropDuplicates([key, "segment_no"])
    )
