"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader.

Features of a text are its words, its pairs of adjacent words, and the same of the words' shapes
(a shape keeps punctuation, and maps runs of upper-case letters, lower-case letters and digits to
one sign each), and the share of pairs that repeat a word, hashed to ``2**BITS`` places.  Each has the value 1 / sqrt(number of features in
the text), whatever its repetitions.  Scores are sparse dot products with the weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from binweave.llm.registry import query, table
from binweave.llm.words import mix, row_chunks, split, text_bytes, windows

BITS = 18
TRAIN_ROWS = 8_192  # labelled rows the model is fitted on, the least by a hash of doc_id
EPOCHS = 3
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.05, 1.0

def _shape_table() -> np.ndarray:
    signs = np.arange(256, dtype=np.uint8)
    signs[ord("A") : ord("Z") + 1] = ord("A")
    signs[ord("a") : ord("z") + 1] = ord("a")
    signs[ord("0") : ord("9") + 1] = ord("0")
    signs[128:] = ord("a")  # letters beyond ASCII count as lower case
    return signs


_SHAPE = _shape_table()


def _shapes(column: pa.Array) -> pa.Array:
    """The column with every letter and digit run reduced to one sign; words stay words."""
    data, offsets = text_bytes(column)
    signs = _SHAPE[data]
    keep = np.ones(len(signs), bool)
    keep[1:] = (signs[1:] != signs[:-1]) | ~np.isin(signs[1:], np.frombuffer(b"Aa0", np.uint8))
    keep[offsets[:-1][offsets[:-1] < len(signs)]] = True
    kept = np.concatenate([[0], np.cumsum(keep)])[offsets].astype(np.int32)
    return pa.StringArray.from_buffers(len(column), pa.py_buffer(kept), pa.py_buffer(np.ascontiguousarray(signs[keep])))


def features(column: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature places of each row, and the row offsets into them."""
    parts, rows = [], []
    for salt, words in enumerate((split(column), split(_shapes(column)))):
        pairs = windows(words, 2)
        for j, (hashes, at) in enumerate(((words.hashes, np.repeat(np.arange(len(column)), words.counts)), (pairs.hashes, pairs.rows))):
            parts.append(mix(hashes + np.uint64(2 * salt + j)) >> np.uint64(64 - bits))
            rows.append(at)
        if not salt:
            # Pairs of one word twice: their share of all pairs, in tenths, is a feature too.
            same = words.hashes[pairs.at] == words.hashes[pairs.at + 1]
            share = np.bincount(pairs.rows, weights=same, minlength=len(column)) / np.maximum(np.diff(pairs.first), 1)
            parts.append(mix(np.floor(share * 10).astype(np.uint64) + np.uint64(1 << 32)) >> np.uint64(64 - bits))
            rows.append(np.arange(len(column)))
    places, row = np.concatenate(parts), np.concatenate(rows)
    # One sort of the combined number orders by row, then place.
    both = np.unique((row.astype(np.uint64) << np.uint64(bits)) | places)
    return (both & np.uint64((1 << bits) - 1)).astype(np.int64), np.searchsorted(both >> np.uint64(bits), np.arange(len(column) + 1))


def places_of(column: pa.Array, bits: int = BITS) -> Iterator[np.ndarray]:
    """The distinct feature places of each row, at most ``2**bits`` of them whatever the text's length."""
    for low, high in row_chunks(column):
        places, first = features(column.slice(low, high - low), bits)
        yield from (places[a:b].astype("<i4") for a, b in zip(first[:-1], first[1:], strict=True))


def fit(texts: Iterator[pa.Array], labels: Iterator[np.ndarray], bits: int = BITS, epochs: int = EPOCHS) -> np.ndarray:
    """Weights after FTRL-proximal passes over texts and their labels."""
    rows = [row for column, label in zip(texts, labels, strict=True) for row in zip(places_of(column, bits), label, strict=True)]
    return fit_places(rows, bits, epochs)


def fit_places(rows: list[tuple[np.ndarray, int]], bits: int = BITS, epochs: int = EPOCHS) -> np.ndarray:
    """Weights (the last one is the constant) after FTRL-proximal passes over ``(places, label)``."""
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
    for epoch in range(epochs):
        for i in np.random.default_rng(epoch).permutation(len(rows)):
            places, label = rows[i]
            at = np.append(places, 1 << bits)
            value = np.full(len(at), 1 / np.sqrt(max(len(places), 1)))
            value[-1] = 1.0
            w = _weights(z[at], n[at])
            p = 1 / (1 + np.exp(-np.clip(w @ value, -35, 35)))
            gradient = (p - label) * value
            squares = gradient * gradient
            z[at] += gradient - (np.sqrt(n[at] + squares) - np.sqrt(n[at])) / ALPHA * w
            n[at] += squares
    return _weights(z, n).astype(np.float32)


def _weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def score(column: pa.Array, weights: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Probability of label 1 for each row; an empty text gets the constant's."""
    out = np.zeros(len(column))
    for low, high in row_chunks(column):
        places, first = features(column.slice(low, high - low), bits)
        sums = np.concatenate([[0.0], np.cumsum(weights[places], dtype=np.float64)])
        count = np.maximum(np.diff(first), 1)
        out[low:high] = (sums[first[1:]] - sums[first[:-1]]) / np.sqrt(count) + weights[-1]
    return 1 / (1 + np.exp(-np.clip(out, -35, 35)))


def is_held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from; a NULL id is one of them."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def sample_of(labels: DataFrame, label: str, rows: int = TRAIN_ROWS) -> DataFrame:
    """At most ``rows`` labelled ids, one label each (the least, if they differ), free to learn from."""
    usable = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")))
    return usable.groupBy("doc_id").agg(F.min(label).alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS, bits: int = BITS) -> np.ndarray:
    """Weights fitted on at most ``rows`` labelled documents, in one task.

    That task is given the feature places of each document, at most 4 * 2**bits bytes a row, and
    no texts, so neither very long texts nor a large table make it grow beyond that bound; places
    are worked out where the documents are.  Without a labelled document all weights are 0 and
    every score is 0.5.  Of documents that repeat an id, the first by text is used.
    """
    sample = F.broadcast(sample_of(labels, label, rows))  # bounded by ``rows``
    chosen = docs.select("doc_id", "text").join(sample, "doc_id").groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.min("label").alias("label"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = pa.array([p.tobytes() for p in places_of(batch.column("text"), bits)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), places], names=["doc_id", "label", "places"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)), key=lambda r: r[0])
        weights = fit_places([(np.frombuffer(places, "<i4"), label) for _, label, places in rows], bits)
        yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary())], names=["weights"])

    slim = chosen.select(F.col("doc_id").cast("bigint"), F.col("label").cast("int"), "text")
    placed = slim.mapInArrow(find, "doc_id long, label int, places binary").repartition(1)
    found = placed.mapInArrow(learn, "weights binary").collect()  # one model of 4 * 2**bits bytes
    return np.frombuffer(found[0][0], np.float32) if found else np.zeros((1 << bits) + 1, np.float32)


def with_quality(docs: DataFrame, weights: np.ndarray, bits: int = BITS, score_name: str = "score", predicted_name: str = "predicted") -> DataFrame:
    """``docs`` with a score (0 to 1) and a prediction (1 where the score is 0.5 or more).

    Columns of ``docs`` that bear the two names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # fixed size
    kept = docs.select([c for c in docs.columns if c not in (score_name, predicted_name)])
    names = kept.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = score(batch.column("text"), shared.value, bits)
            arrays = [*batch.columns, pa.array(values), pa.array((values >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*names, score_name, predicted_name])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(run, f"{fields}, `{score_name}` double, `{predicted_name}` int")


@query("op7_quality")
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score, by a model fitted on labelled rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    weights = train(docs, table(spark, sf_dir, "labels"))
    return with_quality(docs.select("doc_id", "text"), weights).select(
        "doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", "predicted"
    )
