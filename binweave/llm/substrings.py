"""Exact substring deduplication with fixed-block anchors.

A repeat is a window of ``WINDOW`` words that also starts in a document with a smaller id.  Every
such window covers a whole block of the other document, if that is cut into blocks of ``BLOCK``
words (half a window) from its start.  So the blocks of all documents are the index, and every
rolling window of a block's length, in every document, probes it.  Around each hit the windows of
full length are compared, again by hash and across all documents, which extends the hit word by
word to the maximal repeats: runs of windows, each seen before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from binweave.llm.bits import maybe
from binweave.llm.packed import (
    PACKED,
    answer,
    bucket_count,
    bucket_of,
    chunk_group,
    look_up,
    pack,
    resolve,
    send_chunks,
    unpack,
    unpack_chunks,
)
from binweave.llm.registry import query, table
from binweave.llm.words import Words, mix, row_chunks, split, text_bytes, windows
from binweave.scratch import cut

WINDOW = 50
BLOCK = WINDOW // 2
GAPS = r"[\x20\x09-\x0D]+"

_LOW = np.uint64((1 << 48) - 1)
_PER_DOC = "doc_id long, keys binary"


def _long_rows(words: Words, least: int) -> Words:
    """The same words with rows of fewer than ``least`` words emptied."""
    keep = np.repeat(words.counts >= least, words.counts)
    counts = np.where(words.counts >= least, words.counts, 0)
    return Words(words.hashes[keep], np.concatenate([[0], np.cumsum(counts)]), words.starts[keep], words.ends[keep], words.data)


def _probes(buckets: int, window: int, block: int):
    """All rolling windows of a block's length; those at a block's place are flagged as index."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            texts, ids = batch.column("text"), batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            for low, high in row_chunks(texts):
                words = _long_rows(split(texts.slice(low, high - low)), window)
                rolling = windows(words, block)
                rows = rolling.rows
                indexed = (rolling.at - words.first[rows]) % block == 0
                yield rolling.hashes, rows, indexed.astype(np.uint8), ids[low:high], None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return send_chunks(parts(batches), buckets, 6)

    return run


def _groups(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by value, group starts, and the number of each sorted pair's group."""
    order = np.argsort(values)
    sorted_ = values[order]
    new = np.ones(len(order), bool)
    new[1:] = sorted_[1:] != sorted_[:-1]
    return order, np.flatnonzero(new), np.cumsum(new) - 1


def _reply(ids: np.ndarray, values: np.ndarray, groups: int, width: int, by_chunk: bool = False) -> pa.Table:
    dealt = chunk_group(ids >> np.int64(16), groups) if by_chunk else bucket_of(mix(ids.view(np.uint64) + np.uint64(1)), groups)
    return pa.Table.from_batches([pack(dealt, groups, ids, values, width, sort_ids=True)])


def _hits(groups: int):
    """Probes that meet an indexed block, where more than one document holds the value."""

    def reduce(rows: pa.Table) -> pa.Table:
        values, flags, ids = unpack_chunks(rows, 6)
        order, starts, group = _groups(values)
        ids = ids[order]
        several = np.minimum.reduceat(ids, starts) != np.maximum.reduceat(ids, starts)
        hit = np.flatnonzero((several & (np.maximum.reduceat(flags[order], starts) > 0))[group])
        return _reply(ids[hit], values[order[hit]], groups, 6, by_chunk=True)

    return lambda rows: answer(rows, groups, reduce)


def _repeats(groups: int):
    """Windows that a document with a smaller id holds too."""

    def run(rows: pa.Table) -> pa.Table:
        values, _, ids, _ = unpack(rows, 8)
        order, starts, group = _groups(values)
        ids = ids[order]
        hit = np.flatnonzero(ids > np.minimum.reduceat(ids, starts)[group])
        return _reply(ids[hit], values[order[hit]], groups, 8)

    return run


def _per_doc(width: int, by_chunk: bool = False):
    """Values of each document; ids of rows in chunks are turned into those of documents."""

    def run(rows: pa.Table) -> pa.Table:
        known = {}
        if by_chunk:
            rows, known = resolve(rows)
        values, _, ids, _ = unpack(rows, width)
        if by_chunk:
            ids = look_up(ids, known, 0)
        order = np.lexsort((values, ids))
        values, ids = values[order], ids[order]
        new = np.ones(len(ids), bool)
        new[1:] = (ids[1:] != ids[:-1]) | (values[1:] != values[:-1])
        values, ids = values[new], ids[new]
        docs, first = np.unique(ids, return_index=True)
        bounds = np.append(first, len(ids))
        keys = [values[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        return pa.table({"doc_id": pa.array(docs, pa.int64()), "keys": pa.array(keys, pa.binary())})

    return run


def _found(values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(values), bool)
    return keys[np.minimum(np.searchsorted(keys, values), len(keys) - 1)] == values


def _candidates(buckets: int, window: int, block: int):
    """Windows of full length around the hits of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids, keys = batch.column("text"), batch.column("doc_id").to_numpy(), batch.column("keys").to_pylist()
            for low, high in row_chunks(texts):
                words = split(texts.slice(low, high - low))
                rolling, full = windows(words, block), windows(words, window)
                chosen = []
                for row in range(high - low):
                    a, b = rolling.first[row], rolling.first[row + 1]
                    hits = _found(rolling.hashes[a:b] & _LOW, np.frombuffer(keys[low + row], np.uint64))
                    sums = np.concatenate([[0], np.cumsum(hits)])
                    number = full.first[row + 1] - full.first[row]
                    start = np.arange(number)
                    near = sums[start + window - block + 1] > sums[start]
                    chosen.append(full.first[row] + np.flatnonzero(near))
                chosen = np.concatenate(chosen)
                values = full.hashes[chosen]
                yield pack(bucket_of(values, buckets), buckets, ids[low:high][full.rows[chosen]], values, 8)

    return run


def holes_of(words: Words, row: int, covered: np.ndarray) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Byte spans to cut out of a row for its covered words, and their runs (first word, words).

    The white space before a run stays and that after it goes, so kept words stay apart.
    """
    a, b = words.first[row], words.first[row + 1]
    edges = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]])))
    runs = [(int(x), int(y)) for x, y in zip(edges[::2], edges[1::2], strict=True)]
    return [(int(words.starts[a + x]), int(words.starts[a + y] if a + y < b else words.ends[b - 1])) for x, y in runs], [(x, y - x) for x, y in runs]


def _remove(window: int, fields: list[str], removed: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keys = batch.column("text"), batch.column("__keys").to_pylist()
            kept, spans = [], []
            for low, high in row_chunks(texts):
                words = split(texts.slice(low, high - low))
                full = windows(words, window)
                data = words.data.tobytes()
                size = text_bytes(texts.slice(low, high - low))[1]
                for row in range(high - low):
                    text_low, text_high = int(size[row]), int(size[row + 1])
                    known = _found(full.hashes[full.first[row] : full.first[row + 1]], np.frombuffer(keys[low + row] or b"", np.uint64))
                    step = np.zeros(int(words.counts[row]) + 1, np.int64)
                    at = np.flatnonzero(known)
                    np.add.at(step, at, 1)
                    np.add.at(step, at + window, -1)
                    holes, runs = holes_of(words, row, np.cumsum(step)[:-1] > 0)
                    parts, place = [], text_low
                    for x, y in holes:
                        parts.append(data[place:x])
                        place = y
                    parts.append(data[place:text_high])
                    kept.append(b"".join(parts).decode(errors="replace"))
                    spans.append([{"start": x, "words": n} for x, n in runs])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64())]))
            arrays = [pa.array(kept, pa.string()) if f == "text" else batch.column(f) for f in fields] + [pa.array(spans, kind)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*fields, removed])

    return run


def repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id`` and ``keys``: the distinct hashes of a document's repeated windows, packed.

    Only documents with such a window have a row.  Rows that share an id are one document with
    the windows of all; a NULL id or text takes no part.  ``docs`` is read in the order it is stored
    in, so it should be a table and not the result of a shuffle.  Hashes are 64 bits wide here, 48 in the
    search for hits, which later steps only narrow.
    """
    block = window // 2
    usable = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint"), "text")
    buckets = bucket_count(usable)
    probes = usable.mapInArrow(_probes(buckets, window, block), PACKED)
    hits = probes.groupBy("bucket").applyInArrow(_hits(buckets), PACKED)
    per_doc = cut(hits.groupBy("bucket").applyInArrow(_per_doc(6, by_chunk=True), _PER_DOC), "hits")
    near = maybe(usable, per_doc).filter("__maybe").drop("__maybe").join(per_doc, "doc_id")
    full = near.select("doc_id", "text", "keys").mapInArrow(_candidates(buckets, window, block), PACKED)
    found = full.groupBy("bucket").applyInArrow(_repeats(buckets), PACKED)
    return cut(found.groupBy("bucket").applyInArrow(_per_doc(8), _PER_DOC), "repeats")


def without_repeats(docs: DataFrame, window: int = WINDOW, removed: str = "removed") -> DataFrame:
    """``docs`` with repeated words cut out of ``text``, and ``removed``: the runs cut out.

    ``removed`` holds (first word, number of words) in the numbering of the input's words, which
    are unchanged otherwise, as is the white space around them; it is empty where nothing was
    cut.  A column of ``docs`` that bears its name is replaced, all others pass through, whatever
    their names.  A NULL text stays NULL, and a document with a NULL id stays as it is.
    """
    # Other columns go by number in between, so that none can clash with those made here.
    names = {c: c if c in ("doc_id", "text") else f"c{k}" for k, c in enumerate(docs.columns) if c != removed}
    docs = docs.select(*[F.col("`" + c.replace("`", "``") + "`").alias(n) for c, n in names.items()])
    clean = _without_repeats(docs, window)
    return clean.select(*[F.col(n).alias(c) for c, n in names.items()], F.col("__removed").alias(removed))


def _without_repeats(docs: DataFrame, window: int) -> DataFrame:
    fields, removed = docs.columns, "__removed"
    found = repeats(docs, window).withColumnRenamed("keys", "__keys")
    marked = maybe(docs.select(*fields), found)
    kind = "array<struct<start: bigint, words: bigint>>"
    none = F.array().cast(kind).alias(removed)
    clean = marked.filter("NOT __maybe").select(*fields, none)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*fields).schema) + f", `{removed}` {kind}"
    touched = marked.filter("__maybe").drop("__maybe").join(found, "doc_id", "left")
    same = touched.filter("__keys IS NULL").select(*fields, none)
    changed = touched.filter("__keys IS NOT NULL").select(*fields, "__keys").mapInArrow(_remove(window, fields, removed), schema)
    return clean.unionByName(same).unionByName(changed)


def spaced(text: Column) -> Column:
    """The words joined by one space; NULL gives an empty string."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), GAPS, " "))


OP4_SQL = rf"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), s AS (
  SELECT doc_id, unnest(range(1, len(w) - {WINDOW} + 2)) AS i, w FROM d WHERE len(w) >= {WINDOW}
), h AS (
  SELECT doc_id, i, md5(array_to_string(w[i : i + {WINDOW - 1}], ' ')) AS h FROM s
), f AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS least FROM h) WHERE doc_id > least
), c AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW})) AS i FROM f
), r AS (
  SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id
), k AS (
  SELECT d.doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed,
         CASE WHEN gone IS NULL THEN array_to_string(w, ' ')
              ELSE array_to_string(list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda p: NOT list_contains(gone, p[2])), lambda p: p[1]), ' ') END AS kept
  FROM d LEFT JOIN r USING (doc_id)
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM k
"""


@query("op4_substring_dedup", OP4_SQL)
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words, those removed, and a digest of those kept."""
    kept = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    words = spaced(F.col("text"))
    n_kept = F.when(words == "", 0).otherwise(F.octet_length(words) - F.octet_length(F.replace(words, F.lit(" "), F.lit(""))) + 1)
    n_removed = F.aggregate("removed", F.lit(0).cast("bigint"), lambda total, run: total + run["words"])
    return kept.select(
        "doc_id", (n_kept + n_removed).cast("bigint").alias("n_words"), n_removed.alias("n_removed"),
        F.sha2(words.cast("binary"), 256).alias("kept_sha256"),
    )
