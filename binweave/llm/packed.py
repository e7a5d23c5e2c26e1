"""Exchange of many small (id, value) pairs in a few packed rows.

Pairs are dealt to buckets and every task sends one row per bucket and chunk of text.  Spark
shuffles and groups the rows by bucket as usual; the number of buckets follows the amount of
data, so that a bucket stays within a fixed number of pairs.

``pack`` sends the values' low bytes and, for each run of pairs with one id, that id and the run's
length.  With many buckets a run is one pair, so for pairs of every word ``pack_chunk`` names the
row within its chunk in two bytes instead, and sends what is to be known of the chunk's rows once,
to the group that the answers of the chunk go to.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binweave.llm.words import mix

BUCKET_PAIRS = 1 << 20  # pairs a bucket is meant to hold
SENT_PAIRS = 1 << 20  # pairs a task holds before it sends them
WORD_BYTES = 6  # text bytes per word from which the number of pairs is estimated
PACKED = "bucket int, vals binary, flags binary, ids binary, tags binary, runs binary"
_TYPES = [pa.int32(), *[pa.binary()] * 5]
_NAMES = ["bucket", "vals", "flags", "ids", "tags", "runs"]


def bucket_count(docs: DataFrame, text: str = "text", pairs_per_word: float = 1.0) -> int:
    """Buckets for the pairs of all words of ``docs``; at least one per shuffle partition."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, int(total / WORD_BYTES * pairs_per_word / BUCKET_PAIRS) + 1)


def bucket_of(values: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of 64-bit hashes, from their upper half."""
    dealt = ((values >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    return dealt.astype(np.uint16 if buckets <= 1 << 16 else np.uint32)


def _binary(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    data = np.ascontiguousarray(data)
    offsets = (bounds * (data.nbytes // len(data) if len(data) else 1)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data.view(np.uint8))])


def pack(buckets: np.ndarray, n_buckets: int, ids: np.ndarray, values: np.ndarray, width: int = 8,
         flags: np.ndarray | None = None, tags: np.ndarray | None = None, sort_ids: bool = False) -> pa.RecordBatch:
    """One row per non-empty bucket.  Pairs of one id must be adjacent unless ``sort_ids``."""
    order = np.lexsort((ids, buckets)) if sort_ids else np.argsort(buckets, kind="stable")
    buckets, ids, values = buckets[order], ids[order], values[order]
    bounds = np.searchsorted(buckets, np.arange(n_buckets + 1))
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (buckets[1:] != buckets[:-1])
    run = np.flatnonzero(new)
    lengths = np.diff(np.append(run, len(ids))).astype(np.uint32)
    run_bounds = np.searchsorted(run, bounds)
    low = np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8)[:, :width]
    columns = [
        pa.array(np.arange(n_buckets, dtype=np.int32)),
        _binary(low, bounds),
        _binary((np.zeros(len(ids), np.uint8) if flags is None else flags[order].astype(np.uint8)), bounds if flags is not None else bounds * 0),
        _binary(ids[run].view(np.int64), run_bounds),
        _binary(np.zeros(0, np.uint32) if tags is None else tags[order][run].astype(np.uint32), run_bounds if tags is not None else bounds * 0),
        _binary(lengths, run_bounds),
    ]
    batch = pa.RecordBatch.from_arrays(columns, names=_NAMES)
    return batch.take(pa.array(np.flatnonzero(np.diff(bounds))))


def _joined(column: pa.ChunkedArray, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def chunk_ids(chunk: int, places: np.ndarray) -> np.ndarray:
    """Ids of rows by their chunk (below 2**47) and place in it."""
    return (np.int64(chunk) << np.int64(16)) | places.astype(np.int64)


def chunk_group(chunks: np.ndarray, groups: int) -> np.ndarray:
    return bucket_of(mix(chunks.astype(np.uint64) + np.uint64(1)), groups)


def pack_chunk(chunk: int, buckets: np.ndarray, n_buckets: int, places: np.ndarray, values: np.ndarray, width: int,
               flags: np.ndarray | None, about: np.ndarray, tags: np.ndarray | None = None) -> pa.RecordBatch:
    """Pairs of one chunk, ``places`` being rows of it, and a row ``about`` the chunk.

    The latter has bucket ``n_buckets`` + group: ``about`` (64 bits) and ``tags`` of each row.
    """
    order = np.argsort(buckets, kind="stable")
    bounds = np.searchsorted(buckets[order], np.arange(n_buckets + 1))
    low = np.ascontiguousarray(values[order]).view(np.uint8).reshape(-1, 8)[:, :width]
    none = _binary(np.zeros(0, np.uint8), bounds * 0)
    columns = [
        pa.array(np.arange(n_buckets, dtype=np.int32)),
        _binary(low, bounds),
        none if flags is None else _binary(flags[order].astype(np.uint8), bounds),
        pa.array([np.int64(chunk).tobytes()] * n_buckets, pa.binary()),
        none,
        _binary(places[order].astype(np.uint16), bounds),
    ]
    batch = pa.RecordBatch.from_arrays(columns, names=_NAMES).take(pa.array(np.flatnonzero(np.diff(bounds))))
    group = n_buckets + int(chunk_group(np.array([chunk]), n_buckets)[0])
    row = [group, np.ascontiguousarray(about).tobytes(), b"", np.int64(chunk).tobytes(), b"" if tags is None else tags.astype(np.uint32).tobytes(), b""]
    last = pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _TYPES, strict=True)], names=_NAMES)
    return pa.Table.from_batches([batch, last]).combine_chunks().to_batches()[0]


def send_chunks(parts: Iterator[tuple], buckets: int, width: int) -> Iterator[pa.RecordBatch]:
    """Rows of ``pack_chunk`` for parts ``(values, rows, flags, about, tags)`` of a task's rows.

    ``rows`` counts from 0 within the part, whose number of rows is that of ``about`` (at most
    65,535).  Parts are sent together as long as the bounds of rows and pairs allow it.
    """
    chunk = TaskContext.get().partitionId() << 24
    held: list[tuple] = []
    n_rows = n_pairs = 0

    def packed() -> pa.RecordBatch:
        values, rows, flags, about, tags = (None if x[0] is None else np.concatenate(x) for x in zip(*held, strict=True))
        return pack_chunk(chunk, bucket_of(values, buckets), buckets, rows, values, width, flags, about, tags)

    for values, rows, flags, about, tags in parts:
        if held and (n_rows + len(about) > 65_536 or n_pairs + len(values) > SENT_PAIRS):
            yield packed()
            chunk, held, n_rows, n_pairs = chunk + 1, [], 0, 0
        held.append((values, (rows + n_rows).astype(np.uint16), flags, about, tags))
        n_rows, n_pairs = n_rows + len(about), n_pairs + len(values)
    if held:
        yield packed()


def unpack_chunks(table: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``values, flags, ids`` of all pairs of a bucket of chunks."""
    low = _joined(table["vals"], np.uint8).reshape(-1, width)
    values = np.zeros((len(low), 8), np.uint8)
    values[:, :width] = low
    chunks = _joined(table["ids"], np.int64)
    places = _joined(table["runs"], np.uint16)
    sizes = np.array([len(x) // 2 for x in table["runs"].to_pylist()], np.int64)
    return values.view(np.uint64).reshape(-1), _joined(table["flags"], np.uint8), (np.repeat(chunks, sizes) << np.int64(16)) | places.astype(np.int64)


def answer(rows: pa.Table, n_buckets: int, reduce) -> pa.Table:
    """Rows about chunks pass on to their group; other buckets are reduced."""
    bucket = rows["bucket"][0].as_py()
    if bucket < n_buckets:
        return reduce(rows)
    return rows.set_column(0, "bucket", pa.array([bucket - n_buckets] * rows.num_rows, pa.int32())).set_column(
        2, "flags", pa.array([b"about"] * rows.num_rows, pa.binary()))


def resolve(rows: pa.Table) -> tuple[pa.Table, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """The answers of a group, and of each of its chunks what is known of the rows."""
    flags = rows["flags"].to_pylist()
    is_about = np.array([f == b"about" for f in flags], bool)
    known = {}
    for row in rows.filter(pa.array(is_about)).to_pylist():
        known[int(np.frombuffer(row["ids"], np.int64)[0])] = (np.frombuffer(row["vals"], np.int64), np.frombuffer(row["tags"], np.uint32))
    return rows.filter(pa.array(~is_about)), known


def look_up(ids: np.ndarray, known: dict[int, tuple[np.ndarray, np.ndarray]], which: int) -> np.ndarray:
    """What is known of rows named by ``chunk_ids``, from ``resolve``."""
    out = np.zeros(len(ids), np.int64)
    chunks, places = ids >> np.int64(16), ids & np.int64(0xFFFF)
    order = np.argsort(chunks, kind="stable")
    bounds = np.flatnonzero(np.diff(chunks[order], prepend=-1))
    for a, b in zip(bounds, np.append(bounds[1:], len(ids))[: len(bounds)], strict=True):
        some = order[a:b]
        out[some] = known[int(chunks[some[0]])][which][places[some]]
    return out


def unpack(table: pa.Table, width: int = 8):
    """``values, flags, ids, tags`` of all pairs of a bucket; flags and tags may be empty."""
    low = _joined(table["vals"], np.uint8).reshape(-1, width)
    values = np.zeros((len(low), 8), np.uint8)
    values[:, :width] = low
    runs = _joined(table["runs"], np.uint32)
    ids = np.repeat(_joined(table["ids"], np.int64), runs)
    tags = _joined(table["tags"], np.uint32)
    tags = np.repeat(tags, runs) if len(tags) else tags
    return values.view(np.uint64).reshape(-1), _joined(table["flags"], np.uint8), ids, tags


def empty_batch() -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([], t) for t in _TYPES], names=_NAMES)
