"""Harmonic packing of token sequences: pieces by reciprocal-capacity class, each class's bins
filled with a fixed number of pieces.

Class j holds pieces of length up to floor(C / j) and more than floor(C / (j + 1)); j of them
fill a bin of capacity C.  A document longer than C gives full pieces first.  Of the rest, up to
``CUTS`` pieces are cut at exactly floor(C / j), the longest that fits, which wastes less than j
ids of j * floor(C / j); what remains is a piece of its own class.

Every task fills its own bins, class by class, and keeps only the pieces of its unfinished bins
apart; those are filled class by class across tasks.  A piece's number among the leftovers of its
class is its place in its task plus the leftovers of earlier tasks, so leftovers are never ordered:
only their counts per task are.  What then remains is less than one bin per class, so at most C bins
whatever the input, and is packed by first fit decreasing.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from binweave.llm.registry import query, table
from binweave.llm.tokens import encoder
from binweave.llm.words import row_chunks
from binweave.scratch import cut

CAPACITY = 2048
CUTS = 2
END_ID = 1
VOCABULARY = "word_bpe_49k.json"

_PIECE = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "cls", "bin"]
_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, cls long, bin long"
# Of a piece in an unfinished bin: its task, and its place among that task's leftovers of the class.
_LEFT = ["task", "place"]
_WRITTEN = f"{_SCHEMA}, task long, place long"


def cut_points(tokens: int, capacity: int = CAPACITY, cuts: int = CUTS) -> list[tuple[int, int, int]]:
    """``(start, length, class)`` of a document's pieces."""
    pieces = [(at, capacity, 1) for at in range(0, tokens - capacity + 1, capacity)]
    at = len(pieces) * capacity
    left = tokens - at
    for _ in range(cuts):
        if left:
            j = -(-capacity // left)  # least j with capacity / j <= left
            size = capacity // j
            pieces.append((at, size, j))
            at, left = at + size, left - size
    if left:
        pieces.append((at, left, capacity // left))
    return pieces


def _pieces(vocabulary: str, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(vocabulary, False)
        task = TaskContext.get().partitionId()
        base = task << 36
        open_bins: dict[int, list[tuple]] = {}
        done = 0

        def table_of(rows: list[tuple]) -> pa.RecordBatch:
            names = _PIECE + _LEFT
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

        for batch in batches:
            texts, keys = batch.column("text"), batch.column("doc_id").to_pylist()
            for low, high in row_chunks(texts):
                ids, first = tool.encode(texts.slice(low, high - low))
                ids = np.insert(ids, first[1:], np.uint32(end_id)).astype("<u4")
                first = (first + np.arange(len(first))).tolist()
                raw, out = ids.tobytes(), []
                for row in range(high - low):
                    begin, tokens = first[row], first[row + 1] - first[row]
                    for start, length, cls in cut_points(tokens, capacity):
                        at = 4 * (begin + start)
                        piece = (keys[low + row], start, length, zlib.crc32(raw[at : at + 4 * length]), tokens, cls)
                        held = open_bins.setdefault(cls, [])
                        held.append(piece)
                        if len(held) == cls:
                            out += [(*p, base + done, None, None) for p in held]
                            done += 1
                            held.clear()
                yield table_of(out)
        yield table_of([(*p, None, task, place) for held in open_bins.values() for place, p in enumerate(held)])

    return run


def first_fit(lengths: list[int], capacity: int) -> list[int]:
    """Bin of each piece when pieces go, longest first, into the fullest bin that has room."""
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, used = [0] * len(lengths), 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        room = next((r for r in range(lengths[i], capacity + 1) if free[r]), None)
        if room is None:
            bins[i], room, used = used, capacity, used + 1
        else:
            bins[i] = free[room].pop()
        free[room - lengths[i]].append(bins[i])
    return bins


def _last_bins(capacity: int):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending")])
        bins = first_fit(rows["length"].to_pylist(), capacity)
        return rows.select(_PIECE[:-1]).append_column("bin", pa.array(bins, pa.int64()))

    return run


def _numbered(left: DataFrame) -> DataFrame:
    """Leftovers with ``_rank``, from 0 without gaps within their class, and ``_n``, how many their class has.

    What is ordered within a class is one row per task, with a count; a task leaves less than
    ``cls`` pieces, so the join back has no hot key.
    """
    held = left.groupBy("cls", "task").agg(F.count("*").alias("_held"))
    by_class = Window.partitionBy("cls")
    earlier = by_class.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    shifts = held.select(
        "cls", "task", F.coalesce(F.sum("_held").over(earlier), F.lit(0)).alias("_shift"), F.sum("_held").over(by_class).alias("_n")
    )
    return left.join(shifts, ["cls", "task"]).withColumn("_rank", F.col("_shift") + F.col("place"))


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents with their place: ``sequence_id`` and ``offset`` in it.

    Ids are whole numbers; columns other than ``doc_id`` and ``text`` are not looked at.
    A NULL or empty text is its end id alone; an empty table gives no piece; rows that share a
    doc_id are packed each for itself; a NULL doc_id stays NULL.  Sequence ids are unique, not
    dense.  The pieces are written once, so that a retried task cannot fill bins another way.
    """
    slim = docs.select("doc_id", "text")
    written = cut(slim.mapInArrow(_pieces(vocabulary, end_id, capacity), _WRITTEN), "pieces")
    full = written.filter("bin IS NOT NULL").select(*_PIECE)
    # Second round: a class's unfinished bins of all tasks, less than cls pieces from each task.
    ranked = _numbered(written.filter("bin IS NULL").drop("bin"))
    ranked = cut(ranked.withColumn("bin", F.floor(F.col("_rank") / F.col("cls")).cast("bigint")), "ranked")
    filled = (F.col("bin") + 1) * F.col("cls") <= F.col("_n")
    # Bin numbers of the rounds are kept apart by high bits: tasks, then classes, then the rest.
    second = ranked.filter(filled).withColumn("bin", (F.lit(1 << 61) + F.col("cls") * (1 << 44) + F.col("bin")).cast("bigint"))
    left = ranked.filter(~filled).select(*_PIECE[:-1], F.lit(0).alias("_all"))
    last = left.groupBy("_all").applyInArrow(_last_bins(capacity), _SCHEMA)
    last = last.withColumn("bin", (F.lit(1 << 62) + F.col("bin")).cast("bigint"))
    every = full.unionByName(second.select(*_PIECE)).unionByName(last)
    before = Window.partitionBy("bin").orderBy(F.desc("length"), "doc_id", "start", "ids_crc32").rowsBetween(Window.unboundedPreceding, -1)
    return every.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", F.col("bin").alias("sequence_id"),
        F.coalesce(F.sum("length").over(before), F.lit(0)).cast("bigint").alias("offset"),
    )


@query("op6_packing")
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2,048 tokens."""
    return pack(table(spark, sf_dir, "documents"))
