"""Token ids in a binary format: fixed-size id blocks as compressed bit planes, with a chunk index.

A file is a sequence of chunks, each holding the ids of whole documents in ascending order of
doc_id.  A chunk's ids are cut into blocks of ``BLOCK_IDS``.  A block is transposed into planes:
plane b holds bit b of every id, eight ids a byte, least significant bit first.  Only planes with
a set bit are stored, each compressed with zstandard; ``mask`` says which.  The index of a chunk
gives its place (shard, chunk, ids of the shard before it), its documents with their lengths, and its blocks with
their number of ids and the length of each plane.

Chunks are rows written by Spark's own writer, whose commit protocol makes a retried task safe;
row columns are the index, the binary column ``body`` holds the planes of all blocks end to end.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from binweave.llm.registry import query, table
from binweave.llm.tokens import encoder
from binweave.llm.words import row_chunks
from binweave.scratch import new_path

BLOCK_IDS = 1 << 16  # ids in a block; the last block of a chunk is shorter
CHUNK_IDS = 1 << 18  # a chunk is closed after the document that reaches so many ids
END_ID = 2
VOCABULARY = "byte_bpe_50k.json"
LEVEL = 3

_CHUNK = ("chunk int, inside long, doc_ids array<long>, doc_lengths array<long>, n_ids long, "
          "block_ids array<int>, masks array<int>, plane_sizes array<int>, body binary")
_TYPES = [pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary()]
_NAMES = [part.split()[0] for part in _CHUNK.split(", ")]
_DOC = "doc_id long, local_start long, n_tokens long, ids_crc32 long"


def encode_block(ids: np.ndarray) -> tuple[int, list[bytes]]:
    """Mask of the stored planes, and those planes compressed, from the lowest bit up."""
    present = int(np.bitwise_or.reduce(ids)) if len(ids) else 0
    write = zstandard.ZstdCompressor(level=LEVEL).compress
    planes = [write(np.packbits((ids >> np.uint32(b)) & np.uint32(1) == 1, bitorder="little").tobytes())
              for b in range(32) if present >> b & 1]
    return present, planes


def decode_block(n: int, mask: int, planes: list[bytes]) -> np.ndarray:
    ids = np.zeros(n, np.uint32)
    read = zstandard.ZstdDecompressor().decompress
    for b, plane in zip((b for b in range(32) if mask >> b & 1), planes, strict=True):
        bits = np.unpackbits(np.frombuffer(read(plane), np.uint8), count=n, bitorder="little")
        ids |= bits.astype(np.uint32) << np.uint32(b)
    return ids


def _chunk_row(chunk: int, inside: int, doc_ids: list, lengths: list[int], parts: list[np.ndarray]) -> pa.RecordBatch:
    ids = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
    sizes, masks, plane_sizes, body = [], [], [], []
    for low in range(0, len(ids), BLOCK_IDS):
        block = ids[low : low + BLOCK_IDS]
        mask, planes = encode_block(block)
        sizes.append(len(block))
        masks.append(mask - (1 << 32) if mask >> 31 else mask)  # stored as a signed 32-bit number
        plane_sizes += map(len, planes)
        body += planes
    row = [chunk, inside, doc_ids, lengths, len(ids), sizes, masks, plane_sizes, b"".join(body)]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _TYPES, strict=True)], names=_NAMES)


def _write(vocabulary: str, end_id: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(vocabulary, True)
        chunk, inside, doc_ids, lengths, parts, held = 0, 0, [], [], [], 0
        for batch in batches:
            texts, keys = batch.column("text"), batch.column("doc_id").to_pylist()
            for low, high in row_chunks(texts):
                ids, first = tool.encode(texts.slice(low, high - low))
                # The end id goes in after each document.
                ids = np.insert(ids, first[1:], np.uint32(end_id))
                first = first + np.arange(len(first))
                start = 0
                for row in range(high - low):
                    doc_ids.append(keys[low + row])
                    lengths.append(int(first[row + 1] - first[row]))
                    held += lengths[-1]
                    if held >= CHUNK_IDS:
                        parts.append(ids[first[start] : first[row + 1]])
                        yield _chunk_row(chunk, inside, doc_ids, lengths, parts)
                        chunk, inside, doc_ids, lengths, parts, held, start = chunk + 1, inside + held, [], [], [], 0, row + 1
                parts.append(ids[first[start] : first[-1]])
        if doc_ids:
            yield _chunk_row(chunk, inside, doc_ids, lengths, parts)

    return write


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids, at, plane = [], 0, 0
            for n, mask in zip(row["block_ids"], row["masks"], strict=True):
                mask &= 0xFFFFFFFF
                planes = []
                for size in row["plane_sizes"][plane : plane + mask.bit_count()]:
                    planes.append(row["body"][at : at + size])
                    at += size
                plane += mask.bit_count()
                ids.append(decode_block(n, mask, planes))
            data = np.concatenate(ids).astype("<u4").tobytes() if ids else b""
            lengths = np.array(row["doc_lengths"], np.int64)
            starts = np.cumsum(lengths) - lengths
            crcs = [zlib.crc32(data[4 * a : 4 * (a + n)]) for a, n in zip(starts.tolist(), lengths.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["doc_ids"], pa.int64()), pa.array(starts + row["start"]), pa.array(lengths), pa.array(crcs, pa.int64())],
                names=["doc_id", "local_start", "n_tokens", "ids_crc32"],
            )


def write_token_files(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> None:
    """Encode ``text`` and write the chunks below ``path``, one shard per range of doc_id.

    Texts are dealt by ranges of doc_id, encoded where they land, and written in order.  A NULL
    text has the end id alone, an empty table writes no chunk, a NULL doc_id comes first, and
    rows that share a doc_id are all kept, in the order of their texts.  Ranges of (doc_id, hash
    of the text) let rows of one id spread over shards.
    """
    spark = docs.sparkSession
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col("doc_id").asc_nulls_first(), F.col("_h").asc()]
    dealt = docs.select("doc_id", "text", F.xxhash64("text").alias("_h")).repartitionByRange(shards, *keys)
    ordered = dealt.sortWithinPartitions(*keys, "text").select("doc_id", "text")
    chunks = ordered.mapInArrow(_write(vocabulary, end_id), _CHUNK)
    chunks.withColumn("shard", F.spark_partition_id()).write.option("compression", "none").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Documents read back from the files: ``doc_id, start, n_tokens, ids_crc32``.

    ``start`` counts the ids of all documents before: those of earlier shards and of earlier
    chunks of the shard (both from the index, no body is opened) and of the chunk itself.
    """
    schema = _CHUNK + ", shard int"
    chunks = spark.read.schema(schema).parquet(path)
    index = chunks.groupBy("shard").agg(F.sum("n_ids").alias("ids"))  # one row per shard
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = index.select("shard", F.coalesce(F.sum("ids").over(earlier), F.lit(0)).alias("before"))
    placed = chunks.join(F.broadcast(shards), "shard").withColumn("start", F.col("inside") + F.col("before"))
    docs = placed.select("start", "doc_ids", "doc_lengths", "block_ids", "masks", "plane_sizes", "body").mapInArrow(_read, _DOC)
    return docs.withColumnRenamed("local_start", "start")


@query("op10_token_files")
def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents through the format: written, and read back from the files."""
    path = new_path(spark, "tokens")
    write_token_files(table(spark, sf_dir, "documents"), path)
    return read_token_files(spark, path)
