"""Benchmark decontamination by spaced seeds.

A seed is the hash of the tokens that a fixed mask selects from a few adjacent ones; tokens it
skips may differ.  Seeds of all benchmark items and of all documents are joined, and around each
hit the two texts are compared token by token along the hit's diagonal: a document overlaps an
item where, in some stretch of ``STRETCH`` tokens (the whole item if it is shorter), at least
``SHARE`` of the tokens agree; of an item below ``TOLERANT`` tokens all must.  The masks hit every
stretch that agrees enough, whichever its differing tokens are.  Tokens are runs of letters and
digits, A-Z in lower case.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binweave.llm.bits import BITMAP_BITS, bitmap_of, contains
from binweave.llm.registry import query, table
from binweave.llm.words import Words, mix, row_chunks, split
from binweave.scratch import cut

STRETCH = 13
SHARE = 0.7
TOLERANT = 6  # tokens of an item from which some may differ
# Masks by the tokens of a stretch; 1: the token counts, 0: it may differ.
FAMILIES = {width: ("1" * width,) for width in range(1, TOLERANT)} | {
    6: ("11111", "111101", "110111", "111011", "101111"),
    7: ("11101", "100111", "1010011", "1101001"),
    8: ("111101", "110111", "1010111", "11101001", "10011011", "11000111", "11100011"),
    9: ("111011", "1001111", "1110101", "110100011"),
    10: ("111011", "1001111", "1110101", "11010011", "10100111", "111000101", "1100000111", "1101000011"),
    11: ("111011", "1011011", "11010011", "110001011", "11011000001"),
    12: ("1110111", "11111001", "10011111", "111001011", "110100111", "11000101011", "10100101101", "111000000111"),
    13: ("111111", "11101011", "1100100111", "1011000111", "110001010011", "110011001001"),
}
MASKS = tuple(sorted({mask for family in FAMILIES.values() for mask in family}))
RADIUS = 64  # tokens compared on either side of a hit

_HITS = "key long, doc_id long, seg_start long, tokens binary, seeds array<long>, at array<long>"
_SEEDS = "seed long, item_id long, item_at long, mask int"
_FOUND = "doc_id long, item_id long, doc_start long, item_start long, n_tokens long, n_matched long"


def needed(size: int) -> int:
    """Tokens that must agree in a stretch of an item of ``size`` tokens."""
    return size if size < TOLERANT else int(np.ceil(SHARE * min(size, STRETCH)))


def seeds(words: Words, numbers: Iterable[int], own: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Seed hashes of all rows, the number of the first word each covers, and that of its mask.

    ``own``: of each row by the masks of its own family alone.
    """
    values, places, masks = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
    last = np.repeat(words.first[1:], words.counts)
    family = np.repeat(np.minimum(words.counts, STRETCH), words.counts)
    every = np.arange(len(words.hashes))
    for number in numbers:
        mask = MASKS[number]
        fits = every + len(mask) <= last
        if own:
            fits &= np.isin(family, [width for width, masks_ in FAMILIES.items() if mask in masks_])
        at = every[fits]
        total = np.full(len(at), number, np.uint64)
        for offset, sign in enumerate(mask):
            if sign == "1":
                total = total * np.uint64(0x9E3779B97F4A7C15) + words.hashes[at + offset]
        values.append(mix(total))
        places.append(at)
        masks.append(np.full(len(at), number, np.int32))
    return np.concatenate(values), np.concatenate(places), np.concatenate(masks)


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = split(batch.column("text"), lower=True, plain=True)
        values, at, mask = seeds(words, range(len(MASKS)), own=True)
        row = np.searchsorted(words.first, at, side="right") - 1
        items = batch.column("item_id").to_numpy(zero_copy_only=False).astype(np.int64)
        columns = [values.view(np.int64), items[row], (at - words.first[row]).astype(np.int64), mask]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["seed", "item_id", "item_at", "mask"])


def _item_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = split(batch.column("text"), lower=True, plain=True)
        tokens = [words.hashes[a:b].tobytes() for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(tokens, pa.binary())], names=["item_id", "item_tokens"])


def _slots(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = np.uint64(BITMAP_BITS - 1)
    return (values & low).astype(np.int64), ((values >> np.uint64(32)) & low).astype(np.int64)


def _doc_hits(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = TaskContext.get().partitionId() << 36
        known, numbers = shared.value
        whole = np.array(["0" not in mask and len(mask) < TOLERANT - 1 for mask in MASKS])  # of whole items alone
        for batch in batches:
            texts, ids = batch.column("text"), batch.column("doc_id").to_pylist()
            rows: list[tuple] = []
            for low, high in row_chunks(texts):
                words = split(texts.slice(low, high - low), lower=True, plain=True)
                values, at, mask = seeds(words, numbers)
                one, two = _slots(values)
                hit = np.flatnonzero(contains(known, one))
                hit = hit[contains(known, two[hit])]
                hit = hit[np.argsort(at[hit], kind="stable")]
                row = np.searchsorted(words.first, at[hit], side="right") - 1
                # A whole short item is the same wherever it is: its first place in the text will do.
                keep = np.ones(len(hit), bool)
                few = np.flatnonzero(whole[mask[hit]])
                order = few[np.lexsort((values[hit[few]], row[few]))]
                keep[order[1:]] = (row[order[1:]] != row[order[:-1]]) | (values[hit[order[1:]]] != values[hit[order[:-1]]])
                hit, row = hit[keep], row[keep]
                values, at = values[hit], at[hit]
                # Hits whose surroundings touch share one stretch of tokens.
                new = np.ones(len(at), bool)
                new[1:] = (row[1:] != row[:-1]) | (at[1:] - at[:-1] > 2 * RADIUS)
                heads = np.flatnonzero(new)
                for a, b in zip(heads, np.append(heads[1:], len(at))[: len(heads)], strict=True):
                    r = row[a]
                    begin = max(int(at[a]) - RADIUS, int(words.first[r]))
                    end = min(int(at[b - 1]) + RADIUS, int(words.first[r + 1]))
                    rows.append((key, ids[low + r], begin - int(words.first[r]), words.hashes[begin:end].tobytes(),
                                 values[a:b].view(np.int64).tolist(), (at[a:b] - begin).tolist()))
                    key += 1
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                                             names=["key", "doc_id", "seg_start", "tokens", "seeds", "at"])

    return run


def overlap(doc: np.ndarray, item: np.ndarray, diagonal: int) -> tuple[int, int, int, int] | None:
    """``(doc start, item start, tokens, matched)`` of the agreeing part on one diagonal.

    ``diagonal`` is the place in ``doc`` of the item's first token.  The part goes from the first
    to the last agreeing token of the stretches that agree enough.
    """
    low, high = max(0, -diagonal), min(len(item), len(doc) - diagonal)
    width = min(STRETCH, len(item))
    if high - low < width or not width:
        return None
    same = doc[diagonal + low : diagonal + high] == item[low:high]
    sums = np.concatenate([[0], np.cumsum(same)])
    good = np.flatnonzero(sums[width:] - sums[:-width] >= needed(len(item)))
    if not len(good):
        return None
    agreeing = np.flatnonzero(same[good[0] : good[-1] + width]) + good[0]
    first, last = int(agreeing[0]), int(agreeing[-1]) + 1
    return diagonal + low + first, low + first, last - first, int(sums[last] - sums[first])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            found = overlap(np.frombuffer(r["tokens"], np.uint64), np.frombuffer(r["item_tokens"], np.uint64), r["diagonal"])
            if found:
                rows.append((r["doc_id"], r["item_id"], r["seg_start"] + found[0], *found[1:]))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns],
                                         names=[n.split()[0] for n in _FOUND.split(", ")])


def overlaps(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The best overlap of each document and benchmark item that overlap.

    Columns ``doc_id, item_id, doc_start, item_start, n_tokens, n_matched``, counted in tokens.
    All seeds of all documents are looked up in a bitmap of fixed size made of the items' seeds,
    which only spares the join rows that cannot match; hits then join the items' seeds by value.
    NULL and empty texts and empty tables give no row; rows that repeat an id count as one
    document (or item) with all their texts.  NULL ids give no row.
    """
    docs = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint"), "text")
    items = items.filter(F.col("item_id").isNotNull()).select(F.col("item_id").cast("bigint"), "text")
    with_masks = cut(items.mapInArrow(_item_seeds, _SEEDS).distinct(), "seeds")
    numbers = sorted(r["mask"] for r in with_masks.select("mask").distinct().collect())  # at most those of MASKS
    item_seeds = with_masks.drop("mask")
    low = F.lit(BITMAP_BITS - 1)
    slots = F.array(F.col("seed").bitwiseAND(low), F.shiftrightunsigned("seed", 32).bitwiseAND(low))
    known = bitmap_of(item_seeds.select(F.explode(slots).alias("slot")))
    shared = docs.sparkSession.sparkContext.broadcast((known, numbers))  # fixed size
    hits = cut(docs.mapInArrow(_doc_hits(shared), _HITS), "hits")
    each = hits.select("key", F.explode(F.arrays_zip("seeds", "at")).alias("hit"))
    diagonals = (
        each.select("key", F.col("hit.seeds").alias("seed"), F.col("hit.at").alias("at"))
        .join(item_seeds, "seed")
        .select("key", "item_id", (F.col("at") - F.col("item_at")).alias("diagonal"))
        .distinct()
    )
    tokens = items.mapInArrow(_item_tokens, "item_id long, item_tokens binary")
    pairs = diagonals.join(hits.select("key", "doc_id", "seg_start", "tokens"), "key").join(tokens, "item_id")
    found = pairs.select("doc_id", "item_id", "seg_start", "tokens", "item_tokens", "diagonal").mapInArrow(_verify, _FOUND)
    best = F.max(F.struct("n_matched", (-F.col("n_tokens")).alias("_short"), (-F.col("doc_start")).alias("_early"),
                          (-F.col("item_start")).alias("_first"), "doc_start", "item_start", "n_tokens"))
    return found.groupBy("doc_id", "item_id").agg(best.alias("_best")).select(
        "doc_id", "item_id", *[F.col(f"_best.{c}").alias(c) for c in ("doc_start", "item_start", "n_tokens", "n_matched")]
    )


def _long_enough(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = split(batch.column("text"), lower=True, plain=True).counts
            yield batch.filter(pa.array(counts >= least))

    return run


def without_contaminated(docs: DataFrame, items: DataFrame, least_tokens: int = TOLERANT) -> DataFrame:
    """``docs`` without the documents that overlap an item; a NULL doc_id stays.

    Items of fewer than ``least_tokens`` tokens remove nothing: an item of one common word would
    take every document that holds the word.  ``overlaps`` reports them, and ``least_tokens=1``
    lets them remove documents too.
    """
    whole = items.select(F.col("item_id").cast("bigint"), "text").mapInArrow(_long_enough(least_tokens), "item_id long, text string")
    found = overlaps(docs, whole).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti")


@query("op3_decontaminate")
def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents and benchmark items that overlap."""
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
