"""Masks of pixels: bitmaps of square blocks of bins, and dense cells made from them.

A mask is as large as its box, so it is never held whole.  A block of ``MASK_BLOCK`` x ``MASK_BLOCK`` bins
is a bitmap, and a block without a pixel is no row at all.  Dense cells are made block by block,
at most ``MASK_BLOCK`` at a time, however large the box.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from binweave.operators.relational import join_null_safe

MASK_BLOCK = 1024  # bins along a side of a block


def mask_blocks(pixels: DataFrame, keys: Sequence[str], size: int = MASK_BLOCK) -> DataFrame:
    """``block1, block2, ones, words`` of each block of a group that holds a pixel.

    ``words`` lists, in order, the 64-bit words of the block's bitmap that are not 0: word ``w`` has
    the bits of the cells 64 w to 64 w + 63, counted along region2 and then region1 from the
    block's least corner.  Pixels are merged into words before the shuffle, so repeats are
    harmless and a hot group is spread over its words.  Missing keys are a group, pixels without
    both bins are passed over.
    """
    one, two = F.floor(F.col("region1") / size), F.floor(F.col("region2") / size)
    place = (F.col("region1") - one * size) * size + (F.col("region2") - two * size)
    seen = pixels.filter("region1 IS NOT NULL AND region2 IS NOT NULL").select(
        *keys, one.alias("block1"), two.alias("block2"), F.floor(place / 64).cast("int").alias("word"), (place % 64).cast("int").alias("_bit")
    )
    words = seen.groupBy(*keys, "block1", "block2", "word").agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("bits"))
    return words.groupBy(*keys, "block1", "block2").agg(
        F.sum(F.bit_count("bits")).cast("bigint").alias("ones"), F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("words")
    )


def cells_of_blocks(blocks: DataFrame, keys: Sequence[str], size: int = MASK_BLOCK) -> DataFrame:
    """The pixels of some blocks again, one row each."""
    words = blocks.select(*keys, "block1", "block2", F.inline("words"))
    bits = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda b: F.getbit("bits", b) == 1)
    place = F.col("word").cast("bigint") * 64 + F.col("_bit")
    return words.withColumn("_bit", F.explode(bits)).select(
        *keys,
        (F.col("block1") * size + F.floor(place / size)).alias("region1"),
        (F.col("block2") * size + place % size).alias("region2"),
    )


def box_blocks(pixels: DataFrame, keys: Sequence[str], size: int = MASK_BLOCK) -> DataFrame:
    """Ones and zeros of the mask padded by one bin, in each block of a group's box that holds a pixel.

    Of the other blocks of the box there are ``blocks - rows``, all zeros, and no row.
    """
    box = _boxes(pixels, keys)
    side = lambda b, low, high: F.least(F.col(b) * size + size - 1, F.col(high)) - F.greatest(F.col(b) * size, F.col(low)) + 1
    span = lambda low, high: F.floor(F.col(high) / size) - F.floor(F.col(low) / size) + 1
    both = join_null_safe(mask_blocks(pixels, keys, size).drop("words"), box, keys)
    cells = side("block1", "low1", "high1") * side("block2", "low2", "high2")
    return both.select(*keys, "block1", "block2", "ones", (cells - F.col("ones")).alias("zeros"), (span("low1", "high1") * span("low2", "high2")).alias("blocks"))


def _boxes(pixels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each group's box padded by one bin."""
    return pixels.groupBy(*keys).agg(
        (F.min("region1") - 1).alias("low1"), (F.max("region1") + 1).alias("high1"),
        (F.min("region2") - 1).alias("low2"), (F.max("region2") + 1).alias("high2"),
    )


def _block_range(low: Column, high: Column) -> Column:
    return F.sequence(F.floor(low / MASK_BLOCK), F.floor(high / MASK_BLOCK))


def _bins_of(block: str, low: Column, high: Column) -> Column:
    start = F.col(block) * MASK_BLOCK
    return F.sequence(F.greatest(start, low), F.least(start + MASK_BLOCK - 1, high))


def _cells(boxes: DataFrame, pixels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every cell of each box with 1 where there is a pixel; lines of a block are joined, not cells."""
    low1, high1, low2, high2 = (F.col(c) for c in ("low1", "high1", "low2", "high2"))
    lines = (
        boxes.withColumn("_block1", F.explode(_block_range(low1, high1)))
        .withColumn("_block2", F.explode(_block_range(low2, high2)))
        .withColumn("region1", F.explode(_bins_of("_block1", low1, high1)))
        .withColumn("_across", _bins_of("_block2", low2, high2))
        .drop("_block1")
    )
    present = pixels.groupBy(*keys, "region1", F.floor(F.col("region2") / MASK_BLOCK).alias("_block2")).agg(F.collect_set("region2").alias("_present"))
    both = join_null_safe(lines, present, [*keys, "region1", "_block2"], "left")
    found = lambda c: F.coalesce(F.array_contains("_present", c), F.lit(False)).cast("int")
    cells = F.transform("_across", lambda c: F.struct(c.alias("region2"), found(c).alias("value")))
    return both.select(*keys, "region1", "low1", "low2", F.inline(cells))


def group_masks(pixels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Dense 0/1 mask of each group on its box padded by one bin, one row per cell.

    The result grows with the area of the boxes; ``mask_blocks`` holds the same in bitmaps of
    the blocks that have a pixel.
    """
    return _cells(_boxes(pixels, keys), pixels, keys).select(
        *keys, "region1", "region2",
        (F.col("region1") - F.col("low1") + 1).alias("row"), (F.col("region2") - F.col("low2") + 1).alias("col"), "value",
    )


def mask_long(pixels: DataFrame, low: int, high: int) -> DataFrame:
    """Dense 0/1 mask of the bins ``low..high`` on both axes, one row per cell and chromosome."""
    seen = pixels.filter(F.col("region1").between(low, high) & F.col("region2").between(low, high))
    window = {c: F.lit(v).cast("bigint") for c, v in {"low1": low, "high1": high, "low2": low, "high2": high}.items()}
    boxes = pixels.select("chr").distinct().withColumns(window)
    return _cells(boxes, seen, ["chr"]).select("chr", "region1", "region2", "value")
