"""Set membership in a bitmap of fixed size, built by Spark and broadcast.

The size is a parameter and never grows, so the broadcast is bounded.  A member is always found;
the share of strangers that are found too grows with the set, so a bitmap only spares work and
never decides a result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITMAP_BITS = 1 << 24


def slot(*columns: str, bits: int = BITMAP_BITS) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(bits))


def _words(slots: DataFrame) -> DataFrame:
    """Set bits of the slots in column ``slot``, 64 to a row; at most ``bits / 64`` rows."""
    return slots.groupBy(F.floor(F.col("slot") / 64).cast("int").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("set")
    )


def bitmap_of(slots: DataFrame, bits: int = BITMAP_BITS) -> np.ndarray:
    """Bits of the slots in column ``slot``, as bytes."""
    words = _words(slots).toArrow()
    packed = np.zeros(bits // 64, np.int64)
    packed[words["word"].to_numpy()] = words["set"].to_numpy()
    return packed.view(np.uint8)


def contains(packed: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (packed[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 == 1


def maybe(docs: DataFrame, members: DataFrame, bits: int = BITMAP_BITS) -> DataFrame:
    """``docs`` with ``__maybe``: false for documents whose doc_id is certainly not among ``members``.

    The bitmap's words are joined by broadcast; their number is bounded by its fixed size.
    """
    words = _words(members.select(slot("doc_id", bits=bits).alias("slot"))).withColumnsRenamed({"word": "__word", "set": "__set"})
    placed = docs.withColumn("__slot", slot("doc_id", bits=bits))
    joined = placed.join(F.broadcast(words), F.floor(F.col("__slot") / 64) == F.col("__word"), "left")
    inside = F.expr("shiftright(coalesce(__set, 0L), cast(__slot % 64 as int)) & 1L = 1L")
    return joined.withColumn("__maybe", inside).drop("__slot", "__word", "__set")
