"""Contiguous shards of nearly equal byte size, cut from global prefix sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from binweave.llm.registry import query, table
from binweave.scratch import cut

SHARDS = 40
ROW_BYTES = 16  # what a row takes beside its text


def _column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def balanced_shards(rows: DataFrame, order: str, size: str, shards: int, tie: str | None = None) -> DataFrame:
    """``rows`` with ``shard`` (0 to ``shards - 1``) and ``slot``, its place in the shard from 0.

    Rows are dealt to partitions by ranges of ``order`` (then ``tie``) and written, so that a
    lost executor cannot change a partition.  Their number is left to adaptive execution, which
    merges neighbours by bytes: each is a file, and without Hadoop's native library every new file
    starts processes that share the executor's memory for a moment.  Each partition's total and
    count follow from an aggregate; their prefix sums, over one small row per partition, shift the
    sums within the partitions.  A row goes to the shard that its middle byte falls into, so shards
    are contiguous and each cut is off its target by half a row at most.

    Only slim rows should be passed: whatever is in ``rows`` is shuffled.  Equal rows are
    interchangeable and spread over partitions by a random third key, so that one order value may
    hold any share of the rows; NULL order values come first.  A NULL size counts as 0, an
    empty table gives none.  If all sizes are 0, every row goes to shard 0.  A single row above
    the target makes its shard that much larger.  Columns named ``shard`` or ``slot`` are replaced;
    all others pass through, whatever their names.
    """
    # The caller's columns travel in a struct by number, so that none can clash with those below.
    names = {c: f"c{k}" for k, c in enumerate(rows.columns)}
    by = list(dict.fromkeys([order, *([tie] if tie else [])]))
    names |= {c: f"key{k}" for k, c in enumerate(by)}
    keys = [*[f"_given.{names[c]}" for c in by], "_any"]
    given = F.struct(*[_column(c).alias(n) for c, n in names.items()])
    dealt = rows.select(
        given.alias("_given"), F.rand(7).alias("_any"), F.coalesce(_column(size), F.lit(0)).cast("bigint").alias("_size")
    )
    ranged = dealt.repartitionByRange(*[F.col(k).asc_nulls_first() for k in keys])
    written = cut(ranged.withColumn("_part", F.spark_partition_id()), "ranged")

    totals = written.groupBy("_part").agg(F.sum("_size").alias("_bytes"), F.count("*").alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = totals.select(  # one row per partition, which their number bounds
        "_part",
        F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_bytes_before"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows_before"),
    )
    total = totals.agg(F.sum("_bytes")).scalar()
    here = Window.partitionBy("_part").orderBy(*[F.col(k).asc_nulls_first() for k in keys])
    within = here.rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        written.withColumn("_local", F.coalesce(F.sum("_size").over(within), F.lit(0)))
        .withColumn("_row", F.row_number().over(here) - 1)
        .join(F.broadcast(shifts), "_part")
        .withColumn("_middle", 2 * (F.col("_bytes_before") + F.col("_local")) + F.col("_size"))
        .withColumn("_at", F.col("_rows_before") + F.col("_row"))
    )
    twice = (2 * F.greatest(total, F.lit(1))).cast("decimal(20, 0)")
    share = F.expr(f"(cast(_middle as decimal(20, 0)) * {shards}) div _twice")  # exact
    sharded = placed.withColumn("_twice", twice).withColumn("shard", F.least(share, F.lit(shards - 1)).cast("int"))
    firsts = sharded.groupBy("shard").agg(F.min("_at").alias("_first"))  # at most ``shards`` rows
    return sharded.join(F.broadcast(firsts), "shard").select(
        *[F.col(f"_given.{n}").alias(c) for c, n in names.items() if c not in ("shard", "slot")],
        "shard", (F.col("_at") - F.col("_first")).cast("bigint").alias("slot")
    )


OP2_SQL = f"""
WITH powers AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(CAST(i AS BIGINT), range(8)),
    lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS p
), d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents
), b AS (
  SELECT doc_id, list_transform(range(len(x) // 2), lambda i: (instr('0123456789ABCDEF', x[2 * i + 1]) - 1) * 16
    + instr('0123456789ABCDEF', x[2 * i + 2]) - 1) AS bytes FROM d
), c AS (
  SELECT doc_id, CAST(len(bytes) + {ROW_BYTES} AS BIGINT) AS size,
         CAST(xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bytes),
           lambda a, b: xor(a >> 8, p[1 + (xor(a, b) & 255)])), 4294967295) AS BIGINT) AS text_crc32
  FROM b, powers
), s AS (
  SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, text_crc32 ROWS UNBOUNDED PRECEDING) AS upto,
         row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32) AS n, sum(size) OVER () AS total FROM c
), t AS (
  SELECT *, CAST(least(((2 * upto - size) * {SHARDS}) // (2 * total), {SHARDS - 1}) AS INTEGER) AS shard FROM s
)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
       CAST(n - min(n) OVER (PARTITION BY shard) AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM t
"""


@query("op2_sharding", OP2_SQL)
def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of nearly equal bytes; a NULL text has none, and CRC 0."""
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text) + ROW_BYTES).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).cast("bigint").alias("text_crc32"),
    )
    return balanced_shards(slim, "doc_id", "size", SHARDS, "text_crc32").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
