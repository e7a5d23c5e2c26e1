"""User functions over groups of any size.

``apply_in_blocks`` runs a function on blocks of a group that follow each other in an order, each with
the rows around it if wanted, and merges what the blocks give.  ``user_aggregate`` runs an aggregate made
of update, merge and finish over Arrow batches, combined before the shuffle.  Neither ever holds a
group in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from binweave.operators.relational import join_null_safe
from binweave.scratch import cut

BLOCK_ROWS = 100_000  # rows meant to be in a block
BATCH_ROWS = 200_000  # rows an aggregate is updated with at once
HELD_GROUPS = 100_000  # groups whose state a task holds before it passes them on
DIGEST = 4_096  # distinct values up to which a digest is exact

Function = Callable[[pa.Table], pa.Table]


# --- blocks of a group ---------------------------------------------------------------


def _fields(df: DataFrame, names: Sequence[str]) -> list[T.StructField]:
    return [T.StructField(n, df.schema[n].dataType) for n in names]


def _with_keys(table: pa.Table, keys: Sequence[str], out: pa.Table) -> pa.Table:
    """``out`` with the keys of ``table``'s first row in every row."""
    first = pa.array(np.zeros(out.num_rows, np.int64))
    for i, k in enumerate(keys):
        out = out.add_column(i, k, table[k].combine_chunks().take(first) if table.num_rows else pa.array([], table.schema.field(k).type))
    return out


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _each_group(function: Function, keys: Sequence[str], named: Sequence[str] | None = None):
    """``function`` over each group of rows that are sorted by ``keys``, with the keys ``named`` added.

    Only the group that a batch ends in is held until it is known to be whole.
    """
    named = keys if named is None else named

    def whole(table: pa.Table) -> list[pa.Table]:
        first = np.append(_codes(table, keys)[1], table.num_rows).tolist()
        groups = [table.slice(a, b - a) for a, b in zip(first, first[1:])]
        return [_with_keys(g, named, function(g)) for g in groups]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []  # pieces of one group
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            last = _codes(table, keys)[1][-1]
            if held:
                # Does the batch begin with more of the group that is held?
                ends = pa.concat_tables([held[0].slice(0, 1), table.slice(0, 1)])
                if len(_codes(ends, keys)[1]) > 1:
                    yield from _batches(whole(pa.concat_tables(held)))
                    held = []
            if last:
                yield from _batches(whole(pa.concat_tables([*held, table.slice(0, last)])))
                held = []
            held.append(table.slice(last))
        if held:
            yield from _batches(whole(pa.concat_tables(held)))

    return run


def _batches(tables: list[pa.Table]) -> Iterator[pa.RecordBatch]:
    return iter(pa.concat_tables(tables).combine_chunks().to_batches())


def _with_halo(ranged: DataFrame, keys: Sequence[str], order: str, halo: float) -> DataFrame:
    """Rows repeated in every block of their group that they lie within ``halo`` of.

    Only a group that spans blocks has any to go to, of which there are fewer than blocks, so the
    lists of their blocks are small enough to be broadcast.
    """
    edges = ranged.groupBy(*keys, "_block").agg(F.min(order).alias("_least"), F.max(order).alias("_greatest"))
    along = Window.partitionBy(*keys).orderBy("_block")
    near = edges.select(*keys, "_block", F.lag("_greatest").over(along).alias("_before"), F.lead("_least").over(along).alias("_after"))
    near = near.filter("_before IS NOT NULL OR _after IS NOT NULL")
    spans = edges.groupBy(*keys).agg(F.collect_list(F.struct("_block", "_least", "_greatest")).alias("_parts")).filter(F.size("_parts") > 1)
    joined = join_null_safe(ranged, F.broadcast(near), [*keys, "_block"], "left")
    at_edge = F.coalesce((F.col(order) <= F.col("_before") + halo) | (F.col(order) >= F.col("_after") - halo), F.lit(False))
    parts = join_null_safe(joined.withColumn("_edge", at_edge), F.broadcast(spans), keys, "left")
    reached = F.filter("_parts", lambda p: (p._block != F.col("_block")) & (F.col(order) >= p._least - halo) & (F.col(order) <= p._greatest + halo))
    others = F.when(F.col("_edge"), F.transform(reached, lambda p: p._block)).otherwise(F.array().cast("array<int>"))
    targets = F.explode(F.concat(F.array("_block"), F.coalesce(others, F.array().cast("array<int>"))))
    rows = parts.withColumn("_target", targets).withColumn("_own", F.col("_target") == F.col("_block"))
    return rows.drop("_block", "_before", "_after", "_edge", "_parts").withColumnRenamed("_target", "_block")


def apply_in_blocks(
    df: DataFrame, keys: Sequence[str], order: str, partial: Function, partial_schema: str,
    merge: Function, schema: str, halo: float | None = None, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """A function from a group's rows to a table, for groups of any size.

    Rows are dealt by ranges of the keys and ``order`` into blocks of about ``block_rows`` and
    written.  A block holds consecutive rows of a group; rows of one ``order`` value are never
    parted.  ``partial`` takes the rows of a block, sorted by ``order``, to a table of
    ``partial_schema``; with ``halo`` it also gets the rows of the group within that distance of
    the block, and a column ``_own`` that tells which are the block's.  ``merge`` takes what the blocks of a
    group gave, in their order, to a table of ``schema``.  Keys are added to both results.

    A group that ``partial`` does not shrink is gathered in ``merge`` as it is; to return rows
    of blocks unmerged, use ``rows_in_blocks``.  NULL keys are a group; rows without ``order`` are left out.
    """
    partials = rows_in_blocks(df, keys, order, partial, partial_schema, halo, block_rows, with_block=True)
    out = T.StructType([*_fields(df, keys), *T.StructType.fromDDL(schema).fields])

    merged = _each_group(lambda table: merge(table.drop_columns([*keys, "_block"])), keys)
    return partials.repartition(*keys).sortWithinPartitions(*keys, "_block").mapInArrow(merged, out)


def rows_in_blocks(
    df: DataFrame, keys: Sequence[str], order: str, function: Function, schema: str,
    halo: float | None = None, block_rows: int = BLOCK_ROWS, with_block: bool = False,
) -> DataFrame:
    """The first half of ``apply_in_blocks``: what ``function`` gives for each block of a group, with the keys."""
    some = df.filter(F.col(order).isNotNull())
    parts = some.count() // block_rows + 1
    ranged = cut(some.repartitionByRange(parts, *keys, order).withColumn("_block", F.spark_partition_id()), "ranged")
    blocks = ranged if halo is None else _with_halo(ranged, keys, order, halo)
    fields = [*_fields(df, keys), *([T.StructField("_block", T.IntegerType())] if with_block else []), *T.StructType.fromDDL(schema).fields]
    named = [*keys, "_block"] if with_block else list(keys)

    run = _each_group(lambda table: function(table.drop_columns(["_block"])), [*keys, "_block"], named)
    # A task for each block that is full, and many small groups to a task.
    dealt = blocks.repartition(max(parts, _partitions(df)), *keys, "_block")
    return dealt.sortWithinPartitions(*keys, "_block", order).mapInArrow(run, T.StructType(fields))


# --- user aggregates -----------------------------------------------------------------


@dataclass
class UserAggregate:
    """An aggregate over many groups at once.

    ``update(rows, codes, n)`` makes one row of state for each of ``n`` groups from rows whose group
    numbers are ``codes``; ``merge(states, codes, n)`` does so from rows of state; ``finish(states)``
    turns each row of state into a row of the result.  ``state`` and ``result`` are their schemas.
    Both ``update`` and ``merge`` must not depend on the order of rows.
    """

    update: Callable[[pa.Table, np.ndarray, int], pa.Table]
    merge: Callable[[pa.Table, np.ndarray, int], pa.Table]
    finish: Function
    state: str
    result: str


def _codes(table: pa.Table, keys: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the groups in order of their first row, and the place of each group's first row."""
    code = np.zeros(table.num_rows, np.int64)
    for k in keys:
        column = table[k].combine_chunks().dictionary_encode(null_encoding="encode")
        # Renumbered after each key, so that products stay small.
        code = np.unique(code * (len(column.dictionary) + 1) + column.indices.to_numpy(), return_inverse=True)[1]
    _, first, code = np.unique(code, return_index=True, return_inverse=True)
    order = np.argsort(first)
    return np.argsort(order)[code], first[order]


def _combined(table: pa.Table, keys: Sequence[str], combine: Callable[[pa.Table, np.ndarray, int], pa.Table]) -> pa.Table:
    """One row of keys and state per group of the rows."""
    codes, first = _codes(table, keys)
    states = combine(table.drop_columns(list(keys)), codes, len(first))
    for i, k in enumerate(keys):
        states = states.add_column(i, k, table[k].combine_chunks().take(pa.array(first)))
    return states


def user_aggregate(df: DataFrame, keys: Sequence[str], columns: Sequence[str], aggregate: UserAggregate, held_groups: int = HELD_GROUPS) -> DataFrame:
    """The keys and the aggregate's result for each group.

    A task keeps one row of state per group it meets, for at most ``held_groups`` of them, and only
    states are shuffled: a group holding any share of the rows arrives as one state per task.
    NULL keys are a group, an empty table has none.
    """
    state = T.StructType([*_fields(df, keys), *T.StructType.fromDDL(aggregate.state).fields])
    result = T.StructType([*_fields(df, keys), *T.StructType.fromDDL(aggregate.result).fields])

    def merged(parts: list[pa.Table]) -> pa.Table:
        table = pa.concat_tables(parts) if len(parts) > 1 else parts[0]
        return _combined(table, keys, aggregate.merge) if len(parts) > 1 else table

    def update(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting, rows = [], [], 0
        for batch in batches:
            waiting.append(batch)
            rows += batch.num_rows
            if rows >= BATCH_ROWS:
                held = [merged([*held, _combined(pa.Table.from_batches(waiting), keys, aggregate.update)])]
                waiting, rows = [], 0
                if held[0].num_rows > held_groups:
                    yield from held[0].to_batches()
                    held = []
        if rows:
            held = [merged([*held, _combined(pa.Table.from_batches(waiting), keys, aggregate.update)])]
        for table in held:
            yield from table.to_batches()

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
            out = aggregate.finish(table.drop_columns(list(keys)))
            for i, k in enumerate(keys):
                out = out.add_column(i, k, table[k])
            return iter(out.to_batches())

        carried = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = _combined(table if carried is None else pa.concat_tables([carried, table]), keys, aggregate.merge)
            # States are sorted by key, so only the last group may go on in the next batch.
            carried = table.slice(table.num_rows - 1)
            yield from done(table.slice(0, table.num_rows - 1))
        if carried is not None:
            yield from done(carried)

    states = df.select(*keys, *columns).mapInArrow(update, state)
    return states.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(finish, result)


def _lists(codes: np.ndarray, n: int, *values: np.ndarray) -> list[pa.Array]:
    """Values of rows sorted by group as one list per group."""
    offsets = pa.array(np.searchsorted(codes, np.arange(n + 1)).astype(np.int32))
    return [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in values]


def _flat(states: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of lists, and the row of each."""
    column = states[name].combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy()))


def _weights_by_value(codes: np.ndarray, values: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each distinct value of each group once, in order, with its whole weight."""
    order = np.lexsort((values, codes))
    codes, values, weights = codes[order], values[order], weights[order]
    new = np.ones(len(codes), bool)
    new[1:] = (codes[1:] != codes[:-1]) | (values[1:] != values[:-1])
    first = np.flatnonzero(new)
    return codes[first], values[first], np.add.reduceat(weights, first) if len(first) else weights


def weighted_median(value: str, weight: str, most: int = DIGEST) -> UserAggregate:
    """The least value at which half of a group's weight is reached, with ``exact``.

    The state is a digest: each distinct value with its weight, exact up to ``most`` of them.  Beyond
    that neighbours are put together in pairs under their greater value until half as many are left,
    so a state never outgrows ``most`` entries, and ``exact`` is false.  Rows whose value
    or weight is NULL, and NaN values, are passed over; weights are whole and not negative.
    A group without any weight has a NULL median.
    """

    def digest(codes: np.ndarray, values: np.ndarray, weights: np.ndarray, exact: np.ndarray) -> pa.Table:
        n = len(exact)
        codes, values, weights = _weights_by_value(codes, values, weights)
        while True:
            size = np.bincount(codes, minlength=n)
            large = size > most
            if not large.any():
                break
            exact = exact & ~large
            place = np.arange(len(codes)) - np.repeat(np.cumsum(size) - size, size)
            # The first of a pair passes its weight to the second; a last one stays alone.
            gone = large[codes] & (place % 2 == 0) & (place + 1 < size[codes])
            weights = weights + np.concatenate([[0], np.where(gone, weights, 0)[:-1]])
            codes, values, weights = codes[~gone], values[~gone], weights[~gone]
        v, w = _lists(codes, n, values, weights)
        return pa.table({"values": v, "weights": w, "exact": pa.array(exact)})

    def update(rows: pa.Table, codes: np.ndarray, n: int) -> pa.Table:
        known = ~(np.asarray(rows[value].is_null()) | np.asarray(rows[weight].is_null()))
        values = rows[value].fill_null(np.nan).to_numpy().astype(np.float64) + 0.0
        known &= ~np.isnan(values)
        weights = rows[weight].fill_null(0).to_numpy().astype(np.int64)
        known &= weights > 0
        return digest(codes[known], values[known], weights[known], np.ones(n, bool))

    def merge(states: pa.Table, codes: np.ndarray, n: int) -> pa.Table:
        values, row = _flat(states, "values")
        weights, _ = _flat(states, "weights")
        exact = np.ones(n, bool)
        np.logical_and.at(exact, codes, states["exact"].to_numpy())
        return digest(codes[row], values.astype(np.float64), weights.astype(np.int64), exact)

    def finish(states: pa.Table) -> pa.Table:
        values, row = _flat(states, "values")
        weights, _ = _flat(states, "weights")
        n = states.num_rows
        upto = np.cumsum(weights.astype(np.int64))
        first = np.searchsorted(row, np.arange(n + 1))
        sums = np.concatenate([[0], upto])
        before, total = sums[first[:-1]], sums[first[1:]] - sums[first[:-1]]
        reached = np.flatnonzero(2 * (upto - before[row]) >= total[row])
        at = np.searchsorted(row[reached], np.arange(n))
        some = total > 0
        median = np.full(n, np.nan)
        median[some] = values[reached[at[some]]]
        return pa.table({"median": pa.array(median, mask=~some), "exact": states["exact"]})

    return UserAggregate(update, merge, finish, "values array<double>, weights array<bigint>, exact boolean", "median double, exact boolean")


# --- runs of neighbouring values, as a partial step and a merge ---------------------------


def run_of_block(value: str) -> Function:
    """Partial step of ``longest_run``: of a block the run it begins with, the one it ends with and the longest."""

    def partial(rows: pa.Table) -> pa.Table:
        at = np.unique(rows[value].to_numpy())
        heads = np.flatnonzero(np.diff(at, prepend=at[0] - 2) > 1)
        sizes = np.diff(np.append(heads, len(at)))
        best = int(np.argmax(sizes))
        return pa.table({"least": [int(at[0])], "greatest": [int(at[-1])], "head": [int(sizes[0])], "tail": [int(sizes[-1])],
                         "whole": [len(sizes) == 1], "run": [int(sizes[best])], "starts": [int(at[heads[best]])]})

    return partial


RUN_STATE = "least bigint, greatest bigint, head bigint, tail bigint, whole boolean, run bigint, starts bigint"


def longest_run(blocks: pa.Table) -> pa.Table:
    """Merge of ``run_of_block``: the longest run of a group and where it starts; of equal ones the first."""
    best, starts, open_, end = 0, 0, 0, None  # ``open_`` is the length of the run that ends at ``end``
    for b in blocks.to_pylist():
        joined = end is not None and b["least"] == end + 1
        head = (open_ if joined else 0) + b["head"]
        for run, start in ((head, b["least"] + b["head"] - head), (b["run"], b["starts"])):
            if run > best:
                best, starts = run, start
        open_ = head if b["whole"] else b["tail"]
        end = b["greatest"]
    return pa.table({"run": [best], "starts": [starts]})
