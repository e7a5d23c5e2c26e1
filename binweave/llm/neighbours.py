"""Near duplicates among vectors: a small-world graph per shard, every shard queried, links verified.

Equal vectors become one node with a number of copies.  The nodes of a label are dealt to shards of
bounded size; each shard is built into a graph (see ``hnsw.py``), its own nodes are searched in it, and
then the nodes of every earlier shard of the label.  Links are never rows: a task returns the number of
links of each node, and of the links between two shards' components one each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from binweave.llm.components import components
from binweave.llm.hnsw import QUERIES, Graph
from binweave.llm.registry import query, table
from binweave.llm.words import mix
from binweave.operators.relational import join_checked, join_spread
from binweave.scratch import cut

COSINE = 0.93
SHARD_ROWS = 4096  # nodes meant to be in a shard, which bounds a task's memory
HOT_ROWS = 100_000  # copies of one vector above which a join salts it
BEAM = 48  # first width of a beam
SLACK = 0.02  # how far below the least cosine a search goes on, at first
AUDIT = 256  # queries of a shard whose links are also found by comparing with every node
MOST_TASKS = 20_000  # beyond it a task has several shards, one after the other
RECALL = 0.99  # share of the audited links that must be found, or the beam is widened
MARGIN = 1e-4  # what 32-bit cosines may be off; 64-bit ones decide

_KEYS = ["label", "dim"]
_GRAPHS = (
    "label long, dim int, shard int, shards int, nodes array<long>, copies array<long>, vectors binary, "
    "sizes array<int>, links binary, degrees array<int>, n array<long>, component array<long>"
)
_FOUND = "a long, b long, n long"


def usable(vector: Column) -> Column:
    """Neither NULL nor holding a NULL, NaN or infinite component, nor without any but 0."""
    number = lambda x: x.isNotNull() & ~F.isnan(x) & ~F.abs(x).isin(float("inf"))
    return F.coalesce(F.forall(vector, number) & F.exists(vector, lambda x: x != 0), F.lit(False))


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True, initial=1e-300)
    return scaled / np.sqrt(np.einsum("ad,ad->a", scaled, scaled))[:, None]


def _join(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least numbers of the components after joining ``a`` with ``b``, from those before."""
    while True:
        x, y = labels[a], labels[b]
        apart = x != y
        if not apart.any():
            return labels
        a, b = a[apart], b[apart]
        np.minimum.at(labels, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (labels[labels] != labels).any():
            labels = labels[labels]


def _verified(unit: np.ndarray, queries: np.ndarray, q: np.ndarray, node: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs whose cosine is at least ``least`` in double precision."""
    good = np.zeros(len(q), bool)
    for low in range(0, len(q), 1 << 16):
        part = slice(low, low + (1 << 16))
        good[part] = np.einsum("ad,ad->a", unit[node[part]], queries[q[part]]) >= least
    return q[good], node[good]


def _every(unit: np.ndarray, queries: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The same by comparing with every node."""
    q, node = np.nonzero(queries @ unit.T >= least - MARGIN)
    return _verified(unit, queries, q, node, least)


def _search(graph: Graph, unit: np.ndarray, queries: np.ndarray, least: float, width: int, slack: float, which: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links of the queries (or of those numbered ``which``), a block at a time; a beam as wide as the shard compares with every node."""
    which = np.arange(len(queries)) if which is None else which
    for low in range(0, len(which), QUERIES):
        part = which[low : low + QUERIES]
        if width >= len(unit):
            q, node = _every(unit, queries[part], least)
        else:
            q, node = graph.within(queries[part].astype(np.float32), least - MARGIN, width, slack)
            q, node = _verified(unit, queries[part], q, node, least)
        yield part[q], node


def _audited_width(graph: Graph, unit: np.ndarray, queries: np.ndarray, least: float, recall: float, beam: int) -> tuple[int, float]:
    """The first beam (doubled each time) that finds enough of the links of evenly spread queries."""
    sample = np.unique(np.linspace(0, len(queries) - 1, min(2 * AUDIT, len(queries))).astype(int))
    true = np.zeros(len(queries), np.int64)
    for low in range(0, len(sample), QUERIES):
        q, _ = _every(unit, queries[sample[low : low + QUERIES]], least)
        true += np.bincount(sample[low : low + QUERIES][q], minlength=len(queries))
    width, slack = beam, SLACK
    # Queries without links say nothing about recall.
    sample = np.flatnonzero(true)
    while width < len(unit):
        found = sum(len(q) for q, _ in _search(graph, unit, queries, least, width, slack, sample))
        if found >= recall * true.sum():
            break
        width, slack = 2 * width, 2 * slack
    return width, slack


def _vectors(table: pa.Table) -> np.ndarray:
    flat = table["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(table.num_rows, -1)


def _build(least: float, recall: float, beam: int):
    """A shard's graph, with the links and components among its own nodes."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("node")
        nodes = rows["node"].to_numpy()
        unit = _unit(_vectors(rows))
        chance = mix(nodes.view(np.uint64) + np.uint64(1)).astype(np.float64) / 2.0**64
        graph, order = Graph.build(unit.astype(np.float32), chance)
        nodes, unit, copies = nodes[order], unit[order], rows["copies"].to_numpy()[order]
        width, slack = _audited_width(graph, unit, unit, least, recall, beam)
        number, labels = np.zeros(len(nodes), np.int64), np.arange(len(nodes))
        for q, node in _search(graph, unit, unit, least, width, slack):
            other = q != node
            q, node = q[other], node[other]
            labels = _join(labels, q, node)
            number += np.bincount(q, weights=copies[node], minlength=len(nodes)).astype(np.int64)
        one = lambda values, kind: pa.array([values], kind)
        return pa.table({
            "label": rows["label"].slice(0, 1), "dim": rows["dim"].slice(0, 1), "shard": rows["shard"].slice(0, 1), "shards": rows["shards"].slice(0, 1),
            "nodes": one(nodes, pa.list_(pa.int64())), "copies": one(copies, pa.list_(pa.int64())), "vectors": one(unit.tobytes(), pa.binary()),
            "sizes": one([len(x) for x in graph.links], pa.list_(pa.int32())), "links": one(b"".join(x.tobytes() for x in graph.links), pa.binary()),
            "degrees": one([x.shape[1] for x in graph.links], pa.list_(pa.int32())),
            "n": one(number, pa.list_(pa.int64())), "component": one(nodes[labels], pa.list_(pa.int64())),
        })

    return run


class _Shard:
    """A row of the table of graphs."""

    def __init__(self, row: dict):
        self.nodes, self.copies, self.component = (np.array(row[c], np.int64) for c in ("nodes", "copies", "component"))
        self.unit = np.frombuffer(row["vectors"], np.float64).reshape(len(self.nodes), -1)
        if "links" in row:
            flat, links = np.frombuffer(row["links"], np.int32), []
            for size, degree in zip(row["sizes"], row["degrees"], strict=True):
                links.append(flat[: size * degree].reshape(size, degree))
                flat = flat[size * degree :]
            self.graph = Graph(self.unit.astype(np.float32), links)


def _between(least: float, recall: float, beam: int):
    """Links from the nodes of one shard to those of another, as counts and as edges of components."""

    def run(queries: pa.Table, graphs: pa.Table) -> pa.Table:
        found: list[list[np.ndarray]] = [[], [], []]
        for left in queries.to_pylist():
            for right in graphs.to_pylist():
                a, b = _Shard(left), _Shard(right)
                width, slack = _audited_width(b.graph, b.unit, a.unit, least, recall, beam)
                of_a, of_b = np.zeros(len(a.nodes), np.int64), np.zeros(len(b.nodes), np.int64)
                for q, node in _search(b.graph, b.unit, a.unit, least, width, slack):
                    of_a += np.bincount(q, weights=b.copies[node], minlength=len(a.nodes)).astype(np.int64)
                    of_b += np.bincount(node, weights=a.copies[q], minlength=len(b.nodes)).astype(np.int64)
                    edges = np.unique(np.stack([a.component[q], b.component[node]]), axis=1)
                    for out, values in zip(found, (edges[0], edges[1], np.zeros(edges.shape[1], np.int64)), strict=True):
                        out.append(values)
                for shard, number in ((a, of_a), (b, of_b)):
                    some = number > 0
                    for out, values in zip(found, (shard.nodes[some], shard.nodes[some], number[some]), strict=True):
                        out.append(values)
        arrays = [np.concatenate([np.zeros(0, np.int64), *x]) for x in found]
        return pa.table({n: pa.array(x) for n, x in zip(("a", "b", "n"), arrays, strict=True)})

    return run


def _tasks(groups: int | None) -> int:
    return min(max(2 * (groups or 0), 1), MOST_TASKS)


def near_duplicates(vectors: DataFrame, least: float = COSINE, shard_rows: int = SHARD_ROWS, recall: float = RECALL, beam: int = BEAM) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row (columns ``vec_id``, ``embedding``, ``label``).

    Two rows link if their labels are equal and not NULL, their vectors have the same length and
    their cosine, in double precision, is at least ``least``.  ``n_links`` counts the other rows
    a row links with, ``component_id`` is the least vec_id reachable by links and ``kept`` says that
    it is the row's own.  Every link returned is verified; of all links at least ``recall`` is aimed
    at: in each shard the beam is doubled until it finds that share of the links of up to 512 evenly
    spread queries, known by comparing them with every node, and a beam as wide as the shard
    compares with all.

    A vector that is NULL, empty or zero or holds a NULL or non-finite component links with nothing,
    nor does a row without label: such a row is its own component.  Rows that repeat a vec_id
    are rows of their own, equal rows link with each other.  A NULL vec_id is never a component's
    name unless there is no other, and is not kept.  An empty table gives none; other columns
    are ignored.  Ids and labels are whole numbers.
    """
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), "embedding")
    takes_part = F.col("label").isNotNull() & usable(F.col("embedding"))
    rows = rows.withColumn("embedding", F.when(takes_part, F.col("embedding")))  # NULL where there is nothing to link
    copies = rows.filter("embedding IS NOT NULL").groupBy("label", "embedding").agg(F.count("*").alias("copies"), F.min("vec_id").alias("first"))
    nodes = cut(copies.withColumns({"dim": F.size("embedding"), "node": F.monotonically_increasing_id()}), "nodes")
    sizes = nodes.groupBy(*_KEYS).agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("shards"))
    # A task for each shard and pair of shards: there is much to do for few bytes.
    tasks = sizes.agg(F.sum("shards").alias("n"), F.expr("sum(bigint(shards) * (shards - 1) div 2)").alias("pairs")).first()
    dealt = join_checked(nodes, sizes, _KEYS, "inner").withColumn("shard", F.pmod(F.xxhash64("node"), F.col("shards")).cast("int"))
    shards = dealt.select("label", "dim", "shard", "shards", "node", "copies", "embedding")
    spread = shards.repartition(_tasks(tasks["n"]), "label", "dim", "shard")
    graphs = cut(spread.groupBy("label", "dim", "shard").applyInArrow(_build(least, recall, beam), _GRAPHS), "graphs")
    # Every pair of shards of a label once: the earlier one's nodes are queries in the later one's graph.
    many = graphs.filter("shards > 1")
    later = F.explode(F.sequence(F.col("shard") + 1, F.col("shards") - 1))
    earlier = F.explode(F.sequence(F.lit(0), F.col("shard") - 1))
    queries = many.filter("shard + 1 < shards").select(*_KEYS, F.col("shard").alias("i"), later.alias("j"), "nodes", "copies", "component", "vectors")
    indexes = many.filter("shard > 0").select(
        *_KEYS, earlier.alias("i"), F.col("shard").alias("j"), "nodes", "copies", "component", "vectors", "sizes", "links", "degrees"
    )
    pair = [*_KEYS, "i", "j"]
    queries, indexes = (x.repartition(_tasks(tasks["pairs"]), *pair) for x in (queries, indexes))
    between = cut(queries.groupBy(*pair).cogroup(indexes.groupBy(*pair)).applyInArrow(_between(least, recall, beam), _FOUND), "between")
    inside = graphs.select(F.inline(F.arrays_zip("nodes", "n", "component"))).withColumnRenamed("nodes", "node")
    number = inside.select("node", "n").unionByName(between.filter("n > 0").select(F.col("a").alias("node"), "n")).groupBy("node").agg(F.sum("n").alias("n"))
    edges = inside.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(between.select("a", "b")).filter("a <> b")
    of_node = nodes.join(components(edges), "node", "left").withColumn("component", F.coalesce("component", "node"))
    least_id = of_node.groupBy("component").agg(F.min("first").alias("component_id"))
    known = of_node.join(least_id, "component").join(number, "node")
    known = known.select("label", "embedding", "copies", (F.col("copies") - 1 + F.col("n")).alias("n_links"), "component_id", F.col("copies").alias("counted"))
    # One row per distinct vector on the other side; a vector with very many copies is salted.
    met = join_spread(rows, known.drop("copies"), ["label", "embedding"], "left", HOT_ROWS, "counted")
    component = F.coalesce("component_id", "vec_id")
    return met.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )


OP12_SQL = f"""
WITH RECURSIVE v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
), u AS MATERIALIZED (
  SELECT r, vec_id, label, len(v) AS dim, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM v
  WHERE label IS NOT NULL AND v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(v, lambda x: x <> 0)) > 0
), links AS MATERIALIZED (
  SELECT a.r AS a, b.r AS b FROM u a JOIN u b ON a.label = b.label AND a.dim = b.dim AND a.r <> b.r
  WHERE list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) / (a.norm * b.norm) >= {COSINE}
), reach AS (
  SELECT r AS a, r AS b FROM v UNION SELECT reach.a, l.b FROM reach JOIN links l ON reach.b = l.a
), least AS (
  SELECT reach.a AS r, min(vec_id) AS component_id FROM reach JOIN v ON v.r = reach.b GROUP BY 1
), n AS (
  SELECT a AS r, count(*) AS n FROM links GROUP BY 1
)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, coalesce(vec_id = component_id, false) AS kept
FROM v JOIN least USING (r) LEFT JOIN n USING (r)
"""


@query("op12_embedding_dedup", OP12_SQL)
def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates among all vectors of a label, by a cosine of 0.93."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))
