"""Composed jobs: the tables behind the linked views, and what a selection shows.

``linked_tables`` writes the derived pixel table once, and from it one row per
cluster and tile, since the other tables start from these two; the rest is lazy.  ``write_linked_view`` writes every
table in chunks by the selectors its view answers to, so that a viewer opens
only the chunk of the current selection.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import cache, reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from binweave.functions.text import pair_text
from binweave.operators.boundary import segments
from binweave.operators.geometry import (
    PIXEL_HALF,
    TILE,
    TILE_OFFSET,
    TILE_WIDTH,
    axis_relative_corners,
    axis_tile,
    corner_extents,
    corners,
    label_anchor,
    polygon_tiles,
    position_name,
    relative_shape,
    tile,
    tile_center,
    tile_corners,
    tile_name,
    tile_spacing,
    tiled_pixels,
)
from binweave.operators.gaps import missing_runs
from binweave.operators.relational import (
    grid_counts,
    missing_pixels,
    relative_to_least,
    rows_for_keys,
    strictly_between,
    tagged_union,
    window,
)
from binweave.operators.rings import close_rings, outlines, trace
from binweave.operators.selection import (
    diagonal_pixels,
    flag_selected,
    initial_selection,
    shown,
    tooltip,
)
from binweave.operators.summaries import (
    LOGFC_PER_UNIT,
    cluster_tile_labels,
    cluster_tiles,
    coarse_volcano_bins,
    color_scale,
    first_polygon_extents,
    midpoint_intervals,
    polygon_counts,
    representation_labels,
    representation_rows,
    representation_sizes,
    size_bins,
    size_heat,
    size_points,
    summarize_clusters,
    summarize_tiles,
    tile_summary,
    volcano_bins,
    volcano_heat,
    with_p,
)
from binweave.scratch import cut
from binweave.sinks.chunk_index import IndexedChunks, write_indexed_chunks
from binweave.sinks.chunks import ROWS_PER_FILE, read_chunks, write_chunks

CLUSTER = ["chr", "clust"]
LOCAL = ["chr", "clust", *TILE]

# Selectors of few values, with a folder of text files for each.
CHUNKS = {
    "tiles": ["chr"],
    "presence": ["chr"],
    "volcano_heat": ["chr"],
    "size_heat": ["chr"],
    "size_points": ["chr", "size_bin"],
    "shape": [],
    "first": [],
}
# Tables looked up by tile, volcano bin or cluster, of which there are too many for a folder each:
# files in the order of these selectors, found through an index.
INDEXED = {
    "pixels": ["chr", "round_regions"],
    "volcano_points": ["chr", "volcano_bin"],
    "local_outlines": ["chr", "round_regions"],
    "labels": ["chr", "round_regions"],
    "outlines": ["chr", "clust"],
    "cluster_points": ["chr", "clust"],
}
TABLES = (*CHUNKS, *INDEXED)
WRITERS = 4  # tables of a view that are written at once
ABOUT = "about"  # the table of a written view that lists the others


# Columns of the prepared pixels that the tables are made of.
PREPARED = [
    "chr", "region1", "region2", "clust", "logfc", "neg_log10_p", *TILE, "rel_region_x",
    "rel_region_y", "round_regions", "rel_regions", "round_logfc", "round_neg_log10_p",
    "volcano_bin", "relative_logfc", "relative_neg_log10_p",
]


def prepared_pixels(
    pixels: DataFrame,
    greatest: int | None = None,
    width: float = TILE_WIDTH,
    offset: tuple[float, float] = TILE_OFFSET,
) -> DataFrame:
    """Pixels with p scores, tile, place in the tile and volcano bin."""
    scored = with_p(window(pixels, greatest))
    named = position_name(tile_name(tiled_pixels(scored, width, offset)))
    return volcano_bins(named)


def linked_tables(
    pixels: DataFrame,
    greatest: int | None = None,
    width: float = TILE_WIDTH,
    offset: tuple[float, float] = TILE_OFFSET,
    log2_tiles: bool = False,
    saddle: str = "separate",
    names: Sequence[str] = TABLES,
) -> dict[str, DataFrame]:
    """The tables of the linked cluster view, or those of them in ``names``."""

    @cache
    def rows() -> DataFrame:
        prepared = prepared_pixels(pixels, greatest, width, offset)
        return cut(prepared.select(*PREPARED), "prepared")

    @cache
    def cells() -> DataFrame:
        return cut(cluster_tiles(rows()), "cells")

    def seen() -> DataFrame:
        return cells().select("chr", *TILE, "clust")

    def binned() -> DataFrame:
        return size_bins(summarize_clusters(cells()), log2_tiles)

    def local_outlines() -> DataFrame:
        local = tile_name(outlines(rows(), LOCAL, saddle))
        return local.withColumns(
            {
                f"rel_region_{a}": F.col(f"region_{a}") - F.col(f"round_region_{a}")
                for a in ("x", "y")
            }
        )

    def cluster_outlines() -> DataFrame:
        return tile_name(tile(outlines(rows(), CLUSTER, saddle), width, offset))

    def labels() -> DataFrame:
        anchor = label_anchor(corner_extents(rows()))
        return tile_name(cluster_tile_labels(cells(), summarize_clusters(cells()), anchor))

    build = {
        "pixels": lambda: rows().select(
            "chr", "round_regions", "rel_regions", "region1", "region2", "clust",
            "logfc", "neg_log10_p", "volcano_bin",
        ),
        "volcano_points": lambda: rows().select(
            "chr", "volcano_bin", "clust", "region1", "region2",
            "relative_logfc", "relative_neg_log10_p",
        ),
        "shape": lambda: position_name(relative_shape(rows())).drop("rel_region_x", "rel_region_y"),
        "tiles": lambda: tile_name(tile_center(summarize_tiles(cells()), offset)),
        "presence": lambda: tile_name(tile_center(seen(), offset)),
        "local_outlines": local_outlines,
        "outlines": cluster_outlines,
        "cluster_points": lambda: rows().select(
            "chr", "clust", "region1", "region2", "logfc", "neg_log10_p"
        ),
        "labels": labels,
        "volcano_heat": lambda: tooltip(volcano_heat(rows())),
        "size_heat": lambda: size_heat(binned(), log2_tiles),
        "size_points": lambda: size_points(binned()),
        "first": lambda: tile_name(initial_selection(rows(), seen(), TILE)),
    }
    return {name: build[name]() for name in names}


def write_linked_view(tables: Mapping[str, DataFrame], path: str, rows_per_file: int = ROWS_PER_FILE) -> None:
    """Every table in its chunks below ``path``, and a table of their schemas.

    Tables are written a few at a time, so that the small ones fill the cores the last tasks of others leave idle.
    """

    def write(name: str) -> None:
        if name in INDEXED:
            write_indexed_chunks(tables[name], INDEXED[name], f"{path}/{name}", rows_per_file)
        else:
            write_chunks(tables[name], CHUNKS[name], f"{path}/{name}")

    with ThreadPoolExecutor(WRITERS) as pool:
        list(pool.map(write, tables))
    about = [(name, df.schema.json(), name in INDEXED) for name, df in tables.items()]
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame(about, "name string, schema string, indexed boolean").coalesce(1).write.json(f"{path}/{ABOUT}")


@dataclass
class WrittenView:
    """Tables read from their chunks, and the chunks of those that have an index."""

    tables: dict[str, DataFrame]
    chunks: dict[str, IndexedChunks]

    def show(self, selection: Mapping[str, Any]) -> dict[str, DataFrame]:
        return linked_view(self.tables, selection, self.chunks)

    def show_from(self, selection: DataFrame) -> dict[str, DataFrame]:
        return linked_from(self.tables, selection, self.chunks)


def read_linked_view(spark: SparkSession, path: str) -> WrittenView:
    """A written view; a selection opens only the files that can hold it."""
    tables, chunks = {}, {}
    listed = spark.read.schema("name string, schema string, indexed boolean").json(f"{path}/{ABOUT}")
    for row in listed.collect():  # one row per table
        name, schema = row["name"], T.StructType.fromJson(json.loads(row["schema"]))
        if row["indexed"]:
            chunks[name] = IndexedChunks(spark, f"{path}/{name}", schema, INDEXED[name])
            tables[name] = chunks[name].all()
        else:
            tables[name] = read_chunks(spark, f"{path}/{name}", schema)
    return WrittenView(tables, chunks)


def _opened(tables: Mapping[str, DataFrame], name: str, values: Mapping[str, Any], chunks: Mapping[str, IndexedChunks] | None) -> DataFrame:
    """The table, or of an indexed one the rows with the given selectors from the files that can hold them."""
    known = {s: values[s] for s in INDEXED.get(name, []) if s in values}
    return chunks[name].read(known) if chunks and name in chunks and known else tables[name]


def linked_view(
    tables: Mapping[str, DataFrame], selection: Mapping[str, Any], chunks: Mapping[str, IndexedChunks] | None = None
) -> dict[str, DataFrame]:
    """What each view shows for chosen ``chr, volcano_bin, clust, round_regions, size_bin``.

    A volcano bin lists its pixels, a pixel's cluster lists its tiles, and a tile lists
    its pixels, outlines and label; rows of the chosen cluster are flagged.
    """

    def pick(name: str, *selectors: str) -> DataFrame:
        wanted = {s: selection[s] for s in ("chr", *selectors) if s in selection}
        single = {s: v for s, v in wanted.items() if isinstance(v, (str, int, float))}
        return shown(_opened(tables, name, single, chunks), wanted)

    mine = {"clust": selection["clust"]} if "clust" in selection else {}
    views = {
        "volcano_zoom": ("volcano_points", ["volcano_bin"], True),
        "cluster_pixels": ("cluster_points", ["clust"], False),
        "cluster_outline": ("outlines", ["clust"], False),
        "cluster_tiles": ("presence", ["clust"], False),
        "tile_pixels": ("pixels", ["round_regions"], True),
        "tile_outlines": ("local_outlines", ["round_regions"], True),
        "tile_label": ("labels", ["clust", "round_regions"], False),
        "size_zoom": ("size_points", ["size_bin"], True),
        "volcano_heat": ("volcano_heat", [], False),
        "size_heat": ("size_heat", [], False),
        "tiles": ("tiles", [], False),
    }
    found = {view: (pick(name, *keys), flag) for view, (name, keys, flag) in views.items() if name in tables}
    return {view: flag_selected(df, mine) if flag else df for view, (df, flag) in found.items()}


def linked_from(
    tables: Mapping[str, DataFrame], selection: DataFrame, chunks: Mapping[str, IndexedChunks] | None = None
) -> dict[str, DataFrame]:
    """The same chain for those of the tables that are given, from a table of one row.

    The row is written once and its values enter the filters as scalar subqueries, of which a second
    row is an error.  For indexed chunks the row is looked at first, since it names the files.
    """
    selection = cut(selection, "selection")
    views = {
        "volcano_zoom": ("volcano_points", ["chr", "volcano_bin"]),
        "cluster_pixels": ("cluster_points", CLUSTER),
        "cluster_outline": ("outlines", CLUSTER),
        "cluster_tiles": ("presence", CLUSTER),
        "tile_pixels": ("pixels", ["chr", "round_regions"]),
        "tile_outlines": ("local_outlines", ["chr", "round_regions"]),
        "tile_label": ("labels", [*CLUSTER, "round_regions"]),
    }
    row = {}
    if chunks:
        rows = selection.limit(2).collect()
        if len(rows) > 1:
            raise ValueError("a selection of more than one row")
        row = rows[0].asDict() if rows else {}
    found = {}
    for view, (name, keys) in views.items():
        if name in tables:
            values = {k: selection.select(k).scalar() for k in keys}
            chosen = reduce(lambda a, b: a & b, [F.col(k) == v for k, v in values.items()])
            found[view] = _opened(tables, name, {k: row[k] for k in keys if k in row}, chunks).filter(chosen)
    return found


def missing_report(pixels: DataFrame, max_distance: int | None = None) -> dict[str, DataFrame]:
    """Missing cells of the grid up to a distance, and how many of how many.

    Without ``max_distance`` it is the whole triangle, whose missing cells are given as runs.
    """
    missing = {"runs": missing_runs(pixels)} if max_distance is None else {"missing": missing_pixels(pixels, max_distance)}
    return missing | {"counts": grid_counts(pixels, max_distance=max_distance)}


def outline_report(
    pixels: DataFrame, low: float, high: float, saddle: str = "separate"
) -> dict[str, DataFrame]:
    """Outlines, simplified outlines and pixels of a window, with their row counts as labels."""
    inside = pixels.filter(strictly_between(["region1", "region2"], low, high))
    segs = cut(segments(inside, CLUSTER, saddle), "segments")
    ordered = trace(segs, CLUSTER)
    simple = ordered.filter("keep").withColumn("vertex_ord", F.col("kept_ord"))
    columns = [*CLUSTER, "ring_x", "ring_y", "vertex_ord", "x", "y"]
    sizes = representation_sizes(inside, segs)
    return {
        "outlines": tagged_union(
            {
                "cluster": close_rings(ordered.select(*columns), CLUSTER),
                "simplified": close_rings(simple.select(*columns), CLUSTER),
            }
        ),
        "pixels": inside,
        "sizes": representation_rows(sizes),
        "labels": representation_labels(sizes),
    }


def polygon_view(
    polygons: DataFrame, below: float | None = None, divisor: float = 10.0, criterion: DataFrame | None = None
) -> dict[str, DataFrame]:
    """Polygons, or those below a distance: counts per level, tiles, relative vertices, tile means, first vertices.

    ``criterion`` (``nb_clust, crit``) adds itself with the interval in which each level is clicked.
    """
    near = polygons if below is None else polygons.filter(F.col("y") < below)
    some = polygon_tiles(near, divisor)
    keys = ["nb_clust", "round_x", "round_y"]
    rel = relative_to_least(some, keys, ["x", "y"])
    tables = {
        "counts": polygon_counts(some),
        "polygons": rel,
        "tile_means": some.groupBy(*keys, "tile_id").agg(F.avg("iff").alias("mean_iff")),
        "first_extents": first_polygon_extents(rel),
    }
    if criterion is not None:
        tables["criterion"] = criterion.join(midpoint_intervals(criterion, "nb_clust"), "nb_clust")
    return tables


def volcano_view(
    pixels: DataFrame, band: int | None = None, below: int | None = None, per_unit: float = LOGFC_PER_UNIT
) -> dict[str, DataFrame]:
    """Pixels linked to a volcano plot by pixel name, with the outlines of the clusters they show.

    ``band`` bounds the distance of the two bins, ``below`` the greatest bin; without them
    all pixels are in.
    """
    near = pixels if band is None else pixels.filter(F.col("region2") < F.col("region1") + band)
    if below is not None:
        near = near.filter(F.col("region2") < below)
    named = coarse_volcano_bins(pixel_name(with_p(near)), per_unit)
    drawn = named.select("chr", "region1", "region2", "r1r2", "logfc", "sign_neg_log10_p")
    return {
        "pixels": named,
        "corners": corners(drawn, 0.5),
        "volcano_heat": tooltip(volcano_heat(named)),
        "color_scale": color_scale(named, per_unit),
        "first": diagonal_pixels(named.select("chr", "region1", "region2", "r1r2")),
        "outlines": visible_outlines(pixels, near),
    }


def visible_outlines(pixels: DataFrame, shown_pixels: DataFrame) -> DataFrame:
    """Whole outlines of just the clusters that have a pixel among those shown."""
    return outlines(rows_for_keys(pixels, shown_pixels.filter("clust IS NOT NULL"), CLUSTER), CLUSTER)


def axis_view(pixels: DataFrame, width: float = 100.0, half: float = PIXEL_HALF) -> dict[str, DataFrame]:
    """Pixels on tiles of the unrotated axes, with rings around pixels and tiles."""
    tiled = axis_tile(with_p(pixels), width)
    keys = ["chr", "round_r1r2", "round_region1", "round_region2"]
    drawn = tiled.select(
        *keys, "r1r2", "rel_regions", "region1", "region2", "logfc", "neg_log10_p"
    )
    tiles = cut(tile_summary(tiled, keys), "tiles")
    return {
        "pixels": tiled,
        "corners": axis_relative_corners(corners(drawn, half, closed=True)),
        "tiles": tiles,
        "tile_corners": tile_corners(tiles, width * half),
        "spacing": tile_spacing(tiled),
        "outlines": axis_tile_outlines(tiled),
    }


def axis_tile_outlines(tiled: DataFrame) -> DataFrame:
    """Outlines of the clusters, each within every axis tile that it has pixels in."""
    return outlines(tiled, [*CLUSTER, "round_r1r2"])


def closed_pixel_rings(pixels: DataFrame, half: float = 0.4) -> DataFrame:
    """A closed ring of five corners inside each pixel's square, for borders that don't touch."""
    return corners(pixels, half, closed=True)


def pixel_name(df: DataFrame) -> DataFrame:
    """``r1r2``: the pixel's two bins as text."""
    return df.withColumn(
        "r1r2", pair_text(F.col("region1").cast("string"), F.col("region2").cast("string"), "-")
    )
