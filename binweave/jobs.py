"""Jobs: read a table, write the tables of one view.

    python -m binweave.jobs linked --pixels /data/px --chr chr1 --out /data/view
    python -m binweave.jobs missing --format tsv --pixels pixels_chr19_50000.tsv --out /data/missing
"""

from __future__ import annotations

import argparse
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binweave.plans.views import (
    axis_view,
    linked_tables,
    missing_report,
    outline_report,
    polygon_view,
    volcano_view,
    write_linked_view,
)
from binweave.sinks.chunks import audit_chunks, chunk_files, write_chunks
from binweave.sources.tables import read_criterion, read_listing, read_partitioned, read_pixels, read_polygons

# Selectors by which the tables of each job are chunked; tables not named go to one folder.
# The linked view brings its own.
JOB_CHUNKS: dict[str, dict[str, Sequence[str]]] = {
    "linked": {},
    "volcano": {"pixels": ["chr", "volcano_bin"]},
    "axis": {"corners": ["chr", "round_r1r2"], "pixels": ["chr", "round_r1r2"]},
    "missing": {"missing": ["chr"], "runs": ["chr"]},
    "outlines": {"outlines": ["chr", "data_type"]},
    "polygons": {"polygons": ["nb_clust", "tile_id"], "tile_means": ["nb_clust"]},
    "audit": {},
}


def build(spark: SparkSession, args: argparse.Namespace) -> Mapping[str, DataFrame]:
    if args.job == "audit":
        files = chunk_files(spark, args.chunks, args.pattern)
        if args.base:
            # Listings name files relative to a folder.
            files = files.withColumn("name", F.regexp_replace("name", f"^.*{re.escape(args.base)}/?", ""))
        return {"audit": audit_chunks(files, read_listing(spark, args.listing))}
    if args.job == "polygons":
        criterion = read_criterion(spark, args.criterion) if args.criterion else None
        return polygon_view(read_polygons(spark, args.polygons), args.below, criterion=criterion)
    if args.format == "tsv":
        if args.resolution is not None:
            raise SystemExit("--resolution applies to parquet folders only: a TSV file holds one")
        pixels = read_pixels(spark, args.pixels)
        if args.chr:
            pixels = pixels.filter(F.col("chr").isin(args.chr))
    else:
        pixels = read_partitioned(spark, args.pixels, args.chr, args.resolution)
    match args.job:
        case "linked":
            return linked_tables(pixels, args.greatest, log2_tiles=args.log2_tiles)
        case "volcano":
            return volcano_view(pixels, args.band, args.greatest)
        case "axis":
            return axis_view(pixels, args.width)
        case "missing":
            return missing_report(pixels, args.max_distance)
        case _:
            return outline_report(pixels, args.low, args.high)


def parse(argv: Sequence[str] | None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="binweave.jobs", description=__doc__)
    jobs = parser.add_subparsers(dest="job", required=True)
    commands = {name: jobs.add_parser(name) for name in JOB_CHUNKS}
    for name, command in commands.items():
        command.add_argument("--out", required=True)
        command.add_argument("--scratch", help="shared folder for intermediate tables")
        if name not in ("polygons", "audit"):
            command.add_argument("--pixels", required=True, help="TSV files or a partitioned folder")
            command.add_argument("--format", choices=["parquet", "tsv"], default="parquet")
            command.add_argument("--chr", action="append", help="chromosome; may be repeated")
            command.add_argument("--resolution", type=int)
    commands["linked"].add_argument("--greatest", type=int, help="greatest bin kept")
    commands["linked"].add_argument("--log2-tiles", action="store_true")
    commands["volcano"].add_argument("--band", type=int, help="distance of bins kept; all without it")
    commands["volcano"].add_argument("--greatest", type=int)
    commands["axis"].add_argument("--width", type=float, default=100.0)
    commands["missing"].add_argument("--max-distance", type=int)
    commands["outlines"].add_argument("--low", type=float, required=True)
    commands["outlines"].add_argument("--high", type=float, required=True)
    commands["polygons"].add_argument("--polygons", required=True)
    commands["polygons"].add_argument("--below", type=float, help="distance kept; all without it")
    commands["polygons"].add_argument("--criterion", help="TSV file of levels and their criterion")
    commands["audit"].add_argument("--chunks", required=True, help="folder of the chunk files")
    commands["audit"].add_argument("--listing", required=True, help="TSV file of bytes and names")
    commands["audit"].add_argument("--pattern", default="*.csv")
    commands["audit"].add_argument("--base", help="folder the listed names are relative to")
    return parser.parse_args(argv)


def main(argv: Sequence[str] | None = None) -> None:
    args = parse(argv)
    builder = SparkSession.builder.appName(f"binweave {args.job}")
    if args.scratch:
        builder = builder.config("spark.checkpoint.dir", args.scratch)
    spark = builder.getOrCreate()
    tables = build(spark, args)
    if args.job == "linked":
        return write_linked_view(tables, args.out)
    for name, df in tables.items():
        write_chunks(df, JOB_CHUNKS[args.job].get(name, []), f"{args.out}/{name}")


if __name__ == "__main__":
    main()
