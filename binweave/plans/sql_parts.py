"""SQL building blocks for the checks, written apart from the Spark code."""

from __future__ import annotations

PIXELS = """
sums AS (
  SELECT l_partkey AS region1, l_partkey + CAST(l_quantity AS BIGINT) - 1 AS region2,
         CAST(sum(l_orderkey * 7 + l_linenumber) AS BIGINT) AS s
  FROM lineitem GROUP BY 1, 2),
pixels AS (
  SELECT 'chr' || CAST(1 + region1 // 1000 AS VARCHAR) AS chr, region1, region2,
         CAST((region1 // 7) * 100 + (region2 - region1) // 6 AS INTEGER) AS clust,
         CAST(s % 81 - 40 AS DOUBLE) / 16 AS logfc,
         CAST(1 + s % 1000 AS DOUBLE) / 1000 AS p_value
  FROM sums)"""

ZERO_P = """
pixels_p0 AS (
  SELECT p.* REPLACE (CAST(s % 1000 AS DOUBLE) / 1000 AS p_value)
  FROM pixels p JOIN sums USING (region1, region2))"""

POLYGONS = """
polygons AS (
  SELECT l_linenumber AS nb_clust, l_orderkey AS id,
         l_partkey + CAST(l_quantity AS BIGINT) - 1 AS i, l_partkey AS j,
         CAST(l_partkey AS DOUBLE) AS x, l_quantity AS y, l_extendedprice AS iff
  FROM lineitem)"""

# Bins that restart on each of two chromosomes, and clusters that may be missing.
RESTARTING = """
rsums AS (
  SELECT l_linenumber % 2 AS m, l_partkey AS region1, l_partkey + CAST(l_quantity AS BIGINT) - 1 AS region2,
         CAST(sum(l_orderkey * 7 + l_linenumber) AS BIGINT) AS s
  FROM lineitem GROUP BY 1, 2, 3),
restarting AS (
  SELECT 'chr' || CAST(1 + m AS VARCHAR) AS chr, region1, region2,
         CASE WHEN s % 13 <> 0 THEN CAST((region1 // 7) * 100 + (region2 - region1) // 6 AS INTEGER) END AS clust,
         CAST(s % 81 - 40 AS DOUBLE) / 16 AS logfc, CAST(1 + s % 1000 AS DOUBLE) / 1000 AS p_value
  FROM rsums)"""

CRITERION = """
criterion AS (
  SELECT l_linenumber AS nb_clust, CAST(count(*) AS DOUBLE) AS crit
  FROM lineitem GROUP BY 1)"""


def with_p(source: str = "pixels") -> str:
    """``scored``: -log10 p and rotated coordinates."""
    return f"""
scored AS (
  SELECT *, 0e0 - log10(p_value) AS neg_log10_p,
         CAST(sign(logfc) AS DOUBLE) * (0e0 - log10(p_value)) + 0e0 AS sign_neg_log10_p,
         (region1 + region2) / 2e0 AS region_x, (region2 - region1) / 2e0 AS region_y
  FROM {source})"""


TILED = (
    with_p()
    + """,
rounded AS (
  SELECT *, round_even((region_x + 20e0) / 50e0, 0) * 50e0 + 0e0 AS round_region_x,
         round_even((region_y - 24e0) / 50e0, 0) * 50e0 + 0e0 AS round_region_y
  FROM scored),
tiled AS (
  SELECT *, region_x - round_region_x AS rel_region_x, region_y - round_region_y AS rel_region_y,
         CAST(CAST(round_region_x AS BIGINT) AS VARCHAR) || ',' ||
         CAST(CAST(round_region_y AS BIGINT) AS VARCHAR) AS round_regions
  FROM rounded)"""
)

AXIS_TILED = (
    with_p()
    + """,
axis_tiled AS (
  SELECT *, region1 - round_region1 AS rel_region1, region2 - round_region2 AS rel_region2,
         region1 || '-' || region2 AS r1r2,
         CAST(CAST(round_region1 AS BIGINT) AS VARCHAR) || '-' ||
         CAST(CAST(round_region2 AS BIGINT) AS VARCHAR) AS round_r1r2
  FROM (SELECT *, round_even(region1 * 0.01::DOUBLE, 0) / 0.01::DOUBLE + 0e0 AS round_region1,
               round_even(region2 * 0.01::DOUBLE, 0) / 0.01::DOUBLE + 0e0 AS round_region2
        FROM scored))"""
)


def number_text(x: str) -> str:
    """Plain text of a number with at most nine decimals."""
    return (
        f"CASE WHEN {x} = 'inf'::DOUBLE THEN 'Inf' WHEN {x} = '-inf'::DOUBLE THEN '-Inf' "
        f"ELSE regexp_replace(regexp_replace(printf('%.9f', {x}), '\\.?0+$', ''), '^-0$', '0') END"
    )


def volcano(source: str = "scored") -> str:
    """``binned``: volcano bins with their text."""
    return f"""
lnl AS (SELECT *, log10(neg_log10_p) AS lnl_p FROM {source}),
bins AS (
  SELECT *, round_even(logfc / 0.25::DOUBLE, 0) * 0.25::DOUBLE + 0e0 AS round_logfc,
         round_even(neg_log10_p / 5e0, 0) * 5e0 + 0e0 AS round_neg_log10_p,
         CASE WHEN isinf(lnl_p) THEN lnl_p ELSE
           round_even(lnl_p / 0.1::DOUBLE, 0) * 0.1::DOUBLE + 0e0 END AS round_lnl_p
  FROM lnl),
binned AS (
  SELECT *, 'logFC=' || {number_text('round_logfc')} || ' -log10(p)=' || {number_text('round_neg_log10_p')} AS volcano_bin,
         'logFC=' || {number_text('round_logfc')} || ' l-l(p)=' || {number_text('round_lnl_p')} AS lnl_bin
  FROM bins)"""


COARSE = f"""
coarse0 AS (
  SELECT *, round_even(logfc * 4e0, 0) / 4e0 + 0e0 AS round_logfc,
         round_even(neg_log10_p, 0) + 0e0 AS round_neg_log10_p
  FROM scored),
coarse AS (
  SELECT *, 'logFC=' || {number_text('round_logfc')} || ' -log10(p)=' || {number_text('round_neg_log10_p')} AS volcano_bin
  FROM coarse0)"""

CLUSTER_SIZES = """
sizes AS (
  SELECT chr, clust, count(*) AS pixels, count(DISTINCT round_regions) AS tiles,
         min(logfc) AS logfc_min, max(logfc) AS logfc_max,
         min(neg_log10_p) AS neg_log10_p_min, max(neg_log10_p) AS neg_log10_p_max
  FROM tiled GROUP BY chr, clust)"""

EXTENTS = """
corner_rows AS (
  SELECT t.*, c.corner_ord, region1 + c.d1 AS corner1, region2 + c.d2 AS corner2,
         ((region1 + c.d1) + (region2 + c.d2)) / 2e0 AS corner_x,
         ((region2 + c.d2) - (region1 + c.d1)) / 2e0 AS corner_y
  FROM tiled t CROSS JOIN (
    VALUES (1, -0.45::DOUBLE, -0.45::DOUBLE), (2, -0.45::DOUBLE, 0.45::DOUBLE),
           (3, 0.45::DOUBLE, 0.45::DOUBLE), (4, 0.45::DOUBLE, -0.45::DOUBLE),
           (5, -0.45::DOUBLE, -0.45::DOUBLE)) c(corner_ord, d1, d2)),
rel_corners AS (
  SELECT *, round_even(corner_x - round_region_x, 2) + 0e0 AS rel_corner_x,
         round_even(corner_y - round_region_y, 2) + 0e0 AS rel_corner_y
  FROM corner_rows),
extents AS (
  SELECT min(rel_corner_x) AS rel_corner_x_min, max(rel_corner_x) AS rel_corner_x_max,
         min(rel_corner_y) AS rel_corner_y_min, max(rel_corner_y) AS rel_corner_y_max
  FROM rel_corners)"""

# Side-to-side moves per dual cell code, doubled offsets.
MOVES = {
    "separate": "(6, 2, 1, 1, 0), (6, 0, 1, 1, 2), (9, 1, 0, 0, 1), (9, 1, 2, 2, 1)",
    "connect": "(6, 0, 1, 1, 0), (6, 2, 1, 1, 2), (9, 1, 0, 2, 1), (9, 1, 2, 0, 1)",
}


def segments(source: str, keys: str, saddle: str = "separate", name: str = "segs") -> str:
    """``segs``: directed outline segments in doubled coordinates."""
    return f"""
{name}_cells AS (
  SELECT {keys}, ca, cb, bit_or(bit) AS code FROM (
    SELECT {keys}, region1 AS ca, region2 AS cb, 1 AS bit FROM {source} UNION ALL
    SELECT {keys}, region1 - 1, region2, 2 FROM {source} UNION ALL
    SELECT {keys}, region1, region2 - 1, 4 FROM {source} UNION ALL
    SELECT {keys}, region1 - 1, region2 - 1, 8 FROM {source}) GROUP BY {keys}, ca, cb),
{name}_moves(code, a, b, c, d) AS (VALUES
  (1, 1, 0, 0, 1), (2, 2, 1, 1, 0), (3, 2, 1, 0, 1), (4, 0, 1, 1, 2), (5, 1, 0, 1, 2),
  (7, 2, 1, 1, 2), (8, 1, 2, 2, 1), (10, 1, 2, 1, 0), (11, 1, 2, 0, 1), (12, 0, 1, 2, 1),
  (13, 1, 0, 2, 1), (14, 0, 1, 1, 0), {MOVES[saddle]}),
{name} AS MATERIALIZED (
  SELECT {keys}, CAST(2 * ca + a AS BIGINT) AS x1, CAST(2 * cb + b AS BIGINT) AS y1,
         CAST(2 * ca + c AS BIGINT) AS x2, CAST(2 * cb + d AS BIGINT) AS y2
  FROM {name}_cells JOIN {name}_moves USING (code))"""


def vertices(keys: str, segs: str = "segs", name: str = "verts") -> str:
    """``verts``: each vertex with directions in and out."""
    return f"""
{name} AS MATERIALIZED (
  SELECT *, (in_dx <> out_dx) OR (in_dy <> out_dy) AS keep FROM (
    SELECT {keys}, x, y, max(nx) AS nx, max(ny) AS ny, max(in_dx) AS in_dx, max(in_dy) AS in_dy,
           max(out_dx) AS out_dx, max(out_dy) AS out_dy
    FROM (SELECT {keys}, x1 AS x, y1 AS y, x2 AS nx, y2 AS ny, CAST(NULL AS BIGINT) AS in_dx,
                 CAST(NULL AS BIGINT) AS in_dy, x2 - x1 AS out_dx, y2 - y1 AS out_dy FROM {segs}
          UNION ALL
          SELECT {keys}, x2, y2, NULL, NULL, x2 - x1, y2 - y1, NULL, NULL FROM {segs})
    GROUP BY {keys}, x, y))"""


def rings(keys: str, verts: str = "verts") -> str:
    """``ringed``: vertices in order along rings.

    A walk starts at every vertex and stops at a lesser one, so the walks that
    come back to their start are those of the least vertex of each ring.
    """
    names = [k.strip() for k in keys.split(",")]
    same = " AND ".join(f"w.{k} = v.{k}" for k in names)
    v_keys = ", ".join(f"v.{k}" for k in names)
    return f"""
walk AS (
  SELECT {keys}, x AS sx, y AS sy, x, y, nx, ny, keep, 0 AS ord FROM {verts}
  UNION ALL
  SELECT {v_keys}, w.sx, w.sy, v.x, v.y, v.nx, v.ny, v.keep, w.ord + 1
  FROM walk w JOIN {verts} v ON {same} AND v.x = w.nx AND v.y = w.ny
  WHERE v.x > w.sx OR (v.x = w.sx AND v.y > w.sy)),
back AS (SELECT {keys}, sx, sy FROM walk WHERE nx = sx AND ny = sy),
ringed AS (
  SELECT {', '.join('w.' + k for k in names)}, w.sx / 2e0 AS ring_x, w.sy / 2e0 AS ring_y,
         w.x / 2e0 AS x, w.y / 2e0 AS y, w.nx / 2e0 AS next_x, w.ny / 2e0 AS next_y,
         CAST(w.ord AS BIGINT) AS vertex_ord, w.keep,
         CASE WHEN w.keep THEN CAST(sum(CAST(w.keep AS INTEGER)) OVER (
           PARTITION BY {', '.join('w.' + k for k in names)}, w.sx, w.sy ORDER BY w.ord) - 1 AS BIGINT) END AS kept_ord
  FROM walk w JOIN back USING ({keys}, sx, sy))"""


def sql(*parts: str, recursive: bool = False) -> str:
    """Parts joined by commas, the last one being the final SELECT."""
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",".join(parts[:-1]) + "\n" + parts[-1].strip()
