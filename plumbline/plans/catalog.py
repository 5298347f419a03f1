"""The named queries, on the cloud derived from `events`, and SQL for DuckDB with the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions.geometry import cells
from plumbline.functions.remap import level_table
from plumbline.functions.runtime import global_rank
from plumbline.operators import compare, equalize, knn
from plumbline.operators import kmeans as km
from plumbline.sources.points import EVENTS_SQL, points_from_events
from plumbline.sources.sinks import lines

K = 16
K_SHELL = 16
CLUSTERS, STEPS = 16, 5
CELL = 1500.0

Query = Callable[[SparkSession, str], DataFrame]
POINTS_CTE = f"p AS ({EVENTS_SQL.format(events='events')})"


def _on_points(make: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: make(points_from_events(spark, sf_dir))


def _near_columns(near: DataFrame) -> DataFrame:
    return near.select(F.col("qi").alias("idx"), F.col("rank").cast("long").alias("rank"), F.col("idx").alias("neighbor"), "d2")


def _result(df: DataFrame) -> DataFrame:
    return df.select("idx", "x", "y", "z", "new_intensity")


def _centroids(points: DataFrame) -> DataFrame:
    found = km.kmeans(points, CLUSTERS, STEPS)
    return points.sparkSession.createDataFrame([(s.c, s.x, s.y, s.z) for s in found.centroids], "c long, x long, y long, z long")


def _cluster_stats(points: DataFrame) -> DataFrame:
    table = level_table(km.kmeans(points, CLUSTERS, STEPS).assigned, "cluster")
    return table.select("cluster", "intensity", "cnt", "cdf", "cdf_min", "m", "new_intensity")


def _inertia(points: DataFrame) -> DataFrame:
    found = km.kmeans(points, CLUSTERS, STEPS).assigned
    return found.groupBy("cluster").agg(F.count("*").alias("size"), F.sum("x").alias("sum_x"), F.sum("y").alias("sum_y"), F.sum("z").alias("sum_z"))


def _shell_vs_exact(points: DataFrame) -> DataFrame:
    return compare.compare(equalize.exact(points, K_SHELL), equalize.approximate(points, K_SHELL))


def _text_lines(points: DataFrame) -> DataFrame:
    return lines(equalize.whole(points)).select("idx", F.col("value").alias("line"))


def _cdf(points: DataFrame) -> DataFrame:
    table = level_table(points.withColumn("g", F.lit(0)), "g")
    return table.select("intensity", "cnt", "cdf", "cdf_min", "m")


def _ring(points: DataFrame) -> DataFrame:
    grid = points.withColumns(cells(CELL)).groupBy("cx", "cy", "cz").agg(F.count("*").alias("cnt"))
    w = Window.partitionBy("cx").orderBy(F.desc("cnt"), "cy", "cz")
    return grid.withColumn("r", F.row_number().over(w).cast("long")).filter("r <= 3")


def _by_cell(points: DataFrame) -> DataFrame:
    """Points in the order of their cells, which lays neighbours side by side."""
    return global_rank(points.withColumns(cells(CELL)), "cx", "cy", "cz", "idx").select("pos", "idx", "cx", "cy", "cz")


def _local_histogram(points: DataFrame) -> DataFrame:
    """How often each level comes among a point and its neighbours."""
    near = knn.knn_exact(points, K).select(F.col("qi").alias("idx"), "intensity").unionByName(points.select("idx", "intensity"))
    return near.groupBy("idx", "intensity").agg(F.count("*").alias("cnt"))


def _changed(points: DataFrame) -> DataFrame:
    counts = km.changed_counts(points, km.kmeans(points, CLUSTERS, STEPS).history)
    return points.sparkSession.createDataFrame([*enumerate(counts, 1)], "step long, changed long")


QUERIES: dict[str, Query] = {
    "points_scan": _on_points(lambda p: p),
    "points_filter_intensity": _on_points(lambda p: p.filter("intensity >= 200")),
    "cell_assign": _on_points(lambda p: p.select("idx", *[c.alias(n) for n, c in cells(CELL).items()])),
    "cell_histogram": _on_points(lambda p: p.withColumns(cells(CELL)).groupBy("cx", "cy", "cz").agg(F.count("*").alias("cnt"))),
    "cell_top_buckets": _on_points(_ring),
    "grid_bounds": _on_points(lambda p: p.withColumns(cells(CELL)).agg(*[f(c).alias(f"{f.__name__}_{c}") for c in ("cx", "cy", "cz") for f in (F.min, F.max)])),
    "global_histogram_cdf": _on_points(_cdf),
    "global_equalize": _on_points(lambda p: _result(equalize.whole(p))),
    "text_sink_lines": _on_points(_text_lines),
    "cell_size_heuristic": _on_points(lambda p: p.sparkSession.createDataFrame([(knn.choose_cell_size(p, K_SHELL),)], "cell_size double")),
    "knn_kth_distance": _on_points(lambda p: knn.knn_exact(p, K).filter(F.col("rank") == K).select(F.col("qi").alias("idx"), "d2")),
    "knn_exact_neighbors": _on_points(lambda p: _near_columns(knn.knn_exact(p, K))),
    "knn_exact_equalize": _on_points(lambda p: _result(equalize.exact(p, K))),
    "knn_proven_equalize": _on_points(lambda p: _result(equalize.approximate(p, K_SHELL, "proven"))),
    "knn_approx_shell_equalize": _on_points(lambda p: _result(equalize.approximate(p, K_SHELL))),
    "knn_approx_fallback_flags": _on_points(lambda p: knn.knn_approx_shell(p, K_SHELL)[1].select(F.col("qi").alias("idx"), F.col("radius").cast("long").alias("radius"), "found", "fallback")),
    "knn_approx_projection_equalize": _on_points(lambda p: _result(equalize.approximate(p, K, "projection"))),
    "cell_sorted_points": _on_points(_by_cell),
    "knn_local_histogram": _on_points(_local_histogram),
    "knn_fallback_count": _on_points(lambda p: knn.knn_approx_shell(p, K_SHELL)[1].agg(F.count_if("fallback").alias("fallback_points"), F.count("*").alias("points"))),
    "kmeans_changed_counts": _on_points(_changed),
    "kmeans_assign": _on_points(lambda p: km.kmeans(p, CLUSTERS, STEPS).assigned.select("idx", "cluster")),
    "kmeans_centroids": _on_points(_centroids),
    "kmeans_cluster_sums": _on_points(_inertia),
    "kmeans_cluster_stats": _on_points(_cluster_stats),
    "kmeans_equalize": _on_points(lambda p: _result(equalize.clusters(p, CLUSTERS, STEPS))),
    "approx_vs_exact_report": _on_points(_shell_vs_exact),
}

# --- SQL ---------------------------------------------------------------------------------

_D2 = "(q.x - c.x) * (q.x - c.x) + (q.y - c.y) * (q.y - c.y) + (q.z - c.z) * (q.z - c.z)"
_NEW = "CAST(CASE WHEN m = lo THEN intensity ELSE greatest(0, least(255, (le - lo) * 255 // (m - lo))) END AS INT)"


def _cells_sql(size: str) -> str:
    return ", ".join(f"CAST(floor(CAST({c} AS DOUBLE) * (1.0::DOUBLE / {size})) AS BIGINT) AS c{c}" for c in "xyz")


def _exact_sql(k: int, queries: str = "p") -> str:
    """CTE near: idx, intensity, ns (list of the k nearest as structs)."""
    return f"""near AS (
  SELECT q.idx, q.intensity, min(row({_D2}, c.x, c.y, c.z, c.idx, c.intensity), {k}) AS ns
  FROM {queries} q JOIN p c ON q.idx <> c.idx GROUP BY q.idx, q.intensity
), flat AS (
  SELECT idx, intensity, n[1] AS d2, n[5] AS neighbor, n[6] AS level, rank
  FROM (SELECT idx, intensity, unnest(ns) AS n, unnest(range(1, len(ns) + 1)) AS rank FROM near)
)"""


def _levels_sql(source: str = "flat", m: str | None = None) -> str:
    """CTE done: idx, new_intensity from rows idx, intensity (the centre's), level."""
    return f"""around AS (
  SELECT idx, intensity, level FROM {source} UNION ALL SELECT idx, intensity, intensity FROM (SELECT DISTINCT idx, intensity FROM {source})
), low AS (SELECT idx, min(level) AS l FROM around GROUP BY idx
), stats AS (
  SELECT a.idx, any_value(a.intensity) AS intensity, {m or 'count(*)'} AS m, count(*) FILTER (WHERE level = l) AS lo, count(*) FILTER (WHERE level <= intensity) AS le
  FROM around a JOIN low ON a.idx = low.idx GROUP BY a.idx
), done AS (SELECT idx, {_NEW} AS new_intensity FROM stats)"""


_TAIL = "SELECT p.idx, p.x, p.y, p.z, coalesce(done.new_intensity, p.intensity) AS new_intensity FROM p LEFT JOIN done ON p.idx = done.idx"


def _table_sql(source: str, group: str) -> str:
    return f"""hist AS (SELECT {group}, intensity, CAST(count(*) AS BIGINT) AS cnt FROM {source} GROUP BY 1, 2
), cum AS (
  SELECT *, CAST(sum(cnt) OVER w AS BIGINT) AS le, first_value(cnt) OVER w AS lo, CAST(sum(cnt) OVER (PARTITION BY {group}) AS BIGINT) AS m
  FROM hist WINDOW w AS (PARTITION BY {group} ORDER BY intensity ROWS UNBOUNDED PRECEDING)
), levels AS (SELECT {group}, intensity, cnt, le, lo, m, {_NEW} AS new_intensity FROM cum)"""


def _kmeans_sql() -> str:
    """CTEs c0..cT and a1..aT, unrolled; empty clusters keep their centroids."""
    out = [f"c0 AS (SELECT idx AS c, x, y, z FROM p WHERE idx < {CLUSTERS})"]
    for i in range(1, STEPS + 1):
        out.append(f"a{i} AS (SELECT p.idx, any_value(p.x) AS x, any_value(p.y) AS y, any_value(p.z) AS z, any_value(p.intensity) AS intensity, arg_min(q.c, row({_D2.replace('c.', 'p.')}, q.x, q.y, q.z, q.c)) AS cluster FROM p, c{i - 1} q GROUP BY p.idx)")
        mean = ", ".join(f"CAST(coalesce(u.{v}, o.{v}) AS BIGINT) AS {v}" for v in "xyz")
        sums = ", ".join(f"CAST(sum({v}) AS BIGINT) // count(*) AS {v}" for v in "xyz")
        out.append(f"c{i} AS (SELECT o.c, {mean} FROM c{i - 1} o LEFT JOIN (SELECT cluster, {sums} FROM a{i} GROUP BY cluster) u ON o.c = u.cluster)")
    return ", ".join(out)


def _size_sql(k: int) -> str:
    """CTE size: cell_size, the heuristic."""
    return f"""total AS (SELECT count(*) AS n, least(count(*), {knn.SAMPLES}) AS s FROM p
), asked AS (SELECT p.* FROM p JOIN (SELECT DISTINCT i * n // s AS idx FROM (SELECT unnest(range(s)) AS i, n, s FROM total)) u ON p.idx = u.idx
), kth AS (
  SELECT q.idx, sqrt(CAST(max(d) AS DOUBLE)) AS r FROM (
    SELECT q.idx, unnest(min({_D2}, {k})) AS d FROM asked q JOIN p c ON q.idx <> c.idx GROUP BY q.idx) q GROUP BY q.idx
), size AS (
  SELECT CASE WHEN v > 0 THEN v ELSE 1.0::DOUBLE END AS cell_size
  FROM (SELECT r AS v, row_number() OVER (ORDER BY r) AS i, count(*) OVER () AS s FROM kth) WHERE i = least(CAST(floor(0.6::DOUBLE * s) AS BIGINT) + 1, s)
)"""


def _shell_sql(k: int) -> str:
    """CTEs flags and flat, as the shell search."""
    need = (5 * k + 3) // 4
    ring = "greatest(abs(q.cx - c.cx), abs(q.cy - c.cy), abs(q.cz - c.cz))"
    return f"""{_size_sql(k)}, g AS (SELECT p.*, {_cells_sql('size.cell_size')} FROM p, size
), cand AS (
  SELECT q.idx, q.intensity, {ring} AS ring, row({_D2}, c.x, c.y, c.z, c.idx, c.intensity) AS r
  FROM g q JOIN g c ON q.idx <> c.idx AND {ring} <= 2
), counts AS (
  SELECT g.idx, count(ring) FILTER (WHERE ring = 0) AS c0, count(ring) FILTER (WHERE ring <= 1) AS c1, count(ring) AS c2 FROM g LEFT JOIN cand ON g.idx = cand.idx GROUP BY g.idx
), flags AS (
  SELECT idx, CAST(CASE WHEN c0 >= {need} THEN 0 WHEN c1 >= {need} THEN 1 ELSE 2 END AS BIGINT) AS radius,
         CASE WHEN c0 >= {need} THEN c0 WHEN c1 >= {need} THEN c1 ELSE c2 END AS found FROM counts
), few AS (SELECT p.* FROM p JOIN flags ON p.idx = flags.idx WHERE found < {k}
), near AS (
  SELECT cand.idx, intensity, min(r, {k}) AS ns FROM cand JOIN flags ON cand.idx = flags.idx WHERE ring <= radius AND found >= {k} GROUP BY cand.idx, intensity
  UNION ALL
  SELECT q.idx, q.intensity, min(row({_D2}, c.x, c.y, c.z, c.idx, c.intensity), {k}) FROM few q JOIN p c ON q.idx <> c.idx GROUP BY q.idx, q.intensity
), flat AS (SELECT idx, intensity, n[6] AS level FROM (SELECT idx, intensity, unnest(ns) AS n FROM near))"""


def _projection_sql(k: int) -> str:
    a, b, c = knn.DIRECTION
    return f"""placed AS (
  SELECT *, row_number() OVER (ORDER BY CAST(x AS FLOAT) * CAST({a} AS FLOAT) + CAST(y AS FLOAT) * CAST({b} AS FLOAT) + CAST(z AS FLOAT) * CAST({c} AS FLOAT), idx) - 1 AS pos,
         least(count(*) OVER (), {3 * k + 1}) // 2 AS half FROM p
), near AS (
  SELECT q.idx, q.intensity, min(row({_D2}, c.x, c.y, c.z, c.idx, c.intensity), {k}) AS ns
  FROM placed q JOIN placed c ON c.pos BETWEEN q.pos - q.half AND q.pos + q.half AND q.idx <> c.idx GROUP BY q.idx, q.intensity
), flat AS (SELECT idx, intensity, n[6] AS level FROM (SELECT idx, intensity, unnest(ns) AS n FROM near))"""


def _with(*parts: str) -> str:
    body, last = parts[:-1], parts[-1]
    return f"WITH {', '.join((POINTS_CTE, *body))} {last}"


_CLUSTERED = f"c AS (SELECT idx, x, y, z, intensity, cluster FROM a{STEPS})"
_EXACT_DONE = _levels_sql()
_FROM_LEVELS = "SELECT c.idx, c.x, c.y, c.z, l.new_intensity FROM c JOIN levels l ON c.cluster = l.cluster AND c.intensity = l.intensity"
_WHOLE = "c AS (SELECT *, 0 AS cluster FROM p)"

ORACLE_SQL: dict[str, str] = {
    "points_scan": _with("SELECT idx, x, y, z, intensity FROM p"),
    "points_filter_intensity": _with("SELECT idx, x, y, z, intensity FROM p WHERE intensity >= 200"),
    "cell_assign": _with(f"SELECT idx, {_cells_sql(f'{CELL}::DOUBLE')} FROM p"),
    "cell_histogram": _with(f"SELECT cx, cy, cz, CAST(count(*) AS BIGINT) AS cnt FROM (SELECT {_cells_sql(f'{CELL}::DOUBLE')} FROM p) GROUP BY cx, cy, cz"),
    "cell_top_buckets": _with(
        f"h AS (SELECT cx, cy, cz, CAST(count(*) AS BIGINT) AS cnt FROM (SELECT {_cells_sql(f'{CELL}::DOUBLE')} FROM p) GROUP BY cx, cy, cz)",
        "SELECT cx, cy, cz, cnt, CAST(r AS BIGINT) AS r FROM (SELECT *, row_number() OVER (PARTITION BY cx ORDER BY cnt DESC, cy, cz) AS r FROM h) WHERE r <= 3",
    ),
    "grid_bounds": _with(f"g AS (SELECT {_cells_sql(f'{CELL}::DOUBLE')} FROM p)", "SELECT " + ", ".join(f"{f}({c}) AS {f}_{c}" for c in ("cx", "cy", "cz") for f in ("min", "max")) + " FROM g"),
    "global_histogram_cdf": _with(_WHOLE, _table_sql("c", "cluster"), "SELECT intensity, cnt, le AS cdf, lo AS cdf_min, m FROM levels"),
    "global_equalize": _with(_WHOLE, _table_sql("c", "cluster"), _FROM_LEVELS),
    "text_sink_lines": _with(_WHOLE, _table_sql("c", "cluster"), f"SELECT idx, concat_ws(' ', x, y, z, new_intensity) AS line FROM ({_FROM_LEVELS})"),
    "cell_size_heuristic": _with(_size_sql(K_SHELL), "SELECT cell_size FROM size"),
    "knn_kth_distance": _with(_exact_sql(K), f"SELECT idx, d2 FROM flat WHERE rank = {K}"),
    "knn_exact_neighbors": _with(_exact_sql(K), "SELECT idx, CAST(rank AS BIGINT) AS rank, neighbor, d2 FROM flat"),
    "knn_exact_equalize": _with(_exact_sql(K), _EXACT_DONE, _TAIL),
    "knn_proven_equalize": _with(_exact_sql(K_SHELL), _EXACT_DONE, _TAIL),
    "knn_approx_shell_equalize": _with(_shell_sql(K_SHELL), _levels_sql(), _TAIL),
    "knn_approx_fallback_flags": _with(_shell_sql(K_SHELL), f"SELECT idx, radius, CAST(found AS BIGINT) AS found, found < {K_SHELL} AS fallback FROM flags"),
    "knn_approx_projection_equalize": _with(_projection_sql(K), _levels_sql(m=str(K + 1)), _TAIL),
    "cell_sorted_points": _with(f"g AS (SELECT idx, {_cells_sql(f'{CELL}::DOUBLE')} FROM p)", "SELECT CAST(row_number() OVER (ORDER BY cx, cy, cz, idx) - 1 AS BIGINT) AS pos, idx, cx, cy, cz FROM g"),
    "knn_local_histogram": _with(_exact_sql(K), "SELECT idx, level AS intensity, CAST(count(*) AS BIGINT) AS cnt FROM (SELECT idx, level FROM flat UNION ALL SELECT idx, intensity FROM p) GROUP BY ALL"),
    "knn_fallback_count": _with(_shell_sql(K_SHELL), f"SELECT CAST(count(*) FILTER (WHERE found < {K_SHELL}) AS BIGINT) AS fallback_points, CAST(count(*) AS BIGINT) AS points FROM flags"),
    "kmeans_changed_counts": _with(
        _kmeans_sql(),
        "SELECT CAST(1 AS BIGINT) AS step, CAST(count(*) AS BIGINT) AS changed FROM p"
        + "".join(f" UNION ALL SELECT {i}, count(*) FILTER (WHERE a.cluster <> b.cluster) FROM a{i - 1} a JOIN a{i} b ON a.idx = b.idx" for i in range(2, STEPS + 1)),
    ),
    "kmeans_assign": _with(_kmeans_sql(), f"SELECT idx, cluster FROM a{STEPS}"),
    "kmeans_centroids": _with(_kmeans_sql(), f"SELECT c, x, y, z FROM c{STEPS}"),
    "kmeans_cluster_sums": _with(_kmeans_sql(), f"SELECT cluster, CAST(count(*) AS BIGINT) AS size, {', '.join(f'CAST(sum({v}) AS BIGINT) AS sum_{v}' for v in 'xyz')} FROM a{STEPS} GROUP BY cluster"),
    "kmeans_cluster_stats": _with(_kmeans_sql(), _CLUSTERED, _table_sql("c", "cluster"), "SELECT cluster, intensity, cnt, le AS cdf, lo AS cdf_min, m, new_intensity FROM levels"),
    "kmeans_equalize": _with(_kmeans_sql(), _CLUSTERED, _table_sql("c", "cluster"), _FROM_LEVELS),
}
ORACLE_SQL["approx_vs_exact_report"] = f"""
SELECT avg(abs(e.new_intensity - a.new_intensity)) AS mae, CAST(max(abs(e.new_intensity - a.new_intensity)) AS INT) AS max_abs_error,
       CAST(count(*) FILTER (WHERE e.new_intensity <> a.new_intensity) AS BIGINT) AS mismatch_count
FROM ({ORACLE_SQL["knn_exact_equalize"]}) e JOIN ({ORACLE_SQL["knn_approx_shell_equalize"]}) a ON e.idx = a.idx
"""
