"""Nearest-neighbour joins of a cloud with itself.

All return qi, qintensity, rank (from 1), idx, d2, intensity; neighbours exclude the query by
its ordinal and come in the order of geometry.NEIGHBOUR_ORDER, a total order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.geometry import NEIGHBOUR_ORDER, cells, shell_bound, squared_distance
from plumbline.functions.runtime import cut, global_rank, stored
from plumbline.operators.kdjoin import knn_kd, knn_lists, listed
from plumbline.operators.shells import shells
from plumbline.schema import ApproxConfig

RESULT = ("qi", "qintensity", "rank", "idx", "d2", "intensity")
SAMPLES = 1024
PERCENTILE = 0.6
#: Queries of cells with fewer candidates than so many times k try the next shell, where the result has to be proven.
PROVEN_RATIO = (27, 1)


def queries_of(points: DataFrame) -> DataFrame:
    return points.select(F.col("idx").alias("qi"), *[F.col(c).alias(f"q{c}") for c in "xyz"], F.col("intensity").alias("qintensity"))


def _top(pairs: DataFrame, k: int, *carry: str) -> DataFrame:
    """The first k of each query's candidates."""
    pairs = pairs.withColumn("d2", squared_distance())
    order = Window.partitionBy("qi").orderBy(*NEIGHBOUR_ORDER)
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(*RESULT, *carry)


def knn_brute(points: DataFrame, k: int, queries: DataFrame | None = None) -> DataFrame:
    """Every query against every point: for small clouds, and to test the others."""
    queries = queries_of(points) if queries is None else queries
    return _top(queries.join(points, F.col("qi") != F.col("idx")), k)


def _near_cells(queries: DataFrame, radius: int) -> DataFrame:
    """A row per query and cell within the radius: cx, cy, cz."""
    steps = F.array(*[F.lit(d).cast("long") for d in range(-radius, radius + 1)])
    for c in "xyz":
        queries = queries.withColumn(f"_d{c}", F.explode(steps)).withColumn(f"c{c}", F.col(f"qc{c}") + F.col(f"_d{c}"))
    return queries


def knn_exact(points: DataFrame, k: int, queries: DataFrame | None = None) -> DataFrame:
    """Exact neighbours over a partition that follows the points' density (see kdjoin)."""
    return knn_kd(points, k, queries_of(points) if queries is None else queries)


def exact_lists(points: DataFrame, k: int, queries: DataFrame | None = None) -> DataFrame:
    """knn_exact with a row per query: qi, qintensity, near (idx, d2, intensity)."""
    return knn_lists(points, k, queries_of(points) if queries is None else queries)


def knn_grid(points: DataFrame, k: int, cell_size: float | None = None, radii: tuple[int, ...] = (1,), queries: DataFrame | None = None) -> DataFrame:
    """Exact neighbours by joins on grid cells, in DataFrame functions only.

    A query is settled when its k-th distance lies strictly within the cube of cells looked
    at; the others go on with the next radius and then with cells of twice the size, until
    a cube holds the whole cloud. The result does not depend on the cell size.
    """
    size = cell_size or choose_cell_size(points, k)
    row = points.agg(*[f(c) for c in "xyz" for f in (F.min, F.max)]).first()
    extent = float(max((row[2 * i + 1] or 0) - (row[2 * i] or 0) + 1 for i in range(3)))
    left = queries_of(points) if queries is None else queries
    done: list[DataFrame] = []
    rounds = [(size, r) for r in radii]
    while True:
        size, radius = rounds.pop(0) if rounds else (size * 2, 1)
        grid = points.withColumns(cells(size))
        asked = left.withColumns(cells(size, "q")).withColumn("bound", shell_bound(size, radius))
        pairs = _near_cells(asked, radius).join(grid, ["cx", "cy", "cz"]).filter("qi <> idx")
        top = _top(pairs, k, "bound")
        whole = Window.partitionBy("qi")
        top = top.withColumns({"found": F.count("*").over(whole), "far": F.max("d2").over(whole)})
        last = size * radius > 2 * extent
        settled = F.lit(True) if last else (F.col("found") >= k) & (F.col("far") < F.col("bound") * F.col("bound"))
        top = cut(top.filter(settled).select(*RESULT))
        done.append(top)
        if last:
            break
        left = left.join(top.filter("rank = 1").select("qi"), "qi", "left_anti")
        left = cut(left)
        if left.isEmpty():
            break
    return reduce(DataFrame.unionByName, done)


def kth_distances(points: DataFrame, k: int, n: int) -> DataFrame:
    """idx, d2: exact distance to the k-th neighbour of the sampled points."""
    spark = points.sparkSession
    s = min(n, SAMPLES)
    chosen = spark.range(s).select(F.expr(f"id * {n} div {s}").alias("qi")).distinct()
    asked = queries_of(points).join(F.broadcast(chosen), "qi")  # at most SAMPLES rows
    near = knn_exact(points, k, asked)
    return near.filter(F.col("rank") == k).select(F.col("qi").alias("idx"), "d2")


def choose_cell_size(points: DataFrame, k: int) -> float:
    """The 60th percentile of the sampled points' k-th distances; 1 where that is not positive."""
    n = points.count()
    found = kth_distances(points, k, n).agg(F.sort_array(F.collect_list(F.sqrt(F.col("d2").cast("double")))).alias("a")).first()["a"]
    if not found:
        return 1.0
    size = found[min(int(PERCENTILE * len(found)), len(found) - 1)]
    return size if size > 0 else 1.0


def knn_approx_shell(points: DataFrame, k: int, config: ApproxConfig | None = None, cell_size: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(neighbours, flags qi, radius, found, fallback): candidates from shells of cells, exact search where they are too few (see shells)."""
    near, flags = shell_lists(points, k, config, cell_size)
    return listed(near), flags


def shell_lists(points: DataFrame, k: int, config: ApproxConfig | None = None, cell_size: float | None = None) -> tuple[DataFrame, DataFrame]:
    """knn_approx_shell with a row per query: qi, qintensity, near (idx, d2, intensity)."""
    found = stored(_shells(points, k, config, cell_size))
    rest = found.filter("fallback").select("qi", "qx", "qy", "qz", "qintensity")
    near = found.filter("not fallback").select("qi", "qintensity", "near")
    if not rest.isEmpty():
        near = near.unionByName(knn_lists(points, k, rest))
    return near, found.select("qi", "radius", "found", "fallback")


def _shells(points: DataFrame, k: int, config: ApproxConfig | None = None, cell_size: float | None = None) -> DataFrame:
    return shells(points, k, cell_size or choose_cell_size(points, k), config or ApproxConfig())


def knn_proven(points: DataFrame, k: int) -> DataFrame:
    """Exact neighbours (see proven_lists)."""
    return listed(proven_lists(points, k))


def proven_lists(points: DataFrame, k: int) -> DataFrame:
    """Exact neighbours from shells of the heuristic cell size where the k-th distance lies strictly within the cube of
    cells looked at, which proves them; exact search for the other queries."""
    size = choose_cell_size(points, k)
    asked = _shells(points, k, ApproxConfig(True, True, PROVEN_RATIO, (5, 4)), size).withColumns(cells(size, "q"))
    bound = F.when(F.col("radius") == 0, shell_bound(size, 0)).when(F.col("radius") == 1, shell_bound(size, 1)).otherwise(shell_bound(size, 2))
    far = F.try_element_at("near", F.lit(-1))["d2"]
    found = stored(asked.withColumn("proven", ~F.col("fallback") & (far < bound * bound)).withColumn("near", F.when(F.col("proven"), F.col("near"))).drop("qcx", "qcy", "qcz"))
    rest = found.filter("not coalesce(proven, false)").select("qi", "qx", "qy", "qz", "qintensity")
    near = found.filter("proven").select("qi", "qintensity", "near")
    return near if rest.isEmpty() else near.unionByName(knn_lists(points, k, rest))


#: FIXED VALUES: the direction of the seeded projection, as single-precision numbers.
DIRECTION = (-0.8771215, -0.31968367, 0.3584135)


def knn_projection(points: DataFrame, k: int, n: int | None = None, direction: tuple[float, float, float] = DIRECTION) -> DataFrame:
    """The k nearest among the points within half of W = min(n, 3 k + 1) places along a line."""
    n = points.count() if n is None else n
    half = min(n, 3 * k + 1) // 2
    along = sum((F.col(c).cast("float") * F.lit(v).cast("float") for c, v in zip("yz", direction[1:], strict=True)), F.col("x").cast("float") * F.lit(direction[0]).cast("float"))
    placed = cut(global_rank(points.withColumn("proj", along.cast("float")), "proj", "idx"))
    asked = placed.select(F.col("idx").alias("qi"), *[F.col(c).alias(f"q{c}") for c in "xyz"], F.col("intensity").alias("qintensity"), F.explode(F.sequence(F.col("pos") - half, F.col("pos") + half)).alias("pos"))
    return _top(asked.join(placed.drop("proj"), "pos").filter("qi <> idx"), k)
