"""Fixed cases with known answers, and every named query against DuckDB on the smallest tables."""

import math
import random

import duckdb
import pytest

from plumbline.operators import equalize, kdjoin, knn, shells
from plumbline.functions.remap import level_table
from plumbline.operators.kmeans import kmeans
from plumbline.plans.catalog import ORACLE_SQL, QUERIES
from plumbline.sources.points import generate_points, read_points_text
from plumbline.streaming import equalize_stream

SF = "/root/testdata/sf0.001"


def cloud(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "idx long, x long, y long, z long, intensity int")


def levels(df):
    return [r.new_intensity for r in df.orderBy("idx").collect()]


@pytest.mark.parametrize(
    ("k", "rows", "expected"),
    [
        (1, [(0, 0, 0, 100), (1, 0, 0, 200), (-1, 0, 0, 50), (0, 40, 0, 10)], [255, 255, 0, 0]),
        (2, [(0, 0, 0, 100), (1, 0, 0, 50), (-1, 0, 0, 200)], [127, 0, 255]),
        (1, [(0, 0, 0, 10), (5, 0, 0, 200), (5, 1, 0, 90)], [0, 255, 0]),
        (2, [(0, 0, 0, 77), (1, 0, 0, 77), (2, 0, 0, 77)], [77, 77, 77]),
    ],
)
def test_knn_cases(spark, k, rows, expected):
    assert levels(equalize.exact(cloud(spark, rows), k)) == expected


def test_tie_on_a_cell_face(spark):
    points = cloud(spark, [(2, 2, 3, 100), (4, 2, 3, 10), (2, 2, 5, 200)])
    assert levels(equalize.from_neighbours(knn.knn_grid(points, 1, 5.0), points)) == levels(equalize.exact(points, 1)) == [0, 0, 255]


@pytest.mark.parametrize(
    ("k", "t", "rows", "clusters", "centroids", "expected"),
    [
        (2, 1, [(0, 0, 0, 10), (4, 0, 0, 200), (2, 0, 0, 100)], [0, 1, 0], [(1, 0, 0), (4, 0, 0)], [0, 200, 255]),
        (2, 1, [(4, 0, 0, 200), (0, 0, 0, 10), (2, 0, 0, 100)], [0, 1, 1], [(4, 0, 0), (1, 0, 0)], [200, 0, 255]),
        (1, 5, [(3, 3, 3, 42)], [0], [(3, 3, 3)], [42]),
        (2, 5, [(0, 0, 0, 5), (9, 9, 9, 250)], [0, 1], [(0, 0, 0), (9, 9, 9)], [5, 250]),
        (2, 10, [(-1, 0, 0, 10), (50, 0, 0, 20), (0, 0, 0, 30), (0, -1, 0, 40)], [0, 1, 0, 0], [(0, 0, 0), (50, 0, 0)], [0, 20, 127, 255]),
    ],
)
def test_kmeans_cases(spark, k, t, rows, clusters, centroids, expected):
    points = cloud(spark, rows)
    found = kmeans(points, k, t)
    assert [r.cluster for r in found.assigned.orderBy("idx").collect()] == clusters
    assert [(c.x, c.y, c.z) for c in found.centroids] == centroids
    assert levels(equalize.clusters(points, k, t)) == expected


CLOUDS = {
    "uniform": lambda r, i: tuple(r.randint(-10_000, 10_000) for _ in range(3)),
    "lattice": lambda r, i: (i % 7, i // 7 % 7, i // 49),
    "one place": lambda r, i: (5, 5, 5),
    "few places": lambda r, i: (r.randint(0, 2), 0, r.randint(0, 1)),
    "clump and outliers": lambda r, i: (10**9, -(10**8), i) if i % 97 == 0 else tuple(int(r.gauss(0, 20)) for _ in range(3)),
    "line": lambda r, i: (i * i, 3, 3),
}


@pytest.mark.parametrize("name", CLOUDS)
def test_partition_equals_brute_force(spark, name, monkeypatch):
    r = random.Random(7)
    points = cloud(spark, [(*CLOUDS[name](r, i), i % 256) for i in range(350)])
    want = sorted(map(tuple, knn.knn_brute(points, 6).collect()))
    assert sorted(map(tuple, knn.knn_exact(points, 6).collect())) == want
    for leaf, inner, sample in ((40, 8, 65_536), (10, 4, 90)):
        monkeypatch.setattr(kdjoin, "LEAF", leaf)
        monkeypatch.setattr(kdjoin, "INNER", inner)
        monkeypatch.setattr(kdjoin, "SAMPLE", sample)
        assert sorted(map(tuple, knn.knn_exact(points.repartition(3), 6).collect())) == want


def test_partition_with_queries_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(kdjoin, "LEAF", 30)
    points = generate_points(spark, 300, 5)
    queries = spark.createDataFrame([(-1, 99_999, 0, 0, 1), (7, 0, 0, 0, 2), (1000, -5, 10_000, 3, 3)], "qi long, qx long, qy long, qz long, qintensity int")
    want = sorted(map(tuple, knn.knn_brute(points, 5, queries).collect()))
    assert len(want) == 15 and sorted(map(tuple, knn.knn_exact(points, 5, queries).collect())) == want
    assert knn.knn_exact(points.filter("false"), 5, queries).count() == knn.knn_exact(points, 5, queries.filter("false")).count() == 0


def test_fewer_points_than_neighbours(spark):
    points = cloud(spark, [(0, 0, 0, 1), (1, 0, 0, 2), (5, 0, 0, 3)])
    assert sorted(map(tuple, knn.knn_exact(points, 9).collect())) == sorted(map(tuple, knn.knn_brute(points, 9).collect()))


def test_wide_clouds_are_refused(spark):
    with pytest.raises(ValueError, match="span"):
        knn.knn_exact(cloud(spark, [(-(2**31), 0, 0, 1), (2**31 - 1, 0, 0, 2)]), 1)


def test_grid_equals_brute_force(spark):
    points = generate_points(spark, 300, 5)
    want = sorted(map(tuple, knn.knn_brute(points, 4).collect()))
    for size in (None, 700.0, 9000.0):
        assert sorted(map(tuple, knn.knn_grid(points.repartition(3), 4, cell_size=size).collect())) == want


def test_shell_falls_back(spark):
    rows = [(i % 4, i // 4 % 4, i // 16, i * 7 % 256) for i in range(64)] + [(5000, 5000, 5000, 9), (-7000, 0, 9000, 8)]
    points = cloud(spark, rows)
    near, flags = knn.knn_approx_shell(points, 4)
    assert flags.filter("fallback").count() >= 2
    assert near.groupBy("qi").count().filter("count = 4").count() == len(rows)


def shells_brute(rows, k, size):
    """(qi, neighbours in order) and (qi, radius, found) as SURVEY says, pair by pair."""
    cell = [tuple(math.floor(c * (1.0 / size)) for c in r[:3]) for r in rows]
    near, flags = [], []
    for i, q in enumerate(rows):
        ring = [max(abs(a - b) for a, b in zip(cell[i], c, strict=True)) for c in cell]
        least, used, radius = -(-5 * k // 4), {0}, 0
        for r in (1, 2):
            if sum(x in used for x in ring) - 1 < least:
                used, radius = used | {r}, r
        mine = sorted((sum((a - b) ** 2 for a, b in zip(q[:3], p[:3], strict=True)), *p[:3], j) for j, p in enumerate(rows) if j != i and ring[j] in used)
        flags.append((i, radius, len(mine), len(mine) < k))
        if len(mine) >= k:
            near += [(i, rank, x[4], x[0]) for rank, x in enumerate(mine[:k], 1)]
    return near, flags


@pytest.mark.parametrize("name", CLOUDS)
def test_shells_and_proven_make_no_row_per_cell(spark, name, monkeypatch):
    """Shells by leaves of cells equal the plain definition, and what they prove is exact, without a row per query and cell looked at."""
    monkeypatch.setattr(knn, "_near_cells", None)
    monkeypatch.setattr(shells, "SMALL_LEAF", 20)
    r = random.Random(8)
    rows = [(*CLOUDS[name](r, i), i % 256) for i in range(250)]
    points = cloud(spark, rows)
    size = knn.choose_cell_size(points, 4)
    for n in (size, size * 2.3):
        want, flags = shells_brute(rows, 4, n)
        near, got = knn.knn_approx_shell(points.repartition(3), 4, cell_size=n)
        fell = {f[0] for f in flags if f[3]}
        assert sorted(map(tuple, got.collect())) == flags
        assert sorted((x.qi, x["rank"], x.idx, x.d2) for x in near.collect() if x.qi not in fell) == want
    assert sorted(map(tuple, knn.knn_proven(points, 4).collect())) == sorted(map(tuple, knn.knn_brute(points, 4).collect()))


@pytest.mark.parametrize("text", ["0 1 1\n", "100001 1 1\n", "2 0 1\n0 0 0 1\n1 0 0 2\n", "200 129 1\n", "2 1 0\n0 0 0 1\n1 0 0 2\n", "2 1 1\n1e12 0 0 1\n1 0 0 2\n", "2 1 1\ninf 0 0 1\n1 0 0 2\n", "2 1 1\n0 0 0 -1\n1 0 0 2\n", "x y z\n", "",  "3 1 1\n0 0 0 1\n1 0 0 2\n", "2 2 1\n0 0 0 1\n1 0 0 2\n", "2 1 51\n0 0 0 1\n1 0 0 2\n", "2 1 1\n1.5 0 0 1\n1 0 0 2\n", "2 1 1\nabc 0 0 1\n1 0 0 2\n", "2 1 1\n0 0 0 256\n1 0 0 2\n"])
def test_bad_files(spark, tmp_path, text):
    (tmp_path / "in.txt").write_text(text)
    with pytest.raises(Exception):  # noqa: B017
        read_points_text(spark, str(tmp_path / "in.txt"))[0].collect()


def test_stream_of_points_takes_a_batch_run_s_levels(spark, tmp_path):
    points = generate_points(spark, 200, 6)
    found = kmeans(points, 4, 5)
    table = level_table(found.assigned, "cluster")
    points.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(points.schema).parquet(str(tmp_path / "in"))
    q = equalize_stream(stream, found.history[-1], table).writeStream.format("memory").queryName("levels").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r.idx, r.cluster, r.new_intensity) for r in spark.table("levels").collect())
    assert got == sorted((r.idx, r.cluster, r.new_intensity) for r in equalize.from_groups(found.assigned, "cluster").collect())


def test_text_file(spark, tmp_path):
    (tmp_path / "in.txt").write_text("2 1 3\n1.0 -2 3e1 7\n4 5 6 8\nrest\n")
    points, params, n = read_points_text(spark, str(tmp_path / "in.txt"))
    assert (params.k, params.t, n) == (1, 3, 2)
    assert [tuple(r)[:5] for r in points.orderBy("idx").collect()] == [(0, 1, -2, 30, 7), (1, 4, 5, 6, 8)]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    rel = con.sql(ORACLE_SQL[name])
    at = [rel.columns.index(c) for c in cols]
    assert sorted(map(str, map(tuple, df.select(cols).collect()))) == sorted(str(tuple(r[i] for i in at)) for r in rel.fetchall())
