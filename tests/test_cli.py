"""The command line, sinks, and the metrics it prints."""

import json

import pytest

from plumbline import cli
from plumbline.operators import equalize, kmeans, knn
from plumbline.sources.points import generate_points, read_points_text
from plumbline.sources.sinks import write_parquet, write_text


@pytest.fixture
def quiet(monkeypatch):
    """main() takes the tests' session."""
    return cli.main


def test_generate_run_and_compare(spark, tmp_path, capsys):
    source = tmp_path / "in.txt"
    assert cli.main(["generate", "--n", "200", "--k", "5", "--T", "4", "--output", str(source), "--seed", "3"]) == 0
    lines = source.read_text().splitlines()
    assert lines[0] == "200 5 4" and len(lines) == 201 and len(set(lines[1:])) == 200
    again = tmp_path / "again.txt"
    cli.main(["generate", "--n", "200", "--k", "5", "--T", "4", "--output", str(again), "--seed", "3"])
    assert again.read_text() == source.read_text()
    assert cli.main(["--validate", "--stats", str(source), str(tmp_path / "out")]) == 0
    assert {"cell_size", "cells", "fallback_points"} == {x.split("=")[0] for x in capsys.readouterr().err.split() if "=" in x}
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["approx_knn.txt", "kmeans.txt", "knn.txt"]
    assert cli.main(["--one-file", str(source), str(tmp_path / "one")]) == 0
    assert len(list((tmp_path / "one" / "knn.txt").glob("part-*"))) == 1
    points, params, _ = read_points_text(spark, str(source))
    want = [f"{x.x_text} {x.y_text} {x.z_text} {x.new_intensity}" for x in equalize.exact(points, params.k).orderBy("idx").collect()]
    for folder in ("out", "one"):
        parts = sorted((tmp_path / folder / "knn.txt").glob("part-*"))
        assert "".join(p.read_text() for p in parts).splitlines() == want
    capsys.readouterr()
    assert cli.main(["mae", str(tmp_path / "out" / "knn.txt"), str(tmp_path / "one" / "knn.txt")]) == 0
    assert float(capsys.readouterr().out) == 0.0
    cli.main(["mae", str(tmp_path / "out" / "knn.txt"), str(tmp_path / "out" / "kmeans.txt")])
    a, b = (read_values(tmp_path / "out" / n) for n in ("knn.txt", "kmeans.txt"))
    assert float(capsys.readouterr().out) == pytest.approx(sum(abs(x - y) for x, y in zip(a, b, strict=True)) / len(a))


def read_values(folder):
    return [int(x.split()[3]) for p in sorted(folder.glob("part-*")) for x in p.read_text().splitlines()]


def test_bad_input_is_reported(spark, tmp_path, capsys):
    (tmp_path / "in.txt").write_text("100001 1 1\n")
    assert cli.main([str(tmp_path / "in.txt")]) == 1
    assert "100001" in capsys.readouterr().err


def test_benchmark_prints_one_line_of_metrics(spark, tmp_path, capsys):
    cli.main(["generate", "--n", "80", "--k", "4", "--T", "3", "--output", str(tmp_path / "in.txt")])
    cli.main(["--benchmark", "--warmups", "0", "--repeats", "1", str(tmp_path / "in.txt")])
    got = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert (got["n"], got["k"], got["T"], got["warmups"], got["repeats"]) == (80, 4, 3, 0, 1)
    assert got["knn_mismatch_count"] == got["kmeans_mismatch_count"] == 0 and got["knn_mae"] == 0.0
    assert got["kmeans_changed_counts"][0] == 80 and len(got["kmeans_changed_counts"]) == got["kmeans_steps"]
    assert got["knn_speedup_end_to_end"] == pytest.approx(got["knn_baseline_ms"] / got["knn_end_to_end_ms"], rel=1e-3)
    assert got["approx_fallback_count"] >= 0 and got["approx_vs_exact_mae"] >= 0 and got["cells"] > 0
    cli.main(["--benchmark-engine-only", "--warmups", "0", "--repeats", "1", str(tmp_path / "in.txt")])
    less = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert set(less) < set(got) and "knn_baseline_ms" not in less


def test_median_is_the_upper_one():
    assert cli.median([4.0, 1.0, 3.0, 2.0]) == 3.0 and cli.median([5.0]) == 5.0


def test_validate_tells_wrong_results(spark):
    points = generate_points(spark, 60, 2)
    params = cli.Params(3, 2)
    good = equalize.exact(points, 3)
    assert cli.validate(points, "knn", params, good)
    assert not cli.validate(points, "knn", params, good.withColumn("new_intensity", good.new_intensity + 1))


def test_sinks_keep_the_order_of_the_input(spark, tmp_path):
    points = generate_points(spark, 300, 4)
    result = equalize.whole(points)
    write_text(result.repartition(5), str(tmp_path / "t"))
    got = [x for p in sorted((tmp_path / "t").glob("part-*")) for x in p.read_text().splitlines()]
    assert got == [f"{r.x} {r.y} {r.z} {r.new_intensity}" for r in result.orderBy("idx").collect()]
    write_parquet(result, str(tmp_path / "p"))
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "p")).collect())) == sorted(map(str, result.collect()))


def test_steps_of_clustering(spark):
    cloud = lambda rows: spark.createDataFrame([(i, *r, 0) for i, r in enumerate(rows)], "idx long, x long, y long, z long, intensity int")
    cases = [([(0, 0, 0), (4, 0, 0), (2, 0, 0)], 2, 1, 1), ([(3, 3, 3)], 1, 5, 2), ([(0, 0, 0), (9, 9, 9)], 2, 5, 2), ([(-1, 0, 0), (50, 0, 0), (0, 0, 0), (0, -1, 0)], 2, 10, 2)]
    for rows, k, t, steps in cases:
        found = kmeans.kmeans(cloud(rows), k, t)
        assert found.steps == steps
        moved = kmeans.changed_counts(cloud(rows), found.history)
        assert moved[0] == len(rows) and (moved[-1] == 0) == (steps > 1)


def test_neighbours_of_queries_that_fall_back(spark):
    rows = [(i % 4, i // 4 % 4, i // 16, i * 7 % 256) for i in range(64)] + [(5000, 5000, 5000, 9), (-7000, 0, 9000, 8)]
    points = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "idx long, x long, y long, z long, intensity int")
    near, flags = knn.knn_approx_shell(points, 4)
    fell = {r.qi for r in flags.filter("fallback").collect()}
    assert {64, 65} <= fell
    want = sorted(map(tuple, knn.knn_brute(points, 4).collect()))
    assert sorted(t for t in map(tuple, near.collect()) if t[0] in fell) == [t for t in want if t[0] in fell]
