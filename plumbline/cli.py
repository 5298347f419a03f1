"""python -m plumbline.cli [--validate] [--benchmark | --benchmark-engine-only] [--stats] [--one-file] [--warmups N] [--repeats N] INPUT [knn|approx_knn|kmeans|OUTPUT_DIR]
python -m plumbline.cli generate --n N --k K --T T --output FILE [--seed S]
python -m plumbline.cli mae FILE FILE
"""

from __future__ import annotations

import argparse
import os
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.geometry import cells
from plumbline.functions.runtime import cut, global_rank
from plumbline.operators import compare, equalize, kmeans, knn
from plumbline.schema import Params
from plumbline.sources import points as sources
from plumbline.sources import sinks

METHODS = ("knn", "approx_knn", "kmeans")


def run_method(points: DataFrame, method: str, params: Params) -> DataFrame:
    if method == "knn":
        return equalize.exact(points, params.k)
    if method == "approx_knn":
        return equalize.approximate(points, params.k)
    return equalize.clusters(points, params.k, params.t)


def validate(points: DataFrame, method: str, params: Params, result: DataFrame) -> bool:
    """Exact neighbours against brute force, approximate ones within the error bar, clusters against a second run on other partitions."""
    if method == "kmeans":
        other = run_method(points.repartition(3), method, params)
    else:
        other = equalize.from_neighbours(knn.knn_brute(points, params.k), points)
    row = compare.compare(other, result).first()
    return row["mae"] <= compare.APPROX_MAE if method == "approx_knn" else row["mismatch_count"] == 0


def median(values: list[float]) -> float:
    """The upper median."""
    return sorted(values)[len(values) // 2]


def _timed(warmups: int, repeats: int, work) -> tuple[float, DataFrame]:
    """(median milliseconds, the last result) of work, which makes a DataFrame that is then written."""
    times = []
    for i in range(warmups + repeats):
        began = time.perf_counter()
        result = cut(work())
        if i >= warmups:
            times.append((time.perf_counter() - began) * 1000)
    return median(times), result


def _compared(name: str, a: DataFrame, b: DataFrame) -> dict:
    row = compare.compare(a, b).first()
    return {f"{name}_mae": row["mae"], f"{name}_max_abs_error": row["max_abs_error"], f"{name}_mismatch_count": row["mismatch_count"]}


def benchmark(points: DataFrame, params: Params, n: int, warmups: int, repeats: int, baseline: bool = True) -> dict:
    """Milliseconds (medians) of each method and of its phases, the plain methods' where baseline asks for them, and differences.

    Phases: reading the input, the index (neighbours: the cell size; clusters: the centroids), the search or
    assignment ("compute"), and the whole. Plain are the join of all pairs and, for clusters, one task.
    """
    k, t = params.k, params.t
    cores = points.sparkSession.sparkContext.defaultParallelism
    out: dict = {"n": n, "k": k, "T": t, "baseline_tasks": 1, "engine_tasks": cores, "warmups": warmups, "repeats": repeats}
    began = time.perf_counter()
    points = cut(points)
    out["shared_input_ms"] = (time.perf_counter() - began) * 1000
    began = time.perf_counter()
    run_method(points, "knn", params).count()
    out["cold_start_ms"] = (time.perf_counter() - began) * 1000
    results = {}
    for method in METHODS:
        out[f"{method}_end_to_end_ms"], results[method] = _timed(warmups, repeats, lambda method=method: run_method(points, method, params))
    out["knn_compute_ms"], near = _timed(warmups, repeats, lambda: knn.knn_exact(points, k))
    began = time.perf_counter()
    size = knn.choose_cell_size(points, k)
    out["approx_preprocess_ms"] = (time.perf_counter() - began) * 1000
    out["approx_knn_compute_ms"], flags = _timed(warmups, repeats, lambda: knn.knn_approx_shell(points, k, cell_size=size)[1])
    clustering = kmeans.kmeans(points, k, t)
    out["kmeans_compute_ms"], _ = _timed(warmups, repeats, lambda: clustering.assigned)
    out["kmeans_steps"] = clustering.steps
    out["kmeans_changed_counts"] = kmeans.changed_counts(points, clustering.history)
    out["exact_phase_points"] = flags.filter("fallback").count()
    out["approx_fallback_count"] = out["exact_phase_points"]
    out["cell_size"] = size
    out["cells"] = cell_count(points, size)
    out |= _compared("approx_vs_exact", results["knn"], results["approx_knn"])
    if baseline:
        plain = {
            "knn": lambda: equalize.from_neighbours(knn.knn_brute(points, k), points),
            "kmeans": lambda: run_method(points.coalesce(1), "kmeans", params),
        }
        for method, work in plain.items():
            out[f"{method}_baseline_ms"], result = _timed(warmups, repeats, work)
            out[f"{method}_speedup_end_to_end"] = out[f"{method}_baseline_ms"] / out[f"{method}_end_to_end_ms"]
            out[f"{method}_speedup_compute_only"] = out[f"{method}_baseline_ms"] / out[f"{method}_compute_ms"]
            out |= _compared(method, result, results[method])
        for scope in ("end_to_end", "compute"):
            name = "approx_speedup_end_to_end_vs_exact_baseline" if scope == "end_to_end" else "approx_speedup_compute_only_vs_exact_baseline"
            out[name] = out["knn_baseline_ms"] / out[f"approx_knn_{scope}_ms"]
    return out


def cell_count(points: DataFrame, size: float) -> int:
    """Cells that hold a point."""
    return points.select(*[c.alias(n) for n, c in cells(size).items()]).distinct().count()


def read_result(spark: SparkSession, path: str) -> DataFrame:
    """A written result as idx, x, y, z (as text) and new_intensity."""
    t = F.split(F.trim("value"), r"\s+")
    rows = global_rank(sources.text_lines(spark, path), *sources.LINE_ORDER, name="idx")
    return rows.select("idx", *[F.get(t, i).alias(c) for i, c in enumerate("xyz")], F.get(t, 3).cast("int").alias("new_intensity"))


def main(argv: list[str] | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    spark = SparkSession.builder.appName("plumbline").getOrCreate()
    if argv[:1] == ["generate"]:
        p = argparse.ArgumentParser()
        for name, kind, default in (("n", int, 10), ("k", int, 1), ("T", int, 10), ("output", str, "input.txt"), ("seed", int, 42)):
            p.add_argument(f"--{name}", type=kind, default=default)
        a = p.parse_args(argv[1:])
        Params(a.k, a.T).check(a.n)
        made = sources.generate_points(spark, a.n, a.seed).orderBy("idx")
        with open(a.output, "w") as f:
            f.write(f"{a.n} {a.k} {a.T}\n")
            f.writelines(f"{r.x} {r.y} {r.z} {r.intensity}\n" for r in made.toLocalIterator())
        return 0
    if argv[:1] == ["mae"]:
        print(compare.compare(read_result(spark, argv[1]), read_result(spark, argv[2])).first()["mae"])
        return 0
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--validate", action="store_true")
    p.add_argument("--benchmark", action="store_true")
    p.add_argument("--benchmark-engine-only", action="store_true", help="without the plain methods")
    p.add_argument("--one-file", action="store_true", help="one text file by one task, not a folder in order")
    p.add_argument("--stats", action="store_true")
    p.add_argument("--warmups", type=int, default=1)
    p.add_argument("--repeats", type=int, default=3)
    p.add_argument("input")
    p.add_argument("where", nargs="?", default=".")
    a = p.parse_args(argv)
    methods = [a.where] if a.where in METHODS else list(METHODS)
    try:
        points, params, n = sources.read_points_text(spark, a.input, clusters=methods == ["kmeans"])
    except ValueError as e:
        print(e, file=sys.stderr)
        return 1
    if a.benchmark or a.benchmark_engine_only:
        print(sinks.metrics_json(benchmark(points, params, n, a.warmups, a.repeats, not a.benchmark_engine_only)))
        return 0
    if a.stats:
        size = knn.choose_cell_size(points, params.k)
        flags = knn.knn_approx_shell(points, params.k, cell_size=size)[1]
        print(f"cell_size={size} cells={cell_count(points, size)} fallback_points={flags.filter('fallback').count()}", file=sys.stderr)
    good = True
    for method in methods:
        result = cut(run_method(points, method, params))
        sinks.write_text(result, os.path.join("." if a.where in METHODS else a.where, sinks.OUTPUT_NAMES[method]), one_file=a.one_file)
        good &= not a.validate or validate(points, method, params, result)
    return 0 if good else 1


if __name__ == "__main__":
    sys.exit(main())
