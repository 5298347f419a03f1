"""What the operators share: shared folders, row identity, skew-safe joins, components."""

from __future__ import annotations

import atexit
import contextlib
import gc
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A key with more than this share of the rows counts as hot; at most 1 / HOT_SHARE keys can be.
HOT_SHARE = 0.001
#: A side with more rows than this (a few MB of keys and counts) is shuffled, not broadcast.
BROADCAST_ROWS = 50_000

_own_dir: str | None = None
_app_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset.

    Ours is on this machine, so it is made for a local master only; a cluster has to name its shared folder.
    """
    global _own_dir
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        current = spark.sparkContext.getCheckpointDir()
        if current:
            return current
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        if _own_dir is None:
            _own_dir = tempfile.mkdtemp(prefix="plumbline-")
            atexit.register(shutil.rmtree, _own_dir, ignore_errors=True)
        base = "file://" + _own_dir
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return base


def new_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder name within this application's part of the shared folder, which goes when the application ends."""
    app = spark.sparkContext.applicationId
    if app not in _app_dirs:
        at = f"{shared_dir(spark).rstrip('/')}/plumbline-{app}"
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _app_dirs[app] = at
    return f"{_app_dirs[app]}/{name}-{uuid.uuid4().hex}"


def delete_dir(spark: SparkSession, path: str) -> None:
    """Removes a folder of ours through Hadoop's file system, wherever it is."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """The same rows with their lineage cut by a checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager)


def release(spark: SparkSession) -> None:
    """Lets finished phases' shuffle files go: Spark drops them when the JVM collects their plans."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, n: int):
    """While it holds, jobs send n rows at a time to Python."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(name)
    spark.conf.set(name, str(min(n, int(old)) if int(old) > 0 else n))
    try:
        yield
    finally:
        spark.conf.set(name, old)


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows of one doc_id are told apart by these columns first, so that extra columns do not say which of them stays.
TIE_COLUMNS = ("text", "source", "lang")


def hashable(field) -> bool:
    """Whether Spark hashes the column: no maps, no variants."""
    return "map<" not in field.dataType.simpleString() and "variant" not in field.dataType.simpleString()


def ties_of(known: list[Column], every: list[Column]) -> list[Column]:
    """_ta, _tb: hashes of the row's known and of all columns. They order rows of one doc_id by what they hold, as their
    files' names change from run to run; only rows that are alike are left to their places."""
    return [F.xxhash64(F.lit(0), *known).alias("_ta"), F.xxhash64(F.lit(0), *every).alias("_tb")]


class Identified:
    """Rows with a stable identity: df has _rf (a hash of the file's path), _rr (the place in that file), _file and the
    columns of the original as _c0, _c1 and so on, so that no name of theirs clashes with one of ours."""

    def __init__(self, df: DataFrame, names: list[str]):
        self.df, self.names = df, names

    def place(self, name: str) -> str:
        """What the original's column of that name (or of that name in other letters, where none has it exactly) is called here."""
        found = [i for i, n in enumerate(self.names) if n == name] or [i for i, n in enumerate(self.names) if n.lower() == name.lower()]
        if not found:
            raise ValueError(f"no column {name} among {self.names}")
        return f"_c{found[0]}"

    def col(self, name: str) -> Column:
        return F.col(self.place(name))

    def select(self, *names: str) -> DataFrame:
        """_rf, _rr and the columns of those names."""
        return self.df.select("_rf", "_rr", *[self.col(n).alias(n) for n in names])

    def ties(self) -> list[Column]:
        """_ta, _tb: see ties_of."""
        known = [self.col(n) for n in TIE_COLUMNS if n in {x.lower() for x in self.names}]
        return ties_of(known, [F.col(f.name) for f in self.df.schema if f.name in {f"_c{i}" for i in range(len(self.names))} and hashable(f)])

    def restore(self, df: DataFrame) -> DataFrame:
        """The original's columns, by their names, from rows of df."""
        return df.select(*[F.col(f"_c{i}").alias(n) for i, n in enumerate(self.names)])


def _from_files(df: DataFrame) -> bool:
    """Whether the rows are a selection of one read of files, each file listed once."""
    if any(c.lower() == "_metadata" for c in df.columns):
        return False
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias") and plan.deterministic():
        plan = plan.children().head()
    if not plan.nodeName().startswith("LogicalRelation") and "Relation" not in plan.nodeName():
        return False
    found = df._jdf.queryExecution().analyzed().metadataOutput().toString()
    if "_metadata" not in found or "row_index" not in df.select("_metadata").schema["_metadata"].dataType.names:
        return False
    files = list(df._jdf.inputFiles())
    return len(set(files)) == len(files)


def identified(df: DataFrame, at: str | None = None) -> Identified:
    """df's rows with their identity. Rows that are no plain selection from Parquet files are first written to the
    shared folder (any rows to `at` where it is given), so that a recomputed task sees the same identities."""
    names = list(df.columns)
    own = [f"_c{i}" for i in range(len(names))]
    if at or not _from_files(df):
        spark = df.sparkSession
        df = df.toDF(*own)
        at = at or new_dir(spark, "rows")
        df.write.parquet(at)
        df = spark.read.schema(df.schema).parquet(at)
    path = F.col("_metadata.file_path")
    return Identified(df.select("*", F.xxhash64(path), F.col("_metadata.row_index"), path).toDF(*own, "_rf", "_rr", "_file"), names)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package's sources to the executors once per application, for operators that run Python there."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    made = Path(tempfile.mkdtemp(prefix="plumbline-src-"))
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    at = made / "plumbline-src.zip"
    with zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(at))
    _shipped.add(app)


def words_count(text) -> F.Column:
    """Number of runs of anything but the six ASCII white-space characters."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def hot_join(left: DataFrame, right: DataFrame, keys: list[str], n: str, total: int, by: list[str], rows: int | None = None) -> DataFrame:
    """left inner-joined to right, which has one row per key and the key's number of left rows in column n.

    right is broadcast where it has at most BROADCAST_ROWS rows, counted here unless `rows` bounds them. Beyond that
    both sides are shuffled by key and salt: a key with over HOT_SHARE of all rows (at most
    1 / HOT_SHARE keys can have that) is dealt to as many salts as it has such shares.
    A row's salt is a hash of its columns `by` (its identity), so a recomputed task deals alike. right should
    be cut (checkpointed): it is read more than once.
    """
    if (right.count() if rows is None else rows) <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), keys)
    limit = max(1, int(total * HOT_SHARE))
    salts = F.ceil(F.col(n) / F.lit(limit)).cast("int")
    hot = right.filter(F.col(n) > limit).select(*keys, salts.alias("_salts"))
    spread = F.pmod(F.xxhash64(*by), F.coalesce("_salts", F.lit(1))).cast("int")
    dealt = left.join(F.broadcast(hot), keys, "left").withColumn("_salt", spread).drop("_salts")
    right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    return dealt.join(right, [*keys, "_salt"]).drop("_salt")


def _joined(pairs: DataFrame) -> DataFrame:
    """(node, root) of at most BROADCAST_ROWS pairs u, v: one task joins them."""
    ship(pairs.sparkSession)
    kind = pairs.schema["u"].dataType.simpleString()

    def join(batches):
        import pyarrow as pa

        root, kinds = {}, None

        def find(x):
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for batch in batches:
            kinds = batch.schema.types[:1] * 2
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                u, v = sorted((find(u), find(v)))
                root[v] = u
        if kinds:
            nodes = [x for x in root if find(x) != x]
            yield pa.RecordBatch.from_arrays([pa.array(nodes, kinds[0]), pa.array([find(x) for x in nodes], kinds[0])], names=["node", "root"])

    return pairs.coalesce(1).mapInArrow(join, f"node {kind}, root {kind}")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of links between numbers or strings of bytes: (node, root) of every node but the roots,
    a root being the smallest node reachable.

    At most BROADCAST_ROWS links, counted first, are joined by one task. More go through rounds that
    alternate the large-star and small-star steps of Kiveris et al. (2014): each is an
    aggregation with partial sums and a join, the edges never grow, and a round's result
    is checkpointed. Only a count per round reaches the driver.
    """
    pairs = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    pairs, spark = cut(pairs), links.sparkSession
    state, n = None, pairs.count()
    if n <= BROADCAST_ROWS:
        return cut(_joined(pairs.select("u", "v")))
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("_n")).withColumn("m", F.least("u", "m"))
        # a node of a large component has many neighbours: such joins deal it to salts
        large = hot_join(both, least, ["u"], "_n", 2 * n, ["v"], 2 * n).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        large = large.unionByName(least.filter("m < u").select("u", F.col("m").alias("v"))).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("_n"))
        small = hot_join(large, low, ["u"], "_n", 2 * n, ["v"], 2 * n).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        nxt = cut(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        row = nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.countDistinct("u")).first()
        if (row[0], row[1]) == state and row[0] == row[2]:
            break
        state, pairs, n = (row[0], row[1]), nxt, row[0]
        del both, least, large, low, small
        release(spark)
    return nxt.select(F.col("u").alias("node"), F.col("v").alias("root"))


FILTER_BITS = 1 << 25


def _filter_places(keys, bits: int):
    """Four positions for each of an array of unsigned 64-bit keys, one row per key."""
    import numpy as np

    from plumbline.llm.shingles import mix64

    return np.stack([(mix64(keys + np.uint64(i)) % np.uint64(bits)).astype(np.int64) for i in range(1, 5)], axis=1)


def key_filter(keys: DataFrame, bits: int = FILTER_BITS):
    """A Bloom filter of fixed size over one column of longs, broadcast to the executors.

    It only spares carrying rows that cannot match: when more keys come than it can tell
    apart it lets everything through and results stay the same. Its size is bits / 8 bytes
    (4 MiB) whatever the input.
    """
    import numpy as np
    import pyarrow as pa

    spark = keys.sparkSession
    ship(spark)

    def places(batches):
        for batch in batches:
            at = _filter_places(batch.column(0).to_numpy().view(np.uint64), bits)
            yield pa.RecordBatch.from_arrays([pa.array(at.reshape(-1))], names=["p"])

    at = keys.mapInArrow(places, "p long").selectExpr("p + 1 as p")
    pages = at.groupBy(F.expr("bitmap_bucket_number(p)").alias("b")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(p))").alias("m"))
    blob = bytearray(bits // 8)
    for b, m in pages.collect():  # at most bits / 32768 pages of 4096 bytes
        blob[(b - 1) * 4096 : b * 4096] = m
    return spark.sparkContext.broadcast(bytes(blob))


def may_hold(keys, blob: bytes):
    """Which of an array of unsigned 64-bit keys may be in the filter."""
    import numpy as np

    if not len(keys):
        return np.zeros(0, bool)
    bits, at = np.frombuffer(blob, np.uint8), _filter_places(keys, len(blob) * 8)
    return ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)
