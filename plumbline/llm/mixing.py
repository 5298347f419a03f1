"""4. Mixing sources to target weights, in DataFrame functions only.

Every document gets a hash-random key (MD5 of seed and doc_id). Keys are split into ranges
within each source, each range is sorted, and sums of token counts run within a range and
over the ranges' totals: a distributed prefix sum. A source's budget is cut in that order
at the exact word; budgets above a source's size repeat whole epochs first.

Ranges per source follow its share of the rows, so the number of ranges follows the
cluster's parallelism and a source with a third of all rows spreads over a third of them.

Targets: sources in code-point order (null last) weigh 1, 2, 3, repeating, and share all
words; a target stops at `cap` times its source's size and the excess is shared again by
weight among the others until none is above.

Defined results: null text has size 0 and is never taken; a null source is a source of its
own; a null doc_id's key comes from the text, so null ids spread over the ranges; documents with
equal keys (equal ids) are ordered by size and then by what they hold (see `common.ties_of`), so
only rows that are alike can change places and every partitioning gives the same mix; very long
texts count as their words; an empty table gives an empty result; extra columns, whatever their
names, are kept by `mix` and ignored by `plan_mix`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.common import TIE_COLUMNS, cut, hashable, parallelism, ties_of, words_count

SEED = "mix-1"
CAP = 3
#: Hex digits of the key that say its range: 16**4 ranges at most for each source.
RANGE_DIGITS = 4


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = CAP) -> DataFrame:
    """source, n, source_size, weight, target from one row per source (source, n, source_size).

    Ranks come from a sort over several tasks and its tasks' row counts, so any number of
    sources goes. Each round of sharing is one aggregation of which one row is collected.
    """
    ordered = cut(sizes.orderBy(F.col("source").asc_nulls_last()).withColumn("_m", F.monotonically_increasing_id()))
    part, place = F.shiftright("_m", 33), F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    parts = ordered.groupBy(part.alias("_p")).agg(F.count("*").alias("_c"))
    before = parts.select("_p", (F.sum("_c").over(Window.orderBy("_p")) - F.col("_c")).alias("_b"))  # a row per sorted task
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.pmod("_rank", F.lit(len(weights))) + 1).cast("int"))
    ranked = ordered.withColumn("_p", part).join(F.broadcast(before), "_p").withColumn("_rank", F.col("_b") + place)
    ranked = cut(ranked.select("source", "n", "source_size", w.cast("long").alias("weight")))
    full = F.lit(cap) * F.col("source_size")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    capped, left, weight = -1, total, ranked.agg(F.sum("weight")).first()[0] or 1
    while True:
        rate = left / weight
        over = F.col("weight") * F.lit(rate) > full
        row = ranked.agg(F.count_if(over), F.sum(F.when(over, full)), F.sum(F.when(~over, F.col("weight")))).first()
        if row[0] == capped or not row[2]:
            break
        capped, left, weight = row[0], total - (row[1] or 0), row[2]
    return ranked.withColumn("target", F.when(over, full.cast("double")).otherwise(F.col("weight") * F.lit(rate)))


def _planned(docs: DataFrame, keep: list[Column], weights: tuple[int, ...], cap: int, seed: str) -> DataFrame:
    """One row per document: _id, _size, _source_size, _target, _taken and _row, a struct of the columns keep (c0, c1 and so on).

    One struct and not a column each: aliases of all the columns that _tie hashes would double the optimizer's
    constraints with every column.
    """
    spark = docs.sparkSession
    ident = F.when(F.col("doc_id").isNull(), F.concat(F.lit("null:"), F.md5(F.coalesce("text", F.lit(""))))).otherwise(F.col("doc_id").cast("string"))
    known = [F.col(f"`{c}`") for c in TIE_COLUMNS if c in {x.lower() for x in docs.columns}]
    ta, tb = ties_of(known, [F.col(f"`{f.name}`") for f in docs.schema if hashable(f)])
    rows = docs.select(
        F.col("doc_id").alias("_id"), F.col("source").alias("_source"), words_count(F.col("text")).alias("_size"),
        F.md5(F.concat(F.lit(seed + ":"), ident)).alias("_key"), F.struct(ta, tb).alias("_tie"),
        F.struct(*[c.alias(f"c{i}") for i, c in enumerate(keep)]).alias("_row") if keep else F.lit(None).cast("int").alias("_row"),
    )
    sizes = rows.groupBy(F.col("_source").alias("source")).agg(F.count("*").alias("n"), F.sum("_size").alias("source_size"))
    targets = source_targets(sizes, weights, cap)
    total = targets.agg(F.sum("n")).first()[0] or 1

    wanted = F.ceil(F.col("n") * F.lit(8 * parallelism(spark)) / F.lit(total))
    budget = F.floor("target").cast("long")
    targets = cut(
        targets.select(
            F.col("source").alias("_s"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), F.least(wanted, F.lit(16**RANGE_DIGITS)).alias("_ranges"),
            F.when(F.col("source_size") > 0, F.expr("cast(floor(target) as bigint) div source_size")).otherwise(F.lit(0)).alias("_epochs"),
            budget.alias("_budget"),
        )
    )
    rows = rows.join(targets, F.col("_source").eqNullSafe(F.col("_s")))
    rows = rows.withColumn("_range", F.expr(f"(conv(substring(_key, 1, {RANGE_DIGITS}), 16, 10) * _ranges) div {16**RANGE_DIGITS}")).drop("_ranges")
    totals = rows.groupBy("_s", "_range").agg(F.sum("_size").alias("_t"))
    earlier = totals.select("_s", "_range", (F.sum("_t").over(Window.partitionBy("_s").orderBy("_range")) - F.col("_t")).alias("_base"))
    within = Window.partitionBy("_s", "_range").orderBy("_key", "_size", "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_run", F.sum("_size").over(within) - F.col("_size"))
    e = earlier.select(F.col("_s").alias("_es"), F.col("_range").alias("_er"), "_base")
    rows = rows.join(e, F.col("_s").eqNullSafe(F.col("_es")) & (F.col("_range") == F.col("_er")))
    rest = F.col("_budget") - F.col("_epochs") * F.col("_source_size")
    part: Column = F.greatest(F.lit(0), F.least(F.col("_size"), rest - F.col("_base") - F.col("_run")))
    return rows.select("_id", "_size", "_source_size", "_target", (F.col("_epochs") * F.col("_size") + part).cast("long").alias("_taken"), "_row")


def plan_mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = CAP, seed: str = SEED) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken."""
    return _planned(docs, [], weights, cap, seed).drop("_row").toDF("doc_id", "size", "source_size", "target", "taken")


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = CAP, seed: str = SEED) -> DataFrame:
    """The mix itself, columns of docs: a row per epoch in which a document is taken whole; where a source's
    budget ends within a document, that copy has the words up to there, joined by single spaces."""
    cols = docs.columns
    plan = _planned(docs, [F.col(f"`{c}`") for c in cols], weights, cap, seed).filter("_taken > 0")
    of = lambda c: F.col("_row")[f"c{cols.index(c)}"]
    text = of("text")
    whole = F.expr("cast(_taken div _size as int)")
    cut_words = F.expr("cast(_taken % _size as int)")
    copies = plan.withColumn("_copy", F.explode(F.concat(F.array_repeat(F.lit(-1), whole), F.when(cut_words > 0, F.array(cut_words)).otherwise(F.array().cast("array<int>")))))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    partial = F.array_join(F.slice(words, 1, F.col("_copy")), " ")
    out = copies.withColumn("_text", F.when(F.col("_copy") > 0, partial).otherwise(text))
    made = {"text": F.col("_text")}
    if "n_chars" in cols:
        made["n_chars"] = F.when(F.col("_copy") > 0, F.char_length("_text").cast(docs.schema["n_chars"].dataType)).otherwise(of("n_chars"))
    return out.select(*[made.get(c, of(c)).alias(c) for c in cols])


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan_mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null:' || md5(coalesce(text, '')))) AS key
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1 AS BIGINT) AS weight
  FROM d GROUP BY source
), o AS (
  SELECT *, row_number() OVER (ORDER BY 3.0 * source_size / weight, source) AS r,
         sum(3 * source_size) OVER (ORDER BY 3.0 * source_size / weight, source ROWS UNBOUNDED PRECEDING) - 3 * source_size AS capped,
         sum(weight) OVER () - sum(weight) OVER (ORDER BY 3.0 * source_size / weight, source ROWS UNBOUNDED PRECEDING) + weight AS left_weight,
         sum(source_size) OVER () AS total
  FROM s
), c AS (
  SELECT arg_min(CAST(total - capped AS DOUBLE) / left_weight, r) FILTER (WHERE CAST(total - capped AS DOUBLE) / left_weight * weight <= 3 * source_size) AS rate FROM o
), t AS (
  SELECT source, source_size, CASE WHEN weight * rate > 3 * source_size THEN CAST(3 * source_size AS DOUBLE) ELSE weight * rate END AS target FROM s, c
), p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS budget,
         CASE WHEN t.source_size > 0 THEN CAST(floor(t.target) AS BIGINT) // t.source_size ELSE 0 END AS epochs,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.size ROWS UNBOUNDED PRECEDING) - d.size AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, budget - epochs * source_size - before)) AS BIGINT) AS taken
FROM p
"""
