"""3. URL filters: a temporal list join.

List entries are dated: an entry (a host suffix such as `example.org`, or a host with the
start of a path such as `example.org/ads`) is added or removed on a day. An entry's events
become validity intervals [from, until); a capture is joined as of its fetch time to the
entries that were active then.

A capture has one key for each host suffix and path prefix, so the join is by equality, with
the interval as its further condition. The intervals are broadcast where there are at most
common.BROADCAST_ROWS, counted first; beyond that both sides are shuffled by key and salt,
so a suffix that every capture has spreads over SALTS tasks. Matches are summed on the map
side before they meet their captures.

Defined results: a null or hostless url matches nothing; a null fetch time matches nothing;
an add while active and a remove while inactive change nothing; of events on one day the
removal counts last; repeated rows get a row each; empty tables give no rows or no matches;
extra columns, whatever their names, are ignored; a very long url has no more keys than the
deepest entry of the list asks for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.common import BROADCAST_ROWS, cut, identified

SALTS = 32
#: FIXED VALUES: the list of the named query, (entry, action, day).
LIST = (
    ("spam-farm.example.org", "add", "2024-02-01"), ("spam-farm.example.org", "remove", "2024-06-15"), ("spam-farm.example.org", "add", "2024-09-01"),
    ("example.net/en", "add", "2024-03-10"), ("m.ththth.example.net", "add", "2024-01-01"), ("m.ththth.example.net/en", "add", "2024-05-05"),
    ("example.com", "add", "2024-10-01"), ("example.com", "remove", "2024-11-20"), ("blog.ththan.example.net", "add", "2024-04-01"),
    ("blog.ththan.example.net", "remove", "2024-04-01"), ("thther.example.org/es", "add", "2024-07-04"),
)


def host_of(url: Column) -> Column:
    """The host in lower case, without user and port; empty where there is none."""
    h = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.regexp_replace(h, r"\.+$", "")


def keys_of(url: Column, labels: int = 1 << 30, depth: int = 1 << 30) -> Column:
    """array<string>: every suffix of the host, and each of them with every prefix of the path.

    With the most labels and path steps that a list's entries have, longer keys, which can match nothing, are left out.
    """
    host = host_of(url)
    parts = F.split(host, r"\.")
    first = F.greatest(F.lit(1), F.size(parts) - labels + 1)
    suffixes = F.transform(F.sequence(first, F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    path = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    steps = F.filter(F.split(path, "/"), lambda s: s != "")
    most = F.least(F.size(steps), F.lit(depth))
    heads = F.when(most > 0, F.transform(F.sequence(F.lit(1), most), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(steps, 1, i), "/")))).otherwise(F.array().cast("array<string>"))
    both = F.flatten(F.transform(suffixes, lambda s: F.concat(F.array(s), F.transform(heads, lambda p: F.concat(s, p)))))
    return F.when(host != "", F.array_distinct(both)).otherwise(F.array().cast("array<string>"))


def intervals(entries: DataFrame) -> DataFrame:
    """entry, since, until (null: still active) from entry, action (add or remove), day."""
    e = entries.filter("entry is not null and day is not null and action in ('add', 'remove')").select("entry", "action", F.col("day").cast("date").alias("day"))
    last = e.groupBy("entry", "day").agg(F.max("action").alias("action"))  # remove sorts after add
    w = Window.partitionBy("entry").orderBy("day")
    changes = last.withColumn("before", F.lag("action").over(w)).filter("(action = 'add' and coalesce(before, 'remove') = 'remove') or (action = 'remove' and before = 'add')")
    return changes.withColumn("until", F.lead("day").over(w)).filter("action = 'add'").select("entry", F.col("day").alias("since"), "until")


def url_filter(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched") -> DataFrame:
    """One row per capture: id, url, fetched, blocked, entry (the longest that matches, null if none), n_entries."""
    active = cut(intervals(entries))
    size = active.agg(F.count("*"), F.max(F.regexp_count("entry", F.lit(r"\."))), F.max(F.regexp_count("entry", F.lit("/")))).first()
    found = identified(captures)
    rows = found.df.select("_rf", "_rr", found.col(id_col).alias("_id"), found.col(url_col).alias("url"), found.col(time_col).cast("date").alias("fetched"))
    each = rows.select("*", F.explode_outer(keys_of(F.col("url"), (size[1] or 0) + 1, size[2] or 0)).alias("key"))
    near = (F.col("key") == F.col("entry")) & (F.col("since") <= F.col("fetched")) & (F.col("until").isNull() | (F.col("fetched") < F.col("until")))
    if size[0] <= BROADCAST_ROWS:
        found = each.join(F.broadcast(active), near, "left")
    else:
        each = each.withColumn("_salt", F.pmod(F.xxhash64("_rf", "_rr"), F.lit(SALTS)))
        spread = active.withColumn("_s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        found = each.join(spread, near & (F.col("_salt") == F.col("_s")), "left")
    best = F.max(F.when(F.col("entry").isNotNull(), F.struct(F.length("entry").alias("n"), F.col("entry"))))
    out = found.groupBy("_rf", "_rr", "_id", "url", "fetched").agg(best.alias("best"), F.count("entry").alias("n_entries"))
    return out.select(F.col("_id").alias(id_col), "url", "fetched", (F.col("n_entries") > 0).alias("blocked"), F.col("best.entry").alias("entry"), "n_entries")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages against LIST; the pages have no fetch time, so a day of 2024 follows from page_id."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    captures = pages.withColumn("fetched", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("page_id", F.lit(366)).cast("int")))
    return url_filter(captures, spark.createDataFrame([*LIST], "entry string, action string, day string"))


OP3_SQL = f"""
WITH e AS (SELECT entry, action, CAST(day AS DATE) AS day FROM (VALUES {", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in LIST)}) v(entry, action, day)
), d AS (SELECT entry, day, max(action) AS action FROM e GROUP BY entry, day
), c AS (SELECT * FROM (SELECT *, lag(action) OVER (PARTITION BY entry ORDER BY day) AS before FROM d)
         WHERE (action = 'add' AND coalesce(before, 'remove') = 'remove') OR (action = 'remove' AND before = 'add')
), i AS (SELECT * FROM (SELECT entry, action, day AS since, lead(day) OVER (PARTITION BY entry ORDER BY day) AS until FROM c) WHERE action = 'add'
), p AS (
  SELECT page_id, url, CAST(DATE '2024-01-01' + CAST(page_id % 366 AS INT) AS DATE) AS fetched,
         lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS host,
         regexp_replace(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+', '/', 'g') AS path
  FROM pages
), m AS (
  SELECT p.page_id, i.entry FROM p JOIN i ON fetched >= since AND (until IS NULL OR fetched < until) AND host <> ''
   AND ('.' || host) LIKE ('%.' || split_part(i.entry, '/', 1))
   AND (NOT contains(i.entry, '/') OR (rtrim(path, '/') || '/') LIKE (substr(i.entry, strpos(i.entry, '/')) || '/%'))
), b AS (SELECT page_id, count(*) AS n, arg_max(entry, row(length(entry), entry)) AS entry FROM m GROUP BY page_id)
SELECT p.page_id, p.url, p.fetched, b.n IS NOT NULL AS blocked, b.entry, CAST(coalesce(b.n, 0) AS BIGINT) AS n_entries FROM p LEFT JOIN b ON p.page_id = b.page_id
"""
