"""Every operator on odd rows, on tables without rows, on a very long text, and with the names that they use themselves as extra columns."""

import collections
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from plumbline.llm import bm25_search, bpe, exact_dedup, html_text, jaccard_join, mixing, quality, repeats, secrets, url_filter

LONG = "a word of " * 500_000
ODD = [(1, "a b c d e f"), (2, "A  b c d e f"), (None, None), (None, "null id"), (None, "null id"), (3, ""), (3, "x y"), (4, "X y"), (5, "y x"), (5, "y x"), (6, LONG), (7, "!!! ### | x")]
#: Names that the operators use for columns of their own.
CLASHES = (
    "_rf _rr _metadata _c0 _k0 _id _key _size _tie _s _range _run _taken _copy _text _digest _keep_0 _e _host _path _y keep kept quality evidence host_quality path_quality n size "
    "source_size target taken cls g root spans terms counts words rf rr node query_id rank score term df weight file_path row_index n_tokens ids entry key fetched"
).split()


def odd(spark):
    rows = [(i, t, "de" if n % 2 else None, None if n % 3 else "s", n) for n, (i, t) in enumerate(ODD)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    return df.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHES])


def labels(spark):
    return spark.createDataFrame([(1, 1), (None, 0), (3, None)], "doc_id long, quality int")


def rows_of(df):
    return collections.Counter(tuple(map(str, r)) for r in df.collect())


ONE_ROW_EACH = {
    "exact_dedup": lambda df: exact_dedup.exact_dedup(df),
    "bpe": lambda df: bpe.encode_decode(df, bpe.tokenizer_path()),
    "mixing": lambda df: mixing.plan_mix(df),
    "repeats": lambda df: repeats.remove_repeats(df),
    "secrets": lambda df: secrets.scan(df),
    "quality": lambda df: quality.score(df, labels(df.sparkSession)),
    "jaccard": lambda df: jaccard_join.jaccard_join(df),
    "html": lambda df: html_text.extract(df.withColumnsRenamed({"doc_id": "page_id", "text": "html"}).withColumn("url", F.lit("http://a.org"))),
    "url_filter": lambda df: url_filter.url_filter(df.withColumn("url", F.lit("http://a.org/x")).withColumn("fetched", F.lit("2024-05-05")), df.sparkSession.createDataFrame([("a.org", "add", "2024-01-01")], "entry string, action string, day string"), "doc_id"),
}
STAGES = {
    "dedup": lambda df: exact_dedup.dedup(df),
    "keep_good": lambda df: quality.keep_good(df, labels(df.sparkSession)),
    "one_of_each": lambda df: jaccard_join.one_of_each(df),
    "mix": lambda df: mixing.mix(df),
}


@pytest.mark.parametrize("name", sorted(ONE_ROW_EACH))
def test_a_row_for_each_row_and_the_same_without_extra_columns(spark, name):
    df = odd(spark)
    got = rows_of(ONE_ROW_EACH[name](df))
    assert got.total() == len(ODD)
    plain = df.select("doc_id", "text", "lang", "source")
    assert rows_of(ONE_ROW_EACH[name](plain.repartition(3))) == got
    assert rows_of(ONE_ROW_EACH[name](df.filter("false"))).total() == 0


@pytest.mark.parametrize("name", sorted(STAGES))
def test_stages_keep_all_columns(spark, name):
    df = odd(spark)
    got = STAGES[name](df)
    assert got.columns == df.columns and got.schema.simpleString() == df.schema.simpleString()
    rows = got.collect()
    assert rows and all(r[c] == f"own {c}" for r in rows for c in CLASHES)
    if name != "mix":
        assert not rows_of(got) - rows_of(df)
    assert rows_of(STAGES[name](df.repartition(3)).select("doc_id", "text")) == rows_of(got.select("doc_id", "text"))
    assert STAGES[name](df.filter("false")).count() == 0


def test_search_with_extra_columns(spark):
    df = odd(spark)
    assert rows_of(bm25_search.search(df, df, 3)) == rows_of(bm25_search.search(df.select("doc_id", "text"), df.select("text", "doc_id"), 3))


def test_ties_mix_alike_under_every_partitioning(spark):
    rows = [(7, f"{'abcdefghij'[i % 10]} {i} x", "s", i) for i in range(40)] + [(None, f"n {i % 5}", "t", i) for i in range(40)] + [(1, "w " * 30, "u", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, extra int")
    want = rows_of(mixing.mix(df))
    for n in (1, 2, 7):
        assert rows_of(mixing.mix(df.repartition(n, "extra"))) == want


@pytest.mark.parametrize("name", ["exact", "near"])
def test_which_row_of_one_id_stays_is_no_matter_of_files(spark, tmp_path, name):
    """Rows of one doc_id and one text, of two sources, in other files and another order: the same ones stay, extra columns or not."""
    rows = [(i, f"{i} some text of five words", s, j) for i in range(30) for j, s in enumerate(("s", "t"))]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, extra int")
    stage = {"exact": exact_dedup.dedup, "near": jaccard_join.one_of_each}[name]
    got = []
    for n, part in enumerate((df, df.drop("extra").orderBy(F.desc("source")), df.withColumn("extra", F.lit(7)).repartition(3, "source"))):
        part.write.parquet(str(tmp_path / str(n)))
        got.append(rows_of(stage(spark.read.parquet(str(tmp_path / str(n)))).select("doc_id", "source")))
    assert got[0].total() == 30 and got[0] == got[1] == got[2]


def test_second_batch_meets_the_state_of_the_first(spark, tmp_path):
    first = [(10, "a  b"), (11, "c"), (12, None), (13, "only here")]
    second = [(20, "a b"), (9, "c"), (21, ""), (22, "new"), (23, "new"), (None, "a\tb")]
    state = f"file://{tmp_path}/state"
    frame = lambda rows: spark.createDataFrame([(t, i) for i, t in rows], "body string, doc_id long")
    got = {r.doc_id: tuple(r)[1:4] for r in exact_dedup.exact_dedup(frame(first), text_col="body", state_dir=state).collect()}
    assert got == {i: (i, 1, True) for i, _ in first}
    got = {r.doc_id: tuple(r)[1:4] for r in exact_dedup.exact_dedup(frame(second), text_col="body", state_dir=state).collect()}
    texts, want = collections.defaultdict(list), {}
    for i, t in first + second:
        texts[re.sub(exact_dedup.SPACE, " ", t or "")].append(i)
    for i, t in second:
        group = texts[re.sub(exact_dedup.SPACE, " ", t or "")]
        least = min(x for x in group if x is not None)
        want[i] = (least, len(group), i == least)
    assert got == want


@pytest.mark.parametrize("batches", [1, 2])
def test_texts_that_share_a_digest_are_split(spark, tmp_path, monkeypatch, batches):
    """A digest of one hex digit makes different texts share it."""
    monkeypatch.setattr(exact_dedup, "digest", lambda text: F.unhex(F.concat(F.substring(F.sha2(text, 256), 1, 1), F.lit("0"))))
    rows = [(i, f"text {i % 23}") for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = []
    for b in range(batches):
        part = df.filter(F.col("doc_id") % batches == b)
        out += exact_dedup.exact_dedup(part, state_dir=f"file://{tmp_path}/state" if batches > 1 else None).collect()
    for r in out:
        seen = [i for i, _ in rows if i % 23 == r.doc_id % 23 and i % batches <= r.doc_id % batches]
        assert (r.keep_id, r.group_size, r.kept) == (min(seen), len(seen), r.doc_id == min(seen))


def test_hot_keys_are_salted(spark, monkeypatch):
    from plumbline.llm import common

    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    df = spark.createDataFrame([(i, f"t{min(i, 300)}") for i in range(600)], "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(df).collect()}
    assert got == {i: (min(i, 300), 300 if i >= 300 else 1) for i in range(600)}


@pytest.mark.parametrize("most", [0, 50_000])
def test_url_lists_of_any_size_give_the_same(spark, monkeypatch, most):
    monkeypatch.setattr(url_filter, "BROADCAST_ROWS", most)
    urls = ["http://a.b.org/x/y?q", "https://u@B.org:8/x", "nohost", None, "http://c.org/" + "d/" * 2000, "http://b.org/xy"]
    df = spark.createDataFrame([(n, u, f"2024-0{m}-01") for n, u in enumerate(urls) for m in (1, 3, 5)] + [(9, urls[0], None)], "page_id long, url string, fetched string")
    entries = [("b.org/x", "add", "2024-02-01"), ("b.org", "add", "2024-04-01"), ("b.org/x", "remove", "2024-04-15"), ("org", "remove", "2024-01-01"), ("c.org/d/d", "add", "2024-01-01")]
    got = collections.Counter(tuple(map(str, r)) for r in url_filter.url_filter(df, spark.createDataFrame(entries, "entry string, action string, day string")).collect())

    def brute(url, day):
        m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)[^/?#]*([^?#]*)", url or "")
        out = []
        for e in {e for e, _, _ in entries}:
            days = sorted((d, a) for x, a, d in entries if x == e)
            active = ""
            for d, a in days:
                if day and d <= day:
                    active = a
            host, _, path = e.partition("/")
            if m and active == "add" and ("." + m[1].lower()).endswith("." + host) and (not path or (m[2].rstrip("/") + "/").startswith(f"/{path}/")):
                out.append(e)
        return max(out, key=lambda e: (len(e), e)) if out else None, len(out)

    want = collections.Counter()
    for r in df.collect():
        e, n = brute(r.url, r.fetched)
        want[str(r.page_id), str(r.url), str(r.fetched), str(n > 0), str(e), str(n)] += 1
    assert got == want


def test_long_text_digests(spark):
    df = spark.createDataFrame([(1, LONG, "s")], "doc_id long, text string, source string")
    r = exact_dedup.exact_dedup(df).first()
    assert r.text_sha256 == hashlib.sha256(LONG.encode()).hexdigest()
    assert mixing.plan_mix(df).first()["size"] == len(LONG.split())


@pytest.mark.parametrize("rows", [0, 50_000])
@pytest.mark.parametrize("kind", ["bigint", "binary"])
def test_components_equal_brute_force(spark, monkeypatch, rows, kind):
    from plumbline.llm import common

    monkeypatch.setattr(common, "BROADCAST_ROWS", rows)
    r = random.Random(8)
    pairs = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(150)] + [(1000, 1001 + i) for i in range(80)] + [(2000 + i, 2001 + i) for i in range(60)] + [(5, 5)]
    name = (lambda x: x) if kind == "bigint" else (lambda x: x.to_bytes(4, "big"))
    links = spark.createDataFrame([(name(x), name(y)) for x, y in pairs], f"a {kind}, b {kind}")
    got = {n: m for n, m in common.components(links).collect()}
    root = {x: x for p in pairs for x in p if p[0] != p[1]}
    for _ in range(400):
        for x, y in pairs:
            if x != y:
                root[x] = root[y] = min(root[x], root[y])
    assert {bytes(k) if kind == "binary" else k: bytes(v) if kind == "binary" else v for k, v in got.items()} == {name(k): name(v) for k, v in root.items() if k != v}
    assert common.components(links.filter("false")).count() == 0
