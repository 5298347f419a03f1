"""Each operator against SQL or brute force, on the smallest tables and on odd rows."""

import collections
import hashlib
import random
import re

import duckdb
import pytest

from plumbline.llm import bpe, exact_dedup, html_text, jaccard_join, mixing, quality, repeats, secrets, url_filter
from plumbline.llm.entries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
WORD = rb"[^\x20\x09-\x0d]+"
ODD = [(1, "a b c d e f"), (2, "A  b c d e f"), (None, None), (3, ""), (3, "x y"), (4, "X y"), (5, "y x"), (5, "y x"), (6, "ab" * 60_000)]


def odd(spark):
    rows = [(i, t, None if n % 3 else "s", n) for n, (i, t) in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, _rf int")


def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rel = con.sql(ORACLE_SQL[name])
    at = [rel.columns.index(c) for c in cols]
    assert sorted(map(str, map(tuple, df.select(cols).collect()))) == sorted(str(tuple(r[i] for i in at)) for r in rel.fetchall())


def test_exact_dedup_odd_rows(spark):
    rows = exact_dedup.exact_dedup(odd(spark).drop("_rf")).collect()
    assert len(rows) == len(ODD)
    assert sorted((r.keep_id, r.group_size) for r in rows if r.doc_id == 5) == [(5, 2), (5, 2)]
    assert sum(r.kept for r in rows) == 7


def test_bpe_equals_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(bpe.tokenizer_path())
    t.no_truncation()
    t.no_padding()
    v = bpe.vocabulary(bpe.tokenizer_path())
    for text in [x or "" for _, x in documents(spark)[:80]] + ["", "It's 12 <|endoftext|> Σας é İ", "a" * 500, " x\n"]:
        ids = t.encode(text, add_special_tokens=False).ids
        got, decoded = v.encode(text)
        assert got == b"".join(i.to_bytes(4, "little") for i in ids)
        assert decoded == v.decode(got) == t.decode(ids, skip_special_tokens=False)
    assert bpe.encode_decode(odd(spark), bpe.tokenizer_path()).count() == len(ODD)


def test_mixing_odd_rows(spark):
    rows = mixing.plan_mix(odd(spark)).collect()
    assert len(rows) == len(ODD)
    assert all(0 <= r.taken <= 3 * r.size for r in rows)


def jaccard_brute(docs):
    sets = []
    for _, t in docs:
        w = re.findall(WORD, bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = collections.defaultdict(lambda: 1 << 60)
    for i, (d, _) in enumerate(docs):
        least[find(i)] = min(least[find(i)], 1 << 60 if d is None else d)
    return sorted((str(d), len(sets[i]), str(None if least[find(i)] == 1 << 60 else least[find(i)])) for i, (d, _) in enumerate(docs))


def test_jaccard_join_equals_brute_force(spark):
    got = QUERIES["op10_jaccard_join"](spark, SF).collect()
    assert sorted((str(r[0]), r[1], str(r[2])) for r in got) == jaccard_brute(documents(spark))


@pytest.mark.parametrize("bucket", [3, 2000])
def test_jaccard_join_of_one_crowded_bucket(spark, monkeypatch, bucket):
    """Many texts share a long passage, which is in their prefixes, and differ by all degrees in the rest."""
    monkeypatch.setattr(jaccard_join, "BUCKET", bucket)
    r = random.Random(3)
    passage = [f"averylongwordofthepassage{i}" for i in range(40)]
    docs = []
    for i in range(160):
        words = passage + [f"w{j}" for j in range(r.randint(0, 24))] + [f"x{r.randint(0, 9**9)}" for _ in range(r.choice((0, 2, 9, 30)))]
        docs.append((i, " ".join(words)))
    got = jaccard_join.jaccard_join(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((str(x[0]), x[1], str(x[2])) for x in got) == jaccard_brute(docs)


def test_jaccard_join_odd_rows(spark):
    got = jaccard_join.jaccard_join(odd(spark).drop("_rf")).collect()
    assert sorted((str(r[0]), r[1], str(r[2])) for r in got) == jaccard_brute(ODD)


def repeats_brute(docs, size=400):
    data = [(t or "").encode() for _, t in docs]
    count = collections.Counter(b[i : i + size] for b in data for i in range(len(b) - size + 1))
    out = []
    for (d, _), b in zip(docs, data, strict=True):
        gone = bytearray(len(b))
        for i in range(len(b) - size + 1):
            if count[b[i : i + size]] > 1:
                gone[i : i + size] = b"\1" * size
        kept = bytes(x for x, y in zip(b, gone, strict=True) if not y)
        out.append((str(d), len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("block", [1, 1024])
def test_repeats_equal_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK", block)
    docs = [(i, t) for i, t in documents(spark) if t and len(t) < 6000][:120] + [(900, "é" * 400), (901, "ab" * 500), (None, None)]
    got = repeats.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == repeats_brute(docs)


def test_secrets_equal_brute_force(spark):
    got = {r.doc_id: r for r in QUERIES["op7_secret_scan"](spark, SF).collect()}
    for d, t in documents(spark):
        t, spans = t or "", []
        for m in re.finditer(secrets.ASSIGN.replace("(?i)", ""), t, re.I | re.A):
            spans += [(m.start(), 0, m.end())] if len(m[2]) >= 12 else []
        spans += [(m.start(), 1, m.end()) for m in re.finditer(secrets.ACCESS, t) if len(m[0]) >= 18]
        spans += [(m.start(), 2, m.end()) for m in re.finditer(secrets.HEX, t) if len(m[0]) >= 16]
        text = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))
        assert got[d].base_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_html(spark):
    page = '<nav><ul><li><a href="/a">Home page</a></li></ul></nav><article><h1>A &amp; B</h1><p>One  <b>two</b>.<p>Three.</article><footer>&copy; x</footer>'
    rows = [(1, "u", page), (2, None, None), (3, "u", "<p")]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == "A & B One two. Three." and got[2] == ""
    net = html_text.trained()
    right = total = 0
    for x, y in html_text.training_pages(60, 1234):
        right += int(((net.scores(*html_text.padded([x]))[0] > 0) == (y > 0)).sum())
        total += len(y)
    assert right / total > 0.99


def test_url_keys(spark):
    df = spark.createDataFrame([("http://a.b.org/x/y?q",), ("nohost",), (None,)], "url string")
    got = [r[0] for r in df.select(url_filter.keys_of(df.url)).collect()]
    assert set(got[0]) == {f"{h}{p}" for h in ("a.b.org", "b.org", "org") for p in ("", "/x", "/x/y")} and got[1] == got[2] == []


@pytest.mark.parametrize("name", ["op1_exact_dedup", "op2_bpe", "op4_mix_sources", "op6_remove_repeats", "op7_secret_scan", "op10_jaccard_join"])
def test_empty_table(spark, name, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert QUERIES[name](spark, str(tmp_path)).count() == 0
