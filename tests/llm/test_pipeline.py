"""The pipeline against its stages in plain Python and SQL."""

import collections
import hashlib
import re

import duckdb
import pyarrow as pa
import pytest

import corpus_pipeline
from plumbline.llm import bpe
from plumbline.llm.entries import ORACLE_SQL, QUERIES

from pyspark.sql import functions as F

from test_llm import SF, jaccard_brute
from test_robust import CLASHES, ODD

SPACE = r"[\x20\x09-\x0D]+"


def test_pipeline_equals_brute_force(spark):
    tokenizers = pytest.importorskip("tokenizers")
    good = {r.doc_id for r in QUERIES["op9_quality_classifier"](spark, SF).filter("keep").collect()}
    docs = sorted((r.doc_id, r.text or "", r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if r.doc_id in good)
    first: dict[str, int] = {}
    for d, t, _ in docs:
        first.setdefault(re.sub(SPACE, " ", t), d)
    docs = [x for x in docs if x[0] in set(first.values())]
    classes = jaccard_brute([x[:2] for x in docs])
    docs = [x for x in docs if x[0] in {int(c) for _, _, c in classes}]
    assert len(docs) > 50

    documents = pa.table({"doc_id": [x[0] for x in docs], "text": [x[1] for x in docs], "source": [x[2] for x in docs]})  # noqa: F841  read by the SQL
    rel = duckdb.sql(ORACLE_SQL["op4_mix_sources"])
    taken = {r[rel.columns.index("doc_id")]: (r[rel.columns.index("taken")], r[rel.columns.index("size")]) for r in rel.fetchall()}
    t = tokenizers.Tokenizer.from_file(bpe.tokenizer_path())
    t.no_truncation()
    t.no_padding()
    want = collections.Counter()
    for d, text, _ in docs:
        n, size = taken[d]
        copies = [text] * (n // size if size else 0)
        if size and n % size:
            copies.append(" ".join([w for w in re.split(SPACE, text) if w][: n % size]))
        for c in copies:
            ids = t.encode(c, add_special_tokens=False).ids
            want[d, len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()] += 1
    got = collections.Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == want


def test_pipeline_on_odd_tables(spark, tmp_path):
    """Odd rows and extra columns with the operators' own names change nothing but themselves; empty tables give no rows."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    odd = spark.createDataFrame([(*r, None, None if n % 2 else "src1", 0) for n, r in enumerate(ODD)], docs.schema)
    rows = docs.filter("doc_id < 60").unionByName(odd)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    result = []
    for name, extra in (("plain", []), ("clash", CLASHES)):
        at = str(tmp_path / name)
        rows.select("*", *[F.lit(i).alias(c) for i, c in enumerate(extra)]).write.parquet(f"{at}/documents.parquet")
        labels.write.parquet(f"{at}/labels.parquet")
        result.append(collections.Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, at).collect()))
    assert result[0] == result[1] and result[0].total() > 20
    at = str(tmp_path / "none")
    rows.filter("false").write.parquet(f"{at}/documents.parquet")
    labels.filter("false").write.parquet(f"{at}/labels.parquet")
    assert corpus_pipeline.run(spark, at).count() == 0
