"""7. Secret scans: patterns, and a randomness test battery, in DataFrame functions only.

Patterns (kinds `assign`, `access`, `hex`) give the base spans. The battery adds spans of
kind `random`: runs of 20 or more base64 characters are candidates; each is read in the
smallest encoding that holds it (hex, base32 and base36 in either case, base62, base64,
base64url) as a sequence of that alphabet's symbol indices and tested against uniform
randomness (a run that no encoding holds, with both `+/` and `_-`, over all 66 symbols):

* chi-squared: the symbols' counts against equal counts of the alphabet;
* runs: the Wald-Wolfowitz number of runs above and below the alphabet's middle;
* serial correlation: the lag-1 correlation of the indices.

Each test gives a two-sided normal p-value (chi-squared by Wilson and Hilferty's cube root);
a candidate passes when the least of the three, times three, stays above 0.01. Passing alone
says little about short runs, so the evidence against ordinary text is weighed by length:
with q the frequencies of characters in ordinary identifiers and words, the likelihood ratio
uniform / q of the whole run bounds its p-value under the text hypothesis by 1 / ratio
(Markov), and Benjamini and Hochberg's step-up controls the false-discovery rate at 0.001
over all candidates of the corpus. Long runs can reach tiny p-values, short ones cannot.
The step-up needs only a histogram of log p-values in BINS fixed bins.

All tests are sums over the characters' positions, so a scan is one pass without a shuffle;
the histogram is a second aggregation of at most BINS rows.

Defined results: null text is empty text; texts without matches give zeros, an empty
`spans` and the digest of the empty string; positions are code points; repeated rows get a
row each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "random")
LEAST = {"assign": 12, "access": 18, "hex": 16}
#: Matches that one fold gathers.
CHUNK = 512
#: Candidates of the battery.
RUN = r"[A-Za-z0-9+/_-]{20,}"
_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: (alphabet, its characters as a class) of each encoding, from the smallest.
ENCODINGS = (
    (_DIGITS + "abcdef", "0-9a-f"), (_DIGITS + "ABCDEF", "0-9A-F"), (_UPPER + "234567", "A-Z2-7"), (_LOWER + "234567", "a-z2-7"), (_DIGITS + _LOWER, "0-9a-z"), (_DIGITS + _UPPER, "0-9A-Z"),
    (_DIGITS + _UPPER + _LOWER, "0-9A-Za-z"), (_UPPER + _LOWER + _DIGITS + "+/", "0-9A-Za-z+/"), (_UPPER + _LOWER + _DIGITS + "-_", "0-9A-Za-z_-"),
)
#: For runs that no encoding holds.
ANY = _UPPER + _LOWER + _DIGITS + "+/_-"
ALPHA = 0.01
FDR = 0.001
BINS = 400
BIN_WIDTH = 0.25  # in powers of ten
#: FIXED VALUES: shares of characters in ordinary words and identifiers, by classes of equal share.
ORDINARY = (
    ("etaonisrhl", 0.54), ("bcdfgjkmpquvwxyz", 0.36), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 0.06), ("0123456789", 0.03), ("+/_-", 0.01),
)


def _spans(text: Column, pattern: str, kind: str, least: int, group: int = 0) -> Column:
    """array<struct<start, ord, end, kind>> of matches whose group has the least length.

    Pieces between the matches and the matches alternate, so running sums of their lengths
    are the positions in code points.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sizes = F.transform(found, F.char_length)
    held = sizes if group == 0 else F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.char_length)
    gaps = F.transform(F.split(text, pattern, -1), F.char_length)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,size:int,held:int>>").alias("out"))
    triples = F.zip_with(F.slice(gaps, 1, F.size(found)), F.arrays_zip(sizes.alias("s"), held.alias("h")), lambda g, m: F.struct(g.alias("g"), m["s"].alias("s"), m["h"].alias("h")))

    def step(acc, t):
        ok = t["h"] >= F.lit(least)
        hit = F.array(F.struct((acc["at"] + t["g"]).alias("start"), t["s"].alias("size"), t["h"].alias("held")))
        return F.struct((acc["at"] + t["g"] + t["s"]).alias("at"), F.when(ok, F.concat(acc["out"], hit)).otherwise(acc["out"]).alias("out"))

    # folds copy what they have gathered at each step: pieces of CHUNK matches keep that linear
    def pieced(pieces):
        sums = F.transform(pieces, lambda p: F.aggregate(p, F.lit(0), lambda total, t: total + t["g"] + t["s"]))
        none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        starts = F.aggregate(sums, none, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))["out"]
        return F.flatten(F.zip_with(pieces, starts, lambda p, at: F.aggregate(p, F.struct(at.alias("at"), zero["out"].alias("out")), step)["out"]))

    def gathered(t):
        pieces = F.transform(F.sequence(F.lit(0), F.floor((F.size(t) - 1) / F.lit(CHUNK)).cast("int")), lambda i: F.slice(t, i * CHUNK + 1, F.lit(CHUNK)))
        return F.when(F.size(t) <= CHUNK, F.aggregate(t, zero, step)["out"]).otherwise(F.element_at(F.transform(F.array(pieces), pieced), 1))

    hits = F.element_at(F.transform(F.array(triples), gathered), 1)
    order = KINDS.index(kind)
    made = F.transform(hits, lambda m: F.struct(m["start"].alias("start"), F.lit(order).alias("ord"), (m["start"] + m["size"]).alias("end"), F.lit(kind).alias("kind")))
    none = F.array().cast("array<struct<start:int,ord:int,end:int,kind:string>>")
    return F.when(F.size(found) > 0, made).otherwise(none)


def base_spans(text: Column) -> list[Column]:
    """The spans of each base kind. Runs of one class are maximal, so their least length can stand in the pattern."""
    return [
        _spans(text, ASSIGN, "assign", LEAST["assign"], 2),
        _spans(text, r"AKIA[A-Z0-9]{14,}", "access", LEAST["access"]),
        _spans(text, r"[0-9a-f]{16,}", "hex", LEAST["hex"]),
    ]


def _let(value: str, name: str, body: str) -> str:
    """SQL: body with name standing for value, evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _tail(z: str) -> str:
    """SQL: two-sided normal tail of z by Abramowitz and Stegun 26.2.17, good to 7 digits."""
    poly = "t * (0.319381530D + t * (-0.356563782D + t * (1.781477937D + t * (-1.821255978D + t * 1.330274429D))))"
    inner = _let("1D / (1D + 0.2316419D * a)", "t", f"2D * exp(-a * a / 2D) / sqrt(2D * pi()) * {poly}")
    return _let(f"least(abs({z}), 37D)", "a", inner)


def _total(array: str) -> str:
    return f"aggregate({array}, 0D, (s, x) -> s + x)"


def chi_squared_z(w: str, alphabet: str) -> str:
    """SQL of the chi-squared statistic's normal score, from the token w."""
    a, n, df = f"char_length({alphabet})", f"cast(char_length({w}) as double)", f"(char_length({alphabet}) - 1D)"
    squares = f"aggregate(sequence(1, {a}), 0D, (s, k) -> s + power(char_length({w}) - char_length(replace({w}, substring({alphabet}, k, 1), '')), 2))"
    return f"(cbrt(({squares} * {a} / {n} - {n}) / {df}) - (1D - 2D / (9D * {df}))) / sqrt(2D / (9D * {df}))"


def runs_z(x: str, alphabet: str) -> str:
    """SQL of the runs test's normal score, from the token's symbol indices x."""
    high = f"transform({x}, i -> if(i >= char_length({alphabet}) / 2D, 1D, 0D))"
    changes = _total("zip_with(slice(h, 1, size(h) - 1), slice(h, 2, size(h) - 1), (p, q) -> abs(p - q))")
    score = f"({changes} + 1D - m) / sqrt(greatest((m - 1D) * (m - 2D) / (size(h) - 1D), 1e-9D))"
    mean = _let("1D + 2D * o * (size(h) - o) / size(h)", "m", score)
    return _let(high, "h", _let(_total("h"), "o", f"if(o = 0D or o = size(h), 30D, {mean})"))


def serial_z(x: str, alphabet: str) -> str:
    """SQL of the serial correlation's normal score, from the token's symbol indices x."""
    a = f"char_length({alphabet})"
    products = f"zip_with(slice({x}, 1, size({x}) - 1), slice({x}, 2, size({x}) - 1), (p, q) -> (p - ({a} - 1D) / 2D) * (q - ({a} - 1D) / 2D))"
    return f"{_total(products)} / (({a} * {a} - 1D) / 12D) / sqrt(size({x}) - 1D)"


def battery(w: str, alphabet: str) -> str:
    """SQL: the least of the three tests' p-values, times three, for token w in an alphabet (both SQL)."""
    indices = f"transform(sequence(1, char_length({w})), i -> cast(locate(substring({w}, i, 1), {alphabet}) - 1 as double))"
    tests = (chi_squared_z(w, alphabet), runs_z("x", alphabet), serial_z("x", alphabet))
    return _let(indices, "x", "3D * least(" + ", ".join(map(_tail, tests)) + ")")


def log_p(w: str, alphabet_size: str) -> str:
    """SQL: log10 of the bound on the p-value under the text hypothesis, likelihood of ordinary text over uniform."""
    have = lambda chars: f"(char_length({w}) - char_length(translate({w}, '{chars}', '')))"
    parts = [f"{have(chars)} * {math.log10(share / len(chars))!r}D" for chars, share in ORDINARY]
    return f"least(0D, {' + '.join(parts)} + char_length({w}) * log10({alphabet_size}))"


def judged_array(text: Column) -> Column:
    """array<struct<start, ord, end, kind, log_p, pass>> of a text's candidates; null without any."""
    zipped = F.zip_with(_spans(text, RUN, "random", 20), F.regexp_extract_all(text, F.lit(RUN), F.lit(0)), lambda s, w: F.struct(s["start"].alias("start"), s["end"].alias("end"), w.alias("w")))
    return F.when(text.rlike(RUN), zipped)


def _judge_sql(c: str) -> str:
    w = f"{c}.w"
    alphabet = "case " + " ".join(f"when {w} rlike '^[{held}]+$' then '{symbols}'" for symbols, held in ENCODINGS) + f" else '{ANY}' end"
    mixed = f"({w} rlike '[0-9]' and {w} rlike '[A-Za-z]')"
    verdict = f"named_struct('start', {c}.start, 'ord', {KINDS.index('random')}, 'end', {c}.end, 'kind', 'random', 'log_p', {log_p(w, 'char_length(ab)')}, 'pass', if({mixed}, {battery(w, 'ab')} > {ALPHA}D, false))"
    return _let(alphabet, "ab", verdict)


def judged(docs: DataFrame) -> DataFrame:
    """Columns _id, _t and _j, the text's candidates with log_p and pass."""
    rows = docs.select(F.col("doc_id").alias("_id"), F.coalesce("text", F.lit("")).alias("_t"))
    return rows.withColumn("_c", judged_array(F.col("_t"))).withColumn("_j", F.expr(f"transform(_c, c -> {_judge_sql('c')})")).drop("_c")


def fdr_limit(rows: DataFrame, rate: float = FDR) -> float:
    """log10 p up to which candidates are discoveries: step-up over bins of log p, conservative within a bin."""
    each = rows.select(F.explode("_j").alias("j"))
    bins = each.select(F.least(F.lit(BINS - 1), F.floor(-F.col("j.log_p") / F.lit(BIN_WIDTH))).cast("int").alias("b"), F.col("j.pass").alias("ok"))
    bins = bins.groupBy("b").agg(F.count("*").alias("m"), F.count_if("ok").alias("k")).collect()  # at most BINS rows
    m, found, limit = sum(r["m"] for r in bins), 0, -math.inf
    for r in sorted(bins, key=lambda r: -r["b"]):
        found += r["k"]
        if r["k"] and -r["b"] * BIN_WIDTH <= math.log10(rate * found / m):
            limit = -r["b"] * BIN_WIDTH
    return limit


def scan(docs: DataFrame, rate: float = FDR) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random."""
    rows = judged(docs)
    limit = fdr_limit(rows, rate)
    a, k, h = base_spans(F.col("_t"))
    rows = rows.withColumn("_base", F.concat(a, k, h))
    none = F.array().cast("array<struct<start:int,ord:int,end:int,kind:string>>")
    if limit == -math.inf:
        extra = none
    else:
        free = f"filter(_j, c -> c.pass and c.log_p <= {limit!r}D and not exists(_base, b -> b.start <= c.start and b.end >= c.end))"
        extra = F.coalesce(F.expr(f"transform({free}, c -> named_struct('start', c.start, 'ord', c.ord, 'end', c.end, 'kind', c.kind))"), none)
    rows = rows.withColumn("_r", extra)
    number = lambda kind: F.size(F.filter("_base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return rows.select(
        F.col("_id").alias("doc_id"), number("assign"), number("access"), number("hex"),
        F.sha2(_joined(F.col("_base")), 256).alias("base_sha256"), _joined(F.concat("_base", "_r")).alias("spans"), F.size("_r").cast("long").alias("n_random"),
    )


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
