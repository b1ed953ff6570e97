"""Secret scan: three fixed patterns, and a battery of randomness tests with control of false discoveries.

Beside the patterns, each run of at least MIN_LENGTH characters of the usual encodings is tested. Its encoding (hex,
base32 or base64) is inferred from its characters. A chi-squared test of uniformity over the encoding's whole alphabet, a
runs test about its middle and a test of lag-1 serial correlation give three p-values for a random run, which Fisher's
method combines. Words and paths can pass these when short, so each run also gets a p-value for being ordinary: the
likelihood ratio of ordinary text to uniform draws, which by Markov's inequality bounds how often ordinary text looks so
random.

Discoveries are controlled over all runs of the table, twice, by the Benjamini-Hochberg rule with weights in proportion
to length, so that a long run, of which the tests tell more, needs less: the battery clears runs, of which a share of
CLEARED at most are random; of those not cleared the runs that ordinary text does not explain are reported, of which a
share of FDR at most are ordinary. The rule needs counts of p-values only, in bins of a twentieth of a decimal digit.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

KINDS = ("assign", "access", "hex", "random")
MIN_LENGTH, CLEARED, FDR = 20, 0.002, 0.01
#: Bins of a decimal digit of a p-value, and digits told apart.
BINS, DIGITS = 20, 300
#: Fixed patterns: the letters of assign in either case, ASCII only.
_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_RUN = re.compile(rf"[A-Za-z0-9+/_-]{{{MIN_LENGTH},}}")
ALPHABETS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
#: Rough shares of letters in ordinary text, a to z; and of ordinary steps from one class of characters to the next.
LETTERS = dict(zip("abcdefghijklmnopqrstuvwxyz", (8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.2, 0.8, 4.0, 2.4, 6.7, 7.5, 1.9, 0.1, 6.0, 6.3, 9.1, 2.8, 1.0, 2.4, 0.2, 2.0, 0.1), strict=True))
STEPS = {
    "l": {"l": 0.93, "u": 0.02, "d": 0.02, "o": 0.03},
    "u": {"l": 0.45, "u": 0.48, "d": 0.03, "o": 0.04},
    "d": {"l": 0.04, "u": 0.03, "d": 0.88, "o": 0.05},
    "o": {"l": 0.55, "u": 0.15, "d": 0.15, "o": 0.15},
}
_SHARE = sum(LETTERS.values())


def _class(c: str) -> str:
    return "l" if c.islower() else "u" if c.isupper() else "d" if c.isdigit() else "o"


def encoding(run: str) -> str:
    """The smallest alphabet that holds the run."""
    return next((name for name, letters in ALPHABETS.items() if set(run) <= set(letters)), "base64")


def chi_squared(values: list[int], size: int) -> float:
    """p-value of uniformity over the alphabet: the statistic, with the mean and variance it has for so few draws, by
    the cube root of Wilson and Hilferty."""
    n = len(values)
    counts = [0] * size
    for v in values:
        counts[v] += 1
    x = sum(c * c for c in counts) * size / n - n
    scale = n / max(n - 1, 1)
    free = (size - 1) * scale
    z = ((x * scale / free) ** (1 / 3) - (1 - 2 / (9 * free))) / math.sqrt(2 / (9 * free))
    return math.erfc(z / math.sqrt(2)) / 2


def runs(values: list[int], size: int) -> float:
    """Two-sided p-value of the number of runs below and above the alphabet's middle."""
    high = [2 * v >= size for v in values]
    n1 = sum(high)
    n2, n = len(high) - n1, len(high)
    if not n1 or not n2:
        return 2.0 ** (1 - n)
    mean = 2 * n1 * n2 / n + 1
    spread = math.sqrt(max((mean - 1) * (mean - 2) / (n - 1), 1e-12))
    got = 1 + sum(a != b for a, b in zip(high, high[1:], strict=False))
    return math.erfc(abs(got - mean) / spread / math.sqrt(2))


def serial(values: list[int], size: int) -> float:
    """Two-sided p-value of the correlation of neighbours."""
    n = len(values)
    mean = sum(values) / n
    var = sum((v - mean) ** 2 for v in values)
    if not var:
        return 0.0
    r = sum((a - mean) * (b - mean) for a, b in zip(values, values[1:], strict=False)) / var
    return math.erfc(abs(r + 1 / n) * math.sqrt(n) / math.sqrt(2))


def ordinary(run: str, size: int) -> float:
    """A bound of the probability that ordinary text looks as random as this."""
    bits, before = 0.0, "l"
    for c in run:
        now = _class(c)
        within = LETTERS[c.lower()] / _SHARE if now in "lu" else 0.1 if now == "d" else 0.25
        bits += math.log2(STEPS[before][now] * within) + math.log2(size)
        before = now
    return min(1.0, 2.0 ** min(bits, 0.0)) if bits < 0 else 1.0


def battery(run: str, letters: str) -> float:
    """Fisher's combination of the three tests: how probable a random run of the alphabet is to look so little random."""
    place = {c: i for i, c in enumerate(letters)}
    values = [place.get(c, len(letters) - 1) for c in run]
    x = -sum(math.log(max(test(values, len(letters)), 1e-300)) for test in (chi_squared, runs, serial))
    return min(1.0, math.exp(-x) * (1 + x + x * x / 2))


def tested(text: str) -> list[tuple[int, int, int, int]]:
    """(start, end, bin of the battery's p-value, bin of the ordinary one) of each run; p-values are by length."""
    found = []
    for m in _RUN.finditer(text):
        letters = ALPHABETS[encoding(m[0])]
        pair = (battery(m[0], letters), ordinary(m[0], len(letters)))
        found.append((m.start(), m.end(), *(p_bin(p / len(m[0])) for p in pair)))
    return found


def p_bin(p: float) -> int:
    return int(min(-math.log10(max(p, 10.0**-DIGITS)), DIGITS) * BINS)


def least_bin(counts: dict[int, int], number: int, length: float, rate: float) -> int:
    """The first bin of discoveries among so many runs of so much length; bins hold p-values by length."""
    best, beyond = DIGITS * BINS + 1, 0
    for at in sorted(counts, reverse=True):
        beyond += counts[at]
        if length * 10.0 ** (-at / BINS) <= rate * beyond:
            best = at
    return best


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, in order."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 6]
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def scan(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, int]]]:
    """Base spans, and the tested runs that no base span touches."""
    text = text or ""
    base = base_spans(text)
    return base, [r for r in tested(text) if not any(r[0] < end and start < r[1] for start, _, end in base)]


def limits(found: DataFrame) -> tuple[int, int]:
    """The first bins of cleared and of reported runs, from the runs (start, stop, clear, odd) of all rows."""
    every = found.select(F.explode("runs").alias("r")).select("r.*")
    size = F.sum(F.col("stop") - F.col("start"))
    rows = every.groupBy("clear", "odd").agg(F.count(F.lit(1)).alias("n"), size.alias("length")).collect()  # bins, not runs
    number, length = sum(r["n"] for r in rows), float(sum(r["length"] for r in rows))

    def first(column: str, rate: float, kept: list) -> int:
        counts: dict[int, int] = {}
        for r in kept:
            counts[r[column]] = counts.get(r[column], 0) + r["n"]
        return least_bin(counts, number, length, rate)

    return first("clear", CLEARED, rows), first("odd", FDR, rows)


def written(spans: Column) -> Column:
    """Spans (start, kind, stop) as kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["stop"].cast("string"))), ",")


SCHEMA = "struct<base:array<struct<start:int,kind:int,stop:int>>,runs:array<struct<start:int,stop:int,clear:int,odd:int>>>"


def find_secrets(docs: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """docs with the column secrets: counts by kind, and base and all spans as kind:start:end in code points, end exclusive.

    A null or empty text has none; very long texts are scanned whole. Whether a run is reported depends on all runs of the
    table, repeated rows included, so rows equal in text have equal spans. Other columns stay as they are, but a column
    named secrets is replaced. An empty table gives no rows. Without keep_text the text is left out, and each text is
    scanned once; with it the scan is repeated rather than texts written.
    """

    @F.pandas_udf(SCHEMA)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = [scan(t) for t in texts]
            yield pd.DataFrame({"base": [[dict(zip(("start", "kind", "stop"), x, strict=True)) for x in b] for b, _ in rows], "runs": [[dict(zip(("start", "stop", "clear", "odd"), x, strict=True)) for x in r] for _, r in rows]})

    scanned = docs.withColumn("secrets", run(F.col(text)))
    if not keep_text:
        scanned = cut(scanned.drop(text), "scanned")
    clear, odd = limits(scanned.select("secrets.runs"))
    extra = F.transform(F.filter("secrets.runs", lambda r: (r["clear"] < clear) & (r["odd"] >= odd)), lambda r: F.struct(r["start"].alias("start"), F.lit(3).alias("kind"), r["stop"].alias("stop")))
    spans = F.array_sort(F.concat("secrets.base", extra))
    of = lambda k: F.size(F.filter(spans, lambda x: x["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return scanned.withColumn("secrets", F.struct(*[of(k) for k in range(4)], written(F.col("secrets.base")).alias("base"), written(spans).alias("spans")))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    return found.select("doc_id", "secrets.n_assign", "secrets.n_access", "secrets.n_hex", F.sha2("secrets.base", 256).alias("base_sha256"), "secrets.spans")
