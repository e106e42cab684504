"""Secret scans: fixed patterns and a randomness test battery.

Besides the fixed patterns, runs of 20 or more characters that an encoding
could have made are candidates: hexadecimal, base 32, or letters and digits in
base 62 or 64.  Their symbols go through three tests of the hypothesis that
they are random: chi-squared uniformity over the encoding's alphabet, the
number of runs above and below the middle of the alphabet, and the correlation
of neighbours.  The smallest of the three p-values, times three, is the
candidate's.  Candidates whose randomness is rejected are not secrets.  The
rejections are controlled for false discoveries (Benjamini-Hochberg) within
each length band, as tests of long strings see more: among the strings thrown
out of a band, the expected share of random ones is at most ``RATE``.  What is
left, and touches no pattern's span, is reported.

P-values are counted in bins of 1/50 of a decimal order, so control needs no
sorting and covers all candidates of the table.

Null and empty texts have no spans.  Places are code points, ends exclusive.
Rows with equal ids get a row each.  An empty table gives no rows.  Other
columns do not matter.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatlens.llm import native, shared

ASSIGN = (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "random")
LEAST = {"assign": 8, "access": 16, "hex": 32}
#: A whole run of encoding characters with a digit; the look-behind lets the search begin at starts of runs only.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{20,}+"
RATE = 0.05
_BINS_PER_ORDER, _LAST_BIN = 50, 1000

_LETTERS = string.ascii_letters + string.digits
#: Encodings in the order they are tried: name, what their strings look like, alphabet.
ENCODINGS = (
    ("hex", r"^(?=.*[0-9])(?=.*[a-fA-F])([0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef"),
    ("base32", r"^(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]+$", string.ascii_uppercase + "234567"),
    ("base62", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9]+$", _LETTERS),
    ("base64", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9+/_-]+$", _LETTERS + "+/"),
)


def _located(text: Column, pattern: str, kind: str) -> Column:
    """Matches of a pattern, leftmost and not overlapping, as structs (start, rank, kind, end, found).

    Splitting by the pattern gives what stands between matches; lengths of both add up to places.
    """
    none = F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint,found:string>>")
    group = 2 if kind == "assign" else 0
    both = F.struct(F.split(text, pattern, -1).alias("gaps"),
                    F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"),
                    F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("values"))

    def summed(m: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            start = acc["at"] + F.length(F.get(m["gaps"], i))
            end = start + F.length(F.get(m["hits"], i))
            span = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"),
                            end.alias("end"), F.get(m["values"], i).alias("found"))
            long_enough = F.length(F.get(m["values"], i)) >= LEAST.get(kind, 0)
            return F.struct(end.alias("at"), F.when(long_enough, F.concat(acc["spans"], F.array(span)))
                            .otherwise(acc["spans"]).alias("spans"))
        return F.aggregate(native.indices(F.size(m["hits"])),
                           F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("spans")), step,
                           lambda acc: acc["spans"])
    return F.when(text.rlike(pattern), native.bound(both, summed)).otherwise(none)


def _tail(z: Column) -> Column:
    """Upper tail of the normal distribution for z >= 0 (Abramowitz and Stegun 26.2.17)."""
    t = 1 / (1 + 0.2316419 * z)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * poly


def p_value(found: Column, alphabet: str) -> Column:
    """Of the hypothesis that a string is random over an alphabet: three times the least of three tests' p-values."""
    k = len(alphabet)
    tidy = F.translate(found, "-_", "+/") if k == 64 else F.lower(found) if k == 16 else found
    low = alphabet[:k // 2]
    sides = F.translate(tidy, alphabet, "a" * len(low) + "b" * (k - len(low)))

    def times(text: Column, part: str) -> Column:
        return (F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)
    counted = F.struct(
        F.length(tidy).cast("double").alias("n"),
        F.transform(F.split(tidy, ""), lambda c: (F.instr(F.lit(alphabet), c) - 1).cast("double")).alias("x"),
        F.transform(F.array(*[F.lit(c) for c in alphabet]),
                    lambda c: F.length(tidy) - F.length(F.replace(tidy, c, F.lit("")))).alias("of"),
        times(sides, "a").alias("below"), (times(sides, "ab") + times(sides, "ba") + 1).alias("runs"))

    def total(values: Column, of) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + of(v))

    def combined(c: Column) -> Column:
        n, x = c["n"], c["x"]
        chi = total(c["of"], lambda m: (m * m).cast("double")) * k / n - n
        free = k - 1
        uniform = (F.pow(F.greatest(chi / free, F.lit(0.0)), F.lit(1 / 3)) - (1 - 2 / (9 * free))) / math.sqrt(2 / (9 * free))
        p_uniform = F.when(uniform >= 0, _tail(uniform)).otherwise(1 - _tail(-uniform))
        twice = 2 * c["below"] * (n - c["below"])
        spread = twice * (twice - n) / (n * n * (n - 1))
        z_runs = F.when(spread > 0, F.abs(c["runs"] - 1 - twice / n) / F.sqrt(spread)).otherwise(F.lit(40.0))
        s1, s2 = total(x, lambda v: v), total(x, lambda v: v * v)
        s12 = F.aggregate(native.indices(F.size(x) - 1), F.lit(0.0),
                          lambda acc, i: acc + F.get(x, i) * F.get(x, i + 1)) + F.get(x, F.size(x) - 1) * F.get(x, F.lit(0))
        vary = n * s2 - s1 * s1
        z_serial = F.when(vary > 0, F.abs((n * s12 - s1 * s1) / vary) * F.sqrt(n)).otherwise(F.lit(40.0))
        return F.least(F.lit(1.0), 3 * F.least(p_uniform, 2 * _tail(z_runs), 2 * _tail(z_serial)))
    return native.bound(counted, combined)


def _tested(spans: Column) -> Column:
    """Candidates that fit an encoding, with their length band and p-value bin."""
    def one(span: Column) -> Column:
        p = F.lit(None).cast("double")
        for _, looks, alphabet in reversed(ENCODINGS):
            p = F.when(span["found"].rlike(looks), p_value(span["found"], alphabet)).otherwise(p)
        order = -F.log10(F.greatest(p, F.lit(1e-300)))
        return F.struct(span["start"].alias("start"), span["rank"].alias("rank"), span["kind"].alias("kind"),
                        span["end"].alias("end"), F.floor(F.log2(F.length(span["found"]))).cast("int").alias("band"),
                        F.least(F.floor(order * _BINS_PER_ORDER), F.lit(_LAST_BIN)).cast("int").alias("bin"))
    return F.filter(F.transform(spans, one), lambda s: s["bin"].isNotNull())


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, the spans of the patterns, and the tested candidates that touch none of them."""
    text = F.coalesce(F.col("text"), F.lit(""))
    plain = [_located(text, p, k) for p, k in ((ASSIGN, "assign"), (ACCESS, "access"), (HEX_LONG, "hex"))]
    found = docs.select("doc_id", F.sort_array(F.concat(*plain)).alias("base"),
                        _located(text, CANDIDATE, "random").alias("runs"))
    free = F.filter("runs", lambda r: ~F.exists("base", lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"])))
    return found.select("doc_id", "base", _tested(free).alias("candidates"))


#: Runs of hexadecimal characters are maximal, so asking for the length in the pattern changes nothing but speed.
HEX_LONG = r"(?<![0-9a-f])[0-9a-f]{32,}+"


def thresholds(candidates: DataFrame, rate: float = RATE) -> dict[int, int]:
    """For each length band the first p-value bin (of growing evidence) whose strings are not random."""
    counts: dict[int, dict[int, int]] = {}
    for r in candidates.groupBy("band", "bin").agg(F.count("*").alias("n")).collect():   # bands x bins at most
        counts.setdefault(r.band, {})[r.bin] = r.n
    cut = {}
    for band, bins in counts.items():
        total, below, cut[band] = sum(bins.values()), 0, _LAST_BIN + 1
        for b in sorted(bins, reverse=True):
            below += bins[b]
            if 10 ** (-b / _BINS_PER_ORDER) <= rate * below / total:    # the largest p of the bin
                cut[band] = b
    return cut


def scan(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """doc_id, ``base`` spans of the patterns and ``spans`` of patterns and battery, of every row."""
    shared.prepare(docs.sparkSession)
    rows = shared.staged(scanned(docs), "secret-candidates")
    cut = thresholds(rows.select(F.inline("candidates")), rate)
    limit = F.create_map(*[F.lit(x) for pair in cut.items() for x in pair]) if cut else None
    kept = F.filter("candidates", lambda c: c["bin"] < limit[c["band"]]) if cut else F.array()

    def places(spans: Column) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"),
                                                     s["kind"].alias("kind"), s["end"].alias("end")))
    more = places(kept) if cut else F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint>>")
    return rows.select("doc_id", places(F.col("base")).alias("base"),
                       F.sort_array(F.concat(places(F.col("base")), more)).alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
