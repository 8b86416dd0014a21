"""Secrets in texts: three fixed kinds, and strings that pass for random.

Candidates are unbroken strings of an encoding's signs, with a letter and a digit, that no fixed kind covers. Their
encoding is inferred (hexadecimal, base32, base36, base62 or base64), and a battery asks whether their signs could be
uniform and independent: chi-squared over classes of signs (digits, frequent and rare letters of either case, signs), the
runs of signs of one class, and the lag-one correlation of vowels. The three p-values become one (Fisher).

To report a string that was put together from words (an identifier, a path, a slug) is the false discovery. So the null
hypothesis is such a string: NULL holds how often it reaches a p-value by chance, by encoding, and how that falls with its
length. Within each band of lengths the Benjamini-Hochberg step over these null p-values decides what is
reported, at a given rate. Short strings need a good p-value, long ones pass with any that 99 of 100 random strings have.
Only bounded counts by band and p-value leave the rows: the texts are scanned once.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import written

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = ("assign", "access", "hex", "random")
#: signs of a candidate at least: below this, words with a number and random strings can't be told apart
LEAST = 16
CANDIDATE = rf"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{{{LEAST},}}={{0,2}}"

#: name, null, signs in their order, what a string must match; the first that fits is taken
ENCODINGS = (
    ("hex", "hex", "0123456789abcdef", r"^(?=.*[0-9])(?=.*[a-f])[0-9a-f]+$"),
    ("HEX", "hex", "0123456789ABCDEF", r"^(?=.*[0-9])(?=.*[A-F])[0-9A-F]+$"),
    ("base32", "upper", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", r"^(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]+=*$"),
    ("base36", "lower", "0123456789abcdefghijklmnopqrstuvwxyz", r"^(?=.*[0-9])(?=.*[a-z])[0-9a-z]+$"),
    ("BASE36", "upper", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", r"^(?=.*[0-9])(?=.*[A-Z])[0-9A-Z]+$"),
    ("base62", "mixed", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", r"^(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])[0-9A-Za-z]+$"),
    ("base64", "mixed", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", r"^(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])[0-9A-Za-z+/]+=*$"),
    ("base64url", "mixed", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", r"^(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])[0-9A-Za-z_-]+=*$"),
)

#: Of strings of LEAST signs put together from words and numbers, the logarithm of the share that reaches a combined p-value
#: of GRID, and what it loses with each further sign (3,000 simulated strings a length, the losses rounded down).
GRID = (0.01, 0.05, 0.1, 0.2, 0.4)
NULL = {
    "mixed": ((-0.75, -1.30, -1.65, -2.25, -3.0), (0.20, 0.25, 0.25, 0.25, 0.25)),
    "lower": ((-0.42, -1.00, -1.40, -2.00, -3.0), (0.11, 0.20, 0.25, 0.25, 0.25)),
    "upper": ((-0.26, -0.56, -0.75, -1.10, -1.7), (0.06, 0.11, 0.15, 0.20, 0.25)),
    "hex": ((-0.38, -0.85, -1.20, -2.20, -3.0), (0.09, 0.17, 0.25, 0.25, 0.25)),
}


def bin_of(sign: str, kind: str) -> int:
    """The class of a sign that chi-squared counts."""
    if kind == "hex":
        return "0123456789abcdef".index(sign.lower()) // 5
    if sign.isdigit():
        return 0
    if not sign.isalpha():
        return 5
    return (1 if sign.isupper() else 3) + (sign.lower() not in "etaoinsr")


def case_of(sign: str) -> int:
    """The class of a sign whose runs are counted."""
    return 0 if sign.isdigit() else 1 if sign.isupper() else 2 if sign.islower() else 3


def _shares(signs: str, of: Callable[[str], int]) -> list[float]:
    return [sum(of(c) == k for c in signs) / len(signs) for k in range(6)]


_SPAN = "array<struct<start:int,end:int,found:string>>"


def matches(text: Column, pattern: str, first: str, at_once: int = 64) -> Column:
    """array<struct<start, end, found>> in code points; `first` is a cheap pattern that must occur at all. Places are
    summed up in runs of `at_once` matches, so that a text of very many costs little more for each."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    zipped = F.zip_with(F.slice(between, 1, F.size(found)), found, lambda g, m: F.struct(g.alias("gap"), m.alias("found")))
    none = F.array().cast(_SPAN)

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.length(x["found"])
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(F.struct(start.alias("start"), end.alias("end"), x["found"].alias("found")))).alias("spans"))

    def runs(z: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(z) - 1) / at_once).cast("int")), lambda k: F.slice(z, k * at_once + 1, at_once))
        return F.transform(parts, lambda part: F.aggregate(part, F.struct(F.lit(0).alias("at"), none.alias("spans")), step))

    def joined(acc: Column, run: Column) -> Column:
        moved = F.transform(run["spans"], lambda s: F.struct((s["start"] + acc["at"]).alias("start"), (s["end"] + acc["at"]).alias("end"), s["found"].alias("found")))
        return F.struct((acc["at"] + run["at"]).alias("at"), F.concat(acc["parts"], F.array(moved)).alias("parts"))

    whole = _let(zipped, lambda z: F.aggregate(runs(z), F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("parts")), joined, lambda acc: F.flatten(acc["parts"])))
    return F.when(text.rlike(first), F.when(F.size(found) > 0, whole).otherwise(none)).otherwise(none)


def normal_tail(z: Column) -> Column:
    """P(|N| > |z|), by Abramowitz and Stegun 26.2.17 (error below 1e-7)."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.least(F.lit(1.0), 2 * 0.3989422804014327 * F.exp(-x * x / 2) * poly)


def _upper_tail(z: Column) -> Column:
    """P(N > z)."""
    return F.when(z >= 0, normal_tail(z) / 2).otherwise(1 - normal_tail(z) / 2)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once: expressions stay small, however often it is named."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _of_encoding(values: list, enc: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), enc + 1)


def battery(found: Column, enc: Column) -> Column:
    """Combined p-value that the signs of `found` are uniform over those of encoding number `enc`, and independent.

    Chi-squared: classes of signs (Wilson and Hilferty's normal). Runs: changes of case, against their mean and deviation among
    independent signs. Serial correlation: of vowels, at lag one, times the root of n; 0.3 where there is no vowel. Fisher's
    sum of the three.
    """
    bins = [[bin_of(c, kind) for c in signs] for _, kind, signs, _ in ENCODINGS]
    shares = [_shares(signs, lambda c, k=kind: bin_of(c, k)) for _, kind, signs, _ in ENCODINGS]
    cases = [_shares(signs, case_of) for _, _, signs, _ in ENCODINGS]
    same, cube = [sum(q * q for q in c) for c in cases], [sum(q**3 for q in c) for c in cases]
    signs_of = _of_encoding([signs for _, _, signs, _ in ENCODINGS], enc)

    def told(of: list[str]) -> Column:
        return F.call_function("translate", found, signs_of, _of_encoding(of, enc))

    def sums(x: Column) -> Column:
        n = F.length(x["bins"]).cast("double")
        observed = lambda k: F.length(x["bins"]) - F.length(F.translate(x["bins"], str(k), ""))
        chi = F.lit(0.0)
        for k in range(6):
            e = n * _of_encoding([s[k] for s in shares], enc)
            chi = chi + F.when(e > 0, (observed(k) - e) * (observed(k) - e) / e).otherwise(0.0)
        change = 1 - _of_encoding(same, enc)
        var = (n - 1) * change * (1 - change) + 2 * (n - 2) * (_of_encoding(cube, enc) - (1 - change) * (1 - change))
        changes = F.regexp_count(x["cases"], F.lit(r"(.)\1*")) - 1
        vowels = (F.length(x["vowels"]) - F.length(F.translate(x["vowels"], "1", ""))).cast("double")
        mean = vowels / n
        ends = F.substring(x["vowels"], 1, 1).cast("double") + F.substring(x["vowels"], -1, 1).cast("double")
        lag = F.regexp_count(x["vowels"], F.lit("1(?=1)")) - mean * (2 * vowels - ends) + (n - 1) * mean * mean
        square = vowels * (1 - mean)
        df = _of_encoding([float(sum(q > 0 for q in s) - 1) for s in shares], enc)
        return F.struct(
            ((F.cbrt(chi / df) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))).alias("chi"),
            ((changes - (n - 1) * change) / F.sqrt(var)).alias("runs"),
            F.when(square > 0, lag / square * F.sqrt(n)).alias("serial"),
        )

    def combined(x: Column) -> Column:
        p = F.array(_upper_tail(x["chi"]), normal_tail(x["runs"]), F.when(x["serial"].isNotNull(), normal_tail(x["serial"])).otherwise(0.3))
        half = F.aggregate(p, F.lit(0.0), lambda acc, y: acc - F.log(F.greatest(y, F.lit(1e-300))))
        return _let(half, lambda h: F.least(F.lit(1.0), F.exp(-h) * (1 + h + h * h / 2)))

    text = F.struct(
        told(["".join(map(str, b)) for b in bins]).alias("bins"),
        told(["".join(str(case_of(c)) for c in signs) for _, _, signs, _ in ENCODINGS]).alias("cases"),
        told(["".join(str(int(c.lower() in "aeiou")) for c in signs) for _, _, signs, _ in ENCODINGS]).alias("vowels"),
    )
    return _let(_let(text, sums), combined)


def null_log(p: Column, n: Column, enc: Column) -> Column:
    """Minus the logarithm of the chance that a string of `n` signs put together from words has a combined p-value of `p` or more:
    between the points of GRID in a straight line over log p; 0 below the first, and beyond the last as there."""
    x = F.log10(p)
    at = lambda k: -(_of_encoding([NULL[kind][0][k] for _, kind, _, _ in ENCODINGS], enc) - (n - LEAST) * _of_encoding([NULL[kind][1][k] for _, kind, _, _ in ENCODINGS], enc))
    out = at(len(GRID) - 1)
    for k in reversed(range(len(GRID) - 1)):
        low, high = math.log10(GRID[k]), math.log10(GRID[k + 1])
        out = F.when(p < GRID[k + 1], at(k) + (at(k + 1) - at(k)) * (x - low) / (high - low)).otherwise(out)
    return F.when(p < GRID[0], F.lit(0.0)).otherwise(out)


def _examined(found: Column) -> Column:
    """Candidates with their null p-value's logarithm; those of no encoding (words, numbers, paths) are left out."""

    def of(s: Column) -> Column:
        which = F.lit(None).cast("int")
        for i in reversed(range(len(ENCODINGS))):
            which = F.when(s["found"].rlike(ENCODINGS[i][3]), F.lit(i)).otherwise(which)
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), F.rtrim(s["found"], F.lit("=")).alias("found"), which.alias("enc"))

    known = F.filter(F.transform(found, of), lambda s: s["enc"].isNotNull())

    def test(s: Column) -> Column:
        n = F.length(s["found"])
        p = _let(battery(s["found"], s["enc"]), lambda p: null_log(p, n, s["enc"]))
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), F.least(F.lit(9), F.floor(2 * F.log2(n / F.lit(float(LEAST))))).cast("int").alias("band"), _step(p).alias("step"))

    return F.transform(known, test)


def thresholds(tests: DataFrame, rate: float) -> DataFrame:
    """(band, cut): null p-values of step `cut` or beyond (of 10^-0.05, as numbers 0..400) are reported in a band.

    Benjamini-Hochberg over counts: at most bands * 401 rows. Bands are half octaves of length.
    """
    counts = tests.groupBy("band", "step").agg(F.count("*").alias("n"))
    counts = counts.selectExpr("band", "step", "n", "sum(n) OVER (PARTITION BY band) AS m", "sum(n) OVER (PARTITION BY band ORDER BY step DESC) AS r")
    largest = F.pow(F.lit(10.0), -F.col("step") / 20)  # of the null p-values of a step
    return counts.where(largest <= F.lit(rate) * F.col("r") / F.col("m")).groupBy("band").agg(F.min("step").alias("cut"))


def _step(log: Column) -> Column:
    return F.least(F.lit(400), F.floor(20 * log)).cast("int")


def _of_kind(spans: Column | str, kind: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end")))


def scan(docs: DataFrame, rate: float = 0.05, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *keep, spans) with spans array<struct<start, kind, end>>, kind 0..3 as in KINDS, by start, kind.

    A null or empty text has none; repeated rows and null ids each give a row; an empty table gives none.
    Texts of any length are scanned whole. Spans of the method ("random") overlap no span of the fixed kinds; a
    string shorter than LEAST, or without a digit or a letter, is never one. `rate` bounds the share of strings put together
    from words among them, in each band of lengths. Other columns are ignored.
    """
    base = docs.select(F.col(doc_id).alias("doc_id"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], F.coalesce(F.col(text), F.lit("")).alias("_t"))
    t = F.col("_t")
    base = base.withColumn("_assign", F.filter(matches(t, ASSIGN, r"(?i)(?:passw(?:or)?d|secret|token|api_?key)[\"']?\x20*[:=]"), lambda s: F.length(F.regexp_extract(s["found"], ASSIGN, 2)) >= 8))
    base = base.withColumn("_access", matches(t, r"AKIA[A-Z0-9]{12,}", r"AKIA[A-Z0-9]{12}"))  # runs are whole: as AKIA[A-Z0-9]+ of 16 or more
    base = base.withColumn("_hex", matches(t, r"[0-9a-f]{32,}", r"[0-9a-f]{32}"))
    base = base.withColumn("_long", matches(t, CANDIDATE, CANDIDATE))
    fixed = F.concat(*[_of_kind(c, k) for k, c in enumerate(("_assign", "_access", "_hex"))])
    base = base.withColumn("_fixed", fixed)
    free = F.filter("_long", lambda s: ~F.exists("_fixed", lambda f: (f["start"] < s["end"]) & (f["end"] > s["start"])))
    base = base.withColumn("_tests", _examined(free))
    kept = [f"_k{i}" for i in range(len(keep))]
    table = written(base.select("doc_id", *kept, "_fixed", "_tests"), "spans")  # no texts, unless `keep` has them
    cuts = thresholds(table.select(F.explode("_tests").alias("s")).select("s.band", "s.step"), rate)
    cut_of = F.broadcast(cuts.agg(F.map_from_entries(F.collect_list(F.struct("band", "cut"))).alias("_cuts")))  # one row, a map of ten
    random = F.filter("_tests", lambda s: s["step"] >= F.coalesce(F.element_at("_cuts", s["band"]), F.lit(401)))
    spans = F.array_sort(F.concat("_fixed", _of_kind(random, 3)))
    return table.join(cut_of).select("doc_id", *[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], spans.alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def digest(docs: DataFrame, rate: float = 0.05) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans): counts by kind, the digest of the fixed kinds'
    list, and the whole list, for each row of `docs`."""
    s = F.col("spans")
    count = lambda k: F.size(F.filter(s, lambda x: x["kind"] == k)).cast("long")
    fixed = F.filter(s, lambda x: x["kind"] < 3)
    return scan(docs, rate).select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(listed(fixed), 256).alias("base_sha256"), listed(s).alias("spans"))


def redact(docs: DataFrame, rate: float = 0.05, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """`docs` with every span of its texts replaced by `mark`; overlapping spans become one. Rows without
    spans come back unchanged, null texts stay null. Repeated rows each come back, an empty table gives no rows."""
    whole = docs.select(F.col(text).alias("text"), F.struct(*docs.columns).alias("row"))
    found = scan(whole, rate, "text", "text", ("row",)).select("row", "spans")
    t = F.col("row")[text]
    step = lambda acc, s: F.struct(
        F.greatest(acc["at"], s["end"]).alias("at"),
        F.when(s["start"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], F.array(F.substring(t, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark)))).alias("out"),
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    clean = F.aggregate("spans", start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(t, acc["at"] + 1, F.length(t))))
    out = F.when(F.size("spans") > 0, clean).otherwise(t)
    return found.select(*[out.alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns])
