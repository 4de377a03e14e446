"""Secrets in text: fixed patterns, and tokens that no test can tell from random characters.

A run of key characters is cut at each = that is not padding at its end, so that a name and its value stand apart. A
token that holds digits and letters is read as hexadecimal, base 32, base 36 or base 64; where none fits, its parts
between / are tokens of their own, and where none fits these, the parts between _ and -.
Three tests ask whether its characters could be uniform draws from that alphabet: chi-squared on the counts
(Wilson-Hilferty normal value), the number of runs in the upper and lower half of the alphabet, and the serial
correlation of neighbours. Fisher's sum makes one p-value of them, uniform for truly random tokens and near 0
for ordinary ones. Per alphabet and length class the share of random tokens follows from the upper half of the
p-values (Storey), and the lowest threshold is taken at which no more than ``FALSE_SHARE`` of the tokens above it
are expected to be ordinary: short tokens, on which the tests are weak, get a stricter one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pendscope.llm.common import broadcast_if_small, stored
from pendscope.llm.spans import matches


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


ASSIGN = (f"({'|'.join(map(_any_case, ('password', 'passwd', 'secret', 'token')))}|{_any_case('api')}_?{_any_case('key')})"
          r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = "AKIA[A-Z0-9]{16,}"  # maximal runs, so the bound on the length can be in the pattern
HEX = "[0-9a-f]{24,}"
LEAST = 20
TOKEN = f"[A-Za-z0-9+/_=-]{{{LEAST},}}"
KINDS = ("assign", "access", "hex", "random")
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ALPHABETS = {  # name: alphabet, what its tokens look like
    "hex": (DIGITS + "abcdef", "word RLIKE '^[0-9a-f]+$'"),
    "HEX": (DIGITS + "ABCDEF", "word RLIKE '^[0-9A-F]+$'"),
    "base32": (UPPER + "234567", "word RLIKE '^[A-Z2-7]+=*$'"),
    "base36": (DIGITS + LOWER, "word RLIKE '^[0-9a-z]+$'"),
    "BASE36": (DIGITS + UPPER, "word RLIKE '^[0-9A-Z]+$'"),
    "base64": (UPPER + LOWER + DIGITS + "+/", "word RLIKE '[a-z]' AND word RLIKE '[A-Z]' AND word RLIKE '^[A-Za-z0-9+/]+=*$'"),
    "base64url": (UPPER + LOWER + DIGITS + "-_", "word RLIKE '[a-z]' AND word RLIKE '[A-Z]' AND word RLIKE '^[A-Za-z0-9_-]+=*$'"),
}
FALSE_SHARE = 0.05
BINS = 200
LONGEST_CLASS = 16  # length classes of eight characters, the last one open


def _upper_tail(z: str) -> str:
    """Upper tail of the normal distribution (Abramowitz and Stegun 26.2.17, error below 1e-7)."""
    t = f"(1 / (1 + 0.2316419D * abs({z})))"
    poly = f"{t} * (0.319381530D + {t} * (-0.356563782D + {t} * (1.781477937D + {t} * (-1.821255978D + {t} * 1.330274429D))))"
    tail = f"(exp(-{z} * {z} / 2) * 0.3989422804014327D * {poly})"
    return f"if({z} >= 0, {tail}, 1 - {tail})"


_FITS = "CASE WHEN NOT (word RLIKE '[0-9]' AND word RLIKE '[A-Za-z]') THEN NULL " + " ".join(
    f"WHEN {rule} THEN '{name}'" for name, (_, rule) in ALPHABETS.items()) + " END"


def parted(tokens: DataFrame, keys: str, all_tokens: bool = False) -> DataFrame:
    """``tokens`` (start, stop, word, ...) with those that fit no alphabet (or all) replaced by their stretches of ``keys`` of
    ``LEAST`` characters or more, padding at the end of the token included."""
    pattern = f"[{keys}]{{{LEAST},}}+(?:=++$)?|[{keys}]++=++$"
    whole = "array(named_struct('start', start, 'stop', stop, 'word', word))"
    parts = f"transform(filter(parts, s -> length(s.word) >= {LEAST}), s -> named_struct('start', start + s.start, 'stop', start + s.stop, 'word', s.word))"
    kept = [c for c in tokens.columns if c not in ("start", "stop", "word")]
    return (
        tokens.withColumn("fits", F.lit(False) if all_tokens else F.expr(f"({_FITS}) IS NOT NULL"))
        .withColumn("parts", F.when(~F.col("fits"), matches("word", pattern)))
        .select(*kept, F.explode(F.expr(f"if(fits, {whole}, {parts})")).alias("part")).select(*kept, "part.*")
    )


def randomness(spans: DataFrame) -> DataFrame:
    """``spans`` (word, ...) with alphabet name ``code`` and ``p``; both null where no alphabet fits. Needs a
    letter and a digit: digits alone are numbers and letters alone are words."""
    letters = " ".join(f"WHEN '{name}' THEN '{alphabet}'" for name, (alphabet, _) in ALPHABETS.items())
    return (
        spans.withColumn("code", F.expr(_FITS))
        .withColumn("letters", F.expr(f"CASE code {letters} END"))
        .withColumn("v", F.expr("transform(split(rtrim('=', word), ''), c -> instr(letters, c))"))
        .withColumn("n", F.expr("double(size(v))")).withColumn("m", F.expr("double(length(letters))"))
        .withColumn("square", F.expr("aggregate(sequence(1, length(letters)), 0D, (s, a) -> s + pow(size(filter(v, x -> x = a)), 2))"))
        .withColumn("chi", F.expr("square * m / n - n"))
        .withColumn("z_chi", F.expr("(pow(chi / (m - 1), 1D / 3) - (1 - 2 / (9 * (m - 1)))) / sqrt(2 / (9 * (m - 1)))"))
        .withColumn("next", F.expr("slice(v, 2, size(v))"))
        .withColumn("turns", F.expr("aggregate(zip_with(v, next, (a, b) -> int(b IS NOT NULL AND (2 * a > m) <> (2 * b > m))), 0D, (s, x) -> s + x)"))
        .withColumn("z_runs", F.expr("abs(turns - (n - 1) / 2) / sqrt((n - 1) / 4)"))
        .withColumn("product", F.expr("aggregate(zip_with(v, next, (a, b) -> if(b IS NULL, 0D, (a - (m + 1) / 2) * (b - (m + 1) / 2))), 0D, (s, x) -> s + x)"))
        .withColumn("z_serial", F.expr("abs(product) / ((m * m - 1) / 12 * sqrt(n - 1))"))
        .withColumn("x", F.expr(
            f"-2 * (ln(greatest({_upper_tail('z_chi')}, 1e-290D)) + ln(greatest(least(1D, 2 * {_upper_tail('z_runs')}), 1e-290D))"
            f" + ln(greatest(least(1D, 2 * {_upper_tail('z_serial')}), 1e-290D)))"))
        .withColumn("p", F.expr("least(1D, exp(-x / 2) * (1 + x / 2 + x * x / 8))"))
        .drop("letters", "v", "n", "m", "square", "chi", "z_chi", "next", "turns", "z_runs", "product", "z_serial", "x")
    )


def thresholds(tokens: DataFrame) -> DataFrame:
    """(code, length_class, at_least): bins of p are counted over all tokens, and every threshold between two bins is tried,
    whether a token lies there or not. At most ``BINS`` counts for each of 7 alphabets and 16 classes, whatever the input."""
    bins = tokens.groupBy("code", "length_class", F.expr(f"least(int(p * {BINS}), {BINS - 1})").alias("bin")).count()
    above = "aggregate(filter(counts, c -> c.bin >= t), 0L, (s, c) -> s + c.count)"
    return (
        bins.groupBy("code", "length_class").agg(
            F.collect_list(F.struct("bin", "count")).alias("counts"), (2 * (F.sum(F.expr(f"if(2 * bin >= {BINS}, count, 0)")) + 1)).alias("random"))
        .withColumn("at_least", F.expr(f"array_min(filter(sequence(1, {BINS - 1}), t -> 1 - try_divide((1 - t / {BINS}D) * random, {above}) <= {FALSE_SHARE})) / {BINS}"))
        .filter("at_least IS NOT NULL").select("code", "length_class", "at_least")
    )


def _label(array: str) -> Column:
    names = ", ".join(f"'{kind}'" for kind in KINDS)
    return F.expr(f"concat_ws(',', transform({array}, s -> concat(element_at(array({names}), s.kind), ':', s.start, ':', s.stop)))")


def secrets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, ``base`` and ``spans``, arrays of (start, kind, stop) by start and kind, kind
    numbered as in ``KINDS``. Random spans that touch a base span are left out.

    Null and empty texts have no spans. Rows are numbered, so repeated rows and keys stay apart. The text is read
    once; only positions and tokens are stored, and only tokens are shuffled, after counting."""
    body = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    found = body.select(
        "row", "key", matches("body", ASSIGN, 2).alias("assign"), matches("body", ACCESS).alias("access"),
        matches("body", HEX).alias("hex"), matches("body", TOKEN).alias("tokens"))
    one = "transform({0}, s -> named_struct('start', s.start, 'kind', {1}, 'stop', s.stop))"
    parts = [one.format("filter(assign, s -> length(s.inner) >= 6)", 1), one.format("access", 2), one.format("hex", 3)]
    found = found.withColumn("base", F.expr(f"array_sort(concat({', '.join(parts)}))"))
    digit = "regexp_like(s.word, '[0-9]') AND regexp_like(s.word, '[A-Za-z]')"
    found = stored(found.select("row", "key", "base", F.expr(f"filter(tokens, s -> {digit})").alias("tokens")), "secrets")

    apart = "NOT exists(base, b -> b.start < stop AND start < b.stop)"
    tokens = found.filter("size(tokens) > 0").select("row", "base", F.explode("tokens").alias("token")).select(
        "row", "base", "token.start", "token.stop", "token.word")
    tokens = parted(tokens, "A-Za-z0-9+/_-", True)
    for keys in ("A-Za-z0-9+_-", "A-Za-z0-9+"):  # each step starts from files, which keeps the plans small
        tokens = parted(stored(tokens, "secrets-parts"), keys)
    tokens = stored(tokens, "secrets-parts").select("row", "start", "stop", "word", F.expr(apart).alias("apart"))
    tokens = stored(randomness(tokens).filter("p IS NOT NULL").withColumn(
        "length_class", F.expr(f"least({LONGEST_CLASS}, int(length(word) / 8))")).drop("word"), "secrets-tokens")
    random = tokens.filter("apart").join(broadcast_if_small(thresholds(tokens)), ["code", "length_class"]).filter("p >= at_least")
    more = random.groupBy("row").agg(F.collect_list(F.expr("named_struct('start', start, 'kind', 4, 'stop', stop)")).alias("more"))
    return found.select("row", "key", "base").join(more, "row", "left").select(
        F.col("key").alias(key), "base", F.expr("array_sort(concat(base, coalesce(more, array())))").alias("spans"))


def secret_scan(docs: DataFrame) -> DataFrame:
    return secrets(docs).select(
        "doc_id", *(F.expr(f"bigint(size(filter(base, s -> s.kind = {k})))").alias(f"n_{kind}") for k, kind in enumerate(KINDS[:3], 1)),
        F.sha2(_label("base"), 256).alias("base_sha256"), _label("spans").alias("spans"))
