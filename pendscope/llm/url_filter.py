"""URL verdicts: fixed rules first, then logistic regression on hashed character n-grams of host and path.

The model is fitted on a small table of labelled URLs: the caller's (``labelled``, or a Parquet or CSV file named by the
Spark setting ``LABELLED``), else a built-in one. :func:`held_out` reports how it does on names it has not seen. Scoring is
one sum of weights per URL, in SQL functions."""

from __future__ import annotations

from collections import Counter

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RULES = (  # fixed values: host, path, verdict
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
LABELLED = "spark.pendscope.urls.labelled"
MOST_LABELLED = 20_000  # the documented bound of the fit; of a larger table those of least hash are taken
BUCKETS = 4096
GRAMS = (3, 4)
UNWANTED = ("casino-win", "casino-slots", "free-bets", "online-bets", "bets-tips", "poker-room", "cheap-pills", "pills-shop", "cheap-loans",
            "payday-loans", "ads-track", "track-ads", "adserver", "click-track", "banner-ads", "popup-ads", "spam-farm", "link-farm", "jackpot-win",
            "win-prize", "free-gifts", "adult-x", "adult-cams", "hot-dates", "replica-watch", "miracle-diet", "free-spins", "bonus-casino")
WANTED = ("library", "university", "museum", "gardens", "weather", "recipes", "science", "history", "theatre", "orchestra", "railway", "harbour",
          "village", "mountains", "teaching", "medicine", "thinker", "northern", "nation", "station", "gazette", "another", "reading",
          "gathering", "athens", "mathematics", "things", "thread", "lantern", "question")


def labelled_urls() -> list[tuple[str, int]]:
    """The labelled table: every name with the same subdomains and paths, so that only the name tells the label."""
    shapes = [f"https://{sub}{{}}.example{rest}" for sub in ("", "www.", "m.", "blog.") for rest in (".org/en/1234/", ".net/de/567.html")]
    return [(shape.format(name), label) for label, names in ((1, UNWANTED), (0, WANTED)) for name in names for shape in shapes]


def url_parts(url: str) -> tuple[str, str]:
    """SQL for host and path; both empty for null and for a URL without ``://``."""
    rest = f"if(locate('://', `{url}`) > 0, substring(`{url}`, locate('://', `{url}`) + 3), '')"
    host = f"translate(regexp_extract(coalesce({rest}, ''), '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return host, f"regexp_extract(coalesce({rest}, ''), '^[^/?#]*([^?#]*)', 1)"


def rule_sql(host: str, path: str) -> tuple[str, str]:
    """SQL for the longest rule that fits and for its verdict, null without one."""
    ordered = sorted(RULES, key=lambda rule: -len(rule[0] + rule[1]))
    fits = [f"WHEN ({host} = '{h}' OR endswith({host}, '.{h}')) AND startswith({path}, '{p}') THEN" for h, p, _ in ordered]
    rule = " ".join(f"{fit} '{h}{p}'" for fit, (h, p, _) in zip(fits, ordered))
    verdict = " ".join(f"{fit} '{v}'" for fit, (_, _, v) in zip(fits, ordered))
    return f"CASE {rule} END", f"CASE {verdict} END"


def gram_buckets(host: str, path: str) -> str:
    """SQL for the hashed n-grams. Digits count as 0; the host is marked off, so that its grams differ from the path's."""
    chars = f"split(concat('^', {host}, '$', regexp_replace({path}, '[0-9]', '0')), '')"
    grams = ", ".join(
        f"transform(sequence(1, greatest(1, size(c) - {n - 1})), i -> pmod(xxhash64(array_join(slice(c, i, {n}), '')), {BUCKETS}))" for n in GRAMS)
    return f"element_at(transform(array({chars}), c -> concat({grams})), 1)"


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    """(url, label): a CSV with a header, or Parquet. Label 1 is an unwanted URL."""
    reader = spark.read.schema("url string, label int")
    return reader.option("header", True).csv(path) if path.rstrip("/").endswith((".csv", ".csv.gz")) else reader.parquet(path)


def labelled_table(spark: SparkSession) -> DataFrame:
    """The table that the session names, else the built-in one."""
    path = spark.conf.get(LABELLED, None)
    return read_labelled(spark, path) if path else spark.createDataFrame(labelled_urls(), "url string, label int")


def fit_url_model(spark: SparkSession, labelled: DataFrame | None = None) -> tuple[float, list[float]]:
    """Intercept and ``BUCKETS`` weights: a fixed size, whatever the corpus. Rows of ``labelled`` (url, label) without a label
    of 0 or 1 are left out. At most ``MOST_LABELLED`` rows reach the fit, the same ones in every run; both labels have to be there."""
    table = (labelled_table(spark) if labelled is None else labelled).filter("label IN (0, 1)")
    table = table.select("url", "label").orderBy(F.xxhash64("url", "label"), "url", "label").limit(MOST_LABELLED)
    host, path = url_parts("url")
    rows = table.selectExpr("double(label) AS label", f"{host} AS host", f"{path} AS path").selectExpr(
        "label", f"{gram_buckets('host', 'path')} AS buckets").collect()
    if len({row["label"] for row in rows}) < 2:
        raise ValueError("the labelled table needs rows of label 0 and of label 1")
    vectors = [(row["label"], Vectors.sparse(BUCKETS, dict(Counter(row["buckets"])))) for row in rows]
    model = LogisticRegression(regParam=0.002, maxIter=100, standardization=False).fit(
        spark.createDataFrame(vectors, ["label", "features"]).coalesce(1))
    return float(model.intercept), [round(float(w), 9) for w in model.coefficients.toArray()]


def held_out(labelled: DataFrame, folds: int = 4, block_at: float = 0.5, group: str | None = None) -> DataFrame:
    """One row per fold: n, right, and of the unwanted URLs n_unwanted and caught. A URL's fold follows from ``group`` (SQL
    over ``url``; its host without ``www.`` if not given), so every group is judged by a model that has not seen it. The rules
    take no part. A fold without rows is not listed."""
    group = group or f"regexp_replace({url_parts('url')[0]}, '^www[.]', '')"
    dealt = labelled.filter("label IN (0, 1)").select("url", "label").withColumn(
        "fold", F.expr(f"int(pmod(xxhash64({group}), {folds}))"))
    found = None
    for fold in range(folds):
        judged = judge_urls(dealt.filter(f"fold = {fold}"), block_at=block_at, labelled=dealt.filter(f"fold <> {fold}"))
        found = judged if found is None else found.unionByName(judged)
    return found.groupBy("fold").agg(
        F.count("*").alias("n"), F.count_if(F.expr(f"(probability >= {block_at}) = (label = 1)")).alias("right"),
        F.count_if(F.expr("label = 1")).alias("n_unwanted"), F.count_if(F.expr(f"label = 1 AND probability >= {block_at}")).alias("caught"))


def judge_urls(pages: DataFrame, url: str = "url", block_at: float = 0.5, labelled: DataFrame | None = None) -> DataFrame:
    """``pages`` with host, path, rule, probability (of an unwanted URL, by the model) and verdict.

    A URL without a rule is blocked at ``block_at`` or more. Null URLs and those without ``://`` have an empty host and
    path and go to the model like any other; repeated rows are judged alike; columns of ``pages`` with these names are
    replaced. Rows are judged one by one: nothing is shuffled."""
    intercept, weights = fit_url_model(pages.sparkSession, labelled)
    host, path = url_parts(url)
    rule, verdict = rule_sql("host", "path")
    sum_of = f"aggregate(buckets, {intercept!r}D, (s, b) -> s + weights[int(b)])"
    keep = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "probability", "verdict", "buckets", "weights")]
    # the weights are folded to one constant array while planning
    return (
        pages.selectExpr(*(f"`{c}`" for c in keep), f"{host} AS host", f"{path} AS path")
        .withColumn("buckets", F.expr(gram_buckets("host", "path")))
        .withColumn("weights", F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>"))
        .selectExpr(*(f"`{c}`" for c in keep), "host", "path", f"{rule} AS rule", f"1 / (1 + exp(-({sum_of}))) AS probability")
        .withColumn("verdict", F.expr(f"coalesce({verdict}, if(probability >= {block_at}, 'block', 'allow'))"))
    )


def url_filter(pages: DataFrame) -> DataFrame:
    return judge_urls(pages.select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "probability")
