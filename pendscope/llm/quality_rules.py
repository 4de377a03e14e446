"""Quality rules judged together with the host they come from.

A text alone tells little about a borderline case. Failures of each rule are summed by domain, the
domain's rate is shrunk towards the rate of all domains by a beta prior fitted to them (moments), and
the domain's verdict is joined back: a failed rule counts against a document where its domain fails
that rule too often, and elsewhere only together with a second failed rule. A document that fails no
rule is kept whatever its domain."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pendscope.llm.common import BROADCAST_IDS, broadcast_if_small, stored, text_key

RULES = {  # a document fails where the condition holds
    "symbols": "10 * n_symbols > n_words",
    "mostly_symbols": "n_symbols > n_words",
    "dup_lines": "n_dup_lines > 1 AND 10 * n_dup_lines > 3 * n_lines",
    "repeats": "10 * n_repeat_words > 3 * n_words",
    "word_length": "word_chars < 3 * n_words OR word_chars > 12 * n_words",
}
BASE = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"
HOST_RATE = 0.3  # a domain fails a rule above this shrunk rate
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
_SPACE = " \t\n\v\f\r"


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a window of three found twice or more."""
    n = len(words)
    first: dict[bytes, int] = {}
    ids = np.fromiter(map(first.setdefault, words, range(n)), np.int64, n)
    if n < 4 or len(first) == n:
        return 0
    pairs = np.unique(ids[:-2] * n + ids[1:-1], return_inverse=True)[1]
    _, which, found = np.unique(pairs * n + ids[2:], return_inverse=True, return_counts=True)
    twice = found[which] > 1
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[shift:n - 2 + shift] |= twice
    return int(covered.sum())


def counts(text: str | None) -> tuple[int, ...]:
    if not text:
        return (0,) * 6
    words = text.encode("utf-8", "surrogatepass").split()  # bytes split at exactly space and \t to \r
    lines = [line for line in text.split("\n") if line.strip(_SPACE)]
    return (len(words), len(text) - sum(map(text.count, _SPACE)), sum(map(text.count, "#*$%&|<>")), len(lines),
            len(lines) - len(set(lines)), repeated_words(words))


@F.pandas_udf(T.StructType([T.StructField(name, T.LongType()) for name in COUNTS]))
def text_counts(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([counts(text) for text in texts], columns=list(COUNTS))


def host_verdicts(judged: DataFrame) -> DataFrame:
    """Per domain one flag per rule: the shrunk rate is above ``HOST_RATE``.

    With rates p of the domains, m their mean and v their variance, the prior has strength
    m(1-m)/v - 1, held between 1 and 1000; a rule that no domain or every domain fails alike gets 1000."""
    hosts = judged.groupBy("host").agg(F.count("*").alias("n"), *(F.sum(F.col(f"fails_{r}").cast("long")).alias(r) for r in RULES))
    moments = hosts.agg(*(f(F.col(r) / F.col("n")).alias(f"{r}_{name}") for r in RULES for name, f in (("m", F.avg), ("v", F.var_pop))))
    for r in RULES:
        strength = F.expr(f"if({r}_v > 1e-12, greatest(1D, least(1000D, {r}_m * (1 - {r}_m) / {r}_v - 1)), 1000D)")
        moments = moments.withColumn(f"{r}_s", strength)
    over_all = moments.select(F.struct(*moments.columns)).scalar()  # one row, as a subquery
    return hosts.withColumn("all", over_all).select("host", *(
        F.expr(f"({r} + `all`.{r}_s * `all`.{r}_m) / (n + `all`.{r}_s) > {HOST_RATE}D").alias(f"host_{r}") for r in RULES))


def quality(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """One row per row of ``docs``: key, the counts, base_failed, failed (names of failed rules), kept.

    Null and empty texts have no words and fail the base. A null host is a host of its own. Repeated rows
    are judged each and count each for their host; an empty table gives no rows. The counts are stored once, so
    the text is read once; the hosts' table is one row per host and is broadcast only where a count proves it small."""
    plain = docs.select(F.col(key).alias("key"), text_key(host).alias("host"), text_counts(F.col(text)).alias("c")).select("key", "host", "c.*")
    judged = plain.withColumn("base_failed", F.expr(BASE))
    for name, rule in RULES.items():
        judged = judged.withColumn(f"fails_{name}", F.expr(rule))
    judged = stored(judged, "quality")
    hosts = stored(host_verdicts(judged), "quality-hosts")
    failed = " + ".join(f"int(fails_{r})" for r in RULES)
    in_host = " OR ".join(f"(fails_{r} AND host_{r})" for r in RULES)
    return judged.join(broadcast_if_small(hosts), "host").selectExpr(
        f"key AS `{key}`", *COUNTS, "base_failed",
        "array_compact(array(" + ", ".join(f"if(fails_{r}, '{r}', null)" for r in RULES) + ")) AS failed",
        f"NOT base_failed AND NOT ({in_host}) AND {failed} < 2 AS kept")


def quality_rules(docs: DataFrame) -> DataFrame:
    return quality(docs).drop("n_lines", "failed")


def kept_documents(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with the columns of ``docs``. Of rows that share an id all stay if one is kept."""
    judged = quality(docs).groupBy("doc_id").agg(F.max("kept").alias("kept"))
    gone = stored(judged.filter("NOT kept").select("doc_id"), "quality-gone")
    return docs.join(broadcast_if_small(gone, BROADCAST_IDS), docs["doc_id"].eqNullSafe(gone["doc_id"]), "left_anti")
