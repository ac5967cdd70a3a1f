"""URL verdicts: listed rules first, gradient-boosted trees on lexical features for the rest."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framespan.llm.boosting import Trees, fit

#: (verdict, rule): a rule is a host and the beginning of a path.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Labelled URLs that the trees are fitted on, at most.
MAX_TRAINING_ROWS = 20_000
#: Host suffixes are counted in so many buckets.
SUFFIX_BUCKETS = 256
CUT = 0.5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PATTERN = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), _PATTERN, 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), _PATTERN, 2)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    name = verdict = F.lit(None).cast("string")
    for own, rule in sorted(rules, key=lambda x: len(x[1])):  # the last that fits is the longest
        rule_host, slash, rule_path = rule.partition("/")
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(slash + rule_path))
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(own)).otherwise(verdict)
    return name, verdict


def _suffix_bucket(host: Column) -> Column:
    return F.pmod(F.xxhash64(F.substring_index(host, ".", -1)), F.lit(SUFFIX_BUCKETS)).cast("int")


FEATURES = ["log_length", "log_host", "log_path", "depth", "digits", "host_digits", "entropy", "host_entropy", "parameters", "fragment", "labels", "hyphens", "longest_part", "path_digits", "secure", "vowels", "suffix_share", "suffix_blocked"]


def _entropy(text: str) -> float:
    if not text:
        return 0.0
    raw = np.frombuffer(text.encode(), np.uint8)
    share = np.bincount(raw)
    share = share[share > 0] / len(raw)
    return float(-(share * np.log2(share)).sum())


def lexical(url: str, host: str, path: str, share: float, blocked: float) -> list[float]:
    """The ``FEATURES`` of a URL."""
    digits = sum(map(str.isdigit, url))
    query = url.partition("?")[2].partition("#")[0]
    parts = [p for p in path.split("/") if p]
    return [
        float(np.log1p(len(url))), float(np.log1p(len(host))), float(np.log1p(len(path))), float(len(parts)), digits / max(len(url), 1),
        sum(map(str.isdigit, host)) / max(len(host), 1), _entropy(url), _entropy(host), float(query.count("&") + bool(query)), float("#" in url),
        float(host.count(".") + 1), float(host.count("-")), float(max(map(len, parts), default=0)), sum(map(str.isdigit, path)) / max(len(path), 1),
        float(url.startswith("https:")), sum(host.count(v) for v in "aeiou") / max(len(host), 1), share, blocked,
    ]


def _lexical_udf(suffixes: dict[int, tuple[float, float]], model: Trees | None):
    def rows(url: pa.Array, host: pa.Array, path: pa.Array, bucket: pa.Array) -> np.ndarray:
        found = [lexical(u or "", h, p, *suffixes.get(b, (0.0, 0.5))) for u, h, p, b in zip(*(c.to_pylist() for c in (url, host, path, bucket)))]
        return np.array(found, np.float64).reshape(-1, len(FEATURES))

    if model is None:

        @F.arrow_udf(T.ArrayType(T.DoubleType()))
        def features(url: pa.Array, host: pa.Array, path: pa.Array, bucket: pa.Array) -> pa.Array:
            return pa.array(list(rows(url, host, path, bucket)), pa.list_(pa.float64()))

        return features

    @F.arrow_udf(T.DoubleType())
    def score(url: pa.Array, host: pa.Array, path: pa.Array, bucket: pa.Array) -> pa.Array:
        return pa.array(model.probability(rows(url, host, path, bucket)))

    return score


_INPUTS = ("url", "host", "path", "bucket")


def parts_of(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, url, host, path, bucket, rule and the rule's verdict (label)."""
    cut = pages.select("page_id", F.col("url").cast("string").alias("url"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return cut.select("*", _suffix_bucket(F.col("host")).alias("bucket"), rule.alias("rule"), verdict.alias("label"))


def suffix_statistics(labelled: DataFrame) -> dict[int, tuple[float, float]]:
    """Of each bucket of host suffixes (at most ``SUFFIX_BUCKETS``): its share of all URLs, and of its labelled URLs the share blocked."""
    found = labelled.groupBy("bucket").agg(F.count("*").alias("n"), F.count("label").alias("known"), F.count(F.when(F.col("label") == "block", 1)).alias("blocked")).collect()
    total = max(sum(r["n"] for r in found), 1)
    return {r["bucket"]: (r["n"] / total, (r["blocked"] + 1) / (r["known"] + 2)) for r in found}


def train(labelled: DataFrame, suffixes: dict[int, tuple[float, float]]) -> Trees:
    """Fit on distinct URLs (url, host, path, bucket) with a label, block or allow; at most ``MAX_TRAINING_ROWS``, chosen by hash."""
    known = labelled.where("label is not null").dropDuplicates(["url"]).orderBy(F.xxhash64("url"), "url").limit(MAX_TRAINING_ROWS)
    rows = known.select((F.col("label") == "block").cast("int").alias("y"), _lexical_udf(suffixes, None)(*_INPUTS).alias("x")).collect()
    x = np.array([r["x"] for r in rows], np.float64).reshape(-1, len(FEATURES))
    return fit(x, np.array([r["y"] for r in rows], np.float64), depth=3, trees=40)


def op3(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, score (null where a rule decides).

    The URLs that rules decide are the labelled ones. Null URLs and URLs without ``://``
    have an empty host and path and are judged by the trees; repeated rows are judged alike,
    and a URL is learned from once however often it stands there. Further columns, whatever
    their names, are ignored; no rows give none.
    """
    cut = parts_of(pages)
    suffixes = suffix_statistics(cut)
    score = _lexical_udf(suffixes, train(cut, suffixes))
    scored = cut.select("page_id", "host", "path", "rule", "label", score(*_INPUTS).alias("p"))
    by_trees = F.when(F.col("p") >= CUT, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select("page_id", "host", "path", "rule", F.coalesce("label", by_trees).alias("verdict"), F.when(F.col("label").isNull(), F.col("p")).alias("score"))
