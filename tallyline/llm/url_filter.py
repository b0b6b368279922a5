"""Judging URLs: rules by host and path, and gradient-boosted trees on lexical features for all others."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.llm.shared import spread_sample, stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Labelled URLs the trees are fitted on, at most, and the trees themselves.
TRAINING_ROWS, TREES, DEPTH, SEED = 20_000, 20, 4, 7
#: URLs of a higher probability are blocked.
THRESHOLD = 0.5
#: Labelled URLs that a suffix counts besides its own, at the mean rate.
SMOOTHING = 20.0
FEATURES = (
    "url_length", "host_length", "path_length", "depth", "labels", "hyphens", "digit_ratio", "entropy", "parameters",
    "suffix_rate", "suffix_share",
)


@dataclass(frozen=True)
class Rule:
    """A verdict for a host with all subdomains and every path that begins with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path): what is between the first :// and / ? # in lower case (A-Z), and from there up to ? #. Else empty."""
    pattern = r"^(?s:.*?)://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(url, pattern, 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, pattern, 2), F.lit(""))


def rule_for(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """(name, verdict) of the longest rule that fits, null without one. The rules are a short list."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    # The last condition put around the others is asked first.
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name = F.when(fits, rule.name).otherwise(name)
        verdict = F.when(fits, rule.verdict).otherwise(verdict)
    return name, verdict


def lexical(rows: DataFrame) -> DataFrame:
    """``rows`` (with url, host, path) with the lexical features and ``suffix``, the host's last label."""
    url = F.coalesce("url", F.lit(""))
    size = F.greatest(F.length(url), F.lit(1))
    letters = F.array_distinct(F.split(url, ""))
    # Of each different character: how often it is in the URL.
    shares = F.transform(letters, lambda c: (F.length(url) - F.length(F.replace(url, c, F.lit("")))) / size)
    entropy = F.aggregate(shares, F.lit(0.0), lambda s, p: s - F.when(p > 0, p * F.log2(p)).otherwise(0.0))

    def occurrences(text: Column, mark: str) -> Column:
        return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))

    return rows.select(
        "*",
        F.length(url).cast("double").alias("url_length"),
        F.length("host").cast("double").alias("host_length"),
        F.length("path").cast("double").alias("path_length"),
        occurrences(F.col("path"), "/").cast("double").alias("depth"),
        occurrences(F.col("host"), ".").cast("double").alias("labels"),
        occurrences(F.col("host"), "-").cast("double").alias("hyphens"),
        (F.length(F.regexp_replace(url, "[^0-9]", "")) / size).alias("digit_ratio"),
        entropy.alias("entropy"),
        (occurrences(url, "?") + occurrences(url, "&")).cast("double").alias("parameters"),
        F.element_at(F.split("host", r"\."), -1).alias("suffix"),
    )


def suffix_statistics(labelled: DataFrame) -> DataFrame:
    """(suffix, suffix_rate, suffix_share): blocked share of a suffix's labelled URLs, smoothed, and its share of all."""
    rows = labelled.groupBy("suffix").agg(F.count("*").alias("n"), F.sum("label").alias("bad"))
    total = labelled.agg(F.count("*").alias("all_n"), F.sum("label").alias("all_bad")).first()
    n, bad = total["all_n"] or 1, total["all_bad"] or 0.0
    return rows.select(
        F.col("suffix").alias("__suffix"),
        ((F.col("bad") + SMOOTHING * bad / n) / (F.col("n") + SMOOTHING)).alias("suffix_rate"),
        (F.col("n") / n).alias("suffix_share"),
    )


def _vectors(rows: DataFrame, statistics: DataFrame) -> DataFrame:
    joined = rows.join(statistics, rows["suffix"] == statistics["__suffix"], "left").fillna(
        0.0, ["suffix_rate", "suffix_share"]
    )
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(joined).drop("__suffix")


def fit(labelled: DataFrame, rows: int = TRAINING_ROWS) -> tuple[GBTClassificationModel | None, DataFrame]:
    """The trees and the suffix statistics from URLs with a ``label`` (1: block), at most ``rows`` of them.

    The rows with the least hash of their URL are taken, as many of either label.
    Without both labels there is nothing to learn and no model.
    """
    host, path = parts(F.col("url"))
    labelled = labelled.select("url", F.col("label").cast("double").alias("label")).dropna()
    halves = [
        spread_sample(labelled.filter(F.col("label") == label), F.col("url"), rows // 2)
        for label in (0.0, 1.0)
    ]
    sample = halves[0].unionByName(halves[1]).select("url", "label", host.alias("host"), path.alias("path"))
    sample = stage(lexical(sample), "url-training")
    statistics = stage(suffix_statistics(sample), "url-suffixes")
    if sample.select("label").distinct().count() < 2:
        return None, statistics
    trees = GBTClassifier(
        featuresCol="features", labelCol="label", maxIter=TREES, maxDepth=DEPTH, seed=SEED,
    )
    # A bounded sample: one partition saves a job's overhead for each level of each tree.
    return trees.fit(_vectors(sample, statistics).select("features", "label").coalesce(1)), statistics


def listed_labels(urls: DataFrame, words: tuple[str, ...]) -> DataFrame:
    """(url, label): URLs labelled by a word list; 1 where a word is a whole part of the host between dots and hyphens."""
    host, _ = parts(F.col("url"))
    found = F.arrays_overlap(F.split(host, r"[.\-]"), F.array(*[F.lit(w) for w in words]))
    return urls.filter(host != "").select("url", found.cast("double").alias("label"))


def judged(
    urls: DataFrame, rules: list[Rule], labelled: DataFrame, training_rows: int = TRAINING_ROWS,
    threshold: float = THRESHOLD, id_col: str = "page_id", url_col: str = "url",
) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for every row of ``urls``.

    ``verdict`` is that of the longest fitting rule, else block where the trees'
    probability ``score`` exceeds the threshold. A null URL and one without ://
    have an empty host and path and are judged by the trees like any other; without
    a model nothing is blocked but by rules. Repeated rows come out each time, a
    null id stays; other columns are not read.
    """
    model, statistics = fit(labelled, training_rows)
    host, path = parts(F.col("url"))
    rows = urls.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    rows = rows.select("*", host.alias("host"), path.alias("path"))
    if model is None:
        scores = rows.withColumn("score", F.lit(None).cast("double"))
    else:
        scores = model.transform(_vectors(lexical(rows), statistics)).withColumn(
            "score", vector_to_array("probability")[1]
        )
    name, verdict = rule_for(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("score") > threshold, "block").otherwise("allow")
    return scores.select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "score")
