"""URL filters: host and path rules, and gradient-boosted trees on lexical features for what no rule decides.

Features are computed from the URL's characters alone: lengths, depth, digit ratio, entropy, parameter counts, hyphens,
and statistics of the host's suffixes (how often a suffix stands among labelled URLs, and the smoothed share of them
that are to be blocked). A URL's own label never enters its suffix statistics: they come from the other folds.

Trees are fitted by Spark ML to at most `MAX_LABELLED` distinct labelled URLs, those with the smallest hashes. Statistics
of suffixes are counted over all distinct labelled URLs; a table of suffixes is broadcast up to `MAX_SENT` rows and
joined by a shuffle beyond. Judging is column expressions.

Without labels of both kinds there is no model: the score is the share of labels to block (0.5 without any) for all.
Null URLs, and those without `://`, have an empty host and path; they are judged by their features, of which most are
0. Repeated URLs count once in training. Columns besides the URL pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise.llm.shared import checkpointed
from slotwise.llm.texts import lower_ascii

MAX_LABELLED = 20_000
MAX_SENT = 100_000
FOLDS = 5
SMOOTHING = 20.0
TREES, DEPTH, RATE = 20, 4, 0.2


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def longest_rule(rules: tuple[Rule, ...], host: Column, path: Column) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, else null."""
    name, verdict = F, F
    for rule in sorted(rules, key=lambda r: (-len(r.name), r.name)):
        name = name.when(rule.fits(host, path), F.lit(rule.name))
        verdict = verdict.when(rule.fits(host, path), F.lit(rule.verdict))
    return name, verdict


def _count(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{pattern}]", "")).cast("double")


def _entropy(text: Column) -> Column:
    """Bits per character."""
    n = F.length(text)

    def add(total: Column, c: Column) -> Column:
        share = (n - F.length(F.replace(text, c, F.lit("")))) / n
        return total - share * F.log2(share)

    letters = F.array_distinct(F.split(text, "(?!^)(?!$)"))
    return F.when(n > 0, F.aggregate(letters, F.lit(0.0), add)).otherwise(0.0)


def lexical(url: Column) -> dict[str, Column]:
    """Features of a URL by name."""
    whole = F.coalesce(url, F.lit(""))
    host, path = host_of(url), path_of(url)
    query = F.regexp_extract(whole, r"\?([^#]*)", 1)
    size = F.greatest(F.length(whole), F.lit(1)).cast("double")
    return {
        "url_length": F.length(whole).cast("double"),
        "host_length": F.length(host).cast("double"),
        "path_length": F.length(path).cast("double"),
        "query_length": F.length(query).cast("double"),
        "depth": _count(F.rtrim(path, F.lit("/")), "/"),
        "labels": _count(host, "."),
        "longest_label": F.array_max(F.transform(F.split(host, r"\."), F.length)).cast("double"),
        "digit_ratio": _count(whole, "0-9") / size,
        "host_digits": _count(host, "0-9"),
        "host_hyphens": _count(host, r"\-"),
        "path_hyphens": _count(path, r"\-_"),
        "escapes": _count(whole, "%"),
        "signs_ratio": (size - _count(whole, "A-Za-z0-9")) / size,
        "host_entropy": _entropy(host),
        "path_entropy": _entropy(path),
        "parameters": F.when(query != "", _count(query, "&") + 1).otherwise(0.0),
        "vowel_ratio": _count(host, "aeiou") / F.greatest(F.length(host), F.lit(1)),
        "secure": whole.startswith("https://").cast("double"),
    }


def _suffix(host: Column, labels: int) -> Column:
    return F.substring_index(host, ".", -labels)


def _statistics(n: Column, blocked: Column, suffix: str) -> list[Column]:
    return [F.log1p(n).alias(f"{suffix}_seen"),
            ((blocked + 0.5 * SMOOTHING) / (n + SMOOTHING)).alias(f"{suffix}_rate")]


def _sent(table: DataFrame) -> DataFrame:
    """A checkpointed table, to be broadcast if its rows are few enough."""
    return F.broadcast(table) if table.count() <= MAX_SENT else table


class UrlModel:
    """Trees and suffix statistics; `score` adds the estimated chance that a URL is to be blocked."""

    SUFFIXES = {"suffix1": 1, "suffix2": 2}

    def __init__(self, trees: PipelineModel | None, prior: float, suffixes: dict[str, DataFrame]):
        self.trees, self.prior, self.suffixes = trees, prior, suffixes

    @staticmethod
    def names() -> list[str]:
        return [*lexical(F.col("url")), *(f"{s}_{x}" for s in UrlModel.SUFFIXES for x in ("seen", "rate"))]

    def score(self, urls: DataFrame, url: str = "url", into: str = "score") -> DataFrame:
        if self.trees is None:
            return urls.withColumn(into, F.lit(self.prior))
        held = F.struct(*(F.col(f"`{c}`") for c in urls.columns if c.lower() != into.lower())).alias("_row")
        rows = urls.select(held, F.col(url).alias("_url"))
        rows = rows.select("_row", "_url", *(_suffix(host_of(F.col("_url")), n).alias(s) for s, n in self.SUFFIXES.items()))
        for suffix, table in self.suffixes.items():
            rows = rows.join(table, suffix, "left")
        rows = _features(rows, F.col("_url"))
        return self.trees.transform(rows).select("_row.*", vector_to_array("probability")[1].alias(into))


def _features(rows: DataFrame, url: Column) -> DataFrame:
    known = {f"{s}_{x}": F.coalesce(F.col(f"{s}_{x}"), F.lit(default)) for s in UrlModel.SUFFIXES
             for x, default in (("seen", 0.0), ("rate", 0.5))}
    return rows.withColumns(lexical(url) | known)


def train(labelled: DataFrame, url: str = "url", label: str = "label", most: int = MAX_LABELLED, seed: int = 7) -> UrlModel:
    """A model from URLs with label 1 (block) or 0; rows without either teach nothing."""
    usable = labelled.select(F.col(url).alias("url"), F.col(label).cast("int").alias("label")).filter(
        "url is not null and label in (0, 1)")
    distinct = checkpointed(
        usable.groupBy("url").agg(F.max("label").alias("label"))
        .withColumns({s: _suffix(host_of(F.col("url")), n) for s, n in UrlModel.SUFFIXES.items()})
        .withColumn("fold", F.pmod(F.hash("url"), F.lit(FOLDS))))
    sample = checkpointed(distinct.orderBy(F.xxhash64("url"), "url").limit(most))
    n, blocked = sample.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if blocked in (0, n):
        return UrlModel(None, blocked / n if n else 0.5, {})
    rows, suffixes = sample, {}
    for suffix in UrlModel.SUFFIXES:
        counts = checkpointed(distinct.groupBy(suffix, "fold").agg(F.count("*").alias("n"), F.sum("label").alias("b")))
        whole = counts.groupBy(suffix).agg(F.sum("n").alias("all_n"), F.sum("b").alias("all_b"))
        suffixes[suffix] = _sent(checkpointed(whole.select(suffix, *_statistics(F.col("all_n"), F.col("all_b"), suffix))))
        # Of each fold, statistics over the others, for what the sample holds.
        held = sample.select(suffix, "fold").distinct()
        rest = whole.join(held, suffix).join(counts, [suffix, "fold"]).select(
            suffix, "fold", *_statistics(F.col("all_n") - F.col("n"), F.col("all_b") - F.col("b"), suffix))
        rows = rows.join(rest, [suffix, "fold"], "left")
    assembler = VectorAssembler(inputCols=UrlModel.names(), outputCol="features")
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=RATE, seed=seed, labelCol="label", cacheNodeIds=False)
    ready = checkpointed(assembler.transform(_features(rows, F.col("url"))).select("features", "label"))
    model = PipelineModel([assembler, trees.fit(ready)])
    return UrlModel(model, blocked / n, suffixes)
