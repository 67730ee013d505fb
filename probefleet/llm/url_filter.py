"""URL filters: rules first, and gradient-boosted trees on lexical features for the URLs that no rule covers.

Native: DataFrame functions and Spark's own tree learner only. The URLs that a rule covers are the labelled ones.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: About this many labelled URLs, by a hash of the URL, fit the trees.
SAMPLE_ROWS = 50_000
TREES, DEPTH, BINS = 8, 3, 32
#: Hosts are in one of so many folds; a labelled URL's suffix rate comes from the other folds' labels.
FOLDS = 5
#: Weight of the overall share of blocked URLs in the share of a suffix.
PRIOR_ROWS = 20

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """Covers its host and all subdomains, where the URL's path starts with path."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("block", "net", "/"),
    Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"),
)

FEATURES = (
    "url_length", "host_length", "path_length", "depth", "host_labels", "digit_ratio", "host_digits", "entropy",
    "n_parameters", "query_length", "n_hyphens", "has_fragment", "is_https", "suffix_share", "suffix_block_rate",
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What stands between the first `://` and the path, A-Z lower-cased; the path up to `?` or `#`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def first_rule(rules: tuple[Rule, ...], value: str) -> Column:
    """The name or verdict of the longest rule that covers host and path; null without one."""
    host, path, out = F.col("host"), F.col("path"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        covers = ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)
        out = F.when(covers, F.lit(getattr(rule, value))).otherwise(out)
    return out


def _count(text: Column, what: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(what), F.lit("")))


def _entropy(text: Column) -> Column:
    """Entropy in bits of a text's characters."""
    shares = F.transform(
        F.array_distinct(F.filter(F.split(text, ""), lambda c: c != "")),
        lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / F.length(text),
    )
    return -F.aggregate(shares, F.lit(0.0), lambda total, p: total + p * F.log2(p))


def lexical(urls: DataFrame) -> DataFrame:
    """Adds suffix and all features but those of the suffix to rows with url (not null), host and path."""
    url, host = F.col("_url"), F.col("host")
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    digits = F.length(F.regexp_replace(url, "[^0-9]", ""))
    numbers = {
        "url_length": F.length(url),
        "host_length": F.length(host),
        "path_length": F.length("path"),
        "depth": _count(F.col("path"), "/"),
        "host_labels": F.size(F.split(host, r"\.")),
        "digit_ratio": digits / F.greatest(F.length(url), F.lit(1)),
        "host_digits": F.length(F.regexp_replace(host, "[^0-9]", "")),
        "entropy": _entropy(url),
        "n_parameters": F.size(F.filter(F.split(query, "&"), lambda x: x != "")),
        "query_length": F.length(query),
        "n_hyphens": _count(url, "-"),
        "has_fragment": url.contains("#").cast("int"),
        "is_https": url.startswith("https:").cast("int"),
    }
    out = {name: F.coalesce(value.cast("double"), F.lit(0.0)) for name, value in numbers.items()}
    return urls.withColumns(out | {"suffix": F.element_at(F.split(host, r"\."), -1)})


def with_suffix_statistics(rows: DataFrame) -> DataFrame:
    """Adds the share of all URLs and the smoothed share of blocked labelled URLs of each suffix.

    For a labelled URL the labels of its own fold of hosts do not count, so its own label is no feature of it.
    """
    fold = F.pmod(F.xxhash64("host"), F.lit(FOLDS)).cast("int")
    blocked, labelled = F.col("label") == 1, F.col("label").isNotNull()
    counts = rows.groupBy("suffix").agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.count_if(blocked & (fold != k)).alias(f"_blocked_{k}") for k in range(FOLDS)],
        *[F.count_if(labelled & (fold != k)).alias(f"_labelled_{k}") for k in range(FOLDS)],
        F.count_if(blocked).alias("_blocked"),
        F.count_if(labelled).alias("_labelled"),
    )
    total = counts.agg(F.sum("_n").alias("n"), F.sum("_blocked").alias("blocked"), F.sum("_labelled").alias("labelled")).first()
    prior = (total["blocked"] or 0) / max(total["labelled"] or 0, 1)

    def rate(part: str) -> Column:
        return (F.col(f"_blocked{part}") + PRIOR_ROWS * prior) / (F.col(f"_labelled{part}") + PRIOR_ROWS)

    statistics = counts.select(
        "suffix",
        (F.col("_n") / F.lit(max(total["n"] or 0, 1))).alias("suffix_share"),
        F.array(*(rate(f"_{k}") for k in range(FOLDS))).alias("_others"),
        rate("").alias("_all"),
    )
    found = rows.join(statistics, "suffix")
    return found.withColumn("suffix_block_rate", F.when(labelled, F.get("_others", fold)).otherwise(F.col("_all"))).drop("_others", "_all")


def judge_urls(
    pages: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS, keep: tuple[str, ...] = ("page_id",)
) -> DataFrame:
    """keep, host, path, rule and verdict (allow or block) of every row of pages.

    A null url, or one without `://`, has an empty host and path and is judged as an empty URL. Equal URLs get equal
    verdicts. Where the rules cover no URL, or all alike, nothing can be learned and the rest is allowed. Columns other
    than url and those kept are not read.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select(*keep, "url").withColumns({"host": host, "path": path, "_url": F.coalesce("url", F.lit(""))})
    rows = rows.withColumns({"rule": first_rule(rules, "name"), "_verdict": first_rule(rules, "verdict")})
    rows = rows.withColumn("label", F.when(F.col("_verdict").isNotNull(), (F.col("_verdict") == "block").cast("int")))
    seen = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not seen.get(0) or not seen.get(1):
        return rows.select(*keep, "host", "path", "rule", F.coalesce("_verdict", F.lit("allow")).alias("verdict"))
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="_features")
    rows = vectors.transform(with_suffix_statistics(lexical(rows)))
    # A hash of the URL spreads evenly over 2**20, so the sample has about sample_rows rows on any input.
    share = min(1.0, sample_rows / (seen[0] + seen[1]))
    chosen = F.col("label").isNotNull() & (F.pmod(F.xxhash64("_url"), F.lit(1 << 20)) < int(share * (1 << 20)))
    learner = GBTClassifier(
        featuresCol="_features", labelCol="label", predictionCol="_blocked", maxIter=TREES, maxDepth=DEPTH, maxBins=BINS, seed=1
    )
    learner = learner.setRawPredictionCol("_raw").setProbabilityCol("_probability")
    model = learner.fit(rows.where(chosen).select("_features", F.col("label").cast("double").alias("label")))
    learned = F.when(F.col("_blocked") == 1, F.lit("block")).otherwise(F.lit("allow"))
    return model.transform(rows).select(*keep, "host", "path", "rule", F.coalesce("_verdict", learned).alias("verdict"))
