"""URL filter: domain rules, and a linear model for every other address.

The model is a logistic regression on hashed character n-grams of host and path,
fitted on a small table of labelled addresses.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii

#: Rules of the filter: address prefix without scheme, verdict.
RULES = (
    ("net/", "block"),
    ("example.net/en/", "allow"),
    ("example.com/de/", "block"),
    ("org/fr/", "allow"),
)
#: Character n-gram lengths and hashed features of the model.
GRAMS = (3, 4, 5)
FEATURES = 1 << 14
#: Words of addresses that the small labelled table is made of.
UNWANTED = (
    "casino-win", "free-bets", "cheap-pills", "online-casino", "poker-bonus", "bet-now",
    "buy-pills", "viagra-shop", "adult-cams", "xxx-videos", "replica-watches", "fast-loans",
    "lottery-winner", "crypto-giveaway", "free-slots", "hot-singles", "cheap-meds", "win-cash",
    "ads-server", "ad-tracker", "click-track", "link-farm", "spam-mail", "adult-content",
)
WANTED = (
    "library", "university", "recipes", "weather", "museum", "gardening", "news", "history",
    "science", "travel", "docs", "school", "health", "music", "stories", "archive",
    "research", "community", "nation", "station", "attention", "edition", "northern", "another",
    "theory", "theatre", "together", "leather", "within", "strength", "earth", "mother",
    "thinking", "nothing", "evening", "reading", "interesting", "thread", "either", "brother",
    "possible", "table", "notable", "readable", "hence", "present", "different", "student",
    "where", "there", "those", "method", "athlete", "author", "clothes", "width",
    "city-library", "open-data", "state-museum", "free-school", "north-coast", "read-along",
    "farm-stories", "tracks-and-trails", "winter-sports", "cash-economy",
)
_HOSTS = ("{}.example.com", "www.{}.example.org", "m.{}.example.com", "blog.{}.example.org")
_PATHS = ("/en/1204", "/de/33.html", "/fr/871/", "/es/5500")


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The default training table: ``url, label`` (1: block), a few hundred rows."""
    def rows(words: tuple[str, ...], label: int) -> Column:
        urls = [f"https://{h.format(w)}{p}" for w in words for h, p in zip(_HOSTS, _PATHS, strict=True)]
        return F.transform(F.array(*map(F.lit, urls)), lambda u: F.struct(u.alias("url"), F.lit(label).alias("label")))

    one = spark.range(1)
    return one.select(F.explode(F.concat(rows(UNWANTED, 1), rows(WANTED, 0))).alias("x")).select("x.*")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path.  A null url, or one without ``://``, has both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return lower_ascii(host), path


def matching_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits (null: none).

    A rule fits its host and all subdomains, for paths that begin with its own.
    ``rules`` is a configured list, so it becomes part of the expression.
    """
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        rule_host, slash, rule_path = rule.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(slash + rule_path)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def grams(host: Column, path: Column, lengths=GRAMS) -> Column:
    """Character n-grams of host and of path, marked with their part and ends."""
    def of(text: Column, mark: str) -> Column:
        framed = F.concat(F.lit("^"), text, F.lit("$"))
        each = [
            F.when(
                F.length(framed) >= n,
                F.transform(
                    F.sequence(F.lit(1), F.greatest(F.length(framed) - (n - 1), F.lit(1))),
                    lambda i, n=n: F.concat(F.lit(mark), F.substring(framed, i, n)),
                ),
            ).otherwise(F.array().cast("array<string>"))
            for n in lengths
        ]
        return F.concat(*each)

    return F.concat(of(host, "h:"), of(path, "p:"))


def fit(labelled: DataFrame, features: int = FEATURES, lengths=GRAMS) -> PipelineModel:
    """Logistic regression on ``labelled`` (``url, label``); a small table.

    Rows without a label are left out.  Read in one partition, so that reruns
    give the same weights.
    """
    host, path = split_url(F.col("url"))
    train = labelled.where("label is not null").select(
        grams(host, path, lengths).alias("_grams"), F.col("label").cast("double").alias("_label")
    ).coalesce(1)
    return Pipeline(
        stages=[
            HashingTF(inputCol="_grams", outputCol="_features", numFeatures=features, binary=True),
            LogisticRegression(
                featuresCol="_features", labelCol="_label", regParam=0.01, maxIter=100,
                rawPredictionCol="_raw", probabilityCol="_probability", predictionCol="_prediction",
            ),
        ]
    ).fit(train)


def judge_urls(
    pages: DataFrame,
    labelled: DataFrame | None = None,
    rules=RULES,
    id_col: str = "page_id",
    url_col: str = "url",
    threshold: float = 0.5,
) -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` for every row of ``pages``.

    A row that a rule fits has the rule's verdict; any other is blocked if the
    model's ``score`` (probability of block) reaches ``threshold``.  Null and
    malformed addresses have an empty host and path and are judged by the model.
    Other columns of ``pages`` are not read; an empty table gives no rows.
    """
    model = fit(labelled if labelled is not None else labelled_urls(pages.sparkSession))
    host, path = split_url(F.col("_url"))
    parts = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("_url")).select(
        "page_id", host.alias("host"), path.alias("path")
    )
    parts = parts.withColumn("rule", matching_rule(F.col("host"), F.col("path"), rules)).withColumn(
        "_grams", grams(F.col("host"), F.col("path"))
    )
    scored = model.transform(parts).withColumn("score", vector_to_array("_probability")[1])
    ruled = F.lit(None).cast("string")
    for rule, verdict in rules:
        ruled = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(ruled)
    by_model = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce(ruled, by_model).alias("verdict"), "score")
