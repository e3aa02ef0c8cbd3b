"""URL filters: host and path rules, and boosted trees on lexical features for all other urls."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from arbormetric.llm.tables import small, stored, table

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Labelled rows, in expectation, from which the trees are fitted.
FIT_ROWS = 20_000
#: Those of each label that are drawn in any case, all of them where there are fewer.
LEAST_ROWS = 500
#: Labelled rows of average rate that every suffix counts besides its own.
PRIOR = 10.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = (
    "n_url n_host n_path depth labels digits letters hyphens entropy longest_label "
    "parameters n_query fragment secure port suffix_rate site_rate"
).split()


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path; both empty without ``://``."""
    mark = F.instr(url, "://")
    rest = F.when(mark > 0, F.substr(url, mark + 3)).otherwise("")
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules=RULES) -> Column:
    """Struct ``verdict, rule`` of the longest rule that fits, else null."""
    found = []
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        found.append(F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))))
    return F.coalesce(*found)


def lexical_features(rows: DataFrame) -> DataFrame:
    """Adds to ``url, host, path`` the features that need this url alone, and its two suffixes."""
    url, host, path = F.coalesce("url", F.lit("")), F.col("host"), F.col("path")
    named = F.concat(host, path)
    count = lambda text, pattern: F.regexp_count(text, F.lit(pattern)).cast("double")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    n = F.length(named)
    share = lambda ch: (n - F.length(F.replace(named, ch, F.lit("")))) / n
    entropy = F.aggregate(F.array_distinct(F.split(named, "")), F.lit(0.0),
                          lambda s, ch: s - F.when(ch == "", 0.0).otherwise(share(ch) * F.log2(share(ch))))
    names = F.split(host, r"\.")
    return rows.withColumns({
        "n_url": F.length(url).cast("double"), "n_host": F.length(host).cast("double"), "n_path": F.length(path).cast("double"),
        "depth": count(path, "/"), "labels": F.size(names).cast("double"),
        "digits": count(named, "[0-9]") / F.greatest(n, F.lit(1)), "letters": count(named, "[A-Za-z]") / F.greatest(n, F.lit(1)),
        "hyphens": count(host, "-"), "entropy": F.when(n > 0, entropy).otherwise(0.0),
        "longest_label": F.array_max(F.transform(names, F.length)).cast("double"),
        "parameters": F.when(query == "", 0.0).otherwise(count(query, "&") + 1), "n_query": F.length(query).cast("double"),
        "fragment": F.contains(url, F.lit("#")).cast("double"), "secure": F.startswith(url, F.lit("https:")).cast("double"),
        "port": host.rlike(":[0-9]+$").cast("double"),
        "suffix": F.element_at(names, -1), "site": F.array_join(F.slice(names, -F.least(F.size(names), F.lit(2)), 2), "."),
    })


def with_suffix_rates(rows: DataFrame) -> DataFrame:
    """Adds the smoothed share of blocked urls among the labelled ones of the suffix and the site,
    counted over all rows without the row's own label."""
    total = rows.agg(F.avg("label").alias("rate")).first().rate
    mean = 0.5 if total is None else float(total)
    own = F.coalesce(F.col("label"), F.lit(0.0))
    for key, name in (("suffix", "suffix_rate"), ("site", "site_rate")):
        counts = small(stored(rows.groupBy(key).agg(F.sum("label").alias("blocked"), F.count("label").alias("of"))))
        blocked, of = F.coalesce("blocked", F.lit(0.0)) - own, F.col("of") - F.col("label").isNotNull().cast("int")
        rows = rows.join(counts, key).withColumn(name, (blocked + PRIOR * mean) / (of + PRIOR)).drop("blocked", "of")
    return rows


def fit_trees(labelled: DataFrame, fit_rows: int = FIT_ROWS) -> GBTClassificationModel | float:
    """Boosted trees from about ``fit_rows`` labelled rows, drawn by a hash of the url, evenly but for
    LEAST_ROWS of each label; the one label that there is, or 0 without any, if there are not two."""
    counts = {r.label: r.n for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return next(iter(counts), 0.0)
    parts = {k: min(1.0, max(fit_rows / sum(counts.values()), LEAST_ROWS / n)) for k, n in counts.items()}
    part = F.when(F.col("label") == 1.0, int(parts[1.0] * 1_000_000) + 1).otherwise(int(parts[0.0] * 1_000_000) + 1)
    drawn = labelled.filter(F.pmod(F.xxhash64("url", "key"), F.lit(1_000_000)) < part)
    drawn = stored(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(drawn).select("features", "label"))
    if drawn.select("label").distinct().count() < 2:
        return max(counts, key=counts.get)
    return GBTClassifier(maxIter=15, maxDepth=4, stepSize=0.2, seed=11, minInstancesPerNode=5).fit(drawn.coalesce(4))


def judge_urls(pages: DataFrame, key: str = "page_id", url: str = "url", rules=RULES, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``key, host, path, rule, verdict, score``: the verdict of the longest fitting rule, and of
    the trees where none fits (block from a score of 0.5). The labels to fit by are the verdicts of
    the rules.

    A null url has an empty host and path and is judged by the trees; rows that repeat are judged
    alike; other columns are not read. Without any labelled row everything is allowed.
    """
    host, path = url_parts(F.col(url))
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("ruled", matching_rule(F.col("host"), F.col("path"), rules)).withColumn(
        "label", F.when(F.col("ruled").isNotNull(), (F.col("ruled.verdict") == "block").cast("double")))
    rows = with_suffix_rates(lexical_features(rows))
    model = fit_trees(rows.filter("label is not null"), fit_rows)
    if isinstance(model, float):
        rows = rows.withColumn("score", F.lit(model))
    else:
        rows = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows))
        rows = rows.withColumn("score", vector_to_array("probability")[1])
    return rows.select(
        F.col("key").alias(key), "host", "path", F.col("ruled.rule").alias("rule"),
        F.coalesce("ruled.verdict", F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score")


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))
