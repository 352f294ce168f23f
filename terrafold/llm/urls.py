"""URL filters: host and path rules first, gradient-boosted trees on lexical features for the rest.

The rules (a bounded list, a parameter) label the URLs that they fit; a bounded sample of those trains the trees, which
judge the others. Features are the URL's lengths, depth, digit ratio, character entropy, parameter counts and what the
labelled URLs show for its host suffixes. All of it is column expressions and the DataFrame-based learner.

A null URL, or one without ``://``, has an empty host and path, fits no rule and gets the trees' verdict on empty
features. With no labelled URL the verdict is allow, with one class only it is that class. Repeated rows are judged
alike, ties of rule length go to the smaller rule, an empty table gives an empty result, extra columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop, written

RULES = (
    ("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"),
)
#: Labelled rows that the trees are fitted on, about; the share drawn follows from the count of all labelled rows.
LABELLED_ROWS = 20_000
TREES, DEPTH = 10, 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased and path, both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_fit(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule in sorted(rules, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]])):  # the longest is tested first
        h, slash, p = rule.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


def entropy(s: Column) -> Column:
    """Bits a character, from how often each distinct character occurs."""
    n = F.length(s).cast("double")
    share = lambda c: (n - F.length(F.replace(s, c, F.lit("")))) / n
    chars = F.array_distinct(F.filter(F.split(s, ""), lambda c: c != ""))
    return F.when(n > 0, F.aggregate(chars, F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c)))).otherwise(0.0)


def count(s: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(s, f"[^{pattern}]+", "")).cast("double")


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Features of the URL alone."""
    n = F.length(url).cast("double")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    return {
        "f_length": n, "f_host": F.length(host).cast("double"), "f_path": F.length(path).cast("double"),
        "f_depth": count(path, "/"), "f_labels": count(host, "."), "f_hyphens": count(url, r"\-"),
        "f_digits": F.when(n > 0, count(url, "0-9") / n).otherwise(0.0), "f_path_digits": count(path, "0-9"),
        "f_entropy": entropy(url), "f_params": F.when(query != "", count(query, "&") + 1).otherwise(0.0),
        "f_fragment": F.instr(url, "#").cast("boolean").cast("double"),
        "f_https": url.startswith("https:").cast("double"), "f_slash": path.endswith("/").cast("double"),
    }


#: Parts of a URL for which block rates are learned: last label, last two labels, first path step, file ending.
PARTS = {
    "last": lambda host, path: F.substring_index(host, ".", -1),
    "two": lambda host, path: F.substring_index(host, ".", -2),
    "step": lambda host, path: F.regexp_extract(path, "^/([^/]*)", 1),
    "ending": lambda host, path: F.regexp_extract(path, r"\.([A-Za-z0-9]{1,8})$", 1),
}


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, labelled_rows: int = LABELLED_ROWS) -> DataFrame:
    """page_id, host, path, rule, verdict and the trees' block probability (null where a rule decides)."""
    host, path = host_and_path(F.col("url"))
    df = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce(host, F.lit("")).alias("host"),
                      F.coalesce(path, F.lit("")).alias("path"))
    name, verdict = rule_fit(F.col("host"), F.col("path"), rules)
    df = df.withColumns({"rule": name, "ruled": verdict})
    n, blocked = df.agg(F.count("ruled"), F.count_if(F.col("ruled") == "block")).first()
    if blocked in (0, n):
        other = F.lit("block" if n else "allow")
        return df.select("page_id", "host", "path", "rule", F.coalesce("ruled", other).alias("verdict"), F.lit(None).cast("double").alias("p_block"))

    steps = 1_000_000
    drawn = F.pmod(F.xxhash64("page_id", "url"), F.lit(steps)) < max(1, int(steps * min(1.0, labelled_rows / n)))
    sample = df.where(F.col("ruled").isNotNull() & drawn).limit(2 * labelled_rows)
    sample = sample.select("url", "host", "path", (F.col("ruled") == "block").cast("double").alias("label"))
    sample, path_of_sample = written(sample, "labelled-urls")
    try:
        model, rates = fit(sample)
        scored = score(df, model, rates)
    finally:
        drop(pages.sparkSession, path_of_sample)
    return scored.select(
        "page_id", "host", "path", "rule",
        F.coalesce("ruled", F.when(F.col("p") >= 0.5, "block").otherwise("allow")).alias("verdict"),
        F.when(F.col("ruled").isNull(), F.col("p")).alias("p_block"),
    )


def keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumns({f"k_{part}": of(F.col("host"), F.col("path")) for part, of in PARTS.items()})


def with_rates(rows: DataFrame, counts: Column, blocked: Column, part: str) -> DataFrame:
    """Adds the smoothed block rate of a part and how often it was seen; 0.5 and 0 where it was not."""
    n, hits = F.greatest(F.coalesce(counts, F.lit(0.0)), F.lit(0.0)), F.coalesce(blocked, F.lit(0.0))
    return rows.withColumns({f"f_{part}": (hits + 0.5) / (n + 1), f"f_{part}_n": F.log1p(n)})


def fit(sample: DataFrame, folds: int = 5) -> tuple[GBTClassificationModel, list[DataFrame]]:
    """The trees of a bounded sample (url, host, path, label 0 or 1) of both classes, and the block counts of each part.

    A row's rates are those of the other folds, so no label is among its own features; folds go by host.
    """
    rows = keyed(sample).withColumn("fold", F.pmod(F.xxhash64("host"), F.lit(folds)))
    rates = []
    for part in PARTS:
        key = f"k_{part}"
        seen = rows.groupBy(key).agg(F.count("label").cast("double").alias("n"), F.sum("label").alias("hits"))
        own = rows.groupBy(key, "fold").agg(F.count("label").cast("double").alias("own_n"), F.sum("label").alias("own_hits"))
        rates.append(sample.sparkSession.createDataFrame(seen.toPandas(), seen.schema))  # at most as many rows as the sample
        both = own.join(seen, key).select(key, "fold", (F.col("n") - F.col("own_n")).alias("n"), (F.col("hits") - F.col("own_hits")).alias("hits"))
        rows = with_rates(rows.join(both, [key, "fold"], "left"), F.col("n"), F.col("hits"), part).drop("n", "hits")
    learner = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=7, stepSize=0.3)
    return learner.fit(featured(rows).select("features", "label")), rates


def featured(rows: DataFrame) -> DataFrame:
    """Rows with rates and ``features``."""
    alone = lexical(F.col("url"), F.col("host"), F.col("path"))
    names = [*alone, *(f"f_{p}{x}" for p in PARTS for x in ("", "_n"))]
    return VectorAssembler(inputCols=names, outputCol="features").transform(rows.withColumns(alone))


def score(rows: DataFrame, model: GBTClassificationModel, rates: list[DataFrame]) -> DataFrame:
    """The rows (url, host, path) with ``p``, the trees' probability of block."""
    rows = keyed(rows)
    for part, seen in zip(PARTS, rates, strict=True):  # bounded by the sample, so broadcast
        rows = with_rates(rows.join(F.broadcast(seen), f"k_{part}", "left"), F.col("n"), F.col("hits"), part).drop("n", "hits")
    return model.transform(featured(rows)).withColumn("p", vector_to_array("probability")[1])
