"""URL filters: given host and path rules, and association rules that FP-growth mines from labelled URLs."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host and path); the longest that fits wins.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: FP-growth lists every combination of a URL's tokens, so its work doubles with each. If a URL has more that may be combined, rules are mined level by level instead, with the same result.
WIDTH = 10
#: Item of every basket that has a label; URL tokens begin with h or p and a number.
LABELLED = "labelled"


def url_host(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule whose host is the URL's or a parent of it and whose path starts the URL's, and its verdict; else null."""
    fits, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for say, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # a later, longer one overrides
        rule_host, slash, rest = rule.partition("/")
        hit = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(slash + rest)
        fits, verdict = F.when(hit, F.lit(rule)).otherwise(fits), F.when(hit, F.lit(say)).otherwise(verdict)
    return fits, verdict


def url_tokens(host: Column, path: Column) -> Column:
    """Distinct tokens of a URL: its host's labels with their place from the right, its path's segments with their place."""
    labels = F.filter(F.reverse(F.split(host, r"\.")), lambda x: x != "")
    segments = F.filter(F.split(path, "/"), lambda x: x != "")
    return F.array_distinct(F.concat(
        F.transform(labels, lambda x, i: F.concat(F.lit("h"), i.cast("string"), F.lit("="), x)),
        F.transform(segments, lambda x, i: F.concat(F.lit("p"), i.cast("string"), F.lit("="), x)),
    ))


def token_counts(rows: DataFrame) -> DataFrame:
    """(token, n, known, verdict, best, same) of (row, tokens, label), rows numbered.

    ``n`` rows have the token, ``known`` of them a label, and ``best`` of these the label ``verdict``, the
    most frequent. ``same`` is equal for tokens of exactly the same rows: 128 bits of exclusive sums of
    row hashes. Everything is combined map-side, so a token that a third of all rows have is no hot key.
    """
    each = rows.select("row", "label", F.explode("tokens").alias("token"))
    by_label = each.groupBy("token", "label").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("row")).alias("a"), F.bit_xor(F.xxhash64("row", F.lit(1))).alias("b"))
    labelled = F.col("label").isNotNull()
    most = F.max(F.when(labelled, F.struct("n", "label"))).alias("most")
    by_token = by_label.groupBy("token").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(labelled, F.col("n"))), F.lit(0)).alias("known"), most, F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    return by_token.select("token", "n", "known", F.col("most.label").alias("verdict"), F.coalesce("most.n", F.lit(0)).alias("best"), F.struct("a", "b").alias("same"))


def _baskets(rows: DataFrame, useful: DataFrame) -> DataFrame:
    """(row, label, tokens) of each row: its tokens that are among ``useful`` (token, best)."""
    token = F.when(F.col("best").isNotNull(), F.col("token"))
    joined = rows.select("row", "label", F.explode_outer("tokens").alias("token")).join(useful, "token", "left")
    return materialize(joined.groupBy("row").agg(F.first("label").alias("label"), F.array_sort(F.collect_list(token)).alias("tokens")), "url-baskets")


def _by_growth(baskets: DataFrame, min_support: float, min_confidence: float, min_coverage: float) -> DataFrame:
    """Rules of two tokens and more (antecedent, verdict, confidence, support, coverage), by FP-growth over (label, tokens)."""
    label = F.when(F.col("label").isNotNull(), F.array(F.lit(LABELLED), F.concat(F.lit("label="), F.col("label")))).otherwise(F.array().cast("array<string>"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min(min_confidence, min_coverage)).fit(baskets.select(F.concat("tokens", label).alias("items")))
    found = materialize(
        model.associationRules.filter(~F.exists("antecedent", lambda x: x.startswith("label=")))
        .select(F.array_sort(F.array_remove("antecedent", LABELLED)).alias("antecedent"), F.array_contains("antecedent", LABELLED).alias("among"), F.col("consequent")[0].alias("item"), "confidence", "support")
        .filter(F.size("antecedent") > 1),
        "url-rules",
    )
    covered = found.filter((F.col("item") == LABELLED) & (F.col("confidence") >= min_coverage)).select("antecedent", F.col("confidence").alias("coverage"))
    return (
        found.filter(F.col("among") & F.col("item").startswith("label=") & (F.col("confidence") >= min_confidence))
        .select("antecedent", F.regexp_replace("item", "^label=", "").alias("verdict"), "confidence", "support")
        .join(covered, "antecedent")
    )


def _by_levels(baskets: DataFrame, useful: DataFrame, total: int, min_support: float, min_confidence: float, min_coverage: float) -> DataFrame:
    """The rules that ``_by_growth`` would add, level by level, for URLs of any depth.

    A set of tokens is extended only if it can add a rule: a label has the support, each of its subsets has
    more rows (else the subset says the same with fewer tokens), and no rule of it is certain. All
    subsets of such a set are such sets, so those of n tokens follow from pairs of those of n - 1 that
    differ in the last token, in the rows that have both. Nested segments, however deep, end at once:
    two of them have just the rows of the inner one.
    """
    held = baskets.select("row", "label", F.array().cast("array<string>").alias("head"), F.explode("tokens").alias("last"))
    sets = useful.select(F.array("token").alias("tokens"), "n")
    out = None
    for size in range(2, 1 << 20):
        a, b = held.select("row", "label", "head", "last"), held.select("row", "head", F.col("last").alias("other"))
        pairs = materialize(a.join(b, ["row", "head"]).filter("last < other").select("row", "label", F.concat("head", F.array("last")).alias("head"), F.col("other").alias("last")), "url-pairs")
        by_label = materialize(pairs.groupBy(F.concat("head", F.array("last")).alias("tokens"), "label").agg(F.count(F.lit(1)).alias("n")), "url-sets")
        labelled = F.col("label").isNotNull()
        counted = by_label.groupBy("tokens").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(labelled, F.col("n"))), F.lit(0)).alias("known"), F.max(F.when(labelled, F.col("n"))).alias("best"))
        counted = counted.filter(F.col("best") >= F.lit(min_support * total))
        parts = counted.select("tokens", "n", F.explode(F.transform(F.sequence(F.lit(1), F.lit(size)), lambda i: F.filter("tokens", lambda x, k: k + 1 != i))).alias("part"))
        smaller = sets.select(F.col("tokens").alias("part"), F.col("n").alias("of"))
        free = parts.join(smaller, "part").filter("of > n").groupBy("tokens").count().filter(F.col("count") == size).select("tokens")
        kept = materialize(counted.join(free, "tokens"), "url-free")
        confidence, coverage = F.col("m") / F.col("known"), F.col("known") / F.col("n")
        rules = (
            by_label.filter(labelled).select("tokens", F.col("label").alias("verdict"), F.col("n").alias("m")).join(kept, "tokens")
            .filter((F.col("m") >= F.lit(min_support * total)) & (confidence >= min_confidence) & (coverage >= min_coverage))
            .select(F.col("tokens").alias("antecedent"), "verdict", confidence.alias("confidence"), (F.col("m") / F.lit(total)).alias("support"), coverage.alias("coverage"))
        )
        out = rules if out is None else out.unionByName(rules)
        sets = kept.filter(~((F.col("best") == F.col("known")) & (coverage >= min_coverage))).select("tokens", "n")
        if sets.isEmpty():
            return out
        held = pairs.join(sets.select(F.slice("tokens", 1, size - 1).alias("head"), F.element_at("tokens", -1).alias("last")), ["head", "last"])


def mine_rules(labelled: DataFrame, min_support: float, min_confidence: float, min_coverage: float = 1.0, width: int = WIDTH) -> DataFrame:
    """Rules (rule_id, antecedent, verdict, confidence, support, coverage) from (tokens, label).

    A rule has the confidence of its verdict among the labelled rows with its tokens, and the coverage:
    the share of all rows with its tokens that a label vouches for. Both must reach their least, and so
    must the support, a share of all rows; a token that labels hardly ever touch says nothing about the
    rest of its rows. A rule stays if no rule with fewer tokens and the same verdict is as confident: the
    others add nothing.

    Rules of one token come from the tokens' counts, those of several from FP-growth over all rows, where
    a row with a label has the item ``labelled`` beside the label's own: ``tokens, labelled -> label`` has
    the confidence and ``tokens -> labelled`` the coverage. FP-growth lists every combination, and these
    double with each token of a row, so tokens that can add no rule leave before it: those without the
    support of a label (what stays is under average tokens / min_support tokens, whatever the number of
    rows); all but the least of tokens of exactly the same rows; and those whose own rule is certain.
    That changes no verdict. Where a row still has over ``width`` of them, rules come from ``_by_levels``,
    which gives the same ones.
    """
    rows = materialize(labelled.select("tokens", "label").filter("size(tokens) > 0 or label is not null").withColumn("row", F.monotonically_increasing_id()), "url-rows")
    total = max(1, rows.count())
    counts = token_counts(rows).filter(F.col("best") >= F.lit(min_support * total))
    least = F.min(F.struct("token", "n", "known", "verdict", "best")).alias("t")
    counts = materialize(counts.groupBy("same").agg(least).select("t.*"), "url-tokens")
    confidence, coverage = F.col("best") / F.col("known"), F.col("known") / F.col("n")
    passes = (confidence >= min_confidence) & (coverage >= min_coverage)
    single = counts.filter(passes).select(F.array("token").alias("antecedent"), "verdict", confidence.alias("confidence"), (F.col("best") / F.lit(total)).alias("support"), coverage.alias("coverage"))

    useful = counts.filter(~(passes & (F.col("best") == F.col("known")))).select("token", "n", "best")
    baskets = _baskets(rows, useful)
    if baskets.filter(F.size("tokens") > width).isEmpty():
        several = _by_growth(baskets, min_support, min_confidence, min_coverage)
    else:
        several = _by_levels(baskets, useful, total, min_support, min_confidence, min_coverage)
    mined = materialize(single.unionByName(several), "url-rules-covered")
    wide, narrow = mined.alias("w"), mined.alias("n")
    # a rule and its generalisations share a token, so this is an equi-join over the exploded antecedents
    dominated = (
        wide.withColumn("token", F.explode("antecedent")).alias("w")
        .join(narrow.withColumn("token", F.explode("antecedent")).alias("n"), ["token", "verdict"])
        .filter((F.size("n.antecedent") < F.size("w.antecedent")) & (F.size(F.array_except("n.antecedent", "w.antecedent")) == 0) & (F.col("n.confidence") >= F.col("w.confidence")))
        .select(F.col("w.antecedent").alias("antecedent"), "verdict").distinct()
    )
    return mined.join(dominated, ["antecedent", "verdict"], "left_anti").withColumn("rule_id", F.xxhash64("antecedent", "verdict"))


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(key, verdict, rule_id, confidence) of the best mined rule of each URL that has one; ``urls`` has (key, tokens).

    Inverted index from token to rules: a rule matches when as many of its tokens hit as it has. Spark
    broadcasts the index by its own size check and shuffles both sides beyond that. The most confident
    rule wins, then the better supported, then the smallest id.
    """
    index = rules.select(F.explode("antecedent").alias("token"), "rule_id", F.size("antecedent").alias("needs"), "verdict", "confidence", "support")
    hits = urls.select("key", F.explode("tokens").alias("token")).join(index, "token")
    matched = hits.groupBy("key", "rule_id", "needs", "verdict", "confidence", "support").count().filter("count = needs")
    best = F.max(F.struct("confidence", "support", (-F.col("rule_id")).alias("order"), "rule_id", "verdict"))
    return matched.groupBy("key").agg(best.alias("best")).select("key", "best.verdict", "best.rule_id", "best.confidence")


def filter_urls(
    urls: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    rules=RULES,
    min_support: float = 0.01,
    min_confidence: float = 0.9,
    min_coverage: float = 0.5,
    default: str = "allow",
    width: int = WIDTH,
) -> DataFrame:
    """One row per input row: id, host, path, rule, verdict, mined_rule, mined_confidence.

    The given rules label the URLs they fit; FP-growth mines combinations of URL tokens that go with one
    label in at least ``min_confidence`` of the labelled URLs that have them, where these are at least
    ``min_coverage`` of all URLs that have them. A URL's verdict is that of its longest given rule, else of its best mined rule, else ``default``.

    Null URLs and those without ``://`` have an empty host and path and no tokens, so they get
    ``default``. Repeated ids or rows are judged each for itself; null ids too. Other columns are
    ignored. An empty table gives an empty result.
    """
    host, path = url_host(F.col("url")), url_path(F.col("url"))
    fits, says = rule_for(F.col("host"), F.col("path"), rules)
    table = materialize(
        urls.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
        .select("id", host.alias("host"), path.alias("path"), F.monotonically_increasing_id().alias("key"))
        .withColumns({"rule": fits, "given": says, "tokens": url_tokens(F.col("host"), F.col("path"))}),
        "urls",
    )
    mined = mine_rules(table.select("tokens", F.col("given").alias("label")), min_support, min_confidence, min_coverage, width)
    found = match_rules(table.filter(F.col("given").isNull()).select("key", "tokens"), mined).withColumnRenamed("verdict", "mined")
    return table.join(found, "key", "left").select(
        F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("given", "mined", F.lit(default)).alias("verdict"),
        F.col("rule_id").alias("mined_rule"), F.col("confidence").alias("mined_confidence"),
    )


def op10_filter_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))
