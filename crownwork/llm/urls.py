"""URL filters, by DataFrame functions and MLlib only.

``judged`` parses host and path, applies host and path rules, and lets gradient-boosted trees on lexical features
decide where no rule fits. The trees learn from the URLs that rules decide (block: 1), about ``sample`` of them, by a
hash of the URL; suffix statistics (the share of blocked URLs by the host's last label and last two labels, smoothed)
come from all of them, for every suffix. Beyond ``broadcast_bytes`` of suffixes they are joined by a salted shuffle.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, stored

FEATURES = ("url_length", "host_length", "path_length", "depth", "dots", "hyphens", "digit_ratio", "entropy", "parameters", "suffix_1", "suffix_2")


def parsed(urls: DataFrame) -> DataFrame:
    """urls with host and path. Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased;
    path: then up to ``?``, ``#`` or the end. Without ``://``, and for a null url, both are empty."""
    text = F.coalesce("url", F.lit(""))
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return urls.withColumns({"host": ascii_lower(F.regexp_extract(text, parts, 1)), "path": F.regexp_extract(text, parts, 2)})


def rule_of(rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits columns host and path, or null. rules: (allow or block, host/path)."""
    out = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: len(r[1])):
        host, slash, path = rule.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(slash + path)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def lexical(urls: DataFrame) -> DataFrame:
    """urls(url, host, path) with the features that need no statistics."""
    text = F.coalesce("url", F.lit(""))
    size = F.greatest(F.length(text), F.lit(1))
    kinds = F.array_distinct(F.split(text, ""))
    shares = F.transform(F.filter(kinds, lambda c: c != ""), lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / size)
    query = F.regexp_extract(text, r"(?s)\?([^#]*)", 1)
    count = lambda col, what: F.length(col) - F.length(F.replace(col, F.lit(what), F.lit("")))
    labels = F.split("host", r"\.")
    return urls.withColumns(
        {
            "url_length": F.length(text),
            "host_length": F.length("host"),
            "path_length": F.length("path"),
            "depth": count(F.col("path"), "/"),
            "dots": count(F.col("host"), "."),
            "hyphens": count(F.col("host"), "-"),
            "digit_ratio": F.length(F.regexp_replace(text, "[^0-9]", "")) / size,
            "entropy": F.aggregate(shares, F.lit(0.0), lambda a, p: a - p * F.log2(p)),
            "parameters": F.when(query == "", 0).otherwise(count(query, "&") + 1),
            "label_1": F.element_at(labels, -1),
            "label_2": F.array_join(F.slice(labels, -F.least(F.size(labels), F.lit(2)), F.lit(2)), "."),
        }
    )


#: A labelled URL's shares come from the labelled URLs of the other folds.
FOLDS = 5


def with_shares(found: DataFrame, known: DataFrame, column: str, share: float, broadcast_bytes: int, salts: int = 16) -> DataFrame:
    """found with the smoothed share of blocked URLs of known by its suffix in column; share for a suffix that known lacks.

    A row of known gets the share without the fold that its URL is in, so its own label isn't in its feature, nor is that
    of the same URL in another row; other rows get the share of all."""
    name = column.replace("label", "suffix")
    fold = F.pmod(F.xxhash64("url", F.lit(11)), F.lit(FOLDS)).cast("int")
    parts = known.groupBy(column, fold.alias("_fold")).agg(F.count("*").alias("n"), F.sum("block").alias("blocked"))
    by = parts.groupBy(column).agg(F.sum("n").alias("n"), F.sum("blocked").alias("blocked"), F.map_from_entries(F.collect_list(F.struct("_fold", F.struct("n", "blocked")))).alias("own"))  # ``FOLDS`` entries
    each = by.select(column, "n", "blocked", "own", F.explode(F.array(*map(F.lit, range(-1, FOLDS)))).alias("_fold"))
    own = F.try_element_at("own", F.col("_fold"))
    n, blocked = F.col("n") - F.coalesce(own["n"], F.lit(0)), F.col("blocked") - F.coalesce(own["blocked"], F.lit(0.0))
    shares = stored(each.select(column, "_fold", ((blocked + 5 * share) / (n + 5)).alias(name)))
    placed = found.withColumn("_fold", F.when(F.col("block").isNotNull(), fold).otherwise(-1))
    size = shares.agg(F.sum(F.coalesce(F.octet_length(column), F.lit(0)) + 28)).first()[0] or 0
    if size <= broadcast_bytes:
        out = placed.join(F.broadcast(shares), [column, "_fold"], "left")
    else:  # a common suffix goes to ``salts`` tasks
        shares = shares.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
        salted = placed.withColumn("_salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)))
        out = salted.join(shares, [column, "_fold", "_salt"], "left").drop("_salt")
    return out.drop("_fold").fillna(share, [name])


def judged(pages: DataFrame, rules: list[tuple[str, str]], sample: int = 20_000, trees: int = 10, depth: int = 4, seed: int = 1, broadcast_bytes: int = 16 << 20) -> DataFrame:
    """page_id, host, path, rule, verdict of pages(page_id, url).

    verdict: the rule's, else the trees' (block at a chance of at least 1/2). Where the rules leave nothing to learn
    from (no URL, or all of one verdict), URLs without a rule get that one verdict, or allow. Each row is judged, a
    repeated one too. Of equally long rules that fit, which can only be one rule given twice, the last one's action holds."""
    own = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"))
    verdict = F.element_at(F.create_map(*[F.lit(x) for action, rule in rules for x in (rule, action)]), F.col("rule")) if rules else F.lit(None).cast("string")
    found = lexical(parsed(own).withColumn("rule", rule_of(rules))).withColumn("by_rule", F.when(F.col("rule").isNotNull(), verdict))
    found = stored(found.withColumn("block", F.when(F.col("by_rule") == "block", 1.0).when(F.col("by_rule") == "allow", 0.0)))
    known = found.where("block is not null")
    n, blocked = known.agg(F.count("*"), F.sum("block")).first()
    columns = ["page_id", "host", "path", "rule"]
    if not n or blocked in (0, n):
        return found.select(*columns, F.coalesce("by_rule", F.lit("block" if n and blocked else "allow")).alias("verdict"))
    share = blocked / n
    for column in ("label_1", "label_2"):
        found = with_shares(found, known, column, share, broadcast_bytes)
    ready = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(found)
    some = ready.where(F.col("block").isNotNull() & (F.pmod(F.xxhash64("url"), F.lit(1 << 30)) < int(min(1, sample / n) * (1 << 30))))
    if some.select("block").distinct().count() < 2:
        some = ready.where("block is not null")
    model = GBTClassifier(labelCol="block", maxIter=trees, maxDepth=depth, seed=seed).fit(stored(some.select("features", "block")))
    chance = vector_to_array("probability")[1]
    return model.transform(ready).select(*columns, F.coalesce("by_rule", F.when(chance >= 0.5, "block").otherwise("allow")).alias("verdict"))
