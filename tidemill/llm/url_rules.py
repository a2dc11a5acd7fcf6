"""URL filters: fixed allow and block rules, and association rules mined from labels.

Spark's FP-growth mines combinations of URL tokens that are frequent among pages
with bad labels.  Tokens that are on the same labelled pages throughout are one item
there, as k of them would list 2 ** k combinations that say the same.  Combinations
are counted among all labelled pages, and pruned by support, by lift over the share
of bad pages, and by significance of their confidence against that share; and again
if a part of their tokens does as well.  A URL is matched through an inverted index:
each rule is listed under its rarest token, so a URL meets only the rules listed
under its own tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import columns_of, maybe_broadcast, written

#: Fixed rules of the contract: (verdict, host, path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

#: What a mined rule needs: bad labelled pages, lift of its confidence over the share of bad pages, and deviations above that share.
MIN_COUNT, MIN_LIFT, MIN_DEVIATIONS = 10, 1.5, 5.0
#: Labelled URLs that rules are mined from, at most; those with the least hash of their id.
SAMPLE = 500_000
RULE = "rule_id long, tokens array<string>, anchor string, n long, n_bad long, confidence double, lift double"


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    own = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(own, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fixed_rule(host_col: str = "host", path_col: str = "path") -> Column:
    """The longest fixed rule that fits, as struct(rule, verdict); null if none does.

    A rule fits its host and all its subdomains, if the path starts with the rule's.
    """
    h, p = F.col(host_col), F.col(path_col)
    fits = []
    for verdict, rule_host, rule_path in sorted(RULES, key=lambda r: -len(r[1] + r[2])):
        on_host = (h == rule_host) | h.endswith("." + rule_host)
        fits.append(F.when(on_host & p.startswith(rule_path), F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.coalesce(*fits)


def url_tokens(url: Column) -> Column:
    """Distinct tokens of a URL: its host's labels by position from the end, and the words of path and query.

    Numbers are left out, as they identify single pages.
    """
    labels = F.reverse(F.split(host(url), r"\."))
    hosts = F.transform(F.filter(labels, lambda x: F.length(x) > 0), lambda x: F.concat(F.lit("host="), x))
    rest = F.regexp_replace(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*", "")
    words = F.filter(F.split(F.lower(rest), r"[^\p{L}\p{N}_-]+"), lambda x: (F.length(x) > 0) & ~x.rlike(r"^[0-9]+$"))
    return F.array_distinct(F.concat(hosts, F.transform(words, lambda x: F.concat(F.lit("path="), x))))


def document_of(url: Column) -> Column:
    """The document that a page shows, by the last number of its path; null if there is none."""
    return F.nullif(F.regexp_extract(path(url), r"([0-9]{1,18})[^0-9/]*/?$", 1), F.lit("")).cast("long")


def labelled(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(page_id, tokens, bad): pages whose document has a label; bad if of low quality or toxic."""
    own = pages.select("page_id", url_tokens(F.col("url")).alias("tokens"), document_of(F.col("url")).alias("doc_id"))
    marks = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return own.join(marks, "doc_id").select("page_id", "tokens", F.coalesce("bad", F.lit(False)).alias("bad"))


def items_of(rows: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """(item, tokens, n): the tokens with min_count bad rows or more, those on the same rows throughout as one item.

    rows are (row, tokens, bad), with row unique.  Rows are compared by their number
    and two XORs of their hashes.  An item is named by its least token.
    """
    each = rows.select("row", "bad", F.explode("tokens").alias("token"))
    on = each.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("bad").cast("long")).alias("n_bad"), F.expr("bit_xor(xxhash64(row))").alias("x"), F.expr("bit_xor(xxhash64(row, 1))").alias("y"))
    same = on.where(F.col("n_bad") >= min_count).groupBy("n", "x", "y").agg(F.array_sort(F.collect_set("token")).alias("tokens"))
    return same.select(F.element_at("tokens", 1).alias("item"), "tokens", "n")


def mine(rows: DataFrame, min_count: int = MIN_COUNT, min_lift: float = MIN_LIFT, min_deviations: float = MIN_DEVIATIONS, sample: int = SAMPLE) -> DataFrame:
    """Rules (RULE) on token combinations that go with bad labels.

    At most ``sample`` labelled pages are mined, those with the least hash of their
    id.  n of them have all of a rule's tokens, n_bad of these are bad; confidence is
    their ratio, lift its ratio to the share of bad pages.  A rule is dropped if a
    rule on a part of its items is as confident.  Without labelled pages, or bad
    ones, there are no rules; pages without tokens, and repeated rows, count as
    pages.
    """
    from pyspark.ml.fpm import FPGrowth

    spark = rows.sparkSession
    picked = rows.orderBy(F.xxhash64("page_id"), "page_id").limit(sample)
    rows = written(picked.select(F.monotonically_increasing_id().alias("row"), "tokens", "bad"), "url-labels")
    n, n_bad = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0))).first()
    if n_bad < min_count:
        return spark.createDataFrame([], RULE)
    share = n_bad / n
    items = written(items_of(rows, min_count), "url-items")
    n_items = items.count()
    if not n_items:
        return spark.createDataFrame([], RULE)
    each = rows.select("row", "bad", F.explode("tokens").alias("item")).join(maybe_broadcast(items.select("item", F.col("n").alias("_n")), n_items), "item")
    baskets = written(each.groupBy("row", "bad").agg(F.collect_list("item").alias("items")), "url-baskets")
    bad = baskets.where("bad").select("items")
    model = FPGrowth(itemsCol="items", minSupport=max(0.0, (min_count - 0.5) / bad.count()), minConfidence=1.0).fit(bad)
    frequent = model.freqItemsets.select(F.array_sort("items").alias("items"))
    named = written(_anchored(frequent, items.select("item", "n")), "url-combinations")
    # Baskets are few bytes, but each meets many combinations: adaptive execution would leave them in one task.
    probes = baskets.repartition(spark.sparkContext.defaultParallelism).select("bad", "items", F.explode("items").alias("anchor"))
    met = probes.join(maybe_broadcast(named.select("anchor", F.col("items").alias("needed")), named.count()), "anchor").where("size(array_except(needed, items)) = 0")
    counted = met.groupBy(F.col("needed").alias("items"), "anchor").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("bad").cast("long")).alias("n_bad"))
    judged = counted.withColumn("confidence", F.col("n_bad") / F.col("n")).withColumn("lift", F.col("confidence") / F.lit(share))
    above = F.col("n_bad") - F.col("n") * F.lit(share) >= F.lit(min_deviations) * F.sqrt(F.col("n") * F.lit(share * (1 - share)))
    rules = written(judged.where((F.col("n_bad") >= min_count) & (F.col("lift") >= min_lift) & above), "url-rules")
    n_rules = rules.count()
    smaller = rules.select(F.col("items").alias("part"), F.col("confidence").alias("part_confidence"), F.element_at("items", 1).alias("_item"))
    listed = rules.withColumn("_item", F.explode("items"))
    worse = listed.join(maybe_broadcast(smaller, n_rules), "_item").where("size(part) < size(items) AND part_confidence >= confidence AND size(array_except(part, items)) = 0").select("items").distinct()
    kept = rules.join(worse, "items", "left_anti")
    whole = kept.withColumn("item", F.explode("items")).join(maybe_broadcast(items.select("item", "tokens"), n_items), "item")
    whole = whole.groupBy("items", "anchor", "n", "n_bad", "confidence", "lift").agg(F.array_sort(F.flatten(F.collect_list("tokens"))).alias("tokens"))
    return whole.select(F.xxhash64("tokens").alias("rule_id"), "tokens", "anchor", "n", "n_bad", "confidence", "lift")


def _anchored(sets: DataFrame, counts: DataFrame) -> DataFrame:
    """(items, anchor): each set with its rarest item."""
    of = sets.select("items", F.explode("items").alias("item")).join(counts, "item")
    return of.groupBy("items").agg(F.min_by("item", F.struct("n", "item")).alias("anchor"))


def matched(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """page rows' keys (page_id, url_hash) of pages that some rule matches: those that have all its tokens."""
    rules = written(rules, "url-index")
    index = maybe_broadcast(rules.select("anchor", F.col("tokens").alias("needed")), rules.count())
    urls = pages.select("page_id", F.xxhash64("url").alias("url_hash"), url_tokens(F.col("url")).alias("tokens"))
    probes = urls.select("page_id", "url_hash", "tokens", F.explode_outer("tokens").alias("anchor"))
    return probes.join(index, "anchor").where("size(array_except(needed, tokens)) = 0").select("page_id", "url_hash").distinct()


def judge(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of pages.

    A fixed rule decides where one fits; else a page that a mined rule matches is
    blocked and the others are allowed.  Null URLs, and those without ://, have
    empty host and path and are allowed.  URLs of any length are read whole.
    Repeated rows stay; without labels nothing is mined; an empty table gives an
    empty result.
    """
    pages, labels = columns_of(pages, ["page_id", "url"]), columns_of(labels, ["doc_id", "quality", "toxic"])
    hits = written(matched(pages, mine(labelled(pages, labels))), "url-hits").select(F.col("page_id").alias("_id"), F.col("url_hash").alias("_hash"))
    rows = pages.select("page_id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    same = rows.page_id.eqNullSafe(F.col("_id")) & (F.xxhash64(rows.url) == F.col("_hash"))
    rows = rows.join(maybe_broadcast(hits.withColumn("_hit", F.lit(True)), hits.count()), same, "left").withColumn("_fixed", fixed_rule())
    mined = F.when(F.col("_hit"), F.lit("block")).otherwise(F.lit("allow"))
    return rows.select("page_id", "host", "path", F.col("_fixed.rule").alias("rule"), F.coalesce(F.col("_fixed.verdict"), mined).alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered query: the verdict on every page's URL."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic")
    return judge(pages, labels)
