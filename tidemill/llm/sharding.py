"""Sharding by extendible hashing.

A directory is indexed by the leading bits of a hash of 60 bits.  A bucket that
holds more bytes than a shard may is split on the next bit, the others are not; so
shards have prefixes of different lengths, and every shard fits its limit.

Spark sums bytes per prefix at a depth somewhat below the mean shard's, rolls the
sums up to every shorter prefix, and takes as shards the prefixes that fit while
their parent does not.  Prefixes still too heavy at that depth are summed again
some bits further down.  Only sums per prefix are gathered, by hash and hence
evenly; documents are mapped to their shards by a join on the prefix.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import maybe_broadcast, numbered, with_row, written

SHARD_BYTES = 64 << 20
#: Limit of the registered query: small, so that test tables have several shards too.
QUERY_BYTES = 256 << 10
#: Bits of the hash.
BITS = 60
#: Bits that the first sums go beyond the mean shard's prefix, and each later step adds.
SLACK = 4


def row_hash(doc_id: Column, text: Column) -> Column:
    """The leading BITS bits of the MD5 of id and text, null as empty, as a number."""
    own = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(own, 1, BITS // 4), 16, 10).cast("long")


def prefix(h: Column | str, depth: int) -> Column:
    """The leading ``depth`` bits of a hash as a number."""
    h = F.col(h) if isinstance(h, str) else h
    return F.shiftright(h, BITS - depth)


def _leaves(cells: DataFrame, low: int, high: int, limit: int) -> DataFrame:
    """(cell, depth, shard_prefix, shard_bytes) for cells of ``high`` bits that a fitting prefix of more than ``low`` bits, or of ``low`` = 0 bits, covers.

    A prefix is a shard if it fits and the one a bit shorter does not.  Prefixes meet
    their parents only, two at most at each, and list their cells by themselves; the
    root's sum is combined in the tasks and joined to no cell.
    """
    start = low + 1 if low else 0
    each = cells.select("bytes", F.explode(F.sequence(F.lit(start), F.lit(high))).alias("depth"), "cell")
    sums = each.groupBy("depth", F.expr(f"shiftright(cell, {high} - depth)").alias("p")).agg(F.sum("bytes").alias("shard_bytes"))
    sums = written(sums, "shard-sums")
    heavy = sums.where(F.col("shard_bytes") > limit).select((F.col("depth") + 1).alias("depth"), F.col("p").alias("up"))
    fits = sums.where(F.col("shard_bytes") <= limit).withColumn("up", F.shiftright("p", 1))
    leaves = fits.where(F.col("depth") == start).unionByName(fits.where(F.col("depth") > start).join(heavy, ["depth", "up"], "left_semi"))
    covered = F.expr(f"sequence(shiftleft(p, {high} - depth), shiftleft(p + 1, {high} - depth) - 1)")
    return leaves.select(F.explode(covered).alias("cell"), "depth", F.col("p").alias("shard_prefix"), "shard_bytes")


def directory(rows: DataFrame, limit: int = SHARD_BYTES) -> tuple[list[tuple[int, DataFrame, int]], int]:
    """The directory for rows of (h, bytes): [(bits, (cell, depth, shard_prefix, shard_bytes), their number)], number of single hashes above the limit.

    Each step covers the cells that the steps before it left oversized.  Cells of a
    single hash cannot be split by bits and are left out of later steps.
    """
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    low, steps, left = 0, [], rows
    high = min(BITS, max(1, ceil(log2(max(1, total / limit))) + SLACK))
    alone = 0
    while True:
        cells = written(left.groupBy(prefix("h", high).alias("cell")).agg(F.sum("bytes").alias("bytes"), F.min("h").alias("least"), F.max("h").alias("most")), "shard-cells")
        leaves = written(_leaves(cells, low, high, limit), "shard-leaves")
        steps.append((high, leaves, leaves.count()))
        heavy = cells.where(F.col("bytes") > limit)
        alone += heavy.where("least = most").count()
        heavy = heavy.where("least < most")
        over = heavy.count()
        if not over:
            return steps, alone
        heavy = maybe_broadcast(heavy.select(F.col("cell").alias("_cell")), over)
        left = left.join(heavy, prefix("h", high) == F.col("_cell"), "left_semi")
        low, high = high, min(BITS, high + SLACK)


def assign(docs: DataFrame, limit: int = SHARD_BYTES) -> DataFrame:
    """The documents with shard (its bits, and an overflow number where needed) and shard_depth.

    The hash is of id and text, so copies with other ids are spread.  Null texts have no bytes.  A text above the limit is a shard of its own, at the
    depth BITS.  Rows that repeat id and text cannot be
    told apart by bits; if together they exceed the limit, they fill overflow shards
    one after the other.  Input columns named like the results are replaced.  An
    empty table gives an empty result.
    """
    own = row_hash(F.col("doc_id"), F.col("text")), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    rows = written(docs.select(own[0].alias("h"), own[1].alias("bytes")), "shard-sizes")
    steps, alone = directory(rows, limit)
    columns = [c for c in docs.columns if c not in ("shard", "shard_depth")]
    held = with_row(docs.select(*[F.col(f"`{c}`") for c in columns]), "doc_id", "text")
    out = held.select("_row", own[0].alias("_h"), own[1].alias("_bytes"), F.lit(None).cast("string").alias("_shard"), F.lit(None).cast("int").alias("_depth"))
    for bits, leaves, n in steps:
        leaf = maybe_broadcast(leaves.select(F.col("cell").alias("_cell"), F.col("depth").alias("_d"), F.when(F.col("depth") > 0, F.expr("right(lpad(bin(shard_prefix), 64, '0'), depth)")).otherwise("").alias("_bits")), n)
        out = out.join(leaf, prefix("_h", bits) == F.col("_cell"), "left")
        out = out.withColumn("_shard", F.coalesce("_shard", "_bits")).withColumn("_depth", F.coalesce("_depth", "_d")).drop("_cell", "_d", "_bits")
    if alone:
        fits, overflow = out.where("_shard IS NOT NULL"), numbered(out.where("_shard IS NULL").drop("_shard", "_depth"), ["_h"], "_bytes")
        each = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest(F.col("_bytes"), F.lit(1))))
        number = F.floor(F.col("_n") / each).cast("long")
        overflow = overflow.withColumn("_shard", F.concat(F.lpad(F.bin("_h"), BITS, "0"), F.lit("+"), number.cast("string"))).withColumn("_depth", F.lit(BITS)).drop("_n")
        out = fits.unionByName(overflow)
    return out.select("_row.*", F.col("_shard").alias("shard"), F.col("_depth").alias("shard_depth"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered query: doc_id, n_bytes, shard and shard_depth of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return assign(docs, QUERY_BYTES).select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "shard", "shard_depth")


ORACLE_SQL = f"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, CAST(coalesce(octet_length(encode(text)), 0) AS BIGINT) AS n_bytes,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')), 1, 15) AS BIGINT) AS h FROM documents
), each AS (
  SELECT rid, n_bytes, CAST(d AS INT) AS d, h >> CAST({BITS} - d AS INT) AS p FROM docs, range(0, {BITS + 1}) depths(d)
), fitting AS (
  SELECT d, p FROM each GROUP BY d, p HAVING sum(n_bytes) <= {QUERY_BYTES}
), least AS (
  SELECT rid, min(d) AS d FROM each JOIN fitting USING (d, p) GROUP BY rid
), over AS (
  SELECT docs.*, l.d, row_number() OVER (PARTITION BY h ORDER BY docs.rid) - 1 AS n FROM docs LEFT JOIN least l ON l.rid = docs.rid
)
SELECT doc_id, n_bytes,
  CASE WHEN d IS NULL THEN lpad(bin(h), {BITS}, '0') || '+' || CAST(n // greatest(1, {QUERY_BYTES} // greatest(n_bytes, 1)) AS VARCHAR)
    ELSE substr(lpad(bin(h), {BITS}, '0'), 1, d) END AS shard,
  coalesce(d, {BITS}) AS shard_depth
FROM over
"""
