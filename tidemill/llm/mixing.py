"""Mixing sources to target weights by repetition rates.

Word totals per source give each source's target, hence its repetition rate
target / size.  A document is taken floor(rate) times, and once more if a number in
[0, 1) drawn from a hash of its id and text falls below the rate's fraction.  Rows
that repeat both draw by their number among their like, so that no two rows share a
draw.  Only totals, and counts of the hashes, are shuffled, pre-aggregated in every
task; the documents are not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.llm.common import WORD, maybe_broadcast, numbered, with_row, written

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
SEED = "mix"


def words(text: Column) -> Column:
    """Number of words; null counts as none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """(source, source_size, target) from rows of (source, size).

    Sources are taken by code point, null last, and weigh ``weights`` in turn.  They
    share ``share`` of all sizes by weight; a target stops at ``cap`` times its
    source's size and the excess goes to the others by weight, until none is above.
    That is the level L with target = min(cap * size, L * weight): going up the
    ratios cap * size / weight, a source is held at its cap while the level that
    the sources not yet held would get is above its ratio.

    One row per source goes through the windows, not the documents.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    listed = F.array(*[F.lit(w) for w in weights])
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = total.withColumn("w", F.element_at(listed, (F.row_number().over(in_order) - 1) % len(weights) + 1).cast("long"))
    ranked = ranked.withColumn("most", F.col("source_size") * cap).withColumn("ratio", F.col("most") / F.col("w"))
    every = Window.partitionBy()
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        ranked.withColumn("pool", F.sum("source_size").over(every) * F.lit(float(share)))
        .withColumn("all_w", F.sum("w").over(every))
        .withColumn("level", (F.col("pool") - F.coalesce(F.sum("most").over(before), F.lit(0))) / (F.col("all_w") - F.coalesce(F.sum("w").over(before), F.lit(0))))
        .withColumn("held", F.col("level") >= F.col("ratio"))
    )
    free_w = F.sum(F.when(~F.col("held"), F.col("w"))).over(every)
    held_most = F.coalesce(F.sum(F.when(F.col("held"), F.col("most"))).over(every), F.lit(0))
    target = F.when(F.col("held"), F.col("most").cast("double")).otherwise((F.col("pool") - held_most) / free_w * F.col("w"))
    return ranked.select("source", "source_size", target.alias("target"))


def _drawn(text: Column) -> Column:
    """A number from 52 bits of a text's MD5."""
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def row_draw(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """A number below 2 ** 52 from seed, id and text; null counts as empty."""
    parts = [F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")))]
    return _drawn(F.concat_ws("|", *parts))


def copies(rate: Column, draw: Column) -> Column:
    """floor(rate) and one more with the probability of the fraction."""
    return (F.floor(rate) + F.when(draw / F.lit(float(1 << 52)) < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def _apart(rows: DataFrame, order: str) -> DataFrame:
    """rows (_draw, _key of the source, ...) in which rows of one source with the same draw got draws of their own.

    The first of them keeps it, the others draw from it and their number.
    """
    again = rows.groupBy("_draw", "_key").agg(F.count(F.lit(1)).alias("_rows")).where("_rows > 1").select("_draw", "_key")
    again = written(again, "mix-repeats")
    n = again.count()
    if not n:
        return rows
    again = maybe_broadcast(again, n)
    several = numbered(rows.join(again, ["_draw", "_key"], "left_semi"), ["_draw", "_key"], order)
    own = _drawn(F.concat_ws("|", F.col("_draw").cast("string"), F.col("_n").cast("string")))
    several = several.withColumn("_draw", F.when(F.col("_n") > 0, own).otherwise(F.col("_draw"))).drop("_n")
    return rows.join(again, ["_draw", "_key"], "left_anti").unionByName(several)


def _key(source: Column) -> Column:
    """A source, null included, as text that is never null."""
    return F.when(source.isNull(), "").otherwise(F.concat(F.lit("="), source))


def _rates(sizes: DataFrame) -> DataFrame:
    held = written(targets(sizes), "mix-targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    held = held.select(F.col("source").alias("_source"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), rate.alias("_rate"))
    return maybe_broadcast(held, held.count())


def mix(docs: DataFrame) -> DataFrame:
    """The documents as the mix takes them: a row for each copy, none for those not taken.

    All columns stay as they are.  Null texts have no words, so a source of such
    documents only has target zero and is left out.  Rows that repeat id, text and
    source draw apart; where they differ in other columns, which of them is taken
    may depend on how the table is split into files, their number does not.  An
    empty table gives an empty result.
    """
    rates = _rates(docs.select("source", words(F.col("text")).alias("size")))
    rows = with_row(docs, "doc_id", "text", "source").select("_row", "source", row_draw(F.col("doc_id"), F.col("text")).alias("_draw"), _key(F.col("source")).alias("_key"))
    joined = _apart(rows.withColumn("_order", F.xxhash64(F.to_json("_row"))), "_order").join(rates, F.col("source").eqNullSafe(F.col("_source")))
    n = copies(F.col("_rate"), F.col("_draw")).cast("int")
    return joined.select("_row", F.explode(F.when(n > 0, F.sequence(F.lit(1), n)))).select("_row.*")


def decisions(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row of documents, by the rules of ``mix``."""
    sizes = docs.select("doc_id", "source", words(F.col("text")).alias("size"), row_draw(F.col("doc_id"), F.col("text")).alias("_draw"), _key(F.col("source")).alias("_key"))
    sizes = written(sizes, "mix-sizes")
    rates = _rates(sizes.select("source", "size"))
    drawn = _apart(sizes, "size")
    joined = drawn.join(rates, drawn.source.eqNullSafe(rates._source))
    return joined.select("doc_id", "size", F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("size") * copies(F.col("_rate"), F.col("_draw"))).alias("taken"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered query: what the mix takes of every document."""
    return decisions(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    CAST('0x' || substr(md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))), 1, 13) AS BIGINT) AS first_draw FROM documents
), drawn AS (
  SELECT doc_id, source, size, CASE WHEN k = 0 THEN first_draw ELSE CAST('0x' || substr(md5(first_draw || '|' || k), 1, 13) AS BIGINT) END AS draw
  FROM (SELECT *, row_number() OVER (PARTITION BY first_draw, source) - 1 AS k FROM sizes)
), total AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source
), weighed AS (
  SELECT source, source_size, [3, 1, 2][CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS INT)] AS w FROM total
), level AS (
  SELECT *, CAST(2 * source_size AS DOUBLE) / w AS ratio,
    CAST(sum(source_size) OVER () AS DOUBLE) * CAST(1.5 AS DOUBLE) AS pool,
    (CAST(sum(source_size) OVER () AS DOUBLE) * CAST(1.5 AS DOUBLE) - CAST(coalesce(sum(2 * source_size) OVER prior, 0) AS DOUBLE))
      / CAST(sum(w) OVER () - coalesce(sum(w) OVER prior, 0) AS DOUBLE) AS lvl
  FROM weighed
  WINDOW prior AS (ORDER BY CAST(2 * source_size AS DOUBLE) / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), held AS (
  SELECT source, source_size,
    CASE WHEN lvl >= ratio THEN CAST(2 * source_size AS DOUBLE)
      ELSE (pool - CAST(coalesce(sum(CASE WHEN lvl >= ratio THEN 2 * source_size END) OVER (), 0) AS DOUBLE))
        / CAST(sum(CASE WHEN lvl < ratio THEN w END) OVER () AS DOUBLE) * w END AS target
  FROM level
), rated AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM held
)
SELECT s.doc_id, s.size, r.source_size, r.target,
  CAST(s.size * (floor(rate) + CASE WHEN s.draw / CAST(4503599627370496 AS DOUBLE) < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM drawn s JOIN rated r ON s.source IS NOT DISTINCT FROM r.source
"""
