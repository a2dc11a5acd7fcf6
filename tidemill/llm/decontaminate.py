"""Benchmark decontamination with spaced seeds, in DataFrame functions only.

A seed is a fixed mask over consecutive tokens: tokens under a 1 are hashed, those
under a 0 are ignored, so a window matches although ignored tokens were
substituted.  Windows of the benchmark items and of the documents join on these
hashes.  Each hit lays item and document along a diagonal; the overlap is then
compared token by token, and counts as contamination if some stretch of
``STRETCH`` tokens (or the whole of a shorter item) agrees in 80 per cent of them.
``MASKS`` alone miss some ways to place the other tokens; with ``EXTRA`` every
stretch that agrees so far has a hit.

The item side is small and is broadcast only after its rows were counted;
otherwise the windows are joined by a shuffle, 16 bytes and a key each.  With the
broadcast, document windows are never stored: they are generated, probed and
dropped in one pass over the texts.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import BROADCAST_ROWS, maybe_broadcast, with_row, written

#: Fixed seeds: 1 is hashed, 0 is ignored.
MASKS = ("1101011011", "1011100111")
STRETCH = 13
AGREE = 0.8
#: More seeds, by compared tokens and how many of them may differ: together with MASKS they hit every such stretch.
EXTRA = {
    (13, 2): ("11001110101", "110101111"),
    (12, 2): ("11011111", "11100101011"),
    (11, 2): ("11011101", "110010111", "1111011"),
    (10, 2): ("110111", "11100011"),
    (9, 1): ("1111011", "1101111"),
    (8, 1): ("111011", "11111"),
    (7, 1): ("11111", "111011", "110111"),
    (6, 1): ("1111", "11011"),
    (5, 1): ("111", "1101"),
}

TOKEN = r"[\p{L}\p{N}\p{M}]+"


def token_hashes(text: Column) -> Column:
    """array<long>: hashes of the lower-cased tokens; null counts as empty."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))
    return F.transform(found, lambda w: F.xxhash64(w))


def seeds(compared: int, masks: tuple[str, ...] = MASKS, agree: float = AGREE) -> list[str]:
    """Masks of which one at least hits any stretch of ``compared`` tokens that agrees far enough.

    Where EXTRA has none, it is a run: m tokens that differ leave m + 1 runs, and the
    longest has its share of the tokens that agree.
    """
    differ = compared - ceil(compared * agree)
    extra = EXTRA.get((compared, differ)) if masks == MASKS else None
    return [*(m for m in masks if len(m) <= compared), *(extra or ("1" * max(1, ceil((compared - differ) / (differ + 1))),))]


def _windows(rows: DataFrame, masks: list[str], fits: dict[str, Column] | None = None) -> DataFrame:
    """rows with a column tokens, by window: the columns and hash, pos; hash is null where a mask has no window.

    Positions are generated first and hashed after, so that hashing runs in generated
    code, which a lambda over the array would not.  The outer form keeps Catalyst
    from adding a filter on the array's size, which it would push below the tokens
    and so compute these anew.  Masks apply to rows where ``fits`` says so.
    """
    size = F.size("tokens")
    each = rows.select(*rows.columns, F.explode_outer(F.when(size > 0, F.sequence(F.lit(0), size - 1))).alias("pos"))

    def own(k: int, mask: str) -> Column:
        here = F.col("pos") + len(mask) <= size
        return F.when(here & fits[mask] if fits else here, F.xxhash64(F.lit(k), *[F.get("tokens", F.col("pos") + j) for j, bit in enumerate(mask) if bit == "1"]))

    return each.select(*rows.columns, "pos", F.explode(F.array(*[own(k, mask) for k, mask in enumerate(masks)])).alias("hash"))


def overlaps(docs: DataFrame, items: DataFrame, masks: tuple[str, ...] = MASKS, stretch: int = STRETCH, agree: float = AGREE, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, text_hash, item_id, agreeing, compared, doc_from): the best verified overlap of each document and item.

    ``agreeing`` of the ``compared`` tokens of the best stretch agree; ``doc_from``
    is the token of the document where the overlap with the item begins.  Items
    shorter than a stretch have seeds of their own length.  Items or
    documents without tokens, null texts among them, never match; whole texts are
    compared, however long; of several best overlaps the first in the document
    counts; items that repeat are compared once; repeated documents give the same
    rows once; empty tables give an empty result.
    """
    spark = docs.sparkSession
    items = items.select("item_id", token_hashes(F.col("text")).alias("tokens")).where("size(tokens) > 0").distinct()
    items = written(items.withColumn("_item", F.xxhash64("item_id", "tokens")), "benchmark")
    w = F.least(F.size("tokens"), F.lit(stretch))
    lengths = sorted(r[0] for r in items.select(w).distinct().collect()) or [stretch]  # stretch of them at most
    by_length = {n: seeds(n, masks, agree) for n in lengths}
    masks = list(dict.fromkeys(m for n in reversed(lengths) for m in by_length[n]))
    fits = {m: w.isin([n for n in lengths if m in by_length[n]]) for m in masks}
    item_windows = _windows(items, masks, fits).where("hash IS NOT NULL").select("hash", "_item", F.col("pos").alias("item_pos"), F.size("tokens").alias("m")).distinct()
    item_windows = written(item_windows, "benchmark-windows")
    n_windows = item_windows.count()

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), token_hashes(F.col("text")).alias("tokens"))
    diagonal = (F.col("pos") - F.col("item_pos")).alias("diagonal")
    if n_windows <= broadcast_rows:
        hits = _windows(rows, masks).join(F.broadcast(item_windows), "hash").select("doc_id", "text_hash", "tokens", "_item", "m", diagonal)
    else:  # windows are shuffled without the tokens, which only the documents that were hit get back
        hits = _windows(rows, masks).drop("tokens").join(item_windows, "hash").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "_item", "m", diagonal).distinct()
        hits = written(hits, "benchmark-hits")
        same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))
        hits = rows.join(maybe_broadcast(hits, hits.count(), broadcast_rows), same)
    hits = hits.select("doc_id", "text_hash", "_item", "diagonal", F.slice("tokens", F.greatest(F.col("diagonal"), F.lit(0)) + 1, F.col("m") + F.least(F.col("diagonal"), F.lit(0))).alias("part")).distinct()
    both = hits.join(maybe_broadcast(items, n_windows, broadcast_rows), "_item")  # an item has about as many windows as tokens
    shift = F.greatest(-F.col("diagonal"), F.lit(0))
    both = both.withColumn("same", F.transform("part", lambda t, j: (t == F.get(F.col("tokens"), j + shift)).cast("int")))
    both = both.withColumn("compared", w).where(F.size("same") >= F.col("compared"))
    sums = F.transform(F.sequence(F.lit(1), F.size("same") - F.col("compared") + 1), lambda i: F.aggregate(F.slice("same", i, F.col("compared")), F.lit(0), lambda a, x: a + x))
    verified = both.withColumn("agreeing", F.array_max(sums)).where(F.col("agreeing") >= F.ceil(F.col("compared") * agree))
    best = F.max_by(F.struct("agreeing", "compared", F.greatest("diagonal", F.lit(0)).alias("doc_from")), F.struct("agreeing", -F.col("diagonal")))
    return verified.groupBy("doc_id", "text_hash", "item_id").agg(best.alias("b")).select("doc_id", "text_hash", "item_id", "b.agreeing", "b.compared", "b.doc_from")


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents without any contamination, with all their columns as they are.

    Null and empty texts stay; rows that repeat share their fate.
    """
    found = written(overlaps(docs, items).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct(), "contaminated")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_hash"))
    return with_row(docs, "doc_id", "text").join(maybe_broadcast(found, found.count()), same, "left_anti").select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered query: the contaminated documents, with the items and their best overlaps."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return overlaps(docs, items).select("doc_id", "item_id", "agreeing", "compared", "doc_from")


#: Candidates are all diagonals on which enough tokens agree, by a join on tokens: no masks, so it would show a seed that is missing.
ORACLE_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(lower(coalesce(text, '')), '{TOKEN}') AS tokens FROM documents),
items AS (SELECT row_number() OVER () AS rid, item_id, regexp_extract_all(lower(coalesce(text, '')), '{TOKEN}') AS tokens FROM benchmark),
doc_tokens AS (SELECT rid, unnest(tokens) AS token, unnest(range(1, len(tokens) + 1)) AS i FROM docs),
item_tokens AS (SELECT rid, least(len(tokens), {STRETCH}) AS w, unnest(tokens) AS token, unnest(range(1, len(tokens) + 1)) AS i FROM items),
hits AS (SELECT d.rid, t.rid AS iid, d.i - t.i AS diagonal FROM doc_tokens d JOIN item_tokens t ON t.token = d.token GROUP BY ALL HAVING count(*) >= ceil({AGREE} * any_value(w))),
laid AS (SELECT h.*, d.doc_id, t.item_id, d.tokens AS own, t.tokens AS theirs, least(len(t.tokens), {STRETCH}) AS w FROM hits h JOIN docs d ON d.rid = h.rid JOIN items t ON t.rid = h.iid),
compared AS (SELECT rid, iid, diagonal, doc_id, item_id, w, j, CAST(theirs[j] = own[j + diagonal] AS INT) AS same
  FROM (SELECT *, unnest(range(greatest(1, 1 - diagonal), least(len(theirs), len(own) - diagonal) + 1)) AS j FROM laid)),
summed AS (SELECT *, row_number() OVER o AS n, sum(same) OVER (PARTITION BY rid, iid, diagonal ORDER BY j ROWS BETWEEN {STRETCH - 1} PRECEDING AND CURRENT ROW) AS agreeing FROM compared WINDOW o AS (PARTITION BY rid, iid, diagonal ORDER BY j)),
best AS (SELECT rid, iid, diagonal, doc_id, item_id, w, max(agreeing) AS agreeing FROM summed WHERE n >= w GROUP BY ALL HAVING max(agreeing) >= ceil(w * {AGREE})),
picked AS (SELECT *, row_number() OVER (PARTITION BY rid, item_id ORDER BY agreeing DESC, diagonal) AS k FROM best)
SELECT doc_id, item_id, CAST(agreeing AS INT) AS agreeing, CAST(w AS INT) AS compared, CAST(greatest(diagonal, 0) AS INT) AS doc_from FROM picked WHERE k = 1
"""
