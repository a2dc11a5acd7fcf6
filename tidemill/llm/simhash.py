"""SimHash near-duplicate detection with pivot distance tables.

A document's fingerprint is the bitwise majority over the hashes of its word
shingles.  Fingerprints within a few bits are linked, and a component of links
is a group of near copies.

Finding the links takes three steps, none of which pairs up a whole group:

1.  Candidate groups: an equi-join on keys, which a distance table alone cannot
    give.  There are two kinds of key, both exact.  Narrow: the 64 bits are cut in
    ``max_bits + 3`` blocks; two fingerprints that differ in at most ``max_bits``
    bits agree on three whole blocks or more, so they meet under one of the
    C(blocks, 3) keys.  Wide: of a text's distinct shingles, in one order for all
    texts, the first ``n - ceil(0.8 n) + 1`` are its keys; two texts whose
    shingles have a Jaccard similarity of 0.8 or more have one of these in common.
2.  Pivot filter.  Each distinct fingerprint has a table of Hamming distances to
    the pivots, computed once.  By the triangle inequality two fingerprints within
    ``max_bits`` differ by that much at most in every coordinate; pairs with a
    larger maximum coordinate difference are discarded.
3.  Verification of the survivors by their own Hamming distance.

A group hands on a spanning forest of its links, not all of them: what is
connected stays connected, and a group of g fingerprints makes fewer than g rows.
Groups above ``chunk`` members are dealt into chunks and compared by pairs of
chunks, so no task ever holds more than two chunks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, chain, combinations, islice
from math import ceil

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.llm.common import maybe_broadcast, with_row, written

SHINGLE = 4
MAX_BITS = 4
SEED = 42
#: Wide fingerprints of near_dedup stages: words of a shingle, similarity, 64-bit words, and differing bits at most.
#: Shingle sets of similarity 0.8 differ in 15 % of bits on average (the angle between them), 38.8 of 256 with a deviation of 5.7.
WIDE_SHINGLE, SIMILARITY, WIDTH, WIDE_BITS = 5, 0.8, 4, 48
#: Members of a candidate group that are compared in one step.
CHUNK = 2048
#: A shingle with more texts than this, and than this share of all keys, comes last in the order of wide keys.
HOT_KEY, HOT_KEYS = 4096, 1_000_000
#: Keys of groups that a join may broadcast, two longs each.
BROADCAST_KEYS = 1_000_000
#: Copies of a fingerprint from which its rows are kept out of shuffles: so many, and this share of all rows.
HOT_COPIES, HOT_SHARE = 200, 1e-4
#: Number of reference fingerprints.
N_PIVOTS = 16

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
#: Hashes that are counted in one step.
_STEP = 1 << 16


def pivots(n: int = N_PIVOTS, width: int = 1) -> np.ndarray:
    """Reference fingerprints, by row: XXH64 of 0, 1, 2 ... as decimal text, with another seed for each 64-bit word."""
    import xxhash

    return np.array([[xxhash.xxh64_intdigest(str(i), seed=SEED + j) for j in range(width)] for i in range(n)], dtype=np.uint64)


PIVOTS = {1: pivots(), WIDTH: pivots(width=WIDTH)}


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of each shingle of a text, repeats included.

    Only A-Z are lower-cased.  Texts with fewer words than a shingle have one
    shingle, the whole sequence; null and wordless texts have none.
    """
    import xxhash

    words = (text or "").encode("utf-8").translate(_LOWER).split()  # splits at \x20 and \x09-\x0D
    if not words:
        return np.empty(0, dtype=np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, seed=SEED)], dtype=np.uint64)
    digest, ends = xxhash.xxh64_intdigest, list(accumulate(len(w) + 1 for w in words))
    return np.fromiter((digest(joined[a : b - 1], SEED) for a, b in zip(chain((0,), ends), islice(ends, shingle - 1, None))), dtype=np.uint64, count=len(words) - shingle + 1)


def majority(hashes: np.ndarray) -> np.ndarray:
    """The bits that are set in over half of the rows of hashes (n, words); none without rows."""
    n, width = hashes.shape
    lanes = np.arange(8 * width, dtype=np.int64) * 256
    counts = np.zeros(2048 * width, dtype=np.int64)
    for lo in range(0, n, _STEP):
        counts += np.bincount((np.ascontiguousarray(hashes[lo : lo + _STEP]).view(np.uint8).reshape(-1, 8 * width) + lanes).ravel(), minlength=2048 * width)
    return np.packbits(2 * (counts.reshape(-1, 256) @ _BITS).ravel() > n, bitorder="little").view(np.uint64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of one text, unsigned; zero for null and wordless texts."""
    return int(majority(shingle_hashes(text, shingle)[:, None])[0])


@F.pandas_udf(T.LongType())
def _fingerprints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        own = np.fromiter((fingerprint(t) for t in batch), dtype=np.uint64, count=len(batch))
        yield pd.Series(own.view(np.int64))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, fp long) for every row of documents; repeated rows stay repeated."""
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), _fingerprints(F.col("text")).alias("fp"))


def widened(hashes: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """(n, width) hashes from one of 64 bits each, by the finalizer of SplitMix64 on a counter for each word."""
    x = hashes[:, None] + np.arange(1, width + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix(distinct: np.ndarray, hot: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """The first shingles of a sorted set, those in ``hot`` last: sets of the similarity or more share one of theirs."""
    if not len(distinct):
        return distinct
    if len(hot):
        last = np.isin(distinct, hot, assume_unique=True)
        distinct = np.concatenate([distinct[~last], distinct[last]])
    return distinct[: len(distinct) - ceil(similarity * len(distinct) - 1e-9) + 1]


_KEYED = T.StructType([T.StructField("fp", T.BinaryType()), T.StructField("keys", T.ArrayType(T.LongType()))])


def _wide(hot: Broadcast | None = None):
    @F.pandas_udf(_KEYED)
    def wide(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        last = np.empty(0, dtype=np.uint64) if hot is None else hot.value
        for batch in texts:
            out = []
            for t in batch:
                own = np.unique(shingle_hashes(t, WIDE_SHINGLE))
                out.append((majority(widened(own)).tobytes(), prefix(own, last).view(np.int64)))
            yield pd.DataFrame(out, columns=["fp", "keys"])

    return wide


@F.pandas_udf(T.ArrayType(T.LongType()))
def _shingles(texts: pd.Series) -> pd.Series:
    return pd.Series([np.unique(shingle_hashes(t, WIDE_SHINGLE)).view(np.int64) for t in texts])


def block_masks(max_bits: int) -> list[int]:
    """Bit masks, as signed longs, of every three of max_bits + 3 near-equal blocks."""
    n = max_bits + 3
    edges = [64 * i // n for i in range(n + 1)]
    blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    return [signed(a | b | c) for a, b, c in combinations(blocks, 3)]


def pivot_table(fps: np.ndarray) -> np.ndarray:
    """Hamming distances of each fingerprint (rows, of one or more words) to each pivot (columns)."""
    return np.bitwise_count(fps[:, None, :] ^ PIVOTS[fps.shape[1]][None, :, :]).sum(axis=2, dtype=np.int16)


def _matrix(fps: pd.Series) -> np.ndarray:
    """Fingerprints by row: binaries of several words, or longs."""
    if len(fps) and isinstance(fps.iloc[0], bytes):
        return np.frombuffer(b"".join(fps), dtype=np.uint64).reshape(len(fps), -1)
    return fps.to_numpy(np.int64).view(np.uint64)[:, None]


def _table(pivoted: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(pivoted), dtype=np.int16).reshape(len(pivoted), N_PIVOTS)


@F.pandas_udf(T.BinaryType())
def _pivoted(fps: pd.Series) -> pd.Series:
    return pd.Series([row.tobytes() for row in pivot_table(_matrix(fps))], dtype="object")


def _near(max_bits: int):
    @F.pandas_udf(T.BooleanType())
    def near(a: pd.Series, a_table: pd.Series, b: pd.Series, b_table: pd.Series) -> pd.Series:
        x, y = _matrix(a), _matrix(b)
        keep = np.abs(_table(a_table) - _table(b_table)).max(axis=1, initial=0) <= max_bits
        keep[keep] = np.bitwise_count(x[keep] ^ y[keep]).sum(axis=1) <= max_bits
        return pd.Series(keep)

    return near


def spanning_forest(fps: np.ndarray, table: np.ndarray, max_bits: int, rows: int = 256) -> list[tuple[int, int]]:
    """Links (i, j) that connect what links of at most max_bits connect among fps (n, words), whose distances to the pivots are ``table``.

    Fingerprints that no centre covers yet become centres in turn, each compared
    with all; in a group of near copies few are needed.  What is left to compare are
    those that are no centres, and only where the centres did not connect them.
    """
    n = len(fps)
    order = np.argsort(table[:, 0], kind="stable")
    first = table[order, 0].astype(np.int32)
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    links = []

    def join(a: int, b: int) -> None:
        x, y = find(a), find(b)
        if x != y:
            root[y] = x
            links.append((a, b))

    covered = np.zeros(n, dtype=bool)
    centre = np.zeros(n, dtype=bool)
    for i in range(n):
        if covered[i]:
            continue
        centre[i] = True
        lo, hi = np.searchsorted(first, [int(table[i, 0]) - max_bits, int(table[i, 0]) + max_bits + 1])  # sorted by the first pivot
        at = order[lo:hi]
        at = at[np.abs(table[at, 1:] - table[i, 1:]).max(axis=1, initial=0) <= max_bits]
        at = at[np.bitwise_count(fps[at] ^ fps[i]).sum(axis=1) <= max_bits]
        covered[at] = True
        for j in at.tolist():
            join(i, j)
    part = np.array([find(i) for i in range(n)])
    rest = order[~centre[order]]
    if len(np.unique(part[rest])) < 2:
        return links
    first = table[rest, 0].astype(np.int32)
    for lo in range(0, len(rest), rows):
        own = rest[lo : lo + rows]
        other = rest[lo : int(np.searchsorted(first, int(first[min(lo + rows, len(rest)) - 1]) + max_bits, side="right"))]
        keep = part[own][:, None] != part[other][None, :]
        for p in range(table.shape[1]):
            keep &= np.abs(table[own, None, p] - table[None, other, p]) <= max_bits
        i, j = np.nonzero(keep)
        near = np.bitwise_count(fps[own[i]] ^ fps[other[j]]).sum(axis=1) <= max_bits
        for a, b in zip(own[i[near]].tolist(), other[j[near]].tolist()):
            join(a, b)
    return links


def _forest(max_bits: int):
    link = T.ArrayType(T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))

    @F.pandas_udf(link)
    def forest(nodes: pd.Series, fps: pd.Series, tables: pd.Series) -> pd.Series:
        out = []
        for node, fp, table in zip(nodes, fps, tables):
            found = spanning_forest(_matrix(pd.Series(fp)), _table(table), max_bits)
            out.append([{"a": int(node[a]), "b": int(node[b])} for a, b in found])
        return pd.Series(out)

    return forest


def key_sizes(keyed: DataFrame) -> DataFrame:
    """(key, n, a, b): the keys that more than one node has, with their number and the least and greatest of them."""
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("a"), F.max("node").alias("b")).where("n > 1")
    return written(sizes, "simhash-keys")


def links(keyed: DataFrame, tables: DataFrame, max_bits: int = MAX_BITS, chunk: int = CHUNK, sizes: DataFrame | None = None) -> DataFrame:
    """(a, b): links between nodes that span their components.

    ``keyed`` has the candidate keys (node, key), ``tables`` each node's fingerprint
    and its distances to the pivots (node, fp, pivoted), ``sizes`` the key_sizes of
    keyed if they are known.  Keys with one node go first; candidate groups that
    many keys share are compared once.
    """
    sizes = key_sizes(keyed) if sizes is None else sizes
    tables_of = lambda side: tables.select(F.col("node").alias(side), F.col("fp").alias(f"fp_{side}"), F.col("pivoted").alias(f"pivoted_{side}"))
    pairs = sizes.where("n = 2 AND a <> b").select("a", "b").distinct().join(tables_of("a"), "a").join(tables_of("b"), "b")
    pairs = pairs.where(_near(max_bits)("fp_a", "pivoted_a", "fp_b", "pivoted_b")).select("a", "b")
    large = sizes.where("n > 2").select("key", "n")
    many = keyed.join(maybe_broadcast(large, large.count(), BROADCAST_KEYS), "key")
    many = many.withColumn("chunks", F.ceil(F.col("n") / chunk).cast("int")).withColumn("own", F.pmod(F.xxhash64("node", F.lit(7)), F.col("chunks")).cast("int"))
    # A group is a key, or a pair of its chunks: one long either way, so that little is shuffled for each member.
    chunks = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: F.xxhash64("key", F.least(j, F.col("own")), F.greatest(j, F.col("own"))))
    dealt = many.select("node", F.explode(F.when(F.col("chunks") > 1, chunks).otherwise(F.array("key"))).alias("at"))
    groups = dealt.groupBy("at").agg(F.array_sort(F.collect_set("node")).alias("nodes")).where("size(nodes) > 1").select("nodes").distinct()
    members = written(groups.select(F.xxhash64("nodes").alias("group"), F.explode("nodes").alias("node")), "simhash-groups").join(tables, "node")
    members = members.groupBy("group").agg(F.collect_list(F.struct("node", "fp", "pivoted")).alias("m"))
    return pairs.unionByName(members.select(F.inline(_forest(max_bits)("m.node", "m.fp", "m.pivoted"))))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each node's component, for nodes that have an edge.

    Alternating large-star and small-star steps: each node points its larger
    neighbours, then its smaller ones, at the least node it knows.  The number of
    steps grows with the logarithm of a component's size; every step is an
    aggregation and a join, and its result is a table in the shared folder.  Nodes
    with very many neighbours, of which there are 1 / HOT_SHARE at most, get theirs by a
    broadcast, so that no task holds all neighbours of one.
    """
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        up, (edges_now, most) = both.where("v > u"), least.agg(F.coalesce(F.sum("n"), F.lit(0)), F.max("n")).first()
        many = max(HOT_COPIES, ceil(HOT_SHARE * edges_now))
        if edges_now and most > many:
            hubs = F.broadcast(least.where(F.col("n") > many).drop("n"))
            large = up.join(hubs, "u", "left_anti").join(least.where(F.col("n") <= many).drop("n"), "u").unionByName(up.join(hubs, "u"))
        else:
            large = up.join(least.drop("n"), "u")
        large = large.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        now = written(small, "links")
        sign = now.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first()
        if sign == seen:
            roots = now.groupBy("v").agg(F.first("v").alias("root")).select(F.col("v").alias("node"), "root")
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
        seen = sign


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, text_hash, fp, component_id) for every row of documents.

    component_id is the smallest doc_id reachable over links, the row's own
    included.  Null and wordless texts have fingerprint zero and link like any
    other.  Rows that repeat keep one result row each; a null doc_id never becomes
    a component_id unless its whole component has none.  An empty table gives an
    empty result.
    """
    return _narrow(docs, max_bits).drop("root")


def _narrow(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """near_duplicates with root, a node that only the rows of one component share; ids may repeat or be null."""
    rows = written(fingerprints(docs), "fingerprints")
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("copies"))
    distinct = written(distinct.select(F.col("fp").alias("node"), "fp", "least_id", "copies", _pivoted("fp").alias("pivoted")), "distinct")
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(block_masks(max_bits))])
    keyed = distinct.select("node", F.explode(keys).alias("key"))
    return _grouped(rows.withColumn("node", F.col("fp")), distinct, keyed, max_bits).drop("node")


def _wide_keys(texts: DataFrame, docs: DataFrame, hot_key: int = HOT_KEY) -> tuple[DataFrame, DataFrame]:
    """The keys (node, key) of texts (text_hash, node, keys), in an order that has shared shingles last, and their key_sizes.

    The keys are exact under any order that all texts have in common; this one only
    keeps passages that very many texts share from bringing all of these together.
    Where a key is in more than ``hot_key`` texts, and more than one in HOT_KEYS of
    all keys, the shingles of the texts that have it are counted, and the hot ones
    among them, HOT_KEYS at most, come last for every text.
    """
    keyed = texts.select("node", F.explode("keys").alias("key"))
    sizes = key_sizes(keyed)
    limit = max(hot_key, (texts.agg(F.sum(F.size("keys"))).first()[0] or 0) // HOT_KEYS)
    hot = sizes.where(F.col("n") > limit).select("key")
    n_hot = hot.count()
    if not n_hot:
        return keyed, sizes
    own = texts.select("text_hash", F.explode("keys").alias("key")).join(maybe_broadcast(hot, n_hot, BROADCAST_KEYS), "key", "left_semi")
    touched = written(own.select("text_hash").distinct(), "hot-texts")
    touched = maybe_broadcast(touched, touched.count())
    held = docs.select(F.xxhash64("text").alias("text_hash"), "text").join(touched, "text_hash", "left_semi")
    each = held.select("text_hash", _shingles("text").alias("all")).dropDuplicates(["text_hash"])
    shared = each.select(F.explode("all").alias("key")).groupBy("key").count().where(F.col("count") > limit)
    # Each has more than `limit` texts among those touched, whose shingles are about five times their keys.
    last = [r[0] for r in shared.orderBy(F.desc("count"), "key").limit(5 * HOT_KEYS).select("key").collect()]
    last = docs.sparkSession.sparkContext.broadcast(np.sort(np.array(last, dtype=np.int64).view(np.uint64)))
    again = held.select("text_hash", _wide(last)("text").alias("w")).groupBy("text_hash").agg(F.first("w.keys").alias("again"))
    texts = written(texts.join(again, "text_hash", "left").select("node", F.coalesce("again", "keys").alias("keys")), "wide-texts")
    keyed = texts.select("node", F.explode("keys").alias("key"))
    return keyed, key_sizes(keyed)


def _wide_groups(docs: DataFrame, max_bits: int = WIDE_BITS, hot_key: int = HOT_KEY) -> DataFrame:
    """(doc_id, text_hash, fp, component_id, root) by wide fingerprints of five-word shingles."""
    rows = written(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), _wide()("text").alias("w")).select("doc_id", "text_hash", "w.fp", "w.keys"), "wide-fingerprints")
    texts = rows.groupBy("text_hash").agg(F.first("fp").alias("fp"), F.first("keys").alias("keys"))
    texts = written(texts.withColumn("node", F.xxhash64("fp")), "wide-texts")
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("copies"))
    distinct = written(distinct.select(F.xxhash64("fp").alias("node"), "fp", "least_id", "copies", _pivoted("fp").alias("pivoted")), "distinct")
    keyed, sizes = _wide_keys(texts, docs, hot_key)
    return _grouped(rows.select("doc_id", "text_hash", "fp", F.xxhash64("fp").alias("node")), distinct, keyed, max_bits, sizes).drop("node")


def _grouped(rows: DataFrame, distinct: DataFrame, keyed: DataFrame, max_bits: int, sizes: DataFrame | None = None) -> DataFrame:
    """rows (doc_id, text_hash, fp, node) with component_id and root."""
    root = components(links(keyed, distinct.select("node", "fp", "pivoted"), max_bits, sizes=sizes)).withColumnRenamed("node", "_node")
    joined = distinct.join(root, distinct.node == F.col("_node"))
    least = joined.groupBy("root").agg(F.min("least_id").alias("component_id"))
    linked = joined.select("node", "root").join(least, "root").select("node", "root", "component_id")
    own = written(distinct.join(linked, "node", "left").select("node", "copies", F.coalesce("root", "node").alias("root"), F.coalesce("component_id", "least_id").alias("component_id")), "components")
    # Fingerprints with very many copies would meet in one task.  As each has a share of HOT_SHARE of all rows,
    # there are 1 / HOT_SHARE of them at most, and these few are broadcast instead.
    many = max(HOT_COPIES, ceil(HOT_SHARE * (distinct.agg(F.sum("copies")).first()[0] or 0)))
    hot = F.broadcast(own.where(F.col("copies") >= many).drop("copies"))
    rest = rows.join(hot.select("node"), "node", "left_anti").join(own.where(F.col("copies") < many).drop("copies"), "node")
    return rest.unionByName(rows.join(hot, "node")).select("doc_id", "text_hash", "fp", "node", "component_id", "root")


def one_per_group(docs: DataFrame) -> DataFrame:
    """The rows of documents that stay when one document of each group does: the one whose id is the group's.

    Groups are of wide fingerprints: texts whose five-word shingles have a Jaccard
    similarity of 0.8 or more are candidates, and link if at most WIDE_BITS of 256
    bits differ.  All columns stay, whatever they are.  Of rows of one group that
    share that id one stays, the least by its other columns; rows that share only
    the id are judged by their own texts, so each of several groups with one id
    keeps a row.  Of several rows without id in a group without any id one stays as
    well.  Null and wordless texts are one group; an empty table gives an empty
    result.
    """
    groups = written(_wide_groups(docs.select("doc_id", "text")), "near-groups")
    head = F.col("doc_id").eqNullSafe(F.col("component_id"))
    gone = groups.where(~head).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    gone = written(gone, "near-copies")
    again = groups.where(head).groupBy(F.col("root").alias("_root")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_root")
    again = written(again, "repeated-ids")
    gone_rows, again_rows = gone.count(), again.count()
    rows = with_row(docs, "doc_id", "text").withColumn("_own", F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_hash"))
    stay = rows.join(maybe_broadcast(gone, gone_rows), same, "left_anti")
    if not again_rows:
        return stay.select("_row.*")
    repeated = groups.where(head).join(maybe_broadcast(again, again_rows), F.col("root") == F.col("_root"))
    repeated = written(repeated.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "_root").distinct(), "repeated-rows")
    repeated = maybe_broadcast(repeated, repeated.count())
    one = stay.join(repeated, same).groupBy("_root").agg(F.min_by("_row", F.to_json("_row", {"ignoreNullFields": "false"})).alias("_row"))
    return stay.join(repeated, same, "left_anti").select("_row.*").unionByName(one.select("_row.*"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered query: doc_id, fingerprint (16 hex digits), component_id of every document."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
