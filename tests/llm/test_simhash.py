import random
from math import ceil

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemill.llm import simhash


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in low.translate(dict.fromkeys([0x20, 9, 10, 11, 12, 13], " ")).split(" ") if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    """rows: (doc_id, fp); least doc_id reachable over links of at most four bits."""
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(len(rows)):
                if bin(rows[i][1] ^ rows[j][1]).count("1") <= 4 and label[i] > label[j]:
                    label[i], changed = label[j], True
    return {i: min((rows[j][0] for j in range(len(rows)) if label[j] == label[i] and rows[j][0] is not None), default=None) for i in range(len(rows))}


def test_fingerprints_equal_brute_force(texts):
    for t in [*texts[:-1], "A b C d", "a B c D"]:
        assert simhash.fingerprint(t) == brute_fingerprint(t)
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0
    assert simhash.fingerprint("A b C d") == simhash.fingerprint("a B c D") != simhash.fingerprint("É b c d")


def test_components_equal_brute_force(docs):
    got = simhash.near_duplicates(docs).collect()
    rows = [(r.doc_id, r.fp % 2**64) for r in got]
    expected = brute_components(rows)
    assert [r.component_id for r in got] == [expected[i] for i in range(len(rows))]
    assert len(got) == docs.count()


def test_forest_spans_what_links_connect():
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = np.concatenate([centre, *[centre ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) for _ in range(12)]])
    distinct = np.unique(fps)
    matrix = distinct[:, None]
    found = [(int(distinct[i]), int(distinct[j])) for i, j in simhash.spanning_forest(matrix, simhash.pivot_table(matrix), 4, rows=37)]
    assert len(found) < len(distinct)
    assert all(bin((a ^ b) % 2**64).count("1") <= 4 for a, b in found)

    def groups(links):
        root = {int(f): int(f) for f in distinct}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in links:
            root[find(a % 2**64)] = find(b % 2**64)
        return {frozenset(x for x in root if find(x) == r) for r in map(find, list(root))}

    every = [(int(a), int(b)) for a in distinct for b in distinct if a < b and bin(int(a) ^ int(b)).count("1") <= 4]
    assert groups(found) == groups(every)


def test_groups_above_a_chunk_lose_no_link(spark):
    rng = np.random.default_rng(5)
    base = int(rng.integers(0, 2**62))
    fps = {base}
    while len(fps) < 60:  # a walk: neighbours are linked, far ends are not
        base ^= 1 << int(rng.integers(0, 64))
        fps.add(base)
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    df = spark.createDataFrame([(f, f) for f in signed], "node long, fp long").withColumn("pivoted", simhash._pivoted("fp"))
    keyed = df.select("node", F.explode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) + F.lit(i) for i, m in enumerate(simhash.block_masks(4))])).alias("key"))
    roots = simhash.components(simhash.links(keyed, df, chunk=4)).collect()
    assert len(roots) == len(fps) and len({r.root for r in roots}) == 1


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001)], "a long, b long")
    roots = {r.node: r.root for r in simhash.components(edges).collect()}
    assert {roots[i] for i in range(201)} == {0} and roots[1001] == 1000


def test_one_document_of_each_group_stays(docs):
    groups = simhash._wide_groups(docs.select("doc_id", "text")).collect()
    stay = simhash.one_per_group(docs)
    assert stay.columns == docs.columns
    ids = [r.doc_id for r in stay.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(c for c, _ in {(r.component_id, r.root) for r in groups} if c is not None)


def test_groups_that_share_an_id_or_have_none_each_keep_a_document(spark):
    words = "river stone cloud paper window market garden silver copper engine".split()
    text = [" ".join(f"{w}{k}{i}" for i in range(3) for w in words) for k in "abcdef"]
    rows = [(5, text[0], 1), (5, text[0], 2), (5, text[1], 3), (None, text[2], 4), (None, text[2], 5), (None, text[3], 6), (7, text[4], 7), (None, text[4], 8), (8, text[5], 9), (9, text[5], 10), (None, None, 11), (None, "", 12)]
    stay = simhash.one_per_group(spark.createDataFrame(rows, "doc_id long, text string, n long")).collect()
    assert sorted(r.n for r in stay if r.n < 11) == [1, 3, 4, 6, 7, 9] and len(stay) == 7


def test_empty_table(empty):
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.one_per_group(empty).count() == 0


# wide fingerprints


def shingle_set(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(rng, text, n):
    words = text.split()
    for at in rng.sample(range(len(words)), n):
        words[at] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def corpus(spark):
    """Texts with edits of many strengths, copies, and a passage that most of them share."""
    rng = random.Random(21)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9))) for _ in range(n))
    passage = prose(30)
    texts = []
    for i in range(60):
        base = prose(rng.randrange(80, 300)) + (" " + passage if i % 3 else "")
        texts += [base, *(edited(rng, base, k) for k in (1, 2, 3, 4, 6))]
    texts += [texts[0], texts[6].upper(), None, "", "one two", prose(20_000)]
    texts.append(edited(rng, texts[-1], 5))
    return texts, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").cache()


def test_shared_keys_are_exact_under_any_order(corpus):
    rng, sets = random.Random(3), [np.unique(simhash.shingle_hashes(t, 5)) for t in corpus[0]]
    every = np.unique(np.concatenate(sets))
    hot = np.sort(np.array(rng.sample(every.tolist(), 2000), dtype=np.uint64))
    for order in (hot[:0], hot):
        keys = [set(simhash.prefix(s, order).tolist()) for s in sets]
        assert all(len(k) == len(s) - ceil(0.8 * len(s) - 1e-9) + 1 for k, s in zip(keys, sets) if len(s))
        for i in range(len(sets)):
            for j in range(i):
                if len(sets[i]) and len(sets[j]) and 0.7 < len(sets[i]) / len(sets[j]) < 1.5:
                    both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if both / (len(sets[i]) + len(sets[j]) - both) >= 0.8:
                        assert keys[i] & keys[j]


@pytest.mark.parametrize("hot_key", [4096, 20])
def test_wide_groups_catch_near_copies(corpus, hot_key):
    texts, docs = corpus
    group = {r.doc_id: r.component_id for r in simhash._wide_groups(docs, hot_key=hot_key).collect()}
    sets = [shingle_set(t) for t in texts]
    pairs = [(i, j, similarity(sets[i], sets[j])) for i in range(len(texts)) for j in range(i) if abs(i - j) < 6 or i >= 360]
    near = [group[i] == group[j] for i, j, s in pairs if s >= 0.8]
    far = [group[i] == group[j] for i in range(360) for j in range(i) if i // 6 != j // 6]  # within a family links may lead from edit to edit
    assert sum(near) / len(near) >= 0.9 and not any(far)


def test_wide_groups_equal_brute_force(corpus):
    texts, docs = corpus
    sets = [np.unique(simhash.shingle_hashes(t, 5)) for t in texts]
    keys = [set(simhash.prefix(s, s[:0]).tolist()) for s in sets]
    fps = [int.from_bytes(simhash.majority(simhash.widened(s)).tobytes(), "little") for s in sets]
    label = list(range(len(texts)))
    links = [(i, j) for i in range(len(texts)) for j in range(i) if fps[i] == fps[j] or keys[i] & keys[j] and (fps[i] ^ fps[j]).bit_count() <= simhash.WIDE_BITS]
    changed = True
    while changed:
        changed = False
        for i, j in links:
            if label[i] != label[j]:
                label[i] = label[j] = min(label[i], label[j])
                changed = True
    assert {r.doc_id: r.component_id for r in simhash._wide_groups(docs).collect()} == dict(enumerate(label))
