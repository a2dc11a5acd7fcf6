"""Operators on documents against brute force: mixing, sharding, quality, tokens, secrets, decontamination."""

import hashlib
import math
import random
import re
import time
from collections import Counter, defaultdict
from itertools import combinations

import pytest

from tidemill.llm import decontaminate, mixing, quality, secrets, sharding, tokens

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def n_words(text):
    return len(WORDS.findall(text or ""))


# mixing


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=str.encode) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, free, pool = dict.fromkeys(names, 0.0), set(names), 1.5 * sum(sizes.values())
    while pool > 1e-6 and free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if target[s] + pool * weight[s] / total >= 2 * sizes[s]}
        if not over:
            for s in free:
                target[s] += pool * weight[s] / total
            break
        part = pool
        for s in over:
            pool -= 2 * sizes[s] - target[s]
            target[s] = 2 * sizes[s]
        share = {s: part * weight[s] / total for s in free - over}
        free -= over
        for s in free:  # what they already have stays theirs
            target[s] += share[s]
            pool -= share[s]
        if abs(pool) < 1e-9:
            break
    return target


def test_targets_equal_repeated_sharing(docs):
    rows = mixing.decisions(docs).collect()
    sizes = defaultdict(int)
    for r in docs.collect():
        sizes[r.source] += n_words(r.text)
    of = {(r.source_size, round(r.target, 6)) for r in rows}
    assert of == {(n, round(t, 6)) for s, t in brute_targets(sizes).items() for n in [sizes[s]]}
    assert sum(t for _, t in of) == pytest.approx(1.5 * sum(sizes.values()))


def test_taken_is_near_the_target(spark):
    rng = random.Random(1)
    docs = spark.createDataFrame([(i, "w " * rng.randrange(1, 40), f"s{i % 7}") for i in range(6000)], "doc_id long, text string, source string")
    rows = mixing.decisions(docs).collect()
    taken, target = Counter(), {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        taken[f"s{r.doc_id % 7}"] += r.taken
        target[f"s{r.doc_id % 7}"] = r.target
    assert all(abs(taken[s] - t) < 0.06 * t for s, t in target.items())
    assert sorted(rows) == sorted(mixing.decisions(docs).collect())


def test_rows_without_id_and_repeated_rows_draw_apart(spark):
    rows = [(None, f"{'w ' * (1 + i % 9)}{i}", "a") for i in range(2000)] + [(7, "same text again", "b")] * 2000 + [(i, "x y", None) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.decisions(docs).collect()
    taken, target = Counter(), {}
    for r in got:
        taken[r.source_size] += r.taken
        target[r.source_size] = r.target
        assert 0 <= r.taken <= 2 * r.size
    assert len(target) == 3 and all(abs(taken[s] - t) < 0.05 * t for s, t in target.items())
    again = mixing.decisions(docs.repartition(5)).collect()
    assert Counter(map(str, got)) == Counter(map(str, again))
    assert mixing.mix(docs).count() == sum(r.taken // r.size for r in got)


def test_mix_emits_the_copies(docs):
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    assert sum(n_words(r.text) for r in out.collect()) == sum(r.taken for r in mixing.decisions(docs).collect())


# sharding


def test_shards_fit_and_cover(docs):
    limit = 3000
    out = sharding.assign(docs, limit)
    assert out.columns == [*docs.columns, "shard", "shard_depth"]
    rows = out.collect()
    assert Counter(map(str, (r.asDict() | {"shard": 0, "shard_depth": 0} for r in rows))) == Counter(map(str, (r.asDict() | {"shard": 0, "shard_depth": 0} for r in docs.collect())))
    held = defaultdict(list)
    for r in rows:
        held[r.shard].append(len((r.text or "").encode()))
    assert all(sum(v) <= limit or len(v) == 1 for v in held.values())
    names = [s for s in held if "+" not in s]
    assert not any(a != b and b.startswith(a) for a in names for b in names)


def brute_shards(rows, limit):
    """{(shard, depth): sizes}: a bucket of (hash, size) splits on its next bit while it is too large."""
    out = {}

    def split(bucket, depth, name):
        if sum(n for _, n in bucket) <= limit:
            if bucket:
                out[name, depth] = sorted(n for _, n in bucket)
        elif depth == 60:
            full = max(1, limit // max(1, bucket[0][1]))
            for k in range(0, len(bucket), full):
                out[f"{name}+{k // full}", depth] = [n for _, n in bucket[k : k + full]]
        else:
            for bit in "01":
                split([(h, n) for h, n in bucket if h[depth] == bit], depth + 1, name + bit)

    split([(f"{int(hashlib.md5(key.encode()).hexdigest()[:15], 16):060b}", n) for key, n in rows], 0, "")
    return out


@pytest.mark.parametrize("limit", [100, 3000, 50_000, 10**9])
def test_shards_equal_brute_force(docs, limit):
    got = defaultdict(list)
    for r in sharding.assign(docs, limit).collect():
        got[r.shard, r.shard_depth].append(len((r.text or "").encode()))
    rows = [(f"{'' if r.doc_id is None else r.doc_id}|{r.text or ''}", len((r.text or "").encode())) for r in docs.collect()]
    assert {k: sorted(v) for k, v in got.items()} == brute_shards(rows, limit)


def test_hashes_that_share_many_bits_are_told_apart(spark):
    rows = spark.createDataFrame([(i, 10) for i in range(40)] + [(2**59 + i, 10) for i in range(3)], "h long, bytes long")
    steps, alone = sharding.directory(rows, 25)
    covered = {(bits, r.cell) for bits, leaves, _ in steps for r in leaves.collect()}
    assert alone == 0 and all(any((b, h >> (60 - b)) in covered for b, *_ in steps) for h in [*range(40), 2**59, 2**59 + 2])
    assert all(r.shard_bytes <= 25 for _, leaves, _ in steps for r in leaves.collect())


def test_only_oversized_buckets_split(spark):
    docs = spark.createDataFrame([(i, "x" * 100) for i in range(400)], "doc_id long, text string")
    rows = sharding.assign(docs, 4000).collect()
    size = Counter()
    for r in rows:
        size[r.shard] += 100
    depth = {r.shard: r.shard_depth for r in rows}
    assert all(len(s) == d for s, d in depth.items())
    parents = Counter()
    for s, n in size.items():
        for k in range(len(s)):
            parents[s[:k]] += n
    assert all(n > 4000 for n in parents.values())


def test_rows_that_repeat_overflow(spark):
    docs = spark.createDataFrame([(1, "y" * 100)] * 50 + [(2, "z")], "doc_id long, text string")
    size = Counter()
    for r in sharding.assign(docs, 1000).collect():
        size[r.shard] += len(r.text)
    assert max(size.values()) <= 1000 and sum(size.values()) == 5001


def test_overflow_numbers_go_on_from_task_to_task(spark):
    docs = spark.range(0, 60, 1, 7).selectExpr("1L AS doc_id", "repeat('y', 100) AS text", "id AS extra", "'a' AS _n")
    rows = sharding.assign(docs, 1000).collect()
    assert sorted(r.extra for r in rows) == list(range(60)) and {r._n for r in rows} == {"a"}
    assert sorted(Counter(r.shard for r in rows).values()) == [10] * 6  # full shards, whatever wrote them
    assert {r.shard.split("+")[1] for r in rows} == set("012345")


def test_a_text_above_the_limit_is_alone(spark):
    docs = spark.createDataFrame([(0, "x" * 5000), *[(i, "y" * 100) for i in range(1, 40)]], "doc_id long, text string")
    rows = sharding.assign(docs, 1000).collect()
    size, long = Counter(), {r.shard for r in rows if r.doc_id == 0}
    for r in rows:
        size[r.shard] += len(r.text)
    assert len(rows) == 40 and size[long.pop()] == 5000 and sorted(size.values())[-2] <= 1000


# quality


def brute_measures(text):
    text = text or ""
    words = WORDS.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_measures_equal_brute_force(texts):
    for t in [*texts[:-1], "a b c a b c", "a a a a", "a b a b a b x\n\nq\nq\n \nq", "\x1c \x85 \xa0 #"]:
        assert quality.measure(t)[:5] == brute_measures(t)


def test_keep_applies_the_policy(docs, empty):
    kept = quality.keep(docs)
    assert kept.columns == docs.columns
    passed = [r for r in docs.collect() if n_words(r.text)]  # short texts without another fault stay
    assert sorted(r.doc_id or -1 for r in kept.collect()) == sorted(r.doc_id or -1 for r in passed)
    assert quality.keep(empty).count() == 0


def test_ablation_by_bits(spark):
    entries = spark.createDataFrame([(0,), (1,), (1,), (3,), (4,)], "fail_bits long")
    rows = {(r.policy, r.without_rule): r.kept for r in quality.ablation(entries).collect()}
    assert rows[("base", None)] == 2 and rows[("base", "few_words")] == 4 and rows[("v1", None)] == 1


# tokens


@pytest.fixture(scope="module")
def vocabulary():
    public = pytest.importorskip("public_tokenizers")
    return public.path("byte_bpe_50k.json")


def test_counts_equal_the_library(docs, vocabulary, empty):
    own = tokens.tokenizer(vocabulary)
    for r, d in zip(tokens.counts(docs, vocabulary).collect(), docs.collect()):
        text = d.text or ""
        assert (r.n_bytes, r.n_tokens) == (len(text.encode()), len(own.encode(text, add_special_tokens=False).ids))
        assert r.over_limit == (r.n_tokens > 512)
    assert tokens.counts(empty, vocabulary).count() == 0


def test_splices_are_exact(vocabulary):
    own, rng = tokens.tokenizer(vocabulary), random.Random(2)
    hard = ["a" * 3000, " " * 2500 + "x", "<|endoftext|>" * 200, "they're " * 500, ("x" * 700 + " ") * 6, "é" * 2000]
    hard += ["".join(rng.choice("ab '\"s\n\t 1é<|endoftext|>  re") for _ in range(4000)) for _ in range(5)]
    for text in hard:
        for chunk, overlap in ((1000, 150), (333, 120)):
            assert tokens.count_long(text, own, chunk, overlap) == len(own.encode(text, add_special_tokens=False).ids)


# secrets


def test_base_spans_and_links(spark, empty):
    key = "AKIA" + "B" * 16
    texts = [
        f"é😀 password = 'abcdefghijkl' and {key} then {'0' * 20}",
        "token=abc",
        "secret: shortie then AKIASHORT9 near",  # two weak parts that complete one another
        "AKIASHORT9 alone",
        "secret: shortie " + "x" * 300 + " AKIASHORT9",
        "client_id=me secret=abcdef https://x.example/y",
        "",
        None,
        'password="short:abcdefghijklmnop"',
    ]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, parts int")
    rows = {r.doc_id: r for r in secrets.scan(docs).collect()}
    kinds = lambda i: [(s["kind"]) for s in sorted(rows[i]["all"])]
    assert kinds(0) == ["assign", "access", "hex"]
    assert [texts[0][s["start"] : s["end"]] for s in rows[0]["base"]][1:] == [key, "0" * 20]
    assert kinds(1) == [] and kinds(2) == ["weak_secret", "weak_access"] and kinds(3) == [] and kinds(4) == []
    assert kinds(5) == ["identity", "weak_secret", "endpoint"]
    assert kinds(6) == kinds(7) == kinds(8) == []
    assert secrets.scan(empty).count() == 0


def test_parts_link_over_the_gap_between_them(spark):
    texts = ["token=" + "z" * 400 + " client_id=abc", "https://x.example/?" + "q" * 300 + " secret=abcdef", "client_id=abc" + " " * 200 + "secret: shortie", "client_id=abc" + " " * 201 + "secret: shortie"]
    rng = random.Random(12)
    bits = ["secret=abcdef", "client_id=" + "u" * 350, "https://h.example/" + "p" * 500, "AKIASHORT9", "x" * 90, "y" * 170, "z" * 600]
    texts += [" ".join(rng.choice(bits) for _ in range(12)) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    parts = {r.doc_id: r.parts for r in secrets.scanned(docs).collect()}
    got = {r.doc_id: sorted(r["all"]) for r in secrets.scan(docs).collect()}
    for i in range(len(texts)):
        near = lambda p: {secrets.ROLE[o.kind] for o in parts[i] if max(o.start, p.start) - min(o.end, p.end) <= 200}  # noqa: B023, E731
        fits = {"secret": lambda n: n & {"identity", "endpoint"}, "identity": lambda n: "secret" in n, "endpoint": lambda n: n >= {"secret", "identity"}}
        assert got[i] == sorted(p for p in parts[i] if p["rank"] < 3 or fits[secrets.ROLE[p.kind]](near(p)))
    assert [len(got[i]) for i in range(4)] == [2, 1, 2, 0]


def test_base_digest_equals_brute_force(spark):
    rng = random.Random(4)
    patterns = [("assign", re.compile(secrets.ASSIGN), 12, 2), ("access", re.compile(secrets.ACCESS), 18, 0), ("hex", re.compile(secrets.HEX), 16, 0)]
    bits = ["token=", "API_KEY: ", "secret", " = ", '"', "deadbeef" * 3, "AKIA", "ABCDEFGH", "0123456789abcdef0", " ", "é", "\n", "passwd:'", "xyz"]
    texts = ["".join(rng.choice(bits) for _ in range(60)) for _ in range(80)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in secrets.scan(docs).collect():
        spans = sorted((m.start(), k, m.end()) for k, (_, p, least, g) in enumerate(patterns) for m in p.finditer(texts[r.doc_id]) if len(m.group(g)) >= least)
        assert [(s["start"], s["rank"], s["end"]) for s in sorted(r.base)] == spans


def test_a_text_of_very_many_matches(spark):
    n = 50_000
    text = "0123456789abcdef01 " * n + "client_id=abc secret=abcdef " * 1000
    docs = spark.createDataFrame([(None, text), (None, text), (1, "x" * 3_000_000 + " token=abcdefghijkl")], "doc_id long, text string")
    began = time.perf_counter()
    rows = secrets.scan(docs).collect()
    assert time.perf_counter() - began < 60
    assert sorted(len(r.base) for r in rows) == [1, n, n] and sorted(len(r["all"]) for r in rows) == [1, n + 2000, n + 2000]
    long = next(r for r in rows if r.doc_id is None)
    assert [(s["start"], s["end"]) for s in long.base[:: n // 7]] == [(19 * i, 19 * i + 18) for i in range(0, n, n // 7)]


def test_repeated_rows_and_rows_without_id(spark):
    texts = ["secret: shortie then AKIASHORT9 near", "AKIASHORT9 alone", "secret: shortie only"]
    docs = spark.createDataFrame([(None, texts[0]), (None, texts[1]), (None, texts[2]), (1, texts[0]), (1, texts[0]), (1, texts[1])], "doc_id long, text string")
    got = sorted((r.doc_id is None, len(r["all"])) for r in secrets.scan(docs).collect())
    assert got == [(False, 0), (False, 2), (False, 2), (True, 0), (True, 0), (True, 2)]


# decontamination


def test_leaks_are_found_and_clean_documents_left(spark, empty):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate((40, 15, 25, 5, 0))] + [(9, None)]
    noise = lambda n: " ".join(word() for _ in range(n))
    swapped = items[2][1].split()
    for at in (3, 11, 19):
        swapped[at] = "other"
    texts = {
        0: noise(50) + " " + items[0][1].upper() + ", " + noise(20),
        1: items[1][1],
        2: noise(10) + " " + " ".join(swapped) + " " + noise(3),
        3: noise(100),
        4: " ".join(items[0][1].split()[:6]) + " " + noise(30),  # six common words are no leak
        5: noise(4) + " " + items[3][1].replace(" ", "; ") + " " + noise(4),
        6: None,
        7: "",
        8: " ".join(items[0][1].split()[8:26]),  # a part of an item
    }
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, _id string")
    bench = spark.createDataFrame(items + items[:1], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.overlaps(docs, bench).collect()}
    assert found == {(0, 0), (1, 1), (2, 2), (5, 3), (8, 0)}
    repeated = docs.unionByName(docs).unionByName(spark.createDataFrame([(None, texts[0], "x")], docs.schema))
    shuffled = decontaminate.overlaps(repeated, bench, broadcast_rows=0).collect()  # the way of large benchmarks
    assert sorted(map(str, shuffled)) == sorted(map(str, decontaminate.overlaps(repeated, bench).collect())) and len(shuffled) == 6
    assert sorted(r.doc_id for r in decontaminate.clean(docs, bench).collect()) == [3, 4, 6, 7]
    assert decontaminate.clean(docs, bench).columns == docs.columns
    assert decontaminate.clean(empty, bench).count() == 0
    assert decontaminate.clean(docs, spark.createDataFrame([], "item_id long, text string")).count() == len(texts)


def test_a_passage_in_a_very_long_text(spark):
    rng = random.Random(19)
    noise = [f"n{rng.randrange(5000)}" for _ in range(150_000)]
    item = [f"b{i}" for i in range(30)]
    docs = spark.createDataFrame([(1, " ".join(noise[:140_000] + item + noise[140_000:])), (2, " ".join(noise))], "doc_id long, text string")
    items = spark.createDataFrame([(5, " ".join(item))], "item_id long, text string")
    assert [(r.doc_id, r.item_id, r.agreeing, r.doc_from) for r in decontaminate.overlaps(docs, items).collect()] == [(1, 5, 13, 140_000)]


def test_every_overlap_that_the_rule_accepts_has_a_seed(spark):
    bench, texts = [], {}
    for n in range(1, 15):
        w = min(n, 13)
        differ = w - math.ceil(w * 0.8)
        words = [f"w{n}x{i}" for i in range(n)]
        bench.append((n, " ".join(words)))
        for at in combinations(range(w), differ):
            hit = lambda m, o: all(not o <= b < o + len(m) or m[b - o] == "0" for b in at)  # noqa: B023, E731
            assert any(hit(m, o) for m in decontaminate.seeds(w) for o in range(w - len(m) + 1))
            texts[len(texts)] = (n, " ".join(["before", *("other" if i in at else x for i, x in enumerate(words[:w])), "after", *["end"] * (n - w)]))
    docs = spark.createDataFrame([(i, t) for i, (_, t) in texts.items()], "doc_id long, text string")
    items = spark.createDataFrame(bench, "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.overlaps(docs, items).collect()}
    assert found == {(i, n) for i, (n, _) in texts.items()}


def test_empty_tables(empty):
    assert mixing.mix(empty).count() == mixing.decisions(empty).count() == 0
    assert sharding.assign(empty).count() == 0
    assert quality.ledger(empty).count() == 0 and quality.ablation(quality.ledger(empty)).count() == 0


def test_all_shards_take_null_and_empty_texts(spark):
    docs = spark.createDataFrame([(None, None, 1), (1, None, 2), (2, "", 3)], "doc_id long, text string, shard int")
    rows = sharding.assign(docs).collect()
    assert len(rows) == 3 and {r.shard for r in rows} == {""}


def test_sources_without_words_are_left_out(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (3, "x y", "b"), (4, "z", None)], "doc_id long, text string, source string")
    rows = {r.doc_id: r for r in mixing.decisions(docs).collect()}
    assert rows[1].target == rows[2].target == 0 and rows[1].taken == 0
    assert rows[3].target + rows[4].target == 4.5
    assert {r.doc_id for r in mixing.mix(docs).collect()} <= {3, 4}
