"""The whole pipeline against a plain version of it that shares no code with the operators, and the registration of its queries."""

import hashlib
import os
import random
import re
from collections import Counter, defaultdict

import pytest
from conftest_text import clean_text  # noqa: F401

import __spark_entry__
import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id long, _row string, shard string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    text = lambda n: clean_text(rng, n)
    bench = [(i, text(30)) for i in range(4)]
    docs = [(i, text(rng.randrange(60, 300)), "en", f"s{i % 3}") for i in range(120)]
    docs += [(200 + i, docs[i][1], "en", "s0") for i in range(10)]  # copies
    docs += [(250 + i, docs[20 + i][1].rsplit(" ", 2)[0] + " two changed", "en", "s2") for i in range(10)]  # near copies
    docs += [(300 + i, text(40) + " " + bench[i][1] + " " + text(40), "en", "s1") for i in range(4)]  # leaks
    docs += [(400, "a short text", "en", "s2"), (401, None, "en", None), (402, "a%% b## c$$ " * 60, "en", "s1"), (403, text(30_000), "de", None), (404, "the same again and " * 40, "en", "s1"), (405, "", None, None)]
    docs += [docs[3], (None, text(80), None, "s0"), (7, text(90), "en", "s1")]  # a row that repeats, no id, an id that is taken
    rows = [(*d, len(d[1] or ""), i, "x", "y") for i, d in enumerate(docs)]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows, bench


def plain(rows, bench):
    """(row, copies) of what the pipeline returns: faults by regular expression, groups by similarity of shingle sets, leaks by substring, draws by MD5."""
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")

    def passes(t):
        w = words(t)
        windows = Counter(zip(w, w[1:], w[2:]))
        covered = {i + k for i, x in enumerate(zip(w, w[1:], w[2:])) if windows[x] > 1 for k in range(3)}
        return len(w) > 0 and not (len(w) >= 50 and len(covered) * 2 > len(w)) and 100 * len(re.findall(r"[#*$%&|<>]", t)) <= 15 * len(w)

    kept = [r for r in rows if passes(r[1])]
    sets = [{" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (words(r[1].lower()) for r in kept)]
    label = list(range(len(kept)))
    for i in range(len(kept)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
    groups = defaultdict(list)
    for r, g in zip(kept, label):
        groups[g].append(r)
    kept = [min(g, key=lambda r: (r[0] is None, r[0])) for g in groups.values()]
    kept = [r for r in kept if not any(t in r[1] for _, t in bench)]
    size = Counter()
    for r in kept:
        size[r[3]] += len(words(r[1]))
    names = sorted((s for s in size if s is not None)) + [None] * (None in size)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    held = set()
    while True:  # sources above twice their size stop there
        level = (1.5 * sum(size.values()) - sum(2 * size[s] for s in held)) / max(1, sum(weight[s] for s in names if s not in held))
        over = {s for s in names if s not in held and level * weight[s] > 2 * size[s]}
        if not over:
            break
        held |= over
    out = []
    for r in kept:
        rate = 2.0 if r[3] in held else level * weight[r[3]] / size[r[3]]
        draw = hashlib.md5(f"mix|{'' if r[0] is None else r[0]}|{hashlib.md5(r[1].encode()).hexdigest()}".encode()).hexdigest()
        out.append((r, int(rate) + (int(draw[:13], 16) / 2**52 < rate - int(rate))))
    return out


def test_pipeline_equals_the_plain_version(spark, folder):
    path, rows, bench = folder
    out = corpus_pipeline.run(spark, path)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "_id", "_row", "shard", "shard_depth"]
    found = out.collect()
    expected = plain(rows, bench)
    assert Counter((r.doc_id, r.text) for r in found) == Counter({(r[0], r[1]): n for r, n in expected if n})
    assert {(r.shard, r.shard_depth) for r in found} == {("", 0)}  # all fit one shard
    assert 1.2 < sum(n * len(r[1].split()) for r, n in expected) / sum(len(r[1].split()) for r, _ in expected) < 1.8
    assert {r.doc_id for r in found} & {200, 255, 300, 301, 401, 402, 404, 405} == set() and None in {r.doc_id for r in found}


def test_stages_keep_the_columns(spark, folder):
    path, *_ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "decontamination", "mixing", "sharding"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs.limit(0), path)
        assert out.columns == docs.columns and out.count() == 0
        whole = stage(spark, docs, path)
        assert whole.columns == docs.columns and set(whole.collect()) <= set(docs.collect())
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), path).count() == 0


def test_every_operator_is_registered():
    names = __spark_entry__.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op") and n[2].isdigit()} == {f"op{i}" for i in range(1, 11)}
    assert "pipeline" in names and "op6_mixing" in __spark_entry__.oracle_sql()
    assert os.path.isfile(corpus_pipeline.__file__)
