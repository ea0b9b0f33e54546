import random
import re

import numpy as np
import xxhash

from voxloom.llm import simhash


def plain(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def reach(pairs, nodes):
    root = {n: n for n in nodes}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_against_brute_force(docs, rows):
    got = sorted(tuple(r) for r in simhash.simhash_groups(docs).collect() if r["doc_id"] is not None)
    low = lambda i: -1 if i is None else i
    fps = [(low(i), plain(t)) for i, t in rows]
    root = reach([(a, b) for _, a in fps for _, b in fps if (a ^ b).bit_count() <= 2], {f for _, f in fps})
    least = {}
    for i, f in fps:
        least[root[f]] = min(i, least.get(root[f], i))
    want = sorted((i, f"{f:016x}", None if least[root[f]] == -1 else least[root[f]]) for i, f in fps if i != -1)
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert {x[:2]: x[2] for x in got} == {x[:2]: x[2] for x in want}


def test_links_of_large_and_small_buckets(spark):
    rng = random.Random(2)
    fps = {0, 2**64 - 1}
    for _ in range(12):
        seed = rng.getrandbits(64)
        fps |= {seed ^ sum(1 << b for b in rng.sample(range(rng.choice([6, 64])), rng.randint(0, 3))) for _ in range(60)}
    fps = sorted(fps)
    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    edges = [(int(np.int64(r["u"]).astype(np.uint64)), int(np.int64(r["v"]).astype(np.uint64))) for r in simhash.bucket_links(df).collect()]
    want = reach([(a, b) for a in fps for b in fps if (a ^ b).bit_count() <= 2], fps)
    assert reach(edges, fps) == want
    assert len(want) > len(set(want.values())) > 10


def test_dense_group_has_a_star_not_its_pairs():
    fps = np.arange(1 << 12, dtype=np.uint64)
    u, v = simhash.linked(fps, 2, list(range(16)))
    assert len(u) == len(fps) - 1
    assert set(u.tolist()) == {0}


def test_components_of_chains(spark):
    from voxloom.llm.shared import Workspace

    edges = [(i, i + 1) for i in range(60)] + [(200, 150), (150, 199)]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "u long, v long"), Workspace(spark, "t")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 199: 150, 200: 150}


def test_no_documents_and_one_of_each(no_docs, docs, rows):
    assert simhash.simhash_groups(no_docs).count() == 0
    kept = simhash.one_of_each_group(docs)
    assert kept.columns == docs.columns
    groups = {(r["doc_id"], r["component_id"]) for r in simhash.simhash_groups(docs).collect()}
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted({str(a) for a, b in groups if a == b})
