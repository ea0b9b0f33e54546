import random

import numpy as np

from voxloom.llm import near_copies as nc


def plain(text, k=5):
    w = (text or "").encode().lower().split()
    n = min(k, len(w))
    return frozenset(b" ".join(w[i : i + n]) for i in range(len(w) - n + 1)) if w else frozenset()


def edited(rng, text, n):
    w = text.split(" ")
    for k in rng.sample(range(len(w)), n):
        w[k] = f"new{rng.randint(0, 10**6)}"
    return " ".join(w)


def prose(rng, n):
    return " ".join(f"w{rng.randint(0, 5000)}" for _ in range(n))


def test_copies_with_word_edits_are_one(spark):
    rng = random.Random(3)
    texts = []
    for _ in range(30):
        base = prose(rng, rng.randint(60, 300))
        texts += [base, edited(rng, base, 1), edited(rng, base, 2), edited(rng, base, len(base.split()) // 4)]
    sets, root = [plain(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    want = sorted(set(root))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert sorted(r["doc_id"] for r in nc.one_of_each_text(df).collect()) == want
    assert 30 < len(want) < 70


def test_links_run_through_texts_between():
    a = np.arange(100, dtype=np.uint64)
    sets = [a, a + np.uint64(11), a + np.uint64(22), a + np.uint64(500), a + np.uint64(12)]
    assert nc.linked_sets(sets).tolist() == [0, 0, 0, 3, 0]
    assert nc.linked_sets([a, a[:80], a[:79]]).tolist() == [0, 0, 0]
    assert nc.linked_sets([a, a[:79]]).tolist() == [0, 1]


def test_rows_with_null_and_repeated_ids_stay_if_their_texts_differ(spark):
    rng = random.Random(4)
    x, y, z, u = (prose(rng, 80) for _ in range(4))
    rows = [(7, x), (7, y), (3, edited(rng, x, 1)), (None, z), (None, u), (None, z), (None, y), (9, None), (None, ""), (4, "one two"), (4, "One  TWO")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r["doc_id"], r["text"]) for r in nc.one_of_each_text(df).collect()]
    assert sorted(got, key=str) == sorted([(7, y), rows[2], (None, z), (None, u), (9, None), next(g for g in got if g[0] == 4)], key=str)


def test_large_families_and_buckets_are_dealt_in_parts(spark):
    from voxloom.llm import simhash
    from voxloom.llm.shared import Workspace

    rng = random.Random(8)
    base = prose(rng, 120)
    texts = [edited(rng, base, rng.randint(0, 3)) for _ in range(60)] + [prose(rng, 90) for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    sets, root = [plain(t) for t in texts], list(range(80))
    for i in range(80):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    assert sorted(r["doc_id"] for r in nc.one_of_each_text(df, block=8).collect()) == sorted(set(root)) and 20 < len(set(root)) < 60
    fps = [simhash.wide_fingerprint(nc.shingles(t)[1]) for t in texts]
    nodes = spark.createDataFrame(list(enumerate(map(bytearray, fps))), "node long, fp binary")
    close = lambda a, b: sum((x ^ y).bit_count() for x, y in zip(a, b)) <= 31
    near = [(a, b) for a in range(80) for b in range(a) if close(fps[a], fps[b])]
    for block in (1 << 16, 16):
        got = simhash.components(simhash.wide_links(nodes, 31, Workspace(spark, "t"), block=block), Workspace(spark, "t"))
        root = {r["node"]: r["root"] for r in got.collect()}
        assert all(root.get(a, a) == root.get(b, b) for a, b in near)
        assert all(any(root.get(a, a) == root.get(b, b) for b in range(80) if b != a and ((a, b) in near or (b, a) in near)) for a in root)


def test_comparison_along_the_rows_and_from_link_to_link_agree():
    from voxloom.llm import simhash

    rng = np.random.default_rng(2)
    for n, radius in ((1, 3), (2, 0), (70, 20), (300, 26), (300, 0)):
        fps = rng.integers(0, 256, (n, 8), np.uint8)
        fps[rng.random((n, 8)) < 0.6] = 7
        far = np.bitwise_count(fps[:, None] ^ fps[None]).sum(2)
        i, j = simhash.neighbours_linked(fps, np.zeros(n, int), radius, n + 1)
        assert set(zip(i.tolist(), j.tolist())) == {(a, b) for a in range(n) for b in range(a + 1, n) if far[a, b] <= radius}
        root = list(range(n))
        for a in range(n):
            for b in range(a):
                if far[a, b] <= radius and root[a] != root[b]:
                    root = [min(root[a], root[b]) if r in (root[a], root[b]) else r for r in root]
        u, v = simhash.stars(fps, radius)
        got = np.arange(n)
        got[v] = u
        assert got.tolist() == root


def joined(n, pairs):
    root = list(range(n))
    for a, b in pairs:
        if root[a] != root[b]:
            root = [min(root[a], root[b]) if r in (root[a], root[b]) else r for r in root]
    return root


def test_buckets_of_rows_without_links_are_compared_together(monkeypatch):
    from voxloom.llm import simhash

    rng, calls, within = np.random.default_rng(6), [], simhash._within
    monkeypatch.setattr(simhash, "_within", lambda *a: calls.append(1) or within(*a))
    fps = rng.integers(0, 256, (30 * 80, 16), np.uint8)
    u, v = simhash._edges(fps, np.arange(30) * 80, np.full(30, 80), 31)
    assert not len(v) and len(calls) < 100  # not one a row


def test_buckets_of_close_and_of_other_rows_keep_all_links(monkeypatch):
    from voxloom.llm import simhash

    rng = np.random.default_rng(7)
    for joins in (1 << 21, 50):  # links are put together as they come, too
        monkeypatch.setattr(simhash, "LINKS", joins)
        fps, sizes = rng.integers(0, 256, (700, 16), np.uint8), np.array([3, 300, 1, 60, 200, 136])
        starts = np.cumsum(sizes) - sizes
        for at, n, share in ((10, 150, 0.06), (200, 40, 0.1), (420, 9, 0.02), (570, 130, 0.13)):
            fps[at : at + n] = fps[at] ^ np.packbits(rng.random((n, 128)) < share, axis=1)
        fps[rng.permutation(np.arange(3, 303))] = fps[3:303].copy()
        group = np.repeat(np.arange(6), sizes)
        far = np.bitwise_count(fps[:, None] ^ fps[None]).sum(2)
        near = np.argwhere((far <= 31) & (group[:, None] == group[None]))
        got = joined(700, zip(*(x.tolist() for x in simhash._edges(fps, starts, sizes, 31))))
        assert got == joined(700, near.tolist()) and 300 < len(set(got)) < 600


def test_groups_are_whole_however_rows_come():
    import pyarrow as pa

    from voxloom.llm import simhash

    rng = random.Random(1)
    keys = sorted(rng.randint(0, 40) for _ in range(3000))
    batches, at = [], 0
    while at < 3000:
        n = rng.randint(0, 70)
        batches.append(pa.RecordBatch.from_arrays([pa.array(keys[at : at + n], pa.int64()), pa.array(range(at, min(3000, at + n)), pa.int64())], ["key", "node"]))
        at += n
    for together in (1, 100, 1 << 17):
        simhash.TOGETHER, before = together, simhash.TOGETHER
        parts = list(simhash._whole_groups(batches, ("key", "node"), 1))
        simhash.TOGETHER = before
        assert [x for p in parts for x in p[0].tolist()] == keys and [x for p in parts for x in p[1].tolist()] == list(range(3000))
        assert all(p[0][-1] != q[0][0] for p, q in zip(parts, parts[1:]))
    assert list(simhash._whole_groups([], ("key", "node"), 1)) == []


def test_sets_of_a_large_group_are_not_compared_one_by_one(monkeypatch):
    rng = np.random.default_rng(5)
    base = np.arange(100, dtype=np.uint64)
    sets = [np.r_[base[:90], rng.integers(1000, 2**60, 3, np.uint64)] for _ in range(200)]
    between = np.r_[base[:90], np.arange(500, 512, dtype=np.uint64)]
    sets += [np.r_[base[:78], np.arange(500, 512, dtype=np.uint64)], rng.integers(1000, 2**60, 90, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.uint64), between]
    sets = [np.unique(sets[k]) for k in rng.permutation(len(sets))]
    common = np.array([[len(np.intersect1d(a, b)) for a in sets] for b in sets])
    size = np.array([len(s) for s in sets])
    want = joined(len(sets), np.argwhere(100 * common >= 80 * (size + size[:, None] - common)).tolist())
    calls, split = [], np.split
    monkeypatch.setattr(np, "split", lambda *a: calls.append(1) or split(*a))
    assert nc.linked_sets(sets).tolist() == want and len(set(want)) == 3
    assert len(calls) < 40  # two for each set that is compared with all
