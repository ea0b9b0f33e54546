import numpy as np
import pytest

from voxloom.operators import clustering as c


def bundles(*sizes, dim=16, spread=0.05, seed=0):
    rng = np.random.default_rng(seed)
    return np.concatenate([np.eye(dim)[k] + rng.normal(size=(n, dim)) * spread for k, n in enumerate(sizes)])


def naive(x):
    """Centroid linkage by recomputing every centroid."""
    groups, ids, out = {i: [i] for i in range(len(x))}, list(range(len(x))), []
    while len(groups) > 1:
        keys = sorted(groups)
        means = {k: x[groups[k]].mean(0) for k in keys}
        d, a, b = min((((means[a] - means[b]) ** 2).sum(), a, b) for i, a in enumerate(keys) for b in keys[i + 1 :])
        out.append((np.sqrt(d), len(groups[a]) + len(groups[b])))
        groups[len(ids)] = groups.pop(a) + groups.pop(b)
        ids.append(len(ids))
    return out


def test_linkage_is_that_of_recomputed_centroids():
    x = np.random.default_rng(1).normal(size=(60, 5))
    got = c.centroid_linkage(x)
    want = naive(x)
    assert np.allclose(got[:, 2], [h for h, _ in want]) and got[:, 3].tolist() == [n for _, n in want]
    assert (np.diff(got[:, 2]) < 0).any()  # heights fall on the way up here and there


def test_cut_uses_the_highest_merge_below():
    x = np.random.default_rng(1).normal(size=(60, 5))
    merges = c.centroid_linkage(x)
    t = float(np.median(merges[:, 2]))
    labels = c.cut_by_height(merges, 60, t)
    top, members = {}, {i: [i] for i in range(60)}
    for k, (a, b, h, _) in enumerate(merges):
        members[60 + k] = members[int(a)] + members[int(b)]
        top[60 + k] = max(h, top.get(int(a), 0), top.get(int(b), 0))
    for k, m in members.items():
        if k >= 60 and top[k] <= t:
            assert len(set(labels[m])) == 1


def test_finds_bundles_and_absorbs_stragglers():
    labels = c.cluster(np.concatenate([bundles(40, 30, 20), bundles(0, 0, 0, 2)]))
    assert len(set(labels[:40])) == len(set(labels[40:70])) == len(set(labels[70:90])) == 1
    assert set(labels) == {0, 1, 2} and labels[0] == 0


def test_small_cases():
    assert c.cluster(np.ones((1, 4)), 3).tolist() == [0]
    assert c.cluster(bundles(5, 5), 1).tolist() == [0] * 10
    assert c.cluster(np.zeros((0, 4))).tolist() == []
    assert set(c.cluster(np.eye(40)[:30])) == {0}  # nothing is large: one cluster
    assert c.cosine_to(np.zeros((1, 3)), np.eye(3))[0].tolist() == [1, 1, 1]
    assert c.dense(np.array([7, 7, 2, 9, 2])).tolist() == [0, 0, 1, 2, 1]


@pytest.mark.parametrize("target", [2, 3, 4])
def test_pinned_count(target):
    assert len(set(c.cluster(bundles(30, 30, 30, 30, spread=0.1), target))) == target


def test_slots(spark):
    x = bundles(20, 15)
    rows = [(7, i, 0, True, v.tolist()) for i, v in enumerate(x)] + [(7, 99, 1, False, x[0].tolist()), (7, 99, 2, True, None), (8, 0, 0, True, None)]
    df = spark.createDataFrame(rows, "file_id long, chunk_no int, local_spk int, active boolean, embedding array<double>")
    got = {(r["file_id"], r["chunk_no"], r["local_spk"]): r["cluster"] for r in c.cluster_slots(df).collect()}
    assert [got[7, i, 0] for i in range(35)] == [0] * 20 + [1] * 15
    assert got[7, 99, 1] is got[7, 99, 2] is got[8, 0, 0] is None
    assert {r["error"] for r in c.cluster_slots(df.filter("file_id = 7"), max_slots=5).collect()} == {"35 slots to cluster; the most is 5"}


def test_dataframe_forms_agree_with_arrays(spark):
    x = np.random.default_rng(5).normal(size=(90, 6))
    label = np.random.default_rng(6).integers(0, 4, 90)
    label[:3] = 5
    df = spark.createDataFrame([(0, i, int(k), v.tolist()) for i, (k, v) in enumerate(zip(label, x))], "file_id long, vec_id int, cluster int, embedding array<double>")
    near = {r["vec_id"]: r["nearest"] for r in c.nearest_centroid(df, c.centroids(df)).collect()}
    names = np.unique(label)
    means = np.stack([x[label == k].mean(0) for k in names])
    assert [near[i] for i in range(90)] == names[c.cosine_to(x, means).argmin(1)].tolist()
    least = spark.createDataFrame([(0, 12)], "file_id long, least int")
    got = {r["cluster"]: r["absorbed"] for r in c.absorb_small_clusters(df, least).collect()}
    want = c.absorb_small(label, c.large_labels(label, 12), c.normalized(x))
    assert got == {int(k): int(want[label == k][0]) for k in names}


def test_a_large_file_is_clustered_in_linear_memory():
    import tracemalloc

    x = np.concatenate([bundles(*[300] * 8, dim=64, seed=3), np.zeros((4, 64))])
    tracemalloc.start()
    merges = c.centroid_linkage(c.normalized(x))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * len(x) ** 2 / 2
    assert len(set(c.cut_by_height(merges, len(x))[:2400])) == 8


def test_linkage_keeps_its_ties():
    x = np.random.default_rng(2).integers(0, 3, (90, 2)).astype(float)
    got, want = c.centroid_linkage(x), naive(x)
    assert np.allclose(got[:80, 2], [h for h, _ in want[:80]])


def test_no_cap_unless_asked_for(spark):
    import inspect

    from voxloom.queries import QUERIES

    assert inspect.signature(c.cluster_slots).parameters["max_slots"].default is None
    got = QUERIES["hac_centroid"](spark, "/root/testdata/sf0.001")
    assert "error" in got.columns and not got.filter("cluster is null").count()


@pytest.mark.parametrize("seed", range(12))
def test_groups_apart_have_the_labels_of_one_linkage_over_all(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 40, rng.integers(1, 7))
    x = c.normalized(np.concatenate([bundles(*sizes, dim=8, spread=rng.choice([0.05, 0.2, 0.4, 0.8]), seed=seed), np.zeros((2, 8))])[rng.permutation(sizes.sum() + 2)])
    for threshold in (0.2, 0.5, c.THRESHOLD, 1.0):
        want = c.cut_by_height(c.centroid_linkage(x), len(x), threshold)
        assert c.labels_within(x, threshold).tolist() == want.tolist()
        assert sorted(np.concatenate(c.apart(x, threshold)).tolist()) == list(range(len(x)))


def test_speakers_far_apart_are_clustered_one_by_one(monkeypatch):
    seen, whole = [], c.centroid_linkage
    monkeypatch.setattr(c, "centroid_linkage", lambda x, *a: seen.append(len(x)) or whole(x, *a))
    assert c.cluster(bundles(60, 50, 40)).tolist() == [0] * 60 + [1] * 50 + [2] * 40
    assert sorted(seen) == [40, 50, 60]
