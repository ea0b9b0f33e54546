"""Clustering of speakers: centroid linkage within a file, centroids and assignment over DataFrames.

A file is one group of ``applyInPandas``; time is quadratic in the slots of its largest group that stands apart from
the others (see ``apart``), memory linear. ``max_slots`` is for those who would rather have an error row than wait;
without it every file is clustered."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import cosine_distance, doubles, l2_normalized

#: Where the dendrogram is cut, and from how many members a cluster stands by itself.
THRESHOLD, MIN_MEMBERS = 0.7045654963945799, 12


def normalized(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def cosine_to(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Distances of each row of ``x`` to each row of ``c``; 1 where one has no length."""
    return np.where(((x == 0).all(1)[:, None]) | ((c == 0).all(1)[None, :]), 1.0, 1 - normalized(x) @ normalized(c).T)


def nearest_by_cosine(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """For each row of ``x`` the nearest of ``c``, the first on ties, by blocks."""
    return np.concatenate([cosine_to(x[at : at + 1024], c).argmin(1) for at in range(0, len(x), 1024)])


def _square_to(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of each row to ``c``, by blocks."""
    out = np.empty(len(x))
    for at in range(0, len(x), 2048):
        away = x[at : at + 2048] - c
        np.einsum("ij,ij->i", away, away, out=out[at : at + 2048])
    return out


def centroid_linkage(x: np.ndarray, until: float = np.inf) -> np.ndarray:
    """Merges ``(a, b, height, size)`` by nearest centroids; nodes from ``len(x)`` on are merges in order, up to the
    first over ``until``. (Whatever comes after that one has it below, or joins centroids that were as far apart.)

    Memory is linear: each centroid has its nearest one among those after it. Where that one is gone its distance
    stays as a lower bound, and the search is done again only once the bound is the least of all.
    """
    n = len(x)
    center, node, size = x.astype(np.float64), np.arange(n), np.ones(n)
    near, least, stale = np.zeros(n, int), np.full(n, np.inf), np.zeros(n, bool)

    def search(i: int, square: np.ndarray) -> None:
        stale[i] = False
        if len(square):
            near[i] = i + 1 + int(square.argmin())
            least[i] = square[near[i] - i - 1]
        else:
            least[i] = np.inf

    def squares(i: int, at: int) -> np.ndarray:
        """From centroid ``i`` to those from ``at`` on."""
        return np.where(size[at:] > 0, _square_to(center[at:], center[i]), np.inf)

    for i in range(n):
        search(i, squares(i, i + 1))
    out = []
    for step in range(n - 1):
        while stale[i := int(least.argmin())]:
            search(i, squares(i, i + 1))
        j, d = int(near[i]), least[i]
        if np.sqrt(d) > until:
            break
        a, b = sorted((int(node[i]), int(node[j])))
        total = size[i] + size[j]
        out.append((a, b, np.sqrt(d), total))
        center[j] = (size[i] * center[i] + size[j] * center[j]) / total
        node[j], size[j], size[i], least[i], stale[i] = n + step, total, 0, np.inf, False
        square = squares(j, 0)
        search(j, square[j + 1 :])
        before, bound, live = square[:j], least[:j], size[:j] > 0
        gone = live & ((near[:j] == i) | (near[:j] == j))
        closer = live & ((before < bound) | (~stale[:j] & ~gone & (before == bound) & (near[:j] > j)))
        stale[:j] |= gone
        near[:j][closer], bound[closer], stale[:j][closer] = j, before[closer], False
        if len(size) > 64 and 2 * (keep := size > 0).sum() < len(size):
            place = np.cumsum(keep) - 1
            center, node, size, near, least, stale = (v[keep] for v in (center, node, size, near, least, stale))
            near = place[near]
    return np.array(out).reshape(-1, 4)


def _components(merges: np.ndarray, n: int, take: np.ndarray) -> np.ndarray:
    """Labels of the leaves after the merges that are taken, by first leaf."""
    root = list(range(n))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    leaf = list(range(n))
    for k, (a, b, _, _) in enumerate(merges):
        a, b = leaf[int(a)], leaf[int(b)]
        leaf.append(a)
        if take[k]:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return np.array([find(k) for k in range(n)])


def cut_by_height(merges: np.ndarray, n: int, threshold: float = THRESHOLD) -> np.ndarray:
    """Merges whose height, and that of all below, is within the threshold (heights may fall on the way up)."""
    top = np.zeros(len(merges))
    for k, (a, b, height, _) in enumerate(merges):
        top[k] = max([height, *(top[int(c) - n] for c in (a, b) if c >= n)])
    return _components(merges, n, top <= threshold)


def apart(x: np.ndarray, threshold: float, most: int = 64) -> list[np.ndarray]:
    """Rows in groups whose hulls are more than the threshold apart, so that no centroids of two groups ever come
    within it: groups have the merges up to the threshold that they would have together. First guesses are the rows
    nearest to each of at most ``most`` rows far from one another; those that can't be told apart along the line
    between their means become one."""
    square, at = _square_to(x, x[0]), np.zeros(len(x), int)
    for k in range(1, most):
        far = int(square.argmax())
        if square[far] <= threshold**2:
            break
        away = _square_to(x, x[far])
        nearer = away < square
        at[nearer], square[nearer] = k, away[nearer]
    groups = [np.flatnonzero(at == k) for k in range(at.max() + 1)]
    groups, a = [g for g in groups if len(g)], 0
    while a < len(groups):
        joined = []
        for b in range(len(groups)):
            if b == a:
                continue
            line = x[groups[b]].mean(0) - x[groups[a]].mean(0)
            length = np.sqrt(line @ line)
            if not length or (x[groups[b]] @ line).min() - (x[groups[a]] @ line).max() <= (threshold + 1e-6) * length:
                joined.append(b)
        if joined:  # the larger group may reach others, so all are looked at again
            one = np.sort(np.concatenate([groups[k] for k in [a, *joined]]))
            groups, a = [one, *(g for k, g in enumerate(groups) if k != a and k not in joined)], 0
        else:
            a += 1
    return groups


def labels_within(x: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """The labels of ``cut_by_height`` over all rows, each by its first row, found group by group."""
    labels = np.empty(len(x), int)
    for rows in apart(x, threshold):
        labels[rows] = rows[cut_by_height(centroid_linkage(x[rows], threshold), len(rows), threshold)]
    return labels


def large_labels(labels: np.ndarray, least: int) -> np.ndarray:
    names, counts = np.unique(labels, return_counts=True)
    return names[counts >= least]


def cut_to_count(merges: np.ndarray, n: int, target: int, least: int, threshold: float = THRESHOLD) -> np.ndarray:
    """After which merge to stop, for a number of large clusters nearest to the target; heights near the threshold first."""
    best, best_count = len(merges) - 1, 1
    for k in np.argsort(abs(merges[:, 2] - threshold), kind="stable"):
        if merges[k, 3] < least:
            continue
        labels = _components(merges, n, np.arange(len(merges)) <= k)
        count = len(large_labels(labels, least))
        if abs(count - target) < abs(best_count - target):
            best, best_count = k, count
        if count == target:
            return labels
    return _components(merges, n, np.arange(len(merges)) <= best)


def absorb_small(labels: np.ndarray, large: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Small clusters join, whole, the large one of the nearest centroid; with none large there is one cluster."""
    if not len(large):
        return np.zeros_like(labels)
    names, at = np.unique(labels, return_inverse=True)
    centers = np.stack([x[at == k].mean(0) for k in range(len(names))])
    is_large = np.isin(names, large)
    near = names[is_large][nearest_by_cosine(centers, centers[is_large])]
    return np.where(is_large, names, near)[at]


def dense(labels: np.ndarray) -> np.ndarray:
    """Numbers from 0 in order of appearance."""
    _, first, at = np.unique(labels, return_index=True, return_inverse=True)
    return np.argsort(np.argsort(first))[at]


def cluster(x: np.ndarray, num_speakers: int | None = None, threshold: float = THRESHOLD) -> np.ndarray:
    """Cluster numbers of embeddings: linkage, cut, small ones absorbed."""
    n = len(x)
    if n <= 1:
        return np.zeros(n, int)
    if num_speakers is not None and num_speakers < 2:
        return np.zeros(n, int)
    unit = normalized(x)
    least = min(MIN_MEMBERS, max(1, int(np.rint(0.1 * n))))
    labels = labels_within(unit, threshold)
    large = large_labels(labels, least)
    if num_speakers is not None and len(large) != (target := min(max(num_speakers, 1), n)):
        labels = cut_to_count(centroid_linkage(unit), n, target, least, threshold)
        large = large_labels(labels, least)
    return dense(absorb_small(labels, large, unit))


def assign(x: np.ndarray, train: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Nearest mean of the raw training vectors, by cosine; the lower number on ties."""
    centers = np.stack([train[labels == k].mean(0) for k in range(labels.max() + 1)])
    return nearest_by_cosine(x, centers)


def cluster_slots(slots: DataFrame, *, by: str = "file_id", num_speakers: int | None = None, threshold: float = THRESHOLD, max_slots: int | None = None) -> DataFrame:
    """``by, chunk_no, local_spk, cluster, error``: slots that are inactive or have no embedding get none."""
    kind = dict(slots.dtypes)

    def run(pdf):
        pdf = pdf.sort_values(["chunk_no", "local_spk"])
        use = (pdf["active"] & pdf["embedding"].notna()).to_numpy()
        out = pdf[[by, "chunk_no", "local_spk"]].assign(cluster=None, error=None)
        if max_slots is not None and use.sum() > max_slots:
            return out.assign(error=f"{int(use.sum())} slots to cluster; the most is {max_slots}")
        if use.any():
            x = np.stack(pdf.loc[use, "embedding"].to_numpy()).astype(np.float64)
            out.loc[use, "cluster"] = assign(x, x, cluster(x, num_speakers, threshold))
        return out

    shape = f"`{by}` {kind[by]}, chunk_no {kind['chunk_no']}, local_spk {kind['local_spk']}, cluster int, error string"
    return slots.select(by, "chunk_no", "local_spk", "active", "embedding").groupBy(by).applyInPandas(run, shape)


def centroids(vectors: DataFrame, *, by: str = "file_id", label: str = "cluster", vector: str = "embedding") -> DataFrame:
    """``by, label, centroid``: means of the raw vectors, component by component."""
    parts = vectors.select(by, label, F.posexplode(doubles(F.col(vector))).alias("at", "x")).groupBy(by, label, "at").agg(F.avg("x").alias("x"))
    rows = parts.groupBy(by, label).agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("all"))
    return rows.select(by, label, F.transform("all", lambda a: a["x"]).alias("centroid"))


def nearest_centroid(vectors: DataFrame, centers: DataFrame, *, by: str = "file_id", label: str = "cluster", vector: str = "embedding", name: str = "nearest") -> DataFrame:
    """``vectors`` with the label of the file's nearest centroid by cosine, the lower on ties. A file's centroids
    come as one array, so there is one row for a vector, not one for each pair."""
    lists = centers.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col(label).alias("k"), F.col("centroid").alias("c")))).alias("__centers"))
    rows = vectors.join(lists, by, "left").withColumn("__v", doubles(F.col(vector)))
    near = F.array_min(F.transform("__centers", lambda a: F.struct(cosine_distance(F.col("__v"), a["c"]).alias("d"), a["k"].alias("k"))))
    return rows.withColumn(name, near["k"]).drop("__centers", "__v")


def absorb_small_clusters(vectors: DataFrame, least: DataFrame, *, by: str = "file_id", label: str = "cluster", vector: str = "embedding") -> DataFrame:
    """``by, label, absorbed``: for each cluster itself if it has ``least`` (by file) members, else the large one
    whose centroid of unit vectors is nearest; 0 where none is large."""
    unit = vectors.select(by, label, l2_normalized(doubles(F.col(vector))).alias("u"))
    sizes = unit.groupBy(by, label).agg(F.count("*").alias("n")).join(least, by)
    centers = centroids(unit, by=by, label=label, vector="u").join(sizes, [by, label])
    large = centers.filter("n >= least").select(by, label, "centroid")
    near = nearest_centroid(centers, large, by=by, label=label, vector="centroid", name="near")
    return near.select(by, label, F.when(F.col("n") >= F.col("least"), F.col(label)).otherwise(F.coalesce("near", F.lit(0))).alias("absorbed"))
