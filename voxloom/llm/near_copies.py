"""Near copies by SimHash of word shingles, with an exact check: the near-dedup of pipeline stages.

A text is a node, told by the hash of its lower-cased words; a text's set is its distinct runs of ``size`` words
(a shorter text is one run). The set's wide fingerprint proposes (``simhash.wide_links``: bit planes in buckets of
sampled bits): fingerprints of sets with a Jaccard index of 0.8 differ in 19 of 128 bits, give or take 4, those of
unrelated sets in 64, give or take 6. Proposed are differences of up to 31 bits; pairs of index 0.8 are missed 1 in 100
times (no table of bits agrees), of 0.85 1 in 2,000, of 0.9 less than 1 in 100,000, unless a third text links them.
Proposals are joined to families, and a family's texts are compared by their exact sets through an inverted index:
``100 * common >= percent * united``, in integers. A family of more than ``block`` texts is dealt into parts every two
of which meet in one task, so a task holds at most that many, eight bytes for each of their words.

Defined results: null and blank texts are copies of each other; of each linked group the row of the least id
stays, rows without id last; rows are told apart by id, text and their other columns, so rows that share an id or
have none are one document only if their texts are linked; of rows that are equal all through one stays.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Workspace, doc_id, names_of, worker
from .simhash import SEED, WIDE, components, wide_fingerprint, wide_links, wide_radius

WORDS, PERCENT, BLOCK = 5, 80, 4096


def shingles(text: str | None, size: int = WORDS):
    """Hash of the text's words, and the sorted distinct hashes of its shingles."""
    import numpy as np
    import xxhash

    words = (text or "").encode().lower().split()
    joined, width = b" ".join(words), min(size, len(words))
    starts = list(accumulate((len(w) + 1 for w in words), initial=0))
    digest = xxhash.xxh64_intdigest
    found = np.fromiter((digest(joined[a : b - 1], SEED) for a, b in zip(starts, starts[width:], strict=False)) if words else (), np.uint64)
    return digest(joined, SEED), np.unique(found)


def sketches(rows: DataFrame, size: int = WORDS) -> DataFrame:
    """``none, id, r, node, fp`` from ``none, id, r, text``: hash of the text's words, and its set's fingerprint."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part, nodes, fps = b.slice(at, 1024), [], []
                for t in part["text"]:
                    node, found = shingles(t.as_py(), size)
                    nodes.append(node)
                    fps.append(wide_fingerprint(found, WIDE))
                yield pa.RecordBatch.from_arrays([part["none"], part["id"], part["r"], pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(fps, pa.binary())], ["none", "id", "r", "node", "fp"])

    return rows.mapInArrow(worker(run), "none boolean, id long, r long, node long, fp binary")


def linked_sets(sets: list, percent: int = PERCENT):
    """For each set the first that links reach."""
    import numpy as np

    n, sizes = len(sets), np.array([len(s) for s in sets], np.int64)
    values, columns = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(n, dtype=np.int32), sizes)[np.argsort(columns, kind="stable")]
    ends = np.r_[0, np.bincount(columns, minlength=len(values)).cumsum()]
    begins = np.r_[0, sizes.cumsum()]
    root, left = np.full(n, -1), n

    def linked_to(i):
        own = columns[begins[i] : begins[i + 1]]
        lengths = ends[own + 1] - ends[own]
        common = np.zeros(n, np.int64)
        cuts = np.flatnonzero(np.diff(lengths.cumsum() // 4_000_000)) + 1
        for c, m in zip(np.split(own, cuts), np.split(lengths, cuts), strict=True):
            at = np.arange(m.sum()) + np.repeat(ends[c] - np.r_[0, m.cumsum()[:-1]], m)
            common += np.bincount(owner[at], minlength=n)
        return 100 * common >= percent * (sizes + sizes[i] - common)

    for first in range(n):
        if root[first] >= 0:
            continue
        root[first], left, front = first, left - 1, [first]
        while front and left:
            if left < len(front):  # the links between the two sides are found from either; those to groups before are known
                for j in np.flatnonzero(root < 0):
                    root[j] = j
                    meet = np.unique(root[linked_to(j) & (root >= 0)])
                    root[np.isin(root, meet)] = meet[0]
                return root
            hit = np.flatnonzero((root < 0) & linked_to(front.pop()))
            root[hit] = first
            left -= len(hit)
            front += hit.tolist()
    return root


def verified(family_texts: DataFrame, *, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``u, v`` from ``family, part, node, text``, sorted by the first two: stars of the groups that exact links join."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        family, nodes, sets = None, [], []

        def done():
            to = linked_sets(sets, percent)
            own = np.array(nodes, np.int64)
            more = to != np.arange(len(to))
            return pa.RecordBatch.from_arrays([pa.array(own[to[more]]), pa.array(own[more])], ["u", "v"])

        for b in batches:
            for f, p, node, text in zip(b["family"].to_pylist(), b["part"].to_pylist(), b["node"].to_pylist(), b["text"], strict=True):
                if (f, p) != family and nodes:
                    yield done()
                    nodes, sets = [], []
                family = f, p
                nodes.append(node)
                sets.append(shingles(text.as_py(), size)[1])
        if nodes:
            yield done()

    return family_texts.select("family", "part", "node", "text").mapInArrow(worker(run), "u long, v long")


def _row_hash(docs: DataFrame) -> Column:
    """Tells rows apart by all columns that can be hashed."""
    fits = [F.col(n) for n, kind in zip(names_of(docs), (t for _, t in docs.dtypes), strict=True) if "map<" not in kind and "variant" not in kind]
    return F.xxhash64(*fits)


def one_of_each_text(docs: DataFrame, *, size: int = WORDS, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """``docs`` with one row of each group of near copies."""
    work = Workspace(docs.sparkSession, "near_copies")
    every = docs.select(F.struct(*names_of(docs)).alias("row"), doc_id().alias("id"), F.col("doc_id").isNull().alias("none"), _row_hash(docs).alias("r"), "text")
    rows = work.keep(sketches(every.select("none", "id", "r", "text"), size), "sketches")
    order = F.struct("none", "id", "r")
    nodes = work.keep(rows.groupBy("node").agg(F.first("fp").alias("fp"), F.min(order).alias("o")), "nodes")
    joined = components(wide_links(nodes, wide_radius(percent / 100), work), work)
    families = joined.select("node", F.col("root").alias("family")).unionByName(joined.select(F.col("root").alias("node"), F.col("root").alias("family")).distinct())
    sizes = families.groupBy("family").agg(F.count("*").alias("n"))
    parts = F.when(F.col("n") > block, F.ceil(2 * F.col("n") / block)).otherwise(1).cast("int")
    wanted = work.keep(nodes.join(families, "node").join(sizes, "family").select("node", "family", parts.alias("parts"), "o.id", "o.r"), "families")
    texts = every.select("id", "r", "text").join(wanted, ["id", "r"]).select("family", "parts", "node", "text").dropDuplicates(["node"])
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    meet = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.least(k, own) * F.col("parts") + F.greatest(k, own))
    texts = texts.select("family", F.explode(meet).alias("part"), "node", "text").repartition("family", "part").sortWithinPartitions("family", "part", "node")
    groups = components(verified(texts, size=size, percent=percent), work)
    firsts = nodes.join(groups, "node", "left").groupBy(F.coalesce("root", "node").alias("group")).agg(F.min("o").alias("o"))
    keep = work.keep(firsts.select("o.id", "o.r").distinct(), "keep")
    return every.select("row", "id", "r").join(keep, ["id", "r"], "left_semi").dropDuplicates(["id", "r"]).select("row.*")
