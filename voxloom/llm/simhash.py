"""SimHash near-dedup with bit-sliced comparison.

A fingerprint has a bit set where over half the XXH64 (seed 42) of the text's word shingles have it. Equal
fingerprints are one node. Two that differ in ``radius`` bits or fewer agree in all but ``radius`` of eight
bytes, so each goes, once for every choice of the bytes that agree, to a bucket of those: every link is found
in some bucket, and a bucket holds at most 2^16 distinct fingerprints (radius 2), however the documents are
spread. Within a bucket only the free bits
are compared, stored as vertical bit planes: a plane's word holds that bit of 64 fingerprints, differences are
summed by carry-save counters for 64 at once, and words are given up once all of them exceed the radius. Rows
of many buckets are compared together, each row with those after it in its bucket, by shifting the planes of the
whole batch; where large groups are close, these are found first, from link to link. Each linked group of a bucket
becomes a star about its least row, not its pairs. Stars of all buckets are joined to components by alternating large-star and small-star steps.

``wide_links`` does the same for fingerprints of 128 bits and large radii, as sets of shingles of a Jaccard index of
0.8 need them: there no choice of bytes has to agree, so buckets are tables of sampled bits.

Defined results: null and blank texts have fingerprint zero and link like any other; a null id counts as one
document below all others and is reported as null; rows of one id each get their own fingerprint and one
component of that id's smallest reachable document; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import accumulate, combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import NULL_ID, Workspace, doc_id, names_of, null_id, worker

SEED, RADIUS, WORDS = 42, 2, 3


def fingerprint(text: str | None, size: int = WORDS) -> int:
    import numpy as np
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined, width = b" ".join(words), min(size, len(words))
    starts = list(accumulate((len(w) + 1 for w in words), initial=0))
    digest = xxhash.xxh64_intdigest
    count, n = np.zeros(64, np.int64), len(words) - width + 1
    for at in range(0, n, 1 << 14):
        to = min(n, at + (1 << 14))
        h = np.array([digest(joined[a : b - 1], SEED) for a, b in zip(starts[at:to], starts[at + width : to + width], strict=True)], "<u8")
        count += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * count > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = WORDS) -> DataFrame:
    """``id, fp``, the fingerprint as a signed long."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            fps = np.array([fingerprint(t, size) for t in b["text"].to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b["id"], pa.array(fps)], ["id", "fp"])

    return docs.select(doc_id().alias("id"), "text").mapInArrow(worker(run), "id long, fp long")


def planes_of(fps):
    """Bit planes of fingerprints, one row of bytes for each of them: a plane's word holds that bit of 64 rows."""
    import numpy as np

    n, width = len(fps), -(-len(fps) // 64)
    planes = np.zeros((8 * fps.shape[1], 8 * width), np.uint8)
    for at in range(0, n, 1 << 14):
        bits = np.unpackbits(fps[at : at + (1 << 14)], axis=1, bitorder="little")
        packed = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")
        planes[:, at // 8 : at // 8 + packed.shape[1]] = packed
    return planes.view(np.uint64)


def _flags(some, width: int):
    """A word with a bit for each of 64 booleans."""
    import numpy as np

    out = np.zeros(8 * width, np.uint8)
    packed = np.packbits(some, bitorder="little")
    out[: len(packed)] = packed
    return out.view(np.uint64)


def _numbers(words, n: int):
    import numpy as np

    return np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little")[:n])


def _within(planes, radius: int, wanted):
    """Where ``planes`` (of differing bits; a function of plane and words gives them) count ``radius`` or fewer, among
    ``wanted``. Carry-save counters sum 64 places at once; words are given up once all of them exceed the radius."""
    import numpy as np

    get, n_planes = planes
    live = np.flatnonzero(wanted.any(0) if wanted.ndim > 1 else wanted)
    shape = (*wanted.shape[:-1], len(live))
    sums, over = [np.zeros(shape, np.uint64) for _ in range(radius.bit_length())], np.zeros(shape, np.uint64)
    for k in range(n_planes):
        if not len(live):
            break
        carry = get(k, live)
        for c in sums:
            both = c & carry
            c ^= carry
            carry = both
        over |= carry
        if k % 8 == 7 or k == n_planes - 1:
            stay = ~_above(sums, over, radius) & wanted[..., live]
            stay = stay.any(0) if stay.ndim > 1 else stay != 0
            if not stay.all():
                live, over, sums = live[stay], over[..., stay], [c[..., stay] for c in sums]
    out = np.zeros(wanted.shape, np.uint64)
    out[..., live] = ~_above(sums, over, radius) & wanted[..., live]
    return out


def _above(sums, over, radius: int):
    """Where the bit-sliced count exceeds the radius."""
    above, equal = over.copy(), ~over
    for k in range(len(sums) - 1, -1, -1):
        if radius >> k & 1:
            equal = equal & sums[k]
        else:
            above |= equal & sums[k]
            equal = equal & ~sums[k]
    return above


def _along(fps, bucket, radius: int, most: int):
    """As ``neighbours_linked``, a piece for each distance."""
    import numpy as np

    step = 1 << 16
    size = np.bincount(bucket, minlength=1)[bucket] if len(bucket) else np.zeros(0, np.int64)
    for at in range(0, len(fps), step):
        own, sizes = bucket[at : at + step + most], size[at : at + step + most]
        planes = planes_of(fps[at : at + step + most])
        width = planes.shape[1]
        for o in range(1, min(most, len(own))):
            same = (own[o:] == own[:-o]) & (sizes[:-o] <= most)
            same[step:] = False
            if not same.any():
                break
            words, r = divmod(o, 64)

            def differ(k, live, words=words, r=r, planes=planes, width=width):
                plane = planes[k]
                there = plane[np.minimum(live + words, width - 1)] >> np.uint64(r)
                if r:
                    there |= plane[np.minimum(live + words + 1, width - 1)] << np.uint64(64 - r)
                return plane[live] ^ there

            i = _numbers(_within((differ, len(planes)), radius, _flags(same, width)), len(own))
            yield at + i, at + i + o


def neighbours_linked(fps, bucket, radius: int, most: int):
    """Places ``i, j`` of all links within buckets of at most ``most`` rows; ``bucket`` numbers them in ascending order.

    Rows at a distance of 1, 2, ... are compared all along the planes, shifted by that distance."""
    import numpy as np

    found = list(_along(fps, bucket, radius, most))
    return tuple(np.concatenate([np.zeros(0, np.int64), *(x[k] for x in found)]) for k in (0, 1))


def stars(fps, radius: int):
    """Places ``root, member`` of the groups that links join among the rows of one bucket."""
    return _collapsed(fps, radius, len(fps))[:2]


def _collapsed(fps, radius: int, patience: int):
    """``stars``, and the places that are left when ``patience`` groups in a row have each joined under a sixteenth of
    the rows; whole groups are found, so no link runs from those left to others."""
    import numpy as np

    bits = np.unpackbits(fps, axis=1, bitorder="little").T
    every, n = np.uint64(2**64 - 1), len(fps)
    rest, roots, members = np.arange(n), [], []
    packed, waiting, planes = rest, None, None
    small = 0
    while len(rest) and small < patience:
        if waiting is None or 2 * len(rest) < len(packed):  # those that still wait, close together
            packed, planes = rest, planes_of(fps[rest])
            waiting = _flags(np.ones(len(rest), bool), planes.shape[1])
        k = int(np.searchsorted(packed, rest[0]))
        waiting[k // 64] &= ~(np.uint64(1) << np.uint64(k % 64))
        root, front = rest[0], rest[:1]
        while len(front) and waiting.any():
            reached, step = [], max(1, 200_000 // len(waiting))
            for a in range(0, len(front), step):
                own = bits[:, front[a : a + step]].astype(bool)

                def differ(k, live, own=own, planes=planes):
                    return planes[k][live] ^ np.where(own[k], every, np.uint64(0))[:, None]

                hit = np.bitwise_or.reduce(_within((differ, len(planes)), radius, np.broadcast_to(waiting, (own.shape[1], len(waiting)))), axis=0)
                waiting &= ~hit
                reached.append(packed[_numbers(hit, len(packed))])
            front = np.concatenate(reached)
            roots.append(np.full(len(front), root))
            members.append(front)
        before, rest = len(rest), packed[_numbers(waiting, len(packed))]
        small = small + 1 if 16 * (before - len(rest)) < before else 0
    return (*(np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64) for x in (roots, members)), rest)


def linked(fps, radius: int, planes: list[int]):
    """Stars ``(from, to)`` of the groups that links join among distinct 64-bit fingerprints that agree but for ``planes``."""
    import numpy as np

    u, v = stars(_bytes_of(fps, planes), radius)
    return fps[u], fps[v]


def _bytes_of(fps, planes: list[int]):
    """The bytes of 64-bit fingerprints that hold these planes."""
    import numpy as np

    return np.ascontiguousarray(fps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, sorted({p // 8 for p in planes})])


#: Buckets of more rows than that, of which a quarter are close to one of them, are searched from link to link until
#: their large groups are found; what is left, and all others, by shifted planes. Both find every link.
ALONG, PATIENCE = 48, 8
#: Rows that are compared at once, as a plane's operations cost the same for a few words as for hundreds; links that
#: are held before they are put together, as they are as many as the square of a group.
TOGETHER, LINKS = 1 << 17, 1 << 21


def _whole_groups(batches, names, keys: int):
    """Arrays of the columns ``names``, of some ``TOGETHER`` rows, that never end within a group, rows that agree in the
    first ``keys`` of them."""
    import numpy as np

    held, n, enough = [], 0, TOGETHER
    for b in batches:
        if not b.num_rows:
            continue
        held.append([b[c].to_numpy(zero_copy_only=False) if c != "fp" or b[c].type != "binary" else _matrix(b[c]) for c in names])
        n += b.num_rows
        if n < enough:
            continue
        now = [np.concatenate(x) for x in zip(*held, strict=True)]
        cut = int(np.flatnonzero(np.logical_and.reduce([x == x[-1] for x in now[:keys]]))[0])
        if cut:
            yield [x[:cut] for x in now]
        held, n = [[x[cut:] for x in now]], n - cut
        enough = max(TOGETHER, 2 * n)  # a group larger than that is not put together anew for every batch
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _matrix(column):
    """Rows of bytes of a binary column whose values are equally long."""
    import numpy as np

    if not len(column):
        return np.zeros((0, 0), np.uint8)
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]].reshape(len(column), -1)


def _least_linked(n: int, i, j):
    """For each of ``n`` places the least that the links ``i, j`` reach."""
    import numpy as np

    root = np.arange(n)
    while True:
        before = root.copy()
        np.minimum.at(root, j, before[i])
        np.minimum.at(root, i, before[j])
        root = root[root]
        if (root == before).all():
            return root


def _dense(fps, starts, sizes, radius: int):
    """Buckets of over ``ALONG`` rows in which a quarter are within the radius of one of four rows."""
    import numpy as np

    large = np.flatnonzero(sizes > ALONG)
    if not len(large):
        return large
    size = sizes[large]
    first = np.cumsum(size) - size
    rows = np.arange(size.sum()) + np.repeat(starts[large] - first, size)
    own, most = fps[rows], np.zeros(len(large), np.int64)
    for k in range(4):
        far = np.bitwise_count(own ^ np.repeat(fps[starts[large] + k * size // 4], size, axis=0)).sum(1, dtype=np.int64)
        most = np.maximum(most, np.add.reduceat((far <= radius).astype(np.int64), first))
    return large[4 * most >= size]


def _edges(fps, starts, sizes, radius: int):
    """Places ``root, member`` of the groups that links join within groups of rows; ``fps`` are rows of bytes."""
    import numpy as np

    u, v, left = [], [], np.ones(len(fps), bool)
    for g in _dense(fps, starts, sizes, radius):
        x, y, rest = _collapsed(fps[starts[g] : starts[g] + sizes[g]], radius, PATIENCE)
        u.append(x + starts[g])
        v.append(y + starts[g])
        left[starts[g] : starts[g] + sizes[g]] = False
        left[starts[g] + rest] = True
    rows = np.flatnonzero(left)
    bucket = np.repeat(np.arange(len(starts)), sizes)[rows]
    most, held, n = int(np.bincount(bucket, minlength=1).max()), [(np.zeros(0, np.int64),) * 2], 0

    def joined():
        root = _least_linked(len(rows), *(np.concatenate(x) for x in zip(*held, strict=True)))
        more = np.flatnonzero(root != np.arange(len(rows)))
        return root[more], more

    for i, j in _along(fps[rows], bucket, radius, most):
        held.append((i, j))
        n += len(i)
        if n > LINKS:
            held, n = [joined()], 0
    i, j = joined()
    return np.concatenate([*u, rows[i]]), np.concatenate([*v, rows[j]])


def bucket_links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``u, v``: stars that join the same fingerprints as all links of at most ``radius`` bits do."""
    choices = list(combinations(range(8), 8 - radius))
    masks = [sum(0xFF << 8 * b for b in c) for c in choices]
    free = [[b for b in range(8) if b not in c] for c in choices]
    signed = lambda m: m - 2**64 if m >= 2**63 else m
    keys = F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(signed(m)).cast("long")).alias("key")) for k, m in enumerate(masks)])
    rows = fps.select("fp", F.explode(keys).alias("b")).select("b.k", "b.key", "fp")
    rows = rows.repartition("k", "key").sortWithinPartitions("k", "key", "fp")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        of_choice = np.array(free)
        for k, key, fp in _whole_groups(batches, ("k", "key", "fp"), 2):
            first = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (key[1:] != key[:-1])])
            sizes = np.diff(np.r_[first, len(k)])
            raw = np.take_along_axis(fp.astype("<i8").view(np.uint8).reshape(-1, 8), of_choice[k], 1)  # the rest is equal
            i, j = _edges(raw, first, sizes, radius)
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(fp[i]), pa.array(fp[j])], ["u", "v"])

    return rows.mapInArrow(worker(run), "u long, v long")


#: Wide fingerprints: bits, tables of sampled bits, bits in a table's key; rows of a bucket that meet in one task.
WIDE, TABLES, KEY_BITS, BLOCK = 128, 64, 16, 1 << 16


def wide_radius(similarity: float, bits: int = WIDE) -> int:
    """Bits by which the fingerprints of two sets of that Jaccard index differ at most, but for one in 700 pairs."""
    from math import acos, pi, sqrt

    p = acos(2 * similarity / (1 + similarity)) / pi
    return int(bits * p + 3 * sqrt(bits * p * (1 - p)))


def wide_fingerprint(hashes, bits: int = WIDE):
    """Bytes of the fingerprint of a set of 64-bit hashes: a bit is 1 if set in over half of them."""
    import numpy as np

    words, count = bits // 64, np.zeros(bits, np.int64)
    for at in range(0, len(hashes), 1 << 13):
        h = hashes[at : at + (1 << 13), None] + np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ h >> np.uint64(shift)) * np.uint64(factor)
        h ^= h >> np.uint64(31)
        count += np.unpackbits(h.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * count > len(hashes), bitorder="little").tobytes()


def wide_links(nodes: DataFrame, radius: int, work: Workspace, *, tables: int = TABLES, key_bits: int = KEY_BITS, block: int = BLOCK) -> DataFrame:
    """``u, v``: stars of ``nodes`` (``node``, ``fp`` of ``WIDE`` bits) that join all that differ in at most
    ``radius`` bits and agree in the key of some table; a table's key is a sample of the bits.

    A bucket of more than ``block`` rows is dealt into parts every two of which meet in one task."""

    def keyed(batches):
        import numpy as np
        import pyarrow as pa

        rng, picks = np.random.default_rng(SEED), []
        while len(picks) < tables:  # permutations, cut into keys
            order = rng.permutation(WIDE)
            picks += [order[a : a + key_bits] for a in range(0, WIDE - key_bits + 1, key_bits)]
        picks, scale = np.array(picks[:tables]), 1 << np.arange(key_bits)
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                bits = np.unpackbits(_matrix(part["fp"]), axis=1, bitorder="little")
                keys = (bits[:, picks] * scale).sum(2) + (np.arange(tables) << key_bits)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, tables * (part.num_rows + 1), tables, dtype=np.int32)), pa.array(keys.ravel().astype(np.int64)))
                yield pa.RecordBatch.from_arrays([part["node"], part["fp"], lists], ["node", "fp", "keys"])

    rows = nodes.select("node", "fp").mapInArrow(worker(keyed), "node long, fp binary, keys array<long>")
    rows = rows.select("node", "fp", F.explode("keys").alias("key"))
    # keys are counted by 64 at once, which few rows are shuffled for; one by one only where those 64 are too many
    crowd = F.shiftright("key", 6).alias("crowd")
    crowds = work.keep(rows.groupBy(crowd).count().filter(F.col("count") > block).select("crowd"), "crowds")
    large = None
    if crowds.limit(1).count():
        counts = rows.select(crowd, "key").join(F.broadcast(crowds), "crowd").groupBy("key").count().filter(F.col("count") > block)
        large = work.keep(counts.select("key", F.ceil(F.col("count") / (block // 2)).cast("int").alias("parts")), "large")
    if large is not None and large.limit(1).count():
        rows = rows.join(F.broadcast(large), "key", "left")
        own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
        meet = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.least(o, own) * F.col("parts") + F.greatest(o, own))
        part = F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(meet))
        rows = rows.select("node", "fp", "key", part.alias("part")).withColumn("key", F.col("key") + F.shiftleft(F.col("part").cast("long"), 32))
    n_tasks = max(tables, int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.select("key", "node", "fp").repartition(n_tasks, "key").sortWithinPartitions("key", "node")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for key, node, fp in _whole_groups(batches, ("key", "node", "fp"), 1):
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            i, j = _edges(fp, first, np.diff(np.r_[first, len(key)]), radius)
            pairs = np.unique(np.stack([node[i], node[j]], 1), axis=0)
            if len(pairs):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["u", "v"])

    return rows.mapInArrow(worker(run), "u long, v long")


def components(edges: DataFrame, work: Workspace) -> DataFrame:
    """``node, root`` for every node of ``edges (u, v)`` but the roots: the least node that can be reached.

    ``edges`` are stars, some for each node, however large they are."""
    edges = edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).filter("u <> v").distinct()
    # a node is in a star of each of its buckets; their roots meet at the least of them, for all nodes alike
    ties = edges.withColumn("a", F.min("u").over(Window.partitionBy("v")))
    ties = ties.select(F.explode(F.array(F.struct("a", F.col("v").alias("b")), F.struct("a", F.col("u").alias("b")))).alias("e"))
    edges = work.keep(ties.select(F.col("e.a").alias("u"), F.col("e.b").alias("v")).filter("u <> v").distinct(), "edges")
    files = max(1, -(-edges.count() // 200_000))  # a step has no more edges than that, so tables don't become scraps
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("m").alias("u"), "v").filter("u <> v").distinct()
        large = work.keep(large.coalesce(files), "large")
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v")
        small = small.select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("v").alias("b")), F.struct(F.col("m").alias("a"), F.col("u").alias("b")))).alias("e"))
        edges = work.keep(small.select(F.col("e.a").alias("u"), F.col("e.b").alias("v")).filter("u <> v").distinct().coalesce(files), "small")
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            return edges.select(F.col("v").alias("node"), F.col("u").alias("root"))
        state = now


def simhash_groups(docs: DataFrame, *, radius: int = RADIUS, size: int = WORDS) -> DataFrame:
    """Per document: ``doc_id, fingerprint`` (16 hex digits), ``component_id``, the least id that links reach."""
    work = Workspace(docs.sparkSession, "simhash")
    fps = work.keep(fingerprints(docs.select("doc_id", "text"), size), "fingerprints")
    nodes = work.keep(fps.groupBy("fp").agg(F.min("id").alias("least")), "nodes")
    roots = components(bucket_links(nodes.select("fp"), radius), work)
    nodes = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    groups = nodes.groupBy("root").agg(F.min("least").alias("component"))
    nodes = work.keep(nodes.join(groups, "root").select("fp", "component"), "components")
    return fps.join(nodes, "fp").select(
        null_id(F.col("id")).alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), null_id(F.col("component")).alias("component_id")
    )


def one_of_each_group(docs: DataFrame, *, radius: int = RADIUS, size: int = WORDS) -> DataFrame:
    """``docs`` with one row of each group, that of the least id; rows of one id (or of none) count as one document."""
    groups = simhash_groups(docs, radius=radius, size=size)
    keep = groups.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("id")).distinct()
    every = docs.select(F.struct(*names_of(docs)).alias("row"), doc_id().alias("id"), F.xxhash64("text").alias("th"))
    return every.join(keep, "id", "left_semi").groupBy("id").agg(F.min_by("row", "th").alias("row")).select("row.*")
