"""Suffix-array dedup: bytes covered by a string of ``size`` bytes that also starts elsewhere are removed.

1. Anchors. Each window of ``size`` bytes has one anchor, the ``gram`` bytes in it with the least hash (the
   first of them). Equal windows have equal anchors at equal places, so windows whose anchor occurs once cannot
   repeat. The windows that share an occurrence of an anchor are one stretch of text, its context.
2. Equal contexts (by a 128-bit hash of their bytes; counts are combined before the shuffle) repeat as a whole and
   become one, which goes on for all of them.
3. Anchors with several different contexts go, with one copy of each of these, through column-wise
   construction of their collection's Burrows-Wheeler transform and common prefixes (``column_bwt``). Symbols
   are words of eight bytes, in step with the anchor: equal windows have ``size / 8 - 1`` whole words in common
   from their first whole word on, so they stand in one stretch of the suffix order in which common prefixes
   are that long; the up to eight bytes left before and after are then compared exactly.
4. Spans are gathered by document and cut out of its bytes.

A task holds the contexts of whole anchors, some ``batch`` strings at a time. An anchor with more than
``max_group`` different contexts is not gathered in one task. Its windows are parted by the place of the anchor in
them, first half and second half: all windows of a half have some bytes around the anchor in common to look at,
and only those that agree in these bytes can be equal, so each half's contexts are dealt by them. Halves of halves
follow where a group is still too large; in the end a half is one window, and groups of equal windows are one
context. All groups go through the same construction, in files in the shared folder where that is a path.
One symbol per string and round is what keeps the files sequential; single bytes as symbols would need eight
times the rounds over eight times the entries, without another result.

Defined results: null text is empty; repeated rows (of one id, or null ids) are documents of their own that
repeat each other; texts shorter than ``size`` stay whole; an empty table gives no rows; other columns are
ignored. Spans can cut characters, so results are bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Workspace, doc_id, null_id, worker

SIZE, GRAM, WORD = 400, 32, 8
#: Bytes of text that are looked at together; anchors' places in them take 24 bits.
BUFFER = 1 << 20


def _gram_hashes(buf, gram: int):
    """64-bit hashes of all runs of ``gram`` (a power of two) bytes."""
    import numpy as np

    h = np.random.default_rng(17).integers(0, 2**64, 256, np.uint64)[buf]
    width, factor = 1, 0x9E3779B97F4A7C15
    while width < gram:
        h = h[:-width] * np.uint64(factor) + h[width:]
        width, factor = 2 * width, factor * factor % 2**64
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def anchors(buf, starts, ends, size: int, gram: int) -> dict:
    """Arrays ``doc, lo, size, rel, a``: contexts in the buffer of documents ``starts`` to ``ends``, less than 2^24 bytes."""
    import numpy as np

    none = np.zeros(0, np.int64)
    if len(buf) < size:
        return {"doc": none, "lo": none, "size": none, "rel": none, "a": none}
    h = _gram_hashes(buf, gram)
    low = np.uint64((1 << 24) - 1)
    key = h & ~low | np.arange(len(h), dtype=np.uint64)
    w = size - gram + 1
    padded = np.full(-(-len(key) // w) * w, 2**64 - 1, np.uint64)
    padded[: len(key)] = key
    rows = padded.reshape(-1, w)
    front = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(key) - w + 1
    least = np.minimum(back[:n], front[w - 1 : w - 1 + n])
    valid = np.zeros(n + 1, np.int8)
    fits = ends - starts >= size
    np.add.at(valid, starts[fits], 1)
    np.add.at(valid, ends[fits] - size + 1, -1)
    at = np.flatnonzero(np.cumsum(valid[:n]))
    if not len(at):
        return {"doc": none, "lo": none, "size": none, "rel": none, "a": none}
    own = least[at]
    first = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1)])
    lo, hi = at[first], at[np.r_[first[1:], len(at)] - 1]
    anchor = (own[first] & low).astype(np.int64)
    return {"doc": np.searchsorted(starts, lo, "right") - 1, "lo": lo, "size": hi - lo + size, "rel": anchor - lo, "a": h[anchor].view(np.int64)}


def _pieces(column, size: int):
    """Buffers of an Arrow array of texts, ``buf, row, starts, ends, base``: a piece of text that is cut
    overlaps the next by ``size - 1`` bytes, so each window is in one."""
    import numpy as np

    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64 if str(column.type).startswith("large") else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    rows, a, z, base = [], [], [], []
    total = 0
    for row, (s, e) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        for at in range(s, max(s + 1, e), BUFFER):
            stop = min(e, at + BUFFER + size - 1)
            if total and total + stop - at > BUFFER:
                yield data[a[0] : z[-1]], np.array(rows), np.array(a) - a[0], np.array(z) - a[0], np.array(base)
                rows, a, z, base, total = [], [], [], [], 0
            rows.append(row)
            a.append(at)
            z.append(stop)
            base.append(at - s)
            total += stop - at
            if stop == e:
                break
            # the next piece of the same text starts inside this one, so this one goes out by itself
            yield data[a[0] : z[-1]], np.array(rows), np.array(a) - a[0], np.array(z) - a[0], np.array(base)
            rows, a, z, base, total = [], [], [], [], 0
    if rows:
        yield data[a[0] : z[-1]], np.array(rows), np.array(a) - a[0], np.array(z) - a[0], np.array(base)


def _merged(doc, lo, hi):
    """Unions of the intervals of each document."""
    import numpy as np

    order = np.lexsort((lo, doc))
    doc, lo, hi = doc[order], lo[order], hi[order]
    if not len(doc):
        return doc, lo, hi
    reach = hi + doc * (1 << 40)  # documents don't reach into each other
    top = np.maximum.accumulate(reach)
    first = np.flatnonzero(np.r_[True, lo[1:] + doc[1:] * (1 << 40) > top[:-1]])
    return doc[first], lo[first], top[np.r_[first[1:], len(doc)] - 1] - doc[first] * (1 << 40)


def _digests(strings):
    """Two arrays with the halves of the strings' 128-bit hashes."""
    import numpy as np
    import xxhash

    both = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s) for s in strings), ">i8").astype(np.int64).reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def find_anchors(rows: DataFrame, size: int, gram: int) -> DataFrame:
    """``a, c1, c2, id, lo, size, rel, n``: contexts by document; with null ``a``, spans that repeat in their own document."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        kinds = pa.schema([("a", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("id", pa.int64()), ("lo", pa.int64()), ("size", pa.int32()), ("rel", pa.int32()), ("n", pa.int32())])
        for b in batches:
            ids = b["id"].to_numpy()
            for buf, row, starts, ends, base in _pieces(b["text"], size):
                x = anchors(buf, starts, ends, size, gram)
                if not len(x["a"]):
                    continue
                raw = buf.tobytes()
                c1, c2 = _digests(raw[s : s + n] for s, n in zip(x["lo"].tolist(), x["size"].tolist(), strict=True))
                lo = x["lo"] - starts[x["doc"]] + base[x["doc"]]
                order = np.lexsort((lo, c1, c2, x["a"], x["doc"]))
                doc, a, c1, c2, lo, n, rel = x["doc"][order], x["a"][order], c1[order], c2[order], lo[order], x["size"][order], x["rel"][order]
                first = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (a[1:] != a[:-1]) | (c1[1:] != c1[:-1]) | (c2[1:] != c2[:-1])])
                count = np.diff(np.r_[first, len(doc)])
                own = np.repeat(count > 1, count)
                d, s, e = _merged(doc[own], lo[own], lo[own] + n[own])
                none = [None] * len(d)
                parts = [(pa.array(a[first]), pa.array(c1[first]), pa.array(c2[first]), ids[row[doc[first]]], lo[first], n[first], rel[first], count)]
                if len(d):
                    parts.append((*[pa.array(none, pa.int64())] * 3, ids[row[d]], s, e - s, np.zeros(len(d), int), np.zeros(len(d), int)))
                for p in parts:
                    yield pa.RecordBatch.from_arrays([pa.array(v).cast(k.type) for v, k in zip(p, kinds, strict=True)], schema=kinds)

    return rows.mapInArrow(worker(run), "a long, c1 long, c2 long, id long, lo long, size int, rel int, n int")


def _contexts(rows: DataFrame, need: DataFrame) -> DataFrame:
    """``a, id, lo, rel, judge, s``: the bytes of the contexts that ``need`` lists by document."""

    def run(batches):
        import pyarrow as pa

        kinds = pa.schema([("a", pa.int64()), ("id", pa.int64()), ("lo", pa.int64()), ("rel", pa.int32()), ("judge", pa.bool_()), ("s", pa.binary())])
        for b in batches:
            out, held = [], 0
            for i, text, need in zip(b["id"].to_pylist(), b["text"].to_pylist(), b["need"].to_pylist(), strict=True):
                raw = text.encode()
                for x in need:
                    out.append((x["a"], i, x["lo"], x["rel"], x["judge"], raw[x["lo"] : x["lo"] + x["size"]]))
                    held += x["size"]
                    if held > 1 << 23:
                        yield pa.RecordBatch.from_arrays([pa.array(v, k.type) for v, k in zip(zip(*out, strict=True), kinds, strict=True)], schema=kinds)
                        out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, k.type) for v, k in zip(zip(*out, strict=True), kinds, strict=True)], schema=kinds)

    need = need.groupBy("id").agg(F.collect_list(F.struct("a", "lo", "size", "rel", "judge")).alias("need"))
    return rows.join(need, "id").mapInArrow(worker(run), "a long, id long, lo long, rel int, judge boolean, s binary")


def repeated_windows(strings: list[bytes], rel, size: int, folder: str | None = None):
    """``string, start`` of each window of ``size`` bytes that another of the strings has at its anchor, too."""
    import numpy as np

    from .column_bwt import column_bwt

    lengths = np.array([len(s) for s in strings], np.int64)
    ends = np.cumsum(lengths)
    begins = ends - lengths
    raw = np.frombuffer(b"".join(strings) + bytes(2 * WORD), np.uint8)
    head = np.asarray(rel, np.int64) % WORD
    words = (lengths - head) // WORD
    at = np.repeat(begins + head - WORD * (np.cumsum(words) - words), words) + WORD * np.arange(words.sum())
    as_words = np.lib.stride_tricks.sliding_window_view(raw, WORD)
    symbols = np.unique(np.ascontiguousarray(as_words[at]).view(np.uint64).ravel(), return_inverse=True)[1] + 1
    owner, tail, lcp, _ = column_bwt(symbols, words, folder)
    near = lcp >= size // WORD - 1
    group = np.cumsum(~near)
    member = near | np.r_[near[1:], False]
    owner, tail, group = owner[member].astype(np.int64), tail[member], group[member]
    place = head[owner] + WORD * (words[owner] - tail)  # of the first whole word, in its string
    out = []
    for h in range(WORD):
        start = place - h
        fits = (start >= 0) & (start + size <= lengths[owner])
        own, s, g = owner[fits], start[fits], group[fits]
        p = begins[own] + place[fits]
        left = np.concatenate([raw[p[:, None] - h + np.arange(h)], raw[p[:, None] + size - WORD + np.arange(WORD - h)]], axis=1)
        left = np.ascontiguousarray(left).view(np.uint64).ravel()
        order = np.lexsort((left, g))
        g, left = g[order], left[order]
        same = (g[1:] == g[:-1]) & (left[1:] == left[:-1])
        twice = order[(np.r_[same, False] | np.r_[False, same])[: len(order)]]
        out.append((own[twice], s[twice]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _judge(contexts: DataFrame, size: int, batch: int, folder: str | None) -> DataFrame:
    """``id, lo, hi``: what repeats in the contexts to be judged. Sorted by anchor, whole anchors to a partition."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        held: list[tuple] = []

        def settle(rows):
            own, start = repeated_windows([r[5] for r in rows], [r[3] for r in rows], size, folder)
            judged = np.array([r[4] for r in rows])[own]
            own, start = own[judged], start[judged]
            doc, lo, hi = _merged(own, start, start + size)
            ids, base = (np.array([r[k] for r in rows], np.int64)[doc] for k in (1, 2))
            return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(base + lo), pa.array(base + hi)], ["id", "lo", "hi"])

        for b in batches:
            held += list(zip(*(b[c].to_pylist() for c in ("a", "id", "lo", "rel", "judge", "s")), strict=True))
            while len(held) > batch:
                k = batch  # up to the end of an anchor
                while k < len(held) and held[k][0] == held[k - 1][0]:
                    k += 1
                if k == len(held):
                    break
                yield settle(held[:k])
                held = held[k:]
        if held:
            yield settle(held)

    return contexts.repartition("a").sortWithinPartitions("a").mapInArrow(worker(run), "id long, lo long, hi long")


KEYED = "a long, c1 long, c2 long, id long, lo long, rel int, judge boolean, s binary, low int, high int"


def _halves(contexts: DataFrame, size: int) -> DataFrame:
    """Contexts (``id, lo, rel, judge, s``) of windows whose anchor is ``low`` to ``high`` bytes behind their start, cut
    to the windows of either half; ``a`` is now a hash of the bytes that all windows of that half have in common."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        names = [x.split()[0] for x in KEYED.split(", ")]
        kinds = [pa.int64()] * 5 + [pa.int32(), pa.bool_(), pa.binary(), pa.int32(), pa.int32()]
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                out = []
                for i, lo, rel, judge, s, low, high in zip(*(b.slice(at, 4096)[c].to_pylist() for c in ("id", "lo", "rel", "judge", "s", "low", "high")), strict=True):
                    half = (low + high) // 2
                    for p, q in ((low, half), (half + 1, high)) if low < high else ((low, high),):
                        near, far = max(p, rel + size - len(s)), min(q, rel)  # of the windows that are there
                        if near <= far:
                            common = s[rel - p : rel - q + size] if q - p < size else b""
                            out.append((xxhash.xxh3_64_intdigest(common, p * 65_536 + q) - 2**63, i, lo + rel - far, far, judge, s[rel - far : rel - near + size], p, q))
                if out:
                    a, i, lo, rel, judge, s, p, q = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.asarray(x) if hasattr(x, "dtype") else x, k) for x, k in zip((a, *_digests(s), i, lo, rel, judge, s, p, q), kinds, strict=True)], names)

    return contexts.select("id", "lo", "rel", "judge", "s", "low", "high").mapInArrow(worker(run), KEYED)


def _dealt(contexts: DataFrame, work: Workspace, size: int, max_group: int) -> tuple[DataFrame, list[DataFrame], bool]:
    """One step of dealing out: contexts in groups of two or more, ``k`` in each; spans of those that are equal; whether
    a group is still too large."""
    halves = work.keep(_halves(contexts, size), "halves")
    by_context = halves.groupBy("a", "c1", "c2").agg(F.count("*").alias("n"), F.min(F.struct("id", "lo")).alias("x"))
    by_context = work.keep(by_context, "half-contexts")
    alike = by_context.filter("n > 1").select("a", "c1", "c2")
    equal = halves.filter("judge").join(alike, ["a", "c1", "c2"]).select("id", "lo", (F.col("lo") + F.length("s")).alias("hi"))
    groups = by_context.groupBy("a").agg(F.count("*").alias("k")).filter("k > 1")
    one = by_context.join(groups, "a").select("a", "c1", "c2", "x.id", "x.lo", "n", "k")
    left = halves.join(one, ["a", "c1", "c2", "id", "lo"]).withColumn("judge", F.col("judge") & (F.col("n") == 1)).drop("n")
    left = work.keep(left, "dealt")
    return left, [equal], bool(left.filter((F.col("k") > max_group) & (F.col("low") < F.col("high"))).limit(1).count())


def repeated_spans(rows: DataFrame, work: Workspace, *, size: int = SIZE, gram: int = GRAM, batch: int = 1000, max_group: int = 4096) -> DataFrame:
    """``id, lo, hi`` (may overlap) in ``rows`` of unique ``id`` and not-null ``text``."""
    if size % WORD or size < 2 * gram or size > 65_535:
        raise ValueError(f"size must be a multiple of {WORD}, twice a gram or more and under 65,536")
    every = work.keep(find_anchors(rows, size, gram), "anchors")
    found = every.filter("a is not null")
    several = work.keep(found.groupBy("a").agg(F.sum("n").alias("t")).filter("t > 1").select("a"), "several")
    found = work.keep(found.join(several, "a"), "found")
    by_context = found.groupBy("a", "c1", "c2").agg(F.sum("n").alias("n"), F.min(F.struct("id", "lo", "size", "rel")).alias("x"))
    by_context = work.keep(by_context, "contexts")
    work.free()
    alike = by_context.filter("n > 1").select("a", "c1", "c2")
    equal = found.join(alike, ["a", "c1", "c2"]).select("id", "lo", (F.col("lo") + F.col("size")).alias("hi"))
    groups = work.keep(by_context.groupBy("a").agg(F.count("*").alias("k")).filter("k > 1"), "groups")
    need = by_context.join(groups, "a").select("a", "x.*", (F.col("n") == 1).alias("judge"), "k")
    columns = work.local_path("columns")
    spans = [every.filter("a is null").select("id", "lo", (F.col("lo") + F.col("size")).alias("hi")), equal]
    spans.append(work.keep(_judge(_contexts(rows, need.filter(F.col("k") <= max_group)), size, batch, columns), "judged"))
    work.free()
    more = groups.filter(F.col("k") > max_group).limit(1).count() > 0
    if more:
        hot = work.keep(_contexts(rows, need.filter(F.col("k") > max_group)), "hot").withColumns({"low": F.lit(0), "high": F.lit(size - gram)})
    while more:
        left, same, more = _dealt(hot, work, size, max_group)
        fits = (F.col("k") <= max_group) | (F.col("low") == F.col("high"))
        spans += same
        spans.append(work.keep(_judge(left.filter(fits).select("a", "id", "lo", "rel", "judge", "s"), size, batch, columns), "judged"))
        hot = left.filter(~fits)
        work.free()
    out = spans[0]
    for s in spans[1:]:
        out = out.unionByName(s)
    return out


def _unique_rows(docs: DataFrame, work: Workspace) -> DataFrame:
    """``id, doc_id, text``: ``id`` is ``doc_id`` where that is unique, else a number given to each row."""
    rows = docs.select(doc_id().alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    repeated = docs.select(doc_id().alias("i")).groupBy("i").count().filter("count > 1").limit(1).count()
    if not repeated:
        return rows.withColumn("id", F.col("doc_id"))
    return work.keep(rows.withColumn("id", F.monotonically_increasing_id()), "rows")


def without_repeats(docs: DataFrame, *, size: int = SIZE, **how) -> DataFrame:
    """Per document: ``doc_id, n_bytes, spans`` (removed ``[lo, hi)``, apart and in order), ``kept`` (the bytes left)."""
    work = Workspace(docs.sparkSession, "repeats")
    rows = _unique_rows(docs.select("doc_id", "text"), work)
    spans = repeated_spans(rows.select("id", "text"), work, size=size, **how)
    spans = work.keep(spans.groupBy("id").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")), "spans")
    work.free()

    def run(batches):
        import numpy as np
        import pyarrow as pa

        pair = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part, found, sizes, kept = b.slice(at, 256), [], [], []
                for text, spans in zip(part["text"].to_pylist(), part["spans"].to_pylist(), strict=True):
                    raw = text.encode()
                    lo, hi = (np.array([x[k] for x in spans or ()], np.int64) for k in ("lo", "hi"))
                    _, lo, hi = _merged(np.zeros(len(lo), np.int64), lo, hi)
                    lo, hi = lo.tolist(), hi.tolist()
                    found.append([{"lo": a, "hi": z} for a, z in zip(lo, hi, strict=True)])
                    sizes.append(len(raw))
                    kept.append(b"".join(raw[a:z] for a, z in zip([0, *hi], [*lo, len(raw)], strict=True)))
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(sizes, pa.int64()), pa.array(found, pair), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    out = rows.join(spans, "id", "left").select("doc_id", "text", "spans")
    return out.mapInArrow(worker(run), "doc_id long, n_bytes long, spans array<struct<lo: long, hi: long>>, kept binary").withColumn("doc_id", null_id(F.col("doc_id")))


def repeat_digest(docs: DataFrame, **how) -> DataFrame:
    """``without_repeats`` with counts and a hash for spans and bytes."""
    return without_repeats(docs, **how).select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )
