import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.functions import frames as fr
from voxloom.operators import frames, intervals, subtitles, words


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("n", "want"), [(0, 1), (1, 1), (159_999, 1), (160_000, 1), (160_001, 2), (176_000, 2), (176_001, 3), (1_000_000, 54)])
def test_windows_of_a_signal(spark, n, want):
    assert one(spark, fr.num_chunks(F.lit(n))) == want


def test_frame_grid(spark):
    assert [one(spark, fr.num_global_frames(F.lit(k))) for k in (1, 2)] == [589, 648]
    assert [one(spark, fr.chunk_start_frame(F.lit(k))) for k in (0, 1, 2)] == [0, 58, 117]
    assert one(spark, fr.closest_frame(F.lit(-3.0))) == 0


def test_powerset_ties_and_nans(spark):
    cases = [([0.0] * 7, 0), ([0, 1, 1, 0, 0, 0, 0], 1), ([-9, -8, -7, -6, -5, -4, -3], 6), ([0, float("nan"), -1, 2, 0, 0, 0], 3), ([float("nan")] + [1] * 6, 0)]
    for scores, want in cases:
        assert one(spark, fr.powerset_argmax(F.array(*[F.lit(float(s)) for s in scores]))) == want


def test_mask_gate(spark):
    def mask(clean, shared):
        f = [[True, False, False]] * clean + [[True, True, False]] * shared + [[False, True, False]]
        return one(spark, fr.choose_mask(F.array(*[F.array(*map(F.lit, x)) for x in f]), F.lit(0)))

    assert sum(mask(11, 4)) == 11 and sum(mask(10, 4)) == 14


def test_nearest_rows(spark):
    rows = spark.range(998).select(fr.nearest_upsample(F.col("id"), 589, F.lit(998)).alias("x")).collect()
    assert [r["x"] for r in rows] == [i * 589 // 998 for i in range(998)]
    on = [i for i, r in enumerate(rows) if 100 <= r["x"] < 200]
    assert (on[0], on[-1]) == (170, 338)


def fold(active, labels, n_chunks, n_clusters, cap=None):
    """The frame algebra, step by step."""
    d = 10 / 589
    start = lambda t: max(int(np.rint(t / d - 0.5)), 0)
    total = start(10 + n_chunks - 1) + 1
    on, cover = np.zeros(total), np.zeros(total)
    for c in range(n_chunks):
        cover[start(c) : start(c) + 589] += 1
    for c, f, _ in active:
        on[start(c) + f] += 1
    count = np.rint(on / np.maximum(cover, 1)).astype(int)
    count = count if cap is None else np.minimum(count, cap)
    width = max(n_clusters, count.max())
    support = np.zeros((total, width))
    for c, f, k in {(c, f, labels[c, s]) for c, f, s in active if labels.get((c, s)) is not None}:
        support[start(c) + f, k] += 1
    binary = np.zeros((total, width), bool)
    for t in range(total):
        for k in sorted(range(width), key=lambda k: (-support[t, k], k))[: count[t]]:
            binary[t, k] = True
    mid, turns = lambda i: (i + 0.5) * 10 / 589, []
    for k in range(width):
        t = 0
        while t < total:
            if binary[t, k]:
                a = t
                while t < total and binary[t, k]:
                    t += 1
                turns.append((mid(a), mid(min(t, total - 1)), k))
            t += 1
    turns.sort()
    names = {}
    for t in turns:
        names.setdefault(t[2], len(names))
    return count, [(round(a, 9), round(e, 9), names[k]) for a, e, k in turns]


@pytest.mark.parametrize("cap", [None, 1])
def test_turns_against_a_fold(spark, cap):
    rng = random.Random(6)
    active, labels, files = {}, {}, []
    for f in range(6):
        n = rng.randint(1, 5)
        files.append((f, n))
        active[f] = set()
        for _ in range(12):
            c, s, a = rng.randrange(n), rng.randrange(3), rng.randrange(589)
            active[f] |= {(c, k, s) for k in range(a, min(589, a + rng.choice([1, 40, 200])))}
        active[f] |= {(n - 1, 588, 0)}  # starts on the last frame
        labels[f] = {(c, s): rng.choice([0, 1, None, 1]) for c in range(n) for s in range(3)}
    act = spark.createDataFrame([(f, c, k, s) for f, rows in active.items() for c, k, s in rows], "file_id long, chunk_no int, frame_no int, local_spk int")
    lab = spark.createDataFrame([(f, c, s, k) for f, m in labels.items() for (c, s), k in m.items()], "file_id long, chunk_no int, local_spk int, cluster int")
    fl = spark.createDataFrame([(f, n, 2) for f, n in files], "file_id long, n_chunks int, n_clusters int").withColumn("n_frames", fr.num_global_frames(F.col("n_chunks")))
    counts = frames.speaker_count(act, fl, cap=cap)
    top = frames.top_clusters(frames.cluster_support(act, lab), counts, fl.select("file_id", "n_clusters"))
    got = frames.renumber(frames.to_turns(top, fl)).collect()
    for f, n in files:
        count, turns = fold(active[f], labels[f], n, 2, cap)
        assert sorted((round(r["start"], 9), round(r["end"], 9), r["speaker"]) for r in got if r["file_id"] == f) == sorted(turns)


@pytest.mark.parametrize("width", [None, 7, 1000])
def test_dominant_speaker_against_a_fold(spark, width):
    rng = random.Random(4)
    span = lambda: (lambda a: (a, a + rng.randint(0, 30)))(rng.randint(-50, 200))
    seg = [(f, i, *span()) for f in range(12) for i in range(25)]
    trn = [(f, *span(), rng.randint(0, 3)) for f in range(10) for _ in range(12)] + [(0, 10, 5, 9)]
    s = spark.createDataFrame(seg, "file_id long, seg_no int, start long, end long")
    t = spark.createDataFrame(trn, "file_id long, start long, end long, speaker int")
    got = {(r["file_id"], r["seg_no"]): r["speaker"] for r in intervals.dominant_speaker(s, t, bin_width=width).collect()}
    assert len(got) == len(seg)
    for f, i, a, e in seg:
        sums = Counter()
        for g, b, z, k in trn:
            if g == f and min(e, z) > max(a, b):
                sums[k] += min(e, z) - max(a, b)
        assert got[f, i] == (min(sums, key=lambda k: (-sums[k], k)) if sums else None)


def test_sanitized_against_a_fold(spark):
    rng = random.Random(2)
    rows = [(f, i, rng.uniform(-5, 20), rng.uniform(-5, 25)) for f in range(8) for i in range(30)]
    got = subtitles.sanitized(spark.createDataFrame(rows, "file_id long, seg_no int, start double, end double")).collect()
    want, end = {}, {}
    for f, i, a, e in rows:
        a = max(a, 0.0, end.get(f, 0.0))
        end[f] = max(e, a)
        want[f, i] = (a, end[f])
    assert {(r["file_id"], r["seg_no"]): (r["start"], r["end"]) for r in got} == want


def test_raw_segments_and_words(spark):
    raw = spark.createDataFrame([(0.6, "  kept  ", 0, 150), (0.7, "gone", 0, 1), (0.0, "   ", 0, 1), (0.1, " x\n", 5, 7)], "no_speech float, text string, start_cs long, end_cs long")
    assert [tuple(r) for r in words.filter_segments(raw).collect()] == [("kept", 0.0, 1.5), ("x", 0.05, 0.07)]
    tokens = ["[_BEG_]", "Hel", "lo", " wor", "ld", " ", ".\n", " [x]", "[TT_5]"]
    df = spark.createDataFrame([(0, 0, i, t, 10 * i, 10 * i + 9) for i, t in enumerate(tokens)], "file_id long, seg_no int, tok_no int, text string, t0_cs long, t1_cs long")
    got = sorted(words.group_words(df).collect(), key=lambda r: r["word_no"])
    assert [(r["text"], r["start"], r["end"]) for r in got] == [("Hello", 0.1, 0.29), ("world.\n", 0.3, 0.69), ("[x]", 0.7, 0.79)]


def test_silent_frames_are_neither_shuffled_nor_sorted(spark, tmp_path):
    """A file of an hour with three frames on: its 200,000 frames come, but only after the last exchange."""
    active = spark.createDataFrame([(0, 0, 0, 0), (0, 9, 58, 0), (0, 9, 58, 1), (0, 3599, 588, 2), (1, 0, 5, 0)], "file_id long, chunk_no int, frame_no int, local_spk int")
    files = spark.createDataFrame([(0, 3600), (1, 1), (2, 2), (None, 1)], "file_id long, n_chunks int")
    counts = frames.speaker_count(active, files)
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("Window") and "Join" not in plan
    got = counts.groupBy("file_id").agg(F.count("*").alias("frames"), F.countDistinct("frame"), F.sum("n")).collect()
    ends = {n: max(int(np.rint((9 + n) / (10 / 589) - 0.5)), 0) + 1 for n in (1, 2, 3600)}
    assert sorted(tuple(r) for r in got if r[0] is not None) == [(0, ends[3600], ends[3600], 2), (1, ends[1], ends[1], 1), (2, ends[2], ends[2], 0)]
    assert [tuple(r) for r in got if r[0] is None] == [(None, ends[1], ends[1], 0)]
    assert dict(counts.dtypes) == {"file_id": "bigint", "frame": "int", "n": "int"}


def test_a_frame_is_one_row_until_its_clusters_are_chosen(spark):
    counts = spark.createDataFrame([(0, 0, 3), (0, 1, 1), (0, 2, 0), (1, 0, 2)], "file_id long, frame int, n int")
    support = spark.createDataFrame([(0, 0, 4, 9), (0, 0, 1, 2), (0, 0, 99, 50), (0, 2, 1, 1)], "file_id long, frame int, cluster int, support long")
    clusters = spark.createDataFrame([(0, 5), (1, 1)], "file_id long, n_clusters int")
    top = frames.top_clusters(support, counts, clusters)
    assert "explode(sequence" not in top._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(tuple(r) for r in top.collect()) == [(0, 0, 0), (0, 0, 1), (0, 0, 4), (0, 1, 0), (1, 0, 0), (1, 0, 1)]


@pytest.mark.parametrize("width", [None, 7, 1000])
def test_speakers_of_pieces_are_found_in_the_segments_own_row(spark, width):
    rng = random.Random(8)
    seg = [(f, i, a, a + rng.randint(0, 40)) for f in range(8) for i in range(15) for a in [rng.randint(-50, 200)]]
    trn = [(f, a, a + rng.randint(0, 30), rng.randint(0, 3)) for f in range(7) for _ in range(25) for a in [rng.randint(-50, 200)]] + [(0, 10, 5, 9)]
    s = spark.createDataFrame(seg, "file_id long, seg_no int, start long, end long")
    t = spark.createDataFrame(trn, "file_id long, start long, end long, speaker int")
    rows = intervals.with_overlapping_turns(s, t, bin_width=width).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(4))))
    cut = lambda k: F.col("start") + F.call_function("div", (F.col("end") - F.col("start")) * k, F.lit(5))
    got = {(r["file_id"], r["seg_no"], r["k"]): r["x"] for r in rows.select("*", intervals.speaker_within(cut(F.col("k")), cut(F.col("k") + 1), F.col("turns")).alias("x")).collect()}
    assert len(got) == 5 * len(seg)
    for f, i, a, e in seg:
        for k in range(5):
            lo, hi, sums = a + (e - a) * k // 5, a + (e - a) * (k + 1) // 5, Counter()
            for g, b, z, who in trn:
                if g == f and min(hi, z) > max(lo, b):
                    sums[who] += min(hi, z) - max(lo, b)
            assert got[f, i, k] == (min(sums, key=lambda x: (-sums[x], x)) if sums else None)


def test_words_are_not_shuffled_to_find_their_speakers(spark):
    from voxloom.queries import QUERIES

    plan = QUERIES["dominant_speaker_words"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("posexplode") < min(plan.index("Join"), plan.index("Aggregate"))
