import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from voxloom.llm import column_bwt, repeats


@pytest.mark.parametrize("seed", range(8))
def test_column_bwt_against_sorted_suffixes(seed):
    rng = random.Random(seed)
    strings = [[rng.randint(1, 1 + seed) for _ in range(rng.randint(0, 25))] for _ in range(rng.randint(0, 12))]
    strings += strings[:2]
    flat = np.array([s for x in strings for s in x], np.int64)
    owner, size, lcp, bwt = column_bwt.column_bwt(flat, np.array([len(x) for x in strings], np.int64))
    want = sorted(([*strings[i][len(strings[i]) - k :], 0], i, k) for i in range(len(strings)) for k in range(len(strings[i]) + 1))
    assert [strings[i][len(strings[i]) - k :] for i, k in zip(owner.tolist(), size.tolist())] == [w[:-1] for w, _, _ in want]
    assert sorted(zip(owner.tolist(), size.tolist())) == sorted((i, k) for _, i, k in want)
    for r, (i, k) in enumerate(zip(owner.tolist(), size.tolist())):
        s = strings[i]
        assert bwt[r] == (s[len(s) - k - 1] if k < len(s) else 0)
        if r:
            before, now = want[r - 1][0][:-1], want[r][0][:-1]
            same = 0
            while same < min(len(before), len(now)) and before[same] == now[same]:
                same += 1
            assert lcp[r] == same


def plain(rows, size):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i : i + size] for t in texts for i in range(len(t) - size + 1))
    out = []
    for (doc, _), t in zip(rows, texts):
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - size + 1):
            if seen[t[i : i + size]] > 1:
                gone[i : i + size] = True
        edges = np.diff(np.r_[0, gone.astype(int)])
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((str(doc), len(t), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdeéüß") for _ in range(rng.randint(1, 9))) for _ in range(n))


def hard(size):
    rng = random.Random(size)
    passages = [prose(rng, rng.choice([40, 90, 150, 300])) for _ in range(12)]
    edge = prose(rng, 400).encode()[:size].decode(errors="ignore")
    texts = []
    for _ in range(45):
        parts = [prose(rng, rng.randint(0, 120)) for _ in range(3)]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            parts.insert(rng.randint(0, len(parts)), p[rng.randint(0, 30) : len(p) - rng.randint(0, 30)])
        texts.append(" ".join(parts))
    words = prose(rng, 260).split(" ")
    for _ in range(30):  # near copies
        copy = list(words)
        for _ in range(rng.randint(0, 6)):
            copy[rng.randrange(len(copy))] = "X"
        texts.append(" ".join(copy))
    texts += ["De De " * 500, "ab" * 900, "x" * (size - 1), "x" * size, "x" * (size + 1), "q" * 3000, edge, edge + "1", "1" + edge, "", None, passages[0] * 2, prose(rng, 4000)]
    return texts


@pytest.mark.parametrize("max_group", [65_536, 3])
def test_repeats_against_brute_force(spark, max_group):
    rows = list(enumerate(hard(400)))
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], "doc_id long, text string, a string, lo int").repartition(4)
    got = sorted((str(r[0]), *r[1:]) for r in repeats.repeat_digest(df, max_group=max_group).collect())
    assert got == plain(rows, 400)
    assert sum(r[2] for r in got) > 10_000


def test_small_sizes_and_repeated_ids(spark, docs, rows, no_docs):
    got = sorted((str(r[0]), *r[1:]) for r in repeats.repeat_digest(docs, size=64, gram=8).collect())
    assert got == plain(rows, 64)
    assert repeats.repeat_digest(no_docs).count() == 0


def test_anchors_cover_each_window_once():
    rng = random.Random(1)
    texts = [prose(rng, 300).encode(), b"short", b"ab" * 700, b"", prose(rng, 90).encode()]
    buf = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    starts = ends - [len(t) for t in texts]
    found = repeats.anchors(buf, starts, ends, 400, 32)
    covered = Counter((d, o) for d, lo, n in zip(found["doc"].tolist(), found["lo"].tolist(), found["size"].tolist()) for o in range(lo, lo + n - 400 + 1))
    assert covered == Counter((d, starts[d] + o) for d, t in enumerate(texts) for o in range(len(t) - 399))


@pytest.mark.parametrize("limit", [1, 700, 5000, 1 << 20])
def test_pieces_of_long_texts_have_each_window_once(monkeypatch, limit):
    rng = random.Random(3)
    texts = [prose(rng, 500), "", "short", prose(rng, 60), "é" * 399, prose(rng, 2000), "x" * 400]
    monkeypatch.setattr(repeats, "BUFFER", limit)
    column = pa.array(["skipped", *texts])[1:]
    seen = Counter()
    for buf, row, starts, ends, base in repeats._pieces(column, 400):
        x = repeats.anchors(buf, starts, ends, 400, 32)
        for d, lo, n in zip(x["doc"].tolist(), x["lo"].tolist(), x["size"].tolist()):
            text = texts[row[d]].encode()
            for o in range(lo, lo + n - 399):
                at = int(o - starts[d] + base[d])
                assert buf[o : o + 400].tobytes() == text[at : at + 400]
                seen[int(row[d]), at] += 1
    assert seen == Counter((r, i) for r, t in enumerate(texts) for i in range(len(t.encode()) - 399))
    assert not list(repeats._pieces(pa.array([], pa.string()), 400))


def test_windows_of_strings_without_repeats():
    rng = random.Random(9)
    for strings in ([b"x" * 400], [rng.randbytes(400), rng.randbytes(500)], [b"", b"short"]):
        own, start = repeats.repeated_windows(strings, [0] * len(strings), 400)
        assert not len(own) and not len(start)
    own, start = repeats.repeated_windows([b"y" + b"x" * 400, b"x" * 400 + b"z"], [9, 8], 400)
    assert sorted(zip(own.tolist(), start.tolist())) == [(0, 1), (1, 0)]


def test_files_are_gone_and_blocks_of_any_size_agree(tmp_path):
    rng = random.Random(4)
    strings = [[rng.randint(1, 4) for _ in range(rng.randint(0, 30))] for _ in range(20)]
    flat, lengths = np.array([s for x in strings for s in x], np.int64), np.array([len(x) for x in strings], np.int64)
    want = column_bwt.column_bwt(flat, lengths)
    for block in (1, 3, 50):
        got = column_bwt.column_bwt(flat, lengths, str(tmp_path / "columns"), block)
        assert all((a == b).all() for a, b in zip(got, want))
    assert not list((tmp_path / "columns").iterdir())
