import re
from collections import defaultdict

import pytest

from voxloom.llm import decontaminate, line_dedup

low = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s)


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_line_dedup(docs, rows, batches):
    key = lambda line: low(line.strip(" \t\n\x0b\x0c\r"))
    least = lambda i: -1 if i is None else i
    found = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            found[key(line)].add(least(i))
    want = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if len(key(x)) < 10 or min(found[key(x)]) == least(i)]
        want.append((str(i), "\n".join(stay), len(lines), len(lines) - len(stay)))
    got = [(str(r[0]), *r[1:]) for r in line_dedup.drop_repeated_lines(docs, batches=batches).collect()]
    assert sorted(got) == sorted(want)
    assert any(r[3] for r in want)


def plain_hits(rows, items, n=13):
    words = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t or "")) if w]
    out = []
    for i, t in rows:
        w, hit, ids = words(t), set(), set()
        for item, text in items:
            v = words(text)
            size = min(n, len(v))
            wins = {tuple(v[a : a + size]) for a in range(len(v) - size + 1)} if v and item is not None else set()
            for a in range(len(w) - size + 1):
                if tuple(w[a : a + size]) in wins:
                    hit |= set(range(a, a + size))
                    ids.add(str(item))
        out.append((str(i), len(w), len(hit), sorted(ids), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def items_of(rows):
    long = next(t for _, t in rows if t and len(t) > 9000).split(" ")
    return [(1, " ".join(long[40:62])), (2, "zz9 " + " ".join(long[500:520])), (3, "One-Two"), (4, "tira"), (5, None), (6, "..."), (7, " ".join(long[41:63])), (None, "kara"), (10, "tira"), (11, " ".join(long[9:21]))]


@pytest.mark.parametrize("block_rows", [200_000, 7])
def test_decontaminate(spark, docs, rows, block_rows):
    items = items_of(rows)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = [(str(r[0]), *r[1:]) for r in decontaminate.decontaminate(docs, bench, block_rows=block_rows).collect()]
    want = plain_hits(rows, items)
    assert sorted(got) == sorted(want)
    assert any(r[4] for r in want) and any(r[2] and not r[4] for r in want)


def test_decontaminate_without_rows(spark, docs, no_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert decontaminate.decontaminate(no_docs, some).count() == 0
    assert {r["contaminated"] for r in decontaminate.decontaminate(docs, none).collect()} == {False}
    assert decontaminate.remove_leaks(docs, none).count() == docs.count()


def test_remove_leaks_cuts_or_drops(spark):
    leak = "q1 q2 q3 q4 q5 q6 q7 q8 q9 q10 q11 q12 q13"
    filler = " ".join(f"w{i}" for i in range(400))
    rows = [(1, f"{filler}\n({leak.upper()}), {filler}", 9, "a"), (2, f"pre {leak} post", 9, "b"), (3, "clean, text", 9, None), (4, None, None, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, __w string")
    out = {r["doc_id"]: r for r in decontaminate.remove_leaks(docs, spark.createDataFrame([(1, leak)], "item_id long, text string")).collect()}
    assert sorted(out) == [1, 3, 4]
    assert out[1]["text"] == f"{filler}\n({filler}"
    assert out[1]["n_chars"] == len(out[1]["text"]) and out[3]["text"] == "clean, text" and out[3]["n_chars"] == 9


def test_passages_of_items_without_id_are_removed_too(spark):
    leak = " ".join(f"q{i}" for i in range(13))
    filler = " ".join(f"w{i}" for i in range(400))
    docs = spark.createDataFrame([(1, f"{filler} {leak}"), (2, f"pre {leak} post"), (3, "clean")], "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in decontaminate.remove_leaks(docs, spark.createDataFrame([(None, leak)], "item_id long, text string")).collect()}
    assert set(out) == {1, 3} and "q5" not in out[1]


CLASHING = ("__id", "__hit", "__w", "__th", "__n_hit", "id", "th", "hit", "row", "w", "g", "stay", "a`b", "a.b", "block", "s", "node", "none", "r")


@pytest.mark.parametrize("stage", ["decontaminate", "near_dedup", "mix", "groups"])
def test_other_columns_of_any_name_come_through(spark, stage):
    from voxloom.llm import mixing, near_copies, simhash

    words = [" ".join(f"{c}{i}" for i in range(60)) for c in "abc"]
    rows = [(k, t, f"src{k % 2}", *[f"{n} {k}" for n in CLASHING]) for k, t in enumerate(words)]
    kinds = "doc_id long, text string, source string, " + ", ".join("`" + n.replace("`", "``") + "` string" for n in CLASHING)
    docs, bench = spark.createDataFrame(rows, kinds), spark.createDataFrame([(1, "none of these")], "item_id long, text string")
    run = {
        "decontaminate": lambda: decontaminate.remove_leaks(docs, bench), "near_dedup": lambda: near_copies.one_of_each_text(docs),
        "mix": lambda: mixing.mixed_documents(docs), "groups": lambda: simhash.one_of_each_group(docs),
    }
    out = run[stage]()
    assert out.schema.names == docs.schema.names and out.dtypes == docs.dtypes
    assert {tuple(r) for r in out.collect()} == set(rows)


def test_line_dedup_without_rows(no_docs):
    assert line_dedup.drop_repeated_lines(no_docs).count() == 0
