import math
import random
from collections import Counter

import numpy as np
import pytest

from voxloom.llm import cotraining, mixing

GOOD = ["river", "stone", "walks", "the", "and", "morning", "light", "over", "quiet", "house", "garden", "of"]


def labelled(n=900, seed=1):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        bad = rng.random() < 0.3
        words = [rng.choice(GOOD) for _ in range(rng.randint(5, 80))]
        if bad:
            words = rng.choice([lambda w: [x.upper() + "!!" for x in w], lambda w: [x + "###" for x in w], lambda w: [w[0]] * len(w)])(words)
        text = " ".join(words).capitalize() + ("" if bad else ".")
        rows.append((i, text, "web" if rng.random() < 0.4 else f"s{i % 5}", "en", len(text), "extra"))
        if i % 2:
            labels.append((i, int(not bad), 0))
    truth = {r[0]: not (("!!" in r[1]) or ("###" in r[1]) or len(set(r[1].lower().strip(".").split())) == 1) for r in rows}
    odd = [(5000, None, None, None, None, None), (5001, "", "web", "xx", 0, None), (5002, "word " * 40_000, "s1", "en", 1, None), rows[3], (None, "quiet house.", "s1", "en", 12, None)]
    return rows + odd, [*labels, (1, None, None), (99_999, 1, 0), (None, 0, 0), labels[3]], truth


KINDS = "doc_id long, text string, source string, lang string, n_chars long, score string"


@pytest.fixture(scope="module")
def data(spark):
    rows, labels, truth = labelled()
    return spark.createDataFrame(rows, KINDS).repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), truth


def test_held_out_accuracy(data):
    docs, labels, truth = data
    got = {r["doc_id"]: r for r in cotraining.quality(docs, labels).collect()}
    unseen = [i for i in truth if i % 2 == 0]
    assert np.mean([got[i]["keep"] == truth[i] for i in unseen]) > 0.97
    assert all(0 <= got[i][c] <= 1 for i in got for c in ("p_text", "p_meta", "score"))
    assert cotraining.quality(docs, labels).count() == docs.count()


def test_filter_is_the_score_and_keeps_all_columns(data):
    docs, labels, _ = data
    model = cotraining.fit_quality(docs, labels)
    assert model.held_out["rows"] > 50 and sum(model.held_out["pseudo"]) > 0
    kept = cotraining.keep_good(docs, labels, model=model)
    assert kept.columns == docs.columns
    want = Counter(str(r["doc_id"]) for r in cotraining.quality(docs, labels, model=model).collect() if r["keep"])
    assert Counter(str(r["doc_id"]) for r in kept.collect()) == want


def test_without_labels_or_documents(spark, data):
    docs, labels, _ = data
    none = labels.limit(0)
    assert {r["keep"] for r in cotraining.quality(docs, none).collect()} == {True}
    assert cotraining.keep_good(docs, labels.filter("quality = 1")).count() == docs.count()
    assert cotraining.quality(docs.limit(0), labels).count() == 0
    assert cotraining.quality(docs.drop("source", "lang", "n_chars"), labels).count() == docs.count()


def test_views_teach_each_other():
    rng = np.random.default_rng(3)
    y = (rng.random(600) < 0.5).astype(float)
    x = np.zeros((600, cotraining.META.stop))
    x[:, :20] = rng.normal(size=(600, 20)) + 2.0 * (y[:, None] - 0.5)
    x[:, cotraining.META.start : cotraining.META.start + 6] = rng.normal(size=(600, 6)) + 2.5 * (y[:, None] - 0.5)
    model = cotraining.co_train(x[:80], y[:80], x[80:400])
    assert min(model.held_out["pseudo"]) > 50
    assert ((model(x[400:])[2] >= 0.5) == y[400:]).mean() > 0.95


def rows_to_mix():
    rng = random.Random(8)
    rows = [(i, " ".join("w" for _ in range(rng.randint(0, 30))), rng.choice(["hot"] * 6 + ["b", "b", "c", None]), i) for i in range(700)]
    return [*rows, rows[5], rows[5], (None, "a b c", "hot", 1), (9000, None, "empty", 2), (9001, " \n", "empty", 3), (9002, "x " * 5000, "c", 4)]


MIX = "doc_id long, text string, source string, block int"


def sums(rows):
    out = Counter()
    for _, text, source, _ in rows:
        out[source or ""] += len((text or "").split())
    return out


@pytest.mark.parametrize("how", [{}, {"max_repeats": 3.0}, {"max_repeats": None, "target_entropy": 1.2}, {"budget": 4000, "max_repeats": 2.0}, {"broadcast_rows": 0}, {"max_repeats": 4.0, "blocks": 1}])
def test_mix_against_a_plain_version(spark, how):
    rows = rows_to_mix()
    got = mixing.mix(spark.createDataFrame(rows, MIX).repartition(3), **how).collect()
    tokens = sums(rows)
    alive = {s: float(t) for s, t in tokens.items() if t}
    args = {"max_repeats": 1.5, "target_entropy": None, "budget": None} | {k: v for k, v in how.items() if k in ("max_repeats", "target_entropy", "budget")}

    def weights(a):
        p = {s: t**a for s, t in alive.items()}
        return {s: v / sum(p.values()) for s, v in p.items()}

    def fits(a):
        w = weights(a)
        b = args["budget"] or max(t / w[s] for s, t in alive.items())
        entropy = -sum(v * math.log(v) for v in w.values())
        return (args["target_entropy"] is None or entropy <= args["target_entropy"] + 1e-9) and (args["max_repeats"] is None or max(b * w[s] / t for s, t in alive.items()) <= args["max_repeats"] + 1e-6)

    alpha = next(a / 4000 for a in range(4001) if fits(a / 4000))
    want = weights(alpha)
    by_source = Counter()
    for r in got:
        by_source[r["source"]] += r["n_tokens"]
        assert r["weight"] == pytest.approx(want.get(r["source"], 0), abs=2e-3)
    budget = args["budget"] or max(t / want[s] for s, t in alive.items())
    most = max(len((t or "").split()) for _, t, _, _ in rows)
    for s, w in want.items():
        assert by_source[s] <= w * budget * (1 + 2e-3) + 1
        assert by_source[s] >= w * budget * (1 - 2e-3) - 3 * most  # the last document that doesn't fit
    passes = Counter((str(r["doc_id"]), r["source"], r["pass"]) for r in got)
    if not args["budget"]:
        whole = Counter((str(i), s or "", 0) for i, _, s, _ in rows)
        assert {k: v for k, v in passes.items() if k[2] == 0} == whole  # nothing is lost
    assert all((d, s, p - 1) in passes for d, s, p in passes if p)


def test_mix_is_repeatable_and_its_documents_are_the_copies(spark):
    rows = rows_to_mix()
    a, b = (spark.createDataFrame(rows, MIX).repartition(n) for n in (2, 5))
    count = lambda df: Counter(str(r["doc_id"]) for r in df.collect())
    assert count(mixing.mix(a)) == count(mixing.mix(b)) == count(mixing.mixed_documents(a))
    assert mixing.mixed_documents(a).columns == a.columns
    assert mixing.mix(a.limit(0)).count() == 0 and mixing.mixed_documents(a.limit(0)).count() == 0


def test_each_pass_has_a_permutation_of_its_own(spark):
    rows = mixing.mix(spark.createDataFrame([(i, "a b", "one" if i < 40 else "two", 0) for i in range(400)], MIX), max_repeats=6.0, blocks=8).filter("source = 'one'").collect()
    orders = {}
    for p in {r["pass"] for r in rows}:
        orders[p] = [r["doc_id"] for r in sorted((r for r in rows if r["pass"] == p), key=lambda r: (r["block_rank"], r["block"], r["place"]))]
    assert len(orders) >= 3 and orders[0] != orders[1] and sorted(orders[0]) == sorted(orders[1])
    for order in orders.values():  # a block's documents stand together
        blocks = [next(r["block"] for r in rows if r["doc_id"] == d) for d in order]
        assert len([k for k in range(len(blocks)) if not k or blocks[k] != blocks[k - 1]]) == len(set(blocks))


def test_bisect():
    assert mixing.bisect(lambda a: a >= 0.3) == pytest.approx(0.3)
    assert mixing.bisect(lambda a: True) == 0.0


def test_few_labels_of_one_kind_are_not_lost(spark, data):
    docs, labels, truth = data
    bad = [r["doc_id"] for r in labels.filter("quality = 0 and doc_id is not null").collect()]
    absent = spark.range(10**6, 10**6 + 3000).selectExpr("id as doc_id", "cast(1 as long) quality", "cast(0 as long) toxic")
    few = labels.filter("quality = 1").unionByName(labels.filter(labels["doc_id"].isin(bad[:8]) & (labels["quality"] == 0)))
    model = cotraining.fit_quality(docs, few.selectExpr("doc_id", "cast(quality as long) quality", "cast(toxic as long) toxic").unionByName(absent), max_labelled=200)
    assert model is not None
    kept = {r["doc_id"] for r in cotraining.quality(docs, labels, model=model).filter("keep").collect()}
    assert sum(i in kept for i in truth if truth[i]) > 0.9 * sum(truth.values())
    assert len(kept) < docs.count()


def plain_logistic(rows, ys, ridge):
    """Weights, constant first, by plain descent along Newton's direction; both kinds weigh the same."""
    rows, ys = [np.concatenate([[1.0], r]) for r in rows], list(ys)
    n, n_good = len(ys), sum(ys)
    weigh = [0.5 * n / n_good if y else 0.5 * n / (n - n_good) for y in ys]
    lam = ridge * n / (2 * max(1, min(n_good, n - n_good)))
    w = np.zeros(len(rows[0]))
    for _ in range(40):
        g, h = lam * w, lam * np.eye(len(w))
        g[0], h[0, 0] = 1e-6 * w[0], 1e-6
        for r, y, s in zip(rows, ys, weigh):
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, float(r @ w)))))
            g = g + s * (p - y) * r
            h = h + (s * p * (1 - p) + 1e-9) * np.outer(r, r)
        w = w - np.linalg.solve(h, g)
    return w


def test_against_plain_co_training():
    rng = np.random.default_rng(3)
    dims = cotraining.META.stop
    text, meta = range(dims)[cotraining.TEXT], range(dims)[cotraining.META]
    y = (rng.random(60) < 0.7).astype(float)
    hidden = (rng.random(50) < 0.7).astype(float)

    def draw(of):
        x = np.zeros((len(of), dims), np.float32)
        x[:, text[0]], x[:, text[1]] = 2 * of + rng.normal(0, 0.5, len(of)), rng.normal(0, 1, len(of))
        x[:, meta[0]], x[:, meta[1]] = 2 * of + rng.normal(0, 0.7, len(of)), rng.normal(0, 1, len(of))
        return x

    x, pool = draw(y), draw(hidden)
    model = cotraining.co_train(x, y, pool, rounds=2, sure=0.9, per_round=20)
    mean, scale = x.mean(0, dtype=float).astype(np.float32), (x.std(0, dtype=float) + 1e-3).astype(np.float32)
    norm = lambda v: np.clip((v - mean) / scale, -4, 4)
    z, free = norm(x), norm(pool)
    order, held = np.random.default_rng(7).permutation(60).tolist(), set()
    for k in (0, 1):
        held |= set([i for i in order if y[i] == k][::5])
    inside = [i for i in range(60) if i not in held]
    used = [0, 1]  # of each view, all others are zero here
    cut = lambda row, v: row[[(text, meta)[v][c] for c in used]].astype(float)
    sets = [([cut(z[i], v) for i in inside], [y[i] for i in inside]) for v in (0, 1)]
    left = [set(range(50)), set(range(50))]
    good = sum(y[i] for i in inside) / len(inside)
    odds = lambda t: 1 / (1 + math.exp(-t))
    fit = lambda v, ridge=1.0: plain_logistic(*sets[v], ridge)
    w = [fit(0), fit(1)]
    for _ in range(2):
        for v in (0, 1):
            p = [odds(w[v][0] + cut(free[i], v) @ w[v][1:]) for i in range(50)]
            for k, share in ((1, good), (0, 1 - good)):
                trust = [q if k else 1 - q for q in p]
                picks = sorted((i for i in left[1 - v] if trust[i] >= 0.9), key=lambda i: -trust[i])[: int(20 * share)]
                left[1 - v] -= set(picks)
                sets[1 - v] = (sets[1 - v][0] + [cut(free[i], 1 - v) for i in picks], sets[1 - v][1] + [float(k)] * len(picks))
        w = [fit(0), fit(1)]
    assert model.held_out["pseudo"] == [len(sets[v][1]) - len(inside) for v in (0, 1)] and min(model.held_out["pseudo"]) > 5
    back = sorted(held)
    raw = [[w[v][0] + cut(z[i], v) @ w[v][1:] for i in back] for v in (0, 1)]
    bend = [plain_logistic([[r] for r in raw[v]], [y[i] for i in back], 0.01) for v in (0, 1)]
    clip = lambda t: max(-5.0, min(5.0, t))
    both = [[clip(bend[v][0] + bend[v][1] * raw[v][k]) for v in (0, 1)] for k in range(len(back))]
    last = plain_logistic(both, [y[i] for i in back], 0.1)
    got = model(pool)
    for i in range(50):
        views = [clip(bend[v][0] + bend[v][1] * (w[v][0] + cut(free[i], v) @ w[v][1:])) for v in (0, 1)]
        want = (odds(views[0]), odds(views[1]), odds(last[0] + last[1] * views[0] + last[2] * views[1]))
        assert [float(g[i]) for g in got] == pytest.approx(want, abs=2e-3)


def test_page_view_sees_nothing_of_the_text():
    a, b = cotraining.features("One text. Two lines.\nx", "web", "en", 30), cotraining.features("entirely other words", "web", "en", 30)
    assert (a[cotraining.META] == b[cotraining.META]).all() and (a[cotraining.TEXT] != b[cotraining.TEXT]).any()
    assert (cotraining.page_data(None, None, None) != cotraining.page_data(None, None, 0)).any()
