"""Quality classifier by co-training.

Two logistic models see a document from two sides: its content (byte-pair profile, statistics of words and lines)
and its page data (the columns source, lang and n_chars; nothing of the text). Both start from labelled rows; in each round each gives the other
those unlabelled documents it is sure of. Held-out labelled rows then calibrate each (Platt) and weigh the two
calibrated log-odds into one score. Every document is scored on its whole text.

Models are fitted on the driver from bounded samples: ``max_labelled`` labelled and ``max_unlabelled`` other
documents, those whose ids have the least hashes; labelled ones are drawn from those that are there, each kind on
its own, in proportion but for a least share of the rarer kind (a kind of under ten is repeated); only their feature vectors are collected. Scoring is a map
without a shuffle.

Defined results: a null text scores as an empty one, null page data as a value of its own; rows of one id are
scored each; labels that are null or name no document are ignored, of several labels of an id the least holds;
without labels of both kinds every document is kept with the score 1; no documents give no rows; further
columns are ignored (``keep_good`` hands them on).
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass
from operator import eq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import release, worker

PAIRS, WORDS, LINES = 512, 10, 7
SOURCES, LANGS, SIZES = 32, 8, 24
#: Of the labelled sample at least one in so many is of the rarer kind, where there are as many.
LEAST = 20
#: Features count up to so many standard deviations, lest a short text's odd profile decides alone.
FAR = 4.0
#: Log-odds up to which one view can speak against the other.
SURE = 5.0
TEXT = slice(0, PAIRS + WORDS + LINES)
META = slice(TEXT.stop, TEXT.stop + SOURCES + LANGS + SIZES + 1)


def features(text: str | None, source: str | None, lang: str | None, n_chars: int | None):
    import numpy as np

    text = text or ""
    raw = text.encode()
    out = np.zeros(META.stop, np.float32)
    b = np.frombuffer(raw, np.uint8)
    if len(b) > 1:
        pairs = (b[:-1].astype(np.uint32) * 257 + b[1:]) * np.uint32(2654435761) >> np.uint32(23)
        out[:PAIRS] = np.log1p(np.bincount(pairs, minlength=PAIRS) * (2000.0 / len(pairs)))
    words = raw.split()
    if words:
        seen, n, by_byte = Counter(words), len(words), np.bincount(b, minlength=256)
        letters = by_byte[65:91].sum() + by_byte[97:123].sum() + by_byte[128:].sum()
        out[PAIRS : PAIRS + WORDS] = (
            len(seen) / n, np.log1p(n), max(seen.values()) / n, sum(map(eq, words, words[1:])) / n, len(raw) / n,
            by_byte[65:91].sum() / len(b), by_byte[48:58].sum() / len(b), letters / len(b),
            (by_byte[33:48].sum() + by_byte[58:65].sum() + by_byte[91:97].sum() + by_byte[123:127].sum()) / len(b),
            sum(n == 1 for n in seen.values()) / n,
        )
    lines = text.split("\n")
    n = len(text)
    lengths = np.array([len(x) for x in lines])
    out[PAIRS + WORDS : TEXT.stop] = (
        np.log1p(len(lines)), np.log1p(lengths.mean()), np.log1p(lengths.max()),
        sum(x[-1:] in ".!?" for x in lines) / len(lines), sum(x[:1].isupper() for x in lines) / len(lines), text.count(" ") / max(1, n), lengths.std() / (1 + lengths.mean()),
    )
    out[META] = page_data(source, lang, n_chars)
    return out


def page_data(source: str | None, lang: str | None, n_chars: int | None):
    """The view of the page's columns alone: hashed source and language, size by powers of two (null for itself) and by its logarithm."""
    import numpy as np

    out = np.zeros(META.stop - META.start, np.float32)
    out[zlib.crc32(repr(source).encode()) % SOURCES] = 1
    out[SOURCES + zlib.crc32(repr(lang).encode()) % LANGS] = 1
    size = 0 if n_chars is None else min(SIZES - 1, 1 + max(0, n_chars).bit_length())
    out[SOURCES + LANGS + size] = 1
    out[-1] = 0 if n_chars is None else np.log1p(max(0, n_chars))
    return out


def _fit(x, y, ridge: float = 1.0, rounds: int = 12):
    """Weights of a logistic model with a constant in front, by Newton steps; classes weigh the same."""
    import numpy as np

    x = np.c_[np.ones(len(x)), x].astype(np.float64)
    w, share = np.zeros(x.shape[1]), np.where(y > 0, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    rarer = min(max(1.0, (y > 0).sum()), max(1.0, (y == 0).sum()))
    penalty = np.full(x.shape[1], ridge * len(y) / (2 * rarer))  # evidence is what the rarer kind gives, however it is weighed
    penalty[0] = 1e-6
    for _ in range(rounds):
        p = _odds(x @ w)
        grad = x.T @ (share * (p - y)) + penalty * w
        step = np.linalg.solve((x * (share * p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty), grad)
        w -= step
        if abs(step).max() < 1e-6:
            break
    return w


def _odds(z):
    import numpy as np

    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Model:
    mean: object
    scale: object
    text: object
    meta: object
    calibrate: list  # of each view: constant and slope
    combine: object  # constant and weights of the calibrated log-odds
    held_out: dict

    def views(self, x):
        """Calibrated log-odds of either view."""
        import numpy as np

        x = np.clip((x - self.mean) / self.scale, -FAR, FAR)
        raw = [w[0] + x[:, part] @ w[1:] for w, part in ((self.text, TEXT), (self.meta, META))]
        return [np.clip(a + b * z, -SURE, SURE) for (a, b), z in zip(self.calibrate, raw, strict=True)]

    def __call__(self, x):
        """Probabilities of good quality: by text, by page data, by both."""
        a, b = self.views(x)
        return _odds(a), _odds(b), _odds(self.combine[0] + self.combine[1] * a + self.combine[2] * b)


def co_train(x, y, pool, *, rounds: int = 4, sure: float = 0.97, per_round: int = 600) -> Model:
    """``x, y``: labelled features and 0/1; ``pool``: unlabelled features. A fifth of the labelled is held out."""
    import numpy as np

    pool = pool.reshape(-1, META.stop)
    mean, scale = x.mean(0, dtype=np.float64).astype(np.float32), (x.std(0, dtype=np.float64) + 1e-3).astype(np.float32)
    z, free = (np.clip((v - mean) / scale, -FAR, FAR) for v in (x, pool))
    order = np.random.default_rng(7).permutation(len(y))
    held = np.zeros(len(y), bool)
    for k in (0, 1):
        held[order[y[order] == k][::5]] = True
    sets = {0: [z[~held], y[~held]], 1: [z[~held], y[~held]]}
    parts, waiting = (TEXT, META), [np.ones(len(free), bool), np.ones(len(free), bool)]
    weights = [_fit(sets[v][0][:, parts[v]], sets[v][1]) for v in (0, 1)]
    good = y[~held].mean()
    for _ in range(rounds if len(free) else 0):
        for v in (0, 1):
            p = _odds(weights[v][0] + free[:, parts[v]] @ weights[v][1:])
            for k, share in ((1, good), (0, 1 - good)):
                trust = p if k else 1 - p
                pick = np.flatnonzero(waiting[1 - v] & (trust >= sure))
                pick = pick[np.argsort(-trust[pick], kind="stable")][: int(per_round * share)]
                waiting[1 - v][pick] = False
                sets[1 - v][0] = np.r_[sets[1 - v][0], free[pick]]
                sets[1 - v][1] = np.r_[sets[1 - v][1], np.full(len(pick), k)]
        weights = [_fit(sets[v][0][:, parts[v]], sets[v][1]) for v in (0, 1)]
    raw = [weights[v][0] + z[held][:, parts[v]] @ weights[v][1:] for v in (0, 1)]
    calibrate = [tuple(_fit(r[:, None], y[held], 0.01)) for r in raw]
    both = np.stack([np.clip(a + b * r, -SURE, SURE) for (a, b), r in zip(calibrate, raw, strict=True)], 1)
    combine = _fit(both, y[held], 0.1)
    p = _odds(combine[0] + both @ combine[1:])
    found = {"rows": int(held.sum()), "accuracy": float(((p >= 0.5) == y[held]).mean()), "good_kept": float((p[y[held] == 1] >= 0.5).mean()), "pseudo": [len(sets[v][1]) - int((~held).sum()) for v in (0, 1)]}
    return Model(mean, scale, weights[0], weights[1], calibrate, combine, found)


def _columns(docs: DataFrame) -> list:
    """Id, text and page data; columns that are missing count as null."""
    kinds = {"source": "string", "lang": "string", "n_chars": "long"}
    return ["doc_id", "text", *[F.col(c).cast(k).alias(c) if c in docs.columns else F.lit(None).cast(k).alias(c) for c, k in kinds.items()]]


def _matrix(batch):
    import numpy as np

    rows = zip(*(batch[c].to_pylist() for c in ("text", "source", "lang", "n_chars")), strict=True)
    return np.stack([features(*r) for r in rows]) if batch.num_rows else np.zeros((0, META.stop), np.float32)


def fit_quality(docs: DataFrame, labels: DataFrame, *, max_labelled: int = 5000, max_unlabelled: int = 4000, **how) -> Model | None:
    """A model from bounded samples, or None where there is no labelled document of one kind."""
    import numpy as np

    by_hash = F.xxhash64(F.lit("sample"), F.col("doc_id"))
    known = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("y")).withColumn("k", by_hash)
    known = known.join(docs.select("doc_id"), "doc_id", "left_semi")
    sizes = {r["good"]: r["count"] for r in known.groupBy((F.col("y") > 0).alias("good")).count().collect()}
    if len(sizes) < 2:
        return None
    rare = min(sizes, key=sizes.get)
    few = min(sizes[rare], max(max_labelled * sizes[rare] // sum(sizes.values()), max_labelled // LEAST))
    one = lambda good, most: known.filter((F.col("y") > 0) == good).orderBy("k", "doc_id").limit(most)
    known = one(rare, few).unionByName(one(not rare, max_labelled - few))
    other = docs.filter("doc_id is not null").select("doc_id", by_hash.alias("k")).distinct().orderBy("k", "doc_id").limit(max_labelled + max_unlabelled)
    ids = known.select("doc_id", "y").unionByName(other.select("doc_id", F.lit(None).cast("int").alias("y"))).groupBy("doc_id").agg(F.max("y").alias("y"))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["y"], pa.array([x.astype(np.float16).tobytes() for x in _matrix(b)], pa.binary())], ["doc_id", "y", "x"])

    rows = docs.select(*_columns(docs)).join(F.broadcast(ids), "doc_id").mapInArrow(worker(run), "doc_id long, y int, x binary").toArrow()  # samples' vectors only
    rows = rows.sort_by("doc_id")
    x = np.frombuffer(b"".join(rows["x"].to_pylist()), np.float16).reshape(-1, META.stop).astype(np.float32)
    y = np.array([-1 if v is None else v for v in rows["y"].to_pylist()])
    for k in (y > 0, y == 0):
        times = -(-10 // int(k.sum()))
        x, y = np.r_[x, np.tile(x[k], (times - 1, 1))], np.r_[y, np.tile(y[k], times - 1)]
    model = co_train(x[y >= 0], (y[y >= 0] > 0).astype(float), x[y < 0][:max_unlabelled], **how)
    del rows, x
    release()
    return model


def quality(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.5, model: Model | None = None, **how) -> DataFrame:
    """Per document: ``doc_id, p_text, p_meta, score, keep``."""
    model = model or fit_quality(docs, labels, **how)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                p = model(_matrix(part)) if model else [np.ones(part.num_rows)] * 3
                yield pa.RecordBatch.from_arrays([part["doc_id"], *[pa.array(np.round(x, 6)) for x in p], pa.array(np.round(p[2], 6) >= threshold)], ["doc_id", "p_text", "p_meta", "score", "keep"])

    return docs.select(*_columns(docs)).mapInArrow(worker(run), "doc_id long, p_text double, p_meta double, score double, keep boolean")


def keep_good(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.5, model: Model | None = None, **how) -> DataFrame:
    """``docs`` without the documents that the classifier rejects."""
    model = model or fit_quality(docs, labels, **how)
    if model is None:
        return docs

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            rows = pa.Table.from_batches([b])
            for c, kind in (("source", pa.string()), ("lang", pa.string()), ("n_chars", pa.int64())):
                if c not in rows.column_names:
                    rows = rows.append_column(c, pa.nulls(b.num_rows, kind))
            keep = [np.round(model(_matrix(rows.slice(at, 512)))[2], 6) >= threshold for at in range(0, b.num_rows, 512)]
            if keep:
                yield b.filter(pa.array(np.concatenate(keep)))

    return docs.mapInArrow(worker(run), docs.schema)
