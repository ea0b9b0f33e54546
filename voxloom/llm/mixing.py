"""Mixing sources to target weights by temperature.

A source's weight is its share of tokens to the power ``alpha`` (1: as the corpus is, 0: all alike), scaled to
sum to one. ``alpha`` is bisected until the weights' entropy is ``target_entropy``, or until no source is
repeated more than ``max_repeats`` times, both if both are given (the larger ``alpha`` holds). The budget is
``budget`` tokens; by default the least with which every document appears at least once.

A source's part of the budget is that many passes over it. Its documents are dealt to ``blocks`` blocks by a
hash of the document; each pass takes the blocks in a permutation of its own, and within a block the documents
in one. The last pass ends with the last document that still fits the budget. Only sums by (source, block) and
the documents of each source's one block at the cut are sorted; then whether a document belongs to a pass is
decided row by row against its source's cut, with no shuffle of texts. A source of any size is thus spread over
all tasks. The table of sources is broadcast only if it has at most ``broadcast_rows`` rows.

Tokens are runs of text without ASCII white space. Defined results: a null source is the source named '' (as
long as the hash sees no difference); null or blank texts have no tokens and come with every whole pass, a
source of such texts has one pass; repeated rows are in or out together; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Workspace, doc_id, names_of, null_id

SEED = 2024


def n_tokens(text: Column) -> Column:
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, r"[ \t\n\x0B\f\r]+"))).cast("long")


def bisect(below: Callable[[float], bool], low: float = 0.0, high: float = 1.0, steps: int = 40) -> float:
    """The least place in ``[low, high]`` from which ``below`` holds, given that it stays so."""
    if below(low):
        return low
    for _ in range(steps):
        mid = (low + high) / 2
        low, high = (low, mid) if below(mid) else (mid, high)
    return high


def choose_alpha(moments: Callable[[float], tuple[float, float]], least: float, most: float, *, target_entropy: float | None, max_repeats: float | None, budget: float | None) -> float:
    """``moments(a)``: sums over sources of ``t^a`` and of ``t^a ln t``, for their tokens ``t``, ``least`` to ``most``."""

    def entropy(a: float) -> float:
        z, s = moments(a)
        return math.log(z) - a * s / z

    def repeats(a: float) -> float:  # of the smallest source, which is repeated most
        return (most / least) ** (1 - a) if budget is None else budget * least ** (a - 1) / moments(a)[0]

    alpha = 0.0
    if target_entropy is not None:
        alpha = max(alpha, bisect(lambda a: entropy(a) <= target_entropy))
    if max_repeats is not None:
        alpha = max(alpha, bisect(lambda a: repeats(a) <= max_repeats + 1e-9))
    return alpha


def _key(docs_id: Column, th: Column) -> tuple[Callable, Callable]:
    rank = lambda p, s, b: F.xxhash64(F.lit(SEED), F.lit("block"), p.cast("int"), s, b.cast("int"))
    place = lambda p: F.xxhash64(F.lit(SEED), F.lit("place"), p.cast("int"), docs_id, th)
    return rank, place


def mix_plan(docs: DataFrame, work: Workspace, *, target_entropy=None, max_repeats=1.5, budget=None, blocks: int = 4096, broadcast_rows: int = 65_536) -> tuple[DataFrame, DataFrame, int]:
    """Documents' sizes; and by source ``weight, passes`` (whole ones) and the cut ``cut_rank, cut_place`` of one more."""
    text = F.coalesce("text", F.lit(""))
    sizes = docs.select(doc_id().alias("id"), F.xxhash64(text).alias("th"), F.coalesce("source", F.lit("")).alias("s"), n_tokens(F.col("text")).alias("t"))
    sizes = work.keep(sizes.withColumn("block", F.pmod(F.xxhash64("id", "th"), F.lit(blocks)).cast("int")), "sizes")
    sources = work.keep(sizes.groupBy("s").agg(F.sum("t").alias("total")), "sources")
    some = sources.filter("total > 0")
    n, least, most, everything = some.agg(F.count("*"), F.min("total"), F.max("total"), F.sum("total")).first()
    n_sources = sources.count()
    if not n:
        plan = sources.select("s", F.lit(0.0).alias("weight"), F.lit(1).alias("passes"), F.lit(None).cast("long").alias("cut_rank"), F.lit(None).cast("long").alias("cut_place"))
        return sizes, plan, n_sources
    if n <= broadcast_rows:
        totals = [float(r["total"]) for r in some.select("total").collect()]  # bounded just above

        def moments(a: float) -> tuple[float, float]:
            powers = [t**a for t in totals]
            return math.fsum(powers), math.fsum(p * math.log(t) for p, t in zip(powers, totals, strict=True))
    else:

        def moments(a: float) -> tuple[float, float]:
            p = F.pow(F.col("total").cast("double"), F.lit(a))
            return tuple(some.agg(F.sum(p), F.sum(p * F.log("total"))).first())

    alpha = choose_alpha(moments, least, most, target_entropy=target_entropy, max_repeats=max_repeats, budget=budget)
    z = moments(alpha)[0]
    whole = budget if budget is not None else most ** (1 - alpha) * z
    weight = F.when(F.col("total") > 0, F.pow(F.col("total").cast("double"), F.lit(alpha)) / z).otherwise(0.0)
    runs = F.when(F.col("total") > 0, F.col("weight") * whole / F.col("total") + 1e-9).otherwise(1.0)
    plan = sources.withColumn("weight", weight).withColumn("runs", runs).withColumn("passes", F.floor("runs").cast("int"))
    plan = plan.withColumn("part", F.greatest(F.lit(0), F.floor((F.col("runs") - F.col("passes")) * F.col("total"))).cast("long"))
    plan = work.keep(plan, "plan")
    rank, place = _key(F.col("id"), F.col("th"))
    sums = sizes.groupBy("s", "block").agg(F.sum("t").alias("t")).join(plan.select("s", "passes", "part"), "s")
    sums = sums.withColumn("rank", rank(F.col("passes"), F.col("s"), F.col("block")))
    before = Window.partitionBy("s").orderBy("rank", "block").rowsBetween(Window.unboundedPreceding, -1)  # of ``blocks`` rows
    sums = sums.withColumn("before", F.coalesce(F.sum("t").over(before), F.lit(0)))
    at = sums.filter("before <= part and before + t > part").select("s", "block", "rank", "before", "passes", "part")
    inner = sizes.join(at, ["s", "block"]).withColumn("place", place(F.col("passes")))
    upto = Window.partitionBy("s").orderBy("place").rangeBetween(Window.unboundedPreceding, 0)  # repeated rows stay together
    fits = inner.withColumn("upto", F.sum("t").over(upto)).filter("before + upto <= part").groupBy("s").agg(F.max("place").alias("cut_place"))
    cuts = at.select("s", F.col("rank").alias("cut_rank")).join(fits, "s", "left")
    return sizes, work.keep(plan.join(cuts, "s", "left").select("s", "weight", "passes", "cut_rank", "cut_place"), "cuts"), n_sources


def _copies(block: Column, ident: Column, th: Column) -> Column:
    """Numbers of the passes a row belongs to. With no cut, the part of a pass was the whole of it or nothing."""
    rank, place = _key(ident, th)
    p, mine = F.col("passes"), rank(F.col("passes"), F.col("s"), block)
    last = (mine < F.col("cut_rank")) | ((mine == F.col("cut_rank")) & (place(p) <= F.col("cut_place")))
    n = p + F.when(last, 1).otherwise(0)
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.expr("cast(array() as array<int>)"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """A row for each document and pass: ``doc_id, source, pass, block, block_rank, place, n_tokens, weight``.

    Order a pass by ``block_rank, block, place``.
    """
    work = Workspace(docs.sparkSession, "mix")
    sizes, plan, n = mix_plan(docs, work, **how)
    plan = F.broadcast(plan) if n <= how.get("broadcast_rows", 65_536) else plan
    rows = sizes.join(plan, "s").withColumn("pass", F.explode(_copies(F.col("block"), F.col("id"), F.col("th"))))
    rank, place = _key(F.col("id"), F.col("th"))
    return rows.select(
        null_id(F.col("id")).alias("doc_id"), F.col("s").alias("source"), "pass", "block", rank(F.col("pass"), F.col("s"), F.col("block")).alias("block_rank"),
        place(F.col("pass")).alias("place"), F.col("t").alias("n_tokens"), "weight",
    )


def mixed_documents(docs: DataFrame, *, blocks: int = 4096, broadcast_rows: int = 65_536, **how) -> DataFrame:
    """``docs`` with each row as often as the mix has it."""
    work = Workspace(docs.sparkSession, "mix")
    _, plan, n = mix_plan(docs, work, blocks=blocks, broadcast_rows=broadcast_rows, **how)
    plan = F.broadcast(plan) if n <= broadcast_rows else plan
    ident, th = doc_id(), F.xxhash64(F.coalesce("text", F.lit("")))
    rows = docs.select(F.struct(*names_of(docs)).alias("row"), ident.alias("id"), th.alias("th"), F.coalesce("source", F.lit("")).alias("s"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id", "th"), F.lit(blocks)).cast("int")).join(plan, "s")
    return rows.select("row", F.explode(_copies(F.col("block"), F.col("id"), F.col("th"))).alias("pass")).select("row.*")
