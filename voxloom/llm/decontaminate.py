"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, native throughout.

Words are runs of digits, letters and everything beyond ASCII, after A-Z is lower-cased. An item's windows are
its ``n`` consecutive words; an item of fewer is one window. Scanning every window of every document would
build a string per word, so the scan probes grams of ``k`` words at every ``m``-th word only, with
``m + k - 1`` = window length: each window that starts in ``(i - m, i]`` holds the probe at ``i`` whole, so no
window goes unprobed and each belongs to one probe. A probe that is in the set brings its neighbourhood of
words along, and its ``m`` windows are verified by comparing the whole text of the window.

The set is broadcast in blocks of at most ``block_rows`` grams or windows (so a set of any size is scanned in
several passes, each with a bounded broadcast); nothing of the documents is shuffled but hits.

Defined results: null or empty texts have no words and no hits; a null id stays null and counts as one
document; repeated rows give repeated result rows with the same counts; items with no words have no window;
equal items each count as an item; an empty benchmark leaves every document clean. Items with a null id are ignored by
``decontaminate``, as in its SQL; ``remove_leaks`` takes their passages out like any other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Workspace, ascii_lower, doc_id, names_of, null_id

#: What is between words, in lower-cased text.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same in text as it is, and a word.
RAW_GAP, RAW_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text; a null or blank one has none."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAP), lambda w: w != "")


def probe_plan(length: int) -> tuple[int, int]:
    """Words in a probe and words between probes, for windows of that length."""
    k = (length + 1) // 2
    return k, length - k + 1


def item_windows(benchmark: DataFrame, n: int, unnamed: bool = False) -> DataFrame:
    """``item_id, len, win``: every window of every item, space-joined."""
    w = F.col("w")
    length = F.least(F.size(w), F.lit(n))
    return (
        benchmark.filter(F.lit(unnamed) | F.col("item_id").isNotNull())
        .select("item_id", words(F.col("text")).alias("w"))
        .filter(F.size("w") > 0)
        .select("item_id", length.alias("len"), F.explode(F.transform(F.sequence(F.lit(1), F.size(w) - length + 1), lambda i: F.array_join(F.slice(w, i, length), " "))).alias("win"))
        .distinct()
    )


def _probes(length: int) -> Column:
    """Structs of the window length, the place (from 0) and the hash of each probe of ``w``."""
    k, m = probe_plan(length)
    w = F.col("w")
    there = F.transform(
        F.sequence(F.lit(0), F.size(w) - k, F.lit(m)),
        lambda i: F.struct(F.lit(length).alias("len"), i.alias("i"), F.xxhash64(F.lit(length), F.slice(w, i + 1, k)).alias("h")),
    )
    return F.when(F.size(w) >= length, there).otherwise(F.expr("cast(array() as array<struct<len:int,i:int,h:bigint>>)"))


def _grams(length: int) -> Column:
    """Hashes of all grams of a window that a probe can meet."""
    k, m = probe_plan(length)
    return F.transform(F.sequence(F.lit(1), F.lit(m)), lambda i: F.xxhash64(F.lit(length), F.slice(F.split("win", " "), i, k)))


def _blocks(rows: DataFrame, key: Column, count: int, block_rows: int) -> list[DataFrame]:
    n = max(1, -(-count // block_rows))
    return [rows.filter(F.pmod(key, F.lit(n)) == b) if n > 1 else rows for b in range(n)]


def hits(docs: DataFrame, benchmark: DataFrame, work: Workspace, *, n: int = 13, block_rows: int = 200_000, unnamed: bool = False) -> tuple[DataFrame, DataFrame]:
    """``id, th, start, len, win`` of every window of an item in a document, and the windows' items."""
    windows = work.keep(item_windows(benchmark, n, unnamed), "windows")
    lengths = {r["len"]: r["count"] for r in windows.groupBy("len").count().collect()}  # n rows at most
    text = F.coalesce(F.col("text"), F.lit(""))
    if not lengths:
        empty = docs.select(doc_id().alias("id"), F.xxhash64(text).alias("th"), F.lit(0).alias("start"), F.lit(0).alias("len"), F.lit("").alias("win")).limit(0)
        return empty, windows
    at, k_of = F.col("p.i"), {length: probe_plan(length) for length in lengths}
    grams = None
    for length in k_of:
        one = windows.filter(F.col("len") == length).select(F.explode(_grams(length)).alias("gram"))
        grams = one if grams is None else grams.unionByName(one)
    grams = work.keep(grams.distinct(), "grams")
    base = docs.select(doc_id().alias("id"), F.xxhash64(text).alias("th"), words(F.col("text")).alias("w"))
    probes = base.select("id", "th", "w", F.explode(reduce(F.concat, [_probes(x) for x in sorted(lengths)])).alias("p"))
    step = reduce(lambda c, x: c.when(F.col("p.len") == x, k_of[x][1]), list(k_of)[1:], F.when(F.col("p.len") == list(k_of)[0], k_of[list(k_of)[0]][1]))
    near = []
    for block in _blocks(grams, F.col("gram"), grams.count(), block_rows):
        found = probes.join(F.broadcast(block), F.col("p.h") == F.col("gram"))
        first = F.greatest(at - step + 1, F.lit(0))
        near.append(found.select("id", "th", F.col("p.len").alias("len"), at.alias("i"), first.alias("first"), F.slice("w", first + 1, at - first + F.col("p.len")).alias("w")))
    near = work.keep(reduce(DataFrame.unionByName, near), "near")
    spans = near.select("id", "th", "len", "first", "w", F.explode(F.sequence(F.lit(0), F.col("i") - F.col("first"))).alias("o")).filter(F.col("o") + F.col("len") <= F.size("w"))
    spans = spans.select("id", "th", "len", (F.col("first") + F.col("o")).alias("start"), F.array_join(F.slice("w", F.col("o") + 1, F.col("len")), " ").alias("win"))
    texts = windows.select("len", "win").distinct()
    blocks = _blocks(texts, F.xxhash64("win"), sum(lengths.values()), block_rows)
    verified = reduce(DataFrame.unionByName, [spans.join(F.broadcast(b), ["len", "win"]) for b in blocks])
    return work.keep(verified.select("id", "th", "start", "len", "win").distinct(), "hits"), windows


def contamination(docs: DataFrame, benchmark: DataFrame, work: Workspace, *, n: int = 13, block_rows: int = 200_000, unnamed: bool = False) -> tuple[DataFrame, DataFrame]:
    """Per document with a hit ``id, th, n_hit, n_items, items``; and its hit words as spans ``id, th, start, stop``."""
    found, windows = hits(docs, benchmark, work, n=n, block_rows=block_rows, unnamed=unnamed)
    order = Window.partitionBy("id", "th").orderBy("start", "len").rowsBetween(Window.unboundedPreceding, -1)
    spans = found.select("id", "th", "start", "len").distinct().withColumn("stop", F.col("start") + F.col("len"))
    spans = spans.withColumn("done", F.coalesce(F.max("stop").over(order), F.lit(0)))
    spans = spans.select("id", "th", F.greatest("start", "done").alias("start"), "stop").filter(F.col("stop") > F.col("start"))
    n_hit = spans.groupBy("id", "th").agg(F.sum(F.col("stop") - F.col("start")).alias("n_hit"))
    hit = work.keep(found.select("id", "th", "len", "win").distinct(), "hit-windows")
    # in blocks of a bounded size, so a window that many documents have is not one task's
    blocks = _blocks(windows, F.xxhash64("item_id", "win"), windows.count(), block_rows)
    named = reduce(DataFrame.unionByName, [hit.join(F.broadcast(b), ["len", "win"]).select("id", "th", "item_id") for b in blocks])
    items = named.groupBy("id", "th").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    return n_hit.join(items, ["id", "th"]), spans


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, n: int = 13, share: int = 20, block_rows: int = 200_000) -> DataFrame:
    """Per document: ``doc_id, n_words, n_hit, items`` and ``contaminated``: at least one word in ``share`` is hit."""
    work = Workspace(docs.sparkSession, "decontaminate")
    docs = docs.select("doc_id", "text")
    per_doc, _ = contamination(docs, benchmark, work, n=n, block_rows=block_rows)
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.select(doc_id().alias("id"), F.xxhash64(text).alias("th"), F.size(words(F.col("text"))).cast("long").alias("n_words")).join(per_doc, ["id", "th"], "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(
        null_id(F.col("id")).alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def remove_leaks(docs: DataFrame, benchmark: DataFrame, *, n: int = 13, share: int = 20, block_rows: int = 200_000) -> DataFrame:
    """``docs`` without its contaminated documents; from the others, hit words are cut out.

    A cut takes the gaps between the words of a run with it. All columns stay as they are, but for ``text``
    and, where there is one, ``n_chars`` of a document that was cut.
    """
    work = Workspace(docs.sparkSession, "decontaminate")
    per_doc, spans = contamination(docs.select("doc_id", "text"), benchmark, work, n=n, block_rows=block_rows, unnamed=True)
    cut = spans.groupBy("id", "th").agg(F.array_distinct(F.flatten(F.collect_list(F.sequence("start", F.col("stop") - 1)))).alias("hit"))
    cut = cut.join(per_doc.select("id", "th", "n_hit"), ["id", "th"])
    # a row is one struct here, so its columns meet none of these names
    rows = docs.select(F.struct(*names_of(docs)).alias("row"), doc_id().alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th")).join(cut, ["id", "th"], "left")
    changed, text = F.col("hit").isNotNull(), F.col("row.text")
    none = F.expr("cast(null as array<string>)")
    rows = rows.select("row", "hit", "n_hit", F.when(changed, F.regexp_extract_all(text, F.lit(RAW_WORD), F.lit(0))).otherwise(none).alias("w"), F.when(changed, _gaps(text)).otherwise(none).alias("g"))
    rows = rows.filter(~changed | (share * F.col("n_hit") < F.size("w")))
    rows = rows.withColumn("stay", F.array_except(F.sequence(F.lit(0), F.size("w") - 1), "hit"))
    cut_text = F.concat(F.col("g")[0], F.array_join(F.transform("stay", lambda i: F.concat(F.col("w")[i], F.col("g")[i + 1])), ""))
    out = []
    for name, column in zip(docs.columns, names_of(docs), strict=True):
        now = F.col(f"row.{column}")
        if name == "text":
            now = F.when(changed, cut_text).otherwise(now)
        elif name == "n_chars":
            now = F.when(changed, F.length(cut_text)).otherwise(now).cast(docs.schema[name].dataType)
        out.append(now.alias(name))
    return rows.select(*out)


def _gaps(text: Column) -> Column:
    """What stands before the first word, between words and after the last: one more than there are words."""
    return F.split(text, RAW_WORD)
