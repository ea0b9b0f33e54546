import os
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from voxloom.llm import cotraining, decontaminate, mixing, simhash
from voxloom.llm.shared import Workspace, read_table

SF = "/root/testdata/sf0.001"


def test_queries_are_registered():
    found = __spark_entry__.queries()
    assert "pipeline" in found
    for n in range(1, 11):
        assert sum(k.startswith(f"op{n}_") for k in found) == 1
    assert set(__spark_entry__.oracle_sql()) <= set(found)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontaminate", "mix", "token_files"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_each_stage_does_what_its_operator_says(spark):
    docs = read_table(spark, SF, "documents")
    work, columns = Workspace(spark, "t"), docs.columns
    now, kept = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = work.keep(stage(spark, now, SF), name)
        assert now.columns == columns
        kept.append(now)
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    quality = cotraining.quality(docs, read_table(spark, SF, "labels")).filter("keep")
    assert ids(kept[0]) == ids(quality)
    groups = simhash.simhash_groups(kept[0]).filter("doc_id = component_id")
    assert ids(kept[1]) == ids(groups)
    leaks = decontaminate.decontaminate(kept[1], read_table(spark, SF, "benchmark"))
    assert ids(kept[2]) == ids(leaks.filter("not contaminated"))
    assert decontaminate.decontaminate(kept[2], read_table(spark, SF, "benchmark")).filter("n_hit > 0").count() == 0
    assert ids(kept[3]) == ids(kept[2])
    assert kept[3].count() == mixing.mix(kept[2]).count()
    out = corpus_pipeline.run(spark, SF)
    assert out.count() == kept[3].count()
    assert out.agg(F.max(F.col("start") + F.col("n_tokens"))).first()[0] == out.agg(F.sum("n_tokens")).first()[0]


KINDS = "doc_id long, text string, lang string, source string, n_chars long, score string, block int, th long"


@pytest.mark.parametrize("empty", [False, True])
def test_stages_on_hostile_and_empty_tables(spark, rows, tmp_path, empty):
    rng = random.Random(1)
    junk = [(500 + i, " ".join(["AB!!"] * rng.randint(9, 40)), "x", "web", 1, None, 0, 0) for i in range(30)]
    plain = [(i, t, rng.choice(["en", None]), rng.choice(["web", "a", None]), rng.choice([None, 5]), "s", 1, 2) for i, t in rows]
    labels = [(i, 1, 0) for i in range(0, 40)] + [(500 + i, 0, 0) for i in range(15)] + [(None, None, None), (3, None, 1)]
    bench = [(1, rows[2][1]), (2, None), (None, "x"), (3, "")]
    for name, data, kinds in (("documents", plain + junk, KINDS), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", bench, "item_id long, text string")):
        spark.createDataFrame([] if empty else data, kinds).repartition(2).write.parquet(f"{tmp_path}/{name}.parquet")
    work, now = Workspace(spark, "t"), read_table(spark, str(tmp_path), "documents")
    columns, sizes = now.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = work.keep(stage(spark, now, str(tmp_path)), name)
        assert now.columns == columns
        sizes.append(now.count())
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(out) == sizes[3] and (sizes == [0] * 4) == empty
    if not empty:
        assert sizes[0] < len(plain + junk) and sizes[1] < sizes[0] and sizes[2] < sizes[1] <= sizes[3] + 5
        assert 2 not in {r["doc_id"] for r in out}
