from collections import Counter

import corpus_pipeline
import pytest
from helpers import SCHEMA, awkward_rows, docs, prose
from pyspark.sql import functions as F
from test_text_operators import exact_brute, join_brute


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    import random

    rng = random.Random(3)
    path = str(tmp_path_factory.mktemp("sf"))
    junk = [(500 + i, " ".join(w + "!!" for w in prose(rng, 40).upper().split()), "en", "s", 9) for i in range(60)]
    fine = [(600 + i, prose(rng, 60), "en", "s", 9) for i in range(120)]
    rows = awkward_rows() + junk + fine
    docs(spark, rows).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(r[0], int(r[0] >= 600), 0) for r in junk + fine], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stage_names_and_columns(spark, sf):
    src = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, src, sf).columns == src.columns, name


def test_quality_stage_drops_junk_and_keeps_prose(spark, sf):
    kept = {r["doc_id"] for r in corpus_pipeline.quality(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf).collect()}
    assert sum(500 + i in kept for i in range(60)) <= 2 and sum(600 + i in kept for i in range(120)) >= 117


def test_near_stage_keeps_one_of_each_group(spark, sf):
    rows = awkward_rows()
    want = Counter(d for d, _, c in join_brute(rows, 5, 80, 100) if d is None or d == c)
    assert Counter(r["doc_id"] for r in corpus_pipeline.near(spark, docs(spark, rows), sf).collect()) == want


def test_exact_stage(spark, sf):
    out = corpus_pipeline.exact(spark, docs(spark), sf).collect()
    assert len(out) == len({x[4] for x in exact_brute(awkward_rows())})


def test_run_packs_what_the_stages_keep(spark, sf):
    out = corpus_pipeline.run(spark, sf).collect()
    step = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        step = stage(spark, step, sf)
    assert {r["doc_id"] for r in out} == {r["doc_id"] for r in step.collect()}
    assert all(1 <= r["length"] <= 2048 and r["offset"] + r["length"] <= 2048 for r in out)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_take_an_empty_table(spark, sf, name, stage):
    assert stage(spark, spark.createDataFrame([], SCHEMA), sf).count() == 0


def test_passages_stage_cuts_what_repeats(spark, sf):
    rows = [r for r in awkward_rows() if r[1] is None or r[1].isascii()]
    texts = Counter((r[1] or "")[i : i + 250] for r in rows for i in range(len(r[1] or "") - 249))
    want = []
    for r in rows:
        gone = [False] * len(r[1] or "")
        for i in range(len(gone) - 249):
            if texts[r[1][i : i + 250]] > 1:
                gone[i : i + 250] = [True] * 250
        want.append((r[0], None if r[1] is None else "".join(c for c, g in zip(r[1], gone) if not g)))
    out = corpus_pipeline.passages(spark, docs(spark, rows), sf)
    assert Counter((r["doc_id"], r["text"]) for r in out.collect()) == Counter(want)


def test_quality_stage_keeps_what_the_model_scores(spark, sf):
    from sparkloom.llm import quality_fm

    src = spark.read.parquet(f"{sf}/documents.parquet")
    scores = quality_fm.score(src, quality_fm.train(src, spark.read.parquet(f"{sf}/labels.parquet"), buckets=1, held=-1)).collect()
    want = Counter(r["doc_id"] for r in scores if r["score"] >= 0.5)
    assert Counter(r["doc_id"] for r in corpus_pipeline.quality(spark, src, sf).collect()) == want


RESERVED = "__id __key __ranges __text __k __kept __n_bytes __n_removed __n_spans __sha __sha2 __n_chars _gone _id _key _ranges _text _k kept_bytes n_bytes n_removed n_spans _sha _sha_of _n_chars _row _group _hot _salt n digest norm key".split()


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:-1])
def test_stages_keep_columns_of_any_name(spark, sf, name, stage):
    src = docs(spark)
    plain = Counter(tuple(r) for r in stage(spark, src, sf).collect())
    extra = src.select("*", *(F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(c) for c in RESERVED))
    out = stage(spark, extra, sf)
    assert out.columns == extra.columns
    rows = out.collect()
    assert Counter(tuple(r)[: len(src.columns)] for r in rows) == plain
    assert all(r[c] == f"{c}:{'-' if r['doc_id'] is None else r['doc_id']}" for r in rows for c in RESERVED)
