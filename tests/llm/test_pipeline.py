"""Each stage on its own input, and all of them."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

pytest.importorskip("public_tokenizers")


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counts = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialise(stage(spark, docs, sf_dir), f"test-{name}", keep=True)
        assert docs.columns == corpus_pipeline.COLUMNS
        counts.append(docs.count())
    assert sorted(counts, reverse=True) == counts and counts[1] == counts[2] > counts[3] > 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert packed.select("doc_id").distinct().count() == counts[-1]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def odd(spark, texts):
    return spark.createDataFrame([(d, t, "en", None, None if t is None else len(t)) for d, t in texts], SCHEMA).withColumn("row", F.lit("clash"))


def test_stages_on_nothing(spark, sf_dir):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.createDataFrame([], SCHEMA), sf_dir).count() == 0


def test_rows_of_one_id_or_none_are_documents_of_their_own(spark, sf_dir):
    said = " ".join(f"tale{k}" for k in range(80))
    other = " ".join(f"story{k}" for k in range(80))
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").where("length(text) > 80").first().text
    kept = corpus_pipeline.drop_near_copies(spark, odd(spark, [(5, said), (5, other), (None, said), (None, said + " more"), (9, other), (10, None), (11, None), (12, "")]), sf_dir).collect()
    assert sorted(r.text or "" for r in kept) == ["", "", "", other, said]
    clean = corpus_pipeline.drop_contaminated(spark, odd(spark, [(5, said), (5, f"{said} {benchmark}"), (None, benchmark), (None, other), (10, None)]), sf_dir).collect()
    assert sorted(r.text or "" for r in clean) == ["", other, said]
    cut = corpus_pipeline.cut_repeats(spark, odd(spark, [(None, f"begin {said}"), (None, f"start {said}"), (5, other), (5, None)]), sf_dir).collect()
    assert sorted((r.text or "")[:6] for r in cut) == ["", "begin", "start", "story0"] and all("tale40" not in (r.text or "") for r in cut)


def test_a_stage_leaves_others_tables_alone(spark, sf_dir):
    from orrerium.llm.queries import queries

    waiting = queries()["op6_warc_revisits"](spark, sf_dir)
    corpus_pipeline.run(spark, sf_dir)
    assert waiting.count() > 0


def test_passages_of_over_50_words_are_cut(spark, sf_dir):
    said = " ".join(f"{chr(97 + k % 26)}{k:04d}" for k in range(54))
    own = [" ".join(f"{d}word{k}" for k in range(60)) for d in "xyz"]
    rows = [(1, f"{own[0]} {said} {own[0][::-1]}"), (2, f"{own[1]} {said} {own[1][::-1]}"), (3, own[2])]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in corpus_pipeline.cut_repeats(spark, docs, sf_dir).collect()}
    assert len(said) < 330 and "a0026" not in got[1].text + got[2].text
    assert got[1].text.startswith(own[0][:-6]) and got[1].text.endswith(own[0][::-1][6:]) and got[3].text == own[2]
    assert all(r.n_chars == len(r.text) for r in got.values())
