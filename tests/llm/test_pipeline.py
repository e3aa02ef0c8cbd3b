"""The pipeline's stages one after the other on a small table."""

import random

import corpus_pipeline
from arbormetric.llm import language, near, packing
from arbormetric.llm.tables import scratch_folder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_pipeline(spark):
    rng = random.Random(11)
    of = {"en": ["the", "and", "house", "with", "water", "over"], "de": ["der", "und", "haus", "mit", "wasser"]}
    text = lambda lang, n: " ".join(rng.choice(of[lang]) + rng.choice(["", "s", "ing", "er", "en"]) for _ in range(n))
    rows = [(i, text(lang := "en" if i % 3 else "de", 80) + ". Shared line\n" + text(lang, 30), lang, f"s{i % 4}", 1) for i in range(24)]
    rows += [(40, rows[3][1], "de", "s1", 1), (41, rows[4][1].replace("the", "then", 1), "en", "s2", 1), (42, "жизнь и вода " * 40, None, None, None), (44, None, "en", None, None), (43, "write to me a@b.cd " + text("en", 20), "en", "s1", 1)]
    folder = scratch_folder(spark)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, {}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{folder}/{n}")
        docs = spark.read.parquet(f"{folder}/{n}")
        kept[name] = docs
        if n < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    ids = {name: {r.doc_id for r in frame.select("doc_id").distinct().collect()} for name, frame in kept.items()}
    assert set(range(24)) <= ids["language_id"] and 42 not in ids["language_id"]
    assert 40 not in ids["line_dedup"] and set(range(24)) <= ids["near_dedup"]
    assert ids["personal_data"] == ids["near_dedup"] == ids["best_fit_packing"]
    assert "[EMAIL]" in kept["personal_data"].filter("doc_id = 43").first().text
    assert sorted(map(tuple, corpus_pipeline.run(spark, folder).select("doc_id", "piece", "ids_crc32").collect())) == sorted(
        map(tuple, docs.select("doc_id", "piece", "ids_crc32").collect()))


def test_python_stages_hand_over_few_rows(spark, monkeypatch):
    """No stage hands Python thousands of whole texts at once, which the buffers of both sides would hold."""
    rows = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    docs = spark.createDataFrame([(1, "the house and the water", "en", "s", 1)], SCHEMA)
    for module, stage in ((language, corpus_pipeline.language_id), (near, corpus_pipeline.near_dedup), (packing, corpus_pipeline.best_fit_packing)):
        held, stored = [], module.stored
        monkeypatch.setattr(module, "stored", lambda df, held=held, stored=stored: held.append(int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))) or stored(df))
        stage(spark, docs, "")
        assert min(held) <= 512
        assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == rows
