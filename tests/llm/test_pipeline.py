"""The stages one by one, and all of them, against plain versions."""

import corpus_pipeline
import numpy as np
from netloom.llm import decontaminate, langid, neardup, quality, queries


def test_stages(spark):
    folder = "/root/testdata/sf0.01"
    docs = queries.table(spark, folder, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "quality_classifier", "near_duplicates", "benchmark_decontamination", "best_fit_packing"]
    table = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.written(stage(spark, table, folder), "test")
        assert out.schema == docs.schema
        before, after = ({r["doc_id"] for r in t.select("doc_id").collect()} for t in (table, out))
        if name == "language_id":
            want = {r["doc_id"] for r in langid.identified(table).filter("lang_pred != 'und' and score >= 0.5").collect()}
        elif name == "quality_classifier":
            want = {r["doc_id"] for r in quality.scored(table, queries.table(spark, folder, "labels")).filter("predicted = 1").collect()}
        elif name == "near_duplicates":
            want = {r["class_id"] for r in neardup.classes(table).collect()}
            assert out.count() == len(want)
        else:
            bad = decontaminate.matches(table, queries.table(spark, folder, "benchmark"))
            want = before - {r["doc_id"] for r in bad.collect()}
        assert after == want and after < before or name == "language_id"
        table = out
    packed = corpus_pipeline.STAGES[-1][1](spark, table, folder).toPandas()
    assert set(packed["doc_id"]) == {r["doc_id"] for r in table.collect()}
    whole = corpus_pipeline.run(spark, folder).toPandas()
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert np.array_equal(whole[key].sort_values(key).to_numpy(), packed[key].sort_values(key).to_numpy())


def test_empty_table(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        queries.table(spark, "/root/testdata/sf0.001", name).limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0


def test_stages_of_odd_tables(spark):
    """Nulls, empty and long texts, repeated rows and clashing names: every stage gives rows of its input, or none."""
    folder = "/root/testdata/sf0.001"
    good = [tuple(r) for r in queries.table(spark, folder, "documents").select("doc_id", "text", "lang", "source", "n_chars").limit(60).collect()]
    long = " ".join(t for _, t, *_ in good if t)
    rows = good + good[:5] + [(None, None, None, None, None), (None, good[7][1], None, None, None), (9_001, "", "en", "s", 0), (9_002, long * 3, "en", "s", 1), (9_002, "another text of one id", "en", "s", 1)]
    table = spark.createDataFrame([(*r, 1, "x", 2.0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, node int, key string, score double")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, table, folder)
        assert out.columns == table.columns
        assert {tuple(r) for r in out.collect()} <= {(*r, 1, "x", 2.0) for r in rows}
    kept = corpus_pipeline.STAGES[2][1](spark, table, folder).collect()
    assert len({tuple(r) for r in kept}) == len(kept) < len(rows)
    pieces = corpus_pipeline.STAGES[-1][1](spark, table, folder)
    assert pieces.filter("piece = 0").count() == len(rows)
