"""The pipeline's stages on a small corpus, each against what it must do to its own input."""

import corpus_pipeline
from tests.llm.helpers import EDGES, corpus
from tests.llm.test_operators import brute_classes, quality_rows


SMALL = "/root/testdata/sf0.001"


def test_pipeline(spark, tmp_path):
    rows, marks = quality_rows(120)
    docs = rows + [(500 + i, t, lang, s) for i, t, lang, s in corpus()] + [(700, "the password=c6d64b9a661f85b709 is here " + rows[0][1], "en", "s")] + EDGES
    spark.createDataFrame([(*r, len(r[1] or "")) for r in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    sf = f"file://{tmp_path}"
    df = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)

    good = stages["quality_rules"](spark, df, sf)
    quality = {d: q for d, q, _ in marks}
    kept = {r["doc_id"] for r in good.collect()}
    assert good.columns == df.columns
    assert sum(q == (d in kept) for d, q in quality.items()) > 0.95 * len(quality)

    distinct = stages["near_dedup"](spark, good, sf)
    have = [tuple(r)[:2] for r in good.collect()]
    n_classes = len(set(brute_classes(have)))
    left = distinct.collect()
    assert len(left) == n_classes == len({r["doc_id"] for r in left})

    masked = stages["secret_scan"](spark, distinct, sf)
    assert masked.count() == len(left)
    text = {r["doc_id"]: r for r in masked.collect()}
    assert 700 not in text or ("[SECRET]" in text[700]["text"] and "c6d64b9a661f85b709" not in text[700]["text"] and text[700]["n_chars"] == len(text[700]["text"]))

    mixed = stages["mixing"](spark, masked, sf)
    assert mixed.columns == df.columns and {r["doc_id"] for r in mixed.collect()} <= set(text)

    packed = stages["packing"](spark, mixed, sf)
    whole = packed.where("start = 0").count()
    assert whole == mixed.count()
    assert corpus_pipeline.run(spark, sf).count() == packed.count()


def test_pipeline_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0


def test_pipeline_with_nulls_ties_and_clashing_names(spark, tmp_path):
    """Rows without doc_id, text or language, rows that repeat, and further columns that are named like those of results."""
    good = "This is a plain sentence of ordinary words, and here is another one that follows it at some length."
    rows = [(1, good, "en"), (1, good, "en"), (None, good + " More of it comes here.", None), (None, None, None), (2, None, "de"), (3, "", None), (4, good.upper() + " Quite other words stand in this line, so that nothing is alike.", "en")]
    df = spark.createDataFrame([(*r, "s", len(r[1] or ""), "k", 1, 2.0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, root string, key long, rate double")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, SMALL)
        assert out.columns == df.columns, name
        assert out.count() >= (1 if name == "quality_rules" else 2), name
    assert corpus_pipeline.STAGES[-1][1](spark, df, SMALL).where("start = 0").count() == len(rows)
