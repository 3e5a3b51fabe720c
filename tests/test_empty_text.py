"""Documents whose text is empty have no share of odd characters; they are filled like other missing cells."""

from tribunal.functions import rules
from tribunal.operators.prepare import fit_preparation
from tribunal.operators.score import fill_missing_inputs
from tribunal.plans import fixtures as T, queries as Q
from tribunal.plans.analysis import prepared_rows


def _folder(spark, path):
    texts = ["", None, "abc-", "a1b2", "word word", "x!", "plain", "12 34", "a", "b?"]
    docs = [(i, t, ["en", "de"][i % 2], ["src1", "src2"][i // 5], len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(10)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_an_empty_text_is_a_missing_share(spark, tmp_path):
    folder = _folder(spark, tmp_path)
    shares = {r["doc_id"]: r["odd_share"] for r in T.doc_quality(spark, folder).collect()}
    assert shares.pop(0) is None and shares.pop(1) is None
    assert shares == {2: 0.25, 3: 0.5, 4: 0.0, 5: 0.5, 6: 0.0, 7: 0.8, 8: 0.0, 9: 0.5}


def test_documents_with_an_empty_text_are_prepared_and_scored(spark, tmp_path):
    folder = _folder(spark, tmp_path)
    preparation = fit_preparation(T.doc_quality(spark, folder), "quality", rules.CLASSIFICATION, ["doc_id"])
    median = preparation.numeric["odd_share"].median
    assert median == 0.375     # of the eight shares there are
    assert prepared_rows(T.doc_quality(spark, folder), preparation, "doc_id")[0].dropna().count() == 10
    filled = {r["doc_id"]: r["odd_share"] for r in fill_missing_inputs(Q._blanked_docs(spark, folder), preparation).collect()}
    assert len(filled) == 10 and filled[0] == filled[1] == median and filled[2] == 0.25
