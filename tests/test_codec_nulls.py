from palimpsest.plans.queries import QUERIES


def test_null_text_has_a_row(spark, tmp_path):
    spark.createDataFrame([(1, "some text é"), (2, None), (3, "")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: (r["hash"] is None, r["bytes"] is None, r["same"]) for r in QUERIES["codec_round_trip"](spark, str(tmp_path)).collect()}
    assert got == {1: (False, False, True), 2: (True, True, None), 3: (False, False, True)}
