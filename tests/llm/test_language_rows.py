"""The language query on rows without an id, repeated rows, and an empty table."""

from corvid.llm import queries


def test_null_ids_and_repeated_rows(spark, tmp_path):
    words = {"aa": "lorem ipsum dolor sit amet", "bb": "quick brown foxes jump over"}
    rows = [(i, f"{words[lang]} {i} {words[lang]}", lang) for i in range(60) for lang in ("aa", "bb")]
    rows += [(None, words["aa"] * 3, "bb"), (None, None, None), (7, words["bb"] * 3, "bb"), (7, words["bb"] * 3, "bb")]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    table = spark.createDataFrame([(d, t, x, "s", len(t or "")) for d, t, x in rows], schema)
    table.write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op7_language_id(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and all(r.held_out is not None for r in got)
    none = [r for r in got if r.doc_id is None]
    assert all(r.held_out for r in none) and sorted(r.lang_pred for r in none) == ["aa", "und"]
    assert [r.lang_pred for r in got if r.doc_id == 7].count("bb") == 3
    (tmp_path / "empty").mkdir()
    table.limit(0).write.parquet(str(tmp_path / "empty" / "documents.parquet"))
    assert queries.op7_language_id(spark, str(tmp_path / "empty")).count() == 0
