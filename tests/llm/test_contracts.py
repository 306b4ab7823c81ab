"""Contract details and clashing names of single operators."""

from tideglass.llm import decontaminate, langid


def test_only_letters_make_a_language(spark):
    docs = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate([("the sea is wide", "en"), ("das meer ist weit", "de")] * 20)], "doc_id long, text string, lang string")
    asked = spark.createDataFrame([(1, "² ½"), (2, "① 12 _"), (3, None), (4, ""), (5, "² the sea"), (6, "ª"), (7, "³" * 5000 + "x")], "doc_id long, text string")
    got = {r.doc_id: r.lang_pred for r in langid.identify(asked, langid.fit(docs)).collect()}
    assert {i for i, lang in got.items() if lang == "und"} == {1, 2, 3, 4} and got[5] == "en"


def test_names_in_other_case_stay(spark):
    words = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(1, words, "a", "b", "c", "d"), (2, "clean text", "e", "f", "g", "h")], "doc_id long, text string, Hits string, ITEMS string, N_words string, _hits string")
    bench = spark.createDataFrame([("x", words)], "item_id string, text string")
    got = decontaminate.decontaminated(docs, bench)
    assert got.columns == docs.columns and [tuple(r) for r in got.collect()] == [(2, "clean text", "e", "f", "g", "h")]
