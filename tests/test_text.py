"""Golden cases of the transcript scorers, and their properties."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lorikeet.functions import text as X
from lorikeet.functions.phonetics import double_metaphone, metaphone_codes, with_phonemes
from lorikeet.operators import scoring as C


def one(spark, *values):
    names = [f"c{i}" for i in range(len(values))]
    return spark.createDataFrame([values], ", ".join(f"{n} string" for n in names))


@pytest.mark.parametrize(
    "said, want",
    [
        ("T-t-tomato!", "tomato"), ("to-to-tomato", "tomato"), ("passion fruit", "passionfruit"),
        ("I want ice cream", "icecream"), ("red dog", "redog"), ("", ""), ("b b ball", "ball"),
    ],
)
def test_normalize_word(spark, said, want):
    assert one(spark, said).select(X.normalize_word("c0")).first()[0] == want


@pytest.mark.parametrize(
    "expected, actual, want",
    [
        ("tomato", "tomato", 1.0), ("rabbit", "wabbit", 1.0), ("sun", "shun", 1.0), ("cat", "bat", 0.9667),
        ("cat", "", 0.0),
    ],
)
def test_similarity(spark, expected, actual, want):
    rows = C.score_words(spark.createDataFrame([(expected, actual)], "expected string, actual string"))
    assert rows.first()["similarity_score"] == pytest.approx(want, abs=1e-4)


def test_sounds(spark):
    df = spark.createDataFrame([("cat", "bat"), ("rabbit", "wabbit"), ("sun", "jun"), ("ball", "ballball")], "e string, a string")
    got = df.select(X.most_different_sound("e", "a"), X.error_type(F.col("e"), F.col("a")), F.size(X.sound_substitutions("e", "a"))).collect()
    assert [tuple(r) for r in got] == [("b→c", "substitution", 1), ("ra", "correct", 0), ("su", "correct", 0), ("ba", "repetition", 0)]


def test_stuttering(spark):
    df = spark.createDataFrame([("the the cat",), ("soooo big",), ("good dog",), ("",)], "t string")
    assert [tuple(r[0]) for r in df.select(X.detect_stuttering("t")).collect()] == [
        (True, 1, 3), (True, 0, 2), (False, 0, 2), (False, 0, 0)
    ]


def test_sentences(spark):
    df = spark.createDataFrame([(1, "the red dog", "the red dog"), (2, "the red dog", "the red")], "id int, expected string, actual string")
    got = {r["id"]: r for r in C.score_sentences(df).collect()}
    assert (got[1]["error_type"], got[1]["similarity_score"], got[1]["is_correct"]) == ("echolalia", 0.9, True)
    assert got[2]["similarity_score"] == pytest.approx(2 / 3) and not got[2]["is_correct"]
    assert (got[2]["correct_word_count"], got[2]["total_word_count"], got[2]["feedback_class"]) == (2, 3, "one_missing")


def test_rows_that_share_an_id_are_scored_one_by_one(spark):
    said = [(1, "the red dog", "the red"), (1, "the red dog", "the bed dog"), (None, "blue cat", "blue cat now"), (2, "one two", None), (3, None, "x")]
    df = spark.createDataFrame(said, "id int, expected string, actual string")
    got = C.score_sentences(df).collect()
    assert len(got) == 5 and all(0 <= r["similarity_score"] <= 1 for r in got)
    alone = [C.score_sentences(spark.createDataFrame([row], df.schema)).first() for row in said]
    assert sorted(map(repr, got)) == sorted(map(repr, alone))
    items = spark.createDataFrame([(1, "red dog")], "item_id long, name string")
    attempts = spark.createDataFrame([(None, 9, 1, "red dog", 1), (None, 9, 1, "bed dog", 2), (7, 9, 1, "red", 3), (7, 9, 1, "dog", 4)], "attempt_id long, session_id long, item_id long, transcript string, ts long")
    assert sorted(r["response_text"] for r in C.attempt_rows(attempts, items).collect()) == ["bed dog", "dog", "red", "red dog"]


def test_second_scorer(spark):
    df = spark.createDataFrame([("kitten", "sitting")], "expected string, actual string")
    assert C.compare_words(df).first()["similarity_score"] == 0.57
    assert one(spark, "kitten", "sitting").select(X.edit_similarity("c0", "c1")).first()[0] == pytest.approx(0.5714, abs=1e-4)
    rows = spark.createDataFrame([(1, "red dog", "red cat")], "id int, expected string, actual string")
    assert tuple(C.compare_sentences(rows, "id").first())[1:] == (0.5, False, 1, 2)
    phones = df.withColumn("expected_phonemes", F.array(F.lit("K"), F.lit("IH"))).withColumn("actual_phonemes", F.array(F.lit("S"), F.lit("IH")))
    row = C.compare_words(phones, phonemes=True).first()
    assert row["error_type"] == "incorrect" and [tuple(e) for e in row["phoneme_errors"]] == [(0, "K", "S")]
    assert row["tip"] is None and row["feedback_class"] == "slow_down"
    light = df.withColumn("expected_phonemes", F.array(F.lit("L"))).withColumn("actual_phonemes", F.array(F.lit("R")))
    row = C.compare_words(light, phonemes=True).first()
    assert row["tip"] and row["feedback_class"] == "practise_sound"


def test_echolalia_and_grading(spark):
    df = spark.createDataFrame([("dog dog dog", "Dog", " dog ")], "a string, expected string, actual string")
    assert df.select(X.is_echolalic("a")).first()[0]
    assert C.graded(df).first()["is_correct"]


@pytest.mark.parametrize(
    "word, codes",
    [
        ("Thompson", ("TMPSN", "")), ("Smith", ("SM0", "XMT")), ("Schmidt", ("XMT", "SMT")), ("knight", ("NT", "")),
        ("photo", ("FT", "")), ("cat", ("KT", "")), ("", ("", "")), ("church", ("XRX", "XRK")), ("tomato", ("TMT", "")),
    ],
)
def test_double_metaphone(word, codes):
    assert double_metaphone(word) == codes


def test_codes_and_lexicon(spark):
    df = spark.createDataFrame([("cat",), (None,), ("kat",)], "w string")
    assert [r[0]["primary"] for r in df.select(metaphone_codes("w")).collect()] == ["KT", "", "KT"]
    lexicon = spark.createDataFrame([("Cat", ["K", "AE", "T"]), ("cat", ["Z"])], "word string, phonemes array<string>")
    assert {r["w"]: r["phonemes"] for r in with_phonemes(df, "w", lexicon).collect()} == {"cat": ["K", "AE", "T"], None: None, "kat": None}


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.text("abcst -é", max_size=8), st.text("abcst -é", max_size=8)), min_size=1, max_size=20))
def test_similarity_bounds(spark, pairs):
    df = spark.createDataFrame(pairs, "e string, a string")
    for r in df.select("e", "a", X.edit_similarity("e", "a").alias("s"), X.boosted_similarity("e", "a").alias("b")).collect():
        assert (r["s"] is None) == (r["e"] == r["a"] == "")
        assert r["s"] is None or 0 <= r["s"] <= 1
        assert 0 <= r["b"] <= 1
        assert r["e"] != r["a"] or r["e"] == "" or r["s"] == 1


def test_variants(spark):
    df = spark.createDataFrame([("sun", "shun"), ("cat", "bat"), ("rat", "lat"), ("hhh", "hhh"), ("", "")], "e string, a string")
    rows = df.select("e", "a", X.phonetic_variants("e").alias("v"), X.is_variant("e", "a").alias("is")).collect()
    assert [r["is"] for r in rows] == [True, False, True, False, False]
    assert all(r["is"] == (r["a"] in r["v"]) for r in rows) and "thun" in rows[0]["v"] and len(set(rows[0]["v"])) == len(rows[0]["v"])


def test_attempt_rows(spark):
    items = spark.createDataFrame([(1, "rabbit"), (2, "red dog")], "item_id long, name string")
    said = [(1, 9, 1, "wabbit", 1), (2, 9, 1, "rabbit rabbit", 2), (3, 9, 2, "red dog", 3), (4, 9, 2, "red fog", 4)]
    attempts = spark.createDataFrame(said, "attempt_id long, session_id long, item_id long, transcript string, ts long")
    got = {r["attempt_id"]: r for r in C.attempt_rows(attempts, items).collect()}
    assert [got[i]["attempt_number"] for i in (1, 2, 3, 4)] == [1, 2, 1, 2]
    assert got[1]["is_correct"] and got[1]["error_type"] == "correct" and not got[1]["is_echo"]
    assert got[2]["stammering_detected"] and got[2]["repetition_count"] == 1
    assert got[3]["is_echo"] and got[3]["error_type"] == "echolalia"
    assert got[4]["error_type"] == "sentence_errors" and got[4]["n_substitutions"] == 1
