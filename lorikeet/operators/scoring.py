"""Pronunciation scoring of transcripts, both scorers, as whole tables.

Phonetic codes are made in a small Arrow stage, once for the distinct words of a
batch; everything else is expressions within the row. Nothing is joined or
grouped, so rows may share ids or lack them, and the functions work on a stream
as on a table. They take rows with the columns expected and actual, and keep all
others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorikeet.functions import text as X
from lorikeet.functions.phonetics import metaphone_codes, metaphone_codes_of


def similarity(expected: Column, actual: Column, e: Column, a: Column) -> Column:
    """B-06 from two words and their codes: 1 if equal or a one-sound variant, 0.9
    and 0.8 for equal codes, else the boosted edit similarity."""
    return (
        F.when(expected == actual, 1.0)
        .when(X.is_variant(expected, actual), 1.0)
        .when((e["primary"] != "") & (e["primary"] == a["primary"]), 0.9)
        .when((e["secondary"] != "") & (e["secondary"] == a["secondary"]), 0.8)
        .otherwise(X.boosted_similarity(expected, actual))
    )


def score_words(rows: DataFrame) -> DataFrame:
    """B-07, B-08: ``rows`` (expected, actual, ...) scored as single words, with
    expected_clean, actual_clean, similarity_score, is_correct, error_type,
    substitutions, feedback_class. An empty attempt scores 0 with error missing."""
    rows = rows.withColumn("expected_clean", F.regexp_replace(X.trimmed("expected"), "[^a-z]", "")).withColumn(
        "actual_clean", X.normalize_word(X.normalize_word("actual"))
    )
    coded = rows.withColumn("__e", metaphone_codes("expected_clean")).withColumn("__a", metaphone_codes("actual_clean"))
    e, a = F.col("expected_clean"), F.col("actual_clean")
    scored = coded.withColumn("similarity_score", similarity(e, a, F.col("__e"), F.col("__a")))
    kind = F.when((a == "") & (e != ""), "missing").otherwise(X.error_type(e, a))
    return (
        scored.withColumn("is_correct", F.col("similarity_score") >= X.CORRECT)
        .withColumn("error_type", kind)
        .withColumn("substitutions", X.sound_substitutions(e, a))
        .withColumn("feedback_class", X.word_feedback_class(F.col("is_correct"), F.col("similarity_score"), F.col("error_type")))
        .drop("__e", "__a")
    )


_SUBSTITUTION = "struct<word:string,position_in_word:int,expected:string,actual:string,word_position:int>"


def score_sentences(rows: DataFrame) -> DataFrame:
    """B-16, B-13, B-14, B-18: ``rows`` (expected, actual, ...) scored as sentences:
    similarity_score, is_correct, error_type, counts of words, the substitutions
    of all its words and a feedback class.

    Words are aligned by place; the shorter side is padded. A repeated sentence
    counts as echolalia with 0.9. A null side has no words.
    """
    clean = lambda text: F.coalesce(X.strip_punctuation(text), F.lit(""))
    exp, act = clean(X.trimmed("expected")), clean(X.normalize_sentence("actual"))
    base = rows.withColumn("__exp", exp).withColumn("__act", act)
    base = base.withColumn("__echo", X.is_echolalic_sentence("__exp", "__act"))
    base = base.withColumn("__ew", X.words_of("__exp")).withColumn("__aw", X.words_of("__act"))
    coded = base.withColumn("__ec", metaphone_codes_of("__ew")).withColumn("__ac", metaphone_codes_of("__aw"))
    zipped = F.arrays_zip(
        F.col("__ew").alias("e"), F.col("__aw").alias("a"), F.col("__ec").alias("ec"), F.col("__ac").alias("ac")
    )
    none = F.array().cast(f"array<{_SUBSTITUTION}>")

    def scored(pair: Column, at: Column) -> Column:
        e, a = pair["e"], pair["a"]
        both = e.isNotNull() & a.isNotNull()
        sim = F.when(both, similarity(e, a, pair["ec"], pair["ac"])).otherwise(F.lit(0.0))
        # B-14: what differs in a word, with the word and its place
        subs = F.transform(
            X.sound_substitutions(e, a),
            lambda p: F.struct(
                e.alias("word"), p["position"].alias("position_in_word"), p["expected"].alias("expected"),
                p["actual"].alias("actual"), at.alias("word_position"),
            ),
        )
        return F.struct(sim.alias("sim"), both.alias("both"), a.isNull().alias("missing"), F.when(both, subs).otherwise(none).alias("subs"))

    words = coded.withColumn("__words", F.transform(zipped, scored))
    w = F.col("__words")
    count = lambda cond: F.size(F.filter(w, cond))
    n_expected, n_all = F.size("__ew"), F.size(w)
    total = F.aggregate(w, F.lit(0.0), lambda t, x: t + x["sim"])
    words = words.withColumn("__mean", F.coalesce(total / F.nullif(n_all, F.lit(0)), F.lit(0.0)))
    words = words.withColumn("__right", count(lambda x: x["both"] & (x["sim"] >= X.CORRECT)))
    echo, mean = F.col("__echo"), F.col("__mean")
    right = (mean >= X.CORRECT) & (F.col("__right") >= n_expected * 0.7)
    kind = X.sentence_feedback_class(
        right, mean, count(lambda x: x["missing"]), count(lambda x: x["both"] & (x["sim"] < X.CORRECT))
    )
    out = {
        "similarity_score": F.when(echo, 0.9).otherwise(mean),
        "is_correct": echo | right,
        "error_type": F.when(echo, "echolalia").otherwise("sentence_errors"),
        "correct_word_count": F.when(~echo, F.col("__right")).cast("long"),
        "total_word_count": F.when(~echo, n_expected),
        "substitutions": F.when(echo, none).otherwise(F.flatten(F.transform(w, lambda x: x["subs"]))),
        "feedback_class": F.when(echo, "perfect").otherwise(kind),
    }
    return words.select(*[c for c in rows.columns if c not in out], *[x.alias(c) for c, x in out.items()])


def compare_words(rows: DataFrame, phonemes: bool = False) -> DataFrame:
    """B-27 (second scorer): ``rows`` (expected, actual, ...) with similarity_score
    rounded to two places, phonetic_match, letter substitutions, error_type, the
    class of the feedback and a tip for a known confusion (B-26). With
    ``phonemes`` the rows have expected_phonemes and actual_phonemes (U-02), which
    are compared by place; without, no phoneme error is known."""
    rows = rows.withColumn("expected", X.trimmed("expected")).withColumn("actual", X.trimmed("actual"))
    coded = rows.withColumn("__e", metaphone_codes("expected")).withColumn("__a", metaphone_codes("actual"))
    sim = X.edit_similarity("expected", "actual")
    match = F.col("__e.primary") == F.col("__a.primary")
    none = F.lit(None).cast("array<struct<position:int,expected:string,actual:string>>")
    coded = coded.withColumn("phoneme_errors", X.phoneme_errors("expected_phonemes", "actual_phonemes") if phonemes else none)
    errors = F.coalesce(F.size("phoneme_errors") > 0, F.lit(False))
    return (
        coded.withColumn("phonetic_match", match)
        .withColumn("substitutions", X.letter_substitutions("expected", "actual"))
        .withColumn("error_type", X.classify_error(sim, match, errors))
        .withColumn("similarity_score", F.bround(sim, 2))
        .withColumn("is_correct", F.col("error_type") == "correct")
        .withColumn(
            "feedback_class",
            X.comparison_feedback_class(F.col("error_type"), F.col("phoneme_errors"), F.col("substitutions")),
        )
        .withColumn("tip", X.confusion_tip(F.col("phoneme_errors")))
        .drop("__e", "__a")
    )


def compare_sentences(rows: DataFrame, id_col: str) -> DataFrame:
    """B-28, B-29: share of the expected words said right at their place."""
    ew, aw = X.words_of(X.trimmed("expected")), X.words_of(X.trimmed("actual"))
    n = F.least(F.size(ew), F.size(aw))
    right = F.size(F.filter(F.zip_with(F.slice(ew, 1, n), F.slice(aw, 1, n), lambda x, y: x == y), lambda s: s))
    total = F.size(ew)
    score = right / F.nullif(total, F.lit(0))
    return rows.select(
        id_col,
        F.bround(score, 2).alias("similarity_score"),
        (score == 1).alias("is_correct"),
        right.alias("correct_word_count"),
        total.alias("total_word_count"),
    )


def graded(rows: DataFrame) -> DataFrame:
    """B-30: the exact grader: equal but for case and outer blanks."""
    return rows.withColumn("is_correct", X.detect_echolalia("expected", "actual")).withColumn(
        "response_type", F.lit("generic")
    )


def attempt_rows(attempts: DataFrame, items: DataFrame) -> DataFrame:
    """B-31, B-07: ``attempts`` (attempt_id, session_id, item_id, transcript, ts) as
    fact rows: the item's name is scored as a sentence if it has several words,
    else as a word; with stutter, echo and the number of the attempt (A-28). Rows
    are scored one by one, so repeated and null attempt_ids stay rows of their own."""
    numbered = attempts.withColumn(
        "attempt_number", F.row_number().over(Window.partitionBy("session_id", "item_id").orderBy("ts", "attempt_id"))
    )
    rows = numbered.join(items.select("item_id", F.col("name").alias("expected")), "item_id").withColumnRenamed("transcript", "actual")
    rows = rows.withColumn("stutter", X.detect_stuttering("actual")).withColumn("is_echo", X.detect_echolalia("expected", "actual"))
    many = F.size(X.words_of(X.trimmed("expected"))) > 1
    scored = score_words(rows.where(~many)).drop("expected_clean", "actual_clean")
    counted = lambda df: df.withColumn("n_substitutions", F.size("substitutions")).drop("substitutions")
    sentences = score_sentences(rows.where(many)).drop("correct_word_count", "total_word_count")
    return counted(scored).unionByName(counted(sentences)).select(
        "attempt_id", "session_id", "item_id", "attempt_number", F.lit("verbal").alias("response_type"),
        F.col("actual").alias("response_text"), "is_correct", F.col("similarity_score").alias("pronunciation_score"),
        "error_type", "n_substitutions", F.col("stutter.has_stammering").alias("stammering_detected"),
        F.col("stutter.repetition_count").alias("repetition_count"), "is_echo", "feedback_class",
        F.col("ts").alias("created_at"),
    )
