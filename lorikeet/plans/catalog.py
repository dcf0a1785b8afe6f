"""Every registered query: the operators over the domain tables.

Doubles are rounded to six places so that another engine's sums can be compared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorikeet.functions import spelling
from lorikeet.functions import text as X
from lorikeet.functions.phonetics import with_phonemes
from lorikeet.functions.spelling import with_all_phonemes
from lorikeet.operators import classifier
from lorikeet.operators import gaze as Z
from lorikeet.operators import performance as P
from lorikeet.operators import progress as G
from lorikeet.operators import recommend as R
from lorikeet.operators import report as T
from lorikeet.operators import scoring as C
from lorikeet.operators import sessions as S
from lorikeet.operators.categories import category_stats
from lorikeet.operators.similarity import similar_children
from lorikeet.plans.oracle import ORACLES
from lorikeet.session import kept, shared_folder, ship
from lorikeet.sources import tables as W
from lorikeet.sources.domain import AS_OF, Domain, with_views
from lorikeet.streaming import maintained as K
from lorikeet.streaming import messages as M
from lorikeet.streaming import rooms as L

Query = Callable[[SparkSession, str], DataFrame]


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles are scaled, rounded to whole numbers and scaled back, as the SQL's
    ``round`` does. ``F.round`` goes by a double's shortest decimal form, which gives
    other digits next to a half: 0.0640625 is 0.064062 by the SQL, not 0.064063."""
    unit = 10.0**digits

    def value(name: str) -> Column:
        scaled = F.round(F.col(name) * unit) / unit
        return F.when(F.abs(scaled) < float("inf"), scaled).otherwise(F.col(name))

    return df.select(*[value(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def listed(column: str | Column) -> Column:
    """An array as text, so that engines agree on it."""
    return F.array_join(column, "|")


def _performance(d: Domain) -> DataFrame:
    return P.performance_rollup(d.answers, d.therapy_sessions)


def _rollups(d: Domain) -> tuple[DataFrame, DataFrame]:
    """The roll-ups by category and by item, of counts that are gathered once."""
    return P.rollups_of(kept(P.attempt_counts(d.answers, d.therapy_sessions), "counts"))


def performance_rollup(d: Domain) -> DataFrame:
    return rounded(_performance(d))


def item_performance(d: Domain) -> DataFrame:
    return rounded(P.item_performance(d.answers, d.therapy_sessions))


def skill_vectors(d: Domain) -> DataFrame:
    return rounded(P.skill_vector(d.children, _performance(d)))


def similar(d: Domain) -> DataFrame:
    """A stated query set, every 50th child, against all children."""
    vectors = P.skill_vector(d.children, _performance(d))
    return similar_children(vectors, d.children.where("child_id % 50 = 0"))


def similar_to_each(d: Domain) -> DataFrame:
    """The neighbours of every child."""
    return similar_children(P.skill_vector(d.children, _performance(d)))


def ml_features(d: Domain) -> DataFrame:
    return rounded(P.ml_features(d.children, _performance(d), d.therapy_sessions, d.activity_categories))


def child_profiles(d: Domain) -> DataFrame:
    rows = P.child_profile(d.children, _performance(d))
    return rounded(rows.withColumn("strengths", listed("strengths")).withColumn("challenges", listed("challenges")))


def session_overview(d: Domain) -> DataFrame:
    rows = S.session_overview(d.therapy_sessions, d.answers, d.activity_items, d.children, d.activity_categories)
    return rounded(rows.withColumn("strengths", listed("strengths")).withColumn("areas_for_improvement", listed("areas_for_improvement")))


def session_history(d: Domain) -> DataFrame:
    return rounded(S.session_history(d.therapy_sessions, d.answers, d.caregiver_feedback, d.activity_categories))


def performance_details(d: Domain) -> DataFrame:
    return rounded(S.performance_details(_performance(d), d.activity_categories))


def feedback_history(d: Domain) -> DataFrame:
    return S.feedback_history(d.caregiver_feedback, d.therapy_sessions, d.activity_categories)


def attempt_numbers(d: Domain) -> DataFrame:
    return S.attempt_numbers(d.session_activities)


def session_rates(d: Domain) -> DataFrame:
    so_far = S.success_so_far(d.answers)
    return rounded(so_far.join(S.recent_rate(d.session_activities), "session_id"))


def _stats(kind: str) -> Callable[[Domain], DataFrame]:
    def query(d: Domain) -> DataFrame:
        return rounded(
            category_stats(
                d.children, d.activity_categories, d.child_category, d.activity_items, d.session_activities,
                d.therapy_sessions, kind,
            )
        )

    return query


def _trend(days: int) -> Callable[[Domain], DataFrame]:
    return lambda d: rounded(G.progress_trend(d.children, d.therapy_sessions, d.answers, AS_OF, days))


def session_scores(d: Domain) -> DataFrame:
    return rounded(G.session_scores(d.therapy_sessions, d.answers))


def improvement_areas(d: Domain) -> DataFrame:
    return G.improvement_areas(d.children, d.therapy_sessions, d.answers, d.activity_categories, AS_OF, 90, 365)


def improvement_areas_now(d: Domain) -> DataFrame:
    """The windows that are the default: a week and a month."""
    return G.improvement_areas(d.children, d.therapy_sessions, d.answers, d.activity_categories, AS_OF)


def category_recommendations(d: Domain) -> DataFrame:
    return rounded(R.category_recommendations(d.children, d.activity_categories, _performance(d)))


def _item_recommendations(d: Domain) -> DataFrame:
    pairs = d.therapy_sessions.select("child_id", "category_id").distinct()
    return R.item_recommendations(pairs, d.activity_items, d.activity_categories, *_rollups(d))


def _path(d: Domain) -> DataFrame:
    return R.learning_path(P.child_profile(d.children, _performance(d)), d.activity_categories)


def updated_targets(d: Domain) -> DataFrame:
    return rounded(R.updated_targets(_path(d), _performance(d)).select("child_id", "category_id", "priority", "target_score"))


def current_paths(d: Domain) -> DataFrame:
    """Children with odd ids have the stored path; the others' is generated."""
    path = _path(d)
    stored = path.where("child_id % 2 = 1").withColumn("status", F.lit("active"))
    return rounded(R.current_path(stored, path, _performance(d)))


def session_plans(d: Domain) -> DataFrame:
    perf, item_perf = _rollups(d)
    rows = R.session_plan(d.children, perf, d.activity_categories, d.activity_items, item_perf)
    return rows.withColumn("item_ids", listed(F.col("item_ids").cast("array<string>")))


def recommended_in_category(d: Domain) -> DataFrame:
    """The dispatcher, asked for the items of the first category."""
    perf, item_perf = _performance(d), P.item_performance(d.answers, d.therapy_sessions)
    return R.recommend(d.children, d.activity_categories, perf, d.activity_items, item_perf, 0)


def recommended_anywhere(d: Domain) -> DataFrame:
    perf, item_perf = _performance(d), P.item_performance(d.answers, d.therapy_sessions)
    return rounded(R.recommend(d.children, d.activity_categories, perf, d.activity_items, item_perf))


def session_adjustments(d: Domain) -> DataFrame:
    return R.session_adjustment(d.therapy_sessions, d.answers, d.activity_items, _item_recommendations(d))


def next_items(d: Domain) -> DataFrame:
    return R.next_item(d.therapy_sessions, d.answers, d.activity_items)


def next_activities(d: Domain) -> DataFrame:
    perf = kept(_performance(d), "rollup")
    return R.next_activity(
        d.therapy_sessions, d.answers, d.activity_items, d.activity_categories, perf, P.child_profile(d.children, perf)
    )


def adaptations(d: Domain) -> DataFrame:
    """Answers are the names of the next item of the category, as utterances say."""
    said = d.session_activities.join(d.utterances.select("item_id", F.col("actual").alias("response_text")), "item_id", "left")
    return rounded(R.adaptation(said, d.activity_items))


def _shown(rows: DataFrame) -> DataFrame:
    """Rule recommendations with their arrays as text."""
    activity = F.transform("next_activities", lambda x: F.concat(x["category"], F.lit(": "), F.array_join(x["items"], ", ")))
    for c in ("practice_more", "encouraged_by"):
        rows = rows.withColumn(c, listed(c))
    return rounded(rows.withColumn("next_activities", listed(activity)))


def rule_recommendations(d: Domain) -> DataFrame:
    return _shown(R.rule_recommendations(d.children, _performance(d), d.activity_categories, d.activity_items))


def starter_activities(d: Domain) -> DataFrame:
    """What children start with who have no answers of the last ninety days."""
    perf = P.performance_rollup(d.answers, G.in_window(d.therapy_sessions, AS_OF, 90))
    new = d.children.join(perf.select("child_id"), "child_id", "left_anti")
    rows = R.rule_recommendations(new, perf, d.activity_categories, d.activity_items)
    return _shown(rows).select("child_id", "next_activities", "encouragement")


def suggested_items(d: Domain) -> DataFrame:
    return R.suggested_items(d.activity_categories, d.activity_items)


def answer_options(d: Domain) -> DataFrame:
    return R.answer_options(d.activity_items)


def fallback_recommendations(d: Domain) -> DataFrame:
    return classifier.predict(P.ml_features(d.children, _performance(d), d.therapy_sessions, d.activity_categories), None)


def learnt_recommendations(d: Domain) -> DataFrame:
    """The forest learns each child's best category from its features. Its nodes
    are fitted on counts that Spark gathers, whatever the number of children."""
    features, rows = _labelled_features(d)
    return classifier.predict(features, classifier.train(rows))


def _labelled_features(d: Domain) -> tuple[DataFrame, DataFrame]:
    """The features of all children, and those of children with a best category, with it."""
    perf = kept(_performance(d), "rollup")
    rules = R.rule_recommendations(d.children, perf, d.activity_categories, d.activity_items)
    return _with_labels(d, perf, rules)


def _with_labels(d: Domain, perf: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both are written once, since fitting reads its rows many times."""
    features = kept(P.ml_features(d.children, perf, d.therapy_sessions, d.activity_categories), "features")
    labels = rules.where("strongest_category IS NOT NULL").select("child_id", F.col("strongest_category").alias("recommended_category"))
    return features, kept(features.join(labels, "child_id"), "labelled")


def child_reports(d: Domain) -> DataFrame:
    return T.child_reports(
        d.children, _performance(d), d.activity_categories, d.therapy_sessions, d.caregiver_feedback, d.activity_items
    )


def report_blocks(d: Domain) -> DataFrame:
    return T.item_blocks(d.activity_items, d.activity_categories)


def sentence_normals(d: Domain) -> DataFrame:
    rows = d.utterances
    return rows.select("item_id", X.normalize_sentence("expected").alias("normal"), X.normalize_item_name("expected").alias("item_name"))


def edit_scores(d: Domain) -> DataFrame:
    rows = d.utterances
    sim = X.edit_similarity("expected", "actual")
    return rounded(
        rows.select(
            "item_id",
            sim.alias("similarity"),
            X.boosted_similarity("expected", "actual").alias("boosted"),
            F.size(X.letter_substitutions("expected", "actual")).alias("n_letter_substitutions"),
            X.most_different_sound("expected", "actual").alias("different_sound"),
            F.size(X.sound_substitutions("expected", "actual")).alias("n_sound_substitutions"),
            X.error_type("expected", "actual").alias("error_type"),
            X.classify_error(sim, F.lit(False), F.lit(False)).alias("error_class"),
            X.detect_echolalia("expected", "actual").alias("is_exact"),
        )
    )


def sentence_matches(d: Domain) -> DataFrame:
    return rounded(C.compare_sentences(d.utterances, "item_id"))


def graded_answers(d: Domain) -> DataFrame:
    return C.graded(d.utterances).select("item_id", "is_correct", "response_type")


def conversation_stutter(d: Domain) -> DataFrame:
    rows = W.scan(d.spark, f"{d.sf_dir}/conversations.parquet", "conversations")
    return rows.select("conv_id", "turn", X.detect_stuttering("text").alias("s")).select("conv_id", "turn", "s.*")


def echolalic_turns(d: Domain) -> DataFrame:
    """B-04 of every turn of the conversations."""
    rows = W.scan(d.spark, f"{d.sf_dir}/conversations.parquet", "conversations")
    return rows.select("conv_id", "turn", F.coalesce(X.is_echolalic("text"), F.lit(False)).alias("is_echolalic"))


def word_variants(d: Domain) -> DataFrame:
    """B-05 of the distinct words that are expected or said."""
    words = d.utterances.select(F.explode(F.concat(X.words_of("expected"), X.words_of("actual"))).alias("word")).distinct()
    return words.select("word", listed(F.array_sort(X.phonetic_variants("word"))).alias("variants"))


def stored_training(d: Domain) -> DataFrame:
    """S-12: training rows added to a CSV folder in two parts and read again."""
    rows = rounded(P.ml_features(d.children, _performance(d), d.therapy_sessions, d.activity_categories))
    path = shared_folder(d.spark, "training")
    for part in (0, 1):
        W.append_training(rows.where(F.col("child_id") % 2 == part), path)
    return W.read_training(d.spark, path, ", ".join(f"{c} {t}" for c, t in rows.dtypes))


def appended_feedback(d: Domain) -> DataFrame:
    """S-05: feedback added to a table in two parts, of ratings that are allowed."""
    rows = W.with_constraints(d.caregiver_feedback.select("feedback_id", "session_id", "child_id", "rating", "created_at"), {"rating": (1, 5)})
    path = shared_folder(d.spark, "feedback")
    for part in (0, 1):
        W.append(rows.where(F.col("feedback_id") % 2 == part), path)
    return d.spark.read.schema(rows.schema).parquet(path)


def sentence_scores(d: Domain) -> DataFrame:
    rows = C.score_sentences(d.utterances).drop("expected", "actual")
    return rounded(rows.withColumn("substitutions", F.to_json("substitutions")))


def attempt_facts(d: Domain) -> DataFrame:
    """Utterances as attempts: of each item, and of its first word, in one session."""
    said = d.utterances.select("item_id", F.col("actual").alias("transcript"))
    attempts = said.select(
        F.col("item_id").alias("attempt_id"), F.expr("item_id div 4").alias("session_id"), "item_id", "transcript",
        F.lit(AS_OF).cast("timestamp_ntz").alias("ts"),
    )
    return rounded(C.attempt_rows(attempts, d.activity_items))


def combined_recommendations(d: Domain) -> DataFrame:
    perf = _performance(d)
    features = P.ml_features(d.children, perf, d.therapy_sessions, d.activity_categories)
    rules = R.rule_recommendations(d.children, perf, d.activity_categories, d.activity_items)
    return _shown(R.combined_recommendations(rules, classifier.predict(features, None), features))


def model_recommendations(d: Domain) -> DataFrame:
    """The same with what a fitted model says."""
    perf = kept(_performance(d), "rollup")
    rules = R.rule_recommendations(d.children, perf, d.activity_categories, d.activity_items)
    features, rows = _with_labels(d, perf, rules)
    model = classifier.train(rows)
    return _shown(R.combined_recommendations(rules, classifier.predict(features, model), features))


def profile_bundles(d: Domain) -> DataFrame:
    rows = R.profile_bundle(d.children, _performance(d), G.in_window(d.therapy_sessions, AS_OF, 30), d.caregiver_feedback)
    return rows.select(
        "child_id", "name", F.size("performances").alias("n_performances"), F.size("sessions").alias("n_sessions"),
        listed(F.transform("feedback", lambda f: f["feedback_id"].cast("string"))).alias("newest_feedback"),
    )


def word_scores(d: Domain) -> DataFrame:
    words = d.utterances.select(
        "item_id", F.posexplode(F.arrays_zip(X.words_of("expected").alias("e"), X.words_of("actual").alias("a"))).alias("position", "w")
    ).select("item_id", "position", F.col("w.e").alias("expected"), F.col("w.a").alias("actual"))
    rows = C.score_words(words.where("expected IS NOT NULL AND actual IS NOT NULL"))
    return rounded(
        rows.select(
            "item_id", "position", "expected_clean", "actual_clean", "similarity_score", "is_correct", "error_type",
            F.size("substitutions").alias("n_substitutions"), "feedback_class", X.message(F.col("feedback_class"), F.col("item_id")).alias("feedback"),
        )
    )


def word_comparisons(d: Domain) -> DataFrame:
    rows = C.compare_words(d.utterances)
    return rounded(rows.select("item_id", "similarity_score", "phonetic_match", "error_type", "is_correct", F.size("substitutions").alias("n_substitutions"), "feedback_class"))


def upserted_rollup(d: Domain) -> DataFrame:
    """The roll-up of finished sessions, brought up to date by that of all."""
    done = d.therapy_sessions.where("is_completed")
    old = P.performance_rollup(d.answers, done)
    return rounded(W.upserted(old, _performance(d), ["child_id", "category_id"]))


def deletable_items(d: Domain) -> DataFrame:
    """Of all items and a draft beside each, those that no attempt refers to."""
    items = d.activity_items.select("item_id", "name")
    drafts = items.select((-F.col("item_id") - 1).alias("item_id"), F.concat(F.lit("draft of "), "name").alias("name"))
    return W.deletable(items.unionByName(drafts), d.session_activities, "item_id")


def owned_children(d: Domain) -> DataFrame:
    """The children of caregiver 7."""
    return W.owned(d.children, "caregiver_id", 7)


def audio_addresses(d: Domain) -> DataFrame:
    """Of every item the address of its recording, or of the one that is to be made."""
    items = d.activity_items
    return items.select("item_id", F.coalesce("audio_url", S.placeholder_audio(F.col("name"))).alias("audio_url"))


def replaced_interests(d: Domain) -> DataFrame:
    """Every tenth child's interests become the first category alone."""
    new = d.children.where("child_id % 10 = 0").select("child_id", F.lit(0).alias("category_id"))
    return W.replaced(d.child_category, new, "child_id")


def updated_items(d: Domain) -> DataFrame:
    """Items without a level of their own are set to medium."""
    items = d.activity_items.select("item_id", "name", "difficulty_level")
    changes = items.where("difficulty_level IS NULL").select("item_id", F.lit("medium").alias("difficulty_level"))
    return W.updated(items, changes, "item_id")


def event_rates(d: Domain) -> DataFrame:
    events = W.scan(d.spark, f"{d.sf_dir}/events.parquet", "events")
    rows = M.event_rates(events)
    return rounded(rows.withColumn("window_start", F.col("window_start").cast("timestamp_ntz")))


def gaze_summary(d: Domain) -> DataFrame:
    return rounded(
        d.gaze_tracking.groupBy("child_id").agg(
            F.count("*").alias("n_points"), F.avg("on_screen_percentage").alias("on_screen_percentage")
        )
    )


def stored_gaze(d: Domain) -> DataFrame:
    return rounded(Z.accepted_gaze(d.gaze_tracking, d.therapy_sessions, d.children))


def gaze_of_a_session(d: Domain) -> DataFrame:
    """Session 40 as its owner lists it."""
    stored = Z.accepted_gaze(d.gaze_tracking, d.therapy_sessions, d.children)
    owner = d.therapy_sessions.where("session_id = 40").join(d.children, "child_id").select(F.col("caregiver_id").alias("caller"))
    asked = stored.where("session_id = 40").join(owner, F.col("caregiver_id") == F.col("caller")).drop("caller")
    return rounded(asked)


def routed_messages(d: Domain) -> DataFrame:
    return rounded(M.route_table(d.messages).withColumn("ts", F.col("ts").cast("timestamp_ntz")))


def session_members(d: Domain) -> DataFrame:
    return M.members(M.route_table(d.messages))


def broadcast_messages(d: Domain) -> DataFrame:
    """How many messages each connection receives, by type."""
    replies = M.route_table(d.messages)
    return M.fan_out(replies, M.members(replies)).groupBy("recipient", "type").agg(F.count("*").alias("n_messages"))


def room_messages(d: Domain) -> DataFrame:
    """How many messages each connection receives by type, of those sent while it was there."""
    replies = M.route_table(d.messages)
    return L.fan_out_at(replies, L.stays(replies)).groupBy("recipient", "type").agg(F.count("*").alias("n_messages"))


def maintained_rollup(d: Domain) -> DataFrame:
    """The roll-up folded from four batches of sessions, one of them twice."""
    kept = K.Rollup(d.spark, shared_folder(d.spark, "rollup"), 8)
    for k in (0, 1, 1, 2, 3):
        kept.add(d.answers.where(F.col("session_id") % 4 == k), d.therapy_sessions, k)
    return rounded(kept.read())


def maintained_adaptations(d: Domain) -> DataFrame:
    """Adaptations from three batches of answers that cut through sessions. The
    answers are made once: a batch is a filter, which would make them all again."""
    said = d.session_activities.join(d.utterances.select("item_id", F.col("actual").alias("response_text")), "item_id", "left")
    said = kept(said.select(*K.Adaptations.COLUMNS), "answers")
    live = K.Adaptations(d.spark, shared_folder(d.spark, "adaptations"), 8)
    for k in range(3):
        live.add(said.where(F.col("activity_id") % 3 == k), k)
    return rounded(live.read(d.activity_items))


def phoneme_comparisons(d: Domain) -> DataFrame:
    """The words of utterances by their places, compared by their phonemes where the lexicon has both."""
    words = d.utterances.select(
        "item_id", F.posexplode(F.arrays_zip(X.words_of("expected").alias("e"), X.words_of("actual").alias("a"))).alias("position", "w")
    ).select("item_id", "position", F.col("w.e").alias("expected"), F.col("w.a").alias("actual"))
    rows = with_phonemes(words.where("expected IS NOT NULL AND actual IS NOT NULL"), "expected", d.lexicon, "expected_phonemes")
    rows = C.compare_words(with_phonemes(rows, "actual", d.lexicon, "actual_phonemes"), phonemes=True)
    return rounded(rows.select("item_id", "position", "expected", "actual", "similarity_score", "error_type", F.size("phoneme_errors").alias("n_phoneme_errors"), "feedback_class", "tip"))


def guessed_phonemes(d: Domain) -> DataFrame:
    """Phonemes of all words of the conversations: listed ones as the lexicon has
    them, the others by a model that is fitted on it."""
    turns = W.scan(d.spark, f"{d.sf_dir}/conversations.parquet", "conversations")
    letters = F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1))
    words = turns.select(F.explode(letters).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return with_all_phonemes(words, "word", d.lexicon, spelling.fit(d.lexicon)).withColumn("phonemes", F.array_join("phonemes", " "))


def boosted_recommendations(d: Domain) -> DataFrame:
    """What boosted trees say that learnt each child's best category from its features."""
    features, rows = _labelled_features(d)
    return classifier.predict_boosted(features, classifier.boost(rows))


def _of(query: Callable[[Domain], DataFrame]) -> Query:
    return lambda spark, sf_dir: query(Domain(ship(spark), sf_dir))


CATALOG: dict[str, Callable[[Domain], DataFrame]] = {
    "performance_rollup": performance_rollup,
    "item_performance": item_performance,
    "skill_vectors": skill_vectors,
    "similar_children": similar,
    "similar_to_each": similar_to_each,
    "ml_features": ml_features,
    "child_profiles": child_profiles,
    "session_overview": session_overview,
    "session_history": session_history,
    "session_scores": session_scores,
    "session_rates": session_rates,
    "performance_details": performance_details,
    "feedback_history": feedback_history,
    "attempt_numbers": attempt_numbers,
    "category_stats_personalized": _stats("personalized"),
    "category_stats_generic": _stats("generic"),
    "progress_trend_7d": _trend(7),
    "progress_trend_30d": _trend(30),
    "progress_trend_365d": _trend(365),
    "improvement_areas": improvement_areas,
    "improvement_areas_now": improvement_areas_now,
    "category_recommendations": category_recommendations,
    "item_recommendations": _item_recommendations,
    "learning_paths": lambda d: rounded(_path(d)),
    "updated_targets": updated_targets,
    "current_paths": current_paths,
    "session_plans": session_plans,
    "recommended_in_category": recommended_in_category,
    "recommended_anywhere": recommended_anywhere,
    "session_adjustments": session_adjustments,
    "next_items": next_items,
    "next_activities": next_activities,
    "adaptations": adaptations,
    "rule_recommendations": rule_recommendations,
    "starter_activities": starter_activities,
    "suggested_items": suggested_items,
    "answer_options": answer_options,
    "fallback_recommendations": fallback_recommendations,
    "learnt_recommendations": learnt_recommendations,
    "combined_recommendations": combined_recommendations,
    "model_recommendations": model_recommendations,
    "profile_bundles": profile_bundles,
    "child_reports": child_reports,
    "report_blocks": report_blocks,
    "sentence_normals": sentence_normals,
    "edit_scores": edit_scores,
    "sentence_matches": sentence_matches,
    "graded_answers": graded_answers,
    "conversation_stutter": conversation_stutter,
    "echolalic_turns": echolalic_turns,
    "word_variants": word_variants,
    "stored_training": stored_training,
    "appended_feedback": appended_feedback,
    "sentence_scores": sentence_scores,
    "word_scores": word_scores,
    "attempt_facts": attempt_facts,
    "word_comparisons": word_comparisons,
    "phoneme_comparisons": phoneme_comparisons,
    "guessed_phonemes": guessed_phonemes,
    "boosted_recommendations": boosted_recommendations,
    "upserted_rollup": upserted_rollup,
    "maintained_rollup": maintained_rollup,
    "maintained_adaptations": maintained_adaptations,
    "deletable_items": deletable_items,
    "owned_children": owned_children,
    "audio_addresses": audio_addresses,
    "replaced_interests": replaced_interests,
    "updated_items": updated_items,
    "event_rates": event_rates,
    "gaze_summary": gaze_summary,
    "stored_gaze": stored_gaze,
    "gaze_of_a_session": gaze_of_a_session,
    "routed_messages": routed_messages,
    "session_members": session_members,
    "broadcast_messages": broadcast_messages,
    "room_messages": room_messages,
}


def queries() -> dict[str, Query]:
    return {name: _of(query) for name, query in CATALOG.items()}


def oracle_sql() -> dict[str, str]:
    return {name: with_views(sql) for name, sql in ORACLES.items()}
