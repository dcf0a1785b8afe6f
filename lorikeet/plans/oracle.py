"""The registered queries as SQL over the domain views, for another engine."""

from __future__ import annotations

from lorikeet.plans.scoring_oracle import SCORING
from lorikeet.sources.domain import AS_OF

_PERF_COLS = "child_id, category_id, verbal_attempts, verbal_success, selection_attempts, selection_success"
_VECTOR = """
  SELECT c.child_id, CAST(coalesce(va, 0) AS BIGINT) AS verbal_attempts, CAST(coalesce(sa, 0) AS BIGINT) AS selection_attempts,
         CASE WHEN va > 0 THEN vs / va ELSE 0.0 END AS verbal_rate, CASE WHEN sa > 0 THEN ss / sa ELSE 0.0 END AS selection_rate,
         coalesce(score, 0.0) AS avg_score, coalesce(n, 0) AS n_categories
  FROM children c LEFT JOIN (
    SELECT child_id, sum(verbal_attempts) AS va, sum(verbal_success) AS vs, sum(selection_attempts) AS sa,
           sum(selection_success) AS ss, avg(overall_score) AS score, count(DISTINCT category_id) AS n
    FROM child_performance GROUP BY child_id) p USING (child_id)"""
_PROFILE = """
  SELECT c.child_id, coalesce(strengths, []) AS strengths, coalesce(challenges, []) AS challenges,
         coalesce(score, 0.0) AS avg_score,
         CASE WHEN coalesce(score, 0) > 0.75 THEN 'hard' WHEN coalesce(score, 0) > 0.5 THEN 'medium' ELSE 'easy' END
           AS recommended_level,
         CASE WHEN va > 0 AND sa > 0 THEN CASE WHEN vs / va > ss / sa THEN 'verbal' ELSE 'nonverbal' END END
           AS preferred_modality
  FROM children c LEFT JOIN (
    SELECT child_id, list(category_id ORDER BY category_id) FILTER (WHERE overall_score >= 0.7) AS strengths,
           list(category_id ORDER BY category_id) FILTER (WHERE overall_score <= 0.3) AS challenges,
           avg(overall_score) AS score, sum(verbal_attempts) AS va, sum(verbal_success) AS vs,
           sum(selection_attempts) AS sa, sum(selection_success) AS ss
    FROM child_performance GROUP BY child_id) p USING (child_id)"""
_FIRST_FEEDBACK = """
  SELECT session_id, rating, feedback_type FROM (
    SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY created_at, feedback_id) AS n
    FROM caregiver_feedback WHERE session_id IS NOT NULL) WHERE n = 1"""
_SCORES = """
  SELECT child_id, session_id, category_id, start_time, sum(coalesce(pronunciation_score, 0)) / count(*) AS score
  FROM therapy_sessions JOIN session_activities USING (session_id) GROUP BY ALL"""
_PATH = f"""
  SELECT child_id, category_id, name AS category_name,
         CASE seg WHEN 1 THEN 'strength' WHEN 2 THEN 'new_at_level' ELSE 'challenge' END AS reason,
         CAST(CASE seg WHEN 1 THEN 0.9 WHEN 2 THEN 0.7 ELSE 0.5 END AS DOUBLE) AS target_score,
         CASE WHEN seg = 3 THEN 'verbal_prompts' END AS support,
         CAST(row_number() OVER (PARTITION BY child_id ORDER BY seg, CASE difficulty_level WHEN 'easy' THEN 1
           WHEN 'medium' THEN 2 WHEN 'hard' THEN 3 ELSE 4 END, name) AS INTEGER) AS priority, 'pending' AS status
  FROM (SELECT *, CASE WHEN list_contains(strengths, category_id) THEN 1 WHEN list_contains(challenges, category_id) THEN 3
          WHEN difficulty_level = recommended_level THEN 2 END AS seg
        FROM ({_PROFILE}) CROSS JOIN activity_categories) WHERE seg IS NOT NULL"""
_RECENT = """
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, activity_id DESC) AS n
    FROM session_activities) WHERE n <= 5"""
_ITEM_PERF = """
  SELECT child_id, item_id, count(*) FILTER (WHERE response_type = 'verbal') AS verbal_attempts,
         count(*) FILTER (WHERE response_type = 'verbal' AND is_correct) AS verbal_success,
         count(*) FILTER (WHERE response_type = 'nonverbal') AS selection_attempts,
         count(*) FILTER (WHERE response_type = 'nonverbal' AND is_correct) AS selection_success,
         count(*) AS total_attempts,
         count(*) FILTER (WHERE response_type IN ('verbal', 'nonverbal') AND is_correct) / count(*) AS success_rate
  FROM session_activities JOIN therapy_sessions USING (session_id) GROUP BY ALL"""

def _items_for(pairs: str) -> str:
    return f"""
  SELECT child_id, category_id, CAST(rank AS INTEGER) AS rank, item_id, name, level AS difficulty FROM (
    SELECT *, row_number() OVER (PARTITION BY child_id, category_id ORDER BY CASE WHEN known THEN coalesce(success_rate, 1) END,
             CASE WHEN known THEN coalesce(difficulty_level = level, false) END, item_id) AS rank
    FROM (SELECT p.child_id, p.category_id, overall_score IS NOT NULL AS known,
                 CASE WHEN overall_score IS NULL THEN coalesce(c.difficulty_level, 'easy') WHEN overall_score < 0.4 THEN 'easy'
                      WHEN overall_score < 0.7 THEN 'medium' ELSE 'hard' END AS level, c.difficulty_level AS category_level
          FROM ({pairs}) p JOIN activity_categories c USING (category_id)
          LEFT JOIN child_performance USING (child_id, category_id)) w
    JOIN activity_items i USING (category_id) LEFT JOIN ({_ITEM_PERF}) USING (child_id, item_id)
    WHERE coalesce(i.difficulty_level, category_level) = level) WHERE rank <= 5"""


_ITEMS_FOR = _items_for("SELECT DISTINCT child_id, category_id FROM therapy_sessions")


def _stats(kind: str) -> str:
    return f"""
  SELECT ch.child_id, c.category_id, c.name, c.difficulty_level, i.child_id IS NOT NULL AS is_selected,
         CASE WHEN i.child_id IS NOT NULL THEN 1 ELSE 2 END AS display_priority, coalesce(item_count, 0) AS item_count,
         coalesce(total_attempts, 0) AS total_attempts, round(correct / tried * 100, 6) AS latest_performance, last_attempt_date
  FROM children ch CROSS JOIN activity_categories c
  LEFT JOIN child_category i ON i.child_id = ch.child_id AND i.category_id = c.category_id
  LEFT JOIN (SELECT category_id, count(item_id) AS item_count FROM activity_items GROUP BY ALL) n ON n.category_id = c.category_id
  LEFT JOIN (SELECT s.child_id, it.category_id, count(*) AS tried, count(DISTINCT a.session_id) AS total_attempts,
               count(*) FILTER (WHERE is_correct) AS correct, max(created_at) AS last_attempt_date
             FROM session_activities a JOIN activity_items it USING (item_id) JOIN therapy_sessions s USING (session_id)
             GROUP BY ALL) t ON t.child_id = ch.child_id AND t.category_id = c.category_id
  WHERE c.type = '{kind}'"""


def _window(days: int) -> str:
    return f"start_time BETWEEN TIMESTAMP '{AS_OF}' - INTERVAL {days} DAY AND TIMESTAMP '{AS_OF}'"


def _trend(days: int) -> str:
    return f"""
  SELECT c.child_id, CAST(coalesce(n, 0) AS INTEGER) AS n_weeks,
         CASE WHEN n IS NULL THEN 'no data' WHEN n <= 1 THEN 'insufficient data' WHEN last > first THEN 'improving'
              WHEN last < first THEN 'declining' ELSE 'stable' END AS trend,
         CASE WHEN n > 1 THEN round(abs((last - first) / n), 6) ELSE 0.0 END AS rate,
         CASE WHEN n > 1 THEN round(last, 6) END AS current_score, CASE WHEN n > 1 THEN round(first, 6) END AS starting_score
  FROM children c LEFT JOIN (
    SELECT child_id, arg_min(mean, week) AS first, arg_max(mean, week) AS last,
           date_diff('day', min(week), max(week)) // 7 + 1 AS n
    FROM (SELECT child_id, date_trunc('week', start_time)::DATE AS week, avg(score) AS mean
          FROM ({_SCORES}) WHERE {_window(days)} GROUP BY ALL) GROUP BY child_id) w USING (child_id)"""


def _areas(short: int, long: int) -> str:
    return f"""
  WITH s AS (SELECT sc.child_id, sc.start_time, sc.score, c.name AS category FROM ({_SCORES}) sc
             JOIN activity_categories c USING (category_id)),
  r AS (SELECT child_id, category, row_number() OVER (PARTITION BY child_id ORDER BY count(*) DESC, category) AS rank
        FROM s WHERE score < 0.6 AND {_window(short)} GROUP BY child_id, category),
  m AS (SELECT child_id, category, avg(score) AS mean FROM s WHERE {_window(long)} GROUP BY ALL)
  SELECT c.child_id, o.recent_challenges, l.long_term_focus FROM children c
  LEFT JOIN (SELECT child_id, string_agg(category, ', ' ORDER BY rank) AS recent_challenges FROM r WHERE rank <= 3
             GROUP BY child_id) o USING (child_id)
  LEFT JOIN (SELECT child_id, category AS long_term_focus FROM m
             QUALIFY row_number() OVER (PARTITION BY child_id ORDER BY mean, category) = 1) l USING (child_id)"""


_GAZE = """
  SELECT event_id AS gaze_id, s.session_id, user_id AS child_id, event_id % 600 * 1000 AS session_duration,
         round(value, 6) AS on_screen_percentage, c.caregiver_id
  FROM events JOIN therapy_sessions s ON event_id // 3 = s.session_id JOIN children c ON c.child_id = s.child_id
  WHERE user_id IN (SELECT child_id FROM children)"""
_UP = """
  SELECT c.category_id, c.name AS category, string_agg(i.name, ', ' ORDER BY i.item_id) AS names FROM activity_categories c
  LEFT JOIN (SELECT i.* FROM activity_items i JOIN activity_categories c USING (category_id)
    WHERE i.difficulty_level = CASE WHEN c.difficulty_level = 'easy' THEN 'medium' ELSE 'hard' END
    QUALIFY row_number() OVER (PARTITION BY category_id ORDER BY item_id) <= 5) i USING (category_id) GROUP BY ALL"""
_STARTERS = """
  SELECT string_agg(c.name || ': ' || coalesce(names, ''), '|' ORDER BY category_id) FROM (
    SELECT * FROM activity_categories WHERE difficulty_level = 'easy' ORDER BY category_id LIMIT 3) c
  LEFT JOIN (SELECT category_id, string_agg(name, ', ' ORDER BY item_id) AS names FROM (SELECT * FROM activity_items
    QUALIFY row_number() OVER (PARTITION BY category_id ORDER BY item_id) <= 3) GROUP BY category_id) USING (category_id)"""
_PLAN = """
  SELECT c.child_id, coalesce(f.category_id, (SELECT min(category_id) FROM activity_categories WHERE difficulty_level = 'easy')) AS category_id
  FROM children c LEFT JOIN (SELECT child_id, category_id FROM child_performance WHERE category_id IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY child_id ORDER BY overall_score, category_id) = 1) f USING (child_id)"""

#: All items of each category in blocks of a thousand.
_BLOCKS = """listed AS (
    SELECT category_id, item_id, i.name || coalesce(' (' || coalesce(i.difficulty_level, l.difficulty_level) || ')', '') AS shown,
           (row_number() OVER (PARTITION BY category_id ORDER BY item_id) - 1) // 1000 AS block
    FROM activity_items i JOIN activity_categories l USING (category_id)),
  blocks AS (
    SELECT category_id, CAST(block AS INTEGER) AS block, count(*) AS n_items, string_agg(shown, '; ' ORDER BY item_id) AS text,
           sha256(string_agg(shown, '; ' ORDER BY item_id)) AS block_id
    FROM listed GROUP BY category_id, block)"""

ORACLES: dict[str, str] = {
    "performance_rollup": f"SELECT {_PERF_COLS}, round(overall_score, 6) AS overall_score FROM child_performance",
    "item_performance": f"SELECT * REPLACE (round(success_rate, 6) AS success_rate) FROM ({_ITEM_PERF})",
    "skill_vectors": f"""SELECT * REPLACE (round(verbal_rate, 6) AS verbal_rate, round(selection_rate, 6) AS selection_rate,
        round(avg_score, 6) AS avg_score) FROM ({_VECTOR})""",
    "similar_children": f"""
  WITH v AS ({_VECTOR}), n AS (SELECT *, sqrt(verbal_attempts::DOUBLE * verbal_attempts + selection_attempts::DOUBLE * selection_attempts
      + verbal_rate * verbal_rate + selection_rate * selection_rate + avg_score * avg_score + n_categories::DOUBLE * n_categories) AS norm FROM v),
  p AS (SELECT a.child_id, b.child_id AS similar_id, round((a.verbal_attempts::DOUBLE * b.verbal_attempts
      + a.selection_attempts::DOUBLE * b.selection_attempts + a.verbal_rate * b.verbal_rate + a.selection_rate * b.selection_rate
      + a.avg_score * b.avg_score + a.n_categories::DOUBLE * b.n_categories) / nullif(a.norm * b.norm, 0), 9) AS similarity
    FROM n a JOIN n b ON a.child_id <> b.child_id WHERE a.child_id % 50 = 0)
  SELECT child_id, similar_id, similarity, CAST(rank AS INTEGER) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY child_id ORDER BY similarity DESC NULLS LAST, similar_id) AS rank FROM p)
  WHERE rank <= 5""",
    "ml_features": f"""
  SELECT child_id, round(verbal_rate, 6) AS verbal_accuracy, round(selection_rate, 6) AS selection_accuracy,
         round(coalesce(d.rank, 1.0), 6) AS category_difficulty, round(coalesce(t.minutes, 0.0), 6) AS time_spent,
         round(avg_score, 6) AS success_rate, verbal_attempts + selection_attempts AS previous_attempts,
         round(verbal_rate * 0.6::DOUBLE + selection_rate * 0.4::DOUBLE, 6) AS confidence_score
  FROM ({_VECTOR}) LEFT JOIN (
    SELECT child_id, avg(CASE difficulty_level WHEN 'medium' THEN 2 WHEN 'hard' THEN 3 ELSE 1 END) AS rank
    FROM (SELECT DISTINCT child_id, category_id FROM therapy_sessions) JOIN activity_categories USING (category_id)
    GROUP BY child_id) d USING (child_id)
  LEFT JOIN (SELECT child_id, avg(date_diff('second', start_time, end_time) / 60) AS minutes FROM therapy_sessions
    WHERE end_time IS NOT NULL GROUP BY child_id) t USING (child_id)""",
    "child_profiles": f"""SELECT * REPLACE (array_to_string(strengths, '|') AS strengths,
        array_to_string(challenges, '|') AS challenges, round(avg_score, 6) AS avg_score) FROM ({_PROFILE})""",
    "session_overview": """
  SELECT s.session_id, ch.name AS child_name, c.name AS category_name, s.start_time,
         CAST(coalesce(date_diff('second', s.start_time, s.end_time) / 60, 0) AS DOUBLE) AS duration_minutes,
         coalesce(total, 0) AS total_activities, coalesce(correct, 0) AS correct_answers,
         round(coalesce(correct / total * 100, 0), 6) AS accuracy_percentage,
         round(coalesce(response, 0), 6) AS average_response_time,
         coalesce(array_to_string(strong, '|'), '') AS strengths, coalesce(array_to_string(weak, '|'), '') AS areas_for_improvement,
         CASE WHEN coalesce(correct / total * 100, 0) < 50 THEN 'basics' WHEN correct / total * 100 < 75 THEN 'practice'
              ELSE 'ready' END AS advice, coalesce(len(weak) > 3, false) AS few_at_a_time
  FROM therapy_sessions s JOIN children ch USING (child_id) LEFT JOIN activity_categories c USING (category_id)
  LEFT JOIN (
    SELECT session_id, count(*) AS total, count(*) FILTER (WHERE is_correct) AS correct,
           avg(nullif(response_time_seconds, 0)) AS response,
           list_sort(list(DISTINCT name) FILTER (WHERE coalesce(is_correct, false))) AS strong,
           list_sort(list(DISTINCT name) FILTER (WHERE NOT coalesce(is_correct, false))) AS weak
    FROM session_activities JOIN activity_items USING (item_id) GROUP BY session_id) f USING (session_id)""",
    "session_history": f"""
  SELECT h.child_id, CAST(rank AS INTEGER) AS rank, h.session_id, CAST(start_time AS DATE) AS date, c.name AS category,
         CAST(date_diff('second', start_time, end_time) / 60 AS DOUBLE) AS duration_minutes,
         round(coalesce(correct / total, 0), 6) AS score, f.rating AS feedback_rating, f.feedback_type
  FROM (SELECT *, row_number() OVER (PARTITION BY child_id ORDER BY start_time DESC, session_id DESC) AS rank
        FROM therapy_sessions) h
  LEFT JOIN (SELECT session_id, count(*) AS total, count(*) FILTER (WHERE is_correct) AS correct FROM session_activities
             GROUP BY session_id) a USING (session_id)
  LEFT JOIN ({_FIRST_FEEDBACK}) f USING (session_id) LEFT JOIN activity_categories c USING (category_id)
  WHERE rank <= 10""",
    "session_scores": f"SELECT * REPLACE (round(score, 6) AS score) FROM ({_SCORES})",
    "session_rates": f"""
  SELECT session_id, round(so_far, 6) AS success_rate, round(recent, 6) AS recent_rate, n_recent
  FROM (SELECT session_id, avg(is_correct::INTEGER) AS so_far FROM session_activities GROUP BY session_id)
  JOIN (SELECT session_id, count(*) FILTER (WHERE is_correct) / count(*) AS recent, count(*) AS n_recent
        FROM ({_RECENT}) GROUP BY session_id) USING (session_id)""",
    "performance_details": """
  SELECT child_id, coalesce(c.name, 'General') AS category, round(overall_score, 6) AS overall_score,
         round(CASE WHEN verbal_attempts > 0 THEN verbal_success / verbal_attempts ELSE 0 END, 6) AS verbal_accuracy,
         round(CASE WHEN selection_attempts > 0 THEN selection_success / selection_attempts ELSE 0 END, 6) AS selection_accuracy
  FROM child_performance LEFT JOIN activity_categories c USING (category_id)""",
    "feedback_history": """
  SELECT f.child_id, CAST(rank AS INTEGER) AS rank, feedback_id, f.session_id, rating, feedback_type, created_at, c.name AS category
  FROM (SELECT *, row_number() OVER (PARTITION BY child_id ORDER BY created_at DESC, feedback_id DESC) AS rank
        FROM caregiver_feedback) f LEFT JOIN therapy_sessions s USING (session_id)
  LEFT JOIN activity_categories c USING (category_id) WHERE rank <= 5""",
    "attempt_numbers": """
  SELECT activity_id, session_id, item_id, CAST(row_number() OVER (PARTITION BY session_id, item_id
           ORDER BY created_at, activity_id) AS INTEGER) AS attempt_number FROM session_activities""",
    "category_stats_personalized": _stats("personalized"),
    "category_stats_generic": _stats("generic"),
    "progress_trend_7d": _trend(7),
    "progress_trend_30d": _trend(30),
    "progress_trend_365d": _trend(365),
    "improvement_areas": _areas(90, 365),
    "improvement_areas_now": _areas(7, 30),
    "category_recommendations": """
  SELECT child_id, CAST(row_number() OVER (PARTITION BY child_id ORDER BY sort_key DESC, category_id) AS INTEGER) AS rank,
         category_id, name, reason, round(sort_key, 6) AS sort_key
  FROM (SELECT ch.child_id, c.category_id, c.name,
               CASE WHEN p.overall_score IS NULL THEN 'new_easy' ELSE 'room_to_improve' END AS reason,
               CASE WHEN p.overall_score IS NULL THEN 0.0 ELSE 1 - p.overall_score END AS sort_key
        FROM children ch CROSS JOIN activity_categories c
        LEFT JOIN child_performance p ON p.child_id = ch.child_id AND p.category_id = c.category_id
        WHERE (p.overall_score IS NULL AND c.difficulty_level = 'easy') OR 1 - p.overall_score > 0.3)""",
    "item_recommendations": _ITEMS_FOR,
    "learning_paths": _PATH,
    "updated_targets": f"""
  SELECT child_id, category_id, priority, round(CASE WHEN overall_score > target_score * 0.9::DOUBLE THEN least(1.0, target_score + 0.1::DOUBLE)
           WHEN overall_score < target_score * 0.5::DOUBLE THEN greatest(0.3::DOUBLE, target_score - 0.1::DOUBLE) ELSE target_score END, 6) AS target_score
  FROM ({_PATH}) LEFT JOIN child_performance USING (child_id, category_id)""",
    "current_paths": f"""
  SELECT child_id, category_id, target_score, priority, CASE WHEN child_id % 2 = 1 THEN 'active' ELSE status END AS status,
         round(coalesce(overall_score, 0), 6) AS current_score
  FROM ({_PATH}) LEFT JOIN child_performance USING (child_id, category_id)""",
    "session_plans": f"""
  SELECT child_id, category_id, 'adaptive' AS current_level, coalesce(ids, '') AS item_ids FROM ({_PLAN}) LEFT JOIN (
    SELECT child_id, string_agg(item_id, '|' ORDER BY rank) AS ids FROM ({_items_for(_PLAN)}) GROUP BY child_id) USING (child_id)""",
    "recommended_in_category": _items_for("SELECT child_id, 0 AS category_id FROM children"),
    "session_adjustments": f"""
  WITH o AS (
    SELECT s.session_id, s.child_id, s.category_id, CASE WHEN rate > 0.75 THEN 'up' WHEN rate < 0.4 THEN 'down' ELSE 'same' END AS move
    FROM therapy_sessions s JOIN (SELECT session_id, avg(is_correct::INTEGER) AS rate FROM session_activities GROUP BY 1) USING (session_id)
    WHERE NOT is_completed AND rate IS NOT NULL),
  f AS (
    SELECT category_id, item_id, move, row_number() OVER (PARTITION BY category_id, move ORDER BY item_id) AS place
    FROM activity_items JOIN (VALUES ('up', 'medium'), ('up', 'hard'), ('down', 'easy'), ('down', 'medium')) m(move, lev)
      ON difficulty_level = lev),
  a AS (
    SELECT session_id, o.move, place, item_id FROM o JOIN f USING (category_id, move) WHERE place <= 3
    UNION ALL
    SELECT session_id, move, rank, item_id FROM o JOIN ({_ITEMS_FOR}) USING (child_id, category_id) WHERE move = 'same' AND rank <= 3)
  SELECT session_id, move, CAST(place AS INTEGER) AS place, item_id FROM a
  WHERE (session_id, item_id) NOT IN (SELECT (session_id, item_id) FROM session_activities)""",
    "next_items": """
  SELECT s.session_id, n.item_id AS next_item_id, n.item_id IS NULL AS is_complete FROM therapy_sessions s LEFT JOIN (
    SELECT s.session_id, min(i.item_id) AS item_id FROM therapy_sessions s
    JOIN activity_items i ON i.category_id = s.category_id AND i.difficulty_level = s.current_level
    ANTI JOIN session_activities a ON a.session_id = s.session_id AND a.item_id = i.item_id
    GROUP BY s.session_id) n USING (session_id)""",
    "rule_recommendations": f"""
  WITH p AS (SELECT child_id, category_id, overall_score, c.name FROM child_performance JOIN activity_categories c USING (category_id)),
  w AS (SELECT child_id, string_agg(name, '|' ORDER BY category_id) AS x,
               string_agg(name || ': ' || coalesce(names, ''), '|' ORDER BY category_id) AS y
        FROM (SELECT * FROM p WHERE overall_score < 0.6 QUALIFY row_number() OVER (PARTITION BY child_id ORDER BY category_id) <= 3)
        LEFT JOIN ({_UP}) USING (category_id) GROUP BY child_id),
  g AS (SELECT child_id, string_agg(name, '|' ORDER BY category_id) AS x FROM (SELECT * FROM p WHERE overall_score >= 0.8
        QUALIFY row_number() OVER (PARTITION BY child_id ORDER BY category_id) <= 2) GROUP BY child_id),
  b AS (SELECT child_id, avg(overall_score) AS mean, arg_min(name, (-overall_score, name)) AS best, arg_min(name, (overall_score, name)) AS worst
        FROM p GROUP BY child_id)
  SELECT c.child_id, coalesce(w.x, '') AS practice_more,
         CASE WHEN mean IS NULL THEN ({_STARTERS}) ELSE coalesce(w.y, '') END AS next_activities, coalesce(g.x, '') AS encouraged_by, round(mean, 6) AS average_score,
         best AS strongest_category, worst AS weakest_category,
         CASE WHEN mean IS NULL THEN 'new_learner' WHEN g.x IS NOT NULL THEN 'praise' ELSE 'keep_practising' END AS encouragement
  FROM children c LEFT JOIN w USING (child_id) LEFT JOIN g USING (child_id) LEFT JOIN b USING (child_id)""",
    "starter_activities": f"SELECT child_id, ({_STARTERS}) AS next_activities, 'new_learner' AS encouragement FROM children WHERE child_id NOT IN (SELECT child_id FROM therapy_sessions JOIN session_activities USING (session_id) WHERE {_window(90)})",
    "suggested_items": """
  SELECT category_id, c.name AS category, CAST(row_number() OVER (PARTITION BY category_id ORDER BY item_id) AS INTEGER) AS rank,
         item_id, i.name FROM activity_items i JOIN activity_categories c USING (category_id)
  WHERE i.difficulty_level = CASE WHEN c.difficulty_level = 'easy' THEN 'medium' ELSE 'hard' END
  QUALIFY row_number() OVER (PARTITION BY category_id ORDER BY item_id) <= 5""",
    "next_activities": f"""
  WITH l AS (SELECT i.*, coalesce(i.difficulty_level, c.difficulty_level) AS level,
      row_number() OVER (PARTITION BY category_id ORDER BY item_id) AS up,
      row_number() OVER (PARTITION BY category_id ORDER BY item_id DESC) AS down,
      count(*) OVER (PARTITION BY category_id) AS size FROM activity_items i JOIN activity_categories c USING (category_id)),
  b AS (SELECT l.*, band, bool_or(band = level) OVER (PARTITION BY category_id, band) AS has_level
        FROM l CROSS JOIN (VALUES ('new'), ('easy'), ('hard'), ('medium')) v(band)),
  pool AS (SELECT * FROM b WHERE band = 'new' OR CASE WHEN has_level THEN band = level WHEN band = 'easy' THEN up <= 3
        WHEN band = 'hard' THEN down <= 3 ELSE size <= 6 OR (up > 3 AND down > 3) END),
  s AS (SELECT t.session_id, t.category_id, CASE WHEN overall_score IS NULL OR overall_score < 0.1 THEN 'new' WHEN overall_score < 0.4
          THEN 'easy' WHEN overall_score > 0.8 THEN 'hard' ELSE 'medium' END AS band, preferred_modality AS mode
        FROM therapy_sessions t LEFT JOIN child_performance USING (child_id, category_id) LEFT JOIN ({_PROFILE}) USING (child_id)),
  a AS (SELECT DISTINCT session_id, item_id, true AS tried FROM session_activities)
  SELECT session_id, band, item_id AS next_item_id FROM s JOIN pool p USING (category_id, band) LEFT JOIN a USING (session_id, item_id)
  QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY band <> 'new' AND coalesce(tried, false),
    CASE WHEN band = 'new' THEN level WHEN mode = 'verbal' THEN CASE WHEN audio_url IS NULL THEN '0' ELSE '1' END
         WHEN mode = 'nonverbal' THEN CASE WHEN image_url IS NULL THEN '0' ELSE '1' END END,
    CASE WHEN band <> 'new' AND mode IS NOT NULL THEN difficulty_level END NULLS LAST, item_id) = 1""",
    "fallback_recommendations": f"""
  SELECT child_id, CASE WHEN avg_score > 0.8 THEN 'Actions' WHEN avg_score > 0.6 THEN 'Objects' ELSE 'Animals' END
    AS ml_recommendation FROM ({_VECTOR})""",
    "sentence_normals": """
  SELECT item_id, array_to_string(list_filter(string_split(regexp_replace(lower(expected), '[^a-z ]', '', 'g'), ' '), lambda x: x <> ''), ' ')
    AS normal, replace(lower(expected), ' ', '') AS item_name FROM utterances""",
    "sentence_matches": """
  WITH w AS (SELECT item_id, string_split(lower(trim(expected)), ' ') AS e, string_split(lower(trim(actual)), ' ') AS a FROM utterances),
  r AS (SELECT item_id, len(e) AS n, len(list_filter(list_zip(e, a), lambda x: x[1] = x[2])) AS k FROM w)
  SELECT item_id, round_even(k / n, 2) AS similarity_score, k = n AS is_correct, CAST(k AS INTEGER) AS correct_word_count,
         CAST(n AS INTEGER) AS total_word_count FROM r""",
    "graded_answers": """
  SELECT item_id, lower(trim(expected)) = lower(trim(actual)) AS is_correct, 'generic' AS response_type FROM utterances""",
    "upserted_rollup": f"SELECT {_PERF_COLS}, round(overall_score, 6) AS overall_score FROM child_performance",
    "deletable_items": """
  SELECT item_id, name FROM (SELECT item_id, name FROM activity_items UNION ALL SELECT -item_id - 1, 'draft of ' || name FROM activity_items)
  WHERE item_id NOT IN (SELECT item_id FROM session_activities WHERE item_id IS NOT NULL)""",
    "owned_children": "SELECT * FROM children WHERE caregiver_id = 7",
    "audio_addresses": "SELECT item_id, coalesce(audio_url, 'audio/' || lower(name) || '.mp3') AS audio_url FROM activity_items",
    "stored_gaze": _GAZE,
    "gaze_of_a_session": f"{_GAZE} AND s.session_id = 40",
    "replaced_interests": """
  SELECT child_id, category_id FROM child_category WHERE child_id NOT IN (SELECT child_id FROM children WHERE child_id % 10 = 0)
  UNION ALL SELECT child_id, 0 FROM children WHERE child_id % 10 = 0""",
    "updated_items": "SELECT item_id, name, coalesce(difficulty_level, 'medium') AS difficulty_level FROM activity_items",
    "event_rates": """
  SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n_events, round(avg(value), 6) AS mean_value
  FROM events GROUP BY ALL""",
    "gaze_summary": """
  SELECT user_id AS child_id, count(*) AS n_points, round(avg(value), 6) AS on_screen_percentage FROM events GROUP BY ALL""",
    "profile_bundles": f"""
  SELECT c.child_id, c.name, CAST(coalesce(p, 0) AS INTEGER) AS n_performances, CAST(coalesce(s, 0) AS INTEGER) AS n_sessions,
         coalesce(f, '') AS newest_feedback
  FROM children c LEFT JOIN (SELECT child_id, count(*) AS p FROM child_performance GROUP BY 1) USING (child_id)
  LEFT JOIN (SELECT child_id, count(*) AS s FROM therapy_sessions WHERE {_window(30)} GROUP BY 1) USING (child_id)
  LEFT JOIN (SELECT child_id, string_agg(CAST(feedback_id AS VARCHAR), '|' ORDER BY rank) AS f FROM (
    SELECT *, row_number() OVER (PARTITION BY child_id ORDER BY created_at DESC, feedback_id DESC) AS rank FROM caregiver_feedback)
    WHERE rank <= 5 GROUP BY 1) USING (child_id)""",
    "report_blocks": f"WITH {_BLOCKS} SELECT category_id, block, n_items, text, block_id FROM blocks",
    "child_reports": f"""
  WITH {_BLOCKS}, lists AS (
    SELECT category_id, sum(n_items) AS n_items, sha256(string_agg(block_id, ',' ORDER BY block)) AS list_id FROM blocks GROUP BY category_id)
  SELECT c.child_id, 'Learner: ' || c.name || coalesce(chr(10) || 'Scores:' || chr(10) || lines, chr(10) || 'No scores yet')
           || CASE WHEN lines IS NOT NULL AND f.rating IS NOT NULL THEN chr(10) || 'Latest rating: ' || f.rating ELSE '' END AS report
  FROM children c LEFT JOIN (
    SELECT child_id, string_agg(k.name || ' ' || CAST(round_even(overall_score * 100, 0) AS INTEGER) || '%'
             || coalesce(' [' || CAST(n_items AS BIGINT) || ' items: ' || list_id || ']', ''), chr(10) ORDER BY k.name) AS lines
    FROM child_performance JOIN activity_categories k USING (category_id) LEFT JOIN lists USING (category_id) GROUP BY child_id) USING (child_id)
  LEFT JOIN (SELECT child_id, session_id FROM therapy_sessions
    QUALIFY row_number() OVER (PARTITION BY child_id ORDER BY start_time DESC, session_id DESC) = 1) USING (child_id)
  LEFT JOIN ({_FIRST_FEEDBACK}) f USING (session_id)""",
}

ORACLES["recommended_anywhere"] = ORACLES["category_recommendations"]
ORACLES |= SCORING
ORACLES["combined_recommendations"] = f"""
  SELECT r.*, m.ml_recommendation, c.confidence_score FROM ({ORACLES["rule_recommendations"]}) r
  JOIN ({ORACLES["fallback_recommendations"]}) m USING (child_id) JOIN ({ORACLES["ml_features"]}) c USING (child_id)"""
ORACLES["similar_to_each"] = ORACLES["similar_children"].replace(" WHERE a.child_id % 50 = 0", "")
# kept up to date batch by batch, they are what one pass gives
ORACLES["maintained_rollup"] = ORACLES["performance_rollup"]
ORACLES["maintained_adaptations"] = ORACLES["adaptations"]
# what is written comes back
ORACLES["stored_training"] = ORACLES["ml_features"]
ORACLES["appended_feedback"] = "SELECT feedback_id, session_id, child_id, rating, created_at FROM caregiver_feedback WHERE rating BETWEEN 1 AND 5"
