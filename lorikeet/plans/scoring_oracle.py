"""Scoring of transcripts, answer options and messages as SQL, for another engine.

Phonetic codes have no SQL form; those of the words of item names stand in a
table of values, worked out by hand from the published rules.
"""

from __future__ import annotations

from lorikeet.functions.text import CONFUSIONS, MESSAGES, SOUND_GROUPS, TIPS
from lorikeet.sources.domain import AS_OF, PHONEMES

_GROUPS = "[" + ", ".join("[" + ", ".join(f"'{s}'" for s in g) + "]" for g in SOUND_GROUPS) + "]"


# The double metaphone codes of the words, main and other ("" where there is no other).
_FIRST = {
    "large": ("LRJ", "LRK"), "small": ("SML", "XML"), "red": ("RT", ""), "cold": ("KLT", ""), "hot": ("HT", ""), "new": ("N", "NF"),
    "blue": ("PL", ""), "old": ("ALT", ""),
}
_SECOND = {
    "gizmo": ("JSM", "KSM"), "ring": ("RNK", ""), "gear": ("JR", "KR"), "widget": ("AJT", "FJT"), "plate": ("PLT", ""), "bolt": ("PLT", ""),
    "rod": ("RT", ""), "anvil": ("ANFL", ""),
}
#: Within a name: a W that ends no word, or starts none, is silent, and so is a vowel that isn't first.
_INSIDE = {"new": ("N", ""), "widget": ("JT", ""), "anvil": ("NFL", "")}
#: A W anywhere gives Z another sound in the other code.
_NAMES = {"new gizmo": ("NJSM", "NKTSM")}


def _name_code(first: str, second: str) -> tuple[str, str]:
    (a, x), (b, y) = (_INSIDE.get(w) or table[w] for w, table in ((first, _FIRST), (second, _SECOND)))
    other = (x or a) + (y or b)
    return _NAMES.get(f"{first} {second}") or (a + b, other if other != a + b else "")


def _codes(found: dict[str, tuple[str, str]]) -> str:
    rows = ", ".join(f"('{w}', '{main}', '{other}')" for w, (main, other) in found.items())
    return f"(SELECT * FROM (VALUES {rows}) t(word, main, other))"


_WORD_CODES = _codes(_FIRST | _SECOND)
_NAME_CODES = _codes({f"{a} {b}": _name_code(a, b) for a in _FIRST for b in _SECOND})


def _group(letter: str) -> str:
    return f"list_filter({_GROUPS}, lambda g: list_contains(g, {letter}))[1]"


def _unlike(e: str, a: str) -> str:
    """Places where letters differ whose first groups share no sound."""
    x, y = f"substr({e}, i, 1)", f"substr({a}, i, 1)"
    shared = f"coalesce(len(list_intersect({_group(x)}, {_group(y)})), 0)"
    return f"list_filter(range(1, least(length({e}), length({a})) + 1), lambda i: {x} <> {y} AND {shared} = 0)"


def _different(e: str, a: str) -> str:
    return f"len(list_filter(range(1, least(length({e}), length({a})) + 1), lambda i: substr({e}, i, 1) <> substr({a}, i, 1)))"


def _sound(e: str, a: str, bad: str) -> str:
    return f"CASE WHEN len({bad}) > 0 THEN substr({a}, {bad}[1], 1) || '→' || substr({e}, {bad}[1], 1) ELSE substr({e}, 1, 2) END"


def _edit(e: str, a: str) -> str:
    return f"(1 - levenshtein({e}, {a}) / nullif(greatest(length({e}), length({a})), 0))"


def _boosted(e: str, a: str) -> str:
    one = f"least(1.0, {_edit(e, a)} + CASE WHEN abs(length({e}) - length({a})) <= 2 THEN 0.2::DOUBLE ELSE 0.0 END)"
    two = f"least(1.0, {one} + CASE WHEN substr({e}, 1, 1) = substr({a}, 1, 1) THEN 0.15::DOUBLE ELSE 0.0 END)"
    three = f"least(1.0, {two} + CASE WHEN substr({e}, -1, 1) = substr({a}, -1, 1) THEN 0.1::DOUBLE ELSE 0.0 END)"
    return f"CASE WHEN length({e}) = 0 OR length({a}) = 0 THEN 0.0 ELSE {three} END"


def _variant(e: str, a: str) -> str:
    made = f"substr({e}, 1, i - 1) || s || substr({e}, i + 1)"
    group = f"list_contains(g, substr({e}, i, 1)) AND len(list_filter(g, lambda s: {made} = {a})) > 0"
    return f"len(list_filter(range(1, length({e}) + 1), lambda i: len(list_filter({_GROUPS}, lambda g: {group})) > 0)) > 0"


def _kind(e: str, a: str, bad: str) -> str:
    return f"CASE WHEN len({bad}) > 0 THEN 'substitution' WHEN length({a}) > length({e}) + 2 THEN 'repetition' ELSE 'correct' END"


_PICKED = "CASE feedback_class " + " ".join(
    "WHEN '{}' THEN [{}][ascii(md5(CAST(item_id AS VARCHAR))) % {} + 1]".format(
        k, ", ".join("'" + m.replace("'", "''") + "'" for m in v), len(v)
    )
    for k, v in MESSAGES.items()
) + " END"
_WORDS = f"""
  w0 AS (
    SELECT item_id, i - 1 AS position, string_split(expected, ' ')[i] AS e, string_split(actual, ' ')[i] AS a
    FROM (SELECT *, unnest(range(1, least(len(string_split(expected, ' ')), len(string_split(actual, ' '))) + 1)) AS i FROM utterances)),
  w1 AS (
    SELECT w0.*, {_unlike("e", "a")} AS bad,
           CASE WHEN e = a OR ({_variant("e", "a")}) THEN 1.0 WHEN x.main <> '' AND x.main = y.main THEN 0.9::DOUBLE
                WHEN x.other <> '' AND x.other = y.other THEN 0.8::DOUBLE ELSE {_boosted("e", "a")} END AS sim
    FROM w0 LEFT JOIN {_WORD_CODES} x ON x.word = e LEFT JOIN {_WORD_CODES} y ON y.word = a),
  s0 AS (
    SELECT item_id, count(*) AS n, sum(sim) / count(*) AS mean, count(*) FILTER (WHERE sim >= 0.7) AS good,
           flatten(list(list_transform(bad, lambda i: {{'word': e, 'position_in_word': CAST(i - 1 AS INTEGER), 'expected': substr(e, i, 1),
             'actual': substr(a, i, 1), 'word_position': CAST(position AS INTEGER)}}) ORDER BY position)) AS subs
    FROM w1 GROUP BY item_id),
  s1 AS (
    SELECT s0.*, expected, actual, expected = actual AS echo, mean >= 0.7 AND good >= n * 0.7 AS ok FROM s0 JOIN utterances USING (item_id)),
  s2 AS (
    SELECT *, CASE WHEN echo OR (ok AND mean >= 0.9) THEN 'perfect' WHEN ok AND mean >= 0.8 THEN 'almost_all' WHEN ok THEN 'good'
                   WHEN n - good = 1 THEN 'one_difficult' WHEN n - good > 1 THEN 'many_difficult' ELSE 'try_again' END AS feedback_class
    FROM s1)"""
_STUTTER = """
    len(list_filter(range(1, len(words)), lambda i: words[i] = words[i + 1])) AS repeated,
    len(list_filter(words, lambda w: len(list_filter(range(1, length(w) - 1), lambda i: substr(w, i, 1) = substr(w, i + 1, 1)
      AND substr(w, i, 1) = substr(w, i + 2, 1) AND regexp_matches(substr(w, i, 1), '[A-Za-z0-9_]'))) > 0)) AS dragged"""
_PHONES = ", ".join("('{}', [{}])".format(w, ", ".join(f"'{x}'" for x in p.split())) for w, p in PHONEMES.items())
_TIP = "CASE " + " ".join(
    f"WHEN starts_with(xp[wrong[1]], '{e}') AND starts_with(yp[wrong[1]], '{a}') THEN '{tip}'" for (e, a), tip in zip(CONFUSIONS, TIPS)
) + " END"

_MESSAGES = """
  m AS (
    SELECT 'u' || user_id AS connection_id, type, CASE WHEN event_id % 11 = 1 THEN 's' || (event_id // 100) END AS session_id,
           CASE WHEN type = 'child_response' THEN CAST(event_id AS VARCHAR) END AS item_id,
           CASE WHEN type = 'child_response' THEN event_type END AS response,
           CASE WHEN type = 'child_response' THEN CASE WHEN event_id % 2 = 0 THEN value ELSE 0.0 END END AS score,
           CASE WHEN type = 'caregiver_command' THEN event_type END AS command, ts
    FROM (SELECT *, CASE event_id % 11 WHEN 0 THEN 'disconnect' WHEN 1 THEN 'initialize_session' WHEN 6 THEN 'initialize_session'
            WHEN 2 THEN 'caregiver_command' WHEN 3 THEN 'ping' WHEN 8 THEN 'ping' WHEN 4 THEN 'other' ELSE 'child_response' END AS type FROM events)),
  o AS (
    SELECT *, row_number() OVER w AS nr FROM m WHERE type <> 'other' WINDOW w AS (PARTITION BY connection_id ORDER BY ts NULLS LAST,
      CASE type WHEN 'initialize_session' THEN 0 WHEN 'disconnect' THEN 2 ELSE 1 END, type, session_id NULLS LAST, item_id NULLS LAST, command NULLS LAST)),
  e AS (
    SELECT *, (SELECT count(*) FROM o x WHERE x.connection_id = o.connection_id AND x.type = 'disconnect' AND x.nr < o.nr) AS part FROM o),
  f AS (
    SELECT connection_id, part, min(nr) AS first, arg_min(coalesce(session_id, connection_id || '-' || strftime(ts, '%Y%m%d%H%M%S')), nr) AS session
    FROM e WHERE type = 'initialize_session' GROUP BY ALL),
  r AS (
    SELECT connection_id, session AS session_id, CASE type WHEN 'child_response' THEN 'response_update' WHEN 'caregiver_command' THEN 'session_command'
             WHEN 'ping' THEN 'pong' WHEN 'disconnect' THEN 'disconnected' ELSE 'session_initialized' END AS type,
           CASE WHEN type IN ('child_response', 'caregiver_command') THEN 'session' WHEN type = 'disconnect' THEN 'none' ELSE 'personal' END AS scope,
           item_id, response, score, command, ts
    FROM e JOIN f USING (connection_id, part) WHERE nr = first OR (nr > first AND type <> 'initialize_session')),
  j AS (
    SELECT arg_max(session_id, ts) FILTER (WHERE type = 'session_initialized') AS session_id, connection_id FROM r GROUP BY connection_id
    HAVING count(*) FILTER (WHERE type = 'session_initialized') > count(*) FILTER (WHERE type = 'disconnected'))"""

SCORING: dict[str, str] = {
    "edit_scores": f"""
  WITH u AS (SELECT *, {_unlike("expected", "actual")} AS bad, {_edit("expected", "actual")} AS sim FROM utterances)
  SELECT item_id, round(sim, 6) AS similarity, round({_boosted("expected", "actual")}, 6) AS boosted,
         CAST({_different("expected", "actual")} AS INTEGER) AS n_letter_substitutions, {_sound("expected", "actual", "bad")} AS different_sound,
         CAST(len(bad) AS INTEGER) AS n_sound_substitutions, {_kind("expected", "actual", "bad")} AS error_type,
         CASE WHEN sim = 1 THEN 'correct' WHEN sim > 0.7 THEN 'close_pronunciation' ELSE 'incorrect' END AS error_class,
         lower(trim(expected)) = lower(trim(actual)) AS is_exact FROM u""",
    "word_scores": f"""
  WITH {_WORDS},
  v AS (SELECT *, {_kind("e", "a", "bad")} AS kind, sim >= 0.7 AS ok FROM w1),
  t AS (SELECT *, CASE WHEN ok AND kind = 'substitution' THEN 'fixed_sound' WHEN ok AND kind = 'repetition' THEN 'smooth'
          WHEN ok AND sim >= 0.95 THEN 'perfect' WHEN ok AND sim >= 0.85 THEN 'very_good' WHEN ok THEN 'good'
          WHEN kind = 'substitution' THEN 'practise_sound' WHEN kind = 'repetition' THEN 'slow_down' ELSE 'try_again' END AS feedback_class FROM v)
  SELECT item_id, CAST(position AS INTEGER) AS position, e AS expected_clean, a AS actual_clean, round(sim, 6) AS similarity_score,
         ok AS is_correct, kind AS error_type, CAST(len(bad) AS INTEGER) AS n_substitutions, feedback_class, {_PICKED} AS feedback FROM t""",
    "sentence_scores": f"""
  WITH {_WORDS}
  SELECT item_id, round(CASE WHEN echo THEN 0.9::DOUBLE ELSE mean END, 6) AS similarity_score, echo OR ok AS is_correct,
         CASE WHEN echo THEN 'echolalia' ELSE 'sentence_errors' END AS error_type, CASE WHEN NOT echo THEN good END AS correct_word_count,
         CASE WHEN NOT echo THEN CAST(n AS INTEGER) END AS total_word_count,
         CASE WHEN echo THEN '[]' ELSE CAST(to_json(subs) AS VARCHAR) END AS substitutions, feedback_class FROM s2""",
    "attempt_facts": f"""
  WITH {_WORDS}, t AS (SELECT *, string_split(actual, ' ') AS words FROM s2), g AS (SELECT *, {_STUTTER} FROM t)
  SELECT item_id AS attempt_id, item_id // 4 AS session_id, item_id, 1 AS attempt_number, 'verbal' AS response_type, actual AS response_text,
         echo OR ok AS is_correct, round(CASE WHEN echo THEN 0.9::DOUBLE ELSE mean END, 6) AS pronunciation_score,
         CASE WHEN echo THEN 'echolalia' ELSE 'sentence_errors' END AS error_type,
         CAST(CASE WHEN echo THEN 0 ELSE len(subs) END AS INTEGER) AS n_substitutions, repeated > 0 OR dragged > 0 AS stammering_detected,
         CAST(repeated AS INTEGER) AS repetition_count, echo AS is_echo, feedback_class, TIMESTAMP '{AS_OF}' AS created_at FROM g""",
    "word_comparisons": f"""
  WITH u AS (SELECT item_id, {_edit("expected", "actual")} AS sim, x.main = y.main AS same, {_different("expected", "actual")} AS n
    FROM utterances LEFT JOIN {_NAME_CODES} x ON x.word = expected LEFT JOIN {_NAME_CODES} y ON y.word = actual)
  SELECT item_id, round_even(sim, 2) AS similarity_score, same AS phonetic_match,
         CASE WHEN sim = 1 THEN 'correct' WHEN sim > 0.7 THEN 'close_pronunciation' ELSE 'incorrect' END AS error_type, sim = 1 AS is_correct,
         CAST(n AS INTEGER) AS n_substitutions, CASE WHEN sim = 1 THEN 'perfect' WHEN n > 0 THEN 'one_difficult' ELSE 'try_again' END AS feedback_class
  FROM u""",
    "phoneme_comparisons": f"""
  WITH l AS (SELECT * FROM (VALUES {_PHONES}) t(word, phones)),
  w AS (SELECT item_id, string_split(expected, ' ') AS es, string_split(actual, ' ') AS acts FROM utterances),
  u AS (SELECT item_id, i - 1 AS position, es[i] AS e, acts[i] AS a FROM (SELECT *, unnest(range(1, least(len(es), len(acts)) + 1)) AS i FROM w)),
  p AS (
    SELECT item_id, position, e, a, lx.phones AS xp, ly.phones AS yp, {_edit("e", "a")} AS sim, x.main = y.main AS same, {_different("e", "a")} AS n,
           list_filter(range(1, least(len(lx.phones), len(ly.phones)) + 1), lambda i: lx.phones[i] <> ly.phones[i]) AS wrong
    FROM u LEFT JOIN l lx ON lx.word = e LEFT JOIN l ly ON ly.word = a
    LEFT JOIN {_WORD_CODES} x ON x.word = e LEFT JOIN {_WORD_CODES} y ON y.word = a),
  q AS (SELECT *, {_TIP} AS tip, len(wrong) > 0 AS faulty FROM p)
  SELECT item_id, CAST(position AS INTEGER) AS position, e AS expected, a AS actual, round_even(sim, 2) AS similarity_score,
         CASE WHEN sim = 1 THEN 'correct' WHEN faulty AND same THEN 'minor_pronunciation_error' WHEN sim > 0.7 THEN 'close_pronunciation'
              ELSE 'incorrect' END AS error_type, CAST(len(wrong) AS INTEGER) AS n_phoneme_errors,
         CASE WHEN sim = 1 THEN 'perfect' WHEN faulty AND tip IS NOT NULL THEN 'practise_sound' WHEN faulty THEN 'slow_down'
              WHEN n > 0 THEN 'one_difficult' ELSE 'try_again' END AS feedback_class, tip FROM q""",
    "conversation_stutter": f"""
  WITH t AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '') AS words FROM conversations),
  g AS (SELECT *, {_STUTTER} FROM t)
  SELECT conv_id, turn, repeated > 0 OR dragged > 0 AS has_stammering, CAST(repeated AS INTEGER) AS repetition_count,
         CAST(len(words) AS INTEGER) AS word_count FROM g""",
    "echolalic_turns": """
  WITH t AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '') AS words FROM conversations)
  SELECT conv_id, turn, coalesce(len(words) > 1 AND len(list_distinct(words)) = 1, false) AS is_echolalic FROM t""",
    "word_variants": f"""
  WITH w AS (SELECT DISTINCT unnest(string_split(expected, ' ') || string_split(actual, ' ')) AS word FROM utterances),
  l AS (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w),
  g AS (SELECT word, i, unnest({_GROUPS}) AS sounds FROM l),
  v AS (SELECT DISTINCT word, substr(word, 1, i - 1) || unnest(sounds) || substr(word, i + 1) AS variant FROM g WHERE list_contains(sounds, substr(word, i, 1)))
  SELECT word, coalesce(string_agg(variant, '|' ORDER BY variant), '') AS variants FROM w LEFT JOIN v USING (word) WHERE word <> '' GROUP BY word""",
    "adaptations": f"""
  WITH l AS (
    SELECT a.session_id, a.is_correct, a.response_type, lower(i.name) AS e, lower(u.actual) AS a
    FROM (SELECT * FROM session_activities QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, activity_id DESC) <= 5) a
    LEFT JOIN activity_items i USING (item_id) LEFT JOIN utterances u USING (item_id)),
  b AS (SELECT * FROM l WHERE NOT coalesce(is_correct, false)),
  d AS (SELECT *, {_unlike("e", "a")} AS bad FROM (SELECT DISTINCT e, a FROM b WHERE a <> '')),
  s AS (SELECT session_id, {_sound("e", "a", "bad")} AS sound FROM b JOIN d USING (e, a) WHERE response_type = 'verbal'),
  c AS (SELECT session_id, sound FROM s WHERE sound <> '' GROUP BY session_id, sound
        QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY count(*) DESC, sound) = 1),
  k AS (SELECT session_id, count(*) FILTER (WHERE response_type = 'verbal') AS v, count(*) FILTER (WHERE response_type = 'nonverbal') AS n
        FROM b GROUP BY session_id),
  t AS (SELECT session_id, count(*) FILTER (WHERE is_correct) / count(*) AS rate FROM l GROUP BY session_id)
  SELECT session_id, round(rate, 6) AS recent_rate, CASE WHEN rate < 0.3 THEN 'simplify' WHEN rate > 0.8 THEN 'challenge' ELSE 'continue' END AS action,
         CASE WHEN rate < 0.3 THEN -1 WHEN rate > 0.8 THEN 1 END AS difficulty_adjustment, c.sound AS focus_sound,
         CASE WHEN v > n * 2 THEN 'verbal_challenge' WHEN n > v * 2 THEN 'selection_challenge' END AS modality
  FROM t LEFT JOIN c USING (session_id) LEFT JOIN k USING (session_id)""",
    "answer_options": """
  WITH p AS (
    SELECT category_id, item_id, row_number() OVER (PARTITION BY category_id ORDER BY md5('0|' || item_id), item_id) AS nr,
           count(*) OVER (PARTITION BY category_id) AS size FROM activity_items),
  w AS (SELECT category_id, item_id, (nr - 1 + step) % size + 1 AS nr FROM p, range(0, 4) r(step) WHERE step < size)
  SELECT w.item_id, CAST(row_number() OVER (PARTITION BY w.item_id ORDER BY md5('0|' || w.item_id || '|' || p.item_id), p.item_id) AS INTEGER) AS place,
         p.item_id AS option_id, p.item_id = w.item_id AS is_answer FROM w JOIN p USING (category_id, nr)""",
    "routed_messages": f"WITH {_MESSAGES} SELECT * REPLACE (round(score, 6) AS score) FROM r",
    "session_members": f"WITH {_MESSAGES} SELECT session_id, connection_id FROM j",
    "broadcast_messages": f"""
  WITH {_MESSAGES}
  SELECT recipient, type, count(*) AS n_messages FROM (
    SELECT j.connection_id AS recipient, type FROM r JOIN j USING (session_id) WHERE scope = 'session'
    UNION ALL SELECT connection_id, type FROM r WHERE scope = 'personal') GROUP BY ALL""",
    "room_messages": f"""
  WITH {_MESSAGES},
  marks AS (
    SELECT connection_id, session_id, type, ts, lead(ts) OVER (PARTITION BY connection_id ORDER BY ts, type = 'disconnected', session_id) AS gone
    FROM r WHERE type IN ('session_initialized', 'disconnected')),
  stay AS (SELECT * FROM marks WHERE type = 'session_initialized'),
  numbered AS (SELECT *, row_number() OVER () AS reply FROM r)
  SELECT recipient, type, count(*) AS n_messages FROM (
    SELECT DISTINCT n.reply, stay.connection_id AS recipient, n.type
    FROM numbered n JOIN stay ON stay.session_id = n.session_id AND stay.ts <= n.ts AND (stay.gone IS NULL OR n.ts <= stay.gone) WHERE scope = 'session'
    UNION ALL SELECT reply, connection_id, type FROM numbered WHERE scope = 'personal') GROUP BY ALL""",
}
