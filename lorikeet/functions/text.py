"""Transcript scoring as column expressions (engine B).

Everything but the phonetic codes stays in the JVM; see ``phonetics`` for those.
Words are compared letter by letter over their aligned positions. Two letters
are compatible when the first sound groups that hold them share a sound.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sounds that speakers swap, in order; a letter counts with its first group.
SOUND_GROUPS = (
    ("r", "l", "w", "ɹ", "ʋ"),
    ("s", "sh", "z", "th", "f", "θ", "ð"),
    ("t", "d", "ʔ", "ɾ"),
    ("k", "g", "q"),
    ("m", "n", "ŋ"),
    ("p", "b", "β"),
    ("ch", "sh", "j", "zh"),
    ("ah", "a", "æ", "ə"),
    ("oh", "o", "ɔ", "ow"),
    ("ee", "i", "ɪ", "iy"),
)
# Words that are said in two, for the running text and for the last two words.
COMPOUNDS = (("passion", "fruit"), ("straw", "berry"), ("blue", "berry"), ("pine", "apple"), ("water", "melon"))
LAST_TWO = {"".join(p): " ".join(p) for p in (*COMPOUNDS, ("chocolate", "cake"), ("ice", "cream"))}
# Variants of item names.
ITEM_VARIANTS = {
    "passion fruit": "passionfruit", "straw berry": "strawberry", "blue berry": "blueberry", "ice cream": "icecream",
    "fire truck": "firetruck", "sun flower": "sunflower", "rain bow": "rainbow",
}
# Repeated beginnings of words, of one letter and of up to three, with what parts them.
STUTTERS = (r"(\w)[- ]+\1(?:\1[- ]+)*", r"(\w{1,3})[- ]+\1(?:[- ]+\1)*")
#: Similarity from which a word counts as right.
CORRECT = 0.7


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it stands there."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column | str) -> Column:
    """The words between white space."""
    return F.filter(F.split(_col(text), r"\s+"), lambda w: w != "")


def letters_of(text: Column | str) -> Column:
    return F.filter(F.split(_col(text), ""), lambda c: c != "")


def normalize_word(text: Column | str) -> Column:
    """B-01: the last attempt in a noisy transcript of a word; empty without one.
    The stutter rules look across the gaps between words."""
    out = F.lower(_col(text))
    for first, second in COMPOUNDS:
        out = F.regexp_replace(out, rf"{first}\s+{second}", first + second)
        out = F.regexp_replace(out, f"{first}-?{second}", first + second)
    out = F.regexp_replace(out, r"[^a-z\s-]", "")
    for stutter in STUTTERS:
        out = F.regexp_replace(out, stutter, "$1")
    known = F.create_map(*[F.lit(x) for joined, two in LAST_TWO.items() for x in (two, joined)])
    return _let(
        words_of(F.replace(out, F.lit("-"), F.lit(""))),
        lambda words: F.coalesce(
            F.try_element_at(known, F.array_join(F.slice(words, F.greatest(F.size(words) - 1, F.lit(1)), 2), " ")),
            F.try_element_at(words, F.lit(-1)),
            F.lit(""),
        ),
    )


def normalize_item_name(name: Column | str) -> Column:
    """B-02: lower case without spaces, known variants joined."""
    low = F.lower(_col(name))
    out = F.replace(low, F.lit(" "), F.lit(""))
    for variant, joined in ITEM_VARIANTS.items():
        out = F.when(low == variant, joined).otherwise(out)
    return out


def normalize_sentence(text: Column | str) -> Column:
    """B-03: lower case, letters and single spaces only."""
    return F.array_join(F.filter(F.split(F.regexp_replace(F.lower(_col(text)), "[^a-z ]", ""), " "), lambda w: w != ""), " ")


def strip_punctuation(text: Column | str) -> Column:
    """B-15: without what is neither word character, white space nor apostrophe."""
    return F.trim(F.lower(F.regexp_replace(_col(text), r"(?U)[^\w\s']", "")))


def trimmed(text: Column | str) -> Column:
    """B-19, and the first step of every scorer."""
    return F.trim(F.lower(_col(text)))


def is_echolalic(text: Column | str) -> Column:
    """B-04: more than one word, all the same."""
    words = words_of(F.lower(_col(text)))
    return (F.size(words) > 1) & (F.size(F.array_distinct(words)) == 1)


def detect_echolalia(expected: Column | str, actual: Column | str) -> Column:
    """B-10, B-30: equal but for case and outer blanks."""
    return trimmed(expected) == trimmed(actual)


def is_echolalic_sentence(expected: Column | str, actual: Column | str) -> Column:
    """B-13: the sentence itself, or over three words of which under half differ."""
    words = words_of(trimmed(actual))
    n = F.size(words)
    return detect_echolalia(expected, actual) | ((n > 3) & (F.size(F.array_distinct(words)) < n * 0.5))


def detect_stuttering(text: Column | str) -> Column:
    """B-11: struct(has_stammering, repetition_count, word_count): neighbouring
    equal words, or a character three times in a row within a word."""
    return _let(words_of(F.lower(_col(text))), _stutter)


def _stutter(words: Column) -> Column:
    n = F.size(words)
    rest = F.greatest(n - 1, F.lit(0))
    pairs = F.zip_with(F.slice(words, 1, rest), F.slice(words, 2, rest), lambda a, b: a == b)
    return _let(
        F.size(F.filter(pairs, lambda same: same)),
        lambda repeated: F.struct(
            ((repeated > 0) | F.exists(words, lambda w: w.rlike(r"(\w)\1{2,}"))).alias("has_stammering"),
            repeated.alias("repetition_count"),
            n.alias("word_count"),
        ),
    )


def _masks() -> dict[str, int]:
    """For each one-letter sound a bit for every sound of its first group."""
    bits = {s: 1 << i for i, s in enumerate(dict.fromkeys(s for g in SOUND_GROUPS for s in g))}
    out: dict[str, int] = {}
    for group in SOUND_GROUPS:
        for sound in group:
            if len(sound) == 1:
                out.setdefault(sound, sum(bits[s] for s in group))
    return out


_MASKS = _masks()


def _mask(letter: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in _MASKS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, letter), F.lit(0).cast("long"))


def incompatible(a: Column, b: Column) -> Column:
    return (a != b) & (_mask(a).bitwiseAND(_mask(b)) == 0)


def _aligned(expected: Column | str, actual: Column | str) -> Column:
    """array<struct(position, expected, actual)> over the positions both have."""
    e, a = letters_of(expected), letters_of(actual)
    n = F.least(F.size(e), F.size(a))
    zipped = F.zip_with(F.slice(e, 1, n), F.slice(a, 1, n), lambda x, y: F.struct(x.alias("expected"), y.alias("actual")))
    return F.transform(
        zipped, lambda p, i: F.struct(i.alias("position"), p["expected"].alias("expected"), p["actual"].alias("actual"))
    )


def sound_substitutions(expected: Column | str, actual: Column | str) -> Column:
    """B-12: aligned letters that differ and aren't compatible."""
    return F.filter(_aligned(expected, actual), lambda p: incompatible(p["expected"], p["actual"]))


def letter_substitutions(expected: Column | str, actual: Column | str) -> Column:
    """B-22: aligned letters that differ."""
    return F.filter(_aligned(expected, actual), lambda p: p["expected"] != p["actual"])


def error_type(expected: Column | str, actual: Column | str) -> Column:
    """B-12: substitution, else repetition (over two letters more), else correct."""
    return (
        F.when(F.size(sound_substitutions(expected, actual)) > 0, "substitution")
        .when(F.char_length(actual) > F.char_length(expected) + 2, "repetition")
        .otherwise("correct")
    )


def most_different_sound(expected: Column | str, actual: Column | str) -> Column:
    """B-09: the first incompatible pair as actual→expected, else the first two letters."""
    first = F.try_element_at(sound_substitutions(expected, actual), F.lit(1))
    return F.coalesce(F.concat(first["actual"], F.lit("→"), first["expected"]), F.substring(_col(expected), 1, 2))


def _swaps() -> dict[str, list[str]]:
    """For each one-letter sound the sounds of all groups that hold it, itself included."""
    out: dict[str, list[str]] = {}
    for group in SOUND_GROUPS:
        for letter in (s for s in group if len(s) == 1):
            out.setdefault(letter, []).extend(s for s in group if s not in out[letter])
    return out


def phonetic_variants(word: Column | str) -> Column:
    """B-05: the distinct words that have one letter replaced by a sound of a group
    that holds it; the word itself is among them if any letter is in a group."""
    w = _col(word)
    table = F.create_map(*[y for s, xs in _swaps().items() for y in (F.lit(s), F.array(*map(F.lit, xs)))])
    n, none = F.char_length(w), F.array().cast("array<string>")
    each = F.transform(
        letters_of(w),
        lambda c, i: F.transform(
            F.coalesce(F.try_element_at(table, c), none),
            lambda s: F.concat(F.substring(w, F.lit(1), i), s, F.substring(w, i + 2, n)),
        ),
    )
    return F.array_distinct(F.flatten(each))


def is_variant(expected: Column | str, actual: Column | str) -> Column:
    """Whether ``actual`` is among the variants; they are spelt out only where the
    lengths allow it."""
    e, a = _col(expected), _col(actual)
    near = F.abs(F.char_length(a) - F.char_length(e)) <= 1
    return F.coalesce(F.when(near, F.array_contains(phonetic_variants(e), a)), F.lit(False))


def phoneme_errors(expected: Column | str, actual: Column | str) -> Column:
    """B-23: array<struct(position, expected, actual)> of the phonemes that differ,
    up to the shorter list; null where either word isn't listed."""
    e, a = _col(expected), _col(actual)
    n = F.least(F.size(e), F.size(a))
    zipped = F.zip_with(F.slice(e, 1, n), F.slice(a, 1, n), lambda x, y: F.struct(x.alias("expected"), y.alias("actual")))
    placed = F.transform(zipped, lambda p, i: F.struct(i.alias("position"), p["expected"].alias("expected"), p["actual"].alias("actual")))
    return F.filter(placed, lambda p: p["expected"] != p["actual"])


# Phonemes that are often said for others, as (expected, said) beginnings, in order.
CONFUSIONS = (("L", "R"), ("R", "L"), ("TH", "T"), ("V", "F"), ("SH", "S"))
#: Our own wording for them.
TIPS = ("Lift the tongue tip for L.", "Round the lips for R.", "Tongue between the teeth for TH.", "Lip to teeth for V.", "Push air for SH.")


def confusion_tip(errors: Column) -> Column:
    """B-26: the tip for the first phoneme error, null if it is none of the known ones."""
    first = F.try_element_at(errors, F.lit(1))
    out = F.lit(None).cast("string")
    for (expected, said), tip in reversed(list(zip(CONFUSIONS, TIPS))):
        out = F.when(first["expected"].startswith(expected) & first["actual"].startswith(said), tip).otherwise(out)
    return out


def comparison_feedback_class(kind: Column, errors: Column, substitutions: Column) -> Column:
    """B-26: the class of the message of the second scorer."""
    some = F.coalesce(F.size(errors) > 0, F.lit(False))
    return (
        F.when(kind == "correct", "perfect")
        .when(some & confusion_tip(errors).isNotNull(), "practise_sound")
        .when(some, "slow_down")
        .when(F.size(substitutions) > 0, "one_difficult")
        .otherwise("try_again")
    )


def boosted_similarity(expected: Column | str, actual: Column | str) -> Column:
    """B-06, last part: 1 - distance / longer length, raised for near lengths and
    equal first and last letters, up to 1; 0 where either is empty."""
    e, a = _col(expected), _col(actual)
    le, la = F.char_length(e), F.char_length(a)
    one, none = F.lit(1.0), F.lit(0.0)
    base = 1 - F.levenshtein(e, a) / F.greatest(le, la, F.lit(1))
    out = F.least(one, base + F.when(F.abs(le - la) <= 2, 0.2).otherwise(none))
    out = F.least(one, out + F.when(F.substring(e, 1, 1) == F.substring(a, 1, 1), 0.15).otherwise(none))
    out = F.least(one, out + F.when(F.substring(e, -1, 1) == F.substring(a, -1, 1), 0.1).otherwise(none))
    return F.when((le == 0) | (la == 0), none).otherwise(out)


def edit_similarity(expected: Column | str, actual: Column | str) -> Column:
    """B-21: 1 - distance / longer length; null where both are empty."""
    e, a = _col(expected), _col(actual)
    return 1 - F.levenshtein(e, a) / F.nullif(F.greatest(F.char_length(e), F.char_length(a)), F.lit(0))


def classify_error(similarity: Column, phonetic_match: Column, has_phoneme_errors: Column) -> Column:
    """B-25."""
    return (
        F.when(similarity == 1, "correct")
        .when(has_phoneme_errors & phonetic_match, "minor_pronunciation_error")
        .when(similarity > 0.7, "close_pronunciation")
        .otherwise("incorrect")
    )


def percent(x: Column) -> Column:
    """A share as a whole per cent, halves to even."""
    return F.concat(F.bround(x * 100).cast("int"), F.lit("%"))


def word_feedback_class(is_correct: Column, similarity: Column, kind: Column) -> Column:
    """B-17: the class of the message for a word."""
    return (
        F.when(is_correct & (kind == "substitution"), "fixed_sound")
        .when(is_correct & (kind == "repetition"), "smooth")
        .when(is_correct & (similarity >= 0.95), "perfect")
        .when(is_correct & (similarity >= 0.85), "very_good")
        .when(is_correct, "good")
        .when(kind == "substitution", "practise_sound")
        .when(kind == "repetition", "slow_down")
        .otherwise("try_again")
    )


def sentence_feedback_class(is_correct: Column, similarity: Column, n_missing: Column, n_difficult: Column) -> Column:
    """B-18: the class of the message for a sentence."""
    return (
        F.when(is_correct & (similarity >= 0.9), "perfect")
        .when(is_correct & (similarity >= 0.8), "almost_all")
        .when(is_correct, "good")
        .when(n_missing == 1, "one_missing")
        .when(n_missing > 1, "many_missing")
        .when(n_difficult == 1, "one_difficult")
        .when(n_difficult > 1, "many_difficult")
        .otherwise("try_again")
    )


#: Our own wording, a few for each class; one is picked by a hash of the id.
MESSAGES = {
    "fixed_sound": ("You found the right sound!", "That sound is getting clear."),
    "smooth": ("That came out smoothly.", "Nice and steady."),
    "perfect": ("Exactly right!", "Perfectly said."),
    "very_good": ("Very well said.", "That was really close to perfect."),
    "almost_all": ("Nearly every word was right.", "Almost the whole sentence!"),
    "good": ("Good work.", "That is the word."),
    "practise_sound": ("Listen to the sound once more.", "One sound to practise."),
    "slow_down": ("Take your time.", "Say it once, slowly."),
    "one_missing": ("One word was left out.", "Try it with the missing word."),
    "many_missing": ("Let us add the missing words.", "Try the whole sentence."),
    "one_difficult": ("One word to practise.", "Let us say that word together."),
    "many_difficult": ("A few words to practise.", "Word by word."),
    "try_again": ("Let us try again.", "Listen, then try."),
}


def message(kind: Column, key: Column) -> Column:
    """T-10: a message of a class, picked by a hash of the key."""
    table = F.create_map(*[x for k, v in MESSAGES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    options = F.try_element_at(table, kind)
    return F.element_at(options, (F.ascii(F.md5(key.cast("string"))) % F.size(options) + 1).cast("int"))
