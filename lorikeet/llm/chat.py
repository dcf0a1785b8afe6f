"""Chat formatting by prefix-target expansion.

Every assistant turn is exploded into an example of its own: all turns before it
are the context and only that reply is trained on. ``expand`` deals the turns to
the examples in which they are new, and ``whole_examples`` puts each example's
whole prefix before its reply. Whole texts grow with the square of a conversation's
turns, so they are made where a conversation lies sorted and are read row by row:
what is shuffled and sorted are turns.

The template writes a turn as ``<|turn|>role``, a line end, the text and
``<|end|>`` with a line end. Inside roles and texts, a backslash is doubled and
one is put after the first character of every control string, its own and those
of other common templates; taking each backslash away and the next character as
it is reverses that.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, END = "<|turn|>", "<|end|>\n"
#: Strings with a meaning in chat templates, which no text may spell unescaped.
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<start_of_turn>", "<end_of_turn>")
_SPLITS = "|".join(rf"(?<={re.escape(c[0])})(?={re.escape(c[1:])})" for c in CONTROL)
_HEAD = re.compile(r"<\|turn\|>((?:\\.|[^\\\n])*)\n", re.S)
TARGET = "assistant"


def escape(text: Column) -> Column:
    """Text without any control string; ``unescape`` gives it back."""
    doubled = F.regexp_replace(text, r"\\", r"\\\\")
    return F.regexp_replace(doubled, _SPLITS, r"\\")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def format_turns(turns: DataFrame) -> DataFrame:
    """A row for every turn of ``turns`` (conv_id, turn, role, text, ...):

    conv_id, place (0, 1, ... in the conversation), formatted (the turn as the
    template writes it), start (code points of the conversation before it),
    and for assistant turns, else null: example (0, 1, ...), context_end (the
    example's context is the conversation's text up to there), loss_start and
    loss_end (the span of the reply, the only text under the loss mask); and
    replies, how many assistant turns came before.

    Turns are ordered by turn, then role and text; null turns come last, a null
    role or text is empty, null conv_ids are one conversation. Other columns are
    ignored.
    """
    rows = turns.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    order = [F.asc_nulls_last("turn"), F.asc("role"), F.asc("text")]
    w = Window.partitionBy("conv_id").orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    target = F.col("role") == TARGET
    role = F.replace(escape(F.col("role")), F.lit("\n"), F.lit("\\\n"))  # a bare line end would end the head
    head = F.concat(F.lit(TURN), role, F.lit("\n"))
    rows = rows.withColumn("__head", head).withColumn("__body", escape(F.col("text")))
    rows = rows.withColumn("formatted", F.concat("__head", "__body", F.lit(END)))
    rows = rows.withColumn("__n", F.char_length("formatted").cast("long"))
    rows = rows.withColumn("place", F.row_number().over(w) - 1).withColumn(
        "start", F.coalesce(F.sum("__n").over(before), F.lit(0).cast("long"))
    )
    first = F.col("start") + F.char_length("__head")
    rows = rows.withColumn("replies", F.coalesce(F.count_if(target).over(before), F.lit(0)))
    return rows.select(
        "conv_id",
        "place",
        "formatted",
        "start",
        "replies",
        F.when(target, F.col("replies")).alias("example"),
        F.when(target, F.col("start")).alias("context_end"),
        F.when(target, first).alias("loss_start"),
        F.when(target, first + F.char_length("__body")).alias("loss_end"),
    )


def expand(formatted: DataFrame) -> DataFrame:
    """The rows of all examples (conv_id, example, place, trainable, formatted,
    start, context_end, loss_start, loss_end), from ``format_turns``'s output.

    Each turn is exploded into the parts that it plays: a reply is the trainable
    row of its example, whose context ends at context_end, and it is a row of the
    next example's context; any other turn is a row of the next example's context
    only. An example's whole context is the context rows of its own and of all
    examples before it, in order of place (``whole_examples``). Turns after the last
    reply are the context of an example that has no reply yet.
    """
    reply = F.col("example").isNotNull()
    parts = F.when(reply, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))
    rows = formatted.withColumn("trainable", F.explode(parts))
    own = F.when(F.col("trainable"), F.col("example")).otherwise(F.col("replies") + reply.cast("int"))
    span = lambda c: F.when(F.col("trainable"), F.col(c)).alias(c)
    return rows.select(
        "conv_id", own.alias("example"), "place", "trainable", "formatted", "start",
        span("context_end"), span("loss_start"), span("loss_end"),
    )


def example_texts(formatted: DataFrame) -> DataFrame:
    """(conv_id, example, context, reply): the examples with their whole contexts.
    The volume grows with the square of a conversation's turns."""
    w = Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return (
        formatted.withColumn("context", F.array_join(F.collect_list("formatted").over(w), ""))
        .where("example IS NOT NULL")
        .select(
            "conv_id",
            "example",
            "context",
            F.expr("substring(formatted, cast(loss_start - start + 1 as int), cast(loss_end - loss_start as int))").alias(
                "reply"
            ),
        )
    )


def whole_examples(parts: DataFrame) -> DataFrame:
    """(conv_id, place, trainable, example, text, known, loss_start, loss_end), from
    ``expand``'s output: a trainable row for every example, whose text is its whole
    prefix, from the first turn on, and its reply, of which loss_start and loss_end
    are the span in the text; and for every conversation a last row that isn't
    trainable, with the text that follows the last reply. known is where the reply
    of the example before ends, up to which the two texts are to be the same.

    A text is one string, so a conversation of more than 2 GB can't be spelt.
    """
    # of a reply's two rows the trainable one comes first, so its prefix doesn't hold it
    order = Window.partitionBy("conv_id").orderBy("place", F.desc("trainable"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = parts.select(
        "conv_id", "place", "trainable", "example", "formatted", "start", "loss_start", "loss_end",
        F.collect_list(F.when(~F.col("trainable"), F.col("formatted"))).over(before).alias("__turns"),
        F.coalesce(F.max("loss_end").over(before), F.lit(0)).cast("int").alias("known"),
        F.lead("place").over(order).isNull().alias("__last"),
    )
    prefix = F.array_join("__turns", "")
    reply = F.substring("formatted", F.lit(1), (F.col("loss_end") - F.col("start")).cast("int"))
    rest = F.substring(F.concat(prefix, F.col("formatted")), F.col("known") + 1, F.lit(2**31 - 1))
    return rows.where("trainable OR __last").select(
        "conv_id", "place", "trainable", "example",
        F.when(F.col("trainable"), F.concat(prefix, reply)).otherwise(rest).alias("text"),
        "known", "loss_start", "loss_end",
    )


class _Conversation:
    """What is read back of one conversation, example after example."""

    def __init__(self, conv_id):
        self.conv_id, self.turns, self.at, self.formatted, self.text_id = conv_id, 0, 0, 0, None
        self.all, self.loss, self.loss_chars = hashlib.sha256(), hashlib.sha256(), 0

    def _turn(self, role: str, text: str) -> None:
        self.turns += 1
        self.all.update(f"{unescape(role)}\n{text}\n".encode("utf-8", "surrogatepass"))

    def _whole_turns(self, text: str) -> int:
        """Read the turns that are whole; the place after the last."""
        at = len(END) if self.text_id is not None and text.startswith(END) else 0  # of the reply before
        while (head := _HEAD.match(text, at)) and (end := text.find(END, head.end())) >= 0:
            self._turn(head[1], unescape(text[head.end() : end]))
            at = end + len(END)
        return at

    def example(self, text: str, masked: str, known_id: str, text_id: str, spans: tuple[float, float, float]) -> None:
        """An example by what its text has beyond the example before, and its mask."""
        known, loss_start, loss_end = (int(x) for x in spans)
        if known != self.at or (self.text_id is not None and known_id != self.text_id):
            raise ValueError(f"an example of {self.conv_id} doesn't begin with the one before")
        head = _HEAD.match(text, self._whole_turns(text))
        if not head or head.end() + known != loss_start or text[head.end() :] != masked:
            raise ValueError(f"an example of {self.conv_id} doesn't end with the reply under its mask")
        reply = unescape(masked)
        self._turn(head[1], reply)
        self.loss_chars += len(reply)
        self.loss.update(reply.encode("utf-8", "surrogatepass"))
        self.at, self.text_id = loss_end, text_id
        self.formatted += loss_end

    def rest(self, text: str) -> None:
        if self._whole_turns(text) != len(text):
            raise ValueError(f"what follows the last reply of {self.conv_id} isn't whole turns")
        self.formatted += len(text)

    def row(self) -> tuple:
        return self.conv_id, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(examples: DataFrame) -> DataFrame:
    """A row for each conversation, parsed from its whole examples (``whole_examples``):
    its turns, their digest, length and digest of all text under the loss mask, and
    formatted_chars, the length of its examples' texts (context and reply) and of
    what follows the last reply.

    Each text is read whole: by its hash up to the reply of the example before, which
    must be that of the example before, and by its turns from there on. A digest is a
    chain, so a conversation is read in order by one task; it streams, and only hash
    states are held."""
    names = [f.split()[0] for f in DIGEST.split(", ")]

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, known = None, False
        for batch in batches:
            done = []
            columns = [batch[c] for c in ("conv_id", "trainable", "new", "masked", "known_id", "text_id", "known", "loss_start", "loss_end")]
            for null, conv_id, trainable, text, masked, known_id, text_id, *spans in zip(batch["conv_id"].isna(), *columns):
                key = None if null else int(conv_id)
                if not known or key != now.conv_id:
                    if known:
                        done.append(now.row())
                    now, known = _Conversation(key), True
                if trainable:
                    now.example(text, masked, known_id, text_id, spans)
                else:
                    now.rest(text)
            yield _frame(done)
        if known:
            yield _frame([now.row()])

    def _frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=names).astype({"conv_id": "Int64"})

    start, end = F.col("loss_start").cast("int"), F.col("loss_end").cast("int")
    beyond = F.when(F.col("trainable"), F.substring("text", F.col("known") + 1, end - F.col("known"))).otherwise(F.col("text"))
    rows = examples.select(
        F.col("conv_id").cast("long").alias("conv_id"), "place", "trainable", beyond.alias("new"),
        F.substring("text", start + 1, end - start).alias("masked"),
        F.hex(F.xxhash64(F.when(F.col("trainable"), F.substring("text", F.lit(1), F.col("known"))))).alias("known_id"),
        F.hex(F.xxhash64("text")).alias("text_id"),
        *[F.col(c).cast("double").alias(c) for c in ("known", "loss_start", "loss_end")],
    )
    # whole_examples leaves rows dealt and ordered so: no text is shuffled or sorted
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "place", F.desc("trainable")).mapInPandas(each, DIGEST)


def op5_chat(conversations: DataFrame) -> DataFrame:
    """What the examples of all conversations, and of conversation -7, say when read
    back: see ``read_back``, and ``format_turns`` for nulls, empty texts, ties and
    repeated rows, each of which is a turn. An empty table gives conversation -7."""
    spark = conversations.sparkSession
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame(
        [(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string"
    )
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return read_back(whole_examples(expand(format_turns(rows.unionByName(own)))))


def _escaped_sql(column: str) -> str:
    out = f"replace(coalesce({column}, ''), chr(92), chr(92) || chr(92))"
    for c in CONTROL:
        out = f"replace({out}, '{c}', '{c[0]}' || chr(92) || '{c[1:]}')"
    return out


OP5_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), e AS (
  SELECT *, length(replace({_escaped_sql("role")}, chr(10), chr(92) || chr(10))) + length({_escaped_sql("text")})
    + {len(TURN) + 1 + len(END)} AS n FROM t
), w AS (
  SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - {len(END)} AS reply_end FROM e
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(coalesce(sum(reply_end) FILTER (WHERE role = 'assistant'), 0) + sum(n)
         - coalesce(max(reply_end) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS formatted_chars
FROM w GROUP BY conv_id
"""
