"""Chat formatting that is checked by reading it back, in DataFrame functions.

A conversation is written as ``<s>`` and one field a turn: an opening control string, the text, a closing
one. Roles without a field of their own take two, the role's name and the text. A deterministic parser
splits the whole at every control string, wherever it stands, and takes one escape mark back. Each turn is
first written as it is and parsed; if what comes back isn't its text (it holds a control string, or what
looks like an escaped one), its conflicting places are escaped. An escape mark goes behind the first
character of such a place, one more mark where there are some already, so unescaping always gives the text
back. The whole conversation is then parsed once more and compared with its turns; a difference is an error.

What is written is one row a conversation with the segments of the formatted text in order, each marked
whether it counts for the loss; only assistants' texts do. The formatted text is the segments joined.

Turns are ordered by number, ties by role and text, and a null number comes first; repeated rows are turns
of their own. A null role is the empty role, a null text the empty text, rows without conv_id are one
conversation. An empty table gives no rows. Other columns are ignored. A conversation is one value, so one
task holds it, whatever others there are.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the template: its start and the control strings around the text of each role.
START = "<s>"
FIELDS = {
    "system": ("[SYS]", "[/SYS]"),
    "user": ("[INST]", "[/INST]"),
    "assistant": ("[OUT]", "</s>"),
}
NAME_FIELD = ("[ROLE]", "[/ROLE]")
TEXT_FIELD = ("[TEXT]", "[/TEXT]")
LOSS_ROLE = "assistant"

#: Every control string opens with a bracket and ends at the first closing one, so no two overlap.
CONTROLS = [START, *(c for pair in (*FIELDS.values(), NAME_FIELD, TEXT_FIELD) for c in pair)]
_ANY_CONTROL = "|".join(re.escape(c) for c in CONTROLS)
#: By first character, what follows it in control strings.
_RESTS = {
    first: "|".join(re.escape(c[1:]) for c in CONTROLS if c[0] == first) for first in sorted({c[0] for c in CONTROLS})
}


def escape(text: Column) -> Column:
    """One escape mark more in every control string and in every escaped one."""
    for first, rests in _RESTS.items():
        text = F.regexp_replace(text, rf"{re.escape(first)}(\\*(?:{rests}))", rf"{first}\\$1")
    return text


def unescape(text: Column) -> Column:
    """One escape mark less in every escaped control string."""
    for first, rests in _RESTS.items():
        text = F.regexp_replace(text, rf"{re.escape(first)}\\(\\*(?:{rests}))", rf"{first}$1")
    return text


def parse(formatted: Column) -> Column:
    """Turns (role, text) of a formatted conversation; null if it isn't one."""
    split_up = F.struct(
        F.regexp_extract_all(formatted, F.lit(f"({_ANY_CONTROL})"), F.lit(1)).alias("marks"),
        F.split(formatted, _ANY_CONTROL, -1).alias("between"),
    )
    return _bind(split_up, lambda s: F.when(
        (F.size(s["marks"]) >= 3) & (F.size(s["marks"]) % 2 == 1)
        & (s["marks"][0] == START) & (s["between"][0] == "") & (F.element_at(s["between"], -1) == ""),
        _bind(_fields(s["marks"], s["between"]), lambda f: F.when(_well_formed(f), _turns(f))),
    ))


def _bind(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _fields(marks: Column, between: Column) -> Column:
    """Field i stands between marks 2i + 1 and 2i + 2, and a gap before it, counted from 0."""
    return F.transform(
        F.sequence(F.lit(0), F.floor((F.size(marks) - 3) / 2).cast("int")),
        lambda i: F.struct(
            F.get(marks, 2 * i + 1).alias("opened"), F.get(marks, 2 * i + 2).alias("closed"),
            F.get(between, 2 * i + 1).alias("gap"), F.get(between, 2 * i + 2).alias("content"),
        ),
    )


def _by_opening(values: dict[str, str], opened: Column) -> Column:
    found = F.lit(None).cast("string")
    for opening, value in values.items():
        found = F.when(opened == opening, F.lit(value)).otherwise(found)
    return found


def _well_formed(fields: Column) -> Column:
    closings = dict((*FIELDS.values(), NAME_FIELD, TEXT_FIELD))
    following = F.concat(F.slice(F.transform(fields, lambda f: f["opened"]), 2, F.size(fields)), F.array(F.lit("")))
    closed = F.forall(fields, lambda f: (f["gap"] == "") & F.coalesce(_by_opening(closings, f["opened"]) == f["closed"], F.lit(False)))
    named = F.zip_with(fields, following, lambda f, after: (f["opened"] == NAME_FIELD[0]) == (after == TEXT_FIELD[0]))
    return closed & (F.get(fields, F.lit(0))["opened"] != TEXT_FIELD[0]) & F.forall(named, lambda x: x)


def _turns(fields: Column) -> Column:
    roles = {opening: role for role, (opening, _) in FIELDS.items()}
    read = F.transform(fields, lambda f, i: F.struct(
        F.when(f["opened"] == TEXT_FIELD[0], unescape(F.get(fields, i - 1)["content"]))
        .otherwise(_by_opening(roles, f["opened"])).alias("role"),
        unescape(f["content"]).alias("text"),
        (f["opened"] == NAME_FIELD[0]).alias("names"),
    ))
    return F.transform(
        F.filter(read, lambda t: ~t["names"]), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))
    )


def _segment(text: Column, loss: bool) -> Column:
    return F.struct(text.alias("text"), F.lit(loss).alias("loss"))


def _segments(role: Column, text: Column) -> Column:
    """Segments of a turn; only the text of a role that is learnt counts for the loss."""
    whole = F.array(_segment(F.concat(
        F.lit(NAME_FIELD[0]), role, F.lit(NAME_FIELD[1] + TEXT_FIELD[0]), text, F.lit(TEXT_FIELD[1])
    ), False))
    for name, (opening, closing) in FIELDS.items():
        if name == LOSS_ROLE:
            made = F.array(_segment(F.lit(opening), False), _segment(text, True), _segment(F.lit(closing), False))
        else:
            made = F.array(_segment(F.concat(F.lit(opening), text, F.lit(closing)), False))
        whole = F.when(role == name, made).otherwise(whole)
    return whole


def joined(segments: Column) -> Column:
    """The formatted text."""
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def format_conversations(conversations: DataFrame) -> DataFrame:
    """(conv_id, segments); raises where a conversation doesn't read back as its turns."""
    role, text = F.col("said.role"), F.col("said.text")
    plain, escaped = _segments(role, text), _segments(escape(role), escape(text))
    start = F.array(_segment(F.lit(START), False))
    faithful = parse(joined(F.concat(start, plain))) == F.array("said")
    turns = conversations.select(
        "conv_id", "turn",
        F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("said"),
    ).withColumn("segments", F.when(faithful, plain).otherwise(escaped))
    whole = turns.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "said", "segments"))).alias("turns")
    ).select(
        "conv_id", F.transform("turns", lambda t: t["said"]).alias("said"),
        F.concat(start, F.flatten(F.transform("turns", lambda t: t["segments"]))).alias("segments"),
    )
    return whole.withColumn("segments", F.when(parse(joined(F.col("segments"))) == F.col("said"), F.col("segments")).otherwise(
        F.raise_error(F.concat(F.lit("conversation doesn't read back: "), F.coalesce(F.col("conv_id").cast("string"), F.lit("")))).cast(
            "array<struct<text:string,loss:boolean>>"
        )
    )).select("conv_id", "segments")


def write_conversations(conversations: DataFrame, path: str) -> None:
    format_conversations(conversations).write.parquet(path)


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """Turns and learnt texts of written conversations, as counts and digests."""
    read = spark.read.parquet(path).select("conv_id", "segments", joined(F.col("segments")).alias("formatted")).select(
        "conv_id", F.length("formatted").cast("long").alias("formatted_chars"), parse(F.col("formatted")).alias("turns"),
        F.array_join(F.transform(
            F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])
        ), "").alias("learnt"),
    )
    line = F.lit("\n")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], line, t["text"], line)), ""), 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"), "formatted_chars",
    )
