"""Chat formatting: a finite-state machine over roles, and a declarative template with loss flags per segment.

A template names, for each role, what stands before and after its text and whether the text is under the
loss mask. Its control strings are the words of those marks; inside texts and role names they are broken by
a backslash after their first character, and backslashes are doubled, so no text can hold a control string
and the formatted conversation can be read back exactly. DataFrame functions only.

Nulls: a null text or role counts as empty; rows with a null conv_id are one conversation; null turns come
first. Rows of one turn go by role, then text; repeated rows are turns of their own. An empty table gives an
empty table. Columns other than conv_id, turn, role and text are not read. A conversation is one row of the
output, so it has to fit a row, as its digests ask for anyway.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

START = "start"
#: State -> role -> next state. A turn without an entry breaks the order and leaves the state as it is.
TURN_ORDER: Mapping[str, Mapping[str, str]] = {
    START: {"system": "briefed", "user": "asked"},
    "briefed": {"user": "asked"},
    "asked": {"assistant": "answered"},
    "answered": {"user": "asked"},
}
#: States in which a conversation may end.
FINAL_STATES = ("answered",)


@dataclass(frozen=True)
class RoleMarks:
    before: str
    after: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Marks by role. Roles without an entry are written with their name between `name_before` and `other.before`."""

    begin: str = "<s>"
    roles: Mapping[str, RoleMarks] = field(
        default_factory=lambda: {
            "system": RoleMarks("<<SYS>>\n", "\n<</SYS>>\n\n"),
            "user": RoleMarks("[INST] ", " [/INST]"),
            "assistant": RoleMarks("[OUT] ", " </s>", loss=True),
        }
    )
    name_before: str = "[ROLE] "
    other: RoleMarks = RoleMarks(" [TEXT] ", " [/TEXT]")

    def __post_init__(self) -> None:
        marks = [self.begin, self.name_before, self.other.before, self.other.after]
        marks += [m for r in self.roles.values() for m in (r.before, r.after)]
        if any("\\" in m for m in marks) or any(len(w) < 2 for w in self.controls()):
            raise ValueError("control strings need two characters or more and no backslash")
        first = [m.split() for m in (self.name_before, *(r.before for r in self.roles.values()))]
        if not all(first) or len({w[0] for w in first}) < len(first) or not all(m.split() for m in marks[2:]):
            raise ValueError("every turn needs a mark before and after it, and roles differ in the mark before")

    def controls(self) -> list[str]:
        """The words of all marks, longest first."""
        marks = [self.begin, self.name_before, self.other.before, self.other.after]
        marks += [m for r in self.roles.values() for m in (r.before, r.after)]
        return sorted({w for m in marks for w in m.split()}, key=lambda w: (-len(w), w))


DEFAULT_TEMPLATE = Template()


def escape(text: Column, template: Template = DEFAULT_TEMPLATE) -> Column:
    """Doubles backslashes, then breaks each control string by a backslash after its first character."""
    broken = "|".join(f"{re.escape(w[0])}(?={re.escape(w[1:])})" for w in template.controls())
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), broken, r"$0\\")


def unescape(text: Column) -> Column:
    """The inverse of `escape`: of two backslashes one stays, a single one goes."""
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def _walk(roles: Column, order: Mapping[str, Mapping[str, str]], start: str) -> Column:
    """struct(state, at, bad): the machine's last state and the place of the first turn that it has no entry for."""
    table = F.create_map(*[F.lit(x) for s, by in order.items() for r, to in by.items() for x in (f"{s}\n{r}", to)])
    zero = F.struct(F.lit(start).alias("state"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("bad"))

    def step(acc: Column, role: Column) -> Column:
        to = F.try_element_at(table, F.concat(acc["state"], F.lit("\n"), role))
        bad = F.coalesce(acc["bad"], F.when(to.isNull(), acc["at"]))
        return F.struct(F.coalesce(to, acc["state"]).alias("state"), (acc["at"] + 1).alias("at"), bad.alias("bad"))

    return F.aggregate(roles, zero, step)


def _segments(turn: Column, template: Template, masked: Column) -> Column:
    """Three segments of a turn: the mark before (with the name, for other roles), the text, the mark after."""
    other = template.other
    before = F.concat(F.lit(template.name_before), escape(turn["role"], template), F.lit(other.before))
    after, loss = F.lit(other.after), F.lit(other.loss)
    for role, marks in template.roles.items():
        same = turn["role"] == role
        before = F.when(same, F.lit(marks.before)).otherwise(before)
        after = F.when(same, F.lit(marks.after)).otherwise(after)
        loss = F.when(same, F.lit(marks.loss)).otherwise(loss)
    piece = lambda text, flag: F.struct(text.alias("text"), flag.alias("loss"))
    return F.array(piece(before, F.lit(False)), piece(escape(turn["text"], template), loss & ~masked), piece(after, F.lit(False)))


def format_conversations(
    convs: DataFrame,
    template: Template = DEFAULT_TEMPLATE,
    order: Mapping[str, Mapping[str, str]] = TURN_ORDER,
    final_states: tuple[str, ...] = FINAL_STATES,
    invalid: str = "mark",
) -> DataFrame:
    """`conv_id, segments, valid, bad_turn, last_state`: each conversation as segments (text, loss) in order.

    Joined, the segments' texts are the formatted conversation. A conversation is valid if every turn has
    an entry in `order` and the last state is final; bad_turn is the place of the first turn without one.
    Invalid conversations stay as they are (`mark`), lose their loss flags (`mask`) or go (`drop`).
    """
    if invalid not in ("mark", "mask", "drop"):
        raise ValueError("invalid is mark, mask or drop")
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = convs.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("__turns"))
    walked = turns.withColumn("__walk", _walk(F.transform("__turns", lambda t: t["role"]), order, START))
    valid = F.col("__walk.bad").isNull() & F.col("__walk.state").isin(*final_states)
    walked = walked.withColumn("__valid", valid)
    if invalid == "drop":
        walked = walked.where("__valid")
    masked = ~F.col("__valid") if invalid == "mask" else F.lit(False)
    body = F.flatten(F.transform("__turns", lambda t: _segments(t, template, masked)))
    begin = F.array(F.struct(F.lit(template.begin).alias("text"), F.lit(False).alias("loss")))
    return walked.select(
        "conv_id",
        F.concat(begin, body).alias("segments"),
        F.col("__valid").alias("valid"),
        F.col("__walk.bad").alias("bad_turn"),
        F.col("__walk.state").alias("last_state"),
    )


def formatted_text(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def read_turns(formatted: Column, template: Template = DEFAULT_TEMPLATE) -> Column:
    """array(struct(role, text)) read from a formatted conversation alone, unescaped.

    No escaped text holds a control string, so the first mark that ends a role's text is its end.
    """
    quote = lambda s: re.escape(s).replace("\\\n", "\\n")
    forms = [f"{quote(m.before)}.*?{quote(m.after)}" for m in (*template.roles.values(), RoleMarks(template.name_before, template.other.after))]
    found = F.regexp_extract_all(formatted, F.lit("(?s)" + "|".join(forms)), F.lit(0))

    def inner(turn: Column, before: int, after: int) -> Column:
        return unescape(F.substring(turn, F.lit(before + 1), F.length(turn) - before - after))

    def parse(turn: Column) -> Column:
        split = F.instr(turn, F.lit(template.other.before))
        name = unescape(F.substring(turn, F.lit(len(template.name_before) + 1), split - 1 - len(template.name_before)))
        begin = split + len(template.other.before)
        text = unescape(F.substring(turn, begin, F.length(turn) - begin + 1 - len(template.other.after)))
        for role, m in template.roles.items():
            is_role = F.startswith(turn, F.lit(m.before))
            name, text = F.when(is_role, F.lit(role)).otherwise(name), F.when(is_role, inner(turn, len(m.before), len(m.after))).otherwise(text)
        return F.struct(name.alias("role"), text.alias("text"))

    return F.transform(found, parse)


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, joined."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def formatted_digests(formatted: DataFrame, template: Template = DEFAULT_TEMPLATE) -> DataFrame:
    """`conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, valid, bad_turn`, read back from the segments."""
    read = formatted.select("conv_id", "valid", "bad_turn", formatted_text(F.col("segments")).alias("__text"), loss_text(F.col("segments")).alias("__loss"))
    read = read.withColumn("__turns", read_turns(F.col("__text"), template))
    lines = F.array_join(F.transform("__turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("__turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("__loss").cast("long").alias("loss_chars"),
        F.sha2("__loss", 256).alias("loss_sha256"),
        F.length("__text").cast("long").alias("formatted_chars"),
        "valid",
        "bad_turn",
    )


def control_string_conversation(spark: SparkSession) -> DataFrame:
    """Conversation -1: a user's and an assistant's turn that both say the template's own control strings."""
    role = F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant"))
    return spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))


def format_and_read_back(convs: DataFrame) -> DataFrame:
    """Digests of every conversation of a table and of conversation -1, formatted by the default template and read back."""
    rows = convs.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return formatted_digests(format_conversations(rows.unionByName(control_string_conversation(convs.sparkSession))))
