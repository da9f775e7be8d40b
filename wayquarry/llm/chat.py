"""Chat formatting: a finite-state machine over roles, segments with a loss flag each, from a declarative template.

A ``Template`` says what stands before and after the text of each role, which roles' texts are learned from, and which
role may follow in which state. ``format_conversations`` gives each conversation's segments (text and loss flag) in the order of its turns, the state the
machine ends in and the place of the first turn that it refuses; nothing is dropped for that, so a caller may filter by either.
Everything is built from Spark's own functions.

The marks of a template are control strings: where a text contains one, a backslash goes after the mark's first character, and
backslashes are doubled. So no mark occurs within a text, the formatted string parts into its turns again (``turns_of``), and
``unescaped`` gives the texts back unchanged. Templates whose marks could arise across a border are refused.

Turns are ordered by turn, then role, then text, so ties and repeated rows have one order; a null turn comes first. Null texts
and roles count as empty; a role that the template doesn't name is written with its name, isn't learned from and is refused by
the machine. Rows with a null conversation form one conversation, as in GROUP BY. Columns beyond the four named are not read. A conversation
becomes one row, so it must fit a row; conversations are spread by their key after texts were gathered within each task.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ESCAPE = "\\"
REFUSED = "refused"


@dataclass(frozen=True)
class Turn:
    """How a role's turn is written: before its text, after it, and whether the text is learned from."""

    before: str
    after: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    turns: dict[str, Turn]
    #: Every mark that may not occur in a text. Each turn's ``before`` starts with one and its ``after`` holds one.
    controls: tuple[str, ...]
    #: For roles that aren't named: before the role's name, between the name and the text, after the text.
    other: tuple[str, str, str]
    start: str
    moves: dict[tuple[str, str], str]
    accepting: frozenset[str] = field(default_factory=frozenset)

    def __post_init__(self) -> None:
        for c in self.controls:
            if len(c) < 2 or ESCAPE in c:
                raise ValueError(f"a control string needs two characters or more and no backslash: {c!r}")
            for other in self.controls:
                # a mark that a text's end and a mark's start, or a mark's end and a text's start, could make together
                if any(other.startswith(c[k:]) or c[k:].startswith(other) for k in range(1, len(c))):
                    raise ValueError(f"{c!r} could overlap {other!r}")
        opening = [t.before for t in self.turns.values()] + [self.other[0]]
        if any(not any(o.startswith(c) for c in self.controls) for o in opening):
            raise ValueError("each turn must start with a control string")
        for a in opening:
            if sum(b.startswith(a) for b in opening) > 1:
                raise ValueError(f"turns can't be told apart: {a!r}")
        for after in [t.after for t in self.turns.values()] + list(self.other[1:]):
            # the first place where ``after`` may end a text is where its control string stands
            if not any(c in after for c in self.controls):
                raise ValueError(f"what ends a text must hold a control string: {after!r}")

    @property
    def pattern(self) -> str:
        """One whole turn of a formatted conversation."""
        parts = [quoted(t.before) + ".*?" + quoted(t.after) for t in self.turns.values()]
        return "(?s)" + "|".join([*parts, ".*?".join(map(quoted, self.other))])


#: System once at the start, then user and assistant by turns; complete after an assistant.
INSTRUCTIONS = Template(
    turns={
        "system": Turn("<<SYS>>\n", "\n<</SYS>>\n\n"),
        "user": Turn("[INST] ", " [/INST]"),
        "assistant": Turn("<s> ", " </s>\n", loss=True),
    },
    controls=("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[TEXT]", "[/ROLE]"),
    other=("[ROLE] ", " [TEXT] ", " [/ROLE]\n"),
    start="start",
    moves={
        ("start", "system"): "system",
        ("start", "user"): "user",
        ("system", "user"): "user",
        ("user", "assistant"): "assistant",
        ("assistant", "user"): "user",
    },
    accepting=frozenset({"assistant"}),
)


def quoted(text: str) -> str:
    return re.sub(r"[^\w\s]", lambda m: "\\" + m[0], text)


def escaped(text: Column, template: Template = INSTRUCTIONS) -> Column:
    """A backslash after each backslash, and after the first character of each control string."""
    marks = "|".join(f"{quoted(c[0])}(?={quoted(c[1:])})" for c in template.controls)
    return F.regexp_replace(text, rf"\\|{marks}", r"$0\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _segments(turn: Column, template: Template) -> Column:
    """The segments of one turn: before, text, after."""
    text = escaped(turn["text"], template)
    piece = lambda value, loss: F.struct(value.alias("text"), F.lit(loss).alias("loss"))
    first, middle, last = template.other
    found = F.array(piece(F.concat(F.lit(first), escaped(turn["role"], template), F.lit(middle)), False), piece(text, False), piece(F.lit(last), False))
    for role, t in template.turns.items():
        found = F.when(turn["role"] == role, F.array(piece(F.lit(t.before), False), piece(text, t.loss), piece(F.lit(t.after), False))).otherwise(found)
    return found


def _step(run: Column, turn: Column, template: Template) -> Column:
    """The machine's next state; in REFUSED it stays, with the place of the turn that led there."""
    state = F.lit(REFUSED)
    for (before, role), after in template.moves.items():
        state = F.when((run["state"] == before) & (turn["role"] == role), F.lit(after)).otherwise(state)
    refused = run["refused_turn"].isNull() & (state == REFUSED)
    return F.struct(state.alias("state"), (run["turns"] + 1).alias("turns"), F.when(refused, run["turns"]).otherwise(run["refused_turn"]).alias("refused_turn"))


def format_conversations(rows: DataFrame, template: Template = INSTRUCTIONS, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """key, segments (array of text and loss), state, refused_turn (the first turn refused, counted from 0, or null), complete.

    One shuffle: the turns are gathered by conversation, and all else is computed on each conversation's row.
    """
    own = rows.select(
        rows[key].alias("_key"),
        F.struct(rows[turn].alias("turn"), F.coalesce(rows[role].cast("string"), F.lit("")).alias("role"), F.coalesce(rows[text], F.lit("")).alias("text")).alias("turn"),
    )
    gathered = own.groupBy("_key").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    begin = F.struct(F.lit(template.start).alias("state"), F.lit(0).cast("long").alias("turns"), F.lit(None).cast("long").alias("refused_turn"))
    run = F.aggregate("turns", begin, lambda r, t: _step(r, t, template))
    return gathered.select(
        F.col("_key").alias(key),
        F.flatten(F.transform("turns", lambda t: _segments(t, template))).alias("segments"),
        run.alias("_run"),
    ).select(
        key,
        "segments",
        F.col("_run.state").alias("state"),
        F.col("_run.refused_turn").alias("refused_turn"),
        F.col("_run.state").isin(sorted(template.accepting)).alias("complete"),
    )


def formatted(segments: Column) -> Column:
    """The whole formatted text."""
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def learned(segments: Column) -> Column:
    """The texts under the loss mask one after the other, as they were before they were escaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")


def turns_of(text: Column, template: Template = INSTRUCTIONS) -> Column:
    """A formatted conversation parted into its turns again: an array of role and text."""

    def parsed(whole: Column) -> Column:
        first, middle, last = template.other
        # the name of an unnamed role holds no mark, so the first ``middle`` ends it
        at = F.instr(whole, middle)
        found = F.struct(unescaped(whole.substr(F.lit(len(first) + 1), at - len(first) - 1)).alias("role"), unescaped(whole.substr(at + len(middle), F.length(whole) - at - len(middle) - len(last) + 1)).alias("text"))
        for role, t in template.turns.items():
            inner = whole.substr(F.lit(len(t.before) + 1), F.length(whole) - len(t.before) - len(t.after))
            found = F.when(F.startswith(whole, F.lit(t.before)), F.struct(F.lit(role).alias("role"), unescaped(inner).alias("text"))).otherwise(found)
        return found

    return F.transform(F.regexp_extract_all(text, F.lit(template.pattern), F.lit(0)), parsed)
