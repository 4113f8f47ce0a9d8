"""Chat formatting with a grammar round trip, in DataFrame operations only.

A conversation is rendered as its turns in order, each

    <s>[ROLE]role[/ROLE]text</s>

and parsed back by a grammar: turns of just this form, whose role and text hold no bare
control string, and nothing else.  A turn that the grammar rejects, or whose role or text
does not come back identical, is rendered again with a backslash put after the first
character of each control string, and the result is parsed and compared once more.  Escaping adds one backslash to whatever
looks like a control string with any number of them, so it is undone by taking
one away, and no escaped text holds a control string.

Defined results: null role or text is empty; turns go by turn number (null
first), then role and text; a null conv_id is a conversation of its own;
repeated rows are turns of their own; an empty table gives an empty result;
other columns are not read.  A conversation is one row, so the longest one
bounds a task's memory.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Control strings; each opens with ``<`` or ``[`` and holds neither again."""

    begin: str = "<s>"
    end: str = "</s>"
    role_begin: str = "[ROLE]"
    role_end: str = "[/ROLE]"
    others: tuple[str, ...] = ("[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
    loss_roles: tuple[str, ...] = ("assistant",)

    @property
    def control(self) -> tuple[str, ...]:
        own = (self.begin, self.end, self.role_begin, self.role_end, *self.others)
        # "<<SYS>>" is covered by the "<" that is next to its name
        return tuple(dict.fromkeys(x.lstrip("<") if x.startswith("<<") else x[1:] for x in own))

    @property
    def _rest(self) -> str:
        return "(" + "|".join(c.replace("[", r"\[").replace("]", r"\]") for c in self.control) + ")"

    @property
    def pattern(self) -> str:
        """A control string's first character, its backslashes, and the rest."""
        return r"([<\[])(\\*)" + self._rest

    @property
    def bare(self) -> str:
        """A control string as it is."""
        return r"[<\[]" + self._rest


def escape(text: Column, t: Template) -> Column:
    return F.regexp_replace(text, F.lit(t.pattern), F.lit(r"$1\\$2$3"))


def unescape(text: Column, t: Template) -> Column:
    return F.regexp_replace(text, F.lit(t.pattern.replace(r"(\\*)", r"\\(\\*)")), F.lit("$1$2$3"))


def _render(turn: Column, t: Template, escaped: Column) -> Column:
    role = F.when(escaped, escape(turn["role"], t)).otherwise(turn["role"])
    text = F.when(escaped, escape(turn["text"], t)).otherwise(turn["text"])
    return F.concat(F.lit(t.begin + t.role_begin), role, F.lit(t.role_end), text, F.lit(t.end))


def parse(formatted: Column, t: Template) -> Column:
    """The turns of a rendered conversation: array of (role, text); null for any text that
    the grammar does not produce.

    A text is turns, each the opening, a role, the role's end, a text and the turn's end;
    roles and texts hold no bare control string, so pieces between turn ends are turns.
    """
    pieces = F.split(formatted, F.lit(f"\\Q{t.end}\\E"), -1)
    turns = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    opening = t.begin + t.role_begin

    def cut(piece: Column) -> Column:
        role = F.substring_index(piece, t.role_end, 1)
        return F.struct(
            (F.startswith(piece, F.lit(opening)) & F.contains(piece, F.lit(t.role_end))).alias("marked"),
            F.substring(role, len(opening) + 1, 1 << 30).alias("role"),
            F.substring(piece, F.length(role) + len(t.role_end) + 1, F.lit(1 << 30)).alias("text"),
        )

    def fits(x: Column) -> Column:
        return x["marked"] & ~x["role"].rlike(t.bare) & ~x["text"].rlike(t.bare)

    found = F.transform(turns, cut)
    good = (F.element_at(pieces, -1) == "") & F.forall(found, fits)
    return F.when(good, F.transform(found, lambda x: F.struct(unescape(x["role"], t).alias("role"), unescape(x["text"], t).alias("text"))))


def render(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", template: Template = Template()) -> DataFrame:
    """One row per conversation: id, ``formatted``, how many turns were ``escaped``,
    and ``mask``: runs of code points (n_chars, in_loss) over ``formatted``."""
    t = template
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    talks = rows.select(F.col(conv_col).alias("conv"), turn.alias("turn")).groupBy("conv").agg(F.sort_array(F.collect_list("turn")).alias("turns"))

    # Round 1: each turn as it is.  A turn is parsed by itself: it must come back as
    # the one turn it was.
    def conflicting(x: Column) -> Column:
        back = parse(_render(x, t, F.lit(False)), t)
        same = F.coalesce(back == F.array(F.struct(x["role"].alias("role"), x["text"].alias("text"))), F.lit(False))
        return F.struct(x["role"].alias("role"), x["text"].alias("text"), (~same).alias("escaped"))

    talks = talks.select("conv", F.transform("turns", conflicting).alias("turns"))
    # Round 2: the whole conversation, with those turns escaped, must come back.
    pieces = F.transform("turns", lambda x: _render(x, t, x["escaped"]))
    talks = talks.withColumn("formatted", F.array_join(pieces, ""))
    source = F.transform("turns", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    failed = F.raise_error(F.lit("a conversation does not come back from its rendered text"))
    talks = talks.withColumn("formatted", F.when(parse(F.col("formatted"), t) == source, F.col("formatted")).otherwise(failed))

    def runs(x: Column) -> Column:
        role = F.length(F.when(x["escaped"], escape(x["role"], t)).otherwise(x["role"]))
        text = F.length(F.when(x["escaped"], escape(x["text"], t)).otherwise(x["text"]))
        head = role + len(t.begin + t.role_begin + t.role_end)
        learned = x["role"].isin(*t.loss_roles)
        return F.array(
            F.struct(head.alias("n_chars"), F.lit(False).alias("in_loss")),
            F.struct(text.alias("n_chars"), learned.alias("in_loss")),
            F.struct(F.lit(len(t.end)).alias("n_chars"), F.lit(False).alias("in_loss")),
        )

    mask = F.flatten(F.transform("turns", runs))
    escaped = F.size(F.filter("turns", lambda x: x["escaped"])).cast("long")
    return talks.select(F.col("conv").alias(conv_col), "formatted", escaped.alias("escaped"), mask.alias("mask"))


def _under_mask(t: Template) -> Column:
    """The text of the runs of ``formatted`` that ``mask`` has in the loss, unescaped."""

    def cut(done: Column, run: Column) -> Column:
        text = unescape(F.substring(F.col("formatted"), done["at"], run["n_chars"]), t)
        parts = F.when(run["in_loss"], F.array_append(done["parts"], text)).otherwise(done["parts"])
        return F.struct((done["at"] + run["n_chars"]).alias("at"), parts.alias("parts"))

    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<string>").alias("parts"))
    return F.aggregate("mask", start, cut, lambda done: F.array_join(done["parts"], ""))


def summary(rendered: DataFrame, conv_col: str = "conv_id", template: Template = Template()) -> DataFrame:
    """What a reader gets back from ``formatted``: counts and digests of the turns
    and of the text under the loss mask."""
    t = template
    read = rendered.select(conv_col, F.length("formatted").cast("long").alias("formatted_chars"), parse(F.col("formatted"), t).alias("turns"), _under_mask(t).alias("loss"))
    lines = F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n")))
    loss = F.col("loss")
    return read.select(
        conv_col,
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
    )
