"""Chat formatting on DataFrame functions alone: a state machine over roles, segments with loss flags, and the way back.

A template says how a turn is marked, which roles are learned and which role may follow which. Texts
and roles are escaped, so that no control string of the template can come from them.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """How turns are written: `open` role `between` text `close`. `open` and `close` start with `mark`, which has two characters.

    `moves` lists (state, role, next state) of the machine that begins in "start"; a role without a
    move is a mistake. A conversation is valid if none is made and it stops in one of `stops`.
    """

    open: str = "<|im_start|>"
    between: str = "\n"
    close: str = "<|im_end|>\n"
    mark: str = "<|"
    learned: tuple[str, ...] = ("assistant",)
    moves: tuple[tuple[str, str, str], ...] = (
        ("start", "system", "system"),
        ("start", "user", "user"),
        ("system", "user", "user"),
        ("user", "assistant", "assistant"),
        ("assistant", "user", "user"),
        ("assistant", "tool", "tool"),
        ("tool", "tool", "tool"),
        ("tool", "assistant", "assistant"),
    )
    stops: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        if len(self.mark) != 2 or not all(s.startswith(self.mark) for s in (self.open, self.close)) or not self.between or "\\" in self.mark:
            raise ValueError("open and close start with a mark of two characters, neither a backslash, and something stands between role and text")


PLAIN = Template()
ROLE_CODES = {"%": "%25", "<": "%3C", "\n": "%0A"}


def _replaced(c: Column, pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs, c)


def escaped(text: Column, template: Template = PLAIN) -> Column:
    """The text with a backslash after each first character of the mark that its second one or a backslash follows."""
    a, b = template.mark
    return _replaced(text, [(f"{a}\\", f"{a}\\\\"), (f"{a}{b}", f"{a}\\{b}")])


def unescaped(text: Column, template: Template = PLAIN) -> Column:
    a = template.mark[0]
    return _replaced(text, [(f"{a}\\", a)])


def _role_codes(template: Template) -> list[tuple[str, str]]:
    codes = ROLE_CODES | {c: f"%{ord(c):02X}" for c in (template.mark[0], template.between[0])}
    return [("%", codes.pop("%")), *codes.items()]


def formatted(conversations: DataFrame, template: Template = PLAIN) -> DataFrame:
    """conv_id, segments (text, learned), valid and first_mistake (the turn's place from 0, or null) of each conversation (conv_id, turn, role, text).

    Turns stand in the order of turn (null first), role and text. Null roles and texts are empty, and an empty role
    is a mistake. Rows of a null conv_id are one conversation. Repeated rows are turns of their own. An empty table
    gives none; other columns are not read. The turns of one conversation must fit in one row (2 GB).
    """
    turn = F.struct("turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = conversations.select("conv_id", turn.alias("row")).groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("turns"))
    moves = F.create_map(*[F.lit(x) for state, role, then in template.moves for x in (f"{state}\n{role}", then)])

    def moved(s: Column, t: Column) -> Column:
        then = F.try_element_at(moves, F.concat(s["state"], F.lit("\n"), t["role"]))
        return F.struct(F.coalesce(then, F.lit("mistake")).alias("state"), (s["at"] + 1).alias("at"), F.coalesce(s["first"], F.when(then.isNull(), s["at"])).alias("first"))

    start = F.struct(F.lit("start").alias("state"), F.lit(0).cast("long").alias("at"), F.lit(None).cast("long").alias("first"))
    segment = lambda text, learned: F.struct(text.alias("text"), learned.alias("learned"))
    marked = lambda s: segment(F.lit(s), F.lit(False))
    pieces = lambda t: F.array(marked(template.open), segment(_replaced(t["role"], _role_codes(template)), F.lit(False)), marked(template.between), segment(escaped(t["text"], template), t["role"].isin(*template.learned)), marked(template.close))
    rows = rows.select("conv_id", F.flatten(F.transform("turns", pieces)).alias("segments"), F.aggregate("turns", start, moved).alias("end"))
    return rows.select("conv_id", "segments", (F.col("end.state").isin(*template.stops) & F.col("end.first").isNull()).alias("valid"), F.col("end.first").alias("first_mistake"))


def read_back(formatted: DataFrame, template: Template = PLAIN) -> DataFrame:
    """conv_id, turns (role, text), learned (all text under the loss mask, unescaped) and formatted_chars, parsed from the texts of the segments and their flags."""
    rows = formatted.withColumn("written", F.array_join(F.transform("segments", lambda s: s["text"]), ""))
    parts = F.split("written", F.lit("\\Q" + template.open + "\\E"), -1)
    role = lambda p: F.substring_index(p, template.between, 1)
    body = lambda p: F.substring_index(F.substring(p, F.length(role(p)) + 1 + len(template.between), F.length(p)), template.close, 1)
    codes = [(code, c) for c, code in reversed(_role_codes(template))]
    turns = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.struct(_replaced(role(p), codes).alias("role"), unescaped(body(p), template).alias("text")))
    learned = F.array_join(F.transform(F.filter("segments", lambda s: s["learned"]), lambda s: unescaped(s["text"], template)), "")
    return rows.select("conv_id", turns.alias("turns"), learned.alias("learned"), F.length("written").cast("long").alias("formatted_chars"))


def digests(back: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars of what read_back returns."""
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), "formatted_chars")
