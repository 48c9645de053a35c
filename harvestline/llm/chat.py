"""Chat formatting: a finite-state machine over roles, and segments with loss flags from a declarative template."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """open, role, after_role, text, close make a turn; loss_roles are trained on; moves lists the roles that may follow a state."""

    open: str = "<|im_start|>"
    after_role: str = "\n"
    close: str = "<|im_end|>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    moves: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    ends: tuple[str, ...] = ("assistant",)


CHATML = Template()


def escape(text: Column) -> Column:
    """No <| is left: one backslash goes into each < \\...\\ |, and unescape takes it out again."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def _role(role: Column) -> Column:
    """A role as it is written: on one line and escaped."""
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _role_back(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def format_chats(rows: DataFrame, template: Template = CHATML) -> DataFrame:
    """conv_id, segments (text and loss of each piece, in order), formatted (their texts joined), valid, first_bad_turn.

    Rows go by turn (null first; rows of one turn by role and text), a null text or role is empty. A conversation is valid if
    each role may follow the one before and the last may end it; invalid ones are formatted too. Rows of a null conv_id are one
    conversation. No rows give no conversations. Columns other than conv_id, turn, role, text aren't read. A conversation is one output row,
    so its turns meet in one task, whatever their number; nothing wider than a conversation does.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = rows.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    segments = lambda t: F.array(
        piece(F.concat(F.lit(template.open), _role(t["role"]), F.lit(template.after_role)), F.lit(False)),
        piece(escape(t["text"]), t["role"].isin(*template.loss_roles)),
        piece(F.lit(template.close), F.lit(False)),
    )
    moves = F.create_map(*(F.lit(x) for state, after in template.moves.items() for x in (state, ",".join(after))))
    may_follow = lambda state, role: F.array_contains(F.split(F.coalesce(F.try_element_at(moves, state), F.lit("")), ","), role) & (role != "")
    start = F.struct(F.lit("").alias("state"), F.lit(0).alias("n"), F.lit(None).cast("int").alias("bad"))
    step = lambda s, t: F.struct(
        t["role"].alias("state"), (s["n"] + 1).alias("n"),
        F.coalesce(s["bad"], F.when(~may_follow(s["state"], t["role"]), s["n"])).alias("bad"),
    )
    out = chats.select("conv_id", F.flatten(F.transform("turns", segments)).alias("segments"), F.aggregate("turns", start, step).alias("end"))
    return out.select(
        "conv_id", "segments", F.array_join(F.col("segments.text"), "").alias("formatted"),
        (F.col("end.bad").isNull() & F.col("end.state").isin(*template.ends)).alias("valid"), F.col("end.bad").alias("first_bad_turn"),
    )


def read_back(formatted: Column, template: Template = CHATML) -> Column:
    """The turns (role, text) of a formatted conversation."""
    marks = lambda s: "".join(f"\\x{{{ord(c):X}}}" for c in s)
    parts = F.filter(F.split(formatted, marks(template.close)), lambda p: p.startswith(template.open))
    body = lambda p: F.substring(p, F.lit(len(template.open) + 1), F.length(p))
    at = lambda b: F.instr(b, template.after_role)
    role = lambda b: _role_back(F.substring(b, F.lit(1), at(b) - 1))
    text = lambda b: unescape(F.substring(b, at(b) + len(template.after_role), F.length(b)))
    return F.transform(F.transform(parts, body), lambda b: F.struct(role(b).alias("role"), text(b).alias("text")))


def chat_digests(chats: DataFrame, template: Template = CHATML) -> DataFrame:
    """What reading the formatted texts and their segments back gives."""
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    read = chats.withColumn("turns", read_back(F.col("formatted"), template)).withColumn("under_loss", loss)
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
        F.length("under_loss").cast("long").alias("loss_chars"), F.sha2("under_loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "valid",
    )
