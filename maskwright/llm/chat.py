"""Chat formatting: a finite-state machine over roles and a declarative template.

Results by case: a null text or role counts as empty; turns with equal numbers are
ordered by role, then text (a null turn number comes first); repeated rows are turns
of their own; a row with a null conversation id belongs to no other and is a conversation
of its own, with a null id; unknown roles are formatted but make the conversation invalid; an empty table gives an
empty result; only the named columns are read. The machine takes one step a turn. A conversation becomes one row, so one
row holds all its turns.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Marks of a turn, strings that may not appear inside a text, and the machine over roles.

    ``moves`` maps "state|role" to the next state; ``final`` are states where a
    conversation may end. Texts of ``loss_roles`` count for the loss.
    """

    turn: str = "<|turn|>"
    text: str = "<|text|>"
    end: str = "<|end|>"
    escape: str = "\\"
    reserved: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
    moves: dict[str, str] = field(
        default_factory=lambda: {
            "start|system": "system",
            "start|user": "user",
            "system|user": "user",
            "user|assistant": "assistant",
            "assistant|user": "user",
        }
    )
    final: tuple[str, ...] = ("assistant",)
    loss_roles: tuple[str, ...] = ("assistant",)

    @property
    def controls(self) -> tuple[str, ...]:
        return (self.turn, self.text, self.end, *self.reserved)


DEFAULT = Template()


def escape(text: Column, t: Template = DEFAULT) -> Column:
    """Double the escape character and put one behind the first character of each control string."""
    out = F.replace(text, F.lit(t.escape), F.lit(t.escape * 2))
    for c in t.controls:
        out = F.replace(out, F.lit(c), F.lit(c[0] + t.escape + c[1:]))
    return out


def unescape(text: Column, t: Template = DEFAULT) -> Column:
    e = "\\" + t.escape
    return F.regexp_replace(text, f"{e}({e}?)", "$1")


def _walk(t: Template):
    """The machine over the roles of each conversation: places whose role may not follow (the machine goes on from
    the state of that role), and whether none is bad and the last state is final. One step a turn."""

    def walk(roles: pa.Array) -> pa.Array:
        out = []
        for row in roles.to_pylist():
            state, bad = "start", []
            for place, role in enumerate(row):
                to = t.moves.get(f"{state}|{role}")
                if to is None:
                    bad.append(place)
                state = role if to is None else to
            out.append({"bad": bad, "valid": not bad and state in t.final})
        return pa.array(out, pa.struct([("bad", pa.list_(pa.int32())), ("valid", pa.bool_())]))

    return walk


def format_conversations(
    rows: DataFrame, template: Template = DEFAULT, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """One row per conversation: conv_id, segments (text, loss), bad_turns (places whose role may
    not follow), valid."""
    t = template
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    turn = F.struct(F.col(turn_col).alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"))
    owned, own = F.col(conv_col).isNotNull(), F.col(conv_col).alias("conv_id")
    grouped = rows.where(owned).groupBy(own).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    grouped = grouped.unionByName(rows.where(~owned).select(own, F.array(turn).alias("turns")))  # never one group
    segment = lambda c, loss: F.struct(c.alias("text"), loss.alias("loss"))
    no = F.lit(False)
    segments = F.flatten(
        F.transform(
            "turns",
            lambda x: F.array(
                segment(F.concat(F.lit(t.turn), escape(x["role"], t), F.lit(t.text)), no),
                segment(escape(x["text"], t), x["role"].isin(*t.loss_roles)),
                segment(F.lit(t.end), no),
            ),
        )
    )
    machine = F.arrow_udf(_walk(t), "struct<bad:array<int>,valid:boolean>")
    checked = grouped.select("conv_id", segments.alias("segments"), machine(F.transform("turns", lambda x: x["role"])).alias("m"))
    return checked.select("conv_id", "segments", F.col("m.bad").alias("bad_turns"), F.col("m.valid").alias("valid"))


def read_back(formatted: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """Parse formatted conversations: conv_id, formatted, turns (role, text), loss_text, valid."""
    t = template
    quote = lambda s: f"\\Q{s}\\E"
    whole = formatted.select(
        "conv_id",
        "valid",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"], t)), "").alias("loss_text"),
    )
    parts = F.split("formatted", quote(t.end))
    parts = F.slice(parts, 1, F.size(parts) - 1)
    role = lambda p: F.substring_index(p, t.text, 1)
    turns = F.transform(
        parts,
        lambda p: F.struct(
            unescape(F.substr(role(p), F.lit(len(t.turn) + 1)), t).alias("role"),
            unescape(F.substr(p, F.length(role(p)) + len(t.text) + 1), t).alias("text"),
        ),
    )
    return whole.select("conv_id", "formatted", turns.alias("turns"), "loss_text", "valid")


def digest(read: DataFrame) -> DataFrame:
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


def oracle_sql(t: Template = DEFAULT) -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    esc = lambda c: (
        "".join("replace(" for _ in range(len(t.controls) + 1))
        + c
        + f", {q(t.escape)}, {q(t.escape * 2)})"
        + "".join(f", {q(x)}, {q(x[0] + t.escape + x[1:])})" for x in t.controls)
    )
    marks = len(t.turn) + len(t.text) + len(t.end)
    moves = " or ".join(f"(before = {q(k.split('|')[0])} and role = {q(k.split('|')[1])})" for k in t.moves)
    odd = "</s>[INST] ok [/INST]"
    return f"""
with r as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', {q(odd)} union all select -7, 1, 'assistant', {q(odd)}),
o as (select *, case when conv_id is null then row_number() over () else 0 end as lone from r),
n as (select *, row_number() over w as i, coalesce(lag(role) over w, 'start') as before,
    lead(role) over w is null as is_last from o window w as (partition by conv_id, lone order by turn nulls first, role, text)),
m as (select *, ({moves}) as ok from n)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by i)) as turns_sha256,
  cast(sum(case when role in ({", ".join(map(q, t.loss_roles))}) then length(text) else 0 end) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by i) filter (where role in ({", ".join(map(q, t.loss_roles))})), '')) as loss_sha256,
  cast(sum({marks} + length({esc("role")}) + length({esc("text")})) as bigint) as formatted_chars,
  bool_and(ok) and max(case when is_last then role end) in ({", ".join(map(q, t.final))}) as valid
from m group by conv_id, lone"""
