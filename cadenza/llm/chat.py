"""Chat formatting by a declarative template, with loss flags, and its reading back. Built-in functions only."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Role:
    """Marks around a turn, whether its text is learned, and the roles that may come before ('' is the start)."""

    open: str
    close: str
    loss: bool
    after: tuple[str, ...]


@dataclass(frozen=True)
class Template:
    """Roles by name; any other role is written with its name between `other`, `name_end` and `other_end`, and is never valid.

    All marks are control strings: inside texts and names the i-th is written
    as escape and digit, the escape itself as escape and 0. So control strings
    occur in the output as marks only, and reading back is exact. `ends` are
    the roles a valid conversation may end with.
    """

    roles: dict[str, Role] = field(default_factory=lambda: {
        "system": Role("<<SYS>>", "<</SYS>>", False, ("",)),
        "user": Role("[INST]", "[/INST]", False, ("", "system", "assistant")),
        "assistant": Role("<s>", "</s>", True, ("user",)),
    })
    other: str = "<|role|>"
    name_end: str = "<|text|>"
    other_end: str = "<|end|>"
    escape: str = "~"
    ends: tuple[str, ...] = ("assistant",)

    @property
    def controls(self) -> list[str]:
        return [m for r in self.roles.values() for m in (r.open, r.close)] + [self.other, self.name_end, self.other_end]


CHAT = Template()


def escaped(text: Column, template: Template = CHAT) -> Column:
    """Text without control strings."""
    out = F.replace(text, F.lit(template.escape), F.lit(template.escape + "0"))
    for i, control in enumerate(template.controls, 1):
        out = F.replace(out, F.lit(control), F.lit(template.escape + chr(ord("0") + i)))
    return out


def unescaped(text: Column, template: Template = CHAT) -> Column:
    out = text
    for i, control in enumerate(template.controls, 1):
        out = F.replace(out, F.lit(template.escape + chr(ord("0") + i)), F.lit(control))
    return F.replace(out, F.lit(template.escape + "0"), F.lit(template.escape))


def _by_role(role: Column, template: Template, pick, other: Column) -> Column:
    out = F
    for name, r in template.roles.items():
        out = out.when(role == name, pick(r))
    return out.otherwise(other)


def format_chats(turns: DataFrame, template: Template = CHAT) -> DataFrame:
    """(conv_id, formatted, segments, valid) from rows (conv_id, turn, role, text): one row per conversation.

    segments: array of (text, loss), which concatenate to `formatted`; marks
    and texts without loss have loss false. valid: a machine whose state is the
    last role walks the turns; every turn must be allowed after the state, and
    the last state must be one to end with. Invalid conversations are
    formatted as well.

    Turns are ordered by turn (null first), then role and text, so ties and
    repeated rows have one order. Null role and null text are empty strings;
    the empty role is an unknown one. A null conv_id is a conversation. One
    conversation is one text and so one row; other columns are not read.
    """
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    talks = turns.select("conv_id", row.alias("row")).groupBy("conv_id").agg(F.array_sort(F.collect_list("row")).alias("turns"))

    def parts(t: Column) -> Column:
        role = t["role"]
        name = F.concat(F.lit(template.other), escaped(role, template), F.lit(template.name_end))
        piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        return F.array(
            piece(_by_role(role, template, lambda r: F.lit(r.open), name), F.lit(False)),
            piece(escaped(t["text"], template), _by_role(role, template, lambda r: F.lit(r.loss), F.lit(False))),
            piece(_by_role(role, template, lambda r: F.lit(r.close), F.lit(template.other_end)), F.lit(False)))

    allowed = F.array(*[F.lit(f"{before}>{name}") for name, r in template.roles.items() for before in r.after])
    walked = F.aggregate(
        F.transform("turns", lambda t: t["role"]), F.lit(""),
        lambda state, role: F.when(F.array_contains(allowed, F.concat(state, F.lit(">"), role)), role).otherwise(F.lit("!")))
    out = talks.select("conv_id", F.flatten(F.transform("turns", parts)).alias("segments"), walked.isin(*template.ends).alias("valid"))
    return out.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments", "valid")


def read_chats(formatted: DataFrame, template: Template = CHAT) -> DataFrame:
    """`formatted` with turns, an array of (role, text), read back from the text alone."""
    opens = "|".join(re.escape(r.open) for r in template.roles.values())
    closes = "|".join(re.escape(r.close) for r in template.roles.values())
    mark = rf"({opens}|{re.escape(template.other)})((?s:.*?))({closes}|{re.escape(template.other_end)})"
    found = lambda group: F.regexp_extract_all("formatted", F.lit(mark), F.lit(group))
    halves = formatted.withColumn("_open", found(1)).withColumn("_body", found(2))

    def turn(mark: Column, body: Column) -> Column:
        named = F.split(body, re.escape(template.name_end), 2)
        role = F
        for name, r in template.roles.items():
            role = role.when(mark == r.open, F.lit(name))
        return F.struct(role.otherwise(unescaped(named[0], template)).alias("role"),
                        unescaped(F.when(mark == template.other, F.get(named, F.lit(1))).otherwise(body), template).alias("text"))

    return halves.withColumn("turns", F.zip_with("_open", "_body", turn)).drop("_open", "_body")


def digests(turns: DataFrame, template: Template = CHAT) -> DataFrame:
    """Per conversation the figures of its turns and of the text under the loss mask, read back from the output."""
    back = read_chats(format_chats(turns, template), template)
    learned = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["text"], template)), "")
    back = back.withColumn("_loss", learned)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "valid")


#: DuckDB's form over `conversations` and conversation -1
ORACLE = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, v.turn, v.role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(turn, role)),
e AS (
  SELECT *, length(text) + length(text) - length(replace(text, '~', '')) AS plain,
         {cuts} AS cut
  FROM t),
f AS (
  SELECT *, plain - cut + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7
            ELSE 23 + length(role) + length(role) - length(replace(role, '~', '')) END AS size,
         lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before,
         lead(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS after
  FROM e)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(size)::BIGINT AS formatted_chars,
       bool_and((coalesce(before, '') || '>' || role) IN ('>system', '>user', 'system>user', 'assistant>user', 'user>assistant')
                AND (after IS NOT NULL OR role = 'assistant')) AS valid
FROM f GROUP BY conv_id
""".replace("{cuts}", " + ".join(
    f"(length(text) - length(replace(text, '{c}', ''))) // {len(c)} * {len(c) - 2}" for c in CHAT.controls))
