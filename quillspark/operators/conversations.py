"""Conversations: building from rows, seeds, codecs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.column import Column

from ..schemas import ROLES, TURN

KINDS = ("turn", "tool_call", "tool_result")


def build(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text) -> sample_id, turns in order. A conversation is one group; its turns are what one sample holds."""
    turn = F.struct("turn", F.lit("turn").alias("type"), "role", "text")
    return rows.groupBy(F.col("conv_id").cast("string").alias("sample_id")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))


def seed(turns: Column) -> Column:
    """Plain user turns only."""
    return F.filter(turns, lambda t: (t["type"] == "turn") & (t["role"] == "user"))


def is_seed(turns: Column) -> Column:
    return F.forall(turns, lambda t: t["role"] == "user")


def decoded(json: Column) -> Column:
    """A turn from JSON: no tag means `turn`, an unknown one is an error."""
    t = F.from_json(json, TURN.removeprefix("struct<").removesuffix(">").replace(":", " ").replace(",", ", "))
    kind = F.coalesce(t["type"], F.lit("turn"))
    return F.when(kind.isin(*KINDS), t.withField("type", kind)).otherwise(F.raise_error(F.concat(F.lit("unknown turn type "), kind)).cast(TURN))


def tool_call_text(name: Column, arguments: Column) -> Column:
    """JSON of a call's name and arguments. Arguments are JSON text; they are parsed and written anew, so that white space between values goes and that
    within them stays. What is no JSON is an error."""
    # a text as JSON is what stands between the brackets of an array of it
    listed = F.to_json(F.array(name))
    said = listed.substr(F.lit(2), F.length(listed) - 2)
    return F.concat(F.lit('{"name":'), said, F.lit(',"arguments":'), F.to_json(F.parse_json(arguments)), F.lit("}"))


def turn_text(turn: Column) -> Column:
    """What a turn says: its text, the call as JSON, or the result's content."""
    call = tool_call_text(turn["name"], turn["arguments"])
    return F.when(turn["type"] == "tool_call", call).when(turn["type"] == "tool_result", turn["content"]).otherwise(turn["text"])


def role_name(role: Column, custom: Column) -> Column:
    """The role, or the custom one for `other`; a role outside the vocabulary is an error."""
    return F.when(role == "other", custom).when(role.isin(*ROLES), role).otherwise(F.raise_error(F.concat(F.lit("unknown role "), role)).cast("string"))
