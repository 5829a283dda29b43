"""The agent loop as a fold over a conversation's turns: which state takes each turn, what of it is learnt, and where the limits end it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def agent_turns(turns: Column, response_length: int, assistant_turns: int | None = None, user_turns: int | None = None, interaction: bool = False) -> Column:
    """turns: ordered array<struct<role, tokens, calls, stop>> after the prompt -> array of structs, one for each turn: state (that took it), next
    (state after it), mask (1 if its tokens are learnt), start (in the response), kept (tokens within response_length), assistants and users (turns so far).

    generating takes an assistant's turn: the end if the response is full or a limit of turns is reached; else tools if it calls any,
    interacting if there is an interaction, else the end. tools takes a turn of role tool, whose tokens aren't learnt: the end, without them, if
    they would fill the response. interacting takes a user's turn: the end if it says stop. A turn that its state doesn't take ends the loop, and after the
    end turns are left out (state terminated, nothing kept). Null counts are 0 and a null stop is false."""

    def end(when: Column, other: Column | str) -> Column:
        return F.when(when, "terminated").otherwise(F.lit(other) if isinstance(other, str) else other)

    def step(s: Column, t: Column) -> Column:
        n, calls = F.coalesce(t["tokens"].cast("int"), F.lit(0)), F.coalesce(t["calls"].cast("int"), F.lit(0))
        taken = F.when(s["state"] == "generating", t["role"] == "assistant").when(s["state"] == "tools", t["role"] == "tool").when(s["state"] == "interacting", t["role"] == "user")
        full = (s["state"] == "tools") & (s["length"] + n >= response_length)
        ok = F.coalesce(taken, F.lit(False)) & ~full
        model = s["state"] == "generating"
        a = s["assistants"] + F.when(ok & model, 1).otherwise(0)
        u = s["users"] + F.when(ok & ~model, 1).otherwise(0)
        length = s["length"] + F.when(ok, n).otherwise(0)
        limits = length >= response_length
        limits = limits if assistant_turns is None else limits | (a >= assistant_turns)
        limits = limits if user_turns is None else limits | (u >= user_turns)
        more = F.when(calls > 0, "tools").otherwise(F.lit("interacting" if interaction else "terminated"))
        after = F.when(model, end(limits, more)).when(s["state"] == "tools", F.lit("generating")).otherwise(end(F.coalesce(t["stop"], F.lit(False)), "generating"))
        new = end(~ok, after)
        row = F.struct(
            s["state"].alias("state"), new.alias("next"), F.when(ok & model, 1).otherwise(0).alias("mask"), s["length"].alias("start"),
            F.greatest(F.least(length, F.lit(response_length)) - s["length"], F.lit(0)).alias("kept"), a.alias("assistants"), u.alias("users"),
        )
        return F.struct(new.alias("state"), length.alias("length"), a.alias("assistants"), u.alias("users"), F.concat(s["out"], F.array(row)).alias("out"))

    none = F.expr("cast(array() as array<struct<state:string,next:string,mask:int,start:int,kept:int,assistants:int,users:int>>)")
    first = F.struct(F.lit("generating").alias("state"), F.lit(0).alias("length"), F.lit(0).alias("assistants"), F.lit(0).alias("users"), none.alias("out"))
    return F.aggregate(turns, first, step, lambda s: s["out"])


def response_mask(turns: Column) -> Column:
    """The response's mask, token by token, from agent_turns()."""
    return F.flatten(F.transform(turns, lambda t: F.array_repeat(t["mask"], t["kept"])))


def num_turns(turns: Column) -> Column:
    """Turns of users and assistants, and the prompt's."""
    last = F.element_at(turns, -1)
    return F.when(F.size(turns) > 0, last["assistants"] + last["users"] + 1).otherwise(F.lit(1))
