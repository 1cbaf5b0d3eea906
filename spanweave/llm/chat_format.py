"""Operator 10 (DataFrame functions only): fold a conversation log and render it.

The log has one event a row: ``conv_id``, ``seq``, ``op``, ``role``, ``text`` and ``target``.
Sorted by sequence, events fold into final messages: ``message`` opens a turn, ``delta``
appends to the turn that ``target`` (the sequence of its opening event) names, ``edit`` sets
that turn's text anew, ``regenerate`` too, dropping every later turn of the conversation.
Without a target the last open turn is meant.  Turns that were opened under one sequence are
changed together; events whose turn does not exist change nothing.

A conversation is rendered with marks round each turn; control strings inside roles and
texts are broken by a backslash after their first character and backslashes are doubled, so
no text can open or close a turn and every text can be had back.  ``loss`` lists the parts
of the output under the loss mask as character offsets and lengths: the texts of the roles
named.

One conversation becomes one row, so its length bounds a task; a table's other skew does not.
Null texts and roles are empty, a null ``op`` is a message.  Events with equal sequence are
ordered by operation, role and text; repeated rows are events of their own.  A null
``conv_id`` is one conversation.  Texts of any length are rendered whole.  An empty log gives no
rows.  Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the template and control strings of common chat templates.
TURN, SEP, END = "<|turn|>", "<|text|>", "<|end|>"
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<start_of_turn>", "<end_of_turn>")
LOSS_ROLES = ("assistant",)


def escape(s: Column) -> Column:
    s = F.replace(s, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        s = F.replace(s, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return s


def unescape(s: Column) -> Column:
    return F.regexp_replace(s, r"(?s)\\(.)", "$1")


def as_log(turns: DataFrame) -> DataFrame:
    """Plain turns (``conv_id``, ``turn``, ``role``, ``text``) as a log of messages."""
    none = F.lit(None)
    return turns.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("seq"), F.lit("message").alias("op"),
        F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"), none.cast("bigint").alias("target"),
    )


def fold(log: DataFrame) -> DataFrame:
    """``conv_id`` and ``turns``: array of (seq, role, text) after all events."""
    empty = F.lit("")
    event = F.struct(
        F.col("seq").cast("bigint").alias("seq"), F.coalesce(F.col("op").cast("string"), F.lit("message")).alias("op"),
        F.coalesce(F.col("role").cast("string"), empty).alias("role"), F.coalesce(F.col("text").cast("string"), empty).alias("text"),
        F.col("target").cast("bigint").alias("target"),
    )
    events = log.groupBy("conv_id").agg(F.sort_array(F.collect_list(event)).alias("e"))
    n = lambda e: F.struct(e["seq"], e["role"], e["text"])
    opened = F.transform(F.filter("e", lambda e: e["op"] == "message"), n)
    changed = F.exists("e", lambda e: e["op"] != "message")

    def step(turns: Column, e: Column) -> Column:
        last = F.coalesce(e["target"], F.try_element_at(turns, F.lit(-1))["seq"])
        new = lambda t: F.struct(
            t["seq"].alias("seq"), t["role"].alias("role"),
            F.when(~t["seq"].eqNullSafe(last), t["text"]).when(e["op"] == "delta", F.concat(t["text"], e["text"])).otherwise(e["text"]).alias("text"),
        )
        held = F.when(e["op"] == "regenerate", F.filter(turns, lambda t: ~(t["seq"] > F.coalesce(last, t["seq"])))).otherwise(turns)
        return F.when(e["op"] == "message", F.array_append(turns, n(e))).otherwise(F.transform(held, new))

    kind = "array<struct<seq:bigint,role:string,text:string>>"
    folded = F.aggregate("e", F.array().cast(kind), lambda t, e: step(t, e).cast(kind))
    return events.select("conv_id", F.when(changed, folded).otherwise(opened.cast(kind)).alias("turns"))


def render(folded: DataFrame, loss_roles: tuple[str, ...] = LOSS_ROLES) -> DataFrame:
    """``conv_id``, ``formatted`` and ``loss``: array of (start, length) in code points, start from 0."""
    parts = folded.select(
        "conv_id",
        F.transform(
            "turns",
            lambda t: F.struct(
                F.concat(F.lit(TURN), escape(t["role"]), F.lit(SEP)).alias("head"), escape(t["text"]).alias("body"), t["role"].isin(*loss_roles).alias("on")
            ),
        ).alias("parts"),
    )
    size = lambda p: F.char_length(p["head"]) + F.char_length(p["body"]) + len(END)
    state = "struct<at:bigint,spans:array<struct<start:bigint,length:bigint>>>"

    def add(s: Column, p: Column) -> Column:
        span = F.struct((s["at"] + F.char_length(p["head"])).alias("start"), F.char_length(p["body"]).cast("bigint").alias("length"))
        return F.struct((s["at"] + size(p)).alias("at"), F.when(p["on"], F.array_append(s["spans"], span)).otherwise(s["spans"]).alias("spans")).cast(state)

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))
    return parts.select(
        "conv_id",
        F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "").alias("formatted"),
        F.aggregate("parts", start.cast(state), add, lambda s: s["spans"]).alias("loss"),
    )


def chat_format(log: DataFrame, loss_roles: tuple[str, ...] = LOSS_ROLES) -> DataFrame:
    return render(fold(log), loss_roles)


def parse(formatted: Column) -> Column:
    """Turns back from the output: array of (role, text)."""
    bodies = F.filter(F.split(formatted, r"\Q" + TURN + r"\E", -1), lambda s: s != "")
    turn = lambda s: F.struct(
        unescape(F.substring_index(s, SEP, 1)).alias("role"),
        unescape(F.substring_index(F.substring_index(s, SEP, -1), END, 1)).alias("text"),
    )
    return F.transform(bodies, turn)


def under_loss(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
