"""Chat formatting with tool-call linking.

Calls and results are hash-joined by conversation and identifier. Calls may
name others whose results they use ("after"); a call's level is the longest way
down to one that needs none. Levels come from rounds of joins in which every edge
that ends at a call with one open edge jumps over it, so chains halve their length
in a round; a round is needed for each level only of calls that wait for several.
Arguments are parsed once, validated against the tool's schema and written as
canonical JSON: keys in order, no white space. The result is a row for each
message with its canonical line, its level and whether it is linked and valid.
Nothing gathers a conversation in one place, so one with a third of all turns is
like any other: (level, turn, call_id) orders a conversation's lines wherever
they are.

In a table of turns, an assistant's text of the form
{"tool_calls":[{"id":...,"name":...,"arguments":{...},"after":[...]}]} holds
calls; what it has under "content" beside them is a message of its own, as is
the turn if its list of calls is empty. A turn of role "tool" with {"call_id":...,"content":...} is a result.
Every user turn is a call too, to the tool "reply" with its text as prompt, and
an assistant's plain turn right after it that call's result. These calls have names
made of the turn; they are a space of their own, so a written identifier never meets them.

Defined results: a null text counts as empty, a null role as "". Messages of no
call have kind "message" and level 0. Of several calls with one identifier in a
conversation the first (by turn, name and arguments) counts; the others are not linked. A
result is linked if its call exists and doesn't come after it; a call if such a result
exists and all calls that it names do. A tool's turn that can't be read is a result without
identifier, an assistant's turn with "tool_calls" that can't be read a message; neither is
linked nor valid. Calls in a circle, or behind one, have a null level. Repeated
rows give repeated lines. Arguments that are no JSON object are invalid and are
kept as a string under "raw". An empty table gives an empty result. Other
columns are ignored. Rows with a null conv_id or turn are linked with nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

#: Tools with the types of their arguments; each is required and no other is allowed.
SCHEMAS = {"reply": {"prompt": "string"}}
#: What schema_of_variant says of each type.
TYPES = {"string": ("STRING",), "integer": ("BIGINT",), "number": ("BIGINT", "DOUBLE", "DECIMAL"), "boolean": ("BOOLEAN",), "array": ("ARRAY",), "object": ("OBJECT",)}
_CALLS = "tool_calls array<struct<id string, name string, arguments string, after array<string>>>"


def _messages(turns: DataFrame) -> DataFrame:
    """conv_id, turn, kind, made (whether the identifier is), call_id, role, body, broken and, for calls, name, arguments, after."""
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    holds = (F.col("role") == "assistant") & F.col("text").startswith("{") & F.col("text").contains('"tool_calls"')
    rows = rows.withColumns({"holds": holds, "told": F.when(holds, F.from_json("text", f"{_CALLS}, content string")), "back": F.when(F.col("role") == "tool", F.from_json("text", "call_id string, content string"))})
    rows = rows.withColumns({"said": F.col("told.content"), "told": F.col("told.tool_calls")})
    nothing, no, none = F.lit(None).cast("string"), F.lit(False), F.lit(None).cast("array<string>")
    written = rows.where("told IS NOT NULL").select("conv_id", "turn", "role", F.inline("told"))
    written = written.select("conv_id", "turn", F.lit("call").alias("kind"), no.alias("made"), F.col("id").alias("call_id"), "role", nothing.alias("body"), no.alias("broken"), "name", "arguments", "after")
    beside = (F.col("said") != "") | (F.size("told") == 0)
    said = rows.where(F.col("told").isNotNull() & F.coalesce(beside, no))
    said = said.select("conv_id", "turn", F.lit("message").alias("kind"), no.alias("made"), nothing.alias("call_id"), "role", F.coalesce("said", F.lit("")).alias("body"), no.alias("broken"), nothing.alias("name"), nothing.alias("arguments"), none.alias("after"))
    own = F.concat(F.lit("turn-"), F.col("turn").cast("string"))
    plain = rows.where("told IS NULL")
    is_user, is_tool, is_reply = F.col("role") == "user", F.col("role") == "tool", (F.col("role") == "assistant") & ~F.col("holds")
    kind = F.when(is_user & own.isNotNull(), "call").when(is_reply | is_tool, "result").otherwise("message")
    before = F.concat(F.lit("turn-"), (F.col("turn") - 1).cast("string"))
    asked = F.to_json(F.struct(F.col("text").alias("prompt")))
    unread = is_tool & F.col("back.call_id").isNull()
    plain = plain.select(
        "conv_id", "turn", kind.alias("kind"), (~is_tool).alias("made"), F.when(kind == "call", own).when(is_tool, F.col("back.call_id")).when(is_reply, before).alias("call_id"), "role",
        F.when(is_tool & ~unread, F.coalesce("back.content", F.lit(""))).otherwise(F.col("text")).alias("body"), (unread | F.col("holds")).alias("broken"), F.when(kind == "call", "reply").alias("name"), F.when(kind == "call", asked).alias("arguments"), none.alias("after"),
    )
    return plain.unionByName(written).unionByName(said)


def _valid(schemas: dict[str, dict[str, str]]) -> Column:
    """Whether arguments (variant `v`, text `arguments`) are as the tool's schema says."""
    out = F.lit(False)
    for tool, fields in schemas.items():
        fine = F.size(F.array_except(F.json_object_keys("arguments"), F.array(*map(F.lit, fields)).cast("array<string>"))) == 0
        for field, kind in fields.items():
            said = F.schema_of_variant(F.try_variant_get("v", f"$.{field}", "variant"))
            fine &= F.coalesce(F.lit(False), F.lit(False)) if kind not in TYPES else F.coalesce(said.rlike("^(" + "|".join(TYPES[kind]) + ")"), F.lit(False))
        out = F.when(F.col("name") == tool, F.coalesce(fine, F.lit(False))).otherwise(out)
    return out


#: What a way is cut at, so that those in circles don't outgrow a long.
_FAR = 1 << 40


def _levels(calls: DataFrame, scratch: Scratch) -> DataFrame:
    """conv, id and level of every call that can be placed. calls: conv, id, after; identifiers are unique in a conversation."""
    needs = calls.where(F.size("after") > 0).select("conv", "id", F.explode(F.array_distinct("after")).alias("on"))
    if needs.isEmpty():
        return calls.select("conv", "id", F.lit(0).cast("long").alias("level"))
    there = calls.select(F.col("conv").alias("c2"), F.col("id").alias("i2"))
    edges = needs.join(there, (F.col("conv") == F.col("c2")) & (F.col("on") == F.col("i2")), "left_semi")
    wait = edges.groupBy("conv", "id").agg(F.lit(0).cast("long").alias("least"), F.collect_list(F.struct("on", F.lit(1).cast("long").alias("w"))).alias("open"))
    ready = calls.select("conv", "id").join(wait.select(F.col("conv").alias("c2"), F.col("id").alias("i2")), (F.col("conv") == F.col("c2")) & (F.col("id") == F.col("i2")), "left_anti")
    # A call's level is the most of `least` and, for each open edge, w and the level of the call at its end.
    nodes = scratch.cut(ready.select("conv", "id", F.lit(0).cast("long").alias("least"), F.array().cast("array<struct<on:string,w:bigint>>").alias("open")).unionByName(wait))
    left = -1
    while (now := nodes.where(F.size("open") > 0).count()) not in (0, left):  # if none was placed, the rest stand in a circle or behind one
        left = now
        at = nodes.where(F.size("open") <= 1).select(F.col("conv").alias("c2"), F.col("id").alias("i2"), F.col("least").alias("least2"), F.get("open", F.lit(0)).alias("next"))
        each = nodes.where(F.size("open") > 0).select("conv", "id", "least", F.inline("open")).join(at, (F.col("conv") == F.col("c2")) & (F.col("on") == F.col("i2")), "left")
        known = F.col("i2").isNotNull()
        each = each.select("conv", "id", F.greatest("least", F.when(known, F.col("least2") + F.col("w"))).alias("least"), F.when(known, F.col("next.on")).otherwise(F.col("on")).alias("on"), F.least(F.when(known, F.col("w") + F.col("next.w")).otherwise(F.col("w")), F.lit(_FAR)).alias("w"))
        each = each.groupBy("conv", "id", "on").agg(F.max("least").alias("least"), F.max("w").alias("w"))
        moved = each.groupBy("conv", "id").agg(F.max("least").alias("least"), F.collect_list(F.when(F.col("on").isNotNull(), F.struct("on", "w"))).alias("open"))
        new = scratch.cut(nodes.where(F.size("open") == 0).unionByName(moved))
        scratch.drop(nodes)
        nodes = new
    return nodes.where(F.size("open") == 0).select("conv", "id", F.col("least").alias("level"))


def format_chats(turns: DataFrame, schemas: dict[str, dict[str, str]] = SCHEMAS) -> DataFrame:
    """conv_id, turn, kind, call_id, level, linked, valid, line of every message."""
    scratch = Scratch(turns.sparkSession, "chat")
    rows = scratch.cut(_messages(turns))
    calls = rows.where("kind = 'call' AND conv_id IS NOT NULL AND turn IS NOT NULL AND call_id IS NOT NULL")
    first = calls.groupBy(F.col("conv_id").alias("conv"), F.col("made").alias("made2"), F.col("call_id").alias("id")).agg(F.min(F.struct("turn", "name", F.sha2("arguments", 256).alias("hash"), F.coalesce("after", F.array().cast("array<string>")).alias("after"))).alias("f"))
    first = first.select("conv", "made2", "id", F.col("f.turn").alias("first_turn"), F.col("f.name").alias("first_name"), F.col("f.hash").alias("first_hash"), F.col("f.after").alias("after"))
    written = first.where("NOT made2")
    level = _levels(written.select("conv", "id", "after"), scratch).withColumn("made3", F.lit(False))
    answers = rows.where("kind = 'result'").groupBy(F.col("conv_id").alias("c2"), F.col("made").alias("m2"), F.col("call_id").alias("i2")).agg(F.max("turn").alias("last_answer"))
    known = first.join(answers, (F.col("conv") == F.col("c2")) & (F.col("made2") == F.col("m2")) & (F.col("id") == F.col("i2")), "left").drop("c2", "m2", "i2")
    known = known.join(level.toDF("c3", "i3", "level", "made3"), (F.col("conv") == F.col("c3")) & (F.col("made2") == F.col("made3")) & (F.col("id") == F.col("i3")), "left").drop("c3", "i3", "made3")
    # Names of calls that don't exist: few, so only calls with any are looked at.
    on = written.select("conv", "id", F.explode("after").alias("on"))
    lost = on.join(written.select(F.col("conv").alias("c4"), F.col("id").alias("i4")), (F.col("conv") == F.col("c4")) & (F.col("on") == F.col("i4")), "left_anti").select(F.col("conv").alias("c5"), F.lit(False).alias("made5"), F.col("id").alias("i5")).distinct().withColumn("lost", F.lit(True))
    known = known.join(lost, (F.col("conv") == F.col("c5")) & (F.col("made2") == F.col("made5")) & (F.col("id") == F.col("i5")), "left").drop("c5", "made5", "i5", "after")
    known = known.withColumn("level", F.when(F.col("made2"), F.lit(0).cast("long")).otherwise(F.col("level")))
    out = rows.join(known, (F.col("conv_id") == F.col("conv")) & (F.col("made") == F.col("made2")) & (F.col("call_id") == F.col("id")), "left")
    is_call, is_result = F.col("kind") == "call", F.col("kind") == "result"
    counts = F.col("first_turn").eqNullSafe(F.col("turn")) & F.col("first_name").eqNullSafe(F.col("name")) & F.col("first_hash").eqNullSafe(F.sha2("arguments", 256))
    answered = F.col("last_answer") >= F.col("first_turn")
    follows = is_result & F.coalesce(F.col("turn") >= F.col("first_turn"), F.lit(False))
    linked = F.when(is_call, F.coalesce(counts & answered & F.col("lost").isNull(), F.lit(False))).when(is_result, follows).otherwise(~F.col("broken"))
    out = out.withColumn("v", F.when(is_call, F.try_parse_json("arguments")))
    object_ = F.when(F.schema_of_variant("v").startswith("OBJECT"), F.to_json("v"))
    told = F.coalesce(object_, F.to_json(F.struct(F.coalesce("arguments", F.lit("")).alias("raw"))))
    rest = lambda *c: F.substring(F.to_json(F.struct(*c)), 2, 2**30)
    line = (
        F.when(is_call, F.concat(F.lit('{"arguments":'), told, F.lit(","), rest(F.coalesce("call_id", F.lit("")).alias("id"), F.coalesce("name", F.lit("")).alias("name"), F.lit("call").alias("type"))))
        .when(is_result, F.to_json(F.struct(F.coalesce("call_id", F.lit("")).alias("call_id"), F.col("body").alias("content"), F.lit("result").alias("type"))))
        .otherwise(F.to_json(F.struct(F.col("body").alias("content"), "role", F.lit("message").alias("type"))))
    )
    place = F.when(is_call, F.col("level") * 2).when(follows, F.col("level") * 2 + 1).otherwise(F.lit(0))
    out = out.select("conv_id", "turn", "kind", "call_id", place.cast("long").alias("level"), linked.alias("linked"), F.when(is_call, _valid(schemas)).otherwise(~F.col("broken")).alias("valid"), line.alias("line"))
    return scratch.result(out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


#: For turns whose texts hold no calls of their own, which is all that the tables have; tests cover the others.
SQL = r"""
WITH m AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS body,
         CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'message' END AS kind,
         CASE role WHEN 'user' THEN 'turn-' || turn WHEN 'assistant' THEN 'turn-' || (turn - 1) END AS call_id
  FROM conversations),
first AS (SELECT conv_id, call_id, min(sha256('{"prompt":' || to_json(body) || '}')) AS hash FROM m WHERE kind = 'call' GROUP BY ALL),
answered AS (SELECT DISTINCT conv_id, call_id FROM m WHERE kind = 'result')
SELECT m.conv_id, m.turn, m.kind, m.call_id,
       CASE WHEN m.kind = 'result' AND f.call_id IS NOT NULL THEN 1 ELSE 0 END::BIGINT AS level,
       CASE m.kind WHEN 'call' THEN a.call_id IS NOT NULL AND f.hash = sha256('{"prompt":' || to_json(m.body) || '}') WHEN 'result' THEN f.call_id IS NOT NULL ELSE true END AS linked,
       true AS valid,
       CASE m.kind WHEN 'call' THEN '{"arguments":{"prompt":' || to_json(m.body) || '},"id":' || to_json(m.call_id) || ',"name":"reply","type":"call"}'
                   WHEN 'result' THEN '{"call_id":' || to_json(m.call_id) || ',"content":' || to_json(m.body) || ',"type":"result"}'
                   ELSE '{"content":' || to_json(m.body) || ',"role":' || to_json(m.role) || ',"type":"message"}' END AS line
FROM m LEFT JOIN first f ON f.conv_id = m.conv_id AND f.call_id = m.call_id LEFT JOIN answered a ON a.conv_id = m.conv_id AND a.call_id = m.call_id
"""
