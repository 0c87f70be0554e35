"""Chat formatting: tool-call linking with DataFrame functions alone.

Calls and results of a conversation meet by identifier in one shuffled hash join with an aggregate of one row an
identifier, so a hot conversation or identifier never becomes one task's group. A call may need the results of other
calls of its conversation; such needs are peeled off level by level, one round for each level, until no call is left whose
needs are all placed. Messages get a topological key (topo_turn, topo_level, topo_step, turn): a call's topo_turn is the
latest turn among its own and those that it needs, its level is one more than theirs, and a result is a step behind its
call. Sorted by the key, every result follows its call and every call the results that it needs, wherever they were
written. Arguments are validated against the schema of the call's tool, and every message becomes one line of canonical
JSON (keys sorted, no white space, absent fields left out, escapes as in RFC 8785).

Results for odd rows: of calls that repeat an identifier the one of the least turn is linked, the others are `repeated`
(ties in turn are linked alike); a result that repeats its identifier is linked as well; a null identifier links with
nothing; calls whose needs run in a circle, and those that need one of them, are `circular` with their own turn and level
0; a need of no call is no need; a tool without a schema gives the error `tool:unknown`; a null or empty text is an absent
or empty field; very long texts are written whole; repeated rows give one row each; an empty table gives an empty table;
other columns are not read, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.llm.common import Scratch, table

#: Of the arguments of the query's calls: (field, type, required, least, most); least and most bound a number, or a text's length.
REPLY_SCHEMA = [
    ("content", "string", True, 1, 400),
    ("n_chars", "integer", True, 0, 400),
    ("turn", "integer", True, 0, None),
]
_TYPES = {"string": (T.StringType,), "integer": (T.LongType, T.IntegerType, T.ShortType, T.ByteType), "number": (T.DoubleType, T.FloatType, T.LongType, T.IntegerType, T.DecimalType), "boolean": (T.BooleanType,)}


def errors_of(arguments: str, kind: T.StructType, schema: list[tuple]) -> Column:
    """What is wrong with a struct of arguments, in order of the schema: `field:required`, `field:type`, `field:least`, `field:most`, then `field:unknown` by name."""
    found: list[Column] = []
    types = {f.name: f.dataType for f in kind.fields}
    for field, want, required, least, most in schema:
        if field not in types:
            found += [F.lit(f"{field}:required")] if required else []
            continue
        value = F.col(arguments).getField(field)
        if required:
            found.append(F.when(value.isNull(), f"{field}:required"))
        if not isinstance(types[field], _TYPES[want]):
            found.append(F.when(value.isNotNull(), f"{field}:type"))
            continue
        size = F.char_length(value) if want == "string" else value
        found += [F.when(size < least, f"{field}:least")] if least is not None else []
        found += [F.when(size > most, f"{field}:most")] if most is not None else []
    for name in sorted(set(types) - {s[0] for s in schema}):
        found.append(F.when(F.col(arguments).getField(name).isNotNull(), f"{name}:unknown"))
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def sorted_fields(value: Column, kind: T.DataType) -> Column:
    """The value with the fields of every struct in it in order of name."""
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        return F.when(value.isNotNull(), F.struct(*[sorted_fields(value.getField(f.name), f.dataType).alias(f.name) for f in fields]))
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType | T.ArrayType):
        return F.transform(value, lambda x: sorted_fields(x, kind.elementType))
    return value


def canonical_json(value: Column) -> Column:
    """to_json with the hex digits of escapes in lower case; only escapes are met, not escaped backslashes before a u."""
    json = F.to_json(value)

    def lowered(text: Column, code: int) -> Column:
        return F.regexp_replace(text, rf"(?<!\\)((?:\\\\)*)\\u{code:04X}", rf"$1\\u{code:04x}")

    codes = [c for c in range(0x20) if f"{c:04X}" != f"{c:04x}" and chr(c) not in "\b\t\n\f\r"]
    return F.when(F.contains(json, F.lit(r"\u00")), reduce(lowered, codes, json)).otherwise(json)


def levels(spark: SparkSession, calls: DataFrame) -> DataFrame:
    """(conv_id, link_id, need_turn, need_level) of calls (conv_id, link_id, turn, needs) that need others; null for those in or behind a circle."""
    scratch = Scratch(spark, "calls")
    by = ["conv_id", "link_id"]
    ids = scratch.put(calls.groupBy(*by).agg(F.min("turn").alias("turn"), F.min_by("needs", "turn").alias("needs")), "ids")
    names = ids.select("conv_id", F.col("link_id").alias("need"))
    needs = ids.select(*by, "turn", F.explode(F.array_distinct("needs")).alias("need")).join(names, ["conv_id", "need"])
    needs = scratch.put(needs.withColumn("n", F.count("*").over(Window.partitionBy(*by))), "needs")
    # a round's calls are the next round's needs
    front = scratch.put(ids.join(needs.select(*by).distinct(), by, "left_anti").select("conv_id", F.col("link_id").alias("need"), F.col("turn").alias("at"), F.lit(0).alias("level")), "level")
    placed, met = [], scratch.put(needs.limit(0).select(*by, "turn", "n", F.lit(0).alias("seen"), F.lit(0).alias("level"), F.col("turn").alias("at")), "met")
    while needs.limit(1).count():
        now = needs.join(front, ["conv_id", "need"]).groupBy(*by, "turn", "n").agg(F.count("*").cast("int").alias("seen"), F.max("level").alias("level"), F.max("at").alias("at"))
        now = scratch.put(met.unionByName(now).groupBy(*by, "turn", "n").agg(F.sum("seen").cast("int").alias("seen"), F.max("level").alias("level"), F.max("at").alias("at")), "met")
        ready = now.where("seen = n")
        if not ready.limit(1).count():
            break
        placed.append(ready.select(*by, F.greatest("at", "turn").alias("need_turn"), (F.col("level") + 1).alias("need_level")))
        front, met = placed[-1].select("conv_id", F.col("link_id").alias("need"), F.col("need_turn").alias("at"), F.col("need_level").alias("level")), now.where("seen < n")
    wanted = needs.select(*by).distinct()
    if not placed:
        return wanted.withColumn("need_turn", F.lit(None).cast("long")).withColumn("need_level", F.lit(None).cast("int"))
    return wanted.join(reduce(DataFrame.unionByName, placed), by, "left")


def link(messages: DataFrame, schema: list[tuple] | dict[str, list[tuple]]) -> DataFrame:
    """Links messages (conv_id, turn, role, kind, link_id, content, arguments) and serialises them.

    kind is call, result or message; link_id is the identifier of a call or of the call that a result answers. Where there
    is a column needs (array<string>), it has the identifiers of calls that a call needs; with a schema for each tool, a
    column tool names that of a call.
    """
    tools = isinstance(schema, dict)
    by, with_needs = ["conv_id", "link_id"], "needs" in messages.columns
    m = messages.select(*by, "turn", "role", "kind", "content", "arguments", *["tool"] * tools, *["needs"] * with_needs)
    arguments = m.schema["arguments"].dataType
    linking = F.col("link_id").isNotNull() & F.col("kind").isin("call", "result")
    of_id = m.where(linking).groupBy(*by)
    ids = of_id.agg(F.min(F.when(F.col("kind") == "call", F.col("turn"))).alias("call_turn"), F.count_if(F.col("kind") == "result").alias("n_results"))
    if with_needs:
        ids = ids.join(levels(messages.sparkSession, m.where(linking & (F.col("kind") == "call")).select(*by, "turn", "needs")).withColumn("has_needs", F.lit(True)), by, "left")
        ids = ids.withColumns({"circular": F.coalesce("has_needs", F.lit(False)) & F.col("need_turn").isNull(), "call_at": F.coalesce("need_turn", "call_turn"), "level": F.coalesce("need_level", F.lit(0))}).drop("has_needs", "need_turn", "need_level")
    else:
        ids = ids.withColumns({"circular": F.lit(False), "call_at": F.col("call_turn"), "level": F.lit(0)})
    # what has no identifier would all meet in one task, and is spread
    spread = lambda linked: F.when(linked, F.lit(0)).otherwise(F.pmod(F.xxhash64("turn", "role", "content"), F.lit(1 << 20)) + 1)
    m = m.withColumn("spread", spread(F.col("link_id").isNotNull())).join(ids.withColumn("spread", F.lit(0).cast("long")).hint("shuffle_hash"), [*by, "spread"], "left")
    is_call, is_result = F.col("kind") == "call", F.col("kind") == "result"
    first = is_call & (F.col("turn") == F.col("call_turn"))
    status = (
        F.when(F.col("kind") == "message", "message")
        .when(is_call & (F.col("turn") != F.col("call_turn")), "repeated")
        .when(first & F.col("circular"), "circular")
        .when(is_call, F.when(F.coalesce("n_results", F.lit(0)) > 0, "linked").otherwise("no_result"))
        .otherwise(F.when(F.col("call_turn").isNotNull(), "linked").otherwise("no_call"))
    )
    m = m.withColumn("status", status)
    placed = is_result | first
    m = m.withColumn("topo_turn", F.when(placed, F.coalesce("call_at", "turn")).otherwise(F.col("turn"))).withColumn("topo_level", F.when(placed, F.coalesce("level", F.lit(0))).otherwise(0).cast("int"))
    m = m.withColumn("topo_step", F.when(is_result & F.col("call_turn").isNotNull(), 1).otherwise(0))
    if tools:
        found = F.lit("tool:unknown")
        for tool, fields in schema.items():
            found = F.when(F.col("tool") == tool, F.array_join(errors_of("arguments", arguments, fields), ",")).otherwise(found)
    else:
        found = F.array_join(errors_of("arguments", arguments, schema), ",")
    m = m.withColumn("errors", F.when(is_call, found).otherwise(""))
    line = F.struct(
        F.when(is_call, sorted_fields(F.col("arguments"), arguments)).alias("arguments"),
        F.when(is_result, F.col("link_id")).alias("call_id"),
        F.when(~is_call, F.col("content")).alias("content"),
        F.when(is_call, F.col("link_id")).alias("id"),
        F.col("role"),
        *[F.when(is_call, F.col("tool")).alias("tool")] * tools,
        F.col("turn"),
        F.when(is_call, "call").when(is_result, "result").otherwise("message").alias("type"),
    )
    return m.select("conv_id", "turn", "role", "kind", "link_id", "status", F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"), "topo_turn", "topo_level", F.col("topo_step").cast("int").alias("topo_step"), "errors", canonical_json(line).alias("json"))


def turns_as_calls(conversations: DataFrame) -> DataFrame:
    """Conversations as linkable messages: a user's turn is a call of the assistant, the assistant's turn the result of the turn before."""
    role = F.lower("role")
    kind = F.when(role == "user", "call").when(role == "assistant", "result").otherwise("message")
    asked = F.when(role == "assistant", F.col("turn") - 1).when(role == "user", F.col("turn"))
    c = conversations.select("conv_id", "turn", "role", "text").withColumn("kind", kind)
    c = c.withColumn("link_id", F.concat(F.lit("call_"), F.col("conv_id").cast("string"), F.lit("_"), asked.cast("string")))
    arguments = F.struct(F.col("turn").alias("turn"), F.char_length("text").cast("long").alias("n_chars"), F.col("text").alias("content"))
    return c.select("conv_id", "turn", "role", "kind", "link_id", F.col("text").alias("content"), arguments.alias("arguments"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(turns_as_calls(table(spark, sf_dir, "conversations")), REPLY_SCHEMA)


OP8_SQL = r"""
WITH m AS (
  SELECT conv_id, turn, role, text,
         CASE lower(role) WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'message' END AS kind,
         'call_' || CAST(conv_id AS VARCHAR) || '_' || CAST(CASE lower(role) WHEN 'assistant' THEN turn - 1 WHEN 'user' THEN turn END AS VARCHAR) AS link_id,
         '"' || replace(replace(replace(replace(replace(text, '\', '\\'), '"', '\"'), chr(10), '\n'), chr(13), '\r'), chr(9), '\t') || '"' AS quoted
  FROM conversations
), ids AS (
  SELECT conv_id, link_id, min(CASE WHEN kind = 'call' THEN turn END) AS call_turn,
         count(CASE WHEN kind = 'result' THEN 1 END) AS n_results
  FROM m WHERE link_id IS NOT NULL AND kind <> 'message' GROUP BY conv_id, link_id
)
SELECT m.conv_id, m.turn, m.role, m.kind, m.link_id,
  CASE WHEN kind = 'message' THEN 'message'
       WHEN kind = 'call' AND turn <> call_turn THEN 'repeated'
       WHEN kind = 'call' AND n_results > 0 THEN 'linked'
       WHEN kind = 'call' THEN 'no_result'
       WHEN call_turn IS NOT NULL THEN 'linked' ELSE 'no_call' END AS status,
  CAST(coalesce(n_results, 0) AS BIGINT) AS n_results,
  CASE WHEN kind = 'result' THEN coalesce(call_turn, turn) ELSE turn END AS topo_turn,
  CAST(0 AS INTEGER) AS topo_level,
  CAST(CASE WHEN kind = 'result' AND call_turn IS NOT NULL THEN 1 ELSE 0 END AS INTEGER) AS topo_step,
  CASE WHEN kind <> 'call' THEN '' ELSE concat_ws(',',
       CASE WHEN text IS NULL THEN 'content:required' END,
       CASE WHEN length(text) < 1 THEN 'content:least' END,
       CASE WHEN length(text) > 400 THEN 'content:most' END,
       CASE WHEN text IS NULL THEN 'n_chars:required' END,
       CASE WHEN length(text) > 400 THEN 'n_chars:most' END,
       CASE WHEN turn IS NULL THEN 'turn:required' END,
       CASE WHEN turn < 0 THEN 'turn:least' END) END AS errors,
  '{' || concat_ws(',',
       CASE WHEN kind = 'call' THEN '"arguments":{' || concat_ws(',', '"content":' || quoted, '"n_chars":' || CAST(length(text) AS VARCHAR), '"turn":' || CAST(turn AS VARCHAR)) || '}' END,
       CASE WHEN kind = 'result' THEN '"call_id":"' || m.link_id || '"' END,
       CASE WHEN kind <> 'call' THEN '"content":' || quoted END,
       CASE WHEN kind = 'call' THEN '"id":"' || m.link_id || '"' END,
       '"role":"' || role || '"',
       '"turn":' || CAST(turn AS VARCHAR),
       '"type":"' || kind || '"') || '}' AS json
FROM m LEFT JOIN ids ON m.conv_id = ids.conv_id AND m.link_id = ids.link_id
"""
