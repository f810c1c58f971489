"""Chat formatting: tool-call linking, in DataFrame functions only.

Calls (call_id, after, name, arguments) and results (call_id, content) are joined by hash on the identifier. after names the call whose
result a call waits for; levels of that order come from pointer doubling (each round a call adds its pointer's level and takes over its
pointer), so a chain of n calls takes log2(n) joins, in a conversation of any length. Arguments are parsed as JSON and checked against
their tool's schema, and every call with its result is written as canonical JSON: keys sorted at every depth, no white space,
numbers as parsed.

Scale. Every join is by call identifier, never by conversation, so a conversation that holds a third of all turns is spread; rows that
repeat an identifier are reduced before they meet; rounds carry identifiers only.

Nulls and odd input: rows without an identifier take no part; of rows that repeat one the least (name, arguments, after) is used and
n_rows counts them, and of results the least content, and n_results counts them; a result that names no call has a row of its own with
n_rows 0, no name and level, linked false and the error "no call"; an after that names no call is a root's; a call in or behind a cycle has a null
level; arguments that are null or no JSON object are invalid, and canonical JSON then holds null; a call without a result has a null
one; other columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: JSON types, by the start of the parsed value's type name.
TYPES = {"string": ("STRING",), "integer": ("BIGINT",), "number": ("BIGINT", "DECIMAL", "DOUBLE"), "boolean": ("BOOLEAN",), "object": ("OBJECT",), "array": ("ARRAY",)}


def json_string(c: Column) -> Column:
    """A string as JSON text; null stays null."""
    return F.when(c.isNotNull(), F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1))


def errors(name: Column, parsed: Column, schemas: dict[str, dict]) -> Column:
    """Why arguments don't fit their tool's schema, as a sorted array of texts. A schema has properties {field: type} and required [field]."""
    kind = F.schema_of_variant(parsed)
    per_tool = F.when(parsed.isNull() | ~kind.startswith("OBJECT"), F.array(F.lit("not an object")))
    for tool, schema in sorted(schemas.items()):
        found = []
        for field, kind_name in sorted(schema["properties"].items()):
            value = F.try_variant_get(parsed, f"$.{field}", "variant")
            fits = F.lit(False)
            for t in TYPES[kind_name]:
                fits = fits | F.schema_of_variant(value).startswith(t)
            missing = F.lit(f"{field} missing") if field in schema.get("required", ()) else F.lit(None).cast("string")
            found.append(F.when(value.isNull(), missing).when(~fits, F.lit(f"{field} is not {kind_name}")))
        per_tool = per_tool.when(name == tool, F.array_compact(F.array(*found)) if found else F.array().cast("array<string>"))
    return per_tool.otherwise(F.array(F.lit("unknown tool")))


def levels(calls: DataFrame) -> DataFrame:
    """(call_id, after), one row per call_id -> (call_id, level)."""
    ids = calls.select(F.col("call_id").alias("id"))
    now = calls.join(ids, calls["after"] == ids["id"], "left").select("call_id", F.col("id").alias("at"), F.when(F.col("id").isNull(), 0).otherwise(1).cast("long").alias("level"))
    now = materialize(now)
    waiting = now.where("at is not null").count()
    done = now.where("at is null")
    for _ in range(math.ceil(math.log2(waiting + 1)) + 1 if waiting else 0):
        target = now.select(F.col("call_id").alias("at"), F.col("at").alias("to"), F.col("level").alias("more"))
        moved = materialize(now.where("at is not null").join(target, "at").select("call_id", F.col("to").alias("at"), (F.col("level") + F.col("more")).alias("level")))
        now = moved.unionByName(done)
        done = done.unionByName(moved.where("at is null"))
        if moved.where("at is not null").isEmpty():
            break
    return now.select("call_id", F.when(F.col("at").isNull(), F.col("level")).alias("level"))


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """-> call_id, name, level, n_rows, n_results, linked, valid, errors, canonical; one row per identifier of a call or a result, ordered by
    nothing: sort by level, call_id."""
    calls = calls.where("call_id is not null").groupBy("call_id").agg(F.min(F.struct("name", "arguments", "after")).alias("c"), F.count("*").alias("n_rows"))
    calls = calls.select("call_id", "c.*", "n_rows")
    results = results.where("call_id is not null").groupBy("call_id").agg(F.min("content").alias("content"), F.count("*").alias("n_results"))
    order = levels(materialize(calls.select("call_id", "after")))
    both = calls.join(order, "call_id").join(results, "call_id", "full")
    why = F.when(F.col("n_rows").isNull(), "no call").otherwise(F.array_join(errors(F.col("name"), F.col("parsed"), schemas), "; "))
    both = both.withColumn("parsed", F.try_parse_json("arguments")).withColumn("errors", why)
    is_object = F.coalesce(F.schema_of_variant("parsed").startswith("OBJECT"), F.lit(False))
    part = lambda c: F.coalesce(c, F.lit("null"))
    canonical = F.concat(
        F.lit('{"arguments":'), part(F.when(is_object, F.to_json("parsed"))), F.lit(',"id":'), part(json_string(F.col("call_id"))), F.lit(',"level":'), part(F.col("level").cast("string")),
        F.lit(',"name":'), part(json_string(F.col("name"))), F.lit(',"result":'), part(json_string(F.col("content"))), F.lit("}"),
    )
    n = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    linked = F.col("n_rows").isNotNull() & F.col("n_results").isNotNull()
    return both.select("call_id", "name", "level", n("n_rows"), n("n_results"), linked.alias("linked"), (F.col("errors") == "").alias("valid"), "errors", canonical.alias("canonical"))


def turns_as_calls(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A conversation table as calls and results: each user turn calls reply, the assistant's turn right after it is the result, and
    the next user turn waits for it. The table has no tool calls of its own; rows without conv_id or turn take no part."""
    rows = messages.where("conv_id is not null and turn is not null")
    at = lambda back: F.concat_ws(":", F.col("conv_id").cast("string"), (F.col("turn") - back).cast("string"))
    asked = F.to_json(F.struct(F.col("turn").cast("long").alias("turn"), F.col("text").alias("prompt")), {"ignoreNullFields": "true"})
    answers = rows.where("role = 'assistant'")
    results = answers.select(at(1).alias("call_id"), F.col("text").alias("content"))
    answered = results.select(F.col("call_id").alias("after")).distinct()
    calls = rows.where("role = 'user'").select(at(0).alias("call_id"), at(2).alias("before"), F.lit("reply").alias("name"), asked.alias("arguments"))
    calls = calls.join(answered, calls["before"] == answered["after"], "left").select("call_id", "after", "name", "arguments")
    return calls, results


def all_turns_as_calls(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """turns_as_calls() and the turns it leaves out: each turn that is neither a user's nor an assistant's is a call named by its role,
    under an identifier of its own (conversation:turn:role) and with no result. Assistant turns not right after a user turn are
    results that name no call."""
    calls, results = turns_as_calls(messages)
    rows = messages.where("conv_id is not null and turn is not null and coalesce(role, '') not in ('user', 'assistant')")
    role = F.coalesce("role", F.lit("none"))
    said = F.to_json(F.struct(F.col("turn").cast("long").alias("turn"), "text"), {"ignoreNullFields": "true"})
    others = rows.select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"), role).alias("call_id"), F.lit(None).cast("string").alias("after"), role.alias("name"), said.alias("arguments"))
    return calls.unionByName(others), results


REPLY = {"reply": {"properties": {"prompt": "string", "turn": "integer"}, "required": ["prompt", "turn"]}}
TURNS = REPLY | {"system": {"properties": {"text": "string", "turn": "integer"}, "required": ["text", "turn"]}}

ORACLE = """
with recursive m as (select conv_id || ':' || turn as id, conv_id || ':' || (turn - 1) as prev, conv_id || ':' || (turn - 2) as before, turn, role, text
    from conversations where conv_id is not null and turn is not null),
r as (select prev as call_id, min(text) as content from m where role = 'assistant' group by prev),
c0 as (select m.id, m.before, m.text, '{' || case when text is null then '' else '"prompt":' || to_json(text)::varchar || ',' end || '"turn":' || turn || '}' as arguments,
    '{"turn":' || turn || case when text is null then '' else ',"prompt":' || to_json(text)::varchar end || '}' as raw from m where role = 'user'),
c as (select id, arg_min(arguments, raw) as arguments, arg_min(coalesce(text, chr(1)), raw) as text, min(before) as before, count(*) as n_rows from c0 group by id),
e as (select c.id, c.arguments, c.text, c.n_rows, case when r.call_id is not null and p.id is not null then c.before end as parent from c left join r on r.call_id = c.before left join c p on p.id = c.before),
l as (select id, 0::bigint as level from e where parent is null union all select e.id, l.level + 1 from e join l on e.parent = l.id)
select e.id as call_id, 'reply' as name, l.level, e.n_rows::bigint as n_rows, r.call_id is not null as linked, e.text <> chr(1) as valid, case when e.text = chr(1) then 'prompt missing' else '' end as errors,
    '{"arguments":' || e.arguments || ',"id":"' || e.id || '","level":' || l.level || ',"name":"reply","result":' || coalesce(to_json(r.content)::varchar, 'null') || '}' as canonical
from e join l on e.id = l.id left join r on r.call_id = e.id"""

ORACLE_ALL = f"""
with o as ({ORACLE}), m as (select conv_id || ':' || turn as id, conv_id || ':' || (turn - 1) as prev, turn, coalesce(role, 'none') as role, text from conversations where conv_id is not null and turn is not null),
r as (select prev as call_id, min(text) as content, count(*)::bigint as n_results from m where role = 'assistant' group by prev),
s0 as (select id || ':' || role as call_id, role, turn, text, '{{"turn":' || turn || case when text is null then '' else ',"text":' || to_json(text)::varchar end || '}}' as raw from m where role not in ('user', 'assistant')),
s as (select call_id, any_value(role) as role, any_value(turn) as turn, nullif(arg_min(coalesce(text, chr(1)), raw), chr(1)) as text, count(*)::bigint as n_rows from s0 group by call_id)
select o.call_id, name, level, n_rows, coalesce(n_results, 0) as n_results, linked, valid, errors, canonical from o left join r using (call_id)
union all select call_id, null, null, 0, n_results, false, false, 'no call', '{{"arguments":null,"id":"' || call_id || '","level":null,"name":null,"result":' || coalesce(to_json(content)::varchar, 'null') || '}}' from r where call_id not in (select call_id from o)
union all select call_id, role, 0, n_rows, 0, false, role = 'system' and text is not null, case when role <> 'system' then 'unknown tool' when text is null then 'text missing' else '' end,
    '{{"arguments":{{' || case when text is null then '' else '"text":' || to_json(text)::varchar || ',' end || '"turn":' || turn || '}},"id":"' || call_id || '","level":0,"name":' || to_json(role)::varchar || ',"result":null}}' from s"""
