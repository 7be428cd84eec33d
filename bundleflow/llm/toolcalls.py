"""Tool-call linking for chat formatting, in DataFrame functions only.

Calls and results meet by hash joins on conversation and identifier; calls of one message are put
into topological order by what they wait for; arguments are checked against schemas; and each
call becomes one canonical JSON object: keys in order, no spaces.

Messages: conv_id, turn, calls array<struct<id, name, arguments, after>>.  arguments is JSON text
and after lists the ids, in the same message or an earlier one, whose results the call needs.
Results: conv_id, turn, call_id, content.  Schemas: tool, parameter, type (of JSON), required.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .winnow import _sized, let

# Types of Spark's variants that a JSON type covers.
JSON_TYPES = {
    "string": "STRING", "boolean": "BOOLEAN", "integer": "BIGINT|DECIMAL\\([0-9]+,0\\)", "number": "BIGINT|DOUBLE|FLOAT|DECIMAL\\(.*\\)", "object": "OBJECT<.*>", "array": "ARRAY<.*>", "null": "VOID",
}
NO_IDS = "array<string>"


def _steps(calls: Column) -> Column:
    """array<struct<id, step>>: step 1 for calls that wait for none of their message, then upwards; calls in a circle get none."""
    ids = F.transform(calls, lambda c: c["id"])
    size = F.size(calls)
    start = F.struct(F.lit(0).alias("step"), F.array().cast("array<struct<id:string,step:int>>").alias("done"))

    def turn(state: Column, _: Column) -> Column:
        done = F.transform(state["done"], lambda d: d["id"])
        waiting = lambda c: F.array_except(F.array_intersect(F.coalesce(c["after"], F.array().cast(NO_IDS)), ids), done)
        ready = F.filter(calls, lambda c: ~F.array_contains(done, c["id"]) & (F.size(waiting(c)) == 0))
        fresh = F.transform(ready, lambda c: F.struct(c["id"].alias("id"), (state["step"] + 1).cast("int").alias("step")))
        # Once all are placed, or no more can be, a turn does nothing.
        idle = (F.size(state["done"]) >= size) | (F.size(state["done"]) == 0) & (state["step"] > 0)
        return F.when(idle, state).otherwise(F.struct((state["step"] + 1).cast("int").alias("step"), F.concat(state["done"], fresh).alias("done")))

    return F.aggregate(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), start, turn, lambda s: s["done"])


def ordered_calls(messages: DataFrame) -> DataFrame:
    """One row per call: conv_id, turn, id, name, arguments, after, step (null in a circle)."""
    calls = F.filter(F.col("calls"), lambda c: c["id"].isNotNull())
    placed = messages.select("conv_id", "turn", calls.alias("calls")).withColumn("_steps", F.map_from_entries(_distinct_ids(_steps(F.col("calls")))))
    one = placed.select("conv_id", "turn", "_steps", F.explode("calls").alias("c"))
    return one.select("conv_id", "turn", "c.id", "c.name", "c.arguments", F.coalesce("c.after", F.array().cast(NO_IDS)).alias("after"), F.element_at("_steps", F.col("c.id")).alias("step"))


def _distinct_ids(steps: Column) -> Column:
    return let(steps, lambda s: F.filter(s, lambda d, i: ~F.exists(F.slice(s, F.lit(1), i), lambda e: e["id"] == d["id"])))


def argument_errors(value: Column, schema: Column) -> Column:
    """Sorted array of what is wrong: not_json, unknown_tool, missing:p, type:p, unknown:p."""
    given = F.when(F.schema_of_variant(value).startswith("OBJECT"), value.cast("map<string,variant>"))
    names = let(given, lambda g: F.map_keys(g))

    def wrong(p: Column) -> Column:
        found = F.element_at(given, p["parameter"])
        kind = F.lit(None).cast("string")
        for name, pattern in JSON_TYPES.items():
            kind = F.when(p["type"] == name, F.lit(f"^({pattern})$")).otherwise(kind)
        missing = ~F.array_contains(names, p["parameter"])
        return F.when(missing & p["required"], F.concat(F.lit("missing:"), p["parameter"])).when(~missing & ~F.regexp_like(F.schema_of_variant(found), kind), F.concat(F.lit("type:"), p["parameter"]))

    unknown = F.transform(F.array_except(names, F.transform(schema, lambda p: p["parameter"])), lambda n: F.concat(F.lit("unknown:"), n))
    checked = F.array_sort(F.array_compact(F.concat(F.transform(schema, wrong), unknown)))
    return F.when(given.isNull(), F.array(F.lit("not_json"))).when(schema.isNull(), F.array(F.lit("unknown_tool"))).otherwise(checked)


def link(messages: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per call, then one per result without a call.

    Columns: conv_id, turn, step, call_id, name, status, errors, n_results, canonical.  (turn, step)
    is a topological order of a conversation's calls.  status is the first that holds of
    duplicate_call (the id names several calls of the conversation), circular, unresolved (after
    names no call of this or an earlier message), invalid_arguments, no_result (none in a later
    turn), ok; results without a call are orphan_result.  The earliest later result counts; ties
    are broken by content.  Null ids of calls or results, and null conversations, link with
    nothing.  Empty tables give no rows.
    """
    calls = ordered_calls(messages)
    key = ["conv_id", "id"]
    known = calls.filter(F.col("conv_id").isNotNull()).groupBy(*key).agg(F.count("*").alias("n_calls"), F.min("turn").alias("first_turn"))
    answers = results.select("conv_id", F.col("call_id").alias("id"), F.col("turn").alias("result_turn"), "content")
    # The earliest result after each call's turn, aggregated before it is joined to the calls.
    timely = answers.join(known, key).groupBy(*key).agg(
        F.count("*").alias("n_results"), F.min(F.when(F.col("result_turn") > F.col("first_turn"), F.struct("result_turn", "content"))).alias("answer")
    )
    needs = calls.select("conv_id", "turn", "id", F.explode(F.array_distinct("after")).alias("_need"))
    early = known.select(F.col("conv_id").alias("_conv"), F.col("id").alias("_need"), "first_turn")
    met = (F.col("conv_id") == F.col("_conv")) & (needs["_need"] == early["_need"])
    unmet = needs.join(early, met, "left").filter(F.col("first_turn").isNull() | (F.col("first_turn") > F.col("turn"))).select("conv_id", "turn", "id").distinct().withColumn("_unmet", F.lit(True))
    rules = schemas.groupBy(F.col("tool").alias("name")).agg(F.collect_set(F.struct("parameter", "type", "required")).alias("schema"))
    parsed = calls.withColumn("value", F.try_parse_json("arguments")).join(_sized(rules), "name", "left")
    whole = (
        parsed.withColumn("errors", argument_errors(F.col("value"), F.col("schema")))
        .join(known.drop("first_turn"), key, "left").join(timely, key, "left").join(unmet, ["conv_id", "turn", "id"], "left")
    )
    status = (
        F.when(F.col("n_calls") > 1, "duplicate_call").when(F.col("step").isNull(), "circular").when(F.col("_unmet"), "unresolved")
        .when(F.size("errors") > 0, "invalid_arguments").when(F.col("answer").isNull(), "no_result").otherwise("ok")
    )
    # Objects of a variant keep their keys in order, so its JSON text is canonical.
    canonical = F.to_json(F.struct(F.coalesce(F.col("value"), F.parse_json(F.lit("null"))).alias("arguments"), F.col("id"), F.col("name"), F.col("answer.content").alias("result")), {"ignoreNullFields": "false"})
    linked = whole.select(
        "conv_id", "turn", "step", F.col("id").alias("call_id"), "name", status.alias("status"), F.array_join("errors", ",").alias("errors"),
        F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"), canonical.alias("canonical"),
    )
    lost = answers.join(known.select(*key), key, "left_anti").select(
        "conv_id", F.col("result_turn").alias("turn"), F.lit(None).cast("int").alias("step"), F.col("id").alias("call_id"), F.lit(None).cast("string").alias("name"),
        F.lit("orphan_result").alias("status"), F.lit("").alias("errors"), F.lit(1).cast("long").alias("n_results"),
        F.to_json(F.struct(F.col("id"), F.col("content").alias("result")), {"ignoreNullFields": "false"}).alias("canonical"),
    )
    return linked.unionByName(lost)
