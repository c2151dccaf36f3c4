"""Chat formatting: tool calls linked to their results, ordered, checked and serialised, in DataFrame functions alone.

Calls and results are joined on the call's identifier. A call's level is the longest chain of
calls that it depends on; levels are found in rounds that double the distance looked back,
each round joining only the dependencies still open. Arguments are parsed as JSON and checked against the tool's schema,
and each call becomes one canonical JSON object: sorted keys, no spaces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm._tables import kept

# JSON Schema types and the types that parsed JSON has.
TYPES = {"integer": "^BIGINT$", "number": "^(BIGINT|DECIMAL.*|DOUBLE)$", "string": "^STRING$", "boolean": "^BOOLEAN$", "object": "^OBJECT.*$", "array": "^ARRAY.*$"}


#: A call that still waits for more calls than SHORT is not passed through, and one that waits for more than LONG passes through none: so each holds at most SHORT * LONG.
SHORT, LONG = 4, 16


def levels(calls: DataFrame, needs: DataFrame) -> DataFrame:
    """call_id, level for every call whose chain of needed calls ends; calls in or behind a circle, or behind an unknown call, are missing.

    ``needs``: call_id, need (distinct). A call without needs has level 0, others one more than
    the highest level that they need. In each round a need whose level is known becomes a number,
    and one that waits itself is replaced by what it waits for, at the summed distance: a chain
    takes as many rounds as its length has binary digits. Where calls wait for very many calls
    (above SHORT and LONG) they take a round a level instead. Rounds end when none of them finds
    a level.
    """
    edges = kept(needs.select("call_id", "need", F.lit(1).cast("bigint").alias("far"), F.lit(0).cast("bigint").alias("base")), "needs")
    longest = edges.select("call_id").distinct().count()  # a longer way is a circle
    done = fresh = kept(calls.select("call_id").join(edges.select("call_id").distinct(), "call_id", "left_anti").select("call_id", F.lit(0).cast("bigint").alias("level")), "levels")
    while fresh.limit(1).count() and edges.limit(1).count():
        met = edges.join(fresh.select(F.col("call_id").alias("need"), "level"), "need", "left")
        state = kept(_waiting(met.select("call_id", F.greatest("base", F.coalesce(F.col("far") + F.col("level"), F.lit(0))).alias("base"), F.when(F.col("level").isNull(), F.struct("need", "far")).alias("wait")), longest), "states")
        through = state.where(F.size("waits") <= SHORT).select(F.col("call_id").alias("need"), F.col("base").alias("own_base"), F.col("waits").alias("own"))
        wide = state.select("call_id", "base", (F.size("waits") <= LONG).alias("few"), F.explode("waits").alias("w")).select("call_id", "base", "few", "w.need", "w.far").join(through, "need", "left")
        passes = F.col("few") & F.col("own").isNotNull()
        beyond = F.when(passes, F.transform("own", lambda w: F.struct(w["need"].alias("need"), (w["far"] + F.col("far")).alias("far")))).otherwise(F.array(F.struct("need", "far")))
        moved = _waiting(wide.select("call_id", F.when(passes, F.greatest("base", F.col("far") + F.col("own_base"))).otherwise(F.col("base")).alias("base"), F.explode_outer(beyond).alias("wait")), longest)
        ahead = kept(moved, "states")
        known = lambda x: x.where(F.size("waits") == 0).select("call_id", F.col("base").alias("level"))
        fresh = kept(known(state).unionByName(known(ahead)), "levels")
        edges = ahead.select("call_id", "base", F.explode("waits").alias("w")).select("call_id", "w.need", "w.far", "base")
        done = done.unionByName(fresh)
    return done.withColumn("level", F.col("level").cast("int"))


def _waiting(steps: DataFrame, longest: int) -> DataFrame:
    """call_id, base, waits out of rows of call_id, base, wait: the largest base and the farthest way to each need; calls on a way of more than ``longest`` are left out."""
    ways = steps.groupBy("call_id", F.col("wait.need").alias("need")).agg(F.max("base").alias("base"), F.max("wait.far").alias("far"))
    waits = F.collect_list(F.when(F.col("need").isNotNull(), F.struct("need", "far"))).alias("waits")
    return ways.groupBy("call_id").agg(F.max("base").alias("base"), waits, F.max("far").alias("far")).where(F.coalesce(F.col("far") <= longest, F.lit(True))).drop("far")


def _problems(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """call_id, problems: sorted findings such as missing:field, type:field, extra:field, not_json, unknown_tool."""
    fields = schemas.groupBy("name").agg(F.sort_array(F.collect_set(F.struct("field", "type", "required"))).alias("fields"))  # one tool's schema
    pattern = F.create_map(*(F.lit(x) for pair in TYPES.items() for x in pair))
    both = calls.join(fields, "name", "left").withColumn("args", F.from_json("arguments", "map<string,variant>")).withColumn("json", F.try_parse_json("arguments"))
    both = both.withColumn("kinds", F.transform_values("args", lambda _, v: F.schema_of_variant(v)))
    has = lambda f: F.map_contains_key("kinds", f["field"])
    missing = F.transform(F.filter("fields", lambda f: f["required"] & ~has(f)), lambda f: F.concat(F.lit("missing:"), f["field"]))
    wrong = F.transform(F.filter("fields", lambda f: has(f) & ~F.regexp_like(F.col("kinds")[f["field"]], pattern[f["type"]])), lambda f: F.concat(F.lit("type:"), f["field"]))
    known = F.transform("fields", lambda f: f["field"])
    extra = F.transform(F.array_except(F.map_keys("kinds"), known), lambda k: F.concat(F.lit("extra:"), k))
    object_ = F.coalesce(F.schema_of_variant("json").startswith("OBJECT"), F.lit(False))
    found = F.when(~object_, F.array(F.lit("not_json"))).when(F.col("fields").isNull(), F.array(F.lit("unknown_tool"))).otherwise(F.concat(missing, wrong, extra))
    return both.select("call_id", F.to_json("json").alias("canonical"), F.array_join(F.sort_array(found), ",").alias("problems"))


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """conversation, call_id, seq, level, status, problems, n_results, json: one row for each call, and one for each orphan result.

    ``calls``: call_id, conversation, seq, name, arguments (JSON text), needs (array of call ids);
    ``results``: call_id, content; ``schemas``: name, field, type, required. Level and seq
    order a conversation's calls topologically. status is the first that holds of
    duplicate (a repeated call_id; the first row by conversation, seq, name, arguments counts),
    circular (its needs form or reach a circle, or name an unknown call: level null), invalid
    (problems found), unanswered, ok; and orphan for results without a call. Of several results
    the least content is linked and n_results counts them. Calls or results with a null call_id
    are orphans. Null or malformed arguments give not_json and null in the JSON.
    Other columns are ignored; empty tables give no rows.
    """
    calls = calls.select("call_id", "conversation", "seq", "name", "arguments", "needs")
    named = calls.where("call_id IS NOT NULL")
    first = kept(named.groupBy("call_id").agg(F.min(F.struct("conversation", "seq", "name", "arguments", "needs")).alias("x"), F.count(F.lit(1)).alias("copies")).select("call_id", "x.*", "copies"), "calls")
    needs = first.select("call_id", F.explode("needs").alias("need")).where("need IS NOT NULL").distinct()
    level = levels(first, needs)
    answers = results.where("call_id IS NOT NULL").groupBy("call_id").agg(F.min("content").alias("content"), F.count(F.lit(1)).alias("n_results"))
    joined = first.join(level, "call_id", "left").join(answers, "call_id", "left").join(_problems(first, schemas), "call_id", "left").withColumn("n_results", F.coalesce("n_results", F.lit(0)))
    status = F.when(F.col("level").isNull(), "circular").when(F.col("problems") != "", "invalid").when(F.col("n_results") == 0, "unanswered").otherwise("ok")
    text = lambda c: F.regexp_extract(F.to_json(F.struct(F.col(c).alias("x"))), r'(?s)^\{"x":(.*)\}$', 1)  # noqa: E731  a JSON string
    parts = [F.lit('{"arguments":'), F.coalesce("canonical", F.lit("null")), F.lit(',"id":'), text("call_id"), F.lit(',"name":'), F.when(F.col("name").isNull(), "null").otherwise(text("name"))]
    parts += [F.lit(',"result":'), F.when(F.col("content").isNull(), "null").otherwise(text("content")), F.lit("}")]
    columns = ["conversation", "call_id", "seq", "level", "status", "problems", "n_results", "json"]
    linked = joined.withColumn("status", status).withColumn("json", F.concat(*parts))
    nothing = {c: F.lit(None).cast(t) for c, t in (("conversation", calls.schema["conversation"].dataType), ("seq", calls.schema["seq"].dataType), ("level", "int"), ("problems", "string"), ("json", "string"))}
    again = first.where("copies > 1").withColumn("copy", F.explode(F.sequence(F.lit(2), F.col("copies").cast("int"))))
    again = again.select("call_id", "conversation", F.lit("duplicate").alias("status"), F.lit(0).cast("bigint").alias("n_results")).withColumns({c: nothing[c] for c in ("seq", "level", "problems", "json")})
    lost = results.join(first.select("call_id"), "call_id", "left_anti").groupBy("call_id").agg(F.count(F.lit(1)).alias("n_results"))
    unnamed = calls.where("call_id IS NULL").select("call_id", "conversation", "seq", F.lit("orphan").alias("status"), F.lit(0).cast("bigint").alias("n_results")).withColumns({c: nothing[c] for c in ("level", "problems", "json")})
    orphans = lost.select("call_id", F.lit("orphan").alias("status"), "n_results").withColumns(nothing)
    return linked.select(columns).unionByName(again.select(columns)).unionByName(orphans.select(columns)).unionByName(unnamed.select(columns))
