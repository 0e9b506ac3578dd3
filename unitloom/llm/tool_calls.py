"""Tool calls of conversations: linked with their results, put in topological order, validated, written as canonical JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import durable

# JSON kinds and how the types of parsed values begin.
KINDS = {"integer": ("BIGINT",), "number": ("BIGINT", "DECIMAL", "DOUBLE"), "string": ("STRING",), "boolean": ("BOOLEAN",), "array": ("ARRAY",), "object": ("OBJECT",), "null": ("VOID",)}


def canonical_json(text: Column) -> Column:
    """Sorted keys, no blanks, plain numbers; null for what is no JSON or repeats a key."""
    return F.to_json(F.try_parse_json(text))


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of nodes (conv_id, call_id); ``edges`` (conv_id, call_id, needs).

    The level is the length of the longest chain of needs; null on a cycle and behind one.  Each round settles
    the calls whose needs are all settled, so there are as many rounds as levels.
    """
    edges = durable(edges.distinct())
    settled = durable(nodes.join(edges.select("conv_id", "call_id").distinct(), ["conv_id", "call_id"], "left_anti").select("conv_id", "call_id", F.lit(0).alias("level")))
    found, newest, level = settled, settled, 0
    while True:
        level += 1
        left = durable(edges.join(newest.select("conv_id", F.col("call_id").alias("needs")), ["conv_id", "needs"], "left_anti"))
        waiting = left.select("conv_id", "call_id").distinct()
        newest = edges.select("conv_id", "call_id").distinct().join(waiting, ["conv_id", "call_id"], "left_anti")
        newest = durable(newest.select("conv_id", "call_id", F.lit(level).alias("level")))
        if not newest.limit(1).count():
            break
        found, edges = found.unionByName(newest), left
    return nodes.join(found, ["conv_id", "call_id"], "left")


def problems(arguments: Column, fields: Column) -> Column:
    """What is wrong with parsed arguments under a tool's fields (field, kind, required), in order of the names."""
    kinds = F.transform_values(F.try_variant_get(arguments, "$", "map<string,variant>"), lambda _, v: F.schema_of_variant(v))
    wrong = F.transform(
        F.filter(fields, lambda f: kinds[f["field"]].isNotNull() & ~_is_kind(kinds[f["field"]], f["kind"])), lambda f: F.concat(f["field"], F.lit(" is not "), f["kind"])
    )
    missing = F.transform(F.filter(fields, lambda f: f["required"] & kinds[f["field"]].isNull()), lambda f: F.concat(f["field"], F.lit(" is missing")))
    unknown = F.transform(F.array_except(F.map_keys(kinds), F.transform(fields, lambda f: f["field"])), lambda k: F.concat(k, F.lit(" is unknown")))
    return F.when(kinds.isNull(), F.array(F.lit("arguments are no object"))).when(fields.isNull(), F.array(F.lit("tool is unknown"))).otherwise(
        F.array_sort(F.concat(wrong, missing, unknown))
    )


def _is_kind(found: Column, kind: Column) -> Column:
    fits = F.lit(False)
    for name, heads in KINDS.items():
        for head in heads:
            fits = fits | ((kind == name) & found.startswith(head))
    return fits


def link(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per call row, and one per result without a call, in no order: sort by conv_id, level, turn, call_id.

    calls (conv_id, turn, call_id, tool, arguments, needs array), results (conv_id, turn, call_id, content), schemas (tool, field,
    kind, required).  Columns: conv_id, turn, call_id, tool, level, status, errors, call_json, result_json.  Status, the
    first that holds: orphan (no such call), repeated (the id has an earlier call), cyclic, invalid, missing_need,
    unanswered, ok.  Of several results the earliest counts.  A null conversation or call id links with
    nothing.  One conversation may hold any share of the rows; none is gathered in a task.
    """
    keys = ["conv_id", "call_id"]
    calls = calls.select("conv_id", "turn", "call_id", "tool", "arguments", "needs")
    usable = calls.filter("conv_id is not null and call_id is not null")
    first = usable.groupBy(*keys).agg(F.min("turn").alias("first_turn"))
    nodes = first.select(*keys)
    needs = usable.select(*keys, F.explode(F.array_distinct("needs")).alias("needs")).filter("needs is not null").distinct()
    edges = needs.join(nodes.select("conv_id", F.col("call_id").alias("needs")), ["conv_id", "needs"]).select(*keys, "needs")
    lacking = needs.join(nodes.select("conv_id", F.col("call_id").alias("needs")), ["conv_id", "needs"], "left_anti").select(*keys).distinct()
    placed = levels(nodes, edges)
    answers = results.filter("conv_id is not null and call_id is not null").groupBy(*keys).agg(F.min(F.struct("turn", "content")).alias("answer"))
    fields = schemas.groupBy("tool").agg(F.array_sort(F.collect_list(F.struct("field", "kind", "required"))).alias("fields"))
    per_id = first.join(placed, keys, "left").join(lacking.withColumn("lacks", F.lit(True)), keys, "left").join(answers, keys, "left")
    rows = calls.join(per_id, keys, "left").join(fields, "tool", "left")
    parsed = F.try_parse_json("arguments")
    errors = problems(parsed, F.col("fields"))
    status = (
        F.when(F.col("turn") > F.col("first_turn"), "repeated")
        .when(F.col("first_turn").isNotNull() & F.col("level").isNull(), "cyclic")
        .when(F.size("errors") > 0, "invalid")
        .when(F.col("lacks"), "missing_need")
        .when(F.col("answer").isNull(), "unanswered")
        .otherwise("ok")
    )
    call_json = F.to_json(F.struct(parsed.alias("arguments"), F.col("call_id").alias("id"), F.col("tool").alias("name")), {"ignoreNullFields": "false"})
    made = rows.withColumn("errors", errors).select(
        "conv_id", "turn", "call_id", "tool", "level", status.alias("status"), F.concat_ws("; ", "errors").alias("errors"), call_json.alias("call_json"),
        F.when(F.col("answer").isNotNull(), _result_json(F.col("answer.content"), F.col("call_id"))).alias("result_json"),
    )
    orphans = results.select("conv_id", "turn", "call_id", "content").join(nodes, keys, "left_anti")
    orphans = orphans.select(
        "conv_id", "turn", "call_id", F.lit(None).cast("string").alias("tool"), F.lit(None).cast("int").alias("level"), F.lit("orphan").alias("status"),
        F.lit("").alias("errors"), F.lit(None).cast("string").alias("call_json"), _result_json(F.col("content"), F.col("call_id")).alias("result_json"),
    )
    return made.unionByName(orphans)


def _result_json(content: Column, call_id: Column) -> Column:
    return F.to_json(F.struct(content.alias("content"), call_id.alias("id")), {"ignoreNullFields": "false"})


def from_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results read into plain turns: each user turn asks a tool, the next turn of an assistant answers it.

    The tool follows the text's length; every seventh length gives its limit as a string and every eleventh leaves the
    text out, as faulty models do.  A call needs those at a half and a third of its turn number.
    """
    call = lambda turn: F.concat(F.lit("call_"), F.col("conv_id").cast("string"), F.lit("_"), turn.cast("string"))
    turn, size = F.col("turn"), F.coalesce(F.length("text"), F.lit(0))
    tool = F.element_at(F.array(*map(F.lit, ("search", "translate", "summarise"))), size % 3 + 1)
    limit = F.when(size % 7 == 0, F.concat(F.lit('"'), size.cast("string"), F.lit('"'))).otherwise(size.cast("string"))
    quoted = F.when(size % 11 == 0, "").otherwise(F.concat(F.lit(' , "text" : '), F.regexp_extract(F.to_json(F.struct("text")), r"(?s)^\{\"text\":(.*)\}$", 1)))
    arguments = F.concat(F.lit('{ "turn" : '), turn.cast("string"), quoted, F.lit(', "limit": '), limit, F.lit(" }"))
    needs = F.filter(F.array_distinct(F.array(F.floor(turn / 2), F.floor(turn / 3))), lambda t: t < turn)
    calls = turns.filter("role = 'user'").select("conv_id", "turn", call(turn).alias("call_id"), tool.alias("tool"), arguments.alias("arguments"), F.transform(needs, call).alias("needs"))
    results = turns.filter("role = 'assistant'").select("conv_id", "turn", call(turn - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


def turn_schemas(spark: SparkSession) -> DataFrame:
    fields = [("turn", "integer", True), ("text", "string", True), ("limit", "integer", False)]
    return spark.createDataFrame([(tool, *field) for tool in ("search", "translate", "summarise") for field in fields], "tool string, field string, kind string, required boolean")
