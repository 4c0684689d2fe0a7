"""Chat formatting: tool calls and results linked by identifier, ordered, validated, and written as canonical JSON."""

from __future__ import annotations

import json
from collections.abc import Container, Iterable, Iterator
from functools import lru_cache, reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pastframe.llm.common import forget, let_workers_import, settled, written
from pastframe.sources.ordered import running_total

#: What a message's text may hold as JSON: an assistant's calls, a tool's result, a system message's tools.
CALLS = "struct<content:string,tool_calls:array<struct<id:string,name:string,arguments:string,depends_on:array<string>>>>"
RESULT = "struct<tool_call_id:string,content:string>"
TOOLS = "struct<tools:array<struct<name:string,parameters:string>>>"

_KINDS = {"object": dict, "array": list, "string": str, "number": (int, float), "integer": int, "boolean": bool, "null": type(None)}


def problem(value: object, schema: dict, at: str = "$") -> str | None:
    """The first way in which a value breaks a JSON schema (type, enum, required, properties, additionalProperties, items)."""
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    fits = lambda k: isinstance(value, _KINDS.get(k, object)) and not (isinstance(value, bool) and k in ("number", "integer"))
    if kinds and not any(map(fits, kinds)):
        return f"{at}: not {' or '.join(kinds)}"
    if "enum" in schema and value not in schema["enum"]:
        return f"{at}: not one of the allowed values"
    if isinstance(value, dict):
        own = schema.get("properties", {})
        if missing := sorted(set(schema.get("required", [])) - set(value)):
            return f"{at}.{missing[0]}: missing"
        if schema.get("additionalProperties") is False and (extra := sorted(set(value) - set(own))):
            return f"{at}.{extra[0]}: not allowed"
        return next((p for k in sorted(own) if k in value and (p := problem(value[k], own[k], f"{at}.{k}"))), None)
    if isinstance(value, list) and isinstance(schema.get("items"), dict):
        return next((p for i, v in enumerate(value) if (p := problem(v, schema["items"], f"{at}[{i}]"))), None)
    return None


_schema = lru_cache(1024)(json.loads)  # the same few schemas come again and again


def _checked(arguments: str | None, schema: str | None) -> tuple[str | None, str | None]:
    try:
        value = json.loads(arguments) if arguments else {}
        text = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    except (ValueError, RecursionError):  # not JSON, or a number that JSON can't write
        return None, "$: not JSON"
    text = text.encode("utf-8", "replace").decode()
    if schema is None:
        return text, "unknown tool"
    try:
        wrong = problem(value, _schema(schema))
    except (ValueError, AttributeError, TypeError, RecursionError):
        return text, "broken schema"
    return text, wrong and wrong.encode("utf-8", "replace").decode()


@F.pandas_udf(T.StructType([T.StructField("arguments", T.StringType()), T.StructField("problem", T.StringType())]))
def checked(arguments: pd.Series, schema: pd.Series) -> pd.DataFrame:
    """Canonical arguments (sorted keys, no spaces), and what is wrong with them if anything."""
    return pd.DataFrame([_checked(a, s) for a, s in zip(arguments, schema, strict=True)], columns=["arguments", "problem"], dtype=object)


def settle(turns: dict[str, int], waits: dict[str, Iterable[str]], base: dict[str, tuple[int, int]] | None = None, held: Container[str] = ()) -> dict[str, tuple[int, int]]:
    """(level, turn) of each of these calls that isn't in or behind a cycle, nor waits for a held one.

    The level is 0, or one more than the highest that it waits for, and the turn the latest of its own and of those that it
    waits for; base has what calls elsewhere ask of a call. What isn't one of these calls is not waited for.
    """
    left = {c: {w for w in waits.get(c, ()) if w in turns} for c in turns}
    behind: dict[str, list[str]] = {}
    for c, ws in left.items():
        for w in ws:
            behind.setdefault(w, []).append(c)
    best = {c: (base[c][0], max(t, base[c][1])) if base and c in base else (0, t) for c, t in turns.items()}
    ready, out = [c for c, ws in left.items() if not ws and c not in held], {}
    while ready:
        done = ready.pop()
        level, turn = out[done] = best[done]
        for c in behind.get(done, ()):
            best[c] = max(best[c][0], level + 1), max(best[c][1], turn)
            left[c].discard(done)
            if not left[c] and c not in held:
                ready.append(c)
    return out


#: Conversations of up to so many calls and dependencies go through Python many at a time.
_FEW = 100


def _levels(calls: DataFrame, most: int = 50_000) -> DataFrame:
    """(conv_id, call_id, level, after) of calls (conv_id, call_id, turn, depends_on); no row for those in or behind a cycle.

    level: 0 for calls that wait for none, else one more than the calls they wait for. after: the latest turn of the call
    and of all that it waits for, directly or not. Conversations of up to `most` calls and dependencies are settled each in
    one go, those of up to _FEW many in a batch. Longer ones, which no task should hold, are cut into runs of so many in the order of turns, and go in rounds:
    each settles, in every run, what waits for nothing that is open in other runs. So a chain takes as many rounds as it
    goes from one run to another, not as many as it has calls. The result is the same. A dependency that isn't a call of
    the conversation does not hold anything up.
    """
    key = ["conv_id", "call_id"]
    size = calls.groupBy("conv_id").agg(F.sum(1 + F.size("depends_on")).alias("__n"))
    more = written(size.where(F.col("__n") > min(_FEW, most)), "more-calls")
    long_ = more.where(F.col("__n") > most).select("conv_id")
    schema = f"conv_id {dict(calls.dtypes)['conv_id']}, call_id string, level int, after int"

    def told(pdf: pd.DataFrame, levels: dict[str, tuple[int, int]]) -> pd.DataFrame:
        return pd.DataFrame({"conv_id": pdf.conv_id.iloc[0], "call_id": list(levels), "level": [x for x, _ in levels.values()], "after": [x for _, x in levels.values()]}, dtype=object)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        return told(pdf, settle(dict(zip(pdf.call_id, pdf.turn, strict=True)), dict(zip(pdf.call_id, pdf.depends_on, strict=True))))

    def part(pdf: pd.DataFrame) -> pd.DataFrame:
        turns = dict(zip(pdf.call_id, pdf.turn, strict=True))
        waits = {c: list(w) for c, w in zip(pdf.call_id, pdf.waits, strict=True) if w is not None}
        base = {c: (int(level), int(after)) for c, level, after in zip(pdf.call_id, pdf.level, pdf.after, strict=True) if level == level and level is not None}
        return told(pdf, settle(turns, waits, base, {c for c, ws in waits.items() if any(w not in turns for w in ws)}))

    def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, names, levels, after = [], [], [], []
            for i, own in enumerate(b.column("calls").to_pylist()):
                for name, (level, turn) in settle({c["call_id"]: c["turn"] for c in own}, {c["call_id"]: c["depends_on"] for c in own}).items():
                    at.append(i), names.append(name), levels.append(level), after.append(turn)
            ids = b.column("conv_id").take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(names, pa.string()), pa.array(levels, pa.int32()), pa.array(after, pa.int32())], names=["conv_id", "call_id", "level", "after"])

    short = calls.join(more.select("conv_id"), "conv_id", "left_anti").groupBy("conv_id").agg(F.collect_list(F.struct("call_id", "turn", "depends_on")).alias("calls"))
    parts = [short.mapInArrow(few, schema)]
    if more.take(1):
        middle = more.where(F.col("__n") <= most).select("conv_id")
        parts.append(calls.join(middle, "conv_id", "left_semi").groupBy("conv_id").applyInPandas(one, schema))
    if not long_.take(1):
        return reduce(DataFrame.unionByName, parts)
    placed = running_total(calls.join(long_, "conv_id", "left_semi"), [F.col(c) for c in ("conv_id", "turn", "call_id")], "before", 1 + F.size("depends_on"), "call-order", written)
    placed = placed.withColumn("run", F.floor(F.col("before") / most))
    rest = written(placed.select(*key, "turn", "run"), "open-calls")
    edges = placed.select(*key, F.explode(F.array_distinct("depends_on")).alias("on")).join(rest.select("conv_id", F.col("call_id").alias("on")), ["conv_id", "on"], "left_semi")
    edges = written(edges.withColumns({c: F.lit(None).cast("int") for c in ("level", "after")}), "call-edges")
    while rest.take(1):
        asks = edges.groupBy(*key).agg(F.collect_list(F.when(F.col("level").isNull(), F.col("on"))).alias("waits"), (F.max("level") + 1).alias("level"), F.max("after").alias("after"))
        new = written(rest.join(asks, key, "left").groupBy("conv_id", "run").applyInPandas(part, schema), "call-levels")
        if not new.take(1):
            break
        parts.append(new)
        was, rest = rest, written(rest.join(new.select(*key), key, "left_anti"), "open-calls")
        met = new.select("conv_id", F.col("call_id").alias("on"), F.col("level").alias("l"), F.col("after").alias("a"))
        old, edges = edges, written(edges.join(rest.select(*key), key, "left_semi").join(met, ["conv_id", "on"], "left").select(*key, "on", F.coalesce("level", "l").alias("level"), F.coalesce("after", "a").alias("after")), "call-edges")
        forget(was)
        forget(old)
    return reduce(DataFrame.unionByName, parts)


#: Stands for no turn, which is before all turns.
_NO_TURN = -(1 << 31)


def formatted(messages: DataFrame, most: int = 50_000) -> DataFrame:
    """conversations (conv_id, turn, role, text) as one row per message, call or result: conv_id, turn, order_turn, level, kind, call_id, status, problem, json.

    kind: message, call or result. A call is linked to its first result (by turn) over a hash join on (conv_id, call_id);
    status is linked, or orphan where the other half is missing, repeat for further calls or results of one identifier,
    cycle for calls that wait for each other or for such. Topological order is (order_turn, level, kind, call_id): a call's
    order_turn is the latest turn of its own and of all that it waits for, a result's is not before its call's, and a
    message's is its turn. problem tells where a call's arguments break the schema that a system message of the
    conversation gives for the tool. json has sorted keys and no spaces. No conversation longer than `most` is gathered
    anywhere. Every message with a text that isn't a tool's result gives a message row: one that carries calls with its
    content, at level -1 and so before them. Null texts are messages with null content; text that isn't the expected JSON,
    or lists no calls, is a plain message. Calls without an identifier, and calls and results without a conv_id, link to
    nothing: orphan. Rows repeated whole are each told like the first. Arguments with numbers beyond JSON (1e999) are "not JSON";
    lone surrogates are written as "?". Very long texts are one row each, never cut. A call's json names what it depends on. Other columns are not carried. An empty
    table gives no rows.
    """
    let_workers_import(messages.sparkSession)
    m = messages.select("conv_id", F.col("turn").cast("int").alias("turn"), "role", "text")
    braced = F.col("text").rlike(r"^\s*\{")
    m = m.withColumn("a", F.when(braced & (F.col("role") == "assistant"), F.from_json("text", CALLS)))
    m = m.withColumn("r", F.when(braced & (F.col("role") == "tool"), F.from_json("text", RESULT)))
    m = m.withColumn("s", F.when(braced & (F.col("role") == "system"), F.from_json("text", TOOLS)))
    carries = F.coalesce(F.size("a.tool_calls") > 0, F.lit(False))
    calls = m.where(carries).select("conv_id", "turn", F.posexplode("a.tool_calls").alias("slot", "c"))
    calls = calls.select("conv_id", "turn", "slot", F.col("c.id").alias("call_id"), F.col("c.name").alias("name"), F.col("c.arguments").alias("arguments"), F.coalesce("c.depends_on", F.array().cast("array<string>")).alias("depends_on"))
    results = m.where("r.tool_call_id is not null").select("conv_id", "turn", F.col("r.tool_call_id").alias("call_id"), F.col("r.content").alias("content"))
    tools = m.where("s.tools is not null").select("conv_id", F.explode("s.tools").alias("t")).groupBy("conv_id", F.col("t.name").alias("name")).agg(F.min("t.parameters").alias("schema"))

    key = ["conv_id", "call_id"]
    calls = written(calls, "calls")
    known = calls.where("conv_id is not null and call_id is not null")
    said = m.where("r.tool_call_id is null").withColumn("carries", carries)
    text = F.to_json(F.struct(F.when(F.col("carries"), F.col("a.content")).otherwise(F.col("text")).alias("content"), "conv_id", "role", "turn"), {"ignoreNullFields": "false"})
    none = F.lit(None).cast("string")
    rows = said.select("conv_id", "turn", F.col("turn").alias("order_turn"), F.when(F.col("carries"), -1).otherwise(0).alias("level"), F.lit("message").alias("kind"), none.alias("call_id"), none.alias("status"), none.alias("problem"), text.alias("json"))
    if not calls.take(1) and not results.take(1):
        return rows

    first = known.groupBy(*key).agg(F.min(F.struct("turn", "slot", "name", "arguments")).alias("one"))
    answer = results.groupBy(*key).agg(F.min(F.struct("turn", "content")).alias("one"))
    level = settled(messages.sparkSession, lambda: _levels(known.groupBy(*key).agg(F.coalesce(F.min("turn"), F.lit(_NO_TURN)).alias("turn"), F.flatten(F.collect_set("depends_on")).alias("depends_on")), most), "call-levels")
    call = calls.join(first.select(*key, F.col("one").alias("first")), key, "left").join(answer.select(*key, F.col("one").alias("answer")), key, "left").join(level, key, "left").join(tools, ["conv_id", "name"], "left")
    call = call.withColumn("ok", checked("arguments", "schema"))
    is_first = F.struct("turn", "slot", "name", "arguments").eqNullSafe(F.col("first"))
    status = F.when(F.col("first").isNull(), "orphan").when(~is_first, "repeat").when(F.col("level").isNull(), "cycle").when(F.col("answer").isNull(), "orphan").otherwise("linked")
    call_json = F.concat(F.lit('{"arguments":'), F.coalesce("ok.arguments", F.to_json(F.struct("arguments"))), F.lit(","), F.substring(F.to_json(F.struct("call_id", "conv_id", "depends_on", "name", "turn"), {"ignoreNullFields": "false"}), 2, 1 << 30))
    after = F.nullif(F.greatest("turn", "after"), F.lit(_NO_TURN))
    rows = rows.unionByName(call.select("conv_id", "turn", after.alias("order_turn"), F.coalesce("level", F.lit(0)).alias("level"), F.lit("call").alias("kind"), "call_id", status.alias("status"), F.col("ok.problem").alias("problem"), call_json.alias("json")))
    res = results.join(answer.select(*key, F.col("one").alias("answer")), key, "left").join(first.select(*key, F.col("one").alias("first")), key, "left").join(level, key, "left")
    status = F.when(F.col("first").isNull(), "orphan").when(~F.struct("turn", "content").eqNullSafe(F.col("answer")), "repeat").otherwise("linked")
    after = F.nullif(F.greatest("turn", "first.turn", "after"), F.lit(_NO_TURN))
    res_json = F.to_json(F.struct("call_id", "content", "conv_id", F.lit("tool").alias("role"), "turn"), {"ignoreNullFields": "false"})
    return rows.unionByName(res.select("conv_id", "turn", after.alias("order_turn"), F.coalesce("level", F.lit(0)).alias("level"), F.lit("result").alias("kind"), "call_id", status.alias("status"), none.alias("problem"), res_json.alias("json")))
