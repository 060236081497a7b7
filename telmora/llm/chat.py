"""Tool calls of conversations: linked to results, ordered, validated, and written as canonical JSON."""

from __future__ import annotations

import json
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telmora.llm.common import checkpointed
from telmora.operators.ordered import sliced_join

_TYPES = {
    "string": lambda x: isinstance(x, str),
    "integer": lambda x: isinstance(x, int) and not isinstance(x, bool),
    "number": lambda x: isinstance(x, (int, float)) and not isinstance(x, bool),
    "boolean": lambda x: isinstance(x, bool),
    "array": lambda x: isinstance(x, list),
    "object": lambda x: isinstance(x, dict),
    "null": lambda x: x is None,
}


#: Arguments nested deeper are refused: nothing here may run out of stack.
MAX_DEPTH = 100
#: Conversations with at most so many calls and dependencies are ordered in one go, larger ones by rounds.
GROUP_ENTRIES = 200_000


def check_schema(schema: Any, at: str = "$") -> None:
    """A schema with a type that does not exist is the caller's error."""
    if not isinstance(schema, dict):
        return
    kind = schema.get("type") or []
    for k in kind if isinstance(kind, list) else [kind]:
        if k not in _TYPES:
            raise ValueError(f"{at}: unknown type {k!r}")
    for name, part in schema.get("properties", {}).items():
        check_schema(part, f"{at}.{name}")
    check_schema(schema.get("items"), f"{at}[]")


def too_deep(value: Any) -> bool:
    """Whether arrays and objects are nested more than ``MAX_DEPTH`` times."""
    level = [value]
    for _ in range(MAX_DEPTH + 1):
        level = [x for v in level if isinstance(v, (dict, list)) for x in (v.values() if isinstance(v, dict) else v)]
        if not level:
            return False
    return True


def violations(value: Any, schema: Any, at: str = "$") -> list[str]:
    """Where a value breaks a JSON schema: type, enum, required, properties, additionalProperties,
    items, minimum, maximum, minLength, maxLength; true and false allow everything and nothing."""
    out: list[str] = []
    if isinstance(schema, bool):
        return [] if schema else [f"{at}: not allowed"]
    kind = schema.get("type")
    kinds = kind if isinstance(kind, list) else [kind] if kind else []
    if kinds and not any(_TYPES[k](value) for k in kinds):
        return [f"{at}: not {'|'.join(kinds)}"]
    if "enum" in schema and canonical(value) not in {canonical(x) for x in schema["enum"]}:
        out.append(f"{at}: not in enum")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in known:
                out += violations(value[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{at}.{k}: unknown")
    elif isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            out += violations(x, schema["items"], f"{at}[{i}]")
    elif isinstance(value, str):
        if len(value) < schema.get("minLength", 0) or len(value) > schema.get("maxLength", math.inf):
            out.append(f"{at}: length")
    elif _TYPES["number"](value):
        if value < schema.get("minimum", -math.inf) or value > schema.get("maximum", math.inf):
            out.append(f"{at}: range")
    return out


def escaped(text: str) -> str:
    """Half surrogate pairs, which no encoding holds, as JSON escapes."""
    return re.sub("[\ud800-\udfff]", lambda m: f"\\u{ord(m[0]):04x}", text)


def canonical(value: Any) -> str:
    """Sorted keys, no spaces, whole numbers without a fraction; NaN and infinities become null, halves of
    surrogate pairs are escaped."""

    def plain(x: Any) -> Any:
        if isinstance(x, dict):
            return {k: plain(v) for k, v in x.items()}
        if isinstance(x, list):
            return [plain(v) for v in x]
        if isinstance(x, float):
            return None if not math.isfinite(x) else int(x) if x.is_integer() and abs(x) < 2**53 else x
        return x

    return escaped(json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False))


def _written(schemas: dict[str, dict]):
    """Arguments against their schema, and the canonical message."""

    def one(name: str | None, call_id: str, arguments: str | None, content: str | None, linked: bool) -> tuple[list[str], str]:
        try:
            value = json.loads(arguments) if arguments is not None else None
        except ValueError:
            found, value = ["$: not JSON"], arguments
        except RecursionError:
            found, value = ["$: too deep"], arguments
        else:
            if too_deep(value):
                found, value = ["$: too deep"], arguments
            else:
                found = [escaped(x) for x in violations(value, schemas[name])] if name in schemas else ["$: no schema"]
        call = {"id": call_id, "type": "function", "function": {"name": name, "arguments": value}}
        message = {"call": call, "result": {"tool_call_id": call_id, "content": content} if linked else None}
        return found, canonical(message)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f = f.astype({"name": object, "arguments": object, "content": object})
            cells = [[None if x is None or x is pd.NA or isinstance(x, float) else x for x in f[c]] for c in ("name", "arguments", "content")]
            done = [one(n, i, a, c, bool(k)) for n, i, a, c, k in zip(cells[0], f["call_id"], cells[1], cells[2], f["linked"])]
            yield f.drop(columns=["arguments", "content"]).assign(errors=[d[0] for d in done], json=[d[1] for d in done])

    return run


def _settle(depends_on: dict[str, list[str]]) -> dict[str, int]:
    """Levels of the calls of one conversation; those on or behind a cycle are missing."""
    open_, users = {}, defaultdict(list)
    for call, on in depends_on.items():
        wanted = {x for x in on if x in depends_on}
        open_[call] = len(wanted)
        for x in wanted:
            users[x].append(call)
    found, ready, level = {}, [c for c, n in open_.items() if n == 0], 0
    while ready:
        following = []
        for call in ready:
            found[call] = level
            for user in users[call]:
                open_[user] -= 1
                if open_[user] == 0:
                    following.append(user)
        ready, level = following, level + 1
    return found


def _settle_sorted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``conv_id, call_id, level`` of rows that come sorted by conversation; besides a batch, only one conversation
    is held at a time."""
    conv, group = None, {}
    convs, ids, found = [], [], []

    def close() -> None:
        level = _settle(group)
        convs.extend([conv] * len(group))
        ids.extend(group)
        found.extend(map(level.get, group))

    def written() -> pd.DataFrame:
        out = pd.DataFrame({"conv_id": pd.array(convs, dtype="Int64"), "call_id": ids, "level": pd.array(found, dtype="Int32")})
        convs.clear(), ids.clear(), found.clear()
        return out

    for f in frames:
        for conv_id, call_id, on in zip(f["conv_id"].tolist(), f["call_id"].tolist(), f["depends_on"].tolist()):
            if conv_id != conv:
                close()
                conv, group = conv_id, {}
            group[call_id] = list(on)
        if ids:
            yield written()
    close()
    if ids:
        yield written()


def levels(calls: DataFrame) -> DataFrame:
    """``conv_id``, ``call_id``, ``level``: 0 without dependencies, else one more than the deepest
    dependency; null for calls on or behind a cycle. Unknown dependencies are ignored.

    ``calls`` has one row for each (conv_id, call_id), with ``depends_on`` (array of ids). A conversation of up to
    ``GROUP_ENTRIES`` calls and dependencies is ordered by one task, however long its chains are. Larger
    ones are never gathered: they go by rounds over all their calls.
    """
    slim = calls.select("conv_id", "call_id", F.array_compact(F.array_distinct("depends_on")).alias("depends_on"))
    sizes = slim.groupBy("conv_id").agg(F.sum(F.size("depends_on") + 1).alias("n"))
    large = checkpointed(sizes.where(F.col("n") > GROUP_ENTRIES).select("conv_id"))
    schema = "conv_id long, call_id string, level int"
    if large.isEmpty():
        return slim.repartition("conv_id").sortWithinPartitions("conv_id").mapInPandas(_settle_sorted, schema)
    small = sliced_join(slim, large, ["conv_id"], "call_id", "left_anti")
    settled = small.repartition("conv_id").sortWithinPartitions("conv_id").mapInPandas(_settle_sorted, schema)
    return settled.unionByName(levels_by_rounds(sliced_join(slim, large, ["conv_id"], "call_id", "left_semi")))


def levels_by_rounds(calls: DataFrame) -> DataFrame:
    """The same, each round settling the calls whose dependencies are all settled, so rounds equal the depth."""
    ids = checkpointed(calls.select("conv_id", "call_id"))
    wanted = calls.select("conv_id", "call_id", F.explode(F.array_distinct("depends_on")).alias("on"))
    known = ids.withColumnRenamed("call_id", "on")
    waiting = checkpointed(wanted.join(known, ["conv_id", "on"]))
    blocked = waiting.select("conv_id", "call_id").distinct()
    ready = checkpointed(ids.join(blocked, ["conv_id", "call_id"], "left_anti"))
    done, level = ready.withColumn("level", F.lit(0)), 0
    while not waiting.isEmpty():
        settled = ready.withColumnRenamed("call_id", "on")
        left = checkpointed(waiting.join(settled, ["conv_id", "on"], "left_anti"))
        still = left.select("conv_id", "call_id").distinct()
        ready = checkpointed(waiting.select("conv_id", "call_id").distinct().join(still, ["conv_id", "call_id"], "left_anti"))
        if ready.isEmpty():  # what is left lies on or behind cycles
            break
        level += 1
        done = done.unionByName(ready.withColumn("level", F.lit(level)))
        waiting = left
    return ids.join(done, ["conv_id", "call_id"], "left")


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row per call: ``conv_id``, ``call_id``, ``turn``, ``name``, ``level``, ``linked``,
    ``errors`` (of the arguments), ``json``. In a conversation, (level, turn, call_id) is a
    topological order.

    ``calls``: conv_id, call_id, turn, name, arguments (JSON text), depends_on. ``results``: conv_id,
    call_id, turn, content. They meet in a hash join on (conv_id, call_id). Of repeated calls or
    results of an id the one of the earliest turn counts. Rows without conv_id or call_id take part
    in nothing; results without a call are dropped. Null or broken arguments are errors, and so are
    arguments nested more than ``MAX_DEPTH`` times and names without a schema. A schema with an unknown type
    is a ValueError. Conversations may be of any size (see ``levels``). Rows stay one per call: a whole
    conversation's messages are not written into one text.
    """
    for name, schema in schemas.items():
        check_schema(schema, name)
    keyed = "conv_id is not null and call_id is not null"
    firsts = F.min(F.struct("turn", "name", "arguments", "depends_on")).alias("x")
    one_call = checkpointed(calls.where(keyed).groupBy("conv_id", "call_id").agg(firsts).select("conv_id", "call_id", "x.*"))
    one_result = results.where(keyed).groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "content")).alias("r"))
    linked = one_call.join(one_result.hint("shuffle_hash"), ["conv_id", "call_id"], "left")
    ordered = linked.join(levels(one_call.withColumn("depends_on", F.coalesce("depends_on", F.array().cast("array<string>")))), ["conv_id", "call_id"])
    flat = ordered.select(
        "conv_id", "call_id", "turn", "name", "level", F.col("r").isNotNull().alias("linked"), "arguments", F.col("r.content").alias("content")
    )
    schema = "conv_id long, call_id string, turn long, name string, level double, linked boolean, errors array<string>, json string"
    return flat.withColumn("level", F.col("level").cast("double")).mapInPandas(_written(schemas), schema).withColumn("level", F.col("level").cast("int"))
