"""Structured Streaming forms of the event monitors; their batch twins are in operators/history.py."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_stream(spark, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def attention_windows(events: DataFrame, item: str, at: str = "ts", span: str = "5 minutes", slide: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Opens of each item in sliding windows."""
    return events.withWatermark(at, late).groupBy(F.window(at, span, slide), item).agg(F.count("*").alias("opens"), F.max(at).alias("last"))


def dedupe(events: DataFrame, keys: Sequence[str], at: str = "ts", span: str = "30 seconds") -> DataFrame:
    """One event a key within the span, at least; state is dropped with the watermark."""
    return events.withWatermark(at, span).dropDuplicatesWithinWatermark(list(keys))


def changed_paths(events: DataFrame, path: str = "path", at: str = "ts", late: str = "1 minute", span: str = "10 seconds") -> DataFrame:
    """Paths that changed in each tumbling window, once."""
    return events.withWatermark(at, late).groupBy(F.window(at, span), path).agg(F.count("*").alias("n"))


def debounced(events: DataFrame, quiet: int = 200, tick: int = 10_000, parts: int = 16) -> DataFrame:
    """(root, path, changes, waited_ms) of paths that changed, once for each time that they are handed on.

    events: root, path, kind. A `change` waits until `quiet` milliseconds after its path's first one. From `index_start` to
    `index_end` of its root nothing is handed on: what waits is looked at again each `tick`, and soon after the end. Other roots do
    not wait. Waiting paths of a root are spread over so many keys by a hash, each of which gets the root's gate rows, so a root of
    any size is many small states. Rows of another kind and null paths count for nothing.
    """
    gate = F.col("kind").isin("index_start", "index_end")
    keys = F.explode(F.when(gate, F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.pmod(F.xxhash64("path"), F.lit(parts)).cast("int"))))
    rows = events.filter(gate | ((F.col("kind") == "change") & F.col("path").isNotNull())).select("root", "path", "kind", keys.alias("part"))

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        shut, held = state.get if state.exists else (0, "{}")
        waiting: dict[str, list[int]] = json.loads(held)
        now = state.getCurrentProcessingTimeMs()
        for f in frames:
            for path, kind in zip(f.path, f.kind, strict=True):
                if kind == "change":
                    waiting.setdefault(path, [now, 0])[1] += 1
                else:
                    shut = max(0, shut + (1 if kind == "index_start" else -1))
        ready = {} if shut else {p: w for p, w in waiting.items() if now - w[0] >= quiet}
        waiting = {p: w for p, w in waiting.items() if p not in ready}
        if waiting or shut:
            state.update((shut, json.dumps(waiting)))
            state.setTimeoutDuration(tick if shut else quiet)
        elif state.exists:
            state.remove()
        if ready:
            yield pd.DataFrame({"root": key[0], "path": list(ready), "changes": [w[1] for w in ready.values()], "waited_ms": [now - w[0] for w in ready.values()]})

    return rows.groupBy("root", "part").applyInPandasWithState(run, "root string, path string, changes long, waited_ms long", "shut long, held string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def recent_lines(lines: DataFrame, key: str, value: str, pattern: str, keep: int = 50) -> DataFrame:
    """(key, seen, hits): lines of each key and how often the pattern, which may run over several lines, is found in its last `keep`,
    in keyed state. ^ and $ stand for the ends of a line."""

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, last = state.get if state.exists else (0, "")
        rows = last.split("\n") if last else []
        for f in frames:
            rows += f[value].fillna("").str.replace("\n", " ").tolist()
            seen += len(f)
        rows = rows[-keep:]
        state.update((seen, "\n".join(rows)))
        yield pd.DataFrame({key: [k[0]], "seen": [seen], "hits": [sum(1 for _ in re.finditer(pattern, "\n".join(rows), re.M))]})

    kind = lines.schema[key].dataType.simpleString()
    return lines.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, seen long, hits long", "seen long, last string", "update", GroupStateTimeout.NoTimeout)


def snapshot_sink(path: str):
    """A foreachBatch function that writes each batch to its own folder, batch=number: a replayed batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={number}")

    return write
