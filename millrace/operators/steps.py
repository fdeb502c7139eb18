"""Steps: DataFrame to DataFrame functions over the log envelope, for ``df.transform`` on replays and streams.

A row may carry ``is_filtered``: such a sentinel row has no payload and passes every step unchanged but advances
progress; folds and batches neither count it nor hold it back. Steps that fold rows keep the order of offsets within a
log partition. Opaque functions and folds get rows as Python values of exact type (Arrow's: no number passes through
floating point, NaN isn't null).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from millrace.functions.envelope import PLACE, next_offset
from millrace.functions.session import ship

Step = Callable[[DataFrame], DataFrame]


def _passes() -> Column:
    return F.coalesce(F.col("is_filtered"), F.lit(False))


def _beside_sentinels(df: DataFrame, step: Step) -> DataFrame:
    """Give the step the rows that have a payload; sentinels go past it, with what columns they share with its output."""
    if "is_filtered" not in df.columns:
        return step(df)
    out = step(df.filter(~_passes()))
    if "is_filtered" not in out.columns:
        out = out.withColumn("is_filtered", F.lit(False))
    past = df.filter(_passes())
    if "next_offset" in out.columns and "next_offset" not in past.columns:
        past = past.withColumn("next_offset", next_offset())
    kinds = {f.name: f.dataType for f in out.schema.fields}
    return out.unionByName(past.select(*[F.col(f"`{c}`").cast(kinds[c]).alias(c) if c in past.columns else F.lit(None).cast(kinds[c]).alias(c) for c in out.columns]))


def map_(**columns: Column) -> Step:
    """Replace or add columns by native expressions; sentinels keep theirs."""

    def step(df: DataFrame) -> DataFrame:
        flagged = "is_filtered" in df.columns
        return df.withColumns({n: F.when(_passes(), F.col(n) if n in df.columns else F.lit(None)).otherwise(c) if flagged else c for n, c in columns.items()})

    return step


def map_udf(function: Callable[[pd.DataFrame], pd.DataFrame], schema: StructType | str) -> Step:
    """An opaque function over Arrow batches, run by Spark's Python workers; sentinels go past it."""
    return lambda df: _beside_sentinels(df, lambda rows: rows.mapInPandas(lambda frames: (function(f) for f in frames), schema))


def map_threads(function: Callable[[dict], dict], schema: StructType | str, concurrency: int = 8) -> Step:
    """A blocking function of one row, run by threads within a task; rows keep their order, and an error fails the task
    (which is retried), so no row is lost. Sentinels go past it."""

    def step(df: DataFrame) -> DataFrame:
        arrow = _arrow(schema)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            with ThreadPoolExecutor(concurrency) as pool:
                for batch in batches:
                    yield pa.RecordBatch.from_pylist(list(pool.map(function, batch.to_pylist())), arrow)

        return df.mapInArrow(run, schema)

    return lambda df: _beside_sentinels(df, step)


def _arrow(schema: StructType | str) -> pa.Schema:
    return to_arrow_schema(schema if isinstance(schema, StructType) else StructType.fromDDL(schema))


def filter_(condition: Column) -> Step:
    """Keep rows that meet the condition (null: not). Progress is the source's business."""
    return lambda df: df.filter(condition)


def flag_filtered(condition: Column, payload: Iterable[str] = ("key", "value")) -> Step:
    """Keep every row, but turn those that fail the condition into sentinels without payload."""

    def step(df: DataFrame) -> DataFrame:
        gone = ~F.coalesce(condition, F.lit(False))
        gone = (_passes() | gone) if "is_filtered" in df.columns else gone
        df = df.withColumn("is_filtered", gone)
        return df.withColumns({c: F.when(~F.col("is_filtered"), F.col(c)) for c in payload if c in df.columns})

    return step


def filter_progress(df: DataFrame, condition: Column, with_policy: bool = True) -> DataFrame:
    """By partition the next offset after filtering: over all rows with a commit policy, over passing rows without."""
    kept = F.coalesce(condition, F.lit(False))
    of_all = F.max(next_offset())
    of_kept = F.max(F.when(kept, next_offset()))
    return df.groupBy("topic", "partition").agg(F.count_if(kept).alias("n_passed"), (of_all if with_policy else of_kept).alias("next_offset"))


def sentinels(df: DataFrame, condition: Column, policy: object, scope: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """The output of a filter with a commit policy, in place order: passing rows, and a sentinel (``is_filtered``) for a
    partition's last dropped row whenever the policy fires, at the latest at the end.

    ``policy`` is a number of messages, or a commit policy (its time is the rows' own). It is asked before a row is taken:
    over the partitions with a pending dropped row, the offsets since the last commit must reach the number, or the
    time must have passed. A passing row clears its partition's pending row; sentinels in the input pass unchanged.

    ``scope`` is what is folded as one: a log partition by default. With ``["topic"]`` and ``order`` (say, timestamp,
    partition and offset, as arrival isn't defined otherwise) the policy counts over all partitions of a topic and a
    sentinel comes out for each pending one.
    """
    schema = StructType([f for f in df.schema.fields if f.name != "is_filtered"]).add("is_filtered", "boolean")
    flagged = "is_filtered" in df.columns
    mark = F.when(_passes(), F.lit(None)).otherwise(F.coalesce(condition, F.lit(False))) if flagged else F.coalesce(condition, F.lit(False))
    marked = df.select(F.struct("*").alias("row"), mark.alias("passes"), F.unix_micros("timestamp").alias("time") if "timestamp" in df.columns else F.lit(0).cast("long").alias("time"), *{*(scope or ["topic", "partition"]), *(order or []), "partition", "offset"})

    def start(now: float) -> object:
        return _Count(policy) if isinstance(policy, int) else policy.state(now)

    def flush(state: dict, now: float) -> Iterator[dict]:
        positions = {p: row["offset"] + 1 for p, row in state["pending"].items()}
        state["policy"].did_commit(now, positions)
        yield from (row | {"is_filtered": True} for row in state["pending"].values())
        state["pending"] = {}

    def fold(state: dict, row: dict) -> Iterator[dict]:
        now = row["time"] / 1e6
        if not state:
            state |= {"policy": start(now), "pending": {}}
        if state["pending"] and state["policy"].should_commit(now, {p: r["offset"] + 1 for p, r in state["pending"].items()}):
            yield from flush(state, now)
        if row["passes"] is None:
            yield row["row"]
        elif row["passes"]:
            state["pending"].pop(row["partition"], None)
            yield row["row"] | {"is_filtered": False}
        else:
            state["pending"][row["partition"]] = row["row"]

    return ordered_fold(marked, fold, lambda state: flush(state, 0.0), schema, scope, order)


class _Count:
    """A policy of a number of messages; the first position that it sees counts as one."""

    def __init__(self, messages: int) -> None:
        self.messages, self.committed = messages, {}

    def should_commit(self, now: float, positions: dict) -> bool:
        for p, position in positions.items():
            self.committed.setdefault(p, position - 1)
        return sum(position - self.committed[p] for p, position in positions.items()) >= self.messages

    def did_commit(self, now: float, positions: dict) -> None:
        self.committed |= positions


def ordered_fold(df: DataFrame, step: Callable[[dict, dict], Iterable[dict]], end: Callable[[dict], Iterable[dict]], schema: StructType | str, keys: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """A left fold over the rows of each key, in order of ``order`` (offset by default), that yields rows.

    Rows are hash-partitioned by the keys and sorted by Spark (with spilling); a task streams through them in Arrow
    batches and holds one state, so memory does not grow with a partition of the log. ``step`` may change the state
    dict; ``end`` gets it after the key's last row.
    """
    keys = keys or ["topic", "partition"]
    arrow = _arrow(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, out = None, {}, []
        for batch in batches:
            for row in batch.to_pylist():
                key = tuple(row[k] for k in keys)
                if key != now:
                    if now is not None:
                        out += end(state)
                    now, state = key, {}
                out += step(state, row)
            if out:
                yield pa.RecordBatch.from_pylist(out, arrow)
                out = []
        if now is not None:
            out += end(state)
        if out:
            yield pa.RecordBatch.from_pylist(out, arrow)

    ship(df.sparkSession)
    by = [*keys, *[c for c in order or ["offset"] if c not in keys]]
    return df.repartition(*keys).sortWithinPartitions(*by).mapInArrow(run, schema)


# batches


def count_batch_id(size: int) -> Column:
    """The batch of a row when every ``size`` rows of a dense log partition make one."""
    return F.floor(F.col("offset") / size).cast("long")


def closing_batch_ids(df: DataFrame, size: float | None = None, weight: str | None = None, seconds: float | None = None) -> DataFrame:
    """Add ``batch_id``: rows append to the open batch, which closes when its weights reach ``size``, or before a row
    that comes ``seconds`` or more after the batch's first row. A row is never split. Zero weights never close a batch.

    The time rule is the replay form of a processing-time deadline, by the rows' own timestamps. Sentinels have no batch.
    Only weights and timestamps become Python values; the rows themselves stay in Arrow columns.
    """
    schema = StructType([*df.schema.fields]).add("batch_id", "long")
    keys, flagged = ["topic", "partition"], "is_filtered" in df.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, number, total, since = None, 0, 0, None
        for rows in batches:
            none = [None] * rows.num_rows
            weights = rows.column(weight).to_pylist() if weight else none
            times = rows.column("timestamp").cast(pa.int64()).to_pylist() if seconds is not None else none
            past = rows.column("is_filtered").to_pylist() if flagged else none
            out = []
            for key, w, t, skip in zip(zip(*(rows.column(k).to_pylist() for k in keys), strict=True), weights, times, past, strict=True):
                if key != now:
                    now, number, total, since = key, 0, None, None
                if skip:
                    out.append(None)
                    continue
                late = seconds is not None and total is not None and t - since >= seconds * 1e6
                if total is None or late or (size is not None and total >= size):
                    number += total is not None
                    total, since = 0, t
                total += (w or 0) if weight else 1
                out.append(number)
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(out, pa.int64())], [*rows.schema.names, "batch_id"])

    ship(df.sparkSession)
    return df.repartition(*keys).sortWithinPartitions(*keys, "offset").mapInArrow(run, schema)


def batch(values: list[str], by: str = "batch_id", size: Column | None = None) -> Step:
    """Collect rows into one row per log partition and batch: ``values`` as an array of structs in offset order, the
    batch's committable, and the last row's timestamp. Sentinels come out as they are, without values."""

    def collect(df: DataFrame) -> DataFrame:
        of = df if size is None else df.withColumn(by, size)
        items = F.array_sort(F.collect_list(F.struct("offset", *[v for v in values if v != "offset"]))).alias("values")
        return of.groupBy("topic", "partition", by).agg(items, F.max(next_offset()).alias("next_offset"), F.max_by("timestamp", "offset").alias("timestamp"), F.count("*").alias("n"))

    return lambda df: _beside_sentinels(df, collect)


def unbatch(df: DataFrame) -> DataFrame:
    """One row for each value of a batch, in order, with its own offset."""

    def explode(batches: DataFrame) -> DataFrame:
        return batches.select("topic", "partition", F.posexplode("values").alias("position", "v")).select("topic", "partition", "position", "v.*")

    # a sentinel's own offset is the one before the next
    if "is_filtered" in df.columns and "offset" not in df.columns:
        df = df.withColumn("offset", F.col("next_offset") - 1)
    return _beside_sentinels(df, explode)


def reduce_(aggregates: dict[str, Column], by: str = "batch_id") -> Step:
    """Fold batches with an accumulator that is declared associative: Spark's partial aggregation applies. Sentinels come
    out as they are."""
    return lambda df: _beside_sentinels(df, lambda rows: rows.groupBy("topic", "partition", by).agg(*[c.alias(n) for n, c in aggregates.items()], F.max(next_offset()).alias("next_offset"), F.max_by("timestamp", "offset").alias("timestamp")))


def fold_batches(df: DataFrame, accumulator: Callable[[Any, dict], Any], initial: Callable[[], Any], result: str, size: float, weight: str | None = None, flush_empty: bool = False) -> DataFrame:
    """Fold with any accumulator, in offset order: a batch closes after the row whose weight brings it to ``size``, and
    at the end. ``result`` is the SQL type of the accumulated value. Without ``flush_empty`` a batch of zero weight is
    not flushed at the end. Sentinels come out as they are and count for nothing."""

    def fresh(state: dict) -> None:
        state |= {"value": initial(), "sum": 0, "row": None}

    def close(state: dict) -> dict:
        row = state["row"]
        out = {"topic": row["topic"], "partition": row["partition"], "value": state["value"], "next_offset": row["offset"] + 1, "timestamp": row["timestamp"]}
        fresh(state)
        return out

    def step(state: dict, row: dict) -> Iterator[dict]:
        if not state:
            fresh(state)
        state["value"] = accumulator(state["value"], row)
        state["sum"] += (row[weight] or 0) if weight else 1
        state["row"] = row
        if state["sum"] >= size:
            yield close(state)

    def end(state: dict) -> Iterator[dict]:
        if state.get("row") is not None and (state["sum"] > 0 or flush_empty):
            yield close(state)

    schema = f"topic string, partition int, value {result}, next_offset bigint, timestamp timestamp"
    return _beside_sentinels(df, lambda rows: ordered_fold(rows, step, end, schema))


def unfold(items: Column, name: str = "item", own: str | None = None) -> Step:
    """Flat-map by a native array: one row per item; only the last one carries the row's committable. With ``own``, the
    name of a field of the items (structs) with a next offset of their own, items that have one keep it. A row without
    items gives none, and its offset does not advance by itself. Sentinels pass, with their committable."""

    def explode(df: DataFrame) -> DataFrame:
        listed = df.select(F.struct("*").alias("row"), items.alias("items")).select("row", F.size("items").alias("n"), F.posexplode("items").alias("position", "item"))
        last = F.when(F.col("position") == F.col("n") - 1, F.col("row.offset") + 1)
        kept = [F.col(f"row.`{c}`") for c in df.columns if c not in ("position", name, "next_offset")]
        return listed.select(*kept, "position", F.col("item").alias(name), (F.coalesce(F.col(f"item.{own}"), last) if own else last).alias("next_offset"))

    return lambda df: _beside_sentinels(df, explode)


def last_per_partition(df: DataFrame, count: int) -> DataFrame:
    """What a buffer of at most ``count`` messages a partition still holds: its last rows."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("topic", "partition").orderBy(F.desc("offset")))
    return df.withColumn("__rank", rank).filter(F.col("__rank") <= count).drop("__rank")


def noop(df: DataFrame) -> None:
    """Run and discard."""
    df.write.format("noop").mode("overwrite").save()


def in_place_order(df: DataFrame) -> DataFrame:
    return df.orderBy(*PLACE)
