"""Registered queries of the log operators over the ``events`` table as a log, with equivalent SQL.

Topic ``events``; partition user_id mod 4; offsets dense by ts, event_id; an event of type error is invalid.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import envelope as env
from millrace.functions.session import files_of, shared_folder
from millrace.operators import commit, dlq, steps

NOW = "2024-02-01 00:00:00"


_stored: dict[tuple, str] = {}


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events with an envelope, and the columns that predicates and folds use: a stored log, as a topic's offsets are.

    It is derived once for an application, over ranges in as many tasks as there are cores, and written under the shared
    folder by log partition; queries read it, so their filters on partition and offset reach the scan.
    """
    key = (spark.sparkContext.applicationId, shared_folder(spark), spark.conf.get("spark.sql.session.timeZone"), sf_dir)
    files, path = files_of(spark, shared_folder(spark))
    if key not in _stored or not files.exists(path(_stored[key])):
        _stored[key] = f"{shared_folder(spark)}/events-log-{uuid.uuid4().hex}"
        derive_log(spark, sf_dir).write.partitionBy("partition").parquet(_stored[key])
    columns = [*env.ENVELOPE.names, "event_id", "event_type", "props", "k", "amount"]
    return spark.read.parquet(_stored[key]).select(*columns)


def derive_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("int")
    events = events.withColumn("k", k)
    return env.as_log(events, "events", F.col("user_id") % 4, ["ts", "event_id"], "ts", F.col("user_id").cast("string"), F.col("props"), keep=["event_id", "event_type", "props", "k", F.col("value").alias("amount")], dense="range")


LOG_SQL = """WITH log AS (
  SELECT 'events' AS topic, CAST(user_id % 4 AS INT) AS partition,
         row_number() OVER (PARTITION BY user_id % 4 ORDER BY ts, event_id) - 1 AS "offset",
         ts AS "timestamp", CAST(user_id AS VARCHAR) AS key, props, event_id, event_type, value AS amount,
         CAST(json_extract(props, '$.k') AS INT) AS k
  FROM events)
"""


def is_error() -> Column:
    return F.col("event_type") == "error"


def _envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir)
    return log.select("topic", "partition", "offset", F.unix_micros("timestamp").alias("ts_us"), F.decode("key", "UTF-8").alias("key"), F.decode("value", "UTF-8").alias("value"), F.size("headers").alias("n_headers"))


def _hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = event_log(spark, sf_dir).transform(steps.map_(hashed=F.sha2("props", 256), reversed=F.reverse("props")))
    return out.select("partition", "offset", "hashed", "reversed")


def _map_opaque(spark: SparkSession, sf_dir: str) -> DataFrame:
    def upper(frame: pd.DataFrame) -> pd.DataFrame:
        return frame.assign(event_type=frame["event_type"].str.upper())

    return event_log(spark, sf_dir).select("partition", "offset", "event_type").transform(steps.map_udf(upper, "partition int, offset bigint, event_type string"))


def _map_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    def call(row: dict) -> dict:
        return row | {"event_type": row["event_type"][::-1]}

    return event_log(spark, sf_dir).select("partition", "offset", "event_type").transform(steps.map_threads(call, "partition int, offset bigint, event_type string"))


def _filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_log(spark, sf_dir).transform(steps.filter_(is_error())).select("partition", "offset", "event_id")


def _filter_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = event_log(spark, sf_dir).transform(steps.flag_filtered(is_error(), ["props"])).transform(steps.map_(props=F.upper("props")))
    return out.select("partition", "offset", "is_filtered", "props", env.next_offset().alias("next_offset"))


def _filter_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir)
    every, passed = steps.filter_progress(log, is_error()), steps.filter_progress(log, is_error(), with_policy=False)
    return every.select("partition", "n_passed", F.col("next_offset").alias("policy_next")).join(passed.select("partition", F.col("next_offset").alias("plain_next")), "partition")


def _filter_sentinels(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = steps.sentinels(event_log(spark, sf_dir).select("topic", "partition", "offset", "event_type"), is_error(), 3)
    return out.select("partition", "offset", "is_filtered")


def _unfold(spark: SparkSession, sf_dir: str) -> DataFrame:
    # sequence(0, -1) counts down
    log = event_log(spark, sf_dir).filter(F.col("k") >= 1)
    return log.transform(steps.unfold(F.sequence(F.lit(0), F.col("k") - 1))).select("partition", "offset", "item", "next_offset")


def _count_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir).withColumn("batch_id", steps.count_batch_id(100))
    out = log.transform(steps.reduce_({"n": F.count("*"), "k_sum": F.sum("k")}))
    return out.select("partition", "batch_id", "n", "k_sum", "next_offset", F.unix_micros("timestamp").alias("ts_us"))


def _weighted_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir).select("topic", "partition", "offset", "timestamp", F.floor("amount").alias("w"))
    out = steps.closing_batch_ids(log, size=500, weight="w").groupBy("partition", "batch_id")
    return out.agg(F.count("*").alias("n"), F.sum("w").alias("weight"), F.max(env.next_offset()).alias("next_offset"))


def _time_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir).select("topic", "partition", "offset", "timestamp")
    out = steps.closing_batch_ids(log, seconds=6 * 3600).groupBy("partition", "batch_id")
    return out.agg(F.count("*").alias("n"), F.min("offset").alias("first_offset"), F.max(env.next_offset()).alias("next_offset"))


def _fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir).select("topic", "partition", "offset", "timestamp", "k")
    out = steps.fold_batches(log, lambda acc, row: (acc * 31 + int(row["k"])) % 1_000_003, lambda: 7, "bigint", 50)
    return out.select("partition", "value", "next_offset")


def _batch_unbatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir).withColumn("batch_id", steps.count_batch_id(100))
    return steps.unbatch(log.transform(steps.batch(["event_id", "props"]))).select("partition", "offset", "position", "event_id", "props")


def _dlq_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, invalid = dlq.split(dlq.validate(event_log(spark, sf_dir), is_error()))
    out = dlq.dead_letters(invalid, "events-dlq")
    text = lambda name: F.decode(env.header(name), "UTF-8").alias(name)
    return out.select("topic", F.decode("key", "UTF-8").alias("key"), F.decode("value", "UTF-8").alias("value"), text("original_partition"), text("original_offset"), "reason")


def _dlq_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, invalid = dlq.split(dlq.validate(event_log(spark, sf_dir), is_error()))
    out = dlq.apply_limit(invalid, dlq.DlqLimit(0.35, 2), assigned=dict.fromkeys(range(4), 0))
    return out.select("partition", "offset", "valid_count", "invalid_count", "consecutive", "accepted")


def _dlq_limit_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The limit over micro-batches, whose counters go on from batch to batch: as on a replay."""
    _, invalid = dlq.split(dlq.validate(event_log(spark, sf_dir), is_error()))
    counters = spark.createDataFrame([("events", p, -1, 0, 0, 0) for p in range(4)], dlq.COUNTERS)
    out = None
    for low, high in ((0, 99), (100, 599), (600, 1 << 62)):
        limited = dlq.apply_limit(invalid.filter(F.col("offset").between(low, high)), dlq.DlqLimit(0.35, 2), counters=counters)
        counters = dlq.counters_after(limited, counters)
        out = limited if out is None else out.unionByName(limited)
    return out.select("partition", "offset", "valid_count", "invalid_count", "consecutive", "accepted")


def _sentinel_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagged rows pass an opaque map, a fold and a flat-map; the others are mapped, folded and unfolded."""
    log = event_log(spark, sf_dir).select("topic", "partition", "offset", "timestamp", "event_type", "k").transform(steps.flag_filtered(is_error(), ["event_type", "k"]))
    schema = "topic string, partition int, offset bigint, timestamp timestamp, event_type string, k int"
    mapped = log.transform(steps.map_udf(lambda f: f.drop(columns="is_filtered").assign(k=f["k"] + 1), schema))
    folded = steps.fold_batches(mapped, lambda acc, row: acc + row["k"], lambda: 0, "bigint", 20)
    items = F.sequence(F.lit(1), F.col("value") % 3 + 1)
    return folded.withColumn("offset", env.previous_offset()).transform(steps.unfold(items)).select("partition", "offset", "value", "item", "next_offset", "is_filtered")


def _invalid_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, invalid = dlq.split(dlq.validate(event_log(spark, sf_dir), is_error()))
    return dlq.invalid_progress(invalid)


def _buffer_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dlq.buffered(event_log(spark, sf_dir), 50).select("partition", "offset", "event_id")


def _buffer_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir).select("topic", "partition", "offset", "event_type")
    found, missed = dlq.look_up(dlq.buffered(log, 50), log.filter(is_error()))
    return found.select("partition", F.lit(1).alias("found"), F.lit(0).alias("missed")).unionByName(missed.select("partition", F.lit(0).alias("found"), F.lit(1).alias("missed"))).groupBy("partition").agg(F.sum("found").alias("found"), F.sum("missed").alias("missed"))


def _watermarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return env.watermarks(event_log(spark, sf_dir))


def _start_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    committed = spark.createDataFrame([("events", 0, 10), ("events", 2, 10**12)], "topic string, partition int, next_offset bigint")
    return env.start_offsets(env.watermarks(event_log(spark, sf_dir)), committed, "earliest", strict=False)


def _seek_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return env.seek(event_log(spark, sf_dir), {0: (5, 10), 1: (0, 3), 3: (100, 104)}).select("partition", "offset", "event_id")


def _commit_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commit.dense_commits(event_log(spark, sf_dir), 40).select("partition", "next_offset", "commit_no")


def _commit_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commit.commits(event_log(spark, sf_dir).filter(is_error()), commit.CommitPolicy(None, 40)).select("partition", "next_offset", "commit_no")


def _commit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = commit.encode(commit.commit_log(event_log(spark, sf_dir), "group-a"))
    back = commit.decode(messages)
    return back.select("group", "topic", "partition", "offset", F.round(F.col("orig_message_ts") * 1e6).cast("long").alias("ts_us"), F.col("received_p99").isNull().alias("no_p99"))


def _latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = commit.latency(event_log(spark, sf_dir), F.to_timestamp(F.lit(NOW)))
    return out.select("partition", F.round(F.col("max_latency") * 1e6).cast("long").alias("max_us"), F.round(F.col("min_latency") * 1e6).cast("long").alias("min_us"))


def _merge_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_log(spark, sf_dir).select(env.committable().alias("committable"))
    return env.merge_committables(rows)


def _produce(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = env.record(event_log(spark, sf_dir).filter(is_error()), "errors", F.col("partition"))
    return out.select("topic", "partition", F.decode("key", "UTF-8").alias("key"), F.decode("value", "UTF-8").alias("value"), F.size("headers").alias("n_headers"))


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filter, map, batch, unbatch: what a batched transform-and-produce consumer writes."""
    log = event_log(spark, sf_dir).transform(steps.filter_(~is_error())).transform(steps.map_(hashed=F.sha2("props", 256))).withColumn("batch_id", steps.count_batch_id(100))
    return steps.unbatch(log.transform(steps.batch(["event_id", "hashed"]))).select("partition", "offset", "event_id", "hashed")


def _conversation_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = spark.read.parquet(f"{sf_dir}/conversations.parquet").withColumn("ts", F.to_timestamp(F.lit(NOW)))
    log = env.as_log(talks, "talks", F.col("conv_id") % 3, ["conv_id", "turn", "text"], "ts", F.col("conv_id").cast("string"), F.col("text"), keep=["role"], dense="range")
    return log.groupBy("partition").agg(F.count("*").alias("n"), F.min("offset").alias("low"), F.max(env.next_offset()).alias("high"), F.countDistinct("offset").alias("n_offsets"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "envelope": _envelope,
    "hash": _hash,
    "map_opaque": _map_opaque,
    "map_threads": _map_threads,
    "filter": _filter,
    "filter_flags": _filter_flags,
    "filter_progress": _filter_progress,
    "filter_sentinels": _filter_sentinels,
    "unfold": _unfold,
    "count_batch": _count_batch,
    "weighted_batch": _weighted_batch,
    "time_batch": _time_batch,
    "fold": _fold,
    "batch_unbatch": _batch_unbatch,
    "dlq_split": _dlq_split,
    "dlq_limit": _dlq_limit,
    "dlq_limit_batches": _dlq_limit_batches,
    "sentinel_steps": _sentinel_steps,
    "invalid_progress": _invalid_progress,
    "buffer_cap": _buffer_cap,
    "buffer_miss": _buffer_miss,
    "watermarks": _watermarks,
    "start_offsets": _start_offsets,
    "seek_range": _seek_range,
    "commit_count": _commit_count,
    "commit_policy": _commit_policy,
    "commit_log": _commit_log,
    "latency": _latency,
    "merge_progress": _merge_progress,
    "produce": _produce,
    "transform_pipeline": _pipeline,
    "range_offsets": _conversation_log,
}

_PROGRESS = LOG_SQL + 'SELECT topic, partition, max("offset") + 1 AS next_offset FROM log GROUP BY topic, partition'

ORACLE_SQL: dict[str, str] = {
    "envelope": LOG_SQL + 'SELECT topic, partition, "offset", epoch_us("timestamp") AS ts_us, key, props AS value, CAST(0 AS INT) AS n_headers FROM log',
    "hash": LOG_SQL + 'SELECT partition, "offset", sha256(props) AS hashed, reverse(props) AS reversed FROM log',
    "map_opaque": LOG_SQL + 'SELECT partition, "offset", upper(event_type) AS event_type FROM log',
    "map_threads": LOG_SQL + 'SELECT partition, "offset", reverse(event_type) AS event_type FROM log',
    "filter": LOG_SQL + "SELECT partition, \"offset\", event_id FROM log WHERE event_type = 'error'",
    "filter_flags": LOG_SQL + "SELECT partition, \"offset\", event_type IS DISTINCT FROM 'error' AS is_filtered, CASE WHEN event_type = 'error' THEN upper(props) END AS props, \"offset\" + 1 AS next_offset FROM log",
    "filter_progress": LOG_SQL + """SELECT partition, count(*) FILTER (event_type = 'error') AS n_passed, max("offset") + 1 AS policy_next,
       max("offset") FILTER (event_type = 'error') + 1 AS plain_next FROM log GROUP BY partition""",
    "filter_sentinels": LOG_SQL.replace("WITH log", "WITH RECURSIVE log") + """, walk AS (
  SELECT partition, "offset" AS o, CAST(NULL AS BIGINT) AS committed, event_type = 'error' AS pass, CAST(NULL AS BIGINT) AS fired FROM log WHERE "offset" = 0
  UNION ALL
  SELECT l.partition, l."offset", CASE WHEN w.pass THEN w.committed WHEN w.o + 1 - coalesce(w.committed, w.o) >= 3 THEN w.o + 1 ELSE coalesce(w.committed, w.o) END,
         l.event_type = 'error', CASE WHEN NOT w.pass AND w.o + 1 - coalesce(w.committed, w.o) >= 3 THEN w.o END
  FROM walk w JOIN log l ON l.partition = w.partition AND l."offset" = w.o + 1)
SELECT partition, o AS "offset", false AS is_filtered FROM walk WHERE pass
UNION ALL SELECT partition, fired, true FROM walk WHERE fired IS NOT NULL
UNION ALL SELECT partition, o, true FROM walk w WHERE NOT pass AND o = (SELECT max("offset") FROM log l WHERE l.partition = w.partition)""",
    "unfold": LOG_SQL + """SELECT partition, "offset", CAST(item AS INT) AS item, CASE WHEN item = k - 1 THEN "offset" + 1 END AS next_offset
FROM (SELECT *, unnest(range(0, k)) AS item FROM log WHERE k >= 1)""",
    "count_batch": LOG_SQL + """SELECT partition, "offset" // 100 AS batch_id, count(*) AS n, CAST(sum(k) AS BIGINT) AS k_sum, max("offset") + 1 AS next_offset,
       epoch_us(arg_max("timestamp", "offset")) AS ts_us FROM log GROUP BY partition, "offset" // 100""",
    "weighted_batch": LOG_SQL.replace("WITH log", "WITH RECURSIVE log") + """, walk AS (
  SELECT partition, "offset" AS o, CAST(floor(amount) AS BIGINT) AS w, CAST(floor(amount) AS BIGINT) AS s, CAST(0 AS BIGINT) AS b FROM log WHERE "offset" = 0
  UNION ALL
  SELECT l.partition, l."offset", CAST(floor(l.amount) AS BIGINT), CASE WHEN x.s >= 500 THEN 0 ELSE x.s END + CAST(floor(l.amount) AS BIGINT),
         CASE WHEN x.s >= 500 THEN x.b + 1 ELSE x.b END
  FROM walk x JOIN log l ON l.partition = x.partition AND l."offset" = x.o + 1)
SELECT partition, b AS batch_id, count(*) AS n, CAST(sum(w) AS BIGINT) AS weight, max(o) + 1 AS next_offset FROM walk GROUP BY partition, b""",
    "time_batch": LOG_SQL.replace("WITH log", "WITH RECURSIVE log") + """, walk AS (
  SELECT partition, "offset" AS o, "timestamp" AS since, CAST(0 AS BIGINT) AS b FROM log WHERE "offset" = 0
  UNION ALL
  SELECT l.partition, l."offset", CASE WHEN l."timestamp" >= x.since + INTERVAL 6 HOUR THEN l."timestamp" ELSE x.since END,
         CASE WHEN l."timestamp" >= x.since + INTERVAL 6 HOUR THEN x.b + 1 ELSE x.b END
  FROM walk x JOIN log l ON l.partition = x.partition AND l."offset" = x.o + 1)
SELECT partition, b AS batch_id, count(*) AS n, min(o) AS first_offset, max(o) + 1 AS next_offset FROM walk GROUP BY partition, b""",
    "fold": LOG_SQL.replace("WITH log", "WITH RECURSIVE log") + """, walk AS (
  SELECT partition, "offset" AS o, (CAST(7 AS BIGINT) * 31 + k) % 1000003 AS v FROM log WHERE "offset" = 0
  UNION ALL
  SELECT l.partition, l."offset", (CASE WHEN l."offset" % 50 = 0 THEN 7 ELSE x.v END * 31 + l.k) % 1000003
  FROM walk x JOIN log l ON l.partition = x.partition AND l."offset" = x.o + 1)
SELECT partition, v AS value, o + 1 AS next_offset FROM walk w
WHERE o % 50 = 49 OR o = (SELECT max("offset") FROM log l WHERE l.partition = w.partition)""",
    "batch_unbatch": LOG_SQL + 'SELECT partition, "offset", CAST("offset" % 100 AS INT) AS position, event_id, props FROM log',
    "dlq_split": LOG_SQL + """SELECT 'events-dlq' AS topic, key, props AS value, CAST(partition AS VARCHAR) AS original_partition,
       CAST("offset" AS VARCHAR) AS original_offset, 'invalid' AS reason FROM log WHERE event_type = 'error'""",
    "dlq_limit": LOG_SQL + """, bad AS (SELECT partition, "offset" AS o, coalesce(lag("offset") OVER (PARTITION BY partition ORDER BY "offset"), -1) AS l FROM log WHERE event_type = 'error'),
runs AS (SELECT *, sum(CASE WHEN o = l + 1 THEN 0 ELSE 1 END) OVER w AS island, sum(CASE WHEN o = l + 1 THEN 0 ELSE o - l + 1 END) OVER w AS valid, count(*) OVER w AS invalid
  FROM bad WINDOW w AS (PARTITION BY partition ORDER BY o ROWS UNBOUNDED PRECEDING)),
counted AS (SELECT *, count(*) OVER (PARTITION BY partition, island ORDER BY o ROWS UNBOUNDED PRECEDING) AS run FROM runs)
SELECT partition, o AS "offset", CAST(valid AS BIGINT) AS valid_count, invalid AS invalid_count, run AS consecutive,
       valid > 0 AND invalid / valid <= 0.35 AND run <= 2 AS accepted FROM counted""",
    "sentinel_steps": LOG_SQL + """, bad AS (SELECT *, (row_number() OVER (PARTITION BY partition ORDER BY "offset") - 1) // 20 AS b FROM log WHERE event_type = 'error'),
folded AS (SELECT partition, max("offset") AS o, CAST(sum(k + 1) AS BIGINT) AS value FROM bad GROUP BY partition, b)
SELECT partition, o AS "offset", value, item, CASE WHEN item = value % 3 + 1 THEN o + 1 END AS next_offset, false AS is_filtered
FROM (SELECT *, CAST(unnest(range(1, value % 3 + 2)) AS BIGINT) AS item FROM folded)
UNION ALL SELECT partition, "offset", NULL, NULL, "offset" + 1, true FROM log WHERE event_type <> 'error'""",
    "invalid_progress": LOG_SQL + "SELECT topic, partition, max(\"offset\") + 1 AS next_offset, true AS is_filtered FROM log WHERE event_type = 'error' GROUP BY topic, partition",
    "buffer_cap": LOG_SQL + 'SELECT partition, "offset", event_id FROM log QUALIFY row_number() OVER (PARTITION BY partition ORDER BY "offset" DESC) <= 50',
    "buffer_miss": LOG_SQL + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY partition ORDER BY "offset" DESC) AS r FROM log)
SELECT partition, CAST(sum(CASE WHEN r <= 50 THEN 1 ELSE 0 END) AS BIGINT) AS found, CAST(sum(CASE WHEN r > 50 THEN 1 ELSE 0 END) AS BIGINT) AS missed
FROM ranked WHERE event_type = 'error' GROUP BY partition""",
    "watermarks": LOG_SQL + 'SELECT topic, partition, min("offset") AS low, max("offset") + 1 AS high FROM log GROUP BY topic, partition',
    "start_offsets": LOG_SQL + """SELECT topic, partition, CAST(CASE WHEN partition = 0 AND max("offset") + 1 >= 10 THEN 10 ELSE min("offset") END AS BIGINT) AS start_offset
FROM log GROUP BY topic, partition""",
    "seek_range": LOG_SQL + 'SELECT partition, "offset", event_id FROM log WHERE partition = 0 AND "offset" BETWEEN 5 AND 9 OR partition = 1 AND "offset" < 3 OR partition = 3 AND "offset" BETWEEN 100 AND 103',
    "commit_count": LOG_SQL + 'SELECT partition, "offset" + 1 AS next_offset, ("offset" + 1) // 40 AS commit_no FROM log WHERE ("offset" + 1) % 40 = 0',
    "commit_policy": LOG_SQL.replace("WITH log", "WITH RECURSIVE log") + """, bad AS (
  SELECT partition, "offset" + 1 AS p, row_number() OVER (PARTITION BY partition ORDER BY "offset") AS i FROM log WHERE event_type = 'error'),
walk AS (
  SELECT partition, i, p, p - 1 AS c, CAST(0 AS BIGINT) AS n, false AS due FROM bad WHERE i = 1
  UNION ALL
  SELECT b.partition, b.i, b.p, CASE WHEN b.p - w.c >= 40 THEN b.p ELSE w.c END, CASE WHEN b.p - w.c >= 40 THEN w.n + 1 ELSE w.n END, b.p - w.c >= 40
  FROM walk w JOIN bad b ON b.partition = w.partition AND b.i = w.i + 1)
SELECT partition, p AS next_offset, n AS commit_no FROM walk WHERE due""",
    "commit_log": LOG_SQL + """SELECT 'group-a' AS "group", topic, partition, max("offset") + 1 AS "offset", epoch_us(arg_max("timestamp", "offset")) AS ts_us, true AS no_p99
FROM log GROUP BY topic, partition""",
    "latency": LOG_SQL + f"""SELECT partition, max(epoch_us(TIMESTAMP '{NOW}') - epoch_us("timestamp")) AS max_us, min(epoch_us(TIMESTAMP '{NOW}') - epoch_us("timestamp")) AS min_us
FROM log GROUP BY partition""",
    "merge_progress": _PROGRESS,
    "produce": LOG_SQL + "SELECT 'errors' AS topic, partition, key, props AS value, CAST(0 AS INT) AS n_headers FROM log WHERE event_type = 'error'",
    "transform_pipeline": LOG_SQL + "SELECT partition, \"offset\", event_id, sha256(props) AS hashed FROM log WHERE event_type <> 'error'",
    "range_offsets": "SELECT CAST(conv_id % 3 AS INT) AS partition, count(*) AS n, CAST(0 AS BIGINT) AS low, count(*) AS high, count(*) AS n_offsets FROM conversations GROUP BY conv_id % 3",
}
ORACLE_SQL["dlq_limit_batches"] = ORACLE_SQL["dlq_limit"]
