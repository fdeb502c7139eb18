import datetime as dt
import json
import pstats

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from millrace.functions import envelope as env
from millrace.operators import dlq
from millrace.sources import kafka
from millrace.sources.consumer import Closed, EndOfPartition, LogConsumer, LogProducer
from millrace.sources.log import LogStore, OffsetOutOfRange, PartitionDoesNotExist, TopicDoesNotExist, TopicExists, _ends, _LogStreamReader, _Range, _rows, _split, register
from millrace.streaming import metrics, processor
from millrace.streaming.metric_names import FROM_PROGRESS, NAMES
from millrace.streaming.profile import profiled
from millrace.streaming.stateful import BatchProcessor, batch_stream, limit_stream

T0 = dt.datetime(2024, 1, 1)


def messages(spark, values, partition=0):
    return spark.createDataFrame([(str(v).encode(), partition, T0, v) for v in values], "value binary, partition int, timestamp timestamp, n int")


@pytest.fixture
def store(spark, tmp_path):
    out = LogStore(spark, f"file://{tmp_path}/log")
    out.create_topic("t", 2)
    return out


def test_catalog(spark, store):
    assert store.list_topics() == ["t"]
    assert store.partition_count("t") == 2
    with pytest.raises(TopicExists):
        store.create_topic("t", 1)
    with pytest.raises(TopicDoesNotExist):
        store.partition_count("no")
    assert store.consume("t", 0, 0) is None
    store.produce(messages(spark, range(3)), "t", ["n"])
    store.produce(messages(spark, range(3, 5)), "t", ["n"])
    assert [bytes(r.value) for r in store.read("t").orderBy("offset").collect()] == [b"0", b"1", b"2", b"3", b"4"]
    assert store.watermarks("t") == {0: (0, 5), 1: (0, 0)}
    assert bytes(store.consume("t", 0, 4).value) == b"4"
    assert store.consume("t", 0, 5) is None
    with pytest.raises(OffsetOutOfRange):
        store.consume("t", 0, 6)
    with pytest.raises(PartitionDoesNotExist):
        store.consume("t", 2, 0)
    with pytest.raises(ValueError, match="negative"):
        store.consume("t", 0, -1)
    assert store.read("t", {0: 1}, {0: 3}).count() == 2
    store.delete_topic("t")
    assert store.list_topics() == []


def test_keys_choose_partitions(spark, store):
    rows = spark.range(40).select(F.col("id").cast("string").cast("binary").alias("key"), F.lit(b"v").alias("value"))
    store.produce(rows, "t")
    store.produce(rows, "t")
    by_key = {}
    for r in store.read("t").collect():
        by_key.setdefault(bytes(r.key), set()).add(r.partition)
    assert len(by_key) == 40
    assert all(len(p) == 1 for p in by_key.values())
    assert sum(high for _, high in store.watermarks("t").values()) == 80


def test_offsets_reach_the_scan(spark, store):
    store.produce(messages(spark, range(5)), "t", ["n"])
    plan = store.read("t", {0: 2})._jdf.queryExecution().toString()  # noqa: SLF001
    assert "PushedFilters" in plan
    assert "GreaterThanOrEqual(offset,2)" in plan


def collect_sink(into):
    return lambda df, batch_id: into.setdefault(batch_id, []).extend(df.collect())


def test_stream_equals_replay_and_resumes(spark, store, tmp_path):
    for a in range(0, 12, 3):
        store.produce(messages(spark, range(a, a + 3)), "t", ["n"])
    good, bad, replay = {}, {}, {}
    text = F.decode("value", "UTF-8")
    make = lambda sink, letters: processor.Pipeline(lambda df: df.select("offset", text.alias("v")), sink, invalid=text == "7", dead_letters=dlq.DlqConfig("dead"), dead_letter_sink=letters)
    pipeline = make(collect_sink(good), collect_sink(bad))
    check = f"{tmp_path}/check"
    processor.run_stream(pipeline, store.read_stream("t", 1), check).awaitTermination()
    assert len(good) == 4
    processor.run_batch(make(collect_sink(replay), collect_sink({})), store.read("t"))
    assert sorted(r.v for rows in good.values() for r in rows) == sorted(r.v for r in replay[0])
    assert [bytes(r.value) for rows in bad.values() for r in rows] == [b"7"]
    store.produce(messages(spark, [99]), "t", ["n"])
    good.clear()
    processor.Processor(pipeline, store.read_stream("t", 1), check).run()
    assert [r.v for rows in good.values() for r in rows] == ["99"]


def test_source_by_offsets(spark, store, tmp_path):
    register(spark)
    store.produce(messages(spark, range(7)), "t", ["n"])
    store.produce(messages(spark, range(3), 1), "t", ["n"])
    options = {"path": store.root, "topic": "t"}
    read = lambda **more: sorted((r.partition, r.offset) for r in spark.read.format("millrace_log").options(**options, **more).load().collect())
    assert len(read()) == 10
    assert read(startingOffsets='{"0": 5}', endingOffsets='{"1": 1}') == [(0, 5), (0, 6), (1, 0)]
    with pytest.raises(Exception, match="OffsetOutOfRange|offset 99"):
        read(startingOffsets='{"0": 99}')
    assert read(offsetsPerTask=2) == read()
    assert spark.read.format("millrace_log").options(**options, offsetsPerTask=2).load().rdd.getNumPartitions() == 6
    rows = {}
    done = str(tmp_path / "committed.json")
    stream = spark.readStream.format("millrace_log").options(**options, committed=done).load()
    processor.run_stream(processor.Pipeline(lambda df: df, collect_sink(rows)), stream, f"{tmp_path}/check").awaitTermination()
    assert sum(map(len, rows.values())) == 10
    reader = _LogStreamReader(options | {"committed": done, "maxOffsetsPerTrigger": "8"})
    assert (reader.initialOffset(), reader.latestOffset(), reader.latestOffset()) == ({"0": 0, "1": 0}, {"0": 7, "1": 1}, {"0": 7, "1": 3})
    for _ in range(2):  # Spark may commit an end twice
        reader.commit({"0": 7, "1": 3})
    with open(done, encoding="utf-8") as file:
        assert json.load(file) == {"0": 7, "1": 3}


def test_row_groups_are_read_in_order(tmp_path):
    folder = tmp_path / "data/topic=t/partition=0"
    folder.mkdir(parents=True)
    (tmp_path / "_topics").mkdir()
    (tmp_path / "_topics/t.json").write_text('{"partitions": 2}')

    def write(name, offsets, size, **more):
        columns = {"offset": pa.array(offsets, pa.int64()), "timestamp": pa.nulls(len(offsets), pa.timestamp("us")), "key": pa.nulls(len(offsets), pa.binary()), "value": [b"%d" % o for o in offsets]}
        headers = pa.array([[{"key": "h", "value": b"1"}]] * len(offsets), pa.list_(pa.struct([("key", pa.string()), ("value", pa.binary())])))
        pq.write_table(pa.table({"headers": headers} | columns), folder / name, row_group_size=size, **more)

    write("b.parquet", [5, 4, 9, 3], 2)
    write("a.parquet", [0, 1, 2, 8], 2, write_statistics=False)
    write("c.parquet", [12, 10], 8)
    write("empty.parquet", [], 8)
    (folder / "_broken.parquet").write_bytes(b"")
    root = f"file://{tmp_path}"
    assert _ends(root, "t") == {"0": 13, "1": 0}
    got = list(_rows(root, "t", _Range(0, 1, 11)))
    assert [(r[2], r[5]) for r in got] == [(o, b"%d" % o) for o in (1, 2, 3, 4, 5, 8, 9, 10)]
    assert got[0][6] == [("h", b"1")]
    assert list(_rows(root, "t", _Range(0, 6, 8))) == []
    assert list(_rows(root, "t", _Range(1, 0, 8))) == []
    assert [(r.partition, r.start, r.end) for r in _split([_Range(0, 1, 6), _Range(1, 3, 3)], {"offsetspertask": "2"})] == [(0, 1, 3), (0, 3, 5), (0, 5, 6)]
    with pytest.raises(ValueError, match="positive"):
        _split([], {"offsetspertask": "0"})


def test_stateful_batches_survive_a_restart(spark, store, tmp_path):
    batches = lambda: batch_stream(store.read_stream("t", 1), BatchProcessor(3))
    run = lambda: batches().writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
    for a in (0, 2):
        store.produce(messages(spark, range(a, a + 2)), "t", ["n"])
    run()
    store.produce(messages(spark, range(4, 7)), "t", ["n"])
    run()
    rows = spark.read.parquet(f"{tmp_path}/out").orderBy("next_offset").collect()
    assert [(list(r["values"]), r.next_offset) for r in rows] == [([b"0", b"1", b"2"], 3), ([b"3", b"4", b"5"], 6)]


def test_limits_keep_their_counters(spark, store, tmp_path):
    run = lambda: limit_stream(store.read_stream("t"), dlq.DlqLimit(max_consecutive_count=3)).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
    for a in (0, 2):
        store.produce(messages(spark, range(a, a + 2)), "t", ["n"])
        run()
    assert [(r.offset, r.accepted) for r in spark.read.parquet(f"{tmp_path}/out").orderBy("offset").collect()] == [(0, True), (1, True), (2, True), (3, False)]


def test_kafka_options():
    options = kafka.consumer_options(["a:1", "b:2"], ["x", "y"], "g", "largest", True, 1000, 8, overrides={"socket.timeout.ms": 5, "enable.ssl": True})
    assert options["kafka.bootstrap.servers"] == "a:1,b:2"
    assert (options["subscribe"], options["startingOffsets"], options["failOnDataLoss"], options["maxOffsetsPerTrigger"]) == ("x,y", "latest", "true", "1000")
    assert (options["kafka.socket.timeout.ms"], options["kafka.enable.ssl"]) == ("5", "true")
    with pytest.raises(ValueError, match="reset"):
        kafka.consumer_options("a", "x", auto_offset_reset="middle")
    assert kafka.offsets_json("x", {1: 5, 0: 2}) == '{"x": {"0": 2, "1": 5}}'
    assert [kafka.as_bool(v) for v in ("true", "T", "0", False, 1)] == [True, True, False, False, True]
    for wrong, error in (("maybe", ValueError), (2, ValueError), (None, TypeError)):
        with pytest.raises(error):
            kafka.as_bool(wrong)


def test_metrics_health_retry(tmp_path):
    lines = []
    backend = metrics.StatsdMetrics("app", lines.append).with_tag("host", "a")
    backend.increment("n")
    backend.timing("t", 12, {"k": "v"})
    with metrics.Gauge(backend, "busy"):
        pass
    assert lines == ["app.n:1|c|#host:a", "app.t:12|ms|#host:a,k:v", "app.busy:1|g|#host:a", "app.busy:0|g|#host:a"]
    metrics.configure_metrics(backend, force=True)
    with pytest.raises(RuntimeError):
        metrics.configure_metrics(backend)
    now = [0.0]
    health = metrics.HealthFile(str(tmp_path / "ok"), clock=lambda: now[0])
    assert health.touch()
    assert not health.touch()
    now[0] = 1.0
    assert health.touch()
    calls = []

    def fail():
        calls.append(1)
        raise KeyError("x")

    with pytest.raises(metrics.RetryError):
        metrics.retry(fail, 3, sleep=lambda s: None)
    with pytest.raises(KeyError):
        metrics.retry(fail, 3, suppress=lambda e: not isinstance(e, KeyError))
    assert len(calls) == 4


def test_watchdog():
    class Query:
        isActive, lastProgress = True, {"batchId": 1, "timestamp": "a"}  # noqa: N815

    now, told = [0.0], []
    dog = metrics.Watchdog(Query(), 5, told.append, clock=lambda: now[0])
    dog.check()
    for now[0] in (4.0, 6.0, 9.0):
        dog.check()
    assert len(told) == 1
    assert "Thread" in told[0]


def test_listener_reports(spark, store, tmp_path):
    store.produce(messages(spark, range(5)), "t", ["n"])
    lines = []
    listener = metrics.ProgressListener(metrics.StatsdMetrics("m", lines.append), metrics.HealthFile(str(tmp_path / "ok")))
    stream = metrics.observed(store.read_stream("t"))
    processor.Processor(processor.Pipeline(lambda df: df, processor.noop_sink), stream, f"{tmp_path}/check", listener).run()
    import time

    for _ in range(50):
        if any("batch.rows" in x for x in lines):
            break
        time.sleep(0.1)
    assert any("batch.rows" in x for x in lines)


def test_consumer_and_producer(spark, store):
    producer = LogProducer(store)
    for p, v in ((0, b"a"), (1, b"b"), (0, b"c")):
        producer.produce("t", v, partition=p, headers=[("h", b"1")])
    assigned, revoked = [], []
    consumer = LogConsumer(store, "g", end_of_partition=True)
    consumer.subscribe("t", assigned.append, revoked.append)
    assert assigned == [{0: 0, 1: 0}]
    assert [bytes(consumer.poll().value) for _ in range(2)] == [b"a", b"c"]
    with pytest.raises(EndOfPartition):
        consumer.poll()
    consumer.pause([1])
    assert consumer.poll() is None
    consumer.resume([1])
    assert bytes(consumer.poll().value) == b"b"
    consumer.stage_offsets({0: 1})
    consumer.stage_offsets({1: 1})
    assert consumer.commit_offsets() == {0: 1, 1: 1}
    consumer.seek({0: 9})
    with pytest.raises(OffsetOutOfRange):
        consumer.poll()
    for wrong, error in (({5: 0}, PartitionDoesNotExist), ({0: -1}, ValueError)):
        with pytest.raises(error):
            consumer.seek(wrong)
    consumer.close()
    assert revoked == [[0, 1]]
    with pytest.raises(Closed):
        consumer.poll()
    again = LogConsumer(store, "g")
    again.subscribe("t")
    assert again.tell() == {0: 1, 1: 1}
    assert bytes(again.poll().value) == b"c"
    late = LogConsumer(store, "other", "latest")
    late.subscribe("t")
    assert late.poll() is None


def test_commits_are_tried_again(spark, store):
    lines, pauses, calls = [], [], []
    metrics.configure_metrics(metrics.StatsdMetrics("m", lines.append), force=True)
    store.produce(messages(spark, range(2)), "t", ["n"])
    consumer = LogConsumer(store, "g", sleep=pauses.append)
    consumer.subscribe("t")
    commit, fails = consumer.offsets.commit, [OSError("x")] * 2

    def flaky(topic, offsets):
        calls.append(offsets)
        if fails:
            raise fails.pop()
        commit(topic, offsets)

    consumer.offsets.commit = flaky
    consumer.stage_offsets({0: 1})
    assert consumer.commit_offsets() == {0: 1}
    assert (len(calls), pauses) == (3, [1.0, 1.0])
    assert consumer.offsets.read("t") == {0: 1}
    fails[:] = [OSError("x")] * 3
    consumer.stage_offsets({0: 2})
    with pytest.raises(metrics.RetryError):
        consumer.commit_offsets()
    fails[:] = [KeyError("not a fault of the file system")]
    with pytest.raises(KeyError):
        consumer.commit_offsets()
    assert consumer.commit_offsets() == {0: 2}
    assert consumer.commit_offsets() == {}
    assert [x.split("#status:")[1] for x in lines] == ["success,group_id:g", "error,group_id:g", "error,group_id:g", "success,group_id:g"]


def test_deliveries(spark):
    lines, now = [], [0.0]
    deliveries = metrics.Deliveries("p", metrics.StatsdMetrics("m", lines.append), clock=lambda: now[0])
    with deliveries.one():
        now[0] = 0.5
    assert not lines
    sink = processor.measured(lambda df, batch_id: now.__setitem__(0, 2.0) if batch_id == 0 else 1 / 0, deliveries)
    sink(None, 0)
    assert lines == ["m.producer.produce_status:2|c|#status:success,producer_name:p", "m.producer.callback_latency:500|ms|#producer_name:p", "m.producer.callback_latency:1500|ms|#producer_name:p"]
    with pytest.raises(ZeroDivisionError):
        sink(None, 1)
    assert len(lines) == 3
    deliveries.flush()
    assert lines[3:] == ["m.producer.produce_status:1|c|#status:error,producer_name:p", "m.producer.callback_latency:0|ms|#producer_name:p"]
    deliveries.flush()
    assert len(lines) == 5
    nameless = metrics.Deliveries(None, metrics.StatsdMetrics("m", lines.append), clock=lambda: 0.0)
    with nameless.one():
        pass
    nameless.flush()
    assert lines[5:] == ["m.producer.produce_status:1|c|#status:success", "m.producer.callback_latency:0|ms|#producer_name:N/A"]


def test_error_names(spark):
    assert metrics.error_name(KeyError("a")) == "KeyError"
    assert metrics.error_name("nothing known") == "Unknown"
    text = "An error occurred while calling o1.x.\n: org.apache.spark.SparkException: Job aborted\n\tat a.b.C.d(C.java:1)\nCaused by: org.apache.kafka.common.errors.TopicAuthorizationException: no\n\tat x.Y.z(Y.java:2)"
    assert metrics.error_name(text) == "TopicAuthorization"
    with pytest.raises(Exception) as caught:  # noqa: PT011
        spark.range(1).select("missing")
    assert metrics.error_name(caught.value).startswith("UNRESOLVED_COLUMN")


def test_profiles(spark, tmp_path):
    def double(n):
        return 2 * n

    with pytest.raises(NotADirectoryError), profiled(spark, str(tmp_path / "none")):
        pass
    with profiled(spark, str(tmp_path)):
        assert [r[0] for r in spark.range(3).select(F.udf(double, "long")("id")).collect()] == [0, 2, 4]
    with pytest.raises(ZeroDivisionError), profiled(spark, str(tmp_path)):
        1 / 0  # noqa: B018
    assert len(list(tmp_path.glob("*.prof"))) == 2
    (udf,) = tmp_path.glob("udf_*_perf.pstats")
    assert any(name == "double" for _, _, name in pstats.Stats(str(udf)).stats)
    assert spark.conf.get("spark.sql.pyspark.udf.profiler", None) is None


def test_client_statistics():
    lines = []
    metrics.kafka_statistics(json.dumps({"msg_cnt": 3, "brokers": {"b": {"nodeid": 1, "rtt": {"p99": 2500}, "txerrs": 0}}}), metrics.StatsdMetrics("m", lines.append))
    assert lines == ["m.producer.librdkafka.message_count:3|g", "m.producer.librdkafka.p99_rtt:2.5|ms|#broker_id:1"]
    assert len(set(NAMES)) == len(NAMES)
    assert set(FROM_PROGRESS) <= set(NAMES)


def test_limits_count_over_micro_batches(spark, tmp_path):
    # a valid row, an invalid one, then batches without and with invalid ones: counted as on a replay
    store = LogStore(spark, str(tmp_path / "log"))
    store.create_topic("t", 1)
    bad = {5, 8, 9, 11}
    limit = dlq.DlqLimit(0.9, 2)
    for a in range(0, 12, 3):
        store.produce(messages(spark, range(a, a + 3)), "t", ["n"])
    text = F.decode("value", "UTF-8")
    invalid = text.isin([str(b) for b in bad])
    letters = {}
    pipeline = processor.Pipeline(lambda df: df, processor.noop_sink, invalid=invalid, dead_letters=dlq.DlqConfig("dead", limit), dead_letter_sink=collect_sink(letters))
    processor.run_stream(pipeline, store.read_stream("t", 1), str(tmp_path / "check")).awaitTermination()
    assert sorted(int(bytes(r.value)) for rows in letters.values() for r in rows) == sorted(bad)
    # the same batch again counts once
    counters = processor.Counters(str(tmp_path / "counters"))
    log = store.read("t")
    for batch, (a, b) in enumerate([(0, 7), (7, 10), (7, 10), (10, 12)]):
        processor.run_batch(pipeline, log.filter(F.col("offset").between(a, b - 1)), batch - (batch > 1), counters)
    whole = dlq.counters_after(dlq.apply_limit(log.filter(invalid), limit, assigned={0: 0}), spark.createDataFrame([], dlq.COUNTERS)).first()
    assert counters.before(log, 99).first() == whole
    # three in a row are one too many, though each batch has one
    three = dlq.DlqConfig("dead", dlq.DlqLimit(None, 2))
    strict = processor.Pipeline(lambda df: df, processor.noop_sink, invalid=text.isin("5", "6", "7"), dead_letters=three, dead_letter_sink=collect_sink({}))
    counters = processor.Counters()
    processor.run_batch(strict, log.filter("offset = 5"), 0, counters)
    processor.run_batch(strict, log.filter("offset = 6"), 1, counters)
    with pytest.raises(Exception, match="limit exceeded"):
        processor.run_batch(strict, log.filter("offset = 7"), 2, counters)


def test_messages_that_left_the_buffer_are_not_dead_letters(spark):
    rows = spark.range(10).select(F.lit("t").alias("topic"), F.lit(0).alias("partition"), F.col("id").alias("offset"), F.lit(T0).alias("timestamp"), F.lit(None).cast("binary").alias("key"), F.col("id").cast("string").cast("binary").alias("value")).withColumn("headers", env.no_headers())
    letters = {}
    pipeline = processor.Pipeline(lambda df: df, processor.noop_sink, invalid=F.col("offset").isin(1, 9), dead_letters=dlq.DlqConfig("dead", buffered=2), dead_letter_sink=collect_sink(letters))
    with pytest.warns(UserWarning, match="1 invalid"):
        processor.run_batch(pipeline, rows)
    assert [bytes(r.value) for r in letters[0]] == [b"9"]


def test_reads_from_some_start_offsets_keep_the_other_partitions(spark, tmp_path):
    store = LogStore(spark, str(tmp_path))
    store.create_topic("t", 2)
    store.produce(messages(spark, range(4)), "t", ["n"])
    store.produce(messages(spark, range(3), 1), "t", ["n"])
    assert sorted((r.partition, r.offset) for r in store.read("t", {0: 2}).collect()) == [(0, 2), (0, 3), (1, 0), (1, 1), (1, 2)]
    assert sorted((r.partition, r.offset) for r in store.read("t", {0: 2}, {1: 1}).collect()) == [(0, 2), (0, 3), (1, 0)]
