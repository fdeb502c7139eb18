import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions import envelope as env
from millrace.operators import commit, dlq, steps

T0 = dt.datetime(2022, 1, 1, 0, 0, 1)


def log(spark, rows, value="string"):
    """rows: (partition, offset, payload)."""
    data = [("t", p, o, T0 + dt.timedelta(seconds=o), v) for p, o, v in rows]
    return spark.createDataFrame(data, f"topic string, partition int, offset bigint, timestamp timestamp, payload {value}")


def got(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_filter_without_policy(spark):
    df = log(spark, [(0, i, v) for i, v in enumerate([True, False, True, False, True, False], 1)], "boolean")
    assert got(df.transform(steps.filter_(F.col("payload"))), "offset") == [(1,), (3,), (5,)]


def test_filter_with_policy_emits_a_sentinel(spark):
    df = log(spark, [(0, i, v) for i, v in enumerate([True, False, True, False, True, False])], "boolean")
    # the row at offset 3 commits 4; the last dropped row is flushed at the end
    assert got(steps.sentinels(df, F.col("payload"), 3), "offset", "is_filtered") == [(0, False), (2, False), (3, True), (4, False), (5, True)]


def test_flags_keep_progress_and_pass_sentinels(spark):
    df = log(spark, [(0, 0, True), (0, 1, False), (0, 2, None)], "boolean")
    out = df.transform(steps.flag_filtered(F.col("payload"), ["payload"])).transform(steps.map_(payload=~F.col("payload")))
    assert got(out.fillna(False), "offset", "is_filtered") == [(0, False), (1, True), (2, True)]
    assert env.progress(out).first().next_offset == 3


@pytest.mark.parametrize(("weights", "size", "expected"), [([1, 2, 3, 2, 3], 3, [0, 0, 1, 2, 2]), ([5, 5, 5], 10, [0, 0, 1]), ([4, 1, 1], 3, [0, 1, 1])])
def test_weighted_batches_never_split(spark, weights, size, expected):
    df = log(spark, [(0, i, w) for i, w in enumerate(weights)], "int")
    out = steps.closing_batch_ids(df, size=size, weight="payload")
    assert [b for _, b in got(out, "offset", "batch_id")] == expected


def test_batch_and_unbatch_round_trip(spark):
    df = log(spark, [(p, o, f"{p}-{o}") for p in range(2) for o in range(7)]).withColumn("batch_id", steps.count_batch_id(3))
    batches = df.transform(steps.batch(["payload"]))
    assert got(batches, "partition", "batch_id", "next_offset", "n") == [(p, b, min(3 * b + 3, 7), min(3, 7 - 3 * b)) for p in range(2) for b in range(3)]
    assert got(steps.unbatch(batches), "partition", "offset", "payload") == got(df, "partition", "offset", "payload")


def test_fold_in_order_and_empty_batches(spark):
    df = log(spark, [(0, 0, 0), (0, 1, 0), (0, 2, 0)], "int")
    fold = lambda flush: steps.fold_batches(df, lambda acc, row: [*acc, row["offset"]], list, "array<bigint>", 1, "payload", flush).collect()
    assert fold(False) == []
    assert [list(r.value) for r in fold(True)] == [[0, 1, 2]]
    whole = steps.fold_batches(df, lambda acc, row: [*acc, row["offset"]], list, "array<bigint>", 2).collect()
    assert [(list(r.value), r.next_offset) for r in whole] == [([0, 1], 2), ([2], 3)]


def test_unfold_gives_the_last_item_the_committable(spark):
    df = log(spark, [(0, 0, 2), (0, 1, 0)], "int")
    items = F.when(F.col("payload") > 0, F.sequence(F.lit(0), F.col("payload") - 1)).otherwise(F.array().cast("array<int>"))
    rows = df.transform(steps.unfold(items)).orderBy("item").collect()
    assert [(r.item, r.next_offset) for r in rows] == [(0, None), (1, 1)]


def test_threads_keep_order_and_fail_loudly(spark):
    df = log(spark, [(0, i, i) for i in range(50)], "int").select("offset", "payload").coalesce(1)
    out = df.transform(steps.map_threads(lambda r: {"offset": r["offset"], "payload": r["payload"] * 2}, "offset bigint, payload int", 4))
    assert [r.payload for r in out.collect()] == [2 * i for i in range(50)]
    with pytest.raises(Exception, match="division"):
        df.transform(steps.map_threads(lambda r: 1 // 0, "offset bigint, payload int")).collect()


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 9)), min_size=1, max_size=30), st.integers(1, 12))
def test_every_offset_is_in_exactly_one_batch(spark, rows, size):
    at = {0: -1, 1: -1}
    data = []
    for p, w in rows:
        at[p] += 1
        data.append((p, at[p], w))
    out = steps.closing_batch_ids(log(spark, data, "int"), size=size, weight="payload").collect()
    assert sorted((r.partition, r.offset) for r in out) == sorted((p, o) for p, o, _ in data)
    for p in (0, 1):
        own = sorted((r.offset, r.batch_id, r.payload) for r in out if r.partition == p)
        assert all(0 <= b[1] - a[1] <= 1 for a, b in zip(own, own[1:], strict=False))
        for batch in {b for _, b, _ in own}:
            inner = [w for _, b, w in own if b == batch]
            assert sum(inner[:-1]) < size


def test_dead_letters_carry_their_place(spark):
    df = log(spark, [(0, 0, "v"), (0, 1, "i"), (1, 5, "i")]).withColumns({"key": F.lit(None).cast("binary"), "value": F.col("payload").cast("binary"), "headers": env.no_headers()})
    valid, invalid = dlq.split(dlq.validate(df, F.col("payload") == "i", "bad payload"))
    assert valid.count() == 1
    out = dlq.dead_letters(invalid, "dead")
    place = [F.decode(env.header(n), "UTF-8").alias(n) for n in ("original_partition", "original_offset")]
    assert got(out.select("reason", *place), "original_partition", "original_offset", "reason") == [("0", "1", "bad payload"), ("1", "5", "bad payload")]
    assert got(dlq.invalid_progress(invalid), "partition", "next_offset") == [(0, 2), (1, 6)]


def test_limits(spark):
    bad = log(spark, [(0, o, "i") for o in (4, 5, 6, 7, 8, 9)])
    out = dlq.apply_limit(bad, dlq.DlqLimit(max_consecutive_count=5))
    assert [a for _, a in got(out, "offset", "accepted")] == [True] * 5 + [False]
    out = dlq.apply_limit(log(spark, [(0, 1, "i")]), dlq.DlqLimit(0.0, 1), assigned={0: 0})
    assert out.first().accepted is False
    with pytest.raises(Exception, match="limit exceeded"):
        dlq.enforce(out).collect()
    assert dlq.enforce(out, "drop").count() == 0


def test_buffer(spark):
    df = log(spark, [(0, o, "x") for o in range(10)])
    assert got(dlq.buffered(df, 2), "offset") == [(8,), (9,)]
    found, missed = dlq.look_up(dlq.buffered(df, 6), df.filter("offset in (0, 3, 4, 9)"))
    assert (got(found, "offset"), got(missed, "offset")) == ([(4,), (9,)], [(0,), (3,)])
    assert dlq.buffered(df, 0).count() == 10


@pytest.mark.parametrize(
    ("policy", "moves", "expected"),
    [
        (commit.CommitPolicy(None, 2), [(0.0, {0: o}) for o in (0, 1, 2, 5, 10)], [0, 1, 1, 2, 3]),
        (commit.CommitPolicy(None, 2), [(0.0, {0: 200}), (0.0, {1: 400}), (0.0, {0: 400}), (0.0, {1: 400})], [0, 0, 1, 1]),
        (commit.IMMEDIATE, [(0.0, {0: 200})], [1]),
        (commit.CommitPolicy(2, None), [(float(i), {0: i}) for i in range(7)], [0, 0, 1, 1, 2, 2, 3]),
    ],
)
def test_commit_policies(policy, moves, expected):
    state, n, out = policy.state(0.0), 0, []
    for now, offsets in moves:
        if state.should_commit(now, offsets):
            state.did_commit(now, offsets)
            n += 1
        out.append(n)
    assert out == expected
    with pytest.raises(ValueError, match="policy"):
        commit.CommitPolicy()


def test_commit_codec(spark):
    key, value = commit.encode_record("leader-a", "topic", 0, 5, 1.5)
    rows = [(key, value, None), (b"topic:0:leader-a", b"5", [("orig_message_ts", b"2023-09-26T21:58:14.191325Z")]), (b"topic:1:g", b'{"offset": 7, "orig_message_ts": 2.0, "received_p99": 0}', None)]
    messages = spark.createDataFrame(rows, "key binary, value binary, headers array<struct<key: string, value: binary>>")
    out = sorted(commit.decode(messages).collect(), key=lambda r: (r.partition, r.orig_message_ts))
    assert [(r.group, r.topic, r.partition, r.offset, r.received_p99) for r in out] == [("leader-a", "topic", 0, 5, None), ("leader-a", "topic", 0, 5, None), ("g", "topic", 1, 7, None)]
    assert out[1].orig_message_ts == pytest.approx(1695765494.191325)
    records = spark.createDataFrame([("a:b", "t", 0, 1, 1.0, None)], "group string, topic string, partition int, offset bigint, orig_message_ts double, received_p99 double")
    with pytest.raises(Exception, match="colon"):
        commit.encode(records).collect()


def test_start_offsets(spark):
    marks = env.watermarks(log(spark, [(0, o, "x") for o in range(5)] + [(1, 2, "x")]))
    done = spark.createDataFrame([("t", 0, 3)], "topic string, partition int, next_offset bigint")
    assert got(env.start_offsets(marks, done, "latest"), "partition", "start_offset") == [(0, 3), (1, 3)]
    assert got(env.start_offsets(marks, None, "smallest"), "partition", "start_offset") == [(0, 0), (1, 2)]
    late = spark.createDataFrame([("t", 0, 99)], "topic string, partition int, next_offset bigint")
    with pytest.raises(Exception, match="out of range"):
        env.start_offsets(marks, late).collect()
    with pytest.raises(ValueError, match="negative"):
        env.seek(log(spark, []), {0: (-1, None)})


def test_range_offsets_are_dense(spark):
    df = spark.range(1000).withColumns({"p": F.col("id") % 3, "ts": F.lit(T0), "o": F.hash("id")})
    out = env.as_log(df, "t", F.col("p"), ["o", "id"], "ts", keep=["id"], dense="range").collect()
    by = env.as_log(df, "t", F.col("p"), ["o", "id"], "ts", keep=["id"]).collect()
    assert {(r.partition, r.offset, r.id) for r in out} == {(r.partition, r.offset, r.id) for r in by}


def test_folds_keep_exact_types(spark):
    big = (1 << 53) + 1
    rows = [("t", 0, 0, T0, big, float("nan"), b"\xff\x00"), ("t", 0, 1, T0, None, 1.5, None), ("t", 0, 2, T0, big, None, b"")]
    df = spark.createDataFrame(rows, "topic string, partition int, offset bigint, timestamp timestamp, n bigint, x double, b binary")
    for out in (steps.closing_batch_ids(df, size=2), steps.sentinels(df, F.lit(True), 5)):
        back = out.orderBy("offset").collect()
        assert [r.n for r in back] == [big, None, big]
        assert (back[0].x != back[0].x, back[1].x, back[2].x) == (True, 1.5, None)
        assert [r.b for r in back] == [b"\xff\x00", None, b""]
        assert [r.timestamp for r in back] == [T0] * 3
    total = steps.fold_batches(df, lambda acc, row: acc + (row["n"] or 0), lambda: 0, "bigint", 3).first()
    assert total.value == 2 * big


def test_sentinels_pass_every_step(spark):
    df = log(spark, [(0, i, i) for i in range(7)], "int").withColumn("is_filtered", F.col("offset").isin(1, 4))
    past = lambda out: sorted((r.next_offset if "next_offset" in out.columns else r.offset + 1) for r in out.filter("is_filtered").collect())
    fold = steps.fold_batches(df, lambda acc, row: [*acc, row["payload"]], list, "array<int>", 2)
    assert (past(fold), got(fold.filter("not is_filtered"), "value", "next_offset")) == ([2, 5], [([0, 2], 3), ([3, 5], 6), ([6], 7)])
    assert past(df.transform(steps.unfold(F.array("payload", "payload")))) == [2, 5]
    ids = steps.closing_batch_ids(df, size=2)
    assert (past(ids), got(ids.filter("not is_filtered"), "offset", "batch_id")) == ([2, 5], [(0, 0), (2, 0), (3, 1), (5, 1), (6, 2)])
    batches = ids.transform(steps.batch(["payload"]))
    assert (past(batches), sorted(r.n for r in batches.filter("not is_filtered").collect())) == ([2, 5], [1, 2, 2])
    assert past(steps.unbatch(batches)) == [2, 5]
    assert past(ids.transform(steps.reduce_({"s": F.sum("payload")}))) == [2, 5]
    schema = "topic string, partition int, offset bigint, payload int"
    for step in (steps.map_udf(lambda f: f[["topic", "partition", "offset", "payload"]].assign(payload=f["payload"] * 2), schema), steps.map_threads(lambda r: {k: r[k] for k in ("topic", "partition", "offset")} | {"payload": r["payload"] * 2}, schema)):
        out = df.transform(step)
        assert (past(out), [p for _, p in got(out.filter("not is_filtered"), "offset", "payload")]) == ([2, 5], [0, 4, 6, 10, 12])
    # the dropped row at offset 0 is no longer the partition's last
    assert got(steps.sentinels(df, F.col("payload") > 0, 9), "offset", "is_filtered") == [(1, True), (2, False), (3, False), (4, True), (5, False), (6, False)]


def test_filter_policy_over_partitions_and_by_time(spark):
    rows = [("t", p, o, T0 + dt.timedelta(seconds=i), False) for i, (p, o) in enumerate([(1, 0), (0, -1), (0, 0), (0, 1)])]
    df = spark.createDataFrame(rows, "topic string, partition int, offset bigint, timestamp timestamp, payload boolean")
    order = ["timestamp", "partition", "offset"]
    out = [(r.partition, r.offset + 1) for r in steps.sentinels(df, F.col("payload"), 3, ["topic"], order).collect()]
    assert (sorted(out[:2]), out[2:]) == ([(0, 1), (1, 1)], [(0, 2)])
    timed = [(r.partition, r.offset + 1) for r in steps.sentinels(df, F.col("payload"), commit.CommitPolicy(2, None), ["topic"], order).collect()]
    assert (sorted(timed[:2]), timed[2:]) == ([(0, 0), (1, 1)], [(0, 2)])


def test_unfolded_items_keep_their_own_committable(spark):
    df = log(spark, [(0, 4, 1)], "int")
    items = F.array(F.struct(F.lit(1).alias("v"), F.lit(9).cast("bigint").alias("to")), F.struct(F.lit(2).alias("v"), F.lit(None).cast("bigint").alias("to")))
    assert [(r.item.v, r.next_offset) for r in df.transform(steps.unfold(items, own="to")).orderBy("position").collect()] == [(1, 9), (2, 5)]
