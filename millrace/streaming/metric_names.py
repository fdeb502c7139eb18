"""Names of the metrics that consumers and producers of such logs report, and what gives each of them here."""

from __future__ import annotations

# Metric names, without the application's prefix.
NAMES = """
strategies.run_task_with_multiprocessing.batch.size.msg
strategies.run_task_with_multiprocessing.batch.size.bytes
strategies.run_task_with_multiprocessing.batch.submit.time
strategies.run_task_with_multiprocessing.output_batch.size.msg
strategies.run_task_with_multiprocessing.output_batch.size.bytes
consumer.run.count
consumer.invalid_message.count
strategies.reduce.batch_time
strategies.run_task_with_multiprocessing.batch.backpressure
strategies.run_task_with_multiprocessing.batch.input.overflow
strategies.run_task_with_multiprocessing.batch.output.overflow
strategies.run_task_with_multiprocessing.batch.input.resize
strategies.run_task_with_multiprocessing.batch.output.resize
strategies.run_task_with_multiprocessing.batches_in_progress
strategies.run_task_with_multiprocessing.processes
strategies.run_task_with_multiprocessing.pool.create
consumer.poll.time
consumer.processing.time
consumer.backpressure.time
consumer.dlq.time
consumer.join.time
consumer.callback.time
consumer.shutdown.time
consumer.run.callback
consumer.run.close_strategy
consumer.run.create_strategy
consumer.partitions_revoked.count
consumer.partitions_assigned.count
consumer.latency
consumer.pause
consumer.resume
consumer.stuck
consumer.librdkafka.total_queue_size
processing.strategies.healthcheck.touch
strategies.filter.dropped_messages
consumer.dlq.dropped_messages
consumer.commit_status
consumer.dlq_buffer.len
consumer.dlq_buffer.exceeded
consumer.dlq_buffer.assigned_partitions
producer.librdkafka.p99_int_latency
producer.librdkafka.p99_outbuf_latency
producer.librdkafka.p99_rtt
producer.produce_status
producer.librdkafka.message_count
producer.librdkafka.message_size
producer.callback_latency
producer.librdkafka.message_count_max
producer.librdkafka.message_size_max
producer.librdkafka.reply_queue_size
producer.librdkafka.broker_txerrs
producer.librdkafka.broker_txretries
producer.worker.poll
strategies.run_task.join.backpressure
strategies.buffer.join.backpressure
""".split()

#: What a micro-batch's progress calls some of them (durationMs keys, or the listener's own counters).
FROM_PROGRESS = {
    "consumer.run.count": "batch.rows",
    "consumer.poll.time": "batch.latestOffset",
    "consumer.processing.time": "batch.addBatch",
    "consumer.callback.time": "batch.commitOffsets",
    "consumer.run.create_strategy": "batch.queryPlanning",
    "consumer.latency": "millrace.latency_seconds",
    "consumer.stuck": "query.stuck",
}
