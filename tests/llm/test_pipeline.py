import zlib

import brute
import numpy as np
import public_tokenizers
import pyarrow as pa
from test_dedup import expected_lines
from tokenizers import Tokenizer

import corpus_pipeline
from millrace.llm import quality, secrets

DATA = "/root/testdata/sf0.001"


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "line_dedup", "near_dedup", "secret_scan", "packing"]
    stage = dict(corpus_pipeline.STAGES)
    now = docs
    expected = {r.doc_id: r.text for r in quality.score(docs, quality.fit(docs, labels)).filter("quality_score >= 0.7").collect()}
    now = stage["quality"](spark, now, DATA)
    assert now.columns == docs.columns
    assert {r.doc_id: r.text for r in now.collect()} == expected

    first = expected_lines(list(expected.items()))
    lost = {p for p, f in first.items() if p != f}
    texts = {d: "\n".join(x for n, x in enumerate(t.split("\n")) if (d, n) not in lost) for d, t in expected.items()}
    expected = {d: t for d, t in texts.items() if t.strip(" ") or not any(p[0] == d for p in lost)}
    now = stage["line_dedup"](spark, now, DATA)
    assert {r.doc_id: r.text for r in now.collect()} == expected
    assert all(r.n_chars == len(r.text) for r in now.collect())

    group, _, _ = brute.near_groups(expected.items(), 5)
    expected = {d: t for d, t in expected.items() if group[d] == d}
    now = stage["near_dedup"](spark, now, DATA)
    assert {r.doc_id: r.text for r in now.collect()} == expected

    models = secrets.train(secrets.labelled_samples())
    for d, t in expected.items():
        spans = secrets.base_spans(t)
        expected[d] = secrets.redacted(t, sorted([*spans, *secrets.model_spans(t, spans, models)]))
    now = stage["secret_scan"](spark, now, DATA)
    assert {r.doc_id: r.text for r in now.collect()} == expected

    tokens = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = stage["packing"](spark, now, DATA).collect()
    for d, t in expected.items():
        ids = np.array([*tokens.encode(t, add_special_tokens=False).ids, 0], "<u4")
        own = sorted((p for p in out if p.doc_id == d), key=lambda p: p.start)
        assert [p.ids_crc32 for p in own] == [zlib.crc32(ids[p.start : p.start + p.length].tobytes()) for p in own]
        assert sum(p.length for p in own) == len(ids)
    # windows hold at most 1024 ids, and offsets go from 0 without gaps
    for window in {p.sequence_id for p in out}:
        own = sorted((p.offset, p.length) for p in out if p.sequence_id == window)
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))]
        assert sum(n for _, n in own) <= 1024


def test_run_and_empty(spark, tmp_path):
    assert corpus_pipeline.run(spark, DATA).count() > 0
    for name in ("documents", "labels"):
        spark.read.parquet(f"{DATA}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_idle_workers_hold_little(spark):
    # what a scan's worker freed went back: a worker that waits holds no more than some 100 MB of its own
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    secrets.scan(docs, redact=True).write.format("noop").mode("overwrite").save()

    def held(batches):
        for _ in batches:
            pass
        own = sum(int(x.split()[1]) for x in open("/proc/self/smaps_rollup") if x.startswith("Private_Dirty"))
        yield pa.RecordBatch.from_arrays([pa.array([own // 1024])], ["mb"])

    most = max(r.mb for r in spark.range(0, 8, 1, 4).mapInArrow(held, "mb bigint").collect())
    print("held", most)
    assert most < 110
