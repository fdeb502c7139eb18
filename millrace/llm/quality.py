"""Quality classifier: gated-attention multiple-instance learning over the passages of a document.

A document is a bag of passages (windows of ``PASSAGE`` UTF-8 bytes). Every passage of the whole text is encoded from
the shares of its byte classes of the transitions between coarser classes, and of
repeated words, by a learned layer. Gated attention,
learned from document labels alone, weighs the passages; the weighted representation gives the score.

Training takes labelled documents whose crc32(doc_id as text) mod 4 is not 2, at most ``TRAIN_DOCS`` of them in the order
of a hash of doc_id; only their passage features reach the driver. Labels with nulls are left out, and of labels that
repeat a doc_id the least counts. Without both classes among them the score is the share of label 1 (0.5 without labels).

Rows: a null or empty text is one passage without bytes. Repeated rows and a null doc_id (never held out) are scored as
any others; an empty table gives an empty one; label, lang, source and doc_id are never read for a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import released, ship
from millrace.llm.minhash import text_chunks, word_hashes

PASSAGE, TRAIN_DOCS, HIDDEN, GATE, EPOCHS, BATCH = 600, 6000, 24, 12, 30, 256
THRESHOLD = 0.7


def _classes() -> tuple[np.ndarray, np.ndarray, int]:
    """By byte: its class (each ASCII mark its own) and its coarse class of 8."""
    fine, coarse = np.zeros(256, np.int64), np.zeros(256, np.int64)
    marks = [b for b in range(33, 127) if not chr(b).isalnum()]
    groups = [(range(ord("a"), ord("z") + 1), 0), (range(ord("A"), ord("Z") + 1), 1), (range(ord("0"), ord("9") + 1), 2), ([0x20], 3), ([0x0A], 4), (range(128, 256), 5), ([*range(10), *range(11, 32), 127], 6)]
    for members, k in groups:
        fine[list(members)] = coarse[list(members)] = k
    fine[marks] = 7 + np.arange(len(marks))
    coarse[marks] = 7
    return fine, coarse, 7 + len(marks)


_FINE, _COARSE, _KINDS = _classes()
FEATURES = _KINDS + 64 + 3


def passages(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(features by passage, each text's first passage and one more) of a text column, in chunks."""
    for _, _, data, offsets in text_chunks(column):
        sizes = np.diff(offsets)
        many = np.maximum(1, -(-sizes // PASSAGE))
        begins = np.r_[0, np.cumsum(many)]
        within = np.arange(len(data)) - np.repeat(offsets[:-1], sizes)
        own = np.repeat(begins[:-1], sizes) + within // PASSAGE
        total = int(begins[-1])
        fine = np.bincount(own * _KINDS + _FINE[data], minlength=total * _KINDS).reshape(total, _KINDS)
        coarse = _COARSE[data]
        inner = own[1:] == own[:-1]
        moves = np.bincount(own[1:][inner] * 64 + coarse[:-1][inner] * 8 + coarse[1:][inner], minlength=total * 64).reshape(total, 64)
        length = np.maximum(fine.sum(axis=1, keepdims=True), 1)
        starts, word, _ = word_hashes(data, offsets)
        home = own[starts]
        words = np.maximum(np.bincount(home, minlength=total), 1)
        again = lambda lag: np.bincount(home[lag:][(word[lag:] == word[:-lag]) & (home[lag:] == home[:-lag])], minlength=total) / words  # noqa: B023, E731
        # roots spread small shares; then the shares of words that repeat one shortly before, and the passage's length
        yield np.concatenate([np.sqrt(fine / length), np.sqrt(moves / length), again(1)[:, None], again(2)[:, None], fine.sum(axis=1, keepdims=True) / PASSAGE], axis=1).astype(np.float32), begins


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class AttentionModel:
    """Parameters: encoder (w, b), gates (v, u), attention (t), output (c, d), the features' mean and scale."""

    p: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, begins: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        starts = begins[:-1]
        x = (x - p["mean"]) * p["scale"]
        h = np.tanh(x @ p["w"] + p["b"])
        gv, gu = np.tanh(h @ p["v"]), _sigmoid(h @ p["u"])
        e = (gv * gu) @ p["t"]
        many = np.diff(begins)
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), many))
        a = e / np.repeat(np.add.reduceat(e, starts), many)
        z = np.add.reduceat(a[:, None] * h, starts)
        return {"x": x, "h": h, "gv": gv, "gu": gu, "a": a, "z": z, "score": _sigmoid(z @ p["c"] + p["d"])}

    def gradients(self, f: dict[str, np.ndarray], begins: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        p, many = self.p, np.diff(begins)
        out = (f["score"] - label) / len(label)
        dz = out[:, None] * p["c"]
        each = np.repeat(dz, many, axis=0)
        da = (each * f["h"]).sum(axis=1)
        de = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, begins[:-1]), many))
        dg = de[:, None] * p["t"]
        dv, du = dg * f["gu"] * (1 - f["gv"] ** 2), dg * f["gv"] * f["gu"] * (1 - f["gu"])
        dh = f["a"][:, None] * each + dv @ p["v"].T + du @ p["u"].T
        dx = dh * (1 - f["h"] ** 2)
        return {"w": f["x"].T @ dx, "b": dx.sum(axis=0), "v": f["h"].T @ dv, "u": f["h"].T @ du, "t": (f["gv"] * f["gu"]).T @ de, "c": f["z"].T @ out, "d": out.sum(keepdims=True)}


def train(bags: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 5, rate: float = 0.01, decay: float = 1e-4) -> AttentionModel:
    """Fit by Adam over shuffled batches of documents; the order of ``bags`` doesn't depend on partitions."""
    rng = np.random.default_rng(seed)
    every = np.concatenate(bags).astype(np.float64)
    mean, scale = every.mean(axis=0), 1 / (every.std(axis=0) + 0.05)
    shape = lambda *s: rng.standard_normal(s) / np.sqrt(s[0])
    p = {"w": shape(FEATURES, HIDDEN), "b": np.zeros(HIDDEN), "v": shape(HIDDEN, GATE), "u": shape(HIDDEN, GATE), "t": shape(GATE), "c": shape(HIDDEN), "d": np.zeros(1)}
    model = AttentionModel(p | {"mean": mean, "scale": scale})
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), BATCH):
            own = order[at : at + BATCH]
            begins = np.r_[0, np.cumsum([len(bags[i]) for i in own])]
            f = model.forward(np.concatenate([bags[i] for i in own]).astype(np.float64), begins)
            step += 1
            for k, g in model.gradients(f, begins, labels[own]).items():
                g = g + decay * p[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                model.p[k] = p[k] = p[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return model


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> AttentionModel | float:
    """The model of the labelled sample, or a constant score where it lacks a class."""
    ship(docs.sparkSession)
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs)  # the documented bound
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = [x[a:b].astype(np.float16).tobytes() for x, begins in passages(batch.column(1)) for a, b in zip(begins[:-1], begins[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(bags, pa.binary())], ["doc_id", "quality", "bag"])

    rows = texts.select("doc_id", "text", F.col("quality").cast("int").alias("quality")).mapInArrow(lambda batches: released(run(batches)), "doc_id bigint, quality int, bag binary").collect()
    rows.sort(key=lambda r: (r.doc_id, r.bag))
    marks = np.array([float(r.quality) for r in rows])
    if len(set(marks.tolist())) < 2:
        return float(marks.mean()) if len(marks) else 0.5
    return train([np.frombuffer(r.bag, np.float16).reshape(-1, FEATURES) for r in rows], marks)


def score(docs: DataFrame, model: AttentionModel | float) -> DataFrame:
    """The documents with a column ``quality_score`` from 0 to 1."""
    ship(docs.sparkSession)
    docs = docs.drop("quality_score")
    at = docs.columns.index("text")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if isinstance(model, float):
                out = np.full(batch.num_rows, model)
            else:
                out = np.concatenate([model.forward(x.astype(np.float64), begins)["score"] for x, begins in passages(batch.column(at))] or [np.empty(0)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], [*batch.schema.names, "quality_score"])

    return docs.mapInArrow(lambda batches: released(run(batches)), f"{kinds}, quality_score double")


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """By document: doc_id, held_out, score, predicted."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted"))
