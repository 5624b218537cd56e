"""Language identification by a bidirectional gated recurrent network over bytes.

A text is cut into segments of ``SEGMENT`` bytes. In each segment one network of gated recurrent units
runs forwards and one backwards; both states together label every byte position, and the probabilities of
all positions of a document are averaged. The network is trained in numpy by backpropagation through time
on a bounded, documented sample: at most ``per_language`` labelled documents of each language and
``segments`` segments of each. Units use x / (1 + |x|) in place of tanh and its shifted half as gate.

A null text, or one without a letter, is ``und`` with score 0. Documents without a language or with a null
text are not learned from. If nothing can be learned (no labelled rows) every document is ``und``. Every
input row gives one row, repeated ids included; ties between languages go to the first in code point order.
Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from stationcast.llm.common import flat_text, slices, texts

SEGMENT = 64
WIDTH = 8
PER_LANGUAGE = 400
SEGMENTS = 6
STEPS = 500
BATCH = 2048
UNKNOWN = "und"


def _squash(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.abs(x))


def _slope(y: np.ndarray) -> np.ndarray:
    """Derivative of ``_squash`` from its value."""
    return (1 - np.abs(y)) ** 2


def new_model(labels: list[str], seed: int = 1, width: int = WIDTH) -> dict:
    rng = np.random.default_rng(seed)
    n = len(labels)
    model = {"labels": labels, "out": rng.normal(0, 0.3, (n, 2 * width)).astype("f4"), "bias": np.zeros((n, 1), "f4")}
    for side in ("forward", "backward"):
        # Row 256 is the pad byte. Rows of a matrix: gate z, gate r, candidate.
        model[side] = {
            "bytes": rng.normal(0, 0.5, (3 * width, 257)).astype("f4"),
            "state": rng.normal(0, 0.4, (3 * width, width)).astype("f4"),
        }
    return model


def _states(net: dict, x: np.ndarray, keep: bool = False):
    """States after each row of ``x`` (steps, batch); with ``keep`` also what the way back needs."""
    steps, batch = x.shape
    width = net["state"].shape[1]
    h = np.zeros((width, batch), "f4")
    a, g = np.empty((3 * width, batch), "f4"), np.empty((3 * width, batch), "f4")
    states, kept = np.empty((steps, width, batch), "f4"), []
    for t in range(steps):
        np.take(net["bytes"], x[t], axis=1, out=g, mode="clip")
        np.dot(net["state"], h, out=a)
        gates = a[: 2 * width] + g[: 2 * width]
        gates /= 1 + np.abs(gates)
        half = gates * 0.5
        half += 0.5
        inner = a[2 * width :]
        cand = half[width:] * inner
        cand += g[2 * width :]
        cand /= 1 + np.abs(cand)
        if keep:
            kept.append((h, gates, half, inner.copy(), cand))
        h = cand + half[:width] * (h - cand)
        states[t] = h
    return states, kept


def _grow_back(net: dict, x: np.ndarray, kept: list, outside: np.ndarray) -> dict:
    """Gradients of one direction; ``outside`` has the gradient of every state."""
    steps, batch = x.shape
    width = net["state"].shape[1]
    d_bytes, d_state = np.zeros_like(net["bytes"]), np.zeros_like(net["state"])
    back = np.zeros((width, batch), "f4")
    pre = np.empty((3 * width, batch), "f4")
    for t in range(steps - 1, -1, -1):
        h, gates, half, inner, cand = kept[t]
        d = outside[t] + back
        z, r = half[:width], half[width:]
        d_cand = d * (1 - z) * _slope(cand)
        d_inner = d_cand * r
        pre[:width] = d * (h - cand) * 0.5 * _slope(gates[:width])
        pre[width : 2 * width] = d_cand * inner * 0.5 * _slope(gates[width:])
        pre[2 * width :] = d_cand
        for row in range(3 * width):
            d_bytes[row] += np.bincount(x[t], pre[row], 257)
        pre[2 * width :] = d_inner
        d_state += pre @ h.T
        back = d * z + net["state"].T @ pre
    return {"bytes": d_bytes, "state": d_state}


def position_probabilities(model: dict, x: np.ndarray) -> np.ndarray:
    """Probabilities (steps, labels, batch) of segments ``x`` (steps, batch) with pad byte 256."""
    ahead, _ = _states(model["forward"], x)
    behind, _ = _states(model["backward"], x[::-1])
    width = ahead.shape[1]
    p = np.matmul(model["out"][:, :width], ahead)
    p += np.matmul(model["out"][:, width:], behind[::-1])
    p += model["bias"]
    p -= p.max(axis=1, keepdims=True)
    np.exp(p, out=p)
    p /= p.sum(axis=1, keepdims=True)
    return p


def train(samples: list[tuple[bytes, str]], steps: int = STEPS, batch: int = 256, seed: int = 1) -> dict | None:
    """Fit on (segment, language) pairs with Adam; the same samples give the same model."""
    labels = sorted({lang for _, lang in samples})
    if not labels:
        return None
    model = new_model(labels, seed)
    rng = np.random.default_rng(seed)
    x = np.full((len(samples), SEGMENT), 256, np.intp)
    for i, (segment, _) in enumerate(samples):
        x[i, : len(segment)] = np.frombuffer(segment, "u1")
    y = np.array([labels.index(lang) for _, lang in samples])
    by_label = [np.flatnonzero(y == k) for k in range(len(labels))]
    flat = {"out": (model, "out"), "bias": (model, "bias")} | {
        (side, part): (model[side], part) for side in ("forward", "backward") for part in ("bytes", "state")
    }
    moments = {k: (np.zeros_like(d[p]), np.zeros_like(d[p])) for k, (d, p) in flat.items()}
    for step in range(1, steps + 1):
        rows = np.concatenate([rng.choice(ids, max(1, batch // len(labels))) for ids in by_label])
        seg = np.ascontiguousarray(x[rows].T)
        back = np.ascontiguousarray(seg[::-1])
        ahead, kept_a = _states(model["forward"], seg, keep=True)
        behind, kept_b = _states(model["backward"], back, keep=True)
        both = np.concatenate([ahead, behind[::-1]], axis=1)
        p = np.matmul(model["out"], both) + model["bias"]
        p = np.exp(p - p.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        real = (seg < 256)[:, None, :]
        p[:, y[rows], np.arange(len(rows))] -= 1
        p *= real / max(1, real.sum())
        width = ahead.shape[1]
        d_both = np.matmul(model["out"].T, p)
        forward = _grow_back(model["forward"], seg, kept_a, d_both[:, :width])
        backward = _grow_back(model["backward"], back, kept_b, d_both[::-1, width:])
        grads = {"out": np.einsum("tlb,thb->lh", p, both), "bias": p.sum(axis=(0, 2))[:, None]}
        grads |= {("forward", k): v for k, v in forward.items()} | {("backward", k): v for k, v in backward.items()}
        rate = 0.02 * min(1.0, 2.0 * (1 - step / (steps + 1)))
        for k, (d, name) in flat.items():
            m, v = moments[k]
            m += 0.1 * (grads[k] - m)
            v += 0.01 * (grads[k] ** 2 - v)
            d[name] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype("f4")
    return model


def document_probabilities(model: dict, bodies: list[bytes]) -> np.ndarray:
    """Mean probability of every label over all positions of each text (not empty)."""
    lengths = np.array([len(b) for b in bodies])
    counts = -(-lengths // SEGMENT)
    padded = np.full(int(counts.sum()) * SEGMENT, 256, np.int16)
    at = 0
    for body, n in zip(bodies, counts.tolist()):
        padded[at : at + len(body)] = np.frombuffer(body, "u1")
        at += n * SEGMENT
    segments = padded.reshape(-1, SEGMENT)
    owner = np.repeat(np.arange(len(bodies)), counts)
    total = np.zeros((len(bodies), len(model["labels"])))
    for start in range(0, len(segments), BATCH):
        x = np.ascontiguousarray(segments[start : start + BATCH].T).astype(np.intp)
        p = position_probabilities(model, x)
        p *= (x < 256)[:, None, :]
        np.add.at(total, owner[start : start + BATCH], p.sum(axis=0).T.astype("f8"))
    return total / lengths[:, None]


def labelled_segments(
    docs: DataFrame, learn_from: Column, per_language: int = PER_LANGUAGE, segments: int = SEGMENTS
) -> list[tuple[bytes, str]]:
    """A bounded sample of segments: ids are drawn first (by digest), only their texts are read again.

    A drawn id gives the text with the smallest digest of each language, so the driver gets at most
    ``per_language * segments * SEGMENT`` bytes a language.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    usable = rows.where(learn_from & F.col("lang").isNotNull() & (F.length("text") > 0))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = usable.select("doc_id", "lang").distinct().withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_language)
    drawn = usable.join(F.broadcast(chosen.select("doc_id", "lang")), ["doc_id", "lang"])
    drawn = drawn.groupBy("doc_id", "lang").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("m")).select("doc_id", "lang", "m.text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, lang, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "lang", "text"))):
                body = text.encode()
                n = -(-len(body) // SEGMENT)
                rng = np.random.default_rng(abs(doc or 0))
                for k in rng.choice(n, min(n, segments), replace=False).tolist():
                    out.append((doc, body[k * SEGMENT : (k + 1) * SEGMENT], lang))
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.string()))],
                ["doc_id", "segment", "lang"],
            )

    found = drawn.select("doc_id", "lang", "text").mapInArrow(cut, "doc_id long, segment binary, lang string")
    return [(bytes(r.segment), r.lang) for r in found.orderBy("lang", "doc_id", "segment").collect()]


def label_texts(text: pa.Array, model: dict | None) -> tuple[np.ndarray, np.ndarray]:
    """Language and score of every text."""
    letters = pc.match_substring_regex(text, r"\pL").to_numpy(zero_copy_only=False)
    lang, score = np.full(len(text), UNKNOWN, object), np.zeros(len(text))
    rows = np.flatnonzero(letters) if model else []
    if len(rows):
        bodies = text.take(pa.array(rows)).cast(pa.binary()).to_pylist()
        p = document_probabilities(model, bodies)
        best = p.argmax(axis=1)
        lang[rows] = np.array(model["labels"], object)[best]
        score[rows] = np.clip(p[np.arange(len(rows)), best], 0, 1)
    return lang, score


def predict(df: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, lang_pred and score for every row of ``df`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                lang, score = label_texts(flat_text(part), model)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"]
                )

    return texts(df).mapInArrow(run, "doc_id long, lang_pred string, score double")


def recognised(df: DataFrame, model: dict | None, least_score: float) -> DataFrame:
    """Rows of ``df`` (all its columns) with a language and at least this score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                lang, score = label_texts(flat_text(part), model)
                yield part.filter(pa.array((lang != UNKNOWN) & (score >= least_score)))

    return df.mapInArrow(run, df.schema)
