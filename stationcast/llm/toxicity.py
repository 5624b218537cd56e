"""Toxicity by a convolutional text classifier over hashed word embeddings.

A word is the sum of two hashed embeddings: of the lower-cased word and of its first four letters. Filters
of widths 1, 2 and 3 run over the words of a text, each is pooled to its maximum over the whole text, and
a linear layer gives the logit. Only the words under a maximum get a gradient, so training in numpy is
cheap. The first two coordinates of the embeddings start at the log odds of the labels among texts with that word or stem.

``learn`` takes every labelled row. Their hashed words are written once, rows that repeat an id or a text included.
Counts are Spark aggregates over all of them. An epoch is one pass of all tasks: each trains a copy of the model on its
rows, in batches as they come, and the changes are averaged, those of an embedding over the tasks that changed it. A task gets
about ``SHARD_ROWS`` rows, so small tables are trained in one task, step by step. The driver holds the tables of the model and
histograms, whose sizes do not depend on the number of rows.

Class 0 is weighed in the gradient so that both classes together count as their true share, but within 1 / ``MOST_WEIGHT`` to
``MOST_WEIGHT``, where a few rows would otherwise outweigh a step. Thresholds take the true share.

Thresholds are calibrated by language. The language is never read when scoring: hashed words give it by
naive Bayes, whose counts come from the same rows. Each language's best threshold on the held-back fifth
of the rows, logits in steps of 1 / ``GRID``, is moved to 0.5 by a shift of the logit.

``train`` does the same in one process for a list of rows, such as ``labelled_texts`` draws with a bound per class.

Null and empty texts have no words: they are pooled to zeros and get the score of the bias. Without
labelled rows every score is 0. Every input row gives one row, repeated ids included; extra columns are
not read. Texts are handled in blocks of words, however long they are.
"""

from __future__ import annotations

import copy
import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from stationcast.llm.common import flat_text, key_filter, may_hold, offsets_of, slices, stored, texts

WORDS = 1 << 18
STEMS = 1 << 16
STEM = 4
DIM = 8
FILTERS = 8
WIDTHS = (1, 2, 3)
PER_CLASS = 1500
EPOCHS = 4
MOST_WEIGHT = 10.0
PRIOR = 3.0
ENOUGH = 15
BLOCK = 1 << 16
SHARD_ROWS = 4096
BATCH = 32
GRID = 1024
# Arrays of counts that a task holds before it gives them away.
MOST_SUMS = 64
# Logits beyond this count as this in the histograms of thresholds.
WIDEST = 64
TRIM = string.punctuation + "«»“”„’‘…–—"


def word_features(words: list[str]) -> np.ndarray:
    """(n, 2): rows of the word table and of the stem table."""
    out = np.zeros((len(words), 2), np.int64)
    for i, raw in enumerate(words):
        word = raw.strip(TRIM)
        out[i, 0] = zlib.crc32(word.encode()) % WORDS
        out[i, 1] = zlib.crc32(b"^" + word[:STEM].encode()) % STEMS
    return out


def split_words(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of the distinct words, code of every word, and where each text starts."""
    lists = pc.ascii_split_whitespace(pc.utf8_lower(text))
    words, offsets = lists.flatten(), offsets_of(lists)
    real = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    offsets = np.concatenate([[0], np.cumsum(real)])[offsets]
    words = words.filter(pa.array(real)).dictionary_encode()
    return word_features(words.dictionary.to_pylist()), words.indices.to_numpy(), offsets


def new_model(seed: int = 1) -> dict:
    rng = np.random.default_rng(seed)
    return {
        "word": rng.normal(0, 0.02, (WORDS, DIM)), "stem": rng.normal(0, 0.02, (STEMS, DIM)),
        "conv": {w: rng.normal(0, 0.5, (w, DIM, FILTERS)) for w in WIDTHS},
        "conv_bias": {w: np.full(FILTERS, 0.05) for w in WIDTHS},
        "out": rng.normal(0, 0.3, len(WIDTHS) * FILTERS), "bias": np.array([-1.0]),
        "languages": [], "language_words": None, "shift": np.zeros(0), "fitted": False,
    }


def _pool(model: dict, vectors: np.ndarray, codes: np.ndarray, owner: np.ndarray, docs: int, where: bool = False):
    """Largest activation of every filter per text (0 without words); with ``where`` also the word it starts at.

    ``vectors`` (DIM, distinct words) is column-wise, so that the maxima run over contiguous memory.
    """
    pooled = np.zeros((len(WIDTHS) * FILTERS, docs), vectors.dtype)
    at = np.full(pooled.shape, -1)
    for start in range(0, len(codes), BLOCK):
        # A filter that starts in this block may end behind it.
        end = min(len(codes), start + BLOCK)
        own = owner[start : end + max(WIDTHS) - 1]
        words = np.take(vectors, codes[start : end + max(WIDTHS) - 1], axis=1)
        n = end - start
        firsts = np.flatnonzero(np.concatenate([[True], own[1:n] != own[: n - 1]]))
        docs_here = own[firsts]
        for k, width in enumerate(WIDTHS):
            conv = model["conv"][width].astype(vectors.dtype)
            act = conv[0].T @ words[:, :n]
            for o in range(1, width):
                m = min(n, len(own) - o)
                act[:, :m] += (conv[o].T @ words[:, o : o + m]) * (own[o : o + m] == own[:m])
            act += model["conv_bias"][width][:, None].astype(vectors.dtype)
            part = slice(k * FILTERS, (k + 1) * FILTERS)
            if where:
                for doc, a, b in zip(docs_here, firsts, [*firsts[1:], n]):
                    best = act[:, a:b].argmax(axis=1)
                    value = act[np.arange(FILTERS), a + best]
                    better = value > pooled[part, doc]
                    pooled[part, doc] = np.where(better, value, pooled[part, doc])
                    at[part, doc] = np.where(better, start + a + best, at[part, doc])
            else:
                best = np.maximum.reduceat(act, firsts, axis=1)
                pooled[part, docs_here] = np.maximum(pooled[part, docs_here], best)
    return (pooled.T, at.T) if where else pooled.T


def _vectors(model: dict, features: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray((model["word"][features[:, 0]] + model["stem"][features[:, 1]]).T)


def logits(model: dict, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Logit before calibration and language number of every text."""
    return _logits(model, *split_words(text))


def _logits(model: dict, features: np.ndarray, codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    docs = len(offsets) - 1
    owner = np.repeat(np.arange(docs), np.diff(offsets))
    pooled = _pool(model, _vectors(model, features).astype("f4"), codes, owner, docs)
    z = pooled @ model["out"] + model["bias"][0]
    if not model["languages"]:
        return z, np.zeros(docs, int)
    votes = np.zeros((docs, len(model["languages"])))
    per_word = model["language_words"][features[:, 0]]
    for k in range(votes.shape[1]):
        votes[:, k] = np.bincount(owner, per_word[codes, k], docs) if len(codes) else 0
    return z, votes.argmax(axis=1)


def _start_from_counts(model: dict, counts: dict[str, np.ndarray], total: list[int]) -> None:
    """First coordinates of the embeddings: smoothed log odds of texts with the word, and with the stem.

    ``counts``: of each table, the texts of either label that hold the entry; ``total``: all texts of either label.
    """
    total = [max(1, t) for t in total]
    for column, table in enumerate(("word", "stem")):
        rate = [(counts[table][k] / total[k] * min(total) + PRIOR) / (min(total) + 2 * PRIOR) for k in (0, 1)]
        model[table][:, column] += np.log(rate[1] / rate[0])
    for conv in model["conv"].values():
        conv[0, :2, : FILTERS // 2] = np.abs(conv[0, :2, : FILTERS // 2])


DENSE = ["out", "bias"] + [(p, w) for p in ("conv", "conv_bias") for w in WIDTHS]
TABLES = {"word": WORDS, "stem": STEMS}


def _dense(model: dict, name) -> np.ndarray:
    return model[name] if isinstance(name, str) else model[name[0]][name[1]]


def _new_state(model: dict) -> dict:
    """Moments of the dense parts, squared gradients of the embeddings, steps done."""
    return {
        "moments": {n: (np.zeros_like(_dense(model, n)), np.zeros_like(_dense(model, n))) for n in DENSE},
        "seen": {t: np.full((size, 1), 1e-6) for t, size in TABLES.items()}, "step": 0,
    }


def _step(model: dict, state: dict, features: np.ndarray, codes: np.ndarray, owner: np.ndarray, y: np.ndarray, weight: float):
    """One gradient step on a batch of texts; returns the entries of both tables that it moved."""
    vectors = _vectors(model, features)
    pooled, at = _pool(model, vectors, codes, owner, len(y), where=True)
    p = 1 / (1 + np.exp(-(pooled @ model["out"] + model["bias"][0])))
    d = (p - y) * np.where(y == 1, 1.0, weight) / len(y)
    grads = {"out": pooled.T @ d, "bias": np.array([d.sum()])}
    d_pool = d[:, None] * model["out"]
    moved, steps = [np.zeros(0, int)], [np.zeros((0, DIM))]
    for k, width in enumerate(WIDTHS):
        conv, g, gb = model["conv"][width], np.zeros_like(model["conv"][width]), np.zeros(FILTERS)
        for f in range(FILTERS):
            col = k * FILTERS + f
            live = np.flatnonzero(at[:, col] >= 0)
            gb[f] += d_pool[live, col].sum()
            for o in range(width):
                pos = at[live, col] + o
                ok = pos < len(owner)
                pos, docs = pos[ok], live[ok]
                same = owner[pos] == docs
                pos, docs = pos[same], docs[same]
                dd = d_pool[docs, col]
                g[o, :, f] += vectors[:, codes[pos]] @ dd
                moved.append(codes[pos])
                steps.append(dd[:, None] * conv[o, :, f])
        grads["conv", width], grads["conv_bias", width] = g, gb
    state["step"] += 1
    for n in DENSE:
        m, v = state["moments"][n]
        m += 0.1 * (grads[n] - m)
        v += 0.01 * (grads[n] ** 2 - v)
        _dense(model, n)[...] -= 0.01 * (m / (1 - 0.9 ** state["step"])) / (np.sqrt(v / (1 - 0.99 ** state["step"])) + 1e-8)
    moved, steps, touched = np.concatenate(moved), np.concatenate(steps), []
    for column, table in enumerate(TABLES):
        entries, place = np.unique(features[moved, column], return_inverse=True)
        g = np.zeros((len(entries), DIM))
        np.add.at(g, place, steps)
        state["seen"][table][entries] += (g**2).mean(axis=1, keepdims=True)
        model[table][entries] -= 0.1 * g / np.sqrt(state["seen"][table][entries])
        touched.append(entries)
    return touched


def _fit(model: dict, rows: list[tuple[str, int]], weight: float, epochs: int, seed: int) -> None:
    rng = np.random.default_rng(seed)
    state = _new_state(model)
    prepared = [split_words(pa.array([t])) for t, _ in rows]
    y_all = np.array([y for _, y in rows], float)
    counts = {t: np.zeros((2, size)) for t, size in TABLES.items()}
    for (features, _, _), label in zip(prepared, y_all.astype(int)):
        for column, table in enumerate(TABLES):
            counts[table][label, np.unique(features[:, column])] += 1
    _start_from_counts(model, counts, [int((y_all == k).sum()) for k in (0, 1)])
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for start in range(0, len(rows), BATCH):
            ids = order[start : start + BATCH]
            sizes = [len(prepared[i][0]) for i in ids]
            features = np.concatenate([prepared[i][0] for i in ids])
            codes = np.concatenate([prepared[i][1] + b for i, b in zip(ids, np.cumsum([0, *sizes[:-1]]))]).astype(int)
            owner = np.repeat(np.arange(len(ids)), [len(prepared[i][1]) for i in ids])
            _step(model, state, features, codes, owner, y_all[ids], weight)


def train(rows: list[tuple[str, int, str | None]], weight: float = 1.0, epochs: int = EPOCHS, seed: int = 1) -> dict:
    """Fit, then calibrate on every fifth document. ``rows``: (text, 0 or 1, language or null); ``weight`` of class 0."""
    model = new_model(seed)
    if not rows:
        return model
    held = [r for i, r in enumerate(rows) if i % 5 == 0]
    fitted = [r for i, r in enumerate(rows) if i % 5]
    model["languages"] = sorted({lang for _, _, lang in rows if lang})
    if model["languages"]:
        counts = np.full((WORDS, len(model["languages"])), 0.1)
        for text, _, lang in rows:
            if lang:
                features, codes, _ = split_words(pa.array([text]))
                np.add.at(counts[:, model["languages"].index(lang)], features[codes, 0], 1)
        model["language_words"] = np.log(counts / counts.sum(axis=0)).astype("f4")
    _fit(model, [(t, y) for t, y, _ in fitted or held], min(max(weight, 1 / MOST_WEIGHT), MOST_WEIGHT), epochs, seed)
    model["shift"] = np.zeros(max(1, len(model["languages"])))
    model["fitted"] = True
    z, language = logits(model, pa.array([t for t, _, _ in held]))
    y = np.array([y for _, y, _ in held])
    model["shift"][:] = best_threshold(z, y, weight)
    for k in range(len(model["shift"])):
        # A language with few documents of either class keeps the common threshold.
        own = language == k
        if min((y[own] == 0).sum(), (y[own] == 1).sum()) >= ENOUGH:
            model["shift"][k] = best_threshold(z[own], y[own], weight)
    for name in ("word", "stem"):
        model[name] = model[name].astype("f4")
    return model


def best_threshold(z: np.ndarray, y: np.ndarray, weight: float) -> float:
    """Logit with the best F1, class 0 weighed; the middle of the best gap. 0 where a class is missing."""
    if not len(y) or y.min() == y.max():
        return 0.0
    values, place = np.unique(z, return_inverse=True)
    return best_cut(values, np.bincount(place, y), np.bincount(place, 1 - y) * weight)


def best_cut(z: np.ndarray, ones: np.ndarray, zeros: np.ndarray) -> float:
    """The same for rising distinct logits and how many texts of either class have each."""
    if not ones.sum() or not zeros.sum():
        return 0.0
    hits = ones.sum() - np.concatenate([[0], np.cumsum(ones)])
    wrong = zeros.sum() - np.concatenate([[0], np.cumsum(zeros)])
    f1 = 2 * hits / np.maximum(hits + wrong + ones.sum(), 1e-9)
    cuts = np.concatenate([[z[0] - 2], (z[1:] + z[:-1]) / 2, [z[-1] + 2]])
    best = np.flatnonzero(f1 >= f1.max() - 1e-12)
    # Among equally good cuts: the one in the middle of the widest gap.
    edges = np.concatenate([[z[0] - 4], z, [z[-1] + 4]])
    return float(cuts[best[np.argmax(np.diff(edges)[best])]])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every word of a text as one number: its entry of the word table, then that of the stem table."""
    for batch in batches:
        for part in slices(batch, "text"):
            features, codes, offsets = split_words(flat_text(part))
            packed = (features[:, 0] * STEMS + features[:, 1])[codes]
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(packed))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("toxic", "lang", "held")), lists], ["toxic", "lang", "held", "words"])


def _words_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What ``split_words`` gave, from stored words."""
    lists = batch.column("words")
    packed, codes = np.unique(lists.flatten().to_numpy(), return_inverse=True)
    return np.stack([packed // STEMS, packed % STEMS], axis=1), codes, offsets_of(lists)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of either label by table entry (kinds word and stem) and words by language (kind lang)."""
    sums: dict[tuple[str, str], np.ndarray] = {}

    def held_so_far() -> Iterator[pa.RecordBatch]:
        for (kind, name), n in sums.items():
            at = np.flatnonzero(n)
            columns = [pa.array([x] * len(at), pa.string()) for x in (kind, name)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(at.astype(np.int32)), pa.array(n[at])], ["kind", "name", "at", "n"])
        sums.clear()

    for batch in batches:
        features, codes, offsets = _words_of(batch)
        owner = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
        y = batch.column("toxic").to_numpy()
        names, lang = np.unique(np.array([x or "" for x in batch.column("lang").to_pylist()], object), return_inverse=True)
        fitted = ~batch.column("held").to_numpy(zero_copy_only=False)[owner]
        for column, (table, size) in enumerate(TABLES.items()):
            once = np.unique(owner[fitted] * size + features[codes[fitted], column])
            for k in (0, 1):
                of = sums.setdefault((table, str(k)), np.zeros(size, np.int64))
                of += np.bincount(once[y[once // size] == k] % size, minlength=size)
        for k, name in enumerate(names):
            if name:
                of = sums.setdefault(("lang", name), np.zeros(WORDS, np.int64))
                of += np.bincount(features[codes[lang[owner] == k], 0], minlength=WORDS)
                if len(sums) > MOST_SUMS:
                    yield from held_so_far()
    yield from held_so_far()


_CHANGE = [f"d{i}" for i in range(DIM + 1)]


def _epoch(sent, weight: float, seed: int):
    """One task's pass over its rows from the common model. Gives (part, at, n, d0..): ``n`` times the change of each number.

    Part 0 holds the dense numbers with their moments, parts 1 and 2 the entries of the tables with their squared gradients.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, kept = sent.value
        # The tables are copied, the small parts too: the broadcast value serves other tasks of the worker.
        model, state = copy.deepcopy(before), copy.deepcopy(kept)
        touched, rng, n = [[], []], np.random.default_rng(seed), 0
        for batch in batches:
            features, codes, offsets = _words_of(batch)
            y, order = batch.column("toxic").to_numpy().astype(float), rng.permutation(batch.num_rows)
            n += batch.num_rows
            for start in range(0, len(order), BATCH):
                ids = order[start : start + BATCH]
                sizes = offsets[ids + 1] - offsets[ids]
                held = np.concatenate([codes[offsets[i] : offsets[i + 1]] for i in ids])
                used, held = np.unique(held, return_inverse=True)
                moved = _step(model, state, features[used], held, np.repeat(np.arange(len(ids)), sizes), y[ids], weight)
                for all_, entries in zip(touched, moved):
                    all_.append(entries)
        if not n:
            return
        parts = [(0, np.arange(len(_flat_dense(before, kept))), _flat_dense(model, state) - _flat_dense(before, kept))]
        for k, table in enumerate(TABLES):
            at = np.unique(np.concatenate(touched[k]))
            change = [model[table][at] - before[table][at], state["seen"][table][at] - kept["seen"][table][at]]
            parts.append((k + 1, at, np.concatenate(change, axis=1)))
        for part, at, change in parts:
            wide = np.zeros((len(at), DIM + 1))
            wide[:, : change.shape[1]] = change * n
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), part, np.int32)), pa.array(at.astype(np.int32)), pa.array(np.full(len(at), n)), *map(pa.array, np.ascontiguousarray(wide.T))],
                ["part", "at", "n", *_CHANGE],
            )

    return run


def _flat_dense(model: dict, state: dict) -> np.ndarray:
    """(numbers, 3): all dense numbers with both moments."""
    return np.stack([np.concatenate([x.ravel() for x in xs]) for xs in zip(*((_dense(model, n), *state["moments"][n]) for n in DENSE))], axis=1)


def _apply(model: dict, state: dict, changes: pa.Table) -> None:
    """Add the mean changes of all tasks. They are cut to single precision, so that the order of sums does not show."""
    part, at, n = (changes.column(c).to_numpy() for c in ("part", "at", "n"))
    mean = (np.stack([changes.column(c).to_numpy() for c in _CHANGE], axis=1) / n[:, None]).astype("f4").astype(float)
    dense = np.zeros_like(_flat_dense(model, state))
    dense[at[part == 0]] = mean[part == 0][:, :3]
    start = 0
    for name in DENSE:
        numbers = (_dense(model, name), *state["moments"][name])
        for k, x in enumerate(numbers):
            x += dense[start : start + x.size, k].reshape(x.shape)
        start += numbers[0].size
    for k, table in enumerate(TABLES):
        own = part == k + 1
        model[table][at[own]] += mean[own][:, :DIM]
        state["seen"][table][at[own]] += mean[own][:, DIM:]


def _histogram(sent):
    """How many texts of either class have a logit, by language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z, language = _logits(sent.value, *_words_of(batch))
            place = np.rint(np.clip(z, -WIDEST, WIDEST) * GRID).astype(np.int64)
            columns = [pa.array(language.astype(np.int32)), pa.array(place), batch.column("toxic")]
            yield pa.RecordBatch.from_arrays(columns, ["language", "place", "toxic"])

    return run


def labelled_rows(spark: SparkSession, docs: DataFrame, labels: DataFrame, learn_from: Column) -> DataFrame:
    """toxic, lang, held and text of every labelled row with a text. ``held`` is true for about one id in five.

    Texts are dealt by id at any size, so that what is exchanged grows with the rows and not in a step where the labels
    get too large to be broadcast.
    """
    marks = labels.where(learn_from & F.col("toxic").isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    near = may_hold(rows.where("text is not null"), ["doc_id"], key_filter(spark, marks.select("doc_id"))).where("may_hold")
    order = F.xxhash64("doc_id")
    held = F.pmod(F.xxhash64("doc_id", F.lit("held")), F.lit(5)) == 0
    found = near.join(marks.hint("merge"), "doc_id").select("doc_id", "text", "lang", "toxic", held.alias("held"))
    return found.sortWithinPartitions(order, "doc_id", "toxic", "text", "lang").select("toxic", "lang", "held", "text")


def labelled_words(spark: SparkSession, docs: DataFrame, labels: DataFrame, learn_from: Column) -> DataFrame:
    """toxic, lang, held and hashed words of every labelled row with a text, written once."""
    found = labelled_rows(spark, docs, labels, learn_from)
    return stored(spark, found.mapInArrow(_hashed, "toxic int, lang string, held boolean, words array<long>"), "labelled")


def learn(
    spark: SparkSession, docs: DataFrame, labels: DataFrame, learn_from: Column, epochs: int = EPOCHS, seed: int = 1, shard_rows: int = SHARD_ROWS
) -> dict:
    """The model of all rows of ``docs`` (doc_id, text, lang) with a label in ``labels`` (doc_id, toxic) where ``learn_from`` holds."""
    model = new_model(seed)
    rows = labelled_words(spark, docs, labels, learn_from)
    sizes = {(r.held, r.toxic): r["count"] for r in rows.groupBy("held", "toxic").count().collect()}
    if not sizes:
        return model
    # Too few rows to hold some back: all are fitted, or all calibrate.
    if not any(sizes.get((False, k)) for k in (0, 1)):
        rows = rows.withColumn("held", F.lit(False))
        sizes = {(False, k): sizes.get((True, k), 0) for k in (0, 1)}
    total = [sizes.get((False, k), 0) for k in (0, 1)]
    fitted = rows.where("not held")
    calibrating = rows.where("held") if all(sizes.get((True, k)) for k in (0, 1)) else rows

    counted = rows.mapInArrow(_counted, "kind string, name string, at int, n long").groupBy("kind", "name", "at").agg(F.sum("n").alias("n")).toArrow()
    found = {(r["kind"], r["name"]) for r in counted.select(["kind", "name"]).group_by(["kind", "name"]).aggregate([]).to_pylist()}
    counts = {t: np.zeros((2, size)) for t, size in TABLES.items()}
    model["languages"] = sorted(name for kind, name in found if kind == "lang")
    words = np.full((WORDS, len(model["languages"])), 0.1)
    for kind, name in found:
        own = counted.filter(pc.and_(pc.equal(counted.column("kind"), kind), pc.equal(counted.column("name"), name)))
        at, n = own.column("at").to_numpy(), own.column("n").to_numpy()
        if kind == "lang":
            words[at, model["languages"].index(name)] += n
        else:
            counts[kind][int(name), at] = n
    if model["languages"]:
        model["language_words"] = np.log(words / words.sum(axis=0)).astype("f4")
    _start_from_counts(model, counts, total)

    ratio = total[0] / total[1] if all(total) else 1.0
    weight = min(max(ratio, 1 / MOST_WEIGHT), MOST_WEIGHT) / ratio
    state = _new_state(model)
    shards = max(1, round(sum(total) / shard_rows))
    schema = "part int, at int, n long, " + ", ".join(f"{c} double" for c in _CHANGE)
    for k in range(epochs):
        fit = {name: model[name] for name in ("word", "stem", "conv", "conv_bias", "out", "bias")}
        sent = spark.sparkContext.broadcast((fit, state))
        made = fitted.coalesce(shards).mapInArrow(_epoch(sent, weight, seed + k), schema)
        changes = made.groupBy("part", "at").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in _CHANGE]).toArrow()
        sent.destroy()
        _apply(model, state, changes)
        # The steps of a pass, for the bias of the moments; tasks have about equally many.
        state["step"] += max(1, sum(total) // (shards * BATCH))

    for name in ("word", "stem"):
        model[name] = model[name].astype("f4")
    sent = spark.sparkContext.broadcast(model)
    places = calibrating.mapInArrow(_histogram(sent), "language int, place long, toxic int").groupBy("language", "place").agg(
        F.sum("toxic").alias("ones"), F.sum(1 - F.col("toxic")).alias("zeros")
    )
    places = places.toArrow().sort_by("place")
    language, place, ones, zeros = (places.column(c).to_numpy() for c in ("language", "place", "ones", "zeros"))
    at, where = np.unique(place, return_inverse=True)
    model["shift"] = np.full(max(1, len(model["languages"])), best_cut(at / GRID, np.bincount(where, ones), np.bincount(where, zeros)))
    for k in range(len(model["shift"])):
        # A language with few documents of either class keeps the common threshold.
        own = language == k
        if min(ones[own].sum(), zeros[own].sum()) >= ENOUGH:
            model["shift"][k] = best_cut(place[own] / GRID, ones[own], zeros[own])
    sent.destroy()
    model["fitted"] = True
    return model


def labelled_texts(docs: DataFrame, labels: DataFrame, learn_from: Column, per_class: int = PER_CLASS) -> tuple[list, float]:
    """A bounded sample of (text, label, language) and the weight that restores the share of class 0.

    The driver gets ``2 * per_class`` whole texts at most: so many times the bytes of the longest one.
    """
    marks = labels.where(learn_from & F.col("toxic").isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).distinct()
    order = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id")
    drawn = marks.withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_class).select("doc_id", "toxic")
    totals = {r.toxic: r.n for r in marks.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    # One row per drawn id, whatever its copies: the text with the smallest digest.
    sort = F.struct(F.xxhash64("text").alias("h"), "text", "lang")
    rows = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
        .where(F.col("text").isNotNull())
        .join(F.broadcast(drawn), "doc_id")
        .groupBy("doc_id", "toxic")
        .agg(F.min(sort).alias("m"))
        .select("doc_id", "toxic", "m.text", "m.lang")
        .orderBy(F.xxhash64("doc_id"), "doc_id", "toxic", "text")
        .collect()
    )
    n = {k: max(1, sum(r.toxic == k for r in rows)) for k in (0, 1)}
    weight = (totals.get(0, 0) / n[0]) / max(1e-9, totals.get(1, 0) / n[1]) if totals.get(1) else 1.0
    return [(r.text, r.toxic, r.lang) for r in rows], weight


def score(df: DataFrame, model: dict) -> DataFrame:
    """doc_id and score for every row of ``df`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                if model["fitted"]:
                    z, language = logits(model, flat_text(part))
                    out = 1 / (1 + np.exp(-np.clip(z - model["shift"][language], -40, 40)))
                else:
                    out = np.zeros(len(part))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(out)], ["doc_id", "score"])

    return texts(df).mapInArrow(run, "doc_id long, score double")
