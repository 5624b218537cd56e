"""Token counts by a two-tier look-up of pre-tokens, without an exchange keyed by pre-token.

Pre-tokens here are the runs between ASCII white space: the tokenizer drops white space and works on each
run alone. In a first pass every task counts the pre-tokens of all its rows and passes on at most ``KEPT`` of
them; ``PARTS`` tasks and then one merge these counts, dealt evenly and not by word. Up to ``KEPT`` distinct
pre-tokens all counts are exact; beyond, the smallest make room as in Misra and Gries: any pre-token that makes
up more than one in ``KEPT`` of all is kept. Only ones above ``LONGEST_KEPT`` bytes are left to the second pass.
The ``TOP`` most frequent get their token counts from the library and are broadcast as one compact hash table.
In the second pass each task looks its distinct pre-tokens up in that table, then in a bounded cache of its
Python worker, and only what both miss is encoded. The first tier changes cost, never results.

Null text counts as empty: 0 bytes, 0 tokens. Every input row gives one row, repeated ids included; extra
columns are not read. Texts are handled in parts of a few MB, one longer text is a part of its own.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from stationcast.llm.common import flat_text, offsets_of, slices, sums_per_list, texts, worker_state

TOP = 65_536
KEPT = 4 * TOP
SAMPLE = 4_096
FILES = 32
PARTS = 16
CACHE = 400_000
LONGEST_KEPT = 64


def _split(text: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    lists = pc.ascii_split_whitespace(text)
    return lists.flatten().dictionary_encode(), offsets_of(lists)


def _added(counts: list[pa.Table]) -> pa.Table:
    """One row a word; of more than ``KEPT`` words those above the next largest count, less that count."""
    total = pa.concat_tables(counts).group_by("word").aggregate([("n", "sum")]).select(["word", "n_sum"])
    n = total.column("n_sum").to_numpy()
    if len(n) > KEPT:
        least = np.partition(n, -KEPT - 1)[-KEPT - 1]
        total, n = total.filter(pa.array(n > least)), n[n > least] - least
    return pa.table([total.column("word"), pa.array(n, pa.int64())], ["word", "n"])


def _summed(counts: Iterator[pa.Table]) -> pa.Table:
    """The sum of all ``counts``, with at most about three times ``KEPT`` rows at once."""
    held = [pa.table([pa.array([], pa.string()), pa.array([], pa.int64())], ["word", "n"])]
    for some in counts:
        held.append(some)
        if sum(map(len, held)) > 2 * KEPT:
            held = [_added(held)]
    return _added(held)


def _part_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    for batch in batches:
        for part in slices(batch, "text"):
            words, _ = _split(flat_text(part))
            n = np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary))
            short = pc.less_equal(pc.binary_length(words.dictionary), LONGEST_KEPT)
            all_words = pa.table([words.dictionary.cast(pa.string()), pa.array(n, pa.int64())], ["word", "n"])
            yield all_words.filter(short)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _summed(_part_counts(batches)).to_batches()


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _summed(pa.Table.from_batches([b]) for b in batches).to_batches()


def sampled(df: DataFrame, rows: int = SAMPLE, files: int = FILES) -> DataFrame:
    """About ``rows`` rows of ``df``, from at most ``files`` of its files: the others are not opened.

    Token counts do not use it: their first tier counts all rows.
    """
    names = df.inputFiles()
    if len(names) > files:
        drawn = sorted(names, key=lambda n: (zlib.crc32(n.encode()), n))[:files]
        # Rows name a local file with one slash.
        drawn = [re.sub("^file:/+", "file:/", n) for n in drawn]
        df = df.where(df.metadataColumn("_metadata")["file_path"].isin(drawn))
    n = df.count()
    return df.sample(min(1.0, rows / n), seed=0) if n else df


def frequent_words(df: DataFrame, top: int = TOP) -> list[str]:
    """At most ``top`` pre-tokens, the most frequent ones of all rows first, merged from one bounded summary per task."""
    counts = "word string, n long"
    found = texts(df).select("text").mapInArrow(_counted, counts).repartition(PARTS).mapInArrow(_merged, counts)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = pa.Table.from_batches(list(_merged(batches)), pa.schema([("word", pa.string()), ("n", pa.int64())]))
        yield from total.sort_by([("n", "descending"), ("word", "ascending")]).slice(0, top).to_batches()

    return [r.word for r in found.repartition(1).mapInArrow(best, counts).collect()]


def _tokenizer(spec: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(spec)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    return tokenizer


def _lengths(tokenizer, words: list[str]) -> list[int]:
    return [len(e.ids) for e in tokenizer.encode_batch(words, add_special_tokens=False)]


def count_tokens(spark: SparkSession, df: DataFrame, tokenizer_path: str, top: int = TOP) -> DataFrame:
    """doc_id, n_bytes, n_tokens for every row of ``df`` (doc_id, text)."""
    docs = texts(df)
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()
    words = frequent_words(df, top)
    lengths = _lengths(_tokenizer(spec), words)
    table = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(lengths, pa.int32())], ["word", "n"])
    sent = spark.sparkContext.broadcast((spec, table.serialize().to_pybytes(), table.schema.serialize().to_pybytes()))
    key = f"token_lengths_{abs(hash(tokenizer_path))}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spec, rows, schema = sent.value
        frequent = pa.ipc.read_record_batch(pa.py_buffer(rows), pa.ipc.read_schema(pa.py_buffer(schema)))
        known, known_n = frequent.column(0), frequent.column(1).to_numpy()
        tokenizer = worker_state(key, lambda: _tokenizer(spec))
        cache = worker_state(f"{key}_cache", dict)
        for batch in batches:
            for part in slices(batch, "text"):
                text = flat_text(part)
                words, offsets = _split(text)
                distinct = words.dictionary
                at = pc.fill_null(pc.index_in(distinct, value_set=known), -1).to_numpy(zero_copy_only=False)
                n = np.where(at >= 0, known_n[at] if len(known_n) else 0, 0).astype(np.int64)
                missing = np.flatnonzero(at < 0)
                rare = distinct.take(pa.array(missing)).to_pylist()
                got = [cache.get(w) for w in rare]
                fresh = [i for i, v in enumerate(got) if v is None]
                if fresh:
                    if len(cache) + len(fresh) > CACHE:
                        cache.clear()
                    for start in range(0, len(fresh), 20_000):
                        some = fresh[start : start + 20_000]
                        for i, k in zip(some, _lengths(tokenizer, [rare[i] for i in some])):
                            got[i] = k
                            if len(rare[i]) <= LONGEST_KEPT and len(cache) < CACHE:
                                cache[rare[i]] = k
                n[missing] = got
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pc.binary_length(text).cast(pa.int64()),
                        pa.array(sums_per_list(n[words.indices.to_numpy()], offsets)),
                    ],
                    ["doc_id", "n_bytes", "n_tokens"],
                )

    return docs.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
