"""Alignment of two tokenizers' tokens by byte ranges, with diagonal run skipping.

Both tokenizers encode the same bytes: a space and the text. Byte offsets where a token of A and a token of B
both end cut the bytes into groups. Most groups hold one token of each side, and they come in stretches in which
the end of A's token i + k equals the end of B's token j + k. From a common boundary such a stretch is skipped by
probing: slices of both end lists at the current shift j - i are compared, twice as long each time they agree,
and one by one and from short slices again once they differ. What stops the stretch is an irregular group: it is closed by stepping the
side that is behind until both ends meet, which sets a new shift.

Two tokens are linked if their byte ranges overlap; every end of a token on either side closes one such overlap.
A pair's count is the number of rows that hold it linked anywhere. The pairs of each row are stored once, their
counts come from one aggregate over (a, b), and are looked up in two tiers: pairs with large counts, at most
``frequent`` of them, are broadcast as sorted arrays; the rest is joined by (a, b), where no key is hot since
its count is below that of the broadcast ones. Both tiers are exact and together cover every pair.

Null and empty texts, and texts whose tokens do not spell the same bytes on both sides, have no tokens: zeros and
an empty digest. Every input row gives one row, repeated ids and null ids included; each counts as a document
of its own. Texts are handled in parts of a few MB, one longer text is a part of its own. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from stationcast.llm.bpe import LONGEST_KEPT, PIECES, Codec, byte_characters
from stationcast.llm.common import flat_text, slices, sums_per_list, stored, texts, worker_state

FREQUENT = 1 << 20
# Spaces, or what the piece model writes for them, and the word behind them.
RUN = re.compile("[ ▁]+[^ ▁]*")
_ROW = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
_PAIRS = "a array<int>, b array<int>, times array<int>"


def irregular(ends_a: list[int], ends_b: list[int]) -> list[int]:
    """Bounds (first and last + 1 of A, first and last + 1 of B) of all groups that are not one-to-one, in one flat list.

    Both lists rise and end alike.
    """
    n = len(ends_a)
    # Unequal last entries stop every stretch.
    a, b = [*ends_a, -1], [*ends_b, -2]
    found: list[int] = []
    i = j = 0
    while i < n:
        # A stretch of one-to-one groups: double while equal, then begin anew.
        while a[i] == b[j]:
            i, j, step = i + 1, j + 1, 4
            while a[i : i + step] == b[j : j + step]:
                i, j, step = i + step, j + step, 2 * step
        if i >= n:
            break
        # An irregular group: the side behind steps on until both ends meet.
        p, q = i, j
        x, y = a[p], b[q]
        while x != y:
            if x < y:
                p += 1
                x = a[p]
            else:
                q += 1
                y = b[q]
        found += (i, p + 1, j, q + 1)
        i, j = p + 1, q + 1
    return found


def groups(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every group the number of tokens of A, and of B, up to its end."""
    bounds = np.array(irregular(ends_a.tolist(), ends_b.tolist()), np.int64).reshape(-1, 4).T
    cuts = []
    for n, first, last in ((len(ends_a), *bounds[:2]), (len(ends_b), *bounds[2:])):
        # Inside a group only its last token ends it.
        inside = np.zeros(n + 1, np.int64)
        inside[first] += 1
        inside[last - 1] -= 1
        cuts.append(np.flatnonzero(np.cumsum(inside)[:n] == 0) + 1)
    return cuts[0], cuts[1]


def links(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (in A, in B) of all tokens whose ranges overlap, for lists that end alike.

    Every distinct end closes exactly one overlap: that of the tokens which cover the byte before it.
    """
    ends = np.sort(np.concatenate([ends_a, ends_b]))
    ends = ends[np.append(ends[1:] != ends[:-1], True)] if len(ends) else ends
    return np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)


class Tokens(NamedTuple):
    """A tokenizer: texts to all their ids in one array and how many each text has, and the bytes of each id."""

    encode: object
    spelled: list[bytes]


def byte_tokens(path: str) -> Tokens:
    """A byte-level BPE over a space and the text: every distinct piece of a part is pre-tokenized and merged once."""
    with open(path, encoding="utf-8") as f:
        spec = f.read()
    codec = Codec(spec, public_tokenizers.PATTERN, specials=False)
    table = byte_characters()
    vocab = {t["content"]: t["id"] for t in json.loads(spec)["added_tokens"]} | json.loads(spec)["model"]["vocab"]
    spelled = [b""] * (max(vocab.values()) + 1)
    for entry, i in vocab.items():
        spelled[i] = bytes(table[c] for c in entry) if all(c in table for c in entry) else entry.encode()

    def encode(batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
        packed = codec.encode_all(pa.array([" " + t for t in batch], pa.string()))
        return np.frombuffer(b"".join(packed), "<u4").astype(np.int64), np.array([len(p) // 4 for p in packed], np.int64)

    return Tokens(encode, spelled)


def piece_tokens(path: str) -> Tokens:
    """A sentencepiece model, which adds the space itself."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    spelled = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
    return Tokens(_Words(model).encode if _apart(model) else lambda batch: _flat(model.encode(batch, num_threads=1)), spelled)


def _apart(model) -> bool:
    """Whether words get the same tokens alone as inside a text.

    They do in a BPE that leaves characters as they are and puts a space first, if no token holds a space behind
    another character: then nothing is merged across the beginning of a run of spaces.
    """
    try:
        from sentencepiece.sentencepiece_model_pb2 import ModelProto, TrainerSpec
    except ImportError:  # Without protobuf a model does not tell how it works.
        return False
    spec = ModelProto.FromString(model.serialized_model_proto())
    rules = spec.normalizer_spec
    own = {ModelProto.SentencePiece.USER_DEFINED, ModelProto.SentencePiece.UNUSED}
    return (
        spec.trainer_spec.model_type == TrainerSpec.BPE
        and not (spec.trainer_spec.treat_whitespace_as_suffix or rules.precompiled_charsmap or rules.remove_extra_whitespaces)
        and rules.add_dummy_prefix
        and rules.escape_whitespaces
        and not any(p.type in own or "▁" in p.piece.lstrip("▁") for p in spec.pieces)
    )


class _Words:
    """A sentencepiece model whose words can be encoded alone: every distinct word of a part once, kept for later parts.

    A word goes with the spaces before it. The first of them is the one the model adds.
    """

    def __init__(self, model):
        self.model = model
        self.kept: dict[str, bytes] = {}

    def known(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of distinct words, each after one more space, and how many each word has."""
        new = [w for w in words if w not in self.kept]
        ids, size = _flat(self.model.encode(new, num_threads=1))
        packed, ends = ids.astype("<i4").tobytes(), (4 * np.cumsum(size)).tolist()
        found = {w: packed[a:b] for w, a, b in zip(new, [0, *ends], ends)}
        if "" in found:
            found[""] = np.array([self.model.piece_to_id("▁")], "<i4").tobytes()
        held = [found[w] if w in found else self.kept[w] for w in words]
        if len(self.kept) + len(new) > PIECES:
            # Those met again in this part are the likeliest to come back.
            self.kept = {w: self.kept[w] for w in words if w in self.kept}
        room = max(0, PIECES - len(self.kept))
        self.kept.update(itertools.islice(((w, i) for w, i in found.items() if len(w) <= LONGEST_KEPT), room))
        return np.frombuffer(b"".join(held), "<i4").astype(np.int64), np.fromiter(map(len, held), np.int64, len(held)) // 4

    def encode(self, batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
        text = pa.array(batch, pa.string())
        # Texts where spaces do more than part two words are cut before each run of them.
        runs = pc.match_substring_regex(text, "^$|^ | $|  |▁").to_numpy(zero_copy_only=False)
        plain = pc.split_pattern(text.filter(pa.array(~runs)), " ")
        others = [[w[1:].replace("▁", " ") for w in RUN.findall(" " + batch[k])] if batch[k] else [] for k in np.flatnonzero(runs)]
        words = pa.concat_arrays([plain.flatten(), pa.array(itertools.chain.from_iterable(others), pa.string())]).dictionary_encode()
        ids, size = self.known(words.dictionary.to_pylist())
        counts = np.zeros(len(batch), np.int64)
        counts[~runs], counts[runs] = np.diff(plain.offsets.to_numpy()), [len(x) for x in others]
        # Plain texts come first among the words: back into the order of the texts.
        turn = np.concatenate([np.flatnonzero(~runs), np.flatnonzero(runs)])
        first = np.zeros(len(batch), np.int64)
        first[turn] = np.cumsum(counts[turn]) - counts[turn]
        codes = words.indices.to_numpy()[_ranges(first, counts)]
        tokens = ids[_ranges((np.cumsum(size) - size)[codes], size[codes])]
        return tokens, sums_per_list(size[codes], np.append(0, np.cumsum(counts)))


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All numbers of the ranges from ``start`` on with ``size`` numbers each, one range after the other."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


def _written(n: int, after: str) -> np.ndarray:
    """Every id in decimal with what follows it, eight bytes each."""
    return np.array([f"{i}{after}" for i in range(n)], "S8")


def _digests(a, b, cut_a, cut_b, rows_a, rows_b, tables) -> list[str]:
    """The digest of each row's groups. All arrays run over the tokens, groups and rows of a part."""
    both = np.empty(len(a) + len(b), "S8")
    before_a, before_b = np.append(0, cut_a[:-1]), np.append(0, cut_b[:-1])
    # Tokens of A stand behind all of B's from earlier groups, those of B behind A's up to their own group.
    at_a = np.arange(len(a)) + np.repeat(before_b, cut_a - before_a)
    at_b = np.arange(len(b)) + np.repeat(cut_a, cut_b - before_b)
    both[at_a], both[at_b] = tables[0][a], tables[0][b]
    both[at_a[cut_a - 1]] = tables[1][a[cut_a - 1]]
    both[at_b[cut_b - 1]] = tables[2][b[cut_b - 1]]
    edges = np.append(0, rows_a + rows_b).tolist()
    return [hashlib.sha256(both[s:e].tobytes().translate(None, b"\0")[:-1]).hexdigest() for s, e in zip(edges, edges[1:])]


def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a part in one array, and how many each row has."""
    lists = pa.array(ids, pa.list_(pa.int32()))
    return lists.values.to_numpy().astype(np.int64), np.diff(lists.offsets.to_numpy()).astype(np.int64)


class _Spelling:
    """The bytes of all ids one after the other, to compare whole parts at once with what their tokens spell."""

    def __init__(self, spelled: list[bytes]):
        self.size = np.array([len(s) for s in spelled], np.int64)
        self.start = (np.cumsum(self.size) - self.size).astype(np.int32)
        self.bytes = np.frombuffer(b"".join(spelled), np.uint8)

    def __call__(self, ids: np.ndarray, counts: np.ndarray, whole: list[bytes]) -> np.ndarray:
        """Whether the tokens of each row spell its bytes."""
        size = self.size[ids]
        ends = np.append(0, np.cumsum(size))
        if ends[-1] >= 1 << 31:
            raise ValueError("a part of more than two GB")
        at = np.repeat(self.start[ids] - ends[:-1].astype(np.int32), size) + np.arange(ends[-1], dtype=np.int32)
        found = self.bytes[at].tobytes()
        edges = ends[np.append(0, np.cumsum(counts))].tolist()
        return np.array([found[s:e] == w for s, e, w in zip(edges, edges[1:], whole)], bool)


class _Pair:
    """Both tokenizers of a worker, with the lengths and the written ids of their tokens."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = byte_tokens(path_a), piece_tokens(path_b)
        self.spell_a, self.spell_b = _Spelling(self.a.spelled), _Spelling(self.b.spelled)
        self.size_a, self.size_b = self.spell_a.size, self.spell_b.size
        most = max(len(self.size_a), len(self.size_b))
        if most > 10**7:
            raise ValueError("ids of more than seven digits")
        self.tables = [_written(most, after) for after in (",", "|", ";")]

    def tokens(self, batch: list[str]) -> tuple[list[int], list[np.ndarray]]:
        """Which texts both sides spell alike; for A and then for B their tokens and how many each has."""
        whole = [b" " + t.encode() for t in batch]
        sides = [self.a.encode(batch), self.b.encode(batch)]
        good = np.array([bool(t) for t in batch], bool)
        for spelling, side in zip((self.spell_a, self.spell_b), sides):
            good &= spelling(*side, whole)
        kept = [x for ids, counts in sides for x in (ids[np.repeat(good, counts)], counts[good])]
        return np.flatnonzero(good).tolist(), kept

    def rows(self, a: np.ndarray, counts_a: np.ndarray, b: np.ndarray, counts_b: np.ndarray):
        """Per row: groups, links and digest; then row, a, b and times of its distinct linked pairs."""
        rows_a, rows_b = np.cumsum(counts_a), np.cumsum(counts_b)
        # Byte offsets over all rows of the part: every row ends alike on both sides.
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        cut_a, cut_b = groups(ends_a, ends_b)
        digests = _digests(a, b, cut_a, cut_b, rows_a, rows_b, self.tables)
        n_groups = np.diff(np.searchsorted(cut_a, rows_a, side="right"), prepend=0)
        i, j = links(ends_a, ends_b)
        row = np.searchsorted(rows_a, i, side="right")
        n_links = np.bincount(row, minlength=len(rows_a))
        order = np.lexsort((b[j], a[i], row)) if len(rows_a) >= 1 << 15 else None
        if order is None:
            key = np.sort(row << 48 | a[i] << 24 | b[j])
            row, pair_a, pair_b = key >> 48, key >> 24 & 0xFFFFFF, key & 0xFFFFFF
        else:
            row, pair_a, pair_b = row[order], a[i][order], b[j][order]
        first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (pair_a[1:] != pair_a[:-1]) | (pair_b[1:] != pair_b[:-1])))
        return n_groups, n_links, digests, row[first], pair_a[first], pair_b[first], np.diff(first, append=len(row))


def aligned(df: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Per row: sizes, digest of the groups, and its distinct linked pairs with the times they occur."""
    key = f"aligned_{abs(hash((path_a, path_b)))}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = worker_state(key, lambda: _Pair(path_a, path_b))
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                n = part.num_rows
                good, found = both.tokens(flat_text(part).to_pylist())
                counts, digests = np.zeros((4, n), np.int64), np.full(n, "", object)
                row = pair_a = pair_b = times = np.zeros(0, np.int64)
                if good:
                    n_groups, n_links, digests[good], row, pair_a, pair_b, times = both.rows(*found)
                    counts[:, good] = found[1], found[3], n_groups, n_links
                ends = np.zeros(n, np.int64)
                ends[good] = np.bincount(row, minlength=len(good))
                offsets = pa.array(np.append(0, np.cumsum(ends)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (pair_a, pair_b, times)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), part.column("doc_id"), *map(pa.array, counts), pa.array(digests, pa.string()), *lists],
                    ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "a", "b", "times"],
                )

    return texts(df).withColumn("row", F.monotonically_increasing_id()).mapInArrow(run, f"{_ROW}, {_PAIRS}")


def pair_counts(rows: DataFrame) -> DataFrame:
    """a, b, n: the rows that hold the pair; best: whether no pair of the same a has more."""
    held = rows.select(F.inline(F.arrays_zip("a", "b"))).groupBy("a", "b").agg(F.count("*").alias("n"))
    top = held.groupBy("a").agg(F.max("n").alias("most"))
    return held.join(top, "a").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def _least_frequent(counts: DataFrame, frequent: int) -> int:
    """The smallest power of two such that at most ``frequent`` pairs have that count or more."""
    level = F.floor(F.log2("n")).cast("int")
    sizes = {r.level: r["count"] for r in counts.groupBy(level.alias("level")).count().collect()}
    at, room = max(sizes, default=-1) + 1, frequent
    while at > 0 and sizes.get(at - 1, 0) <= room:
        at -= 1
        room -= sizes.get(at, 0)
    return 1 << at


def align(spark: SparkSession, df: DataFrame, path_a: str, path_b: str, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for every row of ``df``."""
    rows = stored(spark, aligned(df, path_a, path_b), "aligned")
    counts = stored(spark, pair_counts(rows), "pair_counts")
    least = _least_frequent(counts, frequent)
    top = counts.where(F.col("n") >= least).select((F.col("a").cast("long") * (1 << 32) + F.col("b")).alias("pair"), "n", "best").toArrow().sort_by("pair")
    pair, n, best = (top.column(c).to_numpy() for c in ("pair", "n", "best"))
    sent = spark.sparkContext.broadcast((pair.astype(np.int64), n.astype(np.int64), best.astype(bool)))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, known_n, known_best = sent.value
        for batch in batches:
            a, b, times = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in ("a", "b", "times"))
            offsets = batch.column("a").offsets.to_numpy()
            offsets = offsets - offsets[0]
            pairs = a << 32 | b
            at = np.minimum(np.searchsorted(known, pairs), max(len(known) - 1, 0))
            hit = known[at] == pairs if len(known) else np.zeros(len(pairs), bool)
            at = np.where(hit, at, 0)
            n = np.where(hit, known_n[at], 0) if len(known) else np.zeros(len(pairs), np.int64)
            good = hit & known_best[at] if len(known) else hit
            missed = np.nonzero(~hit)[0]
            ends = np.searchsorted(missed, offsets).astype(np.int32)
            rest = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x[missed].astype(np.int32))) for x in (a, b, times)]
            kept = [batch.column(c) for c in ("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")]
            sums = [pa.array(sums_per_list(x, offsets)) for x in (times * good, times * n)]
            yield pa.RecordBatch.from_arrays(
                [*kept, *sums, *rest], ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum", "a", "b", "times"]
            )

    found = rows.mapInArrow(look_up, f"{_ROW}, n_best long, count_sum long, {_PAIRS}")
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    if least == 1:  # Every pair is in the first tier.
        return found.select(*columns)
    found = stored(spark, found, "looked_up")
    rest = found.select("row", F.inline(F.arrays_zip("a", "b", "times"))).join(counts.where(F.col("n") < least), ["a", "b"])
    more = rest.groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum")
    )
    both = found.drop("a", "b", "times").join(more, "row", "left")
    added = {k: F.col(k) + F.coalesce(F.col(m), F.lit(0)) for k, m in (("n_best", "more_best"), ("count_sum", "more_sum"))}
    return both.withColumns(added).select(*columns)
