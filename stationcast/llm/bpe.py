"""Byte-level BPE encoding and decoding with a contiguous rank array.

A short pre-token holds its parts and the rank of each neighbouring pair in two contiguous arrays. The
smallest rank is searched by a scan, the boundary behind it is deleted and the two neighbouring ranks are
refreshed, until no pair has a rank. Pre-tokens up to ``LANE`` bytes do so side by side, one row of a matrix
each: every step deletes one boundary in every row that is not done. Pre-tokens above ``SHORT`` bytes, where
scanning would be quadratic, give the same parts through a heap of ranks over linked parts.

Texts are cut at every space that no white space follows: no pre-token reaches across such a place, so the
distinct pieces of a part of an Arrow batch are pre-tokenized once, its distinct pre-tokens are merged once,
and both can be kept in bounded caches. Texts with longer white space runs or special strings are pre-tokenized as a
whole. ``encode_texts`` and ``encode_and_decode`` keep pre-tokens only, and those no longer than a task: an idle
Python worker counts as memory of its executor, so it holds the vocabulary and nothing else.

Null text counts as empty and gives no ids. Every input row gives one row, repeated ids included; extra
columns are not read. Ids are packed as little-endian unsigned 32-bit integers.
"""

from __future__ import annotations

import heapq
import itertools
import json
import os
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from stationcast.llm.common import flat_text, offsets_of, slices, texts, worker_state

LANE = 24
LANES = 8192
SHORT = 64
CACHE = 120_000
PIECES = 240_000
# Pre-tokens that a task of the operators below keeps, and text it takes at a time.
TASK_CACHE = 60_000
PART_BYTES = 1 << 20
LONGEST_KEPT = 64
# Characters from here on may belong to another class in the installed regex module than in the tokenizer's.
NEWER_CHARACTERS = "԰"
WHITE_SPACE = "\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
NO_RANK = 1 << 60


def byte_characters() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def merge_short(word: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """Parts of ``word`` by repeated scans for the smallest rank."""
    starts = list(range(len(word) + 1))
    near = [ranks.get(word[i : i + 2], NO_RANK) for i in range(len(word) - 1)]
    get = ranks.get
    while near:
        smallest = min(near)
        if smallest == NO_RANK:
            break
        i = near.index(smallest)
        del starts[i + 1], near[i]
        if i < len(near):
            near[i] = get(word[starts[i] : starts[i + 2]], NO_RANK)
        if i:
            near[i - 1] = get(word[starts[i - 1] : starts[i + 1]], NO_RANK)
    return [word[a:b] for a, b in zip(starts, starts[1:])]


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The same parts for a long ``word``, by a heap of (rank, start) over linked parts."""
    n = len(word)
    end = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    heap = []

    def push(i: int) -> None:
        j = end[i]
        if j < n and (rank := ranks.get(word[i : end[j]])) is not None:
            heapq.heappush(heap, (rank, i, j, end[j]))

    for i in range(n - 1):
        push(i)
    while heap:
        _, i, j, k = heapq.heappop(heap)
        if end[i] != j or end[j] != k:
            continue
        end[i], end[j] = k, -1
        if k < n:
            before[k] = i
        push(i)
        if before[i] >= 0:
            push(before[i])
    parts, i = [], 0
    while i < n:
        parts.append(word[i : end[i]])
        i = end[i]
    return parts


class Pairs:
    """Rank of a pair of ids, and the id that a rank makes."""

    def __init__(self, merges: list[tuple[int, int, int]]):
        """``merges``: left, right and merged id, by rank."""
        left, right, self.made = (np.array(x, np.int64) for x in zip(*merges)) if merges else (np.zeros(0, np.int64),) * 3
        # Of a pair that is listed twice the later rank counts, as in the library.
        keys, rank = np.unique(((left << 32) | right)[::-1], return_index=True)
        # One key above all others ends the search.
        self.keys = np.append(keys, np.iinfo(np.int64).max)
        self.rank = np.append(len(left) - 1 - rank, NO_RANK)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks; ``NO_RANK`` for no merge or a right side of -1."""
        wanted = (left.astype(np.int64) << 32) | right
        at = np.searchsorted(self.keys[:-1], wanted)
        return np.where(self.keys[at] == wanted, self.rank[at], NO_RANK)


def merge_lanes(ids: np.ndarray, pairs: Pairs) -> list[bytes]:
    """Packed ids of words side by side; ``ids`` (words, length) has the ids of their bytes, then -1."""
    out: list[bytes] = [b""] * len(ids)
    words = np.arange(len(ids))
    ranks = np.full(ids.shape, NO_RANK)
    for k in range(ids.shape[1] - 1):
        ranks[:, k] = pairs.of(ids[:, k], ids[:, k + 1])
    while len(words):
        at = ranks.argmin(axis=1)
        rows = np.arange(len(words))
        smallest = ranks[rows, at]
        live = smallest < NO_RANK
        if not live.all():
            done = ids[~live]
            real = done >= 0
            packed = done[real].astype("<u4").tobytes()
            ends = 4 * np.cumsum(real.sum(axis=1))
            for word, a, b in zip(words[~live].tolist(), [0, *ends.tolist()], ends.tolist()):
                out[word] = packed[a:b]
            ids, ranks, words, at, smallest = ids[live], ranks[live], words[live], at[live], smallest[live]
            rows = rows[: len(words)]
        made = pairs.made[smallest]
        place = np.arange(ids.shape[1] - 1)
        ids = np.where(place <= at[:, None], ids[:, :-1], ids[:, 1:])
        ranks = np.where(place < at[:, None], ranks[:, :-1], ranks[:, 1:])
        ids[rows, at] = made
        following = np.where(at + 1 < ids.shape[1], ids[rows, np.minimum(at + 1, ids.shape[1] - 1)], -1)
        ranks[rows, at] = pairs.of(made, following)
        inner = np.flatnonzero(at)
        ranks[inner, at[inner] - 1] = pairs.of(ids[inner, at[inner] - 1], made[inner])
    return out


class Codec:
    """Encoder and decoder made from the text of a byte-level tokenizer file and its pre-token pattern.

    Without ``specials`` the strings of special tokens inside texts are plain text. At most ``cache`` pre-tokens and
    ``cached_pieces`` pieces are kept between parts, until ``forget``.
    """

    def __init__(self, spec: str, pattern: str, specials: bool = True, cache: int = CACHE, cached_pieces: int = PIECES):
        import regex

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers.pre_tokenizers import ByteLevel

        described = json.loads(spec)
        to_byte = byte_characters()
        self.added = {t["content"]: t["id"] for t in described["added_tokens"]}
        vocab = {t: i for t, i in described["model"]["vocab"].items() if t not in self.added}
        self.ids = {bytes(to_byte[c] for c in token): i for token, i in vocab.items()}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in described["model"]["merges"]]
        merged = [bytes(to_byte[c] for c in a + b) for a, b in merges]
        self.ranks = {token: r for r, token in reversed(list(enumerate(merged)))}
        self.pairs = Pairs([(vocab[a], vocab[b], vocab[a + b]) for a, b in merges])
        self.byte_ids = np.array([self.ids[bytes([b])] for b in range(256)], np.int64)
        size = max([*self.ids.values(), *self.added.values()]) + 1
        self.bytes = [b""] * size
        for token, i in self.ids.items():
            self.bytes[i] = token
        for token, i in self.added.items():
            self.bytes[i] = token.encode()
        if not specials:
            self.added = {t["content"]: t["id"] for t in described["added_tokens"] if not t["special"]}
        self.findall = regex.compile(pattern).findall
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")")
        self.whole = f"[ ][{WHITE_SPACE}]" + "".join("|" + regex.escape(t).replace("<", "\\x3c").replace(">", "\\x3e") for t in self.added)
        self.pre_tokenize = ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
        self.cache, self.cached_pieces = cache, cached_pieces
        self.forget()

    def forget(self) -> None:
        """Empties the caches."""
        self.kept: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def pre_tokens(self, text: str) -> list[str]:
        if text.isascii() or max(text) < NEWER_CHARACTERS:
            return self.findall(text)
        return [text[a:b] for _, (a, b) in self.pre_tokenize(text)]

    def inner_tokens(self, pieces: list[str]) -> tuple[list[str], list[int]]:
        """Pre-tokens of all pieces, each behind a space, and where each piece begins. No piece is empty or begins with white space.

        No pre-token reaches across such a space, so the pieces are searched as one text and only their first pre-tokens begin with one.
        """
        text = " ".join(["", *pieces])
        if text.isascii() or max(text, default="") < NEWER_CHARACTERS:
            found = self.findall(text)
            starts = [k for k, t in enumerate(found) if t[0] == " "]
            if len(starts) == len(pieces):
                return found, starts
        found, starts = [], []
        for piece in pieces:
            starts.append(len(found))
            found += self.pre_tokens(" " + piece)
        return found, starts

    def merge(self, tokens: list[str]) -> list[bytes]:
        """Packed ids of every pre-token (not empty)."""
        words = [t.encode() for t in tokens]
        sizes = np.array([len(w) for w in words], np.int64)
        out: list[bytes] = [b""] * len(words)
        order = np.argsort(sizes, kind="stable")
        lanes = int((sizes <= LANE).sum())
        for start in range(0, lanes, LANES):
            chosen = order[start : min(start + LANES, lanes)]
            held = np.arange(sizes[chosen].max()) < sizes[chosen][:, None]
            ids = np.full(held.shape, -1, np.int64)
            ids[held] = self.byte_ids[np.frombuffer(b"".join([words[i] for i in chosen.tolist()]), "u1")]
            for i, packed in zip(chosen.tolist(), merge_lanes(ids, self.pairs)):
                out[i] = packed
        for i in order[lanes:].tolist():
            parts = (merge_short if sizes[i] <= SHORT else merge_long)(words[i], self.ranks)
            out[i] = np.array([self.ids[p] for p in parts], "<u4").tobytes()
        return out

    def packed(self, tokens: set[str]) -> dict[str, bytes]:
        """Packed ids of pre-tokens by pre-token; new ones are merged and kept for later parts."""
        found = {t: self.kept[t] for t in tokens if t in self.kept}
        missing = sorted(tokens - found.keys())
        new = dict(zip(missing, self.merge(missing)))
        if len(self.kept) + len(new) > self.cache:
            # Those met again in this part are the likeliest to come back.
            self.kept = found.copy()
        room = max(0, self.cache - len(self.kept))
        self.kept.update(itertools.islice(((t, v) for t, v in new.items() if len(t) <= LONGEST_KEPT), room))
        found.update(new)
        return found

    def encode_all(self, text: pa.Array) -> list[bytes]:
        lists = pc.split_pattern(text, " ")
        pieces, offsets = lists.flatten().dictionary_encode(), offsets_of(lists)
        codes = pieces.indices.to_numpy()
        first = np.zeros(len(codes), bool)
        first[offsets[:-1][offsets[1:] > offsets[:-1]]] = True
        whole = pc.match_substring_regex(text, self.whole).to_numpy(zero_copy_only=False)
        needed = ~first & ~np.repeat(whole, np.diff(offsets))
        used = np.flatnonzero(np.bincount(codes[needed], minlength=len(pieces.dictionary))).tolist()
        words = pieces.dictionary.to_pylist()
        ready: list[bytes] = [b""] * len(words)
        met, missing = self.pieces, []
        for i in used:
            if (ids := met.get(words[i])) is None:
                missing.append(i)
            else:
                ready[i] = ids
        # Pre-tokens of each new piece, of the first piece of each text, and of texts that are taken whole.
        older = [i for i in missing if (w := words[i]).isascii() or max(w) < NEWER_CHARACTERS]
        newer = sorted(set(missing).difference(older)) if len(older) < len(missing) else []
        inner = [(some, *self.inner_tokens([words[i] for i in some])) for some in (older, newer)]
        heads = [
            self.whole_tokens(text[k].as_py()) if whole[k] else self.pre_tokens(words[codes[offsets[k]]])
            for k in range(len(text))
        ]
        tokens = {t for head in heads for t in head if isinstance(t, str)}
        tokens.update(*(found for _, found, _ in inner))
        known = self.packed(tokens)

        def join(tokens: list[str | bytes]) -> bytes:
            return b"".join([known[t] if isinstance(t, str) else t for t in tokens])

        for some, found, starts in inner:
            ids = [known[t] for t in found]
            for i, a, b in zip(some, starts, [*starts[1:], len(found)]):
                ready[i] = ids[a] if b - a == 1 else b"".join(ids[a:b])
        if len(met) + len(missing) > self.cached_pieces:
            # Those of this part are the likeliest to come back.
            self.pieces = {words[i]: ready[i] for i in itertools.islice(used, self.cached_pieces) if words[i] in met and len(words[i]) <= LONGEST_KEPT}
        room = max(0, self.cached_pieces - len(self.pieces))
        self.pieces.update(itertools.islice(((words[i], ready[i]) for i in missing if len(words[i]) <= LONGEST_KEPT), room))
        return [
            join(head) if whole[k] else join(head) + b"".join(map(ready.__getitem__, codes[offsets[k] + 1 : offsets[k + 1]].tolist()))
            for k, head in enumerate(heads)
        ]

    def whole_tokens(self, text: str) -> list[str | bytes]:
        """Pre-tokens of a whole text; a special string is there as its packed id."""
        if not self.added:
            return self.pre_tokens(text)
        out: list[str | bytes] = []
        for i, part in enumerate(self.special.split(text)):
            if i % 2:
                out.append(np.array([self.added[part]], "<u4").tobytes())
            elif part:
                out += self.pre_tokens(part)
        return out

    def decode(self, packed: bytes) -> str:
        ids = np.frombuffer(packed, "<u4").tolist()
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


@contextmanager
def _codec(sent) -> Iterator[Codec]:
    """The worker's codec, whose caches end with the task."""
    spec, pattern, key = sent.value
    codec = worker_state(f"codec_{key}", lambda: Codec(spec, pattern, cache=TASK_CACHE, cached_pieces=0))
    try:
        yield codec
    finally:
        codec.forget()
        pa.default_memory_pool().release_unused()


def _sent(spark: SparkSession, tokenizer_path: str, pattern: str):
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()
    return spark.sparkContext.broadcast((spec, pattern, f"{len(spec)}_{abs(hash(spec + pattern))}"))


def encode_texts(spark: SparkSession, df: DataFrame, tokenizer_path: str, pattern: str) -> DataFrame:
    """doc_id and ids (packed) for every row of ``df`` (doc_id, text)."""
    sent = _sent(spark, tokenizer_path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _codec(sent) as codec:
            for batch in batches:
                for part in slices(batch, "text", PART_BYTES):
                    ids = pa.array(codec.encode_all(flat_text(part)), pa.binary())
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids], ["doc_id", "ids"])

    return texts(df).mapInArrow(run, "doc_id long, ids binary")


def _decoded(codec: Codec, ids: pa.Array) -> pa.Array:
    return pa.array([codec.decode(x or b"") for x in ids.to_pylist()], pa.string())


def decode_ids(spark: SparkSession, df: DataFrame, tokenizer_path: str, pattern: str) -> DataFrame:
    """doc_id, ids and the decoded text for every row of ``df`` (doc_id, ids)."""
    sent = _sent(spark, tokenizer_path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _codec(sent) as codec:
            for batch in batches:
                for part in slices(batch, "ids", PART_BYTES):
                    ids = part.column("ids")
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids, _decoded(codec, ids)], ["doc_id", "ids", "decoded"])

    return df.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, decoded string")


def encode_and_decode(spark: SparkSession, df: DataFrame, tokenizer_path: str, pattern: str) -> DataFrame:
    """``decode_ids`` of ``encode_texts`` in one pass, so a task needs one Python worker and one codec."""
    sent = _sent(spark, tokenizer_path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _codec(sent) as codec:
            for batch in batches:
                for part in slices(batch, "text", PART_BYTES):
                    ids = pa.array(codec.encode_all(flat_text(part)), pa.binary())
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids, _decoded(codec, ids)], ["doc_id", "ids", "decoded"])

    return texts(df).mapInArrow(run, "doc_id long, ids binary, decoded string")
