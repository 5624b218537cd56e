"""Near-duplicate documents by MinHash: banding, signature verification, exact confirmation, components.

1. One scan gives every document the number of its shingles, a digest of its set and ``BANDS * ROWS``
   minima of universal hash functions. Documents with the same set form one class at once, its smallest id
   stands for it, so a group of exact copies is one row from here on.
2. Every band of a signature names a bucket. Each member of a bucket is compared with the bucket's centre
   only: pairs grow with the members, not with their square. Pairs whose signatures agree in too few minima
   go; the others are confirmed on full sets.
3. A link that a centre misses joins two groups inside one bucket. Buckets whose members are not yet all in
   one component get a second centre each, drawn by a digest and compared across components only. In what
   is left every pair across components is compared inside the bucket's task: by signatures first, which
   leaves members with a likely partner, then on full sets, likeliest pairs first, until the pair's groups
   are one. Tasks give members and confirmed links, never the pairs; a bucket above ``PART`` members is cut
   into parts, and pairs of parts are tasks of their own. So every pair that shares a band is either
   compared or already connected.
4. Components by alternating large-star and small-star.

With 32 bands of 4 rows a pair at the threshold of 0.8 shares no band with probability 5e-8, and one in 1e5
of them is lost to the signature check.

Words are runs between ASCII white space, A-Z lower-cased. A document with fewer words than a shingle has
its whole sequence as the only one; one without words, or null, has none and links with nothing. Rows that
repeat an id are one node with the links of each of its texts. Rows with a null id link with nothing, have a
null component and are kept. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from stationcast.llm.common import flat_text, key_filter, may_hold, offsets_of, slices, stored, texts
from stationcast.llm.components import components

BANDS = 32
ROWS = 4
SIGNATURE_SLACK = 0.16
PART = 512
BLOCK = 1 << 15


def word_hashes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word and where each text starts."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(text))
    words, offsets = lists.flatten(), offsets_of(lists)
    real = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    offsets = np.concatenate([[0], np.cumsum(real)])[offsets]
    words = words.filter(pa.array(real)).dictionary_encode()
    import xxhash

    table = np.array([xxhash.xxh3_64_intdigest(w) for w in words.dictionary.cast(pa.binary()).to_pylist()], np.uint64)
    return table[words.indices.to_numpy()] if len(table) else table, offsets


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every input bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_sets(text: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, one text after the other, and where each text starts."""
    hashes, offsets = word_hashes(text)
    sets, ends = [], [0]
    with np.errstate(over="ignore"):
        rolled = np.zeros(len(hashes), np.uint64)
        for k in range(words):
            n = max(0, len(hashes) - k)
            rolled[:n] = mix64(rolled[:n] * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n])
        for a, b in zip(offsets, offsets[1:]):
            if b - a >= words:
                found = np.unique(rolled[a : b - words + 1])
            elif b > a:
                short = np.zeros(1, np.uint64)
                for h in hashes[a:b]:
                    short = mix64(short * np.uint64(0x9E3779B97F4A7C15) + h)
                found = short + np.uint64(b - a)
            else:
                found = hashes[:0]
            sets.append(found)
            ends.append(ends[-1] + len(found))
    return np.concatenate(sets) if sets else hashes[:0], np.array(ends)


def hash_family(count: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 31, count, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, count, dtype=np.uint32)


def signatures(sets: np.ndarray, ends: np.ndarray, count: int) -> np.ndarray:
    """(texts, count) minima of ``a * x + b`` modulo 2**32; all ones for an empty set."""
    a, b = hash_family(count)
    x = (sets >> np.uint64(32)).astype(np.uint32)
    out = np.full((count, len(ends) - 1), 0xFFFFFFFF, np.uint32)
    owner = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    for start in range(0, len(x), BLOCK):
        part, own = x[start : start + BLOCK], owner[start : start + BLOCK]
        firsts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        docs = own[firsts]
        for k in range(count):
            low = np.minimum.reduceat(part * a[k] + b[k], firsts)
            out[k, docs] = np.minimum(out[k, docs], low)
    return out.T


def _profile(words: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                sets, ends = shingle_sets(flat_text(part), words)
                sig = signatures(sets, ends, bands * rows)
                digests = [hashlib.blake2b(sets[p:q].tobytes(), digest_size=16).digest() if q > p else None for p, q in zip(ends, ends[1:])]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(ends)), pa.array(digests, pa.binary()), pa.array([s.tobytes() for s in sig], pa.binary())],
                    ["doc_id", "n_shingles", "digest", "signature"],
                )

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                sets, ends = shingle_sets(flat_text(part), words)
                packed = [sets[p:q].tobytes() for p, q in zip(ends, ends[1:])]
                yield pa.RecordBatch.from_arrays([part.column("rep"), pa.array(packed, pa.binary())], ["rep", "shingles"])

    return run


def band_keys(sig: np.ndarray, bands: int) -> np.ndarray:
    """(texts, bands): bucket of every band."""
    parts = sig.reshape(len(sig), bands, -1)
    key = np.zeros(parts.shape[:2], np.uint64) + np.arange(1, bands + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for r in range(parts.shape[2]):
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, r])
    return key


def _buckets(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint32).reshape(batch.num_rows, -1)
            key = band_keys(sig, bands)
            reps = np.repeat(batch.column("rep").to_numpy(), bands)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64).ravel()), pa.array(reps)], ["bucket", "rep"])

    return run


def _alike(least: float):
    """Pairs whose signatures agree in at least this share of the minima."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(batch.num_rows, -1) for c in ("sig_a", "sig_b"))
                ok = pa.array((a == b).mean(axis=1) >= least)
                yield batch.select(["a", "b"]).filter(ok)

    return run


def _confirm(percent: int):
    """Pairs with 100 * |A and B| >= percent * |A or B| on sorted full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("set_a"), batch.column("set_b")
            sets = ((np.frombuffer(left[i].as_buffer(), np.uint64), np.frombuffer(right[i].as_buffer(), np.uint64)) for i in range(batch.num_rows))
            ok = np.array([alike(x, y, percent) for x, y in sets], bool)
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    return run


def _pairs_across(table: pa.Table, key: tuple, bands: int, least: float):
    """(estimates, i, j) of likely pairs across components between two parts of a bucket, or inside one.

    A pair that shares several buckets counts in the one of its first shared band only.
    """
    bucket, first, second = (k.as_py() for k in key)
    component, part = table.column("component").to_numpy(), table.column("part").to_numpy()
    sig = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint32).reshape(table.num_rows, -1)
    keys = band_keys(sig, bands)
    band = int(np.flatnonzero(keys[0].view(np.int64) == bucket)[0])
    left = np.flatnonzero(part == first)
    right = left if first == second else np.flatnonzero(part == second)
    for i in left:
        others = right[(component[right] != component[i]) & ((right > i) | (first != second))]
        others = others[(keys[others, : band + 1] == keys[i, : band + 1]).argmax(axis=1) == band]
        near = (sig[others] == sig[i]).mean(axis=1)
        ok = near >= least
        yield near[ok], np.full(ok.sum(), i), others[ok]


def _likely(bands: int, least: float):
    """Members of a bucket that have a likely partner in another component."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        keep = np.zeros(table.num_rows, bool)
        for _, i, j in _pairs_across(table, key, bands, least):
            keep[i], keep[j] = True, True
        table = table.filter(pa.array(keep))
        bucket = pa.array(np.full(table.num_rows, key[0].as_py()), pa.int64())
        return pa.table([bucket, table.column("rep"), table.column("component")], ["bucket", "rep", "component"])

    return run


def alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * |x and y| >= percent * |x or y| for sorted sets."""
    if not len(x) or not len(y) or 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _links_across(bands: int, percent: int, least: float):
    """Confirmed links of a bucket that join components, likeliest pairs first."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        found = list(_pairs_across(table, key, bands, least))
        near, i, j = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0), np.zeros(0, int), np.zeros(0, int))
        root: dict[int, int] = {}

        def top(c: int) -> int:
            while root.get(c, c) != c:
                c = root[c]
            return c

        reps, component = table.column("rep").to_pylist(), table.column("component").to_pylist()
        sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
        out = []
        for k in np.argsort(-near, kind="stable").tolist():
            x, y = int(i[k]), int(j[k])
            p, q = top(component[x]), top(component[y])
            if p != q and alike(sets[x], sets[y], percent):
                root[max(p, q)] = min(p, q)
                out.append((reps[x], reps[y]))
        return pa.table([pa.array([o[n] for o in out], pa.int64()) for n in (0, 1)], ["a", "b"])

    return run


def in_parts(rows: DataFrame, columns: list[str]):
    """Groups (bucket, part, part) of ``rows``: a bucket with more than ``PART`` members is dealt by digest."""
    parts = rows.groupBy("bucket").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    dealt = rows.join(parts, "bucket").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return dealt.select("bucket", F.least("part", "other").alias("p1"), F.greatest("part", "other").alias("p2"), "part", *columns).groupBy(
        "bucket", "p1", "p2"
    )


def unsettled(members: DataFrame, found: DataFrame) -> DataFrame:
    """(bucket, rep, component) of the buckets that hold more than one component."""
    labelled = members.join(found, "rep")
    split = labelled.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    return labelled.join(split.select("bucket"), "bucket").select("bucket", "rep", "component")


def merged(spark: SparkSession, found: DataFrame, links: DataFrame) -> DataFrame:
    """``found`` (rep, component) after more links (a, b) between reps."""
    links = stored(spark, links, "links")
    if links.isEmpty():
        return found
    edges = links.join(found.select(F.col("rep").alias("a"), F.col("component").alias("ca")), "a", "left").join(
        found.select(F.col("rep").alias("b"), F.col("component").alias("cb")), "b", "left"
    )
    ends = components(spark, edges.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
    known = found.join(ends, found.component == ends.node, "left").select("rep", F.coalesce(ends.component, found.component).alias("component"))
    # Ends that were no member of any bucket: repeated ids that tie classes together.
    new = ends.join(found, ends.node == found.rep, "left_anti").select(F.col("node").alias("rep"), "component")
    return known.unionByName(new)


def near_duplicates(
    spark: SparkSession, df: DataFrame, words: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``df`` (doc_id, text)."""
    docs = texts(df)
    profile = stored(
        spark, docs.mapInArrow(_profile(words, bands, rows), "doc_id long, n_shingles long, digest binary, signature binary"), "signatures"
    )
    usable = profile.where("n_shingles > 0 and doc_id is not null")
    classes = usable.groupBy("digest").agg(F.min(F.struct("doc_id", "signature")).alias("m")).select(
        "digest", F.col("m.doc_id").alias("rep"), F.col("m.signature").alias("signature")
    )
    classes = stored(spark, classes, "classes")
    entries = classes.mapInArrow(_buckets(bands, rows), "bucket long, rep long")
    shared = entries.groupBy("bucket").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high")
    members = stored(spark, entries.join(shared.select("bucket"), "bucket").distinct(), "members")
    # Sets by (rep, text) rather than rep: a repeated id may stand for several classes, equal rows of it for one.
    # Only texts that the filter lets through are exchanged.
    wanted = members.select("rep").distinct()
    signs = classes.join(wanted, "rep").select("rep", "digest", "signature")
    near = may_hold(docs, ["doc_id"], key_filter(spark, wanted)).where("may_hold")
    once = near.groupBy("doc_id", F.xxhash64("text").alias("digest")).agg(F.min("text").alias("text"))
    sets = stored(
        spark,
        once.join(wanted, once.doc_id == wanted.rep).select("rep", "text").mapInArrow(_sets(words), "rep long, shingles binary"),
        "shingles",
    )

    def confirmed(pairs: DataFrame) -> DataFrame:
        signed = pairs.join(signs.select(F.col("rep").alias("a"), F.col("signature").alias("sig_a")), "a").join(
            signs.select(F.col("rep").alias("b"), F.col("signature").alias("sig_b")), "b"
        )
        # ``pairs`` are distinct; only a repeated id with several signatures gives a pair again, which adds no link.
        near = signed.mapInArrow(_alike(percent / 100 - SIGNATURE_SLACK), "a long, b long")
        full = near.join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("set_a")), "a").join(
            sets.select(F.col("rep").alias("b"), F.col("shingles").alias("set_b")), "b"
        )
        return full.mapInArrow(_confirm(percent), "a long, b long")

    # Ids that stand for more than one class, and ids in a class they do not stand for, tie classes together.
    ties = usable.join(classes.select("digest", "rep"), "digest").where("doc_id != rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    repeated = usable.groupBy("doc_id").agg(F.min("digest").alias("d1"), F.max("digest").alias("d2")).where("d1 != d2").select("doc_id")
    links = stored(spark, ties.join(repeated, ties.a == repeated.doc_id, "left_semi"), "links")

    found = stored(spark, merged(spark, members.select("rep").distinct().withColumn("component", F.col("rep")), links), "components")

    # The smallest id of each bucket is its first centre.
    centres = shared.select("bucket", F.col("low").alias("centre"))
    pairs = members.join(centres, "bucket").where("rep != centre").select(F.greatest("rep", "centre").alias("a"), F.least("rep", "centre").alias("b"))
    found = stored(spark, merged(spark, found, confirmed(pairs.distinct())), "components")

    # The second is drawn; only members of other components are compared with it.
    left = stored(spark, unsettled(members, found), "open")
    drawn = left.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("rep", "bucket").alias("h"), "rep", "component")).alias("m")).select(
        "bucket", F.col("m.rep").alias("centre"), F.col("m.component").alias("own")
    )
    pairs = left.join(drawn, "bucket").where("component != own").select(F.greatest("rep", "centre").alias("a"), F.least("rep", "centre").alias("b"))
    found = stored(spark, merged(spark, found, confirmed(pairs.distinct())), "components")

    # What is left is compared inside the buckets.
    left = unsettled(left.select("bucket", "rep"), found)
    likely = in_parts(left.join(signs.select("rep", "signature"), "rep"), ["rep", "component", "signature"]).applyInArrow(
        _likely(bands, percent / 100 - SIGNATURE_SLACK), "bucket long, rep long, component long"
    )
    likely = stored(spark, likely.distinct(), "likely")
    rows = likely.join(signs.select("rep", "signature"), "rep").join(sets, "rep")
    last = in_parts(rows, ["rep", "component", "signature", "shingles"]).applyInArrow(
        _links_across(bands, percent, percent / 100 - SIGNATURE_SLACK), "a long, b long"
    )
    found = stored(spark, merged(spark, found, last), "components")

    classes = classes.select("digest", "rep").alias("c").join(found.alias("f"), F.col("c.rep") == F.col("f.rep"), "left").select(
        "digest", F.coalesce("component", "c.rep").alias("component")
    )
    out = profile.select("doc_id", "n_shingles", "digest").join(classes, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id")
    out = out.select("doc_id", "n_shingles", component)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
