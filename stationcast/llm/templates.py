"""Line dedup by a log-template tree of fixed depth.

A line's path through the tree is: its number of tokens, its leading tokens, then digests of the
``SEGMENTS`` runs that the rest is cut into. Tokens with a digit are variable fields and read ``<*>``
everywhere. A line of ``WILD_TOKENS`` or more also takes, at every run in turn, the ``<*>`` branch in its
place, so lines that differ within one run share a template. A path is thus a template, and a template is
one 64-bit key: templates are counted by plain aggregation, whatever the order of lines, and no branch of
the tree is ever gathered in one task. Only templates with more constant tokens than variable ones, and
``CONSTANT`` at least, stand for their lines: rows of numbers, prices or log fields are compared literally.

A template recurs across documents when it is seen in two or more distinct whole texts, whatever lines stand
around it: the smallest and the largest digest of its texts differ, which is exact but for equal 64-bit
digests. A document copied whole is one text, so it does not make its own lines recur: copies are for the
near-duplicate operator. Lines of a recurring template go from every document but the one with the smallest
id, so one instance stays; where only rows with a null id hold it, the text with the smallest digest keeps it.

A caller may name families of rows instead, such as groups of near copies. Then a template recurs when two
families hold it, and its lines stay in all rows of the family with the smallest number: what one member of a
family loses the others lose too, and near copies remain near copies.

Lines are cut at line feeds. Lines under ``LEAST_TOKENS`` tokens have no template and stay. Null and empty
texts stay as they are. Rows with a repeated id lose lines each for itself; a null id is never the smallest.
Extra columns are kept by ``drop_lines`` where it is told to; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

LEADING = 3
SEGMENTS = 4
LEAST_TOKENS = 4
CONSTANT = 3
WILD_TOKENS = 8
# Paths held before they are handed on, also within one long text.
ROWS = 20_000
VARIABLE = re.compile(r"[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*")
HAS_DIGIT = re.compile("[0-9]").search


def template_keys(line: str) -> list[int]:
    """64-bit keys of the templates of a line: its own path, then one path per wild run."""
    import xxhash

    tokens = (VARIABLE.sub("<*>", line) if HAS_DIGIT(line) else line).split()
    if len(tokens) < LEAST_TOKENS:
        return []
    variable = tokens.count("<*>")
    literal = variable > 0 and len(tokens) - variable < max(CONSTANT, variable + 1)
    if literal:
        tokens = line.split()
    digest = xxhash.xxh3_64_intdigest
    head, rest = f"{len(tokens)} " + " ".join(tokens[:LEADING]), tokens[LEADING:]
    step = -(-len(rest) // SEGMENTS)
    runs = [digest(" ".join(rest[i * step : (i + 1) * step])) for i in range(SEGMENTS)]
    keys = [digest(f"{head} {runs}")]
    if len(tokens) >= WILD_TOKENS and not literal:
        for i in range(SEGMENTS):
            run = rest[i * step : (i + 1) * step]
            # Variable fields outside the wild run, and the run itself as one more.
            fields = variable - run.count("<*>") + 1
            if run and len(tokens) - len(run) - fields + 1 >= max(CONSTANT, fields + 1):
                keys.append(digest(f"{head} {[*runs[:i], '<*>', *runs[i + 1 :]]}"))
    return keys


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        names, kinds = ["template", "doc_id", "body", "line"], [pa.int64(), pa.int64(), pa.int64(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    signed = lambda x: x - (1 << 64) if x >> 63 else x
    for batch in batches:
        rows: list[tuple] = []
        given = batch.column("body").to_pylist() if "body" in batch.schema.names else None
        for n, (doc, text) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist())):
            if not text:
                continue
            lines = text.split("\n")
            body = given[n] if given else signed(xxhash.xxh3_64_intdigest(text))
            for i, line in enumerate(lines):
                keys = template_keys(line)
                rows.extend((signed(k), doc, body, i) for k in keys)
                if len(rows) >= ROWS:
                    yield batch_of(rows)
                    rows = []
        if rows:
            yield batch_of(rows)


def _cut(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, n_lines, n_dropped = [], [], []
            for text, gone in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist()):
                lines = text.split("\n") if text is not None else []
                if gone:
                    drop = set(gone)
                    kept.append("\n".join(x for i, x in enumerate(lines) if i not in drop))
                else:
                    kept.append(text)
                n_lines.append(len(lines))
                n_dropped.append(len(set(gone or ())))
            columns = [pa.array(kept, pa.string()) if c == "text" else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], [*names, "n_lines", "n_dropped"]
            )

    return run


def _body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    for batch in batches:
        digests = [xxhash.xxh3_64_intdigest(t) if t else 0 for t in batch.column("text").to_pylist()]
        yield batch.append_column("body", pa.array(np.array(digests, np.uint64).view(np.int64)))


def drop_lines(df: DataFrame, columns: list[str] | None = None, node: str | None = None, family: str | None = None) -> DataFrame:
    """``columns`` (doc_id and text among them) with recurring lines cut from text, then n_lines and n_dropped.

    With families, ``node`` numbers an id with its text and ``family`` its family; both are long, neither null.
    """
    names = columns or ["doc_id", "text"]
    kinds = {"doc_id": "long", "text": "string"}
    kept = [F.col(c).cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in names]
    if family:
        keyed = df.select(*kept, F.col(node).alias("owner"), F.col(family).alias("body"))
        read = keyed.select(F.col("owner").alias("doc_id"), "text", "body")
        stays = F.col("body") == F.col("low")
    else:
        docs = df.select(*kept)
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
        keyed = docs.mapInArrow(_body, f"{fields}, body long").withColumn("owner", F.col("doc_id"))
        read = docs.select("doc_id", "text")
        stays = F.when(F.col("first").isNull(), F.col("body") == F.col("low")).otherwise(F.col("doc_id").eqNullSafe(F.col("first")))
    paths = read.mapInArrow(_paths, "template long, doc_id long, body long, line int")
    seen = paths.groupBy("template").agg(F.min("body").alias("low"), F.max("body").alias("high"), F.min("doc_id").alias("first"))
    recurring = seen.where("low < high").select("template", "low", "first")
    gone = (
        paths.join(recurring, "template")
        .where(~stays)
        .groupBy(F.col("doc_id").alias("owner"), "body")
        .agg(F.collect_set("line").alias("gone"))
    )
    same = F.col("d.owner").eqNullSafe(F.col("g.owner")) & (F.col("d.body") == F.col("g.body"))
    marked = keyed.alias("d").join(gone.alias("g"), same, "left").select(*[F.col(f"d.{c}") for c in names], "gone")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in marked.drop("gone").schema)
    return marked.mapInArrow(_cut(names), f"{fields}, n_lines long, n_dropped long")
