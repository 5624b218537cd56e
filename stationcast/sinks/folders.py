"""A new table of many folders on a local file system, without a process for each of them.

Hadoop's local file system without its native library starts a ``chmod`` for every folder it makes and twice for
every file: five processes for a station's month, most of what such a folder costs. Here the tasks write the files
themselves, with the same folders, names and compression; the table appears whole, by one rename.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from stationcast.sinks.files import _place, remove

# As Spark names folders.
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"
ESCAPED = {c: f"%{c:02X}" for c in [*range(1, 0x20), *map(ord, "\"#%'*/:=?\\{[]^"), 0x7F]}
ROW_GROUP_BYTES = 64 << 20


def local_path(spark: SparkSession, path: str) -> str | None:
    """The path in the local file system; none where ``path`` is in another one."""
    fs, at = _place(spark, path)
    return fs.makeQualified(at).toUri().getPath() if fs.getUri().getScheme() == "file" else None


def write_new(df: DataFrame, parts: Sequence[str], order: Sequence[str], path: str) -> None:
    """Parquet files of ``df`` in folders ``parts``, in each file sorted by ``order``, as a new local folder ``path``.

    Rows are dealt by folder; a folder has a file for each task that holds rows of it. A task that runs again writes
    its files again under the same names, so attempts never add up. Until all tasks are done the files are in a
    hidden folder beside ``path``.
    """
    spark = df.sparkSession
    run_id = uuid.uuid4().hex
    hidden = os.path.join(os.path.dirname(path.rstrip("/")), f".{os.path.basename(path.rstrip('/'))}-{run_id}")
    kept = df.drop(*parts)
    keys, escaped, no_value, group = list(parts), ESCAPED, NO_VALUE, ROW_GROUP_BYTES
    footer = {"org.apache.spark.version": spark.version, "org.apache.spark.sql.parquet.row.metadata": kept.schema.json()}

    # Pickled whole: workers need nothing of this package.
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        import pyarrow.parquet as pq
        from pyspark import TaskContext

        task = TaskContext.get()
        name = f"part-{task.partitionId():05d}-{run_id}.snappy.parquet"

        def runs() -> Iterator[tuple[tuple, pa.RecordBatch]]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                new = np.zeros(batch.num_rows, bool)
                new[0] = True
                for k in keys:
                    codes = pc.dictionary_encode(batch.column(k), null_encoding="encode").indices.to_numpy()
                    new[1:] |= codes[1:] != codes[:-1]
                starts = np.flatnonzero(new)
                firsts = zip(*(batch.column(k).take(pa.array(starts)).to_pylist() for k in keys))
                values = batch.select([c for c in batch.schema.names if c not in keys])
                for key, start, end in zip(firsts, starts.tolist(), [*starts[1:].tolist(), batch.num_rows]):
                    yield key, values.slice(start, end - start)

        def write_file(key: tuple, first: pa.RecordBatch, rest: Iterator[tuple[tuple, pa.RecordBatch]]):
            folder = os.path.join(hidden, *(f"{k}={v.translate(escaped) if v else no_value}" for k, v in zip(keys, key)))
            os.makedirs(folder, exist_ok=True)
            made = os.path.join(folder, f".{name}.{task.taskAttemptId()}")
            try:
                with pa.OSFile(made, "wb") as out:
                    with pq.ParquetWriter(out, first.schema, compression="snappy", store_schema=False) as writer:
                        held, after = [first], next(rest, None)
                        while after and after[0] == key:
                            if sum(h.nbytes for h in held) >= group:
                                writer.write_table(pa.Table.from_batches(held))
                                held = []
                            held.append(after[1])
                            after = next(rest, None)
                        writer.write_table(pa.Table.from_batches(held))
                        writer.add_key_value_metadata(footer)
                os.replace(made, os.path.join(folder, name))
            except BaseException:
                if os.path.exists(made):
                    os.remove(made)
                raise
            return after

        rest = runs()
        at = next(rest, None)
        n = 0
        while at:
            at = write_file(*at, rest)
            n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["files"])

    os.makedirs(hidden)
    try:
        # An empty value names the same folder as a missing one.
        rows = df.withColumns({k: F.when(F.col(k) != "", F.col(k)) for k in keys})
        dealt = rows.hint("rebalance", *keys).sortWithinPartitions(*keys, *order)
        dealt.mapInArrow(write, "files long").write.mode("append").format("noop").save()
        open(os.path.join(hidden, "_SUCCESS"), "w").close()
        os.rename(hidden, path)
    except BaseException:
        remove(spark, hidden)
        raise
