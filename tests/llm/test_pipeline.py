"""The pipeline's stages against their operators and brute force on a small table."""

import random

import corpus_pipeline
from pyspark.sql import functions as F

from stationcast.llm import langid, mixing
from stationcast.llm.common import DOCUMENT_COLUMNS

SF = "/root/testdata/sf0.001"


def test_stages_keep_their_contract(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(150)
    odd = spark.createDataFrame([(9000, None, None, None, None), (9001, "12 34", "en", "s", 5)], docs.schema)
    docs = docs.unionByName(odd).withColumn("copies", F.lit("clash"))
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, SF)
        found = docs.toPandas()
        docs = spark.createDataFrame(found, docs.schema) if name != "bpe_round_trip" else docs
        seen[name] = (before, found)
        if name != "bpe_round_trip":
            assert list(found.columns) == DOCUMENT_COLUMNS
    kept = set(seen["language_id"][1].doc_id)
    assert not kept & {9000, 9001} and len(kept) >= 145
    lines = seen["line_dedup"][1]
    assert (lines.text.str.len() == lines.n_chars).all()
    assert not seen["near_duplicates"][1].doc_id.duplicated().any()
    copies = {r.doc_id: r.copies for r in mixing.mix(seen["source_mix"][0]).collect()}
    taken = seen["source_mix"][1].doc_id.value_counts().to_dict()
    assert taken == {k: v for k, v in copies.items() if v}
    assert len(seen["bpe_round_trip"][1]) == len(seen["source_mix"][1])
    assert langid.UNKNOWN == "und"


def test_near_duplicates_keep_null_ids_and_texts_of_repeated_ids(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    data = [(None, a), (None, a), (None, b), (3, a), (5, a), (5, b), (5, b + " more"), (5, c), (5, c), (7, c), (8, d), (9, None), (9, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in data], "doc_id long, text string, lang string, source string, n_chars long")
    found = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()]
    bs = [t for i, t in found if i == 5 and t.startswith("b0 ")]
    assert len(bs) == 1 and bs[0] in (b, b + " more")
    want = [(None, a), (None, a), (None, b), (3, a), (5, bs[0]), (5, c), (8, d), (9, None), (9, "")]
    assert sorted(map(str, found)) == sorted(map(str, want))


def lines_of(rng, n):
    syllable = lambda: rng.choice("bdfgklmnprst") + rng.choice("aeiou")
    return [" ".join(syllable() + syllable() + syllable() for _ in range(12)) for _ in range(n)]


def through(spark, docs, *names):
    for name, stage in corpus_pipeline.STAGES:
        if name in names:
            docs = stage(spark, docs, SF)
            docs = spark.createDataFrame(docs.toPandas(), docs.schema)
    return {r.doc_id: r.text for r in docs.collect()}


def test_near_copies_do_not_survive_the_line_stage(spark):
    rng = random.Random(3)
    notice = "this notice stands on every page of the whole archive"
    data, copies = [], set()
    for i in range(0, 60, 3):
        own = lines_of(rng, 20)
        data.append((i, "\n".join([*own, notice])))
        if i % 2:
            # A near copy with one other line, and an exact one.
            data += [(i + 1, "\n".join([*own[:9], *lines_of(rng, 1), *own[10:], notice])), (i + 2, "\n".join([*own, notice]))]
            copies |= {i + 1, i + 2}
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in data], "doc_id long, text string, lang string, source string, n_chars long")
    found = through(spark, docs, "line_dedup", "near_duplicates")
    assert set(found) == {i for i, _ in data} - copies
    # The notice of many unrelated texts is cut from all but one of them, and nothing else is.
    whole = dict(data)
    assert sum(notice in t for t in found.values()) <= 1
    assert all(t.replace("\n" + notice, "") == whole[i].replace("\n" + notice, "") for i, t in found.items())


def test_stages_on_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert through(spark, docs, "line_dedup", "near_duplicates", "source_mix") == {}
