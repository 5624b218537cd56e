"""One query per corpus operator over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from stationcast.llm import alignment, bpe, langid, minhash, mixing, pages, secrets, templates, token_counts, topk, toxicity, vectors, whitening
from stationcast.llm.common import share
from stationcast.session import workspace
from suite.folder import with_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
TOKEN_LIMIT = 2048
ARROW_ROWS = "1000"


def prepared(spark: SparkSession) -> SparkSession:
    """Session settings of the corpus queries: smaller Arrow batches, since one row may hold a long text."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    return with_folder(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(prepared(spark), sf_dir)

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    QUERIES[fn.__name__] = run
    return fn


@query
def op1_language_id(spark, d):
    docs = table(spark, d, "documents")
    held = share("doc_id", 4) == 2
    model = langid.train(langid.labelled_segments(docs, ~F.coalesce(held, F.lit(False))))
    found = langid.predict(docs, model)
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


@query
def op2_exact_top_k(spark, d):
    return topk.top_k(table(spark, d, "embeddings"), F.col("id") % 20 == 0)


@query
def op3_embedding_links(spark, d):
    return vectors.link_vectors(spark, table(spark, d, "embeddings"))


@query
def op4_minhash_near_duplicates(spark, d):
    return minhash.near_duplicates(spark, table(spark, d, "documents"), words=4)


@query
def op5_line_templates(spark, d):
    return templates.drop_lines(table(spark, d, "documents"))


@query
def op6_source_mix(spark, d):
    mixed = mixing.mix(table(spark, d, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


@query
def op7_token_counts(spark, d):
    counted = token_counts.count_tokens(spark, table(spark, d, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


@query
def op8_toxicity(spark, d):
    docs = table(spark, d, "documents")
    held = share("doc_id", 5) == 0
    model = toxicity.learn(spark, docs, table(spark, d, "labels"), ~F.coalesce(held, F.lit(False)))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op9_secret_ledger(spark, d):
    """Two commits: about half of the documents under the earlier rules, then all of them under the present ones."""
    docs = table(spark, d, "documents")
    first = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(2)) == 0)
    commits = [(first, secrets.EARLIER), (docs, secrets.RULES)]
    return secrets.described(secrets.scan_history(spark, commits, workspace(spark, "ledger")))


def round_trip(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Ids and decoded text of every document, with the digests of both."""
    how = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    decoded = bpe.encode_and_decode(spark, docs, *how)
    return decoded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


@query
def op10_bpe_round_trip(spark, d):
    return round_trip(spark, table(spark, d, "documents"))


@query
def op11_whitening(spark, d):
    return whitening.whiten(whitening.integers(table(spark, d, "embeddings")))


@query
def op12_token_alignment(spark, d):
    paths = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return alignment.align(spark, table(spark, d, "documents"), *paths)


@query
def op13_page_text(spark, d):
    return pages.extract(spark, table(spark, d, "pages"))
