"""The corpus pipeline: five stages over ``documents``, each written and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stationcast.llm import langid, minhash, mixing, templates
from stationcast.llm.common import DOCUMENT_COLUMNS, key_filter, may_hold, share, stored
from stationcast.llm.queries import prepared, round_trip

# A document is rejected without a language, or where no language gets this much of its positions.
LEAST_LANGUAGE_SCORE = 0.35


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go. The rest keep their columns."""
    docs = docs.select(*DOCUMENT_COLUMNS)
    held = F.coalesce(share("doc_id", 4) == 2, F.lit(False))
    model = langid.train(langid.labelled_segments(docs, ~held))
    return langid.recognised(docs, model, LEAST_LANGUAGE_SCORE)


def with_node(docs: DataFrame) -> DataFrame:
    """A node is an id with a text."""
    return docs.withColumn("node", F.xxhash64("doc_id", "text"))


def drop_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go; so does a document that loses all its text that way.

    Near copies (five words, 0.8) are one family: lines that only they share are not recurring, and a line that
    recurs elsewhere goes from all of them or from none. So the next stage still finds them.
    """
    nodes = with_node(docs.select(*DOCUMENT_COLUMNS))
    found = minhash.near_duplicates(spark, nodes.select(F.col("node").alias("doc_id"), "text"))
    # The first of a family has its own number; only the others are looked up.
    others = found.where("doc_id != component_id").select(F.col("doc_id").alias("node"), "component_id").distinct()
    others = stored(spark, others, "families")
    marked = may_hold(nodes, ["node"], key_filter(spark, others.select("node")))
    looked_up = marked.where("may_hold").join(others, "node", "left").withColumn("family", F.coalesce("component_id", "node"))
    alone = marked.where("not may_hold").withColumn("family", F.col("node"))
    columns = [*DOCUMENT_COLUMNS, "node", "family"]
    cut = templates.drop_lines(looked_up.select(*columns).unionByName(alone.select(*columns)), DOCUMENT_COLUMNS, "node", "family")
    text_left = F.trim("text") != ""
    return cut.where((F.col("n_dropped") == 0) | text_left).withColumn("n_chars", F.length("text").cast("long")).select(*DOCUMENT_COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five words, 0.8) the document with the smallest id stays.

    Texts are compared, not ids: of a repeated id every text that resembles no other stays, and where texts of
    the smallest id are near-duplicates, the one with the smallest digest. Rows with the same id and text are
    one, with the smallest other columns. Rows with a null id all stay.
    """
    nodes = with_node(docs.where("doc_id is not null").select(*DOCUMENT_COLUMNS))
    found = minhash.near_duplicates(spark, nodes.select(F.col("node").alias("doc_id"), "text"))
    groups = found.groupBy(F.col("doc_id").alias("node"), "component_id").agg(F.count("*").alias("rows"))
    ids = stored(spark, nodes.groupBy("node").agg(F.min("doc_id").alias("doc_id")).join(groups, "node"), "groups")
    first = ids.groupBy("component_id").agg(F.min(F.struct("doc_id", "node")).alias("first"))
    # Texts that go, and those with rows to spare. All others pass as they are, without an exchange of texts.
    touched = ids.join(first, "component_id").withColumn("stays", F.col("node") == F.col("first.node")).where("rows > 1 or not stays")
    touched = stored(spark, touched.select("node", "stays"), "touched")
    marked = may_hold(nodes, ["node"], key_filter(spark, touched.select("node")))
    rest = [c for c in DOCUMENT_COLUMNS if c != "text"]
    once = marked.where("may_hold").groupBy("node").agg(F.min("text").alias("text"), F.min(F.struct(*rest)).alias("m"))
    kept = once.join(touched, "node", "left").where("coalesce(stays, true)").select("text", "m.*")
    untouched = marked.where("not may_hold").unionByName(with_node(docs.where("doc_id is null")), allowMissingColumns=True)
    return kept.unionByName(untouched.select(*DOCUMENT_COLUMNS)).select(*DOCUMENT_COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice."""
    mixed = mixing.mix(docs, keep=DOCUMENT_COLUMNS)
    return mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*DOCUMENT_COLUMNS)


def encode_and_decode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of every document of the mix, and digests of its ids and of the text they decode to."""
    return round_trip(spark, docs)


def _stage(fn):
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return fn(prepared(spark), docs, sf_dir)

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    return run


STAGES = [
    ("language_id", _stage(identify_language)),
    ("line_dedup", _stage(drop_recurring_lines)),
    ("near_duplicates", _stage(drop_near_duplicates)),
    ("source_mix", _stage(mix_sources)),
    ("bpe_round_trip", _stage(encode_and_decode)),
]

# A trained network, text templates and BPE have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = prepared(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(spark, stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
