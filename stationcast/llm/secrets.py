"""Secret scans over an incremental ledger of blobs. DataFrame operations only.

A text is a blob with its SHA-256 as address; the same text under many paths or in many versions is one
blob. The ledger has one row per (blob, rule, version of the rule) that was ever scanned, with the spans
found, none included. A scan takes the blobs whose pairs are not in the ledger yet, looks for just those
rules in them, appends the rows, and joins findings back to every path. Copies are dropped before the
exchange (per task) and after it, so a blob with very many paths costs one scan.

Spans are code points, end exclusive. A rule's pattern is matched leftmost, without overlap: one anchored
expression gives the gap before each match and the match, and running sums of their lengths give the spans.

Null texts count as empty: no spans. Every input row gives one row, repeated ids included; extra columns are
not read. Two scans of one ledger at a time are not meant to be run.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

LEDGER = "blob string, rule string, version int, spans array<struct<start:long, end:long>>"


@dataclass(frozen=True)
class Rule:
    """``pattern`` without outer group; ``secret`` is the group (0: whole match) that needs ``least`` characters."""

    name: str
    pattern: str
    version: int = 1
    secret: int = 0
    least: int = 1


# Base rules. Minimum lengths of ``access`` and ``hex`` are in the pattern: a run that is too
# short holds no longer one, so the spans are the same as when short runs are matched and dropped.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", secret=2, least=6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
ADDED = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("personal", r"gh[pousr]_[A-Za-z0-9]{36,}"),
)
RULES = BASE + ADDED
# The rules before ``personal`` learned longer tokens.
EARLIER = BASE + (ADDED[0], Rule("personal", r"gh[pousr]_[A-Za-z0-9]{36}", version=0))


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _ledger(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], LEDGER)
        raise


def _matches(rule: Rule) -> Column:
    """Gaps, matches and secrets of a rule in ``text``; null where it finds nothing."""
    whole = F.lit(rf"(?s)\G(.*?)({rule.pattern})")
    get = lambda group: F.regexp_extract_all(F.col("text"), whole, F.lit(group))
    zipped = F.arrays_zip(get(1).alias("gap"), get(2).alias("hit"), get(2 + rule.secret).alias("secret"))
    return F.when(F.col("text").rlike(rule.pattern), zipped)


def new_findings(spark: SparkSession, df: DataFrame, ledger: DataFrame, rules=RULES) -> DataFrame:
    """Ledger rows for the (blob, rule, version) triples of ``df`` (text) that ``ledger`` lacks."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    blobs = df.select(blob_id(text).alias("blob"), text.alias("text")).groupBy("blob").agg(F.first("text").alias("text"))
    current = ledger.groupBy("blob").agg(F.collect_set(F.struct("rule", "version")).alias("done"))
    pending = blobs.join(current, "blob", "left")
    todo = []
    for rule in rules:
        known = F.array_contains("done", F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.version).alias("version")))
        unseen = F.col("done").isNull() | ~known
        row = F.struct(
            F.lit(rule.name).alias("rule"), F.lit(rule.version).alias("version"), F.lit(rule.least).alias("least"), _matches(rule).alias("found")
        )
        todo.append(F.when(unseen, row))
    scanned = pending.select("blob", F.explode(F.array_compact(F.array(*todo))).alias("s")).select("blob", "s.*")
    pieces = scanned.select("blob", "rule", "version", "least", F.posexplode_outer("found").alias("nth", "m"))
    upto = Window.partitionBy("blob", "rule", "version").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.length("m.gap") + F.length("m.hit")).over(upto)
    spans = pieces.select("blob", "rule", "version", "least", "m", end.cast("long").alias("end"))
    span = F.struct((F.col("end") - F.length("m.hit")).cast("long").alias("start"), "end")
    real = F.length("m.secret") >= F.col("least")
    return spans.groupBy("blob", "rule", "version").agg(F.array_sort(F.collect_list(F.when(real, span))).alias("spans"))


def scan(spark: SparkSession, df: DataFrame, ledger_path: str, rules=RULES, id_col: str = "doc_id") -> DataFrame:
    """Scan what is new in ``df`` (id, text), then give (id, blob, rule, spans) of every path with findings under ``rules``."""
    new_findings(spark, df, _ledger(spark, ledger_path), rules).write.mode("append").parquet(ledger_path)
    wanted = F.lit(False)
    for rule in rules:
        wanted |= (F.col("rule") == rule.name) & (F.col("version") == rule.version)
    found = spark.read.schema(LEDGER).parquet(ledger_path).where(wanted & (F.size("spans") > 0))
    paths = df.select(F.col(id_col).alias("doc_id"), blob_id(F.col("text").cast("string")).alias("blob"))
    per_blob = found.groupBy("blob").agg(F.collect_list(F.struct("rule", "spans")).alias("found"))
    return paths.join(per_blob, "blob", "left").select("doc_id", "blob", "found")


def scan_history(spark: SparkSession, commits: list[tuple[DataFrame, tuple[Rule, ...]]], ledger_path: str) -> DataFrame:
    """Scan (documents, rules in force) of every commit in turn; the paths of the last one with their findings.

    A later commit costs what it adds: blobs that no commit held, and rules whose version is new.
    """
    for docs, rules in commits:
        found = scan(spark, docs, ledger_path, rules)
    return found


def described(found: DataFrame, rules=RULES) -> DataFrame:
    """Counts per base kind, the digest of the base spans, and all spans as text, from the rows of ``scan``."""
    names = [r.name for r in rules]
    place = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))])
    flat = F.flatten(
        F.transform(
            F.coalesce("found", F.array().cast("array<struct<rule:string, spans:array<struct<start:long, end:long>>>>")),
            lambda f: F.transform(f["spans"], lambda s: F.struct(s["start"].alias("start"), place[f["rule"]].alias("place"), s["end"].alias("end"), f["rule"].alias("rule"))),
        )
    )
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["rule"], s["start"], s["end"])), ",")
    rows = found.withColumn("all", F.array_sort(flat))
    base = F.filter("all", lambda s: s["place"] < len(BASE))
    of = lambda name: F.filter("all", lambda s: s["rule"] == name)
    counts = [F.size(of(r.name)).cast("long").alias(f"n_{r.name}") for r in BASE]
    return rows.select("doc_id", *counts, F.sha2(text(base), 256).alias("base_sha256"), text(F.col("all")).alias("spans"))
