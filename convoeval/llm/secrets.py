"""Secret scans with a ledger of blobs, in DataFrame functions.

Every text version is addressed by its SHA-256. The ledger holds which rule versions have seen which
blob and what they found; a scan reads only pairs that are new, and findings come back to all rows that
hold the blob.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from convoeval.llm.common import work_folder


class Rule(NamedTuple):
    kind: str
    version: int
    pattern: str
    group: int = 0  # whose length counts
    least: int = 1


#: Fixed base rules.
BASE = [
    Rule("assign", 1, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", 1, r"[0-9a-f]+", 0, 24),
]
RULES = [
    *BASE,
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("forge", 1, r"gh[pousr]_[A-Za-z0-9]{36,}"),
]
#: What a text must hold for a rule to find anything, where this is quicker to see than a match.
HINTS = {"hex": "[0-9a-f]{24}", "access": "AKIA[A-Z0-9]{16}"}

FINDINGS = "sha string, kind string, version int, start long, end long"
SCANS = "sha string, rules array<string>"


def _read(spark: SparkSession, folder: str, schema: str) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(folder)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def update_ledger(docs: DataFrame, ledger: str, rules: list[Rule] = RULES) -> None:
    """Scan the blobs of ``docs(text)`` that ``ledger`` has not seen under these rule versions.

    Findings are written before the scans they belong to; a run that breaks in between finds the same
    again and readers take equal findings once. A null text is the empty blob.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    blobs = docs.select(F.sha2(text, 256).alias("sha"), text.alias("text")).dropDuplicates(["sha"])
    keys = [f"{r.kind}/{r.version}" for r in rules]
    scans = _read(spark, f"{ledger}/scans", SCANS)
    if scans is None:
        new = blobs.withColumn("todo", F.lit(keys))
    else:
        seen = scans.select("sha", F.explode("rules").alias("rule")).groupBy("sha").agg(F.collect_set("rule").alias("seen"))
        new = blobs.join(seen, "sha", "left").withColumn(
            "todo", F.array_except(F.lit(keys), F.coalesce("seen", F.array().cast("array<string>")))).where(F.size("todo") > 0)
    found = []
    for r, key in zip(rules, keys, strict=True):
        hit = F.array_contains("todo", key) & F.rlike("text", F.lit(HINTS.get(r.kind, r.pattern)))
        whole = F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0))
        found.append(F.when(hit, F.struct(
            F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), F.lit(r.least).alias("least"),
            # between the matches; one piece more than there are matches
            F.transform(F.split("text", r.pattern, -1), lambda x: F.char_length(x)).alias("gap"),
            F.transform(whole, lambda x: F.char_length(x)).alias("size"),
            F.transform(whole if r.group == 0 else F.regexp_extract_all("text", F.lit(r.pattern), F.lit(r.group)), lambda x: F.char_length(x)).alias("value"))))
    rows = new.select("sha", F.explode(F.array_compact(F.array(*found))).alias("x")).select(
        "sha", "x.kind", "x.version", "x.least", F.posexplode(F.arrays_zip("x.gap", "x.size", "x.value")).alias("i", "m")).where("m.size is not null")
    # places are running sums over the matches of one rule in one blob
    upto = Window.partitionBy("sha", "kind", "version").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    spans = rows.withColumn("end", F.sum(F.col("m.gap") + F.col("m.size")).over(upto)).where(F.col("m.value") >= F.col("least")).select(
        "sha", "kind", "version", (F.col("end") - F.col("m.size")).cast("long").alias("start"), F.col("end").cast("long").alias("end"))
    spans.write.mode("append").parquet(f"{ledger}/findings")
    done = docs.select(F.sha2(text, 256).alias("sha")).distinct()
    if scans is not None:
        done = done.join(scans.select("sha", F.explode("rules").alias("rule")).where(F.col("rule").isin(keys)).groupBy("sha").agg(
            F.count_distinct("rule").alias("n")).where(F.col("n") == len(keys)), "sha", "left_anti")
    done.select("sha", F.lit(keys).alias("rules")).write.mode("append").parquet(f"{ledger}/scans")


def scan_secrets(docs: DataFrame, ledger: str | None = None, rules: list[Rule] = RULES) -> DataFrame:
    """``docs(doc_id, text)`` as (doc_id, sha, findings), the findings of ``rules`` by start and rule.

    ``findings`` holds (start, place of the rule in ``rules``, kind, end), leftmost and without overlap
    within a rule, in code points with the end exclusive. Without a ``ledger`` folder a new one is begun.
    A null text is the empty text; every row of ``docs`` gives one row, repeated rows too; no rows give
    none. Other columns are not read.
    """
    spark = docs.sparkSession
    ledger = ledger or work_folder(spark, "secret-ledger")
    update_ledger(docs, ledger, rules)
    order = spark.createDataFrame([(i, r.kind, r.version) for i, r in enumerate(rules)], "place int, kind string, version int")
    known = _read(spark, f"{ledger}/findings", FINDINGS)
    by_blob = known.join(F.broadcast(order), ["kind", "version"]).groupBy("sha").agg(
        F.array_sort(F.collect_set(F.struct("start", "place", "kind", "end"))).alias("findings"))
    paths = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    empty = F.array().cast("array<struct<start:bigint,place:int,kind:string,end:bigint>>")
    return paths.join(by_blob, "sha", "left").select("doc_id", "sha", F.coalesce("findings", empty).alias("findings"))
