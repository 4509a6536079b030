"""Readers for samples, dialogues, question files, responses and evaluations.

Every reader has a fixed schema: no inference pass, missing fields are NULL. Files
are one JSON array each, or with ``lines`` one object per line, which Spark can split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUESTION = "array<struct<qid:string,query:string,answer:string,position:int,category:string>>"
SAMPLE = f"task_id string, questions {QUESTION}, chunks array<string>"
TURNS = "array<struct<speaker:string,text:string,blip_caption:string>>"
RESPONSE = (
    "qid string, query string, expected_answer string, response string, generation_time double, "
    "intermediate_paths string, tool_call_stats map<string,map<string,int>>"
)
EVALUATION = f"{RESPONSE}, metric map<string,double>, evaluation_time double"
BROKEN = "_corrupt_record"


def read_samples(
    spark: SparkSession, path: str, data_source: str, column: str = "data_source"
) -> DataFrame:
    """Rows of one source; the filter reaches the parquet scan. Empty is an error."""
    rows = spark.read.parquet(path).where(F.col(column) == data_source)
    if not rows.limit(1).count():
        raise ValueError(f"no rows for data source '{data_source}' in {path}")
    return rows


def read_canonical(spark: SparkSession, path: str, small: bool = False) -> DataFrame:
    """Stored samples as JSON array files or parquet; ``small`` reads the small sets."""
    if small:
        head, _, tail = path.rpartition("/")
        path = f"{head}/small_valsets/{tail}" if head else f"small_valsets/{tail}"
    if path.rstrip("/").endswith((".json", ".jsonl")):
        return spark.read.schema(SAMPLE).option("multiLine", not path.endswith("l")).json(path)
    return spark.read.parquet(path)


def to_long(samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nested samples as the two long tables chunks and questions."""
    chunks = samples.select("task_id", F.posexplode("chunks").alias("position", "text"))
    questions = samples.select("task_id", F.posexplode("questions").alias("ord", "q")).select(
        "task_id", "ord", "q.*"
    )
    return chunks, questions


def read_session_dialogues(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """Dialogues whose sessions sit under ``session_N`` keys.

    Returns turns ``(sample_id, session, date, speaker_a, speaker_b, turn, speaker,
    text, caption)`` in numeric session order, and questions.
    """
    schema = (
        "sample_id string, session_summary map<string,string>, conversation map<string,string>, "
        "qa array<struct<question:string,answer:string,adversarial_answer:string,category:int,"
        "evidence:array<string>>>"
    )
    raw = spark.read.schema(schema).option("multiLine", not lines).json(path)
    talk = F.col("conversation")
    sessions = raw.select(
        "sample_id", talk["speaker_a"].alias("speaker_a"), talk["speaker_b"].alias("speaker_b"),
        talk.alias("_talk"), F.explode(F.map_keys(talk)).alias("_key"),
    ).where(F.col("_key").rlike(r"^session_\d+$"))
    sessions = sessions.select(
        "sample_id", "speaker_a", "speaker_b",
        F.regexp_extract("_key", r"(\d+)$", 1).cast("int").alias("session"),
        F.try_element_at("_talk", F.concat("_key", F.lit("_date_time"))).alias("date"),
        F.from_json(F.try_element_at("_talk", F.col("_key")), TURNS).alias("_turns"),
    )
    turns = sessions.select(
        "sample_id", "session", "date", "speaker_a", "speaker_b", F.posexplode("_turns").alias("turn", "_t")
    ).select(
        "sample_id", "session", "date", "speaker_a", "speaker_b", "turn", "_t.speaker", "_t.text",
        F.col("_t.blip_caption").alias("caption"),
    )
    questions = raw.select(
        "sample_id", F.size("session_summary").alias("n_sessions"), F.posexplode("qa").alias("ord", "_q")
    ).select(
        "sample_id", "n_sessions", "ord", F.concat_ws("_", "sample_id", "ord").alias("qid"),
        F.col("_q.question").alias("query"), "_q.answer", "_q.adversarial_answer", "_q.category", "_q.evidence",
    )
    return turns, questions


def read_haystack_dialogues(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """Haystack dialogues: sessions zipped with dates by ordinal, empty ones dropped."""
    schema = (
        "question_id string, question_type string, question string, answer string, question_date string, "
        "haystack_sessions array<array<struct<role:string,content:string>>>, haystack_dates array<string>"
    )
    raw = spark.read.schema(schema).option("multiLine", not lines).json(path)
    dated = raw.select("question_id", "haystack_dates", F.posexplode("haystack_sessions").alias("session", "_t"))
    turns = dated.where(F.size("_t") > 0).select(
        "question_id", "session",
        F.coalesce(F.get("haystack_dates", F.col("session")), F.lit("Unknown")).alias("date"),
        F.posexplode("_t").alias("turn", "_x"),
    ).select("question_id", "session", "date", "turn", "_x.role", F.col("_x.content").alias("text"))
    full = F.size(F.filter("haystack_sessions", lambda s: F.size(s) > 0))
    questions = raw.select(
        F.col("question_id").alias("task_id"), F.concat(F.lit("["), "question_date", F.lit("] "), "question").alias("query"),
        "answer", (full - 1).alias("position"), F.col("question_type").alias("category"),
    )
    return turns, questions


def read_persona_dialogues(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """Earlier dialogs plus the current one, and the self-instruct question.

    The speaker of an earlier turn follows its ordinal.
    """
    schema = (
        "metadata struct<initial_data_id:string>, previous_dialogs array<struct<dialog:array<struct<text:string>>>>, "
        "dialog array<struct<id:string,text:string>>, self_instruct struct<A:string,B:string>"
    )
    raw = spark.read.schema(schema).option("multiLine", not lines).json(path).withColumn(
        "task_id", F.col("metadata.initial_data_id")
    )
    earlier = raw.select("task_id", F.posexplode("previous_dialogs").alias("session", "_d")).select(
        "task_id", "session", F.posexplode("_d.dialog").alias("turn", "_t")
    ).select(
        "task_id", "session", "turn",
        F.when(F.col("turn") % 2 == 0, "Speaker 1").otherwise("Speaker 2").alias("speaker"), "_t.text",
    )
    current = raw.select(
        "task_id", F.size("previous_dialogs").alias("session"), F.posexplode("dialog").alias("turn", "_t")
    ).select("task_id", "session", "turn", F.col("_t.id").alias("speaker"), "_t.text")
    questions = raw.select(
        "task_id", F.col("self_instruct.B").alias("query"), F.col("self_instruct.A").alias("answer"),
        F.size("previous_dialogs").alias("position"), F.lit("memory-recall").alias("category"),
    )
    return earlier.unionByName(current), questions


def read_json_tree(
    spark: SparkSession, folder: str, schema: str, marker: str, lines: bool = False
) -> DataFrame:
    """All JSON files below a folder; category = path segment after ``marker``."""
    rows = (
        spark.read.schema(schema).option("multiLine", not lines).option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.json").json(folder)
    )
    path = F.col("_metadata.file_path")
    found = F.regexp_extract(path, rf"/{marker}/([^/]+)", 1)
    return rows.select(
        "*", F.when(found != "", found).otherwise("unknown").alias("category"),
        _without_end(F.substring_index(path, "/", -1), ".json").alias("file_name"),
    )


def _without_end(name: Column, end: str) -> Column:
    return F.left(name, F.length(name) - len(end))


def _file_of(kind: str) -> tuple[Column, Column]:
    """Corpus folder and stem of a file below ``<corpus>/<kind>/``, or of a folder that Spark wrote for it.

    Worked out for every row: by cuts at slashes, as a search for a long name tries each place of the path.
    """
    path = F.col("_metadata.file_path")
    below = F.substring_index(path, f"/{kind}/", -1)
    above = F.left(path, F.length(path) - F.length(below) - len(f"/{kind}/"))
    name = F.url_decode(F.substring_index(below, "/", 1))
    plural = f"_{kind}s.json"
    stem = F.when(F.endswith(name, F.lit(plural)), _without_end(name, plural)).otherwise(_without_end(name, f"_{kind}.json"))
    return F.substring_index(above, "/", -1), stem


def read_qa_files(spark: SparkSession, folder: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """Question and answer file families; the type is the stem of the file name.

    Names may end in the singular or the plural. The corpus is the folder name.
    """

    def read(kind: str, schema: str) -> DataFrame:
        rows = (
            spark.read.schema(schema).option("multiLine", not lines)
            .json(f"{folder}/*/{kind}/*_{{{kind},{kind}s}}.json")
        )
        corpus, stem = _file_of(kind)
        return rows.select(corpus.alias("corpus"), stem.alias("type"), *rows.columns)

    return read("question", "id string, question string"), read("answer", "id string, answer string")


def read_responses(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Response lines; bad lines are skipped, or an error when ``strict``."""
    reader = spark.read.schema(f"{RESPONSE}, {BROKEN} string")
    if strict:
        return spark.read.schema(RESPONSE).option("mode", "FAILFAST").json(path)
    rows = reader.option("columnNameOfCorruptRecord", BROKEN).json(path)
    return rows.where(F.col(BROKEN).isNull() & F.col("response").isNotNull()).drop(BROKEN)


def _agent(prefix: str) -> Column:
    name = F.regexp_extract(F.col("_metadata.file_path"), rf"/{prefix}([^/]*)\.jsonl(?:/[^/]*)?$", 1)
    return F.regexp_replace(name, r"(?<=.)_\d+$", "")


def _task(prefix: str) -> Column:
    return F.regexp_extract(F.col("_metadata.file_path"), rf"/([^/]+)/{prefix}[^/]*\.jsonl(?:/[^/]*)?$", 1)


def read_evaluations(spark: SparkSession, results: str) -> DataFrame:
    """All evaluated files of all tasks with task and agent from the path.

    A result may be one file or, as Spark writes it, a folder of that name.
    """
    rows = spark.read.schema(EVALUATION).json(f"{results}/*/evaluated_*.jsonl")
    return rows.select(_task("evaluated_").alias("task"), _agent("evaluated_").alias("agent"), *rows.columns)


def long_metrics(evaluations: DataFrame) -> DataFrame:
    """One row per metric of an evaluation record."""
    return evaluations.select("task", "agent", "qid", F.explode("metric").alias("metric", "value"))


def discover_outputs(spark: SparkSession, results: str, prefix: str = "responses_") -> DataFrame:
    """Task and agent of every output file; hidden task folders are left out."""
    files = spark.read.format("binaryFile").load(f"{results}/*/{prefix}*.jsonl").select("_metadata")
    return files.select(_task(prefix).alias("task"), _agent(prefix).alias("agent")).where(
        ~F.col("task").startswith(".")
    ).distinct()


def read_ignore_list(spark: SparkSession, path: str) -> DataFrame:
    """Names of an ignore file; blank lines and comments are dropped."""
    lines = spark.read.text(path).where(~F.col("value").startswith("#"))
    return lines.select(F.trim("value").alias("name")).where("name <> ''").distinct()


def stream_turns(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    """Turns of a growing parquet folder, a few files at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
