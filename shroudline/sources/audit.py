"""Audit logs and backup manifests: reading and writing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.checkpoints import ensure_checkpoint_dir

#: Fields that replay needs; other fields of a line are tolerated.
EVENT = (
    "event string, session_id string, input_path string, output_path string, ts string, ts_start string, page int, word_start int, word_end int, kind string, "
    "confidence string, source string, bbox array<double>, text_sha256 string, context_sha256 string, decision string, status string, verify_result string"
)

#: Version of the lines' form, and of the library that writes them.
SCHEMA_VERSION, ENGINE_VERSION = 1, "0.2"


def parse_lines(lines: DataFrame) -> DataFrame:
    """lines (session_key, line_no, value) to events; blank lines go, and a line that is no JSON object is marked corrupt."""
    events = lines.where(F.trim("value") != "").withColumn("e", F.from_json("value", f"{EVENT}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}))
    return events.select("session_key", "line_no", "e.*")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Events of the NDJSON files under path, one session a file; ValueError names the first malformed line.

    A file is one row of the scan, so that its lines keep their order and number whatever reads it.
    Logs are small, one for each document; a log that a single task can't hold belongs into a table.
    The checks and all readers share one checkpointed pass.
    """
    ensure_checkpoint_dir(spark)
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("session_key"), "value")
    lines = files.select("session_key", F.posexplode(F.split("value", "\n")).alias("at", "value"))
    events = parse_lines(lines.select("session_key", (F.col("at") + 1).alias("line_no"), "value")).checkpoint()
    if bad := events.where("_corrupt IS NOT NULL").orderBy("session_key", "line_no").select("session_key", "line_no").first():
        raise ValueError(f"{bad['session_key']}: line {bad['line_no']}: malformed JSON")
    # Files without any line have no event either.
    begun = events.where("event = 'session_start'").select("session_key").distinct()
    if lost := files.select("session_key").join(begun, "session_key", "left_anti").first():
        raise ValueError(f"{lost['session_key']}: no session_start event")
    return events.drop("_corrupt")


def sessions(events: DataFrame, first: bool = False) -> DataFrame:
    """The session_start of each log: the last one counts in replay, the first one (``first``) where a log is only identified."""
    starts = events.where("event = 'session_start'")
    pick = F.min_by if first else F.max_by
    row = F.struct("session_id", "input_path", "output_path", "ts_start")
    return starts.groupBy("session_key").agg(pick(row, "line_no").alias("s")).select("session_key", "s.*")


def line(*fields: Column | str) -> Column:
    """An event as one compact line of JSON; fields that are null stay."""
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def finding_line(f: Column, page: Column, ts: str, include_text: bool = False) -> Column:
    """The line of a finding f (a struct as plans.run.facts has it)."""
    names = ["bbox", "text_length", "text_sha256", "context_sha256"]
    fields = [F.lit("finding").alias("event"), F.lit(ts).alias("ts"), page.alias("page"), *[f[c].alias(c) for c in ("word_start", "word_end", "kind", "confidence", "source", *names)]]
    fields += [F.lit("applied").alias("decision"), F.lit("auto").alias("reviewer")]
    return line(*fields, *[f[c].alias(c) for c in ("text", "context") if include_text])


def event_line(event: str, ts: str, *fields: Column) -> Column:
    """The line of any other event."""
    return line(F.lit(event).alias("event"), F.lit(ts).alias("ts"), *fields)


#: Fields of a model call in its line.
CALL_FIELDS = (
    "chunk_idx", "pages", "temperature", "seed_requested", "seed_honored", "system_fingerprint", "prompt_sha256", "response_sha256",
    "tokens_in", "tokens_out", "duration_ms", "page_word_range", "cache_creation_input_tokens", "cache_read_input_tokens",
)


def call_line(ts: str) -> Column:
    """The line of a model call (a row of providers.call_records)."""
    return event_line("chunk_request", ts, *map(F.col, CALL_FIELDS))


def session_status(passed: Column, leaks: Column) -> Column:
    """struct<status, verify_result> of a session's end."""
    return (
        F.when(passed, F.struct(F.lit("ok").alias("status"), F.lit("pass").alias("verify_result")))
        .when(leaks > 0, F.struct(F.lit("verify_failed").alias("status"), F.lit("fail").alias("verify_result")))
        .otherwise(F.struct(F.lit("failed").alias("status"), F.lit("skipped").alias("verify_result")))
    )


def write(lines: DataFrame, path: str, buckets: int = 64) -> None:
    """Append sessions (session_id, ord, value) as lines of JSON that name their session and place; sessions are dealt into buckets, so that there are as many files."""
    bucket = F.pmod(F.xxhash64("session_id"), F.lit(buckets)).alias("bucket")
    named = lines.select(bucket, "session_id", "ord", "value").repartition(buckets, "bucket").sortWithinPartitions("bucket", "session_id", "ord")
    row = F.to_json(F.struct(F.col("session_id").cast("string").alias("session_id"), "ord", "value"))
    named.select("bucket", row.alias("value")).write.mode("append").partitionBy("bucket").text(path)


def read_written(spark: SparkSession, path: str) -> DataFrame:
    """Events of what write has written, of any number of sessions: session_key is the session's id, line_no its place. A line is found wherever a file is split."""
    rows = spark.read.text(path).select(F.from_json("value", "session_id string, ord long, value string").alias("r")).select("r.*")
    return parse_lines(rows.select(F.col("session_id").alias("session_key"), F.col("ord").alias("line_no"), "value")).drop("_corrupt")


def export(lines: DataFrame, path: str) -> None:
    """Write sessions as logs that read takes: one folder a session, lines in order. For as many sessions as one wants folders."""
    lines.repartition("session_id").sortWithinPartitions("session_id", "ord").select("session_id", "value").write.mode("append").partitionBy("session_id").text(path)


def read_backups(spark: SparkSession, root: str) -> DataFrame:
    """(session_dir, ts, original_path, copy_path) of the manifests under root/<session>/manifest.json."""
    raw = spark.read.schema("timestamp string, original_path string, copy_path string").json(f"{root}/*/manifest.json", multiLine=True)
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)/manifest\.json$", 1)
    return raw.select(name.alias("session_dir"), backup_time(name).alias("ts"), "original_path", "copy_path")


def backup_time(name: Column) -> Column:
    """Time of a backup folder's name, whose first twenty characters are the time; null if they aren't."""
    return F.try_to_timestamp(F.substring(name, 1, 20), F.lit("yyyy-MM-dd'T'HH-mm-ss'Z'"))
