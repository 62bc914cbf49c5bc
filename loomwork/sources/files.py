"""Log, calendar and document files."""

from __future__ import annotations

import tempfile

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "event_type string, timestamp string, content_type string, week_number int, output_file string, provider string, model string, input_tokens long, output_tokens long, cost_usd double, filename string, source_format string, pdf_method string, error_type string, passed boolean, term string, source_term string, target_term string, flag_count int"
CALENDAR = "terms array<struct<term:string,start:date,end:date,no_class_dates:array<struct<label:string,date:date,date_start:date,date_end:date>>>>"


def read_log(spark: SparkSession, path: str, fail: bool = False, allow_tail: bool = False) -> tuple[DataFrame, DataFrame]:
    """(events, corrupt rows) of a JSON-lines log; a log that isn't there is empty, blank lines are skipped.

    A corrupt row has ``is_tail``: whether it is the last line of its file and no newline ends it, as while it is being written; it
    is read whole next time. With ``fail`` a corrupt line is an error, with ``allow_tail`` such a tail isn't. That a file ends without a newline is told by its size,
    which then is one byte less than its lines and their ends (files that aren't compressed).
    """
    schema = f"{EVENT}, _corrupt string"
    try:
        raw = spark.read.option("lineSep", "\n").text(path)
        placed = raw.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id")).alias("at"))
        lines = placed.where("trim(value) <> ''").select(F.from_json("value", schema, {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"}).alias("e"), "file", "at").select("e.*", "file", "at")
        ends = placed.groupBy("file").agg((F.sum(F.octet_length("value") + 1) == F.max("size") + 1).alias("open"), F.max("at").alias("last"))
        corrupt = lines.where("_corrupt is not null").select("_corrupt", "file", "at").join(ends, "file")
        bad = corrupt.select("_corrupt", (F.col("open") & (F.col("at") == F.col("last"))).alias("is_tail"))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        lines = spark.createDataFrame([], f"{schema}, file string, at long")
        bad = spark.createDataFrame([], "_corrupt string, is_tail boolean")
    if fail and (bad.where("not is_tail") if allow_tail else bad).limit(1).count():
        raise ValueError("the log has a corrupt line")
    good = lines.where("_corrupt is null").drop("_corrupt", "file", "at").withColumn("ts", F.to_timestamp("timestamp"))
    return good, bad


def read_markdown(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(lines, rejected files) of a folder of markdown files: (path, line_no, text) with line ends of any kind, and (path,
    error_code) of files that aren't UTF-8. A byte order mark at the start is no text; an empty file has no lines."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").load(path).select("path", F.coalesce("content", F.lit("").cast("binary")).alias("content"))
    sound = F.is_valid_utf8(F.col("content").cast("string"))
    text = F.regexp_replace(F.col("content").cast("string"), "^\ufeff", "")
    lines = files.where(sound).select("path", F.posexplode(F.split(text, "\r\n|\r|\n")).alias("line_no", "text"))
    return lines, files.where(~sound).select("path", F.lit("not_utf8").alias("error_code"))


def append_log(events: DataFrame, path: str) -> None:
    """Append events as JSON lines, with a UTC time where there is none; null fields aren't written."""
    stamp = F.date_format(F.coalesce(F.to_timestamp("timestamp"), F.current_timestamp()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    events.withColumn("timestamp", stamp).select(F.to_json(F.struct("*")).alias("value")).write.mode("append").text(path)


def read_calendar(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """S3: (terms, no_class) tables of a calendar file, in file order."""
    terms = spark.read.schema(CALENDAR).option("multiLine", True).json(path).select(F.posexplode("terms").alias("pos", "t"))
    entries = terms.select(F.col("t.term").alias("term"), F.posexplode("t.no_class_dates").alias("pos", "e"))
    return (
        terms.select(F.col("t.term").alias("term"), "pos", F.col("t.start").alias("start_date"), F.col("t.end").alias("end_date")),
        entries.select("term", "pos", F.col("e.label").alias("label"), F.col("e.date").alias("day"), F.col("e.date_start").alias("date_start"), F.col("e.date_end").alias("date_end")),
    )


def write_documents(documents: DataFrame, path: str, key: str) -> None:
    """One folder per key with its text, so a course's brief or page can be picked up alone."""
    documents.select(key, "content").write.mode("overwrite").partitionBy(key).text(path)


MOST_ROWS = 100_000


def small(configuration: DataFrame) -> DataFrame:
    """Broadcast a calendar, rates or names after a check of their size; a larger table is joined as it is."""
    return F.broadcast(configuration) if configuration.limit(MOST_ROWS + 1).count() <= MOST_ROWS else configuration


DEALT = 10_000  # rows in one part of a table whose rows grow to a schedule each


def dealt(table: DataFrame, key: str, rows: int = DEALT) -> DataFrame:
    """A table dealt out by a key in parts of about so many rows, before its rows grow to many or are gathered.

    A few files of narrow rows are read by a few tasks, which would make and hold all that comes of them. The number of parts
    follows the rows, so a task's share doesn't grow with the table; what is grouped or ordered by the key stays where it is.
    """
    parts = max(table.sparkSession.sparkContext.defaultParallelism, -(-table.count() // rows))
    return table.repartition(parts, key)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    Only on one machine (master ``local``) a temporary one is set where it is unset.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if not base and not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(base or tempfile.mkdtemp(prefix="spark-"))
    return (base or context.getCheckpointDir()).rstrip("/")


def settled(table: DataFrame) -> DataFrame:
    """A table that several branches of a job read, written once in the shared checkpoint folder."""
    shared_folder(table.sparkSession)
    return table.checkpoint()
