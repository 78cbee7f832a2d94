"""Readers of notes and vocabularies, and writers of results."""

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NOTE = "uid string, name string, raw_text string, filename string, _corrupt string"


def notes_jsonl(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """uid, name, raw_text, filename from lines of JSON. With strict, a broken line, a missing field or a repeated uid is an error."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    df = lines.select(F.from_json("value", NOTE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r")).select("r.*")
    if strict:
        bad = F.col("_corrupt").isNotNull() | F.col("uid").isNull() | F.col("name").isNull() | F.col("raw_text").isNull()
        if n := df.filter(bad).select("uid", "name", "raw_text", "filename", "_corrupt").count():
            raise ValueError(f"{n} notes are broken or lack uid, name or raw_text")
        if twice := df.groupBy("uid").count().filter("count > 1").select("uid").limit(5).collect():
            raise ValueError("uid repeats: " + ", ".join(r.uid for r in twice))
    return df.filter("_corrupt is null").drop("_corrupt")


def name_parts(path: Column) -> tuple[Column, Column]:
    """Name and short id of files called first_last_id8.txt; empty strings where the name has another form."""
    stem = F.regexp_replace(F.element_at(F.split(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), "/"), -1), r"\.txt$", "")
    return F.initcap(F.regexp_replace(F.regexp_extract(stem, r"^(.+)_[0-9a-f]{8}$", 1), "_", " ")), F.regexp_extract(stem, r"_([0-9a-f]{8})$", 1)


def notes_text(spark: SparkSession, path: str) -> DataFrame:
    """uid, name, raw_text, filename from one text file for each patient."""
    df = spark.read.text(path, wholetext=True).withColumn("filename", F.input_file_name())
    name, uid = name_parts(F.col("filename"))
    return df.select(uid.alias("uid"), name.alias("name"), F.col("value").alias("raw_text"), "filename")


def rrf(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A vocabulary file with bars behind every field, by the names of its columns."""
    schema = ", ".join(f"`{c}` string" for c in [*columns, "_end"])
    return spark.read.schema(schema).option("sep", "|").option("quote", "").csv(path).drop("_end")


def write_tables(tables: dict[str, DataFrame], folder: str, csv: bool = False) -> None:
    """Every table to a folder of its own; as CSV with a header, nested columns as JSON, or as parquet."""
    for name, df in tables.items():
        if csv:
            nested = [c for c, t in df.dtypes if t.startswith(("array", "struct", "map"))]
            df.withColumns({c: F.to_json(c) for c in nested}).write.mode("overwrite").option("header", "true").csv(f"{folder}/{name}")
        else:
            df.write.mode("overwrite").parquet(f"{folder}/{name}")


def write_spans(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def term_stats(events: DataFrame) -> DataFrame:
    """normalized_term, n_events, n_patients; a null term is a group of its own."""
    return events.groupBy("normalized_term").agg(F.count(F.lit(1)).alias("n_events"), F.count_distinct("patient_id").alias("n_patients"))


# run log ---------------------------------------------------------------------------------------------------------------

LOG = "request_id string, user_query string, request_timestamp timestamp, run_status string, payload_json string, created_at timestamp"


def log_rows(raw: DataFrame) -> DataFrame:
    """Rows of the log from request_id, user_query, request_timestamp (text), run_status, payload_json.

    A time that can't be read becomes the present; of a repeated request the earliest row is kept.
    """
    now = F.current_timestamp()
    when = F.coalesce(F.try_to_timestamp(F.regexp_replace("request_timestamp", r"(\+00:00)?Z$", "+00:00")), now)
    rows = raw.select("request_id", "user_query", when.alias("request_timestamp"), "run_status", "payload_json", now.alias("created_at")).filter("request_id is not null")
    first = F.min_by(F.struct("user_query", "request_timestamp", "run_status", "payload_json", "created_at"), F.struct("request_timestamp", "run_status", "payload_json", "user_query")).alias("r")
    return rows.groupBy("request_id").agg(first).select("request_id", "r.*")


def new_log_rows(log: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows whose request is not in the log yet."""
    return rows.join(log.select("request_id"), "request_id", "left_anti")


def append_log(spark: SparkSession, rows: DataFrame, path: str) -> int:
    """Appends what is new and tells how many rows the log then has."""
    try:
        rows = new_log_rows(spark.read.schema(LOG).parquet(path), rows)
    except AnalysisException as e:  # the first write finds no log
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    rows.write.mode("append").parquet(path)
    return spark.read.schema(LOG).parquet(path).count()
