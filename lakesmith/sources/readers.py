"""Readers. Every reader returns a DataFrame; nothing is read
on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.documents import json_records, record_columns

def read_csv(spark: SparkSession, path: str, infer: bool = False, schema: str | None = None) -> DataFrame:
    """SRC-01: header CSV. Quality path (``infer=False``): every column is
    text and an empty field stays ``""`` (not null)."""
    r = (spark.read.option("header", True).option("multiLine", True).option("escape", '"')
         .option("emptyValue", ""))
    if not infer:
        # no text reads as null: empty fields stay "" as csv.DictReader gives them
        r = r.option("nullValue", "\u0000<null>")
    if schema:
        return r.schema(schema).csv(path)
    if infer:
        return r.option("inferSchema", True).csv(path)
    df = r.option("inferSchema", False).csv(path)
    # Spark reads an unquoted empty field as null; as text it is ""
    return df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in df.columns])


def read_json_doc(spark: SparkSession, path: str) -> DataFrame:
    """SRC-02: JSON documents, one per file: a top-level array, or an object
    holding its records under the first of ``data, records, rows, items``
    that is an array; any other object is one row. Each document has its own
    wrapper; fields of all records become columns. A file that is no JSON is
    a row of ``_corrupt_record`` (a column only if there is one)."""
    docs = spark.read.text(path, wholetext=True).select("value").withColumnRenamed("value", "_doc")
    records = json_records(docs.withColumn("_corrupt_record", F.when(F.try_parse_json("_doc").isNull(), F.col("_doc"))), "_doc")
    out = record_columns(records.drop("position"))
    return out if not out.where("_corrupt_record is not null").isEmpty() else out.drop("_corrupt_record")


def read_jsonl(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """SRC-03: JSON Lines; blank lines are skipped by the reader."""
    r = spark.read
    return (r.schema(schema) if schema else r).json(path)


def read_any(spark: SparkSession, path: str, **kw) -> DataFrame:
    """SRC-04: format by extension; unknown extensions read as CSV."""
    p = path.lower().rstrip("/")
    if p.endswith(".parquet"):
        return spark.read.parquet(path)
    if p.endswith(".jsonl") or p.endswith(".ndjson"):
        return read_jsonl(spark, path)
    if p.endswith(".json"):
        return read_json_doc(spark, path)
    if p.endswith(".orc"):
        return spark.read.orc(path)
    return read_csv(spark, path, infer=kw.get("infer", True))


def jdbc_options(url: str, table_or_query: str, partition_column: str | None = None,
                 bounds: tuple | None = None, num_partitions: int | None = None,
                 user: str | None = None, password: str | None = None, fetch_size: int = 10000) -> dict:
    """SRC-05 option map: whole table or a query; with a partition column
    and bounds the read is split into ``num_partitions`` range queries."""
    opts = {"url": url, "fetchsize": str(fetch_size)}
    if table_or_query.strip().lower().startswith("select"):
        opts["query"] = table_or_query
    else:
        opts["dbtable"] = table_or_query
    if partition_column:
        if not bounds or not num_partitions:
            raise ValueError("partitioned JDBC reads need bounds and num_partitions")
        opts.update(partitionColumn=partition_column, lowerBound=str(bounds[0]), upperBound=str(bounds[1]),
                    numPartitions=str(num_partitions))
    if user:
        opts["user"] = user
    if password:
        opts["password"] = password
    return opts


def read_jdbc(spark: SparkSession, url: str, table_or_query: str, **kw) -> DataFrame:
    """SRC-05: JDBC source (driver jar must be on the classpath)."""
    return spark.read.format("jdbc").options(**jdbc_options(url, table_or_query, **kw)).load()


def incremental_jdbc_query(table: str, column: str, high_water_mark) -> str:
    """Incremental pull: rows newer than the last loaded mark."""
    return f"select * from {table} where {column} > '{high_water_mark}'"


def replay_from(spark: SparkSession, source: DataFrame, ts_col: str, start: str) -> DataFrame:
    """SRC-06 for file sources: the rows from ``start`` on, as a predicate
    on the raw event-time column (pushed to the scan). The caller writes
    them to a new output with a new checkpoint, then swaps the pointer."""
    typ = source.schema[ts_col].dataType
    return source.where(F.col(ts_col) >= F.lit(start).cast(typ))


def kafka_replay_options(bootstrap: str, topic: str, start_millis: int) -> dict:
    """SRC-06 for Kafka: start every partition at a timestamp."""
    return {"kafka.bootstrap.servers": bootstrap, "subscribe": topic,
            "startingTimestamp": str(start_millis), "failOnDataLoss": "false"}


# Timestamps in message payloads carry microseconds.
TS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
JSON_TS_OPTIONS = {"timestampNTZFormat": TS_FORMAT, "timestampFormat": TS_FORMAT + "XXX"}


def to_messages(df: DataFrame, value_col: str = "value") -> DataFrame:
    """Serialise rows as JSON payloads (the producer side of SRC-08)."""
    return df.select(F.to_json(F.struct(*df.columns), JSON_TS_OPTIONS).alias(value_col))


def parse_messages(df: DataFrame, schema: str | T.StructType, value_col: str = "value") -> DataFrame:
    """SRC-08: parse a JSON payload column into typed columns."""
    return (df.select(F.from_json(F.col(value_col).cast("string"), schema, JSON_TS_OPTIONS).alias("_d"))
            .select("_d.*"))


def read_stream(spark: SparkSession, fmt: str, options: dict, schema: str | T.StructType,
                path: str | None = None) -> DataFrame:
    """SRC-08: a message stream (Kafka) or a file stream with the same
    parsing; for file formats the schema is the file schema."""
    r = spark.readStream.format(fmt).options(**options)
    if fmt == "kafka":
        return parse_messages(r.load(), schema)
    r = r.schema(schema)
    return r.load(path) if path else r.load()


def list_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """File corpus as ``(path, content, size)`` via the binaryFile source."""
    b = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    return b.select(F.col("path"), F.col("content").cast("string").alias("content"), F.col("length").alias("size"))

