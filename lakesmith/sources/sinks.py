"""Writers. Overwrites go to new paths or use dynamic
partition overwrite; a path being read is never overwritten in place."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MODES = {"append": "append", "overwrite": "overwrite", "replace": "overwrite", "fail": "errorifexists",
         "errorifexists": "errorifexists", "ignore": "ignore"}


def write_table(df: DataFrame, path: str, mode: str = "append", partition_by: Sequence[str] = (),
                cluster_by: Sequence[str] = (), n_files: int | None = None, fmt: str = "parquet") -> None:
    """SNK-01: append / overwrite, optional partition columns; clustering =
    range partitioning on the cluster columns plus a sort inside each
    file, so row groups have tight min/max statistics for pruning."""
    out = df
    if cluster_by:
        n = n_files or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        out = out.repartitionByRange(n, *cluster_by).sortWithinPartitions(*cluster_by)
    w = out.write.mode(MODES[mode]).format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def load_table(df: DataFrame, path: str, if_exists: str = "replace", name: str | None = None,
               fmt: str = "parquet") -> DataFrame:
    """SNK-02: write with a conflict policy (replace / append / fail), count
    rows while writing (observed metric, no extra pass) and verify by
    reading the target back. Returns (table, rows_loaded, rows_verified)."""
    from pyspark.sql import Observation
    obs = Observation("load")
    observed = df.observe(obs, F.count(F.lit(1)).alias("rows"))
    observed.write.mode(MODES[if_exists]).format(fmt).save(path)
    loaded = obs.get["rows"]
    spark = df.sparkSession
    verified = spark.read.format(fmt).load(path).count()
    return spark.createDataFrame([(name or path.rstrip("/").split("/")[-1], int(loaded), int(verified))],
                                 "table_name string, rows_loaded long, rows_verified long")


def overwrite_partitions(df: DataFrame, path: str, partition_by: Sequence[str], fmt: str = "parquet") -> None:
    """SNK-03: idempotent load of whole partitions: only the partitions
    present in ``df`` are replaced (dynamic overwrite, set per write)."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*partition_by).format(fmt).save(path))


def write_bucketed(df: DataFrame, table: str, n: int, keys: Sequence[str], path: str | None = None) -> None:
    """SNK-04: bucketed, sorted table; joins of two tables bucketed the same
    way on the key need no exchange."""
    w = df.write.mode("overwrite").bucketBy(n, *keys).sortBy(*keys).format("parquet")
    if path:
        w = w.option("path", path)
    w.saveAsTable(table)


def write_jdbc_staged_fn(url: str, staging: str, properties: dict) -> Callable[[DataFrame, int], None]:
    """SNK-05: foreachBatch body that appends each batch (tagged with its
    batch id) to a staging table; the database-side merge into the final
    table is keyed on (batch id, key), so replays are harmless."""
    def fn(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.jdbc(url, staging, mode="append",
                                                                properties=properties)
    return fn


class CommitConflict(RuntimeError):
    """Another writer has made the same commit first."""


def _file_system(spark: SparkSession, path: str):
    """(Hadoop file system, Path) of a place in shared storage."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether any file or folder matches ``path`` (a listing; storage that
    cannot be reached is an error, not an absence)."""
    fs, where = _file_system(spark, path)
    return bool(fs.globStatus(where))


def add_commit(spark: SparkSession, root: str, number: int, value: str) -> None:
    """Adds marker ``number`` as one small file. Earlier markers stay as they
    are, so a write that fails leaves the last state in force; a marker that
    is there already is never replaced: :class:`CommitConflict`."""
    fs, where = _file_system(spark, f"{root.rstrip('/')}/commits/{number:012d}")
    try:
        out = fs.create(where, False)
    except Exception as e:
        if fs.exists(where):
            raise CommitConflict(f"commit {number} of {root} is taken") from e
        raise
    out.write(bytearray(value.encode()))
    out.close()


def last_commit(spark: SparkSession, root: str) -> tuple[int, str] | None:
    """(number, value) of the highest marker, None without any. Only names
    are listed, and one marker is read; one that another writer has just
    opened and not filled yet does not count."""
    fs, where = _file_system(spark, f"{root.rstrip('/')}/commits")
    if not fs.exists(where):
        return None
    found = [f for f in fs.listStatus(where) if f.getPath().getName().isdigit() and f.getLen() > 0]
    if not found:
        return None
    top = max(found, key=lambda f: int(f.getPath().getName()))
    stream = fs.open(top.getPath())
    try:
        value = bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()
    return int(top.getPath().getName()), value


def stage_parquet(df: DataFrame, root: str, mode: str = "overwrite") -> str:
    """SNK-06: bulk load through a unique staging directory; the new data
    becomes current only by a new commit marker, so readers never see a
    half-written load and never lose the last one. Overwrite starts a fresh
    version; append adds a version and keeps the earlier ones current too.
    A loader that loses the race for a marker goes on from the winner's."""
    spark = df.sparkSession
    target = f"{root.rstrip('/')}/v-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(target)
    while True:
        last = last_commit(spark, root)
        current = json.loads(last[1]) if last and mode == "append" else []
        try:
            add_commit(spark, root, last[0] + 1 if last else 0, json.dumps(current + [target]))
            return target
        except CommitConflict:
            time.sleep(0.05)


def read_pointer(spark: SparkSession, root: str) -> list[str]:
    """Folders of the current versions. Versions without any marker are an
    error, as they are no empty table."""
    last = last_commit(spark, root)
    if last is None and path_exists(spark, f"{root.rstrip('/')}/v-*"):
        raise RuntimeError(f"{root} holds versions but no commit marker")
    return json.loads(last[1]) if last else []


def read_staged(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(*read_pointer(spark, root))


def quality_report(dataset: dict, score: DataFrame, results: DataFrame, profile: DataFrame) -> DataFrame:
    """SNK-07: machine-readable report rows ``(section, payload_json)``:
    dataset info, score, summary counts, one row per check, one per column
    profile."""
    spark = score.sparkSession
    info = spark.createDataFrame([("dataset", json.dumps(dataset, default=str))], "section string, payload_json string")
    sc = score.select(F.lit("score").alias("section"), F.to_json(F.struct(*score.columns)).alias("payload_json"))
    summ = results.agg(F.count(F.lit(1)).alias("total"), F.count_if("passed").alias("passed"),
                       F.count_if(~F.col("passed")).alias("failed")) \
        .select(F.lit("summary").alias("section"), F.to_json(F.struct("total", "passed", "failed")).alias("payload_json"))
    res = results.select(F.lit("check").alias("section"), F.to_json(F.struct(*results.columns)).alias("payload_json"))
    prof = profile.select(F.lit("column_profile").alias("section"),
                          F.to_json(F.struct(*profile.columns)).alias("payload_json"))
    return info.unionByName(sc).unionByName(summ).unionByName(res).unionByName(prof)


def backfill(spark: SparkSession, source: DataFrame, ts_col: str, start: str, end: str, path: str,
             transform: Callable[[DataFrame], DataFrame] | None = None, date_col: str = "ds") -> None:
    """SNK-08: backfill every logical date in [start, end] as ONE job: the
    dates are a column, rows are tagged with their date, and dynamic
    partition overwrite replaces exactly those date partitions (rerunning a
    date range gives the same result)."""
    typ = source.schema[ts_col].dataType
    rows = source.where((F.col(ts_col) >= F.lit(start).cast(typ))
                        & (F.col(ts_col) < F.date_add(F.lit(end).cast("date"), 1).cast(typ)))
    rows = rows.withColumn(date_col, F.to_date(ts_col))
    out = transform(rows) if transform else rows
    overwrite_partitions(out, path, [date_col])
