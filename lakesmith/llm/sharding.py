"""Sharding by a two-pass external shuffle, in DataFrame functions only.

Pass one scatters the records uniformly into memory-sized buckets by a
seeded hash; pass two brings each bucket into memory, shuffles it with
Fisher-Yates (``shuffle``) and numbers its rows behind those of the buckets
before it. The concatenated buckets are one uniform order of the corpus,
and shard ``s`` of ``n`` takes the rows whose place falls into the s-th
n-th part: row counts differ by one at most, whatever the sizes of texts.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prefix_sums

BUCKET_BYTES = 4 << 20


def record_size(text: str) -> F.Column:
    """UTF-8 bytes of the text (null: none) plus 8."""
    return (F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)) + 8).cast("long")


def shuffle_into_shards(df: DataFrame, n_shards: int, key: str = "doc_id", text: str = "text", seed: int = 17,
                        bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Every row of ``df`` with shard, slot (gapless from 0 in a shard) and
    bucket. Columns of ``df`` with these names are replaced.

    Buckets are sized from the bytes of all records, so a bucket (and a
    record) must fit in memory, nothing else. Rows scatter by a hash of key
    and text: copies of a text spread like other rows, null keys and texts
    are ordinary values, and only rows equal in both share a bucket. The
    order is fixed by seed and rows up to the task that shuffles a bucket;
    buckets are sorted first, so a task that runs again repeats its order.
    Fewer rows than shards leave shards empty; an empty table stays so."""
    made = ("shard", "slot", "bucket")
    cols = [c for c in df.columns if c not in made]
    total, rows = df.agg(F.sum(record_size(text)), F.count(F.lit(1))).first()
    n_buckets = max(1, math.ceil((total or 0) / bucket_bytes))
    spread = F.pmod(F.xxhash64(F.lit(seed), F.col(f"`{key}`"), F.col(f"`{text}`")), F.lit(n_buckets)).cast("int")
    plain = df.select(spread.alias("bucket"), *[F.col(f"`{c}`") for c in cols])
    sizes = (df.sparkSession.range(n_buckets).select(F.col("id").cast("int").alias("bucket"))
             .join(plain.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")), "bucket", "left").fillna(0, ["n"]))
    before = prefix_sums(sizes, "bucket", "n", "before").select("bucket", "before")
    record = F.struct(*[F.col(f"`{c}`") for c in cols])
    both = plain.select("bucket", record.alias("r"), F.lit(None).cast("long").alias("before")).unionByName(
        before.select("bucket", F.lit(None).cast(plain.select(record.alias("r")).schema["r"].dataType).alias("r"),
                      "before"))
    # the offset travels as a row of its bucket: no join with the large rows
    whole = both.groupBy("bucket").agg(F.collect_list("r").alias("rs"), F.max("before").alias("before"))
    ordered = (whole.sortWithinPartitions("bucket")
               .select("bucket", "before", F.shuffle(F.array_sort("rs"), F.lit(seed)).alias("rs")))
    out = ordered.select("bucket", "before", F.posexplode("rs").alias("i", "r"))
    place = F.col("before") + F.col("i")
    # integer arithmetic: doubles could round a place across a border
    shard = F.expr(f"(before + i) * {n_shards}L div {max(rows, 1)}L")
    first = F.expr(f"((before + i) * {n_shards}L div {max(rows, 1)}L * {max(rows, 1)}L + {n_shards - 1}L) div {n_shards}L")
    return out.select("r.*", shard.cast("int").alias("shard"), (place - first).cast("long").alias("slot"), "bucket")


def write_shards(df: DataFrame, path: str, n_shards: int, **options) -> None:
    """Write the shards as folders ``shard=N``, rows in slot order: one task
    per shard and bucket range, so no shard passes through one task."""
    out = shuffle_into_shards(df, n_shards, **options)
    (out.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path))
