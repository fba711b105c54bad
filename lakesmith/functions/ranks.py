"""One index of the ranks of all values of many columns or groups.

The long frame (group, value) is counted by distinct value (partial
aggregation), range-partitioned by group and value, and written with the
number of its partition. A partition's total per group, one row each, gives
the rows before it, and a running sum inside the partition the rows before
each value. A group with any share of the rows is split over partitions, no
task sorts a whole group, and the source is read once whatever the number
of columns. Null and NaN values have no rank.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scale import cut_lineage


def rank_index(long: DataFrame, groups: Sequence[str], value: str = "v", marks: Mapping[str, Column] | None = None) -> DataFrame:
    """(groups, value, n, before, size, marks): for every distinct value its
    number of rows, the rows of its group with smaller values and all of
    them, and how many of its rows each of ``marks`` (conditions) holds for."""
    marks = dict(marks or {})
    x = F.col(value)
    known = x.isNotNull()
    if long.schema[value].dataType.typeName() in ("double", "float"):
        known = known & ~F.isnan(x)
    counts = cut_lineage(long.where(known).groupBy(*groups, value).agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(name) for name, c in marks.items()]))
    parts = int(long.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut_lineage(counts.repartitionByRange(parts, *groups, value).withColumn("_part", F.spark_partition_id()))
    totals = placed.groupBy(*groups, "_part").agg(F.sum("n").alias("_t"))
    ahead = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)    # a row per partition
    totals = totals.select(*groups, "_part", F.coalesce(F.sum("_t").over(ahead), F.lit(0)).alias("_off"),
                           F.sum("_t").over(Window.partitionBy(*groups)).alias("size"))
    inner = Window.partitionBy(*groups, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (placed.join(totals, [*groups, "_part"])
            .select(*groups, value, "n", (F.col("_off") + F.sum("n").over(inner) - F.col("n")).alias("before"), "size", *marks))


def at_places(index: DataFrame, groups: Sequence[str], places: Mapping[str, Callable[[Column], Column]], value: str = "v") -> DataFrame:
    """(groups, size, names): of every group the values at the 0-based ranks
    that ``places`` makes of its size."""
    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("before") <= rank) & (rank < F.col("before") + F.col("n")), F.col(value)))
    return index.groupBy(*groups, "size").agg(*[at(place(F.col("size"))).alias(name) for name, place in places.items()])


def _quantiles(index: DataFrame, groups: Sequence[str], probs: Mapping[str, float], value: str = "v") -> DataFrame:
    """(groups, names): linearly interpolated quantiles of every group."""
    def place(p: float) -> Callable[[Column], Column]:
        return lambda size: (size - 1) * F.lit(float(p))
    ends = {f"_{end}_{name}": (lambda size, h=place(p), f=f: f(h(size))) for name, p in probs.items() for end, f in (
        ("a", F.floor), ("b", F.ceil))}
    found = at_places(index, groups, ends, value)
    h = {name: place(p)(F.col("size")) for name, p in probs.items()}
    return found.select(*groups, *[(F.col(f"_a_{name}") + (h[name] - F.floor(h[name])) * (F.col(f"_b_{name}") - F.col(f"_a_{name}"))).alias(name)
                                   for name in probs])


def value_at(df: DataFrame, value: Column, rank: int) -> tuple | None:
    """(value at the 0-based rank, rows with smaller values), in the order
    of the value's own type; None beyond the last rank."""
    index = rank_index(df.select(F.lit(0).alias("_g"), value.alias("v")), ["_g"])
    row = index.where((F.col("before") <= rank) & (F.col("before") + F.col("n") > rank)).first()
    return None if row is None else (row["v"], row["before"])


def column_index(df: DataFrame, columns: Mapping[str, Column] | Sequence[str]) -> DataFrame:
    """The rank index of columns of one table as groups ``column_name``;
    values are doubles."""
    if not isinstance(columns, Mapping):
        columns = {c: F.col(c) for c in columns}
    cells = F.array(*[F.struct(F.lit(name).alias("column_name"), c.cast("double").alias("v")) for name, c in columns.items()])
    return rank_index(df.select(F.explode(cells).alias("c")).select("c.*"), ["column_name"])


def quantiles_of(df: DataFrame, columns: Mapping[str, Column] | Sequence[str], probs: Sequence[float]) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles (numpy, pandas, SQL
    ``quantile_cont``) of all columns; None for a column without values."""
    names = {f"q{i}": p for i, p in enumerate(probs)}
    rows = {r["column_name"]: list(r)[1:] for r in _quantiles(column_index(df, columns), ["column_name"], names).collect()}
    return {c: rows.get(c, [None] * len(names)) for c in list(columns)}


def ranked_values(df: DataFrame, columns: Mapping[str, Column] | Sequence[str],
                  places: Mapping[str, Callable[[Column], Column]]) -> dict[str, tuple[int, list[float | None]]]:
    """(values, those at the given ranks) of all columns; the ranks are made
    of a column's number of values."""
    found = at_places(column_index(df, columns), ["column_name"], places)
    rows = {r["column_name"]: (r["size"], list(r)[2:]) for r in found.collect()}
    return {c: rows.get(c, (0, [None] * len(places))) for c in list(columns)}


def rank_quantiles_of(df: DataFrame, columns: Mapping[str, Column] | Sequence[str],
                      fractions: Sequence[tuple[int, int]]) -> dict[str, tuple[int, list[float | None]]]:
    """(values, ``sorted[n * num // den]`` for each fraction) of all columns."""
    def place(a: int, b: int) -> Callable[[Column], Column]:
        return lambda size: F.least(F.floor((size * a - (size * a) % b) / b), size - 1)
    return ranked_values(df, columns, {f"q{i}": place(a, b) for i, (a, b) in enumerate(fractions)})


def group_quantiles(df: DataFrame, keys: Sequence[str], column: str, probs: Sequence[float], names: Sequence[str]) -> DataFrame:
    """(keys, names): exact interpolated quantiles of every group."""
    index = rank_index(df.select(*keys, F.col(column).cast("double").alias("_v")), list(keys), "_v")
    return _quantiles(index, list(keys), dict(zip(names, probs, strict=True)), "_v")


def ranked_auc(long: DataFrame, by: Sequence[str], positive: Column, score: str = "score") -> DataFrame:
    """(by, positives, negatives, auc): area under the ROC curve of every
    group at once, from average ranks; null without both kinds of rows."""
    index = rank_index(long.withColumn("_v", F.col(score).cast("double")).withColumn("_y", positive), list(by), "_v",
                       {"pos": F.col("_y")})
    sums = index.groupBy(*by).agg(F.sum("pos").alias("positives"), F.sum(F.col("n") - F.col("pos")).alias("negatives"),
                                  F.sum(F.col("pos") * (F.col("before") + (F.col("n") + 1) / 2)).alias("_r"))
    p, n = F.col("positives"), F.col("negatives")
    return sums.select(*by, p, n, F.when((p > 0) & (n > 0), (F.col("_r") - p * (p + 1) / 2) / (p * n)).alias("auc"))
