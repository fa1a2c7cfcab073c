"""Running, sliding and binned statistics over ordered rows, and splits of them.

Everything that runs over a whole table's order is partitioned by range first: sums of ranges are added
to positions within them, so no task sees more than its range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from loomtext.session import cut, shuffle_partitions


def numbered(df: DataFrame, order: list[str], value: str | None = None, part: str = "__part") -> DataFrame:
    """``df`` with pos, the row number from 1 in the order, and cum, the running sum of ``value`` (or of 1)."""
    spark = df.sparkSession
    ranged = cut(df.repartitionByRange(shuffle_partitions(spark), *order).withColumn(part, F.spark_partition_id()))
    amount = F.col(value) if value else F.lit(1)
    within = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    sums = ranged.groupBy(part).agg(F.count("*").alias("__n"), F.sum(amount).alias("__s"))
    base = sums.select(part, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__n"), F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__s"))
    out = ranged.withColumns({"pos": F.count("*").over(within), "cum": F.sum(amount).over(within)}).join(F.broadcast(base), part)
    return out.withColumns({"pos": F.col("pos") + F.col("__n"), "cum": F.col("cum") + F.col("__s")}).drop(part, "__n", "__s")


def budget(text: str) -> int:
    """'100K', '3M' or '1G' as a number."""
    units = {"K": 10**3, "M": 10**6, "G": 10**9}
    return int(float(text[:-1]) * units[text[-1].upper()]) if text[-1].upper() in units else int(text)


def head_by_budget(df: DataFrame, order: list[str], value: str, most: int) -> DataFrame:
    """Rows until the sum of the rows before exceeds the budget."""
    return numbered(df, order, value).where(F.col("cum") - F.col(value) <= most)


def linear_split(df: DataFrame, order: list[str], k: int) -> DataFrame:
    """``df`` with split: row i of s is in slice j where int(j * s / k) <= i < int((j + 1) * s / k)."""
    size = df.count()
    row = F.col("pos") - 1
    guess = F.floor(row * k / max(1, size))
    at = lambda j: F.floor(j * F.lit(size) / k)
    exact = F.when(row < at(guess), guess - 1).when(row >= at(guess + 1), guess + 1).otherwise(guess)
    return numbered(df, order).withColumn("split", exact.cast("int"))


def sliding(df: DataFrame, key: str, order: list[str], before: int, after: int, block: int = 65_536) -> tuple[DataFrame, WindowSpec]:
    """Rows and a window of ``before`` rows before each row of its key and ``after`` rows after it; ``finish`` has to follow.

    A key may hold most rows, so it isn't one partition: rows are numbered by (key, order) over ranges, and a window's partition is a
    block of them with the rows that its borders need from the neighbours.
    """
    at = F.col("pos") - 1
    where = lambda x: F.floor(x / block)
    rows = numbered(df, [key, *order]).withColumn("__own", where(at))
    rows = rows.withColumn("__block", F.explode(F.sequence(where(at - after), where(at + before))))
    return rows, Window.partitionBy(key, "__block").orderBy("pos").rowsBetween(-before, after)


def finish(df: DataFrame) -> DataFrame:
    """Rows of ``sliding``, each once, without what it added."""
    return df.where(F.col("__own") == F.col("__block")).drop("__own", "__block", "pos", "cum")


def runs(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """``df`` with run, a number that consecutive rows of a key with equal values share, over all keys ascending."""
    rows, window = sliding(df, key, order, 1, 0)
    before = F.collect_list(F.struct(value)).over(window)
    changed = F.when((F.size(before) == 2) & before[0][value].eqNullSafe(F.col(value)), 0).otherwise(1)
    marked = finish(rows.withColumn("__new", changed))
    return numbered(marked, [key, *order], "__new").withColumnRenamed("cum", "run").drop("__new", "pos")


def centred_median(value: Column, window: WindowSpec) -> Column:
    """Median of a window's rows, from their sorted values."""
    values = F.array_sort(F.collect_list(value.cast("double")).over(window))
    middle = lambda k: F.get(values, F.floor((F.size(values) - k) / 2).cast("int"))
    return (middle(1) + F.get(values, F.floor(F.size(values) / 2).cast("int"))) / 2


def last_values(value: Column, window: WindowSpec, n: int) -> dict[str, Column]:
    """Minimum, maximum and mean of a window of the last n values."""
    return {f"min_{n}": F.min(value).over(window), f"max_{n}": F.max(value).over(window), f"mean_{n}": F.avg(value).over(window)}


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """bin (0: below, bins + 1: above) and n."""
    return df.groupBy(F.width_bucket(F.col(value), F.lit(low), F.lit(high), F.lit(bins)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
