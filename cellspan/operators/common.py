"""Aggregation shapes that several operators share. All combine map-side; none needs a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def filled(c: str) -> Column:
    """The value, null where it is blank."""
    return F.when(F.trim(F.col(c)) != "", F.col(c))


def n_distinct(c: Column | str, when: Column | None = None) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.countDistinct(c if when is None else F.when(when, c))


def n_if(cond: Column) -> Column:
    return F.count_if(cond)


def total(c: Column | str, digits: int = 4, zero: bool = False) -> Column:
    """Rounded sum, exact in decimals, so that it does not depend on the order of rows; ``zero`` in place of null."""
    c = F.col(c) if isinstance(c, str) else c
    out = F.sum(c.cast("decimal(28,6)"))
    return F.round(F.coalesce(out, F.lit(0).cast("decimal(28,6)")) if zero else out, digits).cast("double")


def average(c: Column, digits: int = 4) -> Column:
    """Mean of a column that is never null or negative, rounded half up in whole numbers."""
    n, unit = F.count("*").cast("decimal(20,0)"), 10 ** (6 - digits)
    over, under = 2 * F.sum(F.round(c * 1e6).cast("decimal(28,0)")) + unit * n, 2 * unit * n
    return ((over - over % under) / under).cast("double") / 10**digits


def joined(c: Column | str, limit: int | None = None) -> Column:
    """Distinct values in order, joined by a comma; blanks and nulls left out."""
    c = F.col(c) if isinstance(c, str) else c
    text = F.array_join(F.array_sort(F.collect_set(F.when(F.trim(c) != "", c))), ", ")
    return F.substring(text, 1, limit) if limit else text


def most_frequent(df: DataFrame, by: list[str], value: str, name: str, when: Column | None = None) -> DataFrame:
    """``by`` and the value seen most often in each group (of equals the smallest): two aggregations, no sort."""
    rows = df if when is None else df.where(when)
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    return counts.groupBy(*by).agg(F.min(F.struct(-F.col("_n"), F.col(value).alias("v")))["v"].alias(name))


def with_most_frequent(result: DataFrame, df: DataFrame, by: list[str], picks: dict[str, tuple[str, Column | None]]) -> DataFrame:
    """``result`` with a most frequent value per group for each ``name: (column, condition)``."""
    for name, (value, when) in picks.items():
        top = most_frequent(df, by, value, name, when)
        result = result.join(top, by, "left") if by else result.withColumn(name, top.scalar())
    return result


def latest(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """First row of each group in ``order``; Spark limits each group before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def fits_broadcast(df: DataFrame, rows: int = 100_000) -> bool:
    """Whether ``df`` has few rows; reads no more than one row beyond."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if_small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """Broadcast hint where ``df`` is checked to have few rows."""
    return F.broadcast(df) if fits_broadcast(df, rows) else df


def metric_rows(df: DataFrame, metrics: dict[str, Column], by: tuple[str, ...] = ()) -> DataFrame:
    """One aggregation turned into rows ``(by…, metric, value string)``."""
    names = list(metrics)
    one = df.groupBy(*by).agg(*[metrics[n].cast("string").alias(f"m{i}") for i, n in enumerate(names)])
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(f"m{i}").alias("value")) for i, n in enumerate(names)]))
    return one.select(*by, pairs.alias("p")).select(*by, "p.metric", "p.value")


def check_rows(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """``(check_name, records, share_percent)``: rows of the frame for which each condition holds."""
    names = list(checks)
    one = df.agg(F.count("*").alias("n"), *[F.count_if(checks[c]).alias(f"c{i}") for i, c in enumerate(names)])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("check_name"), F.col(f"c{i}").alias("records")) for i, c in enumerate(names)]))
    share = F.when(F.col("n") > 0, F.round(100.0 * F.col("p.records") / F.col("n"), 2)).otherwise(F.lit(0.0))
    return one.select("n", pairs.alias("p")).select("p.check_name", "p.records", share.alias("share_percent"))


def matrix(df: DataFrame, item: str, across: str, values: list[str]) -> DataFrame:
    """Counts of ``item`` by a stated list of ``across`` values, zero-filled, with the total and how many are not zero."""
    p = df.groupBy(item).pivot(across, values).count()
    cells = [F.coalesce(F.col(f"`{v}`"), F.lit(0)).cast("long") for v in values]
    total, hits = F.lit(0).cast("long"), F.lit(0)
    for c in cells:
        total, hits = total + c, hits + (c > 0).cast("int")
    return p.select(item, *[c.alias(v) for c, v in zip(cells, values)], total.alias("total"), hits.alias("n_present"))


#: Days of all intervals together up to which they are binned by day.
MAX_BINS = 1_000_000


def join_intervals(df: DataFrame, few: DataFrame, on: Column, first: str, last: str, start: str, end: str, keep: list) -> DataFrame:
    """The columns ``keep`` of the inner join of events (alias ``e``), each from ``first`` to ``last``, with few intervals
    (alias ``p``) whose number the caller has checked.

    Both are binned by day, so that the join is by equality of days and not of each event with each interval. Events are
    points where ``first`` is ``last``; others that last beyond 31 days are joined without bins, as are all if the
    intervals have more than ``MAX_BINS`` days together.
    """
    plain = lambda e: e.alias("e").join(F.broadcast(few).alias("p"), on).select(*keep)
    days = few.agg(F.sum(F.date_diff(F.to_date(end), F.to_date(start)) + 1)).first()[0] or 0
    if days > MAX_BINS:
        return plain(df)
    binned = F.broadcast(few.withColumn("_bin", F.explode(F.sequence(F.to_date(start), F.to_date(end))))).alias("p")
    met = F.col("e._bin") == F.col("p._bin")
    if first == last:
        return df.withColumn("_bin", F.to_date(first)).alias("e").join(binned, met & on).select(*keep)
    span = F.date_diff(F.to_date(last), F.to_date(first))
    short = df.where(span.between(0, 31)).withColumn("_bin", F.explode(F.sequence(F.to_date(first), F.to_date(last))))
    once = F.col("e._bin") == F.greatest(F.to_date(f"e.{first}"), F.to_date(f"p.{start}"))
    return short.alias("e").join(binned, met & once & on).select(*keep).union(plain(df.where(span > 31)))


def night(ts: str, start: int = 22, end: int = 6) -> Column:
    return (F.hour(ts) >= start) | (F.hour(ts) < end)
