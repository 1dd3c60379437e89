"""Line dedup by site-relative frequency."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fits_broadcast, let

#: A line is compared without white space at its ends.
TRIM = r"' \t\r\f\u000b'"


def line_counts(docs: DataFrame, host_col: str = "source", text_col: str = "text") -> DataFrame:
    """``(host, line long, pages, host_pages)``: pages of a host that contain a line at least once (by its XXH64).

    Lines are made distinct within their page before anything is shuffled, and counted map-side, so that a line on a
    third of all pages sends one row per task.
    """
    line = f"filter(transform(split(`{text_col}`, '\\n'), x -> btrim(x, {TRIM})), x -> x <> '')"
    hosted = docs.select(F.col(host_col).cast("string").alias("host"), F.expr(line).alias("l"))
    pages = hosted.groupBy("host").agg(F.count("*").alias("host_pages"))
    digests = F.expr("explode(transform(array_distinct(l), x -> xxhash64(x)))").alias("line")
    counts = hosted.select("host", digests).groupBy("host", "line").agg(F.count("*").alias("pages"))
    few = F.broadcast(pages) if fits_broadcast(pages, 100_000) else pages
    return counts.join(few, counts["host"].eqNullSafe(few["host"])).select(
        counts["host"], "line", "pages", "host_pages"
    )


def drop_boilerplate(
    docs: DataFrame,
    max_ratio: float = 0.02,
    min_pages: int = 10,
    host_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text_col``, and ``n_lines``, ``n_dropped`` (long).

    A line is boilerplate on a host if at least ``min_pages`` of its pages, and more than ``max_ratio`` of them, contain
    it. At most (mean distinct lines of a page) / ``max_ratio`` lines of a host can be so, which bounds its list; the
    lists are broadcast if all of them together are few, else joined by host, where AQE splits hot hosts. Texts are
    never cut or grouped. All rows stay: a page of boilerplate only keeps an empty text, a null text stays null. Null is
    a host of its own. Lines without a word stay and are not counted in ``n_lines``.
    """
    counts = line_counts(docs, host_col, text_col)
    often = cut(
        counts.where((F.col("pages") >= min_pages) & (F.col("pages") > F.col("host_pages") * F.lit(max_ratio))).select(
            "host", "line"
        )
    )
    lists = often.groupBy("host").agg(F.collect_list("line").alias("_often")).withColumnRenamed("host", "_host")
    lists = F.broadcast(lists) if fits_broadcast(often, 200_000) else lists
    joined = docs.join(lists, docs[host_col].cast("string").eqNullSafe(F.col("_host")), "left")
    digest = f"xxhash64(btrim(x, {TRIM}))"
    kept = f"filter(_all, x -> btrim(x, {TRIM}) = '' or not array_contains(_hit, {digest}))"
    # The lines, and the page's few boilerplate digests (a hashed intersection), are bound by name: made once for a page.
    hits = f"array_intersect(transform(_all, x -> {digest}), coalesce(_often, cast(array() as array<bigint>)))"
    row = f"named_struct('n', size(filter(_all, x -> btrim(x, {TRIM}) <> '')), 'all', size(_all), 'kept', {kept})"
    body = let(f"split(`{text_col}`, '\\n')", "_all", let(hits, "_hit", row))
    out = joined.withColumn("_lines", F.expr(f"if(`{text_col}` is null, null, {body})"))
    return out.withColumns(
        {
            text_col: F.expr("array_join(_lines.kept, '\\n')"),
            "n_lines": F.expr("coalesce(cast(_lines.n as bigint), 0L)"),
            "n_dropped": F.expr("coalesce(cast(_lines.all - size(_lines.kept) as bigint), 0L)"),
        }
    ).drop("_lines", "_often", "_host")
