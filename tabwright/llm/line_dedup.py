"""Line dedup by site-relative frequency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _digest(line: Column) -> Column:
    return F.md5(F.trim(line))


def boilerplate(df: DataFrame, host: str = "source", text: str = "text", ratio: float = 0.05, min_pages: int = 5) -> DataFrame:
    """(host, digests): for each host the lines on more than ``ratio`` of its pages and on ``min_pages`` at least.

    Every page counts once for each distinct line; lines are compared without
    the spaces around them, by md5; blank lines don't count. A null host is a
    host of its own. The lists are short by nature: a host's pages hold L
    distinct lines on average, so fewer than L / ratio lines can pass.
    """
    pages = df.select(F.col(f"`{host}`").alias("host"), F.col(f"`{text}`").alias("text"))
    filled = F.filter(_lines(F.col("text")), lambda x: F.trim(x) != "")
    each = pages.select("host", F.explode(F.array_distinct(F.transform(filled, _digest))).alias("digest"))
    counts = each.groupBy("host", "digest").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_pages)
    totals = pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    a, b = counts.alias("a"), totals.alias("b")
    both = a.join(b, F.col("a.host").eqNullSafe(F.col("b.host")))
    common = both.filter(F.col("n") > F.lit(ratio) * F.col("pages"))
    return common.groupBy(F.col("a.host").alias("host")).agg(F.collect_set("digest").alias("digests"))


def line_dedup(df: DataFrame, host: str = "source", text: str = "text", ratio: float = 0.05, min_pages: int = 5,
               broadcast_lines: int = 200_000) -> DataFrame:
    """``df`` with ``text`` cleaned of its host's boilerplate lines, and the columns ``n_lines`` and ``n_dropped``.

    A page of nothing but boilerplate stays as it is: such a page is a copy of
    others, which near-duplicate removal decides on, not text around a content.
    Null texts stay null with no lines; empty texts have one blank line; blank
    lines stay. Repeated rows are pages like any other. Columns of ``df`` called
    n_lines or n_dropped are replaced. The list of boilerplate is broadcast if it
    has at most ``broadcast_lines`` lines; beyond, the join shuffles the pages by
    host and Spark splits a very large host.
    """
    common = written(boilerplate(df, host, text, ratio, min_pages), "boilerplate")
    few = common.select(F.explode("digests")).limit(broadcast_lines + 1).count() <= broadcast_lines
    a, b = df.alias("a"), (F.broadcast(common) if few else common).alias("b")
    both = a.join(b, F.col(f"a.`{host}`").eqNullSafe(F.col("b.host")), "left")
    listed = F.coalesce("b.digests", F.array().cast("array<string>"))
    lines = _lines(F.col(f"a.`{text}`"))
    kept = F.filter(lines, lambda x: ~F.array_contains(listed, _digest(x)))
    rest = F.exists(kept, lambda x: F.trim(x) != "")
    untouched = (F.size(listed) == 0) | ~rest
    result = F.struct(F.when(untouched, F.col(f"a.`{text}`")).otherwise(F.array_join(kept, "\n")).alias("text"),
                      F.when(F.col(f"a.`{text}`").isNull(), 0).otherwise(F.size(lines)).alias("n_lines"),
                      F.when(untouched, 0).otherwise(F.size(lines) - F.size(kept)).alias("n_dropped"))
    done = both.select("a.*", result.alias("__done"))
    values = {"n_lines": F.col("__done.n_lines").cast("long"), "n_dropped": F.col("__done.n_dropped").cast("long"), text: F.col("__done.text")}
    return done.withColumns(values).drop("__done")
