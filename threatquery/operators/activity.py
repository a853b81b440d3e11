"""Activity reports: log parsing, project weeks, per-author totals, cumulative and previous weeks."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threatquery.functions.text import strip

HEADER = "COMMIT|||"


def author(name: Column, aliases: Mapping[str, str] | None = None) -> Column:
    """The canonical name of a known alias, else the trimmed name."""
    key = F.lower(strip(F.regexp_replace(name, r"(?U)\s+", " ")))
    if not aliases:
        return strip(name)
    pairs = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, key), strip(name))


def is_bot(name: Column) -> Column:
    return F.lower(name).contains("bot")


#: Lines of a block within which headers are carried forward.
BLOCK = 1 << 16


def parse_log(lines: DataFrame) -> DataFrame:
    """line_no, line of a log with header lines and added/deleted/file lines -> one row per counted file and header.

    A header is carried forward within its block of lines, and the last header
    of each block to the blocks after it, so that only one row per block is
    ordered in one place. Binary files have no numbers and are skipped.
    """
    is_header = F.col("line").startswith(HEADER)
    part = F.split("line", r"\|\|\|", 5)
    head = F.struct(part[1].alias("sha"), part[2].alias("author"), F.try_to_date(part[3], "yyyy-MM-dd").alias("date"), part[4].alias("message"))
    rows = lines.withColumns({"_header": F.when(is_header, head), "_block": F.floor(F.col("line_no") / BLOCK)})
    own = Window.partitionBy("_block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    last = rows.where(F.col("_header").isNotNull()).groupBy("_block").agg(F.max_by("_header", "line_no").alias("_last"))
    blocks = rows.select("_block").distinct().join(last, "_block", "left")
    blocks = blocks.select("_block", F.last("_last", ignorenulls=True).over(before).alias("_earlier"))
    rows = rows.withColumn("_own", F.last("_header", ignorenulls=True).over(own)).join(blocks, "_block")
    rows = rows.withColumn("_commit", F.coalesce("_own", "_earlier"))
    num = F.split("line", "\t")
    number = "^[0-9]+$"
    counted = ~is_header & (F.size(num) >= 3) & num[0].rlike(number) & num[1].rlike(number)
    rows = rows.withColumns({"is_commit": is_header, "added": F.when(counted, num[0].try_cast("bigint")).otherwise(0), "deleted": F.when(counted, num[1].try_cast("bigint")).otherwise(0)})
    return rows.where(F.col("_commit").isNotNull() & (is_header | counted)).select("line_no", "_commit.*", "is_commit", "added", "deleted")


def week_number(day: Column, start: str) -> Column:
    """Weeks of seven days from ``start`` (a Friday), numbered from 1; null before it."""
    first = F.lit(start).cast("date")
    return F.when(day >= first, F.floor(F.datediff(day, first) / 7) + 1)


def week_spine(spark, start: str, until: str) -> DataFrame:
    """week, week_start, week_end from the start to the week of ``until``."""
    days = F.sequence(F.lit(start).cast("date"), F.lit(until).cast("date"), F.expr("interval 7 days"))
    spine = spark.range(1).select(F.posexplode(days).alias("k", "week_start"))
    return spine.select((F.col("k") + 1).alias("week"), "week_start", F.date_add("week_start", 6).alias("week_end"))


def weeks_of(rows: DataFrame, day: str) -> DataFrame:
    """week, week_start, week_end and n of every week from the first day of ``rows`` to the last; weeks without rows are there."""
    ends = rows.agg(F.min(day).alias("first"), F.max(day).alias("last")).where("first is not null")  # one row
    spine = ends.select("first", F.posexplode(F.sequence("first", "last", F.expr("interval 7 days"))).alias("k", "week_start"))
    spine = spine.select((F.col("k") + 1).alias("week"), "week_start", F.date_add("week_start", 6).alias("week_end"))
    counts = rows.crossJoin(F.broadcast(ends)).groupBy(week_number(F.col(day), F.col("first")).cast("int").alias("week")).agg(F.count("*").alias("n"))
    return spine.join(counts, "week", "left").na.fill(0, ["n"])


def contributions(rows: DataFrame, by: list[str]) -> DataFrame:
    """commits, added, deleted, net, active days of (author, day, added, deleted, is_commit) rows, with the share of commits."""
    out = rows.groupBy(*by, "author").agg(
        F.sum(F.col("is_commit").cast("int")).alias("commits"), F.sum("added").alias("added"), F.sum("deleted").alias("deleted"), F.count_distinct("day").alias("active_days")
    )
    total = F.sum("commits").over(Window.partitionBy(*by)) if by else F.sum("commits").over(Window.partitionBy(F.lit(0)))
    return out.withColumn("net", F.col("added") - F.col("deleted")).withColumn("share", F.round(100 * F.col("commits") / total, 2))


def author_log(rows: DataFrame, order: str) -> DataFrame:
    """author, n, log: (day, message) in order."""
    entry = F.struct(F.col(order).alias("k"), F.col("day"), F.col("message"))
    return rows.groupBy("author").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(entry)).alias("log"))


def period(day: Column, kind: str) -> Column:
    """Bucket of a timeline: day label, ISO week or month."""
    if kind == "weekly":
        return F.date_format(day, "EEE (MMM dd)")
    if kind == "monthly":
        return F.concat(F.extract(F.lit("YEAROFWEEK"), day).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"))
    return F.date_format(day, "yyyy-MM")


def cumulative(weeks: DataFrame, measures: list[str], order: str = "week") -> DataFrame:
    """Totals up to each week; a row for each week of a project."""
    upto = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return weeks.withColumns({f"{m}_to_date": F.sum(m).over(upto) for m in measures})


def cumulative_contributions(rows: DataFrame, week: str = "week") -> DataFrame:
    """week, author and what the author has done up to that week: commits, added, deleted, net, distinct active days.

    A day counts in the week in which it first occurs, so distinct days add up.
    """
    days = rows.groupBy("author", "day").agg(F.min(week).alias(week)).groupBy("author", week).agg(F.count("*").alias("new_days"))
    each = rows.groupBy("author", week).agg(F.sum(F.col("is_commit").cast("int")).alias("commits"), F.sum("added").alias("added"), F.sum("deleted").alias("deleted"))
    upto = Window.partitionBy("author").orderBy(week).rowsBetween(Window.unboundedPreceding, 0)
    out = each.join(days, ["author", week], "left").na.fill(0, ["new_days"])
    out = out.select(week, "author", *[F.sum(c).over(upto).alias(c) for c in ("commits", "added", "deleted")], F.sum("new_days").over(upto).alias("active_days"))
    return out.withColumn("net", F.col("added") - F.col("deleted"))


def previous(weeks: DataFrame, measure: str, order: str = "week") -> DataFrame:
    """The measure of the week before, null where that week has no row."""
    by = Window.orderBy(order)
    value = F.when(F.lag(order).over(by) == F.col(order) - 1, F.lag(measure).over(by))
    return weeks.withColumn(f"previous_{measure}", value)
