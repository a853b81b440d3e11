"""Calendar queries over ``events`` (authors are users, lines are values) and a synthetic log of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from threatquery.operators import activity as ops
from threatquery.plans.catalogue import query, table
from threatquery.sources.sinks import upsert

START = "2024-01-05"
# Activity rows from events: an author's name in two spellings, one bot, added and deleted by type.
_ROWS = """SELECT event_id, CASE WHEN user_id % 10 = 0 THEN ' User  ' || (user_id % 7) WHEN user_id % 10 = 1 THEN 'ci-bot' ELSE 'user ' || (user_id % 7) END AS raw, ts::DATE AS day,
  event_type AS message, CASE WHEN event_type IN ('click', 'view') THEN floor(value)::BIGINT ELSE 0 END AS added, CASE WHEN event_type = 'error' THEN floor(value)::BIGINT ELSE 0 END AS deleted, true AS is_commit FROM events"""
_NAMED = f"SELECT *, regexp_replace(lower(trim(raw)), '\\s+', ' ', 'g') AS author FROM ({_ROWS}) WHERE NOT contains(lower(raw), 'bot')"
ALIASES = {f"user {k}": f"user {k}" for k in range(7)}
_WEEK = f"CASE WHEN day >= DATE '{START}' THEN floor((day - DATE '{START}') / 7)::BIGINT + 1 END"


def rows(spark, sf_dir):
    u, kind = F.col("user_id"), F.col("event_type")
    who = (u % 7).cast("string")
    raw = F.when(u % 10 == 0, F.concat(F.lit(" User  "), who)).when(u % 10 == 1, "ci-bot").otherwise(F.concat(F.lit("user "), who))
    whole = F.floor("value").cast("bigint")
    out = table(spark, sf_dir, "events").select(
        "event_id", raw.alias("raw"), F.to_date("ts").alias("day"), kind.alias("message"),
        F.when(kind.isin("click", "view"), whole).otherwise(0).alias("added"), F.when(kind == "error", whole).otherwise(0).alias("deleted"), F.lit(True).alias("is_commit"),
    )
    return out.where(~ops.is_bot(F.col("raw"))).withColumn("author", ops.author(F.col("raw"), ALIASES))


@query(
    f"""WITH r AS (SELECT *, {_WEEK} AS week FROM ({_NAMED}))
SELECT week, author, count(*) AS commits, sum(added)::BIGINT AS added, sum(deleted)::BIGINT AS deleted, count(DISTINCT day) AS active_days, (sum(added) - sum(deleted))::BIGINT AS net,
  round(100 * count(*) / sum(count(*)) OVER (PARTITION BY week), 2) AS share FROM r WHERE week IS NOT NULL GROUP BY week, author"""
)
def weekly_contribution(spark, sf_dir):
    weekly = rows(spark, sf_dir).withColumn("week", ops.week_number(F.col("day"), START)).where("week is not null")
    return ops.contributions(weekly, ["week"])


@query(f"SELECT author, count(*) AS n, md5(string_agg(day::VARCHAR || ' ' || message, ';' ORDER BY event_id)) AS digest FROM ({_NAMED}) GROUP BY author")
def author_log(spark, sf_dir):
    log = ops.author_log(rows(spark, sf_dir), "event_id")
    text = F.array_join(F.transform("log", lambda x: F.concat_ws(" ", x["day"].cast("string"), x["message"])), ";")
    return log.select("author", "n", F.md5(text.cast("binary")).alias("digest"))


@query(
    """WITH e AS (SELECT ts::DATE AS d FROM events), s AS (SELECT unnest(generate_series(min(d), max(d), INTERVAL 7 DAY))::DATE AS a FROM e)
SELECT (row_number() OVER (ORDER BY a))::INT AS week, a AS week_start, (a + INTERVAL 6 DAY)::DATE AS week_end, (SELECT count(*) FROM e WHERE d BETWEEN a AND a + INTERVAL 6 DAY) AS n FROM s"""
)
def week_spine(spark, sf_dir):
    """The weeks from the first event to the last, with their numbers of events."""
    return ops.weeks_of(table(spark, sf_dir, "events").select(F.to_date("ts").alias("day")), "day")


@query(
    f"""SELECT period, {', '.join(f"count_if(author = 'user {k}') AS u{k}" for k in range(7))} FROM (SELECT author, isoyear(day) || '-W' || lpad(week(day)::VARCHAR, 2, '0') AS period FROM ({_NAMED})) GROUP BY period"""
)
def timeline_pivot(spark, sf_dir):
    out = rows(spark, sf_dir).withColumn("period", ops.period(F.col("day"), "monthly"))
    pivoted = out.groupBy("period").pivot("author", [f"user {k}" for k in range(7)]).agg(F.count(F.lit(1))).na.fill(0)
    return pivoted.select("period", *[F.col(f"user {k}").alias(f"u{k}") for k in range(7)])


@query(f"SELECT strftime(day, '%a (%b %d)') AS period, count(*) AS n FROM ({_NAMED}) GROUP BY 1")
def timeline_days(spark, sf_dir):
    return rows(spark, sf_dir).groupBy(ops.period(F.col("day"), "weekly").alias("period")).agg(F.count("*").alias("n"))


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE ts >= TIMESTAMP '2024-02-05 00:00:00' - INTERVAL 30 DAY GROUP BY event_type")
def last_30_days(spark, sf_dir):
    """A rolling filter before a reference date; the bound reaches the scan."""
    since = F.lit("2024-01-06 00:00:00").cast("timestamp_ntz")
    return table(spark, sf_dir, "events").where(F.col("ts") >= since).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


_WEEKS = f"SELECT week, count(*) AS commits, sum(added)::BIGINT AS added FROM (SELECT *, {_WEEK} AS week FROM ({_NAMED})) WHERE week IS NOT NULL GROUP BY week"


def _weeks(spark, sf_dir):
    weekly = rows(spark, sf_dir).withColumn("week", ops.week_number(F.col("day"), START)).where("week is not null")
    return weekly.groupBy("week").agg(F.count("*").alias("commits"), F.sum("added").alias("added"))


@query(f"SELECT week, commits, added, (sum(commits) OVER (ORDER BY week))::BIGINT AS commits_to_date, (sum(added) OVER (ORDER BY week))::BIGINT AS added_to_date FROM ({_WEEKS})")
def cumulative_weeks(spark, sf_dir):
    return ops.cumulative(_weeks(spark, sf_dir), ["commits", "added"])


@query(
    f"""WITH r AS (SELECT *, {_WEEK} AS week FROM ({_NAMED})), w AS (SELECT DISTINCT author, week FROM r WHERE week IS NOT NULL)
SELECT w.week, w.author, count(*) AS commits, sum(added)::BIGINT AS added, sum(deleted)::BIGINT AS deleted, count(DISTINCT day) AS active_days, (sum(added) - sum(deleted))::BIGINT AS net
FROM w JOIN r ON w.author = r.author AND r.week <= w.week GROUP BY w.week, w.author"""
)
def cumulative_contributions(spark, sf_dir):
    weekly = rows(spark, sf_dir).withColumn("week", ops.week_number(F.col("day"), START)).where("week is not null")
    return ops.cumulative_contributions(weekly)


@query(f"SELECT week, commits, CASE WHEN lag(week) OVER (ORDER BY week) = week - 1 THEN lag(commits) OVER (ORDER BY week) END AS previous_commits FROM ({_WEEKS}) WHERE week <> 2")
def previous_week_delta(spark, sf_dir):
    """Week 2 is left out, so week 3 has no previous week."""
    out = ops.previous(_weeks(spark, sf_dir).where("week <> 2"), "commits")
    return out.select("week", "commits", "previous_commits")


@query(f"SELECT week, CASE WHEN week <= 2 THEN commits ELSE -1 END AS commits FROM ({_WEEKS})")
def history_upsert(spark, sf_dir):
    """Stored weeks, of which all after the second are replaced by fresh records."""
    weeks = _weeks(spark, sf_dir).select("week", "commits")
    fresh = weeks.where("week > 2").withColumn("commits", F.lit(-1).cast("bigint"))
    return upsert(weeks, fresh, "week")


@query(
    """SELECT 'user ' || (user_id % 7) AS author, count(*) AS commits, sum(CASE WHEN event_id % 9 = 0 THEN 0 ELSE floor(value) END)::BIGINT AS added, sum(CASE WHEN event_id % 9 = 0 THEN 0 ELSE event_id % 5 END)::BIGINT AS deleted,
  count(DISTINCT ts::DATE) AS active_days FROM events GROUP BY 1"""
)
def git_log_parse(spark, sf_dir):
    """A log written from the events is parsed back; binary files have no numbers."""
    e = table(spark, sf_dir, "events")
    k = F.col("event_id")
    head = e.select((k * 2).alias("line_no"), F.concat_ws("|||", F.lit("COMMIT"), F.md5(k.cast("string").cast("binary")), F.concat(F.lit("user "), (F.col("user_id") % 7).cast("string")), F.date_format("ts", "yyyy-MM-dd"), "event_type").alias("line"))
    body = e.select((k * 2 + 1).alias("line_no"), F.concat_ws("\t", F.when(k % 9 == 0, "-").otherwise(F.floor("value").cast("string")), (k % 5).cast("string"), F.lit("file")).alias("line"))
    parsed = ops.parse_log(head.unionByName(body))
    out = ops.contributions(parsed.withColumnRenamed("date", "day"), [])
    return out.select("author", "commits", "added", "deleted", "active_days")
