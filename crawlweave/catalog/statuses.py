"""Stop rules, budgets, counts and status over the crawl log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlweave.catalog.registry import query, table
from crawlweave.catalog.shapes import CONTROL_SQL, LOG_SQL, crawl_log, millis, stop_signals
from crawlweave.functions import records
from crawlweave.operators import frontier as steps
from crawlweave.operators import status as ops
from crawlweave.plans.progress import progress_report

NOW_SQL = "TIMESTAMP '2024-01-15 12:00:00'"


def _now():
    return F.to_timestamp(F.lit("2024-01-15 12:00:00"))


def _log(spark: SparkSession, folder: str) -> DataFrame:
    return crawl_log(table(spark, folder, "events"))


def _control(spark: SparkSession, folder: str) -> DataFrame:
    return stop_signals(table(spark, folder, "events"))


@query(
    "stop_reason",
    f"""WITH {LOG_SQL}
    SELECT seq, CASE
        WHEN max_distance >= 0 AND distance > max_distance THEN 'maxDistance'
        WHEN max_urls > 0 AND seq % 23 >= max_urls THEN 'maxUrls'
        WHEN {NOW_SQL} >= max_time THEN 'timeout'
        WHEN event_type = 'error' THEN 'userInitiated' END AS reason
    FROM log""",
)
def stop_reason(spark: SparkSession, folder: str) -> DataFrame:
    c = F.col
    reason = records.stop_reason(
        c("distance"),
        c("max_distance"),
        c("seq") % 23,
        c("max_urls"),
        _now(),
        c("max_time"),
        c("event_type") == "error",
    )
    return _log(spark, folder).select("seq", reason.alias("reason"))


@query(
    "budget_slots",
    f"""WITH {LOG_SQL}
    SELECT seq, CASE WHEN max_urls > 0 THEN max_urls - seq % 23 ELSE 2147483647 END AS slots
    FROM log""",
)
def budget_slots(spark: SparkSession, folder: str) -> DataFrame:
    slots = records.slots_left(F.col("max_urls"), F.col("seq") % 23)
    return _log(spark, folder).select("seq", slots.cast("bigint").alias("slots"))


@query(
    "safe_int",
    """SELECT event_id, CASE event_id % 5 WHEN 0 THEN event_id WHEN 1 THEN 0 WHEN 2 THEN 0
         WHEN 3 THEN -(event_id % 1000) ELSE 0 END AS n FROM events""",
)
def safe_int(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("event_id") % 5
    text = (
        F.when(k == 0, F.col("event_id").cast("string"))
        .when(k == 1, F.col("value").cast("string"))
        .when(k == 2, F.col("props"))
        .when(k == 3, F.concat(F.lit("-"), (F.col("event_id") % 1000).cast("string")))
    )
    return table(spark, folder, "events").select(
        "event_id", records.int_or_zero(text).cast("bigint").alias("n")
    )


@query(
    "stop_filter",
    f"""WITH {LOG_SQL}, {CONTROL_SQL}
    SELECT seq, crawl_id FROM log WHERE crawl_id NOT IN (SELECT crawl_id FROM control)""",
)
def stop_filter(spark: SparkSession, folder: str) -> DataFrame:
    kept = steps.without_stopped(_log(spark, folder), _control(spark, folder))
    return kept.select("seq", "crawl_id")


@query(
    "deadline_filter",
    f"WITH {LOG_SQL} SELECT seq, crawl_id FROM log WHERE {NOW_SQL} < max_time",
)
def deadline_filter(spark: SparkSession, folder: str) -> DataFrame:
    return steps.before_deadline(_log(spark, folder), _now()).select("seq", "crawl_id")


@query(
    "visited_count",
    f"WITH {LOG_SQL} SELECT crawl_id, count(DISTINCT url) AS num_pages FROM log GROUP BY 1",
)
def visited_count(spark: SparkSession, folder: str) -> DataFrame:
    return ops.visited_count(_log(spark, folder))


_LATEST_SQL = f"""{LOG_SQL},
latest AS (SELECT crawl_id, max_by({{'d': distance, 's': stop_reason, 'e': error_message}}, seq) AS f,
             min(noted) AS start_time, max(noted) AS last_modified, count(DISTINCT url) AS num_pages
           FROM log GROUP BY 1)"""

STATUS_SQL = f"""WITH {_LATEST_SQL}
    SELECT crawl_id, f.d AS distance, f.s AS stop_reason, f.e AS error_message,
           (epoch_us(start_time) // 1000) AS start_ms, (epoch_us(last_modified) // 1000) AS modified_ms FROM latest"""


def status_out(status: DataFrame) -> DataFrame:
    return status.select(
        "crawl_id",
        F.col("distance").cast("bigint").alias("distance"),
        "stop_reason",
        "error_message",
        millis(F.col("start_time")).alias("start_ms"),
        millis(F.col("last_modified")).alias("modified_ms"),
    )


@query("status_latest", STATUS_SQL)
def status_latest(spark: SparkSession, folder: str) -> DataFrame:
    return status_out(ops.status_latest(_log(spark, folder)))


@query(
    "status_view",
    f"""WITH {_LATEST_SQL},
    asked AS (SELECT crawl_id FROM latest
              UNION ALL SELECT 'unknown-' || crawl_id FROM latest)
    SELECT a.crawl_id, coalesce(f.d, 0) AS distance, coalesce(num_pages, 0) AS num_pages,
           CASE WHEN f.s IN ('maxDistance', 'maxUrls', 'timeout', 'userInitiated') THEN f.s END
             AS stop_reason,
           f.e AS error_message,
           (epoch_us(coalesce(start_time, {NOW_SQL})) // 1000) AS start_ms,
           (epoch_us(last_modified) // 1000) AS modified_ms
    FROM asked a LEFT JOIN latest l ON a.crawl_id = l.crawl_id""",
)
def status_view(spark: SparkSession, folder: str) -> DataFrame:
    log = _log(spark, folder)
    known = log.select("crawl_id").distinct()
    missing = known.select(F.concat(F.lit("unknown-"), "crawl_id").alias("crawl_id"))
    report = progress_report(known.unionByName(missing), log, _now())
    return status_out(report).join(report.select("crawl_id", "num_pages"), "crawl_id")


@query(
    "status_unknown",
    f"""WITH {_LATEST_SQL} SELECT crawl_id, f.s AS stop_reason FROM latest
    WHERE f.s NOT IN ('maxDistance', 'maxUrls', 'timeout', 'userInitiated')""",
)
def status_unknown(spark: SparkSession, folder: str) -> DataFrame:
    """Stored reasons that are none of the known names are shown, not dropped."""
    status = ops.status_latest(_log(spark, folder))
    return ops.unknown_stop_reasons(status).select("crawl_id", "stop_reason")


def _store(spark: SparkSession, folder: str) -> DataFrame:
    """Status store as JSON; every fifth user's text is damaged."""
    log = _log(spark, folder)
    status = ops.status_latest(log).join(ops.visited_count(log), "crawl_id")
    damaged = F.col("crawl_id").cast("bigint") % 5 == 0
    return ops.encode_status(status).withColumn(
        "value", F.when(damaged, "{broken").otherwise(F.col("value"))
    )


@query(
    "status_read",
    f"""WITH {_LATEST_SQL}
    SELECT log.seq, log.crawl_id,
           CASE WHEN CAST(log.crawl_id AS BIGINT) % 5 = 0 THEN (epoch_us({NOW_SQL}) // 1000)
                ELSE (epoch_us(l.start_time) // 1000) END AS started_ms
    FROM log JOIN latest l ON log.crawl_id = l.crawl_id""",
)
def status_read(spark: SparkSession, folder: str) -> DataFrame:
    status = ops.decode_status(_store(spark, folder))
    records_ = ops.with_start_time(_log(spark, folder), status, _now())
    return records_.select("seq", "crawl_id", millis(F.col("started")).alias("started_ms"))


@query(
    "crawl_init",
    f"""WITH {_LATEST_SQL},
    starting AS (SELECT DISTINCT crawl_id FROM log WHERE event_type = 'signup'
                 UNION SELECT 'new-' || crawl_id FROM log)
    SELECT crawl_id, 0 AS distance, NULL AS stop_reason, NULL AS error_message,
           (epoch_us({NOW_SQL}) // 1000) AS start_ms, (epoch_us({NOW_SQL}) // 1000) AS modified_ms, 0 AS num_pages
    FROM starting
    UNION ALL
    SELECT crawl_id, f.d, f.s, f.e, (epoch_us(start_time) // 1000), (epoch_us(last_modified) // 1000), num_pages
    FROM latest WHERE crawl_id NOT IN (SELECT crawl_id FROM starting)""",
)
def crawl_init(spark: SparkSession, folder: str) -> DataFrame:
    log = _log(spark, folder)
    status = ops.status_latest(log).join(ops.visited_count(log), "crawl_id")
    starting = (
        log.where("event_type = 'signup'")
        .select("crawl_id")
        .unionByName(log.select(F.concat(F.lit("new-"), "crawl_id").alias("crawl_id")))
    )
    store = ops.reset_status(status, starting, _now())
    return store.select(
        "crawl_id",
        F.col("distance").cast("bigint").alias("distance"),
        "stop_reason",
        "error_message",
        millis(F.col("start_time")).alias("start_ms"),
        millis(F.col("last_modified")).alias("modified_ms"),
        "num_pages",
    )


@query(
    "stop_apply",
    f"""WITH {_LATEST_SQL}, {CONTROL_SQL}
    SELECT l.crawl_id, f.d AS distance,
           CASE WHEN f.s IS NULL AND stopped_at IS NOT NULL THEN 'userInitiated' ELSE f.s END
             AS stop_reason,
           CASE WHEN f.s IS NULL AND stopped_at IS NOT NULL THEN 'Manually stopped by user'
                ELSE f.e END AS error_message,
           (epoch_us(start_time) // 1000) AS start_ms,
           epoch_us(CASE WHEN f.s IS NULL AND stopped_at IS NOT NULL THEN stopped_at
                         ELSE last_modified END) // 1000 AS modified_ms
    FROM latest l LEFT JOIN control c ON l.crawl_id = c.crawl_id""",
)
def stop_apply(spark: SparkSession, folder: str) -> DataFrame:
    log = _log(spark, folder)
    status = ops.status_latest(log).join(ops.visited_count(log), "crawl_id")
    return status_out(steps.apply_stops(status, _control(spark, folder)))


@query(
    "status_changes",
    f"""WITH {LOG_SQL},
    snap AS (SELECT crawl_id, CAST(noted AS DATE) AS day, max(seq) AS s,
               max_by({{'d': distance, 's': stop_reason}}, seq) AS f, count(*) AS num_pages
             FROM log GROUP BY 1, 2),
    prev AS (SELECT *, lag(f) OVER w AS pf, lag(num_pages) OVER w AS pn, lag(day) OVER w AS pd
             FROM snap WINDOW w AS (PARTITION BY crawl_id ORDER BY day))
    SELECT crawl_id, strftime(day, '%Y-%m-%d') AS day, f.d AS distance, f.s AS stop_reason,
           num_pages
    FROM prev WHERE pd IS NULL OR pf.d IS DISTINCT FROM f.d OR pf.s IS DISTINCT FROM f.s
                OR pn IS DISTINCT FROM num_pages""",
)
def status_changes(spark: SparkSession, folder: str) -> DataFrame:
    fixed = F.date_trunc("year", F.max("at"))
    snapshots = (
        _log(spark, folder)
        .groupBy("crawl_id", F.to_date("at").alias("day"))
        .agg(
            F.max_by(F.struct("distance", "stop_reason", "error_message"), "seq").alias("_f"),
            F.count("*").alias("num_pages"),
            fixed.alias("start_time"),
            fixed.alias("last_modified"),
        )
        .select("crawl_id", "day", "_f.*", "num_pages", "start_time", "last_modified")
    )
    return ops.status_changes(snapshots).select(
        "crawl_id",
        F.date_format("day", "yyyy-MM-dd").alias("day"),
        F.col("distance").cast("bigint").alias("distance"),
        "stop_reason",
        "num_pages",
    )


@query(
    "budget_running",
    f"""WITH {LOG_SQL},
    f AS (SELECT crawl_id, seq, max_urls, CASE WHEN row_number() OVER
            (PARTITION BY crawl_id, url ORDER BY seq) = 1 THEN 1 ELSE 0 END AS new FROM log),
    r AS (SELECT *, coalesce(sum(new) OVER (PARTITION BY crawl_id ORDER BY seq
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM f)
    SELECT crawl_id, seq, CAST(before AS BIGINT) AS before,
           max_urls <= 0 OR before < max_urls AS fetched FROM r""",
)
def budget_running(spark: SparkSession, folder: str) -> DataFrame:
    log = _log(spark, folder)
    first = log.groupBy("crawl_id", "url").agg(F.min("seq").alias("seq")).drop("url")
    marked = log.select("crawl_id", "seq", "max_urls").join(
        first.withColumn("new", F.lit(1)), ["crawl_id", "seq"], "left"
    )
    counted = steps.running_visited(marked, F.coalesce("new", F.lit(0)))
    fetched = (F.col("max_urls") <= 0) | (F.col("before") < F.col("max_urls"))
    return counted.select("crawl_id", "seq", "before", fetched.alias("fetched"))
