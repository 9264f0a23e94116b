"""Run history from the events: users are pipelines, events their runs."""

from pyspark.sql import functions as F

from checks.base import query, spread_table, sql_time_text, table, time_text
from sediment.functions.runs import run_status, time_of_millis
from sediment.operators.runs import (
    COUNTS, apply_run_counts, awaiting_reports, latest_per_group, page, recent_first, remote_runs, runs_with_names, sanitize_reports,
    sync_runs, top_n,
)

# The life-cycle and result states the event types stand for here.
_STATES = {
    "view": ("TERMINATED", "SUCCESS"), "click": ("RUNNING", None), "purchase": ("TERMINATED", "CANCELED"),
    "error": ("TERMINATED", "TIMEDOUT"), "signup": ("QUEUED", None), "login": ("SKIPPED", None),
    "logout": ("INTERNAL_ERROR", None),
}


def _choose(column, index):
    chosen = F.lit(None).cast("string")
    for kind, states in _STATES.items():
        chosen = F.when(F.col(column) == kind, F.lit(states[index])).otherwise(chosen)
    return chosen


def _sql_choose(column, index):
    cases = " ".join(f"WHEN '{k}' THEN '{s[index]}'" for k, s in _STATES.items() if s[index])
    return f"CASE {column} {cases} END"


_SQL_STATUS = """CASE event_type WHEN 'view' THEN 'success' WHEN 'purchase' THEN 'cancelled' WHEN 'error' THEN 'failed'
    WHEN 'signup' THEN 'pending' WHEN 'login' THEN 'cancelled' WHEN 'logout' THEN 'failed' ELSE 'running' END"""


@query(
    "map_run_status",
    f"""WITH s AS (SELECT event_id, {_sql_choose('event_type', 0)} AS life,
        CASE WHEN event_id % 5 = 0 THEN 'SUCCESS' ELSE {_sql_choose('event_type', 1)} END AS result FROM events)
    SELECT event_id, life, result, CASE
        WHEN life IN ('PENDING', 'QUEUED', 'BLOCKED', 'WAITING_FOR_RETRY') THEN 'pending'
        WHEN life IN ('RUNNING', 'TERMINATING') THEN 'running'
        WHEN life = 'SKIPPED' THEN 'cancelled' WHEN life = 'INTERNAL_ERROR' THEN 'failed'
        WHEN life = 'TERMINATED' THEN CASE WHEN result = 'SUCCESS' THEN 'success'
            WHEN result IN ('CANCELED', 'EXCLUDED', 'DISABLED') THEN 'cancelled' ELSE 'failed' END
        ELSE 'running' END AS status FROM s""",
)
def map_status(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(
        "event_id",
        _choose("event_type", 0).alias("life"),
        F.when(F.col("event_id") % 5 == 0, "SUCCESS").otherwise(_choose("event_type", 1)).alias("result"),
    )
    return e.withColumn("status", run_status(F.col("life"), F.col("result")))


# Half of the runs have not started yet, some have no run id.
_SQL_RUNS = f"""
runs AS (
    SELECT event_id AS id, user_id AS pipeline_id, CASE WHEN event_id % 11 <> 0 THEN 100000000 - event_id END AS run_id,
        {_SQL_STATUS} AS status, CASE WHEN event_id % 2 = 0 THEN ts - INTERVAL 1 HOUR END AS started_at,
        date_trunc('hour', ts) AS created_at
    FROM events
)"""
_ORDER = "coalesce(started_at, created_at) DESC, run_id DESC NULLS LAST, id"


def _runs(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    key = F.col("event_id")
    return e.select(
        key.alias("id"),
        F.col("user_id").alias("pipeline_id"),
        F.when(key % 11 != 0, F.lit(100000000) - key).alias("run_id"),
        run_status(_choose("event_type", 0), _choose("event_type", 1)).alias("status"),
        F.when(key % 2 == 0, F.col("ts") - F.expr("INTERVAL 1 HOUR")).alias("started_at"),
        F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("created_at"),
    )


def _began():
    return time_text(F.coalesce("started_at", "created_at")).alias("began")


_SQL_BEGAN = f"{sql_time_text('coalesce(started_at, created_at)')} AS began"


@query(
    "recent_runs_page",
    f"""WITH {_SQL_RUNS} SELECT id, pipeline_id, run_id, {_SQL_BEGAN} FROM runs ORDER BY {_ORDER} LIMIT 50 OFFSET 25""",
)
def recent_runs_page(spark, sf_dir):
    rows = page(_runs(spark, sf_dir), recent_first(), limit=50, offset=25)
    return rows.select("id", "pipeline_id", "run_id", _began())


@query("newest_runs", f"WITH {_SQL_RUNS} SELECT id, status, {_SQL_BEGAN} FROM runs ORDER BY {_ORDER} LIMIT 25")
def newest_runs(spark, sf_dir):
    return top_n(_runs(spark, sf_dir), recent_first(), 25).select("id", "status", _began())


@query(
    "awaiting_reports",
    f"""WITH {_SQL_RUNS} SELECT id, {sql_time_text('started_at')} AS finished FROM runs
    WHERE status = 'success' AND run_id IS NOT NULL AND id % 3 <> 0 ORDER BY started_at NULLS LAST, id LIMIT 10""",
)
def reports_to_read(spark, sf_dir):
    runs = _runs(spark, sf_dir).withColumns(
        {"metrics": F.when(F.col("id") % 3 == 0, "{}"), "finished_at": F.col("started_at")}
    )
    return awaiting_reports(runs).select("id", time_text("finished_at").alias("finished"))


@query(
    "latest_run_per_group",
    f"""WITH {_SQL_RUNS} SELECT pipeline_id, id, run_id, status, {_SQL_BEGAN} FROM runs
    QUALIFY row_number() OVER (PARTITION BY pipeline_id ORDER BY {_ORDER}) = 1""",
)
def latest_run_per_group(spark, sf_dir):
    return latest_per_group(_runs(spark, sf_dir), "pipeline_id").select(
        "pipeline_id", "id", "run_id", "status", _began()
    )


@query(
    "runs_by_status",
    f"""WITH {_SQL_RUNS} SELECT id, pipeline_id, c_name AS job_name, status FROM runs
    JOIN customer ON c_custkey = pipeline_id WHERE status = 'failed'""",
)
def runs_by_status(spark, sf_dir):
    names = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("pipeline_id"), F.col("c_name").alias("job_name")
    )
    return runs_with_names(_runs(spark, sf_dir), names, status="failed").select(
        "id", "pipeline_id", "job_name", "status"
    )


# The known history lacks the errors, has every third run still running, and calls every run deployed.
_SQL_SYNC = f"""
remote AS (
    SELECT user_id AS pipeline_id, event_id AS run_id, {_SQL_STATUS} AS status,
        CASE WHEN event_id % 4 = 0 THEN 'schedule' ELSE 'manual' END AS triggered_by,
        CASE WHEN event_id <> 0 THEN event_id * 1000 END AS start_s,
        CASE WHEN {_SQL_STATUS} IN ('success', 'failed', 'cancelled') THEN event_id * 1000 + 60000 END AS end_s,
        CASE WHEN {_SQL_STATUS} = 'failed' AND trim(repeat(props, 300)) <> '' THEN trim(repeat(props, 300)) END AS error
    FROM events
),
known AS (
    SELECT user_id AS pipeline_id, event_id AS run_id,
        CASE WHEN event_id % 3 = 0 THEN 'running' ELSE {_SQL_STATUS} END AS status, 'deploy' AS triggered_by,
        CASE WHEN event_id <> 0 THEN event_id * 1000 END AS start_s,
        CASE WHEN event_id % 3 <> 0 AND {_SQL_STATUS} IN ('success', 'failed', 'cancelled')
            THEN event_id * 1000 + 60000 END AS end_s,
        NULL::VARCHAR AS error
    FROM events WHERE event_type <> 'error'
)"""


@query(
    "sync_runs",
    f"""WITH {_SQL_SYNC}
    SELECT r.pipeline_id, r.run_id, r.status, coalesce(k.triggered_by, r.triggered_by) AS triggered_by,
        r.start_s AS start_ms, r.end_s AS end_ms, length(r.error) AS error_length,
        CASE WHEN k.run_id IS NULL THEN 'insert'
            WHEN k.status IS DISTINCT FROM r.status OR k.end_s IS DISTINCT FROM r.end_s OR k.error IS DISTINCT FROM r.error
            THEN 'update' ELSE 'unchanged' END AS _action
    FROM remote r LEFT JOIN known k ON k.pipeline_id = r.pipeline_id AND k.run_id = r.run_id""",
)
def sync(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    key = F.col("event_id")
    listing = e.select(
        F.col("user_id").alias("pipeline_id"), key.alias("run_id"), _choose("event_type", 0).alias("life_cycle"),
        _choose("event_type", 1).alias("result"), F.repeat("props", F.lit(300)).alias("message"),
        F.when(key % 4 == 0, "PERIODIC").otherwise("ONE_TIME").alias("trigger"),
        (key * 1000).alias("start_ms"), (key * 1000 + 60000).alias("end_ms"),
        F.concat(F.lit("https://jobs.example.com/"), key).alias("url"),
    )
    remote = remote_runs(listing)
    known = remote_runs(
        listing.join(e.where("event_type <> 'error'").select(key.alias("run_id")), "run_id", "left_semi")
    ).select(
        "pipeline_id", "run_id",
        F.when(F.col("run_id") % 3 == 0, "running").otherwise(F.col("status")).alias("status"),
        F.lit("deploy").alias("triggered_by"), "started_at",
        F.when(F.col("run_id") % 3 != 0, F.col("finished_at")).alias("finished_at"),
        F.lit(None).cast("string").alias("error_message"), "run_url",
    )
    return sync_runs(known, remote).select(
        "pipeline_id", "run_id", "status", "triggered_by", F.unix_millis("started_at").alias("start_ms"),
        F.unix_millis("finished_at").alias("end_ms"), F.length("error_message").alias("error_length"), "_action",
    )


@query(
    "time_of_millis",
    """SELECT event_id, CASE WHEN event_id <> 0 THEN event_id * 1000 END AS seen_us,
        CASE WHEN event_type <> 'error' THEN user_id * 1000 END AS user_us FROM events WHERE user_id <> 0
    UNION ALL SELECT event_id, CASE WHEN event_id <> 0 THEN event_id * 1000 END, NULL FROM events WHERE user_id = 0""",
)
def millis(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.unix_micros(time_of_millis(F.col("event_id"))).alias("seen_us"),
        F.unix_micros(time_of_millis(F.when(F.col("event_type") != "error", F.col("user_id")))).alias("user_us"),
    )


# Reports as their jobs would write them: some with wrong versions, layers, kinds and sizes of values.
_REPORT = [
    ("text", '{"v":'), ("case", "event_id % 13 = 0", "2", "1"), ("text", ',"layer":"'),
    ("case", "event_id % 7 = 0", "gold", "bronze"), ("text", '","mode":"'), ("case", "event_id % 3 = 0", "x" * 50, "full"),
    ("text", '","injected":{"a":1},"reconciled":'), ("case", "event_id % 5 = 0", '"yes"', "true"),
    ("text", ',"tables":{"t'), ("col", "user_id"), ("text", '":{"target":"main.bronze.t'), ("col", "user_id"),
    ("text", '","source":"'), ("case", "event_id % 4 = 0", "s" * 400, "raw"), ("text", '","rows_read":'), ("col", "event_id"),
    ("text", ',"rows_inserted":-'), ("col", "event_id"), ("text", ',"rows_in_target":'), ("col", "event_id"),
    ("case", "event_id % 2 = 0", ".5", ""), ("text", ',"distinct_records":'),
    ("case", "event_id % 6 = 0", "1208925819614629174706176", "12"), ("text", ',"unchanged":'),
    ("case", "event_id % 8 = 0", "true", "7"), ("text", ',"rows_written":"'), ("col", "event_id"),
    ("text", '","extra_source_columns":["ok",7,"'), ("case", "event_id % 9 = 0", "y" * 200, "z"),
    ("text", '"],"reconciled":'), ("case", "event_id % 10 = 0", "false", "true"), ("text", ',"evil":"x"},"bad":5}}'),
]


def _report_text():
    parts = []
    for kind, *rest in _REPORT:
        if kind == "text":
            parts.append(F.lit(rest[0]))
        elif kind == "col":
            parts.append(F.col(rest[0]).cast("string"))
        else:
            parts.append(F.when(F.expr(rest[0]), F.lit(rest[1])).otherwise(F.lit(rest[2])))
    return F.concat(*parts)


def _sql_report_text():
    parts = []
    for kind, *rest in _REPORT:
        if kind == "text":
            parts.append(f"'{rest[0]}'")
        elif kind == "col":
            parts.append(f"{rest[0]}::VARCHAR")
        else:
            parts.append(f"CASE WHEN {rest[0]} THEN '{rest[1]}' ELSE '{rest[2]}' END")
    return " || ".join(parts)


_SQL_REPORTS = f"""
reports AS (SELECT event_id, user_id AS producer_id, ts AS finished_at, ({_sql_report_text()})::JSON AS r FROM events),
tabled AS (
    SELECT event_id, producer_id, finished_at, r, 't' || producer_id AS table_name,
        json_extract(r, '$.tables.t' || producer_id) AS t
    FROM reports WHERE r->>'$.v' = '1' AND r->>'$.layer' IN ('raw', 'bronze', 'silver')
),
clean AS (
    SELECT event_id, producer_id, finished_at, table_name, r->>'$.layer' AS layer, r->>'$.mode' AS mode,
        json_type(r, '$.reconciled') = 'BOOLEAN' AND r->>'$.reconciled' = 'true' AND t->>'$.reconciled' <> 'false' AS run_reconciled,
        {', '.join(f'''CASE WHEN json_type(t, '$.{k}') IN ('UBIGINT', 'BIGINT') AND (t->>'$.{k}')::HUGEINT BETWEEN 0 AND 9007199254740992
            THEN (t->>'$.{k}')::BIGINT END AS {k}''' for k in COUNTS)},
        t->>'$.source' AS source, t->>'$.target' AS target,
        'ok,' || (t->>'$.extra_source_columns[2]') AS extra, (t->>'$.reconciled')::BOOLEAN AS reconciled
    FROM tabled
)"""


def _reports(spark, sf_dir):
    return spread_table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("producer_id"), F.col("ts").cast("timestamp").alias("finished_at"),
        _report_text().alias("report"),
    )


@query("sanitize_reports", f"WITH {_SQL_REPORTS} SELECT * EXCLUDE (producer_id, finished_at) FROM clean")
def sanitized(spark, sf_dir):
    rows = sanitize_reports(_reports(spark, sf_dir))
    return rows.withColumn("extra", F.array_join("extra_source_columns", ",")).drop(
        "extra_source_columns", "producer_id", "finished_at"
    )


@query(
    "sanitize_long_reports",
    """SELECT event_id // 400 AS report_id, count(*) AS tables, bool_and(event_id % 1200 <> 399) AS run_reconciled,
        sum(event_id)::BIGINT AS rows_read, 500::BIGINT AS longest FROM events GROUP BY 1""",
)
def long_reports(spark, sf_dir):
    """Reports of 400 tables and more than 200,000 characters; in every third one the last table objects."""
    key = F.col("event_id").cast("string")
    flag = F.when(F.col("event_id") % 1200 == 399, "false").otherwise("true")
    entry = F.concat(F.lit('"t'), key, F.lit('":{"rows_read":'), key, F.lit(f',"source":"{"s" * 500}","reconciled":'), flag, F.lit("}"))
    events = table(spark, sf_dir, "events").select(F.expr("event_id div 400").alias("report_id"), entry.alias("entry"))
    reports = events.groupBy("report_id").agg(F.concat(
        F.lit('{"v":1,"layer":"raw","reconciled":true,"tables":{'), F.array_join(F.collect_list("entry"), ","), F.lit("}}")
    ).alias("report"))
    return sanitize_reports(reports).groupBy("report_id").agg(
        F.count(F.lit(1)).alias("tables"), F.bool_and("run_reconciled").alias("run_reconciled"),
        F.sum("rows_read").alias("rows_read"), F.max(F.length("source")).cast("bigint").alias("longest"),
    )


@query(
    "apply_run_counts",
    f"""WITH {_SQL_REPORTS},
    latest AS (SELECT producer_id, finished_at, rows_in_target FROM clean WHERE rows_in_target IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY producer_id ORDER BY finished_at DESC, rows_in_target DESC) = 1),
    assets AS (SELECT DISTINCT user_id, CASE WHEN user_id % 2 = 0 THEN TIMESTAMP '2024-01-20' END AS last_run FROM events)
    SELECT user_id AS produced_by, 't' || user_id AS table_name,
        CASE WHEN user_id % 5 <> 0 AND finished_at >= coalesce(last_run, finished_at) THEN rows_in_target ELSE -1 END AS row_count,
        {sql_time_text('''CASE WHEN user_id % 5 <> 0 AND finished_at >= coalesce(last_run, finished_at) THEN finished_at
            ELSE last_run END''')} AS last_run_at
    FROM assets LEFT JOIN latest ON producer_id = user_id""",
)
def run_counts(spark, sf_dir):
    """Every user's table, some produced by somebody else, some measured lately."""
    user = F.col("user_id")
    assets = table(spark, sf_dir, "events").select(user).distinct().select(
        F.when(user % 5 != 0, user).otherwise(-user - 1).alias("produced_by"),
        F.lit("main").alias("catalog"), F.lit("bronze").alias("schema_name"),
        F.concat(F.lit("t"), user).alias("table_name"), F.lit(-1).cast("bigint").alias("row_count"),
        F.when(user % 2 == 0, F.lit("2024-01-20 00:00:00").cast("timestamp")).alias("last_run_at"),
    )
    reported = sanitize_reports(_reports(spark, sf_dir))
    updated = apply_run_counts(assets, reported, F.lit("2030-01-01 00:00:00"))
    owner = F.when(F.col("produced_by") < 0, -F.col("produced_by") - 1).otherwise(F.col("produced_by"))
    return updated.select(
        owner.alias("produced_by"), "table_name", "row_count", time_text("last_run_at").alias("last_run_at")
    )
