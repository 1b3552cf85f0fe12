"""Checks of history, records, rules, text, rate limits, streams and flows."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.drifting import md5_number
from checks.common import derived, rounded, scratch, table, with_
from plumbline.functions import rules as V
from plumbline.functions import scores as SC
from plumbline.functions import text as TX
from plumbline.operators import features as X
from plumbline.operators import history as H
from plumbline.operators import model as ML
from plumbline.operators import rate_limit as RL
from plumbline.operators import records as R
from plumbline.plans.flow import build, monitor
from plumbline.sources.readers import load_stream, unpack_json_payload
from plumbline.streaming import jobs as J

KEY, ORDER = ["user_id"], ["ts", "event_id"]
EVENT = ["event_id", "user_id", "event_type", "value"]
EVENT_SQL = ", ".join(EVENT)


def events(spark, d):
    return table(spark, d, "events")


def ranked(order: str, where: str, partition: str = "PARTITION BY user_id ") -> str:
    return (f"SELECT {EVENT_SQL} FROM (SELECT *, row_number() OVER ({partition}ORDER BY {order}) AS rn FROM events) WHERE {where}")


NEWEST = "ts DESC, event_id DESC"

# One row per page and kind of address; both engines read the same text.
URLS = " UNION ALL ".join(f"SELECT page_id, {i} AS kind, {e} AS url FROM pages" for i, e in enumerate([
    "url", "replace(url, 'http', 'ftp')", "concat('http://localhost:8080/', page_id)", "concat('http://10.0.', page_id % 256, '.1/x')",
    "concat('https://user@192.168.1.', page_id % 256, ':80/a?b=c')", "concat('http://172.', page_id % 40, '.0.9/')", "concat('example.com/', page_id)",
    "concat('s3://bucket/key-', page_id)", "concat('http:///', page_id)", "concat('HTTP://169.254.', page_id % 300, '.7')"]))
HOST = "lower(regexp_replace(regexp_replace(regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', ''))"
URL_SQL = (
    f"WITH u AS ({URLS}), p AS (SELECT *, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme, {HOST} AS host, "
    f"regexp_matches({HOST}, '^[0-9]{{1,3}}(\\.[0-9]{{1,3}}){{3}}$') AS ip FROM u), "
    "q AS (SELECT *, CASE WHEN ip THEN split_part(host, '.', 1)::INT END AS a, CASE WHEN ip THEN split_part(host, '.', 2)::INT END AS b FROM p) "
    "SELECT page_id, kind, scheme IN ('http', 'https', 's3', 'gs', 'az', 'file') AND (scheme NOT IN ('http', 'https') OR host <> '') "
    "AND host NOT IN ('localhost', '127.0.0.1', '0.0.0.0', '::1') AND NOT coalesce(a = 10 OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 169 AND b = 254), false) AS ok FROM q")


def _urls(spark, d):
    found = spark.sql(URLS.replace("FROM pages", "FROM {pages}"), pages=table(spark, d, "pages"))
    return found.select("page_id", "kind", V.url_ok(F.col("url")).alias("ok"))


FILES = ("SELECT page_id, CASE page_id % 6 WHEN 0 THEN concat('data/', page_id, '.CSV') WHEN 1 THEN concat('../', page_id, '.csv') "
         "WHEN 2 THEN concat('/etc/', page_id, '.json') WHEN 3 THEN concat('in/', page_id, '.exe') WHEN 4 THEN concat('a.b/', page_id) "
         "ELSE concat('/home/x/', page_id, '.parquet') END AS path, CAST(length(html) * 40000 AS BIGINT) AS size_bytes, "
         "CASE page_id % 4 WHEN 0 THEN 'text/csv; charset=utf-8' WHEN 1 THEN ' Application/JSON' WHEN 2 THEN 'text/html' ELSE 'image/png' END AS content_type FROM pages")
PATH_OK = ("(NOT regexp_matches(path, '\\.\\./|^/etc/|^/var/|^/proc/|^/sys/|^/dev/') AND NOT starts_with(path, '/'))")
EXT_OK = ("lower(regexp_extract(path, '[^/](\\.[^./]+)$', 1)) IN ('.csv', '.parquet', '.json', '.jsonl', '.xlsx', '.xls', '.feather', '.arrow', '.pkl', '.pickle', '.txt', '.tsv')")
SIZE_OK = "size_bytes <= 104857600"


def files(spark, d):
    # length is a 32-bit number in Spark and a 64-bit one in DuckDB
    wide = FILES.replace("length(html)", "CAST(length(html) AS BIGINT)")
    return spark.sql(wide.replace("FROM pages", "FROM {pages}"), pages=table(spark, d, "pages"))


def _quarantine(spark, d):
    made = files(spark, d)
    good, bad = V.validate_rows(made, V.file_rules(F.col("path"), F.col("size_bytes")))
    return good.select("page_id", F.lit("").alias("failed")).unionByName(
        bad.select("page_id", F.concat_ws(",", "failed_rules").alias("failed")))


def _names(spark, d):
    part = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    supplier = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.regexp_replace("s_name", "#", "_").alias("name"))
    both = part.unionByName(supplier)
    md5 = F.md5(F.col("name"))
    dashed = F.concat_ws("-", *[F.substring(md5, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    code = F.upper(F.when(F.col("id") % 3 == 0, md5).otherwise(dashed))
    return both.select("id", "name", V.name_ok(F.col("name")).alias("name_ok"), V.uuid_ok(code).alias("uuid_ok"))


NAMES_SQL = (
    "SELECT id, name, regexp_full_match(name, '[A-Za-z][A-Za-z0-9_]*') AND length(name) <= 100 AS name_ok, id % 3 <> 0 AS uuid_ok FROM "
    "(SELECT p_partkey AS id, p_name AS name FROM part UNION ALL SELECT s_suppkey, replace(s_name, '#', '_') FROM supplier)")

# Fixed values, repeated here for an independent comparison.
BANNED = ["DROP ", "DELETE ", "TRUNCATE ", "ALTER ", "CREATE ", "INSERT ", "UPDATE ", "GRANT ", "REVOKE ", "EXEC ", "EXECUTE ", "XP_", "SP_", "--", "/*", "*/"]
QUERY = "CASE doc_id % 3 WHEN 0 THEN text ELSE concat(' select ', text) END"

METRICS = ("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE value / 100 END AS success_rate, CASE WHEN event_id % 8 < 3 THEN NULL ELSE value / 150 END AS user_satisfaction, "
           "CASE WHEN event_id % 16 < 9 THEN NULL ELSE value / 80 END AS efficiency FROM events")


def metrics(spark, d):
    return spark.sql(METRICS.replace("FROM events", "FROM {events}"), events=events(spark, d))


def clip(c: str) -> str:
    return f"greatest(0.0, least(1.0, {c}))"


SCORES_SQL = (
    f"WITH m AS ({METRICS}), w AS (SELECT *, coalesce(0.4 * {clip('success_rate')}, 0) * (success_rate IS NOT NULL)::INT + coalesce(0.3 * {clip('user_satisfaction')}, 0) * (user_satisfaction IS NOT NULL)::INT "
    f"+ coalesce(0.2 * {clip('efficiency')}, 0) * (efficiency IS NOT NULL)::INT AS s, 0.4 * (success_rate IS NOT NULL)::INT + 0.3 * (user_satisfaction IS NOT NULL)::INT + 0.2 * (efficiency IS NOT NULL)::INT AS g FROM m) "
    "SELECT event_id, round(CASE WHEN g > 0 THEN s / g ELSE 0.5 END, 6)::DOUBLE AS score, "
    "round(coalesce(success_rate, 0.8) * 0.4 + coalesce(user_satisfaction, 0.7) * 0.4 + coalesce(efficiency, 0.8) * 0.2, 3)::DOUBLE AS reward FROM w")


def _scores(spark, d):
    named = {c: F.col(c) for c in ("success_rate", "user_satisfaction", "efficiency")}
    return metrics(spark, d).select("event_id", F.round(SC.weighted_score(named), 6).alias("score"),
                                    SC.composite_reward(*named.values()).alias("reward"))


WORDS = "list_distinct(list_filter(string_split_regex({c}, '[\\t-\\r\\x1c-\\x20\\x{{85}}\\p{{Z}}]+'), lambda w: w <> ''))"
NEW_TEXT = "concat(replace(text, 'the', 'example'), ' Clarify')"
CHANGE_SQL = (
    f"WITH t AS (SELECT doc_id, lower({NEW_TEXT}) AS l, {WORDS.format(c='text')} AS a, {WORDS.format(c=NEW_TEXT)} AS b FROM documents) "
    "SELECT doc_id, round(least(0.3, 0.05 * (" + " + ".join(f"contains(l, '{w}')::INT" for w in ("improve", "add", "clarify", "specific", "example"))
    + ") + 0.1 * (1 - len(list_intersect(a, b)) / greatest(len(a), 1)::DOUBLE)), 3)::DOUBLE AS gain FROM t")
# Fixed values, repeated here for an independent comparison.
TAGS = {"data loading": "loader", "cleaning": "cleaning", "analysis": "profile", "features": "features", "model": "model", "api": "serving",
        "docker": "packaging", "deploy": "deployment", "drift": "drift"}
FEEDBACK = "concat(text, CASE doc_id % 5 WHEN 0 THEN ' The MODEL and its Features' WHEN 1 THEN ' data loading' ELSE '' END)"

ARTIFACTS_SQL = ("SELECT CAST(event_id AS VARCHAR) AS id, CAST(user_id % 20 AS VARCHAR) AS job_id, event_type AS agent, "
                 "CASE WHEN event_id % 2 = 0 THEN 'data' ELSE 'report' END AS type, CAST(floor(value * 1000) AS BIGINT) AS size_bytes, "
                 "[event_type, CASE WHEN value > 50 THEN 'big' ELSE 'small' END] AS tags FROM events")


def artifacts(spark, d):
    return events(spark, d).selectExpr(
        "CAST(event_id AS STRING) AS id", "CAST(user_id % 20 AS STRING) AS job_id", "event_type AS agent",
        "CASE WHEN event_id % 2 = 0 THEN 'data' ELSE 'report' END AS type", "CAST(floor(value * 1000) AS BIGINT) AS size_bytes",
        "array(event_type, CASE WHEN value > 50 THEN 'big' ELSE 'small' END) AS tags")


BY_AGENT = ("SELECT CAST(user_id AS VARCHAR) AS agent, avg(CASE WHEN event_type = 'error' THEN 0.0 ELSE 1.0 END) AS success_rate, avg(value) / 60 AS user_satisfaction FROM events GROUP BY 1")


def _by_agent(spark, d):
    return events(spark, d).groupBy(F.col("user_id").cast("string").alias("agent")).agg(
        F.avg(F.when(F.col("event_type") == "error", 0.0).otherwise(1.0)).alias("success_rate"), (F.avg("value") / 60).alias("user_satisfaction"))


def _feedback(spark, d):
    return spark.sql(f"SELECT {FEEDBACK} AS text FROM {{documents}}", documents=table(spark, d, "documents"))


TARGETS_SQL = (f"WITH m AS ({BY_AGENT}), f AS (SELECT lower({FEEDBACK}) AS t FROM documents) "
               "SELECT agent AS target FROM m WHERE success_rate < 0.8 OR user_satisfaction < 0.7 "
               + " ".join(f"UNION SELECT '{label}' FROM f WHERE contains(t, '{word}')" for word, label in TAGS.items()))

RATE, BURST = 1, 2
BUCKET_SQL = (
    "WITH RECURSIVE o AS (SELECT event_id, user_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events), "
    f"b AS (SELECT event_id, user_id, us, rn, {BURST} * 60000000::BIGINT - 60000000 AS units, true AS allowed FROM o WHERE rn = 1 "
    "UNION ALL SELECT o.event_id, o.user_id, o.us, o.rn, CASE WHEN {have} >= 60000000 THEN {have} - 60000000 ELSE {have} END, {have} >= 60000000 "
    "FROM b JOIN o ON o.user_id = b.user_id AND o.rn = b.rn + 1) "
    "SELECT event_id, user_id, allowed, CASE WHEN allowed THEN 0.0 ELSE round((60000000 - units) / 1000000.0::DOUBLE, 6) END AS retry_after, units // 60000000 AS remaining FROM b"
).replace("{have}", f"least({BURST} * 60000000::BIGINT, b.units + (o.us - b.us) * {RATE})")


PAYLOADS = ("SELECT event_id, CASE event_id % 6 WHEN 0 THEN concat('[', props, ', ', props, ']') WHEN 1 THEN concat('{\"items\": [', props, ']}') WHEN 2 THEN props "
            "WHEN 3 THEN 'nothing here' WHEN 4 THEN concat('{\"data\": 5, \"records\": [', props, ']}') ELSE concat('{\"results\": [], \"k\": 1}') END AS payload FROM events")
PAYLOADS_SQL = (
    f"WITH p AS ({PAYLOADS}), k AS (SELECT event_id, payload, json_extract(CASE WHEN event_id % 6 IN (3, 5) THEN NULL WHEN event_id % 6 = 0 THEN payload->'$[0]' "
    "WHEN event_id % 6 = 1 THEN payload->'$.items[0]' WHEN event_id % 6 = 2 THEN payload ELSE payload->'$.records[0]' END, '$.k')::INT AS k FROM p) "
    "SELECT event_id, k FROM k WHERE k IS NOT NULL UNION ALL SELECT event_id, k FROM k WHERE event_id % 6 = 0")


def _payloads(spark, d):
    sql = PAYLOADS.replace("{", "{{").replace("}", "}}").replace("FROM events", "FROM {events}")
    return unpack_json_payload(spark.sql(sql, events=events(spark, d)), "payload", "k INT", ["event_id"])


STREAM_FILES = 6


def _build_model(spark, d):
    """Trains: a linear model has a closed form, so its errors on the held-out rows are known."""
    config = ML.AutoMLConfig("regression", ["linear"], trials=1, folds=2, space={})
    made = build(spark, table(spark, d, "part").select("p_partkey", "p_retailprice"), ["p_partkey"], features=X.FeaturePlan("p_retailprice", ["p_partkey"]), model=config)
    return rounded(made.model.metrics, 3).withColumn("rows", F.lit(made.table.count()))


def stream_of(spark, d, name: str, order: str = "ts"):
    """The table as a stream of several micro-batches, one file each, in the order of time (or of a key)."""
    rows = table(spark, d, name)
    path = scratch(spark, f"stream-{name}")
    value = (F.col(order).cast("timestamp") if order == "ts" else F.col(order)).cast("double")
    low, high = rows.agg(F.min(value), F.max(value)).first()
    part = F.coalesce(F.least(F.lit(STREAM_FILES - 1), F.floor((value - low) / ((high - low) or 1.0) * STREAM_FILES)), F.lit(0))
    for i in range(STREAM_FILES):
        # written one after the other, so that the source lists them in this order; the table is read by many tasks
        rows.filter(part == i).repartition(1).write.mode("append").parquet(path)
    return load_stream(spark, path, rows.schema, "parquet", maxFilesPerTrigger="1")


def _run(stream, spark):
    return J.run_available(stream, scratch(spark, "stream-out"), scratch(spark, "stream-state"))


def _stream_drift(spark, d):
    path = scratch(spark, "stream-drift")

    def sink(scores, batch_id: int) -> None:
        scores.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    job = J.stream_drift(stream_of(spark, d, "events"), events(spark, d), "ts", ["event_type", "value"], "5 days", "1 hour", sink=sink)
    job.option("checkpointLocation", scratch(spark, "stream-state")).trigger(availableNow=True).start().awaitTermination()
    out = rounded(spark.read.parquet(path)).drop("batch_id")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})


def _stream_score(spark, d):
    part = table(spark, d, "part")
    fitted = X.fit_features(part, X.FeaturePlan("p_retailprice", ["p_partkey"], scaling="minmax"))
    model = ML.LinearRegression(regParam=0.0).fit(ML.assemble(fitted.transform(part), ["numeric__p_partkey"], "p_retailprice"))
    out = _run(ML.score(stream_of(spark, d, "part", "p_partkey"), fitted, model, ["p_partkey"]), spark)
    return out.withColumn("prediction", F.round("prediction", 1))


def _stream_breaches(spark, d):
    stream = stream_of(spark, d, "events").withColumn("tokens", F.floor("value").cast("bigint"))
    out = _run(J.stream_limit_breaches(stream, "ts", tokens="tokens", requests_per_minute=1), spark)
    return out.withColumn("minute", F.col("minute").cast("timestamp_ntz"))


def window_sql() -> str:
    from checks.drifting import LEVEL
    from checks.drifting import window_sql as whole
    step = "INTERVAL 5 DAY"
    value = (
        "WITH e AS (SELECT min(value) AS lo, (max(value) - min(value)) / 10 AS w FROM events), "
        f"v AS (SELECT time_bucket({step}, ts, TIMESTAMP '1970-01-01') AS s, least(9, floor((value - lo) / w))::INT AS b FROM events, e), "
        "r AS (SELECT g.b, greatest(count(v.b) / (SELECT count(*) FROM v)::DOUBLE, 0.0001) AS p FROM (SELECT unnest(range(10)) AS b) g LEFT JOIN v USING (b) GROUP BY 1), "
        "t AS (SELECT s, count(*) AS rows FROM v GROUP BY 1), n AS (SELECT s, b, count(*) AS n FROM v GROUP BY 1, 2), "
        "x AS (SELECT t.s, t.rows, least(abs(sum((greatest(coalesce(n, 0) / t.rows::DOUBLE, 0.0001) - p) * ln(greatest(coalesce(n, 0) / t.rows::DOUBLE, 0.0001) / p))), 1.0) AS score "
        "FROM t CROSS JOIN r LEFT JOIN n ON n.s = t.s AND n.b = r.b GROUP BY 1, 2) "
        f"SELECT s AS window_start, s + {step} AS window_end, 'value' AS \"column\", rows, round(score, 6)::DOUBLE AS score, {LEVEL} AS level FROM x")
    return f"SELECT * FROM (SELECT * FROM ({whole(5)}) UNION ALL SELECT * FROM ({value})) WHERE window_end <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)"


PART_PLAN = dict(target="p_retailprice", numeric=["p_partkey", "p_size"], categorical=["p_type"])


def _build(spark, d):
    made = build(spark, f"{d}/part.parquet", ["p_partkey"], features=X.FeaturePlan(**PART_PLAN))
    return rounded(made.table)


TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
BUILD_SQL = ("SELECT " + ", ".join(f"round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 6) AS numeric__{c}" for c in ("p_partkey", "p_size")) + ", "
             + "{types}, p_partkey, round(p_retailprice, 6) AS p_retailprice FROM part")


def _monitor(spark, d):
    found = monitor(derived(spark, d, "ref_orders"), derived(spark, d, "shifted_orders"), _by_agent(spark, d), _feedback(spark, d))
    return found.targets


def breaches_sql(key: str = "", limit: int = 1, closed: str = "true") -> str:
    k = f"{key}, " if key else ""
    return (f"SELECT date_trunc('minute', ts) AS minute, {k}count(*) AS requests, sum(floor(value))::BIGINT AS tokens FROM events GROUP BY ALL "
            f"HAVING count(*) > {limit} AND {closed}")


CALL_TOTALS = ("count(*) AS calls, sum(tokens)::BIGINT AS tokens, round(sum(cost), 4) AS cost, round(avg(latency_ms), 8) AS avg_latency_ms, round(max(latency_ms), 8) AS max_latency_ms")

CHECKS = {
    "latest": (lambda s, d: H.latest(events(s, d), KEY, ORDER).select(EVENT), ranked(NEWEST, "rn = 1")),
    "latest_turn": (lambda s, d: H.latest(table(s, d, "conversations"), ["conv_id"], ["turn"]).select("conv_id", "turn", "role"),
                    "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn = 1"),
    "best": (lambda s, d: H.best(events(s, d), KEY, "value", ORDER).select(EVENT), ranked("value DESC, ts, event_id", "rn = 1")),
    "rollback": (lambda s, d: H.rollback(events(s, d), KEY, ORDER, 2).select(EVENT), ranked(NEWEST, "rn = 3")),
    "retain": (lambda s, d: H.retain(events(s, d), KEY, ORDER).select(EVENT), ranked(NEWEST, "rn <= 10")),
    "top_k": (lambda s, d: H.top_k(events(s, d), "value", 7, tie=["event_id"]).select(EVENT), ranked("value DESC, event_id", "rn <= 7", "")),
    "top_k_by_group": (lambda s, d: H.top_k(events(s, d), "value", 3, ["event_type"], ["event_id"]).select(EVENT),
                       ranked("value DESC, event_id", "rn <= 3", "PARTITION BY event_type ")),
    "improvement": (
        lambda s, d: rounded(H.improvement(events(s, d).withColumn("round", F.dayofmonth("ts")), KEY, "round", "value")),
        "WITH r AS (SELECT user_id, day(ts)::INT AS round, max(value) AS v FROM events GROUP BY 1, 2), x AS (SELECT user_id, round, first_value(v) OVER w AS o, max(v) OVER w AS b FROM r "
        "WINDOW w AS (PARTITION BY user_id ORDER BY round)) SELECT user_id, round, round(o, 6) AS original_score, round(b, 6) AS best_score, round(b - o, 6) AS improvement, "
        "b <= o + 0.05::DOUBLE AND round > 2 AS stop FROM x"),
    "regressions": (
        lambda s, d: H.regressions(events(s, d), KEY, ORDER, "value").select("event_id", "user_id", "value", "previous_score"),
        "SELECT event_id, user_id, value, p AS previous_score FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE value < p"),
    "budget_status": (
        lambda s, d: rounded(R.budget_status(derived(s, d, "calls").withColumn("cost", F.col("cost") / 10), tie=["event_id"]), 4).select("event_id", "spent", "status"),
        with_("calls", body="SELECT event_id, round(v, 4) AS spent, CASE WHEN v >= 50 THEN 'blocked' WHEN v >= 10 THEN 'alert' ELSE 'ok' END AS status FROM "
              "(SELECT event_id, sum(cost / 10) OVER (PARTITION BY date_trunc('day', ts) ORDER BY ts, event_id) AS v FROM calls)")),
    "recent_jobs": (lambda s, d: R.recent_jobs(derived(s, d, "jobs"), "error", 20).select("id", "status"),
                    with_("jobs", body="SELECT id, status FROM jobs WHERE status = 'error' ORDER BY created_at DESC, id LIMIT 20")),
    "filter_artifacts": (
        lambda s, d: R.filter_artifacts(artifacts(s, d), agent="click", type="data", tags=["big", "error"]).select("id", "job_id"),
        f"SELECT id, job_id FROM ({ARTIFACTS_SQL}) WHERE agent = 'click' AND type = 'data' AND list_has_any(tags, ['big', 'error'])"),
    "artifact_sizes": (lambda s, d: R.artifact_sizes(artifacts(s, d)),
                       f"SELECT job_id, count(*) AS artifacts, sum(size_bytes)::BIGINT AS total_bytes FROM ({ARTIFACTS_SQL}) GROUP BY ROLLUP (job_id)"),
    "usage_rollup": (
        lambda s, d: rounded(rounded(R.usage_rollup(derived(s, d, "calls")), 4, "cost"), 8, "avg_latency_ms", "max_latency_ms"),
        with_("calls", body=f", c AS (SELECT *, CASE WHEN contains(model, '/') THEN split_part(model, '/', 1) ELSE 'unknown' END AS provider FROM calls) "
              f"SELECT agent, model, provider, {CALL_TOTALS} FROM c GROUP BY CUBE (agent, model, provider)")),
    "stage_metrics": (
        lambda s, d: rounded(R.stage_metrics(derived(s, d, "runs")), 4),
        with_("runs", body="SELECT agent_name, count(*) AS runs, round(avg((status = 'completed')::INT), 4) AS success_rate, round(1 - avg((status = 'completed')::INT), 4) AS failure_rate, "
              "round(avg(duration_seconds), 4) AS avg_seconds, round(max(duration_seconds), 4) AS max_seconds, sum(tokens_used)::BIGINT AS tokens, round(sum(cost), 4) AS cost FROM runs GROUP BY 1")),
    "optimization_summary": (
        lambda s, d: rounded(R.optimization_summary(events(s, d).select((F.col("value") / 1000).alias("improvement"), (F.col("value") / 100).alias("original_reward")))),
        "SELECT count(*) AS optimized, round(sum(value / 1000), 6) AS total_improvement, round(avg(value / 100), 6) AS average_reward FROM events"),
    "optimization_targets": (lambda s, d: R.optimization_targets(_by_agent(s, d), _feedback(s, d)), TARGETS_SQL),
    "limit_breaches": (
        lambda s, d: R.limit_breaches(events(s, d).withColumn("tokens", F.floor("value").cast("bigint")), "ts", ["event_type"], requests_per_minute=1)
        .withColumn("minute", F.col("minute").cast("timestamp_ntz")), breaches_sql("event_type")),
    "rate_limit_audit": (lambda s, d: rounded(RL.rate_limit_audit(events(s, d), "user_id", "ts", ["event_id"], RATE, BURST)).select(
        "event_id", "user_id", "allowed", "retry_after", "remaining"), BUCKET_SQL),
    "url_rules": (_urls, URL_SQL),
    "file_rules_quarantine": (
        _quarantine,
        f"WITH f AS ({FILES}) SELECT page_id, concat_ws(',', CASE WHEN NOT {PATH_OK} THEN 'path' END, CASE WHEN NOT {SIZE_OK} THEN 'size' END, CASE WHEN NOT {EXT_OK} THEN 'extension' END) AS failed FROM f"),
    "content_type_rule": (
        lambda s, d: files(s, d).select("page_id", V.content_type_ok(F.col("content_type")).alias("ok")),
        f"SELECT page_id, lower(trim(split_part(content_type, ';', 1))) IN ('text/csv', 'text/plain', 'application/json', 'application/octet-stream') AS ok FROM ({FILES})"),
    "select_only_rule": (
        lambda s, d: table(s, d, "documents").select("doc_id", V.select_only(F.expr(QUERY)).alias("ok")),
        f"SELECT doc_id, starts_with(ltrim(q), 'SELECT') AND " + " AND ".join(f"NOT contains(q, '{w}')" for w in BANNED) + f" AS ok FROM (SELECT doc_id, upper({QUERY}) AS q FROM documents)"),
    "name_and_uuid_rules": (_names, NAMES_SQL),
    "weighted_score": (_scores, SCORES_SQL),
    "text_change": (lambda s, d: table(s, d, "documents").select("doc_id", TX.text_change(F.col("text"), F.expr(NEW_TEXT)).alias("gain")), CHANGE_SQL),
    "tag_keywords": (
        lambda s, d: table(s, d, "documents").select("doc_id", F.concat_ws(",", TX.tag_keywords(F.expr(FEEDBACK))).alias("tags")),
        f"SELECT doc_id, concat_ws(',', " + ", ".join(f"CASE WHEN contains(t, '{w}') THEN '{label}' END" for w, label in TAGS.items())
        + f") AS tags FROM (SELECT doc_id, lower({FEEDBACK}) AS t FROM documents)"),
    "extract_json": (
        lambda s, d: events(s, d).select("event_id", TX.extract_json(F.expr(
            "CASE event_id % 4 WHEN 0 THEN concat('```json\\n', props, '\\n```') WHEN 1 THEN concat('see ', props, ' ok') WHEN 2 THEN 'none' ELSE '{bad}' END"),
            "k INT", F.struct(F.lit(-1).alias("k")))["k"].alias("k")),
        "SELECT event_id, CASE WHEN event_id % 4 < 2 THEN json_extract(props, '$.k')::INT ELSE -1 END AS k FROM events"),
    "row_fingerprint": (
        lambda s, d: table(s, d, "orders").select("o_orderkey", TX.row_fingerprint(table(s, d, "orders"), ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]).alias("fingerprint")),
        "SELECT o_orderkey, md5(to_json({'o_custkey': o_custkey, 'o_orderkey': o_orderkey, 'o_orderpriority': o_orderpriority, 'o_orderstatus': o_orderstatus})::VARCHAR) AS fingerprint FROM orders"),
    "duration_and_progress": (
        lambda s, d: derived(s, d, "jobs").select(
            "id", SC.duration_seconds(F.col("created_at").cast("timestamp"), F.expr("CASE WHEN current_step > 5 THEN created_at + INTERVAL 90 SECONDS END").cast("timestamp"),
                                      F.lit("2024-03-01 00:00:00").cast("timestamp")).alias("seconds"),
            F.round(SC.progress_percent(F.col("current_step"), F.col("total_steps")), 4).alias("percent")),
        with_("jobs", body="SELECT id, date_diff('microsecond', created_at, CASE WHEN current_step > 5 THEN created_at + INTERVAL 90 SECOND ELSE TIMESTAMP '2024-03-01' END) / 1000000.0::DOUBLE AS seconds, "
              "round(CASE WHEN total_steps > 0 THEN current_step * 100.0::DOUBLE / total_steps ELSE 0 END, 4) AS percent FROM jobs")),
    "score_with_user_function": (
        lambda s, d: rounded(TX.score_with(events(s, d), lambda value, user: value * 2 + user, ["value", "user_id"]).select("event_id", "score")),
        "SELECT event_id, round(value * 2 + user_id, 6) AS score FROM events"),
    "unpack_json_payload": (_payloads, PAYLOADS_SQL),
    "stream_drift": (_stream_drift, window_sql()),
    "stream_dedup": (lambda s, d: _run(J.stream_dedup(stream_of(s, d, "events"), ["user_id", "event_type"], "ts").select("user_id", "event_type", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")), s),
                     "SELECT DISTINCT user_id, event_type, time_bucket(INTERVAL 1 HOUR, ts) AS hour FROM events"),
    "stream_limit_breaches": (
        _stream_breaches,
        "WITH w AS (SELECT max(ts) - INTERVAL 1 MINUTE AS mark FROM events) SELECT * FROM (" + breaches_sql() + ") WHERE minute + INTERVAL 1 MINUTE <= (SELECT mark FROM w)"),
    "stream_rate_limit": (
        lambda s, d: rounded(_run(J.stream_rate_limit(stream_of(s, d, "events"), "user_id", "ts", "event_id", RATE, BURST), s)).drop("ts_micros"), BUCKET_SQL),
    "stream_score": (
        _stream_score,
        "WITH f AS (SELECT regr_slope(p_retailprice, p_partkey) AS m, regr_intercept(p_retailprice, p_partkey) AS b FROM part) "
        "SELECT p_partkey, round(b + m * p_partkey, 1) AS prediction FROM part, f"),
    "build_flow": (_build, BUILD_SQL.format(types=", ".join(f"(p_type = '{t}')::INT::DOUBLE AS categorical__p_type_{t}" for t in TYPES))),
    "build_flow_model": (
        _build_model,
        f"WITH h AS (SELECT *, {md5_number('p_partkey')} % 100 AS slot FROM part), f AS (SELECT regr_slope(p_retailprice, p_partkey) AS m, regr_intercept(p_retailprice, p_partkey) AS b FROM h WHERE slot < 80), "
        "e AS (SELECT p_retailprice AS y, p_retailprice - b - m * p_partkey AS e FROM h, f WHERE slot >= 80), x AS (SELECT avg(e * e) AS mse, avg(abs(e)) AS mae, var_pop(y) AS v FROM e) "
        "SELECT unnest(['mse', 'rmse', 'mae', 'r2']) AS metric, round(unnest([mse, sqrt(mse), mae, 1 - mse / v]), 3) AS value, (SELECT count(*) FROM part) AS rows FROM x"),
    "monitor_targets": (_monitor, TARGETS_SQL + " UNION SELECT 'features'"),
}
