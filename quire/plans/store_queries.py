"""Queries over the store and the event log: checkpoints, resume, history, replay, states, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import gating, reports, store
from quire.plans.registry import query
from quire.streaming import events as E

_STATUS = "CASE event_type WHEN 'purchase' THEN 'verified' WHEN 'signup' THEN 'needs_review' ELSE 'pending' END"


def _log(read):
    """Events as checkpoints: a user is a job, event_id the version."""
    status = F.when(F.col("event_type") == "purchase", "verified").when(F.col("event_type") == "signup", "needs_review").otherwise("pending")
    return read("events").select(F.col("user_id").alias("job_id"), (F.col("event_id") % 20 + 1).cast("int").alias("page_number"), F.col("event_id").alias("version"), status.alias("status"))


_LOG = f"SELECT user_id AS job_id, (event_id % 20 + 1)::INT AS page_number, event_id AS version, {_STATUS} AS status FROM events"
_LATEST = f"WITH log AS ({_LOG}), latest AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY job_id, page_number ORDER BY version DESC) = 1)"
KEYS = ["job_id", "page_number"]


@query(f"{_LATEST} SELECT * FROM latest")
def latest_checkpoint(read):
    return store.latest(_log(read), KEYS)


@query(f"{_LATEST}, new AS (SELECT DISTINCT job_id, page_number, 'verified' AS status, 1000000 AS version FROM log WHERE version % 7 = 0) SELECT job_id, page_number, status, version::BIGINT AS version FROM new WHERE NOT EXISTS (SELECT 1 FROM latest l WHERE l.job_id = new.job_id AND l.page_number = new.page_number AND l.status IN ('verified', 'needs_review'))")
def checkpoint_guard(read):
    log = _log(read)
    new = log.where("version % 7 = 0").select(*KEYS).distinct().select(*KEYS, F.lit("verified").alias("status"), F.lit(1_000_000).cast("long").alias("version"))
    return store.admitted(log, new, KEYS)


@query(f"{_LATEST} SELECT job_id, page_number, CASE WHEN page_number % 3 = 0 THEN version + 1 ELSE version END AS version, CASE WHEN page_number % 3 = 0 THEN 'pending' ELSE status END AS status FROM latest")
def invalidate_reopen(read):
    log = _log(read)
    return store.latest(log.unionByName(store.invalidation(log, log.where("page_number % 3 = 0"), KEYS)), KEYS)


_PAGES = "SELECT user_id AS job_id, (event_id % 20 + 1)::INT AS page_number FROM events WHERE event_type IN ('purchase', 'signup')"


@query(f"WITH final AS ({_PAGES}), jobs AS (SELECT DISTINCT user_id AS job_id FROM events), open AS (SELECT job_id, n::INT AS page_number FROM jobs, range(1, 21) r(n) WHERE NOT EXISTS (SELECT 1 FROM final f WHERE f.job_id = jobs.job_id AND f.page_number = n)) SELECT jobs.job_id, min(page_number)::INT AS page_number FROM jobs LEFT JOIN open USING (job_id) GROUP BY jobs.job_id")
def resume_point(read):
    log = _log(read)
    jobs = log.select("job_id").distinct().withColumn("page_count", F.lit(20))
    return store.resume_points(jobs, log)


@query("SELECT c.conv_id, c.turn FROM conversations c WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = c.conv_id)")
def terminal_semi(read):
    return read("conversations").join(read("labels").select(F.col("doc_id").alias("conv_id")), "conv_id", "left_semi").select("conv_id", "turn")


@query("SELECT c.conv_id, c.turn FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = c.conv_id)")
def terminal_anti(read):
    return read("conversations").join(read("labels").select(F.col("doc_id").alias("conv_id")), "conv_id", "left_anti").select("conv_id", "turn")


def _jobs(read):
    statuses = F.element_at(F.array(*map(F.lit, store.JOB_STATUSES)), (F.col("o_orderkey") % 11 + 1).cast("int"))
    return read("orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderdate").alias("created_at"), statuses.alias("status"))


_JOBS = "SELECT o_orderkey AS job_id, o_orderdate AS created_at, [" + ", ".join(f"'{s}'" for s in store.JOB_STATUSES) + "][o_orderkey % 11 + 1] AS status FROM orders"


@query(f"SELECT job_id, status FROM ({_JOBS}) ORDER BY created_at DESC, job_id DESC LIMIT 50")
def job_history_topk(read):
    return store.history(_jobs(read)).select("job_id", "status")


@query(f"SELECT job_id, status FROM (SELECT * FROM ({_JOBS}) ORDER BY created_at DESC, job_id DESC LIMIT 50) WHERE status NOT IN ('completed', 'failed', 'cancelled')")
def incomplete_jobs(read):
    return store.incomplete(_jobs(read)).select("job_id", "status")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def clear_job_rows(read):
    rows = read("lineitem").select(F.col("l_orderkey").alias("job_id"), "l_linenumber")
    gone = read("orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("job_id"))
    return store.without_job(rows, gone).select(F.col("job_id").alias("l_orderkey"), "l_linenumber")


@query("SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 5")
def event_replay_last_n(read):
    return E.replay(read("events").select("event_id", "user_id"), ["user_id"], 5, "event_id")


@query("SELECT user_id, event_id, event_type FROM events")
def event_dedup(read):
    own = read("events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), "event_type")
    again = own.union(own.where("seq % 3 = 0")).union(own.where("seq % 5 = 0"))
    return E.deduplicated(again).select(F.col("job_id").alias("user_id"), F.col("seq").alias("event_id"), "event_type")


@query("WITH g AS (SELECT user_id, ts AS from_ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS to_ts FROM events) SELECT * FROM g WHERE to_ts - from_ts > INTERVAL 6 HOUR")
def idle_gaps(read):
    return E.idle_gaps(read("events"), ["user_id"], 6 * 3600, order="event_id")


_STEPS = "SELECT user_id AS job_id, event_id AS seq, ['preflight', 'rendering', 'ocr', 'paused', 'completed', 'cancelled'][event_id % 6 + 1] AS status FROM events"
_ALLOWED = ", ".join(f"('{a}', '{b}')" for a, bs in store.TRANSITIONS.items() for b in bs)


@query(f"""WITH s AS (SELECT *, lag(status) OVER (PARTITION BY job_id ORDER BY seq) AS before FROM ({_STEPS})), allowed(a, b) AS (VALUES {_ALLOWED})
SELECT job_id, seq, before, status FROM s WHERE before IS NOT NULL AND before <> status AND NOT (status = 'cancelled' AND before NOT IN ('completed', 'failed', 'cancelled')) AND NOT EXISTS (SELECT 1 FROM allowed WHERE a = before AND b = status)""")
def state_machine_audit(read):
    names = F.array(*map(F.lit, ("preflight", "rendering", "ocr", "paused", "completed", "cancelled")))
    log = read("events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), F.element_at(names, (F.col("event_id") % 6 + 1).cast("int")).alias("status"))
    return store.illegal_transitions(log)


def _judged(read):
    status = F.when(F.col("quality") == 1, "verified").when(F.col("toxic") == 1, "needs_review").otherwise("pending")
    return read("documents").join(read("labels"), "doc_id", "left").withColumn("status", status)


_JUDGED = "SELECT d.*, quality, toxic, CASE WHEN quality = 1 THEN 'verified' WHEN toxic = 1 THEN 'needs_review' ELSE 'pending' END AS status FROM documents d LEFT JOIN labels USING (doc_id)"


@query(f"SELECT source, count(*) FILTER (status IN ('verified', 'needs_review')) AS done, count(*) AS total, round(count(*) FILTER (status IN ('verified', 'needs_review')) * 100.0 / count(*))::BIGINT AS pct FROM ({_JUDGED}) GROUP BY source")
def progress_pct(read):
    return reports.progress(_judged(read), ["source"])


@query(f"SELECT source, list_aggregate(list_sort(list(doc_id) FILTER (status = 'needs_review')), 'string_agg', ', ') AS pages FROM ({_JUDGED}) GROUP BY source HAVING count(*) FILTER (status = 'needs_review') > 0")
def needs_review_list(read):
    own = _judged(read).select("source", F.col("doc_id").alias("page_number"), F.coalesce(F.col("status") == "needs_review", F.lit(False)).alias("needs_review"))
    return reports.needs_review(own, ["source"]).where(F.size("pages") > 0).select("source", F.array_join("pages", ", ").alias("pages"))


@query("SELECT l_orderkey, sum(l_quantity::BIGINT)::BIGINT AS prompt, sum(CASE WHEN l_linenumber > 1 THEN l_suppkey ELSE 0 END)::BIGINT AS completion FROM lineitem GROUP BY l_orderkey")
def token_usage_totals(read):
    usage = F.struct(F.col("l_quantity").cast("long").alias("prompt"), F.when(F.col("l_linenumber") > 1, F.col("l_suppkey")).alias("completion"))
    return reports.token_totals(read("lineitem").select("l_orderkey", usage.alias("token_usage")), ["l_orderkey"])


_REPRESENTED = "SELECT source, lang, CASE WHEN lang = 'en' THEN 'mermaid' WHEN lang = 'fr' THEN 'table' WHEN lang = 'de' THEN 'image' END AS s FROM documents"


@query(f"""SELECT source, count(*) AS figures, count(*) FILTER (s = 'mermaid') AS mermaid, count(*) FILTER (s = 'table') AS tables, count(*) FILTER (coalesce(s, 'image') NOT IN ('mermaid', 'table')) AS images,
round_even(count(*) FILTER (s = 'mermaid')::DOUBLE / count(*) * 100.0, 0)::BIGINT AS rate FROM ({_REPRESENTED}) GROUP BY source""")
def conversion_rate(read):
    status = F.when(F.col("lang") == "en", "mermaid").when(F.col("lang") == "fr", "table").when(F.col("lang") == "de", "image")
    return reports.conversion_summary(read("documents").select("source", status.alias("conversion_status")), ["source"])


@query("SELECT user_id, CASE WHEN bool_and(event_type <> 'error' OR value < 90) THEN 'ok' ELSE 'degraded' END AS status FROM events GROUP BY user_id")
def health_rollup(read):
    return reports.health(read("events").select("user_id", ((F.col("event_type") != "error") | (F.col("value") < 90)).alias("ok")), ["user_id"])


@query("SELECT user_id, printf('%.1fs', round_even((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 1)) AS wall FROM events GROUP BY user_id")
def wall_clock(read):
    span = read("events").groupBy("user_id").agg(F.min("ts").cast("timestamp").alias("a"), F.max("ts").cast("timestamp").alias("b"))
    return span.select("user_id", reports.wall_clock(F.col("a"), F.col("b")).alias("wall"))


def _attempts(read):
    line = read("lineitem").groupBy("l_orderkey", "l_linenumber").agg(*[F.min(c).alias(c) for c in ("l_partkey", "l_suppkey", "l_quantity", "l_discount")])
    malformed = F.when(F.col("l_discount") > 0.08, "line 1: bad")
    return line.select(
        F.col("l_orderkey").alias("job_id"),
        F.lit(1).alias("page_number"),
        F.col("l_linenumber").alias("attempt"),
        (F.col("l_linenumber") * 100).alias("dpi"),
        F.lit("native").alias("reference_kind"),
        F.concat(F.lit("page "), "l_partkey").alias("markdown"),
        (F.col("l_quantity").cast("int") * 2).alias("coverage"),
        F.lit("pass").alias("verdict"),
        F.array().cast("array<string>").alias("misses"),
        F.lit(None).cast("double").alias("floor_score"),
        F.col("l_suppkey").alias("prompt_tokens"),
        F.lit(1).cast("long").alias("completion_tokens"),
        F.lit(0.0).alias("ms"),
        malformed.alias("envelope_error"),
    )


@query("""WITH a AS (SELECT l_orderkey AS job_id, l_linenumber AS attempt, l_partkey, l_suppkey, l_quantity::INT * 2 AS coverage, l_discount > 0.08 AS bad, l_discount <= 0.08 AND l_quantity::INT * 2 >= 95 AS ok FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey, min(l_quantity) AS l_quantity, min(l_discount) AS l_discount FROM lineitem GROUP BY ALL)),
f AS (SELECT *, min(attempt) FILTER (ok) OVER (PARTITION BY job_id) AS first FROM a), k AS (SELECT * FROM f WHERE first IS NULL OR attempt <= first),
g AS (SELECT job_id, max(attempt) AS retries, sum(l_suppkey)::BIGINT AS prompt, count(*)::BIGINT AS completion, bool_or(ok) AS ok FROM k GROUP BY job_id)
SELECT g.job_id, CASE WHEN g.ok THEN 'verified' ELSE 'needs_review' END AS status, CASE WHEN k.bad THEN '' ELSE 'page ' || l_partkey END AS markdown, CASE WHEN k.bad THEN 0 ELSE coverage END AS coverage_score, retries, prompt, completion,
CASE WHEN NOT g.ok THEN 'verification cap reached' END AS notes FROM g JOIN k ON k.job_id = g.job_id AND k.attempt = g.retries""")
def attempt_reduction(read):
    out = gating.reduced(_attempts(read))
    return out.select("job_id", "status", "markdown", "coverage_score", "retries", F.col("token_usage.prompt").alias("prompt"), F.col("token_usage.completion").alias("completion"), "notes")


@query("""WITH f AS (SELECT event_id, (event_id % 4 + 1)::INT AS attempt, CASE WHEN event_type = 'error' THEN 429 WHEN event_type = 'view' THEN 503 WHEN event_type = 'click' THEN 404 END AS status, CASE WHEN event_type = 'purchase' THEN 'timeout' WHEN event_type = 'signup' THEN 'other' ELSE 'status' END AS kind, CASE WHEN event_id % 2 = 0 THEN value::VARCHAR END AS ra, value FROM events)
SELECT event_id, CASE WHEN kind = 'status' THEN CASE WHEN status = 429 THEN coalesce(least(ra::DOUBLE, 120.0), pow(2.0, attempt - 1)) WHEN status >= 500 THEN pow(2.0, attempt - 1) END WHEN kind = 'timeout' THEN pow(2.0, attempt - 1) END AS delay FROM f""")
def retry_delays(read):
    kind = F.col("event_type")
    status = F.when(kind == "error", 429).when(kind == "view", 503).when(kind == "click", 404)
    label = F.when(kind == "purchase", "timeout").when(kind == "signup", "other").otherwise("status")
    after = F.when(F.col("event_id") % 2 == 0, F.col("value").cast("string"))
    return read("events").select("event_id", gating.retry_delay(status, label, after, (F.col("event_id") % 4 + 1).cast("int")).alias("delay"))


def _report_tables(read):
    spark = read("labels").sparkSession
    docs = _judged(read).where("quality is not null")
    jobs = docs.groupBy(F.col("source").alias("job_id")).agg(F.count("*").alias("page_count"), F.first(F.concat("source", F.lit(".pdf"))).alias("filename"))
    jobs = jobs.select("*", F.lit("completed").alias("status"), F.lit("v1").alias("pipeline_version"), F.lit(None).cast("timestamp").alias("started_at"), F.lit(None).cast("timestamp").alias("finished_at"))
    usage = F.struct(F.col("n_chars").alias("prompt"), F.lit(None).cast("long").alias("completion"))
    pages = docs.select(F.col("source").alias("job_id"), F.col("doc_id").alias("page_number"), "status", F.lit(90).alias("coverage_score"), F.lit(0).alias("retries"), F.lit(200).alias("render_dpi"), (F.col("status") == "needs_review").alias("needs_review"), usage.alias("token_usage"), F.when(F.col("toxic") == 1, "toxic").alias("notes"), F.lit(None).cast("double").alias("floor_score"))
    images = spark.createDataFrame([], "job_id string, page_number long, image_id long, diagram_type string, conversion_status string, confidence int")
    furniture = spark.createDataFrame([], "job_id string, text string, pages long")
    orphans = spark.createDataFrame([], "job_id string, page long, index long, alt string, reason string")
    warnings = spark.createDataFrame([], "job_id string, warning string")
    return jobs, pages, images, furniture, orphans, warnings


@query(f"SELECT source AS job_id, '| ' || doc_id || ' | ' || status || ' | 90 | 0 | 200 | ' || n_chars || ' | 0 | ' || CASE WHEN status = 'needs_review' THEN 'True' ELSE 'False' END || ' |' AS line FROM ({_JUDGED}) WHERE quality IS NOT NULL")
def ordered_report_rows(read):
    return reports.report_lines(*_report_tables(read)).where("part = 2").select("job_id", "line")


_N = "chr(10)"
_RULE = "'| --- | --- | --- | --- | --- | --- | --- | --- |'"


@query(f"""WITH j AS (SELECT * FROM ({_JUDGED}) WHERE quality IS NOT NULL),
r AS (SELECT source AS job_id, count(*) AS n, sum(n_chars)::BIGINT AS chars,
string_agg('| ' || doc_id || ' | ' || status || ' | 90 | 0 | 200 | ' || n_chars || ' | 0 | ' || CASE WHEN status = 'needs_review' THEN 'True' ELSE 'False' END || ' |', {_N} ORDER BY doc_id) AS pages,
string_agg(CASE WHEN status = 'needs_review' THEN doc_id::VARCHAR END, ', ' ORDER BY doc_id) AS review,
string_agg(CASE WHEN toxic = 1 THEN '- page ' || doc_id || ': toxic' END, {_N} ORDER BY doc_id) AS notes,
string_agg('- page ' || doc_id || ': dpi=200 image=NonexNone NoneB model=None effort=None transcribe_ms=None verify_ms=None ocr_ms=None retries=0 verification_score=90 floor=n/a hashes=None/None/None/None', {_N} ORDER BY doc_id) AS telemetry
FROM j GROUP BY source)
SELECT job_id, array_to_string(['# Conversion report — ' || job_id || '.pdf', '', '- job_id: ' || job_id, '- status: completed', '- pages: ' || n, '- wall-clock: not started', '- tokens: prompt=' || chars || ' completion=0', '- pipeline_version: v1',
'- prompts: None', '- models: agent=None ocr=None', '- dpi: None', '- lint warnings: 0', '', '## Per-page coverage', '', '| page | status | coverage | retries | dpi | prompt_tok | completion_tok | needs_review |', {_RULE}, pages,
'', '## needs_review pages', '', coalesce('[' || review || ']', 'none'), '', '## Diagram → Mermaid conversion', '', 'none', '', '## Omissions log', '', coalesce(notes, 'none'), '', '## Running furniture stripped', '', 'none',
'', '## Per-page telemetry (FR-AGT-10)', '', telemetry, '', '## Figures placed without placeholder (appended at page end)', '', 'none', '', '## Lint warnings (non-fatal)', '', 'none'], {_N}) || {_N} AS report FROM r""")
def conversion_report(read):
    return reports.rendered(reports.report_lines(*_report_tables(read)))
