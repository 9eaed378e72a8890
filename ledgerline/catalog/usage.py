"""Usage events, subscriptions and the allowance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline import rules
from ledgerline.catalog.common import as_of, events, long, micros, query
from ledgerline.operators import subscriptions as subs
from ledgerline.operators import telemetry as tel
from ledgerline.session import work_dir
from ledgerline.sources import fixtures
from ledgerline.sources.sinks import append_events
from ledgerline.sources.tables import table


def _case(values, index):
    return f"CASE {index} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


_CANON = {i: (rules.ERROR_CODES.get(c) or {"": None, "TIMEOUT_EXCEEDED": "TIMEOUT_EXCEEDED"}.get(c, "UNKNOWN")) for i, c in enumerate(fixtures.RAW_CODES)}
_CODES = "CASE k % 20 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in _CANON.items() if c) + " END"
EV = f"""
WITH raw AS (SELECT event_id, ts, user_id AS u, event_type AS t, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events),
ev AS (SELECT event_id, ts AS created_at, u, k,
  CASE WHEN t = 'view' THEN 'visitor_landed' WHEN t = 'click' AND k < 50 THEN 'file_loaded' WHEN t = 'click' THEN 'preflight_pass' WHEN t = 'purchase' THEN 'conversion_success' WHEN t = 'error' THEN 'conversion_failed' ELSE 'user_logged_in' END AS event,
  printf('%08x-0000-4000-8000-%012x', u, CAST(CAST(ts AS DATE) - DATE '1970-01-01' AS BIGINT)) AS session_id,
  CASE k % 4 WHEN 0 THEN 'dashboard' WHEN 1 THEN 'bank' ELSE 'other' END AS surface,
  CASE WHEN k % 3 = 0 THEN {_case([x[0] for x in rules.BANK_LAYOUTS], 'u % 20')} END AS bank_slug,
  CASE k % 4 WHEN 0 THEN 'ofx' WHEN 1 THEN 'qbo' WHEN 2 THEN 'qfx' END AS dialect,
  {_case(rules.ROW_BANDS, 'k % 5')} AS row_bucket,
  CASE u % 4 WHEN 0 THEN 'google.com' WHEN 1 THEN 'direct' WHEN 2 THEN 'internal' END AS referrer_host,
  CASE WHEN k % 2 = 0 THEN CASE u % 6 WHEN 0 THEN 'US' WHEN 1 THEN 'GB' WHEN 2 THEN 'DE' WHEN 5 THEN 'FR' END WHEN k % 3 = 0 THEN 'IE' END AS country,
  CASE WHEN u % 10 <> 0 THEN '10.0.' || (u // 256) || '.' || (u % 256) WHEN u % 20 = 0 THEN '2001:db8::1' END AS ip,
  CASE WHEN k % 11 <> 10 THEN {_case(['Edge', 'Safari', 'Firefox', 'Chrome', 'Chrome', 'Other', 'Bot'], 'k % 7')} END AS browser,
  CASE WHEN k % 11 <> 10 THEN {_case(['Windows', 'macOS', 'Linux', 'Android', 'iOS', 'Other', 'Other'], 'k % 7')} END AS os,
  CASE WHEN t = 'error' THEN {_CODES} END AS error_code
  FROM raw WHERE k NOT IN (98, 99)),
now AS (SELECT max(created_at) AS t FROM ev)
"""


@query("m01_clean_events", EV + "SELECT event_id, event, session_id, surface, bank_slug, dialect, row_bucket, referrer_host FROM ev")
def clean(spark, sf):
    return fixtures.usage_events(spark, sf).select("event_id", "event", "session_id", "surface", "bank_slug", "dialect", "row_bucket", "referrer_host")


@query("m01_quarantine", EV + "SELECT event_id, CASE WHEN k = 99 THEN 'event' ELSE 'session' END AS reason FROM raw WHERE k IN (98, 99)")
def quarantine(spark, sf):
    return tel.rejected_events(fixtures.raw_usage_events(table(spark, sf, "events"))).select("event_id", "reason")


@query("s10_event_sink", EV + """, r AS (SELECT * FROM ev, now WHERE created_at >= now.t - INTERVAL 24 HOUR)
SELECT event_id, event, CAST(CAST(created_at AS DATE) AS VARCHAR) AS event_date FROM r""")
def event_sink(spark, sf):
    # Two batches appended to a table by date; the range of a day reads one or two of its folders.
    path, made = work_dir(spark, "events"), fixtures.usage_events(spark, sf)
    for part in (0, 1):
        append_events(made.filter(F.col("event_id") % 2 == part), path)
    written = spark.read.parquet(path)
    return tel.range_scan(written, as_of(written), 24).select("event_id", "event", F.col("event_date").cast("string").alias("event_date"))


@query("m02_error_codes", EV + "SELECT event_id, error_code FROM ev")
def errors(spark, sf):
    return events(spark, sf).select("event_id", "error_code")


@query("m03_clients", EV + "SELECT event_id, browser, os FROM ev")
def clients(spark, sf):
    return events(spark, sf).select("event_id", "browser", "os")


@query("m04_country", EV + "SELECT event_id, country FROM ev")
def country(spark, sf):
    return events(spark, sf).select("event_id", "country")


@query("m05_client_ip", EV + "SELECT event_id, ip FROM ev")
def ip(spark, sf):
    return events(spark, sf).select("event_id", "ip")


_HOST = "regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)), '^www\\.', '')"
_ALLOW = " ".join(f"WHEN host = '{d}' OR host LIKE '%.{d}' THEN '{d}'" for d in rules.REFERRER_HOSTS)


@query("m06_referrers", f"""
SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'direct' WHEN host = own THEN 'internal' {_ALLOW} ELSE 'direct' END AS referrer FROM (
  SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'mail.google.com' WHEN page_id % 3 = 1 THEN 'reddit.com' ELSE {_HOST} END AS host, 'spam-farm.example.org' AS own FROM pages) t""")
def referrers(spark, sf):
    path = F.regexp_extract("url", r"^[a-z]+://[^/]+(.*)$", 1)
    url = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("https://mail.google.com"), path)).when(F.col("page_id") % 3 == 1, F.concat(F.lit("https://www.reddit.com"), path)).otherwise(F.col("url"))
    url = F.when(F.col("page_id") % 5 != 0, url)
    return table(spark, sf, "pages").select("page_id", tel.referrer_host(url, "spam-farm.example.org").alias("referrer"))


_RANGE = EV + ", r AS (SELECT ev.* FROM ev, now WHERE created_at >= now.t - INTERVAL 168 HOUR)"


def _range(spark, sf):
    e = events(spark, sf)
    return tel.range_scan(e, as_of(e))


@query("s09_range_scan", EV + """, r AS (SELECT ev.* FROM ev, now WHERE created_at >= now.t - INTERVAL 720 HOUR)
SELECT event, session_id, bank_slug, dialect, country, ip, browser, os, error_code, epoch_us(created_at) AS created_us FROM r""")
def scan(spark, sf):
    e = events(spark, sf)
    return tel.range_scan(e.select(*tel.SCAN), as_of(e), 720).select(*tel.SCAN[:-1], micros("created_at").alias("created_us"))


@query("m07_unique_visitors", _RANGE + "SELECT count(DISTINCT coalesce(ip, 'session:' || session_id)) AS unique_visitors FROM r WHERE event = 'visitor_landed'")
def visitors(spark, sf):
    return tel.unique_visitors(_range(spark, sf))


@query("m08_counters", _RANGE + "SELECT count(*) FILTER (event = 'conversion_success') AS successes, count(*) FILTER (event = 'conversion_failed') AS failures, count(*) FILTER (event = 'user_logged_in') AS logins FROM r")
def counters(spark, sf):
    return tel.counters(_range(spark, sf))


_STAGES = " UNION ALL ".join(f"SELECT CAST({i} AS BIGINT) AS stage, '{label}' AS label, count(DISTINCT session_id) AS sessions FROM r WHERE event = '{event}'" for i, (label, event) in enumerate(rules.FUNNEL))


@query("m09_funnel", _RANGE + _STAGES)
def funnel(spark, sf):
    return tel.funnel(_range(spark, sf)).select(long("stage"), "label", "sessions")


@query("m10_funnel_dropoff", _RANGE + f""", s AS ({_STAGES}), l AS (SELECT *, lag(sessions) OVER (ORDER BY stage) AS prev, first_value(sessions) OVER (ORDER BY stage) AS top FROM s)
SELECT stage, coalesce(prev - sessions, 0) AS lost, CAST(floor(CASE WHEN prev > 0 THEN (prev - sessions) / prev * 100 ELSE 0 END + 0.5) AS BIGINT) AS drop_pct,
       coalesce(prev > 0 AND (prev - sessions) / prev * 100 >= 50, false) AS severe, CAST(floor(sessions / greatest(top, 1) * 100 + 0.5) AS BIGINT) AS of_first_pct FROM l""")
def dropoff(spark, sf):
    return tel.funnel_dropoff(tel.funnel(_range(spark, sf))).select(long("stage"), "lost", long("drop_pct"), "severe", long("of_first_pct"))


@query("m11_failure_ranking", _RANGE + "SELECT coalesce(error_code, 'UNKNOWN') AS error_code, count(*) AS failures FROM r WHERE event = 'conversion_failed' GROUP BY 1")
def ranking(spark, sf):
    return tel.failure_ranking(_range(spark, sf))


@query("m11_top_failure", _RANGE + "SELECT coalesce(error_code, 'UNKNOWN') AS error_code, count(*) AS failures FROM r WHERE event = 'conversion_failed' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1")
def top(spark, sf):
    return tel.top_failure(_range(spark, sf))


_HOURS = EV + """, spine AS (SELECT date_trunc('hour', t) - to_hours(CAST(i AS INTEGER)) AS h FROM now, range(24) x(i)),
b AS (SELECT strftime(h, '%Y-%m-%d %H:00') AS hour, count(*) FILTER (event = 'visitor_landed') AS landed, count(*) FILTER (event = 'conversion_success') AS converted
      FROM spine LEFT JOIN ev ON date_trunc('hour', created_at) = h GROUP BY h)"""


@query("m12_hourly_buckets", _HOURS + " SELECT * FROM b")
def hourly(spark, sf):
    e = events(spark, sf)
    return tel.hourly_buckets(e, as_of(e))


@query("m13_peak_share", _HOURS + " SELECT hour, landed, converted, round(landed / greatest(1, max(landed) OVER ()), 6) AS share FROM b")
def peak(spark, sf):
    e = events(spark, sf)
    return tel.peak_share(tel.hourly_buckets(e, as_of(e)))


@query("m14_recent_feed", EV + """
SELECT event_id, event, coalesce(country, '—') AS country, CASE WHEN browser IS NULL THEN '—' ELSE browser || ' · ' || os END AS client,
       CASE WHEN error_code IS NOT NULL THEN error_code WHEN event = 'conversion_success' THEN coalesce(dialect, 'ok') ELSE coalesce(replace(bank_slug, '-to-quickbooks', ''), 'ok') END AS status
FROM ev ORDER BY created_at DESC, event_id DESC LIMIT 40""")
def feed(spark, sf):
    return tel.recent_feed(events(spark, sf)).select("event_id", "event", "country", "client", "status")


@query("m15_purge", EV + "SELECT event_id, event FROM ev WHERE created_at >= (SELECT t FROM now) + INTERVAL 75 DAY - INTERVAL 90 DAY")
def purged(spark, sf):
    """The table itself after the purge, run twice."""
    from datetime import timedelta

    from ledgerline.session import work_dir
    from ledgerline.sources import sinks

    e, path = events(spark, sf), work_dir(spark, "purged")
    sinks.append_events(e, path)
    for _ in range(2):
        sinks.purge_events(spark, path, as_of(e) + timedelta(days=75))
    return spark.read.parquet(path).select("event_id", "event")


@query("m16_domain_audit", """
WITH raw AS (SELECT user_id AS u, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events)
SELECT 'event' AS rule, count(*) FILTER (k = 99) AS violations FROM raw UNION ALL SELECT 'surface', count(*) FILTER (k % 4 = 3) FROM raw UNION ALL
SELECT 'dialect', count(*) FILTER (k % 4 = 3) FROM raw UNION ALL SELECT 'row_bucket', count(*) FILTER (k % 5 = 4) FROM raw UNION ALL
SELECT 'country', count(*) FILTER (k % 2 = 0 AND u % 6 <> 1 AND u % 6 <> 5) FROM raw UNION ALL SELECT 'session_id', count(*) FILTER (k = 98) FROM raw""")
def audit(spark, sf):
    raw = fixtures.raw_usage_events(table(spark, sf, "events"))
    return tel.domain_audit(raw.withColumn("country", F.try_element_at("headers", F.lit("x-vercel-ip-country"))))


# --- subscriptions -----------------------------------------------------------------

CH = """
WITH raw AS (SELECT event_id AS seq, ts, user_id AS u, event_type AS t, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events),
ch AS (SELECT seq, ts, u, k, t, printf('user-%05d', u) AS uid, (k % 7 <> 0) AS named,
  CASE WHEN t IN ('click', 'purchase') THEN 'active' WHEN t = 'view' THEN 'trialing' WHEN t = 'error' THEN 'canceled' ELSE 'incomplete' END AS status
  FROM raw WHERE NOT (t = 'view' AND k % 10 = 0) AND NOT (t = 'purchase' AND (k % 7 = 0 OR k % 11 = 0))),
f AS (SELECT u, min(seq) AS first_named FROM ch WHERE named GROUP BY u),
ap AS (SELECT ch.* FROM ch JOIN f USING (u) WHERE named OR seq > first_named),
cur AS (SELECT * FROM ap QUALIFY row_number() OVER (PARTITION BY u ORDER BY seq DESC) = 1)
"""


def _feed(spark, sf):
    return fixtures.subscription_feed(table(spark, sf, "events"))


def _current(spark, sf):
    return subs.current_subscriptions(_feed(spark, sf))


@query("u01_handled_changes", CH + "SELECT seq AS change_seq, status FROM ch")
def changes(spark, sf):
    return subs.change_records(_feed(spark, sf)).select("change_seq", "status")


_CUR = """SELECT uid AS user_id, 'sub_' || u AS subscription_id, CASE WHEN k % 5 <> 0 THEN 'price_' || (k % 3) END AS price_id, status,
 CASE WHEN k % 4 <> 0 THEN CAST(floor(epoch(ts)) AS BIGINT) + 2592000 END AS period_end_s, (k % 2 = 0) AS cancel_at_period_end, seq AS change_seq FROM cur"""


def _shape(state):
    return state.select("user_id", "subscription_id", "price_id", "status", F.unix_seconds("current_period_end").alias("period_end_s"), "cancel_at_period_end", "change_seq")


@query("u02_current_subscriptions", CH + _CUR)
def current(spark, sf):
    return _shape(_current(spark, sf))


@query("u02_merge_state", CH + _CUR)
def merged(spark, sf):
    feed = _feed(spark, sf)
    half = F.pmod(F.unix_date(F.to_date("changed_at")), F.lit(1000)) < 735
    return _shape(subs.merge_state(subs.current_subscriptions(feed.filter(half)), feed.filter(~half)))


@query("u03_unmatched_changes", CH + "SELECT count(*) AS dropped FROM ch LEFT JOIN f USING (u) WHERE NOT named AND (first_named IS NULL OR seq < first_named)")
def unmatched(spark, sf):
    return subs.unmatched_changes(_feed(spark, sf)).agg(F.count(F.lit(1)).alias("dropped"))


@query("u04_entitlement", CH + "SELECT uid AS user_id, (status IN ('active', 'trialing')) AS active FROM cur")
def entitlement(spark, sf):
    return _current(spark, sf).select("user_id", subs.entitled(F.col("status")).alias("active"))


@query("u05_row_gate", CH + ", " + """usage AS (SELECT o_custkey AS c, printf('user-%05d', o_custkey % 300) AS user_id, count(*) * 8 AS row_count FROM orders GROUP BY o_custkey)
SELECT c AS customer, row_count, (row_count <= 50 OR coalesce(status IN ('active', 'trialing'), false)) AS allowed FROM usage LEFT JOIN cur ON uid = user_id""")
def gate(spark, sf):
    usage = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("customer")).agg((F.count(F.lit(1)) * 8).alias("row_count"))
    usage = usage.withColumn("user_id", F.format_string("user-%05d", F.col("customer") % 300))
    return subs.row_gate(usage, _current(spark, sf)).select("customer", "row_count", "allowed")


ALLOW = """
WITH RECURSIVE a AS (SELECT user_id AS v, event_id AS id, epoch_us(ts) // 1000 AS t FROM events WHERE event_type = 'purchase'),
w(v, s) AS (SELECT v, min(t) FROM a GROUP BY v UNION ALL SELECT w.v, (SELECT min(t) FROM a WHERE a.v = w.v AND a.t >= w.s + 86400000) FROM w WHERE EXISTS (SELECT 1 FROM a WHERE a.v = w.v AND a.t >= w.s + 86400000)),
p AS (SELECT a.*, w.s, row_number() OVER (PARTITION BY a.v, w.s ORDER BY a.t, a.id) AS n FROM a JOIN w ON a.v = w.v AND a.t >= w.s AND a.t < w.s + 86400000),
m AS (SELECT v AS visitor_id, id AS attempt_id, t AS at_ms, n <= 2 AS allowed, CAST(least(n, 2) AS BIGINT) AS used, s + 86400000 AS resets_at_ms FROM p)
"""


@query("u06_allowance", ALLOW + "SELECT * FROM m")
def allowance(spark, sf):
    out = subs.meter_allowance(fixtures.allowance_attempts(table(spark, sf, "events")))
    return out.select("visitor_id", "attempt_id", "at_ms", "allowed", long("used"), "resets_at_ms")


@query("u07_peek_allowance", ALLOW + """, l AS (SELECT visitor_id, arg_max(used, at_ms) AS used, arg_max(resets_at_ms, at_ms) AS resets FROM m WHERE at_ms <= 1705276800000 GROUP BY visitor_id)
SELECT visitor_id, CASE WHEN resets > 1705276800000 THEN used < 2 ELSE true END AS allowed, CASE WHEN resets > 1705276800000 THEN used ELSE 0 END AS used FROM l""")
def peek(spark, sf):
    return subs.peek_attempts(fixtures.allowance_attempts(table(spark, sf, "events")), 1_705_276_800_000).select("visitor_id", "allowed", long("used"))
