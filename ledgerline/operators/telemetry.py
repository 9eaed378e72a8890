"""Usage events: cleaning, and the numbers of the dashboard.

``clean_events`` is a projection and a filter, so it serves streams as well.
Everything relative to now takes ``as_of``.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ledgerline import rules
from ledgerline.functions.classify import literal_map
from ledgerline.functions.text import first_match, strip

SCAN = ["event", "session_id", "bank_slug", "dialect", "country", "ip", "browser", "os", "error_code", "created_at"]


def one_of(value: Column, allowed: list[str]) -> Column:
    return F.when(value.isin(allowed), value)


def normalise_error(raw: Column) -> Column:
    """Engine code or canonical name to the canonical name; blank is NULL."""
    trimmed = strip(raw)
    known = F.try_element_at(literal_map(rules.ERROR_CODES), F.lower(trimmed))
    canonical = trimmed.isin(sorted(set(rules.ERROR_CODES.values())))
    return F.when(trimmed != "", F.when(canonical, trimmed).otherwise(F.coalesce(known, F.lit(rules.UNKNOWN_ERROR))))


def browser_of(agent: Column) -> Column:
    return F.when(agent != "", first_match(agent, rules.BROWSERS, F.lit(rules.OTHER_AGENT)))


def system_of(agent: Column) -> Column:
    return F.when(agent != "", first_match(agent, rules.SYSTEMS, F.lit(rules.OTHER_AGENT)))


def _header(headers: Column, name: str) -> Column:
    return F.try_element_at(headers, F.lit(name))


def country_of(headers: Column) -> Column:
    """The first header present decides, even when its value is no country."""
    upper = F.upper(strip(F.coalesce(*[_header(headers, h) for h in rules.COUNTRY_HEADERS])))
    return F.when(upper.rlike(rules.COUNTRY_PATTERN), upper)


def client_ip(headers: Column) -> Column:
    """Leftmost forwarded hop, else the fallback headers; loosely checked."""
    forwarded, *others = [_header(headers, h) for h in rules.IP_HEADERS]
    candidate = F.coalesce(strip(F.substring_index(forwarded, ",", 1)), *[strip(h) for h in others])
    shaped = candidate.rlike(rules.IPV4_PATTERN) | (candidate.rlike(rules.IPV6_PATTERN) & F.contains(candidate, F.lit(":")))
    return F.when(shaped, candidate)


def referrer_host(url: Column, own_host: Column | str = "") -> Column:
    """``direct``, ``internal`` or the allow-listed domain a referrer belongs to."""
    own = F.lit(own_host) if isinstance(own_host, str) else own_host
    host = F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")
    allowed = F
    for domain in rules.REFERRER_HOSTS:
        allowed = allowed.when((host == domain) | F.endswith(host, F.lit(f".{domain}")), F.lit(domain))
    return F.when(host.isNull(), F.lit("direct")).when(host == own, F.lit("internal")).otherwise(F.coalesce(allowed, F.lit("direct")))


def clean_events(raw: DataFrame) -> DataFrame:
    """Validated event rows. An unknown event or session drops the row; any
    other unknown value becomes NULL."""
    event = one_of(F.col("event"), rules.EVENTS)
    session = F.when(F.col("session_id").rlike(rules.SESSION_PATTERN), F.col("session_id"))
    slugs = [layout[0] for layout in rules.BANK_LAYOUTS]
    return raw.filter(event.isNotNull() & session.isNotNull()).select(
        "event_id",
        "event",
        "session_id",
        F.coalesce(one_of(F.col("surface"), rules.SURFACES), F.lit("other")).alias("surface"),
        one_of(F.col("bank_slug"), slugs).alias("bank_slug"),
        one_of(F.col("dialect"), rules.EVENT_DIALECTS).alias("dialect"),
        one_of(F.col("row_bucket"), rules.ROW_BANDS).alias("row_bucket"),
        one_of(F.col("referrer_host"), [*rules.REFERRER_HOSTS, "direct", "internal"]).alias("referrer_host"),
        country_of(F.col("headers")).alias("country"),
        client_ip(F.col("headers")).alias("ip"),
        browser_of(F.col("user_agent")).alias("browser"),
        system_of(F.col("user_agent")).alias("os"),
        F.when(F.col("event") == "conversion_failed", normalise_error(F.col("error_code"))).alias("error_code"),
        "created_at",
    )


def rejected_events(raw: DataFrame) -> DataFrame:
    """The rows `clean_events` drops, with the reason, for a quarantine table."""
    bad_event = ~F.coalesce(F.col("event").isin(rules.EVENTS), F.lit(False))
    bad_session = ~F.coalesce(F.col("session_id").rlike(rules.SESSION_PATTERN), F.lit(False))
    reason = F.when(bad_event, "event").otherwise("session")
    return raw.filter(bad_event | bad_session).select("event_id", "event", "session_id", "created_at", reason.alias("reason"))


# --- the dashboard -----------------------------------------------------------


def since(as_of: datetime, hours: int) -> datetime:
    return as_of - timedelta(hours=hours)


def range_scan(events: DataFrame, as_of: datetime, hours: int = rules.DEFAULT_RANGE_HOURS, cap: int | None = None) -> DataFrame:
    """Events of a range, all of them unless a report asks for the newest ``cap``."""
    hours = hours if hours in rules.RANGE_HOURS else rules.DEFAULT_RANGE_HOURS
    scan = _from(events, since(as_of, hours))
    return scan if cap is None else scan.orderBy(F.desc("created_at")).limit(cap)


def _from(events: DataFrame, start: datetime) -> DataFrame:
    """Events from a time on; a table partitioned by date is pruned by it."""
    kept = events.filter(F.col("created_at") >= F.lit(start).cast(events.schema["created_at"].dataType))
    return kept.filter(F.col("event_date") >= F.lit(start.date())) if "event_date" in events.columns else kept


def visitor_key() -> Column:
    return F.coalesce("ip", F.concat(F.lit("session:"), F.col("session_id")))


def unique_visitors(events: DataFrame, approximate: bool = False) -> DataFrame:
    landed = events.filter(F.col("event") == "visitor_landed").select(visitor_key().alias("visitor"))
    count = F.approx_count_distinct("visitor") if approximate else F.count_distinct("visitor")
    return landed.agg(count.alias("unique_visitors"))


def counters(events: DataFrame) -> DataFrame:
    def of(event: str) -> Column:
        return F.count_if(F.col("event") == event)

    return events.agg(
        of("conversion_success").alias("successes"), of("conversion_failed").alias("failures"), of("user_logged_in").alias("logins")
    )


def funnel(events: DataFrame) -> DataFrame:
    """Distinct sessions per stage. Sessions are folded first, in one shuffle."""
    stages = [F.max((F.col("event") == event).cast("int")).alias(f"s{i}") for i, (_, event) in enumerate(rules.FUNNEL)]
    wanted = events.filter(F.col("event").isin([event for _, event in rules.FUNNEL]))
    totals = wanted.groupBy("session_id").agg(*stages).agg(*[F.coalesce(F.sum(f"s{i}"), F.lit(0)).alias(f"s{i}") for i in range(len(rules.FUNNEL))])
    rows = F.array(*[F.struct(F.lit(i).alias("stage"), F.lit(label).alias("label"), F.col(f"s{i}").alias("sessions")) for i, (label, _) in enumerate(rules.FUNNEL)])
    return totals.select(F.inline(rows))


def funnel_dropoff(stages: DataFrame) -> DataFrame:
    """Loss against the stage before and share of the first; four rows."""
    order = W.partitionBy(F.lit(1)).orderBy("stage")
    previous = F.lag("sessions").over(order)
    top = F.greatest(F.first("sessions").over(order), F.lit(1))
    lost = F.coalesce(previous - F.col("sessions"), F.lit(0))
    pct = F.when(previous > 0, lost / previous * 100).otherwise(F.lit(0.0))
    return stages.select(
        "stage",
        "label",
        "sessions",
        lost.alias("lost"),
        F.floor(pct + 0.5).alias("drop_pct"),
        (pct >= rules.SEVERE_DROP_PCT).alias("severe"),
        F.floor(F.col("sessions") / top * 100 + 0.5).alias("of_first_pct"),
    )


def failure_ranking(events: DataFrame) -> DataFrame:
    code = F.coalesce("error_code", F.lit(rules.UNKNOWN_ERROR))
    return events.filter(F.col("event") == "conversion_failed").groupBy(code.alias("error_code")).agg(F.count(F.lit(1)).alias("failures")).orderBy(F.desc("failures"), "error_code")


def top_failure(events: DataFrame) -> DataFrame:
    return failure_ranking(events).limit(1)


def hourly_buckets(events: DataFrame, as_of: datetime, slots: int = 24) -> DataFrame:
    """The last hours, empty ones included: landings and conversions per hour."""
    spark = events.sparkSession
    current = as_of.replace(minute=0, second=0, microsecond=0)
    start = current - timedelta(hours=slots - 1)
    kind = events.schema["created_at"].dataType
    recent = events.filter((F.col("created_at") >= F.lit(start).cast(kind)) & (F.col("created_at") < F.lit(current + timedelta(hours=1)).cast(kind)))
    counted = recent.groupBy(F.date_format(F.date_trunc("hour", "created_at"), "yyyy-MM-dd HH:00").alias("hour")).agg(
        F.count_if(F.col("event") == "visitor_landed").alias("landed"), F.count_if(F.col("event") == "conversion_success").alias("converted")
    )
    spine = spark.range(slots).select(
        F.date_format(F.lit(start).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("id").cast("int")), "yyyy-MM-dd HH:00").alias("hour")
    )
    return spine.join(counted, "hour", "left").select("hour", F.coalesce("landed", F.lit(0)).alias("landed"), F.coalesce("converted", F.lit(0)).alias("converted"))


def peak_share(buckets: DataFrame) -> DataFrame:
    """Share of the busiest hour; a day of rows, so one window is fine."""
    peak = F.greatest(F.lit(1), F.max("landed").over(W.partitionBy(F.lit(1))))
    return buckets.select("hour", "landed", "converted", F.round(F.col("landed") / peak, 6).alias("share"))


def recent_feed(events: DataFrame, limit: int = rules.FEED_ROWS) -> DataFrame:
    """The newest events with the status shown beside each."""
    status = (
        F.when(F.col("error_code").isNotNull(), F.col("error_code"))
        .when(F.col("event") == "conversion_success", F.coalesce("dialect", F.lit("ok")))
        .otherwise(F.coalesce(F.replace("bank_slug", F.lit(rules.LAYOUT_SLUG_SUFFIX), F.lit("")), F.lit("ok")))
    )
    newest = events.orderBy(F.desc("created_at"), F.desc("event_id")).limit(limit)
    client = F.when(F.col("browser").isNotNull(), F.concat_ws(" · ", "browser", F.coalesce("os", F.lit("—")))).otherwise("—")
    return newest.select("event_id", "created_at", "event", F.coalesce("country", F.lit("—")).alias("country"), client.alias("client"), status.alias("status"))


def purge(events: DataFrame, as_of: datetime, days: int = rules.RETENTION_DAYS) -> DataFrame:
    """What remains after the retention purge; a partitioned table prunes by it."""
    return _from(events, as_of - timedelta(days=days))


def domain_audit(events: DataFrame) -> DataFrame:
    """Rows that break each closed set of the event table, in one pass."""
    def outside(name: str, allowed: list[str], nullable: bool) -> Column:
        bad = ~F.col(name).isin(allowed)
        return F.count_if(bad if nullable else F.coalesce(bad, F.lit(True)))

    audits = {
        "event": outside("event", rules.EVENTS, False),
        "surface": outside("surface", rules.SURFACES, False),
        "dialect": outside("dialect", rules.EVENT_DIALECTS, True),
        "row_bucket": outside("row_bucket", rules.ROW_BANDS, True),
        "country": F.count_if(F.col("country").isNotNull() & ~F.col("country").rlike(rules.COUNTRY_PATTERN)),
        "session_id": F.count_if(~F.coalesce(F.col("session_id").rlike(rules.SESSION_PATTERN), F.lit(False))),
    }
    one = events.agg(*[expr.alias(name) for name, expr in audits.items()])
    rows = F.array(*[F.struct(F.lit(name).alias("rule"), F.col(name).alias("violations")) for name in audits])
    return one.select(F.inline(rows))
