"""Keeping a table of postings: upsert, soft delete, versions, eligibility, shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cut_utf8, usable, without_nul
from .artifacts import merged_json

#: Location statuses that may be exported (fixed values).
EXPORTABLE = ("parsed", "country_only", "remote", "multi_location", "city_resolved")


def eligible(active: Column, text: Column, posted_at: Column, status: Column) -> Column:
    """Active, with usable text, a posting time and an exportable location; never null."""
    return F.coalesce(active & usable(text) & posted_at.isNotNull() & status.isin(*EXPORTABLE), F.lit(False))


def pending(version: Column, current: str) -> Column:
    """Rows whose derived columns are not of the current version (null is not)."""
    return ~version.eqNullSafe(F.lit(current))


def changed_only(new: DataFrame, old: DataFrame, key: list[str], fingerprint: str = "fingerprint") -> DataFrame:
    """Rows of new that old lacks or has with another fingerprint."""
    was = old.select(*[F.col(k).alias(f"_{k}") for k in key], F.col(fingerprint).alias("_fingerprint"))
    on = [F.col(k) == F.col(f"_{k}") for k in key]
    return new.join(was, on, "left").filter(~F.col(fingerprint).eqNullSafe(F.col("_fingerprint"))).select(*new.columns)


def upsert(old: DataFrame, new: DataFrame, key: list[str], keep: list[str] = (), reset: dict[str, list[str]] | None = None) -> DataFrame:
    """Full outer merge: new values win, columns in keep stay from old, and derived
    columns become null when any of the columns they were derived from changed.

    reset: derived column -> the columns it depends on. Columns that new lacks stay."""
    n = new.select(*[F.col(c).alias(f"_n_{c}") for c in new.columns], F.lit(True).alias("_n"))
    o = old.withColumn("_o", F.lit(True))
    both = o.join(n, [F.col(k) == F.col(f"_n_{k}") for k in key], "full")
    out = []
    for c in old.columns:
        fresh = F.col(f"_n_{c}") if c in new.columns else None
        if c in key or (fresh is not None and c in keep):
            v = F.coalesce(F.col(c), fresh)
        elif fresh is not None:
            v = F.when(F.col("_n"), fresh).otherwise(F.col(c))
        else:
            v = F.col(c)
        for d in (reset or {}).get(c, []):
            v = F.when(F.col("_n") & F.col("_o") & ~F.col(d).eqNullSafe(F.col(f"_n_{d}")), F.lit(None)).otherwise(v)
        out.append(v.alias(c))
    return both.select(*out)


def mark_missing(rows: DataFrame, seen: DataFrame, scope: list[str], key: str, now: Column, active: str = "is_active", at: str = "missing_at") -> DataFrame:
    """Rows of the scopes in seen that were not seen there become inactive; the time they
    first went missing stays. seen: scope columns and key (null key: the scope was read and was empty)."""
    ids = seen.filter(F.col(key).isNotNull()).select(*[F.col(c).alias(f"_k_{c}") for c in scope], F.col(key).alias("_k_key"), F.lit(True).alias("_seen")).distinct()
    read = seen.select(*[F.col(c).alias(f"_r_{c}") for c in scope], F.lit(True).alias("_read")).distinct()
    out = rows.join(read, [F.col(c) == F.col(f"_r_{c}") for c in scope], "left")
    out = out.join(ids, [*(F.col(c) == F.col(f"_k_{c}") for c in scope), F.col(key) == F.col("_k_key")], "left")
    gone = F.col("_read") & F.col("_seen").isNull() & F.col(active)
    gone = F.coalesce(gone, F.lit(False))
    return out.select(*[F.when(gone, F.lit(False)).otherwise(F.col(c)).alias(c) if c == active else F.when(gone, F.coalesce(F.col(c), now)).otherwise(F.col(c)).alias(c) if c == at else F.col(c) for c in rows.columns])


def newest_shards(rows: DataFrame, at: str, key: str, per_shard: int, most: int | None = None) -> DataFrame:
    """The `most` newest rows with their 0-based recency and shard.

    A global row number would send all rows to one task; here a rank is the number of rows
    of newer days and of newer minutes of the day, from small counts, and the rank within
    the minute."""
    r = rows.filter(F.col(at).isNotNull()).withColumns({"_day": F.to_date(F.col(at)), "_minute": F.floor(F.unix_timestamp(F.col(at).cast("timestamp")) / 60)})
    minutes = r.groupBy("_day", "_minute").agg(F.count("*").alias("_n"))
    days = minutes.groupBy("_day").agg(F.sum("_n").alias("_n"))
    newer = Window.orderBy(F.desc("_day")).rowsBetween(Window.unboundedPreceding, -1)  # one row a day
    days = days.select(F.col("_day").alias("_d"), F.coalesce(F.sum("_n").over(newer), F.lit(0)).alias("_before"))
    if most is not None:
        days = days.filter(F.col("_before") < most)
    later = Window.partitionBy("_day").orderBy(F.desc("_minute")).rowsBetween(Window.unboundedPreceding, -1)  # 1440 rows a day
    minutes = minutes.join(days, F.col("_day") == F.col("_d")).select(F.col("_d"), F.col("_minute").alias("_m"), (F.col("_before") + F.coalesce(F.sum("_n").over(later), F.lit(0))).alias("_before"))
    if most is not None:
        minutes = minutes.filter(F.col("_before") < most)
    inside = Window.partitionBy("_day", "_minute").orderBy(F.desc(at), F.desc(key))
    out = r.join(minutes, (F.col("_day") == F.col("_d")) & (F.col("_minute") == F.col("_m"))).withColumn("recency", F.col("_before") + F.row_number().over(inside) - 1)
    if most is not None:
        out = out.filter(F.col("recency") < most)
    return out.withColumn("artifact_shard", F.floor(F.col("recency") / per_shard).cast("long")).drop("_day", "_minute", "_d", "_m", "_before")


def early_stop(rows: DataFrame, shard: str, survives: Column, enough: int) -> DataFrame:
    """Surviving rows of shards in order, up to and with the shard that reaches `enough`."""
    kept = rows.filter(survives)
    n = kept.groupBy(F.col(shard).alias("_s")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    n = n.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).filter(F.col("_before") < enough)
    return kept.join(n, F.col(shard) == F.col("_s"), "left_semi")


def read_until(table: DataFrame, shard: str, shards: list, survives: Column, enough: int, at_once: int = 4) -> DataFrame:
    """As early_stop, of a table that is partitioned by shard: reading stops with it.

    shards are the table's, in order (a manifest). They are counted `at_once` at a time, and
    each filter on them is a filter on partitions, so the files of later shards are never opened."""
    kept, used = 0, []
    for i in range(0, len(shards), at_once):
        now = shards[i : i + at_once]
        n = {r[0]: r[1] for r in table.filter(F.col(shard).isin(now)).filter(survives).groupBy(shard).agg(F.count("*")).collect()}
        for s in now:
            used.append(s)
            kept += n.get(s, 0)
            if kept >= enough:
                return table.filter(F.col(shard).isin(used)).filter(survives)
    return table.filter(survives)


def backing_off(failures: Column, last_failure: Column, now: Column, most: int, hours: int) -> Column:
    """Failed too often, and too recently, to be tried again."""
    recent = last_failure > now - F.make_dt_interval(F.lit(0), F.lit(hours))
    return F.coalesce((failures >= most) & recent, F.lit(False))


#: Columns that a new text makes out of date.
DERIVED = ("requirements_version", "yoe_version", "clearance_version", "enrichment_version", "ml_version")


def fetched(rows: DataFrame, outcomes: DataFrame, key: str, now: Column, most_html: int, most_text: int) -> DataFrame:
    """rows after outcomes (key, html, text, error_type; one row a key) of fetching their pages.

    A success keeps the stored HTML if there is one, takes the text, both cut to their bytes and
    without NUL, clears the versions derived from the text (DERIVED) and the failures, and notes in
    raw_json what was cut. A failure (an error_type) counts one more, with its time and type, and
    leaves the rest. Rows without an outcome stay; one that rows lack is ignored."""
    o = outcomes.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in ("html", "text", "error_type")], F.lit(True).alias("_tried"))
    d = rows.join(o, F.col(key) == F.col("_key"), "left")
    failed = F.col("_error_type").isNotNull()
    won = F.coalesce(F.col("_tried") & ~failed, F.lit(False))
    long = lambda c, most: F.coalesce(F.octet_length(c) > most, F.lit(False))
    note = F.to_json(F.struct(F.struct(long("_html", most_html).alias("content_html_truncated"), long("_text", most_text).alias("content_text_truncated"), F.lit(False).alias("raw_json_omitted")).alias("ingestion_size_limits")))
    html, body = (without_nul(cut_utf8(F.col(c), most)) for c, most in (("_html", most_html), ("_text", most_text)))
    new = {
        "content_html": F.when(won, F.coalesce(F.col("content_html"), html)).otherwise(F.col("content_html")),
        "content_text": F.when(won, body).otherwise(F.col("content_text")),
        "raw_json": F.when(won, merged_json(F.coalesce(F.col("raw_json"), F.lit("{}")), note)).otherwise(F.col("raw_json")),
        "fetch_failed_count": F.when(won, 0).when(failed, F.coalesce(F.col("fetch_failed_count"), F.lit(0)) + 1).otherwise(F.col("fetch_failed_count")),
        "fetch_last_failed_at": F.when(failed, now).when(~won, F.col("fetch_last_failed_at")),
        "fetch_last_error_type": F.when(failed, F.col("_error_type")).when(~won, F.col("fetch_last_error_type")),
    }
    new |= {c: F.when(~won, F.col(c)) for c in DERIVED if c in rows.columns}
    return d.select(*[new[c].alias(c) if c in new else F.col(c) for c in rows.columns])


def gone_for_long(code: Column, streak: Column, most: int) -> Column:
    """A source whose last answer was 404, the last of `most` or more in a row; never null."""
    return F.coalesce((code == 404) & (streak >= most), F.lit(False))


def source_backlog(sources: DataFrame, skip_streak: int | None = None) -> DataFrame:
    """Sources to read, without those gone for long if skip_streak says how long, and their place within
    their kind (ats): longest unread first, never read before all, then by URL."""
    d = sources if skip_streak is None else sources.filter(~gone_for_long(F.col("last_http_status_code"), F.col("http_404_streak"), skip_streak))
    minute = F.coalesce(F.floor(F.unix_timestamp(F.col("last_get_at").cast("timestamp")) / 60), F.lit(-1))
    return placed(d.withColumn("_minute", minute), "ats", "_minute", [F.asc_nulls_first("last_get_at"), F.col("source_url")]).drop("_minute")


def skipped_sources(sources: DataFrame, skip_streak: int) -> DataFrame:
    """How many sources of each kind source_backlog leaves out."""
    return sources.groupBy("ats").agg(F.count_if(gone_for_long(F.col("last_http_status_code"), F.col("http_404_streak"), skip_streak)).alias("skipped"))


def placed(rows: DataFrame, by: str, coarse: str, order: list[Column]) -> DataFrame:
    """rows and their place (from 1) within `by`, in the order of a coarse number and then of order:
    counts of the coarse values give the rows before, so only rows of one such value meet in a task."""
    n = rows.groupBy(F.col(by).alias("_by"), F.col(coarse).alias("_c")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_by").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1))
    n = n.select("_by", "_c", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(by, coarse).orderBy(*order))
    out = rows.join(n, F.col(by).eqNullSafe(F.col("_by")) & F.col(coarse).eqNullSafe(F.col("_c")))
    return out.withColumn("place", (F.col("_before") + inside).cast("long")).drop("_by", "_c", "_before")


def attempt_streaks(events: DataFrame, source: str, at: str, code: Column, tie: str) -> DataFrame:
    """Per source: the last attempt, its code, how many 404s in a row it ends with, and the last error's time."""
    e = events.select(F.col(source).alias("source"), F.col(at).alias("at"), F.col(tie).alias("tie"), code.alias("code"))
    ok = F.max(F.when(F.coalesce(F.col("code") != 404, F.lit(True)), F.struct("at", "tie")))
    last = e.groupBy("source").agg(ok.alias("_ok"), F.max(F.struct("at", "tie", "code")).alias("_last"))
    joined = e.join(last, "source")
    streak = joined.groupBy("source").agg(F.count_if(F.col("_ok").isNull() | (F.struct("at", "tie") > F.col("_ok"))).alias("http_404_streak"), F.any_value("_last").alias("_last"))
    return streak.select("source", F.col("_last.at").alias("last_get_at"), F.col("_last.code").alias("last_http_status_code"), "http_404_streak", F.when(F.col("_last.code") >= 400, F.col("_last.at")).alias("last_error_at"))


def normalized_record(rows: DataFrame, now: Column) -> DataFrame:
    """Postings as the table holds them: a company (given, else its name, else the source's URL, else
    'unknown'), known times (now where none was noted), active unless said otherwise, not stale, raw_json
    never null, and no NUL in any text. A row without source_type or source_job_id raises."""
    texts = [f.name for f in rows.schema.fields if f.dataType.simpleString() == "string"]
    d = rows.withColumns({c: F.replace(F.col(c), F.lit("\0"), F.lit("")) for c in texts})
    there = lambda c: F.nullif(F.col(c), F.lit("")) if c in d.columns else F.lit(None).cast("string")
    for c in ("source_type", "source_job_id"):
        d = d.withColumn(c, F.coalesce(there(c), F.raise_error(F.lit(f"a posting without {c}")).cast("string")))
    at = lambda c, other: F.coalesce(F.col(c), other) if c in rows.columns else other
    fetched = at("fetched_at_utc", now)
    return d.withColumns(
        {
            "source_company": F.coalesce(there("source_company"), there("company_name"), there("source_url"), F.lit("unknown")),
            "fetched_at_utc": fetched,
            "first_seen_at_utc": at("first_seen_at_utc", fetched),
            "last_seen_at_utc": at("last_seen_at_utc", fetched),
            "is_active": at("is_active", F.lit(True)),
            "missing_from_source_at_utc": F.lit(None).cast("timestamp"),
            "stale_reason": F.lit(None).cast("string"),
            "raw_json": F.coalesce(there("raw_json"), F.lit("{}")),
        }
    )
