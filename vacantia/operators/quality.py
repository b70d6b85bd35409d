"""Data-quality profiles, with exact percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import trimmed, usable


#: Stretches of values an octave has, when the ranks of percentiles are sought.
STRETCHES = 64


def _stretch(v: Column) -> Column:
    """A whole number that does not fall as v grows: nearby values share one."""
    steps = F.floor(F.log2(F.abs(v)) * STRETCHES) + 100_000
    return F.when(v == 0, F.lit(0)).otherwise(F.signum(v) * steps).cast("long")


def percentiles(df: DataFrame, value: Column, shares: dict[str, float], by: list[str] = ()) -> DataFrame:
    """by and one exact, interpolated percentile per name in shares; nulls are left out.

    Values are counted, then ranked in two steps: running counts over stretches of values
    (a few thousand rows), and over the values of those stretches alone in which a
    percentile falls. So no group's values meet in one task or in one aggregate."""
    by = list(by)
    n = df.select(*by, value.cast("double").alias("_v")).filter("_v IS NOT NULL").groupBy(*by, "_v").agg(F.count("*").alias("_n"))
    n = n.withColumn("_s", _stretch(F.col("_v")))
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    per = n.groupBy(*by, "_s").agg(F.sum("_n").alias("_m"))
    upto = F.sum("_m").over(whole.orderBy("_s").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    per = per.withColumns({"_upto": upto, "_all": F.sum("_m").over(whole)})
    place = lambda p: F.lit(float(p)) * (F.col("_all") - 1)
    wanted = F.array(*[F.struct(F.lit(k).alias("name"), place(p).alias("at"), side(place(p)).cast("long").alias("k")) for k, p in shares.items() for side in (F.floor, F.ceil)])
    hit = per.withColumn("_w", F.explode(F.array_distinct(wanted))).filter((F.col("_w.k") < F.col("_upto")) & (F.col("_w.k") >= F.col("_upto") - F.col("_m")))
    hit = hit.select(*[F.col(c).alias(f"_h_{c}") for c in by], F.col("_s").alias("_h_s"), "_w.name", "_w.at", "_w.k", (F.col("_upto") - F.col("_m")).alias("_before"))
    same = F.col("_s") == F.col("_h_s")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_h_{c}"))
    stretches = hit.groupBy(*[f"_h_{c}" for c in by], "_h_s").agg(F.collect_list(F.struct("name", "at", "k", "_before")).alias("_list"))
    inside = Window.partitionBy(*by, "_s").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = n.join(stretches, same).withColumn("_to", F.sum("_n").over(inside)).withColumn("_w", F.explode("_list"))
    k = F.col("_w.k") - F.col("_w._before")
    rows = rows.filter((k < F.col("_to")) & (k >= F.col("_to") - F.col("_n")))
    at = F.max("_w.at")
    ends = rows.groupBy(*by, "_w.name").agg(F.min("_v").alias("a"), F.max("_v").alias("b"), at.alias("at"))
    value_ = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise((F.ceil("at") - F.col("at")) * F.col("a") + (F.col("at") - F.floor("at")) * F.col("b"))
    return ends.groupBy(*by).agg(*[F.max(F.when(F.col("name") == name, value_)).alias(name) for name in shares])


def _with_percentiles(df: DataFrame, value: Column, shares: dict[str, float], by: list[str], *others: Column) -> DataFrame:
    """others and percentiles of each group; a group without values has null percentiles."""
    by = list(by)
    out = df.groupBy(*by).agg(*others)
    p = percentiles(df, value, shares, by)
    if not by:
        return out.join(F.broadcast(p), F.lit(True), "left")  # one row each
    same = F.lit(True)
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_p_{c}"))
    return out.join(p.withColumnsRenamed({c: f"_p_{c}" for c in by}), same, "left").drop(*[f"_p_{c}" for c in by])


def numeric_profile(df: DataFrame, value: Column, by: list[str] = ()) -> DataFrame:
    """min, p50, p90 and max of what reads as a finite number."""
    v = value.cast("string").try_cast("double")
    v = F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)
    out = _with_percentiles(df, v, {"p50": 0.5, "p90": 0.9}, by, F.count(v).alias("n"), F.min(v).alias("min"), F.max(v).alias("max"))
    return out.select(*by, "n", "min", "p50", "p90", "max")


def _spread(df: DataFrame, v: Column, by: list[str]) -> DataFrame:
    out = _with_percentiles(df, v, {"p10": 0.1, "p50": 0.5, "p90": 0.9}, by, F.count(v).alias("n"), F.avg(v).alias("avg"))
    return out.select(*by, "n", "avg", "p10", "p50", "p90")


def length_profile(df: DataFrame, text: Column, by: list[str] = ()) -> DataFrame:
    """Lengths of trimmed texts, blanks left out."""
    n = F.length(trimmed(text))
    return _spread(df, F.when(n > 0, n), by)


def count_profile(df: DataFrame, count: Column, by: list[str] = ()) -> DataFrame:
    return _spread(df, count, by)


def blanks(text: Column) -> Column:
    return F.count_if(F.coalesce(trimmed(text), F.lit("")) == "")


def duplicates(df: DataFrame, value: Column) -> DataFrame:
    """How many rows repeat a non-blank value that stands already."""
    v = F.nullif(trimmed(value.cast("string")), F.lit(""))
    return df.agg((F.count(v) - F.count_distinct(v)).alias("duplicates"))


def share(part: Column, digits: int = 4) -> Column:
    return F.round(100.0 * F.count_if(part) / F.nullif(F.count("*"), F.lit(0)), digits)


def by_source(df: DataFrame, source: str = "source_type") -> DataFrame:
    return df.groupBy(F.coalesce(F.col(source), F.lit("unknown")).alias(source)).agg(F.count("*").alias("n"))


def shown(value: Column) -> Column:
    """Two decimals at most, without trailing zeros; 'unknown' for null or not finite."""
    v = value.cast("double")
    text = F.regexp_replace(F.regexp_replace(F.format_string("%.2f", v), "0+$", ""), r"\.$", "")
    return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), F.lit("unknown")).otherwise(text)


def shown_text(value: Column) -> Column:
    return F.coalesce(F.nullif(trimmed(value.cast("string")), F.lit("")), F.lit("unknown"))


def shown_counts(counts: Column) -> Column:
    """A map as {key:value,...}, in order of its keys."""
    entries = F.array_sort(F.transform(F.map_entries(counts), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))))
    return F.concat(F.lit("{"), F.array_join(entries, ","), F.lit("}"))


def line(stage: Column, **fields: Column) -> Column:
    """One line of the quality log, its fields (shown already) in the order given."""
    parts = [F.concat(F.lit(f"{k}="), v) for k, v in fields.items()]
    return F.concat_ws(" ", F.concat(F.lit("DATA_QUALITY stage="), stage), *parts)


def status_counts(df: DataFrame, code: str) -> DataFrame:
    """status, n and place: numbers in order, what has none last."""
    n = df.groupBy(F.col(code).cast("int").alias("_code")).agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.orderBy(F.asc_nulls_last("_code"))).cast("long")  # one row a status
    return n.select(F.coalesce(F.col("_code").cast("string"), F.lit("unknown")).alias("status"), "n", place.alias("place"))


def posted_summary(df: DataFrame, active: str = "is_active", posted_at: str = "posted_at") -> DataFrame:
    """One row: active postings, how many have a posting time as text, how many lack it, and the share."""
    has = F.coalesce(usable(F.col(posted_at)), F.lit(False))
    d = df.filter(F.col(active)).agg(F.count("*").alias("active_jobs"), F.count_if(has).alias("has_posted_at"), F.count_if(~has).alias("missing_posted_at"))
    return d.withColumn("percent_missing_posted_at", F.coalesce(100.0 * F.col("missing_posted_at") / F.nullif("active_jobs", F.lit(0)), F.lit(0.0)))


def connector_summary(fetched: DataFrame, known: DataFrame, source: str, key: str = "source_job_id", fingerprint: str = "fingerprint") -> DataFrame:
    """A row a source of what a connector fetched: rows, unchanged ones (known has the same fingerprint
    under source and key, one row each), rows to merge, blank fields, and repeated keys.

    Repeats are counted by key before sources meet, so a source of very many rows is no hot group."""
    was = known.select(F.col(source).alias("_source"), F.col(key).alias("_key"), F.col(fingerprint).alias("_fingerprint"))
    d = fetched.join(was, (F.col(source) == F.col("_source")) & (F.col(key) == F.col("_key")), "left")
    blank = {"missing_title": "title", "missing_url": "job_url", "missing_location": "location_name", "missing_content_text": "content_text"}
    same = F.col(fingerprint) == F.col("_fingerprint")
    n = d.groupBy(source, key).agg(F.count("*").alias("_n"), F.count_if(same).alias("_same"), *[blanks(F.col(c)).alias(name) for name, c in blank.items()])
    again = F.when(F.coalesce(trimmed(F.col(key)), F.lit("")) != "", F.col("_n") - 1).otherwise(0)
    total = lambda c: F.sum(c).cast("long")
    out = n.groupBy(source).agg(total("_n").alias("fetched"), total("_same").alias("unchanged_skipped"), total(F.col("_n") - F.col("_same")).alias("to_upsert"), *[total(c).alias(c) for c in blank], total(again).alias("duplicate_source_job_ids"))
    return out


def export_summary(rows: DataFrame, now: Column, shard: str = "artifact_shard", source: str = "source_type", first_seen: str = "first_seen_at_utc") -> DataFrame:
    """A row a shard, and one of all (shard null): rows, those first seen in the last 24 hours, and a map of
    rows by source ('unknown' where there is none). Shards and sources are counted once, the rest folds counts."""
    new = F.coalesce(F.col(first_seen) >= now - F.expr("INTERVAL 24 HOURS"), F.lit(False))
    n = rows.groupBy(F.col(shard), F.coalesce(F.nullif(F.col(source), F.lit("")), F.lit("unknown")).alias("_source")).agg(F.count("*").alias("_n"), F.count_if(new).alias("_new"))
    n = n.unionByName(n.groupBy("_source").agg(F.sum("_n").alias("_n"), F.sum("_new").alias("_new")).withColumn(shard, F.lit(None).cast(rows.schema[shard].dataType)))
    entries = F.array_sort(F.collect_list(F.struct("_source", "_n")))  # as many as there are kinds of sources
    return n.groupBy(shard).agg(F.sum("_n").alias("rows"), F.sum("_new").alias("new_first_seen_24h"), F.map_from_entries(entries).alias("source_type_counts"))


#: What a model's calls are counted by (fixed values).
USAGE = ("input_tokens", "cached_input_tokens", "output_tokens", "reasoning_tokens", "total_tokens")


def usage_totals(calls: DataFrame, by: list[str], usage: str = "usage") -> DataFrame:
    """Tokens used by calls, per group: sums of the fields of a JSON text, where what is absent, null or no number counts 0."""
    v = {c: F.coalesce(F.get_json_object(usage, f"$.{c}").try_cast("bigint"), F.lit(0)) for c in USAGE}
    return calls.groupBy(*by).agg(F.count("*").alias("calls"), *[F.sum(x).cast("long").alias(c) for c, x in v.items()])
