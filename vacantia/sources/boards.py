"""Listings that boards give page by page, details behind them, and endpoints to probe.

A listing's pages follow one another, so one source is read in one task, and sources
are read beside each other. What fetches a page is a parameter."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

#: Status and payload text of (source, page number from 1 or offset from 0, page size).
Fetch = Callable[[str, int, int], tuple[int, str | None]]
#: Statuses upon which a smaller page is tried, and its size (fixed values).
SMALLER, SMALL_PAGE = (400, 413, 422), 20
#: Endpoints that are probed, in order: a provider, and the URL around the slug (fixed values).
ENDPOINTS = [("greenhouse", "https://boards-api.greenhouse.io/v1/boards/{slug}/jobs"), ("lever", "https://api.lever.co/v0/postings/{slug}?mode=json"), ("ashby", "https://api.ashbyhq.com/posting-api/job-board/{slug}")]


def _loads(body: str | None) -> dict:
    try:
        got = json.loads(body or "{}")
    except json.JSONDecodeError:
        return {}
    return got if isinstance(got, dict) else {}


def numbered_pages(source: str, fetch: Fetch, size: int = 10) -> Iterator[dict]:
    """Jobs of pages 1, 2, ... until totalCount of them are there, or a page has none."""
    seen, page, total = 0, 1, None
    while total is None or seen < total:
        got = _loads(fetch(source, page, size)[1])
        jobs = [j for j in got.get("jobs") or [] if isinstance(j, dict)]
        total = int(got.get("totalCount") or len(jobs)) if total is None else total
        if not jobs and page > 1:
            return
        yield from jobs
        seen, page = seen + len(jobs), page + 1


def offset_pages(source: str, fetch: Fetch, size: int = 100, most: int | None = None) -> Iterator[dict]:
    """Jobs from offset 0 on, until total is reached, a page is empty, or `most` are there.

    If the first page is refused for its size, pages of 20 are asked for; any other status raises."""
    offset, seen, total = 0, 0, None
    while (total is None or offset < total) and (most is None or seen < most):
        status, body = fetch(source, offset, size)
        if status in SMALLER and offset == 0 and size != SMALL_PAGE:
            size = SMALL_PAGE
            continue
        if status != 200:
            raise RuntimeError(f"{source}: status {status} at offset {offset}")
        got = _loads(body)
        if total is None and isinstance(got.get("total"), int):
            total = got["total"]
        jobs = got.get("jobPostings")
        if not isinstance(jobs, list) or not jobs:
            return
        valid = [j for j in jobs if isinstance(j, dict)]
        yield from valid if most is None else valid[: most - seen]
        seen, offset = seen + len(valid), offset + len(jobs)


def collected(sources: DataFrame, source: str, pages: Callable[[str], Iterator[dict]]) -> DataFrame:
    """source, position and raw_json of every job that `pages` gives for each source."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for s in b[source]:
                rows: list[tuple] = []
                for k, job in enumerate(pages(s)):
                    rows.append((s, k, json.dumps(job, ensure_ascii=False)))
                    if len(rows) == 1000:
                        yield pd.DataFrame(rows, columns=["source", "position", "raw_json"])
                        rows = []
                yield pd.DataFrame(rows, columns=["source", "position", "raw_json"])

    return sources.select(source).filter(F.col(source).isNotNull()).mapInPandas(run, "source string, position long, raw_json string")


def pages_read(pages: DataFrame, first_may_be_empty: bool = True, most: int | None = None) -> DataFrame:
    """source, position and raw_json of the jobs of stored listing pages, as a reader of the pages takes them.

    pages: source, page (from 1, without gaps), total (what the page says), jobs (array of JSON texts).
    Pages are taken in order until as many entries are there as the first page's total says (its
    own number, if it says none), or one is empty; an empty first page ends it too unless
    first_may_be_empty. Entries that are no object count but give no job; most bounds the jobs of
    a source. Windows see the sizes of pages only, never what they hold."""
    valid = F.filter("jobs", lambda j: F.ltrim(j).startswith("{"))
    size = pages.select("source", "page", F.coalesce(F.nullif("total", F.lit(0)), F.size("jobs").cast("long")).alias("_total"), F.coalesce(F.size("jobs"), F.lit(0)).alias("_n"), F.coalesce(F.size(valid), F.lit(0)).alias("_valid"))
    w = Window.partitionBy("source").orderBy("page")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    ends = (F.col("_n") == 0) & ((F.col("page") > 1) | F.lit(not first_may_be_empty))
    size = size.withColumns({"_all": F.first("_total").over(w), "_seen": zero("_n"), "_at": zero("_valid"), "_ended": F.coalesce(F.max(ends).over(before), F.lit(False)), "_gap": F.row_number().over(w) < F.col("page")})
    taken = size.filter((F.col("_seen") < F.col("_all")) & ~F.col("_ended") & ~F.col("_gap")).select(F.col("source").alias("_source"), F.col("page").alias("_page"), "_at")
    out = pages.join(taken, (F.col("source") == F.col("_source")) & (F.col("page") == F.col("_page")))
    out = out.select("source", "_at", F.posexplode(valid).alias("_k", "raw_json")).select("source", (F.col("_at") + F.col("_k")).cast("long").alias("position"), "raw_json")
    return out if most is None else out.filter(F.col("position") < most)


def with_details(listed: DataFrame, details: DataFrame, key: str, columns: list[str], state: str | None = None) -> DataFrame:
    """listed, with each of `columns` from its detail where that has one; only published rows if
    `state` names the column that says so (null counts as published)."""
    rows = listed if state is None else listed.filter(F.coalesce(F.col(state), F.lit("published")) == "published")
    d = details.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_d_{c}") for c in columns])
    out = rows.join(d, F.col(key) == F.col("_key"), "left")
    return out.select(*[F.coalesce(text.blank_to_null(F.col(f"_d_{c}")), F.col(c)).alias(c) if c in columns else F.col(c) for c in listed.columns])


def endpoints(companies: DataFrame, key: str, slugs: Column) -> DataFrame:
    """key, attempt, provider, identifier and matched_url of all that is probed for a company: each slug
    (a short array, in order) is tried with every provider before the next."""
    tried = companies.select(F.col(key), F.posexplode(slugs).alias("_n", "identifier"))
    ends = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(p).alias("provider"), F.lit(u).alias("url")) for k, (p, u) in enumerate(ENDPOINTS)])
    tried = tried.withColumn("_e", F.explode(ends))
    url = F.replace(F.col("_e.url"), F.lit("{slug}"), F.replace(F.url_encode("identifier"), F.lit("+"), F.lit("%20")))
    return tried.select(key, (F.col("_n") * len(ENDPOINTS) + F.col("_e.k")).alias("attempt"), F.col("_e.provider").alias("provider"), "identifier", url.alias("matched_url"))


def answers(provider: Column, status: Column, body: Column) -> Column:
    """Whether an endpoint's answer is a listing: status 200, and a list (Lever) or an object with a list of jobs."""
    listing = F.when(provider == "lever", F.ltrim(body).startswith("[")).otherwise(F.ltrim(F.get_json_object(body, "$.jobs")).startswith("["))
    return F.coalesce((status == 200) & listing, F.lit(False))


def first_answers(tried: DataFrame, answered: DataFrame, key: str) -> DataFrame:
    """key, provider, identifier and matched_url of the first attempt of each company whose URL has a valid
    answer (url, status, body; one row a URL) among those that were fetched and stored."""
    hit = tried.join(answered, F.col("matched_url") == F.col("url")).filter(answers(F.col("provider"), F.col("status"), F.col("body")))
    first = F.min(F.struct("attempt", "provider", "identifier", "matched_url"))
    return hit.groupBy(key).agg(first.alias("f")).select(key, "f.provider", "f.identifier", "f.matched_url")


def listing_class(stored_text: Column, same: Column, at: Column, most: int | None) -> Column:
    """What happens to a listed posting: 'reuse' where the stored one has text and all compared
    fields are the same, else 'fetch' for the first `most` others (numbered by `at`), else
    'keep' where there is a stored text and 'seen' where there is none."""
    known = F.coalesce(text.trimmed(stored_text), F.lit("")) != ""
    reuse = known & F.coalesce(same, F.lit(False))
    return F.when(reuse, "reuse").when(F.lit(most is None) | (at <= F.lit(most)), "fetch").when(known, "keep").otherwise("seen")


def classified(rows: DataFrame, source: str, order: str, stored_text: str, same: Column, most: int | None = None) -> DataFrame:
    """rows and listing_class, with the details to fetch counted per source in its own order."""
    reuse = (F.coalesce(text.trimmed(F.col(stored_text)), F.lit("")) != "") & F.coalesce(same, F.lit(False))
    w = Window.partitionBy(source).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # one source's listing
    at = F.sum(F.when(reuse, 0).otherwise(1)).over(w)
    return rows.withColumn("_at", at).withColumn("listing_class", listing_class(F.col(stored_text), same, F.col("_at"), most)).drop("_at")


def payload_fault(raw: Column) -> Column:
    """Why a payload of the iCIMS kind is refused; null if it is not: jobs is a list, and its first
    job has a data object with the provider's marker."""
    jobs, data = F.get_json_object(raw, "$.jobs"), F.get_json_object(raw, "$.jobs[0].data")
    marks = (F.get_json_object(raw, "$.jobs[0].data.ats_code") == "icims") | (F.get_json_object(raw, "$.jobs[0].data.meta_data.ats_code") == "icims")
    marked = F.coalesce(marks, F.lit(False)) | F.coalesce(F.get_json_object(raw, "$.jobs[0].data.meta_data.icims").startswith("{"), F.lit(False))
    empty = F.regexp_replace(jobs, r"\s", "") == "[]"
    return (
        F.when(~F.coalesce(jobs.startswith("["), F.lit(False)), "jobs is no list")
        .when(empty, F.lit(None))
        .when(~F.coalesce(data.startswith("{"), F.lit(False)), "no data object")
        .when(~marked, "no provider marker")
    )


def public_url(data: Column, source_url: Column) -> Column:
    """The canonical URL of a job's data (JSON), else the listing's path and the slug, else null."""
    slug = F.coalesce(F.nullif(F.get_json_object(data, "$.slug"), F.lit("")), F.nullif(F.get_json_object(data, "$.req_id"), F.lit("")))
    site = F.regexp_extract(source_url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", 0)
    path = F.coalesce(F.nullif(F.regexp_replace(F.coalesce(F.try_parse_url(source_url, F.lit("PATH")), F.lit("")), "/+$", ""), F.lit("")), F.lit("/jobs"))
    return F.coalesce(text.blank_to_null(F.get_json_object(data, "$.meta_data.canonical_url")), F.concat(site, path, F.lit("/"), slug, F.lit("?lang=en-us")))


def workday_endpoint(site_url: Column) -> Column:
    """The listing endpoint of a Workday site; null without a site slug."""
    host, slug = _site(site_url)
    scheme = F.try_parse_url(site_url, F.lit("PROTOCOL"))
    return F.concat(scheme, F.lit("://"), host, F.lit("/wday/cxs/"), F.split_part(host, F.lit("."), F.lit(1)), F.lit("/"), slug, F.lit("/jobs"))


def _site(site_url: Column) -> tuple[Column, Column]:
    part = F.filter(F.split(F.coalesce(F.try_parse_url(site_url, F.lit("PATH")), F.lit("")), "/"), lambda p: p != "")
    rest = F.when(F.get(part, F.lit(0)).rlike("^[a-z]{2}-[A-Z]{2}$"), F.slice(part, 2, F.size(part))).otherwise(part)
    return F.try_parse_url(site_url, F.lit("HOST")), F.try_element_at(rest, F.lit(-1))


def workday_detail(site_url: Column, path: Column) -> Column:
    """A posting's page: its path if that is a URL, else the site, its locale and slug, and the path."""
    host, slug = _site(site_url)
    first = F.regexp_extract(F.coalesce(F.try_parse_url(site_url, F.lit("PATH")), F.lit("")), "^/+([a-z]{2}-[A-Z]{2})(?:/|$)", 1)
    base = F.concat(F.try_parse_url(site_url, F.lit("PROTOCOL")), F.lit("://"), host, F.lit("/"), F.when(first != "", first).otherwise("en-US"), F.lit("/"), slug)
    p = F.coalesce(text.trimmed(path), F.lit(""))
    return F.when(p == "", base).when(p.rlike("^https?://"), p).when(p.startswith("/"), F.concat(base, p)).otherwise(F.concat(base, F.lit("/"), p))


def workable_company(source_url: Column) -> Column:
    """The last path part behind jobs-at-, else the first part unless it is 'company', else the host."""
    part = F.filter(F.split(F.coalesce(F.try_parse_url(source_url, F.lit("PATH")), F.lit("")), "/"), lambda p: p != "")
    named = F.try_element_at(F.filter(part, lambda p: p.startswith("jobs-at-")), F.lit(-1))
    first = F.get(part, F.lit(0))
    return F.coalesce(F.substring(named, 9, 1 << 30), F.when(first != "company", first), F.lower(F.coalesce(F.try_parse_url(source_url, F.lit("HOST")), F.lit(""))))
