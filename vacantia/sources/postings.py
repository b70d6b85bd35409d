"""Postings of six job boards, from raw JSON to one record shape.

Each board is a schema and a projection: JSON is parsed in the JVM, and only the
fields that are asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

#: The record that every board gives.
RECORD = ["source_type", "source_job_id", "title", "department", "location_name", "content_text", "job_url", "apply_url", "posted_at", "raw_json"]


def _first(*columns: Column) -> Column:
    return F.coalesce(*[text.blank_to_null(c) for c in columns])


def _names(items: Column) -> Column:
    """Distinct names of an array of structs, joined by bars."""
    return F.array_join(F.array_distinct(F.filter(F.transform(items, lambda i: text.trimmed(i["name"])), lambda n: n.isNotNull() & (n != ""))), " | ")


def _record(df: DataFrame, source: str, **columns: Column) -> DataFrame:
    columns = {"source_type": F.lit(source), "raw_json": F.col("raw_json")} | columns
    return df.select(*[columns.get(c, F.lit(None).cast("string")).cast("string").alias(c) for c in RECORD])


def _parsed(df: DataFrame, schema: str) -> DataFrame:
    return df.withColumn("j", F.from_json("raw_json", schema))


def greenhouse(df: DataFrame) -> DataFrame:
    """Id, else URL, else URL and title; departments and offices each once."""
    d = _parsed(df, "id string, title string, absolute_url string, content string, updated_at string, first_published string, location struct<name:string>, departments array<struct<name:string>>, offices array<struct<name:string>>")
    url = F.col("j.absolute_url")
    key = F.coalesce(_first(F.col("j.id")), _first(url), F.concat_ws(":", url, F.col("j.title")))
    return _record(d, "greenhouse", source_job_id=key, title=F.col("j.title"), department=_names(F.col("j.departments")), location_name=_first(F.col("j.location.name"), _names(F.col("j.offices"))), content_text=text.html_to_text(F.col("j.content")), job_url=url, apply_url=url, posted_at=_first(F.col("j.first_published"), F.col("j.updated_at")))


def ashby(df: DataFrame) -> DataFrame:
    """The plain description, else the stripped one; secondary locations joined."""
    d = _parsed(df, "id string, title string, department string, location string, secondaryLocations array<struct<location:string>>, descriptionPlain string, descriptionHtml string, jobUrl string, applyUrl string, publishedAt string")
    more = F.transform(F.col("j.secondaryLocations"), lambda s: s["location"])
    place = F.array_join(F.array_distinct(F.filter(F.concat(F.array("j.location"), F.coalesce(more, F.array().cast("array<string>"))), lambda s: s.isNotNull() & (s != ""))), " | ")
    return _record(d, "ashby", source_job_id=_first(F.col("j.id"), F.col("j.jobUrl")), title=F.col("j.title"), department=F.col("j.department"), location_name=place, content_text=F.coalesce(_first(F.col("j.descriptionPlain")), text.html_to_text(F.col("j.descriptionHtml"))), job_url=F.col("j.jobUrl"), apply_url=F.col("j.applyUrl"), posted_at=F.col("j.publishedAt"))


def lever(df: DataFrame) -> DataFrame:
    """Opening, description, body, lists and additional text joined; times from milliseconds."""
    d = _parsed(df, "id string, text string, categories struct<team:string,department:string,location:string>, openingPlain string, descriptionPlain string, descriptionBodyPlain string, additionalPlain string, lists array<struct<text:string,content:string>>, hostedUrl string, applyUrl string, createdAt bigint")
    lists = F.array_join(F.transform(F.col("j.lists"), lambda s: F.concat_ws("\n", s["text"], text.html_to_text(s["content"]))), "\n\n")
    parts = [_first(c) for c in (F.col("j.openingPlain"), F.col("j.descriptionPlain"), F.col("j.descriptionBodyPlain"), lists, F.col("j.additionalPlain"))]
    at = F.date_format(F.timestamp_seconds(F.floor(F.col("j.createdAt") / 1000)), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    return _record(d, "lever", source_job_id=F.col("j.id"), title=F.col("j.text"), department=_first(F.col("j.categories.department"), F.col("j.categories.team")), location_name=F.col("j.categories.location"), content_text=F.concat_ws("\n\n", *parts), job_url=F.col("j.hostedUrl"), apply_url=F.col("j.applyUrl"), posted_at=at)


def icims(df: DataFrame) -> DataFrame:
    """Three HTML sections; a place from its parts; tags (tags1, tags2, ...) as one text."""
    d = _parsed(df, "data struct<slug:string,req_id:string,title:string,description:string,responsibilities:string,qualifications:string,city:string,state:string,country:string,location_name:string,posted_date:string,apply_url:string,categories:array<struct<name:string>>>")
    parts = [text.html_to_text(F.col(f"j.data.{c}")) for c in ("description", "responsibilities", "qualifications")]
    place = F.coalesce(_first(F.col("j.data.location_name")), _first(F.concat_ws(", ", *[_first(F.col(f"j.data.{c}")) for c in ("city", "state", "country")])))
    return _record(d, "icims", source_job_id=_first(F.col("j.data.req_id"), F.col("j.data.slug")), title=F.col("j.data.title"), department=_names(F.col("j.data.categories")), location_name=place, content_text=F.concat_ws("\n\n", *parts), job_url=F.col("j.data.apply_url"), apply_url=F.col("j.data.apply_url"), posted_at=F.col("j.data.posted_date"))


def icims_tags(raw: Column) -> Column:
    """The values of tags1, tags2, ... in numeric order."""
    entries = F.map_entries(F.from_json(F.get_json_object(raw, "$.data"), "map<string,string>"))
    tags = F.filter(entries, lambda e: e["key"].rlike(r"^tags\d+$"))
    ordered = F.array_sort(F.transform(tags, lambda e: F.struct(F.regexp_extract(e["key"], r"\d+", 0).cast("int").alias("n"), e["value"].alias("v"))))
    return F.transform(ordered, lambda t: t["v"])


def workable(df: DataFrame) -> DataFrame:
    """Published jobs: three sections; city, region and country."""
    d = _parsed(df, "id string, shortcode string, title string, department string, state string, published string, location struct<city:string,subregion:string,region:string,country:string>, description string, requirements string, benefits string, url string, application_url string")
    d = d.filter(F.coalesce(F.col("j.state"), F.lit("published")) == "published")
    place = F.concat_ws(", ", _first(F.col("j.location.city")), _first(F.col("j.location.subregion"), F.col("j.location.region")), _first(F.col("j.location.country")))
    parts = [text.html_to_text(F.col(f"j.{c}")) for c in ("description", "requirements", "benefits")]
    return _record(d, "workable", source_job_id=_first(F.col("j.shortcode"), F.col("j.id")), title=F.col("j.title"), department=F.col("j.department"), location_name=text.blank_to_null(place), content_text=F.concat_ws("\n\n", *parts), job_url=F.col("j.url"), apply_url=_first(F.col("j.application_url"), F.col("j.url")), posted_at=F.col("j.published"))


def workday(df: DataFrame, stored: str | None = None) -> DataFrame:
    """A summary and, if fetched, its details, over the row stored before (a struct column, if there is one).

    Details win over the summary, and that over the stored row; but the place is the summary's
    first, and a posting that is stored keeps its id."""
    d = _parsed(df, "summary struct<title:string,locationsText:string,externalPath:string,postedOn:string>, detail struct<title:string,description:string,datePosted:string,identifier:struct<value:string>,url:string,location:string>")
    old = lambda c: F.col(f"{stored}.{c}") if stored else F.lit(None).cast("string")
    said, seen = (lambda c: F.col(f"j.detail.{c}")), (lambda c: F.col(f"j.summary.{c}"))
    url = _first(said("url"), seen("externalPath"))
    body = text.blank_to_null(text.html_to_text(said("description")))
    return _record(d, "workday", source_job_id=_first(old("source_job_id"), F.col("j.detail.identifier.value"), seen("externalPath")), title=_first(said("title"), seen("title"), old("title")), location_name=_first(seen("locationsText"), said("location"), old("location_name")), content_text=F.coalesce(body, old("content_text")), job_url=url, apply_url=url, posted_at=_first(said("datePosted"), seen("postedOn"), old("posted_at")))


def json_ld_posting(html: Column) -> Column:
    """The first ld+json script that has a JobPosting, itself or in its @graph or list, as JSON text."""
    scripts = F.regexp_extract_all(html, F.lit(r'(?is)<script[^>]*type="application/ld\+json"[^>]*>(.*?)</script>'), F.lit(1))
    hit = F.filter(scripts, lambda s: s.contains("JobPosting"))
    raw = F.get(hit, F.lit(0))
    listed = F.coalesce(F.from_json(F.get_json_object(raw, "$.@graph"), "array<string>"), F.when(F.ltrim(raw).startswith("["), F.from_json(raw, "array<string>")), F.array(raw))
    return F.get(F.filter(listed, lambda s: F.coalesce(F.get_json_object(s, "$.@type"), F.lit("")).contains("JobPosting")), F.lit(0))
