"""Job boards: which one a URL belongs to, its canonical URL, slugs to try, and tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import trimmed

#: Boards told by the host alone, in order (fixed values).
BY_HOST = [("icims", ["icims.com"]), ("smartrecruiters", ["smartrecruiters.com"]), ("workable", ["workable.com"]), ("jobvite", ["jobvite.com"]), ("bamboohr", ["bamboohr.com"]), ("sap_successfactors", ["successfactors", "sapsf.com"]), ("oracle_cloud_recruiting", ["oraclecloud.com", "oraclecloudcloud.com"]), ("adp", ["adp.com", "workforcenow.adp.com"]), ("rippling", ["rippling.com"]), ("eightfold", ["eightfold.ai"]), ("avature", ["avature.net"])]


def board(url: Column) -> Column:
    """struct<provider, identifier>; null if no board is recognised."""
    host = F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")))
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    part = F.filter(F.split(path, "/"), lambda p: p != "")
    at = lambda k: F.coalesce(F.get(part, F.lit(k)), F.lit(""))
    third = lambda a, b: F.when((at(0) == a) & (at(1) == b), at(2)).otherwise("")
    none = F.lit("")
    greenhouse = F.when(host.isin("boards.greenhouse.io", "job-boards.greenhouse.io"), at(0)).when(host.contains("boards-api.greenhouse.io"), third("v1", "boards")).otherwise(none)
    lever = F.when(host == "jobs.lever.co", at(0)).when(host == "api.lever.co", third("v0", "postings")).otherwise(none)
    ashby = F.when(host == "jobs.ashbyhq.com", at(0)).when(host == "api.ashbyhq.com", third("posting-api", "job-board")).otherwise(none)
    locale = at(0).rlike("^[a-z]{2}-[A-Z]{2}$")
    slug = F.when(locale, at(1)).otherwise(at(0))
    workday = F.when(slug != "", F.concat(F.split_part(host, F.lit("."), F.lit(1)), F.lit("/"), slug)).otherwise(none)
    made = lambda provider, ident: F.struct(F.lit(provider).alias("provider"), ident.alias("identifier"))
    out = F.when(host.contains("greenhouse.io"), made("greenhouse", greenhouse)).when(host.contains("lever.co"), made("lever", lever)).when(host.contains("ashbyhq.com"), made("ashby", ashby))
    out = out.when(host.contains("jibeapply.com") | ((at(0) == "api") & (at(1) == "jobs")), made("icims", host))
    out = out.when(host.contains("myworkdayjobs.com") | host.contains("myworkdaysite.com"), made("workday", workday))
    for provider, hints in BY_HOST:
        any_of = F.lit(False)
        for h in hints:
            any_of |= host.contains(h)
        out = out.when(any_of, made(provider, none))
    return out


def entry_url(provider: Column, identifier: Column, url: Column) -> Column:
    """The canonical listing URL of a board; for iCIMS and Workday it is the recognised URL itself
    (a Workday one needs a site)."""
    token = F.url_encode(trimmed(identifier))
    for a, b in (("+", "%20"), ("%2F", "/"), ("*", "%2A"), ("%7E", "~")):
        token = F.replace(token, F.lit(a), F.lit(b))
    ok = trimmed(identifier) != ""
    return (
        F.when(ok & (provider == "greenhouse"), F.concat(F.lit("https://boards-api.greenhouse.io/v1/boards/"), token, F.lit("/jobs?content=true")))
        .when(ok & (provider == "lever"), F.concat(F.lit("https://api.lever.co/v0/postings/"), token, F.lit("?mode=json")))
        .when(ok & (provider == "ashby"), F.concat(F.lit("https://api.ashbyhq.com/posting-api/job-board/"), token, F.lit("?includeCompensation=true")))
        .when((provider == "icims") | (ok & (provider == "workday")), url)
    )


def probe_slugs(source_company: Column, website: Column, name: Column) -> Column:
    """Slugs to try, in order, none twice: the given one, the site's first label, the name with dashes and without."""
    host = F.lower(F.coalesce(F.try_parse_url(website, F.lit("HOST")), F.lit("")))
    # The letters w and dots are stripped from the left one by one, not as a prefix.
    label = F.split_part(F.regexp_replace(host, r"^[w.]+", ""), F.lit("."), F.lit(1))
    low = F.lower(name)
    made = F.array(F.lower(trimmed(source_company)), label, F.regexp_replace(F.regexp_replace(low, "[^a-z0-9]+", "-"), "^-+|-+$", ""), F.regexp_replace(low, "[^a-z0-9]+", ""))
    return F.array_distinct(F.filter(made, lambda s: s.isNotNull() & (s != "")))


_AMOUNT = r"\$?\s*([0-9][0-9,]*(?:\.[0-9]+)?)"


def salary(tags: Column) -> Column:
    """struct<min, mid, max, currency, period> of an array of tag texts, in order."""
    number = lambda s: F.replace(s, F.lit(","), F.lit("")).try_cast("double")
    priced = F.filter(tags, lambda t: t.rlike("[0-9]"))

    def labelled(pattern: str) -> Column:
        hits = F.filter(F.transform(priced, lambda t: F.regexp_extract(F.lower(t), rf"(?:{pattern})\s*{_AMOUNT}", 1)), lambda s: s != "")
        return number(F.try_element_at(hits, F.lit(-1)))

    loose = F.flatten(F.transform(F.filter(priced, lambda t: ~F.lower(t).rlike("min|mid(?=point)|max")), lambda t: F.regexp_extract_all(t, F.lit(_AMOUNT), F.lit(1))))
    least = F.coalesce(labelled("minimum|min"), number(F.get(loose, F.lit(0))))
    most = F.coalesce(labelled("maximum|max"), F.when(F.size(loose) >= 2, number(F.try_element_at(loose, F.lit(-1)))))
    some = lambda r: F.exists(priced, lambda t: F.lower(t).rlike(r))
    year = r"\b(yr|year|annual|annually)\b"
    hour = F.exists(priced, lambda t: F.lower(t).rlike(r"\b(hr|hour|hourly)\b") & ~F.lower(t).rlike(year))
    return F.struct(least.alias("min"), labelled("midpoint").alias("mid"), most.alias("max"), F.when(some(r"\$|usd"), F.lit("USD")).alias("currency"), F.when(hour, F.lit("hour")).when(some(year), F.lit("year")).alias("period"))


def workplace(text: Column) -> Column:
    t = F.lower(text)
    return F.when(t.rlike(r"\bhybrid\b"), "hybrid").when(t.rlike(r"\bremote\b|\bhome office\b"), "remote").when(t.rlike(r"\bon[- ]?site\b|\boffice location\b|\bin office\b"), "onsite")


def employment_time(text: Column) -> Column:
    t = F.lower(text)
    return F.when(t.rlike(r"\bfull[- ]?time\b"), "Full-Time").when(t.rlike(r"\bpart[- ]?time\b"), "Part-Time")
