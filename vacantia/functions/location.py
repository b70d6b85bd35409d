"""Locations as written, looked up in a table of places.

A written form is cut into segments and tokens by expressions, every token is joined with the
table of places by its key (letters and digits; case and accents are the collation's), and the
hits of a segment are aggregated into country and region. The table is a parameter: what is
bundled knows countries by name, the subdivisions of four countries and the cities that postings
name most; places it lacks are 'ambiguous'."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.filters import COUNTRIES
from ..session import small, stored
from .places import US_STATES as US

#: Subdivisions by country: code and name (fixed values of ISO 3166-2).
CA = {
    "AB": "Alberta", "BC": "British Columbia", "MB": "Manitoba", "NB": "New Brunswick", "NL": "Newfoundland and Labrador",
    "NS": "Nova Scotia", "ON": "Ontario", "PE": "Prince Edward Island", "QC": "Quebec", "SK": "Saskatchewan",
}
GB = {
    "ENG": "England", "NIR": "Northern Ireland", "SCT": "Scotland", "WLS": "Wales",
}
AU = {
    "ACT": "Australian Capital Territory", "NSW": "New South Wales", "NT": "Northern Territory", "QLD": "Queensland", "SA": "South Australia",
    "TAS": "Tasmania", "VIC": "Victoria", "WA": "Western Australia",
}
#: Cities: name, country and, in the United States, state; of one name, the largest.
CITIES = [
    ("Boston", "US", "MA"), ("London", "GB", ""), ("Stockholm", "SE", ""), ("Paris", "FR", ""), ("Berlin", "DE", ""), ("Munich", "DE", ""),
    ("Madrid", "ES", ""), ("Barcelona", "ES", ""), ("Rome", "IT", ""), ("Milan", "IT", ""), ("Amsterdam", "NL", ""), ("Dublin", "IE", ""),
    ("Toronto", "CA", ""), ("Montreal", "CA", ""), ("Vancouver", "CA", ""), ("Sydney", "AU", ""), ("Melbourne", "AU", ""), ("Tokyo", "JP", ""),
    ("Singapore", "SG", ""), ("Bangalore", "IN", ""), ("Bengaluru", "IN", ""), ("Mumbai", "IN", ""), ("Hyderabad", "IN", ""), ("Tel Aviv", "IL", ""),
    ("Zurich", "CH", ""), ("Warsaw", "PL", ""), ("Mexico City", "MX", ""), ("Sao Paulo", "BR", ""), ("New York", "US", "NY"), ("San Francisco", "US", "CA"),
    ("Los Angeles", "US", "CA"), ("Seattle", "US", "WA"), ("Austin", "US", "TX"), ("Chicago", "US", "IL"), ("Denver", "US", "CO"), ("Atlanta", "US", "GA"),
    ("Dallas", "US", "TX"), ("Houston", "US", "TX"), ("Philadelphia", "US", "PA"), ("San Diego", "US", "CA"), ("San Jose", "US", "CA"), ("Portland", "US", "OR"),
    ("Miami", "US", "FL"), ("Phoenix", "US", "AZ"), ("Minneapolis", "US", "MN"), ("Detroit", "US", "MI"), ("Nashville", "US", "TN"), ("Raleigh", "US", "NC"),
    ("Pittsburgh", "US", "PA"), ("Shanghai", "CN", ""), ("Beijing", "CN", ""),
]
MORE_COUNTRIES = {"south korea": "KR", "korea": "KR", "hong kong": "HK", "the netherlands": "NL", "saudi arabia": "SA", "czech republic": "CZ", "brasil": "BR", "portugal": "PT", "belgium": "BE", "austria": "AT", "denmark": "DK", "norway": "NO", "finland": "FI", "greece": "GR", "turkey": "TR", "philippines": "PH", "south africa": "ZA", "new zealand": "NZ", "argentina": "AR", "chile": "CL", "colombia": "CO", "romania": "RO", "ukraine": "UA", "vietnam": "VN", "thailand": "TH", "indonesia": "ID", "malaysia": "MY", "taiwan": "TW", "egypt": "EG", "nigeria": "NG", "kenya": "KE", "democratic republic of the congo": "CD"}

#: Countries whose subdivisions are told without the country, in the order they are tried.
SUBDIVIDED = {"US": US, "CA": CA, "GB": GB, "AU": AU}
MORE_REGIONS = [("mass", "US", "MA"), ("washington dc", "US", "DC"), ("washington d c", "US", "DC"), ("d c", "US", "DC")]
#: Codes of two letters that name a subdivision, so no country.
STATE_CODES = sorted({c for listed in SUBDIVIDED.values() for c in listed if len(c) == 2})

# Patterns that Java and RE2 read alike, so that SQL can repeat them.
HYBRID = r"(?i)\bhybrid\b"
REMOTE = r"(?i)\b(remote(ly)?|work\s+from\s+home|wfh|virtual|anywhere|worldwide)\b"
ONSITE = r"(?i)\b(on[-\s]?site|in[-\s]?office|office[-\s]?based)\b"
NOISE = r"(?i)\b(multiple\s+locations?|locations?|based|role|position|job|offices?|remote(ly)?|hybrid|on[-\s]?site|in[-\s]office|work\s+from\s+home|wfh|virtual|hq|global|area|airport)\b"
BETWEEN = r"(?i)\s*(?:\||;|\n|\t|/|\s+or\s+|\s+-\s+)\s*"
LABEL = r"(?i)^\s*(multiple\s+)?locations?\s*:\s*"
COUNTED = r"(?i)^\d+\s+locations?$"
PAIR = r"\b[A-Za-z]{2}-[A-Za-z]{2,3}\b"
CODE_LAST = rf"(?i)^(.+)[- ]({'|'.join(STATE_CODES)})$"
CODE_FIRST = rf"(?i)^({'|'.join(STATE_CODES)}) (.+)$"
POSTCODE = r"\s+\d{4,5}(-\d{4})?$"
NO_KEY = r"[^\p{L}\p{N}\p{M}]+"

RESULTS = ("location_country", "location_region", "location_segments", "work_arrangement", "location_parse_status")


def entries() -> list[tuple]:
    """The bundled table of places: kind, name, country, region and population (null: not known)."""
    countries = {n: c for n, c in (COUNTRIES | MORE_COUNTRIES).items() if n != "england"}
    rows = [("country", n, c, None, None) for n, c in countries.items()] + [("country", "u.k.", "GB", None, None)]
    rows += [("code", c, c, None, None) for c in sorted(set(countries.values())) if c not in STATE_CODES]
    for country, listed in SUBDIVIDED.items():
        for code, name in listed.items():
            rows += [("region", name, country, code, None), ("region", code, country, code, None), ("pair", f"{country}-{code}", country, code, None)]
    rows += [("region", n, c, r, None) for n, c, r in MORE_REGIONS]
    return rows + [("city", n, c, r or None, None) for n, c, r in CITIES]


def places(spark: SparkSession, cities: DataFrame | None = None) -> DataFrame:
    """The bundled places and those of cities (name, country, region, population), as one table."""
    columns = [pa.array(c, t) for c, t in zip(zip(*entries(), strict=True), [pa.string()] * 4 + [pa.int64()], strict=True)]
    # From Arrow it is a local relation, whose size the optimizer knows.
    bundled = spark.createDataFrame(pa.table(columns, ["kind", "name", "country", "region", "population"]))
    return bundled if cities is None else bundled.unionByName(cities.select(F.lit("city").alias("kind"), "name", "country", "region", F.col("population").cast("long")))


def key(name: Column) -> Column:
    """Letters and digits alone, equal whatever their case and accents."""
    return F.collate(F.btrim(F.regexp_replace(name, NO_KEY, F.lit(" "))), "UNICODE_CI_AI")


def _by_key(known: DataFrame) -> DataFrame:
    """One row a key: country by name, country by code, region in each subdivided country, region by
    pair, and the city: of one name, the most populous (ties: the first country and region)."""
    of = lambda kind, value: F.min(F.when(F.col("kind") == kind, value))
    place = F.struct("country", "region")
    order = F.when(F.col("kind") == "city", F.struct(-F.coalesce("population", F.lit(0)), F.col("country"), F.coalesce("region", F.lit(""))))
    regions = [of("region", F.when(F.col("country") == c, F.col("region"))).alias(f"in_{c}") for c in SUBDIVIDED]
    keyed = known.withColumn("key", key(F.col("name"))).filter("key <> ''")
    return keyed.groupBy("key").agg(of("country", F.col("country")).alias("named"), of("code", F.col("country")).alias("coded"), *regions, of("pair", place).alias("pair"), F.min_by(place, order).alias("city"))


def _strip(c: Column, chars: str) -> Column:
    return F.btrim(c, F.lit(chars))


def _text(written: Column) -> Column:
    return _strip(F.translate(written, "\u2013\u2014\u00a0", "-- "), " \t\r\n")


def _body(written: Column) -> Column:
    return _strip(F.regexp_replace(F.regexp_replace(_text(written), "_+", ", "), LABEL, ""), " ,-")


def _quiet(part: Column) -> Column:
    """A part without the words that name no place."""
    return _strip(F.regexp_replace(F.regexp_replace(part, NOISE, " "), r"\s+", " "), " ,-")


def _spelled(part: Column) -> Column:
    """Boston-MA, Austin TX and WI Marshfield as a city, a comma and a code."""
    last, first = F.regexp_replace(part, CODE_LAST, "$1, $2"), F.regexp_replace(part, CODE_FIRST, "$2, $1")
    return F.when(F.contains(part, F.lit(",")), part).when(part.rlike(CODE_LAST), last).otherwise(first)


def _tokens(part: Column) -> Column:
    edge = " .:-"
    cut = F.transform(F.split(part, "[(),]"), lambda t: _strip(F.regexp_replace(_strip(t, edge), POSTCODE, ""), edge))
    return F.filter(cut, lambda t: t != "")


def arrangement(written: Column) -> Column:
    """hybrid, remote or onsite, by the words of a location as written; else null."""
    t = _text(written)
    return F.when(t.rlike(HYBRID), "hybrid").when(t.rlike(REMOTE), "remote").when(t.rlike(ONSITE), "onsite")


def _segments(written: DataFrame, known: DataFrame) -> DataFrame:
    """_written, country, region, the first place i of the pair, and whether a city told it."""
    w = F.col("_written")
    parts = F.filter(F.transform(F.split(_body(w), BETWEEN), lambda p: _strip(p, " ,-")), lambda p: p != "")
    p = written.select(w, F.posexplode_outer(parts).alias("i", "part")).withColumn("part", _quiet(F.col("part")))
    p = p.withColumns({"pairs": F.regexp_extract_all("part", F.lit(PAIR), F.lit(0)), "plain": _spelled(F.col("part"))}).withColumn("tokens", _tokens(F.col("plain")))
    role = lambda name: lambda x: F.struct(F.lit(name).alias("role"), x.alias("token"))
    seen = F.concat(F.transform("pairs", role("pair")), F.transform("tokens", role("token")), F.transform(F.array("plain"), role("whole")))
    t = p.select("_written", "i", F.size("tokens").alias("n"), F.posexplode_outer(seen).alias("k", "x")).select("_written", "i", "n", "k", "x.role", key(F.col("x.token")).alias("key"))
    # No hint: the table of places is broadcast if its size allows, else joined by key.
    t = t.join(_by_key(known), "key", "left").withColumn("letters", F.length(F.col("key").cast("string")))

    def first(value: Column, condition: Column, order: Column = F.col("k")) -> Column:
        return F.min_by(value, F.when(condition, order))

    token, alone = F.col("role") == "token", F.col("n") == 1
    named, coded, city = F.col("named"), F.col("coded"), F.col("city").isNotNull()
    regions = {c: F.col(f"in_{c}") for c in SUBDIVIDED}
    some = F.coalesce(*[F.when(r.isNotNull(), F.struct(F.lit(c).alias("country"), r.alias("region"))) for c, r in regions.items()])
    g = t.groupBy("_written", "i").agg(
        first(F.col("pair"), (F.col("role") == "pair") & F.col("pair").isNotNull()).alias("pair"),
        F.coalesce(first(F.coalesce(named, coded), (F.col("role") != "pair") & (named.isNotNull() | (alone & coded.isNotNull()))), first(coded, token & (F.col("letters") == 2) & coded.isNotNull())).alias("land"),
        *[first(r, token & r.isNotNull()).alias(f"in_{c}") for c, r in regions.items()],
        first(some, token & some.isNotNull() & ((F.col("n") > 1) | ((F.col("letters") > 3) & ~city))).alias("region"),
        first(F.col("city"), (F.col("role") != "pair") & city, F.when(F.col("role") == "whole", -1).otherwise(F.col("k"))).alias("city"),
    )
    own = F.coalesce(*[F.when(F.col("land") == c, F.col(f"in_{c}")) for c in SUBDIVIDED])
    land = F.when(F.col("land").isNotNull(), F.struct(F.col("land").alias("country"), own.alias("region")))
    g = g.select("_written", "i", F.coalesce("pair", land, "region", "city").alias("at"), (F.coalesce("pair", land, "region").isNull() & F.col("city").isNotNull()).alias("by_city"))
    return g.groupBy("_written", F.col("at.country").alias("country"), F.col("at.region").alias("region")).agg(F.min("i").alias("i"), F.max("by_city").alias("by_city"))


def parse_locations(df: DataFrame, column: str, known: DataFrame | None = None) -> DataFrame:
    """df with location_country, location_region, location_segments, work_arrangement and location_parse_status.

    Every written form is parsed once: a shuffle by the form serves all steps. The results are stored and
    joined with the rows: few of them go to every task, so that rows with a frequent form are not dealt to
    one; many are joined by form, where adaptive execution can split such a partition. known is a table of places as `places` gives it. Null and blank forms are
    'missing'; results of an earlier run are replaced."""
    df = df.drop(*RESULTS).withColumn("_written", F.coalesce(F.col(column), F.lit("")))
    w = F.col("_written")
    found = _segments(df.select("_written").distinct(), places(df.sparkSession) if known is None else known)
    place = F.when(F.col("country").isNotNull(), F.struct("i", "country", "region"))
    found = found.groupBy("_written").agg(F.sort_array(F.collect_list(place)).alias("at"), F.coalesce(F.max(F.when(F.col("country").isNotNull(), F.col("by_city"))), F.lit(False)).alias("by_city"))
    none = (_text(w) == "") | _text(w).rlike(COUNTED)
    first, several = F.get("at", F.lit(0)), F.size("at") > 1
    status = (
        F.when(_text(w) == "", "missing").when(none, "unparseable").when(arrangement(w) == "remote", "remote").when(F.col("by_city"), "city_resolved").when(several, "multi_location")
        .when(first["region"].isNotNull(), "parsed").when(first.isNotNull(), "country_only").when(_quiet(_body(w)).rlike(r"[\p{IsLatin}0-9]"), "ambiguous").otherwise("unparseable")
    )
    unknown = F.array(F.struct(F.lit(None).cast("string").alias("country"), F.lit(None).cast("string").alias("region")))
    segments = F.transform("at", lambda s: F.struct(s["country"].alias("country"), s["region"].alias("region")))
    segments = F.when(none, F.slice(unknown, 1, 0)).when(F.size("at") == 0, unknown).otherwise(segments)
    values = (F.when(~none, first["country"]), F.when(~none, first["region"]), segments, arrangement(w), status)
    found = found.select("_written", *[v.alias(n) for n, v in zip(RESULTS, values, strict=True)])
    return df.join(small(stored(found, "locations")), "_written").drop("_written")
