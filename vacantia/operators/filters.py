"""Hard filters as predicates; Catalyst merges them and pushes them to the scan."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import places
from ..functions.text import collapsed, trimmed

#: Text that does not stand for a clearance (fixed values).
FALSY = ("", "false", "0", "no", "none", "null", "nan")
#: Country names and their codes (fixed values).
COUNTRIES = {"united states": "US", "usa": "US", "us": "US", "u.s.": "US", "u.s.a.": "US", "united states of america": "US", "america": "US", "canada": "CA", "united kingdom": "GB", "uk": "GB", "great britain": "GB", "england": "GB", "india": "IN", "germany": "DE", "france": "FR", "spain": "ES", "italy": "IT", "netherlands": "NL", "ireland": "IE", "australia": "AU", "japan": "JP", "brazil": "BR", "mexico": "MX", "singapore": "SG", "poland": "PL", "sweden": "SE", "switzerland": "CH", "israel": "IL", "china": "CN"}


def required(df: DataFrame, *columns: str) -> DataFrame:
    """df, if it has the columns; else an error that names those it lacks."""
    if lacking := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(lacking)}")
    return df


def within_experience(df: DataFrame, most: float | None, column: str = "min_years_experience") -> DataFrame:
    """Rows that ask for at most so many years; unknown or unreadable years pass; None keeps all."""
    required(df, column)
    if most is None:
        return df
    years = F.col(column).cast("string").try_cast("double")
    return df.filter(years.isNull() | F.isnan(years) | (years <= most))


def truthy(c: Column) -> Column:
    return F.coalesce(~F.lower(collapsed(c.cast("string"))).isin(*FALSY), F.lit(False))


def without_clearance(df: DataFrame, columns: tuple[str, ...] = ("requires_clearance", "clearance_type", "clearance_evidence_text", "security_clearance")) -> DataFrame:
    """Rows in which none of the clearance columns there are says yes."""
    there = [truthy(F.col(c)) for c in columns if c in df.columns]
    return df.filter(~reduce(lambda a, b: a | b, there)) if there else df


def recent(df: DataFrame, now: Column, hours: int = 48, column: str = "posted_at_utc") -> DataFrame:
    """Rows posted in the last hours, both ends included; without the column, none."""
    if column not in df.columns:
        return df.limit(0)
    return df.filter(F.col(column).between(now - F.make_dt_interval(F.lit(0), F.lit(hours)), now))


def _written(name: str | None) -> str:
    return " ".join((name or "").lower().split())


def country_code(name: str | None) -> str | None:
    """The two-letter code that a query's country stands for."""
    key, letters = _written(name), re.sub("[^A-Za-z]", "", name or "").upper()
    if len(letters) == 2 and letters in {*COUNTRIES.values(), *places.COUNTRY_CODES.values()}:
        return letters
    if key in places.US_KEYS:
        return "US"
    spelled = {a: places.COUNTRY_CODES[c] for c, names in places.COUNTRY_ALIASES.items() for a in names}
    return places.COUNTRY_CODES.get(key) or spelled.get(key) or COUNTRIES.get(key)


def state_names(state: str) -> tuple[str, str]:
    """Name and code, in lower case, of a state given by either; another text has no code."""
    codes = {n.lower(): c.lower() for c, n in places.US_STATES.items()}
    key, letters = _written(state), re.sub("[^A-Za-z]", "", state).lower()
    if key in codes:
        return key, codes[key]
    return next(((n, c) for n, c in codes.items() if c == letters), (key, ""))


def _word(names: list[str]) -> str:
    return "(?<![a-z])(?:" + "|".join(re.escape(n) for n in names) + ")(?![a-z])"


def _code(codes: list[str]) -> str:
    return r"(?:^|[\s,;:/()\-])(?:" + "|".join(codes) + r")(?:$|[\s,;:/()\-])"


def written_segments(location: Column) -> Column:
    """The parts of a location as written, in lower case; those that name no place are left out."""
    t = F.translate(F.lower(trimmed(location)), "\u2013\u2014_()[]{}", "--       ")
    t = collapsed(F.replace(F.replace(t, F.lit("/"), F.lit(" / ")), F.lit("|"), F.lit(" ; ")))
    parts = F.transform(F.split(t, r"\s*;\s*"), lambda s: F.regexp_replace(s, "^[ ,;-]+|[ ,;-]+$", ""))
    return F.filter(parts, lambda s: ~s.isin(*places.NO_PLACE))


def _said(location: Column, pattern: str) -> Column:
    return F.coalesce(F.exists(written_segments(location), lambda s: s.rlike(pattern)), F.lit(False))


def text_in_country(location: Column, name: str | None) -> Column:
    """Whether a location as written is in a country: by the country's spellings, and for the United
    States by its terms, states, their codes and large cities. No country: all; no location: not."""
    key = _written(name)
    if not key:
        return F.lit(True)
    if country_code(name) != "US":
        return _said(location, _word(list(places.COUNTRY_ALIASES.get(key, (key,)))))
    states = places.US_STATES.items()
    return _said(location, "|".join([_word([*places.US_TERMS, *(n.lower() for _, n in states), *places.US_CITIES]), _code([c.lower() for c, _ in states])]))


def text_in_state(location: Column, state: str) -> Column:
    """Whether a location as written names a state of the United States, in full or by its code."""
    name, code = state_names(state)
    return _said(location, "|".join([_word([name]), *([_code([code])] if code else [])]))


def _upper(c: Column) -> Column:
    return F.nullif(F.upper(trimmed(c)), F.lit(""))


def in_country(segments: Column, country: Column, text: Column, name: str | None, state: str | None = None, region: Column | None = None) -> Column:
    """Structured segments first, then the country and region columns, then the text; no country: all.

    state (a name or code) holds only for the United States, or where no country is asked for."""
    out, code = F.lit(True), country_code(name)
    if _written(name):
        of = F.array_compact(F.transform(segments, lambda s: _upper(s["country"])))
        if code:
            known = F.when(F.size(of) > 0, F.array_contains(of, code)).when(_upper(country).isNotNull(), _upper(country) == code)
            out &= F.coalesce(known, text_in_country(text, name))
        else:
            out &= text_in_country(text, name)
    if _written(state) and (not _written(name) or code == "US"):
        letters = state_names(state)[1].upper()
        regions = F.array_compact(F.transform(F.filter(segments, lambda s: _upper(s["country"]) == "US"), lambda s: _upper(s["region"])))
        known = F.when(F.size(regions) > 0, F.array_contains(regions, letters))
        if region is not None:
            known = known.when((_upper(country) == "US") & _upper(region).isNotNull(), _upper(region) == letters)
        out &= F.coalesce(known, text_in_state(text, state)) if letters else text_in_state(text, state)
    return out


def existing(df: DataFrame, wanted: list[str], needed: list[str] = ()) -> DataFrame:
    """Those of the wanted columns that df has, in their order; one that is needed and lacking raises."""
    required(df, *needed)
    return df.select(*[c for c in wanted if c in df.columns])
