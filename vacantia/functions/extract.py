"""Extractors of experience, clearance and requirements as column expressions.

Each text becomes an array of sentences; each rule a test or capture on a sentence;
the first hit in (sentence, rule) order wins, as an array filter and its first item."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import collapsed, first_of_each, let, normalized, trimmed

_N = r"(\d+(?:\.\d+)?)"
_Y = r"(?:years?|yrs?)"
#: Rules for years of experience, in order (fixed values). The first has a range.
YEARS = [
    rf"(?i){_N}\s*(?:-|to|–|—)\s*{_N}\s*\+?\s*{_Y}",
    rf"(?i)(?:minimum|min\.?)\s+(?:of\s+)?{_N}\s*\+?\s*{_Y}",
    rf"(?i)at\s+least\s+{_N}\s*\+?\s*{_Y}",
    rf"(?i)requires?\s+(?:at\s+least\s+)?{_N}\s*\+?\s*{_Y}",
    rf"(?i){_N}\s*\+?\s*{_Y}\s+of\s+(?:relevant\s+|related\s+|professional\s+|industry\s+|work\s+|hands[-\s]?on\s+|clinical\s+practice\s+|product\s+management\s+)?experience",
    rf"(?i){_N}\s*\+?\s*{_Y}\s+(?:of\s+)?(?:clinical\s+practice|product\s+management|account\s+management|relationship\s+management|partnership\s+development|leadership|engineering|sales|marketing|operations)?\s*experience",
    rf"(?i){_N}\s*\+?\s*{_Y}\s+(?:in|with)\b",
    rf"(?i){_N}\s*\+?\s*{_Y}\s+(?:required|preferred)",
    rf"(?i){_N}\s*(?:or\s+more|or\s+more\s+years)\b",
]
_SENTENCE = r"(?<=[.!?])\s+|\n+|\s*[;•]\s*"
#: What `collapsed` would change.
_UNTIDY = r"[^\S ]|(?:^|\s)\s|\s$"
YEARS_CUES = ["experience", "required", "preferred", "minimum", "at least", "requirement", "qualification", "practice", "management", "leadership", "with ", " in "]

#: Clearances, in order (fixed values).
CLEARANCES = {
    "TS/SCI with Polygraph": r"(?i)\b(?:ts\s*/\s*sci|top secret\s*/\s*sci)\b[^.\n;]{0,80}\bpoly(?:graph)?\b",
    "Top Secret with Polygraph": r"(?i)\btop secret\b[^.\n;]{0,80}\bpoly(?:graph)?\b",
    "TS/SCI": r"(?i)\b(?:ts\s*/\s*sci|top secret\s*/\s*sci)\b",
    "Top Secret": r"(?i)\b(?:top secret|ts)\s+(?:security\s+)?clearance\b",
    "Secret": r"(?i)\bsecret\s+(?:security\s+)?clearance\b",
    "SCI": r"(?i)\bsci\b",
    "Polygraph": r"(?i)\bpoly(?:graph)?\b",
    "Public Trust": r"(?i)\bpublic trust\b",
    "Ability to Obtain Clearance": r"(?i)\b(?:(?:ability|eligible|eligibility)\s+to\s+obtain|able\s+to\s+obtain)\b[^.\n;]{0,80}\bclearance\b",
    "Security Clearance": r"(?i)\b(?:security clearance|active clearance|current clearance|u\.?s\.?\s+government clearance)\b",
}
CLEARANCE_CONTEXT = r"(?i)\b(?:clearance|security clearance|public trust|polygraph|ts\s*/\s*sci|top secret|secret clearance|sci)\b"
NO_CLEARANCE = r"(?i)\b(?:no|not|without)\s+(?:security\s+)?clearance\s+(?:required|needed|necessary)\b"

#: Headings that open and close a section of requirements (fixed values).
OPENING = ["requirements?", "qualifications?", "minimum qualifications?", "basic qualifications?", "preferred qualifications?", "nice to have", "nice-to-have", "what you'll need", "what you will need", "what we're looking for", "what we are looking for", "who you are", "about you", "you have", "skills(?: and experience)?", "experience(?: and skills)?", "candidate profile", "desired skills", "preferred skills", "must have"]
CLOSING = ["responsibilities?", "what you'll do", "what you will do", "about the role", "about us", "benefits?", "compensation", "salary", "equal opportunity", "eeo", "legal", "privacy", "application", "how to apply", "work environment", "location"]
#: Cues and noise of requirement sentences (fixed values).
CUES = [r"\b\d+\+?\s*(?:years|yrs)\b", r"\bexperience with\b", r"\bexperience in\b", r"\bexperience working with\b", r"\bproficiency in\b", r"\bproficient in\b", r"\bfamiliarity with\b", r"\bknowledge of\b", r"\bunderstanding of\b", r"\bbackground in\b", r"\bdegree in\b", r"\bbachelor's\b", r"\bmaster's\b", r"\bph\.?d\.?\b", r"\bmust have\b", r"\brequired\b", r"\bpreferred\b", r"\bstrong\b.*\bskills\b", r"\bexcellent\b.*\bskills\b", r"\bability to\b", r"\bable to\b", r"\bcomfortable with\b", r"\bhands-on\b", r"\bexpertise in\b", r"\bworking knowledge of\b"]
NOISE = [r"\bequal opportunity\b", r"\beeoc?\b", r"\bwe are an equal\b", r"\bbenefits\b", r"\bmedical\b", r"\bdental\b", r"\bvision\b", r"\b401k\b", r"\bpaid time off\b", r"\bcompensation\b", r"\bsalary range\b", r"\bprivacy policy\b", r"\baccommodation\b", r"\bbackground check\b"]
#: Whole requirements wherever they stand, in order (fixed values).
HARD = [
    r"(?i)(?:minimum of\s*)?\d+\+?\s*(?:years|yrs)\s+(?:of\s+)?(?:professional\s+)?experience[^.\n]*",
    r"(?i)(?:bachelor's|master's|ph\.?d\.?)[^.\n]*",
    r"(?i)(?:must be|ability to obtain|active|current)[^.\n]*(?:security clearance|clearance)[^.\n]*",
    r"(?i)(?:must be|authorized to|eligible to)[^.\n]*(?:work in|work for|employment in|united states|u\.s\.)[^.\n]*",
    r"(?i)(?:experience|proficiency|expertise|knowledge|familiarity|background)\s+(?:with|in|of)[^.\n]*",
]


def pieces(text: Column) -> Column:
    """The sentences of a text, collapsed, none empty."""
    tidy = lambda s: F.when(s.rlike(_UNTIDY), collapsed(s)).otherwise(s)
    return F.filter(F.transform(F.split(text, _SENTENCE), tidy), lambda s: s != "")


def _years_in(s: Column) -> Column:
    """The value of the first rule that holds in a sentence: 'a-b', 'n' or 'n+'."""
    def value(rule: str, k: int) -> Column:
        if k == 0:
            return F.concat(F.regexp_extract(s, rule, 1), F.lit("-"), F.regexp_extract(s, rule, 2))
        plus = F.when(F.regexp_extract(s, rule, 0).contains("+"), F.lit("+")).otherwise(F.lit(""))
        return F.concat(F.regexp_extract(s, rule, 1), plus)

    return F.coalesce(*[F.when(s.rlike(r), value(r, k)) for k, r in enumerate(YEARS)])


def _years_from(text: Column, sentences: Column) -> Column:
    """struct<value, evidence> of the first sentence of a text with a value, or null."""
    cue = lambda s: (F.lower(s).contains("year") | F.lower(s).contains("yrs")) & F.lower(s).rlike("|".join(YEARS_CUES))
    found = let(F.filter(sentences, cue), lambda x: F.when(F.size(x) > 0, x).otherwise(F.array(collapsed(text))))
    made = F.transform(found, lambda s: F.struct(_years_in(s).alias("value"), s.alias("evidence")))
    return F.get(F.filter(made, lambda x: x["value"].isNotNull()), F.lit(0))


def years_of_experience(content: Column, requirements: Column, sentences: Column | None = None) -> Column:
    """struct<raw, min_years, max_years, kind, evidence>: from the content, else the
    requirements, else any 'N+' in the requirements; all null if there is none.
    sentences: the pieces of the content, if they are there already."""
    sentences = pieces(content) if sentences is None else sentences
    plus = rf"{_N}\s*\+"
    fallback = F.transform(pieces(requirements), lambda s: F.struct(F.when(s.rlike(plus), F.concat(F.regexp_extract(s, plus, 1), F.lit("+"))).alias("value"), s.alias("evidence")))
    best = F.coalesce(_years_from(content, sentences), _years_from(requirements, pieces(requirements)), F.get(F.filter(fallback, lambda x: x["value"].isNotNull()), F.lit(0)))

    def described(found: Column) -> Column:
        value, low = found["value"], F.lower(found["evidence"])
        kind = F.when(low.rlike("required|must have|minimum|at least|requirement"), "required").when(low.rlike("preferred|nice to have|plus"), "preferred").when(value.isNotNull(), "unspecified")
        least = F.regexp_extract(value, r"^\d+(?:\.\d+)?", 0).try_cast("double")
        most = F.when(value.contains("-"), F.substring_index(value, "-", -1).try_cast("double"))
        return F.struct(value.alias("raw"), least.alias("min_years"), most.alias("max_years"), kind.alias("kind"), found["evidence"].alias("evidence"))

    return let(best, described)


def security_clearance(content: Column, requirements: Column, sentences: Column | None = None) -> Column:
    """struct<requires, kind, evidence> of the first sentence that names a clearance and does not negate it.
    sentences: the pieces of the content, if they are there already."""
    sentences = pieces(content) if sentences is None else sentences
    kind = lambda s: F.coalesce(*[F.when(s.rlike(r), F.lit(k)) for k, r in CLEARANCES.items()])
    every = F.concat(F.coalesce(sentences, F.array().cast("array<string>")), F.coalesce(pieces(requirements), F.array().cast("array<string>")))
    made = F.transform(F.filter(every, lambda s: s.rlike(CLEARANCE_CONTEXT) & ~s.rlike(NO_CLEARANCE)), lambda s: F.struct(kind(s).alias("kind"), F.substring(s, 1, 500).alias("evidence")))
    first = F.get(F.filter(made, lambda x: x["kind"].isNotNull()), F.lit(0))
    return let(first, lambda x: F.struct(x["kind"].isNotNull().alias("requires"), x["kind"].alias("kind"), x["evidence"].alias("evidence")))


def _any(patterns: list[str]) -> str:
    """A pattern that finds whichever of patterns, in any case. All begin at a word's edge, which is looked for
    once: most places in a text have none, and cost one step there, not one for each pattern."""
    edge = r"\b"
    assert all(p.startswith(edge) for p in patterns)
    return rf"(?i){edge}(?:{'|'.join(p.removeprefix(edge) for p in patterns)})"


def _bare(line: Column) -> Column:
    return F.regexp_replace(F.lower(trimmed(line)), r"^:+|:+$", "")


def is_heading(line: Column, names: list[str]) -> Column:
    return _is_heading(_bare(line), names)


def _is_heading(t: Column, names: list[str]) -> Column:
    return (F.length(t) <= 80) & trimmed(t).rlike("^(?:" + "|".join(names).replace("'", "(?:'|’)") + ")$")


def section_lines(text: Column) -> Column:
    """Lines that stand under an opening heading and before a closing one."""
    return _section_lines(normalized(text))


def _section_lines(normal: Column) -> Column:
    lines = F.filter(F.transform(F.split(normal, "\n"), trimmed), lambda s: s != "")
    start = F.struct(F.lit(False).alias("on"), F.array().cast("array<string>").alias("out"))
    # A line stands beside its bare form, which both tests of a heading read.
    pairs = F.transform(lines, lambda s: F.struct(s.alias("s"), _bare(s).alias("t")))

    def step(acc: Column, x: Column) -> Column:
        s = x["s"]
        return F.when(_is_heading(x["t"], OPENING), F.struct(F.lit(True).alias("on"), acc["out"].alias("out"))).when(_is_heading(x["t"], CLOSING), F.struct(F.lit(False).alias("on"), acc["out"].alias("out"))).otherwise(F.struct(acc["on"].alias("on"), F.when(acc["on"], F.concat(acc["out"], F.array(s))).otherwise(acc["out"]).alias("out")))

    return F.aggregate(pairs, start, step)["out"]


def units(text: Column) -> Column:
    """Lines split at bullets and hyphens; units of over 300 characters also at sentence ends."""
    return _units(normalized(text))


def _units(normal: Column) -> Column:
    lines = F.split(normal, "\n")
    parts = F.flatten(F.transform(lines, lambda s: F.split(s, r"\s*[-*•‣▪●]\s*")))
    long = F.flatten(F.transform(parts, lambda s: F.when(F.length(s) > 300, F.split(s, r"(?<=[.!?])\s+")).otherwise(F.array(s))))
    return F.filter(F.transform(long, trimmed), lambda s: s != "")


def is_noise(s: Column) -> Column:
    return (F.length(s) > 700) | s.rlike(_any(NOISE))


def requirements(text: Column) -> Column:
    """The requirements of a posting, one a line: section lines, then sentences with a
    cue, then whole patterns; cleaned, without noise, the first of equal ones."""
    clean = lambda s: F.regexp_replace(collapsed(F.regexp_replace(s, r"^\s*(?:[-*•‣▪●]+|\d+[.)])\s*", "")), r"^[ ;]+|[ ;]+$", "")

    def found(t: Column) -> Column:
        cued = F.filter(_units(t), lambda s: s.rlike(_any(CUES)) & ~is_noise(s))
        hard = F.flatten(F.array(*[F.regexp_extract_all(t, F.lit(p), F.lit(0)) for p in HARD]))
        items = F.filter(F.transform(F.concat(_section_lines(t), cued, hard), clean), lambda s: (F.length(s) >= 8) & ~is_noise(s))
        return F.array_join(first_of_each(items, lambda s: F.regexp_replace(F.lower(s), "[^a-z0-9]+", "")), "\n")

    return let(normalized(text), found)


#: Cue terms of a job description (fixed values).
DESCRIPTION_CUES = ["qualification", "qualifications", "requirements", "what you'll bring", "what you will bring", "responsibilities", "what you'll do", "what you will do", "about the role", "experience", "skills"]


def looks_like_description(text: Column) -> Column:
    return (F.length(text) >= 300) & F.lower(text).rlike("|".join(DESCRIPTION_CUES))


def bad_content_reasons(page_text: Column, extracted: Column) -> Column:
    """A sorted array of what is wrong with a fetched page."""
    low = F.lower(page_text)
    has = F.length(page_text) > 0
    some = F.array_compact(
        F.array(
            F.when(F.length(page_text) < 300, F.lit("too_short")),
            F.when(low.rlike("access denied|forbidden|not authorized"), F.lit("access_denied")),
            F.when(low.rlike("job no longer available|position has been filled|posting is closed"), F.lit("job_no_longer_available")),
            F.when(low.rlike("enable javascript|javascript is required|requires javascript"), F.lit("enable_javascript")),
            F.when(has & ~low.rlike("qualification|qualifications|requirements|responsibilities|experience|skills"), F.lit("no_requirements_like_text")),
            F.when(has & (F.size(F.array_distinct(F.filter(F.split(low, r"\s+"), lambda w: w != ""))) < 30), F.lit("boilerplate_only")),
        )
    )
    empty = F.coalesce(extracted, F.lit("")) == ""
    return let(some, lambda found: F.sort_array(F.when((F.size(found) == 0) & empty, F.array(F.lit("unusable_unknown"))).otherwise(found)))


def requirement_stats(rows: DataFrame, column: str) -> DataFrame:
    """How many requirements are empty, short (under 120 characters), or one line of under 200."""
    r = F.col(column)
    one_line = ~F.coalesce(F.rtrim(r).contains("\n"), F.lit(False))
    return rows.agg(F.count_if(F.coalesce(r, F.lit("")) == "").alias("empty"), F.count_if((r != "") & (F.length(r) < 120)).alias("short"), F.count_if((r != "") & (F.length(r) < 200) & one_line).alias("generic"))
