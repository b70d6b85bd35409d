"""What is shown of a posting: each field the first of its sources that says something."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text, times

#: A field that is shown, and the columns it comes from, in order (names that must match).
FIELDS = {
    "title": ("title",),
    "company": ("company_name", "company", "source_company"),
    "location": ("location_name", "location"),
    "work_arrangement": ("work_arrangement",),
    "url": ("url", "job_url", "apply_url"),
}


def rows(df: DataFrame, now: Column, posted_at: str = "posted_at_utc", keep: list[str] = ()) -> DataFrame:
    """keep, the FIELDS ('' where no column says anything; only an empty string or null passes on to
    the next, so a blank one shows as '') and posted_display. Rows without a title are left out."""
    said = lambda names: [F.nullif(F.col(c), F.lit("")) for c in names if c in df.columns]
    shown = {f: text.trimmed(F.coalesce(*said(names), F.lit(""))) for f, names in FIELDS.items()}
    out = df.select(*keep, *[c.alias(f) for f, c in shown.items()], times.shown(F.col(posted_at), now).alias("posted_display"))
    return out.filter(F.col("title") != "")
