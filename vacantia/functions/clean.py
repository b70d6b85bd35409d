"""Unicode clean-up that SQL has no function for, as an Arrow function."""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Typographic quotes and their plain forms (fixed values).
QUOTES = str.maketrans({"‘": "'", "’": "'", "‚": "'", "‛": "'", "“": '"', "”": '"', "„": '"', " ": " "})
_broken = re.compile("[Â-ô][\u0080-¿€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]{1,3}")


def _again(m: re.Match) -> str:
    raw = b"".join(bytes([ord(c)]) if ord(c) < 256 else c.encode("cp1252") for c in m[0])
    try:
        return raw.decode("utf-8")
    except UnicodeError:
        return m[0]


def mended(text: str) -> str:
    """Characters of UTF-8 that were once read as Windows-1252, read again, up to three times."""
    for _ in range(3):
        better = _broken.sub(_again, text)
        if better == text:
            break
        text = better
    return text


def clean(text: str | None) -> str | None:
    """Entities, mojibake, compatibility forms, quotes, line ends and white space made uniform; blank is null."""
    if text is None:
        return None
    t = unicodedata.normalize("NFKC", mended(html.unescape(text)))
    for typographic, plain in QUOTES.items():  # str.translate looks at every character, at ten times the cost
        t = t.replace(chr(typographic), plain)
    t = re.sub(r"\r\n?", "\n", t)
    t = re.sub(r"[^\S\n ][^\S\n]*| [^\S\n]+", " ", t)  # single spaces are not touched
    t = re.sub(r" *\n *", "\n", t)
    return re.sub(r"\n{3,}", "\n\n", t).strip() or None


def cleaned(c: Column) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(clean, na_action="ignore")

    return run(c)
