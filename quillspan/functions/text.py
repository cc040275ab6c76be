"""Text keys, tokenizers and scalar helpers as Column builders.

Plain forms use lower case with eszett folded and character classes. ``strict`` ones use compatibility
normalisation and full case folding, in the JVM by ``compat``; ``arrow`` ones are the same by Python's own.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import compat

LATIN = r"^[\p{IsLatin}\p{IsCommon}\p{IsInherited}]*$"
CJK = r"\x{3400}-\x{9fff}\x{f900}-\x{faff}"
TOKEN = rf"(?U)[{CJK}]|[\p{{L}}\p{{N}}\p{{M}}&&[^{CJK}]]+|[^\s\x{{1c}}-\x{{1f}}]"
# Blanks and the token behind them; these tile a text.
TILE = rf"(?U)([\s\x{{1c}}-\x{{1f}}]*+)([{CJK}]|[\p{{L}}\p{{N}}\p{{M}}&&[^{CJK}]]++|[^\s\x{{1c}}-\x{{1f}}]|\z)"
SCORER_TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s,]"


def fold(text: Column) -> Column:
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def identity(text: Column) -> Column:
    """Letters and digits of the folded text."""
    return F.regexp_replace(fold(text), r"[^\p{L}\p{N}]", "")


def key(text: Column) -> Column:
    """As ``identity``, with underscores."""
    return F.regexp_replace(fold(text), r"[^\p{L}\p{N}_]", "")


def canonical(text: Column) -> Column:
    """Folded text with single spaces."""
    return F.trim(F.regexp_replace(fold(text), r"\s+", " "))


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def text_key(text: Column) -> Column:
    return digest(canonical(text))


def identity_strict(text: Column) -> Column:
    return compat.letters(compat.folded(text))


def key_strict(text: Column) -> Column:
    return compat.letters(compat.folded(text), "_")


def canonical_strict(text: Column) -> Column:
    return compat.single_spaced(compat.folded(text))


def _arrow(text: Column, fn) -> Column:
    """Arrow UDF of the normalised, case-folded text; made on use, for workers import this module too."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda t: None if t is None else fn(unicodedata.normalize("NFKC", t).casefold()))

    return run(text)


def identity_arrow(text: Column) -> Column:
    return _arrow(text, lambda t: "".join(filter(str.isalnum, t)))


def key_arrow(text: Column) -> Column:
    return _arrow(text, lambda t: re.sub(r"\W", "", t))


def canonical_arrow(text: Column) -> Column:
    return _arrow(text, lambda t: " ".join(t.split()))


def bucket(value: Column, n: int) -> Column:
    """First 32 bits of the digest, modulo n."""
    return F.conv(F.substring(digest(value), 1, 8), 16, 10).cast("bigint") % n


def hash_split(value: Column, dev: int = 5, test: int = 5, of: int = 100) -> Column:
    b = bucket(value, of)
    return F.when(b < dev, "dev").when(b < dev + test, "test").otherwise("train")


def tokens(text: Column) -> Column:
    """Runs of letters, digits and marks; single ideographs; single other visible characters."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def scorer_tokens(text: Column) -> Column:
    return F.regexp_extract_all(fold(text), F.lit(SCORER_TOKEN), F.lit(0))


def is_latin(text: Column) -> Column:
    return text.rlike(LATIN)


def url_host(url: Column) -> Column:
    return F.try_parse_url(url, F.lit("HOST"))


def compact_ideographs(text: Column) -> Column:
    return F.regexp_replace(text, r"(?<=[\x{3400}-\x{9fff}])\s+(?=[\x{3400}-\x{9fff}])", "")


def size_text(n: Column) -> Column:
    return F.when(n >= 1_000_000, F.format_string("%.1f MB", F.round(n / 1e6, 1))).when(n >= 1000, F.format_string("%.1f kB", F.round(n / 1e3, 1))).otherwise(F.format_string("%d B", n))


def supplementary(text: Column) -> Column:
    """How many characters take two UTF-16 units."""
    return F.length(F.regexp_replace(text, r"[\x{0}-\x{ffff}]", ""))


def utf16_offset(text: Column, offset: Column) -> Column:
    """UTF-16 position of a code point position."""
    return offset + supplementary(F.substring(text, F.lit(1), offset))


# Postal codes and names of the states.
STATES = {
    "AL": "Alabama", "AK": "Alaska", "AZ": "Arizona", "AR": "Arkansas", "CA": "California", "CO": "Colorado", "CT": "Connecticut",
    "DE": "Delaware", "FL": "Florida", "GA": "Georgia", "HI": "Hawaii", "ID": "Idaho", "IL": "Illinois", "IN": "Indiana",
    "IA": "Iowa", "KS": "Kansas", "KY": "Kentucky", "LA": "Louisiana", "ME": "Maine", "MD": "Maryland", "MA": "Massachusetts",
    "MI": "Michigan", "MN": "Minnesota", "MS": "Mississippi", "MO": "Missouri", "MT": "Montana", "NE": "Nebraska", "NV": "Nevada",
    "NH": "New Hampshire", "NJ": "New Jersey", "NM": "New Mexico", "NY": "New York", "NC": "North Carolina", "ND": "North Dakota", "OH": "Ohio",
    "OK": "Oklahoma", "OR": "Oregon", "PA": "Pennsylvania", "RI": "Rhode Island", "SC": "South Carolina", "SD": "South Dakota", "TN": "Tennessee",
    "TX": "Texas", "UT": "Utah", "VT": "Vermont", "VA": "Virginia", "WA": "Washington", "WV": "West Virginia", "WI": "Wisconsin",
    "WY": "Wyoming", "DC": "District of Columbia",
}


def state_code(value: Column) -> Column:
    """A state's code from its code or name, else unknown."""
    pairs = {n.replace(" ", "").lower(): c for c, n in STATES.items()} | {c.lower(): c for c in STATES}
    table = F.create_map(*[F.lit(x) for p in pairs.items() for x in p])
    return F.coalesce(F.try_element_at(table, identity(value)), F.lit("unknown"))
