"""Text expressions: cleaning of narratives, shapes, places; tokens and n-grams."""

from __future__ import annotations

import html
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

#: Sentences editors append to reports, and shape names with one meaning.
EDITOR_NOTES = (
    r"Witness elects to remain totally anonymous[;,.]?\s*provides?\s*(no|little)\s*contact information\.?\s*PD\.?",
    r"Witness elects to remain totally anonymous\.?\s*PD\.?",
    r"Witness indicates that the date of the (?:sighting|incident|event) is approximate\.?\s*PD\.?",
    r"Source of (?:the )?report (?:indicates that the date is approximate|elects to remain anonymous)[^.]*\.?\s*PD\.?",
    r"We suspect that the (?:sighting|object) (?:was|may have been) a [^.]+\.?\s*PD\.?",
    r"We spoke (?:at length )?with this witness via telephone[^.]*\.?\s*PD\.?",
    r"(?:Possibly not a serious report|Possible hoax)[^.]*\.?\s*PD\.?",
    r"We have amended the time above[^.]*\.?\s*PD\.?",
    r"NUFORC Note:[^\n]*",
)
SHAPE_ALIASES = {"changed": "changing", "round": "sphere", "disk": "disc"}
STATE_CODES = (
    "AL", "AK", "AZ", "AR", "CA", "CO", "CT", "DE", "FL", "GA", "HI", "ID", "IL", "IN", "IA", "KS", "KY", "LA", "ME", "MD", "MA", "MI", "MN", "MS", "MO",
    "MT", "NE", "NV", "NH", "NJ", "NM", "NY", "NC", "ND", "OH", "OK", "OR", "PA", "RI", "SC", "SD", "TN", "TX", "UT", "VT", "VA", "WA", "WV", "WI", "WY", "DC",
)

#: What is taken off a typed city, in order (pattern, replacement), off a gazetteer name, and what names often lack.
SAINT_RULE = (r"^st\.?\s+", "saint ")
CITY_RULES = (
    (r"\s*\([^)]*\)\s*", " "),
    (r"^(north|south|east|west|n\.|s\.|e\.|w\.)\s+", ""),
    SAINT_RULE,
    (r",\s*[a-z]{2}$", ""),
)
CENSUS_SUFFIX = r"\s+(city|town|cdp|village|borough|township|plantation|municipality|charter township|metro township)$"
LEADING_WORD = r"^(north|south|east|west|new|old|upper|lower|mount|mt\.?|fort|ft\.?)\s+"
TRAILING_WORD = r"\s+(heights|hills|beach|springs|park|lake|landing|junction|center|centre)$"


@pandas_udf(StringType())
def unescape_twice(texts: pd.Series) -> pd.Series:
    """HTML entities decoded twice, for entities that were themselves encoded; there is no built-in for it."""
    return texts.map(lambda t: html.unescape(html.unescape(t)) if t is not None and "&" in t else t)


def without_notes(text: Column) -> Column:
    """The text without editor notes, in the order the notes are listed, and without a trailing PD."""
    out = reduce(lambda c, p: F.regexp_replace(c, "(?i)" + p, ""), EDITOR_NOTES, text)
    return F.regexp_replace(F.regexp_replace(out, r"\s+PD\.?\s*$", ""), r"(?U)^\s+|\s+$", "")


def collapsed(text: Column) -> Column:
    """White space made single spaces, line breaks made blank lines."""
    out = F.regexp_replace(text, r"\r\n|\r|\n+", " || ")
    out = F.regexp_replace(F.regexp_replace(out, r"(?U)\s+", " "), r"^ | $", "")
    return F.replace(out, F.lit(" || "), F.lit("\n\n"))


def clean_narrative(raw: Column) -> Column:
    """Entities decoded, white space collapsed, editor notes removed; null becomes the empty text.

    Only texts with an ampersand go to the Python step.
    """
    # only texts with an ampersand are sent
    plain = F.coalesce(unescape_twice(F.when(raw.contains("&"), raw)), raw, F.lit(""))
    flat, low = collapsed(plain), F.lower(plain)
    # every note ends in PD or begins with the name of the office; other texts need no look at the nine patterns
    marked = F.contains(low, F.lit("pd")) | F.contains(low, F.lit("nuforc"))
    return F.when(marked, without_notes(flat)).otherwise(F.regexp_replace(flat, r"(?U)^\s+|\s+$", ""))


def clean_shape(raw: Column) -> Column:
    s = F.lower(F.trim(F.coalesce(raw, F.lit(""))))
    return reduce(lambda c, kv: F.when(s == kv[0], kv[1]).otherwise(c), SHAPE_ALIASES.items(), s)


def code(raw: Column, upper: bool = True) -> Column:
    """State or country: trimmed, one case; null and the text nan become empty."""
    s = F.trim(F.coalesce(raw, F.lit("")))
    s = F.upper(s) if upper else F.lower(s)
    return F.when(F.upper(s) == "NAN", "").otherwise(s)


def normalize_city(raw: Column, saints: bool = True) -> Column:
    """A typed city for the gazetteer: lower case, no notes in brackets, no leading direction, St. as saint, no trailing state."""
    rules = [r for r in CITY_RULES if saints or r is not SAINT_RULE]
    return reduce(lambda s, r: F.trim(F.regexp_replace(s, *r)), rules, F.lower(F.trim(F.coalesce(raw, F.lit("")))))


def gazetteer_name(raw: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(raw), CENSUS_SUFFIX, ""))


def city_variants(city: Column) -> list[Column]:
    """The city, the city without a leading, and without a trailing, word that names often lack."""
    return [F.trim(city), F.trim(F.regexp_replace(city, LEADING_WORD, "")), F.trim(F.regexp_replace(city, TRAILING_WORD, ""))]


def tokens(text: Column, stop: list[str]) -> Column:
    """Lower-case words of two letters and more, without stop words, before any n-gram is built."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"\b[a-z][a-z]+\b"), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(stop)) if stop else words


def ngrams(words: Column, low: int, high: int) -> Column:
    """All runs of ``low`` to ``high`` words, joined by spaces; empty for shorter texts."""
    one = lambda n: F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: F.array_join(F.slice(words, i + 1, n), " "))).otherwise(F.array().cast("array<string>"))
    return F.flatten(F.array(*[one(n) for n in range(low, high + 1)]))


def word_safe(text: Column, most: int = 200) -> Column:
    """At most ``most`` characters, cut after the last whole word, with dots."""
    cut = F.regexp_replace(F.substring(text, 1, most), r"(?s) [^ ]*$", "")
    return F.when(F.char_length(text) <= most, text).otherwise(F.concat(cut, F.lit("...")))


def title_case(text: Column) -> Column:
    """Letters after anything but a letter as capitals, all others small, also after apostrophes and digits."""
    low = F.lower(text)
    chars = F.filter(F.split(low, ""), lambda c: c != "")
    turned = F.transform(chars, lambda c, i: F.when((i == 0) | ~F.coalesce(F.try_element_at(chars, i), F.lit("")).rlike(r"\p{L}"), F.upper(c)).otherwise(c))
    return F.array_join(turned, "")


def highlighted(text: Column, words: str) -> Column:
    """The text in parts: what lies between the places of the words, whatever their case, and the words as they stand."""
    import re

    return F.split(F.regexp_replace(text, "(?i)(" + re.escape(words) + ")", "\u0001$1\u0001"), "\u0001")


def month_label(day: Column) -> Column:
    """A month as in Jan 2014."""
    return F.date_format(day, "MMM yyyy")


def salvaged(text: Column) -> Column:
    """The JSON object inside a text, from the first to the last brace, or null if that is none."""
    body = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(F.try_parse_json(body).isNotNull(), body)


def cache_key(query: Column, context: Column) -> Column:
    """Key of an answer kept for a query, whatever its case and outer blanks, and its context."""
    return F.sha2(F.concat(F.lower(F.trim(query)), F.coalesce(context, F.lit(""))), 256)


def excerpt(text: Column, most: int) -> Column:
    """The first characters of a text, for display."""
    return F.substring(text, 1, most)
