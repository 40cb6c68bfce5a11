"""Detectors of personal data in a text, as Column expressions without any Python."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: An ASCII word boundary: Java's own also looks at letters beyond ASCII.
B = r"(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"

# The detectors' patterns, in the order in which types are reported.
PATTERNS = {
    "EMAIL": rf"(?i){B}[a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{{2,}}{B}",
    "SSN_US": rf"{B}[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}{B}",
    "CREDIT_CARD": rf"{B}(?:[0-9][ -]?){{13,19}}{B}",
    "PHONE_E164": r"\+[1-9][0-9]{7,14}",
    "AU_TFN": rf"{B}[0-9]{{3}}[ -]?[0-9]{{3}}[ -]?[0-9]{{3}}{B}",
    "IN_AADHAAR": rf"{B}[0-9]{{4}}[\t\n\f\r ]?[0-9]{{4}}[\t\n\f\r ]?[0-9]{{4}}{B}",
}
#: What every match holds, found faster than the pattern.
HOLDS = {"EMAIL": "@", "SSN_US": "[0-9]{3}-[0-9]{2}-", "CREDIT_CARD": "(?:[0-9][ -]?){6}", "PHONE_E164": r"\+[1-9]", "AU_TFN": "[0-9]{3}", "IN_AADHAAR": "[0-9]{4}"}
KEY = "API_KEY_ENTROPY"
MOST_BYTES, KEY_BYTES, KEY_BITS = 4096, 24, 4.0


def luhn(text: Column) -> Column:
    """The Luhn check over digits, blanks and dashes skipped; false for other characters or a zero sum."""
    digits = F.regexp_replace(text, "[ -]", "")
    return digits.rlike("^[0-9]*[1-9][0-9]*\\z") & F.call_function("luhn_check", digits)


def entropy(text: Column) -> Column:
    """Shannon entropy in bits per character of an ASCII text; 0 for an empty one."""
    def add(total: Column, c: Column) -> Column:
        p = (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / F.length(text)
        return total - p * F.log2(p)

    return F.when(F.length(text) == 0, 0.0).otherwise(F.aggregate(F.array_distinct(F.split(text, "")), F.lit(0.0), lambda t, c: F.when(c == "", t).otherwise(add(t, c))))


def looks_like_key(text: Column) -> Column:
    """At least 24 characters of a key's alphabet and 4 bits of entropy."""
    return F.when(text.rlike(rf"^[A-Za-z0-9_+/=-]{{{KEY_BYTES},}}\z"), entropy(text) >= KEY_BITS).otherwise(False)


def matches(text: Column, kind: str) -> Column:
    """Whether a detector's pattern is found; null for null."""
    return F.when(text.rlike(HOLDS[kind]), text.rlike(PATTERNS[kind])).when(text.isNotNull(), False)


def detected(text: Column) -> Column:
    """The types found in a text, an array. Texts that are null, empty or of over 4,096 bytes have none.

    A text with the surface of a card number, valid or not, is not read as a tax file number or Aadhaar.
    The key type is given only where nothing else is.
    """
    kinds = list(PATTERNS)
    surface = kinds.index("CREDIT_CARD")

    def types(hits: Column) -> Column:
        also = {"CREDIT_CARD": luhn(F.regexp_extract(text, PATTERNS["CREDIT_CARD"], 0)), "AU_TFN": ~hits[surface], "IN_AADHAAR": ~hits[surface]}
        return F.array_compact(F.array(*(F.when(hits[i] & also[k] if k in also else hits[i], F.lit(k)) for i, k in enumerate(kinds))))

    def or_key(found: Column) -> Column:
        return F.when(F.size(found) > 0, found).when(looks_like_key(text), F.array(F.lit(KEY))).otherwise(F.array().cast("array<string>"))

    found = _once(_once(F.array(*(F.coalesce(matches(text, k), F.lit(False)) for k in kinds)), types), or_key)
    return F.when(F.octet_length(text).between(1, MOST_BYTES), found).otherwise(F.array().cast("array<string>"))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where the value is computed once a row however often it is used."""
    return F.transform(F.array(value), lambda x: use(x))[0]
