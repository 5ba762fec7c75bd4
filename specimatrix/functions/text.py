"""Text expressions: all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that a CSV reader of the source data takes as missing.
NA_TEXTS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")

# What people type where nothing is known.
PLACEHOLDERS = ("", "-", "--", "?", ".", "n/a", "na", "n.a.", "none", "null", "nan", "nil", "missing", "unknown", "unk", "not applicable", "not provided", "not collected", "not recorded", "not available", "not known", "unspecified", "undetermined", "anonymous", "various", "tbd", "xxx", "x")

#: Full-width ASCII forms and their plain ones, by rule.
_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
_PLAIN = "".join(chr(c) for c in range(0x21, 0x7F)) + " "


def missing_value(c: Column) -> Column:
    """Null where the text is one that a CSV reader takes as missing."""
    return F.when(~c.isin(*NA_TEXTS), c)


def narrow(c: Column) -> Column:
    """Full-width ASCII forms become plain ones (the part of NFKC that occurs in codes)."""
    return F.translate(c, _WIDE, _PLAIN)


def strip(c: Column) -> Column:
    """Trims Unicode white space, not only blanks."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    """Trimmed, inner white space as one blank."""
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def nonblank(c: Column) -> Column:
    """The trimmed text, null where nothing is left."""
    return F.nullif(strip(c), F.lit(""))


def placeholder(c: Column) -> Column:
    """True where the text is null, blank or says that nothing is known."""
    return F.coalesce(F.lower(squeeze(c)).isin(*PLACEHOLDERS), F.lit(True))


def alnum(c: Column) -> Column:
    """Lower case letters and digits only."""
    return F.regexp_replace(F.lower(narrow(c)), r"[^\p{L}\p{N}]+", "")


def digits_int(c: Column) -> Column:
    """The digits of a text as INT; 0 where there are none or too many."""
    return F.coalesce(F.regexp_replace(c, r"[^0-9]", "").try_cast("int"), F.lit(0))


def python_title(c: Column) -> Column:
    """A capital after every character that is no letter, as in ``ss-RNA`` -> ``Ss-Rna``."""
    pieces = F.regexp_extract_all(c, F.lit(r"(\p{L}+|[^\p{L}]+)"), 1)
    return F.array_join(F.transform(pieces, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, 1_000_000)))), "")


def quote_regex(text: str) -> str:
    """Escapes what is special in Java patterns; plain characters stay readable."""
    return "".join("\\" + ch if ch in r"\.[]{}()*+-?^$|#&~" else ch for ch in text)
