"""Specimen keys: the first identifier that is given, cleaned, combined with the species; and how often keys occur."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from specimatrix.functions.text import strip
from specimatrix.sources.tables import resolve


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x) if x is not None else None)


def sanitize(c: Column, unicode: bool = True) -> Column:
    """A text as part of a key: quotes and parentheses gone, blanks and path signs as single underscores; null as ''.

    Only texts beyond ASCII take the way through Python for compatibility forms (``unicode=False`` never does).
    """
    text = strip(F.coalesce(c, F.lit("")))
    if unicode:
        text = F.when(text.rlike(r"^\p{ASCII}*$"), text).otherwise(_nfkc(text))
    text = F.translate(text, "'\"()", "")
    text = F.regexp_replace(F.translate(text, "　 ", "__"), r"[<>:./\\|?*]+", "_")
    return F.regexp_replace(F.regexp_replace(text, "_+", "_"), "^_|_$", "")


def combined(a: Column, b: Column, unicode: bool = True) -> Column:
    """``a_b`` of two cleaned texts, or the one that is not empty."""
    return F.concat_ws("_", F.nullif(sanitize(a, unicode), F.lit("")), F.nullif(sanitize(b, unicode), F.lit("")))


@dataclass(frozen=True)
class VoucherRules:
    """Where keys come from. ``CLI_VOUCHERS`` has the defaults of the command line."""

    priority: tuple[str, ...] = ("specimen_voucher", "isolate", "culture_collection", "clone_name", "strain")
    use_haplotype: bool = False
    fallback: str = "accession"
    species: str = "organism"
    combine: str = "species_name+pse"
    primary: str = "species_voucher_pse"
    name: str = "species_voucher_new"
    unicode: bool = True
    short: tuple[str, ...] = ("organism", "gene_type", "species_voucher_new", "locusid")


CLI_VOUCHERS = VoucherRules(priority=("specimen_voucher", "isolate", "clone_name", "strain"), use_haplotype=True)


def voucher_columns(df: DataFrame, rules: VoucherRules = VoucherRules()) -> DataFrame:
    """``df`` with the primary identifier, where it came from (``filled_from``) and the combined specimen key."""
    order = list(dict.fromkeys(c for c in (resolve(df, p) for p in rules.priority) if c))
    hap, fall, species = resolve(df, "haplotype"), resolve(df, rules.fallback), resolve(df, rules.species)
    sources = [("priority", F.coalesce(*[F.col(f"`{c}`") for c in order]))] if order else []
    sources += [("haplotype", F.col(f"`{hap}`"))] if rules.use_haplotype and hap else []
    sources += [("fallback", F.col(f"`{fall}`"))] if fall else []
    primary = F.coalesce(*[c for _, c in sources]) if sources else F.lit(None).cast("string")
    origin = F.coalesce(*[F.when(c.isNotNull(), name) for name, c in sources], F.lit("empty"))
    df = df.withColumn("filled_from", origin).withColumn(rules.primary, primary)
    own = F.col(rules.primary)
    if rules.combine == "pse_only" or not species:
        key = sanitize(own, rules.unicode)
    elif rules.combine == "species_name+pse":
        key = combined(F.col(f"`{species}`"), own, rules.unicode)
    elif rules.combine == "pse+species_name":
        key = combined(own, F.col(f"`{species}`"), rules.unicode)
    else:
        raise ValueError("combine must be species_name+pse, pse+species_name or pse_only")
    return df.withColumn(rules.name, key)


def fill_report(vouchered: DataFrame, rules: VoucherRules = VoucherRules()) -> DataFrame:
    """How many rows got their identifier from where, and how many have no key."""
    n = lambda c: F.count_if(c)
    return vouchered.agg(*[n(F.col("filled_from") == s).alias(f"from_{s}") for s in ("priority", "haplotype", "fallback")], n(F.col("filled_from") == "empty").alias("still_empty"), n(F.col(rules.name) == "").alias("empty_keys"))


def voucher_counts(df: DataFrame, key: str = "species_voucher_new") -> DataFrame:
    """How often each key occurs; rows without a key are not counted."""
    return df.where(F.coalesce(F.col(key), F.lit("")) != "").groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def count_of_counts(df: DataFrame, key: str = "species_voucher_new") -> DataFrame:
    """(occurrences, vouchers), most frequent first."""
    return voucher_counts(df, key).groupBy(F.col("n").alias("occurrences")).agg(F.count(F.lit(1)).alias("vouchers")).orderBy(F.desc("occurrences"))


def count_lines(df: DataFrame, key: str = "species_voucher_new") -> DataFrame:
    """The histogram as lines of a text report."""
    return count_of_counts(df, key).select(F.concat(F.col("occurrences").cast("string"), F.lit(" occurrences: "), F.col("vouchers").cast("string")).alias("value"))


def frequency_groups(df: DataFrame, key: str = "species_voucher_new", low: int = 2, high: int = 8) -> DataFrame:
    """Rows whose key occurs ``low`` to ``high`` times, with that number as ``frequency_group``.

    Counts are combined before the shuffle and joined back, so that a key that a third of the rows share stays spread.
    """
    bands = voucher_counts(df, key).where(F.col("n").between(low, high)).select(key, F.col("n").cast("int").alias("frequency_group"))
    return df.join(bands, key)


def with_haplotype(df: DataFrame, column: str = "haplotype") -> DataFrame:
    """Rows that have a haplotype; none if there is no such column."""
    found = resolve(df, column)
    return df.where(F.col(f"`{found}`").isNotNull()) if found else df.limit(0)
