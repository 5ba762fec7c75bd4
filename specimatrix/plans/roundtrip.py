"""Records to flat files and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specimatrix.operators.classify import length_of
from specimatrix.session import cut, scratch
from specimatrix.sources.flatfile import ASSEMBLY_FIELDS, assemblies, flat_view, parse_records, read_records, record_tracking, write_flat
from specimatrix.sources.tables import read_table, write_table


def parsed_again(final: DataFrame) -> DataFrame:
    """All records, written as flat files and parsed."""
    spark = final.sparkSession
    path = scratch(spark)
    write_flat(final.withColumn("n", F.coalesce(length_of(F.col("seq_length")), F.lit(0))), path)
    return parse_records(read_records(spark, path, r"\.txt$"))


def roundtrip(final: DataFrame) -> DataFrame:
    """(locusid, accession, length, definition, organism, taxonid, isolate, specimen_voucher) of all records."""
    flat = flat_view(parsed_again(final), extra=[])
    return flat.select(F.col("LocusID").alias("locusid"), F.col("ACCESSION").alias("accession"), F.col("Length").alias("length"), F.col("Definition").alias("definition"), F.col("organism"), F.col("TaxonID").alias("taxonid"), F.col("isolate"), F.col("specimen_voucher"))


def references(final: DataFrame) -> DataFrame:
    """(locusid, authors, title, journal) of the first reference of all records."""
    flat = flat_view(parsed_again(final), extra=["Ref1Authors", "Ref1Title", "Ref1Journal"])
    return flat.select(F.col("LocusID").alias("locusid"), *[F.col(f"Ref1{c.title()}").alias(c) for c in ("authors", "title", "journal")])


def assembled(final: DataFrame, assembly: DataFrame) -> DataFrame:
    """(accession, the assembly's fields, assembly_source) of all records whose accession has an assembly.

    Of repeated assemblies the smallest is written; records in turn state theirs as structured comment and as text.
    """
    return assemblies(parsed_again(_with_assemblies(final, assembly))).select(F.col("ACCESSION").alias("accession"), *[F.col(f"`{f}`").alias(n) for f, n in zip(ASSEMBLY_FIELDS, NAMES)], "assembly_source")


def tracked(final: DataFrame, assembly: DataFrame) -> DataFrame:
    """What became of each of the same records."""
    return record_tracking(cut(parsed_again(_with_assemblies(final, assembly))))


def delimited(df: DataFrame, kind: str, sep: str) -> DataFrame:
    """A table written as delimited text and read again, all strings."""
    return read_table(df.sparkSession, write_table(df, scratch(df.sparkSession) + kind, sep))


NAMES = tuple(f.lower().replace(" ", "_") for f in ASSEMBLY_FIELDS)


def _with_assemblies(final: DataFrame, assembly: DataFrame) -> DataFrame:
    one = assembly.groupBy(F.trim("accession").alias("accession")).agg(F.min(F.struct(*[F.coalesce(n, F.lit("")).alias(n) for n in NAMES])).alias("_a"))
    return final.join(one, "accession", "left").select(final["*"], *[F.col("_a")[n].alias(f) for n, f in zip(NAMES, ASSEMBLY_FIELDS)], (F.col("row_id") % 2 == 1).alias("as_text"))
