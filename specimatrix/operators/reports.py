"""Counts and samples for people to read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specimatrix.session import cut


def category_counts(rows: DataFrame) -> DataFrame:
    """(category, n, percent) of rows with a ``category``; the window runs over the few categories."""
    counts = rows.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("percent", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 1))


def category_samples(rows: DataFrame, top: int = 5, each: int = 3, letters: int = 100, order: str = "row_id") -> DataFrame:
    """The ``top`` categories, each with its first definitions, cut to a length for display.

    The first rows of a category are found by a limited window, which every task applies before the shuffle.
    """
    rows = cut(rows.select("category", order, "definition"))
    counts = rows.groupBy("category").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "category").limit(top)
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("category").orderBy(order))).where(F.col("rank") <= each)
    return ranked.join(F.broadcast(counts), "category").select("category", "n", "rank", F.substring("definition", 1, letters).alias("sample"))


def report_lines(counts: DataFrame) -> DataFrame:
    """Category counts as lines of a text report, most frequent first."""
    line = F.format_string("%s: %d (%.1f%%)", "category", "n", "percent")
    return counts.orderBy(F.desc("n"), "category").select(line.alias("value"))


def nonempty_counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """How many rows have a text in each column."""
    return rows.agg(*[F.count_if(F.trim(c) != "").alias(c) for c in columns])


def file_status(rows: DataFrame, file: str, failed: Column) -> DataFrame:
    """(file, records, failed, status) of each source file."""
    out = rows.groupBy(file).agg(F.count(F.lit(1)).alias("records"), F.count_if(failed).alias("failed"))
    return out.withColumn("status", F.when(F.col("failed") == F.col("records"), "failed").when(F.col("failed") > 0, "partial").otherwise("success"))


def failed_accessions(rows: DataFrame, file: str, failed: Column, most: int = 5) -> DataFrame:
    """Each file's first failed accessions, for the run's report."""
    bad = rows.where(failed & F.col("accession").isNotNull())
    ranked = bad.withColumn("_rank", F.row_number().over(Window.partitionBy(file).orderBy("accession"))).where(F.col("_rank") <= most)
    return ranked.groupBy(file).agg(F.array_join(F.array_sort(F.collect_list("accession")), "; ").alias("failed_accessions"))


def gene_category(gene: Column) -> Column:
    """What kind of marker this is."""
    return F.when(gene.isin("coi", "cob", "cox2", "cox3"), "mito_protein").when(gene.isin("12s", "16s"), "mito_rrna").when(gene.isin("18s", "28s", "its1-its2", "18-28s"), "nuclear_rrna").when(gene == "mtgenome", "genome").otherwise("nuclear_protein")


def dictionary_stats(dictionary: DataFrame) -> DataFrame:
    """(category, genes, phrases) of a dictionary table."""
    per = dictionary.groupBy("marker").agg(F.countDistinct("phrase").alias("n"))
    return per.groupBy(gene_category(F.col("marker")).alias("category")).agg(F.count(F.lit(1)).alias("genes"), F.sum("n").alias("phrases"))


def ordered_dictionary(dictionary: DataFrame) -> DataFrame:
    """A dictionary's markers by kind, then name."""
    rank = F.when(gene_category(F.col("marker")) == "genome", 0).when(gene_category(F.col("marker")).startswith("mito"), 1).otherwise(2)
    return dictionary.groupBy("marker").agg(F.array_sort(F.collect_set("phrase")).alias("phrases")).orderBy(rank, "marker")
