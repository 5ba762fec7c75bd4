"""Queries of the general problems over training-data tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from specimatrix.operators.moments import normalise_moments
from specimatrix.operators.packed import packed_cells, split_values
from specimatrix.session import table


def p2_found(spark: SparkSession, base: str) -> DataFrame:
    """Each value of a cell that holds several."""
    return split_values(packed_cells(table(spark, base, "assigned_genes_types_all"), table(spark, base, "final")))


def p5_found(spark: SparkSession, base: str) -> DataFrame:
    """The one moment that each collection date names."""
    return normalise_moments(table(spark, base, "final"), table(spark, base, "country_zone"))


QUERIES = {"p2_found": p2_found, "p5_found": p5_found}
ORACLES: dict[str, str] = {}
