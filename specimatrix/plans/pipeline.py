"""The whole pipeline as one lazy plan, with optional results on disk after each step.

Steps are composed as DataFrames; what is written is a choice, not the way from step to step. With ``resume`` a step whose
completed result lies on disk is read instead of computed.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specimatrix.operators import classify as C
from specimatrix.operators import matrix as M
from specimatrix.operators import reports as R
from specimatrix.operators import voucher as K
from specimatrix.session import cut, ship
from specimatrix.sources import flatfile as FF
from specimatrix.sources.tables import PipelineStepError, checked_columns, normalise_columns, read_table, valid_output, write_json_report, write_table, write_text_report

STEPS = ("extract", "classify", "voucher", "organize")
#: Internal names of the flat view's columns.
RENAMES = {"LocusID": "locusid", "ACCESSION": "accession", "Length": "seq_length", "MoleculeType": "moleculetype", "Topology": "topology", "Division": "division", "Date": "record_date", "Definition": "definition", "Keywords": "keywords", "HeaderOrganism": "header_organism", "Version": "seq_version", "TaxonID": "taxonid", "Class": "class_name", "Order": "order_name", "Family": "family_name", "Genus": "genus_name", "clone": "clone_name", "PCR_primers": "pcr_primers"}


@dataclass
class StepResult:
    """What a step left: its table, the path it was written to (if any) and whether it was read from an earlier run."""

    name: str
    table: DataFrame
    path: str | None = None
    resumed: bool = False


@dataclass
class PipelineResult:
    """All steps that ran or were resumed; ``success`` is False with ``error`` if one could not."""

    success: bool = True
    error: str = ""
    steps: dict[str, StepResult] = field(default_factory=dict)

    @property
    def steps_completed(self) -> list[str]:
        return list(self.steps)


def parsed_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """All records of flat files, those that could not be read too."""
    return FF.parse_records(FF.read_records(spark, path))


def extract(spark: SparkSession, path: str | list[str], taxonomy: DataFrame | None = None, each: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Flat files below ``path`` as the metadata table with assemblies, empty texts null, ``row_id`` in file order.

    ``each`` is applied to the parsed records before they are flattened: it may change, drop or add to them.
    """
    parsed = parsed_records(spark, path).where("parse_error is null")
    parsed = each(parsed) if each else parsed
    flat = FF.with_assembly(FF.flat_view(parsed, taxonomy), FF.assemblies(parsed))
    names = [c for c in flat.columns if c not in ("file_path", "at")]
    texts = [F.nullif(F.col(f"`{c}`"), F.lit("")).alias(RENAMES.get(c, c)) for c in names]
    return flat.select(F.col("at._id").alias("row_id"), *texts)  # unique, and in order within a file


def write_extraction_reports(spark: SparkSession, path: str | list[str], out: str, seconds: float = 0.0) -> None:
    """What became of each file and record: errors, tracking, status of files, totals; failed files are copied."""
    parsed = cut(parsed_records(spark, path))
    report = cut(FF.file_report(spark, path, parsed))
    write_table(FF.record_errors(parsed), f"{out}/record_errors")
    write_table(FF.record_tracking(parsed), f"{out}/record_tracking")
    write_json_report(report, f"{out}/files")
    write_json_report(FF.run_totals(report, FF.assemblies(parsed.where("parse_error is null")), seconds), f"{out}/totals")
    FF.archive_failed(report, f"{out}/failed_extract")


def voucher(classified: DataFrame, rules: K.VoucherRules = K.VoucherRules()) -> DataFrame:
    return K.voucher_columns(classified, rules)


def run(
    spark: SparkSession,
    inputs: str | list[str] | DataFrame,
    out: str | None = None,
    resume: bool = False,
    skip: tuple[str, ...] = (),
    taxonomy: DataFrame | None = None,
    rules: C.Rules = C.Rules(),
    vouchers: K.VoucherRules = K.VoucherRules(),
    matrix: M.MatrixRules = M.MatrixRules(),
    normalize_columns: bool = False,
    filters: dict[str, str] | None = None,
    csv: bool = False,
    recheck: bool = True,
    each: Callable[[DataFrame], DataFrame] | None = None,
) -> PipelineResult:
    """Flat files (one path or several), a delimited table (a path) or a DataFrame to the specimen-by-marker matrix.

    ``out`` writes each step as Parquet below it, the matrix sorted by specimen, and as CSV too if ``csv``; for flat files
    also which records and files failed. ``skip`` reads the named steps' results, which must then be there. ``each`` is
    applied to parsed records.
    """
    ship(spark)
    began = time.time()
    result = PipelineResult()

    def source() -> DataFrame:
        if isinstance(inputs, DataFrame):
            return inputs
        if isinstance(inputs, str) and inputs.lower().endswith((".csv", ".tsv", ".txt", ".xls", ".xlsx")):
            table = read_table(spark, inputs)
            return table if "row_id" in table.columns else table.withColumn("row_id", F.monotonically_increasing_id())
        return extract(spark, inputs, taxonomy, each)

    flat_input = not isinstance(inputs, DataFrame) and not (isinstance(inputs, str) and inputs.lower().endswith((".csv", ".tsv", ".txt", ".xls", ".xlsx")))

    makers = {
        "extract": lambda _: normalise_columns(source()) if normalize_columns else source(),
        "classify": lambda df: C.classify(C.attribute_filter(df, **(filters or {})), rules, recheck),
        "voucher": lambda df: voucher(df, vouchers),
        "organize": lambda df: M.matrix(checked_columns(df, [matrix.group, matrix.organism, matrix.gene_type, matrix.locus]), matrix),
    }
    df: DataFrame | None = None
    try:
        for step in STEPS:
            path = f"{out}/{step}" if out else None
            there = bool(path) and valid_output(spark, path)
            if step in skip and not there:
                raise PipelineStepError(f"{step} is skipped but has no valid result")
            if there and (resume or step in skip):
                df = spark.read.parquet(path)
                result.steps[step] = StepResult(step, df, path, resumed=True)
                continue
            df = makers[step](df)
            if path:
                (df.orderBy(matrix.group) if step == "organize" else df).write.mode("overwrite").parquet(path)
                df = spark.read.parquet(path)
                if step == "extract" and flat_input:
                    write_extraction_reports(spark, inputs, f"{out}/extract_reports", time.time() - began)
            elif step == "extract" and not isinstance(inputs, DataFrame):
                df = cut(df)  # row ids are given once, for all that is joined by them
            result.steps[step] = StepResult(step, df, path)
        if out and csv:
            write_table(df, f"{out}/organized_species_voucher.csv", by=matrix.group)
    except PipelineStepError as e:
        result.success, result.error = False, str(e)
    return result


def write_reports(result: PipelineResult, out: str, rules: C.Rules = C.Rules()) -> None:
    """The run's reports: unmatched categories, voucher counts, frequency groups and marker coverage."""
    records = result.steps["extract"].table
    left = C.unmatched(C.first_round(records, rules)).withColumn("category", C.category(F.col(rules.definition)))
    write_table(left, f"{out}/unmatched_categorized")
    write_text_report(R.report_lines(R.category_counts(left)), f"{out}/unmatched_report")
    vouchered = result.steps["voucher"].table
    write_text_report(K.count_lines(vouchered), f"{out}/count_species_voucher")
    write_table(K.frequency_groups(vouchered), f"{out}/species_voucher_groups")
    write_json_report(M.coverage(result.steps["organize"].table), f"{out}/coverage")


def write_gene_tables(classified: DataFrame, out: str, genes: list[str] | None = None) -> None:
    """One folder per marker below ``out``, in one pass over the data."""
    C.gene_rows(classified, genes).withColumn("gene", C.safe_name(F.col("gene"))).write.mode("overwrite").partitionBy("gene").option("header", True).csv(out)
