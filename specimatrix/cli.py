"""Command line: ``python -m specimatrix.cli [run|extract|classify|voucher|organize] INPUT... OUTPUT [options]``.

Without a step's name the whole pipeline runs. The single steps read and write Parquet folders or delimited tables.
"""

from __future__ import annotations

import argparse
import importlib.util
import sys
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specimatrix.functions.phrases import DICTIONARY, load_dictionary, merge
from specimatrix.operators import classify as C
from specimatrix.operators import voucher as K
from specimatrix.operators.matrix import MODES, MatrixRules, matrix
from specimatrix.plans.pipeline import STEPS, extract, run, write_extraction_reports, write_gene_tables, write_reports
from specimatrix.session import build
from specimatrix.sources.tables import checked_columns, normalise_columns, project, read_table, write_table, write_text_report

#: What the library can not do without, and what it uses where it is there.
NEEDED = ("pyspark", "pandas", "pyarrow", "numpy", "xxhash")
OPTIONAL = ("tzdata", "tiktoken", "openpyxl")


def lacking() -> tuple[list[str], list[str]]:
    """The needed and the optional packages that are not installed."""
    return tuple([m for m in names if importlib.util.find_spec(m) is None] for names in (NEEDED, OPTIONAL))


def flag(text: str) -> bool:
    """yes/true/t/1/y/on and their opposites."""
    low = text.strip().lower()
    if low in ("yes", "true", "t", "1", "y", "on"):
        return True
    if low in ("no", "false", "f", "0", "n", "off"):
        return False
    raise argparse.ArgumentTypeError(f"A yes or no is expected, not {text!r}")


def listed(text: str) -> tuple[str, ...]:
    """Names between commas."""
    return tuple(n.strip() for n in text.split(",") if n.strip())


def _rule_options(p: argparse.ArgumentParser) -> None:
    p.add_argument("--dictionary", help="a .txt, .csv or .yaml dictionary merged into the built-in one")
    p.add_argument("--length", default="150:50000", help="overall length range lo:hi")
    p.add_argument("--mito-length", default="150:50000")
    p.add_argument("--nuclear-length", default="150:50000")
    p.add_argument("--gene-length", nargs="*", default=[], metavar="GENE=LO:HI", help="length ranges of single markers")
    p.add_argument("--mitochondrial", type=listed, default=C.MITOCHONDRIAL, help="markers of the mitochondrial group")
    p.add_argument("--nuclear", type=listed, default=C.NUCLEAR)
    p.add_argument("--stop-at-first", type=flag, default=False)
    p.add_argument("--recheck", type=flag, default=True, help="the second round")
    p.add_argument("--reasons", type=flag, default=True)
    p.add_argument("--conflict-reasons", type=flag, default=True)
    p.add_argument("--moleculetype", default="all")
    p.add_argument("--mol-type", default="all")
    p.add_argument("--attribute-length", default="all")
    p.add_argument("--organelle", default="all")


def _voucher_options(p: argparse.ArgumentParser) -> None:
    p.add_argument("--priority", type=listed, default=K.CLI_VOUCHERS.priority, help="columns that give the identifier, in order")
    p.add_argument("--fallback", default="accession")
    p.add_argument("--haplotype", type=flag, default=True)
    p.add_argument("--species-column", default="organism")
    p.add_argument("--combine", default="species_name+pse", choices=["species_name+pse", "pse+species_name", "pse_only"])
    p.add_argument("--primary-name", default="species_voucher_pse")
    p.add_argument("--key-name", default="species_voucher_new")


def _matrix_options(p: argparse.ArgumentParser) -> None:
    p.add_argument("--group", default="species_voucher_new")
    p.add_argument("--genes", type=listed, default=MatrixRules().genes, help="the matrix's markers, in order")
    p.add_argument("--mode", default="first_nonempty", choices=MODES)
    p.add_argument("--metadata", type=listed, default=MatrixRules().metadata)
    p.add_argument("--extra", type=listed, default=())
    p.add_argument("--prefer-reference", type=flag, default=False)
    p.add_argument("--spread-cluster", type=flag, default=True)
    p.add_argument("--spread-genome", type=flag, default=True)
    p.add_argument("--genome-genes", type=listed, default=None)
    p.add_argument("--separate-unknown", type=flag, default=False, help="a row for each record without a key")


def _rules(a: argparse.Namespace) -> C.Rules:
    words = merge(DICTIONARY, load_dictionary(a.dictionary)) if a.dictionary else dict(DICTIONARY)
    lengths = dict(C.Rules().lengths) | dict(g.split("=", 1) for g in a.gene_length)
    return C.Rules(dictionary=words, overall=a.length, mito_length=a.mito_length, nuclear_length=a.nuclear_length, lengths=lengths, mitochondrial=a.mitochondrial, nuclear=a.nuclear, stop_at_first=a.stop_at_first, reasons=a.reasons, conflicts=a.conflict_reasons)


def _filters(a: argparse.Namespace) -> dict[str, str]:
    return {"molecule": a.moleculetype, "mol_type": a.mol_type, "length": a.attribute_length, "organelle": a.organelle}


def _vouchers(a: argparse.Namespace) -> K.VoucherRules:
    return replace(K.CLI_VOUCHERS, priority=a.priority, fallback=a.fallback, use_haplotype=a.haplotype, species=a.species_column, combine=a.combine, primary=a.primary_name, name=a.key_name)


def _matrix(a: argparse.Namespace) -> MatrixRules:
    more = {"includes": MatrixRules().includes | {"mtgenome": a.genome_genes}} if a.genome_genes else {}
    return MatrixRules(group=a.group, genes=a.genes, mode=a.mode, metadata=a.metadata, extra=a.extra, prefer_reference=a.prefer_reference, spread_cluster=a.spread_cluster, spread_genome=a.spread_genome, separate_unknown=a.separate_unknown, **more)


def parser(step: str = "run") -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog=f"specimatrix {step}", description=__doc__)
    p.add_argument("input", nargs="+", help="folders of flat files, or a table (.csv, .tsv, .txt, Parquet folder)")
    p.add_argument("output", help="folder of the results")
    p.add_argument("--normalize-columns", action="store_true")
    if step == "run":
        p.add_argument("--resume", action="store_true", help="take completed steps from the output folder")
        for s in STEPS:
            p.add_argument(f"--skip-{s}", action="store_true")
        p.add_argument("--reports", action="store_true")
        p.add_argument("--csv", action="store_true")
    if step in ("run", "classify"):
        _rule_options(p)
    if step == "classify":
        p.add_argument("--genes", type=listed, default=(), help="markers that get a table of their own")
    if step in ("run", "voucher"):
        _voucher_options(p)
    if step == "voucher":
        p.add_argument("--short", type=flag, default=True, help="a table of few columns too")
        p.add_argument("--short-columns", type=listed, default=("LocusID", "Length", "Definition", "organism", "TaxonID", "specimen_voucher", "species_voucher_new", "species_voucher_pse", "isolate", "strain"))
        p.add_argument("--frequency-groups", type=flag, default=True)
    if step in ("run", "organize"):
        _matrix_options(p)
    return p


def _read(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    path = a.input[0]
    known = path.lower().endswith((".csv", ".tsv", ".txt", ".xls", ".xlsx"))
    df = read_table(spark, path) if known else spark.read.parquet(path)
    df = normalise_columns(df) if a.normalize_columns else df
    return df if "row_id" in df.columns else df.withColumn("row_id", F.monotonically_increasing_id())


def _step(spark: SparkSession, step: str, a: argparse.Namespace) -> None:
    if step == "extract":
        extract(spark, a.input).write.mode("overwrite").parquet(f"{a.output}/final")
        write_extraction_reports(spark, a.input, a.output)
        return
    df = _read(spark, a)
    if step == "classify":
        rules = _rules(a)
        df = C.attribute_filter(df, **_filters(a))
        C.classify(df, rules, a.recheck).write.mode("overwrite").parquet(f"{a.output}/assigned_genes_types_all")
        done = spark.read.parquet(f"{a.output}/assigned_genes_types_all")
        for name, part in (("multiple_matched", C.multiple(done)), ("conflicted_genes", C.conflicting(done)), ("unmatched_sequences", C.unmatched(C.first_round(df, rules)))):
            write_table(part, f"{a.output}/{name}")
        if a.genes:
            write_gene_tables(done, f"{a.output}/genes", list(a.genes))
    elif step == "voucher":
        rules = _vouchers(a)
        K.voucher_columns(df, rules).write.mode("overwrite").parquet(f"{a.output}/updated_species_voucher")
        done = spark.read.parquet(f"{a.output}/updated_species_voucher")
        write_text_report(K.count_lines(done, rules.name), f"{a.output}/count_species_voucher")
        if a.short:
            write_table(project(done, list(a.short_columns)), f"{a.output}/short")
        if a.frequency_groups:
            K.frequency_groups(done, rules.name).write.mode("overwrite").partitionBy("frequency_group").parquet(f"{a.output}/species_voucher_groups")
    else:
        rules = _matrix(a)
        rows = checked_columns(df, [rules.group, rules.organism, rules.gene_type, rules.locus])
        write_table(matrix(rows, rules), f"{a.output}/organized_species_voucher.csv", by=rules.group)


def main(args: list[str] | None = None) -> int:
    args = sys.argv[1:] if args is None else args
    needed, _ = lacking()
    if needed:
        print(f"Not installed: {', '.join(needed)}", file=sys.stderr)
        return 1
    step = args[0] if args and args[0] in (*STEPS, "run") else "run"
    a = parser(step).parse_args(args[1:] if args and args[0] == step else args)
    if step != "run":
        _step(build(), step, a)
        print(f"done: {step}")
        return 0
    rules = _rules(a)
    source = a.input[0] if len(a.input) == 1 else a.input
    result = run(build(), source, a.output, a.resume, tuple(s for s in STEPS if getattr(a, f"skip_{s}")), rules=rules, vouchers=_vouchers(a), matrix=_matrix(a), normalize_columns=a.normalize_columns, filters=_filters(a), csv=a.csv, recheck=a.recheck)
    if result.success and a.reports:
        write_reports(result, a.output, rules)
    print(f"{'done' if result.success else 'failed'}: {', '.join(result.steps_completed)}" + (f"; {result.error}" if result.error else ""))
    return 0 if result.success else 1


if __name__ == "__main__":
    sys.exit(main())
