"""Tables, flat files, the pipeline and the stream, over files written by the tests."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from specimatrix.cli import flag, main
from specimatrix.plans import pipeline as P
from specimatrix.session import clear_scratch, cut
from specimatrix.sources import flatfile as FF
from specimatrix.sources import tables as T

ONE = """LOCUS       AB000001                  24 bp    ss-RNA  linear   INV 28-SEP-2019
DEFINITION  Aus bus voucher X:1 cytochrome c oxidase subunit I (COI) gene,
            partial cds; mitochondrial.
ACCESSION   AB000001 AB000009
VERSION     AB000001.2
KEYWORDS    barcode; BOLD.
SOURCE      mitochondrion Aus bus
  ORGANISM  Aus bus
            Eukaryota; Metazoa; Annelida;
            Polychaeta.
REFERENCE   1  (bases 1 to 24)
  AUTHORS   Doe,J. and Roe,R.
  TITLE     A long title
            over two lines
  JOURNAL   J. Worm 1, 2-3 (2001)
   PUBMED   12345
REFERENCE   2  (bases 1 to 24)
  AUTHORS   Roe,R.
  TITLE     Direct Submission
COMMENT     ##Assembly-Data-START##
            Assembly Method       :: Weaver v. 1
            Sequencing Technology :: ShortRead
            ##Assembly-Data-END##
FEATURES             Location/Qualifiers
     source          1..24
                     /organism="Aus bus"
                     /organelle="mitochondrion"
                     /specimen_voucher="X:1"
                     /note="said ""so""
                     twice"
                     /note="again"
                     /db_xref="taxon:77"
                     /db_xref="BOLD:1"
                     /germline
     gene            1..24
                     /gene="COI"
ORIGIN
        1 acgtacgtac gtacgtacgt acgt
"""
TWO = """LOCUS       AB000002                 650 bp    DNA     circular INV 01-JAN-2020
DEFINITION  Cus dus 16S ribosomal RNA gene.
ACCESSION   AB000002
VERSION     AB000002.1
KEYWORDS    .
SOURCE      Cus dus
  ORGANISM  Cus dus
            Eukaryota.
COMMENT     Assembly Method: Reader;
            Genome Coverage : 12x
FEATURES             Location/Qualifiers
     source          1..650
                     /organism="Cus dus"
"""


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    at = tmp_path_factory.mktemp("flat")
    (at / "sub").mkdir()
    (at / "a.gb").write_text(ONE + "//\n" + TWO + "//\n" + ONE.replace("000001", "000003") + "//\n")
    (at / "sub" / "b.GBK").write_bytes((TWO.replace("000002", "000004") + "//").replace("\n", "\r\n").encode())
    (at / "empty.gb").write_text("")
    (at / "bad.gb").write_text("hello\n//\n")
    (at / "other.txt").write_text(ONE)
    return str(at)


def test_flat_files(spark, files, rows):
    parsed = FF.parse_records(FF.read_records(spark, files)).cache()
    good = {r.locus_id: r for r in parsed.where("parse_error is null").collect()}
    assert set(good) == {"AB000001.2", "AB000002.1", "AB000003.2", "AB000004.1"}
    r = good["AB000001.2"]
    assert (r.accession, r.version, r.length, r.molecule_type, r.topology, r.division, r.date) == ("AB000001", "2", 24, "Ss-Rna", "Linear", "INV", "28-SEP-2019")
    assert r.definition == "Aus bus voucher X:1 cytochrome c oxidase subunit I (COI) gene, partial cds; mitochondrial"
    assert r.keywords == ["barcode", "BOLD"] and r.header_organism == "Aus bus" and r.taxonomy == ["Eukaryota", "Metazoa", "Annelida", "Polychaeta"] and r.taxon_id == "77"
    assert r.source == {"organism": "Aus bus", "organelle": "mitochondrion", "specimen_voucher": "X:1", "note": 'said "so" twice; again', "germline": ""}
    assert [tuple(x) for x in r.refs] == [("Doe,J. and Roe,R.", "A long title over two lines", "J. Worm 1, 2-3 (2001)", "12345", ""), ("Roe,R.", "Direct Submission", "", "", "")]
    assert r.structured_comment["Assembly-Data"] == {"Assembly Method": "Weaver v. 1", "Sequencing Technology": "ShortRead"}
    assert good["AB000002.1"].length == 650 and good["AB000002.1"].keywords == [] and good["AB000004.1"].definition == "Cus dus 16S ribosomal RNA gene"
    asm = {r.ACCESSION: r for r in FF.assemblies(parsed).collect()}
    assert asm["AB000001"].assembly_source == "structured_comment" and asm["AB000001"]["Assembly Method"] == "Weaver v. 1"
    assert asm["AB000002"].assembly_source == "comment_text" and asm["AB000002"]["Assembly Method"] == "Reader" and asm["AB000002"]["Genome Coverage"] == "12x"
    taxonomy = spark.createDataFrame([("77", "C", "O", "F", "G")], "taxonid string, class_name string, order_name string, family_name string, genus_name string")
    flat = FF.flat_view(parsed, taxonomy)
    one = flat.where("LocusID = 'AB000001.2'").first()
    assert one["Class"] == "C" and one["Ref1PubMed"] == "12345" and one["germline"] == "" and one["Length"] == "24 bp" and flat.columns[-1] == "germline"
    report = {r.file_path.rsplit("/", 1)[-1]: (r.records, r.failed, r.status) for r in FF.file_report(spark, files, parsed).collect()}
    assert report == {"a.gb": (3, 0, "success"), "b.GBK": (1, 0, "success"), "empty.gb": (0, 0, "empty"), "bad.gb": (1, 1, "failed")}
    assert rows(FF.run_summary(FF.file_report(spark, files, parsed)))[0][0] == "empty"


def test_tables(spark, tmp_path):
    (tmp_path / "t.csv").write_text('Locus ID, b ,c\n1,"x ""y""",NA\n2,,"two\nlines"\n')
    (tmp_path / "t.tsv").write_text("a\tb\n1\t2\n")
    df = T.read_table(spark, str(tmp_path / "t.csv"))
    assert [tuple(r) for r in df.collect()] == [("1", 'x "y"', None), ("2", None, "two\nlines")] and df.columns == ["Locus ID", "b", "c"]
    assert T.read_table(spark, str(tmp_path / "t.tsv")).count() == 1
    with pytest.raises(T.UnsupportedFormatError):
        T.read_table(spark, "x.json")
    assert issubclass(T.UnsupportedFormatError, T.EngineError) and issubclass(T.PipelineStepError, T.EngineError)
    assert T.resolve(df, "locus_id") == "Locus ID" and T.resolve(df, "B") == "b" and T.resolve(df, "zz") is None
    assert T.normalised_names(["Organism", "organism", "a b"]) == ["organism", "organism__dup1", "a_b"]
    assert T.project(df, ["locus_id", "LOCUS ID", "nope", "c"]).columns == ["Locus ID", "c"] and T.reordered(df, ["c", "q"]).columns == ["c", "Locus ID", "b"]
    assert T.checked_columns(df, ["b"], ["new"]).first()["new"] == ""
    with pytest.raises(T.PipelineStepError):
        T.checked_columns(df, ["zz"])
    out = T.write_table(df.where("c is null"), str(tmp_path / "o.csv"), single=True)
    assert T.valid_output(spark, out) and not T.valid_output(spark, str(tmp_path / "none")) and T.read_table(spark, out).first()["b"] == 'x "y"'


def test_pipeline_resume_skip_and_reports(spark, files, tmp_path):
    out = str(tmp_path / "run")
    result = P.run(spark, files, out)
    assert result.success and result.steps_completed == list(P.STEPS)
    table = {r.species_voucher_new: r for r in result.steps["organize"].table.collect()}
    # the short record is below the length range; a circular one is the whole genome only if nothing else matched
    assert table["Cus_dus_AB000002"]["28s"] == "" and set(table) == {"Cus_dus_AB000002", "Cus_dus_AB000004"}
    again = P.run(spark, "/nowhere", out, resume=True)
    assert again.success and all(s.resumed for s in again.steps.values())
    assert not P.run(spark, files, str(tmp_path / "other"), skip=("extract",)).success
    P.write_reports(result, str(tmp_path / "reports"))
    P.write_gene_tables(result.steps["classify"].table, str(tmp_path / "genes"))
    assert T.valid_output(spark, str(tmp_path / "genes"))


def test_command_line(files, tmp_path, capsys):
    assert main([files, str(tmp_path / "o"), "--mode", "all", "--haplotype", "no"]) == 0
    assert "extract, classify, voucher, organize" in capsys.readouterr().out
    assert flag("Yes") and not flag("off")
    with pytest.raises(Exception, match="yes or no"):
        flag("maybe")


def test_stream(spark, tmp_path):
    from specimatrix.streaming.folder import classify_available, classified_stream, start

    schema = "row_id bigint, locusid string, definition string, seq_length string, organelle string, moleculetype string, topology string, pcr_primers string"
    df = spark.createDataFrame([(1, "L1", "COI gene", "600", "mitochondrion", "DNA", "linear", None), (2, "L2", "x", "10", None, None, None, None)], schema)
    folder, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    df.write.parquet(folder)
    assert [tuple(r)[:3] for r in classify_available(spark, folder).collect()] == [(1, "coi", "first_match")]
    for _ in range(2):  # what was read is not read again
        start(classified_stream(spark, folder, df.schema).select("row_id"), out, mark).awaitTermination()
    assert spark.read.parquet(out).count() == 1
    df.write.mode("append").parquet(folder)
    start(classified_stream(spark, folder, df.schema).select("row_id"), out, mark).awaitTermination()
    assert spark.read.parquet(out).count() == 2


def test_stream_equals_batch_with_repeated_loci(spark, tmp_path, rows):
    from specimatrix.operators.classify import DIAGNOSTICS, first_round
    from specimatrix.streaming.folder import classified_stream, classify_available, start

    schema = "row_id bigint, locusid string, definition string, seq_length string, organelle string, moleculetype string, topology string, pcr_primers string, loaded_at timestamp"
    data = [(i, f"L{i % 7}" if i % 5 else None, ["COI gene", "16S ribosomal RNA", "x", "cytb"][i % 4], str(100 + 50 * i), "mitochondrion" if i % 3 else None, "DNA", "linear", None, datetime(2024, 1, 1)) for i in range(60)]
    df, folder = spark.createDataFrame(data, schema), str(tmp_path / "in")
    df.orderBy("seq_length").repartition(5).write.parquet(folder)
    assert rows(classify_available(spark, folder)) == rows(first_round(df).select("row_id", *DIAGNOSTICS))
    out = str(tmp_path / "out")
    start(classified_stream(spark, folder, df.schema, event_time="loaded_at").select("locusid"), out, str(tmp_path / "mark")).awaitTermination()
    assert spark.read.parquet(out).where("locusid is not null").count() == 7


def test_scratch(spark):
    df = cut(spark.range(5).withColumn("x", F.lit("a")))
    assert df.count() == 5
    clear_scratch(spark)
    with pytest.raises(Exception, match="."):
        spark.read.parquet(df.inputFiles()[0])


def test_failed_records_and_files(spark, tmp_path, rows):
    """Errors, tracking, totals, archive: what could not be read is told, not dropped."""
    from specimatrix.operators.classify import Rules
    from specimatrix.plans.pipeline import run
    from specimatrix.sources import flatfile as FF

    record = lambda i: f"LOCUS       A{i}  5 bp    DNA     linear   INV 01-JAN-2020\nDEFINITION  COI gene.\nACCESSION   A{i}\nVERSION     A{i}.1\nFEATURES             Location/Qualifiers\n     source          1..5\n                     /organism=\"Aus bus\"\nORIGIN\n        1 acgta\n//\n"
    home = tmp_path / "in"
    (home / "sub").mkdir(parents=True)
    (home / "a.gb").write_text(record(1) + "no locus here\nDEFINITION  x\n//\n" + record(2))
    (home / "bad.GB").write_text("nothing\n//\n")
    (home / "sub" / "bad.GB").write_text("nothing\n//\n")
    (home / "late.gb").write_text("junk\n//\n" + record(3))
    (home / "empty.gbk").write_text("")
    (home / "notes.txt").write_text("x")
    found = FF.discover(spark, [str(home), str(tmp_path / "lost")])
    assert (found.total, found.skipped, found.missing) == (6, 1, (str(tmp_path / "lost"),)) and found.files.count() == 5
    short = Rules(overall="1:50000", mito_length="1:50000", nuclear_length="1:50000")
    result = run(spark, [str(home)], str(tmp_path / "out"), csv=True, rules=short)
    assert result.success and result.steps["extract"].table.count() == 3
    errors = spark.read.csv(str(tmp_path / "out/extract_reports/record_errors"), header=True)
    assert rows(errors, "file_name", "record_index", "error_message") == [("a.gb", "2", "no LOCUS line"), ("bad.GB", "1", "no LOCUS line"), ("bad.GB", "1", "no LOCUS line"), ("late.gb", "1", "no LOCUS line")]
    tracked = spark.read.csv(str(tmp_path / "out/extract_reports/record_tracking"), header=True)
    assert tracked.count() == 7 and [tuple(r) for r in tracked.where("file_name = 'a.gb'").orderBy("record_index").select("record_index", "accession", "metadata_ok").collect()] == [("1", "A1", "true"), ("2", None, "false"), ("3", "A2", "true")]
    files = {r.file_path.rsplit("/", 1)[1]: (r.status, r.error) for r in spark.read.json(str(tmp_path / "out/extract_reports/files")).collect()}
    assert files == {"a.gb": ("partial", ""), "bad.GB": ("failed", "does not start with LOCUS"), "late.gb": ("invalid", "does not start with LOCUS"), "empty.gbk": ("empty", "empty file")}
    totals = spark.read.json(str(tmp_path / "out/extract_reports/totals")).first()
    assert (totals.files, totals.records, totals.failed_records, totals.assemblies) == (5, 7, 4, 0) and totals.records_per_second > 0
    assert sorted(p.name for p in (tmp_path / "out/extract_reports/failed_extract").iterdir() if not p.name.startswith(".")) == ["bad.GB", "bad_1.GB", "empty.gbk", "late.gb"]
    keys = [r[0] for r in spark.read.parquet(str(tmp_path / "out/organize")).select("species_voucher_new").collect()]
    assert keys == sorted(keys) and len(keys) == 3
    changed = run(spark, str(home), each=lambda df: df.where("locus_id != 'A1.1'"))
    assert changed.steps["extract"].table.count() == 2


def test_tables_of_markers_have_safe_names(spark, tmp_path):
    from specimatrix.plans.pipeline import write_gene_tables

    df = spark.createDataFrame([(1, "coi,18s/x y"), (2, "18-28s")], "row_id bigint, gene_type string")
    write_gene_tables(df, str(tmp_path / "genes"))
    assert sorted(p.name for p in (tmp_path / "genes").iterdir() if p.is_dir()) == ["gene=18-28s", "gene=18s_x_y", "gene=coi"]


def test_dictionary_by_uri(spark, tmp_path):
    from specimatrix.functions.phrases import load_dictionary

    (tmp_path / "d.txt").write_text("coi: CO I, COI\n# note: x\nnad5: ND5\n")
    assert load_dictionary(f"file://{tmp_path}/d.txt") == load_dictionary(str(tmp_path / "d.txt")) == {"coi": ("CO I", "COI"), "nad5": ("ND5",)}


def test_steps_of_the_command_line(spark, tmp_path):
    from specimatrix.cli import lacking, main

    (tmp_path / "final.csv").write_text("row_id,locusid,accession,definition,seq_length,organelle,moleculetype,topology,organism,specimen_voucher,isolate\n1,L1,A1,COI gene,600,mitochondrion,DNA,linear,Aus bus,V 1,\n2,L2,A2,16S ribosomal RNA,500,mitochondrion,DNA,linear,Aus bus,V 1,\n3,L3,A3,nothing,500,,DNA,linear,Aus cus,,i\n")
    out = str(tmp_path / "o")
    assert main(["classify", str(tmp_path / "final.csv"), out, "--genes", "coi", "--gene-length", "16s=501:900", "--recheck", "no"]) == 0
    done = spark.read.parquet(f"{out}/assigned_genes_types_all")
    assert [r.gene_type for r in done.collect()] == ["coi"] and spark.read.csv(f"{out}/unmatched_sequences", header=True).count() == 2
    assert main(["classify", str(tmp_path / "final.csv"), out, "--mitochondrial", "coi,16s", "--reasons", "no"]) == 0
    assert main(["voucher", f"{out}/assigned_genes_types_all", out, "--combine", "pse_only"]) == 0
    assert {r.species_voucher_new for r in spark.read.parquet(f"{out}/updated_species_voucher").collect()} == {"V_1"}
    assert spark.read.parquet(f"{out}/species_voucher_groups").count() == 2
    assert main(["organize", f"{out}/updated_species_voucher", out, "--genes", "coi,16s", "--metadata", "isolate", "--mode", "all"]) == 0
    row = spark.read.csv(f"{out}/organized_species_voucher.csv", header=True).first()
    assert (row.species_voucher_new, row.coi, row["16s"]) == ("V_1", "L1", "L2")
    assert lacking()[0] == []


def test_sizes_newest_and_dictionaries(spark, tmp_path):
    import os

    from specimatrix.functions.phrases import extended, load_dictionary, read_synonyms, write_yaml
    from specimatrix.sources.tables import format_size, newest

    assert [format_size(x) for x in (None, 0, 1023, 1536, 5 * 1024**6)] == ["0.0 B", "0.0 B", "1023.0 B", "1.5 KB", "5120.0 PB"]
    for k, (name, text) in enumerate((("a.csv", "x"), ("b.csv", "y"), ("c.csv", ""))):
        (tmp_path / name).write_text(text)
        os.utime(tmp_path / name, (k, k))
    assert newest(spark, str(tmp_path / "*.csv")).endswith("b.csv") and newest(spark, str(tmp_path / "*.tsv")) is None
    (tmp_path / "ND5.tsv").write_text("Full Name\tx\nNADH dehydrogenase 5\t1\nND\t2\nnadh Dehydrogenase 5\t3\n\t4\n")
    names = read_synonyms(str(tmp_path / "ND5.tsv"))
    assert names == ["NADH dehydrogenase 5", "nadh Dehydrogenase 5"]
    d = extended({"coi": ("COI", "CO", "coi gene"), "h3": ("histone H3",), "zz": ("zzz",)}, {"coi": ["coi", "COX1: a"], "nd5": names}, {"COI": ["plastid coi"], "rbcL": ["rbcL", "I"], "matK": ["mat \"K\" gene"]})
    assert {m: (x["category"], x["synonyms"]) for m, x in d.items()} == {"coi": ("mitochondrial", ("COI", "coi gene", "COX1: a")), "h3": ("nuclear", ("histone H3",)), "zz": ("unknown", ("zzz",)), "nd5": ("mitochondrial", ("NADH dehydrogenase 5",)), "cp_coi": ("chloroplast", ("plastid coi",)), "matk": ("chloroplast", ('mat "K" gene',))}
    path = write_yaml(d, str(tmp_path / "d.yaml"))
    assert list(load_dictionary(path)) == ["coi", "nd5", "cp_coi", "matk", "h3", "zz"] and {m: x["synonyms"] for m, x in d.items()} == load_dictionary(path)
