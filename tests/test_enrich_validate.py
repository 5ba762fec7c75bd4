"""Enrichment forms and validation joins on small fixtures."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from specimatrix.operators import enrich as E
from specimatrix.operators import reports as R
from specimatrix.operators import validate as V


@pytest.mark.parametrize(("raw", "out"), [("1993", "1993"), ("Dec 2000", "Dec-2000"), ("08-Nov-2005", "08-Nov-2005"), ("8 Apr. 2009", "08-Apr-2009"), ("8 april 2009", "08-Apr-2009"), ("18-20 Apr 2012", "18-Apr-2012"), ("Jul-Aug 2012", "Jul-2012"), (" nan ", ""), (None, ""), ("sometime", "sometime")])
def test_dates(spark, raw, out):
    assert spark.createDataFrame([(raw,)], "s string").select(E.submission_date(F.col("s"))).first()[0] == out


@pytest.mark.parametrize(("raw", "out"), [("SMNH 211581", "SMNH:211581"), ("SMNH:1", "SMNH:1"), ("NSMT An-1 Holotype", "NSMT:An-1"), ("RBINS IG 3", "RBINS:IG 3"), ("no voucher", ""), (None, ""), ("single", "single")])
def test_voucher_forms(spark, raw, out):
    assert spark.createDataFrame([(raw,)], "s string").select(E.submission_voucher(F.col("s"))).first()[0] == out


def test_places_and_positions(spark):
    df = spark.createDataFrame([("57.68", "11.96", "Norway", " ", "Oslo"), (None, "1", "nan", None, None), ("-1.5", "-2", "Peru", "x", None)], "n string, e string, c string, s string, l string")
    assert [r[0] for r in df.select(E.lat_lon(F.col("n"), F.col("e"))).collect()] == ["57.6800 N 11.9600 E", "", "1.5000 S 2.0000 W"]
    assert [r[0] for r in df.select(E.geo_name(F.col("c"), F.col("s"), F.col("l"))).collect()] == ["Norway: Oslo", "", "Peru: x"]


def test_fill_update_and_unpivot(spark, rows):
    own = spark.createDataFrame([(1, "a", None, "x"), (2, "b", " ", "y"), (3, "c", "kept", "z")], "row_id bigint, accession string, country string, isolate string")
    other = spark.createDataFrame([(2, "a", "late"), (1, "a", "first"), (1, "c", "no")], "o bigint, accession string, country string")
    assert rows(E.fill_only_empty(own, other, "accession", ["country"], "o"), "row_id", "country") == [(1, "first"), (2, ""), (3, "kept")]
    wide = spark.createDataFrame([("s", "A1", None), ("t", " ", "B2")], "id string, coi string, `18-28s` string")
    assert rows(E.unpivot_markers(wide, ["id"], ["coi", "18-28s"])) == [("s", "coi", "A1"), ("t", "18-28s", "B2")]
    lit = spark.createDataFrame([(1, "A1", "Peru", "S", None, None, "1", "2", "8 Apr 2009", "Doe", "X 1", "mud"), (2, "A2", "Peru", None, None, None, None, None, None, None, None, None)], "o bigint, accession string, country string, state string, municipality string, locality string, n string, e string, coll_date string, leg string, voucher string, habitat string")
    state = spark.createDataFrame([(1, "A1", None, None, None, None, None, "iso", None), (1, "A2", "Chile", "1", "2000", "R", "v", None, "m")], "o bigint, accession string, geo_loc_name string, lat_lon string, collection_date string, collected_by string, specimen_voucher string, isolate string, isolation_source string")
    assert rows(E.update_rows(lit, state, "o")) == [("A1", "Peru: S", "1.0000 N 2.0000 E", "08-Apr-2009", "Doe", "", "mud")]


def test_validation(spark, rows):
    expected = spark.createDataFrame([("A1", "coi", "Aus bus"), ("A2.1", "coi", "Aus bus"), ("A3", "16s", "Aus bus"), ("A4", "16s", "Aus bus"), ("A5", "16s", "Aus bus")], "accession string, gene string, species string")
    assigned = spark.createDataFrame([(1, "A1.1", "A1", "coi", "Aus cus"), (2, "A2.1", "A2", "16s", "Aus"), (3, "A3.1", "A3", "16s", "Cus")], "row_id bigint, locusid string, accession string, gene_type string, organism string")
    extracted = spark.createDataFrame([("A4.1", "A4")], "locusid string, accession string")
    got = V.validated(expected, assigned, extracted)
    assert rows(got, "accession", "status") == [("A1", "OK"), ("A2.1", "GENE_MISMATCH"), ("A3", "SPECIES_MISMATCH"), ("A4", "UNCLASSIFIED"), ("A5", "MISSING")]
    assert rows(V.validation_rollup(got), "gene", "expected", "ok", "accuracy") == [("16s", 3, 0, 0.0), ("coi", 2, 1, 50.0)]


def test_species_and_accessions(spark, rows):
    names = spark.createDataFrame([("Aus bus Han, 2023",), ("Aus busella",), ("Old bus",), ("Aus cf. zus",), ("Nix nix",)], "name string")
    organisms = spark.createDataFrame([("Aus bus",), ("Aus buselina",), ("New bus",)], "organism string")
    remap = spark.createDataFrame([("old", "bus", "new")], "genus string, epithet string, new_genus string")
    assert rows(V.match_species(names, organisms, remap)) == [("Aus bus Han, 2023", "Aus bus", "exact"), ("Aus busella", "Aus buselina", "prefix"), ("Aus cf. zus", None, "none"), ("Nix nix", None, "none"), ("Old bus", "New bus", "remap")]
    wanted = spark.createDataFrame([("*a1.2",), ("a2",), ("zz",)], "accession string")
    records = spark.createDataFrame([("A1.2", "A1", "one"), ("A2.1", "A2", "two")], "locusid string, accession string, organism string")
    assert rows(V.find_accessions(wanted, records)) == [("*a1.2", "one"), ("a2", "two"), ("zz", "")]
    cell = spark.createDataFrame([("A1.1;B2",)], "c string")
    assert cell.select(V.accession_in(F.col("c"), F.lit("A1")), V.accession_in(F.col("c"), F.lit("B"))).first()[:] == (True, False)


def test_difference_and_reports(spark, rows):
    old = spark.createDataFrame([(1, "a", None), (2, "b", "x")], "k bigint, v string, w string")
    new = spark.createDataFrame([(1, "c", None), (3, "b", "x")], "k bigint, v string, z string")
    assert rows(V.table_diff(old, new, "k")) == [(1, "v", "a", "c"), (2, "<row>", "present", "absent"), (3, "<row>", "absent", "present")]
    left = spark.createDataFrame([(i, c, "d" * 200) for i, c in enumerate("aaab")], "row_id bigint, category string, definition string")
    counts = R.category_counts(left)
    assert rows(counts) == [("a", 3, 75.0), ("b", 1, 25.0)] and [r.value for r in R.report_lines(counts).collect()] == ["a: 3 (75.0%)", "b: 1 (25.0%)"]
    assert len(R.category_samples(left, top=1, each=2).collect()) == 2 and len(R.category_samples(left).first()["sample"]) == 100


def test_literature_and_update(spark, tmp_path):
    from specimatrix.operators import enrich as E

    line = lambda sp, **k: ",".join(k.get(c, "") if c != "species" else sp for c in E.LITERATURE)
    (tmp_path / "sheet.csv").write_text("\n".join(["title", ",,", "", "Species,No", "units", line("Aus bus", country="Peru", coll_date="8 April 2009", voucher="ZM 5", coi="C2", **{"16s": "C1"}), line("Cus dus", country="Chile", coi="C2"), line("Eus", coi="nan")]) + "\n")
    sheet = E.read_literature(spark, str(tmp_path / "sheet.csv"))
    assert [r.species for r in sheet.orderBy("row_id").collect()] == ["Aus bus", "Cus dus", "Eus"]
    lit = E.literature_accessions(sheet)
    assert {(r.accession, r.marker, r.country) for r in lit.collect()} == {("C1", "16s", "Peru"), ("C2", "coi", "Peru")}
    schema = "row_id bigint, accession string, geo_loc_name string, lat_lon string, collection_date string, collected_by string, specimen_voucher string, isolate string, isolation_source string"
    records = spark.createDataFrame([(1, "C2", None, None, None, None, None, None, None), (2, "C1", None, None, "2001", None, "v", None, None)], schema)
    updates = E.update_rows(lit, records, "row_id")
    counts = E.update_counts(updates).first()
    assert (counts.updated, counts.geo_loc_name, counts.collection_date, counts.specimen_voucher, counts.lat_lon) == (2, 2, 1, 1, 0)
    path = E.write_update(updates.repartition(3), str(tmp_path / "update"))
    lines = [line.value for line in spark.read.text(path).collect() if not line.value.startswith("acc. num.")]
    assert lines == ["C1\tPeru\t\t\t\t\t", "C2\tPeru\t\t08-Apr-2009\t\tZM:5\t"]


def test_species_names_word_by_word(spark):
    from pyspark.sql import functions as F

    from specimatrix.operators import validate as V

    names = {"Aus bus": "aus bus", "Aus cf. bus": "aus bus", "Aus bus Han, 2023": "aus bus", "Aus bus Han, Zhou & Wang, 2023": "aus bus", "Aus (Bus) cus (Linnaeus, 1758)": "aus (bus) cus", "Aus sp. nov. 3": "aus", "Gen. nov. aus": "aus", "Aus bus sensu Smith": "aus bus", "Aus sp. 3": "aus sp. 3", "  Aus   bus ": "aus bus", "": "", "Aus Bus": "aus bus"}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r.n: r.k for r in df.select("n", V.species_key(F.col("n")).alias("k")).collect()} == names
    pairs = [("Aus gen. et sp. n.", "Aus sp.", "new name, provisional in the record"), ("Insulidrilus a", "Insulodrilus a", "spelling"), ("Aus cf. bus", "Aus bus", "cf. only"), ("Aus bus", "Cus dus", "another species")]
    got = spark.createDataFrame(pairs, "e string, f string, r string").select("r", V.mismatch_reason(F.col("e"), F.col("f"), (("insulidrilus", "insulodrilus"),)).alias("g")).collect()
    assert all(r.r == r.g for r in got)


def test_species_report_and_verdicts(spark):
    from specimatrix.operators import validate as V

    expected = spark.createDataFrame([("Aus bus", "coi", "A1.1"), ("Aus bus", "16s", "A2"), ("Cus dus Han, 2020", "coi", "B1*"), ("Eus fus", "coi", "-"), ("Gus hus", "coi", "Z9*"), ("Olda kus", "coi", "K1"), ("Ius jus", "16s", "M1")], "species string, gene string, accession string")
    matrix = spark.createDataFrame([("Aus bus", "A1;A3", "A2", ""), ("Cus dus", "", "", "B1"), ("Kus lus", "K1", "", ""), ("Ius jus", "J1", "", "")], "organism string, coi string, `16s` string, mtgenome string")
    records = spark.createDataFrame([("K1.1", "K1", "Kus lus", "coi"), ("A1", "A1", "Aus bus", "coi"), ("A2", "A2", "Aus bus", "16s"), ("J1", "J1", "Ius jus", "coi")], "locusid string, accession string, organism string, gene_type string")
    report = V.species_report(expected, matrix, records)
    assert {r.species: (r.organism, r.method, r.expected, r.covered, r.right, r.filled, r.status) for r in report.collect()} == {
        "Aus bus": ("Aus bus", "exact", 2, 2, 2, 0, "MATCH"), "Cus dus Han, 2020": ("Cus dus", "exact", 1, 1, 1, 1, "MATCH"), "Eus fus": (None, "none", 0, 0, 0, 0, "NO_LIT_DATA"),
        "Gus hus": (None, "none", 1, 0, 0, 0, "NOT_FOUND"), "Olda kus": ("Kus lus", "accession_lookup", 1, 1, 1, 0, "MATCH"), "Ius jus": ("Ius jus", "exact", 1, 0, 0, 0, "PARTIAL"),
    }
    assert {r.status: r.percent for r in V.report_rates(report).collect()} == {"MATCH": 50.0, "NO_LIT_DATA": 16.7, "NOT_FOUND": 16.7, "PARTIAL": 16.7}
    verdicts = V.species_verdicts(expected.where("accession != 'A1.1'"), records)
    assert {r.species: r.verdict for r in verdicts.collect()} == {"Aus bus": "same", "Cus dus Han, 2020": "not found", "Eus fus": "no data", "Gus hus": "not found", "Olda kus": "not found", "Ius jus": "different"}
