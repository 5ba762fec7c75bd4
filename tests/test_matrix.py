"""Vouchers and the matrix: pinned examples, hand-computed metadata texts, and invariance under repartitioning."""

from __future__ import annotations

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from specimatrix.operators import matrix as M
from specimatrix.operators import voucher as K

SCHEMA = "row_id bigint, species_voucher_new string, organism string, gene_type string, locusid string, country string, host string"
RULES = M.MatrixRules(metadata=("country", "host"), tail=("taxonid",))


def cells(df, key):
    return df.where(F.col("species_voucher_new") == key).first().asDict()


@pytest.fixture(scope="module")
def specimens(spark):
    return spark.createDataFrame(
        [
            (2, "v1", "Aus bus", "16s", "B1", "Peru", None),
            (1, "v1", " ", "coi", "A1", " ", "crab"),
            (3, "v1", "Aus cus", "coi,16s", "C1", "Peru; Chile", None),
            (4, "v1", None, "coi#, coi??", "A1", "Chile", None),
            (5, "v1", None, "mtgenome", "NC_1", None, None),
            (6, "v1", None, "mtgenome", "M2", None, None),
            (7, None, None, "h3", "H1", "Oman", None),
            (8, "v2", None, "18-28s", "R1", "Togo", None),
            (9, "v2", None, "18s", "S1", "Togo", None),
            (10, "v2", None, "actin", "X1", "Mali", None),
            (11, "v2", None, None, "Y1", None, None),
            (12, "v2", None, "28s", " ", None, None),
        ],
        SCHEMA,
    )


def test_lists_order_propagation_and_unknown_group(specimens):
    for n in (1, 4, 16):
        out = M.matrix(specimens.repartition(n), RULES)
        v1, v2, none = cells(out, "v1"), cells(out, "v2"), cells(out, "UNKNOWN")
        assert v1["coi"] == "A1;C1;NC_1;M2" and v1["16s"] == "B1;C1;NC_1;M2" and v1["12s"] == "NC_1;M2" and v1["mtgenome"] == "NC_1;M2"
        assert v1["organism"] == "Aus bus" and v1["country"] == "Peru" and v1["host"] == "crab" and v1["taxonid"] == ""
        assert v2["18s"] == "S1;R1" and v2["28s"] == "R1" and v2["its1-its2"] == "R1" and v2["coi"] == "" and none["h3"] == "H1"
    plain = cells(M.matrix(specimens, M.MatrixRules(metadata=(), tail=(), spread_cluster=False, spread_genome=False, prefer_reference=True)), "v1")
    assert plain["mtgenome"] == "NC_1" and plain["coi"] == "A1;C1"
    assert cells(M.coverage(M.matrix(specimens, RULES)).withColumnRenamed("gene", "species_voucher_new"), "coi")["specimens"] == 1


def test_metadata_modes(specimens):
    all_of = cells(M.matrix(specimens, M.MatrixRules(mode="all", tail=())), "v1")
    assert all_of["country"] == "Chile;Peru"
    per = M.matrix(specimens, M.MatrixRules(mode="per_gene", metadata=("country",), tail=()))
    assert cells(per, "v1")["country"] == "coi:Chile;16s:Peru;Peru; Chile" and cells(per, "v2")["country"] == "Togo" and cells(per, "UNKNOWN")["country"] == "Oman"
    advanced = M.matrix(specimens, M.MatrixRules(mode="advanced", metadata=("country",), tail=()))
    # A1: Chile; B1: Peru; C1: Peru, Chile - 16s lists B1, C1; coi lists A1, C1; X1 of v2 has no marker of the matrix
    assert cells(advanced, "v1")["country"] == "Chile;Peru" and cells(advanced, "v2")["country"] == "Mali;18s,28s,18-28s,its1-its2:Togo".replace("18s,28s,18-28s,its1-its2", "18-28s,18s,28s,its1-its2")
    with pytest.raises(ValueError, match="mode"):
        M.matrix(specimens, M.MatrixRules(mode="none"))
    assert M.matrix(specimens.limit(0), RULES).count() == 0


@pytest.mark.parametrize(("text", "clean"), [(None, ""), (" ", ""), ("a b", "a_b"), ("'a\"(b)", "ab"), ("a　b", "a_b"), ("ＡＢ１", "AB1"), ("a<>:./\\|?*b", "a_b"), ("__a__b__", "a_b"), ("Ünï", "Ünï")])
def test_sanitize(spark, text, clean):
    assert spark.createDataFrame([(text,)], "s string").select(K.sanitize(F.col("s"))).first()[0] == clean


def test_vouchers(spark):
    df = spark.createDataFrame([("Aus bus", None, "i1", "A1"), ("Aus bus", "S 1", None, "A2"), (None, None, None, "A3"), ("Aus bus", " ", "i", "A4")], "organism string, specimen_voucher string, isolate string, ACCESSION string")
    out = K.voucher_columns(df).collect()
    assert [r.species_voucher_new for r in out] == ["Aus_bus_i1", "Aus_bus_S_1", "A3", "Aus_bus"] and [r.filled_from for r in out] == ["priority", "priority", "fallback", "priority"]
    assert [r.species_voucher_new for r in K.voucher_columns(df, K.VoucherRules(combine="pse_only")).collect()] == ["i1", "S_1", "A3", ""]
    assert K.voucher_columns(df, K.VoucherRules(combine="pse+species_name")).first().species_voucher_new == "i1_Aus_bus"
    assert K.fill_report(K.voucher_columns(df)).first().asDict() == {"from_priority": 3, "from_haplotype": 0, "from_fallback": 1, "still_empty": 0, "empty_keys": 0}
    with pytest.raises(ValueError, match="combine"):
        K.voucher_columns(df, K.VoucherRules(combine="x"))


def test_frequencies(spark, rows):
    df = spark.createDataFrame([(k,) for k in ["a"] * 3 + ["b"] * 3 + ["c"] + ["d"] * 9 + ["", None]], "species_voucher_new string")
    assert [tuple(r) for r in K.count_of_counts(df).collect()] == [(9, 1), (3, 2), (1, 1)]
    assert rows(K.frequency_groups(df).groupBy("species_voucher_new", "frequency_group").count()) == [("a", 3, 3), ("b", 3, 3)]
    assert [r.value for r in K.count_lines(df).collect()][0] == "9 occurrences: 1"
    assert K.with_haplotype(df).count() == 0


def test_records_without_a_key_as_rows_of_their_own(spark):
    df = spark.createDataFrame([(1, None, "o", "coi", "A1"), (2, None, "o", "coi", "A2"), (3, "k", "o", "coi,16s", "A3")], "row_id bigint, species_voucher_new string, organism string, gene_type string, locusid string")
    for mode in ("first_nonempty", "per_gene", "advanced", "all"):
        rules = M.MatrixRules(genes=("coi", "16s"), metadata=("organism",), tail=(), mode=mode)
        one = {r.species_voucher_new: (r.coi, r["16s"]) for r in M.matrix(df, rules).collect()}
        assert one == {"UNKNOWN": ("A1;A2", ""), "k": ("A3", "A3")}
        each = {r.species_voucher_new: (r.coi, r["16s"]) for r in M.matrix(df, replace(rules, separate_unknown=True)).collect()}
        assert each == {"UNKNOWN 1": ("A1", ""), "UNKNOWN 2": ("A2", ""), "k": ("A3", "A3")}


def test_null_keys_match_nothing(spark, rows):
    from specimatrix.operators.enrich import fill_only_empty

    left = spark.createDataFrame([(None, None), (None, "x"), ("a", None)], "k string, v string")
    other = spark.createDataFrame([(1, None, "n"), (2, "a", "w")], "o bigint, k string, v string")
    assert rows(fill_only_empty(left, other, "k", ["v"], "o")) == sorted([(None, ""), (None, "x"), ("a", "w")], key=str)
