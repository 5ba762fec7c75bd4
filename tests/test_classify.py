"""The rule engine: pinned examples, and a row-at-a-time version written from the rules, over random records."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from specimatrix.functions.phrases import DICTIONARY, MITOCHONDRIAL, NUCLEAR, any_pattern, as_table, has_any, load_dictionary, merge, phrase_join, telling
from specimatrix.operators import classify as C
from specimatrix.sources.tables import UnsupportedFormatError

SCHEMA = "row_id bigint, locusid string, definition string, seq_length string, organelle string, moleculetype string, topology string, pcr_primers string"


def records(spark, *tuples):
    return spark.createDataFrame([(i, f"L{i}", *t) for i, t in enumerate(tuples)], SCHEMA)


def row(definition, length="650 bp", organelle=None, molecule="DNA", topology="linear", primers=None):
    return (definition, length, organelle, molecule, topology, primers)


def genes(df):
    return {r.row_id: r.gene_type for r in df.collect()}


def test_pinned_records(spark):
    mito = "mitochondrion"
    df = records(
        spark,
        row("Aus bus cytochrome c oxidase subunit I (COI) gene", organelle=mito),
        row("Aus bus 18S ribosomal RNA gene", "1800", "nucleus"),
        row("unknown stuff"),
        row("Aus bus mitochondrion, complete genome, COI", "16000 bp", mito),
        row("Aus bus coincidence gene", organelle=mito),
        row("18S ribosomal RNA gene, complete sequence; and 28S ribosomal RNA gene, partial sequence", "8000"),
        row("COI, 16S ribosomal RNA, 12S rRNA", "5000", mito),
        row("12S ribosomal RNA large subunit ribosomal", "600", mito),
    )
    got = {r.row_id: r for r in C.first_round(df).collect()}
    assert [got[i].gene_type for i in range(8)] == ["coi", "18s", "", "mtgenome", "", "18-28s", "mtgenome", "12s"]
    assert got[6].match_source == "first_match -> conflict_check" and got[6].original_match == "12s,16s,coi" and not got[6].has_conflict
    assert got[7].has_conflict and got[7].conflict_reason == "12s conflicts with 'large subunit ribosomal' description"
    assert got[3].assignment_reason.startswith("mtgenome: priority match hit; [conflict check] Special type")


def test_second_round(spark):
    df = records(spark, row("nothing", topology="Circular"), row("nothing", primers="fwd_name: LCO1490, rev_name: HCO2198"), row("mitochondrial cytochrome b", organelle=None), row("x", "100 bp"), row("x", None))
    two = {r.row_id: r for r in C.round_two(df).collect()}
    assert two[0].gene_type == "mtgenome" and two[1].gene_type == "coi" and two[2].gene_type == "cob"
    assert "no mitochondrial marker" in two[1].conflict_reason and set(two) == {0, 1, 2}


def test_lengths_and_filters(spark):
    df = records(spark, row("a", "650 bp"), row("a", " 650  bp"), row("a", "650"), row("a", ""), row("a", None), row("a", "149"), row("a", "50001 bp"))
    assert sorted(r.row_id for r in C.overall_length(df, C.Rules()).collect()) == [0, 1, 2]
    assert C.interval("100:500") == (100, 500) and C.interval("100,") == (100, None) and C.interval(":9") == (None, 9) and C.interval("none") == C.interval("") == (None, None)
    assert C.attribute_filter(df, molecule="dna", columns=("moleculetype", "moleculetype", "seq_length", "organelle")).count() == 7


def test_keep_first_with_null_keys_and_repartitioning(spark):
    df = spark.createDataFrame([(3, "a"), (1, "a"), (2, None), (5, None), (4, "b")], "row_id bigint, locusid string")
    for n in (1, 4, 16):
        assert sorted(r.row_id for r in C.keep_first(df.repartition(n), "locusid", "row_id").collect()) == [1, 2, 4]


@pytest.mark.parametrize(("text", "name"), [("whole genome shotgun", "whole_genome_shotgun"), ("scaffold 1", "scaffold"), ("tRNA-Leu", "tRNA"), ("rRNA mitochondrial", "other"), ("NADH", "NADH_dehydrogenase"), (None, "other")])
def test_categories(spark, text, name):
    assert spark.createDataFrame([(text,)], "d string").select(C.category(F.col("d"))).first()[0] == name


def plain_hits(text):
    def one(p):
        p = p.lower()
        left = r"\b" if re.match(r"\w", p) else r"(?:(?<=\s)|^)"
        right = r"\b" if re.match(r"\w", p[-1]) else r"(?=\s|$)"
        return re.search(left + re.escape(p) + right, text)

    return {g for g, ps in DICTIONARY.items() if any(one(p) for p in ps)}


def plain_first(d, n, mito):
    hits, group = plain_hits(d), MITOCHONDRIAL if mito else NUCLEAR
    lengths = {"mtgenome": (3000, 500000), "18-28s": (5000, 15000)}
    fits = lambda g: g not in lengths or lengths[g][0] <= n <= lengths[g][1]
    for g in ["mtgenome"] if mito else ["18-28s", "its1-its2"]:
        if g in hits and fits(g) and not (g == "mtgenome" and n <= 3000):
            return [g]
    found = sorted(g for g in group if g in hits and g not in ("mtgenome", "18-28s", "its1-its2") and fits(g))
    if mito and len(found) > 2 and n > 3000:
        return ["mtgenome"]
    if mito and (len(found) > 2 or (len(found) == 2 and ("trna" in d or "complete sequence" in d))):
        return found
    for g in found:
        if (g == "12s" and "large subunit ribosomal" in d) or (g == "16s" and "small subunit ribosomal" in d) or (g in ("18s", "28s") and "mitochondrial" in d):
            return [g]
    return found


def test_random_records_against_the_rules_row_by_row(spark):
    rng = random.Random(5)
    phrases = [p for ps in DICTIONARY.values() for p in ps] + ["tRNA", "complete sequence", "mitochondrial", "large subunit ribosomal", "small subunit ribosomal", "gene", "Ünïcode"]
    data = []
    for _ in range(400):
        data.append(row(" ".join(rng.sample(phrases, rng.randint(0, 4))), f"{rng.choice([150, 700, 900, 3000, 3001, 6000, 20000])} bp", rng.choice(["mitochondrion", None])))
    df = records(spark, *data)
    got = genes(C.round_one(df))
    wrong = [(data[i], got[i], plain_first(d.lower().strip(), int(n[:-3]), o is not None)) for i, (d, n, o, *_) in enumerate(data) if got[i] != ",".join(plain_first(d.lower().strip(), int(n[:-3]), o is not None))]
    assert not wrong
    texts = spark.createDataFrame([(i, d[0].lower()) for i, d in enumerate(data)], "row_id bigint, definition string")
    flags = texts.select("row_id", *[has_any(F.col("definition"), ps).alias(g) for g, ps in DICTIONARY.items()]).collect()
    joined = {(r.row_id, r.marker) for r in phrase_join(texts, as_table(spark, DICTIONARY)).collect()}
    brute = {(i, g) for i, d in enumerate(data) for g in plain_hits(d[0].lower())}
    assert {(r.row_id, g) for r in flags for g in DICTIONARY if r[g]} == brute == joined


def test_dictionaries(spark, tmp_path):
    (tmp_path / "a.txt").write_text("# note\nCOI: new phrase, coi\nnd1: nad1\n")
    (tmp_path / "a.csv").write_text("gene,synonyms\nnd1,\"nad1, nd-1\"\n")
    (tmp_path / "a.yaml").write_text("gene_types:\n  nd1:\n    synonyms:\n      - nad1\n")
    (tmp_path / "a.py").write_text("gene_dict = {}")
    merged = merge(DICTIONARY, load_dictionary(str(tmp_path / "a.txt")))
    assert "new phrase" in merged["coi"] and merged["nd1"] == ("nad1",) and len(merged["coi"]) == len(DICTIONARY["coi"]) + 1
    assert load_dictionary(str(tmp_path / "a.csv")) == {"nd1": ("nad1", "nd-1")} and load_dictionary(str(tmp_path / "a.yaml")) == {"nd1": ("nad1",)}
    with pytest.raises(UnsupportedFormatError):
        load_dictionary(str(tmp_path / "a.py"))
    assert telling(["coi", "the coi gene", "coix"]) == ["coi", "coix"] and any_pattern([]) == "(?!)"


def test_gene_lists(spark):
    df = spark.createDataFrame([(1, "coi, 16s"), (2, "coi"), (3, ""), (4, None)], "row_id bigint, gene_type string")
    assert {r.gene for r in C.gene_list(df).collect()} == {"coi", "16s"} and C.gene_rows(df, ["coi"]).count() == 2
    assert C.file_name("18-28s/x y") == "18-28s_x_y"
