"""Queries over all rows of a small table, against the rules said again in plain Python."""

from __future__ import annotations

import re
import unicodedata

import duckdb
import pytest

import __spark_entry__ as entry


@pytest.fixture
def final(spark, tmp_path):
    """Writes a table ``final`` of these rows and gives its folder."""

    def write(rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "final.parquet"))
        return str(tmp_path)

    return write


def key(text):
    s = unicodedata.normalize("NFKC", (text or "").strip())
    s = re.sub("['\"()]", "", s).replace(" ", "_")
    return re.sub("_+", "_", re.sub(r"[<>:./\\|?*]+", "_", s)).strip("_")


IDENTIFIERS = ["SMNH 1", "KLQN：Pol：117554", "[NHQL　Wet　112856]", "CUVI–Pol–128130", "ＺＭ\xa012", "　（x）＂ﬁ②", "é é", "é 1", "：", None]


def test_identifiers_in_any_script(spark, final):
    rows = [(i, v, "iso" if i % 2 else None, "Aus bus" if i % 3 else None) for i, v in enumerate(IDENTIFIERS * 2)] + [(99, None, None, "Aus bus")]
    rows = [(i, v, iso, None, None, None, None if i in (18, 99) else "AC1", o) for i, v, iso, o in rows]
    base = final(rows, "row_id bigint, specimen_voucher string, isolate string, culture_collection string, clone_name string, strain string, accession string, organism string")
    want = set()
    for i, v, iso, _, _, _, accession, o in rows:
        own = next((x for x in (v, iso, accession) if x is not None), None)
        want.add((i, own, "_".join(filter(None, (key(o), key(own))))))
    got = entry.queries()["q_coalesce_voucher"](spark, base).collect()
    assert len(got) == len(rows) and {tuple(r) for r in got} == want


def voucher(text):
    v = (text or "").strip()
    if v in ("", "nan") or v.lower() == "no voucher":
        return ""
    v = re.sub(r"\s+(Holotype|Paratype)$", "", v, flags=re.IGNORECASE)
    parts = v.split(None, 1)
    return ":".join(parts) if ":" not in v and len(parts) == 2 and parts[0].isalpha() else v


def test_voucher_forms_in_any_script(spark, final):
    texts = [*IDENTIFIERS, "GWPX　114089", "ZMÅ 12 b　Holotype", " nan　", "No Voucher ", "ZMUC 1 paratype", "É：1 x", "Музей 7", "A1　2", "ZM  3"]
    base = final(list(enumerate(texts)), "row_id bigint, specimen_voucher string")
    got = dict(map(tuple, entry.queries()["q_voucher_format"](spark, base).collect()))
    assert got == {i: voucher(t) for i, t in enumerate(texts)}
    assert got[len(IDENTIFIERS)] == "GWPX:114089"


def test_dates_with_any_words(spark, final):
    forms = {"8 april 2009": "08-Apr-2009", "12 Sept. 2001": "12-Sep-2001", "3-5 September 2012": "03-Sep-2012", "7 viii 2018": "07-Viii-2018", "23 VI 2012": "23-Vi-2012", "24-III-2010": "24-III-2010", "23.viii.1994": "23.viii.1994", "October 2019": "October 2019", "November 25, 1997": "November 25, 1997", "not collected": "not collected", "missing": "missing", "DEC 1999": "Dec-1999", "Jul-Aug 2012": "Jul-2012", "1993": "1993", "nan": ""}
    base = final([*enumerate(forms), (99, None)], "row_id bigint, collection_date string")
    got = dict(map(tuple, entry.queries()["q_date_format"](spark, base).collect()))
    assert got == dict(enumerate(forms.values())) | {99: ""}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW final AS SELECT * FROM '{base}/final.parquet/*.parquet'")
    assert got == dict(con.execute(entry.oracle_sql()["q_date_format"]).fetchall())


META = ("country", "geo_loc_name", "lat_lon", "collection_date", "isolate", "specimen_voucher")


def test_modes_over_all_metadata(spark, tmp_path):
    columns = ("row_id", "species_voucher_new", "organism", "gene_type", "locusid", *META, "taxonid")
    rows = [(1, "k", "o", "coi", "A1", "Peru", "Peru: x", "1 N 2 E", "2001", "i1", None, "7"), (2, "k", "o", "16s", "A2", "Peru", "Peru: y", None, "2002", "i1", "v", "7"), (3, "k", "o", None, "A3", None, "Peru: z", None, None, None, "w", "8")]
    spark.createDataFrame(rows, ", ".join(f"{c} {'bigint' if c == 'row_id' else 'string'}" for c in columns)).write.parquet(str(tmp_path / "updated_species_voucher.parquet"))
    got = entry.queries()["q_meta_per_gene"](spark, str(tmp_path)).first().asDict()
    assert [got[c] for c in META] == ["Peru", "coi:Peru: x;16s:Peru: y", "1 N 2 E", "coi:2001;16s:2002", "i1", "v"]
    got = entry.queries()["q_meta_advanced"](spark, str(tmp_path)).first().asDict()
    assert [got[c] for c in META] == ["Peru", "coi:Peru: x;16s:Peru: y;Peru: z", "1 N 2 E", "coi:2001;16s:2002", "i1", "16s:v;w"]


def test_update_of_all_six_fields(spark, final):
    columns = ("row_id", "accession", "country", "geo_loc_name", "altitude", "host", "collection_date", "record_date", "collected_by", "specimen_voucher", "isolate", "note", "lat_lon", "culture_collection", "strain")
    rows = [(1, "A1", "Peru", None, None, None, None, "8 April 2009", "D", None, None, "n", "x", "ZM 　5", None), (2, "A2", "Peru", "g", None, None, "2001", "2002", "D", "v", None, "n", "x", "c", None)]
    base = final(rows, ", ".join(f"{c} {'bigint' if c == 'row_id' else 'string'}" for c in columns))
    got = entry.queries()["q_update_table"](spark, base).collect()
    assert [r.asDict() for r in got] == [{"accession": "A1", "geo_loc_name": "Peru", "lat_lon": "", "collection_date": "08-Apr-2009", "collected_by": "", "specimen_voucher": "ZM:5", "isolation_source": ""}]
