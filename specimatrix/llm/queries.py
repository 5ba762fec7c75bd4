"""Queries of this folder's operators over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from specimatrix.llm import identity, markers, mixing, names, packing, subjects, survivor
from specimatrix.session import table


def p1_found(spark: SparkSession, base: str) -> DataFrame:
    """The rows with the best position and place of each specimen."""
    return survivor.best_rows(table(spark, base, "updated_species_voucher"))


def p1_records(spark: SparkSession, base: str) -> DataFrame:
    """One surviving record per specimen."""
    return survivor.survivors(table(spark, base, "updated_species_voucher"))


def p3_found(spark: SparkSession, base: str) -> DataFrame:
    """The markers that definitions and gene types denote."""
    return markers.map_markers(table(spark, base, "final"), table(spark, base, "assigned_genes_types_all"), table(spark, base, "marker_list"))


def p4_found(spark: SparkSession, base: str) -> DataFrame:
    """The pairs of spellings of one person or organisation."""
    return names.same_names(table(spark, base, "final"))


def p4_canonical(spark: SparkSession, base: str) -> DataFrame:
    """Each spelling with the most frequent one of its entity."""
    return names.canonical_names(table(spark, base, "final"))


def p6_found(spark: SparkSession, base: str) -> DataFrame:
    """The further rows of each identity."""
    return identity.copies(table(spark, base, "final"))


def p6_identities(spark: SparkSession, base: str) -> DataFrame:
    """Each identity with the number of its records."""
    return identity.collapsed(table(spark, base, "final"))


def p7_containers(spark: SparkSession, base: str) -> DataFrame:
    """Each text's place in containers of each capacity."""
    return packing.fill_containers(table(spark, base, "documents"), table(spark, base, "container_size"))


def p7_filling(spark: SparkSession, base: str) -> DataFrame:
    """How well the containers of each kind are filled."""
    return packing.filling(p7_containers(spark, base), table(spark, base, "container_size"))


def p8_mix(spark: SparkSession, base: str) -> DataFrame:
    """The documents of the mix with their copies."""
    return mixing.mix(table(spark, base, "documents"), table(spark, base, "source_target"))


def p8_shares(spark: SparkSession, base: str) -> DataFrame:
    """The shares that the mix reaches."""
    return mixing.shares(p8_mix(spark, base), table(spark, base, "source_target"))


def p9_found(spark: SparkSession, base: str) -> DataFrame:
    """The subjects of each document."""
    return subjects.assign_subjects(table(spark, base, "documents"), table(spark, base, "subject_labels"), table(spark, base, "subject_list"))


QUERIES = {"p1_found": p1_found, "p1_records": p1_records, "p3_found": p3_found, "p4_found": p4_found, "p4_canonical": p4_canonical, "p6_found": p6_found, "p6_identities": p6_identities, "p7_containers": p7_containers, "p7_filling": p7_filling, "p8_mix": p8_mix, "p8_shares": p8_shares, "p9_found": p9_found}
_NAMES = "list_filter(list_transform(string_split_regex(geo_loc_name, '[:,;]'), lambda x: trim(x)), lambda x: x <> '' AND lower(x) NOT IN ('missing', 'unknown', 'not applicable', 'not provided', 'n/a', 'na', '-', '?'))"
_PART = r"([{h}])?([+-]?[0-9]+(?:\.[0-9]+)?)°?(?:([0-9]+(?:\.[0-9]+)?)'')?(?:([0-9]+(?:\.[0-9]+)?)\")?([{h}])?"
_WHOLE = "^" + _PART.format(h="NS") + ",?" + _PART.format(h="EW") + "$"
_SQUEEZED = "regexp_replace(regexp_replace(upper(trim(lat_lon)), '([0-9]) +([0-9-])', '\\1,\\2', 'g'), ' +', '', 'g')"
_NUM = lambda i: f"coalesce(TRY_CAST(p[{i}] AS DOUBLE), 0)"
_DEC = lambda i: f"(CASE WHEN contains(p[{i}], '.') THEN length(split_part(p[{i}], '.', 2)) ELSE 0 END)"
_SIDE = lambda i, most: f"abs({_NUM(i + 1)}) + {_NUM(i + 2)} / 60 + {_NUM(i + 3)} / 3600 <= {most} AND {_NUM(i + 2)} < 60 AND {_NUM(i + 3)} < 60"
_UNIT = lambda i: f"CASE WHEN p[{i + 3}] <> '' THEN 3.5 + {_DEC(i + 3)} WHEN p[{i + 2}] <> '' THEN 1.5 + {_DEC(i + 2)} ELSE {_DEC(i + 1)} END"
_FIELD = lambda c: f"CASE WHEN lower(trim(coalesce({c}, ''))) IN ('', 'missing', 'unknown', 'n/a', 'na', '-', '?', 'none') THEN '' ELSE array_to_string(list_sort(string_split(regexp_replace(lower({c}), '[^a-z]', '', 'g'), '')), '') || ' ' || array_to_string(list_sort(regexp_extract_all({c}, '[0-9]+')), ' ') END"
_IDENTITY = f"""WITH k AS (SELECT row_id, array_to_string(list_sort([{_FIELD('specimen_voucher')}, {_FIELD('isolate')}]), '|') AS key FROM final), g AS (SELECT key, min(row_id) AS first_row_id, count(*) AS n_rows FROM k WHERE key <> '|' GROUP BY key)"""

#: SQL for identities has no structural confirmation: it agrees as long as no two codes are anagrams with equal numbers.
_BEST = f"""WITH a AS (SELECT row_id, updated_at, regexp_replace(lower(species_voucher_new), '[^a-z0-9]+', '', 'g') AS k, {_NAMES} AS names, lower(trim(geo_loc_name)) AS place, {_SQUEEZED} AS t FROM updated_species_voucher),
c AS (SELECT *, CASE WHEN regexp_matches(t, '{_WHOLE}') THEN string_split(regexp_replace(t, '{_WHOLE}', '\\1|\\2|\\3|\\4|\\5|') || regexp_replace(t, '{_WHOLE}', '\\6|\\7|\\8|\\9|') || regexp_extract(t, '([EW])$', 1), '|') END AS p FROM a WHERE k <> ''),
d AS (SELECT *, p IS NOT NULL AND {_SIDE(1, 90)} AND {_SIDE(6, 180)} AND (abs({_NUM(2)}) + {_NUM(3)} + {_NUM(4)} + abs({_NUM(7)}) + {_NUM(8)} + {_NUM(9)}) > 0 AS ok, greatest({_UNIT(1)}, {_UNIT(6)}) AS unit, len(names) > 0 AS named FROM c),
l AS (SELECT k, row_id AS r FROM (SELECT k, row_id, row_number() OVER (PARTITION BY k ORDER BY unit DESC, updated_at DESC NULLS LAST, row_id) AS rn FROM d WHERE ok) WHERE rn = 1),
g AS (SELECT k, row_id AS r, names FROM (SELECT k, row_id, names, row_number() OVER (PARTITION BY k ORDER BY len(names) DESC, updated_at DESC NULLS LAST, row_id) AS rn FROM d WHERE named) WHERE rn = 1),
s AS (SELECT k, min(row_id) AS group_row_id, count(*) AS n_rows FROM d GROUP BY k)
"""
ORACLES: dict[str, str] = {
    "p1_found": f"{_BEST} SELECT group_row_id, coalesce(l.r, 0) AS lat_lon_row_id, coalesce(g.r, 0) AS geo_row_id FROM s LEFT JOIN l USING (k) LEFT JOIN g USING (k) WHERE n_rows > 1",
    "p1_records": f"""{_BEST}, v AS (SELECT d.k, d.row_id, d.updated_at, u.country FROM d JOIN updated_species_voucher u USING (row_id) WHERE lower(trim(coalesce(u.country, ''))) NOT IN ('', 'missing', 'unknown', 'not applicable', 'not provided', 'n/a', 'na', '-', '?')),
o AS (SELECT v.*, row_number() OVER (PARTITION BY v.k ORDER BY v.updated_at DESC NULLS LAST, v.row_id) AS rn FROM v LEFT JOIN g USING (k) WHERE g.r IS NULL OR lower(trim(v.country)) = lower(g.names[1]))
SELECT s.group_row_id, s.n_rows, l.r AS lat_lon_row_id, g.r AS geo_row_id, o.row_id AS country_row_id, (SELECT lat_lon FROM updated_species_voucher u WHERE u.row_id = l.r) AS lat_lon, (SELECT geo_loc_name FROM updated_species_voucher u WHERE u.row_id = g.r) AS geo_loc_name, coalesce(o.country, g.names[1]) AS country
FROM s LEFT JOIN l USING (k) LEFT JOIN g USING (k) LEFT JOIN o ON o.k = s.k AND o.rn = 1""",
    "p6_found": f"{_IDENTITY} SELECT first_row_id, row_id AS copy_row_id FROM k JOIN g USING (key) WHERE row_id > first_row_id",
    "p6_identities": f"{_IDENTITY} SELECT first_row_id, n_rows FROM g",
}
