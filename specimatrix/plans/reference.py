"""Queries of the pipeline's own operators, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specimatrix.functions.phrases import DICTIONARY, MARKERS, as_table, phrase_join
from specimatrix.functions.text import missing_value, python_title
from specimatrix.operators import classify as C
from specimatrix.operators import enrich as E
from specimatrix.operators import matrix as M
from specimatrix.operators import validate as V
from specimatrix.operators import voucher as K
from specimatrix.plans import rules_sql as R
from specimatrix.session import bounded, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _final(spark, base) -> DataFrame:
    return table(spark, base, "final")


def _assigned(spark, base) -> DataFrame:
    return table(spark, base, "assigned_genes_types_all")


def _vouchers(spark, base) -> DataFrame:
    return table(spark, base, "updated_species_voucher")


DIAG = "row_id, gene_type, match_source, original_match, has_conflict, conflict_reason, assignment_reason"
_DIAG = ["row_id", *C.DIAGNOSTICS]


# Filters and predicates


@query(f"SELECT row_id, {R.LENGTH} AS n FROM final WHERE {R.LENGTH} BETWEEN 150 AND 50000")
def q_length_filter(spark, base):
    return C.overall_length(_final(spark, base), C.Rules()).select("row_id", C.length_of(F.col("seq_length")).alias("n"))


@query(f"SELECT row_id, moleculetype, mol_type, organelle FROM final WHERE lower(moleculetype) = 'dna' AND lower(mol_type) IN ('genomic dna', 'mrna') AND {R.LENGTH} BETWEEN 300 AND 2000 AND lower(organelle) = 'mitochondrion'")
def q_attr_filter(spark, base):
    return C.attribute_filter(_final(spark, base), "DNA", "genomic DNA, mRNA", "300:2000", "mitochondrion").select("row_id", "moleculetype", "mol_type", "organelle")


_HITS = " UNION ALL ".join(f"SELECT row_id, {R.quoted(g)} AS marker FROM final WHERE regexp_matches(lower(definition), {R.quoted(R.phrase_regex(g))})" for g in DICTIONARY)


@query(_HITS)
def q_phrase_match(spark, base):
    rows = C.prepared(_final(spark, base), C.Rules())
    found = F.array_compact(F.array(*[F.when(F.col(f"`_hit_{g}`"), F.lit(g)) for g in DICTIONARY]))
    return rows.select("row_id", F.explode(found).alias("marker"))


@query(_HITS)
def q_phrase_join(spark, base):
    return phrase_join(_final(spark, base), as_table(spark, DICTIONARY))


@query("SELECT row_id, CASE WHEN regexp_matches(pcr_primers, '(?i)(fwd|rev)_name:\\s*(ZvCO-|SetH-)') THEN 'named' ELSE 'other' END AS primer, regexp_matches(pcr_primers, '(?i)(fwd|rev)_name:\\s*28SC1') AS is_28s FROM final WHERE pcr_primers IS NOT NULL")
def q_primer_match(spark, base):
    """The predicate of the second round, with primers that these tables have."""
    named = C.names_primer(F.col("pcr_primers"), "ZvCO-|SetH-")
    return _final(spark, base).where("pcr_primers is not null").select("row_id", F.when(named, "named").otherwise("other").alias("primer"), C.names_primer(F.col("pcr_primers"), "28SC1").alias("is_28s"))


# Classification


@query(f"WITH {R.first_round()} SELECT {DIAG} FROM r1")
def q_classify_first(spark, base):
    return C.first_round(_final(spark, base)).select(*_DIAG)


@query(f"WITH {R.second_round()} SELECT {DIAG} FROM r2")
def q_recheck(spark, base):
    one = C.first_round(_final(spark, base))
    own = [c for c in one.columns if c not in C.DIAGNOSTICS]
    return C.round_two(C.unmatched(one).select(*own)).select(*_DIAG)


_ALL = f"WITH {R.second_round()}, al AS (SELECT * FROM r1 WHERE gene_type <> '' UNION ALL SELECT * FROM r2 WHERE gene_type <> '')"


@query(f"{_ALL} SELECT {DIAG} FROM al")
def q_classify_all(spark, base):
    return C.classify(_final(spark, base)).select(*_DIAG)


@query(f"{_ALL} SELECT row_id, gene_type FROM al WHERE gene_type LIKE '%,%'")
def q_multi_match(spark, base):
    return C.multiple(C.classify(_final(spark, base))).select("row_id", "gene_type")


@query(f"{_ALL} SELECT DISTINCT gene_type, conflict_reason FROM al WHERE has_conflict")
def q_conflict_union(spark, base):
    return C.conflicting(C.classify(_final(spark, base))).select("gene_type", "conflict_reason").distinct()


@query("SELECT locusid, min(row_id) AS row_id FROM final GROUP BY locusid")
def q_keep_first(spark, base):
    return C.keep_first(_final(spark, base), "locusid", "row_id").select("locusid", "row_id")


_CATEGORY = """CASE WHEN d LIKE '%whole genome shotgun%' THEN 'whole_genome_shotgun' WHEN d LIKE '%genome assembly%' THEN 'genome_assembly'
 WHEN d LIKE '%tpa_asm%' OR d LIKE '%tpa:%' THEN 'TPA_assembly' WHEN d LIKE '%chromosome:%' THEN 'chromosome_data' WHEN d LIKE '%scaffold%' THEN 'scaffold' WHEN d LIKE '%contig%' THEN 'contig'
 WHEN d LIKE '%mrna sequence%' OR d LIKE '%cdna clone%' THEN 'mRNA/cDNA' WHEN d LIKE '%trna%' THEN 'tRNA' WHEN d LIKE '%rrna%' AND d NOT LIKE '%mitochondrial%' THEN 'nuclear_rRNA'
 WHEN d LIKE '%nad%' THEN 'NADH_dehydrogenase' WHEN d LIKE '%atp synthase%' OR d LIKE '%atpase%' THEN 'ATP_synthase' WHEN d LIKE '%creatine kinase%' THEN 'creatine_kinase'
 WHEN d LIKE '%cytochrome b%' OR d LIKE '%cytb%' THEN 'cytochrome_b_variant' ELSE 'other' END"""


@query(f"SELECT row_id, {_CATEGORY} AS category FROM (SELECT row_id, lower(coalesce(definition, '')) AS d FROM final)")
def q_category_case(spark, base):
    return _final(spark, base).select("row_id", C.category(F.col("definition")).alias("category"))


_LEFT = f"WITH {R.first_round()}, lo AS (SELECT r1.row_id, definition, {_CATEGORY} AS category FROM r1 JOIN f USING (row_id) WHERE gene_type = '')"


def _leftovers(spark, base):
    return C.unmatched(C.first_round(_final(spark, base))).select("row_id", "definition", C.category(F.col("definition")).alias("category"))


@query(f"{_LEFT} SELECT category, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 1) AS percent FROM lo GROUP BY category")
def q_category_pct(spark, base):
    from specimatrix.operators.reports import category_counts

    return category_counts(_leftovers(spark, base))


@query(
    f"""{_LEFT}, t AS (SELECT category, count(*) AS n FROM lo GROUP BY category ORDER BY n DESC, category LIMIT 5),
s AS (SELECT category, n, row_id, definition, row_number() OVER (PARTITION BY category ORDER BY row_id) AS rank FROM lo JOIN t USING (category))
SELECT category, n, CAST(rank AS INTEGER) AS rank, substring(definition, 1, 100) AS sample FROM s WHERE rank <= 3"""
)
def q_category_topk(spark, base):
    from specimatrix.operators.reports import category_samples

    return category_samples(_leftovers(spark, base))


_GENES = "SELECT row_id, trim(g) AS gene FROM (SELECT row_id, unnest(string_split(gene_type, ',')) AS g FROM assigned_genes_types_all WHERE gene_type IS NOT NULL) WHERE trim(g) <> ''"


@query(_GENES)
def q_gene_explode(spark, base):
    return C.gene_rows(_assigned(spark, base)).select("row_id", "gene")


@query(f"SELECT * FROM ({_GENES}) WHERE gene IN ('coi', '16s')")
def q_gene_extract(spark, base):
    return C.gene_rows(_assigned(spark, base), ["coi", "16s"]).select("row_id", "gene")


@query(f"SELECT DISTINCT gene FROM ({_GENES})")
def q_gene_list(spark, base):
    return C.gene_list(_assigned(spark, base))


# Vouchers


def _sanitized(c: str) -> str:
    """SQL of the cleaning, with those compatibility forms that these tables have."""
    plain = f"translate({c}, '\uff1a\u00a0\u3000', ':  ')"
    gone = f"replace(replace(replace(replace(trim({plain}), '''', ''), '\"', ''), '(', ''), ')', '')"
    return f"trim(regexp_replace(regexp_replace(replace({gone}, ' ', '_'), '[<>:./\\\\|?*]+', '_', 'g'), '_+', '_', 'g'), '_')"


@query(f"SELECT row_id, {_sanitized('organism')} AS organism_key, {_sanitized('coalesce(definition, chr(32))')} AS definition_key FROM final")
def q_sanitize(spark, base):
    return _final(spark, base).select("row_id", K.sanitize(F.col("organism")).alias("organism_key"), K.sanitize(F.col("definition")).alias("definition_key"))


_FIRST_ID = "coalesce(specimen_voucher, isolate, culture_collection, clone_name, strain, accession)"
_KEY_FORMS = {
    "species_name+pse": f"concat_ws('_', nullif({_sanitized('organism')}, ''), nullif({_sanitized(_FIRST_ID)}, ''))",
    "pse+species_name": f"concat_ws('_', nullif({_sanitized(_FIRST_ID)}, ''), nullif({_sanitized('organism')}, ''))",
    "pse_only": f"coalesce({_sanitized(_FIRST_ID)}, '')",
}


@query(f"SELECT row_id, {_FIRST_ID} AS species_voucher_pse, {_KEY_FORMS['species_name+pse']} AS species_voucher_new FROM final")
def q_coalesce_voucher(spark, base):
    """Over all rows, in any script."""
    return K.voucher_columns(_final(spark, base)).select("row_id", "species_voucher_pse", "species_voucher_new")


@query(f"SELECT row_id, {_KEY_FORMS['pse+species_name']} AS after_identifier, {_KEY_FORMS['pse_only']} AS identifier_only FROM final")
def q_voucher_modes(spark, base):
    """The two other ways to combine species and identifier."""
    rows = K.voucher_columns(_final(spark, base), K.VoucherRules(combine="pse+species_name", name="after_identifier"))
    return K.voucher_columns(rows.drop("filled_from"), K.VoucherRules(combine="pse_only", name="identifier_only")).select("row_id", "after_identifier", "identifier_only")


@query("SELECT count(*) FILTER (s = 1) AS from_priority, CAST(0 AS BIGINT) AS from_haplotype, count(*) FILTER (s = 2) AS from_fallback, count(*) FILTER (s = 0) AS still_empty, CAST(0 AS BIGINT) AS empty_keys FROM (SELECT CASE WHEN coalesce(specimen_voucher, isolate, culture_collection, clone_name, strain) IS NOT NULL THEN 1 WHEN accession IS NOT NULL THEN 2 ELSE 0 END AS s FROM final)")
def q_voucher_fill(spark, base):
    return K.fill_report(K.voucher_columns(_final(spark, base)))


_COUNTS = "SELECT species_voucher_new, count(*) AS n FROM updated_species_voucher WHERE species_voucher_new <> '' GROUP BY 1"


@query(_COUNTS)
def q_voucher_counts(spark, base):
    return K.voucher_counts(_vouchers(spark, base))


@query(f"SELECT n AS occurrences, count(*) AS vouchers FROM ({_COUNTS}) GROUP BY 1")
def q_count_of_counts(spark, base):
    return K.count_of_counts(_vouchers(spark, base))


@query(f"SELECT row_id, species_voucher_new, CAST(n AS INTEGER) AS frequency_group FROM updated_species_voucher JOIN ({_COUNTS}) USING (species_voucher_new) WHERE n BETWEEN 2 AND 8")
def q_frequency_groups(spark, base):
    return K.frequency_groups(_vouchers(spark, base)).select("row_id", "species_voucher_new", "frequency_group")


@query("SELECT organism, gene_type, species_voucher_new, locusid FROM updated_species_voucher")
def q_short_projection(spark, base):
    from specimatrix.sources.tables import project

    return project(_vouchers(spark, base), ["Organism", "gene type", "species_voucher_new", "LocusID", "no such column"])


@query("SELECT row_id, isolate FROM updated_species_voucher WHERE isolate IS NOT NULL")
def q_haplotype_only(spark, base):
    """The isolate plays the haplotype, which these tables lack."""
    return K.with_haplotype(_vouchers(spark, base), "isolate").select("row_id", "isolate")


# Joins

_FIVE = "assembly_method, assembly_name, sequencing_technology, genome_coverage, expected_final_version"


@query(f"SELECT f.row_id, trim(f.accession) AS accession, {_FIVE} FROM final f LEFT JOIN assembly a ON trim(f.accession) = trim(a.accession)")
def q_left_join_meta(spark, base):
    from specimatrix.sources.flatfile import with_assembly

    out = with_assembly(_final(spark, base), table(spark, base, "assembly"), "accession")
    return out.select("row_id", F.trim("accession").alias("accession"), *_FIVE.split(", "))


@query("SELECT f.row_id, f.taxonid, coalesce(t.class_name, '') AS class_name, coalesce(t.order_name, '') AS order_name, coalesce(t.family_name, '') AS family_name, coalesce(t.genus_name, '') AS genus_name FROM final f LEFT JOIN taxonomy t USING (taxonid)")
def q_taxonomy(spark, base):
    ranks = ["class_name", "order_name", "family_name", "genus_name"]
    t = bounded(table(spark, base, "taxonomy").select("taxonid", *[F.col(r).alias(f"t_{r}") for r in ranks]))
    return _final(spark, base).join(t, "taxonid", "left").select("row_id", "taxonid", *[F.coalesce(f"t_{r}", F.lit("")).alias(r) for r in ranks])


# The matrix

_KEYS = "coalesce(species_voucher_new, 'UNKNOWN')"
_LISTED = f"""g0 AS (SELECT {_KEYS} AS k, row_id, trim(locusid) AS l, unnest(list_distinct(list_transform(string_split(gene_type, ','), lambda x: regexp_replace(trim(x), '[#?]+$', '')))) AS g FROM updated_species_voucher WHERE gene_type IS NOT NULL AND trim(locusid) <> ''),
g1 AS (SELECT k, g, l, min(row_id) AS o FROM g0 GROUP BY k, g, l)"""


def _matrix_sql(spread: bool, extra: str = "", prefer: bool = False) -> str:
    own = f"w0 AS (SELECT k, g, l, o, 0 AS lvl FROM g1 WHERE g IN ({', '.join(map(R.quoted, MARKERS))}))"
    if prefer:
        own += ", nc AS (SELECT k FROM w0 WHERE g = 'mtgenome' GROUP BY k HAVING count(*) > 1 AND count(*) FILTER (upper(l) LIKE 'ZY0000%') > 0), w AS (SELECT * FROM w0 WHERE NOT (g = 'mtgenome' AND k IN (SELECT k FROM nc) AND upper(l) NOT LIKE 'ZY0000%'))"
    else:
        own += ", w AS (SELECT * FROM w0)"
    if spread:
        rows = ["SELECT * FROM w"] + [f"SELECT k, {R.quoted(c)}, l, o, 1 FROM w WHERE g = '18-28s'" for c in ("18s", "28s", "its1-its2")] + [f"SELECT k, {R.quoted(c)}, l, o, 2 FROM w WHERE g = 'mtgenome'" for c in ("coi", "16s", "12s", "cob", "cox2", "cox3")]
        own += f", u AS ({' UNION ALL '.join(rows)}), x AS (SELECT k, g, l, min(lvl) AS lvl, arg_min(o, lvl) AS o FROM u GROUP BY k, g, l)"
    else:
        own += ", x AS (SELECT k, g, l, lvl, o FROM w)"
    cells = ", ".join(f"coalesce(string_agg(l, ';' ORDER BY lvl, o, l) FILTER (g = {R.quoted(m)}), '') AS \"{m}\"" for m in MARKERS)
    return f"WITH {_LISTED}, {own}, c AS (SELECT k, {cells} FROM x GROUP BY k), h AS (SELECT {_KEYS} AS k, coalesce(arg_min(trim(organism), row_id) FILTER (trim(organism) <> ''), '') AS organism{extra} FROM updated_species_voucher GROUP BY 1)"


_CELLS = ", ".join(f"coalesce(\"{m}\", '') AS \"{m}\"" for m in MARKERS)
_FIRST = lambda c: f", coalesce(arg_min(trim({c}), row_id) FILTER (trim({c}) <> ''), '') AS {c}"
_META = ("country", "geo_loc_name", "lat_lon", "collection_date", "isolate", "specimen_voucher", "taxonid")


@query(f"{_matrix_sql(True, ''.join(map(_FIRST, _META)))} SELECT h.k AS species_voucher_new, h.organism, {_CELLS}, {', '.join('h.' + c for c in _META)} FROM h LEFT JOIN c USING (k)")
def q_matrix(spark, base):
    return M.matrix(_vouchers(spark, base))


@query(f"{_matrix_sql(True, prefer=True)} SELECT h.k AS species_voucher_new, h.organism, {_CELLS} FROM h LEFT JOIN c USING (k)")
def q_matrix_prefer(spark, base):
    """Of several genomes of a specimen those whose locus begins in a given way; these tables' loci have no NC_."""
    return M.matrix(_vouchers(spark, base), M.MatrixRules(metadata=(), tail=(), prefer_reference=True, reference="ZY0000"))


@query(f"{_matrix_sql(False)} SELECT h.k AS species_voucher_new, h.organism, {_CELLS} FROM h LEFT JOIN c USING (k)")
def q_matrix_plain(spark, base):
    rules = M.MatrixRules(metadata=(), tail=(), spread_cluster=False, spread_genome=False)
    return M.matrix(_vouchers(spark, base), rules)


@query(f"{_matrix_sql(True)} SELECT g AS gene, CAST(n AS BIGINT) AS specimens FROM (SELECT {', '.join(f'count(*) FILTER (coalesce(' + chr(34) + m + chr(34) + f', ' + chr(39) * 2 + f') <> ' + chr(39) * 2 + f') AS ' + chr(34) + m + chr(34) for m in MARKERS)} FROM h LEFT JOIN c USING (k)) UNPIVOT (n FOR g IN ({', '.join(chr(34) + m + chr(34) for m in MARKERS)}))")
def q_gene_coverage(spark, base):
    return M.coverage(M.matrix(_vouchers(spark, base), M.MatrixRules(metadata=(), tail=())))


_PARTS = lambda c: f"coalesce((SELECT string_agg(DISTINCT p, ';' ORDER BY p) FROM (SELECT trim(unnest(string_split(array_to_string(v_{c}, ';'), ';'))) AS p) WHERE p <> ''), '') AS {c}"
_ALLC = ("accession", "specimen_voucher", "isolate", "species_voucher_pse", "lat_lon", "geo_loc_name", "country", "collection_date", "taxonid")


@query(f"WITH a AS (SELECT {_KEYS} AS k, {', '.join(f'list({c}) FILTER (trim({c}) <> ' + chr(39) * 2 + f') AS v_{c}' for c in _ALLC)} FROM updated_species_voucher GROUP BY 1) SELECT k AS species_voucher_new, {', '.join(map(_PARTS, _ALLC))} FROM a")
def q_meta_all(spark, base):
    rules = M.MatrixRules(mode="all", tail=())
    return M.matrix(_vouchers(spark, base), rules).select("species_voucher_new", *_ALLC)


def _labelled_sql(pairs: str, columns: tuple[str, ...], unlinked: str = "") -> str:
    return f"""{pairs},
d AS (SELECT DISTINCT k, g, c, v FROM p), act AS (SELECT k, c, count(DISTINCT g) AS n FROM d GROUP BY k, c),
byv AS (SELECT k, c, v, count(*) AS m, string_agg(g, ',' ORDER BY g) AS gs FROM d GROUP BY k, c, v), cnt AS (SELECT k, c, count(*) AS vals FROM byv GROUP BY k, c),
t AS (SELECT k, c, CASE WHEN max(vals) = 1 THEN max(v) ELSE string_agg(CASE WHEN m = n THEN v ELSE gs || ':' || v END, ';' ORDER BY v) END AS t FROM byv JOIN act USING (k, c) JOIN cnt USING (k, c) GROUP BY k, c)
SELECT kk.k AS species_voucher_new, {', '.join(f"coalesce(replace(max(t) FILTER (c = {R.quoted(c)}), {R.quoted(unlinked or '~~~')}, ''), '') AS {c}" for c in columns)} FROM (SELECT DISTINCT {_KEYS} AS k FROM updated_species_voucher) kk LEFT JOIN t USING (k) GROUP BY kk.k"""


_DEFAULT = M.MatrixRules().metadata
_OF = lambda table, columns, more="": " UNION ALL ".join(f"SELECT k, {more}{R.quoted(c)} AS c, trim({c}) AS v FROM {table} WHERE trim({c}) <> ''" for c in columns)


@query(_labelled_sql(f"WITH gm AS (SELECT {_KEYS} AS k, {', '.join(_DEFAULT)}, unnest(list_distinct(list_transform(string_split(gene_type, ','), lambda x: regexp_replace(trim(x), '[#?]+$', '')))) AS g FROM updated_species_voucher WHERE gene_type IS NOT NULL), p AS (SELECT * FROM ({_OF('gm', _DEFAULT, 'g, ')}) WHERE g IN ({', '.join(map(R.quoted, MARKERS))}))", _DEFAULT))
def q_meta_per_gene(spark, base):
    """Over all metadata columns of the matrix."""
    return M.matrix(_vouchers(spark, base), M.MatrixRules(mode="per_gene")).select("species_voucher_new", *_DEFAULT)


@query(
    _labelled_sql(
        f"""{_matrix_sql(True)}, uu AS (SELECT {_KEYS} AS k, trim(locusid) AS l, row_id, {', '.join(_DEFAULT)} FROM updated_species_voucher WHERE trim(locusid) <> ''),
fv AS (SELECT k, l, c, v, min(row_id) AS o FROM ({_OF('uu', _DEFAULT, 'l, row_id, ')}) GROUP BY k, l, c, v),
jv AS (SELECT k, l, c, list_reduce(list(v ORDER BY o), lambda acc, x: CASE WHEN contains(acc, x) THEN acc ELSE acc || ';' || x END) AS t FROM fv GROUP BY k, l, c),
tx AS (SELECT DISTINCT k, l, c, v FROM (SELECT k, l, c, trim(unnest(string_split(t, ';'))) AS v FROM jv) WHERE v <> ''),
p AS (SELECT tx.k, coalesce(x.g, '_unlinked') AS g, c, v FROM tx LEFT JOIN x ON tx.k = x.k AND tx.l = x.l)""",
        _DEFAULT,
        "_unlinked:",
    )
)
def q_meta_advanced(spark, base):
    """Over all metadata columns of the matrix."""
    return M.matrix(_vouchers(spark, base), M.MatrixRules(mode="advanced")).select("species_voucher_new", *_DEFAULT)


# Enrichment

_LIT = "lit AS (SELECT row_id, accession, country, geo_loc_name AS state, altitude AS municipality, host AS locality, CAST(row_id % 90 AS VARCHAR) AS n, CAST((row_id % 360) - 180 AS VARCHAR) AS e, coalesce(collection_date, record_date) AS coll_date, collected_by AS leg, coalesce(specimen_voucher, culture_collection, strain, accession) AS voucher, note AS habitat FROM final WHERE accession IS NOT NULL)"


def _literature(spark, base):
    """A literature sheet made of the records: their own texts under a sheet's names, and coordinates by rule."""
    f = _final(spark, base).where("accession is not null")
    return f.select("row_id", "accession", "country", F.col("geo_loc_name").alias("state"), F.col("altitude").alias("municipality"), F.col("host").alias("locality"), (F.col("row_id") % 90).cast("string").alias("n"), ((F.col("row_id") % 360) - 180).cast("string").alias("e"), F.coalesce("collection_date", "record_date").alias("coll_date"), F.col("collected_by").alias("leg"), F.coalesce("specimen_voucher", "culture_collection", "strain", "accession").alias("voucher"), F.col("note").alias("habitat"))


@query("WITH o AS (SELECT accession, arg_min(country, row_id) AS c, arg_min(collection_date, row_id) AS d FROM final WHERE country IS NOT NULL OR collection_date IS NOT NULL GROUP BY 1) SELECT v.row_id, CASE WHEN coalesce(trim(v.country), '') IN ('', 'nan') THEN CASE WHEN coalesce(trim(c), '') IN ('', 'nan') THEN '' ELSE trim(c) END ELSE v.country END AS country, CASE WHEN coalesce(trim(v.collection_date), '') IN ('', 'nan') THEN CASE WHEN coalesce(trim(d), '') IN ('', 'nan') THEN '' ELSE trim(d) END ELSE v.collection_date END AS collection_date FROM updated_species_voucher v LEFT JOIN o USING (accession)")
def q_fill_empty(spark, base):
    other = _final(spark, base).where("country is not null or collection_date is not null").select("row_id", "accession", "country", "collection_date")
    rows = _vouchers(spark, base).select("row_id", "accession", "country", "collection_date")
    return E.fill_only_empty(rows, other, "accession", ["country", "collection_date"], "row_id").select("row_id", "country", "collection_date")


@query("SELECT count(*) FILTER (trim(country) <> '') AS country, count(*) FILTER (trim(lat_lon) <> '') AS lat_lon, count(*) FILTER (trim(collection_date) <> '') AS collection_date FROM final")
def q_nonempty_counts(spark, base):
    from specimatrix.operators.reports import nonempty_counts

    return nonempty_counts(_final(spark, base), ["country", "lat_lon", "collection_date"])


_W = "SELECT locusid, accession, CASE WHEN gene_type = 'coi' THEN accession END AS coi, CASE WHEN gene_type = '16s' THEN accession END AS s16 FROM assigned_genes_types_all"


@query(f"SELECT locusid, 'coi' AS marker, coi AS accession FROM ({_W}) WHERE coi <> '' UNION ALL SELECT locusid, '16s', s16 FROM ({_W}) WHERE s16 <> ''")
def q_unpivot(spark, base):
    wide = _assigned(spark, base).select("locusid", *[F.when(F.col("gene_type") == g, F.col("accession")).alias(g) for g in ("coi", "16s")])
    return E.unpivot_markers(wide, ["locusid"], ["coi", "16s"])


_T = lambda c: f"CASE WHEN coalesce(trim({c}), '') = 'nan' THEN '' ELSE coalesce(trim({c}), '') END"


_FULL = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
_NAMED = lambda w: f"CASE {' '.join(f'WHEN rtrim(lower({w}), {R.quoted(chr(46))}) IN ({R.quoted(m[:3])}, {R.quoted(m)}{chr(44) + R.quoted(m[:4]) if m == _FULL[8] else str()}) THEN {R.quoted(m[:3].title())}' for m in _FULL)} ELSE upper(({w})[1]) || rtrim(lower(({w})[2:]), '.') END"
_FORMS = (r"(\d{1,2})\s+(\w+\.?)\s+(\d{4})", r"(\d{1,2})-\d{1,2}\s+(\w+\.?)\s+(\d{4})")


def _date_sql(t: str) -> str:
    days = " ".join(f"WHEN regexp_full_match({t}, '{p}') THEN lpad(regexp_extract({t}, '{p}', 1), 2, '0') || '-' || {_NAMED(f'regexp_extract({t}, {R.quoted(p)}, 2)')} || '-' || right({t}, 4)" for p in _FORMS)
    return rf"CASE WHEN {t} IN ('', 'nan') THEN '' WHEN regexp_full_match({t}, '\w{{3}}(-\w{{3}})?\s+\d{{4}}') THEN {_NAMED(f'({t})[1:3]')} || '-' || right({t}, 4) {days} ELSE {t} END"


_BLANK = r"[\s\pZ\x{1c}-\x{1f}\x{85}]"


def _voucher_sql(c: str) -> str:
    t = f"regexp_replace(regexp_replace(coalesce({c}, ''), '^{_BLANK}+|{_BLANK}+$', '', 'g'), '(?i){_BLANK}+(Holotype|Paratype)$', '')"
    return rf"CASE WHEN {t} IN ('', 'nan') OR lower({t}) = 'no voucher' THEN '' WHEN contains({t}, ':') THEN {t} ELSE regexp_replace({t}, '^(\pL+){_BLANK}+', '\1:') END"


UPDATE_SQL = f"""WITH {_LIT}, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY accession ORDER BY row_id DESC) AS rn FROM lit) WHERE rn = 1),
g AS (SELECT accession, geo_loc_name AS geo, lat_lon AS ll, collected_by AS cb, note AS iso, collection_date AS cd, specimen_voucher AS sv, isolate AS il FROM (SELECT *, row_number() OVER (PARTITION BY accession ORDER BY row_id DESC) AS rn FROM final WHERE accession IS NOT NULL) WHERE rn = 1),
u AS (SELECT accession, CASE WHEN {_T('geo')} = '' THEN CASE WHEN concat_ws(', ', nullif({_T('state')}, ''), nullif({_T('municipality')}, ''), nullif({_T('locality')}, '')) <> '' THEN {_T('l.country')} || ': ' || concat_ws(', ', nullif({_T('state')}, ''), nullif({_T('municipality')}, ''), nullif({_T('locality')}, '')) ELSE {_T('l.country')} END ELSE '' END AS geo_loc_name,
CASE WHEN {_T('ll')} = '' THEN printf('%.4f %s %.4f %s', abs(CAST(n AS DOUBLE)), CASE WHEN CAST(n AS DOUBLE) >= 0 THEN 'N' ELSE 'S' END, abs(CAST(e AS DOUBLE)), CASE WHEN CAST(e AS DOUBLE) >= 0 THEN 'E' ELSE 'W' END) ELSE '' END AS lat_lon,
CASE WHEN {_T('cd')} = '' THEN {_date_sql("coalesce(trim(coll_date), '')")} ELSE '' END AS collection_date, CASE WHEN {_T('cb')} = '' THEN {_T('leg')} ELSE '' END AS collected_by,
CASE WHEN {_T('sv')} = '' AND {_T('il')} = '' THEN {_voucher_sql('voucher')} ELSE '' END AS specimen_voucher, CASE WHEN {_T('iso')} = '' THEN {_T('habitat')} ELSE '' END AS isolation_source FROM l JOIN g USING (accession))
SELECT * FROM u WHERE geo_loc_name || lat_lon || collection_date || collected_by || specimen_voucher || isolation_source <> ''"""


@query(UPDATE_SQL)
def q_update_table(spark, base):
    """All six fields; where the sheet has no date or voucher, the record's date and its collection or accession stand in."""
    records = _final(spark, base).withColumn("isolation_source", F.col("note"))
    return E.update_rows(_literature(spark, base), records, "row_id")


@query(f"SELECT row_id, {_date_sql('t')} AS d FROM (SELECT row_id, coalesce(trim(collection_date), '') AS t FROM final)")
def q_date_format(spark, base):
    """Over all rows, whatever words the dates have."""
    return _final(spark, base).select("row_id", E.submission_date(F.col("collection_date")).alias("d"))


@query(f"SELECT row_id, CASE WHEN concat_ws(', ', nullif({_T('host')}, ''), nullif({_T('altitude')}, '')) <> '' THEN {_T('country')} || ': ' || concat_ws(', ', nullif({_T('host')}, ''), nullif({_T('altitude')}, '')) ELSE {_T('country')} END AS place FROM final")
def q_geo_format(spark, base):
    return _final(spark, base).select("row_id", E.geo_name(F.col("country"), F.col("host"), F.col("altitude")).alias("place"))


_PAIR = r"^\s*(-?\d+(?:\.\d+)?)\s*[,;]\s*(-?\d+(?:\.\d+)?)\s*$"


@query(rf"""WITH a AS (SELECT row_id, TRY_CAST(regexp_extract(lat_lon, '{_PAIR}', 1) AS DOUBLE) AS n, TRY_CAST(regexp_extract(lat_lon, '{_PAIR}', 2) AS DOUBLE) AS e FROM final)
SELECT row_id, coalesce(CASE WHEN n IS NOT NULL AND e IS NOT NULL THEN printf('%.4f %s %.4f %s', abs(n), CASE WHEN n >= 0 THEN 'N' ELSE 'S' END, abs(e), CASE WHEN e >= 0 THEN 'E' ELSE 'W' END) END, '') AS position FROM a""")
def q_lat_lon_format(spark, base):
    """The records' positions; those not written as two numbers have no form."""
    part = lambda i: F.regexp_extract(F.coalesce("lat_lon", F.lit("")), _PAIR, i)
    return _final(spark, base).select("row_id", E.lat_lon(part(1), part(2)).alias("position"))


@query(f"SELECT row_id, {_voucher_sql('specimen_voucher')} AS voucher FROM final")
def q_voucher_format(spark, base):
    """Over all rows, in any script."""
    return _final(spark, base).select("row_id", E.submission_voucher(F.col("specimen_voucher")).alias("voucher"))


# Validation


def _expected(spark, base):
    a = _assigned(spark, base).where("gene_type is not null and organism is not null")
    x = a.select("accession", F.when(F.col("row_id") % 7 == 0, "coi").otherwise(F.col("gene_type")).alias("gene"), F.when(F.col("row_id") % 11 == 0, "Aus bus").otherwise(F.col("organism")).alias("species"))
    missing = table(spark, base, "taxonomy").select(F.concat(F.lit("none"), "taxonid").alias("accession"), F.lit("coi").alias("gene"), F.lit("Aus bus").alias("species"))
    left = _final(spark, base).select("accession", F.lit("coi").alias("gene"), "organism").where("organism is not null").select("accession", "gene", F.col("organism").alias("species"))
    return x.unionAll(missing).unionAll(left).distinct()


_STATUS = """WITH ex AS (SELECT accession, CASE WHEN row_id % 7 = 0 THEN 'coi' ELSE gene_type END AS gene, CASE WHEN row_id % 11 = 0 THEN 'Aus bus' ELSE organism END AS species FROM assigned_genes_types_all WHERE gene_type IS NOT NULL AND organism IS NOT NULL
UNION SELECT 'none' || taxonid, 'coi', 'Aus bus' FROM taxonomy UNION SELECT accession, 'coi', organism FROM final WHERE organism IS NOT NULL),
a AS (SELECT split_part(trim(coalesce(locusid, accession)), '.', 1) AS b, arg_max(gene_type, row_id) AS fg, arg_max(organism, row_id) AS fs FROM assigned_genes_types_all GROUP BY 1),
x AS (SELECT DISTINCT split_part(trim(coalesce(locusid, accession)), '.', 1) AS b FROM final),
r AS (SELECT accession, gene, species, coalesce(fg, '') AS found_gene, coalesce(fs, '') AS found_species, CASE WHEN a.b IS NOT NULL AND coalesce(fg = gene, false) AND starts_with(lower(coalesce(fs, '')), split_part(lower(species), ' ', 1)) THEN 'OK' WHEN a.b IS NOT NULL AND NOT coalesce(fg = gene, false) THEN 'GENE_MISMATCH' WHEN a.b IS NOT NULL THEN 'SPECIES_MISMATCH' WHEN x.b IS NOT NULL THEN 'UNCLASSIFIED' ELSE 'MISSING' END AS status
FROM ex LEFT JOIN a ON split_part(trim(ex.accession), '.', 1) = a.b LEFT JOIN x ON split_part(trim(ex.accession), '.', 1) = x.b)"""


@query(f"{_STATUS} SELECT * FROM r")
def q_validate_status(spark, base):
    return V.validated(_expected(spark, base), _assigned(spark, base), _final(spark, base))


@query(f"{_STATUS} SELECT gene, count(*) AS expected, count(*) FILTER (status = 'OK') AS ok, count(*) FILTER (status = 'GENE_MISMATCH') AS gene_mismatch, count(*) FILTER (status = 'SPECIES_MISMATCH') AS species_mismatch, count(*) FILTER (status = 'UNCLASSIFIED') AS unclassified, count(*) FILTER (status = 'MISSING') AS missing, round(count(*) FILTER (status = 'OK') * 100.0 / count(*), 1) AS accuracy FROM r GROUP BY gene")
def q_validate_rollup(spark, base):
    return V.validation_rollup(V.validated(_expected(spark, base), _assigned(spark, base), _final(spark, base)))


_NAMES = "SELECT DISTINCT organism AS name FROM final WHERE organism IS NOT NULL UNION SELECT DISTINCT organism || ' Han, 2023' FROM taxonomy UNION SELECT DISTINCT substring(organism, 1, length(organism) - 3) || 'zzz' FROM taxonomy"


@query(
    f"""WITH nm AS ({_NAMES}), n AS (SELECT name, lower(trim(regexp_replace(regexp_replace(regexp_replace(name, '(?i)\\bcf\\. ', ' ', 'g'), ',?\\s*[A-Z][a-z]+,?\\s*\\d{{4}}.*$', '', 'g'), '\\s+', ' ', 'g'))) AS key FROM nm),
o AS (SELECT DISTINCT organism, lower(organism) AS ok FROM taxonomy),
h AS (SELECT name, 0 AS r, organism, 'exact' AS m FROM n JOIN o ON key = ok UNION ALL SELECT name, 1, organism, 'prefix' FROM n JOIN o ON split_part(key, ' ', 1) || ' ' || substring(split_part(key, ' ', 2), 1, 4) = split_part(ok, ' ', 1) || ' ' || substring(split_part(ok, ' ', 2), 1, 4)),
b AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY r, organism) AS rn FROM h)
SELECT nm.name, b.organism, coalesce(m, 'none') AS method FROM nm LEFT JOIN b ON nm.name = b.name AND rn = 1"""
)
def q_fuzzy_match(spark, base):
    t = table(spark, base, "taxonomy")
    names = _final(spark, base).where("organism is not null").select(F.col("organism").alias("name"))
    names = names.unionAll(t.select(F.concat("organism", F.lit(" Han, 2023")))).unionAll(t.select(F.expr("concat(substring(organism, 1, length(organism) - 3), 'zzz')")))
    return V.match_species(names, t.select("organism"))


@query(
    """WITH p AS (SELECT DISTINCT organism, split_part(lower(organism), ' ', 1) AS g, split_part(lower(organism), ' ', 2) AS e FROM taxonomy WHERE organism IS NOT NULL),
n AS (SELECT DISTINCT 'Olda' || g || ' ' || e AS name, lower('Olda' || g || ' ' || e) AS key, 'olda' || g AS og, e, g FROM p WHERE e <> ''),
o AS (SELECT DISTINCT organism, lower(organism) AS ok FROM taxonomy), pre AS (SELECT *, split_part(ok, ' ', 1) || ' ' || substring(split_part(ok, ' ', 2), 1, 4) AS op FROM o),
h AS (SELECT name, 2 AS r, organism, 'remap' AS m FROM n JOIN pre ON g || ' ' || e = ok UNION ALL SELECT name, 3, organism, 'remap' FROM n JOIN pre ON g || ' ' || substring(e, 1, 4) = op),
b AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY r, organism) AS rn FROM h) SELECT n.name, b.organism, coalesce(m, 'none') AS method FROM (SELECT DISTINCT name FROM n) n LEFT JOIN b ON n.name = b.name AND rn = 1"""
)
def q_species_remap(spark, base):
    """Species under an older genus, found by a table of genera that were renamed."""
    p = F.split(F.lower("organism"), " ")
    old = table(spark, base, "taxonomy").where("organism is not null").select(p[0].alias("g"), F.get(p, F.lit(1)).alias("epithet")).where("epithet is not null and epithet != ''").distinct()
    names = old.select(F.concat(F.lit("Olda"), "g", F.lit(" "), "epithet").alias("name"))
    remap = old.select(F.concat(F.lit("olda"), "g").alias("genus"), "epithet", F.col("g").alias("new_genus"))
    return V.match_species(names, table(spark, base, "taxonomy").select("organism"), remap)


@query("SELECT row_id, coalesce(len(list_filter(list_transform(string_split(coalesce(locusid, '') || ';' || coalesce(accession, ''), ';'), lambda x: trim(x)), lambda x: x = split_part(locusid, '.', 1) OR starts_with(x, split_part(locusid, '.', 1) || '.'))) > 0, false) AS there FROM updated_species_voucher")
def q_accession_cells(spark, base):
    """Whether a cell of two ids holds an accession, with or without its version."""
    cell = F.concat_ws(";", F.coalesce("locusid", F.lit("")), F.coalesce("accession", F.lit("")))
    there = V.accession_in(cell, F.substring_index("locusid", ".", 1))
    return _vouchers(spark, base).select("row_id", F.coalesce(there, F.lit(False)).alias("there"))


@query("WITH w AS (SELECT DISTINCT accession FROM assembly WHERE accession IS NOT NULL), r AS (SELECT upper(trim(locusid)) AS id, organism FROM final WHERE locusid IS NOT NULL UNION SELECT upper(trim(accession)), organism FROM final WHERE accession IS NOT NULL), c AS (SELECT accession, 0 AS k, upper(trim(accession)) AS id FROM w UNION ALL SELECT accession, 1, split_part(upper(trim(accession)), '.', 1) FROM w UNION ALL SELECT accession, 2, split_part(upper(trim(accession)), '.', 1) || '.1' FROM w), b AS (SELECT accession, organism, row_number() OVER (PARTITION BY accession ORDER BY k, organism NULLS FIRST) AS rn FROM c JOIN r USING (id)) SELECT w.accession, coalesce(b.organism, '') AS organism FROM w LEFT JOIN b ON w.accession = b.accession AND rn = 1")
def q_accession_lookup(spark, base):
    return V.find_accessions(table(spark, base, "assembly").where("accession is not null"), _final(spark, base))


@query("WITH a AS (SELECT row_id, country, isolate FROM final WHERE row_id % 10 <> 0), b AS (SELECT row_id, CASE WHEN row_id % 5 = 0 THEN 'changed' ELSE country END AS country, isolate FROM final WHERE row_id % 10 <> 1) SELECT row_id, '<row>' AS \"column\", CASE WHEN a.row_id IS NULL THEN 'absent' ELSE 'present' END AS old_value, CASE WHEN b.row_id IS NULL THEN 'absent' ELSE 'present' END AS new_value FROM a FULL JOIN b USING (row_id) WHERE a.row_id IS NULL OR b.row_id IS NULL UNION ALL SELECT row_id, 'country', a.country, b.country FROM a JOIN b USING (row_id) WHERE a.country IS DISTINCT FROM b.country UNION ALL SELECT row_id, 'isolate', a.isolate, b.isolate FROM a JOIN b USING (row_id) WHERE a.isolate IS DISTINCT FROM b.isolate")
def q_table_diff(spark, base):
    """The two versions of a table differ by rule; both are whole tables but for the rows that one version lacks."""
    f = _final(spark, base).select("row_id", "country", "isolate")
    old = f.where("row_id % 10 != 0")
    new = f.where("row_id % 10 != 1").withColumn("country", F.when(F.col("row_id") % 5 == 0, "changed").otherwise(F.col("country")))
    return V.table_diff(old, new, "row_id")


@query("SELECT organism, gene_type, string_agg(locusid, '; ' ORDER BY row_id) AS loci FROM assigned_genes_types_all WHERE organism IS NOT NULL AND gene_type IS NOT NULL AND locusid IS NOT NULL GROUP BY 1, 2")
def q_organism_genes(spark, base):
    return V.organism_genes(_assigned(spark, base))


@query(f"{_matrix_sql(True)}, i AS (SELECT h.organism, trim(unnest(string_split(coi, ';'))) AS id FROM h JOIN c USING (k)) SELECT organism, string_agg(DISTINCT id, '; ' ORDER BY id) AS ids FROM i WHERE id <> '' GROUP BY 1")
def q_organism_union(spark, base):
    return V.organism_union(M.matrix(_vouchers(spark, base), M.MatrixRules(metadata=(), tail=())), "coi")


@query("SELECT count(DISTINCT organism) AS organisms, count(DISTINCT accession) AS accessions, count(*) AS n FROM final")
def q_distinct_counts(spark, base):
    return _final(spark, base).agg(F.countDistinct("organism").alias("organisms"), F.countDistinct("accession").alias("accessions"), F.count(F.lit(1)).alias("n"))


@query("SELECT row_id, split_part(trim(locusid), '.', 1) AS b FROM final")
def q_accession_base(spark, base):
    return _final(spark, base).select("row_id", V.accession_base(F.col("locusid")).alias("b"))


# Tables and files

_NULLED = lambda c: f"CASE WHEN {c} IN ('', '#N/A', '#N/A N/A', '#NA', '-1.#IND', '-1.#QNAN', '-NaN', '-nan', '1.#IND', '1.#QNAN', '<NA>', 'N/A', 'NA', 'NULL', 'NaN', 'None', 'n/a', 'nan', 'null') THEN NULL ELSE {c} END AS {c}"


@query(f"SELECT row_id, {_NULLED('collection_date')}, {_NULLED('geo_loc_name')}, {_NULLED('collected_by')} FROM final")
def q_missing_texts(spark, base):
    return _final(spark, base).select("row_id", *[missing_value(F.col(c)).alias(c) for c in ("collection_date", "geo_loc_name", "collected_by")])


@query("SELECT source_file, count(*) AS records, count(*) FILTER (definition IS NULL) AS failed, CASE WHEN count(*) FILTER (definition IS NULL) = count(*) THEN 'failed' WHEN count(*) FILTER (definition IS NULL) > 0 THEN 'partial' ELSE 'success' END AS status FROM final GROUP BY 1")
def q_run_files(spark, base):
    from specimatrix.operators.reports import file_status

    return file_status(_final(spark, base), "source_file", F.col("definition").isNull())


@query("SELECT status, count(*) AS files, CAST(sum(records) AS BIGINT) AS records, CAST(sum(failed) AS BIGINT) AS failed FROM (SELECT source_file, count(*) AS records, count(*) FILTER (definition IS NULL) AS failed, CASE WHEN count(*) FILTER (definition IS NULL) = count(*) THEN 'failed' WHEN count(*) FILTER (definition IS NULL) > 0 THEN 'partial' ELSE 'success' END AS status FROM final GROUP BY 1) GROUP BY 1")
def q_run_summary(spark, base):
    from specimatrix.operators.reports import file_status
    from specimatrix.sources.flatfile import run_summary

    return run_summary(file_status(_final(spark, base), "source_file", F.col("definition").isNull()))


@query("SELECT source_file, array_to_string(list_sort(list(accession))[1:5], '; ') AS failed_accessions FROM final WHERE definition IS NULL AND accession IS NOT NULL GROUP BY 1")
def q_failed_accessions(spark, base):
    from specimatrix.operators.reports import failed_accessions

    return failed_accessions(_final(spark, base), "source_file", F.col("definition").isNull())


_GENESQL = " UNION ALL ".join(f"SELECT {R.quoted(g)} AS gene, {len({p.lower() for p in ps})} AS n" for g, ps in DICTIONARY.items())


@query(f"SELECT CASE WHEN gene IN ('coi', 'cob', 'cox2', 'cox3') THEN 'mito_protein' WHEN gene IN ('12s', '16s') THEN 'mito_rrna' WHEN gene IN ('18s', '28s', 'its1-its2', '18-28s') THEN 'nuclear_rrna' WHEN gene = 'mtgenome' THEN 'genome' ELSE 'nuclear_protein' END AS category, count(*) AS genes, CAST(sum(n) AS BIGINT) AS phrases FROM ({_GENESQL}) GROUP BY 1")
def q_dictionary_stats(spark, base):
    from specimatrix.operators.reports import dictionary_stats

    return dictionary_stats(as_table(spark, DICTIONARY))


@query("SELECT row_id, array_to_string(list_transform(string_split(lower(mol_type), '-'), lambda x: upper(x[1]) || x[2:]), '-') AS title FROM final WHERE mol_type IS NOT NULL AND NOT contains(mol_type, ' ') UNION ALL SELECT row_id, array_to_string(list_transform(string_split(lower(mol_type), ' '), lambda x: upper(x[1]) || x[2:]), ' ') FROM final WHERE contains(mol_type, ' ')")
def q_title_case(spark, base):
    return _final(spark, base).where("mol_type is not null").select("row_id", python_title(F.col("mol_type")).alias("title"))


_FLAT = lambda c: f"coalesce(trim(regexp_replace({c}, '[\\s\\x{{a0}}\\x{{3000}}]+', ' ', 'g')), '') AS {c}"


@query(f"SELECT locusid, accession, coalesce({R.LENGTH}, 0) || ' bp' AS length, {', '.join(map(_FLAT, ('definition', 'organism', 'taxonid', 'isolate', 'specimen_voucher')))} FROM final")
def q_flatfile_roundtrip(spark, base):
    """Records written as flat files and parsed again: what comes back must be what went in."""
    from specimatrix.plans.roundtrip import roundtrip

    return roundtrip(_final(spark, base))


@query(f"SELECT locusid, {_FLAT('ref1authors').replace('AS ref1', 'AS ')}, {_FLAT('ref1title').replace('AS ref1', 'AS ')}, {_FLAT('ref1journal').replace('AS ref1', 'AS ')} FROM final")
def q_flatfile_references(spark, base):
    """The first reference of records written as flat files and parsed again."""
    from specimatrix.plans.roundtrip import references

    return references(_final(spark, base))


_ASM = "(assembly_method || assembly_name || sequencing_technology || genome_coverage || expected_final_version)"


@query(
    f"""WITH a AS (SELECT trim(accession) AS accession, {', '.join(map(_FLAT, _FIVE.split(', ')))} FROM assembly),
o AS (SELECT *, row_number() OVER (PARTITION BY accession ORDER BY {_FIVE}) AS rn FROM a)
SELECT f.accession, {_FIVE}, CASE WHEN row_id % 2 = 0 THEN 'structured_comment' ELSE 'comment_text' END AS assembly_source FROM final f JOIN o ON f.accession = o.accession AND rn = 1 WHERE {_ASM} <> ''"""
)
def q_flatfile_assembly(spark, base):
    """The assemblies of records written as flat files, as structured comments and as text, and found again."""
    from specimatrix.plans.roundtrip import assembled

    return assembled(_final(spark, base), table(spark, base, "assembly"))


@query(
    f"""WITH a AS (SELECT trim(accession) AS accession, {', '.join(map(_FLAT, _FIVE.split(', ')))} FROM assembly),
o AS (SELECT *, row_number() OVER (PARTITION BY accession ORDER BY {_FIVE}) AS rn FROM a),
s AS (SELECT f.accession, f.row_id, {_ASM} <> '' AS has FROM final f LEFT JOIN o ON f.accession = o.accession AND rn = 1), b AS (SELECT accession, min(CASE WHEN row_id % 2 = 0 THEN 'structured_comment' ELSE 'comment_text' END) AS w FROM s WHERE has GROUP BY 1)
SELECT s.accession, true AS metadata_ok, coalesce(w, '') AS assembly_source, w IS NOT NULL AS has_assembly_data, '' AS error_message FROM s LEFT JOIN b USING (accession)"""
)
def q_record_tracking(spark, base):
    """What became of each record that was written as a flat file and parsed again."""
    from specimatrix.plans.roundtrip import tracked

    return tracked(_final(spark, base), table(spark, base, "assembly")).select("accession", "metadata_ok", "assembly_source", "has_assembly_data", "error_message")


_TEXTS = ("definition", "collection_date", "geo_loc_name", "collected_by", "specimen_voucher", "pcr_primers", "note")
_READ = lambda c: f"CASE WHEN {c} IN ('', '#N/A', '#N/A N/A', '#NA', '-1.#IND', '-1.#QNAN', '-NaN', '-nan', '1.#IND', '1.#QNAN', '<NA>', 'N/A', 'NA', 'NULL', 'NaN', 'None', 'n/a', 'nan', 'null') THEN NULL ELSE {c} END AS {c}"


@query(f"SELECT CAST(row_id AS VARCHAR) AS row_id, {', '.join(map(_READ, _TEXTS))} FROM final")
def q_csv_roundtrip(spark, base):
    """A table written with commas and read again, missing texts as nulls."""
    from specimatrix.plans.roundtrip import delimited

    return delimited(_final(spark, base).select("row_id", *_TEXTS), ".csv", ",")


@query(f"SELECT CAST(row_id AS VARCHAR) AS row_id, {', '.join(map(_READ, _TEXTS))} FROM final")
def q_tsv_roundtrip(spark, base):
    """A table written with tabs and read again."""
    from specimatrix.plans.roundtrip import delimited

    return delimited(_final(spark, base).select("row_id", *_TEXTS), ".tsv", "\t")


@query(f"WITH {R.first_round()} SELECT row_id, gene_type, match_source, original_match, has_conflict FROM r1")
def q_classify_plain(spark, base):
    """The first round without its explanations, whose columns are then not there."""
    out = C.first_round(_final(spark, base), C.Rules(reasons=False, conflicts=False))
    return out.select("row_id", *[c for c in C.DIAGNOSTICS if c in out.columns])


@query("""SELECT row_id, CASE WHEN e LIKE '%gen. et sp.%' THEN 'new name, provisional in the record' WHEN e LIKE '%aus%' AND f LIKE '%aos%' THEN 'spelling' WHEN contains(f, regexp_replace(e, 'cf\\. ?', '', 'g')) OR contains(e, regexp_replace(f, 'cf\\. ?', '', 'g')) THEN 'cf. only' ELSE 'another species' END AS reason
FROM (SELECT f.row_id, lower(trim(t.organism)) AS e, lower(trim(f.organism)) AS f FROM final f JOIN taxonomy t USING (taxonid) WHERE f.organism IS NOT NULL AND t.organism IS NOT NULL AND f.organism <> t.organism)""")
def q_mismatch_reason(spark, base):
    """Why a record's species differs from that of its taxon."""
    t = table(spark, base, "taxonomy").select("taxonid", F.col("organism").alias("known"))
    j = _final(spark, base).join(bounded(t), "taxonid").where(F.col("organism") != F.col("known"))
    return j.select("row_id", V.mismatch_reason(F.col("known"), F.col("organism"), (("aus", "aos"),)).alias("reason"))


@query(f"SELECT count(*) AS updated, {', '.join(f'count(*) FILTER ({c} <> ' + chr(39) * 2 + f') AS {c}' for c in E.UPDATE_NAMES if c != 'accession')} FROM ({UPDATE_SQL})")
def q_update_counts(spark, base):
    """How many fields of each kind the update fills."""
    return E.update_counts(q_update_table(spark, base))


@query(f"WITH m AS (SELECT marker, phrase FROM (VALUES {', '.join(f'({R.quoted(g)}, {R.quoted(p.lower())})' for g, ps in DICTIONARY.items() for p in ps)}) v(marker, phrase)) SELECT marker, string_agg(DISTINCT phrase, '|' ORDER BY phrase) AS phrases FROM m GROUP BY 1")
def q_dictionary_order(spark, base):
    """The dictionary by kind of marker, then name; a fixed table."""
    from specimatrix.operators.reports import ordered_dictionary

    return ordered_dictionary(as_table(spark, DICTIONARY)).select("marker", F.array_join("phrases", "|").alias("phrases"))


@query(f"WITH {R.first_round()} SELECT {DIAG} FROM r1")
def q_stream_classify(spark, base):
    """The first round over a stream of table files, until all that is there has been read; the SQL is that of the batch."""
    from specimatrix.streaming.folder import classify_available

    return classify_available(spark, f"{base}/final.parquet")
