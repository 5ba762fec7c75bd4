"""Results against what is expected: by accession, by species name, and table against table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specimatrix.functions.text import squeeze, strip
from specimatrix.session import computed, cut


def accession_base(c: Column) -> Column:
    """An accession without its version."""
    return F.substring_index(F.trim(c), ".", 1)


def validated(expected: DataFrame, assigned: DataFrame, extracted: DataFrame, order: str = "row_id") -> DataFrame:
    """Expected (accession, gene, species) against assigned and extracted records: one row each with a status.

    OK, GENE_MISMATCH, SPECIES_MISMATCH (by genus), UNCLASSIFIED (extracted only) or MISSING. Of repeated accessions the
    last assigned record holds.
    """
    base = lambda df: accession_base(F.coalesce(df["locusid"], df["accession"]))
    a = assigned.select(base(assigned).alias("_b"), "gene_type", "organism", order).groupBy("_b").agg(F.max_by("gene_type", order).alias("found_gene"), F.max_by("organism", order).alias("found_species"), F.lit(True).alias("_assigned"))
    x = extracted.select(base(extracted).alias("_b")).groupBy("_b").agg(F.lit(True).alias("_extracted"))
    j = expected.withColumn("_b", accession_base(F.col("accession"))).join(a, "_b", "left").join(x, "_b", "left")
    low = lambda c: F.lower(squeeze(F.coalesce(c, F.lit(""))))
    genus = F.split(low(F.col("species")), " ")[0]
    gene_ok = F.coalesce(F.col("found_gene") == F.col("gene"), F.lit(False))
    species_ok = low(F.col("found_species")).startswith(genus)
    status = F.when(F.col("_assigned") & gene_ok & species_ok, "OK").when(F.col("_assigned") & ~gene_ok, "GENE_MISMATCH").when(F.col("_assigned"), "SPECIES_MISMATCH").when(F.col("_extracted"), "UNCLASSIFIED").otherwise("MISSING")
    return j.select("accession", "gene", "species", F.coalesce("found_gene", F.lit("")).alias("found_gene"), F.coalesce("found_species", F.lit("")).alias("found_species"), status.alias("status"))


def validation_rollup(results: DataFrame) -> DataFrame:
    """Per expected gene: how many were expected and ended in which status, and the share that is right."""
    n = {s: F.count_if(F.col("status") == s) for s in ("OK", "GENE_MISMATCH", "SPECIES_MISMATCH", "UNCLASSIFIED", "MISSING")}
    return results.groupBy("gene").agg(F.count(F.lit(1)).alias("expected"), *[c.alias(s.lower()) for s, c in n.items()], F.round(n["OK"] * 100.0 / F.count(F.lit(1)), 1).alias("accuracy"))


def species_key(c: Column) -> Column:
    """A species name for comparison: no qualifiers, authors or years, lower case.

    The name is read word by word. An author is the first capitalised word after the genus, if a year follows; it ends the
    name. Qualifiers (cf., sp. nov. with its number, gen. nov., sensu and whom) are left out wherever they stand.
    """
    bare = F.regexp_replace(c, r"\([^()]*[0-9]{4}[^()]*\)", " ")
    words = F.split(squeeze(bare), " ")
    author = F.array_position(F.transform(words, lambda w, i: (i > 0) & w.rlike("^[A-Z][a-z]+,?$")), True)
    dated = (author > 0) & F.exists(F.slice(words, F.greatest(author, F.lit(1)).cast("int"), F.size(words)), lambda w: w.rlike("[0-9]{4}"))
    name = F.when(dated, F.slice(words, F.lit(1), (author - 1).cast("int"))).otherwise(words)
    plain = F.transform(name, lambda w: F.rtrim(F.lower(F.regexp_replace(w, "[.,]+$", ""))))
    at = lambda i: F.coalesce(F.when(i >= 0, F.get(plain, i)), F.lit(""))
    rank = lambda w: w.isin("sp", "gen")
    dropped = lambda w, i: (
        (w == "cf.") | (at(i) == "sensu") | (at(i - 1) == "sensu") | (rank(at(i)) & (at(i + 1) == "nov")) | ((at(i) == "nov") & rank(at(i - 1))) | (w.rlike("^[0-9]+$") & (at(i - 1) == "nov"))
    )
    return F.lower(F.array_join(F.filter(name, lambda w, i: ~dropped(F.lower(w), i)), " "))


def species_prefix(key: Column, letters: int = 4) -> Column:
    """Genus and the first letters of the epithet; null if there is no epithet or it is open."""
    p = F.split(key, " ")
    return F.when((F.size(p) >= 2) & ~p[1].isin("cf", "sp", "cf.", "sp."), F.concat(p[0], F.lit(" "), F.substring(p[1], 1, letters)))


def match_species(names: DataFrame, organisms: DataFrame, remap: DataFrame | None = None) -> DataFrame:
    """(name, organism, method): each name with one organism, by exact key, by prefix, then under a remapped genus.

    ``remap`` has (genus, epithet, new_genus). Each way is an equi-join; the first way that finds any holds, and of its
    organisms the alphabetically first.
    """
    n = cut(computed(names.select("name").distinct(), {"key": species_key(F.col("name"))}))
    o = cut(computed(organisms.select("organism").distinct(), {"o_key": species_key(F.col("organism"))}).withColumn("o_prefix", species_prefix(F.col("o_key"))))
    ways = [(n, 0, "exact", "prefix")]
    if remap is not None:
        p = F.split("key", " ")
        moved = n.withColumn("genus", p[0]).withColumn("epithet", F.get(p, F.lit(1))).join(remap, ["genus", "epithet"])
        ways.append((moved.select("name", F.concat("new_genus", F.lit(" "), "epithet").alias("key")), 2, "remap", "remap"))
    hits = None
    for left, at, exact, prefix in ways:
        left = left.withColumn("prefix", species_prefix(F.col("key")))
        for condition, rank, method in ((F.col("key") == F.col("o_key"), at, exact), (F.col("prefix") == F.col("o_prefix"), at + 1, prefix)):
            found = left.join(o, condition).select("name", F.struct(F.lit(rank).alias("rank"), F.col("organism").alias("organism"), F.lit(method).alias("method")).alias("hit"))
            hits = found if hits is None else hits.unionAll(found)
    best = hits.groupBy("name").agg(F.min("hit").alias("hit"))
    return n.select("name").join(best, "name", "left").select("name", F.col("hit.organism").alias("organism"), F.coalesce("hit.method", F.lit("none")).alias("method"))


def accession_in(cell: Column, accession: Column) -> Column:
    """True if a cell of ids between semicolons holds the accession, with or without a version."""
    return F.exists(F.split(cell, r";\s*"), lambda x: (F.trim(x) == accession) | F.trim(x).startswith(F.concat(accession, F.lit("."))))


def find_accessions(wanted: DataFrame, records: DataFrame) -> DataFrame:
    """(accession, organism) by accession as given, without its version, or as version 1; '' if unknown.

    A leading or trailing ``*`` is dropped and case does not matter; the first way that finds any holds.
    """
    clean = F.upper(F.regexp_replace(F.trim("accession"), r"^\*+|\*+$", ""))
    w = wanted.select("accession").distinct().select("accession", F.posexplode(F.array(clean, F.substring_index(clean, ".", 1), F.concat(F.substring_index(clean, ".", 1), F.lit(".1")))).alias("rank", "id"))
    r = records.select(F.explode(F.array_distinct(F.array(F.upper(F.trim("locusid")), F.upper(F.trim("accession"))))).alias("id"), "organism").where("id is not null")
    hits = w.join(r, "id").groupBy("accession").agg(F.min(F.struct("rank", "organism")).alias("hit"))
    return wanted.select("accession").distinct().join(hits, "accession", "left").select("accession", F.coalesce("hit.organism", F.lit("")).alias("organism"))


def table_diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, column, old_value, new_value) for every cell that differs; a missing row differs in ``<row>``."""
    common = [c for c in old.columns if c in new.columns and c != key]
    a = old.select(key, F.lit(True).alias("_old"), *[F.col(c).cast("string").alias(f"a_{c}") for c in common])
    b = new.select(key, F.lit(True).alias("_new"), *[F.col(c).cast("string").alias(f"b_{c}") for c in common])
    j = a.join(b, key, "full")
    there = lambda c: F.when(F.col(c), "present").otherwise("absent")
    cells = [F.struct(F.lit(c).alias("column"), F.col(f"a_{c}").alias("old_value"), F.col(f"b_{c}").alias("new_value")) for c in common]
    both = F.col("_old") & F.col("_new")
    whole = F.array(F.struct(F.lit("<row>").alias("column"), there("_old").alias("old_value"), there("_new").alias("new_value")))
    out = j.select(key, F.inline(F.when(F.coalesce(both, F.lit(False)), F.array(*cells)).otherwise(whole)))
    return out.where(~F.col("old_value").eqNullSafe(F.col("new_value")))


def mismatch_reason(expected: Column, found: Column, spelled: tuple[tuple[str, str], ...] = ()) -> Column:
    """Why two species names differ: a new name, another spelling of a word (pairs in ``spelled``), a cf., or the species."""
    e, f = F.lower(squeeze(expected)), F.lower(squeeze(found))
    bare = lambda c: F.regexp_replace(c, r"cf\. ?", "")
    other_spelling = F.lit(False)
    for a, b in spelled:
        other_spelling = other_spelling | (e.contains(a.lower()) & f.contains(b.lower()))
    return F.when(e.contains("gen. et sp."), "new name, provisional in the record").when(other_spelling, "spelling").when(f.contains(bare(e)) | e.contains(bare(f)), "cf. only").otherwise("another species")


def _genes_of_species(matrix_rows: DataFrame, genes: list[str]) -> DataFrame:
    """(found, gene, ids): the distinct ids of each organism and marker of a matrix, sorted; pairs without ids are left out."""
    long = matrix_rows.select(F.col("organism").alias("found"), F.inline(F.array(*[F.struct(F.lit(g).alias("gene"), F.col(f"`{g}`").alias("cell")) for g in genes if g in matrix_rows.columns])))
    ids = long.select("found", "gene", F.explode(F.split("cell", ";")).alias("id")).where("trim(id) != ''")
    return ids.groupBy("found", "gene").agg(F.array_sort(F.collect_set(F.trim("id"))).alias("ids"))


def species_report(expected: DataFrame, matrix_rows: DataFrame, records: DataFrame, remap: DataFrame | None = None, fill: bool = True) -> DataFrame:
    """Expected (species, gene, accession) against a matrix: one row per species with its status and counts.

    A species is matched by name, then, where that fails, by any of its accessions in ``records``. A gene is found if the
    matched organism has any record of it (of the whole genome too, if ``fill``), and right if the accession is among
    them. Statuses: NO_LIT_DATA (no accession expected), NOT_FOUND, MATCH (all right), PARTIAL, and ACCESSION_RESOLVED
    (found by accession, but none right). Asterisks, placeholders and versions of expected accessions do not count.
    """
    clean = F.upper(F.rtrim(F.regexp_replace(strip(F.col("accession")), r"\*+$", "")))
    e = expected.select("species", "gene", F.when(~clean.isin("", "-", "–", "NAN"), clean).alias("acc"), F.coalesce(F.col("accession").contains("*"), F.lit(False)).alias("early"))
    named = match_species(e.select(F.col("species").alias("name")), matrix_rows.select("organism").where("organism is not null"), remap).select(F.col("name").alias("species"), F.col("organism").alias("by_name"), "method")
    looked = find_accessions(e.where("acc is not null").select(F.col("acc").alias("accession")), records).where("organism != ''")
    by_acc = e.join(looked, e["acc"] == looked["accession"]).groupBy("species").agg(F.min_by("organism", F.struct("gene", "acc")).alias("by_accession"))
    who = named.join(by_acc, "species", "left").select("species", F.coalesce("by_name", "by_accession").alias("found"), F.when(F.col("by_name").isNotNull(), F.col("method")).when(F.col("by_accession").isNotNull(), "accession_lookup").otherwise("none").alias("method"))
    genes = [c for c in matrix_rows.columns if c not in ("organism",)]
    has = _genes_of_species(matrix_rows, genes)
    genome = has.where("gene = 'mtgenome'").select("found", F.col("ids").alias("whole"))
    j = e.join(who, "species").join(has, ["found", "gene"], "left").join(genome, "found", "left")
    ids = F.coalesce("ids", F.col("whole") if fill else F.lit(None).cast("array<string>"))
    right = F.exists(ids, lambda x: F.upper(accession_base(x)) == accession_base(F.col("acc")))
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    told = F.col("acc").isNotNull()
    counts = j.groupBy("species").agg(F.first("found").alias("organism"), F.first("method").alias("method"), n(told).alias("expected"), n(told & ids.isNotNull()).alias("covered"), n(told & right).alias("right"), n(told & F.col("ids").isNull() & ids.isNotNull()).alias("filled"), F.max("early").alias("_early"))
    whole = F.col("right") == F.col("expected")
    status = F.when(F.col("expected") == 0, "NO_LIT_DATA").when(F.col("organism").isNull(), "NOT_FOUND").when(whole, "MATCH").when((F.col("method") == "accession_lookup") & (F.col("right") == 0), "ACCESSION_RESOLVED").otherwise("PARTIAL")
    detail = F.when(status == "NOT_FOUND", F.when(F.col("_early"), "accessions before publication").otherwise("neither name nor accession found")).when(status == "MATCH", "all accessions right").otherwise(F.concat(F.col("right").cast("string"), F.lit("/"), F.col("expected").cast("string"), F.lit(" accessions right")))
    return counts.select("species", "organism", "method", "expected", "covered", "right", "filled", status.alias("status"), detail.alias("detail"))


def report_rates(report: DataFrame) -> DataFrame:
    """(status, species, percent) of a species report."""
    counts = report.groupBy("status").agg(F.count(F.lit(1)).alias("species"))
    return counts.withColumn("percent", F.round(F.col("species") * 100.0 / F.sum("species").over(Window.partitionBy()), 1))


def species_verdicts(expected: DataFrame, records: DataFrame) -> DataFrame:
    """Expected (species, gene, accession) against records (organism, gene_type, locusid): (species, organism, verdict).

    no data (no accession expected), not found (no organism by name), same (each accession is among the organism's loci of
    that gene) or different.
    """
    given = F.when(~F.coalesce(strip(F.col("accession")), F.lit("")).isin("", "-", "–"), strip(F.col("accession")))
    e = expected.select("species", F.col("gene").alias("gene_type"), given.alias("acc"))
    named = match_species(e.select(F.col("species").alias("name")), records.select("organism").where("organism is not null")).select(F.col("name").alias("species"), "organism")
    loci = records.select("organism", "gene_type", F.col("locusid")).distinct()
    hit = e.join(named, "species").where("acc is not null").join(loci, ["organism", "gene_type"]).where(F.contains("locusid", "acc")).select("species", "gene_type", "acc").distinct().withColumn("_hit", F.lit(True))
    j = e.join(hit, ["species", "gene_type", "acc"], "left").groupBy("species").agg(F.count("acc").alias("n"), F.count("_hit").alias("right"))
    verdict = F.when(F.col("n") == 0, "no data").when(F.col("organism").isNull(), "not found").when(F.col("n") == F.col("right"), "same").otherwise("different")
    return j.join(named, "species").select("species", "organism", verdict.alias("verdict"))


def organism_genes(records: DataFrame, order: str = "row_id") -> DataFrame:
    """(organism, gene_type, loci): the loci of each pair in order, between ``; ``."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct(order, "locusid"))), lambda x: x["locusid"])
    return records.where("organism is not null and gene_type is not null and locusid is not null").groupBy("organism", "gene_type").agg(F.array_join(ids, "; ").alias("loci"))


def organism_union(matrix_rows: DataFrame, column: str, organism: str = "organism") -> DataFrame:
    """(organism, ids): the distinct ids of a matrix column over all specimens of an organism, sorted."""
    ids = matrix_rows.select(organism, F.explode(F.split(F.col(f"`{column}`"), ";")).alias("id")).where("trim(id) != ''")
    return ids.groupBy(organism).agg(F.array_join(F.array_sort(F.collect_set(F.trim("id"))), "; ").alias("ids"))
