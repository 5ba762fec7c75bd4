"""The specimen-by-marker matrix: one row per specimen, the records of each marker in order, and its metadata.

Repeated (specimen, marker, record) triples are reduced in a first shuffle; lists of records and metadata are then brought
together by specimen, each in one more. What a cell holds is what the result has to show.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specimatrix.functions.phrases import MARKERS
from specimatrix.functions.text import strip
from specimatrix.session import cut

MODES = ("first_nonempty", "all", "per_gene", "advanced")


@dataclass(frozen=True)
class MatrixRules:
    """Parameters; ``order`` is the unique column that tells which record comes first.

    Records without a key are one group, UNKNOWN, whose cells grow with their number; with ``separate_unknown`` each is a
    row of its own, ``UNKNOWN`` and its order, so that no cell grows with the data.
    """

    group: str = "species_voucher_new"
    organism: str = "organism"
    gene_type: str = "gene_type"
    locus: str = "locusid"
    order: str = "row_id"
    genes: tuple[str, ...] = MARKERS
    mode: str = "first_nonempty"
    metadata: tuple[str, ...] = ("country", "geo_loc_name", "lat_lon", "collection_date", "isolate", "specimen_voucher")
    tail: tuple[str, ...] = ("taxonid",)
    extra: tuple[str, ...] = ()
    prefer_reference: bool = False
    reference: str = "NC_"  # how preferred loci begin
    separate_unknown: bool = False
    spread_cluster: bool = True
    spread_genome: bool = True
    includes: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"18-28s": ("18s", "28s", "its1-its2")})
    genome_genes: tuple[str, ...] = ("coi", "16s", "12s", "cob", "cox2", "cox3", "nd1", "nd2", "nd3", "nd4", "nd4l", "nd5", "nd6", "atp6", "atp8", "cytb")

    def children(self, parent: str) -> list[str]:
        if parent == "mtgenome":
            return [g for g in self.genes if g in self.includes.get("mtgenome", self.genome_genes)]
        return [g for g in self.includes.get(parent, ()) if g in self.genes]


def group_key(rules: MatrixRules) -> Column:
    unknown = F.concat(F.lit("UNKNOWN "), F.col(rules.order).cast("string")) if rules.separate_unknown else F.lit("UNKNOWN")
    return F.coalesce(F.col(rules.group), unknown)


def gene_of(text: Column) -> Column:
    """A marker without the signs ``#`` and ``?`` at its end."""
    return F.regexp_replace(strip(text), r"[#?]+$", "")


def listed_genes(df: DataFrame, rules: MatrixRules) -> DataFrame:
    """One row per record and marker of the matrix: key, gene, locus, order and the metadata columns."""
    kept = [c for c in dict.fromkeys((*rules.metadata,)) if c in df.columns]
    genes = F.array_distinct(F.transform(F.split(rules.gene_type, ","), gene_of))
    rows = df.where(F.col(rules.gene_type).isNotNull()).select(group_key(rules).alias("_key"), F.explode(genes).alias("_gene"), strip(F.col(rules.locus)).alias("_locus"), F.col(rules.order).alias("_ord"), *kept)
    return rows.where(F.col("_gene").isin(*rules.genes))


def locus_lists(df: DataFrame, rules: MatrixRules) -> DataFrame:
    """(_key, one array of loci per marker), in order of first record, children with their parents' loci at the end."""
    firsts = listed_genes(df, rules).where("_locus is not null and _locus != ''").groupBy("_key", "_gene", "_locus").agg(F.min("_ord").alias("_ord"))
    of = lambda g: F.transform(F.array_sort(F.collect_list(F.when(F.col("_gene") == g, F.struct("_ord", "_locus")))), lambda x: x["_locus"])
    wide = firsts.groupBy("_key").agg(*[of(g).alias(f"g{i}") for i, g in enumerate(rules.genes)])
    col = {g: F.col(f"g{i}") for i, g in enumerate(rules.genes)}
    if rules.prefer_reference and "mtgenome" in col:
        ids = col["mtgenome"]
        reference = F.filter(ids, lambda x: F.upper(x).startswith(rules.reference))
        col["mtgenome"] = F.when((F.size(ids) > 1) & (F.size(reference) > 0), reference).otherwise(ids)
    for parent, on in (("18-28s", rules.spread_cluster), ("mtgenome", rules.spread_genome)):
        if on and parent in col:
            for child in rules.children(parent):
                col[child] = F.array_union(col[child], col[parent])
    return wide.select("_key", *[c.alias(f"g{i}") for i, (_, c) in enumerate(col.items())])


def first_nonempty(c: Column, order: str) -> Column:
    """The first trimmed text of a group that is not blank; '' if there is none."""
    text = strip(c)
    return F.coalesce(F.min_by(text, F.when(F.coalesce(text, F.lit("")) != "", F.col(order))), F.lit(""))


def _present(text: Column) -> Column:
    return F.coalesce(strip(text), F.lit("")) != ""


def _parts(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ";"), strip), lambda p: p != "")


def all_values(c: Column) -> Column:
    """The distinct pieces between semicolons of a group's texts, sorted."""
    return F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(_present(c), _parts(c)))))), ";")


def labelled_values(pairs: DataFrame, columns: list[str], placed: bool = False) -> DataFrame:
    """(_key, _genes, _column, _value) -> one text per key and column; ``placed`` if rows are already brought together by key.

    One value stands alone, and so do values that all active markers share; others carry the markers that have them.
    """
    genes = F.array_sort(F.array_distinct(F.flatten(F.collect_set("_genes"))))
    by_value = pairs.groupBy("_key", "_column", "_value").agg(genes.alias("_genes"))
    by_value = by_value if placed else by_value.repartition("_key")  # all that follows is by this key
    text = lambda x, n: F.when(F.size(x["_genes"]) == n, x["_value"]).otherwise(F.concat(F.array_join(x["_genes"], ","), F.lit(":"), x["_value"]))
    held = by_value.groupBy("_key", "_column").agg(F.array_sort(F.collect_list(F.struct("_value", "_genes"))).alias("v"))
    held = held.withColumn("_active", F.size(F.array_distinct(F.flatten(F.transform("v", lambda x: x["_genes"])))))
    lines = held.select("_key", "_column", F.when(F.size("v") == 1, F.col("v")[0]["_value"]).otherwise(F.array_join(F.transform("v", lambda x: text(x, F.col("_active"))), ";")).alias("t"))
    return lines.groupBy("_key").agg(*[F.coalesce(F.max(F.when(F.col("_column") == c, F.col("t"))), F.lit("")).alias(c) for c in columns])


def _long(rows: DataFrame, columns: list[str], *keys: str) -> DataFrame:
    values = F.array(*[F.struct(F.lit(c).alias("_column"), strip(F.col(c).cast("string")).alias("_value")) for c in columns])
    return rows.select(*keys, F.inline(values)).where(F.coalesce("_value", F.lit("")) != "")


def per_gene_values(df: DataFrame, rules: MatrixRules, columns: list[str]) -> DataFrame:
    """Each column's values with the markers of the records that have them."""
    return labelled_values(_long(listed_genes(df, rules).withColumn("_genes", F.array("_gene")), columns, "_key", "_genes"), columns)


def advanced_values(df: DataFrame, rules: MatrixRules, columns: list[str], lists: DataFrame) -> DataFrame:
    """As ``per_gene_values``, but by the loci that each marker lists after parents' loci were spread.

    A locus' texts are gathered in order, one that an earlier one contains is left out; values of loci that no marker
    lists come out without a marker.
    """
    texts = [strip(F.col(c).cast("string")).alias(f"_c{i}") for i, c in enumerate(columns)]
    rows = df.select(group_key(rules).alias("_key"), strip(F.col(rules.locus)).alias("_locus"), F.col(rules.order).alias("_ord"), *texts).where("_locus is not null and _locus != ''")
    names = [f"_c{i}" for i in range(len(columns))]
    alike = rows.groupBy("_key", "_locus", *names).agg(F.min("_ord").alias("_ord"))  # repeated records are one from here
    held = alike.groupBy("_key", "_locus").agg(F.array_sort(F.collect_list(F.struct("_ord", *names))).alias("_r"))

    def joined(i: int) -> Column:
        given = F.filter(F.transform("_r", lambda x: x[f"_c{i}"]), lambda v: F.coalesce(v, F.lit("")) != "")
        return F.aggregate(given, F.lit(""), lambda acc, x: F.when(acc == "", x).when(F.contains(acc, x), acc).otherwise(F.concat(acc, F.lit(";"), x)))

    def named(c: str):
        return lambda v: F.struct(F.lit(c).alias("_column"), v.alias("_value"))

    values = F.flatten(F.array(*[F.transform(_parts(joined(i)), named(c)) for i, c in enumerate(columns)]))
    held = held.select("_key", "_locus", values.alias("_values"))
    listed = F.array(*[F.struct(F.lit(g).alias("_gene"), F.col(f"g{i}").alias("_ids")) for i, g in enumerate(rules.genes)])
    links = lists.select("_key", F.inline(listed)).select("_key", "_gene", F.explode("_ids").alias("_locus")).groupBy("_key", "_locus").agg(F.collect_set("_gene").alias("_genes"))
    pairs = held.join(links, ["_key", "_locus"], "left").select("_key", F.coalesce("_genes", F.array(F.lit("_unlinked"))).alias("_genes"), "_values").repartition("_key")
    pairs = pairs.select("_key", "_genes", F.inline("_values"))
    out = labelled_values(pairs, columns, placed=True)
    return out.select("_key", *[F.replace(F.col(c), F.lit("_unlinked:"), F.lit("")).alias(c) for c in columns])


def matrix(df: DataFrame, rules: MatrixRules = MatrixRules()) -> DataFrame:
    """One row per specimen: key, organism, a text of loci per marker, metadata by ``rules.mode``, tail and extra columns.

    Columns that ``df`` lacks come out empty. A null key is the group UNKNOWN. Blank loci, and markers that are not
    columns of the matrix, are left out.
    """
    if rules.mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    lists = locus_lists(df, rules)
    lists = cut(lists) if rules.mode == "advanced" else lists  # read twice there
    if rules.mode == "all":
        own = {rules.group, rules.organism, rules.gene_type, rules.locus, rules.order, *rules.genes}
        wanted = [c for c, t in df.dtypes if c not in own and t == "string"]
    else:
        wanted = list(rules.metadata)
    there = [c for c in wanted if c in df.columns]
    late = [c for c in dict.fromkeys((*rules.tail, *rules.extra)) if c not in wanted]
    first = [c for c in late if c in df.columns] + (there if rules.mode == "first_nonempty" else [])
    aggs = [first_nonempty(F.col(c), rules.order).alias(c) for c in first]
    aggs += [all_values(F.col(c)).alias(c) for c in there] if rules.mode == "all" else []
    organism = first_nonempty(F.col(rules.organism), rules.order) if rules.organism in df.columns else F.max(F.lit(""))
    out = df.withColumn("_key", group_key(rules)).groupBy("_key").agg(organism.alias("_organism"), *aggs)
    if rules.mode == "per_gene" and there:
        out = out.join(per_gene_values(df, rules, there), "_key", "left")
    elif rules.mode == "advanced" and there:
        out = out.join(advanced_values(df, rules, there, lists), "_key", "left")
    out = out.join(lists, "_key", "left")
    loci = [F.coalesce(F.array_join(f"g{i}", ";"), F.lit("")).alias(g) for i, g in enumerate(rules.genes)]
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c)
    return out.select(F.col("_key").alias(rules.group), F.col("_organism").alias(rules.organism), *loci, *[text(c) for c in dict.fromkeys((*wanted, *late))])


def coverage(matrix_rows: DataFrame, genes: tuple[str, ...] = MARKERS) -> DataFrame:
    """(gene, specimens): how many specimens have each marker."""
    counts = matrix_rows.agg(*[F.count_if(F.col(f"`{g}`") != "").alias(g) for g in genes])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(g).alias("gene"), F.col(f"`{g}`").alias("specimens")) for g in genes])))
