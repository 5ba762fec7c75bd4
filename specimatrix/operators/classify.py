"""Records to markers by prioritised phrase rules, each decision with its reasons. Row by row: nothing is shuffled."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specimatrix.functions.phrases import DICTIONARY, MITOCHONDRIAL, NUCLEAR, has_any
from specimatrix.functions.text import strip
from specimatrix.session import computed

#: What a classified record gains, in this order before its own columns.
DIAGNOSTICS = ("gene_type", "match_source", "original_match", "has_conflict", "conflict_reason", "assignment_reason")


# The texts of reasons, notes and conflicts.
TEXTS = {
    "range": "Length {n} outside range {r}",
    "short": "mtgenome: keyword matched but Length={n}<=3000",
    "outside": "{g}: keyword matched but length {n} outside range {r}",
    "priority": "{g}: priority match hit",
    "inside": "{g}: keyword matched, length {n} in range {r}",
    "unfiltered": "{g}: keyword matched (no length filter)",
    "special": "Special type (mtgenome/18-28s/its1-its2), skip conflict check",
    "genome": "Mitochondrial multi-match ({k}) + Length>3000 -> reassigned to mtgenome",
    "many": "Mitochondrial multi-match but insufficient length, kept original + flagged",
    "many_why": "Mitochondrial multi-match ({k}) but length {n}<3000",
    "dual": "Dual match + '{t}' in definition, kept original + flagged",
    "dual_why": "Two mitochondrial genes + definition contains '{t}'",
    "12s": "12s matched with 'large subunit ribosomal' in definition, possible 16S mismatch, flagged",
    "12s_why": "12s conflicts with 'large subunit ribosomal' description",
    "16s": "16s matched with 'small subunit ribosomal' in definition, possible 12S mismatch, flagged",
    "16s_why": "16s conflicts with 'small subunit ribosomal' description",
    "long": "{g} in definition with 'mitochondrial' but length {n}>800, kept {g}",
    "long_why": "{g} conflicts with mitochondrial annotation",
    "brief": "{g} in definition with 'mitochondrial' and length {n}<=800, flagged as uncertain",
    "brief_why": "{g} conflicts with mitochondrial annotation, short length",
    "several": "Multiple candidates flagged as conflict",
    "several_why": "Multiple candidate gene types: {t}",
    "again": "Reassigned: [{a}] -> [{b}]",
    "second": "[conflict check] {t}",
    "circular": "Topology=circular -> direct mtgenome",
    "whole": "mtgenome: keyword + Length>3000 + DNA + mitochondrial features",
    "unmet": "mtgenome: conditions not met (Length={n}, MoleculeType={m}, mito_in_def={d}, mito_in_org={o})",
    "keyword": "{g}: keyword matched",
    "primer_coi": "PCR primer match (HCO2198/lc01490) -> coi",
    "primer_28s": "PCR primer match (28SC1) -> 28s",
    "multiple": "Multiple candidates: {t}",
    "mito": "Mitochondrial candidate ({t}) but no mitochondrial marker in organelle/definition",
    "nuclear": "Nuclear candidate ({t}) but mitochondrial marker in organelle/definition",
}


def say(name: str, **values) -> Column:
    """One of the texts with its gaps filled by columns or plain texts."""
    parts = re.split(r"\{(\w)\}", TEXTS[name])
    filled = [F.lit(p) if i % 2 == 0 else v.cast("string") if isinstance(v := values[p], Column) else F.lit(v) for i, p in enumerate(parts) if p]
    return F.concat(*filled) if len(filled) > 1 else filled[0]


def interval(text: str | None) -> tuple[int | None, int | None]:
    """``lo:hi`` or ``lo,hi``, either side open; nothing and ``none`` are unbounded."""
    if not text or text.lower() == "none":
        return None, None
    lo, _, hi = text.partition(":" if ":" in text else ",")
    return (int(lo) if lo.strip() else None), (int(hi) if hi.strip() else None)


def within(length: Column, text: str | None) -> Column:
    """True if the length lies in the closed interval; a missing length passes."""
    lo, hi = interval(text)
    ok = F.lit(True)
    if lo is not None:
        ok = ok & (length >= lo)
    if hi is not None:
        ok = ok & (length <= hi)
    return F.coalesce(ok, F.lit(True))


def length_of(text: Column) -> Column:
    """``650 bp`` as a number; null where it is none."""
    return F.regexp_replace(text, r"\s*bp\s*", "").try_cast("double").cast("int")


@dataclass(frozen=True)
class Rules:
    """Parameters of both rounds; the names are those of the record's columns."""

    dictionary: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(DICTIONARY))
    mitochondrial: tuple[str, ...] = MITOCHONDRIAL
    nuclear: tuple[str, ...] = NUCLEAR
    overall: str = "150:50000"
    mito_length: str = "150:50000"
    nuclear_length: str = "150:50000"
    lengths: dict[str, str] = field(default_factory=lambda: {"mtgenome": "3000:500000", "18-28s": "5000:15000"})
    stop_at_first: bool = False
    reasons: bool = True
    conflicts: bool = True
    definition: str = "definition"
    length: str = "seq_length"
    organelle: str = "organelle"
    molecule: str = "moleculetype"
    topology: str = "topology"
    primers: str = "pcr_primers"
    locus: str = "locusid"
    order: str = "row_id"

    def range_of(self, gene: str) -> str:
        return self.lengths.get(gene, "none")


def keep_first(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key by a unique order; rows without key count as one key.

    Minima are combined before the shuffle and the rows are found again by their order, so no key's rows meet in one task.
    """
    firsts = df.groupBy(key).agg(F.min(order).alias(order)).select(order)
    return df.join(firsts, order, "left_semi")


def attribute_filter(df: DataFrame, molecule: str = "all", mol_type: str = "all", length: str = "all", organelle: str = "all", columns: tuple[str, str, str, str] = ("moleculetype", "mol_type", "seq_length", "organelle")) -> DataFrame:
    """Rows of the given molecule, one of the given types, a length range and an organelle; ``all`` does not filter."""
    low = lambda c: F.lower(F.col(c))
    if molecule.lower() != "all":
        df = df.where(low(columns[0]) == molecule.lower())
    if mol_type.lower() != "all":
        df = df.where(low(columns[1]).isin([t.strip().lower() for t in mol_type.split(",")]))
    if length.lower() != "all":
        lo, hi = interval(length)
        n = length_of(F.col(columns[2]))
        df = df.where((n >= lo if lo is not None else F.lit(True)) & (n <= hi if hi is not None else F.lit(True)))
    if organelle.lower() != "all":
        df = df.where(low(columns[3]) == organelle.lower())
    return df


def overall_length(df: DataFrame, rules: Rules) -> DataFrame:
    """Rows whose length lies in the overall range; those without a length do not."""
    lo, hi = interval(rules.overall)
    n = length_of(F.col(rules.length))
    return df.where(n.isNotNull() & (n >= lo if lo is not None else F.lit(True)) & (n <= hi if hi is not None else F.lit(True)))


def prepared(df: DataFrame, rules: Rules) -> DataFrame:
    """``df`` with what both rounds look at: text, length, group and the markers whose phrases occur."""
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    primers = F.coalesce(F.col(rules.primers), F.lit("")) if rules.primers in df.columns else F.lit("")
    df = computed(df, {"_def": strip(low(rules.definition)), "_n": F.coalesce(length_of(F.col(rules.length)), F.lit(0)), "_org": strip(low(rules.organelle)), "_mol": strip(low(rules.molecule)), "_top": strip(low(rules.topology)), "_pcr": strip(primers)})
    hits = {f"_hit_{g}": has_any(F.col("_def"), p) for g, p in rules.dictionary.items()}
    return computed(df, hits | {"_mito": F.col("_org").contains("mitochondrion")})


def _hit(gene: str, rules: Rules) -> Column:
    return F.col(f"`_hit_{gene}`") if gene in rules.dictionary else F.lit(False)


def _group_match(genes: tuple[str, ...], priority: tuple[str, ...], length: str, rules: Rules) -> tuple[Column, Column]:
    """Markers and notes of the first round for one group."""
    n = F.col("_n")
    priority = tuple(g for g in priority if g in genes)
    out_of_range = lambda g: say("outside", g=g, n=n, r=rules.range_of(g))
    fits = {g: _hit(g, rules) & within(n, rules.range_of(g)) & ((n > 3000) if g == "mtgenome" else F.lit(True)) for g in priority}
    notes = {}
    for g in priority:
        short = F.when(F.lit(g == "mtgenome") & within(n, rules.range_of(g)), say("short", n=n)).otherwise(out_of_range(g))
        notes[g] = F.when(_hit(g, rules) & ~fits[g], short)
    rest = [g for g in sorted(genes) if g not in priority and rules.dictionary.get(g)]
    ok = {g: _hit(g, rules) & within(n, rules.range_of(g)) for g in rest}
    found = F.array_compact(F.array(*[F.when(ok[g], F.lit(g)) for g in rest]))
    hit_note = lambda g: say("unfiltered", g=g) if rules.range_of(g) == "none" else say("inside", g=g, n=n, r=rules.range_of(g))
    rest_notes = F.array(*[F.when(ok[g], hit_note(g)).when(_hit(g, rules), out_of_range(g)) for g in rest])
    if rules.stop_at_first:
        found = F.slice(found, 1, 1)
        before = [~F.greatest(*[ok[x] for x in rest[:i]], F.lit(False)) if i else F.lit(True) for i in range(len(rest))]
        rest_notes = F.array(*[F.when(before[i], rest_notes[i]) for i in range(len(rest))])
    genes_col, notes_col = found, F.array_compact(F.concat(F.array(*[notes[g] for g in priority]), rest_notes))
    for i in range(len(priority) - 1, -1, -1):
        g = priority[i]
        earlier = F.array_compact(F.array(*[notes[x] for x in priority[:i]], say("priority", g=g)))
        genes_col = F.when(fits[g], F.array(F.lit(g))).otherwise(genes_col)
        notes_col = F.when(fits[g], earlier).otherwise(notes_col)
    inside = within(n, length)
    none = F.array().cast("array<string>")
    return F.when(inside, genes_col).otherwise(none), F.when(inside, notes_col).otherwise(F.array(say("range", n=n, r=length)))


def _ribosomal(genes: Column) -> Column:
    """The gene that contradicts its own definition, with conflict and note; null if none does."""
    d, n = F.col("_def"), F.col("_n")
    has = lambda g: F.array_contains(genes, g)
    told = lambda g, text: F.struct(F.lit(g).alias("gene"), say(f"{text}_why", g=g).alias("conflict"), say(text, g=g, n=n).alias("note"))
    out = F.when(has("12s") & d.contains("large subunit ribosomal"), told("12s", "12s")).when(has("16s") & d.contains("small subunit ribosomal"), told("16s", "16s"))
    for g in ("18s", "28s"):
        mito = has(g) & d.contains("mitochondrial")
        out = out.when(mito & (n > 800), told(g, "long")).when(mito, told(g, "brief"))
    return out


def _first_look(df: DataFrame, rules: Rules) -> tuple[DataFrame, dict[str, Column]]:
    """Prepared records with what the first round needs, and its diagnostics."""
    n, d = F.col("_n"), F.col("_def")
    mg, mn = _group_match(rules.mitochondrial, ("mtgenome",), rules.mito_length, rules)
    ng, nn = _group_match(rules.nuclear, ("18-28s", "its1-its2"), rules.nuclear_length, rules)
    df = computed(df, {"_genes": F.array_sort(F.when(F.col("_mito"), mg).otherwise(ng)), "_notes": F.when(F.col("_mito"), mn).otherwise(nn)})
    genes, k = F.col("_genes"), F.size("_genes")
    df = computed(df, {"_rib": _ribosomal(genes), "_first": F.array_join(genes, ",")})
    rib = F.col("_rib")
    special = F.arrays_overlap(genes, F.array(*[F.lit(g) for g in ("mtgenome", "18-28s", "its1-its2")]))
    trigger = F.when(d.contains("trna"), F.lit("tRNA")).when(d.contains("complete sequence"), F.lit("complete sequence"))
    many = F.col("_mito") & (k > 2)
    dual = F.col("_mito") & (k == 2) & trigger.isNotNull()
    verdict = lambda genes, conflict, note: F.struct(genes.alias("genes"), conflict.alias("conflict"), note.alias("note"))
    no = F.lit(None).cast("string")
    checked = (
        F.when(special, verdict(genes, no, say("special")))
        .when(many & (n > 3000), verdict(F.array(F.lit("mtgenome")), no, say("genome", k=k)))
        .when(many, verdict(genes, say("many_why", k=k, n=n), say("many")))
        .when(dual, verdict(genes, say("dual_why", t=trigger), say("dual", t=trigger)))
        .when(rib.isNotNull(), verdict(F.array(rib["gene"]), rib["conflict"], rib["note"]))
        .otherwise(verdict(genes, no, no))
    )
    df = computed(df, {"_c": checked})
    df = computed(df, {"_last": F.array_join("_c.genes", ",")})
    multiple = (F.size("_c.genes") > 1) & F.col("_c.conflict").isNull() & ~special
    again = F.col("_last") != F.col("_first")
    second = F.array_compact(
        F.array(
            F.col("_c.note"),
            F.when(multiple, say("several")),
            F.when(again, say("again", a=F.col("_first"), b=F.col("_last"))),
        )
    )
    found = k > 0
    conflict = F.when(multiple, say("several_why", t=F.array_join("_c.genes", ", "))).otherwise(F.coalesce("_c.conflict", F.lit("")))
    reasons = F.concat_ws("; ", F.when(F.size("_notes") > 0, F.array_join("_notes", "; ")), F.when(found & (F.size(second) > 0), say("second", t=F.array_join(second, "; "))))
    values = {
        "gene_type": F.when(found, F.col("_last")).otherwise(""),
        "match_source": F.when(found & again, "first_match -> conflict_check").when(found, "first_match").otherwise(""),
        "original_match": F.when(found, F.col("_first")).otherwise(""),
        "has_conflict": found & (multiple | F.col("_c.conflict").isNotNull()),
        "conflict_reason": F.when(found, conflict).otherwise(""),
        "assignment_reason": reasons,
    }
    return df, values


def _with_diagnostics(df: DataFrame, values: dict[str, Column], own: list[str], rules: Rules) -> DataFrame:
    kept = [c for c in DIAGNOSTICS if (rules.reasons or c != "assignment_reason") and (rules.conflicts or c != "conflict_reason")]
    return df.select(*[values[c].alias(c) for c in kept], *[F.col(c) for c in own if c not in DIAGNOSTICS])


def names_primer(text: Column, names: str) -> Column:
    """True if a forward or reverse primer of one of the names (a pattern) is given."""
    return text.rlike(rf"(?i)(?:fwd|rev)_name:\s*(?:{names})")


def _second_range(rules: Rules) -> Column:
    """The lengths that the second round looks at: the union of both groups' ranges."""
    (a, b), (c, e) = interval(rules.mito_length), interval(rules.nuclear_length)
    n = length_of(F.col(rules.length))
    return (n >= min(a or 0, c or 0)) & ((n <= max(b, e)) if b and e else F.lit(True))


def _second_look(df: DataFrame, rules: Rules, gate: Column | None = None) -> tuple[DataFrame, dict[str, Column]]:
    """Prepared records with what the second round needs, and its diagnostics; nothing is evaluated where ``gate`` is false."""
    only = (lambda c: F.when(gate, c)) if gate is not None else (lambda c: c)
    n, d = F.col("_n"), F.col("_def")
    in_def = d.rlike("mitochondri(?:on|al|a)")
    in_org = F.col("_org").rlike("mitochondri(?:on|al|a)")
    circular = F.col("_top") == "circular"
    whole = _hit("mtgenome", rules) & (n > 3000) & (F.col("_mol") == "dna") & (in_def | in_org)
    listed = [g for g, p in rules.dictionary.items() if p]
    by_phrase = F.array_compact(F.array(*[F.when(whole if g == "mtgenome" else _hit(g, rules), F.lit(g)) for g in listed]))
    told = F.array_compact(F.array(*[F.when(whole, say("whole")) if g == "mtgenome" else F.when(_hit(g, rules), say("keyword", g=g)) for g in listed]))
    coi, s28 = names_primer(F.col("_pcr"), "HCO2198|lc01490|LCO1490"), names_primer(F.col("_pcr"), "28SC1")
    by_primer = F.array_compact(F.array(F.when(coi, F.lit("coi")), F.when(s28, F.lit("28s"))))
    primer_notes = F.array_compact(F.array(F.when(coi, say("primer_coi")), F.when(s28, say("primer_28s"))))
    df = computed(df, {"_by": only(by_phrase), "_told": only(told)})
    genes = F.when(circular, F.array(F.lit("mtgenome"))).when(F.size("_by") > 0, F.col("_by")).otherwise(by_primer)
    notes = F.when(circular, F.array(say("circular"))).when(F.size("_by") > 0, F.col("_told")).otherwise(primer_notes)
    df = computed(df, {"_genes2": only(F.array_sort(genes)), "_notes2": only(notes)})
    k, one = F.size("_genes2"), F.get(F.col("_genes2"), F.lit(0))
    true_false = lambda c: F.when(c, "True").otherwise("False")
    unmet = F.when(~circular & _hit("mtgenome", rules) & ~whole, say("unmet", n=n, m=F.col("_mol"), d=true_false(in_def), o=true_false(in_org)))
    mito = in_def | in_org
    against = F.array_compact(
        F.array(
            unmet,
            F.when(k > 1, say("multiple", t=F.array_join("_genes2", ", "))),
            F.when((k == 1) & one.isin(*rules.mitochondrial) & ~mito, say("mito", t=one)),
            F.when((k == 1) & one.isin(*rules.nuclear) & mito, say("nuclear", t=one)),
        )
    )
    df = computed(df, {"_against": only(against)})
    conflict = (F.size("_against") > 0) & (k > 0)
    joined = F.array_join("_genes2", ",")
    values = {
        "gene_type": joined,
        "match_source": F.when(k > 0, "recheck_mode").otherwise(""),
        "original_match": joined,
        "has_conflict": conflict,
        "conflict_reason": F.when(conflict, F.array_join("_against", "; ")).otherwise(""),
        "assignment_reason": F.array_join("_notes2", "; "),
    }
    return df, values


def round_one(df: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The first round with its conflict check: diagnostics before the record's own columns."""
    looked, values = _first_look(prepared(df, rules), rules)
    return _with_diagnostics(looked, values, df.columns, rules)


def round_two(df: DataFrame, rules: Rules = Rules(), filter_length: bool = True) -> DataFrame:
    """The second look at records that the first round left without a marker."""
    looked, values = _second_look(prepared(df.where(_second_range(rules)) if filter_length else df, rules), rules)
    return _with_diagnostics(looked, values, df.columns, rules)


def first_round(df: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Records in the overall length range, each locus once, with the first round's diagnostics."""
    return round_one(keep_first(overall_length(df, rules), rules.locus, rules.order), rules)


def unmatched(classified: DataFrame) -> DataFrame:
    return classified.where("gene_type = ''")


def matched(classified: DataFrame) -> DataFrame:
    return classified.where("gene_type != ''")


def multiple(classified: DataFrame) -> DataFrame:
    """Records with more than one marker."""
    return classified.where(F.size(F.split("gene_type", ",")) > 1)


def conflicting(classified: DataFrame) -> DataFrame:
    return classified.where("has_conflict")


def classify(df: DataFrame, rules: Rules = Rules(), recheck: bool = True, filter_length: bool = True) -> DataFrame:
    """Both rounds: the records with a marker, those of the second round after leftovers were looked at again.

    Both looks are expressions over the same prepared row, so records are read and brought together once.
    """
    if not recheck:
        return matched(first_round(df, rules))
    rows = keep_first(overall_length(df, rules), rules.locus, rules.order)
    looked, first = _first_look(prepared(rows, rules), rules)
    looked = computed(looked, {"_one": F.struct(*[c.alias(n) for n, c in first.items()])})
    left = F.col("_one.gene_type") == ""
    looked, second = _second_look(looked, rules, left & F.coalesce(_second_range(rules), F.lit(False)) if filter_length else left)
    values = {n: F.when(left, second[n]).otherwise(F.col("_one")[n]) for n in DIAGNOSTICS}
    looked = computed(looked, {"_both": F.struct(*[c.alias(n) for n, c in values.items()])}).where("_both.gene_type != ''")
    return _with_diagnostics(looked, {n: F.col("_both")[n] for n in DIAGNOSTICS}, df.columns, rules)


def category(definition: Column) -> Column:
    """What an unmatched definition seems to be; the first test that holds decides."""
    d = F.lower(F.coalesce(definition, F.lit("")))
    # Fixed values: (words any of which decides, category), in order.
    tests = [
        (("whole genome shotgun",), "whole_genome_shotgun"),
        (("genome assembly",), "genome_assembly"),
        (("tpa_asm", "tpa:"), "TPA_assembly"),
        (("chromosome:",), "chromosome_data"),
        (("scaffold",), "scaffold"),
        (("contig",), "contig"),
        (("mrna sequence", "cdna clone"), "mRNA/cDNA"),
        (("trna",), "tRNA"),
        (("rrna",), "nuclear_rRNA"),
        (("nad",), "NADH_dehydrogenase"),
        (("atp synthase", "atpase"), "ATP_synthase"),
        (("creatine kinase",), "creatine_kinase"),
        (("cytochrome b", "cytb"), "cytochrome_b_variant"),
    ]
    out = F
    for words, name in tests:
        hit = F.lit(False)
        for w in words:
            hit = hit | d.contains(w)
        if name == "nuclear_rRNA":
            hit = hit & ~d.contains("mitochondrial")
        out = out.when(hit, name)
    return out.otherwise("other")


def gene_rows(classified: DataFrame, genes: list[str] | None = None) -> DataFrame:
    """One row per record and marker of its comma list, ``gene`` trimmed; optionally of some markers only."""
    rows = classified.withColumn("gene", F.explode(F.transform(F.split("gene_type", ","), strip))).where("gene != ''")
    return rows.where(F.col("gene").isin(genes)) if genes else rows


def gene_list(classified: DataFrame) -> DataFrame:
    """The distinct markers of all comma lists."""
    return gene_rows(classified.select("gene_type")).select("gene").distinct()


def file_name(gene: str) -> str:
    """A marker as part of a file name."""
    return re.sub(_UNSAFE, "_", gene)


def safe_name(gene: Column) -> Column:
    """``file_name`` of a column."""
    return F.regexp_replace(gene, f"(?U){_UNSAFE}", "_")


_UNSAFE = r"[^\w\-]"
