"""The phrase dictionary: which phrases in a definition tell which marker, and how phrases become patterns."""

from __future__ import annotations

import csv
import json
import re
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specimatrix.functions.text import quote_regex
from specimatrix.session import bounded

# Marker -> phrases that tell it.
DICTIONARY: dict[str, tuple[str, ...]] = {
    "coi": ("cytochrome oxidase I", "cytochrome oxidase subunit 1 gene", "cytochrome c oxidase subunit I", "cytochrome oxidase subunit I", "cytochrome oxidase subunit 1", "mitochondrial COI", "cytochrome c oxidase I", "cytochrome c oxidase subunit 1", "cytochrome c oxidase gene", "cox1", "cytochrome oxidase subunit I-like", "COI", "CO1", "COXI"),
    "16s": ("16S ribosomal RNA", "16S ribosomal RNA gene, partial sequence; mitochondrial", "large subunit ribosomal RNA gene, partial sequence; mitochondrial", "mitochondrial gene for 16S rRNA, partial sequence", "16S ribosomal RNA, partial sequence", "large subunit ribosomal RNA", "16S rRNA gene", "16S ribosomal RNA gene", "16S-rRNA", "16S ribosomal", "16S large subunit rRNA gene", "ribosomal RNA large subunit", "16s rRNA", "16S subunit RNA"),
    "12s": ("12S ribosomal RNA gene, partial sequence; mitochondrial", "mitochondrial gene for 12S ribosomal RNA, patial sequence", "small subunit ribosomal RNA gene, partial sequence; mitochondrial", "small subunit ribosomal RNA gene", "small subunit ribosomal", "12S rRNA gene", "12S rRNA", "12S small subunit rRNA gene", "12S rRNA, partial sequence", "ribosomal RNA small subunit", "12S ribosomal RNA"),
    "cob": ("cytochrome b", "cytb", "cytochrome b gene, partial cds; mitochondrial", "mitochondrial cytb gene for cytochrome b, partial cds", "cytochrome b (Cytb) gene, partial cds; mitochondrial", "cytochrome oxidase subunit b", "COB", "cytochrome b-like"),
    "mtgenome": ("organelle: mitochondrion", "mitochondrion, complete genome", "mitochondrion, partial genome", "mitochondrion sequence", "mitochondrial genome", "mitochondrial DNA, nearly complete genome", "chromosome: MIT", "mitochondrial_genome", "mt genome", "mtDNA", "complete sequence", "complete genome", "mitogenome", "mitochondrion, complete sequence"),
    "cox3": ("cytochrome oxidase subunit III", "cytochrome c oxidase subunit 3", "cytochrome oxidase 3", "cytochrome c oxidase subunit III", "cytochrome c oxidase III", "cytochrome oxidase subunit 3 mRNA", "cytochrome oxidase subunit 3", "cytochrome c oxidase subunit III (cox3) gene", "COX3", "CO3", "COXIII"),
    "cox2": ("cytochrome oxidase subunit II", "cytochrome oxidase subunit 2", "cytochrome c oxidase subunit II", "cytochrome c oxidase subunit 2", "COX2", "CO2", "COXII"),
    "18-28s": ("18S ribosomal RNA gene, partial sequence; internal transcribed spacer 1, 5.8S rRNA gene, and internal transcribed spacer 2, complete sequence; and 28S ribosomal RNA gene", "18S ribosomal RNA gene, partial sequence; internal transcribed spacer 1, 5.8S rRNA gene, and internal transcribed spacer 2, complete sequence; and 28S ribosomal RNA gene, partial sequence", "small subunit ribosomal RNA gene, partial sequence; internal transcribed spacer 1, 5.8S rRNA gene, and internal transcribed spacer 2, complete sequence; and large subunit ribosomal RNA gene", "18S ribosomal RNA gene, internal transcribed spacer 1, 5.8S rRNA gene, internal transcribed spacer 2, and 28S ribosomal RNA gene, complete sequence", "18S ribosomal RNA gene, internal transcribed spacer 1, 5.8S rRNA gene, and internal transcribed spacer 2, complete sequence; and 28S ribosomal RNA gene", "18S ribosomal RNA gene, internal transcribed spacer 1, 5.8S rRNA gene, and internal transcribed spacer 2, complete sequence; and 28S ribosomal RNA gene, partial sequence", "18S ribosomal RNA gene, complete sequence; and 28S ribosomal RNA gene, partial sequence"),
    "its1-its2": ("5.8S rRNA", "5.8S ribosomal RNA", "internal transcribed spacer", "ITS1", "ITS2", "internal transcribed spacer 1 intergenic spacer", "internal transcribed spacer 1 intergenic spacer, partial sequence; 5.8S ribosomal RNA gene, complete sequence; and internal transcribed spacer 2 intergenic spacer, partial sequence", "ITS"),
    "28s": ("28S ribosomal RNA gene", "28S ribosomal RNA gene, partial sequence", "large subunit ribosomal RNA gene, partial sequence", "28S rRNA, partial sequence", "28S rRNA", "large subunit ribosomal RNA", "ribosomal RNA large subunit gene", "28S ribosomal RNA"),
    "ef-1": ("elongation factor-1 alpha (EF-1 alpha) mRNA", "elongation factor-1", "elongation factor-1alpha", "elongation factor 1-alpha", "ef1a", "ef-1a", "elongation factor 1 alpha", "EF1alpha"),
    "18s": ("small subunit ribosomal RNA gene, partial sequence", "18S ribosomal RNA, partial sequence", "18s rRNA, complete sequence", "18S rRNA, partial sequence", "18S ribosomal RNA gene, partial sequence", "18S ribosomal RNA gene", "18S ribosomal RNA", "small subunit RNA", "nuclear small subunit ribosomal RNA", "small subunit ribosomal RNA", "macronuclear small-subunit ribosomal RNA", "18S small subunit ribosomal RNA", "18S rRNA", "small subunit ribosomal RNA gen", "ribosomal RNA small-subunit"),
    "h3": ("histone H3", "histone 3", "histone 3 (H3)", "histone 3 (H3) gene, partial cds", "histone H3 gene", "H3 histone", "histone (H3) gene", "histone 3 gene"),
}

# The two groups of markers, and the order of the matrix columns.
MITOCHONDRIAL = ("12s", "16s", "cob", "coi", "cox2", "cox3", "mtgenome")
NUCLEAR = ("18-28s", "18s", "28s", "ef-1", "h3", "its1-its2")
MARKERS = ("mtgenome", "coi", "16s", "12s", "cob", "cox2", "cox3", "18s", "28s", "its1-its2", "18-28s", "ef-1", "h3")


def phrase_pattern(phrase: str) -> str:
    """A phrase as a pattern over lower case text: at word boundaries, or beside white space where it ends in a sign."""
    low = phrase.lower()
    edge = lambda ch: bool(re.match(r"\w", ch))
    left = r"\b" if edge(low[0]) else r"(?<=\s|^)"
    right = r"\b" if edge(low[-1]) else r"(?=\s|$)"
    return left + quote_regex(low) + right


def telling(phrases) -> list[str]:
    """The distinct phrases, lower case, without those that contain another one as whole words: they tell nothing more."""
    unique = list(dict.fromkeys(p.lower() for p in phrases if p))
    inside = lambda a, b: a != b and re.search(phrase_pattern(a).replace(r"(?<=\s|^)", r"(?:(?<=\s)|^)"), b)
    return [p for p in unique if not any(inside(o, p) for o in unique)]


def has_any(text: Column, phrases) -> Column:
    """True if the lower case text has one of the phrases.

    Plain substring tests come first, which are many times faster; word boundaries are looked at where one succeeds.
    """
    needed = telling(phrases)
    if not needed:
        return F.lit(False)
    found = reduce(lambda a, b: a | b, [text.contains(p) for p in needed])
    return F.when(found, text.rlike(any_pattern(needed))).otherwise(False)


def any_pattern(phrases) -> str:
    """One pattern for all phrases of a marker; one that never matches if there are none."""
    unique = list(dict.fromkeys(p.lower() for p in phrases if p))
    return "(?U)(?:" + "|".join(map(phrase_pattern, unique)) + ")" if unique else r"(?!)"


def merge(*dictionaries: dict) -> dict[str, tuple[str, ...]]:
    """Union of the phrases of each marker, lower case keys, order kept, case-insensitively distinct."""
    out: dict[str, dict[str, str]] = {}
    for d in dictionaries:
        for marker, phrases in d.items():
            known = out.setdefault(marker.strip().lower(), {})
            for p in phrases:
                if p.strip():
                    known.setdefault(p.strip().lower(), p.strip())
    return {m: tuple(ps.values()) for m, ps in out.items()}


def _whole_text(path: str) -> str:
    """A small file's text, from this machine or, by its URI, from any file system that the session reads."""
    if re.match(r"\w+://", path):
        from pyspark.sql import SparkSession

        return SparkSession.active().read.text(path, wholetext=True).first()[0]
    return Path(path).read_text(encoding="utf-8")


def load_dictionary(path: str) -> dict[str, tuple[str, ...]]:
    """A dictionary file: ``marker: a, b`` lines (.txt), marker,synonyms rows (.csv) or a synonyms list per marker (.yaml).

    Python files are refused: a dictionary is data and is never executed.
    """
    kind, text = Path(path).suffix.lower(), _whole_text(path)
    found: dict[str, list[str]] = {}
    if kind == ".txt":
        for line in text.splitlines():
            marker, colon, phrases = line.partition(":")
            if colon and not line.lstrip().startswith("#"):
                found.setdefault(marker, []).extend(phrases.split(","))
    elif kind == ".csv":
        for row in csv.DictReader(text.splitlines()):
            found.setdefault(row["gene"], []).extend((row.get("synonyms") or "").replace(";", ",").split(","))
    elif kind in (".yaml", ".yml"):
        marker = None
        for line in text.splitlines():
            if m := re.match(r"^ {2}([^\s#:][^:]*):\s*$", line):
                marker = m[1].strip("'\"")
            elif (m := re.match(r"^\s+-\s+(.*\S)\s*$", line)) and marker:
                found.setdefault(marker, []).append(json.loads(m[1]) if m[1].startswith('"') and m[1].endswith('"') else m[1].strip("'\""))
    else:
        from specimatrix.sources.tables import UnsupportedFormatError

        raise UnsupportedFormatError(f"No dictionary format: {kind or path}")
    return merge(found)


# Synonyms that are too short or too vague to tell a marker, and the least length of one.
VAGUE = ("I", "COX", "CO", "ND", "ATP", "rbcL")
LEAST = 3


def read_synonyms(path: str) -> list[str]:
    """The first column of a tab-separated synonym table with header, without vague and very short ones."""
    names = [row[0].strip() for row in csv.reader(_whole_text(path).splitlines(), delimiter="\t") if row][1:]
    return [n for n in names if len(n) >= LEAST and n not in VAGUE]


def _useful(names) -> tuple[str, ...]:
    """Synonyms that are neither vague nor very short, in order; the first of several that differ in case."""
    kept: dict[str, str] = {}
    for n in names:
        if len(n) >= LEAST and n not in VAGUE:
            kept.setdefault(n.lower(), n)
    return tuple(kept.values())


def extended(base: dict, mitochondrial: dict | None = None, chloroplast: dict | None = None) -> dict[str, dict]:
    """A dictionary of the second form: marker -> category, scope and synonyms.

    Synonyms of ``mitochondrial`` join those of the same marker or make a new one; a ``chloroplast`` marker whose name is
    taken gets the prefix ``cp_``. Vague and very short synonyms are left out; the first of several that differ in case
    stays.
    """
    animals, plants = ("metazoa", "fungi"), ("viridiplantae",)
    out: dict[str, dict] = {}
    for marker, names in base.items():
        kind = "mitochondrial" if marker in MITOCHONDRIAL else "nuclear" if marker in NUCLEAR else "unknown"
        scope = {"mitochondrial": animals, "nuclear": ("metazoa", *plants, "fungi")}.get(kind, ("all",))
        out[marker] = {"category": kind, "scope": scope, "synonyms": _useful([*names, *(mitochondrial or {}).get(marker, ())])}
    for marker, names in (mitochondrial or {}).items():
        out.setdefault(marker, {"category": "mitochondrial", "scope": animals, "synonyms": _useful(names)})
    for name, names in sorted((chloroplast or {}).items()):
        if kept := _useful(names):
            marker = name.lower()
            out[marker if marker not in out else f"cp_{marker}"] = {"category": "chloroplast", "scope": plants, "synonyms": kept}
    return out


def write_yaml(dictionary: dict[str, dict], path: str) -> str:
    """A dictionary of the second form as YAML, by category, then name; ``load_dictionary`` reads it back."""
    rank = ("mitochondrial", "chloroplast", "nuclear")
    order = sorted(dictionary, key=lambda m: (rank.index(c) if (c := dictionary[m]["category"]) in rank else len(rank), m))
    quoted = lambda text: json.dumps(text, ensure_ascii=False) if re.search(r"[^\w ()-]|^\W", text) else text
    lines = ['version: "2.0"', "metadata:", '  description: "Marker dictionary with category and scope"', "gene_types:"]
    for m in order:
        d = dictionary[m]
        lines += [f"  {m}:", f"    category: {d['category']}", f"    scope: [{', '.join(d['scope'])}]", "    synonyms:", *[f"      - {quoted(s)}" for s in d["synonyms"]]]
    Path(path).write_text("\n".join(lines) + "\n", encoding="utf-8")
    return path


def as_table(spark, dictionary: dict) -> DataFrame:
    """(marker, phrase) rows of a dictionary."""
    return spark.createDataFrame([(m, p.lower()) for m, ps in dictionary.items() for p in dict.fromkeys(x.lower() for x in ps)], "marker string, phrase string")


def phrase_join(rows: DataFrame, dictionary: DataFrame, text: str = "definition", row_id: str = "row_id") -> DataFrame:
    """(row_id, marker) for a dictionary that is a table of any size: an equi-join on the phrases' first words.

    Only texts that contain a phrase's first word meet the phrase, where the whole of it is then compared. A dictionary of
    a checked size goes to the texts, which then are not moved; beyond that size the words meet by a shuffle.
    """
    low = F.lower(F.col(text))
    first = lambda c: F.regexp_extract(c, r"([\p{L}\p{N}_]+)", 1)
    words = rows.where(F.col(text).isNotNull()).select(F.col(row_id).alias("row_id"), low.alias("_text"), F.explode(F.array_distinct(F.regexp_extract_all(low, F.lit(r"([\p{L}\p{N}_]+)"), 1))).alias("_word"))
    edge = r"(^|[^\p{L}\p{N}_])"
    escaped = F.regexp_replace(F.col("phrase"), r"([\\.\[\]{}()*+?^$|-])", r"\\$1")
    pattern = F.concat(F.lit(edge), escaped, F.lit(r"([^\p{L}\p{N}_]|$)"))
    phrases = bounded(dictionary.select("marker", "phrase", first(F.col("phrase")).alias("_word"), pattern.alias("_pattern")))
    hit = F.col("_text").contains(F.col("phrase")) & F.expr("_text rlike _pattern")
    return words.join(phrases, "_word").where(hit).select("row_id", "marker").distinct()
