"""Freely typed marker names mapped to the entries of the marker list.

The list's entries, by their name, their full name and the aliases of a table, form a trie. A text is searched from the
start of each of its words with a Levenshtein automaton that walks the trie: it returns every spelling that ends at a
word's end within a distance that grows with the spelling's length. Digits and words of one or two letters must be exact.
Of overlapping hits the one that explains most of the text holds.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specimatrix.functions.text import narrow
from specimatrix.operators.packed import atoms
from specimatrix.session import fixed_rows

#: What a text denotes alone if it names one of these at all.
WHOLE = ("mtgenome", "18-28s")

# Aliases of entries that no rule gives; part of the alias table that is used by default.
SPELLINGS = {
    "mtgenome": ("mtgenome", "mt genome", "mito genome", "mitogenome", "mitogenom", "mitochondrial genome", "mtdna genome", "mitochondrion complete genome", "mitochondrial dna complete genome", "mitochondrion partial genome"),
    "coi": ("coi 5p", "co1 5p"),
    "cob": ("cob", "cytb", "cyt b", "cytochrome b", "cytochrom b", "apocytochrome b"),
    "its1-its2": ("its", "its1", "its2", "its 1", "its 2", "its 1 2", "its1 its2", "its region", "its1 5 8s its2", "5 8s", "5 8s rrna", "internal transcribed spacer", "internal transcribed spacers", "int transcr spacer", "int transcr spacers"),
    "18-28s": ("18 28s", "18s 28s", "18s its 28s", "18s to 28s", "18s through 28s", "18s its1 5 8s its2 28s", "18s its1 its2 28s", "rrna operon", "rdna operon", "rrna cluster", "rdna cluster", "rrna array", "rdna array", "rrna gene cluster", "ribosomal rna gene cluster", "ribosomal cluster", "ribosomal operon"),
    "ef-1": ("ef 1", "ef1", "ef1a", "ef 1a", "ef1α", "ef 1α", "ef1 alpha", "ef 1 alpha", "ef1alpha", "elongation factor 1", "elong factor 1", "elongation factor 1 alpha", "elongation factor 1a", "elongation factor 1alpha"),
    "h3": ("h3", "h 3", "his3", "hist h3", "hist 3", "histone h3", "histone 3", "histone three"),
}
# Names of other genes that look like spellings above.
OTHERS = ("cytochrome c", "cytochrome p450", "cyt p450", "elongation factor 2", "ef 2", "ef2", "histone h2a", "histone h2b", "histone h4", "rna pol ii")


@lru_cache(maxsize=1)
def aliases() -> dict[str, str | None]:
    """The alias table: spelling -> the entry it names; None for names of other genes."""
    out: dict[str, str | None] = {s: None for s in OTHERS}
    out |= {s: entry for entry, all_of in SPELLINGS.items() for s in all_of}
    enzyme = ("cytochrome oxidase", "cytochrome c oxidase", "cytochrome oxydase", "cytochrome c oxydase", "cyt oxidase", "cyt c oxidase", "cyt ox", "cyt c ox")
    for entry, numerals in (("coi", ("1", "i", "one")), ("cox2", ("2", "ii", "two")), ("cox3", ("3", "iii", "three"))):
        for n in numerals:
            out |= {f"{e} {part}{n}": entry for e in enzyme for part in ("", "subunit ", "sub ")}
            out |= {f"subunit {n} of {e}": entry for e in enzyme}
        for n in numerals[:2]:
            out |= {f"{stem}{gap}{n}": entry for stem in ("co", "cox") for gap in ("", " ")}
    kinds = (("16", "16s", ("mt",), "mt large"), ("12", "12s", ("mt",), "mt small"), ("18", "18s", ("nuclear", "nssu", "ssu"), "nuclear small"), ("28", "28s", ("nuclear", "nlsu", "lsu"), "nuclear large"))
    for n, entry, before, size in kinds:
        core = (f"{n}s", f"{n} s")
        out |= {f"{c}{after}": entry for c in core for after in ("", " rrna", " rdna", " ribosomal", " ribosomal rna")}
        out |= {s: entry for s in (f"{n}sr rna", f"{n}srrna", f"{n}srdna", f"{size} ribosomal subunit")}
        out |= {f"{b} {c}": entry for b in before for c in core}
    return out | {"rrn16": "16s", "rrnl": "16s", "rrn12": "12s", "rrns": "12s"}


_NUMERALS = ("i", "ii", "iii", "iv", "v", "vi")


def variants(name: str) -> set[str]:
    """What a name of the list is also written like: without what follows a comma, its last numeral in the other script."""
    out = {normal(name), normal(name.partition(",")[0])}
    for text in tuple(out):
        head, _, last = text.rpartition(" ")
        if head and last in _NUMERALS:
            out.add(f"{head} {_NUMERALS.index(last) + 1}")
        elif head and last.isdigit() and 1 <= int(last) <= len(_NUMERALS):
            out.add(f"{head} {_NUMERALS[int(last) - 1]}")
        if m := re.fullmatch(r"([^\W\d]+) ?(\d+[^\W\d]?)", text):  # a short name with its number apart or not
            out |= {m[1] + m[2], f"{m[1]} {m[2]}"}
    return out - {""}


def spellings(entries: list[tuple[str, str | None]], table: dict[str, str | None] | None = None) -> dict[str, tuple[str, ...]]:
    """Every spelling with the entries it names, from (marker, full name) rows and an alias table.

    Aliases of entries that the list lacks, and names of other genes, name none: they only keep others from being found
    in them. A spelling that several entries share names all of them.
    """
    listed = dict.fromkeys(m for m, _ in entries)
    out: dict[str, set[str]] = {normal(s): {m} & set(listed) for s, m in (aliases() if table is None else table).items()}
    for marker, full in entries:
        for s in variants(marker) | variants(full or ""):
            out[s] = out.get(s, set()) | {marker}
    out.pop("", None)
    return {s: tuple(sorted(found)) for s, found in out.items()}


def within(spelling: str) -> int:
    """Errors allowed in a spelling of this length."""
    letters = sum(map(str.isalpha, spelling))
    return 0 if letters < 6 else 1 + letters // 24


class Node:
    """A node of the trie: its edges, keyed by character and whether that must be exact, and the spelling that ends here."""

    __slots__ = ("edges", "end", "most")

    def __init__(self):
        self.edges: dict[tuple[str, bool], Node] = {}
        self.end: tuple[str, tuple[str, ...], int] | None = None
        self.most = 0  # errors that any spelling from here on allows


class Trie:
    """Spellings as a trie; ``search`` walks it with errors."""

    def __init__(self, entries: dict[str, tuple[str, ...]]):
        self.root = Node()
        for spelling, found in entries.items():
            node, most = self.root, within(spelling)
            firm = [len(w) <= 2 or not w.isalpha() for w in spelling.split(" ") for _ in w + " "]
            node.most = max(node.most, most)
            for ch, fixed in zip(spelling, firm):
                node = node.edges.setdefault((ch, fixed or ch == " "), Node())
                node.most = max(node.most, most)
            node.end = (spelling, found, most)

    def near(self, text: str, start: int) -> list[tuple[int, int, int, tuple[str, ...]]]:
        """(start, end, errors, entries) of all spellings at ``start`` within their distance.

        Errors are substituted, missing, added and swapped characters.
        """
        best: dict[tuple[int, str], tuple[int, tuple[str, ...]]] = {}
        n, seen, states = len(text), set(), [(self.root, start, 0)]
        while states:
            state = states.pop()
            node, i, e = state
            if e > node.most or state in seen:
                continue
            seen.add(state)
            if node.end and (i == n or text[i] == " "):
                spelling, found, most = node.end
                if e <= most and e < best.get((i, spelling), (9, ()))[0]:
                    best[i, spelling] = e, found
            here = text[i] if i < n else ""
            for fixed in (False, True):
                if child := node.edges.get((here, fixed)):
                    states.append((child, i + 1, e))
            if e >= node.most:
                continue
            letter = here.isalpha()
            following = text[i + 1] if i + 1 < n else ""
            for (ch, fixed), child in node.edges.items():
                if fixed or e >= child.most:
                    continue
                states.append((child, i, e + 1))  # missing
                if ch != here:
                    if letter:
                        states.append((child, i + 1, e + 1))  # substituted
                    if following == ch and (grandchild := child.edges.get((here, False))):
                        states.append((grandchild, i + 2, e + 1))  # swapped
            if letter and i > start and text[i - 1] != " ":
                states.append((node, i + 1, e + 1))  # added
        return [(start, i, e, found) for (i, _), (e, found) in best.items()]

    def search(self, text: str) -> list[str]:
        """Entries that the normalised ``text`` denotes: of all hits within their distance, those that hold."""
        starts = [0] + [m.end() for m in re.finditer(" ", text)]
        hits = sorted((h for s in starts for h in self.near(text, s)), key=lambda h: (-(h[1] - h[0] - 4 * h[2]), h[2], h[0], h[3]))
        taken: list[tuple[int, int]] = []
        found: dict[str, None] = {}
        for s, end, _, entries in hits:
            if all(end <= a or s >= b for a, b in taken):
                taken.append((s, end))
                found |= dict.fromkeys(entries)
        return [f for f in found if f in WHOLE] or list(found)


def normal(text: str) -> str:
    """Lower case words and numbers, one blank between."""
    return re.sub(r"[^\w]+|_", " ", text.lower()).strip()


def denoted(trie: Trie, text: str) -> tuple[str, ...]:
    """Entries that a text as typed denotes."""
    return tuple(trie.search(normal(text)))


def in_cell(look, cell: str) -> tuple[str, ...]:
    """Entries that the values of a packed cell denote by ``look``, and ``unmatched`` if any denotes none."""
    return tuple(dict.fromkeys(entry for value, *_ in atoms(cell)[0] for entry in look(value) or ("unmatched",)))


def without_codes(definition: Column, organism: Column) -> Column:
    """The definition without its organism and its specimen and isolate codes, which denote nothing."""
    plain, whole = F.lower(narrow(definition)), F.lower(organism)
    bare = F.regexp_replace(whole, r" (?:cf|aff|nr)\.? ", " ")
    after = lambda name: F.substring(plain, F.length(name) + 1, F.length(plain))
    named = F.when(plain.startswith(whole) & (whole != ""), after(whole)).when(plain.startswith(bare) & (bare != ""), after(bare)).otherwise(plain)
    return F.trim(F.regexp_replace(named, r"\b(?:voucher|isolate|specimen|strain|clone|haplotype)\b[ :=#]*(?:[a-z]+[ :#-]+(?=[a-z]*[ :#-]*\d))*[^\s,;]*\d[^\s,;]*", " "))


def map_markers(final: DataFrame, assigned: DataFrame, marker_list: DataFrame, table: dict[str, str | None] | None = None, most: int = 100_000) -> DataFrame:
    """(row_id, field_name, marker): each entry of the list that a definition or a gene_type cell denotes, or ``unmatched``.

    ``marker_list`` has (marker, full_name) and at most ``most`` rows, more are refused; rows without a marker are left
    out. ``table`` (spelling -> marker) are the aliases, by default those of ``aliases``. A null cell gives no row; a blank
    definition gives ``unmatched``, a blank gene_type, which holds no value, no row. A text naming a whole genome or
    cluster gives that only. Of hits that explain equally much, the one with fewer errors, then the first in the text
    holds. Very long texts are searched whole. Repeated rows each give theirs. Empty tables: empty result; an empty list
    leaves all texts unmatched. Extra columns are not read.
    """
    listed = fixed_rows(marker_list.where("marker is not null").select("marker", "full_name").distinct(), "markers", most)
    shared = final.sparkSession.sparkContext.broadcast(spellings(sorted((r.marker, r.full_name or "") for r in listed), table))

    def match(frames):
        trie = Trie(shared.value)
        look = lru_cache(maxsize=200_000)(lambda text: denoted(trie, text))
        cells = lru_cache(maxsize=50_000)(lambda cell: in_cell(look, cell))
        for f in frames:
            out = []
            for row, field, text in zip(f["row_id"], f["field_name"], f["text"]):
                out += [(row, field, m) for m in (cells(text) if field == "gene_type" else look(text) or ("unmatched",))]
            if out:
                yield pd.DataFrame(out, columns=["row_id", "field_name", "marker"])

    d = final.where("definition is not null").select("row_id", F.lit("definition").alias("field_name"), without_codes(F.col("definition"), F.coalesce("organism", F.lit(""))).alias("text"))
    g = assigned.where("gene_type is not null").select("row_id", F.lit("gene_type").alias("field_name"), F.col("gene_type").alias("text"))
    return d.unionAll(g).mapInPandas(match, "row_id bigint, field_name string, marker string")
