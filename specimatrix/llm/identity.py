"""Records that differ only in formatting, by Merkle-style hashing of their identifier fields.

Leaves are a field's letters and digit runs: white space, punctuation and case are gone, and since spaces may be missing
between pieces, the pieces themselves are no safe leaves. The children of a field are sorted by digest, the fields
likewise, so order does not matter. What shares a root digest is then confirmed by comparing the full structures.
"""

from __future__ import annotations

from collections import Counter
from itertools import permutations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specimatrix.functions.text import narrow, placeholder
from specimatrix.session import cut, hot_keys, spread_join, width


def tokens(field: Column) -> Column:
    """The pieces of a field as written, lower case, dotted initials joined; null if the field says nothing."""
    plain = F.lower(narrow(field))
    joined = F.regexp_replace(plain, r"(?<![\p{L}\p{N}])(\p{L})\.(?=\p{L}(?![\p{L}\p{N}]))", "$1")
    found = F.regexp_extract_all(joined, F.lit(r"(\p{N}+\p{L}*|\p{L}+)"), 1)
    return F.when(~placeholder(field) & (F.size(found) > 0), found)


def field_digest(pieces: Column) -> Column:
    """Digest of a field: of its sorted leaf digests; a fixed one for a missing field."""
    text = F.array_join(pieces, " ")
    letters = F.array_join(F.array_sort(F.split(F.regexp_replace(text, r"[^\p{L}]+", ""), "")), "")
    runs = F.transform(F.regexp_extract_all(text, F.lit(r"(\p{N}+)"), 1), lambda r: F.xxhash64(r))
    return F.when(pieces.isNotNull(), F.xxhash64(F.array_sort(F.array_append(runs, F.xxhash64(letters))))).otherwise(F.lit(0).cast("bigint"))


def glued(pieces: list[str], form: list[str]) -> bool:
    """True if each token of ``form`` is made of whole ``pieces``, in any order, and all are used."""
    failed: set = set()

    def fill(at: int, offset: int, free: Counter) -> bool:
        if at == len(form):
            return not free
        if offset == len(form[at]):
            return fill(at + 1, 0, free)
        state = (at, offset, frozenset(free.items()))
        if state in failed:
            return False
        for p in list(free):
            if form[at].startswith(p, offset) and fill(at, offset + len(p), free - Counter([p])):
                return True
        failed.add(state)
        return False

    return sum(map(len, pieces)) == sum(map(len, form)) and fill(0, 0, Counter(pieces))


def same_structure(a: list[list[str]], b: list[list[str]]) -> bool:
    """True if the pieces of one record's fields make up the tokens of the other's, field by field in any order."""
    return any(all(glued(x, y) or glued(y, x) for x, y in zip(a, order)) for order in permutations(b))


def classes(forms: list[tuple[str, str]]) -> list[int]:
    """The class of each (form, run) of one digest; forms are the sorted pieces, runs the pieces in order without spaces.

    Two are the same if they are equal in either, or if one's pieces make up the other's tokens; and what is the same as
    a third is the same. So the classes do not depend on the order in which forms are looked at.
    """
    group = list(range(len(forms)))

    def root(i: int) -> int:
        while group[i] != i:
            group[i] = group[group[i]]
            i = group[i]
        return i

    first: dict = {}
    for i, (form, run) in enumerate(forms):
        for key in (("form", form), ("run", run)):
            group[root(i)] = root(first.setdefault(key, i))
    leads: dict[str, int] = {}
    for i, (form, _) in enumerate(forms):
        leads.setdefault(form, i)
    parsed = [([f.split() for f in form.split("|")], i) for form, i in leads.items()]
    for k, (a, i) in enumerate(parsed):
        for b, j in parsed[:k]:
            if root(i) != root(j) and same_structure(a, b):
                group[root(i)] = root(j)
    return [root(i) for i in range(len(forms))]


def _confirm(frames):
    """Forms of one digest -> forms with the first row and the number of rows of their identity."""
    for f in frames:
        out = []
        for root, forms in zip(f["root"], f["forms"]):
            members: dict[int, list] = {}
            for c, x in zip(classes([(x["form"], x["run"]) for x in forms]), forms):
                members.setdefault(c, []).append(x)
            for group in members.values():
                first, n = min(x["first"] for x in group), sum(x["n"] for x in group)
                out += [(root, x["form"], x["run"], first, n) for x in group]
        if out:
            yield pd.DataFrame(out, columns=["root", "form", "run", "first_row_id", "n_rows"])


def identities(df: DataFrame, row_id: str = "row_id", fields: tuple[str, ...] = ("specimen_voucher", "isolate")) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows (row_id, root, form, run), how often each form occurs, and the forms with first_row_id and n_rows of their
    identities. Forms of one digest are its ways to write the same letters and numbers: their number does not grow with
    the copies."""
    names = [f"_f{i}" for i in range(len(fields))]
    rows = df.select(F.col(row_id).alias("row_id"), *[tokens(F.col(f)).alias(n) for f, n in zip(fields, names)]).where(F.coalesce(*names).isNotNull())
    sorted_text = lambda c: F.coalesce(F.array_join(F.array_sort(c), " "), F.lit(""))
    run_text = lambda c: F.coalesce(F.array_join(c, ""), F.lit(""))
    over = lambda f: F.array_sort(F.array(*[f(F.col(n)) for n in names]))
    rows = cut(rows.select("row_id", F.xxhash64(over(field_digest)).alias("root"), F.array_join(over(sorted_text), "|").alias("form"), F.array_join(over(run_text), "|").alias("run")))
    counted = rows.groupBy("root", "form", "run").agg(F.min("row_id").alias("first"), F.count(F.lit(1)).alias("n"))
    by_root = cut(counted.groupBy("root").agg(F.collect_list(F.struct("form", "run", "first", "n")).alias("forms")))
    plain = by_root.where(F.size("forms") == 1).select("root", F.inline("forms").alias("form", "run", "first_row_id", "n_rows"))
    mixed = by_root.where(F.size("forms") > 1).repartition(width(df.sparkSession), "root").mapInPandas(_confirm, "root bigint, form string, run string, first_row_id bigint, n_rows bigint")
    return rows, by_root.select("root", F.inline("forms").alias("form", "run", "first", "n")), plain.unionByName(mixed)


def copies(df: DataFrame, row_id: str = "row_id", fields: tuple[str, ...] = ("specimen_voucher", "isolate")) -> DataFrame:
    """(first_row_id, copy_row_id) for each further row of an identity with at least two rows.

    A row with all fields null, blank or placeholders has no identity; one missing field is part of an identity. Spaces
    may be missing or added between letters and between letters and digits, not within a number. All copies come out,
    however many; the first is the smallest row id. Very long texts are compared whole. Extra columns are not read.
    Empty table: empty result.
    """
    rows, counted, forms = identities(df, row_id, fields)
    keys = ["root", "form", "run"]
    shared = forms.where("n_rows > 1").select(*keys, "first_row_id")
    hot = hot_keys(counted, keys, rows.count())
    return spread_join(rows, shared, keys, hot, F.xxhash64("row_id")).where("row_id > first_row_id").select("first_row_id", F.col("row_id").alias("copy_row_id"))


def collapsed(df: DataFrame, row_id: str = "row_id", fields: tuple[str, ...] = ("specimen_voucher", "isolate")) -> DataFrame:
    """(first_row_id, n_rows): one row per identity with the number of its records."""
    return identities(df, row_id, fields)[2].groupBy("first_row_id").agg(F.max("n_rows").alias("n_rows"))
