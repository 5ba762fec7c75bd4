"""Several values packed in one field: one row per value, its position kept.

A cell is a lattice whose atoms lie between possible delimiters; a quoted span is one atom, whatever it contains. A
segmentation is as likely as its values are frequent in the whole column and as its delimiters are used to delimit.
Both are learned by expectation-maximisation over all distinct cells; Viterbi then takes the likeliest segmentation.
"""

from __future__ import annotations

import math
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specimatrix.session import cut, hot_keys, spread_join, width

# What may stand between two values.
DELIMITERS = ("::", ",", ";", "/", "|", "+", "&", "\t", "\n", "\r")

_DELIM = "|".join(re.escape(d) for d in DELIMITERS)
_CHARS = re.escape("".join(d for d in DELIMITERS if len(d) == 1))
_BLANK = "[  　]*"
TOKEN = re.compile(rf"""{_BLANK}(?:"(?P<q>(?:[^"]|"")*)"|'(?P<s>(?:[^']|'')*)'){_BLANK}(?={_DELIM}|$)|(?P<d>{_DELIM})|(?P<t>(?:(?!::)[^{_CHARS}])+|:)""", re.S)

#: Values of up to this many atoms are candidates wherever they stand; longer ones where their text occurs elsewhere too.
SPAN = 6
ITERATIONS = 2
#: How likely a delimiter delimits before anything is learned.
UNTOLD = 0.9
_CHAR, _END = math.log(1 / 48), math.log(0.1)


def atoms(cell: str) -> tuple[list[tuple[str, int, int, bool]], list[tuple[str, int]]]:
    """The non-empty atoms (value, start, end, quoted) of a cell and its delimiters (text, atoms before it)."""
    found, between, start, quoted, value, end = [], [], None, False, "", 0

    def close():
        nonlocal start, quoted, value
        if start is not None and (v := value if quoted else cell[start:end].strip()) and v.strip():
            found.append((v.strip(), start, end, quoted))
        start, quoted, value = None, False, ""

    for m in TOKEN.finditer(cell):
        if m["d"]:
            close()
            between.append((m["d"], len(found)))
        else:
            if start is None:
                start = m.start()
                if m["q"] is not None or m["s"] is not None:
                    quoted, value = True, m["q"].replace('""', '"') if m["q"] is not None else m["s"].replace("''", "'")
            else:
                quoted = False
            end = m.end()
    close()
    return found, between


def text_of(cell: str, found: list[tuple[str, int, int, bool]], i: int, j: int) -> str:
    """The value from atom ``i`` to atom ``j`` as written."""
    return found[i][0] if i == j else cell[found[i][1] : found[j][2]].strip()


def lattice(cell: str, longer: list[tuple[int, int]] = ()) -> tuple[list[tuple[str, int, int, bool]], list[list[str]], list[tuple[int, int, str]]]:
    """Atoms, the delimiters in each gap between neighbours, and the candidate spans (first, last, text), sorted."""
    found, between = atoms(cell)
    gaps: list[list[str]] = [[] for _ in range(max(0, len(found) - 1))]
    for d, k in between:
        if 0 < k < len(found):
            gaps[k - 1].append(d)
    spans = [(i, j, cell[found[i][1] : found[j][2]].strip()) for i, j in longer]
    for i, a in enumerate(found):
        spans.append((i, i, a[0]))
        if a[3]:
            continue
        for j in range(i + 1, min(len(found), i + SPAN)):
            if found[j][3]:
                break
            spans.append((i, j, cell[a[1] : found[j][2]].strip()))
    return found, gaps, sorted(spans) if longer else spans


def base(text: str, delims: int) -> float:
    """Log-probability of a value that was never seen: by its length; a delimiter inside is unlikely."""
    return _END + _CHAR * len(text) + delims * math.log(0.01)


def scores(n: int, gaps: list[list[str]], spans: list[tuple[int, int, str]], seen: list[float], total: float, fresh: float, splits: dict[str, float]) -> list[float]:
    """Log-weight of each span; ``seen`` has how often its text occurs in other cells, ``fresh`` the share of new values."""
    cutting = [max((splits.get(d, UNTOLD) for d in g), default=UNTOLD) for g in gaps]
    on = [math.log(p) for p in cutting]
    off = [math.log(1 - p) for p in cutting]
    out = []
    for (i, j, text), c in zip(spans, seen):
        w = math.log(fresh) + base(text, j - i)
        if c > 0:
            w = _plus(w, math.log((1 - fresh) * c / total))
        out.append(w + sum(off[i:j]) + (on[j] if j < n - 1 else 0.0))
    return out


def posteriors(n: int, spans: list[tuple[int, int, str]], w: list[float]) -> list[float]:
    """Probability that each span is a value (forward-backward)."""
    if n == 1:
        return [1.0]
    ahead, back = [0.0] + [-math.inf] * n, [-math.inf] * n + [0.0]
    for (i, j, _), x in zip(spans, w):  # sorted by i
        ahead[j + 1] = _plus(ahead[j + 1], ahead[i] + x)
    for (i, j, _), x in zip(reversed(spans), reversed(w)):
        back[i] = _plus(back[i], x + back[j + 1])
    return [math.exp(min(0.0, ahead[i] + x + back[j + 1] - ahead[n])) for (i, j, _), x in zip(spans, w)]


def _plus(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


def viterbi(n: int, spans: list[tuple[int, int, str]], w: list[float]) -> list[int]:
    """Indices of the spans of the likeliest segmentation; of equal ones, the one with more values."""
    best: list[tuple[float, int, int]] = [(0.0, 0, -1)] + [(-math.inf, 0, -1)] * n
    for k, ((i, j, _), x) in enumerate(zip(spans, w)):
        if (new := (best[i][0] + x, best[i][1] + 1, k))[:2] > best[j + 1][:2]:
            best[j + 1] = new
    path, at = [], n
    while at:
        k = best[at][2]
        path.append(k)
        at = spans[k][0]
    return path[::-1]


_SPANS = "field_name string, cell string, i int, j int, key bigint, mine double"


def _key(field: str, text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(f"{field}\0{text.lower()}") - (1 << 63)


def runs(cell: str) -> list[tuple[str, list[tuple[str, int, int, bool]], int]]:
    """Neighbouring unquoted atoms of a cell, and those within its quoted spans: (text, atoms, index of the first or -1)."""
    found, out, start = atoms(cell)[0], [], 0
    for k in range(len(found) + 1):
        if k == len(found) or found[k][3]:
            if k > start:
                out.append((cell, found[start:k], start))
            if k < len(found):
                inner = [a for a in atoms(found[k][0])[0] if not a[3]]
                out.append((found[k][0], inner, -1))
            start = k + 1
    return out


_GRAMS = "field_name string, cell string, i int, j int, key bigint, whole boolean"


def _grams(size: int, most: int):
    """Spans of more than ``size`` atoms, up to ``most``, whose first and last ``size`` atoms are known to recur.

    With ``most`` = ``size``, all spans of that length. Spans within quotes have no place (-1): they only vouch for others.
    """
    first_turn = size == most

    def step(batches):
        for b in batches:
            fields, cells = b.column("field_name").to_pylist(), b.column("cell").to_pylist()
            known = [()] * len(cells) if first_turn else b.column("known").to_pylist()
            rows: list[tuple] = []
            for field, cell, keys in zip(fields, cells, known):
                keys = set(keys)
                for text, part, first in runs(cell):
                    starts = range(len(part) - size + 1)
                    recurs = [first_turn or _key(field, text_of(text, part, i, i + size - 1)) in keys for i in starts]
                    for i in starts:
                        lasts = (i + size - 1,) if first_turn else range(i + size, min(len(part), i + most)) if recurs[i] else ()
                        for j in lasts:
                            if recurs[j - size + 1]:
                                place = (first + i, first + j) if first >= 0 else (-1, -1)
                                rows.append((field, cell, *place, _key(field, text_of(text, part, i, j)), j - i + 1 == most))
            names = ("field_name", "cell", "i", "j", "key", "whole")
            types = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.bool_())
            columns = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=list(names))

    return step


def longer_spans(cells: DataFrame) -> DataFrame | None:
    """(field_name, cell, longer) with the spans (i, j) of more than ``SPAN`` atoms whose text recurs; None if there is none.

    A text can only recur if its beginning and its end do. So lengths are doubled from ``SPAN`` on, each turn looks only
    where both recur, and it ends when nothing does: no length is ruled out.
    """
    delims = F.length(F.regexp_replace(F.replace("cell", F.lit("::"), F.lit("|")), f"[^{_CHARS}]", ""))
    size, found = SPAN, None
    grams = cut(cells.where(delims >= SPAN).select("field_name", "cell").mapInArrow(_grams(SPAN, SPAN), _GRAMS))
    while not grams.isEmpty():
        known = grams.groupBy("field_name", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("field_name", "key")
        kept = cut(grams.join(known, ["field_name", "key"], "left_semi"))
        if size > SPAN:
            here = kept.where("i >= 0").select("field_name", "cell", F.struct("i", "j").alias("span"))
            found = here if found is None else found.unionAll(here)
        have = kept.where("whole").groupBy("field_name", "cell").agg(F.collect_set("key").alias("known"))
        grams = cut(have.mapInArrow(_grams(size, 2 * size), _GRAMS))
        size *= 2
    return None if found is None else found.groupBy("field_name", "cell").agg(F.collect_set("span").alias("longer"))


def _first(batches):
    """Spans of each distinct cell with their probability before anything is learned."""
    for b in batches:
        fields, cells = b.column("field_name").to_pylist(), b.column("cell").to_pylist()
        longer = b.column("longer").to_pylist() if "longer" in b.schema.names else [None] * len(cells)
        out: dict[str, list] = {"field_name": [], "cell": [], "i": [], "j": [], "key": [], "mine": []}
        for field, cell, more in zip(fields, cells, longer):
            found, gaps, spans = lattice(cell, [(x["i"], x["j"]) for x in more or ()])
            if not found:
                continue
            p = posteriors(len(found), spans, scores(len(found), gaps, spans, [0.0] * len(spans), 1.0, 0.5, {}))
            for s, x in zip(spans, p):
                out["field_name"].append(field)
                out["cell"].append(cell if len(found) > 1 else None)
                out["i"].append(s[0])
                out["j"].append(s[1])
                out["key"].append(_key(field, s[2]))
                out["mine"].append(x)
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("field_name", pa.string()), ("cell", pa.string()), ("i", pa.int32()), ("j", pa.int32()), ("key", pa.int64()), ("mine", pa.float64())]))


def _rounds(totals: dict[str, tuple[float, float]], splits: dict[str, dict[str, float]], last: bool):
    def step(frames):
        for f in frames:
            rows: list[tuple] = []
            for field, cell, known in zip(f["field_name"], f["cell"], f["spans"]):
                found, gaps, _ = lattice(cell)
                known = sorted((x["i"], x["j"], x["seen"], x["mine"]) for x in known)
                spans = [(i, j, text_of(cell, found, i, j)) for i, j, _, _ in known]
                others = [max(0.0, seen - mine) for _, _, seen, mine in known]
                w = scores(len(found), gaps, spans, others, *totals[field], splits.get(field, {}))
                if last:
                    items = [spans[k][2] for k in viterbi(len(found), spans, w)]
                    if len(items) > 1:
                        rows.append((field, cell, items))
                else:
                    p = posteriors(len(found), spans, w)
                    cuts: dict[str, list[float]] = {}
                    for g, gap in enumerate(gaps):
                        kept = sum(x for (i, j, _), x in zip(spans, p) if i <= g < j)
                        for d in gap[:1]:
                            c = cuts.setdefault(d, [0.0, 0.0])
                            c[0] += 1 - kept
                            c[1] += 1
                    rows += [(field, cell, i, j, _key(field, t), x, None, None, None) for (i, j, t), x in zip(spans, p)]
                    rows += [(field, None, None, None, None, None, d, a, b) for d, (a, b) in cuts.items()]
            if rows:
                yield pd.DataFrame(rows, columns=["field_name", "cell", "items"] if last else ["field_name", "cell", "i", "j", "key", "mine", "delim", "cuts", "of"])

    return step


def split_values(cells: DataFrame, iterations: int = ITERATIONS) -> DataFrame:
    """(row_id, field_name, cell) -> (row_id, field_name, pos, item) for every cell that holds at least two values.

    ``pos`` counts the non-empty values from 1; ``item`` is the value trimmed, without enclosing quotes and with doubled
    quotes single. Null, blank and single-valued cells give no rows; values repeated within a cell and repeated rows all
    come out. Of equally likely segmentations the one with more values holds. A value of any number of atoms is found:
    up to ``SPAN`` atoms anywhere, longer ones if the column has them elsewhere too, as nothing else speaks for them. Very
    long texts give a lattice in proportion to their length. Other columns are not used. Empty table: empty result.
    """
    spark = cells.sparkSession
    n = width(spark)
    cells = cells.select("row_id", "field_name", "cell")
    packed = F.col("cell").rlike(f"[{_CHARS}]|::")
    counted = cut(cells.where(F.trim("cell") != "").groupBy("field_name", "cell").agg(F.count(F.lit(1)).alias("n")))
    distinct = counted.select("field_name", "cell")
    if (longer := longer_spans(distinct)) is not None:
        distinct = distinct.join(longer, ["field_name", "cell"], "left")
    spans = cut(distinct.repartition(n).mapInArrow(_first, _SPANS))
    alone = cut(spans.where("cell is null").groupBy("field_name", "key").agg(F.sum("mine").alias("mine")))
    spans = spans.where("cell is not null")
    splits: dict[str, dict[str, float]] = {}
    for turn in range(iterations + 1):
        both = spans.select("field_name", "key", "mine", F.lit(1).alias("in")).unionAll(alone.select("field_name", "key", "mine", F.lit(0)))
        counts = cut(both.groupBy("field_name", "key").agg(F.sum("mine").alias("seen"), F.sum("in").alias("n")))
        once = F.sum(F.when(F.col("seen") < 1.5, F.col("seen")).otherwise(0.0))
        sums = counts.groupBy("field_name").agg(F.sum("seen"), once, F.sum("n")).collect()  # a row for each field
        totals = {r[0]: (r[1], (r[2] + 1) / (r[1] + 2)) for r in sums}
        hot = hot_keys(counts, ["field_name", "key"], sum(r[3] for r in sums))
        known = spread_join(spans, counts.where("n > 0").drop("n"), ["field_name", "key"], hot, F.xxhash64("cell", "i", "j"))
        whole = known.repartition(n, "field_name", "cell").groupBy("field_name", "cell").agg(F.collect_list(F.struct("i", "j", "seen", "mine")).alias("spans"))
        if turn == iterations:
            done = whole.mapInPandas(_rounds(totals, splits, True), "field_name string, cell string, items array<string>")
            hot = hot_keys(counted, ["field_name", "cell"], counted.agg(F.sum("n")).first()[0] or 0)
            rows = spread_join(cells.where(packed), done, ["field_name", "cell"], hot, F.xxhash64("row_id"))
            return rows.select("row_id", "field_name", F.posexplode("items").alias("pos", "item")).select("row_id", "field_name", (F.col("pos") + 1).cast("int").alias("pos"), "item")
        both = cut(whole.mapInPandas(_rounds(totals, splits, False), _SPANS + ", delim string, cuts double, of double"))
        splits = {}
        for r in both.where("delim is not null").groupBy("field_name", "delim").agg(F.sum("cuts").alias("cuts"), F.sum("of").alias("of")).collect():  # a row for each delimiter
            splits.setdefault(r[0], {})[r[1]] = min(1 - 1e-9, (r.cuts + 0.99) / (r.of + 1))
        spans = both.where("cell is not null").select("field_name", "cell", "i", "j", "key", "mine")


def packed_cells(assigned: DataFrame, final: DataFrame) -> DataFrame:
    """The two columns of this data that hold packed cells, as (row_id, field_name, cell)."""
    a = assigned.select("row_id", F.lit("gene_type").alias("field_name"), F.col("gene_type").alias("cell"))
    return a.unionAll(final.select("row_id", F.lit("pcr_primers").alias("field_name"), F.col("pcr_primers").alias("cell")))
