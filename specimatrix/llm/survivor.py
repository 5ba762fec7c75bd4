"""One surviving record per specimen, built from whole bundles of dependent fields.

The fields of a bundle (latitude, longitude and their unit; country, region and place) are taken from one row together,
never mixed. Bundles claim attributes that others claim too (a place and a country column both tell the country); what is
chosen must not contradict itself in any of them. Rows of equal claims are reduced to the most trusted one for each bundle
before and in the shuffle, so no group of records is ever gathered, only its different claims. Where the most trusted rows
contradict each other, branch-and-bound searches the choice of highest trust.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specimatrix.functions.text import alnum, placeholder, squeeze


@dataclass(frozen=True)
class Bundle:
    """Fields that only make sense together.

    ``usable`` tells which rows may supply the bundle; ``trust`` is compared in order, larger first, nulls last, then the
    smallest row id; ``score`` is what the bundle adds to the total of its ``level``; ``claims`` are the values of the
    attributes that the bundle determines, null where it says nothing; ``values`` are carried to the result.
    """

    name: str
    usable: Column
    trust: tuple[Column, ...]
    score: Column = field(default_factory=lambda: F.lit(1.0))
    claims: dict[str, Column] = field(default_factory=dict)
    values: dict[str, Column] = field(default_factory=dict)
    level: int = 0


def search(scores: list[list[float]], claims: list[list[list[str | None]]], levels: list[int]) -> list[int]:
    """The chosen candidate of each bundle (-1 for none), by branch-and-bound.

    Candidates of a bundle are sorted by trust, the best first; ``claims`` has a candidate's value for each attribute. The
    best choice has the largest total of scores in the first level, then the most trusted candidates there, then the
    largest total in the next level, and so on; chosen candidates agree in every attribute that they claim. A node's bound
    takes the best of every bundle that is still open; a node that can not beat the best choice so far is not entered.
    """
    order = sorted(range(len(scores)), key=lambda b: levels[b])
    steps = sorted(set(levels))
    most = [max([0.0, *s]) for s in scores]
    best: list = [None, [-1] * len(scores)]

    def worth(chosen: dict[int, int]) -> tuple:
        """What a choice is worth; of the open bundles the best that could be."""
        out: list = []
        for level in steps:
            mine = [b for b in order if levels[b] == level]
            total = sum(most[b] if b not in chosen else scores[b][chosen[b]] if chosen[b] >= 0 else 0.0 for b in mine)
            out += [round(total, 9), *[0 if b not in chosen else -chosen[b] if chosen[b] >= 0 else -len(scores[b]) for b in mine]]
        return tuple(out)

    def enter(depth: int, chosen: dict[int, int], held: tuple) -> None:
        if best[0] is not None and worth(chosen) <= best[0]:
            return
        if depth == len(order):
            best[:] = [worth(chosen), [chosen[b] for b in range(len(scores))]]
            return
        b, tried = order[depth], set()
        for k, own in enumerate(claims[b]):
            if (key := (tuple(own), scores[b][k])) in tried or any(x is not None and y is not None and x != y for x, y in zip(own, held)):
                continue
            tried.add(key)
            enter(depth + 1, chosen | {b: k}, tuple(y if x is None else x for x, y in zip(own, held)))
        enter(depth + 1, chosen | {b: -1}, held)

    if scores:
        enter(0, {}, (None,) * max([len(c) for cs in claims for c in cs] or [0]))
    return best[1]


def choose_bundles(df: DataFrame, key: Column, row_id: str, bundles: list[Bundle], least: int = 2) -> DataFrame:
    """(group_row_id, n_rows, <bundle>_row_id ..., values ...) for each group of at least ``least`` rows.

    A bundle that no row can supply, or none without contradicting better ones, gets null. Rows with a null or empty key
    belong to no group. Ties in trust go to the smallest row id. Repeated rows count as rows. The input's other columns
    are not read, so extra or clashing names do no harm. Empty table: empty result.
    """
    attributes = sorted({a for b in bundles for a in b.claims})
    told_by = {(b.name, a): f"c{i}" for i, (b, a) in enumerate((b, a) for b in bundles for a in attributes if a in b.claims)}
    text = lambda b: F.struct(*[v.alias(n) for n, v in b.values.items()] or [F.lit(0).alias("_")])
    offer = {b.name: F.when(b.usable, F.struct(*[t.alias(f"t{i}") for i, t in enumerate(b.trust)], (-F.col(row_id)).alias("minus"), b.score.cast("double").alias("score"), text(b).alias("values"))) for b in bundles}
    same = [F.when(b.usable, b.claims[a].cast("string")).alias(told_by[b.name, a]) for b in bundles for a in attributes if a in b.claims]
    rows = df.select(key.alias("_key"), F.col(row_id).alias("_row"), *same, *[c.alias(f"b_{n}") for n, c in offer.items()]).where(F.col("_key") != "")
    top = [F.max(f"b_{b.name}").alias(f"b_{b.name}") for b in bundles]
    told = rows.groupBy("_key", *told_by.values()).agg(F.min("_row").alias("_row"), F.count(F.lit(1)).alias("_n"), *top)

    def claiming(b: Bundle) -> Column:
        """The bundle with its claims, which rows of one group have in common, after what trust compares."""
        claims = F.array(*[F.col(told_by[b.name, a]) if (b.name, a) in told_by else F.lit(None).cast("string") for a in attributes])
        own = F.col(f"b_{b.name}")
        parts = [own[f"t{i}"].alias(f"t{i}") for i in range(len(b.trust))] + [own["minus"].alias("minus"), own["score"].alias("score"), claims.alias("claims"), own["values"].alias("values")]
        return F.when(own.isNotNull(), F.struct(*parts))

    told = told.select("_key", "_row", "_n", *[claiming(b).alias(f"b_{b.name}") for b in bundles])
    lists = [F.sort_array(F.collect_list(f"b_{b.name}"), asc=False).alias(f"b_{b.name}") for b in bundles]
    groups = told.groupBy("_key").agg(F.min("_row").alias("group_row_id"), F.sum("_n").alias("n_rows"), *lists).where(F.col("n_rows") >= least)
    first = lambda b: F.get(F.col(f"b_{b.name}"), F.lit(0))
    torn = F.lit(False)
    for i in range(len(attributes)):
        values = F.array_compact(F.array(*[F.get(first(b)["claims"], F.lit(i)) for b in bundles if attributes[i] in b.claims]))
        torn = torn | (F.size(F.array_distinct(values)) > 1)
    levels = [b.level for b in bundles]

    @F.pandas_udf("array<int>")
    def pick(*columns: pd.Series) -> pd.Series:
        def one(cells) -> list[int] | None:
            if cells[0] is None:
                return None
            return search([list(s) for s in cells[::2]], [[list(c) for c in cs] for cs in cells[1::2]], levels)

        return pd.Series([one(cells) for cells in zip(*columns)], dtype=object)

    if attributes:
        groups = groups.withColumn("_torn", torn)
        open_of = lambda b, part: F.when(F.col("_torn"), F.transform(f"b_{b.name}", lambda x: x[part]))
        groups = groups.withColumn("_picked", pick(*[open_of(b, part) for b in bundles for part in ("score", "claims")]))
        chosen = {b.name: F.when(F.col("_picked").isNull(), first(b)).when(F.col("_picked")[i] >= 0, F.get(F.col(f"b_{b.name}"), F.col("_picked")[i])) for i, b in enumerate(bundles)}
    else:
        chosen = {b.name: first(b) for b in bundles}
    out = groups.select("group_row_id", "n_rows", *[c.alias(n) for n, c in chosen.items()])
    return out.select("group_row_id", "n_rows", *[(-F.col(f"{b.name}.minus")).cast("bigint").alias(f"{b.name}_row_id") for b in bundles], *[F.col(f"{b.name}.values.{v}").alias(v) for b in bundles for v in b.values])


_PART = r"([{h}])? *([+-]?[0-9]+(?:\.[0-9]+)?) *(?:°|º|DEG)? *(?:([0-9]+(?:\.[0-9]+)?)')? *(?:([0-9]+(?:\.[0-9]+)?)\")? *([{h}])?"
POSITION = "^" + _PART.format(h="NS") + r"(?: *[,;] *| +|(?<=[NS])|(?=[EW]))" + _PART.format(h="EW") + "$"


def position_parts(text: Column) -> Column:
    """Letter, degrees, minutes, seconds and letter of either side, '' for what is not written; null if it is no position."""
    plain = F.upper(squeeze(F.translate(text, "′’`″”“−", "'''\"\"\"-")))
    return F.split(F.when(plain.rlike(POSITION), F.regexp_replace(plain, POSITION, "$1|$2|$3|$4|$5|$6|$7|$8|$9|$10")), r"\|")


def position(text: Column, parts: Column | None = None) -> Column:
    """(lat, lon, unit) of a written position, null if it is none on the globe or zero/zero.

    ``unit`` grows with fineness: the decimals of a degree; an arc minute lies between one and two, an arc second
    between three and four.
    """
    p = position_parts(text) if parts is None else parts
    num = lambda i: p[i].try_cast("double")
    decimals = lambda c: F.when(c.contains("."), F.length(F.substring_index(c, ".", -1))).otherwise(0)

    def side(i: int, most: int) -> tuple[Column, Column, Column, Column]:
        letter = F.concat(p[i], p[i + 4])
        size = F.abs(num(i + 1)) + F.coalesce(num(i + 2), F.lit(0.0)) / 60 + F.coalesce(num(i + 3), F.lit(0.0)) / 3600
        south = p[i + 1].startswith("-") | letter.isin("S", "W")
        ok = (size <= most) & (F.length(letter) <= 1) & (F.coalesce(num(i + 2), F.lit(0.0)) < 60) & (F.coalesce(num(i + 3), F.lit(0.0)) < 60)
        unit = F.when(p[i + 3] != "", 3.5 + decimals(p[i + 3])).when(p[i + 2] != "", 1.5 + decimals(p[i + 2])).otherwise(decimals(p[i + 1]).cast("double"))
        return F.when(south, -size).otherwise(size), ok, unit, F.length(letter)

    lat, lat_ok, lat_unit, lat_letters = side(0, 90)
    lon, lon_ok, lon_unit, lon_letters = side(5, 180)
    good = lat_ok & lon_ok & (lat_letters == lon_letters) & ((lat != 0) | (lon != 0))
    return F.when(good, F.struct(lat.alias("lat"), lon.alias("lon"), F.greatest(lat_unit, lon_unit).alias("unit")))


def places(text: Column) -> Column:
    """The place names of a location, country first; null for placeholders and blanks."""
    names = F.filter(F.transform(F.split(text, "[:,;]"), squeeze), lambda n: ~placeholder(n))
    return F.when(~placeholder(text) & (F.size(names) > 0), names)


def _prepared(vouchers: DataFrame) -> DataFrame:
    return vouchers.select("row_id", "updated_at", "lat_lon", "geo_loc_name", "country", alnum(F.col("species_voucher_new")).alias("specimen"), position(F.col("lat_lon")).alias("position"), places(F.col("geo_loc_name")).alias("places"))


def _bundles(carry: bool) -> list[Bundle]:
    """Position, place and country: the place determines the country, which is only chosen after both others."""
    at = F.col("updated_at")
    value = lambda c: {c: F.col(c)} if carry else {}
    place = {"country": F.lower(F.col("places")[0])}
    return [
        Bundle("lat_lon", F.col("position").isNotNull(), (F.col("position.unit"), at), F.col("position.unit") + 1, values=value("lat_lon")),
        Bundle("geo", F.col("places").isNotNull(), (F.size("places"), at), F.size("places").cast("double"), place, value("geo_loc_name") | ({"named": F.col("places")[0]} if carry else {})),
        Bundle("country", ~placeholder(F.col("country")), (at,), F.lit(1.0), {"country": F.lower(squeeze(F.col("country")))}, value("country"), level=1),
    ]


def best_rows(vouchers: DataFrame) -> DataFrame:
    """(group_row_id, lat_lon_row_id, geo_row_id) of each specimen with at least two rows; 0 where no row qualifies."""
    return choose_bundles(_prepared(vouchers), F.col("specimen"), "row_id", _bundles(False)).select("group_row_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("lat_lon_row_id", "geo_row_id")])


def survivors(vouchers: DataFrame) -> DataFrame:
    """One whole record per specimen, single ones too: the best position and place, and the best country that the place
    allows; where no row states that country, it is the one that the place names."""
    chosen = choose_bundles(_prepared(vouchers), F.col("specimen"), "row_id", _bundles(True), least=1)
    return chosen.select("group_row_id", "n_rows", "lat_lon_row_id", "geo_row_id", "country_row_id", "lat_lon", "geo_loc_name", F.coalesce("country", "named").alias("country"))
