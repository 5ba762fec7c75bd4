"""Variant spellings of persons and organisations, linked by noisy-channel attribution.

Frequent spellings are candidate canonical forms. A variant is attached to the one of highest posterior: how often and in
how many forms the candidate is written, times how likely it is to be distorted into the variant by one or two typing errors,
an abbreviation, a nickname or reordered parts. Candidates are found by joins on shared deletions, on
surnames and on initials, never by comparing all pairs.
"""

from __future__ import annotations

import math
import re
import unicodedata
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specimatrix.functions.text import placeholder
from specimatrix.session import cut, width

# Titles, and words that make a name an institution's.
TITLES = set("dr prof professor mr mrs ms miss sir dipl ing phd msc bsc mag don herr frau mme".split())
INSTITUTION = set("museum mus institute institut inst university univ department dept society soc office bureau survey team expedition aquarium aquar laboratory lab station stn stat research res coastal coast centre center college academy acad collection collections herbarium agency ministry service school faculty foundation fisheries zoology zool biology biol natural nat history objects obj marine mar harbour harb project consortium group".split())
# Short forms of given names; those that the data itself tells, as in "Vincent (Vince)", come first.
NICKNAMES = dict(pair.split(":") for pair in "al:albert alex:alexander andy:andrew annie:anna ben:benjamin beppe:giuseppe bert:albert beth:elizabeth bill:william bob:robert cathy:catherine charlie:charles chris:christopher dan:daniel dani:daniela dave:david dick:richard dora:theodora ed:edward fred:frederick fritz:frederik gaby:gabriela greg:gregory hans:johannes harry:henry jack:john jim:james joe:joseph kate:katherine kathy:katherine ken:kenneth kobe:jakob kolya:nikolai larry:lawrence liz:elizabeth maggie:margaret manolo:manuel matt:matthew mike:michael molly:amalia nick:nicholas pat:patricia paco:francisco peggy:margaret pepe:jose pete:peter ray:raymond rick:richard rob:robert ron:ronald roz:rosalind sam:samuel sasha:alexander steve:steven sue:susanna ted:edward theo:theodore tim:timothy tom:thomas tony:anthony trish:patricia vince:vincent will:william".split())
SMALL = set("of the for and at in de der des du la".split())


def fold(text: str) -> str:
    """Lower case without accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", text.replace("ø", "o").replace("Ø", "O").replace("ł", "l").replace("ß", "ss")).lower() if not unicodedata.combining(c))


def parse(name: str) -> dict | None:
    """The parts of a name as typed: kind, words whose role is open, surname, given name, nickname and initials.

    None for names without a word. ``org`` has the initials of its kind and its place; ``open`` lists the two words of a
    person's name whose order is not told by comma, initials or abbreviation.
    """
    text = re.sub(r"\s+", " ", unicodedata.normalize("NFKC", name)).strip()
    words = re.findall(r"[^\W\d_]+(?:['’-][^\W\d_]+)*", text)
    if not words:
        return None
    folded = [fold(w) for w in words]
    capitals = [w for w in words if len(w) >= 3 and w.isupper()]
    rest = [w for w in words if w not in capitals]
    acronym = len(words) == 2 and len(capitals) == 1 and len(capitals[0]) <= 5 and "," not in text and not any(w in INSTITUTION for w in folded)
    if acronym and len(rest) == 1 and len(rest[0]) > 3:
        return {"kind": "o", "surname": fold(rest[0]), "given": capitals[0].lower()}
    known = [w in INSTITUTION or any(k.startswith(w) for k in INSTITUTION if len(w) >= 3 and len(k) - len(w) <= 8) and len(w) <= 5 for w in folded]
    shortened = len(re.findall(r"[^\W\d_]{3,}\.", text)) - sum(w in TITLES for w in folded) >= 2
    many = "," not in text and len([w for w in words if len(w) > 2 and fold(w) not in SMALL | TITLES]) >= 4
    if sum(known) >= 2 or shortened or many or (any(w in INSTITUTION for w in folded) and len([w for w in folded if w not in SMALL]) >= 3):
        return _organisation(text)
    nick = re.search(r"[(\"“]([^\W\d_]+)[)\"”]", text)
    plain = re.sub(r"[(\"“][^)\"”]*[)\"”]", " ", text)
    head, comma, tail = plain.partition(",")
    parts = [_tokens(head), _tokens(tail)] if comma and tail.strip() else [_tokens(plain.replace(",", " "), True)]
    out: dict = {"kind": "p", "nick": fold(nick[1]) if nick else None}
    if len(parts) == 2:
        full = [fold(t) for t, k in parts[0] if k == "w"]
        out["surname"] = " ".join(full) or None
        given = parts[1]
    else:
        full = [t for t, k in parts[0] if k == "w"]
        given = [(t, k) for t, k in parts[0] if k != "w"]
        kinds = "".join(k for _, k in parts[0])
        titled = len(parts[0]) < len(re.findall(r"[^\W\d_]+(?:['’-][^\W\d_]+)*", plain)) and fold(plain.split()[0].strip(".")) in TITLES
        if len(full) >= 2 and (nick or titled or re.search("wi+w", kinds)):
            out |= {"surname": fold(full[-1]), "given": fold(full[0]), "short": False, "inits": "".join(t for t, k in given if k == "i")}
            return out
        if len(full) >= 2 and "a" not in kinds:
            out["open"] = [fold(full[0]), fold(full[-1])]
            out["surname"] = None
            out["inits"] = "".join(t for t, k in given if k == "i")
            return out
        out["surname"] = fold(full[-1]) if full else None
    if not out["surname"]:
        return None
    word = next((t for t, k in given if k in "wa"), None)
    inits = "".join(t for t, k in given if k == "i")
    out["given"] = fold(word) if word else None
    out["short"] = any(k == "a" for t, k in given if t == word)
    out["inits"] = inits
    return out


def _tokens(text: str, alone: bool = False) -> list[tuple[str, str]]:
    """Words (w), abbreviated words (a) and initials (i), titles left out; ``alone`` if this is all there is of a name."""
    found = re.findall(r"([^\W\d_]+(?:['’-][^\W\d_]+)*)(\.?)", text)
    longest = max((len(w) for w, _ in found), default=0)
    title = [k for k, (w, _) in enumerate(found) if fold(w) in TITLES]
    if alone and len(found) - len(title) < 2:  # 'Ing. Aus' and 'Aus DR': beside a surname only, it is the given name
        title = []
    out: list[tuple[str, str]] = []
    for k, (w, dot) in enumerate(found):
        low = fold(w)
        if k in title:
            continue
        if len(w) == 1:
            out.append((low, "i"))
        elif w.isupper() and len(w) <= 3 and longest > 3 and not dot:
            out += [(c, "i") for c in low]
        elif dot and len(w) <= 4:
            out.append((w, "a"))
        else:
            out.append((w, "w"))
    return out


def _organisation(text: str) -> dict:
    """Initials of the kind of institution, and its place: the word or words that stand apart."""
    text = re.sub(r"^the\s+", "", text, flags=re.I)
    words = [(fold(w), bool(d)) for w, d in re.findall(r"([^\W\d_]+(?:['’-][^\W\d_]+)*)(\.?)", text) if fold(w) not in SMALL]
    names = [w for w, _ in words]

    def kind(w: str) -> bool:
        return w in INSTITUTION or w in _MORE or any(_close(w, k) for k in INSTITUTION | _MORE if len(k) > 4)

    sides = [i for i in (0, len(words) - 1)]
    place = next((i for i in sides[::-1] if not words[i][1] and not kind(names[i])), None)
    if place is None:
        place = max(sides, key=lambda i: len(names[i]))
    return {"kind": "o", "surname": names[place], "given": "".join(w[0] for i, w in enumerate(names) if i != place)}


_MORE = set("deep water wat exped surv off fish".split())


def _close(a: str, b: str) -> bool:
    """At most one error: a letter missing, added, changed or two swapped."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])


_PARSED = "name string, n bigint, kind string, surname string, given string, short boolean, inits string, nick string, one string, two string"


def _parsed(frames):
    for f in frames:
        rows = []
        for name, n in zip(f["name"], f["n"]):
            if p := parse(name):
                one, two = p.get("open") or (None, None)
                rows.append((name, n, p["kind"], p.get("surname"), p.get("given"), bool(p.get("short")), p.get("inits") or "", p.get("nick"), one, two))
        if rows:
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _PARSED.split(", ")])


@dataclass(frozen=True)
class Channel:
    """How likely errors are, as logarithms: what people do (leave out, double, swap letters) and what they rarely do.

    ``second`` is added for a second error in a word, ``head`` for one in its first letter. A spelling in fewer than
    ``established`` forms is a name of its own with probability exp(``novel``); two errors are looked for in words of
    ``long`` letters or more.
    """

    usual: float = -1.05
    rare: float = -2.6
    second: float = -1.0
    head: float = -1.0
    novel: float = -3.2
    established: int = 4
    long: int = 9


#: For names in one pool, where many people share each of them and every error recurs.
POOLED = Channel(usual=-4.0, rare=-6.0, novel=0.0)


def distortion(true: str, typed: str, channel: Channel = Channel()) -> float:
    """Log-likelihood that ``true`` is typed as ``typed`` with one or two errors; minus infinity beyond."""
    best: dict[tuple[int, int, int], float] = {(0, 0, 0): 0.0}
    for i in range(len(true) + 1):
        for j in range(max(0, i - 2), min(len(typed), i + 2) + 1):
            for e in range(3):
                if (here := best.get((i, j, e))) is None:
                    continue
                steps = []
                if i < len(true) and j < len(typed) and true[i] == typed[j]:
                    steps.append((i + 1, j + 1, e, 0.0))
                if e < 2:
                    price = (channel.head if min(i, j) == 0 else 0.0) + (channel.second if e else 0.0)
                    if i < len(true):
                        steps.append((i + 1, j, e + 1, price + channel.usual))
                    if j < len(typed):
                        doubled = (j > 0 and typed[j - 1] == typed[j]) or typed[j : j + 1] == typed[j + 1 : j + 2]
                        steps.append((i, j + 1, e + 1, price + (channel.usual if doubled else channel.rare)))
                    if i < len(true) and j < len(typed):
                        steps.append((i + 1, j + 1, e + 1, price + channel.rare))
                    if true[i : i + 2] == typed[j : j + 2][::-1] and len(true[i : i + 2]) == 2:
                        steps.append((i + 2, j + 2, e + 1, price + channel.usual))
                for x, y, f, p in steps:
                    best[x, y, f] = max(best.get((x, y, f), -math.inf), here + p)
    return max(best.get((len(true), len(typed), e), -math.inf) for e in (0, 1, 2))


def _deletions(word: Column) -> Column:
    """The word and what is left of it without each of its letters."""
    return F.array_distinct(F.array_append(F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word)))), word))


def _merge(df: DataFrame) -> DataFrame:
    """``df`` as a side of a sort-merge join: tables that grow with the data are not broadcast because they are small yet."""
    return df.hint("merge")


def attach(words: DataFrame, least: int, channel: Channel = Channel()) -> DataFrame:
    """(block, word, forms, n) -> (block, word, root): each spelling with its canonical one in the same block.

    A spelling goes to the candidate of highest posterior: the logarithm of the forms it is written in plus that of the
    distortion; to none if it is likelier to be a name of its own. What it goes to may go on, until nothing does.
    Spellings of fewer than ``least`` letters stay as they are; candidates share what is left after one or, in long words,
    two deletions.
    """
    once = _deletions(F.col("word"))
    keys = F.when(F.length("word") >= channel.long, F.array_distinct(F.flatten(F.transform(once, _deletions)))).otherwise(once)
    sides = words.where(F.length("word") >= least).select("block", "word", "forms", "n", F.explode(keys).alias("key"))
    a, b = sides.alias("a"), _merge(sides.alias("b"))
    rank = lambda x: F.struct(F.col(f"{x}.forms"), F.col(f"{x}.n"), F.col(f"{x}.word"))
    near = F.abs(F.length("a.word") - F.length("b.word")) <= 2
    pairs = a.join(b, (F.col("a.block") == F.col("b.block")) & (F.col("a.key") == F.col("b.key")) & (rank("b") > rank("a")) & near & (F.levenshtein("a.word", "b.word", 4) >= 0))
    pairs = pairs.select(F.col("a.block").alias("block"), F.col("a.word").alias("word"), F.col("a.forms").alias("forms"), F.col("b.word").alias("to"), F.col("b.forms").alias("to_forms"), F.col("b.n").alias("to_n")).distinct()

    @F.pandas_udf("double")
    def likely(true: pd.Series, typed: pd.Series) -> pd.Series:
        return pd.Series([distortion(x, y, channel) for x, y in zip(true, typed)], dtype=float)

    posterior = F.log(F.col("to_forms")) + likely("to", "word")
    own = F.log(F.col("forms")) + F.when(F.col("forms") < channel.established, channel.novel).otherwise(0.0)
    scored = pairs.select("block", "word", "to", "to_forms", "to_n", posterior.alias("p"), own.alias("own")).where("p > own")
    best = F.max(F.struct("p", "to_forms", "to_n", "to"))
    step = cut(scored.groupBy("block", "word").agg(best.alias("best")).select("block", "word", F.col("best.to").alias("root")))
    while True:  # each turn doubles the length of the ways that are followed; ranks grow on them, so they end
        on = step.select("block", F.col("word").alias("root"), F.col("root").alias("next"))
        onward = step.join(_merge(on), ["block", "root"])
        if onward.isEmpty():
            break
        step = cut(step.join(_merge(on), ["block", "root"], "left").select("block", "word", F.coalesce("next", "root").alias("root")))
    return words.select("block", "word").join(_merge(step), ["block", "word"], "left").select("block", "word", F.coalesce("root", "word").alias("root"))


def link_names(names: DataFrame) -> DataFrame:
    """(name, n) with distinct names -> (name, entity): the person or organisation that each string names.

    Names that are null, blank, placeholders or without a letter belong to none and give no row. Ties of posterior go to
    the more frequent, then to the alphabetically last candidate. A surname without given name or initial is an entity
    of its own. Very long texts are parsed like any other. Extra columns are not read. Empty table: empty result.
    """
    spark = names.sparkSession
    parsed = cut(names.where(~placeholder(F.col("name"))).select("name", "n").repartition(width(spark)).mapInPandas(_parsed, _PARSED))
    told = parsed.where("kind = 'p' and surname is not null")
    words = told.select(F.col("surname").alias("word"), F.lit(1).alias("s"), F.lit(0).alias("g")).unionAll(told.where("given is not null and not short").select("given", F.lit(0), F.lit(1)))
    words = words.unionAll(told.where("nick is not null").select("nick", F.lit(0), F.lit(1)))
    roles = words.groupBy("word").agg(F.log((F.sum("g") + 0.1) / (F.sum("s") + 0.1)).alias("lean"))
    asked = parsed.where("kind = 'p' and surname is null").select("name", "n", "one", "two", "inits")
    for side in ("one", "two"):
        asked = asked.join(_merge(roles.select(F.col("word").alias(side), F.col("lean").alias(f"lean_{side}"))), side, "left")
    first = F.coalesce("lean_one", F.lit(0.0)) - F.coalesce("lean_two", F.lit(0.0)) >= -0.5
    asked = asked.select("name", "n", F.lit("p").alias("kind"), F.when(first, F.col("two")).otherwise(F.col("one")).alias("surname"), F.when(first, F.col("one")).otherwise(F.col("two")).alias("given"), F.lit(False).alias("short"), "inits")
    people = told.select("name", "n", "kind", "surname", "given", "short", "inits").unionByName(asked)
    usual = spark.createDataFrame(list(NICKNAMES.items()), "given string, formal string").select("given", "formal", F.lit(0).cast("bigint").alias("count"))
    nicks = told.where("nick is not null and given is not null and not short").groupBy(F.col("nick").alias("given"), F.col("given").alias("formal")).count().unionByName(usual)
    nicks = nicks.groupBy("given").agg(F.max(F.struct("count", "formal")).alias("best")).select("given", F.col("best.formal").alias("formal"))
    people = people.join(_merge(nicks), "given", "left").withColumn("given", F.when(~F.col("short"), F.coalesce("formal", "given")).otherwise(F.col("given"))).drop("formal")
    everyone = people.unionByName(parsed.where("kind = 'o'").select(*people.columns))
    spelled = everyone.groupBy(F.col("kind").alias("block"), F.col("surname").alias("word")).agg(F.count(F.lit(1)).alias("forms"), F.sum("n").alias("n"))
    roots = attach(spelled, 5).select(F.col("block").alias("kind"), F.col("word").alias("surname"), "root")
    everyone = cut(everyone.join(_merge(roots), ["kind", "surname"]))
    full = everyone.where("kind = 'p' and given is not null and not short")
    given = attach(full.groupBy(F.col("root").alias("block"), F.col("given").alias("word")).agg(F.count(F.lit(1)).alias("forms"), F.sum("n").alias("n")), 3)
    given = given.select(F.col("block").alias("root"), F.col("word").alias("given"), F.col("root").alias("formal"))
    pool = cut(given.groupBy(F.lit("g").alias("block"), F.col("formal").alias("word")).agg(F.count(F.lit(1)).alias("forms"), F.count(F.lit(1)).alias("n")))
    usual_given = attach(pool, 4, POOLED).where("word != root").select(F.col("word").alias("formal"), F.col("root").alias("common"))
    given = given.join(_merge(usual_given), "formal", "left").select("root", "given", F.coalesce("common", "formal").alias("formal"))
    full = cut(full.join(_merge(given), ["root", "given"]))
    known = full.groupBy("root", "formal").agg(F.sum("n").alias("prior"), F.max("inits").alias("middle")).withColumn("initial", F.substring("formal", 1, 1))
    full = full.select("name", F.concat_ws("|", F.lit("p"), "root", "formal").alias("entity"))
    brief = everyone.where("kind = 'p' and (given is null or short)").withColumn("letters", F.concat(F.when(F.col("short"), F.substring("given", 1, 1)).otherwise(""), "inits")).withColumn("initial", F.substring("letters", 1, 1))
    fits = ~F.col("short") | F.col("formal").startswith(F.col("given"))
    own = F.substring("letters", 2, 9)
    middle = F.when((own == "") | (F.col("middle") == ""), F.lit(0.0)).when(own == F.col("middle"), F.lit(3.0)).otherwise(F.lit(-6.0))
    posterior = F.when(fits, F.log("prior") + middle)
    best = brief.join(_merge(known), ["root", "initial"], "left").groupBy("name", "root", "letters").agg(F.max(F.when(fits, F.struct(posterior.alias("p"), F.col("formal").alias("formal")))).alias("best"))
    brief = best.select("name", F.concat_ws("|", F.lit("p"), "root", F.coalesce("best.formal", F.substring("letters", 1, 1))).alias("entity"))
    orgs = everyone.where("kind = 'o'").select("name", F.concat_ws("|", F.lit("o"), "root", "given").alias("entity"))
    return full.unionAll(brief).unionAll(orgs)


def typed_names(final: DataFrame) -> DataFrame:
    """The distinct strings of both columns of persons and institutions, with how often they occur."""
    both = final.select(F.col("collected_by").alias("name")).unionAll(final.select("identified_by"))
    return both.where("name is not null").groupBy("name").agg(F.count(F.lit(1)).alias("n"))


def same_names(final: DataFrame) -> DataFrame:
    """(name_a, name_b): each pair of different strings that name the same, the smaller by UTF-8 bytes first."""
    linked = cut(link_names(typed_names(final)))
    other = linked.select("entity", F.col("name").alias("name_b"))
    return linked.select("entity", F.col("name").alias("name_a")).join(_merge(other), "entity").where("name_a < name_b").select("name_a", "name_b")


def canonical_names(final: DataFrame) -> DataFrame:
    """(name, canonical, links): each spelling with the most frequent one of its entity and how many others it is linked to."""
    counted = cut(typed_names(final))
    linked = cut(link_names(counted).join(_merge(counted), "name"))
    top = linked.groupBy("entity").agg(F.max(F.struct("n", "name")).alias("top"), (F.count(F.lit(1)) - 1).alias("links")).select("entity", F.col("top.name").alias("canonical"), "links")
    return linked.join(_merge(top), "entity").select("name", "canonical", "links")
