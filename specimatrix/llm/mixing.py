"""A mix of documents in which each source has its target share of tokens.

A classifier fitted on labelled rows predicts a document's domain from its words. What a document states is weighed
against that by how often statements are wrong, which held-out rows tell, so every document belongs softly to several
domains. The rates at which documents are taken, between nothing and the allowed repeats, solve a least squares problem by
projected gradient descent: the expected tokens of each domain shall match its target. Documents of like membership are
summed before, so that the descent runs over a bounded number of cells and a document's rate follows from its steps.
Whole copies are then dealt so that the tokens of each source, as stated, meet the target.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from specimatrix.llm.tokens import TOKENIZER, encoding, offer
from specimatrix.session import cut, fixed_rows, width


@dataclass(frozen=True)
class MixModel:
    """Parameters. ``labelled`` is about how many rows the classifier is fitted on, a fifth of them to judge it by."""

    cells: int = 1 << 14
    labelled: int = 20_000
    smooth: float = 0.5
    steps: int = 80
    rate: float = 0.9
    close: float = 1e-5
    grain: int = 16  # steps of a membership in one cell
    most_cells: int = 100_000  # coarser grains are taken beyond
    bins: int = 4096
    seed: int = 20


_WORD = re.compile(r"[^\W\d_]{2,}")


def _cells(text: str, cells: int) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh32_intdigest(w) % cells for w in set(_WORD.findall(text.lower()))], dtype=np.int64)


def _sums(df: DataFrame, arrays, keys: int, columns: int) -> np.ndarray:
    """Sums over all rows of ``arrays(frames)``, which gives keys x columns; at most ``keys`` rows come to the driver."""
    names = [f"v{i}" for i in range(columns)]

    def part(frames):
        total = arrays(frames)
        used = np.flatnonzero(total.any(axis=1))
        yield pd.DataFrame(total[used], columns=names).assign(key=used)

    found = df.mapInPandas(part, ", ".join(f"{n} double" for n in names) + ", key int").groupBy("key").agg(*[F.sum(n).alias(n) for n in names]).toPandas()
    out = np.zeros((keys, columns))
    out[found["key"].to_numpy(dtype=int)] = found[names].to_numpy()
    return out


def labelled_sample(documents: DataFrame, sources: list[str], model: MixModel) -> DataFrame:
    """(source, text, held) of about ``labelled`` rows that state a listed source, by a hash of their ids; all if fewer."""
    known = documents.where(F.col("source").isin(*sources) & F.col("text").isNotNull())
    n = known.count()
    place = lambda salt: F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(salt)), 11) / F.lit(float(1 << 53))
    return known.where(place(model.seed) < model.labelled / max(n, 1)).select("source", "text", (place(model.seed + 1) < 0.2).alias("held")).repartition(width(documents.sparkSession))


def fit_sources(sample: DataFrame, sources: list[str], model: MixModel) -> np.ndarray:
    """Log-probabilities of words in sources, the last row the sources' own (cells + 1 x sources): naive Bayes."""

    def count(frames):
        total = np.zeros((model.cells + 1, len(sources)))
        for f in frames:
            for source, text in zip(f["source"], f["text"]):
                k = sources.index(source)
                total[_cells(text, model.cells), k] += 1
                total[-1, k] += 1
        return total

    total = _sums(sample.where("not held"), count, model.cells + 1, len(sources))
    per_word = np.log((total[:-1] + model.smooth) / (total[-1] + 2 * model.smooth))
    return np.vstack([per_word, np.log((total[-1] + model.smooth) / (total[-1] + model.smooth).sum())])


def posterior(log_p: np.ndarray, cells: np.ndarray, soft: float = 1.0) -> np.ndarray:
    """The probability of each source by a text's words; ``soft`` divides the words' evidence, which is not independent."""
    x = log_p[-1] + log_p[cells].sum(axis=0) / soft
    x = np.exp(x - x.max())
    return x / x.sum()


SOFTNESS = (1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0, 128.0)
_STEPS = 400


def judge(sample: DataFrame, log_p: np.ndarray, sources: list[str], model: MixModel) -> tuple[float, float]:
    """How far to soften the classifier and how often a stated source is wrong, by held-out rows.

    The softness is the one under which the held-out statements are likeliest; the share of wrong ones is then found by
    expectation-maximisation over a histogram of the probabilities of what is stated.
    """
    shared = sample.sparkSession.sparkContext.broadcast(log_p)
    ns = len(sources)

    def count(frames):
        total = np.zeros((len(SOFTNESS) * _STEPS, 1))
        for f in frames:
            for source, text in zip(f["source"], f["text"]):
                cells, k = _cells(text, model.cells), sources.index(source)
                for i, soft in enumerate(SOFTNESS):
                    q = min(max(posterior(shared.value, cells, soft)[k], 1e-9), 1 - 1e-9)
                    total[i * _STEPS + int(np.clip((math.log(q / (1 - q)) + 20) / 40 * _STEPS, 0, _STEPS - 1)), 0] += 1
        return total

    seen = _sums(sample.where("held"), count, len(SOFTNESS) * _STEPS, 1).reshape(len(SOFTNESS), _STEPS)
    q = 1 / (1 + np.exp(-((np.arange(_STEPS) + 0.5) / _STEPS * 40 - 20)))
    if seen.sum() == 0 or ns < 2:
        return SOFTNESS[-1], 0.0
    best = int((seen @ np.log(q)).argmax())
    wrong = 0.05
    for _ in range(200):
        right = (1 - wrong) * q / ((1 - wrong) * q + wrong / (ns - 1) * (1 - q))
        wrong = float((seen[best] * (1 - right)).sum() / seen[best].sum())
    return SOFTNESS[best], max(wrong, 1e-6)


def membership(guess: np.ndarray, stated: int | None, wrong: float) -> np.ndarray:
    """What a document belongs to by its words and by the source that it states, which is ``wrong`` that often."""
    if stated is None or len(guess) < 2:
        return guess
    p = guess * (wrong / (len(guess) - 1))
    p[stated] = guess[stated] * (1 - wrong)
    return p / p.sum() if p.sum() > 0 else np.eye(len(guess))[stated]


def rates(p: np.ndarray, cap: np.ndarray, steps: list[np.ndarray], rate: float) -> np.ndarray:
    """The rate of each document after all ``steps``: start at one, go against the gradient, stay between 0 and the cap."""
    r = np.minimum(1.0, cap)
    for g in steps:
        r = np.clip(r - rate * (p @ g), 0.0, cap)
    return r


def descend(tokens: np.ndarray, p: np.ndarray, repeats: np.ndarray, goal: np.ndarray, model: MixModel) -> list[np.ndarray]:
    """The gradients of projected gradient descent on the squared distance of the domains' tokens from ``goal``."""
    there, cap, steps = tokens @ p, p @ repeats, []
    r = rates(p, cap, steps, model.rate)
    while len(steps) < model.steps:
        off = (tokens * r) @ p - goal
        if np.abs(off).max(initial=0.0) <= model.close * max(goal.sum(), 1.0):
            break
        steps.append(np.where(there > 0, off / np.maximum(there, 1e-9), 0.0))
        r = np.clip(r - model.rate * (p @ steps[-1]), 0.0, cap)
    return steps


def mix(documents: DataFrame, source_target: DataFrame, model: MixModel = MixModel(), path: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, tokens, copies) of every document that is used.

    ``source`` is what the document states, or the likeliest one where that is null or not listed. The total is the
    largest at which every source can reach its share within its repeats. A document's copies never exceed the repeats of
    its source. Documents without tokens are not used. Targets with a null source or no positive share are left out, and
    so are documents that state such a source. Repeated rows are documents of their own. Extra columns are not read.
    Empty tables: empty result.
    """
    spark = documents.sparkSession
    listed = fixed_rows(source_target.where("source is not null").groupBy("source").agg(F.max(F.when(F.col("max_repeats") > 0, F.col("target_share"))).alias("share"), F.max("max_repeats").alias("repeats")), "sources")
    targets = sorted((r for r in listed if r.share is not None and r.share > 0), key=lambda r: r.source)
    sources = [r.source for r in targets]
    if not sources:
        return documents.select("doc_id", "source", F.lit(0).cast("bigint").alias("tokens"), F.lit(0).alias("copies")).limit(0)
    ns, without = len(sources), {r.source for r in listed} - set(sources)
    share = np.array([r.share for r in targets], dtype=float)
    share /= share.sum()
    repeats = np.array([r.repeats for r in targets], dtype=float)
    offer(spark, path)
    sample = cut(labelled_sample(documents, sources, model))
    log_p = fit_sources(sample, sources, model)
    soft, wrong = judge(sample, log_p, sources, model)
    shared = spark.sparkContext.broadcast(log_p)

    def read(frames):
        code, at = encoding(path), {s: k for k, s in enumerate(sources)}
        for f in frames:
            rows = []
            for doc, source, text in zip(f["doc_id"], f["source"], f["text"]):
                if n := len(code.encode_ordinary(text)):
                    p = membership(posterior(shared.value, _cells(text, model.cells), soft), at.get(source), wrong)
                    rows.append((doc, n, at.get(source, int(p.argmax())), p))
            if rows:
                yield pd.DataFrame(rows, columns=["doc_id", "tokens", "k", "p"])

    rows = documents.where(F.col("text").isNotNull())
    if without:
        rows = rows.where(F.col("source").isNull() | ~F.col("source").isin(*without))
    table = cut(rows.select("doc_id", "source", "text").repartition(width(spark)).mapInPandas(read, "doc_id bigint, tokens bigint, k int, p array<double>"))
    for grain in (model.grain, 8, 4, 2, 1):
        cell = F.transform("p", lambda x: F.round(x * grain).cast("smallint"))
        sums = table.groupBy("k", cell.alias("cell")).agg(F.sum("tokens").alias("tokens"), *[F.sum(F.col("tokens") * F.col("p")[i]).alias(f"p{i}") for i in range(ns)])
        found = sums.drop("cell").limit(model.most_cells + 1).toPandas()  # bounded: coarser where there are more
        if len(found) <= model.most_cells:
            break
    else:
        found = table.groupBy("k").agg(F.sum("tokens").alias("tokens"), *[F.sum(F.col("tokens") * F.col("p")[i]).alias(f"p{i}") for i in range(ns)]).toPandas()
    tokens = found["tokens"].to_numpy(dtype=float)
    there = np.bincount(found["k"].to_numpy(dtype=int), weights=tokens, minlength=ns)
    reach = (there * repeats / share)[there > 0]
    goal = share * reach.min(initial=np.inf) if len(reach) else share * 0
    steps = descend(tokens, found[[f"p{i}" for i in range(ns)]].to_numpy(dtype=float) / np.maximum(tokens, 1)[:, None], repeats, goal, model)

    def wanted(f) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A document's rate, its source, and its most copies. It gets its j-th copy where the source's shift is j - 1 more
        than the rate less a fixed chance."""
        p = np.stack(f["p"].to_numpy())
        k = f["k"].to_numpy()
        return rates(p, p @ repeats, steps, model.rate) - f["chance"].to_numpy(), k, repeats[k]

    def histogram(low: np.ndarray, high: np.ndarray):
        """Tokens that each source gains in each step of its shift from ``low`` to ``high``; the first has all below."""

        def count(frames):
            total = np.zeros((ns * (model.bins + 2), 1))
            for f in frames:
                if len(f):
                    r, k, most = wanted(f)
                    for j in range(1, int(repeats.max()) + 1):
                        ok = most >= j
                        at = np.clip(np.ceil((j - 1 - r[ok] - low[k[ok]]) / (high - low)[k[ok]] * model.bins), 0, model.bins + 1).astype(int)
                        np.add.at(total[:, 0], k[ok] * (model.bins + 2) + at, f["tokens"].to_numpy()[ok])
            return total

        return _sums(dealt, count, ns * (model.bins + 2), 1).reshape(ns, model.bins + 2).cumsum(axis=1)

    chance = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(model.seed)), 11) / F.lit(float(1 << 53))).alias("chance")
    dealt = table.select("doc_id", "tokens", "k", "p", chance)
    low, high = np.full(ns, -repeats.max() - 2), np.full(ns, repeats.max() + 2)
    for _ in range(2):  # the shift at which a source's tokens reach its goal, to one part in bins squared
        gained = histogram(low, high)
        step = np.array([min(int(np.searchsorted(g, t)), model.bins) for g, t in zip(gained, goal)])
        width_of = (high - low) / model.bins
        low, high = low + np.maximum(step - 1, 0) * width_of, low + np.maximum(step, 1) * width_of
    shift = high

    def copies(frames):
        for f in frames:
            if len(f):
                r, k, most = wanted(f)
                n = np.clip(np.floor(r + shift[k] + 1), 0, most).astype(np.int32)
                yield pd.DataFrame({"doc_id": f["doc_id"], "source": [sources[x] for x in k], "tokens": f["tokens"], "copies": n})

    return dealt.mapInPandas(copies, "doc_id bigint, source string, tokens bigint, copies int").where("copies > 0")


def shares(mixed: DataFrame, source_target: DataFrame) -> DataFrame:
    """The shares reached: (source, target_share, max_repeats, documents, copies, tokens, share, most_copies)."""
    used = mixed.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("copies").alias("copies"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_copies"))
    used = used.withColumn("whole", F.sum("tokens").over(Window.partitionBy()))  # a row for each source
    return source_target.select("source", "target_share", "max_repeats").join(used, "source", "left").select("source", "target_share", "max_repeats", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("copies", F.lit(0)).alias("copies"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce(F.col("tokens") / F.col("whole"), F.lit(0.0)).alias("share"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"))
