"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specimatrix.session import width

#: Vocabulary file on the driver; executors that have no such path get it with the application's files.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How byte-level BPE divides a text before merging; as published with the vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def encoding(path: str):
    import tiktoken
    from pyspark import SparkFiles

    with open(path if os.path.exists(path) else SparkFiles.get(os.path.basename(path)), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("given", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def offer(spark: SparkSession, path: str) -> None:
    """Sends the vocabulary file along, once for each application."""
    sent = getattr(spark.sparkContext, "_specimatrix_files", set())
    if path not in sent:
        spark.sparkContext.addFile(path)
        spark.sparkContext._specimatrix_files = sent | {path}


def first_part(text: str) -> str:
    """What comes before the loss-bearing part of a training example: the first line, or its first sentence."""
    line = text.lstrip().partition("\n")[0]
    end = min((i for i in (line.find(". "), line.find("? "), line.find("! ")) if i >= 0), default=len(line) - 1)
    return line[: end + 1]


def sized(documents: DataFrame, keep: tuple[str, ...] = (), path: str = TOKENIZER) -> DataFrame:
    """(doc_id, *keep, tokens, prompt_tokens) of every document that has a text; an empty one has 0 tokens."""

    def count(frames):
        code = encoding(path)
        for f in frames:
            texts = f.pop("text")
            f["tokens"] = [len(code.encode_ordinary(t)) for t in texts]
            f["prompt_tokens"] = [min(n, len(code.encode_ordinary(first_part(t)))) for t, n in zip(texts, f["tokens"])]
            yield f

    offer(documents.sparkSession, path)
    kinds = dict(documents.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("doc_id", *keep)) + ", tokens bigint, prompt_tokens bigint"
    rows = documents.where(F.col("text").isNotNull()).select("doc_id", *keep, "text")
    return rows.repartition(width(documents.sparkSession)).mapInPandas(count, schema)
