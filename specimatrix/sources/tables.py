"""Delimited tables as the pipeline's steps exchange them: every column a string, missing texts null."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specimatrix.functions.text import missing_value


class EngineError(Exception):
    """Base of this library's errors."""


class UnsupportedFormatError(EngineError):
    """A file whose format is not read."""


class PipelineStepError(EngineError):
    """A step that can not run or has left no valid result."""


#: Extension -> separator; a text table is tab-separated.
SEPARATORS = {".csv": ",", ".tsv": "\t", ".txt": "\t"}


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A .csv, .tsv or .txt table with header, all strings; names are stripped and missing texts become null.

    Excel files are read on the driver through pandas if it has a reader for them; other formats are refused.
    """
    kind = Path(path.rstrip("/")).suffix.lower()
    if kind in (".xlsx", ".xls"):
        try:
            import pandas as pd

            frame = pd.read_excel(path, dtype=str)
        except ImportError as e:
            raise UnsupportedFormatError(f"No reader for {kind} is installed") from e
        df = spark.createDataFrame(frame.astype(object).where(frame.notna(), None), ", ".join(f"`{c}` string" for c in frame.columns))
    elif kind in SEPARATORS:
        df = spark.read.csv(path, header=True, sep=SEPARATORS[kind], quote='"', escape='"', multiLine=True, inferSchema=False, encoding="UTF-8")
    else:
        raise UnsupportedFormatError(f"Unsupported format: {kind or path}")
    df = df.toDF(*[c.strip() for c in df.columns])
    return missing_to_null(df)


def missing_to_null(df: DataFrame) -> DataFrame:
    """Texts that stand for a missing value become null in all string columns."""
    return df.select(*[missing_value(F.col(f"`{c}`")).alias(c) if t == "string" else F.col(f"`{c}`") for c, t in df.dtypes])


def column_key(name: str) -> str:
    """Name for lenient comparison: lower case, blanks as underscores."""
    return name.lower().replace(" ", "_")


def resolve(df: DataFrame, name: str) -> str | None:
    """The column that ``name`` means: exact, then regardless of case and of blanks or underscores; None if there is none."""
    if name in df.columns:
        return name
    known = {column_key(c): c for c in df.columns}
    return known.get(column_key(name)) or (name.replace("_", " ") if name.replace("_", " ") in df.columns else None)


def normalised_names(names: list[str]) -> list[str]:
    """Names as keys; repeated ones are numbered ``__dup1``, ``__dup2``."""
    seen: dict[str, int] = {}
    out = []
    for n in names:
        k = re.sub(r"\s+", "_", n.strip()).lower()
        out.append(k if k not in seen else f"{k}__dup{seen[k]}")
        seen[k] = seen.get(k, 0) + 1
    return out


def normalise_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*normalised_names(df.columns))


def project(df: DataFrame, names: list[str]) -> DataFrame:
    """The columns that the names resolve to, each once; names without a column are left out."""
    found = [c for c in (resolve(df, n) for n in names) if c]
    return df.select(*[F.col(f"`{c}`") for c in dict.fromkeys(found)])


def checked_columns(df: DataFrame, mandatory: list[str], optional: list[str] = ()) -> DataFrame:
    """``df`` with missing optional columns as empty texts; raises if a mandatory one is missing."""
    if missing := [c for c in mandatory if resolve(df, c) is None]:
        raise PipelineStepError(f"Missing required columns: {', '.join(missing)}")
    return df.withColumns({c: F.lit("") for c in optional if resolve(df, c) is None})


def reordered(df: DataFrame, first: list[str]) -> DataFrame:
    """``first`` columns, as far as there are such, before the others."""
    return df.select(*[f"`{c}`" for c in first if c in df.columns], *[f"`{c}`" for c in df.columns if c not in first])


def write_table(df: DataFrame, path: str, sep: str = ",", by: str | None = None, single: bool = False) -> str:
    """A CSV folder with header, UTF-8; with ``by`` its parts are sorted, one after the other, by that column.

    ``single`` leaves one part file, for results that are small by their nature.
    """
    df = df.orderBy(by) if by else df
    (df.coalesce(1) if single else df).write.mode("overwrite").csv(path, header=True, sep=sep, quote='"', escape='"', encoding="UTF-8", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return path


def write_json_report(df: DataFrame, path: str) -> str:
    """One JSON object per row."""
    df.write.mode("overwrite").json(path)
    return path


def write_text_report(lines: DataFrame, path: str) -> str:
    """A one-column table of lines as a text file, in order."""
    lines.coalesce(1).write.mode("overwrite").text(path)
    return path


def valid_output(spark: SparkSession, path: str) -> bool:
    """True if a completed, non-empty result lies at ``path``."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return False
    if fs.getFileStatus(at).isFile():
        return fs.getFileStatus(at).getLen() > 0
    return fs.exists(jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS"))


def newest(spark: SparkSession, pattern: str) -> str | None:
    """The latest non-empty file or complete folder that a glob pattern names; None if there is none."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(pattern)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at) or ()
    for f in sorted(found, key=lambda f: -f.getModificationTime()):
        if valid_output(spark, name := f.getPath().toString()):
            return name
    return None


def format_size(size: float | None) -> str:
    """A number of bytes for people: ``1.5 KB``."""
    value, units = float(size or 0), ["B", "KB", "MB", "GB", "TB", "PB"]
    while value >= 1024 and len(units) > 1:
        value, units = value / 1024, units[1:]
    return f"{value:.1f} {units[0]}"
