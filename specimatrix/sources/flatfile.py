"""Sequence flat files: one row per record, parsed by expressions over the record's text.

Records end at a line ``//``; the text source splits there, so a large file is read by many tasks. The parsed schema is
nested and typed; the flat view of the pipeline's tables is made from it at the end.
"""

from __future__ import annotations

import logging
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from specimatrix.functions.text import python_title, squeeze
from specimatrix.session import computed, fixed_rows, spread_null

log = logging.getLogger(__name__)
PATTERN = r"(?i).*\.(gb|gbk|genbank|gbff)$"

# Columns of the flat view before those that are found in the data.
BASE_COLUMNS = ("LocusID", "ACCESSION", "Version", "Length", "MoleculeType", "Topology", "Division", "Date", "Definition", "Keywords", "HeaderOrganism", "Taxonomy", "organism", "mol_type", "organelle", "isolate", "host", "db_xref", "country", "specimen_voucher", "culture_collection", "clone", "strain", "collection_date", "collected_by", "identified_by", "note", "TaxonID", "Class", "Order", "Family", "Genus")
# Fields of an assembly, and the keys under which structured comments hold them.
ASSEMBLY_FIELDS = ("Assembly Method", "Assembly Name", "Sequencing Technology", "Genome Coverage", "Expected Final Version")
ASSEMBLY_KEYS = ("Assembly-Data", "Assembly-data", "assembly-data", "Genome-Assembly-Data", "Genome-assembly-data")


@dataclass(frozen=True)
class Discovery:
    """The flat files below some paths, how many files there are in all, how many are of other kinds, and lost paths."""

    files: DataFrame
    total: int
    skipped: int
    missing: tuple[str, ...]


def discover(spark: SparkSession, paths: str | list[str]) -> Discovery:
    """(file_path, length) of the flat files below folders or of single files, any case of the extension, empty ones too.

    Files with content are listed by Spark, in parallel for many folders; its sources leave out empty files, which the
    file system's own listing adds. Paths that do not exist are told and warned of.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    empty, there, missing, total, fit = [], [], [], 0, 0
    for path in [paths] if isinstance(paths, str) else paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(conf)
        if not fs.exists(at):
            log.warning("No such path: %s", path)
            missing.append(path)
            continue
        there.append(path)
        found = fs.listFiles(at, True)
        while found.hasNext():
            f = found.next()
            total += 1
            if re.match(PATTERN, name := f.getPath().toUri().toString()):
                fit += 1
                if f.getLen() == 0:
                    empty.append((name, 0))
    schema = "file_path string, length bigint"
    files = spark.createDataFrame(empty, schema)
    if there:
        full = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(there).select(F.col("path").alias("file_path"), "length")
        files = full.where(F.col("file_path").rlike(PATTERN) & (F.col("length") > 0)).unionAll(files)
    return Discovery(files.withColumn("file_path", _plain_uri(F.col("file_path"))), total, total - fit, tuple(missing))


def flat_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file_path, length) of the flat files below a folder or several."""
    return discover(spark, path).files


def _plain_uri(c: Column) -> Column:
    """``file:/x`` and ``file:///x`` are one place."""
    return F.regexp_replace(c, "^file:/+", "file:///")


def read_records(spark: SparkSession, path: str | list[str], pattern: str = PATTERN) -> DataFrame:
    """(file_path, at, text) of every record in files whose path matches; ``at`` orders the records of a file.

    The order comes from a record's place in the file's splits, so that 'first' means first in the file.
    """
    lines = spark.read.option("lineSep", "\n//").option("recursiveFileLookup", "true").text(path)
    rows = lines.select(_plain_uri(F.col("_metadata.file_path")).alias("file_path"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"), F.col("value"))
    text = F.regexp_replace(F.regexp_replace("value", "\r", ""), r"^\n+|(?<=\n)//\s*$", "")
    rows = rows.where(F.col("file_path").rlike(pattern)).withColumn("text", text).where(F.trim(F.translate("text", "\n\t", "  ")) != "")
    return rows.select("file_path", F.struct("_block", "_id").alias("at"), "text")


def _section(text: Column, keyword: str, indent: int = 0) -> Column:
    """The lines of a keyword with its continuation lines joined; null if there is none."""
    found = F.regexp_extract(text, rf"(?m)^ {{{indent}}}{keyword}\b[ ]*(.*(?:\n {{12}}.*)*)", 1)
    return F.when(text.rlike(rf"(?m)^ {{{indent}}}{keyword}\b"), F.regexp_replace(found, r"\n {12}", "\n"))


def _one_line(c: Column) -> Column:
    return squeeze(F.coalesce(c, F.lit("")))


def parse_records(records: DataFrame) -> DataFrame:
    """The nested record: header fields, source qualifiers, references, comment and structured comment.

    A record without a LOCUS line has ``parse_error`` and empty fields. Qualifiers that occur more than once are joined
    with ``; ``; only the first source feature counts; a taxon reference becomes ``taxon_id``.
    """
    t = F.concat(F.col("text"), F.lit("\n"))
    r = records.withColumn("_locus", F.regexp_extract(t, r"(?m)^LOCUS\s+(.*)", 1))
    locus = F.split(F.trim(F.col("_locus")), r"\s+")
    kind = F.regexp_extract("_locus", r"\d+\s+(?:bp|aa)\s+(\S+)", 1)
    seq = F.regexp_extract(t, r"(?s)\nORIGIN[^\n]*\n(.*)", 1)
    source = F.regexp_extract(t, r"(?m)^ {5}source {2,}\S+((?:\n {21}.*)*)", 1)
    quals = F.regexp_extract_all(F.col("_source"), F.lit(r'(?s)\n {21}(/[^\s=/]+(?:="(?:[^"]|"")*"|=[^\n"]*)?)'), 1)
    name = lambda q: F.regexp_extract(q, r"^/([^=]+)", 1)
    bare = lambda q: F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace(q, r"^/[^=]+=", "")), '^"|"$', ""), r"\n {21}", " ")
    value = lambda q: F.when(q.contains("="), squeeze(F.replace(bare(q), F.lit('""'), F.lit('"')))).otherwise("")
    r = r.withColumn("_source", source).withColumn("_q", F.transform(quals, lambda q: F.struct(name(q).alias("k"), value(q).alias("v"))))
    names = F.array_distinct(F.transform("_q", lambda q: q["k"]))
    joined = F.transform(F.filter(names, lambda k: k != "db_xref"), lambda k: F.struct(k.alias("key"), F.array_join(F.transform(F.filter("_q", lambda q: q["k"] == k), lambda q: q["v"]), "; ").alias("value")))
    taxa = F.filter("_q", lambda q: (q["k"] == "db_xref") & q["v"].startswith("taxon:"))
    refs = F.regexp_extract_all(t, F.lit(r"(?m)^REFERENCE.*((?:\n {2,}.*)*)"), 1)
    ref = lambda x, k: _one_line(F.regexp_replace(F.regexp_extract(x, rf"\n {{2,3}}{k} +(.*(?:\n {{12}}.*)*)", 1), r"\n {12}", " "))
    organism = F.regexp_extract(t, r"(?m)^ {2}ORGANISM +(.*)((?:\n {12}.*)*)", 1)
    lineage = F.regexp_extract(t, r"(?m)^ {2}ORGANISM +(.*)((?:\n {12}.*)*)", 2)
    listed = lambda c: F.filter(F.transform(F.split(F.regexp_replace(_one_line(c), r"\.$", ""), ";"), lambda x: F.trim(x)), lambda x: x != "")
    comment = _section(t, "COMMENT")
    blocks = F.regexp_extract_all(F.coalesce(comment, F.lit("")), F.lit(r"(?s)##([^#\n]+)-START##(.*?)##[^#\n]+-END##"), 0)
    pairs = lambda b: F.transform(F.regexp_extract_all(b, F.lit(r"(?m)^([^\n:#]+?)\s*::\s*(.*(?:\n(?!.*::|##).*)*)"), 0), lambda p: F.struct(F.trim(F.substring_index(p, "::", 1)).alias("key"), squeeze(F.regexp_replace(p, r"(?s)^.*?::", "")).alias("value")))
    unique = lambda a: F.map_from_entries(F.filter(a, lambda x, i: ~F.exists(F.slice(a, F.lit(1), i), lambda y: y["key"] == x["key"])))
    block_name = lambda b: F.regexp_extract(b, r"##([^#\n]+)-START##", 1)
    structured = F.transform(blocks, lambda b: F.struct(block_name(b).alias("key"), unique(pairs(b)).alias("value")))
    first_accession = F.split(_one_line(_section(t, "ACCESSION")), " ")[0]
    version = _one_line(_section(t, "VERSION"))
    locus_id = F.coalesce(F.nullif(F.split(version, " ")[0], F.lit("")), F.nullif(first_accession, F.lit("")), locus[0])
    stated = F.regexp_extract("_locus", r"(\d+)\s+(?:bp|aa)", 1).try_cast("int")
    letters = F.length(F.regexp_replace(seq, r"[^A-Za-z]", ""))
    topology = F.lower(F.regexp_extract("_locus", r"\b(linear|circular)\b", 1))
    definition = F.regexp_replace(_one_line(_section(t, "DEFINITION")), r"\.$", "")
    entries = F.filter(F.transform(F.split(F.regexp_replace(_one_line(_section(t, "KEYWORDS")), r"\.$", ""), ";"), lambda x: F.trim(x)), lambda x: x != "")
    return r.select(
        "file_path",
        "at",
        F.when(F.col("_locus") == "", F.lit("no LOCUS line")).alias("parse_error"),
        locus_id.alias("locus_id"),
        F.coalesce(F.nullif(first_accession, F.lit("")), locus_id).alias("accession"),
        F.regexp_extract(version, r"\.(\d+)", 1).alias("version"),
        F.when(letters > 0, letters).otherwise(stated).alias("length"),
        python_title(kind).alias("molecule_type"),
        F.concat(F.upper(F.substring(topology, 1, 1)), F.substring(topology, 2, 20)).alias("topology"),
        F.regexp_extract("_locus", r"\b([A-Z]{3})\s+\d{2}-[A-Z]{3}-\d{4}", 1).alias("division"),
        F.regexp_extract("_locus", r"(\d{2}-[A-Z]{3}-\d{4})", 1).alias("date"),
        definition.alias("definition"),
        entries.alias("keywords"),
        _one_line(organism).alias("header_organism"),
        listed(lineage).alias("taxonomy"),
        F.get(F.transform(taxa, lambda q: F.substring_index(F.substring_index(q["v"], ":", 2), ":", -1)), F.lit(0)).alias("taxon_id"),
        F.map_from_entries(joined).alias("source"),
        F.transform(refs, lambda x: F.struct(ref(x, "AUTHORS").alias("authors"), ref(x, "TITLE").alias("title"), ref(x, "JOURNAL").alias("journal"), ref(x, "PUBMED").alias("pubmed"), ref(x, "REMARK").alias("remark"))).alias("refs"),
        F.coalesce(comment, F.lit("")).alias("comment"),
        unique(structured).alias("structured_comment"),
    )


def _flexible(text: Column, field: str) -> Column:
    """A field's value from free comment text: after one or two colons to the line's end."""
    # Fixed value: the shape in which comments state a field.
    pattern = r"(?i)" + field.replace(" ", r"\s+") + r"\s*::?\s*(.*?)(?:\n|$)"
    return F.nullif(F.trim(F.regexp_replace(F.trim(F.regexp_extract(text, pattern, 1)), ";+$", "")), F.lit(""))


def assemblies(parsed: DataFrame) -> DataFrame:
    """(ACCESSION, the five assembly fields, assembly_source) of records that tell one, by the first way that finds any.

    A structured comment is looked at first, then the comment's text, then a raw block within it.
    """
    rows = parsed.select(F.col("accession").alias("ACCESSION"), "comment", "structured_comment")
    rows = computed(rows, {"_sc": F.coalesce(*[F.try_element_at("structured_comment", F.lit(k)) for k in ASSEMBLY_KEYS]), "_block": F.regexp_extract("comment", r"(?s)##Assembly-Data-START##(.*?)##Assembly-Data-END##", 1)})
    variants = lambda f: dict.fromkeys((f, f.replace(" ", "_"), *([f.replace(" ", "")] if f != "Expected Final Version" else [])))
    told = lambda f: F.nullif(squeeze(F.coalesce(*[F.try_element_at("_sc", F.lit(v)) for v in variants(f)])), F.lit(""))
    ways = {"structured_comment": told, "comment_text": lambda f: _flexible(F.col("comment"), f), "regex_block": lambda f: _flexible(F.col("_block"), f)}
    rows = computed(rows, {f"_{name}": F.struct(*[way(f).alias(f) for f in ASSEMBLY_FIELDS], F.lit(name).alias("assembly_source")) for name, way in ways.items()})
    any_of = lambda name: F.coalesce(*[F.col(f"_{name}")[f] for f in ASSEMBLY_FIELDS]).isNotNull()
    rows = computed(rows, {"_a": F.coalesce(*[F.when(any_of(name), F.col(f"_{name}")) for name in ways])})
    return rows.where("_a is not null").select("ACCESSION", *[F.coalesce(F.col("_a")[f], F.lit("")).alias(f) for f in ASSEMBLY_FIELDS], F.col("_a.assembly_source").alias("assembly_source"))


def discovered_columns(parsed: DataFrame) -> list[str]:
    """Columns of the flat view beyond the base ones: source qualifiers and reference slots, sorted."""
    keys = [r[0] for r in fixed_rows(parsed.select(F.explode(F.map_keys("source"))).distinct(), "kinds of qualifiers", 10_000)]
    slots = parsed.agg(F.max(F.size("refs"))).first()[0] or 0
    refs = [f"Ref{i}{s}" for i in range(1, slots + 1) for s in ("Authors", "Title", "Journal", "PubMed", "Remark")]
    return sorted(k for k in {*keys, *refs} if k not in BASE_COLUMNS)


def flat_view(parsed: DataFrame, taxonomy: DataFrame | None = None, extra: list[str] | None = None) -> DataFrame:
    """The table of all strings: base columns, then ``extra`` (by default those that are found in the data); nothing is ''.

    ``taxonomy`` (taxonid, class_name, order_name, family_name, genus_name) gives the four ranks by the taxon's id.
    """
    extra = discovered_columns(parsed) if extra is None else extra
    ranks = {"Class": "class_name", "Order": "order_name", "Family": "family_name", "Genus": "genus_name"}
    df = parsed
    if taxonomy is not None:
        df = df.join(taxonomy.select(F.col("taxonid").alias("taxon_id"), *ranks.values()).dropDuplicates(["taxon_id"]), "taxon_id", "left")
    fixed = {
        "LocusID": F.col("locus_id"), "ACCESSION": F.col("accession"), "Version": F.col("version"), "Length": F.concat(F.col("length").cast("string"), F.lit(" bp")), "MoleculeType": F.col("molecule_type"), "Topology": F.col("topology"), "Division": F.col("division"), "Date": F.col("date"),
        "Definition": F.col("definition"), "Keywords": F.array_join("keywords", "; "), "HeaderOrganism": F.col("header_organism"), "Taxonomy": F.array_join("taxonomy", "; "), "TaxonID": F.col("taxon_id"), "db_xref": F.lit(""),
        **{k: F.col(v) if taxonomy is not None else F.lit("") for k, v in ranks.items()},
    }
    slot = {"Authors": "authors", "Title": "title", "Journal": "journal", "PubMed": "pubmed", "Remark": "remark"}

    def column(name: str) -> Column:
        if name in fixed:
            return fixed[name]
        for suffix, part in slot.items():
            if name.startswith("Ref") and name.endswith(suffix) and name[3 : -len(suffix)].isdigit():
                return F.get(F.col("refs"), F.lit(int(name[3 : -len(suffix)]) - 1))[part]
        return F.try_element_at("source", F.lit(name))

    return df.select("file_path", "at", *[F.coalesce(column(c), F.lit("")).alias(c) for c in (*BASE_COLUMNS, *extra)])


def with_assembly(metadata: DataFrame, assembly: DataFrame, key: str = "ACCESSION") -> DataFrame:
    """Metadata with the assembly of its accession, if any; accessions are trimmed, repeated assemblies repeat rows."""
    right = assembly.withColumn("_acc", F.trim(key)).drop(key).where("_acc is not null")
    return metadata.withColumn("_acc", spread_null(metadata, F.trim(key))).join(right, "_acc", "left").drop("_acc")


def file_report(spark: SparkSession, path: str | list[str], parsed: DataFrame) -> DataFrame:
    """Per file: size, records, failed records, status (empty, invalid, failed, partial, success) and what is wrong.

    A file is invalid if it has no record or its first one does not begin with a LOCUS line.
    """
    counts = parsed.groupBy("file_path").agg(F.count(F.lit(1)).alias("records"), F.count_if(F.col("parse_error").isNotNull()).alias("failed"), F.min_by(F.col("parse_error").isNull(), F.col("at")).alias("_head"))
    files = flat_files(spark, path).join(counts, "file_path", "left")
    n, bad, head = F.coalesce("records", F.lit(0)), F.coalesce("failed", F.lit(0)), F.coalesce("_head", F.lit(False))
    status = F.when(F.col("length") == 0, "empty").when(n == 0, "invalid").when(bad == n, "failed").when(~head, "invalid").when(bad > 0, "partial").otherwise("success")
    wrong = F.when(F.col("length") == 0, "empty file").when(n == 0, "no content").when(~head, "does not start with LOCUS").otherwise("")
    return files.select("file_path", "length", n.alias("records"), bad.alias("failed"), status.alias("status"), wrong.alias("error"))


def run_summary(report: DataFrame) -> DataFrame:
    """Totals over all files by status."""
    return report.groupBy("status").agg(F.count(F.lit(1)).alias("files"), F.sum("records").alias("records"), F.sum("failed").alias("failed"))


def run_totals(report: DataFrame, assembly: DataFrame, seconds: float) -> DataFrame:
    """One row for a run: files by status, records read and failed, assemblies by the way they were found, and rates."""
    of = lambda s: F.count_if(F.col("status") == s)
    files = report.agg(F.count(F.lit(1)).alias("files"), *[of(s).alias(s) for s in ("success", "partial", "failed", "invalid", "empty")], F.coalesce(F.sum("records"), F.lit(0)).alias("records"), F.coalesce(F.sum("failed"), F.lit(0)).alias("failed_records"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))
    ways = assembly.agg(F.count(F.lit(1)).alias("assemblies"), *[F.count_if(F.col("assembly_source") == w).alias(f"by_{w}") for w in ("structured_comment", "comment_text", "regex_block")])
    rate = F.lit(1.0 / max(seconds, 1e-9))
    both = files.join(ways)  # a row each
    return both.select("*", F.lit(float(seconds)).alias("seconds"), F.round(F.col("records") * rate, 1).alias("records_per_second"), F.round(F.col("bytes") * rate, 1).alias("bytes_per_second"), F.round(F.col("assemblies") * 100.0 / F.greatest("records", F.lit(1)), 1).alias("assembly_percent"))


def numbered(parsed: DataFrame) -> DataFrame:
    """Records with ``record_index``, their place in their file from 1.

    Places within a part of a file follow from its first; what is before a part is summed over the few parts of a file.
    """
    block, one = F.col("at._block"), F.col("at._id")
    parts = parsed.groupBy("file_path", block.alias("_b")).agg(F.min(one).alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("file_path").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("file_path", "_b", "_first", before.alias("_before"))
    return parsed.withColumn("_b", block).join(parts, ["file_path", "_b"]).withColumn("record_index", F.col("_before") + one - F.col("_first") + 1).drop("_b", "_first", "_before")


def record_errors(parsed: DataFrame) -> DataFrame:
    """(file_name, record_index, accession, error_type, error_message, phase) of the records that could not be read."""
    bad = numbered(parsed).where("parse_error is not null")
    return bad.select(F.substring_index("file_path", "/", -1).alias("file_name"), "record_index", F.coalesce("accession", F.lit("")).alias("accession"), F.lit("ParseError").alias("error_type"), F.col("parse_error").alias("error_message"), F.lit("parse").alias("phase"))


def record_tracking(parsed: DataFrame) -> DataFrame:
    """(file_name, record_index, accession, metadata_ok, assembly_ok, assembly_source, has_assembly_data, error_message) of all records."""
    one = assemblies(parsed).groupBy(F.col("ACCESSION").alias("_acc")).agg(F.min("assembly_source").alias("assembly_source"))
    j = numbered(parsed).join(one, F.col("accession") == F.col("_acc"), "left")
    ok = F.col("parse_error").isNull()
    return j.select(F.substring_index("file_path", "/", -1).alias("file_name"), "record_index", "accession", ok.alias("metadata_ok"), ok.alias("assembly_ok"), F.coalesce("assembly_source", F.lit("")).alias("assembly_source"), F.col("assembly_source").isNotNull().alias("has_assembly_data"), F.coalesce("parse_error", F.lit("")).alias("error_message"))


def archive_failed(report: DataFrame, folder: str) -> int:
    """Copies the files that failed or are invalid or empty to ``folder``; of equal names the later get ``_1``, ``_2``.

    Gives how many were copied. Files are taken one by one from the report, so their number is not bounded by memory.
    """
    spark = report.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    home = path(folder)
    fs, copied = home.getFileSystem(conf), 0
    for r in report.where(F.col("status").isin("failed", "invalid", "empty")).select("file_path").orderBy("file_path").toLocalIterator():
        source = path(r.file_path)
        stem, dot, end = source.getName().rpartition(".")
        to, k = path(home, source.getName()), 0
        while fs.exists(to):
            k += 1
            to = path(home, f"{stem}_{k}{dot}{end}")
        if jvm.org.apache.hadoop.fs.FileUtil.copy(source.getFileSystem(conf), source, fs, to, False, conf):
            copied += 1
    return copied


def write_flat(records: DataFrame, path: str) -> None:
    """Rows with ``locusid``, ``definition`` and the usual columns as flat files; what ``read_records`` reads back.

    The first reference is written where its columns are there, and an assembly where its fields are: as a structured
    comment, or as plain text where ``as_text`` is true.
    """
    v = lambda c: F.coalesce(F.col(f"`{c}`"), F.lit("")) if c in records.columns else F.lit("")
    given = lambda c, text: F.when(v(c) != "", text).otherwise("")
    qualifier = lambda c: given(c, F.concat(F.lit(f"\n                     /{c}=\""), F.replace(v(c), F.lit('"'), F.lit('""')), F.lit('"')))
    part = lambda c, k: given(c, F.concat(F.lit(f"\n  {k:<10}"), v(c)))
    reference = F.concat(*[part(f"ref1{c}", c.upper()) for c in ("authors", "title", "journal")])
    line = lambda f, sign: given(f, F.concat(F.lit(f"\n            {f}{sign} "), v(f)))
    block = F.concat(*[line(f, " ::") for f in ASSEMBLY_FIELDS])
    plain = F.concat(*[line(f, ":") for f in ASSEMBLY_FIELDS])
    structured = F.concat(F.lit("\nCOMMENT     ##Assembly-Data-START##"), block, F.lit("\n            ##Assembly-Data-END##"))
    comment = F.when(block == "", F.lit("")).when(F.coalesce(F.col("as_text"), F.lit(False)) if "as_text" in records.columns else F.lit(False), F.concat(F.lit("\nCOMMENT     Notes on the assembly."), plain)).otherwise(structured)
    text = F.concat(
        F.rpad(F.concat(F.lit("LOCUS       "), v("accession")), 28, " "), F.lit(" "), v("n").cast("string"), F.lit(" bp    DNA     linear   INV "), v("record_date"),
        F.lit("\nDEFINITION  "), v("definition"), F.lit(".\nACCESSION   "), v("accession"), F.lit("\nVERSION     "), v("locusid"), F.lit("\nKEYWORDS    .\nSOURCE      "), v("organism"), F.lit("\n  ORGANISM  "), v("organism"), F.lit("\n            Animalia; Vermes."),
        F.when(reference != "", F.concat(F.lit("\nREFERENCE   1"), reference)).otherwise(""), comment, F.lit("\nFEATURES             Location/Qualifiers\n     source          1.."), v("n").cast("string"),
        *[qualifier(c) for c in ("organism", "mol_type", "organelle", "isolate", "specimen_voucher", "country", "collected_by")],
        F.when(v("taxonid") != "", F.concat(F.lit('\n                     /db_xref="taxon:'), v("taxonid"), F.lit('"'))).otherwise(""), F.lit("\n//"),
    )
    records.select(text.alias("value")).write.mode("overwrite").option("lineSep", "\n").text(path)
