"""Readers: JSON lines, JSON, directories of file pairs, and test reports; and writers of splits and reports."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import diff
from ..functions.text import split_lines
from . import jsonlines

CANONICAL = ("bug_id", "buggy_code", "fixed_code", "suspicious_start", "suspicious_end", "file_path", "project")


@dataclass(frozen=True)
class FieldMap:
    """Names under which corpora keep a field, tried in this order; a dotted name is a path."""

    bug_id: tuple[str, ...] = ("bug_id", "id", "identifier", "name")
    buggy_code: tuple[str, ...] = ("buggy_code", "buggy", "before", "input")
    fixed_code: tuple[str, ...] = ("fixed_code", "fixed", "after", "output")
    suspicious_start: tuple[str, ...] = ("suspicious_start", "start_line", "start")
    suspicious_end: tuple[str, ...] = ("suspicious_end", "end_line", "end")
    file_path: tuple[str, ...] = ("file_path", "path", "file")
    project: tuple[str, ...] = ("project", "repo", "repository")
    metadata: tuple[str, ...] = ("metadata", "meta")
    rest_as_metadata: bool = True

    def consumed(self) -> list[str]:
        return sorted({c.split(".", 1)[0] for n in (*CANONICAL, "metadata") for c in getattr(self, n)})


def lookup(record: Column, candidates: tuple[str, ...]) -> Column:
    """The first candidate's value that isn't null, as text; ``record`` is a VARIANT."""
    return F.coalesce(*[F.try_variant_get(record, "$" + "".join(f"['{p}']" for p in c.split(".")), "string") for c in candidates])


def line_number(text: Column) -> tuple[Column, Column]:
    """(number, is wrong): an integer or an integer-looking text; one of more than 32 bits is wrong."""
    fits = text.rlike(r"\A\s*-?[0-9]+\s*\z")
    number = F.when(fits, F.trim(text).try_cast("int"))
    return number, text.isNotNull() & number.isNull()


def mapped(records: DataFrame, fields: FieldMap = FieldMap(), infer_region: bool = True, record: str = "record") -> DataFrame:
    """Canonical pairs from VARIANT records, with ``error`` saying what is wrong with a record, or null."""
    values = {n: lookup(F.col(record), getattr(fields, n)) for n in CANONICAL}
    start, bad_start = line_number(values["suspicious_start"])
    end, bad_end = line_number(values["suspicious_end"])
    whole = F.from_json(F.to_json(record), "map<string,string>")
    rest = F.map_filter(whole, lambda k, _: ~k.isin(*fields.consumed())) if fields.rest_as_metadata else F.create_map().cast("map<string,string>")
    given = F.from_json(lookup(F.col(record), fields.metadata), "map<string,string>")
    out = records.select(
        "*",
        *[values[n].alias(n) for n in ("bug_id", "buggy_code", "fixed_code", "file_path", "project")],
        start.alias("suspicious_start"),
        end.alias("suspicious_end"),
        F.when(given.isNotNull(), F.map_concat(given, F.map_filter(rest, lambda k, _: ~F.array_contains(F.map_keys(given), k)))).otherwise(rest).alias("metadata"),
        (bad_start | bad_end).alias("_bad"),
    )
    missing = F.concat_ws(", ", *[F.when(F.col(n).isNull(), n) for n in ("bug_id", "buggy_code", "fixed_code")])
    error = (
        F.when(F.schema_of_variant(record).rlike("^OBJECT") == F.lit(False), "not an object")
        .when(missing != "", F.concat(F.lit("missing "), missing))
        .when(F.col("bug_id") == "", "empty bug_id")
        .when(F.col("_bad"), "line number is not an integer")
        .when(F.col("suspicious_start").isNull() != F.col("suspicious_end").isNull(), "half a region")
    )
    out = out.withColumn("error", error).drop("_bad", record)
    if infer_region:
        differs = F.col("error").isNull() & F.col("suspicious_start").isNull() & (F.col("buggy_code") != F.col("fixed_code"))
        ops = diff.opcodes(F.when(differs, split_lines(F.col("buggy_code"))), F.when(differs, split_lines(F.col("fixed_code"))))
        out = out.withColumn("_span", diff.changed_span(ops)).withColumns(
            {
                "error": F.coalesce("error", F.when(differs & F.col("_span").isNull(), "lines do not differ")),
                "suspicious_start": F.coalesce("suspicious_start", "_span.start"),
                "suspicious_end": F.coalesce("suspicious_end", "_span.end"),
            }
        ).drop("_span")
    return out


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(ord, record): an object of each line that isn't blank; a line that isn't JSON stops the read, named by file and line.

    ``ord`` keeps the order of files and lines.
    """
    jsonlines.register(spark)
    lines = spark.read.format(jsonlines.NAME).load(path)
    # what Python takes for JSON and Spark doesn't, such as NaN
    wrong = F.raise_error(F.concat(F.lit("not a JSON object in "), F.col("file"), F.lit(": "), F.substring("record", 1, 80))).cast("variant")
    return lines.select("ord", F.coalesce(F.try_parse_json("record"), wrong).alias("record"))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """(ord, record) of a JSON array, or of the values of an object; a file is one row, so it suits small corpora."""
    whole = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    whole.createOrReplaceTempView("_fixcorpus_json")
    return spark.sql("SELECT cast(e.pos AS bigint) AS ord, e.value AS record FROM _fixcorpus_json, LATERAL variant_explode(v) e")


@dataclass(frozen=True)
class Layout:
    """Names of the files of a pair; a ``*`` in the fixed name stands for the buggy file's stem."""

    buggy: str = "buggy.java"
    fixed: str = "fixed.java"
    metadata: str = "metadata.json"
    bug_id: str = "parent"
    project: str | None = None

    def __post_init__(self):
        if self.bug_id not in ("parent", "relative_path", "stem"):
            raise ValueError(f"unknown source of ids {self.bug_id!r}")


def read_directory(spark: SparkSession, root: str, layout: Layout = Layout()) -> DataFrame:
    """Pairs of files below ``root``, buggy ones without a counterpart left out; metadata files override what paths say."""
    def files(name: str) -> DataFrame:
        rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", name).text(root, wholetext=True)
        full = F.regexp_replace(F.col("_metadata.file_path"), "^file:/*", "/")
        relative = F.regexp_replace(full, F.lit("^.*?" + root.rstrip("/").lstrip("./") + "/"), F.lit(""))
        return rows.select(relative.alias("path"), F.col("value").alias("text"))

    stem = F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?$", 1)
    folder = F.regexp_replace("path", r"[^/]*$", "")
    buggy = files(layout.buggy).select("path", F.col("text").alias("buggy_code"), folder.alias("folder"), F.concat(folder, F.replace(F.lit(layout.fixed), F.lit("*"), stem)).alias("_fixed"), stem.alias("_stem"))
    pairs = buggy.join(files(layout.fixed).select(F.col("path").alias("_fixed"), F.col("text").alias("fixed_code")), "_fixed")
    meta = files(layout.metadata).select(folder.alias("folder"), F.from_json("text", "map<string,string>").alias("metadata"))
    parent = F.regexp_extract("folder", r"([^/]+)/$", 1)
    ids = {"parent": F.when(parent != "", parent).otherwise(F.col("_stem")), "relative_path": F.col("path"), "stem": F.col("_stem")}
    project = F.lit(None).cast("string")
    if layout.project:
        import re

        found = F.regexp_extract("path", layout.project, 1 if re.compile(layout.project).groups else 0)
        project = F.when(F.col("path").rlike(layout.project), found)
    said = lambda key: F.try_element_at("metadata", F.lit(key))
    out = pairs.join(meta, "folder", "left")
    return out.select(
        F.coalesce(said("bug_id"), ids[layout.bug_id]).alias("bug_id"),
        "buggy_code",
        "fixed_code",
        F.coalesce(said("file_path"), F.col("path")).alias("file_path"),
        F.coalesce(said("project"), project).alias("project"),
        "metadata",
        F.col("path").alias("ord"),
    )


_READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {"jsonl": read_jsonl, "json": read_json}


def register_reader(name: str, reader: Callable[[SparkSession, str], DataFrame]) -> None:
    """A reader of (ord, record VARIANT) under a name."""
    _READERS[name] = reader


def available_formats() -> list[str]:
    return sorted([*_READERS, "directory"])


def read_pairs(spark: SparkSession, path: str, kind: str = "jsonl", fields: FieldMap = FieldMap(), skip_invalid: bool = False, limit: int | None = None, layout: Layout = Layout()) -> DataFrame:
    """Pairs of a corpus; the first wrong record stops the read unless wrong ones are skipped; ``limit`` counts pairs.

    A missing path is an error, as is a file where a directory of pairs is asked for.
    """
    if kind not in available_formats():
        raise ValueError(f"unknown format {kind!r}; known: {', '.join(available_formats())}")
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(at):
        raise FileNotFoundError(f"no such file or folder: {path}")
    if kind == "directory" and not store.getFileStatus(at).isDirectory():
        raise NotADirectoryError(f"not a folder: {path}")
    if kind == "directory":
        pairs = read_directory(spark, path, layout)
    else:
        pairs = mapped(_READERS[kind](spark, path), fields)
        if skip_invalid:
            pairs = pairs.where("error IS NULL").drop("error")
        else:
            fine = F.when(F.col("error").isNull(), F.col("bug_id")).otherwise(F.raise_error(F.concat(F.lit("bad record: "), F.col("error"))).cast("string"))
            pairs = pairs.withColumn("bug_id", fine).drop("error")
    return pairs.orderBy("ord").limit(limit) if limit is not None else pairs


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """(test_id, outcome, message) of JUnit reports: error before failure before skipped before passed."""
    cell = "struct<_message:string,_VALUE:string>"
    schema = f"_classname string, _name string, error {cell}, failure {cell}, skipped {cell}"
    rows = spark.read.format("xml").option("rowTag", "testcase").option("mode", "PERMISSIVE").schema(schema).load(path)
    name = F.when(F.coalesce("_classname", F.lit("")) != "", F.concat(F.col("_classname"), F.lit("::"), F.coalesce("_name", F.lit("")))).otherwise(F.coalesce("_name", F.lit("")))
    outcome = F.when(F.col("error").isNotNull(), "error").when(F.col("failure").isNotNull(), "failed").when(F.col("skipped").isNotNull(), "skipped").otherwise("passed")
    return rows.select(name.alias("test_id"), outcome.alias("outcome"), F.coalesce("error._message", "failure._message").alias("message"))


def write_splits(records: DataFrame, folder: str, minimal: bool = False) -> dict[str, int]:
    """JSON lines of each split in a folder of its name, written even if empty; returns the counts."""
    columns = ["input", "output"] + ([] if minimal else [c for c in records.columns if c not in ("input", "output", "ord", "split")])
    counts = {}
    for split in ("train", "validation", "test"):
        part = records.where(F.col("split") == split).select(*columns)
        part.write.mode("overwrite").option("ignoreNullFields", "true").json(f"{folder}/{split}")
        counts[split] = records.sparkSession.read.text(f"{folder}/{split}").count()
    return counts


def count_lines(spark: SparkSession, path: str) -> int:
    """Lines that aren't blank."""
    return spark.read.text(path).where(F.trim("value") != "").count()


def write_build(built: DataFrame, folder: str, report: Report, minimal: bool = False) -> dict[str, int]:
    """Everything a build gives: the splits, the rejected pairs if there are any, and the report as JSON and text.

    Each is a folder of part files. Returns the counts by name.
    """
    spark = built.sparkSession
    kept = built.where("reason IS NULL").drop("stage", "reason", "detail")
    counts = write_splits(kept, folder, minimal)
    rejected = built.where("reason IS NOT NULL").select("bug_id", "stage", "reason", "detail")
    if not rejected.isEmpty():
        rejected.write.mode("overwrite").option("ignoreNullFields", "true").json(f"{folder}/rejected")
        counts["rejected"] = count_lines(spark, f"{folder}/rejected")
    whole = {"stages": report.stages, "reasons": report.reasons, "splits": report.splits, "lengths": report.lengths}
    for name, said in (("report.json", report_json(whole)), ("report.txt", report.text())):
        spark.createDataFrame([(said,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/{name}")
    return counts


def load_split(spark: SparkSession, folder: str, split: str, required: bool = True) -> DataFrame | None:
    """(input, output, ...) of one split that a build wrote.

    A row without input or output stops the read, as does an empty split that is required. A missing split is None, or
    an error if it is required.
    """
    if split not in ("train", "validation", "test"):
        raise ValueError(f"unknown split {split!r}")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{split}")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        if required:
            raise FileNotFoundError(f"no {split} split in {folder}")
        return None
    rows = spark.read.json(f"{folder}/{split}")
    if rows.isEmpty():
        if required:
            raise ValueError(f"the {split} split in {folder} is empty")
        return spark.createDataFrame([], "input string, output string")
    for name in ("input", "output"):
        own = F.col(name) if name in rows.columns else F.lit(None).cast("string")
        rows = rows.withColumn(name, F.coalesce(own, F.raise_error(F.lit(f"a row of the {split} split has no {name}")).cast("string")))
    return rows


def report_json(report: dict) -> str:
    return json.dumps(report, indent=2, default=str, ensure_ascii=False)


@dataclass
class Report:
    """Small results of a build, ready to print."""

    stages: list[dict] = field(default_factory=list)
    reasons: dict[str, int] = field(default_factory=dict)
    splits: dict[str, int] = field(default_factory=dict)
    lengths: dict[str, dict] = field(default_factory=dict)
    empty: list[str] = field(default_factory=list)

    def text(self) -> str:
        lines = [f"{s['stage']:<12} {s['received']:>8} {s['kept']:>8} {s['removed']:>8}" for s in self.stages]
        lines += [f"  {r:<24} {n:>6}" for r, n in sorted(self.reasons.items(), key=lambda x: (-x[1], x[0]))]
        lines += [f"{s:<12} {n:>8}" for s, n in self.splits.items()]
        lines += [f"{s:<12} no records, though it has a share" for s in self.empty]
        return "\n".join(lines)
