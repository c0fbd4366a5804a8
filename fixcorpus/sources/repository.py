"""Tables of a repository: source files, issues, historical bugs, requirements, staged names, dated folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import py_strip

# Extensions of source files, and folders that are left out.
EXTENSIONS = ("py", "java", "js", "jsx", "ts", "tsx", "go", "rs", "c", "h", "cpp", "cc", "cxx", "hpp", "cs", "rb", "php", "kt", "kts", "swift", "scala", "dart", "r", "sh", "bash", "sql")
IGNORED_FOLDERS = (".git", ".idea", ".vscode", "__pycache__", ".pytest_cache", ".mypy_cache", ".tox", "node_modules", "target", "build", "dist", "venv", ".venv", "env", ".env")
# Requirements that install the repository itself, as wholes and as beginnings.
SELF, SELF_START = (".", "-e .", "-e.", "--editable ."), ("-e file:.", "-e ./", "./", "file:.")
# Options that name another file.
REFERRING = ("-r ", "-c ", "--requirement ", "--constraint ")
# What may stand between public and the kind of a Java type, and the kinds.
MODIFIERS, KINDS = ("final", "abstract", "sealed", "strictfp"), ("class", "interface", "enum", "record")


def is_source(path: Column) -> Column:
    """A path relative to the root with a known extension and no ignored part."""
    folders = F.array(*map(F.lit, IGNORED_FOLDERS))
    kind = F.lower(F.regexp_extract(path, r"[^/.][^/]*\.([^./]+)$", 1))
    return kind.isin(*EXTENSIONS) & ~F.arrays_overlap(F.split(path, "/"), folders)


def source_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, text) of source files below ``root``; the path is relative to it. Order by path for a sorted list."""
    rows = spark.read.option("recursiveFileLookup", "true").text(root, wholetext=True)
    full = F.regexp_replace(F.col("_metadata.file_path"), "^file:/*", "/")
    path = F.regexp_replace(full, F.lit("^.*?" + root.rstrip("/").lstrip("./") + "/"), F.lit(""))
    return rows.select(path.alias("path"), F.col("value").alias("text")).where(is_source(F.col("path")))


def issue_text(title: Column, body: Column) -> Column:
    """Title and body as one text; nulls are empty."""
    return py_strip(F.concat(F.coalesce(title, F.lit("")), F.lit("\n\n"), F.coalesce(body, F.lit(""))))


def open_issues(payload: Column) -> Column:
    """Issues (number, title, body, state, url, labels, comments) in a JSON array as an issue service gives it; pull requests are left out."""
    item = "struct<number:bigint,title:string,body:string,state:string,html_url:string,labels:array<struct<name:string>>,comments:bigint>"
    raw = F.transform(F.from_json(payload, "array<string>"), lambda x: F.struct(x.alias("raw"), F.from_json(x, item).alias("i")))
    # a key of that name counts even if its value is null
    issues = F.filter(raw, lambda x: ~F.array_contains(F.json_object_keys(x["raw"]), "pull_request"))
    text = lambda c: F.coalesce(c, F.lit(""))
    made = lambda x: F.struct(
        x["i"]["number"].alias("number"), text(x["i"]["title"]).alias("title"), text(x["i"]["body"]).alias("body"), text(x["i"]["state"]).alias("state"), text(x["i"]["html_url"]).alias("url"),
        F.transform(F.coalesce(x["i"]["labels"], F.array().cast("array<struct<name:string>>")), lambda n: text(n["name"])).alias("labels"), F.coalesce(x["i"]["comments"], F.lit(0)).alias("comments"),
    )
    return F.transform(issues, made)


def load_bugs(spark: SparkSession, path: str) -> DataFrame:
    """(issue, fix, type) of a JSON array of historical bugs; no rows where the file is missing."""
    schema = "issue string, fix string, type string"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def requirements(text: Column, folder: Column) -> Column:
    """Groups of installer arguments in a requirements file: arrays of one specification, or of an option and the file it names.

    Comments, the repository itself and other options are left out; equal groups count once.
    """
    cut = F.transform(F.split(text, r"\r\n|\r|\n"), lambda x: py_strip(F.substring_index(x, " #", 1)))
    starts = lambda x, words: F.array_contains(F.transform(F.array(*map(F.lit, words)), lambda w: x.startswith(w)), True)
    refers = lambda x: starts(x, REFERRING)
    kept = F.filter(cut, lambda x: (x != "") & ~x.startswith("#") & ~x.isin(*SELF) & ~starts(x, SELF_START) & (refers(x) | ~x.startswith("-")))
    option = lambda x: F.array(F.substring_index(x, " ", 1), F.concat(folder, F.lit("/"), py_strip(x.substr(F.instr(x, " ") + 1, F.length(x)))))
    return F.array_distinct(F.transform(kept, lambda x: F.when(refers(x), option(x)).otherwise(F.array(x))))


def content_key(version: Column, files: Column) -> Column:
    """Twelve hexadecimal digits of the SHA-256 of a version, and the names and bytes of ``files`` (name, content) in order."""
    bytes_ = F.aggregate(files, F.encode(version, "utf-8"), lambda a, f: F.concat(a, F.encode(f["name"], "utf-8"), f["content"]))
    return F.substring(F.sha2(bytes_, 256), 1, 12)


def _words(text: Column) -> Column:
    """(word, opens): the words of a text in order, and whether each is the first of its line."""
    lines = F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n")
    in_line = lambda x: F.transform(F.filter(F.split(x, r"\s+"), lambda w: w != ""), lambda w, i: F.struct(w.alias("word"), (i == 0).alias("opens")))
    return F.flatten(F.transform(lines, in_line))


def _read(text: Column, step) -> Column:
    """A name read word by word: ``step(state, word)`` gives (at, name); a state at -1 has it. Empty if no word gets there."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("name"))
    state = lambda at, name: F.struct(at.alias("at"), name.alias("name"))
    end = F.aggregate(_words(text), start, lambda s, w: F.when(s["at"] < 0, s).otherwise(state(*step(s, w))))
    return F.when(end["at"] < 0, end["name"]).otherwise("")


def package_of(text: Column) -> Column:
    """Package of a Java source: what stands between the word package, first in its line, and a semicolon; empty without one."""

    def step(s: Column, w: Column):
        word, none = w["word"], F.lit("")
        named = F.substring_index(word, ";", 1)
        plain = named.rlike(r"\A[\w.]+\z")
        ends = word.contains(";")
        after = F.when((s["at"] == 1) & plain, F.when(ends, -1).otherwise(2)).when((s["at"] == 2) & word.startswith(";"), -1)
        at = F.coalesce(after, F.when(w["opens"] & (word == "package"), 1).otherwise(0))
        return at, F.when(s["at"] == 1, named).when(s["at"] == 2, s["name"]).otherwise(none)

    return _read(text, step)


def public_type(text: Column) -> Column:
    """Name of the first public type of a Java source: the word after its kind, where public begins the line; empty without one."""

    def step(s: Column, w: Column):
        word = w["word"]
        name = F.regexp_extract(word, r"\A\w+", 0)
        after = F.when(s["at"] == 1, F.when(word.isin(*MODIFIERS), 1).when(word.isin(*KINDS), 2)).when((s["at"] == 2) & (name != ""), -1)
        return F.coalesce(after, F.when(w["opens"] & (word == "public"), 1).otherwise(0)), name

    return _read(text, step)


def staged_names(files: DataFrame, key: str, order: str = "path") -> DataFrame:
    """``files`` (key, path, text) of repositories with staged: the folder of a Java file's package and the name of its public type, else its own name.

    Of files that claim one name the first, by path, has it; the name of each other gets the number of files before it
    in its repository. One task numbers one repository's files.
    """
    package, public = package_of(F.col("text")), public_type(F.col("text"))
    folder = F.when(package != "", F.concat(F.replace(package, F.lit("."), F.lit("/")), F.lit("/"))).otherwise("")
    name = F.when(public != "", F.concat(public, F.lit(".java"))).otherwise(F.regexp_extract("path", r"([^/]*)$", 1))
    rows = files.withColumns({"_folder": folder, "_name": name})
    rows = rows.withColumn("_before", F.count(F.lit(1)).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("_turn", F.row_number().over(Window.partitionBy(key, "_folder", "_name").orderBy(order)))
    other = F.concat("_folder", F.lit("_"), F.col("_before").cast("string"), F.lit("_"), "_name")
    return rows.withColumn("staged", F.when(F.col("_turn") == 1, F.concat("_folder", "_name")).otherwise(other)).drop("_folder", "_name", "_before", "_turn")


def qualified_class(path: Column, text: Column) -> Column:
    """Fully qualified name of a Java file's public class, else of one named as the file."""
    package, public = package_of(text), public_type(text)
    name = F.when(public != "", public).otherwise(F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1))
    return F.when(package != "", F.concat(package, F.lit("."), name)).otherwise(name)


def outdated(folders: DataFrame, keep: int, key: str) -> DataFrame:
    """``folders`` (key, path, modified) but the ``keep`` newest of each key, ties by path; none for a negative ``keep``."""
    if keep < 0:
        return folders.limit(0)
    newest = Window.partitionBy(key).orderBy(F.desc("modified"), "path")
    return folders.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") > keep).drop("_n")


def last_checkpoint(names: DataFrame, key: str, prefix: str = "checkpoint") -> DataFrame:
    """(key, step, name): the highest-numbered of ``names`` (key, name) like checkpoint-12; others don't count."""
    step = F.regexp_extract("name", rf"^{prefix}-([0-9]+)$", 1).try_cast("bigint")
    rows = names.withColumn("step", step).where("step IS NOT NULL")
    return rows.groupBy(key).agg(F.max(F.struct("step", "name")).alias("m")).select(key, "m.step", "m.name")
