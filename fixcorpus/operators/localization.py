"""From scored lines to a marked prompt: chunks of a file, its most suspicious line, the prompt, and text about regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_path
from .search import allowed_ranges, most_suspicious, scored_lines

FILL = "<FILL_ME>"
# File name extensions whose comments start with # or are those of a markup language.
HASH = ("py", "rb", "sh", "yaml", "yml")
MARKUP = ("html", "xml")


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*$", 1)


def same_file(chunk: Column, target: Column) -> Column:
    """Whether a chunk's path means the target: equal when normalised, or of the same base name."""
    a, b = normalize_path(chunk), normalize_path(target)
    return (a == b) | (base_name(a) == base_name(b))


def chunks_of(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """(path, chunk): chunks (file, ...) of each of ``files`` (path), by ``same_file``.

    An equal normalised path implies an equal base name, so it is one equi-join by base name.
    """
    own = files.select("path").distinct().withColumn("_base", base_name(normalize_path(F.col("path"))))
    named = chunks.select(F.struct(*chunks.columns).alias("chunk")).withColumn("_base", base_name(normalize_path(F.col("chunk.file"))))
    return own.join(named, "_base").drop("_base")


def comment_marks(path: Column) -> Column:
    """(open, close) of a line comment in a file of that name."""
    kind = F.lower(F.regexp_extract(path, r"[^/.][^/]*\.([^./]+)$", 1))
    opened = F.when(kind.isin(*HASH), "# ").when(kind.isin(*MARKUP), "<!-- ").otherwise("// ")
    return F.struct(opened.alias("open"), F.when(kind.isin(*MARKUP), " -->").otherwise("").alias("close"))


def bounds_error(lines: Column, start: Column, end: Column) -> Column:
    """Why a region can't be marked, or null."""
    return F.when(start < 1, "start_before_first").when(end > F.size(lines), "end_after_last").when(start > end, "end_before_start")


def commented_prompt(lines: Column, start: Column, end: Column, path: Column) -> Column:
    """The whole file, the region commented out at column 0 and the fill token below it; null for wrong bounds."""
    marks = comment_marks(path)
    marked = F.transform(F.slice(lines, start, end - start + 1), lambda x: F.concat(marks["open"], x, marks["close"]))
    whole = F.concat(F.slice(lines, F.lit(1), start - 1), marked, F.array(F.lit(FILL)), F.slice(lines, end + 1, F.size(lines)))
    return F.when(bounds_error(lines, start, end).isNull(), F.array_join(whole, "\n"))


def localized(files: DataFrame, tokens: Column, key: str, nodes: Column | None = None) -> DataFrame:
    """(key, path, number, line, score, prompt): the most suspicious line of each of ``files`` (key, path, lines).

    ``nodes`` (arrays of type, start_line, end_line) restrict the lines that score. Files without lines have no row. Only
    keys, numbers and lines are shuffled; the prompt is made from the file joined back by key.
    """
    rows = files.where(F.size("lines") > 0)
    ranges = allowed_ranges(nodes, F.size("lines")) if nodes is not None else None
    found = most_suspicious(scored_lines(rows, tokens, ranges), key)
    out = rows.select(key, "path", "lines").join(found, key)
    at = F.col("number").cast("int")
    return out.select(key, "path", "number", "line", "score", commented_prompt(F.col("lines"), at, at, F.col("path")).alias("prompt"))


def innermost(spans: Column, line: Column) -> Column:
    """The shortest of ``spans`` (start_line, end_line) that holds a line, the first of equals; null if none does."""
    own = F.filter(spans, lambda s: (s["start_line"] <= line) & (line <= s["end_line"]))
    lengths = F.transform(own, lambda s: s["end_line"] - s["start_line"])
    return F.get(own, (F.array_position(lengths, F.array_min(lengths)) - 1).cast("int"))


def region_sections(regions: Column) -> Column:
    """Regions (file, start_line, end_line, score, code, prompt) as numbered sections of text."""
    part = lambda r, i: F.format_string(
        "REGION %d\nFILE: %s\nSUSPICIOUS LINES: %d-%d\nSCORE: %.4f\n\nORIGINAL SUSPICIOUS CODE:\n%s\n\nIR4 REPRESENTATION:\n%s", i + 1, r["file"], r["start_line"], r["end_line"], r["score"], r["code"], r["prompt"]
    )
    return F.array_join(F.transform(regions, part), "\n\n")


def repair_language(chunks: Column, fallback: Column, is_test) -> Column:
    """Language of the first Python or Java function that isn't a test; ``is_test`` judges a path."""
    able = F.filter(chunks, lambda c: c["language"].isin("python", "java") & c["type"].isin("function", "method") & ~is_test(F.coalesce(c["file"], F.lit(""))))
    return F.coalesce(F.get(able, F.lit(0))["language"], fallback, F.lit(""))


def embedded(chunks: DataFrame) -> DataFrame:
    """Chunks to embed: all but classes; a chunk without a type stays."""
    return chunks.where(~F.col("type").eqNullSafe(F.lit("class")))
