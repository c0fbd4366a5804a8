"""Query-shaped steps of a repair workflow: context for a prompt, related tests, feedback, and training examples."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import let, py_strip

# Lengths and counts at which texts and lists are cut.
MAX_TESTS, MAX_MESSAGE, MAX_PATCH, MAX_OUTPUT, MAX_RELATED, MAX_TARGETS = 8, 300, 3000, 20_000, 20, 3
#: Label of a token that isn't scored.
IGNORED = -100


def _base(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def is_test_file(path: Column) -> Column:
    """A Python test file by its name."""
    return _base(path).rlike(r"^(test_.*\.py|.*_test\.py)$")


def module_of(path: Column) -> Column:
    """Dotted module of a Python file, without a leading src."""
    return F.replace(F.regexp_replace(F.regexp_replace(path, r"\.[^./]*$", ""), r"^src/(?=.)", ""), F.lit("/"), F.lit("."))


def id_prefix(path: Column) -> Column:
    """The beginning of the ids of a file's tests."""
    return F.replace(F.regexp_replace(path, r"\.[^./]*$", ""), F.lit("/"), F.lit("."))


def import_pattern(path: Column) -> Column:
    """A pattern that a test importing the file matches."""
    quoted = lambda c: F.replace(c, F.lit("."), F.lit("\\."))
    module = module_of(path)
    parent, name = F.regexp_replace(module, r"\.?[^.]*$", ""), F.regexp_extract(module, r"([^.]*)$", 1)
    whole = F.concat(F.lit(r"(?m)^\s*import\s+"), quoted(module), F.lit(r"\b|^\s*from\s+"), quoted(module), F.lit(r"\s+import\b"))
    return F.when(parent == "", whole).otherwise(F.concat(whole, F.lit(r"|^\s*from\s+"), quoted(parent), F.lit(r"\s+import\s+[^\n]*\b"), name, F.lit(r"\b")))


def related_tests(files: DataFrame, changed: DataFrame, excluded: DataFrame | None = None, most: int = MAX_RELATED) -> DataFrame:
    """(path): tests among ``files`` (path, text) that are named after, or import, a changed file; at most ``most``, sorted.

    The changed files are the small side: one patch's files.
    """
    from pyspark.sql import Window

    own = changed.where(F.col("path").endswith(".py")).select(F.col("path").alias("_changed"))
    sources = own.where(~is_test_file(F.col("_changed"))).select("_changed", import_pattern(F.col("_changed")).alias("_pattern"), F.regexp_replace(_base(F.col("_changed")), r"\.py$", "").alias("_stem"))
    tests = files.where(is_test_file(F.col("path")))
    name = _base(F.col("path"))
    named = (name == F.concat(F.lit("test_"), F.col("_stem"), F.lit(".py"))) | (name == F.concat(F.col("_stem"), F.lit("_test.py")))
    hit = tests.join(F.broadcast(sources), named | F.regexp_like("text", F.col("_pattern")), "left_semi").select("path")
    out = hit.union(tests.join(own, F.col("path") == F.col("_changed"), "left_semi").select("path")).distinct()
    if excluded is not None:
        out = out.join(excluded.select("path"), "path", "left_anti")
    return out.withColumn("_n", F.row_number().over(Window.orderBy("path"))).where(F.col("_n") <= most).select("path")


def without_overlaps(chunks: Column) -> Column:
    """Chunks, in order, that don't overlap one kept before."""
    free = lambda kept, c: F.forall(kept, lambda o: (c["end_line"] < o["start_line"]) | (c["start_line"] > o["end_line"]))
    return F.aggregate(chunks, F.filter(chunks, lambda _: F.lit(False)), lambda kept, c: F.when(free(kept, c), F.concat(kept, F.array(c))).otherwise(kept))


def repair_targets(chunks: Column, most: int = MAX_TARGETS) -> Column:
    """Functions of the first file with any, in order, without overlaps; tests and other languages are left out."""
    able = F.filter(chunks, lambda c: c["file"].rlike(r"\.(py|java)$") & c["type"].isin("function", "method") & ~is_test_file(c["file"]))
    return F.slice(without_overlaps(F.filter(able, lambda c: c["file"] == F.get(able, F.lit(0))["file"])), 1, most)


def code_context(chunks: Column, most: int = 3) -> Column:
    """The first chunks that aren't tests, or the first of all, as text."""
    source = F.filter(chunks, lambda c: ~is_test_file(c["file"]))
    used = F.slice(F.when(F.size(source) > 0, source).otherwise(chunks), 1, most)
    block = lambda c: F.concat(F.lit("File: "), c["file"], F.lit(" (lines "), c["start_line"].cast("string"), F.lit("-"), c["end_line"].cast("string"), F.lit(", "), c["type"], F.lit(" "), c["name"], F.lit(")\n"), c["code"])
    return F.array_join(F.transform(used, block), "\n\n")


def shortened(text: Column, limit: int) -> Column:
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.substring(text, 1, limit), F.lit("\n... (truncated)")))


def capped_output(text: Column, limit: int = MAX_OUTPUT) -> Column:
    """The end of a long output, with a note of what was cut."""
    cut = F.length(text) - limit
    return F.when(cut > 0, F.concat(F.lit("... ("), cut.cast("string"), F.lit(" characters cut)\n"), F.right(text, F.lit(limit)))).otherwise(text)


def test_section(title: str, tests: Column, messages: Column, most: int = MAX_TESTS) -> Column:
    """Lines of feedback about some tests; none if there are none."""
    message = lambda t: F.coalesce(F.try_element_at(messages, t), F.lit(""))
    line = lambda t: F.concat(F.lit("- "), t, F.when(message(t) != "", F.concat(F.lit(": "), shortened(message(t), MAX_MESSAGE))).otherwise(""))
    more = F.when(F.size(tests) > most, F.array(F.concat(F.lit("- ... and "), (F.size(tests) - most).cast("string"), F.lit(" more")))).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(tests) > 0, F.concat(F.array(F.lit(f"{title}:")), F.transform(F.slice(tests, 1, most), line), more)).otherwise(F.array().cast("array<string>"))


def changed_lines(patch: Column) -> Column:
    """Added and removed lines of a patch, headers left out."""
    return F.size(F.filter(F.split(patch, "\n"), lambda x: x.rlike(r"^[+-]") & ~x.rlike(r"^(\+\+\+|---)")))


def summary_counts(output: Column) -> Column:
    """(passed, failed, errors): the last number before each label."""
    last = lambda label: F.coalesce(F.element_at(F.concat(F.array(F.lit("0")), F.regexp_extract_all(output, F.lit(rf"(\d+) {label}\b"), F.lit(1))), -1).cast("int"), F.lit(0))
    return F.struct(last("passed").alias("passed"), last("failed").alias("failed"), (last("error") + last("errors")).alias("errors"))


def error_lines(output: Column) -> Column:
    """Lines of failures after the last summary heading."""
    mark = "short test summary info"
    tail = F.when(F.lower(output).contains(mark), F.right(output, F.length(F.substring_index(F.lower(output), mark, -1)))).otherwise("")
    return F.filter(F.transform(F.split(tail, r"\r\n|\n|\r"), py_strip), lambda x: x.startswith("FAILED ") | x.startswith("ERROR "))


def first_fenced(text: Column) -> Column:
    """The first fenced block of a reply, else the reply, stripped."""
    block = F.regexp_extract(text, r"(?s)```[a-zA-Z0-9_+-]*\n(.*?)```", 1)
    return py_strip(F.when(block != "", block).otherwise(text))


# Fixed value: the title that may stand before a reply's code.
CODE_TITLE = "FIXED CODE"


def code_of(reply: Column) -> Column:
    """Code of a reply: its first fenced block, else all of it, without a title line."""

    def untitled(block: Column) -> Column:
        first = F.substring_index(block, "\n", 1)
        titled = block.contains("\n") & first.startswith("###") & (py_strip(F.substr(first, F.lit(4))) == CODE_TITLE)
        return F.when(titled, py_strip(F.substr(block, F.length(first) + 2))).otherwise(block)

    return let(first_fenced(reply), untitled)


def diff_of(reply: Column) -> Column:
    """The unified diff of a reply, from its first old-file header on, ended by a line end; null if there is none."""
    from_header = lambda block: F.when(F.instr(block, "--- ") > 0, F.substr(block, F.instr(block, "--- ")))
    return let(from_header(first_fenced(reply)), lambda diff: F.when(diff.contains("\n+++ "), F.concat(diff, F.lit("\n"))))


def confidence_of(found: Column) -> Column:
    """Confidence in a reply's object, from 0 to 1; null if it is no number, as a number or as text."""
    clamped = lambda x: F.when(x.isNotNull() & ~F.isnan(x), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))
    return let(F.get_json_object(found, "$.confidence").try_cast("double"), clamped)


def named_tests(reply: Column) -> Column:
    """The first test name of each line, each once."""
    names = F.transform(F.split(reply, "\n"), lambda x: F.regexp_extract(x, r"(?U)(test_\w+)", 1))
    return F.array_distinct(F.transform(F.filter(names, lambda n: n != ""), lambda n: F.concat(n, F.lit("()"))))


@F.pandas_udf(T.StringType())
def first_object(reply: pd.Series) -> pd.Series:
    """The first JSON object in a reply, as JSON; null if there is none."""
    decoder = json.JSONDecoder()

    def one(text: str | None) -> str | None:
        for m in re.finditer(r"\{", text or ""):
            try:
                return json.dumps(decoder.raw_decode(text[m.start() :])[0])
            except json.JSONDecodeError:
                continue
        return None

    return reply.map(one)


def evidence_tools(files: Column) -> Column:
    """Tools that the names of a repository's top-level files tell of; a test runner and a parser always."""
    found = lambda *names: F.arrays_overlap(files, F.array(*[F.lit(n) for n in names]))
    one = lambda test, tool: F.when(test, F.array(F.lit(tool))).otherwise(F.array().cast("array<string>"))
    tools = F.concat(one(found("pytest.ini", "conftest.py", "tox.ini", "setup.cfg", "pyproject.toml"), "pytest"), one(found("ruff.toml", ".ruff.toml"), "ruff"), one(found(".git"), "git"))
    return F.array_union(tools, F.array(F.lit("pytest"), F.lit("ast")))


def infill_parts(prompt: Column, fill: str = "<FILL_ME>") -> Column:
    """(prefix, suffix) around the first fill token; null without one."""
    return F.when(prompt.contains(fill), F.struct(F.substring_index(prompt, fill, 1).alias("prefix"), F.substring(prompt, F.instr(prompt, fill) + len(fill), F.length(prompt)).alias("suffix")))


def encoded_example(prompt: Column, completion: Column, most: int = 1024, side: str = "left", bos: int | None = None, eos: int | None = None) -> Column:
    """(input_ids, labels) of token arrays cut to ``most``; the prompt's labels are ignored.

    From the left, the first token and the prompt's end stay; a completion that overflows alone keeps its head.
    """
    if side not in ("left", "right", "error"):
        raise ValueError(f"unknown side {side!r}")
    p = F.concat(F.array(F.lit(bos)), prompt) if bos is not None else prompt
    c = F.concat(completion, F.array(F.lit(eos))) if eos is not None else completion
    over = F.size(p) + F.size(c) > most
    none = F.slice(p, 1, 0)
    if side == "left":
        keep, head = F.lit(most) - F.size(c), 1 if bos is not None else 0
        tail = F.greatest(keep - head, F.lit(0))
        short_p = F.when(keep <= 0, none).otherwise(F.concat(F.slice(p, 1, head), F.when(tail > 0, F.slice(p, F.size(p) - tail + 1, tail)).otherwise(none)))
        end = F.array(F.lit(eos)) if eos is not None else none
        short_c = F.when(keep <= 0, F.concat(F.slice(c, 1, most - 1), end)).otherwise(c)
    elif side == "right":
        short_p, short_c = p, F.slice(c, F.lit(1), F.greatest(F.lit(most) - F.size(p), F.lit(0)))
    else:
        stop = F.raise_error(F.lit(f"example is over {most} tokens")).cast("array<int>")
        short_p, short_c = stop, stop
    p, c = F.when(over, short_p).otherwise(p), F.when(over, short_c).otherwise(c)
    return F.struct(F.concat(p, c).alias("input_ids"), F.concat(F.transform(p, lambda _: F.lit(IGNORED)), c).alias("labels"))


def padded(rows: DataFrame, batch: str, pad: int, multiple: int = 8, most: int | None = None, left: bool = False) -> DataFrame:
    """``rows`` (input_ids, labels) filled up to the longest of their batch, rounded up to ``multiple``, with attention_mask."""
    width = F.ceil(F.max(F.size("input_ids")) / multiple) * multiple
    widths = rows.groupBy(F.col(batch).alias("_batch")).agg((F.least(width, F.lit(most)) if most else width).cast("int").alias("_width"))
    out = rows.join(widths, F.col(batch).eqNullSafe(F.col("_batch")))

    def filled(values: Column, value: int) -> Column:
        own = F.slice(values, F.lit(1), F.col("_width"))
        more = F.array_repeat(F.lit(value), F.col("_width") - F.size(own))
        return F.concat(more, own) if left else F.concat(own, more)

    mask = filled(F.transform("input_ids", lambda _: F.lit(1)), 0)
    return out.withColumns({"attention_mask": mask, "input_ids": filled(F.col("input_ids"), pad), "labels": filled(F.col("labels"), IGNORED)}).drop("_batch", "_width")
