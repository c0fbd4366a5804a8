"""Edits of source text by lines: functions spliced into a file, broken tests found by the compiler's errors and taken out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import regions
from ..functions.text import WS, let, py_strip, split_lines, without_last_empty

#: The place after a line's end.
_ENDED = r"(?<=[\n\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029])|(?<=\r)(?!\n)"
#: Columns by which the body of a function stands in.
STEP = 4
#: Lines of a bucket of ``lines_in_spans``.
WIDTH = 64


def kept_lines(text: Column) -> Column:
    """Lines of a text with their ends; joined, they are the text."""
    return let(F.split(text, _ENDED), without_last_empty)


# -- functions spliced into a file -----------------------------------------------------------------


def to_margin(code: Column) -> Column:
    """Lines of a function brought to the left margin.

    Where only the first line stands there already, as a method cut out of its class does, the body is brought to one step;
    else the common indentation goes. Blank lines of a shifted body are empty.
    """
    blank = lambda x: py_strip(x) == ""
    depth = lambda x: F.length(x) - F.length(F.regexp_replace(x, rf"\A{WS}+", ""))

    def moved(lines: Column) -> Column:
        rest = F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))
        body = F.filter(rest, lambda x: ~blank(x))
        first = F.get(lines, 0)
        shift = lambda excess: F.when(excess > 0, F.concat(F.array(first), F.transform(rest, lambda x: F.when(blank(x), "").otherwise(x.substr(excess + 1, F.length(x)))))).otherwise(lines)
        shifted = let(F.array_min(F.transform(body, depth)) - STEP, shift)
        return F.when((F.size(body) > 0) & (depth(first) == 0), shifted).otherwise(let(F.transform(lines, lambda x: F.when(x.rlike(r"\A[ \t]*\z"), "").otherwise(x)), dedented))

    def dedented(plain: Column) -> Column:
        margin = lambda inked: F.when(F.size(inked) > 0, regions.common_indent(inked)).otherwise("")
        return let(let(F.filter(plain, lambda x: x != ""), margin), lambda m: regions.dedent(plain, m))

    return let(split_lines(code), moved)


def aligned_to_brace(code: Column) -> Column:
    """A method whose first line stands further left than its closing brace gets the brace's indentation there."""
    lines = split_lines(code)
    depth = lambda x: F.length(x) - F.length(F.regexp_replace(x, rf"\A{WS}+", ""))
    last = F.try_element_at(lines, F.lit(-1))
    lacks = depth(last) - depth(F.get(lines, 0))
    moved = (F.size(lines) > 1) & (py_strip(last) == "}") & (lacks > 0)
    return F.array_join(F.when(moved, F.concat(F.array(F.concat(F.repeat(F.lit(" "), lacks), F.get(lines, 0))), F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))))).otherwise(lines), "\n")


def reply_functions(nodes: Column, language: Column) -> Column:
    """Map of the functions in a reply by name: the top-level ones of Python without decorators, the methods of Java.

    ``nodes`` is a column of the reply's ``java.code_nodes``. Of functions with one name the last counts; a reply without any
    gives an empty map.
    """
    own = F.filter(nodes, lambda n: F.when(language == "java", n["type"] == "method").otherwise((n["type"] == "function") & n["parent"].isNull()))
    code = lambda n: F.when(language == "java", aligned_to_brace(n["code"])).otherwise(n["code"])
    last = F.filter(own, lambda n, i: ~F.exists(F.slice(own, i + 2, F.size(own)), lambda m: m["name"] == n["name"]))
    return F.map_from_entries(F.transform(last, lambda n: F.struct(n["name"].alias("name"), code(n).alias("code"))))


def spliced(original: Column, targets: Column, functions: Column) -> Column:
    """``original`` with the lines of each target (name, start_line, end_line) replaced by the function of its name.

    A fold over the targets from the bottom up, so that the numbers of lines above stay right; targets that begin on one
    line keep their order, and one inside of another is replaced first, after which the outer one takes as many lines as it
    says. A function is re-indented to its target's first line. Targets without a function, or that begin outside of the
    text, change nothing. A text without a last line end gets none.
    """
    numbered = F.transform(targets, lambda t, i: F.struct((-t["start_line"]).alias("up"), i.alias("turn"), t["name"].alias("name"), t["start_line"].alias("a"), t["end_line"].alias("z")))

    def one(known: Column, lines: Column, t: Column) -> Column:
        put = lambda found: F.when(found.isNotNull() & (t["a"] >= 1) & (t["a"] <= F.size(lines)), replaced(lines, t, found)).otherwise(lines)
        return let(F.try_element_at(known, t["name"]), put)

    def replaced(lines: Column, t: Column, found: Column) -> Column:
        indented = lambda indent: F.transform(to_margin(found), lambda x: F.concat(F.when(py_strip(x) == "", "").otherwise(F.concat(indent, x)), F.lit("\n")))
        new = let(F.regexp_extract(F.get(lines, t["a"] - 1), r"\A[ \t]*", 0), indented)
        return F.concat(F.slice(lines, F.lit(1), t["a"] - 1), new, F.slice(lines, F.greatest(t["z"], t["a"] - 1) + 1, F.size(lines)))

    # each value is computed once
    whole = let(functions, lambda known: F.array_join(F.aggregate(F.array_sort(numbered), kept_lines(original), lambda lines, t: one(known, lines, t)), ""))
    return let(whole, lambda out: F.when(~original.endswith("\n") & out.endswith("\n"), out.substr(F.lit(1), F.length(out) - 1)).otherwise(out))


# -- tests that don't compile ----------------------------------------------------------------------


def compiler_errors(output: Column) -> Column:
    """(file, line) of each error that a Java compiler names in its output, as ``Name.java:12: error``; folders are left out."""
    parts = F.transform(F.split(output, r"\r\n|\n|\r"), lambda x: F.split(x, ":"))

    def of(p: Column) -> Column:
        at = F.filter(F.sequence(F.lit(0), F.size(p) - 1), lambda i: F.get(p, i).endswith(".java") & F.get(p, i + 1).rlike(r"\A[0-9]+\z") & F.get(p, i + 2).startswith(" error"))
        return F.transform(at, lambda i: F.struct(F.element_at(F.split(F.get(p, i), r"[^\w$.]"), -1).alias("file"), F.get(p, i + 1).cast("int").alias("line")))

    return F.flatten(F.transform(parts, of))


def lines_in_spans(lines: DataFrame, spans: DataFrame, key: str, width: int = WIDTH) -> DataFrame:
    """(key, line, start, end): the spans (key, start, end) that each of ``lines`` (key, line) lies in.

    An equi-join by key and bucket of ``width`` lines: a line is in one bucket, a span in all that it touches, so each pair is
    met once and no pair of other buckets is.
    """
    at = lines.withColumn("_bucket", F.floor(F.col("line") / width))
    cover = spans.where(F.col("start") <= F.col("end")).withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))))
    return at.join(cover, [key, "_bucket"]).where(F.col("line").between(F.col("start"), F.col("end"))).drop("_bucket")


def droppable(errors: DataFrame, tests: DataFrame, key: str) -> DataFrame:
    """(key, spans): the tests (key, start, end) to take out of each file so that it compiles, by the errors (key, line) in it.

    All or nothing for a file: each error must lie in a test, and a test must be left. Repeated errors count once; a null
    key or line is left out.
    """
    errors = errors.select(key, "line").dropna().distinct()
    tests = tests.select(key, "start", "end").dropna()
    hit = lines_in_spans(errors, tests, key)
    span = F.struct(F.col("start"), F.col("end"))
    inside = hit.groupBy(key).agg(F.count_distinct("line").alias("_inside"), F.array_sort(F.collect_set(span)).alias("spans"))
    bad = errors.groupBy(key).agg(F.count(F.lit(1)).alias("_bad"))
    all_ = tests.groupBy(key).agg(F.count_distinct(span).alias("_all"))
    return inside.join(bad, key).join(all_, key).where((F.col("_inside") == F.col("_bad")) & (F.size("spans") < F.col("_all"))).select(key, "spans")


def without_spans(text: Column, spans: Column) -> Column:
    """``text`` without the lines of ``spans`` (start, end), which may overlap; a null list takes nothing out."""
    kept = lambda out: F.filter(kept_lines(text), lambda _, i: ~F.exists(out, lambda s: (i + 1).between(s["start"], s["end"])))
    return let(spans, lambda out: F.when(out.isNull(), text).otherwise(F.array_join(kept(out), "")))


# -- tests of functions ----------------------------------------------------------------------------


def test_source_fault(nodes: Column, under_test: Column) -> Column:
    """Why a Python test file can't serve, or null: it has no test function, or redefines what it should import.

    ``nodes`` is a column of the file's ``java.code_nodes``, ``under_test`` has the names of the functions and classes that are
    tested. A text that isn't Python has no test function.
    """
    top = F.filter(nodes, lambda n: n["parent"].isNull() & n["type"].isin("class", "function"))
    names = F.array_distinct(F.transform(top, lambda n: n["name"]))
    again = F.array_sort(F.filter(F.array_intersect(names, under_test), lambda n: ~n.startswith("test")))
    return F.when(~F.exists(names, lambda n: n.startswith("test")), "no test function").when(F.size(again) > 0, F.concat(F.lit("redefines "), F.array_join(again, ", ")))


def without_definitions(source: Column, nodes: Column, names: Column) -> Column:
    """A Python file without the definitions of ``names``, nested ones and their decorators too.

    ``nodes`` is a column of the file's ``java.code_nodes``. A decorator is each line right above a definition, indented like it, that begins with an at sign.
    """
    found = F.filter(nodes, lambda n: F.array_contains(names, n["name"]))
    indent = lambda x: F.regexp_extract(x, r"\A[ \t]*", 0)

    def whole(lines: Column, n: Column) -> Column:
        above = F.reverse(F.slice(lines, F.lit(1), n["start_line"] - 1))
        marks = let(F.concat(indent(F.get(lines, n["start_line"] - 1)), F.lit("@")), lambda at: F.transform(above, lambda x: x.startswith(at)))
        first = lambda m: n["start_line"] - let(F.array_position(m, False).cast("int"), lambda stop: F.when(stop > 0, stop - 1).otherwise(F.size(m)))
        return F.struct(let(marks, first).alias("start"), n["end_line"].alias("end"))

    return without_spans(source, let(split_lines(source), lambda lines: F.transform(found, lambda n: whole(lines, n))))
