"""Marked prompts of a suspicious region, and replacements for it, over arrays of lines (1-based, inclusive bounds)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, py_strip


@dataclass(frozen=True)
class Options:
    """The marks and formats of a prompt."""

    fill: str = "<FILL_ME>"
    start_mark: str = "// buggy lines start here"
    end_mark: str = "// buggy lines end here"
    prefix: str = "//"
    context: int | None = 10
    numbers: bool = False
    path: bool = True
    header: bool = True
    marks: bool = True

    def __post_init__(self):
        if not self.fill or not self.prefix:
            raise ValueError("fill and prefix must not be empty")
        if self.context is not None and self.context < 0:
            raise ValueError("context must be 0 or more, or None")


def _i(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def region_error(lines: Column, start: Column, end: Column) -> Column:
    """Why a region can't be used, or null; an empty source comes first."""
    return (
        F.when(F.size(lines) == 0, "empty_source")
        .when(start < 1, "start_before_first")
        .when(end < start, "end_before_start")
        .when(start > F.size(lines), "start_after_last")
        .when(end > F.size(lines), "end_after_last")
    )


def extract(lines: Column, start: Column, end: Column) -> Column:
    return F.slice(lines, start, end - start + 1)


def common_prefix(a: Column, b: Column) -> Column:
    """Longest common beginning of two strings."""
    places = F.sequence(F.lit(0), F.least(F.length(a), F.length(b)))
    same = F.filter(places, lambda i: a.substr(F.lit(1), i) == b.substr(F.lit(1), i))
    return a.substr(F.lit(1), F.array_max(same))


def common_indent(region: Column) -> Column:
    """Longest common indentation of the lines that aren't blank; of blank lines only, the first line."""
    own = F.transform(F.filter(region, lambda x: py_strip(x) != ""), lambda x: F.regexp_extract(x, r"^[ \t]*", 0))
    folded = F.aggregate(own, F.get(own, 0), common_prefix)
    return F.coalesce(F.when(F.size(own) > 0, folded).otherwise(F.get(region, 0)), F.lit(""))


def indent_width(indent: Column) -> Column:
    """Columns taken by an indentation; a tab goes to the next multiple of four."""
    return F.aggregate(F.split(indent, ""), F.lit(0), lambda w, c: F.when(c == "\t", (F.floor(w / 4) * 4 + 4).cast("int")).when(c == "", w).otherwise(w + 1))


def comment_line(line: Column, prefix: str = "//") -> Column:
    indent = F.regexp_extract(line, r"^[ \t]*", 0)
    rest = F.regexp_replace(line, r"^[ \t]*", "")
    return F.when(rest == "", F.concat(indent, F.lit(prefix))).otherwise(F.concat(indent, F.lit(prefix + " "), rest))


def uncomment_line(line: Column, prefix: str = "//") -> Column:
    indent = F.regexp_extract(line, r"^[ \t]*", 0)
    rest = F.regexp_replace(line, r"^[ \t]*", "")
    bare = rest.substr(F.lit(len(prefix) + 1), F.length(rest))
    return F.when(rest.startswith(prefix), F.concat(indent, F.when(bare.startswith(" "), bare.substr(F.lit(2), F.length(bare))).otherwise(bare))).otherwise(line)


def render(lines: Column, start: Column, end: Column, path: Column | None = None, options: Options = Options()) -> Column:
    """The prompt: header, context, marked and commented region, fill token, context."""
    o, total = options, F.size(lines)
    first = F.lit(1) if o.context is None else F.greatest(F.lit(1), start - o.context)
    last = total if o.context is None else F.least(total, end + o.context)
    indent = common_indent(extract(lines, start, end))
    width = F.greatest(F.lit(4), F.length(total.cast("string")))
    plain = F.repeat(F.lit(" "), width + 3) if o.numbers else F.lit("")

    def numbered(part: Column, at: Column) -> Column:
        if not o.numbers:
            return part
        gutter = lambda i: F.concat(F.lpad((i + at).cast("string"), F.greatest(F.lit(4), F.length((i + at).cast("string"))), F.lit(" ")), F.lit(" | "))
        return F.transform(part, lambda x, i: F.concat(gutter(i), x))

    one = lambda text: F.array(F.concat(plain, text))
    none = F.array().cast("array<string>")
    omitted = lambda n: F.when(n > 0, one(F.concat(F.lit("// ... "), n.cast("string"), F.lit(" line(s) omitted ...")))).otherwise(none)
    parts = []
    if o.path and path is not None:
        parts.append(F.when(F.coalesce(path, F.lit("")) != "", one(F.concat(F.lit(f"{o.prefix} file: "), path))).otherwise(none))
    if o.header:
        parts.append(one(F.concat(F.lit(f"{o.prefix} suspicious region: lines "), start.cast("string"), F.lit("-"), end.cast("string"), F.lit(" of "), total.cast("string"))))
    parts += [omitted(first - 1), numbered(F.slice(lines, first, start - first), first)]
    if o.marks:
        parts.append(one(F.concat(indent, F.lit(o.start_mark))))
    parts.append(numbered(F.transform(extract(lines, start, end), lambda x: comment_line(x, o.prefix)), start))
    if o.marks:
        parts.append(one(F.concat(indent, F.lit(o.end_mark))))
    parts += [one(F.concat(indent, F.lit(o.fill))), numbered(F.slice(lines, end + 1, last - end), end + 1), omitted(total - last)]
    return F.array_join(F.concat(*parts), "\n")


def recover(prompt: Column, options: Options = Options()) -> Column:
    """Lines of the region that a prompt with marks and without line numbers holds; null if it holds none."""
    if not options.marks or options.numbers:
        raise ValueError("only a prompt with marks and without line numbers can be read back")
    def found(lines: Column, bare: Column, start: Column) -> Column:
        rest = F.slice(bare, start + 1, F.size(bare))
        return let(F.array_position(rest, options.end_mark).cast("int"), lambda end: part(lines, start, end))

    def part(lines: Column, start: Column, end: Column) -> Column:
        return F.when((start > 0) & (end > 0), F.transform(F.slice(lines, start + 1, F.greatest(end - 1, F.lit(0))), lambda x: uncomment_line(x, options.prefix)))

    def read(lines: Column) -> Column:
        return let(F.transform(lines, py_strip), lambda bare: let(F.array_position(bare, options.start_mark).cast("int"), lambda start: found(lines, bare, start)))

    # each value is computed once; the prompt may be a whole rendering
    return let(F.split(prompt, "\n"), read)


def splice(lines: Column, start: Column, end: Column, replacement: Column) -> Column:
    return F.concat(F.slice(lines, F.lit(1), start - 1), replacement, F.slice(lines, end + 1, F.size(lines)))


def dedent(lines: Column, indent: Column) -> Column:
    return F.transform(lines, lambda x: F.when((py_strip(x) != "") & x.startswith(indent), x.substr(F.length(indent) + 1, F.length(x))).otherwise(x))


def restore_indent(lines: Column, indent: Column) -> Column:
    return F.transform(lines, lambda x: F.when(py_strip(x) == "", x).otherwise(F.concat(indent, x)))


def parse_completion(text: Column, stops: tuple[str, ...] = (), options: Options = Options(), fences: bool = True) -> Column:
    """Replacement lines of a model's raw completion: cut at the first listed stop, first fenced block, no fill token, no blank edges."""
    cut = text
    for stop in reversed(stops):
        cut = F.when(text.contains(stop), F.substring_index(text, stop, 1)).otherwise(cut)
    lines = F.split(cut, "\n")
    if fences:
        at = F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(r"^\s*```[a-zA-Z0-9_+-]*\s*$"), i)), lambda i: i.isNotNull())
        begin, stop_at = F.get(at, 0), F.coalesce(F.get(at, 1), F.size(lines))
        lines = F.when(F.size(at) > 0, F.slice(lines, F.coalesce(begin, F.lit(0)) + 2, stop_at - F.coalesce(begin, F.lit(0)) - 1)).otherwise(lines)
    lines = F.filter(lines, lambda x: py_strip(x) != options.fill)
    full = F.filter(F.transform(lines, lambda x, i: F.when(py_strip(x) != "", i)), lambda i: i.isNotNull())
    return F.when(F.size(full) > 0, F.slice(lines, F.coalesce(F.array_min(full), F.lit(0)) + 1, F.coalesce(F.array_max(full) - F.array_min(full), F.lit(0)) + 1)).otherwise(F.array().cast("array<string>"))


def fixed_region(lines: Column, start: Column, end: Column) -> Column:
    """(lines, is_deletion, error) of said bounds on the fixed side; an end just before the start is a deletion."""
    error = F.when(start < 1, "start_before_first").when(end < start - 1, "end_before_start").when(end > F.size(lines), "end_after_last")
    own = F.when(error.isNull(), F.slice(lines, F.greatest(start, F.lit(1)), F.greatest(end - start + 1, F.lit(0))))
    return F.struct(own.alias("lines"), (F.size(own) == 0).alias("is_deletion"), error.alias("error"))
