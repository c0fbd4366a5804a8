"""Methods of Java source, and definitions of Python source."""

from __future__ import annotations

import ast
import re
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LINES = [T.StructField("start_line", T.IntegerType()), T.StructField("end_line", T.IntegerType())]
METHODS = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), *_LINES]))
NODES = T.ArrayType(T.StructType([*[T.StructField(n, T.StringType()) for n in ("type", "name", "parent")], *_LINES, T.StructField("code", T.StringType())]))

# Words that a method can't be named.
CONTROL = ("if", "for", "while", "switch", "catch", "synchronized", "try", "do", "else", "return", "new", "case")
_NAMES = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_$")
_PIECE = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"[^\"\\]*(?:\\.[^\"\\]*)*(?:\"|\\?\Z)|'[^'\\]*(?:\\.[^'\\]*)*(?:'|\\?\Z)", re.S)
_MARK = re.compile(r"[\n{}]")


def scrubbed(source: str) -> str:
    """Comments and literals as spaces; line ends of comments stay."""
    return _PIECE.sub(lambda m: re.sub(r"[^\n]", " ", m[0]) if "\n" in m[0] else " " * len(m[0]), source)


def _named(c: str) -> bool:
    return c in _NAMES or c > "\x7f" and c.isalnum()


def signature(line: str) -> tuple[str, int] | None:
    """Name of the method that a line declares, and where its body's brace stands.

    The line is read outwards from its first parenthesis: a name before it, and before that only types (with a list of
    type parameters in front of them, perhaps); a balanced list, and after it only exceptions up to the brace.
    """
    opened = line.find("(")
    if opened < 0:
        return None
    end = len(line[:opened].rstrip())
    start = end
    while start and _named(line[start - 1]):
        start -= 1
    if start == end or not _is_types(line[:start]):
        return None
    depth, at = 0, opened
    while at < len(line):
        c = line[at]
        if c in ";{":
            return None
        depth += (c == "(") - (c == ")")
        at += 1
        if not depth:
            break
    else:
        return None
    brace = line.find("{", at)
    if brace < 0:
        return None
    between = line[at:brace].split(None, 1)
    if between and not (between[0] == "throws" and len(between) == 2 and all(_named(c) or c in "., \t" for c in between[1])):
        return None
    return line[start:end], brace


def _is_types(head: str) -> bool:
    """Whether what stands before a name can be modifiers, type parameters and a type."""
    if not head.strip():
        return True
    words = head.lstrip()
    generic = words.find("<")
    if generic >= 0 and all(w in _MODIFIERS for w in words[:generic].split()):
        closed = words.find(">", generic)
        if closed < 0:
            return False
        words = words[closed + 1 :]
        if not words.strip():
            return True
    return words[-1].isspace() and all(_named(c) or c.isspace() or c in ".<>[],?" for c in words)


# Modifiers of a Java declaration.
_MODIFIERS = ("public", "protected", "private", "static", "final", "abstract", "synchronized", "native", "strictfp", "default")


def find_methods(source: str) -> list[dict]:
    """Methods whose signature and brace stand on one line, to the brace that closes them; the search goes on after it."""
    plain = scrubbed(source)
    lines, out, at = plain.split("\n"), [], 0
    closing: dict[int, int] = {}  # line of the brace that closes the one at a place
    opened: list[int] = []
    line = 0
    for found in _MARK.finditer(plain):
        c = found[0]
        if c == "\n":
            line += 1
        elif c == "{":
            opened.append(found.start())
        elif c == "}" and opened:
            closing[opened.pop()] = line
    begins = [0, *accumulate(len(x) + 1 for x in lines)]
    while at < len(lines):
        found = signature(lines[at]) if "(" in lines[at] and "{" in lines[at] else None
        end = closing.get(begins[at] + found[1]) if found and found[0] not in CONTROL else None
        if end is None:
            at += 1
            continue
        out.append({"name": found[0], "start_line": at + 1, "end_line": end + 1})
        at = end + 1
    return out


@F.arrow_udf(METHODS)
def methods(source: pa.Array) -> pa.Array:
    kind = pa.list_(pa.struct([("name", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32())]))
    return pa.array([find_methods(s.as_py()) if s.is_valid else None for s in source], kind)


def python_nodes(source: str) -> list[dict]:
    """Classes, functions and methods of a Python program; none if it can't be parsed."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return []
    lines, out = source.splitlines(), []

    def walk(node, parent: str | None, in_class: bool) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
                is_class = isinstance(child, ast.ClassDef)
                out.append(
                    {
                        "type": "class" if is_class else "method" if in_class else "function",
                        "name": child.name,
                        "parent": parent,
                        "start_line": child.lineno,
                        "end_line": child.end_lineno,
                        "code": "\n".join(lines[child.lineno - 1 : child.end_lineno]),
                    }
                )
                walk(child, child.name, is_class)
            else:
                walk(child, parent, in_class)

    walk(tree, None, False)
    return out


def java_nodes(source: str) -> list[dict]:
    lines = source.split("\n")
    return [{"type": "method", "parent": None, "code": "\n".join(lines[m["start_line"] - 1 : m["end_line"]]), **m} for m in find_methods(source)]


@F.pandas_udf(NODES)
def code_nodes(source: pd.Series, language: pd.Series) -> pd.Series:
    """Code chunks of Python and Java files; other languages have none."""
    by = {"python": python_nodes, "java": java_nodes}
    return pd.Series([None if s is None else by.get(k, lambda _: [])(s) for s, k in zip(source, language, strict=True)], dtype=object)
