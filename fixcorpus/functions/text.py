"""Text functions that agree with Python's, as Columns."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space of Python's str.strip, and line ends of str.splitlines.
# Listed one by one, since Java looks up single characters of a class in a table and tries ranges one after the other.
WS = r"[\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_WS_IN = WS[1:-1]
_WS_CHARS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
LINE_END = r"(?:\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029])"

#: Tokens of source code; every repetition is possessive, so that long literals need no stack.
_NAME, _DIGITS = "".join(map(chr, (*range(65, 91), *range(97, 123)))) + "_$", "0123456789"
TOKEN = (
    rf"[{_NAME}][{_NAME}{_DIGITS}]*+"
    r"|\p{Nd}++(?:\.\p{Nd}++)?[fFdDlL]?"
    r'|"[^"\\]*+(?:\\[^\n][^"\\]*+)*+"'
    r"|'[^'\\]*+(?:\\[^\n][^'\\]*+)*+'"
    rf"|\n|[^{_WS_IN}{_NAME}{_DIGITS}]"
)
#: Pieces of source text: line comment, block comment, string, character, other.
PIECE = (
    r"//[^\n]*+|/\*(?:[^*]++|\*(?!/))*+(?:\*/|\z)"
    r'|"[^"\\]*+(?:\\(?s:.)[^"\\]*+)*+(?:"|\\?\z)'
    r"|'[^'\\]*+(?:\\(?s:.)[^'\\]*+)*+(?:'|\\?\z)"
    r"""|[^/"']++|/"""
)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def py_strip(c: Column) -> Column:
    return F.btrim(c, F.lit(_WS_CHARS))


def split_lines(c: Column) -> Column:
    """Lines without a phantom last one; the empty text has none."""
    return let(F.split(c, LINE_END), without_last_empty)


def without_last_empty(parts: Column) -> Column:
    """Parts of a split without the last one, where that is empty."""
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def newline_of(c: Column) -> Column:
    return F.when(c.contains("\r\n"), "\r\n").when(c.contains("\r") & ~c.contains("\n"), "\r").otherwise("\n")


def token_count(c: Column) -> Column:
    """Estimated tokens: five characters of a lexical token each, line ends, and a token for each indented line."""
    own = F.aggregate(F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0)), F.lit(0).cast("long"), lambda a, x: a + F.ceil(F.length(x) / 5))
    return own + F.regexp_count(c, F.lit(r"(?:\A|\n)[ \t]")).cast("long")


def has_tokens(c: Column) -> Column:
    """Whether a text has a lexical token: a line end, or anything but white space."""
    return c.rlike(rf"\n|[^{_WS_IN}]")


def strip_comments(c: Column) -> Column:
    """Comments as spaces of the same length; line ends stay, literals are left alone."""
    blank = lambda p: F.when(p.startswith("//") | p.startswith("/*"), F.regexp_replace(p, r"[^\n]", " ")).otherwise(p)
    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit(PIECE), F.lit(0)), blank), "")


def normalize_code(c: Column) -> Column:
    # white space is blanks by then
    return F.trim(F.regexp_replace(strip_comments(c), f"{WS}++", " "))


def normalize_source(c: Column) -> Column:
    """Line ends as LF, no-break spaces as spaces."""
    return F.replace(F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")), F.lit("\xa0"), F.lit(" "))


def fingerprint(buggy: Column, fixed: Column, strategy: str = "normalized", start: Column | None = None, end: Column | None = None) -> Column:
    """SHA-256 of what a strategy compares: both sides as they are, both normalised, or the normalised input with its region."""
    if strategy == "exact":
        parts = [buggy, fixed]
    elif strategy == "normalized":
        parts = [normalize_code(buggy), normalize_code(fixed)]
    elif strategy == "input_only":
        span = F.concat(F.coalesce(start.cast("string"), F.lit("None")), F.lit(":"), F.coalesce(end.cast("string"), F.lit("None"))) if start is not None else F.lit("None:None")
        parts = [normalize_code(buggy), span]
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    return F.sha2(F.concat(parts[0], F.lit("\x00"), parts[1]), 256)


# Folders of tests, endings of their files, annotations, endings of their classes, and lines that are looked at.
TEST_FOLDERS = ("test", "tests")
TEST_FILES = ("Test.java", "Tests.java", "TestCase.java", "IT.java")
TEST_ANNOTATIONS = ("Test", "ParameterizedTest", "BeforeEach", "AfterEach")
TEST_CLASSES = ("Test", "TestCase", "IT")
TEST_HEAD = 40


def looks_like_test(path: Column, source: Column) -> Column:
    """Test code by a folder of its path, its file name, or an annotation or class name in the first lines."""
    ends = lambda c, endings: functools.reduce(Column.__or__, [c.endswith(x) for x in endings])
    path = F.coalesce(path, F.lit(""))
    head = F.slice(split_lines(source), 1, TEST_HEAD)
    marks = F.transform(head, lambda x: F.regexp_extract(x, r"^\s*@(\w+)", 1))
    classes = F.flatten(F.transform(head, lambda x: F.regexp_extract_all(x, F.lit(r"\bclass\s+(\w+)"), F.lit(1))))
    return (
        F.arrays_overlap(F.split(F.lower(path), "/"), F.array(*map(F.lit, TEST_FOLDERS)))
        | ends(path, TEST_FILES)
        | F.arrays_overlap(marks, F.array(*map(F.lit, TEST_ANNOTATIONS)))
        | F.exists(classes, lambda c: ends(c, TEST_CLASSES))
    )


def normalize_path(c: Column) -> Column:
    return F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("/")), r"^[./]+", "")


# Language of a file name extension.
LANGUAGES = {
    ".py": "python", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".ts": "typescript", ".tsx": "tsx",
    ".java": "java", ".kt": "kotlin", ".kts": "kotlin", ".scala": "scala", ".c": "c", ".h": "c", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp",
    ".hpp": "cpp", ".cs": "c_sharp", ".go": "go", ".rs": "rust", ".rb": "ruby", ".php": "php", ".swift": "swift", ".dart": "dart", ".r": "r",
    ".sh": "bash", ".sql": "sql",
}


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def detect_language(path: Column) -> Column:
    """Language of the extension, or null; a leading dot is not an extension."""
    return F.try_element_at(_map(LANGUAGES), F.lower(F.regexp_extract(path, r"[^/.][^/]*(\.[^./]*)$", 1)))


def repository_of(url: Column) -> Column:
    """(owner, name) of a repository's URL or of owner/name; nulls if it is neither."""
    path = F.when(url.contains("//"), F.regexp_replace(url, r"^[^/]*//[^/]*", "")).otherwise(url)
    parts = F.filter(F.split(F.regexp_replace(path, r"[?#].*$", ""), "/"), lambda x: x != "")
    name = F.regexp_replace(F.get(parts, 1), r"\.git$", "")
    fits = (F.size(parts) >= 2) & F.get(parts, 0).rlike(r"^[\w.-]+$") & name.rlike(r"^[\w.-]+$")
    return F.when(fits, F.struct(F.get(parts, 0).alias("owner"), name.alias("name")))
