"""Text functions as temporary functions of SQL, which the analyzer inlines: no Python runs, and filters on them are plans' own.

Nulls give null. ``detect_language`` of a path without a known extension is null.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import text


def _string(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


_TOKEN_COUNT = f"""aggregate(regexp_extract_all(code, {_string(text.TOKEN)}, 0), 0L, (n, t) -> n + ceil(length(t) / 5))
+ regexp_count(code, {_string(r"(?:\A|\n)[ \t]")})"""
_BLANKED = f"""CASE WHEN startswith(p, '//') OR startswith(p, '/*') THEN regexp_replace(p, {_string(r"[^\n]")}, ' ') ELSE p END"""
_STRIPPED = f"array_join(transform(regexp_extract_all(code, {_string(text.PIECE)}, 0), p -> {_BLANKED}), '')"
_LANGUAGES = ", ".join(f"{_string(k)}, {_string(v)}" for k, v in text.LANGUAGES.items())

#: Name: (parameter, result, body).
FUNCTIONS = {
    "token_count": ("code STRING", "BIGINT", _TOKEN_COUNT),
    "strip_comments": ("code STRING", "STRING", _STRIPPED),
    "normalize_code": ("code STRING", "STRING", f"trim(regexp_replace({_STRIPPED}, {_string(text.WS + '++')}, ' '))"),
    "detect_language": ("path STRING", "STRING", f"try_element_at(map({_LANGUAGES}), lower(regexp_extract(path, {_string(r'[^/.][^/]*([.][^./]*)$')}, 1)))"),
}


def register(spark: SparkSession) -> None:
    """Make all ``FUNCTIONS`` known to the session; those of the same names are replaced."""
    for name, (given, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({given}) RETURNS {result} RETURN {body}")
