"""Secret scans with an incremental ledger of blobs (DataFrame functions only).

Every version of every file is content-addressed: its blob id is the SHA-256 of its text. The ledger holds a row for
each blob and rule version that was ever scanned, with the spans found. A scan takes the versions at hand, reduces
them to distinct blobs, leaves out what the ledger has, scans the rest, and joins the findings back to all paths.

Defined results: a null text is the empty text; a null path stays a path of its own; repeated rows each get the
blob's findings; an empty table gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, let

BASE_KINDS = ("assign", "access", "hex")
LEDGER = "blob string, rule string, version string, spans array<struct<start:int,end:int>>"


@dataclass(frozen=True)
class Rule:
    """A kind of secret: leftmost non-overlapping matches of ``pattern``, kept if ``group`` has ``least`` characters.

    ``hint`` is a cheap test that every text with a match passes.
    """

    kind: str
    pattern: str
    hint: Callable[[Column], Column]
    group: int = 0
    least: int = 0

    @property
    def version(self) -> str:
        return f"{self.pattern}|{self.group}|{self.least}"


#: The line that opens a private key.
_KEY = r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"
#: What stands between the lines of a key: white space, or its escapes and quotes in a string of a program.
_BREAK = r"""(?:[\s"',+]|\\[nrt])"""
#: A key up to its END line, if no other line of five dashes comes before; else its header fields and lines of base64, the
#: last of which may be short; every repetition is possessive, so that keys of any length need no stack. The search for dashes stops at the next ones, so that all keys of a text take one pass.
_KEY_BODY = (
    r"(?:(?>[\s\S]*?-----)END [A-Z ]{0,40}PRIVATE KEY-----"
    rf"|(?:{_BREAK}*+[A-Z][A-Za-z-]++:\x20[^\n\\]*+)*+"
    rf"(?:{_BREAK}++[A-Za-z0-9+/]{{20,}}+={{0,2}}+)++"
    r"""(?:(?:\r?\n[ \t]*+|\\n)[A-Za-z0-9+/]{1,19}+={0,2}+(?=["',]*+(?:[ \t]*+(?:[\r\n]|\z)|\\)))?+)?+"""
)

#: The base rules. For access and hex, a run that is too short can hold no match, so the length is part of the pattern.
RULES = (
    Rule(
        "assign",
        r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        lambda t: (t.contains("=") | t.contains(":")) & t.rlike(r"""[dDtTnNyY]["']?\x20*[:=]"""),
        2,
        6,
    ),
    Rule("access", r"AKIA[A-Z0-9]{16,}", lambda t: t.contains("AKIA")),
    Rule("hex", r"[0-9a-f]{24,}", lambda t: t.rlike(r"(?<![0-9a-f])[0-9a-f]{24}")),
    Rule("pem", _KEY + _KEY_BODY, lambda t: t.contains("PRIVATE KEY-----")),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", lambda t: t.contains("eyJ")),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}", lambda t: t.rlike("gh[pousr]_")),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}", lambda t: t.contains("xox")),
)

_SPANS = "array<struct<start:int,end:int>>"


#: Values that ``running`` handles at a time: its cost is linear up to that many, and then grows with n * (n / BLOCK).
BLOCK = 256


def blocked(values: Column) -> Column:
    """An array cut into arrays of ``BLOCK`` values."""
    last = F.floor((F.size(values) - 1) / BLOCK).cast("int")
    return F.when(F.size(values) > 0, F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(values, b * BLOCK + 1, F.lit(BLOCK)))).otherwise(F.array())


def running(values: Column, both: Callable[[Column, Column], Column]) -> Column:
    """Running sums, or maxima, of an array of integers: within blocks, then over the blocks' last ones."""
    plain = lambda a, b: F.when(a.isNotNull(), both(a, b))

    def appended(block: Column) -> Column:
        # get() is null before the first value, and so is what ``both`` makes of it
        return F.aggregate(block, F.array().cast("array<int>"), lambda acc, v: F.array_append(acc, F.coalesce(plain(F.get(acc, F.size(acc) - 1), v), v)))

    def joined(blocks: Column) -> Column:
        before = lambda ends: F.zip_with(blocks, F.concat(F.array(F.lit(None).cast("int")), F.slice(ends, F.lit(1), F.size(ends) - 1)), lambda block, low: F.transform(block, lambda v: F.coalesce(plain(low, v), v)))
        return F.flatten(let(appended(F.transform(blocks, lambda x: F.element_at(x, -1))), before))

    many = let(F.transform(blocked(values), appended), joined)
    return F.when(F.size(values) <= BLOCK, appended(values)).otherwise(many)


def spans_of(text: Column, rule: Rule) -> Column:
    """Matches as (start, end) in code points: running sums of the sizes of matches and of what stands between them."""
    pattern = F.lit(rule.pattern)

    def laid(parts: Column) -> Column:
        def named(ends: Column) -> Column:
            rows = F.zip_with(parts, ends, lambda p, end: F.struct((end - p["size"]).alias("start"), end.alias("end"), p["tested"]))
            return F.transform(F.filter(rows, lambda r: r["tested"] >= rule.least), lambda r: F.struct(r["start"], r["end"]))

        return let(running(F.transform(parts, lambda p: p["gap"] + p["size"]), lambda a, b: a + b), named)

    sizes = lambda values: F.transform(values, lambda v: F.length(v))
    parts = F.zip_with(
        F.arrays_zip(
            sizes(F.regexp_extract_all(text, pattern, F.lit(0))).alias("size"),
            sizes(F.regexp_extract_all(text, pattern, F.lit(rule.group))).alias("tested"),
        ),
        sizes(F.split(text, rule.pattern, -1)),
        lambda m, gap: F.when(m.isNotNull(), F.struct(gap.alias("gap"), m["size"], m["tested"])),
    )
    return F.when(rule.hint(text), let(F.filter(parts, lambda p: p.isNotNull()), laid)).otherwise(F.array()).cast(_SPANS)


def blobs_of(versions: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(path, blob, text): each version with the id of its content."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return versions.select(F.col(path).alias("path"), F.sha2(whole, 256).alias("blob"), whole.alias("text"))


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, path: str = "path", text: str = "text") -> DataFrame:
    """New ledger rows: (blob, rule, version, spans) of each blob and rule version that ``ledger`` lacks.

    Copies of a blob meet after a partial aggregation, so that a blob of many paths sends one row from each task.
    """
    blobs = blobs_of(versions, path, text).select("blob", "text").dropDuplicates(["blob"])
    wanted = F.array(*[F.lit(f"{r.kind}\x00{r.version}") for r in rules])
    if ledger is not None:
        seen = ledger.groupBy("blob").agg(F.collect_set(F.concat_ws("\x00", "rule", "version")).alias("seen"))
        blobs = blobs.join(seen, "blob", "left").withColumn("todo", F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>"))))
        blobs = blobs.where(F.size("todo") > 0)
    else:
        blobs = blobs.withColumn("todo", wanted)
    found = [
        F.when(
            F.array_contains("todo", f"{r.kind}\x00{r.version}"),
            F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version"), spans_of(F.col("text"), r).alias("spans")),
        )
        for r in rules
    ]
    rows = blobs.select("blob", F.filter(F.array(*found), lambda x: x.isNotNull()).alias("found"))
    return rows.select("blob", F.inline("found"))


def read_ledger(spark: SparkSession, at: str) -> DataFrame:
    """The ledger table at a path; without rows if there is none yet."""
    where = spark._jvm.org.apache.hadoop.fs.Path(at)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.read.schema(LEDGER).parquet(at)
    return spark.createDataFrame([], LEDGER)


def updated(versions: DataFrame, at: str, rules: tuple[Rule, ...] = RULES, path: str = "path", text: str = "text") -> DataFrame:
    """The ledger table at ``at`` after what it lacks for ``versions`` was scanned and added."""
    spark = versions.sparkSession
    scan(versions, read_ledger(spark, at), rules, path, text).write.mode("append").parquet(at)
    return read_ledger(spark, at)


def findings(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES, path: str = "path", text: str = "text") -> DataFrame:
    """(path, found): every version with the spans that the ledger has for its blob under the current rules.

    Only blobs with spans are joined back.
    """
    return blobs_of(versions, path, text).select("path", "blob").join(hits(ledger, rules), "blob", "left")


def hits(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, found) of blobs with spans: structs (start, order, kind, end), by start and then by the order of the rules."""
    order = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (f"{r.kind}\x00{r.version}", i)])
    return (
        ledger.where(F.size("spans") > 0)
        .withColumn("order", F.try_element_at(order, F.concat_ws("\x00", "rule", "version")))
        .where(F.col("order").isNotNull())
        .select("blob", F.inline(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.col("order"), F.col("rule").alias("kind"), s["end"].alias("end")))))
        .groupBy("blob")
        .agg(F.array_sort(F.collect_set(F.struct("start", "order", "kind", "end"))).alias("found"))
    )


def joined(found: Column) -> Column:
    return F.coalesce(F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","), F.lit(""))


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of ``findings``."""
    spans = F.coalesce("found", F.array().cast("array<struct<start:int,order:int,kind:string,end:int>>"))
    of = lambda kind: F.size(F.filter("s", lambda x: x["kind"] == kind)).cast("long")
    return found.select(F.col("path").alias("doc_id"), spans.alias("s")).select(
        "doc_id",
        *[of(k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(joined(F.filter("s", lambda x: x["kind"].isin(*BASE_KINDS))), 256).alias("base_sha256"),
        joined(F.col("s")).alias("spans"),
    )


def redact(docs: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span that the ledger has for its text replaced by ``mark``; overlapping spans become one.

    A column n_chars, if there is one, follows the text.
    """
    def cutout(text: Column, spans: Column) -> Column:
        def kept(reach: Column) -> Column:
            # what stands before each span that begins at or after the ends of all earlier ones, and after the last
            before = F.concat(F.array(F.lit(0)), reach)
            rows = F.zip_with(before, spans, lambda a, s: F.struct(a.alias("a"), F.coalesce(s["start"], F.length(text)).alias("z")))
            return F.filter(rows, lambda r: r["z"] >= r["a"])

        def cut(block: Column) -> Column:
            first, last = F.element_at(block, 1)["a"], F.element_at(block, -1)["z"]
            part = F.substring(text, first + 1, last - first)
            return let(F.struct(part.alias("t"), first.alias("a")), lambda p: F.array_join(F.transform(block, lambda r: F.substring(p["t"], r["a"] - p["a"] + 1, r["z"] - r["a"])), mark))

        reach = running(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b))
        return F.array_join(F.transform(let(let(reach, kept), blocked), cut), mark)

    blob, found = fresh(docs, "_blob"), fresh(docs, "_found")
    out = docs.withColumn(blob, F.sha2(F.coalesce("text", F.lit("")), 256)).join(hits(ledger, rules).toDF(blob, found), blob, "left")
    some = F.col(found).isNotNull()
    out = out.withColumn("text", F.when(some, cutout(F.col("text"), F.col(found))).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(some, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


#: DuckDB's expressions have no atomic groups, so the SQL has the first line of a private key only.
_BASE_SQL = {"assign": (RULES[0].pattern, 2, 6), "access": (r"AKIA[A-Z0-9]+", 0, 20), "hex": (r"[0-9a-f]{24,}", 0, 24), "pem": (_KEY, 0, 0)}


def sql() -> str:
    """The contract in DuckDB's SQL. Extra rules rarely match; their patterns are the operator's own."""
    rules = [(r.kind, *_BASE_SQL.get(r.kind, (r.pattern, r.group, r.least))) for r in RULES]

    def spans(i: int, kind: str, pattern: str, group: int, least: int) -> str:
        p = "'" + pattern.replace("'", "''") + "'"
        return f"""list_filter(list_transform(range(1, len(regexp_extract_all(t, {p})) + 1), lambda i: {{
            's': list_sum(list_transform(regexp_split_to_array(t, {p})[1:i], lambda x: length(x)))::BIGINT
                 + coalesce(list_sum(list_transform(regexp_extract_all(t, {p})[1:i - 1], lambda x: length(x))), 0)::BIGINT,
            'o': {i}, 'k': '{kind}',
            'n': length(regexp_extract_all(t, {p})[i]), 'g': length(regexp_extract_all(t, {p}, {group})[i])}}), lambda m: m.g >= {least})"""

    def one(i: int, rule: tuple) -> str:
        hint = "regexp_matches(t, '[0-9a-f]{24}')" if rule[0] == "hex" else "regexp_matches(t, '" + rule[1].replace("'", "''") + "')"
        return f"CASE WHEN {hint} THEN {spans(i, *rule)} ELSE [] END"

    parts = ", ".join(one(i, r) for i, r in enumerate(rules))
    text = "array_to_string(list_transform({}, lambda m: m.k || ':' || m.s || ':' || (m.s + m.n)), ',')"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS (SELECT doc_id, list_sort(flatten([{parts}])) AS a FROM d)
SELECT doc_id,
  len(list_filter(a, lambda m: m.k = 'assign'))::BIGINT AS n_assign,
  len(list_filter(a, lambda m: m.k = 'access'))::BIGINT AS n_access,
  len(list_filter(a, lambda m: m.k = 'hex'))::BIGINT AS n_hex,
  sha256(coalesce({text.format("list_filter(a, lambda m: m.o < 3)")}, '')) AS base_sha256,
  coalesce({text.format("a")}, '') AS spans
FROM f"""
