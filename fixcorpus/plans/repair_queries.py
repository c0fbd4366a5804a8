"""Registered queries of the JSON-lines source, of edits by lines, and of duplicates in a stream."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from ..functions import java
from ..functions import sql as published
from ..operators import batching, edits, workflow
from ..sources import jsonlines
from ..streaming import duplicates, events
from .queries import _count, _normal, _stripped, _twins_sql, query, table


def _scratch(spark, name: str) -> str:
    """A new folder in the one that all executors share, which ``spark.checkpoint.dir`` names; else, for a local master, a temporary one."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{(there or tempfile.mkdtemp(prefix='fixcorpus-')).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("SELECT doc_id, sha256(text) AS digest, length(text)::BIGINT AS n_chars, source FROM documents")
def jsonl_read_back(spark, sf):
    """All documents written as JSON lines and read by the data source, in ranges of 4 MB."""
    at = _scratch(spark, "jsonl")
    table(spark, sf, "documents").select("doc_id", "text", "source").write.json(at)
    jsonlines.register(spark)
    rows = spark.read.format(jsonlines.NAME).option("range_bytes", 4 << 20).load(at)
    said = F.from_json("record", "doc_id long, text string, source string")
    return rows.select(said.alias("r")).select("r.doc_id", F.sha2("r.text", 256).alias("digest"), F.length("r.text").cast("long").alias("n_chars"), "r.source")


@query(f"SELECT source, sum({_count('text')})::BIGINT AS n_tokens, count(DISTINCT sha256({_normal('text')})) AS n_texts FROM documents WHERE {_count('text')} > 20 GROUP BY source")
def sql_functions(spark, sf):
    """Tokens and different normalized texts of each source, by the functions published to SQL."""
    published.register(spark)
    return spark.sql("SELECT source, sum(token_count(text)) AS n_tokens, count(DISTINCT sha2(normalize_code(text), 256)) AS n_texts FROM {docs} WHERE token_count(text) > 20 GROUP BY source", docs=table(spark, sf, "documents"))


# -- edits -----------------------------------------------------------------------------------------

_N = "CASE WHEN text = '' THEN 0 ELSE len(string_split(regexp_replace(text, '\\n\\z', ''), chr(10))) END"
_FILES = f"""WITH d AS (SELECT doc_id, text, string_split(regexp_replace(text, '\\n\\z', ''), chr(10)) AS lines, {_N} AS n FROM documents)"""


@query(_FILES + """, l AS (SELECT doc_id, unnest(range(1, n + 1)) AS i, lines, n FROM d),
errors AS (SELECT doc_id, i FROM l WHERE length(lines[i]) % 13 = 5),
tests AS (SELECT doc_id, i AS a, least(i + 2, n) AS z FROM l WHERE i % 3 = 1 AND length(lines[i]) % 2 = 1),
hit AS (SELECT DISTINCT e.doc_id, e.i, a, z FROM errors e JOIN tests t ON e.doc_id = t.doc_id AND e.i BETWEEN t.a AND t.z),
s AS (SELECT doc_id, count(DISTINCT i) AS inside, count(DISTINCT a) AS spans FROM hit GROUP BY doc_id),
fine AS (SELECT doc_id, spans FROM s WHERE inside = (SELECT count(*) FROM errors e WHERE e.doc_id = s.doc_id) AND spans < (SELECT count(*) FROM tests t WHERE t.doc_id = s.doc_id)),
kept AS (SELECT l.doc_id, string_agg(lines[i] || CASE WHEN i < n OR suffix(text, chr(10)) THEN chr(10) ELSE '' END, '' ORDER BY i) AS pruned
  FROM l JOIN fine USING (doc_id) JOIN (SELECT doc_id, text FROM documents) t USING (doc_id)
  WHERE NOT EXISTS (SELECT 1 FROM hit h WHERE h.doc_id = l.doc_id AND l.i BETWEEN h.a AND h.z) GROUP BY l.doc_id)
SELECT doc_id, spans::INTEGER AS n_dropped, sha256(coalesce(pruned, '')) AS digest FROM fine LEFT JOIN kept USING (doc_id)""")
def broken_tests(spark, sf):
    """Every document as a test file: each third line opens a test if its length is odd; lines of some lengths have errors."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    lines = F.when(F.col("text") != "", F.split(F.regexp_replace("text", r"\n\z", ""), "\n")).otherwise(F.array().cast("array<string>"))
    rows = docs.withColumn("lines", lines)
    said = F.transform(F.col("lines"), lambda x, i: F.when(F.length(x) % 13 == 5, F.concat(F.lit("src/T.java:"), i + 1, F.lit(": error: ';' expected: \n  ^"))).otherwise("Note: some input files use unchecked operations."))
    errors = rows.select("doc_id", F.explode(edits.compiler_errors(F.array_join(said, "\n"))).alias("e")).select("doc_id", "e.line")
    opened = F.filter(F.transform(F.col("lines"), lambda x, i: F.when((i % 3 == 0) & (F.length(x) % 2 == 1), F.struct((i + 1).alias("start"), F.least(i + 3, F.size("lines")).alias("end")))), lambda s: s.isNotNull())
    tests = rows.select("doc_id", F.explode(opened).alias("s")).select("doc_id", "s.start", "s.end")
    dropped = edits.droppable(errors, tests, "doc_id")
    return docs.join(dropped, "doc_id").select("doc_id", F.size("spans").alias("n_dropped"), F.sha2(edits.without_spans(F.col("text"), F.col("spans")), 256).alias("digest"))


@query(_FILES + """, w AS (SELECT *, coalesce(nullif(regexp_extract(text, '[a-z]+'), ''), 'x') AS word, 1 + n // 3 AS a, n // 2 AS z FROM d),
m AS (SELECT *, n >= 1 AND doc_id % 2 = 0 AS two, regexp_extract(lines[a], '^[ \\t]*') AS i, regexp_extract(lines[n], '^[ \\t]*') AS j FROM w),
s AS (SELECT doc_id, text, CASE WHEN n < 1 THEN [] ELSE lines[1:a - 1] || [i || 'def go():', i || '    ' || word, '', i || '        return'] || lines[greatest(z, a - 1) + 1:n - CASE WHEN two AND n > greatest(z, a) THEN 1 ELSE 0 END]
  || CASE WHEN two AND n > greatest(z, a) THEN [j || 'if x:', j || '  ' || word] ELSE [] END END AS l FROM m)
SELECT doc_id, sha256(array_to_string(l, chr(10)) || CASE WHEN suffix(text, chr(10)) THEN chr(10) ELSE '' END) AS digest FROM s""")
def spliced_functions(spark, sf):
    """A function put into every document for its second third of lines, and for each other document another for its last line."""
    word = F.coalesce(F.nullif(F.regexp_extract("text", "[a-z]+", 0), F.lit("")), F.lit("x"))
    docs = table(spark, sf, "documents").select("doc_id", "text", F.size(edits.kept_lines(F.col("text"))).alias("n"), word.alias("word"))
    n, word = F.col("n"), F.col("word")
    a = (1 + F.floor(n / 3)).cast("int")
    z = F.floor(n / 2).cast("int")
    target = lambda name, start, end: F.struct(F.lit(name).alias("name"), start.cast("int").alias("start_line"), end.cast("int").alias("end_line"))
    last = (F.col("doc_id") % 2 == 0) & (n > F.greatest(z, a))
    targets = F.concat(F.array(target("go", a, z)), F.when(last, F.array(target("end", n, n))).otherwise(F.array().cast("array<struct<name:string,start_line:int,end_line:int>>")), F.array(target("none", F.lit(1), F.lit(1))))
    functions = F.create_map(F.lit("go"), F.concat(F.lit("def go():\n        "), word, F.lit("\n  \n            return")), F.lit("end"), F.concat(F.lit("   if x:\n     "), word))
    return docs.select("doc_id", F.sha2(edits.spliced(F.col("text"), targets, functions), 256).alias("digest"))


_TESTED = f"""{_FILES}, s AS (SELECT doc_id, coalesce(nullif(regexp_extract(text, '[a-z]+'), ''), 'x') AS word, n FROM d)"""


@query(_TESTED + """ SELECT doc_id, CASE WHEN n % 3 = 0 THEN 'no test function' WHEN n % 3 = 1 AND NOT starts_with('f_' || word, 'test') THEN 'redefines f_' || word END AS fault,
  sha256('x = 1' || chr(10) || CASE WHEN n % 3 = 0 THEN '' ELSE 'def test_' || word || '():' || chr(10) || '    return f_' || word || '()' || chr(10) END || 'y = 2' || chr(10)) AS pruned FROM s""")
def pruned_tests(spark, sf):
    """A test file for every document, named by its first word: what is wrong with it, and the file without a helper of two decorators."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    word = F.coalesce(F.nullif(F.regexp_extract("text", "[a-z]+", 0), F.lit("")), F.lit("x"))
    rows = docs.select("doc_id", word.alias("word"), (F.size(edits.kept_lines(F.col("text"))) % 3).alias("kind"))
    test = F.concat(F.lit("def test_"), F.col("word"), F.lit("():\n    return f_"), F.col("word"), F.lit("()\n"))
    helper = F.concat(F.lit("@mark\n@cached(9)\ndef "), F.when(F.col("kind") == 1, F.concat(F.lit("f_"), F.col("word"))).otherwise("helper"), F.lit("(a):\n    def test_inner():\n        pass\n    return a\n"))
    rows = rows.withColumn("source", F.concat(F.lit("x = 1\n"), F.when(F.col("kind") == 0, "").otherwise(test), helper, F.lit("y = 2\n")))
    rows = rows.withColumn("nodes", java.code_nodes("source", F.lit("python")))
    own = F.array(F.concat(F.lit("f_"), F.col("word")))
    pruned = edits.without_definitions(F.col("source"), F.col("nodes"), F.array_append(own, F.lit("helper")))
    return rows.select("doc_id", edits.test_source_fault(F.col("nodes"), own).alias("fault"), F.sha2(pruned, 256).alias("pruned"))


# -- replies ---------------------------------------------------------------------------------------

_BLOCK = "regexp_extract(t, '(?s)```[a-zA-Z0-9_+-]*\\n(.*?)```', 1)"


@query(f"""WITH r AS (SELECT doc_id, length(text) % 5 - 2 AS c, CASE doc_id % 3 WHEN 0 THEN 'Here:' || chr(10) || '```diff' || chr(10) || '--- a' || chr(10) || '+++ b' || chr(10) || text || chr(10) || '```' || chr(10) || source
  WHEN 1 THEN 'So --- a' || chr(10) || '+++ b' || chr(10) || text ELSE '### FIXED CODE ' || chr(10) || text END AS t FROM documents),
b AS (SELECT doc_id, c, {_stripped(f"CASE WHEN {_BLOCK} <> '' THEN {_BLOCK} ELSE t END")} AS b FROM r), h AS (SELECT *, position('--- ' IN b) AS header FROM b)
SELECT doc_id, sha256(CASE WHEN starts_with(b, '### FIXED CODE ' || chr(10)) THEN {_stripped("substr(b, 17)")} ELSE b END) AS code,
  CASE WHEN header > 0 AND contains(substr(b, header), chr(10) || '+++ ') THEN sha256(substr(b, header) || chr(10)) END AS diff, greatest(0, least(1, c))::DOUBLE AS confidence FROM h""")
def reply_parts(spark, sf):
    """Replies around every document, a diff in a fence, a diff after words or titled code: their code, diff and confidence."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "source")
    kind = F.col("doc_id") % 3
    fenced = F.concat(F.lit("Here:\n```diff\n--- a\n+++ b\n"), "text", F.lit("\n```\n"), "source")
    reply = F.when(kind == 0, fenced).when(kind == 1, F.concat(F.lit("So --- a\n+++ b\n"), "text")).otherwise(F.concat(F.lit("### FIXED CODE \n"), "text"))
    said = F.concat(F.lit('I say {"confidence": '), F.length("text") % 5 - 2, F.lit("} of "), "text")
    return docs.select("doc_id", F.sha2(workflow.code_of(reply), 256).alias("code"), F.sha2(workflow.diff_of(reply), 256).alias("diff"), workflow.confidence_of(workflow.first_object(said)).alias("confidence"))


# -- a stream --------------------------------------------------------------------------------------


@query(_twins_sql("sha256(b || chr(1) || f)"))
def stream_originals(spark, sf):
    """All documents as a stream: each pair with its original's id, from state that outlives a restart."""
    at, provider = _scratch(spark, "stream"), "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        pairs = _stream(spark, sf, "documents").select("doc_id", F.col("doc_id").alias("ord"), F.col("doc_id").alias("bug_id"), *_sides())
        run = duplicates.with_originals(pairs, "exact").writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
        run.awaitTermination()
    finally:
        spark.conf.set(provider, before)
    return spark.read.parquet(f"{at}/out").select(F.col("bug_id").alias("doc_id"), "duplicate_of")


_LOGS = ("click", "view", "purchase")
_LOG_SQL = ", ".join(f"count(*) FILTER (event_type = '{x}') AS n_{x}, max_by(value, event_id) FILTER (event_type = '{x}') AS last_{x}" for x in _LOGS)


@query(f"""SELECT user_id AS key, count(*) AS n, min(event_id) AS first_seq, max(event_id) AS last_seq, (max(event_id) - min(event_id) + 1 - count(*))::BIGINT AS missing, {_LOG_SQL} FROM events GROUP BY user_id""")
def event_logs(spark, sf):
    """All events appended from a stream, and all once more from another one without its checkpoint; the state of each user."""
    at = _scratch(spark, "events")
    rows = _stream(spark, sf, "events").where("user_id IS NOT NULL").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.col("event_type").alias("log"), "value")
    for turn in ("first", "again"):
        run = rows.writeStream.foreachBatch(events.appender(f"{at}/{turn}")).option("checkpointLocation", f"{at}/state-{turn}").trigger(availableNow=True).start()
        run.awaitTermination()
    return events.folded(events.logged(spark, f"{at}/first", f"{at}/again"), _LOGS)


def _stream(spark, sf, name):
    """A table as a stream of its files; a table of one file is a file of its folder, since a stream reads folders."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf}/{name}.parquet")
    folder = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    reader = spark.readStream.schema(table(spark, sf, name).schema)
    return reader.parquet(f"{sf}/{name}.parquet") if folder else reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf)


def _sides():
    buggy = F.concat("text", F.when(F.col("doc_id") % 3 == 0, "  /* c */  ").otherwise(""))
    return buggy.alias("buggy_code"), F.concat(buggy, F.lit("\nend // d")).alias("fixed_code")


_LENGTHS = """SELECT doc_id, coalesce(len(string_split(text, ' ')), 0)::BIGINT AS length, row_number() OVER (ORDER BY coalesce(len(string_split(text, ' ')), 0), md5(doc_id::VARCHAR), doc_id) - 1 AS k FROM documents"""


@query(f"SELECT doc_id, length, k // 32 AS batch, k % 32 AS slot FROM ({_LENGTHS})")
def length_batches(spark, sf):
    """All documents in batches of 32 of about the same number of words."""
    return batching.length_batches(table(spark, sf, "documents").select("doc_id", _words()), F.col("words"), F.col("doc_id"), 32).drop("words")


@query(f"""SELECT k // 32 AS batch, count(*) AS n, least(2048, ceil(max(least(length, 2048)) / 8) * 8)::BIGINT AS width, sum(least(length, 2048))::BIGINT AS used,
(count(*) * least(2048, ceil(max(least(length, 2048)) / 8) * 8) - sum(least(length, 2048)))::BIGINT AS wasted FROM ({_LENGTHS}) GROUP BY 1""")
def batch_paddings(spark, sf):
    """Width and waste of those batches, with rows as the encoder cuts them: at most 2,048 words."""
    return batching.paddings(length_batches(spark, sf), most=2048)


def _words():
    return F.size(F.split("text", " ")).alias("words")
