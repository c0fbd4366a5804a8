"""More registered queries: steps of a repair workflow, localization, Python pairs and tables of repositories.

Ids of the driver's tables choose between the cases of each operator; every query reads its whole table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import regions, text
from ..operators import corpus, localization, pycorpus, review, runs, search, workflow
from ..sources import repository
from .queries import _LINED, _SUSPECTS, _count, _counted, _lined, _marked, _stripped, _suspects, _tokens, query, table


def _pick(column, values):
    """One of ``values`` by a number modulo their count."""
    own = F.array(*[v if not isinstance(v, (str, type(None))) else F.lit(v).cast("string") for v in values])
    return F.get(own, (column % len(values)).cast("int"))


def _quoted(values) -> str:
    return ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values)


# -- patches and tests -------------------------------------------------------------------------------

_HEADS = ("", "--- a/x.py\n+++ b/x.py\n", "--- /dev/null\n+++ b/new/y.py\t2020\n", "--- a/../up.py\n+++ b/up.py\n", "+++ b/only.py\n", "--- /etc/x\n+++ b/x\n", "--- a/s.py\n+++ b/t.py\n")
_HEADS_SQL = "[" + ", ".join("'" + h.replace("\n", "' || chr(10) || '").replace("\t", "' || chr(9) || '") + "'" for h in _HEADS) + "]"


@query(f"""WITH p AS (SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN ' ' ELSE {_HEADS_SQL}[doc_id % 7 + 1] || text END AS p FROM documents),
h AS (SELECT doc_id, p, list_filter(list_transform(list_filter(string_split(p, chr(10)), lambda x: starts_with(x, '--- ') OR starts_with(x, '+++ ')), lambda x: {_stripped("split_part(substr(x, 5), chr(9), 1)")}), lambda x: x <> '/dev/null') AS named FROM p),
f AS (SELECT doc_id, p, list_transform(named, lambda x: regexp_replace(x, '^[ab]/', '')) AS f FROM h),
u AS (SELECT *, list_filter(f, lambda x: x = '' OR starts_with(x, '/') OR list_contains(string_split(x, '/'), '..')) AS u FROM f),
e AS (SELECT *, CASE WHEN {_stripped("p")} = '' THEN 'empty' WHEN len(u) > 0 THEN 'unsafe: ' || u[1] WHEN len(f) = 0 OR NOT contains(p, chr(10) || '+++ ') THEN 'no headers' END AS error FROM u)
SELECT doc_id, error, CASE WHEN error IS NULL THEN array_to_string(list_filter(f, lambda x, i: list_position(f, x) = i), ',') END AS files FROM e""")
def patch_files(spark, sf):
    patch = F.when(F.col("doc_id") % 13 == 0, " ").otherwise(F.concat(_pick(F.col("doc_id"), _HEADS), "text"))
    rows = table(spark, sf, "documents").select("doc_id", review.patch_files(patch).alias("p"))
    return rows.select("doc_id", "p.error", F.array_join("p.files", ",").alias("files"))


_OUTCOMES = ("passed", "failed", "error", "passed", "skipped")
_MESSAGES = (None, "AssertionError: 1 != 2", "NameError: x", "ImportError", None, "ValueError: bad", "SyntaxErrorX")


def _cases(spark, sf):
    e = F.col("event_id")
    outcome = F.when(F.col("user_id") % 3 == 0, "passed").otherwise(_pick(e, _OUTCOMES))
    message = F.when(F.col("user_id") % 6 == 0, F.lit(None).cast("string")).when(outcome.isin("failed", "error"), _pick(e, _MESSAGES))
    return table(spark, sf, "events").select("user_id", e.alias("ord"), F.concat(F.lit("m"), e % 50, F.lit("::t"), e).alias("test_id"), outcome.alias("outcome"), message.alias("message"))


_CASES = f"""WITH o AS (SELECT user_id, event_id AS ord, 'm' || event_id % 50 || '::t' || event_id AS test_id, CASE WHEN user_id % 3 = 0 THEN 'passed' ELSE [{_quoted(_OUTCOMES)}][event_id % 5 + 1] END AS outcome, event_id FROM events),
c AS (SELECT user_id, ord, test_id, outcome, CASE WHEN user_id % 6 <> 0 AND outcome IN ('failed', 'error') THEN [{_quoted(_MESSAGES)}][event_id % 7 + 1] END AS message FROM o)"""


@query(_CASES + f""", h AS (SELECT *, outcome = 'failed' AND NOT regexp_matches(coalesce(message, ''), '^({"|".join(review.BROKEN)})') AS hit FROM c),
g AS (SELECT user_id, count(*) AS n, count(*) FILTER (hit) AS k, string_agg(test_id, ',' ORDER BY ord) FILTER (hit) AS ids, arg_min(test_id || ': ' || message, ord) FILTER (message IS NOT NULL) AS first FROM h GROUP BY user_id)
SELECT user_id, k > 0 AS accepted, CASE WHEN k > 0 THEN k || ' of ' || n || ' test(s) fail on the unpatched code, reproducing the issue.' WHEN first IS NOT NULL THEN 'The test is broken rather than failing on the bug (' || first || ').'
ELSE 'Every test passes on the unpatched code, so none of them reproduces the issue.' END AS reason, coalesce(ids, '') AS reproducing FROM g""")
def reproduction_accepted(spark, sf):
    return review.reproductions(_cases(spark, sf), ("user_id",)).withColumn("reproducing", F.array_join("reproducing", ","))


@query(_CASES + " SELECT user_id, test_id, outcome FROM c WHERE regexp_matches(split_part(test_id, '::', 1), '^(m1|m27)(\\.|$)')".replace("\\\\", "\\"))
def scoped_baseline(spark, sf):
    return review.scoped(_cases(spark, sf), F.array(F.lit("m1"), F.lit("m27"))).select("user_id", "test_id", "outcome")


@query(_CASES + """, t AS (SELECT user_id, count(*) FILTER (outcome = 'passed') AS passed, count(*) FILTER (outcome IN ('failed', 'error')) AS failed FROM c GROUP BY user_id)
SELECT *, CASE WHEN failed = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM t""")
def test_totals(spark, sf):
    return review.test_totals(_cases(spark, sf), ("user_id",))


@query("""WITH a AS (SELECT user_id, event_id, CASE WHEN event_id % 5 = 0 THEN ' ' ELSE event_type || (event_id % 3) END AS patch FROM events)
SELECT user_id, event_id AS attempt, trim(patch) <> '' AND row_number() OVER (PARTITION BY user_id, patch ORDER BY event_id) > 1 AS repeated FROM a""")
def repeated_patches(spark, sf):
    e = F.col("event_id")
    rows = table(spark, sf, "events").select("user_id", e.alias("attempt"), F.when(e % 5 == 0, " ").otherwise(F.concat("event_type", e % 3)).alias("patch"))
    return review.repeated_patches(rows, "user_id").select("user_id", "attempt", "repeated")


@query("""WITH a AS (SELECT user_id, event_id AS attempt, CASE WHEN event_id % 9 = 0 THEN 2 WHEN event_id % 4 = 0 THEN 1 ELSE 0 END AS rank, event_id % 5 AS broken, event_id % 3 AS fixed, event_id % 2 = 0 AS applied, event_id % 7 AS n FROM events),
b AS (SELECT *, (min({'r': -rank, 'b': broken, 'f': -fixed, 'a': NOT applied, 'n': attempt}) OVER (PARTITION BY user_id ORDER BY attempt ROWS UNBOUNDED PRECEDING)).n AS best, rank = 2 OR (applied AND n = 0) OR attempt >= 5000 AS finished FROM a)
SELECT user_id, attempt, finished, CASE WHEN finished THEN best ELSE attempt END AS shown FROM b""")
def shown_attempts(spark, sf):
    e = F.col("event_id")
    status = F.when(e % 9 == 0, "solved").when(e % 4 == 0, "unverified").otherwise("failed")
    rows = table(spark, sf, "events").select("user_id", e.alias("attempt"), status.alias("status"), (e % 5).alias("broken"), (e % 3).alias("fixed"), (e % 2 == 0).alias("applied"), (e % 7).alias("n_tests"))
    return review.shown_attempts(rows, "user_id", 5000).select("user_id", "attempt", "finished", "shown")


def _test_lists(key):
    """Arrays of test ids of 0 to 11, 0 to 3 and 0 to 2 tests, which overlap."""
    made = lambda n, step: F.transform(F.filter(F.sequence(F.lit(0), F.lit(11)), lambda i: i < key % n), lambda i: F.concat(F.lit("t"), (i * step).cast("string")))
    return made(12, 1), made(4, 3), made(3, 2)


def _lists_sql(key: str) -> str:
    return ", ".join(f"list_transform(range(0, {key} % {n}), lambda i: 't' || (i * {step})) AS {name}" for n, step, name in ((12, 1, "broken"), (4, 3, "repro"), (3, 2, "still")))


@query(f"WITH l AS (SELECT doc_id, {_lists_sql('doc_id')} FROM documents), a AS (SELECT doc_id, broken || repro || still AS x FROM l) SELECT doc_id, array_to_string(list_filter(x, lambda t, i: list_position(x, t) = i), ',') AS tests FROM a")
def failed_order(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(review.failed_order(*_test_lists(F.col("doc_id"))), ",").alias("tests"))


def _section_sql(title: str, tests: str) -> str:
    line = "'- ' || t || CASE WHEN t = 't1' OR length(text) = 0 THEN '' ELSE ': ' || CASE WHEN length(text) <= 300 THEN text ELSE substr(text, 1, 300) || chr(10) || '... (truncated)' END END"
    return f"CASE WHEN len({tests}) > 0 THEN ['{title}:'] || list_transform({tests}[1:8], lambda t: {line}) || CASE WHEN len({tests}) > 8 THEN ['- ... and ' || (len({tests}) - 8) || ' more'] ELSE [] END ELSE [] END"


@query(f"""WITH l AS (SELECT doc_id, text, {_lists_sql('doc_id')} FROM documents), r AS (SELECT *, list_filter(still, lambda t: NOT list_contains(repro, t)) AS rest, {_stripped('text')} AS bare FROM l),
b AS (SELECT doc_id, ['Attempt ' || doc_id || ' was rejected: ' || CASE WHEN doc_id % 2 = 0 THEN 'why' ELSE 'no reason recorded' END] || CASE WHEN doc_id % 3 = 0 THEN ['This patch is identical to an earlier rejected attempt. Take a different approach this time.'] ELSE [] END ||
CASE WHEN doc_id % 10 = 9 OR bare = '' THEN ['No usable patch was produced. none'] WHEN doc_id % 4 = 3 THEN ['The patch could not be applied (FAILED): none', 'Previous patch (rejected, do not repeat it):', CASE WHEN length(bare) <= 3000 THEN bare ELSE substr(bare, 1, 3000) || chr(10) || '... (truncated)' END]
ELSE {_section_sql(review.TITLES[0], 'repro')} || {_section_sql(review.TITLES[1], 'broken')} || {_section_sql(review.TITLES[2], 'rest')} || ['Previous patch (rejected, do not repeat it):', CASE WHEN length(bare) <= 3000 THEN bare ELSE substr(bare, 1, 3000) || chr(10) || '... (truncated)' END] END AS lines FROM r)
SELECT doc_id, sha256(array_to_string(lines, chr(10))) AS feedback FROM b""")
def attempt_feedback(spark, sf):
    d = F.col("doc_id")
    broken, repro, still = _test_lists(d)
    messages = F.map_from_arrays(F.transform(F.sequence(F.lit(0), F.lit(22)), lambda i: F.concat(F.lit("t"), i.cast("string"))), F.transform(F.sequence(F.lit(0), F.lit(22)), lambda i: F.when(i != 1, F.col("text"))))
    applied = d % 4 != 3
    said = review.feedback(d, F.when(d % 2 == 0, "why"), F.when(d % 10 != 9, F.col("text")), applied, F.when(applied, "APPLIED").otherwise("FAILED"), F.lit("none"), d % 3 == 0, repro, broken, still, messages)
    return table(spark, sf, "documents").select("doc_id", F.sha2(said, 256).alias("feedback"))


_KINDS = [*review.REFLECTIONS, "other"]


def _cause_sql(cause: str) -> str:
    quoted = cause.replace("'", "''")
    return f"replace(replace(replace('{quoted}', '{{0}}', 'E1'), '{{1}}', evidence), '{{2}}', verdict)"


@query(f"""WITH l AS (SELECT doc_id, text, [{_quoted(_KINDS)}][doc_id % {len(_KINDS)} + 1] AS kind, CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN ' (t0: m)' ELSE ' (t1)' END AS evidence, CASE WHEN doc_id % 2 = 0 THEN 'why.' ELSE 'No test shows that the patch fixes the issue.' END AS verdict,
len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^[+-]') AND NOT regexp_matches(x, '^(\\+\\+\\+|---)'))) AS changed FROM documents),
c AS (SELECT *, CASE kind {" ".join(f"WHEN '{k}' THEN {_cause_sql(cause)}" for k, (cause, _) in review.REFLECTIONS.items())} ELSE verdict END AS cause,
CASE kind {" ".join(f"WHEN '{k}' THEN [{_quoted(todo)}]" for k, (_, todo) in review.REFLECTIONS.items())} ELSE [{_quoted(review.REFLECTIONS['unknown'][1])}] END AS todo FROM l)
SELECT doc_id, cause AS root_cause, 'The previous patch (' || CASE WHEN {_stripped('text')} = '' THEN 'no patch' ELSE changed || ' changed line(s)' END || ') was rejected: ' || CASE WHEN doc_id % 2 = 0 THEN 'why.' ELSE 'see the failing tests' END AS patch_analysis,
array_to_string(todo || ['Take a different approach from the previous patch.'], '|') AS suggested, cause || ' ' || array_to_string(todo, ' ') || ' Do not repeat the previous patch.' AS guidance FROM c""".replace("\\\\", "\\"))
def reflection_by_rule(spark, sf):
    d = F.col("doc_id")
    tests = F.when(d % 3 == 1, F.array(F.lit("t0"))).when(d % 3 == 2, F.array(F.lit("t1"))).otherwise(F.array().cast("array<string>"))
    made = review.reflection(_pick(d, _KINDS), F.col("text"), F.when(d % 2 == 0, "why."), F.lit("E1"), tests, F.create_map(F.lit("t0"), F.lit("m")))
    rows = table(spark, sf, "documents").select("doc_id", made.alias("r"))
    return rows.select("doc_id", "r.root_cause", "r.patch_analysis", F.array_join("r.suggested_changes", "|").alias("suggested"), F.col("r.repair_guidance").alias("guidance"))


_SAID = ("AssertionError: x", "ValueError: y", "a.b.MyException", "plain words", "", None, "Errors 3", "SystemExit")


@query(f"""WITH l AS (SELECT doc_id, text, [{_quoted(_SAID)}][doc_id % 8 + 1] AS m, doc_id % 5 AS broken, doc_id % 3 AS failed FROM documents)
SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN CASE doc_id % 3 WHEN 0 THEN 'syntax_error' WHEN 1 THEN 'compilation_error' ELSE 'unknown' END WHEN doc_id % 7 = 0 THEN 'patch_application_error' WHEN doc_id % 17 = 0 THEN 'syntax_error' WHEN broken = 4 THEN 'regression'
WHEN m IN ('ValueError: y', 'a.b.MyException', 'SystemExit') THEN 'runtime_error' WHEN coalesce(m, '') <> '' THEN 'logic_error' WHEN failed > 0 THEN 'test_failure' ELSE 'unknown' END AS kind FROM l""")
def failure_type(spark, sf):
    d = F.col("doc_id")
    error = F.when(d % 3 == 0, "x is not valid Python").when(d % 3 == 1, "no patch").otherwise("")
    kind = runs.failure_type(F.when(d % 11 == 0, " ").otherwise(F.concat(F.lit("p"), F.col("text"))), error, F.when(d % 7 == 0, "REJECTED").otherwise("APPLIED"), F.when(d % 17 == 0, "syntax").otherwise("tests"), F.when(d % 5 == 4, 1).otherwise(0), d % 3, F.array(_pick(d, _SAID)))
    return table(spark, sf, "documents").select("doc_id", kind.alias("kind"))


# -- localization ------------------------------------------------------------------------------------

_NAMES = ("a/f.py", "f.java", "x/page.HTML", ".rb", "noext", "y.test.yml")


@query(_LINED + f""", m AS (SELECT doc_id, lines, a, z, n, [{_quoted(_NAMES)}][doc_id % 6 + 1] AS path FROM g), k AS (SELECT *, CASE doc_id % 6 WHEN 0 THEN '# ' WHEN 5 THEN '# ' WHEN 2 THEN '<!-- ' ELSE '// ' END AS o, CASE WHEN doc_id % 6 = 2 THEN ' -->' ELSE '' END AS c FROM m)
SELECT doc_id, sha256(array_to_string(lines[1:a - 1] || list_transform(lines[a:z], lambda x: o || x || c) || ['<FILL_ME>'] || lines[z + 1:n], chr(10))) AS prompt FROM k""")
def localization_prompt(spark, sf):
    return _lined(spark, sf).select("doc_id", F.sha2(localization.commented_prompt(F.col("lines"), F.col("start"), F.col("end"), _pick(F.col("doc_id"), _NAMES)), 256).alias("prompt"))


@query(_SUSPECTS + """, b AS (SELECT doc_id, number, score FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, number) = 1), w AS (SELECT doc_id, list(line ORDER BY number) AS a FROM m GROUP BY doc_id)
SELECT b.doc_id, number::BIGINT AS number, score, sha256(array_to_string(a[1:number - 1] || ['// ' || a[number]] || ['<FILL_ME>'] || a[number + 1:len(a)], chr(10))) AS prompt FROM b JOIN w ON b.doc_id = w.doc_id""")
def localized_prompt(spark, sf):
    issue = table(spark, sf, "benchmark").groupBy().agg(F.min_by("text", "item_id").alias("issue"))
    rows = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("f"), "doc_id", F.lit(".java")).alias("path"), _marked().alias("lines")).join(F.broadcast(issue), F.lit(True))
    found = localization.localized(rows, search.issue_tokens(F.col("issue")), "doc_id")
    return found.select("doc_id", F.col("number").cast("long").alias("number"), "score", F.sha2("prompt", 256).alias("prompt"))


@query("""WITH c AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN './src/f' WHEN 1 THEN 'lib\\f' ELSE 'f' END || page_id % 20 || '.py' AS file FROM pages), f AS (SELECT 'src/f' || n || '.py' AS path FROM range(0, 25) t(n))
SELECT f.path, c.page_id FROM f JOIN c ON regexp_extract(replace(c.file, '\\', '/'), '[^/]*$') = regexp_extract(f.path, '[^/]*$')""".replace("\\\\", "\\"))
def chunks_of_files(spark, sf):
    p = F.col("page_id")
    chunks = table(spark, sf, "pages").select("page_id", F.concat(_pick(p, ("./src/f", "lib\\f", "f")), p % 20, F.lit(".py")).alias("file"))
    files = spark.range(25).select(F.concat(F.lit("src/f"), "id", F.lit(".py")).alias("path"))
    return localization.chunks_of(files, chunks).select("path", "chunk.page_id")


@query("""WITH l AS (SELECT doc_id, doc_id % 40 AS line FROM documents), s(name, a, z, p) AS (VALUES ('outer', 1, 30, 0), ('left', 3, 9, 1), ('twin', 5, 11, 2), ('deep', 7, 8, 3), ('far', 35, 36, 4))
SELECT l.doc_id, (SELECT arg_min(name, (z - a) * 10 + p) FROM s WHERE a <= l.line AND l.line <= z) AS method FROM l""")
def innermost_method(spark, sf):
    span = lambda name, a, z: F.struct(F.lit(name).alias("name"), F.lit(a).alias("start_line"), F.lit(z).alias("end_line"))
    spans = F.array(span("outer", 1, 30), span("left", 3, 9), span("twin", 5, 11), span("deep", 7, 8), span("far", 35, 36))
    return table(spark, sf, "documents").select("doc_id", localization.innermost(spans, F.col("doc_id") % 40)["name"].alias("method"))


@query("""WITH r AS (SELECT doc_id, source, text, 'REGION ' AS h FROM documents) SELECT doc_id, sha256('REGION 1' || chr(10) || 'FILE: ' || source || chr(10) || 'SUSPICIOUS LINES: ' || (doc_id % 9) || '-' || (doc_id % 9 + 2) || chr(10) || 'SCORE: ' || printf('%.4f', (doc_id % 16) / 8.0::DOUBLE) || chr(10) || chr(10) ||
'ORIGINAL SUSPICIOUS CODE:' || chr(10) || text || chr(10) || chr(10) || 'IR4 REPRESENTATION:' || chr(10) || '// ' || text) AS sections FROM r""")
def region_sections(spark, sf):
    d = F.col("doc_id")
    one = F.struct(F.col("source").alias("file"), (d % 9).alias("start_line"), (d % 9 + 2).alias("end_line"), ((d % 16) / 8.0).alias("score"), F.col("text").alias("code"), F.concat(F.lit("// "), "text").alias("prompt"))
    return table(spark, sf, "documents").select("doc_id", F.sha2(localization.region_sections(F.array(one)), 256).alias("sections"))


_CHUNKS = (("python", "class", "a.py"), ("python", "function", "test_a.py"), ("java", "method", "A.java"), ("go", "function", "a.go"), ("python", "method", "b.py"))


@query(f"""WITH c AS (SELECT page_id, [{_quoted(x[0] for x in _CHUNKS)}] AS l, page_id % 5 AS i FROM pages)
SELECT page_id, CASE i WHEN 0 THEN 'java' WHEN 1 THEN 'java' WHEN 2 THEN 'java' ELSE 'python' END AS language FROM c""")
def repair_language(spark, sf):
    chunks = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("language", "type", "file"), x, strict=True)]) for x in _CHUNKS])
    own = F.slice(chunks, (F.col("page_id") % 5 + 1).cast("int"), F.lit(5))
    return table(spark, sf, "pages").select("page_id", localization.repair_language(own, F.lit("none"), workflow.is_test_file).alias("language"))


@query("SELECT page_id, url FROM pages WHERE page_id % 3 <> 0")
def embedded_chunks(spark, sf):
    rows = table(spark, sf, "pages").select("page_id", "url", _pick(F.col("page_id"), ("class", "function", None)).alias("type"))
    return localization.embedded(rows).select("page_id", "url")


# -- Python pairs ------------------------------------------------------------------------------------


def _py_pairs(spark, sf):
    d = F.col("doc_id")
    other = F.array_join(F.transform(text.split_lines(F.col("text")), lambda x: F.concat(F.lit("\x01"), x)), "\n")
    end = F.concat("text", F.when(F.col("text").endswith("\n") | (F.col("text") == ""), "").otherwise("\n"), F.lit("\x01end"))
    return table(spark, sf, "documents").select("doc_id", F.col("text").alias("buggy"), F.when(d % 4 == 0, F.col("text")).when(d % 4 == 1, "").when(d % 4 == 2, other).otherwise(end).alias("fixed"))


_PY = r"""WITH l AS (SELECT doc_id, doc_id % 4 AS k, CASE WHEN text = '' THEN [] ELSE string_split(regexp_replace(text, '\n\z', ''), chr(10)) END AS a FROM documents), n AS (SELECT *, len(a) AS n FROM l),
r AS (SELECT *, CASE WHEN k = 0 OR (k < 3 AND n = 0) THEN 'no_change' WHEN k = 1 THEN 'blank_target' END AS skipped FROM n)"""


@query(_PY + """ SELECT doc_id, skipped, CASE WHEN k = 0 OR (k < 3 AND n = 0) THEN NULL WHEN k = 3 THEN n ELSE 0 END AS buggy_start, CASE WHEN k = 0 OR (k < 3 AND n = 0) THEN NULL ELSE n END AS buggy_end,
CASE WHEN skipped IS NOT NULL THEN NULL WHEN k = 2 THEN sha256(array_to_string(['# BUGGY CODE'] || list_transform(a, lambda x: CASE WHEN x = '' THEN '#' ELSE '# ' || x END) || ['<FILL_ME>'], chr(10))) ELSE sha256(array_to_string(a || ['# BUGGY CODE', '<FILL_ME>'], chr(10))) END AS input,
CASE WHEN skipped IS NOT NULL THEN NULL WHEN k = 2 THEN sha256(array_to_string(list_transform(a, lambda x: chr(1) || x), chr(10))) ELSE sha256(chr(1) || 'end') END AS output, CASE WHEN skipped IS NULL THEN true END AS reconstruction_ok FROM r""")
def pycorpus_build(spark, sf):
    rows = pycorpus.rows(_py_pairs(spark, sf))
    bound = lambda n: F.col(f"region.{n}").cast("long").alias(n)
    return rows.select("doc_id", "skipped", bound("buggy_start"), bound("buggy_end"), F.sha2("input", 256).alias("input"), F.sha2("output", 256).alias("output"), "reconstruction_ok")


@query(_PY + " SELECT count(*) AS original, count(*) FILTER (skipped IS NULL) AS processed, count(skipped) AS skipped FROM r")
def pycorpus_summary(spark, sf):
    return pycorpus.summary(pycorpus.rows(_py_pairs(spark, sf)))


@query(_LINED + """, b AS (SELECT doc_id, lines, n, doc_id % 7 AS s, doc_id % 11 - 1 AS e FROM g), x AS (SELECT *, CASE WHEN s < 1 THEN 'start_before_first' WHEN e < s - 1 THEN 'end_before_start' WHEN e > n THEN 'end_after_last' END AS error FROM b)
SELECT doc_id, error, CASE WHEN error IS NULL THEN sha256(array_to_string(lines[s:e], chr(10))) END AS lines, CASE WHEN error IS NULL THEN e < s END AS is_deletion FROM x""")
def fixed_region_bounds(spark, sf):
    made = regions.fixed_region(F.col("lines"), (F.col("doc_id") % 7).cast("int"), (F.col("doc_id") % 11 - 1).cast("int"))
    rows = _lined(spark, sf).select("doc_id", made.alias("r"))
    return rows.select("doc_id", "r.error", F.sha2(F.array_join("r.lines", "\n"), 256).alias("lines"), "r.is_deletion")


# -- lengths, splits, samples ------------------------------------------------------------------------


@query(f"""WITH d AS (SELECT {_count('text')} AS n FROM documents), s AS (SELECT unnest([{{'series': 'input', 'n': n}}, {{'series': 'output', 'n': n}}, {{'series': 'total', 'n': 2 * n}}, {{'series': 'input_kept', 'n': CASE WHEN n <= 300 THEN n END}}]) AS s FROM d)
SELECT s.series AS series, count(s.n) AS count, sum(s.n)::BIGINT AS total, min(s.n) AS min, max(s.n) AS max FROM s WHERE s.n IS NOT NULL GROUP BY 1""")
def token_series(spark, sf):
    n = F.col("n")
    rows = _counted(spark, sf).select(n.alias("input_tokens"), n.alias("output_tokens"), F.when(n > 300, "input_too_long").alias("reason"))
    return corpus.token_stats(corpus.token_series(rows), ["series"]).select("series", "count", "total", "min", "max")


@query(f"WITH d AS (SELECT lang, {_count('text')} AS n FROM documents) SELECT lang, count(*) AS seen, count(*) FILTER (n + 2 + 2 > 300) AS truncated FROM d GROUP BY lang")
def truncation_counts(spark, sf):
    return _counted(spark, sf).groupBy("lang").agg(*corpus.truncations(F.col("n"), F.lit(2), 300))


@query("SELECT s AS split FROM (VALUES ('train'), ('validation'), ('test')) t(s) WHERE s NOT IN (SELECT CASE WHEN doc_id % 2 = 0 THEN 'train' ELSE 'test' END FROM documents)")
def empty_splits(spark, sf):
    rows = table(spark, sf, "documents").select(F.when(F.col("doc_id") % 2 == 0, "train").otherwise("test").alias("split"))
    return corpus.empty_splits(rows, {"train": 0.9, "validation": 0.05, "test": 0.05})


@query("SELECT doc_id FROM documents ORDER BY sha256('42:' || doc_id::VARCHAR), doc_id LIMIT 50")
def seeded_sample(spark, sf):
    return corpus.sampled(table(spark, sf, "documents").select("doc_id"), "doc_id", 50)


@query(f"WITH d AS (SELECT doc_id, {_count('text')} AS n FROM documents) SELECT doc_id, 2 * n AS total FROM d WHERE doc_id % 3 <> 0 AND 2 * n <= 800")
def trainable_rows(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.concat("text", F.when(F.col("doc_id") % 3 != 0, "<FILL_ME>").otherwise("")).alias("input"), _tokens(F.col("text")).alias("input_tokens"))
    return corpus.trainable(rows.withColumn("output_tokens", F.col("input_tokens")), 800).select("doc_id", corpus.total_tokens().alias("total"))


# -- repositories ------------------------------------------------------------------------------------


@query(f"SELECT conv_id, turn, sha256({_stripped('''role || chr(10) || chr(10) || CASE WHEN conv_id % 4 = 0 THEN '' ELSE text END''')}) AS issue FROM conversations")
def issue_text(spark, sf):
    made = repository.issue_text(F.col("role"), F.when(F.col("conv_id") % 4 != 0, F.col("text")))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.sha2(made, 256).alias("issue"))


@query("""SELECT doc_id AS number, lang AS title, sha256(CASE WHEN doc_id % 4 = 0 THEN '' ELSE text END) AS body, source AS labels, (doc_id % 5)::BIGINT AS comments FROM documents WHERE doc_id % 3 <> 0""")
def open_issues(spark, sf):
    d = F.col("doc_id")
    item = F.struct(d.alias("number"), F.col("lang").alias("title"), F.when(d % 4 != 0, F.col("text")).alias("body"), F.array(F.struct(F.col("source").alias("name"))).alias("labels"), (d % 5).alias("comments"), F.when(d % 3 == 0, F.struct(F.lit("u").alias("url"))).alias("pull_request"))
    rows = table(spark, sf, "documents").select(F.inline(repository.open_issues(F.concat(F.lit("["), F.to_json(item), F.lit("]")))))
    return rows.select("number", "title", F.sha2("body", 256).alias("body"), F.array_join("labels", ",").alias("labels"), "comments")


_FOLDERS = ("src/", "a/node_modules/b/", ".git/", "x/buildings/", "target/")
_FILES = ("f.py", "G.JAVA", "h.txt", ".rs", "noext")


@query(f"WITH p AS (SELECT page_id, [{_quoted(_FOLDERS)}][page_id % 5 + 1] || [{_quoted(_FILES)}][page_id // 5 % 5 + 1] AS path FROM pages) SELECT page_id, path FROM p WHERE (path LIKE '%f.py' OR path LIKE '%G.JAVA') AND page_id % 5 IN (0, 3)")
def source_paths(spark, sf):
    p = F.col("page_id")
    path = F.concat(_pick(p, _FOLDERS), _pick(F.floor(p / 5), _FILES))
    return table(spark, sf, "pages").select("page_id", path.alias("path")).where(repository.is_source(F.col("path")))


_REQUIRED = ("numpy>=1 # fast", "# all", "-e .", "-r  more.txt", "--index-url x", " pandas ", "./here", "", "numpy>=1", "-c lock.txt")


@query("SELECT page_id, 'numpy>=1|-r r' || page_id % 3 || '/more.txt|pandas|p' || page_id || '|-c r' || page_id % 3 || '/lock.txt' AS groups FROM pages")
def requirement_groups(spark, sf):
    p = F.col("page_id")
    lines = F.concat(F.lit("\n".join(_REQUIRED[:8]) + "\np"), p, F.lit("\n" + "\n".join(_REQUIRED[8:])))
    groups = repository.requirements(lines, F.concat(F.lit("r"), p % 3))
    return table(spark, sf, "pages").select("page_id", F.array_join(F.transform(groups, lambda g: F.array_join(g, " ")), "|").alias("groups"))


@query("SELECT doc_id, substr(sha256('v1|3.13' || 'requirements.txt' || text || 'setup.cfg' || source), 1, 12) AS key FROM documents")
def content_key(spark, sf):
    one = lambda name, c: F.struct(F.lit(name).alias("name"), F.encode(F.col(c), "utf-8").alias("content"))
    return table(spark, sf, "documents").select("doc_id", repository.content_key(F.lit("v1|3.13"), F.array(one("requirements.txt", "text"), one("setup.cfg", "source"))).alias("key"))


@query("""WITH f AS (SELECT page_id, page_id % 6 AS repo, 'd/F' || lpad(page_id::VARCHAR, 8, '0') || '.java' AS path, CASE page_id % 4 WHEN 0 THEN 'a/b/' WHEN 1 THEN '' WHEN 2 THEN 'a/b/' ELSE '' END AS folder, CASE page_id % 4 WHEN 0 THEN 'Main.java' WHEN 1 THEN 'Kind.java' END AS own FROM pages),
n AS (SELECT page_id, repo, path, folder, coalesce(own, 'F' || lpad(page_id::VARCHAR, 8, '0') || '.java') AS name FROM f),
w AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY path) - 1 AS before, row_number() OVER (PARTITION BY repo, folder, name ORDER BY path) AS turn FROM n) SELECT page_id, folder || CASE WHEN turn > 1 THEN '_' || before || '_' ELSE '' END || name AS staged FROM w""")
def staged_names(spark, sf):
    p = F.col("page_id")
    source = _pick(p, ("package a.b ;\npublic final  class Main {}", "  public enum Kind {}", "package a.b;\nclass Hidden {}", "// public class No\nclass X {}"))
    files = table(spark, sf, "pages").select("page_id", (p % 6).alias("repo"), F.concat(F.lit("d/F"), F.lpad(p.cast("string"), 8, "0"), F.lit(".java")).alias("path"), source.alias("text"))
    return repository.staged_names(files, "repo").select("page_id", "staged")


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id::VARCHAR) > 3")
def outdated_folders(spark, sf):
    rows = table(spark, sf, "events").select("user_id", "event_id", F.col("event_id").cast("string").alias("path"), F.col("ts").alias("modified"))
    return repository.outdated(rows, 3, "user_id").select("user_id", "event_id")


@query("SELECT user_id, max(event_id) AS step, 'checkpoint-' || max(event_id) AS name FROM events WHERE event_id % 4 <> 0 GROUP BY user_id")
def last_checkpoint(spark, sf):
    e = F.col("event_id")
    names = table(spark, sf, "events").select("user_id", F.when(e % 4 != 0, F.concat(F.lit("checkpoint-"), e)).otherwise(F.concat(F.lit("old-checkpoint-"), e)).alias("name"))
    return repository.last_checkpoint(names, "user_id")


# -- training examples, names and outputs ------------------------------------------------------------


@query(r"""WITH p AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'src/a/' WHEN 1 THEN 'tests/' ELSE 'src' END || 'f' || page_id || CASE WHEN page_id % 2 = 0 THEN '.py' ELSE '' END AS path FROM pages), b AS (SELECT page_id, regexp_replace(path, '\.[^./]*$', '') AS b FROM p)
SELECT page_id, replace(CASE WHEN starts_with(b, 'src/') THEN substr(b, 5) ELSE b END, '/', '.') AS module, replace(b, '/', '.') AS prefix FROM b""")
def module_names(spark, sf):
    p = F.col("page_id")
    path = F.concat(_pick(p, ("src/a/", "tests/", "src")), F.lit("f"), p, F.when(p % 2 == 0, ".py").otherwise(""))
    return table(spark, sf, "pages").select("page_id", workflow.module_of(path).alias("module"), workflow.id_prefix(path).alias("prefix"))


@query("SELECT doc_id, sha256(CASE WHEN length(text) > 500 THEN '... (' || (length(text) - 500) || ' characters cut)' || chr(10) || right(text, 500) ELSE text END) AS output FROM documents")
def capped_output(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(workflow.capped_output(F.col("text"), 500), 256).alias("output"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN sha256(text) END AS prefix, CASE WHEN doc_id % 3 <> 0 THEN source || '<FILL_ME>' END AS suffix FROM documents")
def infill_parts(spark, sf):
    parts = workflow.infill_parts(F.concat("text", F.when(F.col("doc_id") % 3 != 0, "<FILL_ME>").otherwise(""), "source", F.when(F.col("doc_id") % 3 != 0, "<FILL_ME>").otherwise("")))
    return table(spark, sf, "documents").select("doc_id", F.sha2(parts["prefix"], 256).alias("prefix"), parts["suffix"].alias("suffix"))


@query("""WITH e AS (SELECT vec_id, vec_id % 60 + 1 AS s, list_transform(embedding, lambda x: floor(x * 100)::INTEGER) AS e FROM embeddings), c AS (SELECT vec_id, s, [1] || e[1:s] AS p, e[s + 1:64] || [2] AS c FROM e),
x AS (SELECT vec_id, CASE WHEN s <= 17 THEN [] ELSE [1] || p[20:s + 1] END AS p, CASE WHEN s <= 17 THEN c[1:47] || [2] ELSE c END AS c FROM c)
SELECT vec_id, array_to_string(p || c, ' ') AS ids, array_to_string(list_transform(p, lambda x: -100) || c, ' ') AS labels FROM x""")
def encoded_examples(spark, sf):
    # a product of floats, as in SQL; that of a double is less than 29 where the float's is 29
    level = F.transform("embedding", lambda x: F.floor(x * F.lit(100).cast("float")).cast("int"))
    s = (F.col("vec_id") % 60 + 1).cast("int")
    rows = table(spark, sf, "embeddings").select("vec_id", F.slice(level, F.lit(1), s).alias("p"), F.slice(level, s + 1, F.lit(64)).alias("c"))
    made = workflow.encoded_example(F.col("p"), F.col("c"), 48, "left", 1, 2)
    return rows.select("vec_id", made.alias("m")).select("vec_id", F.array_join("m.input_ids", " ").alias("ids"), F.array_join("m.labels", " ").alias("labels"))


@query("""WITH r AS (SELECT vec_id, vec_id % 16 AS batch, vec_id * 7 % 29 + 1 AS n FROM embeddings), w AS (SELECT vec_id, n, (ceil(max(n) OVER (PARTITION BY batch) / 8.0) * 8)::BIGINT AS width FROM r)
SELECT vec_id, width, n AS attended, array_to_string(list_transform(range(0, n), lambda i: vec_id) || list_transform(range(0, width - n), lambda i: -100), ' ') AS labels FROM w""")
def padded_batches(spark, sf):
    v = F.col("vec_id")
    ids = F.array_repeat(v.cast("int"), (v * 7 % 29 + 1).cast("int"))
    rows = workflow.padded(table(spark, sf, "embeddings").select("vec_id", (v % 16).alias("batch"), ids.alias("input_ids"), ids.alias("labels")), "batch", 0)
    attended = F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x)
    return rows.select("vec_id", F.size("input_ids").cast("long").alias("width"), attended.cast("long").alias("attended"), F.array_join("labels", " ").alias("labels"))
