"""Checks of patches and of the tests that reproduce an issue, and what is said about a rejected attempt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, py_strip
from .runs import running_best
from .workflow import MAX_PATCH, changed_lines, shortened, test_section

# Beginnings of messages that tell of a broken test.
BROKEN = ("NameError", "ImportError", "ModuleNotFoundError", "SyntaxError", "IndentationError")
# Titles of the sections of feedback.
TITLES = (
    "Tests that reproduce the issue and still fail (these must pass)",
    "Tests that passed before your patch and now fail (do not break these)",
    "Tests that still fail",
)
# What a failure type is taken to mean, and advice; {0} is the first error, {1} the evidence, {2} the verdict.
REFLECTIONS = {
    "syntax_error": ("The patched code is not valid Python.", ("Return complete, syntactically valid function definitions.",)),
    "compilation_error": ("No usable patch was produced: {0}", ("Return only the corrected functions, as valid Python.",)),
    "patch_application_error": ("The patch did not apply to the repository: {0}", ("Edit the code exactly as shown; do not invent context lines.",)),
    "regression": ("The patch broke behaviour that worked before{1}.", ("Keep the existing behaviour that the broken tests check.", "Limit the change to the case described in the issue.")),
    "runtime_error": (
        "The code still raises an exception on the issue's input{1}.",
        ("Handle the input that triggers the exception before it is raised.", "Return the value the issue asks for instead of raising."),
    ),
    "logic_error": ("The code runs but returns the wrong result{1}.", ("Re-check the computation against the expected values in the failing test.",)),
    "test_failure": ("Tests that should pass after the fix still fail.", ("Change the logic the failing tests exercise.",)),
    "unknown": ("{2}", ("Change the behaviour the issue describes, not only the code's form.",)),
}
CONFIDENCE = 0.3


def patch_files(patch: Column) -> Column:
    """(files, error): the files that the headers of a patch name, each once, in order; or why it can't be used.

    An empty patch comes first, then a path that is empty, absolute or leads upwards, then missing headers. A null patch is empty.
    """
    patch = F.coalesce(patch, F.lit(""))
    heads = F.filter(F.split(patch, r"\r\n|\r|\n"), lambda x: x.startswith("--- ") | x.startswith("+++ "))
    named = F.transform(heads, lambda x: py_strip(F.split(x.substr(F.lit(5), F.length(x)), "\t", 2)[0]))
    paths = F.transform(F.filter(named, lambda p: p != "/dev/null"), lambda p: F.regexp_replace(p, "^[ab]/", ""))
    unsafe = F.filter(paths, lambda p: (p == "") | p.startswith("/") | F.array_contains(F.split(p, "/"), ".."))
    error = (
        F.when(py_strip(patch) == "", "empty")
        .when(F.size(unsafe) > 0, F.concat(F.lit("unsafe: "), F.get(unsafe, F.lit(0))))
        .when((F.size(paths) == 0) | ~patch.contains("\n+++ "), "no headers")
    )
    return F.struct(F.when(error.isNull(), F.array_distinct(paths)).alias("files"), error.alias("error"))


def reproductions(cases: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, accepted, reason, reproducing) from an unpatched run's ``cases`` (keys, ord, test_id, outcome, message).

    A test reproduces the issue if it fails, and not for a reason that tells of a broken test. A group has a row for
    each test, so one task holds one run's tests. Keys without a test have no row; see ``no_reproduction``.
    """
    said = F.coalesce("message", F.lit(""))
    broken = F.lit(False)
    for start in BROKEN:
        broken = broken | said.startswith(start)
    hit = (F.col("outcome") == "failed") & ~broken
    first = F.min(F.when(F.col("message").isNotNull(), F.struct("ord", "test_id", "message")))
    rows = cases.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.array_sort(F.collect_list(F.when(hit, F.struct("ord", "test_id")))).alias("_hits"), first.alias("_first"))
    n = F.size("_hits")
    # The sentences, which are part of the result.
    reason = (
        F.when(n > 0, F.concat(n.cast("string"), F.lit(" of "), F.col("_n").cast("string"), F.lit(" test(s) fail on the unpatched code, reproducing the issue.")))
        .when(F.col("_first").isNotNull(), F.concat(F.lit("The test is broken rather than failing on the bug ("), F.col("_first.test_id"), F.lit(": "), F.col("_first.message"), F.lit(").")))
        .otherwise("Every test passes on the unpatched code, so none of them reproduces the issue.")
    )
    return rows.select(*keys, (n > 0).alias("accepted"), reason.alias("reason"), F.transform("_hits", lambda h: h["test_id"]).alias("reproducing"))


def no_reproduction(errors: Column) -> Column:
    """Why a run without tests proves nothing; the first error is told unless it only says that there were no tests."""
    first = F.get(errors, F.lit(0))
    return py_strip(F.concat(F.lit("No test from the file ran."), F.when(first.contains("collected no tests") | first.isNull(), "").otherwise(F.concat(F.lit(" "), first))))


def scoped(cases: DataFrame, prefixes: Column) -> DataFrame:
    """``cases`` (test_id) whose module is one of ``prefixes``, or lies below one."""
    module = F.substring_index("test_id", "::", 1)
    return cases.where(F.exists(prefixes, lambda p: (module == p) | module.startswith(F.concat(p, F.lit(".")))))


def test_totals(cases: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, passed, failed, status) of each run's tests; an error counts as failed, no test at all fails the run."""
    passed, failed = F.count_if(F.col("outcome") == "passed"), F.count_if(F.col("outcome").isin("failed", "error"))
    rows = cases.groupBy(*keys).agg(passed.alias("passed"), failed.alias("failed"), F.count("outcome").alias("_n"))
    return rows.withColumn("status", F.when((F.col("_n") > 0) & (F.col("failed") == 0), "PASS").otherwise("FAIL")).drop("_n")


def repeated_patches(attempts: DataFrame, key: str) -> DataFrame:
    """``attempts`` (key, attempt, patch) with repeated: whether an earlier attempt of the key has the same patch; blank ones don't count.

    Fingerprints are aggregated before they are joined back, so many copies of a patch are no large group. Keys are not null.
    """
    marked = attempts.withColumn("_fp", F.when(py_strip(F.col("patch")) != "", F.sha2("patch", 256)))
    first = marked.where("_fp IS NOT NULL").groupBy(key, "_fp").agg(F.min("attempt").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    rows = marked.join(first, [key, "_fp"], "left")
    return rows.withColumn("repeated", F.coalesce(F.col("attempt") > F.col("_first"), F.lit(False))).drop("_fp", "_first")


def shown_attempts(attempts: DataFrame, key: str, most: int) -> DataFrame:
    """``attempts`` (key, attempt, status, broken, fixed, applied, n_tests) with best_so_far, finished and shown.

    Work ends with a solved attempt, with one that applies while no test ran, or with the ``most``-th; then the best one
    is shown, before that the current one.
    """
    untested = F.col("applied") & (F.coalesce("n_tests", F.lit(0)) == 0)
    done = (F.col("status") == "solved") | untested | (F.col("attempt") >= most)
    rows = running_best(attempts, key).withColumn("finished", F.coalesce(done, F.lit(False)))
    return rows.withColumn("shown", F.when(F.col("finished"), F.col("best_so_far")).otherwise(F.col("attempt")))


def failed_order(broken: Column, reproduction: Column, still_failing: Column) -> Column:
    """Failed tests, each once: broken ones, those that reproduce the issue, the others; a null list is empty."""
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(*[F.coalesce(c, none) for c in (broken, reproduction, still_failing)]))


def feedback(number: Column, reason: Column, patch: Column, applied: Column, patch_status: Column, error: Column, repeated: Column, reproduction: Column, broken: Column, still_failing: Column, messages: Column) -> Column:
    """Why an attempt was rejected, as text. ``reproduction`` holds the reproducing tests that still fail; ``error`` the first error."""
    none = F.array().cast("array<string>")
    lists = [F.coalesce(c, none) for c in (reproduction, broken, still_failing)]
    lists[2] = F.array_except(lists[2], lists[0])
    rtrim = lambda c: F.regexp_replace(c, r"\s+\z", "")
    patch, error = F.coalesce(patch, F.lit("")), F.coalesce(error, F.lit(""))
    head = F.concat(F.lit("Attempt "), number.cast("string"), F.lit(" was rejected: "), F.coalesce(F.nullif(reason, F.lit("")), F.lit("no reason recorded")))
    again = F.when(repeated, F.array(F.lit("This patch is identical to an earlier rejected attempt. Take a different approach this time."))).otherwise(none)
    unapplied = F.array(rtrim(F.concat(F.lit("The patch could not be applied ("), F.coalesce(patch_status, F.lit("")), F.lit("): "), error)))
    sections = F.concat(*[test_section(title, tests, messages) for title, tests in zip(TITLES, lists, strict=True)])
    tail = F.array(F.lit("Previous patch (rejected, do not repeat it):"), shortened(py_strip(patch), MAX_PATCH))
    empty = F.array(rtrim(F.concat(F.lit("No usable patch was produced. "), error)))
    body = F.when(py_strip(patch) == "", empty).otherwise(F.concat(F.when(applied, sections).otherwise(unapplied), tail))
    return F.array_join(F.concat(F.array(head), again, body), "\n")


def reflection(failure: Column, patch: Column, reason: Column, error: Column, tests: Column, messages: Column) -> Column:
    """(root_cause, patch_analysis, suggested_changes, repair_guidance, confidence) by rule; an unknown failure type is ``unknown``."""
    first = F.get(tests, F.lit(0))
    message = F.when(first.isNotNull(), F.coalesce(F.try_element_at(messages, first), F.lit("")))
    evidence = F.when(first.isNull(), "").when(message == "", F.concat(F.lit(" ("), first, F.lit(")"))).otherwise(F.concat(F.lit(" ("), first, F.lit(": "), message, F.lit(")")))
    verdict = F.coalesce(F.nullif(reason, F.lit("")), F.lit("No test shows that the patch fixes the issue."))
    known = F.when(failure.isin(*REFLECTIONS), failure).otherwise("unknown")
    table = F.create_map(*[x for k, (cause, todo) in REFLECTIONS.items() for x in (F.lit(k), F.struct(F.lit(cause).alias("cause"), F.array(*map(F.lit, todo)).alias("todo")))])

    def made(own: Column) -> Column:
        cause = own["cause"]
        for mark, value in (("{0}", F.coalesce(error, F.lit(""))), ("{1}", evidence), ("{2}", verdict)):
            cause = F.when(own["cause"].contains(mark), F.replace(own["cause"], F.lit(mark), value)).otherwise(cause)
        changed = F.when(py_strip(F.coalesce(patch, F.lit(""))) == "", "no patch").otherwise(F.concat(changed_lines(patch).cast("string"), F.lit(" changed line(s)")))
        return F.struct(
            cause.alias("root_cause"),
            F.concat(F.lit("The previous patch ("), changed, F.lit(") was rejected: "), F.coalesce(reason, F.lit("see the failing tests"))).alias("patch_analysis"),
            F.concat(own["todo"], F.array(F.lit("Take a different approach from the previous patch."))).alias("suggested_changes"),
            F.concat(cause, F.lit(" "), F.array_join(own["todo"], " "), F.lit(" Do not repeat the previous patch.")).alias("repair_guidance"),
            F.lit(CONFIDENCE).alias("confidence"),
        )

    return let(F.element_at(table, known), made)
