"""Test runs before and after a patch, attempts, and scores of predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rank of a verdict.
RANK = {"solved": 2, "unverified": 1, "failed": 0}


def compared(before: DataFrame, after: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, test_id, before, after, change) of all tests of two runs (test_id, outcome).

    A test missing afterwards counts as failed; one that only runs afterwards is added; a skip on either side says nothing.
    """
    a = before.select(*keys, "test_id", F.col("outcome").alias("before"))
    b = after.select(*keys, "test_id", F.col("outcome").alias("after"))
    rows = a.join(b, [*keys, "test_id"], "full")
    after_ = F.coalesce("after", F.lit("missing"))
    change = (
        F.when(F.col("before").isNull(), "added")
        .when((F.col("before") == "skipped") | (after_ == "skipped"), "ignored")
        .when((F.col("before") == "passed") & (after_ == "passed"), "pass_to_pass")
        .when(F.col("before") == "passed", "pass_to_fail")
        .when(after_ == "passed", "fail_to_pass")
        .otherwise("fail_to_fail")
    )
    return rows.select(*keys, "test_id", "before", after_.alias("after"), change.alias("change"))


def verdicts(changes: DataFrame, keys: tuple[str, ...] = (), reproduction: DataFrame | None = None) -> DataFrame:
    """Counts and the status of each comparison; ``reproduction`` (keys, test_id) lists tests that reproduce the issue."""
    names = ("pass_to_pass", "pass_to_fail", "fail_to_pass", "fail_to_fail")
    rows = changes
    if reproduction is None:
        rows = rows.withColumn("_repro", F.lit(False))
    else:
        rows = rows.join(reproduction.select(*keys, "test_id", F.lit(True).alias("_repro")), [*keys, "test_id"], "full").withColumns(
            {"_repro": F.coalesce("_repro", F.lit(False)), "after": F.coalesce("after", F.lit("missing"))}
        )
    out = rows.groupBy(*keys).agg(
        *[F.count_if(F.col("change") == n).alias(n) for n in names],
        F.count_if((F.col("change") == "added") & F.col("after").isin("failed", "error")).alias("added_failing"),
        F.count_if("_repro").alias("repro"),
        F.count_if(F.col("_repro") & (F.col("after") != "passed")).alias("repro_failing"),
        F.count("before").alias("n_before"),
    )
    c = F.col
    text = lambda *parts: F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])
    broke, added = c("pass_to_fail") > 0, c("added_failing") > 0
    problems = F.concat_ws(" and ", F.when(broke, text("broke ", c("pass_to_fail"), " previously passing test(s)")), F.when(added, text("added ", c("added_failing"), " failing test(s)")))
    partly = (c("fail_to_pass") > 0) & (c("repro") > 0) & (c("repro_failing") > 0)
    status = F.when(broke | added, "failed").when(partly, "unverified").when(c("fail_to_pass") > 0, "solved").otherwise("unverified")
    # The sentences, which are part of the result.
    reason = (
        F.when(broke | added, text("The patch ", problems, "."))
        .when(partly, text("Nothing broke and ", c("fail_to_pass"), " test(s) now pass, but ", c("repro_failing"), " of the issue's ", c("repro"), " reproduction test(s) still fail."))
        .when(
            c("fail_to_pass") > 0,
            text(c("fail_to_pass"), " test(s) went from failing to passing and none of the passing tests broke.", F.when(c("repro") > 0, " The issue's reproduction test now passes.").otherwise("")),
        )
        .when(c("n_before") == 0, "The baseline run produced no test results to compare against.")
        .when(c("fail_to_fail") > 0, text("Nothing broke, but the ", c("fail_to_fail"), " test(s) that failed before still fail, so no test shows the fix."))
        .otherwise("Every test passed both before and after the patch, so no test shows the fix.")
    )
    return out.withColumns({"status": status, "reason": reason}).drop("n_before")


# Endings of exceptions' names.
EXCEPTIONS = ("Error", "Exception", "Exit", "Interrupt")


def failure_type(patch: Column, patch_error: Column, patch_status: Column, stage: Column, broken: Column, failed: Column, messages: Column) -> Column:
    """What kind of failure an attempt was; ``messages`` are those of its failed tests, ``broken`` and ``failed`` counts."""
    # an exception stands first: a part of a dotted name with one of the endings, and something before the ending
    parts = lambda m: F.split(F.regexp_extract(m, r"^([A-Za-z_][A-Za-z0-9_.]*)", 1), r"\.")
    ends = lambda p, i: F.array_contains(F.transform(F.array(*map(F.lit, EXCEPTIONS)), lambda e: p.endswith(e) & ((i > 0) | (p != e))), True)
    exception = lambda m: F.array_contains(F.transform(parts(m), ends), True) & ~m.startswith("AssertionError")
    said = F.filter(messages, lambda m: m.isNotNull() & (m != ""))
    return (
        F.when(F.trim(F.coalesce(patch, F.lit(""))) == "", F.when(patch_error.contains("not valid Python"), "syntax_error").when(F.coalesce(patch_error, F.lit("")) != "", "compilation_error").otherwise("unknown"))
        .when(patch_status.isNotNull() & (patch_status != "APPLIED"), "patch_application_error")
        .when(stage == "syntax", "syntax_error")
        .when(broken > 0, "regression")
        .when(F.exists(said, exception), "runtime_error")
        .when(F.size(said) > 0, "logic_error")
        .when(failed > 0, "test_failure")
        .otherwise("unknown")
    )


def attempt_order() -> list[Column]:
    """Best first: verdict, fewer broken, more fixed, applied, earlier."""
    rank = F.when(F.col("status") == "solved", 2).when(F.col("status") == "unverified", 1).otherwise(0)
    return [F.desc(rank), F.col("broken"), F.desc("fixed"), F.desc("applied"), F.col("attempt")]


def best_attempts(attempts: DataFrame, key: str) -> DataFrame:
    """The best attempt of each key: an aggregate that combines in each task."""
    rank = F.when(F.col("status") == "solved", 2).when(F.col("status") == "unverified", 1).otherwise(0)
    score = F.struct((-rank).alias("r"), "broken", (-F.col("fixed")).alias("f"), (~F.col("applied")).alias("a"), "attempt")
    return attempts.groupBy(key).agg(F.min(score).alias("m")).select(key, F.col("m.attempt").alias("attempt"), (-F.col("m.r")).alias("rank"), F.col("m.broken").alias("broken"), (-F.col("m.f")).alias("fixed"))


def running_best(attempts: DataFrame, key: str) -> DataFrame:
    """``attempts`` with best_so_far, the number of the best attempt up to each."""
    rank = F.when(F.col("status") == "solved", 2).when(F.col("status") == "unverified", 1).otherwise(0)
    score = F.struct((-rank).alias("r"), "broken", (-F.col("fixed")).alias("f"), (~F.col("applied")).alias("a"), "attempt")
    upto = Window.partitionBy(key).orderBy("attempt").rowsBetween(Window.unboundedPreceding, 0)
    return attempts.withColumn("best_so_far", F.min(score).over(upto)["attempt"])


def token_matches(predictions: Column, labels: Column, ignored: int = -100) -> Column:
    """(correct, scored): a position predicts the next label; ignored labels don't count."""
    ahead = F.slice(labels, F.lit(2), F.size(labels))
    own = F.filter(F.zip_with(F.slice(predictions, F.lit(1), F.greatest(F.size(predictions) - 1, F.lit(0))), ahead, lambda p, y: F.struct(p.alias("p"), y.alias("y"))), lambda x: x["y"].isNotNull() & (x["y"] != ignored))
    return F.struct(F.size(F.filter(own, lambda x: x["p"] == x["y"])).cast("long").alias("correct"), F.size(own).cast("long").alias("scored"))


def accuracies(rows: DataFrame, predictions: str = "predictions", labels: str = "labels") -> DataFrame:
    """token_accuracy and sequence_accuracy over all rows; rows without a scored token don't count as sequences."""
    m = rows.select(token_matches(F.col(predictions), F.col(labels)).alias("m")).select("m.*")
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return m.agg(
        ratio(F.sum("correct"), F.sum("scored")).alias("token_accuracy"),
        ratio(F.count_if((F.col("scored") > 0) & (F.col("correct") == F.col("scored"))), F.count_if(F.col("scored") > 0)).alias("sequence_accuracy"),
    )


def exact_match(predictions: Column, target: Column) -> Column:
    """Whether any prediction equals the target, white space left out."""
    bare = lambda t: F.regexp_replace(t, r"(?U)\s+", "")
    return F.exists(predictions, lambda p: bare(p) == bare(target))


def perplexity(loss: Column) -> Column:
    return F.when(loss > 60, F.lit(float("inf"))).otherwise(F.exp(loss))


def history_summary(history: DataFrame, key: str) -> DataFrame:
    """Of each run's log (step, loss, eval_loss): the number of evaluations, the best one (the first of equals), the last loss."""
    return history.groupBy(key).agg(
        F.count("eval_loss").alias("evaluations"),
        F.min("eval_loss").alias("best_eval_loss"),
        F.min(F.when(F.col("eval_loss").isNotNull(), F.struct("eval_loss", "step")))["step"].alias("best_step"),
        F.max(F.when(F.col("loss").isNotNull(), F.struct("step", "loss")))["loss"].alias("final_loss"),
    )
