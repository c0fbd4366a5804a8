"""Patches, feedback, localization, Python pairs, repositories and files of a build."""

import hashlib
import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from fixcorpus.functions import regions
from fixcorpus.operators import corpus, localization, pycorpus, review
from fixcorpus.plans import build as building
from fixcorpus.sources import records, repository


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_patch_files(spark):
    patches = [
        ("--- a/x.py\n+++ b/x.py\n@@", ["x.py"], None), ("--- /dev/null\n+++ b/n.py\t2020\n", ["n.py"], None), (None, None, "empty"), (" \n", None, "empty"),
        ("--- a/../x\n+++ b/x\n", None, "unsafe: ../x"), ("--- /etc/x\n+++ b/x\n", None, "unsafe: /etc/x"), ("--- \n+++ b/x\n", None, "unsafe: "), ("+++ b/x\n", None, "no headers"),
        ("--- /dev/null\n+++ /dev/null\n", None, "no headers"), ("--- a/x..y\r\n+++ b/z", ["x..y", "z"], None),
    ]
    got = values(spark, [(i, p[0]) for i, p in enumerate(patches)], "i int, p string", "i", review.patch_files(F.col("p")).alias("r"))
    assert [(r["files"], r["error"]) for _, r in sorted(got)] == [(f, e) for _, f, e in patches]


def test_reproductions(spark):
    cases = [("a", 1, "t1", "failed", "NameError: x"), ("a", 2, "t2", "failed", "AssertionError"), ("a", 3, "t3", "passed", None), ("b", 2, "t1", "failed", "ImportError: y"), ("b", 1, "t2", "error", "E"), ("c", 1, "t1", "passed", None), ("d", 1, "t", "failed", None)]
    schema = "run string, ord int, test_id string, outcome string, message string"
    got = {r["run"]: (r["accepted"], r["reason"], r["reproducing"]) for r in review.reproductions(spark.createDataFrame(cases, schema), ("run",)).collect()}
    assert got["a"] == (True, "1 of 3 test(s) fail on the unpatched code, reproducing the issue.", ["t2"])
    assert got["b"] == (False, "The test is broken rather than failing on the bug (t2: E).", [])
    assert got["c"] == (False, "Every test passes on the unpatched code, so none of them reproduces the issue.", [])
    assert got["d"][0] and got["d"][2] == ["t"]
    assert review.reproductions(spark.createDataFrame([], schema), ("run",)).count() == 0
    said = values(spark, [(0, []), (1, ["boom"]), (2, ["pytest collected no tests"]), (3, None)], "i int, e array<string>", "i", review.no_reproduction(F.col("e")))
    assert [x for _, x in sorted(said)] == ["No test from the file ran.", "No test from the file ran. boom", "No test from the file ran.", "No test from the file ran."]


def test_scoped_and_totals(spark):
    cases = spark.createDataFrame([("tests.a::x", "passed"), ("tests.a.B::y", "error"), ("tests.ab::z", "skipped"), ("tests::w", "failed")], "test_id string, outcome string")
    assert {r[0] for r in review.scoped(cases, F.array(F.lit("tests.a"))).collect()} == {"tests.a::x", "tests.a.B::y"}
    assert tuple(review.test_totals(cases).first()) == (1, 2, "FAIL") and tuple(review.test_totals(cases.limit(0)).first()) == (0, 0, "FAIL")
    assert tuple(review.test_totals(cases.where("outcome = 'passed'")).first()) == (1, 0, "PASS")


def test_attempts(spark):
    rows = spark.createDataFrame([("u", 1, "p"), ("u", 2, " "), ("u", 3, "p"), ("u", 4, " "), ("v", 2, "p"), ("v", 3, None), ("v", 4, None)], "k string, attempt int, patch string")
    assert {(r["k"], r["attempt"]) for r in review.repeated_patches(rows, "k").where("repeated").collect()} == {("u", 3)} and review.repeated_patches(rows, "k").count() == 7
    made = spark.createDataFrame([("u", 1, "failed", 2, 0, True, 3), ("u", 2, "unverified", 0, 1, True, 3), ("u", 3, "failed", 0, 0, False, 0), ("v", 1, "failed", 0, 0, True, None)], "k string, attempt int, status string, broken int, fixed int, applied boolean, n_tests int")
    assert {(r["k"], r["attempt"]): (r["finished"], r["shown"]) for r in review.shown_attempts(made, "k", 3).collect()} == {("u", 1): (False, 1), ("u", 2): (False, 2), ("u", 3): (True, 2), ("v", 1): (True, 1)}


def test_feedback_and_reflection(spark):
    d = spark.range(1)
    listed = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    messages = F.create_map(F.lit("t1"), F.lit("m" * 301), F.lit("t2"), F.lit(""))
    say = lambda patch, applied=True, again=False: d.select(review.feedback(F.lit(2), F.lit(None).cast("string"), F.lit(patch).cast("string"), F.lit(applied), F.lit("CONFLICT"), F.lit("e "), F.lit(again), listed("t1"), listed(*[f"b{i}" for i in range(10)]), listed("t1", "t2"), messages)).first()[0]
    assert say(None) == "Attempt 2 was rejected: no reason recorded\nNo usable patch was produced. e"
    assert say(" x ", False).split("\n")[1:] == ["The patch could not be applied (CONFLICT): e", "Previous patch (rejected, do not repeat it):", "x"]
    lines = say("x", again=True).split("\n")
    assert lines[1].startswith("This patch is identical") and lines[2] == review.TITLES[0] + ":" and lines[3] == "- t1: " + "m" * 300 and lines[4] == "... (truncated)"
    assert lines[5] == review.TITLES[1] + ":" and lines[14:] == ["- ... and 2 more", review.TITLES[2] + ":", "- t2", "Previous patch (rejected, do not repeat it):", "x"]
    made = lambda kind, patch="+a\n-b\n+++ c", tests=("t",), reason="r": d.select(review.reflection(F.lit(kind), F.lit(patch).cast("string"), F.lit(reason).cast("string"), F.lit("err"), listed(*tests), F.create_map(F.lit("t"), F.lit("m"))).alias("r")).first()["r"]
    assert made("regression")["root_cause"] == "The patch broke behaviour that worked before (t: m)." and made("regression", tests=())["root_cause"].endswith("before.")
    assert made("regression", tests=("s",))["root_cause"].endswith("before (s).") and made("compilation_error")["root_cause"].endswith(": err")
    assert made("nothing")["root_cause"] == "r" and made("nothing", reason=None)["root_cause"].startswith("No test shows")
    assert made("logic_error")["patch_analysis"] == "The previous patch (2 changed line(s)) was rejected: r" and "(no patch)" in made("logic_error", patch=None)["patch_analysis"]
    assert made("runtime_error")["suggested_changes"][-1] == "Take a different approach from the previous patch." and made("unknown")["confidence"] == 0.3
    order = d.select(review.failed_order(listed("a", "b"), F.lit(None).cast("array<string>"), listed("b", "c"))).first()[0]
    assert order == ["a", "b", "c"]


def test_localization(spark):
    files = spark.createDataFrame([("f", "src/a.py", ["x = 1", "if todo == 3:", ""]), ("g", "b.html", ["null here", "null"]), ("e", "c.py", [])], "id string, path string, lines array<string>")
    got = {r["id"]: r for r in localization.localized(files, F.array(F.lit("null")), "id").collect()}
    assert set(got) == {"f", "g"} and got["f"]["prompt"] == "x = 1\n# if todo == 3:\n<FILL_ME>\n" and got["g"]["prompt"] == "<!-- null here -->\n<FILL_ME>\nnull"
    chunks = spark.createDataFrame([("./src/a.py", 1), ("other/a.py", 2), ("b.py", 3), (None, 4)], "file string, n int")
    assert sorted((r["path"], r["chunk"]["n"]) for r in localization.chunks_of(files, chunks).collect()) == [("src/a.py", 1), ("src/a.py", 2)]
    assert files.select(localization.commented_prompt(F.col("lines"), F.lit(2), F.lit(9), F.col("path"))).first()[0] is None
    span = "array<struct<name:string,start_line:int,end_line:int>>"
    inner = values(spark, [(0, [("a", 1, 9), ("b", 2, 4), ("c", 3, 5)], 3), (1, [("a", 1, 2)], 3), (2, [], 1)], f"i int, s {span}, line int", "i", localization.innermost(F.col("s"), F.col("line"))["name"])
    assert sorted(inner) == [(0, "b"), (1, None), (2, None)]
    region = [("a.py", 1, 2, 0.5, "c", "p"), ("b.py", 3, 3, 1.0, "d", "q")]
    text = values(spark, [(region,), ([],)], "r array<struct<file:string,start_line:int,end_line:int,score:double,code:string,prompt:string>>", localization.region_sections(F.col("r")))
    assert text[1] == ("",) and text[0][0].split("\n\n")[3].startswith("REGION 2\nFILE: b.py\nSUSPICIOUS LINES: 3-3\nSCORE: 1.0000")


def test_python_pairs(spark):
    rows = [(0, "a\nb\n", "a\nc\n"), (1, "a", "a"), (2, "a\nb", "a"), (3, None, None), (4, "", "x"), (5, "a\n\nb", "z\n\ny"), (6, "a\nb", "a\n \nb"), (7, "k\nk\nk", "k\nk")]
    made = pycorpus.rows(spark.createDataFrame(rows, "i int, buggy string, fixed string"))
    got = {r["i"]: r for r in made.collect()}
    assert {i: r["skipped"] for i, r in got.items()} == {0: None, 1: "no_change", 2: "blank_target", 3: "no_change", 4: None, 5: None, 6: "blank_target", 7: "blank_target"}
    assert got[0]["input"] == "a\n# BUGGY CODE\n# b\n<FILL_ME>" and got[0]["output"] == "c" and got[4]["input"] == "# BUGGY CODE\n<FILL_ME>"
    assert got[5]["input"] == "# BUGGY CODE\n# a\n#\n# b\n<FILL_ME>" and got[5]["output"] == "z\n\ny" and got[1]["input"] is None
    assert all(r["reconstruction_ok"] for r in got.values() if r["skipped"] is None)
    assert tuple(pycorpus.summary(made).first()) == (8, 3, 5) and tuple(pycorpus.summary(made.limit(0)).first()) == (0, 0, 0)


def test_fixed_bounds_and_lengths(spark):
    cases = [(1, 2, ["a", "b"], False, None), (2, 1, [], True, None), (0, 1, None, None, "start_before_first"), (3, 1, None, None, "end_before_start"), (1, 4, None, None, "end_after_last"), (4, 3, [], True, None)]
    got = values(spark, [(i, ["a", "b", "c"], c[0], c[1]) for i, c in enumerate(cases)], "i int, x array<string>, s int, e int", "i", regions.fixed_region(F.col("x"), F.col("s"), F.col("e")).alias("r"))
    assert [tuple(r) for _, r in sorted(got)] == [c[2:] for c in cases]
    rows = spark.createDataFrame([("a <FILL_ME>", 3, 4, None), ("<FILL_ME>", 3, None, None), ("b", 1, 1, "x"), ("<FILL_ME>", 9, 9, None)], "input string, input_tokens int, output_tokens int, reason string")
    assert [r["input"] for r in corpus.trainable(rows, 7).collect()] == ["a <FILL_ME>"]
    series = sorted(tuple(r) for r in corpus.token_series(rows).collect())
    assert series == [("input", 1), ("input", 3), ("input", 3), ("input", 9), ("input_kept", 3), ("input_kept", 3), ("input_kept", 9), ("output", 1), ("output", 4), ("output", 9), ("total", 2), ("total", 7), ("total", 18)]
    few, many = ({r["id"] for r in corpus.sampled(spark.range(50), "id", n).collect()} for n in (5, 20))
    assert len(few) == 5 and few < many and corpus.sampled(spark.range(3), "id", 9).count() == 3


def test_repository_tables(spark, tmp_path):
    for name, text in {"a/f.py": "x", "node_modules/g.js": "y", "h.txt": "z", "b/I.JAVA": "w"}.items():
        os.makedirs(tmp_path / "repo" / os.path.dirname(name), exist_ok=True)
        (tmp_path / "repo" / name).write_text(text)
    assert sorted(tuple(r) for r in repository.source_files(spark, str(tmp_path / "repo")).collect()) == [("a/f.py", "x"), ("b/I.JAVA", "w")]
    assert repository.load_bugs(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "bugs.json").write_text('[{"issue": "i", "fix": "f", "type": "t"},\n {"issue": "j"}]')
    assert [tuple(r) for r in repository.load_bugs(spark, str(tmp_path / "bugs.json")).collect()] == [("i", "f", "t"), ("j", None, None)]
    payload = '[{"number": 1, "title": null, "labels": [{"name": "x"}], "html_url": "u"}, {"number": 2, "pull_request": null}, {"number": 3, "body": "b", "comments": 4}]'
    (issues,) = values(spark, [(payload,)], "p string", repository.open_issues(F.col("p")))[0]
    assert [tuple(i) for i in issues] == [(1, "", "", "", "u", ["x"], 0), (3, "", "b", "", "", [], 4)]
    text = "numpy>=1 # fast\n# all\n-e .\n-r  more.txt\n--index-url x\n pandas\nnumpy>=1\n\n./here"
    assert values(spark, [(text,)], "t string", repository.requirements(F.col("t"), F.lit("r")))[0][0] == [["numpy>=1"], ["-r", "r/more.txt"], ["pandas"]]
    key = hashlib.sha256(b"v" + b"a" + b"\xff" + b"b" + b"").hexdigest()[:12]
    assert values(spark, [([("a", bytearray(b"\xff")), ("b", bytearray())],)], "f array<struct<name:string,content:binary>>", repository.content_key(F.lit("v"), F.col("f")))[0][0] == key
    java = spark.createDataFrame([("r", "d/A.java", "package x.y;\npublic class Z {}"), ("r", "d/B.java", "package x.y;\n public final class Z {}"), ("r", "d/C.java", None), ("s", "e/C.java", "public record R(int a) {}")], "repo string, path string, text string")
    assert {(r["repo"], r["path"]): r["staged"] for r in repository.staged_names(java, "repo").collect()} == {("r", "d/A.java"): "x/y/Z.java", ("r", "d/B.java"): "x/y/_1_Z.java", ("r", "d/C.java"): "C.java", ("s", "e/C.java"): "R.java"}
    assert sorted(r[0] for r in java.select(repository.qualified_class(F.col("path"), F.col("text"))).collect()) == ["C", "R", "x.y.Z", "x.y.Z"]
    folders = spark.createDataFrame([("k", "a", 1), ("k", "b", 3), ("k", "c", 3)], "k string, path string, modified int")
    assert [r["path"] for r in repository.outdated(folders, 1, "k").orderBy("path").collect()] == ["a", "c"] and repository.outdated(folders, -1, "k").count() == 0
    names = spark.createDataFrame([("k", "checkpoint-9"), ("k", "checkpoint-10"), ("k", "checkpoint-x"), ("j", "run"), ("j", None)], "k string, name string")
    assert [tuple(r) for r in repository.last_checkpoint(names, "k").collect()] == [("k", 10, "checkpoint-10")]


def test_build_is_written_and_read_back(spark, tmp_path):
    frame = "class A {{\n  int first(int a) {{\n    return {};\n  }}\n}}"
    pairs = [(i, str(i), frame.format(f"a + {i}"), frame.format(f"a - {i}"), f"p{i}", f"src/A{i}.java", None, None) for i in range(6)] + [(9, "9", "x", "x", "p", "f", None, None)]
    rows = spark.createDataFrame(pairs, "ord long, bug_id string, buggy_code string, fixed_code string, project string, file_path string, suspicious_start int, suspicious_end int")
    built = building.build(rows, building.Settings(ratios=(("train", 1.0), ("validation", 0.0), ("test", 0.0))))
    said = building.report(built, {"train": 0.5, "validation": 0.5, "test": 0.0})
    assert said.empty == ["validation"] and "no records" in said.text() and set(said.lengths) == {"input", "output", "total", "input_kept"}
    counts = records.write_build(built, str(tmp_path / "out"), said)
    assert counts == {"train": 6, "validation": 0, "test": 0, "rejected": 1}
    assert (records.load_split(spark, str(tmp_path / "out"), "train").count(), records.load_split(spark, str(tmp_path / "out"), "test", required=False).count()) == (6, 0)
    assert records.count_lines(spark, str(tmp_path / "out" / "report.txt")) >= 4
    with pytest.raises(ValueError):
        records.load_split(spark, str(tmp_path / "out"), "test")
    with pytest.raises(ValueError):
        records.load_split(spark, str(tmp_path / "out"), "dev")
    with pytest.raises(FileNotFoundError):
        records.load_split(spark, str(tmp_path / "none"), "test")
    assert records.load_split(spark, str(tmp_path / "none"), "test", required=False) is None
    spark.createDataFrame([("a", None), ("b", "c")], "input string, output string").write.json(str(tmp_path / "bad" / "train"))
    with pytest.raises(PySparkException):
        records.load_split(spark, str(tmp_path / "bad"), "train").collect()
