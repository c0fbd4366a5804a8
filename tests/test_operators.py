"""Operators, sources and the whole build."""

import difflib
import functools
import hashlib
import json
import math
import random
import re
import struct
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fixcorpus.operators import cleaning, corpus, runs, search
from fixcorpus.plans import build as building
from fixcorpus.plans import queries
from fixcorpus.sources import records
from fixcorpus.streaming import duplicates as streaming

METHOD = "class C{n} {{\n  int f{n}(int a) {{\n    int b = {n};\n    return a {op} b;\n  }}\n}}\n"
PAIR = "ord long, bug_id string, buggy_code string, fixed_code string, suspicious_start int, suspicious_end int, file_path string, project string"


def pair(i, buggy=None, fixed=None, start=None, end=None, path=None, project=None):
    return (i, f"b{i}", METHOD.format(n=i, op="+") if buggy is None else buggy, METHOD.format(n=i, op="-") if fixed is None else fixed, start, end, path, project or f"p{i % 7}")


def mixed():
    two = "class A {\n  int f() {\n    return 1;\n  }\n  int g() {\n    return 2;\n  }\n}"
    rows = [pair(i) for i in range(40)]
    rows += [
        pair(100, "  \n", "x"), pair(101, "same", "same"), pair(102, "a\r\nb", "a\nb"), pair(103, start=9, end=9), pair(104, start=3, end=2),
        pair(105, "\n".join("abcdefgh"[i % 8] * i for i in range(60)), "\n".join(f"y{i}" for i in range(60))), pair(106, path="src/test/X.java"), pair(107, two, two.replace("1", "3").replace("2", "4")),
        pair(108, "int x;\n", "int y;\n"), pair(109, METHOD.format(n=3, op="+") + "// c\n", METHOD.format(n=3, op="-")), pair(110, METHOD.format(n=5, op="+").replace("  ", "\t"), METHOD.format(n=5, op="-").replace("  ", "\t ")),
    ]
    return rows


REASONS = {100: "empty_source", 101: "identical", 102: "no_change", 103: "invalid_region", 104: "invalid_region", 105: "diff_too_large", 106: "test_only", 107: "not_single_function", 108: "not_single_function", 109: "duplicate", 110: "duplicate"}


def test_cleaning(spark):
    rows = {r["ord"]: r for r in cleaning.clean(spark.createDataFrame(mixed(), PAIR)).collect()}
    for i, r in rows.items():
        want = REASONS.get(i)
        assert r["reason"] == (None if want == "duplicate" else want), i
    assert rows[107]["detail"] == "f, g" and rows[0]["suspicious_start"] == rows[0]["suspicious_end"] == 4
    with pytest.raises(ValueError):
        cleaning.Rules(min_diff=5, max_diff=1)


def test_build_adds_up(spark):
    rows = mixed()
    random.Random(2).shuffle(rows)
    built = building.build(spark.createDataFrame(rows, PAIR).repartition(3)).cache()
    out = {r["ord"]: r for r in built.collect()}
    assert len(out) == len(rows)
    assert {i: r["reason"] for i, r in out.items() if r["reason"]} == REASONS
    assert out[110]["detail"] == "duplicate of b5 (normalized)"
    kept = [r for r in out.values() if not r["reason"]]
    for r in kept:
        assert r["output"] in r["fixed_code"] and "<FILL_ME>" in r["input"] and r["input_tokens"] > r["output_tokens"] > 0 and r["split"]
    assert max(Counter((r["project"], r["split"]) for r in kept).values()) and all(len({r["split"] for r in kept if r["project"] == p}) == 1 for p in {r["project"] for r in kept})
    report = building.report(built)
    assert report.stages[0]["received"] == len(rows) and report.stages[-1]["kept"] == len(kept) == sum(report.splits.values())
    assert report.reasons == dict(Counter(REASONS.values())) and sum(report.reasons.values()) + len(kept) == len(rows)
    assert report.lengths["input"]["count"] == len(kept) and "clean" in report.text()
    again = {r["ord"]: r["split"] for r in building.build(spark.createDataFrame(sorted(rows), PAIR)).collect()}
    assert again == {i: r["split"] for i, r in out.items()}


def test_empty_build(spark):
    built = building.build(spark.createDataFrame([], PAIR))
    assert built.count() == 0 and building.report(built).splits == {"train": 0, "validation": 0, "test": 0}


def test_statistics(spark):
    rng = random.Random(4)
    values = [rng.randint(0, 3000) for _ in range(101)] + [64, 0, 2048, 2049]
    df = spark.createDataFrame([("x", v) for v in values] + [("y", 7)], "k string, n long")
    got = {r["k"]: r for r in corpus.token_stats(df, ["k"]).collect()}
    import statistics

    ordered = sorted(values)
    r = got["x"]
    assert (r["count"], r["total"], r["min"], r["max"], r["median"]) == (len(values), sum(values), min(values), max(values), statistics.median(values))
    assert [r["p90"], r["p95"], r["p99"]] == [ordered[round(f * (len(values) - 1))] for f in (0.90, 0.95, 0.99)] and abs(r["mean"] - statistics.fmean(values)) < 0.006
    assert got["y"]["median"] == 7 and got["y"]["p99"] == 7
    low = (0, *corpus.EDGES)
    want = {f"{a}-{b}": sum(a < v <= b for v in values) for a, b in zip(low, corpus.EDGES, strict=False)} | {">2048": sum(v > 2048 for v in values)}
    assert {r["bucket"]: r["n"] for r in corpus.histogram(df.where("k = 'x'")).collect()} == want
    assert corpus.token_stats(df.limit(0), ["k"]).count() == 0


def test_limits(spark):
    df = spark.createDataFrame([(2000, 5), (10, 300), (10, 0), (800, 200), (5, 5)], "input_tokens int, output_tokens int")
    assert [r[0] for r in df.select(corpus.length_reason(corpus.Limits(1024, 256, 900, 1))).collect()] == ["input_too_long", "output_too_long", "output_too_long", "input_too_long", None]
    with pytest.raises(ValueError):
        corpus.Limits(0)


def plain_greedy(sizes, ratios, order):
    total, count, out = sum(sizes.values()), Counter(), {}
    for key in order:
        split = min((((count[s] + sizes[key]) / max(r * total, 1e-9)), s) for s, r in ratios.items() if r > 0)[1]
        count[split] += sizes[key]
        out[key] = split
    return out


@pytest.mark.parametrize("shuffle", ["hash", "python"])
def test_group_split(spark, shuffle):
    import hashlib

    rng = random.Random(5)
    keys = [f"k{rng.randrange(60)}" for _ in range(600)]
    df = spark.createDataFrame(list(enumerate(keys)), "i long, key string").repartition(5)
    ratios = {"train": 0.9, "validation": 0.05, "test": 0.05}
    got = {r["key"]: r["split"] for r in corpus.split_groups(df, "key", ratios, 7, shuffle).collect()}
    sizes = Counter(keys)
    if shuffle == "python":
        order = sorted(sizes)
        random.Random(7).shuffle(order)
    else:
        order = sorted(sizes, key=lambda k: hashlib.sha256(f"7:{k}".encode()).hexdigest())
    assert got == plain_greedy(sizes, ratios, sorted(order, key=lambda k: -sizes[k])) and len(set(got.values())) == 3


def test_record_split(spark):
    df = spark.range(100).withColumnRenamed("id", "bug_id")
    ratios = {"train": 0.9, "validation": 0.05, "test": 0.05}
    one = {r["bug_id"]: r["split"] for r in corpus.split_records(df, "bug_id", ratios).collect()}
    two = {r["bug_id"]: r["split"] for r in corpus.split_records(df.repartition(7), "bug_id", ratios).collect()}
    assert one == two and Counter(one.values()) == {"train": 90, "validation": 5, "test": 5}
    assert one != {r["bug_id"]: r["split"] for r in corpus.split_records(df, "bug_id", ratios, 1).collect()}
    with pytest.raises(ValueError):
        corpus.split_records(df, "bug_id", {"train": 0.5})


def test_duplicates_keep_the_first(spark):
    df = spark.createDataFrame([(3, "c", "a  b", "x"), (1, "a", "a b", "x"), (2, "b", "a b // y", "x"), (4, "d", "a b", "z")], "ord int, bug_id string, buggy_code string, fixed_code string")
    of = lambda s: {r["bug_id"]: r["duplicate_of"] for r in corpus.duplicates(df, s).collect()}
    assert of("exact") == {"a": None, "b": None, "c": None, "d": None}
    assert of("normalized") == {"a": None, "b": "a", "c": "a", "d": None} and of("input_only") == {"a": None, "b": "a", "c": "a", "d": "a"}


def test_streaming_duplicates(spark, tmp_path):
    rows = [{"bug_id": str(i), "buggy_code": f"a{i % 3}  x", "fixed_code": "y"} for i in range(9)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text("\n".join(map(json.dumps, rows)))
    stream = spark.readStream.schema("bug_id string, buggy_code string, fixed_code string").json(str(tmp_path / "in"))
    run = streaming.first_seen(stream).writeStream.format("memory").queryName("firsts").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert spark.table("firsts").count() == 3


# -- sources ---------------------------------------------------------------------------------------


def test_jsonl(spark, tmp_path):
    rows = [{"id": "1", "before": "a\nb", "after": "a\nc", "stars": 3}, {"commit": {"sha": "2"}, "buggy": "x", "fixed": "y", "start": "1", "end": 1, "meta": {"k": "v"}}, {"id": "3", "buggy": "x"}, {"id": "4", "buggy": "x", "fixed": "z", "start": 1.5, "end": 2}]
    path = tmp_path / "a.jsonl"
    path.write_text("\n\n".join(map(json.dumps, rows)) + "\n")
    fields = records.FieldMap(bug_id=("id", "commit.sha"))
    got = records.read_pairs(spark, str(path), fields=fields, skip_invalid=True).orderBy("ord").collect()
    assert [(r["bug_id"], r["suspicious_start"], r["suspicious_end"], r["metadata"]) for r in got] == [("1", 2, 2, {"stars": "3"}), ("2", 1, 1, {"k": "v"})]
    assert records.read_pairs(spark, str(path), fields=fields, skip_invalid=True, limit=1).count() == 1
    with pytest.raises(Exception, match="missing fixed_code|line number"):
        records.read_pairs(spark, str(path), fields=fields).collect()
    path.write_text('{"id": 1}\nnot json\n')
    with pytest.raises(Exception, match="not a JSON object"):
        records.read_pairs(spark, str(path), skip_invalid=True).collect()
    with pytest.raises(ValueError, match="unknown format"):
        records.read_pairs(spark, str(path), "csv")


def test_json_and_registered_readers(spark, tmp_path):
    path = tmp_path / "a.json"
    for made in ([{"id": "1", "buggy": "a", "fixed": "b"}], {"x": {"id": "1", "buggy": "a", "fixed": "b"}}):
        path.write_text(json.dumps(made))
        assert [r["bug_id"] for r in records.read_pairs(spark, str(path), "json").collect()] == ["1"]
    records.register_reader("again", records.read_json)
    assert "again" in records.available_formats() and records.read_pairs(spark, str(path), "again").count() == 1


def test_directories(spark, tmp_path):
    for name, files in {"p1/b1": {"buggy.java": "a", "fixed.java": "b"}, "p1/b2": {"buggy.java": "c"}, "p2/b3": {"buggy.java": "d", "fixed.java": "e", "metadata.json": '{"project": "other"}'}}.items():
        (tmp_path / "src" / name).mkdir(parents=True)
        for f, t in files.items():
            (tmp_path / "src" / name / f).write_text(t)
    got = records.read_pairs(spark, str(tmp_path / "src"), "directory", layout=records.Layout(project="^[^/]+")).orderBy("ord").collect()
    assert [(r["bug_id"], r["buggy_code"], r["fixed_code"], r["project"]) for r in got] == [("b1", "a", "b", "p1"), ("b3", "d", "e", "other")]
    with pytest.raises(ValueError):
        records.Layout(bug_id="else")


def test_reports(spark, tmp_path):
    (tmp_path / "r.xml").write_text("""<testsuite><testcase classname="m" name="a"/><testcase classname="m" name="b"><failure message="KeyError: 1">x</failure></testcase>
<testcase classname="m" name="c"><error message="boom"/></testcase><testcase classname="" name="d"><skipped/></testcase></testsuite>""")
    got = {(r["test_id"], r["outcome"], r["message"]) for r in records.read_reports(spark, str(tmp_path / "r.xml")).collect()}
    assert got == {("m::a", "passed", None), ("m::b", "failed", "KeyError: 1"), ("m::c", "error", "boom"), ("d", "skipped", None)}


def test_writing(spark, tmp_path):
    df = spark.createDataFrame([("i", "o", "train", None), ("j", "p", "train", "x")], "input string, output string, split string, project string")
    assert records.write_splits(df, str(tmp_path / "out")) == {"train": 2, "validation": 0, "test": 0}
    lines = [json.loads(r[0]) for r in spark.read.text(str(tmp_path / "out/train")).collect()]
    assert sorted(map(list, lines)) == [["input", "output"], ["input", "output", "project"]]


# -- search and runs -------------------------------------------------------------------------------


def test_localization(spark):
    lines = ["def f():", "    # if bug", "    pass", "    return  None", "x = login_user == 1", ""]
    df = spark.createDataFrame([("f", lines)], "file string, lines array<string>")
    tokens = search.issue_tokens(F.lit("The login_user function returns a bug in x"))
    scored = {r["number"]: r["score"] for r in search.scored_lines(df, tokens).collect()}
    assert scored == {1: 0.0, 2: 6.0, 3: 2.0, 4: 1.0, 5: 2.5, 6: 0.0}
    ranges = F.array(F.struct(F.lit(3).alias("start"), F.lit(5).alias("end")))
    best = search.most_suspicious(search.scored_lines(df, tokens, ranges), "file").first()
    assert (best["number"], best["score"]) == (5, 2.5)
    nodes = spark.createDataFrame([([("class", 1, 9)],), ([("class", 1, 9), ("method", 2, 4)],), ([],)], "n array<struct<type:string,start_line:int,end_line:int>>")
    got = [[tuple(x) for x in r[0]] for r in nodes.select(search.allowed_ranges(F.col("n"), F.lit(6))).collect()]
    assert got == [[(1, 6)], [(2, 4)], [(1, 6)]]


def test_triage(spark):
    df = spark.createDataFrame([("A NullPointer",), ("index out",), ("it is SLOW",), ("nothing",)], "t string")
    assert [r[0] for r in df.select(search.classify(F.col("t"))).collect()] == ["null_reference", "boundary_error", "performance", "unknown"]
    assert df.select(search.advice(F.lit("unknown"))).first()[0].startswith("Analyze")
    assert df.select(search.tools(F.lit(" Java ")), search.tools(F.lit(None))).first()[:] == (["JUnit", "Checkstyle", "Git"], ["Git"])
    assert df.select(search.test_names(F.lit("User cannot Login twice now"), F.lit("def f(x): function g ()"))).first()[0] == ["test_f()", "test_g()", "test_user_cannot_login()"]
    assert df.select(search.test_names(F.lit("a b"), F.lit(None))).first()[0] == ["test_reported_issue()"]


def test_nearest_breaks_ties_by_id(spark):
    df = spark.createDataFrame([(3, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 2.0]), (4, [0.0, 0.0])], "vec_id long, embedding array<double>")
    got = [(r["id"], r["score"]) for r in search.nearest(df, df.where("vec_id = 3"), 3).orderBy("rank").collect()]
    assert got == [(1, 0.0), (3, 0.0), (4, 1.0)]
    assert [r["id"] for r in search.nearest(df, df.where("vec_id = 2"), 4, "cosine").orderBy("rank").collect()] == [2, 1, 3, 4]
    with pytest.raises(ValueError):
        search.nearest(df, df, 1, "dot")


CASES = [
    ({"a": "failed"}, {"a": "passed"}, "solved"), ({"a": "passed"}, {"a": "failed"}, "failed"), ({"a": "passed"}, {}, "failed"), ({"a": "failed"}, {"a": "failed"}, "unverified"),
    ({"a": "passed"}, {"a": "passed"}, "unverified"), ({"a": "skipped"}, {"a": "failed"}, "unverified"), ({"a": "failed"}, {"a": "passed", "n": "error"}, "failed"), ({}, {"a": "passed"}, "unverified"),
    ({"a": "passed", "b": "error"}, {"a": "passed", "b": "passed"}, "solved"),
]


def test_verdicts(spark):
    rows = lambda side: [(i, t, o) for i, c in enumerate(CASES) for t, o in c[side].items()]
    schema = "run int, test_id string, outcome string"
    changes = runs.compared(spark.createDataFrame(rows(0), schema), spark.createDataFrame(rows(1), schema), ("run",))
    got = {r["run"]: r for r in runs.verdicts(changes, ("run",)).collect()}
    assert [got[i]["status"] for i in range(len(CASES))] == [c[2] for c in CASES]
    assert got[1]["reason"] == "The patch broke 1 previously passing test(s)." and "added 1 failing" in got[6]["reason"]
    repro = spark.createDataFrame([(0, "a"), (8, "a"), (8, "zz")], "run int, test_id string")
    got = {r["run"]: r for r in runs.verdicts(changes, ("run",), repro).collect()}
    assert got[0]["status"] == "solved" and got[0]["reason"].endswith("reproduction test now passes.") and got[8]["status"] == "unverified"


def test_failures_and_attempts(spark):
    rows = [("", "not valid Python", None, None, 0, 0, []), ("", "x", None, None, 0, 0, []), (" ", None, None, None, 0, 0, []), ("p", None, "REJECTED", None, 0, 0, []), ("p", None, "APPLIED", "syntax", 0, 0, []),
            ("p", None, None, None, 2, 2, ["KeyError"]), ("p", None, "APPLIED", None, 0, 1, ["KeyError: 'x'"]), ("p", None, "APPLIED", None, 0, 1, ["AssertionError: 1"]), ("p", None, "APPLIED", None, 0, 1, [""]), ("p", None, "APPLIED", None, 0, 0, [])]
    df = spark.createDataFrame(rows, "p string, e string, s string, st string, b int, f int, m array<string>")
    got = [r[0] for r in df.select(runs.failure_type(*[F.col(c) for c in ("p", "e", "s", "st", "b", "f", "m")])).collect()]
    assert got == ["syntax_error", "compilation_error", "unknown", "patch_application_error", "syntax_error", "regression", "runtime_error", "logic_error", "test_failure", "unknown"]
    tries = spark.createDataFrame([(1, 1, "failed", 2, 0, True), (1, 2, "unverified", 0, 0, True), (1, 3, "unverified", 0, 1, False), (1, 4, "unverified", 0, 1, True), (1, 5, "unverified", 0, 1, True)], "k int, attempt int, status string, broken int, fixed int, applied boolean")
    assert runs.best_attempts(tries, "k").first()["attempt"] == 4
    assert [r["best_so_far"] for r in runs.running_best(tries, "k").orderBy("attempt").collect()] == [1, 2, 3, 4, 4]
    assert [r["attempt"] for r in tries.orderBy(*runs.attempt_order()).collect()][0] == 4


def test_scores(spark):
    df = spark.createDataFrame([([1, 2, 3], [-100, 1, 2]), ([5, 5, 5], [-100, 5, 6]), ([1], [1])], "predictions array<int>, labels array<int>")
    got = runs.accuracies(df).first()
    assert (got["token_accuracy"], got["sequence_accuracy"]) == (0.75, 0.5)
    assert df.select(runs.exact_match(F.array(F.lit("a b"), F.lit("c")), F.lit("ab\n")), runs.perplexity(F.lit(61.0)), runs.perplexity(F.lit(None).cast("double"))).first()[:] == (True, float("inf"), None)


def test_compiles(spark):
    df = spark.createDataFrame([("x = 1",), ("def (",), (None,)], "t string")
    assert [r[0] for r in df.select(cleaning.compiles("t")).collect()] == [True, False, None]


# -- registered queries ----------------------------------------------------------------------------


def test_registered_queries(spark, data):
    import __spark_entry__

    duckdb = pytest.importorskip("duckdb")
    from fixcorpus.plans import queries

    db = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")
    whole = lambda x: round(x, 6) if isinstance(x, float) else x
    for name, sql in queries.ORACLES.items():
        got, want = queries.QUERIES[name](spark, data), db.execute(sql).fetchall()
        columns = [d[0] for d in db.description]
        assert sorted(columns) == sorted(got.columns), name
        assert Counter(tuple(map(whole, r)) for r in want) == Counter(tuple(whole(r[c]) for c in columns) for r in got.collect()), name
    assert set(queries.QUERIES) <= set(__spark_entry__.queries()) and set(queries.ORACLES) <= set(__spark_entry__.oracle_sql())
    assert __spark_entry__.entry(spark).count() > 0


def test_imports_without_training_data_folder(tmp_path):
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/fixcorpus", tmp_path / "fixcorpus", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert 'token_count' in e.queries() and not any(k.startswith('op') and k[2:3].isdigit() for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})


def test_build_corpus_reads_the_whole_text(spark, tmp_path):
    rng = random.Random(5)
    line = lambda: rng.choice(["", "x", 'say "no" // here', "a\\b { (", "  same  "]) + rng.choice(["", f" w{rng.randrange(40)}"])
    texts = ["\n".join(line() for _ in range(rng.randint(1, 40))) for _ in range(500)]
    texts += texts[:30] + [texts[0] + "\n" + texts[0] + " end", "\n".join(["x"] * 30), "", "\n".join(f"line {i}" for i in range(3000)), "word " * 3000]
    rows = [(i, x, f"s{i % 9}") for i, x in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["ord"]: r for r in queries.build_corpus(spark, str(tmp_path)).collect()}
    assert set(got) == {i for i, *_ in rows}
    seen, renders = {}, 0
    for i, x, _ in rows:
        a = [*['    log("' + s.replace("\\", "\\\\").replace('"', '\\"') + '");' for s in (x[:-1] if x.endswith("\n") else x).split("\n") if x], "    return a;"]
        k = zlib.crc32(x.encode()) % len(a)
        b = [*a[:k], "    if (a > 0)" + a[k], *a[k + 1 :]]
        first = seen.setdefault(re.sub(r"\s+", " ", "\n".join(a) + "\1" + "\n".join(b)), i)
        if first != i:
            assert got[i]["reason"] == "duplicate", x
            continue
        frame = lambda lines: ["class A {", "  int first(int a) {", *lines, "  }", "}"]
        a, b = frame(a), frame(b)
        ops = [o for o in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes() if o[0] != "equal"]
        if sum(o[2] - o[1] + o[4] - o[3] for o in ops) > 50:
            assert got[i]["reason"] == "diff_too_large"
            continue
        assert got[i]["output"] == "\n".join(b[min(o[3] for o in ops) : max(o[4] for o in ops)]), x
        assert got[i]["stage"] in (None, "lengths") and (got[i]["split"] is None) == (got[i]["reason"] is not None)
        renders += got[i]["reason"] is None
    assert renders > 400 and got[len(rows) - 1]["reason"] in ("input_too_long", "output_too_long")
    assert sum(r["reason"] == "duplicate" for r in got.values()) >= 30


def test_edits_of_all_documents(spark, tmp_path):
    rng = random.Random(6)
    texts = ["\n".join(rng.choice(["", "", "x", "x!", "y", f"w{rng.randrange(9)}"]) for _ in range(rng.randint(1, 12))) for _ in range(300)] + ["", None, "x\nx\nx", "x\nx!"]
    rows = [(i, x) for i, x in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    span, target, made = ({r["doc_id"]: r for r in f(spark, str(tmp_path)).collect()} for f in (queries.changed_span, queries.or2_target, queries.pycorpus_rows))
    assert set(span) == set(target) == set(made) == {i for i, _ in rows}
    for i, x in rows:
        x = x or ""
        a = (x[:-1] if x.endswith("\n") else x).split("\n") if x else []
        k = i % len(a) if a else 0
        b = [*a[:k], a[k] + "!", *a[k + 1 :]] if a else ["!"]
        ops = [o for o in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes() if o[0] != "equal"]
        i1, i2, j1, j2 = min(o[1] for o in ops), max(o[2] for o in ops), min(o[3] for o in ops), max(o[4] for o in ops)
        first, last = (max(1, i1), max(1, i1)) if i2 <= i1 else (i1 + 1, i2)
        assert (span[i]["first"], span[i]["last"], span[i]["size"]) == (first, last, sum(o[2] - o[1] + o[4] - o[3] for o in ops)), x
        outside = any(not k <= o[1] <= k + 1 if o[1] == o[2] else not (o[1] >= k and o[2] <= k + 1) for o in ops)
        assert target[i]["outside"] == outside, x
        if not outside:
            assert target[i]["target"] == "\n".join(b[k : k + 1]) or (i1, i2) != (k, k + 1), x
        prompt = [*a[:i1], "# BUGGY CODE", *["#" if s == "" else "# " + s for s in a[i1:i2]], "<FILL_ME>", *a[i2:]]
        want = (i1, i2, hashlib.sha256("\n".join(prompt).encode()).hexdigest(), "\n".join(b[j1:j2]))
        assert tuple(made[i])[1:] == want, x


def test_perplexity_of_all_events(spark, tmp_path):
    rows = [(i, v) for i, v in enumerate([0.0, 0.5, 2.0, 19.99, 20.0, 45.25, 59.9, 60.0, 60.1, 99.0, -1.0, None])]
    spark.createDataFrame(rows, "event_id long, value double").write.parquet(str(tmp_path / "events.parquet"))
    got = {r["event_id"]: r for r in queries.perplexity_bound(spark, str(tmp_path)).collect()}
    assert set(got) == {i for i, _ in rows}
    for i, v in rows:
        bounded = v is not None and v <= 60
        assert got[i]["unbounded"] == (v is not None and v > 60) and (got[i]["mantissa"] is not None) == bounded
        assert not bounded or math.isclose(got[i]["mantissa"] * 10.0 ** got[i]["exponent"], math.exp(v), rel_tol=1e-8), v


def test_token_limits_of_whole_outputs(spark, tmp_path):
    # one token for each short word; 1500 blanks hide the later words from a prefix
    counts = [(0, 0), (19, 0), (20, 0), (256, 0), (257, 0), (30, 300), (30, 100), (600, 600)]
    rows = [(i, " ".join(["a"] * a) + (" " * 1500 + " ".join(["a"] * b) if b else "")) for i, (a, b) in enumerate(counts)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = Counter()
    for a, b in counts:
        n = a + b
        want["input_too_long" if n > 1024 else "output_too_long" if n > 256 or n < 20 else "input_too_long" if 2 * n > 900 else "kept"] += 1
    assert {r["reason"]: r["n"] for r in queries.token_limit_reject(spark, str(tmp_path)).collect()} == want


def test_neighbours_in_blocks(spark, monkeypatch):
    rows = [(i, [float(i % 7), float(i % 5), 1.0]) for i in range(60)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asked = vectors.where("vec_id % 4 = 0")
    whole = {tuple(r) for r in search.nearest(vectors, asked, 3).collect()}
    monkeypatch.setattr(search, "BLOCK", 4)
    assert {tuple(r) for r in search.nearest(vectors, asked, 3).collect()} == whole and len(whole) == 45
    assert search.nearest(vectors, asked.limit(0), 3).count() == 0 and search.nearest(vectors.limit(0), asked, 3).count() == 0


def test_neighbours_against_all_pairs(spark, monkeypatch):
    rng = random.Random(5)
    vector = lambda: [rng.choice([-1.0, 0.0, 0.5, 3.0, 1e-3]) for _ in range(6)]
    rows = {i: vector() for i in range(150)} | {200: None, 201: [1.0, None, 2.0, 0.0, 0.0, 0.0], 202: [1.0], 203: [0.0] * 6, 204: []}
    rows |= {300 + i: rows[i] for i in range(40)}
    vectors = spark.createDataFrame(list(rows.items()), "vec_id long, embedding array<float>")
    asked = [0, 3, 6, 200, 201, 202, 203]
    f = lambda x: [struct.unpack("f", struct.pack("f", y))[0] for y in x]

    def score(metric, a, b):
        if a is None or b is None or len(a) != len(b) or None in a or None in b:
            return None
        a, b = f(a), f(b)
        # one after the other; Python's own sum compensates for rounding
        added = lambda x: functools.reduce(lambda s, t: s + t, x, 0.0)
        if metric == "l2":
            return added((x - y) * (x - y) for x, y in zip(a, b, strict=True))
        norm = added(x * x for x in a) * added(x * x for x in b)
        return max(-1.0, min(1.0, added(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(norm))) if norm else None

    monkeypatch.setattr(search, "VECTORS", 40, raising=False)
    for metric, sign in (("l2", 1), ("cosine", -1)):
        got = search.nearest(vectors, vectors.where(F.col("vec_id").isin(asked)), 7, metric).collect()
        for q in asked:
            scored = sorted((s is None, sign * (s or 0.0), i, s) for i, v in rows.items() for s in [score(metric, rows[q], v)])[:7]
            found = sorted((r for r in got if r["query"] == q), key=lambda r: r["rank"])
            assert [(r["rank"], r["id"]) for r in found] == [(n + 1, i) for n, (_, _, i, _) in enumerate(scored)]
            assert [r["score"] for r in found] == pytest.approx([s for *_, s in scored])


def test_line_numbers_out_of_range(spark):
    df = spark.createDataFrame([("99999999999",), ("-7",), (" 12 ",), ("x",), (None,)], "t string")
    number, wrong = records.line_number(F.col("t"))
    assert [tuple(r) for r in df.select(number, wrong).collect()] == [(None, True), (-7, False), (12, False), (None, True), (None, False)]


def test_similar_texts_against_all_pairs(spark, monkeypatch):
    rng = random.Random(3)
    said = lambda: " ".join(rng.choice(["null", "index", "Loop", "crash", "x"]) for _ in range(rng.randint(0, 9)))
    texts = [(i, said()) for i in range(120)] + [(120, None), (121, ""), (122, "null " * 100), (3, "index x")]
    asked = [(1000 + i, said()) for i in range(7)] + [(2000, None)]
    monkeypatch.setattr(cleaning, "BLOCK", 3)
    frame = lambda rows: spark.createDataFrame(rows, "id long, text string").withColumn("rank", F.lit(0))
    got = cleaning.similar_texts(frame(asked), frame(texts)).collect()
    ratio = lambda a, b: round(difflib.SequenceMatcher(None, (a or "").lower(), (b or "").lower()).ratio(), 2)
    for q, text in asked:
        want = sorted((-ratio(text, t), i) for i, t in texts)[:3]
        assert [(-r["similarity"], r["id"]) for r in sorted((r for r in got if r["query"] == q), key=lambda r: r["rank"])] == want
    assert cleaning.similar_texts(frame(asked[:1]), frame([])).count() == cleaning.similar_texts(frame([]), frame(texts)).count() == 0


def test_funnel_has_one_join_without_text(spark, tmp_path):
    texts = ["", "a b", "a  b", "c\n", "x " * 500, "x  " * 500, None, "d", "e", "f", "a b", "a b"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = queries._tagged(spark, str(tmp_path))
    got = {r["doc_id"]: (r["stage"], r["reason"]) for r in rows.collect()}
    assert (got[0], got[11], got[5]) == (("clean", "empty_source"), ("clean", "empty_source"), ("duplicates", "duplicate")) and got[1] == ("clean", "empty_source")
    assert got[4] == ("lengths", "input_too_long") and got[10] == ("clean", "identical") and got[2] == got[6] == got[7] == (None, None)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1


def test_opcodes_hold_one_row_s_lines(spark):
    from fixcorpus.functions import diff

    assert diff.opcodes.evalType == F.arrow_udf(lambda x: x, "int").evalType
    rows = spark.createDataFrame([(1, ["a", "b"], ["a", "c"]), (2, None, ["a"]), (3, [], []), (4, [], ["a"])], "i int, a array<string>, b array<string>")
    got = {r["i"]: r["o"] if r["o"] is None else [tuple(o) for o in r["o"]] for r in rows.select("i", diff.opcodes("a", "b").alias("o")).collect()}
    assert got == {1: [("equal", 0, 1, 0, 1), ("replace", 1, 2, 1, 2)], 2: None, 3: [], 4: [("insert", 0, 0, 0, 1)]}
