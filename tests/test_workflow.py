"""Steps of the repair workflow."""

import pytest
from pyspark.sql import functions as F

from fixcorpus.operators import workflow as w
from fixcorpus.plans import queries, workflow_queries  # noqa: F401  registers the queries

CHUNK = "array<struct<file:string,type:string,name:string,start_line:int,end_line:int,code:string>>"


def one(spark, column, **values):
    df = spark.range(1)
    for name, (value, kind) in values.items():
        df = df.withColumn(name, F.lit(value) if kind is None else F.from_json(F.lit(value), kind))
    got = df.select(column).first()[0]
    return got


def test_related_tests(spark):
    files = spark.createDataFrame([("tests/test_users.py", ""), ("t/users_test.py", ""), ("a/test_x.py", "from pkg.users import f"), ("a/test_y.py", "  import pkg.usersx"), ("a/test_z.py", "from pkg import a, users"), ("pkg/users.py", ""), ("test_changed.py", "")], "path string, text string")
    changed = spark.createDataFrame([("src/pkg/users.py",), ("test_changed.py",), ("x.md",)], "path string")
    got = [r[0] for r in w.related_tests(files, changed).collect()]
    assert got == ["a/test_x.py", "a/test_z.py", "t/users_test.py", "test_changed.py", "tests/test_users.py"]
    assert [r[0] for r in w.related_tests(files, changed, spark.createDataFrame([("a/test_x.py",)], "path string"), 2).collect()] == ["a/test_z.py", "t/users_test.py"]
    assert spark.range(1).select(w.id_prefix(F.lit("tests/test_users.py"))).first()[0] == "tests.test_users"


def test_targets_and_context(spark):
    chunks = '[{"file":"a/test_x.py","type":"function","name":"t","start_line":1,"end_line":2,"code":"t"},{"file":"b.py","type":"class","name":"K","start_line":1,"end_line":9,"code":"k"},{"file":"b.py","type":"function","name":"f","start_line":1,"end_line":5,"code":"f"},{"file":"b.py","type":"method","name":"g","start_line":3,"end_line":4,"code":"g"},{"file":"c.py","type":"function","name":"h","start_line":9,"end_line":9,"code":"h"},{"file":"b.py","type":"function","name":"i","start_line":7,"end_line":8,"code":"i"}]'
    got = one(spark, w.repair_targets(F.col("c")), c=(chunks, CHUNK))
    assert [c["name"] for c in got] == ["f", "i"]
    assert one(spark, w.code_context(F.col("c"), 1), c=(chunks, CHUNK)) == "File: b.py (lines 1-9, class K)\nk"
    assert one(spark, w.repair_targets(F.col("c")), c=("[]", CHUNK)) == []


def test_outputs(spark):
    out = "x\n2 failed, 3 passed, 1 error\n== short test summary info ==\nFAILED a - b\n  ERROR c\nother\n1 failed, 9 passed"
    assert one(spark, w.summary_counts(F.col("o")), o=(out, None))[:] == (9, 1, 1)
    assert one(spark, w.error_lines(F.col("o")), o=(out, None)) == ["FAILED a - b", "ERROR c"] and one(spark, w.error_lines(F.col("o")), o=("none", None)) == []
    assert one(spark, w.capped_output(F.col("o"), 3), o=("abcdef", None)) == "... (3 characters cut)\ndef"
    assert one(spark, w.changed_lines(F.col("p")), p=("--- a\n+++ b\n-x\n+y\n z", None)) == 2
    assert one(spark, w.first_fenced(F.col("t")), t=("a\n```python\nx = 1\n```\nb ```c```", None)) == "x = 1" and one(spark, w.first_fenced(F.col("t")), t=(" y ", None)) == "y"
    assert one(spark, w.named_tests(F.col("t")), t=("1. test_a and test_b\nno\ntest_a()", None)) == ["test_a()"]
    assert one(spark, w.first_object(F.col("t")), t=('so {bad} then {"a": 1} {"b": 2}', None)) == '{"a": 1}'
    assert one(spark, w.evidence_tools(F.col("f")), f=('["ruff.toml", ".git"]', "array<string>")) == ["ruff", "git", "pytest", "ast"]
    assert one(spark, w.test_section("T", F.col("t"), F.col("m"), 1), t=('["a", "b"]', "array<string>"), m=('{"a": "why"}', "map<string,string>")) == ["T:", "- a: why", "- ... and 1 more"]


def test_replies(spark):
    code = lambda t: one(spark, w.code_of(F.col("t")), t=(t, None))
    assert [code(t) for t in ("say\n```\n### FIXED CODE\n x\n```", "### FIXED CODE", "###FIXED CODE \n\ny", "", "### OTHER\nz")] == ["x", "### FIXED CODE", "y", "", "### OTHER\nz"]
    diff = lambda t: one(spark, w.diff_of(F.col("t")), t=(t, None))
    assert [diff(t) for t in ("a --- x\n+++ y\n-1 ", "--- x", "", "+++ y\n--- x")] == ["--- x\n+++ y\n-1\n", None, None, None]
    sure = lambda t: one(spark, w.confidence_of(F.col("t")), t=(t, None))
    assert [sure('{"confidence": %s}' % v) for v in ("0.25", "7", "-1", '"0.5"', '"NaN"', '"high"', "null")] == [0.25, 1.0, 0.0, 0.5, None, None, None]


def test_examples(spark):
    ids = lambda *x: (str(list(x)), "array<int>")
    parts = one(spark, w.infill_parts(F.col("t")), t=("a<FILL_ME>b<FILL_ME>c", None))
    assert (parts["prefix"], parts["suffix"]) == ("a", "b<FILL_ME>c") and one(spark, w.infill_parts(F.col("t")), t=("a", None)) is None
    p, c = ids(1, 2, 3, 4), ids(7, 8)
    got = one(spark, w.encoded_example(F.col("p"), F.col("c"), 6, bos=0, eos=9), p=p, c=c)
    assert (got["input_ids"], got["labels"]) == ([0, 3, 4, 7, 8, 9], [-100, -100, -100, 7, 8, 9])
    assert one(spark, w.encoded_example(F.col("p"), F.col("c"), 5, "right"), p=p, c=c)["input_ids"] == [1, 2, 3, 4, 7]
    assert one(spark, w.encoded_example(F.col("p"), F.col("c"), 2, eos=9), p=p, c=c)["labels"] == [7, 9]
    with pytest.raises(Exception, match="over 3 tokens"):
        one(spark, w.encoded_example(F.col("p"), F.col("c"), 3, "error"), p=p, c=c)
    rows = spark.createDataFrame([(1, [1, 2, 3], [-100, 2, 3]), (1, [4], [4]), (2, [5], [5])], "b int, input_ids array<int>, labels array<int>")
    got = {(r["b"], r["input_ids"][0]): r for r in w.padded(rows, "b", 0, 2).collect()}
    assert got[1, 4]["input_ids"] == [4, 0, 0, 0] and got[1, 4]["labels"] == [4, -100, -100, -100] and got[1, 4]["attention_mask"] == [1, 0, 0, 0] and got[2, 5]["input_ids"] == [5, 0]
    assert {tuple(r["input_ids"]) for r in w.padded(rows, "b", 0, 4, left=True).collect()} == {(0, 1, 2, 3), (0, 0, 0, 4), (0, 0, 0, 5)}


def test_encoded_examples_against_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    # a float's product of 100 and 0.29 is 29, a double's is less
    rows = [(i, [0.29, -0.29, 0.57, 0.58, 1.13, 1.15, 0.07, 0.0] * 8) for i in range(60)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = db.execute(queries.ORACLES["encoded_examples"]).fetchall()
    assert sorted(tuple(r) for r in queries.QUERIES["encoded_examples"](spark, str(tmp_path)).collect()) == sorted(want)
