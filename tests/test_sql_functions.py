from pyspark.sql import functions as F

from fixcorpus.functions import sql, text


def test_sql_functions_agree_with_columns(spark):
    codes = ["", " ", "int a = 1; // x\n\tb('\\'', \"/* no */\") /* y\nz */ + 2.5f", "\\ 'open", "　x y", "// only", "é_1 ٣ 😀", None]
    paths = ["a/B.PY", "x.tar.gz", ".py", "no", "d.x/", "k.cpp", "m.H", None]
    rows = spark.createDataFrame(list(enumerate(zip(codes, paths, strict=True))), "id int, v struct<code:string,path:string>").select("id", "v.*")
    rows.createOrReplaceTempView("pieces_of_code")
    sql.register(spark)
    sql.register(spark)
    got = spark.sql("SELECT id, token_count(code) AS n, strip_comments(code) AS s, normalize_code(code) AS c, detect_language(path) AS l FROM pieces_of_code ORDER BY id")
    want = rows.select("id", text.token_count(F.col("code")), text.strip_comments(F.col("code")), text.normalize_code(F.col("code")), text.detect_language(F.col("path"))).orderBy("id")
    assert [tuple(r) for r in got.collect()] == [tuple(r) for r in want.collect()]
    assert [r.l for r in got.collect()] == ["python", None, None, None, None, "cpp", "c", None]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "UDF" not in plan and "token_count" not in plan
    assert spark.sql("SELECT count(*) AS n FROM pieces_of_code WHERE token_count(code) > 5").head().n == 1
