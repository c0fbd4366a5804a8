"""Registered queries against their SQL, on texts that the driver's small tables lack."""

from collections import Counter

import pytest

#: Empty, blank and missing texts, each with ids of every remainder by 11, beside ordinary ones. All line ends are LF, at which alone the SQL splits.
TEXTS = ("", None, " ", "\t ", "\n", " \n", "\n\n", "\xa0", "\u3000\xa0", "x", "  def f(a):\n    return None\n", "\n".join(f"  word{i} = {i}.5f" for i in range(90)))


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    pa, pq = pytest.importorskip("pyarrow"), pytest.importorskip("pyarrow.parquet")
    at = tmp_path_factory.mktemp("odd")
    texts = [TEXTS[i % len(TEXTS)] for i in range(11 * len(TEXTS))]
    ids = list(range(len(texts)))
    # of the languages one has empty texts only, one ordinary texts only
    langs = ["none" if t == "" and i % 2 else "all" if t and len(t) > 20 and i % 3 else f"l{i % 3}" for i, t in enumerate(texts)]
    rows = {"doc_id": ids, "text": texts, "lang": langs, "source": [f"s{i % 7}" for i in ids], "n_chars": [len(t or "") for t in texts]}
    pq.write_table(pa.table(rows, schema=pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])), at / "documents.parquet")
    pq.write_table(pa.table({"item_id": pa.array([3, 1], pa.int64()), "text": ["other", "the word7 of f fails"]}), at / "benchmark.parquet")
    return str(at)


def same_as_sql(spark, at, name):
    import __spark_entry__

    db = pytest.importorskip("duckdb").connect()
    for t in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{at}/{t}.parquet')")
    got, want = __spark_entry__.queries()[name](spark, at), db.execute(__spark_entry__.oracle_sql()[name]).fetchall()
    columns = [d[0] for d in db.description]
    assert sorted(columns) == sorted(got.columns)
    assert Counter(want) == Counter(tuple(r[c] for c in columns) for r in got.collect())


@pytest.mark.parametrize("name", ["localize_argmax", "localize_scores", "localized_prompt"])
def test_an_empty_text_is_a_blank_line(spark, odd, name):
    same_as_sql(spark, odd, name)


@pytest.mark.parametrize("name", ["token_count", "token_histogram", "token_series", "trainable_rows", "truncation_counts"])
def test_a_text_without_tokens_has_no_count(spark, odd, name):
    same_as_sql(spark, odd, name)


@pytest.mark.parametrize("name", ["token_percentiles", "token_stats_by_lang"])
def test_a_missing_count_is_a_row_that_ranks_last(spark, odd, name):
    same_as_sql(spark, odd, name)
