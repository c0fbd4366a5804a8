"""Grouping of spelling variants: words of a corpus that differ by one edit, and the commoner form of each.

Words are maximal runs of letters, counted over whole texts. Pairs at one edit are found by merging in an errata trie.
The trie of all words is a table of its branching nodes (prefixes) with their heavy children, those with the most words
below. A word leaves the heavy path at its light edges, at most log2 of the number of words, and only there it is
copied (small-to-large; the end of a word is a light edge too):

- with the light character replaced: light words of one node that go on alike coincide, and the word as it would go on
  below the heavy child is looked up among all words;
- with the light character skipped: what is left is looked up;
- with the heavy character put before it, since the other word may be the heavy one: looked up as well.

Two words part at one node only, where at most one of them stays on the heavy path, so each pair is met just once. Words
that coincide at a replaced character number at most as many as there are letters; they are summed up without pairs.

Defined results: a null text has no words; a null id deletes nothing from them (see ``runs``); repeated rows count each;
an empty table gives an empty result; further columns are ignored. Words of any length are handled whole; the trie has a
row for each distinct prefix.
"""

from __future__ import annotations

import zlib
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .timeencode import crc32_sql

#: By byte of Latin-1: letters in lower case (A to Z only) and U+00C0 to U+00FF stay, everything else becomes a blank.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))
#: Words that a task holds before it hands on their counts.
HELD = 300_000


def runs(text: str, id_: str | None, every: int, least: int) -> Counter:
    """Counts of a text's words; where ``every`` divides the hash of id and word, the word loses one letter."""
    # characters beyond Latin-1 become question marks, which aren't letters
    found = Counter(text.encode("latin-1", "replace").translate(LETTERS).split())
    begin = None if id_ is None else zlib.crc32(f"{id_}:".encode())
    out = Counter()
    for word, n in found.items():
        if len(word) < least:
            continue
        if begin is not None and every:
            h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), begin)
            if h % every == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1 :]
                if len(word) < least:
                    continue
        out[word] += n
    return out


def vocabulary(docs: DataFrame, every: int = 0, least: int = 6, often: int = 5) -> DataFrame:
    """(word, n) of all words of ``least`` letters and ``often`` occurrences."""

    def counted(batches):
        import pyarrow as pa

        def made(total: Counter):
            return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in total], pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

        total = Counter()
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                for id_, text in zip(part.column("id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    if text:
                        total.update(runs(text, id_, every, least))
                if len(total) > HELD:
                    yield made(total)
                    total = Counter()
        yield made(total)

    found = docs.select(F.col("doc_id").cast("string").alias("id"), F.col("text").cast("string").alias("text")).mapInArrow(counted, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= often)


def edges(words: DataFrame) -> DataFrame:
    """(word, n, i, node, c): the path of each word through the trie; at its end, c is empty."""
    at = words.select("word", "n", F.explode(F.sequence(F.lit(0), F.length("word"))).alias("i"))
    return at.select("word", "n", "i", F.substring("word", F.lit(1), F.col("i")).alias("node"), F.substring("word", F.col("i") + 1, F.lit(1)).alias("c"))


def branches(words: DataFrame) -> DataFrame:
    """(node, heavy): nodes with two edges at least, and the character of the child with the most words (ties: the last letter)."""
    weights = edges(words).groupBy("node", "c").agg(F.count(F.lit(1)).alias("k"))
    heavy = F.max(F.when(F.col("c") != "", F.struct("k", "c")))["c"]
    return weights.groupBy("node").agg(heavy.alias("heavy"), F.count(F.lit(1)).alias("edges")).where(F.col("edges") > 1).select("node", "heavy")


def light_edges(words: DataFrame) -> DataFrame:
    """(word, n, node, c, heavy, rest): the light edges of each word, and what follows them."""
    # stored, so that the join can split the nodes below which most words stand
    nodes = stored(branches(words), "branches")
    return edges(words).join(nodes, "node").where(F.col("c") != F.col("heavy")).select("word", "n", "node", "c", "heavy", F.expr("substring(word, i + 2)").alias("rest"))


def near(words: DataFrame) -> DataFrame:
    """(word, n_near, best): how many words are at one edit, and the most frequent of them (ties: the smallest) as (minus, word)."""
    light = stored(light_edges(words), "light")
    inner = F.col("c") != ""
    sort_key = lambda n, word: F.struct((-n).alias("minus"), word.alias("word"))

    replaced = light.where(inner).groupBy("node", "rest").agg(F.sort_array(F.collect_list(sort_key(F.col("n"), F.col("word")))).alias("all")).where(F.size("all") > 1)
    other = lambda x: F.when(x["word"] == F.col("all")[0]["word"], F.col("all")[1]).otherwise(F.col("all")[0])
    replaced = replaced.select(F.size("all").alias("k"), F.inline(F.transform("all", lambda x: F.struct(x["word"].alias("word"), other(x).alias("best")))))
    replaced = replaced.select("word", (F.col("k") - 1).cast("long").alias("k"), "best")

    targets = F.array(
        F.when(inner, F.concat("node", "heavy", "rest")),
        F.when(inner & ~F.col("rest").startswith(F.col("c")), F.concat("node", "rest")),
        F.concat("node", "heavy", "c", "rest"),
    )
    asked = light.select("word", "n", F.explode(F.array_compact(targets)).alias("target"))
    pairs = asked.join(words.select(F.col("word").alias("target"), F.col("n").alias("m")), "target")
    one = F.lit(1).cast("long").alias("k")
    both = pairs.select(F.inline(F.array(F.struct("word", one, sort_key(F.col("m"), F.col("target")).alias("best")), F.struct(F.col("target").alias("word"), one, sort_key(F.col("n"), F.col("word")).alias("best")))))
    return replaced.unionByName(both).groupBy("word").agg(F.sum("k").alias("n_near"), F.min("best").alias("best"))


def rooted(links: DataFrame) -> DataFrame:
    """(word, form, form_n, root): the last form reached from each word. Paths are halved in each round; forms grow, so they end."""
    known = stored(links.withColumn("root", F.col("form")), "roots")
    while True:
        further = known.select(F.col("word").alias("_at"), F.col("root").alias("_next"))
        known = stored(known.join(further, F.col("root") == F.col("_at"), "left").withColumn("more", F.col("_next").isNotNull()).withColumn("root", F.coalesce("_next", "root")).drop("_at", "_next"), "roots")
        if not known.where("more").limit(1).count():
            return known.drop("more")
        known = known.drop("more")


def grouped(words: DataFrame, times: int = 5) -> DataFrame:
    """(word, n, n_near, form, form_n, root): a form is the commonest near word, if it is ``times`` as frequent."""
    words = stored(words, "words")
    judged = stored(words.join(near(words), "word", "left"), "near")
    common = -F.col("best.minus")
    links = judged.where(common >= times * F.col("n")).select("word", F.col("best.word").alias("form"), common.alias("form_n"))
    out = judged.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near")).join(rooted(links), "word", "left")
    return out.select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def sql(every: int = 199, least: int = 6, often: int = 5, times: int = 5) -> str:
    """The contract in DuckDB's SQL; pairs come from all words with one letter taken out."""
    crc = crc32_sql("list_concat(list_transform(string_split(doc_id::VARCHAR || ':', ''), lambda x: ascii(x)::BIGINT), flatten(list_transform(string_split(w, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195::BIGINT, unicode(x) - 64] END)))")
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""WITH RECURSIVE runs AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS w FROM documents),
lowered AS (SELECT doc_id, translate(w, '{upper}', '{upper.lower()}') AS w FROM runs),
each AS (SELECT doc_id, w, count(*) AS k FROM lowered WHERE length(w) >= {least} GROUP BY ALL),
hashed AS (SELECT *, {crc} AS h FROM each),
cut AS (SELECT CASE WHEN h % {every} = 0 THEN left(w, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word, k FROM hashed),
words AS MATERIALIZED (SELECT word, sum(k)::BIGINT AS n FROM cut WHERE length(word) >= {least} GROUP BY word HAVING sum(k) >= {often}),
less AS MATERIALIZED (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
pairs AS (
  SELECT a.word, b.word AS other, b.n AS m FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, min({{'minus': -m, 'w': other}}) AS b FROM pairs GROUP BY word),
linked AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.minus >= {times} * n THEN b.w END AS form, CASE WHEN -b.minus >= {times} * n THEN -b.minus END AS form_n
  FROM words w LEFT JOIN best USING (word)),
steps AS (SELECT word, word AS here, 0 AS k FROM linked UNION ALL SELECT s.word, l.form, k + 1 FROM steps s JOIN linked l ON s.here = l.word WHERE l.form IS NOT NULL),
last AS (SELECT word, max_by(here, k) AS root FROM steps GROUP BY word)
SELECT word, n, n_near::BIGINT AS n_near, form, form_n::BIGINT AS form_n, root FROM linked JOIN last USING (word)"""
