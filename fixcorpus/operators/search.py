"""Nearest neighbours, fault localization and triage of issues."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import let, py_strip

# Words of an issue that don't count.
IGNORED = (
    "the", "and", "for", "with", "from", "that", "this", "where", "when", "into", "should", "could", "would",
    "have", "has", "does", "are", "was", "were", "bug", "buggy", "code", "issue", "function", "method", "file",
    "repository",
)
# Categories of repair, in the order in which they are tried, with their key words and advice.
STRATEGIES = (
    ("null_reference", ("none", "null", "nonetype", "attributeerror"), "Add null/None validation before dereferencing."),
    ("boundary_error", ("index", "range", "off by one", "out of bounds", "indexerror", "empty"), "Correct the boundary condition or index range."),
    ("input_validation", ("invalid input", "validation", "malformed", "sanitize"), "Validate and sanitize the input before use."),
    ("performance", ("slow", "performance", "timeout", "memory", "optimize"), "Optimize the algorithm or data structure."),
    ("exception_handling", ("exception", "traceback", "crash", "raises", "error handling"), "Add or correct exception handling."),
    ("logic_error", ("incorrect", "wrong", "unexpected", "should return", "logic"), "Fix the conditional logic or operator."),
    ("unknown", (), "Analyze the code and apply the minimal correct fix."),
)
# Tools for a language.
TOOLS = {
    "python": ("Pytest", "Ruff", "Git"),
    "javascript": ("Jest", "ESLint", "Git"),
    "typescript": ("Jest", "ESLint", "TypeScript Compiler", "Git"),
    "java": ("JUnit", "Checkstyle", "Git"),
    "kotlin": ("JUnit", "ktlint", "Git"),
    "go": ("go test", "golangci-lint", "Git"),
    "rust": ("cargo test", "clippy", "Git"),
    "ruby": ("RSpec", "RuboCop", "Git"),
    "c": ("Unity", "cppcheck", "Git"),
    "cpp": ("Google Test", "cppcheck", "Git"),
    "c_sharp": ("NUnit", "dotnet format", "Git"),
    "php": ("PHPUnit", "PHP_CodeSniffer", "Git"),
}


#: Queries of one block of ``nearest``, vectors of one of its tasks, and pairs that a task compares at a time.
BLOCK, VECTORS, PAIRS = 16_384, 8_192, 1 << 20


def nearest(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "l2", id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query, id, score, rank): the exact ``k`` nearest of each stated query, by squared distance or cosine, ties by id.

    Queries are handled in blocks of about ``BLOCK``, each broadcast. A task packs its vectors into a matrix, finds by matrix
    products which can be among the best ``k`` of a query, and computes the scores of these term by term. Pairs without a
    score (null vectors or terms, other lengths, a cosine with a zero vector) come last.
    """
    if metric not in ("l2", "cosine"):
        raise ValueError(f"unknown metric {metric!r}")
    blocks = max(1, -(-queries.count() // BLOCK))
    parts = max(2 * vectors.sparkSession.sparkContext.defaultParallelism, -(-vectors.count() // VECTORS))
    packed = _packed(vectors.select(id_col, vector).repartition(parts, id_col))
    asked = queries.select(id_col, vector)
    blocks_of = [_packed(asked.where(F.pmod(F.xxhash64(id_col), F.lit(blocks)) == i).repartition(8, id_col)) for i in range(blocks)]
    kind = vectors.schema[id_col].dataType
    schema = T.StructType([T.StructField("query", queries.schema[id_col].dataType), T.StructField("id", kind), T.StructField("score", T.DoubleType())])
    found = [packed.crossJoin(F.broadcast(b.toDF("q_size", "q_ids", "q_terms"))).mapInArrow(_compared(k, metric), schema) for b in blocks_of]
    order = F.asc_nulls_last("score") if metric == "l2" else F.desc_nulls_last("score")
    best = Window.partitionBy("query").orderBy(order, "id")
    return functools.reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _packed(rows: DataFrame) -> DataFrame:
    """(size, ids, terms): rows (id, vector) of a batch with vectors of one size as one row, by id; size is -1 for those with nulls."""
    schema = T.StructType([T.StructField("size", T.IntegerType()), T.StructField("ids", T.ArrayType(rows.schema[0].dataType)), T.StructField("terms", T.BinaryType())])

    def packed(batches):
        for batch in batches:
            order = pc.sort_indices(batch.column(0), null_placement="at_start")
            ids, lists = batch.column(0).take(order), batch.column(1).take(order)
            sizes = pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False).astype("int32")
            parents, terms = pc.list_parent_indices(lists), lists.flatten()
            sizes[parents.filter(pc.is_null(terms)).to_numpy(zero_copy_only=False)] = -1
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                own = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype("float64").tobytes() if size > 0 else b""
                yield pa.RecordBatch.from_arrays([pa.array([size], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(at)], pa.int32()), ids.take(pa.array(at))), pa.array([own], pa.binary())], ["size", "ids", "terms"])

    return rows.mapInArrow(packed, schema)


def _compared(k: int, metric: str):
    def compared(batches):
        for batch in batches:
            sizes, q_sizes = batch.column(0).to_pylist(), batch.column(3).to_pylist()
            for row, (size, q_size) in enumerate(zip(sizes, q_sizes, strict=True)):
                ids, q_ids = batch.column(1)[row].values, batch.column(4)[row].values
                if size != q_size or size < 0:
                    n = min(k, len(ids))
                    found = [(np.repeat(np.arange(len(q_ids)), n), np.tile(np.arange(n), len(q_ids)), np.full(n * len(q_ids), np.nan), False)]
                else:
                    v, q = (np.frombuffer(batch.column(c)[row].as_buffer(), "float64").reshape(len(i), size) for c, i in ((2, ids), (5, q_ids)))
                    found = _best_pairs(q, v, k, metric)
                for at, to, score, scored in found:
                    yield pa.RecordBatch.from_arrays([q_ids.take(pa.array(at)), ids.take(pa.array(to)), pa.array(score, mask=~np.broadcast_to(scored, score.shape))], ["query", "id", "score"])

    return compared


def _best_pairs(q: np.ndarray, v: np.ndarray, k: int, metric: str):
    """(rows of ``q``, rows of ``v``, scores, whether there is one) of the best ``k`` rows of each query, the first ones among equals."""
    norms, q_norms = (_summed(x.shape[0], ((c, c) for c in x.T)) for x in (v, q))
    tame = all(np.all((n == 0) | ((n > 1e-100) & (n < 1e100))) for n in (norms, q_norms))
    # of a product's error: far above what rounding can add up to, for terms of norm 1
    slack = 1e-15 * (v.shape[1] + 8)
    with np.errstate(all="ignore"):
        if metric == "cosine":
            unit, q_unit = (x / np.sqrt(np.where(n > 0, n, 1))[:, None] for x, n in ((v, norms), (q, q_norms)))
        wide = max(1, PAIRS // max(1, len(v)))
        for low in range(0, len(q), wide):
            part = slice(low, low + wide)
            if not tame or k >= len(v):
                at, to = (x.ravel() for x in np.indices((len(q[part]), len(v))))
            else:
                if metric == "l2":
                    near = q_norms[part, None] + norms - 2 * (q[part] @ v.T)
                    room = 8 * slack * (q_norms[part, None] + norms.max())
                else:
                    near = np.where((norms > 0) & (q_norms[part, None] > 0), -(q_unit[part] @ unit.T), np.inf)
                    room = 8 * slack
                at, to = np.nonzero(near <= np.partition(near, k - 1, axis=1)[:, k - 1 : k] + room)
            at = at + low
            if metric == "l2":
                score = _summed(len(at), ((d, d) for d in (q[at, j] - v[to, j] for j in range(v.shape[1]))))
                scored = np.ones(len(at), bool)
                key = score
            else:
                score = np.clip(_summed(len(at), ((q[at, j], v[to, j]) for j in range(v.shape[1]))) / np.sqrt(q_norms[at] * norms[to]), -1, 1)
                # NaN is the largest number in an order of Spark
                scored = ~((norms[to] == 0) | (q_norms[at] == 0))
                key = np.where(scored, np.where(np.isnan(score), -np.inf, -score), np.inf)
            order = np.lexsort((to, key, at))
            at, to, score, scored = at[order], to[order], score[order], scored[order]
            first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            place = np.arange(len(at)) - np.repeat(first, np.diff(np.r_[first, len(at)]))
            best = place < k
            yield at[best], to[best], score[best], scored[best]


def _summed(n: int, products) -> np.ndarray:
    """Sums of products, term by term, as a fold adds them."""
    out = np.zeros(n)
    for a, b in products:
        out += a * b
    return out


def issue_tokens(text: Column) -> Column:
    words = F.regexp_extract_all(F.lower(text), F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*IGNORED)))


def heuristic_score(line: Column) -> Column:
    """Points for what a line looks like."""
    points = lambda test, n: F.when(test, n).otherwise(0.0)

    def total(low: Column) -> Column:
        out = points(low.contains("todo"), 3.0) + points(low.contains("fixme"), 3.0) + points(low.contains("bug"), 3.0) + points(low == "pass", 2.0)
        comment = low.startswith("#") | low.startswith("//")
        out += points(comment & low.rlike(r"\b(if|else|for|while|return|try|except|catch|def|class)\b"), 3.0)
        out += points(low.contains("return") & low.rlike(r"\breturn\s+(none|null|nil|false|0)\b"), 1.0)
        out += points(low.contains("not in"), 0.5) + points(low.contains("=="), 0.5) + points(low.contains("!="), 0.5)
        return F.when(low == "", 0.0).otherwise(out)

    return let(F.lower(py_strip(line)), total)


def line_score(line: Column, tokens: Column) -> Column:
    """Two points for each token of the issue in the line, and the line's own points."""
    own = F.array_distinct(F.regexp_extract_all(F.lower(line), F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0)))
    return 2.0 * F.size(F.array_intersect(own, tokens)) + heuristic_score(line)


def scored_lines(files: DataFrame, tokens: Column, ranges: Column | None = None) -> DataFrame:
    """``files`` (with an array lines) by line: number, line, score; lines outside of all ``ranges`` score 0."""
    rows = files.withColumn("_tokens", tokens).select("*", F.posexplode("lines").alias("_at", "line")).withColumn("number", F.col("_at") + 1)
    score = line_score(F.col("line"), F.col("_tokens"))
    if ranges is not None:
        score = F.when(F.exists(ranges, lambda r: F.col("number").between(r["start"], r["end"])), score).otherwise(0.0)
    return rows.withColumn("score", score).drop("_at", "_tokens")


def most_suspicious(scored: DataFrame, key: str) -> DataFrame:
    """The line with the highest score of each file, the earliest on ties."""
    best = scored.groupBy(key).agg(F.min_by(F.struct("number", "line", "score"), F.struct((-F.col("score")).alias("s"), "number")).alias("m"))
    return best.select(key, "m.number", "m.line", "m.score")


def allowed_ranges(nodes: Column, n_lines: Column) -> Column:
    """Ranges of functions, else of classes, else the whole file, within its lines."""
    of = lambda kinds: F.transform(F.filter(nodes, lambda n: n["type"].isin(*kinds)), lambda n: F.struct(F.greatest(F.lit(1), n["start_line"]).alias("start"), F.least(n_lines, n["end_line"]).alias("end")))
    functions, classes = of(("function", "method")), of(("class",))
    whole = F.array(F.struct(F.lit(1).alias("start"), n_lines.alias("end")))
    return F.when(F.size(functions) > 0, functions).when(F.size(classes) > 0, classes).otherwise(whole)


def classify(text: Column) -> Column:
    """The first category with a key word in the text."""
    low, out = F.lower(text), None
    for name, words, _ in STRATEGIES:
        if words:
            test = low.contains(words[0])
            for w in words[1:]:
                test = test | low.contains(w)
            out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("unknown")


def advice(category: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for n, _, a in STRATEGIES for x in (n, a)]), category)


def tools(language: Column) -> Column:
    known = F.create_map(*[x for k, v in TOOLS.items() for x in (F.lit(k), F.array(*[F.lit(t) for t in v]))])
    return F.coalesce(F.try_element_at(known, py_strip(F.lower(F.coalesce(language, F.lit(""))))), F.array(F.lit("Git")))


def test_names(issue: Column, code: Column) -> Column:
    """Names of tests to run: one for each function, one from the issue's first long words."""
    functions = F.transform(F.regexp_extract_all(F.coalesce(code, F.lit("")), F.lit(r"(?U)\b(?:def|function)\s+(\w+)\s*\("), F.lit(1)), lambda n: F.concat(F.lit("test_"), n, F.lit("()")))
    words = F.transform(F.filter(F.regexp_extract_all(F.coalesce(issue, F.lit("")), F.lit("[a-zA-Z]+"), F.lit(0)), lambda w: F.length(w) > 3), F.lower)
    own = F.when(F.size(words) > 0, F.array(F.concat(F.lit("test_"), F.array_join(F.slice(words, 1, 3), "_"), F.lit("()")))).otherwise(F.array().cast("array<string>"))
    both = F.array_distinct(F.concat(functions, own))
    return F.when(F.size(both) > 0, both).otherwise(F.array(F.lit("test_reported_issue()")))


def language_vote(files: DataFrame, key: str, language: str = "language", order: str = "ord") -> DataFrame:
    """The language of most files of each group; Python first among equals, then the one seen first."""
    counts = files.where(F.col(language).isNotNull()).groupBy(key, language).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    best = F.max_by(F.col(language), F.struct("n", (F.col(language) == "python").alias("p"), (-F.col("first")).alias("f")))
    return counts.groupBy(key).agg(best.alias("language"))


def chunk_text(file: Column, language: Column, kind: Column, name: Column, code: Column) -> Column:
    """Text of a code chunk as it is embedded."""
    return F.concat(F.lit("\nFile: "), file, F.lit("\nLanguage: "), language, F.lit("\nType: "), kind, F.lit("\nName: "), name, F.lit("\n\nCode:\n"), code, F.lit("\n"))
