"""Quality rules with robust multivariate outliers (DataFrame functions only).

Base rules count words, symbols, repeated lines and repeated three-word windows. Documents that pass them get a vector of
transformed statistics; for each language and source, a minimum-covariance-determinant estimate of centre and scatter is
made, and a document far from its group's centre by Mahalanobis distance is rejected.

The estimate follows the fast algorithm's concentration steps. From a start by medians (by counts in fixed bins), each
step takes the nearest ``HALF`` of a group by the present distance and computes their mean and covariance, which can
only lower the determinant. Distances are counted in fixed bins as well, so a step is one aggregation that combines
in each task, over all rows, and nothing depends on the order of rows. A group of any size has an estimate of its own, which
is then pooled with its language's as if the group held ``PRIOR`` further documents like the language's, and the
language's with the whole table's in the same way: a small group is judged mostly as its language, a large one as itself.

Defined results: a null or empty text has no words and fails the base rules; null languages and sources are groups of
their own; repeated rows and null ids each get their result; further columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE, let, stored

HALF = 0.75
STEPS = 4
PRIOR = 200
#: Squared distance beyond which a document is an outlier: the 0.999999 quantile of the chi-square distribution with five
#: degrees of freedom, 35.888, times the factor by which the nearest ``HALF`` of a normal sample makes its scatter too
#: small, 0.75 / P(chi-square with seven degrees <= 6.626) = 1.4121.
CUTOFF = 50.677
#: Names, and the smallest standard deviation each is taken to have, so that a statistic that hardly varies isn't decisive.
#: Each statistic can pass the cutoff on its own: symbols from a share of 0.046 of the characters, repeated lines from a
#: share of 0.51, words in repeated windows from one of 0.43, in a group where clean text has none.
STATISTICS = {"s_size": 0.3, "s_length": 0.08, "s_symbols": 0.03, "s_lines": 0.1, "s_repeats": 0.08}


def repeated_words(words: Column) -> Column:
    """Words that lie in three-word windows found twice or more.

    Windows are compared by a 64-bit hash: sorted by hash, equal neighbours are the repeats; sorted by place, the gaps
    between their starts give the number of words covered.
    """
    def sorted_windows(w: Column) -> Column:
        three = F.zip_with(F.zip_with(w, F.slice(w, F.lit(2), F.size(w)), lambda a, b: F.struct(a.alias("a"), b.alias("b"))), F.slice(w, F.lit(3), F.size(w)), lambda ab, c: F.xxhash64(ab["a"], ab["b"], c))
        return F.slice(three, F.lit(1), F.size(w) - 2)

    def places(hashes: Column) -> Column:
        return F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeats(rows: Column) -> Column:
        before = F.zip_with(rows, F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), F.slice(rows, F.lit(1), F.size(rows) - 1)), lambda x, y: F.struct(x["i"].alias("i"), F.coalesce(x["h"] == y["h"], F.lit(False)).alias("same"), x["h"].alias("h")))
        both = F.zip_with(before, F.slice(rows, F.lit(2), F.size(rows)), lambda x, y: F.when(x["same"] | F.coalesce(x["h"] == y["h"], F.lit(False)), x["i"]))
        return F.sort_array(F.filter(both, lambda i: i.isNotNull()))

    def covered(at: Column) -> Column:
        gaps = F.zip_with(at, F.slice(at, F.lit(2), F.size(at)), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
        return F.aggregate(gaps, F.lit(0), lambda acc, g: acc + g)

    def counted(hashes: Column) -> Column:
        some = F.size(F.array_distinct(hashes)) < F.size(hashes)
        return F.when(some, let(places(hashes), lambda rows: let(repeats(rows), covered))).otherwise(F.lit(0))

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(let(sorted_windows(words), counted))


def measured(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """Columns ``keep`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    plain = F.trim(F.regexp_replace(text, f"[{SPACE}]+", " "))
    words = F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    long = lambda c: c.cast("long")
    n_words, n_repeat = F.col("n_words"), F.col("n_repeat_words")
    out = docs.select(
        *keep,
        let(words, lambda w: F.struct(long(F.size(w)).alias("n_words"), long(repeated_words(w)).alias("n_repeat_words"))).alias("_w"),
        long(F.length(F.translate(plain, " ", ""))).alias("word_chars"),
        long(F.octet_length(text) - F.octet_length(F.translate(text, "#*$%&|<>", ""))).alias("n_symbols"),
        long(let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))).alias("n_dup_lines"),
        long(F.size(F.split(text, "\n"))).alias("_lines"),
    )
    out = out.select(*keep, "_w.n_words", "word_chars", "n_symbols", "n_dup_lines", "_w.n_repeat_words", "_lines")
    return out.withColumn("base_failed", (n_words < 50) | (100 * n_repeat > 50 * n_words))


def vectors(stats: DataFrame) -> DataFrame:
    """Transformed statistics: logarithms of sizes, square root of the symbols' share, -log(1 - share) of repeats.

    The last grows without bound as a text becomes all repeats, and a single repeat in a short text stays small.
    """
    unique = lambda part, whole: F.log(whole / F.greatest(whole - F.col(part), F.lit(1.0)))
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return stats.withColumns(
        {
            "s_size": F.log(n),
            "s_length": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n),
            "s_symbols": F.sqrt(F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)).cast("double")),
            "s_lines": unique("n_dup_lines", F.greatest(F.col("_lines"), F.lit(1)).cast("double")),
            "s_repeats": unique("n_repeat_words", n),
        }
    )


def inverse(matrix: Column, d: int) -> Column:
    """Inverse of a symmetric positive matrix (array of rows) by the sweep operator, one pivot after the other."""
    def sweep(m: Column, k: Column) -> Column:
        pivot = lambda: F.get(F.get(m, k), k)
        return F.transform(
            m,
            lambda row, i: F.transform(
                row,
                lambda x, j: F.when((i == k) & (j == k), -1 / pivot())
                .when((i == k) | (j == k), x / pivot())
                .otherwise(x - F.get(row, k) * F.get(F.get(m, k), j) / pivot()),
            ),
        )

    swept = F.aggregate(F.sequence(F.lit(0), F.lit(d - 1)), matrix, sweep)
    return F.transform(swept, lambda row: F.transform(row, lambda x: -x))


def distance(values: list[Column], centre: Column, inverted: Column) -> Column:
    """Squared Mahalanobis distance."""
    diff = [v - F.get(centre, i) for i, v in enumerate(values)]
    total = F.lit(0.0)
    for i, a in enumerate(diff):
        for j, b in enumerate(diff):
            if j >= i:
                total = total + a * b * F.get(F.get(inverted, i), j) * (1.0 if i == j else 2.0)
    return F.greatest(total, F.lit(0.0))


#: Groups of a row: language and source, language, all.
_LEVELS = ((True, True), (True, False), (False, False))


def estimates(rows: DataFrame, steps: int = STEPS, half: float = HALF, prior: int = PRIOR) -> DataFrame:
    """(lang, source, total, centre, inverted): the pooled estimate of each group."""
    names = list(STATISTICS)
    d = len(names)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    sums = [F.count(F.lit(1)).alias("n")] + [F.sum(c).alias(f"t{i}") for i, c in enumerate(names)] + [F.sum(F.col(names[i]) * F.col(names[j])).alias(f"q{i}_{j}") for i, j in pairs]
    kept = ["n", *[f"t{i}" for i in range(d)], *[f"q{i}_{j}" for i, j in pairs]]

    def widened(fine: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
        """The groups of all three levels, from sums by language and source."""
        out = None
        for level, (lang, source) in enumerate(_LEVELS):
            part = fine.select(
                F.lit(level).alias("level"),
                (F.col("lang") if lang else F.lit(None).cast("string")).alias("lang"),
                (F.col("source") if source else F.lit(None).cast("string")).alias("source"),
                *by,
                *columns,
            )
            out = part if out is None else out.unionByName(part)
        return out.groupBy("level", "lang", "source", *by).agg(*[F.sum(c).alias(c) for c in columns])

    def moments(summed: DataFrame) -> DataFrame:
        n = F.col("n").cast("double")
        mean = [F.col(f"t{i}") / n for i in range(d)]
        cell = lambda i, j: F.col(f"q{min(i, j)}_{max(i, j)}") / n - mean[i] * mean[j]
        floor = [v * v for v in STATISTICS.values()]
        scatter = F.array(*[F.array(*[F.greatest(cell(i, i), F.lit(0.0)) + floor[i] if i == j else cell(i, j) for j in range(d)]) for i in range(d)])
        found = summed.select("level", "lang", "source", "total", F.array(*mean).alias("centre"), scatter.alias("scatter"))
        return found.withColumn("inverted", inverse(F.col("scatter"), d))

    # start: per statistic, the median of the group's bins; the scatter from the floor values, doubled
    binned = [F.floor(F.col(c) / (w / 4)).cast("int") for c, w in STATISTICS.items()]
    flat = rows.select("lang", "source", F.posexplode(F.array(*binned)).alias("k", "bin")).groupBy("lang", "source", "k", "bin").agg(F.count(F.lit(1)).alias("n"))
    counted = widened(flat, ["k", "bin"], ["n"])
    medians = (
        counted.groupBy("level", "lang", "source", "k")
        .agg(F.sort_array(F.collect_list(F.struct("bin", "n"))).alias("bins"), F.sum("n").alias("total"))
        .select(
            "level", "lang", "source", "k", "total",
            F.aggregate(
                "bins",
                F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("int").alias("at")),
                lambda acc, x: F.struct((acc["seen"] + x["n"]).alias("seen"), F.coalesce(acc["at"], F.when(2 * (acc["seen"] + x["n"]) >= F.col("total"), x["bin"])).alias("at")),
                lambda acc: acc["at"],
            ).alias("at"),
        )
    )
    widths = F.array(*[F.lit(w / 4) for w in STATISTICS.values()])
    start = medians.groupBy("level", "lang", "source").agg(F.max("total").alias("total"), F.transform(F.sort_array(F.collect_list(F.struct("k", "at"))), lambda x: (x["at"] + 0.5) * F.get(widths, x["k"])).alias("centre"))
    wide = [4 * v * v for v in STATISTICS.values()]
    diagonal = lambda values: F.array(*[F.array(*[F.lit(values[i] if i == j else 0.0) for j in range(d)]) for i in range(d)])
    current = stored(start.select("level", "lang", "source", "total", "centre", diagonal(wide).alias("scatter"), diagonal([1 / v for v in wide]).alias("inverted")), "mcd")

    for _ in range(steps):
        bin_ = F.floor(F.log2(F.col("far") + 1e-3) * 16).cast("int").alias("bin")
        near = None
        for level, (lang, source) in enumerate(_LEVELS):
            group = matched(rows, current.where(F.col("level") == level), lang, source, "inner")
            part = group.withColumn("far", distance([F.col(c) for c in names], F.col("centre"), F.col("inverted"))).withColumn("level", F.lit(level))
            part = part.select("level", (F.col("lang") if lang else F.lit(None).cast("string")).alias("lang"), (F.col("source") if source else F.lit(None).cast("string")).alias("source"), bin_, "total", *names)
            near = part if near is None else near.unionByName(part)
        bins = near.groupBy("level", "lang", "source", "bin").agg(F.max("total").alias("total"), *sums)
        listed = bins.groupBy("level", "lang", "source").agg(F.max("total").alias("total"), F.sort_array(F.collect_list(F.struct("bin", *kept))).alias("bins"))
        # the bins up to the one in which ``half`` of the group is reached
        zero = F.struct(*[F.lit(0).cast("long").alias("n") if c == "n" else F.lit(0.0).alias(c) for c in kept])
        chosen = listed.select(
            "level", "lang", "source", "total",
            F.aggregate(
                "bins", zero,
                lambda acc, x: F.when(acc["n"] >= F.col("total") * half, acc).otherwise(F.struct(*[(acc[c] + x[c]).alias(c) for c in kept])),
            ).alias("m"),
        ).select("level", "lang", "source", "total", "m.*")
        current = stored(moments(chosen), "mcd")
    of = lambda level: current.where(F.col("level") == level)
    languages = pooled(of(1), of(2), F.lit(True), prior)
    groups = pooled(of(0), languages, F.col("lang").eqNullSafe(F.col("_l")), prior)
    return stored(groups.select("lang", "source", "total", "centre", inverse(F.col("scatter"), d).alias("inverted")), "mcd")


def pooled(groups: DataFrame, parents: DataFrame, on: Column, prior: int) -> DataFrame:
    """``groups`` with the centre and scatter of their documents and ``prior`` more, which are as their parent's are."""
    rows = groups.join(parents.select(F.col("lang").alias("_l"), F.col("centre").alias("_c"), F.col("scatter").alias("_m")), on)
    own = F.col("total") / (F.col("total") + prior)
    rows = rows.withColumns({"_w": own, "_d": F.zip_with("centre", "_c", lambda a, b: a - b)})
    w, v = F.col("_w"), 1 - F.col("_w")
    cell = lambda i, j, x, y: w * F.get(F.get("scatter", i), j) + v * F.get(F.get("_m", i), j) + w * v * x * y
    scatter = F.transform("_d", lambda x, i: F.transform("_d", lambda y, j: cell(i, j, x, y)))
    return rows.select("lang", "source", "total", F.zip_with("centre", "_c", lambda a, b: w * a + v * b).alias("centre"), scatter.alias("scatter"))


def matched(rows: DataFrame, groups: DataFrame, lang: bool, source: bool, how: str) -> DataFrame:
    """``rows`` with the centre and inverse of their group; the planner broadcasts the groups if their stored size allows it."""
    right = groups.select(F.col("lang").alias("_l"), F.col("source").alias("_s"), F.lit(False).alias("_none"), "total", "centre", "inverted")
    # the group of all rows: a statistic is never null
    on = F.col("lang").eqNullSafe(F.col("_l")) if lang else F.isnull("s_size") == F.col("_none")
    if source:
        on = on & F.col("source").eqNullSafe(F.col("_s"))
    return rows.join(right, on, how).drop("_l", "_s", "_none")


def judged(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """The base columns of every document with ``distance`` (null if the base rules reject it) and ``kept``."""
    stats = stored(vectors(measured(docs)), "quality")
    passed = stats.where(~F.col("base_failed")).select("lang", "source", *STATISTICS)
    found = estimates(passed)
    out = matched(stats, found, True, True, "left").drop("total")
    far = distance([F.col(c) for c in STATISTICS], F.col("centre"), F.col("inverted"))
    out = out.withColumn("distance", F.when(F.col("base_failed"), F.lit(None).cast("double")).otherwise(far))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= cutoff)).alias("kept"),
        F.round("distance", 6).alias("distance"),
    )
