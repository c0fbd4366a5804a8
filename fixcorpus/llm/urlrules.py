"""URL filters: host and path rules, then glob rules run by a bit-parallel wildcard automaton.

All glob rules are packed into one row of 64-bit words, a bit for each state. For every byte of a canonical URL the
whole row moves by Shift-And: states move on where the byte fits, states in front of a ``*`` stay. The automaton runs
over all URLs of a batch at once, and the last rule that fits (in the order given) decides.

Canonical URL: scheme and host in lower case, ports 80 and 443 and the fragment dropped, other than visible ASCII
percent-encoded. Globs are matched against the whole canonical URL: ``*`` any run of bytes, ``?`` one byte.

Defined results: a null URL, or one without ``://``, has an empty host and path and is allowed; repeated rows each get
their result; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from urllib.parse import quote

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values: (verdict, rule). A rule is a host, its subdomains included, and the beginning of a path.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
#: (verdict, glob): junk shops, betting and the like, by host or path; then exceptions.
GLOBS = (
    ("block", "*://*cheap-pills*"),
    ("block", "*://*free-bets*"),
    ("block", "*://*casino*"),
    ("block", "*://*-porn*"),
    ("block", "*://ads.*"),
    ("block", "*/adserver/*"),
    ("block", "*/wp-login.php*"),
    ("block", "*?*sessionid=*"),
    ("block", "*.exe"),
    ("allow", "*://*.gov/*"),
)


class Automaton:
    """Masks of all globs: ``start``, ``final`` and ``stay`` states, and for each byte the states that it enters."""

    def __init__(self, globs: list[str]):
        states, bits = 0, {c: [] for c in range(256)}
        start, stay, final = [], [], []
        for glob in globs:
            start.append(states)
            for c in glob.encode():
                if c == ord("*"):
                    stay.append(states)
                    continue
                states += 1
                for b in range(256) if c == ord("?") else (c,):
                    bits[b].append(states)
            final.append(states)
            states += 1
        self.width = states // 64 + 1
        self.start, self.stay, self.final = self._row(start), self._row(stay), final
        self.enter = np.stack([self._row(bits[c]) for c in range(256)])

    def _row(self, places: list[int]) -> np.ndarray:
        row = [0] * self.width
        for p in places:
            row[p // 64] |= 1 << (p % 64)
        return np.array(row, dtype=np.uint64)

    def fits(self, urls: list[bytes]) -> np.ndarray:
        """A row for each URL, a column for each glob."""
        out = np.zeros((len(urls), len(self.final)), dtype=bool)
        order = np.argsort([-len(u) for u in urls], kind="stable")
        sizes = np.array([len(urls[i]) for i in order])
        if not len(urls):
            return out
        data = np.zeros((len(urls), max(1, int(sizes[0]))), dtype=np.uint8)
        for k, i in enumerate(order):
            data[k, : sizes[k]] = np.frombuffer(urls[i], dtype=np.uint8)
        state = np.tile(self.start, (len(urls), 1))
        one, top = np.uint64(1), np.uint64(63)
        for at in range(int(sizes[0])):
            live = int(np.searchsorted(-sizes, -at, side="left"))
            now = state[:live]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top
            state[:live] = moved & self.enter[data[:live, at]] | now & self.stay
        for g, p in enumerate(self.final):
            out[order, g] = (state[:, p // 64] >> np.uint64(p % 64)) & one > 0
        return out


def canonical(url: str | None) -> bytes:
    if not url or "://" not in url:
        return b""
    scheme, _, rest = url.partition("://")
    cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
    host, tail = rest[:cut].lower(), rest[cut:].split("#", 1)[0]
    for port in (":80", ":443"):
        host = host.removesuffix(port)
    return f"{scheme.lower()}://{quote(host, safe=':@[]-._~')}{quote(tail if tail[:1] == '/' else '/' + tail, safe='/?%&=+:;,@!$()*~-._|[]{}')}".encode()


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path as the contract has them."""
    there = url.contains("://")
    rest = F.regexp_replace(url, r"(?s)^.*?://", "")
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.when(there, lower).otherwise(""), F.when(there, path).otherwise("")


def judged(pages: DataFrame, rules=RULES, globs=GLOBS, url_col: str = "url", keep: tuple[str, ...] = ("page_id",), batch: int = 2048) -> DataFrame:
    """Columns ``keep`` with host, path, rule, glob and verdict: the longest rule's, else the last fitting glob's, else allow."""
    host, path = parts(F.col(url_col))
    fitting = F.array(
        *[
            F.when(
                ((F.col("host") == rule.split("/", 1)[0]) | F.col("host").endswith("." + rule.split("/", 1)[0])) & F.col("path").startswith("/" + rule.split("/", 1)[1]),
                F.struct(F.lit(len(rule)).alias("size"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict")),
            )
            for verdict, rule in rules
        ]
    )
    cut = pages.select(*keep, F.col(url_col).alias("_url"), host.alias("host"), path.alias("path")).withColumn("_rule", F.array_max(fitting))
    automaton = Automaton([g for _, g in globs])

    def run(batches):
        import pyarrow as pa

        for rows in batches:
            urls, chosen = rows.column("_url").to_pylist(), []
            for at in range(0, len(urls), batch):
                fits = automaton.fits([canonical(u) for u in urls[at : at + batch]])
                last = fits.shape[1] - 1 - np.argmax(fits[:, ::-1], axis=1)
                chosen += [int(k) if any_ else None for k, any_ in zip(last, fits.any(axis=1), strict=True)]
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(chosen, pa.int32())], names=[*rows.schema.names, "_glob"])

    schema = T.StructType([*cut.schema.fields, T.StructField("_glob", T.IntegerType())])
    names = F.array(*[F.lit(g) for _, g in globs])
    verdicts = F.array(*[F.lit(v) for v, _ in globs])
    return cut.mapInArrow(run, schema).select(
        *keep,
        "host",
        "path",
        F.col("_rule.rule").alias("rule"),
        F.get(names, F.col("_glob")).alias("glob"),
        F.coalesce(F.col("_rule.verdict"), F.get(verdicts, F.col("_glob")), F.lit("allow")).alias("verdict"),
    )


def sql() -> str:
    """The same in DuckDB's SQL; globs as GLOB patterns over a canonical URL made of plain string functions."""
    rules = ", ".join(f"('{r}', '{r.split('/', 1)[0]}', '/{r.split('/', 1)[1]}', '{v}')" for v, r in RULES)
    globs = ", ".join(f"({i}, '{g}', '{v}')" for i, (v, g) in enumerate(GLOBS))
    return rf"""WITH rules(rule, h, p, verdict) AS (VALUES {rules}), globs(n, pat, verdict) AS (VALUES {globs}),
u AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN regexp_replace(url, '(?s)^.*?://', '') END AS rest FROM pages),
s AS (SELECT page_id, coalesce(lower(regexp_extract(rest, '(?s)^([^/?#]*)', 1)), '') AS host,
  coalesce(regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1), '') AS path,
  lower(split_part(url, '://', 1)) || '://' || lower(regexp_extract(rest, '^([^/?#]*)', 1))
    || regexp_replace(regexp_extract(rest, '^[^/?#]*([^#]*)', 1), '^([^/]|$)', '/\1') AS canon FROM u),
r AS (SELECT page_id, max_by(rule, length(rule)) AS rule, max_by(rules.verdict, length(rule)) AS verdict
  FROM s JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id),
g AS (SELECT page_id, max_by(pat, n) AS pat, max_by(globs.verdict, n) AS verdict FROM s JOIN globs
  ON regexp_full_match(canon, replace(replace(replace(replace(pat, '.', '\.'), '?', '.'), '*', '.*'), '+', '\+')) GROUP BY page_id)
SELECT s.page_id, s.host, s.path, r.rule, g.pat AS "glob", coalesce(r.verdict, g.verdict, 'allow') AS verdict
FROM s LEFT JOIN r USING (page_id) LEFT JOIN g USING (page_id)"""
