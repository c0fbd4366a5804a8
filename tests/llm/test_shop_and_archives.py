"""Target encoding, archives and spelling variants against brute force and edge cases."""

import datetime
import gzip
import random
import zlib

import numpy as np
import pytest

from fixcorpus.llm import spelling, timeencode, warc

T0 = datetime.datetime(2024, 1, 1)

# -- target encoding -------------------------------------------------------------------------------

LINES = "sale_id long, line_no int, item_id long, vendor_id long, flag string, n long, level int, key long"
SALES = "sale_id long, client_id long, sold_at timestamp_ntz, time long, fold int"
OTHERS = ("item_id long, kind string, value string, id long", "vendor_id long, nation_id int, value string", "client_id long, segment string, first long")


def shop(spark, seed, n_sales=60, hot=0):
    rng = random.Random(seed)
    pick = lambda n, none=0.1: None if rng.random() < none else rng.randrange(n)
    sales = [(i, pick(8), None if rng.random() < 0.05 else T0 + datetime.timedelta(seconds=rng.randrange(40), microseconds=rng.choice([0, 0, 1])), 0, 0) for i in range(n_sales)]
    sales += [(3, 1, T0 + datetime.timedelta(days=9), 0, 0), (None, 1, T0, 0, 0)]
    lines = [(pick(n_sales + 3, 0.02), k, pick(9), pick(5), rng.choice(["kept", "returned", "swapped", None]), 1, 1, 1) for k in range(5 * n_sales)]
    lines += lines[:20] + [(7, k, pick(400), pick(5), "returned", 1, 1, 1) for k in range(hot)]
    items = [(i, rng.choice(["a", "b", None]), "x", 1) for i in range(7)] + [(0, "z", "x", 1), (None, "a", "x", 1)]
    vendors = [(i, pick(3), "x") for i in range(4)]
    clients = [(i, rng.choice(["s", "t", None]), 1) for i in range(6)] + [(-1, "s", 1)]
    made = [lines, sales, items, vendors, clients]
    return made, [spark.createDataFrame(rows, schema) for rows, schema in zip(made, (LINES, SALES, *OTHERS), strict=True)]


def brute_rates(lines, sales, items, vendors, clients):
    sold = {}
    for i, c, t, *_ in sales:
        if i is not None and t is not None:
            sold[i] = min(sold.get(i, (t, 1 << 62)), (t, -1 if c is None else c))
    least = lambda rows: {k: min(v for j, v, *_ in rows if j == k and v is not None) for k in {j for j, v, *_ in rows if v is not None}}
    kind, nation, segment = least(items), least(vendors), least(clients)
    every = []
    for sale, _, item, vendor, flag, *_ in lines:
        if sale in sold:
            t, c = sold[sale]
            item = -1 if item is None else item
            every.append((sale, item, vendor, t, zlib.crc32(str(sale).encode()) % 5, flag == "returned", {"all": 0, "segment": segment.get(c), "client": c, "kind": kind.get(item), "item": item, "nation": nation.get(vendor), "vendor": vendor}))
    out = {}
    for key in {x[:3] for x in every}:
        mine = [x for x in every if x[:3] == key]
        _, _, _, t, fold, _, values = mine[0]
        past = [x for x in every if x[4] != fold and x[3] < t]

        def rated(level, prior, past=past, values=values):
            own = [x[5] for x in past if x[6][level] == values[level]]
            return len(own), prior if not own else (1_000_000 * sum(own) + 50 * prior) // (len(own) + 50)

        overall = rated("all", 500_000)[1]
        row = [len(mine), sum(x[5] for x in mine)]
        for own, above in (("item", "kind"), ("vendor", "nation"), ("client", "segment")):
            row += rated(own, rated(above, overall)[1])
        out[key] = (*row, overall)
    return out


@pytest.mark.parametrize(("parts", "chunk", "hot"), [(1, 250_000, 0), (7, 16, 0), (9, 50, 300)])
def test_rates_against_brute_force(spark, parts, chunk, hot):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows, tables = shop(spark, parts, hot=hot)
        got = {(r["sale_id"], r["item_id"], r["vendor_id"]): tuple(r)[3:] for r in timeencode.encoded(*tables, chunk=chunk).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == brute_rates(*rows)


def test_running_sums_over_cut_moments():
    rng = np.random.default_rng(4)
    level, key, time, fold = np.sort(rng.integers(0, 2, 300)), rng.integers(0, 3, 300), rng.integers(0, 6, 300), rng.integers(0, 5, 300)
    order = np.lexsort([time, key, level])
    level, key, time, fold, n, s = level[order], key[order], time[order], fold[order], np.ones(300, int), rng.integers(0, 2, 300)
    want = [(int((m := (level == level[i]) & (key == key[i]) & (time < time[i]) & (fold != fold[i])).sum()), int(s[m].sum())) for i in range(300)]
    for size in (1, 7, 300):
        running, got = timeencode.Running(), []
        for a in range(0, 300, size):
            part = slice(a, a + size)
            got += zip(*running.counted(level[part], key[part], time[part], fold[part], n[part], s[part]), strict=True)
        assert got == want


def test_rates_of_empty_tables(spark):
    _, tables = shop(spark, 1)
    for i in range(5):
        rows = timeencode.encoded(*[t.limit(0) if i == k else t for k, t in enumerate(tables)]).count()
        assert (rows == 0) == (i < 2)


# -- archives --------------------------------------------------------------------------------------

PAGES = "page_id long, url string, html string, path string, offset long, record_type string, header string"


def page_rows():
    rng = random.Random(3)
    rows = [(i, f"http://example.org/{i}", rng.choice(["", None, "<p>same</p>", f"<p>é {rng.random()}</p>", "WARC/1.1\r\n\r\n\r\n1 0 x\n" * rng.randrange(1, 3)])) for i in rng.sample(range(-50, 500), 120)]
    rows += [(7_000, None, "<p>a b</p>"), (7_001, "http://a b/\nc", "x" * 300_000), (7_002, "dns:example.org", "\x00"), (7_003, "", "HTTP/1.1 200 OK\r\n\r\nX-Page-Id: 1\r\n"), rows[0], rows[0], (None, "http://n", "<p>same</p>"), (None, None, "<p>only here</p>")]
    return [(*r, "p", 1, "t", "h") for r in rows]


def brute_pages(rows, least=0):
    import base64
    import hashlib

    out, seen = [], {}
    for i, url, html, *_ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        data = (html or "").encode()
        again = len(data) >= least and data in seen
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", seen[data] if again else None))
        seen.setdefault(data, i)
    return out


@pytest.mark.parametrize(("least", "parts"), [(0, 3), (12, 1)])
def test_pages_through_archives(spark, least, parts):
    rows = page_rows()
    got = warc.archived(spark.createDataFrame(rows, PAGES).repartition(parts), least).drop("url")
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute_pages(rows, least), key=key)
    assert warc.archived(spark.createDataFrame([], PAGES)).count() == 0


@pytest.mark.parametrize("version", [1, 2])
def test_archives_of_both_versions(spark, tmp_path, version):
    rows = [(f"http://example.org/{i}", "20240229123456", 200, bytearray(b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n"), bytearray(b"x" * i)) for i in range(40)] + [("dns:example.org", "2024", 0, bytearray(b""), bytearray(b"20240229\nexample.org"))]
    pages = spark.createDataFrame(rows, "url string, date string, status int, header binary, payload binary").coalesce(1)
    arc = warc.write_arc(pages, str(tmp_path / "arc"), version, most=900)
    files = sorted((tmp_path / "arc").glob("part-*"))
    assert len(files) > 5
    for f in files:  # other tools can read them: members, then zeros
        text = gzip.decompress(f.read_bytes())
        assert text.startswith(b"filedesc://") and warc.FIELDS[version].encode() in text
    read = {r["url"]: r for r in warc.read_arc(spark, arc).collect()}
    assert len(read) == 41 and all(read[u]["payload_bytes"] == len(p) and read[u]["version"] == version and read[u]["date"] == d for u, d, _, _, p in rows)
    back = {r["url"]: r for r in warc.read_warc(spark, warc.convert(spark, arc, str(tmp_path / "warc"), most=900)).collect()}
    assert {u: r["payload_digest"] for u, r in back.items()} == {u: r["payload_digest"] for u, r in read.items()}
    assert back["http://example.org/3"]["date"] == "2024-02-29T12:34:56Z" and back["dns:example.org"]["date"] == "2024-01-01T00:00:00Z"
    assert back["dns:example.org"]["record_type"] == "resource" and back["http://example.org/3"]["record_type"] == "response"
    assert len({r["record_id"] for r in back.values()}) == 41


def test_broken_archives_are_named():
    start = warc.arc_start(1, "a.arc", "20240101000000")
    good = warc.arc_line(1, "http://a", "1.2.3.4", "20240101000000", "text/html", 200, 3, "", 0) + b"abc\n"
    assert [(v, f["IP-address"], b) for _, v, f, b in list(warc.arc_records(start + good))[1:]] == [(1, "1.2.3.4", b"abc")]
    for bad in (good, start + good[:-3], start + b"http://a 1.2.3.4 text/html 3\nabc\n", start + good.replace(b" 3\n", b" x\n")):
        with pytest.raises(ValueError, match="a.arc, offset"):
            list(warc.arc_records(bad, "a.arc"))
    with pytest.raises(ValueError, match="cut off"):
        warc.unpacked(warc.member(b"abc" * 50)[:-9])
    record = warc.warc_record({"WARC-Type": "resource"}, b"a\r\n\r\nWARC/1.1\r\n")
    assert [b for *_, b in warc.warc_records(record * 2)] == [b"a\r\n\r\nWARC/1.1\r\n"] * 2
    with pytest.raises(ValueError, match="no record ends there"):
        list(warc.warc_records(record[:-6] + record))


# -- spelling --------------------------------------------------------------------------------------


def brute_groups(counts, times=5):
    import itertools

    def one_edit(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    near = {w: [] for w in counts}
    for a, b in itertools.combinations(counts, 2):
        if one_edit(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= times * counts[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, n, len(near[w]), form[w], None if form[w] is None else counts[form[w]], root(w)) for w, n in counts.items()}


@pytest.mark.parametrize("letters", ["ab", "abc", "abcdefgé"])
def test_variants_against_brute_force(spark, letters):
    rng = random.Random(len(letters))
    counts = {"".join(rng.choice(letters) for _ in range(rng.randint(1, 5))): rng.choice([1, 2, 5, 6, 30, 200, 1_000]) for _ in range(250)}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert {tuple(r) for r in spelling.grouped(words).collect()} == brute_groups(counts)


def test_light_edges_are_few(spark):
    rng = random.Random(8)
    words = {"".join(rng.choice("aab") for _ in range(12)) for _ in range(900)}
    table = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    most = max(r["count"] for r in spelling.light_edges(table).groupBy("word").count().collect())
    assert most <= np.log2(len(words)) + 1


def test_vocabulary(spark):
    text = "Éclair éclair ABCDEF abcdef×÷ ünïcode abcdéfĀabcdefg under_score9letters x'abcdef ſabcdef"
    docs = spark.createDataFrame([(i, text, None) for i in range(300)] + [(None, text, None), (1, None, None), (2, "", None)], "doc_id long, text string, n string")
    want = {}
    import re

    for doc_id in [*range(300), None]:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text):
            w = "".join(c.lower() if c.isascii() else c for c in run)
            h = None if doc_id is None else zlib.crc32(f"{doc_id}:{w}".encode())
            if h is not None and h % 19 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 6:
                want[w] = want.get(w, 0) + 1
    assert {r["word"]: r["n"] for r in spelling.vocabulary(docs, every=19).collect()} == {w: n for w, n in want.items() if n >= 5}
    assert spelling.grouped(spelling.vocabulary(docs.limit(0), every=199)).count() == 0
