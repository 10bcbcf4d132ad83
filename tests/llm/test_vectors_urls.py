"""URL filter, hard negatives and whitening against plain versions."""

import math
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from batchtrace.llm import negatives, urls, whiten
from batchtrace.llm.queries import QUERIES, URL_RULES

SF = "/root/testdata/sf0.001"
INF, NAN = float("inf"), float("nan")


# ---- URL filter -------------------------------------------------------------------------------

def parts(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return ("".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")


def rule_of(host, path, rules):
    fits = [(len(h + p), i, h + p, v) for i, (v, (h, p)) in enumerate(rules) if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[2:] if fits else (None, None)


def family(host):
    name = re.sub(r":[0-9]*$", "", re.sub(r"(?s)^.*@", "", host)).rstrip(".")
    suffix = next((s for s in sorted(urls.SUFFIXES, key=lambda s: (-len(s), s)) if name.endswith("." + s)), name.split(".")[-1])
    if len(name) <= len(suffix) + 1 or re.match(r"^[0-9.]+$|^\[", name):
        return name, suffix
    return name[:-len(suffix) - 1].split(".")[-1] + "." + suffix, suffix


def level(rows):
    """rows: key -> (bad, seen, prior); key -> (alpha, beta)."""
    had = [(k, n, m) for k, n, m in rows.values() if n]
    room = sum(m * (1 - m) * (n - 1) for _, n, m in had)
    over = sum((k - n * m) ** 2 / n - m * (1 - m) for k, n, m in had)
    least, most = 1 / (urls.MAX_STRENGTH + 1), 1 / (urls.MIN_STRENGTH + 1)
    s = 1 / min(max(over / room if room > 0 else least, least), most) - 1
    return {key: (m * s + k, (1 - m) * s + n - k) for key, (k, n, m) in rows.items()}


def plain_urls(pages, outcomes, rules, max_bad=urls.MAX_BAD):
    known = {}
    for i, bad in outcomes:
        if i is not None and bad is not None:
            known[i] = max(bad, known.get(i, 0))
    hosts = defaultdict(lambda: [0, 0])
    for i, url in pages:
        h = hosts[parts(url)[0]]
        if i in known:
            h[0] += known[i]
            h[1] += 1
    domains, tops = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    for h, (k, n) in hosts.items():
        for t, key in ((domains, family(h)), (tops, family(h)[1])):
            t[key][0] += k
            t[key][1] += n
    others = lambda ab, k, n: (k, n, (ab[0] - k) / (ab[0] + ab[1] - n))  # noqa: E731  (the row's own counts left out)
    bad, seen = (sum(x[i] for x in tops.values()) for i in (0, 1))
    t = level({s: others((bad + 0.5, seen - bad + 0.5), k, n) for s, (k, n) in tops.items()})
    d = level({x: others(t[x[1]], k, n) for x, (k, n) in domains.items()})
    r = level({h: others(d[family(h)], k, n) for h, (k, n) in hosts.items()})
    out = []
    for i, url in pages:
        host, path = parts(url)
        rule, verdict = rule_of(host, path, rules)
        a, b = r[host]
        m = a / (a + b)
        bound = m - urls.DEVIATIONS * math.sqrt(m * (1 - m) / (a + b + 1))
        out.append((i, host, path, rule, verdict or ("block" if bound > max_bad else "allow"), m, bound))
    return out


def check_urls(spark, pages, outcomes, rules, **named):
    frame = spark.createDataFrame([(i, u, "clash", 1) for i, u in pages], "page_id long, url string, verdict string, `a.b` int")
    got = urls.filter_urls(frame, spark.createDataFrame(outcomes, "page_id long, bad int"), rules, **named)
    assert got.columns == ["page_id", "url", "a.b", "host", "path", "rule", "verdict", "bad_share", "bad_bound"]
    key = lambda r: (r[0] is None, r[0] or 0, *map(str, r[1:5]))
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict, r.bad_share, r.bad_bound) for r in got.collect()), key=key)
    want = sorted(plain_urls(pages, outcomes, rules, **named), key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert [x for r in got for x in r[5:]] == pytest.approx([x for r in want for x in r[5:]], abs=1e-9)
    return got


def test_url_query_matches_plain_version(spark):
    pages = [(r.page_id, r.url) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    labels = [(r.doc_id, int(r.quality == 0 or r.toxic == 1)) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    got = QUERIES["op11_url_filter"](spark, SF)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    assert sorted(map(tuple, got.collect())) == sorted(r[:5] for r in plain_urls(pages, labels, URL_RULES))


def test_url_reputation_blocks_what_its_family_supports(spark):
    """One bad page blocks no host; many do; an unlabelled host follows its domain; a few good pages under a bad
    domain are not enough to clear it."""
    pages, outcomes = [], []

    def add(host, bad, good, unknown=1):
        for b in [1] * bad + [0] * good + [None] * unknown:
            pages.append((len(pages), f"http://{host}/x"))
            outcomes.append((len(pages) - 1, b))

    for i in range(30):
        add(f"h{i}.good.com", 0, 20)
    for i in range(10):
        add(f"h{i}.bad.com", 19, 1)
    add("new.bad.com", 0, 0)
    add("one.good.com", 1, 3)
    add("spam.good.com", 40, 0)
    add("solo.org", 1, 0)
    got = {r[1]: r[4] for r in check_urls(spark, pages, outcomes, [])}
    assert got["h3.bad.com"] == got["new.bad.com"] == got["spam.good.com"] == "block"
    assert got["h3.good.com"] == got["one.good.com"] == got["solo.org"] == "allow"


def test_url_edge_cases(spark):
    long_ = "http://long.example.com/" + "a/" * 50_000 + "?q"
    pages = [(1, None), (2, ""), (3, "no scheme"), (4, "://"), (5, "http://"), (6, "HTTP://WWW.Example.COM/De/?x"), (7, "http://www.example.com/de/#y"),
             (8, "http://example.com/de"), (9, "http://notexample.com/de/"), (10, "x://y://z.net/p"), (11, "http://u:p@h.example.net:8080/en/a?b/c"),
             (12, "http://a.b.co.uk/"), (13, "http://c.co.uk"), (14, "http://10.0.0.1/x"), (15, "http://ÄÖ.org/fr/é"), (16, long_), (None, "http://q.com/"),
             (17, "http://net/"), (17, "http://net/"), (18, "http://x.net"), (19, "a\nb://h.com/p\nq?r"), (20, "http://x.org./fr/"), (21, "http://.com/")]
    outcomes = [(6, 1), (6, 0), (9, None), (None, 1), (12, 0), (13, 1), (17, 1), (99, 1), (16, 0)]
    got = check_urls(spark, pages, outcomes, URL_RULES)
    by = {r[0]: r for r in got}
    assert by[7][3:5] == ("example.com/de/", "block") and by[6][2:4] == ("/De/", None) and by[8][3] is by[9][3] is by[18][3] is None
    assert by[1][1:3] == by[3][1:3] == ("", "") and by[15][3:5] == ("org/fr/", "allow") and by[10][1:3] == ("y:", "//z.net/p")
    assert len(got) == len(pages)
    check_urls(spark, pages, [], URL_RULES)
    check_urls(spark, pages, outcomes, URL_RULES, max_bad=0.0)
    assert urls.filter_urls(spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame(outcomes, "page_id long, bad int"), []).count() == 0
    with pytest.raises(ValueError):
        urls.filter_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(outcomes, "page_id long, bad int"),
                         [("block", (f"h{i}", "/")) for i in range(1001)])


# ---- hard negatives ---------------------------------------------------------------------------

def plain_negatives(rows, is_anchor, relabel=lambda i, label: label, scale=256, positives=5, negatives=5, low=80, high=100):
    use, most = [], (1 << 63) - 1
    for i, v, label in rows:
        if i is None or label is None or v is None or any(c is None or not math.isfinite(c) for c in v):
            continue
        use.append((i, relabel(i, label), [math.floor(c * scale) for c in v]))
    dot = lambda a, b: max(-most, min(most, sum(x * y for x, y in zip(a, b))))
    out = []
    for n, (i, label, v) in enumerate(use):
        if not is_anchor(i):
            continue
        scored = sorted((-dot(v, w), j, other) for q, (j, other, w) in enumerate(use) if q != n)
        for p, j, _ in [x for x in scored if x[2] == label][:positives]:
            hard = [x for x in scored if x[2] != label and low * -p <= 100 * -x[0] <= high * -p][:negatives]
            out += [(i, j, r + 1, x[1], -p, -x[0]) for r, x in enumerate(hard)]
    return sorted(out)


def check_negatives(spark, rows, **named):
    frame = spark.createDataFrame([(i, v, label, "x", 1) for i, v, label in rows],
                                  "vec_id long, embedding array<float>, label int, rank string, tile int").repartition(3)
    got = negatives.hard_negatives(frame, anchor=F.col("vec_id") % 10 == 0, **named)
    got = sorted(tuple(r) for r in got.collect())
    assert got == plain_negatives(rows, lambda i: i % 10 == 0, **named)
    return got


def test_negatives_query_matches_plain_version(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want = plain_negatives(rows, lambda i: i % 100 == 0, lambda i, label: (label + 1) % 10 if i % 7 == 0 else label)
    assert sorted(map(tuple, QUERIES["op12_hard_negatives"](spark, SF).collect())) == want != []


def test_negatives_over_many_tiles_and_leaves(spark, monkeypatch):
    """Pruned search over small boxes equals the full search; a vector that a third of the rows share included."""
    monkeypatch.setattr(negatives, "TILE", 60)
    monkeypatch.setattr(negatives, "LEAF", 8)
    monkeypatch.setattr(negatives, "FAN", 3)
    monkeypatch.setattr(negatives, "MAX_DIRECTORY", 4)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 5))
    rows = [(i, (centres[i % 6] + 0.3 * rng.normal(size=5)).astype(np.float32).tolist(), int(rng.integers(0, 3))) for i in range(400)]
    rows += [(1000 + i, rows[0][1], int(i % 3)) for i in range(200)]
    assert check_negatives(spark, rows)
    assert check_negatives(spark, rows, positives=2, negatives=7, low=50, high=90)


def test_tree_prunes_and_finds_all():
    rng = np.random.default_rng(0)
    centres = rng.integers(-2000, 2000, size=(40, 3))
    rows = np.concatenate([c + rng.integers(-20, 20, size=(300, 3)) for c in centres]).astype(np.int64)
    labels, ids = rng.integers(0, 4, len(rows)), rng.permutation(len(rows)).astype(np.int64)
    tree = negatives.Tree(rows, labels, ids, np.arange(len(rows)))
    assert sorted(tree.rids.tolist()) == list(range(len(rows)))
    read, leaf = [], tree.leaf
    class Counted(list):  # noqa: E306
        def __getitem__(self, i):
            read.append(i)
            return super().__getitem__(i)
    tree.leaf = Counted(leaf)
    for q in rows[::1500]:
        low, high = negatives.intervals(tree.low, tree.high, q[None])
        s = rows @ q
        for a, b in ((-negatives.MOST, negatives.MOST), (0, int(s.max()) // 2)):
            got = list(tree.search(q, 1, -1, [{"ask": 0, "same": True, "low": a, "high": b, "least": -negatives.MOST}], low[0], high[0], 5))
            want = sorted((-s[i], ids[i], i) for i in range(len(rows)) if labels[i] == 1 and a <= s[i] <= b)[:5]
            assert [(-g[3], g[2], g[1]) for g in got] == want
        assert (low[0][:len(leaf)] <= [s[tree.rids[x]].min() for x in leaf]).all() and (high[0][:len(leaf)] >= [s[tree.rids[x]].max() for x in leaf]).all()
    assert len(read) < 0.25 * len(leaf) * 16  # 16 searches


def test_negatives_edge_cases(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.0], 2), (3, [0.9, 0.1], 2), (4, [0.9, 0.1], 2), (10, [-1.0, 0.5], 1), (11, [-1.0, 0.0], 2),
            (20, None, 1), (21, [1.0, None], 1), (22, [NAN, 1.0], 2), (30, [INF, 1.0], 2), (40, [1.0, 1.0], None), (None, [1.0, 1.0], 1),
            (50, [], 1), (51, [], 2), (60, [0.5], 1), (61, [0.5, 0.5, 0.5], 2), (70, [0.0, 0.0], 3), (80, [3e38, -3e38], 1), (81, [3e38, 3e38], 1),
            (82, [1e30, 0.0], 2), (0, [1.0, 0.0], 1), (2, [1.0, 0.0], 2)]
    got = check_negatives(spark, rows)
    assert {r[0] for r in got} & {20, 30, 40, 70} == set()
    assert check_negatives(spark, rows[:1]) == check_negatives(spark, rows[8:10]) == []
    assert negatives.hard_negatives(spark.createDataFrame([], "vec_id long, embedding array<float>, label int"), F.lit(True)).count() == 0


# ---- whitening --------------------------------------------------------------------------------

def check_whitening(rows, got, k=8):
    x = np.array([v for _, v in rows], dtype=object)
    n, d = x.shape
    total = x.sum(axis=0)
    y = ((n * x - total) / n).astype(float)
    s, w = np.linalg.svd(y, full_matrices=False)[1:]
    e, w = s ** 2 / n, w.T
    want = y @ w[:, :k] / np.sqrt(e[:k])
    by = defaultdict(dict)
    for r in got:
        by[r.id][r.component] = r
    a = np.array([[by[i][c + 1].whitened for c in range(min(k, d))] for i, _ in rows])
    sign = np.sign((a * want).sum(axis=0))
    assert np.abs(a * sign - want).max() < 1e-6 * max(1, np.abs(want).max())
    for (i, v) in rows:
        r = by[i][1]
        exact = sum((n * c - s) ** 2 for c, s in zip(v, total))
        assert r.n == n and r.deviation == (exact if exact < 1 << 63 else None)
    assert [by[rows[0][0]][c + 1].explained for c in range(min(k, d))] == pytest.approx((e[:k] / e.sum()).tolist(), rel=1e-6)
    assert by[rows[0][0]][1].identity_error < 1e-6


def frame_of(spark, rows):
    return spark.createDataFrame([(i, v, "x", 3) for i, v in rows], "id long, v array<long>, n string, `a.b` int").repartition(3)


def test_whitening_query_matches_plain_version(spark):
    given = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    rows = [(r.vec_id, [math.floor(1024 * c) + 100_000 for c in r.embedding]) for r in given]
    got = QUERIES["op13_whitening"](spark, SF)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    check_whitening(rows, got.withColumnRenamed("vec_id", "id").collect())


def test_whitening_of_badly_conditioned_rows(spark):
    """Axes whose variances differ by a factor of 10^12, far from the origin."""
    rng = np.random.default_rng(1)
    scale = 10.0 ** np.arange(1, 8)
    turn = np.linalg.qr(rng.normal(size=(7, 7)))[0]
    x = np.rint(rng.normal(size=(500, 7)) * scale @ turn + 1e9).astype(np.int64)
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    out = whiten.whiten(frame_of(spark, rows), F.col("v"), ["id"], components=7).collect()
    assert out[0].identity_error < 1e-6
    check_whitening(rows, out, 7)


def test_whitening_edge_cases(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [int(a), int(b), int(a) + int(b), 7]) for i, (a, b) in enumerate(rng.integers(-50, 50, size=(40, 2)))]
    odd = [(90, None), (91, [1, None, 2, 3]), (92, [1, 2]), (93, [])]
    out = whiten.whiten(frame_of(spark, rows + odd), F.col("v"), ["id", "n", "a.b"])
    assert out.columns == ["id", "a.b", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    got = out.collect()
    assert len(got) == 4 * 40 and {r.id for r in got} == set(range(40)) and {r.n for r in got} == {40}
    for r in got:  # the third dimension is the sum of two, the fourth constant
        assert (r.whitened is None) == (r.component > 2) and (r.explained > 0) == (r.component <= 2)
    assert got[0].identity_error < 1e-9 and sum({r.component: r.explained for r in got}.values()) == pytest.approx(1)
    same = whiten.whiten(frame_of(spark, [(1, [5, 5]), (1, [5, 5]), (2, [5, 5])]), F.col("v"), ["id"]).collect()
    assert len(same) == 6 and all((r.whitened, r.explained, r.deviation, r.identity_error) == (None, 0.0, 0, None) for r in same)
    big = whiten.whiten(frame_of(spark, [(1, [1 << 60]), (2, [0]), (3, [-5])]), F.col("v"), ["id"]).collect()
    assert len(big) == 3 and {r.deviation for r in big if r.id == 1} == {None} and big[0].identity_error < 1e-9
    assert whiten.whiten(frame_of(spark, []), F.col("v"), ["id"]).count() == 0
    assert whiten.whiten(frame_of(spark, [(1, [])]), F.col("v"), ["id"]).count() == 0
