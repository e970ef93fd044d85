import math
import random

from pyspark.sql import functions as F

from cohortlens.llm import maxscore, queries, urlfilter


def brute_top(rows, k):
    ints = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    asked = {}
    for i, v in ints:
        if i % 100 == 0:
            asked[i] = min(asked.get(i, v), v)
    out = []
    for i, q in asked.items():
        scored = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in ints if j != i)[:k]
        out += [(i, n + 1, j, max(-(1 << 63), min((1 << 63) - 1, -s))) for n, (s, j) in enumerate(scored)]
    return sorted(out)


def got(df, k):
    return sorted(tuple(r) for r in maxscore.top_k(df, lambda i: i % 100 == 0, k).collect())


def test_top_k_against_brute_force(spark):
    r = random.Random(2)
    dense = [(i, [r.gauss(0, 0.2) for _ in range(16)]) for i in range(1500)]
    sparse = [(i, [r.choice([0.0, 0.0, 0.0, r.random()]) for _ in range(24)]) for i in range(700)]
    ties = [(i, [r.choice([0.0, 0.5, 1.0]) for _ in range(2)]) for i in range(600)]
    odd = [(0, [1.0, None]), (100, None), (None, [1.0, 1.0]), (200, [float("nan"), 1.0]), (300, [float("inf"), 0.0]), (400, [1.0]), (500, [-1.0, 2.0, 3.0]),
           (600, []), (1, [0.5, 0.5]), (1, [0.5, 0.5]), (400, [1.0]), (2, [1e17, 1e17]), (700, [1e6, -3e6]), (800, [0.0, 0.0])]
    for rows in (dense, sparse, ties, odd, []):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
        assert got(df.repartition(3), 10) == brute_top(rows, 10)


def test_blocks_prune_and_agree(spark, monkeypatch):
    monkeypatch.setattr(maxscore, "BLOCK_ROWS", 300)
    monkeypatch.setattr(maxscore, "SEED_ROWS", 20)
    monkeypatch.setattr(maxscore, "QUERY_ROWS", 3)
    r = random.Random(4)
    rows = [(i, [r.random() ** 6 if r.random() < 0.4 else 0.0 for _ in range(20)]) for i in range(1200)]
    assert got(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 5) == brute_top(
        [(i, [float(x) for x in v]) for i, v in spark.createDataFrame(rows, "vec_id long, embedding array<float>").collect()], 5)


URLS = [
    (1, "http://a.com/x", "a.com", "/x", "com/", "allow"), (2, "https://EXAMPLE.com/en/1", "example.com", "/en/1", "example.com/en/", "block"),
    (3, "https://www.example.com/en/1?q=/es/", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
    (4, "http://m.b.net/es/#top", "m.b.net", "/es/", "net/es/", "block"), (5, "http://net/fr/2", "net", "/fr/2", "net/fr/", "block"),
    (6, "http://a.com", "a.com", "", None, "allow"), (7, None, "", "", None, "allow"), (8, "no scheme", "", "", None, "allow"),
    (9, "://?", "", "", None, "allow"), (10, "http://x.org//a//b/c/d/e/", "x.org", "//a//b/c/d/e/", None, "allow"),
    (11, "http://notnet/es/", "notnet", "/es/", None, "allow"), (12, "ftp://ÄB.com/Ü?", "Äb.com", "/Ü", "com/", "allow"),
    (None, "http://a.com/x", "a.com", "/x", "com/", "allow"), (1, "http://a.com/x", "a.com", "/x", "com/", "allow"),
    (13, "http://b.net/es", "b.net", "/es", None, "allow"), (14, "a://b://c.net/fr/", "b:", "//c.net/fr/", None, "allow"), (15, "", "", "", None, "allow"),
]


def test_hosts_paths_and_rules(spark):
    df = spark.createDataFrame([(r[0], r[1]) for r in URLS], "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("rule", F.lit(1))
    none = spark.createDataFrame([], "id long, good int")
    rows = urlfilter.judge(df, queries.URL_RULES, none).select("page_id", "host", "path", "rule", "verdict").collect()
    assert sorted(map(str, map(tuple, rows))) == sorted(str((r[0], *r[2:])) for r in URLS)
    assert urlfilter.judge(df.limit(0), queries.URL_RULES, none).count() == 0
    assert {r["rule"] for r in urlfilter.judge(df, [], none).collect()} == {None}


def test_templates_generalise_merge_and_reject(spark):
    """One host with a variable level, a spam branch and two alike: the spam template alone is rejected."""
    rows, labels = [], []
    for n in range(300):
        section = ("news", "blog", "spam")[n % 3]
        rows.append((n, f"http://h.org/{section}/{n}.html"))
        if n % 2:
            labels.append((n, 0 if section == "spam" else 1))
    labels += [(1, 0), (1, 1)]  # marked both ways: unlabelled
    df = spark.createDataFrame(rows, "page_id long, url string")
    out = urlfilter.judge(df, [], spark.createDataFrame(labels, "id long, good int")).collect()
    by = {}
    for r in out:
        by.setdefault(r["template"], set()).add(r["verdict"])
    assert by == {"/spam/*": {"block"}, "/news/*": {"allow"}, "/blog/*": {"allow"}} or by == {"/spam/*": {"block"}, "/*/*": {"allow"}}
    assert all((r["verdict"] == "block") == ("/spam/" in r["path"]) for r in out)


def host_pages(spark, paths):
    """One host's pages, all labelled: (path, good) in, and page by page the verdict and template out."""
    df = spark.createDataFrame([(n, "http://h.org" + path) for n, (path, _) in enumerate(paths)], "page_id long, url string")
    labels = spark.createDataFrame([(n, good) for n, (_, good) in enumerate(paths)], "id long, good int")
    out = {r["page_id"]: (r["verdict"], r["template"]) for r in urlfilter.judge(df, [], labels).collect()}
    assert sorted(out) == list(range(len(paths)))
    return [(path, good, *out[n]) for n, (path, good) in enumerate(paths)]


def test_a_deep_branch_is_judged_by_itself(spark):
    """The bad branch stands at segments 4 and 6; shorter, longer and pure paths lie beside it."""
    paths = [(f"/a/b/c/{'spam' if n % 3 == 0 else 'ok'}/{n}", int(n % 3 != 0)) for n in range(240)]
    paths += [(f"/x/y/z/u/v/{'bad' if n % 2 else 'good'}/{n}/{n}.html", 1 - n % 2) for n in range(120)]
    paths += [("/a/b", 1), ("/a/b/c", 1), ("/x", 1), ("", 1), ("/a/b/c/ok/" + "t/" * 30, 1)]
    out = host_pages(spark, paths)
    assert all((verdict == "block") == (good == 0) for _, good, verdict, _ in out)
    assert all(len(t.split("/")) == len([s for s in path.split("/") if s]) + 1 for path, _, _, t in out)
    assert {t.split("/")[4] for path, _, _, t in out if "/spam/" in path} == {"spam"}
    assert {t.split("/")[6] for path, _, _, t in out if "/bad/" in path} == {"bad"}


def test_a_hot_branch_of_a_variable_level_is_judged_by_itself(spark):
    """Unique segments at both levels, a third of the pages in one bad branch; and a single bad page that stays in ``*``."""
    paths = [(f"/u{n}/{n}", int(n != 5)) for n in range(1000)] + [(f"/spam/{n}", 0) for n in range(500)]
    out = host_pages(spark, paths)
    assert {(verdict, t) for path, _, verdict, t in out if path.startswith("/spam/")} == {("block", "/spam/*")}
    assert {(verdict, t) for path, _, verdict, t in out if path.startswith("/u")} == {("allow", "/*/*")}


def test_a_template_stops_only_where_nothing_can_differ():
    def splits(n, bad, m, b):
        share = (bad + 1) / (n + 2)
        return abs(b - share * m) > urlfilter.Z * math.sqrt(share * (1 - share) * m)

    def any_split(n, bads):
        return any(splits(n, bad, m, b) for bad in bads for m in range(1, n + 1) for b in range(max(0, m - n + bad), min(m, bad) + 1))

    assert not any(any_split(n, range(n + 1)) for n in range(urlfilter.LEAST_MARKED))
    assert any_split(urlfilter.LEAST_MARKED, range(urlfilter.LEAST_MARKED + 1))
    assert not any(any_split(n, (0, n)) for n in range(1, 80))


def test_the_main_path_runs_no_python(spark):
    df = spark.createDataFrame([(r[0], r[1]) for r in URLS], "page_id long, url string")
    plan = urlfilter.judge(df, queries.URL_RULES, spark.createDataFrame([], "id long, good int"))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
