import pytest
from pyspark.sql import functions as F

from probefleet.llm import url_filter as U

RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = rest[:cut].translate(LOWER), rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, None))
    return host, path, best[1], best[2]


ODD = [
    None, "", "no scheme", "http://", "https://NET/x", "http://a.NET?x=/", "http://net", "ftp://x.example.net/en/1#a",
    "http://example.net/en", "http://notexample.net/en/", "http://xorg/fr/", "http://org/fr/", "//a.net/", "x://b://c.net/",
    "http://É.ORG/fr/?q=%20&&b", "http://a.net/\nb", "http://a.org/" + "x/1-" * 30_000, "http://a.com/de/", "http://a.example.com/de/",
]


def test_corpus(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in U.judge_urls(pages).collect()}
    assert len(got) == 250
    for r in pages.select("page_id", "url").collect():
        host, path, rule, verdict = brute(r.url)
        mine = got[r.page_id]
        assert (mine.host, mine.path, mine.rule) == (host, path, rule)
        assert mine.verdict == verdict if rule else mine.verdict in ("allow", "block")


def test_odd_urls_get_defined_rows_natively(spark):
    odd = spark.createDataFrame([(i, u) for i, u in enumerate(ODD)] + [(None, None), (3, ODD[3])], "page_id long, url string")
    usual = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").selectExpr("page_id + 1000 page_id", "url")
    pages = odd.unionByName(usual).selectExpr("*", "'a' as label", "1 as suffix", "2 as rule", "3 as host")
    out = U.judge_urls(pages)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))
    got = out.where("page_id is null or page_id < 1000").collect()
    assert len(got) == len(ODD) + 2
    for r in got:
        host, path, rule, verdict = brute(None if r.page_id is None else ODD[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict in (("allow", "block") if verdict is None else (verdict,))


@pytest.mark.parametrize("urls", [[], ["http://a.org/x"], ["http://a.net/x", "http://b.com/"], [None]])
def test_nothing_to_learn_from(spark, urls):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = U.judge_urls(pages).collect()
    assert [r.verdict for r in sorted(got)] == ["block" if u and ".net" in u else "allow" for u in urls]


def test_learns_from_lexical_features(spark):
    # Long query strings of digits are blocked, whatever the suffix.
    n = F.col("id")
    url = F.when(n % 2 == 0, F.format_string("http://s%d.net/a?x=%d&y=%d&z=%d", n, n * 7919, n * 104729, n)).otherwise(
        F.format_string("http://s%d.org/fr/story", n)
    )
    labelled = spark.range(600).select(n.alias("page_id"), url.alias("url"))
    free = spark.range(1000, 1100).select(
        n.alias("page_id"),
        F.when(n % 2 == 0, F.format_string("http://s%d.com/a?x=%d&y=%d&z=%d", n, n * 7919, n * 104729, n))
        .otherwise(F.format_string("http://s%d.com/fr/story", n)).alias("url"),
    )
    rules = (U.Rule("block", "net", "/"), U.Rule("allow", "org", "/"))
    got = U.judge_urls(labelled.unionByName(free), rules).where("rule is null").collect()
    assert all(r.verdict == ("block" if r.page_id % 2 == 0 else "allow") for r in got)


def test_a_label_is_no_feature_of_its_own_url(spark):
    """Two hosts of one suffix with unlike labels: each one's rate comes from the other alone."""
    hosts = [f"h{i}.site" for i in range(40)]
    rows = [(h, "site", i % 2) for i, h in enumerate(hosts) for _ in range(3)]
    df = spark.createDataFrame(rows, "host string, suffix string, label int").withColumn("url", F.col("host"))
    got = U.with_suffix_statistics(df)
    fold = F.pmod(F.xxhash64("host"), F.lit(U.FOLDS))
    for r in got.withColumn("fold", fold).collect():
        others = [x for x in got.withColumn("fold", fold).select("fold", "label").collect() if x.fold != r.fold]
        want = (sum(x.label for x in others) + U.PRIOR_ROWS * 0.5) / (len(others) + U.PRIOR_ROWS)
        assert abs(r.suffix_block_rate - want) < 1e-9
        break


def test_unlike_lexical_features_split_one_suffix(spark):
    """Long digit-ridden URLs are blocked, short ones allowed, all of one suffix: what no rule covers follows its kind."""
    rules = (U.Rule("block", "bad.one", "/"), U.Rule("allow", "good.one", "/"))
    long = "http://{}.one/{}?a=1&b=2&c=3"
    rows = [(i, long.format(f"s{i}.bad", f"x{i * 7919}/9{i}/{i * i}")) for i in range(150)]
    rows += [(1000 + i, f"https://s{i}.good.one/about") for i in range(150)]
    rows += [(2000 + i, long.format(f"new{i}", f"y{i * 6007}/8{i}/{i * i}")) for i in range(10)]
    rows += [(3000 + i, f"https://fresh{i}.one/about") for i in range(10)]
    got = {r.page_id: r.verdict for r in U.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()}
    assert {got[2000 + i] for i in range(10)} == {"block"} and {got[3000 + i] for i in range(10)} == {"allow"}
