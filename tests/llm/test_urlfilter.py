import re

from tallyspark.llm import urlfilter
from tallyspark.llm.queries import RULES

URLS = [
    None, "", "no scheme", "http://", "HTTP://A.ORG", "http://a.org/", "https://x.example.org/es/1", "https://example.org/en/123?x#y", "https://notexample.org/es/1", "http://a.com/fr/1#t", "http://b.com/de/9",
    "http://c.net/a/index.html", "http://www.c.net:80/a/", "http://c.net/a?q=://z", "ftp://d.net", "a://b://c", "http://É.net/Ü", "http://c.net?x", "http://c.net/a\n", "http://org/x",
]
LISTED = ["http://c.net/a", "https://d.net/", None, "junk", "http://a.org/zzz", "https://d.net/"]


def host_path(url):
    m = re.match(r"[\s\S]*?://([^/?#]*)([^?#]*)", url or "")
    return (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")


def key(url):
    h, p = host_path(url)
    return re.sub(r":(80|443)\Z", "", re.sub("^www[.]", "", h)) + re.sub(r"(/index)?/*\Z", "", re.sub(r"[.]html?\Z", "", p)) if h else None


def test_matches_brute_force(spark):
    pages = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(URLS)] + [(None, URLS[5], "h", "p"), (5, URLS[5], "h", "p")], "page_id long, url string, host string, path string")
    listed = spark.createDataFrame([(u,) for u in LISTED], "url string")
    keys = {key(u) for u in LISTED} - {None}
    got = urlfilter.judge(pages, listed, RULES).collect()
    assert len(got) == len(URLS) + 2
    for r in got:
        url = URLS[r.page_id if r.page_id is not None else 5]
        h, p = host_path(url)
        fits = [(len(rh + rp), rh + rp, v) for v, rh, rp in RULES if (h == rh or h.endswith("." + rh)) and p.startswith(rp)]
        rule = max(fits, default=(0, None, None))
        inside = key(url) in keys
        assert (r.host, r.path, r.rule, r.listed) == (h, p, rule[1], inside), url
        assert r.verdict == (rule[2] or ("block" if inside else "allow"))


def test_many_rules_are_joined_to_the_same_end(spark):
    rules = [*RULES, ("block", "", "/x"), ("allow", "example.org", "/es/1"), ("block", "c.net", ""), ("block", "b", "/"), ("allow", "b.com", "/de/9"), ("block", "b.com", "/de/9")]
    rows = spark.createDataFrame([(i, u) for i, u in enumerate([*URLS, *URLS, "http://.c.net./x", "http://a..com/fr/"])], "page_id long, url string")
    rows = rows.select("page_id", urlfilter.host_of(rows.url).alias("host"), urlfilter.path_of(rows.url).alias("path"))
    literal, joined = ({r.page_id: r["__rule"] for r in urlfilter.with_longest_rule(rows, rules, literal=n).collect()} for n in (200, 0))
    assert len(joined) == rows.count() and literal == joined and sum(r is not None for r in joined.values()) > 10


def test_filter_passes_every_listed_url(spark):
    listed = spark.range(3000).selectExpr("concat('http://h', id % 7, '.net/p', id) AS url")
    out = urlfilter.judge(listed.withColumn("page_id", listed.url), listed, RULES)
    assert out.where("listed").count() == 3000
    assert urlfilter.judge(spark.range(500).selectExpr("id AS page_id", "concat('http://x.net/q', id) AS url"), listed, RULES).where("listed").count() == 0


def test_empty_tables(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert urlfilter.judge(none, none, RULES).count() == 0
    assert urlfilter.judge(spark.createDataFrame([(1, "http://a.net")], "page_id long, url string"), none, []).first().verdict == "allow"
