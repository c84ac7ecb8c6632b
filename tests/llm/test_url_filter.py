from __future__ import annotations

import math
import re
from collections import Counter
from pathlib import Path

import pytest

from worktempo.llm import queries
from worktempo.llm import url_filter as u

DATA = Path("/root/testdata/sf0.1")
KIND = "page_id bigint, url string, host string, count string"


def plain(url):
    at = (url or "").find("://")
    if at < 0:
        return "", "", None, None
    host = re.match("[^/?#]*", url[at + 3:])[0]
    path = re.match("[^?#]*", url[at + 3 + len(host):])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(r + p), r + p, v) for r, p, v in u.RULES if (host == r or host.endswith("." + r)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


URLS = ["http://a.com/x", "https://EXAMPLE.com/en/1?q#f", "http://www.example.com/en/", "http://m.www.example.com/en/x",
        "http://example.com/en", "http://com/", "http://xcom/", "http://a.com", "http://a.net/es/x", "http://a.net/ES/x",
        "http://a.net/fr/?a=1&b=2", "http://a.net:80/fr/", "ftp://a.org?x=/en/", "no url", "", None, "http://É.com/é/",
        "x://y://z.com/", "http:///en/", "http://a.com#/x", "http://a.net/fr/" + "x" * 20_000]


def test_rules_equal_a_plain_reading(spark):
    pages = spark.createDataFrame([(k, url, "x", "y") for k, url in enumerate(URLS * 2)], KIND)
    got = {r.page_id: r for r in u.verdicts(pages).collect()}
    assert len(got) == 2 * len(URLS)
    for k, url in enumerate(URLS * 2):
        host, path, rule, verdict = plain(url)
        assert (got[k].host, got[k].path, got[k].rule) == (host, path, rule)
        assert got[k].verdict == verdict if verdict else got[k].verdict in ("allow", "block")


def test_without_both_labels(spark):
    pages = spark.createDataFrame([(1, "http://a.com/", "", ""), (2, "http://a.org/", "", ""), (None, None, None, None)], KIND)
    assert {r.verdict for r in u.verdicts(pages).collect()} == {"allow"}
    assert u.verdicts(pages.where("false")).count() == 0


def test_features(spark):
    url = "http://www.a-b.com/x/y1.html?p=1&q=2#z"
    rows = spark.createDataFrame([(1, url, "", "")], KIND).select("page_id", "url")
    row = u.lexical(rows.withColumn("host", u.host_of("url")).withColumn("path", u.path_of("url"))).first()
    entropy = -sum(n / len(url) * math.log2(n / len(url)) for n in Counter(url).values())
    assert abs(row.entropy - entropy) < 1e-9
    assert (row.n_url, row.depth, row.labels, row.hyphens, row.n_parameters, row.has_fragment, row.suffix) == (
        len(url), 2, 2, 1, 2, 1, "a-b.com")


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_trees_learn_the_listed_verdicts(spark):
    """Blocked URLs rank above allowed ones far better than by chance; the rules also look at a language in the path and
    at whole hosts, which none of the lexical features shows, so a perfect ranking cannot be had."""
    rows = queries.op4_url_filter(spark, str(DATA)).where("rule is not null").collect()
    bad, good = [r.score for r in rows if r.verdict == "block"], [r.score for r in rows if r.verdict == "allow"]
    assert sum(b > g for b in bad for g in good) / (len(bad) * len(good)) > 0.75
