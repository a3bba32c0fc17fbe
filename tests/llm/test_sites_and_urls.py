"""Site posteriors and url verdicts against plain versions."""

import collections
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillroll.llm import queries, site_quality, url_filters

SF_DIR = "/root/testdata/sf0.001"


def split(url):
    """Host and path by hand."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host) :])[0]


def longest_rule(host, path):
    fits = [
        (len(h) + len(p), f"{h}{p}", verdict)
        for verdict, h, p in queries.URL_RULES
        if (host == h or host.endswith(f".{h}")) and path.startswith(p)
    ]
    return max(fits)[1:] if fits else (None, None)


def test_hosts_paths_and_rules_of_all_pages(spark):
    urls = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").collect()}
    got = queries.op10_url_filters(spark, SF_DIR).collect()
    assert len(got) == len(urls)
    for r in got:
        host, path = split(urls[r["page_id"]])
        rule, verdict = longest_rule(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (verdict or ("block" if r["purity"] < url_filters.PURITY else "allow"))


def test_a_bad_template_is_rejected_and_its_neighbours_are_not(spark):
    """Labels that follow the pages: one of three templates of a host is bad, the verdicts are counted by hand."""
    pages, labels = [], []
    for i in range(300):
        kind = ("news", "casino", "help")[i % 3]
        pages.append((i, f"http://a.example.org/{kind}/{i}/page-{i % 7}.html", i))
        if i % 2 == 0:
            labels.append((i, int(kind == "casino")))
    df = spark.createDataFrame(pages, "page_id bigint, url string, _label_key bigint")
    rows = url_filters.judged(df, spark.createDataFrame(labels, "key bigint, bad int")).collect()
    verdicts = collections.Counter((re.search(r"org/(\w+)/", pages[r["page_id"]][1])[1], r["verdict"]) for r in rows)
    assert verdicts == {("news", "allow"): 100, ("casino", "block"): 100, ("help", "allow"): 100}


def test_sparse_sites_are_shrunk_towards_what_is_above_them(spark):
    """Posteriors lie between the site's own share and that of its host, closer to its own the more labels it has."""
    rng = np.random.default_rng(1)
    rows = []
    for h in range(30):
        share = rng.beta(2, 6)
        for p in range(6):
            n = int(rng.integers(1, 60)) if p else 400
            rows.append((f"h{h}", f"p{p}", n, int(rng.binomial(n, share)), 0))
    sites = spark.createDataFrame(rows, "host string, path string, n bigint, low bigint, toxic bigint")
    got = {(r["_host"], r["_path"]): r["site_low"] for r in site_quality.site_posteriors(sites).collect()}
    by_host = collections.defaultdict(lambda: [0, 0])
    for h, _, n, low, _ in rows:
        by_host[h][0] += n
        by_host[h][1] += low
    moved = []
    for h, p, n, low, _ in rows:
        own, above = low / n, by_host[h][1] / by_host[h][0]
        assert min(own, above) - 0.05 <= got[h, p] <= max(own, above) + 0.05
        if abs(own - above) > 0.1:
            moved.append((n, abs(got[h, p] - own) / abs(own - above)))
    few, many = ([m for n, m in moved if lo <= n < hi] for lo, hi in ((1, 5), (30, 60)))
    assert np.mean(few) > np.mean(many)


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_languages_of_held_out_documents(spark, sf):
    rows = queries.op3_language_id(spark, f"/root/testdata/{sf}")
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "lang", F.length("text").alias("n"))
    held = rows.join(docs, "doc_id").filter("held_out AND lang IS NOT NULL AND n > 40 AND lang_pred <> 'und'").collect()
    right = sum(r["lang"] == r["lang_pred"] for r in held)
    assert len(held) > 50 and right >= 0.97 * len(held)
