"""Site rates over all sites of a document."""

import math
import random

import pytest

from atlasloom.llm.queries import QUERIES
from atlasloom.llm.site_bayes import SOFT, site_bayes

ODD_WORDS = "red green blue one two three four five six seven".split()


@pytest.fixture(scope="module")
def tables(spark):
    rnd = random.Random(5)
    docs, labels, sites = [], [], []
    for k in range(300):
        good = rnd.random() < 0.6
        docs.append((k, " ".join(rnd.choices(ODD_WORDS, k=20)), "own", "x"))
        if k % 3:
            labels.append((k, good))
        if k % 5:
            sites.append((k, "aa", "p" if k % 2 else "q"))
            sites += [(k, "zz" if good else "yy", "r")] * 2
            if k % 7 == 0:
                sites.append((k, "zz" if good else "yy", "s"))
    kinds = "doc_id long, text string, host string, path string"
    return spark.createDataFrame(docs, kinds), spark.createDataFrame(labels, "doc_id long, good boolean"), sites


def test_every_site_counts(spark, tables):
    docs, labels, sites = tables
    got = {r.doc_id: r for r in site_bayes(docs, labels, sites=spark.createDataFrame(sites, "doc_id long, host string, path string")).collect()}
    assert len(got) == 300
    good = {r.doc_id: r.good for r in labels.collect()}
    of = {k: {(h, p) for d, h, p in sites if d == k} or {("own", "x")} for k in got}
    n = {k: 1.0 if k in good else SOFT for k in got}
    is_good = {k: n[k] * (float(good[k]) if k in good else got[k].evidence) for k in got}
    whole = sum(is_good.values()) / sum(n.values())
    # One host of a kind alone shows its rate; the strengths solve for the rest.
    hosts = {h: [(n[k], is_good[k]) for k in got if h in {x for x, _ in of[k]}] for h in ("own", "aa", "zz", "yy")}
    alone = next(r.host_rate for k, r in got.items() if of[k] == {("own", "x")})
    a, b = sum(x for x, _ in hosts["own"]), sum(y for _, y in hosts["own"])
    strength = (b - alone * a) / (alone - whole)
    rate = {h: (sum(y for _, y in v) + strength * whole) / (sum(x for x, _ in v) + strength) for h, v in hosts.items()}
    for k, r in got.items():
        mine = {h for h, _ in of[k]}
        assert math.isclose(r.host_rate, sum(rate[h] for h in mine) / len(mine), rel_tol=1e-6)
    # The host that comes last by name tells good from bad.
    zz = [r.score for k, r in got.items() if any(h == "zz" for h, _ in of[k]) and k not in good]
    yy = [r.score for k, r in got.items() if any(h == "yy" for h, _ in of[k]) and k not in good]
    assert min(zz) > max(yy)


def test_query_reads_every_page(spark, tables, tmp_path):
    docs, labels, sites = tables
    docs.selectExpr("doc_id", "text", "'en' as lang", "'s' as source").write.parquet(f"{tmp_path}/documents.parquet")
    labels.selectExpr("doc_id", "cast(good as int) as quality", "0 as toxic").write.parquet(f"{tmp_path}/labels.parquet")
    pages = [(i, f"https://{h}/{p}/{k}.html", "") for i, (k, h, p) in enumerate(sites)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.doc_id: r for r in QUERIES["op8_site_bayes"](spark, str(tmp_path)).collect()}
    assert len(got) == 300
    good = {r.doc_id: r.good for r in labels.collect()}
    last = {k: h for k, h, _ in sites if h != "aa"}
    assert min(got[k].score for k, h in last.items() if h == "zz" and k not in good) > max(got[k].score for k, h in last.items() if h == "yy" and k not in good)
