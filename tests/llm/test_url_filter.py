import re

from geomarket.llm import url_filter
from geomarket.llm.url_filter import RULES


def parse(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    return (host.translate({c: c + 32 for c in range(65, 91)}), re.match(r"[^?#]*", rest[len(host):]).group())


def rule(host, path):
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.name), default=None)


URLS = ["http://A.Example.ORG/es/5", "http://example.org", "https://org/", "http://x.org?q=/en/", "x://y://z.org/a#b",
        "no scheme.org/es/", None, "", "://com/fr/", "http://notorg/es/", "http://myexample.org/es/1", "http://a.com/de/x?y",
        "http://É.com/fr/", "http://a.org\n/es/", "http://u@b.org:80/es/", "http://example.org/en/12/3/4/5/6", "a?://b/c"]


def test_hosts_paths_and_rules(spark):
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(URLS)] + [(0, URLS[0])], "page_id long, url string")
    found = url_filter.judge_pages(pages.selectExpr("*", "1 as host", "2 as rule", "3 as template")).collect()
    assert len(found) == len(URLS) + 1
    for r in found:
        host, path = parse(URLS[r.page_id])
        best = rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, best.name if best else None)
        assert r.verdict == best.verdict if best else r.verdict in ("allow", "block")
    assert url_filter.judge_pages(pages.where("false")).count() == 0


def test_templates_follow_pure_labels(spark):
    # Under /de/ all labels are block, the rest of the host is allowed; pages below /de/ of one shape share a fate.
    rows = [("h", f"/de/{k}", "block" if k % 2 else None) for k in range(60)] + [
        ("h", f"/fr/{k}", "allow" if k % 2 else None) for k in range(60)] + [("h", f"/it/{k}", None) for k in range(9)]
    pages = spark.createDataFrame(rows, "host string, path string, label string")
    found = {r["shape"]: (r.template, r.rejected) for r in url_filter.templates(pages).collect()}
    assert found["/de/{n}"] == ("/de/{n}", True)
    assert found["/fr/{n}"] == ("/fr/{n}", False)
    assert found["/it/{n}"] == ("/*/{n}", False)


def test_variable_levels_become_wildcards(spark):
    rows = [("h", f"/user/{chr(97 + k % 26)}{chr(97 + k // 26)}/home", "block") for k in range(100)] + [
        ("h", f"/a/b/c/d/{k}", "allow") for k in range(30)]
    found = {r["shape"]: r.template for r in url_filter.templates(
        spark.createDataFrame(rows, "host string, path string, label string")).collect()}
    assert found["/user/ab/home"] == "/user/*/home" and found["/a/b/c/d/{n}"] == "/a/b/c/**"
