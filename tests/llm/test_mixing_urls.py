import pytest

from arcline.llm import mixing
from arcline.llm.mixing import mix_sources
from arcline.llm.urls import judge_urls

from . import brute

SCHEMA = "doc_id long, text string, source string"
RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"), ("net", "/fr/", "block"),
]


def test_mix_reaches_targets(spark):
    rows = [(i, "w " * (1 + i * i % 37), ["a", "b", "b", "b", "c", None][i % 6]) for i in range(600)]
    rows += [(None, "x y", "a"), (600, None, "b"), (601, "", "empty"), (601, "", "empty")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mix_sources(docs.repartition(7)).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    wanted = brute.targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(wanted[r["source"]])
        assert r["taken"] == r["copies"] * r["size"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    for source, size in sizes.items():
        assert abs(taken[source] - wanted[source]) <= max(40, 0.02 * size)
    again = mix_sources(docs.orderBy("text").coalesce(2)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_mix_empty_and_clashing(spark):
    assert mix_sources(spark.createDataFrame([], SCHEMA)).count() == 0
    docs = spark.createDataFrame([(1, None, None, 5, 2.0)], SCHEMA + ", size int, target double")
    assert tuple(mix_sources(docs).first()) == (1, None, 0, 0, 0.0, 0, 0)


@pytest.mark.parametrize(
    ("url", "host", "path", "rule", "verdict"),
    [
        ("http://A.Example.COM/en/x?q#f", "a.example.com", "/en/x", "example.com/en/", "block"),
        ("https://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"),
        ("https://www.example.com/EN/", "www.example.com", "/EN/", "com/", "allow"),
        ("ftp://notexample.net/fr/a://b/es/", "notexample.net", "/fr/a://b/es/", "net/fr/", "block"),
        ("http://net/es", "net", "/es", None, "allow"),
        ("http://x.com?y=/", "x.com", "", None, "allow"),
        ("no scheme.com/", "", "", None, "allow"),
        ("://", "", "", None, "allow"),
        ("x:///en/", "", "/en/", None, "allow"),
        ("http://com.org/", "com.org", "/", None, "allow"),
        ("", "", "", None, "allow"),
        (None, "", "", None, "allow"),
    ],
)
def test_urls(spark, url, host, path, rule, verdict):
    rules = spark.createDataFrame(RULES + [(None, "/", "block")], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, url, "kept"), (1, url, "kept")], "page_id long, url string, key string")
    got = judge_urls(pages, rules).collect()
    assert [tuple(r) for r in got] == [(1, url, "kept", host, path, rule, verdict)] * 2


def test_many_rules_and_empty(spark):
    """Thousands of listed urls: every listed one is found, no other is."""
    listed = [(f"h{i}.org", f"/p{i % 50}/", "block") for i in range(3000)]
    rules = spark.createDataFrame(listed, "host string, path string, verdict string")
    urls = [(i, f"http://sub.h{i}.org/p{i % 50}/x{i}") for i in range(0, 6000, 7)]
    pages = spark.createDataFrame(urls, "page_id long, url string")
    got = {r["page_id"]: r["url_verdict"] for r in judge_urls(pages, rules, default="unknown").collect()}
    assert got == {i: "block" if i < 3000 else "unknown" for i, _ in urls}
    assert judge_urls(pages.limit(0), rules).count() == 0
    assert {r["url_verdict"] for r in judge_urls(pages, rules.limit(0)).collect()} == {"allow"}


def test_other_columns_may_have_any_name(spark):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    names = ["won", "url_rule", "url_verdict", "page", "block", "key_host", "rule_verdict", "verdict", "a.b"]
    schema = "url string, " + ", ".join(f"`{n}` string" for n in names)
    pages = spark.createDataFrame([("http://a.example.com/en/x", *names)], schema)
    found = judge_urls(pages, rules)
    assert found.columns == ["url", *[n for n in names if n not in ("url_rule", "url_verdict")], "url_host", "url_path", "url_rule", "url_verdict"]
    assert found.first()["url_rule"] == "example.com/en/" and found.first()["won"] == "won" and found.first()["url_verdict"] == "block"
    only = judge_urls(spark.createDataFrame([("x",)], "url_rule string").selectExpr("url_rule AS url_path"), rules, url="url_path")
    assert only.columns == ["url_host", "url_path", "url_rule", "url_verdict"]


def test_mix_of_text_ids_in_many_cells(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CELL_ROWS", 4)
    rows = [(None if i % 3 == 0 else f"a{i}", f"word{i} " * (i % 7), "s" if i % 2 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id string, text string, source string")
    runs = [sorted(map(str, mixing.mix_sources(d).collect())) for d in (df, df.repartition(5))]
    assert runs[0] == runs[1] and len(runs[0]) == 60
