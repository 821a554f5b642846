import pytest
from pyspark.sql import functions as F

from graphloom.functions import columns as fx
from graphloom.functions import text as tx


def test_parse_query():
    p = tx.parse_query("kind:function auth")
    assert (p.kinds, p.text) == (["function"], "auth")
    assert tx.parse_query("lang:TypeScript foo").languages == ["typescript"]
    p = tx.parse_query('path:"my dir/file" foo')
    assert (p.paths, p.text) == (["my dir/file"], "foo")
    p = tx.parse_query("path:src/api name:Handler")
    assert (p.paths, p.names, p.text) == (["src/api"], ["Handler"], "")
    assert tx.parse_query("http://example.com").text == "http://example.com"
    assert "kind:invalid" in tx.parse_query("kind:invalid foo").text
    assert tx.parse_query("TODO: needs review").text == "TODO: needs review"
    assert tx.parse_query('a "open end').text == 'a "open end'


def test_edit_distance(spark):
    cases = [("user", "user", 0), ("user", "usar", 1), ("user", "users", 1), ("ab", "ba", 2), ("abc", "xyzq", 3)]
    for a, b, d in cases:
        assert tx.edit_distance(a, b, 2) == d
    row = spark.range(1).select(*[F.levenshtein(F.lit(a), F.lit(b), 2).alias(f"c{k}") for k, (a, b, _) in enumerate(cases)]).first()
    assert [d if d >= 0 else 3 for d in row] == [d for *_, d in cases]


def test_terms_and_stems():
    assert tx.stem_variants("running")[:3] == ["runn", "runne", "run"] and "query" in tx.stem_variants("queries")
    terms = tx.search_terms("How does ScrapeLoop handle user_service?", stems=False)
    assert terms == ["scrapeloop", "user_service", "scrape", "loop", "handle", "user", "service"]
    assert set(tx.query_symbols("call app.isPackaged in HTTPServer with MAX_SIZE")) >= {"app.isPackaged", "app", "isPackaged", "MAX_SIZE"}
    assert tx.fts_terms("user_service AND foo::bar") == [["user", "service"], ["foo"], ["bar"]]


TESTS = ["okhttp/src/jvmTest/kotlin/okhttp3/CallTest.kt", "Tests/SessionTests.swift", "pkg/bar_test.go", "src/foo.spec.ts", "project/__tests__/foo.ts"]
OTHERS = ["src/latest/loader.kt", "lib/manifest.kt", "src/contestEntry.ts", "pkg/greatest.go"]


def test_test_paths(spark):
    rows = spark.createDataFrame([(p,) for p in TESTS + OTHERS], "p string").select("p", fx.is_test_path(F.col("p")).alias("t")).collect()
    assert {r.p for r in rows if r.t} == set(TESTS)


def test_globs():
    import re

    ok = lambda g, p: bool(re.match(tx.file_glob(g), p))
    assert ok("e2e/*.ts", "e2e/login-flow.ts") and not ok("e2e/*.ts", "e2e/login-flow.ts.bak") and not ok("e2e/*.ts", "src/login-flow.ts")
    assert ok("src/**/*.ts", "src/foo.ts") and ok("src/**/*.ts", "src/nested/foo.ts")


def test_budgets():
    assert [tx.explore_budget(n)[0] for n in (499, 500, 4999, 5000, 14999, 15000, 24999, 25000)] == [1, 2, 2, 3, 3, 4, 4, 5]
    assert [tx.explore_budget(n)[1] for n in (499, 4999, 14999, 15000)] == [18_000, 28_000, 35_000, 38_000]


@pytest.mark.parametrize("a,b,points", [("a/b/c/x.ts", "a/b/d/y.ts", 30), ("x.ts", "y.ts", 0), ("a/x", "b/x", 0), ("a/b/c/d/e/f/g/x", "a/b/c/d/e/f/g/y", 80)])
def test_proximity(spark, a, b, points):
    assert spark.range(1).select(fx.path_proximity(F.lit(a), F.lit(b))).first()[0] == points


def test_name_bonus_and_lines(spark):
    row = spark.range(1).select(*[fx.name_match_bonus(F.lit(n), q).alias(f"c{k}") for k, (n, q) in enumerate([("OpenQueue", "open queue"), ("queue", "open queue"), ("openQueueFast", "openQueue"), ("fastOpenQueue", "openQueue"), ("x", "y")])]).first()
    assert list(row) == [80, 60, 31, 15, 0]
    assert spark.range(1).select(fx.source_lines(F.lit("a\nb\r\nc\nd"), F.lit(2), F.lit(3))).first()[0] == "b\nc"


def test_safety():
    assert not any(tx.is_safe_regex(x) for x in ("x{9}+", "a++", "a+ *")) and tx.parse_query('say "two words" kind:class').text == 'say "two words"'
    assert not tx.looks_like_feature("show me how to add one") and tx.looks_like_feature("swap both parts") and not tx.looks_like_feature("add a check for undefined")
    assert not tx.is_safe_regex("(a+)+") and not tx.is_safe_regex("(") and tx.is_safe_regex("a+b")
    assert tx.path_within("/r", "a/../b") and not tx.path_within("/r", "../x") and not tx.path_within("/r", "/etc")
    assert tx.qualifier_tail("crate::configurator::stage_apply::run") == "run" and tx.qualifier_tail("Session.request") == "request"
    assert tx.looks_like_feature("add a button") and not tx.looks_like_feature("fix the button")
