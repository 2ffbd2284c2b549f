import duckdb
import pytest

from wholesail.llm import url_link_trust as U

PAGES = "page_id long, url string, html string"


def page(host, *links, n=0):
    return (n, f"https://{host}/x", "<html>" + "".join(f'<p><A class="l" href="{x}">t</A>' for x in links) + "</html>")


def rows():
    return [
        page("a.com", "https://good.org/p", "/own", "//Also.org/q", "mailto:x@y.z", n=1),
        (2, "http://spam.net/es/1", '<a href="http://good.org/">x</a>'),
        page("linker.org", "http://spam.net/es/1", "http://spam.net/fr/", "relative", n=3),
        page("good.org", "http://third.org", n=4),
        page("mixed.org", "http://spam.net/", "http://spam.net/", n=5),
        page("also.org", n=6), page("third.org", n=7), page("alone.org", n=8),
        (9, None, None), (10, "no scheme", "<a href=http://good.org>u</a>"), (11, "http://EXAMPLE.com/en/x?y#z", ""), (12, "http://www.example.com/en/", None),
        (13, "http://sub.example.com/en", None), (14, "http://xexample.com/en/", None), (15, "http://net", None), (16, "x://h.org:80?q=://b", ""), (None, "http://a.com/", None),
        (1, "https://a.com/x", ""), (1, "https://a.com/x", ""),
    ]


def test_verdicts(spark):
    out = {r["page_id"]: r for r in U.judge(spark.createDataFrame(rows(), PAGES)).collect()}
    verdict = lambda i: (out[i]["rule"], out[i]["verdict"])
    assert verdict(1) == ("com/", "allow") and verdict(2) == ("net/es/", "block")
    assert verdict(3) == (None, "block") and verdict(5) == (None, "block")  # they link to a blocked host
    assert verdict(4) == verdict(6) == verdict(7) == verdict(8) == (None, "allow")
    assert out[7]["trust"] > 0 and out[6]["trust"] > 0 and out[8]["trust"] == out[8]["distrust"] == 0
    assert verdict(11) == ("example.com/en/", "block") and out[11]["host"] == "example.com" and out[11]["path"] == "/en/x"
    assert verdict(12) == ("www.example.com/en/", "allow") and verdict(13) == ("com/", "allow")
    assert verdict(14) == ("com/", "allow")
    assert (out[9]["host"], out[9]["path"], *verdict(9)) == ("", "", None, "allow") and out[10]["host"] == ""
    assert (out[15]["host"], out[15]["path"]) == ("net", "") and (out[16]["host"], out[16]["path"]) == ("h.org:80", "")


def test_equals_the_sql_also_with_links(spark):
    df = spark.createDataFrame(rows(), PAGES)
    pages = df.toPandas()  # noqa: F841 — read by the SQL
    want = duckdb.sql(U.ORACLE).df()
    got = U.judge(df).toPandas()
    key = ["page_id", "host", "path", "verdict"]
    norm = lambda d: sorted(tuple(repr(x) if x == x and x is not None else "-" for x in r) for r in d[key].astype(object).itertuples(index=False))
    assert norm(got) == norm(want)
    a, b = got.groupby("host").trust.max(), want.groupby("host").trust.max()
    assert a.to_dict() == pytest.approx(b.to_dict())
    assert got.groupby("host").distrust.max().to_dict() == pytest.approx(want.groupby("host").distrust.max().to_dict())


def test_scores_equal_a_plain_power_iteration(spark):
    links = [("a", "b", 3), ("a", "c", 1), ("b", "c", 2), ("c", "a", 1), ("d", "a", 5)]
    seeds = [("a", 1, 0), ("d", 3, 0), ("c", 0, 2)]
    out = {r["host"]: (r["trust"], r["distrust"]) for r in U.propagate(
        spark.createDataFrame(seeds, "host string, trust long, distrust long"), spark.createDataFrame(links, "src string, dst string, links long")).collect()}

    def plain(edges, seed):
        total = {}
        for s, _, n in edges:
            total[s] = total.get(s, 0) + n
        score = dict(seed)
        for _ in range(U.ROUNDS):
            new = {h: (1 - U.DAMPING) * x for h, x in seed.items()}
            for s, d, n in edges:
                new[d] = new.get(d, 0) + U.DAMPING * score.get(s, 0) * n / total[s]
            score = new
        return score

    trust, distrust = plain(links, {"a": 0.25, "d": 0.75}), plain([(d, s, n) for s, d, n in links], {"c": 1.0})
    assert {h: x[0] for h, x in out.items() if x[0]} == pytest.approx(trust) and {h: x[1] for h, x in out.items() if x[1]} == pytest.approx(distrust)


def test_empty_extra_columns_and_plan(spark):
    df = spark.createDataFrame(rows(), PAGES).selectExpr("*", "1 host", "2 path", "3 rule", "4 trust", "5 kind", "6 by_rule")
    out = U.judge(df)
    assert out.count() == len(rows())
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Cartesian" not in plan
    assert U.judge(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        U.judge(df, rules=(("a", "/", "allow"),) * (U.MOST_RULES + 1))
