import random
import re
from collections import defaultdict

import pytest

from corpusmill.llm import urls as U
from corpusmill.llm.queries import op4_url_templates

SCHEMA = "url string, page_id long, bad boolean, host string, path array<int>"
URLS = [
    (None, "", ""), ("", "", ""), ("no scheme/x", "", ""), ("http://", "", ""), ("HTTP://A.Example.ORG/en/1", "a.example.org", "/en/1"),
    ("https://É.com:80/de/x?y#z", "É.com:80", "/de/x"), ("http://x.net?u=/a", "x.net", ""), ("http://x.net#/a", "x.net", ""),
    ("u://a://b/c", "a:", "//b/c"), ("http://ex\nample.com/fr/\n", "ex\nample.com", "/fr/\n"), ("x/://h/p", "h", "/p"),
]


def brute_rule(host, path):
    fits = []
    for rule, verdict in U.RULES:
        name, rest = rule.split("/", 1)
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest):
            fits.append((len(rule), rule, verdict))
    return max(fits)[1:] if fits else (None, None)


def test_parts_and_rules(spark):
    more = [f"http://{h}{p}" for h in ("org", "a.org", "aorg", "example.org", "b.example.org", "com", "x.com", "net") for p in ("", "/", "/es", "/es/", "/es/x", "/en/1", "/en/12?", "/en/2", "/fr/1", "/de/", "/de")]
    rows = [(u, i, None, "h", [1]) for i, u in enumerate([u for u, _, _ in URLS] + more)]
    got = {r["page_id"]: r for r in U.judge_urls(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == len(rows)
    for i, (_, host, path) in enumerate(URLS):
        assert (got[i]["host"], got[i]["path"]) == (host, path)
    for r in got.values():
        rule, verdict = brute_rule(r["host"], r["path"])
        assert (r["rule"], r["verdict"]) == (rule, verdict or "allow")


def shape(segment):
    return next((name for pattern, name in U.FORMS if re.search(pattern, segment)), segment)


def share(pages, above):
    return (sum(bad for _, bad in pages) + U.PRIOR * above) / (sum(lab for lab, _ in pages) + U.PRIOR)


def brute_tree(leaves, above):
    """{t: (template, share)} of {t: (labelled, bad)} below a node, branch by branch."""

    def grow(some, template, own, level):
        out = {t: (template, own) for t in some if len(t) == level}
        below = {t: x for t, x in some.items() if len(t) > level}
        names = {t[level] for t in below}
        kinds = defaultdict(list)
        for name in names:
            mine = [x for t, x in below.items() if t[level] == name]
            lab, bad = sum(x[0] for x in mine), sum(x[1] for x in mine)
            a, b = bad, lab - bad
            c = sum(x[1] for x in below.values()) - bad
            d = sum(x[0] for x in below.values()) - lab - c
            apart = c + d >= U.SUPPORT and (a + b + c + d) * (a * d - b * c) ** 2 > U.CHI2 * (a + b) * (c + d) * (a + c) * (b + d)
            kinds["**" if lab < U.SUPPORT else name if len(names) == 1 or apart else "*"].append(name)
        for kind, held in kinds.items():
            inside = {t: x for t, x in below.items() if t[level] in held}
            if kind == "**":
                out |= {t: (f"{template}/**", own) for t in inside}
            else:
                out |= grow(inside, f"{template}/{kind}", share(inside.values(), own), level + 1)
        return out

    return grow(leaves, "", share(leaves.values(), above), 0)


def test_tree_matches_brute_force(spark):
    rng = random.Random(9)
    rows = []
    for i in range(1500):
        host = rng.choice(["hot.net"] * 3 + ["b.net", "c.net"])
        section = rng.choice(["news", "spam", "blog", "deep/a/b/c/d/e", "deep/a/b/c/d/spam", "", f"rare-{i % 40}x"])
        bad = None if rng.random() < 0.3 else rng.random() < (0.95 if section.endswith("spam") else 0.1)
        rows.append((f"http://{host}/{section}/{rng.choice(['x', 'y', str(i), f'{i}.html'])}", i, bad, "", []))
    rows += [(rows[0][0], None, True, "", []), rows[1], rows[1], ("http://long.net/" + "a/" * 5_000, 5000, True, "", [])]
    got = U.judge_urls(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert len(got) == len(rows)
    leaves, of = defaultdict(lambda: defaultdict(lambda: [0, 0])), {}
    for url, _, bad, *_ in rows:
        host, path = url[7:].split("/", 1)
        t = tuple(map(shape, path.split("/")))
        of[url] = host, t
        leaves[host][t][0] += bad is not None
        leaves[host][t][1] += bool(bad)
    every = [x for own in leaves.values() for x in own.values()]
    rate = sum(x[1] for x in every) / sum(x[0] for x in every)
    trees = {host: brute_tree(own, rate) for host, own in leaves.items()}
    urls = {r[1]: r[0] for r in rows}
    for r in got:
        host, t = of[urls[r["page_id"]]]
        template, value = trees[host][t]
        assert (r["template"], r["verdict"]) == (template, "block" if value >= U.REJECT else "allow")
        assert r["bad_share"] == pytest.approx(value)
    blocked = {r["template"] for r in got if r["verdict"] == "block"}
    assert any(x.startswith("/spam") for x in blocked) and any(x.startswith("/deep/a/b/c/d/spam") for x in blocked)
    assert all("spam" in x for x in blocked) and {r["template"] for r in got} > blocked


@pytest.mark.parametrize("rows", [[], [("http://a.net/x", 1, None, "", [])]])
def test_empty_and_unlabelled(spark, rows):
    got = U.judge_urls(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [r["verdict"] for r in got] == ["allow"] * len(rows)


def test_deep_sections(spark, tmp_path):
    """The query judges a wholly bad section below the seventh level apart from the good pages beside it."""
    pages = [(i, f"http://deep.net/a/b/c/d/e/f/{'spam' if i % 2 else 'docs'}/{i}") for i in range(80)]
    spark.createDataFrame(pages, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(80)], "doc_id long, quality long, toxic long").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r["page_id"]: (r["verdict"], r["template"]) for r in op4_url_templates(spark, str(tmp_path)).collect()}
    assert got == {i: ("block", "/a/b/c/d/e/f/spam/{n}") if i % 2 else ("allow", "/a/b/c/d/e/f/docs/{n}") for i in range(80)}
