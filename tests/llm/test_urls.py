from __future__ import annotations

import re

from comparing import DATA
from pyspark.sql import functions as F

from tallyspark.llm import queries, urls
from tallyspark.llm.common import table


def parts(url: str | None) -> tuple[str, str]:
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    return low, re.match(r"[^?#]*", rest[len(host) :])[0]


def rule(host: str, path: str) -> tuple[str | None, str | None]:
    fits = [(h + p, says) for says, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda x: len(x[0]), default=(None, None))


def test_query_on_whole_table(spark):
    pages = {r.page_id: r.url for r in table(spark, str(DATA / "sf0.01"), "pages").collect()}
    found = queries.op8_path_templates(spark, str(DATA / "sf0.01")).collect()
    assert {r.page_id for r in found} == set(pages) and len(found) == len(pages)
    for r in found:
        host, path = parts(pages[r.page_id])
        name, says = rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, name) and r.verdict in ("allow", "block") and (says is None or r.verdict == says)
        assert says is not None or r.verdict == ("block" if r.bad_share > 0.5 else "allow")


ODD_URLS = [None, "", "no scheme", "://", "http://", "HTTP://WWW.Example.COM/en/1", "http://a.com", "http://a.com?x=/en/", "http://xcom/", "http://net/es/", "http://É.net/fr/#/x://y", "http://h.org//a///b/", "http://h.org/" + "a/" * 40, "http://h.org/" + "x" * 20000, "a://b://c.com/d", "http://h.org/\n/q"]


def test_odd_urls(spark):
    pages = spark.createDataFrame(list(enumerate(ODD_URLS)) + [(None, "http://h.org/1"), (3, "http://h.org/1"), (3, "http://h.org/1")], "page_id long, url string").withColumns({c: F.lit("clash") for c in ("host", "path", "rest", "raw", "segments", "number", "n", "template", "verdict", "shape")})
    labels = spark.createDataFrame([], "doc_id long, bad int")
    found = urls.judge(pages, labels).collect()
    assert len(found) == len(ODD_URLS) + 3
    for r in found:
        if r.page_id is not None and r.page_id != 3:
            assert (r.host, r.path) == parts(ODD_URLS[r.page_id]) and r.rule == rule(r.host, r.path)[0]
    assert urls.judge(pages.limit(0), labels).count() == 0


def test_bad_templates_of_a_host_are_rejected(spark):
    pages = [(i, f"http://h.org/spam/{i}.html?q={i}") for i in range(60)] + [(100 + i, f"http://h.org/news/{i + 100}.html") for i in range(60)]
    pages += [(1000 + i, f"http://h.org/{'abcdefghij'[i // 10]}{'klmnopqrst'[i % 10]}/{1000 + i}") for i in range(80)] + [(3000 + i, f"http://g.org/spam/{3000 + i}.html") for i in range(20)]
    labels = [(i, 1) for i in range(0, 60, 2)] + [(i, 0) for i in range(100, 160, 2)] + [(i, 0) for i in range(3000, 3020)] + [(1000, None)]
    found = {r.page_id: r for r in urls.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, bad int")).collect()}
    assert all(found[i].verdict == "block" for i in range(60)) and all(found[100 + i].verdict == "allow" for i in range(60))
    assert all(found[3000 + i].verdict == "allow" for i in range(20))
    assert len({found[1000 + i].template for i in range(80)}) == 1 and "*" in found[1000].template  # variable segments become one wildcard
    assert found[0].template != found[100].template


def test_alike_branches_are_merged(spark):
    pages = [(i, f"http://h.org/{'ab'[i % 2]}/{i}") for i in range(80)]
    labels = spark.createDataFrame([(i, int(i % 10 < 2)) for i in range(80)], "doc_id long, bad int")
    found = urls.judge(spark.createDataFrame(pages, "page_id long, url string"), labels).collect()
    assert {r.template for r in found} == {"/a|b/{n}"}


def test_no_python_in_the_plan(spark):
    plan = queries.op8_path_templates(spark, str(DATA / "sf0.001"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def brute_templates(shapes: dict, prior: float, max_children: int = 20, rare: float = 0.05, z_limit: float = 1.0, weight: float = 5.0) -> dict:
    """(host, segments) to template, recursively. shapes: (host, segments) to [pages, labelled, bad]."""
    found = {}

    def share(n: int, bad: int) -> float:
        return (bad + weight * prior) / (n + weight)

    def walk(template: str, members: list) -> None:  # members: (key, rest)
        if len(members) == 1:
            key, rest = members[0]
            found[key] = template + "".join("/" + s for s in rest)
            return
        while all(rest for _, rest in members) and len({rest[0] for _, rest in members}) == 1:
            template += "/" + members[0][1][0]
            members = [(k, rest[1:]) for k, rest in members]
        found.update({k: template for k, rest in members if not rest})
        members = [(k, rest) for k, rest in members if rest]
        heads: dict = {}
        for k, rest in members:
            heads.setdefault(rest[0], []).append((k, rest))
        pages = {h: sum(shapes[k][0] for k, _ in m) for h, m in heads.items()}
        name = {h: "*" if len(heads) > max_children and pages[h] < sum(pages.values()) * rare else h for h in heads}
        kept: dict = {}
        for h, m in heads.items():
            x = kept.setdefault(name[h], [0, 0, set()])
            x[0] += sum(shapes[k][1] for k, _ in m)
            x[1] += sum(shapes[k][2] for k, _ in m)
            x[2] |= {len(rest) for _, rest in m}
        runs: list = []
        for depths, _, label in sorted((sorted(x[2]), share(x[0], x[1]), n) for n, x in kept.items()):
            n, bad, _ = kept[label]
            if runs and runs[-1][0] == depths:
                _, names, n0, bad0 = runs[-1]
                a, b = n0 + weight, n + weight
                pooled = (share(n0, bad0) * a + share(n, bad) * b) / (a + b)
                if abs(share(n0, bad0) - share(n, bad)) <= z_limit * (pooled * (1 - pooled) * (1 / a + 1 / b) + 1e-12) ** 0.5:
                    runs[-1] = (depths, [*names, label], n0 + n, bad0 + bad)
                    continue
            runs.append((depths, [label], n, bad))
        for _, names, _, _ in runs:
            below = [(k, rest[1:]) for h, m in heads.items() if name[h] in names for k, rest in m]
            branch = template + "/" + "|".join(sorted(names))
            found.update({k: branch for k, rest in below if not rest})
            if any(rest for _, rest in below):
                walk(branch, [(k, rest) for k, rest in below if rest])

    for host in {h for h, _ in shapes}:
        walk("", [(k, k[1]) for k in shapes if k[0] == host])
    return found


def test_whole_table_with_planted_labels(spark):
    pages = [(r.page_id, r.url) for r in table(spark, str(DATA / "sf0.1"), "pages").collect()]
    labels = {}
    for _, url in pages:
        host, path = parts(url)
        number = int(re.search("[0-9]+", path)[0])
        if number % 3:  # whole hosts, and one language of others
            labels[number] = max(labels.get(number, 0), int(bool(re.search("casino|pills|bets|adult|spam", host)) or (host.endswith(".org") and path.startswith("/es"))))
    labelled = spark.createDataFrame(list(labels.items()), "doc_id long, bad int")
    frame = spark.createDataFrame(pages, "page_id long, url string")
    found = urls.judge(frame, labelled).collect()
    shapes: dict = {}
    for _, url in pages:
        host, path = parts(url)
        segments = tuple(re.sub("[0-9]+", "{n}", path).removeprefix("/").split("/"))
        x = shapes.setdefault((host, segments), [0, 0, 0])
        bad = labels.get(int(re.search("[0-9]+", path)[0]))
        x[0], x[1], x[2] = x[0] + 1, x[1] + (bad is not None), x[2] + (bad or 0)
    prior = sum(x[2] for x in shapes.values()) / sum(x[1] for x in shapes.values())
    templates = brute_templates(shapes, prior)
    sums: dict = {}
    for key, template in templates.items():
        s = sums.setdefault((key[0], template), [0, 0])
        s[0], s[1] = s[0] + shapes[key][1], s[1] + shapes[key][2]
    assert len(found) == len(pages)
    for r in found:
        key = (r.host, tuple(re.sub("[0-9]+", "{n}", r.path).removeprefix("/").split("/")))
        n, bad = sums[(r.host, templates[key])]
        share = (bad + 5 * prior) / (n + 5)
        assert r.template == templates[key] and abs(r.bad_share - share) < 1e-9
        assert r.verdict == (rule(r.host, r.path)[1] or ("block" if share > 0.5 else "allow"))
    undecided = [r for r in found if r.rule is None]
    blocked = [r for r in undecided if r.verdict == "block"]
    assert len(blocked) > 5 and all(re.search("casino|pills|bets|adult|spam", r.host) or r.path.startswith("/es") for r in blocked)


def test_deep_paths_are_told_apart(spark):
    deep = "http://h.org/" + "/".join("abcdefgh")
    pages = [(i, f"{deep}/{'bad' if i % 2 else 'good'}/{i}.html") for i in range(80)] + [(500, "http://h.org/" + "x/" * 300), (501, "http://h.org/a/99999999999999999999999999")]
    labels = [(i, i % 2) for i in range(60)] + [(999999999999999999, 1)]
    found = {r.page_id: r for r in urls.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, bad int")).collect()}
    assert all(found[i].verdict == ("block" if i % 2 else "allow") for i in range(80))
    assert found[500].template == "/" + "x/" * 300 and found[501].verdict == "allow"
