"""Robots rules found by prefixes against the first fitting rule in file order."""

import random

from webloom.sources import site_index


def test_first_fitting_rule(spark):
    r = random.Random(12)
    piece = lambda n: "".join(r.choice("ab/*?") for _ in range(r.randint(0, n)))
    files, sections = [], {}
    for k in range(12):
        origin, lines, of = f"https://h{k}.example", [], {}
        for agent in r.sample(["*", "one", "two", "three"], r.randint(0, 3)):
            rules = [(r.random() < 0.4, r.choice(["", "*", "/", "/" + piece(6), "/" + piece(2), piece(3)])) for _ in range(r.randint(1, 40))]
            lines += [f"User-agent: {agent}", *(f"{'Allow' if a else 'Disallow'}: {p}" for a, p in rules), ""]
            of[agent] = [(a or p.strip() == "", p) for a, p in rules]
        files.append((origin, "\n".join(lines)))
        sections[origin] = of
    asked = [(i, f"{o}{r.choice(['', '/', '/' + piece(8), '/' + piece(8)])}") for i, (o, _) in enumerate(files * 25)] + [(9999, "https://unknown.example/a")]
    asked += asked[:3]
    agents = ["One/2.0", "two", "Four"]
    rows = site_index.robots_rules(spark.createDataFrame(files, "origin string, body string"))
    got = site_index.robots_said(spark.createDataFrame(asked, "n int, url string"), rows, agents)
    assert got.columns == ["n", "url", "agent", "allowed"]
    want = []
    for n, url in asked:
        origin = "https://" + url.split("/")[2]
        path = url.removeprefix(origin)
        path = path if path.startswith("/") else f"/{path}"
        for agent in agents:
            of = sections.get(origin, {})
            rules = of.get(agent.lower().split("/")[0], of.get("*", []))
            want.append((n, url, agent, next((a for a, p in rules if p == "*" or path.startswith(p)), True)))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_many_rules_make_rows_by_length(spark):
    """A file with 5,000 rules of four lengths: no URL meets more than four rows."""
    body = "User-agent: *\n" + "\n".join(f"Disallow: /{'x' * (k % 4)}{k:05d}" for k in range(5000))
    rows = site_index.robots_rules(spark.createDataFrame([("https://h.example", body)], "origin string, body string"))
    asked = spark.range(2000).selectExpr("concat('https://h.example/', repeat('x', cast(id % 4 as int)), lpad(id, 5, '0'), '/page') AS url")
    assert site_index.robots_allowed(asked, rows).filter("NOT allowed").count() == 2000
