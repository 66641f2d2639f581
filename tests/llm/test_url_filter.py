from inklattice.llm import url_filter


def brute(url):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
        host = rest[:cut].translate({c: c + 32 for c in range(65, 91)})
        tail = rest[cut:]
        path = tail[: min([i for i in (tail.find(c) for c in "?#") if i >= 0], default=len(tail))]
    best = None
    for h, p, v in url_filter.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, v)
    return host, path, best


URLS = [
    "http://A.Example.NET/en/1?x=/de/", "https://example.net/EN/1", "https://example.net", "http://x.net?y", "ftp://badexample.com/de/", "http://example.com/de/a#b", "http://www.example.com/de", "http://q.org/fr/", "http://org/fr/x",
    "no scheme", None, "", "://", "http://É.org/fr/", "http://a.b://c/d", "x\n://example.com/de/\n?", "http://h#/x", "http://" + "a" * 30_000 + ".net/",
]


def test_rules_equal_brute_force(spark):
    rows = [(k, u, None, "r") for k, u in enumerate(URLS)] + [(0, URLS[0], "", "r"), (None, URLS[1], "", "r")]
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string, rule string")).collect()
    assert len(got) == len(rows)
    for r in got:
        host, path, best = brute(URLS[1] if r.page_id is None else URLS[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, best and best[0])
        assert r.verdict == best[1] if best else r.verdict in ("allow", "block")


def test_propagation(spark):
    link = lambda *hosts: "".join(f"<a HREF='http://{h}/'>x</a><a href=/local>y</a>" for h in hosts)
    rows = [
        (1, "http://good.org/fr/1", link("friend.com", "friend.com")), (2, "http://friend.com/", link("second.com")), (3, "http://second.com/", ""),
        (4, "http://bad.net/", link("victim.com")), (5, "http://spammer.com/", link("bad.net")), (6, "http://victim.com/", None), (7, "http://alone.com/", link("alone.com")), (8, "http://ring.com/", link("spammer.com")),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in url_filter.judge(pages).collect()}
    assert [got[k].verdict for k in range(1, 9)] == ["allow", "allow", "allow", "block", "block", "allow", "allow", "block"]
    # The same masses by plain iteration.
    edges = {("good.org", "friend.com"): 1, ("friend.com", "second.com"): 1, ("bad.net", "victim.com"): 1, ("spammer.com", "bad.net"): 1, ("ring.com", "spammer.com"): 1}
    mass = {"good.org": 1.0}
    for _ in range(url_filter.ITERATIONS):
        new = {"good.org": 1 - url_filter.DAMPING}
        for (a, b), w in edges.items():
            new[b] = new.get(b, 0) + url_filter.DAMPING * mass.get(a, 0) * w
        mass = new
    mass = {h: m / sum(mass.values()) for h, m in mass.items()}
    assert abs(got[2].trust - mass["friend.com"]) < 1e-12 and abs(got[3].trust - mass["second.com"]) < 1e-12


def test_long_chains_are_followed_to_their_ends(spark):
    chain = [f"h{k}.com" for k in range(20)] + ["bad.net"]
    rows = [(k, f"http://{h}/", f"<a href='http://{chain[k + 1]}/'>x</a>" if k + 1 < len(chain) else "") for k, h in enumerate(chain)]
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.verdict for r in got} == {"block"}
    for r in got:
        far = 20 - r.page_id
        want = url_filter.DAMPING**far * (1 - url_filter.DAMPING) / (1 - url_filter.DAMPING**21)
        assert abs(r.distrust - want) < 1e-12 * want


def test_cycles_converge(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0)], "src string, dst string, weight double")
    got = dict(url_filter.propagate(edges, spark.createDataFrame([("a",)], "host string"), damping=0.5).collect())
    assert abs(got["a"] - 2 / 3) < 1e-8 and abs(got["b"] - 1 / 3) < 1e-8


def test_masses_equal_a_dense_solution(spark, monkeypatch):
    """Trust and distrust on a random graph with hosts without links and a host with many."""
    import random

    import numpy as np

    monkeypatch.setattr(url_filter, "HUB", 4)
    r = random.Random(4)
    hosts = [f"h{k}.com" for k in range(25)] + ["a.net", "b.net", "x.org", "y.org"]
    links = {(a, b): r.randint(1, 3) for a in hosts[:20] + ["x.org"] for b in r.sample(hosts, 3) if a != b}
    links |= {("h3.com", b): 1 for b in hosts if b != "h3.com"}
    rows = [(k, f"http://{h}/fr/", "".join(f'<a href="http://{b}/p">x</a>' * n for (a, b), n in links.items() if a == h)) for k, h in enumerate(hosts)]
    got = {r.host: r for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}

    def solve(weights, seeds):
        at = {h: k for k, h in enumerate(hosts)}
        move, start = np.zeros((len(hosts), len(hosts))), np.zeros(len(hosts))
        for (a, b), n in weights.items():
            move[at[b], at[a]] = n
        out = move.sum(axis=0)
        start[[at[h] for h in seeds]] = 1 / len(seeds)
        move = np.where(out > 0, move / np.maximum(out, 1), start[:, None])  # hosts without links return to the seeds
        return np.linalg.solve(np.eye(len(hosts)) - url_filter.DAMPING * move, (1 - url_filter.DAMPING) * start)

    trust, distrust = solve(links, ["x.org", "y.org"]), solve({(b, a): n for (a, b), n in links.items()}, ["a.net", "b.net"])
    for k, h in enumerate(hosts):
        assert abs(got[h].trust - trust[k]) < 1e-7 and abs(got[h].distrust - distrust[k]) < 1e-7
        if got[h].rule is None:
            assert got[h].verdict == ("block" if distrust[k] > 0 and distrust[k] >= trust[k] else "allow")


def test_empty(spark):
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
