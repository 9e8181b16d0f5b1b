import re

from folioforge.llm import catalog, urls

SF = "/root/testdata/sf0.001"


def parts(url):
    found = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return (re.sub("[A-Z]", lambda m: m[0].lower(), found[1]), found[2]) if found else ("", "")


def rule_of(host, path):
    fits = [(len(r), r, v) for r, v in urls.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
    return max(fits)[1:] if fits else (None, None)


def checked(pages, found):
    assert found.columns[:5] == ["page_id", "host", "path", "rule", "verdict"]
    rows = found.collect()
    expected = []
    for page_id, url in pages:
        host, path = parts(url)
        expected.append((page_id, host, path, *rule_of(host, path)))
    assert sorted(((r.page_id, r.host, r.path, r.rule) for r in rows), key=str) == sorted((x[:4] for x in expected), key=str)
    given = {x[1:3]: x[4] for x in expected if x[4]}
    assert all(r.verdict == given.get((r.host, r.path), r.verdict) and r.verdict in ("allow", "block") for r in rows)
    return rows


def test_whole_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    rows = checked([(r.page_id, r.url) for r in pages.collect()], catalog.op4_url_filter(spark, SF))
    assert all((r.verdict == "block") == (r.purity > urls.REJECT) for r in rows if r.rule is None)


def test_templates(spark):
    def site(host, sections, n):
        return [f"http://{host}/{s}/{i}{'.html' if i % 3 == 0 else ''}" for s in sections for i in range(n)]

    pages = site("a.org", ["news", "wire"], 40) + [f"http://a.org/user/name{chr(97 + i % 26)}{i // 26}x/about" for i in range(60)]
    shop = [f"http://shop.org/{'-'.join('abcdefghij'[int(c)] for c in str(i))}/buy" for i in range(50)]
    bad = site("b.net", ["casino"], 30) + site("c.org", ["casino"], 10) + site("b.org", ["fr"], 30)
    urls_ = pages + shop + bad
    docs = spark.createDataFrame(list(enumerate(urls_)), "page_id long, url string")
    rows = {r.page_id: r for r in urls.judged(docs).collect()}
    by_url = {u: rows[i] for i, u in enumerate(urls_)}
    assert by_url["http://a.org/news/1"].template == by_url["http://a.org/wire/2"].template == "a.org/*/*/"  # alike: merged
    assert by_url["http://a.org/news/3.html"].template.endswith("*.html/")
    assert by_url[shop[0]].template == by_url[shop[7]].template == "shop.org/*/buy/"  # many different children
    assert by_url["http://c.org/casino/1"].verdict == "block" and by_url["http://b.org/fr/1"].verdict == "allow"
    assert by_url["http://a.org/news/1"].verdict == "allow"


def labelled_templates(spark, urls_, bad):
    rows = [(str(i), *parts(u), b, 1) for i, (u, b) in enumerate(zip(urls_, bad, strict=True))]
    df = spark.createDataFrame(rows, "url_key string, host string, path string, bad int, n long")
    return {r.url_key: r for r in urls.templates(df).collect()}, df


def test_deep_paths_keep_their_branches(spark):
    names = "abcdefghij"
    deep = [f"http://h.com/a/b/c/{s}/{names[i // 10]}{names[i % 10]}/x" for s in ("good", "bad") for i in range(30)]
    found, df = labelled_templates(spark, deep, [int("/bad/" in u) for u in deep])
    good, bad = {found[str(i)].template for i in range(30)}, {found[str(i)].template for i in range(30, 60)}
    assert good == {"h.com/a/b/c/good/*/x/"} and bad == {"h.com/a/b/c/bad/*/x/"}
    by = {r.template: r.purity for r in urls.purity(urls.templates(df)).collect()}
    assert by["h.com/a/b/c/bad/*/x/"] > 0.9 > 0.1 > by["h.com/a/b/c/good/*/x/"]
    three = [f"http://h.com/a/b/c/{s}/x" for s in "def"]
    found, _ = labelled_templates(spark, three, [0, 1, 0])  # one label each is no difference beyond chance
    assert {found[str(i)].template for i in range(3)} == {"h.com/a/b/c/*/x/"}
    long = ["http://l.com/" + "s/" * 5000 + x for x in ("y1/a", "y2/b", "z")]
    found, _ = labelled_templates(spark, long, [None] * 3)
    assert found["2"].template == "l.com/" + "s/" * 5000 + "z/" and found["0"].template.endswith("s/*/*/")  # alike below the wildcard


def plain_templates(rows):
    """The tree by recursion over plain lists. rows: (host, path, bad), all different."""
    out = {}

    def variable(s):
        return re.search("[0-9]", s)

    def star(s):
        ext = re.search(r"\.[A-Za-z]{1,5}$", s)
        return "*" + (ext[0] if ext else "")

    def letter(s):
        return "a" if not variable(s) else "." if re.search(r"\.[A-Za-z]{1,5}$", s) else "*"

    def grow(node, members):
        if len(members) == 1:
            key, left, _ = members[0]
            out[key] = node + "".join((star(s) if variable(s) else s) + "/" for s in left)
            return
        branches = {}
        for key, left, bad in members:
            if not left:
                out[key] = node
            else:
                s = left[0]
                branches.setdefault((star(s) if variable(s) else s, bool(variable(s))), []).append((key, left[1:], bad))
        total = sum(map(len, branches.values()))
        general, literal = {}, {}
        for (s, var), own in branches.items():
            rare = len(branches) >= urls.MANY_CHILDREN and len(own) < urls.RARE_CHILD * total
            general[s, var] = s if var else star(s) if rare else s
            if not var and not rare:
                shapes = {}
                for _, left, _ in own:
                    shape = "".join(map(letter, left[: urls.SHAPE]))
                    shapes[shape] = shapes.get(shape, 0) + 1
                kind = ",".join(sorted(x for x, k in shapes.items() if k >= urls.FREQUENT_SHAPE * len(own)))
                literal.setdefault(kind, []).append((s, len(own), shapes, sum(b is not None for *_, b in own), sum(b or 0 for *_, b in own)))
        for group in literal.values():
            whole = sum(n for _, n, *_ in group)
            pool = {}
            for _, _, shapes, *_ in group:
                for x, k in shapes.items():
                    pool[x] = pool.get(x, 0) + k
            seen, bad = sum(g[3] for g in group), sum(g[4] for g in group)
            for s, n, shapes, own_seen, own_bad in group if len(group) > 1 else []:
                overlap = sum(min(k / n, pool[x] / whole) for x, k in shapes.items())
                p = bad / max(seen, 1)
                near = bad == 0 if own_seen == 0 else abs(own_bad / max(own_seen, 1) - p) <= urls.NOISE * (p * (1 - p) / max(own_seen, 1)) ** 0.5 + 1e-9
                if 1 - overlap <= urls.SIMILAR + (len(shapes) / n) ** 0.5 / 2 and near:
                    general[s, False] = "*"
        below = {}
        for key, own in branches.items():
            below.setdefault(general[key], []).extend(own)
        for name, own in below.items():
            grow(f"{node}{name}/", own)

    hosts = {}
    for i, (host, path, bad) in enumerate(rows):
        hosts.setdefault(host + ("//" if path.endswith("/") else "/"), []).append((str(i), [s for s in path.split("/") if s], bad))
    for root, members in hosts.items():
        grow(root, members)
    return out


def test_tree_and_purity_against_plain_code(spark, monkeypatch):
    dice = __import__("random").Random(3)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    made = set()
    while len(made) < 900:
        host = dice.choice(["a.org", "b.org", "c.net"])
        depth = dice.randint(0, 6)
        path = "".join("/" + dice.choice([dice.choice(words[:3]), dice.choice(words), str(dice.randint(0, 9)), f"p{dice.randint(0, 9)}.html"]) for _ in range(depth)) + dice.choice(["", "/"])
        made.add((host, path))
    rows = [(h, p, dice.choice([None, int(h == "c.net"), int(p.startswith("/wa"))])) for h, p in sorted(made)]
    df = spark.createDataFrame([(str(i), h, p, b, 1) for i, (h, p, b) in enumerate(rows)], "url_key string, host string, path string, bad int, n long")
    expected = plain_templates(rows)
    for bound in (urls.hot_bound, lambda *_: 3):
        monkeypatch.setattr(urls, "hot_bound", bound)
        found = urls.templates(df)
        assert {r.url_key: r.template for r in found.collect()} == expected
    bad = {t: [b for i, (_, _, b) in enumerate(rows) if expected[str(i)] == t] for t in set(expected.values())}
    tail = {t: re.match(r"[^/]*(.*)", t)[1] for t in bad}
    seen, blocked = (lambda x: sum(b is not None for b in x)), (lambda x: sum(b or 0 for b in x))
    every = [b for x in bad.values() for b in x]
    overall = (blocked(every) + 0.5) / (seen(every) + 1)
    for r in urls.purity(found).collect():
        shared = [b for t, x in bad.items() if tail[t] == tail[r.template] for b in x]
        by_path = (blocked(shared) + urls.WEIGHT * overall) / (seen(shared) + urls.WEIGHT)
        assert abs(r.purity - (blocked(bad[r.template]) + urls.WEIGHT * by_path) / (seen(bad[r.template]) + urls.WEIGHT)) < 1e-9


def test_no_labels_no_merge_with_blocked(spark):
    """Branches of other languages don't inherit what the labels of one say."""
    pages = [(i * 10 + k, f"http://blog.a.example.com/{lang}/{i}") for i in range(30) for k, lang in enumerate(("de", "en", "fr", "es"))]
    pages += [(1000 + i, f"http://b.example.net/en/{i}") for i in range(60)]
    rows = [r for r in urls.judged(spark.createDataFrame(pages, "page_id long, url string")).collect() if r.page_id < 1000]
    assert {(r.path[:4], r.verdict) for r in rows} == {("/de/", "block"), ("/en/", "allow"), ("/fr/", "allow"), ("/es/", "allow")}
    whole = urls.judged(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).where("host like '%example.com' and path like '/en/%'")
    assert {r.verdict for r in whole.select("verdict").distinct().collect()} == {"allow"}


def test_odd_rows(spark):
    pages = [(1, None), (2, ""), (3, "no scheme/net/"), (4, "HTTP://EXAMPLE.net"), (5, "x://É.Example.NET/en/?q=://z/"), (5, "x://É.Example.NET/en/?q=://z/"), (None, "a://b://c/d#e?f"), (6, "a://h/" + "s/" * 30000), (7, "a://h/x\ny"), (8, "//://org/fr/1"), (9, "a://myexample.net/en/1"), (10, "a://u@h.net:80/x"), (11, "a://h?x#y/")]
    docs = spark.createDataFrame([(*p, "h", "t", 1) for p in pages], "page_id long, url string, host string, template string, n int")
    checked(pages, urls.judged(docs))
    assert urls.judged(docs.limit(0)).collect() == []
    assert {r.verdict for r in urls.judged(docs, rules=[]).collect()} == {"allow"}
