"""Operators 3 and 7 against brute force and planted cases."""

import os

import numpy as np

from weftline.llm import page_text, vector_links


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


# --- 3
PAGE = "<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a='</p>';</script></head><body><header>Site</header><nav><ul><li>a<li>b</ul></nav><!-- c --><div class='ad'>Buy</div><article><header><h1>Ti&eacute;tle &amp; more</h1></header><p>One <b>bold</b>\n  two<br>three<p>Four &lt;x&gt; 1 < 2<div class='share-buttons'>Share</div><ul><li>i</li><li>j</ul><form><input>no</form><section id=comments><p>Nice!</p></section></article><aside>side</aside><footer>&copy; x"


def zone(page, *zones):
    return [x for x, z in page_text.lines(page) if z in zones]


def test_article_lines():
    assert zone(PAGE, page_text.INSIDE) == ["Tiétle & more", "One bold two three", "Four <x> 1 < 2", "i", "j"]
    assert zone(PAGE, page_text.OUTSIDE) == [] and zone(PAGE, page_text.FURNITURE) == ["Site", "a", "b", "Buy", "Share", "no", "Nice!", "side", "© x"]
    for page in (None, "", "<", "<p", "&am", "<!--", "<script>", "</p></div>", "<nav>x", "<p>" * 3000, "<a " * 5000, '<a b="' * 5000):
        assert zone(page, page_text.INSIDE) == [] and zone(page, page_text.OUTSIDE) in ([], ["&am"], ["<"])
    assert zone("<nav>menu<article><p>text</article>", page_text.INSIDE) == ["text"]
    deep = "<div>" * 3000 + "x" + "</div>" * 3000
    assert zone(deep, page_text.OUTSIDE) == ["x"]


def brute_lcs(a, b):
    n = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            n[i + 1][j + 1] = n[i][j] + 1 if x == y else max(n[i][j + 1], n[i + 1][j])
    return n[-1][-1]


def test_common_lines():
    rng = np.random.default_rng(0)
    for _ in range(500):
        a, b = (["abcdefg"[k] for k in rng.integers(0, 5, rng.integers(0, 14))] for _ in range(2))
        got = sorted(page_text.common_lines(a, b))
        assert len(got) == brute_lcs(a, b)
        it = iter(b)
        assert all(a[i] in it for i in got)


def test_differencing(spark):
    page = lambda k: f"<div>Home of the site</div><div>Line {k} one</div><p>Line {k} two</p><div>Made by us</div>"
    urls = [f"http://h.x/a/{k:03d}" for k in range(40)]
    table = [(k, u, page(k)) for k, u in enumerate(urls)] + [(100, "http://alone.x/", page(7)), (101, None, page(8)), (102, "http://h.x/a/005", None), (103, "http://h.x/z", PAGE), (103, "http://h.x/z", PAGE), (None, "http://h.x/b", "")]
    df = spark.createDataFrame(table, "page_id long, url string, html string").selectExpr("*", "'c' as text", "1 as host").repartition(5)
    got = {}
    for r in page_text.extract(df).collect():
        got.setdefault(r.page_id, []).append(r)
        assert r.n_chars == len(r.text)
    for k in range(40):
        if k not in (4, 5, 6):
            assert [r.text for r in got[k]] == [f"Line {k} one\n\nLine {k} two"], k
    whole = "Home of the site\n\nLine {0} one\n\nLine {0} two\n\nMade by us"
    assert got[100][0].text == whole.format(7) and got[101][0].text == whole.format(8)
    assert got[102][0].text == "" and got[None][0].text == ""
    assert [r.text for r in got[103]] == ["Tiétle & more\n\nOne bold two three\n\nFour <x> 1 < 2\n\ni\n\nj"] * 2
    assert rows(page_text.extract(df.limit(0))) == []


def brute_pages(pages):
    """Whole pages by plain means: pages are (id, url, [(line, where it stands)])."""
    def cut(url):
        host, _, path = url.split("://")[1].partition("/")
        return host, "/" + path

    def start(a, b):
        return len(os.path.commonprefix([a, b]))

    def lcs(a, b):
        if not a or not b:
            return 0
        n = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                n[i + 1][j + 1] = n[i][j] + 1 if x == y else max(n[i][j + 1], n[i + 1][j])
        out, i, j = set(), len(a), len(b)
        while i and j:
            if n[i][j] == n[i - 1][j]:
                i -= 1
            elif n[i][j] == n[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                out.add(i)
        return out

    ordered, out = sorted((*cut(u), k, own) for k, u, own in pages), {}
    for at, (host, path, k, own) in enumerate(ordered):
        near = [ordered[i] for i in (at - 1, at + 1) if 0 <= i < len(ordered) and ordered[i][0] == host]
        near.sort(key=lambda r: -start(path, r[1]))  # stable: the one before wins a tie
        gone = lcs([x for x, _ in own], [x for x, _ in near[0][3]]) if near else set()
        left = [(i, x) for i, (x, z) in enumerate(own) if z == page_text.OUTSIDE and i not in gone]
        inside = [(i, x) for i, (x, z) in enumerate(own) if z == page_text.INSIDE]
        teasers = sum(len(x) for _, x in left) > sum(len(x) for _, x in inside)
        out[k] = "\n\n".join(x for _, x in (sorted(inside + left) if teasers else inside))
    return out


def test_whole_query_like_brute_force(spark, tmp_path):
    """Pages with an article, with teasers in articles, and with neither; menus and footers with and without names."""
    rng = np.random.default_rng(5)
    pages, table = [], []
    for k in range(160):
        host = int(rng.integers(0, 7))
        url = f"https://h{host}.org/{'ab'[rng.integers(0, 2)]}/{rng.integers(0, 40):02d}"
        menu = [(f"Menu {host} {i}", page_text.OUTSIDE) for i in range(3)]
        named = [(f"Nav {host} {i}", page_text.FURNITURE) for i in range(2)]
        body = [f"Body {k} line {i} " + "word " * int(rng.integers(0, 9)) for i in range(4)] + [f"Quoted by many on {host}"]
        foot = [(f"Seen {k} times", page_text.FURNITURE), (f"Made by {host}", page_text.OUTSIDE)]
        kind = k % 3
        main = [(x.strip(), page_text.INSIDE if kind == 0 else page_text.OUTSIDE) for x in body]
        teaser = [(f"More {k}", page_text.INSIDE)] if kind == 1 else []
        own = menu + named + main + teaser + foot
        tag = {page_text.OUTSIDE: "div", page_text.INSIDE: "article", page_text.FURNITURE: "footer"}
        html = "<body>" + "".join(f"<{tag[z]}>{x}</{tag[z]}>" for x, z in own) + "</body>"
        assert page_text.lines(html) == own
        pages.append((k, url, own))
        table.append((k, url, html))
    spark.createDataFrame(table, "page_id long, url string, html string").repartition(4).write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r.text for r in page_text.query(spark, str(tmp_path)).collect()}
    want = brute_pages(pages)
    assert got == want
    alone = {k: "\n\n".join(own[i][0] for i in page_text.kept_lines([z for _, z in own], [len(x) for x, _ in own], ())) for k, _, own in pages}
    assert sum(got[k] != alone[k] for k in got) > 60  # differencing decides


# --- 7
def brute_links(table, least=0.98):
    def fine(r):
        return r[0] is not None and r[2] is not None and r[1] and all(v is not None and np.isfinite(v) for v in r[1]) and any(r[1])

    good = [k for k, r in enumerate(table) if fine(r)]
    near = {k: set() for k in range(len(table))}
    for a in good:
        for b in good:
            if a < b and table[a][2] == table[b][2] and len(table[a][1]) == len(table[b][1]):
                x, y = (np.array(table[k][1], np.float64) for k in (a, b))
                if x @ y >= least * np.sqrt((x @ x) * (y @ y)):
                    near[a].add(b)
                    near[b].add(a)
    out, part = [], {}
    for k in range(len(table)):
        if k not in part:
            todo, group = [k], {k}
            while todo:
                for b in near[todo.pop()] - group:
                    group.add(b)
                    todo.append(b)
            least_id = min((table[g][0] for g in group), key=lambda v: (v is None, v))
            part |= dict.fromkeys(group, least_id)
        out.append((table[k][0], len(near[k]), part[k], part[k] == table[k][0]))
    return sorted(out, key=str)


def vectors(dim=64, seed=3):
    rng = np.random.default_rng(seed)
    table = []
    for c in range(60):
        center = rng.standard_normal(dim)
        center /= np.linalg.norm(center)
        for _ in range(rng.integers(1, 8)):
            noise = rng.standard_normal(dim)
            v = center + noise / np.linalg.norm(noise) * 0.09
            table.append((len(table), (v * rng.uniform(0.1, 9)).astype(np.float32).tolist(), int(c % 3)))
    return table


def test_links_like_brute_force(spark):
    table = vectors()
    odd = [None, [], [0.0] * 64, [float("nan")] * 64, [float("inf")] + [0.0] * 63, [None] + [1.0] * 63]
    table += [(1000 + k, v, 1) for k, v in enumerate(odd)] + [(1100, table[0][1], None), (None, table[0][1], 0), (1101, table[0][1], 0), (1102, table[0][1], 0), (1102, table[0][1], 0), (1103, [1.0, 2.0], 0), (1104, [2.0, 4.0], 0)]
    df = spark.createDataFrame(table, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 as n_links").repartition(3)
    want = brute_links(table)
    assert sum(w[1] for w in want) > 300
    got = rows(vector_links.links(df))
    assert got == want
    assert rows(vector_links.links(df, vector_links.Plan(block=4))) == want
    assert rows(vector_links.links(df.limit(0))) == []


def test_recall_at_the_threshold(spark):
    """Pairs right above the least cosine, the hardest: at least 0.95 of them are found, and nothing below it."""
    rng = np.random.default_rng(9)
    table = []
    for k in range(600):
        x, y = rng.standard_normal((2, 64))
        x /= np.linalg.norm(x)
        y -= (y @ x) * x
        y /= np.linalg.norm(y)
        c = 0.9801 if k < 400 else 0.9799
        table += [(2 * k, x.tolist(), 0), (2 * k + 1, (c * x + np.sqrt(1 - c * c) * y).tolist(), 0)]
    df = spark.createDataFrame(table, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.n_links for r in vector_links.links(df).collect()}
    assert sum(got[2 * k] for k in range(400)) >= 0.98 * 400 and sum(got[2 * k] for k in range(400, 600)) == 0


def test_links_of_other_label_types(spark):
    """Labels are compared as they are: 1.2 and 1.7 are unlike, "a" and "a" alike."""
    a, b = [1.0] * 8, [1.0] * 7 + [1.001]
    for kind, values in (("double", (1.2, 1.7, 1.2)), ("string", ("a", "b", "a"))):
        df = spark.createDataFrame([(1, a, values[0]), (2, b, values[1]), (3, b, values[2])], f"vec_id long, embedding array<float>, label {kind}")
        got = {r.vec_id: (r.n_links, r.component_id) for r in vector_links.links(df).collect()}
        assert got == {1: (1, 1), 2: (0, 2), 3: (1, 1)}


def test_plan_grows_with_the_largest_label():
    small, large = vector_links.Plan.sized(100), vector_links.Plan.sized(10**9)
    assert small.cuts < large.cuts and small.tables < large.tables <= 100


def test_collisions_like_counting_all():
    rng = np.random.default_rng(4)
    tile, values = np.sort(rng.integers(0, 9, 120)), rng.standard_normal((120, 6))
    want = {(i, j) for i in range(120) for j in range(i + 1, 120) if tile[i] == tile[j] and (np.abs(values[i] - values[j]) <= 0.9).sum() >= 4}
    got = [tuple(sorted(p)) for i, j in vector_links.collisions(tile, values, 0.9, 4, most=50) for p in zip(i.tolist(), j.tolist(), strict=True)]
    assert len(got) == len(set(got)) and set(got) == want and want


def test_a_class_name_alone_deletes_no_article(spark):
    """A body whose classes also name furniture is the neighbour's to judge: what both pages have goes, what outweighs the teaser stays."""
    page = lambda own: f"<main><p>short teaser</p></main><div class='ad-free promo-notice article-body'><p>Read our terms here</p><p>{own}</p></div><div class='comments'><p>{own} {own} said a reader</p></div>"
    bodies = [" ".join(f"w{(k * 7 + i * i) % 97}" for i in range(30)) for k in range(3)]
    df = spark.createDataFrame([(k, f"http://h.org/a/{k}", page(b)) for k, b in enumerate(bodies)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in page_text.extract(df).collect()}
    assert got == {k: f"short teaser\n\n{b}" for k, b in enumerate(bodies)}
