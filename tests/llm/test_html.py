import random

from pyspark.sql import types as T

from stratalog.llm import html_extract as h

PAGE = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()), T.StructField("text", T.StringType())])


def blocks(page):
    _, found, named = h.blocks_of(page)
    return [t for k, t, _ in found if h.covered(k, named) is None]


def test_blocks_entities_and_unclosed_elements():
    page = (
        "<!doctype html><html><head><title>x</title><style>p{}</style></head><body><nav><ul><li>menu</ul></nav>"
        "<div class='ad banner'>buy</div><article><h1>A &amp; B</h1><p><b>One<br>two <i>thr</i>ee\n\n four<p>Five &lt;tag&gt; &#233;&nbsp;x"
        "<ul><li>a<li>b <em>c</em></ul>tail<!-- no --><script>var t='</p>';</script><aside>side</aside></article>"
        "<footer>&copy; me</footer><div id=comments><p>first!</p></div></body></html>"
    )
    assert blocks(page) == ["A & B", "One two three four", "Five <tag> é x", "a", "b c", "tail"]


def test_odd_pages():
    assert blocks(None) == [] and blocks("") == [] and blocks("<nav>x</nav>") == []
    assert blocks("just text") == ["just text"]
    assert blocks("<p>cut off in a tag <a href='x") == ["cut off in a tag"]
    assert blocks("<p>cut &am") == ["cut &am"]
    assert blocks("</p></div><p>a</p></table>b") == ["a", "b"]
    assert blocks("<table><tr><td>1<td>2<tr><td>3</table>") == ["1", "2", "3"]
    assert blocks("<div>" * 3000 + "deep" + "</div>" * 3000) == ["deep"]
    assert blocks("<header>top</header><main><header><h2>Title</h2></header><p>x</p><form>f</form></main>") == ["Title", "x"]


def test_broken_pages_take_linear_time():
    assert blocks("<a '" * 200_000) == [] and blocks("<p>x<a '>'" * 1) == ["x"]
    assert blocks("<p>it's <b class='x'>fine</b> isn't it") == ["it's fine isn't it"]
    assert blocks("<a title=\"x>text</a> more") == ["text more"]
    assert len(blocks("<a '>' b='" * 100_000)) <= 1
    assert len(blocks("<b>" * 50_000 + "</x>" * 50_000 + "<div>" * 50_000 + "<li>x" * 1000)) == 1000


def test_names_of_furniture():
    for name in ("ad", "ad-slot", "adbox", "adBox2", "comments", "comment-list", "reader-reply", "respond", "site-footer", "cookie_notice", "x sidebar"):
        assert h.is_furniture_name(name), name
    for name in ("post-content has-sidebar", "share-price-report", "related-work", "comments-on-the-treaty", "notice-period", "widget-review", "article-body", "adder"):
        assert not h.is_furniture_name(name), name
    assert blocks("<div class='post-content has-sidebar'><p>kept <math>x<mi>y</mi></math> <button>so</button></p></div><div id=respond>gone</div>") == ["kept xy so"]


def brute_match(a, b, i=0, j=0):
    """Size of the largest matching of two trees by plain recursion."""
    if a.tags[i] != b.tags[j]:
        return 0

    def children(x, y):
        if not x or not y:
            return 0
        return max(children(x[1:], y), children(x, y[1:]), children(x[1:], y[1:]) + brute_match(a, b, x[0], y[0]))

    return 1 + children(a.children[i], b.children[j])


def well_formed(a, b, pairs):
    """Equal tags, parents paired with parents, order kept."""
    parent = lambda t: {c: p for p, cs in enumerate(t.children) for c in cs}
    pa, pb = parent(a), parent(b)
    assert all(a.tags[x] == b.tags[y] and pairs.get(pa.get(x)) == pb.get(y) for x, y in pairs.items() if x)
    ordered = [y for _, y in sorted(pairs.items())]
    assert ordered == sorted(set(ordered))


def test_tree_matching_is_largest(monkeypatch):
    rng = random.Random(2)

    def shape(depth):
        return "".join(f"({rng.choice('pdl')}{shape(depth - 1) if depth else ''})" for _ in range(rng.randint(0, 3)))

    for cells in (h.CELLS, 2):
        monkeypatch.setattr(h, "CELLS", cells)
        for _ in range(60):
            a, b = (h.Tree(f"(#root{shape(2)})") for _ in range(2))
            size, pairs = h.match(a, b)
            assert size == brute_match(a, b) == len(pairs)
            well_formed(a, b, pairs)


def test_wide_and_deep_trees():
    rng = random.Random(7)
    kinds, sizes = ("(p)", "(p(b))", "(div(p)(p))"), {("(p)", "(p(b))"): 1, ("(p(b))", "(p)"): 1}
    left, right = ([rng.choice(kinds) for _ in range(n)] for n in (700, 1002))
    best = [0] * (len(right) + 1)
    for x in left:
        above = best
        best = [0]
        for j, y in enumerate(right):
            gain = x.count("(") if x == y else sizes.get((x, y), 0)
            best.append(max(above[j + 1], best[j], above[j] + gain))
    a, b = h.Tree("(#root" + "".join(left) + ")"), h.Tree("(#root" + "".join(right) + ")")
    size, pairs = h.match(a, b)
    assert size == len(pairs) == 1 + best[-1]
    well_formed(a, b, pairs)
    deep = h.Tree("(#root" + "(div" * 5000 + ")" * 5001), h.Tree("(#root" + "(div" * 4990 + "(p)" + ")" * 4991)
    assert h.match(*deep)[0] == 4991


def texts_of(spark, rows):
    frame = spark.createDataFrame([(i, u, t, None) for i, (u, t) in enumerate(rows)], PAGE)
    return [r.text for r in h.extract(frame).orderBy("page_id").collect()]


def test_what_a_host_tells(spark):
    words = lambda *key: " ".join(f"w{hash((k, *key)) % 997}" for k in range(40))
    page = (
        "<body><div><a href=/a>Home</a> <a href=/b>{3}</a></div><div class=widget><h1>T{0}</h1><p>{1}</p><p>{2}</p><p>Read our paper</p></div>"
        "<div>see also story {4}</div><div class='comment-list'><p>{2} no</p></div><div class=blurb>own words {0}</div></body>"
    ).format
    rows = [(f"https://a.example/{i}", page(i, words(i, 1), words(i, 2), f"menu {i}", i % 3)) for i in range(12)]
    got = texts_of(spark, rows)
    # the menu is all links, "see also" recurs, "Read our paper" is constant, comments have their name; the main node's name is no matter
    assert got == [f"T{i}\n\n{words(i, 1)}\n\n{words(i, 2)}\n\nown words {i}" for i in range(12)]
    alone = texts_of(spark, rows[:1])[0]
    assert "T0" in alone and words(0, 2) + " no" not in alone


def test_deep_wide_and_broken_pages_of_one_host(spark):
    rows = [(f"http://b.example/{i}", "<div>" * (1200 + i) + f"deep {i}") for i in range(6)]
    rows += [(f"http://b.example/w{i}", "".join(f"<p>{i} {j}</p>" for j in range(1000 + i)) + "<div>the notice</div>") for i in range(6)]
    rows += [("http://b.example/x", "<p>fine</p>" + "<a '" * 250_000)]
    got = texts_of(spark, rows)
    assert got[:6] == [f"deep {i}" for i in range(6)] and got[12] == "fine"
    assert all(t == "\n\n".join(f"{i} {j}" for j in range(1000 + i)) for i, t in enumerate(got[6:12]))


def test_template_of_a_host_is_dropped(spark):
    page = "<body><div><p>Site notice number one</p></div><div><h1>T{0}</h1><p>text {0} a</p><p>text {0} b</p></div><p>All rights</p></body>".format
    rows = [(i, f"https://Host.example/{i}", page(i), "x") for i in range(8)]
    rows += [(100 + i, "https://copy.example/", page("same"), None) for i in range(8)]  # copies of one page: nothing is template
    rows += [(200, None, None, None), (201, "http://[bad", "<p>alone</p>", None), (None, "https://host.example/x", page(99), None), (3, "https://host.example/3", page(3), None)]
    rows += [(300, "https://host.example/long", "<p>" + "word " * 100_000 + "</p>" * 5, None)]
    got = {}
    for r in h.extract(spark.createDataFrame(rows, PAGE)).collect():
        got.setdefault(r.page_id, []).append(r.text)
    assert got[0] == ["T0\n\ntext 0 a\n\ntext 0 b"] and got[3] == ["T3\n\ntext 3 a\n\ntext 3 b"] * 2
    assert got[None] == ["T99\n\ntext 99 a\n\ntext 99 b"]
    assert got[100] == ["Site notice number one\n\nTsame\n\ntext same a\n\ntext same b\n\nAll rights"]
    assert got[200] == [""] and got[201] == ["alone"] and len(got[300][0]) == 5 * 100_000 - 1
    assert h.extract(spark.createDataFrame([], PAGE)).count() == 0
