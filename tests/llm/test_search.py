"""Near duplicates, neighbours, toxicity, pages and chats on small inputs."""

import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Row
from pyspark.sql import types as T

from revgrain.llm import ann, chat, graph, html_template, minhash, toxicity
from tests.llm import brute


def test_near_duplicates(docs):
    draw = random.Random(2)
    words = [f"w{i}" for i in range(3_000)]
    rows, i = [], 0
    for n in (30, 80, 200):
        base = draw.choices(words, k=n)
        for _ in range(25):  # a crowd around one text, some links just above the bound, some below
            copy = list(base)
            for at in draw.sample(range(n), draw.choice([0, 0, 1, 1, 2, max(1, n // 80), n // 30])):
                copy[at] = draw.choice(words)
            i += 1
            rows.append((i, " ".join(copy)))
    passage = " ".join(draw.choices(words, k=60))
    rows += [(200 + k, passage + " " + " ".join(draw.choices(words, k=draw.randrange(1, 60)))) for k in range(40)]
    rows += [(300, None), (301, ""), (302, "one two"), (303, "ONE\ttwo "), (304, "one two three"), (305, "a " * 3_000), (306, "a " * 9_000)]
    got = {r.id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs(rows)).collect()}
    assert got == brute.near(rows)
    again = minhash.near_duplicates(docs([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, "x")])).collect()
    assert sorted(map(tuple, again), key=repr) == sorted([(1, 2, 1, True), (1, 2, 1, True), (None, 2, 1, False), (None, 1, None, True)], key=repr)
    assert minhash.near_duplicates(docs([])).count() == 0


def test_rows_that_share_an_id(docs):
    """Rows of one id with unlike texts are documents of their own, each compared with all others."""
    random.seed(8)
    base = [" ".join(random.choices("abcdefghijklmnopqrstuvwxyz", k=60)) for _ in range(6)]
    near = lambda t, n: t + f" q{n}"
    rows = [(3, base[0]), (5, near(base[0], 1)), (5, base[1]), (7, near(base[1], 2)), (3, base[2]), (9, near(base[2], 3)), (3, near(base[0], 4)), (None, base[0]), (11, base[3]), (11, base[4]), (12, ""), (12, "  ")]
    flat = dict(enumerate(rows))
    groups = brute.near([(n, t) for n, (i, t) in flat.items() if i is not None])
    want = []
    for n, (i, t) in flat.items():
        if i is not None:
            least = min(flat[m][0] for m, (_, c) in groups.items() if c == groups[n][1])
            want.append((i, groups[n][0], least, i == least))
    want.append((None, groups[0][0], 3, False))
    got = minhash.near_duplicates(docs(rows)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    stay = minhash.keep_one(docs(rows))
    assert stay.columns == docs(rows).columns
    kept = {(r.doc_id, r.text) for r in stay.collect()}
    for c in {c for _, c in groups.values()}:
        members = [n for n, (_, x) in groups.items() if x == c]
        least = min(flat[n][0] for n in members)
        inside = [flat[n] for n in members if flat[n] in kept]
        assert len(inside) == 1 and inside[0][0] == least
    assert (5, base[1]) in kept and (None, base[0]) in kept and len(kept) == len({c for _, c in groups.values()}) + 1


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 60)] + [(100, k) for k in range(101, 140)] + [(7, 7)]
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 1 for k in range(1, 61)}, **{k: 100 for k in range(100, 140)}}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_neighbours(spark):
    draw = np.random.default_rng(3)
    x = draw.normal(size=(1_500, 16)) * draw.uniform(0.5, 2, size=(1_500, 1))
    x[100:400] = x[100]  # a crowd of equal vectors
    rows = [(i, [float(v) for v in a]) for i, a in enumerate(x)] + [(5_000, None), (5_020, [0.0] * 16), (5_040, [float("nan")] * 16), (5_060, [None] * 16), (5_080, [1.0, 2.0]), (5_100, [float("inf")] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'x' as id", "'y' as class", "'z' as key")
    got: dict = {}
    for r in ann.nearest(df, df.filter("vec_id % 20 = 0"), 10).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id, r.score))
    found = 0
    assert set(got) == {i for i in range(0, 1_500, 20)}
    for q, answers in got.items():
        answers.sort()
        s = x @ x[q]
        s[q] = -np.inf
        assert [a[0] for a in answers] == list(range(1, 11)) and q not in {a[1] for a in answers}
        assert all(abs(a[2] - s[a[1]]) < 1e-9 for a in answers)
        assert all((-a[2], a[1]) < (-b[2], b[1]) for a, b in zip(answers, answers[1:]))
        found += len({a[1] for a in answers} & set(np.lexsort((np.arange(1_500), -s.round(9)))[:10].tolist()))
    assert found >= 0.9 * 10 * len(got)
    few = df.filter("vec_id < 3")
    assert ann.nearest(few, few.filter("vec_id = 0"), 10).count() == 2
    assert ann.nearest(df.filter("vec_id < 0"), df, 10).count() == 0


def test_segments_are_the_maximal_ones():
    draw = random.Random(9)

    def slowly(scores, low, high):
        """Maximal segments by their definition: the best one, then the same on either side of it."""
        best = max(((sum(scores[a:b]), -(b - a), -a) for a in range(low, high) for b in range(a + 1, high + 1)), default=(0, 0, 0))
        if best[0] <= 0:
            return []
        a, b = -best[2], -best[2] - best[1]
        return slowly(scores, low, a) + [(best[0], a, b)] + slowly(scores, b, high)

    for _ in range(200):
        scores = [draw.choice([-4, -3, -1, 2, 3, 5]) + draw.random() / 100 for _ in range(draw.randrange(14))]
        at = [k for k, s in enumerate(scores) if s > 0]
        got = toxicity.segments([scores[k] for k in at], [sum(scores[:k]) for k in at])
        want = slowly(scores, 0, len(scores))
        assert [(at[a], at[b] + 1) for _, a, b in got] == [(a, b) for _, a, b in want]
        assert np.allclose([g[0] for g in got], [w[0] for w in want])


def test_no_labelled_text_is_left_out(spark):
    """Words count once a class and least shingle hash, but every text's words count: against sets in plain Python."""
    base = "one two three four five six seven eight nine ten"
    texts = [(f"{base} own{chr(97 + i)} {'again ' * i}", i % 2) for i in range(8)] + [("", 0), ("Short", 1), ("short short", 1), ("12 34", 0)]
    kin = toxicity.kin_of(pa.array([t for t, _ in texts])).to_pylist()
    seen = {(k, y, w) for k, (t, y) in zip(kin, texts) for w in re.findall(r"[^\W\d_]+", t.lower())}
    want = {w: (sum(y for _, y, v in seen if v == w), sum(1 - y for _, y, v in seen if v == w)) for _, _, w in seen}
    got = {r.word: (r.y1, r.y0) for r in toxicity.word_counts(spark.createDataFrame(texts, "text string, toxic int")).collect()}
    assert got == want and {f"own{c}" for c in "abcdefgh"} <= {*got}
    units = {}
    for r in toxicity.unit_rows(spark.createDataFrame([("abcdefg", 1, 0), ("abc", 1, 0)], "word string, y1 long, y0 long")).collect():
        units.setdefault(r.word, []).append((r.place, r.unit))
    assert {w: [u for _, u in sorted(v)] for w, v in units.items()} == {w: toxicity.units_of(w) for w in units}


def test_toxicity(spark, docs):
    draw = random.Random(10)
    words = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "ne") for b in ("ra", "to", "su") for c in ("ba", "di", "fo", "gu")]
    rows, labels = [], []
    for i in range(900):
        text, bad = draw.choices(words, k=draw.randrange(20, 200)), i % 6 == 0
        for _ in range(draw.randrange(1, 4) * bad):
            text.insert(draw.randrange(len(text)), draw.choice(["zorbig", "Quexle!", "vratzen", "vratzel"]))
        rows.append((i, " ".join(text)))
        labels.append((i, int(bad) if i % 10 else None))
    rows += [(2_000, None), (2_001, ""), (2_002, "zorbig " + "kara " * 9_000), (2_002, "kara")]
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    table = docs(rows)
    model = toxicity.fit(table, known, fit_on=lambda i: i % 4 != 2)
    got = [(r.doc_id, r.s) for r in table.select("doc_id", toxicity.score_of(model)("text").alias("s")).collect()]
    assert len(got) == len(rows) and all(0 <= s <= 1 for _, s in got)
    held = {i: s for i, s in got if i < 900 and i % 4 == 2}
    assert sum((s >= 0.3) == (i % 6 == 0) for i, s in held.items()) >= 0.97 * len(held)
    assert dict(got)[2_000] == dict(got)[2_001] < 0.3
    spots = toxicity.toxic_passages(table.filter("doc_id = 0"), model).collect()
    first = rows[0][1].lower().replace("!", "").split()
    assert spots and all(first[r.first_word][:4] in ("zorb", "quex", "vrat") for r in spots)
    blank = toxicity.fit(table, known.filter("toxic = 0"))
    assert blank["units"] == {} and toxicity.fit(docs([]), known)["units"] == {}


PAGE = """<!DOCTYPE html><html><head><title>T {n}</title><script>var a="<p>no</p>";</script></head><body><header class=top>Site name</header><nav><ul><li><a href="/">Home</a></ul></nav>
<div class="cookie-notice">We use cookies</div><article><h1>Title {n}</h1><p>First&nbsp;part &lt;{n}&gt; &amp; <b>bold</b><br>next.<p>Second<!-- c --> part {n}</p><aside>Related {n}</aside>
<form><input>Name {n}<button>Send</button></form><p>Share this page</p><section class="comments"><p>Nice {n}!</p></section></article><div id=sidebar>Popular {n}</div><footer>&copy; Us</footer></body></html>"""


def test_pages(spark):
    rows = [(i, f"http://Host.example/{i}", PAGE.format(n=i)) for i in range(12)]
    rows += [(50, "http://h2.example/", PAGE.format(n=50)), (50, "http://h2.example/", PAGE.format(n=50)), (51, None, None), (52, "x", ""), (53, None, "plain &lt; text"), (54, "http://h3.example/", "<p>open <!-- never closed")]
    rows += [(60 + i, "http://noarticle.example/", f"<body><div class=menu><a href=a>Menu</a></div><div class=c><p>Body text number {i} runs on.</p></div><div>Contact us</div></body>") for i in range(3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as host", "'y' as id", "'z' as classes")
    got = {r.id: r.text for r in html_template.extract(pages).collect()}
    for i in range(12):  # what every page of a host says is the template's, also inside the article
        assert got[i] == f"Title {i}\nFirst part <{i}> & bold next.\nSecond part {i}"
    assert got[50] == "Title 50\nFirst part <50> & bold next.\nSecond part 50\nShare this page"
    assert (got[51], got[52], got[53], got[54]) == ("", "", "plain < text", "open")
    assert [got[60 + i] for i in range(3)] == [f"Body text number {i} runs on." for i in range(3)]
    assert html_template.extract(pages).count() == len(rows) and html_template.extract(pages.filter("page_id < 0")).count() == 0


def test_reply_trees(spark):
    say = [(1, 1, None, "user", "root", 0.0), (1, 2, 1, "assistant", "bad", 0.1), (1, 3, 1, "assistant", "good", 0.9), (1, 4, 3, "user", "<|im_end|> more", 0.5), (1, 5, 99, "user", "orphan", 0.2)]
    say += [(2, k, k - 1 if k > 1 else None, "user" if k % 2 else "assistant", None if k == 3 else f"t{k}", None) for k in range(1, 41)]
    say += [(3, 1, 2, "user", "cycle", 0.0), (3, 2, 1, "user", "cycle", 0.0), (3, 3, 1, "user", "leaf of a cycle", 0.0)]
    df = spark.createDataFrame(say, "tree long, node long, parent long, role string, text string, score double")
    paths: dict = {}
    for r in chat.root_paths(df).collect():
        paths.setdefault((r.tree, r.leaf), []).append((r.above, r.node))
    assert {k: [n for _, n in sorted(v)] for k, v in paths.items()} == {(1, 2): [2, 1], (1, 4): [4, 3, 1], (1, 5): [5], (2, 40): list(range(40, 0, -1))}
    best = {(r.tree, r["rank"]): r for r in chat.format_paths(df, 2).selectExpr("*").withColumn("turns", chat.parse(chat.F.col("formatted"))).withColumn("learnt", chat.loss_texts(chat.F.col("formatted"), chat.F.col("loss"))).collect()}
    assert [(t.role, t.text) for t in best[1, 1].turns] == [("user", "root"), ("assistant", "good"), ("user", "<|im_end|> more")]
    assert best[1, 1].learnt == ["good"] and best[1, 1].formatted.count("<|im_end|>") == 3
    assert len(best[2, 1].turns) == 40 and best[2, 1].turns[2].text == "" and (3, 1) not in best
    assert [t.text for t in best[1, 2].turns] == ["orphan"]


def test_chats_survive_control_strings(spark):
    draw = random.Random(12)
    parts = ["<|im_start|>", "<|im_end|>", "<|", "<\\|", "\\", "<", "|", "\n", "é🙂", "assistant", ""]
    rows = [(c, t, draw.choice(["user", "assistant", "a<|\nb\\n"]), "".join(draw.choices(parts, k=5))) for c in range(40) for t in range(4)]
    rows += [(None, 0, None, None), (None, 1, "user", "same"), (None, 1, "user", "same"), (77, None, "assistant", "x" * 100_000)]
    df = spark.createDataFrame(rows, T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))
    out = chat.write_chats(chat.threads(df.selectExpr("*", "'x' as tree", "'y' as node")))
    out = out.withColumn("turns", chat.parse(chat.F.col("formatted"))).withColumn("learnt", chat.loss_texts(chat.F.col("formatted"), chat.F.col("loss")))
    want: dict = {}
    for c, t, r, x in rows:
        want.setdefault(c, []).append((t if t is not None else -1, r or "", x or ""))
    got = {r.tree.id: r for r in out.collect()}
    assert set(got) == set(want)
    for c, turns in want.items():
        turns.sort()
        assert [(t.role, t.text) for t in got[c].turns] == [(r, x) for _, r, x in turns]
        assert got[c].learnt == [x for _, r, x in turns if r == "assistant"]
    assert chat.write_chats(chat.threads(df.filter("turn > 99"))).count() == 0
    assert isinstance(got[None], Row) and pa.__version__


def test_names_of_page_and_article(spark):
    read = html_template.main_text
    body = "<p>Whole text.</p><section class=comments><article class=comment>Nice!</article></section>"
    for page in ("single right-sidebar", "cookie-consent-on"):
        assert read(f"<html class={page.split()[0]}-banner><body class='{page}'><article>{body}</article><div class=sidebar>Popular</div></body></html>") == "Whole text."
    for open_, close in (("<main class='no-sidebar'>", "</main>"), ("<article class='post comments-open'>", "</article>"), ("<main><article id=notice-1>", "</article></main>"), ("<div class='has-sidebar'><div role=main class=ads-on>", "</div></div>")):
        assert read(f"<body><div class=ad>Buy</div>{open_}{body}{close}<div class=related><article>Other</article></div>") == "Whole text.", open_
    # What holds the article isn't beside it; articles in containers beside it stay out.
    assert read(f"<div class='page sidebar-right'><div class=related><article>Other text, and longer than the article</article></div><main>{body}</main></div><div>Us</div>") == "Whole text."
    assert read("<div class='page sidebar-right'><div><p>Whole text.</p></div><div class=sidebar><p>Popular</p></div></div>") == "Whole text."
    assert read("<div class=related><article>Other</article></div><div><p>Text of a page without an article.</p></div>") == "Text of a page without an article."
    assert read("<article><p>Mine.</p><article class='comment'>Nice!</article></article>") == "Mine."
    assert read("<div class=menu><a href=a>Menu</a></div>") == ""


def test_template_text_in_articles(spark):
    def texts(*pages):
        rows = [(i, "http://h.example/", f"<body><nav><a href=x>Home</a></nav>{html}</body>") for i, html in enumerate(pages)]
        return [r.text for r in html_template.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("id").collect()]

    # Near copies of one article keep all of it, however many pages they are; so do articles that share most of their text.
    copies = [f"<div class=ad>Ad {k}</div><article><p>One article.</p><p>Its second part.</p></article>" for k in range(12)]
    assert texts(*copies) == ["One article.\nIts second part."] * 12 and texts(*copies[:2]) == ["One article.\nIts second part."] * 2
    close = [f"<article><p>A long passage that all of the pages have.</p><p>Part {k}.</p></article>" for k in range(12)]
    assert texts(*close) == [f"A long passage that all of the pages have.\nPart {k}." for k in range(12)]
    bare = [f"<div class=ad>Ad {k}</div><div><p>One text.</p><p>No article element.</p></div>" for k in range(9)]
    assert texts(*bare) == ["One text.\nNo article element."] * 9
    # What little all different articles share is the template's, with few pages as with many.
    for n in (2, 7, 8):
        pages = [f"<article><p>This is the only text of page {k}.</p><p>Share this</p></article>" for k in range(n)]
        assert texts(*pages, pages[0] + "<p>Ad</p>") == [f"This is the only text of page {k}." for k in [*range(n), 0]]
