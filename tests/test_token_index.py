"""Searches with queries as a table against the same searches written into the plan."""

import random

import pytest

from revgrain.operators import matching, ranking, token_index

WORDS = ["Token", "token_id", "id", "->", "a.b", "Größe", "STRASSE", "ß", "def run", "(", "x", "toke", "zzz", "İx"]
QUERIES = {"q1": ["Token", "id"], "q2": ["->"], "q3": ["a.b", "", "a.b"], "q4": ["größe", "ß", "("], "q5": ["def run", "x"], "q6": ["nothing here"], "q7": [], "q8": ["toke", "Toke"], "q9": ["İx"]}


def make_lines(seed=4):
    random.seed(seed)
    rows = []
    for repo in ("r1", "r2"):
        for f in ("src/a.py", "tests/test_a.py", "docs/readme.md"):
            for n in range(1, 40):
                lead = random.choice(["", "  ", "# ", "import ", "def ", "class "])
                rows.append((repo, f, n, lead + random.choice(["", " "]).join(random.choices(WORDS, k=random.randint(0, 5)))))
    return [*rows, ("r1", "src/a.py", 100, None), ("r1", "src/a.py", 101, ""), ("r2", "src/a.py", 102, "x" * 300 + " Token")]


def tables(spark, rows):
    lines = spark.createDataFrame(rows, "repo string, path string, line_no int, line string")
    asked = spark.createDataFrame([(q, [*w, None]) for q, w in QUERIES.items()], "query_id string, words array<string>")
    return lines, asked


@pytest.mark.parametrize("few, broadcast", [(128, 200_000), (0, 0)])
def test_same_as_in_the_plan(spark, monkeypatch, few, broadcast):
    monkeypatch.setattr(matching, "FEW", few)
    monkeypatch.setattr(matching, "BROADCAST_KEYS", broadcast)
    lines, asked = tables(spark, make_lines())
    plain = {q: w for q, w in QUERIES.items() if w}
    got, want = [], []
    columns = ["query_id", "path", "line_no", "snippet", "file_type", "hit_type", "matched_terms", "score"]
    for repo in ("r1", "r2"):
        want += [(repo, *r) for r in ranking.search_hits(lines.where(f"repo = '{repo}'").drop("repo"), plain).select(*columns).collect()]
    got = [tuple(r) for r in token_index.search_hits(lines, asked, ["repo", "path"]).select("repo", *columns).collect()]
    assert len(got) > 100 and sorted(got) == sorted(want)


def test_ranks_of_each_repository(spark):
    lines, asked = tables(spark, make_lines(5))
    index = token_index.postings(lines, ["repo", "path"])
    got = {tuple(r) for r in token_index.search_topk(lines, asked, 2, ["repo", "path"], index=index).select("query_id", "repo", "path", "line_no", "score", "rank").collect()}
    want = set()
    for repo in ("r1", "r2"):
        rows = ranking.search_topk(lines.where(f"repo = '{repo}'").drop("repo"), {q: w for q, w in QUERIES.items() if w}, 2)
        want |= {(r.query_id, repo, r.path, r.line_no, r.score, r["rank"]) for r in rows.collect()}
    assert got == want and {r[-1] for r in got} == {1, 2}


def test_nothing_to_search(spark):
    lines, asked = tables(spark, [])
    assert token_index.search_topk(lines, asked, 5, ["repo", "path"]).count() == 0
    full, _ = tables(spark, make_lines())
    assert token_index.search_topk(full, asked.where("false"), 5, ["repo", "path"]).count() == 0
