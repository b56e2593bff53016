"""Pages, vectors, registered queries and the pipeline."""

import collections
import random

import duckdb
import numpy as np
import pytest

from repolens.llm import html_text, topk
from repolens.llm.queries import ORACLES, QUERIES
from tests.conftest import SF001

from .helpers import clashing, frame, odd_rows

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<header><p>Site name</p></header><nav><ul><li><a href="/a">{menu}</a></li></ul></nav><!-- x > y --><div class="ad">Buy</div>
<article><h1>Head &amp; more</h1><p>First <b>bold</b>
 line&nbsp;&eacute;.<p>Second<br>line</p><ul><li>one</li><li>two</li></ul><form><input>Mail</form></article>
<section id="comments"><p>Nice</p></section><aside>Side</aside><footer>&copy; us</footer>"""
TEXT = "Head & more\nFirst bold line é.\nSecond line\none\ntwo"


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_extract(spark):
    plain = "<html><body><div><p>{0}</p></div><div><p>Top line</p><p>body {0}</p><p>Bottom line</p></div></body></html>"
    given = [(1, "http://h.org/a/1", PAGE.format(menu="x")), (2, "http://h.org/a/2", PAGE.format(menu="y")),
             (2, "http://h.org/a/2", PAGE.format(menu="y")), (3, None, None), (4, "", ""), (None, "nonsense", "just text"),
             (5, "http://p.org/x/1", plain.format("eins")), (6, "http://p.org/x/2", plain.format("zwei")),
             (7, "http://p.org/x/3", plain.format("drei")), (8, "http://q.org/", "<p>unclosed <div>" * 3000),
             (9, "http://r.org/1", "<p>" + "long " * 200_000)]
    out = {(r["page_id"], r["url"]): r for r in html_text.extract(clashing(pages(spark, given))).collect()}
    assert out[1, "http://h.org/a/1"]["text"] == TEXT and out[2, "http://h.org/a/2"]["n_chars"] == len(TEXT)
    assert out[3, None]["text"] == "" and out[4, ""]["n_chars"] == 0 and out[None, "nonsense"]["text"] == "just text"
    # no article: lines that the neighbour by URL shares are template
    assert out[5, "http://p.org/x/1"]["text"] == "eins\nbody eins" and out[7, "http://p.org/x/3"]["text"] == "drei\nbody drei"
    assert out[9, "http://r.org/1"]["n_chars"] == 5 * 200_000 - 1
    assert html_text.extract(pages(spark, given)).count() == len(given)
    assert html_text.extract(pages(spark, [])).count() == 0


def test_copies_of_an_article_keep_their_text(spark):
    given = [(i, f"http://h.org/a/{i}", PAGE.format(menu=i)) for i in range(6)]
    assert {r["text"] for r in html_text.extract(pages(spark, given)).collect()} == {TEXT}


DIVS = "<div><p>Menu</p><p>Login</p></div><div>{}</div><div><p>Imprint of the site</p></div>"


def div_page(*lines):
    return DIVS.format("".join(f"<p>{x}</p>" for x in lines))


@pytest.mark.parametrize("run_part", [1024, 2])  # a run in one part, in several
def test_copies_and_near_copies_without_article(spark, run_part, monkeypatch):
    monkeypatch.setattr(html_text, "RUN_PART", run_part)
    body = [f"paragraph {i} of the copied story" for i in range(6)]
    story = "\n".join(body)
    given = [(0, "http://c.org/a", div_page("before them", "all"))]
    given += [(i, f"http://c.org/b/{i}", div_page(*body)) for i in range(1, 6)]  # exact copies
    given += [(i, f"http://c.org/c/{i}", div_page(f"Date {i}", *body)) for i in range(6, 13)]  # near copies
    given += [(13, "http://c.org/d", div_page("after them", "all the same")), (14, "http://c.org/z", div_page(*body))]
    given += [(20 + i, f"http://o.org/{i}", div_page(f"Date {i}", *body)) for i in range(2)]  # nothing but near copies
    given += [(30, "http://e.org/1", div_page(*body)), (31, "http://e.org/2", ""), (32, "http://e.org/3", div_page("other"))]
    out = {r["page_id"]: r["text"] for r in html_text.extract(pages(spark, given)).collect()}
    assert out[0] == "before them\nall" and out[13] == "after them\nall the same"
    assert {out[i] for i in (1, 2, 3, 4, 5, 14)} == {story}
    assert [out[i] for i in range(6, 13)] == [f"Date {i}\n{story}" for i in range(6, 13)]
    assert all(out[20 + i] == f"Menu\nLogin\nDate {i}\n{story}\nImprint of the site" for i in range(2))
    assert out[30] == story and out[31] == "" and out[32] == "other"


def test_articles_of_the_driver_pages(spark):
    import html
    import re

    table = spark.read.parquet(f"{SF001}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html_text.extract(table).collect()}
    for r in table.collect():
        body = r["html"].split("<article>")[1].split("</article>")[0]
        lines = [" ".join(html.unescape(re.sub("</?(b|br)>", " ", x)).split()) for x in re.split("</?(?:p|h1)>", body)]
        assert got[r["page_id"]] == "\n".join(x for x in lines if x)


def test_longest_common_subsequence():
    rng = random.Random(3)
    for _ in range(500):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(12))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        found = html_text.shared_lines(a, b)
        rest = iter(b)
        assert len(found) == best[-1][-1] and all(a[i] in rest for i in found)


def test_names_that_tell_of_others_are_no_menus():
    page = '<div class="content has-sidebar"><p>Stay</p><div class="site-footer"><p>Go</p></div></div>'
    assert html_text.main_text(html_text.page_lines(page), set()) == "Stay"


@pytest.mark.parametrize("page,text", [
    ('<article><p class="notice">x<p>real<p>more</article>', "real\nmore"),
    ('<article><p class="notice">x<div>real</div>more</article>', "real\nmore"),
    ('<article><p class="notice">x <i class="ad">y<hr>real</article>', "real"),
    ('<article><ul><li class="ad">x<li>one<ul><li class="ad"><p>y<li>two</ul><li>three</ul></article>', "one\ntwo\nthree"),
    ('<article><ul><li class="ad">x<ul><li>y</li></ul>z</li><li>one</li></ul></article>', "one"),
    ('<article><dl><dt class="notice">x<dd>one<dd class="notice">y<dt>two</dl></article>', "one\ntwo"),
    ('<article><table><tr class="ad"><td>x<td>y<tr><td class="ad">z<td>one<tbody><tr><th>two</table></article>', "one\ntwo"),
    ('<article><table><tr><td class="ad"><table><tr><td>x</td></tr></table>y<td>one</table></article>', "one")])
def test_marked_elements_end_without_end_tag(page, text):
    assert html_text.main_text(html_text.page_lines(page), set()) == text


def plain_top(vectors, every, k):
    usable = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in vectors
              if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in usable if i % every == 0}):
        query = min(v for i, v in usable if i == q)
        scores = sorted((-sum(a * b for a, b in zip(query, v)), i) for i, v in usable if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    return sorted(out)


@pytest.mark.parametrize("block_rows,query_rows", [(4096, 4096), (7, 2)])
def test_top_k(spark, block_rows, query_rows):
    rng = np.random.default_rng(6)
    given = [(int(i), [float(np.float32(x)) for x in rng.normal(0, 0.3, 8).round(1)]) for i in range(60)]  # many ties
    given += [(70, None), (71, []), (72, [1.0, None] + [0.0] * 6), (75, [float("nan")] * 8), (80, [float("inf")] + [0.0] * 7),
              (None, [0.1] * 8), (90, [0.0] * 8), (91, [1e6] * 8), (92, [0.5, -0.5])]
    df = clashing(spark.createDataFrame(given, "vec_id long, embedding array<float>"))
    got = sorted(map(tuple, topk.top_k(df, every=10, block_rows=block_rows, query_rows=query_rows).collect()))
    assert got == plain_top(given, 10, 5)


def test_top_k_of_few_rows(spark):
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [2.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, topk.top_k(few).collect())) == [(0, 1, 1, 256 * 512), (0, 2, 2, 256 * 512)]
    assert topk.top_k(few.filter("vec_id = 0")).count() == 0 and topk.top_k(few.filter("false")).count() == 0


def test_bounds_hold_every_score():
    rng = np.random.default_rng(8)
    vectors, queries = (rng.integers(-200, 200, (n, 16)).astype(float) for n in (300, 20))
    upper, lower = topk.Cells(vectors, 4).bounds(queries)
    exact = vectors @ queries.T
    assert (lower <= exact).all() and (exact <= upper).all()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_registered_query(spark, name):
    df = QUERIES[name](spark, SF001)
    table = "pages" if name.startswith("op2_") else "embeddings" if name.startswith("op6_") else "documents"
    have = spark.read.parquet(f"{SF001}/{table}.parquet").count()
    if not name.startswith(("op5_", "op6_")):
        assert df.count() == have
    if name in ORACLES:
        con = duckdb.connect()
        for t in ("documents", "embeddings"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
        want = con.execute(ORACLES[name]).fetchall()
        names = [d[0] for d in con.description]
        assert collections.Counter(map(tuple, df.select(*names).collect())) == collections.Counter(want)


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as P

    assert [n for n, _ in P.STAGES] == ["toxicity", "line_dedup", "simhash_dedup", "source_mix", "best_fit_packing"]
    docs = clashing(frame(spark, odd_rows()))
    before = docs.columns
    for i, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, SF001)
        out.write.parquet(f"{tmp_path}/{i}")
        out = spark.read.parquet(f"{tmp_path}/{i}")
        if i < len(P.STAGES) - 1:
            assert out.columns == before, name
        if name == "simhash_dedup":
            assert out.count() == out.select("doc_id", "text").distinct().count() <= docs.count()
        docs = out
    assert docs.count() > 0
    empty = frame(spark, [])
    for name, stage in P.STAGES:
        assert stage(spark, empty, SF001).count() == 0, name


def test_pipeline_runs_over_the_table(spark):
    import corpus_pipeline as P

    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF001}/labels.parquet").collect()}
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    kept = P.drop_toxic(spark, docs, SF001)
    clean = [r["doc_id"] for r in docs.collect() if labels.get(r["doc_id"]) == 0]
    stay = {r["doc_id"] for r in kept.collect()}
    assert sum(i in stay for i in clean) >= 0.95 * len(clean)
    out = P.run(spark, SF001)
    assert out.count() > 0 and out.groupBy("sequence_id").sum("length").agg({"sum(length)": "max"}).first()[0] <= 2048
