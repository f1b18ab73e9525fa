"""Main text of pages, and the pipeline on a small fixture."""

import pytest
from helpers import plain_words, prose, table

from segflow.llm import pages
from segflow.llm.pages import Page

CASES = [
    ("<body><div class='cookie-notice'>We use</div><form><main><header><h1>A &amp; B</h1></header><p>x <b>y</b>z<p>q<ul><li>1<li>2</ul><aside>no</aside><div id=comments><p>c1</div></main></form><footer>f</footer>", "A & B\n\nx yz\n\nq\n\n1\n\n2"),
    ("<div><p>a<br>b</p> tail <span class=ad>AD</span> more</div><!-- c", "a b\n\ntail\n\nmore"),
    ("plain < text & more", "plain < text & more"),
    ("", ""),
    ("<article><p>one</article><article class=comment>two</article>", "one"),
    ("<p>x<script>var a='</p>'</script>y<style>p</style>", "xy"),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a\n\nb\n\nc"),
    ("<div class='layout has-sidebar'><p>kept</p><div class='left sidebar'>gone</div><p class='ad-free'>too</p></div>", "kept\n\ntoo"),
    ("<p>&#65;&eacute;&nbsp;b\n\t c</p>", "Aé b c"),
]


@pytest.mark.parametrize("source, text", CASES)
def test_text_of_a_page(source, text):
    assert Page(source).text(set()) == text


def site(k):
    return f"<html><body><div><b>Site of many pages</b></div><div><p>{prose(k, 30)}</p></div><div>All rights kept</div></body></html>"


def test_recurring_subtrees_go(spark):
    rows = [(k, f"http://a.example/{k}", site(k)) for k in range(40)] + [(100, "http://b.example/", site(100)), (101, None, None), (102, "x", "")]
    rows += [(103, "http://a.example/x", site(3)), (3, "http://a.example/3", site(3))]
    frame = spark.createDataFrame([(*r, None) for r in rows], "page_id long, url string, html string, host string")
    out = pages.main_text(frame).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r["n_chars"] == len(r["text"])
        if r["page_id"] < 40:
            assert r["text"] == prose(r["page_id"], 30)
    by_id = {r["page_id"]: r["text"] for r in out}
    assert by_id[100].startswith("Site of many pages") and by_id[101] == by_id[102] == "" and by_id[103] == prose(3, 30)
    assert pages.main_text(frame.limit(0)).collect() == []


def test_copied_articles_stay(spark):
    source = "<body><nav>Home</nav><article><h1>T</h1><p>The same text.</p></article></body>"
    frame = spark.createDataFrame([(k, "http://a.example/", source) for k in range(50)], "page_id long, url string, html string")
    assert {r["text"] for r in pages.main_text(frame).collect()} == {"T\n\nThe same text."}


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    item = prose(77, 30)
    rows, labels = [], []
    for i in range(300):
        words = prose(3000 + i, 80).split()
        if i % 6 == 0:
            words[3], words[40], words[60] = "badone", "badtwo", "badthree"
        if i % 50 == 7:
            words[10:10] = item.split()
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(i % 6 == 0)))
    rows += [(400, rows[1][1]), (401, rows[2][1].replace("w1", "x1", 1)), (402, prose(9, 20) + " " + " ".join(rows[3][1].split()[5:70])), (403, None), (404, "")]
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()} if name != "packing" else docs.collect()
    toxic = {i for i in range(0, 300, 6)}
    assert set(kept["toxicity"]) == {d for d, _ in rows} - toxic
    assert set(kept["near_dedup"]) == set(kept["toxicity"]) - {400, 401}
    assert set(kept["substring_dedup"]) == set(kept["near_dedup"]) and plain_words(kept["substring_dedup"][402]) == plain_words(prose(9, 20))
    leaked = {i for i in range(7, 300, 50)} - toxic
    assert set(kept["decontamination"]) == set(kept["near_dedup"]) - leaked
    assert {r["doc_id"] for r in kept["packing"]} == set(kept["decontamination"])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(kept["packing"])
