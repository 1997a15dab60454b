"""Packages by their relationships, versions of the store, ranks, ranges and runs."""

from __future__ import annotations

import io
import os
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from leafmill.operators import levels, split, stats
from leafmill.plans import retrieve
from leafmill.sources import adapters, store

R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def package(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


def rels(**targets):
    return "<Relationships>" + "".join(f'<Relationship Id="{k}" Target="{v}"/>' for k, v in targets.items()) + "</Relationships>"


def test_slides_in_the_order_of_the_presentation():
    slide = '<s xmlns:a="a"><sp><ph type="title"/><a:p><a:t>{}</a:t></a:p></sp></s>'
    deck = package({
        "ppt/presentation.xml": f'<p xmlns:r="{R}"><sldIdLst><sldId id="9" r:id="r2"/><sldId id="8" r:id="r1"/></sldIdLst></p>',
        "ppt/_rels/presentation.xml.rels": rels(r1="slides/slide1.xml", r2="slides/slide2.xml"),
        "ppt/slides/slide1.xml": slide.format("one"), "ppt/slides/slide2.xml": slide.format("two"),
    })
    assert adapters.pptx_to_markdown(deck).split() == ["#", "two", "#", "one"]


def test_sheet_names_by_relationship():
    sheet = '<w><sheetData><row><c r="A1" t="inlineStr"><is><t>{}</t></is></c></row></sheetData></w>'
    book = package({
        "xl/workbook.xml": f'<w xmlns:r="{R}"><sheets><sheet name="B" r:id="x"/><sheet name="A" r:id="y"/></sheets></w>',
        "xl/_rels/workbook.xml.rels": rels(x="worksheets/sheet2.xml", y="/xl/worksheets/sheet1.xml"),
        "xl/worksheets/sheet1.xml": sheet.format("in a"), "xl/worksheets/sheet2.xml": sheet.format("in b"),
    })
    assert adapters.xlsx_sheets(book) == [("B", [["in b"]]), ("A", [["in a"]])]


def test_headings_by_style_name_and_no_table_text():
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    p = '<w:p><w:pPr><w:pStyle w:val="{}"/></w:pPr><w:r><w:t>{}</w:t></w:r></w:p>'
    text = package({
        "word/document.xml": f'<w:document xmlns:w="{w}"><w:body>{p.format("berschrift2", "Titel")}{p.format("x", "Absatz")}<w:tbl>{p.format("x", "Zelle")}</w:tbl></w:body></w:document>',
        "word/styles.xml": f'<w:styles xmlns:w="{w}"><w:style w:styleId="berschrift2"><w:name w:val="heading 2"/></w:style></w:styles>',
    })
    assert adapters.docx_to_markdown(text) == "## Titel\nAbsatz"


def test_latest_version(spark, tmp_path):
    at = f"{tmp_path}/store"
    for v in (1, 2, 10):
        store.save(spark.range(v), at, "node", v)
    assert store.latest(spark, at, "node").count() == 10
    os.remove(f"{at}/node/version=10/_SUCCESS")  # a writer that didn't finish
    assert store.latest(spark, at, "node").count() == 2
    with pytest.raises(FileNotFoundError):
        store.latest(spark, at, "other")
    cache = spark.range(5).withColumnRenamed("id", "doc_id")
    assert store.invalidate(cache, cache.filter("doc_id > 2")).count() == 3


def test_rank_without_labels(spark):
    values = [random.Random(1).randrange(-50, 900) for _ in range(700)]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    got = stats.nearest_rank(df, "v", (0, 50, 99, 100)).first()
    assert tuple(got) == tuple(sorted(values)[min(700 * p // 100, 699)] for p in (0, 50, 99, 100))


def test_page_ranges_of_any_length(spark):
    nodes = spark.createDataFrame([(1, 5, 9, "x"), (2, None, None, "x"), (3, 70, 80, "x"), (4, 5, 9, "")], "n int, start_index int, end_index int, text string")
    hits = lambda pages: [r.n for r in retrieve.on_pages(nodes, pages).collect()]
    assert hits("6-2000000000") == [1, 3] and hits("0") == [2] and hits("9-6,70") == [3] and hits("10-69") == []


def test_deep_outline_entry_ends_at_the_next_one(spark):
    toc = spark.createDataFrame([(1, 1, 1, "a", 1), (1, 2, 8, "b", 2), (1, 3, 8, "c", 5), (1, 4, 2, "d", 9)], "doc_id long, i int, level int, title string, page int")
    totals = spark.createDataFrame([(1, 20)], "doc_id long, total_pages int")
    assert [r.stop for r in levels.outline_extents(toc, totals).orderBy("i").collect()] == [21, 5, 9, 21]


def test_increasing_run_against_all_subsequences():
    from itertools import combinations

    r = random.Random(2)
    for _ in range(300):
        v = [r.randrange(5) for _ in range(r.randrange(9))]
        runs = [c for n in range(len(v) + 1) for c in combinations(range(len(v)), n) if all(v[a] < v[b] for a, b in zip(c, c[1:]))]
        longest = max(map(len, runs))
        got = split.increasing_run(v)
        assert tuple(got) in runs and len(got) == longest


def test_search_by_model_survives_failures(spark):
    docs = spark.createDataFrame([(1, "a", "s"), (2, "b", "s"), (3, "c", "s")], "doc_id long, doc_name string, summary string")
    nodes = spark.createDataFrame([(1, "n1", 0, "t", "x"), (2, "n1", 0, "boom", "y")], "doc_id long, node_id string, ord int, title string, text string")
    flats = spark.createDataFrame([(3, "flat text")], "doc_id long, content string")

    def client(prompt):
        if "boom" in prompt:
            raise RuntimeError("no")
        return "```json\n[9, 3, 2, 1]\n```" if prompt.startswith("documents") else '["n1", "n7"]'

    got = {r.doc_id: (r.pos, r.content, r.error) for r in retrieve.search_by_model(docs, nodes, flats, "q", client).collect()}
    assert got == {3: (1, "flat text", None), 2: (2, None, "RuntimeError: no"), 1: (3, "x", None)}
    none = retrieve.search_by_model(docs, nodes, flats, "q", lambda p: "[]" if p.startswith("documents") else "not json")
    assert {r.doc_id: r.error is None for r in none.collect()} == {1: False, 2: False, 3: True}


def test_oversized_leaves_by_brute_force():
    """Cuts of a leaf: the text comes back whole, segments begin at their ordinals, and each is cut again while it is too long."""
    r = random.Random(5)
    for _ in range(60):
        numbers = [r.randrange(1, 9) for _ in range(r.randrange(0, 8))]
        text = "".join(f"Article ({n}) " + "x" * r.randrange(0, 60) + "\n" for n in numbers)
        got = split.split_leaf("n", text, 80, 3, 10)
        assert "".join(g[4] for g in got) == text
        runs = split.increasing_run(numbers)
        firsts = [g for g in got if g[3] == 1]
        if len(text) > 80 and len(runs) >= 3:
            assert len(firsts) == len(runs) and all(g[4].startswith(f"Article ({numbers[k]})") for g, k in zip(firsts, runs))
            assert [g[0] for g in firsts] == [f"n-s{k}" for k in range(len(runs))] and {g[1] for g in firsts} == {"n"}
        else:
            assert got == [("n", None, "", 0, text)]
