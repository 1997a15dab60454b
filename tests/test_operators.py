"""Literal cases and properties of single operators."""

from __future__ import annotations

import io
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leafmill.functions import text as T
from leafmill.operators import flat, gate, levels, nodes, split
from leafmill.operators.lines import explode_lines, headings, implode_lines
from leafmill.plans import retrieve
from leafmill.sources import adapters, store
from leafmill.streaming import jobs


def column(spark, f, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[0] for r in df.select(f(F.col("x")).alias("y"), "i").orderBy("i").collect()]


def test_labels(spark):
    cases = {
        "A.1.1": ["A", "1", "1"], "A1-6.1": ["A", "1", "6", "1"], "A(GB)-1": ["A", "GB", "1"], "Abschnitt A1": ["A", "1"], "Teil A": ["A"],
        "Versicherte Personen": [], "T e i l   A": ["A"], "المادة ٩": ["9"], "المادة (٩)": ["9"], "3.1 Zweck": ["3", "1"], "": [], "A.1.2.3.4.5.6.7.8.9": [],
    }
    assert column(spark, T.label, list(cases)) == list(cases.values())


def test_numbering_depths(spark):
    cases = {"الباب الأول": 1, "المادة 5": 2, "مادة": 2, "Abschnitt A1": 2, "Teil A": 1, "anhang": 1, "A1-6": 3, "A1-6.1 x": 4, "A.1.1": 3, "§3.1.2": 3, "3.1": 2, "A": None, "Prosa": None}
    assert column(spark, T.numbering_depth, list(cases)) == list(cases.values())


def test_unspace_and_atoms(spark):
    assert column(spark, T.unspace, ["T e i l   A", "Teil A", "A 1 - 6 . 1", "a b c"]) == ["Teil A", "Teil A", "A1-6.1", "a b c"]
    assert column(spark, T.label_atoms, ["A(GB)1", "A1", "B-4x"]) == [["A", "GB", "1"], ["A", "1"], ["B", "4", "x"]]


def test_dashes_leave_other_marks(spark):
    assert column(spark, T.normalize_dashes, ["a‐b‑c–d—e−f", "‒―"]) == ["a-b-c-d-e-f", "‒―"]


def test_title_matches(spark):
    df = spark.createDataFrame([("abcdefgh", "xabcdefghy", True), ("abc", "abc", True), ("abc", "xabc", False), ("", "", False)], "a string, b string, w boolean")
    assert all(r[0] == r[1] for r in df.select(T.same_title(F.col("a"), F.col("b")), "w").collect())


def test_ocr_languages(spark):
    cases = {"مرحبا بكم": ["ara"], "مرحبا بكم hello": ["ara", "eng"], "Größe": ["deu", "eng"], "plain text": ["eng"], "": ["deu", "eng"], " 12 ": ["deu", "eng"], None: ["deu", "eng"]}
    assert column(spark, T.ocr_languages, list(cases)) == list(cases.values())


def test_pipe_cells(spark):
    assert column(spark, T.pipe_cells, ["| a | b |", "a|b", "|", "| a \\| b |"]) == [["a", "b"], ["a", "b"], [""], ["a \\", "b"]]
    assert column(spark, T.is_separator_row, ["|---|:-:|", "---", "| - | |", "| a | - |"]) == [True, False, False, False]


def md(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id int, md string")


def test_tree(spark):
    d = md(spark, "# a\nx\n```\n# no\n```\n### b\n## c\n### d\n# e", "", "no heading", None)
    got = {(r.doc_id, r.title): (r.parent_ord, r.depth, r.text) for r in nodes.build_nodes(d).collect()}
    assert got == {
        (0, "a"): (None, 1, "# a\nx\n```\n# no\n```\n"), (0, "b"): (1, 2, "### b\n"), (0, "c"): (1, 2, "## c\n"), (0, "d"): (3, 3, "### d\n"), (0, "e"): (None, 1, "# e"),
    }


def stack_tree(levels_):
    out, stack = [], []
    for i, k in enumerate(levels_, 1):
        while stack and stack[-1][1] >= k:
            stack.pop()
        out.append((stack[-1][0] if stack else None, len(stack) + 1))
        stack.append((i, k))
    return out


def test_tree_equals_level_stack(spark):
    import random

    rng = random.Random(3)
    cases = [[rng.randint(1, 6) for _ in range(rng.randint(1, 12))] for _ in range(300)]
    df = spark.createDataFrame([(d, i, k) for d, c in enumerate(cases) for i, k in enumerate(c, 1)], "doc_id int, ord int, level int")
    got = {(r.doc_id, r.ord): (r.parent_ord, r.depth) for r in nodes.link(df).collect()}
    assert got == {(d, i): x for d, c in enumerate(cases) for i, x in enumerate(stack_tree(c), 1)}


def test_lines_round_trip(spark):
    texts = ["a\n\nb\n", "", "\n", "x"]
    got = {r.doc_id: r.md for r in implode_lines(explode_lines(md(spark, *texts))).collect()}
    assert got == dict(enumerate(texts))


def test_relevel(spark):
    d = md(spark, "## a\ntext # no\n### b", "# a", "no")
    assert [r[0] for r in d.select(levels.relevel(F.col("md"))).collect()] == ["# a\ntext # no\n## b", "# a", "no"]


def test_relevel_long_documents(spark):
    import re
    import time

    odd = ["## a", "###", "## ", "### b\r", "x\u2028### c", "#######  d", "###### e", " ## f", "text", "", "##\tg", "#"]
    long = "\n".join(["## top"] + [f"### Heading {k}\nbody" for k in range(40_000)])
    for md in ("\n".join(odd[:-1]), "\n".join(odd), long):
        marks = [len(m) for m in re.findall(r"(?:^|(?<=[\n\r\u2028]))(#{1,6})(?=\s)", md)]
        shift = min(marks) - 1
        want = "\n".join(x[shift:] if re.match(r"#{1,6}(?=[ \t\r])", x) else x for x in md.split("\n"))
        d = spark.createDataFrame([(md,)], "md string")
        began = time.time()
        assert d.select(levels.relevel(F.col("md"))).first()[0] == want
        assert time.time() - began < 30  # the shift once a document; once a line takes minutes


def test_recovery_chain(spark):
    d = md(spark, "# A\nx\n# A.1\n# A.1.1 t\n# B", "# Teil A\n# Abschnitt A1\n# A1-6", "# Prosa\n# Noch mehr")
    got = {r.doc_id: [line for line in r.md.split("\n") if line.startswith("#")] for r in levels.recover_depth(d).collect()}
    assert got[0] == ["# A", "## A.1", "### A.1.1 t", "# B"]
    assert got[2] == ["# Prosa", "# Noch mehr"]
    assert max(len(x.split(" ")[0]) for x in got[1]) >= 2


def test_outline_injects_and_nests(spark):
    d = md(spark, "# Frage eins\na\n# Frage zwei\nb", "# Allein\nx")
    pages = spark.createDataFrame([(0, "frageeins", 1, 3), (0, "fragezwei", 1, 4), (1, "allein", 1, 9)], "doc_id int, key string, k int, page int")
    toc = spark.createDataFrame([(0, 0, 1, "Kapitel  Eins", 3), (0, 1, 1, "Anhang", 9)], "doc_id int, i int, level int, title string, page int")
    totals = spark.createDataFrame([(0, 10), (1, 10)], "doc_id int, total_pages int")
    got = {r.doc_id: r.md for r in levels.relevel_by_outline(d, pages, toc, totals).collect()}
    assert got[0] == "# Kapitel Eins\n## Frage eins\na\n## Frage zwei\nb"
    assert got[1] == "# Allein\nx"


def test_gate(spark):
    d = md(spark, "# a", "# a\n# b\n# c", "# a\n## b\u0000\n## c", "# a\n## b\n## c", "none")
    got = {r.doc_id: r.reason for r in gate.verdict(nodes.build_nodes(d), d).collect()}
    assert got == {0: "node_count<3", 1: "depth<2", 2: "garbling", 3: "", 4: "node_count<3"}


def test_block_machine():
    roles = lambda t: [(b["role"], b["text"] or b["rows"]) for b in flat.parse_blocks(t)]
    assert roles("# T #\n1.1 eins\nwort\nwort2\n\n| a | b |\n|---|---|\n| 1 | 2 |\nende") == [
        ("title", "T"), ("kv", "1.1 eins"), ("prose", "wort wort2"), ("table", [["a", "b"], ["1", "2"]]), ("prose", "ende"),
    ]
    assert roles("|---|\n|---|\n|x|") == [("table", [["---"], ["x"]])]
    assert roles("---\n2024 was") == [("prose", "---"), ("kv", "2024 was")]
    assert roles(None) == roles("") == []


def test_stitch_leaves_others(spark):
    d = md(spark, "| k | 2019 |\n|---|---|\n| a | 1 |\n\n| 2020 | 2021 |\n|---|---|\n| 2 | 3 |\n\n| 2022 |\n|---|\n| 4 |\n| 5 |")
    r = flat.flat_documents(d).first()
    assert [(b.headers, b.rows) for b in r.blocks] == [
        (["k", "2019", "2020", "2021"], [["k", "2019", "2020", "2021"], ["a", "1", "2", "3"]]), (["2022"], [["2022"], ["4"], ["5"]]),
    ]
    assert r.content_class == "flat_table"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 3)), max_size=9))
def test_increasing_run(values):
    run = split.increasing_run(values)
    assert all(values[a] < values[b] for a, b in zip(run, run[1:], strict=False)) and run == sorted(run)
    best = 0
    for m in range(1 << len(values)):
        own = [values[i] for i in range(len(values)) if m >> i & 1]
        if all(a < b for a, b in zip(own, own[1:], strict=False)):
            best = max(best, len(own))
    assert len(run) == best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["Article (1) ", "Article 2 ", "§ 3 ", "المادة ٤ ", "فقرة ", "x" * 40, "ـ", "ﺍﳌﺎﺩﺓ 5 "]), max_size=40))
def test_split_reassembles(parts):
    text = "".join(parts)
    got = split.split_leaf("n", text, 100, 3, 50)
    assert "".join(x[4] for x in got) == text
    assert len({x[0] for x in got}) == len(got)


def test_split_leaf_cases():
    body = "pre " + "".join(f"Article {k} " + "t" * 60 for k in (1, 2, 1, 3))
    got = split.split_leaf("7", body, 100, 3, 5000)
    assert [x[0] for x in got] == ["7", "7-s0", "7-s1", "7-s2"]
    assert split.split_leaf("7", "Article 1 Article 2", 100, 3, 5000)[0][4] == "Article 1 Article 2"
    toc = "Title ........ 12\n" * 30 + "B" * 30
    assert len(split.split_leaf("7", toc, 100, 3, 5000)) == 1


def test_page_selector(spark):
    got = column(spark, retrieve.page_set, ["1,3-4", "4-2", " 7 ", "2,2-3"])
    assert got == [[1, 3, 4], [], [7], [2, 3]]
    with pytest.raises(Exception):
        column(spark, retrieve.page_set, ["a"])


def test_picks_fall_back_to_all(spark):
    docs = spark.createDataFrame([(1,), (2,)], "doc_id int")
    picks = spark.createDataFrame([(9, 1)], "doc_id int, pos int")
    assert {r.doc_id for r in retrieve.pick_in_order(docs, picks).collect()} == {1, 2}


def xlsx(rows):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns="m"><sheets><sheet name="S1"/></sheets></workbook>')
        cells = "".join(f"<row>{''.join(f'<c r="{chr(65 + i)}{n}" t="inlineStr"><is><t>{v}</t></is></c>' for i, v in enumerate(r) if v)}</row>" for n, r in enumerate(rows, 1))
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="m"><sheetData>{cells}</sheetData></worksheet>')
    return b.getvalue()


def office(name, xml):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr(name, xml)
    return b.getvalue()


def test_adapters():
    assert adapters.convert(xlsx([["k", "2019"], ["", ""], ["a|b", "1"]]), ".xlsx")[0] == "## S1\n\n| k | 2019 |\n| --- | --- |\n| a\\|b | 1 |\n"
    assert adapters.convert(xlsx([]), ".xlsx")[2] == "xlsx: the workbook is empty"
    docx = '<w:d xmlns:w="w"><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>A–B</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>x</w:t></w:r></w:p></w:d>'
    assert adapters.convert(office("word/document.xml", docx), ".docx")[0] == "## A-B\n\nx"
    pptx = '<p:s xmlns:p="p" xmlns:a="a"><p:sp><p:nvPr><p:ph type="title"/></p:nvPr><a:p><a:r><a:t>T</a:t></a:r></a:p></p:sp><p:sp><a:p><a:r><a:t>b</a:t></a:r></a:p></p:sp></p:s>'
    assert adapters.convert(office("ppt/slides/slide1.xml", pptx), ".pptx")[0] == "# T\nb\n"
    html = b"<h1>T</h1><script>no</script><p>a <b>c</b> <a href='u'>l</a></p><ul><li>x</li></ul><img src='i.png'>"
    assert adapters.convert(html, ".html")[0] == "# T\n\na **c** [l](u)\n\n  * x\n\n[Image: image]"
    assert adapters.convert(b"", ".pdf")[2] == "no converter for .pdf"
    assert adapters.convert(b"x", ".md", [("bad", lambda c: 1 / 0), ("good", lambda c: "ok")])[:2] == ("ok", "good")


def test_read_files_and_dedup(spark, tmp_path):
    for name, body in {"b.md": "# x", "a.TXT": "y", "c.exe": "z", "sub/d.html": "<p>q</p>"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(body)
    files = store.read_files(spark, str(tmp_path))
    assert {r.filename for r in files.collect()} == {"b.md", "a.TXT", "d.html"}
    assert [r.md for r in adapters.to_markdown(files.filter("ext = '.html'")).collect()] == ["q"]
    assert [r.filename for r in store.scan_folder(spark, str(tmp_path)).collect()] == sorted(["a.TXT", "b.md", "d.html"])


def test_save_and_erase(spark, tmp_path):
    ids = spark.createDataFrame([(1,)], "doc_id int")
    own = spark.createDataFrame([(1, "a.md"), (2, "b.md")], "doc_id int, filename string")
    tables = {k: own for k in ("uploads", "tree", "flat", "meta", "cache")} | {"hash": own.select("filename")}
    out = store.erase(tables, ids)
    assert [r.target for r in out["audit"].orderBy("step").collect()] == ["uploads", "tree", "flat", "meta", "cache", "hash"]
    path = store.save(out["tree"], str(tmp_path), "tree", 1)
    assert [r.doc_id for r in spark.read.parquet(path).collect()] == [2]
    again = store.erase({k: v for k, v in out.items() if k != "audit"}, ids)
    assert sum(r.removed for r in again["audit"].collect()) == 0


def test_stream_equals_batch(spark, tmp_path):
    from leafmill.plans.carriers import carrier

    events = carrier(spark, "/root/testdata/sf0.001", "job_log")
    for k in range(3):
        events.filter(F.col("seq") % 3 == k).coalesce(1).write.parquet(str(tmp_path / "in" / f"k={k}"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 10).parquet(str(tmp_path / "in" / "*"))
    # Time-outs by processing time ask for a further batch for ever; without data none is run here.
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    q = jobs.job_stream(stream).writeStream.outputMode("update").format("memory").queryName("job_states").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = {r.job_id: r for r in spark.sql("SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY updated_at DESC) AS n FROM job_states").filter("n = 1").collect()}
    want = {r.job_id: r for r in jobs.job_states(events).collect()}
    assert got.keys() == want.keys()
    for k, w in want.items():
        assert (got[k].status, got[k].processing_started_at, got[k].attempts, got[k].updated_at) == (w.status, w.processing_started_at, w.attempts, w.updated_at)


def test_plans_stay_native(spark):
    d = md(spark, "# a\n## b")
    for df in (nodes.build_nodes(d), levels.relevel_by_containment(d), gate.verdict(nodes.build_nodes(d), d)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_keyed_filter_reaches_the_scan(spark, tmp_path):
    spark.createDataFrame([(1, "a", "t"), (2, "b", "u")], "doc_id int, title string, text string").write.parquet(str(tmp_path / "n"))
    plan = spark.read.parquet(str(tmp_path / "n")).filter("doc_id = 1").select("title")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(doc_id,1)" in plan and "text" not in plan.split("ReadSchema")[1]


def test_trees_need_one_exchange(spark):
    plan = nodes.build_nodes(md(spark, "# a\n## b"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(doc_id") == 1 and plan.count("Exchange") == 1


def test_percentiles_are_nearest_rank(spark):
    from leafmill.operators.stats import nearest_rank

    values = [5, 1, 1, 9, 7, 7, 7, 2, None]
    own = sorted(v for v in values if v is not None)
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 3)], "tool string, v int")
    got = {r.tool: (r.p50, r.p95, r.p99) for r in nearest_rank(df, "v", (50, 95, 99), "tool").collect()}
    assert got == {"a": tuple(own[min(len(own) * p // 100, len(own) - 1)] for p in (50, 95, 99)), "b": (3, 3, 3)}


def test_models_never_fail_a_row(spark):
    from leafmill.functions import models

    def broken(p):
        raise ValueError(p)

    df = spark.createDataFrame([("one. two",), (None,)], "p string")
    assert [r[0] for r in df.select(models.complete(F.col("p"))).collect()] == ["one", None]
    assert [r[0] for r in df.select(models.caption(F.col("p"), broken)).collect()] == ["image", None]


def test_outline_match_prefers_equal_then_short(spark):
    from leafmill.operators.outline import heading_pages, match_outline

    toc = spark.createDataFrame([(0, 1, 1, "Kapitel", 1), (0, 2, 2, "Der Umfang", 1), (0, 3, 2, "Los", 1)], "doc_id int, i int, level int, title string, page int")
    items = spark.createDataFrame([(0, 1, "1 Kapitel", 1), (0, 2, "Kapitel", 1), (0, 3, "Umfang", 1), (0, 4, "Endlos", 1)], "doc_id int, ord int, text string, page int")
    got = {r.i: (r.ord, r.parent) for r in match_outline(toc, items).collect()}
    assert got == {1: (2, None), 2: (3, 1), 3: (None, 1)}
    pages = heading_pages(items.withColumn("is_heading", F.lit(True)).union(items.withColumn("is_heading", F.lit(True)).withColumn("ord", F.col("ord") + 10)).select("doc_id", "ord", "is_heading", "text", "page"))
    assert pages.filter("key = 'kapitel'").count() == 2
