"""Queries over whole documents and all rows: the registered SQL with its cut taken out, or brute force."""

from __future__ import annotations

from test_oracle import duck, rows  # noqa: F401

from leafmill.plans.queries import ORACLES, QUERIES


def equals(spark, sf_dir, duck, name, cut, whole):  # noqa: F811
    got, want = QUERIES[name](spark, sf_dir), duck.sql(ORACLES[name].replace(cut, whole))
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())


def inner(name):
    """The function of carriers that a query was registered with."""
    q = QUERIES[name]
    return dict(zip(q.__code__.co_freevars, q.__closure__, strict=True))["f"].cell_contents


def test_without_text_keeps_all_nodes(spark):
    n = 10_050
    lines = spark.range(n).selectExpr("0L AS doc_id", "cast(id AS int) AS k1", "0 AS k2", "concat(if(id = 0, '# ', '## '), 'N', id) AS line")
    assert inner("flt_02_without_text")(lines).count() == n


def test_reassembled_whole_texts(spark, sf_dir, duck):  # noqa: F811
    equals(spark, sf_dir, duck, "tree_17_reassembled", "left(text, 300)", "text")


def test_split_covers_whole_texts(spark, sf_dir):
    from pyspark.sql import functions as F

    from leafmill.plans.tree_queries import legal

    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert legal(d).agg(F.sum(F.length("text"))).first()[0] > d.agg(F.sum(F.length("text"))).first()[0]


def test_frontmatter_of_whole_texts(spark, sf_dir, duck):  # noqa: F811
    equals(spark, sf_dir, duck, "flt_09_frontmatter", "left(text, 300)", "text")


def test_search_reads_flat_documents(spark):
    c = spark.createDataFrame([(k, 0, "user", t) for k, t in enumerate(["that of the", "none", "of it"])], "conv_id long, turn int, role string, text string")
    t = spark.createDataFrame([(0, f"n{k}", k, "t", x) for k, x in enumerate(["of", "the that", "x"])], "doc_id long, node_id string, ord int, title string, text string")
    long = "word " * 300 + "the of"
    d = spark.createDataFrame([(0, long), (1, "zzz"), (2, "of that the " + long)], "doc_id long, text string")
    got = [tuple(r) for r in inner("ret_07_lexical")(c, t, d).orderBy("pos").collect()]
    # By the words found, then by id: conv0 (3), doc2 (3), doc0 (2), conv2 (1, no nodes).
    assert got == [(0, "conv0", 1, "the that\n\nof"), (5, "doc2", 2, "of that the " + long), (1, "doc0", 3, long)]


def test_stored_bodies_are_whole(spark, sf_dir, duck):  # noqa: F811
    for name in ("src_04_load_document", "src_06_read_through"):
        equals(spark, sf_dir, duck, name, "left(text, 20)", "text")


def test_content_class_of_any_line(spark):
    import duckdb

    texts = ["4763047826333361 Of the\nnext", "1) one\n2) two", "# Title", "٣ drei", "a | b\n--- | ---\n1 | 2", "", "   ", "plain"]
    d = [(3 * k + r, t) for k, t in enumerate(texts) for r in range(3)]
    got = inner("agg_09_content_class")(spark.createDataFrame(d, "doc_id long, text string")).collect()
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?)", d)
    want = c.sql(ORACLES["agg_09_content_class"]).fetchall()
    assert sorted(map(tuple, got)) == sorted(want)
