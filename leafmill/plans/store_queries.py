"""Store, joins, aggregates, retrieval, jobs and observability over whole carriers, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import text as T
from leafmill.operators import flat, gate, levels, nodes, outline, stats
from leafmill.plans import retrieve
from leafmill.plans.registry import query
from leafmill.plans.scalar_queries import join
from leafmill.plans.tree_queries import BROKEN, GEO, MERGED, ROWS, SECTIONS, VERDICT, geo, outline_parts, pair, tables
from leafmill.sources import adapters, store
from leafmill.streaming import jobs

NOW = 1_000_000


# -- sources and sinks ---------------------------------------------------------------------------------
def artifacts(d: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    body = F.col("text").alias("body")
    trees = d.filter("doc_id % 3 = 0").select("doc_id", body)
    flats = d.filter("doc_id % 2 = 0").select("doc_id", body)
    cache = d.filter("doc_id % 5 = 0").select("doc_id", F.concat(F.lit("cached "), F.col("lang")).alias("body"), F.col("doc_id").alias("cached_at"))
    return cache, trees, flats


@query("src_04_load_document", "documents", "SELECT doc_id, NULL::VARCHAR AS error, text AS body FROM {documents} WHERE doc_id = 6")
def _(d: DataFrame) -> DataFrame:
    return store.load(artifacts(d)[1], 6).select("doc_id", "error", "body")


@query("src_05_missing_document", "documents", "SELECT doc_id, CASE WHEN doc_id IS NULL THEN 'Document not found: -5' END AS error FROM (SELECT doc_id FROM {documents} WHERE doc_id = 4 UNION ALL SELECT NULL)")
def _(d: DataFrame) -> DataFrame:
    flats = artifacts(d)[2]
    return store.load(flats, -5).unionByName(store.load(flats, 4)).select("doc_id", "error")


@query("src_06_read_through", "documents", """
SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'cached ' || lang ELSE text END AS body, CASE WHEN doc_id % 5 = 0 THEN 'cache' WHEN doc_id % 3 = 0 THEN 'tree' ELSE 'flat' END AS origin
FROM {documents} WHERE doc_id % 2 = 0 OR doc_id % 3 = 0 OR doc_id % 5 = 0""")
def _(d: DataFrame) -> DataFrame:
    return store.read_through(*artifacts(d))


@query("src_12_cache_ttl", "documents", """
SELECT doc_id, CASE WHEN doc_id % 5 = 0 AND doc_id >= 200 THEN 'cache' WHEN doc_id % 3 = 0 THEN 'tree' ELSE 'flat' END AS origin
FROM {documents} WHERE doc_id % 2 = 0 OR doc_id % 3 = 0 OR (doc_id % 5 = 0 AND doc_id >= 200)""")
def _(d: DataFrame) -> DataFrame:
    return store.read_through(*artifacts(d), now=F.lit(500), ttl=300).select("doc_id", "origin")


LISTING = """
SELECT doc_id, coalesce(doc_name, filename, doc_id) AS doc_name, coalesce(source_url, '') AS source_url, coalesce(processed_at, '') AS processed_at, content_class, key
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN kind = 'meta' THEN 0 ELSE 1 END, key) AS r FROM {objects} WHERE readable) WHERE r = 1"""


@query("src_07_list_documents", "objects", LISTING)
def _(o: DataFrame) -> DataFrame:
    return store.list_documents(o)


@query("join_12_priority", "objects", "SELECT doc_id, key FROM (" + LISTING + ")")
def _(o: DataFrame) -> DataFrame:
    return store.list_documents(o).select("doc_id", "key")


@query("src_08_hash_cache", "uploads", "SELECT filename, arg_max(sha256(text), doc_id) AS sha256 FROM {uploads} WHERE doc_id % 3 > 0 GROUP BY 1")
def _(u: DataFrame) -> DataFrame:
    return store.hash_cache(u.filter("doc_id % 3 > 0").select("filename", F.sha2("text", 256).alias("sha256"), F.col("doc_id").alias("upload")))


@query("src_09_staging_keys", "uploads", "SELECT doc_id, 'uploads/staging/' || CAST(doc_id AS VARCHAR) || '/' || filename AS key FROM {uploads}")
def _(u: DataFrame) -> DataFrame:
    return u.select("doc_id", store.staging_key(F.col("doc_id").cast("string"), F.concat(F.lit("/tmp/in/"), F.col("filename"))).alias("key"))


@query("src_11_outline_entries", "outline", """
SELECT doc_id, i, CAST(level AS INT) AS level, title, CAST(CASE WHEN i % 7 = 0 THEN 0 ELSE page END AS INT) AS page FROM {outline} WHERE doc_id IN (SELECT doc_id FROM {outline} GROUP BY 1 HAVING count(*) >= 2)""")
def _(o: DataFrame) -> DataFrame:
    return outline.read_outline(o.select("doc_id", "i", (F.col("level") - 1).alias("level"), "title", F.when(F.col("i") % 7 != 0, F.col("page") - 1).alias("page")))


@query("snk_03_sidecar", "objects", """
SELECT key, doc_id, coalesce(doc_name, '') AS doc_name, coalesce(source_url, '') AS source_url, coalesce(processed_at, '') AS processed_at, content_class FROM {objects}""")
def _(o: DataFrame) -> DataFrame:
    return store.sidecar(o.withColumn("doc_id", F.concat_ws("~", "doc_id", "key"))).select(
        F.split("doc_id", "~")[1].alias("key"), F.split("doc_id", "~")[0].alias("doc_id"), "doc_name", "source_url", "processed_at", "content_class"
    )


@query("snk_04_content_type", "uploads", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'application/pdf' ELSE 'application/octet-stream' END AS kind FROM {uploads}")
def _(u: DataFrame) -> DataFrame:
    name = F.when(F.col("doc_id") % 2 == 0, F.regexp_replace("filename", "md$", "PDF")).otherwise(F.col("filename"))
    return u.select("doc_id", store.content_type(name).alias("kind"))


@query("snk_05_upsert", "uploads", """
SELECT filename, coalesce(max(CASE WHEN doc_id % 2 = 0 THEN sha256(text) END), max(sha256(text))) AS sha256 FROM {uploads} GROUP BY 1""")
def _(u: DataFrame) -> DataFrame:
    h = lambda x: x.groupBy("filename").agg(F.max(F.sha2("text", 256)).alias("sha256"))
    return store.upsert(h(u), h(u.filter("doc_id % 2 = 0")), "filename")


@query("snk_06_missing_files", "uploads", "SELECT DISTINCT filename AS name FROM {uploads} WHERE filename NOT IN (SELECT filename FROM {uploads} WHERE doc_id % 4 = 0)")
def _(u: DataFrame) -> DataFrame:
    names = u.select(F.col("filename").alias("name"), "doc_id")
    return store.missing_files(names.select("name").distinct(), names.filter("doc_id % 4 = 0"))


def store_tables(d: DataFrame, u: DataFrame) -> dict[str, DataFrame]:
    cache, trees, flats = artifacts(d)
    return {"uploads": u.select("doc_id", "filename"), "tree": trees, "flat": flats, "meta": d.select("doc_id", "lang"), "cache": cache, "hash": u.groupBy("filename").agg(F.max("doc_id").alias("last"))}


@query("snk_07_erase", ("documents", "uploads"), """
SELECT 0 AS step, 'uploads' AS target, count(*) AS removed FROM {uploads} WHERE doc_id % 10 = 0 UNION ALL SELECT 1, 'tree', count(*) FROM {documents} WHERE doc_id % 30 = 0
UNION ALL SELECT 2, 'flat', count(*) FROM {documents} WHERE doc_id % 10 = 0 UNION ALL SELECT 3, 'meta', count(*) FROM {documents} WHERE doc_id % 10 = 0
UNION ALL SELECT 4, 'cache', count(*) FROM {documents} WHERE doc_id % 10 = 0 UNION ALL SELECT 5, 'hash', count(DISTINCT filename) FROM {uploads} WHERE doc_id % 10 = 0""")
def _(d: DataFrame, u: DataFrame) -> DataFrame:
    return store.erase(store_tables(d, u), d.filter("doc_id % 10 = 0").select("doc_id"))["audit"]


@query("snk_07_erased_hashes", ("documents", "uploads"), "SELECT filename, max(doc_id) AS last FROM {uploads} GROUP BY 1 HAVING NOT bool_or(doc_id % 10 = 0)")
def _(d: DataFrame, u: DataFrame) -> DataFrame:
    return store.erase(store_tables(d, u), d.filter("doc_id % 10 = 0").select("doc_id"))["hash"]


# -- joins ------------------------------------------------------------------------------------------------
KNOWN = """
u AS (SELECT doc_id, filename, sha256(text) AS sha256 FROM {uploads}
), hashes AS (SELECT DISTINCT filename, sha256 FROM u WHERE doc_id % 3 > 0
), listing AS (SELECT filename AS doc_name, lpad(CAST(doc_id AS VARCHAR), 9, '0') AS key, CAST(doc_id AS VARCHAR) AS doc_id FROM u WHERE doc_id % 2 = 0
), hits AS (SELECT u.filename, u.sha256, u.doc_id AS upload, arg_min(l.doc_id, l.key) AS doc_id FROM u JOIN listing l ON u.filename = l.doc_name
  WHERE EXISTS (SELECT 1 FROM hashes h WHERE h.filename = u.filename AND h.sha256 = u.sha256) GROUP BY ALL)"""


def dedup_inputs(u: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    up = u.select(F.col("doc_id").alias("upload"), "filename", F.sha2("text", 256).alias("sha256"))
    listing = u.filter("doc_id % 2 = 0").select(F.col("filename").alias("doc_name"), F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("key"), F.col("doc_id").cast("string").alias("doc_id"), F.lit(None).cast("string").alias("content_class"))
    return up, up.filter("upload % 3 > 0").select("filename", "sha256").distinct(), listing


@query("join_04_unchanged", "uploads", "WITH " + KNOWN.strip() + " SELECT filename, sha256, upload, doc_id FROM hits")
def _(u: DataFrame) -> DataFrame:
    return store.unchanged(*dedup_inputs(u)).drop("content_class")


@query("tree_20_changed", "uploads", "WITH " + KNOWN.strip() + " SELECT filename, sha256, doc_id AS upload FROM u WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.filename = u.filename AND h.sha256 = u.sha256)")
def _(u: DataFrame) -> DataFrame:
    return store.changed(*dedup_inputs(u))


def picks_of(t: DataFrame) -> DataFrame:
    """A model's picks: some ids twice, some that don't exist."""
    at = F.array(F.struct(F.lit(1).alias("pos"), F.lit("n2").alias("node_id")), F.struct(F.lit(2).alias("pos"), F.lit("n0").alias("node_id")), F.struct(F.lit(3).alias("pos"), F.lit("n2").alias("node_id")), F.struct(F.lit(4).alias("pos"), F.lit("n99").alias("node_id")))
    return t.select("doc_id").distinct().select("doc_id", F.inline(at))


PICKS = "picks AS (SELECT DISTINCT t.doc_id, p.pos, p.node_id FROM {turn_nodes} t, (VALUES (1, 'n2'), (2, 'n0'), (3, 'n2'), (4, 'n99')) AS p(pos, node_id))"


@query("join_01_ordered_picks", "conversations", """
WITH docs AS (SELECT DISTINCT conv_id AS doc_id FROM {conversations}), picks AS (SELECT conv_id * 2 AS doc_id, 1000 - turn AS pos FROM {conversations})
SELECT d.doc_id, CAST(min(pos) AS BIGINT) AS pos FROM docs d JOIN picks USING (doc_id) GROUP BY 1""")
def _(c: DataFrame) -> DataFrame:
    docs = c.select(F.col("conv_id").alias("doc_id")).distinct()
    picks = c.select((F.col("conv_id") * 2).alias("doc_id"), (F.lit(1000) - F.col("turn")).alias("pos"))
    return retrieve.pick_in_order(docs, picks).select("doc_id", "pos")


@query("join_02_texts_of_picks", "turn_nodes", "WITH " + PICKS + """
SELECT p.doc_id, string_agg(text, chr(10) || chr(10) ORDER BY p.pos, text) AS content FROM picks p JOIN {turn_nodes} t ON p.doc_id = t.doc_id AND p.node_id = t.node_id WHERE text <> '' GROUP BY 1""")
def _(t: DataFrame) -> DataFrame:
    return retrieve.texts_of_picks(t, picks_of(t))


@query("join_03_invented", "turn_nodes", "WITH " + PICKS + " SELECT doc_id, node_id, pos FROM picks p WHERE NOT EXISTS (SELECT 1 FROM {turn_nodes} t WHERE t.doc_id = p.doc_id AND t.node_id = p.node_id)")
def _(t: DataFrame) -> DataFrame:
    return retrieve.invented(t, picks_of(t)).select("doc_id", "node_id", "pos")


@query("join_09_zip_rows", "wide_tables", f"SELECT doc_id, 2 AS n_rows, data FROM (SELECT doc_id, {MERGED} FROM {{wide_tables}})")
def _(t: DataFrame) -> DataFrame:
    m = pair(t).select("doc_id", flat.merge_tables(F.col("a"), F.col("b"))["rows"].alias("rows"))
    return m.select("doc_id", F.size("rows").alias("n_rows"), join(F.get("rows", F.lit(1))).alias("data"))


@query("join_10_left_anti", "uploads", "SELECT DISTINCT filename FROM {uploads} EXCEPT SELECT filename FROM {uploads} WHERE doc_id % 6 = 0")
def _(u: DataFrame) -> DataFrame:
    return u.select("filename").distinct().join(u.filter("doc_id % 6 = 0"), "filename", "left_anti")


@query("join_11_suffix_match", ("outline", "outline_heads"), """
WITH t AS (SELECT doc_id, i, page, regexp_replace(lower(title), '[^a-z0-9]', '', 'g') AS k FROM {outline}), h AS (SELECT doc_id, page, regexp_replace(lower(title), '[^a-z0-9]', '', 'g') AS k FROM {outline_heads})
SELECT doc_id, count(*) AS entries, count(*) FILTER (EXISTS (SELECT 1 FROM h WHERE h.doc_id = t.doc_id AND h.page = t.page AND (h.k = t.k OR (least(length(h.k), length(t.k)) >= 5 AND (suffix(h.k, t.k) OR suffix(t.k, h.k)))))) AS matched FROM t GROUP BY 1""")
def _(o: DataFrame, h: DataFrame) -> DataFrame:
    m = outline.match_outline(o, h.select("doc_id", "ord", F.col("title").alias("text"), "page"))
    return m.groupBy("doc_id").agg(F.count("*").alias("entries"), F.count("ord").alias("matched"))


@query("join_13_fallback_chain", "documents", "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 0 WHEN doc_id % 3 = 0 THEN 1 ELSE 2 END AS source FROM {documents} WHERE doc_id % 2 = 0 OR doc_id % 3 = 0 OR doc_id % 5 = 0")
def _(d: DataFrame) -> DataFrame:
    r = store.read_through(*artifacts(d))
    return r.select("doc_id", F.when(F.col("origin") == "cache", 0).when(F.col("origin") == "tree", 1).otherwise(2).alias("source"))


@query("join_14_next_not_deeper", "outline", """
SELECT a.doc_id, a.i, arg_min(b.page, b.i) AS next_page FROM {outline} a LEFT JOIN {outline} b ON a.doc_id = b.doc_id AND b.i > a.i AND b.level <= a.level GROUP BY ALL""")
def _(o: DataFrame) -> DataFrame:
    totals = o.select("doc_id").distinct().withColumn("total_pages", F.lit(1_000_000))
    x = levels.outline_extents(o, totals)
    return x.select("doc_id", "i", F.when(F.col("stop") <= 1_000_000, F.col("stop")).alias("next_page"))


@query("win_04_consumption", "outline_heads", """
SELECT doc_id, regexp_replace(lower(title), '[^a-z0-9]', '', 'g') AS key, CAST(row_number() OVER (PARTITION BY doc_id, regexp_replace(lower(title), '[^a-z0-9]', '', 'g') ORDER BY ord) AS INT) AS k, page FROM {outline_heads}""")
def _(h: DataFrame) -> DataFrame:
    return outline.heading_pages(h.select("doc_id", "ord", F.lit(True).alias("is_heading"), F.col("title").alias("text"), "page"))


@query("win_05_first_in_section", ("outline", "outline_heads"), "WITH " + SECTIONS.strip() + """
SELECT doc_id, first, count(*) AS sections FROM (SELECT doc_id, i, min(ord) AS first FROM covers c WHERE NOT EXISTS (SELECT 1 FROM decided d WHERE d.doc_id = c.doc_id AND d.anchor_i = c.i) GROUP BY ALL) GROUP BY ALL""")
def _(o: DataFrame, h: DataFrame) -> DataFrame:
    inserts = levels.outline_levels(*outline_parts(o, h))[1]
    return inserts.groupBy("doc_id", F.col("ord").alias("first")).agg(F.count("*").alias("sections"))


@query("win_06_segment_end", "orders", "SELECT o_custkey, o_orderkey, coalesce(lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), -1) AS stop FROM {orders}")
def _(o: DataFrame) -> DataFrame:
    return o.select("o_custkey", "o_orderkey", F.lead("o_orderkey", 1, -1).over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("stop"))


@query("win_12_images", "pages", "SELECT page_id, '[Image: first]' || html || '[Image: image]' AS html FROM {pages}")
def _(p: DataFrame) -> DataFrame:
    html = F.concat(F.lit('<img alt="x" src="a.png">'), F.col("html"), F.lit("<IMG SRC='b.png'/>"))
    return p.select("page_id", adapters.caption_images(html, F.array(F.lit("first"))).alias("html"))


@query("fmt_05_html_markdown", "pages")
def _(p: DataFrame) -> DataFrame:
    return p.select("page_id", adapters.page_markdown(F.col("html")).alias("md"))


@query("fmt_01_convert", "pages")
def _(p: DataFrame) -> DataFrame:
    files = p.select("page_id", F.when(F.col("page_id") % 5 == 0, ".pdf").otherwise(".html").alias("ext"), F.col("html").cast("binary").alias("content"))
    return adapters.to_markdown(files).select("page_id", "ext", "converter", "convert_error", F.length("md").alias("chars"))


@query("fmt_08_pipe_table", "order_lines", "WITH " + ROWS.strip() + """
SELECT doc_id, '## Orders' || chr(10) || chr(10) || '| order | status | total |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg('| ' || a || '\\|x | ' || b || ' | ' || z || ' |', chr(10) ORDER BY k) || chr(10) AS md
FROM data GROUP BY 1""")
def _(t: DataFrame) -> DataFrame:
    cells = T.pipe_cells(F.col("line"))
    row = F.array(F.concat(F.get(cells, F.lit(0)), F.lit("|x")), F.get(cells, F.lit(1)), F.get(cells, F.lit(2)))
    data = t.filter("pos0 = 2").groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", row.alias("row")))), lambda s: s["row"]).alias("data"))
    head, blank = F.array(*map(F.lit, ("order", "status", "total"))), F.array(F.lit(" "))
    return data.select("doc_id", adapters.sheet_markdown(F.lit("Orders"), F.concat(F.array(head, blank), F.col("data"))).alias("md"))


# -- aggregates and load tests -----------------------------------------------------------------------------
@query("agg_10_counters", "events", "SELECT event_type, count(*) AS value FROM {events} GROUP BY 1")
def _(e: DataFrame) -> DataFrame:
    return stats.counters(e, "event_type")


@query("agg_11_histogram", "samples", "SELECT tool, " + ", ".join(f"count(*) FILTER (latency_ms <= {b * 1000:g}) AS le_{i}" for i, b in enumerate(stats.BUCKETS)) + ", count(*) AS n, CAST(sum(latency_ms) AS VARCHAR) || '.000000' AS total FROM {samples} GROUP BY 1")
def _(s: DataFrame) -> DataFrame:
    h = stats.histogram(s, F.col("latency_ms"), "tool", bounds=tuple(b * 1000 for b in stats.BUCKETS))
    return h.withColumn("total", F.col("total").cast("string"))


@query("agg_12_gauges", "events", "SELECT event_type, arg_max(value, event_id) AS value FROM {events} GROUP BY 1")
def _(e: DataFrame) -> DataFrame:
    return stats.gauges(e, "value", F.col("event_id"), "event_type")


RANK = "list(latency_ms ORDER BY latency_ms)[least(count(*) * {p} // 100, count(*) - 1) + 1] AS p{p}"
RANKS = ", ".join(RANK.replace("{p}", str(p)) for p in (50, 95, 99))


@query("agg_13_step_summary", "samples", f"""
SELECT step, count(*) AS total, count(*) FILTER (status = 0 OR status >= 500) AS failed, round(count(*) FILTER (status = 0 OR status >= 500) * 100.0::DOUBLE / count(*), 1) AS error_pct,
  round(sum(latency_ms)::DOUBLE / count(*), 3) AS avg_ms, min(latency_ms) AS min_ms, max(latency_ms) AS max_ms, round(count(*) / 10.0::DOUBLE, 1) AS rps, {RANKS} FROM {{samples}} GROUP BY 1""")
def _(s: DataFrame) -> DataFrame:
    return stats.step_summary(s, 10.0)


@query("agg_14_nearest_rank", "samples", f"SELECT tool, step, {RANKS} FROM {{samples}} GROUP BY ALL")
def _(s: DataFrame) -> DataFrame:
    return stats.nearest_rank(s, "latency_ms", (50, 95, 99), "tool", "step")


@query("agg_15_tool_summary", "samples", f"SELECT tool, count(*) AS total, count(*) FILTER (status <> 200) AS failed, {RANKS} FROM {{samples}} GROUP BY 1")
def _(s: DataFrame) -> DataFrame:
    return stats.tool_summary(s)


@query("agg_16_recommended", "samples", f"""
WITH s AS (SELECT step, count(*) FILTER (status = 0 OR status >= 500) * 100.0 / count(*) AS e, {RANKS} FROM {{samples}} GROUP BY 1)
SELECT coalesce(max(step) FILTER (round(e, 1) < 9.0 AND p99 < 60000), min(step)) AS concurrency FROM s""")
def _(s: DataFrame) -> DataFrame:
    return stats.recommended(stats.step_summary(s, 10.0), 9.0, 60_000.0)


@query("agg_17_totals", ("documents", "turn_nodes"), """
SELECT (SELECT count(*) FROM {documents}) AS total, d.doc_id, coalesce(n, 0) AS node_count
FROM (SELECT * FROM {documents} ORDER BY lpad(CAST(doc_id AS VARCHAR), 9, '0') LIMIT 40) d LEFT JOIN (SELECT doc_id, count(DISTINCT node_id) AS n FROM {turn_nodes} GROUP BY 1) USING (doc_id)""")
def _(d: DataFrame, t: DataFrame) -> DataFrame:
    return retrieve.recent_documents(listed(d), t, size=40, order="key").select("total", "doc_id", "node_count")


@query("agg_18_context_chars", "turn_nodes", "WITH " + PICKS + """
, c AS (SELECT p.doc_id, string_agg(text, chr(10) || chr(10) ORDER BY p.pos, text) AS content FROM picks p JOIN {turn_nodes} t ON p.doc_id = t.doc_id AND p.node_id = t.node_id WHERE text <> '' GROUP BY 1)
SELECT CAST(sum(length(content)) AS BIGINT) AS chars, count(*) AS sources FROM c""")
def _(t: DataFrame) -> DataFrame:
    parts = retrieve.texts_of_picks(t, picks_of(t)).select(F.col("doc_id").alias("pos"), F.lit("d").alias("doc_name"), "content")
    return retrieve.assemble(parts).select("chars", "sources")


@query("agg_19_corpus_verdicts", "geo_broken", BROKEN + VERDICT + """
, r AS (SELECT reason, CASE WHEN reason = '' THEN 'tree' WHEN reason = 'garbling' AND doc_id % 2 = 1 THEN 'retry' WHEN reason <> 'garbling' THEN 'flat' ELSE 'reject' END AS route FROM verdict)
SELECT route, reason, count(*) AS docs FROM r GROUP BY CUBE (route, reason)""")
def _(t: DataFrame) -> DataFrame:
    d = geo(t)
    v = gate.verdict(nodes.build_nodes(d), d).join(d, "doc_id")
    return v.withColumn("route", gate.route(F.col("ok"), F.col("reason"), F.col("md"), F.col("doc_id") % 2 == 1)).cube("route", "reason").agg(F.count("*").alias("docs"))


@query("obs_06_first_breach", "events", "SELECT event_id, CASE WHEN value >= 95 THEN 'cpu' WHEN value % 10 >= 9 THEN 'memory' WHEN event_id % 7 >= 6 THEN 'error_rate' WHEN event_id % 11 >= 10 THEN 'p99' END AS breach FROM {events}")
def _(e: DataFrame) -> DataFrame:
    return e.select("event_id", stats.first_breach(F.col("value"), F.col("value") % 10, F.col("event_id") % 7, F.col("event_id") % 11, (95, 9, 6, 10)).alias("breach"))


@query("obs_01_counters_by_labels", "job_log", "SELECT event, coalesce(error, 'none') AS error, count(*) AS value FROM {job_log} GROUP BY ALL")
def _(j: DataFrame) -> DataFrame:
    return stats.counters(j.withColumn("error", F.coalesce("error", F.lit("none"))), "event", "error")


@query("obs_02_histogram_buckets", "samples", "SELECT step, count(*) FILTER (latency_ms <= 1000) AS le_0, count(*) FILTER (latency_ms <= 5000) AS le_1, count(*) AS n, CAST(sum(latency_ms) AS VARCHAR) || '.000000' AS total FROM {samples} GROUP BY 1")
def _(s: DataFrame) -> DataFrame:
    return stats.histogram(s, F.col("latency_ms"), "step", bounds=(1000, 5000)).withColumn("total", F.col("total").cast("string"))


@query("obs_03_last_values", "job_log", "SELECT job_id, arg_max(ts, seq) AS value FROM {job_log} GROUP BY 1")
def _(j: DataFrame) -> DataFrame:
    return stats.gauges(j, "ts", F.col("seq"), "job_id")


# -- retrieval -------------------------------------------------------------------------------------------------
@query("flt_01_keyword", "geo_lines", GEO + " SELECT doc_id, node_id, ord FROM tree WHERE contains(lower(title), 'building') OR contains(lower(text), 'building')")
def _(t: DataFrame) -> DataFrame:
    return retrieve.keyword_hits(nodes.build_nodes(geo(t)), "building").select("doc_id", "node_id", "ord")


@query("flt_03_page_selector", "events", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '3|7' WHEN event_id % 3 = 1 THEN '2|3|4' ELSE '5' END AS pages FROM {events}")
def _(e: DataFrame) -> DataFrame:
    s = F.when(F.col("event_id") % 3 == 0, "3, 7,3").when(F.col("event_id") % 3 == 1, "2-4,9-7").otherwise(" 5 ")
    return e.select("event_id", join(retrieve.page_set(s).cast("array<string>")).alias("pages"))


ON_PAGES = "text <> '' AND ((coalesce(start_index, 0) <= 1 AND coalesce(end_index, 0) >= 1) OR (coalesce(start_index, 0) <= 4 AND coalesce(end_index, 0) >= 3) OR coalesce(start_index, 0) = 0)"


@query("flt_04_on_pages", "turn_nodes", "SELECT doc_id, node_id FROM {turn_nodes} WHERE " + ON_PAGES)
def _(t: DataFrame) -> DataFrame:
    return retrieve.on_pages(t, "1,3-4,0").select("doc_id", "node_id")


@query("set_02_page_overlap", "turn_nodes", "SELECT doc_id, node_id, coalesce(start_index, 0) <= 4 AND coalesce(end_index, 0) >= 3 AS hit FROM {turn_nodes}")
def _(t: DataFrame) -> DataFrame:
    own = F.sequence(F.coalesce("start_index", F.lit(0)), F.coalesce("end_index", F.lit(0)))
    return t.select("doc_id", "node_id", F.arrays_overlap(own, retrieve.page_set("3-4")).alias("hit"))


@query("flt_10_flat_route", "objects", "SELECT key, content_class IS NOT NULL AND kind <> 'tree' AS flat FROM {objects}")
def _(o: DataFrame) -> DataFrame:
    return o.select("key", store.is_flat(o).alias("flat"))


def listed(d: DataFrame) -> DataFrame:
    return d.select(F.col("doc_id"), F.concat("source", F.lit(".md")).alias("doc_name"), F.col("n_chars").alias("processed_at"), F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("key"))


@query("ret_01_recent_documents", ("documents", "turn_nodes"), """
SELECT (SELECT count(*) FROM {documents}) AS total, 2 AS page, 25 AS page_size, d.doc_id, d.source || '.md' AS doc_name, 'completed' AS status, coalesce(n, 0) AS node_count
FROM (SELECT * FROM {documents} ORDER BY n_chars DESC, doc_id LIMIT 25 OFFSET 25) d LEFT JOIN (SELECT doc_id, count(DISTINCT node_id) AS n FROM {turn_nodes} GROUP BY 1) USING (doc_id)""")
def _(d: DataFrame, t: DataFrame) -> DataFrame:
    return retrieve.recent_documents(listed(d), t, page=2, size=25)


@query("srt_01_page_zero", ("documents", "turn_nodes"), "SELECT page, doc_id FROM (SELECT 1 AS page, doc_id FROM {documents} ORDER BY n_chars DESC, lpad(CAST(doc_id AS VARCHAR), 9, '0') LIMIT 3)")
def _(d: DataFrame, t: DataFrame) -> DataFrame:
    """Page 0 and a page behind the last are empty, page 1 isn't."""
    pages = [retrieve.recent_documents(listed(d), t, page=k, size=3).select("page", "doc_id") for k in (0, 1, 1_000_000)]
    return pages[0].union(pages[1]).union(pages[2])


@query("srt_02_key_order", ("documents", "turn_nodes"), "SELECT doc_id FROM {documents} ORDER BY lpad(CAST(doc_id AS VARCHAR), 9, '0') LIMIT 10")
def _(d: DataFrame, t: DataFrame) -> DataFrame:
    return retrieve.recent_documents(listed(d), t, order="key").select("doc_id")


@query("srt_03_deepest_first", ("outline", "outline_heads"), "WITH " + SECTIONS.strip() + """
SELECT h.doc_id, CAST(coalesce(anchor, CASE WHEN deepest IS NOT NULL THEN greatest(1, least(6, deepest + 1)) END) AS INT) AS new_level, count(*) AS heads FROM heads h LEFT JOIN decided d ON h.doc_id = d.doc_id AND h.ord = d.ord GROUP BY ALL""")
def _(o: DataFrame, h: DataFrame) -> DataFrame:
    return levels.outline_levels(*outline_parts(o, h))[0].groupBy("doc_id", F.col("new_level").cast("int").alias("new_level")).agg(F.count("*").alias("heads"))


@query("srt_05_truncation", "documents", "SELECT doc_id, left(text, 120) AS title, right(text, 2000) AS tail FROM {documents}")
def _(d: DataFrame) -> DataFrame:
    return d.select("doc_id", F.substring("text", 1, 120).alias("title"), F.when(F.length("text") > 2000, F.expr("right(text, 2000)")).otherwise(F.col("text")).alias("tail"))


@query("ret_03_get_document", "turn_nodes", """
SELECT doc_id, count(DISTINCT node_id) AS total_nodes, coalesce(string_agg(title || '/' || node_id || '/' || coalesce(CAST(start_index AS VARCHAR), 'None') || '-' || coalesce(CAST(end_index AS VARCHAR), 'None'), ';' ORDER BY ord, title) FILTER (parent_ord IS NULL), '') AS top
FROM {turn_nodes} GROUP BY 1""")
def _(t: DataFrame) -> DataFrame:
    g = retrieve.get_document(t)
    top = F.transform("top_level_sections", lambda s: F.concat_ws("/", s["title"], s["node_id"], s["pages"]))
    return g.select("doc_id", "total_nodes", F.array_join(top, ";").alias("top"))


@query("ret_04_structure", "geo_lines", GEO + """
, l3 AS (SELECT doc_id, parent_ord, string_agg('{"title":"' || title || '","node_id":"' || node_id || '","nodes":[]}', ',' ORDER BY ord) AS nodes FROM tree WHERE depth = 3 GROUP BY ALL
), l2 AS (SELECT t.doc_id, t.parent_ord, string_agg('{"title":"' || title || '","node_id":"' || node_id || '","nodes":[' || coalesce(nodes, '') || ']}', ',' ORDER BY ord) AS nodes
  FROM tree t LEFT JOIN l3 ON t.doc_id = l3.doc_id AND t.ord = l3.parent_ord WHERE depth = 2 GROUP BY ALL
), l1 AS (SELECT t.doc_id, string_agg('{"title":"' || title || '","node_id":"' || node_id || '","nodes":[' || coalesce(nodes, '') || ']}', ',' ORDER BY ord) AS nodes
  FROM tree t LEFT JOIN l2 ON t.doc_id = l2.doc_id AND t.ord = l2.parent_ord WHERE depth = 1 GROUP BY ALL)
SELECT doc_id, sha256('[' || nodes || ']') AS digest FROM l1""")
def _(t: DataFrame) -> DataFrame:
    return nodes.nested_json(nodes.build_nodes(geo(t)), 3).select("doc_id", F.sha2("structure", 256).alias("digest"))


@query("ret_05_page_content", "turn_nodes", "SELECT node_id, title, start_index, end_index, text FROM {turn_nodes} WHERE doc_id = 6 AND " + ON_PAGES)
def _(t: DataFrame) -> DataFrame:
    return retrieve.get_page_content(t, 6, "1,3-4,0")


@query("ret_06_normalized_query", "titles", "SELECT id, translate(title, '‐‑–—−', '-----') AS q FROM {titles}")
def _(t: DataFrame) -> DataFrame:
    return t.select("id", T.normalize_dashes(F.col("title")).alias("q"))


@query("ret_09_assembled_context", "conversations", """
WITH parts AS (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS content FROM {conversations} WHERE role = 'system' GROUP BY 1)
SELECT sha256(string_agg('=== conv' || CAST(conv_id AS VARCHAR) || ' ===' || chr(10) || content, chr(10) || chr(10) ORDER BY conv_id)) AS digest, CAST(sum(length(content)) AS BIGINT) AS chars, count(*) AS sources FROM parts""")
def _(c: DataFrame) -> DataFrame:
    x = c.filter("role = 'system'").groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda s: s["text"]), " ").alias("content"))
    parts = x.select(F.col("conv_id").alias("pos"), F.concat(F.lit("conv"), F.col("conv_id").cast("string")).alias("doc_name"), "content")
    return retrieve.assemble(parts).select(F.sha2("content", 256).alias("digest"), "chars", "sources")


@query("set_06_bag_union", "turn_nodes", "SELECT doc_id, text FROM {turn_nodes} WHERE ord = 0 UNION ALL SELECT doc_id, text FROM {turn_nodes} WHERE ord < 2")
def _(t: DataFrame) -> DataFrame:
    return t.filter("ord = 0").select("doc_id", "text").unionByName(t.filter("ord < 2").select("doc_id", "text"))


def stand_in(prompt: str) -> str:
    """In place of a model: documents whose id is divisible by 3, nodes with even numbers; it fails on every fifth number of lines."""
    head, *rows = prompt.split("\n")
    first = [r.split("\t")[0] for r in rows]
    if head.startswith("documents"):
        return '{"ids": [' + ", ".join(x for x in first if int(x) % 3 == 0) + "]}"
    if len(first) % 5 == 0:
        raise ValueError("down")
    return "```json\n[" + ", ".join(f'"{x}"' for x in first if int(x[1:]) % 2 == 0) + "]\n```"


def library(c: DataFrame, t: DataFrame, d: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Conversations have even ids, flat documents odd ones, so neither comes first by its id alone."""
    talks = c.select((F.col("conv_id") * 2).alias("doc_id"), F.concat(F.lit("conv"), F.col("conv_id").cast("string")).alias("doc_name"), F.lit("talk").alias("summary")).distinct()
    files = d.select((F.col("doc_id") * 2 + 1).alias("doc_id"), F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("doc_name"), F.col("lang").alias("summary"))
    flats = d.select((F.col("doc_id") * 2 + 1).alias("doc_id"), F.coalesce("text", F.lit("")).alias("content"))
    return talks.unionByName(files), t.withColumn("doc_id", F.col("doc_id") * 2), flats


LIBRARY = """
WITH lib AS (SELECT DISTINCT conv_id * 2 AS doc_id, 'conv' || CAST(conv_id AS VARCHAR) AS doc_name FROM {conversations} UNION ALL SELECT doc_id * 2 + 1, 'doc' || CAST(doc_id AS VARCHAR) FROM {documents}
), asked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord, node_id, title) AS pos, count(*) OVER (PARTITION BY doc_id) AS n FROM {turn_nodes}
), picked AS (SELECT doc_id, pos, node_id FROM asked WHERE n % 5 > 0 AND ord % 2 = 0
), texts AS (SELECT p.doc_id * 2 AS doc_id, string_agg(text, chr(10) || chr(10) ORDER BY p.pos, text) AS content FROM picked p JOIN {turn_nodes} t ON p.doc_id = t.doc_id AND p.node_id = t.node_id WHERE text <> '' GROUP BY 1
), found AS (SELECT doc_id, content, NULL AS error FROM texts UNION ALL SELECT doc_id * 2 + 1, coalesce(text, ''), NULL FROM {documents}
  UNION ALL SELECT DISTINCT doc_id * 2, NULL, 'ValueError: down' FROM asked WHERE n % 5 = 0
  UNION ALL SELECT DISTINCT doc_id * 2, NULL, 'no ids' FROM asked WHERE n % 5 > 0 AND doc_id NOT IN (SELECT doc_id FROM picked))
"""


@query("ret_02_find_relevant", ("conversations", "turn_nodes", "documents"), LIBRARY + "SELECT doc_id, doc_name, sha256(content) AS digest, error FROM lib JOIN found USING (doc_id) WHERE doc_id % 3 = 0")
def _(c: DataFrame, t: DataFrame, d: DataFrame) -> DataFrame:
    found = retrieve.search_by_model(*library(c, t, d), "the that of", stand_in)
    return found.select("doc_id", "doc_name", F.sha2("content", 256).alias("digest"), "error")


@query("ret_07_lexical", ("conversations", "turn_nodes", "documents"))
def _(c: DataFrame, t: DataFrame, d: DataFrame) -> DataFrame:
    """The default without a model: words in common."""
    # Conversations have even ids, flat documents odd ones, so neither comes first by its id alone.
    talks = c.filter("turn = 0").select((F.col("conv_id") * 2).alias("doc_id"), F.concat(F.lit("conv"), F.col("conv_id").cast("string")).alias("doc_name"), F.col("text").alias("summary"))
    files = d.select((F.col("doc_id") * 2 + 1).alias("doc_id"), F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("doc_name"), F.col("text").alias("summary"))
    docs, t = talks.unionByName(files), t.withColumn("doc_id", F.col("doc_id") * 2)
    flats = files.select("doc_id", F.col("summary").alias("content"))
    return retrieve.search(docs, t, flats, "the that of")


@query("ret_00_ranked_documents", "geo_lines", GEO + """
, hits AS (SELECT doc_id, count(*) AS matches FROM tree WHERE contains(lower(text), 'building') OR contains(lower(title), 'building') GROUP BY 1)
SELECT t.doc_id, CAST(count(*) AS INT) AS node_count, CAST(max(depth) AS INT) AS depth, CASE WHEN count(*) < 3 THEN 'node_count<3' WHEN max(depth) < 2 THEN 'depth<2' ELSE '' END AS reason, coalesce(max(matches), 0) AS matches
FROM tree t LEFT JOIN hits USING (doc_id) GROUP BY 1""")
def _(t: DataFrame) -> DataFrame:
    d = geo(t)
    n = nodes.build_nodes(d)
    hits = retrieve.keyword_hits(n, "building").groupBy("doc_id").agg(F.count("*").alias("matches"))
    v = gate.verdict(n, d).select("doc_id", "node_count", "depth", "reason")
    return v.join(hits, "doc_id", "left").withColumn("matches", F.coalesce("matches", F.lit(0))).orderBy(F.desc("matches"), "doc_id")


# -- jobs -------------------------------------------------------------------------------------------------------
REASON = "CASE error WHEN 'LowQualityTreeError' THEN 'low_quality_tree' WHEN 'MemoryError' THEN 'converter_oom' WHEN 'TimeoutError' THEN 'converter_timeout' ELSE CASE WHEN error IS NOT NULL THEN 'converter_child_failed' END END"
STATES = f"""
states AS (SELECT job_id, arg_max(event, seq) AS status, arg_max(ts, seq) FILTER (event = 'processing') AS processing_started_at, arg_max(doc_id, seq) FILTER (event = 'done') AS doc_id,
  arg_max({REASON}, seq) FILTER (event = 'error') AS reason, max(attempt) AS attempts, max(ts) AS updated_at FROM {{job_log}} GROUP BY 1)"""


@query("job_04_lifecycle", "job_log", "WITH " + STATES.strip() + " SELECT * REPLACE (CASE WHEN status <> 'done' THEN reason END AS reason) FROM states")
def _(j: DataFrame) -> DataFrame:
    return jobs.job_states(j)


@query("job_03_merged_fields", "job_log", "WITH " + STATES.strip() + " SELECT * FROM states")
def _(j: DataFrame) -> DataFrame:
    return jobs.job_states(j, clear_on_success=False)


@query("job_02_lookup", "job_log", "WITH " + STATES.strip() + " SELECT job_id, status FROM states WHERE 600000 - updated_at <= 86400")
def _(j: DataFrame) -> DataFrame:
    return jobs.lookup(jobs.job_states(j), F.lit(600_000)).select("job_id", "status")


@query("job_05_reasons", "job_log", f"SELECT seq, {REASON} AS reason FROM {{job_log}} WHERE event = 'error'")
def _(j: DataFrame) -> DataFrame:
    return j.filter("event = 'error'").select("seq", jobs.reason_of(F.col("error")).alias("reason"))


@query("job_06_outcomes", "job_log", f"SELECT seq, CASE WHEN {REASON} = 'low_quality_tree' THEN 'terminal' WHEN attempt >= 2 THEN 'dead' ELSE 'retry' END AS outcome FROM {{job_log}} WHERE event = 'error'")
def _(j: DataFrame) -> DataFrame:
    return jobs.retryable(j.filter("event = 'error'")).select("seq", "outcome")


@query("job_07_dead_letters", "job_log", f"SELECT job_id, attempt, left(error, 200) AS error FROM {{job_log}} WHERE event = 'error' AND attempt >= 2 AND {REASON} <> 'low_quality_tree'")
def _(j: DataFrame) -> DataFrame:
    return jobs.dead_letters(j.filter("event = 'error'"))


@query("job_08_stale", "job_log", "WITH " + STATES.strip() + " SELECT job_id, processing_started_at FROM states WHERE status = 'processing' AND 700000 - processing_started_at > 1020")
def _(j: DataFrame) -> DataFrame:
    return jobs.stale(jobs.job_states(j), F.lit(700_000)).select("job_id", "processing_started_at")


@query("dtm_02_age", "job_log", "SELECT seq, 400000 - ts > 1020 AS late FROM {job_log}")
def _(j: DataFrame) -> DataFrame:
    return j.select("seq", (F.lit(400_000) - F.col("ts") > jobs.JOB_TIMEOUT_S + jobs.GRACE_S).alias("late"))


@query("dtm_01_times", "job_log", "SELECT seq, strftime(make_timestamp(ts * 1000000), '%Y-%m-%dT%H:%M:%S') || '+00:00' AS iso FROM {job_log}")
def _(j: DataFrame) -> DataFrame:
    return j.select("seq", F.concat(F.date_format(F.timestamp_seconds("ts"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00")).alias("iso"))


@query("dtm_03_ttl", "job_log", "SELECT seq FROM {job_log} WHERE 300000 - ts <= 86400")
def _(j: DataFrame) -> DataFrame:
    return j.filter(F.lit(300_000) - F.col("ts") <= jobs.JOB_TTL_S).select("seq")


@query("job_11_queue_depth", "job_log", "WITH " + STATES.strip() + " SELECT count(*) FILTER (status = 'pending') AS depth FROM states")
def _(j: DataFrame) -> DataFrame:
    return jobs.queue_depth(jobs.job_states(j))


@query("job_13_purged", "job_log", f"SELECT DISTINCT job_id FROM {{job_log}} WHERE event = 'done' OR (event = 'error' AND {REASON} = 'low_quality_tree')")
def _(j: DataFrame) -> DataFrame:
    return jobs.purged(j.filter("event = 'error'"), j.filter("event = 'done'"))


@query("job_01_enqueue", "uploads", """
WITH f AS (SELECT doc_id // 20 AS batch_id, doc_id AS seq, filename, doc_id % 37 <> 5 AS ok FROM {uploads}), b AS (SELECT *, min(seq) FILTER (NOT ok) OVER (PARTITION BY batch_id) AS bad FROM f)
SELECT batch_id, seq, filename, CASE WHEN bad IS NULL OR seq < bad THEN 'pending' WHEN seq = bad THEN 'refused' ELSE 'skipped' END AS status FROM b""")
def _(u: DataFrame) -> DataFrame:
    f = u.select(F.expr("doc_id div 20").alias("batch_id"), F.col("doc_id").alias("seq"), "filename")
    return jobs.enqueue(f, F.col("seq") % 37 != 5)


@query("flat_02_parsed_rows", "order_lines", "SELECT doc_id, CAST(count(*) AS INT) AS n_rows FROM {order_lines} WHERE pos0 = 2 GROUP BY 1")
def _(t: DataFrame) -> DataFrame:
    return flat.blocks(tables(t)).select("doc_id", (F.size(F.get("blocks", F.lit(0))["rows"]) - 1).alias("n_rows"))
