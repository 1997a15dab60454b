"""The remaining operators: outlines against headings, models, expositions, runs and fallbacks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.functions import access, models
from leafmill.functions import text as T
from leafmill.operators import flat, gate, levels, nodes, outline, split, stats
from leafmill.plans import retrieve
from leafmill.plans.registry import query
from leafmill.plans.scalar_queries import CELLS, join
from leafmill.streaming import jobs
from leafmill.plans.store_queries import LIBRARY, library, stand_in
from leafmill.plans.tree_queries import BROKEN, CONTAIN, GEO, VERDICT, geo, legal, outline_parts, pair, tables, titled


@query("tree_08_heading_pages", "outline_heads", """
SELECT doc_id, regexp_replace(lower(title), '[^a-z0-9]', '', 'g') AS key, CAST(row_number() OVER (PARTITION BY doc_id, regexp_replace(lower(title), '[^a-z0-9]', '', 'g') ORDER BY ord) AS INT) AS k, page
FROM {outline_heads} WHERE ord % 4 > 0""")
def _(h: DataFrame) -> DataFrame:
    return outline.heading_pages(h.select("doc_id", "ord", (F.col("ord") % 4 > 0).alias("is_heading"), F.col("title").alias("text"), "page"))


@query("tree_10_outline_match", ("outline", "outline_heads"), """
WITH t AS (SELECT *, regexp_replace(lower(title), '[^a-z0-9]', '', 'g') AS t, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM {outline}
), h AS (SELECT doc_id, ord, page, regexp_replace(lower(title), '[^a-z0-9]', '', 'g') AS k FROM {outline_heads}
), best AS (SELECT t.doc_id, t.i, arg_min(h.ord, (CASE WHEN k = t THEN 0 ELSE 1 END) * 1000000000 + length(k) * 1000000 + h.ord) AS ord FROM t JOIN h ON t.doc_id = h.doc_id AND t.page = h.page
  WHERE k = t OR (least(length(k), length(t)) >= 5 AND (suffix(k, t) OR suffix(t, k))) GROUP BY ALL
), p AS (SELECT doc_id, i, CASE WHEN level > 1 THEN max(CASE WHEN level = 1 THEN n END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS parent FROM t)
SELECT p.doc_id, p.i, best.ord, CAST(p.parent AS INT) AS parent FROM p LEFT JOIN best ON p.doc_id = best.doc_id AND p.i = best.i""")
def _(o: DataFrame, h: DataFrame) -> DataFrame:
    return outline.match_outline(o, h.select("doc_id", "ord", F.col("title").alias("text"), "page"))


@query("tree_06_outline_optional", ("titles", "outline_heads"), CONTAIN.replace("FROM {titles})", "FROM (SELECT id, doc_id, ord, translate(title, '‐‑–—−', '-----') AS title FROM {titles}))") + """
SELECT doc_id, string_agg(CASE WHEN depth IS NULL THEN '#' ELSE repeat('#', least(6, depth)) END || ' ' || trim(title) || chr(10) || 'body of ' || CAST(id AS VARCHAR), chr(10) ORDER BY ord) AS md FROM depths GROUP BY 1""")
def _(t: DataFrame, h: DataFrame) -> DataFrame:
    """Documents without an outline pass the last step unchanged."""
    heads, pages, _, _ = outline_parts(h.withColumn("i", F.col("ord")), h)
    toc = h.limit(0).select("doc_id", F.col("ord").alias("i"), F.lit(1).alias("level"), "title", "page")
    totals = h.select("doc_id").distinct().withColumn("total_pages", F.lit(10))
    return levels.recover_depth(titled(t), pages, toc, totals)


@query("tree_09_promoted_count", "titles", CONTAIN.replace("FROM {titles})", "FROM (SELECT id, doc_id, ord, translate(title, '‐‑–—−', '-----') AS title FROM {titles}))") + """
, anchors AS (SELECT DISTINCT doc_id, label FROM labeled WHERE id % 2 = 0 AND len(label) > 0
), promoted AS (SELECT DISTINCT l.doc_id, l.ord FROM labeled l, unnest(range(1, greatest(len(l.label), 1))) AS u(k) WHERE l.id % 2 = 1 AND len(l.label) > 1
  AND len(list_filter(list_slice(l.label, k + 1, len(l.label)), lambda a: NOT regexp_matches(a, '^[0-9]+$'))) = 0
  AND EXISTS (SELECT 1 FROM anchors a WHERE a.doc_id = l.doc_id AND a.label = list_slice(l.label, 1, k)))
SELECT doc_id, count(*) AS promoted FROM promoted GROUP BY 1""")
def _(t: DataFrame) -> DataFrame:
    p = levels.promotions(t.select("doc_id", "ord", (F.col("id") % 2 == 0).alias("is_heading"), F.col("title").alias("text")))
    return p.groupBy("doc_id").agg(F.count("*").alias("promoted"))


@query("tree_15_reasons", "geo_broken", BROKEN + VERDICT + " SELECT reason, count(*) AS n FROM verdict GROUP BY 1")
def _(t: DataFrame) -> DataFrame:
    d = geo(t)
    return gate.verdict(nodes.build_nodes(d), d).groupBy("reason").agg(F.count("*").alias("n"))


@query("tree_18_paragraph_fallback", "documents", """
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 4 ELSE 1 END AS parts FROM {documents}""")
def _(d: DataFrame) -> DataFrame:
    piece = lambda k: F.concat(F.lit("فقرة "), F.lit("x" * k))
    text = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("vor "), piece(60), piece(60), piece(60))).otherwise(F.concat(piece(60), piece(300), piece(60)))
    leaves = d.select("doc_id", F.lit("n").alias("node_id"), text.alias("text"))
    return split.split_oversized(leaves, max_chars=150, min_gap=50).groupBy("doc_id").agg(F.count("*").cast("int").alias("parts"))


@query("win_07_increasing_run", "documents", """
SELECT doc_id - doc_id % 40 AS doc_id, count(*) AS run FROM {documents} GROUP BY 1 HAVING count(*) >= 3 AND sum(length(text)) > 2000""")
def _(d: DataFrame) -> DataFrame:
    s = split.split_oversized(legal(d).select("doc_id", F.lit("n").alias("node_id"), "text"), max_chars=2_000)
    return s.filter("depth = 1").groupBy("doc_id").agg(F.count("*").alias("run"))


@query("win_10_stitched_run", "wide_tables", "SELECT doc_id, CASE WHEN y3 <> 'Note' THEN 1 ELSE 2 END AS n_tables FROM {wide_tables}")
def _(t: DataFrame) -> DataFrame:
    block = lambda x: F.struct(F.lit("table").alias("role"), F.lit(None).cast("string").alias("text"), x["headers"].alias("headers"), x["rows"].alias("rows"))
    s = flat.stitch(F.array(block(F.col("a")), block(F.col("b"))))
    return pair(t).select("doc_id", F.size(s).alias("n_tables"))


@query("agg_02_depth", "geo_lines", GEO + " SELECT doc_id, max(depth) AS depth FROM tree GROUP BY 1")
def _(t: DataFrame) -> DataFrame:
    return nodes.build_nodes(geo(t)).groupBy("doc_id").agg(F.coalesce(F.max("depth"), F.lit(0)).alias("depth"))


@query("agg_05_min_level", "geo_lines", "SELECT doc_id, CAST(min(length(regexp_extract(line, '^(#+)', 1))) - 1 AS INT) AS shift FROM {geo_lines} WHERE k1 > 0 GROUP BY 1")
def _(t: DataFrame) -> DataFrame:
    return nodes.sections(geo(t.filter("k1 > 0"))).groupBy("doc_id").agg((F.min("level") - 1).alias("shift"))


@query("obs_04_exposition", "job_log", """SELECT 'jobs{event="' || event || '"} ' || CAST(count(*) AS VARCHAR) AS line FROM {job_log} GROUP BY event""")
def _(j: DataFrame) -> DataFrame:
    return stats.exposition(stats.counters(j, "event"), "jobs", "event")


@query("str_15_provider_model", "documents", """
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lang || '-' || source WHEN doc_id % 3 = 0 THEN 'other/azure/' || lang ELSE 'azure/' || lang || '-' || source END AS model FROM {documents}""")
def _(d: DataFrame) -> DataFrame:
    url = F.concat(F.lit("https://"), "source", F.when(F.col("doc_id") % 2 == 0, ".OpenAI.Azure.com/v1").otherwise(".example.org/azure.com"))
    name = F.when((F.col("doc_id") % 2 == 1) & (F.col("doc_id") % 3 == 0), F.concat(F.lit("other/azure/"), "lang")).otherwise(F.concat(F.lit("azure/"), "lang", F.lit("-"), "source"))
    return d.select("doc_id", models.provider_model(name, url).alias("model"))


@query("udf_01_completion", "conversations", "SELECT conv_id, turn, left(string_split(text, '.')[1], 200) AS said FROM {conversations}")
def _(c: DataFrame) -> DataFrame:
    return c.select("conv_id", "turn", models.complete(F.col("text")).alias("said"))


@query("udf_02_caption", "pages", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'image' ELSE url END AS said FROM {pages}")
def _(p: DataFrame) -> DataFrame:
    def client(src: str) -> str:
        if int(src.split("|")[0]) % 2 == 0:
            raise ValueError("no caption")
        return src.split("|", 1)[1]

    return p.select("page_id", models.caption(F.concat_ws("|", F.col("page_id").cast("string"), "url"), client).alias("said"))


@query("udf_04_table_function", "turn_nodes", r"SELECT doc_id, ord, unnest(regexp_extract_all(title, '\S+')) AS word FROM {turn_nodes}")
def _(t: DataFrame) -> DataFrame:
    spark = t.sparkSession
    models.register_tools(spark, t)
    return spark.sql("SELECT doc_id, ord, w.word FROM nodes, LATERAL find_words(title) w")


@query("ret_07_prefilter", ("conversations", "turn_nodes", "documents"), LIBRARY + "SELECT doc_id, doc_name FROM lib WHERE doc_id % 3 = 0")
def _(c: DataFrame, t: DataFrame, d: DataFrame) -> DataFrame:
    docs = library(c, t, d)[0]
    line = F.concat_ws("\t", F.col("doc_id").cast("string"), "doc_name")
    asked = docs.select(F.col("doc_id").alias("key"), F.concat(F.lit("documents\n"), line).alias("prompt"))
    picks = retrieve.model_picks(asked, stand_in).filter("pos IS NOT NULL").select(F.col("picked").cast("long").alias("doc_id"), "pos")
    return retrieve.pick_in_order(docs, picks).select("doc_id", "doc_name")


@query("ret_08_node_search", "turn_nodes", """
SELECT CAST(doc_id AS VARCHAR) AS key, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY ord, node_id) - 1 AS INT) AS pos, node_id AS picked, NULL AS error
FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM {turn_nodes}) WHERE n % 5 > 0 AND ord % 2 = 0
UNION ALL SELECT CAST(doc_id AS VARCHAR), NULL, NULL, 'ValueError: down' FROM {turn_nodes} GROUP BY doc_id HAVING count(*) % 5 = 0
UNION ALL SELECT CAST(doc_id AS VARCHAR), NULL, NULL, 'no ids' FROM {turn_nodes} GROUP BY doc_id HAVING count(*) % 5 > 0 AND count(*) FILTER (ord % 2 = 0) = 0""")
def _(t: DataFrame) -> DataFrame:
    ids = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "node_id"))), lambda x: x["node_id"]), "\n")
    return retrieve.model_picks(t.groupBy(F.col("doc_id").alias("key")).agg(F.concat(F.lit("nodes\n"), ids).alias("prompt")), stand_in)


@query("ret_10_missing_skipped", "conversations", "SELECT DISTINCT conv_id AS doc_id FROM {conversations} WHERE conv_id % 2 = 0 AND conv_id // 2 IN (SELECT conv_id FROM {conversations})")
def _(c: DataFrame) -> DataFrame:
    docs = c.select(F.col("conv_id").alias("doc_id")).distinct()
    return retrieve.pick_in_order(docs, c.select((F.col("conv_id") * 2).alias("doc_id"), F.col("turn").alias("pos"))).select("doc_id")


@query("ret_03_get_flat_document", "order_lines", "SELECT doc_id, 2 AS total_blocks, 'table|prose' AS roles, 'flat_mixed' AS content_class FROM {order_lines} WHERE doc_id % 2 = 1 GROUP BY 1 UNION ALL SELECT doc_id, 1, 'table', 'flat_table' FROM {order_lines} WHERE doc_id % 2 = 0 GROUP BY 1")
def _(t: DataFrame) -> DataFrame:
    f = retrieve.get_flat_document(flat.blocks(noted(t)))
    return f.select("doc_id", "total_blocks", join(F.col("roles")).alias("roles"), "content_class")


@query("ret_11_sections", "turn_nodes", "SELECT doc_id, CAST(count(*) FILTER (parent_ord IS NULL) AS INT) AS sections FROM {turn_nodes} GROUP BY 1")
def _(t: DataFrame) -> DataFrame:
    return retrieve.get_document(t).select("doc_id", F.size("top_level_sections").alias("sections"))


def noted(t: DataFrame) -> DataFrame:
    """Tables of orders, every other one with a closing sentence."""
    note = F.when(F.col("doc_id") % 2 == 1, "\n\nAll prices in euros.").otherwise("")
    return tables(t).select("doc_id", F.concat("md", note).alias("md"))


@query("set_04_signals", "order_lines", "SELECT doc_id, CASE WHEN doc_id % 2 = 1 THEN 'table|prose' ELSE 'table' END AS signals, CASE WHEN doc_id % 2 = 1 THEN 'flat_mixed' ELSE 'flat_table' END AS content_class FROM {order_lines} GROUP BY 1")
def _(t: DataFrame) -> DataFrame:
    b = flat.blocks(noted(t))
    return b.select("doc_id", join(flat.signals(F.col("blocks"))).alias("signals"), flat.content_class(F.col("blocks")).alias("content_class"))


@query("flt_11_access", "documents", """
SELECT doc_id, CASE WHEN path LIKE '/health%' OR path LIKE '/metrics%' OR token = '' OR header = 'Bearer ' || token THEN 200 ELSE 401 END AS bearer,
  CASE WHEN token = '' THEN 503 WHEN key = token THEN 200 ELSE 401 END AS api_key
FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '/health/live' WHEN 1 THEN '/metrics' ELSE '/mcp' END AS path, CASE WHEN doc_id % 5 = 0 THEN '' ELSE lang END AS token,
  CASE WHEN doc_id % 3 = 0 THEN 'Bearer ' || lang WHEN doc_id % 3 = 1 THEN 'Bearer x' END AS header, CASE WHEN doc_id % 6 < 4 THEN lang END AS key FROM {documents})""")
def _(d: DataFrame) -> DataFrame:
    k = F.col("doc_id")
    path = F.when(k % 4 == 0, "/health/live").when(k % 4 == 1, "/metrics").otherwise("/mcp")
    token = F.when(k % 5 != 0, F.col("lang"))
    header = F.when(k % 3 == 0, F.concat(F.lit("Bearer "), "lang")).when(k % 3 == 1, "Bearer x")
    return d.select("doc_id", access.bearer_status(path, header, token).alias("bearer"), access.api_key_status(F.when(k % 6 < 4, F.col("lang")), token).alias("api_key"))


@query("job_09_child_outcome", "events", """
SELECT event_id, CASE WHEN value * 10 >= 870 THEN 'converter_timeout' WHEN event_id % 7 = 0 THEN 'converter_oom' WHEN event_id % 5 = 0 OR event_id % 11 = 0 THEN 'converter_child_failed' END AS reason FROM {events}""")
def _(e: DataFrame) -> DataFrame:
    code = F.when(F.col("event_id") % 7 == 0, -9).when(F.col("event_id") % 5 == 0, 1).otherwise(0)
    line = F.when(F.col("event_id") % 11 == 0, "Traceback").otherwise('{"ok": true}')
    return e.select("event_id", jobs.child_reason(code, F.col("value") * 10, line).alias("reason"))


@query("job_10_admission", "events", """
WITH r AS (SELECT user_id, list(CASE WHEN event_id % 13 = 0 THEN NULL ELSE value END ORDER BY event_id) AS readings FROM {events} GROUP BY 1)
SELECT user_id, CAST(coalesce(list_min(list_filter(list_transform(range(1, 41), lambda k: CASE WHEN k <= len(readings) AND coalesce(readings[k], 999) >= 90 THEN (k - 1) * 3 END), lambda x: x IS NOT NULL)), 120) AS INT) AS waited FROM r""")
def _(e: DataFrame) -> DataFrame:
    reading = F.when(F.col("event_id") % 13 != 0, F.col("value"))
    r = e.groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("event_id", reading.alias("free")))), lambda x: x["free"]).alias("readings"))
    return r.select("user_id", jobs.admission_wait(F.col("readings"), 90).alias("waited"))


@query("obs_05_load_plan", "events", """
WITH d AS (SELECT event_id AS request, user_id % 30 AS stage, ['recent', 'find', 'document', 'structure', 'pages'][CAST(event_id % 5 AS INT) + 1] AS drawn FROM {events}
), n AS (SELECT *, row_number() OVER (PARTITION BY stage, drawn ORDER BY request) AS nth FROM d)
SELECT request, stage, least(50, 2 + stage * 2) AS concurrency, CASE WHEN drawn = 'find' AND nth > 3 THEN 'recent' ELSE drawn END AS tool FROM n""")
def _(e: DataFrame) -> DataFrame:
    draws = e.select(F.col("event_id").alias("request"), (F.col("user_id") % 30).alias("stage"))
    return stats.load_plan(draws, ("recent", "find", "document", "structure", "pages"), "find", "recent", 3)


@query("udf_05_configuration", "documents", """
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'azure' ELSE 'openai' END AS provider,
  CASE WHEN doc_id % 5 = 0 THEN 'no model' WHEN doc_id % 3 = 0 THEN 'no key for ' || CASE WHEN doc_id % 2 = 0 THEN 'azure' ELSE 'openai' END END AS error FROM {documents}""")
def _(d: DataFrame) -> DataFrame:
    k = F.col("doc_id")
    url = F.when(k % 2 == 0, "https://x.OpenAI.azure.com")
    return d.select("doc_id", models.provider(url).alias("provider"), models.config_error(F.when(k % 5 != 0, "m"), url, F.when(k % 3 == 0, " ").otherwise("secret")).alias("error"))


@query("fmt_11_summaries", "turn_nodes", r"""
SELECT doc_id, node_id, ord, CASE WHEN len(regexp_extract_all(text, '\S+')) >= 20 THEN left(string_split(text, '.')[1], 200) ELSE text END AS summary FROM {turn_nodes}""")
def _(t: DataFrame) -> DataFrame:
    return nodes.summaries(t, models.complete, least_words=20).select("doc_id", "node_id", "ord", "summary")


@query("job_12_bounded_calls", "conversations", "SELECT count(*) AS rows, true AS bounded FROM {conversations}")
def _(c: DataFrame) -> DataFrame:
    calls = models.bounded(c, 3).select(F.spark_partition_id().alias("worker"))
    return calls.agg(F.count("*").alias("rows"), (F.count_distinct("worker") <= 3).alias("bounded"))


@query("flat_09_cells", "order_lines", f"""
SELECT doc_id, pos0, k, len({CELLS}) AS cells, contains(line, '|') AS piped, CASE WHEN pos0 = 2 THEN array_to_string(list_transform(list_zip(['order', 'status', 'col3'], {CELLS}), lambda x: x[1] || ': ' || x[2]), '; ') END AS record,
  len(list_filter({CELLS}, lambda c: regexp_matches(c, '^[0-9٠-٩][0-9٠-٩\\s/\\-.:,]*$'))) AS numbers FROM {{order_lines}}""")
def _(t: DataFrame) -> DataFrame:
    cells = T.pipe_cells(F.col("line"))
    record = F.when(F.col("pos0") == 2, T.row_record(F.array(F.lit("order"), F.lit("status")), cells))
    numbers = F.size(F.filter(cells, T.is_number_cell))
    return t.select("doc_id", "pos0", "k", F.size(cells).alias("cells"), T.is_pipe_row(F.col("line")).alias("piped"), record.alias("record"), numbers.alias("numbers"))
