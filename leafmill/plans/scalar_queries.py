"""Scalar functions, predicates, sets and small aggregates over whole carriers, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.functions import models
from leafmill.functions import text as T
from leafmill.operators import flat, levels, split
from leafmill.plans.registry import query
from leafmill.sources import store

join = lambda x: F.array_join(x, "|")
STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
DASHED = "translate(title, '‐‑–—−', '-----')"
AR = r"[\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{08A0}-\x{08FF}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}]"
END = r"(?:[^\p{L}\p{N}_]|$)"


@query("str_01_normalize_dashes", "titles", f"SELECT id, {DASHED} AS title FROM {{titles}}")
def _(t: DataFrame) -> DataFrame:
    return t.select("id", T.normalize_dashes(F.col("title")).alias("title"))


@query("str_02_title_key", "titles", f"SELECT id, regexp_replace(lower(replace({DASHED}, chr(10), ' ')), '[^a-z0-9]', '', 'g') AS key FROM {{titles}}")
def _(t: DataFrame) -> DataFrame:
    return t.select("id", T.title_key(F.col("title")).alias("key"))


@query("str_03_collapse_space", "titles", r"SELECT id, trim(regexp_replace(title, '\s+', ' ', 'g')) AS title FROM {titles}")
def _(t: DataFrame) -> DataFrame:
    return t.select("id", T.collapse_space(F.col("title")).alias("title"))


UNSPACED = r"""
CASE WHEN len(regexp_extract_all(title, '\S+')) >= 4
  AND len(list_filter(regexp_extract_all(title, '\S+'), lambda x: length(x) = 1)) >= 0.6 * len(regexp_extract_all(title, '\S+'))
  THEN array_to_string(list_transform(regexp_split_to_array(trim(title), '\s\s+'), lambda c: replace(c, ' ', '')), ' ') ELSE title END"""


@query("str_04_unspace", "titles", f"SELECT id, {UNSPACED} AS title FROM {{titles}}")
def _(t: DataFrame) -> DataFrame:
    return t.select("id", T.unspace(F.col("title")).alias("title"))


LABELS = rf"""
spaced AS (SELECT id, doc_id, ord, title, {UNSPACED.replace("title", "trimmed")} AS t FROM (SELECT *, trim(title) AS trimmed FROM {{titles}})
), worded AS (
  SELECT *, CASE WHEN regexp_matches(t, '(?i)^(teil|anhang|abschnitt|kapitel){END}') THEN ltrim(regexp_replace(t, '(?i)^(teil|anhang|abschnitt|kapitel)', ''), ' -')
    WHEN regexp_matches(t, '^(?:ال)?(?:مادة|باب|فصل|قسم|جزء|مرسوم){END}') THEN ltrim(regexp_replace(t, '^(?:ال)?(?:مادة|باب|فصل|قسم|جزء|مرسوم)', ''), ' -:()') ELSE t END AS rest
  FROM spaced
), headed AS (
  SELECT *, trim(rtrim(regexp_extract(translate(rest, '٠١٢٣٤٥٦٧٨٩', '0123456789'), '^\s*(\S+)', 1), ':'), '()') AS head FROM worded
), pieced AS (
  SELECT *, list_transform(list_filter(regexp_split_to_array(head, '[.\-]'), lambda p: p <> ''), lambda p:
    CASE WHEN regexp_matches(p, '^([A-Za-z]+)(\(([A-Za-z0-9]+)\))?([0-9]+)?$')
      THEN list_filter([regexp_extract(p, '^([A-Za-z]+)(\(([A-Za-z0-9]+)\))?([0-9]+)?$', 1), regexp_extract(p, '^([A-Za-z]+)(\(([A-Za-z0-9]+)\))?([0-9]+)?$', 3),
        regexp_extract(p, '^([A-Za-z]+)(\(([A-Za-z0-9]+)\))?([0-9]+)?$', 4)], lambda x: x <> '')
      ELSE regexp_extract_all(p, '[A-Za-z]+|[0-9]+') END) AS pieces
  FROM headed
), labeled AS (
  SELECT id, doc_id, ord, title, CASE WHEN regexp_matches(head, '^[A-Za-z0-9]') AND len(list_filter(pieces, lambda p: len(p) = 0)) = 0
    AND regexp_matches(coalesce(flatten(pieces)[1], ''), '^([A-Za-z]|[0-9]+)$') AND length(head) <= 14 THEN flatten(pieces) ELSE [] END AS label
  FROM pieced
)"""


@query("str_05_label_atoms", "titles", r"""
SELECT id, array_to_string(CASE WHEN regexp_matches(tok, '^([A-Za-z]+)(\(([A-Za-z0-9]+)\))?([0-9]+)?$')
  THEN list_filter([regexp_extract(tok, '^([A-Za-z]+)(\(([A-Za-z0-9]+)\))?([0-9]+)?$', 1), regexp_extract(tok, '^([A-Za-z]+)(\(([A-Za-z0-9]+)\))?([0-9]+)?$', 3),
    regexp_extract(tok, '^([A-Za-z]+)(\(([A-Za-z0-9]+)\))?([0-9]+)?$', 4)], lambda x: x <> '')
  ELSE regexp_extract_all(tok, '[A-Za-z]+|[0-9]+') END, '|') AS atoms
FROM (SELECT id, regexp_extract(title, '^\s*([^\s\-]+)', 1) AS tok FROM {titles})""")
def _(t: DataFrame) -> DataFrame:
    return t.select("id", join(T.label_atoms(F.regexp_extract("title", r"^\s*([^\s\-]+)", 1))).alias("atoms"))


@query("str_06_label", "titles", "WITH " + LABELS.strip() + " SELECT id, array_to_string(label, '|') AS label FROM labeled")
def _(t: DataFrame) -> DataFrame:
    return t.select("id", join(T.label(F.col("title"))).alias("label"))


DEPTH = rf"""CASE
  WHEN regexp_matches(trim(title), '^(?:ال)?(?:باب|فصل|قسم|جزء){END}') THEN 1
  WHEN regexp_matches(trim(title), '^(?:ال)?مادة{END}') THEN 2
  WHEN regexp_matches(trim(title), '(?i)^Abschnitt\s+[A-Z]?[0-9]') THEN 2
  WHEN regexp_matches(trim(title), '(?i)^(?:Teil|Anhang|Kapitel|Abschnitt){END}') THEN 1
  WHEN regexp_matches(trim(title), '^[A-Z][0-9]+-[0-9]+(\.[0-9]+)?([ \t]|$)') THEN CASE WHEN contains(regexp_extract(trim(title), '^(\S+)', 1), '.') THEN 4 ELSE 3 END
  WHEN regexp_matches(trim(title), '^[A-Z](\.[0-9]+)+([ \t.:]|$)') THEN 1 + length(regexp_replace(regexp_extract(trim(title), '^([A-Z](?:\.[0-9]+)+)(?:[ \t.:]|$)', 1), '[^.]', '', 'g'))
  WHEN regexp_matches(trim(title), '^(§\s*)?[0-9]+(\.[0-9]+)+([ \t.:]|$)') THEN 1 + length(regexp_replace(regexp_extract(trim(title), '^((?:§\s*)?[0-9]+(?:\.[0-9]+)+)(?:[ \t.:]|$)', 1), '[^.]', '', 'g'))
END"""


@query("str_07_numbering_depth", "titles", f"SELECT id, CAST({DEPTH} AS INT) AS depth FROM {{titles}}")
def _(t: DataFrame) -> DataFrame:
    return t.select("id", T.numbering_depth(F.col("title")).alias("depth"))


@query("str_08_fold", "titles", "SELECT id, replace(title, '‑', '‐') AS folded FROM {titles}")
def _(t: DataFrame) -> DataFrame:
    return t.select("id", split.folded("title").alias("folded"))


@query("str_09_ordinal", "titles", r"""
SELECT id, array_to_string(list_transform(string_split(translate(d, '٠١٢٣٤٥٦٧٨٩', '0123456789'), '.'), lambda x: CAST(CAST(x AS INT) AS VARCHAR)), '|') AS parts
FROM (SELECT id, regexp_extract(title, '([0-9٠-٩]+(?:\.[0-9٠-٩]+)*)', 1) AS d FROM {titles}) WHERE d <> ''""")
def _(t: DataFrame) -> DataFrame:
    d = t.select("id", F.regexp_extract("title", r"([0-9٠-٩]+(?:\.[0-9٠-٩]+)*)", 1).alias("d")).filter("d <> ''")
    return d.select("id", join(T.ordinal(F.col("d")).cast("array<string>")).alias("parts"))


CELLS = "list_transform(string_split(regexp_replace(regexp_replace(trim(line), '^\\|', ''), '\\|$', ''), '|'), lambda c: trim(c))"


@query("str_10_pipe_cells", "order_lines", f"SELECT doc_id, pos0, k, array_to_string({CELLS}, '~') AS cells FROM {{order_lines}}")
def _(t: DataFrame) -> DataFrame:
    return t.select("doc_id", "pos0", "k", F.array_join(T.pipe_cells(F.col("line")), "~").alias("cells"))


@query("str_11_row_record", "order_lines", f"""
SELECT doc_id, k, 'order: ' || c[1] || '; status: ' || c[2] || '; col3: ' || c[3] AS record FROM (SELECT doc_id, k, {CELLS} AS c FROM {{order_lines}} WHERE pos0 = 2)""")
def _(t: DataFrame) -> DataFrame:
    headers = F.array(F.lit("order"), F.lit("status"))
    return t.filter("pos0 = 2").select("doc_id", "k", T.row_record(headers, T.pipe_cells(F.col("line"))).alias("record"))


@query("str_12_without_fences", "titles", r"""
SELECT id, trim(regexp_replace(regexp_replace('```json' || chr(10) || trim(title) || chr(10) || '```', '^```[a-zA-Z]*\s*', ''), '\s*```$', '')) AS body FROM {titles}""")
def _(t: DataFrame) -> DataFrame:
    x = F.concat(F.lit("```json\n"), T.strip(F.col("title")), F.lit("\n```"))
    return t.select("id", T.without_fences(x).alias("body"))


OCR = rf"""
SELECT id, CASE WHEN trim(x) = '' OR a + l = 0 THEN 'deu|eng' WHEN a >= 0.15::DOUBLE * (a + l) AND l >= 0.10::DOUBLE * (a + l) THEN 'ara|eng' WHEN a >= 0.15::DOUBLE * (a + l) THEN 'ara'
  WHEN a >= 0.03::DOUBLE * (a + l) THEN 'ara|eng' WHEN regexp_matches(x, '[äöüÄÖÜß]') THEN 'deu|eng' ELSE 'eng' END AS langs
FROM (SELECT *, len(regexp_extract_all(x, '{AR}')) AS a, len(regexp_extract_all(x, '[A-Za-zÀ-ɏ]')) AS l FROM
  (SELECT id, title AS x FROM {{titles}} UNION ALL SELECT doc_id + 10000000, text FROM {{documents}}))"""


@query("str_13_ocr_languages", ("titles", "documents"), OCR)
def _(t: DataFrame, d: DataFrame) -> DataFrame:
    x = t.select("id", F.col("title").alias("x")).union(d.select(F.col("doc_id") + 10000000, "text"))
    return x.select("id", join(T.ocr_languages(F.col("x"))).alias("langs"))


@query("str_14_names", "objects", r"""
SELECT key, regexp_extract(key, '([^/]*)$', 1) AS base, lower(regexp_extract(key, '(\.[^./]+)$', 1)) AS suffix, regexp_replace(regexp_extract(key, '([^/]*)$', 1), '\.[^.]+$', '') AS stem FROM {objects}""")
def _(t: DataFrame) -> DataFrame:
    k = F.col("key")
    return t.select("key", T.basename(k).alias("base"), T.suffix(k).alias("suffix"), T.stem(k).alias("stem"))


@query("str_16_mask", "turn_nodes", """
SELECT doc_id, ord, '{"title":"masked","pages":[' || coalesce(CAST(start_index AS VARCHAR), 'null') || ',' || coalesce(CAST(end_index AS VARCHAR), 'null') || '],"parts":[{"text":' || CASE WHEN ord % 2 = 0 THEN '"masked"' ELSE 'null' END || ',"last":' || CASE WHEN ord > 3 THEN 'true' ELSE 'false' END || '}],"by":{"' || title || '":"masked"}}' AS body
FROM {turn_nodes}""")
def _(t: DataFrame) -> DataFrame:
    part = F.struct(F.when(F.col("ord") % 2 == 0, F.coalesce("text", F.lit(""))).alias("text"), (F.col("ord") > 3).alias("last"))
    deep = t.select("doc_id", "ord", F.struct("title", F.array("start_index", "end_index").alias("pages"), F.array(part).alias("parts"), F.create_map("title", F.coalesce("text", F.lit(""))).alias("by")).alias("x"))
    return deep.select("doc_id", "ord", F.to_json(T.mask(F.col("x"), deep.schema["x"].dataType), {"ignoreNullFields": "false"}).alias("body"))


# -- filters -----------------------------------------------------------------------------------------
@query("flt_05_same_title", "outline_heads", r"""
WITH k AS (SELECT *, regexp_replace(lower(title), '[^a-z0-9]', '', 'g') AS a, regexp_replace(lower(left(title, 9)), '[^a-z0-9]', '', 'g') AS b FROM {outline_heads})
SELECT doc_id, ord, a <> '' AND b <> '' AND (a = b OR (least(length(a), length(b)) >= 8 AND contains(CASE WHEN length(a) <= length(b) THEN b ELSE a END, CASE WHEN length(a) <= length(b) THEN a ELSE b END))) AS same FROM k
""")
def _(t: DataFrame) -> DataFrame:
    return t.select("doc_id", "ord", T.same_title(T.title_key(F.col("title")), T.title_key(F.substring("title", 1, 9))).alias("same"))


@query("flt_07_number_cell", "titles", r"SELECT id, regexp_matches(trim(title), '^[0-9٠-٩][0-9٠-٩\s/\-.:,]*$') AS is_number FROM {titles}")
def _(t: DataFrame) -> DataFrame:
    return t.select("id", T.is_number_cell(F.col("title")).alias("is_number"))


@query("flt_08_table_rows", "order_lines", f"""
SELECT doc_id, pos0, k, contains(line, '|') AS piped, contains(line, '|') AND len(list_filter({CELLS}, lambda c: NOT (regexp_matches(c, '^[-: ]+$') AND contains(c, '-')))) = 0 AS separator FROM {{order_lines}}""")
def _(t: DataFrame) -> DataFrame:
    x = F.col("line")
    return t.select("doc_id", "pos0", "k", T.is_pipe_row(x).alias("piped"), T.is_separator_row(x).alias("separator"))


@query("flt_09_frontmatter", "documents", r"""
SELECT doc_id, length(x) > 0 AND len(regexp_extract_all(x, '[.․…]{4,}')) >= length(x) / 1000.0 AND o < 0.1 * (length(x) / 1000.0) AND regexp_matches(x, '[A-Za-z]{20,}') AS frontmatter
FROM (SELECT doc_id, text || CASE WHEN doc_id % 2 = 0 THEN ' ....... 12 Bibliographicalreferences' ELSE '' END AS x, len(regexp_extract_all(text, '§')) AS o FROM {documents})""")
def _(t: DataFrame) -> DataFrame:
    x = F.concat("text", F.when(F.col("doc_id") % 2 == 0, " ....... 12 Bibliographicalreferences").otherwise(""))
    return t.select("doc_id", T.frontmatter(x, T.count(F.col("text"), "§")).alias("frontmatter"))


@query("flt_12_headroom", "events", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN true ELSE value >= 50 END AS go FROM {events}")
def _(t: DataFrame) -> DataFrame:
    return t.select("event_id", models.headroom(F.when(F.col("event_id") % 5 != 0, F.col("value")), F.lit(50)).alias("go"))


# -- sets, arrays, maps, times -------------------------------------------------------------------------
@query("set_01_suffix_union", "documents", "SELECT doc_id, array_to_string(list_sort(list_distinct(" + str(list(store.BATCH_SUFFIXES)) + " || ['.' || lang, '.md'])), '|') AS suffixes FROM {documents}")
def _(t: DataFrame) -> DataFrame:
    own = F.array(F.concat(F.lit("."), F.col("lang")), F.lit(".md"))
    return t.select("doc_id", join(store.suffix_union(F.array(*map(F.lit, store.BATCH_SUFFIXES)), own)).alias("suffixes"))


@query("set_03_ordered_union", "documents", "SELECT doc_id, CASE lang WHEN 'de' THEN 'deu|eng' WHEN 'en' THEN 'eng' ELSE lang || '|deu|eng' END AS langs FROM {documents}")
def _(t: DataFrame) -> DataFrame:
    own = F.when(F.col("lang") == "de", F.array(F.lit("deu"))).when(F.col("lang") == "en", F.array(F.lit("eng"))).otherwise(F.array("lang"))
    more = F.when(F.col("lang") == "en", F.array(F.lit("eng"))).otherwise(F.array(F.lit("deu"), F.lit("eng")))
    return t.select("doc_id", join(F.array_distinct(F.concat(own, more))).alias("langs"))


@query("set_05_append_new", "conversations", """
WITH a AS (SELECT conv_id, list(role ORDER BY turn) AS have FROM {conversations} GROUP BY 1)
SELECT conv_id, array_to_string(have || list_filter(['system', 'tool', 'user'], lambda x: NOT list_contains(have, x)), '|') AS roles FROM a""")
def _(t: DataFrame) -> DataFrame:
    have = t.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("have"))
    more = F.array(*map(F.lit, ("system", "tool", "user", "tool")))
    return have.select("conv_id", join(flat.append_new(F.col("have"), more)).alias("roles"))


@query("set_07_collapse_names", "uploads", "SELECT DISTINCT filename FROM {uploads}")
def _(t: DataFrame) -> DataFrame:
    return t.select("filename").dropDuplicates()


@query("arr_01_prefixes", "titles", "WITH " + LABELS.strip() + """
SELECT id, array_to_string(list_slice(label, 1, len(label) - 1), '|') AS prefix, len(list_filter(list_slice(label, 2, len(label)), lambda a: NOT regexp_matches(a, '^[0-9]+$'))) = 0 AS digits
FROM labeled WHERE len(label) > 1""")
def _(t: DataFrame) -> DataFrame:
    lab = t.select("id", T.label(F.col("title")).alias("label")).filter(F.size("label") > 1)
    tail = F.slice("label", F.lit(2), F.size("label") - 1)
    return lab.select("id", join(F.slice("label", F.lit(1), F.size("label") - 1)).alias("prefix"), F.forall(tail, lambda a: a.rlike("^[0-9]+$")).alias("digits"))


@query("arr_02_pad_rows", "titles", r"SELECT id, array_to_string(list_resize(string_split(trim(title), ' '), 6, ''), '~') AS cells FROM {titles}")
def _(t: DataFrame) -> DataFrame:
    row = F.split(F.trim("title"), " ", -1)
    padded = F.concat(row, F.array_repeat(F.lit(""), F.greatest(F.lit(6) - F.size(row), F.lit(0))))
    return t.select("id", F.array_join(F.slice(padded, 1, 6), "~").alias("cells"))


@query("map_01_fallback_name", "objects", "SELECT key, coalesce(doc_name, filename, doc_id) AS name FROM {objects}")
def _(t: DataFrame) -> DataFrame:
    return t.select("key", F.coalesce("doc_name", "filename", "doc_id").alias("name"))


@query("jsn_01_round_trip", "turn_nodes", "SELECT doc_id, ord, title, start_index, '{\"title\":\"' || title || '\",\"start_index\":' || coalesce(CAST(start_index AS VARCHAR), 'null') || '}' AS body FROM {turn_nodes}")
def _(t: DataFrame) -> DataFrame:
    body = F.to_json(F.struct("title", "start_index"), {"ignoreNullFields": "false"})
    back = F.from_json(F.col("body"), "title string, start_index int")
    return t.select("doc_id", "ord", body.alias("body")).select("doc_id", "ord", "body", back["title"].alias("title"), back["start_index"].alias("start_index"))


@query("jsn_02_lenient_json", "titles", """
SELECT id, CASE WHEN id % 4 = 0 THEN 'all' ELSE CAST(id AS VARCHAR) END AS prefilter, id % 4 > 0 AS readable FROM {titles}""")
def _(t: DataFrame) -> DataFrame:
    said = F.when(F.col("id") % 4 == 0, F.lit("not json")).otherwise(F.concat(F.lit('```json\n{"ids": ["'), F.col("id").cast("string"), F.lit('"]}\n```')))
    ids = T.model_ids(said, "ids")
    return t.select("id", F.coalesce(F.get_json_object(ids, "$[0]"), F.lit("all")).alias("prefilter"), ids.isNotNull().alias("readable"))


@query("hsh_01_sha256", "documents", "SELECT doc_id, sha256(text) AS sha256 FROM {documents}")
def _(t: DataFrame) -> DataFrame:
    return t.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))


@query("mth_01_clamp", "lineitem", "SELECT l_orderkey, l_linenumber, greatest(1, least(6, l_linenumber + CAST(l_quantity AS INT) % 5 - 1)) AS level FROM {lineitem}")
def _(t: DataFrame) -> DataFrame:
    return t.select("l_orderkey", "l_linenumber", T.clamp_level(F.col("l_linenumber") + F.col("l_quantity").cast("int") % 5 - 1).alias("level"))


@query("mth_02_memory_units", "orders", "SELECT o_orderkey, o_orderkey * 1024 AS bytes, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey // 1024 ELSE o_orderkey END AS kib FROM {orders}")
def _(t: DataFrame) -> DataFrame:
    line = F.concat(F.lit("MemAvailable:   "), F.col("o_orderkey").cast("string"), F.lit(" kB"))
    number = F.regexp_extract(line, r"MemAvailable:\s+(\d+) kB", 1).cast("long")
    rss = F.when(F.col("o_orderkey") % 2 == 0, F.floor(F.col("o_orderkey") / 1024)).otherwise(F.col("o_orderkey"))  # bytes on one system, KiB on the other
    return t.select("o_orderkey", (number * 1024).alias("bytes"), rss.alias("kib"))


@query("fmt_13_languages", "documents", "SELECT doc_id, CASE lang WHEN 'de' THEN 'deu' WHEN 'en' THEN 'eng' ELSE 'deu|eng' END AS langs FROM {documents}")
def _(t: DataFrame) -> DataFrame:
    own = F.when(F.col("lang") == "de", F.array(F.lit("deu"))).when(F.col("lang") == "en", F.array(F.lit("eng"))).otherwise(F.array("lang"))
    return t.select("doc_id", join(T.supported_languages(own, F.array(F.lit("eng"), F.lit("deu")))).alias("langs"))


@query("agg_07_script_letters", "documents", rf"SELECT doc_id, CAST(len(regexp_extract_all(text, '{AR}')) AS BIGINT) AS arabic, CAST(len(regexp_extract_all(text, '[A-Za-zÀ-ɏ]')) AS BIGINT) AS latin FROM {{documents}}")
def _(t: DataFrame) -> DataFrame:
    return t.select("doc_id", T.count(F.col("text"), T.ARABIC).cast("long").alias("arabic"), T.count(F.col("text"), T.LATIN).cast("long").alias("latin"))


@query("win_08_greedy_gap", "orders", """
WITH spots AS (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS found FROM {orders} GROUP BY 1)
SELECT o_custkey, array_to_string(list_reduce(list_transform(found, lambda x: [x]), lambda kept, x: CASE WHEN x[1] - kept[len(kept)] >= 500 THEN kept || x ELSE kept END), '|') AS kept FROM spots""")
def _(t: DataFrame) -> DataFrame:
    spots = t.groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.col("o_orderkey").cast("int"))).alias("at"))
    return spots.select("o_custkey", join(split.greedy_gap_column(F.col("at"), 500).cast("array<string>")).alias("kept"))


@query("tree_02_relevel_numbering", "titles", f"""
SELECT id, CASE WHEN d IS NULL THEN '#### ' || title ELSE repeat('#', greatest(1, least(6, d))) || ' ' || trim(title) END AS line
FROM (SELECT id, title, CAST({DEPTH} AS INT) AS d FROM (SELECT id, trim(title) AS title FROM {{titles}}))""")
def _(t: DataFrame) -> DataFrame:
    return t.select("id", levels.relevel_by_numbering(F.concat(F.lit("#### "), F.trim("title"))).alias("line"))


NAMED = "'f' || CAST(doc_id AS VARCHAR) || ['.md', '.PDF', '.xyz', '', '.tar.Html'][CAST(doc_id % 5 AS INT) + 1]"
OK_LIST = ", ".join(f"'{x}'" for x in sorted(store.SUFFIXES))


@query("src_02_supported", "documents", f"""
SELECT name, ext, ext IN ({OK_LIST}) AS ok, CASE WHEN ext NOT IN ({OK_LIST}) THEN 'unsupported suffix ' || ext || '; supported: {", ".join(sorted(store.SUFFIXES))}' END AS error
FROM (SELECT {NAMED} AS name, lower(regexp_extract({NAMED}, '(\\.[^.]+)$', 1)) AS ext FROM {{documents}})""")
def _(t: DataFrame) -> DataFrame:
    ends = F.array(*map(F.lit, (".md", ".PDF", ".xyz", "", ".tar.Html")))
    return store.supported(t.select(F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.get(ends, (F.col("doc_id") % 5).cast("int"))).alias("name")), "name")