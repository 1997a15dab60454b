"""Recovering heading depth: shift, numbering prefixes, numbering forms, outlines, and the chain of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import text as T
from leafmill.operators.lines import explode_lines, implode_lines

MARK = "^(#{1,6})(?=\\s|$)"
#: Levels of an outline entry, counted before they are clamped to those of headings.
MAX_OUTLINE = 12
WHOLE = "^#{1,6}[ \\t]+(.*\\S)[ \\t]*$"


def _hash(n: Column) -> Column:
    return F.repeat(F.lit("#"), n.cast("int"))


def max_level(md: Column) -> Column:
    """Deepest heading of a markdown text; 0 without one."""
    marks = F.transform(F.regexp_extract_all(md, F.lit("(?m)^(#{1,6})(?=\\s)"), F.lit(1)), F.length)
    return F.coalesce(F.array_max(marks), F.lit(0))


def heading_count(md: Column) -> Column:
    return T.count(md, "(?m)^#{1,6}(?=\\s)")


def recoverable(md: Column) -> Column:
    return (max_level(md) >= 2) & (heading_count(md) >= 3)


def relevel(md: Column) -> Column:
    """The shallowest heading becomes level one; a scalar expression, without a shuffle."""
    marks = F.transform(F.regexp_extract_all(md, F.lit("(?m)^(#{1,6})(?=\\s)"), F.lit(1)), F.length)
    shift = F.coalesce(F.array_min(marks), F.lit(1)) - 1
    # One pass over the text: inside a transform of its lines, the shift would be found anew for each line.
    own = F.concat(F.lit("(?md)^#{"), shift.cast("string"), F.lit("}(?=#{1,"), (F.lit(6) - shift).cast("string"), F.lit("}[^\\S\\n])"))
    moved = F.regexp_replace(md, own, F.lit(""))
    return F.when(shift > 0, moved).otherwise(md)


def relevel_by_numbering(md: Column) -> Column:
    def line(x: Column) -> Column:
        title = F.regexp_extract(x, WHOLE, 1)
        depth = T.numbering_depth(title)
        return F.when(x.rlike(WHOLE) & depth.isNotNull(), F.concat(_hash(T.clamp_level(depth)), F.lit(" "), title)).otherwise(x)

    return F.array_join(F.transform(F.split(md, "\n", -1), line), "\n")


def containment_depths(titles: DataFrame) -> DataFrame:
    """titles: doc_id, ord, title. Adds label and depth: one more than the longest proper prefix of
    the label that is a label in the document; null without a label. Prefixes are exploded and met
    by a semi-join."""
    own = titles.withColumn("label", T.label(F.col("title")))
    present = own.filter(F.size("label") > 0).select("doc_id", F.col("label").alias("prefix")).distinct()
    longer = own.filter(F.size("label") > 1).select(
        "doc_id", "ord", F.explode(F.transform(F.sequence(F.lit(1), F.size("label") - 1), lambda k: F.slice("label", F.lit(1), k))).alias("prefix")
    )
    found = longer.join(present, ["doc_id", "prefix"], "left_semi").groupBy("doc_id", "ord").agg(F.max(F.size("prefix")).alias("best"))
    return own.join(found, ["doc_id", "ord"], "left").withColumn(
        "depth", F.when(F.size("label") > 0, F.coalesce("best", F.lit(0)) + 1)
    ).drop("best")


def promotions(items: DataFrame) -> DataFrame:
    """items: doc_id, ord, is_heading, text. Text items whose label extends a heading's label by digits
    only: doc_id, ord."""
    own = items.withColumn("label", T.label(T.normalize_dashes(F.coalesce("text", F.lit("")))))
    anchors = own.filter(F.col("is_heading") & (F.size("label") > 0)).select("doc_id", F.col("label").alias("prefix")).distinct()
    tails = own.filter(~F.col("is_heading") & (F.size("label") > 1)).select(
        "doc_id", "ord", "label", F.explode(F.sequence(F.lit(1), F.size("label") - 1)).alias("k")
    )
    digits = F.forall(F.slice("label", F.col("k") + 1, F.size("label") - F.col("k")), lambda a: a.rlike("^\\d+$"))
    extends = tails.filter(digits).select("doc_id", "ord", F.slice("label", F.lit(1), F.col("k")).alias("prefix"))
    return extends.join(anchors, ["doc_id", "prefix"], "left_semi").select("doc_id", "ord").distinct()


def relevel_by_containment(docs: DataFrame) -> DataFrame:
    """doc_id, md to doc_id, md; lines without a label stay as they are."""
    lines = explode_lines(docs)
    heads = lines.filter(F.col("line").rlike(WHOLE)).select("doc_id", F.col("pos").alias("ord"), F.regexp_extract("line", WHOLE, 1).alias("title"))
    depth = containment_depths(heads).filter("depth IS NOT NULL").select("doc_id", F.col("ord").alias("pos"), "title", "depth")
    new = F.coalesce(F.concat(_hash(T.clamp_level(F.col("depth"))), F.lit(" "), F.col("title")), F.col("line"))
    return implode_lines(lines.join(depth, ["doc_id", "pos"], "left").select("doc_id", "pos", new.alias("line")))


def outline_extents(toc: DataFrame, totals: DataFrame) -> DataFrame:
    """toc: doc_id, i, level, title, page. Sections as half-open page ranges: a section ends where the
    next entry of its level or a smaller one begins, in outline order; else behind the last page."""
    following = Window.partitionBy("doc_id").orderBy("i").rowsBetween(1, Window.unboundedFollowing)
    capped = toc.join(totals, "doc_id")
    nxt = {k: F.min(F.when(F.col("level") <= k, F.struct("i", "page"))).over(following) for k in range(1, MAX_OUTLINE + 1)}
    stop = F.coalesce(*[F.when(F.col("level") == k, nxt[k]["page"]) for k in nxt], F.col("total_pages") + 1)
    return capped.select(
        "doc_id", "i", T.clamp_level(F.col("level")).alias("level"), T.title_key(F.col("title")).alias("key"),
        T.collapse_space(T.normalize_dashes(F.col("title"))).alias("raw"), F.col("page").alias("start"), stop.alias("stop"),
    )


def outline_levels(heads: DataFrame, pages: DataFrame, toc: DataFrame, totals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """heads: doc_id, ord, title. pages: doc_id, key, k (from 1), page: the pages of equal titles.

    The k-th heading of a title takes its k-th page (a positional join), the page finds the sections
    that cover it (a range join within the document), and the deepest one decides: the level of a
    matching title, or one more than the deepest. Returns the levels (doc_id, ord, new_level, null
    where nothing is known) and the titles to insert (doc_id, ord of the heading they come before,
    level, line), for sections that no heading matched.
    """
    nth = Window.partitionBy("doc_id", "key").orderBy("ord")
    keyed = heads.withColumn("key", T.title_key(F.col("title"))).withColumn("k", F.row_number().over(nth))
    paged = keyed.join(pages, ["doc_id", "key", "k"], "left")
    sections = outline_extents(toc, totals)
    s = sections.select(F.col("doc_id").alias("s_doc"), "i", F.col("level").alias("s_level"), F.col("key").alias("s_key"), "raw", "start", "stop")
    covers = paged.join(s, (F.col("doc_id") == F.col("s_doc")) & (F.col("start") <= F.col("page")) & (F.col("page") < F.col("stop"))).drop("s_doc")
    covers = covers.withColumn("hit", T.same_title(F.col("key"), F.col("s_key")))
    deepest = F.max(F.struct("s_level"))["s_level"]
    anchor = F.max_by(F.struct("s_level", "i"), F.when(F.col("hit"), F.struct("s_level", -F.col("i"))))
    by_head = covers.groupBy("doc_id", "ord").agg(deepest.alias("deepest"), anchor.alias("anchor"))
    levels = heads.select("doc_id", "ord").join(by_head, ["doc_id", "ord"], "left").select(
        "doc_id", "ord", F.coalesce(F.col("anchor")["s_level"], F.when(F.col("deepest").isNotNull(), T.clamp_level(F.col("deepest") + 1))).alias("new_level"),
        F.col("anchor")["i"].alias("i"),
    )
    matched = levels.filter("i IS NOT NULL").select("doc_id", "i").distinct()
    first = covers.groupBy("doc_id", "i").agg(F.min("ord").alias("ord"), F.first("s_level").alias("level"), F.first("raw").alias("raw"))
    inserts = first.join(matched, ["doc_id", "i"], "left_anti").select(
        "doc_id", "ord", "level", F.concat(_hash(F.col("level")), F.lit(" "), F.col("raw")).alias("line")
    )
    return levels.drop("i"), inserts


def relevel_by_outline(docs: DataFrame, pages: DataFrame, toc: DataFrame, totals: DataFrame) -> DataFrame:
    """doc_id, md to doc_id, md; a document that would stay flat, or has no outline, is unchanged."""
    lines = explode_lines(docs)
    heads = lines.filter(F.col("line").rlike(WHOLE)).select("doc_id", F.col("pos").alias("ord"), F.regexp_extract("line", WHOLE, 1).alias("title"))
    levels, inserts = outline_levels(heads, pages, toc, totals)
    extra = inserts.groupBy("doc_id", "ord").agg(F.transform(F.sort_array(F.collect_list(F.struct("level", "line"))), lambda x: x["line"]).alias("extra"))
    new = lines.join(levels.withColumnRenamed("ord", "pos"), ["doc_id", "pos"], "left").join(extra.withColumnRenamed("ord", "pos"), ["doc_id", "pos"], "left")
    line = F.when(F.col("new_level").isNotNull(), F.concat(_hash(F.col("new_level")), F.lit(" "), F.regexp_extract("line", WHOLE, 1))).otherwise(F.col("line"))
    line = F.array_join(F.concat(F.coalesce("extra", F.array().cast("array<string>")), F.array(line)), "\n")
    done = implode_lines(new.select("doc_id", "pos", line.alias("line"))).withColumnRenamed("md", "new_md")
    return docs.join(done, "doc_id").select("doc_id", F.when(max_level(F.col("new_md")) >= 2, F.col("new_md")).otherwise(F.col("md")).alias("md"))


def recover_depth(docs: DataFrame, pages: DataFrame | None = None, toc: DataFrame | None = None, totals: DataFrame | None = None) -> DataFrame:
    """Dashes, shift, prefixes; while a document is flat, forms; while it still is, the outline. Each
    step runs on what is still flat only."""
    shifted = docs.select("doc_id", relevel(T.normalize_dashes(F.col("md"))).alias("md"))
    nested = relevel_by_containment(shifted)
    formed = nested.select("doc_id", F.when(max_level(F.col("md")) < 2, relevel_by_numbering(F.col("md"))).otherwise(F.col("md")).alias("md"))
    if toc is None:
        return formed
    flat = formed.filter(max_level(F.col("md")) < 2)
    outlined = relevel_by_outline(flat, pages, toc, totals)
    return formed.join(outlined.select("doc_id", F.col("md").alias("o")), "doc_id", "left").select("doc_id", F.coalesce("o", "md").alias("md"))
