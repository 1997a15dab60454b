"""Document store as tables: reading, listing, dedup by content, writing, erasure.

Every artifact is a keyed table (Parquet); a store is a folder with one sub-folder per table. Writes
that replace rows go through a new folder version, so a reader never sees half of one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.functions import text as T

# What can be read.
SUFFIXES = (".pdf", ".md", ".markdown", ".txt", ".docx", ".pptx", ".html", ".xlsx", ".png", ".jpg", ".jpeg", ".tiff", ".tif")
BATCH_SUFFIXES = (".pdf", ".md", ".txt", ".docx", ".pptx", ".html")
TTL_SECONDS = 300


def document_id(filename: Column, sha256: Column) -> Column:
    """Eight hex digits, the same at every retry."""
    return F.substring(F.sha2(F.concat_ws("\x00", filename, sha256), 256), 1, 8)


def read_files(spark: SparkSession, path: str, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """Files below a folder that can be read: path, filename, ext, content, n_bytes, sha256."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    ext = T.suffix(F.col("path"))
    return files.filter(ext.isin(*suffixes)).select(
        "path", T.basename(F.col("path")).alias("filename"), ext.alias("ext"), "content", F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("sha256")
    )


def scan_folder(spark: SparkSession, path: str) -> DataFrame:
    """The offline batch: fewer suffixes, in the order of paths."""
    return read_files(spark, path, BATCH_SUFFIXES).orderBy("path")


def supported(names: DataFrame, column: str = "filename") -> DataFrame:
    """Adds ext, ok, and for the others the message with the sorted list of what can be read."""
    ext = T.suffix(F.col(column))
    known = F.array_join(F.array_sort(F.array(*map(F.lit, SUFFIXES))), ", ")
    ok = ext.isin(*SUFFIXES)
    return names.select("*", ext.alias("ext"), ok.alias("ok"), F.when(~ok, F.concat(F.lit("unsupported suffix "), ext, F.lit("; supported: "), known)).alias("error"))


def suffix_union(a: Column, b: Column) -> Column:
    """Suffixes of two lists, each once, sorted."""
    return F.array_sort(F.array_union(a, b))


def is_flat(objects: DataFrame) -> Column:
    """Whether an object belongs to a flat document: it has a class and isn't a tree."""
    return F.col("content_class").isNotNull() & (F.col("kind") != "tree")


def load(table: DataFrame, doc_id: str) -> DataFrame:
    """The rows of a document; a missing one is one row with an error. Only the key's rows are read."""
    own = table.filter(F.col("doc_id") == doc_id)
    missing = table.sparkSession.range(1).select(F.lit(f"Document not found: {doc_id}").alias("error"))
    return missing.join(own.withColumn("found", F.lit(True)), F.lit(True), "left").withColumn("error", F.when(F.col("found").isNull(), F.col("error"))).drop("found")


def read_through(cache: DataFrame, trees: DataFrame, flats: DataFrame, now: Column | None = None, ttl: int = TTL_SECONDS) -> DataFrame:
    """Each document from the first that has it: a cache entry not too old, its tree, its flat form.
    All three: doc_id, body; the cache also cached_at (seconds)."""
    fresh = cache if now is None else cache.filter(now - F.col("cached_at") <= ttl)
    a = fresh.select("doc_id", "body", F.lit("cache").alias("origin"))
    b = trees.join(a, "doc_id", "left_anti").select("doc_id", "body", F.lit("tree").alias("origin"))
    c = flats.join(trees, "doc_id", "left_anti").join(a, "doc_id", "left_anti").select("doc_id", "body", F.lit("flat").alias("origin"))
    return a.union(b).union(c)


def list_documents(objects: DataFrame) -> DataFrame:
    """objects: key, doc_id, kind (meta, flat, tree), doc_name, filename, source_url, processed_at,
    content_class, readable. One row per id: the sidecar if there is one, else the first object in key
    order; objects that can't be read are left out; missing fields get their defaults."""
    rank = Window.partitionBy("doc_id").orderBy(F.when(F.col("kind") == "meta", 0).otherwise(1), "key")
    best = objects.filter("readable").withColumn("r", F.row_number().over(rank)).filter("r = 1")
    return best.select(
        "doc_id",
        F.coalesce("doc_name", "filename", "doc_id").alias("doc_name"),
        F.coalesce("source_url", F.lit("")).alias("source_url"),
        F.coalesce("processed_at", F.lit("")).alias("processed_at"),
        "content_class",
        "key",
    )


def sidecar(docs: DataFrame) -> DataFrame:
    """Four fields, empty by default, and the class where there is one."""
    fields = [F.coalesce(c, F.lit("")).alias(c) for c in ("doc_id", "doc_name", "source_url", "processed_at")]
    return docs.select(*fields, F.when(F.col("content_class") != "", F.col("content_class")).alias("content_class"))


def content_type(filename: Column) -> Column:
    return F.when(T.suffix(filename) == ".pdf", "application/pdf").otherwise("application/octet-stream")


def unchanged(uploads: DataFrame, hashes: DataFrame, listing: DataFrame) -> DataFrame:
    """uploads: filename, sha256. Those whose name and hash are known and whose name is listed, with
    the first listed document of the name. Equal bytes under another name are new."""
    known = uploads.join(hashes, ["filename", "sha256"], "left_semi")
    first = listing.groupBy(F.col("doc_name").alias("filename")).agg(
        F.min_by("doc_id", "key").alias("doc_id"), F.min_by("content_class", "key").alias("content_class")
    )
    return known.join(first, "filename")


def changed(uploads: DataFrame, hashes: DataFrame, listing: DataFrame) -> DataFrame:
    return uploads.join(unchanged(uploads, hashes, listing).select("filename", "sha256"), ["filename", "sha256"], "left_anti")


def upsert(table: DataFrame, rows: DataFrame, *key: str) -> DataFrame:
    """Rows of the key replaced, others added."""
    return table.join(rows.select(*key), list(key), "left_anti").unionByName(rows)


def hash_cache(uploads: DataFrame) -> DataFrame:
    """filename, sha256 of what was processed last under each name (upload is the order)."""
    return uploads.groupBy("filename").agg(F.max_by("sha256", "upload").alias("sha256"))


def missing_files(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Local files whose name isn't there yet."""
    return local.join(remote.select("name"), "name", "left_anti")


def erase(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """Rewrites of the store without documents, in the order in which they are to be written: uploads,
    tree, flat, meta, cache, hash. Tables that lack a document are left as they are; the hash entry
    goes by the name of its upload. The key 'audit' counts what each step takes away."""
    names = tables["uploads"].join(ids, "doc_id", "left_semi").select("filename").distinct()
    out, audit = {}, None
    for step, name in enumerate(("uploads", "tree", "flat", "meta", "cache", "hash")):
        table = tables[name]
        key, gone = ("filename", names) if name == "hash" else ("doc_id", ids.select("doc_id"))
        out[name] = table.join(gone, key, "left_anti")
        counted = table.join(gone, key, "left_semi").agg(F.count("*").alias("removed")).select(F.lit(step).alias("step"), F.lit(name).alias("target"), "removed")
        audit = counted if audit is None else audit.union(counted)
    return out | {"audit": audit}


def save(df: DataFrame, store: str, name: str, version: int) -> str:
    """Writes a version of a table; readers take the latest one."""
    path = f"{store}/{name}/version={version}"
    df.write.mode("overwrite").parquet(path)
    return path


def latest(spark: SparkSession, store: str, name: str) -> DataFrame:
    """The last version of a table that was written completely; versions that a writer left half done
    lack the success mark and are passed over."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{store}/{name}")
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [f.getPath() for f in fs.listStatus(at)] if fs.exists(at) else []
    done = [int(p.getName().partition("=")[2]) for p in found if p.getName().startswith("version=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    if not done:
        raise FileNotFoundError(f"no version of {name} in {store}")
    return spark.read.parquet(f"{store}/{name}/version={max(done)}")


def invalidate(cache: DataFrame, written: DataFrame) -> DataFrame:
    """The cache without the documents of a version that was just written."""
    return cache.join(written.select("doc_id"), "doc_id", "left_anti")


def staging_key(job_id: Column, filename: Column) -> Column:
    return F.concat(F.lit("uploads/staging/"), job_id, F.lit("/"), T.basename(filename))


def save_tree(store: str, version: int, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """A tree version: its documents and nodes. What is cached of them is out of date: returns the ids."""
    save(docs, store, "tree_doc", version)
    save(nodes, store, "node", version)
    return docs.select("doc_id")


def save_flat(store: str, version: int, docs: DataFrame) -> None:
    """A flat version: documents with their blocks, and the sidecar; never a tree."""
    save(docs.drop("blocks"), store, "flat_doc", version)
    save(docs.select("doc_id", F.posexplode("blocks").alias("block_ord", "block")), store, "block", version)
    save(sidecar(docs), store, "doc_meta", version)
