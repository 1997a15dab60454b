"""Documents without a hierarchy: blocks, tables that go on, quality, views."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions import text as T

TABLE = "struct<headers:array<string>,rows:array<array<string>>>"
BLOCKS = "array<struct<role:string,text:string,headers:array<string>,rows:array<array<string>>>>"

_NUMBERED = re.compile(r"\s*\d+(?:\.\d+)*[.)]?(?:\s+\S.*)?$")
_TITLE = re.compile(r"\s{0,3}#{1,6}\s+(.+?)\s*#*\s*$")


def _cells(line: str) -> list[str]:
    s = line.strip()
    return [c.strip() for c in s.removeprefix("|").removesuffix("|").split("|")] if s != "|" else [""]


def _separator(line: str) -> bool:
    return "|" in line and all("-" in c and not c.strip("-: ") for c in _cells(line))


def parse_blocks(md: str | None) -> list[dict]:
    """The exact line machine: which line is a header depends on what tables before it consumed."""
    out: list[dict] = []
    prose: list[str] = []
    table: dict | None = None

    def put(role: str, text: str) -> None:
        out.append({"role": role, "text": text, "headers": None, "rows": None})

    def end_prose() -> None:
        if text := " ".join(prose).strip():
            put("prose", text)
        prose.clear()

    lines = (md or "").splitlines()
    skip = False
    for line, after in zip(lines, [*lines, ""][1:], strict=True):
        if skip:
            skip = False
            continue
        piped = "|" in line and line.strip() != ""
        if table is not None and piped and not _separator(line):
            table["rows"].append(_cells(line))
            continue
        table = None
        if not line.strip():
            end_prose()
        elif piped and _separator(after):
            end_prose()
            table = {"role": "table", "text": None, "headers": _cells(line), "rows": [_cells(line)]}
            out.append(table)
            skip = True
        elif m := _TITLE.match(line):
            end_prose()
            put("title", m[1].strip())
        elif _NUMBERED.match(line):
            end_prose()
            put("kv", line.strip())
        else:
            prose.append(line.strip())
    end_prose()
    return out


def blocks(docs: DataFrame) -> DataFrame:
    """doc_id, md to doc_id, blocks, by the line machine (Arrow batches)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "blocks": [parse_blocks(t) for t in b["md"]]})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "md").mapInPandas(run, f"doc_id {kind}, blocks {BLOCKS}")


def signals(blocks_: Column) -> Column:
    """The roles that decide a class, each once, in the order in which they appear."""
    return F.array_intersect(F.transform(blocks_, lambda b: b["role"]), F.array(*map(F.lit, ("table", "kv", "prose"))))


def content_class(blocks_: Column) -> Column:
    roles = signals(blocks_)
    return (
        F.when(F.size(roles) > 1, F.lit("flat_mixed"))
        .when(F.array_contains(roles, "table"), F.lit("flat_table"))
        .when(F.array_contains(roles, "kv"), F.lit("flat_kv"))
        .otherwise(F.lit("flat_prose"))
    )


def data_rows(rows: Column) -> Column:
    return F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0)))


def continues(anchor: Column, nxt: Column) -> Column:
    """Whether a table continues the one before: as many data rows, a label column there, numbers only here."""
    n = F.size(anchor["rows"]) - 1
    return (
        (n == F.size(nxt["rows"]) - 1)
        & (n > 0)
        & F.exists(anchor["headers"], lambda h: ~T.is_number_cell(h))
        & (F.size(nxt["headers"]) > 0)
        & F.forall(nxt["headers"], T.is_number_cell)
    )


def merge_tables(anchor: Column, nxt: Column) -> Column:
    """Columns of the continuation joined on by row position; right-to-left tables get them between
    labels and numbers."""
    rtl = T.table_is_rtl(anchor["headers"], anchor["rows"])

    def join(a: Column, b: Column) -> Column:
        number = lambda i: F.coalesce(T.is_number_cell(F.get(anchor["headers"], i)), F.lit(False))
        full = lambda keep: F.filter(
            F.transform(anchor["headers"], lambda h, i: F.when(keep(i), F.coalesce(F.get(a, i), F.lit("")))), lambda x: x.isNotNull()
        )
        return F.when(rtl, F.concat(full(lambda i: ~number(i)), b, full(number))).otherwise(F.concat(a, b))

    headers = join(anchor["headers"], nxt["headers"])
    rows = F.zip_with(anchor["rows"], nxt["rows"], join)
    return F.struct(headers.alias("headers"), rows.alias("rows"))


def stitch(blocks_: Column) -> Column:
    """Every table takes in the continuations that follow it directly."""

    def step(done: Column, b: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        both = (F.size(done) > 0) & (last["role"] == "table") & (b["role"] == "table") & continues(last, b)
        m = merge_tables(last, b)
        merged = F.struct(last["role"].alias("role"), last["text"].alias("text"), m["headers"].alias("headers"), m["rows"].alias("rows"))
        return F.when(F.coalesce(both, F.lit(False)), F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(merged))).otherwise(
            F.concat(done, F.array(b))
        )

    return F.aggregate(blocks_, F.array().cast(BLOCKS), step)


def quality(rows: Column) -> Column:
    """Share of empty data cells, and whether a whole row or column is empty. Nothing is dropped."""
    data = data_rows(rows)
    cells = F.flatten(data)
    empty = lambda c: T.strip(c) == ""
    n_empty = F.size(F.filter(cells, empty))
    blank_row = F.exists(data, lambda r: (F.size(r) > 0) & F.forall(r, empty))
    width = F.coalesce(F.array_max(F.transform(data, F.size)), F.lit(0))
    column = lambda c: F.filter(F.transform(data, lambda r: F.get(r, c)), lambda x: x.isNotNull())
    blank_column = F.when(
        width > 0, F.exists(F.sequence(F.lit(0), F.greatest(width - 1, F.lit(0))), lambda c: (F.size(column(c)) > 0) & F.forall(column(c), empty))
    ).otherwise(F.lit(False))
    return F.struct(
        F.when(F.size(cells) > 0, n_empty / F.greatest(F.size(cells), F.lit(1))).otherwise(F.lit(0.0)).alias("empty_cell_ratio"),
        (blank_row | blank_column).alias("suspected_miss"),
    )


def flat_documents(docs: DataFrame) -> DataFrame:
    """doc_id, content_class, blocks (stitched)."""
    return blocks(docs).select("doc_id", content_class(F.col("blocks")).alias("content_class"), stitch(F.col("blocks")).alias("blocks"))


def table_records(blocks_: Column) -> Column:
    return F.flatten(F.transform(F.filter(blocks_, lambda b: b["role"] == "table"), lambda b: T.row_records(b["headers"], b["rows"])))


def search_text(blocks_: Column, extra: Column | None = None) -> Column:
    """Records of tables and texts of other blocks, then further records not yet there."""
    parts = F.flatten(
        F.transform(
            blocks_,
            lambda b: F.when(b["role"] == "table", T.row_records(b["headers"], b["rows"])).otherwise(
                F.filter(F.array(b["text"]), lambda t: t.isNotNull() & (t != ""))
            ),
        )
    )
    return F.array_join(append_new(parts, extra) if extra is not None else parts, "\n")


def append_new(have: Column, more: Column) -> Column:
    """Order-preserving: what is there stays, duplicates too; new ones follow once."""
    return F.concat(have, F.array_distinct(F.filter(more, lambda x: ~F.array_contains(have, x))))


def flat_view(docs: DataFrame) -> DataFrame:
    """Flat documents as they are shown: row records flattened; documents with a tree are not here."""
    return docs.filter("content_class IS NOT NULL AND content_class <> ''").withColumn("row_records", table_records(F.col("blocks")))
