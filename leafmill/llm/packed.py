"""Exchanges of packed rows, for operators that find what texts share.

Rows (bucket, kind, doc_id, body, n, digest) carry either arrays packed into one binary, for a bucket
of symbols or of documents, or whole texts. An exchange deals them by bucket and sorts them by bucket
and kind, so that a Python stage sees one bucket after another and, in a bucket, one kind after
another, as a stream: it holds one bucket's arrays and some documents at a time, whatever the size of
the table. The number of buckets grows with the input.

The search for repeated windows has four stages over this exchange:

1. every text names symbols that its windows are sure to hold; a symbol's bucket finds those that
   occur twice and tells the document buckets where;
2. texts meet their repeated symbols, and send the windows that only hold such (candidates) to
   buckets in which equal windows meet;
3. such a bucket finds, of equal windows, all but the earliest;
4. texts meet their repeated windows and lose what those cover.

Symbols are 48 bits: that two symbols share a name costs candidates, not results.

A task gathers its entries until a row has about ROW_ENTRIES of them, so rows stay long however many
buckets there are, and what is sent depends on the texts, not on the size of the table. Equal windows
and symbols are collapsed in what was gathered, so a passage that all documents share sends one entry
for some megabytes of text, and its bucket stays small. Copies of a whole text are found in stage 1
as well: all but the earliest need no windows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "bucket int, kind int, doc_id long, body binary, n long, digest binary"
ARROW = pa.schema(
    [("bucket", pa.int32()), ("kind", pa.int32()), ("doc_id", pa.int64()), ("body", pa.binary()), ("n", pa.int64()), ("digest", pa.binary())]
)
#: Kinds, in the order in which a bucket sees them.
WHOLE, SYMBOLS, ENTRIES, FLAGS, TEXT, RESULT = range(6)
#: A null id; it sorts before all others.
NO_ID = -(2**63)
CHUNK_CHARS = 1 << 19
BUCKET_BYTES = 1 << 22
#: Entries of a row, on average, and entries that a task gathers for that at most.
ROW_ENTRIES, MOST_GATHERED = 48, 1 << 22
BATCH_BYTES = 1 << 23
MOST_BUCKETS = 4_000_000
#: Sizes from here on are Spark's guess at what it doesn't know.
UNKNOWN_BYTES = 1 << 60
#: Buckets of a partition of the exchange, and partitions at most; a task sees one bucket after another.
BUCKETS_A_TASK, MOST_TASKS = 2, 20_000


def buckets_for(docs: DataFrame, text_col: str) -> int:
    """An odd number of buckets of about BUCKET_BYTES of the input as stored; where Spark doesn't know
    how much that is, of its texts."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= UNKNOWN_BYTES:
        size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("binary")))).first()[0] or 0
    return max(8, min(size // BUCKET_BYTES, MOST_BUCKETS)) | 1


class Out:
    """Gathers entries for long rows, collects rows and cuts them into Arrow batches of bounded size."""

    def __init__(self, nb: int) -> None:
        self.rows: list[tuple] = []
        self.size = 0
        self.limit = min(MOST_GATHERED, max(1 << 16, nb * ROW_ENTRIES))
        self.held: dict[str, list] = {}

    def add(self, bucket: int, kind: int, doc_id: int | None = None, body: bytes | None = None, n: int | None = None, digest: bytes | None = None) -> None:
        self.rows.append((bucket, kind, doc_id, body, n, digest))
        self.size += 64 + len(body or b"")

    def gather(self, name: str, then: Callable, *columns: np.ndarray | list, weight: int | None = None) -> None:
        """Hold columns until all that came under this name are enough, or the end; then(*columns) goes on with them."""
        if not len(columns[0]):
            return
        slot = self.held.setdefault(name, [then, [], 0])
        slot[1].append(columns)
        slot[2] += len(columns[0]) if weight is None else weight
        if slot[2] >= self.limit:
            self._settle(name)

    def _settle(self, name: str) -> None:
        then, parts, _ = self.held.pop(name)
        then(*[[x for p in c for x in p] if isinstance(c[0], list) else np.concatenate(c) for c in zip(*parts, strict=True)])

    def deal(self, kind: int, bucket: np.ndarray, *arrays: np.ndarray) -> None:
        """Entries of one kind for their buckets."""
        self.gather(f"kind {kind}", lambda b, *a: deal(self, kind, b, *a), np.asarray(bucket, np.int64), *arrays)

    def flush(self, least: int = 0) -> Iterator[pa.RecordBatch]:
        if not self.rows or self.size < least:
            return
        rows, self.rows, self.size = self.rows, [], 0
        at = size = 0
        for k, row in enumerate(rows, 1):
            size += 64 + len(row[3] or b"")
            if size >= BATCH_BYTES or k == len(rows):
                columns = list(zip(*rows[at:k], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ARROW, strict=True)], schema=ARROW)
                at, size = k, 0

    def finish(self) -> Iterator[pa.RecordBatch]:
        while self.held:
            self._settle(next(iter(self.held)))
        yield from self.flush()


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length, one after another, each as its planes of bytes: those that hardly change
    then compress to nothing in the exchange."""
    return b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes() for a in arrays)


def plane(body: bytes, kind: str, n: int, at: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(body, np.uint8, n * size, at).reshape(size, n).T).view(kind).reshape(n)


def unpack(body: bytes, *kinds: str) -> list[np.ndarray]:
    sizes = [np.dtype(k).itemsize for k in kinds]
    n, at, out = len(body) // sum(sizes), 0, []
    for k, s in zip(kinds, sizes, strict=True):
        out.append(plane(body, k, n, at))
        at += n * s
    return out


def unpack_all(bodies: list[bytes], *kinds: str) -> list[np.ndarray]:
    parts = [unpack(b, *kinds) for b in bodies]
    return [np.concatenate(x) if parts else np.zeros(0, k) for k, x in zip(kinds, zip(*parts, strict=True) if parts else [()] * len(kinds), strict=True)]


SYMBOL_MASK = np.uint64((1 << 48) - 1)


def split48(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return s.astype(np.uint32), (s >> np.uint64(32)).astype(np.uint16)


def join48(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return low.astype(np.uint64) | (high.astype(np.uint64) << np.uint64(32))


def home_kind(nb: int) -> str:
    return "u2" if nb < 1 << 16 else "u4"


def deal(out: Out, kind: int, bucket: np.ndarray, *arrays: np.ndarray) -> None:
    """One row per bucket with that bucket's entries of all arrays."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    cuts = np.nonzero(b[1:] != b[:-1])[0] + 1
    sorted_arrays = [a[order] for a in arrays]
    for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(b)], strict=True):
        out.add(int(b[i]), kind, body=pack(*[a[i:j] for a in sorted_arrays]))


def first_of(ids: np.ndarray, *key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by key, then id; which rows of it begin a key; the key's least id for each row of it."""
    order = np.lexsort((ids, *key[::-1]))
    new = np.ones(len(ids), bool)
    new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in key]) if len(ids) > 1 else True
    head = np.maximum.accumulate(np.where(new, np.arange(len(ids)), 0)) if len(ids) else order
    return order, new, ids[order][head]


def deal_bytes(out: Out, kind: int, bucket: np.ndarray, texts: list[bytes], *arrays: np.ndarray) -> None:
    """As deal, with a byte string per entry: the count, the arrays, the lengths, the bytes compressed."""
    press = zstandard.ZstdCompressor(level=3).compress
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    cuts = np.nonzero(b[1:] != b[:-1])[0] + 1
    for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(b)], strict=True):
        own = order[i:j]
        if len(own):
            body = [texts[k] for k in own.tolist()]
            sizes = np.array([len(x) for x in body], np.uint32)
            out.add(int(b[i]), kind, body=b"".join([np.int64(len(own)).tobytes(), pack(*[a[own] for a in arrays], sizes), press(b"".join(body))]))


def unpack_bytes(bodies: list[bytes], *kinds: str) -> tuple[list[bytes], np.ndarray, ...]:
    plain = zstandard.ZstdDecompressor().decompress
    texts: list[bytes] = []
    parts: list[list[np.ndarray]] = []
    for x in bodies:
        n, at, own = int(np.frombuffer(x, np.int64, 1)[0]), 8, []
        for k in (*kinds, "u4"):
            own.append(plane(x, k, n, at))
            at += n * np.dtype(k).itemsize
        body, at = plain(x[at:]), 0
        for size in own.pop().tolist():
            texts.append(body[at : at + size])
            at += size
        parts.append(own)
    return texts, *[np.concatenate(c) for c in zip(*parts, strict=True)]


def splitmix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that mixes them well."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def squeezed(batches: Iterator[pa.RecordBatch], nb: int) -> Iterator[pa.RecordBatch]:
    """Texts for their document buckets, compressed once for all exchanges."""
    out, press = Out(nb), zstandard.ZstdCompressor(level=3).compress
    for b in batches:
        for i in range(0, b.num_rows, 128):
            part = b.slice(i, 128)
            for d, t in zip(part.column("doc_id").to_pylist(), part.column("body").to_pylist(), strict=True):
                out.add(d % nb, TEXT, d, press(t))
            yield from out.flush(1 << 22)
    yield from out.finish()


def chunks(batches: Iterator[pa.RecordBatch], pressed: bool = False) -> Iterator[list[tuple[int, bytes, bytes]]]:
    """Batches of doc_id, body as lists of documents (id, text, as it came) with about CHUNK_CHARS bytes."""
    got, size = [], 0
    plain = zstandard.ZstdDecompressor().decompress if pressed else bytes
    for b in batches:
        for i in range(0, b.num_rows, 128):
            part = b.slice(i, 128)
            for d, t in zip(part.column("doc_id").to_pylist(), part.column("body").to_pylist(), strict=True):
                got.append((d, plain(t), t))
                size += len(got[-1][1])
                if size >= CHUNK_CHARS:
                    yield got
                    got, size = [], 0
    if got:
        yield got


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """(bucket, kind, rows) in the order of the exchange; a bucket's kind may come in several parts."""
    for b in batches:
        bucket, kind = b.column("bucket").to_numpy(), b.column("kind").to_numpy()
        cuts = np.nonzero((bucket[1:] != bucket[:-1]) | (kind[1:] != kind[:-1]))[0] + 1
        for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows], strict=True):
            if j > i:
                yield int(bucket[i]), int(kind[i]), b.slice(i, j - i)


def exchange(rows: DataFrame, nb: int) -> DataFrame:
    """As many partitions as the input asks for, so that a task stays the same size."""
    return rows.repartition(max(1, min(MOST_TASKS, nb // BUCKETS_A_TASK)), "bucket").sortWithinPartitions("bucket", "kind")


Emit = Iterator[pa.RecordBatch]


def symbols_stage(batches: Iterator[pa.RecordBatch], nb: int, symbols_of: Callable, whole_of: Callable) -> Emit:
    """Stage 1, map. symbols_of(documents) gives symbols and the document index of each."""
    out = Out(nb)

    def symbols(sym: np.ndarray, home: np.ndarray) -> None:
        # Collapse: a symbol that occurs twice here is told to its buckets at once and sent once, marked.
        order = np.argsort(sym, kind="stable")
        s, h = sym[order], home[order]
        first = np.ones(len(s), bool)
        first[1:] = s[1:] != s[:-1]
        twice = ~first
        twice[:-1] |= ~first[1:]
        again, where = s[twice], h[twice]
        if len(again):
            by = np.lexsort((where, again))
            again, where = again[by], where[by]
            new = np.ones(len(again), bool)
            new[1:] = (again[1:] != again[:-1]) | (where[1:] != where[:-1])
            out.deal(FLAGS, where[new], *split48(again[new]))
        out.deal(SYMBOLS, s[first] % np.uint64(nb), *split48(s[first]), h[first], twice[first].astype(np.uint8))

    def whole(a: np.ndarray, z: np.ndarray, ids: np.ndarray) -> None:
        order, new, least = first_of(ids, a, z)
        a, own = a[order], ids[order]
        later = own != least
        out.deal(TEXT, np.mod(own[later], nb), own[later], a[later])
        out.deal(WHOLE, a[new] % np.uint64(nb), a[new], z[order][new], own[new])

    for docs in chunks(batches):
        ids, texts = np.array([d for d, _, _ in docs], np.int64), [t for _, t, _ in docs]
        sym, doc = symbols_of(texts)
        out.gather("symbols", symbols, sym, np.mod(ids, nb).astype(home_kind(nb))[doc])
        a, z, at = whole_of(texts)
        out.gather("whole", whole, a, z, ids[at])
        yield from out.flush(1 << 22)
    yield from out.finish()


def repeated_stage(batches: Iterator[pa.RecordBatch], nb: int) -> Emit:
    """Stage 1, reduce: to document buckets, repeated symbols (SYMBOLS) and later copies (WHOLE)."""
    out = Out(nb)

    def close(whole: list[bytes], syms: list[bytes]) -> None:
        a, z, ids = unpack_all(whole, "u8", "u8", "i8")
        if len(a):
            order, _, least = first_of(ids, a, z)
            later = ids[order] != least
            out.deal(WHOLE, np.mod(ids[order][later], nb), ids[order][later], a[order][later])
        low, high, h, many = unpack_all(syms, "u4", "u2", home_kind(nb), "u1")
        if len(low):
            s = join48(low, high)
            order = np.argsort(s, kind="stable")
            s, h, many = s[order], h[order], many[order]
            new = np.ones(len(s), bool)
            new[1:] = s[1:] != s[:-1]
            group = np.cumsum(new) - 1
            total = np.bincount(group, many.astype(np.int64) + 1)
            hit = total[group] > 1
            out.deal(SYMBOLS, h[hit], *split48(s[hit]))

    now, whole, syms = None, [], []
    for bucket, kind, rows in by_bucket(batches):
        if bucket != now:
            close(whole, syms)
            now, whole, syms = bucket, [], []
            yield from out.flush(1 << 22)
        bodies = rows.column("body").to_pylist()
        if kind in (FLAGS, TEXT):  # told at once; the bucket is a document bucket already
            for x in bodies:
                out.add(bucket, SYMBOLS if kind == FLAGS else WHOLE, body=x)
        else:
            (whole if kind == WHOLE else syms).extend(bodies)
    close(whole, syms)
    yield from out.finish()


def candidates_stage(batches: Iterator[pa.RecordBatch], nb: int, whole_of: Callable, candidates_of: Callable, result_of: Callable) -> Emit:
    """Stage 2: documents meet their repeated symbols. candidates_of(texts, ids, repeated, out, nb) sends
    windows and returns which texts have candidates; the others' results are final."""
    out = Out(nb)
    now: int | None = None
    later, syms = [], []
    ready: tuple[set, np.ndarray] | None = None
    ids: set[int] = set()
    for bucket, kind, rows in by_bucket(batches):
        if bucket != now:
            now, later, syms, ready = bucket, [], [], None
        if kind == WHOLE:
            later.extend(rows.column("body").to_pylist())
        elif kind == SYMBOLS:
            syms.extend(rows.column("body").to_pylist())
        else:
            if ready is None:
                ready = (set(zip(*(x.tolist() for x in unpack_all(later, "i8", "u8")), strict=True)), np.unique(join48(*unpack_all(syms, "u4", "u2"))))
                ids = {d for d, _ in ready[0]}
            copies = ready[0]
            for docs in chunks(iter([rows]), True):
                own = []
                for d, t, raw in docs:
                    if d in ids and (d, int(whole_of([t])[0].sum())) in copies:
                        out.add(bucket, RESULT, d, *result_of(t, None))
                    else:
                        own.append((d, t, raw))
                has = candidates_of([t for _, t, _ in own], np.array([d for d, _, _ in own], np.int64), ready[1], out, nb) if own else []
                for (d, t, raw), h in zip(own, has, strict=True):
                    if h:
                        out.add(bucket, TEXT, d, raw)
                    else:
                        out.add(bucket, RESULT, d, *result_of(t, np.zeros((0, 2), np.int64)))
                yield from out.flush(1 << 22)
    yield from out.finish()


def windows_stage(batches: Iterator[pa.RecordBatch], nb: int, later_of: Callable) -> Emit:
    """Stage 3. later_of(bodies) gives doc, start, length of the repeated stretches of a bucket;
    texts and results pass."""
    out = Out(nb)
    now, entries = None, []

    def close() -> None:
        if entries:
            doc, start, length = later_of(entries)
            out.deal(FLAGS, np.mod(doc, nb), doc, start.astype(np.int64), length.astype(np.int64))

    for bucket, kind, rows in by_bucket(batches):
        if bucket != now:
            close()
            now, entries = bucket, []
            yield from out.flush(1 << 22)
        if kind == ENTRIES:
            entries.extend(rows.column("body").to_pylist())
        else:
            yield from out.flush()
            yield rows
    close()
    yield from out.finish()


def results_stage(batches: Iterator[pa.RecordBatch], nb: int, result_of: Callable) -> Emit:
    """Stage 4: texts meet their repeated stretches (start, length), sorted and not yet merged."""
    out = Out(nb)
    plain = zstandard.ZstdDecompressor().decompress
    now: int | None = None
    flags: list[bytes] = []
    ready: list[np.ndarray] | None = None
    for bucket, kind, rows in by_bucket(batches):
        if bucket != now:
            now, flags, ready = bucket, [], None
        if kind == FLAGS:
            flags.extend(rows.column("body").to_pylist())
        elif kind == RESULT:
            yield rows
        else:
            if ready is None:
                doc, start, length = unpack_all(flags, "i8", "i8", "i8")
                order = np.lexsort((start, doc))
                ready = [doc[order], start[order], length[order]]
            for i in range(0, rows.num_rows, 128):
                part = rows.slice(i, 128)
                for d, t in zip(part.column("doc_id").to_pylist(), part.column("body").to_pylist(), strict=True):
                    a, z = np.searchsorted(ready[0], [d, d + 1] if d < 2**63 - 1 else [d, d]).tolist()
                    z = len(ready[0]) if d == 2**63 - 1 else z
                    out.add(bucket, RESULT, d, *result_of(plain(t), merge(ready[1][a:z], ready[2][a:z])))
                yield from out.flush(1 << 22)
    yield from out.flush()


def merge(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Stretches, sorted by start, as maximal runs (start, end); touching ones are one run."""
    if not len(start):
        return np.zeros((0, 2), np.int64)
    end = np.maximum.accumulate(start + length)
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > end[:-1]
    at = np.nonzero(new)[0]
    return np.stack([start[at], end[np.append(at[1:], len(start)) - 1]], 1)


def find_repeats(
    docs: DataFrame, id_col: str, text_col: str, symbols_of: Callable, whole_of: Callable, candidates_of: Callable, later_of: Callable, result_of: Callable
) -> DataFrame:
    """Rows doc_id, body, n, digest as result_of(text, runs) gives them; runs is None for a later copy. Rows of one id are one document: neither is
    earlier than the other. A null id comes first of all; it is null again in the result."""
    nb = buckets_for(docs, text_col)
    source = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("body"))
    told = exchange(source.mapInArrow(lambda b: symbols_stage(b, nb, symbols_of, whole_of), SCHEMA), nb).mapInArrow(lambda b: repeated_stage(b, nb), SCHEMA)
    texts = source.mapInArrow(lambda b: squeezed(b, nb), SCHEMA)
    sent = exchange(told.union(texts), nb).mapInArrow(lambda b: candidates_stage(b, nb, whole_of, candidates_of, result_of), SCHEMA)
    found = exchange(sent, nb).mapInArrow(lambda b: windows_stage(b, nb, later_of), SCHEMA)
    done = exchange(found, nb).mapInArrow(lambda b: results_stage(b, nb, result_of), SCHEMA)
    return done.select(F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "body", "n", "digest")
