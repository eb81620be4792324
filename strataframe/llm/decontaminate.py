"""Benchmark decontamination: which words of a document lie in benchmark windows.

Method: prefix-filtered set join. The shingles of all windows are counted over the documents and ordered
by rarity; as a window must be contained whole, the prefix that has to be joined is its rarest shingle.
Documents are probed for these only; length and positional bounds place the window, and its words are
then compared one by one.

The benchmark is the stated query set: it is taken in blocks of about BLOCK_WORDS words, each of which is
broadcast; documents are never shuffled. With more blocks than one, the documents are written between
blocks with the hits so far.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import hashing as H
from .shared import cut, discard, small_batches, unused

WINDOW = 13
SHINGLE = 5
#: Words of the benchmark in a block: some 30 MB of broadcast index.
BLOCK_WORDS = 1 << 18


def _codes(h: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(max(0, len(h) - size + 1), H.U)
    for j in range(size):
        out = out * H.STEP + h[j : j + len(out)]
    return H.mix(out + H.U(size))


def _lookup(table: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of values that are in the sorted table, and their places there."""
    at = np.searchsorted(table, values)
    at[at == len(table)] = 0
    hit = np.flatnonzero(table[at] == values) if len(table) else np.zeros(0, np.int64)
    return hit, at[hit]


class Windows:
    """Distinct windows of a block of items, their items and their shingles."""

    def __init__(self, item_ids: list[str | None], texts: list[bytes], window: int = WINDOW, shingle: int = SHINGLE):
        self.window = window
        self.items: list[str | None] = item_ids
        lower = [x.translate(H.LOWER) for x in texts]
        h, row, begin, end = H.words(lower, H.NOT_ALNUM)
        joined = b" ".join(lower)
        word = [joined[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
        bounds = np.searchsorted(row, np.arange(len(texts) + 1)).tolist()
        found: dict[bytes, tuple[np.ndarray, set[int]]] = {}
        for item, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            for i in range(a, max(a + 1, b - window + 1) if b > a else a):
                end_ = min(i + window, b)
                found.setdefault(b" ".join(word[i:end_]), (h[i:end_], set()))[1].add(item)
        self.texts = list(found)
        self.rows = [x for x, _ in found.values()]
        self.of = [sorted(x) for _, x in found.values()]
        self.sizes = [min(shingle, len(x)) for x in self.rows]
        self.tables: dict[int, np.ndarray] = {}
        for size in sorted(set(self.sizes)):
            self.tables[size] = np.unique(np.concatenate([_codes(x, size) for x, s in zip(self.rows, self.sizes, strict=True) if s == size]))
        self.index: dict[int, tuple] = {}

    def count(self, rows: list[bytes]) -> dict[int, np.ndarray]:
        """How often each shingle of the windows occurs in rows."""
        out = {size: np.zeros(len(table), np.int64) for size, table in self.tables.items()}
        for a, b in H.slices(rows):
            h, row, _, _ = H.words([x.translate(H.LOWER) for x in rows[a:b]], H.NOT_ALNUM)
            for size, table in self.tables.items():
                if len(h) >= size:
                    hit, at = _lookup(table, _codes(h, size))
                    hit_in = row[hit] == row[hit + size - 1]
                    out[size] += np.bincount(at[hit_in], minlength=len(table))
        return out

    def order(self, counts: dict[int, np.ndarray]) -> None:
        """Index each window by its rarest shingle; windows with a shingle that no document has go."""
        prefix: dict[int, list[tuple[int, int, int]]] = {size: [] for size in self.tables}
        for w, (x, size) in enumerate(zip(self.rows, self.sizes, strict=True)):
            code = _codes(x, size)
            n = counts[size][np.searchsorted(self.tables[size], code)]
            o = int(np.lexsort((code, n))[0])
            if n[o]:
                prefix[size].append((int(code[o]), o, w))
        for size, found in prefix.items():
            if found:
                found.sort()
                code = np.array([x[0] for x in found], H.U)
                keys, first = np.unique(code, return_index=True)
                self.index[size] = keys, np.r_[first, len(found)], np.array([x[1] for x in found]), np.array([x[2] for x in found])
        self.length = np.array([len(x) for x in self.rows], np.int64)
        self.matrix = np.zeros((len(self.rows), self.window), H.U)
        for w, x in enumerate(self.rows):
            self.matrix[w, : len(x)] = x
        self.tables = {}

    def find(self, rows: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(words of each row; and of each occurrence of a window: row, first word, window)"""
        lower = [x.translate(H.LOWER) for x in rows]
        h, row, begin, end = H.words(lower, H.NOT_ALNUM)
        bounds = np.searchsorted(row, np.arange(len(rows) + 1))
        joined, out = None, []
        for size, (keys, first, offsets, windows) in self.index.items():
            if len(h) < size:
                continue
            hit, at = _lookup(keys, _codes(h, size))
            many = first[at + 1] - first[at]
            pos = np.repeat(hit, many)
            each = np.repeat(first[at], many) + np.arange(len(pos)) - np.repeat(np.cumsum(many) - many, many)
            w, doc = windows[each], row[pos]
            start = pos - offsets[each]
            ok = (start >= bounds[doc]) & (start + self.length[w] <= bounds[doc + 1])
            start, w, doc = start[ok], w[ok], doc[ok]
            same = np.ones(len(start), bool)
            for j in range(self.window):
                inside = self.length[w] > j
                same &= ~inside | (h[np.minimum(start + j, len(h) - 1)] == self.matrix[w, j])
            doc, start, w = doc[same], start[same], w[same]
            if len(w):  # hashes agree; the words themselves decide
                joined = b" ".join(lower) if joined is None else joined
                first, last = begin.tolist(), end.tolist()
                same = np.array([b" ".join(joined[first[i] : last[i]] for i in range(a, a + n)) == self.texts[k] for a, n, k in zip(start.tolist(), self.length[w].tolist(), w.tolist(), strict=True)], bool)
            out.append((doc[same], start[same] - bounds[doc[same]], w[same]) if len(w) else (doc, start, w))
        if not out:
            none = np.zeros(0, np.int64)
            return np.diff(bounds), none, none, none
        return np.diff(bounds), *(np.concatenate(x) for x in zip(*out, strict=True))


def _scan(index: Windows, batch: pa.RecordBatch, carried: list[str]) -> Iterator[tuple[int, int, list[np.ndarray], list[set[str]], np.ndarray]]:
    """For slices of the batch: range of rows, merged ranges of hit words, items and words of each row."""
    rows = H.texts(batch["text"])
    old = [batch[x].to_pylist() if x in batch.schema.names else None for x in carried]
    for a, b in H.slices(rows):
        n, doc, start, w = index.find(rows[a:b])
        spans: list[np.ndarray] = [np.frombuffer(x or b"", np.int64).reshape(-1, 2) for x in old[0][a:b]] if old[0] else [np.zeros((0, 2), np.int64)] * (b - a)
        items = [set(x or ()) for x in old[1][a:b]] if old[1] else [set() for _ in range(a, b)]
        order = np.argsort(doc, kind="stable")
        doc, start, w = doc[order], start[order], w[order]
        bound = np.searchsorted(doc, np.arange(b - a + 1))
        for i in np.unique(doc).tolist():
            lo, hi = bound[i], bound[i + 1]
            both = np.concatenate([spans[i], np.stack([start[lo:hi], start[lo:hi] + index.length[w[lo:hi]]], 1)])
            both = both[np.argsort(both[:, 0], kind="stable")]
            reach = np.maximum.accumulate(both[:, 1])
            new = np.flatnonzero(np.r_[True, both[1:, 0] > reach[:-1]])
            spans[i] = np.stack([both[new, 0], reach[np.r_[new[1:] - 1, len(both) - 1]]], 1)
            items[i] |= {index.items[k] for x in np.unique(w[lo:hi]).tolist() for k in index.of[x] if index.items[k] is not None}
        yield a, b, spans, items, n


def _blocks(docs: DataFrame, benchmark: DataFrame, block_words: int, window: int) -> Iterator[tuple[Windows, int, int]]:
    spark = docs.sparkSession
    items = benchmark.where("text is not null").select(F.col("item_id").cast("string").alias("item_id"), "text").distinct()
    words = items.agg(F.sum(F.size(F.split("text", " ")) + F.length("text") / 8)).first()[0] or 0
    n = max(1, -(-int(words) // block_words))
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()
        index = Windows([x["item_id"] for x in part], [x["text"].encode() for x in part], window)
        given = spark.sparkContext.broadcast(index)

        def count(batches: Iterator[pa.RecordBatch], given=given) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                for size, x in given.value.count(H.texts(batch["text"])).items():
                    total[size] = total.get(size, 0) + x
            for size, x in total.items():
                some = np.flatnonzero(x)
                yield pa.record_batch([pa.array(np.full(len(some), size, np.int32)), pa.array(some), pa.array(x[some])], names=["size", "at", "n"])

        counts = {size: np.zeros(len(x), np.int64) for size, x in index.tables.items()}
        if counts:
            for x in docs.select("text").mapInArrow(count, "size int, at long, n long").groupBy("size", "at").agg(F.sum("n").alias("n")).collect():
                counts[x["size"]][x["at"]] = x["n"]
        given.unpersist()
        index.order(counts)
        yield index, k, n


def _run(docs: DataFrame, benchmark: DataFrame, last, schema, block_words: int, window: int) -> DataFrame:
    spark, rows, before = docs.sparkSession, docs, None
    carried = unused(docs, "hit_ranges", "hit_items")
    small_batches(spark)
    for index, k, n in _blocks(docs, benchmark, block_words, window):
        given = spark.sparkContext.broadcast(index)
        if k == n - 1:
            return rows.mapInArrow(lambda batches, given=given: last(given.value, batches, carried), schema)

        def mark(batches: Iterator[pa.RecordBatch], given=given) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                names = [x for x in batch.schema.names if x not in carried]
                for a, b, spans, items, _ in _scan(given.value, batch, carried):
                    part = batch.select(names).slice(a, b - a)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array([x.tobytes() for x in spans], pa.binary()), pa.array([sorted(x) for x in items], pa.list_(pa.string()))], names=[*names, *carried])

        full = T.StructType([*docs.schema.fields, T.StructField(carried[0], T.BinaryType()), T.StructField(carried[1], T.ArrayType(T.StringType()))])
        after = cut(rows.mapInArrow(mark, full))
        discard(before)
        rows = before = after
    raise AssertionError


def contamination(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, items) for each row of docs (doc_id, text).

    Words are maximal runs of ASCII letters and digits, lower-cased, and of other characters beyond ASCII.
    An item's windows are its runs of 13 words, or all its words if they are fewer; items without words
    have none. items: ids, as strings, of items with a window in the text. A null text has no words, an
    item without an id marks words but isn't listed, rows and items may repeat, either table may be empty.
    """

    def last(index: Windows, batches: Iterator[pa.RecordBatch], carried: list[str]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, spans, items, n in _scan(index, batch, carried):
                hit = [int((x[:, 1] - x[:, 0]).sum()) for x in spans]
                yield pa.record_batch([batch["doc_id"].slice(a, b - a), pa.array(n.astype(np.int64)), pa.array(hit, pa.int64()), pa.array([sorted(x) for x in items], pa.list_(pa.string()))], names=["doc_id", "n_words", "n_hit", "items"])

    return _run(docs.select("doc_id", "text"), benchmark, last, "doc_id long, n_words long, n_hit long, items array<string>", block_words, window)


def decontaminate(docs: DataFrame, benchmark: DataFrame, least_share: float = 0.05, block_words: int = BLOCK_WORDS, window: int = WINDOW) -> DataFrame:
    """Rows of docs of whose words less than least_share, or none, lie in a benchmark window; columns stay.

    See contamination() for words and windows. Null and empty texts stay.
    """

    def last(index: Windows, batches: Iterator[pa.RecordBatch], carried: list[str]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [x for x in batch.schema.names if x not in carried]
            for a, b, spans, _, n in _scan(index, batch, carried):
                hit = np.array([int((x[:, 1] - x[:, 0]).sum()) for x in spans])
                yield batch.select(names).slice(a, b - a).filter(pa.array((hit == 0) | (hit < least_share * n - 1e-9)))

    return _run(docs, benchmark, last, docs.schema, block_words, window)
