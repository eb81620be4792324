"""Removal of long byte strings that start in more than one place of a corpus.

Method: hash-compared suffix sort. Prefix polynomial hashes and binary search give the longest common
extension of two suffixes in logarithmic time; suffixes are put in order by mergesort with that
comparison, and what the hashes found equal is verified byte by byte.

The suffix array is sparse. Of each window of LENGTH bytes the least of its GRAM-byte hashes names an
anchor; equal windows have the same anchor at the same offset, so only suffixes at anchors with equal
hashes have to be compared. Occurrences whose whole surroundings (all windows that chose the anchor) are
equal form a class and are settled by counting; the suffix sort works on one occurrence of each class.
Classes of a hot anchor are sorted in many groups: by ranges of window offsets, and within a range by the
bytes that all its windows have in common, so that equal windows are in one group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing as H
from .shared import cut, discard, parts, small_batches, union_all

LENGTH = 400
GRAM = 100
#: Bytes that stand for a word where runs of words are looked for.
CODE = 4
#: Bytes of a text whose hashes are in memory at once; longer texts are cut into overlapping segments.
SEGMENT = 8 << 20
#: Classes of one anchor hash that are sorted together; those of more are dealt into groups by BANDS ranges of
#: window offsets and by what all windows of a range have in common.
HOT, BANDS = 4_000, 8
#: Classes of such a group that are sorted together; in larger ones, which are alike but for a few bytes, whole windows are counted.
ALIKE = 20_000
_CLASS = ["ah", "r0", "o1", "o2"]


def _anchors(buf: np.ndarray, doc: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of window starts with one anchor, for texts joined without separators: anchor, first and last start, two hashes."""
    n = len(buf)
    pw = H.powers(H.BASE, n + 1)
    total = np.zeros(n + 1, H.U)
    np.cumsum(H.TABLE[buf] * pw[:n], out=total[1:])
    inv = H.powers(H.inverse(H.BASE), n + 1)
    g = H.mix((total[gram:] - total[:-gram]) * inv[: n - gram + 1])
    m = (g & ~H.U((1 << 28) - 1)) | np.arange(len(g), dtype=H.U)
    span, width = 1, length - gram + 1
    while span * 2 <= width:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    if width > span:
        m = np.minimum(m[: len(m) - (width - span)], m[width - span :])
    q = np.flatnonzero(doc[: n - length + 1] == doc[length - 1 :])
    if not len(q):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, H.U),) * 2
    p = (m[q] & H.U((1 << 28) - 1)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, (p[1:] != p[:-1]) | (np.diff(q) != 1) | (doc[q[1:]] != doc[q[:-1]])])
    last = np.r_[first[1:] - 1, len(q) - 1]
    p, q1, q2 = p[first], q[first], q[last]
    return p, q1, q2, g[p], H.word_hashes(buf, q1, q2 + length)


def _segments(rows: list[bytes], length: int) -> Iterator[tuple[int, int, bytes]]:
    for i, x in enumerate(rows):
        for at in range(0, max(1, len(x) - length + 1), SEGMENT):
            piece = x[at : at + SEGMENT + length - 1] if len(x) > SEGMENT else x
            if len(piece) >= length:
                yield i, at, piece
            if len(x) <= SEGMENT:
                break


def _find_anchors(length: int, gram: int, coded: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, th = H.texts(batch["text"]), batch["th"]
            rows = _coded(rows) if coded else rows
            held: list[tuple[int, int, bytes]] = []

            def flush(held: list, th=th) -> pa.RecordBatch:
                sizes = np.array([len(x) for _, _, x in held])
                which = np.repeat(np.arange(len(held)), sizes)
                begin = np.cumsum(sizes) - sizes
                p, q1, q2, ah, r0 = _anchors(np.frombuffer(b"".join(x for _, _, x in held), np.uint8), which, length, gram)
                seg = which[q1] if len(q1) else q1
                base = np.array([at for _, at, _ in held])[seg] - begin[seg] if len(seg) else seg
                row = np.array([i for i, _, _ in held])[seg] if len(seg) else seg
                return pa.record_batch([th.take(pa.array(row)), pa.array(p + base), pa.array((p - q2).astype(np.int32)), pa.array((p - q1).astype(np.int32)), pa.array(ah.view(np.int64)), pa.array(r0.view(np.int64))], names=["th", "p", "o1", "o2", "ah", "r0"])

            size = 0
            for piece in _segments(rows, length):
                if held and size + len(piece[2]) > H.SLICE:
                    yield flush(held)
                    held, size = [], 0
                held.append(piece)
                size += len(piece[2])
            if held:
                yield flush(held)

    return run


def _contexts(length: int, coded: bool):
    """The bytes around the anchors listed for each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, listed = H.texts(batch["text"]), batch["listed"].to_pylist()
            rows = _coded(rows) if coded else rows
            for a, b in H.slices(rows):
                out: dict[str, list] = {k: [] for k in (*_CLASS, "c", "hot", "ctx")}
                for x, each in zip(rows[a:b], listed[a:b], strict=True):
                    for e in each:
                        for k in (*_CLASS, "c", "hot"):
                            out[k].append(e[k])
                        out["ctx"].append(x[e["p"] - e["o2"] : e["p"] - e["o1"] + length])
                kinds = {"o1": pa.int32(), "o2": pa.int32(), "ctx": pa.binary(), "hot": pa.bool_()}
                yield pa.record_batch([pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()], names=list(out))

    return run


def _prefix_hashes(rows: np.ndarray) -> np.ndarray:
    """Polynomial hashes of all prefixes of each row, modulo two primes that share a word."""
    columns = np.ascontiguousarray(rows.T)
    out = np.zeros((len(columns) + 1, len(rows)), np.int64)
    one, two = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
    for k, column in enumerate(columns):
        x = column.astype(np.int64) + 1
        one = (one * 1_103_515_245 + x) % 2_147_483_647
        two = (two * 1_402_024_253 + x) % 2_147_483_629
        out[k + 1] = one << 31 | two
    return out.T.view(H.U)


class Suffixes:
    """Right-hand contexts (suffixes at the anchors) and reversed left-hand contexts of one batch of classes."""

    def __init__(self, group: np.ndarray, contexts: list[bytes], o2: np.ndarray, length: int, gram: int):
        n, self.reach = len(contexts), length - gram
        self.group, self.length = group, length
        self.matrix = np.zeros((n, self.reach + length), np.uint8)
        self.right = np.zeros(n, np.int64)
        for i, (x, o) in enumerate(zip(contexts, o2.tolist(), strict=True)):
            self.matrix[i, self.reach - o : self.reach - o + len(x)] = np.frombuffer(x, np.uint8)
            self.right[i] = len(x) - o
        self.ahead = _prefix_hashes(self.matrix[:, self.reach :])
        self.behind = _prefix_hashes(self.matrix[:, : self.reach][:, ::-1])

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Longest common prefixes of suffixes, by binary search on prefix hashes."""
        lo, hi = np.zeros(len(i), np.int64), np.minimum(self.right[i], self.right[j])
        while True:
            open_ = lo < hi
            if not open_.any():
                return lo
            mid = (lo + hi + 1) >> 1
            same = self.ahead[i, mid] == self.ahead[j, mid]
            lo, hi = np.where(open_ & same, mid, lo), np.where(open_ & ~same, mid - 1, hi)

    def less(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether suffix i comes before suffix j; a prefix comes first, and equal suffixes compare as not less."""
        at = self.common(i, j)
        inside = at < np.minimum(self.right[i], self.right[j])
        col = self.reach + np.minimum(at, self.length - 1)
        return np.where(inside, self.matrix[i, col] < self.matrix[j, col], self.right[i] < self.right[j])

    def sort(self) -> np.ndarray:
        """Order by group and suffix: a bottom-up mergesort, all merges of a level at once."""
        order = np.argsort(self.group, kind="stable")
        g = self.group[order]
        first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        size = np.diff(np.r_[first, len(g)])
        base, total = np.repeat(first, size), np.repeat(size, size)
        t = np.arange(len(g)) - base
        w = 1
        while w < (size.max() if len(size) else 0):
            live = np.flatnonzero(total > w)
            run = t[live] // w
            other = (run ^ 1) * w
            lo = np.minimum(other, total[live])
            begin, hi = lo.copy(), np.minimum(other + w, total[live])
            me = order[live]
            is_left = run % 2 == 0
            while True:
                open_ = np.flatnonzero(lo < hi)
                if not len(open_):
                    break
                mid = (lo[open_] + hi[open_]) >> 1
                it = order[base[live[open_]] + mid]
                mine = me[open_]
                before = np.where(is_left[open_], self.less(it, mine), ~self.less(mine, it))
                lo[open_], hi[open_] = np.where(before, mid + 1, lo[open_]), np.where(before, hi[open_], mid)
            place = base[live] + (run // 2) * 2 * w + (t[live] - run * w) + (lo - begin)
            merged = order.copy()
            merged[place] = me
            order = merged
            w *= 2
        return order

    def repeated(self, o1: np.ndarray, o2: np.ndarray) -> np.ndarray:
        """For each class and offset: whether the window that begins so far before the anchor has an equal in another class."""
        n = len(self.group)
        order = self.sort()
        adjacent = np.zeros(n, np.int64)
        if n > 1:
            a, b = order[:-1], order[1:]
            adjacent[1:] = np.where(self.group[a] == self.group[b], self.common(a, b), -1)
        out = np.zeros((n, self.reach + 1), bool)
        for o in range(self.reach + 1):
            block = np.cumsum(adjacent < self.length - o)
            fits = (o1[order] <= o) & (o <= o2[order])
            i = order[fits]
            if len(i) < 2:
                continue
            key = H.mix(self.behind[i, o] + block[fits].astype(H.U) * H.STEP)
            _, head, inverse, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
            some = np.flatnonzero(count[inverse] > 1)
            if not len(some):
                continue
            mine, mate = i[some], i[head[inverse[some]]]
            window = self.matrix[:, self.reach - o : self.reach - o + self.length]
            if (window[mine] == window[mate]).all() and (self.group[mine] == self.group[mate]).all():
                out[mine, o] = True
            else:  # a collision: by the bytes themselves
                seen: dict[tuple[int, bytes], list[int]] = {}
                for k in i.tolist():
                    seen.setdefault((int(self.group[k]), window[k].tobytes()), []).append(k)
                for same in seen.values():
                    if len(same) > 1:
                        out[same, o] = True
        return out


def _runs(marked: np.ndarray) -> list[list[int]]:
    edge = np.diff(np.pad(marked.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    out: list[list[int]] = [[] for _ in range(len(marked))]
    for (i, a), (_, b) in zip(np.argwhere(edge == 1).tolist(), np.argwhere(edge == -1).tolist(), strict=True):
        out[i] += [a, b - 1]
    return out


def _settle(length: int, gram: int):
    """Sort the suffixes of whole groups; rows come sorted by group."""

    def settled(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        group, o2, lo, hi = (rows[k].to_numpy() for k in ("grp", "o2", "lo", "hi"))
        marked = Suffixes(group, rows["ctx"].to_pylist(), o2, length, gram).repeated(lo, hi)
        col = np.arange(marked.shape[1])
        marked |= (rows["c"].to_numpy() > 1)[:, None] & (col >= lo[:, None]) & (col <= hi[:, None])
        some = marked.any(axis=1)
        kept = rows.select(_CLASS).filter(pa.array(some))
        yield from kept.append_column("runs", pa.array(_runs(marked[some]), pa.list_(pa.int32()))).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            while len(held) >= 2048:
                group = held["grp"].to_numpy()
                edges = np.flatnonzero(group[1:] != group[:-1]) + 1
                inner = edges[edges <= 4096]
                if not len(edges):
                    break
                end = int(inner[-1]) if len(inner) else int(edges[0])
                yield from settled(held.slice(0, end))
                held = held.slice(end).combine_chunks()
        if held is not None and len(held):
            yield from settled(held)

    return run


def _dealt(length: int, gram: int):
    """A row for each class and range of offsets, grouped by the bytes that all windows of the range have in common."""
    width = -(-(length - gram + 1) // BANDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                row, group, lows, highs = [], [], [], []
                for i, (ah, o1, o2, ctx) in enumerate(zip(*(part[k].to_pylist() for k in ("ah", "o1", "o2", "ctx")), strict=True)):
                    for first in range(o1 // width * width, o2 + 1, width):
                        last = first + width - 1
                        # from where the last of these windows begins to where the first ends; the anchor is at o2
                        digest = hashlib.blake2b(ctx[o2 - first : o2 - last + length], digest_size=8, key=ah.to_bytes(8, "little", signed=True), salt=first.to_bytes(2, "little")).digest()
                        row.append(i)
                        group.append(int.from_bytes(digest, "little", signed=True))
                        lows.append(max(o1, first))
                        highs.append(min(o2, last))
                yield pa.record_batch([*(part[k].take(pa.array(row, pa.int32())) for k in (*_CLASS, "c", "ctx")), pa.array(group, pa.int64()), pa.array(lows, pa.int32()), pa.array(highs, pa.int32())], names=[*_CLASS, "c", "ctx", "grp", "lo", "hi"])

    return run


def _each_window(length: int):
    """Every window of the ranges of offsets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 64):
                part = batch.slice(at, 64)
                found = [(i, o, ctx[o2 - o : o2 - o + length]) for i, (o2, lo, hi, ctx) in enumerate(zip(*(part[k].to_pylist() for k in ("o2", "lo", "hi", "ctx")), strict=True)) for o in range(lo, hi + 1)]
                row = pa.array([x[0] for x in found], pa.int32())
                yield pa.record_batch([*(part[k].take(row) for k in (*_CLASS, "grp")), pa.array([x[1] for x in found], pa.int32()), pa.array([x[2] for x in found], pa.binary())], names=[*_CLASS, "grp", "o", "w"])

    return run


def _coded(rows: list[bytes]) -> list[bytes]:
    """Texts with CODE bytes of hash for each of their words."""
    out = []
    for a, b in H.slices(rows):
        h, row, _, _ = H.words(rows[a:b], H.BLANK)
        bounds = np.searchsorted(row, np.arange(b - a + 1))
        codes = (h >> H.U(32)).astype(np.uint32)
        out += [codes[i:j].tobytes() for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
    return out


def named_texts(docs: DataFrame) -> DataFrame:
    """(th, text): th is the text's MD5."""
    return docs.select(F.unhex(F.md5("text")).alias("th"), "text").where("text is not null")


def repeated_spans(named: DataFrame, length: int = LENGTH, gram: int = GRAM, coded: bool = False) -> DataFrame:
    """(th, begin, end): bytes of named_texts() that lie in a repeated string of so many bytes.

    Spans of one text may overlap or touch. Texts without such a string have no row. coded: all this holds
    for the codes of the texts' words, see CODE.
    """
    spark = named.sparkSession
    small_batches(spark)
    n = parts(spark)
    named = named.where(F.octet_length("text") >= (2 * length // CODE - 1 if coded else length))
    anchors = cut(named.mapInArrow(_find_anchors(length, gram, coded), "th binary, p long, o1 int, o2 int, ah long, r0 long"))
    kind = F.xxhash64("r0", "o1", "o2")
    known = anchors.groupBy("ah").agg(F.count("*").alias("n"), F.min(kind).alias("x"), F.max(kind).alias("y")).where("n > 1")
    known = cut(known.select("ah", F.expr("x < y").alias("several")))  # written, so that a hot hash's anchors can be split in the join
    found = cut(anchors.join(known, "ah"))
    discard(anchors, known)
    whole = found.where("not several").select("th", (F.col("p") - F.col("o2")).alias("begin"), (F.col("p") - F.col("o1") + length).alias("end"))

    classes = found.where("several").groupBy(*_CLASS).agg(F.count("*").alias("c"), F.min(F.struct("th", "p")).alias("at"))
    hot = classes.groupBy("ah").agg(F.count("*").alias("k")).select("ah", (F.col("k") > HOT).alias("hot"))
    listed = classes.join(hot, "ah").groupBy(F.col("at.th").alias("th")).agg(F.collect_list(F.struct(*_CLASS, "c", "hot", F.col("at.p").alias("p"))).alias("listed"))
    one = named.groupBy("th").agg(F.first("text").alias("text"))
    contexts = cut(one.join(listed, "th").select("text", "listed").mapInArrow(_contexts(length, coded), "ah long, r0 long, o1 int, o2 int, c long, hot boolean, ctx binary"))
    fields = "ah long, r0 long, o1 int, o2 int, c long, ctx binary, grp long, lo int, hi int"
    dealt = cut(contexts.where("hot").mapInArrow(_dealt(length, gram), fields))
    alike = cut(dealt.groupBy("grp").agg(F.count("*").alias("k")).where(F.col("k") > ALIKE).select("grp"))
    plain = contexts.where("not hot").select(*_CLASS, "c", "ctx", F.col("ah").alias("grp"), F.col("o1").alias("lo"), F.col("o2").alias("hi"))
    to_sort = plain.unionByName(dealt.join(alike, "grp", "left_anti").select(plain.columns))
    result = "ah long, r0 long, o1 int, o2 int, runs array<int>"
    sorted_ = to_sort.repartition(n, "grp").sortWithinPartitions("grp", *_CLASS).mapInArrow(_settle(length, gram), result)
    runs = sorted_.select(*_CLASS, F.explode(F.expr("transform(sequence(0, size(runs) div 2 - 1), i -> struct(runs[2 * i] as a, runs[2 * i + 1] as b))")).alias("r")).select(*_CLASS, "r.a", "r.b")
    rest = dealt.join(alike, "grp", "left_semi")
    windows = rest.select(*_CLASS, "ctx", "grp", "lo", "hi").mapInArrow(_each_window(length), "ah long, r0 long, o1 int, o2 int, grp long, o int, w binary")
    twice = windows.groupBy("grp", "o", "w").agg(F.count("*").alias("k")).where("k > 1").drop("k")
    by_window = windows.join(twice, ["grp", "o", "w"]).select(*_CLASS, F.col("o").alias("a"), F.col("o").alias("b"))
    copies = rest.where("c > 1").select(*_CLASS, F.col("lo").alias("a"), F.col("hi").alias("b"))
    runs = cut(union_all([runs, by_window, copies]))
    part = found.where("several").join(runs, _CLASS).select("th", (F.col("p") - F.col("b")).alias("begin"), (F.col("p") - F.col("a") + length).alias("end"))
    out = cut(whole.unionByName(part).distinct())
    discard(found, contexts, dealt, alike, runs)
    return out


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, passage: int | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept, n_passage_words) for each row of docs (doc_id, text); kept: the remaining bytes.

    A byte goes if it lies in a string of so many bytes that also starts anywhere else, in any row; rows
    that repeat are different places. A null or short text is kept whole (null as no bytes). n_spans:
    maximal removed runs. Removal may split a character; kept is binary. Texts may be of any length, an
    empty table gives no rows, and other columns are ignored, whatever their names.

    passage: n_passage_words counts the words that lie in a run of so many words that also starts anywhere
    else, however few bytes it has; such a run is found by the same suffix sort over codes of words. It is
    null without this parameter. Nothing is removed for it.
    """
    named = named_texts(docs)
    spans = repeated_spans(named, length, gram).withColumn("coded", F.lit(False))
    if passage:
        runs = repeated_spans(named, CODE * passage, CODE * passage * gram // length, coded=True)
        spans = spans.unionByName(runs.withColumn("coded", F.lit(True)))
    spans = spans.groupBy("th").agg(F.collect_list(F.struct("begin", "end", "coded")).alias("spans"))
    rows = docs.select("doc_id", "text", F.unhex(F.md5("text")).alias("th")).join(spans, "th", "left").select("doc_id", "text", "spans")

    def covered(each: list[dict]) -> int:
        total, end = 0, 0
        for lo, hi in sorted((s["begin"] // CODE, -(-s["end"] // CODE)) for s in each):
            total += max(0, hi - max(lo, end))
            end = max(end, hi)
        return total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, listed = H.texts(batch["text"]), batch["spans"].to_pylist()
            for a, b in H.slices(texts):
                out: dict[str, list] = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept", "n_passage_words")}
                for x, each in zip(texts[a:b], listed[a:b], strict=True):
                    kept, at, n = [], 0, 0
                    end = -1
                    for lo, hi in sorted((s["begin"], s["end"]) for s in each or () if not s["coded"]):
                        if lo > end:
                            n += 1
                            kept.append(x[at:lo])
                        end = max(end, hi)
                        at = end
                    rest = b"".join([*kept, x[at:]])
                    words = covered([s for s in each or () if s["coded"]]) if passage else None
                    for k, v in (("n_bytes", len(x)), ("n_removed", len(x) - len(rest)), ("n_spans", n), ("kept", rest), ("n_passage_words", words)):
                        out[k].append(v)
                yield pa.record_batch([batch["doc_id"].slice(a, b - a), *(pa.array(out[k], pa.int64()) for k in ("n_bytes", "n_removed", "n_spans")), pa.array(out["kept"], pa.binary()), pa.array(out["n_passage_words"], pa.int64())], names=["doc_id", *out])

    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, n_passage_words long")
