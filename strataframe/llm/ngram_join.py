"""N-gram Jaccard join: exact links between documents by their word shingles.

Method: universe-partition pigeonhole. Tokens (hashed shingles) are dealt into segments whose number
follows from a document's size band, so that two similar documents have at least one segment with the
same tokens; segment subsets are indexed, with one-deletion neighbourhoods for documents of too many
empty segments, and every candidate is verified exactly.

Before it, two exact reductions over shared-nothing partitions of the token universe: tokens that occur
in one distinct set only can't be in any intersection, and a document of which more than a quarter are
such tokens has no link. Neither loses a link. Tokens travel as packed arrays, one row a (task, partition);
the universe goes through in SLICES passes, each of which reads all documents and sends its part of the tokens.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import hashing as H
from .graph import linked_groups
from .shared import cut, discard, parts, small_batches, union_all

#: Tokens that a task gathers before it sends them on.
FLUSH = 1 << 20
#: Passes over the documents, each with its part of the token universe: the shuffle of all tokens is the peak of the disk.
SLICES = 3
#: Words of a parity sketch's folded form, and so of the shortest sketch.
FOLD = 16
#: Distinct sets that may have a token for it to be rare.
RARE = 64
_PACKED = "p int, doc_id long, n long, fp long, fps binary, ns binary, counts binary, tokens binary"
_NAMES = [x.split()[0] for x in _PACKED.split(", ")]
_SCHEMA = pa.schema([("p", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("fp", pa.int64()), *((x, pa.binary()) for x in _NAMES[4:])])


def _rows(columns: dict[str, list]) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.record_batch([pa.array(columns.get(f.name, [None] * n), f.type) for f in _SCHEMA], schema=_SCHEMA)


def _packed(fps: np.ndarray, ns: np.ndarray, tokens: np.ndarray, p: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row a partition: runs of equal fps are stored once, with their length."""
    if not len(tokens):
        return
    order = np.argsort(p, kind="stable")
    fps, ns, tokens, p = fps[order], ns[order], tokens[order], p[order]
    first = np.flatnonzero(np.r_[True, (fps[1:] != fps[:-1]) | (p[1:] != p[:-1])])
    counts = np.diff(np.r_[first, len(fps)]).astype(np.uint32)
    begin = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
    end = np.r_[begin[1:], len(p)]
    out: dict[str, list] = {k: [] for k in ("p", "fps", "ns", "counts", "tokens")}
    for b, e, i, j in zip(begin.tolist(), end.tolist(), np.searchsorted(first, begin).tolist(), np.searchsorted(first, end).tolist(), strict=True):
        at = first[i:j]
        for k, v in (("p", int(p[b])), ("fps", fps[at].tobytes()), ("ns", ns[at].tobytes()), ("counts", counts[i:j].tobytes()), ("tokens", tokens[b:e].tobytes())):
            out[k].append(v)
    yield _rows(out)


def _unpacked(batches: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    get = lambda name, kind: np.concatenate([np.zeros(0, kind), *(np.frombuffer(x.as_py(), kind) for b in batches for x in b[name] if x.is_valid)])
    counts = get("counts", np.uint32)
    return np.repeat(get("fps", np.int64), counts), np.repeat(get("ns", np.uint32), counts), get("tokens", H.U)


def _tokens_of(sets: Callable[[list[bytes]], list[np.ndarray]], places: int, part: int = 0, slices: int = 1) -> Callable:
    """Of each batch its documents (with the first part of the universe only), and this part's tokens of the distinct sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # of this task's distinct sets; copies in other tasks meet later
        held: list[tuple[int, int, np.ndarray]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                length = np.array([len(x) for _, _, x in held])
                tokens = np.concatenate([x for _, _, x in held])
                fps, ns = (np.repeat(np.array([x[i] for x in held], kind), length) for i, kind in ((0, np.int64), (1, np.uint32)))
                yield from _packed(fps, ns, tokens, (tokens % H.U(places)).astype(np.int32))

        for batch in batches:
            rows, ids = H.texts(batch["text"]), batch["doc_id"].to_pylist()
            for a, b in H.slices(rows):
                docs: dict[str, list] = {k: [] for k in ("p", "doc_id", "n", "fp")}
                for i, (doc_id, tokens) in enumerate(zip(ids[a:b], sets(rows[a:b]), strict=True)):
                    fp = int((H.mix(np.array([H.mix(tokens).sum() + H.U(len(tokens))], H.U))).view(np.int64)[0]) if len(tokens) else 0
                    for k, v in (("p", (fp + i) % places), ("doc_id", doc_id), ("n", len(tokens)), ("fp", fp)):
                        docs[k].append(v)
                    if len(tokens) and fp not in seen:
                        seen.add(fp)
                        own = tokens[(tokens >> H.U(32)) % H.U(slices) == part] if slices > 1 else tokens
                        held.append((fp, len(tokens), own))
                        size += len(own)
                if part == 0:
                    yield _rows(docs)
                if size >= FLUSH:
                    yield from flush()
                    held, size = [], 0
        yield from flush()

    return run


def _shared(places: int) -> Callable:
    """Of a partition of the universe: tokens that two distinct sets or more have. Documents pass.

    The lowest bit of a token tells from here on whether it is rare: in RARE distinct sets at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            docs = batch.filter(batch["n"].is_valid())
            if len(docs):
                yield docs
            packs = batch.filter(batch["tokens"].is_valid())
            if len(packs):
                held.append(packs)
        fps, ns, tokens = _unpacked(held)
        del held
        if not len(tokens):
            return
        order = np.argsort(tokens)
        fps, ns, tokens = fps[order], ns[order], tokens[order]
        first = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]])
        size = np.diff(np.r_[first, len(tokens)])
        several = np.minimum.reduceat(fps, first) != np.maximum.reduceat(fps, first)
        rare = size <= RARE
        for i in np.flatnonzero(several & ~rare).tolist():  # copies in other tasks count once
            rare[i] = len(np.unique(fps[first[i] : first[i] + size[i]])) <= RARE
        keep = np.repeat(several, size)
        tokens = (tokens & ~H.U(1)) | np.repeat(rare, size).astype(H.U)
        fps, ns, tokens = fps[keep], ns[keep], tokens[keep]
        order = np.argsort(fps, kind="stable")
        fps = fps[order]
        yield from _packed(fps, ns[order], tokens[order], (fps % places).astype(np.int32))

    return run


def _parity(places: np.ndarray, n: int) -> np.ndarray:
    """Parity sketch of a set of n tokens, of twice as many bits or more: two sets differ in as many tokens as their sketches in bits, at least."""
    words = FOLD
    while words * 32 < n:
        words *= 2
    odd = np.bincount((places % H.U(64 * words)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _folded(sketch: np.ndarray) -> np.ndarray:
    return np.bitwise_xor.reduce(sketch.reshape(-1, FOLD), axis=0)


def _candidates(share: float) -> Callable:
    """Sets of which enough tokens are shared, with those tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fps, ns, tokens = _unpacked(list(batches))
        if not len(tokens):
            return
        order = np.lexsort((tokens, fps))
        fps, ns, tokens = fps[order], ns[order], tokens[order]
        new = np.r_[True, (fps[1:] != fps[:-1]) | (tokens[1:] != tokens[:-1])]
        fps, ns, tokens = fps[new], ns[new], tokens[new]
        first = np.flatnonzero(np.r_[True, fps[1:] != fps[:-1]])
        count = np.diff(np.r_[first, len(fps)])
        full = count >= share * ns[first]
        keep = np.repeat(full, count)
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(count[full])].astype(np.int32)), pa.array(tokens[keep].view(np.int64)))
        places = H.mix(tokens[keep])
        ends = np.cumsum(count[full])
        sketches = [_parity(places[b - n : b], int(size)) for b, n, size in zip(ends.tolist(), count[full].tolist(), ns[first[full]].tolist(), strict=True)]
        fold = pa.ListArray.from_arrays(pa.array(np.arange(len(ends) + 1, dtype=np.int32) * FOLD), pa.array(np.concatenate([_folded(x) for x in sketches]) if sketches else np.zeros(0, np.int64)))
        sketch = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(x) for x in sketches])].astype(np.int32)), pa.array(np.concatenate(sketches) if sketches else np.zeros(0, np.int64)))
        table = pa.table({"id": pa.array(fps[first[full]]), "n": pa.array(ns[first[full]].astype(np.int64)), "tokens": lists, "fold": fold, "sketch": sketch})
        yield from table.to_batches(max_chunksize=4096)

    return run


def bands(tau: float, most: int = 1 << 31) -> list[int]:
    """Least sizes of the bands: sets of a band are linked within it or with the next one at most."""
    out = [1]
    while out[-1] <= most:
        out.append(int(out[-1] / tau) + 1)
    return out


def _signatures(tau: float, spare: float) -> Callable:
    lows = bands(tau)
    top = [x - 1 for x in lows[1:]]
    apart = lambda both: int((1 - tau) / (1 + tau) * both + 1e-9)  # noqa: E731  most tokens in which two sets of these sizes differ

    def segments(level: int, universe: int, m: int, tokens: np.ndarray) -> tuple[np.ndarray, ...]:
        """By segment that has tokens: sizes, sums of hashes and places; and the hashes in order."""
        mixed = H.mix(tokens + H.U((level + 1 + universe * 1000) * int(H.STEP) % 2**64))
        seg = (mixed % H.U(m)).astype(np.int64)
        order = np.argsort(seg, kind="stable")
        seg, mixed = seg[order], mixed[order]
        first = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]]) if len(seg) else seg
        sums = np.add.reduceat(mixed, first) if len(seg) else mixed
        return np.diff(np.r_[first, len(seg)]), sums, H.U((universe << 60) + (level << 40)) + seg[first].astype(H.U) + H.U(1), mixed

    def of(n: int, tokens: np.ndarray) -> list[tuple[np.ndarray, int, int]]:
        """Keys, the group they are of, and how many of the group's most frequent keys may go."""
        out: list[tuple[np.ndarray, int, int]] = []
        own = int(np.searchsorted(lows, n, "right")) - 1
        rare = tokens[(tokens & H.U(1)) == 1]
        for level in range(max(0, own - 1), own + 1):
            m = int(np.ceil((1 + spare) * (apart(top[level] + top[level + 1]) + 1)))
            differ = apart(n + min(int(n / tau), top[level + 1])) - (n - len(tokens))
            if differ < 0:  # more tokens are unshared than may differ
                continue
            # allocation, from the cheapest: subsets of rare tokens; of all tokens; with one token less; single tokens.
            # Each is exact where more segments hold tokens than can differ, and the next is for the rest.
            size, sums, place, _ = segments(level, 0, m, rare)
            out.append((H.mix(H.mix(sums) + place * H.BASE), level * 4, max(0, len(size) - differ - 1)))
            if len(size) > differ:
                continue
            size, sums, place, mixed = segments(level, 1, m, tokens)
            out.append((H.mix(H.mix(sums) + place * H.BASE), level * 4 + 1, max(0, len(size) - differ - 1)))
            if len(size) > differ:
                continue
            many = np.repeat(size > 1, size)
            out.append((H.mix(H.mix(np.repeat(sums, size) - mixed) + np.repeat(place, size) * H.BASE)[many], level * 4 + 2, 0))
            if len(size) + int((size > 1).sum()) <= differ:
                out.append((H.mix(tokens * H.STEP + H.U(level)), level * 4 + 3, 0))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 512):
                part = batch.slice(a, 512)
                found = [(i, *x) for i, n, t in zip(part["id"].to_pylist(), part["n"].to_pylist(), part["tokens"].to_pylist(), strict=True) for x in of(n, np.array(t, np.int64).view(H.U))]
                if not found:
                    continue
                times = [len(k) for _, k, _, _ in found]
                each = lambda j, kind, found=found, times=times: pa.array(np.repeat(np.array([x[j] for x in found], kind), times))
                yield pa.record_batch([pa.array(np.concatenate([k for _, k, _, _ in found]).view(np.int64)), each(0, np.int64), each(2, np.int32), each(3, np.int32)], names=["key", "id", "grp", "spare"])

    return run


def _prefixes(keys: DataFrame) -> DataFrame:
    """Rows (key, id) that candidates must meet in: the rarest keys of each document.

    Of a group's k keys, similar documents share all but as many as may differ (d). So the d + 1 rarest
    of each, in one order of all keys, have one in common, and the k - d - 1 most frequent may go. Keys
    of one document meet nothing.
    """
    met = keys.join(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key")
    most_first = Window.partitionBy("id", "grp").orderBy(F.desc("n"), F.desc("key"))
    return met.withColumn("place", F.row_number().over(most_first)).where("place > spare").select("key", "id")


def ngram_components(docs: DataFrame, sets: Callable[[list[bytes]], list[np.ndarray]] = H.shingles, tau: float = 0.75, spare: float = 0.15) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs, which needs doc_id and text.

    Two documents are linked when their sets' Jaccard similarity is tau or more; component_id is the
    smallest doc_id reachable by links. Null, empty or blank texts have an empty set and no links: their
    component_id is their own doc_id, as for any document without links. Rows with equal sets are linked;
    a null doc_id stays null in its row, and gets the component of its set if another row has an id
    (else null). Repeated rows are returned as often as they come. Other columns are ignored. spare:
    share of segments above the least number, so that most documents need no deletion neighbourhoods.
    """
    spark = docs.sparkSession
    small_batches(spark)
    places = parts(spark)
    texts = docs.select("doc_id", "text")
    few = -(-places // SLICES)  # a pass has a part of the tokens, and a row for each (task, partition)
    found = [cut(texts.mapInArrow(_tokens_of(sets, few, part, SLICES), _PACKED).repartition(few, "p").mapInArrow(_shared(places), _PACKED)) for part in range(SLICES)]
    listed = found[0].where("n is not null").select("doc_id", "n", "fp")
    packs = union_all(found).where("tokens is not null")
    full = cut(packs.repartition(places, "p").mapInArrow(_candidates(tau), "id long, n long, tokens array<long>, fold array<long>, sketch array<long>"))
    discard(*found[1:])
    keys = full.select("id", "n", "tokens").mapInArrow(_signatures(tau, spare), "key long, id long, grp int, spare int")
    buckets = _prefixes(keys).withColumn("sig", F.lit(None).cast("long"))

    def verify(pairs: DataFrame) -> DataFrame:
        a = full.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
        b = full.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
        both = F.size(F.array_intersect("ta", "tb"))
        sized = pairs.join(a, "a").join(b, "b").where("least(na, nb) >= greatest(na, nb) * {}D".format(tau))
        return sized.select("a", "b", "na", "nb", both.alias("i")).where(f"i >= {tau}D * (na + nb - i) - 1e-9D").select("a", "b")

    sketches = full.select("id", F.struct("n", (F.col("n") - F.size("tokens")).alias("own"), "fold", "sketch").alias("sketch"))
    most = f"((1 - {tau}D) / (1 + {tau}D) * (ka.n + kb.n) - ka.own - kb.own + 1e-9D)"
    short = " + ".join(f"bit_count(ka.fold[{i}] ^ kb.fold[{i}])" for i in range(FOLD))
    full_length = "aggregate(zip_with(ka.sketch, kb.sketch, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)"
    near = f"{short} <= {most} and (size(ka.sketch) <> size(kb.sketch) or size(ka.sketch) = {FOLD} or {full_length} <= {most})"
    groups = linked_groups(buckets, verify, sketches=sketches, near=lambda x, y: F.expr(near))
    discard(full)
    # Copies first: one row a distinct set, so that a group of copies of any size meets as sums of tasks.
    own = listed.where("n > 0").groupBy("fp").agg(F.min("doc_id").alias("least"))
    if groups is not None:
        comp = F.coalesce("comp", "fp")
        labelled = own.join(groups.withColumnRenamed("id", "fp"), "fp", "left").select("fp", comp.alias("comp"), "least")
        own = labelled.join(labelled.groupBy("comp").agg(F.min("least").alias("all_least")), "comp").select("fp", F.col("all_least").alias("least"))
    salted = own.select("fp", "least", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("salt"))
    rows = listed.withColumn("salt", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(16)).cast("int"))
    joined = rows.where("n > 0").join(salted, ["fp", "salt"]).select("doc_id", F.col("n").alias("n_shingles"), F.col("least").alias("component_id"))
    alone = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return joined.unionByName(alone)


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """Rows of docs, one of each group that ngram_components links: that of the smallest doc_id.

    Rows without a doc_id stay. Of rows with the same doc_id one stays.
    """
    kept = ngram_components(docs, **options).where("doc_id = component_id").select("doc_id").distinct()
    named = docs.where("doc_id is not null").join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return named.select(docs.columns).unionByName(docs.where("doc_id is null"))
