"""Token counts that follow edits of a text without encoding it anew.

Method: each document keeps a segment tree over runs of whole pre-tokens; a leaf has the run's length in
characters and its number of tokens, an inner node the sums. An edit finds its leaves by position, cuts
and encodes only their text (and what two characters of context on either side touch), and updates the
sums above them.

Runs are cut before a single blank or line end. With a pre-token pattern of the kind below
such a place is a boundary whatever stands further away, so that the counts of runs add up exactly.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import small_batches

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The public byte-level BPE pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of a leaf, about.
LEAF = 512
_CONTEXT = 2
_EDIT = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("text", T.StringType())]))
#: A run may begin at one blank or line end that has no other beside it.
_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")


@lru_cache(maxsize=4)
def _encoding(source: bytes, pattern: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, source.splitlines())}
    return tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def cut_runs(text: str, leaf: int = LEAF) -> list[str]:
    """Runs of whole pre-tokens of about leaf characters; one place that has no boundary makes a longer run."""
    out, at = [], 0
    while len(text) - at > leaf:
        m = _CUT.search(text, at + leaf)
        if not m:
            break
        out.append(text[at : m.start()])
        at = m.start()
    if at < len(text):
        out.append(text[at:])
    return out


class TokenTree:
    """Sums of characters and tokens over the runs of one text; heap order, leaves from index size."""

    def __init__(self, count, chars: list[int], tokens: list[int], leaf: int = LEAF):
        self.count, self.leaf = count, leaf
        self.size = 1
        while self.size < len(chars):
            self.size *= 2
        self.sums = [self._built(chars), self._built(tokens)]
        self.encoded = 0  # characters that edits had encoded

    def _built(self, leaves: list[int]) -> list[int]:
        out = [0] * self.size + leaves + [0] * (self.size - len(leaves))
        for i in range(self.size - 1, 0, -1):
            out[i] = out[2 * i] + out[2 * i + 1]
        return out

    @classmethod
    def of(cls, count, text: str, leaf: int = LEAF) -> TokenTree:
        runs = cut_runs(text, leaf)
        return cls(count, [len(x) for x in runs], [count(x) for x in runs], leaf)

    @property
    def n_tokens(self) -> int:
        return self.sums[1][1]

    def leaves(self) -> tuple[list[int], list[int]]:
        pairs = [(c, t) for c, t in zip(self.sums[0][self.size :], self.sums[1][self.size :], strict=True) if c]
        return [c for c, _ in pairs], [t for _, t in pairs]

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character at (the last one, beyond the end), and where it begins."""
        i, begin, chars = 1, 0, self.sums[0]
        at = min(at, chars[1] - 1)
        while i < self.size:
            i *= 2
            if at >= begin + chars[i]:
                begin += chars[i]
                i += 1
        return i - self.size, begin

    def _set(self, leaf: int, chars: int, tokens: int) -> None:
        for sums, new in zip(self.sums, (chars, tokens), strict=True):
            i = leaf + self.size
            change = new - sums[i]
            while i:
                sums[i] += change
                i //= 2

    def edit(self, text: str, start: int, length: int, new: str) -> str:
        """The text with a range replaced; the tree follows."""
        start = min(max(start, 0), len(text))
        end = min(start + max(length, 0), len(text))
        after = text[:start] + new + text[end:]
        if not text:
            fresh = TokenTree.of(self.count, after, self.leaf)
            self.size, self.sums = fresh.size, fresh.sums
            self.encoded += len(after)
            return after
        first, begin = self.find(max(0, start - _CONTEXT))
        last, last_begin = self.find(end + _CONTEXT)
        stop = last_begin + self.sums[0][self.size + last]
        region = after[begin : stop + len(after) - len(text)]
        runs = cut_runs(region, self.leaf)
        self.encoded += len(region)
        counts = [(len(x), self.count(x)) for x in runs]
        room = last - first + 1
        if len(counts) <= room:
            for k, (c, t) in enumerate(counts + [(0, 0)] * (room - len(counts))):
                self._set(first + k, c, t)
        else:  # the leaves are full: grow
            chars, tokens = self.sums[0][self.size :], self.sums[1][self.size :]
            chars[first : last + 1], tokens[first : last + 1] = [c for c, _ in counts], [t for _, t in counts]
            kept = [(c, t) for c, t in zip(chars, tokens, strict=True) if c]
            while self.size < len(kept):
                self.size *= 2
            self.sums = [self._built([c for c, _ in kept]), self._built([t for _, t in kept])]
        return after


def _vocabulary(docs: DataFrame, path: str):
    """The vocabulary's file as a broadcast: its size doesn't follow the data."""
    with open(path, "rb") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN, leaf: int = LEAF) -> DataFrame:
    """Rows of docs (with text) and n_tokens, leaf_chars, leaf_tokens: the leaves of each text's tree.

    A null text counts as empty: 0 tokens, no leaves. Columns of these names are replaced.
    """
    small_batches(docs.sparkSession)
    given, added = _vocabulary(docs, vocabulary), ["n_tokens", "leaf_chars", "leaf_tokens"]
    kept = [c for c in docs.columns if c not in added]
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField("n_tokens", T.LongType()), *(T.StructField(c, T.ArrayType(T.IntegerType())) for c in added[1:])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(given.value, pattern).encode_ordinary
        for batch in batches:
            trees = [TokenTree.of(lambda x: len(encode(x)), x or "", leaf) for x in batch["text"].to_pylist()]
            leaves = [t.leaves() for t in trees]
            lists = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([t.n_tokens for t in trees], pa.int64()), pa.array([c for c, _ in leaves], lists), pa.array([t for _, t in leaves], lists)], names=[*kept, *added])

    return docs.select(kept).mapInArrow(run, schema)


def apply_edits(counted: DataFrame, edits: Column, vocabulary: str = VOCABULARY, pattern: str = PATTERN, leaf: int = LEAF) -> DataFrame:
    """Rows of count_tokens() after their edits, with n_before and n_encoded (characters encoded for them).

    edits: a column of array<struct<start, length, text>>, applied in order to the text as it then is, in
    characters; what lies outside the text is clipped, null is 0 or empty, and no edits change nothing.
    A null text is edited as an empty one.
    """
    given, added = _vocabulary(counted, vocabulary), ["n_before", "n_encoded"]
    kept = [c for c in counted.columns if c not in added]
    schema = T.StructType([*(counted.schema[c] for c in kept), *(T.StructField(c, T.LongType()) for c in added)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(given.value, pattern).encode_ordinary
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("text", "n_tokens", "leaf_chars", "leaf_tokens", *added)}
            for text, before, chars, tokens, each in zip(*(batch[c].to_pylist() for c in ("text", "n_tokens", "leaf_chars", "leaf_tokens", "__edits")), strict=True):
                tree = TokenTree(lambda x: len(encode(x)), chars or [], tokens or [], leaf)
                for e in each or ():
                    text = tree.edit(text or "", e["start"] or 0, e["length"] or 0, e["text"] or "")
                for c, v in zip(out, (text, tree.n_tokens, *tree.leaves(), before, tree.encoded), strict=True):
                    out[c].append(v)
            new = {c: pa.array(v, {"text": pa.string(), "leaf_chars": pa.list_(pa.int32()), "leaf_tokens": pa.list_(pa.int32())}.get(c, pa.int64())) for c, v in out.items()}
            yield pa.RecordBatch.from_arrays([new[c] if c in new else batch[c] for c in [*kept, *added]], names=[*kept, *added])

    return counted.select(*kept, edits.cast(_EDIT).alias("__edits")).mapInArrow(run, schema)


def sample_edits(text: Column) -> Column:
    """Three edits that any text can have: an insertion, a deletion and a replacement at its end."""
    n = F.coalesce(F.length(text), F.lit(0)).cast("long")
    at = lambda start, length, new: F.struct(start.cast("long").alias("start"), F.lit(length).cast("long").alias("length"), F.lit(new).alias("text"))
    return F.array(at(F.floor(n / 3), 0, " (edited: see note 7) "), at(F.floor(2 * n / 3), 25, ""), at(n - 12, 12, "’s end,\n 2024.\n"))


__all__ = ["LEAF", "PATTERN", "TokenTree", "apply_edits", "count_tokens", "cut_runs", "sample_edits"]
