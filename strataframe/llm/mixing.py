"""Mixing of sources to target weights under a token budget.

Method: temperature mixing. Sources' token shares are raised to an exponent and normalised; the exponent
is bisected (a fixed grid of 2^-20, several parts at once) to the least change of the natural shares that
reaches a target entropy, or further back to them where a source would be repeated too often. Weights
are realised as budgeted block permutations: a source's whole passes take all its documents, its last
pass takes whole blocks in permuted order, then sub-blocks and documents of the block in which the budget
ends. Blocks are ranges of a hash, so nothing is sorted as a whole. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality_rules import words_of
from .shared import cut

GRID = 1 << 20
_PARTS = 32
SALTS = 16


#: Parts of a token by which a target may miss the next whole one and still count as it: the sums of weights are not
#: exact, and their order isn't fixed.
NEXT = 1e-6


def token_table(docs: DataFrame) -> DataFrame:
    """(doc_id, source, n_tokens); a token is a run of characters other than blanks."""
    return docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.size(words_of(F.col("text"))).cast("long").alias("n_tokens"))


def find_exponent(sources: DataFrame, total: float, budget: float, entropy_share: float, max_repeats: float) -> float:
    """The mixing exponent for a table (source, tokens) of sources with total tokens.

    The largest exponent whose weights have entropy_share of the greatest entropy or more; if with it a
    source of the budget would be taken more than max_repeats times, the least exponent that avoids that
    (1, the natural shares, if none does). Entropy and repeats both fall as the exponent grows.
    """

    def met(points: list[int], test: str) -> list[bool]:
        grid = sources.select("tokens", F.explode(F.array(*(F.lit(c) for c in points))).alias("c")).withColumn("w", F.expr(f"power(tokens / {total!r}D, c / {GRID}D)"))
        table = grid.groupBy("c").agg(F.count("*").alias("k"), F.sum("w").alias("z"), F.sum(F.expr("w * ln(w)")).alias("wlw"), F.max(F.expr("w / tokens")).alias("most"))
        rows = {r["c"]: r["ok"] for r in table.selectExpr("c", f"{test} as ok").collect()}
        return [rows[c] for c in points]

    def bisect(test: str, at_zero: bool) -> int:
        """The last point of the grid that is as zero is, for a test that changes once."""
        lo, hi = 0, GRID
        if met([GRID], test) == [at_zero]:
            return GRID
        while hi - lo > 1:
            points = list(range(lo, hi, max(1, (hi - lo) // _PARTS)))[1:]
            for x, ok in zip(points, met(points, test), strict=True):
                lo, hi = (max(lo, x), hi) if ok == at_zero else (lo, min(hi, x))
        return lo

    entropy = bisect(f"ln(z) - wlw / z >= {entropy_share}D * ln(k) - 1e-12D", True)
    few = f"most / z * {budget}D <= {max_repeats}D + 1e-12D"
    repeats = 0 if met([0], few) == [True] else min(GRID, bisect(few, False) + 1)
    return max(entropy, repeats) / GRID


def weights(tokens: DataFrame, budget: int | None = None, entropy_share: float = 0.9, max_repeats: float = 4.0) -> DataFrame:
    """(source, tokens, weight, target, passes, rest): target tokens, whole passes, and tokens of the last pass."""
    sources = cut(tokens.groupBy("source").agg(F.sum("n_tokens").alias("tokens")).where("tokens > 0"))
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    budget = int(total if budget is None else budget)
    total = float(total)
    exponent = find_exponent(sources, total, budget, entropy_share, max_repeats) if total else 1.0
    z = sources.select(F.sum(F.expr(f"power(tokens / {total!r}D, {exponent!r}D)"))).first()[0] if total else 1.0
    shared = sources.withColumn("weight", F.expr(f"power(tokens / {total!r}D, {exponent!r}D) / {z!r}D"))
    target = shared.withColumn("target", F.expr(f"cast(floor(least(weight * {budget}D, tokens * {max_repeats}D) + {NEXT}D) as bigint)"))
    return target.selectExpr("source", "tokens", "weight", "target", "target div tokens as passes", "target % tokens as rest")


def _salted(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows joined with their source's plan, a large source over SALTS tasks."""
    copies = plan.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "n_tokens"), F.lit(SALTS)).cast("int")).join(copies, ["source", "salt"]).drop("salt")


def _upto(table: DataFrame, keys: list[str], order: str) -> DataFrame:
    """table (keys, order, n) with upto, the sum of n so far within keys, and left, what the budget has before it."""
    of = ", ".join(keys)
    return table.selectExpr("*", f"sum(n) over (partition by {of} order by {order}) as upto").withColumn("before", F.expr("upto - n"))


def mix(docs: DataFrame, budget: int | None = None, entropy_share: float = 0.9, max_repeats: float = 4.0, seed: str = "mix-1") -> DataFrame:
    """(doc_id, source, n_tokens, pass, block_key, doc_key): one row each time that a document is taken.

    Ordered by block_key and doc_key the rows are the mixture. budget: tokens in all (default: as many as
    docs has). A source never exceeds its target: the document that would is left out, with all after it in
    its pass. Null sources are one source, ''; sources without tokens aren't taken; documents without tokens
    are taken with their block. Without rows or tokens the result is empty. Rows that repeat are taken as
    often as they come.
    """
    tokens = cut(token_table(docs))
    plan = cut(weights(tokens, budget, entropy_share, max_repeats).select("source", "passes", "rest"))
    rows = _salted(tokens, plan)
    doc_key = f"md5(concat('{seed}/', cast(pass as string), '/', coalesce(cast(doc_id as string), '')))"
    block_key = f"md5(concat('{seed}/', source, '/', cast(pass as string), '/', substring(doc_key, 1, 3)))"
    keyed = lambda df: df.withColumn("doc_key", F.expr(doc_key)).withColumn("block_key", F.expr(block_key))
    out = ["doc_id", "source", "n_tokens", "pass", "block_key", "doc_key"]
    whole = keyed(rows.where("passes > 0").withColumn("pass", F.explode(F.expr("sequence(0L, passes - 1)"))))

    last = cut(keyed(rows.where("rest > 0").withColumn("pass", F.col("passes"))).select(*out, "rest"))
    blocks = _upto(last.groupBy("source", "rest", "block_key").agg(F.sum("n_tokens").alias("n")), ["source"], "block_key").where("before <= rest").select("source", "block_key", "upto", "before")
    blocks = cut(blocks)
    reached = last.join(blocks, ["source", "block_key"])  # a source's documents are spread over its blocks
    in_full = reached.where("upto <= rest")
    split = cut(reached.where("upto > rest").select(*out, (F.col("rest") - F.col("before")).alias("rest"), F.expr("substring(doc_key, 4, 3)").alias("sub")))
    subs = _upto(split.groupBy("source", "block_key", "rest", "sub").agg(F.sum("n_tokens").alias("n")), ["source", "block_key"], "sub").where("before <= rest").select("source", "block_key", "sub", "upto", "before")
    part = split.join(subs, ["source", "block_key", "sub"])
    sub_full = part.where("upto <= rest")
    ends = part.where("upto > rest").selectExpr(*out, "rest - before as rest", "sum(n_tokens) over (partition by source, block_key, sub order by doc_key, n_tokens rows unbounded preceding) as upto")
    return whole.select(out).unionByName(in_full.select(out)).unionByName(sub_full.select(out)).unionByName(ends.where("upto <= rest").select(out))


__all__ = ["find_exponent", "mix", "token_table", "weights"]
