"""Connected groups from candidate buckets, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, discard, is_empty, union_all


#: Pairs for each row of the buckets up to which what the stars left is compared in full.
FULL = 4
#: Rounds after which buckets of FEW rows at most are compared in full; larger ones go on while rounds help, up to MOST.
STARS, FEW, MOST = 3, 64, 8
#: Rows of a key that one task compares in full; the pairs of a larger key are dealt to several.
DEALT = 2_000
#: Pairs beyond which the full comparison begins with one pair of each two groups.
MANY = 50_000


def _sized(df: DataFrame) -> DataFrame:
    """df in as many partitions as its rows need (df is a written table)."""
    return df.coalesce(max(1, df.count() // 20_000))


def connected(links: DataFrame) -> DataFrame:
    """links (a, b) -> (id, comp), comp the smallest id reachable. Alternating large and small stars.

    Self-links and repeated links are allowed; ids without a link to another id do not appear.
    """
    edges = cut(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    while not _is_star_forest(_sized(edges)):
        few = _sized(edges)
        both = few.select("u", "v").unionByName(few.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = cut(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        few = _sized(large)
        down = few.groupBy("u").agg(F.min("v").alias("m"))
        up = few.join(down, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        small = cut(up.where("u <> v").distinct())
        discard(edges, large)
        edges = small
    edges = _sized(edges)
    roots = edges.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("comp"))
    return edges.select(F.col("u").alias("id"), F.col("v").alias("comp")).unionByName(roots)


def _is_star_forest(edges: DataFrame) -> bool:
    """Whether each u has one v, and no v is a u."""
    ends = edges.select("u", F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("u"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return is_empty(ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1"))


def linked_groups(
    buckets: DataFrame,
    verify: Callable[[DataFrame], DataFrame],
    may_link: Callable[[Column, Column], Column] | None = None,
    sketches: DataFrame | None = None,
    near: Callable[[Column, Column], Column] | None = None,
    split: Callable[[DataFrame], DataFrame] | None = None,
    few_first: bool = False,
    exact: bool = False,
    in_full: int = FULL,
) -> DataFrame | None:
    """Groups connected by verified links among ids that share a bucket; None if there is no link.

    buckets: (key, id, sig). verify keeps the true links of candidate pairs (a, b). may_link: a cheap
    necessary condition on two sigs. A bucket of g ids is not expanded into its pairs: in each round
    every id is compared with one leader of each of its buckets, and only buckets whose ids are still in
    different groups go on. What is left at the end is compared in full, so that no link between
    groups is missed; ids of one group need no further comparison. few_first: after STARS rounds buckets in
    which at most FEW ids are apart are compared in full, before the others go on.
    sketches (id, sketch) and near: another necessary condition, for the full comparison only; exact: it is
    verify's own, so that the comparison's join makes links only, and two ids are compared there once, however many
    buckets they share, for which their rows carry their buckets. split: gives the rows of that comparison finer keys and
    passes their other columns on; two rows that it marks as twice have met elsewhere. in_full: pairs for each row of the buckets
    up to which they are compared in full.
    """
    may_link = may_link or (lambda x, y: F.lit(True))
    given = cut(buckets)
    live = cut(_of_several(given, "id"))
    discard(given)
    tested: list[DataFrame] = []
    groups: DataFrame | None = None
    apart = float("inf")

    def compared(pairs: DataFrame, among_many: bool) -> None:
        nonlocal groups
        swap = F.col("a") > F.col("b")
        pairs = pairs.select(*(F.when(swap, F.col(y)).otherwise(F.col(x)).alias(x) for x, y in (("a", "b"), ("b", "a"), ("ca", "cb"), ("cb", "ca")))).distinct()
        if tested:
            pairs = pairs.join(union_all(t.select("a", "b") for t in tested), ["a", "b"], "left_anti")
        pairs = cut(pairs)
        tested.append(pairs)
        if among_many and pairs.count() > MANY:  # one pair of each two groups first: most others are then of one group
            one = cut(pairs.groupBy(F.least("ca", "cb").alias("l"), F.greatest("ca", "cb").alias("g")).agg(F.min_by(F.struct("a", "b"), F.xxhash64("a", "b")).alias("p")).select("p.a", "p.b"))
            groups = _linked(groups, verify(one))
            discard(one)
            if groups is not None:
                of = lambda end: groups.select(F.col("id").alias(end), F.col("comp").alias("n" + end))
                pairs = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").where(F.coalesce("na", "a") != F.coalesce("nb", "b"))
                pairs = cut(pairs.select("a", "b"))
                tested.append(pairs)
        groups = _linked(groups, verify(pairs.select("a", "b")))

    def star(rows: DataFrame, k: int) -> None:
        left = rows.select("key", F.col("id").alias("a"), F.col("sig").alias("sa"), F.col("comp").alias("ca"))
        lead = rows.groupBy("key").agg(F.min_by(F.struct("id", "sig", "comp"), F.xxhash64(F.col("id"), F.lit(k))).alias("l"))
        right = lead.select("key", F.col("l.id").alias("b"), F.col("l.sig").alias("sb"), F.col("l.comp").alias("cb"))
        compared(left.join(right, "key").where((F.col("ca") != F.col("cb")) & may_link(F.col("sa"), F.col("sb"))), False)

    def full(rows: DataFrame) -> None:
        nonlocal groups
        shared = None
        if exact:
            rows = rows.withColumn("bucket", F.col("key"))
            shared = cut(rows.groupBy("id").agg(F.collect_list("bucket").alias("buckets")))
        rows = rows if split is None else split(rows)
        rows, meet = _dealt(rows)
        own = sketches if shared is None else shared if sketches is None else shared.join(sketches, "id")
        rows = rows if own is None else rows.join(own, "id")
        short = {"sig": "s", "comp": "c", "sketch": "k", "part": "p", "other": "o", "twice": "t", "bucket": "m", "buckets": "l"}
        left, right = (rows.select("key", F.col("id").alias(x), *(F.col(c).alias(short[c] + x) for c in rows.columns if c in short)) for x in "ab")
        close = near(F.col("ka"), F.col("kb")) if sketches is not None else F.lit(True)
        if exact:  # ids that share several buckets are compared in the least of them only
            close = (F.col("ma") == F.col("mb")) & (F.col("ma") == F.array_min(F.array_intersect("la", "lb"))) & close
        meet = meet & ~(F.col("ta") & F.col("tb")) if "twice" in rows.columns else meet
        met = left.join(right, (left["key"] == right["key"]) & (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & meet & may_link(F.col("sa"), F.col("sb")) & close)
        if exact:
            groups = _linked(groups, met.select("a", "b").distinct())
        else:
            compared(met, True)
        discard(shared)

    def with_comps() -> DataFrame:
        nonlocal live
        if groups is None:
            return live.withColumn("comp", F.col("id"))
        named = cut(live.join(groups, "id", "left").withColumn("comp", F.coalesce("comp", "id")))
        kept = cut(_of_several(named, "comp"))
        discard(live, named)
        live = kept.select("key", "id", "sig")
        live._cut_path = kept._cut_path
        return kept

    for k in range(MOST + 1):
        rows = with_comps()
        if k:
            by_comp = rows.groupBy("key", "comp").agg(F.count("*").alias("g"))
            size = cut(by_comp.groupBy("key").agg(F.sum("g").alias("n"), F.sum(F.col("g").cast("double") * F.col("g")).alias("own")))
            n, pairs = size.agg(F.sum("n"), F.sum((F.col("n").cast("double") * F.col("n") - F.col("own")) / 2)).first()
            if n is None or pairs <= in_full * n:
                discard(size)
                if n is not None:
                    full(rows)
                break
            if k == STARS and few_first:
                full(rows.join(size.where(F.col("n") <= FEW).select("key"), "key"))
                large = cut(live.join(size.where(F.col("n") > FEW).select("key"), "key"))
                discard(live)
                live = large
                rows = with_comps()
            discard(size)
            if k == MOST or k > STARS and pairs > 0.8 * apart:
                full(rows)
                break
            apart = pairs if k != STARS or not few_first else float("inf")
        star(rows, k)
    discard(live, *tested)
    return groups


def _dealt(rows: DataFrame) -> tuple[DataFrame, Column]:
    """rows with finer keys where a key has more than DEALT rows, and whether rows a and b of one key meet there.

    Such a key's rows are dealt into parts, and each two parts, and each part with itself, have a key of their
    own: every pair meets in one of them.
    """
    large = cut(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > DEALT))
    if is_empty(large):
        return rows, F.lit(True)
    n = F.ceil(F.coalesce("n", F.lit(1)) / DEALT).cast("int")
    parts = rows.join(large, "key", "left").withColumns({"n": n, "part": F.pmod(F.xxhash64("id"), n).cast("int")})
    both = parts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    finer = F.when(F.col("n") > 1, F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other"))).otherwise(F.col("key"))
    return both.withColumn("key", finer).drop("n"), (F.col("pa") == F.col("pb")) == (F.col("pa") == F.col("oa"))


def _of_several(rows: DataFrame, what: str) -> DataFrame:
    """Rows (a written table) of the keys that have two different values or more."""
    keys = rows.groupBy("key").agg(F.min(what).alias("x"), F.max(what).alias("y")).where("x < y").select("key")
    return rows.join(cut(keys), "key")


def _linked(groups: DataFrame | None, links: DataFrame) -> DataFrame | None:
    links = cut(links)
    out = groups if is_empty(links) else _merged(groups, links)
    discard(links)
    return out


def _merged(groups: DataFrame | None, links: DataFrame) -> DataFrame:
    """groups after links between them."""
    if groups is None:
        return cut(connected(links))
    of = lambda end: groups.select(F.col("id").alias(end), F.col("comp").alias("c" + end))
    between = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    higher = cut(connected(between).select(F.col("id").alias("comp"), F.col("comp").alias("top")))
    moved = groups.join(higher, "comp", "left").select("id", F.coalesce("top", "comp").alias("comp"))
    # ids that had no group are comps of their own in the links between
    fresh = higher.select(F.col("comp").alias("id"), F.col("top").alias("comp")).join(groups.select("id"), "id", "left_anti")
    out = cut(moved.unionByName(fresh))
    discard(groups, higher)
    return out
