"""Quality rules with thresholds that follow from the data of each language and source.

Method: every measure of a document falls into a bucket of a log-scaled histogram, a quantile sketch of
fixed relative error that merges by adding counts (whatever the order). Quartiles of each (language,
source), or of the language or of all where a group is small, give outlier fences; documents are joined
with their group's fences and filtered. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, unused

#: Relative width of a sketch's buckets, and the value below which all fall into one.
GAMMA, LEAST = 1.02, 1e-4
#: Documents of a group from which its own quartiles are used.
ENOUGH = 100
#: A fence is Q3 + REACH * (Q3 - Q1) + the measure's margin; for word length also below Q1.
REACH = 3.0
#: Measures, their margins, and whether they have a lower fence too.
MEASURES = {
    "word_length": ("word_chars / n_words", 1.5, True),
    "symbols": ("n_symbols / n_words", 0.1, False),
    "dup_lines": ("n_dup_lines / n_lines", 0.25, False),
    "repeats": ("n_repeat_words / n_words", 0.25, False),
    "capitals": ("n_upper / n_words", 1.0, False),
    "shouts": ("n_shouts / n_words", 0.25, False),
}
#: Groups up to which their fences are broadcast: some 200 bytes each. Beyond, documents are joined over SALTS copies.
FEW_GROUPS = 20_000
SALTS = 16
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_shouts"]


def words_of(text: Column) -> Column:
    """Runs of characters other than blanks; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def _repeat_words(words: str, grams: str, places: str) -> list[str]:
    """Steps of SQL that count words within three-word windows that occur twice or more.

    Windows are sorted by two hashes with their places; equal neighbours are repeats; the places of
    repeats, in order, cover up to three words each.
    """
    return [
        f"case when size({words}) < 4 then cast(array() as array<struct<h:bigint,g:int,i:int>>) else sort_array(transform(sequence(0, size({words}) - 3), i -> struct(xxhash64({words}[i], {words}[i + 1], {words}[i + 2]) as h, hash({words}[i], {words}[i + 1], {words}[i + 2]) as g, i as i))) end",
        f"case when size({grams}) = 0 then cast(array() as array<int>) else sort_array(filter(transform(sequence(0, size({grams}) - 1), j -> case when (j > 0 and {grams}[greatest(j - 1, 0)].h = {grams}[j].h and {grams}[greatest(j - 1, 0)].g = {grams}[j].g) or (j < size({grams}) - 1 and {grams}[least(j + 1, size({grams}) - 1)].h = {grams}[j].h and {grams}[least(j + 1, size({grams}) - 1)].g = {grams}[j].g) then {grams}[j].i else -1 end), x -> x >= 0)) end",
        f"case when size({places}) = 0 then 0L when size({places}) = 1 then 3L else aggregate(sequence(1, size({places}) - 1), 3L, (s, j) -> s + least(3, {places}[j] - {places}[j - 1])) end",
    ]


def with_measures(docs: DataFrame, name: str = "m") -> DataFrame:
    """docs and a struct column of counts: see the module's MEASURES and op3's contract."""
    kept = docs.columns
    text = F.coalesce(F.col("text"), F.lit(""))
    w, l, grams, places, n_repeat = unused(docs, "words", "lines", "grams", "places", "n_repeat_words")  # noqa: E741
    at = docs.withColumns({w: words_of(F.col("text")), l: F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    for step, sql in zip((grams, places, n_repeat), _repeat_words(w, grams, places), strict=True):
        at = at.withColumn(step, F.expr(sql))
    less = lambda chars: (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")
    counts = {
        "n_words": F.size(w).cast("long"),
        "word_chars": F.length(F.array_join(w, "")).cast("long"),
        "n_symbols": less("#*$%&|<>"),
        "n_dup_lines": (F.size(l) - F.size(F.array_distinct(l))).cast("long"),
        "n_repeat_words": F.col(n_repeat),
        "n_lines": F.size(l).cast("long"),
        "n_upper": less("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        "n_shouts": less("!"),
    }
    return at.select(*(F.col(f"`{c}`") for c in kept), F.struct(*(c.alias(k) for k, c in counts.items())).alias(name))


def _bucket(value: str) -> str:
    return f"case when {value} <= {LEAST}D then 0L else cast(floor(ln({value} / {LEAST}D) / ln({GAMMA}D)) as bigint) + 1L end"


def sketches(measured: DataFrame, name: str = "m") -> DataFrame:
    """(lang, source, measure, bucket, n): mergeable by adding n. Documents without words count nowhere."""
    values = [F.struct(F.lit(k).alias("measure"), F.expr(_bucket("cast({} as double)".format(_of(sql, name)))).alias("bucket")) for k, (sql, _, _) in MEASURES.items()]
    rows = measured.where(F.col(f"{name}.n_words") > 0).select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), F.explode(F.array(*values)).alias("v"))
    return rows.groupBy("lang", "source", "v.measure", "v.bucket").agg(F.count("*").alias("n"))


def _of(sql: str, name: str) -> str:
    over, under = sql.split(" / ")
    return f"{name}.{over} / greatest({name}.{under}, 1)"


def quartiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    """(by, measure, n, q1, q3): upper ends of the buckets that hold the quartiles."""
    merged = sketch.groupBy(*by, "measure", "bucket").agg(F.sum("n").alias("n"))
    of = ", ".join([*by, "measure"])
    ranked = merged.selectExpr("*", f"sum(n) over (partition by {of} order by bucket) as upto", f"sum(n) over (partition by {of}) as total")
    end = f"case when bucket = 0 then 0D else {LEAST}D * power({GAMMA}D, cast(bucket as double)) end"
    return ranked.groupBy(*by, "measure").agg(
        F.max("total").alias("n"),
        F.expr(f"min(case when 4 * upto >= total then {end} end)").alias("q1"),
        F.expr(f"min(case when 4 * upto >= 3 * total then {end} end)").alias("q3"),
    )


def fences(sketch: DataFrame) -> DataFrame:
    """(lang, source, and low_<measure> and high_<measure>): one row a group of the sketches."""
    own = quartiles(sketch, ["lang", "source"])
    lang = quartiles(sketch, ["lang"]).selectExpr("lang", "measure", "n as ln", "q1 as l1", "q3 as l3")
    every = quartiles(sketch, []).selectExpr("measure", "q1 as a1", "q3 as a3")
    pick = lambda q: F.expr(f"case when n >= {ENOUGH} then q{q} when ln >= {ENOUGH} then l{q} else a{q} end")
    both = own.join(lang, ["lang", "measure"]).join(every, "measure").select("lang", "source", "measure", pick(1).alias("q1"), pick(3).alias("q3"))
    out = []
    for k, (_, margin, two_sided) in MEASURES.items():
        out.append(F.max(F.when(F.col("measure") == k, F.expr(f"q3 + {REACH}D * (q3 - q1) + {margin}D"))).alias(f"high_{k}"))
        if two_sided:
            out.append(F.max(F.when(F.col("measure") == k, F.expr(f"q1 - {REACH}D * (q3 - q1) - {margin}D"))).alias(f"low_{k}"))
    return both.groupBy("lang", "source").agg(*out)


def _verdict(name: str) -> str:
    tests = []
    for k, (sql, _, two_sided) in MEASURES.items():
        tests.append(f"cast({_of(sql, name)} as double) <= fence_.high_{k}")
        if two_sided:
            tests.append(f"cast({_of(sql, name)} as double) >= fence_.low_{k}")
    return " and ".join(tests)


def judged(measured: DataFrame, name: str = "m") -> DataFrame:
    """measured with base_failed and kept. measured is read twice: for the sketches and for the verdicts.

    Documents of fewer than 50 words, or of which more than half lie in repeated three-word windows, fail
    at once; the others are kept if all measures are within their group's fences. A null
    language or source counts as an empty one.
    """
    table = cut(fences(sketches(measured, name)))
    columns = [c for c in table.columns if c not in ("lang", "source")]
    lang, source, fence, salt = unused(measured, "own_lang", "own_source", "fence_", "salt")
    groups = table.select(F.col("lang").alias(lang), F.col("source").alias(source), F.struct(*columns).alias(fence))
    on = [lang, source]
    rows = measured.withColumns({lang: F.coalesce("lang", F.lit("")), source: F.coalesce("source", F.lit(""))})
    if table.count() <= FEW_GROUPS:
        groups = F.broadcast(groups)
    else:
        groups = groups.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn(salt, F.pmod(F.xxhash64("doc_id", f"{name}.word_chars"), F.lit(SALTS)).cast("int"))
        on = [*on, salt]
    failed = f"({name}.n_words < 50 or 100 * {name}.n_repeat_words > 50 * {name}.n_words)"
    joined = rows.join(groups, on, "left")
    verdict = _verdict(name).replace("fence_.", f"{fence}.")
    return joined.select(*(F.col(f"`{c}`") for c in measured.columns), F.expr(failed).alias("base_failed"), F.expr(f"not {failed} and coalesce({verdict}, false)").alias("kept"))


def quality_verdicts(docs: DataFrame) -> DataFrame:
    """(doc_id, the counts, base_failed, kept) for each row of docs (doc_id, text, lang, source).

    A null text has no words and fails. Rows may repeat; an empty table has no groups and no rows.
    """
    measured = cut(with_measures(docs.select("doc_id", "text", "lang", "source")).drop("text"))
    return judged(measured).select("doc_id", *(F.col(f"m.{c}") for c in _COUNTS), "base_failed", "kept")


def quality_filter(docs: DataFrame) -> DataFrame:
    """Rows of docs that quality_verdicts() keeps; columns stay. The rows are written once with their counts."""
    # the row is carried whole: none of its columns can clash with those of the verdict
    measured = cut(with_measures(docs.select("doc_id", "text", "lang", "source", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))).drop("text"))
    return judged(measured).where("kept").select("row.*")


__all__ = ["fences", "judged", "quality_filter", "quality_verdicts", "quartiles", "sketches", "with_measures", "words_of"]
