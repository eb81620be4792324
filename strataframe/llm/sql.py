"""DuckDB twins of the queries that SQL can express on whole tables."""

from __future__ import annotations

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

SQL: dict[str, str] = {}

SQL["op2_decontaminate"] = rf"""
with item as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark
), win as (
  select distinct item_id, least(13, len(w)) size, array_to_string(w[i:i + 12], ' ') t
  from (select item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) i from item where len(w) > 0)
), doc as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents
), runs as (
  select doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') t
  from (select doc_id, w, size, unnest(range(1, len(w) - size + 2)) i from doc, (select distinct size from win))
), hit as (
  select doc_id, item_id, i, size from runs join win using (size, t)
), words as (
  select doc_id, count(distinct k) n_hit from (select doc_id, unnest(range(i, i + size)) k from hit) group by doc_id
), ids as (
  select doc_id, count(*) n_items, string_agg(id, ',' order by id) s from (select distinct doc_id, cast(item_id as varchar) id from hit) group by doc_id
)
select doc_id, cast(len(w) as bigint) n_words, cast(coalesce(n_hit, 0) as bigint) n_hit, cast(coalesce(n_items, 0) as bigint) n_items,
  sha256(coalesce(s, '')) items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) contaminated
from doc left join words using (doc_id) left join ids using (doc_id)
"""

SQL["op7_ngram_join"] = rf"""
with recursive doc as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x20\x09-\x0D]+') w from documents
), shingle as (
  select distinct doc_id, array_to_string(w[i:i + 4], ' ') t
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) i from doc where len(w) > 0)
), size as (
  select doc_id, count(*) n from shingle group by doc_id
), pair as (
  select a.doc_id x, b.doc_id y, count(*) k from shingle a join shingle b on a.t = b.t and a.doc_id < b.doc_id group by all
), link as (
  select x, y from pair join size s on s.doc_id = x join size t on t.doc_id = y where 100 * k >= 75 * (s.n + t.n - k)
), edge as (
  select x, y from link union all select y, x from link
), reach(x, y) as (
  select distinct x, x from edge union select r.x, e.y from reach r join edge e on r.y = e.x
)
select doc_id, cast(coalesce(n, 0) as bigint) n_shingles, cast(coalesce(c, doc_id) as bigint) component_id
from doc left join size using (doc_id) left join (select x doc_id, min(y) c from reach group by x) using (doc_id)
"""

_RATIOS = {
    "word_length": ("word_chars", "n_words", 1.5, True),
    "symbols": ("n_symbols", "n_words", 0.1, False),
    "dup_lines": ("n_dup_lines", "n_lines", 0.25, False),
    "repeats": ("n_repeat_words", "n_words", 0.25, False),
    "capitals": ("n_upper", "n_words", 1.0, False),
    "shouts": ("n_shouts", "n_words", 0.25, False),
}


def _ratio(k: str) -> str:
    over, under, _, _ = _RATIOS[k]
    return f"cast({over} as double) / greatest({under}, 1)"


_VALUES = " union all ".join(f"select lang, source, '{k}' measure, {_ratio(k)} v from m where n_words > 0" for k in _RATIOS)
_FENCES = ", ".join(
    f"max(case when measure = '{k}' then q3 + 3 * (q3 - q1) + {margin} end) high_{k}, max(case when measure = '{k}' then q1 - 3 * (q3 - q1) - {margin} end) low_{k}"
    for k, (_, _, margin, _) in _RATIOS.items()
)
_WITHIN = " and ".join(f"{_ratio(k)} <= high_{k}" + (f" and {_ratio(k)} >= low_{k}" if two else "") for k, (_, _, _, two) in _RATIOS.items())


def _quartiles(by: str) -> str:
    on = f"{by}, measure" if by else "measure"
    return f"""(select {on}, max(total) n, min(case when 4 * upto >= total then e end) q1, min(case when 4 * upto >= 3 * total then e end) q3
    from (select *, sum(n) over (partition by {on} order by bucket) upto, sum(n) over (partition by {on}) total
          from (select {on}, bucket, case when bucket = 0 then 0.0::double else 1e-4::double * pow(1.02::double, bucket) end e, sum(n) n from sketch group by all)) group by {on})"""


QUALITY_CTES = rf"""
doc as (
  select doc_id, coalesce(lang, '') lang, coalesce(source, '') source, coalesce(text, '') t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) l from documents
), gram as (
  select doc_id, i, array_to_string(w[i:i + 2], ' ') g from (select doc_id, w, unnest(range(1, len(w) - 1)) i from doc)
), covered as (
  select doc_id, count(distinct k) n from (
    select doc_id, unnest(range(i, i + 3)) k from gram join (select doc_id, g from gram group by all having count(*) > 1) using (doc_id, g)) group by doc_id
), m as (
  select doc_id, lang, source, len(w) n_words, length(array_to_string(w, '')) word_chars, length(t) - length(translate(t, '#*$%&|<>', '')) n_symbols,
    len(l) - len(list_distinct(l)) n_dup_lines, coalesce(n, 0) n_repeat_words, len(l) n_lines,
    length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) n_upper, length(t) - length(translate(t, '!', '')) n_shouts
  from doc left join covered using (doc_id)
), sketch as (
  select lang, source, measure, case when v <= 1e-4 then 0 else cast(floor(ln(v / 1e-4::double) / ln(1.02::double)) as bigint) + 1 end bucket, count(*) n
  from ({_VALUES}) group by all
), fence as (
  select lang, source, {_FENCES} from (
    select o.lang, o.source, measure, case when o.n >= 100 then o.q1 when g.n >= 100 then g.q1 else a.q1 end q1, case when o.n >= 100 then o.q3 when g.n >= 100 then g.q3 else a.q3 end q3
    from {_quartiles("lang, source")} o join {_quartiles("lang")} g using (lang, measure) join {_quartiles("")} a using (measure)) group by lang, source
), verdict as (
  select m.*, n_words < 50 or 100 * n_repeat_words > 50 * n_words base_failed, not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and coalesce({_WITHIN}, false) kept
  from m left join fence using (lang, source)
)"""

SQL["op3_quality_rules"] = f"""
with {QUALITY_CTES}
select doc_id, cast(n_words as bigint) n_words, cast(word_chars as bigint) word_chars, cast(n_symbols as bigint) n_symbols, cast(n_dup_lines as bigint) n_dup_lines,
  cast(n_repeat_words as bigint) n_repeat_words, base_failed, kept from verdict
"""

SQL["op4_mixing"] = r"""
with tok as (
  select doc_id, coalesce(source, '') source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) n_tokens from documents
), src as (
  select source, cast(sum(n_tokens) as bigint) tokens from tok group by source having sum(n_tokens) > 0
), tot as (
  select cast(sum(tokens) as double) total, count(*) k from src
), grid as (
  select c, ln(sum(x)) - sum(x * ln(x)) / sum(x) >= 0.9::double * ln(any_value(k)) - 1e-12 entropy, max(x / tokens) / sum(x) * any_value(total) <= 4.0 + 1e-12 repeats
  from (select c, tokens, total, k, pow(tokens / total, c / 1048576.0::double) x from src, tot, range(0, 1048577) r(c)) group by c
), exponent as (
  select greatest(max(c) filter (entropy), coalesce(min(c) filter (repeats), 1048576)) / 1048576.0::double a from grid
), plan as (
  select source, tokens, cast(floor(least(weight * total, tokens * 4.0::double) + 1e-6::double) as bigint) target from (
    select source, tokens, total, pow(tokens / total, a) / sum(pow(tokens / total, a)) over () weight from src, tot, exponent)
), taken as (
  select tok.*, target // tokens passes, target % tokens rest from tok join plan using (source)
), whole as (
  select doc_id, source, n_tokens, unnest(range(0, passes)) as pass, cast(0 as bigint) rest from taken
), keyed as (
  select *, md5('mix-1/' || pass || '/' || coalesce(cast(doc_id as varchar), '')) doc_key, which from (
    select *, 'whole' which from whole union all select doc_id, source, n_tokens, passes, rest, 'last' from taken where rest > 0)
), blocked as (
  select *, md5('mix-1/' || source || '/' || pass || '/' || substring(doc_key, 1, 3)) block_key from keyed
), summed as (
  select *, sum(n_tokens) over (partition by which, source order by block_key, doc_key, n_tokens rows unbounded preceding) upto from blocked
)
select doc_id, source, n_tokens, cast(pass as bigint) pass, block_key, doc_key from summed where which = 'whole' or upto <= rest
"""
