"""DuckDB SQL for the operators that SQL can express."""

MIXING = r"""
with d as (
  select doc_id, source, coalesce(text, '') as t from documents),
k as (
  select doc_id, source, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+'))::bigint as size,
    -ln((('0x' || substr(md5(coalesce(doc_id::varchar, '') || '#7'), 1, 12))::bigint::double + 0.5::double) / 281474976710656::double)
      / (0.1::double + coalesce(length(regexp_replace(t, '[^\p{Ll}]+', '', 'g'))::double / nullif(length(t), 0)::double, 0::double)) as key
  from d),
s as (
  select source, sum(size)::bigint as source_size from k group by source),
w as (
  select source, source_size, ([5, 2, 1])[((row_number() over (order by source nulls last) - 1) % 3 + 1)::int]::double as weight from s),
r as (
  select *, (source_size * 2)::bigint as stop, (source_size * 2) / weight as ratio from w),
l as (
  select *, ((sum(source_size) over ())::double * 1.5::double
      - coalesce(sum(stop) over (order by ratio, source nulls last rows between unbounded preceding and 1 preceding), 0)::double)
    / sum(weight) over (order by ratio, source nulls last rows between current row and unbounded following) as level from r),
p as (
  select source, source_size, least(stop::double, coalesce((select level from l where level <= ratio order by ratio, level limit 1) * weight, stop::double)) as target from l),
e as (
  select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as epochs from p),
q as (
  select k.doc_id, k.size, e.source_size, e.target, e.epochs, floor(e.target)::bigint - e.epochs * e.source_size as rest,
    coalesce(sum(k.size) over (partition by k.source order by k.key, k.doc_id rows between unbounded preceding and 1 preceding), 0)::bigint as before
  from k join e on k.source is not distinct from e.source)
select doc_id, size, source_size, target, (epochs * size + least(size, greatest(0, rest - before)))::bigint as taken from q
"""

EXACT_DEDUP = r"""
with d as (
  select doc_id, coalesce(text, '') as t, row_number() over (order by doc_id, text) as n from documents),
k as (
  select doc_id, n, length(t) as size, sha256(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) as text_sha256 from d),
g as (
  select *, count(*) over (partition by text_sha256) as group_size,
    first_value(doc_id) over w as keep_id, first_value(n) over w as keep_n
  from k window w as (partition by text_sha256 order by size desc, doc_id nulls first, n))
select doc_id, keep_id, group_size::bigint as group_size, n = keep_n as kept, text_sha256 from g
"""


def secret_scan(patterns: dict[str, str], base: tuple[str, ...], least_assigned: int) -> str:
    """What ``secrets`` finds, from the same patterns; matches are placed by what lies between them."""
    def of_kind(no: int, kind: str, pattern: str) -> str:
        p = "'" + pattern.replace("'", "''") + "'"
        group = 2 if kind == "assign" else 0
        return (f"select n, {no} as kind_no, '{kind}' as kind, regexp_extract_all(t, {p}) as f, regexp_extract_all(t, {p}, {group}) as v,"
                f" string_split_regex(t, {p}) as g from d where regexp_matches(t, {p})")

    kinds = " union all ".join(of_kind(i, k, p) for i, (k, p) in enumerate(patterns.items()))
    quoted = ", ".join(f"'{k}'" for k in base)
    counts = ", ".join(f"count(*) filter (where kind = '{k}') as n_{k}" for k in base)
    joined = "coalesce(string_agg(kind || ':' || start || ':' || stop, ',' order by start, kind_no) {0}, '')"
    return f"""
with d as (select doc_id, source, coalesce(text, '') as t, row_number() over () as n from documents),
found as ({kinds}),
one as (select n, kind_no, kind, unnest(f) as f, unnest(v) as v, unnest(g[1:len(f)]) as g, generate_subscripts(f, 1) as i from found),
placed as (select *, sum(length(g) + length(f)) over (partition by n, kind_no order by i) as stop from one),
span as (select n, kind_no, kind, v, (stop - length(f))::bigint as start, stop::bigint as stop from placed where kind <> 'assign' or length(v) >= {least_assigned}),
owned as (select v, count(distinct n) as repositories, count(distinct coalesce('=' || source, '')) as owners from span join d using (n) group by v),
told as (select span.*, owners < 2 and repositories < 4 as live from span join owned using (v)),
summed as (select n, {counts}, sha256({joined.format(f"filter (where kind in ({quoted}))")}) as base_sha256, {joined.format("")} as spans,
  count(*) filter (where live) as n_live from told group by n)
select doc_id, {", ".join(f"coalesce(n_{k}, 0) as n_{k}" for k in base)}, coalesce(base_sha256, sha256('')) as base_sha256, coalesce(spans, '') as spans,
  coalesce(n_live, 0) as n_live from d left join summed using (n)"""


FILTER_AUDIT = r"""
with d as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t from documents),
w as (
  select *, [x for x in string_split_regex(t, '[\x20\x09-\x0D]+') if x <> ''] as words, min(doc_id) over (partition by t) < doc_id as copy from d),
r as (
  select doc_id, part,
    (len(words) < 200)::int + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::int
    + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t))::int + 8 * regexp_matches(t, '[#$%&*|]')::int
    + 16 * coalesce(copy, false)::int as mask from w),
l as (
  select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels where doc_id is not null group by doc_id),
m as (
  select part, mask, count(*) as n, count(*) filter (where good) as good, count(*) filter (where toxic) as toxic
  from r left join l using (doc_id) group by part, mask),
x as (
  select chr(65 + i::int) as f, (1 << i)::int as bit from range(5) s(i)),
o as (
  select a.f || b.f || c.f || e.f || g.f as filter_order, [a.bit, b.bit, c.bit, e.bit, g.bit] as bits
  from x a join x b on a.f <> b.f join x c on c.f not in (a.f, b.f) join x e on e.f not in (a.f, b.f, c.f) join x g on g.f not in (a.f, b.f, c.f, e.f)),
s as (
  select filter_order, k::int as step, bits[k] as bit, list_sum(bits[1:k]) - bits[k] as before from o, range(1, 6) t(k)),
c as (
  select part, filter_order, step, bit,
    coalesce(sum(n) filter (where mask & (bit + before)::int = 0), 0)::bigint as kept,
    coalesce(sum(n) filter (where mask & bit <> 0 and mask & before::int = 0), 0)::bigint as removed,
    coalesce(sum(n) filter (where mask & bit <> 0 and mask & before::int <> 0), 0)::bigint as redundant,
    coalesce(sum(n) filter (where mask = bit), 0)::bigint as unique_fails,
    coalesce(sum(good) filter (where mask & bit <> 0 and mask & before::int = 0), 0)::bigint as good_lost,
    coalesce(sum(toxic) filter (where mask & bit <> 0 and mask & before::int = 0), 0)::bigint as toxic_lost
  from m, s group by part, filter_order, step, bit)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) over (partition by part, bit))::bigint as shapley from c
"""

SOURCE_DIVERGENCE = r"""
with d as (
  select coalesce(text, '') as t, coalesce(lang, '') as lang, coalesce(source, '') as source, row_number() over () as n from documents),
g as (
  select distinct lang, source from d),
x as (
  select n, lang, source, translate(unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as term from d),
kept as (
  select lang, term, count(*) as total from x group by lang, term having count(distinct n) >= 30),
c as (
  select lang, source, term, count(*) as count from x join kept using (lang, term) group by lang, source, term),
v as (
  select lang, count(term) as v, coalesce(sum(total), 0) as n from (select distinct lang from g) left join kept using (lang) group by lang),
gn as (
  select g.lang, g.source, coalesce(sum(count), 0) as n, any_value(v.v) as v from g join v using (lang) left join c using (lang, source) group by g.lang, g.source),
p as (
  select gn.lang, gn.source, term, coalesce(count, 0) as count, 1 + 1000000000::hugeint * (coalesce(count, 0) + 5) // (gn.n + 5 * v) as p
  from gn join kept using (lang) left join c using (lang, source, term)),
q as (
  select lang, term, 1 + 1000000000::hugeint * (total + 5) // (n + 5 * v) as q from kept join v using (lang)),
f as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(sum(abs(a.p - b.p)), 0) as value
  from gn x join gn y on x.lang = y.lang and x.source <> y.source
  left join p a on a.lang = x.lang and a.source = x.source left join p b on b.lang = y.lang and b.source = y.source and b.term = a.term
  where a.term is null or b.term is not null group by a.lang, a.source, b.source),
z as (
  select x.lang, x.source, 'pair' as part, y.source as item, 0 as value from gn x join gn y on x.lang = y.lang and x.source <> y.source where x.v = 0),
t as (
  select lang, source, 'term' as part, term as item, p - q as value from p join q using (lang, term) where count > 0 and p > q),
a as (
  select * from f where lang is not null union all select * from z union all select * from t),
r as (
  select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from a)
select lang, source, part, item, value::bigint as value, rank::int as rank from r where part = 'pair' or rank <= 50
"""
