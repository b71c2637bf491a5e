"""DuckDB SQL for the queries that SQL can express."""

from ..plans.catalog import S_CRC_TABLE as CRC_TABLE
from ..plans.catalog import s_crc32 as crc32

LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {
    "op10_suffix_dedup": r"""
with d as (select doc_id, lower(hex(encode(coalesce(text, '')))) x, octet_length(encode(coalesce(text, ''))) n from documents),
w as (select doc_id, p, substr(x, 2 * p + 1, 200) s from d, unnest(range(0, greatest(n - 99, 0))) t(p)),
f as (select md5_number(s) h, min(doc_id * 1000000000 + p) least from w group by h),
cov as (select w.doc_id, p from w join f on md5_number(w.s) = f.h where w.doc_id * 1000000000 + p <> f.least),
g as (select doc_id, p, lag(p) over (partition by doc_id order by p) before from cov),
r as (select doc_id, p, sum(case when before is null or p - before > 100 then 1 else 0 end) over (partition by doc_id order by p) k from g),
runs as (select doc_id, k, min(p) a, max(p) + 100 e from r group by doc_id, k),
gaps as (select doc_id, coalesce(lag(e) over (partition by doc_id order by a), 0) a, a e from runs
         union all select doc_id, max(e), null from runs group by doc_id),
kept as (select g.doc_id, string_agg(substr(x, cast(2 * g.a + 1 as bigint), cast(2 * (coalesce(g.e, n) - g.a) as bigint)), '' order by g.a) x from gaps g join d using (doc_id) group by g.doc_id),
tot as (select doc_id, sum(e - a) n_removed, count(*) n_spans from runs group by doc_id)
select d.doc_id, cast(d.n as bigint) n_bytes, cast(coalesce(n_removed, 0) as bigint) n_removed, cast(coalesce(n_spans, 0) as bigint) n_spans,
       sha256(unhex(coalesce(kept.x, d.x))) kept_sha256
from d left join tot using (doc_id) left join kept using (doc_id)""",
    "op2_ngram_join": rf"""
with recursive d as (select doc_id, regexp_extract_all(coalesce({LOWER}, ''), '[^\x20\x09-\x0D]+') w from documents),
sh as (select distinct doc_id, array_to_string(list_slice(w, i, i + 3), ' ') || case when len(w) < 4 then '#' || len(w) else '' end g
       from d, unnest(range(1, greatest(len(w) - 3, 1) + 1)) t(i) where len(w) > 0),
n as (select doc_id, count(*) n from sh group by doc_id),
rare as (select sh.doc_id, sh.g, row_number() over (partition by sh.doc_id order by f, sh.g) r
         from sh join (select g, count(*) f from sh group by g) using (g)),
pre as (select rare.doc_id, g from rare join n using (doc_id) where r <= n - ceil(n * 85 / 100.0) + 1),
cand as (select distinct a.doc_id x, b.doc_id y from pre a join pre b on a.g = b.g and a.doc_id < b.doc_id),
com as (select x, y, count(*) c from cand join sh a on a.doc_id = x join sh b on b.doc_id = y and a.g = b.g group by x, y),
link as (select x, y from com join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= 85 * (a.n + b.n - c)),
e as (select x, y from link union all select y, x from link),
reach(s, v) as (select doc_id, doc_id from documents union select s, y from reach join e on v = x)
select d.doc_id, cast(coalesce(n, 0) as bigint) n_shingles, c.component_id
from d left join n using (doc_id) join (select s, min(v) component_id from reach group by s) c on c.s = d.doc_id""",
    "op6_decontaminate": rf"""
with d as (select doc_id, regexp_extract_all(coalesce({LOWER}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
b as (select item_id, regexp_extract_all(coalesce({LOWER}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
bw as (select distinct item_id, least(13, len(w)) n, array_to_string(list_slice(w, i, i + least(13, len(w)) - 1), ' ') k
       from b, unnest(range(1, greatest(len(w) - 12, 1) + 1)) t(i) where len(w) > 0 and item_id is not null),
ns as (select distinct n from bw),
dw as (select doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') k from d, ns, unnest(range(1, greatest(len(w) - n + 1, 0) + 1)) t(i)),
hit as (select doc_id, i, dw.n, item_id from dw join bw on dw.n = bw.n and dw.k = bw.k),
cov as (select doc_id, count(distinct j) n_hit from (select distinct doc_id, i, n from hit), unnest(range(i, i + n)) t(j) group by doc_id),
its as (select doc_id, count(distinct item_id) n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) s from hit group by doc_id)
select d.doc_id, cast(len(w) as bigint) n_words, cast(coalesce(n_hit, 0) as bigint) n_hit, cast(coalesce(n_items, 0) as bigint) n_items,
       sha256(coalesce(s, '')) items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) contaminated
from d left join cov using (doc_id) left join its using (doc_id)""",
    "op11_spelling": rf"""
with recursive crc as ({CRC_TABLE}),
r as (select cast(doc_id as varchar) id, unnest(regexp_extract_all(coalesce({LOWER}, ''), '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) w from documents),
k as (select distinct id, w, coalesce(id, '') || ':' || w s from r where length(w) >= 6),
h as materialized (select id, w, {crc32("s")} h from k, crc),
t as (select case when h % 199 = 0 then substr(r.w, 1, cast(h % length(r.w) as int)) || substr(r.w, cast(h % length(r.w) as int) + 2) else r.w end word
      from r join h on r.id is not distinct from h.id and r.w = h.w),
v as materialized (select word, count(*) n from t where length(word) >= 6 group by word having count(*) >= 5),
d as (select distinct word, n, substr(word, 1, i - 1) || substr(word, i + 1) s from v, unnest(range(1, length(word) + 1)) x(i)),
g as (select word, n, substr(word, 1, i - 1) || chr(0) || substr(word, i + 1) s from v, unnest(range(1, length(word) + 1)) x(i)),
near as (select a.word a, a.n a_n, b.word b, b.n b_n from d a join v b on a.s = b.word
         union select b.word, b.n, a.word, a.n from d a join v b on a.s = b.word
         union select x.word, x.n, y.word, y.n from g x join g y on x.s = y.s and x.word <> y.word),
best as (select a, count(*) n_near, arg_min(b, (-b_n, b)) b, max(b_n) b_n from near group by a),
f as materialized (select word, n, coalesce(n_near, 0) n_near, case when b_n >= 5 * n then b end form, case when b_n >= 5 * n then b_n end form_n from v left join best on a = word),
walk(word, reached) as (select word, word from f union all select walk.word, f.form from walk join f on f.word = walk.reached where f.form is not null),
root as (select walk.word, reached root from walk join f on f.word = walk.reached where f.form is null)
select f.word, form, root, n, n_near, form_n from f join root using (word)""",
    "op12_resample": rf"""
with crc as ({CRC_TABLE}),
d as (select doc_id, regexp_extract_all(coalesce({LOWER}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
m as (select unnest(regexp_extract_all(coalesce({LOWER}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) f from benchmark),
o as (select doc_id, unnest(w) f from d),
b as materialized (select f, {crc32("f")} % 10000 b from (select f from o union select f from m), crc),
s as (select b, count(*) s from o join b using (f) group by b),
t as (select b, count(*) t from m join b using (f) group by b),
tot as (select cast((select coalesce(sum(s), 0) from s) as double) sa, cast((select coalesce(sum(t), 0) from t) as double) ta),
g as (select b, cast(floor(1000 * ln((cast(coalesce(t, 0) as double) + 1) * (sa + 10000) / ((cast(coalesce(s, 0) as double) + 1) * (ta + 10000)))) as bigint) g from s full join t using (b), tot),
w as (select doc_id, sum(g) weight from o join b using (f) join g using (b) group by doc_id),
x as (select doc_id, cast(len(d.w) as bigint) n_features, cast(coalesce(weight, 0) as bigint) weight,
      cast('0x' || substr(sha256('2024:' || doc_id), 1, 8) as bigint) h from d left join w using (doc_id)),
y as (select doc_id, n_features, weight, weight + cast(floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296))) as bigint) score from x),
z as (select doc_id, row_number() over (order by score desc, doc_id) r, count(*) over () n from y where n_features >= 20)
select doc_id, n_features, weight, score, case when r <= 10 * n // 100 then r end "rank" from y left join z using (doc_id)""",
}
