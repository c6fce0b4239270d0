"""The queries in SQL, for an independent engine."""

from __future__ import annotations

_H = """
with e as (select user_id as store, event_id, event_type, value, row_number() over (partition by user_id order by ts, event_id) as pos from events),
h as (select store, pos, pos * 100 as step, case when (pos - 1) % 11 <> 0 then pos - (pos - 1) % 11 end as base,
             ((pos - 1) % 11 = 0 or event_type <> 'error') as finalized, event_id % 29 = 0 as pinned, event_id, event_type, value from e),
pinned as (select store, pos from h where pinned union select store, base from h where pinned and base is not null),
flagged as (select h.*, p.pos is not null as prot from h left join pinned p on h.store = p.store and h.pos = p.pos)
"""
_ENTRIES = _H + """, entries as (
  select store, pos, r as rank, case event_type when 'view' then 'skipped' when 'click' then 'delta' when 'signup' then 'alias' else 'full' end as kind,
         event_id % 900 + 100 + r as raw_size, event_id % 900 + 100 + r - event_id % 97 as compressed_size from h, (select unnest([0, 1])::int as r))
"""
_LIST = _ENTRIES + """, listed as (
  select h.store, h.pos, h.step, h.base is not null as is_delta, sum(compressed_size)::bigint as total_compressed, sum(raw_size)::bigint as total_raw,
         sum(case when kind in ('skipped', 'alias') then 1 else 0 end)::bigint as skipped_tensors, sum(case when kind = 'delta' then 1 else 0 end)::bigint as delta_tensors,
         sum(case when kind = 'full' then 1 else 0 end)::bigint as full_tensors, count(distinct rank) as ranks
  from h join entries t on h.store = t.store and h.pos = t.pos where finalized group by 1, 2, 3, 4)
"""
_V = """
with o as (select o_orderkey, o_orderstatus as s, o_orderpriority as p from orders),
base as (select o_orderkey, md5(s || '|' || p) as h, length(s || '|' || p) as n from o where o_orderkey % 10 <> 1),
target as (select o_orderkey, md5(s || '|' || p) as h, length(s || '|' || p) as n
           from (select o_orderkey, case when o_orderkey % 5 = 0 then 'X' else s end as s, p from o where o_orderkey % 10 <> 2))
"""
_C = """
with c as (select o_orderkey, round(o_totalprice * 100)::bigint as a, (round(o_totalprice * 100) + case when o_orderkey % 3 = 0 then 7 else 0 end)::bigint as b from orders)
"""
_D = """
with d as (select doc_id, n_chars, octet_length(encode(text)) as bytes, first_value(doc_id) over (partition by md5(text), lang order by doc_id) as owner,
                  first_value(n_chars) over (partition by md5(text), lang order by doc_id) as owned from documents)
"""

_STATS = """, g as (
  select store, count(*) as total_snapshots, count(*) filter (not is_delta) as full_snapshots, count(*) filter (is_delta) as delta_snapshots,
         sum(skipped_tensors)::bigint as skipped_tensors, sum(delta_tensors)::bigint as delta_tensors, sum(full_tensors)::bigint as full_tensors,
         sum(total_raw)::bigint as total_raw_bytes, sum(total_compressed)::bigint as total_compressed_bytes,
         (coalesce(arg_min(total_raw, pos) filter (not is_delta), arg_min(total_raw, pos)) * count(*))::bigint as estimated_naive_bytes from {listed} group by store)
select *, skipped_tensors + delta_tensors + full_tensors as total_tensors_saved,
       case when total_raw_bytes > 0 then total_compressed_bytes::double / total_raw_bytes else 1.0 end as compression_ratio,
       estimated_naive_bytes - total_compressed_bytes as total_saved_bytes,
       case when estimated_naive_bytes > 0 then (estimated_naive_bytes - total_compressed_bytes)::double / estimated_naive_bytes * 100 else 0.0 end as savings_percent from g"""

ORACLE_SQL = {
    "classify": _V + "select case when t.h = b.h then 'skipped' when t.n = b.n then 'delta' else 'full' end as kind, count(*) as n from target t left join base b using (o_orderkey) group by 1",
    "dedup_plan": _D + "select doc_id, case when owner <> doc_id then owner end as alias_of from d",
    "alias_resolve": _D + "select doc_id::varchar as name, case when owner <> doc_id then owner::varchar end as alias_of, owned as data from d",
    "xor_delta": _C + "select o_orderkey, xor(a, b) as delta, bit_count(xor(a, b))::int as bits from c",
    "apply_delta": _C + "select o_orderkey, b as v from c",
    "delta_density": """
with e as (select vec_id, list_transform(embedding, lambda x: round(x::double * 10)::int) as a from embeddings),
z as (select vec_id, list_transform(list_zip(a, list_reverse(a)), lambda p: xor(p[1], p[2])) as x from e)
select vec_id, case when len(x) > 0 then len(list_filter(x, lambda v: v <> 0))::double / len(x) else 0.0 end as density from z""",
    "element_size": """
select p_partkey, ['float32', 'bfloat16', 'int64', 'bool', 'complex128'][(p_partkey % 5 + 1)::int] as dtype, [4, 2, 8, 1, 16][(p_partkey % 5 + 1)::int]::int as bytes from part""",
    "part_size": "select o_orderkey, greatest(16777216, ceil(o_orderkey * 20000000 / 9984.0::double))::bigint as bytes from orders",
    "pack_offsets": "select source, doc_id, n_chars, (coalesce(sum(n_chars) over (partition by source order by doc_id rows between unbounded preceding and 1 preceding), 0) + 32)::bigint as \"offset\" from documents",
    "fp8_scale": """
select vec_id, case when s >= 1.1754943508222875e-38 and not isinf(s) then s::double else 1.0::double end as scale from (
  select vec_id, case when vec_id % 5 = 0 then 0.0::float else (list_max(list_transform(list_filter(embedding, lambda x: not isnan(x) and not isinf(x)), lambda x: abs(x)::double)) / 448.0::double)::float end as s from embeddings)""",
    "glob_first_match": """
select p_partkey, case when n like '%BRUSHED%' then 'bfloat16' when n like '%/Brand#1%' then 'float8_e4m3fn' when n like 'PROMO%' then 'none' when n like '%STEEL%' then 'float16' else 'float32' end as dtype
from (select p_partkey, p_type || '/' || p_brand as n from part)""",
    "dead_patterns": """
with r(ord, pattern, lk) as (values (0, '*BRUSHED*', '%BRUSHED%'), (1, '*/Brand#1*', '%/Brand#1%'), (2, 'PROMO*', 'PROMO%'), (3, '*STEEL*', '%STEEL%'), (4, '*', '%'), (5, 'NO SUCH*', 'NO SUCH%'), (6, '*%*', '%$%%'))
select ord::int as ord, pattern from r where not exists (select 1 from part where p_type like lk escape '$')""",
    "list_snapshots": _LIST + "select * from listed",
    "stats": _LIST + _STATS.format(listed="listed"),
    "stats_without_fulls": _LIST + ", deltas as (select * from listed where is_delta)" + _STATS.format(listed="deltas"),
    "classify_documents": """
select doc_id, case when b = text then 'skipped' when octet_length(encode(text)) >= 4096 and doc_id % 5 <> 0 then 'delta' else 'full' end as kind
from (select doc_id, text, case when doc_id % 3 = 0 then array_to_string(list_reverse(string_split(text, '')), '') else text end as b from documents)""",
    "dedup_plan_large": _D + "select doc_id, case when owner <> doc_id and bytes >= 4096 then owner end as alias_of from d",
    "alias_chains": "select p_partkey::varchar as name, (p_partkey - (p_partkey - 1) % 5)::varchar as owner, ((p_partkey - 1) % 5)::int as hops from part",
    "rank_totals": _ENTRIES + "select store, pos, rank, sum(raw_size)::bigint as raw, sum(compressed_size)::bigint as compressed, count(*) filter (kind in ('skipped', 'alias')) as skipped from entries group by 1, 2, 3",
    "casts_anything": "select * from (values ('mixed', true), ('none', false)) as t(policy, casts_anything)",
    "object_keys": "select page_id, 'runs/a/' || url as key, url as bare from pages",
    "force_full_capped": _H + "select store, pos, step, true as is_full, null::bigint as base from h",
    "force_full_gated": """
with recursive e as (select user_id as store, event_id * 10 as step, row_number() over (partition by user_id order by ts, event_id) as pos from events),
r as (
  select store, pos, step, pos as f, step as at from e where pos = 1
  union all
  select e.store, e.pos, e.step,
         case when greatest(e.step - r.at, 0) >= 10000000 or e.pos - r.f > 10 then e.pos else r.f end,
         case when greatest(e.step - r.at, 0) >= 10000000 or e.pos - r.f > 10 then e.step else r.at end
  from r join e on e.store = r.store and e.pos = r.pos + 1)
select store, pos, f = pos as is_full, case when f <> pos then f end as base from r""",
    "resume_out_of_order": _H + "select store, coalesce(arg_max(case when pos % 7 = 0 then step - 650 else step end, pos) filter (finalized) + 1, 0) as resume_step from h group by store",
    "describe": _ENTRIES + "select store, pos, rank, kind, raw_size, compressed_size from entries join (select store, max(pos) as pos from h where finalized group by store) using (store, pos)",
    "load_latest": _H + "select store, pos, event_id, value from (select *, row_number() over (partition by store order by pos desc) as r from h where finalized) where r = 1",
    "load_arrays": _C + "select o_orderkey, a as v from c where o_orderkey % 100 = 0",
    "last_full": _H + "select store, pos, event_id from (select *, row_number() over (partition by store order by pos desc) as r from h where finalized and base is null) where r = 1",
    "base_in_effect": _H + "select store, pos, max(case when base is null then pos end) over (partition by store order by pos rows between unbounded preceding and 1 preceding) as base_for from h",
    "pending_deltas": _H + "select store, max(pos) - coalesce(max(case when base is null then pos end), 0) as pending from h group by store",
    "resume_step": _H + "select store, coalesce(max(case when finalized then step end) + 1, 0) as resume_step from h group by store",
    "save_best": """
select event_id, user_id, value from (select *, min(value) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding) as m from events)
where m is null or value < m""",
    "force_full_cadence": _H + "select store, pos, step, (pos - 1) % 11 = 0 as is_full, base from h",
    "retention_r1": _H + """, f as (
  select store, pos, sum(case when not prot then 1 else 0 end) over (partition by store order by pos) as n, count(*) over (partition by store) - 3 as x, prot from flagged where finalized and base is null),
dead as (select store, pos from f where not prot and n <= x)
select event_id from h where not exists (select 1 from dead d where d.store = h.store and d.pos = coalesce(h.base, h.pos))""",
    "retention_r2": _H + """, f as (
  select *, finalized and not prot and pos <> max(case when finalized then pos end) over (partition by store) as free, sum(case when finalized then 1 else 0 end) over (partition by store) as total from flagged),
deps as (select store, base as pos, bool_and(free) as al, max(pos) as lst from f where base is not null group by 1, 2),
c as (select f.*, row_number() over (partition by f.store order by greatest(f.pos, coalesce(d.lst, f.pos)), f.base is null, f.pos) as r
      from f left join deps d on f.store = d.store and f.pos = d.pos where free and (f.base is not null or coalesce(d.al, true)))
select event_id from h where not exists (select 1 from c where c.store = h.store and c.pos = h.pos and r <= total - 20)""",
    "stride_survivors": _H + """, t as (select *, count(*) over (partition by store) as n from (select *, max(case when base is null then pos end) over (partition by store) as lf from h) where pos > lf),
k as (select store, arg_max(pos, pos) as kp, arg_max(base, pos) as kb from t where finalized and n >= 2 group by store),
dead as (select t.store, t.pos from t join k on t.store = k.store where finalized and n >= 2 and t.pos <> kp and t.base = kb)
select event_id from h where not exists (select 1 from dead d where d.store = h.store and d.pos = h.pos)""",
    "full_merge_plan": _H + """, t as (select * from (select *, max(case when base is null then pos end) over (partition by store) as lf from h) where pos > lf and finalized)
select store, max(pos) as pos, arg_max(base, pos) as base, arg_max(step, pos) as step, count(*) as merged_deltas from t group by store""",
    "rollback_safe": _H + "select store, pos from (select *, row_number() over (partition by store order by pos desc) as r from h where finalized and base is null and step % 200 = 0) where r <= 2",
    "protected": _H + """select store, pos from pinned union
select store, pos from (select *, row_number() over (partition by store order by pos desc) as r from h where finalized and base is null and step % 200 = 0) where r <= 2""",
    "finalize_complete": "select l_orderkey, count(distinct l_linenumber) as parts, max(l_linenumber)::bigint as expected from lineitem group by 1 having count(distinct l_linenumber) >= max(l_linenumber)",
    "sync_absent": "select doc_id from documents anti join labels using (doc_id)",
    "reachable": _H + """select a.store, a.pos from h a left join h b on a.store = b.store and a.base = b.pos
where a.event_id % 13 <> 0 and (a.base is null or b.event_id % 13 <> 0)""",
    "recovery_order": _H + """, o as (select a.* from h a left join h b on a.store = b.store and a.base = b.pos where a.event_id % 3 = 0 and (a.base is null or b.event_id % 3 in (0, 1)))
select store, pos, row_number() over (partition by store order by step, pos)::int as admit from o""",
}
