"""DuckDB SQL of the training-data queries that SQL can express."""

from __future__ import annotations

_PAGES = "pages as (select book_id, part_index, page_id, any_value(token_ids) as t from page_tokens group by all)"
_TOKS = """toks as (select book_id, part_index, page_id, i as pos, cast('0x' || substr(h, 8*i+7, 2) || substr(h, 8*i+5, 2) || substr(h, 8*i+3, 2) || substr(h, 8*i+1, 2) as bigint) as token_id
 from (select book_id, part_index, page_id, hex(t) as h, unnest(range(octet_length(t) // 4)) as i from pages where octet_length(t) % 4 = 0))"""
_DEFS = "defs as (select id as token_id, any_value(lemma_id) as lemma_id, any_value(root_id) as root_id from token_definitions where id is not null group by id)"
#: The mixture of each term, one round of its fit per recursive step, until a round adds less than 1e-9 to a record's log-likelihood.
_FIT = """tf as (select book_id, lemma_id, count(*) as tf from toks join defs using (token_id) where lemma_id <> 0 group by all), books as (select count(distinct book_id) as b from page_tokens),
 hist as (select lemma_id, tf as k, count(*) as n from tf group by all), dfs as (select lemma_id, sum(n)::bigint as df from hist group by 1),
 whole as (select lemma_id, 0 as k, greatest(b - df, 0) as n from dfs, books union all select lemma_id, k, n from hist),
 lists as (select lemma_id, list(k::double order by k) as ks, list(n::double order by k) as ns from whole group by 1),
 first_ as (select lemma_id, ks, ns, list_sum(ns) as total, list_dot_product(ks, ns) as mass from lists),
 em as (select lemma_id, 0 as round, list_transform(ks, lambda k: case when k > mass / greatest(total, 1) then 1.0 else 0.0 end)::double[] as r, 0::double as share, 0::double as up, 0::double as low, '-infinity'::double as ll, true as going from first_
 union all select lemma_id, round, list_transform(d, lambda x: 1 / (1 + exp(-least(greatest(x[1] - x[2], -700), 700))))::double[], share, up, low, lik, lik - ll > 1e-9 * total from (
  select *, list_dot_product(ns, list_transform(d, lambda x: greatest(x[1], x[2]) + ln(1 + exp(-abs(x[1] - x[2]))))::double[]) as lik from (
   select *, list_transform(ks, lambda k: [ln(share) - up + k * ln(up), ln(1 - share) - low + k * ln(low)]) as d from (
    select *, least(greatest((mass - heavy) / greatest(total - high, 1e-9), 1e-9), up) as low from (
     select *, least(greatest(high / greatest(total, 1), 1e-9), 1 - 1e-9) as share, greatest(heavy / greatest(high, 1e-9), 1e-9) as up from (
      select e.lemma_id, e.round + 1 as round, e.ll, f.ks, f.ns, f.total, f.mass, list_dot_product(f.ns, e.r) as high, list_dot_product(list_transform(list_zip(f.ns, f.ks), lambda z: z[1] * z[2])::double[], e.r) as heavy
      from em e join first_ f using (lemma_id) where e.going)))))),
 fitted as (select lemma_id, arg_max(share, round) as share, arg_max(up, round) as up, arg_max(low, round) as low from em group by 1)"""
_COUNTS = f"""{_PAGES}, {_TOKS}, {_DEFS}, occ as (select 'lemma' as kind, lemma_id as term_id, book_id, part_index, page_id from toks join defs using (token_id) where lemma_id <> 0
 union all select 'root', root_id, book_id, part_index, page_id from toks join defs using (token_id) where root_id <> 0),
 cnt as (select kind, term_id, count(*) as occurrences, count(distinct (book_id, part_index, page_id)) as pages from occ group by all),
 known as (select distinct 'lemma' as kind, lemma_id as term_id from token_definitions where lemma_id <> 0 union select distinct 'root', root_id from token_definitions where root_id <> 0),
 marked as (select kind, term_id, coalesce(occurrences, 0) as occurrences, coalesce(pages, 0) as pages, case when occurrences is null then 'unseen' when occurrences <= 2 then 'rare' when pages * 1000 > (select count(*) from pages) * 300 then 'common' end as mark from known left join cnt using (kind, term_id))"""
_RUNS = f"""{_PAGES}, {_TOKS}, seq as (select book_id, part_index, page_id, list(token_id order by pos) as l from toks group by all),
 runs as (select book_id, part_index, page_id, i - 1 as pos, array_to_string(l[i:i+23], ',') as x from (select *, unnest(range(1, len(l) - 22)) as i from seq where len(l) >= 24)),
 shared as (select x from runs group by x having count(distinct (book_id, part_index, page_id)) > 1), hit as (select r.* from runs r join shared using (x)),
 isle as (select *, sum(o) over (partition by book_id, part_index, page_id order by pos) as k from (select book_id, part_index, page_id, pos, case when pos <= lag(pos) over (partition by book_id, part_index, page_id order by pos) + 24 then 0 else 1 end as o from hit)),
 spans as (select book_id, part_index, page_id, min(pos) as span_start, max(pos) + 24 as span_end from isle group by book_id, part_index, page_id, k)"""


_LATER = f"""{_RUNS}, size as (select book_id, part_index, page_id, case when octet_length(t) % 4 = 0 then octet_length(t) // 4 else 0 end as n_tokens from (select book_id, part_index, page_id, coalesce(t, ''::blob) as t from pages)),
 ranked as (select *, row_number() over (partition by x order by book_id, part_index, page_id, pos) as place from hit),
 cover as (select book_id, part_index, page_id, pos + k as pos, bool_or(place > 1) as later from ranked, (select unnest(range(24)) as k) group by book_id, part_index, page_id, pos + k)"""
_HALVES = f"""{_PAGES}, sizes as (select book_id, part_index, page_id, case when octet_length(t) % 4 = 0 then octet_length(t) // 4 else 0 end as n from (select book_id, part_index, page_id, coalesce(t, ''::blob) as t from pages)),
 ranges as (select book_id, part_index, n, (sum(n) over (partition by book_id order by part_index, page_id) - n)::bigint as b from sizes),
 br as (select book_id, b, max(s) as s from (select book_id, b, 1 as s from ranges union all select book_id, min(b), 2 from ranges where n > 0 group by book_id, part_index) where b > 0 group by all),
 w as (select book_id, window_idx, any_value(global_start) as s, any_value(global_end) as e from windows where len(lemma_ids) > 400 and root_ids is not null group by all),
 p as (select book_id, window_idx, s, s as a, e as b from w union all
  select book_id, window_idx, s, case when half = 0 then a else c end, case when half = 0 then c else b end from (select *, coalesce((select arg_max(br.b, [br.s, -abs(br.b - (p.a + p.b) // 2), -br.b]) from br where br.book_id = p.book_id and br.b > p.a and br.b < p.b and abs(br.b - (p.a + p.b) // 2) <= (p.b - p.a) // 4), (p.a + p.b) // 2) as c from p where p.b - p.a > 360), (select unnest([0, 1]) as half))"""


def _near(column: str, least: int) -> str:
    return f"""select a.book_id as book_id_a, a.part_index as part_index_a, a.page_id as page_id_a, b.book_id as book_id_b, b.part_index as part_index_b, b.page_id as page_id_b
 from s a join s b on (a.book_id, a.part_index, a.page_id) < (b.book_id, b.part_index, b.page_id) and len(a.{column}) * 100 >= {least} * len(b.{column}) and len(b.{column}) * 100 >= {least} * len(a.{column})
 where len(list_intersect(a.{column}, b.{column})) * 100 >= {least} * (len(a.{column}) + len(b.{column}) - len(list_intersect(a.{column}, b.{column}))) and len(a.{column}) > 0"""


def oracle_sql() -> dict[str, str]:
    clean = lambda c: f"list_distinct(list_filter(coalesce(any_value({c}), []), lambda x: x <> 0))"
    return {
        "p1_found": """with recursive e as (select distinct source_book_id as a, source_global_start as b, target_book_id as c, target_global_start as d from edges where source_book_id is not null and source_global_start is not null and target_book_id is not null and target_global_start is not null),
 link as (select (a, b) as u, (c, d) as v from e union select (c, d), (a, b) from e), reach as (select u as s, u as t from link union select r.s, l.v from reach r join link l on l.u = r.t)
 select s[1] as book_id, s[2] as global_start, min(t)[1] as group_book_id, min(t)[2] as group_global_start from reach group by s""",
        "p2_found": f"with {_PAGES}, {_TOKS}, {_DEFS}, tf as (select book_id, lemma_id, count(*) as tf from toks join defs using (token_id) where lemma_id <> 0 group by all) select book_id, lemma_id from tf where tf >= 6 and lemma_id in (select lemma_id from tf group by 1 having count(*) between 2 and 3)",
        "p2_scores": f"with recursive {_PAGES}, {_TOKS}, {_DEFS}, {_FIT} select book_id, lemma_id, tf, df, round(1 / (1 + exp(-least(greatest((ln(share) - up + tf * ln(up)) - (ln(1 - share) - low + tf * ln(low)), -700), 700))), 4) as score from tf join dfs using (lemma_id) join fitted using (lemma_id)",
        "p3_found": f"with {_COUNTS} select kind, term_id, mark from marked where mark in ('rare', 'common')",
        "p3_counts": f"with {_COUNTS} select kind, term_id, occurrences, pages, mark from marked",
        "p4_found": f"with {_RUNS} select * from spans",
        "p4_shares": f"with {_LATER} select book_id, part_index, page_id, n_tokens, coalesce(n_shared, 0) as n_shared, coalesce(n_later, 0) as n_later from size left join (select book_id, part_index, page_id, count(*) as n_shared, count(*) filter (later) as n_later from cover group by all) using (book_id, part_index, page_id)",
        "p4_kept": f"with {_LATER} select book_id, part_index, page_id, coalesce(n_kept, 0) as n_kept, coalesce(kept, '') as kept from size left join (select book_id, part_index, page_id, count(*) as n_kept, string_agg(token_id::varchar, ',' order by pos) as kept from toks t left join cover c using (book_id, part_index, page_id, pos) where not coalesce(later, false) group by all) using (book_id, part_index, page_id)",
        "p5_halves": f"with recursive {_HALVES} select book_id, window_idx, row_number() over (partition by book_id, window_idx order by a) - 1 as piece_no, case when a > s then greatest(s, a - 40) else a end as piece_start, b as piece_end from p where b - a <= 360",
        "p5_found": f"""with recursive {_PAGES}, sizes as (select book_id, part_index, page_id, case when octet_length(t) % 4 = 0 then octet_length(t) // 4 else 0 end as n from (select book_id, part_index, page_id, coalesce(t, ''::blob) as t from pages)),
 br as (select distinct book_id, (sum(n) over (partition by book_id order by part_index, page_id) - n)::bigint as b from sizes), w as (select book_id, window_idx, any_value(global_start) as s, any_value(global_end) as e from windows where len(lemma_ids) > 400 and root_ids is not null group by all),
 p as (select book_id, window_idx, 0 as piece_no, s as piece_start, case when e - s <= 400 then e else coalesce((select max(b) from br where br.book_id = w.book_id and b > s + 40 and b <= s + 400), s + 400) end as piece_end, e from w
 union all select book_id, window_idx, piece_no + 1, piece_end - 40, case when e - piece_end + 40 <= 400 then e else coalesce((select max(b) from br where br.book_id = p.book_id and b > p.piece_end and b <= p.piece_end + 360), p.piece_end + 360) end, e from p where piece_end < e)
 select book_id, window_idx, piece_no::bigint as piece_no, piece_start, piece_end from p""",
        "p7_groups": f"""with recursive s as materialized (select book_id, part_index, page_id, list_sort({clean('lemma_ids')}) as l, list_sort({clean('root_ids')}) as r from page_lemmas where len(lemma_ids) >= 30 group by all),
 c as materialized (select l, r, min((book_id, part_index, page_id)) as k from s group by all),
 links as materialized (select a.k as a, b.k as b from c a join c b on a.k < b.k where (len(a.l) > 0 and len(list_intersect(a.l, b.l)) * 100 >= 70 * (len(a.l) + len(b.l) - len(list_intersect(a.l, b.l)))) or (len(a.r) > 0 and len(list_intersect(a.r, b.r)) * 100 >= 80 * (len(a.r) + len(b.r) - len(list_intersect(a.r, b.r))))),
 ends as (select a as x, b as y from links union all select b, a from links), reach as (select k as x, k as y from c union select reach.x, ends.y from reach join ends on ends.x = reach.y),
 g as (select x, min(y) as root from reach group by x), n as (select x, count(*) as n from ends group by x)
 select book_id, part_index, page_id, k[1] as class_book_id, k[2] as class_part_index, k[3] as class_page_id, root[1] as group_book_id, root[2] as group_part_index, root[3] as group_page_id, coalesce(n, 0) as n_links from s join c using (l, r) join g on g.x = k left join n on n.x = k""",
        "p7_found": f"with s as (select book_id, part_index, page_id, {clean('lemma_ids')} as l, {clean('root_ids')} as r from page_lemmas where len(lemma_ids) >= 30 group by all) {_near('l', 70)} union {_near('r', 80)}",
    }
