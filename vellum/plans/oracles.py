"""DuckDB SQL of the catalogue's queries. Those it leaves out (alignments, reports) are tested against brute force."""

from __future__ import annotations

_PAGES = "pages as (select book_id, part_index, page_id, any_value(token_ids) as t from page_tokens group by all)"
_SIZES = "sizes as (select book_id, part_index, page_id, case when octet_length(t) % 4 = 0 then octet_length(t) // 4 else 0 end::bigint as n from (select book_id, part_index, page_id, coalesce(t, ''::blob) as t from pages))"
_DEFS = "defs as (select id as token_id, any_value(surface) as surface, any_value(lemma_id) as lemma_id, coalesce(any_value(root_id), 0) as root_id from token_definitions where id is not null group by id)"
_TOKS = """toks as (select book_id, part_index, page_id, i as page_off, cast('0x' || substr(h, 8*i+7, 2) || substr(h, 8*i+5, 2) || substr(h, 8*i+3, 2) || substr(h, 8*i+1, 2) as bigint) as token_id
 from (select book_id, part_index, page_id, hex(t) as h, unnest(range(octet_length(t) // 4)) as i from pages where octet_length(t) % 4 = 0))"""
_STREAM = """stream as (select book_id, row_number() over (partition by book_id order by part_index, page_id, page_off) - 1 as pos, part_index, page_id, page_off, k.token_id, coalesce(surface, '') as surface,
 coalesce(lemma_id, 0) as lemma_id, coalesce(root_id, 0) as root_id from toks k left join defs using (token_id))"""
_BASE = ", ".join([_PAGES, _SIZES, _DEFS, _TOKS, _STREAM])
_LENGTHS = "lengths as (select book_id, sum(n)::bigint as length from sizes group by 1)"
_COUNT = "case when length <= 0 then 0 when length < 275 then 1 else (length - 275) // 60 + 1 + case when length - ((length - 275) // 60 + 1) * 60 >= 10 then 1 else 0 end end"
_WINDOWS = f"""{_LENGTHS}, wr as (select book_id, k as window_idx, k * 60 as global_start, least(k * 60 + 275, length) as global_end from (select *, unnest(range({_COUNT})) as k from lengths)),
 win as (select w.book_id, window_idx, global_start, global_end, list(lemma_id order by pos) as l, list(root_id order by pos) as r,
 first(part_index || ':' || page_id || '.' || page_off order by pos) as start_at, last(part_index || ':' || page_id || '.' || page_off order by pos) as end_at
 from wr w join stream s on s.book_id = w.book_id and pos >= global_start and pos < global_end group by all)"""
_SHINGLES = "sh as (select distinct book_id, window_idx, array_to_string(l[i:i+4], ',') as shingle from (select book_id, window_idx, l, unnest(range(1, len(l) - 3)) as i from win where len(l) >= 5))"
_CAND = "cand as (select a.book_id as book_a, a.window_idx as widx_a, b.book_id as book_b, b.window_idx as widx_b, count(*) as shared from sh a join sh b on a.shingle = b.shingle and a.book_id < b.book_id group by all having count(*) >= 3)"
_EDGES = "e as (select distinct on (id) * from edges order by id)"
_WHOLE = "w as (select * from e where source_book_id is not null and target_book_id is not null and source_global_start is not null and source_global_end is not null and target_global_start is not null and target_global_end is not null)"
_STORED = "st as (select book_id, window_idx, any_value(lemma_ids) as lemma_ids from windows group by all)"


def _cover(side: str) -> str:
    s = "source" if side == "a" else "target"
    return f"""c{side} as (select book_a, book_b, sum(e - s)::bigint as covered_{side} from (select book_a, book_b, isle, min(s) as s, max(e) as e from (select *, sum(o) over (partition by book_a, book_b order by s, e rows unbounded preceding) as isle from
 (select *, case when s <= max(e) over (partition by book_a, book_b order by s, e rows between unbounded preceding and 1 preceding) then 0 else 1 end as o from
 (select distinct source_book_id as book_a, target_book_id as book_b, {s}_global_start as s, {s}_global_end as e from w))) group by all) group by all)"""


_COVER = f"{_cover('a')}, {_cover('b')}, cov as (select book_a, book_b, covered_a, case when book_a = book_b then covered_a else covered_b end as covered_b from ca full join cb using (book_a, book_b))"


def _loc(x: str) -> str:
    return f"{x}_start_page.part_index || ':' || {x}_start_page.page_id || '.' || {x}_start_offset || ' → ' || {x}_end_page.part_index || ':' || {x}_end_page.page_id || '.' || {x}_end_offset"


_SIDE = [f"{s}_{c}" for s in ("source", "target") for c in ("start_page", "start_offset", "end_page", "end_offset", "global_start", "global_end")]
_METRIC = ["core_similarity", "span_coverage", "content_weight", "lexical_diversity", "lemma_similarity", "combined_similarity", "weighted_similarity", "avg_match_weight"]
_COUNTED = ["aligned_length", "lemma_matches", "substitutions", "root_only_matches", "gaps"]


def _millionths(c: str) -> str:
    return f"floor({c}::float::double * 1000000)::bigint as {c}_ppm"


def _flat(*more: str) -> str:
    sides = ", ".join(f"{s}_book_id, {s}_start_page.part_index as {s}_start_part, {s}_start_page.page_id as {s}_start_page, {s}_start_offset, {s}_end_page.part_index as {s}_end_part, {s}_end_page.page_id as {s}_end_page, {s}_end_offset, {s}_global_start, {s}_global_end" for s in ("source", "target"))
    return f"id, {sides}, {', '.join(_COUNTED)}, {', '.join(_millionths(c) for c in (*_METRIC[:-1], *more))}"


def _fold(slack: int) -> str:
    """The merge fold, one recursive step per place in a pair's order, with all columns of an edge."""
    lt = "<" if not slack else "<="
    more = f" + {slack}" if slack else ""
    over = " and ".join(f"f.{s}_global_start {lt} n.{s}_global_end{more} and n.{s}_global_start {lt} f.{s}_global_end{more}" for s in ("source", "target"))
    own = {}
    for s in ("source", "target"):
        for e, cmp in (("start", "<"), ("end", ">")):
            for c in (f"{s}_global_{e}", f"{s}_{e}_page", f"{s}_{e}_offset"):
                own[c] = f"case when n.{s}_global_{e} {cmp} f.{s}_global_{e} then n.{c} else f.{c} end"
    quotient = lambda x, y: f"(case when {y} > 0 then ({x})::float / ({y})::float else 0 end)::float"
    mean = lambda c: f"((f.{c} + n.{c}) / 2::float)::float"
    less = lambda c, share: f"greatest(0, f.{c} + n.{c} - trunc(shared::float * ({share})::float)::bigint)"
    of = lambda c: quotient(f"f.{c}", "f.aligned_length")
    cols = [*_SIDE, *_COUNTED, *_METRIC]
    new = own | {"aligned_length": "len", "lemma_matches": "hits", "substitutions": "subs", "root_only_matches": "roots", "gaps": "(f.gaps + n.gaps) // 2", "core_similarity": quotient("hits", "hits + subs"), "span_coverage": quotient("hits + subs", "len"), "lemma_similarity": quotient("hits", "len"), "combined_similarity": quotient("(hits::float + 0.5::float * roots::float)::float", "len"), **{c: mean(c) for c in ("content_weight", "lexical_diversity", "weighted_similarity")}, "avg_match_weight": mean("content_weight")}
    step = ", ".join(f"case when joined then {new[c]} else n.{c} end as {c}" for c in cols)
    return f"""with recursive {_EDGES}, o as (select id, source_book_id, target_book_id, {', '.join(_SIDE)}, {', '.join(_COUNTED)}, {', '.join(f'coalesce({c}, 0)::float as {c}' for c in _METRIC)}, row_number() over (partition by source_book_id, target_book_id order by source_global_start, target_global_start, id) as k from e where source_book_id is not null and target_book_id is not null
 and source_global_start is not null and source_global_end is not null and target_global_start is not null and target_global_end is not null and {' and '.join(f'{c} is not null' for c in _COUNTED)}),
 f as (select source_book_id, target_book_id, k, 1::bigint as grp, id, {', '.join(cols)} from o where k = 1
 union all select f.source_book_id, f.target_book_id, n.k, case when joined then f.grp else f.grp + 1 end, case when joined then f.id else n.id end, {step}
 from (select *, {less('lemma_matches', 'f.lemma_similarity')} as hits, {less('substitutions', of('substitutions'))} as subs, {less('root_only_matches', of('root_only_matches'))} as roots
  from (select f, n, {over} as joined, greatest(0, least(f.source_global_end, n.source_global_end) - greatest(f.source_global_start, n.source_global_start)) as shared, greatest(f.source_global_end, n.source_global_end) - least(f.source_global_start, n.source_global_start) as len
   from f join o n on n.source_book_id = f.source_book_id and n.target_book_id = f.target_book_id and n.k = f.k + 1)))
 select {_flat('avg_match_weight')} from f qualify row_number() over (partition by source_book_id, target_book_id, grp order by k desc) = 1"""


_PUNCT = ".,;:!?()[]<>\"''"
_TEXTS = f"""texts as (select 'a' as side, item_id as id, text from eval_items where text is not null union all select 'b', doc_id, text from documents where text is not null),
 words as (select side, id, list_filter(string_split_regex(text, '[ \\t\\n\\r\\f]+'), lambda x: x <> '') as ws from texts),
 lem as (select side, id, list_transform(ws, lambda x: case when translate(x, '{_PUNCT}', '') = '' then x else translate(x, '{_PUNCT}', '') end) as l, len(ws) as length from words),
 tok as (select side, id, length, unnest(range(length)) as pos, unnest(l) as lemma from lem where length > 0),
 cnt as (select side, id, lemma, least(greatest(ln(any_value(length) / count(*)), 0.5), 3.0)::float as wt from tok group by side, id, lemma),
 tw as (select t.side, t.id, pos, lemma, case when length(lemma) >= 3 then substring(lemma, 1, 3) end as root, wt from tok t join cnt using (side, id, lemma)),
 wr as (select side, id, length, k as widx, k * 60 as lo, least(k * 60 + 275, length) as hi from (select side, id, length, unnest(range({_COUNT})) as k from lem)),
 sh as (select distinct side, id, widx, l[i:i+4] as x from (select w.side, w.id, widx, lem.l, unnest(range(lo + 1, hi - 3)) as i from wr w join lem using (side, id) where hi - lo >= 5)),
 cand as (select row_number() over () as k, * from (select a.id as item_id, a.widx as widx_a, b.id as doc_id, b.widx as widx_b from sh a join sh b on a.side = 'a' and b.side = 'b' and a.x = b.x group by all having count(*) >= 3)),
 ca as (select k, pos - lo as i, lemma, root, wt, hi - lo as n from cand c join wr w on w.side = 'a' and w.id = c.item_id and w.widx = c.widx_a join tw t on t.side = 'a' and t.id = c.item_id and t.pos >= lo and t.pos < hi),
 cb as (select k, pos - lo as j, lemma, root, wt from cand c join wr w on w.side = 'b' and w.id = c.doc_id and w.widx = c.widx_b join tw t on t.side = 'b' and t.id = c.doc_id and t.pos >= lo and t.pos < hi)"""


def _aligned(mode: str, weighted: bool, band: int | None = None) -> str:
    """All cells of all candidate pairs, one recursive step per row of the item. A cell carries its score and, packed into one
    number, the start of its path and the counts along it; where a score is reached from the left only, the path is that of the
    last cell on the row that was not, with the gaps in between."""
    hit = "trunc(2::float * least(a.wt, b.wt))::bigint" if weighted else "2"
    score = {"lemma": f"case when a.lemma = b.lemma then {hit} else -1 end", "root": "case when a.root = b.root then 2 else -1 end", "combined": f"case when a.lemma = b.lemma then {hit} when a.root = b.root then 1 else -1 end"}[mode]
    one = [1 << (9 * x) for x in range(6)]  # gaps, root-only matches, lemma matches, pairs, start of b, start of a
    return f"""m as (select k, 0::bigint as i, j, 0::bigint as h, 0::bigint as st from (select distinct k, 0::bigint as j from cb union all select k, j + 1 from cb)
 union all select k, i, j, h, case when h = 0 then 0 when h = t then tst else o.st + (j - o.j) end as st from (
  select k, i, j, t, tst, h, last_value(case when h = t then {{'j': j, 'st': tst}} end ignore nulls) over (partition by k order by j rows between unbounded preceding and current row) as o from (
   select k, i, j, t, case when t = 0 then 0 when t = dg + s then (case when dst = 0 then (i - 1) * {one[5]} + (j - 1) * {one[4]} else dst end) + {one[3]} + cls else ust + 1 end as tst, max(t + j) over (partition by k order by j rows between unbounded preceding and current row) - j as h0, {f'case when abs(i - j) > {band} then 0 else h0 end' if band is not None else 'h0'} as h from (
    select *, case when j = 0{f' or abs(i - j) > {band}' if band is not None else ''} then 0 else greatest(0, dg + s, up - 1) end as t from (
     select r.k, r.i + 1 as i, r.j, r.h as up, r.st as ust, lag(r.h) over (partition by r.k order by r.j) as dg, lag(r.st) over (partition by r.k order by r.j) as dst,
      {score} as s, case when a.lemma = b.lemma then {one[2]} when a.root = b.root then {one[1]} else 0 end as cls
     from m r join ca a on a.k = r.k and a.i = r.i left join cb b on b.k = r.k and b.j = r.j - 1))))),
 best as (select k, max(h) as score, arg_max({{'i': i, 'j': j, 'st': st}}, {{'h': h, 'i': -i, 'j': -j}}) as z from m group by k),
 al as (select c.*, z.st // {one[5]} as a_start, z.i as a_end, (z.st // {one[4]}) % 512 as b_start, z.j as b_end, (z.st // {one[3]}) % 512 as pairs, (z.st // {one[2]}) % 512 as lemma_matches, (z.st // {one[1]}) % 512 as root_only_matches, z.st % 512 as gaps, score from best join cand c using (k) where score >= 10)"""


def _items(mode: str, weighted: bool, band: int | None = None) -> str:
    return f"with recursive {_TEXTS}, {_aligned(mode, weighted, band)} select item_id, widx_a, doc_id, widx_b, a_start, a_end, b_start, b_end, pairs, lemma_matches, pairs - lemma_matches - root_only_matches as substitutions, root_only_matches, gaps, score from al where pairs >= 10"


_VALID = "case when core_similarity >= 0.9::float then 'valid' else 'noise' end"
_MATCHED = lambda s: f"(select coalesce(string_agg(t.surface, ' ' order by t.pos), '') from stream t where t.book_id = w.{s}_book_id and t.pos >= w.{s}_global_start and t.pos < w.{s}_global_end)"


def _report() -> str:
    """An edge in three lines. Decimals are rounded half up, an absent value is 'null'."""
    n = lambda x: f"coalesce(({x})::varchar, 'null')"
    tenths = lambda c: f"coalesce((floor({c}::double * 100 * 10 + 0.5)::bigint // 10) || '.' || (floor({c}::double * 100 * 10 + 0.5)::bigint % 10), 'null') || '%'"
    cents = lambda c: f"coalesce((floor({c}::double * 100 + 0.5)::bigint // 100) || '.' || lpad((floor({c}::double * 100 + 0.5)::bigint % 100)::varchar, 2, '0'), 'null')"
    at = lambda s, e: f"{n(f'{s}_{e}_page.part_index')} || ':' || {n(f'{s}_{e}_page.page_id')} || '.' || {n(f'{s}_{e}_offset')}"
    book = lambda s: f"'Book ' || {n(f'{s}_book_id')} || ' [' || {at(s, 'start')} || '→' || {at(s, 'end')} || ']'"
    return f"""with {_EDGES} select id, 'Edge ' || id || ': len=' || {n('aligned_length')} || ' matches=' || {n('lemma_matches')} || ' subs=' || {n('substitutions')} || ' gaps=' || {n('gaps')} || chr(10) || '  Core: ' || {tenths('core_similarity')} || '  Coverage: ' || {tenths('span_coverage')} || '  Weight: ' || {cents('content_weight')} || '  Diversity: ' || {cents('lexical_diversity')}
 || ' (' || case when lexical_diversity < 0.55::float then 'formulaic' else 'substantive' end || ')' || chr(10) || '  ' || {book('source')} || ' ↔ ' || {book('target')} as lines from e where lexical_diversity is not null"""


def oracle_sql() -> dict[str, str]:
    band = lambda c, h, m, absent: f"case when coalesce({c}, {absent}) >= {h}::float then 'high' when coalesce({c}, {absent}) >= {m}::float then 'medium' else 'low' end as {c}_band"
    ppm = lambda x, n: f"floor(({x})::float::double * 1000000)::bigint as {n}_ppm"
    exact = lambda side, end: f"(select part_index || ':' || page_id || '.' || page_off from stream t where t.book_id = w.{side}_book_id and t.pos = w.{side}_global_{end}{' - 1' if end == 'end' else ''})"
    four = lambda x: f"(floor(({x})::double * 10000 + 0.5)::bigint // 10000) || '.' || lpad((floor(({x})::double * 10000 + 0.5)::bigint % 10000)::varchar, 4, '0')"
    text = lambda lo, hi: f"(select coalesce(string_agg(t.surface, ' ' order by t.pos), '') from stream t where t.book_id = x.book_id and t.pos >= {lo} and t.pos < {hi})"
    return {
        "corpus_stats": f"with {_PAGES}, {_SIZES} select (select count(distinct book_id) from sizes) as book_count, (select count(*) from sizes) as page_count, (select coalesce(sum(n), 0)::bigint from sizes) as token_count, (select count(distinct id) from lemmas) as lemma_count, (select count(distinct root_id) from token_definitions where root_id <> 0) as root_count, (select count(distinct id) from token_definitions) as definition_count",
        "book_info": f"with {_BASE} select book_id, page_count, token_count, coalesce(u, 0) as unique_lemmas, floor(token_count / page_count * 1000)::bigint as tokens_per_page from (select book_id, count(*) as page_count, sum(n)::bigint as token_count from sizes group by 1) left join (select book_id, count(distinct lemma_id) as u from stream group by 1) using (book_id)",
        "book_pages_labels": f"with {_PAGES}, {_SIZES} select book_id, part_index, page_id, n as token_count, case when page_id % 3 <> 0 then page_id::varchar when page_id % 2 = 0 then 'part ' || part_index else '-' end as label from sizes",
        "blob_roundtrip": f"with {_PAGES}, {_TOKS}, g as (select book_id, part_index, page_id, count(*) as n, string_agg(token_id::varchar, ',' order by page_off) as ids from toks group by all) select p.book_id, p.part_index, p.page_id, coalesce(n, 0) as n, coalesce(ids, '') as ids, case when octet_length(t) % 4 = 0 then hex(t) else '' end as packed from pages p left join g using (book_id, part_index, page_id)",
        "token_stream": f"with {_BASE} select book_id, pos, part_index, page_id, page_off, token_id, surface, lemma_id, root_id from stream",
        "lemma_stream": f"with {_BASE} select book_id, row_number() over (partition by book_id order by part_index, page_id, page_off) - 1 as pos, lemma_id from stream where token_id <= (select max(token_id) from defs)",
        "page_offsets": f"with {_PAGES}, {_SIZES} select book_id, part_index, page_id, n, (sum(n) over w - n)::bigint as page_start, (sum(n) over w)::bigint as page_end from sizes window w as (partition by book_id order by part_index, page_id)",
        "position_to_page": f"with {_BASE} select book_id, pos, part_index, page_id, page_off from stream join (select book_id, global_start as pos from windows union select book_id, global_end - 1 from windows) using (book_id, pos)",
        "token_windows": f"with {_BASE}, {_WINDOWS} select book_id, window_idx, global_start, global_end, start_at, end_at, array_to_string(l, ',') as lemmas, array_to_string(r, ',') as roots from win",
        "window_count": f"with {_PAGES}, {_SIZES}, {_LENGTHS} select book_id, length, ({_COUNT})::bigint as n_windows from lengths",
        "shingles": f"with {_BASE}, {_WINDOWS}, {_SHINGLES} select * from sh",
        "candidate_pairs": f"with {_BASE}, {_WINDOWS}, {_SHINGLES}, {_CAND} select * from cand",
        "candidate_pairs_brute": f"with {_STORED} select a.book_id as book_a, b.book_id as book_b, count(*) as n_pairs from st a join st b on a.book_id < b.book_id group by all",
        "filter_rate": f"with {_BASE}, {_WINDOWS}, {_SHINGLES}, {_CAND}, n as (select book_id, count(*) as n from win group by 1) select book_a, book_b, a.n * b.n as total_pairs, c.candidates, ((a.n * b.n - c.candidates) * 1000000) // (a.n * b.n) as rate_ppm from (select book_a, book_b, count(*) as candidates from cand group by all) c join n a on a.book_id = book_a join n b on b.book_id = book_b",
        "idf_weights": f"with {_BASE} select book_id, lemma_id, floor(least(greatest(ln(t.total / count(*)), 0.5), 3.0)::float::double * 1000)::bigint as weight_milli from stream join (select book_id, count(*) as total from stream group by 1) t using (book_id) group by book_id, lemma_id, t.total",
        "quick_similarity": f"with {_STORED} select a.book_id, a.window_idx from st a join st b on a.book_id = b.book_id and b.window_idx = a.window_idx + 1 where len(list_distinct(list_intersect(a.lemma_ids, b.lemma_ids))) >= 10",
        "item_alignments_lemma": _items("lemma", False),
        "item_alignments_root": _items("root", False),
        "item_alignments_combined": _items("combined", False),
        "item_alignments_weighted": _items("combined", True),
        "item_alignments_banded": _items("combined", False, 40),
        "item_edges": f"with recursive {_TEXTS}, {_aligned('combined', True)}, x as (select *, pairs + gaps as aligned_length, pairs - lemma_matches - root_only_matches as substitutions from al where pairs >= 10) select row_number() over (partition by item_id, doc_id order by widx_a, widx_b) - 1 as id, item_id, doc_id, widx_a * 60 + a_start as source_global_start, widx_a * 60 + a_end as source_global_end, widx_b * 60 + b_start as target_global_start, widx_b * 60 + b_end as target_global_end, aligned_length, lemma_matches, substitutions, root_only_matches, gaps, {ppm('case when lemma_matches + substitutions > 0 then lemma_matches::float / (lemma_matches + substitutions)::float else 0 end', 'core_similarity')}, {ppm('case when aligned_length > 0 then (lemma_matches + substitutions)::float / aligned_length::float else 0 end', 'span_coverage')}, {ppm('case when aligned_length > 0 then lemma_matches::float / aligned_length::float else 0 end', 'lemma_similarity')}, {ppm('case when aligned_length > 0 then (lemma_matches + 0.5 * root_only_matches)::float / aligned_length::float else 0 end', 'combined_similarity')} from x",
        "edge_metrics": f"""with {_EDGES}, w as (select *, (coalesce(content_weight, 0)::double * lemma_matches)::float as ws, floor(coalesce(lexical_diversity, 0)::double * lemma_matches) as u from e where lemma_matches is not null and substitutions is not null and root_only_matches is not null and gaps is not null and aligned_length is not null)
 select id, aligned_length, {ppm('case when lemma_matches + substitutions > 0 then lemma_matches::float / (lemma_matches + substitutions)::float else 0 end', 'core_similarity')}, {ppm('case when aligned_length > 0 then (lemma_matches + substitutions)::float / aligned_length::float else 0 end', 'span_coverage')}, {ppm('case when aligned_length > 0 then lemma_matches::float / aligned_length::float else 0 end', 'lemma_similarity')}, {ppm('case when aligned_length > 0 then (lemma_matches + 0.5 * root_only_matches)::float / aligned_length::float else 0 end', 'combined_similarity')},
 {ppm('case when lemma_matches > 0 then ws / lemma_matches::float else 0 end', 'content_weight')}, {ppm('case when lemma_matches > 0 then u::float / lemma_matches::float else 0 end', 'lexical_diversity')}, {ppm('case when aligned_length > 0 then ws / aligned_length::float else 0 end', 'weighted_similarity')}, {ppm('case when lemma_matches > 0 then ws / lemma_matches::float else 0 end', 'avg_match_weight')} from w""",
        "merged_edges": _fold(0),
        "adjacent_merge": _fold(10),
        "subsumed_removal": f"with {_EDGES} select id from e where not exists (select 1 from e b where b.source_book_id = e.source_book_id and b.target_book_id = e.target_book_id and b.source_global_end > b.source_global_start and b.source_global_start <= e.source_global_start and b.source_global_end >= e.source_global_end and b.target_global_start <= e.target_global_start and b.target_global_end >= e.target_global_end and (b.source_global_end - b.source_global_start + b.target_global_end - b.target_global_start > e.source_global_end - e.source_global_start + e.target_global_end - e.target_global_start or b.id < e.id))",
        "filtered_edges": f"with {_EDGES} select id from e where core_similarity >= 0.85::float and span_coverage >= 0.3::float and content_weight >= 1.1::float and lexical_diversity >= 0.55::float",
        "coverage": f"with {_PAGES}, {_SIZES}, {_LENGTHS}, {_EDGES}, {_WHOLE}, {_COVER} select book_a, book_b, covered_a, covered_b, {ppm('case when coalesce(a.length, 0) > 0 then covered_a::float / a.length::float else 0 end', 'coverage_a')}, {ppm('case when coalesce(b.length, 0) > 0 then covered_b::float / b.length::float else 0 end', 'coverage_b')} from cov left join lengths a on a.book_id = book_a left join lengths b on b.book_id = book_b",
        "comparison_summary": f"with {_PAGES}, {_SIZES}, {_LENGTHS}, {_EDGES}, {_WHOLE}, {_COVER} select book_a, book_b, edge_count, total_aligned_tokens, {ppm('s1', 'avg_similarity')}, {ppm('s2', 'avg_weighted_similarity')}, covered_a, covered_b, {ppm('case when coalesce(a.length, 0) > 0 then covered_a::float / a.length::float else 0 end', 'coverage_a')}, {ppm('case when coalesce(b.length, 0) > 0 then covered_b::float / b.length::float else 0 end', 'coverage_b')} from (select source_book_id as book_a, target_book_id as book_b, count(*) as edge_count, sum(aligned_length)::bigint as total_aligned_tokens, coalesce(avg(lemma_similarity::double), 0)::float as s1, coalesce(avg(weighted_similarity::double), 0)::float as s2 from w group by all) join cov using (book_a, book_b) left join lengths a on a.book_id = book_a left join lengths b on b.book_id = book_b",
        "exact_places": f"with {_BASE}, {_EDGES}, {_WHOLE} select id, " + ", ".join(f"coalesce({exact(s, x)}, '') as {s}_{x}" for s in ("source", "target") for x in ("start", "end")) + " from w",
        "passages_with_context": f"with {_BASE}, {_EDGES}, {_WHOLE}, x as (select source_book_id as book_id, source_global_start as s, source_global_end as e from w where source_global_start < source_global_end union select target_book_id, target_global_start, target_global_end from w where target_global_start < target_global_end) select book_id, s as span_start, e as span_end, {text('greatest(s - 30, 0)', 's')} as text_before, {text('s', 'e')} as text_matched, {text('e', 'e + 30')} as text_after from x",
        "edge_locations": f"with {_EDGES} select id, {_loc('source')} as source_location, {_loc('target')} as target_location from e",
        "edge_labels_bands": f"with {_EDGES} select id, case when coalesce(lexical_diversity, 0) < 0.55::float then 'formulaic' else 'substantive' end as diversity_label, {band('core_similarity', .9, .7, 'lemma_similarity')}, {band('span_coverage', .7, .3, 1)}, {band('content_weight', 1.5, 1.0, 1)}, {band('lexical_diversity', .7, .55, 0)}, {band('lemma_similarity', .9, .7, 'null')} from e",
        "viewer_search_sort": "select doc_id, case when length(text) <= 100 then text else text[1:97] || '...' end as short_text, case when length(text) <= 60 then text else text[1:60] || '...' end as preview_text from documents where contains(text, 'chain')",
        "viewer_filter": f"with {_EDGES} select id, aligned_length from e where coalesce(lemma_similarity >= 0.5::float, true) and coalesce(aligned_length >= 20, true) and coalesce(coalesce(core_similarity, lemma_similarity) >= 0.7::float, true) and coalesce(span_coverage, 1) >= 0.3::float and coalesce(content_weight, avg_match_weight, 1) >= 1",
        "top_edges": f"with {_EDGES} select id, aligned_length from e where aligned_length is not null order by aligned_length desc, id limit 25",
        "validation_counts": f"with {_EDGES} select count(*) filter (core_similarity >= 0.9::float) as valid, count(*) filter (core_similarity < 0.7::float) as noise from e",
        "validated_export": f"with {_BASE}, {_EDGES}, {_WHOLE} select id, {_VALID} as validation, {_loc('source')} as source_location, {_loc('target')} as target_location, {_MATCHED('source')} as source_text, {_MATCHED('target')} as target_text, aligned_length as length, lemma_matches, coalesce(substitutions, 0) as substitutions, gaps, {four('coalesce(core_similarity, lemma_similarity)')} as core_similarity, {four('coalesce(span_coverage, 1)')} as span_coverage, {four('coalesce(content_weight, 1)')} as content_weight, coalesce({four('lemma_similarity')}, 'null') as similarity from w where core_similarity >= 0.9::float or core_similarity < 0.7::float",
        "short_export": f"with {_BASE}, {_EDGES}, {_WHOLE} select id, {_VALID} as validation, {_MATCHED('source')} as source_text, {_MATCHED('target')} as target_text, {_millionths('lemma_similarity').replace('lemma_similarity_ppm', 'similarity_ppm')} from w where core_similarity >= 0.9::float or core_similarity < 0.7::float",
        "edge_search_sort": f"""with {_BASE}, {_EDGES}, {_WHOLE}, x as (select id, aligned_length, coalesce(core_similarity, lemma_similarity) as c, {_MATCHED('source')} as a, {_MATCHED('target')} as b from w)
 select id, row_number() over (order by c desc nulls last, id) as place, case when length(a) <= 60 then a else substring(a, 1, 60) || '...' end as source_preview, case when length(b) <= 50 then b else substring(b, 1, 50) || '...' end as target_preview from x where (contains(a, 'ال') or contains(b, 'ال')) and coalesce(aligned_length >= 20, true)""",
        "edge_report": _report(),
        "flat_export": f"with {_EDGES} select {_flat()} from e",
    }
