"""DuckDB building blocks of the oracles: common table expressions written independently of the Spark plans."""

from __future__ import annotations

CELLS = """
ln as (select doc_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) - 1 li from documents),
cells as (select doc_id, cast(li // 40 + 1 as int) page_no, cast(li % 40 as int) idx, line as text, 72.0::double l,
  (72 + 16 * (li % 40))::double t, (72 + least(468, 5 * length(line)))::double r, (84 + 16 * (li % 40))::double b,
  (li % 5 = 4) from_ocr, case when li % 5 = 4 then (60 + ((doc_id + li) % 40)) / 100.0::double else 1.0::double end conf from ln)"""

DETS = CELLS + """,
dbase as (select doc_id, page_no, idx // 3 k, min(l) l, min(t) t, max(r) r, max(b) b from cells group by all),
dv as (select * from dbase cross join (values (0), (1), (2), (3), (4)) x(v)
  where (v = 0 and (doc_id + k) % 6 <> 5) or (v = 1 and (doc_id + k) % 2 = 0) or (v = 2 and (doc_id + k) % 4 = 0)
    or (v = 3 and (doc_id + k) % 3 = 0) or (v = 4 and (doc_id + k) % 5 = 1)),
dets as (select doc_id, page_no, cast(row_number() over (partition by doc_id, page_no order by k, v) - 1 as int) id, k, v,
  case v when 2 then (['table', 'picture', 'form', 'key_value_region', 'document_index'])[1 + (doc_id + k // 4) % 5]
    when 1 then (['text', 'code', 'list_item', 'text', 'footnote'])[1 + (doc_id * 5 + k) % 5]
    else (['text', 'list_item', 'section_header', 'code', 'title', 'text', 'formula', 'caption', 'page_header', 'page_footer'])[1 + (doc_id * 7 + k * 3 + v) % 10] end as label,
  l - v l, t - v + (case when v = 4 then 22 else 0 end) - (case when v = 2 then ((doc_id + k) // 4) % 2 * 20 else 0 end) t, r + v r,
  b + v + (case when v = 4 then 18 when v = 2 then (doc_id % 3) * 24 else 0 end) b,
  (35 + (doc_id * 13 + k * 29 + v * 17) % 65) / 100.0::double as conf from dv)"""

CORRUPT = CELLS + """,
cc as (select * replace (case (doc_id * 7 + idx) % 12 when 0 then text || chr(65533) when 1 then 'GLYPH<0A1f> ' || text when 2 then text || ' /G12/G3'
  when 3 then '/ab /cd ' || text when 4 then 'a/ab.cd/ef.gh b/x.y/z.w c/i.j/k.l ' || text when 5 then 'a/ab.cd/ef.gh b/x.y/z.w ' || text
  when 6 then text || '-' when 7 then text || chr(2) when 8 then '“' || text || '” ’x‘ • ⁄' when 9 then '   ' else text end as text) from cells),
rated as (select *, case when contains(text, chr(65533)) or regexp_matches(text, 'GLYPH<[0-9A-Fa-f]+>') or regexp_matches(text, '(?:/G\\p{Nd}+){2,}')
    or regexp_matches(text, '^(?:/[\\p{L}\\p{N}_]+\\s*){2,}') then 0.0::double
  when len(regexp_extract_all(text, '\\b[A-Za-z](?:/[a-z]{1,3}\\.[a-z]{1,3}){2,}\\b')) >= 3
    then greatest(1.0::double - 0.1::double * len(regexp_extract_all(text, '\\b[A-Za-z](?:/[a-z]{1,3}\\.[a-z]{1,3}){2,}\\b')), 0.0)
  else 1.0::double end as score from cc)"""

PAGES = """
page_dim as (select distinct doc_id, page_no, ([612.0, 595.0, 842.0])[1 + (doc_id + page_no) % 3]::double width, ([792.0, 842.0, 1191.0])[1 + (doc_id + page_no) % 3]::double height,
  (doc_id * 3 + page_no) % 11 <> 0 backend_ok from cells)"""

BITMAPS = """
rects as (select doc_id, page_no, rect_id,
  (case when doc_id % 13 = 0 then 0 else 40 + 180 * rect_id end)::double l, (case when doc_id % 13 = 0 then 0 else 60 + (doc_id % 7) * 90 end)::double t,
  (case when doc_id % 13 = 0 then 612 else least(612, 40 + 180 * rect_id + 60 + (doc_id % 5) * 70) end)::double r,
  (case when doc_id % 13 = 0 then 792 else least(792, 60 + (doc_id % 7) * 90 + 40 + (doc_id % 4) * 120) end)::double b
  from page_dim cross join (values (0), (1), (2)) x(rect_id)
  where case when doc_id % 13 = 0 then rect_id = 0 when doc_id % 13 = 1 then false else (doc_id + rect_id) % 3 <> 0 end)"""

#: pixels of bitmaps after the dilation; what they cover, in the grid that their edges cut the page into
PIXELS = """
px as (select doc_id, page_no, rect_id, greatest(0, x0 - 10) x0, greatest(0, y0 - 10) y0, least(w - 1, x1 + 9) x1, least(h - 1, y1 + 9) y1 from (
  select doc_id, page_no, rect_id, round_even(width, 0) w, round_even(height, 0) h, greatest(0, round_even(l, 0)) x0, greatest(0, round_even(t, 0)) y0,
    least(round_even(width, 0) - 1, round_even(r, 0)) x1, least(round_even(height, 0) - 1, round_even(b, 0)) y1
  from rects join page_dim using (doc_id, page_no) where (r - l) * (b - t) > 0) where x0 <= x1 and y0 <= y1),
gx as (select doc_id, page_no, x, lead(x) over (partition by doc_id, page_no order by x) x2 from (select doc_id, page_no, x0 x from px union select doc_id, page_no, x1 + 1 from px)),
gy as (select doc_id, page_no, y, lead(y) over (partition by doc_id, page_no order by y) y2 from (select doc_id, page_no, y0 y from px union select doc_id, page_no, y1 + 1 from px)),
cov as (select p.doc_id, p.page_no, coalesce(c.n, 0) / (p.width * p.height) coverage from page_dim p left join (
  select gx.doc_id, gx.page_no, sum((x2 - x) * (y2 - y)) n from gx join gy on gx.doc_id = gy.doc_id and gx.page_no = gy.page_no
  where exists (select 1 from px where px.doc_id = gx.doc_id and px.page_no = gx.page_no and px.x0 <= x and x2 <= px.x1 + 1 and px.y0 <= y and y2 <= px.y1 + 1) group by all) c
  using (doc_id, page_no)),
ped as (select a.doc_id, a.page_no, a.rect_id x, b.rect_id y from px a join px b on a.doc_id = b.doc_id and a.page_no = b.page_no and a.rect_id <> b.rect_id
  where (a.x0 <= b.x1 + 1 and b.x0 <= a.x1 + 1 and a.y0 <= b.y1 and b.y0 <= a.y1) or (a.x0 <= b.x1 and b.x0 <= a.x1 and a.y0 <= b.y1 + 1 and b.y0 <= a.y1 + 1)),
pgr as (select doc_id, page_no, rect_id node, rect_id root from px union select g.doc_id, g.page_no, e.y, g.root from pgr g join ped e on g.doc_id = e.doc_id and g.page_no = e.page_no and g.node = e.x),
reg as (select doc_id, page_no, region, min(x0) l, min(y0) t, max(x1) r, max(y1) b from px join (select doc_id, page_no, node rect_id, min(root) region from pgr group by all) using (doc_id, page_no, rect_id) group by all)"""

OCR_CELLS = """
ocr as (select doc_id, page_no, idx, text, l + (case when idx % 4 = 3 then 500 else 0 end) l, t + (case when idx % 4 = 1 then 7 else 0 end) t,
  r + (case when idx % 4 = 3 then 500 else 0 end) r, b + (case when idx % 4 = 1 then 7 else 0 end) b, true from_ocr,
  (50 + (doc_id + idx) % 50) / 100.0::double conf from cells where idx % 4 in (1, 3))"""

SPECIALS = "('form', 'key_value_region', 'table', 'document_index', 'picture')"
GATED = DETS + f""",
gated as (select * replace (case when label = 'title' then 'section_header' else label end as label), label raw_label from dets
  where conf >= case when label in ('section_header', 'title', 'code', 'checkbox_selected', 'checkbox_unselected', 'form', 'key_value_region', 'document_index') then 0.45 else 0.5 end),
regular as (select * from gated where label not in {SPECIALS}),
special as (select * from gated where label in {SPECIALS})"""


def inter(a: str, b: str) -> str:
    return f"greatest(0.0, least({a}.r, {b}.r) - greatest({a}.l, {b}.l)) * greatest(0.0, least({a}.b, {b}.b) - greatest({a}.t, {b}.t))"


def area(a: str) -> str:
    return f"(({a}.r - {a}.l) * ({a}.b - {a}.t))"


def strong(a: str, b: str) -> str:
    i = inter(a, b)
    return f"({area(a)} > 0 and {area(b)} > 0 and (({i}) / ({area(a)} + {area(b)} - ({i})) > 0.8 or ({i}) / {area(a)} > 0.8 or ({i}) / {area(b)} > 0.8))"


USABLE = r"(regexp_replace(c.text, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') <> '')"
ASSIGNED = GATED + f""",
assigned as (select doc_id, page_no, idx, id from (
  select c.doc_id, c.page_no, c.idx, k.id, row_number() over (partition by c.doc_id, c.page_no, c.idx order by ({inter('c', 'k')}) / {area('c')} desc, k.id) rn
  from cells c join regular k on c.doc_id = k.doc_id and c.page_no = k.page_no
  where {USABLE} and {area('c')} > 0 and ({inter('c', 'k')}) / {area('c')} > 0.2) where rn = 1),
orphan as (select c.doc_id, c.page_no, cast(coalesce(d.top, 0) + row_number() over (partition by c.doc_id, c.page_no order by c.idx) as int) id, 'text' label, c.l, c.t, c.r, c.b, c.conf, c.idx
  from cells c left join (select doc_id, page_no, max(id) top from dets group by all) d on c.doc_id = d.doc_id and c.page_no = d.page_no
  where {USABLE} and {area('c')} > 0 and not exists (select 1 from assigned a where a.doc_id = c.doc_id and a.page_no = c.page_no and a.idx = c.idx)),
k0 as (select doc_id, page_no, id, label, l, t, r, b, conf, id ord, false orphan, 'regular' cls from regular r
    where label = 'formula' or exists (select 1 from assigned a where a.doc_id = r.doc_id and a.page_no = r.page_no and a.id = r.id)
  union all select doc_id, page_no, id, label, l, t, r, b, conf, id, true, 'regular' from orphan),
b0 as (select doc_id, page_no, id, idx from assigned union all select doc_id, page_no, id, idx from orphan)"""


def one_pass(n: int, prev_k: str, prev_b: str, tighten: bool = True) -> str:
    """CTEs of one refinement pass from clusters ``prev_k`` and cell links ``prev_b`` to ``k{n}`` and ``b{n}``."""
    tight = f"""
t{n} as (select k.doc_id, k.page_no, k.id, k.label, coalesce(x.l, k.l) l, coalesce(x.t, k.t) t, coalesce(x.r, k.r) r, coalesce(x.b, k.b) b, k.conf, k.ord, k.orphan, k.cls
  from {prev_k} k left join (select w.doc_id, w.page_no, w.id, min(c.l) l, min(c.t) t, max(c.r) r, max(c.b) b from {prev_b} w
    join cells c using (doc_id, page_no, idx) group by all) x using (doc_id, page_no, id))""" if tighten else f"\nt{n} as (select * from {prev_k})"
    return tight + f""",
e{n} as (select x.doc_id, x.page_no, x.id a, y.id b from t{n} x join t{n} y on x.doc_id = y.doc_id and x.page_no = y.page_no and x.cls = y.cls and x.id <> y.id
  where not (x.orphan and y.orphan) and {strong('x', 'y')}),
g{n} as (select doc_id, page_no, id node, id root from t{n}
  union select g.doc_id, g.page_no, e.b, g.root from g{n} g join e{n} e on g.doc_id = e.doc_id and g.page_no = e.page_no and g.node = e.a),
m{n} as (select doc_id, page_no, node id, min(root) comp from g{n} group by all),
c{n} as (select t.*, m.comp, {area('t')} ar, case cls when 'picture' then 2.0 when 'wrapper' then 2.0 else 1.3 end rl, case cls when 'picture' then 0.3::double when 'wrapper' then 0.2::double else 0.05::double end cl
  from t{n} t join m{n} m using (doc_id, page_no, id)),
p{n} as (select x.doc_id, x.page_no, x.id, bool_and(
    coalesce(x.label = 'list_item' and y.label = 'text' and abs(1 - x.ar / y.ar) < 0.2, false)
    or coalesce(x.label = 'code' and ({inter('x', 'y')}) / y.ar > 0.8, false)
    or not coalesce(x.ar / y.ar <= x.rl and y.conf - x.conf > x.cl, false)) ok
  from c{n} x join c{n} y on x.doc_id = y.doc_id and x.page_no = y.page_no and x.comp = y.comp and x.id <> y.id group by all),
w{n} as (select doc_id, page_no, comp, min(ord) ord, any_value(cl) cl, count(*) size,
    coalesce(list_reduce(list({{'id': c.id, 'ar': c.ar, 'conf': c.conf, 'cl': c.cl}} order by c.ord, c.id) filter (coalesce(p.ok, true)),
      lambda m, q: case when q.ar > m.ar and m.conf - q.conf <= q.cl then q else m end).id,
      arg_min(c.id, c.ord)) win
  from c{n} c left join p{n} p using (doc_id, page_no, id) group by doc_id, page_no, comp),
k{n} as (select c.doc_id, c.page_no, c.id, c.label, c.l, c.t, c.r, c.b, c.conf, w.ord, c.orphan, c.cls from w{n} w join c{n} c on c.doc_id = w.doc_id and c.page_no = w.page_no and c.id = w.win),
b{n} as (select distinct l.doc_id, l.page_no, w.win id, l.idx from {prev_b} l join m{n} m using (doc_id, page_no, id) join w{n} w on w.doc_id = m.doc_id and w.page_no = m.page_no and w.comp = m.comp)"""


REFINED = ASSIGNED + "," + one_pass(1, "k0", "b0") + "," + one_pass(2, "k1", "b1") + "," + one_pass(3, "k2", "b2")

SPEC = f"""
spec as (select s.doc_id, s.page_no, s.id, s.label, s.l, s.t, s.r, s.b, s.conf from special s join page_dim p using (doc_id, page_no)
  where not (s.label = 'picture' and {area('s')} / (p.width * p.height) > 0.90))"""
FINAL = REFINED + "," + PAGES + "," + SPEC + f""",
kids as (select s.doc_id, s.page_no, s.id parent_id, r.id child_id, r.l, r.t, r.r, r.b from spec s join k3 r on s.doc_id = r.doc_id and s.page_no = r.page_no
  where {area('r')} > 0 and ({inter('r', 's')}) / {area('r')} > 0.8),
kbox as (select doc_id, page_no, parent_id id, min(l) l, min(t) t, max(r) r, max(b) b from kids group by all),
sk as (select s.doc_id, s.page_no, s.id, s.label, case when loose then coalesce(x.l, s.l) else s.l end l, case when loose then coalesce(x.t, s.t) else s.t end t,
    case when loose then coalesce(x.r, s.r) else s.r end r, case when loose then coalesce(x.b, s.b) else s.b end b, s.conf, s.id ord, false orphan,
    case when s.label = 'picture' then 'picture' else 'wrapper' end cls
  from (select *, label in ('form', 'key_value_region') loose from spec) s left join kbox x using (doc_id, page_no, id)),
sb as (select distinct q.doc_id, q.page_no, q.parent_id id, w.idx from kids q join b3 w on q.doc_id = w.doc_id and q.page_no = w.page_no and q.child_id = w.id),""" + one_pass(4, "sk", "sb", tighten=False) + """,
fin as (select * from k3 k where not exists (select 1 from kids q join k4 s on q.doc_id = s.doc_id and q.page_no = s.page_no and q.parent_id = s.id
    where q.doc_id = k.doc_id and q.page_no = k.page_no and q.child_id = k.id)
  union all select * from k4),
fb as (select * from b3 union all select * from b4),
fpos as (select f.*, coalesce(x.n, 0) n_cells, coalesce(x.first, 'infinity'::double) first from fin f left join (select doc_id, page_no, id, count(*) n, min(idx)::double first from fb group by all) x using (doc_id, page_no, id)),
fo as (select *, row_number() over (partition by doc_id, page_no order by first, t, l, id) - 1 pos from fpos)"""

KIND = """case when label in ('text', 'footnote', 'caption', 'checkbox_unselected', 'checkbox_selected', 'section_header', 'page_header', 'page_footer', 'code', 'list_item', 'formula') then 'text'
  when label in ('table', 'document_index') then 'table' when label = 'picture' then 'figure' when label in ('form', 'key_value_region') then 'container' end"""

#: elements with their text; lines are joined as dehyphenate_join does
ELEMENTS = FINAL + f""",
el as (select f.*, {KIND} kind from fo f),
cl as (select w.doc_id, w.page_no, w.id, w.idx, regexp_replace(replace(c.text, chr(2), '-'), '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') line
  from fb w join cells c using (doc_id, page_no, idx)),
cj as (select *, lead(line) over z nxt, row_number() over z rn, count(*) over (partition by doc_id, page_no, id) n from cl where line <> '' window z as (partition by doc_id, page_no, id order by idx)),
ct as (select doc_id, page_no, id, any_value(n) n, string_agg(case when nxt is null then line
    when ends_with(line, '-') then case when regexp_matches(regexp_extract(line, '([\\p{{L}}\\p{{N}}_]+)[^\\p{{L}}\\p{{N}}_]*$', 1), '^[\\p{{L}}\\p{{N}}]+$')
      and regexp_matches(regexp_extract(nxt, '^[^\\p{{L}}\\p{{N}}_]*([\\p{{L}}\\p{{N}}_]+)', 1), '^[\\p{{L}}\\p{{N}}]+$') then line[:-2] else line end
    else line || ' ' end, '' order by idx) raw from cj group by doc_id, page_no, id),
ex as (select e.*, coalesce(case when c.n <= 1 then c.raw else regexp_replace(translate(c.raw, '⁄’‘“”•', '/''''""·'), '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') end, '') text
  from el e left join ct c using (doc_id, page_no, id) where e.kind is not null)"""

#: reading order of the elements
READING = ELEMENTS + """,
ra as (select *, max(case when label not in ('page_header', 'page_footer') and r <= width / 2 then 1 else 0 end) over pg has_left,
    max(case when label not in ('page_header', 'page_footer') and l >= width / 2 then 1 else 0 end) over pg has_right,
    case label when 'page_header' then 0 when 'page_footer' then 2 else 1 end zone from ex join (select doc_id, page_no, width, height from page_dim) using (doc_id, page_no) window pg as (partition by doc_id, page_no)),
rb as (select *, case when zone = 1 and has_left = 1 and has_right = 1 and (l + r) / 2 > width / 2 then 1 else 0 end col from ra),
ro as (select *, row_number() over (partition by doc_id order by page_no, zone, col, t, l, id) - 1 seq from rb)"""

_REF = "'#/' || page_no::varchar || '/' || {}::varchar"
_MARK = r"^\s*([-*•·]|\d+[.)])\s+"

#: document items: captions and footnotes under their targets, continued texts as one, list items under their groups
ITEMS = READING + f""",
nb as (select *, lag(kind) over d pk, lag(label) over d pl, lag(page_no) over d pp, lag(id) over d pid, lead(kind) over d nk, lead(label) over d nl, lead(page_no) over d np, lead(id) over d nid from ro window d as (partition by doc_id order by seq)),
cap as (select doc_id, page_no, id, seq, case when (nk in ('table', 'figure') or nl = 'code') and np = page_no then nid when (pk in ('table', 'figure') or pl = 'code') and pp = page_no then pid end as target_id from nb where label = 'caption'),
fno as (select *, max(case when label <> 'footnote' then seq end) over (partition by doc_id, page_no order by seq rows between unbounded preceding and 1 preceding) a from ro),
nt as (select doc_id, page_no, id, seq, target_id, 'caption' note from cap where target_id is not null
  union all select f.doc_id, f.page_no, f.id, f.seq, x.id, 'footnote' from fno f join ro x on f.doc_id = x.doc_id and f.a = x.seq where f.label = 'footnote' and (x.kind in ('table', 'figure') or x.label = 'code')),
mg as (select *, coalesce(label = 'text' and lag(label) over d = 'text' and (lag(page_no) over d < page_no or lag(col) over d < col)
  and not regexp_matches(lag(text) over d, '[.!?:;]\\s*$') and lag(text) over d <> '' and regexp_matches(text, '^\\p{{Ll}}'), false) goes from ro window d as (partition by doc_id order by seq)),
mh as (select *, max(case when not goes then seq end) over (partition by doc_id order by seq rows between unbounded preceding and current row) head from mg),
ms as (select *, coalesce(sum(length(text) + 1) over (partition by doc_id, head order by seq rows between unbounded preceding and 1 preceding), 0)::bigint st from mh),
mt as (select doc_id, head seq, string_agg(text, ' ' order by seq) whole, count(*) n_parts,
  string_agg(page_no::varchar || ':' || case when kind = 'text' then st::varchar || '-' || (st + length(text))::varchar else '0-0' end || ':' || concat_ws('/', l::bigint, (height - t)::bigint, r::bigint, (height - b)::bigint), ',' order by seq) prov from ms group by doc_id, head),
mn as (select * from mh m where head = seq and not exists (select 1 from nt where nt.doc_id = m.doc_id and nt.page_no = m.page_no and nt.id = m.id)),
lr as (select *, sum(case when kind = 'text' and label not in ('list_item', 'code') then 1 else 0 end) over (partition by doc_id order by seq) run from mn),
par as (select doc_id, seq, '#/groups/' || (dense_rank() over (partition by doc_id order by run) - 1)::varchar parent_ref from lr where label = 'list_item'
  union all select doc_id, seq, {_REF.format('target_id')} from nt),
rf as (select doc_id, {_REF.format('target_id')} item_ref, string_agg({_REF.format('id')}, ',' order by seq) filter (note = 'caption') cr, string_agg({_REF.format('id')}, ',' order by seq) filter (note = 'footnote') fr from nt group by all),
al as (select * from mn union all select m.* from mh m join nt using (doc_id, page_no, id)),
it as (select a.doc_id, a.seq, a.page_no, {_REF.format('a.id').replace('page_no', 'a.page_no')} item_ref, parent_ref, case when label = 'section_header' then 'heading' when kind = 'text' then label else kind end as type,
  case when label in ('page_header', 'page_footer') then 'furniture' else 'body' end as content_layer,
  case when kind <> 'text' or label = 'formula' then '' when label = 'list_item' then regexp_replace(whole, '{_MARK}', '') else whole end as text,
  case when kind = 'text' then whole else '' end as orig, case when label = 'list_item' then nullif(regexp_extract(whole, '{_MARK}', 1), '') end as marker, n_parts, prov,
  case when kind = 'text' then length(whole) else 0 end charspan_end, l, height - t as top, r, height - b as bottom
  from al a join mt using (doc_id, seq) left join par using (doc_id, seq)),
itr as (select it.*, coalesce(cr, '') caption_refs, coalesce(fr, '') footnote_refs from it left join rf using (doc_id, item_ref))"""
