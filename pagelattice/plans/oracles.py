"""SQL of the layout engine's queries over the same tables."""

from __future__ import annotations

from pagelattice.functions import hints as H
from pagelattice.functions import text as X
from pagelattice.functions import expansion as E
from pagelattice.operators import candidates as C
from pagelattice.sources import adapters as A
from pagelattice.sources.adapters import KV_LABELS

# One row for each token of the customer forms, as the adapters define them.
KV = """kv as (select doc_id, t.token_id as token_id, t.token_id as ord, t.text as text, t.x0 / 1000.0 as x0, t.x1 / 1000.0 as x1,
    t.y0 / 1000.0 as y0, (t.y0 + 20) / 1000.0 as y1
  from (select c_custkey::bigint as doc_id, unnest([{tokens}]) as t
    from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey))""".format(
    tokens=", ".join(
        f"{{'token_id': {2 * i}, 'text': '{label}', 'x0': 50.0, 'x1': 200.0, 'y0': {100 + 50 * i}.0}}, {{'token_id': {2 * i + 1}, 'text': {value}, 'x0': 250.0, 'x1': 600.0, 'y0': {100 + 50 * i}.0}}"
        for i, (label, value) in enumerate(
            zip(KV_LABELS, ("c_name", "c_mktsegment", "n_name", "r_name", "'$ ' || c_acctbal::decimal(12,2)::varchar"), strict=True)
        )
    )
)
GRID = """g as materialized (select doc_id, line, line * 4 + k as token_id, line * 4 + k as ord, text, (50 + 200 * k)::double / 1000 as x0, (150 + 200 * k)::double / 1000 as x1,
    (100 + 40 * line)::double / 1000 as y0, (120 + 40 * line)::double / 1000 as y1 from (
  select l_orderkey::bigint as doc_id, place as line, unnest(range(0, 4)) as k,
    unnest([l_linenumber::varchar, l_quantity::decimal(12,2)::varchar, l_extendedprice::decimal(12,2)::varchar, l_returnflag]) as text
  from (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_quantity, l_extendedprice, l_returnflag) as place from lineitem)
  union all
  select distinct l_orderkey::bigint, 0, unnest(range(0, 4)), unnest(['Line', 'Quantity', 'Price', 'Flag']) from lineitem))"""
_FORM_TEXTS = {
    "title": "'Order ' || o_orderkey::varchar",
    "date": "strftime(o_orderdate, '%d/%m/%Y')",
    "total": "'$ ' || o_totalprice::decimal(12,2)::varchar",
    "holder": "c_name",
    "status": "o_orderstatus",
    "priority": "o_orderpriority",
    "nation": "n_name",
    "code": "'45-' || o_orderkey::varchar",
}
_CELLS = ", ".join(
    "{{'i': {i}, 'text': {t}, 'x0': {x0}, 'x1': {x1}, 'y': {y} + {s}, 'ok': {ok}, 'font': {f}}}".format(
        i=i, t=_FORM_TEXTS.get(n, f"'{n}'"), x0=x0, x1=x1, y=y, s="0" if n == "title" else f"o_orderkey % {A.SHIFT}",
        ok="true" if n not in A.FORM_GAPS else f"o_orderkey % {A.FORM_GAPS[n][0]} <> {A.FORM_GAPS[n][1]}", f="16.0" if n == "title" else "10.0",
    )
    for i, (n, x0, x1, y) in enumerate(A.FORM_ROWS)
)
FORM = f"""ft as materialized (select doc_id, t.i as token_id, t.i as ord, t.text as text, t.x0::double / 1000 as x0, t.x1::double / 1000 as x1,
    t.y::double / 1000 as y0, (t.y + 20)::double / 1000 as y1, t.font::double as font
  from (select o_orderkey::bigint as doc_id, unnest([{_CELLS}]) as t from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey) where t.ok)"""
_KEY = "(c_custkey * 7919 + 13)::varchar"
TYPED = f"""ty as (select o_orderkey::bigint as doc_id, unnest([0, 1, 2]) as token_id,
    unnest([strftime(o_orderdate, '%d/%m/%Y'), 'on ' || strftime(o_orderdate, '%Y-%m-%d'), strftime(o_orderdate, '%-d jan %Y')]) as text from orders
  union all select -c_custkey - 1, unnest([0, 1, 2, 3, 4, 5]), unnest(['(' || a[1:2] || ') ' || a[3:7] || '-' || a[8:11], a[1:3] || '.' || a[4:6] || '.' || a[7:9] || '-' || a[10:11], b,
    'Rua ' || c_name || ', ' || z[1:5] || '-' || z[6:8], 'R$ ' || c_acctbal::decimal(12,2)::varchar, 'Maria ' || upper(c_mktsegment[1:1]) || lower(c_mktsegment[2:]) || '.'])
  from (select *, lpad({_KEY}, 11, '4') as a, lpad({_KEY}, 14, '4') as b, lpad({_KEY}, 8, '4') as z from customer))"""
LINES = "tl as (select doc_id, i - 1 as token_id, string_split(coalesce(text, ''), chr(10))[i] as text from (select doc_id, text, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) as i from documents))"
OCC = """occ as (select event_type as label_type, 'f' || (user_id % 3)::varchar as field_name, event_id as seq, value as x,
    json_extract_string(props, '$.k')::double as y, case when user_id % 5 = 0 then 'LABEL' else 'VALUE' end as role,
    case when event_id % 4 = 0 then 'date' else 'text' end as data_type, (user_id % 4)::int as connections, value > 5.0 as found from events)"""
STRIP = r"regexp_replace(regexp_replace({}, '^\s+', ''), '\s+$', '')"


def ascii_norm(c: str) -> str:
    low = f"translate(lower({c}), '{X.ACCENTS}_', '{X.PLAIN} ')"
    return rf"trim(regexp_replace(regexp_replace({low}, '[^\x00-\x7F]+', '', 'g'), '[^a-z0-9]+', ' ', 'g'))"


def accent_norm(c: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower(translate({c}, '{X.ACCENTS}', '{X.PLAIN}')), '{X.MARKS}', '', 'g'), '\s+', ' ', 'g'))"


def keywords(c: str, stop: str = X.STOP) -> str:
    words = ", ".join(f"'{w}'" for w in stop.split())
    return f"list_sort(list_distinct(list_filter(string_split({ascii_norm(c)}, ' '), lambda w: length(w) >= 3 and w not in ({words}))))"


def edges_of(t: str, p: str = "") -> str:
    """Lines (l), east (ee), south (se) and all (e) edges of pages t whose lines are level, each name with a prefix."""
    return f"""{p}l as materialized (select *, dense_rank() over (partition by doc_id order by y0) - 1 as row_no from {t}),
{p}ee as materialized (select doc_id, token_id as from_id, nt as to_id from (select doc_id, token_id, x0, x1, y0, y1, lead(token_id) over w as nt, lead(x0) over w as nx0,
      lead(x1) over w as nx1, lead(y0) over w as ny0, lead(y1) over w as ny1 from {p}l window w as (partition by doc_id, row_no order by x0, ord))
    where abs((y0 + y1) / 2 - (ny0 + ny1) / 2) < 0.005 and nx0 - x1 < ((x1 - x0) + (nx1 - nx0)) / 2 * 6),
{p}rows as materialized (select doc_id, row_no, max(y1) as low, min(y0) as top from {p}l group by 1, 2),
{p}gaps as (select doc_id, row_no, gap from (select doc_id, row_no, lead(top) over (partition by doc_id order by row_no) - low as gap from {p}rows) where gap > 0),
{p}sp as materialized (select doc_id, 2.5 * case when g[len(g) // 2 + 1] > 0.03 then g[len(g) // 4 + 1] else g[len(g) // 2 + 1] end as spacing from (
    select doc_id, list_sort(list(gap)) as g from {p}gaps group by 1)),
{p}pair as (select a.doc_id, a.token_id as from_id, b.token_id as to_id, b.row_no as b_row, b.row_no - a.row_no as dist, b.ord as bo, b.y0 - a.y1 as fall, b.y0 >= a.y0 - 0.02 as under,
    greatest(0.0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) as ox, greatest(0.0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) as oy,
    abs((a.x0 + a.x1) / 2 - (b.x0 + b.x1) / 2) as off, least(a.x1 - a.x0, b.x1 - b.x0) as narrow, greatest(a.x1 - a.x0, b.x1 - b.x0) as wide
  from {p}l a join {p}l b on a.doc_id = b.doc_id and b.row_no > a.row_no and b.y0 - a.y1 <= 0.30),
{p}cand as (select *, case when oy > 0 then case when fall < 0 then -oy * 0.001 else fall end else greatest(0.0, fall) end as gap,
    min(case when oy > 0 then b_row end) over (partition by doc_id, from_id) as until
  from {p}pair where (oy > 0 and (ox > 0 or off < 0.6 * wide)) or (oy = 0 and under and dist = 1 and (ox >= 0.1 * narrow or off < 0.6 * wide))),
{p}se as materialized (select doc_id, from_id, to_id from (select c.*, row_number() over (partition by c.doc_id, from_id order by oy > 0 desc, oy desc, ox desc, off, gap, dist, b_row, bo) as r
    from {p}cand c left join {p}sp using (doc_id) where (until is null or b_row <= until) and (spacing is null or gap <= spacing) and gap <= 0.042) where r = 1),
{p}e as materialized (select doc_id, from_id, to_id, 'east' as relation from {p}ee union all select doc_id, from_id, to_id, 'south' from {p}se)"""


KVE = KV + ", " + edges_of("kv")
GE = GRID + ", " + edges_of("g")
FE = FORM + ", " + edges_of("ft")
AROUND = "near as materialized (select distinct doc_id, a, b from (select doc_id, from_id as a, to_id as b from e union all select doc_id, to_id, from_id from e))"
TEXT = STRIP.format("text")
SEP = rf"regexp_matches(regexp_replace(text, '\s+$', ''), '{X.SEPARATOR}')"
INSIDE = f"instr({TEXT}, ':') between 2 and length({TEXT}) - 1"
DATE = f"regexp_matches(text, '{X.DATE}')"
CODE = f"(not {DATE} and regexp_matches(text, '{X.CODE}'))"
NUMBER = rf"regexp_matches({TEXT}, '^\d+$')"
DIGITS = r"regexp_matches(text, '\d')"
WORDS = rf"len(regexp_split_to_array({TEXT}, '\s+'))"
SEEDED = FE + """, seed as materialized (select *, ['LABEL', 'VALUE', 'HEADER', null][(token_id * 7 + doc_id * 3) % 4 + 1] as role from ft)"""


def by_token(cases: str, tokens: str = "ft") -> str:
    """Roles of the tokens of forms by what their page has; o is the order's key."""
    return f"with {FORM} select doc_id, token_id, case {cases} end as role from (select *, doc_id as o from {tokens})"


KV_CELLS = "cells as (select doc_id, 0 as table_id, token_id, (token_id // 2)::int as row, (token_id % 2)::int as col, 'vertical' as orientation from kv)"
ROLES = "roles as (select doc_id, token_id, case when token_id % 2 = 0 then 'LABEL' else 'VALUE' end as role from kv)"
DEGREE = "deg as (select doc_id, id as token_id, count(*) as degree from (select doc_id, unnest([from_id, to_id]) as id from e) group by 1, 2)"
VALUES = "vals as (select a.doc_id, a.token_id, coalesce(b.text, a.text) as value from kv a left join kv b on a.doc_id = b.doc_id and a.token_id % 2 = 0 and b.token_id = a.token_id + 1)"
EXTRACT = KV + ", " + VALUES + """, f as (select unnest([0, 1, 2, 3, 4]) as ord, unnest(['holder', 'segment', 'nation', 'region', 'balance']) as field),
x as (select d.doc_id, f.ord, f.field, v.value, case when v.token_id is not null then kv.token_id end as token_id from (select distinct doc_id from kv) d cross join f
  left join kv on kv.doc_id = d.doc_id and rtrim(lower(kv.text), ':') = f.field and kv.token_id % 2 = 0
  left join vals v on v.doc_id = kv.doc_id and v.token_id = kv.token_id)"""


def _digits(c: str) -> str:
    return f"length(regexp_replace({c}, '[^0-9]', '', 'g'))"


def _named(c: str) -> str:
    """Whether a text looks like a name."""
    t = STRIP.format(c)
    acronyms = ", ".join(f"'{a}'" for a in H.ACRONYMS.split())
    return rf"""(length({t}) >= 3 and upper({t}) not in ({acronyms}) and {_digits(t)}::double / greatest(length({t}), 1) <= 0.3 and regexp_matches({t}, '{H.LETTER}')
      and case when regexp_matches({t}, '\s') then regexp_matches({t}, '\S{{3}}') else length({t}) >= 4 end)"""


def _address() -> str:
    return rf"""(len(list_filter(regexp_split_to_array(lower(text), '\s'), lambda w: regexp_matches(w, '^({H.STREETS.replace(" ", "|")})'))) > 0
      or regexp_matches(text, '{H.POSTAL}') or regexp_matches(lower(text), '{H.POSTAL_WORD}')
      or (regexp_matches({TEXT}, '\s') and regexp_matches(text, '\d') and regexp_matches(text, '{H.LETTER}')))"""


def _hint(name: str) -> str:
    q = lambda p: p.replace("'", "''")
    rx = lambda p: f"regexp_matches(text, '{q(p)}')"
    first = lambda p: f"regexp_extract(text, '{q(p)}')"
    strip = STRIP.format("text")
    ratio = f"{_digits('text')}::double / greatest(length(text), 1)"
    found, out = {
        "date": (rx(H.DATE), first(H.DATE)),
        "money": (rx(H.MONEY), first(H.MONEY)),
        "cpf_cnpj": (f"{_digits('text')} in (11, 14) and {rx(H.CPF_CNPJ)}", first(H.CPF_CNPJ)),
        "phone": (f"{_digits('text')} between 10 and 15 and {rx(H.PHONE)}", first(H.PHONE)),
        "address": (_address(), first(H.ADDRESS)),
        "name": (_named("text"), rf"coalesce(case when {_named('tail')} then tail end, '')"),
        "text": (f"regexp_matches(text, '[A-Za-zÀ-ÿ]') and {ratio} <= 0.8", strip),
    }[name]
    return f"with {KV}, {LINES}, {TYPED}, t as (select *, {STRIP.format(f"regexp_replace({TEXT}, '{H.NAME_TAIL}', '')")} as tail from (select doc_id, token_id, text from tl union all select doc_id, token_id, text from kv union all select * from ty)) select doc_id, token_id, md5({out}) as extracted from t where {found}"


def _types() -> dict[str, str]:
    return {
        "date": rf"regexp_matches(text, '{X.DATE}')",
        "money": r"regexp_matches(text, '\d')",
        "phone": rf"regexp_matches(text, '[\d\s()\-+]{{8,}}') and {_digits('text')} >= 8",
        "email": rf"regexp_matches({TEXT}, '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{{2,}}$')",
        "cpf_cnpj": r"regexp_matches(text, '\d{11}|\d{14}|\d{2}\.\d{3}\.\d{3}/\d{4}-\d{2}|\d{3}\.\d{3}\.\d{3}-\d{2}')",
        "number": rf"regexp_matches({TEXT}, '^\d+(?:[.,]\d+)?$')",
    }


_KV_NAMES = "f as (select unnest(['holder', 'segment', 'nation', 'region', 'balance']) as field)"
# Scores of blocks as labels; blocks have one line, which counts less than the whole text.
LABELLED = f"""with {KV}, {_KV_NAMES}, t as (select doc_id, token_id as block_id, regexp_replace({TEXT}, ':+$', '') as t from kv),
n as (select doc_id, block_id, field, {accent_norm("t")} as x, field as y, string_split({accent_norm("t")}, ' ') as w from t cross join f where t <> ''),
sc as (select doc_id, block_id, field, greatest(case when list_contains(list_distinct(w), y) then 1.0 / len(list_distinct(w)) else 0.0 end, 1 - levenshtein(x, y)::double / greatest(length(x), length(y), 1)) as score from n),
lab as materialized (select * from sc where score >= {C.LABEL_FLOOR}),
best as (select * from (select *, row_number() over (partition by doc_id, field order by score desc, block_id) as r from lab) where r <= 5),
sp as (select l.doc_id, l.field, l.block_id as l_id, l.score, b.token_id as block_id,
    case when least(b.y1, a.y1) - greatest(b.y0, a.y0) > 0 and b.x0 >= a.x1 then 'same_line' when least(b.x1, a.x1) - greatest(b.x0, a.x0) > 0 and b.y0 >= a.y1 then 'below' end as relation,
    b.x0 - a.x1 as dx, b.y0 - a.y1 as dy
  from best l join kv a on a.doc_id = l.doc_id and a.token_id = l.block_id join kv b on b.doc_id = l.doc_id and b.token_id <> l.block_id),
cs as materialized (select doc_id, field, block_id, relation, score, far from (
    select *, case relation when 'same_line' then dx else dy end as far, row_number() over (partition by doc_id, field, l_id, relation order by case relation when 'same_line' then dx else dy end, block_id) as r
    from sp where relation is not null) where r = 1)"""
PATTERNS = OCC + """,
r as (select label_type, field_name, count(*) as n, avg(found::int) as found_rate, count(*) filter (where found and x is not null and y is not null) as n_placed,
  avg(x) filter (where found and y is not null) as mean_x, avg(y) filter (where found and x is not null) as mean_y,
  stddev_pop(x) filter (where found and y is not null) as std_x, stddev_pop(y) filter (where found and x is not null) as std_y,
  avg(connections) filter (where found) as mean_c, stddev_pop(connections) filter (where found) as std_c from occ group by 1, 2),
ro as (select label_type, field_name, role, c, c::double / sum(c) over (partition by label_type, field_name) as share, row_number() over (partition by label_type, field_name order by c desc, s) as k
  from (select label_type, field_name, role, count(*) as c, min(seq) as s from occ where found group by 1, 2, 3)),
ty as (select label_type, field_name, data_type, c::double / sum(c) over (partition by label_type, field_name) as share, row_number() over (partition by label_type, field_name order by c desc, s) as k
  from (select label_type, field_name, data_type, count(*) as c, min(seq) as s from occ where found group by 1, 2, 3)),
pt as (select r.*, ro.role as top_role, ro.share as role_share, ty.data_type as top_type, ty.share as type_share,
  list_filter([case when n_placed > 0 then greatest(0.0, 1 - sqrt(std_x * std_x + std_y * std_y) / 1000) end, ro.share, ty.share, case when mean_c > 0 then greatest(0.0, 1 - std_c / mean_c) end], lambda p: p is not null) as parts
  from r left join ro on ro.label_type = r.label_type and ro.field_name = r.field_name and ro.k = 1 left join ty on ty.label_type = r.label_type and ty.field_name = r.field_name and ty.k = 1),
rg as (select *, case when n < 500 or n * found_rate < 1.5 then 0.5 else coalesce(parts[1], 0) * 0.4 + coalesce(parts[2], 0) * 0.3
  + coalesce(list_avg(parts[3:]), 0.0) * 0.3 end as rigidity from pt)"""


def _graphs() -> dict[str, str]:
    """Lines, edges, tables and paths."""
    deg = "deg as materialized (select doc_id, id as token_id, count(*) as degree from (select doc_id, unnest([from_id, to_id]) as id from e) group by 1, 2)"
    below = "[x[j + 1] for j in range({0}, 10, 2)]"
    tab = "case when o % 3 = 0 then [7, 8, 10, 11] else [7, 8, 9, 10, 11, 12] end"
    return {
        "d_lines": f"with {GE} select doc_id, token_id, row_no::int as line from l",
        "d_east_edges": f"with {KVE}, {GRID}, {edges_of('g', 'g')} select * from ee union all select -doc_id, from_id, to_id from gee",
        "d_spacing": f"with {GE} select doc_id, round(spacing, 9) as spacing from sp",
        "d_south_edges": f"with {GE} select * from se",
        "e_degree": f"with {KVE}, {deg} select kv.doc_id, kv.token_id, coalesce(degree, 0) as degree from kv left join deg using (doc_id, token_id)",
        "e_neighbours": f"""with {KVE}, b as (select * from e union all select doc_id, to_id, from_id, case relation when 'east' then 'west' else 'north' end from e)
            select relation, count(*) as n, sum(to_id - from_id)::bigint as steps from b group by 1""",
        "e_label_of": f"with {KV} select v.doc_id, v.token_id, l.token_id as label_id, rtrim(l.text, ':') || ' ' || v.text as both from kv v join kv l on l.doc_id = v.doc_id and l.token_id = v.token_id - 1 where v.token_id % 2 = 1",
        "e_removed": f"with {KVE} select * from e where not (relation = 'south' and from_id % 4 = 0)",
        "e_paths": f"""with {KV}, d as (select doc_id, list(text order by token_id) as x from kv group by 1), i as (select doc_id, x, unnest([0, 2, 4, 6, 8]) as i from d)
            select doc_id, i as token_id, array_to_string({below.format("i + 1")}, '>') as path from i
            union all select doc_id, i, array_to_string([x[i + 3]] || {below.format("i + 3")} || [x[j + 1] for j in range(i + 4, 9, 2)], '>') from i where i < 8""",
        "e_prefixes": f"""with {KV}, d as (select doc_id, list(text order by token_id) as x from kv group by 1), i as (select doc_id, x, unnest(range(0, 10)) as i from d),
            p as (select doc_id, i, x, case when i % 2 = 1 then range(i, 10, 2) else [i, i + 1] || flatten([[j, j + 1, j + 1] for j in range(i + 2, 10, 2)]) end as ids from i),
            q as (select doc_id, i, [x[j + 1] for j in ids] as t from p)
            select distinct doc_id, i as token_id, array_to_string(t[1:k], ' ') as string from (select doc_id, i, t, unnest(range(1, len(t) + 1)) as k from q)""",
        "f_corners": f"""with {GE}, c as materialized (select a.doc_id, a.from_id as tl, a.to_id as tr, b.to_id as bl, c.to_id as br from ee a join se b using (doc_id, from_id)
              join ee c on c.doc_id = a.doc_id and c.from_id = b.to_id join se d on d.doc_id = a.doc_id and d.from_id = a.to_id and d.to_id = c.to_id)
            select c.doc_id, tl, tr, bl, br, case when r2.to_id is not null then 'horizontal' when d2.to_id is not null then 'vertical' else 'unknown' end as orientation
            from c left join ee r on r.doc_id = c.doc_id and r.from_id = tr left join ee s on s.doc_id = c.doc_id and s.from_id = br
              left join se r2 on r2.doc_id = c.doc_id and r2.from_id = r.to_id and r2.to_id = s.to_id and r.to_id <> s.to_id
              left join se u on u.doc_id = c.doc_id and u.from_id = bl left join se v on v.doc_id = c.doc_id and v.from_id = br
              left join ee d2 on d2.doc_id = c.doc_id and d2.from_id = u.to_id and d2.to_id = v.to_id and u.to_id <> v.to_id""",
        "f_form_tables": f"""select o as doc_id, 0 as table_id, t as token_id, ((t - 7) // 3)::int as row, ((t - 7) % 3)::int as col, case when o % 3 = 0 then 'unknown' else 'horizontal' end as orientation
            from (select o, unnest({tab}) as t from (select o_orderkey::bigint as o from orders))""",
        "f_grid_tables": f"""with {GRID}, r as (select doc_id, max(line) + 1 as n from g group by 1)
            select doc_id, 'horizontal' as orientation, n // 2 as n_tables, n // 2 * 8 as n_cells, 3 as last_col from r""",
        "f_cells": "select o_orderkey::bigint as doc_id, 11 as token_id from orders union all select o_orderkey, 9 from orders where o_orderkey % 3 <> 0",
        "f_aligned": f"""with {FORM}, t as (select *, round_even(x0 / 0.02, 0) as k, (y0 + y1) / 2 as cy from ft), u as (select *, dense_rank() over (partition by doc_id order by k) as band from t),
            p as (select a.doc_id, a.band, a.token_id as l, b.token_id as r, a.y0 as ay, a.ord as ao, b.y0 as by_, b.ord as bo, abs(a.cy - b.cy) as far from u a join u b on b.doc_id = a.doc_id and b.band = a.band + 1 where abs(a.cy - b.cy) < 0.04),
            q as (select * from (select *, row_number() over (partition by doc_id, band, l order by far, by_, bo) as i, row_number() over (partition by doc_id, band, r order by far, ay, ao) as j from p) where i = 1 and j = 1),
            c as (select doc_id, band, row, unnest([0, 1]) as col, unnest([l, r]) as token_id from (select *, row_number() over (partition by doc_id, band order by ay, ao) - 1 as row from q)),
            s as (select c.*, stddev_pop(x0) over w as sx, stddev_pop(font) over w as sf, max(row) over (partition by c.doc_id, band) + 1 as n from c join ft using (doc_id, token_id) window w as (partition by c.doc_id, band, col))
            select doc_id, band::int as band, row::int as row, col::int as col, token_id from (select *, max(greatest(sx / 0.02, sf / 2.0)) over (partition by doc_id, band) as worst from s) where worst <= 1 and n >= 2""",
        "f_label_columns": """select c_custkey::bigint as doc_id, i as token_id, case when case when c_custkey % 2 = 0 then i // 2 else i end % 2 = 0 then 'LABEL' else 'VALUE' end as role
            from (select c_custkey, unnest(range(0, 8)) as i from customer)""",
        "n_line_index": f"with {GRID} select doc_id, token_id, (row_number() over (partition by doc_id order by y0, ord) - 1)::int as line_index from g",
        "n_counts": f"with {KVE}, {ROLES} select role as item, count(*) as n from roles group by 1 union all select relation, count(*) from e group by 1",
        "n_enriched": f"""with {FE}, {deg}, c as (select *, {CAPS} as caps from ft)
            select c.doc_id, token_id, coalesce(degree, 0)::int as degree, (row_number() over (partition by c.doc_id order by y0, ord) - 1)::int as line_index,
              least(floor(percent_rank() over (partition by c.doc_id order by caps) * 100 / 20), 4)::int as caps_bin from c left join deg using (doc_id, token_id)""",
        "n_style": rf"""with {FORM}, s as (select doc_id, token_id, text, case token_id % 3 when 0 then 'Arial' when 1 then 'Courier' end as f, case when token_id = 5 then null else font end as size, token_id = 0 as bold,
              case when token_id % 2 = 0 then '#000000' when token_id % 7 = 0 then '#202020' end as color, {CAPS} as caps, {SPACING.format("(x1 - x0)")} as gap from ft)
            select doc_id, token_id, (case when f is null then 0 else dense_rank() over (partition by doc_id, f is null order by f) - 1 end)::int as font_id,
              (case when size is null then 0 else least(floor(percent_rank() over (partition by doc_id, size is null order by size) * 100 / 20), 4) end)::int as size_bin, bold, false as italic,
              (case when color is null then 0 else dense_rank() over (partition by doc_id, color is null order by color) - 1 end)::int as color_id,
              least(floor(percent_rank() over (partition by doc_id order by caps) * 100 / 20), 4)::int as caps_bin, least(floor(percent_rank() over (partition by doc_id order by gap) * 100 / 20), 4)::int as spacing_bin from s""",
        "l_quality_gate": f"""with {FE}, {deg} select ft.doc_id, ft.token_id, (trim(text) <> '' and coalesce(degree, 0) >= 2 and not regexp_matches(text, '^\\d+\\s+[A-Z]')
            and not regexp_matches(lower(text), 'esconder filtros|mostrar filtros|ocultar filtros|atualizar|buscar|pesquisar|filtrar|limpar|resetar|voltar|avançar|próximo|anterior|cancelar|confirmar|salvar|<|>|\\.\\.\\.')) as good
            from ft left join deg using (doc_id, token_id)""",
    }


def _roles() -> dict[str, str]:
    """Single rules over seeded forms; by_token where what a rule does follows from which tokens a form has."""
    has_date, has_total, has_holder = "o % 5 <> 4", "o % 6 <> 5", "o % 4 <> 0"
    return {
        "g_initial_label": f"with {SEEDED} select doc_id, token_id, coalesce(role, case when {SEP} or {INSIDE} then 'LABEL' end) as role from seed",
        "g_initial_value": f"""with {FE}, t as (select doc_id, token_id, {SEP} or {INSIDE} as label, not {SEP} and ({DIGITS} or {WORDS} >= 2) as value from ft),
            c as (select e.doc_id, e.to_id, row_number() over (partition by e.doc_id, from_id order by relation) as r from e join t a on a.doc_id = e.doc_id and a.token_id = from_id and a.label join t b on b.doc_id = e.doc_id and b.token_id = to_id and b.value)
            select t.doc_id, token_id, case when c.to_id is not null then 'VALUE' when label then 'LABEL' end as role from t left join c on c.doc_id = t.doc_id and c.to_id = t.token_id and c.r = 1""",
        "g_initial_header": by_token("when token_id in (0, 13, 15) then 'HEADER' when token_id in (1, 5) then 'LABEL' when token_id in (2, 4, 6, 11, 12, 14) then 'VALUE'"),
        "g_classified": f"""with {FORM} select doc_id, token_id, r[1] as role, r[2] as source from (select doc_id, token_id, case token_id when 0 then ['HEADER', 'initial_header'] when 1 then ['LABEL', 'colon_recursive']
            when 2 then ['VALUE', case when doc_id % 5 <> 4 then 'colon_recursive' else 'initial_header' end] when 3 then ['VALUE', 'value_no_label_connections'] when 4 then ['VALUE', 'initial_header']
            when 5 then case when doc_id % 4 = 0 then ['HEADER', 'label_without_edges'] else ['LABEL', 'colon_recursive'] end when 6 then ['VALUE', 'colon_recursive'] when 13 then ['HEADER', 'initial_header'] when 14 then ['VALUE', 'initial_header'] when 15 then ['HEADER', 'initial_header']
            else case when doc_id % 3 <> 0 then [case when token_id < 10 then 'LABEL' else 'VALUE' end, 'table'] else case token_id when 7 then [null, null] when 11 then ['LABEL', 'typographic_hierarchy'] else ['LABEL', 'value_label_uniqueness'] end end end as r from ft)""",
        "g_separated_pairs": f"with {KVE} select * from e where not (relation = 'south' and from_id < 4)",
        "g_label_only": by_token("when token_id in (7, 10) then 'HEADER' when token_id = 8 then case when o % 3 = 0 then 'HEADER' else 'LABEL' end when token_id = 11 then 'LABEL' when token_id = 12 then 'VALUE'"),
        "g_header_preserve": f"""with {SEEDED}, f as (select *, case when token_id in (0, 1) then 15.0 when token_id = 2 then 11.0 else 10.0 end as size from seed), m as (select *, avg(size) over (partition by doc_id) as mean from f)
            select doc_id, token_id, case when y0 < 0.2 and (size >= mean * 1.2 or (size > mean and {WORDS} >= 2)) and not {SEP} and not {NUMBER} then 'HEADER' else role end as role from m""",
        "g_value_label": by_token(f"when token_id in (2, 4, 11) then 'VALUE' when token_id in (0, 8) then 'LABEL' when token_id = 3 and {has_total} then 'LABEL'"),
        "g_typographic": by_token(
            f"when token_id in (1, 7, 8, 9, 13) then 'LABEL' when token_id in (5, 6, 10, 11, 12, 14) then 'VALUE' when token_id in (2, 3) and {has_date} then 'VALUE'"
        ),
        "g_code_label": by_token(f"when token_id in (3, 13) then 'LABEL' when token_id = 14 or (token_id = 4 and {has_total}) then 'VALUE'"),
        "g_date_cleanup": f"""with {SEEDED}, {AROUND}, s as (select * replace (case when token_id = 1 then 'Date' else text end as text) from seed),
            k as (select a as token_id, near.doc_id, max({DATE}) as d, max({CODE}) as c from near join s on s.doc_id = near.doc_id and s.token_id = b group by 1, 2)
            select s.doc_id, s.token_id, case when not (role = 'LABEL' and coalesce(d, false) and not coalesce(c, false) and not {SEP} and not {INSIDE}) then role end as role from s left join k using (doc_id, token_id)""",
        "g_label_no_edges": f"with {SEEDED}, {AROUND} select doc_id, token_id, case when role = 'LABEL' and not exists (select 1 from near where near.doc_id = seed.doc_id and a = token_id) then 'HEADER' else role end as role from seed",
        "g_isolated": f"""with {SEEDED}, {AROUND}, n as (select doc_id, a as token_id, count(*) as n from near group by 1, 2)
            select seed.doc_id, token_id, case when coalesce(role, 'VALUE') = 'VALUE' and coalesce(n, 0) <= 1 and not {DIGITS} and {WORDS} <= 2 and not {SEP} and (y0 + y1) / 2 < 0.95 then 'HEADER' else role end as role from seed left join n using (doc_id, token_id)""",
        "g_label_guarantee": by_token(f"when token_id in (2, 11) then 'VALUE' when token_id = 0 or token_id = case when {has_holder} then 6 else 8 end then 'LABEL'"),
        "g_colon_chain": f"with {KV} select doc_id, token_id, case when token_id % 2 = 0 or (token_id = 1 and doc_id % 2 = 0) then 'LABEL' when token_id = 9 or (token_id = 3 and doc_id % 2 = 0) then 'VALUE' end as role from kv",
        "g_header_no_north": by_token("when token_id in (10, 11, 12) then 'LABEL' when token_id >= 7 then 'HEADER'"),
        "g_value_no_label": by_token(f"when token_id = 1 or token_id between 7 and 12 or (token_id in (2, 3) and {has_date}) or (token_id = 4 and {has_date} and {has_total}) then 'VALUE' else 'LABEL'"),
        "g_must_have_label": by_token(f"when token_id = 14 then 'VALUE' when token_id = 7 and o % 2 = 0 then 'LABEL' when o % 2 = 1 and token_id = case when {has_date} then 1 else 5 end then 'LABEL'"),
        "g_single_value": f"with {KVE} select * from e where not (from_id in (0, 4) and relation = 'south')",
        "g_adjacent_headers": by_token("when token_id in (7, 8, 10, 13) then 'LABEL' when token_id in (11, 14) then 'VALUE' when token_id = 15 then 'HEADER'"),
        "g_header_edges": f"with {FE} select * from e where not (to_id in (8, 9, 11, 12) and from_id not in (8, 9, 11, 12))",
    }


def _forms() -> dict[str, str]:
    """Sources, splits and extraction."""
    schema = "array_to_string([{0}], ';')"
    o = "o_orderkey"
    cases = {
        "date": (f"case when {o} % 5 <> 4 then strftime(o_orderdate, '%d/%m/%Y') end", f"case when {o} % 5 <> 4 then 'regex_perfect_value' else 'none' end"),
        "holder": (f"case when {o} % 4 <> 0 then c_name end", f"case when {o} % 4 <> 0 then 'regex_perfect_value' else 'regex_perfect_header_no_value' end"),
        "total_value": (f"case when {o} % 6 <> 5 then '$ ' || o_totalprice::decimal(12,2)::varchar end", f"case when {o} % 6 <> 5 then 'regex_perfect_value' else 'none' end"),
        "priority": (f"case when {o} % 3 <> 0 then o_orderpriority end", f"case when {o} % 3 <> 0 then 'regex_perfect_value' else 'regex_perfect_label_no_value' end"),
        "nation": (f"case when {o} % 3 <> 0 then n_name end", f"case when {o} % 3 <> 0 then 'regex_perfect_value' else 'none' end"),
        "ref": ("'45-' || o_orderkey::varchar", "'regex_perfect_header_value'"),
        "remarks": ("'Order ' || o_orderkey::varchar", "'regex_partial'"),
    }
    rows = ", ".join(f"{{'field': '{k}', 'value': {v}, 'strategy': {s}}}" for k, (v, s) in cases.items())
    orders = f"x as (select doc_id, r.field as field, r.value as value, r.strategy as strategy from (select {o}::bigint as doc_id, unnest([{rows}]) as r from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey))"
    parts = "a as (select c_custkey::bigint as doc_id, ['Holder:', c_name, 'Segment:', c_mktsegment, 'U.F .:', c_nationkey::varchar] as p, 'Holder: ' || c_name || ' Segment: ' || c_mktsegment || ' U.F .: ' || c_nationkey::varchar as t from customer)"
    return {
        "a_schema_lookup": f"""select o_orderkey as doc_id, coalesce('label0_' || (n_nationkey % 4)::varchar, '{A.NO_LABEL}') as label, coalesce({schema.format("lower(n_name) || '=the nation'")}, '{A.NO_FIELDS[0][0]}={A.NO_FIELDS[0][1]}') as fields
            from orders left join nation on n_nationkey = o_orderkey % 40""",
        "a_label_filter": "select o_orderkey as doc_id, 'label0_2' as label, lower(n_name) || '=the nation' as fields from orders join nation on n_nationkey = o_orderkey % 40 where n_nationkey % 4 = 2",
        "a_spans": f"""with {FORM}, s as (select *, token_id as k, row_number() over (partition by doc_id order by ord) - 1 as place from ft where token_id <> 13)
            select doc_id, place::int as token_id, text, ((k % 4 * 6) & 16) <> 0 or k % 5 = 0 as bold, ((k % 4 * 6) & 2) <> 0 as italic, '#' || lower(lpad(hex((doc_id % 70000 * 3 + k)::int), 6, '0')) as color,
              round(greatest(0.0, (x0 * 612.0 - case when k = 1 then 40.0 else 0.0 end) / 612.0), 9) as x0, round(greatest(0.0, y0 * 792.0 / 792.0), 9) as y0,
              round(least(1.0, (x1 * 612.0 + case when k = 9 then 300.0 else 0.0 end) / 612.0), 9) as x1, round(least(1.0, y1 * 792.0 / 792.0), 9) as y1 from s""",
        "b_multi_colon": f"""with {parts}, u as (select doc_id, length(t) as n, unnest(range(0, 6)) as part, unnest(p) as text from a),
            c as (select *, sum(length(text)) over (partition by doc_id order by part) as upto from u)
            select doc_id, part::int as part, text, case when part % 2 = 0 then 'LABEL' else 'VALUE' end as role, false as separated_pair, round(0.1 + 0.8 * (upto - length(text)) / n, 9)::double as x0, 0.1::double as y0,
              case when part = 5 then 0.9 else round(0.1 + 0.8 * upto / n, 9) end::double as x1, 0.14::double as y1 from c""",
        "b_newline_split": """with c as (select c_custkey::bigint as doc_id, c_custkey % 3 as k, c_name, 7.0 / (8 + length(c_name)) as cut from customer)
            select doc_id, 0 as part, case when k = 1 then 'Holder' || chr(10) || c_name else 'Holder:' end as text, case when k <> 1 then 'LABEL' end as role, k = 2 as separated_pair,
              0.1::double as x0, 0.1::double as y0, round(case when k = 2 then 0.1 + 0.8 * cut else 0.9 end, 9)::double as x1, case when k = 0 then 0.12 else 0.14 end::double as y1 from c
            union all select doc_id, 1, c_name, case when k = 2 then 'VALUE' end, k = 2, round(case when k = 2 then 0.1 + 0.8 * cut else 0.1 end, 9)::double, case when k = 0 then 0.12 else 0.1 end::double, 0.9::double, 0.14::double from c where k <> 1""",
        "b_merged": """with c as (select c_custkey::bigint as doc_id, c_custkey as k, case when c_custkey % 2 = 0 then 'Telefone da' else 'Telefone' end as a, c_mktsegment as b, c_name as n,
              case c_custkey % 3 when 0 then 0.112 when 1 then 0.101 else 0.13 end as y, (c_custkey % 3 = 0 and c_custkey % 2 = 0) or c_custkey % 3 = 1 as one from customer)
            select doc_id, 0 as token_id, 0 as ord, case when one then a || ' ' || b else a end as text, 0.1::double as y0, case when one then y + 0.02 else 0.12 end::double as y1 from c
            union all select doc_id, 1, 1, b, y::double, (y + 0.02)::double from c where not one
            union all select doc_id, 2, case when one then 1 else 2 end, n, 0.1::double, 0.12::double from c""",
        "l_type_gate": f"with {KV}, {TYPED}, t as (select doc_id, token_id, text from kv union all select * from ty) select doc_id, token_id, {', '.join(f'({v}) as {k}' for k, v in _types().items())} from t",
        "l_extract": f"with {EXTRACT} select doc_id, field, value, case when value is null then 'none' else 'regex_perfect_value' end as strategy from x",
        "l_metadata": f"""with {EXTRACT} select doc_id, count(*) as total_fields, count(value) as extracted_fields, round(count(value)::double / count(*), 6) as success_rate,
            string_agg(token_id::varchar, ',' order by token_id) as nodes, 'regex_perfect_value' as rules from x group by 1""",
        "l_extract_orders": f"with {orders} select doc_id, field, value, strategy, strategy like 'regex_perfect%' as used from x",
        "l_extract_later": f"""select o_orderkey::bigint as doc_id, r.field as field, r.value as value, r.strategy as strategy from (select o_orderkey, unnest([{{'field': 'nome_cliente', 'value': case when {o} % 6 = 5 then n_name else 'Total' end, 'strategy': 'name_heuristic'}},
              {{'field': 'valor', 'value': null, 'strategy': 'none'}}, {{'field': 'vencimento', 'value': case when {o} % 5 <> 4 and {o} % 6 <> 5 then strftime(o_orderdate, '%d/%m/%Y') end, 'strategy': case when {o} % 5 <> 4 and {o} % 6 <> 5 then 'pattern_perfect' else 'none' end}},
              {{'field': 'telefone', 'value': null, 'strategy': 'none'}}]) as r from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey)""",
        "l_occurrences": f"with {orders} select 'order' as label_type, field as field_name, count(*) as n, round(count(value)::double / count(*), 6) as found_rate from x group by 2",
    }


CAPS = r"(case when regexp_matches(text, '\p{L}') then length(regexp_replace(text, '[^\p{Lu}]', '', 'g'))::double / length(regexp_replace(text, '[^\p{L}]', '', 'g')) else 0.0 end)"
_SOLID = r"length(regexp_replace(text, '\s', '', 'g'))"
SPACING = "(case when " + _SOLID + " > 1 and {0} > 0 then ({0} - {0} / length(text) * " + _SOLID + ") / greatest(" + _SOLID + " - 1, 1) else 0.0 end)"


def _words() -> dict[str, str]:
    """Texts, schema words and names."""
    lines = f"with {LINES}"
    ends = "['vencimento', 'emissão', 'telefone de contato', 'valor da parcela', 'refinanciamento mensal']"
    stop = ", ".join(f"'{w}'" for w in E.STOP.split())
    in_list = lambda words: ", ".join(f"'{w}'" for w in words.split())
    either = lambda words: words.replace(" ", "|")
    uniq = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"
    stem = f"regexp_extract(k, '^(.{{3,}}){E.SUFFIX}$', 1)"
    bones = f"regexp_replace({stem}, '[aeiou]', '', 'g')"
    rest = "regexp_replace(k[2:], '[aeiou]', '', 'g')"
    short = ", ".join(f"case when {stem} <> '' and contains(k, '{p}') then '{v}' end" for p, v in E.SHORT_FORMS.items())
    variants = f"""[k, regexp_replace(translate(k, '{X.ACCENTS}', '{X.PLAIN}'), '[^\x00-\x7F]', '', 'g'), case when {stem} <> '' then {stem} end,
        case when {stem} <> '' and length({bones}) >= 2 then case when length({bones}) > 3 then {bones}[1] || {bones}[length({bones}) // 2 + 1] || {bones}[-1] else {bones} end || 'o' end, {short},
        case when length(k) > 5 then k[1:3] end, case when length(k) > 5 then k[1:4] end, case when length(k) > 6 and {rest} <> '' then k[1] || {rest}[1:2] || 'o' end]"""
    described = rf"""d as (select p_partkey as id, 'data_' || lower(p_type) as name, 'Data de ' || {ends}[p_partkey % 5 + 1] || ' ' || p_name as description from part),
        w as (select *, list_filter(regexp_extract_all(lower(description), '[\p{{L}}\p{{M}}\p{{Nd}}_]+'), lambda x: length(x) > 2 and x not in ({stop})) as words from d),
        m as (select *, list_filter(flatten([{variants} for k in words]), lambda x: x is not null and length(x) >= 2) as every from w),
        v as (select *, {uniq.format("every")} as syn from m)"""
    twice = lambda words, test: f"flatten([case when {test} then [k, k] else [k] end for k in {words}])"
    query = f"""[description] || {twice("words", f"regexp_matches(k, '{either(E.WEIGHTY)}')")} || flatten([[k, k] for k in syn if k in ({in_list(E.IMPORTANT)})]) || [k for k in syn if k not in ({in_list(E.IMPORTANT)})]
        || {twice("[k for k in string_split(name, '_') if length(k) > 3]", f"regexp_matches(lower(k), '{either(E.WEIGHTY_NAMES)}')")}"""
    hit = "[k for k in words || syn if contains(label, k)]"
    named = rf"(case when {_WORD_COUNT} >= 2 then 10 when {_WORD_COUNT} = 1 then 5 else 0 end + case when not regexp_matches(text, '\p{{Nd}}') then 5 else 0 end + case when not regexp_matches(text, '[^\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}\s''-]') then 3 else 0 end + case when len(list_filter({_WORD_LIST}, lambda w: w <> '' and not regexp_matches(w, '^\p{{Lu}}'))) = 0 then 2 else 0 end)"
    return {
        "c_search_texts": rf"""{lines} select doc_id, token_id, contains(n, 'tion') or contains(n, 'nand') as has, md5(regexp_replace(regexp_replace(split_part(regexp_replace(' ' || text || ' ', '\r\n|\r', chr(10), 'g'), chr(10), 1), '^\s+', ''), '\s+$', '')) as first_line
            from (select *, {accent_norm("text")} as n from tl)""",
        "c_after_label": "select c_custkey, c_name || ' of ' || c_mktsegment as rest, null::varchar as nothing from customer",
        "c_caps_spacing": f"{lines} select doc_id, token_id, round({CAPS}, 9) as caps, round({SPACING.format('0.5::double')}, 9) as spacing from tl",
        "c_truncated": f"""{lines}, h as (select *, text[1:40] as head, 40 - instr(reverse(text[1:40]), ' ') as cut, instr(reverse(text[1:40]), ' ') > 0 as has from tl)
            select doc_id, token_id, md5(case when length(text) <= 40 then text else case when has and cut > 28 then head[1:cut] else head end || '...' end) as short from h""",
        "c_distance": f"with {FORM} select doc_id, token_id, round(least(1.0, sqrt(((x0 + x1) / 2 - 0.1) * ((x0 + x1) / 2 - 0.1) + ((y0 + y1) / 2 - 0.9) * ((y0 + y1) / 2 - 0.9)) / sqrt(2.0)), 9) as far from ft",
        "c_whitish": """with c as (select c_custkey, (16711680 + c_custkey * 977 % 65536)::bigint as v from customer)
            select c_custkey, case when c_custkey % 10 = 0 then 'white' else '#' || lower(hex(v)) end as color, c_custkey % 10 = 0 or (v // 256 % 256 > 240 and v % 256 > 240) as white from c""",
        "c_run_id": "select o_orderkey, strftime(o_orderdate, '%Y%m%d_%H%M%S') || '_page.' || o_orderkey::varchar as run from orders",
        "h_aggregate": """select l_orderkey, round(sum(l_quantity::decimal(12,2)::double), 2) as total, max(l_orderkey % 3 = 0 and l_linenumber = 1) as mixed, (3 * count(*) - 2)::int as listed, (2 * count(*) - 1)::int as joined, count(*) as n from lineitem group by 1""",
        "i_label_pattern": f"with {KV} select doc_id, token_id, 'money' as hint, regexp_extract(text, '{H.MONEY}') as value, 0.9::double as score from kv where regexp_matches(text, '{H.MONEY}') and token_id % 2 = 1",
        "i_names": f"{lines}, {TYPED}, t as (select doc_id, token_id, text from tl union all select * from ty) select doc_id, token_id, {named} as points from t where {_named('text')} and not {_address()}",
        "i_regex_partial": f"""with {KV}, k as (select doc_id, token_id, {ascii_norm("text")} as t from kv),
            f as (select unnest(['nat', 'bal', 'holder_ref']) as field, unnest(['nat', 'bal', 'holder ref']) as n, unnest(['nation', 'balance sheet', 'customer']) as d,
              unnest([['nat', 'nation'], ['bal', 'balance', 'sheet'], ['holder', 'ref', 'customer']]) as w, unnest([['nation'], ['balance', 'sheet'], ['customer']]) as dw),
            q as (select *, [{{'at': instr(t, z), 'i': list_position(w, z), 'n': length(z)}} for z in w if contains(t, z)] as a, [{{'at': instr(t, z), 'i': list_position(dw, z), 'n': length(z)}} for z in dw if contains(t, z)] as b from k cross join f where t <> ''),
            m as (select doc_id, field, token_id, greatest(case when contains(t, n) then length(n) else 0 end, case when contains(t, d) then length(d) else 0 end, coalesce(list_min(a).n, 0), coalesce(list_min(b).n, 0)) / length(t) * 0.8 as score,
              t = n or t = d or list_contains(w, t) as own from q)
            select doc_id, field, token_id, round(score, 6) as score from m where not own and score >= 0.3""",
        "i_embedding_topk": """with q as materialized (select vec_id, embedding::double[] as e from embeddings where vec_id % 100 = 0),
            s as (select q.vec_id as query_id, v.vec_id, round((list_inner_product(v.embedding::double[], q.e) + 1) / 2, 6) as score from embeddings v join q on q.vec_id <> v.vec_id),
            r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s where score >= 0.3) select query_id, vec_id, score, rank::int as rank from r where rank <= 5""",
        "j_keywords": f"with {described} select id, array_to_string(words, ' ') as words from v",
        "j_synonyms": f"with {described} select id, array_to_string(syn, ' ') as words from v",
        "j_expanded_query": f"""with {described}, q as (select id, {query} as parts from v)
            select id, array_to_string(list_filter(parts, lambda x, i: lower(x) in ({in_list(E.REPEATED)}) or list_position([lower(p) for p in parts], lower(x)) = i), ' ') as query from q""",
        "j_boost": f"""with {described}, l as (select *, lower(['Dt. vcto', 'Tel', 'Valor base', 'Data de emissão', 'other'][id % 5 + 1]) as label from v)
            select id, round(case when len({hit}) = 0 then 1.0 else least({E.BOOST_MOST}, 1 + {E.BOOST_EACH} * least(len({hit}), 3) + {E.BOOST_IMPORTANT} * len([k for k in words || syn if contains(label, k) and k in ({in_list(E.IMPORTANT)})])) end, 6)::double as boost from l""",
        "k_heuristic": f"""with {KV} select doc_id, token_id, round(case when token_id % 2 = 1 then 1.0 else 0.3 end * 0.4 + (1.0 - ((y0 + y1) / 2 + (x0 + x1) / 2) / 2) * 0.2
            + case when length(text) between 3 and 50 then 1.0 when length(text) < 3 then 0.7 when length(text) <= 100 then 0.8 else 0.5 end * 0.1 + case when token_id % 2 = 1 then 0.9 else 0.5 end * 0.1, 6) as score from kv""",
        "k_tied": f"with {FORM} select doc_id, token_id, round(6.0 / length(text) * 0.8, 6)::double as score from ft where token_id = 12 and 6.0 / length(text) * 0.8 >= 0.3",
        "m_report": f"with {PATTERNS} select label_type, field_name, n as occurrence_count, round(found_rate, 6) as found_rate, round(mean_x, 6) as mean_x, top_role, round(role_share, 6) as role_share, top_type as top_data_type, round(mean_c, 6) as mean_c from rg",
    }


_WORD_LIST = r"regexp_split_to_array(text, '\s+')"
_WORD_COUNT = f"len(list_filter({_WORD_LIST}, lambda w: w <> ''))"


def _form_of(c: str) -> str:
    t = STRIP.format(c)
    return rf"""case when regexp_matches({t}, '{X.DATE}') then 'date_like' when regexp_matches({t}, '^(?:R\s*\$|US\s*\$|[$€£])\s*\d') or regexp_matches({t}, '^\d{{1,3}}(?:\.\d{{3}})*,\d{{2}}$') then 'money_like'
      when regexp_matches({t}, '^\d+$') then 'digits_only' when regexp_matches({t}, '^[\d\s.,/()+-]+$') and regexp_matches({t}, '[0-9]') then 'digits_with_separators' when regexp_matches({t}, '^\p{{L}}{{1,3}}$') then 'isolated_letters'
      when regexp_matches({t}, '^\S+$') and regexp_matches({t}, '\d') and regexp_matches({t}, '\p{{L}}') then 'alphanumeric' else 'text' end"""


def _choices() -> dict[str, str]:
    """Candidates, sessions and stores."""
    kinds = {"when": "date", "amount": "money", "id": "cpf", "state": "uf", "note": "text"}
    wanted = " ".join(f"when '{f}' then {list(C.FORMS_OF_TYPE[k])}" for f, k in kinds.items())
    upper = f"regexp_replace(translate(upper(text), '{X.ACCENTS}', '{X.PLAIN}'), '[^\x00-\x7F]', '', 'g')"
    rank = " ".join(f"when '{r}' then {i}" for i, r in enumerate(C.RELATIONS))
    place = " ".join(f"when '{r}' then {p}" for r, p in C.PLACE.items())
    typed = "list_contains(case kind " + " ".join(f"when '{k}' then {list(C.FORMS_OF_TYPE[k])}" for k in ("money", "text", "int")) + " end, form)"
    return {
        "o_label_blocks": LABELLED + " select doc_id, block_id, field, round(score, 6) as score from lab",
        "o_label_priority": LABELLED + f""", p as (select kv.doc_id, kv.token_id as block_id, field, {accent_norm("kv.text")} as x, string_split({accent_norm("kv.text")}, ' ') as w, length(kv.text) as n, kv.token_id + 8.0 as font from kv cross join f),
            s as (select *, greatest(case when list_contains(list_distinct(w), field) then 1.0 / len(list_distinct(w)) else 0.0 end, 1 - levenshtein(x, field)::double / greatest(length(x), length(field), 1)) as score from p),
            r as (select *, score / (1.0 + n * 0.01) + font * 0.01 as priority from s where score >= 0.6)
            select doc_id, block_id, field, round(priority, 6) as priority, row_number() over (partition by doc_id, field order by priority desc, block_id)::int as rank from r""",
        "o_positions": f"""with {FORM}, p as (select *, max(x1) over (partition by doc_id) as w, max(y1) over (partition by doc_id) as h, (x0 + x1) / 2 as cx, (y0 + y1) / 2 as cy from ft),
            c as (select doc_id, token_id as block_id, 'a' as field, (1 - cx / (w * 0.5) + 1 - cy / (h * 0.5)) / 2 as score from p where cx < w * 0.55 and cy < h * 0.55
              union all select doc_id, token_id, 'b', (cx / (w * 0.5) - 1 + cy / (h * 0.5) - 1) / 2 from p where cx >= w * 0.45 and cy >= h * 0.45
              union all select doc_id, token_id, 'c', (cx / (w * 0.5) - 1 + 1 - cy / (h * 0.5)) / 2 from p where cx >= w * 0.45 and cy < h * 0.55)
            select doc_id, field, block_id, round(score, 6) as score from c where score > 0.3""",
        "o_table_row": """select o_orderkey::bigint as doc_id, c.field as field, c.block_id as block_id, 'table_row' as relation from (select o_orderkey, unnest([{'field': 'status', 'block_id': 8}, {'field': 'status', 'block_id': 9}, {'field': 'priority', 'block_id': 7}, {'field': 'priority', 'block_id': 9}]) as c from orders)
            where c.block_id <> 9 or o_orderkey % 3 <> 0""",
        "o_same_block": "select c_custkey::bigint as doc_id, 'holder' as field, 0 as block_id, c_name as text from customer",
        "o_forms": f"""with {TYPED}, k as (select unnest({list(kinds)}) as field), t as (select *, {_form_of("text")} as form from ty)
            select doc_id, field, token_id as block_id from t cross join k where list_contains(case field {wanted} end, form)""",
        "o_enums": f"""with {KV}, t as (select doc_id, token_id, {upper} as p from kv), o as (select unnest(['segment', 'segment', 'region', 'region']) as field, unnest(['AUTOMOBILE', 'BUILDING SITE', 'ASIA', 'EUROPE']) as x)
            select distinct doc_id, field, token_id as block_id from t join o on contains(p, x) or contains(x, p)""",
        "o_footers": f"""with {FORM}, t as (select text, count(distinct doc_id) as n from ft group by 1) select token_id as block_id, count(*) as n from ft join t using (text) where t.n > 0.7 * (select count(*) from orders) group by 1""",
        "o_text_window": "select c_custkey, case when c_custkey % 5 in (0, 2) then ' ' || c_name || ' ' || chr(10) || c_mktsegment else c_name end as window from customer",
        "o_score_tuple": f"""with b as (select c_custkey, case when c_custkey % 2 = 0 then '$ ' || c_acctbal::decimal(12,2)::varchar else c_mktsegment end as text, ['money', 'text', 'int'][c_custkey % 3 + 1] as kind,
              ['semantic', 'south_of', 'same_block', 'same_line', 'table_row'][c_custkey % 5 + 1] as rel, c_custkey as k from customer), t as (select *, {_form_of("text")} as form from b), u as (select *, {typed} as ok from t)
            select c_custkey, (ok and (rel in ('table_row', 'same_line') or (rel = 'same_block' and length(text) >= 4)))::int as sufficient, (case rel {rank} end)::int as relation_rank, ok::int as type_gate, (k % 4 / 4.0 <= 0.5)::int as style,
              (k % 2 = 1)::int as same_component, (case rel {place} end)::double as place, case k % 3 when 0 then 2 when 1 then 1 else 0 end as memory, (case when rel = 'semantic' then floor(k % 10 / 10.0 * 10) else 0 end)::int as meaning from u""",
        "o_candidates": LABELLED + """, d as (select *, row_number() over (partition by doc_id, field, block_id, relation order by score desc, far) as r from cs), top as (select *, row_number() over (partition by doc_id, field order by score desc, block_id, relation) as k from d where r = 1)
            select doc_id, field, block_id, relation, round(score, 6) as score, round(far, 6) as far from top where k <= 12""",
        "o_pareto": LABELLED + """ select distinct doc_id, field, block_id, relation from cs a where not exists (select 1 from cs b where b.doc_id = a.doc_id and b.field = a.field and b.score >= a.score and b.far <= a.far and (b.score > a.score or b.far < a.far))""",
        "p_search": "select distinct conv_id from conversations where contains(lower(text), 'thing') union all select distinct conv_id from conversations where contains('session ' || conv_id::varchar, 'session 1') or contains(lower(text), 'session 1')",
        "p_label_sessions": "select label, row_number() over (partition by label order by conv_id desc)::int as place, conv_id from (select distinct role as label, conv_id from conversations)",
        "p_upsert": """select c_custkey, c_mktsegment from customer where c_custkey not in (select s_suppkey * 3 from supplier) union all select s_suppkey * 3, 'CHANGED' from supplier where s_suppkey % 2 <> 0""",
        "p_store": "select event_id, user_id, value from (select *, row_number() over (partition by user_id order by event_id desc) as r from events) where r = 1 and event_type <> 'error'",
    }


def sql() -> dict[str, str]:
    t2 = f"{KV}, {LINES}, t as (select doc_id, token_id, text from kv union all select doc_id, token_id, text from tl)"
    s = STRIP.format("text")
    date, code = f"regexp_matches(text, '{X.DATE}')", f"(not regexp_matches(text, '{X.DATE}') and regexp_matches(text, '{X.CODE}'))"
    number = rf"regexp_matches({s}, '^\d+$')"
    out = {
        "c_token_predicates": rf"""with {t2} select doc_id, token_id, ends_with({s}, ':') as ends_colon, instr({s}, ':') between 2 and length({s}) - 1 as colon_inside,
            {date} as is_date, {code} as is_code, {number} as is_number, (not {date} and not {code} and not {number} and regexp_matches(text, '[A-Za-zÀ-ÿ]')) as is_text,
            regexp_matches(regexp_replace(text, '\s+$', ''), '{X.SEPARATOR}') as ends_separator from t""",
        "c_ascii_norm": f"with {LINES} select doc_id, token_id, md5({ascii_norm('text')}) as norm from tl",
        "c_accent_norm": f"with {LINES} select doc_id, token_id, md5({accent_norm('text')}) as norm from tl",
        "c_keyword_sets": f"with {LINES} select doc_id, token_id, array_to_string({keywords('text')}, ' ') as keywords from tl",
        "c_label_score": f"""with a as (select p_partkey as id, {accent_norm("p_name")} as x, {accent_norm("p_type")} as y from part),
            b as (select *, list_distinct(string_split(x, ' ')) as s, list_distinct(string_split(y, ' ')) as t from a)
            select id, round(greatest(len(list_intersect(s, t))::double / len(list_distinct(list_concat(s, t))), 1 - levenshtein(x, y)::double / greatest(length(x), length(y), 1)), 6) as score from b""",
        "c_multi_value": r"""with a as (select l_orderkey, l_linenumber, '$ ' || l_extendedprice::decimal(12,2)::varchar as p, l_quantity::decimal(12,2)::varchar as q, l_discount::decimal(12,2)::varchar as r from lineitem)
            select l_orderkey, l_linenumber, true as multi, len(list_distinct([p, q, r]))::int as n_values from a""",
        "b_colon_split": """with a as (select c_custkey::bigint as doc_id, 'Holder: ' || c_name as t, c_name from customer),
            b as (select *, 0.1 + (0.5 - 0.1) * 7 / length(t) as cut from a)
            select doc_id, 0 as part, 'Holder:' as text, 'LABEL' as role, true as separated_pair, 0.1::double as x0, round(cut, 9) as x1 from b
            union all select doc_id, 1, c_name, 'VALUE', true, round(cut, 9), 0.5::double from b""",
        "e_label_value": f"with {KV}, {VALUES} select * from vals",
        "f_tables": f"with {KV}, {KV_CELLS} select * from cells",
        "f_roles": f"with {KV}, {ROLES} select * from roles",
        "i_word_overlap": f"""with {KV}, f as (select unnest(['holder', 'segment', 'nation', 'region', 'balance']) as field), k as (select doc_id, token_id, {keywords("text")} as w from kv)
            select doc_id, field, token_id, 1.0::double as overlap from k join f on list_contains(w, field)""",
        "i_regex_perfect": f"""with {KV}, f as (select unnest(['holder', 'segment', 'nation', 'region', 'balance']) as field)
            select doc_id, field, token_id, 0.95::double as score from kv join f on {ascii_norm("text")} = field""",
        "i_pattern": f"""with {KV} select doc_id, token_id, 'money' as hint, regexp_extract(text, '{H.MONEY}') as value, round(0.5 + case when token_id % 2 = 0 then 0.1 else 0.3 end + 0.1, 6)::double as score
            from kv where regexp_matches(text, '{H.MONEY}')""",
        "j_type_classifier": """with p as (select label, i, avg(embedding[i]::double) as m from (select label, embedding, unnest(range(1, 65)) as i from embeddings) group by 1, 2),
            v as (select 'k' || label::varchar as kind, list(m order by i) as raw from p group by 1), n as (select kind, list_transform(raw, lambda x: x / sqrt(list_inner_product(raw, raw))) as proto from v),
            s as (select vec_id, kind, round(list_inner_product(embedding::double[], proto), 6) as similarity from embeddings cross join n),
            r as (select *, row_number() over (partition by vec_id order by similarity desc, kind) as k from s) select vec_id, kind, round(similarity, 5) as similarity from r where k = 1 and similarity >= 0.45""",
        "m_found_rate": f"with {OCC} select label_type, field_name, count(*) as n, round(avg(found::int), 6) as found_rate from occ group by 1, 2",
        "m_position": f"with {PATTERNS} select label_type, field_name, n_placed, round(mean_x, 6) as mean_x, round(mean_y, 6) as mean_y, round(std_x, 6) as std_x, round(std_y, 6) as std_y from r",
        "m_distributions": f"with {PATTERNS} select label_type, field_name, role as item, c as n, round(share, 6) as share from ro",
        "m_rigidity": f"with {PATTERNS} select label_type, field_name, round(rigidity, 6) as rigidity from rg",
        "m_veto": f"""with {PATTERNS} select seq, coalesce((n >= 2 and found_rate = 0) or (n >= 50 and found_rate >= 0.8 and rigidity >= 0.7 and (
            coalesce(sqrt((x - mean_x) * (x - mean_x) + (y - mean_y) * (y - mean_y)) > 3 * greatest(case when coalesce(std_x, 0) = 0 then 100.0 else std_x end, case when coalesce(std_y, 0) = 0 then 100.0 else std_y end), false)
            or coalesce(role_share > 0.7 and role <> top_role, false) or coalesce(type_share > 0.7 and data_type <> top_type, false))), false) as rejected
            from occ left join rg using (label_type, field_name)""",
        "m_stream": f"with {OCC} select label_type, field_name, count(*)::bigint as n, round(avg(found::int), 6) as found_rate from occ group by 1, 2",
        "p_by_label": "select role as label, count(distinct conv_id) as n_sessions, max(conv_id) as newest from conversations group by 1",
        "p_dedupe": "select conv_id, turn, role from (select *, row_number() over (partition by conv_id order by turn) as r from conversations) where r = 1",
        "p_latest": "select conv_id, turn, md5(text) as text_md5 from (select *, row_number() over (partition by conv_id order by turn desc) as r from conversations where role = 'assistant') where r = 1",
    }
    out |= {f"h_{h.name}": _hint(h.name) for h in H.HINTS}
    return out | _graphs() | _roles() | _forms() | _words() | _choices()
