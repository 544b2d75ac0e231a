"""SQL for those queries that it can express."""

from __future__ import annotations

from pagelattice.llm import decontaminate as dc
from pagelattice.llm import quality_rules as qr
from pagelattice.llm import url_filter as uf
from pagelattice.llm.common import UPPER

WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"


def _quality() -> str:
    stop = ", ".join(f"'{w}'" for w in sorted(set(qr.STOP_WORDS.split())))
    tests = " and ".join(
        t
        for r in qr.RULES
        for t in (
            f"{r.measure} >= {r.lowest}" if r.lowest is not None else "",
            f"{r.measure} <= {r.highest}" if r.highest is not None else "",
        )
        if t
    )
    gets = ", ".join(f"w[i + {k}]" for k in range(qr.WINDOW))
    return rf"""
with d as (select doc_id, coalesce(text, '') as t, {WORDS.format("coalesce(text, '')")} as w from documents),
wins as (select doc_id, i, [{gets}] as win from (
    select doc_id, w, unnest(range(1, greatest(len(w) - {qr.WINDOW - 2}, 1))) as i from d)),
twice as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, win) as c from wins) where c > 1),
covered as (select doc_id, count(distinct p) as n from (
    select doc_id, unnest(range(i, i + {qr.WINDOW})) as p from twice) group by 1),
lines as (select doc_id, count(*) as n_lines, count(*) - count(distinct line) as n_dup from (
    select doc_id, unnest(string_split(t, chr(10))) as line from d) where regexp_matches(line, '[^\x20\x09-\x0D]') group by 1),
m as (select d.doc_id, len(w) as n_words, length(array_to_string(w, '')) as word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as n_symbols,
    coalesce(n_dup, 0) as n_dup_lines, coalesce(n_lines, 0) as n_lines,
    coalesce(covered.n, 0) as n_repeat_words,
    len(list_filter(w, lambda x: translate(x, '{UPPER}', '{UPPER.lower()}') in ({stop}))) as n_stop_words,
    length(regexp_replace(t, '[^!]', '', 'g')) as n_exclamations
  from d left join lines using (doc_id) left join covered using (doc_id)),
r as (select *, word_chars::double / greatest(n_words, 1) as mean_word_chars,
    n_symbols::double / greatest(word_chars, 1) as symbol_ratio,
    n_stop_words::double / greatest(n_words, 1) as stop_word_ratio,
    n_exclamations::double / greatest(n_words, 1) as exclamation_ratio,
    n_dup_lines::double / greatest(n_lines, 1) as dup_line_ratio,
    (n_words < {qr.MIN_WORDS} or 100 * n_repeat_words > {qr.MAX_REPEAT_PERCENT} * n_words) as base_failed from m)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols,
  n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words, base_failed,
  (not base_failed and {tests}) as kept from r"""


def _substrings() -> str:
    return rf"""
with d as (select doc_id, {WORDS.format("coalesce(text, '')")} as w from documents),
win as (select doc_id, i, array_to_string(w[i:i + 12], ' ') as s from (
    select doc_id, w, unnest(range(1, greatest(len(w) - 11, 1))) as i from d)),
least as (select s, min(doc_id) as m from win group by 1),
gone as (select distinct doc_id, p from (
    select doc_id, unnest(range(i, i + 13)) as p from win join least using (s) where m < doc_id)),
kept as (select d.doc_id, p, w[p] as x from (select doc_id, w, unnest(range(1, len(w) + 1)) as p from d) d
    left join gone using (doc_id, p) where gone.doc_id is null),
k as (select doc_id, string_agg(x, ' ' order by p) as t, count(*) as n from kept group by 1)
select d.doc_id, len(w)::bigint as n_words, (len(w) - coalesce(k.n, 0))::bigint as n_removed,
  sha256(coalesce(k.t, '')) as kept_sha256 from d left join k using (doc_id)"""


def _urls() -> str:
    cases = "".join(
        f" when (host = '{h}' or host like '%.{h}') and starts_with(path, '{p}') then {{}}".format(f"'{h}{p}'")
        for h, p, _ in sorted(uf.DEFAULT_RULES, key=lambda r: -len(r[0] + r[1]))
    )
    verdicts = "".join(f" when '{h}{p}' then '{v}'" for h, p, v in uf.DEFAULT_RULES)
    hosts = ", ".join(f"'{u.split('://')[1]}'" for u in uf.DEFAULT_HOSTS)
    key = rf"regexp_replace(regexp_replace(host, ':\d*$', ''), '\.+$', '') || case when path = '' then '/' else regexp_replace(path, '/{{2,}}', '/', 'g') end"
    return rf"""
with a as (select page_id, case when contains(url, '://') then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
b as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{UPPER.lower()}') as host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from a),
c as materialized (select *, case{cases} end as rule, {key} as whole from b),
d as (select whole, split_part(whole, '/', 1) as h, substr(whole, length(split_part(whole, '/', 1)) + 1) as p from (select distinct whole from c where rule is null and host <> '')),
e as (select whole, string_split(h, '.') as hs, string_split(p, '/') as ps, p from d),
f as (select whole, p, ps, array_to_string(hs[i:], '.') as h from (select *, unnest(range(1, len(hs) + 1)) as i from e)),
g as (select whole, h || p as k from f union all select whole, h || array_to_string(ps[1:j], '/') || '/' from (select *, unnest(range(1, len(ps))) as j from f)),
listed as (select distinct whole as k from c where page_id % {uf.FEED} = 0 and whole <> '/' and exists (select 1 from pages x where x.page_id = c.page_id and contains(x.url, '://')) union select unnest([{hosts}])),
hit as (select distinct whole from g join listed using (k))
select page_id, host, path, rule, case rule{verdicts} else case when host <> '' and hit.whole is not null then 'block' else 'allow' end end as verdict from c left join hit using (whole)"""


def _contamination() -> str:
    shingles = rf"""{{0}}w as (select {{1}} as id, {WORDS.format(f"translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}')")} as w from {{2}}),
{{0}}s as (select distinct id, array_to_string(w[i:i + {dc.SHINGLE - 1}], ' ') as s from (
  select id, w, unnest(range(1, greatest(len(w) - {dc.SHINGLE - 2}, 2))) as i from {{0}}w where len(w) > 0))"""
    return f"""with {shingles.format("d", "doc_id", "documents")}, {shingles.format("b", "item_id", "benchmark")},
n as (select id, count(*) as n from bs group by 1),
p as (select ds.id as doc_id, bs.id as item_id, count(*) as n_shared from ds join bs using (s) group by 1, 2)
select doc_id, item_id, n_shared::bigint as n_shared, n::bigint as n_item, n_shared::double / n as containment
from p join n on n.id = p.item_id where n_shared >= n * {dc.THRESHOLD} - 1e-9"""


def _chat() -> str:
    """Messages whose lines may be quoted; a message that quotes links only if SQL finds the passage as a whole line."""
    lines = "[x for x in string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))]"
    normal = rf"trim(regexp_replace(translate(regexp_replace({{}}, '^[ \t]*>[> \t]*', ''), '{UPPER}', '{UPPER.lower()}'), '[\x20\x09-\x0D]+', ' ', 'g'))"
    return rf"""
with m as materialized (select distinct conv_id, coalesce(turn, -1) as turn, coalesce(role, 'unknown') as role, coalesce(text, '') as text from conversations),
l as (select *, unnest({lines}) as line from m),
q as (select conv_id, turn, role, text, regexp_matches(line, '^[ \t]*>') as quoted, length(regexp_replace(regexp_extract(line, '^[ \t]*(>[> \t]*)', 1), '[^>]', '', 'g')) as level, {normal.format("line")} as norm from l),
k as (select a.conv_id, a.turn, a.role, a.text, a.level, a.norm, max(b.turn) as origin from (select distinct * from q where quoted and norm <> '') a
  join q b on b.conv_id is not distinct from a.conv_id and b.norm = a.norm and not b.quoted and b.turn < a.turn group by all),
v as (select conv_id, turn, role, text, level, origin, count(*) as n, sum(length(norm)) as size from k group by all),
w as (select conv_id, turn, role, text, sum(n) over p as n_linked, origin, row_number() over (partition by conv_id, turn, role, text order by level, size desc, n desc, origin desc) as r from v window p as (partition by conv_id, turn, role, text)),
n as (select conv_id, turn, role, text, count(*) filter (where quoted) as n_quoted from q group by all),
b as (select *, lag(turn) over (partition by conv_id order by turn) as before from (select distinct conv_id, turn from m)),
r as (select n.*, coalesce(w.n_linked, 0) as n_linked, coalesce(w.origin, b.before) as reply, '<|' || n.role || '|>' || chr(10)
    || regexp_replace(trim(array_to_string([x for x in {lines.replace("text", "n.text")} if not regexp_matches(x, '^[ \t]*>')], chr(10)), ' ' || chr(9) || chr(10) || chr(13)), '\n{{3,}}', chr(10) || chr(10), 'g') || chr(10) || '<|end|>' as shown
  from n left join w on w.conv_id is not distinct from n.conv_id and w.turn = n.turn and w.role = n.role and w.text = n.text and w.r = 1 left join b on b.conv_id is not distinct from n.conv_id and b.turn = n.turn)
select conv_id, 0::bigint as part, count(*) as n_messages, sum(n_quoted)::bigint as n_quoted, sum(n_linked)::bigint as n_linked,
  string_agg(coalesce(reply::varchar, '-'), ',' order by turn, role, text) as replies, string_agg(shown, chr(10) order by turn, role, text) as chat from r group by 1"""


def _warc() -> str:
    return """
with p as (select page_id, sha256(coalesce(html, '')) as payload_digest, strlen(coalesce(html, '')) as payload_bytes from pages),
f as (select *, min(page_id) over (partition by payload_digest) as first from p)
select page_id, payload_bytes::bigint as payload_bytes, payload_digest,
  case when payload_bytes >= 100 and page_id <> first then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 100 and page_id <> first then first end as refers_to from f"""


def sql() -> dict[str, str]:
    return {
        "op3_decontaminate": _contamination(),
        "op4_quality_rules": _quality(),
        "op6_substring_dedup": _substrings(),
        "op7_chat_format": _chat(),
        "op9_url_filter": _urls(),
        "op10_warc": _warc(),
    }
