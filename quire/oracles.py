"""DuckDB SQL for the queries of quire.queries, written on its own terms (no code shared but the fixture views)."""

from __future__ import annotations

from quire.plans import fixtures

PAGES = fixtures.for_oracle(fixtures.PAGES)
BOXES = fixtures.for_oracle(fixtures.BOXES)
LOG = fixtures.for_oracle(fixtures.LOG)
DET = r"<\|det\|>([^\[]+)\[\s*(\d+)\s*,\s*(\d+)\s*,\s*(\d+)\s*,\s*(\d+)\s*\]<\|/det\|>"
BBOX = r"<\|bbox\|\s*(\d+)\s*\|\s*(\d+)\s*\|\s*(\d+)\s*\|\s*(\d+)\s*(?:\|\s*([^|>\s]+)\s*)?\|?>"


def rx(c: str, pattern: str, new: str, flags: str = "g") -> str:
    return f"regexp_replace({c}, '{pattern}', {new}, '{flags}')"


def strip(c: str) -> str:
    return rx(c, r"^\s+|\s+$", "''")


def clean(c: str, hyphens: bool = True, quotes: bool = True) -> str:
    if quotes:
        c = f"translate({c}, '‘’`´“”«»', repeat(chr(39), 4) || repeat(chr(34), 4))"
    if hyphens:
        c = rx(c, r"-\s*\n\s*", "''")
        c = rx(rx(c, r"(\S)\n(\S)", r"'\1 \2'"), r"(\S)\n(\S)", r"'\1 \2'")
    c = rx(rx(c, r"<\|det\|>.*?\[.*?\]<\|/det\|>", "''"), r"<\|bbox\|.*?\|>", "''")
    return strip(rx(rx(c, r"\n{3,}", "chr(10) || chr(10)"), r"[ \t]+\n", "chr(10)"))


def placeholders(c: str) -> str:
    c = f"replace(replace(replace({c}, '<image>', ''), '<|image|>', ''), '<image_1>', '')"
    return strip(rx(rx(rx(c, r"[ \t]+\n", "chr(10)"), r"[ \t]+$", "''"), r"\n{3,}", "chr(10) || chr(10)"))


def wrap(c: str) -> str:
    c = rx(c, r"<\|det\|>(footer|page_number|header)\[[^\]]+\]<\|/det\|>([^\n<]+)", r"chr(10) || chr(10) || '<div class=\"\1\">' || chr(1) || '\2' || chr(1) || '</div>' || chr(10) || chr(10)".replace('\\"', '"'))
    c = f"regexp_replace({c}, chr(1) || '\\s*|\\s*' || chr(1), '', 'g')"
    return rx(c, r"<\|det\|>(?:footer|page_number|header)\[[^\]]+\]<\|/det\|>", "''")


def pixels(w: str = "w", h: str = "h") -> dict[str, str]:
    """Pixel box of columns x1, y1, x2, y2 on a page."""
    scale = f"(1024.0::double / greatest({w}, {h}))"
    out = {}
    for axis, side in (("x", w), ("y", h)):
        pad = f"((1024.0::double - greatest(1.0::double, round_even({side} * {scale}, 0))) / 2.0::double)"
        back = lambda v, pad=pad: f"round_even((({v} * 1024.0::double / 1000.0::double) - {pad}) / {scale}, 0)::bigint"
        low = f"greatest(0, least({side} - 1, {back(axis + '1')}))"
        out[axis] = (low, f"greatest({low} + 1, least({side}, {back(axis + '2')}))")
    return {"left": out["x"][0], "upper": out["y"][0], "right": out["x"][1], "lower": out["y"][1]}


BOX = pixels()
BIG = f"({BOX['right']} - {BOX['left']} >= 32 and {BOX['lower']} - {BOX['upper']} >= 32)"


def tag_rows(src: str, text: str = "raw_text") -> str:
    """The det tags of src's texts with their place, numbers, label and asset number."""
    return f"""
tg as (select doc_id, page_num, w, h, unnest(regexp_extract_all({text}, '{DET}')) as tag, unnest(range(1, len(regexp_extract_all({text}, '{DET}')) + 1)) as i from {src}),
tp as (select doc_id, page_num, w, h, i, trim(regexp_extract(tag, '{DET}', 1)) as label, regexp_extract(tag, '{DET}', 2)::bigint as x1, regexp_extract(tag, '{DET}', 3)::bigint as y1,
  regexp_extract(tag, '{DET}', 4)::bigint as x2, regexp_extract(tag, '{DET}', 5)::bigint as y2 from tg),
tn as (select *, coalesce(sum((label in ('image', 'figure', 'table'))::int) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as number,
  'page' || lpad(page_num::varchar, 4, '0') || '_' || label as stem, {BIG} as kept from tp)"""


def rewrite(src: str, text: str) -> str:
    """CTEs up to rw (doc_id, md): texts with tags rewritten."""
    image = "'<img src=\"images/' || stem || number || '.webp\" style=\"width:' || printf('%.1f', least(100.0, greatest(30.0, (x2 - x1) / 10.0))) || '%;max-width:100%;height:auto;display:block;margin:1em auto;\" />' || chr(10) || chr(10)"
    return f"""{tag_rows(src, text)},
tx as (select doc_id, i, chr(10) || chr(10) || case when label in ('image', 'figure', 'table') and kept then {image} when label = 'title' then '# ' when label = 'heading' then '## '
  when label = 'subtitle' then '### ' else '' end as new from tn),
sp as (select doc_id, regexp_split_to_array({text}, '{DET}') as parts from {src}),
rw as (select sp.doc_id, parts[1] || coalesce(string_agg(new || parts[i + 1], '' order by i), '') as md from sp left join tx using (doc_id) group by sp.doc_id, parts)"""


BATCHED = f"""
pg as ({PAGES}),
bt as (select *, floor((page_num - 1) / 20)::bigint as batch_id, count(*) over (partition by book_id) as total from pg),
bs as (select *, batch_id * 20 + 1 as batch_start, least(batch_id * 20 + 20, total) as batch_end from bt)"""

SEGMENTED = f"""{BATCHED},
ra as (select book_id, batch_id, '<page>' || coalesce(string_agg(case when doc_id % 37 <> 5 then raw_text end, '<PAGE>' order by page_num), '') || case when batch_id % 3 = 1 then '<page>surplus' else '' end as t from bs group by book_id, batch_id),
sa as (select book_id, batch_id, regexp_split_to_array({strip('t')}, '(?i)<page>')[2:] as parts from ra),
sg as (select book_id, batch_id, unnest(range(0, len(parts))) as idx, unnest(parts) as segment from sa)"""

BOOKS = f"""
pg as ({PAGES}),
pm as (select book_id, page_num, case when doc_id % 29 = 3 then '  ' else case when page_num % 4 = 1 then '# Chapter ' || page_num || ' ' || chr(10) || chr(10)
  when page_num % 4 = 3 then '## Part ' || page_num || chr(10) || chr(10) else '' end || raw_text end as md from pg),
bk as (select book_id, count(*) as n_pages, string_agg(md, chr(10) || chr(10) || '<!-- pagebreak -->' || chr(10) || chr(10) order by page_num) as markdown from pm group by book_id)"""


def headings(mark: str, src: str = "bk", md: str = "markdown", name: str = "ch") -> str:
    """CTE of chapters (book_id, pos, title, body) by headings."""
    pat = rf"(?m)^{mark}\s+(.+?)\s*$"
    return f"""
{name}a as (select book_id, regexp_extract_all({md}, '{pat}', 1) as titles, regexp_split_to_array({md}, '{pat}') as parts from {src}),
{name}b as (select book_id, case when parts[1] <> '' then list_prepend('', titles) else titles end as titles, case when parts[1] <> '' then parts else parts[2:] end as parts from {name}a where len(titles) >= 3),
{name} as (select book_id, unnest(range(0, len(parts))) as pos, trim(unnest(titles)) as title, {rx('unnest(parts)', r'[ \t\n]+$', "''")} as body from {name}b)"""


GROUPED = rf"""
ga as (select book_id, list_filter(list_transform(regexp_split_to_array(markdown, '(?m)^<!-- pagebreak -->$'), lambda p: {strip('p')}), lambda p: p <> '') as pages from bk),
gb as (select book_id, unnest(range(0, len(pages), 7)) as s, pages from ga),
ch as (select book_id, (s / 7)::bigint as pos, 'Pagine ' || (s + 1) || '-' || least(s + 7, len(pages)) as title, array_to_string(pages[s + 1 : s + 7], chr(10) || chr(10)) as body from gb)"""

LEGACY = rf"""
la as (select book_id, regexp_split_to_array(markdown, '(?m)^<!-- pagebreak -->$') as parts from bk),
lb as (select book_id, unnest(range(0, len(parts))) as i, unnest(parts) as p from la),
ch as (select book_id, row_number() over (partition by book_id order by i) - 1 as pos, '' as title, {strip('p')} as body from lb where case when i = 0 then p <> '' else {strip('p')} <> '' end)"""

CHAPTERS = "select book_id, pos::bigint as chapter_no, 1::bigint as level, case when title = '' then 'Pagina ' || (pos + 1) else title end as title, 'chap_' || lpad(pos::varchar, 4, '0') || '.xhtml' as filename, body from ch"

ADAPTIVE = f"""{BOOKS},{headings('#', name='h1')},{headings('##', name='h2')},
ls as (select book_id from bk where book_id not in (select book_id from h1) and book_id not in (select book_id from h2)),
{LEGACY.strip().replace('from bk)', 'from bk where book_id in (select book_id from ls))').replace('ch as (', 'lg as (')},
ch as (select book_id, pos, title, body from h1 union all select book_id, pos, title, body from h2 where book_id not in (select book_id from h1) union all select book_id, pos, title, body from lg)"""

LISTED = f"""{ADAPTIVE},
cl as ({CHAPTERS}),
ld as (select book_id, chapter_no, title, filename from cl union all select book_id, -1, 'Cover', 'cover.xhtml' from pg where page_num = 1 and w % 2 = 0)"""

IMAGES = f"select book_id, doc_id, 'page' || lpad(page_num::varchar, 4, '0') || '_figure0.' || case when doc_id % 2 = 0 then 'webp' else 'png' end as name from ({PAGES}) where doc_id % 3 = 0"


def escape(c: str) -> str:
    return f"replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


CHUNKS = "select conv_id as stream_id, turn as seq, case when turn % 5 = 4 then '' else text end as chunk from conversations"
AMOUNTS = "select l_orderkey as k, l_linenumber as n, (l_orderkey * l_partkey * l_suppkey * 8)::double as v from lineitem"
STALLS = f"select job_id, seq from (select *, coalesce(lead(ts) over (partition by job_id order by ts, seq), max(ts) over ()) as until from ({LOG})) where until > ts + interval 10 seconds and phase not in ('done', 'error')"

WHEELS = "(values (6, 0, 'cu118', '11.8'), (6, 1, 'cu118', '11.8'), (6, 2, 'cu118', '11.8'), (7, 0, 'cu118', '11.8'), (7, 5, 'cu118', '11.8'), (8, 0, 'cu124', '11.8'), (8, 6, 'cu124', '11.8'), (8, 9, 'cu124', '11.8'), (9, 0, 'cu124', '11.8'), (10, 0, 'cu126', '12.6'), (12, 0, 'cu126', '12.6')) w(wm, wn, b, l)"

def shown(v: str, end: str = "") -> str:
    return "case " + " ".join(f"when {v} / {1024.0**i}::double < 1024 then format('{{:,.1f}} {u}{end}', {v} / {1024.0**i}::double)" for i, u in enumerate(("B", "KB", "MB", "GB", "TB"))) + f" else format('{{:,.1f}} PB{end}', {v} / {1024.0**5}::double) end"


BOOK = f"""{BATCHED},
w0 as (select doc_id, book_id, page_num, w, h, {wrap(strip('raw_text'))} as t from bs),
w1 as (select * from w0),{rewrite('w1', 't')},
mp as (select book_id, page_num, {placeholders('md')} as md from rw join pg using (doc_id)),
mk as (select book_id, string_agg(md, chr(10) || chr(10) || '<!-- pagebreak -->' || chr(10) || chr(10) order by page_num) as m from mp group by book_id),
bk as (select book_id, {clean('m')} as markdown from mk)"""

CHAPTERS_OF_BOOK = f"{BOOK}," + ADAPTIVE.replace(BOOKS, "").lstrip(",")

EVENTS = f"""{SEGMENTED}, k as (select book_id, count(*) as n from kt where label in ('image', 'figure', 'table') and kept and book_id not like '%-0' group by book_id),
b as (select bs.book_id, max(total) as total, max(batch_id) as last, max(coalesce(k.n, 0)) as crops from bs left join k using (book_id) group by bs.book_id),
e as (select distinct book_id, batch_id, batch_start, batch_end, total, 'reading pages ' || batch_start || '-' || batch_end || '/' || total as m from bs),
p as (select book_id, batch_id, part, substr(' ' || t, 1, (part + 1) * 450) as text from ra, (values (0), (1)) v(part)),
every as (
  select book_id, 0 as o0, 0 as o1, 0 as o2, 'rendering' as phase, 'rendering' as message, 0 as current, 0 as total, 0.0::double as percent, false as transient from b
  union all select book_id, 1, 0, 0, 'rendering', 'rendered pages: ' || total, total, total, 100.0, false from b
  union all select book_id, 2, batch_id, 0, 'ocr', m, batch_start, total, batch_end * 100.0::double / total, false from e
  union all select e.book_id, 2, e.batch_id, part + 1, 'ocr', m || chr(10) || right(text, 500), batch_start, total, batch_end * 100.0::double / total, true from e join p on p.book_id = e.book_id and p.batch_id = e.batch_id
  union all select book_id, 3, 0, 0, 'cleaning', 'cleaning text', 0, 0, 0.0, false from b
  union all select book_id, 4, 0, 0, 'cropping', 'cut images: ' || crops, crops, crops, 100.0, false from b
  union all select book_id, 5, 0, 0, 'optimizing', 'optimizing images', 0, 0, 0.0, false from b where crops > 0
  union all select book_id, 6, 0, 0, 'compiling', 'compiling the book', 0, 0, 0.0, false from b
  union all select book_id, 7, 0, 0, 'done', 'pages done: ' || total, total, total, 100.0, false from b),
numbered as (select book_id, phase, message, current::bigint as current, total::bigint as total, percent, transient, row_number() over (partition by book_id order by o0, o1, o2) - 1 as seq from every)""".replace("k as (select book_id", f"{tag_rows('pg').strip()}, kt as (select tn.*, pg.book_id from tn join pg using (doc_id)), k as (select book_id", 1)

ORACLES = {
    "clean_text": f"select doc_id, c as cleaned, length(c) as n_chars from (select doc_id, {clean('raw_text')} as c from ({PAGES}))",
    "clean_text_flags": f"select doc_id, {clean('raw_text', False, False)} as plain, {clean('raw_text', False)} as quotes_only from ({PAGES})",
    "count_words": r"select doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) as n_words from documents",
    "strip_placeholders": f"select doc_id, {placeholders('raw_text')} as stripped from ({PAGES})",
    "parse_tags": f"""with pg as ({PAGES}),{tag_rows('pg')},
bg as (select doc_id, unnest(regexp_extract_all(raw_text, '{BBOX}')) as tag, unnest(range(1, len(regexp_extract_all(raw_text, '{BBOX}')) + 1)) as i from pg),
u as (select doc_id, 0 as kind, i, label, x1, y1, x2, y2 from tp union all
  select doc_id, 1, i, coalesce(regexp_extract(tag, '{BBOX}', 5), ''), regexp_extract(tag, '{BBOX}', 1)::bigint, regexp_extract(tag, '{BBOX}', 2)::bigint, regexp_extract(tag, '{BBOX}', 3)::bigint, regexp_extract(tag, '{BBOX}', 4)::bigint from bg)
select doc_id, row_number() over (partition by doc_id order by kind, i) - 1 as pos, label, x1, y1, x2, y2 from u""",
    "box_from_string": f"select doc_id, trim(regexp_extract(raw_text, '{DET}', 1)) as label, " + ", ".join(f"regexp_extract(raw_text, '{DET}', {i})::bigint as {n}" for i, n in ((2, "x1"), (3, "y1"), (4, "x2"), (5, "y2"))) + f" from ({PAGES})",
    "parse_bbox_legacy": f"select doc_id, coalesce(regexp_extract(raw_text, '{BBOX}', 5), '') as label, " + ", ".join(f"regexp_extract(raw_text, '{BBOX}', {i})::bigint as {n}" for i, n in ((1, "x1"), (2, "y1"), (3, "x2"), (4, "y2"))) + f" from ({PAGES}) where regexp_matches(raw_text, '{BBOX}')",
    "bbox_metrics": f"select k, n, greatest(x2 - x1, 0) as width, greatest(y2 - y1, 0) as height, greatest(x2 - x1, 0) * greatest(y2 - y1, 0) as area from ({BOXES})",
    "denormalize_bbox": "select k, n, " + ", ".join(f'{v} as "{k}"' for k, v in BOX.items()) + f" from ({BOXES})",
    "crop_filter": f"select k, n, least(100.0::double, greatest(30.0::double, (x2 - x1) / 10.0::double)) as percent from ({BOXES}) where {BIG}",
    "square_normalize": f"select k, n, nw as new_w, nh as new_h, floor((1024 - nw) / 2)::bigint as paste_x, floor((1024 - nh) / 2)::bigint as paste_y from (select k, n, greatest(1, round_even(w * (1024.0::double / greatest(w, h)), 0))::bigint as nw, greatest(1, round_even(h * (1024.0::double / greatest(w, h)), 0))::bigint as nh from ({BOXES}))",
    "batch_pages": f"with {BATCHED} select book_id, page_num::int as page_num, batch_id, batch_start, batch_end, batch_end * 100.0::double / total as percent from bs",
    "split_pages": f"with {SEGMENTED} select book_id, batch_id, idx, segment from sg",
    "page_segment_join": f"with {SEGMENTED} select doc_id, coalesce(segment, '') as segment from bs left join sg on sg.book_id = bs.book_id and sg.batch_id = bs.batch_id and sg.idx = bs.page_num - bs.batch_start",
    "layout_wrap": f"select doc_id, {wrap('raw_text')} as wrapped from ({PAGES})",
    "tag_rewrite": f"with pg as ({PAGES}),{rewrite('pg', 'raw_text')} select doc_id, md from rw",
    "asset_names": f"with pg as ({PAGES}),{tag_rows('pg')} select doc_id, number::bigint as number, label, stem || number || '.webp' as name, kept from tn where label in ('image', 'figure', 'table')",
    "page_markdown": f"with pg as ({PAGES}), wp as (select doc_id, page_num, w, h, {wrap('raw_text')} as t from pg),{rewrite('wp', 't')} select doc_id, {placeholders('md')} as md from rw",
    "assemble_book": f"with {BOOKS} select book_id, n_pages, markdown from bk",
    "chapters_h1": f"with {BOOKS},{headings('#')} {CHAPTERS}",
    "chapters_h2": f"with {BOOKS},{headings('##')} {CHAPTERS}",
    "chapters_grouped": f"with {BOOKS},{GROUPED} {CHAPTERS}",
    "chapters_legacy": f"with {BOOKS},{LEGACY} {CHAPTERS}",
    "chapters_adaptive": f"with {ADAPTIVE} {CHAPTERS}",
    "toc": f"""with {LISTED} select book_id, string_agg('<li><a href="' || filename || '">' || {escape('title')} || '</a></li>', chr(10) order by chapter_no) as toc from ld where filename <> 'cover.xhtml' group by book_id""",
    "spine": f"""with {LISTED} select book_id, string_agg('<itemref idref="' || replace(filename, '.xhtml', '') || '"/>', chr(10) || '    ' order by chapter_no) as spine from ld group by book_id""",
    "manifest": f"""with {LISTED}, im as ({IMAGES}) select book_id, 'chapter' as kind, '<item id="' || replace(filename, '.xhtml', '') || '" href="' || filename || '" media-type="application/xhtml+xml"/>' as item from ld
union all select book_id, 'image', '<item id="img_' || split_part(name, '.', 1) || '" href="images/' || name || '" media-type="image/' || split_part(name, '.', 2) || '"/>' from im""",
    "xml_escape": f"select page_id, {escape('html')} as escaped from pages",
    "responsive_images": """select page_id, replace(html, '<body>', '<body><img  src="a.png" style="max-width:100%; height:auto; display:block; margin:1em auto;" /><img  src=''b.png'' style="max-width:100%; height:auto; display:block; margin:1em auto;" /><img style="max-width:100%" src="c.png">') as html from pages""",
    "result_summary": f"""with {BOOK}, k as (select book_id, count(*) as n from tn join pg using (doc_id) where label in ('image', 'figure', 'table') and kept group by book_id), n as (select book_id, count(*) as pages from pg group by book_id)
select book_id, pages as pages_processed, coalesce(k.n, 0) as images_extracted, coalesce(k.n, 0) as images_used, length(markdown) as markdown_chars from n join bk using (book_id) left join k using (book_id)""",
    "page_separators": f"with {SEGMENTED} select book_id, batch_id, greatest(1, (length(t) - length(replace(t, '<page>', ''))) // 6)::bigint as separators from ra",
    "token_stream_prefix": f"select stream_id, seq, t as text, right(t, 500) as tail from (select stream_id, seq, string_agg(chunk, '') over (partition by stream_id order by seq rows between unbounded preceding and current row) as t from ({CHUNKS}) where chunk <> '')",
    "token_stream_final": f"select stream_id, string_agg(chunk, '' order by seq) as text from ({CHUNKS}) group by stream_id",
    "token_status": f"""with c as ({CHUNKS}), r as (select stream_id, seq, string_agg(chunk, '') over (partition by stream_id order by seq rows between unbounded preceding and current row) as text from c where chunk <> ''),
s as (select distinct stream_id + i as stream_id from c, (values (0), (1000000)) v(i)), w as (select stream_id, max(seq) as last, string_agg(chunk, '' order by seq) as text from c group by stream_id)
select stream_id, seq, text, 'running' as status from r union all select stream_id, coalesce(last, -1) + 1, coalesce(text, ''), 'done' from s left join w using (stream_id)""",
    "token_result": f"""with c as ({CHUNKS}), s as (select distinct stream_id + i as stream_id from c, (values (0), (1000000)) v(i)), w as (select stream_id, string_agg(chunk, '' order by seq) as t from c group by stream_id)
select stream_id, {placeholders("coalesce(t, '')")} as text from s left join w using (stream_id)""",
    "token_stream": f"select stream_id, seq, length(t)::bigint as n_chars, right(t, 500) as tail from (select stream_id, seq, string_agg(chunk, '') over (partition by stream_id order by seq rows between unbounded preceding and current row) as t from ({CHUNKS}) where chunk <> '')",
    "latest_state": f"select job_id, phase, message, percent, n_events from (select *, row_number() over (partition by job_id order by ts desc, seq desc) as r, count(*) over (partition by job_id) as n_events from ({LOG})) where r = 1",
    "phase_coverage": f"select job_id, string_agg(distinct phase, ',' order by phase) as phases from ({LOG}) group by job_id",
    "job_elapsed": f"select job_id, (epoch(date_trunc('second', max(ts))) - epoch(date_trunc('second', min(ts))))::bigint as seconds from ({LOG}) group by job_id",
    "stall_watchdog": STALLS,
    "stall_stream": STALLS,
    "transient_filter": f"select job_id, seq, phase from ({LOG}) where not transient",
    "format_event": f"select seq, '[' || rpad(upper(phase), 10, ' ') || ']' || case when total <> 0 then ' [' || rpad(repeat('█', round_even(percent / 5, 0)::int), 20, ' ') || '] ' || lpad(printf('%.1f', percent), 5, ' ') || '%' else '' end || ' ' || message as line from ({LOG})",
    "state_json_defaults": f"select seq, case when seq % 4 > 1 then phase else 'init' end as phase, '' as message, case when seq % 4 > 1 then seq else 0 end::bigint as downloaded_bytes, 0::bigint as total_bytes, case when seq % 4 > 1 then 1.5 else 0 end::double as speed_bps, 0.0::double as eta_seconds, 0.0::double as updated_at from ({LOG})",
    "progress_percent": f"select seq, case seq % 5 when 0 then 100.0 when 1 then 0.0 when 2 then 50.0 when 3 then 0.0 else case when total > 0 then least(100.0::double, percent * 100 / total) end end::double as shown from ({LOG})",
    "wheel_asof": f"""with d as (select distinct (l_partkey % 14)::int as major, (l_suppkey % 10)::int as minor, (l_linenumber + 8)::int as driver_major from lineitem),
j as (select d.*, b, l, row_number() over (partition by major, minor, driver_major order by case when wm = major and wn = minor then 0 else 1 end, wm, wn) as r from d left join {WHEELS} on wm >= major),
c as (select *, coalesce(b, 'cpu') as q from j where r = 1)
select major || '/' || minor || '/' || driver_major as device, major, minor, driver_major, case when q = 'cu118' and driver_major < 11 then 'cpu' when q = 'cu124' and driver_major < 12 then 'cu118' when q = 'cu126' and driver_major < 12 then 'cu124' else q end as build,
  case when q = 'cu118' and driver_major < 11 then '0' when q = 'cu124' and driver_major < 12 then '11.8' when q = 'cu126' and driver_major < 12 then '12.4' else coalesce(l, '') end as least_driver from c""",
    "parse_devices": "select distinct 'GPU ' || l_suppkey as name, '5' || l_partkey % 50 as driver, case when l_linenumber <> 1 then (l_partkey % 14)::int end as major, case when l_linenumber <> 1 then (l_suppkey % 10)::int end as minor from lineitem",
    "first_cached": f"select book_id as folder, min(name) as name from ({IMAGES}) where name like 'page%.webp' group by book_id",
    "run_events": f"with {EVENTS} select * from numbered",
    "run_result": f"with {EVENTS}, fin as (select * from numbered where phase = 'done' and total % 3 > 0) select b.book_id, fin.total as pages, fin.message from b left join fin using (book_id)",
    "format_event_line": f"select seq, '[' || rpad(upper(phase), 10, ' ') || '] t=' || lpad(printf('%.1f', (seq % 4000)::double), 6, ' ') || 's' || case when total <> 0 and percent <> 0 then ' [' || rpad(repeat('█', round_even(percent / 5, 0)::int), 20, ' ') || '] ' || lpad(printf('%.1f', percent), 5, ' ') || '%' else '' end || ' ' || message as line from ({LOG})",
    "model_status": f"""with f as (select book_id as model, 'shard' || doc_id % 9 as shard, doc_id, page_num from ({PAGES})), i as (select distinct model, shard from f where doc_id % 1000 < 500 and model like 'src1%'),
h as (select distinct model, shard from f where doc_id % 7 > 0 or doc_id % 2 = 0), m as (select distinct model from f), l as (select i.model, count(*) - count(h.shard) as lost from i left join h on h.model = i.model and h.shard = i.shard group by i.model),
c as (select model from f where page_num = 1 and doc_id % 5 > 0), o as (select model from f where page_num = 1 and doc_id % 3 > 0),
x as (select model, case when model not in (select model from c) then 'absent' when lost > 0 then 'incomplete' when lost = 0 or model in (select model from o) then 'ready' else 'absent' end as message from m left join l using (model))
select model, message = 'ready' as ok, message from x""",
    "cut_boxes": f"""with pg as ({PAGES}),{tag_rows('pg')},
bg as (select doc_id, w, h, unnest(regexp_extract_all(raw_text, '{BBOX}')) as tag, unnest(range(1, len(regexp_extract_all(raw_text, '{BBOX}')) + 1)) as i from pg),
u as (select doc_id, w, h, 0 as kind, i, label, x1, y1, x2, y2 from tp union all
  select doc_id, w, h, 1, i, coalesce(regexp_extract(tag, '{BBOX}', 5), ''), regexp_extract(tag, '{BBOX}', 1)::bigint, regexp_extract(tag, '{BBOX}', 2)::bigint, regexp_extract(tag, '{BBOX}', 3)::bigint, regexp_extract(tag, '{BBOX}', 4)::bigint from bg),
v as (select doc_id, label, row_number() over (partition by doc_id order by kind, i) - 1 as pos, {', '.join(f'{x} as b_{k}' for k, x in BOX.items())} from u)
select book_id, page_num::int as page_num, pos, 'page' || lpad(page_num::varchar, 4, '0') || '_bbox' || case when label <> '' then '_' || label else '' end || '.png' as name, {', '.join(f'b_{k} as "{k}"' for k in BOX)} from v join pg using (doc_id) where b_right - b_left >= 32 and b_lower - b_upper >= 32""",
    "book_metadata": f"""with pg as ({PAGES}), g as (select book_id, case when doc_id % 3 = 2 then 'Title ' || doc_id end as title, (doc_id % 9)::int as chapter_pages from pg where page_num = 1 and doc_id % 3 > 0)
select b.book_id, coalesce(title, 'file ' || b.book_id) as title, case when g.book_id is null then 'Unknown' else 'A. Author' end as author, 'it' as language, chapter_pages from (select distinct book_id from pg) b left join g using (book_id)""",
    "carried_state": f"select job_id, max_by(percent, struct_pack(ts := ts, seq := seq)) filter (phase = 'view') as shown, max_by(seq, struct_pack(ts := ts, seq := seq)) filter (phase = 'purchase') as bought from ({LOG}) group by job_id",
    "chapter_title": "select page_id, case when page_id % 4 = 0 then html else regexp_replace(html, '(?s)<h1[^>]*>.*?</h1>', '<h1 class=\"chapter-title\">Page $1 &amp; ' || page_id || '</h1>') end as html from pages",
    "thumbnails_top3": f"select book_id, name, r as rank from (select book_id, name, row_number() over (partition by book_id order by name) as r from ({IMAGES})) where r <= 3",
    "image_semi_join": f"with i as ({IMAGES}) select book_id, name from i where (book_id, name) in (select (book_id, name) from i where doc_id % 2 = 0)",
    "shard_anti_join": f"with i as (select book_id as model, 'shard' || doc_id % 9 as shard, doc_id from ({PAGES})) select model, count(distinct shard) as n_shards, count(distinct case when doc_id % 9 >= 7 then shard end) as n_missing from i group by model",
    "page_box_zip": f"""with pg as ({PAGES}),{tag_rows('pg')},
bg as (select doc_id, page_num, unnest(regexp_extract_all(raw_text, '{BBOX}')) as tag, unnest(range(1, len(regexp_extract_all(raw_text, '{BBOX}')) + 1)) as i from pg),
u as (select doc_id, 0 as kind, i, label from tp union all select doc_id, 1, i, coalesce(regexp_extract(tag, '{BBOX}', 5), '') from bg),
v as (select doc_id, label, row_number() over (partition by doc_id order by kind, i) - 1 as pos from u)
select book_id, page_num::int as page_num, pos, 'page' || page_num || '_' || case when label = '' then 'asset' || lpad(pos::varchar, 2, '0') else label end || '.png' as name from v join pg using (doc_id)""",
    "human_bytes": f"select k, n, {shown('v')} as shown from (select k, n, floor(v / 1024) * 1024 as v from ({AMOUNTS}))",
    "human_speed": f"select k, n, {shown('v', '/s')} as shown from (select k, n, v / 7 as v from ({AMOUNTS}))",
    "download_eta": f"select k, n, d / greatest(e, 0.001::double) as speed, case when t > 0 and d > 0 then (t - d) / (d / greatest(e, 0.001::double)) else 0 end::double as eta from (select k, n, n::double * 64 as d, (k % 9)::double * 1024 as t, (k % 5)::double as e from ({AMOUNTS}))",
    "format_eta": f"select k, n, case when s <= 0 then '—' when s < 60 then s || 's' when s < 3600 then (s // 60) || 'm ' || lpad((s % 60)::varchar, 2, '0') || 's' else (s // 3600) || 'h ' || lpad((s // 60 % 60)::varchar, 2, '0') || 'm' end as shown from (select k, n, ((v::bigint) % 200000) - 100 as s from ({AMOUNTS}))",
    "device_and_window": f"select k, n, case when k % 3 = 0 then 'cpu' when k % 17 >= 8 then 'cuda' else 'cpu' end as device, case when n > 1 then 1024 else 128 end::bigint as ngrams, case when k % 4 = 0 then 0 else n / (k % 4)::double end::double as ratio from ({AMOUNTS})",
    "epub_entries": f"""with {CHAPTERS_OF_BOOK}, cv as (select book_id from pg where page_num = 1 and w % 2 = 0), al as (select distinct book_id from pg)
select book_id, 'OEBPS/chap_' || lpad(pos::varchar, 4, '0') || '.md' as entry_path, null::bigint as n_bytes from ch union all select book_id, 'OEBPS/' || f, null from al, (values ('nav.xhtml'), ('content.opf')) v(f)
union all select book_id, 'OEBPS/images/' || stem || number || '.webp', length(stem || number) + 5 from tn join pg using (doc_id) where label in ('image', 'figure', 'table') and kept
union all select book_id, 'OEBPS/cover.xhtml', null from cv union all select book_id, 'OEBPS/images/cover.webp', length(book_id) from cv""",
    "book_toc": f"with {CHAPTERS_OF_BOOK}" + " select book_id, pos::bigint as chapter_no, 'chap_' || lpad(pos::varchar, 4, '0') || '.xhtml' as filename, case when title = '' then 'Pagina ' || (pos + 1) else title end as title, length(body) as n_chars from ch",
}
