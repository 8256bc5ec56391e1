"""SQL of the queries that SQL can express, for DuckDB."""

OP10 = """
with lines as (
  select doc_id, text, hash(text) as h, string_split(text, chr(10)) as l from documents where text is not null
), windows as (
  select doc_id, text, l[i] || chr(10) || l[i + 1] || chr(10) || l[i + 2] as w, i
  from (select *, unnest(range(1, len(l) - 1)) as i from lines where len(l) >= 3)
), firsts as (
  select w, min(struct_pack(d := doc_id, i := i)) as f from windows group by w
), gone as (
  select distinct doc_id, text, unnest([i, i + 1, i + 2]) as i
  from windows join firsts using (w) where struct_pack(d := doc_id, i := windows.i) <> f
), each as (
  select doc_id, text, l[i] as line, i from (select *, unnest(range(1, len(l) + 1)) as i from lines)
), kept as (
  select each.doc_id, each.text, string_agg(line, chr(10) order by each.i) filter (where gone.i is null) as rest,
         count(*) as n, count(gone.i) as g
  from each left join gone on each.doc_id = gone.doc_id and each.text = gone.text and each.i = gone.i
  group by each.doc_id, each.text
)
select d.doc_id, case when d.text is null then null else coalesce(rest, '') end as text,
       coalesce(n, 0) as n_lines, coalesce(g, 0) as n_removed
from documents d left join kept on d.doc_id = kept.doc_id and d.text = kept.text
"""

OP11 = """
with digests as (
  select doc_id, coalesce(text, '') as text, sha256('1:' || coalesce(doc_id::varchar, '')) as d from documents
), drawn as (
  select doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') as u,
         ('0x' || d[1:8])::bigint as h1, ('0x' || d[9:16])::bigint as h2,
         ('0x' || d[17:24])::bigint as h3, ('0x' || d[25:32])::bigint as h4
  from digests
), cut as (
  select *, len(u) as n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) as a,
         greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) as b,
         case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 90
              then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form
  from drawn
), pieces as (
  select *, array_to_string(u[1:a], '') as p, array_to_string(u[a + 1:b], '') as m, array_to_string(u[b + 1:], '') as s
  from cut
)
select doc_id, n, form, case when form <> 'plain' then length(p) end as prefix_chars,
       case when form <> 'plain' then length(m) end as middle_chars,
       sha256(case form when 'plain' then text when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m
              else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
       sha256(text) as restored_sha256
from pieces
"""

ORACLES = {"op10_line_dedup": OP10, "op11_fill_in_middle": OP11}
