"""Queries of the corpus operators as DuckDB SQL over whole tables, where SQL can express them."""

#: Words in windows of 50; a word goes if a window over it starts in a document of a smaller id too.
SUBSTRING = r"""
with d as (select row_number() over () as rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
windows as (select rid, doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) as h from (select rid, doc_id, w, unnest(generate_series(1, len(w) - 49)) as i from d)),
earliest as (select h, min(doc_id) as low from windows group by h),
hits as (select rid, i from windows join earliest using (h) where doc_id > low),
words as (select rid, unnest(generate_series(1, len(w))) as p, unnest(w) as word from d),
marked as (select words.rid, p, word, coalesce(max(i) over (partition by words.rid order by p) >= p - 49, false) as gone from words left join hits on hits.rid = words.rid and hits.i = p),
kept as (select rid, count(*) filter (where gone) as n_removed, string_agg(word, ' ' order by p) filter (where not gone) as text from marked group by rid)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_removed, 0) as bigint) as n_removed, sha256(coalesce(text, '')) as kept_sha256 from d left join kept using (rid)
"""

#: Bytes in strings of 400; a byte goes if a string over it starts anywhere else too.
BYTES = r"""
with d as (select row_number() over () as rid, doc_id, encode(coalesce(text, '')) as b from documents),
windows as (select rid, i, md5(b[i:i + 399]) as h from (select rid, b, unnest(generate_series(1, octet_length(b) - 399)) as i from d)),
many as (select h from windows group by h having count(*) > 1),
hits as (select rid, i from windows semi join many using (h)),
steps as (select rid, i, coalesce(i > lag(i) over (partition by rid order by i) + 400, true) as fresh from hits),
numbered as (select rid, i, sum(case when fresh then 1 else 0 end) over (partition by rid order by i) as run from steps),
runs as (select rid, min(i) as a, max(i) + 399 as z from numbered group by rid, run),
gaps as (select rid, a, z, coalesce(lag(z) over (partition by rid order by a), 0) + 1 as s from runs),
kept as (select rid, sum(z - a + 1) as n_removed, count(*) as n_spans, max(z) as z, list_reduce(list(b[s:a - 1] order by s), lambda x, y: x || y) as head from gaps join d using (rid) group by rid)
select doc_id, cast(octet_length(b) as bigint) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, cast(coalesce(n_spans, 0) as bigint) as n_spans, sha256(case when z is null then b else head || b[z + 1:octet_length(b)] end) as kept_sha256 from d left join kept using (rid)
"""
