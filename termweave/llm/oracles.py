"""SQL that states the results of operators by exhaustive comparison."""

OP5_SQL = r"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents
), s as (
  select distinct doc_id, unnest(case when len(ws) >= 4 then list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i : i + 3], ' ')) when len(ws) > 0 then [array_to_string(ws, ' ')] end) as shingle from w
), n as (
  select w.doc_id, count(shingle) as n from w left join s using (doc_id) group by all
), shared as (
  select a.doc_id as u, b.doc_id as v, count(*) as k from s a join s b on a.shingle = b.shingle and a.doc_id <> b.doc_id group by all
), link as (
  select u, v from shared join n a on a.doc_id = u join n b on b.doc_id = v where 100 * k >= 80 * (a.n + b.n - k)
), reach as (
  select doc_id, doc_id as other from documents union select reach.doc_id, link.v from reach join link on link.u = reach.other
)
select n.doc_id, n.n as n_shingles, min(other) as component_id, n.doc_id = min(other) as kept from n join reach using (doc_id) group by n.doc_id, n.n
"""

#: Every alignment that could be accepted: of a stretch of ``compared`` words with at most ``wrong`` differences, some
#: q words in a row agree, q being the matching words over the number of runs that the differences leave, rounded up.
OP7_SQL = r"""
with w as (
  select doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') as ws from documents
), t as (
  select item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') as ws from benchmark
), c as (
  select item_id, ws, least(13, len(ws)) as compared, least(13, len(ws)) * 20 // 100 as wrong from t where len(ws) >= 5
), ts as (
  select item_id, unnest(range(0, len(ws) - q + 1)) as place, q, ws from (select *, ((compared - wrong + wrong) // (wrong + 1))::bigint as q from c)
), td as (
  select item_id, place, q, array_to_string(ws[place + 1 : place + q], ' ') as seed from ts
), ds as (
  select doc_id, q, i, array_to_string(ws[i + 1 : i + q], ' ') as seed from (select doc_id, ws, q, unnest(range(0, len(ws) - q + 1)) as i from w, (select distinct q from td) where len(ws) >= q)
), lain as (
  select distinct doc_id, item_id, i - place as doc_word from ds join td using (q, seed)
), same as (
  select doc_id, item_id, doc_word, least(13, len(t.ws)) as compared,
    list_transform(range(greatest(0, -doc_word), least(len(t.ws), len(w.ws) - doc_word)), lambda p: case when w.ws[p + doc_word + 1] = t.ws[p + 1] then 1 else 0 end) as eq
  from lain join w using (doc_id) join t using (item_id)
), best as (
  select *, list_max(list_transform(range(1, len(eq) - compared + 2), lambda i: list_sum(eq[i : i + compared - 1]))) as matched from same where len(eq) >= compared
)
select doc_id, item_id, arg_max(doc_word, (matched, -doc_word))::int as doc_word, max(matched)::int as matched, any_value(compared)::int as compared
from best where matched * 100 >= compared * 80 group by doc_id, item_id
"""
