"""DuckDB SQL for the queries of this subpackage that SQL can express."""

_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES = {
    "op1_decontamination": f"""
with d as (select doc_id, coalesce({_WORDS}, []) w from documents),
b as (select item_id, {_WORDS} w from benchmark where text is not null and item_id is not null),
win as (select distinct item_id::varchar item_id, list_slice(w, i, i + 9) g from (select *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) i from b where len(w) > 0)),
sizes as (select distinct len(g) k from win),
grams as (select doc_id, i, k, list_slice(w, i, i + k - 1) g from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) i from d, sizes where len(w) >= k)),
hits as (select doc_id, i, k, item_id from grams join win using (g)),
marked as (select doc_id, count(distinct p) n from (select doc_id, unnest(range(i, i + k)) p from hits) group by 1),
items as (select doc_id, count(distinct item_id) n, string_agg(distinct item_id, ',' order by item_id) s from hits group by 1)
select d.doc_id, len(w)::bigint n_words, coalesce(marked.n, 0)::bigint n_hit, coalesce(items.n, 0)::bigint n_items,
       sha256(coalesce(s, '')) items_sha256, coalesce(marked.n, 0) > 0 contaminated
from d left join marked using (doc_id) left join items using (doc_id)""",
    "op5_top_k": """
with v as (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) v from embeddings
           where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as (select q.vec_id query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::bigint score
      from v q, v c where q.vec_id % 100 = 0 and c.vec_id <> q.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::integer rank from s)
select query_id, rank, vec_id, score from r where rank <= 10""",
    "op10_jaccard_join": r"""
with recursive d as (select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) w from documents),
s as (select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
      else list_transform(range(1, len(w) - 2), lambda i: array_to_string(list_slice(w, i, i + 3), ' ')) end) g from d),
e as (select doc_id, len(g) n, unnest(g) x from s),
pairs as (select a.doc_id a, b.doc_id b, count(*) c, any_value(a.n) + any_value(b.n) n from e a join e b using (x) where a.doc_id < b.doc_id group by 1, 2),
links as (select a, b from pairs where 100 * c >= 85 * (n - c)),
both_ways as (select a, b from links union all select b, a from links),
reach as (select a as doc_id, b as other from both_ways union select r.doc_id, t.b from reach r join both_ways t on r.other = t.a),
least_of as (select doc_id, least(doc_id, min(other)) c from reach group by doc_id)
select doc_id, len(g)::bigint n_shingles, coalesce(c, doc_id)::bigint component_id from s left join least_of using (doc_id)""",
}
