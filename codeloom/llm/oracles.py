"""DuckDB counterparts of the queries that SQL can express."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = r"[^\x20\x09-\x0D]+"
_TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_BENCH_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

WARC = """
with p as (
    select page_id, coalesce(html, '') as body, max(page_id) over (partition by coalesce(html, '')) as top,
        sha1(coalesce(html, '')) as hex
    from pages
), d as (
    select *, list_transform(range(0, 8), lambda i: ('0x' || substr(hex, (5 * i + 1)::int, 5))::int) as twenty from p
)
select page_id, strlen(body)::bigint as payload_bytes,
    array_to_string(list_transform(flatten(list_transform(twenty, lambda x: [x >> 15, (x >> 10) & 31, (x >> 5) & 31, x & 31])),
        lambda v: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v + 1)::int, 1)), '') as payload_digest,
    case when page_id = top then 'response' else 'revisit' end as record_type,
    case when page_id = top then null else top end as refers_to
from d
"""

DECONTAMINATE = f"""
with d as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_BENCH_WORDS}') as w from documents
), i as (
    select item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_BENCH_WORDS}') as w from benchmark
), iw as (
    select distinct item_id, least(10, len(w)) as k, array_to_string(w[p:p + least(10, len(w)) - 1], ' ') as window_text
    from (select *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as p from i where len(w) > 0)
), dw as (
    select doc_id, p, k, array_to_string(w[p:p + k - 1], ' ') as window_text
    from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as p from d, (select distinct k from iw) where len(w) >= k)
), hits as (
    select doc_id, item_id, p, k from dw join iw using (k, window_text)
), words as (
    select doc_id, count(distinct q)::bigint as n_hit from (select doc_id, unnest(range(p, p + k)) as q from hits) group by 1
), items as (
    select doc_id, count(*)::bigint as n_items, string_agg(id, ',' order by id) as ids
    from (select distinct doc_id, item_id::varchar as id from hits) group by 1
)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
    sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join words using (doc_id) left join items using (doc_id)
"""

JACCARD = f"""
with recursive d as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORDS}') as w from documents
), s as (
    select distinct doc_id, array_to_string(w[p:p + least(3, len(w)) - 1], ' ') as f
    from (select *, unnest(range(1, greatest(len(w) - 2, 1) + 1)) as p from d where len(w) > 0)
), n as (
    select doc_id, count(*)::bigint as n from s group by 1
), links as (
    select a, b from (select x.doc_id as a, y.doc_id as b, count(*) as c from s x join s y on x.f = y.f and x.doc_id <> y.doc_id group by 1, 2)
    join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * c >= 90 * (na.n + nb.n - c)
), reach as (
    select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a
)
select doc_id, coalesce(n.n, 0) as n_shingles, least(doc_id, coalesce(m, doc_id)) as component_id
from d left join n using (doc_id) left join (select a as doc_id, min(b) as m from reach group by 1) using (doc_id)
"""

SUBSTRINGS = f"""
with d as (
    select doc_id, regexp_extract_all(coalesce(text, ''), '{_WORDS}') as w from documents
), v as (
    select doc_id, p, array_to_string(w[p:p + 49], ' ') as t
    from (select *, unnest(range(1, len(w) - 48)) as p from d where len(w) >= 50)
), m as (
    select t, min(doc_id) as least_id from v group by 1
), gone as (
    select distinct doc_id, unnest(range(p, p + 50)) as q from v join m using (t) where doc_id > least_id
), words as (
    select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as q from d
), kept as (
    select doc_id, count(*) as n, string_agg(word, ' ' order by q) as t from words anti join gone using (doc_id, q) group by 1
)
select doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256
from d left join kept using (doc_id)
"""

LEXICAL = f"""
with d as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_TERMS}') as w from documents
), facts as (
    select count(*) filter (len(w) > 0)::bigint as nd, sum(len(w))::bigint as nt from d
), tf as (
    select doc_id, term, count(*)::bigint as tf from (select doc_id, unnest(w) as term from d) group by 1, 2
), weights as (
    select term, floor(1000 * ln((2 * nd + 2) / (2 * count(*) + 1)))::bigint as w from tf, facts group by term, nd
), asked as (
    select item_id, term, count(*)::bigint as times from (
        select item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_TERMS}')) as term from benchmark
    ) group by 1, 2
), m as (
    select doc_id, 75 + (25 * len(w)::bigint * nd) // nt as m from d, facts where len(w) > 0
), scored as (
    select item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::bigint as score
    from asked join tf using (term) join weights using (term) join m using (doc_id) group by 1, 2
)
select item_id, rank::int as rank, doc_id, score
from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scored where score > 0)
where rank <= 20
"""

HARD_NEGATIVES = """
with v as (
    select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
        list_transform(embedding, lambda x: floor(256 * x::double)) as v
    from embeddings
    where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
    select a.vec_id as anchor_id, a.label = v.label as same, v.vec_id as id, list_inner_product(a.v, v.v)::bigint as score
    from v a, v where a.vec_id % 100 = 0 and v.vec_id <> a.vec_id
), p as (
    select anchor_id, id as positive_id, score as positive_score
    from (select *, row_number() over (partition by anchor_id order by score desc, id) as n from s where same) where n <= 5
), n as (
    select anchor_id, positive_id, positive_score, id as negative_id, score as negative_score,
        row_number() over (partition by anchor_id, positive_id order by score desc, id) as rank
    from p join s using (anchor_id) where not same and 80 * positive_score <= 100 * score and score <= positive_score
)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from n where rank <= 5
"""
