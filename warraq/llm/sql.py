"""DuckDB SQL for the operators that SQL can express."""

#: Base-32 digits of a hexadecimal SHA-1, five bits at a time.
_BASE32 = "(select string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((('0x' || substr({h}, 1 + 10 * (i // 8), 10))::bigint >> (35 - 5 * (i % 8))) & 31))::int, 1), '' order by i) from range(32) t(i))"

OP1 = r"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'
), escaped as (
  select *, replace(replace(replace(replace(role || chr(1) || text, '\', '\\'), '<turn>', '<\turn>'), '</turn>', '<\/turn>'), '</role>', '<\/role>') as both_escaped from turns
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  sum(length(both_escaped) - 1 + length('<turn></role></turn>') + 1)::bigint as formatted_chars
from escaped group by conv_id
"""

OP3 = f"""
with p as (
  select page_id, sha1(coalesce(html, '')) as h, strlen(coalesce(html, ''))::bigint as payload_bytes from pages
), g as (
  select *, max(page_id) over (partition by h, payload_bytes) as response from p
)
select page_id, payload_bytes, {_BASE32.format(h="h")} as payload_digest,
  case when page_id is distinct from response then 'revisit' else 'response' end as record_type,
  case when page_id is distinct from response then response end as refers_to
from g
"""

OP8 = """
with recursive v as (
  select vec_id, label, embedding::double[] as e from embeddings
  where label is not null and embedding is not null and vec_id is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
), link as (
  select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_cosine_similarity(a.e, b.e) >= 0.93
), reach(a, b) as (
  select vec_id, vec_id from v union select r.a, l.b from reach r join link l on r.b = l.a
), least as (select a, min(b) as component_id from reach group by a), degree as (select a, count(*) as n from link group by a)
select vec_id, coalesce(n, 0)::bigint as n_links, coalesce(component_id, vec_id) as component_id, coalesce(component_id, vec_id) = vec_id as kept
from embeddings left join least on least.a = vec_id left join degree on degree.a = vec_id
"""

OP7 = r"""
with recursive w as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words from documents
), s as (
  select doc_id, case when len(words) = 0 then [] when len(words) < 5 then [list_aggregate(words, 'string_agg', ' ')]
    else list_distinct(list_transform(range(1, len(words) - 3), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] || ' ' || words[i + 3] || ' ' || words[i + 4])) end as shingles from w
), e as (select doc_id, len(shingles) as n, hash(unnest(shingles)) as h from s
), pair as (
  select a.doc_id as a, b.doc_id as b from e a join e b on a.h = b.h and a.doc_id < b.doc_id and 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n)
  group by a.doc_id, b.doc_id, a.n, b.n having 175 * count(*) >= 75 * (a.n + b.n)
), link as (select a, b from pair union all select b, a from pair
), reach(a, b) as (select doc_id, doc_id from documents union select r.a, l.b from reach r join link l on r.b = l.a
), least as (select a, min(b) as component_id from reach group by a
), degree as (select a, count(*) as n_links from link group by a)
select doc_id, len(shingles)::bigint as n_shingles, coalesce(n_links, 0)::bigint as n_links, component_id from s join least on least.a = doc_id left join degree on degree.a = doc_id
"""
