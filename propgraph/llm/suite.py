"""The operators' registered queries and their oracle SQL."""

from __future__ import annotations

from .langid import op10_language_id
from .fingerprints import op8_fingerprints
from .jaccard import op5_ngram_jaccard
from .licenses import op7_license_scan
from .mixing import op1_mixing
from .ngram_lm import op6_ngram_lm
from .packing import op9_packing
from .quality import op4_quality_rules
from .sharding import op2_sharding
from .warc import op3_warc


def queries() -> dict:
    return {f.__name__: f for f in (op1_mixing, op2_sharding, op3_warc, op4_quality_rules, op5_ngram_jaccard, op6_ngram_lm, op7_license_scan, op8_fingerprints, op9_packing, op10_language_id)}


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP3 = """
with p as (select page_id, coalesce(html, '') as body, octet_length(encode(coalesce(html, '')))::bigint as payload_bytes from pages),
    f as (select *, min(page_id) over (partition by body) as first from p),
    r as (select *, payload_bytes >= 100 and page_id <> first as again from f)
select page_id, payload_bytes, sha256(body) as payload_digest, case when again then 'revisit' else 'response' end as record_type,
    case when again then first end as refers_to, true as has_request, true as has_metadata from r
"""

# all shingles, all links, and from each document the ones that it reaches
_OP5 = rf"""
with recursive w as (select doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') as w from documents),
    k as (select doc_id, w, least(5, len(w)) as k from w),
    s as (select distinct doc_id, list_slice(w, i, i + k - 1) as s from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as i from k where len(w) > 0)),
    n as (select doc_id, count(*) as n from s group by doc_id),
    c as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
    l as (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)),
    r(a, b) as (select doc_id, doc_id from documents union select r.a, l.b from r join l on l.a = r.b)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, m.component_id from documents d left join n using (doc_id)
    join (select a as doc_id, min(b) as component_id from r group by a) m using (doc_id)
"""


def oracle_sql() -> dict:
    """SQL for the whole results that SQL can express; the other queries are tested against brute force."""
    return {"op3_warc": _OP3, "op5_ngram_jaccard": _OP5}
