"""DuckDB definitions of the fixture views, prepended as CTEs to oracle SQL.

The oracle runs with only the base tables registered, so every oracle query
carries the fixture views it reads as ``WITH`` clauses.
"""

from __future__ import annotations

import re

FX = {
    "fx_corpus": "select cast(doc_id as varchar) as _id, split_part(text, chr(10), 1) as title, text, lang, source from documents",
    "fx_queries": "select cast(item_id as varchar) as _id, text from benchmark",
    "fx_qrels": ("select b.item_id as query_id, d.doc_id as corpus_id, 1 as score from benchmark b join documents d on contains(d.text, b.text) "
                 "union all select item_id, item_id, 0 from benchmark "
                 "union all select item_id, 100000000 + item_id, 1 from benchmark where item_id % 5 = 0"),
    "fx_pairs": ("select conv_id, turn, text as query, nxt as positive from (select conv_id, turn, role, text, lead(text) over w as nxt, "
                 "lead(role) over w as nrole from conversations window w as (partition by conv_id order by turn)) "
                 "where role='user' and nrole='assistant'"),
    "fx_labelled": ("select d.doc_id, case when d.doc_id % 3 = 0 then 'test' else 'train' end as split, d.text, "
                    "(case when quality=1 then 'good' else 'poor' end) || '_' || (case when toxic=1 then 'toxic' else 'clean' end) as label_text, "
                    "quality*2+toxic as label from documents d join labels l using (doc_id)"),
    "fx_grouped": "select doc_id, text, lang || '.' || source || ' ' || lang || '.x' as categories, source as category from documents",
    "fx_examples": ("select doc_id as row_id, lang as dataset, source as cluster, string_split(text, chr(10))[1] as query, "
                    "list_filter(string_split(text, chr(10)), lambda x, i: i % 2 = 0) as positive, "
                    "list_filter(string_split(text, chr(10)), lambda x, i: i > 1 and i % 2 = 1) as negative from documents"),
    "fx_vectors": "select vec_id, embedding, label as cluster from embeddings",
    "fx_vec_queries": ("select e.vec_id, e.label as cluster, coalesce(list_sort(list(p.vec_id) filter (where p.vec_id is not null))[1:2], []) as positive_ids "
                       "from embeddings e left join embeddings p on p.label = e.label and p.vec_id > e.vec_id and p.vec_id <= e.vec_id + 30 "
                       "group by e.vec_id, e.label"),
    "fx_token_vectors": ("select vec_id // 32 as doc, vec_id % 32 as pos, "
                         "case when vec_id % 4 = 0 then 0 else 1 end as mask, embedding from embeddings"),
    "fx_sts": ("select a.vec_id as id, a.embedding as e1, b.embedding as e2, case when a.label=b.label then 5.0 - a.vec_id % 3 "
               "else (a.vec_id % 3) * 1.0 end as gold from embeddings a join embeddings b on b.vec_id = a.vec_id + 1"),
    "fx_bitext": "select a.item_id, a.text as t1, b.text as t2 from benchmark a join benchmark b on b.item_id = a.item_id + 1",
    "fx_parallel": "select conv_id, list(text order by turn) as sentences, list(role order by turn) as labels from conversations group by conv_id",
    "fx_scores": ("select d.lang, d.lang || cast(d.doc_id % 2 as varchar) as code, d.source as dataset, avg(l.quality) as score "
                  "from documents d join labels l using (doc_id) group by all"),
    "fx_eval_steps": ("select cast(date_diff('day', timestamp '2024-01-01', ts) as int) as step, event_type as metric, avg(value) as score "
                      "from events group by all"),
}

_NAME = re.compile(r"\bfx_[a-z_]+\b")


def with_fx(sql: str) -> str:
    """Prefix ``sql`` with the CTEs of every fixture view it names.

    If ``sql`` starts with its own ``WITH`` the fixture CTEs are merged in
    front of it."""
    names = sorted(set(_NAME.findall(sql)))
    unknown = [n for n in names if n not in FX]
    if unknown:
        raise KeyError(unknown)
    if not names:
        return sql
    ctes = ",\n".join(f"{n} as ({FX[n]})" for n in names)
    body = sql.lstrip()
    if body[:5].lower() == "with ":
        rest = body[5:]
        if rest[:10].lower().startswith("recursive "):
            return f"with recursive {ctes},\n{rest[10:]}"
        return f"with {ctes},\n{rest}"
    return f"with {ctes}\n{body}"
