"""Registered queries: evaluation roll-ups, lookups and alignment routing
(R1-R8, J4, J9, J10, L1-L4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import alignment as AL
from tessera.operators import batching as BT
from tessera.operators import joins as J
from tessera.operators import rollups as R
from tessera.plans import registry as REG
from tessera.plans.catalog import joined, r6, register
from tessera.session import scratch_path
from tessera.sources import catalogue as CT
from tessera.sources import tables as T

MD5U = "((('0x' || substr(md5(concat_ws(':', {parts})), 1, 8))::UBIGINT) / 4294967296.0)"


def _values(rows, cols):
    def lit(v):
        if v is None:
            return "null"
        if isinstance(v, bool):
            return "true" if v else "false"
        if isinstance(v, (int, float)):
            return repr(v)
        return "'" + str(v).replace("'", "''") + "'"
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"(select * from (values {body}) t({', '.join(cols)}))"


def _task_of(ds_col):
    """Fixture rule: a dataset 'srcN' belongs to task type N mod 7."""
    idx = F.pmod(F.regexp_extract(ds_col, r"(\d+)$", 1).cast("int"), F.lit(7)) + 1
    return F.element_at(F.array(*[F.lit(t) for t in REG.TASK_TYPES]), idx)


TASK_SQL = "([" + ", ".join(f"'{t}'" for t in REG.TASK_TYPES) + "])[(cast(regexp_extract({c}, '(\\d+)$', 1) as int) % 7) + 1]"
CELLS_SQL = "cells as (select lang, dataset, avg(score) as score from fx_scores group by lang, dataset)"


def _cells(spark, d):
    return R.dataset_language_score(T.fx_scores(spark, d))


@register("pick_eval_split", f"""
with a as (select distinct d.source as dataset,
                  (['test', 'test.full', 'test_expert', 'validation', 'dev', 'train'])[(d.doc_id % 6) + 1] as split
           from documents d join labels l using (doc_id)),
p as (select dataset, split, list_position(['test', 'test.full', 'test_expert', 'validation', 'dev', 'train'], split) as pr from a)
select dataset, arg_min(split, pr) as split from p group by dataset
""")
def pick_eval_split(spark, d):
    docs = T.table(spark, d, "documents").join(T.table(spark, d, "labels"), "doc_id")
    pr = F.array(*[F.lit(s) for s in REG.SPLIT_PRIORITY])
    a = docs.select(F.col("source").alias("dataset"),
                    F.element_at(pr, (F.col("doc_id") % 6 + 1).cast("int")).alias("split")).distinct()
    return R.pick_eval_split(a, REG.SPLIT_PRIORITY)


@register("dataset_language_score", "with " + CELLS_SQL + " select lang, dataset, round(score, 6) as score from cells")
def dataset_language_score(spark, d):
    return _cells(spark, d).select("lang", "dataset", r6("score"))


@register("task_average", "with " + CELLS_SQL + f"""
select {TASK_SQL.format(c='dataset')} as task, round(avg(score), 6) as score, count(*) as n_datasets
from cells where lang = 'en' group by 1
""")
def task_average(spark, d):
    c = _cells(spark, d).where(F.col("lang") == "en").withColumn("task", _task_of(F.col("dataset")))
    return R.task_average(c).select("task", r6("score"), "n_datasets")


@register("language_rollup", "with " + CELLS_SQL + """
select lang, round(avg(score), 6) as score, count(*) as n_cells from cells group by lang
union all select 'avg', round(avg(score), 6), count(*) from cells
""")
def language_rollup(spark, d):
    return R.language_rollup(_cells(spark, d)).select("lang", r6("score"), "n_cells")


QUICK = ["src0", "src3", "src7", "src11", "src19"]


@register("quick_subset", "with " + CELLS_SQL + f"""
select lang, dataset, round(score, 6) as score from cells where dataset in ({", ".join(repr(q) for q in QUICK)})
""")
def quick_subset(spark, d):
    q = spark.createDataFrame([(x,) for x in QUICK], "dataset string")
    return R.quick_subset(_cells(spark, d), q).select("lang", "dataset", r6("score"))


def _sheet(spark, cells):
    """Fixture sheet: datasets src0..src19 in numeric order for each language;
    German lists 'src5.v2'-style names resolved by the '.v2' fallback.  Other
    languages and sources that have scores are added, English with all of them;
    the position is the number of the source, null if it has none."""
    rows = [(lang, f"src{i}") for lang in ("de", "en", "es", "fr") for i in range(20)]
    own = cells.select("lang", F.regexp_replace("dataset", r"\.v2$", "").alias("dataset"))
    sheet = spark.createDataFrame(rows, "lang string, dataset string").union(own).union(own.select(F.lit("en"), "dataset"))
    pos = F.expr(r"try_cast(regexp_extract(dataset, '^src(\\d+)$', 1) as int)")
    return sheet.distinct().select("lang", pos.alias("pos"), "dataset")


@register("score_sheet", "with " + CELLS_SQL + """,
sheet as (select lang, i as pos, 'src' || i as dataset from (select unnest(['de', 'en', 'es', 'fr']) as lang), range(0, 20) t(i)),
c2 as (select lang, substr(dataset, 1, length(dataset) - 3) as dataset, score as s2 from cells where dataset like '%.v2'),
j as (select sheet.*, c.score as s1, c2.s2 from sheet left join cells c using (lang, dataset) left join c2 using (lang, dataset)),
s as (select lang, pos, dataset, coalesce(s1, case when lang in ('de', 'fr', 'ja', 'ar') then s2 end) as s from j)
select lang, cast(pos as int) as pos, dataset, round(case when s is null and lang = 'en' then 0.0 else s * 100.0 end, 6) as score
from s where s is not null or lang = 'en'
""")
def score_sheet(spark, d):
    cells = _cells(spark, d)
    return R.score_sheet(_sheet(spark, cells), cells).select("lang", "pos", "dataset", r6("score"))


@register("crosslingual_average", "with " + CELLS_SQL + """
select dataset, round(avg(case when score is not null and not isnan(score) then score end), 6) as score,
       cast(sum(case when score is not null and not isnan(score) then 1 else 0 end) as bigint) as n_langs
from cells group by dataset
""")
def crosslingual_average(spark, d):
    return R.crosslingual_average(_cells(spark, d)).select("dataset", r6("score"), F.col("n_langs").cast("bigint"))


@register("best_checkpoint", """
with r as (select *, max(score) over (partition by metric order by step rows between unbounded preceding and 1 preceding) as prev from fx_eval_steps),
b as (select metric, max(score) as best_score from fx_eval_steps group by metric)
select b.metric, round(b.best_score, 6) as best_score,
       min(case when s.score = b.best_score then s.step end) as best_step_strict,
       max(case when s.score = b.best_score then s.step end) as best_step_ge,
       (select cast(sum(case when prev is null or r.score > prev then 1 else 0 end) as bigint) from r where r.metric = b.metric) as n_improvements_strict,
       (select cast(sum(case when prev is null or r.score >= prev then 1 else 0 end) as bigint) from r where r.metric = b.metric) as n_improvements_ge
from b join fx_eval_steps s using (metric) group by b.metric, b.best_score
""")
def best_checkpoint(spark, d):
    b = R.best_checkpoint(T.fx_eval_steps(spark, d))
    return b.select("metric", r6("best_score"), "best_step_strict", "best_step_ge",
                    *[F.col(c).cast("bigint") for c in ("n_improvements_strict", "n_improvements_ge")])


@register("lang_code_join", "with " + CELLS_SQL + ", codes as " + _values(
    [(lang, c) for lang, cs in REG.LANG_TO_CODES.items() for c in cs], ["lang", "code"]) + """
select cells.lang, codes.code, cells.dataset, round(cells.score, 6) as score from cells join codes using (lang)
""")
def lang_code_join(spark, d):
    j = J.lang_code_join(_cells(spark, d), REG.lang_codes(spark))
    return j.select("lang", "code", "dataset", r6("score"))


def _instr_tables(spark):
    flat = [(f"src{i}", f"Instruction for task {REG.TASK_TYPES[i % 7]}.") for i in range(0, 20, 2)]
    per = [(lang, f"src{i}", f"{lang} instruction {i}.") for lang in ("de", "en", "fr") for i in range(0, 20, 3)]
    return flat, per


@register("task_instruction_lookup", "with " + CELLS_SQL + ", flat as " + _values(_instr_tables(None)[0], ["dataset", "fi"])
          + ", per as " + _values(_instr_tables(None)[1], ["lang", "dataset", "pi"]) + """
select c.lang, c.dataset, case when c.lang = 'en' then coalesce(flat.fi, per.pi) else per.pi end as instruction
from cells c left join flat using (dataset) left join per using (lang, dataset)
where (case when c.lang = 'en' then coalesce(flat.fi, per.pi) else per.pi end) is not null
""")
def task_instruction_lookup(spark, d):
    flat, per = _instr_tables(spark)
    f = spark.createDataFrame(flat, "dataset string, instruction string")
    p = spark.createDataFrame(per, "lang string, dataset string, instruction string")
    return R.task_instruction_lookup(_cells(spark, d), f, p)


# stand-in catalogue from the documents: an entry per language and source but
# every third, for all languages every second source, some twice or empty
_CATALOGUE_SQL = """src as (select distinct lang, source, cast(substr(source, 4) as int) as i from documents),
entries as (select lang, source as dataset, 'In ' || lang || ', find texts of ' || source || '.' as instruction from src where i % 3 <> 0
  union all select lang, source, 'Find ' || lang || ' ' || source || '.' from src where i % 8 = 1
  union all select '*', source, case when i % 5 <> 0 then 'Find texts of ' || source || '.' else ' ' end
  from (select distinct source, i from src) where i % 2 = 0),
one as (select lang, dataset, min(instruction) as instruction from entries where trim(instruction) <> '' group by lang, dataset)"""


def _catalogue_file(spark, d):
    src = T.table(spark, d, "documents").select("lang", F.col("source").alias("dataset"), F.substring("source", 4, 9).cast("int").alias("i")).distinct()
    own = src.where("i % 3 <> 0").select("lang", "dataset", F.expr("concat('In ', lang, ', find texts of ', dataset, '.')").alias("instruction"))
    again = src.where("i % 8 = 1").select("lang", "dataset", F.expr("concat('Find ', lang, ' ', dataset, '.')").alias("instruction"))
    everyone = src.select("dataset", "i").distinct().where("i % 2 = 0").select(
        F.lit(CT.ANY).alias("lang"), "dataset", F.expr("case when i % 5 <> 0 then concat('Find texts of ', dataset, '.') else ' ' end").alias("instruction"))
    path = scratch_path(spark, "catalogue")
    for rows in (own, again, everyone):
        tasks = rows.groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("dataset", F.struct(
            "instruction", F.lit("Retrieval").alias("task_type"))))).alias("tasks"))
        tasks.select(F.to_json(F.create_map("lang", "tasks"))).write.mode("append").text(path)
    return path


@register("catalogue_lookup", "with " + CELLS_SQL + ", " + _CATALOGUE_SQL + """
select c.lang, c.dataset, coalesce(a.instruction, b.instruction) as instruction,
       case when coalesce(a.instruction, b.instruction) is not null then 'Retrieval' end as task_type, coalesce(a.lang, b.lang) as found_in
from cells c left join one a on a.lang = c.lang and a.dataset = c.dataset left join one b on b.lang = '*' and b.dataset = c.dataset
""")
def catalogue_lookup(spark, d):
    """Instructions from catalogue files: a cell's language, then the entries for all."""
    entries, _ = CT.scan_catalogue(spark, _catalogue_file(spark, d))
    return CT.catalogue_lookup(_cells(spark, d).select("lang", "dataset"), entries)


@register("catalogue_problems", "with " + CELLS_SQL + ", " + _CATALOGUE_SQL + ", known as " + _values(
    [(lang,) for lang in REG.LANG_TO_CODES if lang != "fr"], ["lang"]) + """
select 'duplicate' as kind, lang, dataset, count(*) as n from entries group by lang, dataset having count(*) > 1
union all select 'unknown language', lang, null, count(*) from entries where lang <> '*' and lang not in (select lang from known) group by lang
union all select 'no instruction', lang, dataset, count(*) from entries where trim(instruction) = '' group by lang, dataset
union all select 'not found', c.lang, c.dataset, count(*) from cells c
where not exists (select 1 from one where one.dataset = c.dataset and one.lang in (c.lang, '*')) group by c.lang, c.dataset
""")
def catalogue_problems(spark, d):
    """What is wrong with the catalogue files, for a user without French."""
    entries, _ = CT.scan_catalogue(spark, _catalogue_file(spark, d))
    known = REG.lang_codes(spark).where(F.col("lang") != "fr").select("lang").distinct()
    return CT.catalogue_problems(entries, known, _cells(spark, d).select("lang", "dataset"))


# fixed values: short language code -> script-qualified code
SCRIPT_CODES = [("de", "deu_Latn"), ("en", "eng_Latn"), ("es", "spa_Latn"), ("fr", "fra_Latn"), ("ru", "rus_Cyrl")]


@register("lang_pair_parse", "with sc as " + _values(SCRIPT_CODES, ["short", "script"]) + """,
p as (select distinct lang || '-en' as pair, lang as src, 'en' as tgt from documents where lang <> 'en')
select p.pair, s.script as src_script, t.script as tgt_script,
       concat_ws(',', case when s.script is null then src end, case when t.script is null then tgt end) as unknown
from p left join sc s on s.short = p.src left join sc t on t.short = p.tgt
""")
def lang_pair_parse(spark, d):
    docs = T.table(spark, d, "documents").where(F.col("lang") != "en")
    pairs = docs.select(F.concat(F.col("lang"), F.lit("-en")).alias("pair")).distinct()
    sc = spark.createDataFrame(SCRIPT_CODES, "short string, script string")
    return J.lang_pair_parse(pairs, sc, "pair").select("pair", "src_script", "tgt_script", "unknown")


@register("script_pair_parse", "with sc as " + _values(SCRIPT_CODES, ["short", "script"]) + """,
p as (select distinct lang as src from documents where lang <> 'en')
select sc.script || '-eng_Latn' as pair, p.src, 'en' as tgt from p join sc on sc.short = p.src
""")
def script_pair_parse(spark, d):
    """The other direction: pairs of script codes back to short codes."""
    sc = spark.createDataFrame(SCRIPT_CODES, "short string, script string")
    known = lang_pair_parse(spark, d).where(F.col("unknown") == "")
    pairs = known.select(F.concat_ws("-", "src_script", "tgt_script").alias("pair"))
    back = J.lang_pair_parse(pairs, sc.select(F.col("script").alias("short"), F.col("short").alias("script")), "pair")
    return back.select("pair", F.col("src_script").alias("src"), F.col("tgt_script").alias("tgt"))


# --------------------------------------------------------------- alignment
@register("select_training_datasets", "with g as " + _values(
    [(lang, n) for lang, ns in REG.LANG_GROUPS.items() for n in ns], ["lang", "name"]) + """
select distinct name from g where lang in (select distinct dataset from fx_examples)
""")
def select_training_datasets(spark, d):
    langs = T.fx_examples(spark, d).select(F.col("dataset").alias("lang")).distinct()
    return AL.select_training_datasets(REG.lang_groups(spark), langs)


# fixture: example dataset (language) -> registry name and its instruction
ALIGN_NAMES = [("de", "imdb", "Classify the sentiment of the given review."),
               ("en", "MSMarco", "Given a question, retrieve passages that answer the question."),
               ("es", "SQuAD", "Given a question, retrieve passages that answer the question."),
               ("fr", "Banking77", "Given an online banking query, find the intent.")]


def _routes_sql():
    rows, seen = [], set()
    for route, names in (("reconstruct", REG.PRETRAINING_RECONSTRUCT), ("passage2query", REG.PRETRAINING_PASSAGE2QUERY),
                         ("query2passage", REG.PRETRAINING_QUERY2PASSAGE)):
        for n in names:
            if n not in seen:
                seen.add(n)
                rows.append((n, route))
    return _values(rows, ["name", "route"])


def _aligned(spark, d):
    m = spark.createDataFrame(ALIGN_NAMES, "lang string, name string, instruction string")
    ex = T.fx_examples(spark, d).join(m.select(F.col("lang").alias("dataset"), "name"), "dataset", "left")
    ex = ex.withColumn("dataset", F.coalesce("name", "dataset")).drop("name")  # an unknown language keeps its name
    ins = m.select(F.col("name").alias("dataset"), "instruction")
    return AL.route_alignment_task(ex, REG.alignment_routes(spark), ins, seed=777)


_U = MD5U.format(parts="'777', '{t}', cast(e.row_id as varchar)")


ALIGN_MODES = [("reconstruct", True, False), ("align", False, True), ("both", True, True)]


@register("alignment_datasets", "with m as " + _values(ALIGN_NAMES, ["lang", "name", "instruction"]) + ", rt as " + _routes_sql()
          + ", modes as " + _values(ALIGN_MODES, ["mode", "r", "a"]) + """
select mode, rt.name, rt.route, count(*) as n_examples
from fx_examples e join m on m.lang = e.dataset join rt on rt.name = m.name
join modes on case when rt.route = 'reconstruct' then r else a end
group by mode, rt.name, rt.route
""")
def alignment_datasets(spark, d):
    """Examples that each mode of pre-training takes, by dataset and route."""
    m = spark.createDataFrame(ALIGN_NAMES, "dataset string, name string, instruction string").select("dataset", "name")
    sizes = T.fx_examples(spark, d).join(m, "dataset").groupBy("name").agg(F.count(F.lit(1)).alias("n_examples"))
    modes = [AL.alignment_datasets(REG.alignment_routes(spark), r, a).join(sizes, "name").withColumn("mode", F.lit(mode))
             for mode, r, a in ALIGN_MODES]
    return modes[0].unionByName(modes[1]).unionByName(modes[2]).select("mode", "name", "route", "n_examples")


@register("route_alignment_task", "with m as " + _values(ALIGN_NAMES, ["lang", "name", "instruction"])
          + ", rt as " + _routes_sql() + f""",
x as (select e.row_id, m.name as dataset, e.query, e.positive, m.instruction, rt.route,
             {_U.format(t='u1')} as u1, {_U.format(t='u2')} as u2, {_U.format(t='u3')} as u3
      from fx_examples e join m on m.lang = e.dataset join rt on rt.name = m.name),
y as (select *, positive[cast(floor(u3 * len(positive)) as int) + 1] as pos from x where route = 'reconstruct' or len(positive) > 0)
select row_id, dataset, route,
  case when route = 'reconstruct' then query when route = 'passage2query' then (case when u1 < 0.3 then query else pos end) else query end as query,
  case when route = 'reconstruct' then null when route = 'passage2query' then (case when u1 < 0.3 then pos when u2 < 0.4 then null else query end)
       else (case when u1 < 0.1 then null else pos end) end as answer,
  case when route = 'reconstruct' then '{REG.RECONSTRUCT_INSTRUCTION}'
       when route = 'passage2query' then (case when u1 < 0.3 then instruction when u2 < 0.4 then '{REG.RECONSTRUCT_INSTRUCTION}' else '{REG.QUESTION_INSTRUCTION}' end)
       else (case when u1 < 0.1 then '{REG.RECONSTRUCT_INSTRUCTION}' else instruction end) end as instruction
from y
""")
def route_alignment_task(spark, d):
    return _aligned(spark, d)


@register("render_prompts", "with m as " + _values(ALIGN_NAMES, ["lang", "name", "instruction"]) + """
select e.row_id, pos, '<|begin_of_text|>' || m.instruction || '.' || chr(10) || e.query || '<|end_of_text|>' as query_prompt,
       '<|begin_of_text|>' || m.instruction || '. Candidate:' || chr(10) || e.candidate || '<|end_of_text|>' as candidate_prompt
from (select row_id, dataset, query, unnest(range(len(positive))) as pos, unnest(positive) as candidate from fx_examples) e
join m on m.lang = e.dataset
""")
def render_prompts(spark, d):
    """Examples of a language without an instruction have null prompts."""
    m = spark.createDataFrame(ALIGN_NAMES, "dataset string, name string, instruction string")
    ex = T.fx_examples(spark, d).select("row_id", "dataset", "query", F.posexplode("positive").alias("pos", "candidate"))
    out = AL.render_prompts(ex.join(m, "dataset", "left"), REG.special_tokens(spark), "llama")
    return out.select("row_id", F.col("pos").cast("bigint").alias("pos"), "query_prompt", "candidate_prompt")


_UI = MD5U.format(parts="'0', '{t}', cast(row_id as varchar), cast(i - 1 as varchar)")


@register("mask_tokens", f"""
with t as (select row_id, list_transform(string_split(query, ' '), lambda w: ('0x' || substr(md5(w), 1, 4))::UBIGINT::INT) as tok from fx_examples),
p as (PLANSQL),
b as (select t.row_id, t.tok, max(len(t.tok)) over (partition by p.batch_order) as ml from t join p using (row_id)),
pd as (select row_id, len(tok) as real, list_concat(tok, list_transform(range(ml - len(tok)), lambda z: 0)) as tk from b)
select row_id,
  array_to_string(list_transform(tk, lambda x, i: case when i - 1 < real and {_UI.format(t='in')} < 0.15 then 128002 else x end), ',') as input_ids,
  array_to_string(list_transform(tk, lambda x, i: case when i - 1 >= real or {_UI.format(t='att')} < 0.15 then 0 else 1 end), ',') as attention_mask,
  array_to_string(list_transform(tk, lambda x, i: case when i - 1 >= real then -100 else x end), ',') as labels
from pd
""")
def mask_tokens(spark, d):
    from pyspark.sql import Window
    e = T.fx_examples(spark, d)
    tok = F.transform(F.split("query", " "), lambda w: F.conv(F.substring(F.md5(w), 1, 4), 16, 10).cast("int"))
    p = BT.plan_batches(e, 32, seed=777, epoch=0).select("batch_order", "row_id")
    t = e.select("row_id", tok.alias("tok")).join(p, "row_id")
    t = t.withColumn("ml", F.max(F.size("tok")).over(Window.partitionBy("batch_order")))
    m = AL.mask_tokens(t, "tok", "row_id", mask_id=128002, p=0.15, seed=0, pad_to="ml")
    return m.select("row_id", F.array_join(F.transform("input_ids", lambda x: x.cast("string")), ",").alias("input_ids"),
                    F.array_join(F.transform("attention_mask", lambda x: x.cast("string")), ",").alias("attention_mask"),
                    F.array_join(F.transform("labels", lambda x: x.cast("string")), ",").alias("labels"))


def _fix_mask_sql():
    from tessera.plans.catalog import ORACLE
    from tessera.plans.q_sampling import _plan_sql
    plan = _plan_sql(False).strip()
    ORACLE["mask_tokens"] = ORACLE["mask_tokens"].replace("PLANSQL", "select * from (" + plan.replace("\n", " ") + ")")


_fix_mask_sql()
