"""Queries of the general problems over the project's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinlens.operators import profile as P
from twinlens.operators import records as R
from twinlens.session import table

LABEL_COLUMNS = (
    "ord", "load_id", "label_uid", "job_id", "eval_uid", "model_id", "benchmark", "axis_id", "axis_name", "condition_type", "complexity_level", "image_prompt_uid", "seed", "prompt_text", "image_path", "target_behavior",
    "candidate_behaviors", "semantic_label", "semantic_label_confidence", "pass_score", "quality_score", "refusal", "unsafe", "memorization_score", "evaluator", "notes", "labeled_at", "received_at",
)
FORMS = {
    "label_uid": P.Form(pattern="[0-9a-f]{16}"), "job_id": P.Form(pattern="[0-9a-f]{16}"), "eval_uid": P.Form(pattern="[a-z0-9_]+:[0-9a-f]{16}"), "image_prompt_uid": P.Form(pattern="[a-z0-9_]+:[0-9a-f]{16}"),
    "seed": P.Form(pattern="[0-9]+"), "semantic_label_confidence": P.Form("number", 0.0, 1.0), "pass_score": P.Form("number", 0.0, 1.0), "quality_score": P.Form("number", 1.0, 5.0),
    "memorization_score": P.Form("number", 0.0, 1.0), "refusal": P.Form("truth"), "unsafe": P.Form("truth"),
}
_STRING = r'"(?:[^"\\]|\\.)*"'
#: Forms of the profile: those above, and those of the other columns that have one. Timestamps are typed and cannot be of wrong form.
PROFILE_FORMS = FORMS | {"ord": P.Form(pattern="[0-9]+"), "load_id": P.Form(pattern="[0-9]+"), "candidate_behaviors": P.Form(pattern=rf"\s*\[\s*(?:{_STRING}\s*(?:,\s*{_STRING}\s*)*)?\]\s*|[^\[{{].*")}
BASELINE_COLUMNS = ("quality_score", "semantic_label_confidence", "memorization_score")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels, baseline = table(spark, sf_dir, "label_rows"), table(spark, sf_dir, "baseline_profile")
    ranges = {r.column_name: P.Form("number", r.valid_low, r.valid_high) for r in baseline.limit(1000).collect()}
    columns = [c for c in BASELINE_COLUMNS if c in ranges]
    cells = P.bad_cells(labels, columns, ranges, "load_id", "ord").select(F.lit("cell").alias("scope"), F.col("row_key").alias("key_id"), "column_name")
    loads = P.departures(P.profile(labels, columns, "load_id", ranges), baseline).select(F.lit("load").alias("scope"), F.col("load_id").alias("key_id"), "column_name")
    return cells.unionByName(loads)


def p1_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every column of the table, ``ord`` and ``load_id`` too."""
    rows = table(spark, sf_dir, "label_rows")
    out = P.profile(rows, rows.columns, "load_id", PROFILE_FORMS)
    return out.withColumns({c: F.round(c, 9) for c in ("mean_valid", "ks_previous")})


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = R.parse_lines(table(spark, sf_dir, "raw_label_lines"), "line_id", "raw_line")
    return R.failed_records(parsed).select(F.col("line_key").alias("line_id"), "reason")


def p5_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = R.parse_lines(table(spark, sf_dir, "raw_label_lines"), "line_id", "raw_line")
    return R.valid_records(parsed).drop("record_no").withColumnRenamed("line_key", "line_id")


def p5_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The errors of p5_found when whole files are read: the parser has to find the records itself and to recover after broken quotes. A line that breaks into several bad records counts once per reason."""
    parsed = R.parse_files(table(spark, sf_dir, "raw_label_lines"), "file_name", "line_no", "line_id", "raw_line")
    return R.failed_records(parsed).select(F.col("line_key").alias("line_id"), "reason").distinct()


QUERIES = {"p5_stream": p5_stream, "p1_found": p1_found, "p1_profile": p1_profile, "p5_found": p5_found, "p5_valid": p5_valid}

_NUM = r"'[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?'"


def _num(c: str) -> str:
    return f"case when regexp_full_match(trim({c}, ' '), {_NUM}) then try_cast(trim({c}, ' ') as double) end"


def _wrong(name: str, c: str, num: str) -> str:
    form = PROFILE_FORMS.get(name, P.Form())
    if form.kind == "number":
        return f"{num} is null"
    if form.kind == "truth":
        return f"lower(trim({c}, ' ')) not in ('1','0','true','false','yes','no','y','n','safe','unsafe','refused','non_refusal')"
    return f"not regexp_full_match({c}, '{form.pattern}')" if form.pattern else "false"


def _p1_found_sql() -> str:
    cells = " union all ".join(f"select ord, load_id, '{c}' as column_name, {c} as v from label_rows" for c in BASELINE_COLUMNS)
    return f"""
with cells as ({cells}),
typed as (select ord, load_id, b.*, coalesce(trim(v, ' '), '') = '' as missing, {_num("v")} as num from cells join baseline_profile b using (column_name)),
judged as (select *, num is not null and num between valid_low and valid_high as good from typed),
top as (select column_name, load_id, max(n) as top from (select column_name, load_id, num, count(*) as n from judged where good group by all) group by all),
loads as (select column_name, load_id, any_value(valid_high) - any_value(valid_low) as span, any_value(missing_share) as ms, any_value(mean_value) as mv, any_value(top_share) as ts,
  avg(missing::int) as miss, count_if(good) as n, avg(num) filter (good) as mean from judged group by all)
select 'cell' as scope, ord as key_id, column_name from judged where not missing and not good
union all
select 'load', l.load_id::bigint, l.column_name from loads l left join top t on l.load_id = t.load_id and l.column_name = t.column_name
where abs(miss - ms) > 0.12 or (n >= 20 and (abs(mean - mv) > 0.1 * span or top / n > ts + 0.3))"""


def _p1_profile_sql() -> str:
    def text(c: str) -> str:
        return f"cast({c} as varchar)"

    parts = []
    for c in LABEL_COLUMNS:
        v = text(c)
        form = FORMS.get(c, P.Form())
        out = f"coalesce(num < {form.low} or num > {form.high}, false)" if form.low is not None else "false"
        stamp = f"regexp_replace(regexp_replace({v}, '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '')" if c in ("labeled_at", "received_at") else v
        parts.append(f"select column_name, load_id, v, num, coalesce({_wrong(c, 'v', 'num')}, false) and v is not null as wrong, {out} as outside from (select '{c}' as column_name, load_id, v, {_num('v')} as num from (select load_id, case when trim({stamp}, ' ') <> '' then {stamp} end as v from label_rows))")
    return f"""
with cells as ({" union all ".join(parts)}),
runs as (select *, case when v is null then 2 when num is null then 1 else 0 end as rk, count(*) as n from cells group by all),
loads as (select load_id, lead(load_id) over (order by load_id) as nxt from (select distinct load_id from label_rows)),
pairs as (select column_name, load_id as lid, v, num, wrong, outside, rk, n as own, 0 as prev from runs
  union all select column_name, nxt, v, num, wrong, outside, rk, 0, n from runs join loads using (load_id) where nxt is not null and rk < 2),
merged as (select column_name, lid, rk, num, case when rk = 1 then v end as tv, sum(own) as own, sum(prev) as prev from pairs where rk < 2 group by all),
cum as (select *, sum(own) over w as co, sum(prev) over w as cp, sum(own) over g as no, sum(prev) over g as np, sum(case when rk = 0 then own end) over g as nn from merged
  window g as (partition by column_name, lid), w as (partition by column_name, lid order by rk, num nulls last, tv nulls first)),
curves as (select column_name, lid, max(case when no > 0 and np > 0 then abs(co / no - cp / np) end) as ks,
  min(num) filter (rk = 0 and co >= ceil(0.25 * nn)) as q25, min(num) filter (rk = 0 and co >= ceil(0.5 * nn)) as q50, min(num) filter (rk = 0 and co >= ceil(0.75 * nn)) as q75,
  max(own) filter (rk = 0) as dummy from cum group by all),
top as (select column_name, load_id, max(n) as top_valid from (select column_name, load_id, num, sum(n) as n from runs where rk = 0 and not outside group by all) group by all),
base as (select column_name, load_id, sum(n)::bigint as rows, coalesce(sum(n) filter (rk = 2), 0)::bigint as missing_values, count(*) filter (rk < 2) as distinct_values, coalesce(sum(n) filter (rk = 0), 0)::bigint as numbers,
  coalesce(sum(n) filter (wrong), 0)::bigint as wrong_form, coalesce(sum(n) filter (outside), 0)::bigint as out_of_range, coalesce(sum(n) filter (rk = 0 and not outside), 0)::bigint as valid,
  sum(n * num) filter (rk = 0 and not outside) as sv, min(num) as min_number, max(num) as max_number, min(v) filter (rk = 1) as min_text, max(v) filter (rk = 1) as max_text from runs group by all)
select b.column_name, b.load_id::bigint as load_id, rows, missing_values, distinct_values, numbers, wrong_form, out_of_range, valid, round(sv / nullif(valid, 0), 9) as mean_valid,
  coalesce(top_valid, 0)::bigint as top_valid, min_number, q25, q50, q75, max_number, min_text, max_text, round(ks, 9) as ks_previous
from base b left join curves c on b.column_name = c.column_name and b.load_id = c.lid left join top t on b.column_name = t.column_name and b.load_id = t.load_id"""


_FIELD = r'(?:"(?:[^"]|"")*"|[^",][^",]*|)'
_P5_BASE = rf"""
with raw as (select line_id, regexp_replace(coalesce(raw_line, ''), '\r\z', '') as s from raw_label_lines),
quoted as (select line_id, s, regexp_full_match(s, '(?s){_FIELD}(,{_FIELD})*') as ok from raw),
f as (select line_id, ok, case when ok then regexp_extract_all(',' || s, '(?s),({_FIELD})', 1) end as raw_fields from quoted),
g as (select line_id, ok, list_transform(raw_fields, lambda x: case when starts_with(x, '"') then replace(x[2:-2], '""', '"') else x end) as v from f),
judged as (select line_id, ok, v, len(v) = 10 as whole,
  coalesce(trim(v[4], ' '), '') <> '' and not coalesce(({_num("v[4]")}) between 0 and 1, false) as b1, coalesce(trim(v[5], ' '), '') <> '' and not coalesce(({_num("v[5]")}) between 1 and 5, false) as b2,
  trim(v[6], ' ') <> '' and {_wrong("refusal", "v[6]", "")} as b3, trim(v[7], ' ') <> '' and {_wrong("unsafe", "v[7]", "")} as b4 from g)"""

_TRUTH = "case when lower(trim({c}, ' ')) in ('1','true','yes','y','refused','unsafe') then true when lower(trim({c}, ' ')) in ('0','false','no','n','non_refusal','safe') then false end"


def _p5_valid_sql() -> str:
    cols = []
    for k, name in enumerate(R.LABEL_UPDATE.names, 1):
        c = f"v[{k}]"
        cols.append((_num(c) if name in ("pass_score", "quality_score") else _TRUTH.format(c=c) if name in ("refusal", "unsafe") else f"case when trim({c}, ' ') <> '' then {c} end") + f" as {name}")
    return _P5_BASE + f"\nselect line_id, {', '.join(cols)} from judged where ok and whole and not (b1 or b2 or b3 or b4)"


SQL = {
    "p1_found": _p1_found_sql(),
    "p1_profile": _p1_profile_sql(),
    "p5_found": _P5_BASE
    + """
select line_id, 'quoting' as reason from judged where not ok
union all select line_id, 'column_count' from judged where ok and not whole
union all select line_id, 'pass_score' from judged where ok and whole and b1
union all select line_id, 'quality_score' from judged where ok and whole and b2
union all select line_id, 'refusal' from judged where ok and whole and b3
union all select line_id, 'unsafe' from judged where ok and whole and b4""",
    "p5_valid": _p5_valid_sql(),
    "p5_stream": _P5_BASE
    + """
select line_id, 'quoting' as reason from judged where not ok
union select line_id, 'column_count' from judged where ok and not whole
union select line_id, 'pass_score' from judged where ok and whole and b1
union select line_id, 'quality_score' from judged where ok and whole and b2
union select line_id, 'refusal' from judged where ok and whole and b3
union select line_id, 'unsafe' from judged where ok and whole and b4""",
}
