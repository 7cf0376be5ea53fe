"""Queries of the training-data problems over the project's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinlens.llm import consensus as C
from twinlens.llm import copies, growing_sample, label_mapping, mixing, packing, splitting
from twinlens.llm.tokens import with_tokens
from twinlens.session import materialize, table

SAMPLE_RATE = 0.2


def limits(spark: SparkSession, sf_dir: str) -> dict[str, int]:
    wanted = ("container_capacity", "piece_limit", "piece_overlap")
    return {r["limit_name"]: r["tokens"] for r in table(spark, sf_dir, "size_limits").filter(F.col("limit_name").isin(*wanted)).groupBy("limit_name").agg(F.max("tokens").alias("tokens")).collect()}


def p2_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger is kept in the folder named by spark.twinlens.ledger, where a later session adds only the loads it lacks; without it a new one is made in the shared folder."""
    named = spark.conf.get("spark.twinlens.ledger", None)
    ledger = growing_sample.replay(table(spark, sf_dir, "prompt_bank"), "condition_type", "image_prompt_uid", "load_batch", SAMPLE_RATE, path=named)
    return ledger.select(F.col("stratum").alias("condition_type"), F.col("sample_key").alias("image_prompt_uid"), "chosen_in")


def _mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_mapping.map_values(table(spark, sf_dir, "label_rows"), table(spark, sf_dir, "behavior_vocab"), "ord", "axis_name", "semantic_label", "candidate_behaviors")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mapped(spark, sf_dir).select(F.col("key").alias("ord"), "field_name", "item_pos", "behavior_id")


def p3_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_mapping.unmatched_report(_mapped(spark, sf_dir))


def p3_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels of p3_found that are a name or alias of one entry of their axis in other letter case or outer spaces: what they were mapped to."""
    name = F.explode(F.concat(F.array("canonical_label"), F.coalesce("aliases", F.array().cast("array<string>"))))
    names = table(spark, sf_dir, "behavior_vocab").select(F.col("axis_name").alias("axis"), "behavior_id", name.alias("name")).groupBy("axis", F.lower("name").alias("name")).agg(F.countDistinct("behavior_id").alias("n")).filter("n = 1")
    mapped = _mapped(spark, sf_dir).filter("item_pos = 0").withColumn("name", F.lower(F.trim("text")))
    return mapped.join(names, ["axis", "name"], "left_semi").select(F.col("key").alias("ord"), "behavior_id")


def _written(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    written = copies.written_alike(table(spark, sf_dir, "prompt_bank"), "ord", ["benchmark", "axis_id"], ["prompt_text"], ["metadata"])
    return copies.hashed(written), written


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies.copies_of(*_written(spark, sf_dir)).select(F.col("first_key").alias("first_ord"), F.col("key").alias("ord"))


def p4_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies.copy_groups(*_written(spark, sf_dir)).select(F.col("first_key").alias("first_ord"), "copies")


def _consensus(spark: SparkSession, sf_dir: str, *tasks: str) -> C.Consensus:
    return C.consensus(C.update_votes(table(spark, sf_dir, "label_updates"), tasks or ("semantic_label", "pass_score", "quality_score")), unvoted=True)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item cases are rows of the model's posterior, annotator cases rows of its reliabilities; the exact counts carried beside them then decide."""
    result = _consensus(spark, sf_dir, "semantic_label")
    items = result.posterior.filter("votes >= 3 and 2 * class_votes > votes and labels > 1").select(F.lit("item").alias("case_kind"), F.col("item").alias("case_key"), F.col("class").alias("case_label"))
    doubtful = result.annotators.filter("settled_votes >= 10 and 10 * settled_right < 6 * settled_votes").select(F.lit("evaluator").alias("case_kind"), F.col("annotator").alias("case_key"), F.lit("").alias("case_label"))
    return items.unionByName(doubtful)


def p6_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _consensus(spark, sf_dir).items.withColumn("probability", F.round("probability", 6))


def p6_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _consensus(spark, sf_dir).annotators


def p6_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    tally = C.standing(C.update_votes(table(spark, sf_dir, "label_updates"))).groupBy("task", "item", "label").agg(F.count("*").alias("n"))
    return C.agreement(tally).withColumns({c: F.round(c, 9) for c in ("alpha_nominal", "alpha_interval")})


def _sized(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return with_tokens(table(spark, sf_dir, "documents").select(*columns, "text"), "text")


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_sized(spark, sf_dir, "doc_id"), "doc_id", "tokens", limits(spark, sf_dir)["container_capacity"]).withColumnRenamed("doc_key", "doc_id")


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    capacity = limits(spark, sf_dir)["container_capacity"]
    return packing.fill_report(packing.pack(_sized(spark, sf_dir, "doc_id"), "doc_id", "tokens", capacity), capacity)


def _mix(spark: SparkSession, sf_dir: str, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    return mixing.mix(_sized(spark, sf_dir, "doc_id", "source"), "doc_id", "source", "tokens", table(spark, sf_dir, "source_weights"), exact=exact)


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[0].withColumnRenamed("doc_key", "doc_id")


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[1]


def p8_target_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of a mixture no larger than lets all sources with documents keep their target shares."""
    return _mix(spark, sf_dir, True)[1]


def p8_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: listed sources, and what must not occur in a mixture: copies of unlisted sources, more copies than allowed, and copies that are neither floor nor ceiling of the expected number."""
    mixture, report = _mix(spark, sf_dir)
    per_doc = mixture.groupBy("doc_key", "source").agg(F.count("*").alias("n"), F.max("copy_no").alias("last")).join(F.broadcast(report.select("source", "expected_copies", "max_repeats")), "source", "left")
    e = F.col("expected_copies")
    found = per_doc.agg(
        F.count_if(e.isNull()).alias("unlisted"), F.count_if(F.col("n") > F.col("max_repeats")).alias("over_max_repeats"), F.count_if((F.col("n") < F.floor(e)) | (F.col("n") > F.ceil(e)) | (F.col("n") != F.col("last"))).alias("wrong_copies")
    )
    return report.agg(F.count("*").alias("sources")).crossJoin(F.broadcast(found))


def p7_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: documents, and what must not occur in a packing: documents left out or placed twice, over-full containers, documents split though they fit, gaps between parts."""
    capacity = limits(spark, sf_dir)["container_capacity"]
    sized = materialize(_sized(spark, sf_dir, "doc_id"), "checked")
    packed = materialize(packing.pack(sized, "doc_id", "tokens", capacity), "packed")
    docs = packed.groupBy("doc_key").agg(F.count("*").alias("parts"), F.sum("part_tokens").alias("placed"), F.sum((F.col("part_no") - 1) * capacity - F.col("start_token")).alias("off"))
    d = sized.join(docs, sized["doc_id"] == docs["doc_key"], "left").agg(
        F.count("*").alias("documents"), F.count_if(F.coalesce(F.col("placed") != F.col("tokens"), F.lit(True))).alias("misplaced"), F.count_if((F.col("tokens") <= capacity) & (F.col("parts") > 1)).alias("split_though_fitting"), F.count_if(F.col("off") != 0).alias("gaps")
    )
    boxes = packed.groupBy("container_id").agg(F.sum("part_tokens").alias("level"), F.max("filled").alias("said")).agg(F.count_if((F.col("level") > capacity) | (F.col("level") != F.col("said"))).alias("wrong_containers"))
    return d.crossJoin(F.broadcast(boxes))


def _pieces(spark: SparkSession, sf_dir: str, with_text: bool) -> DataFrame:
    most = limits(spark, sf_dir)
    return splitting.split_texts(table(spark, sf_dir, "documents"), "doc_id", "text", most["piece_limit"], most["piece_overlap"], with_text)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir, False).filter("piece_no = 1").select(F.col("piece_key").alias("doc_id"))


def p9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir, True).withColumnRenamed("piece_key", "doc_id")


QUERIES = {
    f.__name__: f
    for f in (p2_sample, p3_found, p3_unmatched, p3_named, p4_found, p4_records, p6_found, p6_consensus, p6_reliability, p6_agreement, p7_containers, p7_fill, p7_checks, p8_mixture, p8_shares, p8_target_shares, p8_checks, p9_found, p9_pieces)
}

_NUM = r"case when regexp_full_match(trim({c}, ' '), '[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?') then try_cast(trim({c}, ' ') as double) end"
_PASS, _QUALITY = _NUM.format(c="pass_score"), _NUM.format(c="quality_score")
_STANDING = f"""
cast_votes as (
  select 'semantic_label' as task, label_uid, evaluator, replace(lower(trim(semantic_label, ' ')), ' ', '_') as label, ord from label_updates where trim(semantic_label, ' ') <> ''
  union all select 'pass_score', label_uid, evaluator, case when ({_PASS}) >= 0.5 then 'pass' else 'fail' end, ord from label_updates where ({_PASS}) between 0 and 1
  union all select 'quality_score', label_uid, evaluator, cast(cast(floor(({_QUALITY}) + 0.5) as bigint) as varchar), ord from label_updates where ({_QUALITY}) between 1 and 5),
standing as (select task, label_uid, lower(trim(evaluator, ' ')) as who, arg_max(label, ord) as label from cast_votes where trim(evaluator, ' ') <> '' group by all),
tally as (select task, label_uid, label, count(*) as n from standing group by all)"""

_NARROW = "array_to_string(list_transform(string_split(coalesce(prompt_text, ''), ''), lambda c: case when unicode(c) between 65281 and 65374 then chr(unicode(c) - 65248) else c end), '')"
_WRITTEN = f"""with w as (select ord, benchmark, axis_id, metadata is null as no_meta, regexp_replace(lower(nfc_normalize({_NARROW})), '[^\\p{{L}}\\p{{N}}\\p{{M}}]', '', 'g') as t,
  case when json_valid(metadata) then (select list_sort(list(fullkey || '=' || case when type in ('UBIGINT', 'BIGINT', 'DOUBLE') then 'NUMBER ' || (atom::varchar::double)::varchar else type || ' ' || coalesce(atom::varchar, '') end)) from json_tree(metadata)) else [metadata] end as m from prompt_bank)"""

SQL = {
    "p2_sample": rf"""
with recursive keyed as (select coalesce(regexp_replace(lower(trim(condition_type, ' ')), '[\s\-]+', '_', 'g'), '') as stratum, image_prompt_uid as key, load_batch as lb from prompt_bank where image_prompt_uid is not null),
c as (select stratum, key, min(lb) as fl, md5('1|' || key) as p from keyed group by all),
loads as (select fl, row_number() over (order by fl) as idx from (select distinct fl from c)),
led as (
  select 0 as i, null::varchar as stratum, null::varchar as key, null::int as chosen
  union all
  select * from (
    with prev as materialized (select * from led), nxt as (select idx as i, fl from loads where idx = (select max(i) + 1 from prev)),
    seen as (select c.* from c, nxt where c.fl <= nxt.fl), need as (select stratum, ceil(round({SAMPLE_RATE} * count(*), 6)) - count(prev.key) as need from seen left join prev using (stratum, key) group by stratum),
    ranked as (select stratum, key, row_number() over (partition by stratum order by p, key) as r from seen anti join prev using (stratum, key))
    select nxt.i, prev.stratum, prev.key, prev.chosen from prev, nxt
    union all select nxt.i, stratum, key, nxt.fl from ranked join need using (stratum), nxt where r <= need))
select stratum as condition_type, key as image_prompt_uid, chosen as chosen_in from led where i = (select max(i) from led) and key is not null""",
    "p4_found": f"{_WRITTEN}, g as (select *, min(ord) over (partition by benchmark, axis_id, no_meta, t, m) as first_ord from w) select first_ord, ord from g where ord <> first_ord",
    "p4_records": f"{_WRITTEN} select min(ord) as first_ord, count(*) as copies from w group by benchmark, axis_id, no_meta, t, m",
    "p3_named": """
with n as (select axis_name, behavior_id, lower(unnest(list_prepend(canonical_label, coalesce(aliases, [])))) as name from behavior_vocab),
one as (select axis_name, name, min(behavior_id) as behavior_id from n group by axis_name, name having count(distinct behavior_id) = 1)
select ord, behavior_id from label_rows l join one on l.axis_name = one.axis_name and lower(trim(semantic_label, ' ')) = name
where not exists (select 1 from behavior_vocab v where v.axis_name = l.axis_name and v.canonical_label = l.semantic_label)""",
    "p7_checks": "select count(*) as documents, 0 as misplaced, 0 as split_though_fitting, 0 as gaps, 0 as wrong_containers from documents",
    "p8_checks": r"select count(distinct regexp_replace(lower(regexp_replace(source, '^\s+|\s+$', '', 'g')), '[\s\-]+', '_', 'g')) as sources, 0 as unlisted, 0 as over_max_repeats, 0 as wrong_copies from source_weights where target_share is not null",
    "p6_found": f"""
with {_STANDING},
items as (select label_uid, sum(n) as votes, max(n) as top, arg_max(label, n) as label, count(*) as labels from tally where task = 'semantic_label' group by all),
settled as (select * from items where votes >= 3 and 2 * top > votes),
who as (select s.who, count(*) as votes, count_if(s.label = t.label) as agreed from standing s join settled t using (label_uid) where s.task = 'semantic_label' group by all)
select 'item' as case_kind, label_uid as case_key, label as case_label from settled where labels > 1
union all select 'evaluator', who, '' from who where votes >= 10 and 10 * agreed < 6 * votes""",
    "p6_agreement": f"""
with {_STANDING},
used as (select *, sum(n) over (partition by task, label_uid) as m, try_cast(label as double) as x from tally qualify m > 1),
item as (select task, label_uid, max(m) as m, sum(n * n) as same, sum(n * x) as sx, sum(n * x * x) as sxx from used group by all),
o as (select task, count(*) as items, sum(m)::bigint as votes, sum((m * m - same) / (m - 1)) as d, sum(2 * (m * sxx - sx * sx) / (m - 1)) as dx from item group by all),
v as (select task, label, sum(n) as n, any_value(x) as x from used group by all),
e as (select task, sum(n) as a, sum(n * n) as same, sum(n * x) as sx, sum(n * x * x) as sxx, count_if(x is null) as texts from v group by all)
select task, items, votes, round(1 - (a - 1) * d / nullif(a * a - same, 0), 9) as alpha_nominal, case when texts = 0 then round(1 - (a - 1) * dx / nullif(2 * (a * sxx - sx * sx), 0), 9) end as alpha_interval from o join e using (task)""",
}
