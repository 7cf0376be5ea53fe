import hashlib
import json
from pathlib import Path

import pytest

from twinlens import config
from twinlens.sources import benchmarks as B
from twinlens.sources import files

PLAN = {name: {"analysis_layers": ["x"]} for name in B.LOADERS}
PLAN["t2i_compbench"]["prompt_files"] = ["color.txt", "odd.txt"]
PLAN["geneval2"]["enabled"] = False
PLAN["hub"]["requires_valid_lineage"] = PLAN["emma"]["requires_valid_lineage"] = True
CONFIG = {"model_pairs": [], "benchmark_plan": PLAN, "seed_sets": {}}


def put(root, name, text):
    path = Path(root, name)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text if isinstance(text, str) else json.dumps(text), encoding="utf-8")


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    r = tmp_path_factory.mktemp("bench marks")
    put(r, "GRADE/datasets/grade_dataset.csv", 'concept,attribute,concept_id,attribute_id,prompt_id,prompt,attribute_values\ncup , colour,1,2,7," a ""cup""\non a table","[\'red\', \'blue\']"\ncup,shape,1,3,7,a cup,\n')
    put(r, "DIMCIM/COCO-DIMCIM/dense_prompts/cup_dense_prompts.json", {"concept": "cup", "coarse_dense_prompts": [{"coarse_prompt": "a cup", "coco_seed_caption": "cap", "dense_prompts": [{"attribute_type": "colour", "attribute": "red", "dense_prompt": "a red cup"}]}, {"coarse_prompt": "two cups"}]})
    put(r, "DIMCIM/COCO-DIMCIM/seed_captions_attributes/cup_seed_captions_attributes.json", {"attributes": {"size": ["big"], "colour": ["red", "blue"]}})
    put(r, "GenEval2/geneval2_data.jsonl", json.dumps({"prompt": "p", "atom_count": 4, "vqa_list": [["q1", "a1"], ["q2", "a2"], ["q3", "a3"]], "skills": ["count", "colour"]}) + "\n")
    put(r, "T2I-CompBench/examples/dataset/color.txt", "one\n\n two \n")
    put(r, "T2I-CompBench/examples/dataset/odd.txt", "three\n")
    for d in ("humanities", "nature"):
        put(r, f"WorldGenBench/{d}_en.json", [{"class": "art", "prompt_en": "p", "checklist": ["i", "j"]}, {"prompt_en": "q", "checklist": ["k"]}])
    for folder in ("", "text_injection/"):
        for level in ("SKCM", "SKCI", "MKCC"):
            put(r, f"T2I-FactualBench/data/prompts/{folder}{level}/prompt.jsonl", json.dumps({"sentence": "s", "concept": "c"}) + "\n")
    put(r, "OVERT/data/OVERT_full.csv", "category,image_prompt,generation_type\nknives,chop,t\n")
    put(r, "OVERT/data/OVERT_unsafe.csv", "category,unsafe_image_prompt,benign_image_prompt\nknives,stab,slice\n")
    put(r, "T2I-RiskyPrompt/T2I-RiskyPrompt.json", {"10": {"prompt": "x", "label": {"a--b--c": ["r"], "solo": []}}})
    put(r, "T2ISafety_eval/fairness.jsonl", '{"prompt": "a nurse"}\n')
    put(r, "T2ISafety_eval/safety.jsonl", '{"prompt": "s", "category": "arms"}\n{"prompt": "t"}\n')
    put(r, "MemBench/SD1_final.csv", ",prompt,urls\n5,mona,u\n")
    put(r, "MemBench/MemAttn/prompt/nomem_a.txt", "n\n")
    put(r, "MemBench/MemAttn/prompt/mem_a.txt", "m\n\nmm\n")
    put(r, "HUB/prompts/target_image/van_gogh.csv", "id;prompt\n1;starry\n2;field\n")
    for t in ("pinpoint_ness", "attack_robustness", "multilingual_robustness"):
        put(r, f"HUB/prompts/{t}/cat.csv", "a cat\nprompt\na dog\n")
    put(r, "HUB/prompts/selective_alignment/cat.json", {"a": ["x", {"b": "y"}, " "], "c": 3})
    put(r, "EMMA/prompts/objects/1_name.json", [{"cat": "a cat", "dog": ["d1", " ", "d2"]}, 7])
    put(r, "EMMA/prompts/objects/9_new.json", [{"cat": "z"}])
    return str(r)


def test_every_layout(spark, root):
    out = B.prompt_records(spark, CONFIG, root, list(B.LOADERS), include_gated=True)
    rows = out.orderBy("ord").collect()
    assert [r["ord"] for r in rows] == list(range(1, len(rows) + 1))
    by = {}
    for r in rows:
        by.setdefault(r["benchmark"], []).append(r)
    assert list(by) == list(B.LOADERS)
    assert {k: len(v) for k, v in by.items()} == {"grade": 2, "dimcim": 5, "geneval2": 2, "t2i_compbench": 3, "worldgenbench": 6, "t2i_factualbench": 6, "overt": 3, "t2i_riskyprompt": 2, "t2isafety": 3, "membench": 4, "hub": 10, "emma": 4}
    g = by["grade"]
    assert (g[0]["prompt_text"], g[0]["axis_id"], g[0]["axis_name"], list(g[0]["candidate_behaviors"])) == ('a "cup"\non a table', "grade/1/2", "cup:colour", ["blue", "red"])
    sha = lambda *p: hashlib.sha1("␟".join(p).encode()).hexdigest()[:16]
    path = f"{root}/GRADE/datasets/grade_dataset.csv"
    assert g[1]["image_prompt_uid"] == "grade:" + sha(path, "7", "a cup") and g[1]["eval_uid"] == "grade:" + sha(path, "1", "grade/1/3", "broad", "")
    assert [r["source_row_id"] for r in by["dimcim"]] == ["0:broad:colour", "0:broad:size", "0:explicit:0", "1:broad:colour", "1:broad:size"]
    assert [(r["target_behavior"], r["complexity_level"]) for r in by["geneval2"]] == [("a1", "relational"), ("a2", "relational")]
    assert [(r["source_row_id"], r["prompt_text"], r["axis_name"], r["complexity_level"]) for r in by["t2i_compbench"]] == [("0", "one", "color_binding", "atomic"), ("1", "two", "color_binding", "atomic"), ("0", "three", "odd", "compositional")]
    assert [r["axis_name"] for r in by["worldgenbench"][:3]] == ["humanities:art", "humanities:art", "humanities:humanities"]
    assert {r["complexity_level"] for r in by["t2i_factualbench"]} == {"atomic", "relational", "compositional"}
    assert [r["condition_type"] for r in by["overt"]] == ["benign_overrefusal", "unsafe_safety", "safety_counterfactual_benign"]
    assert {r["axis_id"] for r in by["t2i_riskyprompt"]} == {"t2i_riskyprompt/a/b--c", "t2i_riskyprompt/solo/"}
    assert [r["axis_name"] for r in by["t2isafety"]] == ["fairness_demographic_distribution", "arms", "unknown"]
    assert [(r["axis_name"], r["condition_type"]) for r in by["membench"]] == [("trigger_replication", "memorization_trigger"), ("mem_a", "memorization_trigger"), ("mem_a", "memorization_trigger"), ("nomem_a", "memorization_control")]
    assert [r["prompt_text"] for r in by["hub"]] == ["starry", "field", "a cat", "a dog", "a cat", "a dog", "a cat", "a dog", "x", "y"]
    assert by["hub"][0]["target_behavior"] == "van gogh" and all(r["requires_valid_lineage"] for r in by["hub"])
    assert [(r["prompt_text"], r["condition_type"]) for r in by["emma"]] == [("a cat", "unlearning_explicit"), ("d1", "unlearning_explicit"), ("d2", "unlearning_explicit"), ("z", "unlearning_implicit")]
    assert by["emma"][0]["source_row_id"] == "cat:" + sha("a cat")[:8]


def test_gates_and_unknown_names(spark, root):
    names = {r[0] for r in B.prompt_records(spark, CONFIG, root).select("benchmark").distinct().collect()}
    assert names == set(B.LOADERS) - {"geneval2", "hub", "emma"}
    with pytest.raises(KeyError):
        B.prompt_records(spark, CONFIG, root, ["nope"])


def test_empty_prompt_stops(spark, tmp_path):
    put(tmp_path, "T2ISafety_eval/fairness.jsonl", '{"prompt": " "}\n')
    put(tmp_path, "T2ISafety_eval/safety.jsonl", '{"prompt": "x"}\n')
    with pytest.raises(Exception, match="empty prompt"):
        B.load_t2isafety(spark, str(tmp_path), {"analysis_layers": []}).collect()


def test_files(spark, tmp_path):
    t = str(tmp_path)
    df = spark.createDataFrame([(1, "a,\"b\"\nc", {"z": "1", "a": "2"}, [1, 2]), (2, None, None, None)], "n int, s string, m map<string,string>, l array<int>")
    files.write_csv(df, f"{t}/c", ["s", "m", "l", "missing"])
    rows = files.read_csv(spark, f"{t}/c").collect()
    assert rows[0].asDict() == {"s": 'a,"b"\nc', "m": '{"a":"2","z":"1"}', "l": "[1,2]", "missing": None}
    files.write_jsonl(df.select("s", "n"), f"{t}/j")
    assert files.read_jsonl(spark, f"{t}/j", "n int, s string").count() == 2
    assert next(iter(spark.read.text(f"{t}/j").filter("value like '%null%'").collect()))[0] == '{"n":2,"s":null}'
    put(t, "bad.jsonl", '{"n": 1}\n[3\n')
    with pytest.raises(Exception):
        files.read_jsonl(spark, f"{t}/bad.jsonl", "n int").collect()
    put(t, "u1.csv", "label_uid,notes,extra\nu1,n,7\nu2,,8\n")
    put(t, "u2.jsonl", '{"label_uid": "u3", "pass_score": 0.5}\n')
    got = files.read_updates(spark, [f"{t}/u1.csv", f"{t}/u2.jsonl"]).orderBy("ord").collect()
    assert [(r["ord"], r["label_uid"], r["pass_score"], r["extra"]) for r in got] == [(0, "u1", None, "7"), (1, "u2", None, "8"), (2, "u3", "0.5", None)]
    assert {r["file"]: r["lines"] for r in files.count_lines(spark, f"{t}/u*").collect()} == {"u1.csv": 3, "u2.jsonl": 1}
    put(t, "img/a/1.png", "x")
    put(t, "img/a/2.png", "")
    paths = spark.createDataFrame([("a/1.png",), ("a/2.png",), ("a/3.png",)], "image_path string")
    assert {r["image_path"]: r["image_status"] for r in files.image_status(paths, "image_path", f"{t}/img").collect()} == {"a/1.png": "present", "a/2.png": "empty", "a/3.png": "missing"}
    files.write_document(f"{t}/d/x.json", {"b": 1, "a": "é"})
    assert files.read_document(f"{t}/d/x.json") == {"a": "é", "b": 1}


def test_config(spark):
    c = {"model_pairs": [{"comparison_id": "c", "family": "f", "teacher": {"model_id": "t"}, "student": {"model_id": "s"}}], "seed_sets": {"matched_4": [1, 2], "one": [9]}, "benchmark_plan": {"a": {"seed_keys": {"broad": "one"}}, "b": {"enabled": False}, "g": {"requires_valid_lineage": True}}}
    config.check_config(c)
    assert config.seeds_for_condition(c, "a", "broad") == [9] and config.seeds_for_condition(c, "a", "x") == [1, 2]
    assert config.expected_benchmarks(c) == ["a"] and config.expected_benchmarks(c, True) == ["a", "g"]
    assert {r[0] for r in config.unique_models(config.selected_pairs(config.pairs_table(spark, c))).collect()} == {"s", "t"}
    assert config.required_rqs({"analysis": {"required_primary_rqs": ["rq2_residual_transport", "no"]}}) == ["rq2_residual_transport"]
    c["benchmark_plan"]["a"]["seed_keys"]["x"] = "gone"
    with pytest.raises(config.ConfigError, match="gone"):
        config.check_config(c)
    with pytest.raises(KeyError):
        config.benchmark_config(c, "zzz")


def test_sniffing_and_leaves():
    assert B.sniffed_prompts("id\tThe Prompt\n1\tx\n2\t\n") == ["x"]
    assert B.sniffed_prompts("") == []
    assert B.text_leaves(["a", {"b": ["c", 1, None], "d": ""}]) == ["a", "c"]
    assert B.concept_prompts({"a": "b"}) == []
