"""Graphs in large files and published models: cuts at any byte, writers that fail, old versions."""

import json
import random

import pytest
from pyspark.sql import functions as F

from cmdspark.operators import mining, rules
from cmdspark.sources import manuals, models
from cmdspark.sources.graph_file import graph_entries


def graph(n):
    rng = random.Random(n)
    commands = {
        f"cmd {k}é\"\\": {"category": rng.choice(["a", "b", ""]), "syntax": f"cmd_{k} [-x]", "options": {"-x": "text\n    \"not a key\": {"}, "description": "d" * rng.randint(0, 300), "examples": "", "related": ["r"], "depends_on": ["other", f"cmd {k}é\"\\"]}
        for k in range(n)
    }
    categories = {}
    for name, r in commands.items():
        if r["category"]:
            categories.setdefault(r["category"], []).append(name)
    return {"commands": commands, "categories": categories}


@pytest.mark.parametrize(("indent", "size"), [(2, 1000), (4, 177), ("\t", 60), (None, 500)])
def test_a_graph_file_is_cut_anywhere(spark, tmp_path, indent, size):
    want = graph(60)
    (tmp_path / "g.json").write_text(json.dumps(want, indent=indent))
    entries = graph_entries(spark, f"file://{tmp_path}/g.json", size)
    assert (entries.rdd.getNumPartitions() > 10) == (indent is not None)
    got = {"commands": {}, "categories": {}}
    for r in entries.collect():
        part = got["commands" if r["kind"] == "command" else "categories"]
        assert r["name"] not in part
        part[r["name"]] = json.loads(r["body"])
    assert got == want
    records, index = models.load_graph_file(spark, f"file://{tmp_path}/g.json", size)
    assert {(r["command"], r["category"], tuple(r["depends_on"])) for r in records.collect()} == {(c, r["category"], ("other",)) for c, r in want["commands"].items()}
    assert {(r["category"], r["command"]) for r in index.collect()} == {(k, c) for k, v in want["categories"].items() for c in v}


def test_empty_graph_files(spark, tmp_path):
    for name, text in (("a", ""), ("b", "{}"), ("c", '{\n  "commands": {},\n  "categories": {}\n}')):
        (tmp_path / f"{name}.json").write_text(text)
    assert graph_entries(spark, f"file://{tmp_path}").count() == 0


def test_documents_have_their_categories(spark, tmp_path):
    want = graph(25)
    (tmp_path / "g.json").write_text(json.dumps(want))
    records = models.load_graph_json(spark, f"{tmp_path}/g.json")
    for write, load in ((models.write_graph_json, lambda p: models.load_categories_json(spark, p, lines=True)), (models.write_graph_text, lambda p: models.load_graph_file(spark, p, 300)[1])):
        path = f"file://{tmp_path}/{write.__name__}"
        write(records, path, 10)
        assert {(r["category"], r["command"]) for r in load(path).collect()} == {(k, c) for k, v in want["categories"].items() for c in v}


def parts(spark, n):
    return {"frequency": spark.createDataFrame([("a", n)], "command string, count long"), "transitions": spark.createDataFrame([("a", "b", n)], "`from` string, `to` string, count long")}


def loaded(spark, path, version=None):
    model = models.load_model(spark, path, version)
    return {name: df.first()["count"] if df.columns[-1] == "count" and not df.isEmpty() else None for name, df in model.items()}


def test_a_writer_that_fails_leaves_the_old_model(spark, tmp_path):
    path = f"{tmp_path}/model"
    assert loaded(spark, path)["frequency"] is None
    models.write_model(parts(spark, 1), path)
    bad = parts(spark, 2)
    bad["transitions"] = bad["transitions"].withColumn("count", F.raise_error(F.lit("lost")).cast("long"))
    with pytest.raises(Exception, match="lost"):
        models.write_model(bad, path)
    assert loaded(spark, path) == {"meta": None, "frequency": 1, "flags": None, "transitions": 1, "sequences": None}
    with pytest.raises(ValueError, match="no parts"):
        models.write_model({"other": bad["frequency"]}, path)


def test_versions_and_their_end(spark, tmp_path):
    path = f"{tmp_path}/model"
    assert [models.write_model(parts(spark, n), path, keep=2) for n in (1, 2, 3)] == [1, 2, 3]
    assert list(models.versions(spark, path)) == [2, 3]
    assert (loaded(spark, path)["frequency"], loaded(spark, path, 2)["frequency"]) == (3, 2)
    assert len(list((tmp_path / "model/snapshots").iterdir())) == 2
    with pytest.raises(ValueError, match="no version"):
        models.load_model(spark, path, 1)
    (tmp_path / "model/manifests/000000000009.json").write_text('{"snapshot": "x", "pa')  # cut off
    (tmp_path / "model/snapshots/left").mkdir()
    assert loaded(spark, path)["frequency"] == 3
    assert models.write_model(parts(spark, 4), path, keep=2, grace_hours=-1) == 10
    assert loaded(spark, path)["frequency"] == 4
    assert not (tmp_path / "model/snapshots/left").exists()


def test_catalogue_of_sections(spark):
    texts = [("p", "COMMAND: c\n\nSYNTAX:\nc [-a] [-b n] <x-y | -z>\n\nOPTIONS:\n-a v : text\n  -no : indented\nmore -text\n"), ("q", "COMMAND: bare\n")]
    sections = manuals.parse_sections(spark.createDataFrame(texts, "path string, value string"))
    for flags_from, want in (("options", {"c": ["-a"], "bare": []}), ("options+syntax", {"c": ["-a", "-b", "-z"], "bare": []})):
        assert {r["command"]: r["options"] for r in rules.catalogue_of_sections(sections, flags_from).collect()} == want
    with pytest.raises(ValueError, match="flags come from"):
        rules.catalogue_of_sections(sections, "syntax")


def test_mining_after_cleaning(spark):
    script = spark.createDataFrame([("s", "add_faults-all here and there\nrun_drc x{1}\nrun_atpg-auto now")], "script_id string, text string")
    names = ["add_faults", "run_drc", "run_atpg"]
    assert [r["command"] for r in mining.mine(script, names).collect()] == ["run_drc"]
    assert [r["command"] for r in mining.mine(script, names, cleaned=True).orderBy("pos").collect()] == names
