import os

import pytest

from toolframe.sources import readers


def write(folder, name, lines):
    with open(os.path.join(folder, name), "w") as f:
        f.write("\n".join(lines) + "\n")


def test_a_malformed_line_is_named(spark, tmp_dir):
    write(tmp_dir, "a.jsonl", ['{"text": "x"}', "", "  ", '{"text": "y"}'])
    write(tmp_dir, "b.jsonl", ['{"text": "%d"}' % i for i in range(3000)] + ['{"text": "cut', "later too {"])
    with pytest.raises(readers.MalformedLine) as error:
        readers.read_jsonl(spark, tmp_dir, mode="FAILFAST")
    assert error.value.line == 3001 and error.value.file.endswith("b.jsonl") and "line 3001" in str(error.value)
    good = {r.text for r in readers.read_jsonl(spark, os.path.join(tmp_dir, "a.jsonl"), mode="FAILFAST").collect()}
    assert good == {"x", "y"}


def test_line_numbers_over_splits(spark, tmp_dir):
    write(tmp_dir, "a.jsonl", [f"line {i} " + "x" * (i % 90) for i in range(1, 4000)])
    write(tmp_dir, "b.json", ["", "one"])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = readers.numbered_lines(spark, tmp_dir)
        got = {(os.path.basename(r.file), r.line): r.value for r in rows.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(got) == 4001 and all(v.startswith(f"line {n} ") for (f, n), v in got.items() if f == "a.jsonl")
    assert got[("b.json", 1)] == "" and got[("b.json", 2)] == "one"


def test_a_failing_source_is_skipped_and_told(spark, tmp_dir):
    write(tmp_dir, "a.jsonl", ['{"text": "x"}'])
    os.mkdir(os.path.join(tmp_dir, "bad"))
    write(os.path.join(tmp_dir, "bad"), "b.jsonl", ["{oops"])
    specs = [readers.SourceSpec("good", os.path.join(tmp_dir, "a.jsonl")), readers.SourceSpec("bad", os.path.join(tmp_dir, "bad"), options={"mode": "FAILFAST"}),
             readers.SourceSpec("gone", os.path.join(tmp_dir, "none")), readers.SourceSpec("odd", tmp_dir, "no such type")]
    errors = {}
    assert readers.load_all(spark, specs, errors).count() == 1
    assert set(errors) == {"bad", "gone", "odd"} and "line 1" in errors["bad"]
    with pytest.raises(readers.SourceError):
        readers.load_all(spark, specs[1:])


def test_the_last_path_comes_from_the_last_files(spark, tmp_dir, monkeypatch):
    write(tmp_dir, "log-1.jsonl", ['{"sampler_path": "old"}'])
    write(tmp_dir, "log-2.jsonl", ['{"sampler_path": "s1"}', '{"sampler_path": "s2"}', "{bad", '{"sampler_path": ""}'])
    write(tmp_dir, "log-3.jsonl", ['{"other": 1}', ""])
    assert readers.last_sampler_path(spark, tmp_dir).first()["sampler_path"] == "s2"
    opened, real = [], readers.last_sampler_path_of
    monkeypatch.setattr(readers, "last_sampler_path_of", lambda lines, *a, **k: opened.extend(lines.inputFiles()) or real(lines, *a, **k))
    readers.last_sampler_path(spark, tmp_dir)
    assert sorted(os.path.basename(f) for f in opened) == ["log-2.jsonl", "log-3.jsonl"]
    os.mkdir(os.path.join(tmp_dir, "none"))
    write(os.path.join(tmp_dir, "none"), "x.jsonl", ["{}"])
    assert readers.last_sampler_path(spark, os.path.join(tmp_dir, "none")).first()["sampler_path"] is None
