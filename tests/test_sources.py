"""Readers, writers and the cache on small files."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from ratiocert.session import scratch_path, shared_dir
from ratiocert.sources import cache, readers, writers


def test_unreadable_runs_are_reported(spark, tmp_path):
    df = spark.range(10).select("id", F.concat(F.lit("r"), F.col("id") % 2).alias("run_id"))
    root = str(tmp_path / "runs")
    writers.write_scores(df, root)
    (tmp_path / "runs" / "run_id=bad").mkdir()
    (tmp_path / "runs" / "run_id=bad" / "part.parquet").write_bytes(b"PAR1 broken")
    with pytest.raises(Exception, match="not a Parquet file"):
        readers.score_runs(spark, root).count()
    found, unread = readers.readable_runs(spark, [f"{root}/run_id={r}" for r in ("r0", "bad", "r1", "none")])
    assert found.count() == 10
    assert {(r["path"].rsplit("=")[-1], r["bytes"]) for r in unread.collect()} == {("bad/part.parquet", 11), ("none", None)}
    one = readers.score_runs(spark, root, df.schema).where("run_id = 'r1'")
    assert "PartitionFilters: [isnotnull(run_id" in one._jdf.queryExecution().toString()


def test_one_bad_file_of_four_costs_itself(spark, tmp_path):
    root = tmp_path / "runs"
    for i in range(4):
        spark.range(i * 5, i * 5 + 5, 1, 1).write.parquet(str(root / str(i)))
    damaged = next((root / "2").glob("part-*"))
    damaged.write_bytes(damaged.read_bytes()[:-9])
    (next((root / "2").glob(".part-*.crc"))).unlink()
    found, unread = readers.readable_runs(spark, [str(root / str(i)) for i in range(4)])
    assert sorted(r["id"] for r in found.collect()) == [*range(10), *range(15, 20)]
    assert [r["path"].rsplit("/", 2)[1:] for r in unread.collect()] == [["2", damaged.name]]
    assert {r["folder"].rsplit("/", 1)[1] for r in found.collect()} == {"0", "1", "3"}
    none, every = readers.readable_runs(spark, [str(root / "2"), str(root / "9")])
    assert none is None and every.count() == 2


def test_many_folders_take_the_jobs_of_one(spark, tmp_path):
    import shutil

    spark.range(1).coalesce(1).write.parquet(str(tmp_path / "one"))
    file = next((tmp_path / "one").glob("part-*"))
    for i in range(300):
        (tmp_path / f"f{i}").mkdir()
        shutil.copy(file, tmp_path / f"f{i}" / "x.parquet")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("folders", "folders")
    found, unread = readers.readable_runs(spark, [str(tmp_path / f"f{i}") for i in range(300)])
    assert found.count() == 300 and unread.count() == 0
    jobs = len(tracker.getJobIdsForGroup("folders"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < jobs < 20


def test_runs_are_stacked_by_name(spark, tmp_path):
    spark.range(3).select("id", F.lit(1.0).alias("a")).write.parquet(str(tmp_path / "runs" / "run_id=x"))
    spark.range(2).select(F.lit("t").alias("b"), "id").write.parquet(str(tmp_path / "runs" / "run_id=y"))
    for runs in (readers.score_runs(spark, str(tmp_path / "runs")), readers.readable_runs(spark, [str(tmp_path / "runs" / f"run_id={r}") for r in "xy"])[0]):
        assert {"id", "a", "b"} <= set(runs.columns) and runs.count() == 5 and runs.where("b = 't' AND a IS NULL").count() == 2


def test_json_documents(spark, tmp_path):
    doc = {"config": {"k": "4"}, "results": [{"abstained": False, "num_samples": 2, "generated_text": "a\nb"}, {"abstained": True}], "metrics": {"m": 1.0}}
    (tmp_path / "r.json").write_text(json.dumps(doc, indent=2))
    rows = readers.gate_results(spark, str(tmp_path / "r.json")).orderBy("idx").collect()
    assert [(r["idx"], r["abstained"], r["num_samples"]) for r in rows] == [(0, False, 2), (1, True, None)]
    (tmp_path / "p.json").write_text(json.dumps({"data": [{"prompt": "p", "response": "r"}]}, indent=1))
    assert [tuple(r) for r in readers.prompt_responses(spark, str(tmp_path / "p.json")).collect()] == [(0, "p", "r")]


def test_lines_and_categories(spark, tmp_path):
    (tmp_path / "a.txt").write_text("  one \n\ntwo three\nfour\n")
    got = [r[0] for r in readers.text_lines(spark, str(tmp_path / "a.txt"), 5, 3).collect()]
    assert got == ["one", "", "two t"]
    assert readers.whole_texts(spark, str(tmp_path / "a.txt")).first()["text"].startswith("  one")
    (tmp_path / "categories.txt").write_text("Gene\nBrain \nPain\n")
    (tmp_path / "run").mkdir()
    got = readers.category_list(spark, str(tmp_path / "run")).orderBy("idx").collect()
    assert [tuple(r) for r in got] == [("Gene", 0), ("Brain", 1), ("Pain", 2)]
    with pytest.raises(FileNotFoundError):
        readers.category_list(spark, str(tmp_path / "run"), "none.txt")


def test_tables_round_trip(spark, tmp_path):
    t = spark.createDataFrame([(1, -3.0, 0.5, 0.5, 0.5, 1.0, 2.0, 3.0)], "T int, log10_eps double, k_min double, k_mid double, k_max double, cr_10 double, cr_median double, cr_90 double")
    writers.write_tsv(t, str(tmp_path / "eps"))
    back = readers.eps_table(spark, str(tmp_path / "eps")).first()
    assert (back["k"], back["log10_cr_90"], back["T"]) == (0.5, 3.0, 1)


def test_splits_and_manifest(spark, tmp_path):
    pairs = spark.createDataFrame([(1, "train", "b a", "a b"), (2, "val", "c a", "a c")], "id int, split string, input string, answer string")
    writers.write_splits(pairs, str(tmp_path / "out"), "id")
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "out/all_text")).collect()) == ["b a a b", "c a a c"]
    digests = {r["file"]: r["md5"] for r in writers.manifest(spark, str(tmp_path / "out")).collect()}
    for path in (tmp_path / "out").rglob("part-*"):
        assert digests[path.name] == hashlib.md5(path.read_bytes()).hexdigest()


def test_digests_of_any_file(spark, tmp_path):
    import gzip

    folder = tmp_path / "files"
    (folder / "deep").mkdir(parents=True)
    files = {
        "a.txt": b"one\ntwo\n", "b.txt": b"no end", "c.bin": bytes(range(256)) * 5000, "d.txt": b"\r\n\n\n", "e.txt": b"", "f.txt": b"\n",
        "deep/g.txt": b"x" * 3_000_000 + b"\n" + b"y" * 100, "h.txt.gz": gzip.compress(b"packed\n" * 100),
    }
    for name, data in files.items():
        (folder / name).write_bytes(data)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = {r["file"]: (r["bytes"], r["md5"]) for r in writers.manifest(spark, str(folder)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {name.split("/")[-1]: (len(data), hashlib.md5(data).hexdigest()) for name, data in files.items()}


def test_corpora_of_three_shapes(spark, tmp_path):
    docs = [
        {"id": "5733be", "title": "Gene", "context": "c", "question": "q1", "answers": {"text": ["a", "b"], "answer_start": [1, 2]}},
        {"pubid": 7, "question": "q2", "context": {"contexts": ["x", "y"], "labels": []}, "long_answer": "la", "final_decision": "maybe"},
        {"question": "q3", "task": "anatomy", "choices": ["w", "x", "y", "z"], "answer": 2},
        {"question": "q4", "subject": "virology", "choices": ["w"], "answer": 9},
        {"question": "q5", "context": None},
    ]
    (tmp_path / "all.json").write_text("\n".join(map(json.dumps, docs)))
    rows = {r["question"]: r for r in readers.qa_documents(spark, str(tmp_path / "all.json")).collect()}
    assert [(r["shape"], r["subject"], r["contexts"], r["answers"], r["choices"], r["decision"]) for _, r in sorted(rows.items())] == [
        ("extract", "Gene", ["c"], ["a", "b"], [], None), ("judged", None, ["x", "y"], ["la"], [], "maybe"),
        ("choices", "anatomy", [], ["y"], ["w", "x", "y", "z"], None), ("choices", "virology", [], [], ["w"], None),
        ("extract", None, [], [], [], None),
    ]
    assert rows["q1"]["id"] == "5733be" and rows["q3"]["answer_idx"] == 2


def test_cache_is_reused(spark, tmp_path):
    calls = []

    def make():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        assert cache.cached(spark, str(tmp_path), "x", {"a": 1}, make).count() == 3
    cache.cached(spark, str(tmp_path), "x", {"a": 2}, make)
    assert len(calls) == 2


def test_shared_folder_is_stable(spark):
    assert shared_dir(spark) == shared_dir(spark)
    assert scratch_path(spark, "x") != scratch_path(spark, "x")
