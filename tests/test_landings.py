"""Landed result trees with pruned languages and a quarantine; reference texts read in byte ranges."""
import os
import random

from pyspark.sql import functions as F

from evalspark.operators import outcomes
from evalspark.sources import files

GOOD = '{"tests_outcomes": [false, 1], "prompt_tokens": 7}'
ROWS = [("2024-01-01-00-00-00--m", "python", "a", GOOD), ("2024-01-01-00-00-00--m", "python", "b", "{}"), ("2024-01-01-00-00-00--m", "go", "007", "{bad"),
        ("2024-02-01-00-00-00--m", "go", "x y", GOOD), ("2024-02-01-00-00-00--m", "rust", "1", GOOD), ("2024-02-01-00-00-00--m", "c/c++=", "é", GOOD)]


def land(spark, root):
    files.land_exercise_results(spark.createDataFrame(ROWS, "run string, language string, exercise string, value string"), root)


def test_languages_prune_folders(spark, tmp_path):
    root = str(tmp_path / "landing")
    land(spark, root)
    raw = files.landed_results(spark, root, " go, python ,go")
    assert sorted((r["language"], r["exercise"]) for r in raw.collect()) == [("go", "007"), ("go", "x y"), ("python", "a"), ("python", "b")]
    assert "PartitionFilters: [language" in raw._jdf.queryExecution().toString().replace("isnotnull(language", "language")
    assert len(raw.inputFiles()) >= 4
    everything = files.landed_results(spark, root)
    assert sorted(r["exercise"] for r in everything.collect()) == ["007", "1", "a", "b", "x y", "é"]
    assert sum(r["done"] for r in outcomes.count_done(raw).collect()) == 4


def test_records_and_quarantine_are_written_in_one_pass(spark, tmp_path):
    root, out = str(tmp_path / "landing"), str(tmp_path / "out")
    land(spark, root)
    for _ in range(2):
        files.ingest_results(files.landed_results(spark, root, "go,python"), out)
    assert sorted(d for d in os.listdir(out) if d.startswith("kind=")) == ["kind=records", "kind=rejects"]
    rec = {r["exercise"]: r for r in files.ingested(spark, out, "records").collect()}
    assert set(rec) == {"a", "x y"} and rec["a"]["tests_outcomes"] == [False, True] and rec["a"]["prompt_tokens"] == 7
    bad = {r["exercise"]: (r["reason"], r["value"].strip()) for r in files.ingested(spark, out, "rejects").collect()}
    assert bad == {"b": ("empty", "{}"), "007": ("unreadable", "{bad")}


def test_landing_again_replaces_a_file(spark, tmp_path):
    root = str(tmp_path / "landing")
    land(spark, root)
    files.land_exercise_results(spark.createDataFrame([(*ROWS[1][:3], GOOD)], "run string, language string, exercise string, value string"), root)
    rec = files.exercise_results(files.landed_results(spark, root, "python")).collect()
    assert sorted(r["exercise"] for r in rec) == ["a", "b"] and files.landed_results(spark, root).count() == len(ROWS)


def test_reference_counts_equal_a_lenient_decode(spark, tmp_path):
    r = random.Random(1)
    parts = [b"abc", b" ", "é".encode(), b"\xff", b"\xe2\x82", b"\n", b"\r\n", b"\r", "�".encode(), b" ", "😀".encode(), b"\xf0\x9f", b"  "]
    for i in range(30):
        data = b"".join(r.choice(parts) for _ in range(r.randrange(1, 400)))
        (tmp_path / f"f{i}.txt").write_bytes((b"\xef\xbb\xbf" if i % 10 == 3 else b"") + data)
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for split in ("100", size):
            spark.conf.set("spark.sql.files.maxPartitionBytes", split)
            got = {os.path.basename(x["path"]): (x["n_chars"], x["est_tokens"]) for x in files.reference_counts(files.reference_pieces(spark, str(tmp_path))).collect()}
            for i in range(30):
                text = (tmp_path / f"f{i}.txt").read_text(encoding="utf-8", errors="ignore")
                assert got[f"f{i}.txt"] == (len(text), len(text) // 4)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_reference_pieces_are_no_longer_than_the_text_between_spaces(spark, tmp_path):
    (tmp_path / "ref.txt").write_bytes(b"one \xfftwo\r\nlines \xef\xbf\xbdthree")
    rows = files.reference_pieces(spark, str(tmp_path / "ref.txt")).collect()
    assert [x["text"] for x in rows] == ["one", "two\nlines", "�three"] and [x["n_chars"] for x in rows] == [3, 9, 6]
    assert files.reference_pieces(spark, str(tmp_path)).agg(F.max("n_bytes")).first()[0] < 12


def test_files_are_made_by_many_tasks(spark):
    rows = spark.range(40).selectExpr("string(id) AS file", "'x' AS value")
    few = rows.groupBy("file").agg(F.first("value").alias("value"))
    assert few.rdd.getNumPartitions() == 1
    assert files.spread_files(few, "file").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1


def test_landed_results_opens_no_file_only_to_count_it(spark, tmp_path, monkeypatch):
    from evalspark.plans import catalog
    rows = [(k, k % 25, float(k % 3 - 1)) for k in range(1, 40)]
    spark.createDataFrame(rows, "s_suppkey bigint, s_nationkey int, s_acctbal double").write.parquet(str(tmp_path / "supplier.parquet"))
    out = catalog.q_landed_results(spark, str(tmp_path))
    assert not [f for f in out.inputFiles() if "/landing/" in f]
    assert sum(r["done"] for r in out.collect()) == sum(1 for _, n, _ in rows if n % 4 in (0, 2))


def test_folders_are_listed_many_at_a_time(spark, tmp_path):
    for i in range(60):
        (tmp_path / f"file={i}").mkdir()
        (tmp_path / f"file={i}" / "log.txt").write_text(f"Final estimate: PPL = {i}.5")
    before, tracker = spark.conf.get(files._LISTING), spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("listing", "listing")
    try:
        logs = files.read_ppl_logs(spark, str(tmp_path / "*"))
        stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("listing") for s in tracker.getJobInfo(j).stageIds]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert stages and max(s.numTasks for s in stages) <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert logs.count() == 60 and spark.conf.get(files._LISTING) == before
