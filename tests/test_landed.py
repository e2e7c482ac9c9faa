"""Landed files and their manifest."""

import json

import pytest
from pyspark.sql import functions as F

from factpanel.sources import facts, landed, manifest


@pytest.fixture
def folder(tmp_path):
    """Documents by key, some in folders of their own, one large, one without a key."""
    for i in range(1, 9):
        at = tmp_path / "landed" / (f"part{i % 2}" if i < 6 else f"file=CIK{i:010d}.json")
        at.mkdir(parents=True, exist_ok=True)
        text = json.dumps({"cik": i, "facts": {}}) + " " * (5000 if i == 4 else 0)
        (at / (f"CIK{i:010d}.json" if i < 6 else "part-00000-x.txt")).write_text(text)
    (tmp_path / "landed" / "readme.txt").write_text("no key")
    return str(tmp_path / "landed")


def test_listing_and_reading(spark, folder):
    listed = landed.list_files(spark, folder)
    assert "content" not in listed.columns
    assert sorted(r["file_key"] or "" for r in listed.collect()) == ["", *[f"{i:010d}" for i in range(1, 9)]]
    wanted = spark.createDataFrame([("1",), ("0000000004",), ("CIK7",), ("77",), ("77",), (None,)], "cik10 string")
    want = {"0000000001": None, "0000000004": "too_large", "0000000007": None, "0000000077": "missing"}
    for limit in (10_000, 1):  # keys in the scan's filter, and joined
        landed.KEYS_IN_FILTER, before = limit, landed.KEYS_IN_FILTER
        try:
            rows = landed.read_files(spark, folder, keys=wanted, largest=4000).collect()
        finally:
            landed.KEYS_IN_FILTER = before
        assert {r["file_key"]: r["problem"] for r in rows} == want and len(rows) == len(want)
        assert all((r["text"] is None) == (r["problem"] is not None) for r in rows)
    every = landed.read_files(spark, folder)
    assert every.count() == 9 and every.where("problem is not null").isEmpty()
    assert facts.open_documents(every.where("file_key is not null")).where("status = 'ok'").count() == 8


def test_files_are_pruned_before_they_are_opened(spark, folder):
    """The scan's own count of files, with the keys in its filter."""
    kept = spark.read.option("recursiveFileLookup", "true").text(folder, wholetext=True).where(landed.file_key(F.col("_metadata.file_path")).isin(["0000000001", "0000000007"]))
    assert len(kept.collect()) == 2
    nodes = [kept._jdf.queryExecution().executedPlan()]
    while nodes:
        node = nodes.pop()
        nodes += [node.children().apply(i) for i in range(node.children().size())]
        if "Scan" in node.nodeName() and node.metrics().contains("numFiles"):
            assert node.metrics().apply("numFiles").value() == 2
            return
    raise AssertionError("no scan")


def rows_of(docs):
    return docs.select(F.col("file_key").alias("key"), F.explode(F.split("text", " ")).alias("word"))


def test_only_changes_are_computed(spark, tmp_path):
    folder, built = str(tmp_path / "panel"), []

    def build(docs):
        built.append(sorted(r["file_key"] for r in docs.select("file_key").distinct().collect()))
        return rows_of(docs)

    def load(**texts):
        docs = spark.createDataFrame([(k, t) for k, ts in texts.items() for t in (ts if isinstance(ts, list) else [ts])] + [(None, "no key")], "file_key string, text string")
        found = {r["key"]: r["state"] for r in manifest.refresh(spark, folder, docs, build).collect()}
        now = sorted((r["key"], r["word"], r["version"]) for r in manifest.current(spark, folder).collect())
        return found, now

    assert load(a="x y", b="z", c=["1", "2"]) == (dict.fromkeys("abc", "new"), [("a", "x", 1), ("a", "y", 1), ("b", "z", 1), ("c", "1", 1), ("c", "2", 1)])
    found, now = load(a="x y", b="changed", d="d", c=["2", "1"])
    assert found == {"a": "unchanged", "b": "changed", "c": "unchanged", "d": "new"}
    assert now == [("a", "x", 1), ("a", "y", 1), ("b", "changed", 2), ("c", "1", 1), ("c", "2", 1), ("d", "d", 2)]
    # a run that breaks off before its manifest leaves what was there, and the next one takes its number
    spark.createDataFrame([("a", "half")], "key string, word string").write.parquet(f"{folder}/rows/version=3")
    assert sorted(r["word"] for r in manifest.current(spark, folder).collect()) == sorted(w for _, w, _ in now)
    found, now = load(b="changed", c=["2", "1"], d="d")
    assert found == {"a": "vanished", "b": "unchanged", "c": "unchanged", "d": "unchanged"}
    assert now == [("b", "changed", 2), ("c", "1", 1), ("c", "2", 1), ("d", "d", 2)]
    assert load(a="x y", b="changed", c=["2", "1"], d="d")[1][:2] == [("a", "x", 4), ("a", "y", 4)]
    assert built == [["a", "b", "c"], ["b", "d"], [], ["a"]]


def test_nothing_landed(spark, tmp_path):
    none = spark.createDataFrame([], "file_key string, text string")
    assert manifest.refresh(spark, str(tmp_path / "p"), none, rows_of).count() == 0
    assert manifest.current(spark, str(tmp_path / "p")).count() == 0


def test_many_files_are_written_and_listed_by_tasks(spark, tmp_path):
    """The tasks of a write grow with the files, each file holds its text, and a folder for each file isn't a task for each."""
    folder = str(tmp_path / "written")
    texts = {f"CIK{i:010d}.json": "a\n b" * (i % 3) for i in range(1, 61)}
    landed.write_files(spark.createDataFrame(list(texts.items()), "file string, value string"), folder, each=6)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("listing", "")
    try:
        rows = landed.read_files(spark, folder).select("source_file", "file_key", "text")
        jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup("listing")]
        tasks = [tracker.getStageInfo(s).numTasks for job in jobs for s in job.stageIds]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert tasks and max(tasks) <= 4 * spark.sparkContext.defaultParallelism
    assert spark.conf.get(landed.LISTING_TASKS) == "10000"
    rows = rows.collect()
    assert {f"CIK{r['file_key']}.json": (r["text"] or "").removesuffix(" ") for r in rows} == texts and len(rows) == 60
    assert len({r["source_file"].split("/part-")[1][:5] for r in rows}) > 5
