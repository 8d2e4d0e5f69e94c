"""The catalogue log over several runs."""

import json

import pytest
from conftest import SMALL, values
from repoloom.plans.queries import QUERIES
from repoloom.streaming import catalogue as streams


def test_log_survives_a_lost_checkpoint_and_compaction(spark, tmp_path):
    log = str(tmp_path / "log")
    body = lambda v: json.dumps({"tree": {"name": f"n{v}"}})
    for run, rows in enumerate([[("a", 1), ("b", 1)], [("a", 3)], [("a", 2), ("c", 1)]]):
        source = str(tmp_path / f"in{run}")
        table = spark.createDataFrame([(r, v, body(v)) for r, v in rows], "repo string, version int, body string")
        table.write.parquet(source)
        stream = spark.readStream.schema(table.schema).parquet(source)
        # A new checkpoint each time: batches are numbered from the start again.
        streams.stream_catalogue(stream, log, str(tmp_path / f"c{run}")).awaitTermination()
    want = [("a", 3, body(3)), ("b", 1, body(1)), ("c", 1, body(1))]
    assert values(streams.current_catalogues(spark, log), "repo", "version", "body") == want
    streams.compact_log(spark, log)
    assert len([p for p in (tmp_path / "log").iterdir() if p.is_dir()]) == 1
    assert values(streams.current_catalogues(spark, log), "repo", "version", "body") == want


def test_keyed_state_drops_replays_and_older_versions(spark, tmp_path):
    log, source = str(tmp_path / "log"), tmp_path / "in"
    body = lambda v: json.dumps({"tree": {"name": f"n{v}"}})
    arrivals = [
        [("a", 1), ("b", 5), ("a", 2)], [("a", 2), ("b", 4)], [("a", 1), ("c", 1)], [("a", 7), ("b", 5)], [("a", 6), ("d", None)],
    ]
    kind = "repo string, version int, body string"
    tables = [spark.createDataFrame([(r, v, body(v)) for r, v in rows], kind) for rows in arrivals]
    tables[3] = tables[3].union(spark.createDataFrame([("a", 99, "{broken"), ("c", 9, "{}")], kind))

    def run(checkpoint):
        stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(source / "*"))
        streams.stream_newest(stream, log, str(tmp_path / checkpoint)).awaitTermination()
        return values(streams.current_catalogues(spark, log), "repo", "version")

    for i, table in enumerate(tables):
        table.coalesce(1).write.parquet(str(source / str(i)))
        if i == 2:
            assert run("c") == [("a", 2), ("b", 5), ("c", 1)]
    want = [("a", 7), ("b", 5), ("c", 1)]
    assert run("c") == want
    logged = values(spark.read.option("recursiveFileLookup", "true").parquet(log), "repo", "version")
    assert logged == [("a", 2), ("a", 7), ("b", 5), ("c", 1)]
    assert run("lost") == want


@pytest.mark.parametrize("query", ["w1_stream_catalogue", "w1_stream_newest", "w2_stream_marks", "w2_stream_tags"])
def test_a_table_may_be_a_folder_of_files(spark, tmp_path, query):
    for table in ("pages", "documents"):
        spark.read.parquet(f"{SMALL}/{table}.parquet").repartition(3).write.parquet(str(tmp_path / f"{table}.parquet"))
    assert values(QUERIES[query](spark, str(tmp_path))) == values(QUERIES[query](spark, SMALL))
