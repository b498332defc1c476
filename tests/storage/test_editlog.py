import random

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import edits
from tallyspark.storage.editlog import EditLog
from tallyspark.storage.versions import Conflict

SCHEMA = "document_id long, year int, ts long, id long, new double, old double, undo boolean"


def made(n, seed=3):
    rng = random.Random(seed)
    return [(rng.randrange(12), rng.choice([None, 2020, 2021]), rng.randrange(40), i, None if (u := rng.random() < 0.3) else rng.random(), rng.random(), u) for i in range(n)]


def test_state_is_the_whole_logs_fold_and_reads_the_tail_only(spark, tmp_path):
    rows = made(240)
    log = EditLog(spark, str(tmp_path / "log"), ["document_id", "year"], "ts", "new", "old", F.col("undo"))
    with pytest.raises(ValueError, match="no batch"):
        log.state()
    for k in range(6):
        log.append(spark.createDataFrame(rows[k * 40 : (k + 1) * 40], SCHEMA).coalesce(1))
        if k in (1, 4):
            log.compact()
        whole = spark.createDataFrame(rows[: (k + 1) * 40], SCHEMA)
        want = edits.fold(whole, ["document_id", "year"], "ts", "new", "old", F.col("undo")).collect()
        assert sorted(map(tuple, log.state().collect()), key=str) == sorted(map(tuple, want), key=str), k
    folders = {f.rpartition("/data/")[2].split("/")[1] for f in log.state().inputFiles()}
    assert folders == {"snapshot", "tail-000000008"}  # of six batches five are in the snapshot


def test_a_batch_that_comes_in_while_the_log_is_compacted_stays(spark, tmp_path, monkeypatch):
    log = EditLog(spark, str(tmp_path / "log"), ["document_id", "year"], "ts", "new", "old", F.col("undo"))
    log.append(spark.createDataFrame(made(20), SCHEMA))
    last, seen = log.store.last, log.store.last()
    log.append(spark.createDataFrame(made(20, 4), SCHEMA))
    monkeypatch.setattr(log.store, "last", lambda: seen)
    with pytest.raises(Conflict):
        log.compact()
    monkeypatch.setattr(log.store, "last", last)
    assert log.all_keys().agg(F.sum("edits")).first()[0] == 40
