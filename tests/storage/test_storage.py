import pytest
from pyspark.sql import functions as F

from tallyspark.storage import ordered, pages
from tallyspark.storage.versions import Conflict, Versions


def test_pages_equal_offsets_and_read_few_ranges(spark, tmp_path):
    rows = spark.range(5000).select(F.col("id"), (F.col("id") * 7919 % 101).alias("v"), F.when(F.col("id") % 3 > 0, F.col("id") % 13).alias("w"))
    order, path = [F.col("v").desc_nulls_last(), F.col("w").asc_nulls_first(), F.col("id")], str(tmp_path / "pages")
    pages.write(rows, order, path, ranges=11)
    want = [tuple(r) for r in rows.orderBy(*order).collect()]
    for number, size in [(1, 10), (2, 999), (250, 20), (251, 20), (7, 400), (1, 5000), (3, 0), (0, 5)]:
        start = max(0, number - 1) * size
        assert [tuple(r) for r in pages.page(spark, path, order, number, size).collect()] == want[start : start + size], (number, size)
    files = pages.page(spark, path, order, 120, 20).inputFiles()
    assert len({f.rpartition("range=")[2].partition("/")[0] for f in files}) <= 2
    assert pages.pagination(spark, path, 2, 30) == {"total": 5000, "page": 2, "page_size": 30, "pages": 167}


def test_pages_of_an_empty_table(spark, tmp_path):
    rows, path = spark.range(0), str(tmp_path / "none")
    pages.write(rows, [F.col("id")], path)
    assert pages.pagination(spark, path, 1, 10)["total"] == 0 and pages.page(spark, path, [F.col("id")], 1, 10).collect() == []


@pytest.mark.parametrize("buckets", [4, 7])
def test_ordered_tables_meet_without_a_shuffle(spark, tmp_path, buckets):
    docs = spark.range(40).select(F.col("id").alias("document_id"), F.concat(F.lit("f"), "id").alias("file_path"))
    values = spark.range(300).select((F.col("id") % 37).alias("document_id"), "id")
    checks = spark.range(90).select((F.col("id") % 31).alias("document_id"), F.when(F.col("id") % 2 == 0, "ERROR").otherwise("VALID").alias("status"))
    names = [f"t{buckets}_{n}" for n in ("docs", "vals", "chks")]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name, rows, order in zip(names, (docs, values, checks), (("file_path",), ("id",), ("status",)), strict=True):
            ordered.save(rows, name, order=order, buckets=buckets, path=str(tmp_path / name))
        counts, files = ordered.document_counts(spark, *names), ordered.with_files(spark, names[1], names[0])
        for df in (counts, files):
            assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
        assert {r.document_id: (r.n_values, r.n_findings) for r in counts.collect()} == {d: (len([i for i in range(300) if i % 37 == d]), len([i for i in range(0, 90, 2) if i % 31 == d])) for d in range(40)}
        assert files.count() == 300
        assert [r.id for r in ordered.read_in_order(spark, names[1], [5]).collect()] == list(range(5, 300, 37))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        for name in names:
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_tables_are_replaced_together_or_not_at_all(spark, tmp_path):
    store = Versions(spark, str(tmp_path / "store"))
    rows = lambda what, ids: spark.createDataFrame([(i, what) for i in ids], "document_id long, what string")
    assert store.last() == 0 and store.tables() == {}
    store.publish({"pages": rows("p", range(6)), "values": rows("v", range(6)), "checks": rows("c", range(6))})
    first = store.read("values")
    bad = rows("x", [1]).withColumn("what", F.raise_error(F.lit("lost")))
    for broken in ({"pages": bad, "values": rows("v2", [1])}, {"pages": rows("p2", [1]), "values": bad}, {"values": rows("v2", [1]), "checks": bad}):
        with pytest.raises(Exception, match="lost"):
            store.replace(broken)
        assert store.last() == 1 and {r.what for n in ("pages", "values", "checks") for r in store.read(n).collect()} == {"p", "v", "c"}
    assert store.replace({"values": rows("v2", [1, 9]), "checks": rows("c2", [1])}) == 2
    assert sorted(tuple(r) for r in store.read("values").collect()) == [(0, "v"), (1, "v2"), (2, "v"), (3, "v"), (4, "v"), (5, "v"), (9, "v2")]
    assert {r.what for r in store.read("pages").collect()} == {"p"} and {r.what for r in first.collect()} == {"v"}  # readers keep their version
    with pytest.raises(Conflict):
        store.publish({"pages": rows("late", [1])}, base=1)
    assert {r.what for r in store.read("pages").collect()} == {"p"}
    store.drop_before(2)
    assert store.read("checks").count() == 6 and store.read("pages").count() == 6
