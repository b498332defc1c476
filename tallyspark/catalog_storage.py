"""Registered queries over stored tables, facets, edits and registers, and the SQL each must agree with."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tallyspark.catalog import _SUMS, READINGS, order_checks, query, readings, table
from tallyspark.operators import edits, grid
from tallyspark.plans import exports
from tallyspark.sources import filings
from tallyspark.storage import ordered, pages
from tallyspark.storage.editlog import EditLog
from tallyspark.storage.versions import Versions
from tallyspark.streaming.ingest import shared_dir
from tallyspark.streaming.lifecycle import CHANGES, lifecycle

_RAW = """CASE event_id % 6 WHEN 0 THEN event_id || '.25' WHEN 1 THEN '-' || format('{:,}', event_id * 1234) WHEN 2 THEN 'x' || event_id WHEN 3 THEN '(' || event_id || ')' WHEN 4 THEN '9007199254740993' ELSE CAST(event_id AS VARCHAR) END"""


@query(f"""SELECT event_id, CASE WHEN event_id % 4 > 0 THEN 2020 END AS year, {_RAW} AS raw, event_id % 6 IN (0, 1, 5) AS admitted,
    CASE event_id % 6 WHEN 0 THEN event_id + 0.25 WHEN 1 THEN event_id * -1234.0 WHEN 5 THEN event_id * 1.0 END::DOUBLE AS new_value FROM events""")
def admitted_edits(spark, sf):
    """Every edit once, among the admitted or the rejected ones; a quarter has no year."""
    n = F.col("event_id")
    raw = F.when(n % 6 == 0, F.concat(n, F.lit(".25"))).when(n % 6 == 1, F.concat(F.lit("-"), F.format_number((n * 1234).cast("double"), 0))).when(n % 6 == 2, F.concat(F.lit("x"), n))
    raw = raw.when(n % 6 == 3, F.concat(F.lit("("), n, F.lit(")"))).when(n % 6 == 4, "9007199254740993").otherwise(n.cast("string"))
    good, bad = edits.admit(table(spark, sf, "events").select(n, F.when(n % 4 > 0, 2020).alias("year"), raw.alias("raw")))
    good = good.select("event_id", "year", "raw", F.lit(True).alias("admitted"), F.col("new_value").cast("double").alias("new_value"))
    return good.unionByName(bad.select("event_id", "year", "raw", F.lit(False).alias("admitted"), F.lit(None).cast("double").alias("new_value")))


@query("""WITH e AS (SELECT event_id, event_id % 100000 AS k FROM events) SELECT event_id,
    CASE WHEN k % 7 = 0 THEN 'no json 1.23456' ELSE '{"a":{"v":' || k || '.123,"t":"1.23456 \\" 2.34567"}, "l":[[' || k || '.988,2],{"deep":[-' || k || '.5]},null,true],"x":-' || k || '}' END AS metrics FROM e""")
def metrics_json(spark, sf):
    """Nested metrics; every seventh text is no JSON."""
    k = (F.col("event_id") % 100000).cast("string")
    text = F.concat(F.lit('{"a":{"v":'), k, F.lit('.12345,"t":"1.23456 \\" 2.34567"}, "l":[['), k, F.lit('.98765,2],{"deep":[-'), k, F.lit('.5]},null,true],"x":-'), k, F.lit("}"))
    rows = table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 100000 % 7 == 0, "no json 1.23456").otherwise(text).alias("metrics"))
    return exports.rounded_metrics(rows)


@query("""SELECT 'S' || s_suppkey AS code, s_name AS name, make_date(CAST(1970 + s_suppkey % 50 AS INTEGER), 12, 9) AS listed_on FROM supplier WHERE s_suppkey % 5 > 0 AND s_suppkey % 3 > 0""")
def register_rows(spark, sf):
    """A register of three columns: nameless rows and rows without a date are left out."""
    s = F.col("s_suppkey")
    day = F.when(s % 3 > 0, F.concat(F.lit("09 Des "), (F.lit(1970) + s % 50).cast("string"))).otherwise("belum tercatat")
    raw = table(spark, sf, "supplier").select(F.concat(F.lit("S"), s).alias("kode"), F.when(s % 5 > 0, F.col("s_name")).alias("nama"), day.alias("tanggal"))
    return filings.listing_register(raw)


_FACETS = {"company": "contains(lower(company), 'c1')", "year": "year = 1996", "currency": "currency = 'IDR'", "field": "field IN ('F', 'O')", "confidence": "confidence >= 0.8"}
_BESIDE = lambda own: " AND ".join(c for n, c in _FACETS.items() if n != own)


@query(f"""WITH {READINGS}, c AS (
    SELECT 'currency' AS facet, coalesce(currency, 'none') AS value, count(*) AS n FROM readings WHERE coalesce({_BESIDE("currency")}, false) GROUP BY 2
    UNION ALL SELECT 'field', field, count(*) FROM readings WHERE coalesce({_BESIDE("field")}, false) GROUP BY 2
    UNION ALL SELECT 'year', CAST(year AS VARCHAR), count(*) FROM readings WHERE coalesce({_BESIDE("year")}, false) GROUP BY 2
    UNION ALL SELECT 'all', field, count(*) FROM readings WHERE coalesce({_BESIDE("")}, false) GROUP BY 2)
    SELECT * FROM c UNION ALL SELECT 'currency', v, 0 FROM (VALUES ('eur'), ('idr')) s(v) WHERE NOT EXISTS (SELECT 1 FROM c WHERE facet = 'currency' AND lower(value) = v)""")
def grid_facets(spark, sf):
    """Five filters and four facets, each beside all filters but its own."""
    filters = {
        "company": grid.contains("company", "C1"), "year": F.col("year") == 1996, "currency": grid.currency_is(F.col("currency"), "idr"), "field": F.col("field").isin("F", "O"), "confidence": F.col("confidence") >= 0.8,
    }
    facets = {"currency": grid.Facet(F.col("currency"), "currency", ("eur", "idr")), "field": grid.Facet(F.col("field"), "field"), "year": grid.Facet(F.col("year"), "year", empty=None), "all": grid.Facet(F.col("field"))}
    return grid.facet_table(readings(spark, sf), filters, facets)


@query(f"WITH {READINGS} SELECT id, company, value FROM readings ORDER BY value DESC, id LIMIT 50 OFFSET 4950")
def deep_page(spark, sf):
    """The hundredth page of a sorted table: the limit is the feature."""
    order, path = [F.col("value").desc_nulls_last(), F.col("id")], shared_dir(spark, "pages")
    pages.write(readings(spark, sf).select("id", "company", "value"), order, path, ranges=16)
    return pages.page(spark, path, order, 100, 50)


def _saved(spark, sf, buckets: int = 8) -> tuple[str, str, str]:
    """Documents (orders), values (their lines) and checks as ordered tables of one number of buckets."""
    names = tuple(f"ordered_{kind}_{uuid.uuid4().hex}" for kind in ("documents", "values", "checks"))
    docs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("document_id"), F.concat(F.lit("f"), "o_orderkey").alias("file_path"))
    values = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("id"), F.col("l_partkey").alias("part"))
    checks = order_checks(spark, sf).select(F.col("o_orderkey").alias("document_id"), "status")
    for name, rows, order in zip(names, (docs, values, checks), (("file_path",), ("id", "part"), ("status",)), strict=True):
        ordered.save(rows, name, order=order, buckets=buckets, path=shared_dir(spark, name))
    return names


@query(f"""WITH {_SUMS}, v AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1), f AS (SELECT o_orderkey AS k, count(*) AS n FROM c WHERE status <> 'VALID' GROUP BY 1)
    SELECT o_orderkey AS document_id, coalesce(v.n, 0) AS n_values, coalesce(f.n, 0) AS n_findings FROM orders LEFT JOIN v ON v.k = o_orderkey LEFT JOIN f ON f.k = o_orderkey""")
def ordered_counts(spark, sf):
    return ordered.document_counts(spark, *_saved(spark, sf))


@query("SELECT l_orderkey AS document_id, l_linenumber AS id, l_partkey AS part, CASE WHEN o_orderkey IS NOT NULL THEN 'f' || o_orderkey END AS file_path FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey")
def ordered_files(spark, sf):
    documents, values, _ = _saved(spark, sf)
    return ordered.with_files(spark, values, documents)


@query(f"""WITH {READINGS} SELECT 'values' AS part, id, company AS what FROM readings WHERE id % 10 > 0 OR id % 20 > 0 UNION ALL SELECT 'values', id, 'new' FROM readings WHERE id % 20 = 0
    UNION ALL SELECT 'checks', o_orderkey, CASE WHEN o_orderkey % 20 = 0 THEN 'checked' ELSE o_orderstatus END FROM orders""")
def replaced_versions(spark, sf):
    """A twentieth of the documents replaced in two tables at once, read from the version that holds both."""
    store = Versions(spark, shared_dir(spark, "versions"))
    values = readings(spark, sf).select(F.col("id").alias("document_id"), F.col("company").alias("what"))
    checks = table(spark, sf, "orders").select(F.col("o_orderkey").alias("document_id"), F.col("o_orderstatus").alias("what"))
    store.publish({"values": values, "checks": checks})
    some = values.where("document_id % 20 = 0").select("document_id")
    store.replace({"values": some.withColumn("what", F.lit("new")), "checks": some.withColumn("what", F.lit("checked"))})
    part = lambda name: store.read(name).select(F.lit(name).alias("part"), F.col("document_id").alias("id"), "what")
    return part("values").unionByName(part("checks"))


@query("""WITH s AS (SELECT user_id, min_by(value, struct_pack(ts := ts, event_id := event_id)) AS original_value, max_by(value, struct_pack(ts := ts, event_id := event_id)) AS value, max_by(event_type, struct_pack(ts := ts, event_id := event_id)) AS k, count(*) AS edits FROM events GROUP BY 1)
    SELECT user_id, original_value, value, edits FROM s WHERE k <> 'click'""")
def edit_log(spark, sf):
    """The events in three batches, two of them in the snapshot: what a fold of all of them gives."""
    log = EditLog(spark, shared_dir(spark, "editlog"), ["user_id"], "ts", "value", "value", F.col("event_type") == "click")
    events = table(spark, sf, "events").withColumn("id", F.col("event_id"))
    for batch in range(3):
        log.append(events.where(F.col("event_id") % 3 == batch))
        if batch == 1:
            log.compact()
    return log.state().select("user_id", "original_value", "value", "edits")


@query(None)
def document_states(spark, sf):
    """Every change of the users' documents by the events' stream: a custom state machine, held against a plain fold in the tests."""
    folder = shared_dir(spark, "lifecycle")
    steps = ("start", "extract", "validate", "finish", "doubt", "fail", "retry", "accept", "repeat")
    event = F.element_at(F.array(*map(F.lit, steps)), (F.col("event_id") * 7 % len(steps) + 1).cast("int"))
    schema = table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("recursiveFileLookup", True).parquet(sf)
    moves = lifecycle(stream.select(F.col("user_id").alias("document_id"), "event_id", "ts", event.alias("event")), "1 hour", 6 * 3_600_000)
    spark.createDataFrame([], CHANGES).write.parquet(f"{folder}/changes/batch=-1")
    write = lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/changes/batch={n}")
    moves.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(CHANGES).parquet(f"{folder}/changes/*")
