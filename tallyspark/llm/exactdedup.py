"""Exact deduplication over a keyed streaming state; DataFrame and SQL functions only.

The rows go to a content store (Parquet) and stream from there into a stateful aggregation without
expiry, kept on disk (RocksDB): each digest's state holds the digest, the stable identifier (largest
id so far), the number of rows and the locator of the first row under it (the call that brought it
and its place in that call's part of the store). The state's last word on a call's digests is read
from the update log of that call. Every further row with a known digest (a hit) is then checked on
full bytes: the least and the greatest text among a call's hits and the content that the locator
names, where an earlier call brought it, must be equal; a call opens only those files of earlier calls
that hold a content it asks for. Where they differ, the digest's rows are grouped by their texts, so a collision never merges
two texts.

``state_dir`` keeps store and state over calls: each call gives its own rows' results against all rows
so far, and its work grows with its own rows. A call that failed is repeated with the same rows: what it
had stored is not stored again, and the stream goes on from its checkpoint.

Skew: both aggregations combine before the shuffle; the join back to large groups is salted
(``common.salted_join``), so no task holds one group.

Defined results: null text counts as empty, so null and empty texts are equal; rows with a null id
take part (a null id never wins over another); repeated rows count one by one; of equal texts the
largest id stays, all rows that carry it; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.common import salted_join, shared_dir, small_or_shuffled, written

#: State on disk; without preallocated files, of which each of many small stores would hold megabytes.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


#: Micro-batches of a call.
BATCHES = 2
_CONTENT = "__id long, __digest string, __sha string, __text string, __call int, __at long"
_LOG = "__digest string, best struct<known:boolean,id:long>, first struct<call:int,at:long>, __n long"


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def _state(spark: SparkSession, folder: str, call: int, files_a_batch: int) -> DataFrame:
    """One row a digest of the call: ``__digest, __keep, __n, first``, from the update log of the stateful stream."""
    rows = spark.readStream.schema(_CONTENT).option("maxFilesPerTrigger", max(1, files_a_batch)).parquet(f"{folder}/content/*")
    # (known, id) orders null ids before all others.
    best = F.max(F.struct(F.col("__id").isNotNull().alias("known"), F.col("__id").alias("id")))
    first = F.min(F.struct(F.col("__call").alias("call"), F.col("__at").alias("at")))
    state = rows.groupBy("__digest").agg(best.alias("best"), first.alias("first"), F.count(F.lit(1)).alias("__n"))
    log = f"{folder}/log/call-{call}"
    spark.createDataFrame([], _LOG).write.mode("overwrite").parquet(f"{log}/batch=-1")
    before = {key: spark.conf.get(key, None) for key in STORE}
    for key, value in STORE.items():
        spark.conf.set(key, value)
    try:
        query = (
            state.writeStream.outputMode("update")
            .foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(f"{log}/batch={number}"))
            .option("checkpointLocation", f"{folder}/state")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value) if value else spark.conf.unset(key)
    last = spark.read.schema(f"{_LOG}, batch long").parquet(log).groupBy("__digest").agg(F.max_by(F.struct("best", "first", "__n"), "__n").alias("s"))
    return last.select("__digest", F.col("s.best.id").alias("__keep"), F.col("s.first").alias("first"), F.col("s.__n").alias("__n"))


def _contents(spark: SparkSession, folder: str, met: DataFrame) -> DataFrame:
    """The contents that ``met`` (``__call, __at``) names: of the store's files only those are opened that hold one.

    A place's upper bits are the number of the task that wrote it, which is its file's; the list of the files that
    hold hits is as long as these are many.
    """
    files = met.select("__call", F.shiftright("__at", 33).alias("file")).distinct().collect()
    paths = [f"{folder}/content/call-{r['__call']}/part-{r['file']:05d}-*" for r in files]
    rows = spark.read.schema(_CONTENT).parquet(*paths) if paths else spark.createDataFrame([], _CONTENT)
    return rows.join(small_or_shuffled(met), ["__call", "__at"], "left_semi")


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: str | None = None, batches: int = BATCHES, state_dir: str | None = None) -> DataFrame:
    """``id_col, keep_id, group_size, kept, text_sha256`` of every row of ``docs``, dropped ones too.

    ``digest`` is SQL for the state's key over the column ``__text`` (SHA-256 by default; shorter ones
    collide, which only costs time), the same in all calls on one ``state_dir``. A call's files stream
    in ``batches`` micro-batches, so later ones meet the state of earlier ones.
    """
    spark = docs.sparkSession
    folder = state_dir or shared_dir(spark, "exactdedup")
    calls = f"{folder}/calls"
    spark.createDataFrame([], "call int").write.mode("append").parquet(calls)
    call = spark.read.schema("call int").parquet(calls).count()
    own_content = f"{folder}/content/call-{call}"
    if not _exists(spark, f"{own_content}/_SUCCESS"):
        rows = docs.select(F.col(id_col).cast("long").alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text")).withColumn("__digest", F.sha2("__text", 256) if digest is None else F.expr(digest))
        rows = rows.withColumn("__sha", F.col("__digest") if digest is None else F.sha2("__text", 256))
        rows = rows.select("__id", "__digest", "__sha", "__text", F.lit(call).alias("__call"), F.monotonically_increasing_id().alias("__at"))
        rows.write.mode("overwrite").option("compression", "zstd").parquet(own_content)
    new, content = (spark.read.schema(_CONTENT).parquet(path) for path in (own_content, f"{folder}/content/*"))
    state = written(_state(spark, folder, call, -(-len(new.inputFiles()) // batches)), "exactdedup-state")
    many = state.where("__n > 1")

    # Full bytes on hits: the texts under a digest are one text if their least and greatest are equal.
    # Combined before the shuffle, so a group of any size sends one row a task.
    hits = new.join(small_or_shuffled(many.select("__digest")), "__digest", "left_semi").select("__digest", "__text")
    if call:
        met = many.where(F.col("first.call") < call).select(F.col("first.call").alias("__call"), F.col("first.at").alias("__at"))
        hits = hits.unionByName(_contents(spark, folder, met).select("__digest", "__text"))
    clash = hits.groupBy("__digest").agg(F.min("__text").alias("a"), F.max("__text").alias("b")).where("a != b").select("__digest")
    clash.write.mode("overwrite").parquet(f"{folder}/clash/call-{call}")
    clash = small_or_shuffled(spark.read.schema("__digest string").parquet(f"{folder}/clash/*").distinct())
    apart = content.join(clash, "__digest", "left_semi")
    own = apart.groupBy("__digest", "__text").agg(F.max("__id").alias("__own_keep"), F.count(F.lit(1)).alias("__own_n"))
    own = written(own.select("__digest", F.sha2("__text", 256).alias("__sha"), "__own_keep", "__own_n"), "exactdedup-own")
    spark.createDataFrame([(call,)], "call int").write.mode("append").parquet(calls)

    full = salted_join(new.select("__id", "__digest", "__sha"), state.select("__digest", "__keep", "__n"), "__digest", "__n", "__id").join(small_or_shuffled(own), ["__digest", "__sha"], "left")
    keep = F.when(F.col("__own_n").isNotNull(), F.col("__own_keep")).otherwise(F.col("__keep"))
    size = F.coalesce("__own_n", "__n")
    return full.select(F.col("__id").alias(id_col), keep.alias("keep_id"), size.alias("group_size"), keep.eqNullSafe(F.col("__id")).alias("kept"), F.col("__sha").alias("text_sha256"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    gone = classify(docs, id_col, text_col).where("NOT kept").select(F.col(id_col).alias("__gone_id"), F.col("text_sha256").alias("__gone_sha")).distinct()
    gone = small_or_shuffled(written(gone, "exactdedup-gone"))
    same = docs[id_col].eqNullSafe(gone["__gone_id"]) & (F.sha2(F.coalesce(docs[text_col], F.lit("")), 256) == gone["__gone_sha"])
    return docs.join(gone, same, "left_anti")
