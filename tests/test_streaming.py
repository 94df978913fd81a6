from shuffleworks.operators.runs import merge_updates
from shuffleworks.streaming import progress as stream

KEYS, ORDER = ["run_id", "node_name"], ["seq"]
SCHEMA = "run_id int, node_name string, seq int, status string"


def write_batches(spark, folder):
    batches = [
        [(1, "a", 1, "running"), (1, "b", 2, "success")],
        [(1, "a", 4, "success"), (2, "a", 1, "failed")],
        [(1, "a", 3, "late"), (2, "a", 2, None)],
    ]
    for batch in batches:
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    return spark.read.parquet(folder)


def test_stream_gives_the_batch_result(spark, tmp_path, rows):
    source, table = str(tmp_path / "in"), str(tmp_path / "table")
    everything = write_batches(spark, source)
    updates = stream.read_updates(spark, source, everything.schema)
    stream.write_progress(updates, KEYS, ORDER, table, str(tmp_path / "cp")).awaitTermination()
    expected = rows(merge_updates(everything, KEYS, ORDER))
    assert rows(stream.read_progress(spark, table, KEYS, ORDER)) == expected
    # New files arrive; the stream goes on from its checkpoint.
    spark.createDataFrame([(1, "b", 9, "failed")], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    stream.write_progress(updates, KEYS, ORDER, table, str(tmp_path / "cp")).awaitTermination()
    merged = stream.read_progress(spark, table, KEYS, ORDER)
    assert rows(merged) == rows(merge_updates(spark.read.parquet(source), KEYS, ORDER))
    # Compaction in between, and batches after it, twice.
    for seq in (10, 11):
        stream.compact_progress(spark, table, KEYS, ORDER)
        stream.compact_progress(spark, table, KEYS, ORDER)
        assert rows(stream.read_progress(spark, table, KEYS, ORDER)) == rows(merge_updates(spark.read.parquet(source), KEYS, ORDER))
        spark.createDataFrame([(seq, "a", seq, "new"), (1, "a", seq, "again")], SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream.write_progress(updates, KEYS, ORDER, table, str(tmp_path / "cp")).awaitTermination()
        assert rows(stream.read_progress(spark, table, KEYS, ORDER)) == rows(merge_updates(spark.read.parquet(source), KEYS, ORDER))
    assert len(list((tmp_path / "table").glob("b*=*"))) <= 5


def test_no_input_is_an_empty_table(spark, tmp_path):
    source, table = tmp_path / "in", str(tmp_path / "table")
    source.mkdir()
    schema = spark.createDataFrame([], SCHEMA).schema
    stream.write_progress(stream.read_updates(spark, str(source), schema), KEYS, ORDER, table, str(tmp_path / "cp")).awaitTermination()
    assert stream.read_progress(spark, table, KEYS, ORDER).count() == 0


def test_streaming_aggregate_in_update_mode(spark, tmp_path, rows):
    source = str(tmp_path / "in")
    everything = write_batches(spark, source)
    seen = {}

    def collect(batch, _):
        seen.update({(r.run_id, r.node_name): tuple(r) for r in batch.collect()})

    updates = spark.readStream.schema(everything.schema).option("maxFilesPerTrigger", 1).parquet(source)
    latest = stream.latest_progress(updates, KEYS, ORDER)
    latest.writeStream.outputMode("update").foreachBatch(collect).trigger(availableNow=True).start().awaitTermination()
    assert sorted(seen.values(), key=repr) == rows(merge_updates(everything, KEYS, ORDER))
