from seqloom.operators.minhash import native_signatures
from seqloom.streaming.signatures import stream_sequences, stream_signatures


def test_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame([(1, "ACDEGHHIKLLL"), (2, "ACDEGHHIKLMN"), (3, "AC")], "seq_id long, sequence string")
    df.write.parquet(f"{tmp_path}/in")
    query = stream_signatures(stream_sequences(spark, f"{tmp_path}/in"), 4, 8).writeStream.format("memory").queryName("sig").start()
    query.processAllAvailable()
    query.stop()
    assert {tuple(r) for r in spark.table("sig").collect()} == {tuple(r) for r in native_signatures(df, 4, 8).collect()}
