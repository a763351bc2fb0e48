"""Streams of chunks that come late, twice or overlapping, over a restart."""

import random

from strandframe.streaming.detectors import sliding_windows, streamed_hits

SCHEMA = "chrom string, chunk_start long, seq string"


def run(stream, path, name):
    query = stream.writeStream.format("parquet").option("path", f"{path}/{name}").option("checkpointLocation", f"{path}/{name}-ck").outputMode("append").trigger(availableNow=True)
    query.start().awaitTermination()


def test_chunks_in_any_order_and_a_restart(spark, tmp_path):
    r = random.Random(4)
    whole = {c: "".join(r.choice("AT") for _ in range(900)) for c in "12"}
    chunks = []
    for c, text in whole.items():
        at = 0
        while at < len(text):
            size = r.choice([1, 3, 20, 60])
            chunks.append((c, at + 1, text[at : at + size + r.choice([0, 0, 5])]))  # some overlap the next
            at += size
    chunks += r.sample(chunks, 20) + [("1", 1, None), ("2", 5, "")]
    r.shuffle(chunks)
    source = f"{tmp_path}/in"
    third = len(chunks) // 3
    for k, part in enumerate((chunks[:third], chunks[third : 2 * third], chunks[2 * third :])):  # each run goes on from the checkpoint
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        run(streamed_hits(stream(), "TATA[AT]A", 6), tmp_path, "hits")
        run(sliding_windows(stream(), 8, 3, lambda w: w.count("A") / 8, 0.6), tmp_path, "windows")
    hits = spark.read.parquet(f"{tmp_path}/hits").collect()
    want = [(c, k + 1) for c, t in whole.items() for k in range(len(t) - 5) if t[k : k + 4] == "TATA" and t[k + 5] == "A"]
    assert sorted((x["chrom"], x["start"]) for x in hits) == sorted(want) and len(want) > 20
    found = spark.read.parquet(f"{tmp_path}/windows").collect()
    want = [(c, k + 1, t[k : k + 8].count("A") / 8) for c, t in whole.items() for k in range(0, len(t) - 7, 3) if t[k : k + 8].count("A") / 8 >= 0.6]
    assert sorted(map(tuple, found)) == sorted(want) and len(want) > 20
