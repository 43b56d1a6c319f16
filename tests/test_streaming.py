from tracewell.operators import oneclass, vectors
from tracewell.streaming.stateless import records_from_lines, route_records

LINE = "{label}117 2005.06.03 R02-M1-N0-C:J12-U11 2005-06-03-15.42.50.675872 R02-M1-N0-C:J12-U11 RAS KERNEL INFO {text}"


def test_stream_gives_the_same_rows_as_batch(spark, tmp_path):
    lines = [LINE.format(label="" if i % 2 else "ERR ", text=f"cache error {i % 5} corrected") for i in range(40)]
    for i in range(2):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{i}.log").write_text("\n".join(lines[i * 20:i * 20 + 20]) + "\n")
    batch = records_from_lines(spark.read.text(str(tmp_path / "in")))
    embedded = vectors.hashed_embedding(batch, "log_text", 64)
    centre = vectors.centre_distance_fit(embedded)
    bands = oneclass.calibrate(vectors.centre_distance_score(embedded, centre))
    want = route_records(batch, centre, bands).select("value", "is_normal", "route", "confidence")

    stream = records_from_lines(spark.readStream.schema("value string").text(str(tmp_path / "in")))
    routed = route_records(stream, centre, bands).select("value", "is_normal", "route", "confidence")
    job = (routed.writeStream.format("memory").queryName("routed").outputMode("append")
           .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    job.awaitTermination(120)
    got = spark.table("routed")
    assert got.count() == 40
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
