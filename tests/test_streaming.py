import pytest
from pyspark.sql import functions as F

from solweave.streaming.append import append_to, arriving


def test_late_rows_are_kept_and_late_repeats_known(spark, tmp_path):
    src, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    rows = lambda ids, day: spark.createDataFrame([(i, float(i or 0)) for i in ids], "id bigint, val double").withColumn("at", F.to_timestamp(F.lit(day)))
    for ids, day in (([1, 2, 3, 3], "2024-06-01"), ([4, 1], "2004-01-01"), ([5, 2, None, None], "2024-08-01"), ([3, 6, 4], "2024-05-01")):
        new = rows(ids, day)
        new.write.mode("append").parquet(src)
        append_to(arriving(spark, src, new.schema, "id", "at"), out, cp).awaitTermination()
    got = spark.read.parquet(out)
    assert sorted(r.id for r in got.filter("id IS NOT NULL").collect()) == [1, 2, 3, 4, 5, 6] and got.count() == 8
    assert got.filter("id = 4").first().at.year == 2004 and got.filter("id = 1").first().at.year == 2024
    append_to(arriving(spark, src, new.schema, "id", "at"), out, cp + "2").awaitTermination()  # all files again
    assert sorted(r.id for r in spark.read.parquet(out).filter("id IS NOT NULL").collect()) == [1, 2, 3, 4, 5, 6]
    (tmp_path / "sink" / "_spark_metadata").mkdir(parents=True)
    with pytest.raises(ValueError):
        append_to(arriving(spark, src, new.schema, "id", "at"), str(tmp_path / "sink"), cp + "3")
