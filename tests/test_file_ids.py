"""File ids of paths of any length."""

import base64

from pyspark.sql import functions as F

from corpusloom.functions import text as X


def test_long_paths_come_back_and_have_no_line_breaks(spark):
    paths = ["", "a", "/d/é?>.pdf", *[("/folder/" + "ü~?" * 80)[:n] for n in (56, 57, 58, 59, 114, 115, 200)]]
    rows = spark.createDataFrame([(p,) for p in paths], "path string").select("path", X.file_id(F.col("path")).alias("fid"))
    for r in rows.withColumn("back", X.path_of(F.col("fid"))).collect():
        assert r.fid == base64.urlsafe_b64encode(r.path.encode()).decode().rstrip("=") and r.back == r.path
