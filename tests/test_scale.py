import os

import pytest
from pyspark.sql import functions as F

from tempolog.functions import binding
from tempolog.operators import merges, staging
from tempolog.plans import streams

FOLDER = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the test tables are not here")


@needs_tables
def test_lines_are_dealt_to_all_cores(spark):
    """Few row groups, and few bytes, do not make few tasks of lines that patterns are tried on."""
    for lines in (streams.made_lines(spark, FOLDER), streams.r_forms(spark, FOLDER)):
        tasks = lines.select(F.spark_partition_id().alias("task")).distinct().count()
        assert tasks >= spark.sparkContext.defaultParallelism


def test_once_gives_the_value(spark):
    df = spark.createDataFrame([("a",), (None,)], "t string")
    found = df.select(binding.once(F.upper("t"), lambda u: F.coalesce(F.concat(u, u), F.lit("none"))).alias("f")).collect()
    assert [r["f"] for r in found] == ["AA", "none"]


def test_records_are_grouped_once_for_id_and_source(spark, rows):
    """What a record has is found in one grouping, and the same origin's source still comes first."""
    new = spark.createDataFrame([(1, "a", "new", "n"), (1, "b", "new", "n"), (2, "c", "new", "n")], "record_id long, origin_key string, requester_user_id string, requester_source string")
    existing = spark.createDataFrame([(1, "a", "2", "usr_a", ""), (1, "b", "3", "", "own"), (1, "x", "1", "", "first"), (2, "c", "4", "", "lost")], "record_id long, origin_key string, origin_id string, requester_user_id string, requester_source string")
    kept = merges.keep_requester(new, existing).select("origin_key", "requester_user_id", "requester_source")
    assert kept._jdf.queryExecution().executedPlan().toString().count("Aggregate(key") == 2  # within tasks, then across
    assert rows(kept) == [("a", "usr_a", "first"), ("b", "usr_a", "own"), ("c", "new", "n")]


@needs_tables
def test_plain_lines_stay_out_of_the_interruptions(spark):
    """What only tells the time is not run through when the next interruption of another item is looked for."""
    assert streams.t7(spark, FOLDER).count() > 100
    forcing = spark.read.parquet([path for path in staging._STAGED if "/forcing-" in path][-1])
    assert forcing.count() > 100 and forcing.filter("force = 0 or reason is null").isEmpty()
