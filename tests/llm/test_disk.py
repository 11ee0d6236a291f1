"""Stored stages leave no shuffle files, so the disk holds those of one stage at a time."""

import os
import time

from pyspark.sql import functions as F

from millrace.llm import phrases
from millrace.llm.common import stored

TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shuffle_files(spark):
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {os.path.join(at, n) for d in folders for at, _, names in os.walk(d) for n in names if n.startswith("shuffle_")}


def left_behind(spark, before):
    for _ in range(50):  # they are deleted in the background
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.2)
    return left


def test_stored_stage_drops_its_shuffle_files(spark):
    before, setting = shuffle_files(spark), spark.conf.get(TIDY, None)
    out = stored(spark.range(1000).groupBy((F.col("id") % 10).alias("g")).count())
    assert left_behind(spark, before) == set() and spark.conf.get(TIDY, None) == setting
    assert out.agg(F.sum("count")).first()[0] == 1000


def test_repeated_spans_leave_two_stored_tables_and_no_shuffle_files(spark):
    passage = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(i, f"a{i} {passage} b{i}") for i in range(6)] + [(9, "alone")], "doc_id bigint, text string")
    before = shuffle_files(spark)
    touched, spans = phrases.repeated_spans(docs)
    assert left_behind(spark, before) == set()
    assert touched.count() == 6 and {r.doc_id for r in spans.collect()} == {1, 2, 3, 4, 5}
