"""Tables that grow with the input are never sent to the driver as a hash table, however small their files are."""

import pytest
from pyspark.sql import functions as F

from veriframe.operators import claims as C
from veriframe.operators import decide, diagnose, geometry

BOX = "label string, det_idx int, x0 int, y0 int, x1 int, y1 int, text string, confidence double"


def label_tables(spark):
    det = spark.createDataFrame([(k, i, 0, 20 * i, 80, 20 * i + 12, t, 0.9) for k in "ab" for i, t in enumerate(("OLD FARM", "40% Alc./Vol."))], BOX)
    rows = [(k, "spirits", "OLD FARM", "", ["OLD FARM"], "", 40.0, 0.0, None) for k in "ab"]
    return det, C.claims(spark.createDataFrame(rows, C.APPLICATION))


def joins_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("what", ["verify", "runs", "reach", "probes"])
def test_labels_are_joined_by_a_shuffle(spark, what):
    det, filed = label_tables(spark)
    if what == "runs":
        ordered = geometry.reading_order(det)
        plan = joins_of(geometry.successors(ordered))
    elif what == "verify":
        plan = joins_of(decide.verify(det, filed, C.candidates(filed)))
    else:
        plan = joins_of(getattr(diagnose, what)(det, C.candidates(filed)))
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_a_vocabulary_is_not_expanded_for_each_claim(spark):
    _, filed = label_tables(spark)
    specs, words = C.numeric(filed)
    assert specs.count() == 2 and words.select("vocabulary").distinct().count() == 1
    assert filed.filter("claim = 'abv'").select(F.size("numeric.valid").alias("n")).distinct().collect()[0].n == 190


def test_long_columns_are_not_made_where_they_are_not_read(spark):
    _, filed = label_tables(spark)
    plan = filed.select("label", "claim", "expected")._jdf.queryExecution().optimizedPlan().toString()
    assert "Alc./Vol." not in plan and "Bottled by" not in plan
