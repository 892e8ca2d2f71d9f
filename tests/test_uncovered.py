"""The query of uncovered boxes takes all words."""

from pyspark.sql import functions as F

from veriframe.operators import geometry
from veriframe.plans import label_queries


def test_all_words_are_turned_boxes(spark, small, monkeypatch):
    sides = []
    monkeypatch.setattr(geometry, "uncovered", lambda turned, upright: sides.extend((turned, upright)) or turned)
    label_queries.geometry_uncovered(spark, small)
    n = label_queries.words(spark, small).count()
    assert [x.count() for x in sides] == [n, n] and sides[1].filter(F.col("x1") <= F.col("x0")).count() == label_queries.words(spark, small).filter("x1 <= x0").count()
