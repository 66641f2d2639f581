"""Queries without SQL pass every row of their tables to the operator."""

import os

import pytest
from pyspark.sql import functions as F

from inklattice.plans import drawing_queries, store_queries
from inklattice.plans import stand_ins as S

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_match_tiers_reads_every_text(spark):
    found = {r.doc for r in store_queries.match_tiers(spark, SF).select("doc").distinct().collect()}
    assert {k % 3 for k in found} == {0, 1, 2}


def test_every_point_is_a_text_or_a_serial(spark):
    marks = drawing_queries.entities(spark, SF).filter("kind IN ('TEXT', 'ATTRIB')").groupBy("document_hash").agg(F.count("*").alias("n"))
    points = S.points(spark, SF).groupBy(F.col("doc").cast("string").alias("document_hash")).agg(F.count("*").alias("n"))
    assert sorted(marks.collect()) == sorted(points.collect())


def test_every_point_has_a_box(spark):
    assert drawing_queries.entities(spark, SF).filter("kind = 'LINE' AND seq >= 1000000000").count() == S.points(spark, SF).count()
