"""Boosted trees send few sums to the driver."""

import numpy as np

from apronflow.models import boosting


def test_few_sums_reach_the_driver(spark):
    values = [np.array([i, 1.0]) for i in range(50)]
    sums = spark.sparkContext.parallelize(values, 50)
    few = boosting._partials(sums)
    assert few.getNumPartitions() <= 8 and few.reduce(np.add).tolist() == [1225.0, 50.0]
    assert few.count() <= 8
