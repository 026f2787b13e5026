"""Results do not depend on the number of shuffle partitions (SURVEY 5 (c))."""

import pytest

import __spark_entry__ as E

from paths import SF

NAMES = ["exact_sample", "mar_missing", "permute_column", "category_shift", "numbered_batches",
         "stratified_split_counts", "ks_continuous", "fill_median", "dedup_after_injection"]


@pytest.mark.parametrize("name", NAMES)
def test_same_result_for_1_4_17_partitions(spark, name):
    outs = []
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (1, 4, 17):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            outs.append(sorted(map(repr, (tuple(r) for r in E.queries()[name](spark, SF).collect()))))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert outs[0] == outs[1] == outs[2]
