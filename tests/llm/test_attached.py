"""The join that leaves rows of frequent keys where they are."""

import io
from contextlib import redirect_stdout

from pyspark.sql import functions as F

from hodos.llm.common import FREQUENT, attached


def test_rows_meet_once_and_no_join_puts_out_the_others(spark):
    """Rows that meet nothing pass a filter, not a join (finding on op2 and the pipeline)."""
    rows = [(7, i) for i in range(50)] + [(k, 0) for k in range(100, 3000)] + [(None, 1)]
    many = spark.createDataFrame(rows, "key long, place int")
    one = spark.createDataFrame([(7, 50, "often")] + [(k, 1, "once") for k in range(100, 3000, 2)], "key long, times long, what string")
    for total, frequent in ((many.count(), 1), (60 * FREQUENT, 0)):
        assert one.filter(F.col("times") * FREQUENT > total).count() == frequent
        met = attached(many, one, "key", "times", total)
        want = many.join(one.drop("times"), "key")
        assert sorted(met.select("key", "place", "what").collect()) == sorted(want.select("key", "place", "what").collect())
        shown = io.StringIO()
        with redirect_stdout(shown):
            met.explain()
        assert "LeftAnti" not in shown.getvalue()
