"""Streaming equals batch; property-based checks of the exact quantile helper."""

import os

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from surveyspark.functions.ordered import exact_quantiles
from surveyspark.plans import inputs
from surveyspark.spec import DRIVER_TABLES
from surveyspark.streaming.clean_stream import clean_rows, start_clean_stream

SMOKE = "/root/testdata/sf0.001"


def test_stream_equals_batch_and_resumes(spark, tmp_dir):
    raw = inputs.raw_obs(spark, SMOKE)
    src = os.path.join(tmp_dir, "src")
    raw.where(F.col("id") % 2 == 0).write.parquet(src, mode="append")
    sink, ckpt = os.path.join(tmp_dir, "sink"), os.path.join(tmp_dir, "ckpt")
    q = start_clean_stream(spark, src, raw.schema, DRIVER_TABLES, sink, ckpt, skip_decode=("segment",))
    q.awaitTermination()
    # new files arrive; a restarted query picks up only the new ones (checkpointed progress)
    raw.where(F.col("id") % 2 == 1).write.parquet(src, mode="append")
    q = start_clean_stream(spark, src, raw.schema, DRIVER_TABLES, sink, ckpt, skip_decode=("segment",))
    q.awaitTermination()
    streamed = spark.read.parquet(sink)
    batch = clean_rows(raw, DRIVER_TABLES, ("segment",))
    assert streamed.count() == raw.count()
    assert streamed.exceptAll(batch.select(*streamed.columns)).count() == 0


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(st.one_of(st.integers(-50, 50).map(float), st.floats(-1e6, 1e6, allow_nan=False)),
                       min_size=1, max_size=60),
       q=st.sampled_from([0.0, 0.1, 0.25, 0.5, 0.9, 1.0]))
def test_quantile_matches_numpy(spark, values, q):
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = exact_quantiles(df, [], "v", [q]).first()["value"]
    assert got == pytest.approx(float(np.quantile(np.array(values), q)), rel=1e-9, abs=1e-9)
