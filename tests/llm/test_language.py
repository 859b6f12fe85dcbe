"""Memory of a language ID task."""

import tracemalloc

import numpy as np
import pyarrow as pa

from ledgerloom.llm import language


def test_memory_of_a_prediction(spark, monkeypatch):
    """The arrays of a task stay small beside a batch of 4 MB."""
    ran = []
    monkeypatch.setattr(language.F, "arrow_udf", lambda run, kind: (ran.append(run), lambda column: language.F.struct(language.F.lit("x").alias("lang"), language.F.lit(0.5).alias("score")))[1])
    frame = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    rng = np.random.default_rng(9)
    language.predict(frame, language.Model(["a", "b"], rng.normal(size=(language.BUCKETS, 2)), np.zeros(2), 1.0, 0.1))
    texts = pa.array(["".join(map(chr, rng.integers(97, 123, 2000))) for _ in range(2000)])
    tracemalloc.start()
    try:
        (told,) = ran[-1](iter([texts]))
        peak = tracemalloc.get_traced_memory()[1] >> 20
    finally:
        tracemalloc.stop()
    assert len(told) == 2000
    assert peak < 60, peak
