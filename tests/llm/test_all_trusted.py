"""Quality: every labelled text is learned from, and the threshold is the exact quantile."""

import numpy as np

from millrace.llm import quality


def test_all_labelled_rows_are_trusted(spark):
    labels = spark.range(20_500).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic")
    docs = spark.range(20_500).selectExpr("id AS doc_id", "concat_ws(' ', array_repeat('good', 25)) AS text")
    odd = spark.range(20_500, 20_600).selectExpr("id AS doc_id", "concat_ws(' ', array_repeat('bad', 25)) AS text")
    model = quality.fit_quality(docs.unionByName(odd), labels)
    fifths = quality.trusted_sample(labels).selectExpr("pmod(xxhash64(doc_id, 5), 5) > 0 AS t").where("t").count()
    bucket = quality.ngram_buckets([b"good"], 16)[0]
    size = 1 << 16
    target, raw = 25 * fifths + 1, 25 * 20_500 + 1
    want = np.log(target / (49 * fifths + size)) - np.log(raw / (49 * 20_600 + size))
    assert abs(model.log_ratio[bucket] - want) < 1e-9


def test_lower_quantile(spark):
    values = [float(x) for x in np.random.default_rng(1).normal(size=1700)]
    rows = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    for share in (0.0, 0.002, 0.01):
        assert abs(quality.lower_quantile(rows, "v", share) - np.quantile(values, share)) < 1e-12
    assert quality.lower_quantile(rows.limit(0), "v", 0.002) is None
