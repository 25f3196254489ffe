"""The near-duplicate stage within an executor's memory: one pass over the texts, and few whole sets at once in Python."""

import pyarrow as pa
from loomgrid.llm import common, jaccard, simhash


def test_one_pass_gives_digests_keys_and_fingerprints(spark):
    texts = ["a b c d e f g", "a b c d e f h", "", None, "A b c"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "key long, text string")
    told = jaccard.fingerprints(rows, "text", 5, with_bands=True, number=simhash.fingerprint)
    before = jaccard.fingerprints(simhash._with_fingerprint(rows), "text", 5, with_bands=True)
    assert told._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    columns = ["key", "fp", "bands", "size", "sketch", "sim"]
    assert told.select(columns).orderBy("key").collect() == before.select(columns).orderBy("key").collect()


def test_whole_sets_come_in_batches_of_few_rows(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    with common.short_batches(spark):
        found = spark.range(5000).repartition(1).mapInArrow(sizes, "n long").collect()
    assert max(r.n for r in found) <= common.SHORT_BATCH and sum(r.n for r in found) == 5000
    assert spark.conf.get(name) == before
