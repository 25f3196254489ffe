"""The near-duplicate stage finds candidates by SimHash fingerprints and confirms them on whole sets."""

import random

from pyspark.sql import functions as F

from loomgrid.llm import jaccard, simhash


def test_fingerprints_link_what_shares_no_min_hash_key(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(5000)]
    base = [rng.choice(words) for _ in range(3000)]
    chant = ["all", "the", "same", "words", "again"] * 400
    texts = {1: base, 2: [*base[:1500], "other", *base[1501:]], 3: chant + words[:40], 4: chant + words[40:80], 5: words[100:900], 6: []}
    rows = spark.createDataFrame([(k, " ".join(t)) for k, t in texts.items()] + [(7, None)], "key long, text string")
    fps = {k: simhash.fingerprint(" ".join(t).encode()) for k, t in texts.items()}
    assert all((fps[a] ^ fps[b]).bit_count() <= 3 for a, b in ((1, 2), (3, 4)))
    told = jaccard.fingerprints(simhash._with_fingerprint(rows), "text", 5, with_bands=True)
    # keys that nothing shares, so that min-hash finds no candidate at all
    own = F.when(F.col("bands").isNotNull(), F.array(F.xxhash64("fp")))
    distinct = told.groupBy("fp").agg(F.min("key").alias("first"), F.min("sim").alias("sim"), F.first("bands").alias("bands")).withColumn("bands", own)
    of = {bytes(r.fp): r["first"] for r in distinct.collect()}
    found = {tuple(sorted((of[bytes(r.a)], of[bytes(r.b)]))) for r in simhash._confirmed(rows, distinct, 0.8, 5).collect()}
    assert found == {(1, 2)}
    nameless = rows.withColumn("key", F.lit(None).cast("long"))
    assert simhash._confirmed(nameless, distinct.withColumn("first", F.lit(None).cast("long")), 0.8, 5).count() == 1
    assert simhash._confirmed(rows.limit(0), distinct.limit(0), 0.8, 5).count() == 0
