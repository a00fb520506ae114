"""Audits of the small-world search: planted pairs where the data hold none, and graphs that answer."""

import os

import numpy as np
import pytest

from pyspark.sql import functions as F

from folioflow.llm import embedding_dedup
from folioflow.llm.embedding_dedup import audited_hits


class Blind:
    """A graph whose search finds nothing but a query's own row."""

    def __init__(self, vectors, own):
        self.vectors, self.own = vectors, own

    def within(self, q, threshold, beam, margin):
        return (q @ self.vectors.T > 1 - 1e-12) & self.own


@pytest.mark.parametrize("own", [False, True])
@pytest.mark.parametrize("crowd", [3, 300])
def test_pairs_that_no_audit_vouches_for_are_found(own, crowd):
    """A few true pairs that the audit's queries miss, and many that no beam finds."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 24))
    at = np.arange(2, 2 + crowd) if crowd > 3 else np.array([3, 4, 5])
    x[at] = x[at[0]] + rng.normal(size=(crowd, 24)) * 0.02
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = x if own else x[:800] + 1e-4
    q = q / np.linalg.norm(q, axis=1, keepdims=True)
    hits, _ = audited_hits(Blind(x, own), q, 0.98, 0.999)
    assert sorted(map(tuple, hits.tolist())) == sorted(map(tuple, np.argwhere(q @ x.T >= 0.98).tolist()))


SF = "/root/testdata/sf0.1/embeddings.parquet"


@pytest.mark.skipif(not os.path.exists(SF), reason="needs the driver's tables")
def test_graphs_answer_where_labels_hold_no_pair(spark):
    """No pair of the table's own reaches the threshold: planted near copies of 40 rows are all found, by graphs alone."""
    rows = spark.read.parquet(SF).select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"), "label")
    near = rows.where("vec_id < 40").select((F.col("vec_id") + 10**6).alias("vec_id"), F.transform("v", lambda x, i: x + F.when(i == 3, 0.05).otherwise(0.0)).alias("v"), "label")
    both = rows.unionByName(near)
    keyed = both.select(F.col("label").cast("string").alias("__l"), F.md5(F.col("v").cast("string")).alias("__d"), F.col("v").alias("__v"), F.col("vec_id").alias("id"))
    _, found = embedding_dedup._found(keyed, 0.98, 0.999, 128)
    audits = found.where("cid < 0").agg(F.min("links"), F.sum("true"), F.sum("caught"), F.count("*")).first()
    assert audits[0] >= 0 and audits[3] > 10 and audits[2] >= 0.999 * audits[1] > 10_000
    x = np.array([r.v for r in both.orderBy("vec_id").collect()])
    label = np.array([r.label for r in both.orderBy("vec_id").collect()])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    true = np.triu((x @ x.T >= 0.98) & (label[:, None] == label), 1).sum()
    assert found.where("cid < 0").agg(F.sum("root")).first()[0] == true >= 30
