import os
from urllib.parse import urlparse

import corpus_pipeline
from braidwork.llm import mixing, sharding, simhash
from braidwork.llm.common import shared_dir, stored, table


def test_stages(spark, small):
    docs = table(spark, small, "documents")
    columns, left = docs.columns, docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stored(stage(spark, docs, small))
        if k < 4:
            assert docs.columns == columns, name
        if k < 3:
            assert 0 < docs.count() <= left, name
            left = docs.count()
    counts = [r["count"] for r in docs.groupBy("shard").count().collect()]
    assert max(counts) - min(counts) <= 1


def test_stages_leave_what_is_read(spark, small):
    """What a stage wrote on its way is gone when it returns; before, near-dedup alone left dozens of tables on the disk."""
    docs = table(spark, small, "documents")
    folder = f"{urlparse(shared_dir(spark)).path}/braidwork"
    os.makedirs(folder, exist_ok=True)
    for stage, least in ((simhash.one_of_each, {"stay", "again", "clash"}), (mixing.repeated, {"times"}), (sharding.sharded, {"rows", "labels"})):
        before = set(os.listdir(folder))
        out = stage(docs)
        left = sorted(x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before)
        assert set(left) <= least and len(left) <= len(least), (stage, left)
        assert out.count() > 0
