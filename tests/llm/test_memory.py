"""What the Jaccard join and the quality classifier hold in a Python worker, whatever the number of rows."""

import tracemalloc

import numpy as np
import pyarrow as pa

TEXTS = pa.array([" ".join(f"w{(7 * i + j * j) % 9973}" for j in range(400)) for i in range(2000)])  # 4 MB


def peak_mb(work) -> float:
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_shingles_hold_a_piece():
    from framelake.llm import jaccard, tokens

    tokens._table.cache_clear()
    assert peak_mb(lambda: [len(s) for s in jaccard.shingle_sets(TEXTS)]) < 50


def test_pooled_vectors_hold_a_piece():
    from framelake.llm import quality, tokens

    tokens._table.cache_clear()
    vectors = np.ones((quality.BUCKETS, quality.WIDTH), np.float32)
    assert peak_mb(lambda: quality.pooled(TEXTS, vectors)) < 70


def test_region_holds_its_shared_shingles():
    from framelake.llm.jaccard import Region

    draw = np.random.default_rng(4)
    sets = []
    for k in range(120):  # pairs that share nine tenths; 8 MB in all
        own = draw.integers(0, 1 << 63, 8192 + 1000, dtype=np.uint64)
        sets += [np.sort(own[:8192]), np.sort(own[820 // 2 : 8192 + 820 // 2])]
    size = sum(s.nbytes for s in sets) / 1e6
    links = []
    assert peak_mb(lambda: links.extend(Region(sets, list(range(len(sets))), 80).join())) < 4 * size
    assert sorted(tuple(sorted(x)) for x in links) == [(2 * k, 2 * k + 1) for k in range(120)]


def test_batches_follow_bytes(spark):
    from framelake.llm.common import PIECES, staged

    def sizes(batches):
        for batch in batches:
            yield pa.record_batch([pa.array([batch.nbytes])], ["n"])

    before = {k: spark.conf.get(k) for k in PIECES}
    docs = spark.range(0, 200, 1, 1).selectExpr("id", "repeat('0123456789', 10000) AS text")  # 20 MB
    found = [r["n"] for r in staged(docs.mapInArrow(sizes, "n long"), pieces=True).collect()]
    assert max(found) < 4e6 and sum(found) > 19e6
    assert before == {k: spark.conf.get(k) for k in PIECES}
