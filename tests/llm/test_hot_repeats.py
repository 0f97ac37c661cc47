import random

import pytest
from pyspark.sql import functions as F
from test_text import brute_repeats, docs, prose

from meshloom.llm import repeats


@pytest.mark.parametrize("repeated", [False, True])
def test_a_passage_in_most_documents_stays_out_of_one_group(spark, monkeypatch, repeated):
    """An anchor with more contents than a shard holds: the right spans, and no group much larger than a shard."""
    shard, runs = 20_000, repeats.runs

    def bounded(batches, keys):
        for t in runs(batches, keys):
            if t.nbytes > 3 * shard:
                raise MemoryError(f"a group of {t.nbytes} bytes")
            yield t

    monkeypatch.setattr(repeats, "SHARD", shard)
    monkeypatch.setattr(repeats, "runs", bounded)
    rnd = random.Random(9)
    passage = prose(120, rnd)
    tails = [prose(60, rnd) for _ in range(12)]
    texts = [prose(rnd.randint(60, 90), rnd) + passage + (rnd.choice(tails) if k % 3 else prose(60, rnd)) for k in range(300)]
    rows = list(enumerate(texts)) + ([(7, texts[7]), (None, texts[8]), (900, texts[9])] if repeated else [])
    got = repeats.without_repeats(docs(spark, rows)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    want = [(d, *w) for (d, _), w in zip(rows, brute_repeats([t for _, t in rows]), strict=True)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
