"""The near-duplicate stage of the pipeline: recall on planted pairs, groups, null and repeated ids."""

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from tables import hard_docs

from threadscope.llm import near_dedup
from threadscope.llm.common import Powers

RNG = np.random.default_rng(7)


def prose(n):
    return [f"w{x}" for x in RNG.integers(0, 5000, n)]


def changed(words, n):
    """Each change, far from the others, takes five shingles away and adds five."""
    out = list(words)
    for i in range(n):
        out[5 + i * (len(words) - 10) // max(n, 1)] = f"new{RNG.integers(0, 1 << 40)}"
    return out


def jaccard(a, b):
    a, b = ({tuple(x[i:i + 5]) for i in range(len(x) - 4)} for x in (a, b))
    return len(a & b) / len(a | b)


def stage(spark, rows):
    return corpus_pipeline.near_dedup_stage(spark, hard_docs(spark, rows), "").collect()


def test_planted_pairs_unlike_texts_and_ids(spark):
    """Pairs at 0.8 to 0.96 lose their second text, pairs below 0.79 keep it; a null or repeated id is no reason to go."""
    rows, gone, below = [], set(), 0
    for i in range(120):
        words = prose(204)
        other = changed(words, i % 6 + 1)
        rows += [(i, " ".join(words)), (1000 + i, " ".join(other))]
        if jaccard(words, other) >= 0.8:
            gone.add(1000 + i)
        else:
            below += 1
    assert len(gone) >= 60 and below >= 20
    alone = [" ".join(prose(60)) for _ in range(12)]
    rows += [(None if i % 2 else 5000, t) for i, t in enumerate(alone)]
    got = stage(spark, rows)
    ids = {r["doc_id"] for r in got}
    missed = ids & gone
    assert len(missed) <= 1, missed
    assert {d for d, _ in rows if d is not None} - gone <= ids
    assert sorted(r["text"] for r in got if r["doc_id"] in (None, 5000)) == sorted(alone)


def test_linked_unlike_texts_under_one_id(spark):
    """The row kept is the smallest of its own group, whatever other rows have its id."""
    one, two = prose(204), prose(204)
    rows = [(None, " ".join(one)), (None, " ".join(changed(one, 1))), (4, " ".join(changed(one, 2))), (4, " ".join(two)),
            (4, " ".join(changed(two, 1))), (9, " ".join(two)), (4, " ".join(two)), (1, None), (2, ""), (3, " ")]
    got = stage(spark, rows)
    assert sorted((r["doc_id"] or 0) for r in got) == [0, 1, 4]
    assert [r["text"] in (rows[3][1], rows[4][1]) for r in got if r["doc_id"] == 4] == [True]


def test_tiles_link_what_the_smallest_member_does_not():
    """A link between two members of a bucket whose smallest member is like neither."""
    first, other = prose(204), prose(204)
    texts = [" ".join(x) for x in (first, other, changed(other, 1))]
    batch = pa.RecordBatch.from_pydict({"node": [b"a", b"b", b"c"], "label": [b"a", b"b", b"c"], "text": texts, "bucket": [1] * 3, "tile": [0] * 3, "side": [-1] * 3})
    found = [tuple(r.values()) for b in near_dedup._inside(iter([batch.slice(0, 2), batch.slice(2)])) for r in b.to_pylist()]
    assert [set(p) for p in found] == [{b"b", b"c"}]


@pytest.mark.parametrize("share", [0.8, 0.9])
def test_share_a_band(share):
    """Bands alone: of 300 pairs at the share or just above, all but three meet."""
    met = total = 0
    for _ in range(300):
        words = prose(504)
        other = changed(words, int(500 * (1 - share) / (1 + share) / 5))
        assert jaccard(words, other) >= share
        a, b = near_dedup.band_values(pa.array([" ".join(words), " ".join(other)]), Powers())
        met, total = met + (a == b).any(), total + 1
    assert met >= total - 3
