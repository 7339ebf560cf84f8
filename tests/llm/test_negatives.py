"""Hard negatives against all scores."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import negatives, queries

SF = "/root/testdata/sf0.001"


def plain(rows, positives=5, wanted=3):
    """rows: (vec_id, embedding, label)."""
    sound = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v], lab) for i, v, lab in rows if i is not None and lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, v, lab in sound:
        if i % 50:
            continue
        others = sorted((-sum(a * b for a, b in zip(v, w)), j, k) for j, w, k in sound if j != i)
        for ps, p in [(-s, j) for s, j, k in others if k == lab][:positives]:
            fit = [(j, -s) for s, j, k in others if k != lab and 50 * ps <= -100 * s <= 95 * ps]
            out += [(i, p, n + 1, j, ps, s) for n, (j, s) in enumerate(fit[:wanted])]
    return sorted(out)


def found(df):
    return sorted(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in df.collect())


def test_query_against_all_scores(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()
    given = [(i, v, (lab + 1) % 10 if i is not None and lab is not None and i % 7 == 0 else lab) for i, v, lab in rows]
    want = plain(given)
    assert len(want) > 50
    assert found(queries.op13_hard_negatives(spark, SF)) == want


@pytest.mark.parametrize("blocks", [(16_384, 4_096), (40, 3)])
def test_odd_rows_ties_and_copies(spark, blocks):
    rng = random.Random(3)
    vec = lambda n=6: [rng.randrange(-3, 9) / 8 for _ in range(n)]
    rows = [(i, vec(), rng.randrange(3)) for i in range(0, 460)]
    rows += [(i, [0.5] * 6, i % 2) for i in range(500, 700)]  # one vector many times, among them anchors
    rows += [(50, vec(), 1), (103, rows[103][1], rows[103][2]), (None, vec(), 1), (701, None, 1), (702, vec(), None), (703, [1.0, None, 0.0], 1), (704, [float("nan")] * 6, 1), (750, [float("inf")] * 6, 1)]
    rows += [(800, [], 0), (801, vec(3), 0), (802, vec(9), 1), (850, [0.0] * 6, 9), (900, [-1.0] * 6, 8), (901, [-1.0] * 6, 8), (902, [-0.7] * 6, 7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({c: F.lit(c) for c in ("a", "w", "v", "score", "least", "rank")})
    got = found(negatives.hard_negatives(df.repartition(4), rows_in_block=blocks[0], anchors_in_block=blocks[1]))
    assert got == plain(rows)
    assert found(negatives.hard_negatives(df.limit(0))) == []


def test_no_bound_rules_out_a_pair_above_the_threshold():
    rng = np.random.default_rng(1)
    for scale in (1, 30):
        rows, anchors = np.floor(rng.normal(0, scale, (300, 37)) * rng.random(37) ** 3), np.floor(rng.normal(0, scale, (20, 37)))
        scores = anchors @ rows.T
        for share in (0.9, 0.5, 0.1, -0.2):
            least = scores.max(axis=1) * share
            rest = negatives.rest_norms(anchors)
            index = negatives.indexed(rows, rest, least.min())
            a, r = negatives.candidates(index, anchors, rest, least)
            got = set(zip(a.tolist(), index.rows[r].tolist(), strict=True))
            assert got >= set(zip(*(x.tolist() for x in np.nonzero(scores >= least[:, None])), strict=True))
            assert share < 0.9 or len(got) < scores.size / 2 and index.listed[-1] < len(rows)


def test_scores_beyond_doubles():
    big = np.array([[1 << 31, 3.0]])
    assert negatives.exact_scores(big, np.array([[1 << 30, 1.0]]), np.array([0]), np.array([0])).tolist() == [(1 << 61) + 3]
