"""Dense search by parts of the scores."""

import random

from quillon.operators import dense


def test_scores_are_worked_out_some_at_a_time(spark, monkeypatch):
    draw = random.Random(3)
    vec = lambda: [float(draw.randrange(3)) for _ in range(4)]
    rows, asked = [(i, vec()) for i in range(60)], [(i, vec()) for i in range(25)]
    want = []
    for q, a in asked:
        scored = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in rows)[:5]
        want += [(q, i, -score, rank) for rank, (score, i) in enumerate(scored, 1)]
    monkeypatch.setattr(dense, "TILE", 128)
    sizes, real = [], dense._at_least
    monkeypatch.setattr(dense, "_at_least", lambda scores, k: sizes.append(scores.size) or real(scores, k))
    frames = [dense.pd.DataFrame(x, columns=[name, "vec"]) for x, name in ((asked, "query_id"), (rows, "chunk_id"))]
    frames = [f.assign(vec=f["vec"].map(dense.np.array)) for f in frames]
    found = dense._nearest(*frames, 5, [])
    assert max(sizes) <= 128
    assert [(r.query_id, r.chunk_id, r.dense_score, r.rank + 1) for r in found.itertuples()] == want
    got = dense.search(
        spark.createDataFrame(rows, "chunk_id long, vec array<double>"),
        spark.createDataFrame(asked, "query_id long, vec array<double>"), 5,
    ).collect()
    assert sorted((r.query_id, r.chunk_id, r.dense_score, r.dense_rank) for r in got) == sorted(want)
