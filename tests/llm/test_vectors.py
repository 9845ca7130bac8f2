from __future__ import annotations

import numpy as np
import pytest

from millrace.llm import ann
from millrace.llm.ann import search
from millrace.llm.neardup import linked_vectors, needed_collisions


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "clash", 1) for i, v in rows], "vec_id long, embedding array<float>, links string, list int")


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(2)
    base = rng.standard_normal((300, 24))
    near = base[:60] + 0.25 * rng.standard_normal((60, 24))
    far = base[:60] + 0.45 * rng.standard_normal((60, 24))
    x = np.concatenate([base, near, far, base[:5]]).astype(np.float32)
    return [(i, [float(y) for y in v]) for i, v in enumerate(x)]


ODD = [(1000, None), (1001, [0.0] * 24), (1002, [float("nan")] + [1.0] * 23), (1003, [None] + [1.0] * 23), (1004, [float("inf")] * 24), (1005, [1.0, 2.0]), (1006, [2.0, 4.0]), (1007, [])]


def test_links_equal_brute_force(spark, sample):
    got = {r["vec_id"]: r for r in linked_vectors(frame(spark, sample + ODD)).collect()}
    x = np.array([v for _, v in sample], float)
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    found, true = sum(got[i]["n_links"] for i in range(len(x))), near.sum()
    assert true > 100 and 0.99 * true <= found <= true
    assert all(got[i]["n_links"] <= near[i].sum() for i in range(len(x)))
    label = list(range(len(x)))
    for _ in range(len(x)):
        new = [min([label[i], *(label[j] for j in np.flatnonzero(near[i]))]) for i in range(len(x))]
        if new == label:
            break
        label = new
    assert sum(got[i]["component_id"] == label[i] for i in range(len(x))) >= 0.99 * len(x)
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in (1000, 1001, 1002, 1003, 1004, 1007))
    assert got[1005]["n_links"] == 1 and got[1006]["component_id"] == 1005


def test_rows_that_repeat_an_id_keep_their_own_links(spark):
    rows = frame(spark, [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [0.01, 1.0]), (3, [0.01, 1.0]), (9, [-1.0, -0.0]), (8, [-1.0, 0.0]), (None, [1.0, 0.0])])
    got = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0, r["kept"]) for r in linked_vectors(rows).collect())
    assert got == [(0, 0, 0, True), (1, 1, 1, True), (1, 2, 1, True), (2, 1, 1, False), (3, 2, 1, False), (3, 2, 1, False), (8, 1, 8, True), (9, 1, 8, False)]


def test_recall_by_band_of_cosine(spark):
    """Over several blocks: pairs planted at known cosines, and a group of near copies that holds a third of the rows."""
    rng = np.random.default_rng(12)
    n, dim = 12_000, 48
    x = rng.standard_normal((n, dim))
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    hot = np.arange(0, n, 3)
    x[hot] = x[0] + 0.02 * rng.standard_normal((len(hot), dim))
    for k, i in enumerate(range(1, n - 3, 6)):  # i is cold, as is i + 1
        cosine = 0.88 + 0.12 * (k % 120) / 120
        other = x[i + 1] - (x[i + 1] @ x[i]) * x[i]
        x[i + 1] = cosine * x[i] + np.sqrt(1 - cosine**2) * other / np.sqrt(other @ other)
    x = x.astype(np.float32)
    got = {r["vec_id"]: r for r in linked_vectors(frame(spark, list(enumerate(x.tolist())))).collect()}
    unit = x.astype(float)
    unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
    alike = unit @ unit.T
    np.fill_diagonal(alike, -1)
    true = (alike >= 0.9).sum(axis=1)
    found = np.array([got[i]["n_links"] for i in range(n)])
    assert (found <= true).all()
    for low, high in ((0.9, 0.91), (0.91, 0.93), (0.93, 0.96), (0.96, 1.01)):
        band = (alike.max(axis=1) >= low) & (alike.max(axis=1) < high) & (np.arange(n) % 3 != 0)
        assert band.sum() >= 50 and found[band].sum() >= 0.99 * true[band].sum(), (low, found[band].sum(), true[band].sum())
    assert found[hot].sum() >= 0.999 * true[hot].sum() and sum(got[i]["component_id"] == 0 for i in hot) >= len(hot) - 5


def test_links_of_an_empty_table(spark):
    assert linked_vectors(frame(spark, [])).count() == 0


def test_collisions_are_calibrated():
    assert 20 <= needed_collisions() <= 30


def test_search(spark, sample):
    rows = frame(spark, sample + ODD[:5])
    out = search(rows, rows.where("vec_id % 10 = 0"), 5).collect()
    x = np.array([v for _, v in sample], float)
    unit = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    hit = 0
    for q in range(0, len(x), 10):
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in out if r["query_id"] == q)
        score = unit @ unit[q]
        score[q] = -9
        want = np.lexsort((np.arange(len(x)), -score))[:5]
        hit += len({m[1] for m in mine} & set(want.tolist()))
        assert [m[0] for m in mine] == [1, 2, 3, 4, 5]
        assert all(abs(score[m[1]] - m[2]) < 1e-9 for m in mine)
    assert hit >= 0.9 * 5 * len(range(0, len(x), 10))
    assert not {r["query_id"] for r in out} & {1000, 1001, 1002, 1003, 1004}


def test_search_with_few_candidates(spark):
    rows = frame(spark, [(0, [1.0, 0.0]), (50, [1.0, 0.0]), (7, [1.0, 0.1])])
    out = search(rows, rows.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in out] == [(0, 1, 50), (0, 2, 7), (50, 1, 0), (50, 2, 7)]
    empty = frame(spark, [])
    assert search(empty, empty).count() == 0


def test_search_finds_enough_where_lists_are_small(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 8))
    x[:250] = x[0] + 1e-3 * rng.standard_normal((250, 8))  # most lists of the others hold a row or two
    rows = frame(spark, [(i, [float(y) for y in v]) for i, v in enumerate(x)])
    monkeypatch.setattr(ann, "COVERAGE", 0.0)  # one probe, so that only the guards find more
    out = search(rows, rows.where("vec_id % 3 = 0"), 5).collect()
    assert all(sum(r["query_id"] == q for r in out) == 5 for q in range(0, 300, 3))


def test_search_among_rows_that_repeat_an_id(spark):
    rows = [(0, [1.0, 0.0]), (50, [1.0, 0.02]), (7, [1.0, 0.1]), (7, [1.0, 0.01]), (7, [0.0, 1.0]), (8, [1.0, 0.1]), (8, [1.0, 0.1]), (8, [1.0, 0.1]), (9, [1.0, 0.3]), (10, [1.0, 0.4]), (50, [1.0, 0.02])] + [(11, [1.0, 0.05 + i / 1e6]) for i in range(200)]
    rows = frame(spark, rows)
    out = search(rows, rows.where("vec_id % 50 = 0"), 5).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"]) for r in out] == [(0, 7), (0, 50), (0, 11), (0, 8), (0, 9), (50, 7), (50, 0), (50, 11), (50, 8), (50, 9)]
    assert [r["rank"] for r in out] == [1, 2, 3, 4, 5] * 2


def test_recall_by_density_with_few_lists_visited(spark):
    """Clustered data of several spreads: recall is reached in each, and lists are left out."""
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((60, 32))
    spread = np.repeat([0.05, 0.2, 0.6], 20)
    which = rng.integers(0, 60, 12_000)
    which[:4000] = 0  # a dense place holds a third
    x = (centres[which] + spread[which][:, None] * rng.standard_normal((len(which), 32))).astype(np.float32)
    perm = rng.permutation(len(x))
    x, which = x[perm], which[perm]
    rows = frame(spark, [(i, v) for i, v in enumerate(x.tolist())])
    out = {}
    for r in search(rows, rows.where("vec_id % 50 = 0"), 5).collect():
        out.setdefault(r["query_id"], set()).add(r["vec_id"])
    unit = x.astype(float)
    unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
    hits: dict = {}
    for q in range(0, len(x), 50):
        score = unit @ unit[q]
        score[q] = -9
        hits.setdefault((which[q] == 0, spread[which[q]]), []).append(len(out[q] & set(np.argsort(-score)[:5].tolist())) / 5)
    assert all(np.mean(h) >= 0.9 for h in hits.values()) and len(hits) == 4, {k: np.mean(h) for k, h in hits.items()}
    index = ann.Index.fit(unit, int(len(x) ** 0.5), 5)
    assert index.probes <= 0.3 * len(index.centres), (index.probes, len(index.centres))


def test_search_in_a_crowd_of_near_copies(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((20_000, 32))
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    x[::3] = x[0] + 0.02 * rng.standard_normal((len(x[::3]), 32)) / 32**0.5
    rows = frame(spark, [(i, v) for i, v in enumerate(x.astype(np.float32).tolist())])
    out = search(rows, rows.where("vec_id % 200 = 0"), 5).collect()
    unit = x.astype(np.float32).astype(float)
    unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
    hits = {True: [], False: []}
    for q in range(0, len(x), 200):
        score = unit @ unit[q]
        score[q] = -9
        want = set(np.argsort(-score)[:5].tolist())
        hits[q % 3 == 0].append(len({r["vec_id"] for r in out if r["query_id"] == q} & want) / 5)
    assert np.mean(hits[True]) >= 0.9 and np.mean(hits[False]) >= 0.9, (np.mean(hits[True]), np.mean(hits[False]))
