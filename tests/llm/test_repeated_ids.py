import numpy as np
import pytest

from voxloom.llm import embedding_links

SCHEMA = "vec_id long, embedding array<float>"


def _plain(rows, cosine=0.9):
    """(id, links, component) of each row: rows as nodes, whatever their ids."""
    x = [None if v is None or not np.any(v) else np.array(v, dtype=np.float64) / np.linalg.norm(v) for _, v in rows]
    near = [[a is not None and b is not None and i != j and a @ b >= cosine for j, b in enumerate(x)] for i, a in enumerate(x)]
    out = []
    for i, (k, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            p = todo.pop()
            for q in range(len(rows)):
                if near[p][q] and q not in seen:
                    seen.add(q)
                    todo.append(q)
        out.append((k, sum(near[i]), min((rows[q][0] for q in seen if rows[q][0] is not None), default=None)))
    return out


def _got(spark, rows):
    return [(r["vec_id"], r["n_links"], r["component_id"]) for r in embedding_links.embedding_links(spark.createDataFrame(rows, SCHEMA)).collect()]


def test_one_id_with_two_vectors(spark):
    a, b = [1.0, 0.0, 0.1, 0.0], [0.0, 1.0, 0.0, 0.1]
    near = lambda v: [x + 0.01 for x in v]
    rows = [(1, a), (1, b), (2, a), (3, near(a)), (4, b), (5, near(b))]
    got = _got(spark, rows)
    assert sorted(got) == sorted(_plain(rows))
    assert next(n for k, n, _ in got if k == 2) == 2


@pytest.mark.parametrize("seed", [1, 2])
def test_random_repeated_ids(spark, seed):
    r = np.random.default_rng(seed)
    centers = r.normal(size=(30, 8))
    rows = [(int(r.integers(0, 60)), np.float32(centers[r.integers(0, 30)] + r.normal(size=8) * 0.15).tolist()) for _ in range(150)]
    rows += [(7, rows[0][1]), (7, rows[0][1]), (7, [0.0] * 8), (8, None), (90, None)]
    key = lambda x: (x[0], x[1], x[2])
    assert sorted(_got(spark, rows), key=key) == sorted(_plain(rows), key=key)
