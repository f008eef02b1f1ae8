import hashlib
import math
import random
from collections import defaultdict

import numpy as np

from cliplane.llm import codes

SCHEMA = "vec_id long, embedding array<double>, label int, code string, q string, id int, error int, entry int"


def plain(rows, parts=16, entries=64, rounds=2):
    """The same by plain loops; (id, code, error, label_error, digest) of each kept row."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    if not kept:
        return []
    width = max(1, -(-max(len(r[1]) for r in kept) // parts))
    cut = lambda v: [[*(math.floor(256 * x) for x in v), *[0] * (parts * width - len(v))][p * width : (p + 1) * width] for p in range(parts)]
    vectors = [cut(r[1]) for r in kept]
    first = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, kept[i][1]))[:entries]
    books = [[vectors[i][p] for i in first] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda: [[min(range(len(books[p])), key=lambda j: (dist(v[p], books[p][j]), j)) for p in range(parts)] for v in vectors]
    for _ in range(rounds):
        code = nearest()
        for p in range(parts):
            own = defaultdict(list)
            for v, c in zip(vectors, code, strict=True):
                own[c[p]].append(v[p])
            for j, vs in own.items():
                books[p][j] = [sum(x) // len(vs) for x in zip(*vs, strict=True)]
    code = nearest()
    error = [sum(dist(v[p], books[p][c[p]]) for p in range(parts)) for v, c in zip(vectors, code, strict=True)]
    by_label = defaultdict(int)
    for r, e in zip(kept, error, strict=True):
        by_label[r[2]] += e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((r[0], "".join(f"{c:02x}" for c in own), e, by_label[r[2]], sha) for r, own, e in zip(kept, code, error, strict=True)), key=str)


def got(spark, rows, schema=SCHEMA):
    df = spark.createDataFrame([(*r, "x", "y", 1, 2, 3) for r in rows], schema)
    return sorted((tuple(r)[:5] for r in codes.compress(df.repartition(3)).collect()), key=str)


def test_codes_equal_plain_loops(spark):
    rng = random.Random(1)
    centres = [[rng.gauss(0, 0.3) for _ in range(32)] for _ in range(12)]
    rows = [(i, [round(x + rng.gauss(0, 0.05), 3) for x in rng.choice(centres)], rng.choice([0, 1, None])) for i in range(90)]
    # A crowd of equal vectors, ties on a coarse grid, repeated and null ids, and vectors that take no part.
    rows += [(1000 + i, centres[0], 2) for i in range(40)]
    rows += [(2000 + i, [rng.choice([-0.5, 0.0, 0.5]) for _ in range(32)], 3) for i in range(30)]
    rows += [(5, rows[5][1], 0), (None, rows[6][1], 1), (None, rows[7][1], None), (3000, None, 1), (3001, [float("nan")] * 32, 1), (3002, [0.1, None] * 16, 1), (3003, [float("inf")] * 32, 1)]
    rows += [(3004, [], 4), (3005, [0.25] * 7, 4), (3006, [1e4, -1e4] * 16, 5)]
    assert got(spark, rows) == plain(rows)


def test_few_vectors_and_none(spark):
    rows = [(3, [0.1, 0.2, 0.3], 1), (1, [0.1, 0.2, 0.3], None)]
    assert got(spark, rows) == plain(rows)
    assert got(spark, [(1, None, 1)]) == []
    assert codes.compress(spark.createDataFrame([], SCHEMA)).count() == 0
    huge = got(spark, [(1, [1e300, -1e300], 1), (2, [0.0, 0.0], 1)])
    assert [r[2] for r in huge] == [0, 0]


def test_bounds_settle_parts_without_a_scan_and_never_a_tie():
    rng = np.random.default_rng(2)
    centres = rng.integers(-400, 400, (64, 16, 4))
    x = centres[np.append(np.arange(64), rng.integers(0, 64, 4000))] + rng.integers(-20, 20, (4064, 16, 4))
    history = [np.ascontiguousarray(x[:64].transpose(1, 0, 2))]
    bounds = None
    for _ in range(5):
        bounds = codes.assign(x, history, bounds)
        want = np.stack([codes.squared(x[:, p], history[-1][p]).argmin(1) for p in range(16)], axis=1)
        assert (bounds.code == want).all()
        book = history[-1].copy()
        for p in range(16):
            for j in range(64):
                own = x[want[:, p] == j, p]
                if len(own):
                    book[p, j] = own.sum(0) // len(own)
        history.append(book)
    # Without bounds, five rounds would compare every part five times. Here a codebook begins with an entry of each centre.
    assert bounds.scans.mean() < 0.5 * 5 * 16


def test_net_displacement_is_tighter_than_drift():
    # An entry that moves away and back has no net displacement: nothing is compared again.
    x = np.zeros((10, 1, 2), np.int64) + np.array([1, 0])
    a, b = np.array([[[0, 0], [10, 0]]]), np.array([[[4, 0], [10, 0]]])
    bounds = codes.assign(x, [a], None)
    bounds = codes.assign(x, [a, b], bounds)
    before = bounds.scans.copy()
    bounds = codes.assign(x, [a, b, a], bounds)
    assert (bounds.code == 0).all() and (bounds.scans == before).all() and (before == 1).all()
