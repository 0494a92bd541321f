import math
import random

import numpy as np
import pytest

from lexstrata.llm import vector_codes

DDL = "vec_id long, embedding array<float>, label int, entry array<int>, v string, error string"


def brute(rows, parts, entries, rounds):
    """Plain Lloyd over whole numbers, as loops."""
    kept = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    size = -(-max((len(v) for _, v, _ in kept), default=0) // parts) * parts
    width = size // parts
    kept = [(i, v + [0] * (size - len(v)), label) for i, v, label in kept]
    head = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[v[p * width : (p + 1) * width] for _, v, _ in head] for p in range(parts)]
    part = lambda v, p: v[p * width : (p + 1) * width]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda v: [min((gap(part(v, p), c), e) for e, c in enumerate(books[p])) for p in range(parts)]
    for _ in range(rounds):
        codes = [nearest(v) for _, v, _ in kept]
        for p in range(parts):
            for e in range(len(head)):
                own = [part(v, p) for (_, v, _), c in zip(kept, codes) if c[p][1] == e]
                if own:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own)]
    return sorted((str(i), str(label), [e for _, e in n], sum(d for d, _ in n)) for (i, v, label), n in zip(kept, map(nearest, [v for _, v, _ in kept]))), books


def rows_of(n, dim, rng, spread=3.0):
    return [(i, [rng.choice((-1, 1)) * rng.random() * spread for _ in range(dim)], rng.choice((None, 0, 1))) for i in range(n)]


def cases():
    rng = random.Random(6)
    yield "plain", rows_of(150, 16, rng), 4, 8, 2
    yield "ties", [(i, [rng.choice((0.0, 0.5, 1.0)) for _ in range(8)], 1) for i in range(120)], 4, 16, 3
    yield "few", rows_of(5, 8, rng), 4, 64, 2
    odd = [(None, [1.0] * 8, 2), (None, None, 2), (3, [None, *[0.0] * 7], 0), (4, [float("nan")] * 8, 0), (5, [float("inf"), *[0.0] * 7], 0), (6, [], None), (7, [0.1] * 5, 1), (7, [0.1] * 5, 1), (7, [-0.2] * 7, 1)]
    yield "odd", odd + rows_of(20, 7, rng), 4, 6, 2
    yield "one round", rows_of(40, 6, rng, 0.01), 3, 5, 1
    yield "no round", rows_of(40, 6, rng), 3, 5, 0


def test_brute_force(spark):
    for name, rows, parts, entries, rounds in cases():
        exact = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]
        df = spark.createDataFrame([(i, v, label, [1], "v", "e") for i, v, label in exact], DDL).repartition(3)
        coded, books = vector_codes.compress(df, parts, entries, rounds)
        want, want_books = brute(exact, parts, entries, rounds)
        assert sorted((str(r.id), str(r.label), r.entry, r.error) for r in coded.collect()) == want, name
        assert books.tolist() == want_books, name


def test_bounds_hold_and_prune():
    """After every round bounds enclose the true distances, and clustered rows need few distances."""
    rng = np.random.default_rng(3)
    centres = rng.integers(-4000, 4000, size=(12, 2, 4))
    v = centres[rng.integers(0, 12, 900)] + rng.integers(-150, 150, size=(900, 2, 4))
    books = v[:30].transpose(1, 0, 2).copy()
    entry, upper, lower = vector_codes.first_round(v, books)
    spent = []
    for _ in range(4):
        new = books.copy()
        for p in range(2):
            for e in range(30):
                if (entry[:, p] == e).any():
                    new[p, e] = v[entry[:, p] == e, p].sum(axis=0) // (entry[:, p] == e).sum()
        moved = vector_codes.root(((new - books) ** 2).sum(axis=2), up=True)
        books = new
        apart = vector_codes.root(((books[:, :, None] - books[:, None]) ** 2).sum(axis=3))
        entry, upper, lower, n = vector_codes.next_round(v, books, apart, moved, entry, upper, lower)
        spent.append(n)
        square = vector_codes._distances(v, books)
        assert (entry == square.argmin(axis=2)).all()
        assert (upper**2 >= np.take_along_axis(square, entry[:, :, None], 2)[:, :, 0]).all() and (lower**2 <= square).all()
    assert max(spent) < 0.4 * square.size and spent[-1] < 0.15 * square.size


def test_roots():
    x = np.array([0, 1, 2, 3, 4, 2**62 - 1, (2**31 - 1) ** 2, (2**31 - 1) ** 2 - 1])
    assert vector_codes.root(x).tolist() == [math.isqrt(k) for k in x.tolist()]
    assert vector_codes.root(x, up=True).tolist() == [math.isqrt(k - 1) + 1 if k else 0 for k in x.tolist()]


def test_edges(spark):
    """Empty tables give no rows; components past exact 64-bit sums count as the bound."""
    df = spark.createDataFrame([(1, [3e38, -3e38], 0, None, None, None), (2, [0.0, 0.0], 0, None, None, None), (None, None, 0, None, None, None)], DDL)
    coded, books = vector_codes.compress(df, 2, 1, 1)
    bound = 2**29
    assert books.tolist() == [[[bound // 2]], [[-bound // 2]]] and {r.error for r in coded.collect()} == {bound * bound // 2}
    for none in (df.limit(0), df.where("embedding IS NULL")):
        coded, books = vector_codes.compress(none)
        assert coded.count() == 0 and books.size == 0
    with pytest.raises(ValueError, match="from 1 to 256"):
        vector_codes.compress(df, 2, 300)
