"""Closures, cycles, groups and blocked pages over long chains, in rounds that grow with the logarithm of the length."""

import random

import pytest

from paperstrata.operators import pages, tree

LONG = 10_000


@pytest.fixture
def tables(monkeypatch):
    """Counts staged tables, a few of which are a round."""
    count, plain = [], tree.staged

    def counting(df):
        count.append(1)
        return plain(df)

    monkeypatch.setattr(tree, "staged", counting)
    monkeypatch.setattr(pages, "staged", counting)
    return count


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "path long, target long").coalesce(2)


def seeds(spark, *paths):
    return spark.createDataFrame([(p,) for p in paths], "path long")


def values(df):
    return sorted(r[0] for r in df.collect())


def chain(n, seed=None):
    order = list(range(n))
    if seed is not None:
        random.Random(seed).shuffle(order)
    return order, list(zip(order, order[1:], strict=False))


@pytest.mark.parametrize("seed", [None, 3])
def test_groups_of_a_chain(spark, tables, seed):
    _, pairs = chain(LONG, seed)
    claims = spark.createDataFrame([(i, p) for i, (a, b) in enumerate(pairs) for p in (a, b)], "item long, page long").coalesce(2)
    assert pages.groups(claims).select("group").distinct().collect() == [(0,)]
    assert len(tables) < 3 * 20


def test_blocked_chain(spark, tables):
    order, pairs = chain(LONG, 5)
    rows = [(i, p, i != LONG // 2) for i, (a, b) in enumerate(pairs) for p in (a, b)] + [(LONG + 1, LONG + 1, True), (LONG + 2, None, False)]
    claims = spark.createDataFrame(rows, "item long, page long, ok boolean").coalesce(2)
    assert values(pages.blocked_pages(claims, claims["ok"])) == sorted(order)
    assert len(tables) < 3 * 20


def test_closures_of_a_chain(spark, tables):
    order, pairs = chain(LONG, 8)
    relations = edges(spark, pairs)
    assert values(tree.closure(relations, seeds(spark, order[7], -1))) == sorted([*order, -1])
    assert len(tables) < 4 * 20
    tables.clear()
    assert values(tree.closure(relations, seeds(spark, order[7]), both=False)) == sorted(order[7:])
    assert len(tables) < 50  # 6 plain rounds, 14 shortcuts, 14 rounds along them


def test_cycles_behind_chains(spark, tables):
    order, pairs = chain(LONG, 2)
    assert tree.cycles(edges(spark, pairs)).isEmpty()
    tables.clear()
    ring = [(LONG + i, LONG + (i + 1) % 50) for i in range(50)]
    tails = [(order[-1], LONG), (LONG + 7, 2 * LONG), *((2 * LONG + i, 2 * LONG + i + 1) for i in range(3000))]
    assert values(tree.cycles(edges(spark, [*pairs, *ring, *tails]))) == list(range(LONG, LONG + 50))
    assert len(tables) < 120


@pytest.mark.parametrize("seed", [1, 3])
def test_random_graphs(spark, monkeypatch, seed):
    """Against plain search, with shortcuts from the first round on."""
    monkeypatch.setattr(tree, "PLAIN_ROUNDS", 1)
    rng = random.Random(seed)
    pairs = list({(rng.randrange(40), rng.randrange(40)) for _ in range(30 + 8 * seed)})
    out = {}
    for a, b in pairs:
        out.setdefault(a, set()).add(b)

    def reach(start, step):
        seen, todo = set(), list(start)
        while todo:
            v = todo.pop()
            if v not in seen:
                seen.add(v)
                todo += step.get(v, ())
        return seen

    around = {}
    for a, b in pairs:
        around.setdefault(a, set()).add(b)
        around.setdefault(b, set()).add(a)
    relations = edges(spark, [*pairs, pairs[0]])
    assert values(tree.closure(relations, seeds(spark, 1, 2), both=False)) == sorted(reach([1, 2], out))
    assert values(tree.closure(relations, seeds(spark, 1, 2))) == sorted(reach([1, 2], around))
    assert values(tree.cycles(relations)) == sorted(v for v in out if v in reach(out[v], out))
