"""Components take no round of star steps that changes nothing."""

import random

from postlens.operators import components as c


def test_stars_take_no_round_and_chains_few(spark, monkeypatch):
    rounds, small = [], c._small_star
    monkeypatch.setattr(c, "_small_star", lambda e: rounds.append(1) or small(e))
    find = lambda rows: dict(map(tuple, c.components(spark.createDataFrame(rows, "a long, b long")).collect()))
    assert find([(5, 1), (1, 6), (9, 7), (7, 7)]) == {1: 1, 5: 1, 6: 1, 7: 7, 9: 7} and not rounds
    assert find([(2, 1), (3, 2)]) == {1: 1, 2: 1, 3: 1} and len(rounds) == 1
    rng = random.Random(3)
    rows, root = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)], list(range(60))
    for _ in root:
        for a, b in rows:
            root[a] = root[b] = min(root[a], root[b])
    assert find(rows) == {n: root[n] for row in rows if row[0] != row[1] for n in row}
