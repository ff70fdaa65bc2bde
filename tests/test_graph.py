import itertools
import random
from collections import Counter

import pytest

from quernstone.operators import graph as g
from quernstone.sources.readers import EDGE_SCHEMA, cap

EDGES = [(50000, 3400), (2300, 50000), (3400, 2300), (50000, 2100), (2100, 3400), (3400, 800), (2100, 50000)]
STAR = [(1, 9), (9, 1), (2, 9), (9, 2), (3, 9), (9, 3)]


def edges(spark, rows):
    return spark.createDataFrame(rows, EDGE_SCHEMA)


def counted(df):
    return tuple(df.first())


def test_goldens(spark):
    e = edges(spark, EDGES)
    assert counted(g.triangle_rotations(cap(e, 62500))) == (3, 1)
    assert counted(g.triangle_rotations(cap(e, 50000))) == (0, 0)
    assert counted(g.path2_count(e)) == (11,)
    assert counted(g.path2_no_return(e)) == (9,)


def test_reciprocal_star_has_no_triangle(spark):
    e = edges(spark, STAR)
    for mode in ("bag", "semi", "rep"):
        assert counted(g.triangle_rotations(e, mode)) == (0, 0)
    assert counted(g.path2_count(e)) == (12,) and counted(g.path2_no_return(e)) == (6,)


def test_empty(spark):
    e = edges(spark, [])
    assert counted(g.triangle_count(e)) == (0, 0) and counted(g.path2_count(e)) == (0,)


def test_wrong_names(spark):
    with pytest.raises(ValueError):
        g.triangle_rotations(edges(spark, []), "none")
    with pytest.raises(ValueError):
        g.triangle_count(edges(spark, []), "none")


@pytest.mark.parametrize("seed", [1, 2])
def test_random_multigraphs(spark, seed):
    r = random.Random(seed)
    rows = [(r.randrange(7), r.randrange(7)) for _ in range(40)]
    e, m, once = edges(spark, rows), Counter(rows), set(rows)
    cycles = [(x, y, z) for x, y, z in itertools.product(range(7), repeat=3)]
    bag = sum(m[x, y] * m[y, z] * m[z, x] for x, y, z in cycles if x != z)
    semi = sum(m[x, y] * m[y, z] * ((z, x) in once) for x, y, z in cycles)
    rep = sum(m[x, y] * ((y, z) in once) * ((z, x) in once) for x, y, z in cycles if x != z)
    simple = sum({(x, y), (y, z), (z, x)} <= once for x, y, z in cycles if len({x, y, z}) == 3)
    assert counted(g.triangle_rotations(e, "bag"))[0] == bag
    assert counted(g.triangle_rotations(e, "semi"))[0] == semi
    assert counted(g.triangle_rotations(e, "rep"))[0] == rep
    for s in g.HINTS:
        assert counted(g.triangle_count(e, s)) == (simple, simple // 3)
    assert g.path2_list(e).count() == sum(m[x, y] * m[y, z] for x, y, z in cycles) == counted(g.path2_count(e))[0]
    assert g.path2_list(e, no_return=True).count() == counted(g.path2_no_return(e))[0]
