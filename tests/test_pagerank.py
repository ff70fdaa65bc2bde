import pytest

from quernstone.operators.pagerank import pagerank, pagerank_chain
from quernstone.sources.readers import EDGE_SCHEMA


@pytest.mark.parametrize(
    "k, n, want",
    [
        (10, 6, [0.0, 0.002667242144, 0.004887462275, 0.006731980575, 0.008261031303, 0.009525460943, 0.010568168427, 0.014339663583]),
        (100, 2, [0.0, 1.5857225e-5, 2.9329725e-5, 1.0157972499999999e-4]),
        (3, 52, [0.0, 0.061472260642385104, 0.11372368218841244, 0.15813739050253567]),
    ],
)
def test_chain_goldens(spark, k, n, want):
    got = dict(map(tuple, pagerank_chain(spark, k, n).collect()))
    assert [got[i] for i in range(len(want))] == pytest.approx(want, abs=1e-9)


def test_mass_is_one(spark):
    e = spark.createDataFrame([(1, 2), (1, 2), (1, 3), (2, 3), (3, 4), (5, 1)], EDGE_SCHEMA)
    assert sum(r.pr for r in pagerank(e, 5).collect()) == pytest.approx(1, abs=1e-9)
