import os
import subprocess
import sys

import __spark_entry__ as e


def test_entry(spark):
    assert e.entry(spark).columns == ["rotations", "triangles"]


def test_every_query_of_the_engine_has_sql():
    from quernstone.plans import ORACLE_SQL, QUERIES

    assert set(QUERIES) == set(ORACLE_SQL) and set(QUERIES) <= set(e.queries())


def test_engine_without_packages_of_the_optional_part():
    code = "import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; q = e.queries(); assert 'triangle_count' in q and 'op4_simhash' not in q"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)
