"""Every query with SQL gives the rows of its SQL."""

import compare
import pytest

from ledgerloom.plans import registry

D = "/root/testdata/sf0.001"
#: Queries that find nothing in so small tables.
EMPTY: set[str] = set()
_con = []


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_rows(spark, name):
    if not _con:
        _con.append(compare.connect(D))
    said = compare.differences(registry.queries()[name](spark, D), _con[0], registry.oracle_sql()[name])
    assert said == ("no rows" if name in EMPTY else ""), said


def test_all_have_sql():
    assert set(registry.queries()) == set(registry.oracle_sql())
