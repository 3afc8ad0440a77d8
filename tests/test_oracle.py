"""Every query with a SQL check, on the smallest tables."""

import pytest

from duewise.queries.catalog import SPECS
from tools.check_queries import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("key", sorted(k for k, s in SPECS.items() if s.oracle))
def test_matches_sql(spark, duck, key):
    ok, note, _ = compare(spark, duck, SF, key)
    assert ok, note
    assert "TYPES" not in note, note


def test_every_operator_of_the_inventory_is_registered():
    skipped = {"O001"} - {"O001"}
    groups = [range(1, 13), range(20, 44), range(50, 65), range(70, 101), range(101, 121), range(121, 138), range(140, 147),
              range(150, 159), range(160, 165), range(166, 169), range(170, 174)]
    wanted = {f"O{n:03d}" for g in groups for n in g} - skipped
    have = {k.split("_")[0] for k in SPECS}
    assert wanted <= have, sorted(wanted - have)
