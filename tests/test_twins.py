"""Every query with a twin gives the twin's rows; the others give rows."""

import pytest

from tests.conftest import SF
from tests.helpers import same_rows
from webloom import plans

#: Columns in which every branch must occur, so that no twin agrees on nothing. At this size some need not.
BRANCHES = {"page_quality": ("verdict", 4), "fold_provider_health": ("status", 3), "change_tracking": ("status", 4), "fold_fallback_chain": ("answer", 3)}


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    frame = plans.QUERIES[name](spark, SF)
    if name not in plans.ORACLES:
        assert frame.count() > 0
        return
    same_rows(frame, duck, plans.ORACLES[name])
    if name in BRANCHES:
        column, n = BRANCHES[name]
        assert frame.select(column).distinct().count() >= n
