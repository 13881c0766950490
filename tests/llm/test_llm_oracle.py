"""Every query of the subpackage on the smallest tables, against its SQL where it has one."""

import oracle
import pytest

from tallyloom.llm.queries import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.run))
def test_query(spark, name):
    folder = f"{oracle.DATA}/sf0.001"
    if name in catalogue.sql:
        assert oracle.compare(spark, catalogue.run[name], catalogue.sql[name], folder) == ""
    else:
        assert catalogue.run[name](spark, folder).count() > 0 or name == "p3_limits"  # the smallest table may have no limit
