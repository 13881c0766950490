"""Every query of the core against its SQL, on the smallest tables; those without SQL must run."""

import oracle
import pytest

from tallyloom.plans import catalogues

RUN = {n: f for c in catalogues() for n, f in c.run.items()}
SQL = {n: s for c in catalogues() for n, s in c.sql.items()}


@pytest.mark.parametrize("name", sorted(RUN))
def test_query(spark, name):
    folder = f"{oracle.DATA}/sf0.001"
    if name in SQL:
        assert oracle.compare(spark, RUN[name], SQL[name], folder) == ""
    else:
        assert RUN[name](spark, folder).count() > 0
