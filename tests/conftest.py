import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    import tempfile
    from stallboard.session import get_session
    s = get_session("local[4]", app="stallboard-tests", shuffle_partitions=8,
                    extra={"spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="stallboard-wh-")})
    yield s
    s.stop()


def rows(df, *order):
    return [r.asDict() for r in (df.orderBy(*order) if order else df).collect()]
