import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    import tempfile
    from seqlens.session import get_session
    warehouse = tempfile.mkdtemp(prefix="seqlens-warehouse-")
    s = get_session(master="local[*]", shuffle_partitions=8,
                    extra={"spark.sql.warehouse.dir": warehouse})
    yield s
    s.stop()
