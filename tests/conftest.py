import os
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
os.environ.setdefault("OMP_NUM_THREADS", "1")

import pytest  # noqa: E402

from pactline.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    out = session("local[4]", **{"spark.sql.shuffle.partitions": 4, "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")), "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse"))})
    out.sparkContext.setLogLevel("ERROR")
    yield out
    out.stop()
