import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from stratafield.session import clear, local_session, ship

    session = local_session("4", 4, **{"spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("ERROR")
    ship(session)
    yield session
    clear(session)
