"""The executors get the package whatever their path."""

import zipfile

from shroudline.functions import shipping


class Context:
    def __init__(self):
        self.files = []

    def addPyFile(self, path):
        self.files.append(path)


class Session:
    def __init__(self):
        self.sparkContext = Context()


def test_the_package_is_sent_once():
    session = Session()
    shipping.ship(session)
    shipping.ship(session)
    (path,) = session.sparkContext.files
    names = zipfile.ZipFile(path).namelist()
    assert "shroudline/__init__.py" in names and "shroudline/operators/rules.py" in names


def test_queries_run_through_the_driver_s_entry(spark):
    import os

    import pytest

    import __spark_entry__ as entry

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("the driver's tables are not here")
    assert entry.queries()["model_findings"](spark, "/root/testdata/sf0.001").count() > 0
