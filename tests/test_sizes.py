"""What one task joins or reads does not grow with the tables."""

import os

import pytest

from kinweave import registry
from kinweave.plans import bundles, network

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")


@pytest.mark.parametrize("name", ["p01_relation_split", "u06_creators_then_spreaders"])
def test_joins_have_parts_by_lines(spark, monkeypatch, name):
    want = sorted(registry.queries()[name](spark, SF).collect())
    monkeypatch.setattr(network, "LINES", 500)
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert network.messages(spark, SF).rdd.getNumPartitions() == -(-lines // 500)
    assert sorted(registry.queries()[name](spark, SF).collect()) == want


def test_lines_without_an_order_are_produced(spark, tmp_path):
    for name, keep in (("lineitem", "true"), ("orders", "o_orderkey % 2 = 0")):
        spark.read.parquet(f"{SF}/{name}.parquet").where(keep).write.parquet(str(tmp_path / f"{name}.parquet"))
    found = {r.relation: r.n for r in registry.queries()["p01_relation_split"](spark, str(tmp_path)).collect()}
    lines = spark.read.parquet(f"{SF}/lineitem.parquet")
    assert found == {"PRODUCED": lines.count(), "FORWARDED_BY": lines.where("l_orderkey % 2 = 0 AND l_linenumber <> 2").count()}


def test_export_files_are_bounded(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(bundles, "FILE_ROWS", 500)
    monkeypatch.setattr(bundles, "place", lambda spark, name: str(tmp_path))
    assert sum(r.n for r in registry.queries()["s01_relationship_csv"](spark, SF).collect()) > 5000
    files = list(tmp_path.glob("export.csv/*.csv"))
    assert len(files) > 10 and max(f.read_text().count("user_id") for f in files) <= 500
