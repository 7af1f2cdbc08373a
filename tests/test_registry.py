from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pairgauge.sources import registry

ENTRY = """
[[datasets]]
name = "{name}"
openml_id = {id}
version = 6
md5_checksum = "c0ffee"
source_url = "https://data.example/{name}"
original_source_url = ""
license = "CC0"
family = "boats"
clinical = {clinical}
target = "afloat"
positive_class = "{positive}"
class_labels = ["no", "yes"]
expected_rows = 5
numeric_features = ["length", "draught"]
categorical_features = ["{hull}"]
excluded_features = ["harbour"]
split_strategy = "stratified"
split_notes = ""
selection_reason = "a test"
"""


def _file(tmp_path, *entries, version=1):
    good = dict(name="skiff", id=71, clinical="false", positive="yes", hull="hull")
    path = tmp_path / "datasets.toml"
    body = "".join(ENTRY.format(**{**good, **e}) for e in entries)
    path.write_text(f"schema_version = {version}\n{body}")
    return str(path)


def test_listing_and_general(spark, tmp_path):
    path = _file(tmp_path, {"name": "yawl", "id": 72}, {"name": "ward", "id": 73, "clinical": "true"})
    entries = registry.read_registry(spark, path)
    assert {r["n_features"] for r in registry.listing(entries).collect()} == {3}
    assert [r["name"] for r in registry.all_general(entries).collect()] == ["yawl"]
    asked = spark.createDataFrame([("ward",), ("raft",), ("yawl",)], "name string")
    found = {r["name"]: r["request"] for r in registry.select_requested(entries, asked).collect()}
    assert found == {"ward": "clinical", "raft": "unknown", "yawl": "known"}


@pytest.mark.parametrize(
    "entries",
    [
        [{"positive": "perhaps"}],
        [{"hull": "draught"}],
        [{"hull": "harbour"}],
        [{"hull": "afloat"}],
        [{"clinical": "1"}],
        [{}, {"id": 99}],
        [{"name": "yawl"}, {"name": "ketch"}],
        [],
    ],
)
def test_refused_registries(spark, tmp_path, entries):
    with pytest.raises(ValueError):
        registry.read_registry(spark, _file(tmp_path, *entries))
    with pytest.raises(ValueError, match="version"):
        registry.read_registry(spark, _file(tmp_path, {}, version=2))


def test_contract_on_a_landed_table(spark, tmp_path):
    entries = registry.read_registry(spark, _file(tmp_path, {}))
    manifest = spark.createDataFrame(
        [("skiff", 71, 6, "c0ffee")],
        "name string, openml_id_found long, version_found long, md5_checksum_found string",
    )
    landed = ("length", "draught", "hull", "harbour")

    def status(labels, columns=landed, man=manifest):
        frame = spark.createDataFrame([("skiff", x) for x in labels], "name string, label string")
        seen = registry.observed_labels(frame, entries, "label")
        numeric = ("length", "draught", "harbour")
        return registry.contract_status(entries, man, seen, columns, numeric, "afloat").first()["status"]

    mixed = ["yes", "yes", "no", "yes", "no"]
    assert status(mixed) == "ok"
    assert status([*mixed, "no"]) == "row_count"
    assert status([None, *mixed[1:]]) == "missing_target"
    assert status(["maybe", *mixed[1:]]) == "classes"
    assert status(mixed, landed[1:]) == "columns"
    older = manifest.withColumn("version_found", F.lit(5))
    assert status(mixed, man=older) == "identity_mismatch"
