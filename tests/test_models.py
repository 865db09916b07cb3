import json
import math

from plumbline.operators.components import components
from plumbline.operators.fit import fit_temperatures
from plumbline.streaming.requests import serve


def test_fitted_temperature_is_the_least_loss(spark):
    rows = [("choice", [0.9, 0.1], int(i % 4 == 0)) for i in range(100)] + [("bool", [0.6, 0.4], 0)] * 10
    found = fit_temperatures(spark.createDataFrame(rows, "type string, p array<double>, label int"))
    assert found["bool"] == 0.05  # always right: as sharp as allowed
    assert abs(found["choice"] - math.log(9) / math.log(3)) < 2e-3  # 3/4 right


def test_components(spark):
    links = spark.createDataFrame([(1, 12), (11, 12), (11, 15), (2, 20), (None, 3), *[(i, i + 1) for i in range(100, 140)]], "a long, b long")
    found = {r.node: r.component for r in components(links, "a", "b").collect()}
    assert found == {1: 1, 12: 1, 11: 1, 15: 1, 2: 2, 20: 2, **{i: 100 for i in range(100, 141)}}
    assert components(links.limit(0), "a", "b").collect() == []


def test_stream_of_requests(spark, tmp_path):
    good = {"id": "a", "type": "bool", "options": ["yes", "no"], "logits": [0, 2]}
    lines = [json.dumps(good), "nonsense", json.dumps(good | {"options": ["x", "x"]}), json.dumps({"id": "b", "type": "score"}), json.dumps(good | {"logits": [1]}), json.dumps({"type": "bool"})]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.txt").write_text("\n".join(lines) + "\n")
    for _ in range(2):  # a second run finds nothing new
        serve(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out", f"file://{tmp_path}/state").awaitTermination()
    rows = spark.read.parquet(f"file://{tmp_path}/out").collect()
    assert sorted((r.top or "", r.error or "") for r in rows) == sorted([("no", ""), ("", "not a JSON request"), ("", "options must differ"), ("", "between 2 and 26 options are needed"), ("", "one logit for each option is needed"), ("", "id is missing")])
