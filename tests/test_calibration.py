from sievework.operators import calibration as c


def scored(spark):
    rows = [(f"k{i}", (i % 100) / 100, "1" if (i % 100) + (i * 7919 % 40) > 70 else "0", i % 20) for i in range(600)]
    return spark.createDataFrame(rows, "row_key string, p double, label string, unit long")


def test_record_passes_on_good_scores(spark):
    r = c.calibration_record(scored(spark), "p", "label", "1", "unit")
    assert r["low"] <= r["auroc"] <= r["high"] and r["auroc"] > 0.9 and all(r["checks"].values()) and r["verdict"] == "passes"
    assert sum(b["rows"] for b in r["reliability"]) == 600


def test_one_class_is_invalid(spark):
    assert c.calibration_record(scored(spark).where("label = '1'"), "p", "label", "1", "unit")["verdict"] == "invalid"


def test_verdicts():
    ok = {"both_classes": True}
    assert c.verdict({"x": False}, 0.9, 0.9) == "invalid" and c.verdict(ok, None, None) == "insufficient"
    assert c.verdict(ok, 0.8, 0.75, target=0.74) == "passes" and c.verdict(ok, 0.8, 0.72, target=0.9) == "fails"
    assert c.verdict(ok, 0.8, 0.5, target=0.9, comparison=0.8, ceiling_low=0.7) == "passes" and c.verdict(ok, 0.8, 0.71) == "passes" and c.verdict(ok, 0.8, 0.6) == "fails"


def test_raters_who_agree_have_a_high_ceiling(spark):
    rows = [(f"k{i}", r, float(i % 2) if (i + r) % 11 else 0.5) for i in range(200) for r in range(3)]
    out = c.rater_ceiling(spark.createDataFrame(rows, "row_key string, rater long, score double"), draws=3).first()
    assert out["draws"] == 3 and out["ceiling"] > 0.9


def test_gate():
    facts = {"rows": {"train": 5}, "label_unmapped": 0, "audit": [], "crossing_pairs": 0, "calibration": "passes", "shared_values": 0}
    assert c.may_send(c.detector_gate(facts)) and not c.may_send(c.detector_gate(facts | {"crossing_pairs": 1}))
    assert not c.may_send(c.detector_gate({**facts, "calibration": "invalid"})) and c.detector_gate({})["D-1"] == "not_computed"


def test_label_mapping(spark):
    d = spark.createDataFrame([("a",), ("b",), (None,)], "v string")
    assert {(r["value"], r["target"]) for r in c.label_mapping_check(d, "v", {"a": "x"}).collect()} == {("a", "x"), ("b", None), (None, None)}
