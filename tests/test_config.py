import json

from millrace import config


def test_substitution_and_profiles(tmp_path):
    (tmp_path / "profiles").mkdir()
    (tmp_path / "c.json").write_text(json.dumps({"a": {"x": "${X:-1}", "y": "${Y}"}, "qc": {"epsilon": 0.1}}), encoding="utf-8")
    (tmp_path / "profiles" / "p.json").write_text(json.dumps({"a": {"y": "z"}, "qc": {"epsilon": 2}}), encoding="utf-8")
    assert config.load(str(tmp_path / "c.json"), env={"Y": "why"})["a"] == {"x": "1", "y": "why"}
    merged = config.load(str(tmp_path / "c.json"), "p", env={"X": "9"})
    assert merged["a"] == {"x": "9", "y": "z"}
    assert config.problems(merged) == ["qc.epsilon: 2 is not between 0.0 and 1.0"]


def test_all_problems_are_listed():
    bad = {"qc": {"epsilon": "no", "union": {"fusion": {"mode": "xor"}}}}
    assert len(config.problems(bad)) == 2 and config.problems({}) == []
