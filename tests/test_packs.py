"""Directories of YAML and JSON packs."""

import pytest

from quern.sources import ontology, packs


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


HEAD = "version: '1'\nstatus: accepted\nowner: me\npurpose: test\n"


def test_rule_packs_in_yaml(spark, tmp_path):
    (tmp_path / "rules").mkdir()
    (tmp_path / "rules" / "labs.yaml").write_text(HEAD + "rules:\n  - id: a\n    operator: gt\n    threshold: 5.5\n  - id: b\n")
    (tmp_path / "rules" / "none.yml").write_text(HEAD)
    (tmp_path / "rules" / "old.json").write_text('{\n"version": "1", "status": "draft",\n"owner": "x", "purpose": "y", "rules": [{"id": "z"}]}')
    found = ontology.rule_packs(spark, str(tmp_path))
    assert set(found) == {"labs", "none", "old"} and rows(found["labs"], "id", "rule")[0] == ("a", '{"id": "a", "operator": "gt", "threshold": 5.5}')
    assert found["none"].count() == 0 and rows(found["old"], "id") == [("z",)]
    for text, problem in (("- a\n- b\n", "not an object"), ("a: [", "not YAML"), ("version: '1'\n", "lacks"), (HEAD.replace("accepted", "odd"), "status"), (HEAD + "rules:\n  - id: a\n  - id: a\n", "repeated")):
        (tmp_path / "rules" / "none.yml").write_text(text)
        with pytest.raises(ValueError, match=problem):
            ontology.rule_packs(spark, str(tmp_path))


def test_mapping_files_are_merged_in_order(spark, tmp_path):
    entry = "    - {local_code: %s, standard_system: S, display: %s}\n"
    (tmp_path / "vocabularies.yaml").write_text("local_mappings:\n  sex:\n" + entry % ("F", "first") + "  labs:\n" + entry % ("K", "Potassium"))
    (tmp_path / "patient_mappings.yaml").write_text("local_mappings:\n  sex:\n" + entry % ("M", "male") + entry % ("F", "female"))
    (tmp_path / "payer_mappings.json").write_text('{"local_mappings": {"plans": [{"local_code": 7}]}}')
    (tmp_path / "unused.yaml").write_text("local_mappings:\n  other:\n" + entry % ("x", "y"))
    found = packs.local_mappings(spark, str(tmp_path))
    assert rows(found, "family", "local_code", "display", "lookup") == [("labs", "K", "Potassium", "k"), ("plans", "7", None, "7"), ("sex", "F", "female", "f"), ("sex", "M", "male", "m")]
    for lines, problem in ((entry % ("A", "x") * 2, "twice"), ("    - {display: x}\n", "without")):
        (tmp_path / "device_mappings.yaml").write_text("local_mappings:\n  d:\n" + lines)
        with pytest.raises(ValueError, match=problem):
            packs.local_mappings(spark, str(tmp_path))
