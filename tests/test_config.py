import pytest

from siltstone.plans.config import ConfigError, TableSpec, checked, load_catalogue

GOOD = "table_name: {name}\nsequence: {n}\nprimary_key: id\nscd_type: {kind}\nforeign_keys: {fk}\nunknown_key: 1\nexpected_file_format:\n  expected_headers: [id, x]\n"


def write(folder, **files):
    (folder / "tables").mkdir(parents=True, exist_ok=True)
    for name, text in files.items():
        (folder / "tables" / f"{name}.yaml").write_text(text)


def test_tables_come_in_sequence_and_unknown_keys_are_ignored(tmp_path):
    write(tmp_path, a=GOOD.format(name="child", n=2, kind="none", fk="{x: parent.id}"), b=GOOD.format(name="parent", n=1, kind="SCD2", fk="{}"))
    (tmp_path / "gold_mappings.yaml").write_text("gold_tables:\n  - {gold_table: g, source_tables: [parent], aggregation_type: passthrough}\n")
    got = load_catalogue(tmp_path)
    assert [t.table_name for t in got.tables] == ["parent", "child"] and got.rollups[0].gold_table == "g"
    assert got.table("child").parents() == [("x", "parent", "id")]
    with pytest.raises(ConfigError, match="parent, child"):
        got.table("other")


@pytest.mark.parametrize("text, message", [("sequence: 1\nprimary_key: id\n", "table_name"), (GOOD.format(name="a", n=1, kind="SCD9", fk="{}"), "SCD9"), (GOOD.format(name="a", n=1, kind="none", fk="{x: gone.id}"), "gone")])
def test_bad_declarations_name_the_problem(tmp_path, text, message):
    write(tmp_path, a=text)
    with pytest.raises(ConfigError, match=message):
        load_catalogue(tmp_path)


def test_no_declarations(tmp_path):
    with pytest.raises(ConfigError):
        load_catalogue(tmp_path)


def test_derived_columns():
    t = TableSpec("t", 1, ["a", "b"], "SCD2", {"expected_headers": ["a", "b", "m"]}, business_rules={"m": {"max": 3}, "n": "text"}, effective_start_col="since")
    assert t.keys == ["a", "b"] and t.decimal_columns == ["m"] and t.silver_columns[-3:] == ["since", "effective_end_date", "is_current"]
    assert checked([t]).tables == [t]
