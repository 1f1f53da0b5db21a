"""Descriptions that break a rule: an error, or a warning and the default."""

import warnings

import pytest

from tabweave.model import TableGroup


def group(column=None, **table):
    return TableGroup.of({"url": "t.csv", "tableSchema": {"columns": [{"name": "a", **(column or {})}]}, **table})


@pytest.mark.parametrize(
    "value",
    [
        {"@unknown": 1},
        {"@value": "x", "@type": "xsd:string", "@language": "en"},
        {"@value": "x", "dc:title": "y"},
        {"@value": {"a": 1}},
        {"@language": "en"},
        {"@id": "_:b"},
        {"@type": "_:b"},
        {"@type": "no-such-term"},
        {"@type": 5},
        [{"dc:x": {"@id": "_b"}}],
    ],
)
def test_common_properties_that_are_errors(value):
    with pytest.raises(ValueError):
        group(**{"dc:subject": value})


@pytest.mark.parametrize("value", ["text", 5, {"@value": "x", "@language": "en"}, {"@value": 1.5}, {"@type": "schema:Thing"}, {"@type": ["Table", "http://example.org/T"]}, {"@id": "http://example.org", "dc:x": ["y"]}])
def test_common_properties_that_are_fine(value):
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        assert group(**{"dc:subject": value}).tables[0].common == {"dc:subject": value}


def test_a_wrong_language_is_left_out():
    with pytest.warns(UserWarning, match="language"):
        made = group(**{"dc:subject": {"@value": "x", "@language": "1 2"}})
    assert made.tables[0].common == {"dc:subject": {"@value": "x"}}


@pytest.mark.parametrize(
    "name, wrong, stands_in",
    [("null", [1], [""]), ("lang", "!", "und"), ("default", 5, ""), ("separator", ["x"], None), ("required", "yes", False), ("ordered", "no", False), ("textDirection", "up", None)],
)
def test_inherited_properties(name, wrong, stands_in):
    with pytest.warns(UserWarning, match=name):
        made = group({name: wrong})
    assert made.tables[0].schema.columns[0].own[name] == stands_in


@pytest.mark.parametrize("table", [{"@type": "Schema"}, {"@id": "_:x"}, {"dialect": {"@type": "Table"}}, {"transformations": [{"@type": "Dialect"}]}])
def test_types_and_ids_of_descriptions(table):
    with pytest.raises(ValueError):
        group(**table)


def test_what_is_no_description_warns():
    for table in ({"dialect": "none"}, {"transformations": "none"}, {"tableDirection": "up"}):
        with pytest.warns(UserWarning):
            group(**table)
    with pytest.warns(UserWarning, match="language"):
        made = group({"titles": {"en": "A", "not a tag": "B"}})
    assert made.tables[0].schema.columns[0].titles.values == {"en": ["A"]}
    assert TableGroup.of({"@type": "TableGroup", "tables": [{"@type": "Table", "url": "t.csv", "tableSchema": {"@type": "Schema", "columns": [{"@type": "Column", "name": "a"}]}}]}).tables


def test_titles_in_another_language_warn():
    from tabweave.operators.scan import match_header

    table = group({"titles": {"de": "Name", "en": "name"}}, lang="en").tables[0]
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        assert match_header(table, ["name"], strict=False)[0][0] == "a"
    with pytest.warns(UserWarning, match="titled in de"):
        match_header(table, ["Name"], strict=False)
