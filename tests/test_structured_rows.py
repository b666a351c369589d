"""Nested tables, references, media and entities as rows; bad lines are set aside."""

import json

import pytest

from canopy.sources import structured as X
from canopy.sources.scratch import scratch_dir

KEY = ["identifier"]


def table(name, depth):
    cell = {"value": f"c{depth}"}
    if depth > 1:
        cell["nested_table"] = table(f"{name}.{depth - 1}", depth - 1)
    return {"identifier": name, "confidence_score": 0.5, "headers": [[{"value": "h1"}, {"value": "h2"}]],
            "rows": [[{"value": "a"}, cell], [cell]], "footers": []}


def camel(x):
    if isinstance(x, dict):
        return {X._camel(k) if k != "access_date" else k: camel(v) for k, v in x.items()}
    return [camel(v) for v in x] if isinstance(x, list) else x


LINK = {"url": "u", "text": "t", "images": [{"content_url": "li", "width": 3}]}
RECORD = {
    "identifier": 1, "name": "one", "tables": [table("t", 4), {"identifier": "empty"}],
    "references": [{"identifier": "r1", "group": "g", "type": "web", "metadata": {"access_date": "2024", "k": "v"},
                    "text": {"value": "said", "links": [LINK, {"url": "u2"}]}, "source": {"value": "src", "links": [LINK]}},
                   {"identifier": "r2"}],
    "main_entity": {"identifier": "Q1", "url": "e1"}, "additional_entities": [{"identifier": "Q2", "aspects": ["S", "T"]}],
    "article_sections": [{"name": "s", "has_parts": [{"name": "p", "links": [LINK], "citations": [{"identifier": "x", "text": "[1]"}],
                                                       "images": [{"alternative_text": "alt", "height": 9}], "values": ["1", "2"]}]}],
}


@pytest.fixture(scope="module")
def read(spark):
    root = scratch_dir(spark, "variant")
    other = {**camel(RECORD), "identifier": 2}
    odd = {"identifier": 3, "tables": [5, "x", None, {"rows": [7, [None, {"value": "kept"}]]}], "references": {"not": "a list"},
           "sections": "text", "main_entity": None}
    lines = [json.dumps(RECORD), json.dumps(other), json.dumps(odd), "{broken", "[1, 2]", "", "17"]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(root)
    return X.read_records(spark, root)


def test_bad_lines_are_set_aside(read):
    good, bad = read
    assert sorted(r.identifier for r in good.collect()) == [1, 2, 3]
    assert sorted(r.line for r in bad.collect()) == ["17", "[1, 2]", "{broken"]
    assert all(r.file for r in bad.collect())


def want_cells(t, path):
    out = []
    for s in X.SECTIONS:
        for i, line in enumerate(t.get(s, [])):
            for j, cell in enumerate(line):
                out.append((tuple(path), s, i, j, cell["value"], "nested_table" in cell))
                if "nested_table" in cell:
                    out += want_cells(cell["nested_table"], [*path, X.SECTIONS.index(s), i, j])
    return out


def test_cells_of_nested_tables(read):
    found = X.tables(read[0], KEY)
    rows = X.cells(found, KEY).collect()
    want = [c for k, t in enumerate(RECORD["tables"]) for c in want_cells(t, [k])]
    for i in (1, 2):
        assert sorted((tuple(r.path), r.section, r.row, r.col, r.value, r.nested) for r in rows if r.identifier == i) == sorted(want)
        ids = {tuple(r.path): (r.table_id, r.confidence_score) for r in found.collect() if r.identifier == i}
        assert ids[(0,)] == ("t", 0.5) and ids[(0, 1, 0, 1, 1, 1, 0)] == ("t.3.2", 0.5) and len(ids) == 16
    assert [(tuple(r.path), r.row, r.col, r.value) for r in rows if r.identifier == 3 and r.value] == [((3,), 1, 1, "kept")]


def test_references_links_and_images(read):
    found = X.references(read[0], KEY)
    for i in (1, 2):
        rows = {r.pos: r for r in found.collect() if r.identifier == i}
        assert (rows[0].reference_id, rows[0].group, rows[0].type, rows[0].text, rows[0].source) == ("r1", "g", "web", "said", "src")
        assert rows[0].metadata == {"access_date": "2024", "k": "v"} and rows[1].metadata is None and rows[1].text is None
        linked = X.reference_links(found, KEY)
        got = sorted((r.ref, r.place, r.pos, r.url, r.text) for r in linked.collect() if r.identifier == i)
        assert got == [(0, "source", 0, "u", "t"), (0, "text", 0, "u", "t"), (0, "text", 1, "u2", None)]
        pics = X.images(linked, [*KEY, "ref", "place"], linked["link"]).collect()
        assert sorted((r.place, r.content_url, r.width) for r in pics if r.identifier == i) == [("source", "li", 3), ("text", "li", 3)]


def test_parts_media_and_entities(read):
    p = X.parts(read[0], KEY, "sections", "article_sections")
    for i in (1, 2):
        assert {tuple(r.path): (r.name, r["values"]) for r in p.collect() if r.identifier == i} == \
            {(0,): ("s", None), (0, 0): ("p", ["1", "2"])}
        own = [*KEY, "path"]
        assert [(tuple(r.path), r.url) for r in X.links(p, own, p["part"]).collect() if r.identifier == i] == [((0, 0), "u")]
        assert [(r.alternative_text, r.height) for r in X.images(p, own, p["part"]).collect() if r.identifier == i] == [("alt", 9)]
        assert [r.text for r in X.citations(p, own, p["part"]).collect() if r.identifier == i] == ["[1]"]
        assert sorted((r.pos, r.entity_id, r.url, r.aspects) for r in X.entities(read[0], KEY).collect() if r.identifier == i) == \
            [(-1, "Q1", "e1", None), (0, "Q2", None, ["S", "T"])]
