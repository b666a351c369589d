"""Structured contents: parts of every level and both spellings survive the read."""

import json

from canopy.plans import catalogue
from canopy.sources import articles as A
from canopy.sources.scratch import scratch_dir
from tests.conftest import SMALL
from tests.oracle import compare


def _nest(spelling, depth, at=1):
    part = {"name": f"n{at}", "type": "section", "value": f"v{at}", "values": ["a", "b"],
            "links": [{"url": "u", "text": "t", "images": [{"content_url": "i", "width": 3}]}],
            "images": [{"content_url": "c"}], "citations": [{"identifier": "x", "group": "g", "text": "[1]"}]}
    if at < depth:
        part[spelling] = [_nest(spelling, depth, at + 1), {"name": f"side{at}"}]
    return part


def test_parts_of_every_level_in_both_spellings(spark):
    rest = {"tables": [{"identifier": "t1", "rows": [[{"value": "z", "nested_table": {"identifier": "t2"}}]]}],
            "references": [{"identifier": "r1", "metadata": {"k": "v"}, "text": {"value": "w"}}]}
    records = [
        {"identifier": 1, "name": "snake", "date_modified": "d", "sections": [_nest("has_parts", 6)], **rest},
        {"identifier": 2, "name": "camel", "dateModified": "d", "articleSections": [_nest("hasParts", 6)], **rest},
        {"identifier": 3, "name": "none", "date_modified": "d", "sections": []},
    ]
    root = scratch_dir(spark, "structured-test")
    spark.createDataFrame([(json.dumps(r),) for r in records], "value string").write.mode("overwrite").text(root)
    df = A.read_structured(spark, root)
    kept = {r.identifier: r for r in df.collect()}
    for i in (1, 2):
        assert json.loads(kept[i].tables) == rest["tables"] and json.loads(kept[i].references) == rest["references"]
        assert kept[i].date_modified == "d"
    rows = A.unfold_parts(df, ["identifier"], "sections").collect()
    for i in (1, 2):
        got = {tuple(r.path): r for r in rows if r.identifier == i}
        assert {p: r.name for p, r in got.items()} == \
            {**{(0,) * d: f"n{d}" for d in range(1, 7)}, **{(0,) * d + (1,): f"side{d}" for d in range(1, 6)}}
        deep = got[(0,) * 6]
        assert (deep.value, deep["values"], deep.pos) == ("v6", ["a", "b"], 0)
        assert deep.links[0].images[0].width == 3 and deep.images[0].content_url == "c"
        assert deep.citations[0].text == "[1]"
    assert [(r.path, r.pos, r.name) for r in rows if r.identifier == 3] == [(None, None, None)]


def test_structured_sections_matches_sql(spark):
    name = "structured_sections"
    assert compare(catalogue.queries()[name](spark, SMALL), catalogue.oracle_sql()[name], SMALL) > 0
