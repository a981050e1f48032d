import json

from weirstone.operators import nested as N

SCHEMA = "gold_id bigint, condition_by_condition string, holistic_alignment string, location_targets array<array<struct<path:string,start_line:int,end_line:int,symbol:string,evidence_id:string,route:string>>>, depth string"


def _rows(spark, *rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)


def test_numbers_count_null_elements(spark):
    loc = {"file_path": "a.py", "line_ranges": [None, {"start": 3}, [4, 6], "7-9", {"start_line": "10", "end_line": "12"}]}
    text = json.dumps({"evidence": [None, {"locations": loc}, {"locations": json.dumps([None, loc])}]})
    df = _rows(spark, (1, text, None, None), (1, text, None, None))
    got = {tuple(r)[2:] for r in N.line_ranges(df).collect()}
    assert got == {(e, n, r, a, b) for e, n in ((2, 1), (3, 2)) for r, a, b in ((2, 3, 3), (3, 4, 6), (4, 7, 9), (5, 10, 12))}


def test_texts_that_say_json_and_ones_that_do_not(spark):
    good = json.dumps(json.dumps({"evidence": {"locations": {"lineRanges": {"start": 1, "end": 2}}}}))
    rows = [(1, good, '{"evidence": [', None), (2, "", "null", []), (3, "[]", "NaN", None), (None, good, None, None), (4, None, None, [None, [None, ("p", 5, None, None, None, None)]])]
    got = sorted(tuple(r) for r in N.line_ranges(_rows(spark, *rows)).collect())
    assert got == [(1, "condition_by_condition", 1, 1, 1, 1, 2), (4, "location_targets", 2, 1, 2, 5, 5)]


def test_intervals_nest(spark):
    text = json.dumps({"evidence": [{"locations": [{"line_ranges": [{"start": i}]}]} for i in range(1, 4)]})
    nodes = N.nodes(_rows(spark, (1, text, text, None))).collect()
    for a in nodes:
        for b in nodes:
            if a.field == b.field and a.pre < b.pre < a.post:
                assert b.post < a.post
    ranges = N.flat(_rows(spark, (1, text, None, None)), "range").collect()
    assert [(r.evidence_no, r.line_start) for r in sorted(ranges, key=lambda r: r.pre)] == [(1, 1), (2, 2), (3, 3)]


def test_empty_table(spark):
    assert N.line_ranges(_rows(spark)).count() == 0
