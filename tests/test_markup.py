"""HTML tables and nested JSON: golden cases, broken input."""

from __future__ import annotations

from cadastra.functions import nested
from cadastra.sources import markup


def rows(html):
    return [(t, i, at, h, v) for t, i, at, h, v in markup.parsed(html)]


def test_plain_table():
    html = "<table><tr><th>name</th><th>rate</th></tr><tr><td> a  b</td><td>1 234,5</td></tr></table>"
    assert rows(html) == [(0, 0, 0, "name", "a b"), (0, 0, 1, "rate", "1 234,5")]


def test_unclosed_tags_scripts_comments_and_entities():
    html = "<body><TABLE class=x><TR><TH>k<TH>v<tr><td>a&amp;b<script>var t='<td>x</td>';</script><td><!-- <td>no --><b>2<p>3<tr><td>c"
    assert rows(html) == [(0, 0, 0, "k", "a&b"), (0, 0, 1, "v", "2 3"), (0, 1, 0, "k", "c")]


def test_levels_of_headers_and_spans():
    html = """<table><thead><tr><th rowspan=2>Day<th colspan=2>Rate</th><th></tr><tr><th>buy<th>sell<th></thead>
    <tbody><tr><td rowspan=3>Mon<td>1<td>2<td></tr><tr><td colspan=2>closed</tr><tr><td><td></td></tr></tbody><tfoot><tr><td>sum<td>1</table>"""
    assert rows(html) == [
        (0, 0, 0, "Day", "Mon"), (0, 0, 1, "Rate buy", "1"), (0, 0, 2, "Rate sell", "2"), (0, 1, 0, "Day", "Mon"), (0, 1, 1, "Rate buy", "closed"), (0, 1, 2, "Rate sell", "closed"),
        (0, 2, 0, "Day", "Mon"), (0, 3, 0, "Day", "sum"), (0, 3, 1, "Rate buy", "1"),
    ]


def test_names_of_columns_without_a_header():
    assert [r[3] for r in rows("<table><tr><td>1<td>2</table>")] == ["0", "1"]
    assert [r[3] for r in rows("<table><tr><th>a<th></th></tr><tr><td>1<td>2</table>")] == ["a", "Col_1"]


def test_nested_tables_and_empty_rows_and_columns():
    html = "<table><tr><td>out <table><tr><td>in</table> side<td></tr><tr><td></td></tr><tr><td>x<td></table>"
    assert rows(html) == [(0, 0, 0, "0", "out in side"), (0, 2, 0, "0", "x"), (1, 0, 0, "0", "in")]


def test_spans_of_any_size():
    assert rows("<table><tr><td colspan=99999999999>a<tr><td rowspan=0>b<tr><td>c</table>")[-2:] == [(0, 2, 0, "0", "b"), (0, 2, 1, "1", "c")]
    assert len(rows("<table><tr><td colspan=99999999999>a</table>")) == markup.COLUMNS
    assert rows("<table><tr><td colspan=x rowspan=-3>a</table>") == [(0, 0, 0, "0", "a")]
    assert rows("</table><td>x</td>") == rows("") == rows("<table></table>") == []


def test_batches_of_cells(spark, monkeypatch):
    many = "<table>" + "<tr><td>1<td>2</tr>" * 30_000 + "</table>"
    df = spark.createDataFrame([("a", many), ("b", None), ("c", "no table"), (None, "<table><tr><td>z")], "table_id string, html string")
    out = markup.tables(df, "table_id", "html")
    assert {(r["table_id"], r["count"]) for r in out.groupBy("table_id").count().collect()} == {("a", 60_000), (None, 1)}
    assert out.filter("line = 29999 AND at = 1 AND value = '2'").count() == 1


def test_leaves_and_malformed(spark):
    texts = [(1, '{"a": {"b": [1, "x", null], "c": {}}, "d": true}'), (2, "[]"), (3, "3.5"), (4, "{oops"), (5, None), (6, '{"k": [[1, [2]]]}'), (7, ""), (8, '{"é.x": "a\\nb"}')]
    df = spark.createDataFrame(texts, "id int, text string")
    found = sorted(map(tuple, nested.leaves(df, "id", "text", depth=3).collect()))
    expected = [
        (1, "a.b.0", "BIGINT", "1"), (1, "a.b.1", "STRING", "x"), (1, "a.b.2", "VOID", None), (1, "d", "BOOLEAN", "true"), (3, "", "DECIMAL", "3.5"),
        (6, "k.0.0", "BIGINT", "1"), (6, "k.0.1", "ARRAY", "[2]"), (8, "é.x", "STRING", "a\nb"),
    ]
    assert found == expected
    assert sorted(r["id"] for r in nested.malformed(df, "id", "text").collect()) == [4, 7]
