import pytest

from orrerium.sources import graphs, tables


def test_graphs_in_lines_hold_no_node_whole(spark, tmp_path):
    members = spark.range(5000).selectExpr("'c' AS config_id", "concat('n', CAST(id % 2 AS STRING)) AS node_id", "id AS row_index")
    members = members.unionByName(members.limit(10))
    edges = spark.createDataFrame([("c", "n0", "n1")], "config_id string, source string, target string")
    path = f"file://{tmp_path}/g.jsonl"
    tables.graph_lines(members, edges, most=100).select("json").write.text(path)
    assert max(len(r.value) for r in spark.read.text(path).collect()) < 5000
    got = [(r.node_id, r.row_index) for r in tables.graph_members(spark, path, "c").collect()]
    assert len(got) == 5000 and set(got) == {(f"n{i % 2}", i) for i in range(5000)}
    assert [(r.source, r.target) for r in tables.graph_edges(spark, path).collect()] == [("n0", "n1")]


def test_membership_comes_from_graphs_in_lines(spark, tmp_path):
    members = spark.range(300).selectExpr("'c' AS config_id", "concat('n', CAST(id % 2 AS STRING)) AS node_id", "id AS row_index")
    for name, end in (("good", "n1"), ("bad", "n9")):
        edges = spark.createDataFrame([("c", "n0", end)], "config_id string, source string, target string")
        tables.graph_lines(members, edges, most=50).select("json").write.text(f"file://{tmp_path}/{name}.jsonl")
    found, _ = graphs.resolve_membership(spark, "c", [graphs.MemberSource("graph", f"file://{tmp_path}/good.jsonl")], members)
    assert {(r.node_id, r.row_index) for r in found.collect()} == {(f"n{i % 2}", i) for i in range(300)}
    with pytest.raises(ValueError, match="unknown node"):
        graphs.resolve_membership(spark, "c", [graphs.MemberSource("graph", f"file://{tmp_path}/bad.jsonl")])
