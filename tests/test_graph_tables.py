import pytest
from pyspark.sql import functions as F

from tidewarden.triples import match, tables
from tidewarden.triples.tables import GraphTables

SCHEMA = "s string, p string, o string, kind string, datatype string, graph string"
ROWS = [
    ("e1", "rdf:type", "E", "iri", None, "g"),
    ("e1", "rdf:type", "E", "iri", None, "h"),  # the same triple of another graph
    ("e1", "at", "l1", "iri", None, "g"),
    ("e1", "at", "l2", "iri", None, "g"),
    ("e1", "ref", "1", "literal", "xsd:integer", "g"),
    ("e2", "rdf:type", "E", "iri", None, "g"),
    ("e2", "ref", "1", "literal", None, "g"),
    ("e2", "note", "l1", "literal", None, "g"),  # a text that is also an address
    ("e3", "rdf:type", "F", "iri", None, "g"),
    ("e3", "ref", "3", "literal", None, "g"),
    ("l1", "label", "x", "literal", None, "g"),
    ("e1", "tag", "a", "literal", None, "g"),
    ("e1", "tag", "b", "literal", None, "g"),
]


def rows(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


@pytest.fixture()
def graph(spark, tmp_path):
    return GraphTables.write(spark.createDataFrame(ROWS, SCHEMA), str(tmp_path / "graph"))


def test_star_equals_joins_of_patterns(spark, graph):
    triples = spark.createDataFrame(ROWS, SCHEMA).dropDuplicates(["s", "p", "o"])
    want = match.solve(triples, [("?e", "rdf:type", "E"), ("?e", "ref", "?ref")])
    want = match.optional(want, triples, [("?e", "at", "?loc")])
    want = match.optional(want, triples, [("?e", "tag", "?tag")]).select("e", "ref", "loc", "tag")
    got = graph.star("e", {"ref": "ref"}, {"at": "loc", "tag": "tag"}, {"rdf:type": "E"})
    assert rows(graph.decode(got, "e", "ref", "loc", "tag").select("e", "ref", "loc", "tag")) == rows(want)
    plain = tables.star(triples, "e", {"ref": "ref"}, {"at": "loc", "tag": "tag"}, {"rdf:type": "E"})
    assert rows(plain.select("e", "ref", "loc", "tag")) == rows(want)


def test_predicates_are_read_alone(graph):
    plan = graph.rows(["ref"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1 and graph.rows(["ref"]).count() == 3
    assert "note" in graph.single and "at" not in graph.single and "tag" not in graph.single


def test_star_takes_one_exchange(graph):
    found = graph.star("e", {"ref": "ref"}, {"at": "loc", "note": "note"}, {"rdf:type": "E"})
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_terms_of_one_text_and_other_kinds_differ(graph):
    assert graph.id_of("l1") != graph.id_of("l1", "literal")
    assert graph.terms().where("value = '1'").count() == 2


def test_missing_predicates_and_empty_graphs(spark, graph, tmp_path):
    assert graph.star("e", {"nowhere": "x"}).count() == 0
    assert {r.x for r in graph.star("e", {"ref": "ref"}, {"nowhere": "x"}).collect()} == {None}
    assert graph.star("e", {"ref": "ref"}, fixed={"rdf:type": "Nothing"}).count() == 0
    empty = GraphTables.write(spark.createDataFrame([], SCHEMA), str(tmp_path / "empty"))
    assert empty.star("e", {"ref": "ref"}).collect() == [] and empty.terms().count() == 0
    with pytest.raises(ValueError):
        tables.star(spark.createDataFrame(ROWS, SCHEMA), "e", {})


def test_hot_object(spark, tmp_path):
    many = spark.range(3000).select(
        F.concat(F.lit("e"), F.col("id").cast("string")).alias("s"), F.lit("rdf:type").alias("p"), F.lit("E").alias("o"),
        F.lit("iri").alias("kind"), F.lit(None).cast("string").alias("datatype"), F.lit("g").alias("graph"),
    )
    graph = GraphTables.write(many.unionByName(many), str(tmp_path / "graph"))
    assert graph.star("e", {"rdf:type": "class"}).count() == 3000
