"""Queries of stores and sweeps: Turtle, keyed state, graph tables, as-of joins, concepts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewarden.operators import concepts, profiling, sweeps, synthetic
from tidewarden.plans.cases import CASES_SQL, cases
from tidewarden.plans.catalog import query, table
from tidewarden.plans.pipeline_queries import TRIPLES_SQL, case_triples
from tidewarden.sinks import files
from tidewarden.sources import turtle
from tidewarden.storage import scratch
from tidewarden.streaming.keyed_state import KeyedState
from tidewarden.triples import match, model, quality
from tidewarden.triples.tables import GraphTables

#: Short names of the namespaces that the queries write.
NAMES = {
    "ts": "urn:tidewarden:ts#",
    "tsd": "urn:tidewarden:data#",
    "tss": "urn:tidewarden:terms#",
    "rdf": turtle.RDF,
    "xsd": turtle.XSD,
}


def noted_triples(spark, sf_dir) -> DataFrame:
    """Cases as triples, with a note that needs escapes and a label in a language."""
    i = F.col("event_id")
    event = F.concat(F.lit("tsd:event_"), i.cast("string"))
    note = F.concat("country", F.lit(' "'), F.coalesce("disease", F.lit("-")), F.lit('"\n\\é\t'), i.cast("string"))
    every = model.emit(
        cases(spark, sf_dir),
        [
            *model.is_a(event, "ts:OutbreakEvent"),
            model.literal(event, "ts:note", note),
            model.literal(event, "ts:cases", F.col("cases"), "xsd:integer"),
            model.literal(event, "ts:label", F.col("admin1")),
            model.link(event, "ts:at", F.concat(F.lit("tsd:loc_"), F.col("country"))),
        ],
    )
    return every.withColumn("lang", F.when(F.col("p") == "ts:label", "de"))


def by_subject(triples: DataFrame, *predicates: str) -> DataFrame:
    """(event_id, a column for each predicate) of subjects named event_."""
    values = [F.max(F.when(F.col("p") == p, F.col("o"))).alias(p.split(":")[1]) for p in predicates]
    events = triples.where(F.startswith("s", F.lit("tsd:event_")))
    return events.groupBy(F.substring_index("s", "_", -1).cast("bigint").alias("event_id")).agg(*values)


@query(
    "turtle_read_back",
    f"""WITH {CASES_SQL} SELECT event_id, country || ' "' || coalesce(disease, '-') || '"' || chr(10) || '\\é' || chr(9) || event_id AS note,
      CAST(cases AS VARCHAR) AS cases, admin1 AS label, CASE WHEN admin1 IS NOT NULL THEN 'de' END AS lang FROM cases""",
)
def turtle_read_back(spark, sf_dir):
    """Triples written as Turtle and read again from all part files."""
    path = scratch(spark, "turtle")
    files.turtle(noted_triples(spark, sf_dir), path, NAMES)
    got, _ = turtle.read(spark, path, NAMES)
    langs = got.where("p = 'ts:label'").select(F.substring_index("s", "_", -1).cast("bigint").alias("event_id"), "lang")
    return by_subject(got, "ts:note", "ts:cases", "ts:label").join(langs, "event_id", "left")


@query(
    "turtle_counts",
    f"WITH {CASES_SQL} SELECT CAST(count(*) AS BIGINT) AS subjects, CAST(4 * count(*) + count(admin1) AS BIGINT) AS triples FROM cases",
)
def turtle_counts(spark, sf_dir):
    """What the writer says it wrote."""
    counts = files.turtle(noted_triples(spark, sf_dir), scratch(spark, "turtle"), NAMES)
    return spark.createDataFrame([(counts["subjects"], counts["triples"])], "subjects bigint, triples bigint")


@query(
    "turtle_forms",
    f"WITH {CASES_SQL} SELECT event_id, country, CAST(cases AS VARCHAR) AS first, coalesce(disease, '') || ' \"' || event_id || '\"' || chr(10) || ' . x' AS note FROM cases",
)
def turtle_forms(spark, sf_dir):
    """Blank nodes, collections, languages and long strings, as other writers spell them."""
    i = F.col("event_id").cast("string")
    ts, data = NAMES["ts"], NAMES["tsd"]
    line = F.concat(
        F.lit(f"<{data}event_"), i, F.lit(f"> a <{ts}E> ; # note .\n  <{ts}at> [ <{ts}country> '"), "country",
        F.lit(f"'@en-GB ; <{ts}values> ( "), F.col("cases").cast("string"), F.lit(f" \"x\" ) ] ;\n <{ts}note> \"\"\""),
        F.coalesce("disease", F.lit("")), F.lit(' "'), i, F.lit('"\n . x""" .'),
    )
    path = scratch(spark, "turtle-forms")
    cases(spark, sf_dir).select(line.alias("value")).write.text(path)
    got, _ = turtle.read(spark, path, NAMES)
    patterns = [
        ("?e", "ts:at", "?b"), ("?b", "ts:country", "?country"), ("?b", "ts:values", "?l"), ("?l", "rdf:first", "?first"), ("?e", "ts:note", "?note"),
    ]
    found = match.solve(got, patterns)
    return found.select(F.substring_index("e", "_", -1).cast("bigint").alias("event_id"), "country", "first", "note")


SHAPES_TEXT = f"""@prefix sh: <{quality.SHACL}> . @prefix ts: <{NAMES['ts']}> .
ts:EventShape a sh:NodeShape ; sh:targetClass ts:OutbreakEvent ;
  sh:property [ sh:path ts:referenceId ; sh:minCount 1 ] , [ sh:path ts:hasDisease ; sh:minCount 1 ] ;
  sh:property [ sh:path ts:occursAt ; sh:minCount 1 ] ; sh:property [ sh:path ts:belongsToSituation ; sh:minCount 1 ] ;
  sh:property [ sh:path ts:optionalNote ; sh:minCount 0 ] .
ts:SituationShape a sh:NodeShape ; sh:targetClass ts:OutbreakSituation ; sh:property [ sh:path ts:hasSituationKey ; sh:minCount 1 ] ."""


@query(
    "shapes_of_file",
    f"""WITH {TRIPLES_SQL} SELECT 'tsd:event_' || event_id AS node, 'ts:OutbreakEvent' AS class, 'ts:occursAt' AS missing FROM k WHERE place IS NULL
    UNION ALL SELECT 'tsd:event_' || event_id, 'ts:OutbreakEvent', 'ts:belongsToSituation' FROM k WHERE situation IS NULL""",
)
def shapes_of_file(spark, sf_dir):
    """Cases against shapes that are read from a Turtle file."""
    path = scratch(spark, "shapes")
    spark.createDataFrame([(SHAPES_TEXT,)], "value string").write.text(path)
    found, _ = turtle.read(spark, path, NAMES | {"sh": quality.SHACL})
    return quality.shape_violations(case_triples(spark, sf_dir), quality.read_shapes(found))


STATE = "source string, stage string, record_key string, fingerprint string, processed_at bigint"
#: Batches of the state queries: all events, by their type.
BATCHES_SQL = """b AS (SELECT CAST(user_id AS VARCHAR) AS record_key, event_type AS fingerprint, epoch_us(ts) AS processed_at,
    CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 ELSE 2 END AS batch FROM events)"""
LATEST_SQL = "row_number() OVER (PARTITION BY record_key ORDER BY processed_at DESC, batch DESC, fingerprint DESC) = 1"


def state_batches(spark, sf_dir) -> list[DataFrame]:
    e = table(spark, sf_dir, "events")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = e.select(
        F.lit("events").alias("source"), F.lit("s").alias("stage"), F.col("user_id").cast("string").alias("record_key"),
        F.col("event_type").alias("fingerprint"), micros.alias("processed_at"),
    )
    kind = F.col("fingerprint")
    return [rows.where(kind == "view"), rows.where(kind == "click"), rows.where(~F.coalesce(kind.isin("view", "click"), F.lit(False)))]


@query(
    "keyed_state_upserts",
    f"WITH {BATCHES_SQL} SELECT record_key, fingerprint, processed_at FROM b QUALIFY {LATEST_SQL}",
)
def keyed_state_upserts(spark, sf_dir):
    """The state after three batches, the second of which comes twice."""
    state = KeyedState(spark, scratch(spark, "keyed-state"), STATE)
    first, second, third = state_batches(spark, sf_dir)
    for batch in (first, second, second, third):
        state.upsert(batch)
    state.compact()
    return state.read().select("record_key", "fingerprint", "processed_at")


@query(
    "keyed_state_changes",
    f"""WITH {BATCHES_SQL}, s AS (SELECT * FROM b WHERE batch < 2 QUALIFY {LATEST_SQL}), n AS (SELECT * FROM b WHERE batch = 2 QUALIFY {LATEST_SQL})
    SELECT n.record_key, n.fingerprint FROM n LEFT JOIN s USING (record_key) WHERE s.fingerprint IS DISTINCT FROM n.fingerprint""",
)
def keyed_state_changes(spark, sf_dir):
    """Latest records of the third batch that the state of the others has not, or otherwise."""
    state = KeyedState(spark, scratch(spark, "keyed-state"), STATE)
    latest = KeyedState(spark, scratch(spark, "keyed-batch"), STATE)
    *old, new = state_batches(spark, sf_dir)
    state.upsert(reduce(DataFrame.unionByName, old))
    latest.upsert(new)
    return state.changed(latest.read()).select("record_key", "fingerprint")


@query(
    "graph_tables_star",
    f"WITH {TRIPLES_SQL} SELECT CAST(event_id AS VARCHAR) AS ref, situation, place AS loc, 'tss:' || disease AS disease FROM k",
)
def graph_tables_star(spark, sf_dir):
    """A star over a graph of numbers, written once."""
    graph = GraphTables.write(case_triples(spark, sf_dir), scratch(spark, "graph"))
    found = graph.star(
        "event",
        {"ts:referenceId": "ref", "ts:hasDisease": "disease"},
        {"ts:belongsToSituation": "situation", "ts:occursAt": "loc"},
        {model.A: "ts:OutbreakEvent"},
    )
    return graph.decode(found, "ref", "situation", "loc", "disease").select("ref", "situation", "loc", "disease")


SECONDS = "epoch_us(ts) / 1e6"
#: Waypoints of the sweep queries: purchases and errors by time, the least of each time.
WAYS_SQL = f"""e AS (SELECT event_id, {SECONDS} AS t FROM events),
    w AS (SELECT min(event_id) AS i, {SECONDS} AS pos, min_by(value, event_id) AS v FROM events WHERE event_type IN ('purchase', 'error') GROUP BY 2),
    x AS (SELECT *, lead(i) OVER (ORDER BY pos) AS ni, lead(pos) OVER (ORDER BY pos) AS nat, lead(v) OVER (ORDER BY pos) AS nv FROM w)"""


def timed(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(points, waypoints) of events, by seconds."""
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    e = table(spark, sf_dir, "events").withColumn("t", t)
    ways = e.where(F.col("event_type").isin("purchase", "error"))
    return e.select("event_id", "t"), ways.select(F.col("event_id").alias("i"), F.col("t").alias("at"), F.col("value").alias("v"))


@query(
    "as_of_waypoint",
    f"WITH {WAYS_SQL} SELECT e.event_id, w.i AS waypoint FROM e ASOF LEFT JOIN w ON e.t >= w.pos",
)
def as_of_waypoint(spark, sf_dir):
    points, ways = timed(spark, sf_dir)
    return sweeps.as_of(points, ways.select("at", "i", "v"), "t", "at").select("event_id", F.col("waypoint.i").alias("waypoint"))


@query(
    "nearest_waypoint_of_table",
    f"""WITH {WAYS_SQL}, p AS (SELECT e.event_id, e.t, x.i, x.pos, x.ni, x.nat FROM e ASOF LEFT JOIN x ON e.t >= x.pos)
    SELECT event_id, CASE WHEN pos IS NULL THEN (SELECT arg_min(i, pos) FROM w) WHEN nat IS NULL OR t - pos < nat - t THEN i
      WHEN t - pos > nat - t THEN ni ELSE least(i, ni) END AS waypoint FROM p""",
)
def nearest_waypoint_of_table(spark, sf_dir):
    points, ways = timed(spark, sf_dir)
    return sweeps.nearest(points, ways, "t", "at", "i").select("event_id", F.col("waypoint.i").alias("waypoint"))


@query(
    "piecewise_of_table",
    f"""WITH {WAYS_SQL}, h AS (SELECT * FROM x ORDER BY pos LIMIT 1),
    p AS (SELECT e.event_id, e.t, coalesce(x.pos, h.pos) AS pos, coalesce(x.v, h.v) AS v, CASE WHEN x.pos IS NULL THEN h.nat ELSE x.nat END AS nat,
      CASE WHEN x.pos IS NULL THEN h.nv ELSE x.nv END AS nv FROM e ASOF LEFT JOIN x ON e.t > x.pos, h)
    SELECT event_id, round(CASE WHEN nat IS NULL THEN v ELSE v + (nv - v) * (t - pos) / (nat - pos) END, 4) AS path_value FROM p""",
)
def piecewise_of_table(spark, sf_dir):
    points, ways = timed(spark, sf_dir)
    ways = ways.groupBy("at").agg(F.min_by("v", "i").alias("v"))
    found = sweeps.piecewise(points, ways, "t", "at", "v")
    return found.select("event_id", F.round("path_value", 4).alias("path_value"))


@query(
    "nearest_concepts_of_table",
    """SELECT a.vec_id, CAST(b.vec_id AS VARCHAR) AS concept, round(list_cosine_similarity(list_reverse(a.embedding)::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity
    FROM embeddings a, embeddings b QUALIFY row_number() OVER (PARTITION BY a.vec_id
      ORDER BY list_cosine_similarity(list_reverse(a.embedding)::DOUBLE[], b.embedding::DOUBLE[]) DESC, CAST(b.vec_id AS VARCHAR)) = 1""",
)
def nearest_concepts_of_table(spark, sf_dir):
    """Each vector, turned round, and the nearest of all vectors as they are."""
    every = table(spark, sf_dir, "embeddings")
    asked = every.select("vec_id", F.reverse("embedding").alias("embedding"))
    named = every.select(F.col("vec_id").cast("string").alias("name"), "embedding")
    found = concepts.nearest_concepts(asked, named)
    return found.select("vec_id", "concept", F.round("similarity", 6).alias("similarity"))


@query(
    "sample_of_groups",
    """SELECT event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY md5('42:' || event_id), event_id) <= 20""",
)
def sample_of_groups(spark, sf_dir):
    return profiling.sample(table(spark, sf_dir, "events"), 20, "event_id", by="event_type").select("event_type", "event_id")


def _uniform_sql(name: str) -> str:
    return f"(CAST('0x' || substr(md5('42:' || event_id || ':{name}'), 1, 13) AS BIGINT) / 4503599627370496e0)"


_PICK_SQL = f"""CASE WHEN {_uniform_sql('s')} < 0.3e0 THEN 'west' WHEN {_uniform_sql('s')} < 0.8e0 THEN 'central' ELSE 'swiss' END"""
_POPULATION_SQL = f"""CASE WHEN {_uniform_sql('p')} < 0.6e0 THEN 'wild' WHEN {_uniform_sql('p')} < 0.9e0 THEN 'poultry' ELSE 'captive' END"""
FLYWAY_SQL = f"""f AS (SELECT event_id, {_PICK_SQL} AS stream, {_POPULATION_SQL} AS population FROM events),
    g AS (SELECT *, CAST(greatest(1, floor(CASE population WHEN 'poultry' THEN 20000 WHEN 'captive' THEN 200 ELSE 50 END * {_uniform_sql('a')})) AS INTEGER) AS susceptible FROM f),
    h AS (SELECT *, CAST(least(susceptible, greatest(1, floor(susceptible * {_uniform_sql('b')}))) AS INTEGER) AS cases FROM g),
    m AS (SELECT *, CAST(least(cases, floor(cases * {_uniform_sql('c')})) AS INTEGER) AS dead FROM h)"""


@query("synthetic_events", f"WITH {FLYWAY_SQL} SELECT * FROM m")
def synthetic_events(spark, sf_dir):
    """A made-up outbreak for each event."""
    made = synthetic.flyway_events(table(spark, sf_dir, "events").select("event_id"))
    return made.select("event_id", "stream", "population", "susceptible", "cases", "dead")


@query("synthetic_invariants", "SELECT CAST(count(*) AS BIGINT) AS n, CAST(0 AS BIGINT) AS broken FROM events")
def synthetic_invariants(spark, sf_dir):
    """Made-up outbreaks have no more deaths than cases."""
    made = synthetic.flyway_events(table(spark, sf_dir, "events").select("event_id"))
    return made.agg(F.count("*").alias("n"), F.count(F.when(F.col("dead") > F.col("cases"), 1)).alias("broken"))


@query(
    "hotspot_events",
    f"""WITH u AS (SELECT event_id, {_uniform_sql('h')} AS h, greatest({_uniform_sql('lat:u')}, 1e-12) AS a, {_uniform_sql('lat:v')} AS b FROM events),
    n AS (SELECT *, CASE WHEN h < 0.4e0 THEN 'lake' WHEN h < 0.7e0 THEN 'plain' WHEN h < 0.9e0 THEN 'river' ELSE 'valley' END AS hotspot FROM u)
    SELECT event_id, hotspot, round(CASE hotspot WHEN 'lake' THEN 47.55e0 WHEN 'plain' THEN 46.95e0 WHEN 'river' THEN 47.5e0 ELSE 46.2e0 END
      + 0.1e0 * sqrt(-2 * ln(a)) * cos(6.283185307179586e0 * b), 6) AS lat FROM n""",
)
def hotspot_events(spark, sf_dir):
    made = synthetic.hotspot_events(table(spark, sf_dir, "events").select("event_id"))
    return made.select("event_id", "hotspot", F.round("lat", 6).alias("lat"))


@query(
    "weighted_repetition",
    f"""SELECT event_id, (['a', 'a', 'a', 'b', 'b', 'c'])[CAST(floor({_uniform_sql('w')} * 6) AS BIGINT) + 1] AS name,
      CASE WHEN event_id % 7 <> 0 THEN value END AS value FROM events""",
)
def weighted_repetition(spark, sf_dir):
    """A name for each event from a list that repeats names, and a column that is null at times."""
    u = synthetic.uniform(42, "event_id", F.lit("w"))
    e = synthetic.nullable(table(spark, sf_dir, "events"), "event_id", value=7)
    return e.select("event_id", synthetic.weighted_by_repetition(u, (("a", 3), ("b", 2), ("c", 1))).alias("name"), "value")
