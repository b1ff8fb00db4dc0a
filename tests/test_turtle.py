"""Turtle reader and writer: grammar, errors, and files of many splits against a plain generator."""

import random

import pytest

from tidewarden.sinks import files
from tidewarden.sources import turtle
from tidewarden.triples import model

NAMES = {"ts": "urn:ts#", "tsd": "urn:d#", "rdf": turtle.RDF, "xsd": turtle.XSD}
HEAD = "".join(f"@prefix {k}: <{v}> .\n" for k, v in NAMES.items())


def parse(text, scope=None):
    parser = turtle.Parser(scope or turtle.Scope({}, "", "f", "p"))
    parser.read(text)
    short = turtle.shortener(NAMES)
    show = lambda t: short(t[1]) if t[0] == "iri" else t[1]
    return [(show(s), short(p), show(o), o[0], o[2] and short(o[2]), o[3]) for s, p, o in parser.triples]


def objects(text):
    return [t[2:] for t in parse(f"{HEAD} tsd:a ts:p {text} .")]


def test_literals():
    assert objects(r'''"a\u20AC\u00e9\t\"\\", 'it"s', """x "y" "" z
    """, """it's""" , "Haus"@de, "Haus"@de-CH, "Haus", "2026-01-01"^^xsd:date, ""''') == [
        ('a€é\t"\\', "literal", None, None),
        ('it"s', "literal", None, None),
        ('x "y" "" z\n    ', "literal", None, None),
        ("it's", "literal", None, None),
        ("Haus", "literal", None, "de"),
        ("Haus", "literal", None, "de-ch"),
        ("Haus", "literal", None, None),
        ("2026-01-01", "literal", "xsd:date", None),
        ("", "literal", None, None),
    ]
    assert objects('"""abc"""') == [("abc", "literal", None, None)]
    assert objects("5, -1.5, .5, 1e3, 1.E3, true, false") == [
        ("5", "literal", "xsd:integer", None),
        ("-1.5", "literal", "xsd:decimal", None),
        (".5", "literal", "xsd:decimal", None),
        ("1e3", "literal", "xsd:double", None),
        ("1.E3", "literal", "xsd:double", None),
        ("true", "literal", "xsd:boolean", None),
        ("false", "literal", "xsd:boolean", None),
    ]
    assert parse(f"{HEAD} tsd:a ts:p 5.\ntsd:b ts:p tsd:c.d.")[1][2] == "tsd:c.d"


def test_addresses_and_scopes():
    text = """BASE <http://a.org/x/>
    PREFIX : <#>
    <y> a :Thing ; :of <../z>, <http://b.org/?q=1#f>, <\\u00e9> .
    @base <sub/> . @prefix e: <e/> .
    <y> e:of e:a\\-b, :c%20d, e:, e:1:2 .
    @prefix e: <urn:new:> .
    e:a e:b e:c ."""
    assert [t[:3] for t in parse(text)] == [
        ("<http://a.org/x/y>", "rdf:type", "<http://a.org/x/#Thing>"),
        ("<http://a.org/x/y>", "<http://a.org/x/#of>", "<http://a.org/z>"),
        ("<http://a.org/x/y>", "<http://a.org/x/#of>", "<http://b.org/?q=1#f>"),
        ("<http://a.org/x/y>", "<http://a.org/x/#of>", "<http://a.org/x/é>"),
        ("<http://a.org/x/sub/y>", "<http://a.org/x/sub/e/of>", "<http://a.org/x/sub/e/a-b>"),
        ("<http://a.org/x/sub/y>", "<http://a.org/x/sub/e/of>", "<http://a.org/x/#c%20d>"),
        ("<http://a.org/x/sub/y>", "<http://a.org/x/sub/e/of>", "<http://a.org/x/sub/e/>"),
        ("<http://a.org/x/sub/y>", "<http://a.org/x/sub/e/of>", "<http://a.org/x/sub/e/1:2>"),
        ("<urn:new:a>", "<urn:new:b>", "<urn:new:c>"),
    ]


def test_blank_nodes_and_collections():
    got = parse(f"""{HEAD} tsd:s a ts:Shape ; ts:property [ ts:path ts:a ; ts:min 1 ; ] , [ ] ;
      ts:list ( "x" [ ts:q "y" ] () ) ; . # note . here
    [ ts:only "z" ] .
    [] ts:p _:l . _:l ts:p _:l.""")
    assert len(got) == 16
    assert [t[2] for t in got if t[1] == "ts:path"] == ["ts:a"]
    assert sum(t[1] == "rdf:first" for t in got) == 3 and sum(t[2] == "rdf:nil" for t in got) == 2
    last = got[-1]
    assert last[0] == last[2] == got[-2][2] != got[-2][0]


@pytest.mark.parametrize("text", [
    'tsd:a ts:p "x" "y" .', "tsd:a ts:p .", "tsd:a .", "tsd:a ts:p nope:b .", r'tsd:a ts:p "\q" .', 'tsd:a ts:p "x', "tsd:a ~~~ .",
    "tsd:a ts:p tsd:b", '"x" ts:p tsd:b .', "tsd:a ts:p [ ts:q ] .", "tsd:a ts:p ( tsd:b .", "tsd:a ts:p ] .", "tsd:a ts:p tsd:b ; ts:q .",
    "[] .  ; .", "tsd:a [] tsd:b .", '@prefix x <urn:x> .', "tsd:a ts:p , tsd:b .",
])
def test_errors(text):
    with pytest.raises(ValueError):
        parse(HEAD + text)


def test_hostile_text_is_read_in_linear_time():
    import time

    for text in ("[" * 200_000, "(" * 200_000, '"' * 300_001, "'''" + "''" * 200_000, "a:b." * 100_000, "<" * 300_000, "\\" * 300_000):
        began = time.process_time()
        with pytest.raises(ValueError):
            parse(HEAD + "tsd:a ts:p " + text)
        turtle.after_line(text, 0), turtle.after_line(text, 1)
        assert time.process_time() - began < 5


def generated(seed, n):
    """A document in many spellings, and its triples with blank nodes named by what they hold."""
    rnd = random.Random(seed)
    serial = iter(range(10**9))
    text, triples = [HEAD], set()
    space = {"ts": "urn:ts#"}

    def literal():
        key = f"k{next(serial)}"
        value = key + "".join(rnd.choice(["a", " ", ".", '"', "'", "\n", "\\", "é", "🙂", "# no", "@prefix x: <y> .", "\t"]) for _ in range(rnd.randint(0, 9)))
        escaped = value.replace("\\", "\\\\")
        one = escaped.replace("\n", "\\n").replace("\t", "\\t")
        style = rnd.randrange(4)
        if style == 0:
            return '"' + one.replace('"', '\\"') + '"', value
        if style == 1:
            return "'" + one.replace("'", "\\'") + "'", value
        quote = '"' if style == 2 else "'"
        return quote * 3 + escaped.replace(quote, "\\" + quote) + quote * 3, value

    def thing(depth):
        """(spelling, name) of an object, its own triples added."""
        kind = rnd.randrange(6) if depth < 3 else 0
        if kind == 4:
            spelling, value = literal()
            name = f"blank {value}"
            triples.add((name, "ts:key", value, "literal", None, None))
            inner = [f"ts:key {spelling}"]
            for _ in range(rnd.randint(0, 2)):
                more, target = thing(depth + 1)
                triples.add((name, "ts:in", *target))
                inner.append(f"ts:in {more}")
            return "[ " + " ; ".join(inner) + " ]", (name, "blank", None, None)
        if kind == 5:
            spelling, value = literal()
            name = f"list {value}"
            triples.add((name, "rdf:first", value, "literal", None, None))
            triples.add((name, "rdf:rest", "rdf:nil", "iri", None, None))
            return f"({spelling})", (name, "blank", None, None)
        if kind in (2, 3):
            name = f"n{rnd.randrange(50)}"
            return rnd.choice([f"tsd:{name}", f"<urn:d#{name}>"]), (f"tsd:{name}", "iri", None, None)
        spelling, value = literal()
        if kind == 1:
            return f"{spelling}@DE", (value, "literal", None, "de")
        return spelling, (value, "literal", None, None)

    for i in range(n):
        if rnd.random() < 0.05:
            space["v"] = f"urn:v{i}#"
            text.append(rnd.choice([f"@prefix v: <{space['v']}> .", f"PREFIX v: <{space['v']}>"]) + "\n")
        subject = f"tsd:s{i}"
        parts = []
        for _ in range(rnd.randint(1, 4)):
            spelling, target = thing(0)
            predicate, full = ("v:p", f"<{space['v']}p>") if "v" in space and rnd.random() < 0.3 else ("ts:p", "ts:p")
            triples.add((subject, full, *target))
            parts.append(f"{predicate} {spelling}")
        text.append(subject + rnd.choice([" ", "\n  "]) + rnd.choice([" ;\n  ", ";", " ; # note . \n"]).join(parts))
        text.append(rnd.choice([" .\n", ".\n", " . ", "\n.\n", " . # end\n", "\n\n . \r\n"]))
    return "".join(text), triples


def named(rows):
    """Triples with blank nodes under the names that ``generated`` gives them."""
    own = {r.s: f"blank {r.o}" for r in rows if r.p == "ts:key"} | {r.s: f"list {r.o}" for r in rows if r.p == "rdf:first"}
    return {(own.get(r.s, r.s), r.p, own.get(r.o, r.o) if r.kind == "blank" else r.o, r.kind, r.datatype, r.lang) for r in rows}


@pytest.mark.parametrize("split,statements", [("128m", 80), ("900", 40), ("70", 6)])
def test_large_file_in_many_splits(spark, tmp_path, split, statements):
    folder = tmp_path / "in"
    folder.mkdir()
    wanted = set()
    for i in range(2):
        text, triples = generated(i, statements)
        (folder / f"f{i}.ttl").write_text(text, newline="")
        wanted |= triples
    (folder / "empty.ttl").write_text("")
    (folder / "bom.ttl").write_text("\ufeff" + HEAD + "tsd:bom ts:p tsd:bom .", encoding="utf-8")
    wanted.add(("tsd:bom", "ts:p", "tsd:bom", "iri", None, None))
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got, errors = turtle.read(spark, str(folder), NAMES)
        assert errors.collect() == []
        assert named(got.collect()) == wanted
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_pieces_end_where_statements_do():
    """Each piece that a serial reader of lines would cut is whole statements."""
    for seed in range(30):
        state, piece = turtle.OUTSIDE, ""
        scope = turtle.Scope({}, "", "f", "p")
        for line in generated(seed, 30)[0].split("\n"):
            state, ends = turtle.after_line(line, state)
            piece += line + "\n"
            if ends:
                turtle.Parser(scope).read(piece)
                piece = ""
        turtle.Parser(scope).read(piece)  # the rest


def test_round_trip_and_counts(spark, tmp_path):
    triples = spark.createDataFrame(
        [
            ("tsd:a", "rdf:type", "ts:E", "iri", None, None, "g"),
            ("tsd:a", "ts:label", 'say "hi"\nthere \\ é\r\t', "literal", None, None, "g"),
            ("tsd:a", "ts:label", "Haus", "literal", None, "de", "g"),
            ("tsd:a", "ts:label", "Haus", "literal", None, None, "g"),
            ("tsd:a", "ts:date", "2026-05-01", "literal", "xsd:date", None, "g"),
            ("tsd:b", "ts:of", "tsd:a", "iri", None, None, "g"),
            ("tsd:b", "ts:of", "tsd:a", "iri", None, None, "g"),
        ],
        turtle.TRIPLE_SCHEMA,
    )
    folder = str(tmp_path / "out")
    assert files.turtle(triples.repartition(3), folder, NAMES) == {"subjects": 2, "triples": 6}
    for part in (tmp_path / "out").glob("part-*"):  # each file by itself
        got, errors = turtle.read(spark, str(part), NAMES)
        assert errors.count() == 0 and (got.count() > 0 or not part.read_text())
    got, errors = turtle.read(spark, folder, NAMES)
    assert sorted(map(str, (tuple(r)[:6] for r in got.drop("graph").distinct().collect()))) == sorted(
        map(str, (tuple(r)[:6] for r in triples.drop("graph").distinct().collect()))
    )
    assert errors.count() == 0


def test_a_bad_file_stops_no_other(spark, tmp_path):
    (tmp_path / "x.ttl").write_text(HEAD + "tsd:b ts:p 1 .\n" * 3 + "tsd:a ~~~ .")
    (tmp_path / "y.ttl").write_text(HEAD + 'tsd:a a ts:E ; ts:n 5, "x"@de .\n# note\n')
    (tmp_path / "z.ttl").write_text("tsd:a a ts:E .")
    (tmp_path / "w.ttl").write_text(HEAD + 'tsd:a a ts:E . tsd:b ts:p """x')
    got, errors = turtle.read(spark, str(tmp_path), NAMES)
    assert sorted((r.o, r.lang) for r in got.select("o", "lang").collect()) == [("5", None), ("ts:E", None), ("x", "de")] or got.count() == 3
    assert sorted(r.file.rsplit("/", 1)[-1] for r in errors.collect()) == ["w.ttl", "x.ttl", "z.ttl"]
    assert model.union(got, got.drop("lang")).count() >= 3
