"""Triples of outbreak notifications and of report records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewarden.functions import keys, numbers, text
from tidewarden.triples.model import emit, is_a, link, literal

#: Predicates of counts by column, fixed values.
COUNTS = (
    ("Susceptible 1", "ts:susceptibleCount"),
    ("Cases 1", "ts:casesCount"),
    ("Dead 1", "ts:deadCount"),
    ("Killed 1", "ts:killedCount"),
    ("Slaughtered 1", "ts:slaughteredCount"),
    ("Vaccinated 1", "ts:vaccinatedCount"),
)
#: (column, scheme, concept prefix, class, predicate) of an event's concepts.
CONCEPTS = (
    ("Disease name", "diseases", "", "ts:Disease", "ts:hasDisease"),
    ("Disease type", "disease_subtypes", "", "ts:DiseaseSubtype", "ts:hasDiseaseSubtype"),
    ("Country/Territory", "countries", "country-", None, None),
    ("Species 1", "species", "species-", "ts:Species", "ts:hasSpecies"),
    ("Status Continuing/Resolved", "event-status", "status-", None, "ts:hasEventStatus"),
    ("Result type 1", "result-status", "result-", None, None),
    ("Pertinence", "pertinence-values", "pertinence-", None, "ts:hasPertinence"),
)


def node(kind: str, local: Column) -> Column:
    return F.concat(F.lit(f"tsd:{kind}_"), local)


def concept(prefix: str, label: Column) -> Column:
    return F.concat(F.lit(f"tss:{prefix}"), text.dash_slug(label))


def event_month(row: DataFrame | None = None) -> tuple[Column, Column]:
    """(month, date that gave it) by confirmation, suspicion, submission, else unknown."""
    dates = [
        (name, numbers.date_of(text.na_to_null(F.col(c))))
        for name, c in (
            ("confirmation", "Confirmation date"),
            ("suspicion", "Suspicion/Start date"),
            ("submitted", "Submitted on"),
        )
    ]
    month = F.coalesce(*(keys.month_key(d) for _, d in dates), F.lit(keys.UNKNOWN_MONTH))
    source = F.coalesce(*(F.when(d.isNotNull(), F.lit(n)) for n, d in dates), F.lit("unknown"))
    return month, source


def adis_triples(rows: DataFrame, version: str = "0.1.1", row_number: str = "row_number") -> DataFrame:
    """Graphs events, situations, skos and source_rows of notifications, as one table."""

    def col(name: str) -> Column:
        return text.na_to_null(F.col(f"`{name}`"))

    rows = rows.where(text.blank_to_null(F.col("Reference")).isNotNull())
    ref = F.trim("Reference")
    event = node("event", text.dash_slug(ref))
    disease = F.coalesce(text.blank_to_null(F.col("Disease name")), F.lit("unknown"))
    country = F.coalesce(text.blank_to_null(F.col("Country/Territory")), F.lit("unknown"))
    month, _ = event_month()
    key = keys.situation_key(disease, country, month, version)
    situation = node("situation", text.dash_slug(key))
    base = disease if version == "0.1.1" else keys.split_context(disease)[0]
    place = F.concat_ws(
        "-",
        *(
            F.coalesce(F.col(c), F.lit(""))
            for c in (
                "Location",
                "Administrative division level 1",
                "Administrative division level 2",
                "Administrative division level 3",
            )
        ),
    )
    loc = node("loc", text.dash_slug(place))
    lat, lon = numbers.decimal(col("Latitude")), numbers.decimal(col("Longitude"))
    located = lat.isNotNull() & lon.isNotNull()
    unit = col("Measuring unit 1")
    measured = F.when(unit.isNotNull(), node("meas", text.dash_slug(ref)))
    source_row = node("source_row", keys.source_row_id(ref, F.col(row_number)))

    out = [
        *is_a(event, "ts:OutbreakEvent", graph="events"),
        literal(event, "ts:referenceId", ref, graph="events"),
        literal(event, "ts:nationalReferenceId", col("National reference"), graph="events"),
        literal(event, "ts:countryLabel", F.col("Country/Territory"), graph="events"),
        literal(event, "ts:rawEventStatusLabel", F.col("Status Continuing/Resolved"), graph="events"),
        literal(event, "ts:rawPertinenceLabel", F.col("Pertinence"), graph="events"),
        link(event, "ts:occursAt", loc, "events"),
        *is_a(loc, "ts:Location", graph="events"),
        literal(loc, "ts:latitude", F.when(located, lat), "xsd:decimal", "events"),
        literal(loc, "ts:longitude", F.when(located, lon), "xsd:decimal", "events"),
        link(event, "ts:hasMeasurement", measured, "events"),
        *is_a(measured, "ts:Measurement", graph="events"),
        link(measured, "ts:hasMeasuringUnit", concept("unit-", unit), "events"),
        literal(measured, "ts:rawMeasuringUnitLabel", unit, graph="events"),
        *is_a(source_row, "ts:SourceRow", graph="source_rows"),
        literal(source_row, "ts:referenceId", ref, graph="source_rows"),
        link(event, "ts:hasSourceRow", source_row, "events"),
        link(event, "ts:belongsToSituation", situation, "events"),
        *is_a(situation, "ts:OutbreakSituation", graph="situations"),
        literal(situation, "ts:hasSituationKey", key, graph="situations"),
        link(situation, "ts:situationDisease", concept("", base), "situations"),
        link(situation, "ts:situationCountry", node("country", text.dash_slug(country)), "situations"),
        literal(
            situation,
            "ts:situationMonth",
            F.when(month != keys.UNKNOWN_MONTH, month),
            "xsd:gYearMonth",
            "situations",
        ),
        literal(
            situation, "ts:situationMonth", F.when(month == keys.UNKNOWN_MONTH, month), graph="situations"
        ),
        *_concept_of("measuring-units", concept("unit-", unit), unit, None),
    ]
    for predicate, column in (
        ("ts:confirmationDate", "Confirmation date"),
        ("ts:suspicionStartDate", "Suspicion/Start date"),
        ("ts:submissionDate", "Submitted on"),
    ):
        out.append(literal(event, predicate, numbers.date_of(col(column)), "xsd:date", "events"))
    for predicate, column in (
        ("ts:locationLabel", "Location"),
        ("ts:adminLevel1Label", "Administrative division level 1"),
        ("ts:adminLevel2Label", "Administrative division level 2"),
        ("ts:adminLevel3Label", "Administrative division level 3"),
    ):
        out.append(literal(loc, predicate, col(column), graph="events"))
    for column, scheme, prefix, kind, predicate in CONCEPTS:
        label = {"Disease name": base, "Country/Territory": country}.get(column, col(column))
        own = F.when(label.isNotNull(), concept(prefix, label))
        out += _concept_of(scheme, own, label, kind)
        if predicate:
            out.append(link(event, predicate, own, "events"))
    for column, predicate in COUNTS:
        value = numbers.decimal(col(column)).try_cast("int")
        out.append(literal(measured, predicate, value, "xsd:integer", "events"))
    return emit(rows, out)


def _concept_of(scheme: str, own: Column, label: Column, kind: str | None) -> list[Column]:
    top = F.lit(f"tss:{scheme}")
    return [
        *is_a(own, "skos:Concept", *((kind,) if kind else ()), graph="skos"),
        literal(own, "skos:prefLabel", label, graph="skos"),
        link(own, "skos:inScheme", top, "skos"),
        link(own, "skos:topConceptOf", top, "skos"),
    ]


def report_triples(reports: DataFrame) -> DataFrame:
    """Triples of report records. Columns that the table lacks count as null."""

    def col(name: str, kind: str = "string") -> Column:
        return F.col(name) if name in reports.columns else F.lit(None).cast(kind)

    def coded(s: Column, p: str, prefix: str, value: Column) -> Column:
        slug = F.nullif(text.underscore_slug(value), F.lit(""))
        return link(s, p, F.concat(F.lit(f"tss:{prefix}-"), slug))

    slug = text.underscore_slug(F.col("report_id"))
    reports = reports.withColumn("__slug", slug)
    slug = F.col("__slug")
    news, candidate = node("news", slug), node("candidate", slug)
    known = [col(c) for c in ("situation_key", "situation_month", "disease_concept_id", "country_concept_id")]
    complete = F.lit(True)
    for c in known:
        complete = complete & (F.coalesce(c, F.lit("")) != "")
    situation = F.when(complete, node("situation", text.underscore_slug(known[0])))
    disease = F.when(complete, F.concat(F.lit("tss:"), known[2]))
    country = F.when(complete, F.concat(F.lit("tsd:"), F.regexp_replace(known[3], "^country-", "country_")))
    out = [
        *is_a(news, "ts:NewsReport", "ts:SourceDocument"),
        literal(news, "ts:referenceId", col("source_document_id")),
        literal(news, "ts:sourceDocumentTitle", col("source_document_title")),
        literal(news, "ts:sourceURL", col("source_link"), "xsd:anyURI"),
        literal(news, "ts:sourcePublishedDate", col("source_publication_date"), "xsd:date"),
        literal(news, "ts:sourceRetrievedAt", col("source_retrieved_at"), "xsd:dateTime"),
        literal(news, "ts:sourcePublisher", col("source_name")),
        literal(news, "ts:sourceFullText", col("fulltext")),
        literal(news, "ts:sourceContentHash", col("content_hash")),
        *is_a(candidate, "ts:ExtractionCandidate"),
        link(candidate, "ts:extractedFromSource", news),
        literal(candidate, "ts:referenceId", F.col("report_id")),
        literal(candidate, "ts:extractionMethod", col("extraction_method")),
        literal(candidate, "ts:extractionVersion", col("extraction_version")),
        coded(candidate, "ts:hasExtractionStatus", "status", col("extraction_status")),
        coded(candidate, "ts:hasExtractionConfidence", "confidence", col("extraction_confidence")),
        link(candidate, "ts:candidateDescribesSituation", situation),
        *is_a(situation, "ts:OutbreakSituation"),
        *is_a(country, "ts:Location"),
        *is_a(disease, "skos:Concept", "ts:Disease"),
        link(situation, "ts:situationDisease", disease),
        link(situation, "ts:situationCountry", country),
        literal(situation, "ts:hasSituationKey", known[0]),
        literal(situation, "ts:situationMonth", known[1], "xsd:gYearMonth"),
        literal(country, "ts:locationLabel", col("country_or_territory")),
        literal(disease, "skos:prefLabel", col("disease_name")),
    ]
    for kind, parts in (
        ("relevance", ("level", "evidence", "rationale")),
        ("severity", ("level", "evidence", "rationale")),
        ("reach", ("level", "rationale")),
    ):
        columns = {
            "level": col(f"{kind}_level"),
            "evidence": col(f"raw_{kind}_evidence"),
            "rationale": col(f"{kind}_rationale"),
        }
        any_part = F.lit(False)
        for p in parts:
            any_part = any_part | (F.coalesce(columns[p], F.lit("")) != "")
        own = F.when(any_part, node(kind, slug))
        name = kind.title()
        out += [
            *is_a(own, f"ts:{name}Assessment"),
            link(candidate, f"ts:has{name}Assessment", own),
            coded(own, f"ts:has{name}Level", kind, columns["level"]),
            literal(own, f"ts:{kind}Rationale", columns["rationale"]),
        ]
        if "evidence" in parts:
            out.append(literal(own, f"ts:raw{name}Evidence", columns["evidence"]))
    consequence = F.when(
        F.coalesce(col("consequences"), F.lit("")) != "", F.concat(node("consequence", slug), F.lit("_1"))
    )
    out += [
        *is_a(consequence, "ts:Consequence"),
        link(candidate, "ts:hasConsequence", consequence),
        literal(consequence, "ts:consequenceText", col("consequences")),
        literal(consequence, "ts:rawConsequenceEvidence", col("consequences")),
    ]
    nested = []
    if "evidence_snippets" in reports.columns:
        nested.append(_snippet_triples(candidate))
    if "prevention_measures" in reports.columns:
        nested.append(_item_triples(reports, candidate, slug, "prevention_measures", "prevention"))
    if "research_references" in reports.columns:
        nested.append(_item_triples(reports, candidate, slug, "research_references", "research"))
    return emit(reports, out, nested)


def _each(column: str, triples) -> Column:
    """Triples of the elements of an array, null as empty; ``triples`` takes (element, number)."""
    found = F.flatten(F.transform(F.col(column), lambda x, i: F.array(*triples(x, (i + 1).cast("string")))))
    return F.coalesce(found, F.array().cast(_TRIPLES))


def _snippet_triples(candidate: Column) -> Column:
    def of(s: Column, n: Column) -> list[Column]:
        # Ids of rule snippets are hexadecimal; others fall back to their number.
        local = F.nullif(text.dash_slug(F.regexp_replace(s["snippet_id"], "^snippet:", "")), F.lit(""))
        own = node("snippet", F.coalesce(local, n))
        return [
            *is_a(own, "ts:EvidenceSnippet"),
            link(candidate, "ts:hasEvidenceSnippet", own),
            literal(own, "ts:snippetText", s["text"]),
            literal(own, "ts:sourceTextLocator", s["locator"]),
        ]

    terms = F.flatten(
        F.transform(
            F.col("evidence_snippets"),
            lambda s, i: F.transform(
                s["matched_terms"],
                lambda t: literal(
                    node(
                        "snippet",
                        F.coalesce(
                            F.nullif(
                                text.dash_slug(F.regexp_replace(s["snippet_id"], "^snippet:", "")), F.lit("")
                            ),
                            (i + 1).cast("string"),
                        ),
                    ),
                    "ts:rawMatchedTerm",
                    t,
                ),
            ),
        )
    )
    return F.concat(_each("evidence_snippets", of), F.coalesce(terms, F.array().cast(_TRIPLES)))


#: (class, link, [(field, predicate, datatype)]) of list items, fixed values.
ITEMS = {
    "prevention": (
        "ts:PreventionMeasure",
        "ts:hasPreventionMeasure",
        (("text", "ts:preventionMeasureText", None), ("raw_evidence", "ts:rawPreventionEvidence", None)),
    ),
    "research": (
        "ts:ResearchReference",
        "ts:hasResearchReference",
        (
            ("title", "ts:researchTitle", None),
            ("url", "ts:researchURL", "xsd:anyURI"),
            ("citation_text", "ts:researchCitationText", None),
            ("raw_evidence", "ts:rawResearchEvidence", None),
        ),
    ),
}


def _item_triples(reports: DataFrame, candidate: Column, slug: Column, column: str, kind: str) -> Column:
    name, predicate, fields = ITEMS[kind]
    there = reports.schema[column].dataType.elementType.names

    def of(x: Column, n: Column) -> list[Column]:
        own = F.concat(node(kind, slug), F.lit("_"), n)
        return [
            *is_a(own, name),
            link(candidate, predicate, own),
            *(literal(own, p, x[f], d) for f, p, d in fields if f in there),
        ]

    return _each(column, of)


_TRIPLES = "array<struct<s:string,p:string,o:string,kind:string,datatype:string,graph:string>>"
