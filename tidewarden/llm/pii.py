"""Personal data by weak supervision, DataFrame functions only.

1. Candidates. Patterns of base kinds (email, ip, card, phone) and of looser kinds are
   matched in a document's row. Matches and the gaps between them, two arrays of one
   pattern, give offsets by a running sum. Base spans that pass their checks always stay.
2. Votes. Three labelers vote yes, no or abstain on each candidate: the form of the match,
   gazetteers (top-level domains, calling codes, number ranges), and words before it.
3. Expectation-maximisation over the votes. Candidates are counted by kind and votes, at
   most 7 x 27 rows whatever the corpus; the iterations run over that table as one array,
   and estimate each labeler's reliability and the chance that a candidate is real.
4. Classifier. Those chances label all candidates softly, and a naive Bayes classifier over
   kind, votes, neighbouring characters and length is trained on them: a bounded table of
   weights. Looser candidates that it takes for real are added.

Candidates are written to the shared folder once, so texts are read once.

Defined cases: null text has no spans; spans of one kind never overlap, those of two base
kinds may; a looser span that overlaps a base one is dropped; repeated rows each get their
spans; an empty table gives an empty result; extra columns are ignored; a score of exactly
0 adds nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewarden.llm.quality_rules import let
from tidewarden.llm.shared import written

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("spelled_email", "local_phone", "id_number")
KINDS = (*BASE_KINDS, *ADDED_KINDS)

# A match can only start where its first run of characters does, or where the match before
# ended (\G): without that, a long run would be tried from each of its characters. Groups
# are possessive; nothing in these patterns could match by giving characters back.
EMAIL = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
)
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}+"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
SPELLED_EMAIL = (
    r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{1,64}+\x20?[(\[]at[)\]]\x20?[A-Za-z0-9-]{1,63}+"
    r"\x20?(?:[(\[]dot[)\]]|\.)\x20?[A-Za-z]{2,24}+"
)
LOCAL_PHONE = r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])"
ID_NUMBER = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"

#: Gazetteers, fixed values.
TOP_DOMAINS = (
    "com|org|net|edu|gov|info|biz|io|eu|de|fr|es|it|ch|at|nl|be|uk|us|ca|au|pl|pt|se|no|dk|fi"
)
CALLING_CODES = (
    "1|7|20|27|30|31|32|33|34|36|39|40|41|43|44|45|46|47|48|49|51|52|53|54|55|56|57|58|60|61"
    "|62|63|64|65|66|81|82|84|86|90|91|92|93|94|95|98|351|352|353|354|355|356|357|358|359"
)
#: Words that speak for or against a candidate when they stand before it.
YES_WORDS = (
    "e-?mail|mail|contact|tel|phone|call|fax|mobile|cell|whatsapp|card|visa|mastercard|credit"
    "|payment|ip|address|host|client|ssn|social security|id|account|kontakt|telefon|rufen"
    "|correo|courriel|appelez|llame|adresse"
)
NO_WORDS = "version|ver|isbn|issn|doi|order|invoice|build|release|page|figure|table|section|no"
CONTEXT = 24
ITERATIONS = 25
#: Matches whose places are summed up together.
PART = 64


def luhn(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def valid_ip(match: Column) -> Column:
    def part(p: Column) -> Column:
        digits = F.regexp_replace(p, "^0+", "")
        return (F.length(digits) <= 3) & (F.coalesce(digits.try_cast("int"), F.lit(0)) <= 255)

    return F.forall(F.split(match, "\\."), part)


def valid_card(match: Column) -> Column:
    digits = F.translate(match, " -", "")
    return F.length(digits).between(16, 19) & luhn(digits)


def valid_phone(match: Column) -> Column:
    return F.length(F.translate(match, "+ ().-", "")).between(8, 15)


def anything(match: Column) -> Column:
    return F.lit(True)


def form_vote(kind: str, match: Column) -> Column:
    """The first labeler: how well formed a match is."""
    if kind in ("email", "spelled_email"):
        good, bad = match.rlike(r"^[A-Za-z0-9]"), match.rlike(r"\.\.|^[.%+-]")
    elif kind == "ip":
        good, bad = match.rlike(r"^[1-9]"), match.rlike(r"^0|\.0[0-9]")
    elif kind == "card":
        good, bad = match.rlike(r"^[2-6]"), match.rlike(r"^0|([0-9])\1{7}")
    elif kind == "id_number":
        good, bad = ~match.rlike(r"^(000|666|9)|-00-|-0000$"), match.rlike(r"^(000|666|9)")
    else:
        good, bad = match.rlike(r"[\x20()-]"), match.rlike(r"([0-9])\1{6}|\.\.|--")
    return F.when(bad, F.lit(0)).when(good, F.lit(2)).otherwise(F.lit(1))


def gazetteer_vote(kind: str, match: Column) -> Column:
    """The second labeler: whether a match is in a known range."""
    if kind in ("email", "spelled_email"):
        good, bad = match.rlike(rf"(?i)(?:{TOP_DOMAINS})$"), match.rlike(r"(?i)(png|jpe?g|gif|js)$")
    elif kind == "ip":
        good, bad = match.rlike(r"^(1[0-9]{2}|2[01][0-9]|[1-9]?[0-9])\."), match.rlike(r"^0+\.")
    elif kind == "card":
        good, bad = match.rlike(r"^(4|5[1-5]|2[2-7]|3[47]|6)"), match.rlike(r"^[01789]")
    elif kind == "phone":
        good, bad = match.rlike(rf"^\+(?:{CALLING_CODES})"), match.rlike(r"^\+0")
    elif kind == "local_phone":
        good, bad = match.rlike(r"^\(?[2-9][0-9]{2}"), match.rlike(r"^\(?[01]")
    else:
        good, bad = match.rlike(r"^[0-7]"), match.rlike(r"^9")
    return F.when(bad, F.lit(0)).when(good, F.lit(2)).otherwise(F.lit(1))


def context_vote(before: Column) -> Column:
    """The third labeler: words in the text before a match."""
    return (
        F.when(before.rlike(rf"(?i)\b(?:{NO_WORDS})\b[^A-Za-z]*$"), F.lit(0))
        .when(before.rlike(rf"(?i)\b(?:{YES_WORDS})\b"), F.lit(2))
        .otherwise(F.lit(1))
    )


def neighbour(c: Column) -> Column:
    """Class of a neighbouring character."""
    return (
        F.when(F.coalesce(c, F.lit("")) == "", "edge")
        .when(c.rlike(r"^[\x20\t\r\n]"), "space")
        .when(c.rlike(r"^[0-9]"), "digit")
        .when(c.rlike(r"^\p{L}"), "letter")
        .otherwise("mark")
    )


def candidates(
    kind: str, text: Column, pattern: str, valid: Callable[[Column], Column], hint: Column | None
) -> Column:
    """Array of (kind, start, end, votes, features) of the matches that are valid."""
    none = F.array().cast(
        "array<struct<kind:string,start:bigint,end:bigint,votes:array<int>,features:array<string>>>"
    )

    def of(x: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            match, gap = F.get(x["matches"], i), F.get(x["gaps"], i)
            start = acc["pos"] + F.length(gap)
            before = F.right(gap, F.lit(CONTEXT))
            votes = F.array(form_vote(kind, match), gazetteer_vote(kind, match), context_vote(before))
            after = F.substring(F.get(x["gaps"], i + 1), 1, 1)
            features = F.array(
                F.concat(F.lit("before="), neighbour(F.right(before, F.lit(1)))),
                F.concat(F.lit("after="), neighbour(after)),
                F.concat(F.lit("size="), F.least(F.length(match), F.lit(31)).cast("string")),
            )
            one = F.struct(
                F.lit(kind).alias("kind"),
                start.alias("start"),
                (start + F.length(match)).alias("end"),
                votes.alias("votes"),
                features.alias("features"),
            )
            return F.struct(
                (start + F.length(match)).alias("pos"),
                F.when(valid(match), F.concat(acc["out"], F.array(one)))
                .otherwise(acc["out"])
                .alias("out"),
            )

        # Each step copies what has gathered, so matches go in parts of bounded length.
        n = F.size(x["matches"])
        parts = F.sequence(F.lit(0), F.floor((n - 1) / PART).cast("int"))
        sizes = F.zip_with(
            x["matches"], F.slice(x["gaps"], F.lit(1), n), lambda m, g: F.length(m) + F.length(g)
        )

        def part_starts(sizes: Column) -> Column:
            sums = F.transform(
                parts,
                lambda b: F.aggregate(
                    F.slice(sizes, b * PART + 1, F.lit(PART)),
                    F.lit(0).cast("bigint"),
                    lambda a, size: a + size,
                ),
            )
            return F.aggregate(
                sums,
                F.array(F.lit(0).cast("bigint")),
                lambda a, total: F.concat(a, F.array(F.element_at(a, -1) + total)),
            )

        def of_part(b: Column, start: Column) -> Column:
            return F.aggregate(
                F.sequence(b * PART, F.least(b * PART + PART, n) - 1),
                F.struct(start.alias("pos"), none.alias("out")),
                step,
                lambda acc: acc["out"],
            )

        return F.when(
            n > 0,
            let(
                let(sizes, part_starts),
                lambda starts: F.flatten(
                    F.transform(parts, lambda b: of_part(b, F.get(starts, b)))
                ),
            ),
        ).otherwise(none)

    found = let(
        F.struct(
            F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("matches"),
            F.split(text, pattern, -1).alias("gaps"),
        ),
        of,
    )
    return found if hint is None else F.when(hint, found).otherwise(none)


def document_candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, spans): all candidates by kind as listed, then start."""
    text = F.coalesce("text", F.lit(""))
    base = [
        candidates("email", text, EMAIL, anything, F.contains(text, F.lit("@"))),
        candidates("ip", text, IP, valid_ip, None),
        candidates("card", text, CARD, valid_card, None),
        candidates("phone", text, PHONE, valid_phone, F.contains(text, F.lit("+"))),
    ]
    spelled = F.contains(text, F.lit("(at)")) | F.contains(text, F.lit("[at]"))
    added = [
        candidates("spelled_email", text, SPELLED_EMAIL, anything, spelled),
        candidates("local_phone", text, LOCAL_PHONE, anything, None),
        candidates("id_number", text, ID_NUMBER, anything, F.contains(text, F.lit("-"))),
    ]
    found = docs.select(
        "doc_id", *(c.alias(k) for k, c in zip(BASE_KINDS, base, strict=True)), F.concat(*added).alias("added")
    )
    apart = F.filter("added", lambda a: ~reduce(or_, (overlaps(a, F.col(k)) for k in BASE_KINDS)))
    return found.select("doc_id", F.concat(*BASE_KINDS, apart).alias("spans"))


def overlaps(span: Column, others: Column) -> Column:
    """Whether a span overlaps one of others, which are in order and apart from each other.

    Of those that start before the span's end the last one reaches furthest; halving finds it,
    so a text with many spans takes steps in proportion, not by pairs.
    """
    halvings = F.sequence(F.lit(1), F.length(F.bin(F.size(others))))

    def halve(x: Column, _: Column) -> Column:
        middle = F.floor((x["low"] + x["high"]) / 2).cast("int")
        before = F.get(others, middle)["start"] < span["end"]
        open_ = x["low"] < x["high"]
        return F.struct(
            F.when(open_ & before, middle + 1).otherwise(x["low"]).alias("low"),
            F.when(open_ & ~before, middle).otherwise(x["high"]).alias("high"),
        )

    return F.aggregate(
        halvings,
        F.struct(F.lit(0).alias("low"), F.size(others).alias("high")),
        halve,
        lambda x: F.coalesce(F.get(others, x["low"] - 1)["end"] > span["start"], F.lit(False)),
    )


def vote_posteriors(spans: DataFrame) -> DataFrame:
    """(kind, votes, real): the chance that a candidate is real, for each kind and votes.

    A labeler's vote depends on whether the candidate is real, and on nothing else; how
    often each vote comes up either way, and how often candidates of a kind are real, are
    estimated in turns with the chances.
    """
    counted = spans.groupBy("kind", "votes").agg(F.count("*").cast("double").alias("n"))
    table = counted.agg(F.sort_array(F.collect_list(F.struct("kind", "votes", "n"))).alias("rows"))

    def total(rows: Column, real: Column, of: Callable[[Column, Column], Column]) -> Column:
        """Sum of ``of`` a row and its chance."""
        return F.aggregate(F.zip_with(rows, real, of), F.lit(0.0), lambda a, x: a + x)

    def start(row: Column) -> Column:
        balance = F.aggregate(row["votes"], F.lit(0), lambda a, v: a + v - 1)
        return F.when(balance > 0, F.lit(0.9)).when(balance < 0, F.lit(0.1)).otherwise(F.lit(0.5))

    def again(rows: Column, real: Column) -> Column:
        def share(of: Callable[[Column], Column], prior: float, yes: bool) -> Column:
            weight = lambda r, p: r["n"] * (p if yes else 1 - p)
            part = total(rows, real, lambda r, p: F.when(of(r), weight(r, p)).otherwise(F.lit(0.0)))
            return (part + 1) / (total(rows, real, weight) + prior)

        def rates(yes: bool) -> Column:
            """For each labeler in turn, the rates of its three votes."""
            return F.array(
                *(
                    share(lambda r, k=k, v=v: F.get(r["votes"], F.lit(k)) == v, 3.0, yes)
                    for k in range(3)
                    for v in range(3)
                )
            )

        def kind_share(kind: str) -> Column:
            mine = lambda r: r["kind"] == kind
            got = total(rows, real, lambda r, p: F.when(mine(r), r["n"] * p).otherwise(F.lit(0.0)))
            n = total(rows, real, lambda r, p: F.when(mine(r), r["n"]).otherwise(F.lit(0.0)))
            return (got + 1) / (n + 2)

        def chance(row: Column, x: Column) -> Column:
            prior = F.get(x["kinds"], F.array_position(F.array(*map(F.lit, KINDS)), row["kind"]).cast("int") - 1)
            at = [F.lit(3 * k) + F.get(row["votes"], F.lit(k)) for k in range(3)]
            yes, no = prior, 1 - prior
            for i in at:
                yes, no = yes * F.get(x["yes"], i), no * F.get(x["no"], i)
            return yes / (yes + no)

        return let(
            F.struct(
                F.array(*map(kind_share, KINDS)).alias("kinds"),
                rates(True).alias("yes"),
                rates(False).alias("no"),
            ),
            lambda x: F.transform(rows, lambda row: chance(row, x)),
        )

    solved = table.select(
        "rows",
        F.aggregate(
            F.sequence(F.lit(1), F.lit(ITERATIONS)),
            F.transform("rows", start),
            lambda real, _: again(F.col("rows"), real),
        ).alias("real"),
    )
    pairs = F.zip_with("rows", "real", lambda r, p: F.struct(r["kind"], r["votes"], p.alias("real")))
    return solved.select(F.inline(pairs).alias("kind", "votes", "real"))


def span_features(span: Column) -> Column:
    """Feature names of a span, each with its kind."""
    votes = F.transform(
        span["votes"],
        lambda v, i: F.concat(F.lit("vote"), i.cast("string"), F.lit("="), v.cast("string")),
    )
    names = F.concat(F.array(F.lit("kind")), votes, span["features"])
    return F.transform(names, lambda f: F.concat_ws(" ", span["kind"], f))


def classifier(found: DataFrame) -> dict[str, float]:
    """Weight of each feature: log-odds of real over not, from softly labelled candidates.

    At most 7 kinds times (1 + 9 + 10 + 31) features.
    """
    spans = found.select(F.explode("spans").alias("s"))
    real = written(vote_posteriors(spans.select("s.kind", "s.votes")), "pii-votes")
    features = (
        spans.select("s.kind", "s.votes", span_features(F.col("s")).alias("features"))
        .join(F.broadcast(real), ["kind", "votes"])
        .select(F.explode("features").alias("feature"), "real")
        .groupBy("feature")
        .agg(F.sum("real").alias("yes"), F.sum(1 - F.col("real")).alias("no"))
        .withColumn("kind", F.substring_index("feature", " ", 1))
    )
    sums = features.where(F.col("feature").endswith(" kind")).select(
        "kind", F.col("yes").alias("all_yes"), F.col("no").alias("all_no")
    )
    odds = F.log((F.col("yes") + 1) / (F.col("all_yes") + 2)) - F.log(
        (F.col("no") + 1) / (F.col("all_no") + 2)
    )
    prior = F.log((F.col("all_yes") + 1) / (F.col("all_no") + 1))
    weights = features.join(F.broadcast(sums), "kind").select(
        "feature", F.when(F.col("feature").endswith(" kind"), prior).otherwise(odds).alias("weight")
    )
    return {r["feature"]: r["weight"] for r in weights.collect()}


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, spans: kind, start, end, score) of every row of ``docs`` (doc_id, text)."""
    found = written(document_candidates(docs), "pii-candidates")
    weights = sorted(classifier(found).items())
    table = F.map_from_arrays(
        F.array(*(F.lit(f) for f, _ in weights)).cast("array<string>"),
        F.array(*(F.lit(float(w)) for _, w in weights)).cast("array<double>"),
    )

    def scored(span: Column) -> Column:
        score = F.aggregate(
            span_features(span),
            F.lit(0.0),
            lambda a, f: a + F.coalesce(F.try_element_at(table, f), F.lit(0.0)),
        )
        return F.struct(span["kind"], span["start"], span["end"], score.alias("score"))

    spans = F.filter(
        F.transform("spans", scored), lambda s: s["kind"].isin(*BASE_KINDS) | (s["score"] > 0)
    )
    return found.select("doc_id", spans.alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    found = personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))

    def number(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")

    return found.select(
        "doc_id",
        *(number(kind).alias(f"n_{kind}") for kind in BASE_KINDS),
        F.sha2(joined(F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))), 256).alias(
            "base_sha256"
        ),
        joined(F.col("spans")).alias("spans"),
    )
