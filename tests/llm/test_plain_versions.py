"""Whole results against plain versions: co-training in numpy, weak supervision in Python."""

import math
import random
import zlib

import numpy as np
import pytest

from tests.conftest import SMALL
from tidewarden.llm import pii, quality_classifier, registry

# Co-training.

DIM_TEXT, DIM_META = 96 + 12 + 1, 8 + 32 + 7 + 1


def chance(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def text_vector(text):
    words = (text or "").split()
    out = np.zeros(DIM_TEXT)
    out[-1] = 1
    if not words:
        return out
    for w in words:
        out[zlib.crc32(w.encode()) % 96] += 1
    out[:96] = np.sqrt(out[:96] / len(words))
    data, n = text.encode(), len(words)
    share = lambda chars: sum(data.count(c) for c in chars)
    upper, lower = share(range(65, 91)), share(range(97, 123))
    out[96:108] = [
        share(b"#*$%&|<>{}[]^~_=+\\@") / n, upper / (upper + lower + 1), share(range(48, 58)) / len(data), share(b"!") / n, share(b"|") / n,
        share(b".?;:,") / n, share(range(128, 256)) / len(data), min(len(data) / n, 40) / 10, len(set(words)) / n,
        sum(words[i] == words[i - 1] for i in range(1, n)) / n, math.log1p(n) / 8, n < 10,
    ]
    return out


def meta_vector(source, lang, size, text):
    out = np.zeros(DIM_META)
    out[-1] = 1
    out[zlib.crc32(repr(lang).encode()) % 8] = 1
    out[8 + zlib.crc32(repr(source).encode()) % 32] = 1
    lines = [x for x in (text or "").split("\n") if x.strip()]
    n, size = len(lines), max(size or 0, 0)
    out[40:47] = [
        math.log1p(size) / 10, (math.log1p(size) / 10) ** 2, size == 0, math.log1p(n) / 5, math.log1p(size / n if n else 0) / 8,
        (n - len(set(lines))) / n if n else 0, n <= 1,
    ]
    return out


def fitted(x, y, ridge):
    """Ridge logistic regression, Newton steps from zero."""
    w = np.zeros(x.shape[1])
    for _ in range(12):
        p = chance(x @ w)
        curve = x.T @ np.diag(p * (1 - p) + 1e-6) @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, x.T @ (p - y) + ridge * w)
        w = w - step
        if np.abs(step).max() < 1e-4:
            break
    return w


def taught(x, y, w, pool, labels, share, weight):
    """A step over labelled rows and pseudo-labelled ones, which weigh as their class's share of ``weight``."""
    p = chance(x @ w)
    slope = x.T @ (p - y) + w
    curve = x.T @ np.diag(p * (1 - p) + 1e-6) @ x + np.eye(len(w))
    for label, part in ((0, 1 - share), (1, share)):
        z = pool[labels == label]
        if len(z):
            each = min(1.0, weight * part / len(z))
            q = chance(z @ w)
            slope = slope + each * (z.T @ (q - label))
            curve = curve + each * (z.T @ np.diag(q * (1 - q)) @ z)
    step = np.linalg.solve(curve, slope)
    return w - step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))


def plain_scores(docs, labels):
    """(p_text, p_meta, score) of documents (doc_id, text, lang, source, n_chars)."""
    both = {
        i: (text_vector(t).astype(np.float32).astype(float), meta_vector(s, lang, n, t).astype(np.float32).astype(float))
        for i, t, lang, s, n in docs
    }
    own = {i: y for i, y in labels.items() if i in both}
    assert len(own) <= quality_classifier.MAX_LABELLED
    ids = sorted(own)
    y = np.array([own[i] for i in ids], float)
    views = [np.array([both[i][v] for i in ids]) for v in (0, 1)]
    pool = [np.array([both[i][v] for i in both if i not in labels]) for v in (0, 1)]
    rng, held = np.random.default_rng(5), np.zeros(len(y), bool)
    for label in (0, 1):
        rows = rng.permutation(np.flatnonzero(y == label))
        held[rows[: max(1, len(rows) // 5)]] = True
    share = y.mean()
    weights = [fitted(v[~held], y[~held], 1.0) for v in views]
    for turn in range(4):
        sure = []
        for v in (0, 1):
            p = chance(pool[v] @ weights[v])
            sure.append(np.where(p <= 0.05, 0, np.where(p >= 0.95, 1, -1)))
        for _ in range(2):
            weights = [
                taught(views[v][~held], y[~held], weights[v], pool[v], sure[1 - v], share, (~held).sum() * (turn + 1) / 4) for v in (0, 1)
            ]
    scale = []
    for v in (0, 1):
        z = views[v][held] @ weights[v]
        a, b = fitted(np.stack([z, np.ones(len(z))], axis=1), y[held], 0.1)
        scale.append((max(a, 0), b))
    prior = math.log(share / (1 - share))
    out = {}
    for i, vectors in both.items():
        za, zb = (scale[v][0] * (vectors[v] @ weights[v]) + scale[v][1] for v in (0, 1))
        out[i] = tuple(float(chance(z)) for z in (za, zb, za + zb - prior))
    return out


def test_co_training_equals_plain_numpy(spark, oracle):
    docs = oracle.sql("SELECT doc_id, text, lang, source, n_chars FROM documents").fetchall()
    labels = dict(oracle.sql("SELECT doc_id, quality FROM labels").fetchall())
    want = plain_scores(docs, labels)
    got = {r.doc_id: r for r in registry.queries()["op2_quality_classifier"](spark, SMALL).collect()}
    assert got.keys() == want.keys()
    for i, (a, b, score) in want.items():
        assert (got[i].p_text, got[i].p_meta, got[i].score) == pytest.approx((a, b, score), abs=1e-5), i
        assert got[i].kept == (got[i].score >= 0.5)


# Weak supervision.


def plain_posteriors(found):
    """{(kind, votes): chance} by EM over the candidates one by one."""
    kinds = pii.KINDS
    balance = {c: sum(c[1]) - 3 for c in found}
    real = {c: 0.9 if balance[c] > 0 else 0.1 if balance[c] < 0 else 0.5 for c in found}
    for _ in range(25):
        yes = {(k, v): 1.0 for k in range(3) for v in range(3)}
        no, total_yes, total_no = dict(yes), 0.0, 0.0
        by_kind, size = dict.fromkeys(kinds, 1.0), dict.fromkeys(kinds, 2.0)
        for (kind, votes), n in found.items():
            p = real[kind, votes]
            total_yes += n * p
            total_no += n * (1 - p)
            by_kind[kind] += n * p
            size[kind] += n
            for k, v in enumerate(votes):
                yes[k, v] += n * p
                no[k, v] += n * (1 - p)
        real = {}
        for kind, votes in found:
            a = by_kind[kind] / size[kind]
            b = 1 - a
            for k, v in enumerate(votes):
                a *= yes[k, v] / (total_yes + 3)
                b *= no[k, v] / (total_no + 3)
            real[kind, votes] = a / (a + b)
    return real


def plain_added(rows):
    """{doc_id: spans that stay} from candidates (kind, start, end, votes, features) of documents."""
    found = {}
    for _, spans in rows:
        for s in spans:
            found[s.kind, tuple(s.votes)] = found.get((s.kind, tuple(s.votes)), 0) + 1
    real = plain_posteriors(found)
    names = lambda s: [*(f"vote{i}={v}" for i, v in enumerate(s.votes)), *s.features]
    yes, no, all_yes, all_no = {}, {}, {}, {}
    for _, spans in rows:
        for s in spans:
            p = real[s.kind, tuple(s.votes)]
            all_yes[s.kind] = all_yes.get(s.kind, 0) + p
            all_no[s.kind] = all_no.get(s.kind, 0) + 1 - p
            for f in names(s):
                yes[s.kind, f] = yes.get((s.kind, f), 0) + p
                no[s.kind, f] = no.get((s.kind, f), 0) + 1 - p
    out = {}
    for doc_id, spans in rows:
        kept = []
        for s in spans:
            k = s.kind
            score = math.log((all_yes[k] + 1) / (all_no[k] + 1))
            for f in names(s):
                score += math.log((yes[k, f] + 1) / (all_yes[k] + 2)) - math.log((no[k, f] + 1) / (all_no[k] + 2))
            if k in pii.BASE_KINDS or score > 0:
                kept.append((k, s.start, s.end, pytest.approx(score, abs=1e-6)))
        out[doc_id] = kept
    return out


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_added_spans_equal_plain_expectation_maximisation(spark, folder):
    docs = spark.read.parquet(f"/root/testdata/{folder}/documents.parquet").select("doc_id", "text", "source")
    rng = random.Random(4)
    parts = ["call 555-123-4567 now", "order 155-111-1111", "ssn 123-45-6789", "page 900-00-0000", "mail joe (at) example.com", "version 1.2.3.4"]
    made = [(10**6 + i, " ".join(rng.choice(parts) for _ in range(rng.randint(1, 5))), "a") for i in range(200)]
    docs = docs.unionByName(spark.createDataFrame(made, "doc_id bigint, text string, source string"))
    rows = [(r.doc_id, r.spans) for r in pii.document_candidates(docs).collect()]
    want = plain_added(rows)
    got = {r.doc_id: [(s.kind, s.start, s.end, s.score) for s in r.spans] for r in pii.personal_data(docs).collect()}
    assert got == want
    added = [s for spans in got.values() for s in spans if s[0] not in pii.BASE_KINDS]
    candidates = [s for _, spans in rows for s in spans if s.kind not in pii.BASE_KINDS]
    assert 0 < len(added) < len(candidates)
