"""Plain versions of what operators compute, for tests."""

import hashlib
import html
import re

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
PERSONAL = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def secrets(text):
    text = text or ""
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    counts = [sum(f[1] == k for f in found) for k in range(3)]
    return (*counts, digest([(k, a, b) for a, _, k, b in sorted(found)]))


def luhn(digits):
    doubled = [int(c) * 2 if i % 2 else int(c) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def valid(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 8 <= len(digits) <= 15


def personal(text):
    found = [
        [(k, m.start(), m.end()) for m in re.finditer(p, text or "") if valid(k, m[0])] for k, p in PERSONAL.items()
    ]
    return (*map(len, found), digest([s for f in found for s in f]))


def article(page):
    """Text of the article element of the test tables' pages."""
    inner = page[page.index("<article>") + 9 : page.rindex("</article>")]
    blocks = re.sub("<[^>]*>", " ", re.sub(r"</?(p|h1)\b[^>]*>", "\n", inner)).split("\n")
    found = (" ".join(html.unescape(b).split()) for b in blocks)
    return "\n".join(b for b in found if b)


def targets(sizes, sources):
    """Target words of each source, reshared until no source is above twice its size."""
    total = {}
    for i, n in sizes.items():
        total[sources[i]] = total.get(sources[i], 0) + n
    order = sorted(total, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    left, free, out = 1.5 * sum(total.values()), set(order), {}
    while free:
        share = left / sum(weight[s] for s in free)
        full = {s for s in free if weight[s] * share > 2 * total[s]}
        for s in full or free:
            out[s] = 2.0 * total[s] if full else weight[s] * share
        left -= sum(out[s] for s in full)
        free -= full or free
    return out
