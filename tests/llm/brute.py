"""Plain versions of the text operators for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict
from math import log


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def repeats(docs, length=50):
    """Per row (doc_id, text): words, removed words and digest of the kept ones."""
    earliest = {}
    for doc, text in docs:
        if doc is None:
            continue
        w = words(text)
        for k in range(len(w) - length + 1):
            g = tuple(w[k : k + length])
            earliest[g] = min(earliest.get(g, doc), doc)
    out = []
    for doc, text in docs:
        w = words(text)
        gone = set()
        for k in range(len(w) - length + 1):
            if doc is not None and earliest[tuple(w[k : k + length])] < doc:
                gone.update(range(k, k + length))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def bag(text, n=5):
    w = words(text)
    if 0 < len(w) < n:
        return Counter([tuple(w)])
    return Counter(tuple(w[k : k + n]) for k in range(len(w) - n + 1))


def classes(docs, least=0.8):
    """Smallest doc_id of each document's class; every pair is compared."""
    bags = [bag(text) for _, text in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if docs[i][1] is None or docs[j][1] is None:
                continue
            same = sum((bags[i] & bags[j]).values())
            total = sum(bags[i].values()) + sum(bags[j].values()) - same
            if docs[i][1] == docs[j][1] or (total and same >= least * total):
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i, (doc, _) in enumerate(docs):
        groups[find(i)].append(doc)
    return [min(groups[find(i)]) for i in range(len(docs))]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def only_digits(text):
    return re.sub("[^0-9]", "", text)


PERSONAL = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.group().split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(only_digits(m.group())) <= 19 and luhn(only_digits(m.group()))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(only_digits(m.group())) <= 15),
]
NAMES = "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
SECRETS = [
    ("assign", rf"""({NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m.group(2)) >= 8),
    ("access", r"AKIA[A-Z0-9]+", lambda m: len(m.group()) >= 16),
    ("hex", r"[0-9a-f]+", lambda m: len(m.group()) >= 32),
]


def base_spans(text, kinds):
    """Counts per kind, digest, and the joined spans."""
    found = []
    for rank, (kind, pattern, holds) in enumerate(kinds):
        for m in re.finditer(pattern, text or ""):
            if holds(m):
                found.append((m.start(), rank, m.end(), kind))
    found.sort()
    joined = ",".join(f"{kind}:{start}:{end}" for start, _, end, kind in found)
    counts = [sum(f[3] == kind for f in found) for kind, _, _ in kinds]
    return (*counts, hashlib.sha256(joined.encode()).hexdigest()), joined


def quality(text):
    w = words(text)
    places = defaultdict(list)
    for k in range(len(w) - 7):
        places[tuple(w[k : k + 8])].append(k)
    covered = {j for ks in places.values() if len(ks) > 1 for k in ks for j in range(k, k + 8)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(w), sum(map(len, w)), symbols, dup, len(covered), failed


TERM = re.compile(r"[^\W\d_]{3,}")


def _shingles(text):
    w = words(text)
    return {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))}


def term_spans(docs, threshold=0.8, risk=0.05):
    """Per row (doc_id, text) the spans of terms that disclose a value; every pair of texts with a value is compared."""
    texts = [text or "" for _, text in docs]
    lowered = [[w.lower() for w in TERM.findall(t)] for t in texts]
    n_term = Counter(w for found in lowered for w in set(found))
    held, rest = defaultdict(list), {}
    for i, t in enumerate(texts):
        spans = [s.split(":") for s in base_spans(t, PERSONAL)[1].split(",") if s]
        rest[i] = Counter(lowered[i])
        for kind, a, b in spans:
            value = t[int(a) : int(b)]
            rest[i] -= Counter(w.lower() for w in TERM.findall(value))
            name = kind + ":" + re.sub(r"[\x20()-]", "", value).lower()
            if i not in held[name]:
                held[name].append(i)
    n, looked, told = len(docs), {}, set()
    for value, rows in held.items():
        different = sorted({texts[i] for i in rows})
        bags = [_shingles(t) for t in different]
        weight = {}
        for t, own in zip(different, bags, strict=True):
            alike = sum(len(own & x) >= 0.5 * len(own | x) for x in bags)
            weight[t] = 1 / alike / sum(texts[i] == t for i in rows)
        for term in {w for i in rows for w in lowered[i]}:
            with_it = [i for i in rows if term in lowered[i]]
            if len(different) > 1:
                looked[value, term] = (sum(weight[texts[i]] for i in with_it), sum(weight[texts[i]] for i in rows))
            runs = re.findall("[a-z]{3,}", value.split(":", 1)[1].split("@")[0]) if value.startswith("email:") else []
            named = any(2 * len(term) > len(r) and (r.startswith(term) or r.endswith(term)) for r in runs)
            if named and any(rest[i][term] for i in with_it) and 2 * len(with_it) > n_term[term] and len(rows) < n:
                if log(n * len(with_it) / n_term[term] / len(rows)) >= threshold * log(n / len(rows)):
                    told.add(term)
    for (value, term), (both, own) in looked.items():
        rows = held[value]
        share, rate = both / own, n_term[term] / n
        if both < 1.999 or share <= rate or len(rows) == n:
            continue
        other = (1 - share) * log((1 - share) / (1 - rate)) if share < 1 - 1e-9 else 0
        together = sum(term in lowered[i] for i in rows)
        enough = own * (share * log(share / rate) + other) >= log(max(len(looked), 1) / risk)
        if enough and log(n * together / n_term[term] / len(rows)) >= threshold * log(n / len(rows)):
            told.add(term)
    return [(d, [(m.start(), m.end()) for m in TERM.finditer(t or "") if m.group().lower() in told]) for d, t in docs]
