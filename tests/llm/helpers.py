"""Brute-force models of the operators, over plain Python rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import xxhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def repeats(rows, length=100):
    """(doc_id, text) rows, ids unique: {id: (bytes, removed, spans, sha256 of the rest)}."""
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        raw = (text or "").encode()
        gone = [False] * len(raw)
        for s in range(len(raw) - length + 1):
            w = raw[s:s + length]
            if w in seen:
                gone[s:s + length] = [True] * length
            seen.add(w)
        starts = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        rest = bytes(b for b, g in zip(raw, gone) if not g)
        out[i] = (len(raw), sum(gone), starts, hashlib.sha256(rest).hexdigest())
    return out


def contamination(docs, items, window=10):
    phrases = defaultdict(set)
    for i, text in items:
        words = WORDS.findall((text or "").translate(LOWER))
        if words:
            for k in range(max(1, len(words) - window + 1)):
                phrases[tuple(words[k:k + window])].update([] if i is None else [str(i)])
    out = []
    for i, text in docs:
        words = WORDS.findall((text or "").translate(LOWER))
        hit, found = [False] * len(words), set()
        for phrase, owners in phrases.items():
            n = len(phrase)
            for k in range(len(words) - n + 1):
                if tuple(words[k:k + n]) == phrase:
                    hit[k:k + n] = [True] * n
                    found |= owners
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((i, len(words), sum(hit), len(found), sha, any(hit)))
    return out


def fingerprint(text, shingle=4):
    words = SPACED.findall((text or "").translate(LOWER))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[k:k + shingle]).encode(), 42)
              for k in range(max(1, len(words) - shingle + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(prints, distance=4):
    """{id: fingerprint} -> {id: smallest id reachable}."""
    parent = {i: i for i in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(prints)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            if (prints[a] ^ prints[b]).bit_count() <= distance:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def base_scores(rows, is_training):
    """(doc_id, text) -> {id: (tokens, known, N, base)}."""
    tokens = {i: SPACED.findall((t or "").translate(LOWER)) + ["\n"] for i, t in rows}
    counts = Counter(w for i, ws in tokens.items() if is_training(i) for w in ws)
    n, v = sum(counts.values()), len(counts)
    return {i: (len(ws), sum(w in counts for w in ws), n,
                sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)) for i, ws in tokens.items()}


def mix(rows, weights=(1, 2, 3), most=3):
    """(doc_id, source, text) -> {source: (size, target)}, by filling up step by step."""
    size = Counter()
    for _, source, text in rows:
        size[source] += len(SPACED.findall(text or ""))
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    target, open_, left = dict.fromkeys(order, 0.0), set(order), float(sum(size.values()))
    while open_:
        share = left / sum(w[s] for s in open_)
        full = {s for s in open_ if share * w[s] >= most * size[s]}
        if not full:
            for s in open_:
                target[s] = share * w[s]
            break
        for s in full:
            target[s] = float(most * size[s])
            left -= target[s]
        open_ -= full
    return {s: (size[s], target[s]) for s in order}


BASE_KINDS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text):
    """[kind:start:end] of the base kinds, by kind and then start."""
    out = []
    for kind, pattern in BASE_KINDS.items():
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")),
                    "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def drawn(docs, goal, buckets=10000, seed=2024, least=20, share=(10, 100), ngram=1):
    """(doc_id, text) rows -> sorted [(doc_id, n_features, weight, score, rank)]."""
    def features(text):
        ws = WORDS.findall((text or "").translate(LOWER))
        return len(ws), [" ".join(ws[i:i + n]) for n in range(1, ngram + 1) for i in range(len(ws) - n + 1)]

    at = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(at(f) for _, text in rows for f in features(text)[1]) for rows in (docs, goal))
    n_s, n_t = sum(s.values()), sum(t.values())
    scored = []
    for i, text in docs:
        n, fs = features(text)
        w = sum(math.floor(1000 * math.log((t[b] + 1.0) * (n_s + buckets) / ((s[b] + 1.0) * (n_t + buckets)))) for b in map(at, fs))
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        scored.append((n >= least, i, len(fs), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    order = sorted((r for r in scored if r[0]), key=lambda r: (-r[4], r[1] is None, r[1] or 0))
    k = share[0] * len(order) // share[1]
    return sorted([(*r[1:], p if p <= k else None) for p, r in enumerate(order, 1)] + [(*r[1:], None) for r in scored if not r[0]], key=str)


TERMS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def divergence(rows, least=30, top=50):
    """(text, lang, source) rows -> sorted [(lang, source, part, item, value, rank)]."""
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in ((t or "", la or "", so or "") for t, la, so in rows):
        terms = TERMS.findall(text.translate(LOWER))
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        whole = Counter({t: sum(counts[lang, s][t] for s in sources) for t in kept})

        def shares(c):
            n = sum(c[t] for t in kept)
            return [1 + 10**9 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept]

        p, q = {s: shares(counts[lang, s]) for s in sources}, shares(whole)
        for s in sources:
            found = {"pair": [(-sum(abs(x - y) for x, y in zip(p[s], p[o])), o.encode(), o) for o in sources if o != s],
                     "term": [(b - a, t.encode(), t) for t, a, b in zip(kept, p[s], q) if counts[lang, s][t] and a > b]}
            for part, items in found.items():
                out += [(lang, s, part, t, -v, k) for k, (v, _, t) in enumerate(sorted(items), 1) if part == "pair" or k <= top]
    return sorted(out)
