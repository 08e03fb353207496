"""Plain versions of the operators' contracts, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def lower_ascii(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def substring_dedup(docs, window=35):
    """[(doc_id, n_words, n_removed, kept text)] for [(doc_id, text)]."""
    words = [WORD.findall(t or "") for _, t in docs]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (doc_id, _), w in zip(docs, words):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((doc_id, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def simhash(text, size=3):
    words = WORD.findall(lower_ascii(text or ""))
    shingles = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or ([" ".join(words)] if words else [])
    value = 0
    for bit in range(64):
        if 2 * sum(xxhash.xxh64_intdigest(s.encode(), 42) >> bit & 1 for s in shingles) > len(shingles):
            value |= 1 << bit
    return value


def components(ids, values, distance=3):
    """Smallest id reachable over links of at most ``distance`` bits."""
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= distance:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    smallest = defaultdict(list)
    for i, x in enumerate(ids):
        smallest[find(i)].append(x)
    known = {r: min((x for x in xs if x is not None), default=None) for r, xs in smallest.items()}
    return [known[find(i)] for i in range(len(ids))]


def line_dedup(docs, min_chars=10):
    """[(doc_id, n_lines, n_dropped, kept text)] for [(doc_id, text)]."""
    key = lambda line: lower_ascii(line.strip(" \t\n\x0b\x0c\r"))
    held = defaultdict(set)
    for doc_id, text in docs:
        for line in (text or "").split("\n"):
            if doc_id is not None and len(key(line)) >= min_chars:
                held[key(line)].add(doc_id)
    out = []
    for doc_id, text in docs:
        lines = (text or "").split("\n")
        gone = lambda x: doc_id is not None and len(held.get(key(x), ())) > 1 and doc_id != min(held[key(x)])  # noqa: B023, E731
        kept = [x for x in lines if not gone(x)]
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contamination(docs, items, window=10):
    """[(doc_id, n_words, n_hit, [item ids as sorted strings])]."""
    windows = defaultdict(set)
    for item, text in items:
        w = ITEM_WORD.findall(lower_ascii(text or ""))
        n = min(window, len(w))
        for i in range(len(w) - n + 1) if n else ():
            windows[tuple(w[i : i + n])].add(str(item))
    out = []
    for doc_id, text in docs:
        w = ITEM_WORD.findall(lower_ascii(text or ""))
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        out.append((doc_id, len(w), len(hit), sorted(found)))
    return out


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else sum(divmod(2 * d, 10))
    return total % 10 == 0


def base_spans(text):
    """[kind:start:end] by kind and start."""
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": True,
                "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True,
                "card": 16 <= len(digits) <= 19 and luhn(digits),
                "phone": 8 <= len(digits) <= 15,
            }[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def clusters(rows, k=8, rounds=10, dim=64, scale=1024, seed="3"):
    """([(vec_id, cluster, distance)], centroids) by plain rounds."""
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(scale * x) for x in v]))
    digest = lambda i: (i is None, sha(f"{seed}:{i}"))
    centroids = [v for i, v in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:k]]
    for r in range(rounds + 1):
        found = []
        for i, v in kept:
            ds = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in centroids]
            found.append((i, ds.index(min(ds)), min(ds)))
        if r < rounds:
            for c in range(len(centroids)):
                own = [v for (_, v), (_, a, _) in zip(kept, found) if a == c]
                if own:
                    centroids[c] = [sum(x) // len(own) for x in zip(*own)]
    return found if kept else [], centroids


def trie(rows, span=100, heads=6):
    """Nodes of the rebuilt conversations of [(conv_id, turn, role, text)]."""
    said = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            said[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [(role, text) for *_, role, text in sorted(v)] for c, v in said.items()}
    members, children, ends = defaultdict(list), defaultdict(set), defaultdict(list)
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % heads
        path = turns.get(c - int(math.fmod(c, span)), [])[:h] + own[h:]
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
            if d:
                children[tuple(path[: d - 1])].add(tuple(path[:d]))
        ends[tuple(path)].append(c)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[q] for q in children[p]) if children[p] else 1
        saved[p] = (len(members[p]) - 1) * len(p[-1][1] if p else "") + sum(saved[q] for q in children[p])
    return [
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p], sha(",".join(map(str, sorted(ends.get(p, []))))))
        for p, m in members.items()
    ]


SECRETS = {
    "assign": r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
}


def secret_spans(text):
    """[(start, kind, end)] of the base kinds, by start, then kind."""
    out = []
    for n, (kind, pattern) in enumerate(SECRETS.items()):
        for m in re.finditer(pattern, text or ""):
            if len(m[2] if kind == "assign" else m[0]) >= (8, 16, 32)[n]:
                out.append((m.start(), n, m.end()))
    return [f"{list(SECRETS)[n]}:{s}:{e}" for s, n, e in sorted(out)]


def gram_counts(tokens):
    """(two characters before, character) with start and end marks."""
    out = Counter()
    for t in tokens:
        marked = "  " + t + " "
        out.update((marked[i : i + 2], marked[i + 2]) for i in range(len(t) + 1))
    return out


def char_probability(counts, before, char, size=67, backoff=20.0, floor=0.05):
    """p(char | before) of a character model of order two."""
    total = lambda keep: sum(n for (b, c), n in counts.items() if keep(b, c))
    p = (total(lambda b, c: c == char) + 1) / (sum(counts.values()) + size)
    p = (total(lambda b, c: c == char and b[1] == before[1]) + backoff * p) / (total(lambda b, c: b[1] == before[1]) + backoff)
    p = (counts[before, char] + backoff * p) / (total(lambda b, c: b == before) + backoff)
    return (1 - floor) * p + floor / size
