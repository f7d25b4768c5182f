"""Plain Python versions of the llm operators' contracts, for small inputs."""

from __future__ import annotations

import collections
import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def shingles(text, n=5):
    w = words(text)
    return frozenset(tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def line_key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\r\x0b\x0c"))


def dedup(rows, min_chars=40, min_docs=5):
    """rows: (doc_id, text). Sorted (doc_id, n_lines, n_dropped, kept_sha256, kept)."""
    low = float("-inf")
    holders = collections.defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(line_key(line)) >= min_chars:
                holders[line_key(line)].add(low if doc is None else doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(holders[line_key(x)]) < min_docs
                or max(holders[line_key(x)]) == (low if doc is None else doc)]
        body = "\n".join(kept)
        out.append((doc, len(lines), len(lines) - len(kept), hashlib.sha256(body.encode()).hexdigest(), body))
    return sorted(out, key=str)


def jaccard(rows, threshold=0.8):
    """rows: (doc_id, text). Sorted (doc_id, class_id, n_links) over rows."""
    sets = [shingles(t) for _, t in rows]
    links, parent = [0] * len(rows), list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and both >= threshold * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                links[a] += 1
                links[b] += 1
                parent[root(a)] = root(b)
    low = {}
    for i, (doc, _) in enumerate(rows):
        r = root(i)
        low[r] = min((x for x in (low.get(r), doc) if x is not None), default=None)
    return sorted(((doc, low[root(i)], links[i]) for i, (doc, _) in enumerate(rows)), key=str)


def base_personal(text):
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", m.start(), m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        odd = [x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(reversed(d))]
        if 16 <= len(d) <= 19 and sum(odd) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def rule_counts(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)."""
    text = text or ""
    w = words(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    windows = collections.Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    flags = [False] * len(w)
    for i in range(len(w) - 7):
        if windows[tuple(w[i:i + 8])] > 1:
            flags[i:i + 8] = [True] * 8
    n = sum(flags)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, n,
            len(w) < 20 or 100 * n > 30 * len(w))


LICENSE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))


def license_base(text):
    """(n_words, n_base, first_word, last_word, base_labels)."""
    w = LICENSE_WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    at, labels = [], set()
    for phrase, label in PHRASES:
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i:i + len(p)] == p:
                at.append(i)
                labels.add(label)
    return (len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels)))


def mix_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """Targets by sources in order, as repeated sharing until none is above."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    capped = set()
    while True:
        left = share * sum(sizes) - sum(most * sizes[i] for i in capped)
        total = sum(w[i] for i in range(len(sizes)) if i not in capped)
        out = [most * s if i in capped else (left * w[i] / total) for i, s in enumerate(sizes)]
        above = {i for i in range(len(sizes)) if i not in capped and out[i] > most * sizes[i]}
        if not above:
            return out
        capped |= above
