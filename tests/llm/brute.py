"""Plain versions of the operators' contracts."""

import hashlib
import re
from collections import Counter

BLANK = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return BLANK.findall(text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, n):
    w = words(lower(text))
    if len(w) >= n:
        return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    return frozenset([tuple(w)] if w else [])


def near_components(docs, n, percent):
    """doc_id -> (set size, component) for (doc_id, text) rows; ids are not null."""
    sets = [(k, shingles(t, n)) for k, t in docs]
    parent = {k: k for k, _ in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[i + 1 :]:
            both = len(s & t)
            if s and t and 100 * both >= percent * (len(s) + len(t) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {k: (len(s), find(k)) for k, s in sets}


def repeats(docs, length=100):
    """doc_id -> (bytes, removed, spans, sha256 of the rest) for (doc_id, text) rows with different ids."""
    seen, out = set(), {}
    for k, text in sorted(docs):
        x = (text or "").encode()
        cover, until = bytearray(len(x)), 0
        for i in range(len(x) - length + 1):
            w = x[i : i + length]
            if w in seen:
                for q in range(max(until, i), i + length):
                    cover[q] = 1
                until = i + length
            seen.add(w)
        spans = sum(1 for i, c in enumerate(cover) if c and (i == 0 or not cover[i - 1]))
        rest = bytes(b for b, c in zip(x, cover) if not c)
        out[k] = (len(x), sum(cover), spans, hashlib.sha256(rest).hexdigest())
    return out


def base_counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    w = words(text)
    runs = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    often = Counter(runs)
    covered = {j for i, r in enumerate(runs) if often[r] > 1 for j in range(i, i + 8)}
    seen, lines = set(), 0
    for line in text.split("\n"):
        if BLANK.search(line):
            lines += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), lines, len(covered)
