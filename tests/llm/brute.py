"""Plain versions of the operators, document by document, to hold them against."""

from __future__ import annotations

import hashlib
import re

import numpy as np

WORDS = re.compile(rb"[^\t\n\x0b\x0c\r ]+")


def joined(ranges):
    out = []
    for lo, hi in sorted(ranges):
        if out and out[-1][1] >= lo:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return tuple((a, b) for a, b in out)


def repeats(docs, length):
    """doc_id -> (repeated, removed) word ranges; docs: (doc_id, text) with distinct ids."""
    grams, where = {}, {}
    for i, t in docs:
        ws = WORDS.findall(t.encode())
        where[i] = [tuple(ws[k : k + length]) for k in range(len(ws) - length + 1)]
        for g in where[i]:
            grams.setdefault(g, set()).add(i)
    out = {}
    for i, gs in where.items():
        rep = [(k, k + length) for k, g in enumerate(gs) if len(grams[g]) > 1]
        if rep:
            out[i] = (joined(rep), joined([(k, k + length) for k, g in enumerate(gs) if min(grams[g]) < i]))
    return out


def exact(docs):
    groups = {}
    for i, t in docs:
        if t is not None:
            groups.setdefault(t, []).append(i)
    return [sorted(g, key=lambda i: (i is None, i or 0)) for g in groups.values()]


def line_chunks(text):
    lines = text.split("\n")
    at = [i for i, x in enumerate(lines) if x.strip(" ")]
    h = [int(hashlib.md5(lines[i].encode()).hexdigest()[:8], 16) for i in at]
    r = [(x + 31 * (h[j - 1] if j else 0)) % 2**32 for j, x in enumerate(h)]
    out, start = [], 0
    for j in range(1, len(at) - 2):
        if r[j] < r[j - 1] and r[j] <= r[j + 1]:
            out.append((start, lines[start : at[j] + 1]))
            start = at[j] + 1
    return [*out, (start, lines[start:])]


def line_dedup(docs):
    """New texts of (doc_id, text) rows with distinct ids, in order."""
    first = {}
    for i, t in sorted((x for x in docs if x[0] is not None and x[1] is not None), key=lambda x: x[0]):
        for s, c in line_chunks(t):
            first.setdefault("\n".join(c), (i, s))
    out = []
    for i, t in docs:
        if i is None or t is None or "\n" not in t:
            out.append((i, t))
            continue
        kept = [x for s, c in line_chunks(t) for x in (c if sum(bool(x.strip(" ")) for x in c) < 2 or first["\n".join(c)] == (i, s) else [])]
        out.append((i, "\n".join(kept)))
    return out


def normal_words(text):
    """(word, from, to) in bytes: lower-cased runs of ASCII letters and digits and of other characters but dashes, quotes and spaces."""
    raw = text.encode()
    sep = re.compile(rb"(?:\xe2[\x80\x81][\x80-\xbf]|\xc2\xa0|[\x00-/:-@\[-`{-\x7f])+")
    out, at = [], 0
    for m in [*sep.finditer(raw), None]:
        end = m.start() if m else len(raw)
        if end > at:
            out.append((raw[at:end].decode().lower(), at, end))
        at = m.end() if m else at
    return out


def contaminated(text, items, least, most, coverage, short=4):
    """Byte ranges to remove: maximal matches by quadratic comparison; of items of `short` words to `least` the whole counts."""
    ws = normal_words(text)
    own = [w for w, _, _ in ws]
    items = {i: [w for w, _, _ in normal_words(t)] for i, t in items}
    grams = {}
    for i in sorted(items):
        for k in range(len(items[i]) - least + 1):
            grams.setdefault(tuple(items[i][k : k + least]), []).append((i, k))
    matches = {}
    for a in range(len(own) - least + 1):
        for i, k in grams.get(tuple(own[a : a + least]), ()):
            n = least
            while a + n < len(own) and k + n < len(items[i]) and own[a + n] == items[i][k + n]:
                n += 1
            if (a + n) not in matches or matches[a + n][0] > a:
                matches[a + n] = (a, i, k)
    spans = sorted((a, b, i, k) for b, (a, i, k) in matches.items())
    spans += [(a, a + len(v), i, 0) for i, v in items.items() if short <= len(v) < least for a in range(len(own)) if own[a : a + len(v)] == v]
    spans.sort()
    spans = [s for s in spans if not any(o[0] <= s[0] and s[1] <= o[1] and o[:2] != s[:2] for o in spans)]
    covered = {}
    for a, b, i, k in spans:
        covered.setdefault(i, set()).update(range(k, k + b - a))
    return [(ws[a][1], ws[b - 1][2]) for a, b, i, k in spans if b - a >= most or len(covered[i]) >= coverage * len(items[i])]


def without(text, ranges):
    raw, out, at = text.encode(), b"", 0
    for lo, hi in joined(ranges):
        out += raw[at:lo]
        at = hi
    return (out + raw[at:]).decode("utf-8", "replace")


def near_groups(prints, max_bits):
    """Root of each fingerprint (rows of uint64) by comparing all pairs."""
    n = len(prints)
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    pairs = set()
    for i in range(n):
        d = np.bitwise_count(prints[i] ^ prints[i + 1 :]).sum(1)
        for j in np.flatnonzero(d <= max_bits) + i + 1:
            pairs.add((i, int(j)))
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)], pairs
