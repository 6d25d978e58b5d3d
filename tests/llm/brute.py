"""Plain single-machine versions of the operators, written from their contracts, to compare with."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UP = {i: i + 32 for i in range(65, 91)}


def words(text):
    return WORD.findall(text or "")


def low(text):
    return (text or "").translate(UP)


def luhn(d):
    s = [int(c) for c in d][::-1]
    return (sum(s[::2]) + sum(sum(divmod(2 * x, 10)) for x in s[1::2])) % 10 == 0


PII = {
    "email": (re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda m: True),
    "ip": (re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda m: all(int(x) <= 255 for x in m.split("."))),
    "card": (re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda m: 14 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d)),
    "phone": (re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda m: 10 <= len(re.sub("[^0-9]", "", m)) <= 15),
}


def personal(text):
    found = [(m.start(), k, m.end(), name) for k, (name, (p, ok)) in enumerate(PII.items()) for m in p.finditer(text or "") if ok(m[0])]
    found.sort()
    joined = ",".join(f"{n}:{a}:{b}" for a, _, b, n in found)
    return [sum(x[3] == n for x in found) for n in PII], hashlib.sha256(joined.encode()).hexdigest(), joined


def quality(text):
    text = text or ""
    w = words(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    inside = set()
    for i in range(len(w) - 7):
        if grams[tuple(w[i : i + 8])] > 1:
            inside.update(range(i, i + 8))
    failed = len(w) < 20 or 100 * len(inside) > 30 * len(w)
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)], failed


def coverage(text, n):
    w = words(text)
    grams = Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    inside = {j for i in range(len(w) - n + 1) if grams[tuple(w[i : i + n])] > 1 for j in range(i, i + n)}
    return sum(len(w[j]) for j in inside) / max(1, sum(map(len, w)))


def shingle_set(text, n):
    w = words(low(text))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def near(docs, n, threshold):
    """{row: (size, component)} for rows (doc_id, text)."""
    sets = [shingle_set(t, n) for _, t in docs]
    index = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            index[x].append(i)
    both = Counter()
    for rows in index.values():
        for k, i in enumerate(rows):
            for j in rows[k + 1 :]:
                both[i, j] += 1
    parent = list(range(len(docs)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for (i, j), c in both.items():
        if Fraction(c, len(sets[i]) + len(sets[j]) - c) >= threshold:
            parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        r = find(i)
        if d is not None and (least.get(r) is None or d < least[r]):
            least[r] = d
    return [(len(sets[i]), least.get(find(i))) for i in range(len(docs))]


def suffixes(docs, length):
    """For (doc_id, text) in order: n_bytes, n_removed, n_spans, sha256 of what stays."""
    seen, out = set(), []
    for _, text in docs:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            s = raw[i : i + length]
            if s in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(s)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((len(raw), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


def base_scores(docs):
    """For (doc_id, text): held_out, n_tokens, n_known, N, base score; and the word and pair counts of the training rows."""
    one, two = Counter(), Counter()
    rows = []
    for d, t in docs:
        held = zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1
        tokens = [*words(low(t)), None]
        rows.append((held, tokens))
        if not held:
            one.update(tokens)
            two.update(zip([None, *tokens], tokens))
    total, vocabulary = sum(one.values()), len(one)
    score = lambda t: math.log10((one[t] + 0.5) / (total + 0.5 * (vocabulary + 1)))
    return [(h, len(t), sum(one[x] > 0 for x in t), total, sum(map(score, t))) for h, t in rows], rows, one, two


def mixed_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    left, out = Fraction(3 * sum(sizes.values()), 2), {}
    while len(out) < len(names):
        open_ = [s for s in names if s not in out]
        w = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] > 2 * sizes[s] * w]
        if not over:
            return out | {s: left * weight[s] / w for s in open_}
        out |= {s: Fraction(2 * sizes[s]) for s in over}
        left -= sum(2 * sizes[s] for s in over)
    return out


def edits_inside(pattern, text):
    """Fewest edits between the pattern and any part of the text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)
