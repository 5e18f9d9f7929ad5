"""Brute-force versions of the operators."""

import base64
import hashlib
import re
from collections import Counter, defaultdict


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def quality(text):
    w = words(text)
    seen_windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if seen_windows[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered), n < 50 or 100 * len(covered) > 50 * n


def suffixes(rows, length=100):
    """rows: (doc_id, text), ids distinct."""
    seen, out = set(), {}
    for d, t in sorted(rows, key=lambda r: (-(2**63) if r[0] is None else r[0])):
        b = (t or "").encode()
        cover = bytearray(len(b))
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if w in seen:
                cover[s : s + length] = b"\1" * length
            else:
                seen.add(w)
        runs = sum(1 for i, x in enumerate(cover) if x and not (i and cover[i - 1]))
        out[d] = (len(b), sum(cover), runs, hashlib.sha256(bytes(c for c, x in zip(b, cover) if not x)).hexdigest())
    return out


def warc(rows):
    """rows: (page_id, html)."""
    top = {}
    for p, h in rows:
        d = hashlib.sha1((h or "").encode()).digest()
        if p is not None:
            top[d] = max(top.get(d, p), p)
    out = []
    for p, h in rows:
        b = (h or "").encode()
        d = hashlib.sha1(b).digest()
        revisit = d in top and (p is None or p < top[d])
        out.append((p, len(b), base64.b32encode(d).decode(), "revisit" if revisit else "response", top[d] if revisit else None))
    return out


class Sets:
    """Union-find."""

    def __init__(self, items):
        self.up = {i: i for i in items}

    def find(self, x):
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def jaccard(rows, n=5):
    """rows: (doc_id, text), ids distinct -> id: (n_links, component_id, kept)."""
    grams = {}
    for i, t in rows:
        w = [x for x in re.split(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (t or "").lower()) if x]
        grams[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
    where = defaultdict(list)
    for i, s in grams.items():
        for g in s:
            where[g].append(i)
    common = Counter((a, b) for ids in where.values() for k, b in enumerate(ids) for a in ids[:k])
    links, sets = Counter(), Sets(grams)
    for (a, b), c in common.items():
        if 5 * c >= 4 * (len(grams[a]) + len(grams[b]) - c):
            links[a] += 1
            links[b] += 1
            sets.join(a, b)
    return {i: (links[i], sets.find(i), sets.find(i) == i) for i in grams}


def vectors(rows, threshold=0.98):
    """rows: (vec_id, embedding, label), ids distinct."""
    import math

    def ok(v, label):
        return v is not None and label is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)

    sets, links = Sets([r[0] for r in rows]), Counter()
    for k, (i, v, a) in enumerate(rows):
        for j, w, b in rows[:k]:
            if a == b and ok(v, a) and ok(w, b) and len(v) == len(w):
                dot = sum(x * y for x, y in zip(v, w))
                if dot / (math.sqrt(sum(x * x for x in v)) * math.sqrt(sum(x * x for x in w))) >= threshold:
                    links[i] += 1
                    links[j] += 1
                    sets.join(i, j)
    return {r[0]: (links[r[0]], sets.find(r[0]), sets.find(r[0]) == r[0]) for r in rows}


def licenses(text, model, templates, confirm=0.5, whole_share=0.9):
    """(n_lines, notices, families, license) of a text by the model's numbers; notices: (at, n_lines, family, probability, similarity, confirmed)."""
    import math

    import regex

    split = lambda t: regex.findall(r"[\p{L}\p{N}]+", t.lower())
    grams = lambda w, n: {" ".join(w[i : i + n]) for i in range(len(w) - n + 1)}
    telling = {f for f in model.features if " " not in f}
    weights = {f: [round(x, 6) for x in w] for f, w in zip(model.features, model.weights) if any(abs(x) > 1e-6 for x in w)}
    lines = (text or "").split("\n")
    words = [split(x) for x in lines]
    told = [i for i, w in enumerate(words) if telling & set(w)]
    runs = []
    for i in told:
        if runs and runs[-1][-1] == i - 1:
            runs[-1].append(i)
        else:
            runs.append([i])

    def judge(w):
        known = {g for n in (1, 2, 3) for g in grams(w, n)} & set(model.features)
        logits = [(sum(weights[f][k] for f in known if f in weights) + b) / model.temperature for k, b in enumerate(model.intercepts)]
        best = logits.index(max(logits))
        p = 1 / sum(math.exp(x - logits[best]) for x in logits)
        family = model.families[best]
        if family == "unknown" or p < 0.5:
            return None
        n = min(3, len(w))
        own = grams(w, n)
        sets = [split(t) for t in templates[family]]
        similarity = max(len(grams(t, n) & own) / max(1, min(len(grams(t, n)), len(own))) for t in sets)
        whole = max(len(grams(t, min(3, len(t))) & own) / len(grams(t, min(3, len(t)))) for t in sets)
        return family, p, similarity, whole

    found = []
    for run in runs:
        block = judge([x for i in run for x in words[i]])
        if block:
            found.append((run[0], len(run), *block[:3], block[2] >= confirm))
        for i in run if len(run) > 1 else []:
            one = judge(words[i])
            if one and one[3] >= whole_share and not (block and block[2] >= confirm and block[0] == one[0]):
                found.append((i, 1, *one[:3], one[2] >= confirm))
    sure = [f for f in found if f[5]]
    best = max(((round(f[3], 6), round(f[4], 6), f[2]) for f in sure), default=None)
    return sum(bool(x.strip(" ")) for x in lines), sorted(found), sorted({f[2] for f in sure}), best and best[2]
