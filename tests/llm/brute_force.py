"""Brute-force forms of the pipeline's filtering stages: {doc_id: text} to {doc_id: text}."""

import hashlib
import random
import re
from collections import Counter


def words(n, seed=0, alphabet="abcdefghik"):
    r = random.Random(seed)
    return " ".join("".join(r.choice(alphabet) for _ in range(r.randint(2, 6))) for _ in range(n))


def quality(texts, _):
    out = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        c = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        hit = {k + j for k in range(len(w) - 7) if c[tuple(w[k : k + 8])] > 1 for j in range(8)}
        if len(w) >= 20 and 100 * len(hit) <= 30 * len(w):
            out[i] = t
    return out


def lines(texts, _):
    rows = {i: (t or "").split("\n") for i, t in texts.items()}
    places = {}
    for i, ls in rows.items():
        h, n = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in ls], len(ls)
        ends = [k for k in range(1, n + 1) if k == n or k > 1 and (h[k - 1] + 31 * h[k - 2]) % 64 < 32]
        for k in range(1, n + 1):
            for s, e in ((k, min([k + 15, n] + [x for x in ends if x > k])), (max([k - 15, 1] + [x + 1 for x in ends if x < k]), k)):
                chunk = "\n".join(ls[s - 1 : e])
                if e > s and chunk.strip("\n"):
                    places.setdefault(chunk, set()).add((i, s, e))
    gone = {(i, k) for p in places.values() for i, s, e in sorted(p)[1:] for k in range(s, e + 1)}
    out = {i: "\n".join(x for k, x in enumerate(ls, 1) if (i, k) not in gone) for i, ls in rows.items()}
    return {i: t for i, t in out.items() if t}


def near(texts, _):
    sets, root = {}, {i: i for i in texts}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t.lower())
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sorted(texts):
        for j in sorted(texts):
            if i < j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: t for i, t in texts.items() if find(i) == i}


def clean(texts, benchmark):
    plain = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
    bad = set()
    for _, t in benchmark:
        w = plain(t)
        bad |= {tuple(w[k : k + 10]) for k in range(len(w) - 9)}
    return {i: t for i, t in texts.items() if not any(tuple(plain(t)[k : k + 10]) in bad for k in range(len(plain(t)) - 9))}


brute_stages = [quality, lines, near, clean]
