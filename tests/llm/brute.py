"""Plain Python versions of the contracts, for small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode())


def held(doc_id, mod, rest):
    return True if doc_id is None else crc(doc_id) % mod == rest


def ids_crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def quality_features(text):
    """Words, pairs of words, the same of shapes, and the tenth of pairs that repeat a word."""
    words = split(text)
    signs = "".join("A" if "A" <= c <= "Z" else "0" if "0" <= c <= "9" else "a" if "a" <= c <= "z" or ord(c) > 127 else c for c in text or "")
    shapes = split(re.sub(r"(A|a|0)\1+", r"\1", signs))
    kinds = [words, list(zip(words, words[1:])), shapes, list(zip(shapes, shapes[1:]))]
    same = sum(a == b for a, b in kinds[1])
    return {(k, f) for k, kind in enumerate(kinds) for f in kind} | {("share", math.floor(10 * same / max(len(kinds[1]), 1)))}


def quality(rows, labels, places_of, epochs=3, alpha=1.0, beta=1.0, l1=0.05, l2=1.0):
    """``(doc_id, score)`` by follow-the-regularised-leader, one number at a time."""
    texts, wanted = {}, {}
    for i, t in rows:
        if i is not None:
            texts[i] = min(texts.get(i, t or ""), t or "")
    for i, label in labels:
        if i is not None and label is not None and i in texts and not held(i, 3, 1):
            wanted[i] = min(wanted.get(i, label), label)
    order = sorted(wanted)
    z, n = defaultdict(float), defaultdict(float)

    def weight(k):
        return 0.0 if abs(z[k]) <= l1 else -(z[k] - math.copysign(l1, z[k])) / ((beta + math.sqrt(n[k])) / alpha + l2)

    def inputs(text):
        places = [int(p) for p in places_of(text)]
        return [(p, 1 / math.sqrt(len(places))) for p in places] + [("constant", 1.0)]

    def chance(values):
        return 1 / (1 + math.exp(-max(-35.0, min(35.0, sum(weight(k) * x for k, x in values)))))

    for epoch in range(epochs):
        for at in np.random.default_rng(epoch).permutation(len(order)):
            values = inputs(texts[order[at]])
            error = chance(values) - wanted[order[at]]
            for k, x, w in [(k, x, weight(k)) for k, x in values]:
                g = error * x
                z[k] += g - (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / alpha * w
                n[k] += g * g
    return [(i, chance(inputs(t))) for i, t in rows]


def encode(name, text, end):
    return Tokenizer.from_file(public_tokenizers.path(name)).encode(text or "", add_special_tokens=False).ids + [end]


def substring_dedup(rows, width=50):
    least = {}
    for i, text in rows:
        w = split(text)
        if i is not None:
            for k in range(len(w) - width + 1):
                key = tuple(w[k : k + width])
                least[key] = min(least.get(key, i), i)
    out = []
    for i, text in rows:
        w = split(text)
        gone = [False] * len(w)
        if i is not None:
            for k in range(len(w) - width + 1):
                if least[tuple(w[k : k + width])] < i:
                    gone[k : k + width] = [True] * width
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((i, len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


def language_model(rows):
    tokens = [split(lower(t)) + [None] for _, t in rows]
    counts = Counter(w for (i, _), k in zip(rows, tokens) if not held(i, 7, 2) for w in k)
    n, v = sum(counts.values()), len(counts)
    return [
        (i, held(i, 7, 2), len(k), sum(counts[w] > 0 for w in k), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in k))
        for (i, _), k in zip(rows, tokens)
    ]


def jaccard(rows, width=5):
    sets = []
    for _, text in rows:
        w = split(lower(text))
        sets.append({tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 80 * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    members = defaultdict(list)
    for x in range(len(rows)):
        members[find(x)].append(rows[x][0])
    out = []
    for x, (i, _) in enumerate(rows):
        named = [k for k in members[find(x)] if k is not None]
        out.append((i, len(sets[x]), i if not sets[x] else min(named, default=None)))
    return out


def overlaps(docs, items, stretch=13, share=0.7):
    """Pairs that agree in some stretch on some diagonal, without seeds."""
    tokens = lambda t: re.findall(r"[a-z0-9\u0080-\U0010ffff]+", lower(t))
    found = set()
    for d, text in docs:
        a = tokens(text)
        for i, item in items:
            b = tokens(item)
            width = min(stretch, len(b))
            if len(b) < 6:
                continue
            for diagonal in range(-len(b), len(a)):
                same = [0 <= diagonal + k < len(a) and a[diagonal + k] == b[k] for k in range(len(b))]
                if any(sum(same[k : k + width]) >= math.ceil(share * width) for k in range(len(b) - width + 1)):
                    found.add((d, i))
                    break
    return found


@cache
def _piece_numbers():
    from binweave.llm import language

    return {s: k for k, s in enumerate(language.pieces().strings)}


def segmentations(word, log_p):
    """Log of the sum over all ways to cut a word, behind a space, into pieces of the vocabulary."""
    number = _piece_numbers()
    data = b" " + word.encode().lower()
    sums = [0.0]
    for end in range(1, len(data) + 1):
        terms = [sums[start] + log_p[number[data[start:end]]] for start in range(max(0, end - 64), end) if data[start:end] in number]
        top = max(terms)
        sums.append(top + math.log(sum(math.exp(t - top) for t in terms)))
    return sums[-1]
