"""Plain versions of the operators' contracts, for small inputs. documents: lists of (doc_id, text, lang, source)."""

import math
import unicodedata
import zlib
from collections import Counter, defaultdict

import xxhash


def words(text):
    return (text or "").encode().split()


def fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_groups(docs, radius=3):
    prints = [fingerprint(d[1]) for d in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(docs):
        if d[0] is not None:
            r = find(i)
            least[r] = min(least.get(r, d[0]), d[0])
    return sorted(((d[0], format(prints[i], "016x"), least.get(find(i))) for i, d in enumerate(docs)), key=repr)


def top_k(vectors, every, k):
    good = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in vectors if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, q) in enumerate(good):
        if i % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(q, v)), j) for b, (j, v) in enumerate(good) if b != a and len(v) == len(q))
            out += [(i, r, j, -s) for r, (s, j) in enumerate(scored[:k], 1)]
    return sorted(out)


def without_repeats(docs, length=20):
    """docs in order of precedence: (n_words, n_removed, kept)."""
    seen, out = set(), []
    for d in docs:
        w = words(d[1])
        gone = set()
        for i in range(len(w) - length + 1):
            window = tuple(w[i : i + length])
            if window in seen:
                gone.update(range(i, i + length))
            seen.add(window)
        out.append((len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return out


def katz(docs, folds=7, fold=2, k=5):
    def discounts(n):
        """Good-Turing after Katz from counts of counts; for counts where that gives no discount, an absolute one."""
        out = [1.0] * (k + 1)
        if n[0] == 0:
            return out
        share = (k + 1) * n[k] / n[0]
        fixed = min(0.9, n[0] / (n[0] + 2 * n[1]))
        for r in range(1, k + 1):
            ratio = None
            if n[r - 1] > 0 and share < 1:
                better = (r + 1) * n[r] / n[r - 1]  # r*
                ratio = (better / r - share) / (1 - share)
            out[r] = ratio if ratio is not None and 0 < ratio < 1 else (r - fixed) / r
        return out

    held = [zlib.crc32(str(d[0]).encode()) % folds == fold for d in docs]
    texts = [[*(w.lower() for w in words(d[1])), b""] for d in docs]
    uni, bi, follow = Counter(), Counter(), defaultdict(set)
    for t, h in zip(texts, held):
        if not h:
            uni.update(t)
            for a, b in zip([None, *t], t):
                bi[a, b] += 1
                follow[a].add(b)
    n, v = sum(uni.values()), len(uni)
    of = lambda c: [float(sum(1 for x in c.values() if x == r)) for r in range(1, k + 2)]
    d1, d2 = discounts(of(uni)), discounts(of(bi))
    d = lambda t, c: t[c] if c <= k else 1.0
    left1 = sum(c - d(d1, c) * c for c in uni.values())
    total1 = n if left1 > 0 else n + 1
    p1 = lambda w: d(d1, uni[w]) * uni[w] / total1 if uni[w] else (left1 / n if left1 > 0 else 1 / total1) if n else 1.0
    size = {a: sum(bi[a, b] for b in f) for a, f in follow.items()}
    left = {a: sum(bi[a, b] - d(d2, bi[a, b]) * bi[a, b] for b in f) for a, f in follow.items()}

    def p2(a, b):
        if a not in size:
            return p1(b)
        total = size[a] if left[a] > 0 else size[a] + 1
        if bi[a, b]:
            return d(d2, bi[a, b]) * bi[a, b] / total
        return (left[a] if left[a] > 0 else 1) / total / (1 - sum(p1(x) for x in follow[a])) * p1(b)

    rows = []
    for doc, t, h in zip(docs, texts, held):
        base = sum(math.log10((uni[w] + 1) / (n + v + 1)) for w in t)
        rows.append((doc[0], h, len(t), sum(uni[w] > 0 for w in t), n, base, sum(math.log10(p2(a, b)) for a, b in zip([None, *t], t))))
    return rows, p2, uni, follow


def targets(sizes, weights=(3, 1, 2), share=1.5, cap=2):
    """sizes: (source, size) pairs; targets by resharing until none is above its cap."""
    order = sorted(sizes, key=lambda s: (s[0] is None, (s[0] or "").encode("utf-32-be")))
    w = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    size, fixed, rest = dict(sizes), {}, share * sum(x for _, x in sizes)
    while open_ := [s for s in size if s not in fixed]:
        level = rest / sum(w[s] for s in open_)
        over = [s for s in open_ if level * w[s] > cap * size[s]]
        if not over:
            return fixed | {s: level * w[s] for s in open_}
        for s in over:
            fixed[s] = float(cap * size[s])
            rest -= fixed[s]
    return fixed


def languages(docs, letter, dim=1024, folds=3, fold=1):
    """(held, lang_pred, score) of each document; letter: a letter's vector, from its code point."""
    import numpy as np

    def vector(text):
        plain = "".join(c if unicodedata.category(c)[0] == "L" else " " for c in text or "")
        plain = " " + " ".join(plain.split(" ")).strip() + " "
        while "  " in plain:
            plain = plain.replace("  ", " ")
        plain = plain.lower()
        out = np.zeros(dim)
        for gram, times in Counter(plain[i : i + 3] for i in range(len(plain) - 2)).items():
            v = np.ones(dim)
            for place, c in enumerate(gram):
                v = v * np.roll(letter(ord(c)).astype(float), place)
            out += times * v
        return out / (np.linalg.norm(out) or 1) if plain.strip() else None

    held = [zlib.crc32(("null" if d[0] is None else str(d[0])).encode()) % folds == fold for d in docs]
    units = [vector(d[1]) for d in docs]
    sums = {}
    for d, h, u in zip(docs, held, units):
        if not h and d[2] is not None and u is not None:
            sums[d[2]] = sums.get(d[2], 0) + u
    names = sorted(sums)
    matrix = np.array([sums[k] / np.linalg.norm(sums[k]) for k in names])
    mean = matrix.mean(axis=0) if len(names) > 1 else np.zeros(dim)
    out = []
    for h, u in zip(held, units):
        if u is None:
            out.append((h, "und", 0.0))
            continue
        cosines = [(u - mean) @ (m - mean) / np.linalg.norm(m - mean) for m in matrix]
        best = int(np.argmax(cosines))
        out.append((h, names[best], float(np.clip(u @ matrix[best], 0, 1))))
    return out
