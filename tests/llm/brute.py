"""Plain versions of the operators, for small inputs."""

import hashlib
import random
import re
import zlib

import numpy as np
import xxhash


def secrets(text):
    spans = []
    for kind, pattern, group, least in (
        ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
        ("access", r"AKIA[A-Z0-9]+", 0, 20),
        ("hex", r"[0-9a-f]+", 0, 24),
    ):
        spans += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text or "") if len(m[group]) >= least]
    order = ("assign", "access", "hex")
    spans.sort(key=lambda s: (s[0], order.index(s[1])))
    digest = hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, k, e in spans).encode()).hexdigest()
    return [sum(k == x for _, k, _ in spans) for x in order], digest


def simhash(text, n):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    shingles = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def components(ids, linked):
    """linked(i, j) of positions; the smallest id that each reaches."""
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if linked(i, j):
                root[find(i)] = find(j)
    best = {}
    for i, x in enumerate(ids):
        best[find(i)] = min(x, best.get(find(i), x))
    return [best[find(i)] for i in range(len(ids))]


def words9(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def contamination(text, items, window=10):
    words = words9(text)
    hit, found = set(), set()
    for item, body in items:
        own = words9(body)
        size = min(window, len(own))
        if not size:
            continue
        wanted = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)}
        for i in range(len(words) - size + 1):
            if tuple(words[i : i + size]) in wanted:
                hit |= set(range(i, i + size))
                found.add(str(item))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


def pieces(text, tokenizer, capacity=2048):
    ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
    return [(k, s, len(p := ids[s : s + capacity]), zlib.crc32(np.array(p, dtype="<u4").tobytes())) for k, s in enumerate(range(0, len(ids), capacity))]


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def normal(line):
    return "".join(c for c in line.lower() if c.isalnum() or ord(c) > 160 or ord(c) in range(9) or ord(c) in (*range(14, 32), *range(127, 160)))


def dropped_lines(docs, least=20):
    """{id: set of line numbers} of lines that equal, or from so many characters are within an edit of, an earlier one."""
    first, order, out = {}, [], {i: set() for i, _ in docs}
    for i, text in sorted(docs, key=lambda d: d[0]):
        for k, line in enumerate(text.split("\n") if text is not None else []):
            n = normal(line)
            if not n:
                continue
            if n in first:
                out[i].add(k)
                first[n].append((i, k))
            else:
                first[n] = [(i, k)]
                order.append(n)
    for x, n in enumerate(order):
        if len(n) < least:
            continue
        for e in order[:x]:
            if len(e) >= least and abs(len(e) - len(n)) <= 1:
                at = next((z for z in range(min(len(e), len(n))) if e[z] != n[z]), min(len(e), len(n)))
                if e[at + 1 :] == n[at + 1 :] or e[at:] == n[at + 1 :] or e[at + 1 :] == n[at:]:
                    for i, k in first[n]:
                        out[i].add(k)
                    break
    return out


def words(n, seed=0):
    rng = random.Random(seed)
    return " ".join(rng.choice("the of and to in is that for it with red green blue stone river house bird apple cloud sleep walk".split()) + str(rng.randrange(40)) for _ in range(n))
