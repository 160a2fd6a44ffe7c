"""Plain Python versions of the operators, and small tables with awkward rows."""

import hashlib
import re

BLANK = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text, pattern=BLANK, lower=False):
    return pattern.findall((text or "").translate(LOWER) if lower else text or "")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def repeated_words(rows, n):
    every = {}
    split = [words(t) for _, t in rows]
    for r, ws in enumerate(split):
        for s in range(len(ws) - n + 1):
            every.setdefault(tuple(ws[s : s + n]), []).append((r, s))
    gone = [set() for _ in rows]
    for places in every.values():
        if len(places) > 1:
            for r, s in places:
                gone[r].update(range(s, s + n))
    return [(d, len(ws), len(g), sha(" ".join(w for i, w in enumerate(ws) if i not in g))) for (d, _), ws, g in zip(rows, split, gone, strict=True)]


def repeated_bytes(rows, n):
    """Rows in order of doc_id."""
    seen, out = set(), []
    for d, t in rows:
        b, gone, new = (t or "").encode(), set(), []
        for s in range(len(b) - n + 1):
            x = b[s : s + n]
            if x in seen:
                gone.update(range(s, s + n))
            seen.add(x)
        spans = sum(1 for i in gone if i - 1 not in gone)
        out.append((d, len(b), len(gone), spans, sha(bytes(c for i, c in enumerate(b) if i not in gone))))
    return out


def jaccard_groups(rows, n=5, percent=75):
    """The set size and the group (a number) of each row."""
    sets = []
    for _, t in rows:
        ws = words(t, lower=True)
        sets.append({tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)} if len(ws) >= n else {tuple(ws)} if ws else set())
    comp = list(range(len(rows)))

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                comp[root(i)] = root(j)
    return [(len(x), root(i)) for i, x in enumerate(sets)]


def jaccard(rows, n=5, percent=75):
    groups, least = jaccard_groups(rows, n, percent), {}
    for (d, _), (_, g) in zip(rows, groups, strict=True):
        if d is not None:
            least[g] = min(d, least.get(g, d))
    return [(d, size, least.get(g)) for (d, _), (size, g) in zip(rows, groups, strict=True)]


def contaminated(rows, items, n=13):
    known = {}
    for item, t in items:
        ws = words(t, ALNUM, True)
        m = min(n, len(ws))
        for s in range(len(ws) - m + 1) if ws else ():
            known.setdefault(tuple(ws[s : s + m]), set()).add(item)
    sizes, out = {len(k) for k in known}, []
    for d, t in rows:
        ws, hit, found = words(t, ALNUM, True), set(), set()
        for m in sizes:
            for s in range(len(ws) - m + 1):
                if (x := tuple(ws[s : s + m])) in known:
                    hit.update(range(s, s + m))
                    found |= known[x]
        found.discard(None)
        out.append((d, len(ws), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit) and 20 * len(hit) >= len(ws)))
    return out


def awkward(seed=3, rows=60):
    """(doc_id, text): shared passages, near copies, copies, repeated rows, ties, nulls, empty and long texts."""
    import random

    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["é", "ñandú", "Groß", "THE", "the", " "]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage, base = some(60), some(120)
    out = [(0, None), (1, ""), (2, " \t\n"), (3, "one two"), (4, "One  two"), (5, " ".join(some(9000))), (6, "a " * 300), (7, " ".join(base)), (7, " ".join(base)), (None, "only words here to see what null does"), (8, " ".join(passage[:35])), (9, " ".join(passage[:34]))]
    for k in range(10, 10 + rows):
        kind = k % 5
        if kind == 0:
            text = some(rng.randrange(1, 40)) + passage[: rng.randrange(20, 60)] + some(rng.randrange(0, 40))
        elif kind == 1:
            text = list(base)
            for _ in range(rng.randrange(0, 8)):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
        elif kind == 2:
            text = some(rng.randrange(0, 12))
        else:
            text = some(rng.randrange(20, 200))
        out.append((k, rng.choice([" ", "\n", "  "]).join(text)))
    return out
