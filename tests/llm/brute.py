"""Plain Python versions of the operators, for small inputs."""

import hashlib
import re
from collections import defaultdict

NON_SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def near_duplicates(docs, k=5, percent=75):
    sets = {}
    for i, t in docs:
        w = NON_SPACE.findall(lower(t))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    holders = defaultdict(list)
    for i in ids:
        for s in sets[i]:
            holders[s].append(i)
    pairs = {(a, b) for h in holders.values() for x, a in enumerate(h) for b in h[x + 1 :]}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def drop_windows(docs, window=20):
    words = {i: NON_SPACE.findall(t or "") for i, t in docs}
    seen, out = set(), {}
    for i in sorted(words):
        w, gone = words[i], set()
        for s in range(len(w) - window + 1):
            x = tuple(w[s : s + window])
            if x in seen:
                gone |= set(range(s, s + window))
            seen.add(x)
        out[i] = (len(w), len(gone), sha(" ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


def contamination(docs, items, length=10):
    windows = defaultdict(set)
    for i, t in items:
        w = ALNUM.findall(lower(t))
        if w:
            for s in range(max(1, len(w) - length + 1)):
                windows[tuple(w[s : s + length])].add(i)
    sizes = {len(x) for x in windows}
    out = {}
    for i, t in docs:
        w, hit, own = ALNUM.findall(lower(t)), set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if (x := tuple(w[s : s + n])) in windows:
                    hit |= set(range(s, s + n))
                    own |= windows[x]
        ids = sorted(str(x) for x in own)
        out[i] = (len(w), len(hit), len(ids), sha(",".join(ids)), bool(hit))
    return out


def drop_byte_spans(docs, length=400):
    texts = {i: (t or "").encode() for i, t in docs}
    count = defaultdict(int)
    for b in texts.values():
        for s in range(len(b) - length + 1):
            count[b[s : s + length]] += 1
    out = {}
    for i, b in texts.items():
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if count[b[s : s + length]] > 1:
                gone[s : s + length] = b"\x01" * length
        spans = sum(1 for j in range(len(b)) if gone[j] and (j == 0 or not gone[j - 1]))
        out[i] = (len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone) if not g)))
    return out


def prefix_nodes(rows):
    """rows: (conv_id, turn, role, text); the trie's nodes."""
    import zlib

    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[c].append((turn is not None, turn or 0, digest, (role, text)))
    own = {c: [x[3] for x in sorted(v)] for c, v in own.items()}
    members = defaultdict(list)
    for c in own:
        base = c - remainder(c, 20)
        h = zlib.crc32(str(c).encode()) % 4
        seq = tuple(own.get(base, [])[:h] + own[c][h:])
        for d in range(len(seq) + 1):
            members[seq[:d]].append((c, d == len(seq)))
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    sums = {}
    for p in sorted(members, key=len, reverse=True):
        words = len(NON_SPACE.findall(p[-1][1])) if p else 0
        leaves = sum(sums[q][0] for q in children[p]) if children[p] else 1
        sums[p] = leaves, (len(members[p]) - 1) * words + sum(sums[q][1] for q in children[p])
    low = {p: min(c for c, _ in m) for p, m in members.items()}
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c, e in m if e)))
        yield low[p], len(p), low[p[:-1]] if p else None, len(m), len(children[p]), sums[p][0], sums[p][1], sha(ends)


def remainder(a, b):
    """The remainder with the sign of a, as in SQL."""
    return abs(a) % b * (1 if a >= 0 else -1)
