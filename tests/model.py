"""The semantics in plain Python, for small inputs."""

from collections import Counter, defaultdict

SWAP = str.maketrans("ACGT", "TGCA")


def four(s):
    c = s.translate(SWAP)
    return [s, s[::-1], c[::-1], c]


def windows(s, k, last=False):
    return [s[i : i + k] for i in range(max(0, len(s) - k + last))]


def regions(tx, k):
    """tx: {(gid, tidx): seq} -> [(gid, tidx, position, seq)]"""
    owners = defaultdict(set)
    for (g, _), s in tx.items():
        for o in four(s):
            for w in windows(o, k):
                owners[w].add(g)
    out = []
    for (g, t), s in tx.items():
        good = [len(owners[w]) < 2 for w in windows(s, k)] + [False]
        start = None
        for i, ok in enumerate(good):
            if ok and start is None:
                start = i
            if not ok and start is not None:
                out.append((g, t, start, s[start : i + k]))
                start = None
    return out


def keys(tx, regs, k, m):
    out = set()
    for g, t, _, s in regs:
        step = max(10, min(50 + (10 - m) * 10, int((len(tx[g, t]) - 20) / m)))
        for p in range(min(20, len(s) - k), len(s) - k, step):
            out.add((g, min(four(s[p : p + k]))))
    return out


def positions(regs, ks, k):
    where = defaultdict(list)
    for g, t, at, s in regs:
        for i, w in enumerate(windows(s, k)):
            where[g, w].append((t, at + i))
    occ = [(g, key, t, p) for g, key in ks for o in four(key) for t, p in where[g, o]]
    per = defaultdict(set)
    for g, key, t, _ in occ:
        per[g, t].add(key)
    return Counter(o for o in occ if len(per[o[0], o[2]]) > 2)


def counts(ks, reads, k):
    n = Counter(w for r in reads for w in windows(r, k, True) if "N" not in w)
    return {(g, key): sum(n[o] for o in four(key)) for g, key in ks}
