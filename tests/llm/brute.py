"""Plain versions of what the operators must return."""

import hashlib
import re

WHITE = re.compile(r"[\x20\x09-\x0D]")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(WHITE.sub("", t or ""), []).append((-len(t or ""), i is None, i or 0, i))
    out = []
    for i, t in rows:
        plain = WHITE.sub("", t or "")
        keep = min(groups[plain], key=lambda x: x[:3])[3]
        out.append((i, keep, len(groups[plain]), i == keep, hashlib.sha256(plain.encode()).hexdigest()))
    return out


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def near(rows, percent=85):
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            common = len(sets[a] & sets[b])
            if sets[a] and 100 * common >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


RULES = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
]


def secrets(text):
    """Base spans (start, kind number, end) of a text."""
    return sorted((m.start(), no, m.end()) for no, (_, p, g, least) in enumerate(RULES) for m in re.finditer(p, text or "") if len(m[g]) >= least)


def lines(rows, least=40, docs=5):
    """(id, lines, dropped, digest of the text that stays) of (id, text) rows."""
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    rank = lambda i: (i is not None, i or 0)
    seen = {}
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            seen.setdefault(k, []).append(rank(i))
    goes = {k: max(v) for k, v in seen.items() if len(k) >= least and len(v) >= docs}
    out = []
    for i, t in rows:
        own = (t or "").split("\n")
        stay = [x for x in own if goes.get(key(x), rank(i)) == rank(i)]
        out.append((i, len(own), len(own) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return out


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def merkle(rows, key, ident):
    """(root, per row: (leaf, subroot, siblings level by level)) of tuples; ``key`` and ``ident`` are places in a row."""

    def tree(hashes):
        proofs, at, level = [[] for _ in hashes], list(range(len(hashes))), hashes
        while len(level) > 1:
            for n, k in enumerate(at):
                begin = k // 8 * 8
                proofs[n].append((level[begin:k], level[k + 1:begin + 8]))
            at = [k // 8 for k in at]
            level = [digest(*level[k:k + 8]) for k in range(0, len(level), 8)]
        return level[0], proofs

    none_first = lambda v: (v is not None, v if v is not None else 0)
    keys = sorted({r[key] for r in rows}, key=lambda k: (k is not None, (k or "").encode()))
    own, heads = {}, []
    for k in keys:
        order = sorted((n for n, r in enumerate(rows) if r[key] == k), key=lambda n: (none_first(rows[n][ident]), leaf(rows[n])))
        head, proofs = tree([leaf(rows[n]) for n in order])
        heads.append(head)
        own.update({n: (head, p) for n, p in zip(order, proofs)})
    root, top = tree(heads)
    return root, [(leaf(r), own[n][0], own[n][1] + top[keys.index(r[key])]) for n, r in enumerate(rows)]


def fold(start, proof):
    for left, right in proof:
        start = digest(*left, start, *right)
    return start
