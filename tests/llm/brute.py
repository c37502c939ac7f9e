"""Plain-Python versions of operators 11 to 13, which the tests compare with."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def trie(rows):
    """Nodes of the rebuilt conversations from (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [x[1:] for x in sorted(v)] for c, v in own.items()}
    nodes, built = defaultdict(list), {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - c % 20, [])[:h] + own[c][h:]
        for d in range(len(built[c]) + 1):
            nodes[tuple(built[c][:d])].append(c)
    below = Counter(k[:-1] for k in nodes if k)
    cost = {k: (len(v) - 1) * len(WORD.findall(k[-1][1])) if k else 0 for k, v in nodes.items()}
    leaves, saved = Counter(), Counter()
    for k in nodes:
        for d in range(len(k) + 1):
            leaves[k[:d]] += not below[k]
            saved[k[:d]] += cost[k]
    out = set()
    for k, v in nodes.items():
        ends = ",".join(str(c) for c in sorted(v) if len(built[c]) == len(k))
        out.add((min(v), len(k), min(nodes[k[:-1]]) if k else None, len(v), below[k], leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def near(a, b):
    """Exactly one code point inserted, deleted or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def words(docs, thin=31):
    """Counts of the words of (doc_id, text)."""
    n = Counter()
    for key, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{key}:{run}".encode())
            if key is not None and h % thin == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                n[run] += 1
    return {w: c for w, c in n.items() if c >= 2}


def spelling(n):
    """(word, form, root, n, n_near, form_n) of each of the counted words, by comparing all pairs."""
    found = {}
    for w in n:
        close = [v for v in n if near(w, v)]
        best = min(close, key=lambda v: (-n[v], v), default=None)
        found[w] = (best if best is not None and n[best] >= 10 * n[w] else None, len(close))
    out = set()
    for w, (form, count) in found.items():
        root = w
        while found[root][0] is not None:
            root = found[root][0]
        out.add((w, form, root, n[w], count, n[form] if form else None))
    return out


def targets(sizes, share=1.5, weights=(3, 1, 2), most=2):
    """Target of each source, by sharing the excess again until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full, budget = {}, share * sum(sizes.values())
    while True:
        free = [s for s in order if s not in full]
        left = budget - sum(full.values())
        level = left / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if level * weight[s] > most * sizes[s]]
        if not over:
            return full | {s: level * weight[s] for s in free}
        full |= {s: most * sizes[s] for s in over}


def sainte_lague(votes, seats, most):
    """Seats by highest quotients, one after the other; ties by the order of ``votes``."""
    got = [0] * len(votes)
    for _ in range(seats):
        open_ = [i for i in range(len(votes)) if got[i] < most[i] and votes[i] > 0]
        if not open_:
            break
        got[max(open_, key=lambda i: (votes[i] / (2 * got[i] + 1), -i))] += 1
    return got
