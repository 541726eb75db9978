"""One-pass Python versions of what the training-data operators compute, written from the definitions."""

import hashlib
import zlib
from collections import defaultdict


def trie(turns, hundred=100, heads=6):
    """turns: (conv_id, turn, role, text). {(depth, prefix): row} as in the contract."""
    convs = defaultdict(list)
    for c, t, role, text in turns:
        if c is not None:
            convs[c].append(((t is not None, t or 0), role or "", text or ""))
    convs = {c: [(r, x) for _, r, x in sorted(rows)] for c, rows in convs.items()}
    seqs = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % heads
        seqs[c] = tuple(convs.get(c - c % hundred, [])[:h] + own[h:])
    members = defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    children = defaultdict(list)
    for s in members:
        if s:
            children[s[:-1]].append(s)
    leaves, saved = defaultdict(int), defaultdict(int)
    for s, m in members.items():
        for d in range(len(s) + 1):
            leaves[s[:d]] += s not in children
            saved[s[:d]] += (len(m) - 1) * len(s[-1][1]) if s else 0
    out = []
    for s, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(seqs[c]) == len(s))))
        out.append((min(m), len(s), min(members[s[:-1]]) if s else None, len(m), len(children[s]), leaves[s], saved[s], hashlib.sha256(ends.encode()).hexdigest()))
    return out
