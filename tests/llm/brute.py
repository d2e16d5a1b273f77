"""Plain statements of what the operators return, for small tables."""

import hashlib
import re
import zlib

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def top_k(vectors: dict, queries: list, k: int) -> list:
    out = []
    for q in queries:
        ranked = sorted((-sum(a * b for a, b in zip(vectors[q], v, strict=False)), i) for i, v in vectors.items() if i != q)
        out += [(q, r, i, -s) for r, (s, i) in enumerate(ranked[:k], 1)]
    return out


def substrings(docs: list, length: int) -> list:
    first: dict = {}
    words = {d: WORD.findall(t or "") for d, t in docs}
    for d in sorted(words):
        for i in range(len(words[d]) - length + 1):
            first.setdefault(tuple(words[d][i : i + length]), d)
    out = []
    for d, w in words.items():
        gone = set()
        for i in range(len(w) - length + 1):
            if first[tuple(w[i : i + length])] < d:
                gone.update(range(i, i + length))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), sha(kept.encode())))
    return out


def shingles(text: str | None) -> set:
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def near(docs: list, percent: int) -> list:
    sets = {d: shingles(t) for d, t in docs}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders: dict = {}
    for d in sorted(sets):
        counts: dict = {}
        for s in sets[d]:
            for o in holders.setdefault(s, []):
                counts[o] = counts.get(o, 0) + 1
            holders[s].append(d)
        for o, both in counts.items():
            if 100 * both >= percent * (len(sets[d]) + len(sets[o]) - both):
                a, b = find(d), find(o)
                root[max(a, b)] = min(a, b)
    return [(d, len(s), find(d), find(d) == d) for d, s in sets.items()]


def packing_faults(docs: dict, rows: list, ids_of, longest: int = 2048) -> list:
    """What is wrong with packed pieces (doc_id, start, length, crc, doc_tokens, sequence_id, offset); docs: id to text."""
    faults, by_doc, by_seq = [], {}, {}
    for r in rows:
        by_doc.setdefault(r[0], []).append(r)
        by_seq.setdefault(r[5], []).append(r)
    if set(by_doc) != set(docs):
        faults.append("documents")
    for d, pieces in by_doc.items():
        ids, at = [*ids_of(docs[d] or ""), 1], 0
        for _, start, length, crc, n, _, _ in sorted(pieces, key=lambda r: r[1]):
            if start != at or n != len(ids) or crc != zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes()) or length < 1:
                faults.append(("piece", d, start))
            at = start + length
        if at != len(ids):
            faults.append(("cover", d))
    for s, pieces in by_seq.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r[6]):
            if r[6] != at:
                faults.append(("gap", s))
            at += r[2]
        if at > longest:
            faults.append(("long", s))
    return faults
