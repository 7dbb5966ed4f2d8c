"""Brute-force versions, for small inputs."""

import hashlib
import html
import re

WORD5 = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(b: bytes) -> bytes:
    return bytes(c + 32 if 65 <= c <= 90 else c for c in b)


def contamination(docs, items, window=10):
    """{doc_id: (n_words, n_hit, items)}"""
    index: dict = {}
    sizes = set()
    for i, t in items:
        w = WORD5.findall(lower((t or "").encode()))
        n = min(window, len(w))
        if n:
            sizes.add(n)
            for k in range(len(w) - n + 1):
                index.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    out = {}
    for d, t in docs:
        w = WORD5.findall(lower((t or "").encode()))
        hit, got = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if found := index.get(tuple(w[k : k + n])):
                    got |= found
                    hit |= set(range(k, k + n))
        out[d] = (len(w), len(hit), sorted(got))
    return out


def article(page):
    """The text of pages as plain as those of the test tables."""
    m = re.search(r"(?s)<article>(.*)</article>", page)
    blocks = re.split(r"</?(?:p|h1)>", m[1])
    texts = [" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", b))).split()) for b in blocks]
    return "\n\n".join(t for t in texts if t)


def repeats(texts, k):
    """For each text: which bytes stand in a string of k bytes that also starts elsewhere."""
    seen: dict = {}
    for i, t in enumerate(texts):
        for a in range(len(t) - k + 1):
            seen.setdefault(hashlib.md5(t[a : a + k]).digest(), []).append((i, a))
    cover = [bytearray(len(t)) for t in texts]
    for places in seen.values():
        if len(places) > 1:
            for i, a in places:
                cover[i][a : a + k] = b"\x01" * k
    return cover


WORD10 = re.compile(rb"[^\x20\x09-\x0D]+")


def shingles(text, n=5):
    w = WORD10.findall(lower((text or "").encode()))
    if not w:
        return frozenset()
    if len(w) < n:
        return frozenset([tuple(w)])
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1))


def components(docs):
    """{doc_id: (n_shingles, component_id)} by comparing all pairs that share a shingle."""
    sets = {d: shingles(t) for d, t in docs}
    index: dict = {}
    for d, s in sets.items():
        for x in s:
            index.setdefault(x, []).append(d)
    top = {d: d for d in sets}

    def find(d):
        while top[d] != d:
            top[d] = top[top[d]]
            d = top[d]
        return d

    common: dict = {}
    for ds in index.values():
        for i, a in enumerate(ds):
            for b in ds[i + 1 :]:
                common[a, b] = common.get((a, b), 0) + 1
    for (a, b), n in common.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            top[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}
