"""Plain versions of the operators, for small inputs."""

import hashlib
import re

import numpy as np
from xxhash import xxh64_intdigest


def groups(n, linked):
    """Smallest member reachable of 0..n-1."""
    low = list(range(n))
    changed = True
    while changed:
        changed = False
        for i, j in linked:
            m = min(low[i], low[j])
            if low[i] != m or low[j] != m:
                low[i] = low[j] = m
                changed = True
    return low


def simhash(text, k=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    h = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(text):
    text = text or ""
    out = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def span_text(spans):
    return ",".join(f"{k}:{a}:{z}" for a, _, k, z in spans)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def cosine_links(vectors, threshold=0.9):
    out = []
    for i, x in enumerate(vectors):
        for j in range(i):
            y = vectors[j]
            if x is not None and y is not None and len(x) == len(y):
                a, b = np.array(x, float), np.array(y, float)
                d = np.linalg.norm(a) * np.linalg.norm(b)
                if np.isfinite(a).all() and np.isfinite(b).all() and d > 0 and a @ b / d >= threshold:
                    out.append((i, j))
    return out
