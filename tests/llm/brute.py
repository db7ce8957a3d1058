"""Plain Python versions of the operators, for small inputs."""

import hashlib
import re
import zlib
from collections import Counter

import xxhash

BLANK = " \t\n\x0b\x0c\r"


def ascii_lower(s: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def words(s: str | None) -> list[str]:
    return [w for w in re.split(r"[\x20\x09-\x0D]+", ascii_lower(s or "")) if w]


def first_lines(rows: list[tuple[int, str | None]]) -> dict[int, tuple[int, int, str]]:
    owner: dict[str, int] = {}
    key = lambda line: ascii_lower(line.strip(BLANK))
    for i, t in rows:
        for line in (t or "").split("\n"):
            owner[key(line)] = min(owner.get(key(line), i), i)
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or owner[key(x)] == i]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def fingerprint(text: str | None, k: int = 3) -> int:
    w = words(text)
    if not w:
        return 0
    grams = [" ".join(w[i:i + k]) for i in range(len(w) - k + 1)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(fps: dict, radius: int = 3) -> dict:
    """Smallest reachable id of every id."""
    parent = {i: i for i in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(fps)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def leaks(docs, items, similarity=0.8):
    found = {}
    for item, text in items:
        w = words(text)
        k = min(5, len(w))
        if not w:
            continue
        a = Counter(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
        m = sum(a.values())
        for doc, body in docs:
            x = words(body)
            grams = [tuple(x[i:i + k]) for i in range(len(x) - k + 1)]
            if not a.keys() & set(grams):
                continue
            for s in range(max(1, len(grams) - m + 1)):
                b = Counter(grams[s:s + m])
                both = sum((a & b).values())
                value = both / (m + sum(b.values()) - both)
                if value >= similarity and value > found.get((doc, item), (0, 0))[0]:
                    found[doc, item] = (value, s)
    return found


def _luhn(s):
    return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(reversed(s))) % 10 == 0


def _digits(s):
    return re.sub("[^0-9]", "", s)


BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 14 <= len(_digits(s)) <= 19 and _luhn(_digits(s))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 10 <= len(_digits(s)) <= 15),
}


def base_spans(text: str | None) -> list[tuple[int, int, str, int]]:
    return sorted((m.start(), n, kind, m.end()) for n, (kind, (p, ok)) in enumerate(BASE.items()) for m in re.finditer(p, text or "") if ok(m[0]))


def span_text(spans) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in spans)


def sha(s: str | bytes) -> str:
    return hashlib.sha256(s.encode() if isinstance(s, str) else s).hexdigest()


def bucket(doc_id, m: int) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % m


def record(*values) -> str:
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def merkle_levels(nodes: list[str]) -> list[list[str]]:
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha("".join(last[i:i + 3])) for i in range(0, len(last), 3)])
    return levels


def merkle_proof(levels: list[list[str]], place: int) -> list[tuple[str, str]]:
    out = []
    for level in levels[:-1]:
        begin = place - place % 3
        out.append(("".join(level[begin:place]), "".join(level[place + 1:begin + 3])))
        place //= 3
    return out


def merkle(rows: list[tuple]) -> list[tuple]:
    """(doc_id, leaf, subroot, root, proof digest, folded root) of rows (doc_id, source, lang, n_chars, text)."""
    first = lambda v: (v is not None, v or 0)
    named = lambda s: (s is not None, (s or "").encode())
    trees = {}
    for r in rows:
        trees.setdefault(r[1], []).append((first(r[0]), record(*r), r))
    sources = sorted(trees, key=named)
    levels = {}
    for s in sources:
        trees[s].sort(key=lambda x: x[:2])
        levels[s] = merkle_levels([leaf for _, leaf, _ in trees[s]])
    top = merkle_levels([levels[s][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for i, (_, leaf, r) in enumerate(trees[s]):
            segments = merkle_proof(levels[s], i) + merkle_proof(top, k)
            even = zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 2 == 0
            node = record(*r[:4], None if r[4] is None else r[4].replace("\n", "")) if even else leaf
            for left, right in segments:
                node = sha(left + node + right)
            out.append((r[0], leaf, levels[s][-1][0], top[-1][0], sha("".join(a + b for a, b in segments)), node))
    return out
