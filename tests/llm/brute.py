"""Plain Python versions of the corpus operators, for small inputs."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

WHITE = re.compile(r"[\t\n\x0b\x0c\r\x1c-\x1f ]+")
_UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text: str) -> list[str]:
    return [w.translate(_UPPER) for w in WHITE.split(text) if w]


def key(doc: int | None) -> tuple:
    return (doc is not None, doc or 0)


def line_dedup(docs: list[tuple[int, str]], run: int = 3, chars: int = 300) -> dict[int, str]:
    """Text by document of (doc_id, text), ids unique; documents that lose all lines are absent."""
    seen, out = set(), {}
    for d, text in sorted(docs, key=lambda x: key(x[0])):
        lines = text.split("\n")
        gone = set()
        for i in range(len(lines)):
            for size in range(1, run + 1):
                now = tuple(lines[i : i + size])
                if len(now) == size and (size == run or sum(map(len, now)) >= chars):
                    if now in seen:
                        gone |= {*range(i, i + size)}
                    seen.add(now)
        left = [x for i, x in enumerate(lines) if i not in gone]
        if left:
            out[d] = "\n".join(left)
    return out


def quality(docs: list[tuple[int, str, str]], min_docs: int, min_share: float, min_kept: float) -> dict[int, str]:
    """Text by document of (doc_id, text, host)."""
    norm = lambda x: " ".join(x.lower().split())
    by: dict[tuple, set] = defaultdict(set)
    hosts: dict[str, set] = defaultdict(set)
    for _, text, host in docs:
        hosts[host].add(text)
        for line in text.split("\n"):
            by[host, norm(line)].add(text)
    out = {}
    for d, text, host in docs:
        good, size, left = [], 0, 0
        for line in text.split("\n"):
            n = norm(line)
            chars, c = len(n.replace(" ", "")), len(by[host, n])
            size += chars
            if not n or not (c > min_docs and c > min_share * len(hosts[host])):
                good.append(line)
                left += chars
        if left and left >= min_kept * size:
            out[d] = "\n".join(good)
    return out


def least_distance(item: str, text: str) -> int:
    """Least edit distance of an item to any part of a text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        before, row[0] = row[0], i
        for j, b in enumerate(text, 1):
            before, row[j] = row[j], min(before + (a != b), row[j] + 1, row[j - 1] + 1)
    return min(row)


def near_pairs(prints: list[list[int]], most: int) -> list[tuple[int, int]]:
    whole = [sum(w << (64 * i) for i, w in enumerate(p)) for p in prints]
    return [(i, j) for i in range(len(whole)) for j in range(i) if (whole[i] ^ whole[j]).bit_count() <= most]


def edited_copies(n: int, seed: int) -> list[tuple[int, str]]:
    """(2 i, a text of 60 rare words), (2 i + 1, the same with 4 other words) for each i: SimHash has most of the two 15 to 30 of 192 bits apart."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        text = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        copy = text[:]
        for k in rng.sample(range(60), 4):
            copy[k] = f"w{rng.randrange(10**6)}"
        out += [(2 * i, " ".join(text)), (2 * i + 1, " ".join(copy))]
    return out


def roots(n: int, pairs: list[tuple[int, int]]) -> list[int]:
    up = list(range(n))

    def find(a: int) -> int:
        while up[a] != a:
            a = up[a]
        return a

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(a) for a in range(n)]


def repeated_runs(docs: list[tuple[int, str]], size: int) -> dict[int, list[tuple[int, int]]]:
    """By document of (doc_id, text), ids unique: each place of a run of so many words that an earlier document holds, and the first that does."""
    first: dict[tuple, int] = {}
    out: dict[int, list] = {}
    for d, text in sorted(docs):
        w = words(text)
        for i in range(len(w) - size + 1):
            e = first.setdefault(tuple(w[i : i + size]), d)
            if e != d:
                out.setdefault(d, []).append((i, e))
    return out


def chat(events: list[tuple]) -> list[tuple[int, str | None, str]]:
    """(turn, role, text) after applying (seq, kind, turn, role, text) events of one conversation one by one."""
    rank = {"message": 0, "edit": 1, "regenerate": 2, "delta": 3}
    state: dict[int, list] = {}
    for _, kind, turn, role, text in sorted(events, key=lambda e: (e[0], rank[e[1]], e[2], e[3] is not None, e[3] or "", e[4] is not None, e[4] or "")):
        now = state.setdefault(turn, [None, ""])
        now[0] = role if role is not None else now[0]
        if kind == "delta":
            now[1] += text or ""
        else:
            now[1] = text or ""
        if kind in ("edit", "regenerate"):
            state = {t: v for t, v in state.items() if t <= turn}
    return [(t, *v) for t, v in sorted(state.items())]
