"""Brute-force versions of the operators, for small tables, and a table with every awkward row."""

from __future__ import annotations

import hashlib
import random
import re

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, n int, word string, part string, key string, row string, th string, a string, start string, dropped string"


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def awkward(seed: int = 1, n: int = 60) -> list[tuple]:
    """Rows with nulls, empty and long texts, exact and near copies, repeated rows and lines, and clashing columns."""
    r = random.Random(seed)
    words = ["ab", "the", "House", "é", "x1", "日本", "of", "a,b", "z.", "Q", "idiot", "paper"]
    text = lambda k: " ".join(r.choice(words) for _ in range(k))
    long = text(3000)
    base = text(120).split()
    rows: list[str | None] = [None, "", " ", "\n", "\n\n", "a", "a b", "\t a \n b ", long, long, "same line of text here\nother", "Same line of text here  \nmore\nmore", "aaaa " * 300, "▁x ▁ y", "  two  blanks", "nul\x00byte", "<|endoftext|> <s>"]
    for i in range(n):
        if i % 3 == 0:
            near = list(base)
            near[r.randrange(len(near))] = f"w{i}"
            rows.append(" ".join(near))
        elif i % 3 == 1:
            rows.append(text(40) + "\n" + " ".join(base[10:60]) + "\n" + text(20))
        else:
            rows.append(text(r.randrange(1, 90)))
    table = [(i, t, "en", f"s{i % 3}", len(t or ""), "x", 1, "w", "p", "k", "r", "t", "a", "s", "d") for i, t in enumerate(rows)]
    return table


def components(sets: dict[int, frozenset], percent: int) -> dict[int, int]:
    up = {i: i for i in sets}

    def find(x: int) -> int:
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i in ids:
        for j in ids:
            if j < i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def shingles(text: str | None, n: int) -> frozenset:
    w = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()).split()
    return frozenset([tuple(w)] if 0 < len(w) < n else [tuple(w[i : i + n]) for i in range(len(w) - n + 1)])


def lines(docs: list[tuple[int, str | None]], least: int = 10) -> dict[int, tuple[int, int, str]]:
    key = lambda line: re.sub(r"[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    holders: dict[str, set[int]] = {}
    for i, t in docs:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least:
                holders.setdefault(key(line), set()).add(i)
    out = {}
    for i, t in docs:
        every = (t or "").split("\n")
        kept = [x for x in every if not (len(key(x)) >= least and len(holders[key(x)]) >= 2 and min(holders[key(x)]) != i)]
        out[i] = len(every), len(every) - len(kept), sha("\n".join(kept).encode())
    return out


def byte_repeats(docs: list[tuple[int, str | None]], w: int) -> dict[int, tuple[int, int, int, str]]:
    starts: dict[bytes, int] = {}
    for _, t in docs:
        x = (t or "").encode()
        for i in range(len(x) - w + 1):
            starts[x[i : i + w]] = starts.get(x[i : i + w], 0) + 1
    out = {}
    for i, t in docs:
        x = (t or "").encode()
        gone = bytearray(len(x))
        for k in range(len(x) - w + 1):
            if starts[x[k : k + w]] > 1:
                gone[k : k + w] = b"\1" * w
        runs = sum(1 for k in range(len(x)) if gone[k] and (not k or not gone[k - 1]))
        out[i] = len(x), sum(gone), runs, sha(bytes(c for c, g in zip(x, gone, strict=True) if not g))
    return out


def word_repeats(docs: list[tuple[int, str | None]], w: int) -> dict[int, tuple[int, int, str]]:
    seen: set[tuple] = set()
    out = {}
    for i, t in sorted(docs, key=lambda d: d[0]):
        x = (t or "").encode().split()
        gone = [False] * len(x)
        for k in range(len(x) - w + 1):
            if tuple(x[k : k + w]) in seen:
                gone[k : k + w] = [True] * w
            seen.add(tuple(x[k : k + w]))
        out[i] = len(x), sum(gone), sha(b" ".join(a for a, g in zip(x, gone, strict=True) if not g))
    return out
