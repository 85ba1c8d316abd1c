"""Inputs that every text operator must take: nulls, empty and very long texts, ties, repeated rows, clashing names."""

from __future__ import annotations

import random

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, kept boolean, component_id string, "
    "id string, node int, bits int, row string, tag string, spans string, n long, recipe string, k string"
)


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n))


def texts(seed: int = 7) -> list[tuple[int | None, str | None]]:
    rng = random.Random(seed)
    base = words(rng, 120)
    edited = base.split(" ")
    edited[60] = "changed"
    far = base.split(" ")[:60] + words(rng, 60).split(" ")
    out: list[tuple[int | None, str | None]] = [
        (1, None),
        (2, ""),
        (3, " \t\n"),
        (4, "one"),
        (5, "two words"),
        (6, base),
        (7, base.upper()),
        (8, " ".join(edited)),
        (9, " ".join(far)),
        (10, base.replace(" ", "\n", 3)),
        (11, base + "  "),
        (12, words(rng, 30_000)),
        (13, "x" * 150_000),
        (14, "1234 " * 20_000),
        (15, "!!! ??? 123"),
        (16, "Éàü 漢字 \U0001f642 <|endoftext|> \\ <| |> a@b.co +1 234 567 8901"),
        (None, base),
        (None, None),
        (17, base),
        (17, base),
        (18, words(rng, 80)),
        (18, words(rng, 80)),
    ]
    for i in range(20, 60):
        copy = base.split(" ")
        copy[rng.randrange(120)] = f"w{i}"
        out.append((i, " ".join(copy)))
    return out


def frame(spark, rows=None):
    rows = texts() if rows is None else rows
    data = [
        (i, t, "en" if t else None, "s", None, True, "c", "i", 1, 2, "r", "t", "s", 5, "x", "k") for i, t in rows
    ]
    return spark.createDataFrame(data, SCHEMA).repartition(3)


def shingles(text: str | None, size: int) -> frozenset:
    found = "".join(c.lower() if "A" <= c <= "Z" else c for c in (text or ""))
    for c in "\t\n\x0b\x0c\r":
        found = found.replace(c, " ")
    found = [w for w in found.split(" ") if w]
    if not found:
        return frozenset()
    k = min(size, len(found))
    return frozenset(tuple(found[i : i + k]) for i in range(len(found) - k + 1))


def similar(a: frozenset, b: frozenset) -> bool:
    both = len(a & b)
    return both > 0 and 100 * both >= 80 * len(a | b)


def smallest_reachable(ids: list[int], links: list[tuple[int, int]]) -> dict[int, int]:
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}
