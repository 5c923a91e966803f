"""Plain versions of the words and sets that the operators work on."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
NORMAL = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def sentence(n, seed, alphabet="abcdefgh"):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices(alphabet, k=rng.randint(2, 6))) for _ in range(n))


def shingle_set(text, size=5):
    words = WORD.findall(lower(text or ""))
    if not words:
        return frozenset()
    return frozenset(
        tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))
    )


def near_components(rows, percent):
    """{doc_id: smallest reachable id} by comparing all pairs."""
    sets = [(i, shingle_set(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            both = len(a & b)
            if a and b and 100 * both >= percent * (len(a) + len(b) - both):
                low, high = sorted((find(i), find(j)))
                parent[high] = low
    return {i: find(i) for i, _ in rows}
