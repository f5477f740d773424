"""Plain Python versions of operators, for small inputs."""

import re


def covered(docs, size):
    """docs: (key, sequence). Per row, the set of covered unit positions."""
    least = {}
    for key, units in docs:
        for i in range(len(units) - size + 1):
            w = units[i : i + size]
            if w not in least or key < least[w]:
                least[w] = key
    out = []
    for key, units in docs:
        gone = set()
        for i in range(len(units) - size + 1):
            if least[units[i : i + size]] < key:
                gone.update(range(i, i + size))
        out.append(gone)
    return out


def word_list(text):
    return tuple(re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode()))


def runs(gone):
    return sum(1 for p in gone if p - 1 not in gone)


def substring(docs, size=13):
    units = [(k, word_list(t)) for k, t in docs]
    return sorted(
        (k, len(u), len(g), b" ".join(w for i, w in enumerate(u) if i not in g).decode())
        for (k, u), g in zip(units, covered(units, size), strict=True)
    )


def suffix(docs, size=50):
    units = [(k, (t or "").encode()) for k, t in docs]
    return sorted(
        (k, len(u), len(g), runs(g), bytes(b for i, b in enumerate(u) if i not in g))
        for (k, u), g in zip(units, covered(units, size), strict=True)
    )
