"""Brute-force yardsticks of the pipeline's stages."""

from collections import Counter


def near_groups(texts):
    sets = {}
    for i, t in texts.items():
        w = (t or "").lower().split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) or (frozenset([tuple(w)]) if w else frozenset())
    groups = {i: {i} for i in texts}
    for a in texts:
        for b in texts:
            x, y = sets[a], sets[b]
            if a < b and x and y and 100 * len(x & y) >= 75 * len(x | y) and groups[a] is not groups[b]:
                groups[a] |= groups[b]
                for k in groups[b]:
                    groups[k] = groups[a]
    return {frozenset(g) for g in groups.values()}


def covered(texts, width=35):
    """Each text without the words of repeated windows; as it is where nothing goes."""
    seen, out = Counter(), {}
    split = {i: (t or "").split() for i, t in texts.items()}
    for w in split.values():
        seen.update(tuple(w[k : k + width]) for k in range(len(w) - width + 1))
    for i, w in split.items():
        gone = {j for k in range(len(w) - width + 1) if seen[tuple(w[k : k + width])] > 1 for j in range(k, k + width)}
        out[i] = " ".join(x for k, x in enumerate(w) if k not in gone) if gone else texts[i]
    return out
