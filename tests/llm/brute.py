"""Plain versions of the operators, for small tables."""

import collections

from crawlweave.llm import line_dedup, substring_dedup


def brute_lines(rows, min_docs, keep_first):
    """Kept text per distinct (id, text)."""
    docs = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0))
    holders = collections.defaultdict(set)
    for d in docs:
        for line in (d[1] or "").encode().split(b"\n"):
            holders[line_dedup.line_key(line)].add(d)
    seen, out = set(), {}
    for d in docs:
        kept = []
        for line in (d[1] or "").encode().split(b"\n"):
            key = line_dedup.line_key(line)
            if key and len(holders[key]) >= min_docs and (not keep_first or key in seen):
                continue
            seen.add(key)
            kept.append(line)
        out[d] = b"\n".join(kept).decode()
    return out


def brute_passages(rows, min_words):
    seen, out = {}, set()
    for doc, text in rows:
        run = None
        for unit in [*substring_dedup.units(text or ""), None]:
            first = None
            if unit:
                first = seen.get(unit[2])
                seen.setdefault(unit[2], doc)
            if first is not None:
                run = [run[0], unit[1], run[2] + unit[3], run[3]] if run else [*unit[:2], unit[3], first]
                continue
            if run and run[2] >= min_words:
                out.add((doc, *run))
            run = None
    return out


def brute_near(rows, k=5, percent=75):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(max(len(w) - k + 1, 1))} if w else set()
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y]:
                both = len(sets[x] & sets[y])
                if 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                    a, b = top(x), top(y)
                    root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), top(i)) for i in ids}
