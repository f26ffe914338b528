"""Plain versions of the operators, for small tables only. None of them shares code with them."""

import hashlib
from collections import Counter, defaultdict


def groups(nodes, linked):
    """Smallest member of the group of each node."""
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def shingles(text, size):
    words = (text or "").encode().lower().split()
    return frozenset(zip(*[words[k:] for k in range(min(size, len(words)))])) if words else frozenset()


def near_duplicates(docs, size, percent):
    """docs: (doc_id, text) with distinct ids."""
    sets = {i: shingles(t, size) for i, t in docs}
    ids = sorted(sets)
    links = [
        (a, b) for k, a in enumerate(ids) for b in ids[k + 1 :]
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    label = groups(ids, links)
    return sorted((i, len(sets[i]), label[i]) for i in ids)


def repeated_bytes(docs, length):
    """docs: (doc_id, text); rows may share an id."""
    rows = [(i, (t or "").encode()) for i, t in docs]
    least = {}
    for i, data in rows:
        for k in range(len(data) - length + 1):
            part = data[k : k + length]
            least[part] = min(least.get(part, i), i)
    out = []
    for i, data in rows:
        gone = bytearray(len(data))
        for k in range(len(data) - length + 1):
            if least[data[k : k + length]] < i:
                gone[k : k + length] = b"\1" * length
        kept = bytes(c for c, g in zip(data, gone) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        out.append((i, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def distance(a, b):
    row = list(range(len(a) + 1))
    for j, y in enumerate(b, 1):
        before, row = row, [j]
        for i, x in enumerate(a, 1):
            row.append(min(before[i] + 1, row[-1] + 1, before[i - 1] + (x != y)))
    return row[-1]


def removed_lines(docs, edits, least):
    """Places (doc_id, number) of lines that are not the first of their class.

    Equal lines are one class; so are those of `least` characters or more within `edits`.
    """
    places = [(i, no, line.strip(" \t\n\r\x0b\x0c")) for i, t in docs for no, line in enumerate((t or "").split("\n"))]
    places = [p for p in places if p[2]]
    lines = sorted({p[2] for p in places})
    links = [(a, b) for k, a in enumerate(lines) for b in lines[k + 1 :] if min(len(a), len(b)) >= least and abs(len(a) - len(b)) <= edits and distance(a, b) <= edits]
    label = groups(lines, links)
    first = {}
    for i, no, line in sorted(places):
        first.setdefault(label[line], (i, no))
    return {(i, no) for i, no, line in places if first[label[line]] != (i, no)}


def without_lines(docs, edits, least):
    gone, out = removed_lines(docs, edits, least), []
    for i, t in docs:
        lost = {no for d, no in gone if d == i}
        left = "\n".join(x for no, x in enumerate((t or "").split("\n")) if no not in lost)
        if not lost:
            out.append((i, t))
        elif left.split():
            out.append((i, left))
    return out


def leaks(docs, items, least=0.8):
    """(doc_id, item_id) where some window as long as the item is similar enough."""
    def weights(words):
        size = min(5, len(words))
        return Counter(zip(*[words[k:] for k in range(size)])) if size else Counter()

    found = set()
    for i, text in docs:
        words = (text or "").encode().lower().split()
        for item, t in items:
            own = (t or "").encode().lower().split()
            want = weights(own)
            for k in range(max(1, len(words) - len(own) + 1) if words and own else 0):
                got = weights(words[k : k + len(own)])
                if sum((want & got).values()) >= least * sum((want | got).values()):
                    found.add((i, item))
                    break
    return found


def quality_counts(text):
    text = text or ""
    words = text.encode().split()
    triples = list(zip(words, words[1:], words[2:]))
    times, covered = Counter(triples), set()
    for k, t in enumerate(triples):
        if times[t] > 1:
            covered |= {k, k + 1, k + 2}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.encode().split():
            dup += line in seen
            seen.add(line)
    chars = sum(c not in " \t\n\r\x0b\x0c" for c in text)
    return len(words), chars, sum(c in "#*$%&|<>" for c in text), dup, len(covered), len(words) < 50 or 100 * len(covered) > 50 * len(words)


def matched(rows):
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(r[1:])
    return by
