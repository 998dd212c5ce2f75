"""Plain-Python versions of the corpus operators, for small tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def crc(ids):
    return zlib.crc32(b"".join(int(i).to_bytes(4, "little") for i in ids))


def removed_repeats(docs):
    words = {d: WORD.findall(t or "") for d, t in docs}
    least = {}
    for d, w in words.items():
        for i in range(len(w) - 12):
            key = tuple(w[i : i + 13])
            least[key] = min(least.get(key, d), d)
    out = {}
    for d, w in words.items():
        gone = set()
        for i in range(len(w) - 12):
            if least[tuple(w[i : i + 13])] < d:
                gone.update(range(i, i + 13))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[d] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def maximal_repeats(docs, size=13):
    """``doc, start, length, first doc, first start``; docs of different ids."""
    rep, words = {}, {d: WORD.findall(t or "") for d, t in docs}
    for d, t in sorted(docs):
        rep.setdefault(t, d)
    own = {d for d, t in docs if rep[t] == d}
    first = {}
    for d in sorted(own):
        for i in range(len(words[d]) - size + 1):
            first.setdefault(tuple(words[d][i : i + size]), (d, i))
    out = {(d, 0, len(words[d]), rep[t], 0) for d, t in docs if rep[t] != d and len(words[d]) >= size}
    for d in own:
        run = None
        for i in range(len(words[d]) - size + 1):
            at = first[tuple(words[d][i : i + size])]
            if run and at == (run[3], run[4] + i - run[1]):
                run[2] += 1
            else:
                run = [d, i, size, *at]
            if at[0] < d:
                out.discard(tuple([*run[:2], run[2] - 1, *run[3:]]))
                out.add(tuple(run))
    return out


def rule_counts(text):
    text = text or ""
    w = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    rep = set()
    for i in range(len(w) - 2):
        if grams[tuple(w[i : i + 3])] > 1:
            rep.update(range(i, i + 3))
    base = len(w) < 50 or 100 * len(rep) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(rep), base


def shingles(text, k):
    w = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def linked(docs, k, percent):
    sets = {d: shingles(t, k) for d, t in docs}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def boilerplate_free(docs, min_sites=8, distinct_texts=False):
    sites, least = defaultdict(set), {}
    for _, text, source in docs:
        if source is not None:
            least[text] = min(source, least.get(text, source))
    for _, text, source in docs:
        source = least[text] if distinct_texts and source is not None else source
        for line in (text or "").split("\n"):
            if line.strip(" ") and source is not None:
                sites[line].add(source)
    out = []
    for d, text, _ in docs:
        if text is None:
            out.append((d, None, 0, 0))
            continue
        lines = text.split("\n")
        kept = [x for x in lines if len(sites.get(x, ())) < min_sites]
        out.append((d, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def contaminated(docs, items, bound=0.8):
    split = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+")
    lower = lambda t: [x for x in split.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))]
    bags, df = {}, Counter()
    for i, t in items:
        w = lower(t)
        k = min(5, len(w))
        if k:
            bags[i] = (k, Counter(tuple(w[j : j + k]) for j in range(len(w) - k + 1)))
            df.update(set(bags[i][1]))
    found = {}
    for d, t in docs:
        w = lower(t)
        grams = {k: [tuple(w[j : j + k]) for j in range(len(w) - k + 1)] for k in range(1, 6)}
        for i, (k, bag) in bags.items():
            n = sum(bag.values())
            for s in range(len(grams[k]) - n + 1):
                if not any(g in bag for g in grams[k][s : s + n]):
                    continue
                own = Counter(grams[k][s : s + n])
                low = sum(min(own[g], bag[g]) / max(1, df[g]) for g in own.keys() | bag.keys())
                high = sum(max(own[g], bag[g]) / max(1, df[g]) for g in own.keys() | bag.keys())
                if low / high >= bound - 1e-12:
                    found[d, i] = max(found.get((d, i), 0), low / high)
    return found
