"""Plain versions of the operators, for small tables."""

import collections
import hashlib
import re

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BLANK = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def keep_lines(docs, min_chars=40, min_docs=5):
    key = lambda x: lower(x.strip(" \t\n\x0b\x0c\r"))
    holders = collections.defaultdict(set)
    for i, t in docs:
        for x in (t or "").split("\n"):
            if len(key(x)) >= min_chars and i is not None:
                holders[key(x)].add(i)
    hot = {k: max(v) for k, v in holders.items() if len(v) >= min_docs}
    return [(i, "\n".join(x for x in (t or "").split("\n") if i is None or hot.get(key(x), i) == i)) for i, t in docs]


def shingles(text):
    w = BLANK.findall(lower(text))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def components(docs, percent=75):
    sets = [(i, shingles(t)) for i, t in docs]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (a, x) in enumerate(sets):
        for b, y in sets[:n]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: (len(s), find(i)) for i, s in sets}


def windows(text, size=10):
    w = ALNUM.findall(lower(text))
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def contaminated(text, items):
    w = ALNUM.findall(lower(text))
    hit, ids = set(), set()
    for item, wins in items:
        for win in wins:
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit.update(range(i, i + len(win)))
                    if item is not None:
                        ids.add(str(item))
    return len(w), len(hit), sorted(ids)


def quality(text):
    w, text = BLANK.findall(text or ""), text or ""
    lines = [x for x in text.split("\n") if BLANK.search(x)]
    n = len(w)
    count = collections.Counter(tuple(w[i : i + 8]) for i in range(n - 7))
    repeated = {j for i in range(n - 7) if count[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated)


def phrases(text):
    w, places, labels = ALNUM.findall(lower(text)), [], set()
    for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
        p = phrase.split()
        for i in range(len(w)):
            if w[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(w), len(places), min(places, default=None), max(places, default=None), sorted(labels)
