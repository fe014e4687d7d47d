"""Plain versions of what the operators compute, over lists of dictionaries."""

import re
import zlib
from collections import Counter, defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def fold(key, folds):
    return zlib.crc32(("" if key is None else str(key)).encode()) % folds


def shingles(text, k=5):
    words = spaced((text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def near_duplicates(texts, percent=85):
    """{id: (set size, component, kept)}"""
    sets = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def contamination(text, items, span=13):
    """(words, hit words, sorted ids of found items); items: [(id, text)]"""
    windows = defaultdict(set)
    for item, other in items:
        words = alnum(other)
        n = min(span, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            windows[tuple(words[i : i + n])].add(item)
    words = alnum(text)
    hit, found = [False] * len(words), set()
    for n in {len(w) for w in windows}:
        for i in range(len(words) - n + 1):
            if tuple(words[i : i + n]) in windows:
                found |= windows[tuple(words[i : i + n])]
                hit[i : i + n] = [True] * n
    return len(words), sum(hit), sorted(str(i) for i in found if i is not None)


def phrase_places(text):
    phrases = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}
    words = alnum(text)
    return len(words), sorted((i, label) for p, label in phrases.items() for i in range(len(words)) if tuple(words[i : i + len(p)]) == p)


def quality_counts(text):
    text = text or ""
    words = spaced(text)
    windows = defaultdict(list)
    for i in range(len(words) - 7):
        windows[tuple(words[i : i + 8])].append(i)
    covered = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if spaced(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def unigram(texts):
    """{id: (tokens, known, training tokens, base)}"""
    import math

    tokens = {i: [*spaced((t or "").translate(LOWER)), None] for i, t in texts.items()}
    counts = Counter(w for i, t in tokens.items() if fold(i, 7) != 2 for w in t)
    total, distinct = sum(counts.values()), len(counts)
    return {
        i: (len(t), sum(counts[w] > 0 for w in t), total, sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in t))
        for i, t in tokens.items()
    }


def split_url(url):
    found = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return (found[1].translate(LOWER), found[2]) if found else ("", "")


def url_rule(host, path):
    rules = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
    fits = []
    for rule in rules:
        domain, slash, start = rule.partition("/")
        if (host == domain or host.endswith("." + domain)) and path.startswith(slash + start):
            fits.append(rule)
    best = max(fits, key=len, default=None)
    return best, rules.get(best)


def mix_targets(sizes):
    """{source: target}; sizes: {source: words}"""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in full]
        rest = total - sum(2 * sizes[s] for s in full)
        target = {s: 2.0 * sizes[s] if s in full else rest * weight[s] / sum(weight[x] for x in free) for s in order}
        above = {s for s in free if target[s] > 2 * sizes[s]}
        if not above:
            return target
        full |= above


def run_buckets(text, buckets=10_000, longest=3):
    """(words, buckets of all runs of words)"""
    words = alnum(text)
    runs = (" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1))
    return len(words), [zlib.crc32(r.encode()) % buckets for r in runs]


def resampled(rows, target):
    """Sorted (key, features, weight, score, rank); rows: [(key, text)], target: [text]"""
    import hashlib
    import math

    docs = [(key, *run_buckets(text)) for key, text in rows]
    own = Counter(b for *_, found in docs for b in found)
    other = Counter(b for text in target for b in run_buckets(text)[1])
    mine, theirs = sum(own.values()) + 10_000, sum(other.values()) + 10_000
    gain = lambda b: math.floor(1000 * math.log((other[b] + 1) * mine / ((own[b] + 1) * theirs)))
    scored = []
    for key, n, found in docs:
        weight = sum(map(gain, found))
        h = int(hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        scored.append([key, n, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in scored if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    ranks = {id(r): i + 1 for i, r in enumerate(able[: 5 * len(able) // 100])}
    return sorted(((r[0], r[2], r[3], r[4], ranks.get(id(r))) for r in scored), key=str)


def spellings(texts, noise=199, least=6, often=5, times=5):
    """{word: (n, near words, form, form's n, root)}; texts: [(key, text)]. Every two words are compared by all single edits."""
    counts = Counter()
    for key, text in texts:
        for run in re.findall("[A-Za-z\u00C0-\u00FF]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % noise == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return spelling_forms({w: n for w, n in counts.items() if len(w) >= least and n >= often}, times)


def spelling_forms(counts, times=5):
    gaps = defaultdict(set)
    for w in counts:
        for i in range(len(w)):
            gaps[w[:i], w[i + 1 :]].add(w)
    near = defaultdict(set)
    for (a, b), words in gaps.items():
        for w in words:
            near[w] |= words
            if a + b in counts:
                near[w].add(a + b)
                near[a + b].add(w)
    form = {}
    for w, n in counts.items():
        best = min(near[w] - {w}, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= times * n else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {w: (n, len(near[w] - {w}), form[w], form[w] and counts[form[w]], root(w)) for w, n in counts.items()}


def best_fit_decreasing(sizes, length=2048):
    """Number of sequences."""
    from bisect import bisect_left, insort

    gaps, n = [], 0
    for size in sorted(sizes, reverse=True):
        i = bisect_left(gaps, size)
        room = gaps.pop(i) if i < len(gaps) else length
        n += room == length
        if room > size:
            insort(gaps, room - size)
    return n
