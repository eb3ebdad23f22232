"""Plain versions of the operators over lists of (doc_id, text), for small inputs."""

import collections
import fractions
import hashlib
import math
import re
import zlib

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def quality(text):
    text = text or ""
    words = WORD.findall(text)
    seen, duplicates = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            duplicates += line in seen
            seen.add(line)
    windows = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = set()
    for i in range(len(words) - 4):
        if windows[tuple(words[i : i + 5])] > 1:
            covered |= set(range(i, i + 5))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), duplicates, len(covered)


def verdicts(docs, limit=0.5):
    """kept of every (host, failed): hosts whose rate, shrunk by the moments of all hosts, passes the limit go."""
    hosts = collections.defaultdict(list)
    for host, failed in docs:
        if host is not None:
            hosts[host].append(failed)
    n, mean = sum(map(len, hosts.values())), 0.0
    if n:
        mean = min(max(sum(map(sum, hosts.values())) / n, 1e-6), 1 - 1e-6)
    true_mean, q = (sum(map(sum, hosts.values())) / n if n else 0.0), mean * (1 - mean)
    spread = sum(len(h) * (sum(h) / len(h) - true_mean) ** 2 for h in hosts.values())
    weight = n - sum(len(h) ** 2 for h in hosts.values()) / n - (len(hosts) - 1) if n else 0
    between = (spread - (len(hosts) - 1) * q) / weight if weight > 1e-9 * n else 0.0
    strength = 1e6 if between <= 0 else min(max(q / between - 1, 2.0), 1e6)
    bad = {name for name, h in hosts.items() if (sum(h) + mean * strength) / (len(h) + strength) > limit}
    return [not failed and host not in bad for host, failed in docs]


def byte_repeats(docs, window=200):
    seen = collections.Counter()
    raws = [(text or "").encode() for _, text in docs]
    for b in raws:
        seen.update(b[i : i + window] for i in range(len(b) - window + 1))
    out = []
    for (doc_id, _), b in zip(docs, raws, strict=True):
        gone = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if seen[b[i : i + window]] > 1:
                gone[i : i + window] = b"\1" * window
        kept = bytes(x for x, y in zip(b, gone, strict=True) if not y)
        out.append((doc_id, len(b), sum(gone), sum(gone[i] and not (i and gone[i - 1]) for i in range(len(b))), hashlib.sha256(kept).hexdigest()))
    return out


def word_repeats(docs, window=50):
    order = lambda d: float("inf") if d is None else d
    least = {}
    split = [(text or "").encode().split() for _, text in docs]
    for (doc_id, _), words in zip(docs, split, strict=True):
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            least[key] = min(least.get(key, float("inf")), order(doc_id))
    out = []
    for (doc_id, _), words in zip(docs, split, strict=True):
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            if least[tuple(words[i : i + window])] < order(doc_id):
                gone[i : i + window] = [True] * window
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out.append((doc_id, len(words), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def shingles(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if len(words) >= 5:
        return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}
    return {tuple(words)} if words else set()


def jaccard(docs, groups=False):
    """(doc_id, n, component) of every row, or its group's number; rows are told apart by position."""
    sets = [shingles(text) for _, text in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    index = collections.defaultdict(list)
    for i, s in enumerate(sets):
        shared = collections.Counter(j for x in s for j in index[x])
        for j, n in shared.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                parent[find(i)] = find(j)
        for x in s:
            index[x].append(i)
    if groups:
        return [find(i) for i in range(len(docs))]
    least = {}
    for i, (doc_id, _) in enumerate(docs):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return [(doc_id, len(sets[i]), least.get(find(i))) for i, (doc_id, _) in enumerate(docs)]


def targets(sizes, weights, most_times=3):
    """Share the sum of sizes by weight; none over ``most_times`` its size, the excess shared again."""
    capped = set()
    while True:
        left = sum(sizes) - sum(most_times * sizes[i] for i in capped)
        weight = sum(w for i, w in enumerate(weights) if i not in capped)
        unit = left / weight if weight else 0.0
        over = {i for i, w in enumerate(weights) if i not in capped and unit * w > most_times * sizes[i]}
        if not over:
            return [float(most_times * s) if i in capped else unit * w for i, (s, w) in enumerate(zip(sizes, weights, strict=True))]
        capped |= over


def mixed(sources, placed, phi, unit, most_times=3):
    """Words taken of each row: slot by slot, each point's source, the next of its blocks, and the rows that lie in it.

    ``sources``: number to (size, blocks, low, high); ``placed``: (row, source, first word, words).
    """
    due = max((s[3] for s in sources.values()), default=0)
    used, rank = collections.Counter(), collections.Counter()
    for j in range(-(-due // unit)):
        point = min(int(((j * phi) % (1 << 64) >> 11) * 2.0**-53 * due), due - 1)
        source = next(k for k, (_, _, low, high) in sources.items() if low <= point < high)
        epoch, block = divmod(rank[source], sources[source][1])
        rank[source] += 1
        if epoch < most_times:
            used[source, block] += 1
    taken = collections.Counter()
    for row, source, first, words in placed:
        size, blocks = sources[source][:2]
        for (s, block), times in used.items():
            if s == source:
                begin, end = block * size // blocks, (block + 1) * size // blocks
                taken[row] += times * max(0, min(end, first + words) - max(begin, first))
    return taken


def best_fit(lengths, most, open_bins):
    """Bin and offset of each length in the given order, by looking at every open bin."""
    bins, out, opened = [], [], 0
    for n in lengths:
        fitting = [b for b in bins if b[1] >= n]
        if fitting:
            best = min(b[1] for b in fitting)
            chosen = [b for b in fitting if b[1] == best][-1]  # of like bins, the one last used
            bins.remove(chosen)
        else:
            chosen, opened = [opened, most], opened + 1
        out.append((chosen[0], most - chosen[1]))
        chosen[1] -= n
        if chosen[1]:
            bins.append(chosen)  # the last used comes last
        if len(bins) > open_bins:
            least = min(b[1] for b in bins)
            bins.remove(next(b for b in bins if b[1] == least))
    return out


def crc(ids):
    return zlib.crc32(b"".join(int(x).to_bytes(4, "little") for x in ids))


def order(rows):
    """Rows in an order that nulls do not break."""
    return sorted(rows, key=repr)


def runs(words):
    """start, length and smallest period of each run, by comparing at every distance."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = q
        while i < n:
            if words[i] != words[i - q]:
                i += 1
                continue
            j = i
            while j < n and words[j] == words[j - q]:
                j += 1
            run = words[i - q : j]
            if len(run) >= max(6, 4 * q) and not any(run[r:] == run[:-r] for r in range(1, q)):
                out.append((i - q, len(run), q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def periodic(doc_id, text):
    """One row of the digest, planted ending included."""
    words = WORD.findall(text or "")
    n, h = len(words), 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    found = runs(words)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = max(found, key=lambda r: (fractions.Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *top, digest("".join(f"{a},{b},{c}\n" for a, b, c in found)), digest(kept))


def whitening(vectors, components=8):
    """n, deviations by row, covariance's leading eigenvalues and vectors, its trace and the centred rows."""
    x = [[math.floor(1024 * float(c)) + 100000 for c in v] for v in vectors]
    n, sums = len(x), [sum(col) for col in zip(*x)]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(row, sums)) for row in x]
    centred = np.array([[(n * a - s) / n for a, s in zip(row, sums)] for row in x])
    values, directions = np.linalg.eigh(centred.T @ centred / n)
    k = min(components, len(values))
    return n, deviation, values[::-1][:k], directions.T[::-1][:k], float(values.sum()), centred
