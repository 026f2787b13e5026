"""Plain single-process versions of the operators' results, for small inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

from xxhash import xxh64_intdigest

SPACE_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
TEST_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())


def sha(raw):
    return hashlib.sha256(raw).hexdigest()


def kneser_ney(docs, remainder=1):
    """doc rows (doc_id, text) -> list of (doc_id, held_out, n_tokens, n_known, N, base, score)."""
    def toks(t):
        return [*SPACE_WORD.findall(lower(t)), b"\0end"]

    fold = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 5
    c1, c2 = Counter(), Counter()
    for i, t in docs:
        if fold(i) != remainder:
            seq = toks(t)
            c1.update(seq)
            c2.update(zip([None, *seq], seq, strict=False))
    total, v = sum(c1.values()), len(c1)
    before = Counter(w for _, w in c2)
    follow = defaultdict(list)
    for (h, _), n in c2.items():
        follow[h].append(n)

    def disc(counts):
        n = [sum(1 for x in counts if x == k) for k in range(5)]
        if not (n[1] and n[2] and n[3]):
            return [0, .5, 1, 1.5]
        y = n[1] / (n[1] + 2 * n[2])
        d = [0, 1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3]]
        return d if all(0 <= x <= k for k, x in enumerate(d)) else [0, .5, 1, 1.5]

    d1, d2 = disc(list(before.values())), disc(list(c2.values()))
    big = len(c2)
    g1 = sum(d1[min(x, 3)] for x in before.values()) / big

    def low(w):
        t = before.get(w, 0)
        return max(t - d1[min(t, 3)], 0) / big + g1 / (v + 1)

    def prob(h, w):
        if h not in follow:
            return low(w)
        s, c = sum(follow[h]), c2.get((h, w), 0)
        return max(c - d2[min(c, 3)], 0) / s + sum(d2[min(x, 3)] for x in follow[h]) / s * low(w)

    out = []
    for i, t in docs:
        seq = toks(t)
        base = sum(math.log10((c1[w] + .5) / (total + .5 * (v + 1))) for w in seq)
        logs = sum(math.log10(prob(h, w)) for h, w in zip([None, *seq], seq, strict=False))
        out.append((i, fold(i) == remainder, len(seq), sum(c1[w] > 0 for w in seq), total, base, logs))
    return out, prob, [*c1, b"\0unseen"]


def simhash(text, size=4):
    words = SPACE_WORD.findall(lower(text))
    if not words:
        return 0
    size = min(size, len(words))
    hs = [xxh64_intdigest(b" ".join(words[i:i + size]), 42) for i in range(len(words) - size + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def near_groups(docs, bits=4):
    fps = [simhash(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(docs)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= bits:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        r = find(i)
        if d is not None and (least.get(r) is None or d < least[r]):
            least[r] = d
    return [(d, f"{fps[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(docs)]


def decontaminate(docs, bench, n=13):
    windows = defaultdict(set)
    for item, t in bench:
        ws = TEST_WORD.findall(lower(t))
        k = min(n, len(ws))
        for i in range(len(ws) - k + 1 if k else 0):
            windows[tuple(ws[i:i + k])].add(item)
    out = []
    for d, t in docs:
        ws, hit, items = TEST_WORD.findall(lower(t)), set(), set()
        for k in {len(w) for w in windows}:
            for i in range(len(ws) - k + 1):
                found = windows.get(tuple(ws[i:i + k]))
                if found:
                    hit.update(range(i, i + k))
                    items |= found
        items = {i for i in items if i is not None}
        out.append((d, len(ws), len(hit), len(items), sha(",".join(sorted(map(str, items))).encode()),
                    bool(hit) and 20 * len(hit) >= len(ws)))
    return out


def substring(docs, n=20):
    def place(d, i):
        return (d is None, d or 0, i)
    first = {}
    split = [(d, SPACE_WORD.findall((t or "").encode())) for d, t in docs]
    for d, ws in split:
        for i in range(len(ws) - n + 1):
            w = tuple(ws[i:i + n])
            first[w] = min(first.get(w, place(d, i)), place(d, i))
    out = []
    for d, ws in split:
        gone = set()
        for i in range(len(ws) - n + 1):
            if first[tuple(ws[i:i + n])] < place(d, i):
                gone.update(range(i, i + n))
        out.append((d, len(ws), len(gone), sha(b" ".join(w for i, w in enumerate(ws) if i not in gone))))
    return out


def edited(docs):
    """(doc_id, edited text) for documents with distinct ids."""
    order = sorted(docs, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for k, (d, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        out.append((d, t[:len(t) - half] + nxt[:half]))
    return out


def shingles(text, n=5):
    ws = [w for w in re.split("[ \t\n\x0b\f\r]+", text.lower()) if w]
    return {tuple(ws[i:i + n]) for i in range(len(ws) - n + 1)} or ({tuple(ws)} if ws else set())


def conversations(rows):
    """conv_id -> (n_turns, turns digest, loss text) of rows (conv_id, turn, role, text)."""
    by = defaultdict(list)
    for c, k, r, t in rows:
        by[c].append((k is not None, k or 0, r or "", t or ""))
    out = {}
    for c, turns in by.items():
        turns.sort()
        loss = "".join(t for *_, r, t in turns if r == "assistant")
        out[c] = (len(turns), sha("".join(f"{r}\n{t}\n" for *_, r, t in turns).encode()), loss)
    return out


def usable(vector):
    return vector is not None and all(x is not None and math.isfinite(x) for x in vector)


def inner(a, b):
    return sum(x * y for x, y in zip(a, b, strict=False))


def by_score(rows, score):
    """Indices of rows (id, ...) by descending score, then id (null last)."""
    return sorted(range(len(rows)), key=lambda i: (-score[i], rows[i][0] is None, rows[i][0] or 0))


def hard_negatives(rows):
    rows = [(i, [math.floor(256 * x) for x in v], (lab + 1) % 10 if i is not None and i % 7 == 0 else lab)
            for i, v, lab in rows if lab is not None and usable(v)]
    out = []
    for n, (a, av, al) in enumerate(rows):
        if a is None or a % 50:
            continue
        score = [inner(av, r[1]) for r in rows]
        order = [i for i in by_score(rows, score) if i != n]
        for p in [i for i in order if rows[i][2] == al][:5]:
            inside = [i for i in order if rows[i][2] != al and 50 * score[p] <= 100 * score[i] <= 95 * score[p]]
            out += [(a, rows[p][0], k, rows[i][0], score[p], score[i]) for k, i in enumerate(inside[:3], 1)]
    return out


def clusters(rows, k=8, rounds=10):
    rows = [(i, [math.floor(1024 * x) for x in v]) for i, v, _ in rows if usable(v) and len(v) == 64]
    seeds = sorted(rows, key=lambda r: (sha(f"3:{'' if r[0] is None else r[0]}".encode()), r[0] is not None, r[0] or 0, r[1]))
    centroids = [v for _, v in seeds[:k]]

    def nearest(v):
        return min((sum((x - y) ** 2 for x, y in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        mine = [nearest(v)[1] for _, v in rows]
        for j in range(len(centroids)):
            own = [v for (_, v), m in zip(rows, mine, strict=True) if m == j]
            if own:
                centroids[j] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    found = [nearest(v) for _, v in rows]
    total = [sum(d for d, m in found if m == j) for j in range(len(centroids))]
    return [(i, j, d, total[j], sum(total), sha(",".join(map(str, centroids[j])).encode()))
            for (i, _), (d, j) in zip(rows, found, strict=True)]


def nearest(rows, k=5):
    """(query id, its row, [(id, score), ...] of the k nearest) for ids divisible by 50."""
    rows = [(i, v) for i, v, *_ in rows if usable(v) and any(v)]
    norm = [math.sqrt(inner(v, v)) for _, v in rows]
    out = []
    for n, (q, qv) in enumerate(rows):
        if q is not None and q % 50 == 0:
            score = [inner(qv, v) / (norm[n] * m) for (_, v), m in zip(rows, norm, strict=True)]
            out.append((q, [(rows[i][0], score[i]) for i in by_score(rows, score) if i != n][:k]))
    return out


def sketch(text, fraction=1 / 8, n=5):
    """Sorted retained shingle hashes (signed) of a text."""
    def signed(x):
        return x - 2 ** 64 if x >= 2 ** 63 else x

    def chain(hashes):
        x = 42
        for h in hashes:
            x = xxh64_intdigest(h.to_bytes(8, "little", signed=True), x)
        return signed(x)
    words = [signed(xxh64_intdigest(w.encode(), 42)) for w in re.split("[ \t\n\x0b\f\r]+", (text or "").lower()) if w]
    if len(words) < n:
        return [chain(words)] if words else []
    every = {chain(words[i:i + n]) for i in range(len(words) - n + 1)}
    return sorted(h for h in every if h < int(-(2 ** 63) + fraction * 2 ** 64)) or [min(every)]


def containment(a, b):
    return 1.0 if a == b else len(set(a) & set(b)) / len(a) if a else 0.0


def language(text, dicts, margin):
    """(lang_pred, score, accepted) with one compressor for each block and language."""
    import zstandard
    if text is None or not dicts or not any(c.isalpha() for c in text):
        return "und", 0.0, False
    raw, size = text.lower().encode(), {}
    for lang, content in dicts.items():
        total = 0
        for i in range(0, max(1, len(raw)), 4096):
            params = zstandard.ZstdCompressionParameters.from_level(
                6, source_size=4096, dict_size=len(content), min_match=3, write_content_size=False, write_checksum=False,
                write_dict_id=False)
            given = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            given.precompute_compress(compression_params=params)
            total += len(zstandard.ZstdCompressor(dict_data=given, compression_params=params).compress(raw[i:i + 4096]))
        size[lang] = total
    first, *rest = sorted(size, key=lambda lang: (size[lang], lang))
    score = 1 - size[first] / size[rest[0]] if rest else 1.0
    return first, score, score >= margin


def kneser_ney_of_order(docs, order):
    """Texts -> (scores of all, prob(context tuple, word), words): the model of ``order`` words learnt from all texts."""
    def toks(t):
        return [*SPACE_WORD.findall(lower(t)), b"\0end"]
    grams = {order: Counter()}
    for _, t in docs:
        seq = [None] * (order - 1) + toks(t)
        grams[order].update(tuple(seq[i:i + order]) for i in range(len(seq) - order + 1))
    for n in range(order - 1, 0, -1):
        grams[n] = Counter(g[1:] for g in grams[n + 1])
    words = sorted({g[0] for g in grams[1]})

    def disc(counts):
        n = [sum(1 for x in counts if x == k) for k in range(5)]
        if not (n[1] and n[2] and n[3]):
            return [0, .5, 1, 1.5]
        y = n[1] / (n[1] + 2 * n[2])
        d = [0, 1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3]]
        return d if all(0 <= x <= k for k, x in enumerate(d)) else [0, .5, 1, 1.5]
    ds = {n: disc(list(c.values())) for n, c in grams.items()}
    follow = {n: defaultdict(list) for n in grams}
    for n, c in grams.items():
        for g, k in c.items():
            follow[n][g[:-1]].append(k)

    def prob(h, w):
        if not h:
            ks = follow[1][()]
            return (max(grams[1][(w,)] - ds[1][min(grams[1][(w,)], 3)], 0) + sum(ds[1][min(k, 3)] for k in ks) / (len(words) + 1)) / sum(ks)
        low, n = prob(h[1:], w), len(h) + 1
        ks = follow[n].get(h)
        if not ks:
            return low
        c = grams[n][(*h, w)]
        return (max(c - ds[n][min(c, 3)], 0) + sum(ds[n][min(k, 3)] for k in ks) * low) / sum(ks)
    out = []
    for d, t in docs:
        seq = [None] * (order - 1) + toks(t)
        out.append((d, sum(math.log10(prob(tuple(seq[i:i + order - 1]), seq[i + order - 1])) for i in range(len(seq) - order + 1))))
    return out, prob, [*words, b"\0unseen"]
