"""Plain single-process versions of the training-data operators, for comparison."""

import hashlib
import math
import re
from collections import Counter

import xxhash

SPACE = r"[\x20\x09-\x0D]+"


def words(text):
    return [w for w in re.split(SPACE, text or "") if w]


def base(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    w, t = words(text), text or ""
    lines = [x for x in t.split("\n") if words(x)]
    grams = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    n = Counter(grams)
    covered = {j for i, g in enumerate(grams) if n[g] > 1 for j in range(i, i + 5)}
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), failed


def js(p, q):
    sp, sq = sum(p), sum(q)
    if not sp or not sq:
        return None
    out = 0.0
    for a, b in zip(p, q, strict=True):
        a, b = a / sp, b / sq
        out += (a * math.log2(2 * a / (a + b)) if a else 0) + (b * math.log2(2 * b / (a + b)) if b else 0)
    return math.sqrt(max(0.0, out / 2))


def histograms(text, classes, common):
    t, w = text or "", words(text)
    c = [len(re.findall(p, t)) for p in classes.values()]
    space = len(t) - sum(map(len, w))
    low = [x.lower() for x in w]
    hits = [low.count(x) for x in common]
    return [*c, space, len(t) - space - sum(c)], [*hits, len(w) - sum(hits)]


def ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def fingerprint(text, shingle=4):
    w = words(ascii_lower(text))
    if not w:
        return 0
    parts = [" ".join(w[i:i + shingle]) for i in range(max(1, len(w) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(fps, max_bits):
    """Smallest index reachable of every fingerprint."""
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= max_bits:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


def sentences(text):
    return re.findall(r"(?s).+?(?:[.!?][ \t\n\x0b\f\r]+|\n[ \t\n\x0b\f\r]*|\Z)", text or "")


def pieces(text, window):
    """Sentences, those of ``window`` words or more cut at the last smallest hash of every window."""
    out = []
    for s in sentences(text):
        t = re.findall(r"[ \t\n\x0b\f\r]*[^ \t\n\x0b\f\r]+[ \t\n\x0b\f\r]*", s)
        if len(t) < window:
            out.append(s)
            continue
        key = [(hashlib.md5(x.strip(" \t\n\x0b\f\r").lower().encode()).hexdigest()[:10], -i) for i, x in enumerate(t)]
        ends = sorted({-min(key[i:i + window])[1] for i in range(len(t) - window + 1)} | {len(t) - 1})
        out += ["".join(t[a + 1:b + 1]) for a, b in zip([-1, *ends], ends)]
    return out


def dedup_spans(docs, run, min_words, window):
    """doc_id -> text without the pieces of repeated runs, grown both ways, that are not first."""
    seen, out = set(), {}
    for i in sorted(docs):
        parts = pieces(docs[i], window)
        norm = [tuple(words(p.lower())) for p in parts]
        runs = set()
        for a in range(len(norm)):
            onward = [b for b in range(a + run, len(norm) + 1) if sum(map(len, norm[a:b])) >= min_words]
            back = [b for b in range(a + 1 - run, -1, -1) if sum(map(len, norm[b:a + 1])) >= min_words]
            runs |= {(a, b) for b in onward[:1]} | {(b, a + 1) for b in back[:1]}
        gone, mine = set(), set()
        for a, b in sorted(runs):
            key = tuple(norm[a:b])
            if key in seen or key in mine:
                gone |= set(range(a, b))
            mine.add(key)
        seen |= mine
        out[i] = "".join(p for k, p in enumerate(parts) if k not in gone) if gone else docs[i]
    return out


def language(train, texts, max_words, max_grams):
    """(language, score) of each text by a model of all (text, lang) rows of ``train``."""
    def word(chunk):
        at = [i for i, c in enumerate(chunk) if c.isalpha()]
        return chunk[at[0]:at[-1] + 1] if at else ""

    def grams(w, n):
        w = f" {w} " if n > 1 else w
        return [w[i:i + n] for i in range(len(w) - n + 1)]

    train = [(t, lang) for t, lang in train if t is not None and lang is not None]
    langs = sorted({lang for _, lang in train})
    count = {lang: Counter(w for t, k in train if k == lang for c in t.lower().split() if (w := word(c))) for lang in langs}
    by_size = {lang: Counter() for lang in langs}
    for lang in langs:
        for w, n in count[lang].items():
            for size in (5, 4, 3, 2, 1):
                for g in grams(w, size):
                    by_size[lang][g] += n

    def table(counts, limit, kind):
        keys = {k for c in counts.values() for k in sorted(c, key=lambda k: (-c[k], k))[:limit // max(1, len(langs))]}
        total = {(lang, kind(k)): 0 for lang in langs for k in counts[lang]}
        for lang in langs:
            for k, n in counts[lang].items():
                total[lang, kind(k)] += n
        return {k: [math.log((counts[lang][k] + 0.5) / (total.get((lang, kind(k)), 0) + 1000.0)) for lang in langs] for k in keys}

    known_words, known_grams = table(count, max_words, lambda k: 0), table(by_size, max_grams, len)
    prior = [math.log(sum(k == lang for _, k in train) / len(train)) for lang in langs]

    def vector(w):
        if w in known_words:
            return known_words[w]
        for size in (5, 4, 3, 2, 1):
            if found := [known_grams[g] for g in grams(w, size) if g in known_grams]:
                return [sum(c) / len(found) for c in zip(*found)]
        return None

    out = []
    for t in texts:
        ws = [w for c in (t or "").lower().split() if (w := word(c))]
        if not ws or not langs:
            out.append(("und", 0.0))
            continue
        vs = [v for w in ws if (v := vector(w)) is not None]
        z = [p + (min(len(vs), 30) / len(vs) * sum(v[i] for v in vs) if vs else 0) for i, p in enumerate(prior)]
        e = [math.exp(x - max(z)) for x in z]
        best = e.index(max(e))
        out.append((langs[best], e[best] / sum(e)))
    return out
