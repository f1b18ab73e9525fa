"""Small tables with every odd case, and brute-force versions."""

import hashlib
import re
from collections import Counter

import numpy as np

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, spans string, key string, gram long, packed string, host string"


def table(spark, rows):
    """Documents from (doc_id, text), with columns whose names operators use themselves, all null."""
    full = [(d, t, None, "s", None if t is None else len(t), None, None, None, None, None, None) for d, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def prose(seed, words=120, vocabulary=4000):
    draw = np.random.default_rng(seed)
    return " ".join(f"w{v}" for v in draw.integers(0, vocabulary, words))


def odd_rows():
    base = prose(1)
    return [
        (5, base), (3, base), (3, base), (9, None), (10, ""), (11, "   \n\t "), (12, "a"), (13, base + " " + prose(2)),
        (None, prose(3)), (None, base), (20, "ab cd " * 300), (21, "xx " + "ab cd " * 150), (22, "z" * 700),
        (23, prose(4, 9000)), (24, prose(4, 9000) + " tail"), (25, "ü " * 300), (26, "\x01 <|endoftext|>  é " * 40),
        (27, prose(5)), (28, prose(5).replace("w1", "v1", 2)),
    ]


def bytes_brute(rows, window=200):
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(b[i : i + window] for b in data for i in range(len(b) - window + 1))
    out = []
    for (doc, _), b in zip(rows, data):
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - window + 1):
            if seen[b[i : i + window]] > 1:
                gone[i : i + window] = True
        kept = bytes(v for v, g in zip(b, gone) if not g)
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((doc, len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def words_brute(rows, window=50):
    big, low, split = 1 << 62, {}, []
    for doc, text in rows:
        own = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode())
        split.append(own)
        for i in range(len(own) - window + 1):
            key = tuple(own[i : i + window])
            low[key] = min(low.get(key, big + 1), big if doc is None else doc)
    out = []
    for (doc, _), own in zip(rows, split):
        gone = [False] * len(own)
        for i in range(len(own) - window + 1):
            if low[tuple(own[i : i + window])] < (big if doc is None else doc):
                gone[i : i + window] = [True] * window
        kept = b" ".join(w for w, g in zip(own, gone) if not g)
        out.append((doc, len(own), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def plain_words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())
