"""Spelling variants: words one edit apart, found by k-d trees over letter counts."""

from __future__ import annotations

import re
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segflow.llm.common import prepare, stored

#: Letters of a word after A-Z is lower-cased: a-z and U+00C0 to U+00FF.
LETTERS = 26 + 64
#: Words, about, that the upper levels of the trees are drawn from, and words of a leaf of these levels that one task searches.
SAMPLE, LEAF = 1 << 15, 1 << 12
#: Words of a leaf of the trees that a task builds, below which words are compared one by one.
SMALL = 16
#: Words of equal counts from which a leaf is searched by deleted letters, and pairs of words compared at once.
WIDE, PAIRS = 64, 1 << 15
#: Distinct words that a task counts together.
HELD = 1 << 17
EDITED = 199


def word_counts(docs: DataFrame, shortest: int, least: int) -> DataFrame:
    """(word, n): runs of letters with their planted deletions, of ``shortest`` letters and ``least`` occurrences."""
    prepare(docs.sparkSession)
    pattern = "[a-zÀ-ÿ]{%d,}" % shortest  # a deletion only shortens a run

    def count(stream):
        find, held = re.compile(pattern).findall, Counter()

        def out():
            batch = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()
            return batch

        for batch in stream:
            for doc, text in zip(batch.column("doc_id"), batch.column("text")):
                head = f"{'' if (key := doc.as_py()) is None else key}:".encode()
                begin = crc32(head)
                for run, n in Counter(find(text.as_buffer().to_pybytes().lower().decode("utf-8", "replace"))).items():
                    h = crc32(run.encode(), begin)
                    if h % EDITED == 0:
                        h %= len(run)
                        run = run[:h] + run[h + 1 :]
                        if len(run) < shortest:
                            continue
                    held[run] += n
                if len(held) >= HELD:
                    yield out()
        yield out()

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.length("text") >= shortest)
    return narrow.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def vectors(words: list[str]) -> np.ndarray:
    """Letter counts of words, one row each."""
    code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    letter = np.where(code < 128, code - 97, code - 0xC0 + 26)
    own = np.repeat(np.arange(len(words)), [len(w) for w in words])
    return np.bincount(own * LETTERS + letter, minlength=len(words) * LETTERS).reshape(len(words), LETTERS).astype(np.int32)


def split(counts: np.ndarray, leaf: int):
    """A k-d tree of letter counts as (letter, value, low, high) nodes and, for each leaf, its rows.

    A node cuts the letter that halves its rows best: rows with at most ``value`` of it go low. Rows of equal counts
    cannot be cut, so they form a leaf however many they are. A child below 0 is the leaf of number ``-1 - child``.
    """
    nodes, leaves, todo = [], [], [(np.arange(len(counts)), None, 0)]
    while todo:
        rows, parent, side = todo.pop()
        at = None
        if len(rows) > leaf:
            mine = counts[rows]
            letters = np.flatnonzero(mine.max(0) > mine.min(0))
            if len(letters):
                middle = np.partition(mine[:, letters], len(rows) // 2, axis=0)[len(rows) // 2]
                choices = np.stack([middle - 1, middle])  # the cut just below or at the median
                low = np.stack([(mine[:, letters] <= c).sum(0) for c in choices])
                low[(low == 0) | (low == len(rows))] = 2 * len(rows)
                pick = np.unravel_index(np.argmin(np.abs(low - len(rows) // 2)), low.shape)
                letter, value = int(letters[pick[1]]), int(choices[pick])
                at = len(nodes)
                nodes.append([letter, value, None, None])
                goes = mine[:, letter] <= value
                todo.append((rows[goes], at, 2))
                todo.append((rows[~goes], at, 3))
        if at is None:
            at = -1 - len(leaves)
            leaves.append(rows)
        if parent is not None:
            nodes[parent][side] = at
    return nodes, leaves


def reached(nodes: list, counts: np.ndarray, more: int, fewer: int):
    """(row, leaf) of the boxes that may hold a word with at most ``more`` letters more and ``fewer`` letters less.

    On the way down a row keeps, for each letter, what the box already needs of it; the sum over letters of what is
    needed may not pass ``more`` upwards and ``fewer`` downwards. One edit moves the counts by an L1 distance of at
    most two: a replaced letter is one more and one less, an inserted letter one more.
    """
    rows, leaf = [], []
    todo = [(0 if nodes else -1, np.arange(len(counts)), {}, np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64))]
    while todo:
        at, own, need, up, down = todo.pop()
        if not len(own):
            continue
        if at < 0:
            rows.append(own)
            leaf.append(np.full(len(own), -1 - at))
            continue
        letter, value, low, high = nodes[at]
        have = counts[own, letter]
        old_up, old_down = need.get(letter, (np.zeros(len(own), np.int64),) * 2)
        for child, new_up, new_down in ((low, old_up, np.maximum(old_down, have - value)), (high, np.maximum(old_up, value + 1 - have), old_down)):
            u, d = up - old_up + new_up, down - old_down + new_down
            keep = np.flatnonzero((u <= more) & (d <= fewer))
            kept = {k: (a[keep], b[keep]) for k, (a, b) in need.items()}
            kept[letter] = (new_up[keep], new_down[keep])
            todo.append((child, own[keep], kept, u[keep], d[keep]))
    return (np.concatenate(rows), np.concatenate(leaf)) if rows else (np.zeros(0, np.int64),) * 2


def one_edit(short: str, long: str) -> bool:
    """Whether one inserted or replaced letter makes ``long`` of ``short``, in the order of the letters."""
    at, n = 0, len(short)
    while at < n and short[at] == long[at]:
        at += 1
    if n == len(long):
        return at < n and short[at + 1 :] == long[at + 1 :]
    return short[at:] == long[at + 1 :]


#: How many letters longer the words sought are, and the letters that they may have more and less.
_SOUGHT = ((0, 1, 1), (1, 1, 0), (-1, 0, 1))


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, n_near, best_n, best): for each word its near words' number and the most frequent (ties: the least).

    Words of one length share a k-d tree. Its upper levels are cut on a bounded sample of the words (only their balance
    depends on it); every word is in the one leaf that its counts lead to and is sent, for each of the three lengths
    that a near word can have, to all leaves whose box an edit reaches. The task of a leaf builds the rest of the tree.
    """
    total = words.count()
    share = min(1.0, SAMPLE / max(total, 1))  # by the hash of a word, so the same words are drawn each time
    picked = words.where(F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
    drawn = picked.select("word").toArrow().column("word").to_pylist()
    leaf = max(1, LEAF * len(drawn) // max(total, 1))
    by_length: dict[int, list[str]] = {}
    for word in sorted(drawn):
        by_length.setdefault(len(word), []).append(word)
    trees = {length: split(vectors(own), leaf)[0] for length, own in by_length.items()}

    def route(stream):
        for batch in stream:
            text = batch.column("word").to_pylist()
            counts, size = vectors(text), np.array([len(w) for w in text])
            for length in np.unique(size).tolist():
                mine = np.flatnonzero(size == length)
                home = reached(trees.get(length, []), counts[mine], 0, 0)
                sent = [(home[0], home[1], length, False)]
                sent += [(*reached(trees.get(length + d, []), counts[mine], more, fewer), length + d, True) for d, more, fewer in _SOUGHT]
                for row, at, tree, seeks in sent:
                    rows = pa.array(mine[row])
                    yield pa.RecordBatch.from_arrays([batch.column("word").take(rows), batch.column("n").take(rows), pa.array(np.full(len(row), tree, np.int32)), pa.array(at.astype(np.int32)), pa.array(np.full(len(row), seeks))], names=["word", "n", "length", "leaf", "seeks"])

    def search(stream):
        leaf_of, held, table = None, [], None

        def sought(rows):
            nonlocal table
            if table is None:
                held.sort()
                counts = vectors([w for w, _ in held])
                table = (counts, *split(counts, SMALL))
            return _sought(rows.column("word"), rows.column("n"), held, *table)

        for batch in stream:
            at, seeks = np.stack([np.asarray(batch.column(c)) for c in ("length", "leaf")]), np.asarray(batch.column("seeks"))
            edges = np.flatnonzero(np.any(at[:, 1:] != at[:, :-1], axis=0) | (seeks[1:] != seeks[:-1])) + 1
            for low, high in zip([0, *edges.tolist()], [*edges.tolist(), len(seeks)]):
                if low == high:
                    continue
                if leaf_of != (own := tuple(at[:, low].tolist())):
                    leaf_of, held, table = own, [], None
                rows = batch.slice(low, high - low)
                if seeks[low]:
                    yield sought(rows)
                else:  # the words of a leaf come before those that seek in it
                    held += zip(rows.column("word").to_pylist(), rows.column("n").to_pylist())

    shape = "word string, n long, length int, leaf int, seeks boolean"
    dealt = words.mapInArrow(route, shape).repartition("length", "leaf").sortWithinPartitions("length", "leaf", "seeks")
    found = dealt.mapInArrow(search, "word string, n long, n_near long, best_n long, best string")
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("less"), "best"))).alias("b")
    found = found.groupBy("word", "n").agg(F.sum("n_near").alias("n_near"), best)
    return found.select("word", "n", "n_near", (-F.col("b.less")).alias("best_n"), "b.best")


def _sought(column, counts_of, held: list, counts: np.ndarray, nodes: list, leaves: list):
    """For each seeking word the number of its near words among ``held`` (sorted, of one length) and the best of them."""
    words = column.to_pylist()
    size, length = np.array([len(w) for w in words]), len(held[0][0]) if held else 0
    own, n_near, best = vectors(words), np.zeros(len(words), np.int64), [None] * len(words)
    small = [np.minimum(v, 127).astype(np.int8) for v in (own, counts)]  # cut off at 127, so differences are never too large
    leaf_size = np.array([len(v) for v in leaves])
    members = np.concatenate(leaves)
    first = np.cumsum(leaf_size) - leaf_size

    def meet(row: int, member: int) -> None:
        n_near[row] += 1
        word, n = held[member]
        if best[row] is None or (-n, word) < best[row]:
            best[row] = (-n, word)

    for longer, more, fewer in _SOUGHT if held else ():
        mine = np.flatnonzero(size + longer == length)
        row, leaf = reached(nodes, own[mine], more, fewer)
        row = mine[row]
        wide = leaf_size[leaf] > WIDE
        for at in np.unique(leaf[wide]).tolist():
            _by_deletion(row[wide & (leaf == at)].tolist(), words, leaves[at].tolist(), held, longer, meet)
        row, leaf = row[~wide], leaf[~wide]
        edge = np.concatenate([[0], np.cumsum(leaf_size[leaf])])
        begin = 0
        while begin < len(row):
            end = max(begin + 1, int(np.searchsorted(edge, edge[begin] + PAIRS, "right")) - 1)
            some = leaf_size[leaf[begin:end]]
            one = np.repeat(row[begin:end], some)
            two = members[np.arange(len(one)) + np.repeat(first[leaf[begin:end]] - (edge[begin:end] - edge[begin]), some)]
            apart = np.abs(small[0][one] - small[1][two]).sum(axis=1, dtype=np.int32)
            for k in np.flatnonzero(apart <= more + fewer).tolist():
                word, other = words[one[k]], held[two[k]][0]
                if one_edit(*((other, word) if longer < 0 else (word, other))):
                    meet(one[k], two[k])
            begin = end
    columns = [pa.array([None if b is None else -b[0] for b in best], pa.int64()), pa.array([None if b is None else b[1] for b in best], pa.string())]
    return pa.RecordBatch.from_arrays([column, counts_of, pa.array(n_near), *columns], names=["word", "n", "n_near", "best_n", "best"])


def _by_deletion(rows: list, words: list, members: list, held: list, longer: int, meet) -> None:
    """Near words of ``rows`` in a leaf of many words of equal counts, by what a deleted letter leaves: no pairs are listed."""
    left: dict = {}
    for member in members:
        word = held[member][0]
        if longer < 0:
            left.setdefault(word, []).append(member)
        else:
            for cut in {(k if longer == 0 else 0, word[:k] + word[k + 1 :]) for k in range(len(word))}:
                left.setdefault(cut, []).append(member)
    for row in rows:
        word = words[row]
        if longer < 0:
            keys = {word[:k] + word[k + 1 :] for k in range(len(word))}
        else:
            keys = {(k, word[:k] + word[k + 1 :]) for k in range(len(word))} if longer == 0 else {(0, word)}
        for key in keys:
            for member in left.get(key, ()):
                if held[member][0] != word:
                    meet(row, member)


def variants(docs: DataFrame, shortest: int = 6, least: int = 5, times: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n): words of ``shortest`` letters and ``least`` occurrences and their forms.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF with A-Z lower-cased; a run loses a letter where the crc32
    of ``<doc_id>:<run>`` says so (a null doc_id is written as nothing). Two words are near if one inserted, deleted or
    replaced letter parts them. The form is the near word of largest n (ties: the least) if that is ``times`` the word's
    own; the root follows forms to the last. A null or empty text has no words, repeated rows count each, other columns
    are not read, an empty table gives no rows.
    """
    words = stored(word_counts(docs, shortest, least), "words")
    near = near_words(words).withColumn("with_form", F.coalesce(F.col("best_n") >= times * F.col("n"), F.lit(False)))
    near = near.select("word", F.when(F.col("with_form"), F.col("best")).alias("form"), "n", "n_near", F.when(F.col("with_form"), F.col("best_n")).alias("form_n"))
    near = stored(near, "forms")
    links = near.where("form is not null").select("word", F.col("form").alias("root"))
    while True:  # a form's n is ``times`` larger each time, so paths are short; each round doubles what is followed
        further = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        links = stored(links.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if links.where("moved").isEmpty():
            break
        links = links.drop("moved")
    out = near.join(links.drop("moved"), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
