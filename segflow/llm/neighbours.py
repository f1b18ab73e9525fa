"""Toxicity by nearest labelled examples: exact TF-IDF cosine over block-max inverted lists, distance-weighted votes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segflow.llm.common import mixed, NONE, PLAIN, prepare, rolling, signed, stored, text_buffers, texts, words
from segflow.llm.shingles import SHINGLE, lowered, pieces, rarity, word_slots

#: Bounds of the fit: labelled rows of each label that are drawn by the hash of their id, and terms that are kept.
EXAMPLES, TERMS = 4096, 4096
#: Least standard score by which a term's rate among toxic examples exceeds that among others.
TELLING = 4.5
#: And by which factor.
LIFT = 2.0
NEIGHBOURS, PRIOR_WEIGHT = 15, 0.5
BLOCK = 64


def held_out(column: str = "doc_id"):
    """Rows that no label is learnt from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _term_counts(data: np.ndarray, at: np.ndarray):
    """(document, term, word slot, count) of the distinct words, by document and term."""
    _, _, first, hashes = words(data, at, PLAIN)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    turn = np.lexsort((hashes, doc))
    doc, hashes = doc[turn], hashes[turn]
    new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])])) if len(doc) else np.zeros(0, np.int64)
    return doc[new], hashes[new], word_slots(hashes[new]), np.diff(np.append(new, len(doc)))


def _twins(stream):
    """Adds two least hashes of the five-word runs of each text, equal for copies and for most near copies."""
    for batch in stream:
        data, offsets = text_buffers(lowered(batch.column("text")))
        least = np.zeros((2, batch.num_rows), np.int64)
        for low, high in pieces(offsets):
            _, _, first, hashes = words(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], PLAIN)
            size = np.diff(first)
            runs = hashes.copy()
            if len(hashes) >= SHINGLE:
                whole = np.flatnonzero(np.arange(len(hashes)) + SHINGLE <= np.repeat(first[1:], size))
                runs[whole] = rolling(hashes, SHINGLE)[whole]
            # the last words of a text have no whole run and do not count, but in texts of under five words
            runs[(np.arange(len(hashes)) + SHINGLE > np.repeat(first[1:], size)) & np.repeat(size >= SHINGLE, size)] = NONE
            some = np.flatnonzero(size)
            if len(some):
                for k in range(2):
                    each = np.where(runs == NONE, NONE, mixed(runs + np.uint64(k)))
                    least[k, low + some] = signed(np.minimum.reduceat(each, first[:-1][some]))
        columns = [batch.column(c) for c in ("doc_id", "toxic", "text")] + [pa.array(v) for v in least]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "toxic", "text", "one", "two"])


class Index:
    """Inverted lists of unit vectors: per term the examples and weights, and the greatest weight of each block of examples."""

    def __init__(self, examples: list[tuple[int, int, dict[int, float]]]):
        self.ids = np.array([e[0] for e in examples], np.int64)
        self.label = np.array([e[1] for e in examples], np.float64)
        self.blocks = -(-len(examples) // BLOCK)
        lists: dict[int, list] = {}
        for k, (_, _, vector) in enumerate(examples):
            for term, weight in vector.items():
                lists.setdefault(term, []).append((k, weight))
        self.lists, self.most = {}, {}
        for term, pairs in lists.items():
            at = np.array([p[0] for p in pairs])
            weight = np.array([p[1] for p in pairs])
            most = np.zeros(self.blocks)
            np.maximum.at(most, at // BLOCK, weight)
            self.lists[term] = (at, weight, np.searchsorted(at, np.arange(self.blocks + 1) * BLOCK))
            self.most[term] = most

    def nearest(self, vector: dict[int, float], k: int) -> tuple[np.ndarray, np.ndarray]:
        """Exact ``k`` nearest examples by cosine (ties by place): blocks by falling bound, until none can enter."""
        terms = [t for t in vector if t in self.lists]
        if not terms:
            return np.zeros(0, np.int64), np.zeros(0)
        bound = sum(vector[t] * self.most[t] for t in terms)
        near, place, least = np.zeros(0), np.zeros(0, np.int64), 0.0
        for block in np.argsort(-bound, kind="stable").tolist():
            if bound[block] <= 0 or (len(near) == k and bound[block] < least - 1e-12):
                break
            own = np.zeros(BLOCK)
            for t in terms:
                at, weight, cut = self.lists[t]
                a, b = cut[block], cut[block + 1]
                own[at[a:b] - block * BLOCK] += vector[t] * weight[a:b]
            some = np.flatnonzero(own)
            near, place = np.append(near, own[some]), np.append(place, some + block * BLOCK)
            turn = np.lexsort((place, -near))[:k]
            near, place = near[turn], place[turn]
            least = near[-1]
        return place, near


class Classifier:
    """Terms with their weights, the example index, and the share of each label behind an example."""

    def __init__(self, terms: np.ndarray, weight: np.ndarray, examples, rates: tuple[float, float], prior: float):
        self.terms, self.weight, self.rates, self.prior = terms, weight, rates, prior
        self.filter = np.zeros(1 << 16, bool)
        self.filter[(terms >> np.uint64(48)).astype(np.int64)] = True
        self.index, self.known = Index(examples), {}

    def vectors(self, data: np.ndarray, at: np.ndarray):
        """Unit vectors over the kept terms, as {place of term: weight}, of each document that has any."""
        _, _, first, hashes = words(data, at, PLAIN)
        maybe = np.flatnonzero(self.filter[(hashes >> np.uint64(48)).astype(np.int64)]) if len(self.terms) else np.zeros(0, np.int64)
        place = np.minimum(np.searchsorted(self.terms, hashes[maybe]), max(0, len(self.terms) - 1))
        good = self.terms[place] == hashes[maybe] if len(maybe) else np.zeros(0, bool)
        doc, place = np.searchsorted(first, maybe[good], "right") - 1, place[good]
        out: dict[int, dict[int, float]] = {}
        for d, t in zip(doc.tolist(), place.tolist()):
            own = out.setdefault(d, {})
            own[t] = own.get(t, 0) + 1
        for own in out.values():
            for t in own:
                own[t] = (1 + np.log(own[t])) * self.weight[t]
            norm = np.sqrt(sum(v * v for v in own.values()))
            for t in own:
                own[t] /= norm
        return out

    def score(self, vector: dict[int, float]) -> tuple[float, list[int]]:
        """Vote of the nearest examples by cosine, corrected for how each label was drawn, with the base rate as a
        weak vote of its own; and the ids of the examples."""
        key = tuple(sorted((t, round(w, 12)) for t, w in vector.items()))
        if key not in self.known:
            place, near = self.index.nearest(vector, NEIGHBOURS)
            label = self.index.label[place]
            vote = near * np.where(label > 0, self.rates[1], self.rates[0])
            score = (float((vote * label).sum()) + PRIOR_WEIGHT * self.prior) / (float(vote.sum()) + PRIOR_WEIGHT)
            if len(self.known) > 50_000:
                self.known.clear()
            self.known[key] = (min(1.0, max(0.0, score)), self.index.ids[place].tolist())
        return self.known[key]


def fit(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, terms: int = TERMS) -> Classifier:
    """Fit on at most ``examples`` rows of each label, drawn by the hash of their id; held-out ids are never read.

    Rarity of terms comes from all documents. Terms of toxic examples, by TELLING standard errors, are kept, at most
    ``terms`` of them. Null labels are ignored; of repeated labels the greatest holds.
    """
    prepare(docs.sparkSession)
    rare = rarity(docs)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where("doc_id is not null and toxic in (0, 1)").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    drawn = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(examples) for y in (0, 1)]
    drawn = F.broadcast(drawn[0].unionByName(drawn[1]))  # at most twice ``examples`` rows of two numbers
    # copies and near copies are one example: their common words would seem telling
    sample = texts(docs).where("doc_id is not null").join(drawn, "doc_id").mapInArrow(_twins, "doc_id long, toxic int, text string, one long, two long")
    for twin in ("one", "two"):  # the row with the least id stays, whatever order the rows come in
        first = F.min(F.struct("doc_id", "text", "one", "two")).alias("first")
        sample = sample.groupBy(twin, "toxic").agg(first).select("toxic", "first.*")
    sample = stored(sample.select("doc_id", "toxic", "text"), "examples")

    def count(stream):
        for batch in stream:
            data, offsets = text_buffers(lowered(batch.column("text")))
            y = batch.column("toxic").to_numpy().astype(np.int64)
            for low, high in pieces(offsets):
                doc, term, slot, _ = _term_counts(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                own = y[low:high][doc]
                yield pa.RecordBatch.from_arrays([pa.array(signed(term)), pa.array(slot.astype(np.int32)), pa.array(1 - own), pa.array(own)], names=["term", "slot", "other", "toxic"])

    rows = sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()
    size = {r["toxic"]: r["n"] for r in rows}
    n0, n1 = max(1, size.get(0, 0)), max(1, size.get(1, 0))
    each = sample.select("text", "toxic").mapInArrow(count, "term long, slot int, other long, toxic long")
    each = each.groupBy("term", "slot").agg(F.sum("other").alias("a"), F.sum("toxic").alias("b")).where("a + b >= 4")
    rate = (F.col("a") + F.col("b")) / (n0 + n1)
    gap = (F.col("b") / n1 - F.col("a") / n0) / F.sqrt(rate * (1 - rate) * (1 / n0 + 1 / n1) + 1e-12)
    best = each.withColumn("gap", gap).where(F.col("gap") >= TELLING).where(F.col("b") / n1 >= F.col("a") / n0 * LIFT).orderBy(F.desc("gap"), "term").limit(terms).collect()
    found = sorted((int(np.int64(r["term"]).view(np.uint64)), r["slot"]) for r in best)
    chosen = np.array([f[0] for f in found], np.uint64)
    weight = rare[np.array([f[1] for f in found], np.int64)].astype(np.float64) if found else np.zeros(0)
    base = (counts.get(1, 0) + 1) / (counts.get(0, 0) + counts.get(1, 0) + 2)
    blank = Classifier(chosen, weight, [], (1.0, 1.0), base)

    def vectors(stream):
        for batch in stream:
            data, offsets = text_buffers(lowered(batch.column("text")))
            for low, high in pieces(offsets):
                made = blank.vectors(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                docs_of = sorted(made)
                columns = [batch.column(c).slice(low, high - low).take(pa.array(docs_of, pa.int64())) for c in ("doc_id", "toxic")]
                columns += [pa.array([list(made[d]) for d in docs_of], pa.list_(pa.int32())), pa.array([list(made[d].values()) for d in docs_of], pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "toxic", "terms", "weights"])

    kept = sample.select("doc_id", "toxic", "text").mapInArrow(vectors, "doc_id long, toxic int, terms array<int>, weights array<double>").collect()
    made = [(r["doc_id"], r["toxic"], dict(zip(r["terms"], r["weights"]))) for r in sorted(kept, key=lambda r: (r["doc_id"], str(r["terms"])))]
    rates = tuple(counts.get(y, 0) / max(1, size.get(y, 0)) for y in (0, 1))
    top = max(rates) or 1.0
    return Classifier(chosen, weight, made, (rates[0] / top, rates[1] / top), base)


def scored(docs: DataFrame, model: Classifier) -> DataFrame:
    """``docs`` (all columns) with ``score`` and ``evidence``, the ids of the nearest examples.

    Only the text is read for a score. A text without a kept term (also null or empty) gets the base rate.
    """
    from pyspark.sql import types as T

    prepare(docs.sparkSession)
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("evidence", T.ArrayType(T.LongType()))])

    def judge(stream):
        for batch in stream:
            data, offsets = text_buffers(lowered(batch.column("text").fill_null("")))
            score, evidence = np.full(batch.num_rows, model.prior), [[]] * batch.num_rows
            for low, high in pieces(offsets):
                for d, vector in model.vectors(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]).items():
                    score[low + d], evidence[low + d] = model.score(vector)
            columns = [*batch.columns, pa.array(score), pa.array(evidence, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "score", "evidence"])

    return docs.mapInArrow(judge, schema)


def without_toxic(docs: DataFrame, model: Classifier, limit: float = 0.5) -> DataFrame:
    """``docs`` with all columns, of the documents with a score below ``limit``; null and empty texts are kept."""
    prepare(docs.sparkSession)

    def keep(stream):
        for batch in stream:
            data, offsets = text_buffers(lowered(batch.column("text").fill_null("")))
            score = np.zeros(batch.num_rows)
            for low, high in pieces(offsets):
                for d, vector in model.vectors(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]).items():
                    score[low + d] = model.score(vector)[0]
            yield batch.filter(pa.array(score < limit))

    return docs.mapInArrow(keep, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame, **bounds) -> DataFrame:
    """Per document: held_out, score, predicted (score 0.5 or more) and evidence.

    A null id is not held out. Repeated rows are scored alike. Without labels of both kinds no term is kept and
    all get the base rate; an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = scored(rows, fit(docs, labels, **bounds))
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")
