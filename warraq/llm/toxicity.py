"""Toxicity by the nearest labelled examples under exact TF-IDF cosine."""

from __future__ import annotations

import re
import uuid
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import engine, held_out, written

#: Bound of the sample: labelled documents of each label that are indexed.
SAMPLED = 6144
#: Terms kept: all that are so far from chance (chi-square) at least, and so much more frequent in label 1.
LEAST_CHI, LEAST_LIFT = 6.0, 3.0
#: Neighbours that vote, evidence returned.
NEIGHBOURS, EVIDENCE = 24, 3
#: Texts that are scored together, and of these such that are multiplied at once; they bound memory only.
TOGETHER, AT_ONCE = 256, 64
#: A term that more than this share of the examples has is common.
COMMON = 0.06
PREFIXES = range(3, 8)
WORD = re.compile(r"[^\W\d_]+")
TOKEN = re.compile(r"\w+")
#: The term that is counted at each word; every example with words has it.
ANY = 0
#: The number of a word that no example has; it lengthens a vector and meets nothing.
UNSEEN = -1


#: A word's number: words are told apart by 64 bits.
hashed = xxhash.xxh3_64_intdigest


def features(text: str) -> set[str]:
    """Words of a text, and starts of longer words marked by a star."""
    words = set(WORD.findall(text.lower()))
    return words | {w[:k] + "*" for w in words for k in PREFIXES if len(w) > k}


class Terms:
    """Counts the vocabulary's terms in a text: whole words, or starts of words."""

    def __init__(self, terms: list[str]) -> None:
        import ahocorasick

        self.machine = ahocorasick.Automaton()
        by: dict[str, list] = {}
        for k, t in enumerate(terms, start=1):
            by.setdefault(t.removesuffix("*"), []).append((k, t.endswith("*")))
        for s, found in by.items():
            self.machine.add_word(s, (len(s), found))
        self.empty = not by
        if by:
            self.machine.make_automaton()

    def count(self, low: str, words: Counter) -> dict[int, int]:
        out = Counter({ANY: words.total()} if words else {})
        end_of = len(low)
        hits = () if self.empty else self.machine.iter(low)
        for end, (size, found) in hits:
            if end - size >= 0 and low[end - size].isalpha():
                continue
            whole = end + 1 == end_of or not low[end + 1].isalpha()
            for k, prefix in found:
                if prefix != whole:  # a start is of a longer word
                    out[k] += 1
        return out


def _spans(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All numbers from each start to before its end, one span after another."""
    size = end - start
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())


def _best(n: np.ndarray, cosines: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest cosines over 0, from the largest down, equal ones by number."""
    if len(n) > 4 * k:
        ok = np.flatnonzero((cosines >= np.partition(cosines, -k)[-k]) & (cosines > 0))
    else:
        ok = np.flatnonzero(cosines > 0)
    best = ok[np.lexsort((n[ok], -cosines[ok]))[:k]]
    return n[best], cosines[best]


def _reached(sums: np.ndarray, k: int) -> float:
    """What ``k`` of the sums reach at least: the k-th largest of all, or of the largest ones of many groups."""
    if len(sums) > 64 * k:
        sums = sums[: len(sums) // 16 * 16].reshape(16, -1).max(axis=0)
    return np.partition(sums, len(sums) - k)[len(sums) - k] if len(sums) > k else 0.0


class Index:
    """Inverted index over unit TF-IDF vectors of the examples, with its common terms as a table.

    Postings of a rare term are added up for the examples that have it. The
    parts of common terms (more than ``COMMON`` of the examples have one) are
    one product in single precision for many queries at once, whose error has
    a bound (``slack``). Only examples that reach the worst of the ``k``
    largest sums, less that error on both sides, can be neighbours; their
    common part is added exactly, so the neighbours are exact.
    Equal cosines go to the smaller example number, which the label has no
    part in. Terms from ``words_from`` on are the words: within a vector they
    keep their TF-IDF proportions, and together they are as long as the term
    ANY. So a few telling terms aren't lost in a long text, and no two
    different texts are as close as copies.
    """

    def __init__(self, vectors: list, labels: list[int], weights: list[float], keys: list, n_terms: int, words_from: int | None = None) -> None:
        total, self.words_from = len(vectors), n_terms if words_from is None else words_from
        df = np.zeros(n_terms, np.int64)
        for v in vectors:
            df[list(v) if isinstance(v, dict) else v[0]] += 1
        self.idf = np.append(np.log1p(total / (1 + df)), np.log1p(total))  # the last is of UNSEEN
        unit = [self.unit(v) for v in vectors]
        single = [self._singles(v) for v in vectors]
        often = df > COMMON * total

        def alike(k: int) -> tuple:
            """Examples with the same heaviest common terms stand together."""
            t, w = unit[k]
            mine = np.flatnonzero(often[t] & (t != ANY))
            return (*t[mine[np.argsort(-w[mine], kind="stable")[:4]]].tolist(), k)

        order = sorted(range(total), key=alike)
        self.labels = np.array([labels[k] for k in order], float)
        self.weights = np.array([weights[k] for k in order], float)
        self.keys, self.order = [keys[k] for k in order], order
        sizes = [len(unit[k][0]) for k in order]
        t = np.concatenate([unit[k][0] for k in order], dtype=np.int32, casting="unsafe") if total else np.empty(0, np.int32)
        w = np.concatenate([unit[k][1] for k in order]) if total else np.empty(0)
        del unit
        n = np.repeat(np.arange(total, dtype=np.int32), sizes)
        self.common = np.where(often, np.cumsum(often) - 1, -1).astype(np.int32)
        here = often[t]
        # common terms by example
        self.own_term, self.own_value = self.common[t[here]], w[here]
        self.own = np.searchsorted(n[here], np.arange(total + 1))
        self.width = int(often.sum())
        # vectors are of length 1 at most, so this bounds the error of a product's sum and of its rounded factors
        self.slack = (self.width + 4) * 2.0**-24
        self.dense = None
        # rare terms by term. A word that stands once in its text weighs its idf times a factor of the text, so such postings need no weight
        once = np.concatenate([single[k] for k in order]) & ~here if total else np.empty(0, bool)
        self.factor = np.zeros(total)
        self.factor[n[once]] = w[once] / self.idf[t[once]]
        by_term = np.flatnonzero(once)[np.argsort(t[once], kind="stable")]
        self.once, self.once_posts = n[by_term], np.searchsorted(t[by_term], np.arange(n_terms + 1))
        rest = np.flatnonzero(~once & ~here)
        by_term = rest[np.argsort(t[rest], kind="stable")]
        self.example, self.value = n[by_term], w[by_term]
        self.posts = np.searchsorted(t[by_term], np.arange(n_terms + 1))

    def _singles(self, vector) -> np.ndarray:
        """Which terms of a vector, in the order of ``unit``, are words that stand once."""
        t, counts = (np.array(sorted(vector), np.int64), np.array([vector[k] for k in sorted(vector)])) if isinstance(vector, dict) else vector
        return ((t >= self.words_from) & (counts == 1))[t != UNSEEN]

    def rows(self) -> np.ndarray:
        """The common terms' weights in single precision, an example in a row; made where the index is used."""
        if self.dense is None:
            self.dense = np.zeros((len(self.labels), self.width), np.float32)
            self.dense[np.repeat(np.arange(len(self.labels)), np.diff(self.own)), self.own_term] = self.own_value
        return self.dense

    def __getstate__(self) -> dict:
        return self.__dict__ | {"dense": None}

    def unit(self, vector) -> tuple[np.ndarray, np.ndarray]:
        """Terms and weights of a vector, given as a dictionary of counts or as terms and counts; without the unseen words."""
        if isinstance(vector, dict):
            vector = np.array(sorted(vector), np.int64), np.array([vector[k] for k in sorted(vector)], float)
        t, counts = vector
        w = (1 + np.log(counts)) * self.idf[t]
        word = (t >= self.words_from) | (t == UNSEEN)
        if word.any():
            w[word] *= (1 + np.log(counts[word].sum())) * self.idf[ANY] / np.sqrt((w[word] ** 2).sum())
        norm = np.sqrt((w * w).sum())
        seen = t != UNSEEN
        return t[seen], w[seen] / norm if norm else w[seen]

    def nearest(self, vector, k: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and cosines of the nearest examples; none for an empty vector."""
        return self.nearest_to(*self.unit(vector), k)

    def nearest_to(self, t: np.ndarray, w: np.ndarray, k: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray]:
        return self.nearest_to_each([(t, w)], k)[0]

    def nearest_to_each(self, units: list, k: int = NEIGHBOURS) -> list[tuple[np.ndarray, np.ndarray]]:
        """What ``nearest`` gives, for many vectors that ``unit`` made."""
        out = []
        for first in range(0, len(units), AT_ONCE):
            lot = units[first : first + AT_ONCE]
            places = [self.common[t] for t, _ in lot]
            query = np.zeros((len(lot), self.width))
            for row, at, (_, w) in zip(query, places, lot, strict=True):
                row[at[at >= 0]] = w[at >= 0]
            near = query.astype(np.float32) @ self.rows().T
            out += [self._nearest(t[at < 0], w[at < 0], row, about, k) for (t, w), at, row, about in zip(lot, places, query, near, strict=True)]
        return out

    def _rare(self, t: np.ndarray, w: np.ndarray) -> np.ndarray:
        """What rare terms add to each example."""
        total = len(self.labels)
        start, end = self.posts[t], self.posts[t + 1]
        post = _spans(start, end)
        part = np.bincount(self.example[post], np.repeat(w, end - start) * self.value[post], total)
        start, end = self.once_posts[t], self.once_posts[t + 1]
        if (end > start).any():
            found = self.once.take(_spans(start, end))
            part = part + self.factor * np.bincount(found, np.repeat(w * self.idf[t], end - start), total)
        return part

    def _nearest(self, t: np.ndarray, w: np.ndarray, query: np.ndarray, about: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The nearest by rare terms, the weights of the common ones and about what those add to each example."""
        total = len(self.labels)
        if not total or not len(t) and not query.any():
            return np.empty(0, np.int64), np.empty(0)
        part = self._rare(t, w)
        sums = part + about
        now = np.flatnonzero(sums >= _reached(sums, k) - 2 * self.slack)
        start, end = self.own[now], self.own[now + 1]
        post = _spans(start, end)
        exact = part[now] + np.bincount(np.repeat(np.arange(len(now)), end - start), query[self.own_term[post]] * self.own_value[post], len(now))
        return _best(now, np.round(exact, 12), k)

    def examples(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each example's vector begins, and the terms and weights of all, example by example."""
        numbers = np.arange(len(self.posts) - 1, dtype=np.int32)
        term, single = np.repeat(numbers, np.diff(self.posts)), np.repeat(numbers, np.diff(self.once_posts))
        name = np.flatnonzero(self.common >= 0).astype(np.int32)
        n = np.concatenate([self.example, self.once.astype(np.int32), np.repeat(np.arange(len(self.labels), dtype=np.int32), np.diff(self.own))])
        order = np.argsort(n, kind="stable")
        values = np.concatenate([self.value, self.factor[self.once] * self.idf[single], self.own_value])
        return np.searchsorted(n[order], np.arange(len(self.labels) + 1)), np.concatenate([term, single, name[self.own_term]])[order], values[order]

    def vote(self, n: np.ndarray, cosines: np.ndarray) -> float:
        """The share of label 1 among neighbours, weighted by closeness and by how many documents an example stands for; -1 without neighbours."""
        if not len(n):
            return -1.0
        w = self.weights[n] / (1.02 - np.minimum(cosines, 1.0))
        return float((w * self.labels[n]).sum() / w.sum())


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising steps of least squares: the votes where steps begin, and the levels."""
    steps: list[list[float]] = []
    for v in np.unique(x).tolist():
        at = x == v
        steps.append([v, float((w[at] * y[at]).sum()), float(w[at].sum())])
        while len(steps) > 1 and steps[-2][1] * steps[-1][2] >= steps[-1][1] * steps[-2][2]:
            _, a, b = steps.pop()
            steps[-1][1] += a
            steps[-1][2] += b
    return np.array([s[0] for s in steps]), np.array([s[1] / s[2] for s in steps])


class Model:
    """Terms, words and the index; built once, by the driver. A worker gets the finished index."""

    def __init__(self, learned: dict) -> None:
        self.names, self.words = learned["terms"], learned["words"]
        self.__setstate__({})
        rows, totals = learned["rows"], learned["totals"]
        sampled = Counter(r[1] for r in rows)
        self.prior = (totals.get(1, 0) + 0.5) / (sum(totals.values()) + 1)
        share = [totals[r[1]] / sampled[r[1]] for r in rows]
        self.index = Index([r[2] for r in rows], [r[1] for r in rows], share, [r[0] for r in rows], 1 + len(self.names) + len(self.words), 1 + len(self.names))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("terms", "known")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self.terms, self.known = Terms(self.names), {}

    def vectors(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Terms and counts of each text; equal ones are in one order, so they are summed alike."""
        low = [t.lower() for t in texts]
        words = [Counter(TOKEN.findall(t)) for t in low]
        sizes = [len(w) for w in words]
        hashes = np.fromiter(map(hashed, chain.from_iterable(words)), np.uint64, sum(sizes))
        counts = np.fromiter(chain.from_iterable(w.values() for w in words), float, len(hashes))
        order = np.argsort(hashes)  # sorted keys are found faster
        hashes = hashes[order]
        at = np.searchsorted(self.words, hashes)
        known = self.words.take(at, mode="clip") == hashes if len(self.words) else np.zeros(len(hashes), bool)
        by_text = np.argsort(np.repeat(np.arange(len(texts), dtype=np.uint32), sizes)[order], kind="stable")
        numbers, counts = np.where(known, at + (1 + len(self.names)), UNSEEN)[by_text], counts[order[by_text]]
        out = []
        for t, w, end in zip(low, words, np.cumsum(sizes).tolist(), strict=True):
            terms, own = sorted(self.terms.count(t, w).items()), slice(end - len(w), end)
            out.append((np.concatenate([np.array([k for k, _ in terms], np.int64), numbers[own]]), np.concatenate([np.array([n for _, n in terms], float), counts[own]])))
        return out

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        return self.vectors([text])[0]

    def scores(self, texts: list[str], at: np.ndarray, level: np.ndarray) -> list[tuple[float, list]]:
        """Score and evidence of each text. All are cut into words before any is searched for, as each half keeps the processor's caches full."""
        keys = [xxhash.xxh3_128_digest(t.encode()) for t in texts]
        if len(self.known) > 8_000:
            self.known.clear()
        fresh = {k: t for k, t in zip(keys, texts, strict=True) if k not in self.known}
        units = [self.index.unit(v) for v in self.vectors(list(fresh.values()))]
        for key, (n, cos) in zip(fresh, self.index.nearest_to_each(units), strict=True):
            vote = self.index.vote(n, cos)
            if vote < 0:
                score = self.prior
            elif len(at):
                # the level of the vote's step, and a little of the vote, which keeps the order within a step
                score = 0.98 * float(level[max(0, int(np.searchsorted(at, vote, side="right")) - 1)]) + 0.02 * vote
            else:
                score = vote
            evidence = [{"doc_id": self.index.keys[a], "cosine": float(c), "toxic": int(self.index.labels[a])} for a, c in zip(n[:EVIDENCE].tolist(), cos[:EVIDENCE].tolist(), strict=True)]
            self.known[key] = (min(1.0, max(0.0, score)), evidence)
        return [self.known[k] for k in keys]


def _calibrated(spark, model: Model, shared) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic steps over the examples' votes, each found by the others; tasks score stretches of the examples."""
    total = len(model.index.labels)
    if not total:
        return np.empty(0), np.empty(0)

    def votes(batches):
        index = shared.value.index
        start, terms, weights = index.examples()
        for b in batches:
            out, numbers = [], b.column("id").to_pylist()
            units = [(terms[start[k] : start[k + 1]], weights[start[k] : start[k + 1]]) for k in numbers]
            for k, (n, cos) in zip(numbers, index.nearest_to_each(units, NEIGHBOURS + 1), strict=True):
                out.append(index.vote(n[n != k][:NEIGHBOURS], cos[n != k][:NEIGHBOURS]))
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(out, pa.float64())], names=["id", "vote"])

    found = spark.range(0, total, 1, max(1, min(spark.sparkContext.defaultParallelism, total // 256))).mapInArrow(votes, "id bigint, vote double").toArrow().sort_by("id")
    votes_ = found.column("vote").to_numpy()
    at = votes_ >= 0
    return isotonic(votes_[at], model.index.labels[at], model.index.weights[at]) if at.any() else (np.empty(0), np.empty(0))


def learn(docs: DataFrame, labels: DataFrame) -> dict:
    """What a model needs, from a bounded sample of labelled documents that aren't held out.

    Needs doc_id, text of ``docs`` and doc_id, toxic of ``labels``. A null
    toxic labels nothing; of several labels of a document the largest counts.
    Of each label the ``SAMPLED`` documents with the smallest hashes of their
    doc_id are indexed; they also calibrate, each scored by the others. Terms
    are words and starts of words that the rows of label 1 have markedly more
    often; the vectors hold these and all words. Only this sample's ids and the
    hashes and counts of its words reach the driver.
    """
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic")).where(~held_out())
    totals = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    picked = None
    for y in (0, 1):
        part = known.where(F.col("toxic") == y).select("doc_id", "toxic", F.xxhash64(F.lit("sample"), "doc_id").alias("h")).orderBy("h", "doc_id").limit(SAMPLED)
        picked = part if picked is None else picked.unionByName(part)
    picked = picked.select("doc_id", "toxic")
    rows = written(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").where("text is not null"), "toxic-sample")
    counted = rows.mapInArrow(_feature_counts, "feature string, toxic int, n bigint")
    n1, n0 = (F.sum(F.when(F.col("toxic") == y, F.col("n")).otherwise(0)) for y in (1, 0))
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    a1, a0 = float(sizes.get(1, 0)), float(sizes.get(0, 0))
    terms: list[str] = []
    if a1 and a0:
        both = counted.groupBy("feature").agg(n1.alias("n1"), n0.alias("n0"))
        det = F.col("n1") * (a0 - F.col("n0")) - F.col("n0") * (a1 - F.col("n1"))
        chi = (a1 + a0) * det * det / ((F.col("n1") + F.col("n0")) * (a1 + a0 - F.col("n1") - F.col("n0") + 1e-9) * a1 * a0)
        lift = ((F.col("n1") + 0.5) / a1) / ((F.col("n0") + 0.5) / a0)
        good = both.select("feature", chi.alias("chi"), lift.alias("lift")).where((F.col("chi") >= LEAST_CHI) & (F.col("lift") >= LEAST_LIFT))
        terms = [r["feature"] for r in good.orderBy(F.desc("chi"), "feature").select("feature").collect()]
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(terms)
    vectors = rows.mapInArrow(lambda batches: _vectors(batches, shared), "doc_id bigint, toxic int, terms array<int>, counts array<int>, words array<bigint>, word_counts array<int>, text_hash bigint").toArrow()
    vectors = vectors.sort_by([("doc_id", "ascending"), ("text_hash", "ascending")]).combine_chunks()
    doc_ids, toxic = vectors.column("doc_id").to_pylist(), vectors.column("toxic").to_pylist()
    lists = {n: _flat(vectors.column(n)) for n in ("terms", "counts", "words", "word_counts")}
    del vectors  # the driver's memory is the tightest
    hashes = lists["words"][1].to_numpy().view(np.uint64)
    words = np.unique(hashes)
    numbers = np.empty(len(hashes), np.int32)
    for at in range(0, len(hashes), 1 << 18):
        numbers[at : at + (1 << 18)] = np.searchsorted(words, hashes[at : at + (1 << 18)]) + 1 + len(terms)
    del hashes
    lists["words"] = (lists["words"][0], None)
    term, count, word_count = (lists[n][1].to_numpy() for n in ("terms", "counts", "word_counts"))
    picks = []
    for k in range(len(doc_ids)):
        t, w = (slice(*lists[n][0][k : k + 2]) for n in ("terms", "words"))
        own = np.lexsort((word_count[w], numbers[w]))
        picks.append((np.concatenate([term[t], numbers[w][own]]), np.concatenate([count[t], word_count[w][own]])))
    del lists, term, count, word_count, numbers
    pa.default_memory_pool().release_unused()
    return {"terms": terms, "words": words, "totals": totals, "rows": list(zip(doc_ids, toxic, picks, strict=True))}


def _flat(lists) -> tuple[np.ndarray, pa.Array]:
    """Where each list starts, and the values of all in one array."""
    parts = lists.chunks if isinstance(lists, pa.ChunkedArray) else [lists]
    values = pa.concat_arrays([p.flatten() for p in parts]) if parts else pa.array([], lists.type.value_type)
    return np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())]).astype(np.int64), values


def _feature_counts(batches):
    for b in batches:
        counts: Counter = Counter()
        for text, y in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
            counts.update((f, y) for f in features(text))
        yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in counts], pa.string()), pa.array([y for _, y in counts], pa.int32()), pa.array(list(counts.values()), pa.int64())], names=["feature", "toxic", "n"])


def _vectors(batches, shared):
    terms = Terms(shared.value)
    for b in batches:
        low = [t.lower() for t in b.column("text").to_pylist()]
        words = [Counter(TOKEN.findall(t)) for t in low]
        found = [sorted(terms.count(t, w).items()) for t, w in zip(low, words, strict=True)]
        ints, longs = pa.list_(pa.int32()), pa.list_(pa.int64())
        hashes = [np.fromiter(map(hashed, v), np.uint64, len(v)).view(np.int64) for v in words]
        texts = np.array([hashed(t) for t in low], np.uint64).view(np.int64)
        columns = [b.column("doc_id"), b.column("toxic"), pa.array([[k for k, _ in v] for v in found], ints), pa.array([[n for _, n in v] for v in found], ints), pa.array(hashes, longs), pa.array([list(v.values()) for v in words], ints), pa.array(texts, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "toxic", "terms", "counts", "words", "word_counts", "text_hash"])


def scored(docs: DataFrame, text: Column, learned: dict) -> Column:
    """A struct (score, evidence) for each whole text.

    ``score`` is the calibrated share of label 1 among the nearest examples;
    ``evidence`` names the nearest with cosine and label. A null text, or one
    without words, has no neighbours: its score is the share of label 1 among
    all labelled documents. Without labels every score is that prior, 0.5.
    """
    spark, model, name = docs.sparkSession, Model(learned), uuid.uuid4().hex
    shared = spark.sparkContext.broadcast(model)
    at, level = _calibrated(spark, model, shared)
    proof = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())]))

    @F.arrow_udf("score double, evidence array<struct<doc_id:bigint,cosine:double,toxic:int>>")
    def score(texts: pa.Array) -> pa.Array:
        model, out = engine(("toxicity", name), lambda: shared.value), []
        for first in range(0, len(texts), TOGETHER):
            out += model.scores([t or "" for t in texts[first : first + TOGETHER].to_pylist()], at, level)
        return pa.StructArray.from_arrays([pa.array([s for s, _ in out], pa.float64()), pa.array([e for _, e in out], proof)], names=["score", "evidence"])

    return score.asNondeterministic()(text)
