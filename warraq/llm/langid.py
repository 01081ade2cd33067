"""Language identification by cross-parsing against a suffix automaton per language."""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import engine, held_out, written

#: Bounds of the training sample for each language: documents, and characters of them all. A document longer than ``SHORT_CHARS`` is learned from only where a language has too few others.
SAMPLE_DOCS, SAMPLE_CHARS, SHORT_CHARS = 48, 24_000, 4_000
#: Stretches of this many symbols run in step, so that the stretches of many texts share each step. The parse goes on over their ends, so the length is no limit on a phrase.
STRETCH = 512


class Automaton:
    """The suffix automaton of a text, as one dense table: state and symbol to state, 0 where there is none.

    State 1 is the start; state 0, left by nothing, ends a phrase. Following a text from the start visits states as
    long as what was read since occurs in the learned text: the longest match.
    """

    def __init__(self, codes: np.ndarray, symbols: int) -> None:
        follow: list[dict[int, int]] = [{}, {}]
        link, length, last = [0, 0], [0, 0], 1
        for c in codes.tolist():
            new = len(follow)
            follow.append({})
            length.append(length[last] + 1)
            link.append(1)
            p = last
            while p and c not in follow[p]:
                follow[p][c] = new
                p = link[p]
            if p:
                q = follow[p][c]
                if length[p] + 1 == length[q]:
                    link[new] = q
                else:
                    copy = len(follow)
                    follow.append(dict(follow[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p and follow[p].get(c) == q:
                        follow[p][c] = copy
                        p = link[p]
                    link[q] = link[new] = copy
            last = new
        self.table = np.zeros((len(follow), symbols), np.int32)
        for s, edges in enumerate(follow):
            if edges:
                self.table[s, list(edges)] = list(edges.values())
        self.learned = len(codes)

    def phrases(self, codes: np.ndarray, lengths: np.ndarray, chains: list[list[int]]) -> list[int]:
        """Phrases of whole texts. Columns of ``codes`` (symbol by stretch, from long to short) are stretches; ``chains`` has each text's in order.

        A phrase is the longest match from where the last one ended; a symbol
        that the automaton never saw is a phrase of its own. All stretches are
        first parsed in step, each as if a phrase began with it. A text's
        parse then goes on from one stretch into the next until it begins a
        phrase where that one's own parse did: from there both are one.
        """
        flat, n = self.table.reshape(-1), self.table.shape[1]
        state = np.zeros(codes.shape[1], np.int32)
        begins = np.zeros(codes.shape, bool)
        alive = len(lengths) - np.searchsorted(lengths[::-1], np.arange(codes.shape[0]), side="right")
        for at in range(codes.shape[0]):
            k = int(alive[at])
            row = codes[at, :k]
            to = flat.take(state[:k] * n + row)
            lost = np.flatnonzero(to == 0)
            if len(lost):
                begins[at, lost] = True
                to[lost] = flat.take(n + row[lost])
            state[:k] = to
        count = begins.sum(axis=0)
        out = []
        for chain in chains:
            total, carried = 0, None
            for column in chain:
                if carried is None:
                    total, carried = int(count[column]), int(state[column])
                    continue
                more, carried = self._joined(carried, codes[:, column], begins[:, column], int(lengths[column]), int(count[column]), int(state[column]))
                total += more
            out.append(total)
        return out

    def _joined(self, state: int, codes: np.ndarray, begins: np.ndarray, length: int, count: int, last: int) -> tuple[int, int]:
        """Phrases that begin in a stretch entered in ``state``, and the state at its end."""
        table, found, passed = self.table, 0, 0
        for low in range(0, length, 64):
            for code, begun in zip(codes[low : min(length, low + 64)].tolist(), begins[low : low + 64].tolist(), strict=False):
                passed += begun
                to = int(table[state, code])
                if not to:
                    found += 1
                    if begun:
                        return found + count - passed, last
                    to = int(table[1, code])
                state = to
        return found, state


class Model:
    """Automata by language, over the UTF-8 bytes of letters in lower case and a space for all else: no script lacks symbols.

    Each automaton has its own alphabet: the bytes of its sample, and one
    symbol for all others. Memory grows with the languages, by at most
    ``SAMPLE_CHARS`` characters each.
    """

    def __init__(self, samples: dict[str, str]) -> None:
        self.names = sorted(samples)
        self.codes, self.automata = [], []
        for name in self.names:
            learned = np.frombuffer(spelt(samples[name])[: 4 * SAMPLE_CHARS], np.uint8)
            own = np.unique(learned)
            code = np.zeros(256, np.uint8)
            code[own] = np.arange(1, len(own) + 1)
            self.codes.append(code)
            self.automata.append(Automaton(code[learned], len(own) + 1))

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bits per symbol by text and language, and the symbols of each text."""
        coded = [np.frombuffer(spelt(t), np.uint8) for t in texts]
        size = np.array([len(c) for c in coded])
        owner = np.repeat(np.arange(len(coded)), -(-size // STRETCH))
        starts = np.concatenate([np.arange(0, s, STRETCH) for s in size]) if len(size) else np.empty(0, int)
        lengths = np.minimum(STRETCH, size[owner] - starts)
        order = np.argsort(-lengths, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        chains: list[list[int]] = [[] for _ in texts]
        for o, p in zip(owner.tolist(), place.tolist(), strict=True):
            chains[o].append(p)
        owner, starts, lengths = owner[order], starts[order], lengths[order]
        matrix = np.zeros((int(lengths.max(initial=0)), len(lengths)), np.uint8)
        for k, (o, s, n) in enumerate(zip(owner.tolist(), starts.tolist(), lengths.tolist(), strict=True)):
            matrix[:n, k] = coded[o][s : s + n]
        out = np.zeros((len(texts), len(self.names)))
        for k, (code, a) in enumerate(zip(self.codes, self.automata, strict=True)):
            found = np.array(a.phrases(code[matrix], lengths, chains), float)
            # a phrase is told by where in the learned text it stands
            out[:, k] = found * np.log2(max(2, a.learned)) / np.maximum(1, size)
        return out, size


#: Runs of what is no letter; marks that stand with letters stay.
APART = re.compile(r"(?:[^\w\u0300-\u036f\u0591-\u05c7\u064b-\u065f\u0900-\u0dff\u0e31-\u0e4e]|[\d_])+")


def spelt(text: str) -> bytes:
    """The letters of a text in lower case, with one space for each run of anything else."""
    return APART.sub(" ", text.lower()).encode()


def samples(docs: DataFrame) -> dict[str, str]:
    """Labelled text by language, of bounded size, from documents that aren't held out.

    Needs doc_id, text, lang; rows with a null lang or a text without letters
    teach nothing. Every language is learned, from at most ``SAMPLE_DOCS``
    whole documents and ``SAMPLE_CHARS`` characters: those with the smallest
    hashes of their doc_id, documents over ``SHORT_CHARS`` characters behind
    all others, until the characters are reached; the last document gives as
    many as are left. Rows are ranked without their texts, and each task keeps
    only its first of each language, so no language's rows meet in one task.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()).where(F.col("text").rlike(r"\p{L}"))
    known = known.select("lang", "text", F.xxhash64("doc_id").alias("h"), F.xxhash64("doc_id", "text").alias("key"))
    narrow = known.select("lang", "h", "key", F.length("text").cast("bigint").alias("n"), (F.length("text") > SHORT_CHARS).alias("long"))
    rank = Window.partitionBy("lang").orderBy("long", "h", "key")
    before = F.coalesce(F.sum("n").over(rank.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = narrow.withColumn("r", F.row_number().over(rank)).where(F.col("r") <= SAMPLE_DOCS)
    chosen = written(first.withColumn("before", before).where(F.col("before") < SAMPLE_CHARS).select("lang", "key", "r", "before"), "language-sample")
    rows = known.join(chosen, ["lang", "key"]).select("lang", "r", F.expr(f"substring(text, 1, cast({SAMPLE_CHARS} - before as int))").alias("text")).dropDuplicates(["lang", "r"]).collect()
    out: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["r"])):
        out.setdefault(r["lang"], []).append(r["text"])
    return {k: " ".join(v) for k, v in out.items()}


def identified(docs: DataFrame, text: Column, learned: dict[str, str]) -> Column:
    """A struct (lang_pred, score) for each whole text.

    ``lang_pred`` is the language with the fewest phrases, each weighed by
    the bits that tell it, per symbol; equal ones go to the first by name.
    It is ``und`` with score 0 if the text is null or has no letter, or if
    nothing was learned. ``score`` is the winner's share of exp(-bits of the
    whole text / 8), a number from 0 to 1.
    """
    kind = [pa.field("lang_pred", pa.string()), pa.field("score", pa.float64())]
    shared, name = docs.sparkSession.sparkContext.broadcast(learned), uuid.uuid4().hex

    @F.arrow_udf("lang_pred string, score double")
    def identify(texts: pa.Array) -> pa.Array:
        names, scores = [], []
        model = engine(("languages", name), lambda: Model(shared.value)) if shared.value else None
        for at in range(0, len(texts), 1024):
            for lot in _by_size(texts[at : at + 1024].to_pylist()):
                if model is None:
                    names += ["und"] * len(lot)
                    scores += [0.0] * len(lot)
                    continue
                bits, size = model.entropies(lot)
                letters = np.array([any(map(str.isalpha, t)) for t in lot])
                gap = (bits - bits.min(axis=1, keepdims=True)) * size[:, None] / 8
                share = 1 / np.exp(-np.minimum(gap, 700)).sum(axis=1)
                best = bits.argmin(axis=1)
                names += [model.names[b] if ok else "und" for b, ok in zip(best.tolist(), letters.tolist(), strict=True)]
                scores += np.where(letters, share, 0.0).tolist()
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], fields=kind)

    return identify.asNondeterministic()(text)


def _by_size(texts: list[str | None], most: int = 4_000_000):
    """Lots of texts, in order, of a bounded number of characters unless one text alone has more."""
    lot, held = [], 0
    for t in texts:
        t = t or ""
        if lot and held + len(t) > most:
            yield lot
            lot, held = [], 0
        lot.append(t)
        held += len(t)
    if lot:
        yield lot
