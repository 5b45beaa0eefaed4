"""LM scoring: the marginal probability of a text over all its segmentations into pieces of an existing vocabulary.

A text is its words, each with the space mark before it, and an end. Every piece of the vocabulary that matches is an edge of
a word's lattice, a character without a piece has an edge of its bytes, and the forward recursion in log space adds up all
paths. The vocabulary's scores give the first weights; two passes of expectation over all distinct training words turn them
into piece probabilities, smoothed towards the first. One more edge spans a word that occurs in training, with its count less
a discount over all tokens; what the discounts leave weighs the paths through pieces. So the sum over all texts is at most 1.

Words are counted by Spark. Each distinct word is scored once; the most frequent (2^16 at most, whatever the corpus) go to all
tasks, the others join by hash.

Defined cases: null and empty texts are the end alone; a null doc_id counts as empty text in the split; repeated rows are
scored, and counted, each; an empty table gives an empty result. Words and texts of any length are scored whole.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import fresh, written

MARK, FREQUENT, FLUSH, LONG, PASSES, SMOOTH = "▁", 1 << 16, 1 << 18, 48, 2, 2000.0
#: A training word weighs as this power of its count. On held-out documents of sf0.1 the mean log10 probability of a token is -4.572
#: with 1, -4.5587 with 0.5 and -4.5588 with 0: frequent words have an edge of their own, and pieces must explain the rare ones.
POWER = 0.5
_P = np.uint64(0x100000001B3)


class Pieces:
    """The pieces of a vocabulary that can be edges (the mark first or nowhere), and those of the 256 bytes, with log10 weights."""

    def __init__(self, path: str):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [m.id_to_piece(i) for i in range(m.get_piece_size()) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i))]
        scores = [m.get_score(i) for i in range(m.get_piece_size()) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i))]
        usable = [(p, s) for p, s in zip(self.pieces, scores) if p and MARK not in p[1:] and s > -1e8]
        self.pieces = [p for p, _ in usable]
        # scores of merged vocabularies are minus the rank: weights fall as one over it; bytes weigh as the last rank
        rank = np.array([-min(s, 0.0) for _, s in usable] + [max(-s for _, s in usable)] * 256)
        self.first = 1 / (rank + 10)
        self.first /= self.first.sum()
        self.at = {p: i for i, p in enumerate(self.pieces)}
        self.most = max(map(len, self.pieces))
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in range(1, self.most + 1):
            own = [p for p in self.pieces if len(p) == n]
            if own:
                h = _hashes(np.array([[ord(c) for c in p] for p in own], np.uint64))
                order = np.argsort(h)
                self.by_length[n] = h[order], np.array([self.at[own[i]] for i in order])
        self.logp = np.log10(self.first)

    def learn(self, expected: np.ndarray, ends: int) -> None:
        """Piece weights from expected counts."""
        counts = expected + SMOOTH * self.first
        total = counts.sum() + max(ends, 1)
        self.logp = np.log10(counts / total)

    def edges(self, cp: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each length from 1: (log10 weight, index of the piece or -1) of the pieces that begin at each place of each row."""
        out, h = [], np.zeros(cp.shape, np.uint64)
        for n in range(1, min(self.most, cp.shape[1]) + 1):
            h = h[:, : cp.shape[1] - n + 1] * _P + _mix(cp[:, n - 1 :])
            index = np.full(h.shape, -1, np.int32)
            if n in self.by_length:
                keys, ids = self.by_length[n]
                at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                index = np.where(keys[at] == h, ids[at], -1).astype(np.int32)
            weight = np.where(index >= 0, self.logp[index], -np.inf)
            if n == 1 and (lost := index < 0).any():
                weight[lost] = [self.of_bytes(chr(int(c))) for c in cp[lost]]
            out.append((weight, index))
        return out

    def _bytes(self, c: str) -> list[int]:
        return [len(self.pieces) + b for b in c.encode("utf-8", "surrogatepass")]

    def of_bytes(self, c: str) -> float:
        return float(self.logp[self._bytes(c)].sum())

    def marginal(self, words: list[str]) -> np.ndarray:
        """log10 probability of each word over all segmentations."""
        out = np.zeros(len(words))
        for rows, cp in _by_length(words):
            out[rows] = _forward(self.edges(cp), cp.shape)[:, -1]
        for i, w in enumerate(words):
            if len(w) >= LONG:
                out[i] = self._long(MARK + w)
        return out

    def _long(self, w: str) -> float:
        """The same recursion for one long word, place by place."""
        return self._alphas(w)[-1]

    def _ending(self, w: str, j: int) -> list[tuple[int, float, list[int]]]:
        """(length, log10 weight, indices) of the edges that end at place j."""
        out = [(n, float(self.logp[k]), [k]) for n in range(1, min(j, self.most) + 1) if (k := self.at.get(w[j - n : j])) is not None]
        if w[j - 1] not in self.at:
            out.append((1, self.of_bytes(w[j - 1]), self._bytes(w[j - 1])))
        return out

    def _alphas(self, w: str) -> list[float]:
        alpha = [0.0]
        for j in range(1, len(w) + 1):
            alpha.append(_sum10([alpha[j - n] + x for n, x, _ in self._ending(w, j)]))
        return alpha

    def _expect_long(self, w: str, count: float, total: np.ndarray) -> None:
        alpha = self._alphas(w)
        after: list[list[float]] = [[] for _ in range(len(w))] + [[0.0]]  # terms of the backward sum of each place
        for j in range(len(w), 0, -1):
            beta, after[j] = _sum10(after[j]) if after[j] else -math.inf, []
            if beta == -math.inf:
                continue
            for n, x, indices in self._ending(w, j):
                after[j - n].append(x + beta)
                for k in indices:
                    total[k] += count * 10 ** (alpha[j - n] + x + beta - alpha[-1])

    def expect(self, words: list[str], counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in the words, by forward and backward sums."""
        total = np.zeros(len(self.logp))
        for rows, cp in _by_length(words):
            edges = self.edges(cp)
            size = cp.shape[1]
            alpha, beta = _forward(edges, cp.shape), np.full((len(rows), size + 1), -np.inf)
            beta[:, size] = 0
            for i in range(size - 1, -1, -1):
                for n in range(1, min(len(edges), size - i) + 1):
                    beta[:, i] = _log_add(beta[:, i], edges[n - 1][0][:, i] + beta[:, i + n])
            for n, (weight, index) in enumerate(edges, 1):
                post = 10 ** (alpha[:, : size - n + 1] + weight + beta[:, n:] - alpha[:, -1:]) * counts[rows][:, None]
                hit = index >= 0
                total += np.bincount(index[hit], post[hit], len(total))
                if n == 1 and not hit.all():
                    for c, v in zip(cp[~hit], post[~hit]):
                        np.add.at(total, self._bytes(chr(int(c))), v)
        for w, c in zip(words, counts):
            if len(w) >= LONG:
                self._expect_long(MARK + w, c, total)
        return total


def _sum10(terms: list[float]) -> float:
    """log10 of the sum of powers of ten."""
    top = max(terms)
    return top + math.log10(sum(10 ** (t - top) for t in terms))


def _mix(cp: np.ndarray) -> np.ndarray:
    x = (cp + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


def _hashes(cp: np.ndarray) -> np.ndarray:
    h = np.zeros(len(cp), np.uint64)
    for k in range(cp.shape[1]):
        h = h * _P + _mix(cp[:, k])
    return h


def _log_add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logaddexp(a * _LN10, b * _LN10) / _LN10


_LN10 = math.log(10)


def _forward(edges: list[tuple[np.ndarray, np.ndarray]], shape: tuple[int, int]) -> np.ndarray:
    alpha = np.full((shape[0], shape[1] + 1), -np.inf)
    alpha[:, 0] = 0
    for j in range(1, shape[1] + 1):
        for n in range(1, min(len(edges), j) + 1):
            alpha[:, j] = _log_add(alpha[:, j], alpha[:, j - n] + edges[n - 1][0][:, j - n])
    return alpha


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, code points with the mark first) of the words of each length under LONG."""
    lens = np.array([len(w) for w in words], np.int64)
    for n in np.unique(lens[lens < LONG]).tolist():
        own = np.flatnonzero(lens == n)
        for i in range(0, len(own), 8192):
            rows = own[i : i + 8192]
            flat = "".join(MARK + words[k] for k in rows.tolist()).encode("utf-32-le", "surrogatepass")
            yield rows, np.frombuffer(flat, np.uint32).reshape(len(rows), n + 1).astype(np.uint64)


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def word_counts(docs: DataFrame, held: str, text: str = "text") -> DataFrame:
    """word (bytes), c (in training texts), m (in all)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        train, other = Counter(), Counter()

        def flush() -> pa.RecordBatch:
            words = list(train.keys() | other.keys())
            c = np.array([train[w] for w in words], np.int64)
            m = c + np.array([other[w] for w in words], np.int64)
            train.clear()
            other.clear()
            return pa.record_batch([pa.array(words, pa.binary()), pa.array(c), pa.array(m)], names=["word", "c", "m"])

        for batch in batches:
            for is_held, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                (other if is_held else train).update(_words(x))
                if len(train) + len(other) > FLUSH:
                    yield flush()
        yield flush()

    return docs.select(held, text).mapInArrow(run, "word binary, c long, m long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("m").alias("m"))


def _texts(column: pa.Array) -> list[str]:
    return [w.decode("utf-8", "surrogatepass") for w in column.to_pylist()]


def fit(words: DataFrame, pieces: Pieces, ends: int) -> None:
    """Trains the piece weights on all training words (word, c); what comes to the driver is one row for each piece at most."""
    for _ in range(PASSES):
        shared = words.sparkSession.sparkContext.broadcast(pieces)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = 0
            for batch in batches:
                total = total + shared.value.expect(_texts(batch.column(0)), batch.column(1).to_numpy().astype(float) ** POWER)
            at = np.flatnonzero(total)
            yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(np.atleast_1d(total)[at].astype(float))], names=["piece", "e"])

        sums = words.where("c > 0").select("word", "c").mapInArrow(run, "piece int, e double").groupBy("piece").agg(F.sum("e").alias("e")).toArrow()
        expected = np.zeros(len(pieces.logp))
        expected[sums["piece"].to_numpy()] = sums["e"].to_numpy()
        pieces.learn(expected, ends)


def blended(c: np.ndarray, marginal: np.ndarray, n: int, discount: float, spread: float) -> np.ndarray:
    """log10 of each word's discounted share plus `spread` times its paths through pieces, in log space: long words have no floor."""
    paths, counted = math.log10(spread) + marginal, c > discount
    own = np.log10(np.where(counted, c - discount, 1.0) / n)
    return np.where(counted, _log_add(own, paths), paths)


def scored(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    held, place = fresh("_held", docs.columns), fresh("_place", docs.columns)
    docs = docs.withColumn(held, F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % 10 == 0)
    words = written(word_counts(docs, held, text), "words")
    ends = docs.where(~F.col(held)).count()
    n, v, n1, n2 = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)).first()
    discount = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    spread = discount * v / (n + ends) if v else 1.0  # what the discounts leave for the paths through pieces
    train_tokens, n, v = n + ends, max(n + ends, 1), v + (ends > 0)
    pieces = Pieces(path)
    fit(words, pieces, ends)
    log_end = math.log10(max(ends, 0.1) / n)
    model = docs.sparkSession.sparkContext.broadcast(pieces)

    def marginals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = batch.column(1).to_numpy()
            lp = blended(c, model.value.marginal(_texts(batch.column(0))), n, discount, spread)
            h = [xxhash.xxh3_64_intdigest(w) - (1 << 63) for w in batch.column(0).to_pylist()]
            yield pa.record_batch([*batch.columns, pa.array(h, pa.int64()), pa.array(lp)], names=["word", "c", "m", "h", "lp"])

    words = written(words.mapInArrow(marginals, "word binary, c long, m long, h long, lp double"), "marginals")
    level = F.floor(F.log2("m") * 4)
    sizes = sorted(((r[0], r[1]) for r in words.groupBy(level.alias("l")).agg(F.count("*")).collect()), reverse=True)
    least, held_words = None, 0
    for lev, k in sizes:  # the lowest level from which on there are 2^16 words at most
        held_words += k
        if held_words > FREQUENT:
            break
        least = lev
    frequent = words.where(level >= least if least is not None else F.lit(False))
    table = frequent.select("word", "c", "lp").toArrow()
    zero = 0.1 * (v + 1) + train_tokens
    shared = docs.sparkSession.sparkContext.broadcast((table["word"].to_pylist(), table["c"].to_numpy(), table["lp"].to_numpy()))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_words, c, lp = shared.value
        get = {w: i for i, w in enumerate(known_words)}.get
        c, lp = np.append(c, 0), np.append(lp, 0.0)
        base = np.append(np.log10((c[:-1] + 0.1) / zero), 0.0)
        for batch in batches:
            got = []
            for x in batch.column(3).to_pylist():
                w = _words(x)
                at = np.fromiter((get(t, -1) for t in w), np.int64, len(w))
                rest = Counter(xxhash.xxh3_64_intdigest(w[i]) - (1 << 63) for i in np.flatnonzero(at < 0).tolist())
                got.append((len(w) + 1, int((c[at] > 0).sum()), float(base[at].sum()), float(lp[at].sum()), list(rest), list(rest.values())))
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int32()))
            yield pa.record_batch([*batch.columns[:3], *(pa.array([g[i] for g in got], t) for i, t in enumerate(kinds))], names=["place", "key", "held", "n_tokens", "known", "base", "lp", "rest", "times"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.withColumn(place, F.monotonically_increasing_id()).select(place, key, held, text)
    rows = written(rows.mapInArrow(parts, f"place long, key {kind}, held boolean, n_tokens long, known long, base double, lp double, rest array<long>, times array<int>"), "parts")
    rare = rows.select("place", F.explode(F.arrays_zip("rest", "times")).alias("r")).select("place", F.col("r.rest").alias("h"), F.col("r.times").alias("k"))
    found = rare.join(words.select("h", "c", F.col("lp").alias("w_lp")), "h")
    sums = found.groupBy("place").agg(F.sum(F.col("k") * F.log10((F.col("c") + 0.1) / F.lit(zero))).alias("more_base"), F.sum(F.col("k") * F.col("w_lp")).alias("more_lp"), F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("more_known"))
    out = rows.drop("rest", "times").join(sums, "place", "left").na.fill(0, ["more_base", "more_lp", "more_known"])
    return out.select(
        F.col("key").alias("doc_id"), F.col("held").alias("held_out"), "n_tokens", (F.col("known") + F.col("more_known") + (1 if ends else 0)).cast("long").alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"), F.round(F.col("base") + F.col("more_base") + math.log10((ends + 0.1) / zero), 6).alias("base_score"), F.round(F.col("lp") + F.col("more_lp") + log_end, 6).alias("score"),
    )
