"""Quality rules: perplexity under modified Kneser-Ney models of 4-grams, one for each language, with bands by language.

The units are UTF-16 code units of the text in lower case, so every character of every script is kept apart, four of them
fill 64 bits, and an n-gram's number is the n-gram itself. Digits read as 0, white space and flagged symbols once a run.

Spark counts the 4-grams of all documents by language, and from them the lower orders (distinct units before), the totals
of the contexts and the counts of counts for the discounts, and joins them to the probability of every 4-gram (`probabilities`).
Workers hold the MODEL most frequent ones, 12 bytes each. The others come by a join: each document hands on those of its 4-grams that
its worker lacks, so its perplexity is over all of them, whatever MODEL is. `KneserNey` is a model of bounded size for texts that
were not counted; the rules don't use it.

Defined cases: a null or empty text has no words, fails the base rules and is rejected; a null language is a group of
its own; a language whose documents all fail the base rules has no band and rejects nothing more; an empty table gives
an empty result; repeated rows count as often as they occur in the model, and once in the bands of a language. Long texts are
read in slices, without a cap. Near copies are different texts: a group of them that fills a language still narrows its band.
Columns of the input that have the names of new ones stay; the new ones get a trailing underscore.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from marketlens.llm.common import fresh, written

ORDER, SLICE = 4, 1 << 18
#: 4-grams that a worker holds, over all languages; distinct 4-grams that a task holds before it hands them on.
MODEL, HELD = 1 << 20, 1 << 19
SPACES = "\t\n\x0b\x0c\r "
#: Fixed by the contract.
FLAGGED = "#*$%&|<>"


def _table() -> np.ndarray:
    """The unit that each UTF-16 code unit is read as: 0 is kept for the edge of a text."""
    t = np.arange(1 << 16, dtype=np.uint16)
    t[0] = 1
    t[[ord(c) for c in SPACES]] = ord(" ")
    t[[ord(c) for c in FLAGGED]] = ord("#")
    t[ord("0") : ord("9") + 1] = ord("0")
    return t


_UNIT = _table()
_ONCE = np.isin(np.arange(1 << 16), (ord(" "), ord("#")))


def units(texts: list[str]) -> np.ndarray:
    """All texts as units, three edges before, between and after; a run of spaces or of flagged symbols counts once."""
    edge = np.zeros(ORDER - 1, np.uint16)
    parts = [edge]
    for x in texts:
        parts += [_UNIT[np.frombuffer(x.lower().encode("utf-16-le", "surrogatepass"), np.uint16)], edge]
    s = np.concatenate(parts)
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != s[:-1]) | ~_ONCE[s[1:]]
    return s[keep]


def grams(s: np.ndarray) -> np.ndarray:
    """The 4-gram that ends at each unit from the fourth on, the first unit highest."""
    n = s[:-3].astype(np.uint64)
    for k in range(1, ORDER):
        n = n << np.uint64(16) | s[k : len(s) - ORDER + 1 + k].astype(np.uint64)
    return n


def predicted(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which units are predicted (those of texts and the first edge after each), and where each text begins."""
    edges = np.flatnonzero(s == 0).reshape(-1, ORDER - 1)
    real = np.ones(len(s), bool)
    real[edges.ravel()] = False
    real[edges[1:, 0]] = True
    return real, edges[:-1, -1] + 1


def _groups(texts: list[str]) -> Iterator[tuple[int, int]]:
    """(first, end) of stretches of texts with about SLICE characters; a longer text is a stretch of its own."""
    first, size = 0, 0
    for i, x in enumerate(texts):
        size += len(x)
        if size >= SLICE or i + 1 == len(texts):
            yield first, i + 1
            first, size = i + 1, 0


def count_grams(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """lang, gram, n: how often each 4-gram occurs in the documents of each language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str | None, list[tuple[np.ndarray, np.ndarray]]] = {}
        raw: dict[str | None, list[np.ndarray]] = {}
        size = 0

        def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            g, n = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
            g, at = np.unique(g, return_inverse=True)
            return g, np.bincount(at, n).astype(np.int64)

        def flush() -> Iterator[pa.RecordBatch]:
            for code, parts in raw.items():
                held.setdefault(code, []).append(np.unique(np.concatenate(parts), return_counts=True))
            raw.clear()
            for code in held:
                held[code] = [merged(held[code])]
            if sum(len(p[0][0]) for p in held.values()) > HELD:
                yield from rows()
                held.clear()

        def rows() -> Iterator[pa.RecordBatch]:
            for code, parts in held.items():
                for g, n in parts:
                    yield pa.record_batch([pa.array([code] * len(g), pa.string()), pa.array(g.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                by: dict[str | None, list[str]] = {}
                for code, x in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    by.setdefault(code, []).append(x or "")
                for code, texts in by.items():
                    for a, b in _groups(texts):
                        s = units(texts[a:b])
                        g = grams(s)[predicted(s)[0][ORDER - 1 :]]
                        raw.setdefault(code, []).append(g)
                        size += len(g)
                        if size >= 1 << 20:
                            yield from flush()
                            size = 0
        yield from flush()
        yield from rows()

    return docs.select(lang, text).mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _seed(lang: str | None, order: int) -> np.uint64:
    return np.uint64(xxhash.xxh3_64_intdigest(f"{order}|{lang}" if lang is not None else f"{order}"))


def _hash(ids: np.ndarray, seed: np.uint64) -> np.ndarray:
    """Multiplying by an odd number and folding are both reversible: n-grams of one language and order never collide."""
    h = (ids.astype(np.uint64) ^ seed) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(32))


def discounts(n1: float, n2: float, n3: float, n4: float) -> list[float]:
    """Modified Kneser-Ney discounts for counts of 0, 1, 2 and at least 3; halves where a count of counts is missing."""
    if min(n1, n2, n3, n4) <= 0:
        return [0.0, 0.5, 1.0, 1.5]
    y, n = n1 / (n1 + 2 * n2), [0.0, n1, n2, n3, n4]
    return [0.0, *(min(max(i - (i + 1) * y * n[i + 1] / n[i], 0.05 * i), 0.95 * i) for i in range(1, 4))]


@dataclass
class KneserNey:
    """keys: sorted hashes of all n-grams kept, whatever their language and order; logp, backoff: log10 figures in the same
    places. empty: by language, log10 of the mass that unigrams leave for units never seen."""

    keys: np.ndarray
    logp: np.ndarray
    backoff: np.ndarray
    empty: dict[str | None, float]

    @staticmethod
    def fit(levels: list[pa.Table], counted: dict[tuple[str | None, int], list[float]]) -> KneserNey:
        """levels[k]: lang, gram, n, total (of the context, all its n-grams) of the (k+1)-grams kept; counted: the counts of counts."""
        codes = {code for code, _ in counted}
        keys, logps, backoffs = [], [], []
        empty: dict[str | None, float] = {}
        for code in codes:
            lower_ids, lower_p, floor = np.empty(0, np.uint64), np.empty(0), 1.0 / (1 << 16)
            found: list[tuple[np.ndarray, np.ndarray]] = []
            boff: list[dict[str, np.ndarray]] = []
            gamma0 = 1.0
            for k, level in enumerate(levels):
                own = level.filter(pa.compute.equal(level["lang"], code) if code is not None else pa.compute.is_null(level["lang"]))
                ids, c, total = (own[x].to_numpy() for x in ("gram", "n", "total"))
                order = np.argsort(ids.view(np.uint64))
                ids, c, total = ids.view(np.uint64)[order], c[order].astype(float), total[order].astype(float)
                share = (c - np.array(discounts(*counted.get((code, k), [0.0] * 4)))[np.minimum(c, 3).astype(int)]) / total
                ctx, at = np.unique(ids >> np.uint64(16), return_inverse=True)
                gamma = np.maximum(1 - np.bincount(at, share, len(ctx)), 1e-12)
                if k == 0:
                    gamma0 = float(gamma[0]) if len(gamma) else 1.0
                    p = share + gamma0 * floor
                else:
                    suffix = ids & np.uint64((1 << 16 * k) - 1)
                    p = share + gamma[at] * _probability(found, boff, suffix, k, gamma0 * floor)
                boff.append({"ctx": ctx, "gamma": gamma})
                found.append((ids, p))
            empty[code] = float(np.log10(gamma0 * floor))
            for k, (ids, p) in enumerate(found):
                gamma = np.ones(len(ids))
                if k + 1 < len(boff):  # contexts of the order above, by the n-gram that they are
                    ctx = boff[k + 1]["ctx"]
                    at = np.minimum(np.searchsorted(ctx, ids), max(len(ctx) - 1, 0))
                    hit = ctx[at] == ids if len(ctx) else np.zeros(len(ids), bool)
                    gamma[hit] = boff[k + 1]["gamma"][at[hit]]
                keys.append(_hash(ids, _seed(code, k)))
                logps.append(np.log10(p).astype(np.float32))
                backoffs.append(np.log10(gamma).astype(np.float32))
                if k + 1 < len(boff):  # contexts with n-grams kept that are themselves left out
                    lost = ~np.isin(boff[k + 1]["ctx"], ids)
                    keys.append(_hash(boff[k + 1]["ctx"][lost], _seed(code, k)))
                    logps.append(np.full(int(lost.sum()), np.nan, np.float32))
                    backoffs.append(np.log10(boff[k + 1]["gamma"][lost]).astype(np.float32))
        if not keys:
            return KneserNey(np.empty(0, np.uint64), np.empty(0, np.float32), np.empty(0, np.float32), empty)
        all_keys = np.concatenate(keys)
        order = np.argsort(all_keys)
        return KneserNey(all_keys[order], np.concatenate(logps)[order], np.concatenate(backoffs)[order], empty)

    def _find(self, ids: np.ndarray, code: str | None, k: int) -> tuple[np.ndarray, np.ndarray]:
        h = _hash(ids, _seed(code, k))
        at = np.minimum(np.searchsorted(self.keys, h), max(0, len(self.keys) - 1))
        return at, self.keys[at] == h if len(self.keys) else np.zeros(len(h), bool)

    def score(self, ids: np.ndarray, code: str | None) -> np.ndarray:
        """log10 of the probability of each 4-gram's last unit after the three before it."""
        out, left = np.zeros(len(ids)), np.arange(len(ids))
        for k in range(ORDER - 1, -1, -1):
            n = ids[left] & np.uint64((1 << 16 * (k + 1)) - 1)
            at, hit = self._find(n, code, k)
            hit[hit] = ~np.isnan(self.logp[at[hit]])
            out[left[hit]] += self.logp[at[hit]]
            left, n = left[~hit], n[~hit]
            if k and len(left):
                at, hit = self._find(n >> np.uint64(16), code, k - 1)
                out[left[hit]] += self.backoff[at[hit]]
        out[left] += self.empty.get(code, -16 * np.log10(2))
        return out


def _probability(found: list, boff: list, ids: np.ndarray, order: int, floor: float) -> np.ndarray:
    """Probability of n-grams of `order` units under the levels below, backing off where one was left out."""
    p, factor, left = np.empty(len(ids)), np.ones(len(ids)), np.arange(len(ids))
    for k in range(order - 1, -1, -1):
        known, probs = found[k]
        n = ids[left] & np.uint64((1 << 16 * (k + 1)) - 1)
        at = np.minimum(np.searchsorted(known, n), max(len(known) - 1, 0))
        hit = known[at] == n if len(known) else np.zeros(len(n), bool)
        p[left[hit]] = factor[left[hit]] * probs[at[hit]]
        left, n = left[~hit], n[~hit]
        if k and len(left):
            ctx, gamma = boff[k]["ctx"], boff[k]["gamma"]
            at = np.minimum(np.searchsorted(ctx, n >> np.uint64(16)), max(len(ctx) - 1, 0))
            hit = ctx[at] == n >> np.uint64(16) if len(ctx) else np.zeros(len(n), bool)
            factor[left[hit]] *= gamma[at[hit]]
    p[left] = factor[left] * floor
    return p


def _least_held(level: DataFrame) -> int:
    """The least count of the MODEL most frequent n-grams, those of the next count being too many; from a histogram of counts."""
    sizes = level.groupBy("n").agg(F.count("*").alias("k")).orderBy(F.desc("n")).limit(MODEL).toArrow()
    held = sizes["n"].to_numpy()[np.cumsum(sizes["k"].to_numpy()) <= MODEL]
    return int(held.min()) if len(held) else 1 << 62


def _levels(docs: DataFrame, lang: str, text: str) -> list[DataFrame]:
    """lang, gram, n: stored tables of the n-grams of each order, the 1-grams first."""
    out = [written(count_grams(docs, lang, text), f"grams{ORDER}")]
    for k in range(ORDER - 1, 0, -1):
        suffix = F.col("gram").bitwiseAND((1 << 16 * k) - 1)
        out.append(written(out[-1].groupBy("lang", suffix.alias("gram")).agg(F.count("*").alias("n")), f"grams{k}"))
    return out[::-1]


def _counts_of_counts(level: DataFrame) -> DataFrame:
    """lang, n1, n2, n3, n4: how many n-grams of a language stand once, twice ..."""
    return level.groupBy("lang").agg(*(F.count_if(F.col("n") == i).cast("double").alias(f"n{i}") for i in range(1, 5)))


def _ctx() -> Column:
    return F.shiftrightunsigned("gram", 16)


def probabilities(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """lang, gram, n, logp: log10 of the interpolated probability of every 4-gram of docs, as a stored table."""
    lower = None
    for k, level in enumerate(_levels(docs, lang, text)):
        d = F.udf(lambda *n: discounts(*n), "array<double>")("n1", "n2", "n3", "n4")
        cut = _counts_of_counts(level).select(F.col("lang").alias("d_lang"), d.alias("d"))
        many = [F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") == 2).alias("twice"), F.count_if(F.col("n") > 2).alias("often")]
        after = level.groupBy(F.col("lang").alias("c_lang"), _ctx().alias("ctx")).agg(F.sum("n").alias("total"), *many)
        rows = level.join(after, F.col("lang").eqNullSafe(F.col("c_lang")) & (_ctx() == F.col("ctx"))).join(cut, F.col("lang").eqNullSafe(F.col("d_lang")))
        below = F.lit(1.0 / (1 << 16))
        if lower is not None:
            low = lower.select(F.col("lang").alias("l_lang"), F.col("gram").alias("l_gram"), F.col("p").alias("below"))
            rows = rows.join(low, F.col("lang").eqNullSafe(F.col("l_lang")) & (F.col("gram").bitwiseAND((1 << 16 * k) - 1) == F.col("l_gram")))
            below = F.col("below")
        left = sum((F.col(c) * F.col("d")[i] for i, c in enumerate(("once", "twice", "often"), 1)), F.lit(0.0)) / F.col("total")
        share = (F.col("n") - F.col("d")[F.least("n", F.lit(3)).cast("int")]) / F.col("total")
        lower = rows.select("lang", "gram", "n", (share + F.greatest(left, F.lit(1e-12)) * below).alias("p"))
    return written(lower.select("lang", "gram", "n", F.log10("p").cast("float").alias("logp")), "probabilities")


@dataclass
class Held:
    """By language, 4-grams in order and log10 of their probabilities: those that a worker holds."""

    by: dict[str | None, tuple[np.ndarray, np.ndarray]]

    @staticmethod
    def of(table: DataFrame) -> Held:
        got, by = table.select("lang", "gram", "logp").toArrow(), {}
        for code in got["lang"].unique().to_pylist():
            own = got.filter(pa.compute.equal(got["lang"], code) if code is not None else pa.compute.is_null(got["lang"]))
            ids, logp = own["gram"].to_numpy().view(np.uint64), own["logp"].to_numpy()
            order = np.argsort(ids)
            by[code] = ids[order], logp[order]
        return Held(by)

    def sums(self, texts: list[str], code: str | None) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """For each text: the sum of log10 over the units predicted that are held, how many units are predicted in all, and the 4-grams
        that aren't held, with how often they occur."""
        known, logp = self.by.get(code, (np.empty(0, np.uint64), np.empty(0, np.float32)))
        out, size, rest = np.empty(len(texts)), np.empty(len(texts), np.int64), []
        for a, b in _groups(texts):
            s = units(texts[a:b])
            real, starts = predicted(s)
            ids, at = np.unique(grams(s), return_inverse=True)
            place = np.minimum(np.searchsorted(known, ids), max(0, len(known) - 1))
            hit = known[place] == ids if len(known) else np.zeros(len(ids), bool)
            v = np.zeros(len(s))
            v[ORDER - 1 :] = np.where(hit, logp[place], 0)[at] if len(known) else 0
            v[~real] = 0
            out[a:b] = np.add.reduceat(v, starts)
            size[a:b] = np.add.reduceat(real, starts, dtype=np.int64)
            missing = np.flatnonzero(~hit[at] & real[ORDER - 1 :])
            cuts = np.searchsorted(missing, starts[1:] - ORDER + 1)
            rest += [np.unique(ids[at[m]], return_counts=True) for m in np.split(missing, cuts)] if len(missing) else [_NONE] * (b - a)
        return out, size, rest


_NONE = np.empty(0, np.uint64), np.empty(0, np.int64)


def fit_model(docs: DataFrame, lang: str = "lang", text: str = "text") -> KneserNey:
    """A model of bounded size: of each order the MODEL most frequent n-grams at most, and four figures for each language, come to the driver."""
    levels, counted = [], {}
    for k, level in enumerate(_levels(docs, lang, text)):
        for code, *n in _counts_of_counts(level).toLocalIterator():
            counted[code, k] = n
        totals = level.groupBy("lang", _ctx().alias("ctx")).agg(F.sum("n").alias("total"))
        kept = level.where(F.col("n") >= _least_held(level)).select("lang", _ctx().alias("ctx"), "gram", "n")
        same = kept["lang"].eqNullSafe(totals["lang"]) & (kept["ctx"] == totals["ctx"])
        levels.append(kept.join(totals, same).select(kept["lang"], "gram", "n", "total").toArrow())
    return KneserNey.fit(levels, counted)


def base_figures(text: str) -> tuple[int, int, int, int, int]:
    """words, code points in words, flagged symbols, repeated lines, words in repeated 3-word windows."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    chars = len(text) - sum(map(text.count, SPACES))
    seen: set[bytes] = set()
    dup = 0
    for line in raw.split(b"\n"):
        if line.strip():
            dup += line in seen
            seen.add(line)
    flagged = sum(raw.count(b) for b in _FLAGGED_BYTES)
    return len(words), chars, flagged, dup, repeated(words)


_FLAGGED_BYTES = [c.encode() for c in FLAGGED]


def repeated(words: list[bytes]) -> int:
    """How many words lie in a window of three that is found twice or more, the first included."""
    if len(words) < 4:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    mixed = (h[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ h[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) ^ h[2:]
    order = np.argsort(mixed)
    same = np.flatnonzero(mixed[order[1:]] == mixed[order[:-1]])
    if not len(same):
        return 0  # different hashes: different windows
    first: dict[tuple, int] = {}
    inside = np.zeros(len(words), bool)
    for i in np.unique(np.concatenate((order[same], order[same + 1]))).tolist():  # equal hashes: compare the words
        j = first.setdefault(tuple(words[i : i + 3]), i)
        if j != i:
            inside[i : i + 3] = True
            inside[j : j + 3] = True
    return int(inside.sum())


def _names(columns: list[str]) -> list[str]:
    return [fresh(c, columns) for c in ("_q_words", "_q_chars", "_q_symbols", "_q_lines", "_q_repeats", "_q_ppl")]


_REST = ArrayType(StructType().add("gram", "long").add("n", "long"))


def _base_figures_and_sums(docs: DataFrame, held: Held, whole: bool, lang: str, text: str) -> DataFrame:
    """docs with the base figures and the mean of -log10 over the units predicted, of those held; unless `whole`, with the number of
    units and the 4-grams not held too, in the columns of _rest_names()."""
    at, code_at, names, shared = docs.columns.index(text), docs.columns.index(lang), _names(docs.columns), docs.sparkSession.sparkContext.broadcast(held)
    n_name, rest_name = _rest_names(docs.columns)

    def figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given in batches:
            for i in range(0, given.num_rows, 256):
                batch = given.slice(i, 256)
                texts = [x or "" for x in batch.column(at).to_pylist()]
                base = np.array([base_figures(x) for x in texts], np.int64).reshape(-1, 5)
                ppl, size, rest, by = np.zeros(len(texts)), np.zeros(len(texts), np.int64), [_NONE] * len(texts), {}
                for k, code in enumerate(batch.column(code_at).to_pylist()):
                    by.setdefault(code, []).append(k)
                for code, rows in by.items():
                    total, size[rows], lists = shared.value.sums([texts[k] for k in rows], code)
                    ppl[rows] = -total / size[rows]
                    for k, x in zip(rows, lists):
                        rest[k] = x
                columns, new = [*batch.columns, *(pa.array(base[:, k]) for k in range(5)), pa.array(ppl)], [*batch.schema.names, *names]
                if not whole:
                    ends = pa.array(np.concatenate([[0], np.cumsum([len(g) for g, _ in rest])]), pa.int32())
                    pairs = [pa.array(np.concatenate([x[j] for x in rest]).view(np.int64)) for j in (0, 1)]
                    columns += [pa.array(size), pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(pairs, ["gram", "n"]))]
                    new += [n_name, rest_name]
                yield pa.record_batch(columns, names=new)

    schema = StructType(list(docs.schema.fields))
    for name in names[:5]:
        schema = schema.add(name, "long")
    schema = schema.add(names[5], "double")
    return docs.mapInArrow(figures, schema if whole else schema.add(n_name, "long").add(rest_name, _REST))


def _rest_names(columns: list[str]) -> list[str]:
    return [fresh(c, columns) for c in ("_q_units", "_q_rest")]


def with_figures(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """docs with the base figures and log10 of the perplexity, in the columns of _names(), as stored tables. Only documents that have 4-grams
    which workers don't hold are joined with those; what they miss comes back as one sum for each."""
    table = probabilities(docs, lang, text)
    least = _least_held(table)
    held, others = table.where(F.col("n") >= least), table.where(F.col("n") < least)
    if others.isEmpty():
        return written(_base_figures_and_sums(docs, Held.of(held), True, lang, text), "quality")
    row, its, more = (fresh(c, docs.columns) for c in ("_q_row", "_q_its", "_q_more"))
    ppl, (size, rest), all_names = _names(docs.columns)[5], _rest_names(docs.columns), [*docs.columns, *_names(docs.columns)]
    scored = written(_base_figures_and_sums(docs, Held.of(held), False, lang, text).withColumn(row, F.monotonically_increasing_id()), "quality")
    columns, some = [F.col(f"`{c}`") for c in all_names], F.size(f"`{rest}`") > 0
    lacks = scored.where(some).select(F.col(row).alias(its), F.col(f"`{lang}`").alias("r_lang"), F.inline(f"`{rest}`").alias("r_gram", "times"))
    others = others.select("lang", "gram", "logp")
    sums = lacks.join(others, F.col("lang").eqNullSafe(F.col("r_lang")) & (F.col("gram") == F.col("r_gram"))).groupBy(its).agg(F.sum(F.col("times") * F.col("logp").cast("double")).alias(more))
    joined = scored.where(some).join(sums, F.col(row) == F.col(its)).withColumn(ppl, F.col(ppl) - F.col(more) / F.col(size))
    return scored.where(~some).select(columns).union(written(joined.select(columns), "quality-rest"))


def judged(docs: DataFrame, text: str = "text", lang: str = "lang", below: float = 8.0, above: float = 6.0, least: float = 0.6) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, log_perplexity, kept.

    The band of a language runs from its median `below` quartile distances down and `above` up, measured on the distinct texts
    that pass the base rules, so that a group of copies weighs as one. A mean over n words varies as 1 / sqrt(n), so the band of a document is wider by
    sqrt(median n / n), and `least` times as wide at least. New columns get a trailing underscore where docs has their name.
    """
    names = _names(docs.columns)
    words, _, _, _, repeats, ppl = names
    scored = with_figures(docs, lang, text)
    failed = (F.col(words) < 50) | (100 * F.col(repeats) > 50 * F.col(words))
    # exact, so reruns agree; perplexities are rounded, so the values that one language counts are bounded
    exact = lambda x, p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {x})")
    q = F.array(*(exact(f"round(`{ppl}`, 5)", p) for p in (0.25, 0.5, 0.75)))
    key, mid, down, up, usual, same = (fresh(c, scored.columns) for c in ("_q_lang", "_q_mid", "_q_down", "_q_up", "_q_usual", "_q_same"))
    once = scored.where(~failed).select(F.col(lang).alias(key), F.xxhash64(text).alias(same), words, ppl).distinct()
    bands = once.groupBy(key).agg(q.alias("q"), exact(f"`{words}`", 0.5).alias(usual))
    step = lambda a, b: F.greatest(F.col("q")[b] - F.col("q")[a], F.lit(0.001))
    bands = written(bands.select(key, F.col("q")[1].alias(mid), (below * step(0, 1)).alias(down), (above * step(1, 2)).alias(up), usual), "bands")
    out, cols = scored.join(bands, F.col(lang).eqNullSafe(F.col(key)), "left"), [F.col(c) for c in docs.columns]
    wider = F.greatest(F.sqrt(F.col(usual) / F.greatest(F.col(words), F.lit(1))), F.lit(least))
    inside = F.col(ppl).between(F.col(mid) - F.col(down) * wider, F.col(mid) + F.col(up) * wider)
    new = dict(zip(["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"], map(F.col, names)))
    new |= {"base_failed": failed, "log_perplexity": F.round(F.col(ppl), 6), "kept": ~failed & F.coalesce(inside, F.lit(True))}
    return out.select(*cols, *(e.alias(fresh(n, docs.columns)) for n, e in new.items()))


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with the columns of docs."""
    kept = fresh("kept", docs.columns)
    return judged(docs).where(F.col(kept)).select(*docs.columns)
