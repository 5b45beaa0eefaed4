"""Document fingerprints by consistent weighted sampling, in DataFrame functions alone.

A text is the set of its words `[^\\x20\\x09-\\x0D]+`, as they stand, each with its number of occurrences as weight. For sample
k and a term of weight S, with r and c from Gamma(2, 1) and b uniform, all drawn from hashes of the term and k:

    t = floor(ln S / r + b),    ln a = ln c - r (t - b + 1),

and the term of least a, with its t, is the sample. Two texts have the same k-th sample with a probability equal to the
generalised Jaccard similarity of their weights (sum of minima by sum of maxima). A fingerprint is SAMPLES such choices of 16
bits each, so a likeness has a standard error of at most 0.5 / sqrt(SAMPLES) and 2^-16 of chance equality.

The texts move once: documents go to blocks of a few hundred neighbours in the order of doc_id, and the text after the last of a
block is fetched by block. Words are counted inside the row, and sampled within the partition: the exploded
terms never move, and only one row for each text and group of samples is held.

Defined cases: a null text is empty; a text without words has the fingerprint '' and likeness 1 to others of that kind, 0 to
the rest; null doc_ids come first; rows that share a doc_id are ordered by a hash of the text; a single document is its own
next; long texts are read whole; an empty table gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.llm.common import WORD, text_of, written

#: Samples of a fingerprint, and how many of them a row computes at once (small methods that the JVM compiles).
SAMPLES, AT_ONCE = 32, 4
#: Ranges of doc_id by quantiles, and documents of a block about.
RANGES, BLOCK_ROWS = 256, 256
#: Values of a gamma draw, equally likely; b has 48 bits, so that no two terms tie.
LEVELS = 256
SEED = 1801
#: ln a lies between -64 and 4 for weights under e^14, and so on: 2^20 steps of it take 27 bits, the sample's hash 36.
STEPS, HASH_BITS, OFFSET = 1 << 20, 36, 96


def terms(text: Column) -> Column:
    """Hashes of the words in order, one entry for each occurrence."""
    return F.sort_array(F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w)))


def weighted(df: DataFrame, sorted_terms: str) -> DataFrame:
    """df with `term` and `weight` for each distinct term of the sorted array; one row with nulls if there is none."""
    s = F.col(sorted_terms)
    begins = F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == 1) | (F.get(s, i - 1) != F.get(s, i - 2)))
    df = df.withColumn("begins", F.when(F.size(s) > 0, begins)).withColumn("ends", F.slice(F.concat("begins", F.array(F.size(s) + 1)), 2, F.size("begins")))
    pairs = F.zip_with("begins", "ends", lambda a, b: F.struct(F.get(s, a - 1).alias("term"), (b - a).alias("weight")))
    keep = [c for c in df.columns if c not in (sorted_terms, "begins", "ends")]
    return df.select(*keep, pairs.alias("pairs")).select(*keep, F.explode_outer("pairs").alias("pair")).select(*keep, "pair.term", "pair.weight")


def _gamma() -> list[float]:
    """LEVELS equally likely values of Gamma(2, 1): where 1 - exp(-x) (1 + x) is (i + 1/2) / LEVELS."""
    out = []
    for i in range(LEVELS):
        low, high = 0.0, 64.0
        for _ in range(64):
            x = (low + high) / 2
            low, high = (x, high) if 1 - math.exp(-x) * (1 + x) < (i + 0.5) / LEVELS else (low, x)
        out.append(low)
    return out


def _level(values: list[float], h: Column, piece: int) -> Column:
    return F.get(F.array(*map(F.lit, values)), F.shiftrightunsigned(h, 8 * piece).bitwiseAND(LEVELS - 1).cast("int"))


def samples(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, fingerprint: from rows (keys, term, weight)."""
    df = df.select(*keys, "term", F.ln(F.col("weight").cast("double")).alias("ln_s"), F.explode(F.array(*map(F.lit, range(0, SAMPLES, AT_ONCE)))).alias("k"))
    each = range(AT_ONCE)
    df = df.select(*keys, "k", "term", "ln_s", *(F.xxhash64("term", F.col("k") + i, F.lit(SEED)).alias(f"h{i}") for i in each))
    gamma = _gamma()
    draws = [f(F.col(f"h{i}")).alias(f"{name}{i}") for i in each for name, f in (
        ("r", lambda h: _level(gamma, h, 0)),
        ("c", lambda h: _level([math.log(x) for x in gamma], h, 1)),
        ("b", lambda h: (F.shiftrightunsigned(h, 16) + F.lit(0.5)) * F.lit(2.0**-48)),
    )]
    df = df.select(*keys, "k", "term", "ln_s", *draws)
    df = df.select(*keys, "k", "term", *(x for i in each for x in (f"r{i}", f"c{i}", f"b{i}", F.floor(F.col("ln_s") / F.col(f"r{i}") + F.col(f"b{i}")).alias(f"t{i}"))))

    def packed(i: int) -> Column:
        ln_a = F.col(f"c{i}") - F.col(f"r{i}") * (F.col(f"t{i}") - F.col(f"b{i}") + 1)
        what = F.xxhash64("term", f"t{i}", F.col("k") + i).bitwiseAND((1 << HASH_BITS) - 1)
        return F.shiftleft(F.floor((ln_a + OFFSET) * STEPS).cast("long"), HASH_BITS).bitwiseOR(what)

    least = df.groupBy(*keys, "k").agg(*(F.min(packed(i)).alias(f"m{i}") for i in each))
    part = F.concat(*(F.lpad(F.lower(F.hex(F.col(f"m{i}").bitwiseAND(0xFFFF))), 4, "0") for i in each))
    parts = least.select(*keys, F.struct("k", part.alias("part")).alias("p"))
    return parts.groupBy(*keys).agg(F.coalesce(F.array_join(F.sort_array(F.collect_list("p"))["part"], ""), F.lit("")).alias("fingerprint"))


def likeness(a: Column, b: Column) -> Column:
    """The share of equal samples of two fingerprints."""
    same = sum(((F.substring(a, 4 * i + 1, 4) == F.substring(b, 4 * i + 1, 4)).cast("int") for i in range(1, SAMPLES)), (F.substring(a, 1, 4) == F.substring(b, 1, 4)).cast("int"))
    return F.when((a == "") | (b == ""), (a == b).cast("double")).otherwise(same / F.lit(float(SAMPLES)))


def _block(docs: DataFrame) -> Column:
    """A number that rises with doc_id: quantile ranges, a bounded list, each cut evenly. Null ids are in block -1."""
    share = [i / RANGES for i in range(RANGES + 1)]
    n, marks = docs.agg(F.count("*"), F.percentile_approx("doc_id", F.lit(share).cast("array<double>"), F.lit(100 * RANGES))).first()
    marks = sorted({int(m) for m in marks or [0]})
    cuts = max(1, -(-n // (RANGES * BLOCK_ROWS)))

    table = F.array(*(F.lit(m).cast("long") for m in marks))
    at = F.size(F.filter(table, lambda m: m <= F.col("doc_id"))) - 1
    low = F.get(table, at)
    width = F.greatest(F.coalesce(F.get(table, at + 1), low + 1) - low, F.lit(1))
    inside = F.least(F.floor((F.col("doc_id") - low).cast("double") * cuts / width), F.lit(cuts - 1))
    return F.coalesce((at * cuts + inside).cast("long"), F.lit(-1).cast("long"))


def fingerprints(docs: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, fingerprint of the column `text`; keys must tell rows apart."""
    return samples(weighted(docs.select(*keys, terms(text_of(text)).alias("_terms")), "_terms"), keys)


def _next_heads(keyed: DataFrame) -> DataFrame:
    """block, next_text, next_fingerprint: the document after the last of each block; after the last block, the first of all.

    One row for each block, written: the texts of the blocks' first documents are read again, by their ids.
    """
    firsts = keyed.groupBy("block").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "tie")).alias("m"))
    order = Window.orderBy("block")  # over one row a block, without texts
    before = F.coalesce(F.lag("block").over(order), F.max("block").over(Window.partitionBy()))
    heads = firsts.select("block", before.alias("before"), F.col("m.doc_id").alias("first_id"), F.col("m.tie").alias("first_tie"))
    texts = keyed.join(heads.select("first_id", "first_tie", "before"), F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("tie") == F.col("first_tie")))
    texts = written(texts.groupBy("before").agg(F.first("text").alias("next_text")), "block-heads")
    return written(texts.join(fingerprints(texts, ["before"], "next_text"), "before").select(F.col("before").alias("block"), "next_text", F.col("fingerprint").alias("next_fingerprint")), "block-heads")


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    keyed = docs.select("doc_id", text_of().alias("text")).withColumn("tie", F.xxhash64("text")).withColumn("block", _block(docs))
    heads = _next_heads(keyed)
    by = Window.partitionBy("block").orderBy(F.asc_nulls_first("doc_id"), "tie")
    lined = keyed.select("block", "doc_id", "text", F.row_number().over(by).alias("place"), F.lead("text").over(by).alias("following"))
    lined = lined.join(heads.select("block", "next_text"), "block")
    n, half = F.char_length("text"), F.floor(F.char_length("text") / 2).cast("int")
    new = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.coalesce("following", "next_text"), F.lit(1), half))
    lined = lined.select("block", "place", "doc_id", n.cast("long").alias("n_chars"), "text", new.alias("edited"))
    keys = ["block", "place", "doc_id", "n_chars", "edited_sha256", "side"]
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("text")), F.struct(F.lit(1).alias("side"), F.col("edited").alias("text"))))
    both = lined.select("block", "place", "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), sides.alias("s"))
    made = fingerprints(both.select(*keys[:-1], "s.side", "s.text"), keys, "text")
    side = lambda i: F.max(F.when(F.col("side") == i, F.col("fingerprint")))
    rows = made.groupBy(*keys[:-1]).agg(side(0).alias("fingerprint"), side(1).alias("edited_fingerprint"))
    rows = rows.withColumn("following", F.lead("fingerprint").over(Window.partitionBy("block").orderBy("place")))
    rows = rows.join(heads.select("block", "next_fingerprint"), "block")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.coalesce("following", "next_fingerprint")).alias("near_next"),
    )
