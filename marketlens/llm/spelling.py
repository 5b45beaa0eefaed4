"""Spelling variants: words one replaced, inserted or deleted code point apart, grouped without pairs.

Each word goes into a group for each of its positions, named by (position, prefix, suffix); words that differ in that place
alone meet there. A group tells each of its words the group's size and the better of its two best other words. For insertions
and deletions, each word less one code point joins the vocabulary; a match informs both sides. The answers are then added
up by word: pairs are never rows.

Words are ranked by falling count and rising code points, so the best near word is the least rank and all shuffles after the
ranking carry numbers. A group's key is the word with its position blanked; of words over LONG code points it is two digests
of 128 bits, so a word of a million letters makes a million short keys. Groups are small by nature: 90 letters can stand in one
place, so a pattern has 90 words at most and a word 90 longer ones for each of its gaps.

Defined cases: null texts have no words; a null doc_id is written as nothing in the edit's checksum; rows that share doc_id
and text count each; long texts and words are read whole; of words that tie in count the least in code-point order is the
form; without words the result is empty; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlens.llm.common import written
from marketlens.llm.sharding import row_numbers

#: Fixed by the contract: least code points and occurrences of a word, the edit's divisor, how much more frequent a form is.
LEAST, OFTEN, EDITED, MORE = 7, 2, 31, 10
#: Longer words have digests for keys. Words that a task counts before it hands its counts on.
LONG, COUNTED = 64, 1 << 17
RUN = re.compile("[a-zÀ-ÿ]{%d,}" % LEAST)
STAR, DELETED, SELF = 0, 1, 2


def edited(doc: str, run: str) -> str:
    """The run as it counts in a document: one in 31 has lost a code point."""
    h = zlib.crc32(f"{doc}:{run}".encode())
    if h % EDITED:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[str] = Counter()

    def out() -> pa.RecordBatch:
        return pa.record_batch([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])

    for batch in batches:
        for doc, text in zip(batch.column(0), batch.column(1)):
            text = (text.as_py() or "").encode().lower().decode()  # of bytes, only A-Z become lower case
            doc = str(doc.as_py()) if doc.is_valid else ""
            for run, n in Counter(RUN.findall(text)).items():
                word = edited(doc, run)
                if len(word) >= LEAST:
                    counts[word] += n
            if len(counts) >= COUNTED:
                yield out()
                counts.clear()
    yield out()


def vocabulary(docs: DataFrame) -> DataFrame:
    """rank, word, n of all words; rank 0 is the most frequent. A written table."""
    found = docs.select("doc_id", "text").mapInArrow(_counts, "word string, n long")
    counts = written(found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= OFTEN).select("word", "n", (-F.col("n")).alias("less")), "word-counts")
    return written(row_numbers(counts, "less", "word", name="rank").select("rank", "word", "n"), "vocabulary")


def _digests(word: str) -> list[bytes]:
    """For each i, a digest of word[:i]."""
    h, out = hashlib.blake2b(digest_size=16), []
    for c in word:
        out.append(h.digest())
        h.update(c.encode("utf-32-le"))
    return [*out, h.digest()]


def keys_of(word: str) -> Iterator[tuple[int, str]]:
    """The (kind, key) of a word's groups: its patterns, itself, and what is left without one of its code points, each once."""
    n = len(word)
    deleted = [i for i in range(n) if i == 0 or word[i] != word[i - 1]] if n > LEAST else []
    if n > LONG:
        head, tail = _digests(word), _digests(word[::-1])[::-1]  # tail[i]: of word[i:]
        key = lambda kind, i, j: f"{kind}{i}:{head[i].hex()}{tail[j].hex()}"
        yield from ((STAR, key("*", i, i + 1)) for i in range(n))
        yield from ((SELF, key("-", i, i)) for i in range(n + 1))
    else:
        yield from ((STAR, f"{word[:i]}*{word[i + 1 :]}") for i in range(n))
        yield SELF, word
    if n > LONG + 1:
        yield from ((DELETED, key("-", i, i + 1)) for i in deleted)
    else:
        yield from ((DELETED, word[:i] + word[i + 1 :]) for i in deleted)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(rows: list[tuple]) -> pa.RecordBatch:
        kinds, keys, ranks = zip(*rows)
        return pa.record_batch([pa.array(keys, pa.string()), pa.array(kinds, pa.int8()), pa.array(ranks, pa.int64())], names=["key", "kind", "rank"])

    rows: list[tuple] = []
    for batch in batches:
        for rank, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for kind, key in keys_of(word):
                rows.append((kind, key, rank))
                if len(rows) >= 50_000:
                    yield out(rows)
                    rows = []
    if rows:
        yield out(rows)


def neighbours(words: DataFrame) -> DataFrame:
    """rank, n_near, best: how many near words a word has, and the least rank among them. Words without any are left out.

    In a group the vocabulary's own word comes first, then ranks rise. The first row sees all others, the best of which is
    next; the others of a pattern see the first; words less a code point see the vocabulary's word, if there is one.
    """
    keys = words.select("rank", "word").mapInArrow(_keys, "key string, kind byte, rank long")
    group, by = Window.partitionBy("key"), Window.partitionBy("key").orderBy(F.desc("kind"), "rank")
    seen = keys.select(
        "rank", "kind", F.count("*").over(group).alias("size"), F.row_number().over(by).alias("place"),
        F.first("rank").over(by).alias("first"), F.first("kind").over(by).alias("first_kind"), F.lead("rank").over(by).alias("second"),
    ).where("size > 1 AND (kind <> 1 OR first_kind = 2)")
    near = F.when(F.col("kind") == DELETED, F.lit(1)).otherwise(F.col("size") - 1)
    best = F.when(F.col("place") == 1, F.col("second")).otherwise(F.col("first"))
    return seen.groupBy("rank").agg(F.sum(near).alias("n_near"), F.min(best).alias("best"))


def followed(links: DataFrame) -> DataFrame:
    """rank, root from links (rank, root): each link replaced by its end. A form has ten times the count, so chains are short
    and their lengths halve each round."""
    links = written(links, "forms")
    while not (more := links.join(links.select(F.col("rank").alias("root"), F.col("root").alias("next")), "root")).isEmpty():
        moved = more.select("rank", F.col("next").alias("root"))
        links = written(links.join(moved.select("rank"), "rank", "left_anti").select("rank", "root").union(moved), "forms")
    return links


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n for each word."""
    words = vocabulary(docs)
    other = words.select(F.col("rank").alias("best"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    near = neighbours(words).join(other, "best")
    full = written(words.join(near, "rank", "left").withColumn("is_form", F.coalesce(F.col("form_n") >= MORE * F.col("n"), F.lit(False))), "near-words")
    links = followed(full.where("is_form").select("rank", F.col("best").alias("root")))
    roots = links.join(words.select(F.col("rank").alias("root"), F.col("word").alias("root_word")), "root").select("rank", "root_word")
    form = lambda c: F.when(F.col("is_form"), F.col(c)).alias(c)
    return full.join(roots, "rank", "left").select("word", form("form"), F.coalesce("root_word", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form("form_n"))
