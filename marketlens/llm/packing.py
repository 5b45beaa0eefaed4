"""Packing: concatenate and cut. Two passes of prefix sums give every token a global offset; fixed windows cut the stream.

Pass one tokenizes each document once and writes its ids with its offset inside its task. The sums of the tasks, one row
each, give the offset at which each task starts; pass two adds both and cuts at multiples of the window. A document that
crosses a boundary gives a record on either side. Only the last sequence is padded.

Defined cases: a null text is empty, so its document is the end token alone; repeated rows are packed as often as they
occur; an empty table gives no pieces. Long texts are tokenized whole.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import written

WINDOW, END = 4096, 2
#: Words remembered unless told otherwise, fewer of them where an executor's memory is short (with those of one batch under two thirds of 2^20,
#: where a dict doubles), and bytes of one.
_MEMO_WORDS, FEW_WORDS, _MEMO_CHARS = 1 << 20, 5 << 17, 32
#: The rule by which the vocabulary cuts a lower-cased text, words of ASCII and the letters of Latin-1, and what the rule is for these.
_RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SUFFIX = "</w>"
_PLAIN = re.compile(rb"(?:[\x00-\x7f]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
_PIECES = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+|[0-9]|[^\sa-z0-9\x80-\xff]+")
_state: dict = {}


def _tokenizer(path: str):
    """One tokenizer for each Python worker, and one memo of words of 32 bytes at most, which the worker's next tasks find filled."""
    if _state.get("path") != path:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True  # their strings in a text are ordinary text
        rules, before = ({} if part is None else json.loads(part.__getstate__()) for part in (t.pre_tokenizer, t.normalizer))
        cuts = [x.get("pattern", {}).get("Regex") for x in rules.get("pretokenizers", ())]
        lower = {"type": "Lowercase"} in before.get("normalizers", ())
        _state.update(path=path, tokenizer=t, memo={}, pieces=lower and _RULE in cuts and getattr(t.model, "end_of_word_suffix", None) == _SUFFIX)
        ends = np.zeros(t.get_vocab_size(), bool)
        ends[[i for w, i in t.get_vocab().items() if w.endswith(_SUFFIX)]] = True
        _state["ends"] = ends
        if _state["pieces"]:  # pieces are lower-cased and cut already, so white space alone parts them
            from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

            plain = Tokenizer(t.model)  # the same vocabulary, held once
            plain.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
            _state["plain"] = plain
    return _state["tokenizer"], _state["memo"]


def forget() -> None:
    """Empties the memo."""
    if "memo" in _state:
        _state["memo"].clear()


def _remember_pieces(pieces: list[bytes], memo: dict) -> None:
    """Pieces that the vocabulary's rules don't cut: tokenized in a row, as only a piece's last id stands for the end of a word."""
    tokenizer = _state["plain"]
    for i in range(0, len(pieces), 256):
        part = pieces[i : i + 256]
        ids = np.array(tokenizer.encode_batch_fast([b" ".join(part).decode()], add_special_tokens=False)[0].ids, "<u4")
        at = (np.flatnonzero(_state["ends"][ids]) + 1) * 4
        if len(at) != len(part):
            raise ValueError("a piece is cut by the vocabulary's rules")
        raw, at = ids.tobytes(), at.tolist()
        memo.update((p, raw[x:y]) for p, x, y in zip(part, [0, *at], at))


def _remember(words: list[bytes], tokenizer, memo: dict) -> None:
    for i in range(0, len(words), 4096):
        part = words[i : i + 4096]
        got = tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in part], add_special_tokens=False)
        ids = [e.ids for e in got]
        raw, at = np.fromiter(chain.from_iterable(ids), "<u4").tobytes(), 0
        for w, n in zip(part, map(len, ids)):
            memo[w] = raw[at : at + 4 * n]
            at += 4 * n


def encoded(texts: list[str], path: str, words_held: int | None = None) -> list[bytes]:
    """The ids of each text as little-endian 32-bit numbers, the end token last.

    The vocabulary's rules drop white space and no token spans it, so words are tokenized one by one and remembered. A new word of Latin
    letters is lower-cased and cut where those rules cut, so that its pieces are met again in other words.
    """
    tokenizer, memo = _tokenizer(path)
    lines = [x.encode("utf-8", "surrogatepass").split() for x in texts]
    found = [list(map(memo.get, words)) for words in lines]
    gaps = [[k for k, x in enumerate(ids) if x is None] for ids in found]
    new = {words[k] for words, gap in zip(lines, gaps) for k in gap}
    cut = {w: _PIECES.findall(w.lower() if w.isascii() else w.decode().lower().encode()) for w in new if w.isascii() or _PLAIN.fullmatch(w)} if _state["pieces"] else {}
    missing = set(chain.from_iterable(cut.values())).difference(memo)
    if missing:
        _remember_pieces(list(missing), memo)
    _remember([w for w in new if w not in cut], tokenizer, memo)
    memo.update([(w, b"".join(map(memo.__getitem__, pieces))) for w, pieces in cut.items() if len(pieces) != 1 or pieces[0] != w])
    end = END.to_bytes(4, "little")
    out = []
    for words, ids, gap in zip(lines, found, gaps):
        for k in gap:
            ids[k] = memo[words[k]]
        out.append(b"".join(ids) + end)
    for w in [w for words in (new, missing - new) for w in words if len(w) > _MEMO_CHARS]:
        del memo[w]
    most = words_held or _MEMO_WORDS
    if len(memo) > most:  # the words of these texts stay, so frequent ones are not tokenized again
        stay = {w: memo[w] for words in lines for w in words if w in memo}
        memo.clear()
        memo.update(stay if len(stay) <= most // 2 else {})
    return out


def id_type(path: str) -> str:
    """16-bit numbers hold all ids of a vocabulary of up to 65,536."""
    return "<u2" if _tokenizer(path)[0].get_vocab_size() <= 1 << 16 else "<u4"


def tokenized(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", words_held: int | None = None) -> DataFrame:
    """Pass one: key, part, inside (tokens of the part before this document), doc_tokens, ids (16-bit where the vocabulary fits)."""
    width = id_type(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        part, before = TaskContext.get().partitionId(), 0
        pa.default_memory_pool().release_unused()  # what a worker's earlier tasks, of other stages too, have left
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                rows = batch.slice(i, 512)
                ids = encoded([x or "" for x in rows.column(1).to_pylist()], path, words_held)
                n = np.array([len(x) // 4 for x in ids], np.int64)
                small = [np.frombuffer(x, "<u4").astype(width).tobytes() for x in ids]
                inside = before + np.cumsum(n) - n
                before += int(n.sum())
                yield pa.record_batch([rows.column(0), pa.array(np.full(len(n), part, np.int32)), pa.array(inside), pa.array(n), pa.array(small, pa.binary())], names=["key", "part", "inside", "doc_tokens", "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"key {kind}, part int, inside long, doc_tokens long, ids binary")


def _cut(batches: Iterator[pa.RecordBatch], width: str) -> Iterator[pa.RecordBatch]:
    forget()  # the words of pass one
    for batch in batches:
        begins, sizes, ids = (batch.column(i) for i in (1, 2, 3))
        row, start, length, crc, seq, off = [], [], [], [], [], []
        for k, (begin, size, raw) in enumerate(zip(begins.to_pylist(), sizes.to_pylist(), ids)):
            full = np.frombuffer(raw.as_buffer(), width).astype("<u4")
            at = 0
            while at < size:
                place = begin + at
                n = min(size - at, WINDOW - place % WINDOW)
                for to, v in ((row, k), (start, at), (length, n), (crc, zlib.crc32(full[at : at + n].tobytes())), (seq, place // WINDOW), (off, place % WINDOW)):
                    to.append(v)
                at += n
        at = pa.array(row, pa.int64())
        cols = [batch.column(0).take(at), *(pa.array(x, pa.int64()) for x in (start, length, crc)), sizes.take(at), *(pa.array(x, pa.int64()) for x in (seq, off))]
        yield pa.record_batch(cols, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])


def packed(docs: DataFrame, path: str | None = None, key: str = "doc_id", words_held: int | None = None) -> DataFrame:
    """The pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. words_held: how many words a worker remembers, a matter
    of memory and time only."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    rows = written(tokenized(docs, path, key, words_held=words_held), "tokens")
    sums = rows.groupBy("part").agg(F.sum("doc_tokens").alias("n"))  # one row for each task of pass one
    base = sums.select("part", (F.expr("sum(n) OVER (ORDER BY part)") - F.col("n")).alias("base"))
    placed = rows.join(F.broadcast(base), "part").select("key", (F.col("base") + F.col("inside")).alias("begin"), "doc_tokens", "ids")
    kind = docs.schema[key].dataType.simpleString()
    width = id_type(path)
    return placed.mapInArrow(lambda batches: _cut(batches, width), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
