"""Language ID: Bayesian fusion of what a page says, what its markup declares, its address suffix and its host.

Text: likelihoods under hashed letter trigrams, counted over all labelled documents (16,384 places for each language, whatever
the corpus). Declared language and host: grouped aggregation of the text's posteriors over all pages. A host's prior is
smoothed towards its domain's, that towards the address suffix's, and that towards all pages'; a page's own text is taken out
of all these sums and of those for its declared language, so no page is its own evidence twice. The logarithms add up; the
largest wins. Each language takes 64 KB of the table of likelihoods, and there are 26^2 + 26^3 codes at most.

Defined cases: null or empty html has no text evidence and takes the prior; a null or odd address has the host ''; documents
without a language code or text teach nothing; without any labelled document the answer is null; repeated rows count each; ties go
to the language first in code point order. Long pages are read whole.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import written

PLACES, TEMPER, TRUST = 1 << 14, 0.25, 5.0
#: A label is a language where it begins with a code of two or three letters, small or capital; a region after it is left out.
CODE = r"^([A-Za-z]{2,3})(?:[_\-].*)?$"
#: Second labels under which countries register hosts: such a domain has three labels (fixed values).
SECOND = ("ac", "co", "com", "edu", "go", "gov", "ne", "net", "or", "org")
_TABLE = np.zeros(0x110000, np.uint32)
_TABLE[:] = np.arange(0x110000, dtype=np.uint32)
_TABLE[65:91] += 32
_TABLE[:65] = _TABLE[91:97] = _TABLE[123:128] = 32  # all ASCII but letters is space


def trigrams(text: str) -> np.ndarray:
    """Places of the letter trigrams of a text, in which other characters are one space."""
    got = []
    for i in range(0, len(text), 1 << 20):
        cp = _TABLE[np.frombuffer((" " + text[max(0, i - 2) : i + (1 << 20)] + " ").encode("utf-32-le", "surrogatepass"), np.uint32)]
        keep = np.ones(len(cp), bool)
        keep[1:] = (cp[1:] != 32) | (cp[:-1] != 32)
        cp = cp[keep].astype(np.uint64)
        if len(cp) > 2:
            h = (cp[:-2] * np.uint64(0x9E3779B97F4A7C15) + cp[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) + cp[2:]
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
            got.append((h >> np.uint64(50)).astype(np.int64))
    return np.concatenate(got) if got else np.empty(0, np.int64)


def visible(page: str) -> str:
    """The text of a page: without tags, comments, scripts and styles, entities decoded. One pass from < to <.

    A comment ends at the first -->; one that never ends takes the rest of the page.
    """
    out, skip = [], ""
    for k, part in enumerate(re.sub(r"<!--.*?(?:-->|\Z)", "<!>", page, flags=re.S).split("<")):
        tag, closed, text = part.partition(">") if k else ("", ">", part)
        name = re.match(r"/?[A-Za-z]*", tag)[0].lower()
        if skip:
            if name != "/" + skip:
                continue
            skip = ""
        elif name in ("script", "style"):
            skip = name
            continue
        elif k and not re.match("[A-Za-z/!?]", part):  # no tag: the sign is text
            out.append(part)
            continue
        out.append(text if closed else "")
    return entities.unescape(" ".join(out))


def declared(page: str) -> str | None:
    """The language that the markup declares: lang of html, else a meta element; two or three letters, small."""
    m = re.search(r"<html\b[^<>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})\b", page, re.I) or re.search(r"<meta\b[^<>]*?\bcontent-language[^<>]*?content\s*=\s*[\"']?([A-Za-z]{2,3})\b", page, re.I)
    return m[1].lower() if m else None


def train(docs: DataFrame, lang: str = "lang", text: str = "text") -> tuple[list[str], np.ndarray]:
    """(languages, log likelihoods by language and place) from all labelled documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for code, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n = np.bincount(trigrams(x), minlength=PLACES)
                sums[code] = sums[code] + n if code in sums else n
        for code, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.record_batch([pa.array([code] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], names=["lang", "place", "n"])

    code = F.lower(F.regexp_extract(lang, CODE, 1))
    labelled = docs.where(F.col(lang).rlike(CODE) & F.col(text).isNotNull()).select(code.alias("lang"), text)
    codes = sorted(r[0] for r in labelled.select("lang").distinct().collect())  # bounded by the form of a code
    table = labelled.mapInArrow(run, "lang string, place int, n long").groupBy("lang", "place").agg(F.sum("n").alias("n")).toArrow()
    counts = np.full((len(codes), PLACES), 0.5)
    at = {c: i for i, c in enumerate(codes)}
    np.add.at(counts, ([at[c] for c in table["lang"].to_pylist()], table["place"].to_numpy()), table["n"].to_numpy())
    return codes, np.log(counts / counts.sum(1, keepdims=True)).astype(np.float32) if codes else counts


def _host(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def _sums(columns: int) -> Column:
    return F.array(*(F.sum(F.element_at("post", i + 1)) for i in range(columns)))


def identified(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """page_id, host, declared, lang, confidence, text_lang, prior_lang for each page."""
    codes, likely = train(docs)
    if not codes:
        none = F.lit(None).cast("string")
        return pages.select("page_id", _host(F.col("url")).alias("host"), none.alias("declared"), none.alias("lang"), F.lit(None).cast("double").alias("confidence"), none.alias("text_lang"), none.alias("prior_lang"))
    k = len(codes)
    shared = pages.sparkSession.sparkContext.broadcast(likely)

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said, logs, post = [], [], []
            for page in batch.column(2).to_pylist():
                t = trigrams(visible(page or ""))
                e = TEMPER * shared.value[:, t].sum(1)
                e -= e.max()
                said.append(declared(page or ""))
                logs.append(e.tolist())
                post.append((np.exp(e) / np.exp(e).sum()).tolist())
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(said, pa.string()), pa.array(logs, pa.list_(pa.float64())), pa.array(post, pa.list_(pa.float64()))], names=["page_id", "host", "declared", "logs", "post"])

    kind = pages.schema["page_id"].dataType.simpleString()
    rows = pages.select("page_id", _host(F.col("url")).alias("host"), "html").mapInArrow(evidence, f"page_id {kind}, host string, declared string, logs array<double>, post array<double>")
    rows = written(rows, "evidence")
    labels = F.split("host", r"\.")
    own = F.when((F.size(labels) > 2) & (F.length(F.element_at(labels, -1)) == 2) & F.try_element_at(labels, F.lit(-2)).isin(*SECOND), 3).otherwise(2)
    hosts = rows.groupBy("host").agg(_sums(k).alias("h"))
    hosts = hosts.withColumn("domain", F.array_join(F.slice(labels, F.greatest(F.size(labels) - own + 1, F.lit(1)), own), ".")).withColumn("suffix", F.element_at(labels, -1))
    add = lambda c: F.array(*(F.sum(F.element_at(c, i + 1)) for i in range(k)))
    domains = hosts.groupBy("domain", "suffix").agg(add("h").alias("d"))
    suffixes = domains.groupBy("suffix").agg(add("d").alias("s"))
    everything = np.array(written(suffixes, "suffixes").agg(add("s")).first()[0] or [0.0] * k)
    table = written(hosts.join(domains, ["domain", "suffix"]).join(suffixes, "suffix").select("host", "h", "d", "s"), "hosts")
    # at most 26^2 + 26^3 declared codes: a table of bounded size for the driver
    codes_said = {r["declared"]: np.array(r["c"]) for r in rows.where("declared IS NOT NULL").groupBy("declared").agg(_sums(k).alias("c")).toLocalIterator()}
    total = sum(codes_said.values(), np.zeros(k)) + 1.0

    def fused(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            logs, post, h, d, s = (np.array(batch.column(i).to_pylist(), float).reshape(n, k) for i in range(3, 8))
            said = batch.column(2).to_pylist()
            prior = np.maximum(everything - post, 0) + 1
            prior /= prior.sum(1, keepdims=True)
            for sums in (s, d, h):
                own = np.maximum(sums - post, 0)
                prior = (own + TRUST * prior) / (own.sum(1, keepdims=True) + TRUST)
            spoken = np.array([codes_said.get(c, total) for c in said]).reshape(n, k) - post  # without a declared language the ratio is the same for all
            spoken = np.log((np.maximum(spoken, 0) + 1.0 / (len(codes_said) + 1)) / np.maximum(total - post, 1e-9))
            spoken[[c is None for c in said]] = 0
            all_ = logs + np.log(prior) + spoken
            p = np.exp(all_ - all_.max(1, keepdims=True)) if n else all_
            p /= p.sum(1, keepdims=True)
            best = np.argmax(p, 1) if n else []
            name = lambda x: pa.array([codes[i] for i in (np.argmax(x, 1) if n else [])], pa.string())
            yield pa.record_batch([*(batch.column(i) for i in range(3)), pa.array([codes[i] for i in best], pa.string()), pa.array(np.round(p[np.arange(n), best], 6) if n else [], pa.float64()), name(logs), name(prior)], names=["page_id", "host", "declared", "lang", "confidence", "text_lang", "prior_lang"])

    joined = rows.join(table, "host").select("page_id", "host", "declared", "logs", "post", "h", "d", "s")
    return joined.mapInArrow(fused, f"page_id {kind}, host string, declared string, lang string, confidence double, text_lang string, prior_lang string")
