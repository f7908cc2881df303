"""Language identification by Bayesian evidence fusion.

Four kinds of evidence multiply:

* the text: byte trigram likelihoods, learned from labelled texts.  Trigrams
  overlap, so n of them count as ``n / (1 + n / REACH)`` independent ones and a
  long text cannot drown the rest by its length alone;
* the declared markup language: how often each declaration stands over each
  language, since declarations are often templates;
* the address suffix, likewise;
* the host: P(language | host) smoothed towards its domain, and that towards
  all addresses.

The last three are sums of text posteriors by declaration, suffix, host and
domain: grouped aggregations that combine before the shuffle, joined back to
narrow rows.  A row's own text is taken out of the sums it is judged by.

A text's likelihood table is fitted on at most ``sample`` labelled texts, or one
of each language if those are more: the first by hash of each language.  All
else reads all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairwell.llm.batches import added, byte_texts
from pairwell.llm.common import text_of, written

#: Labelled texts the likelihoods are fitted on, at most.
SAMPLE = 20_000
BUCKETS = 1 << 16
REACH = 300.0
#: Rows that a smoothing prior weighs as much as.
PRIOR = 5.0
_CHUNK = 1 << 16


def _buckets(text: bytes) -> np.ndarray:
    """The bucket of each byte trigram, A-Z lowered, blanks at either end."""
    data = np.frombuffer(b" " + text.lower() + b" ", np.uint8).astype(np.uint32)
    if len(data) < 3:
        return np.zeros(0, np.int64)
    code = data[:-2] | data[1:-1] << 8 | data[2:] << 16
    return ((code * np.uint32(2654435769)) >> np.uint32(16)).astype(np.int64)


@dataclass
class Likelihoods:
    """Log likelihood of each trigram bucket under each language."""

    languages: list[str]
    table: np.ndarray

    def evidence(self, text: bytes) -> np.ndarray:
        total = np.zeros(len(self.languages))
        at = _buckets(text) if text else np.zeros(0, np.int64)
        for i in range(0, len(at), _CHUNK):
            total += self.table[at[i:i + _CHUNK]].sum(axis=0, dtype=np.float64)
        return total / (1.0 + len(at) / REACH)


def _quota(counts: list[int], sample: int) -> int:
    """The most texts a language may give for all together to be at most ``sample``; one at least."""
    left, quota = sample, 0
    for i, n in enumerate(sorted(counts)):
        quota = max(quota, left // (len(counts) - i))
        if n > quota:
            break
        left -= n
    return max(1, quota)


def _drawn(labels: DataFrame, counts: dict[str, int], sample: int) -> DataFrame:
    """(id, lang) of the first rows by hash of each language."""
    quota = _quota(list(counts.values()), sample)
    # Rows whose hash is beyond twice what the quota asks for cannot be among the
    # first, so no task sorts all rows of a frequent language.
    share = [(name, min(1.0, (2 * quota + 100) / n)) for name, n in counts.items()]
    shares = labels.sparkSession.createDataFrame(share, "lang string, share double")
    order = F.xxhash64("id")
    near = labels.join(F.broadcast(shares), "lang").filter(
        (F.col("share") >= 1) | (order / 2.0**64 + 0.5 < F.col("share"))).select("id", "lang").distinct()
    first = F.row_number().over(Window.partitionBy("lang").orderBy(order, "id"))
    return near.withColumn("first", first).filter(F.col("first") <= quota).select("id", "lang")


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Likelihoods:
    """Likelihoods of all languages with a labelled text; rows without a label or text do not count."""
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang")).filter(
        "id is not null and lang is not null and text <> ''")
    # One number per language.
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    names = sorted(counts)
    if not names:
        return Likelihoods(names, np.zeros((BUCKETS, 0), np.float32))
    chosen = _drawn(rows.select("id", "lang"), counts, sample)
    number = {name: i for i, name in enumerate(names)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, np.ndarray] = {}
        for batch in batches:
            for body, name in zip(byte_texts(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                if name not in tables:
                    tables[name] = np.zeros(BUCKETS, np.int64)
                tables[name] += np.bincount(_buckets(body), minlength=BUCKETS)
        for name, table in tables.items():
            bucket = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(bucket), number[name])), pa.array(bucket), pa.array(table[bucket])], ["lang", "bucket", "n"])

    learned = rows.join(F.broadcast(chosen), ["id", "lang"]).select("text", "lang").mapInArrow(
        count, "lang long, bucket long, n long")
    table = np.full((BUCKETS, len(names)), 0.5)
    # One number per bucket and language.
    for r in learned.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect():
        table[r.bucket, r.lang] += r.n
    table /= table.sum(axis=0)
    np.log(table, out=table)
    table -= table.mean(axis=1, keepdims=True)
    return Likelihoods(names, table.astype(np.float32))


def page_rows(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(id, text, declared, host, domain, suffix) of web pages."""
    body = text_of(html)
    tag = F.regexp_extract(body, r"(?is)<html\b([^>]*)>", 1)
    declared = F.lower(F.regexp_extract(tag, r"(?is)\blang\s*=\s*[\"']?\s*([A-Za-z]{2,3})(?![A-Za-z])", 1))
    seen = F.regexp_replace(body, r"(?is)<(script|style|nav)\b.*?</\1\s*>|<!--.*?-->", " ")
    plain = F.regexp_replace(F.regexp_replace(seen, r"(?s)<[^>]*>", " "), r"&[a-zA-Z]+;|&#\d+;|\s+", " ")
    host = F.lower(F.regexp_extract(text_of(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    named = F.when(~host.rlike(r"^[0-9.]*$"), host)
    return pages.select(
        F.col(key).alias("id"), F.trim(plain).alias("text"), F.nullif(declared, F.lit("")).alias("declared"),
        F.nullif(host, F.lit("")).alias("host"),
        F.nullif(F.regexp_extract(named, r"([^.]+\.[^.]+)\.?$", 1), F.lit("")).alias("domain"),
        F.nullif(F.regexp_extract(named, r"\.([^.]+)\.?$", 1), F.lit("")).alias("suffix"))


def text_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The same columns for plain texts: their source stands for the host."""
    none = F.lit(None).cast("string")
    return docs.select(
        F.col(key).alias("id"), F.col(text).alias("text"), none.alias("declared"),
        F.concat(F.lit("source "), F.col(source).cast("string")).alias("host"), none.alias("domain"), none.alias("suffix"))


def identify(rows: DataFrame, likelihoods: Likelihoods, keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep``, id, lang, probability, text_lang of rows as :func:`page_rows` makes them.

    Null and empty texts have no evidence of their own and are judged by the
    rest; missing declarations, hosts or suffixes are no evidence either way.
    Equal posteriors go to the language first in the alphabet.  Repeated rows
    are judged each.  Without languages, ``lang`` is null.
    """
    names = likelihoods.languages
    if not names:
        none = F.lit(None)
        return rows.select(*keep, "id", none.cast("string").alias("lang"), none.cast("double").alias("probability"),
                           none.cast("string").alias("text_lang"))
    shared = rows.sparkSession.sparkContext.broadcast(likelihoods)

    def work(cells: pa.Array) -> list[tuple]:
        out = []
        for body in byte_texts(cells):
            evidence = shared.value.evidence(body)
            share = np.exp(evidence - evidence.max())
            out.append((evidence.tolist(), (share / share.sum()).tolist()))
        return out

    kinds = ("declared", "suffix", "domain", "host")
    double = T.ArrayType(T.DoubleType())
    made = written(added(rows, "text", [("evidence", double), ("share", double)], work, [*keep, "id", *kinds]), "evidence")

    def sums(only: Column | None = None) -> Column:
        shares = [F.get("share", F.lit(i)) for i in range(len(names))]
        return F.array(*(F.sum(s if only is None else F.when(only, s)) for s in shares))

    joined = made
    for kind in kinds:
        totals = made.filter(F.col(kind).isNotNull()).groupBy(kind).agg(sums().alias(f"{kind}_sum"))
        joined = joined.join(totals, kind, "left")
    # Over all rows, and over those with a declaration or a suffix: a number per language.
    whole = made.agg(sums().alias("all_sum"), *(
        sums(F.col(k).isNotNull()).alias(f"{k}_all") for k in ("declared", "suffix"))).first().asDict()
    joined = joined.withColumns({c: F.array(*(F.lit(float(v or 0.0)) for v in vs)) for c, vs in whole.items()})

    def others(name: str, i: Column) -> Column:
        """The sum without this row's own part."""
        return F.greatest(F.get(name, i) - F.get("share", i), F.lit(0.0))

    def size(name: str) -> Column:
        return F.greatest(F.aggregate(name, F.lit(0.0), lambda a, b: a + b) - 1, F.lit(0.0))

    joined = joined.withColumns({f"{c}_n": size(f"{c}_sum") for c in ("all", *kinds)} | {
        f"{c}_all_n": size(f"{c}_all") for c in ("declared", "suffix")})

    def prior(i: Column) -> Column:
        whole = (others("all_sum", i) + PRIOR / len(names)) / (F.col("all_n") + PRIOR)
        domain = F.when(F.col("domain_sum").isNull(), whole).otherwise(
            (others("domain_sum", i) + PRIOR * whole) / (F.col("domain_n") + PRIOR))
        return F.when(F.col("host_sum").isNull(), domain).otherwise(
            (others("host_sum", i) + PRIOR * domain) / (F.col("host_n") + PRIOR))

    def told(kind: str, i: Column) -> Column:
        """P(what is told | language), smoothed towards how often it is told at all."""
        often = (F.col(f"{kind}_n") + 1) / (F.col(f"{kind}_all_n") + 2)
        given = (others(f"{kind}_sum", i) + PRIOR * often) / (others(f"{kind}_all", i) + PRIOR)
        return F.when(F.col(f"{kind}_sum").isNull(), F.lit(0.0)).otherwise(F.log(given))

    index = F.array(*(F.lit(i) for i in range(len(names))))
    logits = F.transform(index, lambda i: F.get("evidence", i) + F.log(prior(i)) + told("declared", i) + told("suffix", i))
    ranked = joined.select(*keep, "id", "evidence", logits.alias("logits"))
    best = F.array_max("logits")
    scale = F.aggregate(F.transform("logits", lambda x: F.exp(x - best)), F.lit(0.0), lambda a, b: a + b)
    labels = F.array(*map(F.lit, names))
    pick = lambda c: F.element_at(labels, F.array_position(c, F.array_max(c)).cast("int"))
    return ranked.select(
        *keep, "id", pick("logits").alias("lang"), (1.0 / scale).alias("probability"), pick("evidence").alias("text_lang"))
