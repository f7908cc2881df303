"""Near copies by min-max hashing, confirmed on full shingle sets.

Each of 64 permutations gives two values of a document's shingle set, its
minimum and its maximum: 128 values for 64 hash evaluations per shingle.  32
bands of four values (two minima and two maxima of four permutations) bring two
documents of similarity 0.8 together with all but one chance in ten million.

Equal sets are one class from the start.  Within a band, members are linked to
the band's first by their true similarity, which costs one comparison a member.
Where a band still spans several components after that, its members are joined
exactly (``ngram_join.across``): shingles are ordered by rarity and the necessary
prefixes meet within size classes, so no link between different texts is lost, no
band is expanded into pairs, and documents of one template that are not similar
enough do not meet.

Every step is keyed by band, class, shingle or component.  No step gathers a
group in one place, and there are no caps.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairwell.llm.batches import added, byte_texts
from pairwell.llm.common import fresh, written
from pairwell.llm.components import components
from pairwell.llm.ngram_join import across, prefixes
from pairwell.llm.shingles import mixed, shingle_set

PERMUTATIONS, BANDS = 64, 32
#: Links need ``100 * intersection >= PERCENT * union``.
WORDS, PERCENT = 5, 80

_SEED = np.random.Generator(np.random.Philox(7))
_FLIP = _SEED.integers(0, 2**64, (PERMUTATIONS, 1), np.uint64)
_TIMES = _SEED.integers(0, 2**63, (PERMUTATIONS, 1), np.uint64) * np.uint64(2) + np.uint64(1)
#: Shingles permuted at once.
_STEP = 2048


def signature(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The minimum and the maximum of the set under each permutation."""
    low = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64)
    high = np.zeros(PERMUTATIONS, np.uint64)
    for at in range(0, len(codes), _STEP):
        moved = (codes[None, at:at + _STEP] ^ _FLIP) * _TIMES
        np.minimum(low, moved.min(axis=1), out=low)
        np.maximum(high, moved.max(axis=1), out=high)
    return low, high


def bands(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """One key per band, of two minima and two maxima of other permutations."""
    high = np.roll(high, -2)
    key = np.arange(1, BANDS + 1).astype(np.uint64)
    for part in (low[0::2], low[1::2], high[0::2], high[1::2]):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + part)
    return key.view(np.int64)


def sketches(docs: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """(id, n, set_id, bands) of each row: set size, a digest of the set, band keys."""
    fields = [("n", T.LongType()), ("set_id", T.StringType()), ("bands", T.ArrayType(T.LongType()))]

    def work(cells: pa.Array) -> list[tuple]:
        rows = []
        for body in byte_texts(cells):
            codes = shingle_set(body, words)
            name = hashlib.blake2b(codes.tobytes(), digest_size=12).hexdigest()
            rows.append((len(codes), name, bands(*signature(codes)) if len(codes) else None))
        return rows

    return added(docs.select(F.col(key).alias("id"), F.col(text).alias("text")), "text", fields, work, ["id"])


def _sets(docs: DataFrame, nodes: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """(id, codes) of the documents that ``nodes`` (id, set_id) names."""
    wanted = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(
        nodes.select("id").distinct().hint("shuffle_hash"), "id", "left_semi")

    def work(cells: pa.Array) -> list[tuple]:
        return [(shingle_set(body, words).view(np.int64),) for body in byte_texts(cells)]

    return added(wanted, "text", [("codes", T.ArrayType(T.LongType()))], work, ["id"]).filter(F.size("codes") > 0)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets are similar enough."""
    first, second = (sets.toDF(k, f"{k}_codes") for k in ("a", "b"))
    joined = pairs.join(second, "b").join(first, "a")
    common = F.size(F.array_intersect("a_codes", "b_codes"))
    union = F.size("a_codes") + F.size("b_codes") - common
    return joined.filter(100 * common >= percent * union).select("a", "b")


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS,
                percent: int = PERCENT) -> DataFrame:
    """One row per document: (key, n_shingles, component_id, kept).

    ``component_id`` is the smallest key reachable over links of at least
    ``percent`` per cent similarity, and ``kept`` marks that document.

    Null, empty and wordless texts have no shingles and are linked with
    nothing.  Rows that share a key count as one document.  A null key cannot
    be linked: its component is null, and it is kept; its copies with keys are
    grouped among themselves.  An empty table gives an empty one.  Very long texts
    are hashed in pieces between words.  Columns other than the two named are not read.
    """
    made = written(sketches(docs, key, text, words), "sketches")
    full = made.filter("n > 0 and id is not null")
    first = written(full.groupBy("set_id").agg(F.min("id").alias("first")), "classes")
    # One row per class: its first document, with that document's bands.
    nodes = full.join(first.withColumnRenamed("first", "id"), ["set_id", "id"], "left_semi")
    band = written(nodes.select("id", F.explode("bands").alias("band")), "bands")
    lead = band.groupBy("band").agg(F.min("id").alias("lead"))
    pairs = written(band.join(lead, "band").filter("lead <> id").select(
        F.col("lead").alias("a"), F.col("id").alias("b")).distinct(), "pairs")

    sets = written(_sets(docs, pairs.select(F.col("a").alias("id")).union(pairs.select("b")), key, text, words), "sets")
    links = written(_confirmed(pairs, sets, percent), "stars")
    component = components(links).select(F.col("node").alias("id"), "component")

    # Bands that still span several components.
    named = band.join(component, "id", "left").select("band", "id", F.coalesce("component", "id").alias("component"))
    spread = named.groupBy("band").agg(
        F.min("component").alias("least"), F.max("component").alias("most")).filter("least <> most")
    open_ids = written(named.join(spread, "band", "left_semi").select("id").distinct(), "open")
    rest = sets.join(open_ids, "id", "left_semi")
    found = written(across(prefixes(rest, percent, orders=1), component, percent), "found")
    more = written(_confirmed(found, sets, percent), "more")
    linked = components(links.union(more)).select(F.col("node").alias("first"), "component")

    classes = first.join(linked, "first", "left").select("set_id", F.coalesce("component", "first").alias("component"))
    return made.select("id", "n", "set_id").join(classes, "set_id", "left").select(
        F.col("id").alias(key), F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")).alias("component_id"),
        F.coalesce(F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")) == F.col("id"), F.lit(True)).alias("kept"))


def first_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS,
                  percent: int = PERCENT) -> DataFrame:
    """``docs`` without later near copies, with their own columns.

    Of repeated rows with one key all stay or go together.
    """
    name = fresh(docs.columns, "gone")
    gone = near_copies(docs, key, text, words, percent).filter("not kept").select(F.col(key).alias(name)).distinct()
    return docs.join(gone.hint("shuffle_hash"), docs[f"`{key}`"] == gone[name], "left_anti")
