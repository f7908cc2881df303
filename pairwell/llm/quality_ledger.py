"""Quality rules: a ledger of failure bits and measurements.

Every rule is evaluated once per document.  The ledger keeps the measurements
and one bit per failed rule; policies are masks over those bits, so a new
version of a policy, or an ablation, never reads a text again.

Words are runs of characters other than U+0020 and U+0009 to U+000D.  All of it
is built-in functions over one row: nothing is shuffled, and a text of any
length is one row's work.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwell.llm.common import SPACE, fresh, text_of

MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_chars_text",
)
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """A rule fails where ``fails`` holds over the measurements."""

    name: str
    bit: int
    fails: str


#: Ratios are products of whole numbers, so no rounding decides a document.
RULES = (
    Rule("few_words", 0, "n_words < 20"),
    Rule("repeated_windows", 1, "100 * n_repeat_words > 30 * n_words"),
    Rule("symbols", 2, "10 * n_symbols > n_words"),
    Rule("short_words", 3, "word_chars < 2 * n_words"),
    Rule("long_words", 4, "word_chars > 20 * n_words"),
    Rule("repeated_lines", 5, "n_lines >= 4 and 2 * n_dup_lines > n_lines"),
)
BASE = ("few_words", "repeated_windows")


@dataclass(frozen=True)
class Policy:
    """A version of what counts: the rules that reject a document."""

    version: str
    rules: tuple[str, ...] = field(default_factory=tuple)

    def mask(self, rules: tuple[Rule, ...] = RULES) -> int:
        bits = {r.name: r.bit for r in rules}
        return sum(1 << bits[name] for name in set(self.rules))


POLICIES = (
    Policy("base", BASE),
    Policy("v1", (*BASE, "short_words", "long_words", "repeated_lines")),
    Policy("v2", (*BASE, "symbols", "short_words", "long_words", "repeated_lines")),
)
PRODUCTION = POLICIES[-1]


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, and only when asked for."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _repeated_words(words: Column, hashes: Column) -> Column:
    """Words inside windows whose hash is found twice or more, each once.

    Windows are sorted by (hash, place); equal neighbours are repeats.  Their
    places, sorted, cover ``WINDOW`` words each, less where the next begins.
    """
    placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def covered(e: Column) -> Column:
        last = F.size(e) - 1
        twice = F.filter(e, lambda x, k: (
            ((k > 0) & (F.get(e, k - 1)["h"] == x["h"])) | ((k < last) & (F.get(e, k + 1)["h"] == x["h"]))
        ))
        return _let(F.sort_array(F.transform(twice, lambda x: x["i"])), lambda p: F.aggregate(
            F.transform(p, lambda at, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - at, F.lit(WINDOW)))),
            F.lit(0), lambda a, b: a + b))

    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(_let(placed, covered))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with one struct column of measurements; see :func:`ledger`."""
    def new(df: DataFrame, name: str) -> str:
        return fresh(df.columns, name)

    body = new(docs, "q_text")
    docs = docs.withColumn(body, text_of(text))
    words, lines = new(docs, "q_words"), new(docs, "q_lines")
    docs = docs.withColumns({
        # Only the first and last part can be empty: the text may begin or end with space.
        words: F.filter(F.split(body, f"{SPACE}+"), lambda w: w != ""),
        lines: F.filter(F.split(body, "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]")),
    })
    hashes = new(docs, "q_hashes")
    n = F.size(words)
    docs = docs.withColumn(hashes, F.when(n >= WINDOW, F.transform(
        F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW))
    )).otherwise(F.array().cast("array<bigint>")))
    values = {
        "n_words": F.size(words),
        "word_chars": F.length(F.array_join(words, "")),
        "n_symbols": F.length(body) - F.length(F.regexp_replace(body, r"[#*$%&|<>]", "")),
        "n_lines": F.size(lines),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": _repeated_words(F.col(words), F.col(hashes)),
        "n_chars_text": F.length(body),
    }
    out = new(docs, "q_measures")
    docs = docs.withColumn(out, F.struct(*(v.cast("long").alias(k) for k, v in values.items())))
    return docs.drop(body, words, lines, hashes).withColumnRenamed(out, fresh(
        [c for c in docs.columns if c not in (body, words, lines, hashes, out)], "measures"))


def fail_bits(measures: str, rules: tuple[Rule, ...] = RULES) -> Column:
    """The failure bits of a struct of measurements."""
    bits = F.lit(0).cast("long")
    for rule in rules:
        fails = F.expr(_qualified(rule.fails, measures))
        bits = bits.bitwiseOR(F.when(fails, F.lit(1 << rule.bit)).otherwise(F.lit(0)).cast("long"))
    return bits


def _qualified(condition: str, measures: str) -> str:
    return " ".join(f"`{measures}`.{w}" if w in MEASURES else w for w in condition.split())


def ledger(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: the key, all measurements and ``fail_bits``.

    Null and empty texts have no words: every count is 0, ``few_words`` fails.
    Repeated rows are measured each.  Other columns of ``docs`` are not read,
    so their names cannot clash; an empty table gives an empty ledger.
    """
    measured = measure(docs.select(F.col(key).alias("key"), F.col(text).alias("body")), "body")
    return measured.select(
        F.col("key").alias(key), "measures.*", fail_bits("measures").alias("fail_bits"))


def verdict(policy: Policy, bits: str | Column = "fail_bits") -> Column:
    """Whether a document passes: none of the policy's bits is set."""
    bits = F.col(bits) if isinstance(bits, str) else bits
    return bits.bitwiseAND(F.lit(policy.mask()).cast("long")) == 0


def keep(docs: DataFrame, policy: Policy = PRODUCTION, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass the policy, with their own columns."""
    measured = measure(docs, text)
    (name,) = set(measured.columns) - set(docs.columns)
    # A filter on a computed column would be pushed down and measure once per
    # rule; below an explode it cannot, and each row is measured once.
    passes = fresh(measured.columns, "passes")
    judged = measured.withColumn(passes, F.explode(F.array(verdict(policy, fail_bits(name)))))
    return judged.filter(F.col(passes)).select(*(F.col(f"`{c}`") for c in docs.columns))


def ablations(entries: DataFrame, policies: tuple[Policy, ...] = POLICIES) -> DataFrame:
    """What each rule of each policy costs, from a ledger alone.

    The ledger shrinks to one row per pattern of bits, of which there are at
    most two to the number of rules.  ``n_failed`` counts documents failing the
    rule, ``n_alone`` those that would be kept without it.
    """
    patterns = entries.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    rows = [(p.version, r.name, 1 << r.bit, p.mask()) for p in policies for r in RULES if r.name in p.rules]
    rules = F.array(*(F.struct(
        F.lit(v).alias("policy"), F.lit(r).alias("rule"), F.lit(b).cast("long").alias("bit"),
        F.lit(m).cast("long").alias("mask")) for v, r, b, m in rows))
    each = patterns.select("fail_bits", "n", F.explode(rules).alias("r"))
    masked = F.col("fail_bits").bitwiseAND(F.col("r.mask"))
    return each.groupBy("r.policy", "r.rule").agg(
        F.sum(F.when(masked.bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(masked == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_alone"),
        F.sum(F.when(masked == 0, F.col("n")).otherwise(0)).alias("n_kept"),
        F.bit_or("fail_bits").alias("bits_seen"),
    )
