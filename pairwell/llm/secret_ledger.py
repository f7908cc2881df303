"""Secret scans over an incremental ledger of blobs.

Every text is a blob named by its SHA-256.  The ledger lists the (blob, rules)
pairs already scanned; only unseen pairs are scanned, one text each however
many paths carry it, and findings go back to every path by join.

Matching is built-in regular expressions.  ``regexp_extract_all`` gives the
matches and ``split`` the text between them; their running lengths are the
places, in code points.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairwell.llm.common import text_of, written


@dataclass(frozen=True)
class Kind:
    """``pattern`` finds; a match counts if ``group`` of it has ``least`` characters."""

    name: str
    pattern: str
    least: int = 1
    group: int = 0


#: The three base kinds.  ``hex`` and ``access`` ask for their length in the
#: pattern: a run of one class, matched whole, has it or not.
BASE = (
    Kind("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2),
    Kind("access", r"AKIA[A-Z0-9]{12,}", 16),
    Kind("hex", r"[0-9a-f]{32,}", 32),
)
#: Further kinds, by their published formats.
MORE = (
    Kind("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Kind("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Kind("forge", r"gh[opsu]_[A-Za-z0-9]{36}"),
    Kind("hook", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
)
KINDS = (*BASE, *MORE)
RULES_VERSION = "1"
FINDING = "blob string, rules string, kind string, span_start long, span_end long"
LEDGER = "blob string, rules string"


def blob_of(text: str | Column) -> Column:
    """The content address of a text; null counts as empty."""
    return F.sha2(text_of(text).cast("binary"), 256)


def _pieces(body: Column, kind: Kind) -> Column:
    """For each match: its length, the gap before it, and whether it counts."""
    matches = F.regexp_extract_all(body, F.lit(kind.pattern), F.lit(0))
    gaps = F.split(body, kind.pattern, -1)
    part = (lambda m: F.regexp_extract(m, kind.pattern, kind.group)) if kind.group else (lambda m: m)
    return F.when(body.rlike(kind.pattern), F.transform(matches, lambda m, i: F.struct(
        F.lit(kind.name).alias("kind"), i.alias("place"), F.length(F.get(gaps, i)).alias("gap"),
        F.length(m).alias("size"), (F.length(part(m)) >= kind.least).alias("counts"))))


def scan(blobs: DataFrame, kinds: tuple[Kind, ...] = KINDS, rules: str = RULES_VERSION) -> DataFrame:
    """Findings in ``blobs`` (blob, body), one row per span, each once.

    Leftmost matches that do not overlap, per kind; spans are code points, end
    exclusive.  The running sum is per text and kind, so no group outgrows a
    text.
    """
    found = blobs.select("blob", F.explode(F.flatten(F.filter(
        F.array(*(_pieces(F.col("body"), k) for k in kinds)), lambda a: a.isNotNull()))).alias("f"))
    found = found.select("blob", "f.*").distinct()
    before = Window.partitionBy("blob", "kind").orderBy("place")
    end = F.sum(F.col("gap") + F.col("size")).over(before)
    return (
        found.withColumn("span_end", end.cast("long")).filter("counts")
        .select("blob", F.lit(rules).alias("rules"), "kind",
                (F.col("span_end") - F.col("size")).alias("span_start"), "span_end")
    )


def unseen(docs: DataFrame, ledger: DataFrame | None, rules: str = RULES_VERSION,
           key: str = "doc_id", text: str = "text") -> DataFrame:
    """One (blob, body) for every blob that the ledger has not under ``rules``.

    The first path of a blob is found from hashes alone; texts move once, by
    their own key, so copies by the thousand do not meet in one task.
    """
    rows = docs.select(F.col(key).alias("path"), text_of(text).alias("body"))
    named = rows.select("path", blob_of("body").alias("blob"))
    # A path without a key still names a blob; the pair (blob, path) finds its text.
    first = named.groupBy("blob").agg(F.min(F.struct(F.col("path").isNull().alias("none"), "path")).alias("at"))
    if ledger is not None:
        seen = ledger.filter(F.col("rules") == rules).select("blob").distinct()
        first = first.join(seen, "blob", "left_anti")
    first = first.select(F.col("blob").alias("first_blob"), F.col("at.path").alias("first_path"))
    texts = rows.withColumn("blob", blob_of("body"))
    return texts.join(
        first.hint("shuffle_hash"),
        F.col("path").eqNullSafe(F.col("first_path")) & (F.col("blob") == F.col("first_blob")),
        "left_semi",
    ).select("blob", "body")


def update(docs: DataFrame, ledger: DataFrame | None, kinds: tuple[Kind, ...] = KINDS,
           rules: str = RULES_VERSION, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """What to append to the two tables: (ledger entries, findings).

    Blobs without findings get a ledger entry too, so they are not scanned again.
    A null text is the empty blob; an empty or missing ledger has seen nothing;
    an empty delivery adds nothing.  Repeated rows are one blob.
    """
    entries = docs.select(blob_of(text).alias("blob")).distinct().select("blob", F.lit(rules).alias("rules"))
    if ledger is not None:
        entries = entries.join(ledger, ["blob", "rules"], "left_anti")
    return entries, scan(unseen(docs, ledger, rules, key, text), kinds, rules)


def deliver(deliveries: Iterable[DataFrame], ledger: DataFrame | None = None, findings: DataFrame | None = None,
            kinds: tuple[Kind, ...] = KINDS, rules: str = RULES_VERSION, key: str = "doc_id",
            text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(ledger, findings) after one delivery of texts after another.

    Each delivery is scanned for the (blob, rules) pairs that the ledger has not
    yet, and both tables grow by a written part: a delivery sent again, or texts
    known from earlier ones, cost no scan and give no finding twice.
    """
    for number, docs in enumerate(deliveries):
        entries, found = update(docs, ledger, kinds, rules, key, text)
        # Findings first: a ledger entry promises that its findings are there.
        found = written(found, f"findings-{number}")
        entries = written(entries, f"ledger-{number}")
        ledger = entries if ledger is None else ledger.unionByName(entries)
        findings = found if findings is None else findings.unionByName(found)
    return ledger, findings


def digests(findings: DataFrame, kinds: tuple[Kind, ...] = KINDS, base: tuple[Kind, ...] = BASE) -> DataFrame:
    """One row per blob with findings: counts, and the spans joined in order."""
    order = F.element_at(F.create_map(*(F.lit(x) for i, k in enumerate(kinds) for x in (k.name, i))), F.col("kind"))
    item = F.struct(
        F.col("span_start").alias("s"), order.alias("o"),
        F.concat_ws(":", "kind", "span_start", "span_end").alias("span"))
    names = [k.name for k in base]
    groups = findings.groupBy("blob").agg(
        *(F.sum((F.col("kind") == n).cast("long")).alias(f"n_{n}") for n in names),
        F.sort_array(F.collect_list(item)).alias("items"))
    in_base = F.filter("items", lambda x: x["o"] < len(base))
    return groups.select(
        "blob", *(f"n_{n}" for n in names),
        F.array_join(F.transform(in_base, lambda x: x["span"]), ",").alias("base_spans"),
        F.array_join(F.transform("items", lambda x: x["span"]), ",").alias("spans"))


def by_path(docs: DataFrame, findings: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Findings joined back: one row per row of ``docs``, copies included.

    A null or empty text has no findings.  Repeated rows give repeated rows, an
    empty table none; other columns are not read, so names cannot clash.
    """
    paths = docs.select(F.col(key).alias("path"), blob_of(text).alias("blob"))
    joined = paths.join(digests(findings), "blob", "left")
    zero = [F.coalesce(f"n_{k.name}", F.lit(0).cast("long")).alias(f"n_{k.name}") for k in BASE]
    return joined.select(
        F.col("path").alias(key), *zero,
        F.sha2(F.coalesce("base_spans", F.lit("")).cast("binary"), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"), "blob")
