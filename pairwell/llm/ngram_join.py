"""N-gram Jaccard join by prefix filters under several global token orders.

Two similar sets share a token among the first few of each, whatever the one
order all tokens stand in.  A candidate pair has to pass that filter under
every one of several orders before its sets are compared.

1. *Sample order.*  Tokens are hashes, so a set's least ones are a sample of it
   that is the same for all sets.  Of a longer prefix in this order, similar
   sets share not one but a known number of tokens (``head``).  Counting only
   heads, a third of all tokens, leaves sets that can have a partner at all.
2. *Rarity orders.*  Of those sets all tokens are counted.  The first order goes
   by count, the others by the binary size of the count; ties go by different
   hashes.  A prefix holds rare tokens under each of them, but not the same.
3. *Intersection.*  Pairs meet by a token of their prefixes and stay if the
   prefixes under every order share a token.  Only these are verified, on full sets.

Copies are one class from the start.  Members of a token's group are first held
against its smallest only, one pair each; what then is one component need not
meet again.  The rest meet by (token, size class): a set's unshared tokens bound
the sizes of its possible partners, so sets made from one template that are not
similar enough never come to the same key.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairwell.llm.batches import added, byte_texts
from pairwell.llm.common import release, written
from pairwell.llm.components import components
from pairwell.llm.shingles import mixed, shingle_set

#: Links need ``100 * intersection >= PERCENT * union``.
WORDS, PERCENT = 5, 80
#: A head is at least one in so many tokens of a set.
HEAD = 4
#: Token orders by rarity, each with a hash of its own for ties.
ORDERS = 3
_TURN = [np.uint64(int(x)) for x in np.random.Generator(np.random.Philox(11)).integers(1, 2**63, ORDERS)]
#: Tokens before a place that a row of a prefix carries, to count a pair where it first meets.
BEFORE = 64
#: Rows of a narrow table that go to one file at least.
FILE_ROWS = 1_000_000
#: Size classes grow by this share.
CLASS = 1.05


def prefix_length(n: int, percent: int) -> int:
    """Tokens of which a similar set shows at least one among its own."""
    return n - -(-percent * n // 100) + 1


def _digest(codes: np.ndarray) -> str:
    return hashlib.blake2b(codes.tobytes(), digest_size=12).hexdigest()


def heads(docs: DataFrame, key: str, text: str, words: int, percent: int) -> DataFrame:
    """(id, n, set_id, head, least): each set's first tokens, and how many of them must be shared."""
    fields = [("n", T.LongType()), ("set_id", T.StringType()), ("head", T.ArrayType(T.LongType())), ("least", T.IntegerType())]

    def work(cells: pa.Array) -> list[tuple]:
        rows = []
        for body in byte_texts(cells):
            codes = shingle_set(body, words)
            prefix = prefix_length(len(codes), percent)
            head = codes[:max(prefix, len(codes) // HEAD)]
            rows.append((len(codes), _digest(codes), head.view(np.int64), len(head) - prefix + 1))
        return rows

    return added(docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text")), "text", fields, work, ["id"])


def possible(made: DataFrame) -> DataFrame:
    """(id) of the sets whose heads share enough tokens with other heads, or with their copies."""
    tokens = made.select("id", F.explode("head").alias("token"))
    shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("often")).filter("often > 1").select("token")
    counts = tokens.join(shared.hint("shuffle_hash"), "token").groupBy("id").agg(F.count(F.lit(1)).alias("shared"))
    needed = made.groupBy("id").agg(F.min("least").alias("least"))
    return counts.join(needed, "id").filter("shared >= least").select("id")


def full_sets(docs: DataFrame, wanted: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """(id, codes) of the classes in ``wanted`` (first, set_id, node); id is the class's number.

    Rows of one key come together in the join, where repeats go.
    """
    rows = docs.select(F.col(f"`{key}`").alias("first"), F.col(f"`{text}`").alias("text")).join(
        wanted.hint("shuffle_hash"), "first").distinct()

    def work(cells: pa.Array) -> list[tuple]:
        made = (shingle_set(body, words) for body in byte_texts(cells))
        return [(_digest(codes), codes.view(np.int64)) for codes in made]

    sets = added(rows, "text", [("digest", T.StringType()), ("codes", T.ArrayType(T.LongType()))], work, ["set_id", "node"])
    return sets.filter("digest = set_id").select(F.col("node").alias("id"), "codes")


def ordered(tokens: np.ndarray, often: np.ndarray) -> list[np.ndarray]:
    """Places of the tokens under each global order."""
    size = np.frexp(often.astype(np.float64))[1]
    ties = [mixed(tokens ^ turn) for turn in _TURN]
    return [np.lexsort((ties[i], size if i else often)) for i in range(ORDERS)]


def prefixes(sets: DataFrame, percent: int, orders: int = ORDERS) -> DataFrame:
    """(id, n, alone, most, orders) of the sets that can still have a partner.

    ``alone`` counts the tokens of no other set: they come first in every order
    and help no pair.  ``most`` is the largest size of a partner that shares all
    others.  ``orders`` are the shared tokens of the prefix under each order.
    """
    tokens = sets.select("id", F.size("codes").alias("n"), F.explode("codes").alias("token"))
    often = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("often")).filter("often > 1")
    shared = tokens.join(often, "token").groupBy("id", "n").agg(F.collect_list(F.struct("token", "often")).alias("shared"))
    able = shared.filter(100 * F.size("shared") >= percent * F.col("n"))
    plain = able.select(
        "id", "n", F.transform("shared", lambda s: s["token"]).alias("tokens"), F.transform("shared", lambda s: s["often"]).alias("often"))
    fields = T.StructType([plain.schema["id"], *(T.StructField(c, T.LongType()) for c in ("n", "alone", "most")),
                           T.StructField("orders", T.ArrayType(T.ArrayType(T.LongType())))])

    def run(batches):
        for batch in batches:
            rows = {c: [] for c in ("n", "alone", "most", "orders")}
            for n, mine, counts in zip(*(batch.column(c) for c in ("n", "tokens", "often")), strict=True):
                n = n.as_py()
                # A set given twice has each token twice.
                tokens, one = np.unique(np.asarray(mine.values).astype(np.int64).view(np.uint64), return_index=True)
                alone = n - len(tokens)
                length = max(prefix_length(n, percent) - alone, 0)
                places = ordered(tokens, np.asarray(counts.values)[one])[:orders]
                rows["n"].append(n)
                rows["alone"].append(alone)
                rows["most"].append((n - alone) * (100 + percent) // percent - n)
                rows["orders"].append([tokens[p[:length]].view(np.int64) for p in places])
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *(pa.array(v, k) for v, k in zip(rows.values(), kinds, strict=True))],
                ["id", "n", "alone", "most", "orders"])

    return plain.mapInArrow(run, fields)


def passing(pairs: DataFrame, filters: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose prefixes share a token under every order."""
    first, second = (filters.select(F.col("id").alias(k), F.col("orders").alias(f"{k}_orders")) for k in ("a", "b"))
    joined = pairs.join(second, "b").join(first, "a")
    for i in range(ORDERS):
        joined = joined.filter(F.arrays_overlap(F.col("a_orders")[i], F.col("b_orders")[i]))
    return joined.select("a", "b")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` whose full sets are similar enough."""
    first, second = (sets.select(F.col("id").alias(k), F.col("codes").alias(f"{k}_codes")) for k in ("a", "b"))
    joined = pairs.join(second, "b").join(first, "a")
    common = F.size(F.array_intersect("a_codes", "b_codes"))
    union = F.size("a_codes") + F.size("b_codes") - common
    return joined.filter(100 * common >= percent * union).select("a", "b")


def stars(filters: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of each token's most central set with the token's others, under every order.

    The fewer tokens a set has to itself, the more of the others are like it:
    the text that copies were made from leads its copies.
    """
    rows = filters.select("id", "n", "alone", F.posexplode("orders").alias("order", "tokens")).select(
        "id", "n", "alone", "order", F.explode("tokens").alias("token"))
    lead = rows.groupBy("order", "token").agg(F.min(F.struct("alone", "id", "n")).alias("lead"))
    met = rows.join(lead, ["order", "token"]).filter(
        (F.col("lead.id") != F.col("id"))
        & (100 * F.least("n", "lead.n") >= percent * F.greatest("n", "lead.n")))
    return met.select(F.least("lead.id", "id").alias("a"), F.greatest("lead.id", "id").alias("b")).distinct()


def _size_class(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) / float(np.log(CLASS))).cast("int")


def across(filters: DataFrame, component: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that meet in the first order and keep its bounds.

    Of a pair the larger set (by size, then key) looks for the smaller in the
    size classes its bounds allow; the smaller shows the shorter prefix that
    serves partners of its own size or more.
    """
    n = F.col("n")
    placed = filters.join(component, "id", "left").select(
        "id", "n", "alone", "most", F.coalesce("component", "id").alias("component"),
        F.posexplode(F.col("orders")[0]).alias("at", "token"))
    # Tokens whose sets are of one component already have nothing to add.
    sizes = placed.groupBy("token", "component").agg(F.count(F.lit(1)).alias("rows"))
    main = sizes.groupBy("token").agg(
        F.max(F.struct("rows", "component")).alias("main"), F.count(F.lit(1)).alias("spans")
    ).filter("spans > 1").select("token", F.col("main.component").alias("main"))
    mine = placed.join(main, "token").groupBy("id", "n", "alone", "most", "component").agg(F.sort_array(F.collect_list(F.struct(
        (F.col("alone") + F.col("at")).alias("place"), "token", (F.col("component") == F.col("main")).alias("in_main")))).alias("steps"))
    steps = F.transform("steps", lambda c, i: F.struct(
        c["place"].alias("place"), c["token"].alias("token"), c["in_main"].alias("in_main"), (i <= BEFORE).alias("all_seen"),
        F.transform(F.slice("steps", F.greatest(i - BEFORE, F.lit(0)) + 1, F.least(F.lit(BEFORE), i)), lambda x: x["token"])
        .alias("before")))
    spread = written(mine.withColumn("step", F.explode(steps)).select("id", "n", "alone", "most", "component", "step.*"), "spread")
    short = n - F.ceil(2 * percent * n / (100 + percent)) + 1
    smaller = spread.filter((F.col("most") >= n) & (F.col("place") < short)).withColumn("class", _size_class(n))
    least = F.ceil(percent * n / 100)
    larger = spread.filter(F.col("most") >= least).withColumn(
        "class", F.explode(F.sequence(_size_class(least), _size_class(F.least(n, F.col("most"))))))
    # Sets of a token's largest component need not be held against each other: of a pair one is of another.
    pairs = _met(smaller.filter("not in_main"), larger, percent).unionByName(
        _met(smaller.filter("in_main"), larger.filter("not in_main"), percent))
    return pairs.distinct()


def _met(smaller: DataFrame, larger: DataFrame, percent: int) -> DataFrame:
    s, g = smaller.alias("s"), larger.alias("g")
    # What may be common: nothing before this place if all of that was seen to differ, this, and what follows.
    behind = [F.col(f"{x}.place") - F.col(f"{x}.alone") for x in "sg"]
    unseen = F.when(F.col("s.all_seen") & F.col("g.all_seen"), F.lit(0)).otherwise(F.least(*behind))
    common = unseen + F.least(F.col("s.n") - F.col("s.place"), F.col("g.n") - F.col("g.place"))
    met = s.join(g, (
        (F.col("s.token") == F.col("g.token")) & (F.col("s.class") == F.col("g.class"))
        & (F.col("s.component") != F.col("g.component"))
        & (F.struct("s.n", "s.id") < F.struct("g.n", "g.id"))
        & (100 * F.col("s.n") >= percent * F.col("g.n"))
        & (F.col("s.n") <= F.col("g.most")) & (F.col("g.n") <= F.col("s.most"))
        & ((100 + percent) * common >= percent * (F.col("s.n") + F.col("g.n")))
        & ~F.arrays_overlap("s.before", "g.before")))
    return met.select(F.least("s.id", "g.id").alias("a"), F.greatest("s.id", "g.id").alias("b"))


def _files(rows: DataFrame) -> int:
    """Files for a narrow table of no more rows than a written one; its footers tell their number."""
    return 1 + rows.count() // FILE_ROWS


def _let_go(spark: SparkSession) -> None:
    """Shuffle files of the steps written so far go: the driver's plans go in one collection, what they hold in the next.

    Without it the two passes over tokens and the texts of the candidates lie on disk together, about 1.6 times the input.
    """
    release(spark)
    release(spark)


def similar_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS,
                   percent: int = PERCENT) -> DataFrame:
    """One row per document: (key, n_shingles, component_id), the smallest key reachable by links.

    Null, empty and wordless texts have no shingles, and their own key as
    component.  Repeated rows are copies of each other.  Of rows that share a
    key but not a text each is grouped by its own text.  A null key cannot be
    linked, and its component is null.  An empty table gives an empty one.
    Texts are read whole, whatever their length; other columns are not read.
    """
    spark = docs.sparkSession
    made = written(heads(docs, key, text, words, percent), "heads")
    full, files = made.filter("n > 0 and id is not null"), _files(made)
    classes = written(full.groupBy("set_id").agg(F.min("id").alias("first")).withColumn(
        "node", F.monotonically_increasing_id()).coalesce(files), "classes")
    # One document stands for its class.
    wanted = written(classes.join(possible(full).withColumnRenamed("id", "first"), "first", "left_semi"), "possible")
    _let_go(spark)
    sets = written(full_sets(docs, wanted, key, text, words), "sets")
    _let_go(spark)
    filters = written(prefixes(sets, percent), "filters")
    links = written(verified(passing(stars(filters, percent), filters), sets, percent), "stars")
    component = components(links, _files(links)).select(F.col("node").alias("id"), "component")
    met = written(across(filters, component, percent), "met")
    more = written(verified(passing(met, filters), sets, percent), "more")
    linked = components(links.union(more), _files(links) + _files(more))

    joined = classes.join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = joined.groupBy("component").agg(F.min("first").alias("component_id"))
    named = joined.join(least, "component").select("set_id", "component_id")
    return made.select("id", "n", "set_id").join(named, "set_id", "left").select(
        F.col("id").alias(key), F.col("n").alias("n_shingles"),
        F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
