"""Mixing sources to target weights: fixed-length blocks of words, drawn for output shards through index permutations.

The words of a source form one stream, cut into blocks of ``block_words``. An output shard takes the whole part of its expected
number of blocks from each source, and draws the sources of its remaining slots from the multinomial over the fractional parts.
The slots of a source are numbered across shards; slot k takes block perm(k mod blocks) of the source, under a new permutation
each time round, so a block comes at most as often as there are rounds. A permutation is eight rounds of swap-or-not, which
works on any number of blocks and needs no sort. Blocks and slots then meet in a join by (source, block index).

DataFrame functions only. Places in a stream come from prefix sums in three levels (documents in a bucket, buckets in a group,
groups of a source), so no window holds more than some hundreds or thousands of rows of a source, whatever its size.

Null texts and texts without words have size 0 and take part with nothing; null sources form one source, the last; a null doc_id
is a document like any other; repeated rows are documents of their own; an empty table gives an empty mix. A draw beyond
``repeats`` rounds of a source is void. Other columns are carried by ``taken_texts`` and ignored elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from syllabary.llm.common import WORD, Scratch, partitions, text_of

#: Documents of a bucket and buckets of a group, about.
BUCKET, GROUP = 512, 4096
#: Modulus of the arithmetic generators (prime) and their multipliers.
PRIME, STEP, TURN = 2147483647, 48271, 69621
ROUNDS = 8
#: Sources of a mix: each shard draws from all of them, and a row for each is broadcast. More are an error, never left out.
MOST_SOURCES = 20_000


def _draw(x: Column, key: Column) -> Column:
    """A pseudorandom integer below PRIME from two integers below it."""
    return ((x % PRIME * STEP + key) % PRIME * TURN + key * STEP) % PRIME


def streams(docs: DataFrame) -> DataFrame:
    """``doc_id, source, row_hash, size`` of every document, with its size in words."""
    return docs.select("doc_id", "source", _row_hash(docs).alias("row_hash"), F.regexp_count(text_of(), F.lit(WORD)).cast("long").alias("size"))


def _row_hash(docs: DataFrame) -> Column:
    return F.xxhash64(docs["doc_id"], docs["source"], docs["text"])


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, repeats: int, block_words: int) -> DataFrame:
    """One row a source: ``source, place, source_size, n_docs, weight, target, blocks, slots``.

    Sources stand in code point order, null last, and take the weights in turn. The targets share ``share`` of all words by
    weight and stop at ``repeats`` times a source's size; what exceeds that goes to the others by weight. Ordered by the level
    at which they stop, the level of those that do not is the largest of the levels that each prefix of stopped ones gives.
    """
    every = Window.orderBy(F.col("source").isNull(), "source")  # a row for each source: not the data, but its dictionary
    by_cap = Window.orderBy("stop", "place")
    whole = Window.partitionBy(F.lit(1))
    wheel = F.array(*[F.lit(w) for w in weights])
    rows = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    rows = rows.withColumn("place", (F.row_number().over(every) - 1).cast("long"))
    rows = rows.withColumn("weight", F.get(wheel, (F.col("place") % len(weights)).cast("int")).cast("double"))
    rows = rows.withColumn("cap", F.lit(float(repeats)) * F.col("source_size"))
    rows = rows.withColumn("stop", F.col("cap") / F.col("weight"))
    rows = rows.withColumn("wanted", F.lit(share) * F.sum("source_size").over(whole))
    before = F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("level", (F.col("wanted") - before) / rest)
    rows = rows.withColumn("target", F.least("cap", F.max("level").over(whole) * F.col("weight")))
    blocks = F.ceil(F.col("source_size") / block_words)
    rows = rows.withColumn("blocks", blocks.cast("long"))
    slots = F.when(F.col("source_size") > 0, F.col("target") * F.col("blocks") / F.col("source_size")).otherwise(0.0)
    return rows.select("source", "place", "source_size", "n_docs", "weight", "target", "blocks", slots.alias("slots"))


def placed(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """Every document with ``place`` of its source and ``first``, the words of the source before it."""
    own = F.broadcast(sources.select(F.col("source").alias("s"), "place", "n_docs"))  # a row for each source
    rows = sizes.join(own, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    key = F.pmod(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), F.lit(PRIME)) * STEP % PRIME
    rows = rows.withColumn("bucket", key % (1 + F.floor(F.col("n_docs") / BUCKET))).drop("n_docs")
    earlier = Window.unboundedPreceding, -1
    sums = rows.groupBy("place", "bucket").agg(F.sum("size").alias("n")).withColumn("group", F.floor(F.col("bucket") / GROUP))
    groups = sums.groupBy("place", "group").agg(F.sum("n").alias("n"))
    groups = groups.select("place", "group", F.coalesce(F.sum("n").over(Window.partitionBy("place").orderBy("group").rowsBetween(*earlier)), F.lit(0)).alias("base"))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("place", "group").orderBy("bucket").rowsBetween(*earlier)), F.lit(0))
    bases = sums.withColumn("inside", inside).join(groups, ["place", "group"]).select("place", "bucket", (F.col("base") + F.col("inside")).alias("base"))
    order = Window.partitionBy("place", "bucket").orderBy("doc_id", "size", "row_hash").rowsBetween(*earlier)
    rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(order), F.lit(0)))
    rows = rows.join(bases, ["place", "bucket"])
    return rows.select("doc_id", "source", "row_hash", "size", "place", (F.col("base") + F.col("inside")).alias("first"))


def draws(sources: DataFrame, shard_slots: int, repeats: int, seed: int) -> DataFrame:
    """``shard, place, round, block`` of every slot of the mix."""
    total = F.sum("slots")
    # One row: an array with an entry for each source.
    table = sources.filter("slots > 0").agg(
        F.array_sort(F.collect_list(F.struct("place", "blocks", "slots"))).alias("sources"),
        F.greatest(F.ceil(total / shard_slots), F.lit(1)).cast("long").alias("shards"),
    )
    parts = F.transform("sources", lambda s: s["slots"] / F.col("shards"))
    table = table.withColumn("fractions", F.transform(parts, lambda x: x - F.floor(x)))
    table = table.withColumn("left", F.round(F.aggregate("fractions", F.lit(0.0), lambda a, x: a + x)).cast("int"))
    sums = F.transform("fractions", lambda _, i: F.aggregate(F.slice("fractions", F.lit(1), i + 1), F.lit(0.0), lambda a, x: a + x))
    table = table.withColumn("ends", sums).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)))
    table = table.repartition(F.col("shard"))
    number = F.sequence(F.lit(1), F.col("left"))
    spun = F.transform(number, lambda i: _draw((F.col("shard") * 7919 + i) % PRIME, F.lit(seed)) / F.lit(float(PRIME)) * F.element_at("ends", -1))
    table = table.withColumn("spun", F.when(F.col("left") > 0, spun).otherwise(F.array().cast("array<double>")))
    low = lambda i: F.when(i > 0, F.get("ends", i - 1)).otherwise(0.0)
    drawn = lambda i: F.size(F.filter("spun", lambda u: (u >= low(i)) & (u < F.get("ends", i))))
    counts = F.transform("sources", lambda s, i: F.struct(s["place"], s["blocks"], (F.floor(s["slots"] / F.col("shards")) + drawn(i)).alias("n")))
    per_shard = table.select("shard", F.inline(counts))
    earlier = Window.partitionBy("place").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    per_shard = per_shard.withColumn("from", F.coalesce(F.sum("n").over(earlier), F.lit(0))).filter("n > 0")
    # A row becomes thousands of slots: they are dealt out by number, as the few bytes before would all go to one task.
    per_shard = per_shard.repartition(partitions(sources.sparkSession), "shard", "place")
    slots = per_shard.withColumn("k", F.explode(F.sequence(F.col("from"), F.col("from") + F.col("n") - 1)))
    slots = slots.filter(F.col("k") < F.col("blocks") * repeats)
    slots = slots.select("shard", "place", "blocks", F.floor(F.col("k") / F.col("blocks")).alias("round"), (F.col("k") % F.col("blocks")).alias("x"))

    def swap(x: Column, i: Column) -> Column:
        """One round: x and its mate change places, or do not, by a coin that both share."""
        key = (F.col("place") * 8191 + F.col("round") * 131 + (F.lit(seed) + i)) % PRIME
        mate = F.pmod(_draw(i + 1, key) - x, F.col("blocks"))
        coin = F.floor(_draw(F.greatest(x, mate), key) / 65536) % 2
        return F.when(coin == 1, mate).otherwise(x)

    # A fold keeps the rounds one small expression; eight nested ones would double at every round.
    rounds = F.sequence(F.lit(0).cast("long"), F.lit(ROUNDS - 1).cast("long"))
    return slots.select("shard", "place", "round", F.aggregate(rounds, F.col("x"), swap).alias("block"))


def pieces(documents: DataFrame, block_words: int) -> DataFrame:
    """What each document has in each block: ``place, block, first, word, n`` (``word``: the document's words before it)."""
    cut = F.sequence(F.floor(F.col("first") / block_words), F.floor((F.col("first") + F.col("size") - 1) / block_words))
    rows = documents.filter("size > 0").select("place", "first", "size", F.explode(cut).alias("block"))
    begin = F.greatest(F.col("first"), F.col("block") * block_words)
    end = F.least(F.col("first") + F.col("size"), (F.col("block") + 1) * block_words)
    return rows.select("place", "block", "first", (begin - F.col("first")).alias("word"), (end - begin).alias("n"))


class Mix:
    """The plan of a mix over ``doc_id, text, source``; ``spans`` are the slots' words, ``documents`` and ``sources`` the accounts."""

    def __init__(self, docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, repeats: int = 2, block_words: int = 128, shard_slots: int = 1 << 14, seed: int = 17):
        scratch = Scratch(docs.sparkSession, "mix")
        sizes = scratch.keep(streams(docs), "sizes")  # texts are read once
        self.sources = scratch.keep(targets(sizes, weights, share, repeats, block_words), "sources")
        if (n := self.sources.count()) > MOST_SOURCES:
            raise ValueError(f"{n} sources; a mix takes {MOST_SOURCES}: group them, as domains by kind")
        self.documents = scratch.keep(placed(sizes, self.sources), "documents")
        slots = draws(self.sources, shard_slots, repeats, seed)
        #: shard, place, round, block, first, word, n: words [word, word + n) of the document at ``first`` of source ``place``.
        # Slots look small to the planner, which sees them before they are numbered out; a sort-merge join never broadcasts them.
        self.spans = slots.hint("merge").join(pieces(self.documents, block_words), ["place", "block"])


def accounts(mix: Mix) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every document."""
    taken = mix.spans.groupBy("place", "first").agg(F.sum("n").alias("taken"))
    own = F.broadcast(mix.sources.select(F.col("place").alias("p"), "source_size", "target"))  # a row for each source
    docs = mix.documents.join(own, F.col("place") == F.col("p")).drop("p").withColumn("at", F.when(F.col("size") > 0, F.col("first")))
    taken = taken.select(F.col("place").alias("p"), F.col("first").alias("f"), "taken")
    joined = docs.join(taken, (F.col("place") == F.col("p")) & (F.col("at") == F.col("f")), "left")
    return joined.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def taken_texts(docs: DataFrame, mix: Mix) -> DataFrame:
    """Rows of ``docs`` (all its columns), one for each document and round in which words of it are taken, with those words.

    The text keeps the white space before each word but the first. Rows equal in doc_id, source and text
    take what each of their places in the stream takes.
    """
    names = docs.columns
    runs = mix.spans.groupBy("place", "first", "round").agg(F.array_sort(F.collect_list(F.struct("word", "n"))).alias("mix_runs"))
    runs = runs.select(F.col("place").alias("p"), F.col("first").alias("f"), "round", "mix_runs")
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")
    found = mix.documents.filter("size > 0").join(runs, (F.col("place") == F.col("p")) & (F.col("first") == F.col("f")))
    # Equal rows are told apart by their number among their equals. Documents and what is taken of them stand in one table, dealt
    # by (doc_id, row hash) once: two windows over that number them and hand each document's row to what is taken of it.
    key = lambda doc, h: (F.coalesce(doc.cast("long"), F.lit(-1)).alias("id0"), h.alias("h0"))
    found = found.select(*key(F.col("doc_id"), F.col("row_hash")), F.lit(1).alias("side"), "place", "first", "mix_runs", F.lit(None).cast(docs.select(row).schema["row"].dataType).alias("row"))
    marked = docs.select(*key(docs["doc_id"], _row_hash(docs)), F.lit(0).alias("side"), F.monotonically_increasing_id().alias("place"), F.lit(0).cast("long").alias("first"), F.lit(None).cast(found.schema["mix_runs"].dataType).alias("mix_runs"), row)
    both = marked.unionByName(found).repartition("id0", "h0")  # both windows need no other dealing
    both = both.withColumn("number", F.dense_rank().over(Window.partitionBy("id0", "h0", "side").orderBy("place", "first")))
    own = Window.partitionBy("id0", "h0", "number").orderBy("side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = both.withColumn("row", F.first("row", ignorenulls=True).over(own)).filter("side = 1")
    words = F.regexp_extract_all(F.col("row.text"), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    joined = both.withColumn("words", words)
    text = F.array_join(F.flatten(F.transform("mix_runs", lambda r: F.slice("words", (r["word"] + 1).cast("int"), r["n"].cast("int")))), "")
    joined = joined.select("row", F.regexp_replace(text, r"^[\x20\x09-\x0D]+", "").alias("taken_text"))
    out = [F.col("taken_text").alias(c) if c == "text" else F.length("taken_text").cast("long").alias(c) if c == "n_chars" else F.col(f"row.`{c}`").alias(c) for c in names]
    return joined.select(*out)
