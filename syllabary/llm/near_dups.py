"""Near-duplicate groups: HyperMinHash sketches, banding, collision-corrected estimates, exact verification, components.

1. Each text becomes its set of word shingles (64-bit hashes), a HyperMinHash sketch and the keys of the sketch's bands.
2. Equal sets are one class, by an aggregate over two 64-bit sums and the size; the smallest doc_id stands for it.
3. Members of a bucket (a band key that several classes share) meet in cells of bounded size. In a cell, sketches are compared as
   arrays, and pairs of different components whose estimate comes within ``SIGMAS`` standard errors of the threshold come out:
   each member's best one, after which most of a group of copies is one component. A pair is looked at in one cell alone.
4. In the second round the members outside the largest component of a bucket meet every member of it, in blocks against blocks, and
   every such pair comes out. So no pair that shares a band is left unseen unless both ends are linked already.
5. Pairs are verified on their full sets; links make components (``graphs``).

A link of similarity 0.85 shares none of the 25 bands of 5 registers once in two million times, and falls short of the estimate's
margin less than once in a hundred thousand.

doc_id is the vertex: rows that share one are linked, rows without one are linked with nothing. Null and empty texts have empty
sets and are linked with nothing. An empty table gives an empty result. Columns besides doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from syllabary.llm import shingles
from syllabary.llm.common import Scratch, text_of, together
from syllabary.llm.graphs import components

#: Members of a cell, and of a block of outsiders in the last round.
CELL, PROBES = 1024, 512
SIGMAS = 4.5

_SETS = "doc_id long, n long, ka long, kb long, bands array<long>, sketch binary"
_SETS_ARROW = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("ka", pa.int64()), ("kb", pa.int64()), ("bands", pa.list_(pa.int64())), ("sketch", pa.binary())])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for some in together(batch, 1):
            rows = []
            for doc_id, own in zip(some.column(0).to_pylist(), shingles.shingle_sets([x.encode() for x in some.column(1).to_pylist()]), strict=True):
                registers = shingles.sketch(own)
                sums = own.sum(dtype=np.uint64), shingles.mixed(own + np.uint64(1)).sum(dtype=np.uint64)
                ka, kb = np.array(sums, np.uint64).view(np.int64).tolist()
                rows.append({"doc_id": doc_id, "n": len(own), "ka": ka, "kb": kb, "sketch": registers.tobytes()})
            keys = shingles.band_keys(np.frombuffer(b"".join(r["sketch"] for r in rows), np.uint16).reshape(len(rows), -1)).view(np.int64)
            for row, own in zip(rows, keys, strict=True):
                row["bands"] = own[own != 0].tolist()
            yield pa.RecordBatch.from_pylist(rows, _SETS_ARROW)


_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _compare(similarity: float, most: int | None):
    """Cells (columns cell, part, probe, id, comp, n, sketch; sorted by cell and part) to candidate pairs.

    A pair is looked at in the cell of the first band that it shares, and in no other.
    """

    def cell(rows: list[tuple], key: int) -> tuple[np.ndarray, np.ndarray]:
        probe = np.array([r[0] for r in rows], bool)
        ids, comp, n = (np.array([r[k] for r in rows], np.int64) for k in (1, 2, 3))
        registers = np.frombuffer(b"".join(r[4] for r in rows), np.uint16).reshape(len(rows), -1)
        keys, own = shingles.band_keys(registers), np.array([key], np.int64).view(np.uint64)[0]
        target = np.flatnonzero(~probe)
        left, right = [], []
        for i in np.flatnonzero(probe) if most is None else range(len(rows)):
            near = target[(comp[target] != comp[i]) & (np.minimum(n[target], n[i]) >= similarity * np.maximum(n[target], n[i]) - 1e-9)]
            if len(near):
                shared = (keys[near] == keys[i]) & (keys[i] != 0)
                near = near[keys[i][shared.argmax(1)] == own]
            if not len(near):
                continue
            found, error = shingles.estimate(registers[near], registers[i], n[near], n[i])
            fit = np.flatnonzero(found >= similarity - SIGMAS * error)
            if most is not None and len(fit) > most:
                fit = fit[np.lexsort((ids[near[fit]], -found[fit]))[:most]]
            left.append(np.full(len(fit), ids[i]))
            right.append(ids[near[fit]])
        both = [np.concatenate(x) if x else np.empty(0, np.int64) for x in (left, right)]
        return np.minimum(*both), np.maximum(*both)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(7)]
            for c, part, *rest in zip(*columns, strict=True):
                if (c, part) != key:
                    if len(held) > 1:
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cell(held, key[0])], schema=_PAIRS)
                    held, key = [], (c, part)
                held.append(rest)
        if len(held) > 1:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cell(held, key[0])], schema=_PAIRS)

    return run


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in together(batch, 2, 3):
                a, b, left, right = (x.to_pylist() for x in some.columns)
                sets = shingles.shingle_sets([x.encode() for x in left + right])
                keep = []
                for k in range(len(a)):
                    both, union = shingles.jaccard_parts(sets[k], sets[len(a) + k])
                    keep.append(100 * both >= percent * union and union > 0)
                keep = np.array(keep, bool)
                yield pa.RecordBatch.from_arrays([pa.array(np.array(x, np.int64)[keep]) for x in (a, b)], schema=_PAIRS)

    return run


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``: one row a document; links have 100 * intersection >= percent * union."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-dups")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    sets = scratch.keep(plain.mapInArrow(_sets, _SETS), "sets")
    classes = sets.filter("n > 0 and doc_id is not null").groupBy("ka", "kb", "n").agg(F.min("doc_id").alias("rep"))
    classes = scratch.keep(classes, "classes")
    reps = classes.select(F.col("rep").alias("doc_id"), "ka").join(sets.select("doc_id", "ka", "n", "bands", "sketch"), ["doc_id", "ka"])
    reps = scratch.keep(reps.dropDuplicates(["doc_id", "ka"]), "reps")
    keyed = reps.select(F.explode("bands").alias("cell"), F.col("doc_id").alias("id"), "ka", "n")
    shared = keyed.groupBy("cell").agg(F.count("*").alias("size")).filter("size > 1")
    # The other side of this join and of those by cell below has a row a cell, so Spark splits a cell that is skewed.
    members = scratch.keep(keyed.join(shared, "cell"), "members")
    involved = members.select(F.col("id").alias("doc_id"), "ka").distinct()
    sketches = scratch.keep(reps.join(involved, ["doc_id", "ka"], "left_semi").select(F.col("doc_id").alias("id"), "ka", "sketch"), "sketches")
    scratch.drop("reps")
    texts = scratch.keep(plain.join(involved.select("doc_id").distinct(), "doc_id", "left_semi").distinct(), "texts")
    # A doc_id of several classes (rows of different texts) links them.
    several = sets.filter("n > 0 and doc_id is not null").groupBy("doc_id").agg(F.min("ka").alias("low"), F.max("ka").alias("high")).filter("low < high").select("doc_id")
    several = sets.join(several, "doc_id", "left_semi").join(classes, ["ka", "kb", "n"]).select("doc_id", "rep")
    least = several.groupBy(F.col("doc_id").alias("id")).agg(F.min("rep").alias("a"))
    links = scratch.keep(several.join(least, F.col("doc_id") == F.col("id")).filter("a < rep").select("a", F.col("rep").alias("b")), "links")
    roots = None
    for turn, most in enumerate((1, None)):
        labelled = members.withColumn("comp", F.col("id"))
        if roots is not None:
            labelled = members.join(roots, F.col("id") == F.col("node"), "left").withColumn("comp", F.coalesce("root", "id")).drop("node", "root")
        if turn:
            open_cells = labelled.groupBy("cell").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high").select("cell")
            labelled = scratch.keep(labelled.join(open_cells, "cell"), f"open-{turn}")
            scratch.drop("members")
        if most is not None:
            part = F.pmod(F.xxhash64("cell", "id", F.lit(turn)), F.ceil(F.col("size") / CELL))
            dealt = labelled.withColumn("probe", F.lit(False)).withColumn("part", part)
        else:
            dealt = _blocks(labelled)
        dealt = dealt.join(sketches, ["id", "ka"]).select("cell", "part", "probe", "id", "comp", "n", "sketch")
        dealt = dealt.repartition("cell", "part").sortWithinPartitions("cell", "part", "id")
        pairs = scratch.keep(dealt.mapInArrow(_compare(percent / 100, most), "a long, b long").distinct(), f"pairs-{turn}")
        left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("left"))
        right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("right"))
        both = pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right")
        found = both.mapInArrow(_verify(percent), "a long, b long")
        known = roots.select(F.col("root").alias("a"), F.col("node").alias("b")) if roots is not None else links
        roots = components(known.union(found), scratch, f"turn-{turn}")
        scratch.drop(f"pairs-{turn}")
    named = classes.join(roots, F.col("rep") == F.col("node"), "left").select("ka", "kb", F.col("n").alias("size"), F.coalesce("root", "rep").alias("component"))
    scratch.drop("open-1", "sketches", "texts", "links")
    own = sets.select("doc_id", "n", F.col("ka").alias("ka0"), F.col("kb").alias("kb0"))
    on = (F.col("ka0") == F.col("ka")) & (F.col("kb0") == F.col("kb")) & (F.col("n") == F.col("size")) & F.col("doc_id").isNotNull()
    out = own.join(named, on, "left")
    component = F.when(F.col("n") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _blocks(labelled: DataFrame) -> DataFrame:
    """Outsiders of each cell (not of its most frequent component), in blocks, against all its members, in blocks."""
    counts = labelled.groupBy("cell", "comp").agg(F.count("*").alias("c"))
    main = counts.groupBy("cell").agg(F.max(F.struct("c", "comp")).alias("most"), F.sum("c").alias("all"))
    main = main.select("cell", F.col("most.comp").alias("main"), F.greatest(F.ceil((F.col("all") - F.col("most.c")) / PROBES), F.lit(1)).alias("kp"), F.ceil(F.col("all") / CELL).alias("kt"))
    rows = labelled.join(main, "cell")
    own_p, own_t = (F.pmod(F.xxhash64("cell", "id", F.lit(salt)), F.col(k)) for salt, k in ((7, "kp"), (8, "kt")))
    number = lambda p, t: p * F.col("kt") + t
    every = lambda k: F.sequence(F.lit(0).cast("long"), F.col(k).cast("long") - 1)
    targets = rows.withColumn("part", F.explode(F.transform(every("kp"), lambda p: number(p, own_t)))).withColumn("probe", F.lit(False))
    probes = rows.filter("comp <> main").withColumn("part", F.explode(F.transform(every("kt"), lambda t: number(own_p, t)))).withColumn("probe", F.lit(True))
    return targets.unionByName(probes)
