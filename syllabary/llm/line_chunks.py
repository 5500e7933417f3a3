"""Line dedup by content-defined chunks of lines.

A document is cut into chunks of whole lines where a rolling hash over the hashes of the last two lines is divisible by
``divisor``, so the same run of lines is cut alike wherever it stands and inserted lines shift only the chunk they fall into. A
line of ``long_words`` words or more is a passage by itself: it closes the chunk before it and makes one of its own. A chunk is
eligible with two lines with a word or more, or when it is such a passage. An eligible chunk that occurs again, byte for byte, is
removed everywhere but at its first place, the smallest (doc_id, row hash, line).

Chunks alone miss most passages of several short lines, for a chunk must lie wholly inside the passage. With ``runs_over`` the
shortest runs of more than so many words, one from every line on and one up to every line, are eligible besides. Whatever run of
lines of more than ``runs_over`` words stands at an earlier place that it doesn't overlap, wherever it begins and however its lines
are laid out, is the union of such runs that stand there too; so all of it goes, and there are two rows a line, never pairs of places.
As such runs overlap, SHA-256 digests of runs and chunks are compared there, in place of their bytes.

DataFrame functions only. 64-bit hashes and lengths of chunks are counted first, and only chunks whose hash repeats travel with
their bytes for the comparison. No group is gathered: counts and first places are aggregates, and rows meet their group's
single row in an equi-join, in which chunks that are very common are salted.

Null and empty texts have no chunks and stay as they are; rows equal in doc_id and text lose the same lines (they count as one
place); a null doc_id comes before all others; an empty table gives an empty table; other columns are kept,
whatever their names, but one named ``removed_lines`` is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from syllabary.llm.common import WORD, Scratch, hot_keys, salted_join


def line_hash(line: Column) -> Column:
    """The first 32 bits of a line's MD5, which SQL engines agree on."""
    return F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("long")


def _chunk_spans(lines: Column, long_words: int, divisor: int) -> Column:
    """Chunks of an array of structs (h: line hash, words): array of (start, length, words, filled)."""
    last = F.size(lines) - 1
    at = F.sequence(F.lit(0), last)
    big = lambda i: F.get(lines, i)["words"] >= long_words
    hash_of = lambda i: F.get(lines, i)["h"]
    roll = lambda i: hash_of(i) * 31 + F.coalesce(F.get(lines, i - 1)["h"], F.lit(0))
    ends = F.filter(at, lambda i: (i == last) | big(i) | big(i + 1) | ((F.floor(roll(i) / 64) % divisor) == 0))
    starts = F.concat(F.array(F.lit(0)), F.transform(F.slice(ends, F.lit(1), F.size(ends) - 1), lambda e: e + 1))
    return F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("start"), (e - s + 1).alias("length")))


def chunk_places(docs: DataFrame, long_words: int, divisor: int, summed: bool = False) -> DataFrame:
    """``doc, row_hash, start, length, hash, bytes`` of every eligible chunk of ``doc_id, text``; ``summed``: with the hashes of ``run_places``."""
    rows = docs.select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("row_hash"), F.split("text", "\n").alias("parts")).filter("parts is not null")
    counted = F.transform("parts", lambda x: F.struct(line_hash(F.encode(x, "UTF-8")).alias("h"), F.regexp_count(x, F.lit(WORD)).alias("words")))
    rows = rows.withColumn("lines", counted).withColumn("spans", _chunk_spans(F.col("lines"), long_words, divisor))

    def eligible(s: Column) -> Column:
        filled = F.size(F.filter(F.slice("lines", s["start"] + 1, s["length"]), lambda x: x["words"] > 0))
        return (filled >= 2) | ((s["length"] == 1) & (F.get("lines", s["start"])["words"] >= long_words))

    def measured(s: Column) -> Column:
        own = F.slice("parts", s["start"] + 1, s["length"])
        hashes = F.transform(own, lambda x: F.shiftrightunsigned(F.xxhash64(x), 24))
        text = F.array_join(own, "\n")
        total = F.xxhash64(F.aggregate(hashes, F.lit(0).cast("long"), lambda a, x: a + x), s["length"]) if summed else F.xxhash64(text)
        return F.struct(s["start"].alias("start"), s["length"].alias("length"), total.alias("hash"), F.octet_length(text).alias("bytes"))

    # Chunks are measured inside of their document, so that no row of a chunk carries its lines.
    return rows.select("doc", "row_hash", F.inline(F.transform(F.filter("spans", eligible), measured)))


def run_places(docs: DataFrame, over: int) -> DataFrame:
    """``doc, row_hash, start, length, hash, bytes`` of the shortest runs of more than ``over`` words from and up to every line.

    ``hash`` is a sum over the lines, so that running totals give it for every run; equal runs have equal hashes and bytes.
    """
    rows = docs.select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("row_hash"), F.monotonically_increasing_id().alias("row"), F.split("text", "\n").alias("parts"))
    rows = rows.filter("parts is not null").select("doc", "row_hash", "row", F.posexplode("parts").alias("line", "body"))
    # 40 bits a line: the totals of eight million lines stay within 63.
    own = {"words": F.regexp_count("body", F.lit(WORD)).cast("long"), "h": F.shiftrightunsigned(F.xxhash64("body"), 24), "bytes": F.octet_length("body") + F.lit(1).cast("long")}
    rows = rows.select("doc", "row_hash", "row", "line", *[c.alias(k) for k, c in own.items()])
    text = Window.partitionBy("doc", "row_hash", "row")
    upto = text.orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.select("*", *[F.sum(k).over(upto).alias(f"{k}_to") for k in own]).select("*", *[(F.col(f"{k}_to") - F.col(k)).alias(f"{k}_at") for k in own])
    # All totals grow with the line, so the largest of a frame are those of its last line and the least those of its first.
    after = text.orderBy("words_at").rangeBetween(Window.currentRow, over)
    before = text.orderBy("words_to").rangeBetween(-over, Window.currentRow)
    rows = rows.select("*", F.max("line").over(after).alias("stop"), *[F.max(f"{k}_to").over(after).alias(f"{k}_stop") for k in own])
    rows = rows.select("*", F.min("line").over(before).alias("begin"), *[F.min(f"{k}_at").over(before).alias(f"{k}_begin") for k in own])

    def run(start: str, length: Column, h: Column, size: Column) -> Column:
        return F.struct(F.col(start).alias("start"), length.cast("int").alias("length"), F.xxhash64(h, length.cast("int")).alias("hash"), (size - 1).cast("int").alias("bytes"))

    there = F.col("words_stop") - F.col("words_at") > over
    back = (F.col("words_to") - F.col("words_begin") > over) & (F.col("words_at") - F.col("words_begin") > over)  # else it is the one from its first line
    forward = run("line", F.col("stop") - F.col("line") + 1, F.col("h_stop") - F.col("h_at"), F.col("bytes_stop") - F.col("bytes_at"))
    backward = run("begin", F.col("line") - F.col("begin") + 1, F.col("h_to") - F.col("h_begin"), F.col("bytes_to") - F.col("bytes_begin"))
    return rows.select("doc", "row_hash", F.inline(F.array_compact(F.array(F.when(there, forward), F.when(back, backward)))))


_ROW = ["id0", "no_id", "h0"]


def _row(doc: Column, text_hash: Column) -> tuple[Column, Column, Column]:
    """What rows of one document share, as keys that a join can hash: no id is another key than any id."""
    return F.coalesce(doc.cast("long"), F.lit(0)).alias("id0"), doc.isNull().alias("no_id"), text_hash.alias("h0")


def remove_repeats(docs: DataFrame, long_words: int = 50, divisor: int = 4, runs_over: int | None = None) -> DataFrame:
    """``docs`` without repeated chunks, and with ``runs_over`` without repeated runs of more words: its columns with the new
    ``text`` (and ``n_chars``, where there is one), and ``removed_lines``, the numbers of the lines removed, counted from 0."""
    scratch = Scratch(docs.sparkSession, "line-chunks")
    names = [c for c in docs.columns if c != "removed_lines"]
    chunks = chunk_places(docs, long_words, divisor, summed=runs_over is not None)
    places = scratch.keep(chunks if runs_over is None else chunks.unionByName(run_places(docs, runs_over)), "places")
    # A hash with one place alone, in however many equal rows, is no repeat.
    place = F.xxhash64("doc", F.col("doc").isNull(), "row_hash", "start")
    counted = places.groupBy("hash", "bytes").agg(F.count("*").alias("n"), F.min(place).alias("low"), F.max(place).alias("high"))
    again = scratch.keep(counted.filter("low < high").select("hash", "bytes", "n"), "again")
    hot = hot_keys(again, "hash", places.count())
    found = salted_join(places, again.drop("n"), ["hash", "bytes"], "hash", hot, ["doc", "row_hash", "start"])
    suspects = found.groupBy("doc", "row_hash").agg(F.collect_set(F.struct("start", "length", "hash")).alias("found"))
    # The bytes of the suspects alone: one shuffle of the texts against the documents that hold any. Sort-merge at every size: how
    # many documents are suspect grows with the input, so none of these sides is broadcast.
    texts = docs.select(*_row(F.col("doc_id"), F.xxhash64("text")), "text")
    held = texts.hint("merge").join(suspects.select(*_row(F.col("doc"), F.col("row_hash")), "doc", "found"), _ROW)

    def cut(f: Column) -> Column:
        chunk = F.array_join(F.slice("parts", f["start"] + 1, f["length"]), "\n")
        # Runs overlap: their bytes would be many times the text's.
        return F.struct(f["start"].alias("start"), f["length"].alias("length"), f["hash"].alias("hash"), (chunk if runs_over is None else F.unhex(F.sha2(chunk, 256))).alias("chunk"))

    held = held.withColumn("parts", F.split("text", "\n")).select("doc", "h0", F.inline(F.transform("found", cut)))
    held = scratch.keep(held, "held")
    scratch.drop("places")
    at = F.struct("doc", "h0", "start")
    groups = held.groupBy("hash", "chunk").agg(F.min(at).alias("first"), F.max(at).alias("last"))
    groups = groups.filter(~F.col("first").eqNullSafe(F.col("last"))).drop("last")
    later = salted_join(held, groups, ["hash", "chunk"], "hash", hot, ["doc", "h0", "start"])  # equal hash and equal bytes
    # The first place stays, and so does what overlaps it: of a line that is said on and on, one passage is left.
    same = F.struct("doc", "h0").eqNullSafe(F.struct("first.doc", "first.h0"))
    later = later.filter(~(same & (F.col("start") < F.col("first.start") + F.col("length"))))
    gone = later.groupBy(*_row(F.col("doc"), F.col("h0"))).agg(F.collect_set(F.struct("start", "length")).alias("gone"))
    gone = scratch.keep(gone, "gone")
    scratch.drop("held", "again")
    rows = docs.select(*_row(F.col("doc_id"), F.xxhash64("text")), F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    rows = rows.hint("merge").join(gone, _ROW, "left")
    numbers = F.array_sort(F.array_distinct(F.flatten(F.transform("gone", lambda g: F.sequence(g["start"], g["start"] + g["length"] - 1)))))
    rows = rows.withColumn("numbers", F.coalesce(numbers, F.array().cast("array<int>")))
    rows = rows.withColumn("parts", F.when(F.size("numbers") > 0, F.split("row.text", "\n")))
    stay = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), "numbers")
    text = F.when(F.size("numbers") == 0, F.col("row.text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get("parts", i)), "\n"))
    rows = rows.withColumn("left_text", text)
    out = [F.col("left_text").alias(c) if c == "text" else F.when(F.size("numbers") == 0, F.col("row.n_chars")).otherwise(F.length("left_text")).cast("long").alias(c) if c == "n_chars" else F.col(f"row.`{c}`").alias(c) for c in names]
    return rows.select(*out, F.col("numbers").alias("removed_lines"))
