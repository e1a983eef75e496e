"""Mixing sources to target weights by pivotal dependent rounding.

Every source gets a target number of words; a document of it is wanted
``target / source size`` times, a whole number of copies and a fraction.  The
fractions are rounded by the pivotal method on words: of two documents with
fractional copies, mass moves at random from one to the other until one of
them is 0 or 1, and the other one goes on; expectations and the source's total
of words stay what they were.  Each group of a source's documents is worked
off in one pass over a stream and leaves at most one fractional document;
these residuals meet in groups of ``FAN`` at the next level of a reduction
tree until one is left for each source, which goes to the nearer whole number.  So
each source misses its target by half a document at most.

Groups are dealt out by a hash, so a hot source is many groups; the random
numbers depend on the seed and the ids only, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import WORD, quoted, spare, uniforms
from graphloom.scratch import Scratch

ROWS = 10_000  #: documents of a group at the first level, on average
FAN = 64  #: residuals of a group at each further level
WEIGHTS = (3.0, 1.0, 2.0)  #: of the sources in order, repeating
SHARE = 1.5  #: of all words that the mix takes
MOST = 2.0  #: times that a source, and a document, is taken at most
_OUT = "rank long, bucket long, doc_id long, tag long, size long, source_size long, target double, fraction double, copies int, done boolean"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, scratch: Scratch, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``source, rank, n, source_size, target`` from ``(source, size)``.

    Sources are ranked by code point, null last; their weights repeat.  Targets
    share ``share`` of all words by weight, but none exceeds ``most`` times its
    source: what is above goes to the others by weight until none is above.
    """
    sums = sized.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"))
    last = F.col("source").isNull()
    ranged = sums.repartitionByRange(last, "source").withColumn("part", F.spark_partition_id())
    ranged = scratch.save(ranged, "sources")
    before, offsets = 0, []
    for part, n in sorted(ranged.groupBy("part").count().collect()):
        offsets.append((part, before))
        before += n
    if not offsets:
        return ranged.select("source", F.lit(0).cast("long").alias("rank"), "n", "source_size", F.lit(0.0).alias("target"))
    offset = F.element_at(F.create_map(*[F.lit(x) for pair in offsets for x in pair]), F.col("part"))
    rank = (F.row_number().over(Window.partitionBy("part").orderBy(last, "source")) - 1 + offset).cast("long")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = scratch.save(ranged.withColumn("rank", rank).withColumn("weight", weight), "ranked")
    level, capped = 0.0, F.lit(False)
    total = float(ranked.agg(F.sum("source_size")).first()[0] or 0) * share
    while True:
        got = ranked.agg(F.sum(F.when(capped, most * F.col("source_size"))).alias("full"), F.sum(F.when(~capped, F.col("weight"))).alias("open")).first()
        if not got["open"]:
            break
        found = max(0.0, total - float(got["full"] or 0.0)) / got["open"]
        if found <= level:
            break
        level = found
        capped = most * F.col("source_size") <= F.lit(level) * F.col("weight")
    target = F.when(capped, most * F.col("source_size")).otherwise(F.lit(level) * F.col("weight"))
    return ranked.select("source", "rank", "n", "source_size", target.cast("double").alias("target"))


def transfer(f: float, s: float, g: float, t: float, u: float) -> tuple[float, float]:
    """Move words between two fractional documents (fractions f, g of sizes s, t) until one is 0 or 1."""
    up, down = min((1 - f) * s, g * t), min(f * s, (1 - g) * t)
    if u * (up + down) < down:
        f, g = (1.0, g - up / t) if (1 - f) * s <= g * t else (f + up / s, 0.0)
    else:
        f, g = (0.0, g + down / t) if f * s <= (1 - g) * t else (f - down / s, 1.0)
    return _snap(f), _snap(g)


def _snap(f: float) -> float:
    return 0.0 if f < 1e-12 else 1.0 if f > 1 - 1e-12 else f


def _round(batches: Iterator[pa.RecordBatch], level: int, seed: int) -> Iterator[pa.RecordBatch]:
    """One pass over rows sorted by group: all but at most one document of each group come out rounded."""
    names = None
    carry: list | None = None  # the group's fractional document
    for batch in batches:
        names = batch.schema.names
        ids = batch.column(2).fill_null(0).to_numpy(zero_copy_only=False).astype(np.uint64) + batch.column(3).fill_null(0).to_numpy(zero_copy_only=False).astype(np.uint64)
        draws = uniforms(ids * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed * 1_000_003 + level * 7919 + 1))
        out: list[list] = []
        for row, u in zip(zip(*(c.to_pylist() for c in batch.columns), strict=True), draws.tolist(), strict=True):
            row = list(row)
            if carry is not None and carry[:2] != row[:2]:
                out.append(carry)
                carry = None
            row[7] = _snap(row[7])
            if row[4] == 0:
                row[7] = float(u < row[7])
            if 0.0 < row[7] < 1.0:
                if carry is None:
                    carry = row
                    continue
                carry[7], row[7] = transfer(carry[7], carry[4], row[7], row[4], u)
                whole = [x for x in (carry, row) if x[7] in (0.0, 1.0)]
                out += whole
                carry = next((x for x in (carry, row) if 0.0 < x[7] < 1.0), None)
            else:
                out.append(row)
        yield _table(out, names)
    if carry is not None and names:
        yield _table([carry], names)


def _table(rows: list[list], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 6 + [pa.float64(), pa.float64(), pa.int32()]
    columns = [pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [()] * 9, kinds, strict=True)]
    f = columns[7].to_numpy(zero_copy_only=False)
    done = (f <= 0.0) | (f >= 1.0)
    copies = columns[8].to_numpy(zero_copy_only=False) + np.where(done, f, 0).astype(np.int32)
    return pa.RecordBatch.from_arrays([*columns[:7], pa.array(np.where(done, 0.0, f)), pa.array(copies.astype(np.int32)), pa.array(done)], [*names[:9], "done"])


def _reduced(todo: DataFrame, buckets: int, level: int, scratch: Scratch, seed: int) -> DataFrame:
    """All rows of ``todo`` with their copies: groups are rounded, residuals go up the tree."""
    parts = []
    while True:
        dealt = todo.repartition("rank", "bucket").sortWithinPartitions("rank", "bucket", "doc_id", "tag", "size")
        step = scratch.save(dealt.mapInArrow(partial(_round, level=level, seed=seed), _OUT), "rounded")
        parts.append(step.where("done"))
        left = step.where("not done").drop("done")
        if buckets <= 1:
            break
        buckets, level = -(-buckets // FAN), level + 1
        todo = left.withColumn("bucket", F.floor(F.col("bucket") / FAN).cast("long"))
    # one document of each source at most is left: the nearer whole number keeps the source nearest to its target
    parts.append(left.withColumn("copies", F.col("copies") + (F.col("fraction") >= 0.5).cast("int")))
    out = parts[0].drop("done")
    for p in parts[1:]:
        out = out.unionByName(p.select(out.columns))
    return out.select("doc_id", "tag", "size", "source_size", "target", "copies")


def _wanted() -> Column:
    """How often a source's documents are wanted."""
    return F.when(F.col("source_size") > 0, F.least(F.lit(MOST), F.col("target") / F.col("source_size"))).otherwise(0.0)


def rounded_copies(rows: DataFrame, scratch: Scratch, seed: int = 1) -> DataFrame:
    """``doc_id, tag, size, source_size, target, copies`` for rows of ``doc_id, tag, size, source``."""
    targets = scratch.save(source_targets(rows.select("source", "size"), scratch), "targets")
    wanted = _wanted()
    named = targets.withColumnRenamed("source", "of")
    todo = rows.join(named, F.col("source").eqNullSafe(F.col("of")))
    groups = F.ceil(F.col("n") / ROWS)
    todo = todo.select("rank", F.pmod(F.xxhash64("doc_id", "tag"), groups).cast("long").alias("bucket"), "doc_id", "tag", "size", "source_size", "target", (wanted - F.floor(wanted)).alias("fraction"), F.floor(wanted).cast("int").alias("copies"))
    most = targets.agg(F.max("n")).first()[0] or 0
    return _reduced(todo, -(-most // ROWS), 0, scratch, seed)


def mix(docs: DataFrame, seed: int = 1) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for every document.

    ``taken`` is the number of words the mix takes of the document, repeats
    counted: 0, 1 or 2 times its size.  Null and empty texts have size 0 and
    are taken as 0 words.  Null is a source of its own, the last.  Null ids and
    repeated rows are mixed like others; a source without words has target 0.
    Other columns are ignored; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    rows = docs.select("doc_id", F.lit(0).cast("long").alias("tag"), word_count(F.col("text")).alias("size"), "source")
    out = rounded_copies(scratch.save(rows, "sized"), scratch, seed)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def _round_in_place(batches: Iterator[pa.RecordBatch], seed: int, names: list[str], held: int = 10_000) -> Iterator[pa.RecordBatch]:
    """One pass over whole documents: rows come out with their copies as soon as these are known.

    Columns before the documents' own: key, draw, rank, size, fraction, copies; ``names`` are those of the marks before them in the result.
    A document of each source stays behind until a later one settles it; what
    is left at the end, or beyond ``held`` sources, comes out as open.
    """
    carried: dict[int, list] = {}  # by source: key, size, fraction, copies and the document as a batch of one row
    for batch in (whole.slice(at, 1000) for whole in batches for at in range(0, whole.num_rows, 1000)):
        draws, (key, rank, size) = batch.column(1).to_numpy().astype(np.uint64), (batch.column(i).to_pylist() for i in (0, 2, 3))
        fraction, copies = batch.column(4).to_pylist(), batch.column(5).to_pylist()
        u = uniforms(draws * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed * 1_000_003 + 1)).tolist()
        final: list[int | None] = [None] * batch.num_rows
        late: list[tuple[pa.RecordBatch, int]] = []
        here: dict[int, int] = {}  # by source: the row of this batch that it carries
        for r in range(batch.num_rows):
            f = _snap(fraction[r])
            if size[r] == 0:
                f = float(u[r] < f)
            if f in (0.0, 1.0):
                final[r] = copies[r] + int(f)
                continue
            fraction[r], source = f, rank[r]
            if source in here:
                q = here[source]
                fraction[q], fraction[r] = transfer(fraction[q], size[q], f, size[r], u[r])
                if fraction[q] in (0.0, 1.0):
                    final[q] = copies[q] + int(fraction[q])
                    del here[source]
            elif source in carried:
                old = carried[source]
                old[2], fraction[r] = transfer(old[2], old[1], f, size[r], u[r])
                if old[2] in (0.0, 1.0):
                    late.append((old[4], old[3] + int(old[2])))
                    del carried[source]
            if fraction[r] in (0.0, 1.0):
                final[r] = copies[r] + int(fraction[r])
            elif source not in here and source not in carried:
                here[source] = r
        for source, r in here.items():
            carried[source] = [key[r], size[r], fraction[r], copies[r], batch.take(pa.array([r])).select(batch.schema.names[6:])]
        chosen = [r for r, n in enumerate(final) if n is not None]
        yield _marked(batch.take(pa.array(chosen, pa.int64())).select(batch.schema.names[6:]), names, [(0, 0, 0, 0.0, final[r], False) for r in chosen])
        for row, n in late:
            yield _marked(row, names, [(0, 0, 0, 0.0, n, False)])
        while len(carried) > held:
            source = next(iter(carried))
            k, s, f, n, row = carried.pop(source)
            yield _marked(row, names, [(k, source, s, f, n, True)])
    for source, (k, s, f, n, row) in carried.items():
        yield _marked(row, names, [(k, source, s, f, n, True)])


def _marked(rows: pa.RecordBatch, names: list[str], marks: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.bool_()]
    columns = [pa.array(c, k) for c, k in zip(list(zip(*marks, strict=True)) or [()] * 6, kinds, strict=True)]
    return pa.RecordBatch.from_arrays([*columns, *rows.columns], [*names, *rows.schema.names])


_MARKS = ("key", "rank", "size", "fraction", "copies", "open")


def mixed_documents(docs: DataFrame, seed: int = 1, sources_at_once: int = 1_000_000) -> DataFrame:
    """The mix itself: each row as often as the mix takes it (0, 1 or 2 times), with all its columns.

    Texts are not shuffled: every partition rounds its own documents in one
    pass and leaves one open document of each source at most; only the open
    ones go up the reduction tree.  Targets are broadcast up to
    ``sources_at_once`` sources and joined by shuffle beyond.

    Null and empty texts have size 0 and are taken by the same fractions, each
    by its own draw.  Repeated rows and null ids are rows like others.  Reruns
    over the same files agree.  An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    size = word_count(F.col("text"))
    targets = scratch.save(source_targets(docs.select("source", size.alias("size")), scratch), "targets")
    few = targets.count() <= sources_at_once
    names = spare(docs.columns, *_MARKS, "of", "draw")
    key, rank, words, fraction, copies, open_, of, draw = names
    wanted = targets.select(F.col("source").alias(of), F.col("rank").alias(rank), _wanted().alias(fraction))
    told = docs.withColumn(words, size).join(F.broadcast(wanted) if few else wanted, F.col(of).eqNullSafe(docs["source"]))
    told = told.select(F.monotonically_increasing_id().alias(key), F.xxhash64("doc_id", "text").alias(draw), rank, words, (F.col(fraction) - F.floor(fraction)).alias(fraction), F.floor(fraction).cast("int").alias(copies), *quoted(docs.columns))
    schema = ", ".join([f"{key} long, {rank} long, {words} long, {fraction} double, {copies} int, {open_} boolean", *(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)])
    marked = scratch.save(told.mapInArrow(partial(_round_in_place, seed=seed, names=names[: len(_MARKS)]), schema), "marked")
    todo = marked.where(open_).select(F.col(rank).alias("rank"), F.floor(F.shiftright(F.col(key), 33) / FAN).cast("long").alias("bucket"), F.col(key).alias("doc_id"), F.lit(0).cast("long").alias("tag"), F.col(words).alias("size"), F.lit(0).cast("long").alias("source_size"), F.lit(0.0).alias("target"), F.col(fraction).alias("fraction"), F.col(copies).alias("copies"))
    todo = scratch.save(todo, "open")
    buckets = (todo.agg(F.max("bucket")).first()[0] or 0) + 1
    last = _reduced(todo, buckets, 1, scratch, seed).select(F.col("doc_id").alias(key), F.col("copies").alias(of))
    settled = marked.where(open_).join(last, key).withColumn(copies, F.col(of)).select(marked.columns)
    out = marked.where(~F.col(open_)).unionByName(settled).where(F.col(copies) > 0)
    return out.select(F.explode(F.sequence(F.lit(1), F.col(copies))).alias(of), *quoted(docs.columns)).select(quoted(docs.columns))
