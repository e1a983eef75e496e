"""Small helpers that several corpus operators share."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.scratch import Scratch

#: A word is a maximal run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")

_MUL1, _MUL2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: str) -> list[bytes]:
    """Words of a text with A-Z lower-cased, as UTF-8; bytes.split() splits on exactly x20 and x09-x0D."""
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (the finaliser of splitmix64), elementwise; wraps around."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _S30
    x *= _MUL1
    x ^= x >> _S27
    x *= _MUL2
    x ^= x >> _S31
    return x


def short_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Send whole texts to Python in batches of ``rows`` at most: lowers the session's setting, never raises it.

    A batch lies in memory several times, in the JVM and in Python; Spark's
    10,000 documents are tens of megabytes.  The batches change no result.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name, "10000") or 10_000)
    if not 0 < now <= rows:
        spark.conf.set(name, rows)


def give_back() -> None:
    """Return freed memory to the system: a Python worker lives on between tasks and stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def uniforms(seed: np.ndarray) -> np.ndarray:
    """Numbers in [0, 1) from 64-bit seeds."""
    return (mix64(seed) >> np.uint64(11)).astype(np.float64) * (1.0 / (1 << 53))


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """True for rows whose crc32 of the id as text falls in ``fold``; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def hash_sample(rows: DataFrame, rows_wanted: int, *keys: str) -> DataFrame:
    """About ``rows_wanted`` of the distinct rows, chosen by a hash of ``keys``; all if there are fewer.

    Each row decides for itself, so nothing but a count meets anywhere.
    """
    n = rows.count()
    if n <= rows_wanted:
        return rows.distinct()
    return rows.where(F.pmod(F.xxhash64(*keys), F.lit(1 << 40)) < int(rows_wanted / n * (1 << 40))).distinct()


def hash_sample_by(rows: DataFrame, rows_wanted: int, least: int, group: str, *keys: str) -> DataFrame:
    """As ``hash_sample``, but of every value of ``group`` about ``least`` rows at least, all if there are fewer, and never none."""
    whole, draw = 1 << 40, F.pmod(F.xxhash64(*keys), F.lit(1 << 40))
    counts = rows.groupBy(group).agg(F.count("*").alias("n"), F.min(draw).alias("first")).collect()  # one row a value
    n = sum(r["n"] for r in counts)
    if n <= rows_wanted:
        return rows.distinct()
    cut = int(rows_wanted / n * whole)
    own = {r[group]: max(min(whole, int(least / r["n"] * whole)), r["first"] + 1) for r in counts}
    rare = [F.lit(x) for value, k in own.items() if k > cut for x in (value, k)]
    limit = F.coalesce(F.try_element_at(F.create_map(*rare), F.col(group)), F.lit(cut)) if rare else F.lit(cut)
    return rows.where(draw < limit).distinct()


def spare(columns: Iterable[str], *names: str) -> list[str]:
    """The names, each with underscores before it until no column is called so (whatever its case)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(columns: Iterable[str]) -> list[Column]:
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


PIECE_BITS = 1 << 15  #: bits of a piece of a Bloom filter, which one bitmap aggregate holds
PIECES = 8192  #: pieces at most, 32 MB in all: enough for 26 million keys at 10 bits each
TESTS = 4  #: bits that a key sets in its piece


def split_by_keys(rows: DataFrame, key: Column, keys: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Rows whose key (a long) is surely none of ``keys``' only column, and those whose key may be one.

    The test is a Bloom filter, built by one aggregate for each of its pieces
    and broadcast: at most ``PIECES`` of ``PIECE_BITS`` bits.  With up to 26
    million keys about one row in a hundred is in the second part by chance,
    with more keys more, so a join of the second part is always exact and
    rows of the first need none.
    """
    (name,) = keys.columns
    pieces = max(1, min(PIECES, -(-keys.count() * 10 // PIECE_BITS)))
    h, piece, bits = spare(rows.columns, "h", "piece", "bits")
    mixed = lambda c: F.xxhash64(c, F.lit(1))
    part = lambda c: F.pmod(F.xxhash64(c), F.lit(pieces)).cast("int")
    bit = lambda c, i: F.shiftrightunsigned(mixed(c), 15 * i).bitwiseAND(F.lit(PIECE_BITS - 1))
    own = keys.select(part(F.col(name)).alias(piece), F.col(name).alias(h)).repartition(piece)
    own = own.select(piece, F.explode(F.array(*[bit(F.col(h), i) for i in range(TESTS)])).alias(bits))
    made = scratch.save(own.groupBy(piece).agg(F.bitmap_construct_agg(bits).alias(bits)), "filter")
    keyed = rows.withColumn(h, key)
    keyed = keyed.join(F.broadcast(made.withColumnRenamed(piece, f"{piece}_")), part(F.col(h)) == F.col(f"{piece}_"), "left")
    byte = lambda i: F.conv(F.hex(F.substring(bits, (F.shiftright(bit(F.col(h), i), 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    hit = F.lit(True)
    for i in range(TESTS):
        hit = hit & (F.getbit(byte(i), bit(F.col(h), i).bitwiseAND(F.lit(7)).cast("int")) == 1)
    hit = F.coalesce(hit, F.lit(False))
    return tuple(keyed.where(side).select(quoted(rows.columns)) for side in (~hit, hit))  # type: ignore[return-value]


HEAVY = 10_000  #: a key is heavy if more than one row in so many has it: there are fewer such keys than that


def join_per_key(rows: DataFrame, per: DataFrame, key: str, count: str, total: int, scratch: Scratch) -> DataFrame:
    """``rows`` joined with their key's row of ``per``, whose ``count`` tells how many of the ``total`` rows have the key.

    Heavy keys, fewer than ``HEAVY``, meet their rows by broadcast, so that no
    task gets all rows of one; the others are shuffled.
    """
    heavy = scratch.save(per.where(F.col(count) * HEAVY > total), "heavy")
    if not heavy.limit(1).count():
        return rows.join(per, key)
    light = rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(per.where(F.col(count) * HEAVY <= total), key)
    return rows.join(F.broadcast(heavy), key).unionByName(light)


def sorted_runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Regroup sorted batches so that no run of equal keys is cut; yields tables of whole runs.

    Only for runs that fit in memory: callers bound the length of a run.
    """
    rest: pa.Table | None = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([rest, t]).combine_chunks() if rest is not None else t
        if not t.num_rows:
            rest = None
            continue
        change = np.zeros(t.num_rows - 1, bool)
        for k in keys:
            v = t.column(k).to_numpy()
            change |= v[1:] != v[:-1]
        cuts = np.flatnonzero(change)
        last = int(cuts[-1]) + 1 if len(cuts) else 0
        if last:
            yield t.slice(0, last)
        rest = t.slice(last)
    if rest is not None and rest.num_rows:
        yield rest


def run_starts(columns: list[np.ndarray]) -> np.ndarray:
    """Offsets where a new run of equal keys begins."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    change = np.ones(len(columns[0]), bool)
    change[1:] = False
    for v in columns:
        change[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(change)
