"""Groups of near-duplicate records: multi-index Hamming join on weighted signatures, exact check, components."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollmill.llm.components import connected_components
from rollmill.llm.bitmap import bitmap, with_maybe
from rollmill.plans.store import discard, stored_bytes, tidy, written

#: Slots of the hashed document-frequency table (four bits each in the broadcast: 4 MB).
SLOTS = 1 << 23
#: An element in 1 / 2 ** q of the texts has the weight 2 ** (SLOPE * q), q being MOST_CODE at most. The steeper, the smaller the
#: buckets, but the more a signature hangs on the few rarest elements of a text.
MOST_CODE, SLOPE = 10, 0.75
#: Chunks of a signature, and bits that are set in each.
CHUNKS, SET_BITS = 6, 4
#: The chunks are filed and joined in so many rounds. The index rows of one round only are on disk at a time; each round reads the classes again.
ROUNDS = 2
#: Signatures closer than this (in bits) have, by the pigeonhole principle, a chunk with at most one error (two bits).
REACH = 4 * CHUNKS
#: Bits of the folded signature that is compared when two chunks meet, in words of 64.
FOLD_WORDS = 2
#: The least threshold at which texts that are linked, but not equal, share three elements.
LEAST_THRESHOLD = 0.75

#: Bytes of an index row, and of such rows that a task of the join should read of one side; most partitions of that shuffle.
KEY_BYTES, TASK_BYTES, MOST_TASKS = 36, 4 << 20, 20_000

_GOLD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _MIX
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _lists(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word hashes to a set of elements (the k-th copy of a word is an element of its own) and its fingerprint."""
    for batch in batches:
        lists = batch.column(1)
        lengths = np.asarray(lists.value_lengths().fill_null(0), dtype=np.int64)
        flat = np.asarray(lists.flatten()).view(np.uint64)
        doc = np.repeat(np.arange(len(lengths)), lengths)
        order = np.lexsort((flat, doc))
        flat = flat[order]
        place = np.arange(len(flat))
        first = np.ones(len(flat), bool)
        first[1:] = (flat[1:] != flat[:-1]) | (doc[1:] != doc[:-1])
        copy = (place - np.maximum.accumulate(np.where(first, place, 0))).astype(np.uint64)
        elements = np.where(copy == 0, flat, _mix(flat + copy * _GOLD))
        ends = np.cumsum(lengths)
        sums = []
        for salt in (1, 2):
            run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(elements ^ _mix(np.full(1, salt, np.uint64))), dtype=np.uint64)])
            sums.append((run[ends] - run[ends - lengths]).view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sums[0]), pa.array(sums[1]), pa.array(lengths.astype(np.int32)), _lists(elements, lengths)], names=["id", "f1", "f2", "n", "e"])


def _planes(df: DataFrame) -> np.ndarray:
    """Code of every slot: 0 for slots met in fewer than two texts, else 1 + its rareness. At most 4 MB are collected."""
    codes = np.zeros(SLOTS, np.uint8)
    bits = df.select("slot", F.explode(F.array_compact(F.array(*[F.when(F.col("code").bitwiseAND(F.lit(1 << i)) != 0, F.lit(i)) for i in range(4)]))).alias("plane"))
    at = F.col("slot") + F.lit(1)
    rows = bits.groupBy("plane", F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("map")).collect()
    for r in rows:
        got = np.unpackbits(np.frombuffer(bytes(r.map), np.uint8), bitorder="little")
        start = (r.bucket - 1) * len(got)
        codes[start : start + len(got)] |= got[: SLOTS - start] << r.plane
    return codes


def _folded(flat: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """The parity signature of all elements of each text, folded to FOLD_WORDS words."""
    bit, ends, out = _mix(flat ^ np.uint64(77)), np.cumsum(size), []
    for w in range(FOLD_WORDS):
        here = (bit >> np.uint64(6)) % np.uint64(FOLD_WORDS) == w
        own = np.where(here, np.uint64(1) << (bit & np.uint64(63)), np.uint64(0))
        run = np.concatenate([np.zeros(1, np.uint64), np.bitwise_xor.accumulate(own)]) if len(own) else np.zeros(1, np.uint64)
        out.append(run[ends] ^ run[ends - size])
    return out


def _chunk(flat: np.ndarray, doc: np.ndarray, weight: np.ndarray, total: np.ndarray, number: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One chunk of the signatures: (text, rank, position) of its set bits, which are SET_BITS elements drawn by weight.

    Every element has an exponential waiting time with its weight as rate, the same in all texts; the first SET_BITS win.
    """
    hashed = _mix(flat ^ _mix(np.full(1, 1000 + number, np.uint64)))
    wait = -np.log(((hashed >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight
    early = wait * total[doc] <= 4.0 * SET_BITS  # nearly always holds the winners; where it doesn't, all elements are sorted
    few = np.bincount(doc[early], minlength=len(total)) < SET_BITS
    if few.any():
        early |= few[doc]
    d, t, h = doc[early], wait[early], hashed[early]
    order = np.lexsort((h, t, d))
    d, h = d[order], h[order]
    place = np.arange(len(d))
    first = np.ones(len(d), bool)
    first[1:] = d[1:] != d[:-1]
    rank = place - np.maximum.accumulate(np.where(first, place, 0))
    won = rank < SET_BITS
    return d[won], rank[won], h[won]


def _keys(codes_of, chunks: range):
    """Signatures to index rows: (key, id, size, folded signature), one for every one of these chunks and every bit taken out of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = codes_of.value
        for batch in batches:
            size = np.asarray(batch.column(1), dtype=np.int64)
            ids = np.asarray(batch.column(0))
            flat = np.asarray(batch.column(2).flatten()).view(np.uint64)
            fold = _folded(flat, size)
            code = codes[(_mix(flat) % np.uint64(SLOTS)).astype(np.int64)]
            known = code > 0  # the others are in no other text
            doc, flat = np.repeat(np.arange(len(size)), size)[known], flat[known]
            weight = np.exp2(SLOPE * (code[known] - 1.0))
            total = np.bincount(doc, weights=weight, minlength=len(size))
            keys, docs = [], []
            for number in chunks:
                d, rank, h = _chunk(flat, doc, weight, total, number)
                bits = np.zeros((len(size), SET_BITS), np.uint64)
                bits[d, rank] = _mix(h ^ np.uint64(11))
                many = np.bincount(d, minlength=len(size))
                whole = bits.sum(1) + np.full(1, number, np.uint64) * _GOLD
                for out in range(SET_BITS):
                    there = np.flatnonzero(many == SET_BITS)
                    keys.append(_mix(whole[there] - bits[there, out]))
                    docs.append(there)
                there = np.flatnonzero(many == SET_BITS - 1)
                keys.append(_mix(whole[there]))
                docs.append(there)
            key, d = np.concatenate(keys), np.concatenate(docs)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), pa.array(ids[d]), pa.array(size[d].astype(np.int32)), *[pa.array(x[d].view(np.int64)) for x in fold]],
                names=["key", "id", "n", *[f"w{i}" for i in range(FOLD_WORDS)]],
            )

    return run


def _candidates(keys: DataFrame, threshold: float) -> DataFrame:
    """Pairs of ids that share a chunk up to one error and whose folded signatures are near enough.

    A pair of similarity s differs in at most (1 - s) / (1 + s) of its elements, and each of those flips at most one
    bit of the folded signature: the test drops no pair at or above the threshold. Hot keys are split by the skew join.
    """
    w = [f"w{i}" for i in range(FOLD_WORDS)]
    # Both sides are renamed alike: only then are their plans equal below the join, and the keys are made and shuffled once.
    one = keys.select("key", F.col("id").alias("id1"), F.col("n").alias("n1"), *[F.col(x).alias(x + "a") for x in w])
    other = keys.select("key", F.col("id").alias("id2"), F.col("n").alias("n2"), *[F.col(x).alias(x + "b") for x in w])
    far = sum((F.bit_count(F.col(x + "a").bitwiseXOR(F.col(x + "b"))) for x in w), F.lit(0))
    reach = (1 - threshold) / (1 + threshold)
    near = (far <= F.lit(reach) * (F.col("n1") + F.col("n2")) + F.lit(1e-9)) & (F.least("n1", "n2") >= F.lit(threshold) * F.greatest("n1", "n2") - F.lit(1e-9))
    return one.join(other, "key").where((F.col("id1") < F.col("id2")) & near).select(F.col("id1").alias("a"), F.col("id2").alias("b")).distinct()


@contextmanager
def _tasks_for(spark: SparkSession, size: int, read: int) -> Iterator[None]:
    """Inside, ``size`` bytes that are shuffled make tasks of about TASK_BYTES on both sides: so many shuffle partitions at least (small
    ones are merged at run time), and splits of the ``read`` bytes they come from that are as many."""
    tasks = max(1, min(MOST_TASKS, -(-size // TASK_BYTES)))
    wanted = {"spark.sql.shuffle.partitions": max, "spark.sql.files.maxPartitionBytes": min, "spark.sql.files.openCostInBytes": min}
    values = {"spark.sql.shuffle.partitions": tasks, "spark.sql.files.maxPartitionBytes": max(1 << 16, -(-read // tasks)), "spark.sql.files.openCostInBytes": 1 << 16}
    jvm = spark._jvm.org.apache.spark.network.util.JavaUtils
    before = {name: spark.conf.get(name) for name in wanted}
    number = lambda name: int(before[name]) if name.endswith("partitions") else int(jvm.byteStringAsBytes(before[name]))
    for name, pick in wanted.items():
        spark.conf.set(name, str(pick(number(name), values[name])))
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def near_duplicates(df: DataFrame, id: str, text: str, threshold: float = 0.75) -> DataFrame:
    """One row per record with text: ``id``, ``class_id`` (records of equal words share it), ``group_id``, ``n_links``.

    The words of a text are its runs of letters or digits in lower case. Two records are linked if the words they share
    are at least ``threshold`` of the words of both together, repeats counted. A group is everything joined by links,
    named by its smallest id; ``n_links`` counts linked classes of other words. Null and blank texts, texts without a
    word and null ids give no row; an empty table gives an empty result; other columns aren't read. Texts are read whole.

    1. Words become 64-bit elements, the k-th copy of a word being its own element, so that similarity is that of sets.
       Records with equal elements form a class; only one of each goes on, so copies cost nothing, however many.
    2. A counting table (``SLOTS`` hashed slots, all classes counted) gives each element a weight by its share of the
       classes, the larger the rarer it is; elements met in a single class can't be shared
       and are left out. The signature of a class is a string of bits in ``CHUNKS`` chunks of 2 ** 64; in each, the bits
       of ``SET_BITS`` elements are set that are drawn by weight, by the same draw in all texts. Its size, and the chance
       that two texts of some similarity agree in a chunk, don't depend on the length of the texts.
    3. Multi-index Hamming join: each chunk is filed once for every bit taken out of it. Chunks with at most one error
       (a bit exchanged) agree in one of these keys, so by the pigeonhole principle *all* pairs of signatures at a
       distance under ``REACH`` bits meet. At similarity 0.75 of the drawn elements, a chunk has at most one error with
       probability 0.82, and all ``CHUNKS`` fail with probability 0.00004. A key holds three elements, mostly rare ones.
       The chunks go in ``ROUNDS`` rounds, which bounds the disk that keys take; what they meet is put together.
    4. Pairs that meet are tested on folded signatures, then on the elements themselves; components of the links are the groups.
    """
    if not LEAST_THRESHOLD <= threshold <= 1:
        raise ValueError(f"threshold must be in [{LEAST_THRESHOLD}, 1]")
    words = F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    hashed = df.where(F.col(id).isNotNull() & F.col(text).isNotNull()).select(F.col(id).cast("bigint").alias("id"), F.transform(words, lambda x: F.xxhash64(x)).alias("h")).where(F.size("h") > 0)
    records = written(hashed.mapInArrow(_elements, "id bigint, f1 bigint, f2 bigint, n int, e array<bigint>"), "records")
    classes = written(records.groupBy("f1", "f2", "n").agg(F.min("id").alias("class_id"), F.count("*").alias("c")), "fingerprints")
    members = written(records.select("id", "f1", "f2", "n").join(classes.drop("c"), ["f1", "f2", "n"]).select("id", "class_id"), "members")
    # Only records whose fingerprint may occur twice are shuffled with their elements.
    marked = with_maybe(records, F.col("f1"), bitmap(classes.where(F.col("c") > 1), F.col("f1")))
    merged = marked.where("maybe").groupBy("f1", "f2", "n").agg(F.min("id").alias("id"), F.first("e").alias("e")).select("id", "n", "e")
    reps = written(marked.where(~F.col("maybe")).select("id", "n", "e").union(merged), "classes")

    discard(records)
    spark = df.sparkSession
    tidy(spark)
    total = reps.count()
    codes_of = spark.sparkContext.broadcast(_planes(_slot_codes(reps, total)))
    met = []
    for chunks in (range(r, CHUNKS, ROUNDS) for r in range(ROUNDS)):
        with _tasks_for(spark, total * len(chunks) * SET_BITS * KEY_BYTES, stored_bytes(reps)):
            keys = reps.mapInArrow(_keys(codes_of, chunks), "key bigint, id bigint, n int, " + ", ".join(f"w{i} bigint" for i in range(FOLD_WORDS)))
            met.append(written(_candidates(keys, threshold), "candidates", drop_shuffles=True))
    pairs = written(reduce(DataFrame.union, met).distinct(), "pairs")
    for table in met:
        discard(table)
    tidy(spark)
    involved = with_maybe(reps, F.col("id"), bitmap(pairs.select(F.explode(F.array("a", "b")).alias("id")), F.col("id"))).where("maybe")
    left = involved.select(F.col("id").alias("a"), F.col("e").alias("ea"))
    right = involved.select(F.col("id").alias("b"), F.col("e").alias("eb"))
    shared = F.size(F.array_intersect("ea", "eb"))
    enough = F.col("s") >= F.lit(threshold) * (F.size("ea") + F.size("eb") - F.col("s")) - F.lit(1e-9)
    links = written(pairs.join(left, "a").join(right, "b").withColumn("s", shared).where(enough).select("a", "b"), "links", drop_shuffles=True)
    tidy(spark)
    groups = connected_components(links).select(F.col("id").alias("class_id"), F.col("component").alias("group_id"))
    degree = links.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("n_links"))
    return (
        members.join(groups.join(degree, "class_id"), "class_id", "left")
        .select(F.col("id").alias(id), "class_id", F.coalesce("group_id", "class_id").alias("group_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))
    )


def _slot_codes(reps: DataFrame, total: int) -> DataFrame:
    """``slot`` and ``code`` of every slot that at least two classes use. Counted over all classes, combined before the shuffle."""
    slots = reps.mapInArrow(_slots, "slot int, c int").groupBy("slot").agg(F.sum("c").alias("c")).where(F.col("c") >= 2)
    rare = F.least(F.lit(MOST_CODE), F.floor(F.log2(F.greatest(F.lit(1.0), F.lit(float(max(1, total))) / F.col("c")))))
    return slots.select("slot", (rare + 1).cast("int").alias("code"))


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        flat = np.asarray(batch.column(2).flatten()).view(np.uint64)
        slot, c = np.unique((_mix(flat) % np.uint64(SLOTS)).astype(np.int32), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(c.astype(np.int32))], names=["slot", "c"])


def near_duplicate_pairs(df: DataFrame, id: str, text: str, threshold: float = 0.75) -> DataFrame:
    """Every pair ``<id>_a`` < ``<id>_b`` of records of one group, as :func:`near_duplicates` defines it."""
    rows = near_duplicates(df, id, text, threshold).select(F.col(id).alias("id"), "group_id")
    several = rows.groupBy("group_id").agg(F.count("*").alias("c")).where(F.col("c") > 1).select("group_id")
    rows = written(rows.join(several, "group_id"), "members")
    other = rows.select("group_id", F.col("id").alias("id2"))
    return rows.join(other, "group_id").where(F.col("id") < F.col("id2")).select(F.col("id").alias(f"{id}_a"), F.col("id2").alias(f"{id}_b"))
