"""What the corpus operators share: byte kernels, checkpoints, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspark.session import shared_folder

#: Bytes of text that a numpy kernel holds at once. A longer text is taken alone, whole.
SLICE_BYTES = 1 << 20

_MULT = 0x9E3779B97F4A7C15 | 1
_INV = pow(_MULT, -1, 1 << 64)

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: A random odd 64-bit value for each byte, so that a hash isn't a plain polynomial of byte values.
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, SLICE_BYTES + 4096)
        for name, base in (("up", _MULT), ("down", _INV)):
            row = np.full(size, base, np.uint64)
            row[0] = 1
            _powers[name] = np.multiply.accumulate(row)
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of buf[start:end], the same for the same bytes wherever they stand."""
    up, down = _power_tables(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * up[: len(buf)], out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def sequence_hashes(h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the sequences h[start:end], the same for the same values wherever they stand."""
    up, down = _power_tables(len(h) + 1)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def sliding_least(h: np.ndarray, width: int, at: np.ndarray) -> np.ndarray:
    """For each place in ``at`` the place of the last least of h[at : at + width], by the upper 40 bits."""
    low = np.uint64((1 << 24) - 1)
    least, size = h & ~low | low - (np.arange(len(h), dtype=np.uint64) & low), 1
    while size < width:
        step = min(size, width - size)
        least, size = np.minimum(least[:-step], least[step:]), size + step
    return at + ((low - (least[at] & low)).astype(np.int64) - at & int(low))


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One buffer of all texts with a newline between, and where each begins and ends."""
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lens + 1) - 1
    return np.frombuffer(b"\n".join(texts), np.uint8), ends - lens, ends


def word_spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes other than ASCII white space."""
    word = np.zeros(len(buf) + 2, np.int8)
    word[1:-1] = ~SPACE[buf]
    step = np.diff(word)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def slices(texts: list[bytes], most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most so many bytes, or of one row."""
    i = size = 0
    for j, text in enumerate(texts):
        if j > i and size + len(text) > most:
            yield i, j
            i, size = j, 0
        size += len(text) + 1
    if i < len(texts):
        yield i, len(texts)


def small(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most so many, as Python's copies of texts take several times their room."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; nulls become empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def ragged(lens: np.ndarray) -> np.ndarray:
    """0..n-1 for each length n, one after the other."""
    ends = np.cumsum(lens)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lens, lens)


class Recent:
    """Remembers the last hash of each of its slots, in bounded memory: what is frequent is known when it comes again.

    What is rare may be forgotten, so use it only where a repeat costs time but changes nothing.
    """

    def __init__(self, bits: int):
        self.mask = np.uint64((1 << bits) - 1)
        self.slots = np.arange(1 << bits, dtype=np.uint64) ^ np.uint64(1)  # none of these falls in its slot

    def new(self, hashes: np.ndarray) -> np.ndarray:
        """Which of these distinct hashes aren't remembered; all are from now on."""
        at = hashes & self.mask
        fresh = self.slots[at] != hashes
        self.slots[at[fresh]] = hashes[fresh]
        return fresh


def blocked(rows: DataFrame, group: str, member: str, most: int) -> DataFrame:
    """rows(group, member) with a column cell, so that each pair of members of a group meets in some cell.

    A group of up to ``most`` members is one cell. A larger one is cut into blocks by a hash of its
    members, and every two blocks make a cell; so no cell has more than about 2 ``most`` members.
    """
    sizes = rows.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("blocks")).where("blocks > 1")
    own = rows.join(sizes, group, "left").withColumn("own", F.when(F.col("blocks").isNotNull(), F.pmod(F.xxhash64(member), F.col("blocks")).cast("int")))
    other = F.when(F.col("blocks").isNull(), F.array(F.lit(None).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    spread = own.withColumn("other", F.explode(other))
    cell = F.when(F.col("blocks").isNull(), F.col(group)).otherwise(F.xxhash64(F.col(group), F.least("own", "other"), F.greatest("own", "other")))
    return spread.withColumn("cell", cell).drop("blocks", "own", "other")


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that df doesn't have, whatever the case."""
    taken, name = {c.lower() for c in df.columns}, f"__{stem}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


def col(name: str) -> Column:
    """A top-level column, whatever signs its name holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def checkpointed(df: DataFrame) -> DataFrame:
    """df cut from its lineage, kept in the ``shared_folder``."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges(a, b): root is the least id of its component.

    Alternates large-star and small-star steps (Kiveris et al. 2014) until the edges stay the same;
    that takes about log2 of the longest path in rounds. Each round is written to the shared
    checkpoint folder, so a lost executor costs one round at most.
    """
    now = checkpointed(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    if now.isEmpty():
        return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    for _ in range(most_rounds):
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(near, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where(F.col("u") != F.col("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        small = small.select("e.u", "e.v").where(F.col("u") != F.col("v")).distinct()
        now = checkpointed(small)
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if before == mark:
            break
        before = mark
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For n nodes and edges a-b, the least node of each one's component."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        low = np.minimum(ra, rb)
        np.minimum.at(root, ra, low)
        np.minimum.at(root, rb, low)
        root = root[root]
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        left = root[a] != root[b]
        a, b = a[left], b[left]
    return root


def groups_of(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables that hold whole runs of a key, of batches sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        change = np.flatnonzero(keys[1:] != keys[:-1])
        if held and keys[0] != held[-1].column(held[-1].schema.get_field_index(key))[-1].as_py():
            yield pa.Table.from_batches(held)
            held = []
        if len(change):
            cut = int(change[-1]) + 1
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
