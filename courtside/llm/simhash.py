"""SimHash near-dedup: tiled exact comparison of fingerprints with exclusive-or and bit counts in numpy.

Documents are reduced to fingerprints of a few words of 64 bits, and equal fingerprints to one row. Fingerprints are
cut into tiles; a tile holds at most a fixed number on average, and all of a tile share a key. Spark pairs the tiles
whose keys allow a pair within the radius and deals the pairs; a task compares one pair of tiles at a time, in blocks,
and skips blocks whose population counts differ beyond the radius. So every pair within the radius is found, and no
task holds more than two tiles. The key of :func:`simhash_groups` is the population count of each 16-bit quarter: a
differing bit moves one count by one, so keys whose counts differ by more than the radius in sum hold no pair, and
most tile pairs are never formed. Of the links in a tile pair only a spanning forest leaves the task.

Null and empty texts have the fingerprint zero and link like any other; repeated rows share a fingerprint and a
component; a row with a null id is linked and may join others like any other row, and its component is null only if no
row of it has an id; an empty table gives an empty result; texts of any length are read whole, in blocks of shingles;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtside.llm.frames import map_texts, one_row_each, with_fields
from courtside.plans.components import connected_components
from courtside.plans.storage import partitions, saved, small_side

SEED = 42
#: Fingerprints in a tile, on average; rows compared at once within a task.
TILE, BLOCK = 1 << 16, 128
#: For each byte value, its eight bits.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_BYTES = np.arange(8) * 256


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 of each shingle of ``size`` words, in order, repeats included.

    Words are what ASCII white space separates, with A-Z in lower case; fewer words than ``size`` make one shingle
    of the whole sequence, and no words make none.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    digest, join = xxhash.xxh64_digest, b" ".join
    return np.frombuffer(b"".join([digest(join(s), SEED) for s in zip(*(words[i:] for i in range(size)))]), ">u8").astype(np.uint64)


def fingerprint(hashes: np.ndarray, words: int = 1) -> np.ndarray:
    """``words`` 64-bit words whose bits are 1 where over half of the hashes have a 1.

    The first word uses the hashes themselves, each further word a fresh mix of them.
    """
    out = np.zeros(words, np.uint64)
    for k in range(words if len(hashes) else 0):
        h = hashes
        if k:
            h = hashes + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)
            h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
            h = h ^ h >> np.uint64(31)
        # how often each byte value stands at each of the eight places gives the bit counts
        times = np.zeros(2048, np.int64)
        for at in range(0, len(h), 4096):
            times += np.bincount((h[at : at + 4096].astype(">u8").view(np.uint8).reshape(-1, 8) + _BYTES).ravel(), minlength=2048)
        out[k] = np.packbits((times.reshape(8, 256) @ _BITS).ravel() * 2 > len(h)).view(">u8")[0]
    return out


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """``(id_col, fp bigint)`` of every row: the 64-bit fingerprint of its shingles."""

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(shingle_hashes(t.as_py(), size))[0] for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=[id_col, "fp"])

    return map_texts(df.select(F.col(id_col), F.col(text_col)), run, with_fields(df, [id_col], "fp: bigint"))


def tiles(rows: DataFrame, key: str, values: list[str]) -> DataFrame:
    """``(key, chunk, rows array)``: the rows of each key, dealt into chunks of about ``TILE`` rows.

    A row is its only value, or else a struct of its values. The table of chunk counts has one row a key.
    """
    counts = small_side(rows.groupBy(key).agg(F.ceil(F.count("*") / F.lit(TILE)).alias("chunks")))
    dealt = rows.join(counts, key).withColumn("chunk", F.pmod(F.xxhash64(*values), F.col("chunks")))
    return dealt.groupBy(key, "chunk").agg(F.collect_list(values[0] if len(values) == 1 else F.struct(*values)).alias("rows"))


def tile_pairs(table: DataFrame, key: str, neighbours: Column) -> DataFrame:
    """``(cell, pair, same, a, b)``: every pair of tiles to compare, once.

    ``neighbours`` lists the keys that a tile's key meets, its own among them, each unordered pair of keys once. Pairs
    are dealt into cells of about two full tiles, which a task holds one at a time; small tiles share a cell.
    """

    def joined(tiles_: DataFrame) -> DataFrame:
        left = tiles_.select(F.col(key).alias("own"), F.col("chunk").alias("chunk_a"), F.col("rows").alias("a"), F.explode(neighbours).alias(key))
        right = tiles_.select(key, F.col("chunk").alias("chunk_b"), F.col("rows").alias("b"))
        return left.join(right, key).where(f"own <> {key} or chunk_a <= chunk_b")

    parts = 4 * partitions(table.sparkSession)
    weight = joined(table.withColumn("rows", F.size("rows"))).agg(F.sum(F.col("a").cast("bigint") + F.col("b"))).first()[0] or 0
    cells = max(4 * parts, math.ceil(weight / (2 * TILE)))
    same = (F.col("own") == F.col(key)) & (F.col("chunk_a") == F.col("chunk_b"))
    pairs = joined(table).select(F.xxhash64("own", key, "chunk_a", "chunk_b").alias("pair"), same.alias("same"), "a", "b")
    return pairs.select(F.pmod("pair", F.lit(cells)).alias("cell"), "*").repartition(parts, "cell")


def close_blocks(a: np.ndarray, b: np.ndarray, radius: int, same: bool):
    """Blocks ``(rows of a, rows of b, differing bits, whether within radius)`` of fingerprints (rows of 64-bit words).

    Both sides go in order of their population counts, so blocks that lie beyond the radius are never formed. If
    ``same``, a pair of rows is within the radius in one of its two orders only.
    """
    of = [np.bitwise_count(x).sum(axis=1, dtype=np.int64) for x in (a, b)]
    order = [np.argsort(x, kind="stable") for x in of]
    a, b, of = a[order[0]], b[order[1]], [x[o] for x, o in zip(of, order)]
    for i in range(0, len(a), BLOCK):
        x, low, high = a[i : i + BLOCK], of[0][i], of[0][min(i + BLOCK, len(a)) - 1]
        start, end = np.searchsorted(of[1], [low - radius, high + radius + 1])
        for j in range(max(start, i) if same else start, end, 4 * BLOCK):
            y = b[j : min(j + 4 * BLOCK, end)]
            apart = np.bitwise_count(x[:, None, 0] ^ y[None, :, 0]).astype(np.uint16)
            for k in range(1, a.shape[1]):
                apart += np.bitwise_count(x[:, None, k] ^ y[None, :, k])
            near = apart <= radius
            if same:
                near &= np.arange(i, i + len(x))[:, None] < np.arange(j, j + len(y))
            if near.any():
                yield order[0][i : i + len(x)], order[1][j : j + len(y)], apart, near


def close_pairs(a: np.ndarray, b: np.ndarray, radius: int, same: bool):
    """Index pairs ``(i, j)`` of :func:`close_blocks`, block by block."""
    for rows, cols, _, near in close_blocks(a, b, radius, same):
        p, q = np.nonzero(near)
        yield rows[p], cols[q]


def spanning(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges ``(node, smallest node it reaches)`` that connect what the given edges connect."""
    nodes, at = np.unique(np.concatenate([src, dst]), return_inverse=True)
    u, v = at[: len(src)], at[len(src) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, u, low)
        np.minimum.at(new, v, low)
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _edges(src, dst) -> pa.Table:
    return pa.table({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64())})


def links(pairs: DataFrame, radius: int) -> DataFrame:
    """``(src, dst)``: for each pair of tiles of fingerprints, edges that connect those within ``radius`` bits of each other."""

    def run(table: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64),) * 2]
        for same, a, b in zip(*(table.column(c) for c in ("same", "a", "b"))):
            a, b = (x.values.to_numpy() for x in (a, b))
            found, size = [], 0
            for i, j in close_pairs(a.view(np.uint64)[:, None], b.view(np.uint64)[:, None], radius, same.as_py()):
                found.append((a[i], b[j]))
                size += len(i)
                if size > 1 << 20:  # only what connects is kept
                    found, size = [spanning(*(np.concatenate(x) for x in zip(*found)))], 0
            if found:
                out.append(spanning(*(np.concatenate(x) for x in zip(*found))))
        return _edges(*(np.concatenate(x) for x in zip(*out)))

    return pairs.groupBy("cell").applyInArrow(run, "src bigint, dst bigint")


def _near_counts(key: Column, parts: int, most: int, radius: int) -> Column:
    """Keys ``>= key`` whose digits (``parts`` counts, each below ``most + 1`` and written base 32) differ by ``radius`` in sum at most."""
    steps: list[tuple[int, ...]] = [()]
    for _ in range(parts):
        steps = [(*s, d) for s in steps for d in range(-radius, radius + 1) if sum(map(abs, s)) + abs(d) <= radius]
    ahead = [s for s in steps if s >= (0,) * parts]
    return F.array(*[key + sum(d * 32 ** (parts - 1 - i) for i, d in enumerate(s)) for s in ahead])


def quarter_counts(fp: Column) -> Column:
    """The population counts of the four 16-bit quarters, as one number in base 32."""
    return sum((F.bit_count(F.shiftrightunsigned(fp, 16 * i).bitwiseAND(F.lit(0xFFFF))).cast("bigint") * 32**i for i in range(4)), F.lit(0).cast("bigint"))


def simhash_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, radius: int = 2) -> DataFrame:
    """``(id_col, fingerprint, component_id)``: texts whose fingerprints a chain of steps of at most ``radius`` bits joins.

    ``fingerprint`` is 16 hex digits; ``component_id`` is the smallest id of the component, a lone row's own id, and null
    where no row of the component has an id. Fingerprints are the nodes that are linked, so ids may repeat or be null.
    """
    rows = saved(fingerprints(df, id_col, text_col, size).withColumnRenamed(id_col, "id"))
    distinct = saved(rows.groupBy("fp").agg(F.min("id").alias("id")).select("id", "fp", quarter_counts(F.col("fp")).alias("key")))
    table = saved(tiles(distinct.select("fp", "key"), "key", ["fp"]))
    component = connected_components(links(tile_pairs(table, "key", _near_counts(F.col("key"), 4, 16, radius)), radius))
    placed = distinct.join(component, distinct.fp == component.node, "left").select("fp", "id", F.coalesce("component", "fp").alias("component"))
    smallest = placed.groupBy("component").agg(F.min("id").alias("component_id"))
    named = saved(placed.join(smallest, "component").select("fp", "component_id"))
    out = rows.join(named, "fp")
    return out.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# --- near-duplicate removal by verified similarity ---------------------------------------------------------------

#: Words of a fingerprint, and the differing bits of 256 up to which a pair is verified: at a similarity of 0.8 about
#: 39 bits differ, with a standard deviation of 6; unrelated texts differ in 128 with one of 8. The bits of sets of a few
#: shingles spread more, so pairs with a smaller set than ``FEW`` are verified up to a wider radius.
WORDS, RADIUS, FEW, FEW_RADIUS = 4, 60, 12, 90
NAMES = [f"w{k}" for k in range(WORDS)]
#: Bands of sizes that the ratio ``similarity`` is cut into.
BANDS = 4
#: Bytes of shingles and rows of one side that a task verifies at a time.
PART_BYTES, PART_ROWS = 8 << 20, 4096


def _digest(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def sketches(df: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """``(id, digest, of, n, w0..w3)``: each text's set of shingles as a 128-bit hash, its size and its 256-bit fingerprint."""

    def run(batches):
        for batch in batches:
            n, of, fps = [], [], []
            for t in batch.column(1):
                h = np.unique(shingle_hashes(t.as_py(), size))
                n.append(len(h))
                of.append(xxhash.xxh3_128_hexdigest(h.tobytes()))
                fps.append(fingerprint(h, WORDS))
            fps = np.array(fps, np.uint64).reshape(-1, WORDS).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(of, pa.string()), pa.array(n, pa.int64()), *(pa.array(fps[:, k].copy()) for k in range(WORDS))], names=["id", "digest", "of", "n", *NAMES])

    return map_texts(df.select(F.col(id_col).cast("bigint"), F.col(text_col), _digest(F.col(text_col))), run, "id bigint, digest string, of string, n bigint, " + ", ".join(f"{w} bigint" for w in NAMES))


def _banded(rows: DataFrame, similarity: float) -> DataFrame:
    """Adds ``band``: sets of a similarity of at least this have sizes within ``BANDS`` bands of each other."""
    return rows.withColumn("band", F.when(F.col("n") == 0, -1 - BANDS).otherwise(F.floor(F.ln(F.col("n").cast("double")) * F.lit(BANDS / (math.log(1 / similarity) + 1e-9)))).cast("bigint"))


def _radius(n: np.ndarray) -> int:
    return RADIUS if n.min() >= FEW else FEW_RADIUS


def _alike_sizes(a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    a, b = a[:, None], b[None, :]
    return np.minimum(a, b) + 1e-9 >= similarity * np.maximum(a, b)


def involved(table: DataFrame, similarity: float) -> DataFrame:
    """``(pair, side, id, n, w0..w3)``: of each pair of tiles the rows with a row on the other side that is close in bits and size.

    A tile compared with itself gives its rows on both sides.
    """
    fields = ["id", "n", *NAMES]

    def run(table: pa.Table) -> pa.Table:
        out = []
        for pair, same, *sides in zip(*(table.column(c) for c in ("pair", "same", "a", "b"))):
            sides = [s.values for s in sides]
            n = [s.field("n").to_numpy() for s in sides]
            words = [np.stack([s.field(w).to_numpy() for w in NAMES], 1).view(np.uint64) for s in sides]
            has = [np.zeros(len(x), bool) for x in n]
            for rows, cols, _, near in close_blocks(*words, max(map(_radius, n)), same.as_py()):
                near &= _alike_sizes(n[0][rows], n[1][cols], similarity)
                has[0][rows] |= near.any(axis=1)
                has[1][cols] |= near.any(axis=0)
            if same.as_py():
                has = [has[0] | has[1]] * 2
            for side, s, keep in zip((0, 1), sides, has):
                at = np.flatnonzero(keep)
                out.append(pa.table([pa.array(np.full(len(at), pair.as_py())), pa.array(np.full(len(at), side), pa.int32()), *(s.field(f).take(pa.array(at)) for f in fields)], names=["pair", "side", *fields]))
        return pa.concat_tables(out)

    pairs = tile_pairs(table, "band", F.array(*[F.col("band") + k for k in range(BANDS + 1)]))
    return pairs.groupBy("cell").applyInArrow(run, "pair bigint, side int, id bigint, n bigint, " + ", ".join(f"{w} bigint" for w in NAMES))


def verified_links(rows: DataFrame, shingles: DataFrame, similarity: float) -> DataFrame:
    """``(src, dst)``: edges between sets of at least this Jaccard similarity that connect all such sets of a pair of tiles.

    ``rows`` are those of :func:`involved`. Each pair is cut into parts by bytes and rows, so that a task holds two parts
    at a time; each set travels once a part it is compared with, never once a pair. Within a part a set is first
    verified against the nearest on the other side, twice, and then against those close to it that are not yet
    connected with it; only decisions leave the task.
    """
    sized = rows.groupBy("pair", "side").agg(F.greatest(F.ceil(F.sum("n") * 8 / F.lit(PART_BYTES)), F.ceil(F.count("*") / F.lit(PART_ROWS))).alias("parts"))
    parts = small_side(sized.groupBy("pair").agg(*[F.max(F.when(F.col("side") == s, F.col("parts"))).alias(f"parts{s}") for s in (0, 1)]).where("parts0 is not null and parts1 is not null"))
    own = F.pmod(F.xxhash64("id"), F.when(F.col("side") == 0, F.col("parts0")).otherwise(F.col("parts1")))
    other = F.sequence(F.lit(0).cast("bigint"), F.when(F.col("side") == 0, F.col("parts1")).otherwise(F.col("parts0")) - 1)
    dealt = rows.join(parts, "pair").withColumn("own", own).select("*", F.explode(other).alias("other"))
    part = F.when(F.col("side") == 0, F.col("own") * F.col("parts1") + F.col("other")).otherwise(F.col("other") * F.col("parts1") + F.col("own"))
    ready = dealt.select("pair", part.alias("part"), "side", "id", "n", *NAMES).join(shingles, "id")

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids, n, side = (table.column(c).to_numpy() for c in ("id", "n", "side"))
        words = np.stack([table.column(w).to_numpy() for w in NAMES], 1).view(np.uint64)
        sets = table.column("shingles").chunk(0)
        values, start = sets.values.to_numpy(), sets.offsets.to_numpy()
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not len(a) or not len(b):
            return _edges([], [])
        _, node = np.unique(ids, return_inverse=True)
        label = np.arange(node.max() + 1)
        radius, edges = max(_radius(n[a]), _radius(n[b])), []

        def connect(i, j, apart):
            """Verify pairs of rows that are not connected yet, nearest first."""
            for k in np.argsort(apart, kind="stable"):
                u, v = label[node[i[k]]], label[node[j[k]]]
                if u != v:
                    x, y = (values[start[r] : start[r + 1]] for r in (i[k], j[k]))
                    shared = len(np.intersect1d(x, y, assume_unique=True))
                    if shared + 1e-9 >= similarity * (len(x) + len(y) - shared):
                        label[label == v] = u
                        edges.append((ids[i[k]], ids[j[k]]))

        def unconnected():
            for rows, cols, apart, near in close_blocks(words[a], words[b], radius, False):
                i, j = a[rows], b[cols]
                near &= _alike_sizes(n[i], n[j], similarity) & (label[node[i]][:, None] != label[node[j]][None, :])
                if near.any():
                    yield i, j, apart, near

        for _ in range(2):
            best, nearest = np.full(len(ids), 1 << 15), np.zeros(len(ids), np.int64)
            for i, j, apart, near in unconnected():
                far = np.where(near, apart, 1 << 15)
                for mine, others, axis in ((i, j, 1), (j, i, 0)):
                    at = far.argmin(axis=axis)
                    least = far.min(axis=axis)
                    better = least < best[mine]
                    best[mine[better]], nearest[mine[better]] = least[better], others[at[better]]
            found = np.flatnonzero(best < 1 << 15)
            connect(found, nearest[found], best[found])
        for i, j, apart, near in unconnected():
            p, q = np.nonzero(near)
            connect(i[p], j[q], apart[p, q])
        return _edges(*zip(*edges)) if edges else _edges([], [])

    return ready.repartition(4 * partitions(rows.sparkSession), "pair", "part").groupBy("pair", "part").applyInArrow(run, "src bigint, dst bigint")


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``df`` that stay when of each group of near-duplicate texts one stays.

    Two texts are near-duplicates if their sets of ``size``-word shingles have a Jaccard similarity of at least
    ``similarity``, and a group is a component of such pairs; its smallest id stays. Equal sets are one row from the
    start. Tiles of fingerprints are compared once: rows without a close row in another set are done, the others are
    verified by their exact sets (:func:`verified_links`), so a component is what verified pairs join.

    Texts without words (null and empty ones among them) are copies of each other. Rows are told apart by id and text,
    so an id may stand on several texts; of equal rows one stays, and a null id wins over no other. Texts are read
    whole. An empty table stays empty; other columns, whatever their names, are kept as they are.
    """
    found = sketches(df, id_col, text_col, size).groupBy("id", "digest").agg(F.count("*").alias("copies"), *[F.max(c).alias(c) for c in ("of", "n", *NAMES)])
    # the key of a row: numbers are given to rows that are written already, so they do not change
    named = saved(saved(found).select(F.monotonically_increasing_id().alias("key"), F.col("id").alias("name"), "digest", "copies", "of", "n", *NAMES))
    sets = saved(named.groupBy("of", "n").agg(F.min("key").alias("id"), *[F.max(w).alias(w) for w in NAMES]))
    table = saved(tiles(_banded(sets.select("id", "n", *NAMES), similarity), "band", ["id", "n", *NAMES]))
    close = saved(involved(table, similarity))
    grouped = named.select("key", "name", "digest", "copies", "of", "n").join(sets.select("of", "n", "id"), ["of", "n"])
    if close.isEmpty():
        grouped = saved(grouped.withColumn("component", F.col("id")))
    else:
        wanted = named.join(close.select(F.col("id").alias("key")).distinct(), "key", "left_semi")
        shingles = saved(_shingle_sets(df, wanted, id_col, text_col, size))
        component = connected_components(verified_links(close, shingles, similarity)).withColumnRenamed("node", "id")
        grouped = saved(grouped.join(component, "id", "left").withColumn("component", F.coalesce("component", "id")))
    first = grouped.groupBy("component").agg(F.min(F.struct(F.col("name").isNull().alias("null"), "name", "digest", "key")).alias("first")).select(F.col("first.key").alias("stays"))
    decided = grouped.join(first, F.col("key") == F.col("stays"), "left").select(F.col("name").alias("id"), "digest", F.col("stays").isNotNull().alias("kept"), "copies")
    return one_row_each(df, id_col, _digest(F.col(text_col)), decided, F.lit(0))


def _shingle_sets(df: DataFrame, keys: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """``(id, shingles array<bigint>)``: the distinct shingle hashes of the texts of the given ``(key, name, digest)``, ``id`` being the key."""

    def run(batches):
        for batch in batches:
            sets = [np.unique(shingle_hashes(t.as_py(), size)).view(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["id", "shingles"])

    wanted = keys.select("key", "name", F.col("digest").alias("of"))
    texts = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), _digest(F.col(text_col)).alias("digest"))
    texts = texts.join(wanted, F.col("id").eqNullSafe(F.col("name")) & (F.col("digest") == F.col("of"))).select("key", "text")
    return map_texts(texts, run, "id bigint, shingles array<bigint>").dropDuplicates(["id"])
