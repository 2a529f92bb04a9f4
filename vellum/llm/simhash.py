"""SimHash near-dedup: segment-popcount embedding, grid range-join, exact check.

A text's fingerprint has a bit set where more than half of its shingles' hashes have it set. A
fingerprint is embedded as the bit counts of its segments. The Manhattan distance of two embeddings
is at most the number of differing bits, so pairs beyond the radius there are beyond it everywhere.

`links` (small radius r, 64 bits, two-bit segments). The segments are dealt to 2 * r groups; a grid
cell is a choice of r groups with the counts of all their segments. Two fingerprints whose
embeddings are within distance r differ in at most r groups, so they meet in the cell of r groups
where they agree: no link is lost. Each fingerprint is in C(2r, r) cells (20 for r = 3). Cells of
more than `tile` fingerprints are cut by a second grid, over the segments of the other groups: these
are dealt to r + 1 parts, and two fingerprints within the distance agree in one part at least.

`near_copies` and `keep_one` (texts of a given Jaccard similarity over shingles). The radius is then
a share of the bits, too wide for any lossless grid, so a longer fingerprint is cut into `bands` grid
cells of one-bit segments, as many as the wanted recall needs at that cell size (the cells get finer
as rows grow, so that a row meets about 2 ** ROOM unrelated ones in each). What meets there and is
near by a sketch is only a candidate: the shingle sets of everything that candidates connect are then
compared with each other, and only an exact similarity of two sets counts.

Rows of a cell are compared in blocks, and only enough links to connect all that are linked are given
out, never all pairs. Cells that stay larger than `tile` are cut into pairs of tiles that go to
different tasks. Equal fingerprints (in near_copies, equal sets) are one row from the start, however
many documents have them.

`keep_one` keeps documents to which all that go are similar: of what candidates connect, the set that
most others are similar to stays and those go, then the same with the rest. Of a group that is too
large for one task, a share of `tile` sets chooses who stays, all others are held against these, and
what is left goes to the next round; no pairs of the others are formed.

Defined results: a text without words has fingerprint zero; null texts are empty texts; a null
doc_id is labelled by the others of its component, and is null where there are none; repeated rows
are equal fingerprints; an empty table gives no rows.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm._rt import begin, discard, ready, sized, store
from vellum.llm.components import components

ODD = [(0x9E3779B97F4A7C15 * (2 * k + 1)) & (2**64 - 1) | 1 for k in range(256)]
PAIRS = 0x5555555555555555
ROOM = 6
KEYS = ["key", "t1", "t2"]
TEXTS = 2_000  # texts that a task writes


def shingle_hashes(text: str | None, n: int) -> np.ndarray:
    """XXH64 (seed 42) of each n-word shingle, repeats included; of the whole sequence if it is shorter."""
    w = (text or "").encode().lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    if len(w) < n:
        return np.array([digest(join(w), 42)], np.uint64)
    return np.array([digest(join(x), 42) for x in zip(*(w[i:] for i in range(n)))], np.uint64)


def majority(h: np.ndarray, words: int = 1) -> np.ndarray:
    """The fingerprint of hashes: `words` words of 64 bits; word 0 is made of the hashes themselves."""
    if not len(h):
        return np.zeros(words, np.uint64)
    count = np.zeros(64 * words, np.int64)
    for lo in range(0, len(h), 255):
        part = h[lo : lo + 255]
        wide = np.empty((len(part), words), np.uint64)
        wide[:, 0] = part
        for k in range(1, words):
            x = part * np.uint64(ODD[k])
            x ^= x >> np.uint64(32)
            wide[:, k] = x * np.uint64(ODD[-k])
        count += np.add.reduce(np.unpackbits(wide.view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return np.packbits(count * 2 > len(h), bitorder="little").view(np.uint64)


def fingerprints(documents: DataFrame, n: int, words: int = 1) -> DataFrame:
    """(doc_id, f0, f1, ...): one row per document."""
    ready(documents.sparkSession)
    names = [f"f{k}" for k in range(words)]

    def run(batches):
        begin("simhash")
        for b in batches:
            hashes = (shingle_hashes(t, n) for t in b.column(1).to_pylist())
            rows = [majority(h, words) for h in hashes]
            m = np.array(rows, np.uint64).reshape(-1, words).view(np.int64)
            yield pa.record_batch([b.column(0).cast(pa.int64()), *(pa.array(m[:, k]) for k in range(words))], ["doc_id", *names])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{x} long" for x in names))


def set_prints(documents: DataFrame, n: int, words: int) -> DataFrame:
    """(doc_id, t, id, f0, f1, ...): id is a hash of the set of shingles, the fingerprint is made of that set; t is a hash of the text."""
    ready(documents.sparkSession)
    names = [f"f{k}" for k in range(words)]

    def run(batches):
        begin("simhash")
        for b in batches:
            sets = [np.unique(shingle_hashes(t, n)) for t in b.column(2).to_pylist()]
            m = np.array([majority(h, words) for h in sets], np.uint64).reshape(-1, words).view(np.int64)
            ids = np.array([xxhash.xxh64_intdigest(h.tobytes(), 42) for h in sets], np.uint64).view(np.int64)
            yield pa.record_batch([b.column(0).cast(pa.int64()), b.column(1), pa.array(ids), *(pa.array(m[:, k].copy()) for k in range(words))], ["doc_id", "t", "id", *names])

    return documents.select("doc_id", F.xxhash64("text").alias("t"), "text").mapInArrow(run, "doc_id long, t long, id long, " + ", ".join(f"{x} long" for x in names))


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def _spread(radius: int) -> tuple[list[tuple[list[int], list[list[int]]]], int]:
    """For each cell of the grid the segments it fixes, and its parts of the other segments; and how many parts each has."""
    groups = [[s for s in range(32) if s * 2 * radius // 32 == g] for g in range(2 * radius)]
    out = []
    for chosen in combinations(range(2 * radius), radius):
        fixed = [s for g in chosen for s in groups[g]]
        rest = [s for s in range(32) if s not in fixed]
        out.append((fixed, [rest[k :: radius + 1] for k in range(radius + 1)]))
    return out, radius + 1


def _mask(segments: list[int]) -> int:
    return _signed(sum(3 << (2 * s) for s in segments))


def counts_of(f: Column) -> Column:
    """Each two-bit field holds its bit count."""
    low, high = f.bitwiseAND(F.lit(PAIRS)), F.shiftrightunsigned(f, 1).bitwiseAND(F.lit(PAIRS))
    return F.shiftleft(low.bitwiseAND(high), 1).bitwiseOR(low.bitwiseXOR(high))


def grid_cells(prints: DataFrame, radius: int = 3) -> DataFrame:
    """(key, cell, id, s0) for every cell of every 64-bit fingerprint `f0`, natively: two-bit segments."""
    cells, _ = _spread(radius)
    each = F.array(*(F.struct(F.lit(i).alias("cell"), F.col("counts").bitwiseAND(F.lit(_mask(fixed))).alias("k")) for i, (fixed, _) in enumerate(cells)))
    rows = prints.select("f0", counts_of(F.col("f0")).alias("counts")).select("f0", F.explode(each).alias("c"))
    return rows.select(F.xxhash64("c.cell", "c.k").alias("key"), "c.cell", F.col("f0").alias("id"), F.col("f0").alias("s0"))


def finer_cells(cells: DataFrame, radius: int = 3) -> DataFrame:
    """The second grid: (key, id, s0) of rows of grid_cells, each in radius + 1 finer cells."""
    spread, parts = _spread(radius)
    masks = F.array(*(F.lit(_mask(part)) for _, rest in spread for part in rest))
    rows = cells.select("key", "id", "s0", "cell", counts_of(F.col("s0")).alias("counts"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    own = F.col("counts").bitwiseAND(F.get(masks, F.col("cell") * parts + F.col("part")))
    return rows.select(F.xxhash64("key", "part", own).alias("key"), "id", "s0")


def band_cells(prints: DataFrame, bands: int, bits: int, sketch: int) -> DataFrame:
    """(key, id, s0, ...): cells of `bits` one-bit segments, with the first `sketch` words for the check, natively."""
    keys = []
    for j in range(bands):
        word, off = divmod(j * bits, 64)
        k = F.shiftrightunsigned(f"f{word}", off)
        if off + bits > 64:
            k = k.bitwiseOR(F.shiftleft(f"f{word + 1}", 64 - off))
        keys.append(k.bitwiseAND(F.lit((1 << bits) - 1)).bitwiseOR(F.lit(j << bits)))  # bits and the number of bands stay far below 63 together
    return prints.select("id", *(F.col(f"f{k}").alias(f"s{k}") for k in range(sketch)), F.explode(F.array(*keys)).alias("key"))


def embedded(f: np.ndarray) -> np.ndarray:
    """Bit counts of two-bit segments, each as so many ones: the bits in which two of these differ are their Manhattan distance."""
    pairs = np.uint64(PAIRS)
    low, high = f & pairs, (f >> np.uint64(1)) & pairs
    return (low | high) | ((low & high) << np.uint64(1))


def _apart(f: np.ndarray, e: np.ndarray, i: np.ndarray, j: np.ndarray | int, radius: int) -> np.ndarray:
    """True where rows i and j of fingerprints f (e: embedded) are within the radius: first by the embedding, then bit by bit."""
    out = np.bitwise_count(e[i] ^ e[j]).sum(axis=-1, dtype=np.int64) <= radius
    near = np.flatnonzero(out)
    if len(near):
        other = f[j[near]] if isinstance(j, np.ndarray) else f[j]
        out[near] = np.bitwise_count(f[i[near]] ^ other).sum(axis=-1, dtype=np.int64) <= radius
    return out


def _forest(f: np.ndarray, e: np.ndarray, rows: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Pairs of rows that span each component of one cell's links."""
    out, rest = [], rows
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            i = queue.pop()
            near = _apart(f, e, rest, int(i), radius)
            if near.any():
                got, rest = rest[near], rest[~near]
                out += [(int(i), int(j)) for j in got]
                queue += got.tolist()
    return out


def _large(cells: DataFrame, tile: int) -> tuple[DataFrame, int]:
    """(key, n) of the cells of more than `tile` rows, and how many there are."""
    large = store(cells.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > tile), "large")  # most often nothing is written
    return large, large.count()


def _dealt(cells: DataFrame, tile: int, all_small: bool = False) -> DataFrame:
    """(key, t1, t2, id, payload) of (key, id, payload): each run of equal keys is a cell, or a pair of tiles of a large one, and is in one task."""
    spark = cells.sparkSession
    parallel = int(spark.conf.get("spark.sql.shuffle.partitions"))
    payload = [c for c in cells.columns if c not in ("key", "id")]
    large, n = (None, 0) if all_small else _large(cells, tile)
    if not n:
        rows = cells.select("key", F.lit(0).alias("t1"), F.lit(0).alias("t2"), "id", *payload)
    else:
        tiles = F.coalesce(F.ceil(F.col("n") / tile), F.lit(1)).cast("int")
        own = F.pmod(F.xxhash64("id"), tiles).cast("int")
        others = F.when(tiles == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), tiles - 1), lambda x: x != own))
        rows = cells.join(sized(large, n), "key", "left").withColumn("own", own).withColumn("other", F.explode(others))
        rows = rows.select("key", F.least("own", "other").alias("t1"), F.greatest("own", "other").alias("t2"), "id", *payload)
    return rows.repartition(parallel, *KEYS).sortWithinPartitions(*KEYS, "id")


def edges_in_cells(cells: DataFrame, radius: int, tile: int = 4096, all_small: bool = False) -> DataFrame:
    """(a, b): distinct ids that are within the radius and share a cell, enough of them to connect all that are linked."""
    names = [c for c in cells.columns if c[0] == "s"]
    rows = _dealt(cells.select("key", "id", *names), tile, all_small)
    # ids come last, so each run of equal keys is one cell (or one pair of its tiles)

    def run(batches):
        held = None
        for b in batches:
            m = np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(b.num_columns)], axis=1)
            if held is not None:
                m = np.concatenate([held, m])
            new = np.flatnonzero((m[1:, :3] != m[:-1, :3]).any(axis=1)) + 1
            cut = new[-1] if len(new) else 0
            held = m[cut:]
            if cut:
                yield from found(m[:cut])
        if held is not None and len(held):
            yield from found(held)

    def found(m):
        starts = np.concatenate([[0], np.flatnonzero((m[1:, :3] != m[:-1, :3]).any(axis=1)) + 1, [len(m)]])
        size = np.diff(starts)
        f = np.ascontiguousarray(m[:, 4:]).view(np.uint64)
        e = embedded(f)
        after = np.repeat(starts[1:], size) - np.arange(len(m)) - 1  # rows that follow in the same run
        part_of, out = np.arange(len(m)), []  # rows with the same value are connected by what is given out
        i = np.flatnonzero(np.repeat(size <= 256, size))
        for lag in range(1, 256):
            i = i[after[i] >= lag]
            if not len(i):
                break
            k = i[_apart(f, e, i, i + lag, radius)]
            k = k[part_of[k] != part_of[k + lag]]
            if len(k):
                out.append(np.stack([m[k, 3], m[k + lag, 3]], axis=1))
                a, b = part_of[k], part_of[k + lag]
                np.minimum.at(part_of, np.maximum(a, b), np.minimum(a, b))
                while (part_of != part_of[part_of]).any():
                    part_of = part_of[part_of]
        for k in np.flatnonzero(size > 256):
            pairs = np.array(_forest(f, e, np.arange(starts[k], starts[k + 1]), radius), np.int64).reshape(-1, 2)
            if len(pairs):
                out.append(m[pairs, 3])
        if out:
            x = np.concatenate(out)
            x = np.unique(np.sort(x[x[:, 0] != x[:, 1]], axis=1), axis=0)
            yield pa.record_batch([pa.array(x[:, 0].copy()), pa.array(x[:, 1].copy())], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long").distinct()


def grid_edges(groups: DataFrame, radius: int, tile: int = 4096) -> DataFrame:
    """(a, b) over fingerprints f0: through the grid, and through the second grid in its large cells."""
    cells = grid_cells(groups, radius)
    large, n = _large(cells, tile)
    if not n:
        return edges_in_cells(cells, radius, tile, True)
    small = edges_in_cells(cells.join(sized(large, n), "key", "left_anti"), radius, tile, True)
    return small.unionByName(edges_in_cells(finer_cells(cells.join(sized(large.select("key"), n), "key", "left_semi"), radius), radius, tile)).distinct()


def _similar(ids: list[int], sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Edges that span each component of the sets of the given Jaccard similarity or more."""
    size = np.array([len(x) for x in sets], np.int64)
    values, flat = np.unique(np.concatenate(sets), return_inverse=True)
    bound = np.concatenate([[0], np.cumsum(size)])
    mark = np.zeros(len(values), bool)
    out, rest = [], np.flatnonzero(size)
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        own = np.concatenate([flat[bound[k] : bound[k + 1]] for k in rest])
        start = np.concatenate([[0], np.cumsum(size[rest])[:-1]])
        there = np.ones(len(rest), bool)
        while queue and there.any():
            i = queue.pop()
            mine = flat[bound[i] : bound[i + 1]]
            mark[mine] = True
            common = np.add.reduceat(mark[own].astype(np.int64), start)
            mark[mine] = False
            near = there & (common >= similarity * (size[rest] + size[i] - common) - 1e-9)
            there &= ~near
            out += [(int(ids[i]), int(ids[j])) for j in rest[near]]
            queue += rest[near].tolist()
        rest = rest[there]
    return out


def _runs(batches, keys: int):
    """The rows of record batches as lists of columns, run by run of equal values in the first columns."""
    now, held = None, []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            if row[:keys] != now:
                if held:
                    yield now, held
                now, held = row[:keys], []
            held.append(row[keys:])
    if held:
        yield now, held


def similar_edges(groups: DataFrame, shingle: int, similarity: float, tile: int = 512) -> DataFrame:
    """(a, b) of (root, id, text): ids of one root whose sets of shingles are similar, enough of them to connect all that are."""
    rows = _dealt(groups.select(F.col("root").alias("key"), "id", "text"), tile)

    def run(batches):
        for _, held in _runs(batches, 3):
            e = _similar([i for i, _ in held], [np.unique(shingle_hashes(t, shingle)) for _, t in held], similarity) if len(held) > 1 else []
            if e:
                e = np.sort(np.asarray(e, np.int64), axis=1)
                yield pa.record_batch([pa.array(e[:, 0].copy()), pa.array(e[:, 1].copy())], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long").distinct()


class Sets:
    """Sets of shingles that are compared with each other."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(x) for x in sets], np.int64)
        self.values, self.flat = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_inverse=True)
        self.bound = np.concatenate([[0], np.cumsum(self.size)])
        self.mark = np.zeros(len(self.values) + 1, bool)

    def near(self, mine: np.ndarray, size: int, similarity: float) -> np.ndarray:
        """True for each set that is similar to the one whose values' places are given."""
        self.mark[mine] = True
        common = np.concatenate([[0], np.cumsum(self.mark[self.flat])])[self.bound]
        self.mark[mine] = False
        common = np.diff(common)
        return common >= similarity * (self.size + size - common) - 1e-9

    def near_own(self, i: int, similarity: float) -> np.ndarray:
        return self.near(self.flat[self.bound[i] : self.bound[i + 1]], self.size[i], similarity)

    def near_other(self, x: np.ndarray, similarity: float) -> bool:
        at = np.minimum(np.searchsorted(self.values, x), max(0, len(self.values) - 1))
        return bool(len(self.values)) and bool(self.near(at[self.values[at] == x], len(x), similarity).any())


def stays(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """True for the sets that stay: again and again the one with the most similar ones that are neither kept nor gone, which then go; ties to the first."""
    n, all_ = len(sets), Sets(sets)
    near = np.stack([all_.near_own(i, similarity) for i in range(n)])
    np.fill_diagonal(near, False)
    open_, kept = np.ones(n, bool), np.zeros(n, bool)
    count = near.sum(axis=1)
    while open_.any():
        i = int(np.argmax(np.where(open_, count, -1)))
        if not count[i]:
            kept |= open_
            break
        gone = near[i] & open_
        kept[i] = True
        gone[i] = True
        open_ &= ~gone
        count = count - near[:, gone].sum(axis=1)
    return kept


def gone_of(groups: DataFrame, shingle: int, similarity: float, tile: int = 512) -> DataFrame:
    """(id) of the sets of (root, id, least, text) that go, each similar to one of its root that stays."""
    spark = groups.sparkSession
    parallel = int(spark.conf.get("spark.sql.shuffle.partitions"))
    state = "root long, id long, least long, text string, slices int, stays boolean"
    names = ["root", "id", "least", "text"]

    def choose(batches):
        begin("simhash")
        for (root, slices), held in _runs(batches, 2):
            held.sort(key=lambda r: (r[1] is None, r[1] or 0, r[0]))
            keep = stays([np.unique(shingle_hashes(r[2], shingle)) for r in held], similarity) if len(held) > 1 else [True]
            out = [(root, *r, slices, bool(k)) for r, k in zip(held, keep)]
            yield pa.RecordBatch.from_pylist([dict(zip((*names, "slices", "stays"), r if slices > 1 else (*r[:3], None, *r[4:]))) for r in out], STATE)

    def compare(batches):
        now, leaders, kept = None, [], None
        for b in batches:
            out = []
            for root, part, kind, i, least, text in zip(*(c.to_pylist() for c in b.columns)):
                if (root, part) != now:
                    now, leaders, kept = (root, part), [], None
                own = np.unique(shingle_hashes(text, shingle))
                if kind == 0:
                    leaders.append(own)
                    continue
                kept = kept or Sets(leaders)
                near = kept.near_other(own, similarity)
                out.append({"root": root, "id": i, "least": least, "text": None if near else text, "slices": 0, "stays": not near})
            if out:
                yield pa.RecordBatch.from_pylist(out, STATE)

    rest, out, n = groups.select(*names), None, 0
    rows = groups.count()
    while True:
        n += 1
        sizes = rest.groupBy("root").agg(F.ceil(F.count("*") / tile).cast("int").alias("slices"))
        sizes = store(sizes, "sizes", rows=rows)
        sliced = rest.join(sized(sizes, sizes.count()), "root").withColumn("slice", F.pmod(F.xxhash64("id", F.lit(n)), F.col("slices")).cast("int"))
        first = sliced.where("slice = 0").select("root", "slices", "id", "least", "text").repartition(parallel, "root").sortWithinPartitions("root")
        chosen = store(first.mapInArrow(choose, state), "chosen")  # most of it is ids alone
        gone = chosen.where("not stays").select("id")
        out = gone if out is None else out.unionByName(gone)
        if not sizes.where("slices > 1").count():
            return out
        leaders = chosen.where("stays and slices > 1").select("root", F.explode(F.sequence(F.lit(1), F.col("slices") - 1)).alias("slice"), F.lit(0).alias("kind"), "id", "least", "text")
        others = sliced.where("slice > 0").select("root", "slice", F.lit(1).alias("kind"), "id", "least", "text")
        runs = leaders.unionByName(others).repartition(parallel, "root", "slice").sortWithinPartitions("root", "slice", "kind")
        met = store(runs.mapInArrow(compare, state), "met")
        out = out.unionByName(met.where("not stays").select("id"))
        rest = met.where("stays").select(*names)


STATE = pa.schema([("root", pa.int64()), ("id", pa.int64()), ("least", pa.int64()), ("text", pa.string()), ("slices", pa.int32()), ("stays", pa.bool_())])


def _label(prints: DataFrame, groups: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """Add component_id to prints: the smallest doc_id of everything linked."""
    n = prints.count()
    roots = components(edges, n)
    per_root = roots.join(groups.select(F.col(key).alias("node"), "least"), "node").groupBy("root").agg(F.min("least").alias("smallest"))
    named = roots.join(per_root, "root").select(F.col("node").alias(key), "smallest")
    label = groups.join(named, key, "left").select(key, F.coalesce("smallest", "least").alias("component_id"))
    label = store(label, "labels", rows=n)  # both sides of the next join are then dealt anew, and Spark may split a fingerprint that very many rows share
    return prints.join(label, key, "left")


def links(documents: DataFrame, shingle: int = 3, radius: int = 3, tile: int = 4096) -> DataFrame:
    """(doc_id, fingerprint, component_id): fingerprints link at `radius` or fewer differing bits; no link is lost."""
    prints = store(fingerprints(documents, shingle), "prints")
    groups = prints.groupBy("f0").agg(F.min("doc_id").alias("least"))
    out = _label(prints, groups, grid_edges(groups, radius, tile), "f0")
    return out.select("doc_id", F.lpad(F.lower(F.hex("f0")), 16, "0").alias("fingerprint"), "component_id")


def bit_share(similarity: float) -> float:
    """Share of SimHash bits that differ between sets of a Jaccard similarity."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def banding(rows: int, similarity: float, recall: float) -> tuple[int, int]:
    """(bands, bits of each) for so many rows: about 2 ** ROOM unrelated texts share a cell, linked ones share one of all cells with the wanted recall."""
    bits = max(12, math.ceil(math.log2(max(2, rows))) - ROOM)
    hit = (1 - bit_share(similarity)) ** bits
    return math.ceil(math.log(1 - recall) / math.log(1 - hit)), bits


class Candidates:
    """Sets of shingles, and which of them may be similar."""

    def __init__(self, documents: DataFrame, shingle: int, similarity: float, recall: float, sketch: int, slack: float, tile: int):
        """Candidates are decided on 64 * sketch bits of the fingerprints; slack is added to the share of bits that differ at the
        similarity, as the share that is seen scatters around it (four standard deviations at 128 bits)."""
        rows = documents.count()
        bands, bits = banding(rows, similarity, recall)
        words = max(sketch, -(-bands * bits // 64))
        names = [f"f{k}" for k in range(words)]
        self.prints = store(set_prints(documents, shingle, words), "prints")
        first = F.min(F.struct("doc_id", "t"))
        self.groups = self.prints.groupBy("id").agg(F.min("doc_id").alias("least"), first.alias("of"), *(F.first(x).alias(x) for x in names))
        cells = band_cells(self.groups.select("id", *names), bands, bits, sketch)
        roots = components(edges_in_cells(cells, int(64 * sketch * (bit_share(similarity) + slack)), tile), rows)
        held = store(self.groups.select("id", "least", "of").join(roots.select(F.col("node").alias("id"), "root"), "id"), "held", rows=rows)
        n = held.count()
        texts = documents.select(F.col("doc_id").cast("long").alias("of_id"), F.xxhash64("text").alias("of_t"), "text")
        same = F.col("of_id").eqNullSafe(F.col("of.doc_id")) & (F.col("of_t") == F.col("of.t"))
        both = texts.join(sized(held, n), same)
        # rows may repeat an id and a text
        self.texts = store(both.groupBy("id").agg(F.first("root").alias("root"), F.first("least").alias("least"), F.first("text").alias("text")), "candidates", rows=n, each=TEXTS)
        self.rows, self.n = rows, n


def near_copies(documents: DataFrame, shingle: int = 5, similarity: float = 0.8, recall: float = 0.99, sketch: int = 2, slack: float = 0.13, tile: int = 4096) -> DataFrame:
    """(doc_id, component_id) for texts whose sets of shingles have the given Jaccard similarity or more: components of such links."""
    found = Candidates(documents, shingle, similarity, recall, sketch, slack, tile)
    edges = similar_edges(found.texts, shingle, similarity)
    return _label(found.prints.select("doc_id", "id"), found.groups.select("id", "least"), edges, "id").select("doc_id", "component_id")


def keep_one(documents: DataFrame, shingle: int = 5, similarity: float = 0.8, recall: float = 0.99, sketch: int = 2, slack: float = 0.13, tile: int = 4096) -> DataFrame:
    """documents without those that are similar to one that stays; of equal sets of shingles the smallest doc_id stays.

    Rows that repeat an id are one document: they stay or go together, and stay if any of them would.
    Rows without an id stay, as nothing tells which of them would stand for a group.
    """
    spark = documents.sparkSession
    found = Candidates(documents, shingle, similarity, recall, sketch, slack, tile)
    gone = gone_of(found.texts, shingle, similarity)
    stay = found.groups.select("id", "least").join(gone, "id", "left_anti").select(F.col("least").alias("doc_id"))
    lost = store(found.prints.select("doc_id").where("doc_id is not null").distinct().join(stay, "doc_id", "left_anti"), "lost", rows=found.rows)
    discard(spark, found.prints.vellum_path, found.texts.vellum_path)
    return documents.join(sized(lost, lost.count()), "doc_id", "left_anti").select(*documents.columns)
