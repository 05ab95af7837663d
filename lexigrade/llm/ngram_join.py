"""N-gram Jaccard join: which documents share most of their word n-grams.

A document's set are the distinct hashes (64 bits) of its five-word shingles.
Two documents link when 100 * intersection >= 80 * union. The join is exact:

1. Equal sets fall together by a 128-bit digest; one row stands for each.
2. Sets are ordered by a rough count of each shingle's frequency (a table of
   fixed size over all documents), rare ones first. Linked sets share one of
   their first ``n - ceil(0.8 n) + 1`` shingles, which become join keys.
3. The rows of a key are swept by size. Those within reach of each other's size
   form a band; in a narrow band all pairs are candidates, in a wide one each
   row meets its latest predecessors and its block's leader. Expected-frequent keys are
   split by salts, which bridge rows tie together.
4. Candidates meet in tiles, as hashed bitmaps of two to four bits per shingle.
   They bound the overlap from above, by ``(|A| + |B| - popcount(A xor B)) / 2``.
   Only rows with a pair that may link meet again as sorted arrays, whose
   intersection settles it.
5. Links give components. Keys whose band was wide and whose rows are not all in
   one component get the rest: size-banded tiles of bounded row count, each
   against itself and those within reach, where rows of one component need no
   further comparison: first a few pairs of each two components, then all that
   are still apart. Then components are drawn again.

Tables that grow with the data are joined by merging, at every size.
Hence no link between different texts is lost, and a group of near copies costs
about its size, not its square. What does cost more is a key whose many rows
stay in many components after the first links: each of their tiles meets the
others of its sizes, as narrow rows, of which few remain.

Defined cases: a null or empty text, or one without words, has an empty set
and links with nothing; fewer than five words are one shingle; repeated rows
are equal sets; null ids take part, and never name a component if another id is
there; an empty table gives no rows; extra columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Shelf, flat, fresh, lower_table, mixed, ragged, range_hashes, shuffle_partitions, slices, small_batches, space_mask, spans, table, written
from .components import components

WORDS = 5
#: The threshold as a fraction.
NUM, DEN = 80, 100
#: log2 of the counters of the frequency table. Every task sends its counters, so their number does not grow with the rows.
SKETCH = 18
#: log2 of the bits by which texts that no candidate needs are left out, at least and at most.
WANTED, WANTED_MOST = 20, 24
#: Rows of a band up to which all pairs are candidates, rows under one leader, rows of a key's salt, rows of a tile's side, partners of a unit, parts of a row's partners in tiles.
NARROW, LEADER, SALT, TILE, PARTNERS, SPLIT = 6, 64, 8192, 128, 32, 16

_STEP = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


def shingle_sets(column: pa.Array, words: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every text of a column, in order."""
    data, offsets = flat(column)
    lower, inside = lower_table(), space_mask()
    for at, to in slices(offsets):
        part, offs = lower[data[offsets[at] : offsets[to]]], offsets[at : to + 1] - offsets[at]
        starts, ends, first = spans(part, offs, inside)
        hashes = range_hashes(part, starts, ends)
        n = len(hashes)
        with np.errstate(over="ignore"):
            rows = np.zeros(max(0, n - words + 1), np.uint64)
            for j in range(words if len(rows) else 0):
                rows += hashes[j : n - words + 1 + j] * _STEP[j % 5] * np.uint64(2 * (j // 5) + 1)
            rows = mixed(rows)
            for i in range(to - at):
                a, b = first[i], first[i + 1]
                if b - a >= words:
                    yield np.unique(rows[a : b - words + 1])
                elif b > a:
                    few = sum((hashes[a + j] * _STEP[j] for j in range(b - a)), np.uint64(b - a))
                    yield mixed(np.array([few], np.uint64))
                else:
                    yield rows[:0]


def set_digest(shingles: np.ndarray) -> bytes:
    """16 bytes that tell sets apart."""
    with np.errstate(over="ignore"):
        return int(shingles.sum(dtype=np.uint64)).to_bytes(8, "little") + int(mixed(shingles ^ _STEP[1]).sum(dtype=np.uint64)).to_bytes(8, "little")


def least_overlap(a: int, b: int) -> int:
    """Shingles that sets of sizes a and b must share to link."""
    return -(-NUM * (a + b) // (NUM + DEN))


def prefix_length(n: int) -> int:
    return n - -(-NUM * n // DEN) + 1 if n else 0


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """A bitmap with a bit for each shingle: bytes of a power of two of bits, two to four per shingle, 64 at least."""
    width = max(64, 1 << (2 * len(shingles) - 1).bit_length()) if len(shingles) else 64
    out = np.zeros(width, bool)
    out[(shingles & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(out)


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """A bitmap of ``size`` bytes from a longer one: places are hashes modulo a power of two, so parts lie on top of each other."""
    return bits if len(bits) == size else np.bitwise_or.reduce(bits.reshape(-1, size), axis=0)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return DEN * both >= NUM * (len(a) + len(b) - both)


def bits_for(n: int, least: int, most: int) -> int:
    """log2 of a table's size for n rows, four or more entries each within the limits."""
    return min(most, max(least, (4 * max(1, n) - 1).bit_length()))


def frequency_table(docs: DataFrame, bits: int) -> np.ndarray:
    """Counters of shingles by their leading bits, over all texts. Its size is fixed, so it may travel to the driver and back."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int64)
        for batch in batches:
            slots = [(s >> np.uint64(64 - bits)).astype(np.int64) for s in shingle_sets(batch.column(0))]
            total += np.bincount(np.concatenate([*slots, np.zeros(0, np.int64)]), minlength=1 << bits)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["slot", "n"])

    rows = docs.select("text").mapInArrow(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    got = rows.toArrow()
    out = np.zeros(1 << bits, np.int64)
    out[got["slot"].to_numpy()] = got["n"].to_numpy()
    return out


def _prepared(docs: DataFrame, sketch: np.ndarray, shelf: Shelf) -> DataFrame:
    """nid, id, mark (a hash of the text), n, sid, bits and, for the first row of a set within its task, the keys in order."""
    kind = dict(docs.dtypes)["id"]
    shared = docs.sparkSession.sparkContext.broadcast(sketch)
    shift = np.uint64(64 - (len(sketch) - 1).bit_length())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = shared.value, set()
        for batch in batches:
            sizes, sids, keys, bits = [], [], [], []
            for s in shingle_sets(batch.column(1)):
                n = len(s)
                sizes.append(n)
                sid = set_digest(s) if n else None
                sids.append(sid)
                if sid is None or sid in seen:
                    keys.append(np.zeros(0, np.int64))
                    bits.append(None)
                    continue
                if len(seen) >= 1 << 19:
                    seen.clear()
                seen.add(sid)
                order = np.lexsort((s, counts[(s >> shift).astype(np.int64)]))
                keys.append(s[order[: prefix_length(n)]].view(np.int64))
                bits.append(bitmap(s).tobytes())
            first = np.cumsum([0, *map(len, keys)])
            flat_keys = np.concatenate([*keys, np.zeros(0, np.int64)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(sizes, pa.int32()), pa.array(sids, pa.binary()), pa.array(bits, pa.binary()), ragged(flat_keys, first, pa.int64())],
                ["id", "mark", "n", "sid", "bits", "keys"],
            )

    out = docs.select("id", "text", F.xxhash64("text").alias("mark")).mapInArrow(run, f"id {kind}, mark long, n int, sid binary, bits binary, keys array<long>")
    return shelf.put(out.withColumn("nid", F.monotonically_increasing_id()), "sets")


def _key_rows(reps: DataFrame, sketch: np.ndarray) -> DataFrame:
    """(key, salt, pos, n, nid): a row per key of each set.

    Keys of slots far above the mean are salted, by a table of at most as many
    rows as the sketch; their rows also go to salt -1 now and then, as bridges.
    """
    rows = reps.select("nid", "n", F.posexplode("keys").alias("pos", "key"))
    parts = 1 + np.maximum(sketch - 2 * int(sketch.mean()), 0) // SALT
    hot = np.flatnonzero(parts > 1)
    if not len(hot):
        return rows.select("key", F.lit(0).alias("salt"), "pos", "n", "nid")
    known = reps.sparkSession.createDataFrame([(int(h), int(parts[h])) for h in hot], "slot long, parts int")
    rows = rows.join(F.broadcast(known), F.shiftrightunsigned("key", 64 - (len(sketch) - 1).bit_length()) == F.col("slot"), "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    salt = F.when(F.col("parts") == 1, F.lit(0)).otherwise(1 + F.pmod(F.xxhash64("nid"), F.col("parts")).cast("int"))
    bridge = (F.col("parts") > 1) & (F.pmod(F.xxhash64("nid", F.lit(7)), F.col("parts")) == 0)
    return rows.withColumn("salt", F.explode(F.when(bridge, F.array(salt, F.lit(-1))).otherwise(F.array(salt)))).select("key", "salt", "pos", "n", "nid")


def _candidates(key_rows: DataFrame) -> DataFrame:
    """(a, b, key, n, pos): candidate pairs (a, b), and the rows (a = nid, key, n, pos) of keys that were swept in part only."""
    dealt = key_rows.repartition(shuffle_partitions(key_rows.sparkSession), "key", "salt").sortWithinPartitions("key", "salt", "n", "nid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, wide = None, False
        band: list[tuple[int, int, int]] = []  # (n, nid, pos): the latest rows, of those within reach
        early: list[tuple[int, int, int]] = []  # a key's rows as long as nothing was left out
        leader, since = None, 0
        for batch in batches:
            key, salt, pos, n, nid = (batch.column(i).to_numpy() for i in range(5))
            # Most keys have one row: they need no loop.
            same = np.zeros(len(key), bool)
            same[1:] = (key[1:] == key[:-1]) & (salt[1:] == salt[:-1])
            lively = same.copy()
            lively[:-1] |= same[1:]
            lively |= salt != 0
            if len(key):
                lively[0] |= last == (int(key[0]), int(salt[0]))
                lively[-1] = True  # the next batch may go on with it
            pairs: dict[tuple[int, int], None] = {}
            members: list[tuple[int, int, int, int]] = []  # nid, key, n, pos
            for i in np.flatnonzero(lively).tolist():
                now = (int(key[i]), int(salt[i]))
                if now != last:
                    last, wide, band, early, leader, since = now, now[1] > 0, [], [], None, 0
                me = (int(n[i]), int(nid[i]), int(pos[i]))
                kept = [x for x in band if DEN * x[0] >= NUM * me[0]]
                partners = kept
                if len(kept) > NARROW:  # more rows are in reach than are paired
                    partners = kept[-2:]
                    if not wide and now[1] >= 0:
                        wide = True
                        members += [(y, now[0], x, z) for x, y, z in early]
                    if leader is not None and DEN * leader[0] >= NUM * me[0] and leader not in partners:
                        partners = [*partners, leader]
                if wide and now[1] >= 0:
                    members.append((me[1], now[0], me[0], me[2]))
                else:
                    early.append(me)
                for size, other, q in partners:
                    if min(size - q, me[0] - me[2]) >= least_overlap(size, me[0]):
                        pairs[min(other, me[1]), max(other, me[1])] = None
                if leader is None or since % LEADER == 0:
                    leader = me
                band = [*kept[-NARROW:], me]
                since += 1
            none, nones = [None] * len(members), [None] * len(pairs)
            columns = ([x for x, _ in pairs] + [x[0] for x in members], [y for _, y in pairs] + none, *(nones + [x[k] for x in members] for k in (1, 2, 3)))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b", "key", "n", "pos"])

    return dealt.mapInArrow(run, "a long, b long, key long, n long, pos long")


class _Forest:
    """Components of a tile, joined as links are found."""

    def __init__(self) -> None:
        self.top: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (y := self.top.get(x, x)) != x:
            self.top[x] = self.top.get(y, y)
            x = y
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        self.top[max(a, b)] = min(a, b)


def _reach(side: list[int], n: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each row of a tile with those it has to meet and whose size is within reach: side 0 meets 1, side 2 meets itself."""
    right = np.array([k for k, x in enumerate(side) if x in (1, 2)], np.int64)
    for i in (k for k, x in enumerate(side) if x in (0, 2)):
        js = right[right > i] if side[i] == 2 else right
        js = js[DEN * np.minimum(n[js], n[i]) >= NUM * np.maximum(n[js], n[i])]
        if len(js):
            yield i, js


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows of each unit, from batches in which units lie together; a unit's rows that repeat a nid and side count once."""
    now, held = None, {}
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[0] != now:
                if len(held) > 1:
                    yield list(held.values())
                now, held = row[0], {}
            held[row[1], row[3]] = row
    if len(held) > 1:
        yield list(held.values())


def _dealt(rows: DataFrame) -> DataFrame:
    small_batches(rows)
    return rows.repartition(shuffle_partitions(rows.sparkSession), "unit").sortWithinPartitions("unit")


def _alive(units: DataFrame, sets: DataFrame) -> DataFrame:
    """The rows (unit, side, comp, nid, id, sid) of units that have a partner in another component whose bitmap does not rule it out."""
    rows = units.join(sets.select("nid", "id", "sid", "n", "bits").hint("merge"), "nid").select("unit", "side", "comp", "nid", "n", "bits", "id", "sid")
    kind = dict(sets.dtypes)["id"]
    fields = f"unit long, side int, comp long, nid long, id {kind}, sid binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = iter(batches)
        head = next(batches, None)
        if head is None:
            return
        id_type = head.schema.field("id").type
        out: list[tuple] = []

        def packed() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), id_type, pa.binary())
            columns = [pa.array([x[i] for x in out], k) for i, k in zip((0, 1, 2, 3, 6, 7), kinds, strict=True)]
            return pa.RecordBatch.from_arrays(columns, ["unit", "side", "comp", "nid", "id", "sid"])

        def again() -> Iterator[pa.RecordBatch]:
            yield head
            yield from batches

        for tile in _tiles(again()):
            n = np.array([x[4] for x in tile])
            comp = np.array([x[2] for x in tile])
            raw = [np.frombuffer(x[5], np.uint8) for x in tile]
            least = min(map(len, raw))
            grids = {}
            while least <= max(map(len, raw)):  # all bitmaps at the lengths that occur, as far as they reach
                if any(len(r) == least for r in raw):
                    fits = np.array([k for k, r in enumerate(raw) if len(r) >= least])
                    place = np.full(len(raw), -1)
                    place[fits] = np.arange(len(fits))
                    grids[least] = (np.array([folded(raw[k], least) for k in fits]).view(np.uint64), place)
                least *= 2
            live = np.zeros(len(tile), bool)
            sizes = np.array([len(r) for r in raw])
            for i, js in _reach([x[1] for x in tile], n):
                js = js[comp[js] != comp[i]]
                common = np.minimum(sizes[js], sizes[i])
                for size in np.unique(common).tolist():
                    part = js[common == size]
                    grid, place = grids[size]
                    apart = np.bitwise_count(grid[place[part]] ^ grid[place[i]]).sum(axis=1, dtype=np.int64)
                    ok = (n[part] + n[i] - apart) // 2 >= -(-NUM * (n[part] + n[i]) // (NUM + DEN))
                    live[part[ok]] = True
                    live[i] |= ok.any()
            out += [tile[k] for k in np.flatnonzero(live)]
            if len(out) > 5000:
                yield packed()
                out = []
        yield packed()

    return _dealt(rows).mapInArrow(run, fields)


def _with_arrays(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows (unit, side, comp, nid, shingles) of rows (unit, side, comp, nid, id, sid).

    Texts whose id is wanted by no row are left out by a bitmap over hashes of
    the ids, so their sets are not shuffled; beyond its greatest size it lets
    more of them pass, and the join drops them. Rows that repeat an id are told
    apart by their digest.
    """
    width = 1 << bits_for(rows.count(), WANTED, WANTED_MOST)
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(width)).cast("int")
    got = rows.select(slot("id").alias("slot")).distinct().toArrow()  # bounded by the bitmap's size
    wanted = np.zeros(width, bool)
    wanted[got["slot"].to_numpy()] = True
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(wanted))
    kind = dict(docs.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            batch = batch.filter(pa.array(bits[batch.column(2).to_numpy()]))
            if batch.num_rows:
                sets = list(shingle_sets(batch.column(1)))
                columns = [batch.column(0), pa.array([set_digest(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["own", "own_sid", "shingles"])

    small_batches(docs)
    made = docs.select("id", "text", slot("id").alias("slot")).mapInArrow(run, f"own {kind}, own_sid binary, shingles binary")
    both = made.join(rows.hint("merge"), F.col("id").eqNullSafe(F.col("own")) & (F.col("sid") == F.col("own_sid")))
    return both.select("unit", "side", "comp", "nid", "shingles")


def _settled(rows: DataFrame) -> DataFrame:
    """Links (a, b) of rows (unit, side, comp, nid, shingles), by the sorted arrays.

    Rows of one component are not compared, and links found join components at once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links: list[tuple[int, int]] = []

        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], ["a", "b"])

        for tile in _tiles(batches):
            sets = [np.frombuffer(x[4], np.uint64) for x in tile]
            forest = _Forest()
            for i, js in _reach([x[1] for x in tile], np.array([len(s) for s in sets])):
                for j in js.tolist():
                    a, b = tile[i][2], tile[j][2]
                    if forest.root(a) != forest.root(b) and linked(sets[i], sets[j]):
                        forest.join(a, b)
                        links.append((min(tile[i][3], tile[j][3]), max(tile[i][3], tile[j][3])))
            if len(links) > 5000:
                yield packed()
                links = []
        yield packed()

    return _dealt(rows).mapInArrow(run, "a long, b long")


def _led(pairs: DataFrame) -> DataFrame:
    """Units (unit, side, comp, nid) of pairs (a, b): each row that leads pairs, with PARTNERS of its partners or so at a time."""
    many = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PARTNERS).cast("int").alias("units"))
    part = F.pmod(F.xxhash64("b", F.lit(3)), F.col("units")).cast("int")
    unit = F.xxhash64("a", "part").alias("unit")  # should two units fall together, their rows meet too, which does no harm
    both = pairs.join(many, "a").withColumn("part", part).select(unit, F.lit(1).alias("side"), F.col("b").alias("nid"))
    lead = many.select("a", F.explode(F.sequence(F.lit(0), F.col("units") - 1)).alias("part")).select(unit, F.lit(0).alias("side"), F.col("a").alias("nid"))
    return both.unionByName(lead).select("unit", "side", F.col("nid").alias("comp"), "nid")


def _links(docs: DataFrame, sets: DataFrame, units: DataFrame, shelf: Shelf) -> DataFrame:
    """The links that units (unit, side, comp, nid) hold."""
    return shelf.put(_settled(_with_arrays(docs, shelf.put(_alive(units, sets), "alive"))), "links")


def _rest(swept: DataFrame, comps: DataFrame, shelf: Shelf) -> DataFrame:
    """Units (unit, side, comp, nid, n, pos) of the rows (key, nid, n, pos) of keys that were swept in part and still join several components.

    A key of few rows is a unit. The rows of others form bands of sizes, a band
    tiles of some TILE rows; a tile meets the tiles of its band and of the next.
    Rows of the key's greatest component have tiles of their own, which do not
    meet each other. So a row is copied as often as there are tiles of rows
    outside that component; only a key whose rows are in many components has
    copies beyond their number. Rows are narrow: sizes and places alone.
    """
    rows = swept.join(comps.select(F.col("node").alias("nid"), "comp"), "nid", "left").withColumn("comp", F.coalesce("comp", "nid"))
    rows = shelf.put(rows, "rest")
    parts = rows.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"))
    keys = parts.groupBy("key").agg(F.count(F.lit(1)).alias("comps"), F.max(F.struct("c", "comp")).alias("great"), F.sum("c").alias("rows")).where("comps > 1")
    keys = shelf.put(keys.select("key", "rows", F.col("great.comp").alias("great")), "keys")
    small = rows.join(keys.where(F.col("rows") <= 2 * TILE).select("key"), "key", "left_semi").select(F.col("key").alias("unit"), F.lit(2).alias("side"), "comp", "nid", "n", "pos")
    rows = rows.join(keys.where(F.col("rows") > 2 * TILE).select("key", "great"), "key").withColumn("great", (F.col("great") == F.col("comp")).cast("int"))
    rows = rows.withColumn("band", F.floor(F.log("n") / F.log(F.lit(DEN / NUM)) + F.lit(1e-9)).cast("int"))
    sizes = shelf.put(rows.groupBy("key", "band", "great").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles")), "bands")
    around = sizes.select(F.col("key").alias("near"), "tiles", F.explode(F.array(*[(F.col("band") + d).alias("d") for d in (-1, 0, 1)])).alias("of"), F.col("band").alias("other"), F.col("great").alias("too"))
    rows = rows.join(sizes, ["key", "band", "great"]).withColumn("tile", F.pmod(F.xxhash64("nid"), F.col("tiles")).cast("int")).drop("tiles")
    met = rows.join(around, (F.col("key") == F.col("near")) & (F.col("band") == F.col("of")) & (F.col("great") + F.col("too") < 2))
    met = met.select("key", "band", "great", "tile", "other", "too", "nid", "comp", "n", "pos", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("j"))
    mine, theirs = F.struct("band", "great", "tile"), F.struct(F.col("other").alias("band"), F.col("too").alias("great"), F.col("j").alias("tile"))
    # A hash names the pair of tiles; should two pairs fall together, their rows meet too, which does no harm.
    unit = F.xxhash64("key", F.least(mine, theirs), F.greatest(mine, theirs))
    side = F.when(mine == theirs, 2).when(mine < theirs, 0).otherwise(1)
    return small.unionByName(met.select(unit.alias("unit"), side.alias("side"), "comp", "nid", "n", "pos"))


def _sifted(units: DataFrame, most: int | None) -> DataFrame:
    """Units (unit, side, comp, nid) of the rows whose sizes and places leave a link open.

    With ``most``, only so many pairs of each two components of a tile, those of
    the closest sizes first: they join most components that can be joined, and
    the round without ``most`` settles what is left.

    Where few pairs of a tile remain, each pair's rows meet under the pair's
    first, with one of SPLIT parts of its partners; where many do, the tile stays as it is. Of all keys that a pair
    shares, the bound by places holds at the first, so no link is lost.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[tuple, None] = {}

        def packed() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], ["unit", "side", "comp", "nid"])

        for tile in _tiles(batches):
            n, pos, comp = (np.array([x[i] for x in tile]) for i in (4, 5, 2))
            found: list[tuple[int, int]] = []
            for i, js in _reach([x[1] for x in tile], n):
                js = js[comp[js] != comp[i]]
                open_ = np.minimum(n[js] - pos[js], n[i] - pos[i]) >= -(-NUM * (n[js] + n[i]) // (NUM + DEN))
                found += [(i, j) for j in js[open_].tolist()]
            if most is not None:
                found.sort(key=lambda p: (abs(int(n[p[0]]) - int(n[p[1]])), *sorted((tile[p[0]][3], tile[p[1]][3]))))
                taken: dict[tuple[int, int], int] = {}
                few = []
                for i, j in found:
                    two = (min(comp[i], comp[j]), max(comp[i], comp[j]))
                    taken[two] = taken.get(two, 0) + 1
                    if taken[two] <= most:
                        few.append((i, j))
                found = few
            if len(found) <= 64 * len(tile):
                for i, j in found:
                    a, b = (tile[i], tile[j]) if tile[i][3] < tile[j][3] else (tile[j], tile[i])
                    unit = (a[3] * SPLIT + b[3] % SPLIT) * 2 + 1  # odd: apart from most tiles' names; rows of two units that fall together meet too
                    unit = (unit + (1 << 63)) % (1 << 64) - (1 << 63)
                    out[unit, 0, a[2], a[3]] = None
                    out[unit, 1, b[2], b[3]] = None
            else:
                for k in {x for p in found for x in p}:
                    out[tile[k][:4]] = None
            if len(out) > 20000:
                yield packed()
                out = {}
        yield packed()

    return _dealt(units).mapInArrow(run, "unit long, side int, comp long, nid long").distinct()


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """nid, id, mark, n_shingles, component (least id; the row's own id if alone) and keeper of every row.

    ``keeper`` marks one row per component: of its rows the one of least id, and of
    those the first; every row with an empty set is its own.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    small_batches(docs)
    shelf = Shelf(docs.sparkSession, "ngrams", "snappy")  # over twenty tables
    sketch = frequency_table(docs, SKETCH)
    sets = _prepared(docs, sketch, shelf)
    first = shelf.put(sets.where("n > 0").groupBy("sid").agg(F.min("nid").alias("rep")), "reps")
    reps = sets.join(first.select(F.col("rep").alias("nid")).hint("merge"), "nid", "left_semi")
    found = shelf.put(_candidates(_key_rows(reps, sketch)), "found")
    pairs = shelf.put(found.where("b IS NOT NULL").select("a", "b").distinct(), "pairs")
    links = _links(docs, sets, _led(pairs), shelf)
    comps = components(links, shelf)
    swept = found.where("key IS NOT NULL").select("key", F.col("a").alias("nid"), "n", "pos")
    for most in (3, None):
        more = _links(docs, sets, shelf.put(_sifted(_rest(swept, comps, shelf), most), "sifted"), shelf)
        if not more.isEmpty():
            links = shelf.put(links.unionByName(more), "every")
            comps = components(links, shelf)
    groups = first.join(comps.select(F.col("node").alias("rep"), "comp"), "rep", "left").select("sid", F.coalesce("comp", "rep").alias("comp"))
    rows = sets.select("nid", "id", "mark", "n", "sid").join(shelf.put(groups, "groups").hint("merge"), "sid", "left")
    rows = shelf.put(rows.select("nid", "id", "mark", "n", F.coalesce("comp", "nid").alias("comp")), "rows")
    names = rows.groupBy("comp").agg(F.min("id").alias("name"), F.min(F.struct(F.col("id").isNull(), "id", "nid")).alias("k"), F.count(F.lit(1)).alias("size"))
    names = shelf.put(names.select("comp", "name", F.col("k.nid").alias("keep"), "size").where("size > 1"), "names")
    shelf.clear("rows", "names")
    out = rows.join(names, "comp", "left")
    return out.select("nid", "id", "mark", F.col("n").cast("long").alias("n_shingles"), F.coalesce("name", "id").alias("component"), (F.coalesce("keep", "nid") == F.col("nid")).alias("keeper"), F.coalesce("size", F.lit(1)).alias("group_size"))


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component: that of the least id. Their columns are their own, whatever their names are."""
    keep, keep_mark, mark, key, key_mark = fresh(docs.columns, "keep", "keep_mark", "mark", "key", "key_mark")
    keepers = join(docs, id_col, text_col).where("keeper").groupBy("id", "mark").agg(F.count(F.lit(1)).alias("n"))
    keepers = written(keepers.select(F.col("id").alias(keep), F.col("mark").alias(keep_mark), "n"), "keepers")
    rows = docs.withColumn(mark, F.xxhash64(text_col))
    stay = rows.join(keepers, (F.col(mark) == F.col(keep_mark)) & F.col(id_col).eqNullSafe(F.col(keep)), "left_semi")
    again = rows.groupBy(id_col, mark).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if not again.isEmpty():  # repeated rows: of those alike in id and text, as many stay as are keepers, one or all without words
        alone = keepers.where("n > 1").select(F.col(keep).alias(key), F.col(keep_mark).alias(key_mark))
        many = stay.join(alone, (F.col(mark) == F.col(key_mark)) & F.col(id_col).eqNullSafe(F.col(key)), "left_semi")
        few = stay.join(alone, (F.col(mark) == F.col(key_mark)) & F.col(id_col).eqNullSafe(F.col(key)), "left_anti")
        stay = few.dropDuplicates([id_col, mark]).unionByName(many)
    return stay.select(*docs.columns)


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents and their components."""
    return join(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


ORACLE_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\v\\f\\r]+'), lambda x: x <> '') AS ws
  FROM documents
), g AS (
  SELECT DISTINCT doc_id, sh FROM (
    SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
      ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM w
  )
), n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS c FROM r GROUP BY a) m USING (doc_id)
"""
