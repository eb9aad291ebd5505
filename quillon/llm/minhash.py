"""MinHash near-duplicate detection with odd sketches for the candidates of the bands.

1. One pass turns each text into its set of word shingles (64-bit hashes), its
   MinHash samples, ``bands`` hashes of ``rows`` samples each, and an odd
   sketch: the samples folded into a parity bitmap, whose XOR population count
   estimates a high similarity precisely.
2. Equal sets collapse to one representative.  Representatives that share a
   band meet in buckets; buckets of up to ``small_bucket`` members give all
   their pairs, larger ones a star (which joins more than need be, never less).
   Hot buckets are contracted to stars before the shuffle.
3. Pairs whose odd sketches differ by too many bits go.  What stays makes loose
   components, which hold each true component whole.
4. Only members of loose components have their texts read again, once, and every link
   is confirmed exactly on full sets.  A component is dealt into parts of bounded
   size.  Some members, the pivots, go to each part and tie the parts together: the
   hub, which shares most bands with the component's commonest ones (copies of one
   text are nearer to it than to each other), and a few others.  What the parts link
   makes groups.
5. Where a component falls into several groups, all of them but the largest are
   compared, block by block, with each other and with the largest.

With 48 bands of 5 rows a pair at similarity 0.8 shares no band with
probability (1 - 0.8^5)^48 = 5e-9; the sketch filter allows six deviations.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.bitmap import all_set, bitmap, bits_for, places
from quillon.llm.common import kept, shared_dir, string_buffers, without_rows, written
from quillon.llm.components import connected_components
from quillon.llm.words import SPACED, WordHasher, mix

SKETCH_BITS = 1024
#: How far below the wanted similarity the sketches' estimate may lie.
SKETCH_SLACK = 0.18
#: Members of a component that go to each of its parts.
PIVOTS = 4


def shingle_sets(raw: np.ndarray, off: np.ndarray, words: int, hasher: WordHasher):
    """The sorted set of shingle hashes of each text: fewer words make one shingle, none an empty set."""
    for _, h, bounds, _, _ in hasher.documents(raw, off):
        with np.errstate(over="ignore"):
            whole = h * np.uint64(2 * words + 1) if len(h) else h
            rolled = np.zeros(max(0, len(h) - words + 1), np.uint64)
            for k in range(words):
                rolled = rolled * np.uint64(0xD6E8FEB86659FD93) + h[k : len(h) - words + 1 + k] if len(rolled) else rolled
            rolled = mix(rolled)
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                if b - a >= words:
                    yield np.unique(rolled[a : b - words + 1])
                elif b > a:
                    one = np.uint64(0)
                    for x in whole[a:b]:
                        one = one * np.uint64(0xD6E8FEB86659FD93) + x
                    yield mix(np.array([one ^ np.uint64(b - a)]))
                else:
                    yield np.zeros(0, np.uint64)


class Signatures:
    """Samples, band hashes and odd sketches of shingle sets."""

    def __init__(self, bands: int, rows: int):
        rng = np.random.Generator(np.random.PCG64(7))
        self.bands, self.rows, self.k = bands, rows, bands * rows
        self.mul = rng.integers(0, 1 << 31, self.k, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.add = rng.integers(0, 1 << 32, self.k, dtype=np.uint32)

    def samples(self, shingles: np.ndarray) -> np.ndarray:
        low = np.full(self.k, 0xFFFFFFFF, np.uint32)
        x = (shingles >> np.uint64(32)).astype(np.uint32)
        with np.errstate(over="ignore"):
            for at in range(0, len(x), 2048):
                np.minimum(low, (self.mul[:, None] * x[None, at : at + 2048] + self.add[:, None]).min(axis=1), out=low)
        return low

    def band_hashes(self, low: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = np.broadcast_to(np.arange(1, self.bands + 1, dtype=np.uint64), (len(low), self.bands))
            for r in range(self.rows):
                h = mix(h * np.uint64(0x9E3779B97F4A7C15) + low[:, r :: self.rows][:, : self.bands])
        return h.view(np.int64)

    def odd_sketches(self, low: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            at = mix(low.astype(np.uint64) + (np.arange(self.k, dtype=np.uint64) << np.uint64(32))) % np.uint64(SKETCH_BITS)
        flat = (np.arange(len(low))[:, None] * SKETCH_BITS + at.astype(np.int64)).ravel()
        odd = (np.bincount(flat, minlength=len(low) * SKETCH_BITS) & 1).astype(np.uint8).reshape(len(low), SKETCH_BITS)
        return np.packbits(odd, axis=1).view(np.int64)


def most_odd_bits(similarity: float, samples: int) -> int:
    """Bits in which two odd sketches may differ for the pair to stay a candidate."""
    low = max(0.0, similarity - SKETCH_SLACK)
    return int(SKETCH_BITS / 2 * (1 - (1 - 2 / SKETCH_BITS) ** (2 * samples * (1 - low)))) + 1


def _lists(values: np.ndarray) -> pa.Array:
    n, k = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * k), pa.array(values.ravel()))


def _signature_udf(words: int, bands: int, rows: int):
    def run(batches):
        hasher, sign = kept(("signatures", bands, rows), lambda: (WordHasher(SPACED), Signatures(bands, rows)))
        for batch in batches:
            raw, off = string_buffers(batch.column(1))
            lows, sizes, keys, done = [], [], [], 0
            for s in shingle_sets(raw, off, words, hasher):
                lows.append(sign.samples(s))
                sizes.append(len(s))
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                if len(lows) == 1000 or done + len(lows) == batch.num_rows:
                    low, n = np.array(lows), len(lows)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(done, n), batch.column(2).slice(done, n), batch.column(3).slice(done, n), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), _lists(sign.odd_sketches(low)), _lists(sign.band_hashes(low))],
                        ["__id", "__xx", "__row", "n", "key", "sketch", "bands"],
                    )
                    done += n
                    lows, sizes, keys = [], [], []

    return run


def _stars_before_shuffle(small: int):
    """(bucket, member, star): members of a bucket with over ``small`` of them in this batch go as a star's pivot."""

    def run(batches):
        for batch in batches:
            rep = np.asarray(batch.column(0))
            bands = batch.column(1)
            bucket, who = np.asarray(bands.flatten()), np.repeat(rep, np.diff(np.asarray(bands.offsets)))
            order = np.lexsort((who, bucket))
            bucket, who = bucket[order], who[order]
            start = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
            size = np.diff(np.r_[start, len(bucket)])
            many = np.repeat(size > small, size)
            pivot = np.repeat(who[start], size)
            first = np.zeros(len(who), bool)
            first[start] = True
            edge = many & ~first
            # an edge is done: it goes wherever its member's number leads
            bucket, pivot = np.where(edge, who, bucket), np.where(edge, pivot, -1)
            yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(who), pa.array(pivot), pa.array(many)], ["bucket", "member", "pivot", "star"])

    return run


def _pairs_of_buckets(small: int):
    """Rows sorted by bucket -> (a, b, star).  Only the first ``small`` members of a bucket are held."""

    def emit(a, b, star):
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(star, pa.bool_())], ["a", "b", "star"])

    def run(batches):
        bucket, held, star = None, [], False
        out: list[tuple[int, int, bool]] = []

        def close():
            if len(held) > 1:
                out.extend((held[0], x, True) for x in held[1:]) if star else out.extend((x, y, False) for x, y in combinations(held, 2))

        for batch in batches:
            b, m, pivot = (np.asarray(batch.column(i)) for i in range(3))
            s = batch.column(3).to_numpy(zero_copy_only=False)
            if (done := pivot >= 0).any():
                yield emit(pivot[done], m[done], s[done])
                b, m, s = b[~done], m[~done], s[~done]
            # members alone in their bucket are most of the rows: they are passed over at once
            alone = np.r_[True, b[1:] != b[:-1]] & np.r_[b[1:] != b[:-1], True] if len(b) else np.zeros(0, bool)
            if len(b):
                alone[0] &= b[0] != bucket
                alone[-1] = False
            for i in np.flatnonzero(~alone).tolist():
                if b[i] != bucket:
                    close()
                    bucket, held, star = b[i], [], False
                star |= bool(s[i])
                if len(held) < small:
                    held.append(int(m[i]))
                else:
                    if not star:
                        star = True
                    out.append((held[0], int(m[i]), True))
            if len(out) > 50_000:
                yield emit(*map(list, zip(*out, strict=True)))
                out.clear()
        close()
        if out:
            yield emit(*map(list, zip(*out, strict=True)))

    return run


def link_groups(sets: list[np.ndarray], percent: int) -> list[int]:
    """For each set the index of the first set of its component under 100 * |a & b| >= percent * |a | b|.

    A component is searched breadth first: each of its sets is compared with
    all sets not yet reached at once, so a dense group costs little more than its size.
    """
    n = len(sets)
    if not n:
        return []
    root = np.full(n, -1)
    size = np.array([len(s) for s in sets])
    code = np.unique(np.concatenate(sets), return_inverse=True)[1]
    mark = np.zeros(int(code.max(initial=-1)) + 1, bool)
    bound = np.r_[0, np.cumsum(size)]
    own = [code[a:b] for a, b in zip(bound[:-1], bound[1:], strict=True)]
    left = np.arange(n)  # not yet reached; with their codes and starts
    codes, starts = code, bound[:-1]
    for seed in range(n):
        if root[seed] >= 0:
            continue
        root[seed], queue = seed, [seed]
        while queue:
            x = queue.pop()
            open_ = root[left] < 0
            if not open_.any():
                return root.tolist()
            if open_.sum() <= 0.7 * len(left):
                left = left[open_]
                codes = np.concatenate([own[i] for i in left])
                starts = np.r_[0, np.cumsum(size[left])][:-1]
                open_ = np.ones(len(left), bool)
            mark[own[x]] = True
            both = np.add.reduceat(mark[codes].astype(np.int64), starts)
            mark[own[x]] = False
            near = open_ & (100 * both >= percent * (size[x] + size[left] - both))
            root[left[near]] = seed
            queue += left[near].tolist()
    return root.tolist()


def _known_udf(known, bits: int):
    """(id, xx, text) -> the rows whose hash is in the map."""

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(all_set(known.value, places(batch.column(1), bits))))

    return run


_LINKS = "a long, b long, parts long, shingles array<long>"


def _verify(words: int, percent: int):
    """Rows (comp, tile, parts, row, own, text) sorted by tile -> each document's edge to the first of its component within the tile.

    Documents of components in several parts are put out with their shingle sets too
    (b is null there), from the part that is their own.
    """

    def out(a, b, parts, sets):
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(parts, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["a", "b", "parts", "shingles"])

    def run(batches):
        hasher = kept("spaced", lambda: WordHasher(SPACED))
        tile, rows, sets, parts = None, [], [], 1
        for batch in batches:
            raw, off = string_buffers(batch.column(5))
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True))
            found: tuple[list, ...] = ([], [], [], [])

            def put(*values, found=found):
                for column, v in zip(found, values, strict=True):
                    column.append(v)

            for (comp, no, of, row, own), s in zip(keys, shingle_sets(raw, off, words, hasher), strict=True):
                if (comp, no) != tile:
                    for r, x in zip(rows, link_groups(sets, percent), strict=True):
                        put(r, rows[x], parts, None)
                    tile, rows, sets, parts = (comp, no), [], [], of
                rows.append(row), sets.append(s)
                if of > 1 and own:
                    put(row, None, of, s.view(np.int64))
            yield out(*found)
        g = link_groups(sets, percent)
        yield out(rows, [rows[x] for x in g], [parts] * len(rows), [None] * len(rows))

    return run


def _verify_sets(percent: int):
    """Rows (comp, tile, row, shingles) sorted by tile -> each set's edge to the first of its component within the tile."""

    def out(rows, sets):
        g = link_groups(sets, percent)
        return pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array([rows[x] for x in g], pa.int64())], ["a", "b"])

    def run(batches):
        tile, rows, sets = None, [], []
        for batch in batches:
            for k, (comp, no, row) in enumerate(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)):
                if (comp, no) != tile:
                    yield out(rows, sets)
                    tile, rows, sets = (comp, no), [], []
                rows.append(row)
                sets.append(np.asarray(batch.column(3)[k].values))
        yield out(rows, sets)

    return run


def _blocks(rows, shingles, most_rows: int, most_shingles: int):
    """How many blocks hold that many rows and shingles; 1 at least."""
    return F.greatest(F.ceil(rows / most_rows), F.ceil(shingles / most_shingles), F.lit(1)).cast("long")


def hubs(members: DataFrame) -> DataFrame:
    """(comp, hub): of ``members`` (comp, row, bands) the one that has most of its component's commonest hash of each band."""
    each = members.select("comp", "row", F.posexplode("bands").alias("band", "h"))
    votes = each.groupBy("comp", "band", "h").agg(F.count("*").alias("n"))
    modes = votes.groupBy("comp", "band").agg(F.max_by("h", F.struct("n", "h")).alias("h"))
    # other keys than the aggregate's give this side an exchange of its own: a large component can be split
    modes = modes.select(F.bitwise_not("comp").alias("c"), F.bitwise_not("h").alias("m"))
    have = each.join(modes, (F.bitwise_not("comp") == F.col("c")) & (F.bitwise_not("h") == F.col("m")))
    return have.groupBy("comp", "row").agg(F.count("*").alias("n")).groupBy("comp").agg(F.max_by("row", F.struct("n", "row")).alias("hub"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80,
    bands: int = 48, rows: int = 5, small_bucket: int = 8, part_rows: int = 64, part_shingles: int = 250_000,
    block_rows: int = 512, block_shingles: int = 500_000, max_map_bits: int = 1 << 28,
) -> DataFrame:
    """One row per document: __id, __xx, n_shingles, component_id, kept.

    A document's set holds its distinct shingles of ``words`` words (A-Z
    lower-cased, split at ASCII white space).  Null and empty texts have empty
    sets and no links.  component_id is the smallest id reached over links,
    kept tells whether that is the row's own id; repeated rows of one id are
    kept together, rows whose component has no id but null are kept.
    ``percent`` is the similarity in hundredths.  A part of a component has about
    ``part_rows`` members or ``part_shingles`` shingles, a block of what the parts leave
    apart ``block_rows`` or ``block_shingles``, and the map that texts pass before they
    are shuffled ``max_map_bits`` at most; none of them changes the result.  Malformed bytes
    belong to words like any others.
    """
    spark = docs.sparkSession
    path = shared_dir(spark)
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("__id"), F.col(f"`{text_col}`").alias("__text"), F.xxhash64(F.col(f"`{text_col}`")).alias("__xx"))
    sig = src.select("__id", "__text", "__xx", F.monotonically_increasing_id().alias("__row")).mapInArrow(
        _signature_udf(words, bands, rows), "__id long, __xx long, __row long, n long, key binary, sketch array<long>, bands array<long>")
    sig = written(sig, f"{path}/signatures")

    same = sig.where("n > 0").groupBy("key").agg(F.min_by(F.struct("__row", "__id", "__xx", "n", "sketch", "bands"), "__row").alias("r"), F.count("*").alias("copies"))
    reps = written(same.select("key", "copies", "r.*"), f"{path}/representatives")

    buckets = reps.select("__row", "bands").mapInArrow(_stars_before_shuffle(small_bucket), "bucket long, member long, pivot long, star boolean")
    met = buckets.repartition("bucket").sortWithinPartitions("bucket", "member")
    pairs = met.mapInArrow(_pairs_of_buckets(small_bucket), "a long, b long, star boolean")
    pairs = pairs.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("star").alias("star"))

    sketches = reps.select("__row", "n", "sketch")
    one, two = (sketches.select(F.col("__row").alias(f"r{i}"), F.col("n").alias(f"n{i}"), F.col("sketch").alias(f"s{i}")) for i in (1, 2))
    odd = F.aggregate(F.zip_with("s1", "s2", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    far = F.lit(100) * F.least("n1", "n2") < F.lit(percent) * F.greatest("n1", "n2")
    near = pairs.join(one, F.col("a") == F.col("r1")).join(two, F.col("b") == F.col("r2")).where(F.col("star") | (~far & (odd <= most_odd_bits(percent / 100, bands * rows))))
    loose = connected_components(near.select("a", "b"), path)

    member = loose.select(F.col("node").alias("m_row"), F.col("root").alias("comp"))
    member = written(member.unionByName(loose.select(F.col("root").alias("m_row"), F.col("root").alias("comp")).distinct()), f"{path}/members")
    info = member.join(reps.select("__row", "__id", "__xx", "n"), F.col("m_row") == F.col("__row"))
    parts = _blocks(F.count("*"), F.sum("n"), part_rows, part_shingles)
    some = F.array(*(F.min_by("__row", F.xxhash64("__row", F.lit(k))) for k in range(PIVOTS - 1)))
    # other keys than the aggregate's give each side an exchange of its own: a large component can be split
    own = F.bitwise_not("comp")
    dealt = info.groupBy("comp").agg(parts.alias("parts"), some.alias("some")).withColumn("c", own).drop("comp")
    info = written(info.join(dealt, own == F.col("c")).select("__row", "__id", "__xx", "n", "comp", "parts", "some"), f"{path}/parts")
    large = info.where("parts > 1").select("comp", F.col("__row").alias("row")).join(reps.select(F.col("__row").alias("k_row"), "bands"), F.col("row") == F.col("k_row"))
    hub = written(hubs(large).select(own.alias("c"), "hub"), f"{path}/hubs")
    info = info.join(hub, own == F.col("c"), "left").withColumn("pivot", F.array_contains("some", F.col("__row")) | F.col("__row").eqNullSafe(F.col("hub"))).drop("c", "hub", "some")
    info = written(info, f"{path}/pivots")
    own_part = F.pmod(F.xxhash64("__row"), F.col("parts"))
    dealt = info.withColumn("tiles", F.when(F.col("pivot"), F.expr("sequence(0L, parts - 1)")).otherwise(F.array(own_part)))
    # a map of bounded size passes over most texts that are no members'; what it lets through is joined exactly
    bits = bits_for(info.count(), 16, max_map_bits)
    known = spark.sparkContext.broadcast(bitmap(info.select("__xx"), places, bits))
    text = src.select(F.col("__id").alias("t_id"), F.col("__xx").alias("t_xx"), "__text").mapInArrow(_known_udf(known, bits), "t_id long, t_xx long, __text string")
    # members grow with the documents and are not to be broadcast
    texts = dealt.hint("merge").join(text, F.col("__id").eqNullSafe(F.col("t_id")) & (F.col("__xx") == F.col("t_xx")))
    tiles = texts.select("comp", F.explode("tiles").alias("tile"), "parts", "__row", own_part.alias("own_part"), "__text")
    tiles = tiles.select("comp", "tile", "parts", "__row", (F.col("tile") == F.col("own_part")).alias("mine"), "__text")
    tiles = tiles.repartition("comp", "tile").sortWithinPartitions("comp", "tile", "__row")
    found = written(tiles.mapInArrow(_verify(words, percent), _LINKS), f"{path}/links")
    links = found.where("a <> b").select("a", "b", "parts")
    split = connected_components(links.where("parts > 1").select("a", "b"), path)

    label = info.where("parts > 1").join(split, F.col("__row") == F.col("node"), "left").withColumn("label", F.coalesce("root", "__row"))
    label = written(label.select("__row", "__id", "__xx", "n", "comp", "parts", "label"), f"{path}/labels")
    sizes = label.groupBy("comp", "label").agg(F.count("*").alias("size")).groupBy("comp")
    sizes = sizes.agg(F.max_by("label", F.struct("size", "label")).alias("largest"), F.count("*").alias("groups")).where("groups > 1").withColumn("c", own).drop("comp")
    apart = label.join(sizes, own == F.col("c")).withColumn("rest", F.col("label") != F.col("largest"))
    apart = written(apart.select("__row", "n", "comp", "rest"), f"{path}/apart")
    if not apart.isEmpty():
        rest, most = F.col("rest"), ~F.col("rest")
        nr, nl = (_blocks(F.count_if(x), F.sum(F.when(x, F.col("n")).otherwise(0)), block_rows, block_shingles) for x in (rest, most))
        blocks = apart.groupBy("comp").agg(nr.alias("nr"), nl.alias("nl")).withColumn("c", own).drop("comp")
        apart = apart.join(blocks, own == F.col("c")).withColumn("blk", F.pmod(F.xxhash64("__row"), F.when(rest, F.col("nr")).otherwise(F.col("nl"))))
        # tile (i, j): block i of the rest with block j of the rest, or with block j - nr of the largest group
        with_rest = "transform(sequence(0L, nr - 1), o -> least(blk, o) * (nr + nl) + greatest(blk, o))"
        with_most = "transform(sequence(0L, nl - 1), j -> blk * (nr + nl) + nr + j)"
        most_in = "transform(sequence(0L, nr - 1), i -> i * (nr + nl) + nr + blk)"
        # repeated rows of one id and text were read more than once
        sets = found.where("b is null").select(F.col("a").alias("s_row"), "shingles").dropDuplicates(["s_row"])
        sets = apart.hint("merge").join(sets, F.col("__row") == F.col("s_row"))
        tiles = sets.select("comp", F.explode(F.expr(f"if(rest, concat({with_rest}, {with_most}), {most_in})")).alias("tile"), "__row", "shingles")
        tiles = tiles.repartition("comp", "tile").sortWithinPartitions("comp", "tile", "__row")
        more = written(tiles.mapInArrow(_verify_sets(percent), "a long, b long").where("a <> b"), f"{path}/more_links")
        split = connected_components(more.unionByName(split.select(F.col("node").alias("a"), F.col("root").alias("b"))), path)
    root = links.where("parts = 1").select(F.col("a").alias("node"), F.col("b").alias("root")).distinct().unionByName(split)

    copies = reps.where("copies > 1").select(F.col("key").alias("k"), F.col("__row").alias("rep"))
    all_ = sig.select("__id", "__xx", "__row", "n", "key").join(copies, F.col("key") == F.col("k"), "left").withColumn("rep", F.coalesce("rep", "__row"))
    all_ = all_.join(root, F.col("rep") == F.col("node"), "left").withColumn("group", F.coalesce("root", "rep"))
    all_ = written(all_.select("__id", "__xx", "n", "group"), f"{path}/groups")
    ids = all_.groupBy("group").agg(F.min("__id").alias("component_id"), F.count("*").alias("c")).where("c > 1").select(F.bitwise_not("group").alias("g"), "component_id")
    out = all_.join(ids, F.bitwise_not("group") == F.col("g"), "left")
    out = out.withColumn("component_id", F.when(F.col("g").isNull(), F.col("__id")).otherwise(F.col("component_id")))
    return out.select("__id", "__xx", F.col("n").alias("n_shingles"), "component_id", F.col("__id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with one document of each group: the one with the smallest id; all columns stay as they were."""
    gone = near_duplicates(docs, id_col, text_col, **how).where("not kept").select("__id", "__xx").distinct()
    return without_rows(docs, written(gone, f"{shared_dir(docs.sparkSession)}/gone"), id_col, text_col)
