"""Links between documents whose sets of word n-grams overlap by 90 %, and their groups.

1. A document's set: hashes of its distinct n-grams.  Documents with equal sets are one
   class, represented by the smallest doc_id; only representatives are compared.
2. Candidates.  Sets of similar size share a band of sizes, and a band deals hashes into a
   fixed number of cells.  Two linked sets differ in at most d = n/9 n-grams, so of any d + 1
   cells of one at least one has the same n-grams in the other.  Each set names its cells by
   number and content, and asks by the d + 1 fullest.  Sets with a common name by which one of
   them asks are candidates; chains of candidates form clusters.
3. Tiles.  Each cluster is cut by bands of sizes into blocks, and compatible blocks are
   paired into tiles.  In a tile hashed bitmap signatures bound the overlap from above.  Tiles
   of bitmaps alone go first: sets that may link by that bound form smaller clusters.  Their
   tiles hold the sets themselves, and pairs that may link are intersected exactly as sorted
   arrays.  Pairs that are already connected within a tile are not compared again.
4. Connected components of the links.

No candidate is dropped: cells give all of them, and large clusters only become more tiles.
Defined cases: NULL text and texts without words have the empty set, link with nothing and
are their own component; texts with fewer words than n have one n-gram of all their words.
Rows with NULL doc_id are returned with NULL component_id and link with nothing.  Repeated
rows are returned as often as they occur.  Other columns are not read.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from liftengine.llm.components import components
from liftengine.llm.tokens import slices
from liftengine.sources.scratch import write_scratch

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Sizes of a band differ by at most this factor; cells of a band as a multiple of d + 1.
BAND, CELLS = 1.5, 1.3
#: Up to this size the d + 1 smallest n-grams stand for cells.
SMALL = 64
#: A block has about a twelfth of its band, but no fewer documents and no more n-grams.
BLOCKS, BLOCK_DOCS, BLOCK_GRAMS = 12, 128, 1_000_000
_ASKS = np.uint64(1)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def gram_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text."""
    import xxhash

    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    first = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    coded = pc.dictionary_encode(pc.list_flatten(lists))
    found = coded.dictionary.to_pylist()
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in found), np.uint64, len(found))
    empty = np.array([w == "" for w in found], bool)
    code = coded.indices.to_numpy()
    hashed = hashes[code]
    blank = empty[code]
    out = []
    for a, b in zip(first[:-1], first[1:]):
        # white space at either end of a text leaves an empty piece there
        while a < b and blank[a]:
            a += 1
        while a < b and blank[b - 1]:
            b -= 1
        w = hashed[a:b]
        width = min(n, len(w))
        if not width:
            out.append(np.empty(0, np.uint64))
            continue
        grams = np.full(len(w) - width + 1, width, np.uint64)
        for i in range(width):
            grams = _mixed(grams * np.uint64(0x9E3779B97F4A7C15) + w[i:len(w) - width + 1 + i])
        out.append(np.unique(grams))
    return out


def _allowed(size: int, percent: int) -> int:
    """In how many n-grams a set of this size can differ from one it links with."""
    return size * (100 - percent) // percent


def _band_of(size: float) -> int:
    return int(np.floor(np.log(size) / np.log(BAND)))


def _cells(grams: np.ndarray, band: int, need: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The band's cells that are not empty, each as a hash of band, cell and content, and a flag.

    The flag marks the ``need`` fullest cells.  Of two linked sets at most need - 1 cells differ,
    so one of any ``need`` cells of the smaller set is a cell of the larger too.  Cells with several
    n-grams are rarely alike by a phrase that both texts happen to have.  A set has many more
    n-grams than cells; that ``need`` are not empty fails with a chance like that of equal hashes.
    """
    top = int(BAND ** (band + 1)) + 1
    salt = np.uint64((band + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    if top <= SMALL:
        return _mixed(grams[:need] ^ salt), np.ones(min(need, len(grams)), bool)
    count = np.uint64(int(CELLS * (_allowed(top, percent) + 1)))
    cell = _mixed(grams ^ salt) % count
    order = np.argsort(cell, kind="stable")
    at = np.flatnonzero(np.diff(cell[order].astype(np.int64), prepend=-1))
    content = np.add.reduceat(_mixed(grams[order]), at)
    asked = np.zeros(len(at), bool)
    asked[np.argsort(-np.diff(at, append=len(grams)), kind="stable")[:need]] = True
    return _mixed(content ^ _mixed(cell[order][at] + salt)), asked


def names(grams: np.ndarray, percent: int) -> np.ndarray:
    """What the candidates of a set are found by; the lowest bit says that the set asks by it.

    Of two linked sets the larger answers to all its cells in its own band, and the smaller asks
    by some of its cells there, which is its own band or that of larger partners.
    """
    size = len(grams)
    need = _allowed(size, percent) + 1
    if need == 1:
        return np.empty(0, np.uint64)  # links with equal sets only, and those are one class
    own, above = _band_of(size), _band_of(size * 100 / percent)
    found, asked = _cells(grams, own, need, percent)
    found = found & ~_ASKS | asked
    if above != own:
        more, asked = _cells(grams, above, need, percent)
        found = np.concatenate([found, more[asked] | _ASKS])
    return np.unique(found)


def signature(grams: np.ndarray) -> np.ndarray:
    """A bitmap of hashed n-grams, with two to four bits per n-gram and 256 at least."""
    bits = 1 << max(8, (4 * len(grams)).bit_length() - 1)
    out = np.zeros(bits // 64, np.uint64)
    bit = _mixed(grams) & np.uint64(bits - 1)
    np.bitwise_or.at(out, (bit >> np.uint64(6)).astype(np.int64),
                     np.uint64(1) << (bit & np.uint64(63)))
    return out


def _folded(bitmaps: list[np.ndarray]) -> np.ndarray:
    """Bitmaps brought to the shortest length: a hash's lower bits name its place there."""
    words = min(map(len, bitmaps))
    return np.stack([np.bitwise_or.reduce(b.reshape(-1, words), axis=0) for b in bitmaps])


def tile_links(ids, sides, sizes, bitmaps: list[np.ndarray], percent: int,
               sets: list[np.ndarray] | None = None) -> list[tuple[int, int]]:
    """Links that connect what is linked in a tile; rows of one side only meet in tile 0 x 0.

    Without ``sets``, pairs count as linked that may link as far as their bitmaps tell.
    """
    n = len(bitmaps)
    order = np.argsort(sizes, kind="stable")
    ids, sides, size = (np.asarray(x)[order] for x in (ids, sides, sizes))
    bits = _folded([bitmaps[i] for i in order])
    cross = bool((sides == 1).any())
    group = np.arange(n)
    found = []
    for i in range(n - 1):
        # partners are larger, up to the size that the threshold allows
        last = np.searchsorted(size, size[i] * 100 // percent, side="right")
        near = np.arange(i + 1, last)
        near = near[group[near] != group[i]]
        if cross:
            near = near[sides[near] != sides[i]]
        if not len(near):
            continue
        missing = np.bitwise_count(bits[i] & ~bits[near]).sum(1, dtype=np.int64)
        added = np.bitwise_count(bits[near] & ~bits[i]).sum(1, dtype=np.int64)
        most = np.minimum(size[i] - missing, size[near] - added)
        near = near[100 * most >= percent * (size[i] + size[near] - most)]
        for j in near:
            if group[j] == group[i]:
                continue
            if sets is not None:
                common = len(np.intersect1d(
                    sets[order[i]], sets[order[j]], assume_unique=True))
                if 100 * common < percent * (size[i] + size[j] - common):
                    continue
            found.append((int(ids[i]), int(ids[j])))
            group[group == group[j]] = group[i]
    return found


def _summary(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, two digests of the set, its names and its bitmap."""
    fields = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("d1", pa.int64()),
                        ("d2", pa.int64()), ("names", pa.binary()), ("bitmap", pa.binary())])

    def summed(batches):
        for batch in batches:
            for part in slices(batch):
                sets = gram_sets(part.column("text"), n)
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(np.array([_mixed(s).sum(dtype=np.uint64) for s in sets],
                                      np.uint64).view(np.int64)),
                    pa.array(np.array([np.bitwise_xor.reduce(_mixed(~s)) for s in sets],
                                      np.uint64).view(np.int64)),
                    pa.array([names(s, percent).tobytes() for s in sets], pa.binary()),
                    pa.array([signature(s).tobytes() for s in sets], pa.binary())],
                    schema=fields)

    return docs.select("doc_id", "text").mapInArrow(
        summed, "doc_id bigint, n_shingles bigint, d1 bigint, d2 bigint, names binary, "
        "bitmap binary")


def _candidates(named: DataFrame) -> DataFrame:
    """Pairs (u, v) that connect all sets with a common name by which one of them asks.

    Each batch sends a name once, with the first of its sets.  If one of them asks, they are
    joined to the first there and then; else the others go along, for a set elsewhere may ask.
    """
    out = pa.schema([("name", pa.int64()), ("doc", pa.int64()), ("asked", pa.bool_()),
                     ("more", pa.list_(pa.int64()))])

    def combined(batches):
        for batch in batches:
            raw = batch.column("names")
            counts = pc.binary_length(raw).to_numpy() // 8
            if not counts.sum():
                continue
            name = np.frombuffer(b"".join(raw.to_pylist()), np.uint64)
            doc = np.repeat(batch.column("doc_id").to_numpy(), counts)
            asks = (name & _ASKS) == _ASKS
            name = name >> _ASKS
            order = np.lexsort((doc, name))
            name, doc, asks = name[order], doc[order], asks[order]
            first = np.concatenate([[True], name[1:] != name[:-1]])
            group, at = np.cumsum(first) - 1, np.flatnonzero(first)
            asked = np.logical_or.reduceat(asks, at)
            other = ~first & (doc != doc[at][group])
            joint = other & asked[group]
            joints = np.unique(np.stack([doc[at][group[joint]], doc[joint]]), axis=1)
            key = _mixed(joints[0].view(np.uint64) ^ _M2) ^ _mixed(joints[1].view(np.uint64))
            waiting = other & ~joint
            more = np.bincount(group[waiting], minlength=len(at))
            lists = np.concatenate([more, np.ones(len(key), np.int64)])
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([name[at], key]).view(np.int64)),
                pa.array(np.concatenate([doc[at], joints[0]])),
                pa.array(np.concatenate([asked, np.ones(len(key), bool)])),
                pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(lists)]), pa.int32()),
                    pa.array(np.concatenate([doc[waiting], joints[1]])),
                    mask=pa.array(lists == 0))], schema=out)

    sent = named.select("doc_id", "names").mapInArrow(
        combined, "name bigint, doc bigint, asked boolean, more array<bigint>")
    name = Window.partitionBy("name")
    met = sent.select("doc", "more", F.min("doc").over(name).alias("least"),
                      F.max("asked").over(name).alias("asked")).where(
        F.col("asked") & ((F.col("doc") != F.col("least")) | F.col("more").isNotNull()))
    docs = F.concat(F.array("doc"), F.coalesce("more", F.array().cast("array<bigint>")))
    return met.select(F.explode(docs).alias("u"), F.col("least").alias("v")).where(
        F.col("u") != F.col("v")).distinct()


def _tiles(members: DataFrame, percent: int) -> DataFrame:
    """rep with the tiles it takes part in, each with a side; members are (rep, n, d1, d2, cluster)."""
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent))).cast("int")
    banded = members.withColumn("band", band)
    counts = write_scratch(banded.groupBy("cluster", "band").agg(
        F.count("*").alias("docs"), F.sum("n").alias("grams")), "bands")
    whole = counts.groupBy("cluster").agg(F.sum("docs").alias("all_docs"),
                                          F.sum("grams").alias("all_grams"))
    blocks = F.ceil(F.greatest(
        F.col("docs") / F.greatest(F.lit(BLOCK_DOCS), F.col("docs") / BLOCKS),
        F.col("grams") / F.lit(BLOCK_GRAMS))).cast("int")
    one = (F.col("all_docs") <= BLOCK_DOCS) & (F.col("all_grams") <= BLOCK_GRAMS)
    shape = counts.join(whole, "cluster").select(
        "cluster", "band", F.when(one, F.lit(0)).otherwise(blocks).alias("blocks"))

    def beside(step: int, name: str) -> DataFrame:
        return shape.select("cluster", (F.col("band") - step).alias("band"),
                            F.col("blocks").alias(name))

    shaped = write_scratch(shape.join(beside(1, "up"), ["cluster", "band"], "left").join(
        beside(-1, "down"), ["cluster", "band"], "left"), "shape")
    own = F.pmod(F.xxhash64("rep"), F.greatest("blocks", F.lit(1))).cast("int")

    def tile(low, a, high, b, side):
        return F.struct(F.xxhash64("cluster", low, a, high, b).alias("tile"), side.alias("side"))

    def blocks_of(count):
        return F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(
            F.array().cast("array<int>"))

    here, over, under = F.col("band"), F.col("band") + 1, F.col("band") - 1
    tiles = F.when(F.col("blocks") == 0, F.array(tile(
        F.lit(-1), F.lit(0), F.lit(-1), F.lit(0), F.lit(0)))).otherwise(F.concat(
            F.transform(blocks_of(F.col("blocks")), lambda k: tile(
                here, F.least(F.col("own"), k), here, F.greatest(F.col("own"), k),
                (k < F.col("own")).cast("int"))),
            F.transform(blocks_of(F.coalesce("up", F.lit(0))), lambda k: tile(
                here, F.col("own"), over, k, F.lit(0))),
            F.transform(blocks_of(F.coalesce("down", F.lit(0))), lambda k: tile(
                under, k, here, F.col("own"), F.lit(1)))))
    return banded.join(shaped, ["cluster", "band"]).withColumn("own", own).select(
        "rep", "d1", "d2", tiles.alias("tiles"))


def _dealt(rows: DataFrame, *columns: str) -> DataFrame:
    """A row per tile that a set takes part in."""
    return rows.select("rep", *columns, F.explode("tiles").alias("t")).select(
        "rep", *columns, "t.tile", "t.side")


def _maybe(known: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Pairs that connect, within tiles, all sets that may link as far as bitmaps tell."""

    def compared(found: pd.DataFrame) -> pd.DataFrame:
        found = found.drop_duplicates(["rep", "bitmap"])
        links = tile_links(found["rep"], found["side"], found["n"],
                           [np.frombuffer(b, np.uint64) for b in found["bitmap"]], percent)
        return pd.DataFrame(links, columns=["u", "v"], dtype=np.int64)

    rows = known.select(F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"), "d1", "d2",
                        "bitmap").join(_tiles(members, percent), ["rep", "d1", "d2"])
    return _dealt(rows, "n", "bitmap").groupBy("tile").applyInPandas(compared, "u bigint, v bigint")


def _links(docs: DataFrame, members: DataFrame, n: int, percent: int) -> DataFrame:
    """Exact links within tiles."""
    out = pa.schema([("rep", pa.int64()), ("grams", pa.binary())])

    def grams(batches):
        for batch in batches:
            for part in slices(batch):
                sets = gram_sets(part.column("text"), n)
                made = pa.RecordBatch.from_arrays([
                    part.column("rep"), pa.array([s.tobytes() for s in sets], pa.binary())],
                    schema=out)
                yield made.append_column("tiles", part.column("tiles"))

    def compared(found: pd.DataFrame) -> pd.DataFrame:
        found = found.drop_duplicates(["rep", "grams"])
        sets = [np.frombuffer(g, np.uint64) for g in found["grams"]]
        links = tile_links(found["rep"], found["side"], [len(s) for s in sets],
                           [signature(s) for s in sets], percent, sets)
        return pd.DataFrame(links, columns=["u", "v"], dtype=np.int64)

    tiles = _tiles(members, percent).select("rep", "tiles")
    texts = docs.select(F.col("doc_id").alias("rep"), "text").join(tiles, "rep")
    sets = texts.mapInArrow(
        grams, "rep bigint, grams binary, tiles array<struct<tile:bigint,side:int>>")
    return _dealt(sets, "grams").groupBy("tile").applyInPandas(compared, "u bigint, v bigint")


def _clustered(classes: DataFrame, links: DataFrame) -> DataFrame:
    """The representatives in the components of the links: rep, n, d1, d2, cluster."""
    found = components(links)
    inside = found.select(F.col("u").alias("rep"), F.col("v").alias("cluster")).unionByName(
        found.select(F.col("v").alias("rep"), F.col("v").alias("cluster")).distinct())
    return classes.join(inside, "rep")


def groups(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    held = write_scratch(_summary(docs, n, percent), "sets")
    known = held.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes = write_scratch(known.groupBy("d1", "d2").agg(
        F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n")), "classes")
    named = known.where(F.length("names") > 0)
    near = _clustered(classes, write_scratch(_candidates(named), "candidates"))
    maybe = _clustered(classes, write_scratch(_maybe(named, near, percent), "maybe"))
    joined = components(write_scratch(_links(docs, maybe, n, percent), "links"))
    found = classes.join(joined.select(F.col("u").alias("rep"), F.col("v").alias("to")), "rep",
                         "left").select("d1", "d2", F.coalesce("to", "rep").alias("component_id"))
    return held.select("doc_id", "n_shingles", "d1", "d2").join(
        found, ["d1", "d2"], "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce(
            F.when(F.col("n_shingles") > 0, F.col("component_id")), F.col("doc_id")))
        .alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group: that with the smallest doc_id.

    Rows with NULL doc_id belong to no group and stay.
    """
    first = groups(docs, n, percent).where(F.col("doc_id") == F.col("component_id")).select(
        F.col("doc_id").alias("first_id")).distinct()
    packed = docs.select("doc_id", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("held"))
    kept = packed.where(F.col("doc_id").isNotNull()).join(
        first, F.col("doc_id") == F.col("first_id"), "left_semi").groupBy("doc_id").agg(
        F.first("held").alias("held"))
    return kept.select("held.*").unionByName(
        packed.where(F.col("doc_id").isNull()).select("held.*"))
