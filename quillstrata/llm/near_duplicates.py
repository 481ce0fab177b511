"""MinHash near-duplicate detection with b-bit signatures.

Plan
1. One pass over the texts makes each document's set of word shingles, a 128-bit
   fingerprint of that set, ``BANDS`` band keys of ``ROWS`` minima each, and the
   low 4 bits of 128 minima packed in bit planes.
2. Equal fingerprints collapse to one representative, so any number of exact
   copies costs one combining aggregate.
3. Representatives that share a band key meet. Within a band bucket every member
   is held against one hub (the member with most company), so a bucket of n members
   gives n - 1 pairs, of which the collision-corrected similarity of the packed bits
   drops those that are many standard errors below the threshold. Of what is left the
   most similar hub of each member is confirmed on full shingle sets: one confirmation
   a document, however large its family.
4. Buckets that still hold several components are compared whole, by packed bits,
   in blocks; members of the bucket's largest component are not held against each other.
   The result is not pairs but the documents that have a possible link outside their
   component.
5. Sets of these documents are sent once to their family (what buckets connect), or to
   its blocks. Sizes of all intersections of a block are one matrix product over the
   shingles that occur twice in it; exact links leave the task as a forest.

At the least linked similarity of 0.8 a pair shares no band with probability
(1 - 0.8 ** 4) ** 32 = 5e-8, and a packed signature lies five standard errors low
with probability below 1e-7.

Defined results: null and blank texts have empty sets and link with nothing; a
null id is returned with its set size, a null component and kept = true; rows that
share an id are one document: they have one component, and all are kept or none;
ids of a type other than integers raise ``TypeError``; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstrata.llm.arrowtext import SLICE, constants, doc_blocks, integer_id, map_batches, mix, shingle_sets, utf8, words
from quillstrata.llm.graph import components
from quillstrata.sources import Scratch

ROWS, BANDS = 4, 32
HASHES = ROWS * BANDS
BITS = 4
PLANES = BITS * HASHES // 64
#: Shingles whose minima are taken at once; they stay in a core's cache.
CACHE = 1 << 15
#: Estimated similarity may be this far below the threshold (over five standard errors).
MARGIN = 0.2
#: Ids that may be sent to every executor, 32 MB of longs.
BROADCAST_IDS = 4_000_000
#: Shingles of a block (a document counts for ``LEAST`` at least).
BLOCK, LEAST = 1 << 20, 256
#: Documents and shingles of one matrix product.
CHUNK, COLUMNS = 256, 1024
#: Shingles looked up at once.
PART = 1 << 18


def minima(values: np.ndarray, offsets: np.ndarray, hashes: int = HASHES) -> np.ndarray:
    """Return the minima of each non-empty set, one row a set."""
    factors, masks = constants(hashes, 0x4D), constants(hashes, 0x4E)
    out = np.empty((len(offsets) - 1, hashes), np.uint64)
    scratch = np.empty(CACHE, np.uint64)
    for i, j in doc_blocks(offsets, CACHE):
        part = values[offsets[i] : offsets[j]]
        starts = offsets[i:j] - offsets[i]
        work = scratch[: len(part)] if len(part) <= CACHE else np.empty(len(part), np.uint64)
        for h in range(hashes):
            np.bitwise_xor(part, masks[h], out=work)
            np.multiply(work, factors[h], out=work)
            out[i:j, h] = np.minimum.reduceat(work, starts)
    return out


def band_keys(low: np.ndarray) -> np.ndarray:
    """Return one 64-bit key a band; keys of different bands differ."""
    factors = constants(ROWS, 0xBA)
    rows = low.reshape(len(low), BANDS, ROWS)
    keys = np.zeros((len(low), BANDS), np.uint64)
    for r in range(ROWS):
        keys += mix(rows[:, :, r].ravel()).reshape(keys.shape) * factors[r]
    return mix((keys + constants(BANDS, 0xB5)).ravel()).reshape(keys.shape)


def bit_planes(low: np.ndarray) -> np.ndarray:
    """Pack the low bits of each minimum: plane p holds bit p of every hash."""
    finished = mix(low.ravel()).reshape(low.shape)
    planes = [np.packbits(((finished >> np.uint64(p)) & np.uint64(1)).astype(bool), axis=1).view(np.uint64) for p in range(BITS)]
    return np.concatenate(planes, axis=1)


def _signatures(shingle: int):
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("bands", pa.list_(pa.int64())), ("planes", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for i, j in doc_blocks(offsets, 4 * SLICE):
                part = data[offsets[i] : offsets[j]]
                values, at = shingle_sets(*words(part, offsets[i : j + 1] - offsets[i]), j - i, shingle)
                n = np.diff(at)
                full = n > 0
                sums = np.zeros((2, j - i), np.uint64)
                lists = np.zeros((j - i, BANDS), np.uint64), np.zeros((j - i, PLANES), np.uint64)
                if full.any():
                    begin = at[:-1][full]
                    for row, salt in enumerate((0x11, 0x22)):
                        sums[row, full] = np.add.reduceat(mix(values + np.uint64(salt)), begin)
                    low = minima(values, np.append(begin, at[-1]))
                    lists[0][full], lists[1][full] = band_keys(low), bit_planes(low)
                rows = [pa.array(n.astype(np.int64)), *(pa.array(x.view(np.int64)) for x in sums)]
                for x in lists:
                    at_list = np.arange(j - i + 1, dtype=np.int32) * x.shape[1]
                    rows.append(pa.ListArray.from_arrays(pa.array(at_list), pa.array(x.ravel().view(np.int64))))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *rows], schema=schema)

    return run


def _sets(shingle: int):
    schema = pa.schema([("id", pa.int64()), ("members", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for i, j in doc_blocks(offsets, 4 * SLICE):
                part = data[offsets[i] : offsets[j]]
                values, at = shingle_sets(*words(part, offsets[i : j + 1] - offsets[i]), j - i, shingle)
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), lists], schema=schema)

    return run


def _estimate(left: list[Column], right: list[Column]) -> Column:
    """Collision-corrected similarity: equal bits of chance are taken out."""
    per = HASHES // 64
    differing = []
    for word in range(per):
        planes = [left[p * per + word].bitwiseXOR(right[p * per + word]) for p in range(BITS)]
        joined = planes[0]
        for plane in planes[1:]:
            joined = joined.bitwiseOR(plane)
        differing.append(F.bit_count(joined))
    equal = F.lit(1.0) - sum(differing[1:], differing[0]) / F.lit(float(HASHES))
    chance = 2.0**-BITS
    return (equal - F.lit(chance)) / F.lit(1 - chance)


def _candidates(pairs: DataFrame, signatures: DataFrame, least: float) -> DataFrame:
    """Keep the pairs (id, hub) whose packed signatures allow the threshold, with the estimate."""
    names = [f"s{p}" for p in range(PLANES)]
    for side in ("id", "hub"):
        pairs = pairs.join(signatures.select(F.col("id").alias(side), *(F.col(x).alias(f"{side}{x}") for x in names)), side)
    estimate = _estimate([F.col(f"id{x}") for x in names], [F.col(f"hub{x}") for x in names])
    return pairs.select("id", "hub", estimate.alias("estimate")).where(F.col("estimate") >= F.lit(least - MARGIN))


def _confirm(pairs: DataFrame, texts: DataFrame, shingle: int, num: int, den: int) -> DataFrame:
    """Keep the pairs (id, hub) whose full sets have den * intersection >= num * union, as (a, b)."""
    wanted = pairs.select("id").union(pairs.select("hub")).distinct()
    sets = map_batches(_chosen(texts, wanted), _sets(shingle), "id long, members array<long>")
    both = pairs.join(sets.withColumnRenamed("members", "x"), "id").join(sets.withColumnsRenamed({"id": "hub", "members": "y"}), "hub")
    common = F.size(F.array_intersect("x", "y"))
    return both.where(F.lit(den) * common >= F.lit(num) * (F.size("x") + F.size("y") - common)).select(F.col("id").alias("a"), F.col("hub").alias("b"))


def _chosen(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """Return (id, text) of the ids, sent to the texts if there are few enough."""
    few = ids.count() <= BROADCAST_IDS
    return texts.join(F.broadcast(ids) if few else ids, "id", "left_semi").select("id", "text")


def _faces(rows: DataFrame, block: int) -> DataFrame:
    """Deal the rows (unit, id, component, weight) of each unit to pairs of blocks (lo, hi).

    A unit beyond one block keeps its heaviest component apart: its blocks meet those of
    the other components, not each other.
    """
    sizes = rows.groupBy("unit", "component").agg(F.sum("weight").alias("weight"))
    total = sizes.groupBy("unit").agg(F.sum("weight").alias("total"), F.max(F.struct("weight", (-F.col("component")).alias("negative"))).alias("top"))
    parts = lambda weight: F.ceil(weight / F.lit(float(block))).cast("int")
    small = F.col("total") <= F.lit(block)
    units = total.select(
        "unit",
        F.when(~small, -F.col("top.negative")).alias("main"),
        F.when(small, 1).otherwise(F.greatest(F.lit(1), parts(F.col("total") - F.col("top.weight")))).alias("others"),
        F.when(small, 0).otherwise(parts(F.col("top.weight"))).alias("mains"),
    )
    dealt = rows.join(units, "unit").withColumn("inner", F.coalesce(F.col("component") == F.col("main"), F.lit(False)))
    draw = F.xxhash64("id", F.lit(0xB10C))
    dealt = dealt.withColumn("block", F.when(F.col("inner"), F.col("others") + F.pmod(draw, F.greatest("mains", F.lit(1)))).otherwise(F.pmod(draw, F.col("others"))).cast("int"))
    last = F.when(F.col("inner"), F.col("others")).otherwise(F.col("others") + F.col("mains")) - 1
    faced = dealt.select("unit", "id", "component", "block", F.explode(F.sequence(F.lit(0), last.cast("int"))).alias("other"))
    return faced.select("unit", "id", "component", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))


def _pairs_of_blocks(frame: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Yield (left, right) rows to compare: some of one block, and what is in other components."""
    owner, side = frame.column("component").to_numpy(), frame.column("block").to_numpy()
    lo, hi = frame.column("lo")[0].as_py(), frame.column("hi")[0].as_py()
    left, right = np.flatnonzero(side == lo), np.flatnonzero(side == hi)
    left = left[np.argsort(owner[left], kind="stable")]
    for at in range(0, len(left), CHUNK):
        rows = left[at : at + CHUNK]
        only = owner[rows[0]] == owner[rows[-1]]
        yield rows, right[owner[right] != owner[rows[0]]] if only else right


def _possible(least: float) -> Callable[[pa.Table], pa.Table]:
    """Documents with a possible link outside their component, by packed bits."""

    def run(frame: pa.Table) -> pa.Table:
        owner = frame.column("component").to_numpy()
        planes = np.stack([frame.column(f"s{p}").to_numpy().view(np.uint64) for p in range(PLANES)], axis=1).reshape(len(owner), BITS, -1)
        open_ = np.zeros(len(owner), bool)
        for rows, others in _pairs_of_blocks(frame):
            if not len(others):
                continue
            differing = np.zeros((len(rows), len(others)), np.int64)
            for w in range(planes.shape[2]):
                joined = planes[rows, 0, w][:, None] ^ planes[others, 0, w]
                for p in range(1, BITS):
                    joined |= planes[rows, p, w][:, None] ^ planes[others, p, w]
                differing += np.bitwise_count(joined)
            near = (1 - differing / HASHES - 2.0**-BITS) / (1 - 2.0**-BITS) >= least - MARGIN
            near &= owner[rows][:, None] != owner[others]
            open_[rows] |= near.any(axis=1)
            open_[others] |= near.any(axis=0)
        return frame.select(["unit", "id"]).filter(pa.array(open_))

    return run


def _exact(num: int, den: int) -> Callable[[pa.Table], pa.Table]:
    """Links between components, a forest of them, by the sizes of all intersections."""

    def run(frame: pa.Table) -> pa.Table:
        members = frame.column("members").combine_chunks()
        values = members.values.to_numpy().view(np.uint64)
        offsets = members.offsets.to_numpy()
        size = np.diff(offsets)
        distinct, times = np.unique(values, return_counts=True)
        distinct = distinct[times > 1]
        # Shingles that occur once are in no intersection; the others are numbered, a part at a time.
        code, row = [], []
        for at in range(0, len(values), PART):
            part = values[at : at + PART]
            place = np.minimum(np.searchsorted(distinct, part), max(0, len(distinct) - 1))
            twice = np.flatnonzero(distinct[place] == part) if len(distinct) else np.zeros(0, np.int64)
            code.append(place[twice].astype(np.int32))
            row.append((np.searchsorted(offsets, at + twice, "right") - 1).astype(np.int32))
        code, row = (np.concatenate(x) if x else np.zeros(0, np.int32) for x in (code, row))
        shared = np.bincount(row, minlength=len(size))
        begin = np.append(0, np.cumsum(shared))
        hopeful = den * shared >= num * size
        ids, owner = frame.column("id").to_numpy(), frame.column("component").to_numpy()
        top: dict[int, int] = {}

        def find(x: int) -> int:
            while (y := top.get(x, x)) != x:
                top[x] = top.get(y, y)
                x = y
            return x

        place = np.full(len(distinct), -1, np.int32)
        found = []
        for rows, others in _pairs_of_blocks(frame):
            rows, others = rows[hopeful[rows]], others[hopeful[others]]
            if not len(rows) or not len(others):
                continue
            left, right = (np.concatenate([np.arange(begin[k], begin[k + 1], dtype=np.int32) for k in side]) for side in (rows, others))
            at_left, at_right = (np.repeat(np.arange(len(side), dtype=np.int32), shared[side]) for side in (rows, others))
            used = np.unique(code[left])
            place[used] = np.arange(len(used), dtype=np.int32)
            x, y = place[code[left]], place[code[right]]
            common = np.zeros((len(rows), len(others)), np.float32)
            for c in range(0, len(used), COLUMNS):
                width = min(COLUMNS, len(used) - c)
                sides = []
                for at, col, n in ((at_left, x, len(rows)), (at_right, y, len(others))):
                    inside = (col >= c) & (col < c + width)
                    dense = np.zeros((n, width), np.float32)
                    dense[at[inside], col[inside] - c] = 1
                    sides.append(dense)
                common += sides[0] @ sides[1].T
            place[used] = -1
            same = common.astype(np.int64)
            linked = (den * same >= num * (size[rows][:, None] + size[others] - same)) & (owner[rows][:, None] != owner[others])
            for k in np.flatnonzero(linked.any(axis=1)).tolist():
                with_ = others[linked[k]]
                for j in with_[np.unique(owner[with_], return_index=True)[1]].tolist():
                    a, b = find(int(owner[rows[k]])), find(int(owner[j]))
                    if a != b:
                        top[max(a, b)] = min(a, b)
                        found.append((int(ids[rows[k]]), int(ids[j])))
        return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})

    return run


def near_duplicates(df: DataFrame, shingle: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """Return (doc_id, n_shingles, component_id, kept), one row an input row.

    Documents are linked where ``den * |A & B| >= num * |A | B|`` holds for their
    sets of ``shingle``-word shingles; components are closed over links. ``block`` is
    the number of shingles that a task compares at once; it changes no result.
    """
    if num * 100 < 80 * den:
        raise ValueError("band parameters hold for similarities of 0.8 or more")
    least = num / den
    scratch = Scratch(df.sparkSession)
    texts = df.select(integer_id(df, id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    signed = scratch.write(map_batches(texts, _signatures(shingle), "id long, n long, f1 long, f2 long, bands array<long>, planes array<long>"))
    keys = ["n", "f1", "f2"]
    linkable = signed.where("n > 0 and id is not null")
    groups = scratch.write(linkable.groupBy(*keys).agg(F.min("id").alias("rep")))
    rows = scratch.write(signed.select("id", *keys).join(groups, keys, "left").select("id", "n", "rep"))
    first_rows = linkable.join(groups.withColumnRenamed("rep", "id"), ["id", *keys]).dropDuplicates(["id", *keys])
    names = [f"s{p}" for p in range(PLANES)]
    reps = scratch.write(first_rows.select("id", "n", "bands", *(F.col("planes")[p].alias(x) for p, x in enumerate(names))))
    scratch.drop(signed, groups)

    bucket = reps.select("id", "n", F.explode("bands").alias("key"))
    shared = bucket.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    company = scratch.write(bucket.join(shared, "key"))
    crowd = company.groupBy("id").agg(F.sum("size").alias("crowd"))
    hubs = company.join(crowd, "id").groupBy("key").agg(F.max(F.struct("crowd", (-F.col("id")).alias("negative"))).alias("top")).select("key", (-F.col("top.negative")).alias("hub"))
    met = company.join(hubs, "key").where("id <> hub").select("id", "hub").distinct()
    nearest = _candidates(met, reps, least).groupBy("id").agg(F.max(F.struct("estimate", (-F.col("hub")).alias("negative"))).alias("top"))
    pairs = scratch.write(nearest.select("id", (-F.col("top.negative")).alias("hub")))
    # Rows of one id with different texts are one document.
    named = rows.where("id is not null and rep is not null")
    times = named.groupBy("id").agg(F.count("*").alias("times")).where("times > 1").select("id")
    same = named.where("id <> rep").join(times, "id", "left_semi").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    links = scratch.write(_confirm(pairs, texts, shingle, num, den).union(same))
    scratch.drop(pairs)
    label = components(links, scratch)

    placed = company.join(label, "id", "left").select(F.col("key").alias("unit"), "id", F.coalesce("component", "id").alias("component"), F.greatest("n", F.lit(LEAST)).alias("weight"))
    # Of buckets with the same members one is compared.
    members = [F.count("*").alias("members"), *(F.bit_xor(F.xxhash64("id", F.lit(k))).alias(f"d{k}") for k in (1, 2))]
    mixed = placed.groupBy("unit").agg(F.min("component").alias("low"), F.max("component").alias("high"), *members).where("low <> high")
    mixed = mixed.groupBy("members", "d1", "d2").agg(F.min("unit").alias("unit")).select("unit")
    rest = scratch.write(placed.join(mixed, "unit"))
    scratch.drop(company)
    faced = _faces(rest, block).join(reps.select("id", *names), "id")
    open_ = scratch.write(faced.groupBy("unit", "lo", "hi").applyInArrow(_possible(least), "unit long, id long").distinct())
    scratch.drop(reps)
    if not open_.isEmpty():
        star = open_.join(open_.groupBy("unit").agg(F.min("id").alias("b")), "unit").select(F.col("id").alias("a"), "b")
        family = components(star, scratch)
        sides = rest.select("id", "component", "weight").distinct().join(family.select("id", F.col("component").alias("unit")), "id")
        sets = map_batches(_chosen(texts, family.select("id")), _sets(shingle), "id long, members array<long>")
        faced = _faces(sides, block).join(sets, "id")
        more = scratch.write(links.union(faced.groupBy("unit", "lo", "hi").applyInArrow(_exact(num, den), "a long, b long")))
        label = components(more, scratch)
        scratch.drop(more)
    scratch.drop(links, rest, open_)

    known = named.join(label.withColumnRenamed("id", "rep"), "rep", "left").groupBy("id").agg(F.min(F.coalesce("component", "rep")).alias("component")).where("component <> id")
    component = F.coalesce("component", "id")
    return rows.join(known, "id", "left").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def keep_one(df: DataFrame, shingle: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return ``df`` with one row of each near-duplicate component, all columns kept.

    It is the one with the smallest id. Rows with a null id stay; of rows that
    share an id the one with the first text in order stays, a null text as an empty one.
    """
    scratch = Scratch(df.sparkSession)
    ids = scratch.write(near_duplicates(df, shingle, num, den, id_col, text_col).where("doc_id is not null").groupBy(F.col("doc_id").alias(id_col)).agg(F.max("kept").alias("kept"), F.count("*").alias("times")))

    def few(chosen: DataFrame) -> DataFrame:
        return F.broadcast(chosen) if chosen.count() <= BROADCAST_IDS else chosen

    kept = df.join(few(ids.where("not kept").select(id_col)), id_col, "left_anti").select(*df.columns)
    repeated = ids.where("kept and times > 1").select(id_col)
    if repeated.isEmpty():
        return kept
    chosen = few(repeated)
    whole = F.min_by(F.struct(*df.columns), F.coalesce(F.col(text_col), F.lit(""))).alias("whole")
    one = kept.join(chosen, id_col, "left_semi").groupBy(F.col(id_col).alias("repeated")).agg(whole).select("whole.*")
    return kept.join(chosen, id_col, "left_anti").select(*df.columns).unionByName(one)
