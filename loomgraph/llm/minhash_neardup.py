"""Near-duplicate documents by MinHash bands, odd sketches and full-set checks.

A document is the set of its distinct ``shingle``-word runs (words lower-cased A-Z;
a text of fewer words is one run). Two are linked when their Jaccard similarity is
``percent`` / 100 or more; links make components.

1. Documents with equal sets (128-bit digest) form a class; its smallest id stands
   for it from here on.
2. ``rows`` MinHash values make a band key, ``bands`` keys a document. A pair at 0.75
   shares none of 48 bands of 5 with a chance of 2e-6.
3. All samples of a document are folded into an odd sketch: each toggles one bit.
   The bits set in the XOR of two sketches estimate how many samples differ, most
   precisely at high similarity (Mitzenmacher, Pagh, Pham 2014). Pairs whose
   sketches differ by more than five standard deviations above what the limit
   implies are dropped, all others are compared by their full sets.
4. Hubs: every document is compared with the best sketch among the smallest ids of
   its buckets; this joins the members of large groups in linear work.
5. The rest: in buckets that still hold more than one component, the documents of the main (most frequent)
   component and all others are cut into blocks of ``block`` documents, and each block of others is
   compared by sketch with each main one and with each block of others. Two blocks are the most that a group
   holds, however large a bucket is. Only pairs of different components
   that no earlier band holds are confirmed, and a group returns one link for each
   pair of components that it joins, never all pairs.

Nulls: a document without words (or with a null text) is in no set and linked with
nothing; a null id takes no part and is returned with a null component. Rows that
repeat an id are one node: the union of their links. Of equally good hubs the smallest id counts. Very
long texts are taken one at a time, in memory in proportion to their bytes. Other columns are not read,
whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .storage import discard, partitions, pick, written
from .words import mix, short_runs, signed, slices

SKETCH_BITS = 1024


def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.Generator(np.random.PCG64(5))
    return r.integers(0, 2**32, n, dtype=np.uint32), r.integers(0, 2**31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def _shingles(s, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document of a slice, sorted, and where each begins."""
    words = s.word_hash(lower=True)
    first, h = s.grams(words, k)
    doc = np.searchsorted(s.ptr, first, side="right") - 1
    short = np.flatnonzero((s.counts > 0) & (s.counts < k))
    if len(short):
        h = np.r_[h, short_runs(words, s.ptr[short], s.ptr[short + 1])]
        doc = np.r_[doc, short]
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(s.n + 1))


def _min_hashes(h: np.ndarray, flip: np.ndarray, scale: np.ndarray) -> np.ndarray:
    least = np.full(len(flip), 0xFFFFFFFF, np.uint32)
    low = (h >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(low), 1024):
        np.minimum(least, ((low[i : i + 1024, None] ^ flip) * scale).min(axis=0), out=least)
    return least


def _odd_sketch(samples: np.ndarray) -> np.ndarray:
    place = mix(samples.astype(np.uint64) + (np.arange(len(samples), dtype=np.uint64) << np.uint64(32))) % np.uint64(SKETCH_BITS)
    odd = (np.bincount(place.astype(np.int64), minlength=SKETCH_BITS) & 1).astype(np.uint8)
    return np.packbits(odd)


def _sets(k: int):
    """id, size and digest of each document's set."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for s in slices(batch.column(1)):
                h, ptr = _shingles(s, k)
                wide = np.zeros((2, len(h) + 1), np.uint64)
                np.cumsum(mix(h), out=wide[0, 1:])
                np.cumsum(mix(h + np.uint64(0x5DEECE66D)), out=wide[1, 1:])
                digest = wide[:, ptr[1:]] - wide[:, ptr[:-1]]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(s.rows[0], s.n),
                        pa.array(np.diff(ptr).astype(np.int64)),
                        pa.array(signed(digest[0])),
                        pa.array(signed(digest[1])),
                    ],
                    names=["id", "n", "d0", "d1"],
                )

    return run


def _signatures(k: int, bands: int, rows: int):
    """id, size, band keys and odd sketch of each document that has a set."""
    flip, scale = _seeds(bands * rows)

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for s in slices(batch.column(1)):
                h, ptr = _shingles(s, k)
                some = np.flatnonzero(np.diff(ptr))
                if not len(some):
                    continue
                keys, sketches = [], []
                for d in some:
                    samples = _min_hashes(h[ptr[d] : ptr[d + 1]], flip, scale)
                    sketches.append(_odd_sketch(samples).tobytes())
                    band = np.zeros(bands, np.uint64)
                    for column in samples.reshape(bands, rows).T:
                        band = mix(band * np.uint64(31) + column)
                    keys.append(mix(band + np.arange(bands, dtype=np.uint64)))
                flat = pa.array(signed(np.concatenate(keys)))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(s.rows[0], s.n).take(pa.array(some)),
                        pa.array(np.diff(ptr)[some].astype(np.int64)),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * bands), flat),
                        pa.array(sketches, pa.binary()),
                    ],
                    names=["id", "n", "keys", "sketch"],
                )

    return run


def _hash_sets(k: int):
    """id and sorted shingle hashes, as bytes."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for s in slices(batch.column(1)):
                h, ptr = _shingles(s, k)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(s.rows[0], s.n), pa.array([h[a:b].tobytes() for a, b in zip(ptr[:-1], ptr[1:], strict=True)], pa.binary())],
                    names=["id", "hashes"],
                )

    return run


def most_bits(samples: int, percent: int) -> int:
    """Bits that may differ between the sketches of a pair at the limit, with five deviations to spare."""
    apart = 1 - percent / 100
    differ = samples * apart + 5 * math.sqrt(samples * apart * (1 - apart))
    toggles = 2 * differ
    mean = SKETCH_BITS / 2 * (1 - (1 - 2 / SKETCH_BITS) ** toggles)
    return math.ceil(mean + 5 * math.sqrt(toggles) / 4)


def _alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Both sorted and distinct: 100 * |a & b| >= percent * |a | b|."""
    if not len(a) or not len(b):
        return False
    place = np.searchsorted(a, b)
    place[place == len(a)] = 0
    common = int(np.count_nonzero(a[place] == b))
    return 100 * common >= percent * (len(a) + len(b) - common)


def _confirm_pairs(percent: int):
    def run(batches):
        for batch in batches:
            ok = [
                _alike(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent)
                for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            ]
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    return run


class _Union:
    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = x
        while (above := self.up.get(root, root)) != root:
            root = above
        while (above := self.up.get(x, x)) != root and above != x:
            self.up[x], x = root, above
        return root

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
        return x != y


def _pairs(part: dict, limit: int, percent: int, bands: int):
    """Pairs (i, j) of a block that need a full check: different components, sizes and sketches that
    allow a link, and no earlier band in common. Side 1 meets side 0; a block that is alone meets itself."""
    ids, component, n, sketch, keys, side, band = (part[c] for c in ("id", "component", "n", "sketch", "keys", "side", "band"))
    one, two = np.flatnonzero(side == 1), np.flatnonzero(side == 0)
    for i in one:
        js = one[ids[one] > ids[i]] if part["alone"] else two
        fits = (component[js] != component[i]) & (100 * np.minimum(n[js], n[i]) >= percent * np.maximum(n[js], n[i]))
        js = js[fits]
        if not len(js):
            continue
        bits = np.bitwise_count(sketch[js] ^ sketch[i]).sum(axis=1)
        near = bits <= limit
        js, bits = js[near], bits[near]
        if band and len(js):
            first = ~(keys[js, :band] == keys[i, :band]).any(axis=1)
            js, bits = js[first], bits[first]
        for j, b in zip(js.tolist(), bits.tolist(), strict=True):
            yield b, int(i), j


def _part(rows: pa.Table, bands: int) -> dict:
    keys = rows["keys"].combine_chunks().flatten().to_numpy().reshape(-1, bands)
    sketch = np.frombuffer(b"".join(rows["sketch"].to_pylist()), np.uint64).reshape(len(rows), -1)
    out = {c: rows[c].to_numpy() for c in ("id", "component", "n", "side")}
    x, y = rows["x"][0].as_py(), rows["y"][0].as_py()
    return out | {"keys": keys, "sketch": sketch, "band": int(rows["band"][0].as_py()), "alone": x == -1 - y}


#: x: a main block, or -1 - a block of others; y: a block of others.
_PART = ["key", "band", "x", "y"]


def _screen(limit: int, percent: int, bands: int):
    """Which documents of a block have a pair that needs a full check."""

    def run(table: pa.Table) -> pa.Table:
        part = _part(table, bands)
        hit = np.zeros(len(table), bool)
        for _, i, j in _pairs(part, limit, percent, bands):
            hit[i] = hit[j] = True
        return table.select([*_PART, "id", "component", "n", "sketch", "keys", "side"]).filter(pa.array(hit))

    return run


def _settle(limit: int, percent: int, bands: int):
    """Links that join components, from the pairs of a block, most alike first."""

    def run(table: pa.Table) -> pa.Table:
        part = _part(table, bands)
        sets = [np.frombuffer(x or b"", np.uint64) for x in table["hashes"].to_pylist()]
        joined, out = _Union(), []
        for _, i, j in sorted(_pairs(part, limit, percent, bands)):
            a, b = int(part["component"][i]), int(part["component"][j])
            if joined.find(a) != joined.find(b) and _alike(sets[i], sets[j], percent):
                joined.join(a, b)
                out.append((a, b))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return run


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    percent: int = 75,
    bands: int = 48,
    rows: int = 5,
    block: int = 2048,
) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest id reachable by links) and kept (doc_id = component_id)."""
    spark = docs.sparkSession
    texts = pick(docs, id=id_col, text=text_col)
    limit = most_bits(bands * rows, percent)

    # 1. classes of equal sets
    sets = written(texts.mapInArrow(_sets(shingle), "id long, n long, d0 long, d1 long"), "sets")
    classes = sets.where("n > 0 and id is not null").groupBy("n", "d0", "d1").agg(F.min("id").alias("rep"))
    rep = F.when(F.col("id").isNotNull(), F.col("rep")).alias("rep")
    members = written(sets.join(classes, ["n", "d0", "d1"], "left").select("id", "n", rep), "members")
    reps = members.where("id = rep").select("id").distinct()

    # 2. bands
    schema = "id long, n long, keys array<long>, sketch binary"
    signs = texts.where("id is not null").mapInArrow(_signatures(shingle, bands, rows), schema)
    signs = written(signs.join(reps, "id", "left_semi"), "signs")
    keys = signs.select("id", F.posexplode("keys").alias("band", "key"))
    hubs = keys.groupBy("key", "band").agg(F.min("id").alias("hub"), F.max("id").alias("last")).where("hub != last")
    buckets = written(keys.join(hubs.select("key", "band", "hub"), ["key", "band"]), "buckets")

    # 3. the best hub of each document
    light = signs.select("id", "n", "sketch")
    to_hub = (
        buckets.where("id != hub")
        .select("id", "hub")
        .distinct()
        .join(light, "id")
        .join(light.select(F.col("id").alias("hub"), F.col("n").alias("hub_n"), F.col("sketch").alias("hub_sketch")), "hub")
        .where(100 * F.least("n", "hub_n") >= percent * F.greatest("n", "hub_n"))
        .mapInArrow(_differing(limit), "id long, hub long, bits int")
        .groupBy("id")
        .agg(F.min_by("hub", F.struct("bits", "hub")).alias("hub"))
    )
    to_hub = written(to_hub, "hubs")
    wanted = to_hub.select("id").union(to_hub.select(F.col("hub").alias("id"))).distinct()
    hashes = texts.join(wanted, "id", "left_semi").mapInArrow(_hash_sets(shingle), "id long, hashes binary")
    hashes = written(hashes, "hashes")
    pairs = to_hub.join(hashes, "id").join(hashes.select(F.col("id").alias("hub"), F.col("hashes").alias("hub_hashes")), "hub")
    links = pairs.select("id", "hub", "hashes", "hub_hashes").mapInArrow(_confirm_pairs(percent), "id long, hub long")
    links = written(links.select(F.col("id").alias("a"), F.col("hub").alias("b")), "links", batch_rows=500)
    labels = written(components(links), "labels")
    discard(to_hub, hashes)

    # 4. buckets that hold more than one component
    labelled = buckets.join(labels.withColumnRenamed("node", "id"), "id", "left").select(
        "key", "band", "id", F.coalesce("component", "id").alias("component")
    )
    kinds = labelled.groupBy("key", "band", "component").agg(F.count("*").alias("n"))
    mixed = (
        kinds.groupBy("key", "band")
        .agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.sum("n").alias("all"), F.max("n").alias("most"), F.count("*").alias("kinds"))
        .where("kinds > 1")
        .select("key", "band", "main", F.ceil(F.col("most") / block).cast("int").alias("mains"), F.ceil((F.col("all") - F.col("most")) / block).cast("int").alias("others"))
    )
    is_main = F.col("component") == F.col("main")
    rest = labelled.join(mixed, ["key", "band"]).withColumn("own", F.pmod(F.xxhash64("id"), F.when(is_main, F.col("mains")).otherwise(F.col("others"))).cast("int"))
    places = F.expr("""
      CASE WHEN component = main THEN transform(sequence(0, others - 1), y -> struct(own AS x, y AS y, 0 AS side))
      ELSE concat(transform(sequence(0, mains - 1), x -> struct(x AS x, own AS y, 1 AS side)),
        transform(sequence(own, others - 1), y -> struct(-1 - own AS x, y AS y, 1 AS side)),
        transform(filter(sequence(0, others - 1), x -> x < own), x -> struct(-1 - x AS x, own AS y, 0 AS side))) END""")
    placed = rest.select("key", "band", "id", "component", F.explode(places).alias("p")).select("key", "band", "id", "component", "p.*").join(signs, "id")
    shape = "key long, band int, x int, y int, id long, component long, n long, sketch binary, keys array<long>, side int"
    screened = placed.groupBy(*_PART).applyInArrow(_screen(limit, percent, bands), shape)
    screened = written(screened, "screened")
    discard(buckets)
    wanted = screened.select("id").distinct()
    hashes = texts.join(wanted, "id", "left_semi").mapInArrow(_hash_sets(shingle), "id long, hashes binary")
    more = screened.join(hashes, "id").groupBy(*_PART).applyInArrow(_settle(limit, percent, bands), "a long, b long")
    final = written(components(links.union(more)), "labels")
    discard(screened, signs, labels)

    return (
        members.join(final.withColumnRenamed("node", "rep"), "rep", "left")
        .select(
            F.col("id").alias("doc_id"),
            F.col("n").alias("n_shingles"),
            F.coalesce("component", "rep", "id").alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
        .repartition(partitions(spark))
    )


def _differing(limit: int):
    """Pairs whose sketches differ in few enough bits."""

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(len(batch), -1) for c in ("sketch", "hub_sketch"))
            bits = np.bitwise_count(a ^ b).sum(axis=1).astype(np.int32)
            near = pa.array(bits <= limit)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("hub"), pa.array(bits)], names=["id", "hub", "bits"]).filter(near)

    return run
