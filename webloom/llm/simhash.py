"""SimHash near-dedup with covering locality-sensitive hashing: structured bit masks make every pair of fingerprints
within the radius equal under at least one mask."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webloom.llm.common import light_slices, materialise, own_columns, salted_join, small_batches, table

BITS = 64
#: Buckets of up to so many distinct fingerprints compare all their pairs; larger ones go another, exact way.
SMALL_BUCKET = 16
#: So many masks find most copies before the exact search for what they leave.
FIRST_MASKS = 8
#: Shingles counted at once for the list of frequent ones, and the most that the list holds. Both decide speed, not results.
COUNTED, FREQUENT = 2**21, 2**18


def covering_masks(radius: int, bits: int = BITS) -> list[int]:
    """``2 ** (radius + 1) - 1`` masks. Bit ``i`` has a nonzero vector ``m(i)`` of ``radius + 1`` bits; mask ``v`` keeps the bits
    with odd ``<m(i), v>``. Any ``radius`` vectors miss some nonzero ``v``, whose mask keeps none of those bits."""
    size = 2 ** (radius + 1) - 1
    vectors = [i * 0x9E3779B97F4A7C15 % 2**64 % size + 1 if size > bits else i % size + 1 for i in range(bits)]
    return [sum((bin(m & v).count("1") & 1) << i for i, m in enumerate(vectors)) for v in range(1, size + 1)]


def _shingle_hashes(text: str | None, words_each: int) -> list[int]:
    words = (text or "").encode().lower().split()
    if not words:
        return []
    if len(words) < words_each:
        return [xxhash.xxh64_intdigest(b" ".join(words), 42)]
    if words_each == 1:
        joined = words
    else:
        joined = map(b" ".join, zip(*[words[k:] for k in range(words_each)], strict=False))
    return [xxhash.xxh64_intdigest(s, 42) for s in joined]


def _bits_set(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Fingerprints of the runs of ``hashes`` between ``bounds``: a bit is set if it is in over half of a run."""
    out = np.zeros(len(bounds) - 1, np.uint64)
    step = 1 << 16
    sums = np.zeros((len(out), BITS), np.int64)
    run = np.repeat(np.arange(len(out)), np.diff(bounds))
    for at in range(0, len(hashes), step):
        part = hashes[at : at + step]
        ones = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        own = run[at : at + step]
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        sums[own[first]] += np.add.reduceat(ones, first, axis=0, dtype=np.int64)
    set_bits = (2 * sums > np.diff(bounds)[:, None]).astype(np.uint8)
    if len(out):
        out = np.packbits(set_bits, axis=1, bitorder="little").view("<u8").reshape(-1)
    return out


def fingerprints(docs: DataFrame, words_each: int = 3) -> DataFrame:
    """doc_id and the 64-bit fingerprint (a long) of every whole text; no words: 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in light_slices(whole, 1)):
            values, bounds = [], [0]
            for text in batch.column(1).to_pylist():
                values.append(np.array(_shingle_hashes(text, words_each), np.uint64))
                bounds.append(bounds[-1] + len(values[-1]))
            all_values = np.concatenate(values) if values else np.zeros(0, np.uint64)
            fp = _bits_set(all_values, np.array(bounds))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def _buckets(prints: DataFrame, masks: list[int], carry: list[str]) -> DataFrame:
    """One row a fingerprint and mask: ``carry`` and the hashed bucket key of the mask and the bits it keeps."""
    signed = [m - 2**64 if m >= 2**63 else m for m in masks]
    keys = F.array(*[F.xxhash64(F.lit(m), F.col("fp").bitwiseAND(F.lit(m))) for m in signed])
    return prints.select(*carry, F.explode(keys).alias("key"))


def _pairs_of(entries: DataFrame, radius: int) -> DataFrame:
    """All pairs (a, b), a < b, of the nodes of a key (key, node, fp) within the radius, once each. For keys of at most SMALL_BUCKET nodes."""
    return _within(
        entries.groupBy("key")
        .agg(F.sort_array(F.collect_list(F.struct("node", "fp"))).alias("all"))
        .select(F.posexplode("all").alias("at", "a"), "all")
        .select("a", F.explode(F.slice("all", F.col("at") + 2, F.size("all"))).alias("b")),
        radius,
    )


def _within(pairs: DataFrame, radius: int) -> DataFrame:
    """Of pairs of structs (node, fp) the nodes (a, b) with a < b within the radius, once each."""
    near = (F.col("a.node") < F.col("b.node")) & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= radius)
    return pairs.where(near).select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct()


def near_pairs(prints: DataFrame) -> DataFrame:
    """Edges (a, b) over distinct fingerprints ``fp`` that connect exactly what all pairs at 2 or fewer differing bits
    connect. Small buckets give all their pairs. A fingerprint in a large bucket instead names every value at most one bit away:
    two fingerprints within two bits share such a value, and all that share one lie within two bits of each other, so that each is linked to
    the least of them."""
    radius = 2
    entries = _buckets(prints, covering_masks(radius), ["fp"])
    buckets = materialise(entries.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    small = entries.join(buckets.where(F.col("n") <= SMALL_BUCKET).select("key"), "key", "left_semi")
    pairs = _pairs_of(small.withColumn("node", F.col("fp")), radius)
    crowded = entries.join(buckets.where(F.col("n") > SMALL_BUCKET).select("key"), "key", "left_semi").select("fp").distinct()
    flips = F.array(*[F.lit(1 << i if i < 63 else -(2**63)) for i in range(BITS)])
    near = F.concat(F.array("fp"), F.transform(flips, lambda x: F.col("fp").bitwiseXOR(x)))
    named = crowded.select("fp", F.explode(near).alias("key"))
    least = named.groupBy("key").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a < z").select("key", "a")
    stars = named.join(least, "key").select("a", F.col("fp").alias("b")).where("a < b")
    return pairs.union(stars).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): the least node reachable. Alternates large-star and small-star steps,
    each written out, until nothing changes; all on the executors."""
    edges = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v"))).distinct()
        edges = materialise(small)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if now == before:
            return edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
        before = now


def near_duplicates(docs: DataFrame, words_each: int = 3) -> DataFrame:
    """Fingerprints every text and names the component of each: the least doc_id reachable by links of 2 or fewer
    differing bits.

    Copies share a fingerprint and are one node, so their number costs nothing. Null or empty text: fingerprint 0,
    linked like any other. Fewer words than a shingle: the whole sequence. Very long text: whole. A null doc_id never names a component
    unless all its members are null. Repeated rows: each is returned. Empty table: no rows. Extra columns are ignored.
    Returns doc_id, fp (long), component_id.
    """
    prints = materialise(fingerprints(docs, words_each))
    nodes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(near_pairs(nodes.select("fp")))
    named = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    component = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of_print = materialise(named.join(component, "root").select("fp", "component_id"))
    return salted_join(prints, of_print, ["fp"]).select("doc_id", "fp", "component_id")


_PUNCTUATION = re.compile(rb"[^\w\x80-\xff]+")


_SETS = "doc_id long, text_hash long, fp long, node long, size long, shingles array<int>"


def _repeated(sets: list[np.ndarray]) -> pa.RecordBatch:
    """Rows of ``text_sets`` for the shingles in more than one of ``sets``: the shingle as text_hash, the count as fp, size -1."""
    values, counts = np.unique(np.concatenate(sets), return_counts=True)
    values, counts = values[counts > 1].view(np.int64), counts[counts > 1].astype(np.int64)
    none = pa.nulls(len(values), pa.int64())
    return _rows(none, pa.array(values), pa.array(counts), none, pa.array(np.full(len(values), -1)), pa.nulls(len(values), pa.list_(pa.int32())))


def _rows(*columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns), names=["doc_id", "text_hash", "fp", "node", "size", "shingles"])


def text_sets(docs: DataFrame, words_each: int = 5, repeated: bool = False) -> DataFrame:
    """Per text: doc_id, text_hash, a fingerprint of its distinct word pairs without punctuation, a hash of its set of word shingles, the set's size
    and the set, 32 bits a shingle. With ``repeated`` also the rows of ``_repeated`` for every COUNTED shingles of distinct sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        n_held = 0
        for batch in (part for whole in batches for part in light_slices(whole, 2, 500_000)):
            values, bounds, nodes, sets = [], [0], [], []
            for text in batch.column(2).to_pylist():
                words = _PUNCTUATION.sub(b" ", (text or "").encode().lower()).split()
                twos = set(map(b" ".join, zip(words, words[1:], strict=False))) or set(words)
                values.append(np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in twos), np.uint64, len(twos)))
                bounds.append(bounds[-1] + len(twos))
                own = np.unique(np.array(_shingle_hashes(text, words_each), np.uint64))
                sets.append(own)
                nodes.append(xxhash.xxh64_intdigest(own.tobytes()) - 2**63)
                if repeated and len(own) and nodes[-1] not in held:
                    held[nodes[-1]] = own
                    n_held += len(own)
                    if n_held >= COUNTED:
                        yield _repeated(list(held.values()))
                        held, n_held = {}, 0
            fp = _bits_set(np.concatenate(values), np.array(bounds)).view(np.int64)
            ends = np.cumsum([0, *map(len, sets)])
            shingles = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets).astype(np.uint32).view(np.int32)))
            yield _rows(batch.column(0), batch.column(1), pa.array(fp), pa.array(nodes, pa.int64()), pa.array(np.diff(ends)), shingles)
        if held:
            yield _repeated(list(held.values()))

    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text")
    return rows.mapInArrow(run, _SETS)


def _shingle_sets(figures: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, shingles) of the nodes in ``wanted``, once each; copies are one before the shuffle."""
    return figures.select("node", "shingles").join(wanted, "node", "left_semi").groupBy("node").agg(F.first("shingles").alias("shingles"))


def _least(crowd: DataFrame, n: int) -> DataFrame:
    """Per key an array of its ``n`` least nodes with their fingerprints. A key's nodes are first thinned out within slices of the
    hash space, so that a task sorts a slice of a large bucket rather than all of it."""
    first = Window.partitionBy("key", "slice").orderBy("node")
    few = crowd.withColumn("slice", F.pmod("node", F.lit(64))).withColumn("place", F.row_number().over(first)).where(F.col("place") <= n)
    return few.groupBy("key").agg(F.slice(F.sort_array(F.collect_list(F.struct("node", "fp"))), 1, n).alias("lead"))


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose shingle sets have at least that Jaccard similarity."""
    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    other = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return salted_join(pairs, one, ["a"]).join(other, "b").where(both >= similarity * (F.size("x") + F.size("y") - both)).select("a", "b")


def _near_texts(figures: DataFrame, nodes: DataFrame, masks: list[int], radius: int, similarity: float) -> DataFrame:
    """Verified edges (a, b), a < b, among nodes (node, fp) that share a bucket of ``masks``; see ``drop_near_duplicates`` for what crowded
    buckets compare."""
    entries = _buckets(nodes, masks, ["node", "fp"])
    # Always a shuffle of both sides, whatever their sizes here: the plan that large inputs get.
    counted = entries.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").hint("merge")
    alive = materialise(entries.join(counted, "key").select("key", "node", "fp", "n"))
    small = materialise(_pairs_of(alive.where(F.col("n") <= SMALL_BUCKET), radius))
    crowd, leaders = alive.where(F.col("n") > SMALL_BUCKET).select("key", "node", "fp"), 1
    # Only the sets of texts within the radius of another, or in a crowd, go on.
    wanted = small.select(F.col("a").alias("node")).union(small.select("b")).union(crowd.select("node")).distinct()
    sets = materialise(_shingle_sets(figures, wanted))
    check = lambda pairs: materialise(_verified(pairs, sets, similarity))
    found = [check(small)]
    while not crowd.isEmpty():
        lead = materialise(_least(crowd, leaders))
        led = materialise(crowd.join(lead, "key").select("key", F.struct("node", "fp").alias("b"), F.explode("lead").alias("a")))
        linked = check(_within(led.select("a", "b"), radius))
        found.append(linked)
        out = lead.select("key", F.explode("lead").alias("l")).select("key", F.col("l.node").alias("node"))
        joined = led.select("key", F.col("a.node").alias("a"), F.col("b.node").alias("node")).join(linked.withColumnRenamed("b", "node"), ["a", "node"]).select("key", "node")
        rest = crowd.join(out.union(joined).distinct(), ["key", "node"], "left_anti")
        rest = materialise(rest.join(rest.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key"))
        found.append(check(_pairs_of(rest.where(F.col("n") <= SMALL_BUCKET), radius)))
        crowd, leaders = rest.where(F.col("n") > SMALL_BUCKET).select("key", "node", "fp"), leaders * 4
    return materialise(reduce(DataFrame.union, found))


def _frequent(repeated: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, ascending, and counts of up to FREQUENT frequent shingles, from the rows of ``_repeated``."""
    totals = materialise(repeated.groupBy(F.col("text_hash").alias("h")).agg(F.sum("fp").alias("n")).where("n >= 8").withColumn("power", F.log2("n").cast("int")))
    least, room = 64, FREQUENT
    for r in sorted(totals.groupBy("power").count().collect(), reverse=True):
        room -= r["count"]
        if room < 0:
            break
        least = r.power
    rows = totals.where(F.col("power") >= least).select("h", "n").toArrow()
    hashes, counts = rows.column(0).to_numpy().view(np.uint64), rows.column(1).to_numpy()
    order = np.argsort(hashes)
    return hashes[order], counts[order]


def _prefixes(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray], smallest: int, similarity: float, words_each: int) -> DataFrame:
    """(node, size, common, keys) of every shingle set of ``smallest`` or more: the share of frequent shingles, and the set's first shingles in one
    order for all, rare ones first: so many that two sets of at least that Jaccard similarity have one of them in common."""
    listed, counts = frequent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in light_slices(whole, 0, 500_000)):
            nodes, sizes, common, keys = [], [], [], []
            for text in batch.column(0).to_pylist():
                own = np.unique(np.array(_shingle_hashes(text, words_each), np.uint64))
                n = len(own)
                if n < smallest:
                    continue
                times = np.zeros(n, np.int64)
                if len(listed):
                    at = np.minimum(np.searchsorted(listed, own), len(listed) - 1)
                    times = np.where(listed[at] == own, counts[at], 0)
                first = n - math.ceil(similarity * n - 1e-9) + 1
                nodes.append(xxhash.xxh64_intdigest(own.tobytes()) - 2**63)
                sizes.append(n)
                common.append(np.count_nonzero(times) / n)
                keys.append(own[np.lexsort((own, times))[:first]].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(common, pa.float64()), pa.array(keys, pa.list_(pa.int64()))],
                names=["node", "size", "common", "keys"],
            )

    rows = small_batches(docs).select("text").mapInArrow(run, "node long, size long, common double, keys array<long>")
    return rows.groupBy("node").agg(*[F.first(c).alias(c) for c in ("size", "common", "keys")])


def _with_roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``nodes`` with the root that ``edges`` give each, its own node where they give none."""
    return nodes.join(components(edges), "node", "left").withColumn("root", F.coalesce("root", "node"))


def _missing_links(docs: DataFrame, figures: DataFrame, nodes: DataFrame, edges: DataFrame, frequent: tuple[np.ndarray, np.ndarray], radius: int, similarity: float, words_each: int) -> DataFrame:
    """What ``edges`` lack: verified edges with which they connect exactly what all pairs of nodes (node, fp) within the similarity and the
    radius connect. A pair is compared if its sets share a shingle of their prefixes and the two are not connected yet. Crowded buckets first
    compare all nodes with the one that has most of its shingles in common with others, which connects a group of edited copies."""
    smallest = _smallest(similarity)
    prefixes = materialise(_prefixes(docs, frequent, smallest, similarity, words_each))
    facts = materialise(_with_roots(prefixes.select("node", "size", "common").join(nodes, "node"), edges))
    keyed = prefixes.select("node", F.posexplode("keys").alias("at", "key"))
    rooted = facts.select("node", "root").join(prefixes.select("node", "keys"), "node").select("root", F.explode("keys").alias("key"))
    mixed = lambda rows: rows.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key").hint("merge")
    entries = materialise(keyed.join(mixed(rooted), "key").join(facts, "node"))

    def check(pairs: DataFrame) -> DataFrame:
        pairs = materialise(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        sets = materialise(_shingle_sets(figures, wanted))
        return materialise(_verified(pairs, sets, similarity))

    # Sets of this similarity differ in size by that factor at most.
    near = (F.col("x.root") != F.col("y.root")) & (F.least("x.size", "y.size") >= similarity * F.greatest("x.size", "y.size") - 1e-6)
    if radius < BITS:
        near &= F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= radius
    crowd = entries.join(entries.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > SMALL_BUCKET).select("key"), "key", "left_semi")
    fields = F.struct("node", "root", "size", "fp")
    lead = crowd.groupBy("key").agg(F.max_by(fields, F.struct("common", "node")).alias("x"))
    stars = check(crowd.select("key", fields.alias("y")).join(lead, "key").where(near).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")))
    now = materialise(_with_roots(facts.select("node"), edges.union(stars)))
    entries = materialise(entries.drop("root").join(now, "node"))
    entries = materialise(entries.join(mixed(entries), "key"))
    # In the bucket of the first shingle that two similar sets share, enough of both follows.
    follows = F.least(F.col("x.size") - F.col("x.at"), F.col("y.size") - F.col("y.at"))
    near &= follows * (1 + similarity) >= similarity * (F.col("x.size") + F.col("y.size")) - 1e-6
    one = entries.alias("x").hint("merge")
    rest = check(one.join(entries.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.node") < F.col("y.node")) & near).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")))
    return stars.union(rest)


def _smallest(similarity: float) -> int:
    """Smaller sets cannot be similar without being equal."""
    return int(similarity / (1 - similarity) + 1e-9)


def drop_near_duplicates(docs: DataFrame, radius: int = 6, similarity: float = 0.8, words_each: int = 5) -> DataFrame:
    """Keeps one document of each group of near duplicates: of the text that leads the group, the one of least doc_id.

    Two texts are near duplicates if the Jaccard similarity of their sets of ``words_each``-word shingles (A-Z lower-cased) is
    ``similarity`` or more and the fingerprints of their distinct word pairs differ in at most ``radius`` bits (64: whatever they are); groups are what
    such links connect. Texts of one shingle set are one node. The first covering masks find most links cheaply: buckets with up to SMALL_BUCKET nodes
    compare all pairs, larger ones all nodes with a growing number of leaders. A prefix filter on the shingles, which misses no pair of that
    similarity, then finds every link between texts that are not connected yet, so the groups are exact. The work is linear
    where a bucket is a group of copies; only texts that share rare shingles and yet are not connected meet each other.
    Null and empty texts: one group. Fewer words than a shingle: equal word sequences only. Very long texts: whole. Wholly
    equal rows: one stays. Null doc_id: after all others. Empty table: no rows. All columns are kept as they are.
    """
    columns = own_columns(docs)
    both = materialise(text_sets(docs, words_each, repeated=True))
    figures, frequent = both.where("size >= 0"), _frequent(both.where("size < 0"))
    nodes = figures.groupBy("node").agg(F.min("fp").alias("fp"), F.max("size").alias("size"))
    alive = materialise(nodes.where(F.col("size") >= _smallest(similarity)).drop("size"))
    edges = _near_texts(figures, alive, covering_masks(min(radius, 6))[:FIRST_MASKS], radius, similarity)
    roots = components(edges.union(_missing_links(docs, figures, alive, edges, frequent, radius, similarity, words_each)))
    # The text that leads a group is its least node.
    leading = salted_join(figures, roots.where("node <> root").select("node"), ["node"], "left_anti")
    stays = materialise(
        leading.groupBy("node")
        .agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("s"))
        .select(F.struct("s.doc_id", "s.text_hash").alias("__wanted"))
    )
    key = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    kept = docs.select(*columns, key.alias("__stays"))
    twice = materialise(figures.groupBy(F.struct("doc_id", "text_hash").alias("twice")).agg(F.count("*").alias("n")).where("n > 1").select("twice"))
    same = stays["__wanted"].eqNullSafe(twice.twice)
    of = lambda wanted: kept.join(wanted, F.col("__stays").eqNullSafe(F.col("__wanted")), "left_semi")
    once, again = of(stays.join(twice, same, "left_anti")), of(stays.join(twice, same, "left_semi"))
    return once.select(*columns).union(again.dropDuplicates(["__stays"]).select(*columns))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint and component."""
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
