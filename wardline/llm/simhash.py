"""SimHash near-duplicates by anchor-point covering.

Of the 64 bits, two blocks of 31 are covered by the perfect Hamming code of length 31: its codewords are the anchors, and
every block value lies within one bit of exactly one anchor, its home. Two fingerprints that differ in at most three bits
differ in at most one bit of one of the blocks; so in that block the second lies within 1 + 1 bits of the home of the
first. Every distinct fingerprint is sent to all anchors within two bits (1 or 16 a block) and compared there with the
fingerprints whose home it is. An anchor emits a spanning forest of its links and never all pairs of a dense group;
anchors that are home to more than HOME_SHARE fingerprints are split, their visitors copied to each part.

Copies share a fingerprint and are one row before anything is compared. Components come from alternating stars over the
links, each round a table in the shared folder.

Defined results: a null or empty text has fingerprint zero and links like any other; a component without any doc_id has a
null component_id; repeated rows and repeated ids are rows of their own and share their component.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.lookup import attach_key_facts
from ..session import materialize

SHINGLE_WORDS = 3
MAX_DISTANCE = 3
HASH_SEED = 42
BLOCK_BITS = 31
HOME_SHARE = 2048  # fingerprints at home in one part of an anchor
FEW_HOMES = 8  # up to here a part's comparisons are made together with those of other anchors
PAIRS_AT_ONCE = 1 << 20  # comparisons held in memory together
HOT_ANCHORS = 100_000  # a list of split anchors is broadcast up to this many rows


def fingerprint_of(text: bytes, shingle_words: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash of a text's word shingles, as a signed number; only A-Z change case."""
    words = text.lower().split()
    if not words:
        return 0
    digest = partial(xxhash.xxh64_intdigest, seed=HASH_SEED)
    if len(words) < shingle_words:
        shingles: Iterator[bytes] = iter([b" ".join(words)])
        count = 1
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(shingle_words))))
        count = len(words) - shingle_words + 1
    hashes = np.fromiter(map(digest, shingles), np.uint64, count)
    votes = np.zeros(64, np.int64)
    for at in range(0, count, 1 << 16):
        part = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > count, bitorder="little").view(np.int64)[0])


def fingerprint(text: Column, shingle_words: int = SHINGLE_WORDS) -> Column:
    """The SimHash of whole texts as a long."""

    @F.arrow_udf("long")
    def hashed(column: pa.Array) -> pa.Array:
        texts = column.cast(pa.large_binary())
        return pa.array([fingerprint_of(x.as_py() or b"", shingle_words) for x in texts], pa.int64())

    return hashed(text)


def as_hex(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def _anchor_visits(value: Column) -> tuple[Column, Column]:
    """Home anchor of a block value, and all anchors within two bits of it."""
    places = range(1, BLOCK_BITS + 1)
    syndrome = F.lit(0)
    for j in range(5):
        checked = sum(1 << (i - 1) for i in places if i >> j & 1)
        parity = F.bit_count(value.bitwiseAND(F.lit(checked))) % 2
        syndrome = syndrome + parity * (1 << j)
    syndrome = syndrome.cast("int")
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << (i - 1)).cast("long") for i in places])
    home = value.bitwiseXOR(F.get(flips, syndrome))
    # Flipping the places i and j leads to an anchor exactly when i xor j is the syndrome; place 0 stands for no flip.
    pairs = F.filter(F.sequence(F.lit(0), F.lit(BLOCK_BITS)), lambda i: i < i.bitwiseXOR(syndrome))
    near = F.transform(pairs, lambda i: value.bitwiseXOR(F.get(flips, i)).bitwiseXOR(F.get(flips, i.bitwiseXOR(syndrome))))
    return home, F.when(syndrome == 0, F.array(value)).otherwise(near)


def visits(fingerprints: DataFrame) -> DataFrame:
    """anchor, home, fp: every fingerprint at all anchors near it, over both blocks."""
    blocks = []
    for block in (0, 1):
        value = F.shiftrightunsigned("fp", BLOCK_BITS * block).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1))
        home, near = _anchor_visits(F.col("_value"))
        one = fingerprints.select("fp", value.alias("_value")).select("fp", home.alias("_home"), F.explode(near).alias("_near"))
        blocks.append(one.select((F.col("_near") * 2 + block).alias("anchor"), (F.col("_near") == F.col("_home")).alias("home"), "fp"))
    return blocks[0].unionByName(blocks[1])


def _forest(homes: np.ndarray, visitors: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what the comparisons of one anchor connect: at most one a visitor and one a home."""
    group = np.arange(len(homes))
    for at in range(0, len(visitors), max(1, PAIRS_AT_ONCE // len(homes))):
        part = visitors[at : at + max(1, PAIRS_AT_ONCE // len(homes))]
        near = np.bitwise_count(part[:, None] ^ homes[None, :]) <= most
        found = near.any(axis=1)
        part, near = part[found], near[found]
        if not len(part):
            continue
        first = near.argmax(axis=1)
        yield part, homes[first]
        while True:
            lowest = np.where(near, group, len(homes)).min(axis=1)
            highest = np.where(near, group, -1).max(axis=1)
            apart = np.flatnonzero(lowest != highest)
            if not len(apart):
                break
            low, high = lowest[apart[0]], highest[apart[0]]
            yield homes[[high]], homes[[low]]
            group[group == high] = low


def _links_of(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Links within anchors; rows come sorted by anchor part, homes first. A part may span batches: its homes stay."""
    last_part, last_homes = None, np.empty(0, np.uint64)
    for batch in batches:
        part = batch.column("part").to_numpy()
        home = batch.column("home").to_numpy(zero_copy_only=False)
        fp = batch.column("fp").to_numpy().view(np.uint64)
        if not len(part):
            continue
        if part[0] == last_part:
            part = np.concatenate([np.full(len(last_homes), last_part), part])
            home = np.concatenate([np.full(len(last_homes), True), home])
            fp = np.concatenate([last_homes, fp])
        starts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        sizes = np.diff(np.append(starts, len(part)))
        homes = np.add.reduceat(home.astype(np.int64), starts)
        last_part, last_homes = part[-1], fp[starts[-1] : starts[-1] + homes[-1]]
        left, right = [], []
        for i in np.flatnonzero((homes > FEW_HOMES) & (sizes > 1)):
            own = fp[starts[i] : starts[i] + sizes[i]]
            for a, b in _forest(own[: homes[i]], own, most):
                left.append(a)
                right.append(b)
        few = (homes > 0) & (homes <= FEW_HOMES) & (sizes > 1)
        for k in range(FEW_HOMES):
            some = few & (homes > k)
            visitor = np.repeat(starts[some], sizes[some]) + _counting(sizes[some])
            a, b = fp[visitor], fp[np.repeat(starts[some] + k, sizes[some])]
            near = np.bitwise_count(a ^ b) <= most
            left.append(a[near])
            right.append(b[near])
        a, b = np.concatenate(left).view(np.int64), np.concatenate(right).view(np.int64)
        different = a != b
        if different.any():
            a, b = a[different], b[different]
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["u", "v"])


def _counting(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... within each run of the given sizes."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)


def links(fingerprints: DataFrame, max_distance: int = MAX_DISTANCE, home_share: int = HOME_SHARE) -> DataFrame:
    """u > v: links between distinct fingerprints (column fp) that connect all within max_distance bits."""
    if not 0 <= max_distance <= MAX_DISTANCE:
        raise ValueError(f"two blocks cover distances of up to {MAX_DISTANCE} bits, not {max_distance}")
    rows = visits(fingerprints)
    crowded = rows.filter("home").groupBy("anchor").agg(F.ceil(F.count(F.lit(1)) / home_share).alias("parts")).filter("parts > 1")
    crowded = materialize(crowded, "anchors")
    hot = crowded.count()
    if hot:
        rows = rows.join(F.broadcast(crowded) if hot <= HOT_ANCHORS else crowded, "anchor", "left")
        own = F.pmod(F.xxhash64("fp"), F.coalesce("parts", F.lit(1)))
        every = F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1)
        rows = rows.select("anchor", "fp", F.col("home").alias("_home"), own.alias("_own"), F.explode(every).alias("_part"))
        rows = rows.select("anchor", "fp", (F.col("_home") & (F.col("_part") == F.col("_own"))).alias("home"), "_part")
    else:
        rows = rows.withColumn("_part", F.lit(0).cast("long"))
    rows = rows.select((F.col("anchor") * (1 << 24) + F.col("_part")).alias("part"), "home", "fp")
    sorted_rows = rows.repartition("part").sortWithinPartitions("part", F.desc("home"))
    return sorted_rows.mapInArrow(partial(_links_of, most=max_distance), "u long, v long")


def stars(edges: DataFrame) -> DataFrame:
    """u, v: for every node u of a component that is not its least, the least node v."""
    edges = materialize(edges.distinct(), "links")
    seen = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 30)))).first()
        if state == seen or not state[0]:
            return edges
        seen = state
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(floor, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialize(small.unionByName(floor.select("u", F.col("m").alias("v"))).distinct(), "links")


def fingerprint_rows(documents: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, fp of every row, written once."""
    return materialize(documents.select("doc_id", fingerprint(F.col("text"), shingle_words).alias("fp")), "fingerprints")


def groups(rows: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """fp, copies, component_id, root: one row for each distinct fingerprint of (doc_id, fp) rows.

    root is the least fingerprint of the component, component_id its least doc_id.
    """
    distinct = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("copies")), "distinct")
    linked = stars(links(distinct.select("fp"), max_distance))
    roots = linked.select(F.col("u").alias("fp"), F.col("v").alias("root"))
    rooted = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return rooted.join(least, "root").select("fp", "copies", "component_id", "root")


def near_duplicates(documents: DataFrame, shingle_words: int = SHINGLE_WORDS, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """doc_id, fingerprint (hex), component_id for every row of documents (doc_id, text)."""
    rows = fingerprint_rows(documents, shingle_words)
    facts = groups(rows, max_distance).select(as_hex(F.col("fp")).alias("fingerprint"), "copies", "component_id")
    keyed = rows.select("doc_id", as_hex(F.col("fp")).alias("fingerprint"))
    return attach_key_facts(keyed, facts, "fingerprint", F.col("doc_id")).select("doc_id", "fingerprint", "component_id")


def keep_one(documents: DataFrame, shingle_words: int = SHINGLE_WORDS, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """One document of each component, that of the least doc_id, with its columns.

    A row whose id is null is kept only where its component has no id. Rows that share an id are told apart by their
    fingerprints, and the least text among rows of the same id and component stays.
    """
    rows = fingerprint_rows(documents, shingle_words)
    found = materialize(groups(rows, max_distance), "components")
    repeated = rows.groupBy("doc_id").count().filter("count > 1 or doc_id is null").select("doc_id")
    repeated = materialize(repeated, "repeated-ids")
    chosen = found.select(F.col("component_id").alias("doc_id")).distinct().join(repeated, "doc_id", "left_anti")
    unique = documents.join(chosen, "doc_id", "left_semi")
    columns = F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("_row")
    doubtful = documents.alias("d").join(repeated.alias("r"), F.expr("d.doc_id <=> r.doc_id"), "left_semi").select(columns)
    doubtful = doubtful.withColumn("fp", fingerprint(F.col("_row.text"), shingle_words)).join(found, "fp")
    doubtful = doubtful.filter(F.col("_row.doc_id").eqNullSafe(F.col("component_id")))
    one = doubtful.groupBy("root").agg(F.min_by("_row", F.struct(F.col("_row.text"), F.to_json(F.struct("_row")))).alias("_row"))
    return unique.select(*[f"`{c}`" for c in documents.columns]).unionByName(one.select("_row.*"))
