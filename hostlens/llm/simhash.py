"""Near-duplicates by SimHash fingerprints and meet-in-the-middle ball hashing.

Two fingerprints at most ``2 r`` bits apart have a common neighbour at most r
bits from both.  So every distinct fingerprint emits all variants within r
bits, variants are shuffled, and fingerprints that meet at a variant are linked
after their distance was checked.  A variant meets at most as many fingerprints
as its ball holds (65 for r = 1), however many documents share them, and they
are linked as a chain, so no group is expanded into pairs.

Links become components by alternating large-star and small-star steps on
written tables; every document then carries the smallest doc_id it can reach.

That contract (3 words, 2 of 64 bits) is the one of op4.  The stage that keeps
one document of each group (``one_per_component``) asks for 5-word shingles and
an exact Jaccard similarity of 0.8 or more, at which a 64-bit fingerprint
differs in ten bits.  It uses several short fingerprints instead, each with its
ball of one bit.  Sets that meet at a variant are compared in rounds: a round
gives each variant one of its members as centre, other components there are
compared with it, and what is alike becomes one component.  Whatever then still
meets from different components is compared pair by pair.  See ``copies``.

Null and empty texts have fingerprint zero, which is linked like any other.
Documents without doc_id get a component but never name one (null if no member
has an id).  Repeated rows stay repeated.  An empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from hostlens.llm.common import col, fresh, materialize, query, small_batches, table
from hostlens.sources.store import discard

SEED = 42
_CHUNK = 1 << 16
#: share of the pairs just at the similarity asked for that the short fingerprints let meet, by design
RECALL = 0.96
#: members of a variant that may have met by chance
_SMALL = 6
#: nearest centres a set is compared with in a turn; all other meetings follow after the turns
_TRIES = 2
#: turns end when fewer than one in so many of their comparisons finds a copy
_YIELD = 20
#: buckets in which the shingles of a set are counted; see ``_remaining``
_BUCKETS = 64
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def fingerprint(text: str | None, words_per_shingle: int = 3) -> int:
    """Majority of the bits of the XXH64 of all shingles, as a signed 64-bit number.

    Only A-Z are lower-cased and words are separated by ASCII white space.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))
    k = min(words_per_shingle, len(words))
    starts, ends = starts[: len(words) - k + 1].tolist(), (ends[k - 1 :] - 1).tolist()
    h = xxhash.xxh64_intdigest
    total = np.zeros(64, np.int64)
    for at in range(0, len(starts), _CHUNK):
        part = [h(joined[a:b], SEED) for a, b in zip(starts[at : at + _CHUNK], ends[at : at + _CHUNK])]
        total += np.unpackbits(np.array(part, ">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(starts)).view(">i8")[0])


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fp", words_per_shingle: int = 3) -> DataFrame:
    """``docs`` with its fingerprint as a long."""
    small_batches(docs)

    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, words_per_shingle) for t in texts], dtype="int64")

    return docs.withColumn(out, fp(col(text)))


def _masks(radius: int) -> list[int]:
    """All bit patterns with at most ``radius`` of 64 bits, as signed numbers."""
    found = [sum(1 << b for b in bits) for r in range(radius + 1) for bits in itertools.combinations(range(64), r)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in found]


def links(distinct: DataFrame, max_bits: int = 2) -> DataFrame:
    """Pairs (a, b), a > b, that connect all fingerprints ``fp`` within ``max_bits``.

    ``max_bits`` must be even.  Fingerprints that meet are linked to the next one
    there; members of a ball of radius r are within 2 r of each other, so no link
    is lost to the chain, and every link is verified.
    """
    masks = F.array(*[F.lit(m).cast("long") for m in _masks(max_bits // 2)])
    meeting = Window.partitionBy("variant").orderBy("fp")
    return (
        distinct.select("fp", F.explode(masks).alias("mask"))
        .select(F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"), "fp")
        .select(F.col("fp").alias("a"), F.lag("fp").over(meeting).alias("b"))
        .where(F.col("b").isNotNull() & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits))
        .distinct()
    )


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One written star step over edges (a, b) with a > b: whoever is larger than a node
    (or the node and its smaller neighbours) hangs on the node's smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    # written, so that both sides of the join are plain shuffles and a hub can be split
    smallest = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "smallest")
    moved = both.join(smallest, "a").select("a", "b", "m")
    if large:
        out = moved.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            smallest.select("a", F.col("m").alias("b"))
        )
    stepped = materialize(out.where(F.col("a") > F.col("b")).distinct(), "stars")
    discard(smallest)
    return stepped


def _double_star(edges: DataFrame) -> DataFrame:
    large = _stars(edges, True)
    small = _stars(large, False)
    discard(large)
    return small


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for all nodes of the edges (a > b) that are no root.

    Ends when a round changes nothing, which a count and a hash sum tell; then
    every edge leads to the smallest node of its component.
    """
    mark = None
    edges = materialize(edges, "links")
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark or not now[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = now
        before, edges = edges, _double_star(edges)
        discard(before)


def clusters(rows: DataFrame, max_bits: int = 2) -> DataFrame:
    """(doc_id, fp) rows with ``component_id``; ``rows`` is read several times."""
    classes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "fingerprints")
    return _with_component(rows, classes, components(links(classes, max_bits)))


def _with_component(rows: DataFrame, classes: DataFrame, roots: DataFrame) -> DataFrame:
    """``rows`` (doc_id, fp) with the smallest doc_id of the component of their fp."""
    rooted = materialize(
        classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root")),
        "rooted",
    )
    lowest = materialize(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "lowest")
    ids = materialize(rooted.join(lowest, "root").select("fp", "component_id"), "components")
    return rows.join(ids, "fp")


def hex64(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def shingles(text: str | None, words_per_shingle: int) -> np.ndarray:
    """Distinct XXH64 of the shingles, sorted; words as in ``fingerprint``."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))
    k = min(words_per_shingle, len(words))
    starts, ends = starts[: len(words) - k + 1].tolist(), (ends[k - 1 :] - 1).tolist()
    h = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((h(joined[a:b], SEED) for a, b in zip(starts, ends)), np.uint64, len(starts)))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sets as ``shingles`` gives them; two empty ones are equal."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def short_fingerprints(documents: int, similarity: float) -> tuple[int, int]:
    """How many short fingerprints of how many bits, for a number of documents.

    Bits grow with the logarithm of the documents, so that a variant holds few
    documents by chance; fingerprints follow from the share of pairs at
    ``similarity`` that one of them lets meet (at most two bits differ).
    """
    bits = min(40, max(20, math.ceil(math.log2(max(documents, 2))) + 5))
    differs = math.acos(2 * similarity / (1 + similarity)) / math.pi
    meets = sum(math.comb(bits, k) * differs**k * (1 - differs) ** (bits - k) for k in range(3))
    tables = 1 if meets >= RECALL else math.ceil(math.log(1 - RECALL) / math.log(1 - meets))
    return tables, bits


def signature(found: np.ndarray, tables: int, bits: int) -> tuple[int, int, list[int]]:
    """A 128-bit fingerprint of a set of shingles and ``tables`` independent short ones."""
    width = -(-(128 + tables * bits) // 64)
    salts = np.arange(width, dtype=np.uint64) * _GOLDEN
    total = np.zeros(64 * width, np.int64)
    for at in range(0, len(found), 255):  # a sum of 255 bits fits a byte
        x = found[at : at + 255, None] + salts
        x[:, 1:] = (x[:, 1:] ^ (x[:, 1:] >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x[:, 1:] = (x[:, 1:] ^ (x[:, 1:] >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x[:, 1:] ^= x[:, 1:] >> np.uint64(31)
        total += np.unpackbits(x.astype(">u8").view(np.uint8), axis=1).sum(0, dtype=np.uint8)
    set_bits = 2 * total > len(found)
    short = set_bits[128 : 128 + tables * bits].reshape(tables, bits) @ (np.int64(1) << np.arange(bits, dtype=np.int64))
    return *np.packbits(set_bits[:128]).view(">i8").tolist(), short.tolist()


def set_name(found: np.ndarray) -> bytes:
    """128 bits that are equal for equal shingle sets."""
    return xxhash.xxh3_128_digest(found.tobytes(), SEED)


def _body(text: Column) -> Column:
    """128 bits that name a text; null counts as empty."""
    return F.substring(F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)), 1, 16)


def _sets(docs: DataFrame, text: Column, words_per_shingle: int, tables: int, bits: int) -> Column:
    small_batches(docs)

    @F.pandas_udf("name binary, size int, wide1 long, wide2 long, short array<long>")
    def sets(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            found = shingles(t, words_per_shingle)
            out.append((set_name(found), len(found), *signature(found, tables, bits)))
        return pd.DataFrame(out, columns=["name", "size", "wide1", "wide2", "short"])

    return sets(text)


def _apart(one: str, two: str) -> Column:
    """Bits in which the wide fingerprints of two prefixes differ."""
    return sum(F.bit_count(F.col(f"{one}wide{i}").bitwiseXOR(F.col(f"{two}wide{i}"))) for i in (1, 2))


def _farthest(similarity: float) -> int:
    """Bits in which wide fingerprints differ at most; see ``meetings``."""
    differs = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.ceil(128 * differs + 4.5 * math.sqrt(128 * differs * (1 - differs)))


def meetings(classes: DataFrame, similarity: float, bits: int) -> DataFrame:
    """(variant, id) where sets meet at a variant of a short fingerprint.

    Short fingerprints also meet by chance.  In a variant of up to ``_SMALL`` sets a
    set stays only if the 128 bits of its wide fingerprint agree with another one's;
    at ``similarity`` one pair in some 100,000 differs in more bits.  Larger
    variants, hardly ever chance, stay as they are.
    """
    farthest = _farthest(similarity)
    masks = F.array(*[F.lit(m).cast("long") for m in [0, *(1 << b for b in range(bits))]])
    same = ["id", "wide1", "wide2"]
    entries = (
        classes.where("size > 0").select(*same, F.posexplode("short").alias("at", "value"))
        .select(*same, (F.col("value") + F.col("at") * F.lit(1 << bits).cast("long")).alias("value"), F.explode(masks).alias("mask"))
        .select(F.col("value").bitwiseXOR(F.col("mask")).alias("variant"), *same)
    )
    meeting = Window.partitionBy("variant").orderBy("id")
    near = F.lit(False)
    for k in [k for k in range(1 - _SMALL, _SMALL) if k]:
        bits_apart = sum(F.bit_count(F.col(w).bitwiseXOR(F.lag(w, k).over(meeting))) for w in ("wide1", "wide2"))
        near = near | F.coalesce(bits_apart <= farthest, F.lit(False))
    large = F.count("*").over(Window.partitionBy("variant")) > _SMALL
    return entries.withColumn("stays", large | near).where("stays").select("variant", "id")


def _centres(live: DataFrame, turn: int) -> DataFrame:
    """The members (variant, id, mass, root) of variants where components still meet,
    beside the variant's centre (c_id, c_root, c_mass, ...).

    The first centre of a variant is its set with the largest mass, that of a crowd
    around it; later ones are drawn by a hash.
    """
    drawn = F.col("mass") if turn == 0 else F.xxhash64(F.lit(turn), "id")
    of_centre = ["id", "root", "mass", "size", "wide1", "wide2"]
    centres = (
        live.groupBy("variant").agg(
            F.min("root").alias("low"), F.max("root").alias("high"), F.max(F.struct(drawn.alias("drawn"), *of_centre)).alias("c")
        ).where("low <> high").select("variant", *[F.col(f"c.{c}").alias(f"c_{c}") for c in of_centre])
    )
    return live.join(centres, "variant")


def _speakers(members: DataFrame) -> DataFrame:
    """Two members for each component of a variant, the heaviest and one drawn by a hash
    of variant and set.  A set meets another component at many variants, where others speak."""
    own = ["mass", "id", "size", "wide1", "wide2"]
    heavy = F.max(F.struct(*own))
    drawn = F.max(F.struct(F.xxhash64("variant", "id").alias("drawn"), *own))
    two = members.groupBy("variant", "root").agg(heavy.alias("h"), drawn.alias("d")).select(
        "variant", "root", F.array_distinct(F.array(*[F.struct(*[f"{x}.{c}" for c in own]) for x in ("h", "d")])).alias("two")
    )
    return two.select("variant", "root", F.inline("two"))


def _chosen(members: DataFrame, tried: list[DataFrame], similarity: float, turn: int) -> DataFrame:
    """(a, b), a > b: for each set the few centres to compare it with in this turn, the
    nearest ones and, in the first turn, also the heaviest.  Sizes that rule the similarity
    out, and pairs that were tried, are left out.  No pair is lost: see ``_remaining``."""
    ends = [F.greatest("id", "centre").alias("a"), F.least("id", "centre").alias("b")]
    fits = F.least("size", "c_size") >= F.greatest("size", "c_size") * (similarity - 1e-9)
    placed = members.where((F.col("root") != F.col("c_root")) & fits).select("id", F.col("c_id").alias("centre"), "c_mass", _apart("", "c_").alias("apart"))
    near = F.transform(F.slice(F.sort_array(F.collect_set(F.struct("apart", "centre"))), 1, _TRIES), lambda x: x["centre"])
    if turn == 0:
        near = F.array_distinct(F.concat(near, F.array(F.max_by("centre", F.struct("c_mass", "centre")))))
    pairs = placed.groupBy("id").agg(near.alias("best")).select("id", F.explode("best").alias("centre")).select(*ends).distinct()
    for before in tried:
        pairs = pairs.join(before.select("a", "b"), ["a", "b"], "left_anti")
    return pairs


def _able(info: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The sets that may have the similarity to another of ``sets``, with the number of
    their shingles that another one has, too.

    A shingle that no other of these sets has is in no intersection, so two sets have
    at most as many shingles in common as the smaller number of shared ones.  That
    rules out, exactly, sets that met by chance and the outermost members of a crowd.
    """
    alone = (
        sets.select("id", F.explode("set").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("n"), F.min("id").alias("id"))
        .where("n = 1").groupBy("id").agg(F.count("*").alias("alone"))
    )
    shared = F.col("size") - F.coalesce("alone", F.lit(0))
    return info.join(alone, "id", "left").withColumn("shared", shared).drop("alone").where(F.col("shared") >= F.col("size") * (similarity - 1e-9))


def _remaining(met: DataFrame, info: DataFrame, sets: DataFrame, roots: DataFrame | None, similarity: float, bits: int) -> DataFrame:
    """(a, b), a > b: all pairs that meet at a variant, are of different components and
    may have the similarity, by the numbers of shared shingles (``_able``) and, where
    ``info`` has them, by ``counts``: two sets have at most as many shingles in
    common as the smaller counts of all buckets add up to, hardly more than they do have.

    One of a pair is not of the component that most members of the variant are of;
    only such members are met with all others there.
    A pair near by the wide fingerprints comes from just one of its variants, which
    are those of all pairs so near; others come from each and are made distinct.
    """
    if "shared" not in info.columns:
        info = _able(info, sets, similarity)
    if roots is None:
        info = info.withColumn("root", F.col("id"))
    else:
        info = info.join(roots.select(F.col("node").alias("id"), F.col("root").alias("r")), "id", "left").withColumn("root", F.coalesce("r", "id"))
    own = ["id", "root", "size", "shared", "wide1", "wide2", "short", *(["counts"] if "counts" in info.columns else [])]
    info = materialize(info.select(*own), "sets-of-components")
    placed = materialize(met.join(info.select("id", "root"), "id"), "meetings-of-components")
    most = F.max_by("root", F.struct("n", "root")).alias("main")
    several = (
        placed.groupBy("variant", "root").agg(F.count("*").alias("n")).groupBy("variant").agg(most, F.count("*").alias("roots"))
        .where("roots > 1").select("variant", "main")
    )
    few = materialize(placed.join(several, "variant").where("root <> main").select("variant", "id"), "outside-the-main")
    one, two = (df.join(info, "id").select("variant", *[F.col(c).alias(f"{x}_{c}") for c in own]) for x, df in (("a", few), ("b", met)))
    enough = similarity - 1e-9
    needed = (F.col("a_size") + F.col("b_size")) * enough
    far = _apart("a_", "b_") > _farthest(similarity)
    may = (F.col("a_root") != F.col("b_root")) & (F.least("a_shared", "b_shared") * (1 + enough) >= needed) & (far | _first_meeting(bits))
    if "counts" in own:
        in_buckets = F.aggregate(F.zip_with("a_counts", "b_counts", lambda x, y: F.least(x, y)), F.lit(0), lambda n, x: n + x)
        may = may & (in_buckets * (1 + enough) >= needed)
    ends = [F.greatest("a_id", "b_id").alias("a"), F.least("a_id", "b_id").alias("b")]
    pairs = materialize(one.join(two, "variant").where(may).select(*ends).distinct(), "pairs-left")
    discard(info, placed, few)
    return pairs


def _counts(found: np.ndarray) -> np.ndarray:
    """How many shingles of a set fall into each bucket."""
    return np.bincount((found % np.uint64(_BUCKETS)).astype(np.int64), minlength=_BUCKETS).astype(np.int32)


def _first_meeting(bits: int) -> Column:
    """Whether ``variant`` is the one to name a pair of sets: of the first short
    fingerprint at which they meet, the smaller of the variants between them."""
    gaps = F.zip_with("a_short", "b_short", lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    at = F.array_position(F.transform(gaps, lambda x: x <= 2), True).cast("int")
    a, b = F.element_at("a_short", at), F.element_at("b_short", at)
    lowest = a.bitwiseXOR(b).bitwiseAND(-a.bitwiseXOR(b))  # lowest bit in which they differ, if any
    between = F.least(a.bitwiseXOR(lowest), b.bitwiseXOR(lowest))
    return F.col("variant") == between + (at - 1) * F.lit(1 << bits).cast("long")


def copies(docs: DataFrame, words_per_shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, text) rows as (doc_id, body, root, component_id).

    Sets that meet at variants are compared in turns.  In each, a set is compared
    with a few centres of its variants, so a turn's pairs are in
    proportion to the sets, whatever the size of a crowd; variants within one
    component leave.  Sets that share too few shingles with all others for the
    similarity leave before, exactly.  The first centres are the sets with the largest mass (the
    members of all their variants, counted): the text a crowd of copies was made
    from, as its copies lie around it.  After that two members speak for each component
    of a variant; centres are drawn anew for every variant, and a set tries the nearest.  Turns end when
    one finds hardly anything alike.
    After a turn a large and a small star step shorten the links, which is enough to
    see that most variants hold one component; after the turns they are followed to the last.
    Turns only spare comparisons: in the end all members of a variant that are still of
    different components are compared with each other, unless counts of their shingles
    rule the similarity out (``_remaining``), so no link of sets that meet is lost.
    Similarity is exact: shingle sets are made once of every text that met another,
    and intersected.
    """
    tables, bits = short_fingerprints(docs.count(), similarity)
    found = _sets(docs, F.col("text"), words_per_shingle, tables, bits)
    rows = materialize(docs.select("doc_id", _body(F.col("text")).alias("body"), found.alias("s")).select("doc_id", "body", "s.*"), "document-sets")
    same = [F.first(c).alias(c) for c in ("size", "wide1", "wide2", "short")]
    classes = materialize(
        rows.groupBy("name").agg(F.min("doc_id").alias("first_id"), F.min("body").alias("body"), *same)
        .withColumn("id", F.monotonically_increasing_id()), "shingle-sets"
    )
    met = materialize(meetings(classes, similarity, bits), "meetings")
    crowd = materialize(met.groupBy("variant").agg(F.count("*").alias("n")), "variant-sizes")
    mass = materialize(met.join(crowd, "variant").groupBy("id").agg(F.sum("n").alias("mass")), "masses")
    discard(crowd)
    wanted = classes.select("id", "body").join(mass.select("id"), "id", "left_semi")
    texts = (
        docs.select(_body(F.col("text")).alias("body"), "text").join(wanted.select("body"), "body", "left_semi")
        .groupBy("body").agg(F.min("text").alias("text"))
    )
    small_batches(docs)

    @F.pandas_udf("set array<long>, counts array<int>")
    def hashes(texts: pd.Series) -> pd.DataFrame:
        found = [shingles(t, words_per_shingle) for t in texts]
        return pd.DataFrame({"set": [x.view(np.int64) for x in found], "counts": [_counts(x) for x in found]})

    all_sets = materialize(wanted.join(texts, "body").select("id", hashes("text").alias("s")).select("id", "s.*"), "candidate-sets")
    own = ["id", "size", "mass", "wide1", "wide2", "short"]
    able = _able(classes.join(mass, "id").select(*own), all_sets, similarity)
    info = materialize(able.join(all_sets.select("id", "counts"), "id"), "candidates")
    sets = materialize(all_sets.select("id", "set").join(info.select("id"), "id", "left_semi"), "sets")
    discard(mass, all_sets)

    def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        for side in ("a", "b"):
            pairs = pairs.join(sets.select(F.col("id").alias(side), F.col("set").alias(f"set_{side}")), side)
        both = F.size(F.array_intersect("set_a", "set_b"))
        alike = both / (F.size("set_a") + F.size("set_b") - both) >= similarity
        return materialize(pairs.select("a", "b", alike.alias("alike")), "compared")

    live, tried, edges, turn = met.join(info.drop("short", "shared", "counts"), "id").withColumn("root", F.col("id")), [], None, 0
    while True:
        members = materialize(_centres(live, turn), "open-variants")
        new = compared(_chosen(members, tried, similarity, turn), sets)
        tried, found = [*tried, new], new.where("alike").select("a", "b")
        asked, copied = new.count(), found.count()
        if copied:
            before, edges = edges, _double_star(found if edges is None else edges.unionByName(found))
            discard(*([] if before is None else [before]))
        if copied * _YIELD < asked or not asked:
            break
        roots = edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("new"))
        own = materialize(roots, "joined")
        here = members.join(own, "id", "left").select(
            "variant", "id", "mass", "size", "wide1", "wide2", F.coalesce("new", "root").alias("root")
        )
        before, live, turn = live, materialize(_speakers(here), "speakers"), turn + 1
        discard(members, before)
    discard(members, live, *tried)
    roots = None if edges is None else components(edges)
    rest = _remaining(met, info, sets, roots, similarity, bits)
    asked = rest.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    missed = compared(rest, materialize(sets.join(asked, "id", "left_semi"), "sets-compared")).where("alike").select("a", "b")
    if missed.limit(1).count():
        known = missed if roots is None else missed.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
        roots = components(known)
    discard(met, info, sets)
    rooted = classes.select("name", "id", "first_id")
    if roots is None:
        rooted = rooted.withColumn("root", F.col("id"))
    else:
        rooted = rooted.join(roots, F.col("id") == F.col("node"), "left").withColumn("root", F.coalesce("root", "id"))
    rooted = materialize(rooted.select("name", "root", "first_id"), "rooted")
    lowest = materialize(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "lowest")
    ids = materialize(rooted.join(lowest, "root").select("name", "root", "component_id"), "components")
    return rows.select("doc_id", "body", "name").join(ids, "name").drop("name")


def one_per_component(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words_per_shingle: int = 5, similarity: float = 0.8
) -> DataFrame:
    """One document of each component: the one with the smallest doc_id (documents
    without come last), of several texts with that id the one whose digest is
    smallest, and of rows repeated with both the one whose columns hash lowest.

    Shingle sets are named and fingerprinted once and written; the texts are then
    read again and joined with the ids to keep, whose shuffle carries no texts.
    """
    rows = copies(docs.select(col(doc_id).alias("doc_id"), col(text).alias("text")), words_per_shingle, similarity)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "body")).alias("first")
    keep, own, row = fresh(docs, "_keep", "_own", "_row")
    kept = rows.groupBy("root").agg(first).select(F.struct("first.doc_id", "first.body").alias(keep))
    # one key for the join and the grouping (a null inside equals a null): texts are moved once
    named = docs.withColumn(own, F.struct(col(doc_id).alias("doc_id"), _body(col(text)).alias("body")))
    columns = [col(c) for c in docs.columns]
    once = (
        named.join(kept, col(own) == col(keep), "left_semi")
        .groupBy(col(own)).agg(F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias(row))
    )
    return once.select(*[col(row).getField(c).alias(c) for c in docs.columns])


@query("op4_simhash_near_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = materialize(fingerprints(docs).select("doc_id", "fp"), "document-fingerprints")
    return clusters(rows).select("doc_id", hex64(F.col("fp")).alias("fingerprint"), "component_id")
