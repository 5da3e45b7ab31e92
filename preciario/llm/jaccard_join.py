"""Exact Jaccard join of documents on word n-grams by a partition of the token universe.

Tokens (hashed shingles) are dealt by a hash over the segments of a size band.
Two sets that link differ in at most H tokens, so of H + 1 + s segments at least
1 + s are equal: pigeonhole.  Equal segments are found by their signatures, and
only pairs that share one are verified, on the whole sets.

* **Allocation.**  Each segment of a band has a value: 0, its signature is
  indexed; 1, the signatures of its one-deletion neighbourhood as well, which finds
  segments that differ in one token and counts for two; -1, it is left out.  The values
  add up to at least H + 1 + ``SPARE_EMPTY``.  A first count of all signatures gives the cost of every
  segment (members of its buckets): segments far above the rest are left out, first as far as spare segments
  go, then each against a one-deletion segment among the cheapest, if that saves at least ``WORTH`` of all members, for
  it takes another pass over the texts.
* **Empty segments** are equal for no good reason; a set with at most ``SPARE_EMPTY`` of them need
  not index those of value 0; one of value 1 counts for two and is always indexed.
* **Equal sets** are one class from the start, so copies never meet in pairs.
* **Stars, then differences.**  Members of a bucket are verified against its most central class (the one
  that shares the most signatures with others) and links are closed into components.  Where a star still
  holds several components, its members are described by their differences from the centre: two members that
  link, one of them unlinked to the centre, must share a rare difference (a prefix filter, rarest first).  So a
  group of near copies costs about a pair for each member, not one for each two, also if they don't link.

One pass in Python makes sets, signatures and compressed texts; they are written, and what follows reads them.

Classes are named by 64-bit hashes of their sorted sets, shingles by 64-bit hashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from preciario.llm.components import connected
from preciario.llm.shared import ddl, discard, free_shuffles, written

#: Sets link from this share on, in hundredths.
SHARE = 90
WORDS = 3
BAND_RATIO = 1.35
SPARE_EMPTY = 2
#: A segment this many times as costly as its band's median is left out.
COSTLY = 16
#: Share of all members that one-deletion segments must save.
WORTH = 0.5
#: Bits of a signature that name its segment.
CODE_BITS = 20

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
#: A word's hash is the sum of its bytes' random numbers, one for each place up to ``PLACES``; longer words go on
#: with the numbers multiplied by an odd constant.
PLACES = 64
_NUMBERS = np.random.default_rng(20240101).integers(0, 2**64, (PLACES, 256), dtype=np.uint64).ravel()
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _A
    x = (x ^ (x >> np.uint64(29))) * _B
    return x ^ (x >> np.uint64(32))


def word_hashes(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode("utf-8", "replace").translate(_LOWER), np.uint8)
    inside = ~_SPACE[data]
    edges = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    letters = data[inside].astype(np.int64)
    first = np.cumsum(lengths) - lengths
    place = np.arange(len(letters)) - np.repeat(first, lengths)
    values = _NUMBERS[(place % PLACES) * 256 + letters]
    if lengths.max() > PLACES:
        far = np.flatnonzero(place >= PLACES)
        powers = np.full(int(place.max()) // PLACES + 1, _B)
        powers[0] = 1
        values[far] *= np.cumprod(powers)[place[far] // PLACES]
    return mixed(np.add.reduceat(values, first) + lengths.astype(np.uint64))


def shingles(text: str | None, n_words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; of the whole sequence if it has fewer words."""
    one = word_hashes(text or "")
    if not len(one):
        return one
    n = min(n_words, len(one))
    out = np.full(len(one) - n + 1, np.uint64(n))
    for i in range(n):
        out = mixed(out * _C + one[i : len(one) - n + 1 + i])
    return np.unique(out)


def signed(x: np.ndarray | int) -> np.ndarray | int:
    return x.view(np.int64) if isinstance(x, np.ndarray) else x - (1 << 64) if x >= 1 << 63 else x


def class_of(tokens: np.ndarray) -> int:
    return signed(xxhash.xxh3_64_intdigest(tokens.tobytes()))


def links(a: np.ndarray, b: np.ndarray, share: int = SHARE) -> bool:
    small, large = min(len(a), len(b)), max(len(a), len(b))
    if not small or 100 * small < share * large:
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= share * (len(a) + len(b) - common)


class Bands:
    """Size bands and their segments.  Band k holds sizes from ``lows[k]`` up to the next; its scheme
    serves pairs whose smaller set lies in the band, so a set uses its own band's scheme and, if a
    partner could be in the band below, that one's."""

    def __init__(self, share: int = SHARE, ratio: float = BAND_RATIO):
        self.share, self.ratio = share, max(ratio, 100 / share)
        self.lows = [1]

    def grown(self, size: int) -> None:
        while self.lows[-1] <= size:
            self.lows.append(max(self.lows[-1] + 1, int(self.lows[-1] * self.ratio)))

    def schemes(self, size: int) -> list[int]:
        self.grown(size)
        k = int(np.searchsorted(self.lows, size, "right")) - 1
        below = k > 0 and 100 * (self.lows[k] - 1) >= self.share * size
        return [k, k - 1] if below else [k]

    def differing(self, k: int) -> int:
        """H: the most tokens in which two linked sets of the scheme differ.

        |A| + |B| - 2 |A and B| with |A and B| >= share / (100 + share) * (|A| + |B|)."""
        while len(self.lows) < k + 2:
            self.grown(self.lows[-1])
        small = self.lows[k + 1] - 1
        large = small * 100 // self.share
        return (small + large) * (100 - self.share) // (100 + self.share)

    def segments(self, k: int) -> int:
        h = self.differing(k)
        return h + 1 + SPARE_EMPTY + h // 32


def allocate(costs: dict[tuple[int, int], float], bands: Bands, deletions: bool = True) -> dict[int, np.ndarray]:
    """For each scheme with costs, the segments' values (-1, 0, 1); see the module's docstring.  Without ``deletions`` only
    spare segments are left out."""
    by_scheme: dict[int, dict[int, float]] = {}
    for (k, i), cost in costs.items():
        by_scheme.setdefault(k, {})[i] = cost
    out = {}
    for k, own in by_scheme.items():
        m = bands.segments(k)
        cost = np.array([own.get(i, 0.0) for i in range(m)])
        values = np.zeros(m, np.int8)
        spare = m - (bands.differing(k) + 1 + SPARE_EMPTY)
        order = np.argsort(-cost, kind="stable")
        cheap = m - 1
        for at, i in enumerate(order.tolist()):
            if at >= cheap or not deletions and at >= spare:
                break
            if cost[i] <= COSTLY * (np.median(cost) + 1):
                break
            values[i] = -1
            if at >= spare:
                values[order[cheap]] = 1
                cheap -= 1
        out[k] = values
    return out


def worthwhile(costs: dict[tuple[int, int], float], bands: Bands) -> dict[int, np.ndarray]:
    """The allocation, without one-deletion segments where those left out for them hold less than ``WORTH`` of all members."""
    values = allocate(costs, bands)
    spare = allocate(costs, bands, deletions=False)
    saved = sum(cost for (k, i), cost in costs.items() if values[k][i] < 0 <= spare[k][i])
    return values if saved >= WORTH * sum(costs.values()) > 0 else spare


def signatures(tokens: np.ndarray, bands: Bands, values: dict[int, np.ndarray] | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(scheme, segment numbers, signatures) of one set, for each scheme it uses."""
    spread = mixed(tokens ^ _C)
    for k in bands.schemes(len(tokens)):
        m = bands.segments(k)
        if bands.differing(k) == 0:
            continue  # only equal sets link
        segment = ((spread >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
        order = np.argsort(segment, kind="stable")
        segment, part = segment[order].astype(np.int64), mixed(tokens[order] + _A)
        starts = np.flatnonzero(np.diff(segment, prepend=-1))
        sums, used = np.add.reduceat(part, starts), segment[starts]
        numbers, found = [used], [sums]
        own = None if values is None else values.get(k)
        empty = np.setdiff1d(np.arange(m), used)
        if len(empty) <= SPARE_EMPTY:
            empty = empty[:0] if own is None else empty[own[empty] == 1]
        numbers.append(empty)
        found.append(np.zeros(len(empty), np.uint64))
        if own is not None:
            ones = own[segment] == 1
            numbers.append(segment[ones])
            found.append(np.repeat(sums, np.diff(starts, append=len(segment)))[ones] - part[ones])
        number, signature = np.concatenate(numbers), np.concatenate(found)
        if own is not None:
            keep = own[number] >= 0
            number, signature = number[keep], signature[keep]
        salt = mixed((np.uint64(k) << np.uint64(32)) + number.astype(np.uint64))
        yield k, number, mixed(signature * _C + salt)


def segment_code(k: int, number: np.ndarray) -> np.ndarray:
    """A segment of a scheme in ``CODE_BITS``; two that share one only add up their costs."""
    return mixed((np.uint64(k) << np.uint64(32)) + number.astype(np.uint64)) >> np.uint64(64 - CODE_BITS)


def sets(docs: DataFrame, values: dict[int, np.ndarray] | None, key: str, text: str, share: int, n_words: int) -> DataFrame:
    """Of every row: key, n_shingles, class (null for an empty set); and once per task and class its signatures (with their
    segment's code in front) and, if no ``values`` are given, its compressed text, null otherwise."""
    schema = docs.select(key).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, seen = Bands(share), set()
        for batch in batches:
            n, names, blobs, keys = [], [], [], []
            for x in batch.column(1).to_pylist():
                tokens = shingles(x, n_words)
                name = class_of(tokens) if len(tokens) else None
                n.append(len(tokens))
                names.append(name)
                if name is None or name in seen:
                    blobs.append(None)
                    keys.append(None)
                    continue
                if len(seen) < 1_000_000:  # beyond, copies in one task are only repeated rows
                    seen.add(name)
                found = [(segment_code(k, number) << np.uint64(64 - CODE_BITS)) + (sign >> np.uint64(CODE_BITS)) for k, number, sign in signatures(tokens, bands, values)]
                blobs.append(zlib.compress(x.encode("utf-8", "replace"), 1) if values is None else None)
                keys.append(signed(np.concatenate(found)) if found else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(names, pa.int64()), pa.array(blobs, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                [key, "n_shingles", "class", "blob", "keys"],
            )

    return docs.select(key, text).mapInArrow(run, f"{ddl(schema)}, n_shingles long, class long, blob binary, keys array<long>")


def bucket_members(rows: DataFrame) -> DataFrame:
    """key, class and n (rows) of the signatures of at least two classes: one exchange of the signatures finds and counts them."""
    signs = rows.where(F.col("keys").isNotNull()).select("class", F.explode("keys").alias("key"))
    same = Window.partitionBy("key")
    counted = signs.select("key", "class", F.min("class").over(same).alias("low"), F.max("class").over(same).alias("high"), F.count(F.lit(1)).over(same).alias("n"))
    return counted.where(F.col("low") < F.col("high")).select("key", "class", "n")


def segment_costs(members: DataFrame, bands: Bands, most: int) -> dict[tuple[int, int], float]:
    """What the buckets of each segment cost: their members, which are verified in stars; ``most`` is the size of the largest set.

    An entry per segment of the largest set's bands at most, however many rows there are.
    """
    summed = members.groupBy(F.shiftrightunsigned("key", 64 - CODE_BITS).alias("code")).agg(F.count(F.lit(1)).cast("double").alias("cost"))
    costs = {r.code: r.cost for r in summed.toLocalIterator()}
    out = {}
    bands.grown(most)
    for k in range(len(bands.lows) - 1):
        numbers = np.arange(bands.segments(k))
        out |= {(k, int(i)): costs[c] for i, c in zip(numbers, segment_code(k, numbers).tolist(), strict=True) if c in costs}
    return out


def with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b, ...) with both compressed texts in front, those of one b together."""
    left = texts.select(F.col("class").alias("a"), F.col("blob").alias("first"))
    right = texts.select(F.col("class").alias("b"), F.col("blob").alias("second"))
    others = [c for c in pairs.columns if c not in ("a", "b")]
    return pairs.join(left, "a").join(right, "b").select("first", "second", "a", "b", *others)


def _compared(batch: pa.RecordBatch, n_words: int, last: list) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Row, set of a and set of b; ``last`` keeps the latest b between batches."""
    first, second, b = (batch.column(i).to_pylist() for i in (0, 1, 3))
    for i in range(len(b)):
        if not last or last[0] != b[i]:
            last[:] = [b[i], shingles(zlib.decompress(second[i]).decode(), n_words)]
        yield i, shingles(zlib.decompress(first[i]).decode(), n_words), last[1]


def verified(pairs: DataFrame, texts: DataFrame, share: int, n_words: int) -> DataFrame:
    """The pairs (a, b) that link, decided on the whole sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list = []
        for batch in batches:
            take = pa.array([i for i, x, y in _compared(batch, n_words, last) if links(x, y, share)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(2).take(take), batch.column(3).take(take)], ["a", "b"])

    return with_texts(pairs.select("a", "b"), texts).mapInArrow(run, "a long, b long")


def differences(stars: DataFrame, texts: DataFrame, share: int, n_words: int) -> DataFrame:
    """b, a, label, d (number of differences of a from b), most (that a and a partner of it may have) and each
    differing token.  ``stars`` has a, b and a's label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list = []
        for batch in batches:
            rows, d, most, tokens = [], [], [], []
            for i, x, y in _compared(batch, n_words, last):
                differing = np.setxor1d(x, y, assume_unique=True)
                rows.append(np.full(len(differing), i))
                d.append(np.full(len(differing), len(differing)))
                most.append(np.full(len(differing), (len(x) + len(x) * 100 // share) * (100 - share) // (100 + share)))
                tokens.append(signed(differing))
            if rows:
                take = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(3).take(take), batch.column(2).take(take), batch.column(4).take(take), *(pa.array(np.concatenate(c).astype(np.int64)) for c in (d, most, tokens))],
                    ["b", "a", "label", "d", "most", "token"],
                )

    return with_texts(stars.select("a", "b", "label"), texts).mapInArrow(run, "b long, a long, label long, d long, most long, token long")


def difference_pairs(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components that may link: |A xor B| is the differences they do not share, so of
    ``d(a) + d(b)`` at least ``(d(a) + d(b) - most) / 2`` are shared; with tokens in one order, rarest first, a shared one
    is among the first ``most / 2 + 1`` of the member with fewer differences and the first ``most + 1`` of the other.
    Differences that one member has alone come first of all and are only counted."""
    tokens = rows.select("b", "a", "token")
    shared = tokens.groupBy("b", "token").agg(F.count(F.lit(1)).alias("f")).where(F.col("f") > 1)
    member = Window.partitionBy("b", "a")
    placed = tokens.join(shared, ["b", "token"]).select(
        "b", "a", "token", F.row_number().over(member.orderBy("f", "token")).alias("place"), F.count(F.lit(1)).over(member).alias("n")
    )
    members = rows.select("b", "a", "label", "d", "most").distinct()
    ranked = placed.join(members, ["b", "a"]).withColumn("rank", F.col("place") + F.col("d") - F.col("n")).where(F.col("rank") <= F.col("most") + 1)
    few = ranked.where(F.col("rank") <= F.floor(F.col("most") / 2) + 1).select("b", "token", F.col("a").alias("x"), F.col("d").alias("dx"), F.col("label").alias("lx"))
    many = ranked.select("b", "token", F.col("a").alias("y"), F.col("d").alias("dy"), F.col("label").alias("ly"), "most")
    met = few.join(many, ["b", "token"]).where(
        (F.col("lx") != F.col("ly")) & ((F.col("dx") < F.col("dy")) | ((F.col("dx") == F.col("dy")) & (F.col("x") < F.col("y")))) & (F.col("dy") - F.col("dx") <= F.col("most"))
    )
    return met.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()


def join(docs: DataFrame, share: int = SHARE, n_words: int = WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles and component_id of every row.

    component_id is the smallest key that links reach.  A null, empty or blank text has no shingles and links with
    nothing; repeated rows are in one component; a row without a key takes the component of its text, null if
    no row with a key is in it.  Other columns are not read.
    """
    rows = written(sets(docs, None, key, text, share, n_words), "sets")
    narrow, edges = linked(docs, rows, share, n_words, key, text)
    rows, labels = narrow, connected(edges)
    discard(edges)
    named = rows.where(F.col("class").isNotNull()).groupBy("class").agg(F.min(key).alias("low"))
    grouped = named.join(labels, F.col("class") == F.col("node"), "left").withColumn("label", F.coalesce("label", "class"))
    smallest = grouped.groupBy("label").agg(F.min("low").alias("component_id"))
    component = grouped.join(smallest, "label").select("class", "component_id")
    placed = rows.select(key, "n_shingles", "class").join(component, "class", "left")
    return placed.select(key, "n_shingles", F.when(F.col("class").isNull(), F.col(key)).otherwise(F.col("component_id")).alias("component_id"))


def representatives(docs: DataFrame, share: int = SHARE, n_words: int = WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay if one document of each component does: that of the smallest key.

    Texts without words, and rows without a key, all stay; rows that repeat a key are one document, whichever of them comes first
    by its text and then by its other columns.
    """
    kept = join(docs, share, n_words, key, text).where((F.col(key) == F.col("component_id")) | (F.col("n_shingles") == 0))
    kept = kept.where(F.col(key).isNotNull()).select(key).distinct()
    rows = docs.where(F.col(key).isNotNull()).join(kept.hint("merge"), key, "left_semi")
    first = F.row_number().over(Window.partitionBy(key).orderBy(F.asc_nulls_first(text), F.xxhash64(*docs.columns)))
    return rows.withColumn("__first", first).where(F.col("__first") == 1).drop("__first").unionByName(docs.where(F.col(key).isNull()))


def linked(docs: DataFrame, rows: DataFrame, share: int, n_words: int, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """The rows' key, n_shingles and class, and links (a, b) between classes: every link of the join is among them or inside a
    component that they span.

    ``rows`` are the written ``sets`` of ``docs``; they and every table between are deleted once their last reader has run.
    """
    bands = Bands(share)
    members = written(bucket_members(rows), "members")
    values = worthwhile(segment_costs(members, bands, rows.agg(F.max("n_shingles")).first()[0] or 0), bands)
    free_shuffles(docs.sparkSession)
    if any((v == 1).any() for v in values.values()):  # one-deletion neighbourhoods are made only where they are wanted
        again = written(sets(docs, values, key, text, share, n_words), "signatures")
        before, members = members, written(bucket_members(again), "members")
        discard(before, again)
    left_out = np.unique(np.concatenate([np.zeros(0, np.uint64), *(segment_code(k, np.flatnonzero(v < 0)) for k, v in values.items() if (v < 0).any())]))
    kept = {c for k, v in values.items() for c in segment_code(k, np.flatnonzero(v >= 0)).tolist()}
    dropped = [(int(c),) for c in left_out if int(c) not in kept]  # a code that a kept segment shares stays
    wanted = members.distinct()
    if dropped:
        codes = docs.sparkSession.createDataFrame(dropped, "code long")
        wanted = wanted.withColumn("code", F.shiftrightunsigned("key", 64 - CODE_BITS)).join(codes, "code", "left_anti").drop("code")
    before, members = members, written(wanted, "members")
    discard(before)
    texts = rows.where(F.col("blob").isNotNull()).select("class", "blob")
    narrow = written(rows.select(key, "n_shingles", "class"), "classes")
    central = members.groupBy("class").agg(F.sum("n").alias("score"))
    centres = members.join(central, "class").groupBy("key").agg(F.max(F.struct("score", "class")).alias("c")).select("key", F.col("c.class").alias("b"))
    stars = members.select("key", F.col("class").alias("a")).join(centres, "key").where(F.col("a") != F.col("b"))
    stars = written(stars.select("a", "b").distinct(), "stars")
    discard(members)
    free_shuffles(docs.sparkSession)
    classes = stars.select("a").union(stars.select("b")).distinct().withColumnRenamed("a", "class")
    # the wanted classes grow with the input, so they are never broadcast
    texts = written(texts.join(classes.hint("merge"), "class", "left_semi").dropDuplicates(["class"]), "texts")
    discard(rows)
    free_shuffles(docs.sparkSession)
    edges = written(verified(stars, texts, share, n_words), "links")
    labels = connected(edges)
    placed = stars.join(labels.withColumnRenamed("node", "a"), "a", "left").withColumn("label", F.coalesce("label", "a"))
    placed = placed.join(labels.select(F.col("node").alias("b"), F.col("label").alias("own")), "b", "left").withColumn("own", F.coalesce("own", "b"))
    # stars with one unlinked member have no pair left to look at
    loose = placed.groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") != F.col("own")).alias("m")).where((F.col("m") > 0) & (F.col("n") > 1))
    apart = written(differences(placed.join(loose.select("b"), "b", "left_semi"), texts, share, n_words), "differences")
    free_shuffles(docs.sparkSession)
    rest = difference_pairs(apart)
    rest = rest.join(stars.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), ["a", "b"], "left_anti")
    more = written(verified(rest, texts, share, n_words), "links")
    out = written(edges.unionByName(more), "links")
    discard(apart, texts, stars, edges, more)
    return narrow, out
