"""Near-duplicate groups by MinHash signatures and a multi-index Hamming join.

Words are what lies between bytes 20 and 09-0D, A-Z lower-cased. A document's
set is its distinct shingles of five words, or its whole sequence if it has
fewer words. Documents whose sets have a Jaccard similarity of 0.75 or more
are linked; groups are the connected components of the links.

Method. Texts that are byte for byte equal are one class. A class has a
signature of CHUNKS * PER_CHUNK MinHash values of BITS bits. By the pigeonhole
principle, signatures that differ in at most DISTANCE = CHUNKS * (ERRORS + 1) - 1
values agree in some chunk but for ERRORS values; so for each chunk and each
choice of ERRORS values to leave out, the rest is a key, and every pair under
the distance meets in a key. At similarity 0.75 a value differs with
probability 1/4, and a pair exceeds the distance with probability 3e-6.

Pairs of a key's members aren't all emitted. First every class is compared
with the most central class that it meets in any key (the one whose keys are
shared most often), and what is confirmed is merged into components. Then only
pairs that meet and lie in different components are compared, since the others
change no group, and of these only such as can be similar, by two bounds that
hold for certain. A shingle that no other candidate has is in no intersection.
And the parities of the numbers of shingles that fall to each of SKETCH_BITS
places differ in no more places than the sets differ in shingles, which for
similar sets are at most a seventh of their sizes together. Members of a hot key
meet only where they share one of their rarest shingles, as similar sets do, so
work doesn't grow with the square of a key. Where classes meet, each is first
compared with the nearest possible one before it alone, by these parities; that
merges what is linked many times over, and hands on no more pairs than classes.
What then still lies apart is compared pair by pair: by the bounds, by
signatures, and last by the full sets. So no link between signatures within the
distance is lost; that is every link but for the probability above.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.bitmap import hash_counters, repeated_hashes
from loomgraph.llm.common import bound_batches, discard, keeping_columns, materialize, plain_columns, plan_bytes, read_table
from loomgraph.llm.graph import components
from loomgraph.llm.spans import Words, grams, mix

SHINGLE = 5
CHUNKS, PER_CHUNK, ERRORS, BITS = 8, 5, 2, 24
VALUES = CHUNKS * PER_CHUNK
DISTANCE = CHUNKS * (ERRORS + 1) - 1
#: Similarity as hundredths.
SIMILAR = 75

#: Candidate classes up to which their keys are broadcast to fetch the texts (about 40 bytes each); beyond, the join shuffles.
BROADCAST_CLASSES = 500_000
#: Characters of text that are hashed together.
GROUP_CHARACTERS = 1_000_000
#: Stored bytes of a text for each of its shingles.
SHINGLE_BYTES = 4

#: Members of a key beyond which they pair by their rarest shingles.
HOT_KEY = 32
#: Members of a shingle up to which they travel as one row (300 bytes each), and members that are compared with the others at once.
PLACE, PAIR_BLOCK = 1024, 64
#: Bits of the parity sketch, 64 in a word.
SKETCH_BITS = 2048
#: Words that it is folded to where a place has many classes.
SHORT_SKETCH = 8

OUTPUT = ["n_shingles", "component_id", "kept"]

_steps = np.arange(1, VALUES + 1, dtype=np.uint64)
MULTIPLIERS = mix(_steps * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
OFFSETS = mix(_steps * np.uint64(0xD6E8FEB86659FD93))


def shingle_sets(texts: list[str], size: int = SHINGLE) -> list[np.ndarray]:
    """The set of each text as sorted distinct 64-bit hashes; empty without words."""
    words = Words([text.encode().lower() for text in texts])
    ends = np.cumsum(words.count)
    hashes = grams(words.hash, size)
    sets = []
    for n, end in zip(words.count.tolist(), ends.tolist(), strict=True):
        if n >= size:
            sets.append(np.unique(hashes[end - n : end - size + 1]))
        elif n:
            sets.append(mix(grams(words.hash[end - n : end], n) + np.uint64(n)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values of sets that aren't empty: one row each."""
    sizes = np.array([len(s) for s in sets])
    members = np.concatenate(sets)
    starts = np.cumsum(sizes) - sizes
    out = np.empty((len(sets), VALUES), np.uint32)
    for j in range(VALUES):
        values = ((members * MULTIPLIERS[j] + OFFSETS[j]) >> np.uint64(32)).astype(np.uint32)
        out[:, j] = np.minimum.reduceat(values, starts) & np.uint32((1 << BITS) - 1)
    return out


def signature_keys(values: np.ndarray) -> np.ndarray:
    """The keys of each signature: one for each chunk and each choice of values to leave out."""
    columns = []
    wide = values.astype(np.uint64)
    for chunk in range(CHUNKS):
        for salt, kept in enumerate(combinations(range(PER_CHUNK), PER_CHUNK - ERRORS)):
            key = np.full(len(values), chunk * 1000 + salt + 1, np.uint64)
            for place in kept:
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + wide[:, chunk * PER_CHUNK + place])
            columns.append(key)
    return np.stack(columns, axis=1).view(np.int64)


def _grouped(rows: list[tuple], texts: list[str]) -> Iterator[tuple[list[tuple], list[str]]]:
    at, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= GROUP_CHARACTERS:
            yield rows[at : i + 1], texts[at : i + 1]
            at, size = i + 1, 0
    if at < len(texts):
        yield rows[at:], texts[at:]


def text_classes(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(nid, cls, rep, n, sig) of each distinct text that isn't null; ``rep`` is its least id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, least = {}, {}
            for key, cls, text in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                texts[cls] = text
                if cls not in least or (key is not None and (least[cls] is None or key < least[cls])):
                    least[cls] = key
            for rows, group in _grouped(list(least.items()), list(texts.values())):
                sets = shingle_sets(group)
                full = [i for i, s in enumerate(sets) if len(s)]
                sigs: list[bytes | None] = [None] * len(sets)
                if full:
                    for i, values in zip(full, signatures([sets[i] for i in full]), strict=True):
                        sigs[i] = values.tobytes()
                arrays = [pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], batch.schema.field(0).type), pa.array([len(s) for s in sets], pa.int64()), pa.array(sigs, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["cls", "rep", "n", "sig"])

    kind = docs.schema[id_column].dataType.simpleString()
    listed = docs.filter(F.col(text_column).isNotNull()).select(F.col(id_column), _class_of(text_column).alias("cls"), F.col(text_column))
    found = listed.mapInArrow(run, f"cls binary, rep {kind}, n long, sig binary")
    merged = found.groupBy("cls").agg(F.min("rep").alias("rep"), F.max("n").alias("n"), F.max("sig").alias("sig"))
    return merged.select(F.monotonically_increasing_id().alias("nid"), "*")


def _class_of(text_column: str):
    return F.unhex(F.md5(F.col(text_column)))


def class_keys(classes: DataFrame) -> DataFrame:
    """(key, nid): the keys that each class is indexed under."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            values = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, VALUES)
            keys = signature_keys(values)
            nid = np.repeat(batch.column(0).to_numpy(), keys.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(nid)], names=["key", "nid"])

    return classes.filter(F.col("n") > 0).select("nid", "sig").mapInArrow(run, "key long, nid long")


def _close_signatures(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose signatures are within the distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(-1, VALUES) for i in (2, 3))
            near = pa.array((x != y).sum(axis=1) <= DISTANCE)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(near), batch.column(1).filter(near)], names=["a", "b"])

    one = classes.select(F.col("nid").alias("a"), F.col("sig").alias("x"))
    two = classes.select(F.col("nid").alias("b"), F.col("sig").alias("y"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, x, y = (column.to_pylist() for column in batch.columns)
            links: list[tuple[int, int]] = []
            for rows, group in _grouped(list(zip(a, b, y, strict=True)), x):
                others = dict.fromkeys(row[1] for row in rows)
                whole = {row[1]: row[2] for row in rows}
                sets = shingle_sets(group + [whole[k] for k in others])
                of = dict(zip(others, sets[len(group) :], strict=True))
                for (one, two, _), own in zip(rows, sets, strict=False):
                    other = of[two]
                    common = len(np.intersect1d(own, other, assume_unique=True))
                    if 100 * common >= SIMILAR * (len(own) + len(other) - common):
                        links.append((one, two))
            yield pa.RecordBatch.from_arrays([pa.array([l[0] for l in links], pa.int64()), pa.array([l[1] for l in links], pa.int64())], names=["a", "b"])

    one = texts.select(F.col("nid").alias("a"), F.col("text").alias("x"))
    two = texts.select(F.col("nid").alias("b"), F.col("text").alias("y"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


# An aggregate that is joined back to its rows by a hot key is written first: a join of two plain tables is what Spark can split.


def _mixed(placed: DataFrame) -> DataFrame:
    """The rows (key, nid, root) whose key is shared by classes of different roots."""
    mixed = placed.groupBy("key").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).filter(F.col("r1") < F.col("r2")).select("key")
    return placed.join(mixed, "key", "left_semi")


def _placed(apart: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, nid, root) of the keys that still hold different roots."""
    own = apart.select("key", "nid").join(roots.withColumnRenamed("node", "nid"), "nid", "left")
    return _mixed(own.select("key", "nid", F.coalesce("root", "nid").alias("root")))


def parity_sketch(shingles: np.ndarray) -> list[int]:
    """The parity of the number of shingles at each place, as words of 64 bits."""
    places = (mix(shingles + np.uint64(1)) % np.uint64(SKETCH_BITS)).astype(np.int64)
    odd = (np.bincount(places, minlength=SKETCH_BITS) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64).tolist()


def _bounds(texts: DataFrame) -> DataFrame:
    """(nid, shared, sketch): how many of a class's shingles another of these classes may have, never too few, and its parity sketch."""

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[np.ndarray]]]:
        for batch in batches:
            for rows, group in _grouped(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield rows, shingle_sets(group)

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for _, sets in grouped(batches):
            yield mix(np.concatenate(sets))

    texts = texts.select("nid", "text")
    repeated = texts.sparkSession.sparkContext.broadcast(repeated_hashes(texts, hashes, plan_bytes(texts) // SHINGLE_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, sets in grouped(batches):
            held = repeated.value.holds(mix(np.concatenate(sets)))
            sizes = np.array([len(s) for s in sets])
            counts = np.bincount(np.repeat(np.arange(len(sets)), sizes), held, minlength=len(sets)).astype(np.int64)
            sketches = pa.array([parity_sketch(s) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(counts), sketches], names=["nid", "shared", "sketch"])

    return _with_shared(texts.mapInArrow(run, "nid long, shared long, sketch array<long>"), repeated)


def _with_shared(table: DataFrame, shared) -> DataFrame:
    """A table that remembers what was broadcast for it, to be destroyed once it is written."""
    table._shared = shared
    return table


def _possible(x: list[Column], y: list[Column], words: int = SKETCH_BITS // 64) -> tuple[Column, Column]:
    """Whether two classes, by (n, shared, sketch), can be similar at all; and the least number of shingles in which they differ.

    A folded sketch, the parities of fewer and larger places, gives a weaker
    bound, but a sure one.
    """
    most, sizes = F.least(x[1], y[1]), x[0] + y[0]
    differ = sum(F.bit_count(x[2][i].bitwiseXOR(y[2][i])) for i in range(words))
    return (100 * most >= SIMILAR * (sizes - most)) & ((100 + SIMILAR) * differ <= (100 - SIMILAR) * sizes), differ


def _keys_that_meet(classes: DataFrame) -> DataFrame:
    """(key, nid, size): the rows of keys that more than one class has."""
    keys = class_keys(classes)
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > 1)
    return keys.join(materialize(sizes, "sizes"), "key").select("key", "nid", "size")


def _leaders(met: DataFrame, central: DataFrame) -> DataFrame:
    """(a, b): for each class the most central one that it meets in any key."""
    order = F.struct((-F.col("central")).alias("c"), F.col("nid"))
    leads = materialize(met.join(central, "nid").groupBy("key").agg(F.min(order).alias("lead")), "leads")
    first = met.select("key", "nid").join(leads, "key").groupBy(F.col("nid").alias("a")).agg(F.min("lead")["nid"].alias("b"))
    return first.filter(F.col("a") != F.col("b"))


def _needed_texts(docs: DataFrame, classes: DataFrame, central: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(nid, text) of the classes that meet another."""
    need = classes.select("cls", "nid", "rep").join(central.select("nid"), "nid", "left_semi")
    wanted = central.count()
    if wanted <= BROADCAST_CLASSES:
        need = F.broadcast(need)
    own = docs.filter(F.col(text_column).isNotNull()).select(F.col(id_column).alias("_id"), _class_of(text_column).alias("cls"), F.col(text_column).alias("text"))
    texts = materialize(own.join(need, "cls").filter(F.col("_id").eqNullSafe(F.col("rep"))).select("nid", "text"), "texts")
    if texts.count() > wanted:  # rows that repeat an id and its text
        once, texts = texts, materialize(texts.dropDuplicates(["nid"]), "texts")
        discard(once)
    return texts


def class_groups(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(cls, n, group_id) of each distinct text; ``group_id`` is the least id of its component."""
    classes = materialize(text_classes(docs, id_column, text_column), "classes")
    met = materialize(_keys_that_meet(classes), "met")
    central = materialize(met.groupBy("nid").agg(F.sum("size").alias("central")), "central")
    texts = _needed_texts(docs, classes, central, id_column, text_column)
    links = materialize(_confirmed(_leaders(met, central), texts), "links")
    roots = components(links)

    apart = materialize(_placed(met, roots), "apart")
    discard(met, central)
    if not apart.isEmpty():
        bounds = _bounds(texts.join(apart.select("nid").distinct(), "nid", "left_semi"))
        able = materialize(bounds.join(classes.select("nid", "n"), "nid").filter(100 * F.col("shared") >= SIMILAR * F.col("n")), "bounds")
        bounds._shared.destroy()
        apart, before = materialize(_mixed(apart.join(able.select("nid"), "nid", "left_semi")), "apart"), apart
        discard(before)
        places = _places(apart, able, texts)
        discard(apart)
        for nearest in (True, False):
            pairs = materialize(_possible_pairs(places, roots, able, nearest), "pairs")
            if pairs.isEmpty():
                break
            links = links.union(materialize(_confirmed(pairs if nearest else _close_signatures(pairs, classes), texts), "links"))
            roots = components(links)
            discard(pairs)
        discard(places, able)
    discard(texts)

    inside = classes.join(roots.withColumnRenamed("node", "nid"), "nid").select("nid", "rep", "root")
    least = inside.groupBy("root").agg(F.min("rep").alias("group_id"))
    named = inside.join(least, "root").select("nid", "group_id")
    return classes.join(named, "nid", "left").select("cls", "n", F.coalesce("group_id", "rep").alias("group_id"))


def _rare_shingles(texts: DataFrame) -> DataFrame:
    """(nid, token): of each class the rarest shingles among these classes, so many that similar sets share one.

    Similar sets have at least three quarters of each one's shingles in common;
    so of all but three quarters and one more, in one order for all, they share
    one at least. The order is by counters of bounded size, then by hash: any
    order for all would do, and rare ones first make few meet. Shingles that
    one class alone has are in the count, but join nothing.
    """
    texts = texts.select("nid", "text")

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[np.ndarray]]]:
        for batch in batches:
            for rows, group in _grouped(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield rows, shingle_sets(group)

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for _, sets in grouped(batches):
            yield mix(np.concatenate(sets))

    counters = texts.sparkSession.sparkContext.broadcast(hash_counters(texts, hashes, plan_bytes(texts) // SHINGLE_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, sets in grouped(batches):
            nids, tokens = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
            for nid, own in zip(rows, sets, strict=True):
                counts = counters.value.of(mix(own))
                most = len(own) - -(-len(own) * SIMILAR // 100) + 1
                first = np.lexsort((own, counts))[:most]
                shared = own[first[counts[first] > 1]]
                nids.append(np.full(len(shared), nid))
                tokens.append(shared)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(nids)), pa.array(np.concatenate(tokens).view(np.int64))], names=["nid", "token"])

    return _with_shared(texts.mapInArrow(run, "nid long, token long"), counters)


def _places(apart: DataFrame, able: DataFrame, texts: DataFrame) -> DataFrame:
    """(at, nid): where classes meet: at keys, and those of hot keys at their rarest shingles, which similar sets share."""
    sizes = materialize(apart.groupBy("key").agg(F.count(F.lit(1)).alias("size")), "sizes")
    placed = apart.join(sizes, "key")
    few = placed.filter(F.col("size") <= HOT_KEY).select(F.col("key").alias("at"), "nid")
    hot = materialize(placed.filter(F.col("size") > HOT_KEY).select("nid").distinct(), "hot")
    if hot.isEmpty():
        return materialize(few, "places")
    tokens = _rare_shingles(texts.join(hot, "nid", "left_semi"))
    places = materialize(few.union(tokens.select(F.col("token").alias("at"), "nid")), "places")
    tokens._shared.destroy()
    discard(sizes, hot)
    return places


def _possible_pairs(places: DataFrame, roots: DataFrame, able: DataFrame, nearest: bool) -> DataFrame:
    """(a, b): pairs of classes of different roots that meet at a place and can be similar; of each class only the nearest one before it, if asked, and at places of PLACE classes at most."""
    placed = places.join(roots.withColumnRenamed("node", "nid"), "nid", "left").select("at", "nid", F.coalesce("root", "nid").alias("root"))
    sizes = placed.groupBy("at").agg(F.count(F.lit(1)).alias("size"), F.min("root").alias("r1"), F.max("root").alias("r2")).filter(F.col("r1") < F.col("r2")).select("at", "size")
    mixed = placed.join(materialize(sizes, "sizes"), "at")
    met = _pairs_of_few(mixed.filter(F.col("size") <= PLACE), able, nearest)
    return met.distinct() if nearest else met.union(_pairs_of_many(mixed.filter(F.col("size") > PLACE).select("at", "nid", "root"), able)).distinct()


def _pairs_of_few(placed: DataFrame, able: DataFrame, nearest: bool = False) -> DataFrame:
    """(a, b) of (at, nid, root): the possible pairs of different roots at places of PLACE classes at most, a place's members as one row; with ``nearest`` one for each member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: set[tuple[int, int]] = set()
            members = batch.column(0)
            of = members.flatten()
            nid, root, n, shared = (of.field(name).to_numpy() for name in ("nid", "root", "n", "shared"))
            sketch = of.field("sketch").flatten().to_numpy().reshape(len(nid), -1).view(np.uint64)
            ends = np.cumsum(members.value_lengths().to_numpy())
            least, near = np.full(len(nid), np.iinfo(np.int64).max), np.full(len(nid), -1)
            for at, last in ((at, last) for first, last in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True) for at in range(first, last, PAIR_BLOCK)):
                i, j = np.nonzero(np.arange(at, min(at + PAIR_BLOCK, last))[:, None] < np.arange(at, last)[None, :])
                i, j = i + at, j + at
                most, sizes = np.minimum(shared[i], shared[j]), n[i] + n[j]
                fine = (root[i] != root[j]) & (100 * most >= SIMILAR * (sizes - most))
                i, j, sizes = i[fine], j[fine], sizes[fine]
                differ = np.bitwise_count(sketch[i] ^ sketch[j]).sum(axis=1, dtype=np.int64)
                fine = (100 + SIMILAR) * differ <= (100 - SIMILAR) * sizes
                i, j, differ = i[fine], j[fine], differ[fine]
                if nearest:
                    order = np.lexsort((nid[i], differ, j))
                    own, first = np.unique(j[order], return_index=True)
                    i, differ = i[order][first], differ[order][first]
                    better = differ < least[own]
                    least[own[better]], near[own[better]] = differ[better], i[better]
                else:
                    found.update(zip(np.maximum(nid[i], nid[j]).tolist(), np.minimum(nid[i], nid[j]).tolist(), strict=True))
            if nearest:
                j = np.flatnonzero(near >= 0)
                found.update(zip(np.maximum(nid[near[j]], nid[j]).tolist(), np.minimum(nid[near[j]], nid[j]).tolist(), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    rows = placed.join(able, "nid").groupBy("at").agg(F.collect_list(F.struct("nid", "root", "n", "shared", "sketch")).alias("members"))
    return rows.filter(F.size("members") > 1).select("members").mapInArrow(run, "a long, b long")


def _pairs_of_many(placed: DataFrame, able: DataFrame) -> DataFrame:
    """(a, b) of (at, nid, root): the possible pairs of different roots at larger places, where the folded sketch is a condition of the join."""
    words = [F.get("sketch", F.lit(i)) for i in range(SKETCH_BITS // 64)]
    folded = F.array(*[reduce(lambda a, b: a.bitwiseXOR(b), words[i::SHORT_SKETCH]) for i in range(SHORT_SKETCH)])
    short = able.select("nid", "n", "shared", folded.alias("sketch"))
    x, y = (placed.join(short, "nid").alias(side) for side in "xy")
    possible, _ = _possible(*[[F.col(f"{side}.{name}") for name in ("n", "shared", "sketch")] for side in "xy"], words=SHORT_SKETCH)
    pairs = x.join(y, (F.col("x.at") == F.col("y.at")) & (F.col("x.nid") > F.col("y.nid")) & (F.col("x.root") != F.col("y.root")) & possible)
    pairs = pairs.select(F.col("x.nid").alias("a"), F.col("y.nid").alias("b")).distinct()
    sides = [able.select(F.col("nid").alias(side), F.struct("n", "shared", "sketch").alias(name)) for side, name in (("a", "x"), ("b", "y"))]
    possible, _ = _possible(*[[F.col(f"{name}.{field}") for field in ("n", "shared", "sketch")] for name in "xy"])
    return pairs.join(sides[0], "a").join(sides[1], "b").filter(possible).select("a", "b")


@keeping_columns(OUTPUT)
def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Each row with n_shingles, component_id (the least id of its group) and kept (it has that id).

    Texts that are null, empty or without words have no shingles and are alone
    in their group. Null ids never lead a group that has any other; a group of
    null ids alone has a null component_id and all its rows are kept. Repeated
    rows of one id are one document and all kept. Input columns with the
    results' names are replaced.
    """
    bound_batches(docs.sparkSession)
    groups = class_groups(docs, id_column, text_column).filter(F.col("n") > 0)
    rows = docs.withColumn("_cls", _class_of(text_column))
    joined = rows.join(groups.select(F.col("cls").alias("_cls"), F.col("n").alias("_n"), "group_id"), "_cls", "left")
    group = F.when(F.col("_n").isNull(), F.col(id_column)).otherwise(F.col("group_id"))
    return joined.select(
        *plain_columns(docs, OUTPUT),
        F.coalesce("_n", F.lit(0)).cast("long").alias("n_shingles"),
        group.alias("component_id"),
        F.col(id_column).eqNullSafe(group).alias("kept"),
    )


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", *OUTPUT)


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS c FROM s GROUP BY doc_id),
link AS (
  SELECT p.a, p.b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL) p
  JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * k >= 75 * (na.c + nb.c - k)),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM d
  UNION
  SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b),
comp AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(c, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d JOIN comp ON comp.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
