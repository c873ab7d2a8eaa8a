"""Near-duplicate documents by MinHash bands, odd sketches and an exact check.

A document is the set of its five-word shingles (kernels.shingles).  The steps, all on DataFrames:

1. One pass makes each document's signature: the size of the set, a 128-bit hash of it, SAMPLES MinHash
   values folded into BANDS band keys, and their odd sketch, a bitmap of 256 parities.
2. Documents with equal sets are one class, which its least id stands for; only these go on.
3. Documents that share a band key form a bucket.  In each bucket one leader is compared with all
   others, so a bucket of n documents makes n - 1 pairs.  The population count of two sketches' XOR
   estimates their similarity; pairs clearly below the threshold are dropped, all others are checked on their
   full sets.  The sets of documents in buckets are made once from the texts; a leader's set is sent once to each
   BLOCK of its partners, which stream past it, so no leader is a hot key.
4. Links make components.  In buckets that still hold several, the documents of different components
   are compared by their sketches, each pair in the first bucket that it shares, in blocks of about
   BLOCK documents and at most about BLOCK_SHINGLES shingles.  Only documents with a partner that the sketches
   leave go on: the same blocks hold their full sets and check; of the links they give those that join
   components.  So no link between components of a bucket is lost, whatever its size, and rows and tasks stay small.

With SAMPLES = 80 in bands of 4, a pair of similarity 0.85 shares no bucket with probability 4e-7, one of 0.8
with 3e-5.  The sketch test allows MARGIN below the threshold, five standard deviations of the estimate.

Defined results: null and empty texts have an empty set, size 0, and are linked with nothing; a text of
fewer than five words is one shingle.  Rows that share an id are one document; repeated rows are all
returned.  A row without an id takes the component of a document with an equal set, else none, and is kept then;
`dedup` keeps one of the rows without an id that have equal sets and no such document, and of rows that share
an id but not their set one for each set.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bloom, kernels
from .components import components
from .tables import forget, mapped, pick, written

SHINGLE = 5
SAMPLES, BANDS = 80, 20
BITS = 256
MARGIN = 0.2
BLOCK = 512
BLOCK_SHINGLES = 500_000
_SKETCH = ["s0", "s1", "s2", "s3"]
_ADD, _TIMES, _FOLD, _PLACE = (kernels.constants(SAMPLES, seed) for seed in (101, 202, 303, 404))
_TIMES |= np.uint64(1)


def distinct_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all rows one after another, and where each row's begin and end."""
    sets = [np.zeros(0, np.uint64)]
    sizes = []
    for part in kernels.slices(column):
        found = kernels.shingles(kernels.words(part), SHINGLE)
        for a, b in zip(found.bounds[:-1].tolist(), found.bounds[1:].tolist(), strict=True):
            sets.append(np.unique(found.hashes[a:b]))
            sizes.append(len(sets[-1]))
    return np.concatenate(sets), np.concatenate([[0], np.cumsum(np.array(sizes, np.int64))]).astype(np.int64)


def minhashes(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """SAMPLES least values of each non-empty row, a row of the result each."""
    out = np.empty((len(starts), SAMPLES), np.uint64)
    spare = np.empty_like(values)
    for i in range(SAMPLES):
        np.bitwise_xor(values, _ADD[i], out=spare)
        np.multiply(spare, _TIMES[i], out=spare)
        out[:, i] = np.minimum.reduceat(spare, starts)
    return out


def band_keys(samples: np.ndarray) -> np.ndarray:
    rows = SAMPLES // BANDS
    folded = (samples ^ _FOLD) * (_FOLD | np.uint64(1))
    return kernels.mix(folded.reshape(len(samples), BANDS, rows).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """Parities of how many samples fall on each of BITS places, as four 64-bit words a row."""
    n = len(samples)
    place = (kernels.mix(samples ^ _PLACE) >> np.uint64(56)).astype(np.int64)
    odd = np.bincount((place + np.arange(n)[:, None] * BITS).ravel(), minlength=n * BITS) & 1
    return np.packbits(odd.astype(np.uint8)).reshape(n, BITS // 8).copy().view(np.uint64)


def set_hashes(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """128-bit hashes of non-empty sets, two numbers a row."""
    return np.column_stack([np.add.reduceat(x, starts) for x in (kernels.mix(values), kernels.mix(values ^ _ADD[0]))])


def most_bits(threshold: int) -> int:
    """Most odd places of two sketches' XOR at which a similarity of threshold percent is still possible."""
    differing = 2 * SAMPLES * (1 - threshold / 100 + MARGIN)
    return int(BITS / 2 * (1 - exp(-2 * differing / BITS))) + 1


def signatures(documents: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, node, bands, s0..s3) of every row; without words node, bands and sketch are null."""

    def run(batches):
        for batch in batches:
            for part in kernels.slices(batch.column(1)):
                first = part.first
                values, bounds = distinct_sets(batch.column(1).slice(first, len(part)))
                size = np.diff(bounds)
                full = np.flatnonzero(size)
                none = pa.array(size == 0)
                samples = minhashes(values, bounds[:-1][full]) if full.size else np.zeros((0, SAMPLES), np.uint64)
                whole = set_hashes(values, bounds[:-1][full]) if full.size else np.zeros((0, 2), np.uint64)
                node = np.zeros((len(size), 2), np.uint64)
                node[full] = whole
                bands, sketch = np.zeros((len(size), BANDS), np.uint64), np.zeros((len(size), 4), np.uint64)
                bands[full], sketch[full] = band_keys(samples), odd_sketches(samples)
                nodes = pa.array([bytes(x) if n else None for x, n in zip(node, size, strict=True)], pa.binary())
                keys = pa.ListArray.from_arrays(np.arange(0, len(size) * BANDS + 1, BANDS, dtype=np.int32), pa.array(bands.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(size)), pa.array(size), nodes, keys, *(pa.array(sketch[:, i].copy().view(np.int64), mask=none.to_numpy(zero_copy_only=False)) for i in range(4))],
                    ["doc_id", "n_shingles", "node", "bands", *_SKETCH],
                )

    return mapped(pick(documents, doc_id="long", text="string"), run, "doc_id long, n_shingles long, node binary, bands array<long>, " + ", ".join(f"{s} long" for s in _SKETCH))


def _sets(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """(rep, node, weight, shingles): the full sets, as sorted 64-bit hashes, of at least the documents of `ids`; those that a filter of bounded size lets through."""
    table = documents.sparkSession.sparkContext.broadcast(bloom.build(F.col(ids.columns[0]), ids, ids.count()))

    def run(batches):
        for batch in batches:
            batch = batch.take(pa.array(bloom.having(batch.column(0), table.value)))
            for part in kernels.slices(batch.column(1)):
                values, bounds = distinct_sets(batch.column(1).slice(part.first, len(part)))
                size = np.diff(bounds)
                full = np.flatnonzero(size)
                if full.size:
                    whole = set_hashes(values, bounds[:-1][full])
                    rows = [values[bounds[i] : bounds[i + 1]].tobytes() for i in full.tolist()]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(full + part.first)), pa.array([bytes(x) for x in whole], pa.binary()), pa.array(size[full]), pa.array(rows, pa.binary())], ["rep", "node", "weight", "shingles"])

    return mapped(pick(documents, doc_id="long", text="string"), run, "rep long, node binary, weight long, shingles binary")


def _groups(batches, order: list[str]) -> Iterator[pa.Table]:
    """Tables of consecutive rows that agree in the `order` columns."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        if not rows.num_rows:
            continue
        marks = np.column_stack([rows.column(c).to_numpy().astype(np.int64) for c in order])
        cuts = [0, *(np.flatnonzero((np.diff(marks, axis=0) != 0).any(axis=1)) + 1).tolist(), len(marks)]
        for start, end in zip(cuts[:-1], cuts[1:], strict=True):
            mark = tuple(marks[start].tolist())
            if held and mark != last:
                yield pa.concat_tables(held)
                held = []
            held.append(rows.slice(start, end - start))
            last = mark
    if held:
        yield pa.concat_tables(held)


def _similar(a: np.ndarray, b: np.ndarray, threshold: int) -> bool:
    """Whether 100 * shared >= threshold * union of two sorted sets."""
    if min(len(a), len(b)) * 100 < threshold * max(len(a), len(b)):
        return False
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    at = np.searchsorted(large, small)
    shared = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return 100 * shared >= threshold * (len(a) + len(b) - shared)


def confirmed(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b), distinct, whose full sets are similar enough: 100 * shared >= threshold * union."""
    blocks = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = pairs.join(blocks, "a").select("a", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int").alias("salt"), "b")
    dealt = written(dealt)
    own = sets.select("rep", "shingles")
    partners = dealt.join(own, dealt.b == own.rep).select("a", "salt", "b", "shingles")
    # a leader stands before its partners in each block
    leaders = dealt.select("a", "salt").distinct().join(own, F.col("a") == own.rep).select("a", "salt", F.lit(None).cast("long").alias("b"), "shingles")
    order = ["a", "salt"]

    def run(batches):
        mark, leader = None, np.zeros(0, np.uint64)
        for batch in batches:
            a, salt, b = (batch.column(i).to_pylist() for i in range(3))
            yes = []
            for i in range(batch.num_rows):
                own = np.frombuffer(batch.column(3)[i].as_buffer(), np.uint64)
                if b[i] is None:
                    mark, leader = (a[i], salt[i]), own.copy()
                elif mark == (a[i], salt[i]) and _similar(leader, own, threshold):
                    yes.append(i)
            taken = pa.array(yes, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(taken), batch.column(2).take(taken)], ["a", "b"])

    both = leaders.unionByName(partners).repartition(*order).sortWithinPartitions(*order, F.asc_nulls_first("b"))
    return mapped(both, run, "a long, b long")


def _near_enough(pairs: DataFrame, reps: DataFrame, most: int) -> DataFrame:
    """Pairs (a, b) whose sketches allow the threshold."""
    mine = reps.select(F.col("rep").alias("b"), *(F.col(s).alias(f"b_{s}") for s in _SKETCH))
    other = reps.select(F.col("rep").alias("a"), *(F.col(s).alias(f"a_{s}") for s in _SKETCH))
    bits = sum((F.bit_count(F.col(f"a_{s}").bitwiseXOR(F.col(f"b_{s}"))) for s in _SKETCH[1:]), F.bit_count(F.col("a_s0").bitwiseXOR(F.col("b_s0"))))
    return pairs.join(mine, "b").join(other, "a").filter(bits <= most).select("a", "b")


def _asked(group: pa.Table, most: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The rows of a group with a partner of another component that their sketches allow, and for each the partners to the right.

    A pair counts in the first bucket that it shares alone.
    """
    key, i, j, against = (group.column(c)[0].as_py() for c in ("key", "i", "j", "against_main"))
    label, main, own = (group.column(c).to_numpy() for c in ("component", "main", "own"))
    odd = label != main
    left = np.flatnonzero(odd)
    if len(label) < 2 or not left.size:
        return left[:0], []
    sketch = np.column_stack([group.column(s).to_numpy() for s in _SKETCH]).view(np.uint64)
    bands = group.column("bands").combine_chunks().flatten().to_numpy().reshape(len(label), BANDS)
    asked = []
    for x in left.tolist():
        other = ~odd if against else odd & (own != own[x]) if i != j else odd.copy()
        if not against:
            other[: x + 1] = False
        ask = np.flatnonzero(other & (label != label[x]))
        ask = ask[np.bitwise_count(sketch[ask] ^ sketch[x]).sum(axis=1) <= most]
        same = bands[ask] == bands[x]
        asked.append(ask[bands[x][same.argmax(axis=1)] == key])
    return left, asked


def _links_of_group(group: pa.Table, most: int, threshold: int) -> list[tuple[int, int]]:
    """Links that join the components of one group's rows: for each pair of components that a link joins, at least a path of them."""
    left, asked = _asked(group, most)
    if not any(x.size for x in asked):
        return []
    rep, label = group.column("rep").to_numpy(), group.column("component").to_numpy().copy()
    raw = [np.frombuffer(x, np.uint64) for x in group.column("shingles").to_pylist()]
    size = np.array([len(x) for x in raw])
    codes = np.unique(np.concatenate(raw), return_inverse=True)[1]
    parts = np.split(codes, np.cumsum(size)[:-1])
    own_set = np.zeros(int(codes.max()) + 1, bool)
    found = []
    for x, ask in zip(left.tolist(), asked, strict=True):
        ask = ask[(label[ask] != label[x]) & (100 * np.minimum(size[ask], size[x]) >= threshold * np.maximum(size[ask], size[x]))]
        if not ask.size:
            continue
        own_set[parts[x]] = True
        shared = np.add.reduceat(own_set[np.concatenate([parts[y] for y in ask.tolist()])].astype(np.int64), np.concatenate([[0], np.cumsum(size[ask])[:-1]]))
        own_set[parts[x]] = False
        for y in ask[100 * shared >= threshold * (size[ask] + size[x] - shared)].tolist():
            if label[y] != label[x]:
                found.append((min(rep[x], rep[y]), max(rep[x], rep[y])))
                label[label == label[y]] = label[x]
    return found


def _rest(members: DataFrame, reps: DataFrame, sets: DataFrame, most: int, threshold: int) -> DataFrame:
    """Links (a, b) between different components in the same bucket, by blocks.

    In each bucket the component of the leader is compared with the others, and these among each other;
    the many rows of one component are never compared among themselves.  A first pass over the blocks holds
    sketches alone and tells which rows have a partner left; the second holds those rows' full sets, confirms pairs
    at once and gives only as many links as join its rows' components: fewer than its rows.
    """
    weight = sets.select("rep", "weight").groupBy("rep").agg(F.max("weight").alias("weight"))
    other = F.col("component") != F.col("main")
    blocks = lambda n, total: F.ceil(F.greatest(n / BLOCK, total / BLOCK_SHINGLES)).cast("int")
    sizes = members.join(weight, "rep").groupBy("key").agg(blocks(F.count("*"), F.sum("weight")).alias("all"), blocks(F.count_if(other), F.coalesce(F.sum(F.when(other, F.col("weight"))), F.lit(0))).alias("odd"))
    own = F.when(other, F.pmod(F.xxhash64("rep"), F.col("odd")).cast("int"))
    # every odd block meets every odd block (as rows below and above the diagonal) and every block of the main component
    mine = F.pmod(F.xxhash64("rep", F.lit(1)), F.col("all")).cast("int")
    to_odd = F.transform(F.sequence(F.lit(0), F.col("odd") - 1), lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j"), F.lit(False).alias("against_main")))
    to_main = F.transform(F.sequence(F.lit(0), F.col("all") - 1), lambda j: F.struct(own.alias("i"), j.alias("j"), F.lit(True).alias("against_main")))
    from_main = F.transform(F.sequence(F.lit(0), F.col("odd") - 1), lambda i: F.struct(i.alias("i"), mine.alias("j"), F.lit(True).alias("against_main")))
    dealt = members.join(written(sizes), "key").filter("odd > 0")
    held = ["bands", *_SKETCH]
    order = ["key", "i", "j", "against_main"]
    dealt = dealt.join(reps.select("rep", *held), "rep").select("key", "rep", "component", "main", *held, F.coalesce(own, F.lit(-1)).alias("own"), F.explode(F.when(other, F.concat(to_odd, to_main)).otherwise(from_main)).alias("block"))
    columns = [*order, "rep", "component", "main", "own", *held]
    dealt = dealt.select("key", "block.i", "block.j", "block.against_main", *columns[4:])

    def partnered(batches):
        for group in _groups(batches, order):
            left, asked = _asked(group, most)
            yes = np.unique(np.concatenate([left[[x.size > 0 for x in asked]], *asked])) if len(left) else left
            yield from group.take(pa.array(yes.astype(np.int64))).combine_chunks().to_batches()

    def linked(batches):
        for group in _groups(batches, order):
            found = _links_of_group(group, most, threshold)
            yield pa.RecordBatch.from_arrays([pa.array([int(p[k]) for p in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    kind = "key long, i int, j int, against_main boolean, rep long, component long, main long, own int, bands array<long>, " + ", ".join(f"{s} long" for s in _SKETCH)
    some = written(mapped(dealt.select(*columns).repartition(*order).sortWithinPartitions(*order), partnered, kind))
    whole = some.join(sets.join(reps.select("rep", "node"), ["rep", "node"]).select("rep", "shingles"), "rep").select(*columns, "shingles")
    return mapped(whole.repartition(*order).sortWithinPartitions(*order), linked, "a long, b long")


def _possible(reps: DataFrame, buckets: DataFrame) -> DataFrame:
    """(key, rep): every band key of a document that may be one of `buckets`."""
    table = reps.sparkSession.sparkContext.broadcast(bloom.build(F.col("key"), buckets, buckets.count()))

    def run(batches):
        for batch in batches:
            keys = batch.column(1).flatten()
            live = bloom.having(keys, table.value)
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(live)), batch.column(0).take(pa.array(live // BANDS))], ["key", "rep"])

    return mapped(reps.select("rep", "bands"), run, "key long, rep long")


def classes(documents: DataFrame, threshold: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row; documents link from a similarity of threshold percent on."""
    return _classes(documents, threshold).drop("node")


def _classes(documents: DataFrame, threshold: int) -> DataFrame:
    """`classes` with node, the hash of each row's set."""
    most = most_bits(threshold)
    signed = written(signatures(documents))
    alike = signed.filter("node is not null and doc_id is not null").groupBy("node").agg(F.min(F.struct("doc_id", "bands", *_SKETCH)).alias("least"))
    reps = written(alike.select("node", F.col("least.doc_id").alias("rep"), "least.bands", *(f"least.{s}" for s in _SKETCH)))
    placed = reps.select("rep", F.explode("bands").alias("key"))
    order = F.xxhash64("rep", F.lit(5))
    buckets = written(placed.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct(order.alias("order"), F.col("rep").alias("leader"))).alias("first")).filter("n > 1").select("key", F.col("first.leader").alias("leader")))
    members = written(_possible(reps, buckets).join(buckets, "key").select("key", "rep", "leader"))
    sets = written(_sets(documents, written(members.select("rep").distinct())))
    pairs = members.filter("rep <> leader").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct()
    of_reps = sets.join(reps.select("rep", "node"), ["rep", "node"])
    found = written(components(confirmed(written(_near_enough(pairs, reps, most)), of_reps, threshold)))
    now = members.join(found, members.rep == found.node, "left").select("key", "rep", "leader", F.coalesce("component", "rep").alias("component"))
    main = F.max(F.when(F.col("rep") == F.col("leader"), F.col("component"))).alias("main")
    open_ = now.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), main).filter("x <> y")
    now = written(now.join(written(open_.select("key", "main")), "key").select("key", "rep", "component", "main"))
    if not now.isEmpty():
        more = written(_rest(now, reps, sets, most, threshold))
        found = written(components(more.unionByName(found.select(F.col("node").alias("a"), F.col("component").alias("b")))))
    whole = reps.select(F.col("node").alias("set"), "rep").join(found, F.col("rep") == F.col("node"), "left")
    whole = written(whole.select(F.col("set").alias("node"), F.coalesce("component", "rep").alias("component_id")))
    forget(buckets, members, sets, now)
    out = signed.select("doc_id", "n_shingles", "node").join(whole, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), "node").withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())).select("doc_id", "n_shingles", "component_id", "kept", "node")


def dedup(documents: DataFrame, threshold: int = 80) -> DataFrame:
    """One document of each component, the one of the least id, with all its columns; of repeated rows of an id and set the first.

    A filter of bounded size finds the few rows that are shuffled: those that may be dropped or repeated.
    """
    judged = written(_classes(documents, threshold))
    # a row's own key: its id, or, without one, its set's hash
    key = F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id")).otherwise(F.xxhash64("node"))
    marked = judged.filter("doc_id is not null or node is not null").select(key.alias("key"), F.col("doc_id").alias("own_id"), "node", "kept")
    doubtful = written(marked.groupBy("key").agg(F.count("*").alias("n"), F.bool_and("kept").alias("sure")).filter("n > 1 or not sure").select("key"))
    table = documents.sparkSession.sparkContext.broadcast(bloom.build(F.col("key"), doubtful, doubtful.count()))
    # of the rows of one id and set the join takes one; those of a set without any id have a null id
    keep = written(marked.join(doubtful, "key", "left_semi").groupBy("key", "own_id", "node").agg(F.bool_or("kept").alias("kept")).filter("kept").select("key", "own_id", "node"))
    # the input's columns go by number, so that none of their names can clash
    at_id, at_text = documents.columns.index("doc_id"), documents.columns.index("text")
    rows_ = documents.toDF(*(f"c{i}" for i in range(len(documents.columns))))
    names = rows_.columns
    fields = rows_.withColumn("id_", F.col(names[at_id]).cast("long")).withColumn("key_", F.when(F.col("id_").isNotNull(), F.xxhash64("id_")))

    def doubt(batch: pa.RecordBatch) -> pa.Array:
        live = np.asarray(batch.column(at_id).is_null())
        live[bloom.having(batch.column(len(names) + 1), table.value)] = True
        return live

    def without(batches):
        for batch in batches:
            kept = batch.filter(pa.array(~doubt(batch)))
            yield pa.RecordBatch.from_arrays(kept.columns[: len(names)], names)

    def with_node(batches):
        for batch in batches:
            batch = batch.filter(pa.array(doubt(batch)))
            column = batch.column(at_text).cast(pa.string())
            for part in kernels.slices(column):
                values, bounds = distinct_sets(column.slice(part.first, len(part)))
                full = np.flatnonzero(np.diff(bounds))
                nodes: list[bytes | None] = [None] * len(part)
                if full.size:
                    for i, x in zip(full.tolist(), set_hashes(values, bounds[:-1][full]), strict=True):
                        nodes[i] = bytes(x)
                rows = batch.slice(part.first, len(part))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(nodes, pa.binary())], schema=rows.schema.append(pa.field("node_", pa.binary())))

    sure = mapped(fields, without, rows_.schema)
    asked = mapped(fields, with_node, T.StructType([*fields.schema.fields, T.StructField("node_", T.BinaryType())]))
    asked = asked.withColumn("key_", F.coalesce("key_", F.xxhash64("node_")))
    held = asked.join(keep, F.col("key_").eqNullSafe(F.col("key")) & F.col("id_").eqNullSafe(F.col("own_id")) & F.col("node_").eqNullSafe(F.col("node")), "left_semi")
    blank = asked.filter("id_ is null and node_ is null").select(*names)
    # rows whose key is in no doubt stay, one for each id and set
    rest = asked.filter("id_ is not null or node_ is not null").join(doubtful, F.col("key_") == F.col("key"), "left_anti").select(*names)
    once = held.filter("id_ is not null or node_ is not null").dropDuplicates(["key_", "id_", "node_"]).select(*names)
    return sure.unionByName(rest).unionByName(once).unionByName(blank).toDF(*documents.columns)
