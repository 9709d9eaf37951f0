"""Near-duplicate documents: MinHash with tensored banding, links confirmed on full shingle sets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagewise import scratch
from .components import components
from .words import hashes, mix, shingles, space_words

#: Text whose MinHash values are made in one go, in shingles: bounds a worker's memory.
AT_ONCE = 1 << 18
BINS = 512
BLOCK = 512
MOST_HOT = 4096
NODE = "node"


def multipliers(n: int) -> np.ndarray:
    return (mix(np.arange(1, n + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def minhash_bytes(sets: list[np.ndarray], n: int) -> np.ndarray:
    """The low byte of each of ``n`` MinHash values, one row for each (not empty) set."""
    ends = np.cumsum([len(s) for s in sets])
    starts = np.concatenate(([0], ends[:-1]))
    x = (np.concatenate(sets) >> np.uint64(16)).astype(np.uint32)
    out = np.empty((len(sets), n), np.uint8)
    for k, a in enumerate(multipliers(n)):
        low = np.minimum.reduceat(x * a, starts)
        out[:, k] = (low ^ (low >> np.uint32(11)) ^ (low >> np.uint32(19))).astype(np.uint8)
    return out


def bin_bytes(shingle_set: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One-permutation sketch: of each of BINS bins, the low byte of its least hash, and if it has one."""
    # sets are sorted, so by the top bits bins are ranges and the first of each is the least
    top = (shingle_set >> np.uint64(64 - 9)).astype(np.int64)
    first = np.concatenate(([True], top[1:] != top[:-1]))
    values, held = np.zeros(BINS, np.uint8), np.zeros(BINS, bool)
    values[top[first]] = (shingle_set[first] & np.uint64(255)).astype(np.uint8)
    held[top[first]] = True
    return values, held


def sketch(df: DataFrame, key: str, text: str, collections: int, each: int, width: int) -> DataFrame:
    """key, n_shingles, node (digest of the set; null if empty), coll (one int for each collection)."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            keys, values = batch.column(0), batch.column(1)
            at, held, sets = 0, 0, []
            for i, value in enumerate(values):
                s = shingles(hashes(space_words(value.as_buffer().to_pybytes() if value.is_valid else None)), width)
                sets.append(s)
                held += len(s)
                if held >= AT_ONCE or i + 1 == len(values):
                    yield rows(keys.slice(at, len(sets)), sets)
                    at, held, sets = i + 1, 0, []

    def rows(keys, sets):
        full = [s for s in sets if len(s)]
        coll = minhash_bytes(full, collections * each).reshape(len(full), collections, each) if full else None
        if full:
            packed = np.zeros((len(full), collections, 4), np.uint8)
            packed[:, :, :each] = coll
            numbers = packed.view("<i4")[:, :, 0]
        lists, at = [], 0
        for s in sets:
            lists.append(numbers[at] if len(s) else None)
            at += bool(len(s))
        return pa.RecordBatch.from_arrays(
            [keys, pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()), pa.array(lists, pa.list_(pa.int32()))],
            [key, "n_shingles", NODE, "coll"],
        )

    return df.select(F.col(key), F.col(text).cast("string").cast("binary")).mapInArrow(run, f"`{key}` {kind}, n_shingles long, {NODE} binary, coll array<int>")


def full_sets(df: DataFrame, wanted: DataFrame, key: str, text: str, width: int, most_broadcast: int) -> DataFrame:
    """(node, n, items, bins, held) for each wanted (key, node): shingle hashes and their sketch.

    The wanted keys are broadcast if they are at most ``most_broadcast``; else it's a shuffled join.
    """
    few = wanted.count() <= most_broadcast
    keys = wanted.select(F.col("rep").alias("_rep")).distinct()
    rows = df.select(F.col(key).alias("_key"), F.col(text).cast("string").cast("binary").alias("_text"))
    rows = rows.join(F.broadcast(keys) if few else keys, F.col("_key").eqNullSafe(F.col("_rep")), "left_semi")

    def run(batches):
        for batch in batches:
            cols = [[] for _ in range(5)]
            for value in batch.column(0):
                s = shingles(hashes(space_words(value.as_buffer().to_pybytes() if value.is_valid else None)), width)
                if len(s):
                    values, held = bin_bytes(s)
                    for c, x in zip(cols, (xxhash.xxh3_128_digest(s.tobytes()), len(s), s.view(np.int64), values.tobytes(), np.packbits(held).tobytes()), strict=True):
                        c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], [NODE, "n", "items", "bins", "held"])

    types = [pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary()]
    made = rows.select("_text").mapInArrow(run, f"{NODE} binary, n long, items array<long>, bins binary, held binary")
    # a key's rows may have several texts, and several keys one text
    return made.join(wanted.select(NODE), NODE, "left_semi").dropDuplicates([NODE])


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) pairs whose sets reach the similarity: 100 * intersection >= percent * union."""
    left = sets.select(F.col(NODE).alias("a"), F.col("items").alias("x"))
    right = sets.select(F.col(NODE).alias("b"), F.col("items").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return (
        pairs.join(left, "a").join(right, "b")
        .withColumn("both", both)
        .filter(F.lit(100) * F.col("both") >= F.lit(percent) * (F.size("x") + F.size("y") - F.col("both")))
        .select("a", "b")
    )


def near_pairs(table: list[tuple], percent: int) -> list[tuple[bytes, bytes]]:
    """Pairs of one group value's rows that may be links and that this group answers for.

    A row: (node, component, n, coll, bins, held, block, group). Left out are pairs that share no
    other group, hence no table key, or that share an earlier one, which answers for them; pairs of
    one component, of sizes that rule a link out, and of a sketch five deviations below the similarity.
    """
    first, blocks = table[0][7], [r[6] for r in table]
    node = [r[0] for r in table]
    comp = np.unique([r[1] for r in table], return_inverse=True)[1]
    n = np.array([r[2] for r in table], np.float64)
    coll = np.array([r[3] for r in table], np.int32)
    bins = np.frombuffer(b"".join(r[4] for r in table), np.uint8).reshape(len(table), BINS)
    held = np.unpackbits(np.frombuffer(b"".join(r[5] for r in table), np.uint8)).reshape(len(table), BINS).astype(bool)
    split = len(set(blocks)) > 1
    least = percent / 100
    out = []
    for i in range(len(table) - 1):
        js = np.arange(i + 1, len(table))
        keep = (comp[js] != comp[i]) & (np.minimum(n[js], n[i]) >= least * np.maximum(n[js], n[i]))
        if split:  # two blocks of a large key: pairs within a block belong to another task
            keep &= np.array([blocks[j] != blocks[i] for j in js])
        js = js[keep]
        if not len(js):
            continue
        same = coll[js] == coll[i]
        js = js[~same[:, :first].any(1) & (same.sum(1) > 1)]
        if not len(js):
            continue
        either = held[js] | held[i]
        k = either.sum(1)
        share = ((bins[js] == bins[i]) & held[js] & held[i]).sum(1) / k
        union = np.maximum((n[js] + n[i]) / (1 + least), k)
        spread = np.sqrt(least * (1 - least) / k * (union - k) / np.maximum(union - 1, 1))
        out += [(node[i], node[j]) for j in js[share >= least - 5 * spread - 0.002]]
    return out


def cross_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Candidate (a, b) pairs between different components of each group value, each pair from one of them only."""

    def run(batches):
        now, held = None, []
        for batch in batches:
            found = []
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                group = r[:4]
                if group != now:
                    if len(held) > 1:
                        found += near_pairs(held, percent)
                    now, held = group, []
                held.append((*r[4:], r[0]))
            yield out(found)
        yield out(near_pairs(held, percent) if len(held) > 1 else [])

    def out(found):
        found = [(min(p), max(p)) for p in found]
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in found], pa.binary()), pa.array([p[1] for p in found], pa.binary())], ["a", "b"])

    keyed = rows.repartition("c", "v", "lo", "hi").sortWithinPartitions("c", "v", "lo", "hi")
    return keyed.select("c", "v", "lo", "hi", NODE, "component", "n", "coll", "bins", "held", "block").mapInArrow(run, "a binary, b binary")


def near_duplicates(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    width: int = 5,
    percent: int = 75,
    collections: int = 24,
    each: int = 4,
    most_broadcast: int = 1_000_000,
) -> DataFrame:
    """One row per input row: key, n_shingles, component_id, kept.

    Tensored banding: ``collections`` groups of ``each`` MinHash values; every pair of groups is a
    table, so ``collections * each`` values serve ``collections * (collections - 1) / 2`` tables. Two
    documents meet if two groups agree: at similarity 0.75 all but 0.13 % of pairs, 0.005 % at 0.8.

    1. Rows with equal shingle sets become one node; empty sets link with nothing.
    2. Groups' values that occur once can't meet, so only nodes that share two or more go on.
    3. In each table key every node is compared with the key's least node, on full sets, and the
       links' components are found; in a family of copies these few links join nearly all.
    4. Pairs in different components that share a table key are compared one by one, so that no
       candidate is lost. They are found by the first group they share, whose rows are far fewer
       than the keys'; large ones are cut into blocks. Of the pairs only those that a sketch leaves
       open are emitted, each once, and confirmed on full sets.

    Null keys form a document of their own; rows that repeat a key are one document's rows, with all
    their sets' links. ``component_id`` is the smallest key reachable. Null and empty texts have no
    shingles; an empty table gives no rows.

    No shuffle of rows is dealt by a set that many rows have: sets of at least a MOST_HOT-th of all rows,
    MOST_HOT at most, are broadcast, and rows without a set aren't joined at all.
    """
    scratch.not_among(key, ["n_shingles", "component_id", "kept"])
    asked = key
    key, df, text = "_doc", df.select(F.col(key).alias("_doc"), F.col(text).alias("_text")), "_text"
    rows = scratch.table(sketch(df, key, text, collections, each, width), "sketches")
    # rows of one key are one document: their nodes are linked without a comparison
    nodes = rows.filter(F.col(NODE).isNotNull()).groupBy(NODE).agg(F.min(key).alias("rep"), F.first("n_shingles").alias("n"), F.first("coll").alias("coll"), F.count("*").alias("copies"))
    nodes = scratch.table(nodes, "nodes")
    parts = nodes.select(NODE, F.posexplode("coll").alias("c", "v"))
    shared = parts.groupBy("c", "v").count().filter("count > 1").select("c", "v")
    able = parts.join(shared, ["c", "v"]).groupBy(NODE).agg(F.array_sort(F.collect_list(F.struct("c", "v"))).alias("cv")).filter(F.size("cv") > 1)
    able = scratch.table(able.join(nodes.drop("copies"), NODE), "able")
    tables = able.select(
        NODE,
        F.explode(F.flatten(F.transform("cv", lambda x, i: F.transform(
            F.slice("cv", i + 2, F.lit(collections)),
            lambda y: F.struct(x["c"].alias("first"), y["c"].alias("second"), F.xxhash64(x["c"], y["c"], x["v"], y["v"]).alias("key")),
        )))).alias("t"),
    ).select(NODE, "t.*")
    keys = tables.groupBy("key").agg(F.min(NODE).alias("center"), F.count("*").alias("size")).filter("size > 1")
    met = scratch.table(tables.join(keys, "key"), "met")
    # what several places of a plan read is written first: the driver holds the text and metrics of every plan
    wanted = scratch.table(able.join(met.select(NODE).distinct(), NODE, "left_semi").select(NODE, "rep"), "wanted")
    sets = scratch.table(full_sets(df, wanted, key, text, width, most_broadcast), "sets")
    sizes = able.select(NODE, "n")
    stars = met.filter(F.col(NODE) != F.col("center")).select(F.col("center").alias("a"), F.col(NODE).alias("b")).distinct()
    stars = (
        stars.join(sizes.withColumnsRenamed({NODE: "a", "n": "na"}), "a").join(sizes.withColumnsRenamed({NODE: "b", "n": "nb"}), "b")
        .filter(F.lit(100) * F.least("na", "nb") >= F.lit(percent) * F.greatest("na", "nb")).select("a", "b")
    )
    many = rows.filter(F.col(NODE).isNotNull()).groupBy(key).agg(F.min(NODE).alias("a"), F.max(NODE).alias("z")).filter("a < z").select(key, "a")
    same_key = rows.join(many, rows[key].eqNullSafe(many[key]), "inner").filter(F.col("a") < F.col(NODE)).select("a", F.col(NODE).alias("b"))
    links = scratch.table(confirmed(stars, sets, percent).unionByName(same_key.filter(F.col("a").isNotNull())).distinct(), "links")
    joined = scratch.table(components(links), "joined")

    def with_component(nodes_: DataFrame) -> DataFrame:
        found = nodes_.join(joined.withColumnRenamed("node", NODE), NODE, "left")
        return found.withColumn("component", F.coalesce("component", NODE))

    labelled = with_component(able.select(NODE, F.explode("cv").alias("x")).select(NODE, "x.c", "x.v"))
    mixed = labelled.groupBy("c", "v").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size"))
    mixed = mixed.filter("low < high").select("c", "v", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    open_rows = (
        labelled.join(mixed, ["c", "v"])
        .withColumn("block", F.pmod(F.xxhash64(NODE), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))
        .join(sets.drop("items"), NODE).join(able.select(NODE, "coll"), NODE)
    )
    candidates = scratch.table(cross_pairs(open_rows, percent), "pairs")
    links = scratch.table(links.unionByName(confirmed(candidates, sets, percent)), "all-links")
    final = scratch.table(components(links), "final")
    least = nodes.select(NODE, "rep").join(final.withColumnRenamed("node", NODE), NODE).groupBy("component").agg(F.min("rep").alias("least"))
    by_node = final.withColumnRenamed("node", NODE).join(least, "component").select(NODE, "least")
    home = nodes.select(NODE, "rep", "copies").join(by_node, NODE, "left").select(NODE, F.coalesce("least", "rep").alias("component_id"), "copies")
    home = scratch.table(home, "homes")
    enough = (home.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0] or 0) / MOST_HOT
    hot = F.broadcast(home.filter((F.col("copies") >= enough) & (F.col("copies") > 1)).select(NODE, F.col("component_id").alias("hot_id")))
    some = rows.select(key, "n_shingles", NODE).filter(F.col(NODE).isNotNull()).join(hot, NODE, "left")
    out = rows.filter(F.col(NODE).isNull()).select(key, "n_shingles", F.col(key).alias("component_id"))
    out = out.unionByName(some.filter(F.col("hot_id").isNotNull()).select(key, "n_shingles", F.col("hot_id").alias("component_id")))
    out = out.unionByName(some.filter(F.col("hot_id").isNull()).join(home, NODE).select(key, "n_shingles", F.coalesce("component_id", F.col(key)).alias("component_id")))
    return out.withColumn("kept", F.col(key).eqNullSafe(F.col("component_id"))).withColumnRenamed(key, asked)


def first_of_each(df: DataFrame, key: str = "doc_id", most_broadcast: int = 1_000_000, **options) -> DataFrame:
    """The rows of ``df`` that their component keeps, one for each key, with all columns.

    Of rows that repeat a kept key the one with the least text stays, by all its columns if texts are
    equal. Null and empty texts stay, an empty table gives none. Only keys to be dropped or thinned are
    joined: broadcast if they are at most ``most_broadcast``, a number that is counted first, else shuffled.
    """
    text = options.get("text", "text")
    found = near_duplicates(df, key, most_broadcast=most_broadcast, **options)
    at, stays = scratch.fresh(df, "_key"), scratch.fresh(df, "_stays")
    keys = found.groupBy(F.col(key).alias(at)).agg(F.first("kept").alias(stays), F.count("*").alias("_rows"))
    odd = scratch.table(keys.filter(~F.col(stays) | (F.col("_rows") > 1)).drop("_rows"), "odd-keys")
    odd = F.broadcast(odd) if odd.count() <= most_broadcast else odd
    same = F.col(key).eqNullSafe(F.col(at))
    single = df.join(odd, same, "left_anti")
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns))
    first = F.min_by(row, F.struct(F.col(text).alias("t"), F.to_json(row, {"ignoreNullFields": "false"}).alias("j")))
    repeated = df.join(odd.filter(stays), same, "left_semi").groupBy(F.col(key).alias(at)).agg(first.alias(at + "row")).select(at + "row.*")
    return single.unionByName(repeated)
