"""N-gram Jaccard join with parity sketches.

Texts link when the Jaccard similarity of their sets of word shingles reaches a threshold
t.  Then their symmetric difference has at most D = (a + b) (1 - t) / (1 + t) shingles, where
a and b are the set sizes, and the sizes differ by a factor of t at most.

* Sketch.  Every shingle flips one bit of a parity sketch, so the Hamming distance of two
  sketches never exceeds the symmetric difference.
* Pigeonhole per size band.  The bits are cut into P = 2^j >= 1.25 (D + 1) blocks; a + b
  decides j, so both texts of a pair know it.  At least P - D blocks are equal, hence each
  text needs to publish its D + 1 rarest blocks only, in one order that all texts share:
  blocks with most shingles that are not frequent in the corpus come first, empty ones last.
  Blocks are very wide (the sketch is sparse), and their content travels as a 64-bit hash.
* Candidates.  Texts with equal sets count once.  In every group of one block, the members
  pair with its most typical one; links are verified and components taken.  Groups that then
  still hold several components compare what is outside the hub's component with all
  members, sketches first, in chunks; so no link between different components is lost, and
  links inside one component need not be listed.
* Verify.  The sketches' distance first, then the whole shingle sets.

The list of frequent shingles orders blocks and picks hubs and has no effect on results; it
is a mergeable summary over all texts, and its size is bounded (``FREQUENT``).
Shingles and sets are compared by 64-bit hashes.

A NULL text and a text without words have an empty set and link with nothing.  Repeated rows
are equal texts.  A NULL id is a text of its own and never names a component unless
all its members' ids are NULL.  Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exposure.llm import words as W
from exposure.llm.graph import components
from exposure.llm.shared import stored, text_megabytes

FREQUENT = 1 << 16
SPARE = 1.25
LEAST_LEVEL = 5
CHUNK = 256


def most_apart(total: int, percent: int) -> int:
    """Largest symmetric difference of two sets whose sizes add up to ``total``."""
    return total * (100 - percent) // (100 + percent)


def level_of(apart: int) -> int:
    return max(LEAST_LEVEL, math.ceil(math.log2(SPARE * (apart + 1))))


def bands(size: int, percent: int) -> list[tuple[int, int]]:
    """``(level, blocks to publish)`` for every size that a partner may have."""
    low, high = -(-size * percent // 100), size * 100 // percent
    widest = most_apart(size + high, percent)
    return [
        (level, min(widest, int((1 << level) / SPARE) - 1) + 1)
        for level in range(level_of(most_apart(size + low, percent)), level_of(widest) + 1)
    ]


def published(shingles: np.ndarray, common: np.ndarray, percent: int) -> np.ndarray:
    """Hashes of the blocks that a set publishes.  ``shingles`` are sorted; ``common`` flags frequent ones."""
    out = []
    for level, n in bands(len(shingles), percent):
        block = shingles >> np.uint64(64 - level)
        first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        seed = W.mix(block[first] + np.uint64(level << 40))
        keys = W.mix(np.bitwise_xor.reduceat(W.mix(shingles), first) + seed)
        rare = np.add.reduceat(~common, first, dtype=np.int64)
        filled = np.diff(np.concatenate([first, [len(shingles)]]))
        if n < len(first):
            keys = keys[np.lexsort((keys, -filled, -rare))[:n]]
        elif n > len(first):
            empty = np.setdiff1d(np.arange(1 << level, dtype=np.uint64), block[first])[: n - len(first)]
            keys = np.concatenate([keys, W.mix(empty + np.uint64((level << 40) + (1 << 39)))])
        out.append(keys)
    return np.concatenate(out)


def sketch_of(shingles: np.ndarray) -> np.ndarray:
    """Parity sketch, at least four bits per shingle; the halves of a longer one XOR to a shorter one."""
    bits = 1 << max(8, math.ceil(math.log2(4 * len(shingles))))
    odd = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8))


def sketch_distance(one: np.ndarray, other: np.ndarray) -> int:
    while len(one) > len(other):
        one = one[: len(one) // 2] ^ one[len(one) // 2:]
    while len(other) > len(one):
        other = other[: len(other) // 2] ^ other[len(other) // 2:]
    return int(np.bitwise_count(one ^ other).sum())


def _set_id(shingles: np.ndarray) -> np.uint64:
    return W.mix(np.bitwise_xor.reduce(W.mix(shingles)) + np.array([len(shingles)], np.uint64))[0]


def _signed(values) -> np.ndarray:
    return np.asarray(values, np.uint64).view(np.int64)


def _shingled(batch: pa.RecordBatch, shingle: int):
    texts = batch["text"].to_pylist()
    for a, b in W.in_pieces(texts):
        yield batch.slice(a, b - a), W.shingle_sets(W.read_words(texts[a:b], lower=True), shingle)


_PROFILE = "row long, doc {kind}, n long, set_id long, sketch binary, shingle long, seen long"


def profiles(docs: DataFrame, id_col: str, text_col: str, shingle: int = 5) -> DataFrame:
    """Per row its set's size, id and sketch; beside these, counts of shingles that recur in a batch."""
    rows = docs.select(
        F.xxhash64(id_col, text_col).alias("row"), F.col(id_col).alias("doc"), F.col(text_col).cast("binary").alias("text")
    )
    kind = dict(rows.dtypes)["doc"]

    def profile(batches):
        for batch in batches:
            for part, sets in _shingled(batch, shingle):
                nothing = pa.nulls(len(sets), pa.int64())
                yield pa.RecordBatch.from_arrays([
                    part["row"], part["doc"],
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([int(_set_id(s).view(np.int64)) if len(s) else None for s in sets], pa.int64()),
                    pa.array([sketch_of(s).tobytes() if len(s) else None for s in sets], pa.binary()),
                    nothing, nothing,
                ], names=["row", "doc", "n", "set_id", "sketch", "shingle", "seen"])
                every = np.sort(np.concatenate(sets)) if sets else np.empty(0, np.uint64)
                first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.empty(0, int)
                seen = np.diff(np.concatenate([first, [len(every)]])).astype(np.int64)
                often = np.flatnonzero(seen >= max(4, len(sets) // 256))
                none = pa.nulls(len(often), pa.int64())
                yield pa.RecordBatch.from_arrays([
                    none, pa.nulls(len(often), part.schema.field("doc").type), none, none, pa.nulls(len(often), pa.binary()),
                    pa.array(_signed(every[first[often]])), pa.array(seen[often]),
                ], names=["row", "doc", "n", "set_id", "sketch", "shingle", "seen"])

    return rows.mapInArrow(profile, _PROFILE.format(kind=kind))


def frequent_shingles(profile: DataFrame) -> np.ndarray:
    """The most frequent shingles, FREQUENT of them at most: a bounded list, for orders alone."""
    top = (
        profile.filter("seen IS NOT NULL").groupBy("shingle").agg(F.sum("seen").alias("seen"))
        .filter("seen >= 32").orderBy(F.desc("seen"), "shingle").limit(FREQUENT).select("shingle").toPandas()
    )
    return np.sort(top["shingle"].to_numpy(np.int64).view(np.uint64))


def _member(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def block_groups(docs: DataFrame, text_col: str, frequent: np.ndarray, percent: int, shingle: int, megabytes: float) -> DataFrame:
    """``(members)``: the sets that publish one block, most typical first; equal lists once."""
    buckets = np.uint64(max(64, math.ceil(megabytes / 8)))

    def publish(batches):
        for batch in batches:
            for _, sets in _shingled(batch, shingle):
                held = {}
                for s in sets:
                    if len(s):
                        held.setdefault(int(_set_id(s)), s)
                ids, sizes, keys, typical = [], [], [], []
                for name, s in held.items():
                    common = _member(s, frequent)
                    own = published(s, common, percent)
                    ids.append(name)
                    sizes.append(len(own))
                    keys.append(own)
                    typical.append(255 - int(255 * common.mean()))
                if not ids:
                    continue
                key, owner = np.concatenate(keys), np.repeat(np.arange(len(ids)), sizes)
                bucket = (key % buckets).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                key, owner, bucket = (key[order] >> np.uint64(32)).astype(np.uint32), owner[order], bucket[order]
                first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
                bounds = [*first.tolist(), len(bucket)]
                names, ranks = np.array(ids, np.uint64), np.array(typical, np.uint8)
                out = {"bucket": bucket[first], "sets": [], "ranks": [], "sizes": [], "keys": []}
                for a, b in zip(bounds, bounds[1:]):
                    who = np.flatnonzero(np.concatenate([[True], owner[a + 1:b] != owner[a:b - 1]])) + a
                    out["sets"].append(names[owner[who]].tobytes())
                    out["ranks"].append(ranks[owner[who]].tobytes())
                    out["sizes"].append(np.diff(np.concatenate([who, [b]])).astype(np.uint32).tobytes())
                    out["keys"].append(key[a:b].tobytes())
                yield pa.RecordBatch.from_pydict({k: pa.array(v, None if k == "bucket" else pa.binary()) for k, v in out.items()})

    def meet(table: pa.Table) -> pa.Table:
        def column(name, kind):
            return np.concatenate([np.frombuffer(x, kind) for x in table[name].to_pylist()])

        sizes = column("sizes", np.uint32)
        sets = np.repeat(column("sets", np.uint64), sizes)
        ranks = np.repeat(column("ranks", np.uint8), sizes)
        keys = column("keys", np.uint32)
        order = np.argsort(keys, kind="stable")
        at = np.flatnonzero(np.diff(keys[order]) == 0)
        shared = np.zeros(len(keys), bool)
        shared[at] = shared[at + 1] = True
        order = order[shared]
        keys, sets, ranks = keys[order], sets[order], ranks[order]
        order = np.lexsort((sets, ranks, keys))
        keys, sets = keys[order], sets[order]
        new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (sets[1:] != sets[:-1])]) if len(keys) else np.empty(0, bool)
        keys, sets = keys[new], sets[new]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, int)
        bounds = np.concatenate([first, [len(keys)]])
        some = np.flatnonzero(np.diff(bounds) > 1)
        names = np.add.reduceat(W.mix(sets), first)[some] if len(some) else np.empty(0, np.uint64)
        _, once = np.unique(names, return_index=True)
        lists = [_signed(sets[bounds[i]:bounds[i + 1]]) for i in some[once]]
        return pa.table({
            "name": pa.array(_signed(names[once])),
            "members": pa.array(lists, pa.list_(pa.int64())),
        })

    packed = docs.select(F.col(text_col).cast("binary").alias("text")).mapInArrow(
        publish, "bucket long, sets binary, ranks binary, sizes binary, keys binary"
    )
    groups = packed.groupBy("bucket").applyInArrow(meet, "name long, members array<long>")
    return groups.groupBy("name").agg(F.first("members").alias("members"))


def _near_enough(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs that their sizes and sketches do not rule out."""
    one = sketches.select(F.col("set_id").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("sketch_a"))
    other = sketches.select(F.col("set_id").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("sketch_b"))

    def near(batches):
        for batch in batches:
            sizes = zip(batch["n_a"].to_pylist(), batch["n_b"].to_pylist())
            both = zip(batch["sketch_a"].to_pylist(), batch["sketch_b"].to_pylist())
            keep = [
                sketch_distance(np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)) <= most_apart(m + n, percent)
                for (m, n), (x, y) in zip(sizes, both)
            ]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    fits = (F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
    return pairs.join(one, "a").join(other, "b").filter(fits).mapInArrow(near, "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose whole shingle sets reach the threshold."""

    def exact(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch["set_a"].to_pylist(), batch["set_b"].to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                same = int(_member(x, y).sum())
                keep.append(100 * same >= percent * (len(x) + len(y) - same))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = sets.select(F.col("set_id").alias("a"), F.col("shingles").alias("set_a"))
    other = sets.select(F.col("set_id").alias("b"), F.col("shingles").alias("set_b"))
    return pairs.join(other, "b").join(one, "a").select("a", "b", "set_a", "set_b").mapInArrow(exact, "a long, b long")


def _whole_sets(docs: DataFrame, id_col: str, text_col: str, profile: DataFrame, needed: DataFrame, shingle: int) -> DataFrame:
    """``(set_id, shingles)`` of the needed sets, from one text of each."""
    owners = (
        profile.filter("set_id IS NOT NULL").groupBy("set_id").agg(F.min("row").alias("row"))
        .join(needed, "set_id", "left_semi").select("row")
    )
    rows = docs.select(F.xxhash64(id_col, text_col).alias("row"), F.col(text_col).cast("binary").alias("text"))

    def whole(batches):
        for batch in batches:
            for _, sets in _shingled(batch, shingle):
                yield pa.RecordBatch.from_arrays([
                    pa.array([int(_set_id(s).view(np.int64)) for s in sets], pa.int64()),
                    pa.array([s.tobytes() for s in sets], pa.binary()),
                ], names=["set_id", "shingles"])

    return rows.join(owners, "row", "left_semi").select("text").mapInArrow(whole, "set_id long, shingles binary")


def _loose_pairs(groups: DataFrame, roots: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Across components, the pairs of one group that sizes and sketches do not rule out.

    Members outside the hub's component meet all members, chunk by chunk.
    """
    member = groups.filter(F.size("members") > 2).select("name", F.posexplode("members").alias("at", "set_id"))
    placed = member.join(roots.withColumnRenamed("node", "set_id"), "set_id", "left").select(
        "name", "at", "set_id", F.coalesce("root", "set_id").alias("root")
    )
    mixed = placed.groupBy("name").agg(
        F.count("*").alias("size"), F.min("root").alias("low"), F.max("root").alias("high"),
        F.max(F.when(F.col("at") == 0, F.col("root"))).alias("hub_root"),
    ).filter("low < high")
    # narrow rows up to here; the sketches join what is left and move once
    placed = placed.join(mixed.select("name", "size", "hub_root"), "name").join(
        sketches, "set_id"
    ).withColumn("chunks", F.ceil(F.col("size") / CHUNK).cast("int"))
    chunk = F.pmod(F.xxhash64("set_id", "name"), F.col("chunks")).cast("int")
    keep = ["name", "set_id", "n", "sketch", "root"]
    steps = F.sequence(F.lit(0), F.col("chunks") - 1)
    mine = F.transform(steps, lambda s: F.struct(s.alias("i"), chunk.alias("j"), F.lit(False).alias("loose")))
    theirs = F.transform(steps, lambda s: F.struct(chunk.alias("i"), s.alias("j"), F.lit(True).alias("loose")))
    both = F.when(F.col("root") != F.col("hub_root"), F.concat(mine, theirs)).otherwise(mine)
    dealt = placed.select(*keep, F.inline(both))

    def compare(table: pa.Table) -> pa.Table:
        flag = table["loose"].to_numpy(zero_copy_only=False)
        ids, n = table["set_id"].to_numpy(), table["n"].to_numpy()
        root = table["root"].to_numpy()
        sketch = [np.frombuffer(x, np.uint8) for x in table["sketch"].to_pylist()]
        bytes_of = np.array([len(x) for x in sketch])
        left, right = np.flatnonzero(flag), np.flatnonzero(~flag)
        found = []
        for size in np.unique(bytes_of[right]):
            there = right[bytes_of[right] == size]
            matrix = {int(size): np.stack([sketch[y] for y in there])}
            for x in left:
                if not size // 2 <= bytes_of[x] <= size * 2:  # too far apart in size
                    continue
                narrow = int(min(size, bytes_of[x]))
                if narrow not in matrix:
                    matrix[narrow] = matrix[int(size)][:, :narrow] ^ matrix[int(size)][:, narrow:]
                own = sketch[x] if bytes_of[x] == narrow else sketch[x][:narrow] ^ sketch[x][narrow:]
                apart = np.bitwise_count(matrix[narrow] ^ own).sum(axis=1, dtype=np.int64)
                fits = (root[there] != root[x]) & (apart <= (n[there] + n[x]) * (100 - percent) // (100 + percent))
                fits &= np.minimum(n[there], n[x]) * 100 >= np.maximum(n[there], n[x]) * percent
                found += [(min(ids[x], ids[y]), max(ids[x], ids[y])) for y in there[fits]]
        pairs = np.array(sorted(set(found)), np.int64).reshape(-1, 2)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return dealt.groupBy("name", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def _labelled(docs: DataFrame, percent: int, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """``(row, doc, n, root)``, one row per input row; linked texts share a root, texts without words have none."""
    profile = stored(profiles(docs, id_col, text_col, shingle))
    frequent = frequent_shingles(profile)
    own = profile.filter("n IS NOT NULL")
    sketches = own.filter("n > 0").groupBy("set_id").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    groups = stored(block_groups(docs, text_col, frequent, percent, shingle, text_megabytes(docs, text_col)))
    star = groups.select(F.col("members")[0].alias("a"), F.explode(F.slice("members", 2, F.size("members"))).alias("b")).distinct()
    star = stored(_near_enough(star, sketches, percent))
    needed = groups.select(F.explode("members").alias("set_id")).distinct()
    sets = stored(_whole_sets(docs, id_col, text_col, own, needed, shingle))
    links = stored(_verified(star, sets, percent))
    roots = stored(components(links))
    loose = stored(_loose_pairs(groups, roots, sketches, percent))
    if not loose.isEmpty():
        links = links.union(_verified(loose, sets, percent))
        roots = stored(components(links))
    return own.join(roots.withColumnRenamed("node", "set_id"), "set_id", "left").select(
        "row", "doc", "n", F.coalesce("root", "set_id").alias("root")
    )


def jaccard_components(
    docs: DataFrame, percent: int = 75, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(doc, n_shingles, component)``, one row per input row; the component is its smallest id."""
    labelled = _labelled(docs, percent, shingle, id_col, text_col).select("doc", "n", "root")
    least = labelled.filter("root IS NOT NULL").groupBy("root").agg(F.min("doc").alias("component"))
    return labelled.join(least, "root", "left").select(
        "doc", F.col("n").alias("n_shingles"), F.coalesce("component", "doc").alias("component")
    )


def spare_rows(
    docs: DataFrame, percent: int = 75, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(row, doc, stays)``: rows (``row`` = xxhash64 of id and text) of which copies go.

    Of each group of linked rows the first by id, then by ``row``, stays; NULL ids come last.
    All others are listed with ``stays`` false.  Where a row that stays has a NULL id and is
    there more than once, it is listed with ``stays`` true: one of its copies stays.
    """
    labelled = _labelled(docs, percent, shingle, id_col, text_col).filter("root IS NOT NULL")
    place = F.struct(F.col("doc").isNull().alias("unnamed"), "doc", "row")
    best = labelled.groupBy("root").agg(F.min(place).alias("best"))
    judged = labelled.join(best, "root").select("row", "doc", (place == F.col("best")).alias("stays"))
    return (
        judged.filter("NOT stays OR doc IS NULL").groupBy("row", "doc", "stays").agg(F.count("*").alias("n"))
        .filter("NOT stays OR n > 1").select("row", "doc", "stays")
    )
