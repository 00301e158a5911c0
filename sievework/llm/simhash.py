"""SimHash near-duplicates by a Gray-order hierarchical index.

Every text becomes a 64-bit fingerprint. Fingerprints that differ in at most `bits` places link. To spread the search, the
64 places are cut into blocks; two linked fingerprints agree on at least (blocks - bits) whole blocks, so each distinct
fingerprint is dealt once for each choice of that many blocks, and a link is sure to meet in one of the groups. This deal
decides which fingerprints meet at all, and keeps most unlike ones apart; the index prunes what is left inside the groups.

The search itself is the index. Members are sorted by (group, Gray rank); runs of up to FANOUT neighbours become nodes that
hold the bits all their members share, runs of nodes become upper nodes, up to one root for each group. All groups of a
batch form one forest, which is descended from the pairs (root, root): a pair of nodes whose shared bits already differ in
too many places is pruned with everything below it. Links feed a union-find as they come, so they are never held, and a
group's links are reduced to one edge from each member to the smallest of its part; no group emits its pairs.

Groups above a cap are not gathered: their members are dealt again by more blocks, and again, until the places left free
bound a group by 2^16 members. Components of the edges come from label joins and pointer jumps over tables in the shared
folder.

Defined cases: a null or empty text has no words and fingerprint zero, and links like any other; fewer words than a
shingle has make one shingle; repeated rows share their fingerprint and so their component; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import drop, keep_least, map_batches, materialize, parts, raw_texts, row_hash

SEED = 42
#: Members of a group that one task gathers; larger groups are dealt again by more blocks.
GROUP_CAP = 8192
#: Masks that go first where there are many.
FIRST_MASKS = 8
#: Children of a node in the index; pairs of nodes that are looked at at once.
FANOUT, CHUNK = 16, 1 << 20
#: Free places that bound a group well enough to gather it.
FREE = 16


def simhash(text: bytes, shingle: int) -> int:
    """The fingerprint of one UTF-8 text: bit b is set if it is set in over half the shingles' XXH64."""
    words = text.lower().split()
    if not words:
        return 0
    digest, n = xxhash.xxh64_digest, len(words)
    if n < shingle:
        raw = digest(b" ".join(words), SEED)
    elif shingle == 3:
        raw = b"".join([digest(b"%b %b %b" % w, SEED) for w in zip(words, words[1:], words[2:])])
    else:
        raw = b"".join([digest(b" ".join(words[i : i + shingle]), SEED) for i in range(n - shingle + 1)])
    count = np.zeros(64, np.int64)
    table = np.frombuffer(raw, np.uint8).reshape(-1, 8)
    for i in range(0, len(table), 1 << 16):
        count += np.unpackbits(table[i : i + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * count > len(table))
    return int.from_bytes(bits.tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, row, fingerprint bigint) of every row of docs; row is the hash of all its columns."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = np.array([simhash(t, shingle) for t in raw_texts(batch.column(2))], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values)], ["doc_id", "row", "fingerprint"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_hash(docs).alias("row"), F.col("text").cast("string").alias("text"))
    return map_batches(rows, one, "doc_id long, row long, fingerprint long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _masks(free: list[int], bits: int, extra: int) -> list[int]:
    """Masks over the free places of which at least one agrees for any two values that differ in at most `bits` of them."""
    n = min(len(free), bits + extra)
    if n <= bits:
        return [0]
    cut = [round(i * len(free) / n) for i in range(n + 1)]
    blocks = [sum(1 << p for p in free[a:b]) for a, b in zip(cut, cut[1:])]
    return [sum(c) for c in combinations(blocks, n - bits)]


def first_masks(bits: int) -> list[int]:
    """Masks of the first deal."""
    return _masks(list(range(64)), bits, 2 if bits <= 3 else 3)


def finer_masks(mask: int, bits: int) -> list[int]:
    """Masks of the next deal of a group that agrees on the mask's places."""
    return [mask | x for x in _masks([p for p in range(64) if not mask >> p & 1], bits, 2)]


def gray_rank(values: np.ndarray) -> np.ndarray:
    """Place of each value in the order of the binary-reflected Gray code."""
    rank = values.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def _forest(values: np.ndarray, starts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The index of consecutive groups that begin at `starts`, leaves first: the pattern and the mask of shared places of
    each node, where its children begin on the level below, and how many they are. The last level has a root a group."""
    sizes = np.diff(np.append(starts, len(values)))
    none = np.empty(0, np.int64)
    levels = [(values, np.full(len(values), ~np.uint64(0)), none, none)]
    while len(levels) == 1 or (sizes > 1).any():
        pattern, mask = levels[-1][:2]
        many = -(-sizes // FANOUT)
        ends = np.cumsum(many)
        inside = np.arange(ends[-1]) - np.repeat(ends - many, many)
        first = np.repeat(starts, many) + inside * FANOUT
        ones = np.bitwise_and.reduceat(pattern & mask, first)
        zeros = np.bitwise_and.reduceat(~pattern & mask, first)
        levels.append((ones, ones | zeros, first, np.diff(np.append(first, len(pattern)))))
        starts, sizes = ends - many, many
    return levels


def links(values: np.ndarray, bits: int, starts: np.ndarray | None = None, chunk: int = CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places, each once, of values of one group that differ in at most `bits` bits, in bounded chunks.

    Values are distinct and Gray-sorted within their groups, which begin at `starts` (without it there is one group).
    """
    levels = _forest(values, np.zeros(1, np.int64) if starts is None else starts)
    roots = np.arange(len(levels[-1][0]))
    todo = [(len(levels) - 1, roots, roots)]
    while todo:
        level, a, b = todo.pop()
        if level == 0:
            yield a, b
            continue
        first, count = levels[level][2:]
        total = count[a] * count[b]
        if len(a) > 1 and total.sum() > chunk:
            part = np.cumsum(total) // chunk
            cut = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(a)]
            todo += [(level, a[i:j], b[i:j]) for i, j in zip(cut, cut[1:])] if len(cut) > 2 else [(level, a[: len(a) // 2], b[: len(a) // 2]), (level, a[len(a) // 2 :], b[len(a) // 2 :])]
            continue
        k = np.arange(total.sum()) - np.repeat(np.cumsum(total) - total, total)
        wide = np.repeat(count[b], total)
        left, right = np.repeat(first[a], total) + k // wide, np.repeat(first[b], total) + k % wide
        good = left < right if level == 1 else left <= right
        left, right = left[good], right[good]
        pattern, mask = levels[level - 1][:2]
        good = np.bitwise_count((pattern[left] ^ pattern[right]) & mask[left] & mask[right]) <= bits
        if good.any():
            todo.append((level - 1, left[good], right[good]))


def _joined(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The root of each of n places when the pairs are joined, chunk by chunk."""
    parent = np.arange(n)

    def roots(x: np.ndarray) -> np.ndarray:
        up = parent[x]
        while (up != (above := parent[up])).any():
            up = above
        return up

    for a, b in pairs:
        while len(a):
            ra, rb = roots(a), roots(b)
            apart = ra != rb
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
    return roots(np.arange(n))


def _smallest(group: np.ndarray, values: np.ndarray, labels: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(label, smaller label) of rows (group, value, label), groups together: each label and the smallest that its value
    reaches inside its group."""
    order = np.lexsort((gray_rank(values), group))
    group, values, labels = group[order], values[order], labels[order]
    once = np.concatenate([[True], (group[1:] != group[:-1]) | (values[1:] != values[:-1])])
    group, values, labels = group[once], values[once], labels[once]
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    root = _joined(len(values), links(values, bits, starts))
    best = labels.copy()
    np.minimum.at(best, root, labels)
    keep = best[root] != labels
    return labels[keep], best[root][keep]


def _group_edges(batches: Iterator[pa.RecordBatch], bits: int, cap: int | None) -> Iterator[pa.RecordBatch]:
    """Over rows (mask, part, fingerprint, label) sorted by (mask, part): edges (0, label, smaller label), each between
    labels that meet in a group, or (1, member, mask) of groups above the cap."""

    def flush(kind: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        both = np.unique(np.stack([a.view(np.uint64), b.view(np.uint64)], 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(both), kind, np.int32)), *(pa.array(np.ascontiguousarray(both[:, i]).view(np.int64)) for i in range(2))], ["kind", "a", "b"])

    open_: list[tuple[np.ndarray, ...]] = []  # rows of the group that may go on in the next batch
    key, hot = None, False

    def searched(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        rows = [np.concatenate(x) for x in zip(*parts)]
        mask, part, fp, label = rows
        new = np.concatenate([[True], (mask[1:] != mask[:-1]) | (part[1:] != part[:-1])])
        a, b = _smallest(np.cumsum(new), fp.view(np.uint64), label.view(np.uint64), bits)
        if len(a):
            yield flush(0, a, b)

    for batch in batches:
        rows = tuple(np.asarray(batch.column(i)).astype(np.int64) for i in range(4))
        mask, part, fp, _ = rows
        if not len(mask):
            continue
        cut = np.concatenate([[0], np.flatnonzero((mask[1:] != mask[:-1]) | (part[1:] != part[:-1])) + 1, [len(mask)]])
        whole = []  # rows of groups that end in this batch
        if key is not None and (mask[0], part[0]) != key:
            if open_ and not hot:
                whole.append(tuple(np.concatenate(x) for x in zip(*open_)))
            open_, hot = [], False
        last = int(cut[-2])
        head = int(cut[1]) if len(cut) > 2 else 0
        if head and (open_ or hot):  # the open group ends here
            if hot:
                yield flush(1, fp[:head], mask[:head])
            else:
                whole.append(tuple(np.concatenate(x) for x in zip(*open_, tuple(c[:head] for c in rows))))
            open_, hot = [], False
        else:
            head = 0
        if last > head:
            whole.append(tuple(c[head:last] for c in rows))
        key = (mask[last], part[last])
        open_.append(tuple(c[last:] for c in rows))
        if cap is not None and (hot or sum(len(x[0]) for x in open_) > cap):
            hot = True
            held = [np.concatenate(x) for x in zip(*open_)]
            yield flush(1, held[2], held[0])
            open_ = []
        if cap is not None and whole:  # groups inside one batch may be above the cap as well
            kept = []
            for rows_ in whole:
                new = np.concatenate([[True], (rows_[0][1:] != rows_[0][:-1]) | (rows_[1][1:] != rows_[1][:-1])])
                size = np.diff(np.append(np.flatnonzero(new), len(new)))
                large = np.repeat(size > cap, size)
                if large.any():
                    yield flush(1, rows_[2][large], rows_[0][large])
                kept.append(tuple(c[~large] for c in rows_))
            whole = [x for x in kept if len(x[0])]
        if whole:
            yield from searched(whole)
    if open_ and not hot:
        yield from searched(open_)


def edges(labelled: DataFrame, bits: int, masks: list[int], cap: int = GROUP_CAP) -> DataFrame:
    """(a, b): edges between labels of fingerprints that meet in a group of one of the masks; `labelled` has (fingerprint, label).

    With all the masks the edges connect exactly what links of at most `bits` differing bits connect.
    """
    spark = labelled.sparkSession

    def search(rows: DataFrame, limit: int | None) -> DataFrame:
        keyed = rows.select("mask", F.col("fingerprint").bitwiseAND(F.col("mask")).alias("part"), "fingerprint", "label")
        grouped = keyed.repartition(max(parts(spark), 1), "mask", "part").sortWithinPartitions("mask", "part")
        found = grouped.mapInArrow(lambda it: _group_edges(it, bits, limit), "kind int, a long, b long")
        return materialize(found, "simhash-links")

    found = search(labelled.select("fingerprint", "label", F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("mask")), cap)
    out = found.where("kind = 0").select("a", "b")
    while True:
        hot = found.where("kind = 1").select(F.col("a").alias("f"), F.col("b").alias("mask")).distinct()
        again = [r.mask & (1 << 64) - 1 for r in hot.select("mask").distinct().collect()]  # some of the masks dealt last
        if not again:
            return out.distinct()
        next_ = {m: finer_masks(m, bits) for m in again}
        finer = F.create_map(*[x for m, fine in next_.items() for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(x)) for x in fine]))])
        rows = hot.join(labelled, F.col("f") == F.col("fingerprint")).select("fingerprint", "label", F.explode(F.element_at(finer, F.col("mask"))).alias("mask"))
        bounded = all(64 - x.bit_count() <= FREE or x in next_ for fine in next_.values() for x in fine)
        found = search(rows, None if bounded else cap)
        out = out.unionByName(found.where("kind = 0").select("a", "b"))


def linked(distinct: DataFrame, bits: int, cap: int = GROUP_CAP) -> DataFrame:
    """(fingerprint, root) of all fingerprints of `distinct` that link to another.

    Where there are many masks, a few of them go first: what they connect carries one label in the second round, so
    members of a dense group are not linked again under every mask.
    """
    masks = first_masks(bits)
    some = masks[:: max(1, len(masks) // FIRST_MASKS)] if len(masks) > 2 * FIRST_MASKS else masks
    rest = [m for m in masks if m not in set(some)]
    found = components(edges(distinct.select("fingerprint", F.col("fingerprint").alias("label")), bits, some, cap), "near")
    if not rest:
        return found.select(F.col("node").alias("fingerprint"), "root")
    one = distinct.select("fingerprint").join(found, distinct.fingerprint == found.node, "left").select("fingerprint", F.coalesce("root", "fingerprint").alias("label"))
    one = materialize(one, "simhash-labels")
    more = components(edges(one, bits, rest, cap), "nearer").select("node", F.col("root").alias("far"))
    both = one.join(more, one.label == more.node, "left").select("fingerprint", F.coalesce("far", "label").alias("root"))
    # A root that no other fingerprint shares has no links.
    kept = both.where(F.col("root") != F.col("fingerprint"))
    return kept.unionByName(kept.select(F.col("root").alias("fingerprint"), "root").distinct())


def components(links_: DataFrame, label: str = "components") -> DataFrame:
    """(node, root) of every node that has an edge (a, b): root is the smallest node reachable.

    Each round takes the smallest label among neighbours, gives it to the node and to the node's old root as well (so that
    whole trees are hooked and rounds do not follow the length of a chain), and then the label's own label (pointer jump).
    Rounds go on until no label changes; labels only fall, so that comes. Joins are plain shuffles of narrow rows, which
    Spark may split.
    """
    both = materialize(links_.select("a", "b").union(links_.select("b", "a")).distinct(), f"{label}-edges")
    nearest = both.groupBy("a").agg(F.min("b").alias("b"))
    now = materialize(nearest.select(F.col("a").alias("node"), F.least("a", "b").alias("root")), f"{label}-0")
    changed, i = True, 0
    while changed:
        i += 1
        said = both.join(now, both.b == now.node).groupBy("a").agg(F.min("root").alias("near"))
        low = now.join(said, now.node == said.a, "left").select("node", F.least("root", F.coalesce("near", "root")).alias("low"), F.col("root").alias("was"))
        # Each node's own row keeps what it was; a row for its old root hooks that one.
        told = low.select(F.explode(F.array(F.struct("node", "low", "was"), F.struct(F.col("was").alias("node"), "low", F.lit(None).cast("long").alias("was")))).alias("x")).select("x.*")
        told = told.groupBy("node").agg(F.min("low").alias("root"), F.max("was").alias("was"))
        up = now.select(F.col("node").alias("up"), F.col("root").alias("above"))
        jumped = told.join(up, told.root == up.up, "left").select("node", F.least("root", F.coalesce("above", "root")).alias("root"), "was")
        new = materialize(jumped, f"{label}-{i}")
        changed = not new.where("root <> was").isEmpty()
        drop(now)
        now = new
    return now.select("node", "root")


def near_duplicates(docs: DataFrame, shingle: int = 3, bits: int = 2, cap: int = GROUP_CAP) -> DataFrame:
    """(doc_id, fingerprint bigint, component_id): component_id is the smallest doc_id reachable over links, itself included."""
    marked = materialize(fingerprints(docs, shingle), "simhash")
    distinct = marked.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id"))
    roots = materialize(linked(distinct.select("fingerprint"), bits, cap), "simhash-roots")
    # Only fingerprints with links need a look at others; the minimum is combined before it is shuffled.
    ids = roots.join(distinct, "fingerprint").groupBy(F.col("root").alias("of")).agg(F.min("first_id").alias("component_id"))
    ids = materialize(ids, "simhash-components")
    named = materialize(roots.join(ids, roots.root == ids.of).select(F.col("fingerprint").alias("named"), "component_id"), "simhash-named")
    alone = distinct.select(F.col("fingerprint").alias("one"), "first_id")
    every = alone.join(named, alone.one == named.named, "left").select("one", F.coalesce("component_id", "first_id").alias("component_id"))
    every = materialize(every, "simhash-all")
    return marked.join(every, marked.fingerprint == every.one).select("doc_id", "fingerprint", "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, bits: int = 6) -> DataFrame:
    """docs, all columns, of which each component keeps one row: that of the smallest doc_id, then of the smallest hash.

    Rows that share a doc_id, or have none, are documents each.
    """
    own = materialize(fingerprints(docs, shingle), "simhash")
    roots = linked(own.select("fingerprint").distinct(), bits)
    return keep_least(docs, own.join(roots, "fingerprint", "left").select("doc_id", "row", F.coalesce("root", "fingerprint").alias("root")))


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    """Contract query: three-word shingles, links at two or fewer differing bits, over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = near_duplicates(docs.select("doc_id", "text"), shingle=3, bits=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
