"""Near copies: documents linked at an exact five-word Jaccard likeness of 0.8 or more.

Every text becomes the set of its shingles' hashes; texts of one set are one node. Of two sets of the likeness the larger
must have, among its first fifth in any one order of shingles, one of the smaller's first ninth (prefix filter), so nodes
are dealt by those shingles and no pair is missed. The order puts shingles that a sample finds common last: groups stay
small, whatever is sampled. Inside a group pairs are left out whose sizes, or whose sketches (parities of 512 cells, which
bound from below how many shingles two sets do not share), rule the likeness out. What is left is verified on the texts'
shingle sets.

Verification goes in rounds, so that dense groups come together by few pairs: the links of the SimHash components; then,
again and again while that finds links, each node with the few likeliest of each of its groups in other components (the one
that most others may be like, and those whose sketches are nearest); at last all pairs that are still in different
components. Pairs inside a component change nothing, so components are those of all links.

Defined cases: a null text is an empty one; texts without words are one node; fewer words than a shingle has make one
shingle; equal texts are one node however many rows have them. A row is known by its doc_id and a hash of all its columns,
so rows that share a doc_id, or have none, are documents each; a doc_id must be a whole number. An empty table gives an
empty result; other columns are kept by keep_one whatever their names, and ignored by near_copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import drop, keep_least, map_batches, materialize, parts, raw_texts, row_hash, shuffles_freed, sorted_run, unbroadcast
from sievework.llm.simhash import SEED, components, linked, simhash

#: Words of a shingle.
WORDS = 5
#: Likeness, as a fraction of whole numbers.
OVER, UNDER = 4, 5
#: Documents sampled for common shingles; how often a shingle is common; shingles kept (16 bytes each on the driver).
SAMPLE, COMMON, MOST = 20_000, 4, 200_000
#: Cells of a sketch.
CELLS = 512
#: In a round of likeliest pairs: pairs for each node of a group; rounds at most; they end when fewer than one pair in so
#: many is a link.
NEAREST, ROUNDS, WORTH = 3, 4, 20
#: Pairs that a task holds before it sends them on.
CHUNK = 1 << 20


def shingle_set(text: bytes) -> np.ndarray:
    """Sorted distinct XXH64 of the text's shingles."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_digest
    if len(words) < WORDS:
        raw = digest(b" ".join(words), SEED)
    else:
        raw = b"".join([digest(b"%b %b %b %b %b" % w, SEED) for w in zip(*(words[i:] for i in range(WORDS)))])
    return np.unique(np.frombuffer(raw, ">u8").astype(np.uint64))


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the Jaccard likeness of two sets is at least OVER / UNDER."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return UNDER * both >= OVER * (len(a) + len(b) - both)


def sketch(own: np.ndarray) -> bytes:
    return np.packbits(np.bincount((own & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS) & 1).tobytes()


def prefix(own: np.ndarray, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first shingles of a set: common ones (sorted by hash, each with its rank) come last, others by hash."""
    n = len(own)
    many = n - -(-OVER * n // UNDER) + 1 if n else 0
    if not len(common):
        return own[:many]
    at = np.minimum(np.searchsorted(common, own), len(common) - 1)
    place = np.where(common[at] == own, rank[at] + 1, 0)
    return own[np.argsort(place, kind="stable")[:many]]


def inner(n: np.ndarray) -> np.ndarray:
    """How many of a set's first shingles must hold one of the first of any set that is like it and not smaller."""
    return n - -(-2 * OVER * n // (OVER + UNDER)) + 1


def _common(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that a bounded sample finds in several documents, sorted, and their ranks by how often."""
    total = docs.count()
    share = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, SAMPLE / max(total, 1)))

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(t) for t in raw_texts(batch.column(0))]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], ["h"])

    seen = map_batches(docs.where(share).select(F.col("text").cast("string")), one, "h long").groupBy("h").agg(F.count("*").alias("n"))
    with shuffles_freed(docs.sparkSession):
        rows = seen.where(F.col("n") >= COMMON).orderBy(F.desc("n"), "h").limit(MOST).toArrow()
    h, n = rows.column("h").to_numpy().view(np.uint64), rows.column("n").to_numpy()
    rank = np.empty(len(h), np.int64)
    rank[np.lexsort((h, n))] = np.arange(len(h))
    order = np.argsort(h)
    return h[order], rank[order]


def marked(docs: DataFrame) -> DataFrame:
    """(doc_id, row, node, n, sketch, prefix, fingerprint, text) of every row: row is the hash of all columns, node the
    digest of its shingle set, n the set's size, fingerprint the three-word SimHash."""
    sent = docs.sparkSession.sparkContext.broadcast(_common(docs))

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        common, rank = sent.value
        texts = raw_texts(batch.column(2))
        sets = [shingle_set(t) for t in texts]
        node = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
        prints = np.array([simhash(t, 3) for t in texts], np.uint64).view(np.int64)
        columns = [pa.array(node), pa.array([len(s) for s in sets], pa.int64()), pa.array([sketch(s) for s in sets], pa.binary()), pa.array([prefix(s, common, rank).tobytes() for s in sets], pa.binary()), pa.array(prints)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns, batch.column(2)], ["doc_id", "row", "node", "n", "sketch", "prefix", "fingerprint", "text"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_hash(docs).alias("row"), F.col("text").cast("string").alias("text"))
    return map_batches(rows, one, "doc_id long, row long, node long, n long, sketch binary, prefix binary, fingerprint long, text string")


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by (h, node) in stretches that hold whole groups of h, each node once in a group."""
    held: list[pa.Table] = []
    last = None

    def once(tables: list[pa.Table]) -> pa.Table:
        rows = pa.concat_tables(tables).combine_chunks()
        h, node = (rows.column(i).to_numpy() for i in range(2))
        return rows.filter(pa.array(np.concatenate([[True], (h[1:] != h[:-1]) | (node[1:] != node[:-1])])))

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = once([pa.Table.from_batches([batch])])
        h = rows.column(0).to_numpy()
        start = int(np.flatnonzero(h == h[-1])[0])
        if held and h[0] != last:
            yield once(held)
            held = []
        if start:
            yield once([*held, rows.slice(0, start)])
            held = []
        held.append(rows.slice(start))
        last = h[-1]
    if held:
        yield once(held)


def _by_size(rows: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """The rows by (h, size, node), for each where its group starts, and how many of its group come from it on."""
    h, node, size = (rows.column(i).to_numpy() for i in range(3))
    order = np.lexsort((node, size >> 1, h))
    h = h[order]
    cut = np.flatnonzero(h[1:] != h[:-1]) + 1
    starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(h)]])
    group = np.repeat(np.arange(len(starts)), ends - starts)
    return rows.take(pa.array(order)), starts[group], ends[group] - np.arange(len(h))


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (h, node, size), where size is twice n, and one more if h is among the node's inner ones, those that may
    link to another of their group: an inner one with a larger one near enough, or one with such a smaller one."""
    for rows in _whole_groups(batches):
        rows, start, left = _by_size(rows)
        size = rows.column(2).to_numpy()
        n, is_inner = size >> 1, (size & 1).astype(bool)
        keep = np.zeros(len(n), bool)
        keep[:-1] = is_inner[:-1] & (left[:-1] > 1) & (OVER * n[1:] <= UNDER * n[:-1])
        last = np.maximum.accumulate(np.where(is_inner, np.arange(len(n)), -1))
        before = np.concatenate([[-1], last[:-1]])
        good = before >= start
        keep[good] |= OVER * n[good] <= UNDER * n[before[good]]
        yield from rows.filter(pa.array(keep)).to_batches()


def _steps(rows: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of places, and in how many cells their sketches differ, in each step each place at most once on either side, of nodes of different labels that may have
    the likeness, over rows (h, node, size, label, sketch) in the order of _by_size."""
    size, label = rows.column(2).to_numpy(), rows.column(3).to_numpy()
    n, is_inner = size >> 1, (size & 1).astype(bool)
    h = rows.column(0).to_numpy()
    ends = np.concatenate([np.flatnonzero(h[1:] != h[:-1]) + 1, [len(h)]])
    left = ends[np.searchsorted(ends, np.arange(len(h)), side="right")] - np.arange(len(h))
    cells = np.frombuffer(b"".join(rows.column(4).to_pylist()), np.uint64).reshape(len(h), -1)
    at, step = np.flatnonzero(is_inner), 0
    while True:
        step += 1
        at = at[left[at] > step]
        at = at[OVER * n[at + step] <= UNDER * n[at]]  # sizes rise, so who fails here fails further on
        if not len(at):
            return
        good = label[at] != label[at + step]
        x = at[good]
        y = x + step
        apart = np.bitwise_count(cells[x] ^ cells[y]).sum(axis=1, dtype=np.int64)
        good = (OVER + UNDER) * apart <= (UNDER - OVER) * (n[x] + n[y])
        yield x[good], y[good], apart[good]


def _likeliest(rows: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each place the one of its group that most others may be like, and those NEAREST whose sketches differ least for
    their sizes."""
    n = rows.column(2).to_numpy() >> 1
    node = rows.column(1).to_numpy()
    degree = np.zeros(len(node), np.int64)
    near, far = np.full((len(node), NEAREST), -1), np.full((len(node), NEAREST), np.inf)
    for x, y, apart in _steps(rows):
        degree[x] += 1
        degree[y] += 1
        share = apart / (n[x] + n[y])
        for i, j in ((x, y), (y, x)):  # a place is at most once on either side, so rows of i are distinct
            worse = far[i].argmax(axis=1)
            better = share < far[i, worse]
            at, slot = i[better], worse[better]
            far[at, slot], near[at, slot] = share[better], j[better]
    best = np.full(len(node), -1)
    for x, y, _ in _steps(rows):
        for i, j in ((x, y), (y, x)):
            was = best[i]
            better = (was < 0) | (degree[j] > degree[was]) | (degree[j] == degree[was]) & (node[j] < node[was])
            best[i[better]] = j[better]
    every = np.concatenate([best[:, None], near], axis=1)
    x, k = np.nonzero(every >= 0)
    return [(x, every[x, k])]


def _pairs(batches: Iterator[pa.RecordBatch], star: bool) -> Iterator[pa.RecordBatch]:
    """Over rows (h, node, size, label, sketch): pairs of nodes of different labels that may have the likeness; with
    `star` only the likeliest few of each node."""

    def flush(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
        one, two = np.concatenate(a), np.concatenate(b)
        both = np.unique(np.stack([np.minimum(one, two), np.maximum(one, two)], 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(both[:, i])) for i in range(2)], ["a", "b"])

    a, b, many = [], [], 0
    for rows in _whole_groups(batches):
        rows, _, _ = _by_size(rows)
        node = rows.column(1).to_numpy()
        for x, y in _likeliest(rows) if star else ((x, y) for x, y, _ in _steps(rows)):
            a.append(node[x])
            b.append(node[y])
            many += len(x)
            if many > CHUNK:
                yield flush(a, b)
                a, b, many = [], [], 0
    if many:
        yield flush(a, b)


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts have the likeness."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        known: dict[int, np.ndarray] = {}
        keep = []
        for x, y, left, right in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), raw_texts(batch.column(2)), raw_texts(batch.column(3))):
            for node, text in ((x, left), (y, right)):
                if node not in known:
                    known[node] = shingle_set(text)
            keep.append(alike(known[x], known[y]))
        return batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    first = texts.select(F.col("node").alias("a"), F.col("text").alias("left"))
    second = texts.select(F.col("node").alias("b"), F.col("text").alias("right"))
    return map_batches(pairs.join(second, "b").join(first, "a").select("a", "b", "left", "right"), one, "a long, b long")


def rooted(docs: DataFrame, bits: int = 6) -> DataFrame:
    """(doc_id, row, root) of every row of docs: rows of one root are those reachable over links.

    `bits` is of the SimHash components that are tried first; it changes the work, not the result.
    """
    with unbroadcast(docs.sparkSession):
        return _rooted(docs, bits)


def _rooted(docs: DataFrame, bits: int) -> DataFrame:
    spark = docs.sparkSession
    marks = materialize(marked(docs), "near-marks")

    def dealt(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw, n = batch.column(2), batch.column(1).to_numpy()
        many = np.array([len(x.as_buffer() or b"") // 8 for x in raw])
        place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        size = 2 * np.repeat(n, many) + (place < np.repeat(inner(n), many))
        columns = [np.frombuffer(b"".join(raw.to_pylist()), np.int64), np.repeat(batch.column(0).to_numpy(), many), size.astype(np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["h", "node", "size"])

    def grouped(rows: DataFrame) -> DataFrame:
        return rows.repartition(max(parts(spark), 1), "h").sortWithinPartitions("h", "node")

    rows = map_batches(marks.select("node", "n", "prefix"), dealt, "h long, node long, size int")
    groups = sorted_run(grouped(rows).mapInArrow(_shared, "h long, node long, size int").repartition(parts(spark), "node"), "near_groups", ["node"])
    texts = marks.select("node", "sketch", "fingerprint", "text").join(groups.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"])
    texts = sorted_run(texts, "near_texts", ["node"])
    nodes = materialize(marks.select("doc_id", "row", "node"), "near-nodes")
    drop(marks)  # what is held from here on are the texts that may have copies, once each

    def proposed(labels: DataFrame, star: bool) -> DataFrame:
        known = groups.join(labels, "node").select("h", "node", "size", "label", "sketch")
        return grouped(known).mapInArrow(lambda it: _pairs(it, star), "a long, b long").distinct()

    def labelled(roots: DataFrame) -> DataFrame:
        return texts.select("node", "sketch").join(roots.withColumnRenamed("root", "label"), "node", "left").select("node", F.coalesce("label", "node").alias("label"), "sketch")

    # The smallest node of a SimHash component stands for it. What later queries read is a table by now: else the plan of
    # each holds all that made it, and the driver keeps plans and their metrics long after.
    prints = materialize(linked(texts.select("fingerprint").distinct(), bits), "near-prints")
    centres = materialize(texts.select("node", "fingerprint").join(prints, "fingerprint", "left").select("node", F.coalesce("root", "fingerprint").alias("root")), "near-centres")
    pairs = centres.withColumnRenamed("node", "b").join(centres.groupBy("root").agg(F.min("node").alias("a")), "root").where("a <> b").select("a", "b")
    links = materialize(_verified(pairs, texts), "near-links")
    written = [prints, centres, links]
    roots = components(links, "near-components")
    tried: DataFrame | None = None

    def untried(labels: DataFrame, star: bool) -> DataFrame:
        found = proposed(labels, star)
        return found if tried is None else found.join(tried, ["a", "b"], "left_anti")

    for i in range(ROUNDS):
        pairs = materialize(untried(labelled(roots), True), f"near-tried-{i}")
        found = materialize(_verified(pairs, texts), f"near-links-{i}")
        tried = pairs if tried is None else tried.union(pairs)
        written += [pairs, found]
        new, asked = found.count(), pairs.count()
        if new:  # without new links components are those before
            links = links.union(found)
            roots = components(links, f"near-components-{i}")
        if new * WORTH < asked or not asked:
            break
    rest = materialize(untried(labelled(roots), False), "near-rest")
    found = materialize(_verified(rest, texts), "near-links-rest")
    if not found.isEmpty():
        roots = components(links.union(found), "near-all")
    out = materialize(nodes.join(roots, "node", "left").select("doc_id", "row", F.coalesce("root", "node").alias("root")), "near-roots")
    for table in (groups, texts, nodes, rest, found, *written):
        drop(table)
    return out


def near_copies(docs: DataFrame, bits: int = 6) -> DataFrame:
    """(doc_id, component_id) of every row: component_id is the smallest doc_id reachable over links, itself included;
    null if none of them has one."""
    every = rooted(docs, bits)
    ids = every.groupBy(F.col("root").alias("of")).agg(F.min("doc_id").alias("component_id"))
    return every.join(ids, every.root == ids.of).select("doc_id", "component_id")


def keep_one(docs: DataFrame, bits: int = 6) -> DataFrame:
    """docs, all columns, of which each group keeps one row: that of the smallest doc_id, then of the smallest hash."""
    return keep_least(docs, rooted(docs, bits))
