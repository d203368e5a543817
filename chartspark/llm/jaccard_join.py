"""N-gram Jaccard join with signature trees, exact and without all pairs of any group.

1. Every text becomes its set of word shingles, as 64-bit hashes. Equal sets form a class, which
   is one node from here on.
2. Blocks: of two sets that link, each holds a shingle of the other among its first
   |x| - ceil(percent * |x|) + 1 shingles, in any order common to all sets. The order puts shingles
   last that are frequent in some part of the corpus and in all of it (at most 1 / FREQUENT times
   the mean set size of them, so they can be broadcast), which keeps blocks small and changes no
   result. Blocks are found over ranges of equal size of the sorted (shingle, set) rows, so a
   shingle of any frequency lies in as many ranges as it fills. A member stays in a block only if it
   may link with another one whose first common shingle this is: by their sizes and the places of the
   shingle in both orders (``_partnered``). Blocks with equal members count once.
3. In each block a signature tree gives pairs that may link, enough to connect all that could be
   connected (``signature_tree``). Their components are closed: no link leads out of one.
4. Each set of such a component is sent once more, to its component, where a signature tree with wide
   bitmaps, and comparison of whole sets, gives links that connect all that link.
5. Components by large-star and small-star; the smallest doc_id of each names it.

A block or component of more than HELD members or HELD_SHINGLES shingles is dealt out in parts
(``_spanned``): first each part with one member common to all parts, then members outside of the
largest component found by then, against all parts. A group of near copies of any size is
connected in the first step, so the second has the few that are left.

Defined results: a text without words, or null, has an empty set and links with nothing; a text
of fewer words than a shingle has one shingle, all of them; a null doc_id takes no part and has no
component; rows with one doc_id are judged row by row; an empty table gives an empty table; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartspark.llm import signature_tree as st
from chartspark.llm.graph import components
from chartspark.llm.scratch import dropped, written
from chartspark.llm.words import BASE, U, Hasher, grams, mix, rows_of, signed, slices

#: A shingle in this share of all documents is put last in the order of shingles.
FREQUENT = 1 / 500
#: The most of them that are used; more only makes blocks larger, never the result different.
FREQUENT_MOST = 250_000
#: The most members, and shingles of them, that one task compares at once; more are dealt out in parts.
HELD, HELD_SHINGLES = 8192, 4 << 20
#: Bits of a place in a prefix. Shingles that differ in these bits only are one block, which loses no pair.
PLACE = 16
#: Bits for each key of a map that passes rows of wanted keys, and the most bits of a map (16 MB): beyond, more rows pass in
#: vain and none is lost.
SLOTS_EACH, SLOTS_MOST = 8, 1 << 27


def shingle_sets(column: pa.Array, hasher: Hasher, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every row, and the offsets of the rows."""
    words, offsets = hasher(column)
    size = np.diff(offsets)
    hashes = grams(words, n, 3)
    row = rows_of(offsets)[: len(hashes)]
    inside = np.arange(len(hashes)) + n <= offsets[row + 1] if len(hashes) else np.zeros(0, bool)
    hashes, row = hashes[inside], row[inside]
    short = np.flatnonzero((size > 0) & (size < n))
    if len(short):
        h = np.zeros(len(short), U)
        for i in range(n - 1):
            more = size[short] > i
            h[more] = h[more] * U(BASE) + words[offsets[short[more]] + i]
        hashes, row = np.concatenate([hashes, mix(h + size[short].astype(U), 4)]), np.concatenate([row, short])
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    once = np.r_[True, (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])] if len(hashes) else np.zeros(0, bool)
    hashes, row = hashes[once], row[once]
    return hashes, np.searchsorted(row, np.arange(len(size) + 1))


def node_of(hashes: np.ndarray) -> int:
    """A hash of a set."""
    parts = [int(mix(hashes, s).sum(dtype=U)) for s in (21, 22)] + [len(hashes)]
    return int(grams(np.array(parts, U), 3, 23).view(np.int64)[0])


def prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _placed(shingles: np.ndarray) -> np.ndarray:
    """Shingles with their places, those from 2**PLACE - 1 on as that one, in place of their last PLACE bits."""
    place = np.minimum(np.arange(len(shingles)), (1 << PLACE) - 1).astype(U)
    return ((shingles >> U(PLACE) << U(PLACE)) | place).view(np.int64)


def frequent_shingles(docs: DataFrame, n: int) -> np.ndarray:
    """Shingles in at least FREQUENT of all documents by their counts in the parts of tasks where they are as frequent, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(fold=True)
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, _ = shingle_sets(part.column("text"), hasher, n)
                found, count = np.unique(hashes, return_counts=True)
                many = count >= max(3, part.num_rows * FREQUENT)
                yield pa.RecordBatch.from_arrays([signed(found[many]), pa.array(count[many])], names=["shingle", "n"])

    total = docs.count()
    counts = docs.select("text").mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    top = counts.where(F.col("n") >= max(3, total * FREQUENT)).orderBy(F.col("n").desc(), "shingle").limit(FREQUENT_MOST)
    return np.sort(top.select("shingle").toArrow().column(0).to_numpy().view(U))


def described(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """``doc_id, n_shingles, node``, and once for each node and task ``prefix`` and ``bits``; ``text_hash`` too if ``docs`` has it.
    A shingle of ``prefix`` holds its place there in its last PLACE bits: as many tokens, of fewer bits, and no other column."""
    keyed = "text_hash" in docs.columns
    last = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, seen = Hasher(fold=True), set()
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, offsets = shingle_sets(part.column("text"), hasher, n)
                often = np.isin(hashes, last.value)
                nodes, prefixes, bits = [], [], []
                known = part.column("doc_id").is_valid().to_pylist()
                for i in range(part.num_rows):
                    s = hashes[offsets[i] : offsets[i + 1]]
                    node = node_of(s) if len(s) else None
                    nodes.append(node)
                    if node is None or node in seen or not known[i]:
                        prefixes.append(None)
                        bits.append(None)
                        continue
                    seen.add(node)
                    o = often[offsets[i] : offsets[i + 1]]
                    m = prefix_size(len(s), percent)
                    first = s[~o][:m]
                    prefixes.append(_placed(np.concatenate([first, s[o][: m - len(first)]])))
                    bits.append(st.bitmap(s, st.width_of(len(s))).tobytes())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(offsets)), pa.array(nodes, pa.int64()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(bits, pa.binary()), *([part.column("text_hash")] if keyed else [])], names=["doc_id", "n_shingles", "node", "prefix", "bits", *["text_hash"] * keyed])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, node long, prefix array<long>, bits binary" + ", text_hash long" * keyed)


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole groups from rows sorted by ``key``; a group may span batches."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(key).to_numpy()
        change = np.flatnonzero(k[1:] != k[:-1]) + 1
        if held and held[-1].column(key)[-1].as_py() != k[0]:
            yield pa.Table.from_batches(held)
            held = []
        if len(change):
            yield pa.Table.from_batches([*held, b.slice(0, int(change[-1]))])
            held, b = [], b.slice(int(change[-1]))
        held.append(b)
    if held:
        yield pa.Table.from_batches(held)


def _partnered(token: np.ndarray, size: np.ndarray, at: np.ndarray, percent: int) -> np.ndarray:
    """Of rows sorted by token, those of sets that may link with another set of their token whose first common shingle it is.

    Sets x and y with the shingle at places p and q of their orders, and none in common before, have at most
    min(|x| - p, |y| - q) in common. To link they need percent * (|x| + |y|) / (100 + percent), so each allows the other
    a largest size. Any two that link do so at their first common shingle, which is in both prefixes."""
    most = (100 + percent) * (size - at) // percent - size
    apart = np.cumsum(np.r_[False, token[1:] != token[:-1]]) * (max(size.max(), most.max()) + 1)
    order = np.lexsort((size, token))
    allowed = (apart + most)[order]
    first = np.r_[-1, np.maximum.accumulate(allowed)]  # the largest and second largest of what the smallest sets allow
    second = np.r_[-1, np.maximum.accumulate(np.minimum(allowed, first[:-1]))]
    small = np.searchsorted((apart + size)[order], apart + most, "right")
    return np.where(size <= most, second[small], first[small]) >= apart + size  # a set of a size it allows is one of them itself


def _members(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Members of blocks with at least two, from rows sorted by token (``_placed``) and node, one batch at a time. Blocks that lie inside
    a batch lose the members that can link with no other there. The first row of a block has sums over its members in this
    batch; where a batch ends inside a block, several rows have a part of them."""
    before = None
    for b in batches:
        if not b.num_rows:
            continue
        token, node, size = (b.column(c).to_numpy() for c in ("token", "node", "n"))
        once = np.r_[before != (token[0], node[0]), (token[1:] != token[:-1]) | (node[1:] != node[:-1])]
        before = token[-1], node[-1]
        token, node, size = token[once], node[once], size[once].astype(np.int64)
        if not len(token):
            continue
        token, at = token >> PLACE, token & ((1 << PLACE) - 1)
        count = np.diff(np.flatnonzero(np.r_[True, token[1:] != token[:-1], True]))
        edge, whole = np.zeros(len(count), bool), count > 1
        edge[[0, -1]], whole[[0, -1]] = True, False
        keep, whole = np.repeat(edge, count), np.flatnonzero(np.repeat(whole, count))
        if len(whole):
            keep[whole[_partnered(token[whole], size[whole], at[whole], percent)]] = True
        token, node, size = token[keep], node[keep], size[keep]
        begin = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
        count = np.diff(np.r_[begin, len(token)])
        none = np.ones(len(token), bool)
        none[begin] = False
        sums = (*(np.bitwise_xor.reduceat(mix(node.view(U), k), begin).view(np.int64) for k in (31, 32)), count, np.add.reduceat(size, begin))
        none = pa.array(none)
        yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(node), pa.array(size.astype(np.int32)), *(pc.if_else(none, None, pa.array(np.repeat(x, count))) for x in sums)], names=["token", "node", "n", "h1", "h2", "members", "load"])


def _per_unit(batches: Iterator[pa.RecordBatch], links_of) -> Iterator[pa.RecordBatch]:
    """``u, v`` from each unit of rows sorted by unit, n and node; a node counts once."""
    for t in _groups(batches, "unit"):
        unit, node = t.column("unit").to_numpy(), t.column("node").to_numpy()
        new = np.r_[True, unit[1:] != unit[:-1]]
        once = new | np.r_[True, node[1:] != node[:-1]]
        t, unit = t.filter(pa.array(once)), unit[once]
        begin = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
        out: list[tuple] = []
        for at, end in zip(begin, np.r_[begin[1:], len(unit)], strict=True):
            if end - at > 1:
                g = t.slice(at, end - at)
                node = g.column("node").to_numpy()
                label = np.unique(g.column("root").to_numpy(), return_inverse=True)[1]
                out += [(int(node[i]), int(node[j])) for i, j in links_of(node, g.column("n").to_numpy().astype(np.int64), label, g.column("data").to_pylist())]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["u", "v"])


def _may_link(percent: int):
    """Pairs that may link by their bitmaps, and connect all that may be connected."""
    return lambda node, size, label, data: st.Block([np.frombuffer(x, U) for x in data], size, label, percent, node).spanning()


def _do_link(percent: int):
    """Links, by whole sets, that connect all that link; wide bitmaps spare most comparisons."""

    def links(node, size, label, data):
        sets = [np.frombuffer(x, U) for x in data]
        bits = [st.bitmap(s, st.WIDE * st.width_of(len(s))) for s in sets]

        def check(i: int, j: int) -> bool:
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            return 100 * both >= percent * (size[i] + size[j] - both)

        return st.Block(bits, size, label, percent, node).spanning(check)

    return links


def _spanned(rows: DataFrame, links_of, name: str) -> DataFrame:
    """``u, v``: pairs of one group, by ``links_of``, that connect all that such pairs of a group connect.
    ``rows``, a written table: group, node, n, data, and of the whole group ``members`` and ``load`` (shingles)."""

    def units(df: DataFrame, *key: str) -> DataFrame:
        unit = df.select(F.xxhash64(*key).alias("unit"), "node", F.col("n").cast("int").alias("n"), "root", "data")
        return unit.repartition("unit").sortWithinPartitions("unit", "n", "node").mapInArrow(lambda it: _per_unit(it, links_of), "u long, v long")

    def each(count: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(count).cast("long") - 1))

    parts = F.greatest(F.ceil(F.col("members") / HELD), F.ceil(F.col("load") / HELD_SHINGLES)).cast("int")
    dealt = rows.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts"))).withColumn("root", F.col("node"))
    big = dealt.where("parts > 1")
    pivot = big.groupBy("group", "parts").agg(F.min(F.struct(F.xxhash64("node").alias("by"), "node", "n", "data")).alias("p"))
    pivot = pivot.select("group", "p.node", "p.n", "p.data", each("parts").alias("part"), F.col("p.node").alias("root"))
    columns = ["group", "part", "node", "n", "root", "data"]
    links = written(units(dealt.select(*columns).unionByName(pivot.select(*columns)), "group", "part"), name)
    if not big.take(1):
        return links
    found = big.drop("root").join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
    counts = found.groupBy("group", "root").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("s"))
    most = counts.groupBy("group").agg(F.max_by("root", F.struct("k", "root")).alias("major"))
    left = counts.join(most, "group").where("root <> major").groupBy("group").agg(F.greatest(F.ceil(F.sum("k") / HELD), F.ceil(F.sum("s") / HELD_SHINGLES)).cast("int").alias("lefts"))
    open_ = found.join(most.join(left, "group"), "group")
    all_ = open_.withColumn("other", each("lefts"))
    few = open_.where("root <> major").withColumn("other", F.pmod(F.xxhash64("node", F.lit(1)), F.col("lefts"))).drop("part").withColumn("part", each("parts"))
    columns.append("other")
    more = units(all_.select(*columns).unionByName(few.select(*columns)), "group", "part", "other")
    return written(links.unionByName(more), name, links)


def _wanted_map(keys: DataFrame, key: str) -> tuple[Broadcast, Column]:
    """A bitmap of the hashed ``key`` of ``keys`` (a written table), sized by their count, and the slot of a row in it. Spark
    puts its 64-bit words together; the driver gets them, at most SLOTS_MOST / 64, and no key."""
    slots = min(SLOTS_MOST, 1 << max(6, (SLOTS_EACH * keys.count()).bit_length()))
    slot = F.pmod(F.xxhash64(key), F.lit(slots))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(63).cast("int"))
    got = keys.select(F.shiftright(slot, 6).alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    words = np.zeros(slots // 64, U)
    words[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(U)
    return keys.sparkSession.sparkContext.broadcast(words), slot.alias("slot")


def _passed(batch: pa.RecordBatch, words: np.ndarray) -> pa.RecordBatch:
    """The rows whose slot is open in the map, without ``slot``."""
    slot = batch.column("slot").to_numpy()
    open_ = (words[slot >> 6] >> (slot & 63).view(U)) & U(1)
    return batch.filter(pa.array(open_.astype(bool))).drop_columns(["slot"])


def _sets(wanted: DataFrame, docs: DataFrame, n: int) -> DataFrame:
    """``wanted`` (a written table: doc_id, node and more) with ``data``, the set of the node, from the text of that doc_id;
    equal rows give equal rows. Texts are not shuffled: a bitmap of hashed ids passes the texts that may be wanted and few
    others, and their sets are joined: by a merge at every size, as what is wanted grows with the corpus."""
    passed, slot = _wanted_map(wanted, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(fold=True)
        for batch in batches:
            for part in slices(_passed(batch, passed.value), "text"):
                hashes, offsets = shingle_sets(part.column("text"), hasher, n)
                own = [hashes[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                keep = [i for i, s in enumerate(own) if len(s)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(keep, pa.int64())), pa.array([node_of(own[i]) for i in keep], pa.int64()), pa.array([own[i].tobytes() for i in keep], pa.binary())], names=["doc_id", "node", "data"])

    rows = docs.where("doc_id is not null").select("doc_id", "text", slot)
    return rows.mapInArrow(run, "doc_id long, node long, data binary").join(wanted.hint("merge"), ["doc_id", "node"])


def linked_components(documents: DataFrame, n: int = 5, percent: int = 75) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``documents`` (doc_id, text)."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    nodes = written(described(docs, n, percent), "nodes")
    place, roots = _rooted(docs, nodes, n, percent)
    named = place.select("node", F.col("doc_id").alias("component_id"))
    of = named.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = of.groupBy("root").agg(F.min("component_id").alias("component_id"))
    named = of.select("node", "root").join(least, "root").select("node", "component_id")
    out = nodes.select("doc_id", "n_shingles", "node").join(named, "node", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"))


def text_key() -> Column:
    """With doc_id, tells rows of different texts apart."""
    return F.xxhash64("text")


def linked_rows(documents: DataFrame, n: int = 5, percent: int = 75) -> DataFrame:
    """``doc_id, text_hash, root`` of every row that can link; rows have one root if their sets are equal or linked, also where a doc_id repeats."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    nodes = written(described(docs.withColumn("text_hash", text_key()), n, percent), "nodes")
    _, roots = _rooted(docs, nodes, n, percent)
    rows = nodes.where("doc_id is not null and node is not null").select("doc_id", "text_hash", "node")
    return rows.join(roots, "node", "left").select("doc_id", "text_hash", F.coalesce("root", "node").alias("root"))


def _rooted(docs: DataFrame, nodes: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """``node, doc_id`` (the smallest with that set) of all nodes, and ``node, root`` of those that link with another."""
    place = nodes.where("doc_id is not null and node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("n_shingles").alias("n"))
    tokens = nodes.where("prefix is not null").select(F.explode("prefix").alias("token"), "node", F.col("n_shingles").cast("int").alias("n"))
    tokens = tokens.repartitionByRange("token", "node").sortWithinPartitions("token", "node")
    seen = written(tokens.mapInArrow(lambda it: _members(it, percent), "token long, node long, n int, h1 long, h2 long, members long, load long"), "members")
    sums = seen.where("members is not null").groupBy("token").agg(F.bit_xor("h1").alias("h1"), F.bit_xor("h2").alias("h2"), F.sum("members").alias("members"), F.sum("load").alias("load"))
    kept = sums.where("members > 1").groupBy("h1", "h2", "members", "load").agg(F.min("token").alias("token")).select("token", "members", "load")
    bits = nodes.where("bits is not null").select("node", "bits").dropDuplicates(["node"])
    blocks = seen.select("token", "node", "n").join(kept, "token").join(bits, "node")
    blocks = written(blocks.select(F.col("token").alias("group"), "node", "n", F.col("bits").alias("data"), "members", "load"), "blocks", seen)
    pairs = _spanned(blocks, _may_link(percent), "pairs")
    dropped(blocks)
    roots = components(pairs)
    near = roots.unionByName(roots.select(F.col("root").alias("node"), "root")).distinct().join(place, "node")
    sums = near.groupBy("root").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("load"))
    wanted = written(near.join(sums, "root").select("doc_id", "node", F.col("root").alias("group"), "n", "members", "load"), "wanted", pairs)
    whole = written(_sets(wanted, docs, n).select("group", "node", "n", "data", "members", "load"), "whole")
    links = _spanned(whole, _do_link(percent), "links")
    dropped(whole, wanted)
    return place, components(links)
