"""Similarity join on word shingles: T-occurrence search by short and long inverted lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buffers import LOWER, find_words, mixed, prefix_hashes, range_hashes, run_starts, text_chunks, word_hashes
from .columns import saved
from .graphs import connected
from .repeats import LAST_ID, Sizes, as_batch, pack, pack_versions, part_of, prepared, split_rows, unpack, unpack_versions

SHINGLE = 5
# Link when DENOMINATOR * intersection >= NUMERATOR * (size + size): 7 and 3 for a Jaccard of 0.75.
# Shingles seen in more rows of a chunk than this are frequent; their rows skip the bucket.
FREQUENT = 32
ROW, ENTRY, HOT, DIRECT = 0, 1, 2, 3
MOST = np.uint32(0xFFFFFFFF)

SENT = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), *((n, pa.binary()) for n in ("ids", "versions", "a", "b"))])
NOTED = pa.schema([("part", pa.int32()), ("kind", pa.int32()), *((n, pa.binary()) for n in ("ids", "versions", "a", "b"))])
SETS_DDL = "id long, version long, n_shingles long, node long, codes binary"


def shingle_sets(chunk, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, 48-bit shingle hash), distinct and in order; texts of fewer words are one shingle."""
    words = find_words(chunk)
    values = word_hashes(chunk, words, LOWER[chunk.data])
    start, row = run_starts(words.first, shingle)
    size = np.diff(words.first)
    short = np.flatnonzero((size > 0) & (size < shingle))
    start = np.concatenate((start, words.first[:-1][short]))
    end = np.concatenate((start[: len(row)] + shingle, words.first[1:][short]))
    row = np.concatenate((row, short))
    hashes = range_hashes(prefix_hashes(values), start, end) >> np.uint64(16)
    key = np.unique((row.astype(np.uint64) << np.uint64(48)) | hashes)
    return (key >> np.uint64(48)).astype(np.int64), key & np.uint64((1 << 48) - 1)


def first_of_each(*columns: np.ndarray) -> np.ndarray:
    """True where sorted rows differ from the row before."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return new


def needed(n: np.ndarray, share: tuple[int, int]) -> np.ndarray:
    """Least overlap of a set of n with any set it links to: ceil(n x Jaccard)."""
    top, bottom = share
    return -(-n * top // bottom)


def shingle_index(rows: DataFrame, sizes: Sizes, shingle: int, share: tuple[int, int]) -> DataFrame:
    """Every row's set size and node (hash of the set), and for sets that may link their repeated
    shingles, rarest first (see SETS_DDL).

    Shingles meet in buckets by hash, where those of one document only are dropped. A set of n can
    only link if ceil(n x Jaccard) of its shingles are repeated, which few documents reach. Equal
    sets of a chunk are sent once, and shingles frequent in a chunk send one mark, their rows going
    straight to their part; so a bucket gets a bounded number of entries per chunk for any shingle.
    """
    bits, buckets, parts = sizes.bits, sizes.buckets, sizes.parts
    kinds = [np.int64, np.int64]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, versions = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for chunk in text_chunks(batch.column(2)):
                row, code = shingle_sets(chunk, shingle)
                n = np.bincount(row, minlength=chunk.rows)
                ends = np.concatenate(([0], np.cumsum(n)))
                sums = np.concatenate(([np.uint64(0)], np.cumsum(mixed(code + np.uint64(1)))))
                node = mixed(sums[ends[1:]] - sums[ends[:-1]] + n.astype(np.uint64))
                own, ver = ids[chunk.first : chunk.first + chunk.rows], versions[chunk.first : chunk.first + chunk.rows]
                found = [
                    (int(node[0] % np.uint64(buckets)), ROW, pack(own.astype(np.int64)), pack_versions(ver), pack(n.astype(np.uint32)), pack(node))
                ]
                first = np.zeros(chunk.rows, bool)
                first[np.unique(node, return_index=True)[1]] = True
                mine = first[row]
                row, code = row[mine], code[mine]
                if len(row):
                    order = np.argsort(code)
                    at = np.flatnonzero(np.concatenate(([True], np.diff(code[order]) != 0)))
                    times = np.diff(np.append(at, len(order)))
                    frequent = np.zeros(len(row), bool)
                    frequent[order] = np.repeat(times, times) > FREQUENT
                    marks = code[order][at][times > FREQUENT]
                    bucket = (code >> np.uint64(48 - bits)).astype(np.int64)
                    low, high = code.astype(np.uint32), (code >> np.uint64(32)).astype(np.uint16)
                    rest = ~frequent
                    found += split_rows(bucket[rest], [own[row[rest]], ver[row[rest]], low[rest], high[rest]], [*kinds, np.uint32, np.uint16], (ENTRY,))
                    found += split_rows(
                        (marks >> np.uint64(48 - bits)).astype(np.int64),
                        [np.zeros(len(marks)), np.zeros(len(marks)), marks.astype(np.uint32), (marks >> np.uint64(32))],
                        [*kinds, np.uint32, np.uint16],
                        (HOT,),
                    ) if len(marks) else []
                    if frequent.any():
                        for k in np.array_split(np.flatnonzero(frequent), 4):
                            if len(k):
                                found.append((int(code[k[0]] % np.uint64(buckets)), DIRECT, pack(own[row[k]].astype(np.int64)), pack_versions(ver[row[k]]), pack(low[k]), pack(high[k])))
                yield as_batch(found, SENT)

    def read(table: pa.Table, kind: int, a, b) -> list[np.ndarray]:
        chosen = np.flatnonzero(table["kind"].to_numpy() == kind)
        out = []
        ids = table["ids"].take(pa.array(chosen)).to_pylist()
        for name, dtype in (("ids", np.int64), ("versions", np.int64), ("a", a), ("b", b)):
            column = table[name].take(pa.array(chosen)).to_pylist()
            found = map(unpack_versions, column, ids) if name == "versions" else (unpack(x, dtype) for x in column)
            out.append(np.concatenate([*found] or [np.zeros(0, dtype)]))
        return out

    def whole(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return (high.astype(np.uint64) << np.uint64(32)) | low

    def count(table: pa.Table) -> pa.Table:
        found = []
        ids, versions, n, node = read(table, ROW, np.uint32, np.uint64)
        if len(ids):
            found += split_rows(part_of(ids, versions, parts), [ids, versions, n, node], [*kinds, np.uint32, np.uint64], (ROW,))
        ids, versions, low, high = read(table, DIRECT, np.uint32, np.uint16)
        if len(ids):
            found += split_rows(part_of(ids, versions, parts), [ids, versions, whole(low, high), np.full(len(ids), MOST)], [*kinds, np.uint64, np.uint32], (ENTRY,))
        _, _, low, high = read(table, HOT, np.uint32, np.uint16)
        hot = np.unique(whole(low, high))
        ids, versions, low, high = read(table, ENTRY, np.uint32, np.uint16)
        if len(ids):
            code = whole(low, high)
            order = np.lexsort((versions, ids, code))
            code, ids, versions = code[order], ids[order], versions[order]
            # A repeated row counts once.
            new = first_of_each(code, ids, versions)
            code, ids, versions = code[new], ids[new], versions[new]
            at = np.flatnonzero(np.concatenate(([True], np.diff(code) != 0)))
            times = np.diff(np.append(at, len(code)))
            rank = np.where(np.isin(code[at], hot), MOST, np.minimum(times, MOST - 1).astype(np.uint32))
            rank = np.repeat(rank, times)
            kept = rank > 1
            if kept.any():
                ids = ids[kept]
                found += split_rows(part_of(ids, versions[kept], parts), [ids, versions[kept], code[kept], rank[kept]], [*kinds, np.uint64, np.uint32], (ENTRY,))
        return pa.Table.from_batches([as_batch(found, NOTED)])

    def gather(table: pa.Table) -> pa.Table:
        ids, versions, n, node = read(table, ROW, np.uint32, np.uint64)
        of, ver, code, rank = read(table, ENTRY, np.uint64, np.uint32)
        order = np.lexsort((code, rank, ver, of))
        of, ver, code = of[order], ver[order].astype(np.int64), code[order]
        new = first_of_each(of, ver, code)
        of, ver, code = of[new], ver[new], code[new]
        keys = np.rec.fromarrays([of, ver])
        wanted = np.rec.fromarrays([ids, versions.astype(np.int64)])
        low, high = np.searchsorted(keys, wanted, "left"), np.searchsorted(keys, wanted, "right")
        n = n.astype(np.int64)
        may = (n > 0) & (high - low >= needed(n, share))
        codes = [code[a:b].tobytes() if m else None for a, b, m in zip(low, high, may, strict=True)]
        return pa.Table.from_arrays(
            [pa.array(ids), pa.array(versions.astype(np.int64)), pa.array(n), pa.array(node.view(np.int64)), pa.array(codes, pa.binary())],
            ["id", "version", "n_shingles", "node", "codes"],
        )

    dealt = rows.select("id", "version", "text").mapInArrow(send, "bucket int, kind int, ids binary, versions binary, a binary, b binary")
    counted = dealt.groupBy("bucket").applyInArrow(count, "part int, kind int, ids binary, versions binary, a binary, b binary")
    return counted.groupBy("part").applyInArrow(gather, SETS_DDL)


def verified(pairs: DataFrame, sets: DataFrame, share: tuple[int, int]) -> DataFrame:
    """Pairs (a, b) of nodes whose overlap reaches the threshold.

    The second half of the search: the codes of the smaller set, long lists included, are probed
    by binary search in the sorted codes of the larger one.
    """
    top, bottom = share
    left = sets.select(F.col("node").alias("a"), F.col("n_shingles").alias("n_a"), F.col("codes").alias("codes_a"))
    right = sets.select(F.col("node").alias("b"), F.col("n_shingles").alias("n_b"), F.col("codes").alias("codes_b"))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            values = (batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("n_a", "codes_a", "n_b", "codes_b"))
            for n_a, x, n_b, y in zip(*values, strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                y = np.sort(y)
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                keep.append((bottom + top) * int((y[at] == x).sum()) >= top * (n_a + n_b))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "n_a", "codes_a", "n_b", "codes_b")
    return joined.mapInArrow(probe, "a long, b long")


def short_lists(sets: DataFrame, share: tuple[int, int]) -> DataFrame:
    """Entries (code, node, n, rest, loose) of every set's short lists.

    Of the lists of a set of n, the T - 1 longest are set aside (T the overlap it needs); a partner
    must occur in one of the others. ``rest`` counts the set's repeated codes from this one on,
    ``loose`` is the share of its shingles that no other set has.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            arrays = [np.frombuffer(x, np.uint64) for x in batch.column(2).to_pylist()]
            held = np.array([len(x) for x in arrays], np.int64)
            short = np.maximum(held - needed(sizes, share) + 1, 0)
            which = np.repeat(np.arange(len(nodes)), short)
            inside = np.arange(len(which)) - np.repeat(np.cumsum(short) - short, short)
            codes = np.concatenate([x[:k] for x, k in zip(arrays, short, strict=True)] or [np.zeros(0, np.uint64)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(codes.view(np.int64)), pa.array(nodes[which]), pa.array(sizes[which]), pa.array(held[which] - inside), pa.array((1 - held / np.maximum(sizes, 1))[which])],
                ["code", "node", "n", "rest", "loose"],
            )

    return sets.select("node", "n_shingles", "codes").mapInArrow(split, "code long, node long, n long, rest long, loose double")


def link_sets(sets: DataFrame, share: tuple[int, int]) -> DataFrame:
    """(node, root) of all sets that link to another one."""
    top, bottom = share
    entries = saved(short_lists(sets, share))

    # 1. Every set is held against one other: the head of most of its short lists. The head of
    # a list is the set with the least share of shingles of its own: of edited copies, the source.
    head = F.min(F.struct("loose", "node", "n"))
    heads = entries.groupBy("code").agg(head.alias("first"), F.count(F.lit(1)).alias("nodes")).where("nodes > 1")
    heads = heads.select("code", F.col("first.node").alias("head"), F.col("first.n").alias("n_head"))
    fits = F.least("n", "n_head") * bottom >= F.greatest("n", "n_head") * top
    met = entries.join(heads, "code").where((F.col("node") != F.col("head")) & fits)
    met = met.groupBy("node", "head").agg(F.count(F.lit(1)).alias("lists"))
    best = met.groupBy("node").agg(F.max_by("head", F.struct("lists", "head")).alias("b")).withColumnRenamed("node", "a")
    stars = saved(verified(best, sets, share))
    groups = connected(stars)

    # 2. All pairs of sets in a common short list that are not yet connected.
    labelled = saved(entries.join(groups, "node", "left").withColumn("root", F.coalesce("root", "node")))
    mixed_lists = labelled.groupBy("code").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("code")
    open_ = saved(labelled.join(mixed_lists, "code", "left_semi"))
    other = open_.select("code", *[F.col(c).alias(f"{c}_b") for c in ("node", "n", "rest", "root")])
    candidates = (
        open_.join(other, "code")
        .where((F.col("n") < F.col("n_b")) | ((F.col("n") == F.col("n_b")) & (F.col("node") < F.col("node_b"))))
        .where(F.col("root") != F.col("root_b"))
        .where(F.col("n") * bottom >= F.col("n_b") * top)
        .where(F.least("rest", "rest_b") * (bottom + top) >= (F.col("n") + F.col("n_b")) * top)
        .select(F.col("node").alias("a"), F.col("node_b").alias("b"))
        .distinct()
    )
    more = verified(candidates, sets, share)
    return connected(stars.unionByName(more))


def similar_rows(rows: DataFrame, sizes: Sizes, shingle: int = SHINGLE, share: tuple[int, int] = (3, 4)) -> DataFrame:
    """Per row of ``prepared`` rows: id, version, n_shingles, node, and ``first``, the smallest (id,
    version) reachable by links, the row's own included; see similar_documents."""
    index = saved(shingle_index(rows, sizes, shingle, share))
    sets = index.where("codes is not null").groupBy("node").agg(F.first("n_shingles").alias("n_shingles"), F.first("codes").alias("codes"))
    roots = link_sets(saved(sets), share)
    named = index.select("id", "version", "n_shingles", "node").where("n_shingles > 0")
    named = named.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min(F.struct("id", "version")).alias("first"))
    linked = named.join(least, "root").select("id", "version", "n_shingles", "node", "first")
    alone = index.where("n_shingles = 0").select("id", "version", "n_shingles", "node", F.struct("id", "version").alias("first"))
    return linked.unionByName(alone)


def similar_documents(
    docs: DataFrame, *, shingle: int = SHINGLE, share: tuple[int, int] = (3, 4), doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, node, over links of Jaccard >= share.

    Sets are the distinct ``shingle``-word runs of the lower-cased text (A-Z); a text of fewer
    words is one shingle, one without words has none and links with nothing. component_id is the
    smallest id reachable by links, the row's own included.

    T-occurrence search with the lists divided: 1. shingles meet in buckets and get their number
    of documents; sets without enough repeated shingles drop out. 2. Of each set's lists the T - 1
    longest are set aside; the short ones are merged by a shuffle on the shingle. 3. Candidates of
    the short lists are probed for the rest, long lists included, by binary search. Equal sets
    are one node. To keep large groups cheap every node is first held against one list head, and
    only pairs that these links leave unconnected are searched, in all short lists; links inside
    a connected group are implied and not listed.

    Shingles are compared by 48 bits of hash, sets by 64. A null doc_id counts as larger than
    every id and gives a null component_id where no id is reachable. Rows that repeat an id are
    separate rows. Empty tables give empty results; other columns are ignored.
    """
    rows, sizes = prepared(docs, doc_id, text)
    found = similar_rows(rows, sizes, shingle, share)
    kind = dict(rows.dtypes)["doc_id"]

    def known(column: str):
        return F.when(F.col(column) != LAST_ID, F.col(column)).cast(kind)

    return found.select(
        known("id").alias("doc_id"), "n_shingles", known("first.id").alias("component_id"), "node"
    )
