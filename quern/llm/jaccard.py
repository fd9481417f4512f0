"""N-gram Jaccard join by size: subsets for small sets, inverted lists for large ones.

The shingles of a set are ordered by how many texts have them, rare ones first, the same way everywhere.
Sets that link share a shingle among the first n - ceil(0.8 n) + 1 of each, and a pair of shingles among one more.
Small sets are therefore listed under their pairs of first shingles (subsets of a fixed size), large ones under
single first shingles; a large set scans lists that also hold the small sets near its size. The boundary is
where a set has as many pairs as the entries that its scan would read, by the measured lengths of the lists (of their
entries' view), and at most SMALL_MOST.

A shingle that one text alone has links nothing. Such shingles come first, and a set whose other shingles are fewer
than 0.8 of it has no partner and leaves at once. Two sets are compared only if the shingles after their first
common one can be enough. Equal sets are one set from the start.

Lists are not multiplied out. Each entry is first compared with the set of its list that has the fewest
shingles of its own; sets found linked fall into components; then entries of different components of a list
are compared, for long lists in blocks. So no pair of different components stays unexamined, and pairs within a
component, whose links change nothing, are left out.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import exchange
from quern.llm.components import components
from quern.llm.exchange import Chunk, Numbering, pack_ints, unpack_ints
from quern.llm.words import by_space, hash_words, shingle_hashes
from quern.session import cut, ship

K = 5
PERCENT = 80
LIST_BLOCK = 4096  # entries of a list that one group compares with the entries of other components
SMALL_MOST = 200  # the boundary is never higher: a set of 200 has 861 pairs

_KEY_BITS = np.uint64(16)  # keys of the exchange are hashes without so many low bits


def need(a, b):
    """The least number of common shingles of sets of sizes a and b that link: 100 x >= PERCENT (a + b - x)."""
    return -(-PERCENT * (a + b) // (100 + PERCENT))


def least(n):
    return -(-PERCENT * n // 100)


def _number(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    numbers = Numbering()
    seqs = [np.fromiter(map(numbers.__getitem__, w), np.int64, len(w)) for w in map(by_space, texts)]
    return *exchange.joined(seqs), list(numbers)


def shingle_set(words: np.ndarray, k: int = K) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``k`` words; of the whole sequence if it is shorter."""
    return np.unique(shingle_hashes(words, min(k, len(words)))) if len(words) else np.empty(0, np.uint64)


def _sets(c: Chunk, k: int) -> list[np.ndarray]:
    h = hash_words(c.words)[c.seq] if len(c.words) else np.empty(0, np.uint64)
    ends = np.cumsum(c.lengths)
    return [shingle_set(h[e - n : e], k) for e, n in zip(ends.tolist(), c.lengths.tolist(), strict=True)]


def sets(docs: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n, print, own, items`` for each row.

    ``print``: a fingerprint of the set; ``own``: shingles that no other text has; ``items``: the
    shingle hashes in order of rarity (counts up to 255, then by hash), null where the set cannot have a partner.
    """
    n_buckets = exchange.n_buckets(docs, text_col)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    kind, id_type = docs.schema[id_col].dataType.simpleString(), exchange.arrow_type(docs, id_col)

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
        for ids, texts in exchange.runs(batches):
            yield Chunk(ids, texts, _number)

    def asked(c: Chunk) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        """The sets, distinct keys by bucket, how many of the chunk's texts have each, and their buckets."""
        own = _sets(c, k)
        keys, counts = np.unique(np.concatenate([np.empty(0, np.uint64), *own]) >> _KEY_BITS, return_counts=True)
        at = (keys % np.uint64(n_buckets)).astype(np.int64)
        order = np.argsort(at, kind="stable")
        return own, keys[order], counts[order], at[order]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in chunks(batches):
            _, keys, counts, at = asked(c)
            buckets, begin = np.unique(at, return_index=True)
            out = []
            for own, n in zip(np.split(keys, begin[1:]), np.split(counts, begin[1:]), strict=True):
                out.append(pickle.dumps((pack_ints(np.diff(own, prepend=np.uint64(0))), pack_ints(n))) if len(own) else None)
            m = len(buckets)
            yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int64()), pa.array([c.key] * m, pa.binary()), pa.array(out[:m], pa.binary())], ["bucket", "chunk", "keys"])

    def answer(table: pa.Table) -> pa.Table:
        got = [tuple(map(unpack_ints, pickle.loads(b))) for b in table.column("keys").to_pylist()]
        keys = [np.cumsum(d) for d, _ in got]
        distinct, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.minimum(np.bincount(inverse, np.concatenate([n for _, n in got]), len(distinct)), 255).astype(np.uint8)
        cuts = np.cumsum([len(x) for x in keys])[:-1]
        blobs = [zlib.compress(total[i].tobytes(), 1) for i in np.split(inverse, cuts)]
        return pa.table([table.column("bucket"), table.column("chunk"), pa.array(blobs, pa.binary())], ["bucket", "chunk", "counts"])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in chunks(batches):
            yield pa.RecordBatch.from_arrays([pa.array([c.key], pa.binary()), pa.array([c.dumps()], pa.binary())], ["chunk", "texts"])

    def order(texts: pa.Table, answers: pa.Table) -> pa.Table:
        got = dict(zip(answers.column("bucket").to_pylist(), answers.column("counts").to_pylist(), strict=True))
        out: list[tuple] = []
        for blob in texts.column("texts").to_pylist():
            c = Chunk.loads(blob)
            own, keys, _, at = asked(c)
            if len(keys) and not got:
                raise RuntimeError("the input gave its rows in another order the second time; write or checkpoint it first")
            counts = np.concatenate([np.empty(0, np.uint8), *(np.frombuffer(zlib.decompress(got[b]), np.uint8) for b in np.unique(at).tolist())])
            by_key = np.argsort(keys)
            keys, counts = keys[by_key], counts[by_key]
            for doc_id, s in zip(c.ids, own, strict=True):
                n = len(s)
                count = counts[np.searchsorted(keys, s >> _KEY_BITS)] if n else counts[:0]
                alone = int((count == 1).sum())
                items = s[np.argsort(count, kind="stable")].tobytes() if n and n - alone >= least(n) else None
                out.append((doc_id, n, xxhash.xxh3_128_digest(s.tobytes()), alone, items))
        return pa.table([pa.array([r[j] for r in out], t) for j, t in enumerate((id_type, pa.int64(), pa.binary(), pa.int64(), pa.binary()))], ["doc_id", "n", "print", "own", "items"])

    answers = rows.mapInArrow(ask, "bucket long, chunk binary, keys binary").groupBy("bucket").applyInArrow(answer, "bucket long, chunk binary, counts binary")
    texts = rows.mapInArrow(keep, "chunk binary, texts binary")
    return texts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(order, f"doc_id {kind}, n long, print binary, own long, items binary")


def _entries(nodes: DataFrame, small: int | None) -> DataFrame:
    """``key, node, n, own, at`` of the lists: single first shingles, or for sets up to ``small`` their pairs too.

    With a boundary, sets that are small and too small to link with a large one are not under single shingles.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, rows, places = [], [], []
            n_all, own_all = b.column(1).to_numpy(), b.column(2).to_numpy()
            for r, items in enumerate(b.column(3)):
                n, own = int(n_all[r]), int(own_all[r])
                s = np.frombuffer(items.as_buffer(), np.uint64)
                p = n - least(n) + 1
                if small is None or n >= least(small + 1):
                    at = np.arange(own, p)  # shingles of its own come first, and are in no list
                    keys.append(s[at])
                    places.append(at)
                if small is not None and 4 <= n <= small:
                    i, j = np.triu_indices(min(p + 1, n), 1)
                    use = i >= own
                    i, j = i[use], j[use]
                    keys.append(shingle_pairs(s[i], s[j]))
                    places.append(i)
                rows.append(sum(map(len, keys)))
            counts = np.diff([0, *rows])
            index = np.repeat(np.arange(b.num_rows), counts)
            key = np.concatenate([np.empty(0, np.uint64), *keys]).view(np.int64)
            at = np.concatenate([np.empty(0, np.int64), *places])
            yield pa.RecordBatch.from_arrays([pa.array(key), b.column(0).take(pa.array(index)), pa.array(n_all[index]), pa.array(own_all[index]), pa.array(at)], ["key", "node", "n", "own", "at"])

    return nodes.select("node", "n", "own", "items").mapInArrow(run, "key long, node binary, n long, own long, at long")


def shingle_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash for each two shingles, whatever their order."""
    from quern.llm.words import mix

    with np.errstate(over="ignore"):
        return mix(np.minimum(a, b) * np.uint64(0x9E3779B97F4A7C15) + mix(np.maximum(a, b)))


def boundary(nodes: DataFrame) -> int:
    """The largest size, up to SMALL_MOST, whose pairs of first shingles are no more than the entries that its scan of lists reads.

    An entry reads the entries of its list; lists of one entry cost nothing. The length that counts is that of the list of the
    median entry: entries of a few very long lists, as of thousands of near copies, meet the centre of the list and little more.
    """
    lists = _entries(nodes, None).groupBy("key").count().filter("count > 1").groupBy("count").agg(F.count("*").alias("lists"))
    length = lists.agg(F.expr("percentile(count, 0.5, count * lists)")).first()[0] or 1.0
    n = 4
    while n < SMALL_MOST and (n + 1 - least(n + 1) + 2) / 2 <= length:
        n += 1
    return n


def _may_link(a: str, b: str) -> str:
    """SQL: the entries ``a`` and ``b`` of a list can belong to sets that link."""
    required = f"ceil({PERCENT} * ({a}.n + {b}.n) / {100 + PERCENT})"
    return f"least({a}.n - greatest({a}.at, {a}.own), {b}.n - greatest({b}.at, {b}.own)) >= {required}"


def _linked(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose sets link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= PERCENT * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = nodes.select(F.col("node").alias("a"), F.col("items").alias("x"))
    right = nodes.select(F.col("node").alias("b"), F.col("items").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a binary, b binary")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _across(entries: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs of entries of a list that have different components and can link."""
    e = entries.join(labels.withColumnRenamed("label", "part"), "node", "left").withColumn("part", F.coalesce("part", "node"))
    parts = e.groupBy("key", "part").count()
    lists = parts.groupBy("key").agg(F.sum("count").alias("size"), F.count("*").alias("parts"), F.max_by("part", F.struct("count", "part")).alias("most"))
    lists = lists.filter("parts > 1").select("key", "most", F.ceil(F.col("size") / LIST_BLOCK).cast("int").alias("blocks"))
    e = e.join(lists, "key").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # entries outside of the largest component go to every block of their list, others to one
    other = F.col("part") != F.col("most")
    e = e.select("*", other.alias("other"), F.explode(F.when(other, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))).alias("to"))

    def run(table: pa.Table) -> pa.Table:
        n, own, at = (table.column(c).to_numpy() for c in ("n", "own", "at"))
        part = np.unique(table.column("part").to_numpy(zero_copy_only=False), return_inverse=True)[1]
        other, home = table.column("other").to_numpy(), table.column("block").to_numpy() == table.column("to").to_numpy()
        left = n - np.maximum(at, own)
        out = []
        mine = np.flatnonzero(home)
        for x in np.flatnonzero(other).tolist():
            y = mine[part[mine] != part[x]]
            y = y[np.minimum(left[y], left[x]) >= need(n[y], n[x])]
            out += [(x, z) for z in y.tolist()]
        a, b = ([p[0] for p in out], [p[1] for p in out]) if out else ([], [])
        node = table.column("node")
        return pa.table([node.take(pa.array(a, pa.int64())), node.take(pa.array(b, pa.int64()))], ["a", "b"])

    return e.select("key", "to", "node", "part", "n", "own", "at", "other", "block").groupBy("key", "to").applyInArrow(run, "a binary, b binary")


def join(docs: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row: the smallest id that links lead to, itself included.

    Words are lower-cased (A-Z) and parted by ASCII white space. A text of fewer than ``k`` words is one
    shingle; a null or wordless text has none and links with nothing, also not with its like. Equal sets link.
    Rows with equal ids each give a row; ids that are null are never the smallest. Rows must come in the same
    order when read twice, as from files. Sets are compared by 64-bit hashes of their shingles.
    """
    ship(docs.sparkSession)
    found = cut(sets(docs, k, id_col, text_col))
    # equal sets are one node
    nodes = found.filter("items IS NOT NULL").groupBy(F.col("print").alias("node")).agg(F.min("n").alias("n"), F.min("own").alias("own"), F.first("items").alias("items"))
    nodes = cut(nodes)
    entries = cut(_entries(nodes, boundary(nodes)))
    # the set of each list with the smallest share of shingles of its own
    centre = entries.groupBy("key").agg(F.min_by(F.struct("node", "n", "own", "at"), F.struct(F.col("own") / F.col("n"), "node")).alias("c"))
    star = entries.alias("e").join(centre, "key").filter("e.node <> c.node").filter(_may_link("e", "c"))
    star = cut(_ordered(star.select(F.col("c.node").alias("a"), F.col("e.node").alias("b"))))
    links = cut(_linked(star, nodes))
    across = _ordered(_across(entries, components(links))).join(star, ["a", "b"], "left_anti")
    links = links.unionByName(cut(_linked(across, nodes)))
    labels = components(links)
    of = found.filter("n > 0").groupBy(F.col("print").alias("node")).agg(F.min("doc_id").alias("first"))
    of = of.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    smallest = of.groupBy("label").agg(F.min("first").alias("component_id"))
    of = of.join(smallest, "label").select(F.col("node").alias("print"), "component_id")
    some = found.filter("n > 0").select("doc_id", "n", "print").join(of, "print").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    none = found.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return some.unionByName(none)


def one_each(docs: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` of each component: that of its smallest id, of rows with one id that of the smallest hash of id and text.

    A row without id stays only if its component has none with an id. Rows equal in id and text leave one. Rows without words all stay.
    """
    rows = docs.withColumn("_row", F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")))
    groups = join(rows, k, "_row", text_col).filter("n_shingles > 0")
    groups = cut(groups.groupBy(F.col("doc_id").alias("_row")).agg(F.min("component_id").alias("part"), F.count("*").alias("n")))
    of = rows.select("_row", F.col(f"`{id_col}`").alias("_id")).join(groups, "_row")
    keep = of.groupBy("part").agg(F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_row"))["_row"].alias("stays"))
    groups = cut(groups.join(keep, "part").select("_row", "n", (F.col("_row") == F.col("stays")).alias("stays")))
    alone = rows.join(groups.filter("NOT stays OR n > 1").select("_row"), "_row", "left_anti")
    repeated = rows.join(groups.filter("stays AND n > 1").select("_row"), "_row", "left_semi").dropDuplicates(["_row"])
    return alone.unionByName(repeated).select(*[F.col(f"`{c}`") for c in docs.columns])
