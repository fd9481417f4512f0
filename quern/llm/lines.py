"""Line dedup, native: fuzzy lines by MinHash.

Distinct lines are found first and written as a table with numbers. The signature of a line is the sorted list of the
smallest hashes of its character shingles. Runs of neighbours in that list are the bands: two lines share a run if all
hashes that either has in that stretch belong to both. The length of runs follows the number of distinct lines, so that
chance meetings stay few, and the length of the list follows from it, so that RECALL of the pairs at the threshold share
a run (see ``places``). Lines of few shingles are listed by their whole sets with runs of three, which no pair of them
that is similar enough can miss.

Each line is paired with the first of the lines that share a run of it. Most unlike pairs are ruled out by 64 bits of their
signatures, others are verified by the exact Jaccard similarity of all their character shingles, and linked lines fall into
components by distributed union-find. Lines of a run that still lie in different components are compared next: first with
one line of a random few of the run, which joins most of what belongs together by pairs in proportion to the lines; then all
that are left apart, in large groups in blocks. Both look first at the parities of all shingles of a line, which rule out
most unlike pairs and no similar one, so no differing pair of a group stays unexamined. Of each component the first line stays.
Equal lines need no candidates. Only SQL functions are used; shingles are compared by 64-bit hashes, lines by their
numbers, and occurrences find their line by 128-bit hashes.
"""

from __future__ import annotations

import gc
import time
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.components import components
from quern.session import checkpoint_dir, cut

MIN_CHARS = 1  # characters other than white space that a line needs to take part
SHINGLE = 5  # characters, for the exact similarity
SIMILAR = 80  # hundredths
RECALL = 0.99  # of pairs at the threshold
CHANCE = 20  # a run is one longer for each such factor in the number of distinct lines
FEWEST = 8  # in lines of many shingles a run begins at one of so many hashes
SIGNED, BITS_APART = 48, 18  # smallest hashes whose bits rule out pairs, and how many may differ
BROADCAST_BYTES = 4 << 20  # of numbers of lines that go; more are joined by shuffle
BITMAP_BLOCKS = 1 << 16  # of 4,096 bits in a bitmap that may go to every executor, 512 bytes each
SIEVE = 32  # bits for each hash in a bitmap of hashes
PARITIES = 16  # words of 64 bits
MEET = 8  # lines of a group of which one is compared with the others before all that are left apart are
LIST_BLOCK = 4096  # lines of a group that one task compares with the lines of other components
BLANK = "\\u0020\\u0009\\u000b\\u000c\\u000d"  # ASCII white space within a line, in SQL


def _let(name: str, value: str, body: str) -> str:
    """SQL: ``body`` with ``name`` for ``value``, worked out once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def places(run: int, rate: float) -> int:
    """How many smallest hashes give two lines at the threshold a common run with probability RECALL, if a run's
    first hash begins one with probability ``rate``. A chain over the hashes of both lines in order, each of which
    belongs to both with probability SIMILAR."""
    p, state, n = SIMILAR / 100, [1.0] + [0.0] * run, 0
    while sum(state) > 1 - RECALL:
        hits = [p * x for x in state]
        state = [(1 - p) * sum(state), *hits[: run - 1], (1 - rate) * (hits[run - 1] + hits[run])]
        n += 1
    return -(-n * (100 + SIMILAR) // 200)  # of one line


def run_length(lines: int) -> int:
    """Neighbours in a run for so many distinct lines."""
    run = 4
    while CHANCE**run < lines:
        run += 1
    return run


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, row, t``: ``row`` is a 128-bit hash of id and text."""
    d = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("t"))
    return d.select("id", _pair("id", "t").alias("row"), "t")


def _pair(*cols: str) -> Column:
    return F.struct(F.xxhash64(*cols).alias("x"), F.xxhash64(F.lit(1), *cols).alias("y"))


def _split(rows: DataFrame, *cols: str) -> DataFrame:
    """The lines that take part, with their number in the text."""
    lines = rows.select(*cols, F.posexplode(F.split("t", "\n")).alias("line_no", "line"))
    return lines.filter(F.expr(f"length(trim(BOTH '{BLANK}' FROM line)) >= {MIN_CHARS}"))


class Table:
    """``node, line`` and the two hashes of all distinct lines, written once; nodes are their numbers."""

    def __init__(self, rows: DataFrame):
        self.spark = rows.sparkSession
        self.folder = f"{checkpoint_dir(self.spark)}/lines-{uuid.uuid4().hex}"
        distinct = _split(rows).groupBy("line").agg(F.count("*").alias("copies"))
        distinct = distinct.select(F.monotonically_increasing_id().alias("node"), "line", _pair("line").alias("hash"), "copies")
        distinct.write.option("compression", "zstd").parquet(self.folder)
        self.lines = self.spark.read.parquet(self.folder)
        self.size = self.lines.count()

    def delete(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def _hashes(line: str) -> str:
    """SQL: the hashes of the shingles of ``line`` in order of place; four bytes a character make each quick to find."""
    at = f"sequence(1, greatest(1, 4 * length({line}) - {4 * SHINGLE - 4}), 4)"
    return _let("b", f"encode({line}, 'UTF-32')", f"transform({at}, i -> xxhash64(substring(b, i, {4 * SHINGLE})))")


def _smallest(lines: DataFrame, most: int) -> DataFrame:
    """``lines`` with ``m``, the ``most`` smallest distinct hashes, sorted."""
    kept = [c for c in lines.columns if c != "m"]
    # never null, so that no filter that looks for nulls works them out a second time
    s = lines.selectExpr(*kept, f"coalesce(sort_array({_hashes('line')}), CAST(array() AS array<bigint>)) AS h")
    # repeated hashes are few in most lines
    s = s.selectExpr(*kept, "h", f"array_distinct(slice(h, 1, {most + 16})) AS m")
    return s.selectExpr(*kept, f"slice(CASE WHEN size(m) < {most} AND size(h) > {most + 16} THEN array_distinct(h) ELSE m END, 1, {most}) AS m")


def _keys(signed: DataFrame, run: int) -> DataFrame:
    """``key, node, sig`` of the groups of each line of ``signed(node, m, n, sig)``: hashes of its runs, without ``sig``, and one row
    more of each line that alone holds its ``sig``, at a key of its own.

    Lines of few shingles have runs of fewer; where that changes, lines have both. Runs begin at every place, or in lines of
    many shingles at hashes with one to three low bits of zero. A number stands for a run, its place times 64 and its length; 0 for the row more.
    """

    def runs(length: str, of: str = "n") -> str:
        return f"sequence(64 + {length}, 64 * ({of} - {length} + 1) + {length}, 64)"

    none = "CAST(array() AS array<int>)"
    parts = ["array(0)", f"CASE WHEN n < 3 THEN {runs('n')} WHEN n IN (4, 5) THEN {runs('2')} ELSE {none} END"]
    for r in range(3, run):
        least = 3 if r == 3 else places(r, 1)
        parts.append(f"CASE WHEN n >= {least} AND n < {-(-100 * places(r + 1, 1) // SIMILAR)} THEN {runs(r)} ELSE {none} END")
    parts.append(f"CASE WHEN n < {places(run, 1)} THEN {none} ELSE {runs(run)} END")
    low = " ".join(f"WHEN n < {-(-100 * places(run, 1 / (2 * k)) // SIMILAR)} THEN {k - 1}" for k in (1, 2, 4))
    rows = signed.selectExpr("node", "sig", "m", f"CASE {low} ELSE {FEWEST - 1} END AS low", f"explode(concat({', '.join(parts)})) AS at")
    rows = rows.filter("at = 0 OR get(m, shiftright(at, 6) - 1) & low = 0")
    return rows.selectExpr("CASE WHEN at = 0 THEN xxhash64(node) ELSE xxhash64(slice(m, shiftright(at, 6), at & 63)) END AS key", "node", "CASE WHEN at = 0 THEN sig END AS sig")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()


def _groups(lines: DataFrame, run: int) -> tuple[DataFrame, DataFrame]:
    """``node, first, two, more`` of lines and the first of their groups, if these can be similar enough, and whether that is of a group of
    two lines and of one of more; and ``key, node`` of the groups of more."""
    signed = _smallest(lines.select("node", "line"), places(run, 1 / FEWEST))
    # bits of the smallest hashes
    sig = f"aggregate(slice(m, 1, {SIGNED}), 0L, (a, x) -> a | shiftleft(1L, CAST(x & 63 AS INT)))"
    near = _keys(signed.selectExpr("node", "m", "size(m) AS n", f"{sig} AS sig"), run).repartition("key")
    # most keys stand alone; both sides read one shuffle, and neither sorts it. What holds a sig belongs to no group
    groups = near.groupBy("key").agg(F.expr("min(CASE WHEN sig IS NULL THEN node END) AS first"), F.expr("count(CASE WHEN sig IS NULL THEN 1 END) AS size"))
    near = near.join(groups.filter("size > 1").hint("shuffle_hash"), "key", "left").filter("sig IS NOT NULL OR size IS NOT NULL")
    near = cut(near.select("key", "node", "first", "size", "sig"))
    signs, near = near.filter("sig IS NOT NULL").select("node", "sig"), near.filter("sig IS NULL")
    pairs = near.filter("node <> first").groupBy("node", "first").agg(F.expr("min(size) = 2 AS two"), F.expr("max(size) > 2 AS more"))
    pairs = pairs.join(signs.hint("merge"), "node").join(signs.select(F.col("node").alias("first"), F.col("sig").alias("first_sig")).hint("merge"), "first")
    return cut(pairs.filter(_may_link("sig", "first_sig")).select("node", "first", "two", "more")), cut(near.filter("size > 2").select("key", "node"))


def _may_link(a: str, b: str) -> str:
    """SQL: lines with the bits ``a`` and ``b`` can be similar enough. In a simulation 7 of 10,000 pairs at the threshold differ
    in more bits, none where the bits are of all their hashes."""
    return f"bit_count({a} ^ {b}) <= {BITS_APART}"


def _bitmap(numbers: DataFrame) -> DataFrame | None:
    """``block, words`` with a bit for each of the numbers in the one column, from 0 on; None if it is too large to go to every executor."""
    words = numbers.toDF("v").groupBy(F.expr("shiftright(v, 6)").alias("w")).agg(F.expr("bit_or(shiftleft(1L, CAST(v & 63 AS INT)))").alias("bits"))
    blocks = words.groupBy(F.expr("shiftright(w, 6)").alias("block")).agg(F.map_from_entries(F.collect_list(F.struct(F.expr("CAST(w & 63 AS INT)"), "bits"))).alias("m"))
    bits = cut(blocks.selectExpr("block", "transform(sequence(0, 63), i -> coalesce(try_element_at(m, i), 0L)) AS words"))
    return bits if bits.count() <= BITMAP_BLOCKS else None


def _asked(rows: DataFrame, number: str, bits: DataFrame) -> DataFrame:
    """``rows`` with ``asked``: whether their ``number`` has its bit. The rows stay where they are."""
    found = rows.withColumn("v", F.expr(number)).join(F.broadcast(bits), F.expr("shiftright(v, 12) = block"), "left")
    asked = "coalesce(get(words, CAST(shiftright(v, 6) & 63 AS INT)) & shiftleft(1L, CAST(v & 63 AS INT)), 0L) <> 0"
    return found.select(*rows.columns, F.expr(asked).alias("asked"))


def _sieved(rows: DataFrame, pair: str, wanted: DataFrame) -> DataFrame:
    """``rows`` with ``asked``: false only where their ``pair`` of hashes is not in ``wanted``, and for most of those."""
    size = max(1, min(SIEVE * wanted.count(), 4096 * BITMAP_BLOCKS))
    bits = _bitmap(wanted.selectExpr(f"pmod({pair}.x, {size}L)"))
    return _asked(rows, f"pmod({pair}.x, {size}L)", bits) if bits is not None else rows.withColumn("asked", F.lit(True))


def _lines_of(lines: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, line`` of ``nodes``. Lines are many more than those asked for, so a bitmap goes to the lines and not the lines to a join."""
    nodes, lines = cut(nodes), lines.select("node", "line")
    bits = _bitmap(nodes)
    return lines.join(nodes, "node", "left_semi") if bits is None else _asked(lines, "node", bits).filter("asked").drop("asked")


def _texts(lines: DataFrame, pairs: DataFrame) -> DataFrame:
    """``node, line`` of the lines in pairs (a, b)."""
    return cut(_lines_of(lines, pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()))


def _side(found: DataFrame, name: str, *cols: str) -> DataFrame:
    return found.select(F.col("node").alias(name), *cols)


def _linked(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """The pairs (a, b) of lines that are similar enough."""
    texts = _texts(lines, pairs)
    p = pairs.join(_side(texts, "a", F.col("line").alias("x")), "a").join(_side(texts, "b", F.col("line").alias("y")), "b")
    p = p.selectExpr("a", "b", f"array_distinct({_hashes('x')}) AS x", f"array_distinct({_hashes('y')}) AS y")
    p = p.selectExpr("a", "b", "size(x) + size(y) AS both", "size(array_intersect(x, y)) AS common")
    return cut(p.filter(f"100 * common >= {SIMILAR} * (both - common)").select("a", "b"))


def _apart(entries: DataFrame, labels: DataFrame) -> DataFrame:
    """``key, node, part, most, size`` of ``entries(key, node)`` in groups of several components: the line's component, the
    largest of the group and the group's size."""
    e = entries.join(labels.withColumnRenamed("label", "part").hint("merge"), "node", "left").withColumn("part", F.coalesce("part", "node"))
    parts = e.groupBy("key", "part").count()
    lists = parts.groupBy("key").agg(F.sum("count").alias("size"), F.count("*").alias("parts"), F.max_by("part", F.struct("count", "part")).alias("most"))
    return cut(e.join(lists.filter("parts > 1").select("key", "most", "size").hint("merge"), "key").select("key", "node", "part", "most", "size"))


def _parities(lines: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, n, p0, p1, ...``: how many shingles each of the lines has, and for each of 64 * PARITIES bits whether an odd number
    of them falls on it. Two lines differ in no more bits than there are shingles that only one of them has."""
    # the hashes are a column of their own, so that code is made for the explode; an outer one needs no look for empty lists first
    x = _lines_of(lines, nodes).selectExpr("node", f"array_distinct({_hashes('line')}) AS h").selectExpr("node", "explode_outer(h) AS x")
    x = x.selectExpr("node", f"CAST(pmod(x, {PARITIES}) AS INT) AS k", "shiftleft(1L, CAST(shiftrightunsigned(x, 58) AS INT)) AS bit")
    bits = [F.expr(f"bit_xor(CASE WHEN k = {k} THEN bit ELSE 0L END) AS p{k}") for k in range(PARITIES)]
    return cut(x.groupBy("node").agg(F.count("*").cast("int").alias("n"), *bits))


def _close(x: str, y: str) -> str:
    """SQL: by their parities the lines ``x`` and ``y`` can be similar enough. No pair is lost: shingles that only one line has are
    at most (100 - SIMILAR) / (100 + SIMILAR) of both lines' together, or the pair is too unlike."""
    apart = " + ".join(f"bit_count({x}.p{k} ^ {y}.p{k})" for k in range(PARITIES))
    return f"{100 + SIMILAR} * ({apart}) <= {100 - SIMILAR} * ({x}.n + {y}.n) AND 100 * least({x}.n, {y}.n) >= {SIMILAR} * greatest({x}.n, {y}.n)"


def _met(e: DataFrame, marks: DataFrame) -> DataFrame:
    """Distinct close pairs (a, b): the lines of a group ``_apart`` are dealt at random by MEET, each with the first of its own.

    Lines that share many groups meet others in each, so large components come together by pairs no more than the lines' entries."""
    w = Window.partitionBy("key", F.expr(f"pmod(xxhash64(key, node), CAST(ceil(size / {MEET}) AS INT))")).orderBy("node")
    pairs = e.select("node", "part", F.first("node").over(w).alias("first"), F.first("part").over(w).alias("first_part"))
    pairs = _ordered(pairs.filter("part <> first_part").select(F.col("node").alias("a"), F.col("first").alias("b")))
    x, y = marks.withColumnRenamed("node", "a").alias("x"), marks.withColumnRenamed("node", "b").alias("y")
    return cut(pairs.join(x.hint("merge"), "a").join(y.hint("merge"), "b").filter(_close("x", "y")).select("a", "b"))


def _across(e: DataFrame, marks: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of lines of a group ``_apart`` that have different components and are close."""
    e = e.withColumn("blocks", F.ceil(F.col("size") / LIST_BLOCK).cast("int")).join(marks.hint("merge"), "node")
    # lines outside of the largest component go to every block of their group, others to one
    x = e.filter("part <> most").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    y = e.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    both = "x.key = y.key AND x.block = y.block AND x.part <> y.part AND (y.part = y.most OR x.node < y.node)"
    pairs = x.alias("x").join(y.alias("y"), F.expr(f"{both} AND {_close('x', 'y')}"))
    return cut(_ordered(pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))))


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` after ``links`` between components; a line without a component is its own."""
    for side in ("a", "b"):
        links = links.join(labels.select(F.col("node").alias(side), F.col("label").alias("of")).hint("merge"), side, "left").withColumn(side, F.coalesce("of", side)).drop("of")
    joined = components(links).select(F.col("node").alias("label"), F.col("label").alias("to"))
    known = labels.join(joined.hint("merge"), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    return cut(known.unionByName(joined.join(labels.select("node"), F.col("label") == F.col("node"), "left_anti").select(F.col("label").alias("node"), F.col("to").alias("label"))))


def _release(df: DataFrame) -> None:
    """Let Spark take back the disk of shuffles that nothing refers to any more. References of this process reach the JVM within about a
    second; Spark's cleaner takes one after the other after that."""
    gc.collect()
    time.sleep(1.2)
    df.sparkSession.sparkContext._jvm.System.gc()
    time.sleep(1)


def _labels(table: Table) -> DataFrame:
    """``node, label`` of the lines that have links: the label is the same in a component."""
    first, entries = _groups(table.lines, run_length(table.size))
    _release(first)
    # a line of larger groups is first paired with the least of their first lines alone; what that leaves apart is compared below
    star = first.filter("two").select("node", "first").unionByName(first.filter("more").groupBy("node").agg(F.min("first").alias("first")))
    star = cut(_ordered(star.select(F.col("node").alias("a"), F.col("first").alias("b"))))
    labels = components(_linked(star, table.lines))
    _release(labels)
    e = _apart(entries, labels)
    if e.isEmpty():
        return labels
    marks = _parities(table.lines, e.select("node").distinct())
    _release(marks)
    for pairs in (_met, _across):
        links = _linked(pairs(e, marks), table.lines)
        _release(marks)
        if not links.isEmpty():
            labels = _joined(labels, links)
        if pairs is _met:
            e = _apart(e.select("key", "node"), labels)
    return labels


def dropped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row, line_nos``: the lines (from 0, in order) that go, for each row that loses any."""
    rows = _rows(docs, id_col, text_col)
    table = Table(rows)
    _release(docs)
    labels = cut(_labels(table))
    _release(docs)
    distinct, bits = table.lines.select("node", "hash", "copies"), _bitmap(labels.select("node"))
    if bits is not None:
        distinct = _asked(distinct, "node", bits).filter("asked OR copies > 1").drop("asked")
    groups = distinct.join(labels, "node", "left").filter("label IS NOT NULL OR copies > 1")
    groups = cut(groups.select("hash", F.coalesce("label", "node").alias("label")))
    table.delete()
    at = F.struct("id", "row", "line_no")
    every = _split(rows, "id", "row").select("id", "row", "line_no", _pair("line").alias("hash"))
    repeated = _sieved(every, "hash", groups).filter("asked").drop("asked").join(groups, "hash").drop("hash")
    repeated = cut(repeated)
    kept = repeated.groupBy("label").agg(F.min(at).alias("keep"))
    out = repeated.join(kept, "label").filter(~at.eqNullSafe(F.col("keep")))
    return cut(out.groupBy("row").agg(F.array_sort(F.array_distinct(F.collect_list("line_no"))).alias("line_nos")))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_lines, n_dropped, text`` for each row: the text without the lines that repeat earlier ones.

    Of a component of like lines the one at the smallest (id, position) stays; a null id is the smallest.
    Lines of ASCII white space alone stay. A null text has no lines and stays null. Rows equal in id and text are one
    document: they lose the same lines. An empty table gives none. Other columns do not matter.
    """
    out = _with_drops(docs, id_col, text_col)
    return out.select(F.col("_d").getField(id_col).alias("doc_id"), F.coalesce(F.size(F.split(F.col("_d").getField(text_col), "\n")), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("line_nos"), F.lit(0)).cast("long").alias("n_dropped"), _left(text_col).alias("text"))


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with its own columns, repeated lines taken out of the text; ``n_chars`` follows the text if there is one.

    All rows stay, as ``dedup`` has it for nulls, equal rows and empty tables; a text may become empty."""
    out = _with_drops(docs, id_col, text_col).withColumn("_t", _left(text_col))
    cols = [F.col("_t").alias(c) if c == text_col else F.when(F.col("line_nos").isNull(), F.col("_d").getField(c)).otherwise(F.length("_t")).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col("_d").getField(c).alias(c) for c in docs.columns]
    return out.select(*cols)


def _with_drops(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    drops = dropped(docs, id_col, text_col)
    size = drops.agg(F.coalesce(F.sum(40 + 4 * F.size("line_nos")), F.lit(0))).first()[0]
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_d"))
    d = d.select("_d", F.col("_d").getField(id_col).alias("id"), F.coalesce(F.col("_d").getField(text_col), F.lit("")).alias("t"))
    d = d.select("_d", _pair("id", "t").alias("row"))
    if size <= BROADCAST_BYTES:
        return d.join(F.broadcast(drops), "row", "left")
    # rows that lose nothing need not be shuffled
    d = _sieved(d, "row", drops)
    whole = d.filter("NOT asked").withColumn("line_nos", F.lit(None).cast(drops.schema["line_nos"].dataType))
    return d.filter("asked").join(drops, "row", "left").unionByName(whole)


def _left(text_col: str) -> Column:
    others = "array_except(sequence(0, size(l) - 1), line_nos)"
    left = _let("l", f"split(_d.`{text_col}`, '\\n')", f"array_join(transform({others}, i -> get(l, i)), '\\n')")
    return F.expr(f"CASE WHEN line_nos IS NULL THEN _d.`{text_col}` ELSE {left} END")
