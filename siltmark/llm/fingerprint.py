"""Document fingerprints as invertible Bloom lookup sketches, in DataFrame and SQL functions only.

A text's paragraphs are hashed to 64-bit digests; each distinct digest goes to one cell of each of three subtables,
which keep a count, the XOR of digests and the XOR of their checks. Two sketches subtract cell by cell, so that equal
paragraphs cancel, and peeling pure cells recovers the digests that only one side has. Where a sketch is too small for
the difference, both sides are hashed to blocks of a few digests with a sketch each, larger and differently salted on
each further failure.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from . import _shared as S

#: Cells of the fingerprint itself.
CELLS = 18
#: A paragraph ends with its line, or at the first sentence end after so many characters of it.
PARAGRAPH = 120
#: Digests that a block should hold on a retry, and cells of a block's sketch on each attempt; twice as many on the next, until all is peeled.
BLOCK_DIGESTS, BLOCK_CELLS = 12, (36, 90, 240)
#: Peeling rounds; each at least halves what is left, or nothing more can be peeled.
ROUNDS = 12
LEAST = -(1 << 63)


def digests(text: str) -> str:
    """SQL for the distinct paragraph digests of a text column."""
    pieces = f"regexp_extract_all(p, '(?s).{{{PARAGRAPH},}}?[.!?](?=[ ])|.+', 0)"
    return rf"array_distinct(transform(filter(flatten(transform(split({text}, '\\n'), p -> {pieces})), p -> length(trim(p)) > 0), p -> xxhash64(trim(p))))"


def sketch(units: str, cells: int, salt: int) -> str:
    """SQL for the cells of an array of struct(s: 1 or -1, d: digest)."""
    third = cells // 3
    places = f"transform({units}, u -> named_struct('s', u.s, 'd', u.d, 'c', xxhash64(u.d, 7), 'at', {_places('u.d', third, salt)}))"
    cell = "named_struct('n', 0, 'k', 0L, 'c', 0L)"
    add = "named_struct('n', a.n + u.s, 'k', a.k ^ u.d, 'c', a.c ^ u.c)"
    return f"transform(array({places}), us -> transform(sequence(0, {cells - 1}), i -> aggregate(us, {cell}, (a, u) -> if(array_contains(u.at, i), {add}, a))))[0]"


def _places(d: str, third: int, salt: int) -> str:
    return f"array({', '.join(f'cast({k * third} + pmod(xxhash64({d}, {salt + k}), {third}) as int)' for k in range(3))})"


def subtract(a: str, b: str) -> str:
    return f"zip_with({a}, {b}, (x, y) -> named_struct('n', x.n - y.n, 'k', x.k ^ y.k, 'c', x.c ^ y.c))"


def peel(cells: str, n: int, salt: int) -> str:
    """SQL for struct(pos, neg: digests that only the first or second side has; done: whether nothing is left)."""
    third = n // 3
    pure = "filter(st.cells, c -> abs(c.n) = 1 and c.c = xxhash64(c.k, 7))"
    keys = f"array_distinct(transform({pure}, c -> named_struct('s', c.n, 'd', c.k)))"
    placed = f"transform({keys}, u -> named_struct('s', u.s, 'd', u.d, 'c', xxhash64(u.d, 7), 'at', {_places('u.d', third, salt)}))"
    take = "named_struct('n', a.n - u.s, 'k', a.k ^ u.d, 'c', a.c ^ u.c)"
    left = f"transform(st.cells, (c, i) -> aggregate(ks, c, (a, u) -> if(array_contains(u.at, i), {take}, a)))"
    step = f"transform(array({placed}), ks -> if(size(ks) = 0, st, named_struct('cells', {left}, 'pos', st.pos + size(filter(ks, u -> u.s = 1)), 'neg', st.neg + size(filter(ks, u -> u.s = -1)))))[0]"
    done = "named_struct('pos', st.pos, 'neg', st.neg, 'done', forall(st.cells, c -> c.n = 0 and c.k = 0L and c.c = 0L))"
    return f"aggregate(sequence(1, {ROUNDS}), named_struct('cells', {cells}, 'pos', 0, 'neg', 0), (st, r) -> {step}, st -> {done})"


def hexed(cells: str) -> str:
    return f"concat_ws('', transform({cells}, c -> concat(lpad(hex(c.n), 8, '0'), lpad(hex(c.k), 16, '0'), lpad(hex(c.c), 16, '0'))))"


def signed(d: str, s: int) -> str:
    return f"transform({d}, d -> named_struct('s', {s}, 'd', d))"


def with_fingerprint(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """docs with the fingerprint of a text column; null is like the empty text, and equal texts have equal ones."""
    d = digests(f"coalesce({text}, '')")
    return docs.withColumn(name, F.expr(hexed(sketch(signed(d, 1), CELLS, 100))))


def _peel_blocks(pairs: DataFrame, sizes: tuple[int, ...], salt: int) -> DataFrame:
    """(row, pair, pos2, neg2, ok) of pairs (row, pair, na, nb, ab): differences by blocks of digests, each tried with these sizes in turn; not ok where a block still cannot be peeled."""
    units = pairs.withColumn("u", F.explode(F.expr("transform(ab, (d, i) -> named_struct('s', if(i < na, 1, -1), 'd', d))")))
    units = units.withColumn("block", F.expr(f"pmod(xxhash64(u.d, 55), cast(ceil((na + nb) / {BLOCK_DIGESTS}.0) as int))"))
    blocks = units.groupBy("row", "pair", "block").agg(F.collect_list("u").alias("us"))
    for k, cells in enumerate(sizes):
        tried = peel(sketch("us", cells, salt + 10 * k), cells, salt + 10 * k)
        blocks = blocks.withColumn("r", F.expr(tried if not k else f"if(r.done, r, {tried})"))
    return blocks.groupBy("row", "pair").agg(F.sum("r.pos").alias("pos2"), F.sum("r.neg").alias("neg2"), F.bool_and("r.done").alias("ok"))


def likeness(pairs: DataFrame, root: str) -> DataFrame:
    """Likeness of sketches: pairs (row, pair, a, b: digest arrays, sa, sb: their cells) to (row, pair, near).

    near is the share of digests that both sides have among those that either has, by what peeling recovers; two empty
    sides are alike.
    """
    first = pairs.withColumn("r", F.expr(peel(subtract("sa", "sb"), CELLS, 100)))
    first = first.select("row", "pair", F.size("a").alias("na"), F.size("b").alias("nb"), F.expr("r.pos").alias("pos"), F.expr("r.neg").alias("neg"), F.expr("r.done").alias("done"), F.expr("if(r.done, null, concat(a, b))").alias("ab"))
    first = S.materialised(first, f"{root}/first")
    # larger: a sketch a block, each tried with more cells and another salt until it can be peeled
    cells, open_, solved = BLOCK_CELLS, first.filter("not done"), []
    while True:
        tried = S.materialised(_peel_blocks(open_, cells, 200 + 100 * len(solved)), f"{root}/blocks{len(solved)}")
        solved.append(tried.filter("ok"))
        left = tried.filter("not ok")
        if left.isEmpty():
            break
        open_, cells = open_.join(left.select("row", "pair"), ["row", "pair"], "left_semi"), tuple(2 * c for c in cells)
    again = reduce(DataFrame.unionByName, solved).select("row", "pair", "pos2", "neg2")
    both = first.select("row", "pair", "na", "nb", "pos", "neg", "done").join(again, ["row", "pair"], "left")
    pos, neg = F.expr("if(done, pos, pos2)"), F.expr("if(done, neg, neg2)")
    whole = F.col("na") + neg
    return both.select("row", "pair", F.when(whole == 0, 1.0).otherwise((F.col("na") - pos) / whole).alias("near"))


def with_next(docs: DataFrame, parts: int) -> DataFrame:
    """(doc_id, text, next_text, row): each row with the text of the next by ascending (doc_id, text), the last with the first's.

    Ranges of ids are dealt to partitions; the first rows of a range also go to the range before, so that no partition
    needs another. Nulls come first.
    """
    ids = docs.select("id")
    cuts = sorted({int(x) for x in ids.approxQuantile("id", [k / parts for k in range(1, parts)], 0.2 / parts)}) if parts > 1 else []
    bucket = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col("id"))) if cuts else F.lit(0)
    placed = docs.withColumn("b", bucket)
    firsts = sorted(placed.groupBy("b").agg(F.min("id").alias("id")).collect())  # at most one row a partition
    if not firsts:
        return docs.select("id", "doc_id", "text", F.col("text").alias("next_text"), F.lit("").alias("row"))
    before = F.create_map(*[F.lit(x).cast(c) for k, r in enumerate(firsts) for x, c in ((r.id, "long"), (firsts[k - 1].b, "int"))])
    also = F.try_element_at(before, F.col("id"))
    # a copy for the range before comes after all of that range's own rows
    copies = F.array_compact(F.array(F.struct(F.lit(0).alias("late"), F.col("b").alias("at")), F.when(also.isNotNull(), F.struct(F.lit(1).alias("late"), also.alias("at")))))
    rows = placed.withColumn("copy", F.explode(copies)).select("id", "doc_id", "text", "n_chars", "copy.late", "copy.at")
    w = Window.partitionBy("at").orderBy("late", "id", "text")
    rows = rows.repartition(parts, "at").withColumn("next_text", F.lead("text").over(w)).withColumn("rn", F.row_number().over(w))
    return rows.filter("late = 0").withColumn("row", F.expr("concat(at, ':', rn)")).drop("late", "at", "rn")


def compare_versions(docs: DataFrame, key: str = "doc_id", text: str = "text", edited_share: int = 4) -> DataFrame:
    """Fingerprints every text and its edit, whose last n_chars // edited_share code points come from the next document.

    Returns (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next). A null text is
    empty; a null key comes first; equal keys are ordered by text; one document is its own next; other columns are
    ignored; an empty table gives none.
    """
    spark, root = docs.sparkSession, S.shared_root(docs.sparkSession)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(LEAST)).alias("id"), F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).withColumn("n_chars", F.length("text").cast("long"))
    rows = with_next(rows, parts)
    cut = f"cast(length(text) div {edited_share} as int)"
    rows = rows.withColumn("edited", F.expr(f"concat(left(text, length(text) - {cut}), left(next_text, {cut}))"))
    made = rows.select("row", "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), F.expr(digests("text")).alias("a"), F.expr(digests("edited")).alias("e"), F.expr(digests("next_text")).alias("x"))
    # one array, in which what the three texts share is near itself and so compresses
    made = made.select("row", "doc_id", "n_chars", "edited_sha256", F.size("a").alias("na"), F.size("e").alias("ne"), F.concat("a", "e", "x").alias("d"))
    made = S.materialised(made, f"{root}/digests")
    made = made.select("row", "doc_id", "n_chars", "edited_sha256", F.expr("slice(d, 1, na)").alias("a"), F.expr("slice(d, na + 1, ne)").alias("e"), F.expr("slice(d, na + ne + 1, size(d))").alias("x"))
    cells = {c: sketch(signed(c, 1), CELLS, 100) for c in "aex"}
    made = made.select("*", *(F.expr(q).alias(f"s{c}") for c, q in cells.items()))
    pairs = made.select("row", "a", "sa", F.explode(F.array(F.struct(F.lit(0).alias("pair"), F.col("e").alias("b"), F.col("se").alias("sb")), F.struct(F.lit(1).alias("pair"), F.col("x").alias("b"), F.col("sx").alias("sb")))).alias("p"))
    near = likeness(pairs.select("row", "p.pair", "a", "p.b", "sa", "p.sb"), root)
    near = near.groupBy("row").agg(F.max(F.when(F.col("pair") == 0, F.col("near"))).alias("near_edited"), F.max(F.when(F.col("pair") == 1, F.col("near"))).alias("near_next"))
    prints = made.select("row", "doc_id", "n_chars", "edited_sha256", F.expr(hexed("sa")).alias("fingerprint"), F.expr(hexed("se")).alias("edited_fingerprint"))
    return prints.join(near, "row").select(F.col("doc_id").alias(key), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
