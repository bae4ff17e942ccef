"""N-gram Jaccard join: a grouped prefix join that keeps every link's component.

1. Documents with equal shingle sets form one class; a class is known by a hash of its set.
2. A set that has more shingles of its own than a link allows cannot link. That is decided on a
   share of all shingles (the ones with small hashes), which each set is counted on alike.
3. For the sets left, shingles are ordered by how many sets hold them. Links share one of the first
   ``n - ceil(t n) + 1`` shingles of each set, its prefix; shingles of one set only find nothing.
   Sets with identical prefix and size form one group, which is indexed once.
4. Groups that share a prefix shingle are candidates if their sizes, the places of the shingle and
   the bitmaps of their sets allow a link. First each group meets the nearest of its buckets' pivots, one link a round at
   most, so that large groups of near copies grow together at linear cost, until the buckets that hold several
   components are small; then candidate pairs between different components are compared and those still apart
   expanded to members. All are verified on whole sets.

So links inside a component already known are not enumerated, and none between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skytrace.operators.components import components
from skytrace.sources.storage import Scratch
from .words import BLANKS, byte_table, gram_hashes, mix, slices, split_words, word_hashes

TABLE = byte_table(BLANKS)
BITS = 512


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; the whole sequence as one if it has fewer words."""
    words = split_words(column, TABLE)
    hashes = word_hashes(words)
    grams = gram_hashes(hashes, size)
    for lo, hi in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        yield np.unique(grams[lo : hi - size + 1]) if hi - lo >= size else gram_hashes(hashes[lo:hi], hi - lo)[: hi > lo]


def class_hash(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as signed longs."""
    with np.errstate(over="ignore"):
        a, b = mix(tokens).sum(dtype=np.uint64), mix(tokens ^ np.uint64(0xA5A5A5A55A5A5A5A)).sum(dtype=np.uint64)
        both = mix(np.array([a + np.uint64(len(tokens)), b], np.uint64))
    return tuple(both.view(np.int64).tolist())


def bitmap(tokens: np.ndarray) -> list[int]:
    """The parity of the tokens in each of BITS cells: two sets differ in as many tokens at least as their bitmaps in bits."""
    odd = np.bincount((tokens % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def _signatures(text: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            rows = [(len(s), *class_hash(s)) for s in shingle_sets(batch.column(text), size)]
            n, a, b = (pa.array(x, pa.int64()) for x in zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([batch.column("id"), n, a, b], ["id", "n", "class", "check"])

    return run


def _sampled(text: str, size: int, share: float):
    limit = np.uint64(min(int(share * 2**64), 2**64 - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            own = {class_hash(s)[0]: s[: np.searchsorted(s, limit)].view(np.int64) for s in shingle_sets(batch.column(text), size)}
            length = np.cumsum([0, *map(len, own.values())])
            lists = pa.ListArray.from_arrays(pa.array(length, pa.int32()), pa.array(np.concatenate([*own.values(), np.zeros(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), lists], ["class", "tokens"])

    return run


def _whole(text: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            want = batch.column("class").to_pylist()
            rows = [(c, len(s), s.view(np.int64), bitmap(s)) for c, s in zip(want, shingle_sets(batch.column(text), size), strict=True) if class_hash(s)[0] == c]
            kinds = pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["class", "n", "tokens", "bits"])

    return run


class _Join:
    """The steps after classes: ``sets`` has class, n, tokens and bits of all sets that may link."""

    def __init__(self, sets: DataFrame, percent: int, scratch: Scratch) -> None:
        self.sets, self.percent, self.scratch = sets, percent, scratch
        #: ``class, comp`` of all classes with a link
        self.comp: DataFrame | None = None

    def _needed(self, n: Column, m: Column) -> Column:
        """The smallest intersection of a link between sets of these sizes."""
        return F.ceil((n + m) * self.percent / (100 + self.percent) - F.lit(1e-9))

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs ``a, b`` of classes that are links, checked on whole sets."""
        left = self.sets.select(F.col("class").alias("a"), F.col("tokens").alias("x"))
        right = self.sets.select(F.col("class").alias("b"), F.col("tokens").alias("y"))
        both = F.size(F.array_intersect("x", "y"))
        # x and y are sets, so their sizes give the size of the union
        return pairs.join(left, "a").join(right, "b").select("a", "b", both.alias("k"), F.size("x").alias("n"), F.size("y").alias("m")).where(
            F.lit(100) * F.col("k") >= self.percent * (F.col("n") + F.col("m") - F.col("k"))
        ).select("a", "b")

    def prefixes(self) -> DataFrame:
        """``token, class, n, own, pos, prev``: the shingles of each prefix that other sets hold too; own: shingles of this set alone; prev: the shingle before."""
        rows = self.sets.select("class", "n", F.explode("tokens").alias("token"))
        shared = rows.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
        rows = rows.join(shared, "token")
        order = Window.partitionBy("class").orderBy("df", "token")
        rows = rows.withColumn("own", F.col("n") - F.count("*").over(Window.partitionBy("class")))
        rows = rows.withColumn("pos", F.col("own") + F.row_number().over(order) - 1).withColumn("prev", F.lag("token").over(order))
        return self.scratch.write(rows.where(F.col("pos") <= F.col("n") - F.ceil(F.col("n") * self.percent / 100 - F.lit(1e-9))).select("token", "class", "n", "own", "pos", "prev"), "prefixes")

    def groups(self, prefixes: DataFrame) -> DataFrame:
        """``a, b``: classes of identical prefix and size, and the first of them that they link with."""
        same = prefixes.where("own = 0").groupBy("class", "n").agg(F.xxhash64(F.array_sort(F.collect_list("token"))).alias("prefix"))
        first = same.groupBy("prefix", "n").agg(F.min("class").alias("b"), F.count("*").alias("members")).where("members > 1")
        pairs = same.join(first, ["prefix", "n"]).where("class <> b").select(F.col("class").alias("a"), "b")
        return self.scratch.write(self.verified(pairs), "groups")

    def unite(self, links: DataFrame) -> DataFrame | None:
        """Take in new links; what each old component's name becomes, as ``comp, now``."""
        if links.isEmpty():
            return None
        if self.comp is None:
            self.comp = components(links).select(F.col("node").alias("class"), "comp")
            return self.comp.select(F.col("class").alias("comp"), F.col("comp").alias("now"))
        old, edges = self.comp, links
        for end in ("a", "b"):
            named = old.select(F.col("class").alias(end), F.col("comp").alias("c"))
            edges = edges.join(named, end, "left").withColumn(end, F.coalesce("c", end)).drop("c")
        moved = components(edges).select(F.col("node").alias("comp"), F.col("comp").alias("now"))
        kept = old.join(moved, "comp", "left").select("class", F.coalesce("now", "comp").alias("comp"))
        fresh = moved.select(F.col("comp").alias("class"), F.col("now").alias("comp")).join(old, "class", "left_anti")
        self.comp = self.scratch.write(kept.unionByName(fresh), "comp")
        self.scratch.drop(old)
        return moved

    def _near(self, a: str, b: str) -> tuple[Column, Column]:
        """In how many bits the bitmaps of two entries differ at least, and whether their sizes, places and bitmaps allow a link."""
        n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
        needed = self._needed(n, m)
        apart = F.coalesce(sum((F.bit_count(F.col(f"{a}.bits")[i].bitwiseXOR(F.col(f"{b}.bits")[i])) for i in range(BITS // 64)), F.lit(0)), F.lit(0))
        rest = F.least(n - F.col(f"{a}.pos"), m - F.col(f"{b}.pos"))
        return apart, (F.lit(100) * F.least(n, m) >= self.percent * F.greatest(n, m)) & (rest >= needed) & (apart <= n + m - 2 * needed)

    def heads(self, prefixes: DataFrame, groups: DataFrame) -> DataFrame:
        """One class per group with its prefix, as far as other components share it. A class that stands for others has no bitmap, as theirs differ."""
        bits = self.sets.select("class", "bits").join(groups.select(F.col("b").alias("class")), "class", "left_anti")
        named = prefixes.join(groups.select(F.col("a").alias("class")), "class", "left_anti")
        if self.comp is None:
            named = named.withColumn("comp", F.col("class"))
        else:
            named = named.join(self.comp, "class", "left").withColumn("comp", F.coalesce("comp", "class"))
        mixed = named.groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("token")
        rows = named.join(mixed, "token").groupBy("class").agg(*(F.first(c).alias(c) for c in ("n", "own", "comp")), F.collect_list(F.struct("token", "pos", "prev")).alias("places"))
        return self.scratch.write(rows.join(bits, "class", "left"), "heads")

    def entries(self, heads: DataFrame) -> DataFrame:
        """The entries in buckets of several components; ``held``: entries of the bucket, ``load``: pairs to compare in it."""
        rows = heads.select("class", "n", "own", "comp", "bits", F.inline("places"))
        by = rows.groupBy("token", "comp").agg(F.count("*").alias("c")).groupBy("token").agg(F.count("*").alias("k"), F.sum("c").alias("held"), F.sum(F.col("c") * F.col("c")).alias("squares"))
        by = by.where("k > 1").select("token", "held", ((F.col("held") * F.col("held") - F.col("squares")) / 2).alias("load"))
        return self.scratch.write(rows.join(by, "token"), "entries")

    def met(self, rows: DataFrame, round_: int) -> DataFrame:
        """Each class and the nearest of the pivots of its buckets.

        Every bucket has one pivot a round: first a set with the fewest shingles of its own, such as what near copies were
        made from, then sets drawn by hash.
        """
        first = (F.col("own") if round_ == 0 else F.lit(0).cast("long")).alias("first")
        drawn = F.struct(first, F.xxhash64("class", F.lit(round_)).alias("h"), *(F.col(c) for c in ("class", "n", "pos", "comp", "bits")))
        pivot = rows.groupBy("token").agg(F.min(drawn).alias("p"))
        apart, may = self._near("a", "p")
        both = rows.alias("a").join(pivot, "token").where((F.col("a.comp") != F.col("p.comp")) & may)
        return both.groupBy(F.col("a.class").alias("a")).agg(F.min(F.struct(apart.alias("apart"), "p.h", "p.class")).alias("p")).select("a", F.col("p.class").alias("b"))

    def rest(self, rows: DataFrame, block: int) -> DataFrame:
        """All pairs ``a, b`` of different components that may link, each once; large buckets are compared block by block.

        The places bound a link at the first common shingle only, and that one has no common shingle before it.
        """
        cut = F.ceil(F.col("held") / block)
        rows = rows.withColumn("own", F.pmod(F.xxhash64("class"), cut)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), cut - 1)))
        _, may = self._near("a", "b")
        same = (F.col("a.token") == F.col("b.token")) & (F.col("a.own") == F.col("b.other")) & (F.col("a.other") == F.col("b.own"))
        return rows.alias("a").join(rows.alias("b"), same & (F.col("a.class") < F.col("b.class")) & (F.col("a.comp") != F.col("b.comp")) & F.coalesce(F.col("a.prev") != F.col("b.prev"), F.lit(True)) & may).select(F.col("a.class").alias("a"), F.col("b.class").alias("b")).distinct()

    def apart(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose ends are in different components."""
        if self.comp is None:
            return pairs
        a, b = self.comp.select(F.col("class").alias("a"), F.col("comp").alias("x")), self.comp.select(F.col("class").alias("b"), F.col("comp").alias("y"))
        return pairs.join(a, "a", "left").join(b, "b", "left").where(F.coalesce("x", "a") != F.coalesce("y", "b")).select("a", "b")

    def run(self, rounds: int, worth: int, block: int) -> DataFrame:
        scratch = self.scratch
        prefixes = self.prefixes()
        groups = self.groups(prefixes)
        self.unite(groups)
        heads = self.heads(prefixes, groups)
        scratch.drop(prefixes)
        rows = self.entries(heads)
        before = float("inf")
        for round_ in range(rounds):
            cost = rows.agg(F.coalesce(F.sum(F.col("load") / F.col("held")), F.lit(0.0)).alias("pairs"), F.count("*").alias("n")).first()
            if min(cost["pairs"], before - cost["pairs"]) <= worth * cost["n"]:
                break
            before = cost["pairs"]
            links = scratch.write(self.verified(self.met(rows, round_)), "links")
            moved = self.unite(links)
            if moved is None:
                break
            now = scratch.write(heads.join(moved, "comp", "left").withColumn("comp", F.coalesce("now", "comp")).drop("now"), "heads")
            scratch.drop(rows, links, heads)
            heads, rows = now, self.entries(now)
        pairs = scratch.write(self.rest(rows, block), "pairs")
        scratch.drop(rows, heads)
        links = scratch.write(self.verified(pairs), "links")
        self.unite(links)
        # the members of groups whose heads are still apart
        members = groups.select(F.col("a").alias("member"), F.col("b").alias("head"))
        pairs = self.apart(pairs)
        for end in ("a", "b"):
            more = pairs.join(members, F.col(end) == F.col("head")).withColumn(end, F.col("member")).select("a", "b")
            pairs = pairs.unionByName(more)
        self.unite(scratch.write(self.verified(pairs.where("a <> b")), "links"))
        return self.comp if self.comp is not None else groups.select(F.col("a").alias("class"), F.col("b").alias("comp"))


def jaccard_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 75, share: float = 0.375, rounds: int = 20, worth: int = 3,
    block: int = 2000, broadcast_rows: int = 1_000_000,
) -> DataFrame:
    """``id_col``, ``n_shingles`` and ``component_id`` for every row: the smallest id that links reach.

    Two documents link if ``100 * |intersection| >= percent * |union|`` of their sets of ``shingle``-word
    shingles (A-Z lower-cased, words between blanks). ``share`` is the part of all shingles on which sets without
    partners are told apart. Pivot rounds go on, up to ``rounds``, while comparing all entries that are left would take more than ``worth``
    comparisons an entry, and the last round saved more than that; then buckets are compared in blocks of ``block`` entries. The ids
    of sets that may link are broadcast up to ``broadcast_rows`` of them, and joined by shuffle beyond. None of these changes the result.

    Null and empty texts have no shingles and link nothing. Rows with a null id keep it, and lend no id
    to others. Repeated rows and ids are rows of their own.
    """
    scratch = Scratch(docs.sparkSession, "jaccard")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    signatures = scratch.write(rows.mapInArrow(_signatures("text", shingle), f"id {docs.schema[id_col].dataType.simpleString()}, n long, class long, check long"), "signatures")
    classes = scratch.write(signatures.where("n > 0").groupBy("class", "check", "n").agg(F.min("id").alias("first")), "classes")
    tokens = rows.select("text").mapInArrow(_sampled("text", shingle, share), "class long, tokens array<long>")
    single = tokens.select("class", F.explode("tokens").alias("token")).groupBy("token").agg(F.min("class").alias("class"), F.max("class").alias("other"))
    own = single.where("class = other").groupBy("class").agg(F.count("*").alias("own"))
    able = classes.join(own, "class", "left").where(F.coalesce("own", F.lit(0)) <= F.col("n") - F.ceil(F.col("n") * percent / 100 - F.lit(1e-9)))
    able = scratch.write(able.select(F.col("first").alias("id"), "class"), "able")
    sets = rows.join(F.broadcast(able) if able.count() <= broadcast_rows else able, "id")
    sets = sets.select("class", "text").mapInArrow(_whole("text", shingle), "class long, n long, tokens array<long>, bits array<long>")
    if not signatures.groupBy("id").count().where("count > 1").isEmpty():
        sets = sets.dropDuplicates(["class"])
    comp = _Join(scratch.write(sets, "sets"), percent, scratch).run(rounds, worth, block)
    linked = classes.join(comp, "class")
    least = linked.groupBy("comp").agg(F.min("first").alias("least"))
    named = classes.join(linked.select("class", "check", "n", "comp"), ["class", "check", "n"], "left").join(least, "comp", "left")
    named = scratch.write(named.select("class", "check", "n", F.coalesce("least", "first").alias("component_id")), "named")
    scratch.finish(signatures, named)
    out = signatures.join(named, ["class", "check", "n"], "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows whose id is the smallest of their component; columns as given. Rows with a null id stay."""
    out = jaccard_components(docs, id_col, text_col, **options)
    dropped = out.where(F.col(id_col) != F.col("component_id")).select(id_col).distinct()
    return docs.join(dropped, id_col, "left_anti")
