"""N-gram Jaccard join by T-occurrence search with DivideSkip, and the groups it links.

A document is the set of its five-word shingles, as 64-bit hashes. Two sets with a Jaccard similarity of 75 % or more
share an element among the first n - ceil(0.75 n) + 1 of each, in any order that is the same for all. The order here puts rare
elements first: a count sketch of fixed size over all documents tells common from rare, ties go by hash.

How many of those elements they must share follows from their sizes, and is a third condition beside the sizes themselves.

1. Equal sets form classes; only the document with the smallest id goes on for each.
2. Representatives that share a leading element meet: each is held against one leader an element. What that links forms components, most
   of them final.
3. Elements whose documents lie in several components show which documents have yet to be searched in which component. The
   members of a component, in blocks of bounded size, are the index; documents of smaller components are the queries.

In both, a block is an inverted index over its documents, and a query finds those with at least T = ceil(0.75 n) of its
elements: of its lists, the T - 1 longest are set aside, the others are merged in a heap, and what comes out is probed
in the long ones by binary search. Overlaps are then exact and held against the similarity itself. One link joins a query and
a component, so further ones needn't be found; no pair of documents is left undecided, and none is dropped for skew.

Edge cases: a document of fewer than five words is one shingle of them all. A null or empty text, or one of white space,
has no shingles and links with nothing. Equal sets are one component. Rows that share an id are one vertex of ``jaccard_components``; rows
without an id have no component. Ids are longs, or what casts to them; others are an error. Very long texts are hashed whole, in slices.
Extra columns are neither read nor returned, except by ``one_of_each``, which keeps all; result columns that would clash with the id's get an
underscore. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ionweave.functions.hamming import bits_apart
from ionweave.llm import chunks
from ionweave.llm.common import beside, cut, discard, freed, fresh, parts, resident, ship, spill_freed, table
from ionweave.llm.shingles import _SALT, BLOCK, fetched, mixed, placed, shingle_sets
from ionweave.operators.components import components

#: Counters a row of the sketch; with three rows of four bytes it is 3 MB, whatever the input.
BUCKETS, ROWS = 1 << 18, 3
#: Sizes are exact bands up to this; beyond it, bands are 1/50 wide.
EXACT_SIZE = 48
#: Documents of one element that a task is to take.
HOT = 20_000

def needed(n: int, percent: int) -> int:
    """The least overlap a set of n elements has with any similar one."""
    return -(-n * percent // 100)


def shared_at_least(a: str, b: str, percent: int) -> str:
    """SQL for how many leading elements sets of a and b elements share if they are similar.

    Similar sets overlap in percent (a + b) / (100 + percent) elements or more. Up to where the first of the two leading parts ends,
    what they share is in both leading parts; beyond it are the other ceil(percent n / 100) - 1 elements of that set."""
    return f"(ceil({percent} * ({a} + {b}) / {100 + percent}) - ceil({percent} * greatest({a}, {b}) / 100))"


def sketch_places(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counter and sign of each element in each row of the sketch."""
    h = np.stack([mixed(x * s) for s in _SALT[:ROWS]])
    return (h >> np.uint64(46)).astype(np.int64) + np.arange(ROWS)[:, None] * BUCKETS, 1 - 2 * ((h >> np.uint64(3)) & np.uint64(1)).astype(np.int64)


def commonness(docs: DataFrame, text_col: str, k: int) -> np.ndarray:
    """The count sketch of all distinct shingles of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resident("jaccard")
        counts = np.zeros(ROWS * BUCKETS, dtype=np.int64)
        for b in parts(batches):
            for s in shingle_sets(b.column(0).to_pylist(), k):
                if s.size:
                    place, sign = sketch_places(s)
                    np.add.at(counts, place.ravel(), sign.ravel())
        some = np.flatnonzero(counts)
        for at in range(0, len(some), 100_000):
            part = some[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(counts[part])], names=["place", "n"])

    got = docs.select(text_col).mapInArrow(run, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    sketch = np.zeros(ROWS * BUCKETS, dtype=np.float32)
    sketch[got["place"].to_numpy()] = got["n"].to_numpy()
    # what a rare element is taken for: a counter's spread, by the median as few elements are common
    noise = float(np.median(np.abs(sketch))) / 0.6745
    return np.append(sketch, np.float32(max(2.0, 3 * noise)))


def levels(s: np.ndarray, sketch: np.ndarray, hot: int) -> tuple[np.ndarray, np.ndarray]:
    """The level of each element, 0 if the sketch can't tell it from rare ones, then one more for each doubling of its
    documents; and its salts, so that some ``hot`` of its documents go to each, 0 if they are fewer in all."""
    place, sign = sketch_places(s)
    estimate = np.median(sketch[place] * sign, axis=0)
    level = np.floor(np.log2(np.maximum(estimate / sketch[-1], 1))).astype(np.int64)
    return level, np.where(estimate > hot, 2 * estimate // hot, 0).astype(np.int32)


def signatures(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int, sketch, hot: int = HOT) -> DataFrame:
    """(id, n, f1, f2, lead, salts, bits, wide): set size, fingerprint of the set, leading elements and the salts of each, and parity
    sketches, bits of which each element of the set turns one over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resident("jaccard")
        for b in parts(batches):
            n, f1, f2, lead, salts, bits, wide = [], [], [], [], [], [], []
            for s in shingle_sets(b.column(1).to_pylist(), k):
                n.append(len(s))
                f1.append(int(mixed(s * _SALT[3]).sum(dtype=np.uint64).view(np.int64)) if s.size else 0)
                f2.append(int(np.bitwise_xor.reduce(mixed(s + _SALT[3])).view(np.int64)) if s.size else 0)
                dealt = np.zeros(0, dtype=np.int32)
                bits.append(chunks.parity(s))
                wide.append(chunks.wide_parity(s))
                if s.size:
                    level, dealt = levels(s, sketch.value, hot)
                    first = np.lexsort((s, level))[: len(s) - needed(len(s), percent) + 1]
                    s, dealt = s[first], dealt[first]
                lead.append(s.view(np.int64))
                salts.append(dealt)
            longs = pa.list_(pa.int64())
            columns = [pa.array(n, pa.int32()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(lead, longs), pa.array(salts, pa.list_(pa.int32()))]
            columns += [pa.array(bits, longs), pa.array(wide, longs)]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=["id", "n", "f1", "f2", "lead", "salts", "bits", "wide"])

    schema = "id long, n int, f1 long, f2 long, lead array<long>, salts array<int>, bits array<long>, wide array<long>"
    return docs.select(F.col(id_col).cast("long").alias("id"), text_col).mapInArrow(run, schema)


class Index:
    """Inverted lists of a block of sets."""

    def __init__(self, ids: list[int], sets: list[np.ndarray]):
        self.ids, self.sizes = ids, np.array([len(s) for s in sets], dtype=np.int64)
        tokens = np.concatenate(sets)
        owners = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(tokens, kind="stable")
        self.tokens, begin = np.unique(tokens[order], return_index=True)
        self.bounds = np.append(begin, len(tokens))
        self.owners = owners[order]

    def lists(self, query: np.ndarray) -> list[np.ndarray]:
        at = np.minimum(np.searchsorted(self.tokens, query), len(self.tokens) - 1)
        at = at[self.tokens[at] == query]
        return [self.owners[a:b] for a, b in zip(self.bounds[at], self.bounds[at + 1], strict=True)]

    def search(self, query: np.ndarray, percent: int, first_only: bool, skip: int | None) -> list[int]:
        """Ids whose similarity to the query reaches the threshold; one of them at most with ``first_only``."""
        t = needed(len(query), percent)
        lists = sorted(self.lists(query), key=len)
        if len(lists) < t:
            return []
        short, long = lists[: len(lists) - t + 1], lists[len(lists) - t + 1 :]
        fits = (self.sizes * 100 >= len(query) * percent) & (self.sizes * percent <= len(query) * 100)
        found: list[int] = []
        waiting: list[tuple[int, int]] = []

        def probe() -> None:
            who = np.array([w for w, _ in waiting])
            count = np.array([c for _, c in waiting])
            waiting.clear()
            for k, owners in enumerate(reversed(long)):
                at = np.minimum(np.searchsorted(owners, who), len(owners) - 1)
                count = count + (owners[at] == who)
                if k % 32 == 31:
                    may = count + len(long) - k - 1 >= t
                    who, count = who[may], count[may]
                    if not who.size:
                        return
            union = self.sizes[who] + len(query) - count
            found.extend(self.ids[w] for w in who[100 * count >= percent * union])

        heap = [(int(x[0]), i) for i, x in enumerate(short)]
        heapq.heapify(heap)
        place = [0] * len(short)
        while heap:
            top, count = heap[0][0], 0
            while heap and heap[0][0] == top:
                i = heap[0][1]
                count += 1
                place[i] += 1
                if place[i] < len(short[i]):
                    heapq.heapreplace(heap, (int(short[i][place[i]]), i))
                else:
                    heapq.heappop(heap)
            if fits[top] and self.ids[top] != skip:
                waiting.append((top, count))
                if len(waiting) >= 256:
                    probe()
                    if first_only and found:
                        return found[:1]
        if waiting:
            probe()
        return found[:1] if first_only else found


def searched(docs: DataFrame, places: DataFrame, first_only: bool, id_col: str, text_col: str, k: int, percent: int) -> DataFrame:
    """Links (a, b) that searches in blocks find. ``places``: (id, block, salt, asks), a row for each document and block, with
    asks 0 for members of the index and 1 for queries. Blocks stream through a task in order: one index is held at a time."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resident("jaccard")
        block, ids, sets, index = None, [], [], None
        for b in parts(batches):
            out: list[tuple[int, int]] = []
            for q, salt, asks, i, elements in zip(*(b.column(c).to_pylist() for c in range(5)), strict=True):
                if (q, salt) != block:
                    block, ids, sets, index = (q, salt), [], [], None
                s = np.frombuffer(elements, dtype=np.uint64)
                if not asks:
                    ids.append(i)
                    sets.append(s)
                elif ids:
                    index = index or Index(ids, sets)
                    out += [(i, x) for x in index.search(s, percent, first_only, i)]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.int64())], names=["a", "b"])
        ids, sets, index = [], [], None
        freed()

    wanted = places.groupBy("id").agg(F.collect_list(F.struct("block", "salt", "asks")).alias("at"))
    rows = fetched(docs, wanted, id_col, text_col, k).select(F.explode("at").alias("x"), "id", "elements").select("x.block", "x.salt", "x.asks", "id", "elements")
    return rows.repartition("block", "salt").sortWithinPartitions("block", "salt", "asks").mapInArrow(search, "a long, b long")


def linked(docs: DataFrame, members: DataFrame, queries: DataFrame, block_size: int, first_only: bool, **how) -> DataFrame:
    """The links (a, b) that queries find among members, written."""
    places = cut(placed(members, queries, block_size), "places")
    links = cut(searched(docs, places, first_only=first_only, **how), "links")
    discard(places)
    spill_freed(docs.sparkSession)
    return links


def leading(classes: DataFrame) -> DataFrame:
    """(rep, n, t, salt): the leading elements of each representative; the documents of a common one are dealt into salts."""
    rows = classes.select("rep", "n", F.explode("lead").alias("x"))
    salt = F.when(F.col("x.salts") > 0, F.pmod(F.xxhash64("rep"), F.col("x.salts"))).otherwise(-1).cast("int")
    return rows.select("rep", "n", F.col("x.lead").alias("t"), salt.alias("salt"))


def star_pairs(stars: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(id, block, n): rows (rep, n, leader, leader_n), one for each shared element, as pairs that may be similar; written."""
    near = stars.filter(f"rep <> leader and 100 * least(n, leader_n) >= {percent} * greatest(n, leader_n)")
    near = near.groupBy("rep", "leader", "n", "leader_n").agg(F.count("*").alias("both"))
    near = near.filter(f"both >= {shared_at_least('n', 'leader_n', percent)}")
    return cut(chunks.near_enough(near.select(F.col("rep").alias("id"), F.col("leader").alias("block")), classes, percent), "stars")


def star_links(docs: DataFrame, stars: DataFrame, block_size: int, **how) -> DataFrame:
    """The links of pairs (id, block, n): what is near a leader is the index, the leader the query."""
    leaders = stars.select(F.col("block").alias("id"), "block").distinct()
    return linked(docs, stars, leaders, block_size, False, **how)


def open_rows(hits: DataFrame, near: DataFrame) -> DataFrame:
    """(t, rep, n, c, members, deal): documents, with their component, of elements found in several components; written.
    ``deal`` is the number of salts for the element's documents."""
    sizes = near.groupBy("component").agg(F.count("*").alias("members")).withColumnRenamed("component", "_c")
    known = near.join(sizes, F.col("component") == F.col("_c")).select(F.col("id").alias("_id"), "_c", "members")
    marked = hits.select("t", "rep", "n").join(known, F.col("rep") == F.col("_id"), "left")
    marked = marked.select("t", "rep", "n", F.coalesce("_c", "rep").alias("c"), F.coalesce("members", F.lit(1)).alias("members"))
    marked = cut(marked, "marked")
    spans = marked.groupBy(F.col("t").alias("_t")).agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("many"))
    spans = spans.filter("lo < hi").select("_t", F.ceil(F.col("many") / F.lit(float(HOT))).cast("int").alias("deal"))
    rest = cut(marked.join(spans, F.col("t") == F.col("_t")).drop("_t"), "rest")
    discard(marked)
    return rest


def band_of(n: str) -> Column:
    """Sizes in bands: each its own up to ``EXACT_SIZE``, then 1/50 wide."""
    return F.expr(f"cast(if({n} <= {EXACT_SIZE}, {n}, {EXACT_SIZE + 1} + floor(ln({n} / {EXACT_SIZE + 1}.0D) / ln(1.02D))) as int)")


def hopeful(rest: DataFrame, percent: int) -> DataFrame:
    """The rows of ``rest`` whose document may be similar to one of another component by that element; written.

    Similar documents of a and b elements share ``shared_at_least`` leading ones, so each has as many that other documents
    have too. What the documents of an element and a band of sizes have of these at most, and their least and largest
    size, shows for a whole band at once that none of it is similar to a document, before pairs are made.
    """
    own = rest.groupBy("rep").agg(F.count("*").alias("own")).withColumnRenamed("rep", "_r")
    rows = cut(rest.join(own, F.col("rep") == F.col("_r")).drop("_r"), "rows")
    extent = [F.min("n").alias("lo"), F.max("n").alias("hi"), F.max("own").alias("most"), F.min("c").alias("c0"), F.max("c").alias("c1")]
    cells = rows.groupBy(F.col("t").alias("_t"), band_of("n").alias("band")).agg(*extent)
    # as many as there are bands at most, so a few hundred for an element, however many documents have it
    cells = cells.groupBy("_t").agg(F.collect_list(F.struct("lo", "hi", "most", "c0", "c1")).alias("cells"))
    # the sizes of a cell that fit a document of n; the number to share rises up to n, and falls beyond but for rounding
    low, high = f"greatest(x.lo, cast(ceil({percent} * n / 100) as int))", f"least(x.hi, cast(floor(100 * n / {percent}) as int))"
    below = f"if({low} <= n, {shared_at_least('n', low, percent)}, 1000000000)"
    above = f"if({high} > n, {shared_at_least('n', high, percent)} - if({high} > greatest(n, {low}), 1, 0), 1000000000)"
    may = f"(x.c0 <> c or x.c1 <> c) and {low} <= {high} and least(own, x.most) >= least({below}, {above})"
    kept = rows.join(cells, F.col("t") == F.col("_t")).filter(F.expr(f"exists(cells, x -> {may})")).select(*rest.columns)
    out = cut(kept, "rest")
    discard(rows, rest)
    return out


def near_enough(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (id, block) of representatives whose bits allow that they are similar: sets of a and b elements that are
    differ in (a + b) (100 - percent) / (100 + percent) elements at most, and each of those turns one bit at most."""
    side = lambda p: classes.select(F.col("rep").alias(f"_{p}"), F.col("n").alias(f"n{p}"), F.col("bits").alias(f"bits{p}"))
    met = pairs.join(side("a"), F.col("id") == F.col("_a")).join(side("b"), F.col("block") == F.col("_b"))
    return met.filter(bits_apart("bitsa", "bitsb") * (100 + percent) <= (F.col("na") + F.col("nb")) * (100 - percent)).select(*pairs.columns)


def asked(rest: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(id, block, many): documents and the larger components (of equal ones, those with the smaller name) that they share
    enough elements with; written."""
    here = rest.withColumn("salt", F.pmod(F.xxhash64("rep"), F.col("deal")))
    there = rest.groupBy("t", F.col("c").alias("block"), "deal").agg(F.max("members").alias("many"), F.min("n").alias("lo"), F.max("n").alias("hi"))
    there = there.select("t", "block", "many", "lo", "hi", F.explode(F.sequence(F.lit(0), F.col("deal") - 1)).alias("salt"))
    pairs = here.join(there, ["t", "salt"]).filter("c <> block and (members < many or (members = many and c > block))")
    pairs = pairs.groupBy("rep", "n", "block").agg(F.count("*").alias("both"), F.max("many").alias("many"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    fit = F.expr(f"greatest(lo, cast(ceil({percent} * n / 100) as int))"), F.expr(f"least(hi, cast(floor(100 * n / {percent}) as int))")
    pairs = pairs.withColumn("low", fit[0]).withColumn("hi", fit[1]).withColumn("lo", F.col("low"))
    # the number falls as sizes part, so the ends of the sizes in question have the least; one less for the rounding between
    few = f"least({shared_at_least('n', 'lo', percent)}, {shared_at_least('n', 'hi', percent)}) - if(lo = hi, 0, 1)"
    pairs = cut(pairs.filter("lo <= hi").filter(f"both >= {few}").select(F.col("rep").alias("id"), "block", "many"), "pairs")
    # a component of one is held against the query itself
    alone = near_enough(pairs.filter("many = 1"), classes, percent)
    out = cut(pairs.filter("many > 1").unionByName(alone), "queries")
    discard(pairs)
    return out


def jaccard_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 75, block_size: int = BLOCK, hot: int = HOT
) -> DataFrame:
    """(id, n_shingles, component_id) of each row. ``percent`` is the least similarity, ``k`` the words of a shingle (64 at most)."""
    spark = ship(docs.sparkSession)
    if not 0 < percent <= 100 or not 0 < k <= 64:
        raise ValueError("percent is 1 to 100, k is 1 to 64")
    how = {"id_col": id_col, "text_col": text_col, "k": k, "percent": percent}
    sketch = spark.sparkContext.broadcast(commonness(docs, text_col, k))
    signed = cut(signatures(docs, id_col, text_col, k, percent, sketch, hot), "signatures")
    classes = signed.filter("n > 0 and id is not null").groupBy("f1", "f2", "n").agg(F.min(F.struct("id", "lead", "salts", "bits", "wide")).alias("x"))
    classes = cut(classes.select("f1", "f2", "n", F.col("x.id").alias("rep"), F.arrays_zip("x.lead", "x.salts").alias("lead"), "x.bits", "x.wide"), "classes")
    own = cut(signed.select("id", "f1", "f2", "n"), "own")
    discard(signed)
    spill_freed(spark)

    # a salt of a common element has a leader of its own; what links across salts shows later
    by_rep = Window.partitionBy("t", "salt").orderBy("rep", "n")
    leads = leading(classes).withColumn("x", F.first(F.struct("rep", "n")).over(by_rep)).withColumn("next", F.lead("rep").over(by_rep))
    leads = leads.filter("salt >= 0 or next is not null or rep <> x.rep").select("t", "rep", "n", F.col("x.rep").alias("leader"), F.col("x.n").alias("leader_n"))
    hits = cut(leads, "hits")
    spill_freed(spark)
    stars = star_pairs(hits, classes, percent)
    links = star_links(docs, stars, block_size, **how)
    near = cut(found := components(links), "near")
    discard(stars, links, found)

    # what is left open is held against the shortest document of each element and band of sizes, then against components
    rest = hopeful(open_rows(hits, near), percent)
    discard(hits)
    if not rest.isEmpty():
        shortest = Window.partitionBy("t", "salt", "band").orderBy("n", "rep")
        dealt = rest.withColumn("salt", F.pmod(F.xxhash64("rep"), F.col("deal"))).withColumn("band", band_of("n"))
        dealt = dealt.withColumn("x", F.first(F.struct("rep", "n", "c")).over(shortest)).filter("c <> x.c")
        stars = star_pairs(dealt.select("rep", "n", F.col("x.rep").alias("leader"), F.col("x.n").alias("leader_n")), classes, percent)
        links = star_links(docs, stars, block_size, **how)
        edges = near.select(F.col("id").alias("a"), F.col("component").alias("b"))
        nearer = cut(found := components(edges.unionByName(links)), "near")
        discard(stars, links, found, near)
        near, before = nearer, rest
        rest = open_rows(before, near)
        discard(before)
    links = []
    if not rest.isEmpty():
        queries = asked(rest, classes, percent)
        wanted = queries.select(F.col("block").alias("_b")).distinct()
        members = rest.select(F.col("rep").alias("id"), F.col("c").alias("block"), "n").distinct()
        members = members.join(wanted, F.col("block") == F.col("_b"), "left_semi")
        links = [linked(docs, members, queries.select("id", "block"), block_size, True, **how)]
        discard(queries)
    edges = near.select(F.col("id").alias("a"), F.col("component").alias("b"))
    whole = components(edges.unionByName(links[0])) if links else near
    named = classes.select("f1", "f2", "n", "rep").join(whole.withColumnRenamed("id", "rep"), "rep", "left")
    named = cut(named.select("f1", "f2", "n", F.coalesce("component", "rep").alias("component")), "named")
    discard(rest, classes, near, whole, *links)
    spill_freed(spark)
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    names = beside(id_col, ["n_shingles", "component_id"])
    out = own.join(named, ["f1", "f2", "n"], "left")
    return out.select(F.col("id").alias(id_col), F.col("n").cast("long").alias(names[0]), component.alias(names[1]))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with one document of each component, that of the smallest id; rows without an id all stay.

    A document is an id and a text. Ids that are unique are the vertices themselves; where some repeat with other texts, documents are
    numbered, and of a component that of the smallest id stays, then that of the smallest digest. Of rows that repeat both, the one whose
    other columns are first as JSON stays.
    """
    key, digest, place = (fresh(docs, x) for x in ("_keep", "_digest", "_place"))
    known = docs.filter(F.col(id_col).isNotNull()).withColumn(digest, F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")))
    seen = known.groupBy(id_col).agg(F.min(digest).alias("a"), F.max(digest).alias("b"), F.count("*").alias("n"))
    fact = seen.agg(F.max(F.col("a") != F.col("b")).alias("other_texts"), F.max("n").alias("n")).first()
    if not fact["other_texts"]:
        found = jaccard_components(docs, id_col, text_col, **how).toDF("_id", "_n", "_component")
        keep = found.filter("_id = _component").select(F.col("_id").alias(key)).distinct()
        first = known.join(keep, F.col(id_col).cast("long") == F.col(key), "left_semi")
    else:
        pairs = known.select(id_col, digest).distinct()
        # numbered once, in a table, so that a task that runs again finds the same numbers
        numbers = cut(pairs.withColumn(place, F.monotonically_increasing_id()), "numbers")
        vertices = cut(known.join(numbers, [id_col, digest]).select(place, text_col).distinct(), "vertices")
        found = jaccard_components(vertices, place, text_col, **how).toDF("_v", "_n", "_component")
        member = found.join(numbers, F.col("_v") == F.col(place)).select("_component", F.struct(F.col(id_col).cast("long").alias("i"), F.col(digest).alias("d"), F.col("_v").alias("v")).alias("x"))
        keep = member.groupBy("_component").agg(F.min("x").alias("x")).select(F.col("x.v").alias(key))
        keep = numbers.join(keep, F.col(place) == F.col(key), "left_semi").select(F.col(id_col).alias("_i"), F.col(digest).alias("_d"))
        first = known.join(keep, (F.col(id_col) == F.col("_i")) & (F.col(digest) == F.col("_d")), "left_semi")
    if fact["n"] and fact["n"] > 1:
        row = F.struct(*(F.col(c) for c in docs.columns))
        least = first.groupBy(id_col, digest).agg(F.min_by(row, F.to_json(row)).alias(key))
        first = least.select(*(F.col(f"{key}.{c}").alias(c) for c in docs.columns))
    return first.select(*docs.columns).unionByName(docs.filter(F.col(id_col).isNull()))


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


ORACLE = """
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\t\\n\\x0B\\f\\r]+') AS w FROM documents),
listed AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
          ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words),
shingles AS (SELECT doc_id, unnest(s) AS g FROM listed),
sizes AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM listed),
met AS (SELECT a.doc_id AS i, b.doc_id AS j, count(*) AS o FROM shingles AS a JOIN shingles AS b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
linked AS (SELECT i, j FROM met JOIN sizes AS x ON x.doc_id = i JOIN sizes AS y ON y.doc_id = j WHERE 100 * o >= 75 * (x.n + y.n - o)),
both_ways AS (SELECT i, j FROM linked UNION ALL SELECT j, i FROM linked),
reach(id, o) AS (SELECT DISTINCT i, i FROM both_ways UNION SELECT r.id, b.j FROM reach AS r JOIN both_ways AS b ON r.o = b.i),
smallest AS (SELECT id, min(o) AS component FROM reach GROUP BY id)
SELECT s.doc_id, s.n AS n_shingles, coalesce(l.component, s.doc_id) AS component_id FROM sizes AS s LEFT JOIN smallest AS l ON l.id = s.doc_id
"""
