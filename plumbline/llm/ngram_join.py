"""N-gram Jaccard join by a MinHash LSH forest with exact verification.

Texts are sets of shingles of five words. Equal texts are one class from the start, so copies cost no comparison. Each
distinct text gets a signature, and tree t of the forest is a prefix trie of all signatures read from the value ``DEPTH * t``
on, round and round. Paths of different trees differ in their first ``DEPTH`` values, so that many independent chances find
a pair; deeper down they share values, which costs no hashing and only tells what to compare first.

Texts that share the first ``DEPTH`` values of a path meet, sorted along the path: a prefix trie. It is walked from the
deepest shared prefixes up. Where branches join, texts that no deeper match has connected are compared by whole signatures,
far below the threshold; what holds together is written as a spanning forest, never as all pairs. Matched prefixes are
shortened value by value, each branch from as deep as it goes and for as long as it holds texts that are not connected,
until ``DEPTH``: there the trees together find a pair of the threshold similarity with the target recall, and a shorter
prefix is not needed. The forest's components are families, and within a family every pair is verified on its exact shingle
sets; again only counts by text and a spanning forest leave the task.

Large tries and families are dealt to pairs of blocks of about ``BLOCK`` texts, or fewer of long ones, so no task holds an
unbounded group and none is capped. Work within a family grows with the square of its distinct texts, as its links do;
what is moved for that grows by one copy of a text for each ``BLOCK`` texts of its family.

Defined results: a text without a word has no shingles, links to nothing and is a class of its own with its doc_id; a text
of fewer than five words is one shingle; rows with null ids are linked as others, and a class of them alone has a null
class; an empty table gives an empty table; other columns are ignored by ``join`` and kept by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import alone_in_worker, bounded_batches, cut, small_side
from .components import components

SHINGLE = 5
#: The threshold is a fraction, so that comparisons are exact.
NUMERATOR, DENOMINATOR = 8, 10
HASHES = 96
RECALL = 0.99999
#: A pair is a candidate if so many of its hash values agree: six standard deviations below what the threshold gives.
AGREE = int(HASHES * (0.8 - 6 * (0.8 * 0.2 / HASHES) ** 0.5))
#: Texts of a block, and bytes of text of one that is verified (the longest text may be more).
BLOCK, BLOCK_BYTES = 256, 1 << 24
#: The low bits of a trie's number tell its tree.
TREE_BITS = 5
#: Rows of (key, id) that may be broadcast: some 40 bytes each.
BROADCAST_KEYS = 250_000
#: Shingles hashed together, and words whose hash a worker remembers.
CHUNK, CACHE_WORDS = 1 << 18, 250_000

_rng = np.random.default_rng(20240229)
_FACTORS = _rng.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MASKS = _rng.integers(0, 2**63, HASHES, dtype=np.uint64)
_PLACES = _rng.integers(1, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_words: dict[bytes, int] = {}


def depth_for(recall: float = RECALL, similarity: float = NUMERATOR / DENOMINATOR, hashes: int = HASHES) -> int:
    """How far prefixes are shortened: the deepest at which ``hashes // depth`` trees find a pair of ``similarity`` at the target recall."""
    for depth in range(8, 1, -1):
        if 1 - (1 - similarity**depth) ** (hashes // depth) >= recall:
            return depth
    return 1


DEPTH = depth_for()
TREES = HASHES // DEPTH


def _word_hash(word: bytes) -> int:
    import xxhash

    if len(_words) >= CACHE_WORDS:
        _words.clear()
    got = _words[word] = xxhash.xxh3_64_intdigest(word)
    return got


def _mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of the input."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed shingles of all texts in a row, and how many each text has."""
    each: list[int] = []
    sizes = []
    known = _words.get
    for t in texts:
        words = t.encode("utf-8", "surrogatepass").split()  # bytes split at exactly the six white-space characters of ASCII
        each += [known(w) or _word_hash(w) for w in words]
        sizes.append(len(words))
        if 0 < len(words) < SHINGLE:  # filled up, so that it is one shingle
            each += [len(words)] * (SHINGLE - len(words))
            sizes[-1] = SHINGLE
    n = np.array(sizes, np.int64)
    counts = np.maximum(n - SHINGLE + 1, 0)
    w = np.array(each, np.uint64)
    if not counts.sum():
        return np.zeros(0, np.uint64), counts
    rolled = np.zeros(len(w) - SHINGLE + 1, np.uint64)
    for k in range(SHINGLE):
        rolled += w[k : k + len(rolled)] * _PLACES[k]
    ends = np.cumsum(n)
    inside = np.ones(len(rolled), bool)
    for k in range(1, SHINGLE):
        at = ends[:-1] - k
        inside[at[(at >= 0) & (at < len(rolled)) & (n[:-1] > 0)]] = False
    return _mixed(rolled[inside]), counts


def signatures(texts: list[str]) -> list[bytes | None]:
    """For each text its ``HASHES`` least values of 32 bits; None without a word."""
    h, counts = shingles(texts)
    has = counts > 0
    if not has.any():
        return [None] * len(texts)
    starts = (np.cumsum(counts) - counts)[has]
    out = np.empty((len(starts), HASHES), ">u4")
    for i in range(HASHES):
        out[:, i] = np.minimum.reduceat((h ^ _MASKS[i]) * _FACTORS[i], starts) >> np.uint64(32)
    rows = iter(out)
    return [next(rows).tobytes() if x else None for x in has]


def _sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    alone_in_worker("ngram_join", _words.clear)
    for batch in batches:
        texts: list[str] = []
        sigs: list[bytes | None] = []
        held = 0
        for value in batch.column(2):
            texts.append(value.as_py() or "")
            held += len(texts[-1]) // 6
            if held >= CHUNK:
                sigs += signatures(texts)
                texts, held = [], 0
        sigs += signatures(texts)
        size = pa.compute.fill_null(pa.compute.binary_length(batch.column(2)), 0).cast(pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sigs, pa.binary()), size], names=["doc_id", "key", "sig", "bytes"])


class Forest:
    """Union-find that remembers the edges that joined something."""

    def __init__(self, n: int):
        self._up = list(range(n))
        self.edges: list[tuple[int, int]] = []

    def _root(self, i: int) -> int:
        up = self._up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self._root(i), self._root(j)
        if a != b:
            self._up[max(a, b)] = min(a, b)
            self.edges.append((i, j))


def _groups(batches: Iterable[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows of equal first three columns, which come sorted by them."""
    rows: list[tuple] = []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if rows and rows[-1][:3] != row[:3]:
                yield rows
                rows = []
            rows.append(row)
    if rows:
        yield rows


def _facing(rows: list[tuple]) -> list[np.ndarray]:
    """For each row the later rows that it is compared with: all in a block with itself, else those of the other block."""
    side = np.array([r[3] for r in rows])
    later = np.arange(len(rows))
    if rows[0][1] == rows[0][2]:
        return [later[i + 1 :] for i in range(len(rows))]
    return [later[i + 1 :][side[i + 1 :] != side[i]] for i in range(len(rows))]


def trie_order(paths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows along their paths, and how many first values each row of that order shares with the one before."""
    order = np.argsort(np.ascontiguousarray(paths, ">u4").view(f"S{4 * paths.shape[1]}").ravel(), kind="stable")
    same = paths[order[1:]] == paths[order[:-1]]
    return order, np.where(same.all(axis=1), paths.shape[1], same.argmin(axis=1))


def descend(sigs: np.ndarray, tree: int, side: np.ndarray | None) -> list[tuple[int, int]]:
    """A spanning forest of the rows that agree, from the deepest shared prefixes up to those of ``DEPTH`` values.

    With ``side`` only rows of different sides are compared. Each pair is looked at once at most, where its branches join.
    """
    if len(sigs) == 2:
        return [(0, 1)] if (side is None or side[0] != side[1]) and (sigs[0] == sigs[1]).sum() >= AGREE else []
    order, shared = trie_order(np.roll(sigs, -DEPTH * tree, axis=1))
    edges: list[tuple[int, int]] = []
    part = np.arange(len(sigs))  # what a row is connected with
    start = np.arange(len(sigs))  # of the branch that ends at a place
    end = np.arange(len(sigs))  # of the branch that starts at a place
    for at in np.argsort(-shared, kind="stable").tolist():
        low, high = int(start[at]), int(end[at + 1])
        end[low], start[high] = high, low
        if (part[order[low : high + 1]] == part[order[low]]).all():
            continue
        left, right = order[low : at + 1], order[at + 1 : high + 1]
        if len(left) > len(right):
            left, right = right, left
        for i in left.tolist():
            others = right[part[right] != part[i]]
            if side is not None:
                others = others[side[others] != side[i]]
            for j in others[(sigs[others] == sigs[i]).sum(axis=1) >= AGREE].tolist() if len(others) else ():
                if part[j] != part[i]:
                    edges.append((i, j))
                    part[part == part[j]] = part[i]
    return edges


def _candidates(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, i, j, block, key, sig) -> a spanning forest of what agrees."""
    for rows in _groups(batches):
        sigs = np.frombuffer(b"".join(r[5] for r in rows), ">u4").astype(np.uint32).reshape(len(rows), HASHES)
        edges = descend(sigs, rows[0][0] & ((1 << TREE_BITS) - 1), None if rows[0][1] == rows[0][2] else np.array([r[3] for r in rows]))
        if edges:
            yield pa.RecordBatch.from_arrays([pa.array([rows[e[k]][4] for e in edges], pa.binary()) for k in (0, 1)], names=["a", "b"])


def _verified(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (family, i, j, block, key, n, text) -> (a, b, links): links by text, and a spanning forest with null links."""
    alone_in_worker("ngram_join", _words.clear)
    for rows in _groups(batches):
        h, counts = shingles([r[6] for r in rows])
        sets = [np.unique(x) for x in np.split(h, np.cumsum(counts)[:-1])]
        sizes = np.array([len(s) for s in sets])
        places = np.unique(np.concatenate(sets), return_inverse=True)[1]
        starts = np.cumsum(sizes) - sizes
        marked = np.zeros(places.max() + 1, np.int64)
        weight = np.array([r[5] for r in rows], np.int64)
        links = np.zeros(len(rows), np.int64)
        forest = Forest(len(rows))
        for i, others in enumerate(_facing(rows)):
            if not len(others):
                continue
            own = places[starts[i] : starts[i] + sizes[i]]
            marked[own] = 1
            common = np.add.reduceat(marked[places], starts)[others]
            marked[own] = 0
            near = others[DENOMINATOR * common >= NUMERATOR * (sizes[others] + sizes[i] - common)]
            links[i] += weight[near].sum()
            links[near] += weight[i]
            for j in near.tolist():
                forest.join(i, j)
        a = [rows[i][4] for i in np.flatnonzero(links)] + [rows[i][4] for i, _ in forest.edges]
        b = [None] * int((links > 0).sum()) + [rows[j][4] for _, j in forest.edges]
        n = [int(x) for x in links[links > 0]] + [None] * len(forest.edges)
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(n, pa.int64())], names=["a", "b", "links"])


def _dealt(rows: DataFrame, group: str, blocks: Column, rest: list[str]) -> DataFrame:
    """Rows of a group go to every pair of blocks (i, j) that their own block is in; the rows of a pair come together."""
    rows = rows.withColumn("__blocks", F.greatest(F.ceil(blocks), F.lit(1)).cast("int")).withColumn("block", F.pmod(F.xxhash64("key"), F.col("__blocks")).cast("int"))
    rows = rows.withColumn("__with", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)))
    rows = rows.select(group, F.least("block", "__with").alias("i"), F.greatest("block", "__with").alias("j"), "block", "key", *rest)
    return rows.repartition(group, "i", "j").sortWithinPartitions(group, "i", "j", *rest[:1])


def classes(docs: DataFrame) -> DataFrame:
    """Per distinct text that has a copy or a link: key, least_id, class_id, n_links, and the class's root: the key of one of
    its texts, which tells it from all others where class_id is null or repeated."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _key(F.col("text")).alias("key"), F.col("text").cast("string").alias("text"))
    signed = rows.mapInArrow(_sign, "doc_id long, key binary, sig binary, bytes long")
    texts = cut(signed.groupBy("key").agg(F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("n"), F.max("sig").alias("sig"), F.max("bytes").alias("bytes")))

    # roots of the tries: the first DEPTH values of each tree's paths
    part = lambda t: F.shiftleft(F.xxhash64(F.lit(t), F.substring("sig", 1 + 4 * DEPTH * t, 4 * DEPTH)), TREE_BITS) + t
    paths = texts.filter("sig is not null").select("key", F.explode(F.array(*[part(t) for t in range(TREES)])).alias("bucket"))
    shared = paths.groupBy("bucket").agg(F.count(F.lit(1)).alias("members"), F.min("key").alias("lo"), F.max("key").alias("hi"), F.bit_xor(F.xxhash64("key")).alias("all")).filter("members > 1")
    # trees that found the same members need one comparison
    shared = shared.groupBy("members", "lo", "hi", "all").agg(F.min("bucket").alias("bucket")).select("bucket", "members")
    met = paths.join(shared, "bucket").join(texts.select("key", "sig"), "key")
    forest = _dealt(met, "bucket", F.col("members") / BLOCK, ["sig"]).mapInArrow(_candidates, "a binary, b binary")
    families = cut(components(forest).select(F.col("node").alias("key"), F.col("root").alias("family")))

    members = families.join(texts.select("key", "least_id", "n", "bytes"), "key")
    sizes = members.groupBy("family").agg(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("bytes") / BLOCK_BYTES).alias("blocks"))
    wanted = cut(members.join(sizes, "family").select(F.col("key").alias("__key"), "family", "blocks", "least_id", "n"))
    read = rows.join(small_side(wanted, BROADCAST_KEYS), (F.col("key") == F.col("__key")) & F.col("doc_id").eqNullSafe(F.col("least_id"))).dropDuplicates(["key"])
    checked = _dealt(read.select("family", "blocks", "key", "n", "text"), "family", F.col("blocks"), ["n", "text"]).mapInArrow(_verified, "a binary, b binary, links long")
    checked = cut(checked)

    links = checked.filter("b is null").groupBy(F.col("a").alias("key")).agg(F.sum("links").alias("links"))
    roots = components(checked.filter("b is not null").select("a", "b")).select(F.col("node").alias("key"), "root")
    linked = wanted.select(F.col("__key").alias("key"), "least_id").join(roots, "key")
    firsts = linked.groupBy("root").agg(F.min("least_id").alias("class_id"))
    found = linked.join(firsts, "root").join(links, "key").select("key", "class_id", "root", "links")
    some = texts.select("key", "least_id", "n", F.col("sig").isNotNull().alias("worded")).join(found, "key", "left").filter("worded and (n > 1 or links is not null)")
    return some.select("key", "least_id", F.coalesce("class_id", "least_id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "key").alias("root"))


def _key(text: Column) -> Column:
    """128 bits that stand for a whole text; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary")))


def join(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, class_id (the least doc_id of all that are linked to it over any steps) and n_links, the number
    of other documents whose similarity with it reaches the threshold, copies included."""
    of = cut(classes(docs).select(F.col("key").alias("__key"), "class_id", "n_links"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _key(F.col("text")).alias("__k"))
    rows = rows.join(small_side(of, BROADCAST_KEYS), F.col("__k") == F.col("__key"), "left")
    return rows.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents without the others of each class: the one with the least doc_id stays, once if that row is repeated;
    a null id stays only where the class has no other."""
    of = cut(classes(docs).select("key", "least_id", "root"))
    # a minimum is taken before rows are dealt, so no task gathers a large class
    firsts = of.groupBy("root").agg(F.min(F.struct(F.col("least_id").isNull().alias("none"), "least_id", "key")).alias("first"))
    of = of.join(firsts.select("first.key", F.lit(True).alias("__first")), "key", "left")
    of = cut(of.select(F.col("key").alias("__key"), F.col("least_id").alias("__least"), F.coalesce("__first", F.lit(False)).alias("__first")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col("doc_id").cast("long").alias("__id"), _key(F.col("text")).alias("__k"))
    rows = rows.join(small_side(of, BROADCAST_KEYS), F.col("__k") == F.col("__key"), "left")
    alone = rows.filter("__key is null").select("__row")
    first = rows.filter("__first").filter(F.col("__id").eqNullSafe(F.col("__least"))).dropDuplicates(["__k"]).select("__row")
    return alone.unionByName(first).select("__row.*")

