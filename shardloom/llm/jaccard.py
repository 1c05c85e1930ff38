"""N-gram Jaccard join with PartEnum signatures: every link at the threshold, and what it connects.

A document's set holds the 64-bit hashes of its word n-grams. Sets fall into bands of size by powers
of two; a set signs for its own band, and for the next one if a partner can lie there. For each band
the domain of hashes is cut into first-level partitions of about _load() elements at the band's largest
size (8 at 80 %), and each of these into SECOND (in the bands of small sets SECOND_SMALL) second-level partitions. In a
first-level partition all subsets that leave LEFT_OUT of its second-level partitions out are enumerated;
the projection of the set on such a subset, if it isn't empty, is a signature.

Why linked sets share one: sets r, s with Jaccard >= t % differ in at most k = (100 - t)(|r| + |s|) / (100 + t)
elements. Call a first-level partition common if r and s agree, and aren't empty, on one of its
enumerated subsets. Let r occupy j second-level partitions of one that isn't common. If r and s differ in
more than LEFT_OUT of them, it holds at least LEFT_OUT + 1 differences. If not, r's j partitions all
differ, since a subset around one that agrees would be common; it holds at least j. So each partition that
isn't common holds at least c = min(j, LEFT_OUT + 1) differences. In the order of partitions, those of r before
the first common one have a sum of c of at most k. A set therefore signs partitions in order as long as the sum of c
of those before is at most k (with the largest partner that its size admits), and the first common
one is signed by r and by s. Where the sum over all of a set's partitions is at most k, there may be no common one:
such sets, which are rare (many elements must have met in few partitions), sign all of theirs and once more
under another hash of the elements, in a space of their own; after LEVELS such attempts they share a
signature. If one of two linked sets has a large enough sum, a common partition exists and the other signs
all it has; if neither has, both go on to the next hash. So no link is lost, and no signature is
shared by sets for being empty. Sets with k = 0 link with equal sets only and need no signature.

Equal sets are one class from the start (grouped by a 128-bit digest), so copies cost no pairs.
Candidates are the classes that share a signature, thinned by size and by odd sketches: the parity
of the set's elements in each of CELLS cells differs in at most |r xor s| cells, so a larger difference
proves that two sets are no link. Candidate pairs are verified on the sets themselves.

Only components are asked for, so pairs within one component need no look. Round one takes, for each
class, the closest of those with the smallest id in one of its signatures, which joins most of a group
of near copies; round two takes one pair for each two components that share a signature; round three
takes every pair of one signature that still lies in two components and holds at least one class
outside the component that has most of the signature's classes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shardloom.llm.common import arrow_limits, components, drop, fresh, need, only, shared_table

N_WORDS, THRESHOLD = 5, 80
#: Second-level partitions of one, and how many of them an enumerated subset leaves out.
SECOND, LEFT_OUT = 3, 1
#: The bands below this one (of sets below 32 elements) have more second-level partitions, so that few elements meet in one.
SECOND_SMALL, SMALL_BANDS = 12, 5
#: Hashes under which sets sign whose elements lie in too few partitions. Below a threshold of about 40 % most do, and share signatures for it.
LEVELS = 4
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)  # fixed values: multipliers of a 64-bit mixer
_S = np.uint64(33)
_U32 = np.uint64(32)
#: Classes of more rows than this and than a part in HOT_PARTS of all rows are found by a broadcast of at most HOT_PARTS rows.
HOT, HOT_PARTS = 256, 10_000
#: So many ids are broadcast at most (about 50 MB as a hash table).
MOST_SENT = 1_000_000
#: Largest bitmap of ids that is sent to the workers: 32 MB.
MOST_BITS = 1 << 28
#: Parities of the sketch that pairs are thinned by before their sets are compared; it tells sets of thousands of elements apart.
FINE_CELLS = 4096
#: Sets of so many elements carry the fine sketch from the start.
FINE_FROM = 1024
CELLS = 1024
SKETCH = tuple(f"o{i}" for i in range(CELLS // 64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S)) * _M1
    x = (x ^ (x >> _S)) * _M2
    return x ^ (x >> _S)


class _Words(dict):
    """Hash of each word, kept for the next time; forgotten when there are too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _words() -> _Words:
    return only("words", _Words)


def _factor(i: int) -> np.uint64:
    """The multiplier of a shingle's i-th word: odd, and unrelated to the others, so that no regular pattern of words cancels out."""
    return np.uint64(xxhash.xxh3_64_intdigest(b"place %d" % i) | 1)


def shingle_sets(texts: list[str | None], n_words: int = N_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The sets of some texts one after another, each sorted, and the bounds between them.

    A set holds the distinct hashes of a text's word n-grams, A-Z lower-cased; of all its words, if they are fewer; nothing without words.
    """
    words: list[bytes] = []
    bounds = [0]
    for x in texts:
        words += (x or "").encode("utf-8", "replace").lower().split()  # of bytes: ASCII letters and ASCII white space only
        bounds.append(len(words))
    h = np.fromiter(map(_words().__getitem__, words), np.uint64, len(words))
    at = np.array(bounds, np.int64)
    n = np.diff(at)
    whole = np.zeros(len(words), np.uint64)
    last = max(0, len(words) - n_words + 1)
    for i in range(n_words):
        whole[:last] += h[i : i + last] * _factor(i)
    whole += np.uint64(n_words)
    for d in np.flatnonzero((n > 0) & (n < n_words)):
        own = h[at[d] : at[d + 1]]
        whole[at[d]] = (own * np.array([_factor(i) for i in range(len(own))])).sum() + np.uint64(len(own))
    size = np.where(n > 0, np.maximum(n - n_words, 0) + 1, 0)
    ends = np.concatenate(([0], np.cumsum(size)))
    # the first size[d] places of each text
    flat = _mix(whole[np.arange(ends[-1]) + np.repeat(at[:-1] - ends[:-1], size)])
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        flat[a:b].sort()
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    new[ends[:-1][size > 0]] = True
    kept = np.concatenate(([0], np.cumsum(new)))
    return flat[new], kept[ends]


def shingles(text: str | None, n_words: int = N_WORDS) -> np.ndarray:
    """The set of one text."""
    return shingle_sets([text], n_words)[0]


def odd_sketch(s: np.ndarray, cells: int = CELLS) -> np.ndarray:
    """So many parities (a power of two) as 64-bit numbers."""
    bits = np.bincount((s & np.uint64(cells - 1)).astype(np.int64), minlength=cells).astype(np.uint8) & 1
    return np.packbits(bits).view(np.int64)


def odd_sketches(s: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The sketches of CELLS parities of some sets, one after another: a row for each."""
    place = np.repeat(np.arange(len(size)), size) * CELLS + (s & np.uint64(CELLS - 1)).astype(np.int64)
    odd = np.bincount(place, minlength=len(size) * CELLS).astype(np.uint8) & 1
    return np.packbits(odd.reshape(-1, CELLS), axis=1).view(np.int64)


def _lists(flat: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    """Numbers as lists of so many each."""
    ends = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))


def most_missing(n, largest, t: int):
    """In how many elements a set of n and a linked one of at most so many can differ."""
    return (100 - t) * (n + largest) // (100 + t)


def _load(t: int) -> float:
    """Elements of a first-level partition at a band's largest size: a ninth fewer than would leave just as many partitions as k needs."""
    return 8 / 9 * (LEFT_OUT + 1) * (100 + t) / max(1, 2 * (100 - t))


def _enumerated(s: np.ndarray, size: np.ndarray, band: np.ndarray, k: np.ndarray, second: int, level: int, load: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of sets (one after another, each sorted, none empty), which set each is of, and which sets have too few partitions for their k."""
    owner = np.repeat(np.arange(len(size)), size)
    cells = np.ceil((np.int64(2) << band) / load).astype(np.int64) * second
    cell = (((s >> _U32) * cells.astype(np.uint64)[owner]) >> _U32).astype(np.int64)  # sets are sorted, so cells and partitions are runs
    run = np.flatnonzero(np.concatenate(([True], (cell[1:] != cell[:-1]) | (owner[1:] != owner[:-1]))))
    sums = np.add.reduceat(_mix(s ^ np.uint64(0x5DEECE66D)), run)
    of, part, which = owner[run], cell[run] // second, cell[run] % second
    new = np.concatenate(([True], (part[1:] != part[:-1]) | (of[1:] != of[:-1])))
    first = np.flatnonzero(new)
    held = np.diff(np.append(first, len(run)))
    cost = np.minimum(held, LEFT_OUT + 1)
    at = of[first]
    begin = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    before = np.cumsum(cost) - cost
    failed = np.add.reduceat(cost, begin) <= k
    taken = before - before[begin][at] <= k[at]  # every set has a partition, so begin has a place for each

    table = np.zeros((len(first), second), np.uint64)
    table[np.cumsum(new) - 1, which] = sums
    empty = np.ones(table.shape, bool)
    empty[np.cumsum(new) - 1, which] = False
    table, empty, held, at = table[taken], empty[taken], held[taken], at[taken]
    total = table.sum(axis=1)
    label = _mix((np.uint64(level) << np.uint64(56)) + (band[at].astype(np.uint64) << np.uint64(48)) + part[first][taken].astype(np.uint64) + np.uint64(1))
    rank = np.cumsum(empty, axis=1)  # 1 for the first empty place of a row
    sig, of = [], []
    for out in map(list, combinations(range(second), LEFT_OUT)):
        idle = empty[:, out]
        # subsets that differ in empty places only give one projection: the first empty places stand for all
        some = (held - (~idle).sum(axis=1) > 0) & (~idle | (rank[:, out] <= idle.sum(axis=1, keepdims=True))).all(axis=1)
        sig.append(_mix((total - table[:, out].sum(axis=1))[some] + label[some]))
        of.append(at[some])
    return np.concatenate(sig), np.concatenate(of), failed


def signatures_of(s: np.ndarray, ends: np.ndarray, t: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """The signatures of some sets of sorted hashes, one after another between ends, and the bounds between the signatures of each."""
    size = np.diff(ends)
    own = np.frexp(size.astype(float))[1].astype(np.int64) - 1
    largest = 100 * size // t
    sigs, of = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for step in (0, 1):
        band = own + step
        top = (np.int64(2) << np.maximum(band, 0)) - 1  # the largest size of a band
        k = most_missing(size, np.minimum(largest, top), t)
        wanted = (k > 0) & ((step == 0) | (largest > top >> 1))
        for second in (SECOND_SMALL, SECOND):
            sets = np.flatnonzero(wanted & ((band < SMALL_BANDS) == (second == SECOND_SMALL)))
            for level in range(LEVELS):
                if not len(sets):
                    break
                n = size[sets]
                begin = np.cumsum(n) - n
                x = s[np.arange(n.sum()) + np.repeat(ends[sets] - begin, n)]
                if level:
                    x = _mix(x ^ np.uint64(0xE7037ED1A0B428DB + level))
                    x = x[np.lexsort((x, np.repeat(np.arange(len(sets)), n)))]
                sig, at, failed = _enumerated(x, n, band[sets], k[sets], second, level, _load(t))
                sigs.append(sig)
                of.append(sets[at])
                sets = sets[failed]
            sigs.append(_mix(band[sets].astype(np.uint64) + np.uint64(0xA0761D6478BD642F)))
            of.append(sets)
    flat, at = np.concatenate(sigs), np.concatenate(of)
    return flat[np.argsort(at, kind="stable")], np.concatenate(([0], np.cumsum(np.bincount(at, minlength=len(size)))))


def signatures(s: np.ndarray, t: int = THRESHOLD) -> np.ndarray:
    """The signatures of one set of sorted hashes."""
    return signatures_of(s, np.array([0, len(s)]), t)[0]


def _signed(docs: DataFrame, id_col: str, text: str, n_words: int, t: int) -> DataFrame:
    """id, n, digest, sketches (the fine one from FINE_FROM elements on) and signatures of each document; a set that its partition has seen already under an id brings no signatures again, nor do rows without id."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            s, ends = shingle_sets(batch.column(1).to_pylist(), n_words)
            size = np.diff(ends)
            bounds = list(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))
            digests = [xxhash.xxh3_128_digest(s[a:b].data) for a, b in bounds]
            signs = []
            for known, key in zip(batch.column(0).is_valid().to_pylist(), digests, strict=True):
                signs.append(known and key not in seen)
                if len(seen) > 200_000:
                    seen.clear()
                if known:
                    seen.add(key)
            signs = np.array(signs, bool)
            part = np.concatenate(([0], np.cumsum(size[signs])))
            flat, own = signatures_of(s[np.repeat(signs, size)], part, t)
            counts = np.zeros(len(size), np.int64)
            counts[signs] = np.diff(own)
            o = odd_sketches(s, size)
            fine = [odd_sketch(s[a:b], FINE_CELLS) if b - a >= FINE_FROM else None for a, b in bounds]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size.astype(np.int32)), pa.array(digests, pa.binary()), *(pa.array(o[:, i]) for i in range(len(SKETCH))), pa.array(fine, pa.list_(pa.int64())), _lists(flat, counts)],
                names=["id", "n", "digest", *SKETCH, "fine", "sig"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(work, f"id {kind}, n int, digest binary, {', '.join(f'{o} long' for o in SKETCH)}, fine array<long>, sig array<long>")


def _bitmap(ids: DataFrame) -> np.ndarray:
    """Bits for the hashes of some ids, of at most MOST_BITS: an id without its bit isn't among them."""
    n = ids.count()
    bits = min(MOST_BITS, 1 << max(16, (16 * n).bit_length()))
    h = F.xxhash64("id").bitwiseAND(F.lit(bits - 1))
    words = ids.select(F.shiftright(h, 6).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int")).alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    out = np.zeros(bits // 64, np.int64)
    out[words["w"]] = words["b"]
    return out.view(np.uint64)


def _sets(docs: DataFrame, ids: DataFrame, n_words: int) -> DataFrame:
    """id, set, fine, digest: the hashes of each document (id, text) whose id may be among ids, and their sketch of FINE_CELLS.

    What isn't wanted is left out where it is read, so no text is shuffled: up to MOST_SENT ids are
    broadcast, beyond that a bitmap of bounded size; what passes that in vain finds no partner in the
    joins that follow.
    """
    few = ids.count() <= MOST_SENT
    if few:
        docs = docs.join(F.broadcast(ids), "id", "left_semi")
    sent = docs.sparkSession.sparkContext.broadcast(None if few else _bitmap(ids))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = sent.value
        for batch in batches:
            some = batch
            if bitmap is not None:
                h = batch.column(2).to_numpy().astype(np.uint64) % np.uint64(64 * len(bitmap))
                some = batch.filter(pa.array((bitmap[(h >> np.uint64(6)).astype(np.int64)] >> (h & np.uint64(63))) & np.uint64(1) == 1))
            if not len(some):
                continue
            s, ends = shingle_sets(some.column(1).to_pylist(), n_words)
            sets = [s[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            fine = np.concatenate([odd_sketch(x, FINE_CELLS) for x in sets])
            yield pa.RecordBatch.from_arrays(
                [some.column(0), _lists(s, np.diff(ends)), _lists(fine, np.full(len(sets), FINE_CELLS // 64)), pa.array([xxhash.xxh3_128_digest(x.data) for x in sets], pa.binary())],
                names=["id", "set", "fine", "digest"],
            )

    kind = docs.schema["id"].dataType.simpleString()
    # the size of the bitmap divides 2 ** 62, so the lower bits of the hash give the place
    return docs.select("id", "text", F.xxhash64("id").bitwiseAND(F.lit((1 << 62) - 1)).alias("h")).mapInArrow(work, f"id {kind}, set array<long>, fine array<long>, digest binary")


def _distance(a: str, b: str) -> Column:
    """In how many cells two sketches differ: at most the number of elements that the sets differ in."""
    return sum((F.bit_count(F.col(f"{a}.{o}").bitwiseXOR(F.col(f"{b}.{o}"))) for o in SKETCH), F.lit(0))


def _close(a: str, b: str, t: int) -> Column:
    """What two linked sets fulfil: sizes within the threshold, and few parities that differ."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    x, y = F.col(f"{a}.fine"), F.col(f"{b}.fine")
    fits = lambda apart: apart * (100 + t) <= (100 - t) * (n + m)
    coarse = (100 * F.least(n, m) >= t * F.greatest(n, m)) & fits(_distance(a, b))
    return coarse & F.when(x.isNotNull() & y.isNotNull(), fits(_apart(x, y))).otherwise(F.lit(True))


def _apart(x: Column, y: Column) -> Column:
    """In how many cells two fine sketches differ."""
    return F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda acc, d: acc + d)


def _verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, n_words: int, t: int) -> DataFrame:
    """The links among distinct pairs (a, b, …), from the whole sets of the documents in them. The fine sketches go first, so that few sets move."""
    if pairs.isEmpty():
        return pairs
    ends = shared_table(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ends")
    right = nodes.select(F.col("rep").alias("id"), "digest")
    sets = shared_table(_sets(docs, ends, n_words), "sets")
    if sets.count() > ends.count():  # an id with several texts, or a bitmap that let others pass
        sets = sets.join(right, ["id", "digest"], "left_semi").dropDuplicates(["id"])
    told = sets.select("id", "fine", F.size("set").alias("n"))
    near = pairs.join(told.select(F.col("id").alias("b"), F.col("fine").alias("fb"), F.col("n").alias("nb")), "b").join(told.select(F.col("id").alias("a"), F.col("fine").alias("fa"), F.col("n").alias("na")), "a")
    near = shared_table(near.where(_apart(F.col("fa"), F.col("fb")) * (100 + t) <= (100 - t) * (F.col("na") + F.col("nb"))).select(*pairs.columns), "near")
    both = near.join(sets.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b").join(sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a")
    common = F.size(F.array_intersect("sa", "sb"))
    found = shared_table(both.where(100 * common >= t * (F.size("sa") + F.size("sb") - common)).select(*pairs.columns), "links")
    drop(near, ends)
    return found


def _merged(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes with the components that edges (a, b) between their components connect."""
    if edges.isEmpty():
        return nodes
    label = components(edges).select(F.col("id").alias("component"), F.col("component").alias("new"))
    return shared_table(nodes.join(label, "component", "left").withColumn("component", F.coalesce("new", "component")).drop("new"), "nodes")


def _open(buckets: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows of signatures whose classes lie in several components: sig, rep, n, sketch, component, and main, the component of most of them."""
    told = buckets.join(nodes, "rep")
    ends = told.groupBy("sig").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("sig")
    some = shared_table(told.join(ends, "sig"), "open")
    main = some.groupBy("sig", "component").agg(F.count("*").alias("c")).groupBy("sig").agg(F.max(F.struct("c", "component")).alias("m")).select("sig", F.col("m.component").alias("main"))
    out = shared_table(some.join(main, "sig"), "open")
    drop(some)
    return out


def _shared(rows: DataFrame) -> DataFrame:
    """The rows (sig, id) whose signature another row has, and the first and last of each partition, which may be alone.

    Rows are range-partitioned and sorted by sig and id, so a signature of very many rows spreads over
    partitions, and equal signatures are neighbours; a worker compares neighbours as they pass.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, tied = None, True  # the last row waits for the next; tied: it is kept in any case
        for batch in batches:
            if not len(batch):
                continue
            sig = batch.column(0).to_numpy()
            same = np.concatenate(([last is not None and last.column(0)[0].as_py() == sig[0]], sig[1:] == sig[:-1]))
            if last is not None and (tied or same[0]):
                yield last
            keep = same.copy()
            keep[:-1] |= same[1:]
            if last is None:
                keep[0] = True
            if len(sig) > 1:
                yield batch.slice(0, len(sig) - 1).filter(pa.array(keep[:-1]))
            last, tied = batch.slice(len(sig) - 1), bool(keep[-1])
        if last is not None:
            yield last

    kind = rows.schema["id"].dataType.simpleString()
    return rows.repartitionByRange(parts, "sig", "id").sortWithinPartitions("sig", "id").mapInArrow(pick, f"sig long, id {kind}")


def _named(one: DataFrame) -> DataFrame:
    """one (id, n, digest, …) with rep, the smallest id of each set.

    Classes are found by partial sums. Those of one row need no look-up. Those of over HOT rows and a HOT_PARTS-th
    of all, which are at most HOT_PARTS, are broadcast; the other rows meet their class in a join, in which
    no key has more rows than that.
    """
    classes = shared_table(one.groupBy("n", "digest").agg(F.min("id").alias("rep"), F.count("*").alias("c")).where("c > 1"), "classes")
    many = F.col("c") > max(HOT, one.count() // HOT_PARTS)
    told = one.join(F.broadcast(classes.where(many).drop("c")), ["n", "digest"], "left")
    rest = told.where("rep is null").drop("rep").join(classes.where(~many).drop("c"), ["n", "digest"], "left")
    return told.where("rep is not null").unionByName(rest.withColumn("rep", F.coalesce("rep", "id")))


def _carried(rows: DataFrame, names: DataFrame) -> DataFrame:
    """id, sig of rows that bring signatures. An id with several sets may bring those of one that it isn't placed by; they go to the set's class, if there is one."""
    odd = names.where("several").select("id")
    n = odd.count()
    if not n:
        return rows.select("id", "sig")
    odd = F.broadcast(odd) if n <= MOST_SENT else odd
    classes = names.where("id = rep").select("n", "digest", "rep")
    strays = rows.join(odd, "id", "left_semi").join(classes, ["n", "digest"]).select(F.col("rep").alias("id"), "sig")
    return rows.join(odd, "id", "left_anti").select("id", "sig").unionByName(strays)


def _buckets(shared: DataFrame, names: DataFrame) -> DataFrame:
    """sig, rep: the classes of each signature that several share; of signatures shared by the same classes one is kept."""
    rows = shared_table(shared.join(names.select("id", "rep"), "id").select("sig", "rep").distinct(), "rows")
    prints = rows.groupBy("sig").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("x"), F.bit_xor(F.xxhash64("rep", F.lit(2))).alias("y")).where("c > 1")
    one = prints.groupBy("c", "x", "y").agg(F.min("sig").alias("sig")).select("sig")
    out = shared_table(rows.join(one, "sig", "left_semi"), "buckets")
    drop(rows)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", n_words: int = N_WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles long, component_id of each row: the smallest id reachable by links of at least threshold percent.

    ids are whole numbers. A null or blank text has no shingles and links with nothing; rows without
    id are components of their own (null). Rows that repeat an id with other texts are all placed by
    the text with the smallest set (and, of those, the smallest digest). Other columns are left out; an empty table gives an empty result.
    """
    need(docs, id_col, text)
    arrow_limits(docs.sparkSession)
    t = threshold
    docs = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    signed = shared_table(_signed(docs, "id", "text", n_words, t), "signed")
    filled = signed.where((F.col("n") > 0) & F.col("id").isNotNull())
    # rows with the smallest id of a set go by that id from here on
    one = filled.groupBy("id").agg(F.min(F.struct("n", "digest", *SKETCH, "fine")).alias("x"), (F.min("digest") < F.max("digest")).alias("several")).select("id", "several", "x.*")
    names = shared_table(_named(shared_table(one, "one")), "names")
    sizes = shared_table(signed.select("id", "n"), "sizes")
    lone = _carried(filled.where(F.size("sig") > 0), names).select("id", F.explode("sig").alias("sig"))
    shared = shared_table(_shared(lone.select("sig", "id")), "shared")
    drop(signed)
    buckets = _buckets(shared, names)
    drop(shared)
    reps = buckets.select("rep").distinct()
    nodes = shared_table(names.where("id = rep").select("rep", "n", "digest", *SKETCH, "fine").join(reps, "rep", "left_semi").withColumn("component", F.col("rep")), "nodes")
    docs = docs.where("id is not null")

    # round one: each class with the closest of the classes that come first in its signatures
    told = nodes.select("rep", F.struct("rep", "n", *SKETCH, "fine").alias("s"))
    first = buckets.groupBy("sig").agg(F.min("rep").alias("first")).join(told.select(F.col("rep").alias("first"), F.col("s").alias("q")), "first")
    star = buckets.join(first, "sig").where("rep > first").join(told.select("rep", F.col("s").alias("p")), "rep").where(_close("p", "q", t))
    star = star.groupBy(F.col("p.rep").alias("b")).agg(F.min(F.struct(_distance("p", "q").alias("d"), F.col("q.rep").alias("rep"))).alias("x")).select(F.col("x.rep").alias("a"), "b")
    nodes = _merged(nodes, _verified(shared_table(star, "pairs"), docs, nodes, n_words, t))
    open_ = _open(buckets, nodes)

    # round two: for each two components that meet in a signature, the closest pair of their firsts there
    one = open_.groupBy("sig", "component", "main").agg(F.min(F.struct("rep", "n", *SKETCH, "fine")).alias("s"))
    heads = one.where("component = main").select("sig", F.col("component").alias("x"), F.col("s").alias("q"))
    near = one.where("component <> main").select("sig", F.col("component").alias("y"), F.col("s").alias("p")).join(heads, "sig").where(_close("p", "q", t))
    near = near.groupBy("x", "y").agg(F.min(F.struct(_distance("p", "q").alias("d"), F.col("p.rep").alias("a"), F.col("q.rep").alias("b"))).alias("z")).select("z.a", "z.b", "x", "y")
    nodes = _merged(nodes, _verified(shared_table(near, "pairs"), docs, nodes, n_words, t).select(F.col("x").alias("a"), F.col("y").alias("b")))
    more = _open(open_.select("sig", "rep"), nodes)
    drop(open_, buckets)

    # round three: whatever is left. Of two classes outside the main component the smaller id is looked at from the larger
    apart = (F.col("p.sig") == F.col("q.sig")) & (F.col("p.component") != F.col("q.component")) & ((F.col("q.component") == F.col("q.main")) | (F.col("p.rep") > F.col("q.rep")))
    cross = more.where("component <> main").alias("p").join(more.alias("q"), apart & _close("p", "q", t))
    cross = cross.select(F.col("p.rep").alias("a"), F.col("q.rep").alias("b"), F.col("p.component").alias("x"), F.col("q.component").alias("y")).distinct()
    links = _verified(shared_table(cross, "pairs"), docs, nodes, n_words, t).select(F.col("x").alias("a"), F.col("y").alias("b"))
    nodes = _merged(nodes, links)
    drop(more)

    final = names.select("id", "rep").join(nodes.select("rep", "component"), "rep", "left").select("id", F.coalesce("component", "rep").alias("component"))
    # a class's smallest id is in the class, and a component's smallest class holds the component's smallest id
    return sizes.join(final, "id", "left").select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def keep_one(docs: DataFrame, n_words: int = N_WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest doc_id. All columns stay.

    Documents without words stay. Of rows that repeat a doc_id one row stays, but for rows without doc_id, which all stay.
    """
    found = near_duplicates(docs, "doc_id", "text", n_words, threshold).where("doc_id is not null")
    key, component, one = fresh(docs, "key", "component", "one")
    told = found.groupBy(F.col("doc_id").alias(key)).agg(F.min("component_id").alias(component))
    # texts are shuffled once: the window has the join's partitioning
    first = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"))
    kept = docs.where("doc_id is not null").join(told, F.col("doc_id") == F.col(key)).where(F.col("doc_id") == F.col(component))
    kept = kept.withColumn(one, F.row_number().over(first)).where(F.col(one) == 1).select(*docs.columns)
    return kept.unionByName(docs.where("doc_id is null"))
