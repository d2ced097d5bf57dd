"""SimHash near-duplicates by an index of fingerprint bytes with count filtering.

A fingerprint of 64 bits is 8 bytes, each with its position. Two fingerprints that differ in at most
3 bits share at least 5 positional bytes; of 5 out of 8, at least 3 lie in the first or in the second
half. So the inverted index is keyed by three positional bytes of one half (8 keys a fingerprint,
24 bits each), which keeps its lists short where single bytes would list 1/256 of all fingerprints.
For pairs that meet in a list the shared positional bytes are tallied, in long lists from postings of
single positional bytes: those that share fewer than 5 go, the rest is verified bit by bit. Equal
fingerprints are one class throughout and never paired.

A list's pairs aren't emitted: within a list, members are linked breadth first, each taken once, and
only those links leave. The members of a list longer than LONG go on to lists of 5 positional bytes
(10 each, as 2 more of the other 5 must be shared), and where these are longer than LONG, to lists of
a quarter of the remaining 24 bits (4 each, as one quarter must be the same). Such a list has at most
2^18 members, however large the table, and the rows of the index grow as the fingerprints do.
Components come from alternating large-star and small-star steps, each written to the shared folder;
rows of keys that very many rows share are joined by broadcast.

The pipeline's stage links texts by five-word shingles with a Jaccard similarity of 0.8 or more
(`near_copies`). Fingerprints of these go through the same index, and what it links is verified by the
shingles. As texts so similar can differ in more than 3 bits, lists of rare shingles give the rest, so
that no such pair is missed.

Defined results: null and empty texts have fingerprint zero, linked like any other. A null doc_id
links but is nobody's component; component_id is null where no id is reachable. Repeated rows get
one result each. Extra columns are left out.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm import common

SHINGLE, BITS, SEED = 3, 3, 42
#: Members of a list beyond which it is split, and beyond which its tallies come from postings.
LONG, DENSE = 2048, 256
#: The pipeline's stage: words of a shingle, least Jaccard similarity.
WORDS, SIMILARITY = 5, "0.8"
#: Lists up to SHORT give all pairs at once. One text in SAMPLED tells which hashes OFTEN texts or more have, of which the MOST frequent are kept.
SHORT, SAMPLED, OFTEN, MOST = 4, 10, 50, 500_000
#: Members of a list that meet in one task; longer lists are cut into blocks of about so many.
BLOCK = 4096
#: Links of the pipeline's stage that are joined in one task; star steps take a dozen plans, which fill the driver's memory.
FEW_LINKS = 100_000
#: Bits of a set's parities, in 64-bit words.
PARITY_WORDS = 16
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_TRIPLES = [(h + a, h + b, h + c) for h in (0, 4) for a, b, c in ((0, 1, 2), (0, 1, 3), (0, 2, 3), (1, 2, 3))]
#: Ids of classes that have no doc_id start here.
_NAMELESS = 1 << 62


def _hashes(text: str | None, shingle: int) -> Iterator[np.ndarray]:
    """Hashes of the text's shingles in pieces, so that memory stays small for long texts; a text of fewer words is one shingle."""
    import xxhash

    w = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    if not w:
        return
    line = b" ".join(w)
    n = max(1, len(w) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, w), dtype=np.int64, count=len(w)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    stops = ends[min(shingle, len(w)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    for i in range(0, n, 65536):
        yield np.array([digest(line[a:b], SEED) for a, b in zip(starts[i : i + 65536], stops[i : i + 65536])], dtype="<u8")


def simhash(pieces: Iterable[np.ndarray]) -> int:
    """A bit is 1 if set in over half the hashes."""
    total, n = np.zeros(64, np.int64), 0
    for h in pieces:
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    return int.from_bytes(np.packbits(2 * total > n, bitorder="little").tobytes(), "little")


def fingerprint(text: str | None) -> int:
    """SimHash of the text's shingles."""
    return simhash(_hashes(text, SHINGLE))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    common.make_room()
    for b in batches:
        found = np.array([fingerprint(t) for t in b.column("text").to_pylist()], dtype="<u8").view("<i8")
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found)], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    common.bound_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_fingerprints, "doc_id long, fp long")


def linked(fps: np.ndarray, ids: np.ndarray) -> list[tuple[int, int]]:
    """Links (smaller id first) that connect all members within BITS bits of each other, each member reached once."""
    if len(fps) > DENSE:
        varies = np.bitwise_or.reduce(fps ^ fps[0])
        return _linked_in_cube(fps, ids, int(varies)) if len(fps) > LONG and int(varies).bit_count() <= 18 else _linked_by_postings(fps, ids)
    out, left = [], np.arange(len(fps))
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            x = front.pop()
            differ = fps[left] ^ fps[x]
            same_bytes = (differ.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
            near = same_bytes >= 8 - BITS
            near[near] = np.bitwise_count(differ[near]) <= BITS
            for y in left[near]:
                a, b = int(ids[x]), int(ids[y])
                if a != b:
                    out.append((min(a, b), max(a, b)))
                front.append(y)
            left = left[~near]
    return out


def _linked_by_postings(fps: np.ndarray, ids: np.ndarray) -> list[tuple[int, int]]:
    """As linked: a member's candidates are tallied from the postings of its 8 positional bytes."""
    at = fps.view(np.uint8).reshape(-1, 8)
    orders = [np.argsort(at[:, p], kind="stable") for p in range(8)]
    starts = [np.searchsorted(at[o, p], np.arange(257)) for p, o in enumerate(orders)]
    alike = [p for p in range(8) if (at[:, p] == at[0, p]).all()]
    out, taken = [], np.zeros(len(fps), bool)
    for seed in range(len(fps)):
        if taken[seed]:
            continue
        taken[seed] = True
        front = [seed]
        while front:
            x = front.pop()
            tally = np.full(len(fps), len(alike), np.int8)
            for p in range(8):
                if p not in alike:
                    tally[orders[p][starts[p][at[x, p]] : starts[p][int(at[x, p]) + 1]]] += 1
            near = np.flatnonzero((tally >= 8 - BITS) & ~taken)
            near = near[np.bitwise_count(fps[near] ^ fps[x]) <= BITS]
            taken[near] = True
            out += [(min(int(ids[x]), i), max(int(ids[x]), i)) for i in ids[near].tolist() if i != ids[x]]
            front += near.tolist()
    return out


def _linked_in_cube(fps: np.ndarray, ids: np.ndarray, varies: int) -> list[tuple[int, int]]:
    """As linked, of fingerprints that vary in few bits: neighbours are looked up in a table of all values of these."""
    bits = [b for b in range(64) if varies >> b & 1]
    code = np.zeros(len(fps), np.int64)
    for i, b in enumerate(bits):
        code |= ((fps >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << i
    table = np.full(1 << len(bits), -1, np.int64)
    table[code] = np.arange(len(fps))
    masks = np.array([sum(1 << i for i in c) for k in range(1, BITS + 1) for c in itertools.combinations(range(len(bits)), k)], dtype=np.int64)
    out, taken = [], np.zeros(len(fps), bool)
    for seed in range(len(fps)):
        if taken[seed]:
            continue
        taken[seed] = True
        front = np.array([seed])
        while len(front):
            x, front = front[:1024], front[1024:]
            met = table[code[x, None] ^ masks]
            i, j = np.nonzero(met >= 0)
            y = met[i, j]
            fresh = ~taken[y]
            y, first = np.unique(y[fresh], return_index=True)
            taken[y] = True
            out += [(min(a, b), max(a, b)) for a, b in zip(ids[x[i[fresh][first]]].tolist(), ids[y].tolist()) if a != b]
            front = np.concatenate([front, y])
    return out


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within each list of rows (key, fp, id) sorted by key; lists of one are skipped in bulk."""

    def of(lists) -> pa.RecordBatch:
        found = sorted({e for fps, ids in lists for e in linked(fps, ids)})
        return pa.RecordBatch.from_arrays([pa.array([e[0] for e in found], pa.int64()), pa.array([e[1] for e in found], pa.int64())], names=["a", "b"])

    rest: tuple[np.ndarray, ...] | None = None
    for b in batches:
        key, fp, ids = (b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "fp", "id"))
        if rest is not None:
            key, fp, ids = (np.concatenate(p) for p in zip(rest, (key, fp, ids)))
        cut = np.flatnonzero(key[1:] != key[:-1]) + 1
        if not len(cut):
            rest = (key, fp, ids)
            continue
        begin = np.concatenate([[0], cut[:-1]])
        many = np.flatnonzero(cut - begin > 1)
        rest = (key[cut[-1] :], fp[cut[-1] :], ids[cut[-1] :])
        if len(many):
            yield of((fp[s:e].view("<u8"), ids[s:e]) for s, e in zip(begin[many].tolist(), cut[many].tolist()))
    if rest is not None and len(rest[0]) > 1:
        yield of([(np.ascontiguousarray(rest[1]).view("<u8"), rest[2])])


def links(classes: DataFrame, long: int = LONG) -> DataFrame:
    """Links (a, b) between ids of classes(fp, id); within each component they connect all members."""
    byte = lambda i: F.shiftrightunsigned("fp", 8 * i).bitwiseAND(F.lit(255).cast("long"))
    part = lambda i: F.shiftrightunsigned("rest", 6 * i).bitwiseAND(F.lit(63).cast("long"))
    keys = F.array(*((F.lit(t << 24) + byte(x) * 65536 + byte(y) * 256 + byte(z)) for t, (x, y, z) in enumerate(_TRIPLES)))
    by_list = lambda df: df.select("key", "fp", "id").repartition("key").sortWithinPartitions("key").mapInArrow(_links, "a long, b long")

    def cut(index: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """The rows of lists up to `long`, and those of longer ones, if there are any."""
        hot = common.written(index.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > long).select("key"), "lists")
        if hot.isEmpty():
            return index, None
        # a list has over `long` of the index's rows, so that these keys are few beside them
        return index.join(hot, "key", "left_anti"), index.join(hot, "key", "left_semi")

    usual, hot = cut(classes.select(F.posexplode(keys).alias("t", "key"), "fp", "id"))
    out = by_list(usual)
    if hot is None:
        return out
    more = []
    for t, triple in enumerate(_TRIPLES):
        others = [i for i in range(8) if i not in triple]
        for n, (x, y) in enumerate(itertools.combinations(others, 2)):
            rest = [i for i in others if i not in (x, y)]
            more.append((F.col("t") == t, F.struct((F.lit(n << 16) + byte(x) * 256 + byte(y)).alias("two"), sum((byte(i) * (1 << 8 * k) for k, i in enumerate(rest)), F.lit(0).cast("long")).alias("rest"))))
    of = F.when(F.lit(False), F.array(more[0][1]))
    for t in range(len(_TRIPLES)):
        of = of.when(F.col("t") == t, F.array(*(c for k, (_, c) in enumerate(more) if k // 10 == t)))
    five = hot.select("key", "fp", "id", F.explode(of).alias("m")).select(F.xxhash64("key", "m.two").alias("key"), "fp", "id", "m.rest")
    usual, hot = cut(five)
    out = out.unionByName(by_list(usual))
    if hot is None:
        return out
    quarter = hot.select("key", "fp", "id", F.explode(F.array(*(F.lit(i << 6) + part(i) for i in range(4)))).alias("q"))
    return out.unionByName(by_list(quarter.select(F.xxhash64("key", "q").alias("key"), "fp", "id")))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, root) of links (a, b) that are all in one task."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    for batch in batches:
        for a, b in zip(*(c.to_pylist() for c in batch.columns)):
            low, high = sorted((find(a), find(b)))
            root[high] = low
    ids = np.array([x for x in root if root[x] != x], np.int64)
    yield _batch("id root", ids, np.array([find(x) for x in ids.tolist()], np.int64))


def components(edges: DataFrame, rounds: int = 60, few: int = 0) -> DataFrame:
    """(id, root): each linked id with the smallest id of its component. Up to `few` links are joined in one task, more by star steps."""
    common.trim_driver(edges.sparkSession)
    edges = common.written(edges.filter("a <> b").distinct(), "edges")
    before, size = None, edges.count()
    if size <= few:
        return common.written(edges.select("a", "b").coalesce(1).mapInArrow(_joined, "id long, root long"), "roots")

    def star(many: DataFrame, one: DataFrame, key: str) -> DataFrame:
        if size <= common.HOT_ROWS:  # no centre can have more
            return many.join(one.drop("n"), key)
        return common.spread_join(many, common.written(one, "centres"), key)

    for _ in range(rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = star(both, low, "a").filter("b > a").select(F.col("m").alias("a"), "b").filter("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
        least = down.groupBy("hi").agg(F.min("lo").alias("m"), F.count(F.lit(1)).alias("n"))
        small = star(down, least, "hi").select(F.explode(F.array(F.struct("m", F.col("lo").alias("v")), F.struct("m", F.col("hi").alias("v")))).alias("e")).select(F.col("e.m").alias("a"), F.col("e.v").alias("b")).filter("a <> b").distinct()
        edges = common.written(small, "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components didn't settle in {rounds} rounds")
    return edges.select(F.col("b").alias("id"), F.col("a").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp and component_id of every row."""
    fps = common.written(fingerprints(docs), "fingerprints")
    nameless = F.lit(_NAMELESS) + F.col("fp").bitwiseAND(F.lit(_NAMELESS - 1))
    classes = common.written(fps.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).select("fp", F.coalesce("first", nameless).alias("id"), "n"), "classes")
    roots = components(links(classes.drop("n")))
    of = classes.join(roots, "id", "left").select("fp", F.coalesce("root", "id").alias("component_id"), "n")
    named = F.when(F.col("component_id") < _NAMELESS, F.col("component_id"))
    return common.spread_join(fps, of, "fp").select("doc_id", "fp", named.alias("component_id"))


def op8(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# Near copies by shingle sets, for the pipeline --------------------------------------------------------


def shingles(text: str | None, shingle: int = WORDS) -> np.ndarray:
    """The sorted set of the hashes of the text's shingles."""
    return np.unique(np.concatenate([np.zeros(0, "<u8"), *_hashes(text, shingle)]))


def _among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of x are in the sorted array known; proportional to x."""
    if not len(known):
        return np.zeros(len(x), bool)
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def similar(x: np.ndarray, y: np.ndarray, least: Fraction) -> bool:
    """Whether the Jaccard similarity of two sets is at least that; of two empty ones it is 1."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= least * (len(x) + len(y) - both)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of rows sorted by the first one, cut where it changes; parities as an array of two dimensions."""
    rest: list[np.ndarray] | None = None
    for b in batches:
        columns = [c.flatten().to_numpy().view("<u8").reshape(-1, PARITY_WORDS) if pa.types.is_list(c.type) else c.to_numpy(zero_copy_only=False) for c in b.columns]
        if rest is not None:
            columns = [np.concatenate(p) for p in zip(rest, columns)]
        cut = np.flatnonzero(columns[0][1:] != columns[0][:-1]) + 1
        rest = [c[cut[-1] :] for c in columns] if len(cut) else columns
        if len(cut):
            yield [c[: cut[-1]] for c in columns]
    if rest is not None and len(rest[0]):
        yield rest


def _batch(names: str, *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names.split())


def _may(n: np.ndarray, at: np.ndarray, i, j, least: Fraction) -> np.ndarray:
    """Whether members i and j of a list can be similar, by their sizes and the places of the shared hash in them."""
    t, s = least.numerator, least.denominator
    most = np.minimum(at[i], at[j]) + np.minimum(n[i] - at[i], n[j] - at[j])
    return (s * np.minimum(n[i], n[j]) >= t * np.maximum(n[i], n[j])) & ((s + t) * most >= t * (n[i] + n[j]))


def _lists(block: int):
    """Of rows (key, id, at) sorted by key and id, those whose key has others, in blocks: key, id, n, at, m, block, copy.

    `at` holds the size of the member's set in its upper 32 bits and the key's place in it in the lower ones. m is the length
    of a list of up to `block` members; longer ones are cut into blocks, have m = block + 1, and their first member again, as a
    copy, in all of the blocks. No more than a block is held at once.
    """

    def out(key, id_, at, m, number=0, copy=0) -> pa.RecordBatch:
        full = lambda x: np.full(len(key), x, np.int64) if np.isscalar(x) else x
        return _batch("key id n at m block copy", key, id_, at >> 32, at & 0xFFFFFFFF, full(m), full(number), full(copy))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.zeros(0, np.int64) for _ in range(3)]  # rows of the last key
        number, head = 0, None  # the block that comes next, if the last key has had some, and its first member

        def cut(rows, first) -> Iterator[pa.RecordBatch]:
            """rows of a long list as blocks, the next of which is the first-th."""
            for n, f in enumerate(range(0, len(rows[0]), block), first):
                yield out(*(x[f : f + block] for x in rows), block + 1, n)
                if n:
                    yield out(*head, block + 1, n, 1)

        for b in batches:
            key, id_, at = (np.concatenate(p) for p in zip(rest, (c.to_numpy(zero_copy_only=False) for c in b.columns)))
            begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            ends = np.append(begin[1:], len(key))
            if number and len(begin) > 1:  # the rest of a long list
                yield from cut([x[: ends[0]] for x in (key, id_, at)], number)
                number, head, begin, ends = 0, None, begin[1:], ends[1:]
            whole = slice(0, max(0, len(begin) - 1))
            size = ends[whole] - begin[whole]
            member = np.repeat((size > 1) & (size <= block), size)
            if member.any():
                low, high = begin[0], ends[whole][-1]
                yield out(*(x[low:high][member] for x in (key, id_, at)), np.repeat(size, size)[member])
            for s, e in zip(begin[whole][size > block].tolist(), ends[whole][size > block].tolist()):
                head = [x[s : s + 1] for x in (key, id_, at)]
                yield from cut([x[s:e] for x in (key, id_, at)], 0)
                head = None
            last = begin[-1] if len(begin) else 0
            rest = [x[last:] for x in (key, id_, at)]
            if full_blocks := (len(rest[0]) - 1) // block if len(rest[0]) else 0:
                head = head or [x[:1] for x in rest]
                yield from cut([x[: full_blocks * block] for x in rest], number)
                rest, number = [x[full_blocks * block :] for x in rest], number + full_blocks
        if number:
            yield from cut(rest, number)
        elif len(rest[0]) > 1:
            yield out(*rest, len(rest[0]))

    return run


def _first_pairs(least: Fraction):
    """All pairs of each list of at most SHORT; of longer ones each member with the first and the next, by id, so that lists of the same members give the same pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, id_, n, at in _whole(batches):
            begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.concatenate([begin, [len(key)]]))
            i, j = [], []
            for m in np.unique(size[size <= SHORT]).tolist():
                x, y = np.triu_indices(m, 1)
                i.append((begin[size == m, None] + x).ravel())
                j.append((begin[size == m, None] + y).ravel())
            for s, m in zip(begin[size > SHORT].tolist(), size[size > SHORT].tolist()):
                order = np.arange(s, s + m)
                i += [order[:-1], np.repeat(order[:1], m - 1)]
                j += [order[1:], order[1:]]
            i, j = np.concatenate(i), np.concatenate(j)
            good = _may(n, at, i, j, least) & (id_[i] != id_[j])
            a, b = id_[i[good]], id_[j[good]]
            yield _batch("a b", np.minimum(a, b), np.maximum(a, b))

    return run


def _other_pairs(least: Fraction, forest: bool):
    """Of lists with rows (key, id, n, at, root, asks, odd): pairs that can be similar, of members that ask and any others that no link has joined to them yet.

    A guest, which asks in a block that isn't its own (asks = 2), meets the block's members only. forest: as if each pair given
    were a link; so a list gives fewer pairs than it has roots, an asking member's closest ones first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, *columns in _whole(batches):
            found = [np.zeros((2, 0), np.int64)]
            for part in np.split(np.arange(len(key)), np.flatnonzero(key[1:] != key[:-1]) + 1):
                part = part[np.argsort(-columns[4][part], kind="stable")]
                id_, n, at, root, asks, odd = (c[part] for c in columns)
                guests, root = int((asks > 1).sum()), root.copy()
                for i in range(int((asks > 0).sum())):
                    j = np.arange(max(i + 1, guests), len(part))
                    j = j[root[j] != root[i]]
                    j = j[_may(n, at, i, j, least)]
                    differ = np.bitwise_count(odd[j] ^ odd[i]).sum(axis=1, dtype=np.int64)
                    near = _near(differ, n[i] + n[j], least)
                    j, differ = j[near], differ[near]
                    if forest:
                        j, links = j[np.argsort(differ / (n[i] + n[j]), kind="stable")], []
                        while len(j):
                            links.append(j[0])
                            root[root == root[j[0]]] = root[i]
                            j = j[root[j] != root[i]]
                        j = np.array(links, np.int64)
                    if len(j):
                        found.append(np.array([np.minimum(id_[i], id_[j]), np.maximum(id_[i], id_[j])]))
            yield _batch("a b", *np.unique(np.concatenate(found, axis=1), axis=1))

    return run


def _near(differ, total, least: Fraction):
    """Whether sets of `total` elements together, whose parities differ in that many places, can be similar.

    Similar sets of n and m elements differ in at most (1 - s) / (1 + s) (n + m) of them, and in no more parities than elements.
    """
    t, s = least.numerator, least.denominator
    return differ * (s + t) <= total * (s - t)


def parities(s: np.ndarray) -> np.ndarray:
    """For each residue of hashes modulo the number of bits, whether the set has an odd number of them."""
    odd = np.bincount((s % np.uint64(64 * PARITY_WORDS)).astype(np.int64), minlength=64 * PARITY_WORDS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _alike(pairs: DataFrame, marks: DataFrame, least: Fraction) -> DataFrame:
    """Those of pairs (a, b) whose parities in marks(id, n, odd) let their sets be similar; the others go before any text is fetched."""
    mark = lambda k: marks.select(F.col("id").alias(k), F.col("n").alias(f"n_{k}"), F.col("odd").alias(f"odd_{k}"))
    differ = F.aggregate(F.zip_with("odd_a", "odd_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    near = _near(differ, F.col("n_a") + F.col("n_b"), least)
    return common.written(pairs.distinct().join(mark("a"), "a").join(mark("b"), "b").filter(near).select("a", "b"), "pairs")


def _verified(pairs: DataFrame, rows: DataFrame, shingle: int, least: Fraction) -> DataFrame:
    """Those of the written pairs (a, b) whose texts in rows(id, text) are similar."""
    ids = common.written(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "ids")
    texts = common.only(rows, ids, "id")
    of = lambda k: texts.select(F.col("id").alias(k), F.col("text").alias(f"text_{k}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.make_room()
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            good = []
            for at, (a, b) in enumerate(zip(*(c.to_pylist() for c in batch.columns[:2]))):
                if a not in known:  # the pairs of one text often follow each other
                    known = {a: shingles(batch.column(2)[at].as_py(), shingle)}
                good.append(similar(known[a], shingles(batch.column(3)[at].as_py(), shingle), least))
            good = np.array(good, dtype=bool)
            yield _batch("a b", *(batch.column(c).to_numpy()[good] for c in ("a", "b")))

    met = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "text_a", "text_b")
    return met.mapInArrow(run, "a long, b long")


def frequent(rows: DataFrame, shingle: int) -> np.ndarray:
    """Hashes that many texts have, by a sample; sorted. Their choice bears on the time only, not on the pairs found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.make_room()
        for b in batches:
            yield _batch("key", np.concatenate([np.zeros(0, "<u8"), *(shingles(t, shingle) for t in b.column("text").to_pylist())]).view("<i8"))

    sample = rows.filter(F.pmod(F.xxhash64("id", F.lit(2)), F.lit(SAMPLED)) == 0).select("text").mapInArrow(run, "key long")
    counts = sample.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") * SAMPLED >= OFTEN)
    keys = counts.orderBy(F.desc("n"), "key").limit(MOST).select("key").toArrow().column("key").to_numpy()
    return np.sort(keys.view("<u8"))


def fingerprint_pairs(texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of texts(id, fp) that the index of fingerprint bytes links; texts with the same fingerprint are paired with the first of them."""
    same = common.written(texts.groupBy("fp").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")), "fingerprints")
    equal = common.spread_join(texts, same.filter("n > 1"), "fp").filter("first <> id").select(F.col("first").alias("a"), F.col("id").alias("b"))
    return equal.union(links(same.select("fp", F.col("first").alias("id"))))


def near_copies(rows: DataFrame, shingle: int = WORDS, similarity: str = SIMILARITY) -> DataFrame:
    """id and component (its least id) of each row of rows(id, text); ids are distinct.

    Texts are linked where the Jaccard similarity of their sets of shingles is at least that. Texts
    with the same set are one class. Pairs are those that the fingerprints' index links, then those that
    differ in more bits: of two similar sets, each in one order of all hashes, the first
    n - ceil(similarity n) + 1 have a hash in common, so that the lists of those hashes, rare ones first,
    have all pairs. Each is verified, by the parities of the sets first (see _near), then by the texts.
    Long lists give only as many pairs as members at first; of the rest of their pairs those count that
    the links so found haven't joined: members outside a list's largest component are held against all,
    by parities where the list is. Of what these leave, each list gives a forest, fewer pairs than it has
    components; once its links are known, all pairs go on that still lie between two components. Lists
    longer than BLOCK meet block by block.
    """
    spark, least, since = rows.sparkSession, Fraction(similarity), common.given()
    common.bound_batches(spark)
    with common.tidy(spark):
        often = spark.sparkContext.broadcast(frequent(rows, shingle))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        common.make_room()
        for b in batches:
            sets = [shingles(t, shingle) for t in b.column("text").to_pylist()]
            first = []
            for s in sets:
                rare = ~_among(s, often.value)
                first.append(np.concatenate([s[rare], s[~rare]])[: len(s) - math.ceil(least * len(s)) + 1].view("<i8"))
            ends = np.cumsum([0, *map(len, first)])
            keys = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, "<i8"), *first])))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(np.array([simhash(s[i : i + 65536] for i in range(0, len(s), 65536)) for s in sets], dtype="<u8").view("<i8")), pa.array([parities(s) for s in sets], pa.list_(pa.int64())), keys], names=["id", "same", "n", "fp", "odd", "keys"])

    sets = common.written(rows.select("id", "text").mapInArrow(run, "id long, same binary, n long, fp long, odd array<long>, keys array<long>"), "sets")
    common.trim_driver(spark)
    marks = sets.select("id", "n", "odd")
    classes = common.written(sets.groupBy("same").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"), F.min("fp").alias("fp")), "classes")
    near = common.written(_verified(_alike(fingerprint_pairs(classes.select("id", "fp")), marks, least), rows, shingle, least), "near")
    at = F.shiftleft(F.col("n"), 32) + F.col("at")
    index = sets.join(classes.select("id"), "id", "left_semi").select("id", "n", F.posexplode("keys").alias("at", "key")).select("key", "id", at.alias("at"))
    by_key = lambda df: df.repartition("key").sortWithinPartitions("key", "id")
    lists = common.written(by_key(index).mapInArrow(_lists(BLOCK), "key long, id long, n long, at long, m long, block long, copy long"), "lists")
    in_blocks = lists.select(F.when(F.col("m") > BLOCK, F.xxhash64("key", "block")).otherwise(F.col("key")).alias("key"), "id", "n", "at")
    found = by_key(in_blocks).mapInArrow(_first_pairs(least), "a long, b long").join(near, ["a", "b"], "left_anti")
    roots = components(_verified(_alike(found, marks, least), rows, shingle, least).union(near), few=FEW_LINKS)
    long_lists = lists.filter((F.col("m") > SHORT) & (F.col("copy") == 0))
    blocks = common.written(lists.filter(F.col("m") > BLOCK).groupBy("key").agg((F.max("block") + 1).alias("blocks"), F.count(F.lit(1)).alias("of")), "blocks")
    tested = None
    for forest in (True, False) if not long_lists.isEmpty() else ():
        known = common.written(long_lists.join(roots, "id", "left").select("key", "id", "n", "at", "m", "block", F.coalesce("root", "id").alias("root")), "known")
        # lists that are one component by now are done; of others the members of the largest one have nothing to ask
        largest = known.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c")).groupBy("key").agg(F.max_by("root", F.struct("c", "root")).alias("largest"), F.sum("c").alias("of"), F.count(F.lit(1)).alias("roots")).filter("roots > 1").drop("roots")
        asked = common.spread_join(known, common.written(largest, "largest"), "key", "of").withColumn("asks", (F.col("root") != F.col("largest")).cast("long"))
        asked = asked.join(marks.select("id", "odd"), "id")
        row = ("id", "n", "at", "root")
        short = asked.filter(F.col("m") <= BLOCK).select("key", *row, "asks", "odd")
        cut = asked.filter(F.col("m") > BLOCK)
        home = cut.select(F.xxhash64("key", "block").alias("key"), *row, F.lit(0).cast("long").alias("asks"), "odd")
        guests = common.spread_join(cut.filter("asks = 1"), blocks, "key", "of").withColumn("to", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select(F.xxhash64("key", "to").alias("key"), *row, F.lit(2).cast("long").alias("asks"), "odd")
        pairs = by_key(short.union(home).union(guests)).mapInArrow(_other_pairs(least, forest), "a long, b long").distinct()
        pairs = common.written(pairs.join(tested, ["a", "b"], "left_anti") if tested else pairs, "pairs")
        more = common.written(_verified(pairs, rows, shingle, least), "more")
        n = more.count()
        if n:
            roots = components(roots.select(F.col("root").alias("a"), F.col("id").alias("b")).union(more), few=FEW_LINKS)
        if n == pairs.count():  # all are links, as the forests took them to be: no list has any others
            break
        tested = pairs
    of = classes.join(roots, "id", "left").select("same", F.coalesce("root", "id").alias("component"), "n")
    out, path = common.written_at(common.spread_join(sets.select("id", "same"), of, "same").select("id", "component"), "near-copies")
    common.clear(spark, since, keep=(path,))
    return out


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies, that with the smallest doc_id; one without an id only where all are.

    Rows are numbered and dropped by number: what shares a doc_id with a copy, or has none, is judged by its own text.
    """
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row_"))
    since = common.given()
    rows, whole = common.written_at(rows.withColumn("id", F.monotonically_increasing_id()), "rows")
    text, doc_id = F.col("row_")["text"], F.col("row_")["doc_id"].cast("long")
    found = near_copies(rows.select("id", text.alias("text"))).join(rows.select("id", doc_id.alias("doc_id"), F.xxhash64(text).alias("hash")), "id")
    order = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "hash", "id")
    found = common.written(found.select("component", order.alias("o")), "components")
    groups = found.groupBy("component").agg(F.min("o").alias("kept"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    drop, path = common.written_at(common.spread_join(found, common.written(groups, "groups"), "component").filter("o <> kept").select("o.id"), "copies")
    common.clear(spark, since, keep=(whole, path))
    return common.unpacked(common.only(rows, drop, "id", "left_anti"), docs.columns)
