"""Benchmark decontamination by a distributed positional inverted index.

Training documents are dealt to shards (pieces of Arrow batches). A shard stores its vocabulary, and
for every word of it the sorted positions where it stands, as one row of a table in the shared
folder (`index`). A test window is looked up by intersecting its terms' lists, each moved back by the
term's offset, from the shard's rarest term on; what is left are exact phrase matches. `proximity`
gives the shortest runs of words that hold all of an item's terms, from the same lists. Postings
never leave their shard's row, so nothing is shuffled, and no term or passage, however common, meets
in one task. The table outlives lost executors, and other benchmarks can be looked up in it.

The test items are sent to all executors in blocks of at most BLOCK_BYTES of text. Each block is one
pass over the stored postings, a job of its own whose hits are written; texts are read and cut into
words once. A lookup's candidates are expanded in pieces of at most EXPAND places.

Defined results: null and empty texts have no words, no hits, and the digest of an empty list. Items
with null ids or without words match nothing; equal ids count once. Repeated rows get one result
each, ties are all reported. A text longer than SHARD_BYTES is a shard of its own, whole. An empty
benchmark leaves everything clean, an empty table gives no rows. Extra columns are left out.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm import common

WINDOW = 10
#: Text of the test items that one pass holds, and text that one shard indexes, in bytes; places that a lookup holds at once.
BLOCK_BYTES, SHARD_BYTES, EXPAND = 8 << 20, 4 << 20, 1 << 20
#: A-Z to a-z; what isn't a digit, a letter a-z or beyond ASCII becomes a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_FOLD).split()


class Windows:
    """All windows of test items, by length, as matrices of term numbers; which items have each."""

    def __init__(self, items: Iterable[tuple[str, str]], size: int = WINDOW):
        self.term: dict[bytes, int] = {}
        self.ids: list[str] = []
        number: dict[str, int] = {}
        have: dict[tuple[int, ...], set[int]] = {}
        for item, text in sorted(items):
            w = [self.term.setdefault(x, len(self.term)) for x in words(text)]
            if not w:
                continue
            if item not in number:
                number[item] = len(self.ids)
                self.ids.append(item)
            for i in range(max(1, len(w) - size + 1)):
                have.setdefault(tuple(w[i : i + size]), set()).add(number[item])
        self.by_length: dict[int, tuple[np.ndarray, list[list[int]]]] = {}
        for n in sorted({len(k) for k in have}):
            keys = sorted(k for k in have if len(k) == n)
            self.by_length[n] = (np.array(keys, dtype=np.int64).reshape(-1, n), [sorted(have[k]) for k in keys])


class Postings:
    """What a shard stores: its words, how often each stands there, their positions word by word; words of each document.

    Positions run over all documents, with a gap after each.
    """

    def __init__(self, texts: list[str | None]):
        number: dict[bytes, int] = {}
        ids, sizes = array("i"), []
        for t in texts:
            w = words(t)
            sizes.append(len(w))
            for x in set(w).difference(number):
                number[x] = len(number)
            ids.extend(map(number.__getitem__, w))
            ids.append(-1)
        flat = np.frombuffer(ids, dtype=np.int32) if len(ids) else np.zeros(0, np.int32)
        self.vocabulary = list(number)
        self.sizes = np.array(sizes, dtype=np.int64)
        order = np.argsort(flat, kind="stable")
        self.positions = order[len(texts) :].astype(np.int32)
        self.counts = np.bincount(flat[self.positions], minlength=len(number)).astype(np.int32)


class Shard:
    """Stored postings seen through the term numbers of some test items."""

    def __init__(self, vocabulary: list[bytes], counts: np.ndarray, positions: np.ndarray, sizes: np.ndarray, term: dict[bytes, int]):
        self.sizes = sizes
        self.begin = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
        self.span = int(sizes.sum()) + len(sizes) + 1
        known = [(term[w], i) for i, w in enumerate(vocabulary) if w in term]
        known.sort()
        first = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
        lists = [positions[first[i] : first[i + 1]] for _, i in known]
        self.positions = np.concatenate([np.zeros(0, np.int64), *lists]).astype(np.int64)
        self.count = np.zeros(len(term), np.int64)
        self.count[[t for t, _ in known]] = [len(x) for x in lists]
        self.first = np.concatenate([[0], np.cumsum(self.count)])
        self.keys = np.repeat(np.arange(len(term)), self.count) * self.span + self.positions  # sorted: by term, then position

    @classmethod
    def of(cls, texts: list[str | None], term: dict[bytes, int]) -> Shard:
        p = Postings(texts)
        return cls(p.vocabulary, p.counts, p.positions, p.sizes, term)

    def document(self, at):
        """The number of the document at a position."""
        return np.searchsorted(self.begin, at, "right") - 1

    def postings(self, t: int) -> np.ndarray:
        return self.positions[self.first[t] : self.first[t + 1]]

    def _has(self, terms: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether each position is in its term's list."""
        want = terms * self.span + at
        i = np.searchsorted(self.keys, want)
        return (at >= 0) & (at < self.span) & (i < len(self.keys)) & (self.keys[np.minimum(i, len(self.keys) - 1)] == want)

    def phrases(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, start) of every exact occurrence of every window."""
        none = np.zeros(0, np.int64)
        if not len(windows) or not len(self.keys):
            return none, none
        counts = self.count[windows]
        alive = np.flatnonzero(counts.min(axis=1) > 0)
        if not len(alive):
            return none, none
        ranked = np.argsort(counts[alive], axis=1, kind="stable")  # offsets, rarest term first
        rare = windows[alive, ranked[:, 0]]
        ends = np.cumsum(self.count[rare])
        which, starts = [none], [none]
        for low in range(0, int(ends[-1]), EXPAND):
            place = np.arange(low, min(low + EXPAND, int(ends[-1])))
            row = np.searchsorted(ends, place, "right")
            within = place - (ends[row] - self.count[rare[row]])
            start = self.positions[self.first[rare[row]] + within] - ranked[row, 0]
            for k in range(1, windows.shape[1]):
                if not len(row):
                    break
                offset = ranked[row, k]
                ok = self._has(windows[alive[row], offset], start + offset)
                row, start = row[ok], start[ok]
            ok = start >= 0
            which.append(alive[row[ok]])
            starts.append(start[ok])
        return np.concatenate(which), np.concatenate(starts)

    def near(self, terms: list[int], span: int) -> list[tuple[int, int]]:
        """(start, end) of the shortest runs of words that hold all terms, in any order: at most span words, no smaller run inside."""
        lists = sorted((self.postings(t) for t in set(terms)), key=len)
        if not lists or not len(lists[0]):
            return []
        # only what is within reach of the rarest term can matter
        rare = lists[0]
        places, of = [rare], [np.zeros(len(rare), np.int64)]
        for k, x in enumerate(lists[1:], 1):
            i = np.searchsorted(rare, x)
            gap = np.minimum(np.abs(rare[np.minimum(i, len(rare) - 1)] - x), np.abs(rare[np.maximum(i - 1, 0)] - x))
            places.append(x[gap < span])
            of.append(np.full(int((gap < span).sum()), k))
        at, of = np.concatenate(places), np.concatenate(of)
        order = np.argsort(at, kind="stable")
        doc, out = self.document(at), []
        have, missing, left = [0] * len(lists), len(lists), 0
        at, of, doc = at[order].tolist(), of[order].tolist(), doc[order].tolist()
        for right, (p, k) in enumerate(zip(at, of)):
            if doc[left] != doc[right]:
                have, missing, left = [0] * len(lists), len(lists), right
            missing -= have[k] == 0
            have[k] += 1
            while have[of[left]] > 1:
                have[of[left]] -= 1
                left += 1
            if not missing:
                if p - at[left] < span:
                    out.append((at[left], p + 1))
                have[of[left]] -= 1
                missing += 1
                left += 1
        return out


def _matches(shard: Shard, w: Windows) -> tuple[np.ndarray, dict[int, set[int]]]:
    """A flag for each position that is hit, and the items found, by document."""
    change = np.zeros(shard.span + 1, np.int64)
    found: dict[int, set[int]] = {}
    for n, (windows, items) in w.by_length.items():
        which, start = shard.phrases(windows)
        np.add.at(change, start, 1)
        np.add.at(change, start + n, -1)
        for k, d in {*zip(which.tolist(), shard.document(start).tolist())}:
            found.setdefault(d, set()).update(items[k])
    return np.cumsum(change) > 0, found


def _runs(flags: np.ndarray) -> list[list[int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edge.reshape(-1, 2).tolist()


def _shards(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch of at most SHARD_BYTES of text, or one row."""
    size = [0 if x is None else x for x in pa.compute.binary_length(batch.column("text_")).to_pylist()]
    begin, total = 0, 0
    for i, n in enumerate(size):
        if i > begin and total + n > SHARD_BYTES:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += n
    if len(size) > begin:
        yield batch.slice(begin)


def blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> list[DataFrame]:
    """The test items, dealt to as many blocks as keep each within block_bytes or so."""
    known = benchmark.filter("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item"), "text").distinct()
    total = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // block_bytes)
    return [known] if n <= 1 else [known.filter(F.pmod(F.xxhash64("item"), F.lit(n)) == i) for i in range(n)]


#: A shard's row: its documents' keys, words of each, and the postings (32-bit counts and positions).
_SHARD = "n_words array<long>, vocabulary array<binary>, counts binary, positions binary"
_SPANS = pa.list_(pa.list_(pa.int64()))


def index(rows: DataFrame) -> DataFrame:
    """The stored postings of rows(key_, text_), a row for each shard: keys and _SHARD."""
    common.bound_batches(rows.sparkSession)
    schema = common.with_fields(rows.select(F.array("key_").alias("keys")).schema, _SHARD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.make_room()
        for batch in batches:
            for b in _shards(batch):
                p = Postings(b.column("text_").to_pylist())
                keys = pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), b.column("key_"))
                cells = [pa.array([p.sizes.tolist()], pa.list_(pa.int64())), pa.array([p.vocabulary], pa.list_(pa.binary())), pa.array([p.counts.tobytes()], pa.binary()), pa.array([p.positions.tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays([keys, *cells], names=["keys", "n_words", "vocabulary", "counts", "positions"])

    return common.written(rows.select("key_", "text_").mapInArrow(run, schema), "postings")


def _stored(batches: Iterator[pa.RecordBatch], term: dict[bytes, int]) -> Iterator[tuple[pa.Array, Shard]]:
    for b in batches:
        for i in range(b.num_rows):
            vocabulary, counts, positions, sizes = (b.column(c)[i] for c in ("vocabulary", "counts", "positions", "n_words"))
            found = Shard(vocabulary.as_py(), np.frombuffer(counts.as_py(), "<i4"), np.frombuffer(positions.as_py(), "<i4"), sizes.values.to_numpy(zero_copy_only=False), term)
            yield b.column("keys")[i].values, found


def probe(postings: DataFrame, block: DataFrame, size: int = WINDOW, every: bool = True) -> tuple[DataFrame, Broadcast]:
    """key_, n_words, spans and items of the documents of an index; of those with a hit only, unless every. And what was broadcast for it."""
    # a block's size is bounded by BLOCK_BYTES
    sent = postings.sparkSession.sparkContext.broadcast(Windows([(r[0], r[1]) for r in block.collect()], size))
    schema = common.with_fields(postings.select(F.element_at("keys", 1).alias("key_")).schema, "n_words long, spans array<array<long>>, items array<string>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.make_room()
        w = sent.value
        for keys, shard in _stored(batches, w.term):
            hit, found = _matches(shard, w)
            spans = [_runs(hit[a : a + n]) if d in found else [] for d, (a, n) in enumerate(zip(shard.begin.tolist(), shard.sizes.tolist()))]
            items = [sorted(w.ids[k] for k in found.get(d, ())) for d in range(len(spans))]
            b = pa.RecordBatch.from_arrays([keys, pa.array(shard.sizes), pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.string()))], names=["key_", "n_words", "spans", "items"])
            yield b if every else b.take(pa.array(sorted(found), pa.int64()))

    return postings.mapInArrow(run, schema), sent


def _merged(spans: Column) -> Column:
    """Sorted spans, those that touch made one."""
    last = lambda a: F.element_at(a, -1)
    joined = lambda a, x: F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(F.array(last(a)[0], F.greatest(last(a)[1], x[1]))))
    step = lambda a, x: F.when((F.size(a) > 0) & (last(a)[1] >= x[0]), joined(a, x)).otherwise(F.concat(a, F.array(x)))
    return F.aggregate(F.array_sort(spans), F.array().cast("array<array<bigint>>"), step)


def searched(rows: DataFrame, benchmark: DataFrame, size: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """key_, n_words, spans (array of [start, end) of words hit) and items (array of ids, sorted) of rows(key_, text_).

    Of several blocks, each is a job of its own; its hits are written and its broadcast is released.
    """
    postings = index(rows.withColumn("key_", F.struct(F.col("key_"), F.monotonically_increasing_id().alias("row_"))))
    parts = blocks(benchmark, block_bytes)
    if len(parts) == 1:
        found = probe(postings, parts[0], size)[0]
    else:
        hit = None
        for part in parts:
            one, sent = probe(postings, part, size, every=False)
            one = common.written(one, "hits")
            sent.destroy()
            hit = one if hit is None else hit.unionByName(one)
        hit = hit.groupBy(F.col("key_.row_").alias("row_")).agg(_merged(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        docs = postings.select(F.explode(F.arrays_zip("keys", "n_words")).alias("d")).select(F.col("d.keys").alias("key_"), "d.n_words", F.col("d.keys.row_").alias("row_"))
        found = docs.join(hit, "row_", "left").select("key_", "n_words", F.coalesce("spans", F.array().cast("array<array<bigint>>")).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    return found.withColumn("key_", F.col("key_.key_"))


def hits(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, spans and items of every row of docs(doc_id, text)."""
    return searched(docs.select(F.col("doc_id").alias("key_"), F.col("text").alias("text_")), benchmark, size, block_bytes).withColumnRenamed("key_", "doc_id")


def proximity(docs: DataFrame, benchmark: DataFrame, span: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item and [start, end) of the shortest runs of at most span words of a document that hold all of an item's words, in any order.

    A run is reported if no smaller one inside it holds them too. Items of more different words than span match nothing.
    """
    postings = index(docs.select(F.col("doc_id").alias("key_"), F.col("text").alias("text_")))
    schema = postings.select(F.element_at("keys", 1).alias("doc_id")).schema
    schema = common.with_fields(schema, "item string, start long, end long")
    out = None
    for part in blocks(benchmark, block_bytes):
        items = [(r[0], sorted(set(words(r[1])))) for r in part.collect()]
        sent = postings.sparkSession.sparkContext.broadcast([(item, terms) for item, terms in items if 0 < len(terms) <= span])

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            term: dict[bytes, int] = {}
            numbered = [(item, [term.setdefault(t, len(term)) for t in terms]) for item, terms in sent.value]
            for keys, shard in _stored(batches, term):
                doc, item_, start, end = [], [], [], []
                for item, terms in numbered:
                    for a, e in shard.near(terms, span):
                        d = int(shard.document(a))
                        doc.append(d), item_.append(item), start.append(a - int(shard.begin[d])), end.append(e - int(shard.begin[d]))
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(doc, pa.int64())), pa.array(item_, pa.string()), pa.array(start, pa.int64()), pa.array(end, pa.int64())], names=["doc_id", "item", "start", "end"])

        one = common.written(postings.mapInArrow(run, schema), "near")
        sent.destroy()
        out = one if out is None else out.unionByName(one)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    found = hits(docs, benchmark, size=size)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x[1] - x[0])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def op6(spark, sf_dir: str) -> DataFrame:
    return decontaminate(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of the benchmark, with their columns; rows are judged each by its own text."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row_"))
    rows = common.written(rows.withColumn("key_", F.monotonically_increasing_id()), "rows")
    found = searched(rows.select("key_", F.col("row_")["text"].alias("text_")), common.table(spark, sf_dir, "benchmark")).filter(F.size("spans") > 0).select("key_")
    return common.unpacked(common.only(rows, common.written(found, "found"), "key_", "left_anti"), docs.columns)
