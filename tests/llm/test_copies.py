"""The pipeline's near copies, planted and against brute force."""

import random

import pytest

from tidewater.llm import neardup


def grams(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def slow_roots(texts):
    """Least id of each text's component, all pairs compared."""
    sets, root = {i: grams(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in texts:
        for j in texts:
            if i < j:
                both = len(sets[i] & sets[j])
                if 10 * both >= 8 * (len(sets[i]) + len(sets[j]) - both):
                    a, b = sorted((find(i), find(j)))
                    root[b] = a
    return {i: find(i) for i in texts}


def planted():
    """Random texts, copies of some with words changed, a group of 151 that only one text holds together, a line that most have."""
    r = random.Random(3)
    words = [f"w{i}" for i in range(500)]
    line = " ".join(r.choices(words, k=9))
    texts = [" ".join([line, *r.choices(words, k=r.randint(1, 90))]) for _ in range(120)]

    def changed(text, k):
        w = text.split()
        for i in r.sample(range(len(w)), min(k, len(w))):
            w[i] = r.choice(words)
        return " ".join(w)

    texts += [changed(t, r.randint(0, 4)) for t in texts for _ in range(2)]
    middle = " ".join(r.choices(words, k=60))
    texts += [middle, *(changed(middle, 1) for _ in range(150))]
    texts += [None, "", " ", "One two", "one  TWO", "one two three"]
    r.shuffle(texts)
    return dict(enumerate(texts))


@pytest.mark.parametrize("block", [4096, 40])
def test_near_copies_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    texts = planted()
    want = slow_roots(texts)
    assert max(sum(v == w for v in want.values()) for w in want.values()) >= 151
    got = neardup.near_copies(spark.createDataFrame([*texts.items()], "id long, text string").repartition(4)).collect()
    assert len(got) == len(texts) and {r.id: r.component for r in got} == want


def test_parities_never_rule_out_similar_sets():
    import numpy as np

    r = np.random.default_rng(2)
    for n in (1, 7, 300, 9000):
        x = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64))
        y = np.unique(np.concatenate([x[: n - n // 9], r.integers(0, 1 << 63, n // 9, dtype=np.uint64)]))
        differ = int(np.bitwise_count((neardup.parities(x) ^ neardup.parities(y)).view("<u8")).sum())
        assert differ <= len(np.setxor1d(x, y)) and neardup.parities(x).shape == (neardup.PARITY_WORDS,)


@pytest.mark.parametrize("size", [1, 3, 7, 1000])
def test_lists_in_blocks(size):
    """Whatever the batches, members of lists come back once, long lists in blocks that all hold the first member."""
    import numpy as np
    import pyarrow as pa

    r = random.Random(size)
    keys = sorted(k for k in range(40) for _ in range(r.choice([1, 1, 2, 3, 4, 5, 8, 9, 17])))
    ids = list(range(len(keys)))
    rows = pa.table({"key": keys, "id": ids, "at": [(i << 32) + 5 for i in ids]})
    got = [x for b in neardup._lists(4)(iter(rows.to_batches(max_chunksize=size))) for x in b.to_pylist()]
    of = {k: [i for i, x in zip(ids, keys) if x == k] for k in set(keys)}
    assert sorted((x["key"], x["id"]) for x in got if not x["copy"]) == sorted((k, i) for k, m in of.items() if len(m) > 1 for i in m)
    assert all((x["n"], x["at"]) == (x["id"], 5) for x in got)
    for k, members in of.items():
        mine = [x for x in got if x["key"] == k]
        if len(members) > 4:
            blocks = {b: [x["id"] for x in mine if x["block"] == b] for b in {x["block"] for x in mine}}
            assert all(x["m"] == 5 for x in mine) and all(members[0] in b and len(b) <= 5 for b in blocks.values()) and len(blocks) == -(-len(members) // 4)
        else:
            assert all((x["m"], x["block"], x["copy"]) == (len(members), 0, 0) for x in mine)


@pytest.mark.parametrize("changes", [1, 2])
def test_stage_drops_planted_near_copies(spark, changes):
    r = random.Random(changes)
    text = [f"x{r.randint(0, 999)}" for _ in range(120)]
    copy = [f"y{i}" if i in range(20, 20 + 40 * changes, 40) else w for i, w in enumerate(text)]
    far = [f"z{i}" if i % 12 == 5 else w for i, w in enumerate(text)]
    docs = spark.createDataFrame([(7, " ".join(copy)), (3, " ".join(text)), (9, " ".join(far))], "doc_id long, text string")
    assert sorted(x.doc_id for x in neardup.stage(spark, docs, "").collect()) == [3, 9]


def test_rows_are_dropped_not_ids(spark):
    a, b, c = (" ".join(f"{k}{i}" for i in range(40)) for k in "abc")
    rows = [(1, a), (5, a), (5, b), (None, c), (None, c), (None, c)]
    got = neardup.stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == [(0, c), (1, a), (5, b)]


def test_near_copies_go_through_the_fingerprint_index(spark, monkeypatch):
    """What the index links, texts with equal fingerprints too, is as by brute force, and near_copies takes its pairs from there."""
    r = random.Random(5)
    fps = [r.getrandbits(62) for _ in range(60)]
    fps += [f ^ sum(1 << b for b in r.sample(range(62), k)) for f in fps[:30] for k in (1, 3, 4)] + fps[:10]
    root = list(range(len(fps)))
    for _ in fps:
        for i in range(len(fps)):
            root[i] = min(root[j] for j in range(len(fps)) if (fps[i] ^ fps[j]).bit_count() <= neardup.BITS)
    edges = neardup.fingerprint_pairs(spark.createDataFrame([*enumerate(fps)], "id long, fp long"))
    assert all((fps[e.a] ^ fps[e.b]).bit_count() <= neardup.BITS for e in edges.collect())
    got = {x.id: x.root for x in neardup.components(edges).collect()}
    assert [got.get(i, i) for i in range(len(fps))] == root

    met, before = [], neardup.links
    monkeypatch.setattr(neardup, "links", lambda classes, *a: met.append(classes.count()) or before(classes, *a))
    texts = planted()
    got = neardup.near_copies(spark.createDataFrame([*texts.items()], "id long, text string")).collect()
    assert met and met[0] > 100 and {x.id: x.component for x in got} == slow_roots(texts)


def test_a_group_of_near_copies_gives_few_pairs(spark, monkeypatch):
    """Texts verified grow with a group whose members are near to some others only, not with its square; none of its links is lost."""
    r = random.Random(7)
    base = [f"w{i}" for i in range(60)]
    edits = [*(("a", i) for i in range(0, 60, 6)), *(("b", i) for i in range(3, 60, 6))]
    texts = dict(enumerate(" ".join(f"{c}{i}" if i in at else w for i, w in enumerate(base)) for at, c in ((dict(e[::-1] for e in r.sample(edits, 2)), chr(97 + k % 26) + str(k)) for k in range(240))))
    met, before = [], neardup._verified

    def counted(pairs, *a):
        met.append(pairs.count())
        return before(pairs, *a)

    monkeypatch.setattr(neardup, "_verified", counted)
    got = neardup.near_copies(spark.createDataFrame([*texts.items()], "id long, text string").repartition(4)).collect()
    assert {x.id: x.component for x in got} == slow_roots(texts)
    assert sum(met) < 20 * len(texts) < len(texts) ** 2 / 8


@pytest.mark.parametrize("forest", [False, True])
def test_pairs_of_a_list_that_no_link_has_joined(forest):
    """All that can be similar, guests with the block's members only; as a forest, one pair for each root that joins another."""
    import numpy as np
    import pyarrow as pa
    from fractions import Fraction

    r = np.random.default_rng(4)
    base = np.unique(r.integers(0, 1 << 63, 400, dtype=np.uint64))
    sets = [np.sort(np.concatenate([np.delete(base, r.choice(len(base), k, replace=False)), r.integers(0, 1 << 63, k, dtype=np.uint64)])) for k in r.integers(5, 90, 60)]
    asks = [0] * 20 + [1] * 20 + [2] * 20
    rows = pa.table({
        "key": [0] + [9] * 60, "id": range(-1, 60), "n": [400] * 61, "at": [0] * 61, "root": [-1, *(i // 2 for i in range(60))], "asks": [1, *asks],
        "odd": pa.array([neardup.parities(base), *(neardup.parities(s) for s in sets)], pa.list_(pa.int64())),
    })
    got = [(x["a"], x["b"]) for b in neardup._other_pairs(Fraction("0.8"), forest)(iter(rows.to_batches(max_chunksize=7))) for x in b.to_pylist()]
    apart = {(i, j) for i in range(60) for j in range(i + 1, 60) if i // 2 != j // 2 and asks[j] and not asks[i] == asks[j] == 2}
    alike = {p for p in apart if neardup.similar(sets[p[0]], sets[p[1]], Fraction("0.8"))}
    assert len(set(got)) == len(got) and set(got) <= apart and 100 < len(alike)
    if forest:
        assert 10 < len(got) < 30
    else:
        assert alike <= set(got) and len(got) < len(alike) + len(apart) / 20

def test_few_links_are_joined_in_one_task(spark, monkeypatch):
    """As by star steps, and with two written tables only."""
    r = random.Random(9)
    edges = [(i, i + 1) for i in range(100, 140)] + [(r.randint(200, 400), r.randint(200, 400)) for _ in range(120)] + [(7, 7), (9, -3), (-3, 9)]
    r.shuffle(edges)
    df = spark.createDataFrame(edges, "a long, b long").repartition(5)
    steps, one = ({x.id: x.root for x in neardup.components(df, **k).collect()} for k in ({}, {"few": 1000}))
    assert one == steps and one[140] == 100 and one[9] == -3 and 7 not in one
    assert neardup.components(df.limit(0), few=10).count() == 0
    tables, before = [], neardup.common.written
    monkeypatch.setattr(neardup.common, "written", lambda d, name: tables.append(name) or before(d, name))
    neardup.components(df, few=1000)
    assert tables == ["edges", "roots"]


def test_the_driver_gives_memory_back(spark):
    """Where Java can: the call reaches its command."""
    from tidewater.llm import common

    version = [int(x) for x in spark.sparkContext._jvm.System.getProperty("java.version").split(".")]
    assert common.trim_driver(spark) or version < [17, 0, 9]


def test_what_a_stage_kept_goes_when_the_next_one_begins(spark, tmp_path):
    """Stages called one by one, each written and read again, as the check tool does; a result that isn't written keeps its tables."""
    import os

    import corpus_pipeline
    from tidewater.llm import common

    stages = dict(corpus_pipeline.STAGES)
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    there = lambda paths: [p for p in paths if os.path.exists(p.removeprefix("file:"))]
    since = common.given()
    out = stages["near_duplicates"](spark, docs, sf)
    kept = common.given_since(since)
    assert len(kept) == 2 and there(kept) == kept  # the numbered rows and those to drop
    n = out.count()
    clean = stages["decontamination"](spark, out, sf)
    assert there(kept) == kept and 0 < clean.count() <= n
    out.write.parquet(f"{tmp_path}/out")
    stages["decontamination"](spark, spark.read.parquet(f"{tmp_path}/out"), sf)
    assert not there(kept)
