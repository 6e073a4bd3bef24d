"""SimHash, near copies, embeddings: against brute force."""

import random

import numpy as np
import xxhash

from faultmill.llm import embeddings, simhash
from faultmill.llm.common import components


def groups(n, links):
    parent = list(range(n))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return [top(x) for x in range(n)]


def slow_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def test_trie_join_equals_all_pairs():
    rng = np.random.default_rng(3)
    for _ in range(5):
        base = rng.integers(0, 2**63, 30, dtype=np.uint64)
        values = base[rng.integers(0, 30, 300)]
        for _ in range(4):
            values = np.where(rng.random(300) < .6, values ^ (np.uint64(1) << rng.integers(0, 48, 300).astype(np.uint64)),
                              values)
        values = np.unique(values)
        group = values >> np.uint64(48)
        pairs = [(i, j) for i in range(values.size) for j in range(i)
                 if group[i] == group[j] and int(values[i] ^ values[j]).bit_count() <= 3]
        i, j = simhash.trie_links(values, group, 16, 3)
        assert {(max(a, b), min(a, b)) for a, b in zip(i.tolist(), j.tolist(), strict=True)} <= set(pairs)
        assert groups(values.size, pairs) == groups(values.size, zip(i.tolist(), j.tolist(), strict=True))


def test_hot_keys_are_split_without_loss(spark):
    """Fingerprints that share most of their bits, far over the limit of a key."""
    rng = np.random.default_rng(4)
    low = np.unique(rng.integers(0, 1 << 22, 1200, dtype=np.int64))
    values = np.unique(np.concatenate([low, low[:100] | (1 << 60)]))
    links = [(i, j) for i in range(values.size) for j in range(i) if int(values[i] ^ values[j]).bit_count() <= 3]
    rows = spark.createDataFrame([(0, v) for v in values.tolist()], "space int, fp long")
    got = simhash.linked(rows, 3, limit=20).collect()
    place = {v: k for k, v in enumerate(values.tolist())}
    assert all((r.a ^ r.b).bit_count() <= 3 for r in got)
    assert groups(values.size, [(place[r.a], place[r.b]) for r in got]) == groups(values.size, links)


def test_documents_equal_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").limit(150)
    rows = [tuple(r) for r in docs.collect()]
    rows += [(9001, rows[0][1]), (9002, None), (9003, " \n\t"), (9004, "two words"), (9005, "TWO words"), (None, rows[1][1])]
    prints = [slow_print(t) for _, t in rows]
    top = groups(len(rows), [(i, j) for i in range(len(rows)) for j in range(i)
                             if (prints[i] ^ prints[j]).bit_count() <= 3])
    least = {}
    for (doc, _), t in zip(rows, top, strict=True):
        if doc is not None:
            least[t] = min(least.get(t, doc), doc)
    want = sorted(((d is None, d or 0), p, least.get(t)) for (d, _), p, t in zip(rows, prints, top, strict=True))
    made = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(7))
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.fp % (1 << 64), r.component_id) for r in made.collect()) == want
    assert simhash.near_duplicates(docs.limit(0)).collect() == []


def test_components_of_chains_and_hubs(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(300, 340)] + [(7, 1000 + i) for i in range(200)] + [(5, 5), (None, 3), (2, 7)]
    rng.shuffle(links)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 300 for i in range(300, 341)}, **{1000 + i: 2 for i in range(200)}, 2: 2, 7: 2}


def test_near_copies_keep_one_of_each(spark):
    rng = random.Random(2)
    def prose(n):
        return [f"{rng.choice('bcdfgklm')}{rng.choice('aeiou')}{rng.randrange(900)}" for _ in range(n)]
    rows, kept = [], set()
    for g in range(25):
        words = prose(220)
        rows.append((g * 100, " ".join(words)))
        kept.add(g * 100)
        for c in range(1, 5):
            edited = list(words)
            for _ in range(c):
                edited[rng.randrange(220)] = "changed"
            rows.append((g * 100 + c, " ".join(edited) if c < 4 else " ".join(words)))
        rows.append((g * 100 + 50, " ".join(prose(220))))
        kept.add(g * 100 + 50)
    rows += [(90_000, None), (90_001, ""), (90_002, "tiny"), (90_003, "small"), (0, rows[0][1])]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, __key string")
    docs = docs.withColumnRenamed("__key", "component")
    got = simhash.near_copies(docs.repartition(5))
    assert got.columns == docs.columns
    left = [r.doc_id for r in got.collect()]
    kept |= {90_000, 90_002, 90_003}
    # candidates come by chance: of 100 copies, up to six per cent of the words changed, two may stay
    assert kept <= set(left) and len(left) == len(set(left)) <= len(kept) + 2


def jaccard(a, b):
    a, b = ({tuple(t.split()[k:k + 5]) for k in range(len(t.split()) - 4)} for t in (a, b))
    return len(a & b) / len(a | b)


def test_near_copies_of_long_texts_are_decided_by_all_shingles(spark):
    """Pairs of 1000 words just above and just below 0.8: sketches of 256 hashes cannot tell them apart."""
    rng = random.Random(12)
    rows = []
    for g in range(30):
        words = [f"w{rng.randrange(10 ** 6)}" for _ in range(1000)]
        edits = 21 if g % 2 else 23  # each takes five shingles: 0.81 and 0.79
        other = list(words)
        for k in range(edits):
            other[30 + k * 40] = f"new{g}x{k}"
        rows += [(2 * g, " ".join(words)), (2 * g + 1, " ".join(other))]
        assert (jaccard(rows[-2][1], rows[-1][1]) >= .8) == bool(g % 2)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts = simhash._texts(docs, "doc_id", "text").withColumnRenamed("doc_id", "low")
    keys = {r.low: r.key for r in texts.collect()}
    pairs = spark.createDataFrame([(keys[2 * g], keys[2 * g + 1]) for g in range(30)], "x long, y long")
    near = {r.x for r in simhash._held(pairs, texts, docs, .8, "doc_id", "text").collect()}
    assert near == {keys[2 * g] for g in range(1, 30, 2)}


def test_near_copies_that_differ_by_a_block(spark):
    """Text appended, trimmed or put in front: all at 0.8 or more go, what is below stays."""
    rng = random.Random(13)
    rows, kept = [], set()
    for g in range(60):
        words = [f"w{rng.randrange(10 ** 6)}" for _ in range(rng.choice((60, 250, 700)))]
        more = [f"m{rng.randrange(10 ** 6)}" for _ in range(len(words) // 5)]
        rows += [(10 * g, " ".join(words)), (10 * g + 1, " ".join(words + more)), (10 * g + 2, " ".join(more + words)),
                 (10 * g + 3, " ".join(words[:-len(words) // 6])), (10 * g + 4, " ".join(words + [f"{k}{m}" for m in more for k in "abc"]))]
        assert all(jaccard(rows[-5][1], t) >= .8 for _, t in rows[-4:-1])
        assert all(jaccard(rows[-1][1], t) < .8 for _, t in rows[-5:-1])
        kept |= {10 * g, 10 * g + 4}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert {r.doc_id for r in simhash.near_copies(docs).collect()} == kept


def test_near_copies_in_a_hot_family(spark, monkeypatch):
    """Variants below 0.8 of each other that share most shingles, each with a twin."""
    monkeypatch.setattr(simhash, "SHARED", 10)
    monkeypatch.setattr(simhash._sharing, "__defaults__", (10,))
    monkeypatch.setattr(simhash, "TILE_TEXTS", 32)
    rng = random.Random(14)
    base, rows = [f"w{k}" for k in range(220)], []
    for g in range(150):
        words = list(base)
        for k in rng.sample(range(5, 215, 6), 8):
            words[k] = f"v{g}x{k}"
        twin = list(words)
        twin[110 + g % 90] = "other"
        rows += [(2 * g, " ".join(words)), (2 * g + 1, " ".join(twin))]
    sets = [{tuple(t.split()[k:k + 5]) for k in range(216)} for _, t in rows]
    links = [(i, j) for i in range(300) for j in range(i) if len(sets[i] & sets[j]) >= .8 * len(sets[i] | sets[j])]
    top = groups(300, links)
    assert 100 < len({*top}) <= 150
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert {r.doc_id for r in simhash.near_copies(docs).collect()} == {*top}


def test_tile_products_keep_their_bound():
    rng = np.random.default_rng(5)
    base = rng.standard_normal((40, 48))
    a = np.concatenate([base + rng.standard_normal((40, 48)) * s for s in (0, .02, .2, .39, .4, .41)]) * 1e150
    unit = a / np.abs(a).max(axis=1, keepdims=True)
    unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
    near = unit @ unit.T
    i, j = embeddings.tile_links(a, None, 0.93)
    assert {*zip(i.tolist(), j.tolist(), strict=True)} == {
        (x, y) for x, y in zip(*np.nonzero(near >= 0.93), strict=True) if x < y}
    i, j = embeddings.tile_links(a[:100], a[100:], 0.93)
    assert {*zip(i.tolist(), j.tolist(), strict=True)} == {*zip(*np.nonzero(near[:100, 100:] >= 0.93), strict=True)}


def test_vectors_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "TILE", 16)
    rng = np.random.default_rng(6)
    base = rng.standard_normal((30, 8))
    rows = []
    for i in range(200):
        v = base[rng.integers(30)] + rng.standard_normal(8) * rng.choice([0, .05, .3])
        rows.append((1000 - i, v.tolist(), int(rng.integers(3))))
    rows += [(1, None, 0), (2, [0.0] * 8, 0), (3, [None] + [1.0] * 7, 0), (4, [float("nan")] * 8, 1),
             (5, rows[0][1], None), (6, [], 0), (7, [1.0, 2.0], 0), (8, [2.0, 4.0], 0), (None, rows[1][1], rows[1][2]),
             (9, [float("inf")] + [1.0] * 7, 0), (1000, rows[0][1], rows[0][2])]
    def good(v):
        return bool(v) and None not in v and np.isfinite(v).all() and any(v)
    links = []
    for i, (_, v, label) in enumerate(rows):
        for j in range(i):
            w = rows[j][1]
            if label is not None and label == rows[j][2] and good(v) and good(w) and len(v) == len(w):
                if np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w) >= 0.93:
                    links.append((i, j))
    top = groups(len(rows), links)
    least, count = {}, [0] * len(rows)
    for (i, _, _), t in zip(rows, top, strict=True):
        if i is not None:
            least[t] = min(least.get(t, i), i)
    for i, j in links:
        count[i] += 1
        count[j] += 1
    want = sorted(str((r[0], n, least.get(t), r[0] is not None and r[0] == least.get(t)))
                  for r, n, t in zip(rows, count, top, strict=True))
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    got = embeddings.near_duplicates(table).collect()
    assert sorted(str((r.vec_id, r.n_links, r.component_id, r.kept)) for r in got) == want
    assert embeddings.near_duplicates(table.limit(0)).collect() == []


def test_common_counts():
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(0, 6000, rng.integers(0, 900)).astype(np.uint64)) for _ in range(25)]
    sizes = [np.array([s.size for s in part], np.int64) for part in (sets[:10], sets[10:])]
    packed = [np.concatenate(part) for part in (sets[:10], sets[10:])]
    want = [[np.intersect1d(a, b).size for b in sets[10:]] for a in sets[:10]]
    assert simhash.common_counts(packed, sizes).tolist() == want
    want = [[np.intersect1d(a, b).size for b in sets[:10]] for a in sets[:10]]
    got = simhash.common_counts(packed[:1], sizes[:1])
    assert all(got[i][j] == want[i][j] for i in range(10) for j in range(10) if i != j)
