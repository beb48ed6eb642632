"""Exact search, conversation tries and periodic runs against plain versions, on odd rows too."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from leakloom.llm import periods, trie, vafile

NAN, INF = float("nan"), float("inf")


def plain_top(rows, k, is_query):
    units = lambda v: [int(np.floor(256 * float(x))) for x in v]
    ok = [(i, units(v)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and sum((256.0 * x) ** 2 for x in v) < 2**62]
    out = []
    for a, (i, q) in enumerate(ok):
        if is_query(i):
            best = sorted((-sum(x * y for x, y in zip(q, c, strict=False)), j) for b, (j, c) in enumerate(ok) if a != b)[:k]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(best, 1)]
    return sorted(out)


def searched(spark, rows, k=5, is_query=lambda i: i % 50 == 0):
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, row int, q int")
    return sorted(tuple(r) for r in vafile.top_k(df, is_query, k).collect())


@pytest.mark.parametrize("wide", [3, 24])
def test_search_finds_the_best_of_all(spark, wide):
    r = np.random.default_rng(wide)
    rows = [(i, v) for i, v in enumerate(r.normal(size=(700, wide)).astype(np.float32).tolist())]
    rows += [(700 + i, rows[50][1]) for i in range(300)]  # copies of a query
    rows += [(1000 + i, (np.array(rows[100][1]) + r.normal(size=wide) * 0.001).tolist()) for i in range(200)]
    assert searched(spark, rows) == plain_top(rows, 5, lambda i: i % 50 == 0)


def test_search_of_odd_vectors(spark):
    rows = [(0, None), (50, []), (100, [1.0]), (150, [1.0, None]), (200, [NAN]), (250, [INF, 1.0]), (300, [1.0, 2.0, 3.0]), (350, [0.0, 0.0]), (None, [1.0]), (400, [1e30]), (450, [1000.0, -1000.0]), (300, [1.0, 2.0, 3.0]), (300, [5.0]), (1, [-0.001]), (2, [1.0, 2.0]), (3, [3e6, 3e6])]
    got = searched(spark, rows)
    assert got == plain_top(rows, 5, lambda i: i % 50 == 0)
    assert {q for q, *_ in got} == {50, 100, 300, 350, 450}
    assert searched(spark, rows[:2]) == [] and searched(spark, []) == []
    zeros = [(i, [0.0, 0.0]) for i in range(120)] + [(i, [0.0, 0.0, float(i)]) for i in range(120, 260)]
    assert searched(spark, zeros) == plain_top(zeros, 5, lambda i: i % 50 == 0)


def test_bounds_hold_for_vectors_that_the_cells_do_not_fit():
    r = np.random.default_rng(1)
    inner = vafile.cuts(r.integers(-50, 50, (100, 6)).tolist())
    wide = r.integers(-500, 500, (400, 8))
    cells = np.zeros(wide.shape, np.uint8)
    for d in range(6):
        cells[:, d] = np.searchsorted(inner[d], wide[:, d], "right")
    low, high = vafile.bounds(cells, inner, wide.min(0), wide.max(0))
    assert (low <= wide).all() and (wide <= high).all()
    least, most = vafile.score_bounds(wide[:50].astype(float), low, high)
    scores = wide[:50] @ wide.T
    assert (least <= scores).all() and (scores <= most).all()
    huge = wide[:50].astype(float) * 2.0**40
    least, most = vafile.score_bounds(huge, low, high)
    assert all(least[i, j] <= int(scores[i, j]) * 2**40 <= most[i, j] for i in range(50) for j in range(400))


def test_few_exact_vectors_are_read(spark):
    r = np.random.default_rng(2)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(r.normal(size=(2000, 16)).tolist())], "v long, units array<double>")
    file = df.selectExpr("v", "transform(units, x -> cast(floor(256 * x) as long)) AS units", "v AS id")
    inner = vafile.cuts([x[0] for x in file.select("units").collect()])
    placed, n = vafile._sized(file, vafile.CELL_VALUES, "block")
    grouped, m = vafile._sized(file.filter("v % 50 = 0"), vafile.QUERY_VALUES, "group")
    met = vafile.candidates(placed.groupBy("block").applyInArrow(vafile._pack_cells(inner), vafile._CELLS_DDL), grouped.groupBy("group").applyInArrow(vafile._pack_queries, vafile._QUERIES_DDL), n, m, inner, 6)
    assert met.count() < 40 * 40  # of 40 queries with 2,000 vectors


def plain_trie(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            told = f"{len(role.encode())}:{role}{text}"
            convs.setdefault(c, []).append(((turn is not None, turn or 0, hashlib.sha256(told.encode()).hexdigest()), (role, text)))
    convs = {c: [t for _, t in sorted(x)] for c, x in convs.items()}
    built = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(convs.get(c - int(np.fmod(c, 5)), [])[:h] + own[h:])
    nodes = {}
    for c, x in built.items():
        for d in range(len(x) + 1):
            nodes.setdefault(x[:d], []).append(c)
    out = []
    for key, members in nodes.items():
        under = [n for n in nodes if n[: len(key)] == key]
        saved = sum((len(nodes[n]) - 1) * len(n[-1][1].encode()) for n in under if n)
        leaves = sum(not any(m[:-1] == n for m in nodes if m) for n in under)
        ends = ",".join(str(c) for c in sorted(c for c in members if built[c] == key))
        out.append((min(members), len(key), min(nodes[key[:-1]]) if key else None, len(members), sum(bool(m) and m[:-1] == key for m in nodes), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def grown(spark, rows):
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, part int, depth int")
    return sorted((tuple(r) for r in trie.trie(df).collect()), key=str)


def test_trie_against_a_plain_one(spark):
    r = random.Random(3)
    rows = [(c, t, r.choice(["user", "assistant", None]), r.choice(["a", "é", "", None, "long text"])) for c in range(60) for t in range(r.randint(0, 12))]
    rows += [(c, t, "user", f"same {t}") for c in range(100, 160) for t in range(4)]
    rows += [(7, None, "user", "first"), (7, None, "user", "first"), (None, 1, "user", "x"), (-3, 1, "user", "x"), (-3, 1, "user", "y"), (2001, 0, None, None), (5004, 1, "a", "b")]
    rows += [(3000, t, "user", "again" if t % 2 else "") for t in range(300)]
    r.shuffle(rows)
    assert grown(spark, rows) == plain_trie(rows)
    assert grown(spark, []) == []


def test_long_lists_of_ends_and_long_conversations_are_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 50)
    rows = [(c, 0, "user", "same") for c in range(0, 2000, 5)] + [(5001, t, "user", str(t % 3)) for t in range(150)]
    assert grown(spark, rows) == plain_trie(rows)
    ends = spark.createDataFrame([(c, 1, 2, 3, 4, 5) for c in range(1000)], "conv_id long, depth long, l0 long, l1 long, l2 long, l3 long")
    want = hashlib.sha256(",".join(map(str, range(1000))).encode()).hexdigest()
    assert [r.ends_sha256 for r in trie.end_lists(ends).collect()] == [want]


def plain_runs(words):
    out, n = {}, len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                out.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((s, q, n) for (s, n), q in out.items())


def test_runs_against_plain_ones():
    from leakloom.llm.words import mix

    r = random.Random(4)
    for _ in range(600):
        texts = []
        for _ in range(r.randint(1, 4)):
            text, k = [], r.randint(1, 4)
            for _ in range(r.randint(0, 14)):
                text += [r.randint(0, k) for _ in range(r.randint(1, 9))] * r.randint(1, 7)
            texts.append(text)
        bounds = np.cumsum([0] + [len(t) for t in texts])
        got = [tuple(x) for x in periods.find_runs(mix(np.array([x + 7 for t in texts for x in t], np.uint64)), bounds).tolist()]
        assert got == [(int(b) + s, n, q) for b, t in zip(bounds[:-1], texts, strict=True) for s, q, n in plain_runs(t)]


def test_runs_of_odd_texts(spark, odd, empty):
    def fold(i, n):
        h = zlib.crc32(str(i).encode()) // 10
        return h % n, 1 + (n - h % n) // (3 + h % 8)

    for how in (None, fold):
        got = periods.periodic_runs(odd, how).collect()
        assert len(got) == odd.count()
        want = []
        for r in odd.collect():
            words = (r.text or "").encode().split()
            if how and words:
                a, p = how(r.doc_id, len(words))
                words = [words[i if i < a else a + (i - a) % p] for i in range(len(words))]
            if len(words) < 2000:
                runs = plain_runs(words)
                gone = {i for s, q, n in runs for i in range(s + q, s + n)}
                want.append((r.doc_id, len(words), [(s, n, q) for s, q, n in runs], b" ".join(w for i, w in enumerate(words) if i not in gone).decode()))
        assert sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got if r.n_words < 2000), key=str) == sorted(want, key=str)
    long = next(r for r in periods.periodic_runs(odd).collect() if r.doc_id == 5)
    assert [tuple(x) for x in long.runs] == [(0, 48_000, 6)] and long.collapsed == "word another token of the text"
    assert periods.periodic_runs(empty).collect() == []


def test_an_index_of_twenty_batches_writes_each_entry_a_few_times(spark, tmp_path):
    """Runs have tiers: what is written over all batches grows with the logarithm of their number."""
    from leakloom.llm import substrings

    r = random.Random(6)
    shared = [" ".join(f"s{r.randint(0, 9)}{i}" for _ in range(25)) for i in range(3)]
    index, written, rows = substrings.FingerprintIndex(spark, 4), 0, []
    for b in range(20):
        batch = [(100 * b + i, " ".join([*(f"w{r.randint(0, 99999)}" for _ in range(60)), shared[(b + i) % 3] if i < 2 else ""])) for i in range(4)]
        rows += batch
        docs = spark.createDataFrame(batch, "doc_id long, text string")
        sent = docs.select((docs.doc_id + 1).alias("slice"), "text").mapInArrow(substrings._anchor_batches(20, 4), substrings._SENT_DDL)
        index.add(sent).collect()
        entries = spark.read.schema(substrings._MERGED_DDL).parquet(index.runs[-1][0]).filter("kind = 1").collect()
        written += sum(len(substrings.unpacked(x.fps)) for x in entries)
    held = sum(len(substrings.unpacked(x.fps)) for path, _ in index.runs for x in spark.read.schema(substrings._MERGED_DDL).parquet(path).filter("kind = 1").collect())
    assert [t for _, t in index.runs] == [4, 2]  # as the digits of 20
    assert held < written <= held * 5.5
    index.drop()


def test_numbers_of_rows_with_many_copies(spark, monkeypatch):
    from leakloom.llm import sharding

    monkeypatch.setattr(sharding, "COPIES", 7)
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 50)
    rows = [(1, "same")] * 300 + [(i, f"t{i}") for i in range(200)] + [(None, None)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = sharding.shard(docs, 7).collect()
    assert sorted(x.row_number for x in out) == list(range(503)) == sorted(x.position for x in out)
    assert sum(x.doc_id == 1 for x in out) == 301 and sum(x.doc_id is None for x in out) == 3
    sizes = [sum(x.shard == s for x in out) for s in range(7)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(x.slot for x in out if x.shard == s) == list(range(sizes[s])) for s in range(7))
