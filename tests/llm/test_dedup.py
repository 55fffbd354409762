"""Exact dedup, substring dedup and the Jaccard join against brute force."""

import hashlib
import random
from collections import defaultdict

import pyarrow as pa
import pytest
import zstandard

from graphloom.llm import exact_dedup, jaccard_join, substring_dedup
from graphloom.llm.links import components


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def test_exact_groups(make, prose):
    texts = prose(120) + ["ABC Äx", "abc Äx", "abc äx", None, ""]
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[lower(t)].append(i)
    got = exact_dedup.exact_groups(make(texts)).collect()
    assert len(got) == len(texts)
    for r in got:
        g = groups[lower(texts[r.id])]
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (max(g), len(g), r.id == max(g), hashlib.sha256(lower(texts[r.id]).encode()).hexdigest())


def test_exact_ties_and_nulls(make):
    got = exact_dedup.exact_groups(make(["a", "A", "a", "b"], ids=[5, 5, None, None])).collect()
    assert sorted((str(r.id), str(r.keep_id), r.group_size) for r in got) == [("5", "5", 3), ("5", "5", 3), ("None", "5", 3), ("None", "None", 1)]
    assert sum(r.kept for r in got if r.group_size == 3) == 1
    assert exact_dedup.exact_groups(make([])).count() == 0


@pytest.mark.parametrize("few", [1_000_000, 0])
def test_exact_semi_join_is_below_the_aggregate(make, prose, monkeypatch, few):
    """Only suspects' texts are grouped, whether their fingerprints are broadcast or not."""
    monkeypatch.setattr(exact_dedup, "BROADCAST_KEYS", few)
    plan = exact_dedup.exact_groups(make(prose(40, 4)))._jdf.queryExecution().optimizedPlan().toString().splitlines()
    monkeypatch.undo()
    reads = [i for i, line in enumerate(plan) if "norm" in line and "Aggregate [fp" in line]
    assert all(any("Join LeftSemi" in line for line in plan[i:]) for i in reads)


def test_owners_grow_with_rows():
    assert exact_dedup.owners_for(0, 8) == 8 and exact_dedup.owners_for(50_000_000_000, 200) == 12_500


def test_exact_shuffle_path(make, prose, monkeypatch):
    texts = prose(60, 4)
    want = sorted(map(tuple, exact_dedup.exact_groups(make(texts)).collect()))
    monkeypatch.setattr(exact_dedup, "BROADCAST_KEYS", 0)
    monkeypatch.setattr(exact_dedup, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, exact_dedup.exact_groups(make(texts)).collect())) == want


def repeats(texts, ids, width=13):
    words = [(t or "").encode().split() for t in texts]
    first = {}
    for i, ws in zip(ids, words, strict=True):
        for p in range(len(ws) - width + 1):
            k = tuple(ws[p : p + width])
            first[k] = min(first.get(k, i), i)
    for i, ws in zip(ids, words, strict=True):
        gone = {p + j for p in range(len(ws) - width + 1) if first[tuple(ws[p : p + width])] < i for j in range(width)}
        kept = [w for p, w in enumerate(ws) if p not in gone]
        yield i, len(ws), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()


@pytest.mark.parametrize("most", [50_000, 40])
def test_repeats(make, prose, monkeypatch, most):
    monkeypatch.setattr(substring_dedup, "GROUP_LEAST", most)
    monkeypatch.setattr(substring_dedup, "GROUP_MOST", most)
    texts = [*prose(80, 2), "a " * 60, "a " * 30, "A " * 30, "x y", None, "", " ".join(f"long{i % 5000}" for i in range(30_000))]
    got = substring_dedup.remove_repeats(make(texts)).drop("kept").collect()
    assert sorted(map(tuple, got)) == sorted(repeats(texts, range(len(texts))))


def test_repeats_of_one_key(make):
    text = " ".join(f"w{i}" for i in range(30))
    got = substring_dedup.remove_repeats(make([text, text, text + " z", "q " + text], ids=[3, 3, None, None])).collect()
    assert sorted((str(r.id), r.n_removed) for r in got) == [("3", 0), ("3", 0), ("None", 30), ("None", 30)]
    assert {r.kept for r in got if r.id is None} == {"z", "q"}
    assert substring_dedup.remove_repeats(make([])).count() == 0


def brute_maximal(texts, width):
    """Every sequence of words that occurs twice and that no word before or after all its places makes longer."""
    words = [tuple((t or "").encode().split()) for t in texts]
    places = defaultdict(list)
    for d, ws in enumerate(words):
        for i in range(len(ws)):
            for j in range(i + width, len(ws) + 1):
                places[ws[i:j]].append((d, i, j))
    out = []
    for seq, at in places.items():
        left = {words[d][i - 1] if i else (d, i) for d, i, _ in at}
        right = {words[d][j] if j < len(words[d]) else (d, j) for d, _, j in at}
        if len(at) > 1 and len(left) > 1 and len(right) > 1:
            out.append((b" ".join(seq).decode(), len(seq), len(at), min(d for d, _, _ in at)))
    return sorted(out)


@pytest.mark.parametrize("most", [50_000, 30])
def test_maximal_repeats(make, prose, monkeypatch, most):
    monkeypatch.setattr(substring_dedup, "GROUP_LEAST", most)
    monkeypatch.setattr(substring_dedup, "GROUP_MOST", most)
    texts = [*prose(40, 3, words=25, vocabulary=30), "a b c d e f", "x a b c d e f", "x a b c d", None, "", "a a a a a a a"]
    got = substring_dedup.maximal_repeats(make(texts), width=4).collect()
    assert sorted((r.words, r.n_words, r.places, r.least_id) for r in got) == brute_maximal(texts, 4) and not any(r.cut for r in got)
    assert substring_dedup.maximal_repeats(make([])).count() == 0


def test_nodes_of_a_subtree():
    import numpy as np

    tails = [b"d e", b"d f", b"d e", b"", b"z"]
    tree = substring_dedup.Subtree.of([b"a b c"] * 4 + [b"a b x"], tails, np.array([5, 3, 9, 4, 1]), 3)
    assert sorted((d, sorted(tree.order[a:b])) for d, a, b in tree.nodes()) == [(3, [0, 1, 2, 3]), (4, [0, 1, 2]), (5, [0, 2])]
    assert sorted(tree.repeated()) == [0, 2, 3]  # 4 has a path of its own


def test_equal_hashes_of_different_words_are_no_repeat(make, monkeypatch):
    """All windows share one hash, and all words a prefix: words alone tell them apart."""
    import numpy as np

    monkeypatch.setattr(substring_dedup, "window_hashes", lambda h, w: np.zeros(max(0, len(h) - w + 1), np.uint64))
    texts = [" ".join(f"{k}{i}" for i in range(20)) for k in "abca"]
    bucket = [(i, t.encode(), False) for i, t in enumerate(texts)]
    table = pa.table({"out": pa.array([0], pa.int32()), "ids": [[0, 1, 2, 3]], "sizes": [[len(t) for t in texts]], "texts": [zstandard.compress("".join(texts).encode())]})
    flags = pa.table({"owner": [0], "bits": [np.packbits([True]).tobytes()]})
    first, split, groups = substring_dedup.plan_groups(np.zeros(substring_dedup.SLOTS, np.int64), 10)
    sent = substring_dedup._send(13, 16, 16, 1, first, split, groups, False)(table, flags)
    hits = substring_dedup._tree(13)(sent)
    places = sorted(int(x) for h in hits.column("hits").to_pylist() for x in substring_dedup._unpack(h, np.uint32))
    assert places == list(range(60, 68)) and len(bucket) == 4


def test_sent_bytes_do_not_grow_with_groups():
    """What a bucket sends for one text is as much for 1,250 groups as for 32, but for a fixed cost of a record."""
    import numpy as np

    rng = random.Random(2)
    text = " ".join(f"w{rng.randrange(5000)}" for _ in range(200_000))
    table = pa.table({"out": pa.array([0], pa.int32()), "ids": [[7]], "sizes": [[len(text)]], "texts": [zstandard.compress(text.encode())]})
    owners, bits = 4, 24
    bucket = substring_dedup._Bucket.of([(7, text.encode(), False)], 13, True)
    _, _, cuts = bucket.codes(bits, owners)
    flags = pa.table({"owner": cuts[:, 2], "bits": [np.packbits(np.ones(b - a, bool)).tobytes() for a, b, _ in cuts]})
    counts = np.bincount(bucket.slots, minlength=substring_dedup.SLOTS)
    size = {}
    for groups in (32, 1250):
        first, split, n = substring_dedup.plan_groups(counts, -(-int(counts.sum()) // groups))
        sent = substring_dedup._send(13, 16, bits, owners, first, split, n, False)(table, flags)
        size[groups] = sum(len(x) for c in ("heads", "tails", "ids", "at") for x in sent.column(c).to_pylist())
        assert groups <= n <= 2 * groups + 64
    assert size[1250] < 1.35 * size[32]


def test_groups_of_prefixes_cover_all():
    import numpy as np

    counts = np.random.default_rng(3).integers(0, 5, substring_dedup.SLOTS)
    counts[7], counts[100:164] = 5000, 90
    first, split, n = substring_dedup.plan_groups(counts, 1000)
    size = np.zeros(n)
    for slot, k in enumerate(counts):
        size[first[slot] : first[slot] + split[slot]] += k / split[slot]
    assert size.sum() == pytest.approx(counts.sum()) and size.max() <= 1000


def brute_components(texts):
    sets = []
    for t in texts:
        ws = lower(t).encode().split()
        sets.append({tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} if len(ws) >= 5 else {tuple(ws)} if ws else set())
    comp = list(range(len(texts)))

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                comp[max(a, b)] = min(a, b)
    return sorted((i, len(s), find(i)) for i, s in enumerate(sets))


def near(n, seed, length, edits):
    rng = random.Random(seed)
    base = [f"b{rng.randrange(10**6)}" for _ in range(length)]
    for _ in range(n):
        ws = list(base)
        for _ in range(rng.randrange(edits + 1)):
            ws[rng.randrange(length)] = f"e{rng.randrange(10**6)}"
        yield " ".join(ws)


@pytest.mark.parametrize(("block", "task", "group"), [(1000, 4_000_000, 1_000_000), (7, 4_000_000, 50), (500, 60, 1_000_000), (500, 400, 1_000_000)])
def test_links(make, prose, monkeypatch, block, task, group):
    """In one block and in many, with whole ranges and with split ones."""
    monkeypatch.setattr(jaccard_join, "CLUSTER_BLOCK", block)
    monkeypatch.setattr(jaccard_join, "TASK_HASHES", task)
    monkeypatch.setattr(jaccard_join, "GROUP_HASHES", group)
    texts = [*prose(60, 7), *near(40, 1, 60, 3), *near(30, 2, 300, 12), *near(10, 3, 64, 1), "A b", "a B", "a b c", None, "\n"]
    got = jaccard_join.groups(make(texts))
    assert sorted(map(tuple, got.collect())) == brute_components(texts)


def test_ranges_of_huge_tables_fit_in_tasks():
    for n in (10**3, 10**7, 10**11):
        for band, (ranges, splits) in jaccard_join.plan_ranges({0: n, 3: n}, 8).items():
            size = jaccard_join.RANGE_HASHES << band
            assert n * size * 3 // 2 // (ranges * splits) <= 2 * jaccard_join.TASK_HASHES and size // ranges >= jaccard_join.LEAST_HASHES


def test_first_hashes_meet_in_a_split():
    import numpy as np

    rng = np.random.default_rng(4)
    for _ in range(300):
        x = np.unique(rng.integers(0, 500, 40))
        y = np.unique(np.append(rng.permutation(x)[: rng.integers(1, len(x) + 1)], rng.integers(0, 500, rng.integers(0, 6))))
        shared = len(np.intersect1d(x, y))
        if 100 * (shared + 1) >= 80 * (len(np.union1d(x, y)) + 1):
            a, b = jaccard_join.first_hashes(np.array([len(x), len(y)]), 80)
            assert len(np.intersect1d(x[:a], y[:b]))


def test_links_of_repeated_and_null_keys(make):
    a, b, c = (" ".join(f"{k}{i}" for i in range(20)) for k in "abc")
    got = sorted(map(str, jaccard_join.groups(make([a, b, b, c, c, a], ids=[1, 1, 2, 7, None, 9])).collect()))
    comp = {r.split("id=")[1].split(",")[0]: r.split("component_id=")[1].rstrip(")") for r in got}
    assert comp == {"1": "1", "2": "1", "7": "7", "9": "1", "None": "7"}
    assert jaccard_join.groups(make([])).count() == 0


def test_search_equals_all_pairs():
    import numpy as np

    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 25)).astype(np.uint64)) for _ in range(80)]
    sets += [np.unique(np.append(s[:-1], rng.integers(0, 60, 1).astype(np.uint64))) for s in sets[:40]]
    off = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    got = {(x, int(y)) for x, ys in jaccard_join.search(np.concatenate(sets), off) for y in ys}
    link = lambda i, j: 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))
    assert got == {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if link(i, j)}
    mask = np.zeros(len(sets), bool)
    mask[::7] = True
    some = {(x, int(y)) for x, ys in jaccard_join.search(np.concatenate(sets), off, queries=mask) for y in ys}
    assert some == {(i, j) for i in range(0, len(sets), 7) for j in range(len(sets)) if i != j and link(i, j)}


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)]
    root = {n: n for e in edges for n in e}
    for _ in range(500):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: r for n, r in root.items() if n != r}
