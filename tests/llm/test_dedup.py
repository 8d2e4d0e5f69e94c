import hashlib
import random
import re
from collections import Counter, defaultdict

from llm.conftest import ODD, sample
from repoloom.llm import minhash, suffix_dedup
from repoloom.llm.components import components


def order(rows):
    return sorted(rows, key=repr)


def removed_by_hand(rows):
    first = {}
    for doc_id, text in rows:
        raw = (text or "").encode()
        rank = -1 if doc_id is None else doc_id
        for i in range(len(raw) - 49):
            own = raw[i : i + 50]
            first[own] = min(first.get(own, rank), rank)
    out = []
    for doc_id, text in rows:
        raw = (text or "").encode()
        rank = -1 if doc_id is None else doc_id
        gone = bytearray(len(raw))
        for i in range(len(raw) - 49):
            if first[raw[i : i + 50]] < rank:
                gone[i : i + 50] = b"\1" * 50
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((doc_id, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return order(out)


def repeats(df):
    columns = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    return order(tuple(r) for r in suffix_dedup.remove_repeats(df).select(*columns).collect())


def overlapping(seed):
    rand = random.Random(seed)
    passage = "".join(rand.choice("abc é") for _ in range(300))
    rows = []
    for i in range(40):
        at = rand.randrange(250)
        ends = ["".join(rand.choice(x) for _ in range(rand.randrange(90))) for x in ("xyz", "ab")]
        rows.append((1000 + i, ends[0] + passage[at : at + rand.randrange(40, 200)] + ends[1]))
    return rows


def test_repeats_equal_brute_force(spark, documents):
    rows = [(r.doc_id, r.text) for r in sample(spark).collect()] + overlapping(1) + ODD
    rows += [(2000, "z" * 500), (2001, "z" * 49), (2002, "z" * 50), (2002, "z" * 50)]
    rows.append((3, rows[1][1]))  # another text under an id that is taken
    assert repeats(documents(rows)) == removed_by_hand(rows)


def test_repeats_meet_across_batches_and_blocks(documents, monkeypatch):
    rows = overlapping(2) + [(i, "a hot passage that every document holds, " * 3) for i in range(300)]
    monkeypatch.setattr(suffix_dedup, "BLOCK", 64)
    assert repeats(documents(rows, 30)) == removed_by_hand(rows)


def test_repeats_of_an_empty_table(documents):
    assert repeats(documents([])) == []


def shingles(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = [x for x in re.split(r"[\x20\x09-\x0D]+", low) if x]
    if not words:
        return set()
    if len(words) < 5:
        return {tuple(words)}
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def classes_by_hand(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for k, own in enumerate(sets):
        for x in own:
            holders[x].append(k)
    shared = Counter((a, b) for own in holders.values() for i, b in enumerate(own) for a in own[:i])
    for (a, b), n in shared.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            parent[root(a)] = root(b)
    rank = lambda x: -1 if x is None else x
    least = {}
    for k, (doc_id, _) in enumerate(rows):
        r = root(k)
        least[r] = doc_id if r not in least or rank(doc_id) < rank(least[r]) else least[r]
    out = []
    for k, (doc_id, _) in enumerate(rows):
        own = least[root(k)]
        out.append((doc_id, len(sets[k]), own, rank(own) == rank(doc_id)))
    return order(out)


def classes(df):
    return order(tuple(r) for r in minhash.near_duplicates(df).drop("row_key").collect())


def varied(seed, n=60, words=120, edits=9):
    rand = random.Random(seed)
    pool = [f"w{i}" for i in range(3000)]
    base = [rand.choice(pool) for _ in range(words)]
    rows = []
    for i in range(n):
        own = list(base)
        for _ in range(rand.randrange(edits)):
            own[rand.randrange(words)] = rand.choice(pool)
        rows.append((5000 + i, " ".join(own)))
    return rows


def test_classes_equal_brute_force(spark, documents):
    rows = [(r.doc_id, r.text) for r in sample(spark).collect()] + varied(1) + ODD
    rows.append((7000, rows[-20][1].upper().replace(" ", "\t\n")))
    assert classes(documents(rows)) == classes_by_hand(rows)


def test_chains_of_links(documents):
    # Neighbours are linked, the ends are far apart.
    words = [f"w{i}" for i in range(400)]
    rows = [(100 - i, " ".join(words[5 * i : 5 * i + 100])) for i in range(40)]
    got = classes(documents(rows))
    assert got == classes_by_hand(rows)
    assert {r[2] for r in got} == {61}


def test_clusters_of_unlinked_sets_are_compared_in_blocks(documents, monkeypatch):
    # All share more than half of their text; few are linked, and each of those pairs in another half.
    from pyspark.sql.pandas.group_ops import PandasCogroupedOps

    rand = random.Random(8)
    shared = [f"s{i}" for i in range(70)]
    rows = []
    for i in range(120):
        own = [f"u{rand.randrange(10**6)}" for _ in range(45)]
        rows.append((100 + i, " ".join(shared + own)))
        if i % 20 == 0:
            rows.append((900 + i, " ".join(shared + own[:40])))
    monkeypatch.setattr(minhash, "BLOCK_SETS", 16)
    largest, run = [], PandasCogroupedOps.applyInArrow

    def counted(self, *args):
        for group in (self._gd1, self._gd2):
            largest.append(max((r["count"] for r in group.count().collect()), default=0))
        return run(self, *args)

    monkeypatch.setattr(PandasCogroupedOps, "applyInArrow", counted)
    assert classes(documents(rows + rows[:1])) == classes_by_hand(rows + rows[:1])
    assert largest and max(largest) <= 3 * 16


def test_classes_of_an_empty_table(documents):
    assert classes(documents([])) == []


def test_words_of_long_texts_are_cut_at_any_block(monkeypatch):
    import numpy as np

    texts = ["ab cd  " * 50, "", "x" * 333, "é\tß\n" * 40, "end"]
    raw = [t.encode() for t in texts]
    borders = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    data = np.frombuffer(b"".join(raw), np.uint8)
    whole = minhash.word_names(data, borders)
    for block in (16, 50, 101):
        monkeypatch.setattr(minhash, "BLOCK", block)
        names, places = minhash.word_names(data, borders)
        assert (names == whole[0]).all() and (places == whole[1]).all()


def test_components(spark):
    rand = random.Random(4)
    edges = [(rand.randrange(300), rand.randrange(300)) for _ in range(200)] + [(1000, 1000 + i) for i in range(50)]
    edges += [(2000 + i, 2001 + i) for i in range(30)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    want = {(x, root(x)) for a, b in edges if a != b for x in (a, b)}
    got = [tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_recall_where_all_lines_are_common(spark, documents):
    """Documents of 40 out of 210 lines, so that unrelated ones head nearly all keys, and planted pairs."""
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(400)]
    lines = [" ".join(rng.choice(words) for _ in range(7)) for _ in range(210)]
    rows, planted = [], 60
    for i in range(3000):
        rows.append((1000 + i, "\n".join(rng.sample(lines, 40))))
    for i in range(planted):
        own = rows[rng.randrange(3000)][1].split("\n")
        for at in rng.sample(range(40), 3):
            own[at] = " ".join(rng.choice(words) for _ in range(7))
        rows.append((5000 + i, "\n".join(own)))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(documents(rows)).collect()}
    want = {r[0]: r[2] for r in classes_by_hand(rows)}
    linked = [i for i in want if i >= 5000 and want[i] != i]
    assert len(linked) > 0.8 * planted
    assert sum(got[i] == want[i] for i in linked) >= 0.99 * len(linked)
    assert all(got[i] == i for i in want if want[i] == i and i not in got.values())
