import random
import re

from fixtures import driver_texts, no_docs, odd_docs, same

from vacantia.llm import components, neardup


def brute(texts, words, percent):
    """doc_id, set size and least reachable id, for distinct ids."""
    sets = {}
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m.group().lower(), t or ""))
        k = min(words, len(w))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(i for i in sets if sets[i])
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [(i, len(s), find(i), find(i) == i) for i, s in sets.items()]


def check(spark, texts, words=2, percent=80, exact=False):
    got = neardup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), words, percent, exact=exact).collect()
    same(got, brute(texts, words, percent))


def test_the_exact_way(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 50)
    check(spark, [*driver_texts(200), (9001, None), (9002, "a b"), (9003, "A  b"), (9004, "x")], exact=True)
    check(spark, crowd(120, 60, random.Random(13), 300, 247, 26), words=1, exact=True)
    docs = odd_docs(spark)
    same(neardup.near_duplicates(docs, exact=True).collect(), neardup.near_duplicates(docs).collect())
    assert neardup.near_duplicates(no_docs(spark), exact=True).count() == 0


def test_driver_texts(spark):
    check(spark, driver_texts(200))


def test_chains_copies_and_dense_groups(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [rng.choice(vocabulary) for _ in range(120)]
    texts = []
    for k in range(60):  # one template, each with own changes: pairs on either side of the threshold
        t = base[:]
        for _ in range(rng.randrange(1, 14)):
            t[rng.randrange(len(t))] = rng.choice(vocabulary)
        texts.append((len(texts), " ".join(t)))
    t = [rng.choice(vocabulary) for _ in range(150)]
    for k in range(12):  # a chain: neighbours are linked, ends are not
        t = t[:]
        for _ in range(6):
            t[rng.randrange(len(t))] = f"new{rng.random()}"
        texts.append((len(texts), " ".join(t)))
    texts += [(len(texts) + k, "exactly the same words in every copy of this text") for k in range(30)]
    texts += [(500 + k, t) for k, t in enumerate(["Hello", "hello", "HELLO there", "", None, " ", "a b c", "A  B\tC"])]
    check(spark, texts)
    check(spark, texts, words=5)


def crowd(strangers, partners, rng, pool=300, held=170, changed=18):
    """Texts of `held` words of one pool, each word in its own place, and partners of some that exchange a few."""
    sets = [set(rng.sample(range(pool), held)) for _ in range(strangers)]
    for k in range(partners):
        others = sorted(set(range(pool)) - sets[k])
        sets.append(sets[k] - set(rng.sample(sorted(sets[k]), changed)) | set(rng.sample(others, changed)))
    return [(i, " ".join(f"w{x}" for x in sorted(t))) for i, t in enumerate(sets)]


def test_windows_full_of_strangers(spark, monkeypatch):
    # Strangers are 0.4 alike, so that signatures rule them out; some partners stand further off than a window, here the narrowest.
    monkeypatch.setattr(neardup, "NEIGHBOURS", 1)
    check(spark, crowd(900, 300, random.Random(11)), words=1)


def test_dense_regions_have_no_window(spark, monkeypatch):
    # Strangers are 0.7 alike, which signatures do not rule out; no setting of a window decides which partners are met.
    for name, rows in (("NEIGHBOURS", 1), ("WIDE", 2), ("BLOCK", 40)):
        monkeypatch.setattr(neardup, name, rows, raising=False)
    check(spark, crowd(500, 200, random.Random(12), 300, 247, 26), words=1)


def test_odd_rows(spark):
    docs = odd_docs(spark)
    got = neardup.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert [r.component_id for r in by[7]] == [1, 1] and not any(r.kept for r in by[7])
    assert all(by[i][0].n_shingles == 0 and by[i][0].component_id == i and by[i][0].kept for i in (2, 3, 4))
    assert by[5][0].n_shingles == 1 and by[None][0].component_id is None
    assert neardup.near_duplicates(no_docs(spark)).count() == 0


def test_stage_keeps_one_of_each_group(spark):
    docs = odd_docs(spark)
    kept = neardup.neardup_stage(spark, docs, "")
    assert kept.columns == docs.columns
    same([(r.doc_id,) for r in kept.collect()], [(i,) for i in (1, 2, 3, 4, 5, 6, 8, None, 9)])
    only_copies = spark.createDataFrame([(4, "a b c d e f g")] * 3 + [(None, "a b c d e f g")], "doc_id long, text string")
    assert [tuple(r) for r in neardup.neardup_stage(spark, only_copies, "").collect()] == [(4, "a b c d e f g")]
    assert neardup.neardup_stage(spark, no_docs(spark), "").count() == 0
    # Texts without words are linked with nothing, whatever their ids: all rows stay.
    blank = spark.createDataFrame([(None, None), (None, None), (None, ""), (3, ""), (3, ""), (3, " \n")], "doc_id long, text string")
    same(neardup.neardup_stage(spark, blank, "").collect(), blank.collect())


def test_components_of_random_graphs(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(400, 440)] + [(500, i) for i in range(501, 560)] + [(7, 7), (None, 3)]
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    for limit in (0, 10**6):  # by stars, and by one task
        got = components.components(spark.createDataFrame(edges, "a long, b long"), local_edges=limit).collect()
        same(got, [(i, find(i)) for i in list(root)])
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_any_whole_number_is_an_id(spark):
    low = -(1 << 63)
    texts = [(low, "a b c"), (5, "a b c"), (0, "x y z"), (None, "x y z"), (None, "p q r"), (None, "p q r"), (-1, ""), (low + 1, "only me")]
    got = neardup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), 2).collect()
    want = [(low, 2, low, True), (5, 2, low, False), (0, 2, 0, True), (None, 2, 0, False), (None, 2, None, True), (None, 2, None, True), (-1, 0, -1, True), (low + 1, 1, low + 1, True)]
    same(got, want)


def test_ends_of_pairs_come_once(spark):
    pairs = spark.createDataFrame([(b"a", b"b", 0), (b"a", b"c", 0), (b"b", b"c", 6)], "a binary, b binary, tree int")
    assert sorted(bytes(r.node) for r in neardup.ends_of(pairs).collect()) == [b"a", b"b", b"c"]
    by_tree = neardup.ends_of(pairs, "tree")
    assert sorted((bytes(r.node), r.tree) for r in by_tree.collect()) == [(b"a", 0), (b"b", 0), (b"b", 6), (b"c", 0), (b"c", 6)]
    # Neither side's pairs are doubled: what is made of them are ends that differ.
    assert "Generate" not in by_tree._jdf.queryExecution().optimizedPlan().toString()
