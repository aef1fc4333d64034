import random
import re

from fixtures import driver_texts, no_docs, odd_docs, same

from vacantia.llm import licenses

CASES = [
    "Released under the MIT License. Released UNDER-THE-mit\nlicense!",
    "under the mit licenses; apache license, version 2.0 and Apache License Version 2 apache license version",
    "CC BY-NC 4.0 cc by nc cc by nc nc",
    "under the mit under the mit license license",
    "This work is licensed under the GNU General Public License, version 3.",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "the license of this text is unknown",
]


def brute(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    at = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in at]
    return len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))


def plain(text, idf):
    """labels and score by trying every start that an anchor of a notice proposes, beside another anchor, one by one."""
    held = [w.decode() for w in licenses.words(text)]
    holds = lambda phrase: any(held[i : i + len(phrase)] == phrase for i in range(len(held)))
    base = {label for p, label in licenses.PHRASES.items() if holds(p.split())}
    labels, score = set(base), 1.0 if base else 0.0
    for label, (notice, keys) in licenses.NOTICES.items():
        own = notice.split()
        weights = [idf[w] for w in own]
        order = sorted(range(len(own)), key=lambda q: (-weights[q], q))
        n = next(n for n in range(1, len(own) + 1) if n == len(own) or sum(weights[q] for q in order[n:]) + weights[order[0]] < 0.6 * sum(weights) - 1e-9)
        proposed = {(i - q, q) for q in order[:n] for i, w in enumerate(held) if w == own[q]}
        best = 0.0
        for start, q in proposed:
            if any(p != q and abs(s - start) <= 4 for s, p in proposed):
                near = [any(held[i] == w for i in range(max(0, start + k - 4), min(len(held), start + k + 5))) for k, w in enumerate(own)]
                best = max(best, sum(x for x, hit in zip(weights, near, strict=True) if hit) / sum(weights))
        score = max(score, best)
        if best >= 0.6 and any(holds(k.split()) for k in keys):
            labels.add(label)
    return ",".join(sorted(labels)), min(score, 1.0)


def test_labels_and_scores(spark):
    rng = random.Random(4)
    notices = [t.split() for t, _ in licenses.NOTICES.values()]
    made = []
    for _ in range(120):  # notices with words lost, added and changed, several in a text, among other words
        out = []
        for own in rng.sample(notices, rng.randint(1, 4)):
            out += [w for w in own if rng.random() > 0.15] if rng.random() < 0.7 else own
            out += rng.choices(["the", "license", "of", "software", "word", "cc", "by", "public"], k=rng.randint(0, 12))
        made.append(" ".join(out))
    texts = [*driver_texts(120), *((5000 + i, t) for i, t in enumerate(CASES + made))]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    idf = licenses.idf_weights(df, sorted({w for t, keys in licenses.NOTICES.values() for x in (t, *keys) for w in x.split()} | {w for p in licenses.PHRASES for w in p.split()}))
    got = {r.doc_id: r for r in licenses.scan_licenses(df).collect()}
    want = {i: plain(t, idf) for i, t in texts}
    assert {i: r.labels for i, r in got.items()} == {i: w[0] for i, w in want.items()}
    assert all(abs(r.score - want[i][1]) < 1e-9 for i, r in got.items())
    assert sum(bool(w[0]) for i, w in want.items() if i >= 5000) > 60


def test_the_index_needs_two_anchors():
    index = licenses.Index(licenses.PHRASES, licenses.NOTICES)
    for t in index.templates:
        rest = sum(x for q, x in enumerate(t.idf) if q not in t.anchors)
        assert t.base and len(t.anchors) == 1 or len(t.anchors) > 1 and rest + max(t.idf) < 0.6 * sum(t.idf)
        assert all([at, q] in index.postings[t.ids[q]].tolist() for at, u in enumerate(index.templates) if u is t for q in t.anchors)


def test_notices_from_a_table(spark):
    table = spark.createDataFrame([("own", "may be used by friends of the house only", ["friends of the house"]), ("blank", " ", [])], "label string, text string, keys array<string>")
    docs = spark.createDataFrame([(1, "this may be used by friends of the house only"), (2, "friends of the house")], "doc_id long, text string")
    assert {r.doc_id: r.labels for r in licenses.scan_licenses(docs, notices=licenses.read_notices(table)).collect()} == {1: "own", 2: ""}


def test_base_columns(spark):
    texts = [*driver_texts(), *((900 + i, t) for i, t in enumerate(CASES))]
    rows = licenses.scan_licenses(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    same([r[:6] for r in rows], [(i, *brute(t)) for i, t in texts])
    for r in rows:
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1
    labels = {r.doc_id: r.labels for r in rows}
    assert labels[904] == "gpl-3" and labels[905] == "mit" and labels[906] == ""


def test_odd_rows(spark):
    docs = odd_docs(spark)
    rows = licenses.scan_licenses(docs).collect()
    same([r[:6] for r in rows], [(d.doc_id, *brute(d.text)) for d in docs.collect()])
    assert licenses.scan_licenses(no_docs(spark)).count() == 0


def test_frequencies_count_every_document(spark):
    docs = spark.createDataFrame([(i, "mit license mit" if i % 4 else "other") for i in range(40)], "doc_id long, text string")
    assert {r.word: r.n for r in licenses.frequencies(docs, ["mit", "license", "absent"]).collect()} == {"mit": 30, "license": 30, "": 40}


def test_templates_without_a_chance_are_left_out(monkeypatch):
    """The rarest words come first, and what can't beat them is not looked at: with the same results."""
    words = sorted({w for t, keys in licenses.NOTICES.values() for x in (t, *keys) for w in x.split()} | {w for p in licenses.PHRASES for w in p.split()})
    index = licenses.Index(licenses.PHRASES, licenses.NOTICES, {w: 1.0 + k % 7 for k, w in enumerate(words)})
    texts = [t for t, _ in licenses.NOTICES.values()]
    texts += [" ".join(a.split()[: len(a.split()) * 2 // 3] + b.split()[::2]) for a, b in zip(texts, texts[1:] + texts[:1], strict=True)]
    share, looked = licenses._share, []
    monkeypatch.setattr(licenses, "_share", lambda *args: looked.append(1) or share(*args))
    got = [licenses.scan_text(t, index) for t in texts]
    fewer = len(looked)
    monkeypatch.setattr(licenses.Template, "most", lambda self, by: 2.0)
    looked.clear()
    assert [licenses.scan_text(t, index) for t in texts] == got and fewer < len(looked) / 2
