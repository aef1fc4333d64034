import random
import re
from collections import Counter
from zlib import crc32

import pytest
from fixtures import driver_texts, no_docs, odd_docs, same
from hypothesis import given, settings
from hypothesis import strategies as st

from vacantia.llm import spelling


def near(a, b):
    """Whether one inserted, deleted or replaced code point parts a and b."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def forms_of(counts):
    """word, form, root, n, n_near and form_n by comparing all pairs."""
    best, number = {}, Counter()
    for w, n in counts.items():
        others = [(-counts[x], x) for x in counts if abs(len(x) - len(w)) < 2 and near(w, x)]
        number[w] = len(others)
        if others and -min(others)[0] >= 2 * n:
            best[w] = min(others)[1]

    def root(w):
        return root(best[w]) if w in best else w

    return [(w, best.get(w), root(w), n, number[w], counts.get(best.get(w))) for w, n in counts.items()]


def counted(rows, least_letters, least_count, noise=97):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = crc32(f"{'' if i is None else i}:{run}".encode())
            if h % noise == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= least_letters and n >= least_count}


def test_made_up_words(spark):
    """A crowded vocabulary: many words near each other, chains of forms, ties, letters beyond ASCII."""
    rng = random.Random(5)
    stems = ["".join(rng.choices("abcdeéÀß", k=rng.randint(4, 7))) for _ in range(60)]
    rows = []
    for i in range(300):
        words = []
        for _ in range(60):
            w = rng.choice(stems[: rng.randint(1, 60)])
            if rng.random() < 0.3:
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice("abcdé") + w[at:], w[:at] + "e" + w[at + 1 :], w.upper()])
            words.append(w)
        rows.append((i, rng.choice([" ", "-", "日", "×1"]).join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for letters, least, noise in ((5, 3, 97), (2, 2, 3)):
        want = forms_of(counted(rows, letters, least, noise))
        assert sum(r[1] is not None for r in want) > 100 and any(r[1] and r[2] != r[1] for r in want)
        same(spelling.spelling_variants(docs, letters, least, noise).collect(), want)


def test_driver_texts(spark):
    texts = driver_texts()
    want = counted(texts, 5, 3)
    got = spelling.spelling_variants(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {r.word: r.n for r in got} == want
    by = {r.word: r for r in got}
    for r in got[::40]:
        others = [x for x in want if abs(len(x) - len(r.word)) < 2 and near(x, r.word)]
        assert r.n_near == len(others)
        best = min(((-want[x], x) for x in others), default=(0, None))
        assert (r.form, r.form_n) == ((best[1], -best[0]) if others and -best[0] >= 2 * r.n else (None, None))
        assert r.root == (by[r.form].root if r.form else r.word)


def test_odd_rows(spark):
    docs = odd_docs(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    same(spelling.spelling_variants(docs, 2, 1, 2).collect(), forms_of(counted(rows, 2, 1, 2)))
    assert spelling.spelling_variants(no_docs(spark)).collect() == []


@pytest.mark.parametrize("long", [3, 256])
def test_long_words(spark, monkeypatch, long):
    """Hashed remainders give the same links as whole ones, also for very long runs of letters."""
    monkeypatch.setattr(spelling, "LONG", long)
    base = "ab" * 400 + "cde" * 50
    words = [base, base[1:], base[:500] + base[501:], base[:-1] + "z", base + "e", "x" + base, "a" * 700, "a" * 701, "a" * 300 + "b" + "a" * 400, "hello", "hallo", "halo", "hello" * 60]
    counts = {w: n for n, w in enumerate(words, 3)}
    rows = {}
    for w, n in counts.items():
        key = sum(spelling.POWERS[c] for c in w.encode("latin-1"))
        for c in (0, *set(w.encode("latin-1"))):
            rows.setdefault(key - (spelling.POWERS[c] if c else 0), []).append((c, w, n))
    number, best = Counter(), {}
    for held in rows.values():
        for w, (n, less, other) in spelling.linked(*map(list, zip(*held, strict=True))).items():
            number[w] += n
            best[w] = min(best.get(w, (0, "")), (less, other))
    for w in words:
        others = [(-counts[x], x) for x in words if near(w, x)]
        assert number[w] == len(others) and best.get(w) == (min(others) if others else None)


@settings(max_examples=80, deadline=None)
@given(st.sets(st.text(st.sampled_from("abcÀ"), min_size=1, max_size=5), max_size=40))
def test_letters_in_any_order(words):
    counts = {w: 1 + len(w) % 3 for w in words}
    rows = {}
    for w, n in counts.items():
        key = sum(spelling.POWERS[c] for c in w.encode("latin-1"))
        for c in (0, *set(w.encode("latin-1"))):
            rows.setdefault(key - (spelling.POWERS[c] if c else 0), []).append((c, w, n))
    number = Counter()
    for held in rows.values():
        for w, (n, _, _) in spelling.linked(*map(list, zip(*held, strict=True))).items():
            number[w] += n
    assert number == Counter({w: k for w in words if (k := sum(near(w, x) for x in words))})
