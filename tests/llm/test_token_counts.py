import public_tokenizers
from fixtures import driver_texts, no_docs, odd_docs, same
from hypothesis import given, settings
from hypothesis import strategies as st

from vacantia.llm import token_counts

BY = token_counts.counter(public_tokenizers.path("piece_bpe_32k.model"))


def brute(token):
    """Tokens of the best segmentation, word by word: most score, then fewest tokens."""
    best = [(0, 0)]
    for end in range(1, len(token) + 1):
        n = len(token[end - 1].encode("utf-8", "surrogatepass"))
        ways = [(best[end - 1][0] + n * BY.byte_score, best[end - 1][1] - n)]
        ways += [(best[at][0] + BY.scores[token[at:end]], best[at][1] - 1) for at in range(end) if token[at:end] in BY.scores]
        best.append(max(ways))
    return -best[-1][1]


def expected(texts):
    words = {i: token_counts.split_words(t) for i, t in texts}
    return [(i, len(w), sum(brute(token_counts.MARK + x) for x in w)) for i, w in words.items()]


def test_driver_texts(spark):
    texts = driver_texts(60)
    same(token_counts.token_counts(spark.createDataFrame(texts, "doc_id long, text string")).collect(), expected(texts))


def test_given_scores(spark):
    docs = spark.createDataFrame([(1, "abab ab x")], "doc_id long, text string")
    scores = {"▁": -1, "a": -5, "b": -5, "ab": -3, "▁abab": -8, "▁ab": -4}
    # ▁ab + ab (7) beats ▁abab (8); ▁ab (4) ties with ▁ + ab and has fewer tokens; x is one byte behind ▁.
    assert [tuple(r) for r in token_counts.token_counts(docs, scores=scores).collect()] == [(1, 3, 2 + 1 + 2)]


def test_odd_rows(spark):
    docs = odd_docs(spark)
    texts = [(i, r.text) for i, r in enumerate(docs.collect())]
    want = expected(texts)
    got = token_counts.token_counts(docs).collect()
    same([r[1:] for r in got], [w[1:] for w in want])
    assert token_counts.token_counts(no_docs(spark)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("▁aeintrs ab日🎉\x00"), min_size=1, max_size=12), max_size=12))
def test_shared_prefixes(words):
    tokens = sorted(set(words))
    assert BY.count_sorted(tokens) == [brute(t) for t in tokens]
