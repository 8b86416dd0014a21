import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.llm import chunks, token_counts, trie_bpe

TEXTS = [None, "", " \t", "Hello, World! it's 3.14", "a<|endoftext|>b <|startoftext|>", "é ́x", "y\x1cz \x85 \xa0 　q", "İ ß ΑΣ ﬁ ½ 日本語 ​", "the " * 3000, "q" * 3000, "don't DON'T 'S x'll"]


def test_counts_and_digests_equal_the_library(spark):
    rows = [(i if i else None, t, i) for i, t in enumerate(TEXTS)] + [(1, TEXTS[3], 0)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long")
    tok = chunks.LibraryEncoder(None).tok
    ids = [tok.encode(t or "", add_special_tokens=False).ids for _, t, _ in rows]
    got = token_counts.count_tokens(docs, limit=100).collect()
    key = lambda r: str(r)
    assert sorted(map(tuple, got), key=key) == sorted([(i, len((t or "").encode()), len(x), len(x) > 100) for (i, t, _), x in zip(rows, ids)], key=key)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = trie_bpe.encode_digest(docs, keep_ids=True).collect()
    want = [(i, len(x), sha(" ".join(map(str, x))), sha(tok.decode(x, skip_special_tokens=False)), x) for (i, _, _), x in zip(rows, ids)]
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert token_counts.count_tokens(docs.where("false")).count() == trie_bpe.encode_digest(docs.where("false")).count() == 0


_TRIE = trie_bpe._build(None)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=30), max_size=5))
def test_trie_equals_the_library_on_any_text(texts):
    tok = _TRIE.encoder.tok
    for t in texts:
        if any(0xD800 <= ord(c) < 0xE000 for c in t):
            continue
        ws = t.encode().split()
        _TRIE.learn([ws])
        found = [_TRIE[w] for w in ws if _TRIE[w][0]]
        assert [int(i) for v in found for i in v[1].split()] == tok.encode(t, add_special_tokens=False).ids
