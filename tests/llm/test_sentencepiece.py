import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from siltstone.llm import sentencepiece as sp

MODEL = sp.load(public_tokenizers.path("piece_bpe_32k.model"))


def small_model():
    pieces = ["▁", "▁▁", "a", "b", "ab", "ba", "▁a", "▁ab", "abba", "é", "aé"]
    table = {p.encode(): i + 256 for i, p in enumerate(pieces)}
    scores = np.concatenate([np.zeros(256), -np.array([3.0, 4.5, 2, 2, 2.5, 2.7, 3.1, 3.3, 4.1, 5, 6])])
    return sp.make(table, scores, np.arange(256, dtype=np.int32), [bytes([i]) for i in range(256)] + [p.replace("▁", " ").encode() for p in pieces]), dict(zip(pieces, scores[256:], strict=True))


def brute(unit, scores, unknown):
    """Best score over all segmentations of a short unit."""
    best = {0: 0.0}
    for i in range(len(unit)):
        for j in range(i + 1, len(unit) + 1):
            if unit[i:j] in scores:
                best[j] = max(best.get(j, -1e18), best[i] + scores[unit[i:j]])
        if unit[i] not in scores:
            best[i + 1] = max(best.get(i + 1, -1e18), best[i] + unknown)
    return best[len(unit)]


@settings(max_examples=150, deadline=None)
@given(st.text("ab éx ", min_size=1, max_size=12))
def test_viterbi_is_optimal(text):
    m, scores = small_model()
    unit = " " + text.replace(" ", "") if text.strip() else " "
    for ids in (sp.viterbi_long(unit, m), sp.viterbi_short([unit, "ab"], m)[0].tolist()):
        total, at = 0.0, 0
        while at < len(ids):
            if ids[at] >= 256:
                total, at = total + m.scores[ids[at]], at + 1
            else:
                n = 1 if ids[at] < 128 else 2
                total, at = total + m.unknown, at + n
        assert abs(total - brute(unit.replace(" ", "▁"), scores, m.unknown)) < 1e-9


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(min_size=0, max_size=80), min_size=1, max_size=4))
def test_round_trip_and_both_loops(texts):
    ids = sp.Encoder(MODEL).encode(texts)
    data = np.frombuffer(b"".join(MODEL.text), np.uint8)
    starts = np.concatenate([[0], np.cumsum([len(t) for t in MODEL.text])]).astype(np.int64)
    assert [sp.decode_ids(i, data, starts) for i in ids] == texts
    for t, got in zip(texts, ids, strict=True):
        assert got.tolist() == [i for u in sp.UNIT.findall(" " + t if t else "") for i in sp.viterbi_long(u, MODEL)]


def test_trie_holds_exactly_the_pieces():
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    t = MODEL.trie
    for i in range(259, p.vocab_size(), 7):
        node = 0
        for c in p.id_to_piece(i).encode():
            child = t.base[node] + c
            assert t.check[child] == node
            node = child
        assert t.value[node] == i
    assert (t.value >= 0).sum() == p.vocab_size() - 259


def test_frames(spark):
    rows = [(1, None), (2, ""), (3, " lead and  trail "), (3, " lead and  trail "), (None, "▁ literal 漢字\n\t"), (5, "x" * 30_000), (6, "long words " * 20_000)]
    df = spark.createDataFrame([(a, b, 0) for a, b in rows], "doc_id long, text string, ids int")
    out = sp.decode(sp.encode(df, MODEL), MODEL).collect()
    assert sorted(((r.doc_id, r.text) for r in out), key=str) == sorted(((a, b or "") for a, b in rows), key=str)
    assert {r.n_tokens for r in out if r.doc_id in (1, 2)} == {0}
    assert sp.encode(df.limit(0), MODEL).count() == 0
