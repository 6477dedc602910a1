import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from siltstone.llm.packing import Packer, byte_level_encoder, pack

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_encoder_equals_library():
    t = Tokenizer.from_file(PATH)
    for text in ["", " ", "a  b\n\n c", "déjà vu ß 漢字 \U0001f600", "x" * 3000, "it's 12,345 <|endoftext|> ***", "a<|endoftext|>b", "<|endoftext|><|endoftext|>  <|endoftext|>", "x" + " " * 1_000_000 + "y", "\n" * 150_000, "ab" * 400_000, "\r\n\t tab", " nb sp"]:
        assert byte_level_encoder(PATH)(text).tolist() == t.encode(text, add_special_tokens=False).ids
    assert byte_level_encoder(PATH)("a<|endoftext|>b").tolist() == [64, 50256, 65]


def test_very_long_text(spark):
    texts = [" " * 1_000_000, "word " * 300_000, "a<|endoftext|>b"]
    out = pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), PATH).toPandas()
    t = Tokenizer.from_file(PATH)
    assert out.groupby("doc_id").length.sum().to_dict() == {i: len(t.encode(x, add_special_tokens=False).ids) + 1 for i, x in enumerate(texts)}


def test_every_id_in_one_piece(spark):
    rows = [(i, ("wörd %d " % i) * (i * 13 % 700), 1) for i in range(60)] + [(60, None, 1), (61, "", 2), (5, "again", 3), (None, "no id", 4)]
    out = pack(spark.createDataFrame(rows, "doc_id long, text string, length int").repartition(3), PATH, open_windows=4).toPandas()
    whole = {i: np.append(byte_level_encoder(PATH)(t or ""), np.uint32(0)) for i, t, _ in rows if i != 5}
    assert out.groupby("doc_id", dropna=False).length.sum().sum() == sum(len(byte_level_encoder(PATH)(t or "")) + 1 for _, t, _ in rows)
    for r in out[out.doc_id.notna() & (out.doc_id != 5)].itertuples():
        ids = whole[r.doc_id]
        assert r.doc_tokens == len(ids)
        assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].astype("<u4").tobytes())
    for _, w in out.groupby("sequence_id"):
        w = w.sort_values("offset")
        assert w.offset.tolist() == [0, *w.length.cumsum()[:-1]]
        n = w.length.sum()
        assert n == 1024 or n < 1024 and n & (n - 1) == 0


def test_packer_bounds_open_windows():
    p = Packer(16, 3, 0)
    rng = np.random.default_rng(1)
    got = 0
    for i in range(200):
        got += sum(x[2] for x in p.add(i, np.arange(rng.integers(1, 40), dtype="u4")))
        assert len(p.open) <= 3
    assert got + sum(x[2] for x in p.finish()) == sum(np.random.default_rng(1).integers(1, 40, 200))


def test_empty(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
