"""The pipeline's stages against brute force on a small corpus, and its queries against their contracts."""

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from siltstone.llm.packing import byte_level_encoder
from siltstone.llm.queries import QUERIES
from tests.llm import test_linededup, test_neardup, test_suffixes


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = np.random.default_rng(21)
    vocab = {"en": [f"the{c}ing" for c in "abcdefghij"] + ["of", "and", "word"], "fr": [f"é{c}tion" for c in "abcdefghij"] + ["où", "ça", "être"]}
    text = lambda g, n: " ".join(rng.choice(vocab[g], n))
    rows, passage = [], text("en", 60)
    for i in range(90):
        g = "fr" if i % 3 == 0 else "en"
        body = "\n".join(text(g, int(rng.integers(5, 60))) for _ in range(int(rng.integers(1, 4))))
        if i % 4 == 0:
            body += "\ncookie notice of the site"
        if i % 7 == 0:
            body += f"\n{text(g, 3)} {passage} {text(g, 3)}"
        rows.append((i, body, g, f"s{i % 15}", len(body)))
    rows += [(90, rows[1][1], "en", "s1", 1), (91, rows[2][1] + " tail", "en", "s2", 1), (92, None, "en", "s1", 0), (93, "", None, "s1", 0), (94, "12 ... 34", "en", None, 1), (95, rows[2][1], None, None, 1)]
    path = tmp_path_factory.mktemp("corpus")
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{path}/documents.parquet")
    return str(path), df


def test_stages(spark, corpus, tmp_path):
    sf_dir, docs = corpus
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        out[name] = docs.collect()
        if name != "packing":
            assert docs.columns == corpus_pipeline.COLUMNS
            assert all(r.n_chars == len(r.text) for r in out[name])
    pairs = lambda name: [(r.doc_id, r.text) for r in out[name]]
    assert {r.doc_id for r in out["language_id"]} == set(range(92)) | {95}
    kept = test_linededup.brute([(r.doc_id, r.text, r.source) for r in out["language_id"]], 10)
    assert sorted(pairs("line_dedup")) == sorted((k, t) for k, t, _, _ in kept) and any(r[3] for r in kept)
    classes = dict(test_neardup.brute(pairs("line_dedup")))
    assert {r.doc_id for r in out["near_dedup"]} == {c for c in classes.values()} and len(set(classes.values())) < len(classes)
    assert set(pairs("near_dedup")) <= set(pairs("line_dedup"))
    sizes = {k: n - gone for k, n, gone, _, _ in test_suffixes.brute(pairs("near_dedup"))}
    assert {r.doc_id: len(r.text.encode()) for r in out["suffix_dedup"]} == pytest.approx(sizes, abs=4) and sum(sizes.values()) < sum(len(t.encode()) for _, t in pairs("near_dedup"))
    encode = byte_level_encoder(public_tokenizers.path("byte_bpe_50k.json"))
    tokens = {}
    for r in out["packing"]:
        tokens[r.doc_id] = tokens.get(r.doc_id, 0) + r.length
    assert tokens == {r.doc_id: len(encode(r.text)) + 1 for r in out["suffix_dedup"]}
    last = {(r.doc_id, r.start, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert {x[0] for x in last} == set(tokens)


def test_language_stage_rejects_what_is_no_learned_language(spark, corpus):
    rng = np.random.default_rng(3)
    rand = lambda letters, n: "".join(rng.choice(list(letters), n))
    junk = {"letters": "qxzjkvwbpmyu  ", "cyrillic": "абвгдежзийклмнопрстуфхцчшщ    ", "greek": "αβγδεζηθικλμνξοπρστυφχψω   ", "han": [chr(c) for c in range(0x4E00, 0x5E00)], "symbols": "!@#$%^&*<>/|xq"}
    odd = [(1000 + 10 * i + j, rand(a, 300), None, name, 300) for i, (name, a) in enumerate(junk.items()) for j in range(5)]
    short = [(2000, "the", None, "s", 3), (2001, "theaing of", None, "s", 10), (2002, "être", None, "s", 4)]
    docs = corpus[1].unionByName(spark.createDataFrame(odd + short, corpus[1].schema))
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, docs, corpus[0]).collect()}
    assert not kept & {r[0] for r in odd} and kept >= {r[0] for r in short} | set(range(92))


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
    assert docs.count() == 0


CONTRACTS = {
    "op1_fingerprints": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    "op2_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op3_warc": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
    "op4_nearest": ["query_id", "rank", "vec_id", "score"],
    "op5_suffix_dedup": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op6_line_dedup": ["doc_id", "n_lines", "n_removed", "kept_sha256"],
    "op7_near_duplicates": ["doc_id", "class_id"],
    "op8_sentencepiece": ["doc_id", "n_tokens", "ids_crc32", "decoded_chars", "decoded_sha256"],
    "op9_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op10_packing": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    "op11_centroids": ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
    "op12_conversations": ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"],
    "op13_near_vectors": ["vec_id", "n_links", "component_id", "kept"],
}


def test_every_query_has_its_columns():
    assert sorted(QUERIES) == sorted(CONTRACTS)


@pytest.mark.parametrize("name", ["op1_fingerprints", "op2_language_id", "op5_suffix_dedup", "op6_line_dedup", "op7_near_duplicates", "op8_sentencepiece", "op10_packing"])
def test_queries_on_the_corpus(spark, corpus, name):
    out = QUERIES[name](spark, corpus[0])
    assert out.columns == CONTRACTS[name]
    assert {r.doc_id for r in out.select("doc_id").collect()} == set(range(96))
