from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.functions.stem_fr import stem
from siltstone.operators import corpus


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


def test_clean_keeps_paragraphs(spark):
    assert one(spark, " a\x01b\x0b\r\nc\rd\t \te\n\n\n\nf\x7f ", T.clean) == "ab\nc\nd e\n\nf"
    assert one(spark, None, T.clean) == "" and one(spark, " \n ", T.clean) == ""


def test_paragraphs_prefer_empty_lines(spark):
    assert one(spark, "a\nb\n\n c \n\n\nd", T.paragraphs) == ["a\nb", "c", "d"]
    assert one(spark, "a\nb\n\n", T.paragraphs) == ["a", "b"]


def test_long_paragraphs_are_split_at_blanks(spark):
    words = " ".join(["x" * 99] * 50)
    got = one(spark, words, T.paragraphs)
    assert " ".join(got) == words and max(map(len, got)) <= T.HARD_MAX and len(got) == 3
    assert one(spark, "y" * 5000, T.paragraphs) == ["y" * 5000]


def reference_chunks(pars):
    """The packing rule in plain Python."""
    out, cur = [], ""
    for p in pars:
        if cur and len(cur) + 1 + len(p) > T.CHUNK_SIZE:
            if len(cur) >= T.MIN_CHUNK:
                out.append(cur)
            tail = cur if len(cur) <= T.CHUNK_OVERLAP else cur[-T.CHUNK_OVERLAP :]
            if len(cur) > T.CHUNK_OVERLAP and any(c.isspace() for c in tail):
                i = next(i for i, c in enumerate(tail) if c.isspace())
                tail = tail[i:].lstrip() or tail
            cur = tail
        cur = f"{cur} {p}" if cur else p
    return out + [cur] if len(cur) >= T.MIN_CHUNK else out


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=0, max_size=40))
def test_chunks_follow_the_rule(spark, sizes):
    pars = [" ".join(f"w{i}" for i in range(n)) * 3 for n in sizes]
    got = spark.createDataFrame([(pars,)], "p array<string>").select(T.pack_chunks(F.col("p")).alias("c")).first().c
    assert got == reference_chunks(pars)


def test_dropped_chunk_still_seeds_the_overlap(spark):
    short, long = "a" * 60, "b" * 1790
    assert spark.createDataFrame([([short, long],)], "p array<string>").select(T.pack_chunks(F.col("p")).alias("c")).first().c == [f"{short} {long}"]


def test_chunk_ids(spark):
    df = spark.createDataFrame([("d1", "x " * 3000), ("d2", ""), ("d3", "short")], "doc_id string, text string")
    got = corpus.chunks(df).collect()
    assert {r.doc_id for r in got} == {"d1"} and [r.chunk_id for r in sorted(got, key=lambda r: r.chunk_index)] == [f"d1-{i}" for i in range(len(got))]
    assert all(r.total_chunks == len(got) for r in got)


def test_overlap_tail(spark):
    assert one(spark, "alpha beta gamma delta", lambda c: T.overlap_tail(c, 8)) == "delta"
    assert one(spark, "nospacesatall", lambda c: T.overlap_tail(c, 5)) == "atall"
    assert one(spark, "abc", lambda c: T.overlap_tail(c, 8)) == "abc"


def test_query_expansion(spark):
    got = one(spark, "Préavis de LICENCIEMENT pendant la grève ?", T.expand_query)
    assert got.endswith("? congediement preavis indemnite licenciement droit de greve service minimum")
    assert one(spark, "sans rapport", T.expand_query) == "sans rapport"
    long = one(spark, "licenciement faute grave periode essai harcelement", T.expand_query)
    assert long.endswith("duree maximale essai") and "atteinte dignite" not in long


def test_prefix_once(spark):
    assert one(spark, "Query: x", lambda c: T.with_prefix(c, "query: ")) == "Query: x"
    assert one(spark, "x", lambda c: T.with_prefix(c, "query: ")) == "query: x"


def test_mojibake(spark):
    for bad, good in (("cafÃ©", "café"), ("lâ€™Ã©tÃ©", "l’été"), ("café", "café"), ("Ã", "Ã"), ("", "")):
        assert one(spark, bad, T.repair_mojibake) == good


def test_preview_and_tokens(spark):
    assert one(spark, " a \n b\t", T.preview) == "a b"
    assert len(one(spark, "x" * 300, T.preview)) == 240 and one(spark, "x" * 300, T.preview).endswith("…")
    assert one(spark, "L'été, déjà_vu!", T.token_count) == 6


def test_stemmer_on_published_samples():
    for w, s in {"continuellement": "continuel", "contradictoirement": "contradictoir", "majestueusement": "majestu", "maintenant": "mainten", "majorité": "major", "continuité": "continu", "contractés": "contract", "mairie": "mair"}.items():
        assert stem(w) == s


def test_context_budget_is_monotone(spark):
    d = spark.createDataFrame([(128_000,), (8_192,), (1_000,)], "w int").select(T.context_budget(F.col("w")).alias("b"))
    assert [r.b for r in d.collect()] == [89_600, 5_734, 1_024]


def test_strip_and_clean_are_as_their_patterns(spark):
    """Without patterns over every character: the same texts."""
    blanks = [chr(c) for c in range(0x3001) if one_blank(chr(c))]
    assert set(blanks) == set(T.BLANKS)
    texts = [(b + "a" + b + "b" + b * 2,) for b in blanks] + [("​ a ﻿",), (" \t",), ("a \t b  c\td e\r\r\nf\n\r\n\n\ng",), (None,)]
    df = spark.createDataFrame(texts, "x string")
    x = F.regexp_replace(F.regexp_replace(F.regexp_replace("x", r"[\x01-\x08\x0b\x0c\x0e-\x1f\x7f]", ""), r"\r\n|\r", "\n"), r"[ \t]+", " ")
    old = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    rows = df.select(T.strip(F.col("x")), old("x"), T.clean(F.col("x")), F.coalesce(old(F.regexp_replace(x, r"\n{3,}", "\n\n")), F.lit(""))).collect()
    assert all(r[0] == r[1] and r[2] == r[3] for r in rows)


def one_blank(c):
    return c.isspace() and not 0x1C <= ord(c) <= 0x1F
