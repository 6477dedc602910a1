from collections import defaultdict

from pyspark.sql import functions as F

from siltstone.llm import linededup
from siltstone.llm.linededup import remove_boilerplate


def brute(rows, min_sites):
    sites, first = defaultdict(set), {}
    for k, t, s in rows:
        for i, line in enumerate((t or "").split("\n")):
            if line.strip(" "):
                sites[line.strip(" ")] |= {s} - {None}
                at = (k is not None, k or 0, i)
                first[line.strip(" ")] = min(first.get(line.strip(" "), at), at)
    out = []
    for k, t, _ in rows:
        if t is None:
            out.append((k, None, 0, 0))
            continue
        lines = t.split("\n")
        kept = [x for i, x in enumerate(lines) if not x.strip(" ") or len(sites[x.strip(" ")]) < min_sites or first[x.strip(" ")] == (k is not None, k or 0, i)]
        out.append((k, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def test_equals_brute_force(spark):
    rows = [(i, "\n".join(f"line {j}" for j in range(i % 7)) + ("\n cookie notice \n\nend" if i % 3 else "\ncookie notice"), f"s{i % 9}") for i in range(120)]
    rows += [(500, None, "s1"), (501, "", "s2"), (502, "cookie notice\ncookie notice", None), (None, "cookie notice\nmine", "s3"), (7, rows[7][1], "s7"), (503, "a\nb\n" * 5000 + "cookie notice", "s4")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, source string, site string")
    for least in (3, 9):
        got = remove_boilerplate(df, min_sites=least)
        assert got.columns[:4] == df.columns
        assert sorted(((r.doc_id, r.text, r.n_lines_, r.n_removed_) for r in got.collect()), key=str) == brute(rows, least)


def test_empty(spark):
    assert remove_boilerplate(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_exact_counts_are_for_near_lines_only(spark):
    lines = [(f"all {i}", s) for i in range(3) for s in range(60)] + [(f"near {i}", s) for i in range(5) for s in range(8 + i)] + [(f"few {i}", s) for i in range(40) for s in range(1 + i % 4)]
    docs = spark.createDataFrame([(j, text, f"s{s}") for j, (text, s) in enumerate(lines)], "doc_id long, text string, source string")
    rows = linededup._lines(docs, "doc_id", "text", "source")
    name = {(r.h1, r.h2): r.text for r in docs.join(rows.withColumnRenamed("k", "doc_id"), "doc_id").select("text", "h1", "h2").collect()}
    hits = linededup.occurrences(rows, 10, 0.2)
    assert {name[r.h1, r.h2][:3] for r in hits.collect()} == {"all", "nea"}
    near = {name[r.h1, r.h2]: r.n for r in linededup.near_counts(hits, 10, 0.2).collect()}
    assert near == {f"near {i}": 8 + i for i in range(5) if f"near {i}" in near} and 3 <= len(near) <= 5
    got = remove_boilerplate(docs).where("n_removed_ > 0").select(F.substring("text", 1, 1).alias("x"), "doc_id").collect()
    assert len(got) == 3 * 59 + (10 - 1) + (11 - 1) + (12 - 1) and all(r.x == "" for r in got)


def test_clashing_names(spark):
    rows = [(i, f"one line\nmine {i}", f"s{i}", 7, "a", "b") for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_lines_ int, __k string, ___gone string")
    got = remove_boilerplate(df)
    assert got.columns == [*df.columns, "n_removed_"]
    assert {(r["__k"], r["___gone"], r.n_lines_, r.n_removed_) for r in got.collect()} == {("a", "b", 2, 0), ("a", "b", 2, 1)}
