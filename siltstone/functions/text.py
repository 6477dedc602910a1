"""Text functions as Column expressions: all of them run inside Catalyst."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters of a chunk, of its overlap, of the least chunk and of the largest.
CHUNK_SIZE, CHUNK_OVERLAP, MIN_CHUNK, HARD_MAX = 1800, 200, 100, 2200
# What the three tokenizers and counters of the corpus format count as a token.
METRIC_TOKEN = "[a-zàâäéèêëîïôöùûüç]+"
SPARSE_TOKEN = r"(?U)\b\w\w+\b"
COUNT_TOKEN = r"(?U)\w+|[^\w\s]"
CITATION = r"\[Source\s+(\d+)\]"
LIGHT_TOKEN = "[a-zàâäéèêëîïôùûüÿœæ0-9]+"
# Trigger phrases of a question and the terms they add.
EXPANSIONS = {
    "licenciement": ["congediement", "preavis", "indemnite licenciement"],
    "faute grave": ["cause valable", "manquement grave", "rupture immediate"],
    "periode essai": ["renouvellement essai", "duree maximale essai"],
    "harcelement": ["harcelement moral", "atteinte dignite", "sante mentale"],
    "conges payes": ["indemnite compensatrice", "conge annuel"],
    "salaire minimum": ["salaire minima", "minimum legal"],
    "permis travail": ["autorisation embauchage", "travailleur etranger"],
    "temps partiel": ["duree hebdomadaire", "heures complementaires"],
    "greve": ["droit de greve", "service minimum"],
    "cdd": ["contrat duree determinee", "requalification cdi"],
}
MOST_EXPANSIONS = 8
# French month names, without accents.
MONTHS = ["janvier", "fevrier", "mars", "avril", "mai", "juin", "juillet", "aout", "septembre", "octobre", "novembre", "decembre"]
# Character sequences that betray UTF-8 read as a one-byte encoding.
MOJIBAKE = ["Ã", "Â", "â€™", "â€œ", "â€"]
# What Unicode calls white space.
BLANKS = "".join(map(chr, (*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often body uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def strip(c: Column) -> Column:
    """Without leading and trailing white space of any kind."""
    return F.trim(c, F.lit(BLANKS))


def clean(c: Column) -> Column:
    """Control characters dropped, line ends unified, blanks and empty lines collapsed, stripped."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), r"[\x01-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    c = F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    c = F.regexp_replace(c, r"[ \t]{2,}|\t", " ")  # a single blank stays as it is
    return strip(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def _parts(c: Column, pattern: str) -> Column:
    return F.filter(F.transform(F.split(c, pattern), strip), lambda x: x != "")


def segments(par: Column) -> Column:
    """A paragraph over the hard limit as word-packed segments, any other as itself."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"), F.lit(0).alias("n"))

    def step(a: Column, w: Column) -> Column:
        full = (a.n + F.length(w) + 1 > HARD_MAX) & (a.n > 0)
        return F.struct(
            F.when(full, F.concat(a.done, F.array(a.cur))).otherwise(a.done).alias("done"),
            F.when(full | (a.n == 0), w).otherwise(F.concat(a.cur, F.lit(" "), w)).alias("cur"),
            (F.when(full, F.lit(0)).otherwise(a.n) + F.length(w) + 1).alias("n"),
        )

    packed = F.aggregate(F.split(par, " "), start, step, lambda a: F.concat(a.done, F.array(a.cur)))
    return F.when(F.length(par) <= HARD_MAX, F.array(par)).otherwise(packed)


def paragraphs(cleaned: Column) -> Column:
    """Paragraphs between empty lines, or lines if there is one paragraph at most; none over the hard limit."""
    split = let(cleaned, lambda c: let(_parts(c, r"\n{2,}"), lambda wide: F.when(F.size(wide) > 1, wide).otherwise(_parts(c, "\n"))))
    return F.flatten(F.transform(split, segments))


def overlap_tail(c: Column, limit: int = CHUNK_OVERLAP) -> Column:
    """The last `limit` characters from the first word boundary on."""
    tail = F.right(c, F.lit(limit))
    safe = let(F.regexp_replace(tail, r"(?U)^\S*\s+", ""), lambda s: F.when(s == "", tail).otherwise(s))
    return F.when(F.length(c) <= limit, c).otherwise(safe)


def pack_chunks(pars: Column) -> Column:
    """Paragraphs packed greedily into overlapping chunks; chunks under the minimum still seed the overlap.

    The fold carries the length of the open chunk, so a paragraph that fits costs one concatenation and no pattern.
    """
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"), F.lit(0).alias("n"))

    def emit(done: Column, text: Column) -> Column:
        return F.when(F.length(text) >= MIN_CHUNK, F.concat(done, F.array(text))).otherwise(done)

    def state(done: Column, cur: Column, n: Column) -> Column:
        return F.struct(done.alias("done"), cur.alias("cur"), n.alias("n"))

    def closed(a: Column, p: Column) -> Column:
        seeded = lambda text: let(overlap_tail(text), lambda seed: F.when(seed == "", p).otherwise(F.concat(seed, F.lit(" "), p)))
        return let(strip(a.cur), lambda text: let(seeded(text), lambda cur: state(emit(a.done, text), cur, F.length(cur))))

    def step(a: Column, p: Column) -> Column:
        full = (a.n + F.length(p) + 1 > CHUNK_SIZE) & (a.n > 0)
        grown = F.when(a.n == 0, state(a.done, p, F.length(p))).otherwise(state(a.done, F.concat(a.cur, F.lit(" "), p), a.n + 1 + F.length(p)))
        return F.when(full, closed(a, p)).otherwise(grown)

    return F.aggregate(pars, start, step, lambda a: F.when(a.n == 0, a.done).otherwise(let(strip(a.cur), lambda text: emit(a.done, text))))


def _plain_letters() -> tuple[str, str]:
    """Accented lower-case Latin letters and the letters that their canonical decomposition starts with."""
    pairs = []
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        base, *marks = unicodedata.normalize("NFD", chr(code))
        if marks and base.isascii() and chr(code).islower():
            pairs.append((chr(code), base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _plain_letters()


def fold_accents(c: Column) -> Column:
    """Lower case without accents, composed or as combining marks; ligatures and ß stay."""
    return F.regexp_replace(F.translate(F.lower(c), ACCENTED, PLAIN), r"[\u0300-\u036f]+", "")


def light_tokens(c: Column) -> Column:
    """Letters of French and digits, two characters or more."""
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(LIGHT_TOKEN), 0), lambda x: F.length(x) >= 2)


def metric_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(f"({METRIC_TOKEN})"), 1)


def sparse_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(SPARSE_TOKEN), 0)


def token_count(c: Column) -> Column:
    """Words plus punctuation marks: the approximate token count of a prompt."""
    return F.size(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(COUNT_TOKEN), 0))


def expand_query(question: Column, rules: dict[str, list[str]] | None = None) -> Column:
    """The question followed by at most eight distinct terms of all triggers that it contains."""
    rules = EXPANSIONS if rules is None else rules
    folded = fold_accents(question)
    hits = F.concat(*[F.when(folded.contains(t), F.array(*map(F.lit, terms))).otherwise(F.array().cast("array<string>")) for t, terms in rules.items()])
    terms = F.slice(F.array_distinct(hits), 1, MOST_EXPANSIONS)
    return F.when(F.size(terms) == 0, question).otherwise(F.concat(question, F.lit(" "), F.array_join(terms, " ")))


def with_prefix(c: Column, prefix: str) -> Column:
    """The embedding prefix once, whatever its case in the text."""
    return F.when(F.lower(c).startswith(prefix.lower()), c).otherwise(F.concat(F.lit(prefix), c))


def preview(c: Column, limit: int = 240) -> Column:
    """White space collapsed; longer texts end in an ellipsis within the limit."""
    flat = strip(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))
    return F.when(F.length(flat) > limit, F.concat(F.left(flat, F.lit(limit - 1)), F.lit("…"))).otherwise(flat)


def citations(answer: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(CITATION), 1), lambda x: x.cast("long"))


def without_citations(answer: Column) -> Column:
    return strip(F.regexp_replace(answer, r"\s*" + CITATION, ""))


def parse_date(raw: Column) -> Column:
    """dd/mm/yyyy or a written French date as ISO; else the first four digits; else the text itself."""
    raw = strip(F.coalesce(raw, F.lit("")))
    d = lambda p, i, c=raw: F.regexp_extract(c, p, i)
    slash, words = r"(\d{1,2})/(\d{1,2})/(\d{4})", r"(\d{1,2})\s+(\w+)\s+(\d{4})"
    plain = F.translate(F.lower(raw), "éèêûôà", "eeeuoa")
    month = F.greatest(F.array_position(F.array(*map(F.lit, MONTHS)), d(words, 2, plain)), F.lit(1))
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return (
        F.when(d(slash, 3) != "", F.concat_ws("-", d(slash, 3), two(d(slash, 2)), two(d(slash, 1))))
        .when(d(words, 3, plain) != "", F.concat_ws("-", d(words, 3, plain), two(month), two(d(words, 1, plain))))
        .when(d(r"(\d{4})", 1) != "", d(r"(\d{4})", 1))
        .otherwise(raw)
    )


# Characters of the Windows superset of Latin-1, and the bytes that they stand for.
WINDOWS = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
WINDOWS_BYTES = "\x80\x82\x83\x84\x85\x86\x87\x88\x89\x8a\x8b\x8c\x8e\x91\x92\x93\x94\x95\x96\x97\x98\x99\x9a\x9b\x9c\x9e\x9f"


def mojibake_score(c: Column) -> Column:
    return sum((F.size(F.split(c, m)) - 1 for m in MOJIBAKE), F.lit(0))


def repair_mojibake(c: Column) -> Column:
    """UTF-8 that was read as Latin-1 or its Windows superset, read right if that lowers the score."""
    latin = F.translate(c, WINDOWS, WINDOWS_BYTES)
    fits = ~latin.rlike(r"[^\x00-\xff]")
    raw = F.when(fits, F.encode(latin, "ISO-8859-1"))
    fixed = F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string"))
    return F.when((mojibake_score(c) > 0) & fixed.isNotNull() & (mojibake_score(fixed) < mojibake_score(c)), fixed).otherwise(c)


def json_block(c: Column) -> Column:
    """A judge's reply without its code fence; of other text the part from the first to the last brace."""
    bare = strip(F.regexp_replace(F.regexp_replace(strip(c), r"^```[a-zA-Z0-9_-]*\s*", ""), r"\s*```$", ""))
    found = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    return F.when(bare.startswith("{"), bare).otherwise(found)


# What a judge calls a good and a bad answer.
GOOD, BAD = ("acceptable", "accept", "correct", "ok"), ("incorrect", "wrong", "reject", "bad")


def judge_reply(c: Column) -> Column:
    """score (0 to 1, 4 places), label, reason, error of a judge's JSON reply."""
    block = json_block(c)
    v = F.try_parse_json(block)
    raw = F.try_variant_get(v, "$.score", "double")
    score = F.when(raw.isNotNull(), F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0)))
    verdict = F.lower(strip(F.try_variant_get(v, "$.verdict", "string")))
    label = F.when(verdict.isin(*GOOD), F.lit("acceptable")).when(verdict.isin(*BAD), F.lit("incorrect"))
    reason = F.nullif(strip(F.try_variant_get(v, "$.reason", "string")), F.lit(""))
    error = (
        F.when(block == "", F.lit("Judge returned non-JSON output"))
        .when(v.isNull(), F.lit("Judge JSON parse error"))
        .when(score.isNull() | label.isNull(), F.lit("Judge JSON missing valid score/verdict"))
    )
    return F.struct(F.bround(score, 4).alias("score"), label.alias("label"), reason.alias("reason"), error.alias("error"))


def context_budget(window: Column) -> Column:
    """Tokens of a model's window that context may take."""
    reserve = F.least(F.lit(2048), F.greatest(F.lit(512), F.floor(window / 4)))
    return F.greatest(F.lit(1024), F.least(window - reserve, F.floor(window * 0.7))).cast("long")
