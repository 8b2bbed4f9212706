"""Text kernels as column expressions; only Unicode normalisation and stemming need Python."""
from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from tesserae.constants import STOPWORDS

HAN = r"\p{IsHan}"
_RUN = rf"({HAN}+|[\p{{L}}\p{{N}}&&[^{HAN}]]+)"


def word_list(words) -> Column:
    return F.array(*map(F.lit, words))


def tokenize(text: Column) -> Column:
    """Set of tokens: words without stop words, and overlapping pairs of Han characters (one alone stays)."""
    runs = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(_RUN), F.lit(1))

    def of(run: Column) -> Column:
        pairs = F.when(F.char_length(run) == 1, F.array(run)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(run) - 1, F.lit(1))), lambda i: F.substring(run, i, F.lit(2))))
        return F.when(run.rlike(f"^{HAN}"), pairs).otherwise(F.array(run))

    return F.array_distinct(F.array_except(F.flatten(F.transform(runs, of)), word_list(STOPWORDS)))


def search_tokens(content: Column, tags: Column, entities: Column) -> Column:
    """Sorted tokens of content, tags and entities."""
    joined = F.concat_ws(" ", content, F.array_join(F.coalesce(tags, F.array().cast("array<string>")), " "), F.array_join(F.coalesce(entities, F.array().cast("array<string>")), " "))
    return F.array_sort(tokenize(joined))


def plain_normal(text: Column) -> Column:
    """Lower case, white space collapsed and trimmed; what normalisation does to text that NFKC leaves alone."""
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))


def nfkc(text: Column) -> Column:
    """NFKC in Arrow batches; ASCII text is passed through without Python's help."""

    @F.pandas_udf("string")
    def run(s):
        return s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))

    return run(text)


def normalize_content(text: Column) -> Column:
    return plain_normal(nfkc(text))


def content_hash(normal: Column) -> Column:
    return F.sha2(normal, 256)


def flatten_whitespace(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def brief(text: Column, n: int) -> Column:
    """At most n code points with an ellipsis in place of the rest."""
    flat = flatten_whitespace(text)
    cut = F.lit("…") if n == 1 else F.concat(F.rtrim(F.substring(flat, 1, n - 1)), F.lit("…"))
    return F.when(F.char_length(flat) <= n, flat).otherwise(cut)


def clip(text: Column, n: int) -> Column:
    return F.when(F.char_length(text) > n, F.concat(F.substring(text, 1, n - 1), F.lit("…"))).otherwise(text)


def negation_marks(text: Column) -> Column:
    words = F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)"), F.lit(1))
    return F.array_join(F.array_sort(F.filter(words, lambda w: w.isin("not", "no", "never"))), ",")


def contains_any(text: Column, phrases) -> Column:
    low = F.lower(text)
    out = F.lit(False)
    for p in phrases:
        out = out | low.contains(p.lower())
    return out


# Stemming after Porter (1980), as published.
_VOWELS = "aeiou"


def _cons(w: str, i: int) -> bool:
    c = w[i]
    return c not in _VOWELS and not (c == "y" and i > 0 and _cons(w, i - 1))


def _measure(w: str) -> int:
    shape = "".join("c" if _cons(w, i) else "v" for i in range(len(w)))
    n, last = 0, ""
    for c in shape:
        n += last == "v" and c == "c"
        last = c
    return n


def _vowel(w: str) -> bool:
    return any(not _cons(w, i) for i in range(len(w)))


def _cvc(w: str) -> bool:
    return len(w) > 2 and _cons(w, len(w) - 3) and not _cons(w, len(w) - 2) and _cons(w, len(w) - 1) and w[-1] not in "wxy"


_STEP2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"))
_STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def stem(w: str) -> str:
    if len(w) < 3 or not w.isascii() or not w.isalpha():
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and _vowel(w[:-len(end)]):
                w = w[:-len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and _cons(w, len(w) - 1) and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _cvc(w):
                    w += "e"
                break
    if w.endswith("y") and _vowel(w[:-1]):
        w = w[:-1] + "i"
    for steps, least in ((_STEP2, 0), (_STEP3, 0)):
        for end, new in sorted(steps, key=lambda x: -len(x[0])):
            if w.endswith(end):
                if _measure(w[:-len(end)]) > least:
                    w = w[:-len(end)] + new
                break
    for end in sorted(_STEP4, key=lambda x: -len(x)):
        if w.endswith(end):
            head = w[:-len(end)]
            if _measure(head) > 1 and (end != "ion" or head[-1:] in ("s", "t")):
                w = head
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _cvc(w[:-1])):
            w = w[:-1]
    if _measure(w) > 1 and w.endswith("ll"):
        w = w[:-1]
    return w


def stems(text: Column) -> Column:
    """Stems of the words that are no stop words, with their positions: array of (stem, pos)."""

    @F.pandas_udf("array<struct<stem:string,pos:int>>")
    def run(s):
        import re

        stop = set(STOPWORDS)
        return s.map(lambda t: [{"stem": stem(w), "pos": i} for i, w in enumerate(re.findall(r"[^\W_]+", (t or "").lower()), 1) if w not in stop])

    return run(text)


def cover_density(doc: Column, query: list[str]) -> Column:
    """Sum over minimal covers of the query's stems of 1 / (1 + other words inside); null if one is absent."""
    want = frozenset(query)

    @F.pandas_udf("double")
    def run(s):
        return s.map(lambda entries: _covers(((e["pos"], e["stem"]) for e in (entries if entries is not None else [])), want))

    return run(doc)


def cover_ranks(text: Column, queries: list[tuple[int, list[str]]]) -> Column:
    """cover_density of each query (id, stems) that has one, straight from the text: array of (query_id, rank_cd). Stems of one text at a time are held."""
    wants = [(i, frozenset(q)) for i, q in queries]
    every = frozenset().union(*(w for _, w in wants))
    firsts = frozenset(x[:1] for x in every)  # a stem begins as its word does

    @F.pandas_udf("array<struct<query_id:int,rank_cd:double>>")
    def run(s):
        import re

        stop, known = set(STOPWORDS), lru_cache(1 << 16)(stem)

        def ranks(t):
            at = [(i, x) for i, w in enumerate(re.findall(r"[^\W_]+", (t or "").lower()), 1) if w[0] in firsts and w not in stop and (x := known(w)) in every]
            got = ((i, _covers(at, want)) for i, want in wants)
            return [{"query_id": i, "rank_cd": r} for i, r in got if r is not None]

        return s.map(ranks)

    return run(text)


def _covers(entries, want: frozenset) -> float | None:
    """The density of (pos, stem) entries."""
    if not want:
        return None
    at = sorted(e for e in entries if e[1] in want)
    if {w for _, w in at} != want:
        return None
    total, count, left = 0.0, dict.fromkeys(want, 0), 0
    missing = len(want)
    for p, w in at:
        missing -= count[w] == 0
        count[w] += 1
        moved = False
        while missing == 0:
            moved = True
            start, first = at[left]
            count[first] -= 1
            missing += count[first] == 0
            left += 1
        if moved:
            total += 1 / (1 + max(0, p - start + 1 - len(want)))
    return total
