r"""Quality rules by distribution divergence.

Two histograms of a text are compared with references of the known languages by Jensen-Shannon distance (base 2, so
between 0 and 1): the shares of character classes among all characters but digits (identifiers in prose do not decide),
and the shares of a language's most common words, the rest being one class.  A document is kept when one language's
characters are near enough and one language's words are.  A text with fewer common words than the reference must come
nearer than MAX_WORD_SHARE of the distance that a text without any of them has, which tells prose from word lists, name
tables and word salad; one with more must stay within MAX_WORD_DISTANCE, which a few common words said over and over do
not.  Short texts have noisy histograms, so each comparison has a minimum length; below it, it is not made.

Only DataFrame functions are used, with one narrow pass over the table: no shuffle, no state, and cost per row
n log n in the row's own words (repeated 5-word windows are found by sorting window hashes, and only in rows which
have any).  The results leave through a generator of one row, behind which a filter on them stays: pushed below the
projections, it would compute every definition anew for each use.  Window equality is equality of 64-bit hashes inside
one document.

Defined results: a null text has no words; words are ``[^\x20\x09-\x0D]+``; a text below the minimum lengths is
judged by the base rules alone; repeated rows give repeated results; an empty table gives no rows; other columns are
carried along, but those of ``docs`` with the name of a result are replaced by it.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WINDOW = 5
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
#: Fewer code points or words than this: the histogram is not judged.
MIN_CHARS_JUDGED, MIN_WORDS_JUDGED = 100, 60
#: Largest distance of the characters, and of the words of a text with at least as many common words as the reference.
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.17, 0.45
#: Largest distance of the words of other texts, as a share of that of a text without any common word.
MAX_WORD_SHARE = 0.85

#: Shares of character classes in running prose (letters, capitals, spaces, punctuation, symbols).
CHAR_REFERENCE = {
    "en": (0.790, 0.025, 0.160, 0.022, 0.0001),
    "fr": (0.795, 0.022, 0.155, 0.025, 0.0001),
    "de": (0.790, 0.045, 0.140, 0.022, 0.0001),
    "es": (0.790, 0.022, 0.163, 0.022, 0.0001),
}
#: Shares of the most common words in running prose.
WORD_REFERENCE = {
    "en": {"the": 0.060, "of": 0.030, "and": 0.029, "to": 0.026, "a": 0.022, "in": 0.020, "that": 0.011, "is": 0.010, "it": 0.010, "was": 0.009, "for": 0.009, "on": 0.007, "with": 0.007, "as": 0.007, "be": 0.006, "by": 0.005},
    "fr": {"de": 0.055, "la": 0.032, "le": 0.030, "et": 0.024, "les": 0.023, "des": 0.021, "en": 0.018, "un": 0.014, "du": 0.013, "une": 0.012, "que": 0.012, "est": 0.011, "pour": 0.010, "qui": 0.010, "dans": 0.010, "par": 0.008},
    "de": {"der": 0.034, "die": 0.033, "und": 0.028, "in": 0.020, "den": 0.013, "von": 0.011, "zu": 0.011, "das": 0.011, "mit": 0.009, "ist": 0.009, "sich": 0.008, "des": 0.008, "auf": 0.008, "im": 0.008, "für": 0.007, "dem": 0.007},
    "es": {"de": 0.060, "la": 0.038, "que": 0.032, "el": 0.030, "en": 0.026, "y": 0.025, "a": 0.022, "los": 0.017, "se": 0.014, "del": 0.012, "las": 0.011, "un": 0.011, "no": 0.010, "por": 0.010, "con": 0.009, "una": 0.009},
}
COMMON = sorted({w for words in WORD_REFERENCE.values() for w in words})
LONGEST = max(len(w.encode()) for w in COMMON)

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS, CAPITALS, DIGITS, MARKS = r"#*$%&|<>", r"\p{Lu}", r"0-9", r".,;:!?'\"()\-"


def named(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    one_space = F.translate(text, SPACES[1:], " " * (len(SPACES) - 1))
    return F.array_remove(F.split(one_space, " "), "")


def _count(text: Column, inside: str) -> Column:
    """Code points of the class; long runs of others go in one match."""
    return F.length(F.regexp_replace(text, f"[^{inside}]+", ""))


def repeated_words(hashes: Column) -> Column:
    """Positions covered by the windows whose hash occurs twice or more. hashes: one for each window start."""
    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def starts(sorted_pairs: Column) -> Column:
        def twice(p: Column, k: Column) -> Column:
            before = F.get(sorted_pairs, k - 1)["h"]
            after = F.get(sorted_pairs, k + 1)["h"]
            return F.coalesce(p["h"] == before, F.lit(False)) | F.coalesce(p["h"] == after, F.lit(False))

        return F.array_sort(F.transform(F.filter(sorted_pairs, twice), lambda p: p["i"]))

    def covered(s: Column) -> Column:
        gaps = F.transform(s, lambda v, k: F.least(F.lit(WINDOW), F.coalesce(F.get(s, k + 1) - v, F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0), lambda a, v: a + v)

    inner = named(pairs, lambda p: named(starts(p), covered))
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), inner).otherwise(0)


def _distance(p: Column, q: list[float]) -> Column:
    """Jensen-Shannon distance of a histogram (an array of shares) and a reference, scaled to a sum of 1."""
    reference = F.array(*[F.lit(y / sum(q)) for y in q])

    def part(x: Column, y: Column) -> Column:
        m = (x + y) / 2
        return F.when(x > 0, x * F.log2(x / m)).otherwise(0.0) + F.when(y > 0, y * F.log2(y / m)).otherwise(0.0)

    total = F.aggregate(F.zip_with(p, reference, part), F.lit(0.0), lambda a, v: a + v)
    return F.sqrt(F.greatest(total / 2, F.lit(0.0)))


def _without_words(reference: dict[str, float]) -> float:
    """The distance of a text without any common word from the reference."""
    known = sum(reference.values())
    return math.sqrt((known + (1 - known) * math.log2(2 * (1 - known) / (2 - known)) + math.log2(2 / (2 - known))) / 2)


def _windows(hashes: Column) -> Column:
    """A hash for each window of WINDOW words."""
    last = F.size(hashes) - WINDOW
    made = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)]))
    return F.when(last < 0, F.array().cast("array<bigint>")).otherwise(made)


def _seen(words: Column) -> Column:
    """How often each word of COMMON stands there; only those that are known are looked through again."""
    known = F.filter(words, lambda w: (F.octet_length(w) <= LONGEST) & w.isin(COMMON + [w.capitalize() for w in COMMON]))
    listed = F.array(*[F.lit(w) for w in COMMON])
    return named(F.transform(known, lambda w: F.lower(w)), lambda k: F.transform(listed, lambda w: F.size(k) - F.size(F.array_remove(k, w))))


def _counts(text: Column, words: Column) -> dict[str, Column]:
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "n_words": F.size(words).cast("long"),
        "chars": F.length(text),
        "word_chars": F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast("long"),
        "n_symbols": _count(text, SYMBOLS).cast("long"),
        "capitals": _count(text, CAPITALS),
        "digits": _count(text, DIGITS),
        "marks": _count(text, MARKS),
        "n_dup_lines": named(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": named(named(F.transform(words, lambda w: F.xxhash64(w)), _windows), repeated_words).cast("long"),
        "seen": _seen(words),
    }


def _char_shares(c: Callable[[str], Column]) -> Column:
    letters = c("word_chars") - c("n_symbols") - c("capitals") - c("digits") - c("marks")
    whole = F.greatest(c("chars") - c("digits"), F.lit(1)).cast("double")
    return F.array(*[x / whole for x in (letters, c("capitals"), c("chars") - c("word_chars"), c("marks"), c("n_symbols"))])


def _word_excess(shares: Column, reference: dict[str, float]) -> Column:
    """The distance of the words from a reference, as a share of what is allowed. shares: of COMMON."""
    seen = F.transform(F.array(*[F.lit(COMMON.index(w)) for w in reference]), lambda i: F.get(shares, i))
    known = F.aggregate(seen, F.lit(0.0), lambda a, v: a + v)
    rest = F.array(F.greatest(F.lit(1.0) - known, F.lit(0.0)))
    allowed = F.when(known < sum(reference.values()), MAX_WORD_SHARE * _without_words(reference)).otherwise(MAX_WORD_DISTANCE)
    return _distance(F.concat(seen, rest), [*reference.values(), 1 - sum(reference.values())]) / allowed


OWN = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_distance", "word_excess", "kept")


def judge(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` and, of each text, the counts, base_failed, the distances (null if too short) and kept."""
    others = [c for c in docs.columns if c not in OWN]
    prefix = "_" * (1 + max(map(len, docs.columns)))  # makes names that no column of docs has
    c = lambda k: F.col(prefix + k)
    add = lambda d, new: d.withColumns({prefix + k: v for k, v in new.items()})
    d = add(docs, {"text": F.coalesce("text", F.lit(""))})
    d = add(d, {"words": words_of(c("text"))})
    d = add(d, _counts(c("text"), c("words")))
    whole = F.greatest(c("n_words"), F.lit(1)).cast("double")
    d = add(d, {"char_shares": _char_shares(c), "word_shares": F.transform(c("seen"), lambda n: n / whole)})
    char_distance = F.least(*[_distance(c("char_shares"), list(q)) for q in CHAR_REFERENCE.values()])
    word_excess = F.least(*[_word_excess(c("word_shares"), q) for q in WORD_REFERENCE.values()])
    failed = (c("n_words") < MIN_WORDS) | (100 * c("n_repeat_words") > MAX_REPEAT_PERCENT * c("n_words"))
    judged = {"char_distance": F.when(c("chars") >= MIN_CHARS_JUDGED, char_distance), "word_excess": F.when(c("n_words") >= MIN_WORDS_JUDGED, word_excess)}
    d = add(d, {"base_failed": failed} | judged)
    near = (F.coalesce(c("char_distance"), F.lit(0.0)) <= MAX_CHAR_DISTANCE) & (F.coalesce(c("word_excess"), F.lit(0.0)) <= 1)
    d = add(d, {"kept": ~c("base_failed") & near})
    return d.select(*others, F.inline(F.array(F.struct(*[c(k).alias(k) for k in OWN]))))


RESULT = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select(*RESULT)


def _oracle() -> str:
    """The same rules in DuckDB's SQL, with the references as values."""
    chars = ", ".join(f"('{k}', {list(v)!r})" for k, v in CHAR_REFERENCE.items())
    words = ", ".join(f"('{k}', {list(v)!r}, {[*v.values(), 1 - sum(v.values())]!r}, {_without_words(v)!r})" for k, v in WORD_REFERENCE.items())
    known = ", ".join(repr(w) for w in COMMON + [w.capitalize() for w in COMMON])
    distance = "sqrt(greatest(0.0, sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2))"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM d),
base AS (
  SELECT rid, doc_id, words, len(words) AS n_words, length(text) AS chars,
    length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
    length(regexp_replace(text, '[^\p{{Lu}}]+', '', 'g')) AS capitals,
    length(regexp_replace(text, '[^0-9]+', '', 'g')) AS digits,
    length(regexp_replace(text, '[^.,;:!?''"()\-]+', '', 'g')) AS marks,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM w),
windows AS (
  SELECT rid, unnest(range(1, len(words) - 3)) AS k, unnest(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) AS win
  FROM base WHERE len(words) >= 5),
twice AS (SELECT rid, k FROM windows QUALIFY count(*) OVER (PARTITION BY rid, win) > 1),
gaps AS (SELECT rid, least(5, coalesce(lead(k) OVER (PARTITION BY rid ORDER BY k) - k, 5)) AS g FROM twice),
repeats AS (SELECT rid, sum(g) AS n FROM gaps GROUP BY rid),
seen AS (SELECT rid, lower(x) AS w, count(*) AS c FROM (SELECT rid, unnest(words) AS x FROM base) WHERE x IN ({known}) GROUP BY ALL),
char_refs(lang, q) AS (VALUES {chars}), word_refs(lang, names, q, without) AS (VALUES {words}),
char_pairs AS (
  SELECT rid, lang, unnest([(word_chars - n_symbols - capitals - digits - marks)::DOUBLE, capitals, chars - word_chars, marks, n_symbols]) / greatest(chars - digits, 1) AS p,
    unnest(list_transform(q, lambda x: x / list_sum(q))) AS q
  FROM base, char_refs WHERE chars >= {MIN_CHARS_JUDGED}),
char_near AS (SELECT rid, min(x) AS x FROM (SELECT rid, lang, {distance} AS x FROM char_pairs GROUP BY ALL) GROUP BY rid),
named AS (SELECT rid, n_words, lang, unnest(names) AS w, unnest(q[1:len(names)]) AS q FROM base, word_refs WHERE n_words >= {MIN_WORDS_JUDGED}),
shares AS (SELECT n.rid, lang, coalesce(c, 0)::DOUBLE / n_words AS p, q FROM named n LEFT JOIN seen s ON s.rid = n.rid AND s.w = n.w),
word_pairs AS (
  SELECT rid, lang, p, q FROM shares
  UNION ALL SELECT rid, lang, greatest(0.0, 1 - sum(p)), 1 - sum(q) FROM shares GROUP BY rid, lang),
allowed AS (
  SELECT rid, s.lang, CASE WHEN sum(p) < list_sum(any_value(r.q)[1:-2]) THEN {MAX_WORD_SHARE} * any_value(without) ELSE {MAX_WORD_DISTANCE} END AS most
  FROM shares s JOIN word_refs r ON r.lang = s.lang GROUP BY rid, s.lang),
far AS (SELECT rid, lang, {distance} AS x FROM word_pairs GROUP BY ALL),
word_near AS (SELECT far.rid, min(x / most) AS x FROM far JOIN allowed ON allowed.rid = far.rid AND allowed.lang = far.lang GROUP BY far.rid),
judged AS (
  SELECT doc_id, n_words, word_chars, n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(n, 0)::BIGINT AS n_repeat_words, n_words < {MIN_WORDS} OR 100 * coalesce(n, 0) > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
    coalesce(c.x, 0) <= {MAX_CHAR_DISTANCE} AND coalesce(v.x, 0) <= 1 AS near
  FROM base LEFT JOIN repeats USING (rid) LEFT JOIN char_near c USING (rid) LEFT JOIN word_near v USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND near AS kept FROM judged
"""


ORACLE_SQL = _oracle()
