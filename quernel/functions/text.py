"""Scalar text functions as Column expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed as X


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _strings(xs) -> Column:
    return F.array(*map(F.lit, xs))


def _map(d: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def let(x: Column, f) -> Column:
    """f of x with x evaluated once; a plain reference inside a lambda would be evaluated for each element."""
    return F.element_at(F.transform(F.array(x), f), 1)


def tr_lower(x) -> Column:
    """Lower case with dotted and dotless i kept apart."""
    return F.lower(F.translate(_col(x), X.UPPER, X.LOWER))


def found_tokens(x) -> Column:
    """All numbers with inner points and commas, single digits and runs of letters, in lower case."""
    return F.regexp_extract_all(tr_lower(F.coalesce(_col(x), F.lit(""))), F.lit(X.TOKEN), F.lit(0))


def is_token(t: Column) -> Column:
    """Neither a stop word nor a lone letter."""
    return ~t.isin(X.STOPWORDS) & ((F.length(t) >= 2) | t.rlike("^[0-9]$"))


def raw_tokens(x) -> Column:
    """found_tokens without stop words and lone letters."""
    return F.filter(found_tokens(x), is_token)


def equivalents(t: Column) -> Column:
    """Other forms under which a token is found: without leading zeros, months and number words as digits."""
    plain = F.when((F.length(t) > 1) & t.rlike("^0[0-9]*$"), F.coalesce(F.nullif(F.ltrim(t, F.lit("0")), F.lit("")), F.lit("0")))
    month = F.element_at(_map(X.MONTHS), t)
    padded = F.when(F.length(month) == 1, F.concat(F.lit("0"), month))
    number = F.element_at(_map(X.NUMBER_WORDS), t)
    return F.filter(F.array_distinct(F.array_compact(F.array(plain, month, padded, number))), lambda e: e != t)


def forms(t: Column) -> Column:
    """A token's index terms: itself, its six-letter stem marked ~ if it has seven letters or more, its equivalents."""
    stem = F.when((F.length(t) >= X.STEM_FROM) & ~t.rlike("^[0-9]"), F.array(F.concat(F.left(t, F.lit(X.STEM_LEN)), F.lit("~")))).otherwise(F.array().cast("array<string>"))
    # few tokens have other forms; the others are spared the look-ups
    other = t.startswith("0") | t.isin([*X.MONTHS, *X.NUMBER_WORDS])
    return F.concat(F.array(t), stem, F.when(other, equivalents(t)).otherwise(F.array().cast("array<string>")))


def tokenize(x) -> Column:
    """Index terms: the forms of each token."""
    return F.flatten(F.transform(raw_tokens(x), forms))


def content_terms(x) -> Column:
    """As tokenize, without stems."""
    return F.flatten(F.transform(raw_tokens(x), lambda t: F.concat(F.array(t), equivalents(t))))


def coverage(q_terms: Column, body_terms: Column) -> Column:
    """Share of the distinct query terms that the body has, as such or by stem; 0 without query terms."""
    stem = lambda t: F.left(t, F.lit(X.STEM_LEN))
    long = lambda t: F.length(t) >= X.STEM_FROM

    def share(x):
        hit = F.filter(x["q"], lambda t: F.array_contains(x["b"], t) | (long(t) & F.array_contains(x["s"], stem(t))))
        return F.when(F.size(x["q"]) > 0, F.size(hit) / F.size(x["q"])).otherwise(F.lit(0.0))

    distinct = F.struct(F.array_distinct(q_terms).alias("q"), F.array_distinct(body_terms).alias("b"))
    return let(distinct, lambda d: let(F.struct(d["q"].alias("q"), d["b"].alias("b"), F.transform(F.filter(d["b"], long), stem).alias("s")), share))


def clean_text(x) -> Column:
    """Uniform line ends, joined hyphenation, no lines of a page number only, single blanks, at most one blank line."""
    t = F.regexp_replace(F.coalesce(_col(x), F.lit("")), "\r\n?", "\n")
    t = F.regexp_replace(t, r"(?U)(\w)-\n(\w)", "$1$2")
    t = F.regexp_replace(t, r"(?m)(?d)^\s*[-–—]?\s*[0-9]{1,4}\s*[-–—]?\s*$", "")
    t = F.regexp_replace(t, "[ \t ]+", " ")
    return trim(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def trim(x) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(_col(x), r"(?U)^\s+|\s+$", "")


def detect_heading(x) -> Column:
    """The first of three lines that looks like a heading, trimmed; else null."""
    lines = F.transform(F.slice(F.split(F.coalesce(_col(x), F.lit("")), "\n"), 1, 3), trim)
    upper = lambda s: (s == F.upper(s)) & (F.lower(s) != s) & F.length(s).between(4, 100)
    hits = F.filter(lines, lambda s: F.length(s).between(1, 120) & (s.rlike(X.HEADING) | upper(s)))
    return F.when(F.size(hits) > 0, F.element_at(hits, 1))


def capitals_heading(x) -> Column:
    """The first of three lines in capitals, 4 to 100 characters without ASCII white space at their ends; else null. Case is
    mapped character by character, so one whose capital is several (a ligature) is its own capital."""
    lines = F.transform(F.slice(F.split(F.coalesce(_col(x), F.lit("")), "\n"), 1, 3), lambda s: F.regexp_replace(s, r"^[\t\f\r ]+|[\t\f\r ]+\z", ""))
    plain = lambda s: F.translate(s, X.OWN_CAPITALS, "")
    hits = F.filter(lines, lambda s: F.length(s).between(4, 100) & (plain(s) == F.upper(plain(s))) & (F.lower(s) != s))
    return F.when(F.size(hits) > 0, F.element_at(hits, 1))


def split_articles(x, least: int = 60) -> Column:
    """Pieces at article marks, short ones joined to a neighbour; the text itself if there is one piece only."""
    raw = F.filter(F.transform(F.split(_col(x), X.ARTICLE), trim), lambda p: F.length(p) > 0)
    empty = F.array().cast("array<string>")
    last = lambda a: F.element_at(a, -1)
    join = lambda a, p: F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.concat(last(a), F.lit("\n"), p)))
    fold = F.aggregate(raw, empty, lambda a, p: F.when((F.size(a) > 0) & ((F.length(p) < least) | (F.length(last(a)) < least)), join(a, p)).otherwise(F.concat(a, F.array(p))))
    return F.when(F.length(_col(x)) == 0, empty).when(F.size(raw) <= 1, F.array(_col(x))).otherwise(fold)


def chunk_id(rel_path, order, seq, piece) -> Column:
    return F.sha1(F.concat_ws("|", _col(rel_path), _col(order).cast("string"), _col(seq).cast("string"), F.substring(_col(piece), 1, 120)))


def is_table_row(x) -> Column:
    """Does a line look like a row of a table: a period and a number, three numbers, or few words and an amount."""
    s = trim(x)
    n = F.regexp_count(s, F.lit(X.ROW_NUMBER))
    words = F.regexp_count(s, F.lit(r"(?U)\S+"))
    return F.coalesce(F.length(s).between(4, 220) & ((s.rlike(X.PERIOD) & (n >= 1)) | (n >= 3) | ((n >= 1) & (words <= 10) & s.rlike(X.MONEY))), F.lit(False))


def norm_line(x) -> Column:
    """A line for comparison over pages: digits masked, single blanks, lower case."""
    return F.lower(trim(F.regexp_replace(F.regexp_replace(_col(x), "[0-9]+", "#"), r"(?U)\s+", " ")))


def strip_citations(x) -> Column:
    return F.regexp_replace(F.regexp_replace(F.coalesce(_col(x), F.lit("")), X.CITATION, " "), X.BARE_CITATION, " ")


def cited_ids(x) -> Column:
    """The numbers of all citations, in order."""
    return F.transform(F.regexp_extract_all(F.coalesce(_col(x), F.lit("")), F.lit(X.CITATION), F.lit(1)), lambda n: n.cast("int"))


def normalize_number(x) -> Column:
    """Without thousands separators and without zeros that end decimals; other points stay."""
    s = F.replace(trim(F.coalesce(_col(x), F.lit(""))), F.lit(" "), F.lit(""))
    dec = F.substring_index(s, ",", -1)
    head = F.replace(F.substring(s, F.lit(1), F.length(s) - F.length(dec) - 1), F.lit("."), F.lit(""))
    dec = F.rtrim(dec, F.lit("0"))
    return F.when(F.contains(s, F.lit(",")), F.when(dec == "", head).otherwise(F.concat(head, F.lit(","), dec))).when(s.rlike(r"^[0-9]{1,3}(\.[0-9]{3})+$"), F.replace(s, F.lit("."), F.lit(""))).otherwise(s)


def numbers_in(x) -> Column:
    return F.regexp_extract_all(F.coalesce(_col(x), F.lit("")), F.lit(X.NUMBER), F.lit(0))


def number_forms(x) -> Column:
    """All numbers of a text as written, normalised, and without points."""
    return F.array_distinct(F.flatten(F.transform(numbers_in(x), lambda n: F.array(n, normalize_number(n), F.replace(n, F.lit("."), F.lit(""))))))


def split_sentences(x) -> Column:
    """Sentences line by line; a list item is one sentence."""
    lines = F.filter(F.transform(F.split(F.coalesce(_col(x), F.lit("")), "\n"), trim), lambda s: s != "")
    cut = lambda s: F.filter(F.transform(F.split(s, X.SENTENCE_END), trim), lambda p: p != "")
    return F.flatten(F.transform(lines, lambda s: F.when(s.rlike(X.LIST_ITEM), F.array(s)).otherwise(cut(s))))


def is_meta(x) -> Column:
    """Does a sentence only speak of its source, or say nothing: no number and under two content terms."""
    s = trim(strip_citations(x))
    return (s == "") | tr_lower(s).rlike(X.META) | (~s.rlike(X.NUMBER) & (F.size(content_terms(s)) < 2))


def is_factual(x, least: int = 40) -> Column:
    s = trim(strip_citations(x))
    return (s != "") & (s.rlike(X.NUMBER) | (F.length(s) >= least))


def strip_refusal(answer, refusal: str) -> tuple[Column, Column]:
    """(the answer without the refusal phrase, how often it stood there); citations may stand between its words."""
    import re

    core = re.sub(r"\bK\s?\d{1,2}\b", " ", re.sub(r"\[K\s*\d{1,2}\]", " ", refusal)).strip().strip(".").strip()
    a = F.coalesce(_col(answer), F.lit(""))
    if not core:
        return a, F.lit(0)
    quoted = [re.sub(r"([^\w])", r"\\\1", w) for w in core.split()]
    phrase = X.BEFORE_REFUSAL + X.CITATIONS_BETWEEN.join(quoted) + r"\s*\.?"
    n, t = F.regexp_count(a, F.lit(phrase)), F.regexp_replace(a, phrase, " ")
    for pattern, by in X.TIDY:
        t = F.regexp_replace(t, pattern, by)
    return F.when(n > 0, trim(t)).otherwise(a), n


def clean_ocr(x) -> Column:
    """Lines of at least two letters or digits, and 35 % of them; single blanks."""
    lines = F.transform(F.split(F.replace(F.coalesce(_col(x), F.lit("")), F.lit("\r"), F.lit("")), "\n"), trim)
    alnum = lambda s: F.regexp_count(s, F.lit(r"[\p{L}\p{N}]"))
    kept = F.filter(lines, lambda s: (s != "") & (alnum(s) >= F.greatest(F.lit(2.0), F.length(s) * 0.35)))
    return trim(F.regexp_replace(F.array_join(kept, "\n"), "[ \t]{2,}", " "))


def assess_quality(x) -> tuple[Column, Column]:
    """(score from 0 to 1, kinds of problems) of recognised text; under 40 characters: 1."""
    t = trim(F.coalesce(_col(x), F.lit("")))
    words = F.regexp_extract_all(t, F.lit(r"(?U)\S+"), F.lit(0))
    n, size = F.greatest(F.size(words), F.lit(1)), F.greatest(F.length(t), F.lit(1))
    count = lambda r: F.regexp_count(t, F.lit(r))
    glued, longs, odd, single = count(X.GLUED), count("[0-9]{6,}"), count(X.ODD), count(X.LONE_LETTER)
    tiny = F.size(F.filter(words, lambda w: (F.length(w) <= 2) & w.rlike(r"\p{L}")))
    terms = [
        ("glued", glued / n > 0.02, F.least(F.lit(0.35), glued / n * 5)), ("long_digits", longs > 0, F.least(F.lit(0.40), 0.25 * longs)), ("odd", odd / size > 0.004, F.least(F.lit(0.30), odd / size * 30)),
        ("fragments", tiny / n > 0.12, F.least(F.lit(0.25), tiny / n * 1.2)), ("lone_letters", single >= 2, F.least(F.lit(0.20), 0.05 * single)),
    ]
    loss = sum((F.when(c, p).otherwise(0.0) for _, c, p in terms), F.lit(0.0))
    short = F.length(t) < 40
    score = F.when(short, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 1.0 - loss))
    return score, F.when(short, F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c, _ in terms])))


def chars_per_ink(chars, ink) -> Column:
    return F.when(_col(ink) <= 0, F.lit(0.0)).otherwise(_col(chars) / (_col(ink) * 10000.0))


def content_loss(ink, ratio, best, floor: float = 3.0, relative: float = 0.7) -> Column:
    """Trust from 0 to 1 that a page's text is all there, from characters per ink and the document's best page."""
    i, r, b = _col(ink), _col(ratio), _col(best)
    absolute = F.when(r < floor, F.least(F.lit(0.6), (floor - r) / floor)).otherwise(0.0)
    compared = F.when((b > 0) & (r < b * relative), 0.25).otherwise(0.0)
    return F.when(i < 0.002, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 1.0 - (absolute + compared)))


def eval_normalize(x) -> Column:
    """Plain lower case with dotted i reduced (not tr_lower)."""
    return F.replace(F.replace(F.lower(F.coalesce(_col(x), F.lit(""))), F.lit("i̇"), F.lit("i")), F.lit("İ"), F.lit("i"))


def value_in(text_n, expected) -> Column:
    """Does normalised text hold an expected value; numbers need borders, words are substrings."""
    e = trim(F.coalesce(_col(expected), F.lit("")))
    quoted = F.regexp_replace(e, r"([.])", r"\\$1")
    pattern = F.concat(F.lit(r"(?<![0-9.,])"), quoted, F.lit(r"(?![0-9])"))
    return F.when(e == "", False).when(e.rlike("^[0-9.,:%/-]+$"), F.regexp_like(_col(text_n), pattern)).otherwise(F.contains(_col(text_n), eval_normalize(e)))


def highlight(x, term, width: int = 130) -> Column:
    """A window of text from a third of width before the first place of term to width after it, cut ends marked."""
    t, needle = _col(x), _col(term)
    flat = lambda c: F.regexp_replace(trim(c), r"(?U)\s+", " ")
    at = F.call_function("instr", tr_lower(t), tr_lower(needle)) - 1
    start, end = F.greatest(F.lit(0), at - width // 3), F.least(F.length(t), at + width)
    window = flat(F.substring(t, start + 1, end - start))
    marked = F.concat(F.when(start > 0, "…").otherwise(""), window, F.when(end < F.length(t), "…").otherwise(""))
    return F.when(at < 0, F.left(flat(t), F.lit(width))).otherwise(marked)


def lcp(a: Column, b: Column) -> Column:
    """Length of the longest common prefix."""
    n = F.least(F.length(a), F.length(b))
    differ = F.filter(F.sequence(F.lit(1), n), lambda k: F.substring(a, k, F.lit(1)) != F.substring(b, k, F.lit(1)))
    return F.when(n == 0, 0).otherwise(F.coalesce(F.array_min(differ) - 1, n))


def format_cell(x, kind: str) -> Column:
    """A spreadsheet cell as text: dates as dd.MM.yyyy, whole floats without decimals, others with a comma."""
    c = _col(x)
    if kind in ("date", "timestamp"):
        return F.coalesce(F.date_format(c, "dd.MM.yyyy"), F.lit(""))
    if kind in ("float", "double"):
        return F.coalesce(F.when(c == F.floor(c), c.cast("bigint").cast("string")).otherwise(F.translate(c.cast("string"), ".", ",")), F.lit(""))
    return F.coalesce(trim(c.cast("string")), F.lit(""))
