"""DuckDB expressions that mirror functions.text, for the oracles."""

from __future__ import annotations

from ..functions import fixed as X


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strings(xs) -> str:
    return "[" + ", ".join(map(quote, xs)) + "]"


def mapping(d: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"{quote(k)}: {quote(v)}" for k, v in d.items()) + "}"


def tr_lower(x: str) -> str:
    return f"lower(translate({x}, '{X.UPPER}', '{X.LOWER}'))"


def trim(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def raw_tokens(x: str) -> str:
    return rf"list_filter(regexp_extract_all({tr_lower(f'coalesce({x}, {quote(str())})')}, '[0-9][0-9.,]*[0-9]|[0-9]|\p{{L}}+'), lambda t: NOT list_contains({strings(X.STOPWORDS)}, t) AND (length(t) >= 2 OR regexp_matches(t, '^[0-9]$')))"


def equivalents(t: str) -> str:
    month, number = f"{mapping(X.MONTHS)}[{t}]", f"{mapping(X.NUMBER_WORDS)}[{t}]"
    plain = f"CASE WHEN length({t}) > 1 AND regexp_matches({t}, '^0[0-9]*$') THEN coalesce(nullif(ltrim({t}, '0'), ''), '0') END"
    every = f"[{plain}, {month}, CASE WHEN length({month}) = 1 THEN '0' || {month} END, {number}]"
    return f"list_filter({every}, lambda e: e IS NOT NULL AND e <> {t})"


def tokenize(x: str) -> str:
    return f"flatten(list_transform({raw_tokens(x)}, lambda t: list_concat(list_concat([t], CASE WHEN length(t) >= {X.STEM_FROM} AND NOT regexp_matches(t, '^[0-9]') THEN [left(t, {X.STEM_LEN}) || '~'] ELSE []::VARCHAR[] END), {equivalents('t')})))"


def content_terms(x: str) -> str:
    return f"flatten(list_transform({raw_tokens(x)}, lambda t: list_concat([t], {equivalents('t')})))"


def coverage(q: str, b: str) -> str:
    """Over lists of distinct terms."""
    stems = f"list_transform(list_filter({b}, lambda s: length(s) >= {X.STEM_FROM}), lambda s: left(s, {X.STEM_LEN}))"
    hit = f"list_filter({q}, lambda t: list_contains({b}, t) OR (length(t) >= {X.STEM_FROM} AND list_contains({stems}, left(t, {X.STEM_LEN}))))"
    return f"CASE WHEN len({q}) > 0 THEN len({hit})::DOUBLE / len({q}) ELSE 0.0::DOUBLE END"


def strip_citations(x: str) -> str:
    return rf"regexp_replace(regexp_replace(coalesce({x}, ''), '\[K\s*([0-9]{{1,2}})\]', ' ', 'g'), '\bK\s?[0-9]{{1,2}}\b', ' ', 'g')"


def numbers_in(x: str) -> str:
    return rf"regexp_extract_all(coalesce({x}, ''), '[0-9]+(?:[.,][0-9]+)*')"


def normalize_number(s: str) -> str:
    dec = f"rtrim(split_part({s}, ',', -1), '0')"
    head = f"replace(left({s}, length({s}) - length(split_part({s}, ',', -1)) - 1), '.', '')"
    return rf"CASE WHEN contains({s}, ',') THEN CASE WHEN {dec} = '' THEN {head} ELSE {head} || ',' || {dec} END WHEN regexp_full_match({s}, '[0-9]{{1,3}}(\.[0-9]{{3}})+') THEN replace({s}, '.', '') ELSE {s} END"


def sentences(x: str) -> str:
    """A list; the split marks are put in first, since DuckDB's patterns have no look-behind."""
    cut = rf"string_split(regexp_replace(l, '([.!?:])\s+([A-ZÇĞİÖŞÜ«\x22\x27\-•*0-9\[(])', '\1' || chr(1) || '\2', 'g'), chr(1))"
    return rf"flatten(list_transform(list_filter(list_transform(string_split(coalesce({x}, ''), chr(10)), lambda a: {trim('a')}), lambda a: a <> ''), lambda l: CASE WHEN regexp_matches(l, '^(?:[-*•]|[0-9]+[.)])\s+') THEN [l] ELSE list_filter(list_transform({cut}, lambda p: {trim('p')}), lambda p: p <> '') END))"


def eval_normalize(x: str) -> str:
    return f"replace(replace(lower(coalesce({x}, '')), 'i̇', 'i'), 'İ', 'i')"


def value_in(t: str, e: str) -> str:
    """Borders are taken into the match, since DuckDB's patterns have no look-around."""
    number = rf"regexp_matches({t}, '(^|[^0-9.,])' || regexp_replace({e}, '[.]', '\\.', 'g') || '($|[^0-9])')"
    return f"CASE WHEN {e} = '' THEN FALSE WHEN regexp_full_match({e}, '[0-9.,:%/-]+') THEN {number} ELSE contains({t}, {eval_normalize(e)}) END"


def table_row(x: str) -> str:
    """A number starts only where a run of word characters, points and commas does, so each run counts once at most."""
    word = r"\p{L}\p{M}\p{N}\p{Pc}"
    number = rf"^(?:[0-9]{{1,3}}(?:\.[0-9]{{3}})+(?:,[0-9]+)?|[0-9]+(?:,[0-9]+)?)(?:$|[^{word}])"
    day, month = "[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{2,4}", rf"(?:{X.MONTH_NAMES})\s*[/-]?\s*[0-9]{{4}}|[0-9]{{4}}\s+(?:{X.MONTH_NAMES})"
    period = rf"(?i)(?:^|[^{word}])(?:{day}|[0-9]{{4}}[-/.][0-9]{{1,2}}|[0-9]{{1,2}}[-/.][0-9]{{4}}|{month})(?:$|[^{word}])"
    n = f"len(list_filter(regexp_extract_all({x}, '[{word}.,]+'), lambda r: regexp_matches(r, {quote(number)})))"
    amount = rf"len(regexp_extract_all({x}, '[^\s\p{{Z}}]+')) <= 10 AND regexp_matches({x}, '[0-9],[0-9]{{2}}(?:$|[^{word}])')"
    return f"length({x}) BETWEEN 4 AND 220 AND ((regexp_matches({x}, {quote(period)}) AND {n} >= 1) OR {n} >= 3 OR ({n} >= 1 AND {amount}))"


def heading(x: str) -> str:
    lines = f"list_transform(string_split(coalesce({x}, ''), chr(10))[1:3], lambda l: {trim('l')})"
    upper = "(l = upper(l) AND lower(l) <> l AND length(l) BETWEEN 4 AND 100)"
    return f"list_filter({lines}, lambda l: length(l) BETWEEN 1 AND 120 AND (regexp_matches(l, {quote(X.HEADING)}) OR {upper}))[1]"


def cosine(a: str, b: str) -> str:
    return f"list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[])"


def wilson(k: str, n: str) -> tuple[str, str]:
    z, z2 = X.Z95, X.Z95 * X.Z95
    p = f"({k}::DOUBLE / {n})"
    centre = f"(({p} + {z2!r}::DOUBLE / (2 * {n})) / (1 + {z2!r}::DOUBLE / {n}))"
    radius = f"(({z!r}::DOUBLE / (1 + {z2!r}::DOUBLE / {n})) * sqrt({p} * (1 - {p}) / {n} + {z2!r}::DOUBLE / (4 * {n}::DOUBLE * {n})))"
    return f"(CASE WHEN {n} <= 0 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, {centre} - {radius}) END)", f"(CASE WHEN {n} <= 0 THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, {centre} + {radius}) END)"
