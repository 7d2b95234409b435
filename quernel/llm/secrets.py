"""Secret scan with a random forest against false positives, in DataFrame functions only.

A wide pattern marks candidates (long tokens with a digit, and values after ':' or '='). Each gets
features in five groups: length, character transitions, dictionary coverage, path, neighbouring words. A
random forest (pyspark.ml), trained from labelled findings, keeps those that look like credentials.
Transitions and dictionary are learned from the corpus itself (`learn`): the chance of each letter after another over
all its words, and the words that it holds `least` times or more; a candidate is rated by the mean log chance of its
letter pairs and by the share of its characters in such words. Labelled findings are a table (before, candidate, after,
path, label); `labelled_findings` makes one by rule where no reviewed findings are at hand.

A text is cut at its candidates; positions are running sums of the lengths of the pieces, so the work grows in
proportion to the text and the number of candidates.

Positions are code points, end exclusive. Defined results: null and empty texts have no findings; rows
alike give findings alike; candidates don't overlap, the leftmost wins; texts of any length are scanned
whole; the private-use characters U+E000 and U+E001, used as marks, count as other characters; an empty
table gives no findings; further columns, whatever their names, are not looked at (and kept by `redact`).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import drop, lookup, materialise

CANDIDATE = r"(?<![A-Za-z0-9+/_\-])(?:(?=[A-Za-z+/_\-]*+[0-9])[A-Za-z0-9+/_\-]{12,}+|(?<=[:=][\"']?|[:=]\s[\"']?)[A-Za-z0-9+/_\-!@#$%^&*.~]{6,}+)"
OPEN, CLOSE = "", ""
#: How much text before and after a candidate counts as its neighbourhood.
AROUND = 48

# Words and letter pairs that the features look for.
SECRET_WORDS = "password|passwd|pwd|secret|token|apikey|api_key|api-key|access_key|accesskey|credential|private_key|auth|bearer|client_secret|passphrase"
BENIGN_WORDS = "commit|sha1|sha256|md5|hash|checksum|digest|etag|uuid|guid|build|version|revision|order|invoice|isbn|serial|ticket|phone|card|id|ref|page|file|path|url"
PLACEHOLDERS = "example|sample|dummy|test|changeme|placeholder|your|xxxx|redacted|fake|todo|none|null|true|false|default"
DICTIONARY = "password|secret|token|value|name|user|admin|login|server|client|config|default|example|sample|test|data|table|index|image|photo|page|file|path|home|www|com|org|net|html|http|https|static|assets|module|function|class|object|string|number|handler|service|report|account|order|product|version|release|update|the|and|for|with|that|this|from|have|not|are|was|will|can|all|new|one|time|year|day|month|january|february|march|april|june|july|august|september|october|november|december"
PAIRS = "th|he|in|er|an|re|on|at|en|nd|ti|es|or|te|of|ed|is|it|al|ar|st|to|nt|ng|se|ha|as|ou|io|le|ve|co|me|de|hi|ri|ro|ic|ne|ea|ra|ce"
KNOWN = r"^(AKIA|ASIA|ghp_|gho_|sk_live_|rk_live_|xox[bap]-|AIza|eyJ|glpat-|SG\.)"

FEATURES = ["f_len", "f_change", "f_digit", "f_upper", "f_lower", "f_symbol", "f_hex", "f_digits_only", "f_distinct", "f_run", "f_pairs", "f_chance", "f_words", "f_vocabulary", "f_known", "f_path_in", "f_path_near", "f_path_doc", "f_secret_word", "f_benign_word", "f_placeholder", "f_assigned", "f_quoted"]


@dataclass
class Language:
    """What `learn` knows of a corpus: its words (word, n), and one row with the log chances of 26 x 26 letter pairs."""

    words: DataFrame
    chances: DataFrame


@dataclass
class Scanner:
    """A trained forest with the language that its features are taken from."""

    forest: PipelineModel
    language: Language | None


def learn(docs: DataFrame, least: int = 20, text: str = "text") -> Language:
    """Words that all of docs hold `least` times or more, and letter transitions over all words of a-z."""
    words = docs.select(F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}{2,24}"), F.lit(0))).alias("word"))
    counts = materialise(words.groupBy("word").agg(F.count("*").alias("n")), "words")
    pairs = counts.select("n", F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring(F.col("word"), i, F.lit(2)))).alias("pair"))
    at = lambda i: F.ascii(F.substring("pair", i, 1)) - 97
    seen = pairs.where(F.col("pair").rlike("^[a-z]{2}$")).groupBy((at(1) * 26 + at(2)).alias("id")).agg(F.sum("n").alias("n"))
    # 676 rows, then one
    grid = docs.sparkSession.range(0, 676, 1, 1).join(F.broadcast(seen.select(F.col("id").cast("long").alias("id"), "n")), "id", "left").select("id", (F.coalesce("n", F.lit(0)) + 1).alias("n"))
    rows = grid.withColumn("p", F.log(F.col("n") / F.sum("n").over(Window.partitionBy(F.floor(F.col("id") / 26)))))
    chances = rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "p"))), lambda x: x["p"]).alias("chances"))
    language = Language(materialise(counts.where((F.col("n") >= least) & (F.length("word") >= 3)), "vocabulary"), materialise(chances, "chances"))
    drop(counts)
    return language


def _known(found: DataFrame, language: Language | None) -> DataFrame:
    """found (a written table) with f_chance and f_vocabulary; every string that candidates repeat is looked up once."""
    if language is None:
        return found.withColumns({"f_chance": F.lit(0.0), "f_vocabulary": F.lit(0.0)})
    strings = found.groupBy("candidate").agg(F.count("*").alias("uses"))
    chars = F.split(F.lower("candidate"), "")
    letter = lambda c: c.between("a", "z") & (F.length(c) == 1)
    # ids of pairs of neighbouring letters
    ids = F.zip_with(F.slice(chars, 1, F.size(chars) - 1), F.slice(chars, 2, F.size(chars) - 1), lambda a, b: F.when(letter(a) & letter(b), (F.ascii(a) - 97) * 26 + F.ascii(b) - 96))
    of_strings = strings.where(F.length("candidate") > 1).withColumn("ids", F.array_compact(ids)).where(F.size("ids") > 0).crossJoin(F.broadcast(language.chances))  # one row
    chance = F.aggregate(F.transform("ids", lambda i: F.element_at("chances", i)), F.lit(0.0), lambda x, y: x + y) / F.size("ids")
    rated = of_strings.select("candidate", chance.alias("chance"))
    tokens = materialise(strings.select("candidate", F.explode(F.regexp_extract_all("candidate", F.lit("[A-Z]?[a-z]{2,}|[A-Z]{3,}"), F.lit(0))).alias("token")).select("candidate", F.lower("token").alias("token")), "tokens")
    needed = materialise(tokens.groupBy("token").agg(F.count("*").alias("uses")).join(language.words.select(F.col("word").alias("token")), "token"), "needed")
    covered = lookup(tokens, needed, "token", "uses").groupBy("candidate").agg(F.sum(F.length("token")).alias("covered"))
    told = materialise(strings.join(rated, "candidate", "left").join(covered, "candidate", "left"), "strings")
    out = lookup(found, told, "candidate", "uses", "left")
    out = out.withColumns({"f_chance": F.coalesce("chance", F.lit(-3.0)), "f_vocabulary": F.coalesce(F.col("covered") / F.length("candidate"), F.lit(0.0))}).drop("chance", "covered", "uses")
    out = materialise(out, "known")
    drop(tokens, needed, told)
    return out


def _marked(text: Column) -> Column:
    """The text cut before each candidate, in pieces of a candidate, a mark and what follows; the first has no candidate."""
    return F.split(F.regexp_replace(F.translate(text, OPEN + CLOSE, "??"), CANDIDATE, f"{OPEN}$0{CLOSE}"), OPEN)


def featurise(found: DataFrame) -> DataFrame:
    """found with a double column for each of FEATURES; needs before, candidate, after and path."""
    c, n = F.col("candidate"), F.length("candidate")
    before, after, path = (F.lower(F.coalesce(F.col(x), F.lit(""))) for x in ("before", "after", "path"))
    near = F.concat_ws(" ", before, after)
    count = lambda x, r: F.regexp_count(x, F.lit(r)).cast("double")
    share = lambda r: count(c, r) / n
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("double")
    values = {
        "f_len": F.least(n, F.lit(200)).cast("double"),
        # character transitions: class changes, distinct characters, runs, and common letter pairs
        "f_change": share(r"(?<=[a-z])[A-Z0-9]|(?<=[A-Z])[a-z0-9]|(?<=[0-9])[A-Za-z]"),
        "f_digit": share("[0-9]"), "f_upper": share("[A-Z]"), "f_lower": share("[a-z]"), "f_symbol": share("[^A-Za-z0-9]"),
        "f_hex": flag(c.rlike("^[0-9a-f]+$|^[0-9A-F]+$")), "f_digits_only": flag(c.rlike("^[0-9_/+\\-]+$")),
        "f_distinct": F.size(F.array_distinct(F.split(c, ""))) / F.least(n, F.lit(64)),
        "f_run": count(c, r"(.)\1") / n,
        "f_pairs": count(F.lower(c), PAIRS) / n,
        "f_words": (n - F.length(F.regexp_replace(F.lower(c), DICTIONARY, ""))) / n,
        "f_known": flag(c.rlike(KNOWN)),
        # path: a slash inside, a path or address that runs into the candidate, and where the document is from
        "f_path_in": count(c, "/") / n,
        "f_path_near": flag(before.rlike(r"(://|www\.|/|\\)\S*$") | after.rlike(r"^\.[a-z]{2,4}\b|^/")),
        "f_path_doc": flag(path.rlike("test|example|sample|fixture|docs|mock")),
        # neighbouring words
        "f_secret_word": flag(F.right(before, F.lit(24)).rlike(SECRET_WORDS)),
        "f_benign_word": flag(F.right(before, F.lit(24)).rlike(rf"\b({BENIGN_WORDS})\b")),
        "f_placeholder": flag(F.lower(c).rlike(PLACEHOLDERS) | near.rlike(r"\b(example|sample|dummy|placeholder|redacted|fake)\b")),
        "f_assigned": flag(before.rlike(r"[:=]\s?[\"']?$")), "f_quoted": flag(before.rlike("[\"'`]$")),
    }
    return found.withColumns(values)


def _key(doc_id: str, text: str) -> Column:
    """Rows alike in id and text share it."""
    return F.xxhash64(doc_id, text, F.octet_length(text))


def candidates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """doc_id, path, key, i, start, end (code points), before, candidate, after: a row for each candidate, the i-th of its text."""
    some = docs.where(F.col(text).rlike(CANDIDATE)).select(F.col(doc_id).alias("doc_id"), (F.col(path) if path else F.lit(None)).cast("string").alias("path"), _key(doc_id, text).alias("key"), F.monotonically_increasing_id().alias("row"), F.col(text).alias("t"))
    some = some.select("doc_id", "path", "key", "row", F.posexplode(_marked(F.col("t"))).alias("i", "piece"))
    bare = F.translate("piece", CLOSE, "")
    cut = some.select("doc_id", "path", "key", "row", "i", F.length(bare).alias("n"), F.right(bare, F.lit(AROUND)).alias("tail"), F.substring_index("piece", CLOSE, 1).alias("candidate"), F.left(F.substring_index("piece", CLOSE, -1), F.lit(AROUND)).alias("after"))
    order = Window.partitionBy("row").orderBy("i")
    told = cut.withColumn("start", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)).cast("long")).withColumn("before", F.lag("tail").over(order)).where("i > 0")
    return told.select("doc_id", "path", "key", "i", "start", (F.col("start") + F.length("candidate")).alias("end"), "before", "candidate", "after")


def labelled_findings(spark: SparkSession, n: int = 6000) -> DataFrame:
    """n findings by rule, half of them credentials: before, candidate, after, path, label. Equal n, equal rows."""
    key = lambda salt: F.sha2(F.concat_ws(":", F.lit(salt), F.col("id").cast("string")), 256)
    pick = lambda salt, *xs: F.element_at(F.array(*[x if isinstance(x, Column) else F.lit(x) for x in xs]), (F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(len(xs))) + 1).cast("int"))
    b64 = lambda salt: F.base64(F.unhex(key(salt)))
    alnum = F.regexp_replace(b64("a"), "[^A-Za-z0-9]", "")
    size = (F.pmod(F.xxhash64(F.lit("n"), "id"), F.lit(30)) + 12).cast("int")
    digits = F.translate(key("d"), "abcdef", "314159")
    word = lambda salt: pick(salt, *"over the river and under a bridge was seen when they went home pour les autres dans avec und nicht der mit para los que esta".split())
    filler = F.concat_ws(" ", word("w1"), word("w2"), word("w3"))
    name = pick("k", "password", "token", "secret", "api_key", "client_secret", "auth_token", "access_key", "passwd", "DB_PASSWORD", "private_key")
    assign = F.concat(filler, F.lit(" "), name, pick("e", "=", " = ", ": ", ":"), pick("q", "", '"', "'"))
    good = pick("g", *[F.struct(b.alias("before"), c.alias("candidate")) for b, c in (
        (assign, F.left(key("h"), size)), (assign, F.left(key("h"), pick("hl", F.lit(16), F.lit(18), F.lit(20), F.lit(32), F.lit(40), F.lit(64)))), (assign, F.left(alnum, size)), (assign, F.left(b64("c"), size)),
        (F.concat(filler, F.lit(" ")), F.concat(pick("p", "AKIA", "ASIA"), F.left(F.regexp_replace(F.upper(b64("u")), "[^A-Z0-9]", ""), F.lit(16)))),
        (F.concat(filler, F.lit(" ")), F.concat(pick("p2", "ghp_", "sk_live_", "xoxb-", "AIza", "glpat-"), F.left(alnum, F.lit(36)))),
        (F.concat(filler, F.lit(" "), pick("k2", "bearer", "secret", "password", "token"), pick("is", " is ", " ")), F.left(alnum, size)),
    )])
    benign = pick("b", "commit", "md5", "sha256", "checksum", "etag", "hash", "revision", "build", "uuid", "order", "invoice", "serial", "id", "")
    noted = F.concat(filler, F.lit(" "), benign, pick("e2", " ", ": ", "=", " "))
    snake = F.concat_ws("_", pick("s1", "user", "report", "module", "page", "image", "handler"), pick("s2", "profile", "index", "version", "default", "service"), F.left(digits, F.lit(3)))
    compound = F.concat(pick("c1", "the", "and", "ing", "tion", "for"), pick("c2", "ering", "ation", "under", "order"), pick("c3", "than", "here", "ment", "able"), F.left(digits, F.lit(2)))
    bad = pick("x", *[F.struct(b.alias("before"), c.alias("candidate")) for b, c in (
        (noted, F.left(key("h"), pick("hl", F.lit(32), F.lit(40), F.lit(64), F.lit(16)))), (noted, F.left(digits, size)), (F.concat(filler, F.lit(" ")), F.left(digits, size)),
        (noted, F.concat_ws("-", F.left(key("u"), F.lit(8)), F.substring(key("u"), 9, 4), F.substring(key("u"), 13, 4), F.substring(key("u"), 17, 4), F.substring(key("u"), 21, 12))),
        (F.concat(filler, F.lit(" ")), snake), (F.concat(filler, F.lit(" ")), compound), (F.concat(filler, F.lit(" https://www.site.org/")), F.concat_ws("/", F.lit("static"), snake)),
        (assign, pick("ph", "changeme", "your_password_here", "xxxxxxxxxxxx", "example-token-1", "<redacted>", "placeholder1", "${DB_PASSWORD}", "test1234")),
        (F.concat(filler, pick("e3", ": ", "=")), pick("v", "default", "production", "enabled", "localhost8080", "2024-01-31", "info@site.org", "and.more", "something")),
        (F.concat(filler, F.lit(" ")), F.repeat(F.lit("ab1"), 6)), (F.concat(filler, F.lit("/")), F.concat(snake, F.lit("-"), F.left(key("z"), F.lit(6)))),
    )])
    rows = spark.range(0, n, 1, 1).withColumn("label", (F.col("id") % 2).cast("double"))
    rows = rows.withColumn("f", F.when(F.col("label") == 1, good).otherwise(bad))
    after = F.concat(F.when(F.right("f.before", F.lit(1)).isin('"', "'"), F.right("f.before", F.lit(1))).otherwise(""), F.lit(" "), filler)
    return rows.select("f.before", "f.candidate", after.alias("after"), pick("pa", "src/app/main", "notes", "web", "src/config", "tests/fixtures").alias("path"), "label")


def train(labelled: DataFrame, language: Language | None = None, trees: int = 40, depth: int = 9, seed: int = 7) -> Scanner:
    """A random forest over FEATURES from labelled findings (before, candidate, after, path, label)."""
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
    # a table of numbers, so that the forest's jobs don't plan and compile the features each time
    found = materialise(labelled.where("length(candidate) > 0 and label is not null").select("before", "candidate", "after", "path", "label"), "findings")
    rows = materialise(featurise(_known(found, language)).select("label", *FEATURES), "labelled")
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, subsamplingRate=0.8, featureSubsetStrategy="sqrt", cacheNodeIds=False)
    return Scanner(PipelineModel([assembler, forest.fit(assembler.transform(rows))]), language)


def _scored(docs: DataFrame, scanner: Scanner, doc_id: str, text: str, path: str | None) -> DataFrame:
    found = materialise(candidates(docs, doc_id, text, path), "candidates")
    scored = scanner.forest.transform(featurise(_known(found, scanner.language))).withColumn("score", vector_to_array("probability")[1])
    scored = materialise(scored.select("doc_id", "key", "i", "start", "end", "candidate", "score"), "scored")
    drop(found)
    return scored


def scan(docs: DataFrame, scanner: Scanner, threshold: float = 0.5, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """The candidates that the forest scores at threshold or more: doc_id, start, end, candidate, score."""
    return _scored(docs, scanner, doc_id, text, path).where(F.col("score") >= threshold).select("doc_id", "start", "end", "candidate", "score")


def redact(docs: DataFrame, scanner: Scanner, mask: str = "[SECRET]", threshold: float = 0.5, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """docs with each kept finding replaced by mask, at each place of its text where the same string is a candidate; all rows stay.

    Only documents with a candidate are shuffled.
    """
    scored = _scored(docs, scanner, doc_id, text, path)
    # a row for each candidate of a text, whatever the number of rows alike
    best = F.max("score").over(Window.partitionBy("key", "candidate"))
    once = scored.groupBy("key", "i", "candidate").agg(F.max("score").alias("score"), F.count("*").alias("rows")).withColumn("kept", best >= threshold)
    flags = once.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "kept"))), lambda x: x["kept"]).alias("flags"), F.max("rows").alias("rows"), F.collect_set(F.when(F.col("kept"), F.col("candidate"))).alias("found"))
    flags = materialise(flags.where(F.exists("flags", lambda x: x)), "flags")
    body = F.col(f"row.`{text}`")
    swap = lambda p, f: F.when(f, F.concat(F.lit(mask), F.substring_index(p, CLOSE, -1))).otherwise(F.translate(p, CLOSE, ""))
    masked = F.array_join(F.zip_with(_marked(body), F.concat(F.array(F.lit(False)), "flags"), swap), "")
    # a text that holds the marks themselves keeps them: found strings are replaced one after another, longer ones first
    longest = F.array_sort("found", lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).when(a < b, -1).when(a > b, 1).otherwise(0))
    plain = F.aggregate(longest, body, lambda t, c: F.replace(t, c, F.lit(mask)))
    masked = F.when(body.rlike(f"[{OPEN}{CLOSE}]"), plain).otherwise(masked)
    some = F.coalesce(F.col(text).rlike(CANDIDATE), F.lit(False))
    rows = docs.where(some).select(_key(doc_id, text).alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    hit = lookup(rows, flags, "key", "rows", "left").select(F.col("row").withField(f"`{text}`", F.when(F.col("flags").isNull(), body).otherwise(masked)).alias("row"))
    return docs.where(~some).unionByName(hit.select("row.*"))
