"""Secret scan: candidates by pattern, false positives removed by a random forest.

A candidate is a maximal run of characters of ``[A-Za-z0-9_+/=.-]`` that holds
a digit and a letter among 9 or more, or a known prefix of keys; or any value
after a secret-like name and ``=`` or ``:``, whatever its characters or length,
unless such a run holds it whole; or a private key block. The forest sees its
length, its changes between kinds of characters and how likely each character
is after the one before it, how much of it words of a dictionary cover, whether
its document's path looks like a test file's, and the words around it.

The dictionary and the likelihoods are learned from the documents themselves:
words are counted over all whole texts, the commonest make the dictionary, and
the counts of their pairs of characters the likelihoods. Both are kept in one
row of fixed size, whatever the corpus. All of it is column expressions and
Spark's own learner; there is no Python on the executors.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, stored

_RUN = r"A-Za-z0-9_+/=.\-"
_KNOWN = r"(?:(?:AKIA|ASIA|AGPA|AIDA|AROA|ANPA)[A-Z0-9]{12}|gh[opsur]_[A-Za-z0-9]{8}|(?:github_pat_|glpat-|xox[abeoprs]-|[prs]k_(?:live|test)_|npm_|pypi-|hf_|dop_v1_|shp(?:at|ca|pa|ss)_|sk-)[A-Za-z0-9_\-]{8}|AIza[A-Za-z0-9_\-]{16}|eyJ[A-Za-z0-9_\-]{16}|ya29\.|SG\.[A-Za-z0-9_\-]{8})"
CANDIDATE = rf"(?<![{_RUN}])(?:(?=[A-Za-z_+/=.\-]*+[0-9])(?=[0-9_+/=.\-]*+[A-Za-z])[{_RUN}]{{9,}}+|(?=[{_RUN}]*?(?<![A-Za-z0-9]){_KNOWN})[{_RUN}]{{9,}}+)"
_NAME = r"(?:pass(?:words?|wd|phrase|code)|pass(?![A-Za-z])|pwd|secret|token|api[_.\- ]?key|access[_.\- ]?key|auth(?!or(?!i))|bearer|credential|private[_.\- ]?key)"
#: Each match of the names holds one of these.
_NEEDED = ("pass", "pwd", "secret", "token", "key", "auth", "bearer", "credential")
#: A secret-like name, = or :, and in group 1 the value: to the closing quote where it is quoted, else to the next blank or quote. What is itself a name before a value is none.
NAMED = rf"(?i){_NAME}[\w.\-]{{0,40}}+[\"'`\])]{{0,3}}+[ \t]*+(?::=|=>|={{1,3}}+|:)[ \t]*+(?:(?:bearer|basic)[ \t]++)?+" + rf"(?:[\"'`]?+)((?<=\")[^\"\\\r\n]*+(?:\\.[^\"\\\r\n]*+){{0,100}}+(?<!\")|(?<=')[^'\\\r\n]*+(?:\\.[^'\\\r\n]*+){{0,100}}+(?<!')|(?<=`)[^`\r\n]++|(?<![\"'`])(?![\w.\-{{\[(]{{0,60}}{_NAME}[\w.\-]{{0,40}}[ \t]?[:=]+[\"'`\s])(?![{{\[(]+[\"'`\s])[^\s\"'`]++)"
PEM = r"-----BEGIN (?:[A-Z0-9]{1,12} ){0,3}PRIVATE KEY-----(?:\s*+[A-Za-z0-9+/=]{16,}+)*+(?:\s*+[A-Za-z0-9+/=]{0,15}+\s*+-----END (?:[A-Z0-9]{1,12} ){0,3}PRIVATE KEY-----)?+"
#: The commonest words that make the dictionary, its bits (a power of two), the characters whose pairs are counted (others count as one more), and what each pair is counted beyond its occurrences.
WORDS, BITS, ALPHABET, SMOOTHING = 20_000, 1 << 18, "abcdefghijklmnopqrstuvwxyz0123456789", 0.5
_NAMING = r"(?i)(pass(word|wd|phrase)?|pwd|secret|token|api.?key|access.?key|auth|bearer|credential|private.?key|client.?secret)"
FEATURES = ["f_length", "f_digits", "f_upper", "f_lower", "f_to_digit", "f_from_digit", "f_to_upper", "f_to_lower", "f_likely", "f_unlikely", "f_distinct", "f_hex", "f_covered", "f_slashes", "f_dots", "f_test_path", "f_named", "f_assigned", "f_quoted", "f_known", "f_marks", "f_call"]


def _count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """doc_id, start (characters before it), value, before (up to 40 characters), after (up to 2), path: every candidate of every whole text.

    A null or empty text has none; neither does an empty table.
    """
    path = F.coalesce(F.col(path_col).cast("string"), F.lit("")) if path_col else F.lit("")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), path.alias("path"))
    runs = _matches(rows, CANDIDATE, 0).select("doc_id", "start", "value", F.right("left", F.lit(40)).alias("before"), F.left("right", F.lit(2)).alias("after"), "path")
    lowered = F.lower("text")  # searched for plain strings first, which is much cheaper than the pattern that needs one of them
    holds = reduce(lambda a, b: a | b, (lowered.contains(x) for x in _NEEDED)) & (F.col("text").contains("=") | F.col("text").contains(":"))
    named = _matches(rows.filter(holds), NAMED, 1).filter("value <> ''")
    around = F.concat(F.regexp_extract("left", rf"(?<![{_RUN}])[{_RUN}]++$", 0), F.col("value"), F.regexp_extract("right", rf"^[{_RUN}]*+", 0))
    held = F.col("value").rlike(rf"^[{_RUN}]++$") & around.rlike(rf"^{CANDIDATE}$")
    named = named.filter(~held).select("doc_id", "start", "value", F.right("left", F.lit(40)).alias("before"), F.left("right", F.lit(2)).alias("after"), "path")
    blocks = _matches(rows.filter(F.col("text").contains("PRIVATE KEY-----")), PEM, 0).select("doc_id", "start", "value", F.right("left", F.lit(40)).alias("before"), F.left("right", F.lit(2)).alias("after"), "path")
    return runs.unionByName(named).unionByName(blocks)


def running_ends(sizes: Column) -> Column:
    """Of an array of longs, what each and all before it add up to. Sums go by pieces of about the root of its size, as an array that grows by one is copied each time."""
    empty = F.array().cast("array<bigint>")
    add = lambda total, x: F.concat(total, F.array(F.element_at(total, -1) + x))

    def of(step: Column) -> Column:
        pieces = F.transform(F.sequence(F.lit(1), F.size(sizes), step), lambda at: F.slice(sizes, at, step))
        totals = F.transform(pieces, lambda piece: F.aggregate(piece, F.lit(0).cast("long"), lambda a, x: a + x))
        before = F.aggregate(totals, F.array(F.lit(0).cast("long")), add)
        inside = lambda piece, first: F.slice(F.aggregate(piece, F.array(first), add), F.lit(2), F.size(piece))
        return F.flatten(F.zip_with(pieces, F.slice(before, F.lit(1), F.size(pieces)), inside))

    step = F.ceil(F.sqrt(F.size(sizes))).cast("int")
    return F.when(F.size(sizes) > 0, F.transform(F.array(step), of)[0]).otherwise(empty)


def _matches(rows: DataFrame, pattern: str, group: int) -> DataFrame:
    """doc_id, path, start, value, left (from the match before to the value), right (to the next match): the group, which ends its match, of every match in text."""
    rows = rows.filter(F.col("text").rlike(pattern))
    rows = rows.withColumns({"found": F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), "value": F.regexp_extract_all("text", F.lit(pattern), F.lit(group)), "between": F.split("text", pattern, -1)})
    rows = rows.withColumn("sizes", F.zip_with("found", F.slice("between", 1, F.size("found")), lambda m, b: (F.length(b) + F.length(m)).cast("long")))
    rows = rows.select("doc_id", "path", F.explode(F.arrays_zip("found", "value", running_ends(F.col("sizes")).alias("ends"), F.slice("between", 1, F.size("found")).alias("b"), F.slice("between", 2, F.size("found")).alias("a"))).alias("x"))
    lead = F.left("x.found", F.length("x.found") - F.length("x.value"))
    return rows.select("doc_id", "path", (F.col("x.ends") - F.length("x.value")).alias("start"), F.col("x.value").alias("value"), F.concat("x.b", lead).alias("left"), F.col("x.a").alias("right"))


def _pair(text: Column, at: Column) -> Column:
    """The number of the pair of characters of a lowered text that begins at ``at``."""
    return F.instr(F.lit(ALPHABET), F.substring(text, at, F.lit(1))) * (len(ALPHABET) + 1) + F.instr(F.lit(ALPHABET), F.substring(text, at + 1, F.lit(1)))


def _places(word: Column) -> list[Column]:
    return [F.pmod(F.xxhash64(word, F.lit(seed)), F.lit(BITS)) for seed in (1, 2)]


def learn_words(docs: DataFrame, text_col: str = "text", words: int = WORDS) -> DataFrame:
    """One row: bits (the dictionary as a bitmap, where each word sets two bits) and likely (the logarithm of each character's share after the one before).

    Words are runs of three or more letters, lowered, counted over all whole
    texts; the dictionary holds the ``words`` commonest, ties in their order.
    Null and empty texts have none. Without any word the bitmap is empty and
    all pairs are equally likely.
    """
    spark = docs.sparkSession
    counted = docs.select(F.explode(F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(r"\p{L}{3,}"), F.lit(0))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    common = stored(counted.orderBy(F.desc("n"), "word").limit(words), f"{scratch(spark)}/words")
    set_bits = common.select(F.explode(F.array(*_places(F.col("word")))).alias("bit")).groupBy(F.shiftright("bit", 6).alias("slot")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("bit", F.lit(64)).cast("int"))).alias("x"))
    slots = spark.range(BITS // 64).select(F.col("id").alias("slot")).join(F.broadcast(set_bits), "slot", "left")
    bits = slots.agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", F.coalesce("x", F.lit(0)).alias("x")))), lambda s: s["x"]).alias("bits"))
    wide = len(ALPHABET) + 1
    pairs = common.select("n", F.explode(F.sequence(F.lit(1), F.length("word") - 1)).alias("at"), "word").groupBy(_pair(F.col("word"), F.col("at")).alias("pair")).agg(F.sum("n").alias("n"))
    every = spark.range(wide * wide).select(F.col("id").cast("int").alias("pair")).join(F.broadcast(pairs), "pair", "left")
    every = every.withColumn("n", F.coalesce("n", F.lit(0)) + SMOOTHING)
    of_first = every.groupBy(F.floor(F.col("pair") / wide).alias("first")).agg(F.sum("n").alias("all"))
    share = every.withColumn("first", F.floor(F.col("pair") / wide)).join(F.broadcast(of_first), "first").withColumn("log", F.log(F.col("n") / F.col("all")))
    likely = share.agg(F.transform(F.array_sort(F.collect_list(F.struct("pair", "log"))), lambda s: s["log"]).alias("likely"))
    return stored(bits.crossJoin(likely), f"{scratch(spark)}/learned")  # one row


def with_features(found: DataFrame, learned: DataFrame) -> DataFrame:
    """Candidates with the forest's columns; ``learned`` is the row of ``learn_words``. A name and ``=`` that stand in the run itself count as words before the value, as in ``password=...``."""
    own = F.regexp_extract("value", r"^([A-Za-z_.\-]+=)?(.*)$", 1)
    found = found.crossJoin(F.broadcast(learned))  # one row of about 50 kB
    found = found.withColumns({"_v": F.substring("value", F.length(own) + 1, F.length("value")), "_b": F.concat("before", own)}).withColumn("_l", F.lower("_v"))
    n = F.greatest(F.length("_v"), F.lit(1)).cast("double")
    flag = lambda c: c.cast("double")
    bit = lambda at: F.call_function("shiftright", F.get("bits", F.shiftright(at, 6).cast("int")), F.pmod(at, F.lit(64)).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1
    known = lambda w: bit(_places(w)[0]) & bit(_places(w)[1])
    parts = F.transform(F.regexp_extract_all("_v", F.lit(r"\p{Lu}?\p{Ll}{2,}|\p{Lu}{3,}"), F.lit(0)), F.lower)
    covered = F.aggregate(parts, F.lit(0), lambda a, w: a + F.when((F.length(w) > 2) & known(w), F.length(w)).otherwise(0))
    logs = F.transform(F.sequence(F.lit(1), F.length("_l") - 1), lambda at: F.get("likely", _pair(F.col("_l"), at)))
    found = found.withColumn("_p", F.when(F.length("_l") > 1, logs).otherwise(F.array().cast("array<double>")))
    pairs = F.greatest(F.size("_p"), F.lit(1)).cast("double")
    return found.withColumns({
        "f_length": n,
        "f_digits": _count(F.col("_v"), "[0-9]") / n,
        "f_upper": _count(F.col("_v"), "[A-Z]") / n,
        "f_lower": _count(F.col("_v"), "[a-z]") / n,
        "f_to_digit": _count(F.col("_v"), "(?<=[A-Za-z])(?=[0-9])") / n,
        "f_from_digit": _count(F.col("_v"), "(?<=[0-9])(?=[A-Za-z])") / n,
        "f_to_upper": _count(F.col("_v"), "(?<=[a-z])(?=[A-Z])") / n,
        "f_to_lower": _count(F.col("_v"), "(?<=[A-Z])(?=[a-z])") / n,
        "f_likely": F.aggregate("_p", F.lit(0.0), lambda a, x: a + x) / pairs,
        "f_unlikely": F.size(F.filter("_p", lambda x: x < -6)) / pairs,
        "f_distinct": F.size(F.array_distinct(F.split(F.col("_v"), "(?!^)"))) / n,
        "f_hex": flag(F.col("_v").rlike("^([0-9a-f]+|[0-9A-F]+)$")),
        "f_covered": covered / n,
        "f_slashes": _count(F.col("_v"), "/").cast("double"),
        "f_dots": _count(F.col("_v"), r"\.").cast("double"),
        "f_test_path": flag(F.col("path").rlike("(?i)test|example|sample|fixture|mock")),
        "f_named": flag(F.col("_b").rlike(_NAMING)),
        "f_assigned": flag(F.col("_b").rlike("[=:]\\s*[\"']?$")),
        "f_quoted": flag(F.col("after").rlike("^[\"']")),
        "f_known": flag(F.col("_v").rlike(rf"(?<![A-Za-z0-9]){_KNOWN}|^{PEM}")),
        "f_marks": _count(F.col("_v"), "[!@#$%^&*~?:;|]") / n,
        "f_call": flag(F.col("_v").rlike(r"[(\[{]|^(?i)(str|string|none|null|true|false|bool|int|optional.*|required|undefined)[,;.)]*$")),
    }).drop("_v", "_b", "_l", "_p", "bits", "likely")


def example_findings(spark: SparkSession, n: int = 6000) -> DataFrame:
    """Labelled findings made by rule: credentials of common shapes and their look-alikes (numbers, addresses, hosts, paths, versions, identifiers, digests in prose), each in its context. Columns of ``candidates`` and ``label``."""
    h = lambda k: F.sha2(F.concat_ws("-", "id", F.lit(k)), 256)
    pick = lambda k, *xs: F.element_at(F.array(*(F.lit(x) for x in xs)), (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(xs))) + 1).cast("int"))
    number = lambda k, m: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(m)).cast("string")
    upper = F.upper(F.translate(F.substring(F.regexp_replace(F.base64(F.unhex(h(1))), "[^A-Za-z2-7]", ""), 1, 16), "0189", "ABCD"))
    b64 = F.regexp_replace(F.base64(F.unhex(h(2))), "=+$", "")
    word = F.concat(pick(3, "user", "page", "item", "version", "section", "file", "thing", "number"), pick(4, "Name", "List", "_index", "-report", "Table", "tion"))
    prose = pick(5, "of the ", "and then ", "in ", "see ", "le ", "der ", "que la ")
    shapes = [
        (1, F.substring(h(6), 1, 40), pick(7, 'token = "', 'secret: "', "api_key = '", 'auth_token="', 'password: "'), '"'),
        (1, F.concat(F.lit("password="), F.substring(h(8), 1, 18)), prose, " "),
        (1, F.concat(pick(9, "token=", "secret=", "passwd=", "api_key="), F.substring(b64, 1, 28)), prose, " "),
        (1, F.concat(F.lit("AKIA"), upper), pick(10, "key ", "of the ", "aws ", "est ", "= "), " "),
        (1, b64, pick(11, 'client_secret = "', "Bearer ", "private_key: ", 'access-key = "'), '"'),
        (1, F.concat(F.lit("ghp_"), F.substring(b64, 1, 36)), pick(12, "token ", "use ", "= "), " "),
        (0, F.concat(number(13, 1 << 50), F.lit("kg")), prose, " "),
        (0, F.concat(F.lit("mail"), number(14, 99), F.lit(".example.com")), pick(15, "jo.doe@", "that.92@", "https:"), " "),
        (0, F.concat(word, number(16, 9999), pick(17, "value", "html", "Items", "final")), prose, " "),
        (0, F.concat(F.lit("/en/"), number(18, 99999), F.lit("/index.html")), prose, " "),
        (0, F.concat(pick(19, "v", "rev", "build-"), number(20, 30), F.lit("."), number(21, 99), F.lit("."), number(22, 9999), F.lit("-beta")), pick(23, "version = ", "release ", "at "), " "),
        (0, F.concat(F.lit("2024-"), number(24, 12), F.lit("-1T"), number(25, 24), F.lit("-30-00Z")), pick(26, "date: ", "on ", "am "), " "),
        (0, F.concat(F.substring(h(27), 1, 8), F.lit("-"), F.substring(h(28), 1, 4), F.lit("-4"), F.substring(h(29), 1, 3), F.lit("-"), F.substring(h(30), 1, 12)), pick(31, "id: ", "uuid ", "row "), " "),
        (1, F.concat(pick(40, "Correct", "Silent", "Purple", "Winter"), pick(41, "Horse", "River", "Window", "Falcon"), pick(42, "Battery", "Staple", "Garden", "Copper")), pick(43, 'password = "', 'passwd: "', 'secret="', 'db_password: "'), '"'),
        (1, F.concat(pick(44, "Tr0ub4", "hunter", "qwe", "Zx"), pick(45, "!", "@", "#", "$", "%", "&"), number(46, 9999), pick(47, "~x", ":K", "!", "")), pick(48, "password: ", "password=", "pwd = ", "secret_key: "), pick(49, '"', "\n", " ")),
        (1, number(50, 10**8), pick(51, "password: ", "pass = ", "passcode = ", "token="), pick(52, '"', "\n", " ")),
        (0, pick(53, "str", "None", "getpass()", "get_token(request)", "string,", "true", "config[", "null", "os.environ["), pick(54, "password: ", "token = ", "secret=", "api_key: "), pick(55, " ", "\n", '"')),
        (0, pick(56, "the", "a", "your", "enter", "it", "der", "la", "this", "please"), pick(57, "the password: ", "token: ", "secret: ", "passwords: "), " "),
        (1, F.concat(pick(58, "-----BEGIN PRIVATE KEY-----", "-----BEGIN RSA PRIVATE KEY-----", "-----BEGIN EC PRIVATE KEY-----"), F.lit("\n"), b64), prose, " "),
        (0, F.substring(h(32), 1, 40), pick(33, "commit ", "sha1 of the file ", "digest: ", "checksum "), " "),
    ]
    kind = F.pmod(F.col("id"), F.lit(len(shapes)))
    chosen = [lambda k, j=j: F.coalesce(*(F.when(kind == i, s[j] if isinstance(s[j], Column) else F.lit(s[j])) for i, s in enumerate(shapes))) for j in range(4)]
    path = F.when(F.pmod(F.xxhash64("id", F.lit(34)), F.lit(20)) == 0, "tests/fixtures").otherwise("src")
    return spark.range(n).select(F.col("id").alias("doc_id"), F.lit(0).cast("long").alias("start"), chosen[1](0).alias("value"), chosen[2](0).alias("before"), chosen[3](0).alias("after"), path.alias("path"), chosen[0](0).cast("double").alias("label"))


def train(findings: DataFrame, learned: DataFrame, trees: int = 20, depth: int = 7, seed: int = 11) -> PipelineModel:
    """A forest from labelled findings: the columns of ``candidates`` and ``label`` (1: a secret, 0: not). Findings with a null value or label are left out."""
    rows = with_features(findings.dropna(subset=["value", "label"]), learned)
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="_x", handleInvalid="keep")
    forest = RandomForestClassifier(featuresCol="_x", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed, probabilityCol="_p", rawPredictionCol="_raw", predictionCol="_hit")
    return PipelineModel([assembler, forest.fit(assembler.transform(rows))])


def scan(docs: DataFrame, model: PipelineModel, learned: DataFrame, threshold: float = 0.5, **columns) -> DataFrame:
    """doc_id, start, length, value_sha256, score, is_secret for every candidate of docs. The value itself is not returned."""
    from pyspark.ml.functions import vector_to_array

    scored = model.transform(with_features(candidates(docs, **columns), learned))
    out = scored.select("doc_id", "start", F.length("value").alias("length"), F.sha2("value", 256).alias("value_sha256"), vector_to_array("_p")[1].alias("score"))
    return out.withColumn("is_secret", F.col("score") >= threshold)
