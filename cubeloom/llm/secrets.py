"""Secret scan: candidates by patterns, false positives removed by a random forest.

One regular expression finds candidates: known key formats, private keys with or without their end
line, values of VALUE_LENGTH characters or more assigned to telling names (which may have a prefix or
a tail, as in DB_PASSWORD= and secret_key:), passwords in URLs, values of NAME=value where that is
long, and long bare tokens; a name is no part of its value. Each is described by its length, its character
classes and transitions, the part covered by dictionary words, its path, and the neighbouring words;
a random forest trained on labelled findings says whether it is a secret.

A text is scanned, described, judged and redacted inside its own row: the forest that pyspark.ml
trains becomes arrays of nodes, and a candidate walks down them by built-in expressions. So there
are no shuffles, and no row can meet another's findings.

The dictionary is the DICTIONARY_WORDS most frequent whole words of a public vocabulary file (its
lowest ids), or any list of lower-case words that is given. ``labelled_findings`` makes
TRAINING_ROWS labelled findings by seeded rules, the bound of the training set; give ``train`` a
table of your own with the same columns to use real ones.

Defined results: null and empty texts have no candidates. A null path is the empty one. Rows with a
null doc_id are scanned like all others, and repeated rows each have their findings. ``redact``
changes text alone; other columns pass through, whatever their names.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.ml import Model
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TRAINING_ROWS, TREES, DEPTH, SEED = 6_000, 24, 7, 11
THRESHOLD = 0.5
MARK = "[SECRET]"
CONTEXT = 48
_NAMES = "token|secret|passwd|password|passphrase|passcode|pass|pwd|api[_-]?key|access[_-]?key|private[_-]?key|auth[_-]?key|(?<![a-z0-9])key|credentials?"
#: What may stand between a telling name and the sign: secret_key, token2, passwordHash, credentials.
_TAIL = "(?:[_-][A-Za-z0-9_-]{0,31}|[A-Z0-9][A-Za-z0-9]{0,31}|s)?"
_NAMED = rf"(?:(?i:{_NAMES})|(?<=[a-z])Key){_TAIL}"
#: The least length of a value behind a telling name.
VALUE_LENGTH = 4
#: Header lines (RFC 1421) may hold hyphens, the body doesn't.
_HEADERS = r"(?:\s*+[A-Za-z][A-Za-z-]{0,30}+:(?:(?!-----BEGIN)[^\n])*+)*+"
#: A key without its end line: full lines of base64, and a shorter one that is padded or ends the text.
_CUT = r"""(?:(?:\s|\\[rn])*+[A-Za-z0-9+/=]{40,}+)++(?:(?:\s|\\[rn])*+[A-Za-z0-9+/]{1,39}+(?:={1,2}|(?=["'\s]*+(?![\s\S]))))?"""
_PEM = rf"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----{_HEADERS}(?:[^-]*+-----END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----|{_CUT})"
_KNOWN = rf"{_PEM}|(?<![A-Za-z0-9_])(?:AKIA|ASIA)[0-9A-Z]{{16}}(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])gh[pousr]_[A-Za-z0-9]{{36,}}+|(?<![A-Za-z0-9_])xox[abprs]-[A-Za-z0-9-]{{10,}}+|(?<![A-Za-z0-9_])sk_live_[0-9A-Za-z]{{16,}}+|(?<![A-Za-z0-9_])AIza[0-9A-Za-z_-]{{35}}|(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{{10,}}+\.[A-Za-z0-9_-]{{10,}}+\.[A-Za-z0-9_-]{{10,}}+"
#: A long name in front is a bare match of its own, so the name can lie before the match. Looking ahead first is what's cheap.
_SIGN = r"""["']?\s{0,3}[:=]"""
_ASSIGNED = rf"""(?:{_NAMED}|(?={_SIGN})(?<={_NAMED})){_SIGN}\s{{0,3}}["']?(?:{_PEM}|[^\s"'<>,;]{{{VALUE_LENGTH},}}+)"""
#: The password in scheme://user:password@host.
_URL = r"""://[^\s/:@"'<>]*+:[^\s/@"'<>]{3,}+(?=@)"""
#: NAME=value of 20 characters or more under any other name; telling names and known keys inside it are left to their own patterns.
_PAIR = rf"""(?:(?<![A-Za-z0-9_+/=-])(?=[A-Za-z0-9_+/=-]{{20}})(?![A-Za-z0-9_+/=-]*?(?:{_NAMED}{_SIGN}|=(?:{_KNOWN})))[A-Za-z0-9_+/-]{{0,19}}|(?==)(?<=[A-Za-z0-9_+/-]{{20}})(?!=(?:{_KNOWN})))=[A-Za-z0-9_+/=-]{{8,}}+"""
#: '=' is padding at the end only, not what stands between a name and a value.
_BARE = r"""(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{20,}+(?:={1,2}(?!=|["']?[^\s"'<>,;:.)\]}&]))?"""
PATTERN = f"{_KNOWN}|{_ASSIGNED}|{_URL}|{_PAIR}|{_BARE}"
#: Whatever PATTERN matches has a sign of an assignment, or one of these: a test that is much cheaper, for texts that have none.
_HINT = r"[A-Za-z0-9_+/=-]{20}|xox[abprs]-|eyJ|-----BEGIN"
#: The part of an assignment before its value.
_PREFIX = rf"""^(?:://[^\s/:@"'<>]*:|(?:(?i:{_NAMES}|key){_TAIL})?{_SIGN}\s{{0,3}}["']?|[A-Za-z0-9_+/-]{{0,19}}=(?=.{{8}}))"""
#: Words of the dictionary, and the least length of one.
DICTIONARY_WORDS, DICTIONARY_FILE, WORD_LENGTH = 8_000, "word_bpe_49k.json", 4
_BIGRAMS = "th|he|in|er|an|re|on|at|en|nd|ti|es|or|te|of|ed|is|it|al|ar|st|to|nt|ng|se|ha|as|ou|io|le"
_kept: dict = {}
FEATURES = ["length", "digits", "uppers", "hex", "classes", "transitions", "bigrams", "variety", "runs", "words", "known", "assigned", "near_key", "near_hash", "near_example", "in_url", "path_test", "path_config"]


def frequent_words(path: str | None = None, most: int = DICTIONARY_WORDS) -> list[str]:
    """The vocabulary's whole words of WORD_LENGTH letters or more, from its lowest id on."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(DICTIONARY_FILE)
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    mark = model["end_of_word_suffix"]
    ended = (t.removesuffix(mark) for t, _ in sorted(model["vocab"].items(), key=lambda x: x[1]) if t.endswith(mark))
    return [w for w in ended if len(w) >= WORD_LENGTH and w.isascii() and w.isalpha()][:most]


def dictionary_pattern(words: Iterable[str]) -> str:
    """A regular expression that matches the longest of the words, by their common beginnings."""
    root: dict = {}
    for w in words:
        node = root
        for letter in w:
            node = node.setdefault(letter, {})
        node[""] = {}

    def told(node: dict) -> str:
        options = [letter + told(below) for letter, below in sorted(node.items()) if letter]
        body = options[0] if len(options) == 1 and "" not in node else f"(?:{'|'.join(options)})" if options else ""
        return body + "?" if options and "" in node else body

    return told(root) or "(?!)"


def _pattern() -> str:
    if "pattern" not in _kept:
        _kept["pattern"] = dictionary_pattern(frequent_words())
    return _kept["pattern"]


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def features(c: Column, left: Column, right: Column, path: Column, words: str) -> dict[str, Column]:
    """The columns FEATURES of a candidate in its surroundings; words is a dictionary_pattern."""
    size = F.greatest(F.length(c), F.lit(1)).cast("double")
    left, right, path = F.lower(left), F.lower(right), F.lower(path)
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("double")
    return {
        "length": F.log2(size),
        "digits": _count(c, "[0-9]") / size,
        "uppers": _count(c, "[A-Z]") / size,
        "hex": flag(c.rlike("^[0-9a-fA-F]+$")),
        "classes": flag(c.rlike("[0-9]")) + flag(c.rlike("[a-z]")) + flag(c.rlike("[A-Z]")) + flag(c.rlike("[^A-Za-z0-9]")),
        "transitions": _count(c, "(?<=[a-z])[^a-z]|(?<=[A-Z])[^A-Z]|(?<=[0-9])[^0-9]") / size,
        "bigrams": _count(F.lower(c), f"(?={_BIGRAMS})") / size,
        "variety": F.size(F.array_distinct(F.split(c, ""))) / F.least(size, F.lit(64.0)),
        "runs": flag(c.rlike(r"(.)\1{3,}")),
        "words": (size - F.length(F.regexp_replace(F.lower(c), words, ""))) / size,
        "known": flag(c.rlike(f"^(?:{_KNOWN})$")),
        "assigned": flag(left.rlike("[:=]\\s{0,3}[\"']?$")),
        "near_key": flag(left.rlike(f"(?:{_NAMES}|bearer|auth)[^\\n]{{0,12}}$")),
        "near_hash": flag(left.rlike("(?:commit|sha|md5|hash|checksum|digest|uuid|guid|revision|integrity|base64|etag)[^\\n]{0,12}$")),
        "near_example": flag(F.concat(left, F.lit(" "), right).rlike("example|sample|placeholder|dummy|fake|changeme|replace")),
        "in_url": flag(left.rlike("://[^\\s/:@]*:$")),
        "path_test": flag(path.rlike("test|example|sample|mock|fixture|doc")),
        "path_config": flag(path.rlike("config|secret|cred|env|key|deploy|settings")),
    }


def described(found: DataFrame, words: str | None = None) -> DataFrame:
    """found (candidate, left, right, path) with the columns FEATURES."""
    return found.withColumns(features(*(F.col(c) for c in ("candidate", "left", "right", "path")), words or _pattern()))


def labelled_findings(spark: SparkSession, rows: int = TRAINING_ROWS, seed: int = SEED) -> DataFrame:
    """candidate, left, right, path and label (1: secret), made by rule; the same for the same seed."""
    key = lambda salt: f"sha2(concat('{seed}-{salt}-', id), 256)"
    b64 = lambda salt, n: f"substring(regexp_replace(base64(unhex(concat({key(salt)}, {key(salt + 'x')}))), '\\\\s', ''), 1, {n})"
    pick = lambda salt, *options: f"element_at(array({', '.join(repr(o) for o in options)}), cast(conv(substring({key(salt)}, 1, 6), 16, 10) AS int) % {len(options)} + 1)"
    name = f"concat({pick('name', 'token', 'secret', 'api_key', 'apikey', 'password', 'passwd', 'pwd', 'access_key', 'auth_key', 'credential', 'private_key', 'secret_key', 'token_v2', 'passphrase', 'db_pass', 'key', 'clientSecret', 'pass')}, {pick('sign', '=', ' = ', ': ', ':', '\": ')}, {pick('open', '', '\"', chr(39))})"
    quote = pick("quote", "\"", "'", " ", "\n")
    hash_ = pick("hash", "commit ", "sha1 ", "md5: ", "sha256-", "checksum = ", "uuid ", "revision: ", "etag=\"")
    words = lambda *sep: f"concat_ws({pick('sep', *sep)}, {', '.join(pick(f'w{i}', 'service', 'client', 'user', 'data', 'config', 'module', 'handler', 'value', 'index', 'public', 'version', 'component', 'sample', 'there', 'other', 'entire', 'station') for i in range(5))}, cast(id % 97 AS string))"
    env = pick("env", "DB_PASSWORD=", "AWS_SECRET_ACCESS_KEY=", "GITHUB_TOKEN=", "export API_KEY=", "STRIPE_SECRET='", "MY_SERVICE_AUTH_KEY=\"", "DB_PASS=", "SECRET_KEY_BASE=", "ENCRYPTION_KEY: ")
    plain = pick("plain", "LOG_LEVEL=", "class=", "DATA_DIR=", "export MODULE=", "target='", "href=\"")
    phrase = f"concat({', '.join(pick(f'x{i}', 'correct', 'horse', 'battery', 'staple', 'purple', 'monkey', 'dragon', 'winter', 'coffee', 'guitar', 'pepper', 'velvet', 'zebra', 'cactus', 'quartz', 'jigsaw') for i in range(4))})"
    prose = f"concat({', '.join(pick(f'y{i}', 'ein', 'heit', 'ver', 'erbe', 'be', 'keit', 'en', 'ung', 'tion', 'ing', 'than', 'and', 'ly', 'ment', 'ge', 'der', 'schaft', 'ist', 're', 'con') for i in range(8))})"
    long = "least(64, 20 + id % 44)"
    # Short ones: a word with digits, or letters and digits mixed.
    mixed = f"translate({b64('short', '6 + id % 5')}, '/+', '{{}}')"
    joined = f"concat({pick('t1', 'hunter', 'dragon', 'admin', 'qwerty', 'summer', 'letme', 'pepper', 'tiger', 'p4ss', 'r00t', 'blue', 'Monkey')}, {pick('t2', '2', '#', '@', '!', '', '_', '')}, cast(id * 37 % 997 AS string), {pick('t3', '', '!', 'x9', '$', '')})"
    said = pick("said", "true", "false", "null", "none", "None", "string", "required", "optional", "text", "value", "hidden", "undefined", "name", "default", "number", "expired", "invalid", "missing", "yours", "please", "never", "about", "something")
    code = pick("code", "get_token()", "os.environ[", "os.getenv(", "${PASSWORD}", "$SECRET", "{{ token }}", "process.env.API_KEY", "config.get(", "self.password", "request.token", "getpass()", "settings.SECRET_KEY", "lambda", "args.key", "%(token)s", "{token}", "str(value)", "item[0]", "row.key", "[REDACTED]", "x[1]")
    kinds = [
        (1, name, f"substring({key('a')}, 1, element_at(array(32, 40, 64), cast(id % 3 AS int) + 1))"),
        (1, name, b64("b", long)),
        (1, name, f"translate({b64('c', '8 + id % 20')}, '/+', '!@')"),
        (1, pick("k", "", "key ", "use ", "= "), f"concat('AKIA', upper(substring({key('d')}, 1, 16)))"),
        (1, pick("k", "", "push with ", "= "), f"concat('ghp_', substring(regexp_replace({b64('e', 80)}, '[/+=]', 'a'), 1, 36))"),
        (1, pick("k", "bearer ", "authorization: bearer ", "secret "), b64("f", long)),
        (0, hash_, f"substring({key('g')}, 1, element_at(array(32, 40, 64), cast(id % 3 AS int) + 1))"),
        (0, hash_, f"regexp_replace(substring({key('h')}, 1, 32), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '$1-$2-$3-$4-$5')"),
        (0, pick("n", "", "import ", "see ", "the ", "= "), words("_", "-", "/", "")),
        (0, name, words("_", "-", "")),
        (0, name, pick("ph", "your_api_key_here", "xxxxxxxxxxxxxxxx", "changeme_changeme", "example-token-value", "<insert-secret>", "00000000000000000000", "********", "dummy_password_1", "test_token_123")),
        (0, pick("n", "id ", "", "number ", "tel "), f"substring(conv(substring({key('i')}, 1, 15), 16, 10) || conv(substring({key('j')}, 1, 15), 16, 10), 1, cast(20 + id % 8 AS int))"),
        (0, "'data:image/png;base64,'", b64("l", 80)),
        (0, pick("n2", "", "in ", "row ", "the "), f"substring({key('m')}, 1, 40)"),
        (1, env, b64("o", "12 + id % 40")),
        (1, env, phrase),
        (1, pick("k2", "", "stripe ", "STRIPE_KEY=", "key: "), f"concat('sk_live_', translate(substring({key('q')}, 1, cast(16 + id % 9 AS int)), '0123456789', element_at(array('ghijklmnop', '0123456789'), cast(id % 2 AS int) + 1)))"),
        (1, pick("u", "https://user:", "postgres://app:", "DATABASE_URL=mysql://root:", "git clone https://me:"), f"translate({b64('r', '8 + id % 20')}, '/+', '_-')"),
        (1, pick("u2", "https://user:", "amqp://worker:", "redis://default:"), phrase),
        (0, pick("u3", "https://user:", "https://name:", "postgres://user:", "ftp://login:"), pick("ph2", "password", "pass", "secret", "your_password", "********", "changeme", "xxxxxxxx", "<password>")),
        (1, pick("pk", "", "private_key = \"", "\n"), f"concat('-----BEGIN RSA PRIVATE KEY-----', chr(10), repeat(concat({b64('s', 64)}, chr(10)), cast(1 + id % 30 AS int)), '-----END RSA PRIVATE KEY-----')"),
        (1, pick("pk2", "", "private_key = \"", "\n", "key: "), f"concat('-----BEGIN PRIVATE KEY-----', chr(10), repeat(concat({b64('v', 64)}, chr(10)), cast(1 + id % 12 AS int)), {b64('w', 40)})"),
        (1, name, mixed),
        (1, name, joined),
        (0, name, said),
        (0, name, code),
        (0, env, said),
        (0, env, words("_", "-", "")),
        (0, plain, words("_", "-", "/", "")),
        (0, pick("n5", "", "the ", "mit ", "of "), prose),
        (0, pick("n4", "", "export ", "\n", "$"), f"upper({words('_')})"),
        (0, pick("n3", "", "=== ", "\n"), pick("rule", "--------------------1", "====================2", "____________________3", "////////////////////4")),
    ]
    def made(low: int, high: int) -> DataFrame:
        case = lambda i: "CASE " + " ".join(f"WHEN id % {len(kinds)} = {n} THEN {kinds[n][i]}" for n in range(low, high)) + " END"
        path = f"CASE WHEN {case(0)} = 1 THEN {pick('p', 'web', 'config/env', 'deploy/settings', 'app/main', 'forum', '')} ELSE {pick('q', 'web', 'tests/fixture', 'docs/example', 'app/main', 'forum', '', 'config/env')} END"
        base = spark.range(0, rows, 1, 1).where(f"id % {len(kinds)} >= {low} AND id % {len(kinds)} < {high}")
        return base.select(F.expr(case(2)).alias("candidate"), F.expr(case(1)).alias("left"), F.expr(quote).alias("right"), F.expr(path).alias("path"), F.expr(case(0)).cast("double").alias("label"))

    # In three parts, since one expression for all kinds is more than generated code can hold.
    cuts = [len(kinds) * i // 3 for i in range(4)]
    return made(cuts[0], cuts[1]).unionAll(made(cuts[1], cuts[2])).unionAll(made(cuts[2], cuts[3]))


def train(labelled: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = SEED, words: str | None = None) -> Model:
    """A forest of labelled findings (candidate, left, right, path, label)."""
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(described(labelled, words)).select("features", "label").persist()
    try:
        return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, minInstancesPerNode=3).fit(rows)
    finally:
        rows.unpersist()


def flattened(model: Model) -> dict:
    """The forest's nodes, one after the other: the feature and the cut of each, where to go on, and a leaf's share of secrets; a leaf leads to itself."""
    out: dict = {"roots": [], "feature": [], "cut": [], "low": [], "high": [], "share": [], "depth": model.getMaxDepth()}

    def add(node) -> int:
        at = len(out["cut"])
        for name in ("feature", "cut", "share"):
            out[name].append(0)
        out["low"].append(at)
        out["high"].append(at)
        if node.subtreeDepth():
            out["feature"][at], out["cut"][at] = node.split().featureIndex(), node.split().threshold()
            out["low"][at], out["high"][at] = add(node.leftChild()), add(node.rightChild())
        else:
            no, yes = node.impurityStats().stats()
            out["share"][at] = yes / (no + yes)
        return at

    for tree in model.trees:
        out["roots"].append(add(tree._call_java("rootNode")))
    return out


def forest_score(values: Column, forest: dict) -> Column:
    """The forest's probability of a secret for an array of FEATURES."""
    listed = lambda name, kind: F.split(F.lit(",".join(map(repr, forest[name]))), ",").cast(f"array<{kind}>")
    feature, low, high, cut, share = listed("feature", "int"), listed("low", "int"), listed("high", "int"), listed("cut", "double"), listed("share", "double")
    step = lambda at, _: F.when(F.get(values, F.get(feature, at)) <= F.get(cut, at), F.get(low, at)).otherwise(F.get(high, at))
    leaf = lambda root: F.aggregate(F.sequence(F.lit(1), F.lit(forest["depth"])), root, step)
    total = F.aggregate(listed("roots", "int"), F.lit(0.0), lambda sum_, root: sum_ + F.get(share, leaf(root)))
    return F.round(total / len(forest["roots"]), 6)


def default_forest(spark: SparkSession) -> dict:
    """The forest of the made findings, trained once in a session."""
    app = spark.sparkContext.applicationId
    if _kept.get("app") != app:
        _kept["forest"], _kept["app"] = flattened(train(labelled_findings(spark))), app
    return _kept["forest"]


def before_each(lengths: Column, block: int = 64) -> Column:
    """The sum of what stands before each number of an array, by blocks: appending to one long array would copy it at every step."""
    none = F.array().cast("array<bigint>")
    add = lambda acc, x: F.struct((acc["sum"] + x).alias("sum"), F.concat(acc["all"], F.array(acc["sum"])).alias("all"))
    sums = lambda numbers, start: F.aggregate(numbers, F.struct(start.alias("sum"), none.alias("all")), add, lambda acc: acc["all"])
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(lengths) - 1, F.lit(0)) / block)), lambda b: F.slice(lengths, b.cast("int") * block + 1, F.lit(block)))
    total = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("bigint"), lambda x, y: x + y))
    return F.flatten(F.transform(F.arrays_zip(blocks.alias("block"), sums(total, F.lit(0).cast("bigint")).alias("start")), lambda z: sums(z["block"], z["start"])))


def scanned(docs: DataFrame, forest: dict | None = None, path: str = "source", words: str | None = None) -> DataFrame:
    """row (docs' columns), gaps (the texts between matches), found (an array of each match's hit, prefix, candidate, left, right, score); null where none is."""
    forest, words = forest or default_forest(docs.sparkSession), words or _pattern()
    own = F.col(path).cast("string") if path in docs.columns else F.lit("")
    text = F.col("text")
    hinted = F.contains(text, F.lit(":")) | F.contains(text, F.lit("=")) | text.rlike(_HINT)
    hits = F.when(hinted, F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)))
    base = docs.select(F.struct("*").alias("row"), text.alias("text"), F.coalesce(own, F.lit("")).alias("path"), hits.alias("hits"))
    base = base.withColumn("gaps", F.when(F.size("hits") > 0, F.split("text", PATTERN, -1))).drop("text")
    # A value right behind a match (its long name) has that for its left.
    left = f"right(if(i > 0 AND gaps[i] = '', hits[i - 1], gaps[i]), {CONTEXT})"
    found = f"""if(gaps IS NULL, NULL, transform(hits, (h, i) -> struct(h AS hit, regexp_extract(h, {_quoted(_PREFIX)}, 0) AS prefix, {left} AS left, left(gaps[i + 1], {CONTEXT}) AS right)))"""
    base = base.withColumn("found", F.expr(found)).drop("hits")
    part = lambda f: F.struct(f["hit"].alias("hit"), f["prefix"].alias("prefix"), f["hit"].substr(F.length(f["prefix"]) + 1, F.length(f["hit"])).alias("candidate"), F.concat(f["left"], f["prefix"]).alias("left"), f["right"].alias("right"))
    base = base.withColumn("found", F.transform("found", part))
    numbers = lambda f: F.array(*features(f["candidate"], f["left"], f["right"], F.col("path"), words).values())
    base = base.withColumn("numbers", F.transform("found", numbers)).drop("path")
    scores = F.transform("numbers", lambda x: forest_score(x, forest))
    return base.withColumn("found", F.zip_with("found", scores, lambda f, s: f.withField("score", s))).drop("numbers")


def _quoted(pattern: str) -> str:
    """pattern as a literal of SQL."""
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def findings(docs: DataFrame, forest: dict | None = None, path: str = "source", threshold: float = THRESHOLD, words: str | None = None) -> DataFrame:
    """_id (the doc_id), ordinal, start (from 0, in code points), kind, candidate, left, right, score and is_secret: a row for every candidate."""
    found = scanned(docs, forest, path, words)
    length = F.zip_with("found", F.slice("gaps", 1, F.size("found")), lambda f, gap: (F.length(f["hit"]) + F.length(gap)).cast("bigint"))
    each = found.select(F.col("row.doc_id").alias("_id"), "gaps", "found", length.alias("length")).withColumn("before", before_each(F.col("length")))
    # Outer: from an inner one Spark infers a filter, and pushes it, with the search that it needs, below the search.
    each = each.select("_id", F.posexplode_outer(F.arrays_zip("found", "before", F.slice("gaps", 1, F.size("found")).alias("gap"))).alias("ordinal", "f")).where("f IS NOT NULL")
    c = F.col("f.found")
    kind = F.when(F.length(c["prefix"]) > 0, "assigned").when(c["hit"].rlike(f"^(?:{_KNOWN})$"), "known").otherwise("bare")
    start = F.col("f.before") + F.length("f.gap") + F.length(c["prefix"])
    return each.select("_id", "ordinal", start.alias("start"), kind.alias("kind"), c["candidate"].alias("candidate"), c["left"].alias("left"), c["right"].alias("right"), c["score"].alias("score"), (c["score"] >= threshold).alias("is_secret"))


def redact(docs: DataFrame, forest: dict | None = None, path: str = "source", mark: str = MARK, threshold: float = THRESHOLD, words: str | None = None) -> DataFrame:
    """docs with every secret in text replaced by mark; all else of the text stays."""
    told = lambda f: F.concat(f["prefix"], F.when(f["score"] >= threshold, F.lit(mark)).otherwise(f["candidate"]))
    pieces = F.zip_with("gaps", F.concat(F.transform("found", told), F.array(F.lit(""))), lambda gap, told: F.concat(gap, told))
    text = F.when(F.col("found").isNull(), F.col("row.text")).otherwise(F.array_join(pieces, ""))
    return scanned(docs, forest, path, words).select(F.col("row").withField("text", text).alias("row")).select("row.*")
