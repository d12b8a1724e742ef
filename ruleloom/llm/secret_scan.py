"""Secret scans with a random forest that removes false positives; DataFrame functions only.

A pattern finds candidates: runs of 12 or more letters, digits, `_`, `+`, `/`, `-`; keys with a known beginning, also within
a run; and whatever is assigned to a name with a secret word in it, of any length and alphabet. Each is described by its
length, how often the kind of character changes, how much of it a dictionary covers, the document's path (source) and the
words around it. The forest is trained by Spark ML from labelled findings and turned into a column expression, so that
a scan is one map over the documents: no shuffle, no Python.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_RUN = "[A-Za-z0-9_+/-]"
#: Keys known by their beginning; a run is cut before one, so that no path or rule in front hides it.
KEY = r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[A-Z0-9]{16,}+|gh[oprsu]_[A-Za-z0-9]{16,}+|glpat-[A-Za-z0-9_-]{16,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|sk[-_][A-Za-z0-9_-]{16,}+|AIza[A-Za-z0-9_-]{30,}+|eyJ[A-Za-z0-9_-]{8,}+(?:\.[A-Za-z0-9_-]++)*+)"
_BODY = f"(?:(?!----|____|////|{KEY}){_RUN}){{12,}}+"
CANDIDATE = f"{KEY}|(?:(?<!{_RUN})|(?<=----|____|////)(?![_/-])){_BODY}"
#: Characters before and after a candidate that count as its neighbourhood.
NEAR = 32
# What the features look for.
SECRET_WORDS = "password|passwd|pwd|secret|token|credential|bearer|authorization|apikey|api_key|api-key|access_key|private_key"
HARMLESS_WORDS = "commit|sha|md5|checksum|digest|uuid|revision|version|order|invoice|card|phone|isbn|example|sample|build|issue|page|http"
PREFIXES = "AKIA|ASIA|ghp_|gho_|ghs_|glpat-|xoxb-|xoxp-|sk-|sk_live_|AIza|eyJ"
DICTIONARY = "password|example|sample|secret|change|dummy|token|test|user|admin|default|your|here|some|value|name|word|this|that|with|from|have|will|and|the|for|you|not|are|key|foo|bar|abc|xxx|ing|ion|ent|ter|er|re|on|an|in|at|es|or|ti|st|en|ed|it|ou|al"
PATH_WORDS = "test|example|sample|doc|fixture|mock|demo"
#: Values that stand for another one: types, empty values, variables, calls, addresses, notes to fill in.
STAND_IN = r"^(?:str|string|int|integer|bool|boolean|bytes|char|text|none|null|nil|true|false|undefined|optional|any|object|required|yes|no|bearer|basic|todo|tbd|x+|[*.-]+)[^a-z0-9]*$|^(?:<|\$|\{|%|https?:|\[secret|os\.|env\.|process\.|self\.|this\.|config\.|settings\.|args\.|request\.)|^[a-z_][a-z0-9_.]*[(\[]|your[_-]|example|placeholder|redacted|[_-]here|change_?me"
REDACTED = "[secret]"

#: A name with a secret word, what assigns, and the quote or scheme before the value.
_ASSIGN = rf"(?=[abcpstABCPST])(?i:{SECRET_WORDS})[A-Za-z0-9_.-]{{0,24}}(?:\\?[\"'])?\]?\s*+(?:=>|:=|==?|:)\s*+(?:\\?[\"'])?(?:(?i:bearer|basic|token)[ \t]++)?"
#: Up to the closing quote of the line; without one up to a quote, white space, closing marks or the next name that is assigned.
_VALUE = r"(?:(?<=\")[^\"\\\r\n]++(?=\\?\")|(?<=')[^'\\\r\n]++(?=\\?')|(?:(?![&;,][A-Za-z0-9_.-]{1,32}[=:]|[,;.)\]}>\\]{1,8}+(?:[\s\"']|\z))[^\s\"'])++)"
#: Directories in front of a run.
_PATH = f"(?<!{_RUN})(?:[a-z_-]{{0,32}}+/){{3,}}+(?={_RUN}{{12}})"
#: All candidates with what precedes a value; and that alone, at a candidate's beginning.
FOUND = f"{_ASSIGN}{_VALUE}|{_PATH}{_BODY}|{CANDIDATE}"
LEADING = f"^(?:{_ASSIGN}(?=.)|{_PATH})"

FEATURES = ["length", "transitions", "distinct", "digits", "upper", "covered", "hex", "digits_only", "prefix", "secret_near", "harmless_near", "assigned", "path", "letters", "marks", "stand_in", "quoted", "equals", "kinds", "given"]


def features(found: Column, left: Column, right: Column, path: Column) -> list[Column]:
    """The features of a finding, as doubles in the order of FEATURES."""
    n = F.greatest(F.length(found), F.lit(1)).cast("double")
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(found, "[a-z]+", "a"), "[A-Z]+", "A"), "[0-9]+", "0")

    def flag(c: Column) -> Column:
        return F.coalesce(c, F.lit(False)).cast("double")

    before = F.lower(left)
    named = flag(before.rlike(f"(?:{SECRET_WORDS})(?:[^a-z0-9]{{0,6}}|[a-z0-9_.-]{{0,24}}[^a-z0-9]{{0,3}}[=:][^a-z0-9]{{0,4}}|[^a-z0-9]{{0,6}}(?:bearer|basic|token)\\s+)$"))
    stand_in = flag(F.lower(found).rlike(STAND_IN))
    variety = sum((flag(found.rlike(c)) for c in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]")), F.lit(0.0))
    return [
        n,
        (F.length(kinds) - 1) / n,
        F.size(F.array_distinct(F.split(found, ""))) / n,
        F.length(F.regexp_replace(found, "[^0-9]", "")) / n,
        F.length(F.regexp_replace(found, "[^A-Z]", "")) / n,
        (n - F.length(F.regexp_replace(F.lower(found), f"(?:{DICTIONARY})", ""))) / n,
        flag(found.rlike("^[0-9a-f]+$")),
        flag(found.rlike("^[0-9_+/-]+$")),
        flag(found.rlike(f"^(?:{PREFIXES})")),
        named,
        flag(before.rlike(f"(?:{HARMLESS_WORDS})[^\\n]{{0,12}}$") | F.lower(right).rlike("^[^\\n]{0,3}(?:example|placeholder)")),
        flag(left.rlike("[=:]\\s*[\"']?$")),
        flag(F.lower(path).rlike(PATH_WORDS)),
        flag(found.rlike("^[A-Za-z]+$")),
        F.length(F.regexp_replace(found, "[A-Za-z0-9]", "")) / n,
        stand_in,
        flag(left.rlike("[\"']$")),
        flag(left.rlike("=\\s*[\"']?$")),
        variety,
        named * (F.lit(1.0) - stand_in) * variety,
    ]


def labelled_findings(spark: SparkSession, n: int = 4000, held_out: bool = False) -> DataFrame:
    """(found, before, after, path, label): n synthetic findings by a rule, for want of a labelled table, so always the same;
    with held_out others, whose neighbours, names and words are of other lists.

    Secrets: hexadecimal, mixed, letters-only, short and punctuated values that are assigned, keys with a known beginning with
    and without a digit, bearer headers. Not secrets: digests and commits, identifiers, numbers, placeholders, types, calls and
    short words that are assigned, long and made-up words, names of code, paths, rules, words with a number, keys of test paths."""
    i = F.col("id")
    part = 1 if held_out else 0

    def digest(salt: str) -> Column:
        return F.sha2(F.concat(F.lit(f"{salt}{'-other' if held_out else ''}"), i.cast("string")), 256)

    def base64(salt: str) -> Column:
        return F.regexp_replace(F.base64(F.unhex(digest(salt))), "[=]", "")

    def draw(least: int, most: int, salt: int) -> Column:
        return (F.pmod(F.xxhash64("id", F.lit(salt + 100 * part)), F.lit(most - least + 1)) + least).cast("int")

    def one(words: list[str], salt: int) -> Column:
        """From the even places, held out from the odd."""
        some = words[part::2]
        return F.element_at(F.array(*(F.lit(w) for w in some)), draw(1, len(some), salt))

    def cut(c: Column, least: int, most: int, salt: int) -> Column:
        return F.substr(c, F.lit(1), draw(least, most, salt))

    base: list[tuple[str, Column]] = []

    def held(name: str, c: Column) -> Column:
        """A column made once for all kinds, after those that it needs."""
        base.append((name, c))
        return F.col(name)

    hexa = held("hexa", digest("h"))
    mixed = held("mixed", base64("m"))
    upper = held("upper", F.upper(F.regexp_replace(base64("u"), "[+/=0189]", "7")))
    digits = held("digits", F.regexp_replace(hexa, "[a-f]", "4"))
    letters = held("letters", F.translate(F.lower(base64("l")), "0123456789+/", "bcdfghjkmnpq"))
    plain = ["the", "see", "then", "and", "under", "with", "when", "found", "nation", "server", "heart", "value", "onder", "users", "call", "into"]
    word = held("word", one(plain, 1))
    words = ["correct", "battery", "horse", "monkey", "staple", "dragon", "sunshine", "river", "purple", "winter", "garden", "shadow", "orange", "coffee", "mountain", "guitar", "summer", "letmein"]
    phrase = held("phrase", F.concat(one(words, 11), one(words, 12), F.when(draw(0, 1, 13) == 1, one(words, 14)).otherwise(F.lit(""))))
    name = held("name", one(["password=", "passwd=", "token = \"", "secret = '", "secret: ", "token: ", "api_key=", "apikey: ", "passwd: ", "pwd: ", "DB_PASSWORD=", "ADMIN_SECRET=", "\"client_secret\": \"", "\"password\": \"", "access_key = ", "credential = "], 2))
    firm = held("firm", one(["password=", "passwd=", "pwd = \"", "secret=\"", "db_password: \"", "user_password: '", "token='", "api_key = '"], 3))
    loose = held("loose", one(["password: ", "token: ", "secret: ", "credential: ", "passwd: ", "api key, secret: "], 4))
    other = held("other", one(["commit ", "digest ", "sha1: ", "sha256:", "md5 ", "checksum: ", "uuid=", "build ", "revision ", "version="], 5))
    header = held("header", one(["Authorization: Bearer ", "authorization: token ", "Authorization: Basic ", "bearer ", "\"Authorization\": \"Bearer ", "-H 'Authorization: Bearer "], 6))
    short = held("short", F.concat(F.initcap(one(words, 15)), cut(digits, 1, 4, 16), one(["!", "&3", "#", "@9", "$", "?x", "*", "%7"], 17)))
    stand_in = held("stand_in", one(["string", "str", "None", "null", "true", "undefined", "os.environ[", "process.env.TOKEN", "${TOKEN}", "$SECRET", "<token>", "<password>", "get_token()", "request.args", "self.token", "config.secret", "********", "xxxxxxxx", "changeme", "your-token", "your_password_here", "https://example.org/a", "{{ token }}", "https://docs.site/x"], 18))
    long_word = held("long_word", one(["internationalization", "characteristically", "acknowledgements", "responsibilities", "straightforward", "misunderstanding", "electromagnetic", "Verantwortungsbewusstsein", "Geschwindigkeitsbegrenzung", "extraordinairement", "developpement", "responsabilidades", "especificaciones", "counterproductive", "transformational", "disproportionately"], 19))
    code = held("code", one(["get_user_name_from_id", "read_all_the_lines", "SimpleNamespaceFactory", "AbstractWidgetBuilder", "end-to-end-encryption", "state-of-the-art", "MAX_RETRY_COUNT", "DEFAULT_TIMEOUT_MS", "/usr/local/lib/python", "/var/log/nginx/access", "src/main/java/org", "com/company/service", "onMouseEnterHandler", "createElementNode", "well-known-address", "long-term-support"], 20))
    rule = held("rule", one(["____________", "------------", "------------------------", "////////////", "+-----+-----+", "________________", "-+-+-+-+-+-+-", "/-/-/-/-/-/-/"], 21))
    dated = held("dated", F.concat(one(["report", "backup", "image", "photo"], 22), F.lit("-20"), F.substr(digits, F.lit(1), F.lit(2)), F.lit("-"), F.substr(digits, F.lit(3), F.lit(2)), F.lit("-"), F.substr(digits, F.lit(5), F.lit(2))))
    syllables = ["bra", "ken", "lo", "mis", "tur", "vel", "schaf", "dren", "pou", "quin", "zar", "gles", "fi", "nort", "hab", "cux", "wim", "pel", "jo", "stru"]
    spoken = held("spoken", F.concat(*(one(syllables, 60 + k) for k in range(4)), F.when(draw(0, 1, 64) == 1, one(syllables, 65)).otherwise(F.lit(""))))
    spoken = held("spoken_word", F.when(draw(0, 1, 66) == 1, F.initcap("spoken")).otherwise(F.col("spoken")))
    marked = held("marked", F.translate(cut(mixed, 4, 9, 67), "aeiouAEIOU26+/", "$@!#%&*?^~.-$!"))
    said = F.concat(word, F.lit(" "))
    src = one(["src", "app", "web", "docs/guide", "lib", "deploy", "mail", "notes"], 23)
    grouped = F.concat_ws("-", F.substr(hexa, F.lit(1), F.lit(8)), F.substr(hexa, F.lit(9), F.lit(4)), F.substr(hexa, F.lit(13), F.lit(4)), F.substr(hexa, F.lit(17), F.lit(4)), F.substr(hexa, F.lit(21), F.lit(12)))
    kinds = [
        (cut(hexa, 14, 64, 31), name, src, 1),
        (F.substring(hexa, 1, 40), name, src, 1),
        (F.concat(F.lit("AKIA"), F.substring(upper, 1, 16)), said, src, 1),
        (F.concat(F.lit("AKIA"), F.translate(F.substring(upper, 1, 16), "234567", "BCDFGH")), said, src, 1),
        (F.concat(F.lit("ghp_"), F.substring(base64("m"), 1, 36)), said, src, 1),
        (cut(mixed, 12, 43, 32), name, src, 1),
        (cut(F.regexp_replace(mixed, "[+/]", ""), 7, 14, 33), firm, src, 1),
        (cut(letters, 8, 24, 34), firm, src, 1),
        (cut(letters, 14, 30, 35), loose, src, 1),
        (phrase, firm, src, 1),
        (F.concat(phrase, one(words, 36)), loose, src, 1),
        (F.concat_ws(" ", one(words, 37), one(words, 38), one(words, 39)), F.lit("password = \""), src, 1),
        (short, name, src, 1),
        (F.concat(short, cut(hexa, 1, 3, 40)), name, src, 1),
        (F.concat(F.lower(short), F.lit("!")), name, src, 1),
        (F.concat(marked, F.lit("$k")), name, src, 1),
        (cut(mixed, 20, 43, 41), header, src, 1),
        (F.concat(F.lit("eyJ"), cut(mixed, 15, 20, 42), F.lit(".eyJ"), cut(base64("j"), 20, 40, 43), F.lit("."), cut(base64("k"), 30, 43, 44)), F.when(draw(0, 1, 45) == 1, header).otherwise(said), src, 1),
        (F.concat(F.lit("xoxb-"), F.substring(digits, 1, 11), F.lit("-"), F.regexp_replace(cut(mixed, 24, 32, 46), "[+/]", "")), said, src, 1),
        (F.concat(F.lit("AIza"), F.substring(F.regexp_replace(F.concat(mixed, base64("z")), "[+/]", "-"), 1, 35)), said, src, 1),
        (F.concat(one(["sk-", "sk_live_"], 47), F.regexp_replace(cut(mixed, 24, 43, 48), "[+/]", "")), said, src, 1),
        (F.substring(F.concat(mixed, base64("p")), 1, 64), one(["BEGIN RSA PRIVATE KEY-----\n", "BEGIN PRIVATE KEY-----\n"], 49), src, 1),
        (F.concat(mixed, base64("q")), F.lit("\n"), src, 1),
        (F.substring(hexa, 1, 40), other, src, 0),
        (cut(hexa, 32, 64, 50), other, src, 0),
        (cut(hexa, 12, 64, 51), said, src, 0),
        (cut(digits, 12, 19, 52), said, src, 0),
        (grouped, F.when(draw(0, 1, 53) == 1, other).otherwise(said), src, 0),
        (F.concat(word, word, word, word, F.lit("2")), said, src, 0),
        (F.concat(F.lit("your_password_here_"), F.substring(digits, 1, 2)), name, src, 0),
        (stand_in, name, src, 0),
        (stand_in, loose, src, 0),
        (word, loose, src, 0),
        (one(["nobody", "nothing", "keep", "always", "everyone", "valid", "expired", "missing", "it", "must"], 54), loose, src, 0),
        (F.substring(digits, 1, 2), loose, src, 0),
        (long_word, said, src, 0),
        (spoken, said, src, 0),
        (spoken, F.concat(word, F.lit(". ")), src, 0),
        (F.concat(word, F.lit("/"), long_word), said, src, 0),
        (code, said, src, 0),
        (F.concat(code, F.lit("_"), word), F.lit("= "), src, 0),
        (rule, said, src, 0),
        (dated, said, src, 0),
        (F.substring(mixed, 1, 24), said, F.lit("tests/fixture"), 0),
    ]
    pick = F.pmod(i, F.lit(len(kinds)))

    def case(k: int) -> Column:
        return reduce(lambda c, j: c.when(pick == j, F.lit(kinds[j][k]) if k == 3 else kinds[j][k]), range(1, len(kinds)), F.when(pick == 0, F.lit(kinds[0][k]) if k == 3 else kinds[0][k]))

    rows = reduce(lambda df, x: df.withColumn(*x), base, spark.range(n))
    return rows.select(case(0).alias("found"), F.concat(word, F.lit(" "), case(1)).alias("before"), F.concat(F.lit(" "), word).alias("after"), case(2).alias("path"), case(3).alias("label"))


class Forest:
    """Trees as nested tuples: (feature, threshold, low, high) or a leaf's probability."""

    def __init__(self, trees: list):
        self.trees = trees

    @staticmethod
    def train(labelled: DataFrame, trees: int = 15, depth: int = 5, seed: int = 7) -> Forest:
        """From (found, before, after, path, label 0/1); rows without a finding or label are left out. Statistics of all the
        labelled rows are summed over the cluster."""
        from pyspark.ml.classification import RandomForestClassifier
        from pyspark.ml.feature import VectorAssembler

        rows = labelled.where("found is not null and label is not null")
        columns = [c.alias(name) for c, name in zip(features(F.col("found"), F.coalesce("before", F.lit("")), F.coalesce("after", F.lit("")), F.col("path")), FEATURES, strict=True)]
        data = VectorAssembler(inputCols=FEATURES, outputCol="x").transform(rows.select(*columns, F.col("label").cast("double").alias("label")))
        model = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed).fit(data.select("x", "label"))

        def node(n):
            if n.subtreeDepth() == 0:
                stats = list(n.impurityStats().stats())
                return stats[1] / sum(stats) if len(stats) > 1 and sum(stats) else 0.0
            return (n.split().featureIndex(), n.split().threshold(), node(n.leftChild()), node(n.rightChild()))

        return Forest([node(t.rootNode()) for t in model._java_obj.trees()])

    def probability(self, of: list[Column]) -> Column:
        def case(n) -> Column:
            return F.when(of[n[0]] <= n[1], case(n[2])).otherwise(case(n[3])) if isinstance(n, tuple) else F.lit(float(n))

        return reduce(lambda a, b: a + b, map(case, self.trees)) / len(self.trees)

    def of(self, values: list[float]) -> float:
        def walk(n):
            while isinstance(n, tuple):
                n = n[2] if values[n[0]] <= n[1] else n[3]
            return n

        return reduce(lambda a, b: a + b, map(walk, self.trees)) / len(self.trees)


_trained: dict[str, Forest] = {}


def default_forest(spark: SparkSession) -> Forest:
    if "default" not in _trained:
        _trained["default"] = Forest.train(labelled_findings(spark))
    return _trained["default"]


def scan_secrets(documents: DataFrame, forest: Forest | None = None, path: str = "source", threshold: float = 0.5) -> DataFrame:
    """All columns with findings [(place, found, probability, secret)], n_candidates, n_secrets, score and redacted.

    place is the candidate's number in the text; score the largest probability (0 without candidates); redacted the text with
    every secret replaced. A null text has no findings and stays null. The same string may be a secret in one place and not
    in another. Whole texts; each row is its own; the work grows with the text's length alone."""
    forest = forest or default_forest(documents.sparkSession)
    between, found = F.split("text", FOUND, -1), F.regexp_extract_all("text", F.lit(FOUND), F.lit(0))
    kind = "array<struct<found:string,lead:string,before:string,after:string>>"

    def near(i: Column) -> Column:
        whole, lead = F.get("__found", i), F.get("__lead", i)
        left = F.concat(F.right(F.get("__between", i), F.lit(NEAR)), F.regexp_replace(lead, r"\s+", " "))
        return F.struct(F.substr(whole, F.length(lead) + 1).alias("found"), lead.alias("lead"), F.right(left, F.lit(NEAR)).alias("before"), F.left(F.get("__between", i + 1), F.lit(NEAR)).alias("after"))

    pairs = F.transform(F.sequence(F.lit(0), F.size("__found") - 1), near)
    df = documents.withColumn("__found", F.coalesce(found, F.array().cast("array<string>"))).withColumn("__between", between)
    df = df.withColumn("__lead", F.transform("__found", lambda x: F.regexp_extract(x, LEADING, 0)))
    df = df.withColumn("__near", F.when(F.size("__found") > 0, pairs).otherwise(F.array().cast(kind)))
    df = df.withColumn("__x", F.transform("__near", lambda c: F.struct(c["found"].alias("found"), *(x.alias(name) for x, name in zip(features(c["found"], c["before"], c["after"], F.coalesce(F.col(path), F.lit(""))), FEATURES, strict=True)))))
    df = df.withColumn("__p", F.transform("__x", lambda c: F.struct(c["found"].alias("found"), forest.probability([c[name] for name in FEATURES]).alias("probability"))))
    df = df.withColumn("findings", F.transform("__p", lambda c, i: F.struct(i.cast("long").alias("place"), c["found"].alias("found"), c["probability"].alias("probability"), (c["probability"] >= threshold).alias("secret"))))
    secret = F.filter("findings", lambda c: c["secret"])
    whole = F.array_join(F.transform("__between", lambda t, i: F.concat(t, F.coalesce(F.get("__lead", i), F.lit("")), F.coalesce(F.when(F.get("findings", i)["secret"], F.lit(REDACTED)).otherwise(F.get("findings", i)["found"]), F.lit("")))), "")
    df = df.withColumn("n_candidates", F.size("findings").cast("long")).withColumn("n_secrets", F.size(secret).cast("long")).withColumn("score", F.coalesce(F.array_max(F.transform("findings", lambda c: c["probability"])), F.lit(0.0)))
    df = df.withColumn("redacted", F.when(F.col("n_secrets") > 0, whole).otherwise(F.col("text")))
    return df.drop("__found", "__lead", "__between", "__near", "__x", "__p")
