"""Secret scan, with a random forest that removes false findings. DataFrame functions only.

A candidate is a run of 16 or more letters, digits and ``+ / _ -`` (and closing ``=``) within a
white-space token, or the whole value, of 8 characters or more of any kind, that is assigned (by ``=``
or ``:``, in the same token or the one before) to a name that holds a word such as ``password``.

Features of a candidate and its surroundings: length; shares of digits, capitals and symbols; how
varied its characters are and how often they change kind; how natural its letter transitions are; the
share that dictionary words cover; whether it stands in a path or address; and words on either side
that speak for or against a secret. Transitions and dictionary are learned from the scanned texts: one
count of all their words gives the probability of each letter after another, and the ``dictionary``
most frequent words of four letters or more (a short list of common pairs and words is added, so that
a few texts are no worse off). The forest is trained on labelled findings (``labelled``, a small table
written from a rule, or one's own) and drops candidates below ``threshold``.

The texts are read twice and never shuffled; their words are, as counts summed in each task. A text
becomes an array of tokens and neighbours are found by place, so the cost is linear in its length.

Edge cases: null and empty texts have no findings. A candidate that a text holds more than once is
one row for each place. Repeated rows are scanned alike; very long texts are read whole. Columns other
than doc_id and text are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import json
import math
import random
import string
from typing import NamedTuple

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quoteloom.llm.common import written

LEAST = 16
CANDIDATE = f"[A-Za-z0-9+/_-]{{{LEAST},}}={{0,2}}"
VALUE = 8
FINDINGS = 4000
DICTIONARY = 2000
TREES, DEPTH = 30, 8
THRESHOLD = 0.5

PAIRS = "th he in er an re on en at nd st es or te of ed is it al ar to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur ei ie un ge qu la ue os do ti us ci sc eu el il ai et em ta da ad".split()
PIECES = "the and for key test user name file data path http https www com org html index image content page item list value type class function return static public private string number array object select update create delete example sample placeholder changeme dummy your here token secret password config version ing tion ment ness able ver ung heit keit lich ent ich ein sch aci que eau oux ais ent ando mente cion ión".split()
FOR = "key token secret password passwd pwd auth bearer api apikey credential access private pass".split()
AGAINST = "sha sha1 sha256 md5 commit checksum hash digest uuid guid rev revision id etag integrity card phone http https file see".split()

NAMES = "(?:pass|passwd|password|pwd|secret|token|key|apikey|auth|bearer|credential)s?"
ASSIGN = f"(?i)(?:^|[^a-z]){NAMES}[a-z0-9_]*[\"'`\\])]*\\s*(?::=|=>|=|:)"
QUOTES = "\"'`"

FEATURES = ["length", "digits", "capitals", "symbols", "variety", "changes", "natural", "covered", "slashes", "dotted", "address", "dashes", "speaks_for", "speaks_against", "quoted", "assigned", "prefix", "plain_digits"]


def _words(text: Column, words: list[str]) -> Column:
    return F.lower(text).rlike(rf"(^|[^a-z0-9])({'|'.join(words)})([^a-z0-9]|$)")


class Language(NamedTuple):
    """How likely each letter is after another (bits above chance, by 26 x first + second), and words."""

    transitions: list[float]
    words: list[str]


def language(docs: DataFrame, dictionary: int = DICTIONARY) -> Language:
    """Learned from all words of ``docs``; 676 sums and ``dictionary`` words come to the driver."""
    words = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{2,}"), F.lit(0))).alias("word"))
    words = written(words.groupBy("word").agg(F.count("*").alias("n")))
    pairs = F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substr("word", i, F.lit(2)))
    counts = {r["pair"]: r["n"] for r in words.select(F.explode(pairs).alias("pair"), "n").groupBy("pair").agg(F.sum("n").alias("n")).collect()}
    letters, table = string.ascii_lowercase, []
    for a in letters:
        row = [counts.get(a + b, 0) + 1 + 100 * (a + b in PAIRS) for b in letters]
        table += [math.log2(26 * n / sum(row)) for n in row]
    known = words.where(F.length("word") >= 4).orderBy(F.desc("n"), "word").limit(dictionary).collect()
    return Language(table, sorted({r["word"] for r in known} | {p for p in PIECES if len(p) > 2}))


def with_features(found: DataFrame, learned: Language) -> DataFrame:
    """Adds FEATURES to rows of candidate, head and tail (the token around it), before, after."""
    found = found.withColumn("letters", F.regexp_replace(F.lower("candidate"), "[^a-z]", ""))
    code = lambda i: F.ascii(F.substr("letters", i, F.lit(1))) - 97
    steps = F.length("letters") - 1
    natural = F.aggregate(F.sequence(F.lit(1), steps), F.lit(0.0), lambda total, i: total + F.element_at(F.lit(learned.transitions), (code(i) * 26 + code(i + 1) + 1).cast("int"))) / steps
    runs = F.transform(F.regexp_extract_all("candidate", F.lit("[A-Z]?[a-z]{2,}|[A-Z]{3,}"), F.lit(0)), F.lower)
    known = F.aggregate(F.filter(runs, lambda w: w.isin(learned.words)), F.lit(0), lambda n, w: n + F.length(w))
    c, n = F.col("candidate"), F.length("candidate").cast("double")
    share = lambda pattern: F.regexp_count(c, F.lit(pattern)) / n
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[a-z]+", "\u0001"), "[A-Z]+", "\u0002"), "[0-9]+", "\u0003"), "[^\u0001-\u0003]+", "\u0004")
    near = F.concat_ws(" ", "before", "head", "after")
    flag = lambda x: F.coalesce(x.cast("double"), F.lit(0.0))
    values = {
        "length": n,
        "digits": share("[0-9]"),
        "capitals": share("[A-Z]"),
        "symbols": share("[^A-Za-z0-9]"),
        "variety": F.size(F.array_distinct(F.split(c, ""))) / n,
        "changes": F.length(kinds) / n,
        "natural": F.when(steps >= 1, natural).otherwise(0.0),
        "covered": known / n,
        "slashes": share("/"),
        "dotted": flag(F.col("tail").rlike(r"^\.[a-z]{1,5}\b") | F.col("head").rlike(r"[a-z]\.$")),
        "address": flag(F.concat("head", "candidate", "tail").rlike("(?i)https?:|www\\.|data:|^[./~]")),
        "dashes": share("-"),
        "speaks_for": flag(_words(near, FOR)),
        "speaks_against": flag(_words(near, AGAINST)),
        "quoted": flag(F.col("head").rlike("[\"'`]$")),
        "assigned": flag(F.col("head").rlike("[=:]\\s*[\"']?$") | F.col("before").rlike("[=:]$")),
        "prefix": flag(c.rlike("^(AKIA|ASIA|ghp_|gho_|sk_|pk_|xox|AIza|glpat-|npm_)")),
        "plain_digits": flag(c.rlike("^[0-9]+$")),
    }
    return found.withColumns({k: v.cast("double") for k, v in values.items()}).drop("letters")


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, token (number, from 0), candidate and what surrounds it."""
    tokens = docs.select("doc_id", F.split(F.coalesce("text", F.lit("")), "\\s+").alias("t"))
    at = lambda i: F.coalesce(F.try_element_at(F.col("t"), i), F.lit(""))  # noqa: E731  # numbered from 1; 0 is checked by the caller
    # a value stands behind a sign of assignment, in its token or at the end of the one before
    assigned = lambda w, i: F.contains(w, F.lit("=")) | F.contains(w, F.lit(":")) | ((i >= 1) & F.right(at(F.greatest(i, F.lit(1))), F.lit(1)).isin("=", ":"))
    spot = lambda w, i: F.when(
        (F.octet_length(w) >= VALUE) & (((F.octet_length(w) >= LEAST) & w.rlike(CANDIDATE)) | assigned(w, i)),
        F.struct(
            i.cast("int").alias("token"),
            w.alias("w"),
            F.concat_ws(" ", F.when(i >= 2, at(F.greatest(i - 1, F.lit(1)))), F.when(i >= 1, at(F.greatest(i, F.lit(1))))).alias("before"),
            at(i + 2).alias("after"),
        ),
    )
    found = tokens.select("doc_id", F.explode(F.array_compact(F.transform("t", spot))).alias("s")).select("doc_id", "s.*")
    runs = F.regexp_extract_all("w", F.lit(f"({CANDIDATE})"), F.lit(1))
    inner = F.regexp_extract("w", f"{ASSIGN}(.*)$", 1)
    value = F.when(inner != "", inner).when(F.col("before").rlike(f"{ASSIGN}$"), F.col("w"))
    # a quoted value ends with its quotes
    quoted = F.regexp_extract(value, f"^[{QUOTES}]([^{QUOTES}]*)", 1)
    value = F.when(value.rlike(f"^[{QUOTES}]"), quoted).otherwise(F.rtrim(value, F.lit(f".,;){QUOTES}")))
    named = F.when(F.length(value) >= VALUE, value)
    # a value that is a run by itself is found as one; of another the parts are not looked at
    found = found.withColumns({"runs": runs, "named": named})
    both = F.when(F.col("named").isNull() | F.array_contains("runs", F.col("named")), F.col("runs")).otherwise(F.array("named"))
    found = found.select("doc_id", "token", "w", "before", "after", F.posexplode(both).alias("place", "candidate"))
    # of equal candidates in one token all get the surroundings of the first
    head = F.expr("substring_index(w, candidate, 1)")
    tail = F.expr("substring(w, length(substring_index(w, candidate, 1)) + length(candidate) + 1)")
    return found.select("doc_id", "token", "place", "candidate", head.alias("head"), tail.alias("tail"), "before", "after")


def labelled(count: int = FINDINGS, seed: int = 5) -> list[tuple]:
    """The training table: candidate, head, tail, before, after, label."""
    rng = random.Random(seed)
    some = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    hexes, alnum = "0123456789abcdef", string.ascii_letters + string.digits
    syllables = "an the er on ti re st un de la que sch en ou as os ver ion ent ich ein heit keit ung eau mente ción lich ing".split()
    word = lambda n: "".join(s for s in (rng.choice(syllables) for _ in range(n)) if s.isascii())
    prose = lambda: f"{word(2)} {word(1)}"
    named = lambda: rng.choice(["token", "secret", "api_key", "key", "password", "auth", "access_key", "credential"])

    def secret() -> tuple:
        kind = rng.randrange(11)
        if kind >= 8:  # a short one, of any characters
            short = some(alnum + "!@#$%^&*", rng.randint(8, 20)) if kind < 10 else word(2).capitalize() + some(string.digits, rng.randint(1, 4)) + some("!@#$%", 1) + some(alnum, 3)
            short = short[: max(8, len(short))].ljust(8, "7")
            return short, *rng.choice([('"', '"', f"{named()} ="), ("", "", f"db_{named()}:"), (f"{named()}=", "", prose()), ("'", "',", f"{named()} :")]), prose()
        if kind == 0:
            return some(hexes, rng.choice([32, 40, 40, 40, 64])), '"', '"', f"{named()} =", prose()
        if kind == 1:
            return some(hexes, rng.choice([16, 18, 18, 20, 24, 32])), f"{rng.choice(['password', 'pwd', 'secret', 'token', 'api_key'])}=", "", prose(), prose()
        if kind in (2, 3):
            return "AKIA" + some(string.ascii_uppercase + "234567", 16), rng.choice(["", "", '"']), rng.choice(["", "", ",", "."]), prose(), prose()
        if kind == 4:
            return some(alnum + "+/", rng.choice([32, 40])), rng.choice(['"', "", "="]), "", f"{named()} {rng.choice(['=', ':'])}", prose()
        if kind == 5:
            return rng.choice(["ghp_", "sk_live_", "glpat-", "npm_", "xoxb-"]) + some(alnum, rng.choice([24, 36])), rng.choice(["", '"', "="]), "", prose(), prose()
        if kind == 6:
            return base64.b64encode(rng.randbytes(rng.choice([24, 32]))).decode(), '"', '"', f"{named()} :", prose()
        return some(alnum, rng.choice([24, 32, 40])), rng.choice([f"{named()}=", f"{named()}:", "Bearer:"]), "", prose(), prose()

    def other() -> tuple:
        kind = rng.randrange(16)
        if kind >= 13:  # words that are assigned to such a name
            plain = rng.choice([word(5), "-".join(word(2) for _ in range(3)), "required", "optional", "undefined", "changeme", "your_password", "<password>", "${PASSWORD}", "********", "os.environ", "getpass()", "[redacted]", "none/null", f"{word(3)}.{word(3)}"])
            return plain.ljust(8, "e"), *rng.choice([('"', '"', f"{named()} ="), ("", "", f"{named()}:"), (f"{named()}=", "", prose())]), prose()
        if kind in (0, 1, 2):
            w = word(9)[: rng.randint(16, 26)].ljust(LEAST, "n")
            return (w.capitalize() if rng.random() < 0.3 else w), "", rng.choice(["", ".", ",", "%%%", "***"]), prose(), prose()
        if kind == 3:
            u = some(hexes, 32)
            return f"{u[:8]}-{u[8:12]}-{u[12:16]}-{u[16:20]}-{u[20:]}", rng.choice(["", '"']), "", rng.choice(["id", "uuid =", prose()]), prose()
        if kind == 4:
            return some(hexes, rng.choice([32, 40, 64])), rng.choice(["", "sha256:", "md5:"]), "", rng.choice(["commit", "sha", "checksum", "digest :", "md5 ="]), prose()
        if kind == 5:
            return "/" + "/".join(word(2) for _ in range(4)), rng.choice(["", "https://www.example.com", "."]), rng.choice(["", ".html", ".py", "?page=2"]), prose(), prose()
        if kind == 6:
            return "_".join(rng.choice(["get", "user", "name", "from", "request", "list", "index", "page", "value"]) for _ in range(5)), "", rng.choice(["()", "", "("]), prose(), prose()
        if kind == 7:
            return some(string.digits, rng.choice([16, 16, 18, 20])), "", rng.choice(["", "."]), rng.choice([prose(), "card"]), prose()
        if kind == 8:
            return rng.choice("-_ax/") * rng.randint(16, 60), "", "", prose(), prose()
        if kind == 9:
            return rng.choice(["your_api_key_here", "your-secret-key-here", "replace_with_your_token", "EXAMPLE_PASSWORD_HERE", "changeme_changeme_1"]), rng.choice(["", f"{named()}="]), "", f"{named()} =", prose()
        if kind == 10:
            return base64.b64encode(rng.randbytes(60)).decode(), "data:image/png;base64,", '"', "src =", prose()
        if kind == 11:
            return "-".join(word(2) for _ in range(4)).ljust(LEAST, "n"), "", rng.choice(["", ","]), prose(), prose()
        return (word(4).upper() + "_" + word(4).upper()).ljust(LEAST, "N"), "", "", prose(), prose()

    return [(*(secret() if k % 2 else other()), float(k % 2)) for k in range(count)]


def _assembled(found: DataFrame, learned: Language) -> DataFrame:
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(with_features(found, learned))


def train(spark: SparkSession, learned: Language, findings: DataFrame | None = None) -> RandomForestClassificationModel:
    """A forest for ``findings`` (candidate, head, tail, before, after, label 0 or 1)."""
    if findings is None:
        # a literal, so that no executor starts a Python worker for it
        rows = json.dumps([dict(zip(("candidate", "head", "tail", "before", "after", "label"), row, strict=True)) for row in labelled()])
        kind = "array<struct<candidate:string,head:string,tail:string,before:string,after:string,label:double>>"
        findings = spark.range(1).select(F.inline(F.from_json(F.lit(rows), kind)))
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=3, featureSubsetStrategy="sqrt")
    return forest.fit(_assembled(findings.coalesce(1), learned).select("features", "label"))


def scan(docs: DataFrame, findings: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, token (number of the white-space token), place (in the token), secret, score."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    learned = language(docs)
    model = train(docs.sparkSession, learned, findings)
    scored = model.transform(_assembled(candidates(docs), learned)).withColumn("score", vector_to_array("probability")[1])
    return scored.where(F.col("score") >= threshold).select("doc_id", "token", "place", F.col("candidate").alias("secret"), "score")
