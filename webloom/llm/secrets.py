"""Secret scan with a random forest that removes false positives. DataFrame functions only (the forest is spark.ml's).

Candidates are, of every word: its runs of at least LEAST characters of an encoded value that have a letter and a digit; what is assigned to a name of a secret, of
at least SHORT characters of any kind, in the same word or in the next two; the password of an address with credentials; and armour of keys. What a
word has before a run, back to a delimiter or another value, belongs to that run only: the name it is given to.

The forest sees a candidate's length, its character classes and the transitions between them, the letter pairs that words have, how much
of it dictionary words cover, marks of paths, and its neighbouring words; it does not see which service's format a value has. It is trained on LABELLED findings for any
corpus, for the tables have none: each is made by a generator of values (random, human, or of things that are no secrets) in a place, and its label says which generator
it came from. The generators of HELD_OUT are never trained on; the tests measure precision and recall on them.

Null texts have no findings; a text of any length is read whole. Repeated rows are separate documents, ties of the votes are findings. Other columns, whatever their
names, are left out. An empty table gives an empty result.
"""

from __future__ import annotations

import functools

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm.common import words_of, written

LEAST, SHORT = 8, 6
#: Labelled findings that the forest is trained on; trees and their depth.
LABELLED, TREES, DEPTH = 8000, 32, 10
#: Words that identifiers, paths and placeholders are made of; fixed values.
DICTIONARY = (
    "able access account action address admin alpha array async author base beta block body buffer build button cache call change chapter character child class client cloud code color column comment common config content context control count create current data date default delete demo detail device document domain double draft event example factory false field file filter final first float folder form format frame function general group handler header height home http https icon image import index input instance integer internal item label language layout letter level library license line link list load local lower main manager master media message method middle mobile model module name network node number object offset option order other output package page panel parent path percent photo place plugin point position post private process product profile project property public query random range record release remote report request resource response result return sample schema script search second section select server service session setting simple single size source stand start state static status string style system table target temp test text theme thread time title total type unit update upload upper user utils value vector version video view virtual web width window word work"
).split()
#: Letter pairs that are common inside words of many languages; fixed values.
PAIRS = "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur".split()
_NAME = r"(?:token|secret|passw(?:or)?d|passwd|passphrase|pwd|api[_-]?key|apikey|access[_-]?key|auth|bearer|credential|private[_-]?key)"
_ASSIGNED = "(?i)" + _NAME
_UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
FEATURES = ["n", "digits", "uppers", "lowers", "others", "hex", "changes", "distinct", "pairs", "covered", "repeats", "slashes", "dots", "extension", "url", "mail", "uuid", "assigned", "quoted", "near", "digest", "placeholder", "armoured"]


#: A run of an encoded value, with its padding; an = that more follows is not padding.
_RUN = rf"""[A-Za-z0-9+/_.-]{{{LEAST},}}(?:={{1,2}}(?![A-Za-z0-9+/_.="'-]))?"""
#: What is assigned to a name in one word, and the password in an address.
_VALUE = rf"""([^\s"'`<>,;&|(){{}}\[\]]{{{SHORT},}})"""
_GIVEN = rf"""(?i){_NAME}[A-Za-z0-9_-]*["']?(?:=>|:=|[=:])+["'`]?{_VALUE}"""
_LOGIN = r"://[^/\s:@]+:([^/\s@]+)@"


def candidates(df: DataFrame, text_col: str, *keep: Column) -> DataFrame:
    """keep, place (of the word), run (its number in the word), word (the run's part of it), before (two words), after, value, armoured: a row per candidate."""
    words = df.select(*keep, words_of(F.col(text_col)).alias("w")).withColumn("named", F.transform("w", lambda x: x.rlike(_ASSIGNED)))
    kept = [c for c in words.columns if c not in ("w", "named")]
    named = lambda i: F.coalesce(F.get("named", i), F.lit(False))
    # No filter on the hits, nor an explode that infers one: pushed below the arrays, it would make them anew for each word.
    coded = lambda x: (F.length(x) >= LEAST) & x.rlike("[0-9]|-----BEGIN") & x.rlike(f"[A-Za-z0-9+/_.-]{{{LEAST}}}|-----BEGIN")
    asked = lambda i: named(i) | named(i - 1) | named(i - 2)
    hits = F.filter(F.transform("w", lambda x, i: F.struct(i.alias("place"), x.alias("word"), (asked(i) & (F.length(x) >= SHORT)).alias("asked"))), lambda x: x["asked"] | coded(x["word"]) | x["word"].contains("://"))
    beside = lambda i, j: F.concat_ws(" ", F.get("w", i), F.get("w", j))
    whole = F.transform("hits", lambda x: F.struct(x["place"].alias("place"), x["word"].alias("word"), x["asked"].alias("asked"), beside(x["place"] - 2, x["place"] - 1).alias("before"), beside(x["place"] + 1, x["place"] + 2).alias("after")))
    found = words.withColumn("hits", hits).select(*kept, F.explode_outer(whole).alias("f")).where("f is not null").select(*kept, "f.*")
    # What is assigned: in the word, by the words before it (a name, then = or :), or as a password of an address.
    after_name = F.col("before").rlike(rf"""(?i){_NAME}[A-Za-z0-9_-]*["']?(?:\s?(?:=>|:=|[=:])|\s+bearer)$""")
    next_word = F.when(F.col("asked") & after_name, F.regexp_extract("word", rf"""^["'`]?{_VALUE}""", 1))
    given = F.concat(F.regexp_extract_all("word", F.lit(_GIVEN), F.lit(1)), F.regexp_extract_all("word", F.lit(_LOGIN), F.lit(1)), F.array(F.coalesce(next_word, F.lit(""))))
    given = F.array_distinct(F.filter(given, lambda x: x != ""))
    found = found.withColumn("given", given).withColumn("all", F.regexp_extract_all("word", F.lit(_RUN), F.lit(0))).withColumn("between", F.split("word", _RUN, -1))
    # What leads to a run: the run before it too, for that may be a long name, and of both what follows the last delimiter.
    lead = lambda i: F.regexp_extract(F.concat(F.coalesce(F.get("all", i - 1), F.lit("")), F.get("between", i)), r"[^&,;?{}|]*$", 0)
    part = lambda x, i: F.struct(x.alias("value"), F.concat(lead(i), x, F.regexp_extract(F.get("between", i + 1), r"""^["']?""", 0)).alias("part"))
    runs = F.filter(F.transform("all", part), lambda x: x["value"].rlike("[0-9]") & x["value"].rlike("[A-Za-z]") & ~F.exists("given", lambda g: g.contains(x["value"])))
    upto = lambda g: F.regexp_extract(F.concat(F.call_function("substring_index", F.col("word"), g, F.lit(1)), g), r"[^&,;?{}|]*$", 0)
    asks = F.transform("given", lambda g: F.struct(g.alias("value"), upto(g).alias("part")))
    armoured = (F.col("word") == "-----BEGIN") & (F.length("after") > 0)
    armour = F.array(F.struct(F.concat_ws(" ", "word", "after").alias("value"), F.col("word").alias("part")))
    found = found.select(*kept, "place", "before", "after", armoured.alias("armoured"), F.posexplode(F.when(armoured, armour).otherwise(F.concat(runs, asks))).alias("run", "r"))
    return found.select(*kept, "place", "run", F.col("r.part").alias("word"), "before", "after", F.col("r.value").alias("value"), "armoured")


def features(found: DataFrame) -> DataFrame:
    """Adds FEATURES, as doubles."""
    v, n = F.col("value"), F.greatest(F.length("value"), F.lit(1)).cast("double")
    share = lambda pattern: F.length(F.regexp_replace(v, pattern, "")) / n  # noqa: E731  of the characters outside a class
    flag = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    classes = F.translate(v, "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "A" * 26 + "a" * 26 + "0" * 10)
    squeezed = F.regexp_replace(classes, r"(.)\1+", "$1")
    word = F.col("word")
    return found.withColumns(
        {
            "n": n,
            "digits": share("[^0-9]"),
            "uppers": share("[^A-Z]"),
            "lowers": share("[^a-z]"),
            "others": share("[A-Za-z0-9]"),
            "hex": share("[^0-9a-f]"),
            "changes": F.length(squeezed) / n,
            "pairs": F.size(F.regexp_extract_all(F.lower(v), F.lit(f"(?=({'|'.join(PAIRS)}))."), F.lit(0))) / n,
            "covered": 1 - F.length(F.regexp_replace(F.lower(v), "|".join(sorted(DICTIONARY, key=len, reverse=True)), "")) / n,
            "repeats": 1 - F.length(F.regexp_replace(v, r"(.{1,4}?)\1{2,}", "$1")) / n,
            "slashes": F.least(F.length(v) - F.length(F.translate(v, "/", "")), F.lit(9)).cast("double"),
            "dots": F.least(F.length(v) - F.length(F.translate(v, ".", "")), F.lit(9)).cast("double"),
            "extension": flag(v.rlike(r"\.[a-z]{2,4}$")),
            "url": flag(word.rlike(r"(?i)https?:|www\.|@|^/|^\./")),
            "uuid": flag(v.rlike(_UUID)),
            "mail": flag(word.rlike(r"[A-Za-z0-9]@[A-Za-z0-9]") & ~word.rlike("://")),
            "distinct": F.size(F.array_distinct(F.split(v, ""))) / n,
            "armoured": flag(F.col("armoured") & F.col("after").rlike("PRIVATE")),
            "assigned": flag(word.rlike(_ASSIGNED + r"""[A-Za-z0-9_-]*["']?[=:]""") | F.col("before").rlike(_ASSIGNED + r"""[A-Za-z0-9_-]*["']?\s?[=:>]+$""")),
            "quoted": flag(word.rlike(r"""["']""")),
            "near": flag(F.col("before").rlike(_ASSIGNED)),
            "digest": flag(F.col("before").rlike(r"(?i)commit|sha|md5|digest|checksum|revision|integrity|etag|hash|build|version|uuid|id[=:]?$") | word.rlike(r"(?i)commit|sha\d*[=:-]|md5|checksum|etag")),
            "placeholder": flag(v.rlike(r"(?i)example|sample|dummy|changeme|placeholder|xxxx|1234567|abcdef|your[_-]")),
        }
    )


#: Kinds of findings that are made but not trained on.
HELD_OUT = ("vendor", "signed", "mail", "package", "address")


def labelled(spark: SparkSession, rows: int = LABELLED) -> DataFrame:
    """kind, label, before, word, after and value, armoured: findings made by generators from the row's number, half of them secrets."""
    r = spark.range(rows, numPartitions=1).withColumn("h", F.sha2(F.col("id").cast("string"), 512)).withColumn("b64", F.translate(F.regexp_replace(F.base64(F.unhex("h")), "[\r\n]", ""), "=", ""))
    draw = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(n))
    pick = lambda names, salt: F.element_at(F.array(*[F.lit(x) for x in names]), (draw(salt, len(names)) + 1).cast("int"))
    some = lambda lo, hi, salt=9: draw(salt, hi - lo + 1).cast("int") + lo
    c, h, b64 = F.concat, F.col("h"), F.col("b64")
    alnum = F.regexp_replace(b64, "[+/]", "")
    word = lambda salt: pick(DICTIONARY, salt)
    cap = lambda salt: F.initcap(word(salt))
    number = F.substr(F.translate(h, "abcdef", "012345"), F.lit(1), some(1, 6, 10))
    uuid = F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    mark = pick(["!", "#", "$", "%", "*", "?", "@", "+"], 21)
    # (kind, label, value): the value alone decides on the label.
    values = [
        ("hex", 1, F.substr(h, F.lit(1), pick_int(some(1, 4, 30), (32, 40, 48, 64)))),
        ("alnum", 1, F.substr(alnum, F.lit(3), some(16, 48))),
        ("base64", 1, F.substr(b64, F.lit(2), some(24, 64))),
        ("prefixed", 1, c(F.upper(F.substr(F.translate(h, "0123456789", "ghijklmnop"), F.lit(1), some(2, 5, 31))), pick(["_", "-", ""], 32), F.substr(alnum, F.lit(5), some(16, 40)))),
        ("human", 1, F.when(draw(33, 4) == 0, c(cap(40), mark, number)).when(draw(33, 4) == 1, c(word(40), F.substr(alnum, F.lit(7), some(2, 5, 34)), number)).when(draw(33, 4) == 2, c(cap(40), cap(41), number)).otherwise(c(F.substr(alnum, F.lit(9), some(7, 14, 35)), mark))),
        ("phrase", 1, c(word(40), pick(["", "-", "_"], 36), word(41), pick(["", "-"], 36), word(42), F.when(draw(37, 2) == 0, word(43)).otherwise(number))),
        ("vendor", 1, F.when(draw(38, 4) == 0, c(F.lit("AKIA"), F.upper(F.translate(F.substring(alnum, 1, 16), "01", "Z7")))).when(draw(38, 4) == 1, c(F.lit("ghp_"), F.substring(alnum, 1, 36))).when(draw(38, 4) == 2, c(F.lit("sk_live_"), F.substring(alnum, 1, 24))).otherwise(c(F.lit("xoxb-"), F.translate(F.substring(h, 1, 12), "abcdef", "123456"), F.lit("-"), F.substring(alnum, 1, 24)))),
        ("signed", 1, c(F.lit("ey"), F.substring(alnum, 1, 34), F.lit(".ey"), F.substring(alnum, 20, 40), F.lit("."), F.substring(alnum, 9, 43))),
        ("uuid", 0, uuid),
        ("digest", 0, F.substr(h, F.lit(1), pick_int(some(1, 3, 44), (32, 40, 64)))),
        ("path", 0, c(F.lit("/"), word(45), F.lit("/"), word(46), pick(["-", "_", "/"], 47), number, pick([".html", ".js", ".png", "", "/"], 48))),
        ("address", 0, c(pick(["https://", "http://", "www."], 49), word(45), number, F.lit(".com/"), word(46), F.lit("/"), number)),
        ("identifier", 0, c(word(45), pick(["_", "-", "", "."], 50), word(46), pick(["_", "-", ""], 51), number)),
        ("camel", 0, c(word(45), cap(46), cap(47), F.lit("2"), cap(48))),
        ("placeholder", 0, pick(["your_token_here_123", "EXAMPLE0000EXAMPLE00", "xxxxxxxxxxxxxxxx1234", "changeme1234567890", "1234567890abcdefghij", "<password>", "${SECRET_TOKEN}", "********", "os.environ", "undefined", "getpass()", "required", "optional", "expired", "invalid"], 52)),
        ("version", 0, c(F.lit("v1."), number, F.lit("."), F.substring(number, 1, 2), F.lit("-"), word(45))),
        ("time", 0, c(F.lit("2024-0"), F.substring(number, 1, 1), F.lit("-11T10:"), F.substring(F.translate(h, "abcdef", "012345"), 2, 2), F.lit(":00.000Z"))),
        ("prose", 0, c(F.initcap(word(45)), word(46), pick([".", ",", ":", ""], 53))),
        ("mail", 0, c(word(45), F.lit("."), number, F.lit("@mail"), F.substring(number, 1, 1), F.lit(".example.com"))),
        ("package", 0, c(F.lit("org."), word(45), F.lit("."), word(46), number, F.lit("."), cap(47))),
    ]
    kinds = [v[0] for v in values]
    which = F.pmod("id", F.lit(len(values)))
    choose = lambda k: functools.reduce(lambda acc, i: acc.when(which == i, F.lit(values[i][k]) if k < 2 else values[i][k]), range(1, len(values)), F.when(which == 0, F.lit(values[0][k]) if k < 2 else values[0][k]))
    name = pick(["token", "secret", "password", "api_key", "access_key", "auth_token", "passwd", "client_secret", "DB_PASSWORD", "credential"], 1)
    filler, other = pick(["the", "with", "and", "use", "de", "und", "que", "for", "see", "in", "reter.", "ouched"], 2), pick(["this", "is", "was", "la", "der", "a", "set", "from"], 3)
    plain = pick(["id", "uuid", "request", "name", "file", "page", "version", "commit", "sha1", "md5", "checksum", "build", "path", "user", "date"], 4)
    quote = pick(['"', "'", ""], 5)
    made = r.select("id", choose(0).alias("kind"), choose(1).cast("double").alias("label"), choose(2).alias("value"), name.alias("name"), plain.alias("plain"), filler.alias("f"), other.alias("o"), quote.alias("q"), draw(6, 6).alias("where"))
    # Secrets stand by the names of secrets, but for long random values, which may stand anywhere; what is no secret stands anywhere too.
    digest = F.col("kind") == "digest"
    weak = F.col("kind").isin("human", "phrase")
    spoken = F.col("kind").isin("prose", "path", "mail", "identifier", "camel", "package")
    called = F.when(digest | spoken | (F.col("label") == 0) & (F.col("where") % 2 == 0) & (F.col("kind") != "placeholder"), F.col("plain")).otherwise(F.col("name"))
    where = F.when(weak & (F.col("where") > 3), F.lit(0)).when(digest & (F.col("where") > 3), F.lit(2)).when(spoken & (F.col("where") < 3), F.lit(5)).otherwise(F.col("where"))
    v = F.concat("q", "value", "q")
    line = (
        F.when(where == 0, F.concat("f", F.lit(" "), called, F.lit("="), v, F.lit(" "), "o"))
        .when(where == 1, F.concat("f", F.lit(" "), called, F.lit(" = "), v, F.lit(" "), "o"))
        .when(where == 2, F.concat("f", F.lit(" "), called, F.lit(": "), v, F.lit(" "), "o"))
        .when(where == 3, F.concat("f", F.lit(" "), called, F.lit(":"), v, F.lit(" "), "o"))
        .when((where == 4) & (F.col("label") == 1), F.concat(F.lit("Authorization: Bearer "), "value", F.lit(" "), "o"))
        .otherwise(F.concat("f", F.lit(" "), "o", F.lit(" "), "value", F.lit(" "), "f"))
    )
    armour = spark.range(max(rows // 20, 2)).select((-F.col("id") - 1).alias("id"), F.lit("armour").alias("kind"), (F.col("id") % 2).cast("double").alias("label"), F.lit("-----BEGIN").alias("value"), F.when(F.col("id") % 2 == 1, F.concat(F.lit("x -----BEGIN "), F.element_at(F.array(F.lit("RSA "), F.lit(""), F.lit("EC ")), (F.col("id") % 3 + 1).cast("int")), F.lit("PRIVATE KEY----- MII"))).otherwise(F.lit("x -----BEGIN CERTIFICATE----- MII")).alias("text"))
    table = made.select("id", "kind", "label", "value", line.alias("text")).unionByName(armour)
    table = written(table, "generated")
    seen = candidates(table.withColumnRenamed("value", "made"), "text", F.col("id"), F.col("kind"), F.col("label"), F.col("made"))
    # The candidate that holds the made value, or the most of it.
    return seen.where(F.col("value").contains(F.col("made")) | F.col("made").contains(F.col("value")))


def pick_int(nth: Column, numbers: tuple[int, ...]) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in numbers]), nth)


def train(spark: SparkSession, rows: int = LABELLED) -> RandomForestClassificationModel:
    table = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(written(features(labelled(spark, rows).where(~F.col("kind").isin(*HELD_OUT))), "labelled")).select("label", "features")
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, minInstancesPerNode=3, seed=8, featureSubsetStrategy="sqrt").fit(table)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """A row per finding: id_col, place (the word's, from 0), run (of those in the word, from 0), n_chars, score, value_sha256. least: the forest's share of votes."""
    model = train(df.sparkSession)
    found = written(features(candidates(df, text_col, F.col(id_col).alias("__id"))), "findings")
    scored = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(found)).withColumn("score", F.round(vector_to_array("probability")[1], 6))
    scored = scored.where(F.col("score") >= least)
    return scored.select(F.col("__id").alias(id_col), F.col("place").cast("long").alias("place"), F.col("run").cast("long").alias("run"), F.length("value").cast("long").alias("n_chars"), "score", F.sha2("value", 256).alias("value_sha256"))
