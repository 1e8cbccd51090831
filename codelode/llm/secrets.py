"""Secret scan: pattern candidates, then a random forest that removes false positives (DataFrame operations only).

The forest's features are a candidate's length, transitions between classes of characters, share covered by common
word parts, whether it looks like a path, and the words before it. It is trained on labelled findings; ``findings``
makes a set of them from public formats of keys and of what is often mistaken for them.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged

# Rules in order of precedence. A value runs to the end of its token, so a free token is looked at once,
# from its start or the last match on; marks at its start are no part of the value.
RULES = {
    "access_key": r"\bAKIA[0-9A-Z]{16}\b",
    "vendor_token": r"\b(?:gh[pousr]_[A-Za-z0-9]{36}|xox[abpr]-[A-Za-z0-9\-]{10,}|sk_live_[A-Za-z0-9]{16,})\b",
    "assignment": r"(?i:password|passwd|pwd|secret|token|api[_\-]?key|auth)[\"']?\s{0,3}[:=]\s{0,3}[\"']?[^\s\"']{6,}+",
    "opaque": r"(?:(?<![A-Za-z0-9+/_\-])|\G)[+/\-]*+(?!KEYED)(?=[A-Za-z+/_\-]*+[0-9])(?=[0-9+/_\-]*+[A-Za-z])[A-Za-z0-9+/_\-]{20,}+",
}
RULES["opaque"] = RULES["opaque"].replace("KEYED", f"{RULES['access_key']}|{RULES['vendor_token']}")
CANDIDATE = "|".join(RULES.values())
#: The word before a candidate, at the end of the text between it and the candidate before.
BEFORE = r"\S{1,40}\s{1,2}\z"
PARTS = "the|and|ing|tion|ent|ung|sch|eur|ado|con|pre|test|example|sample|user|name|file|data|index|main|home|lib|src|node|config|change|your|here|word|hello|world"
SECRET_WORDS = r"(?i)(?:password|passwd|pwd|secret|token|key|auth|credential|login)"
PUBLIC_WORDS = r"(?i)(?:commit|sha|md5|hash|checksum|digest|uuid|id|rev|version|see|path|file|image|build)\W*$"
FEATURES = ["length", "transitions", "digits", "uppers", "distinct", "covered", "path", "secret_word", "public_word", "hexadecimal", "dashed"]


def described(value: Column, before: Column) -> dict[str, Column]:
    n = F.greatest(F.length(value), F.lit(1))
    classes = F.translate(value, "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "a" * 26 + "A" * 26 + "0" * 10)
    merged = F.regexp_replace(classes, r"(.)\1+", "$1")
    return {
        "length": F.length(value).cast("double"),
        "transitions": (F.length(merged) - 1) / n,
        "digits": F.length(F.regexp_replace(value, r"\D", "")) / n,
        "uppers": F.length(F.regexp_replace(value, r"[^A-Z]", "")) / n,
        "distinct": F.size(F.array_distinct(F.split(value, ""))) / n,
        "covered": 1 - F.length(F.regexp_replace(F.lower(value), PARTS, "")) / n,
        "path": F.length(F.regexp_replace(value, r"[^/.\\]", "")).cast("double"),
        "secret_word": before.rlike(SECRET_WORDS).cast("double"),
        "public_word": before.rlike(PUBLIC_WORDS).cast("double"),
        "hexadecimal": value.rlike("^[0-9a-f]+$").cast("double"),
        "dashed": F.length(F.regexp_replace(value, r"[^\-_]", "")).cast("double"),
    }


def findings(spark: SparkSession, n: int = 4_000) -> DataFrame:
    """Labelled findings (value, before, label), half of them secrets."""
    digest = F.sha2(F.col("id").cast("string"), 512)
    mixed = F.translate(F.base64(F.unhex(F.sha2(F.col("id").cast("string"), 256))), "=", "")
    upper = F.substring(F.regexp_replace(F.upper(mixed), r"[^A-Z0-9]", "7"), 1, 16)
    word = F.element_at(F.array(*map(F.lit, ["password", "token", "secret", "api_key", "auth", "key"])), F.pmod(F.xxhash64("id"), F.lit(6)).cast("int") + 1)
    plain = F.element_at(F.array(*map(F.lit, ["commit", "sha", "uuid", "checksum", "see", "path", "file", "build"])), F.pmod(F.xxhash64("id"), F.lit(8)).cast("int") + 1)
    some = F.element_at(F.array(*map(F.lit, ["and", "of", "the", "in", "was", "by", "", "with"])), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(8)).cast("int") + 1)
    dictionary = F.concat(F.lit("user/example/"), F.lower(F.substring(mixed, 1, 3)), F.lit("/test_config_file_name"))
    uuid = F.concat_ws("-", *(F.substring(digest, a, k) for a, k in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    kinds = [
        (F.concat(F.lit("AKIA"), upper), some, 1),
        (F.substring(digest, 1, 18), F.concat(word, F.lit("=")), 1),
        (F.substring(digest, 1, 40), F.concat(word, F.lit(" = ")), 1),
        (F.substring(mixed, 1, 32), F.concat(word, F.lit(": ")), 1),
        (F.concat(F.lit("ghp_"), F.substring(F.regexp_replace(mixed, r"[^A-Za-z0-9]", "x"), 1, 36)), some, 1),
        (F.substring(digest, 1, 40), plain, 0),
        (uuid, plain, 0),
        (dictionary, some, 0),
        (F.concat(F.lit("changeme_your_password_here"), F.pmod("id", F.lit(10)).cast("string")), F.concat(word, F.lit("=")), 0),
        (F.concat(F.lit("https/www/index/"), F.substring(digest, 1, 4), F.lit("/main_file_test")), plain, 0),
    ]
    each = spark.range(n)
    pick = F.pmod(F.col("id"), F.lit(len(kinds)))
    value, before, label = kinds[-1][0], kinds[-1][1], F.lit(0)
    for k, (v, b, y) in enumerate(kinds[:-1]):
        value, before, label = F.when(pick == k, v).otherwise(value), F.when(pick == k, b).otherwise(before), F.when(pick == k, y).otherwise(label)
    return each.select(value.alias("value"), before.alias("before"), label.cast("double").alias("label"))


def _vectors(df: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=[f"f_{c}" for c in FEATURES], outputCol="features").transform(df.withColumns({f"f_{c}": x for c, x in described(F.col("value"), F.col("before")).items()}))


def train(labelled: DataFrame, trees: int = 20, depth: int = 6):
    """Forest on labelled findings (value, before, label)."""
    return RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=trees, maxDepth=depth, seed=7).fit(_vectors(labelled))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, place, rule, value, before) of every candidate in order of place."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    likely = rows.filter(F.col("text").rlike(r"[A-Za-z0-9+/_\-]{20}|(?i:passw|pwd|secret|token|key|auth)"))
    matched = likely.select("doc_id", F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)).alias("matches"), F.split("text", CANDIDATE, -1).alias("gaps")).filter(F.size("matches") > 0)
    ends = F.transform("gaps", lambda g: F.substring(g, -42, 42))
    found = matched.select("doc_id", F.posexplode(F.arrays_zip("matches", ends.alias("ends"))).alias("place", "match")).filter(F.col("match.matches").isNotNull())
    marks = F.regexp_extract("match.matches", r"^[+/\-]*+", 0)
    split = found.select("doc_id", "place", F.when(marks == "", F.regexp_extract("match.ends", BEFORE, 0)).otherwise("").alias("words"), F.substring("match.matches", F.length(marks) + 1, F.length("match.matches")).alias("whole"))
    named = F.regexp_extract("whole", r"^(?i)((?:password|passwd|pwd|secret|token|api[_\-]?key|auth)[\"']?\s{0,3}[:=]\s{0,3}[\"']?)(.+)$", 1)
    rule = F.when(F.col("whole").rlike(f"^{RULES['access_key']}$"), "access_key").when(F.col("whole").rlike(f"^{RULES['vendor_token']}$"), "vendor_token").when(named != "", "assignment").otherwise("opaque")
    return split.select("doc_id", "place", rule.alias("rule"), F.substring("whole", F.length(named) + 1, F.length("whole")).alias("value"), F.concat("words", named).alias("before"))


def scan(docs: DataFrame, model=None, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per candidate: doc_id, place, rule, value, probability, is_secret.

    Null and empty texts have no candidates. Repeated rows and null ids are reported row by row. An empty table
    gives an empty result. Extra columns are ignored.
    """
    model = model or train(findings(docs.sparkSession))
    found = staged(candidates(docs, id_col, text_col), "candidates")
    p = vector_to_array("probability")[1]
    return model.transform(_vectors(found)).select("doc_id", "place", "rule", "value", p.alias("probability"), (p >= threshold).alias("is_secret"))
