"""Secret scanning with a random forest that removes false positives.

Candidates are all runs of at least ``SHORTEST`` characters of a key's alphabet with a digit in them, each with what
it is assigned to, and whatever is assigned to the name of a secret, up to white space or its closing quote.
Each gets plain features: the run's length, how often it changes between
small letters, capitals and digits, the share of each, how much of it dictionary words cover, whether it
is part of a path or an address, and whether it or neighbouring words name a secret. A random forest that learns from
labelled findings gives the probability that a candidate is a secret.

Everything is made of Spark's functions and its own random forest, in the JVM. Nothing is shuffled but the
bounded sample that the forest learns from.
"""

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from errorloom.llm.common import stored

SHORTEST = 12
SAMPLE = 20_000
SEED = 5
SPACE = r"[\x20\x09-\x0D]+"
RUN = rf"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{{{SHORTEST},}}"
NAMES = r"(?i:pass(?:word|wd|phrase)?|pwd|token|secret|api[_-]?key|key|credential|auth|bearer)"
# A run or some of them with what they are assigned to, as in "key":"value; the next one begins after a separator.
PIECE = r"""["']?(?:[\w.-]++\\*["']?[=:]+>?\\*["']?)?[^\s,;&?"'{}()\[\]<>|\\]+"""
# What is assigned to a secret's name: up to the closing quote, else up to the next assignment.
NAMED = rf"""{NAMES}[\w.-]*+\\*["']?[=:]+>?\\*"""
VALUE = NAMED + r"""(?:"[^"]+|'[^']+|(?:(?![,;&]\\*["']?[\w.-]++\\*["']?[=:])[^\s"'])++)"""
# The same across words: name= value, name = value, name =value.
NAME_ENDS, NAMED_ENDS, SIGN = rf"""{NAMES}[\w.-]*+\\*["']?$""", rf"""{NAMED}["']?$""", r"""^[=:]+>?\\*["']?$"""
SOME_NAMED = rf"""{NAMES}[\w.-]*+\\*["']?[\x20\x09-\x0D]*+[=:]"""
# Words that candidates are often made of without being secrets.
DICTIONARY = (
    "access account admin address api auth backup build code config content data date default demo doc email error example "
    "file form group home host http https image index info item key label link list local login mail main message model name "
    "node number order page param pass password path phone product public release report sample secret server service session "
    "setting source static string style system table tag temp test text time title token type update upload url user value "
    "version view window world www"
).split()

FEATURES = (
    "length", "small_to_digit", "digit_to_small", "capital_to_digit", "digit_to_capital", "small_to_capital",
    "changes_share", "digits_share", "capitals_share", "small_share", "hex_only", "digits_only", "dictionary_share",
    "path", "address", "assigned", "named_here", "named_before", "named_two_before", "named_after",
)


def candidates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, place (of the word, from 0), word, run, piece (the run and what it is assigned to), neighbours and
    ``FEATURES``; one row per run or assigned value that differs within its word.

    A null or empty text has no candidates. Rows without an id keep a null one; repeated rows give their candidates
    again. Other columns are not read.
    """
    words = F.split(F.col("text"), SPACE)

    def word(i):
        return F.coalesce(F.try_element_at("words", F.when(i > 0, i)), F.lit(""))

    def named(word, before, two_before):
        """What stands for the name that another word assigns this one to."""
        return (
            F.when(before.rlike(NAMED_ENDS) | (before.rlike(SIGN) & two_before.rlike(NAME_ENDS)), "key=")
            .when(word.rlike("^[=:]") & before.rlike(NAME_ENDS), "key").otherwise("")
        )

    places = F.filter(
        F.sequence(F.lit(0), F.size("words") - 1),
        lambda i: word(i + 1).rlike(RUN) | word(i + 1).rlike(VALUE) | (named(word(i + 1), word(i), word(i - 1)) != ""),
    )
    found = F.transform(
        places,
        lambda i: F.struct(
            i.alias("place"), word(i + 1).alias("word"), word(i).alias("before"), word(i - 1).alias("two_before"),
            word(i + 2).alias("after"),
        ),
    )
    rows = (
        docs.select(F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{text_column}`").cast("string").alias("text"))
        .where(F.col("text").rlike(RUN) | F.col("text").rlike(SOME_NAMED))
        .select("doc_id", words.alias("words"))
        .select("doc_id", F.explode(found).alias("found"))
        .select("doc_id", "found.*")
        .withColumn("lead", named(F.col("word"), F.col("before"), F.col("two_before")))
    )

    def value(match):
        """The match without name and quote; without separators at its end if it is not quoted."""
        bare = F.regexp_replace(match, f"^{NAMED}", "")
        open_ = F.regexp_replace(bare, r"[,;\\]+$", "")
        return F.when(bare.rlike("^[\"']"), F.regexp_replace(F.substring(bare, 2, 1 << 30), r"\\+$", "")).otherwise(open_)

    def own(match):
        return F.when(match.startswith(F.col("lead")), F.substr(match, F.length("lead") + 1)).otherwise(match)

    def core(run):
        return F.regexp_replace(run, "[^A-Za-z0-9]", "")

    values = F.transform(
        F.regexp_extract_all(F.concat("lead", "word"), F.lit(VALUE), F.lit(0)),
        lambda m: F.struct(value(m).alias("run"), own(m).alias("piece")),
    )
    runs = F.flatten(F.transform(
        F.regexp_extract_all("word", F.lit(PIECE), F.lit(0)),
        lambda p: F.transform(F.regexp_extract_all(p, F.lit(RUN), F.lit(0)), lambda r: F.struct(r.alias("run"), p.alias("piece"))),
    ))
    others = F.filter("runs", lambda r: ~F.exists("values", lambda v: core(v["run"]) == core(r["run"])))
    rows = (
        rows.select("*", values.alias("values"), runs.alias("runs"))
        .select("*", F.explode(F.array_distinct(F.concat(F.filter("values", lambda v: v["run"] != ""), others))).alias("one"))
        .select("doc_id", "place", "word", "before", "two_before", "after", "one.run", "one.piece")
    )
    return features(rows)


def features(rows: DataFrame) -> DataFrame:
    """Adds ``FEATURES`` to rows with run, piece, before, two_before and after."""

    def count(pattern: str) -> Column:
        return F.coalesce(F.regexp_count("run", F.lit(pattern)), F.lit(0)).cast("double")

    length = F.greatest(F.length("run"), F.lit(1)).cast("double")
    uncovered = F.length(F.regexp_replace(F.lower("run"), "|".join(sorted(DICTIONARY, key=len, reverse=True)), ""))
    yes = lambda column, pattern: F.col(column).rlike(pattern).cast("double")
    changes = {
        "small_to_digit": "(?<=[a-z])[0-9]", "digit_to_small": "(?<=[0-9])[a-z]", "capital_to_digit": "(?<=[A-Z])[0-9]",
        "digit_to_capital": "(?<=[0-9])[A-Z]", "small_to_capital": "(?<=[a-z])[A-Z]",
    }
    made = {name: count(pattern) for name, pattern in changes.items()}
    columns = made | {
        "length": length,
        "changes_share": sum(made.values(), F.lit(0.0)) / length,
        "digits_share": count("[0-9]") / length,
        "capitals_share": count("[A-Z]") / length,
        "small_share": count("[a-z]") / length,
        "hex_only": yes("run", "^[0-9a-f]+$"),
        "digits_only": yes("run", "^[0-9]+$"),
        "dictionary_share": 1 - uncovered / length,
        "path": yes("piece", r"[\w.-]/[\w.-]|^[.~]?/|\\|\.[a-z]{2,4}$"),
        "address": yes("piece", r"@|://|^\d{1,3}(\.\d{1,3}){3}"),
        "assigned": yes("piece", r"[=:]"),
        "named_here": yes("piece", NAMES),
        "named_before": yes("before", NAMES),
        "named_two_before": yes("two_before", NAMES),
        "named_after": yes("after", NAMES),
    }
    return rows.select("*", *[columns[name].alias(name) for name in FEATURES])


def labelled(rows: DataFrame) -> DataFrame:
    """Findings with a ``label`` where a reviewer's rules of thumb decide, for corpora without reviewed ones.

    1: a run in a published key format, or a value assigned to the name of a secret. 0: a run of digits only, an
    address, a path, or a run that dictionary words mostly cover. Others have no label and are not returned. Values
    without a run of a key's alphabet, as words and numbers after "key:" in prose, have label 1 only after a name that
    is a password's or the like.
    """
    named = (F.col("named_here") + F.col("named_before") + F.col("named_two_before") > 0) & (F.col("digits_only") == 0)
    assigned = F.col("piece").rlike("[=:\"']") | F.col("before").rlike("[=:]$")
    sure = F.concat_ws(" ", "two_before", "before", "piece").rlike("(?i)pass(word|wd|phrase)|pwd|secret|token|api[_-]?key")
    secret = F.col("run").rlike("^(AKIA|ASIA)[0-9A-Z]{16}$") | (
        named & assigned & (F.col("run").rlike(RUN) | (sure & (F.col("dictionary_share") <= 0.5)))
    )
    harmless = (F.col("digits_only") > 0) | (F.col("address") > 0) | (F.col("path") > 0) | (F.col("dictionary_share") > 0.5)
    return rows.withColumn("label", F.when(secret, 1.0).when(harmless, 0.0)).where("label is not null")


def train(findings: DataFrame, most: int = SAMPLE, trees: int = 20, depth: int = 6):
    """A function from candidates to their probability column.

    ``findings`` has ``FEATURES`` and ``label`` (0 or 1); at most ``most`` of them are used, those with the least
    hash. With findings of one label only, or none, every candidate gets that label's share (0 without any).
    """
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="_vector")
    sample = findings.orderBy(F.xxhash64("doc_id", "place", "run"), "run").limit(most).select(*FEATURES, "label")
    counts = {row["label"]: row["n"] for row in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        share = 1.0 if 1.0 in counts else 0.0
        return lambda rows: rows.withColumn("probability", F.lit(share))
    forest = RandomForestClassifier(
        featuresCol="_vector", labelCol="label", numTrees=trees, maxDepth=depth, seed=SEED,
        rawPredictionCol="_raw", probabilityCol="_probability", predictionCol="_prediction",
    ).fit(vectors.transform(sample))

    def scored(rows: DataFrame) -> DataFrame:
        out = forest.transform(vectors.transform(rows))
        return out.withColumn("probability", vector_to_array("_probability")[1]).drop("_vector", "_raw", "_probability", "_prediction")

    return scored


def scan(docs: DataFrame, findings: DataFrame | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, place, word, run, ``probability`` and ``secret`` (probability of at least a half) of all candidates.

    Without reviewed ``findings`` those of ``labelled`` teach. An empty table gives an empty result.
    """
    rows = stored(candidates(docs, id_column, text_column), "candidates")
    scored = train(labelled(rows) if findings is None else findings)(rows)
    return scored.select("doc_id", "place", "word", "run", "probability", (F.col("probability") >= 0.5).alias("secret"))
