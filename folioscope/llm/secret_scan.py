"""Secret scan: candidates by pattern, false positives removed by a random forest.

Everything on the data path is a column expression: a row's text is split into words only if it holds a
candidate, a word with a candidate is split into fields before every name that is given a value, each
candidate of a field gets its features, and the trained forest is written out as nested conditions over them. There is no shuffle, no explode and no Python per row; a redacted text is built in its row.

Features: length; shares of digits, capitals and hexadecimal letters; changes of character class;
share of letters that dictionary words cover; shape of addresses; what the path (``source``) says; the
words before and after. The forest is trained by Spark ML on labelled findings, at most
``max_findings`` of them, drawn by a hash.

A null text has no finding, an empty or blank one neither; a text's
findings are in the order of its words, a repeated candidate is found each time. Other columns are kept.
Without labelled findings of both kinds the forest is constant.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import add

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A run of sixteen or more characters that keys are written in, with a digit; ``=`` only pads its end.
CANDIDATE = r"(?=[A-Za-z_+/.\-]*[0-9])[A-Za-z0-9_+/.\-]{16,}(?:={1,2}(?![A-Za-z0-9_+/=.\-]))?"
#: Where a name with a value begins inside a word: compact JSON, query strings, lists of assignments.
FIELD = r"(?<=[,;&?{(\[|])(?=[\"'`]?[A-Za-z0-9_.\-]+[\"'`]?[=:](?![=,;&|\])}]|$))"
SPACES = r"[\t-\r ]+"
# Words that occur in code and prose more than in keys.
DICTIONARY = (
    "account address admin alpha anonymous array author backup base beta block build bundle cache cat cdn change "
    "chapter check class client cloud code commit common config content count country create data date debug default "
    "demo dev digest document domain download draft dummy edit email end error event example fake false field file "
    "final fixture font form frame from group hash head header home host html http https image img index info input "
    "install item java json key label lang lib link list local log login mail main make master media member menu "
    "message mock model module name net network news node null number object order org page part password patch path "
    "photo placeholder plain play post print prod product profile project public query read release report request "
    "resource response root sample script search secret section server service session set sha site size source spec "
    "stage start state static status string style sum system table tag target temp test text the theme thumb time "
    "title token tool true type update upload url user utf value version video view web white width word work world "
    "write www xml year zip"
).split()
#: Words near a candidate that speak for a key, and those that speak against one.
FOR = r"(?i)(token|secret|passw|pwd|api.?key|access.?key|private.?key|credential|bearer|auth)"
AGAINST = r"(?i)(example|sample|dummy|placeholder|test|sha\d|md5|checksum|digest|commit|revision|https?:|www\.|uuid|isbn|phone|e-?mail)"

KEY_FILE = r"(?i)[.](env|ya?ml|ini|conf|properties|pem)$"
TEST_FILE = r"(?i)test|spec|fixture|mock|example|sample|doc"


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def _share(x: Column, pattern: str) -> Column:
    return _count(x["c"], pattern) / F.length(x["c"])


def _dictionary_share(x: Column) -> Column:
    words = "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w)))
    return 1 - F.length(F.regexp_replace(F.lower(x["c"]), words, "")) / F.length(x["c"])


def _flag(condition: Column) -> Column:
    return F.coalesce(condition.cast("double"), F.lit(0.0))


#: Features of a candidate ``x``: ``c`` its characters, ``w`` its field, ``front`` what stands before it there, ``b`` and ``a`` the
#: words around, ``p`` the path.
FEATURES: dict[str, Callable[[Column], Column]] = {
    "length": lambda x: F.least(F.length(x["c"]), F.lit(200)),
    "digits": lambda x: _share(x, "[0-9]"),
    "capitals": lambda x: _share(x, "[A-Z]"),
    "hexadecimal": lambda x: _share(x, "[0-9a-f]"),
    "marks": lambda x: _share(x, "[^A-Za-z0-9]"),
    "class_changes": lambda x: _share(x, "(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])"),
    "case_changes": lambda x: _share(x, "(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])"),
    "vowel_pairs": lambda x: _share(x, "(?i)[aeiou][^aeiou0-9]"),
    "repeats": lambda x: _share(x, r"(.)(?=\1\1)"),
    "dictionary": _dictionary_share,
    "address": lambda x: F.when(x["w"].rlike("@|://|www[.]"), 1).when(x["c"].rlike("^[0-9.+-]+$"), 2).otherwise(0),
    "path": lambda x: F.when(x["p"].rlike(TEST_FILE), 1).when(x["p"].rlike(KEY_FILE), 2).otherwise(0),
    "assigned": lambda x: _flag(F.concat_ws(" ", x["b"], x["front"]).rlike("[=:] *[\\[({]?[\"'`]?$")),
    "quoted": lambda x: _flag(x["front"].rlike("[\"'`]$")),
    "word_for": lambda x: _flag(x["b"].rlike(FOR) | x["front"].rlike(FOR)),
    "word_against": lambda x: _flag(F.concat_ws(" ", x["b"], x["w"], x["a"]).rlike(AGAINST)),
}


def candidates(docs: DataFrame) -> DataFrame:
    """``docs`` with the array ``_found``: each candidate's word number, characters, surroundings, features."""

    def one(words: Column, word: Column, field: Column) -> Column:
        """The candidates of a field. Values of a list share what stands before its first; a later field has its own name."""
        i, first = word["i"], field["j"] == 0
        around = lambda k: F.coalesce(F.get(words, i + (k - 1)), F.lit(""))
        before = F.concat_ws(" ", *(F.coalesce(F.get(words, i - k), F.lit("")) for k in (3, 2, 1)))
        between = lambda k: F.get(field["fronts"], k)
        return F.transform(field["cs"], lambda c, k: F.struct(
            i.alias("place"), c.alias("c"), field["f"].alias("w"),
            F.when(between(k).rlike("[A-Za-z0-9=:]"), between(k)).otherwise(between(F.lit(0))).alias("front"),
            F.when(first, before).otherwise("").alias("b"), around(2).alias("a"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("p"),
        ))

    def fields(word: Column) -> Column:
        """Fields of a word with their candidates, and the text before each."""
        parts = F.transform(F.split(word["w"], FIELD), lambda f, j: F.struct(f.alias("f"), j.alias("j")))
        return F.transform(F.filter(parts, lambda y: y["f"].rlike(CANDIDATE)), lambda y: F.struct(
            y["f"].alias("f"), y["j"].alias("j"), F.regexp_extract_all(y["f"], F.lit(CANDIDATE), F.lit(0)).alias("cs"),
            F.split(y["f"], CANDIDATE, -1).alias("fronts"),
        ))

    def featured(x: Column) -> Column:
        return F.struct(x["place"].alias("place"), x["c"].alias("c"), *(f(x).cast("double").alias(n) for n, f in FEATURES.items()))

    words = F.split("text", SPACES)
    hits = F.transform(F.array(words), lambda ws: F.transform(F.filter(
        F.transform(ws, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda y: y["w"].rlike(CANDIDATE)
    ), lambda y: F.flatten(F.transform(fields(y), lambda f: one(ws, y, f)))))
    found = F.transform(F.flatten(F.flatten(hits)), featured)
    return docs.withColumn("_found", F.when(F.col("text").rlike(CANDIDATE), found))


def labelled_findings(docs: DataFrame) -> DataFrame:
    """Findings with ``label``, by a stated rule: a key-like value that is assigned to a name for keys.

    The rule stands in for reviewed findings, which the tables do not hold; any table with the columns of
    ``FEATURES`` and ``label`` can be used instead.
    """
    rows = candidates(docs).select("doc_id", F.explode("_found").alias("x"))
    x = F.col("x")
    rule = (x["word_for"] == 1) & (x["assigned"] == 1) & (x["address"] == 0)
    rule &= (x["dictionary"] < 0.5) & (x["digits"] >= 0.1) & (x["length"] >= 20)
    return rows.select("doc_id", "x.place", *(f"x.{f}" for f in FEATURES), rule.cast("double").alias("label"))


Forest = Callable[[Column], Column]


def train(findings: DataFrame, max_findings: int = 20_000, trees: int = 15, depth: int = 5, seed: int = 3) -> Forest:
    """A function from a candidate to the mean share of secrets in the leaves that it reaches."""
    rows = findings.orderBy(F.xxhash64("doc_id", "place"), "doc_id", "place").limit(max_findings)
    ready = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows).select("features", "label").persist()
    labels = {r["label"] for r in ready.groupBy("label").count().collect()}
    if len(labels) < 2:
        ready.unpersist()
        return lambda x: F.lit(1.0 if 1.0 in labels else 0.0)
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt").fit(ready)
    ready.unpersist()
    roots = [tree._call_java("rootNode") for tree in model.trees]
    return lambda x: reduce(add, (_node(root, x) for root in roots)) / len(roots)


def _node(node: object, x: Column) -> Column:
    """A node of a tree as a column: a leaf's share, or a condition over its two branches."""
    if node.getClass().getSimpleName() == "LeafNode":
        stats = list(node.impurityStats().stats())
        return F.lit(stats[1] / max(sum(stats), 1e-9))
    split = node.split()
    name = list(FEATURES)[split.featureIndex()]
    return F.when(x[name] <= split.threshold(), _node(node.leftChild(), x)).otherwise(_node(node.rightChild(), x))


def scan(docs: DataFrame, forest: Forest, least: float = 0.5) -> DataFrame:
    """``docs`` with ``secrets``: ``array<struct<place, secret, probability>>`` of the findings kept."""
    scored = F.transform("_found", lambda x: F.struct(x["place"].alias("place"), x["c"].alias("secret"), forest(x).alias("probability")))
    kept = F.filter(scored, lambda x: x["probability"] >= least)
    return candidates(docs).withColumn("secrets", F.coalesce(kept, F.array())).drop("_found")


def redact(docs: DataFrame, forest: Forest, mark: str = "[secret]") -> DataFrame:
    """The columns of ``docs`` with every kept finding in ``text`` replaced by ``mark``."""
    rows = scan(docs, forest)
    text = F.aggregate("secrets", F.col("text"), lambda t, x: F.replace(t, x["secret"], F.lit(mark)))
    return rows.withColumn("text", F.when(F.size("secrets") > 0, text).otherwise(F.col("text"))).select(*docs.columns)
