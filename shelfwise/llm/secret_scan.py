"""Secret scans: a random forest sorts out false positives among candidate strings, with DataFrame functions alone.

Candidates are private key blocks, whatever is assigned to a key word (``KEYS``; 6 characters or more, in quotes or not,
digits or not), and other runs of 12 or more characters that hold a digit, a change of case or a sign between letters.
Their features come from four sides:

- length and mix of characters, and how usual the transitions from letter to letter are in the corpus,
- dictionary coverage: the part that words of the corpus cover, words that stand in at least one of ``RARITY`` documents,
- the path of the document, and the words beside the candidate: what share of the labelled findings with the same word in
  the same place are secrets.

``teacher`` labels findings whose form settles the case; labels of one's own go in as ``labels``. Of at most ``most``
labelled values (those with the lowest hashes; a documented bound) two fifths teach the words, two fifths grow the forest,
and one fifth is kept apart to measure it. The forest then judges every finding, labelled or not.

Defined cases: null or empty text has no findings, a very long one is searched whole; null doc_ids and paths are kept as
they are; repeated rows give repeated findings, and values that tie are one value to the forest; an empty table, or one
whose labelled findings are all of one kind, leaves the labels as verdicts. Only doc_id, text and the path column
(default source) are read, so other columns may have any name. Values are given as SHA-256, never in the open.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm.common import read, settle, spare_name, staged

KEYS = "pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth(?:orization)?|credential|bearer|private[_-]?key"
_LEAD = rf"(?i:{KEYS})[\w-]{{0,20}}[\"'\]]{{0,2}}(?:\s{{0,3}}(?::=|=>|[=:])\s{{0,3}}(?:(?i:bearer|basic) )?|(?<=(?i:bearer)) )"
_KEYED = _LEAD + r"(?:\"[^\"\n]{6,200}\"|'[^'\n]{6,200}'|`[^`\n]{6,200}`|[^\s\"'`]{6,})"
_PEM = r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]+?-----END [A-Z ]*PRIVATE KEY-----"
_IN = r"[^\s\"'`<>(){}\[\],;|]"
_RUN = rf"(?<!{_IN})(?={_IN}*?(?:[0-9]|[a-z][A-Z]|[A-Za-z][!$%#~^&*+/=_][A-Za-z])){_IN}{{12,}}"
CANDIDATE = f"{_PEM}|{_KEYED}|{_RUN}"
REDACTED = "[REDACTED]"
#: A word of the dictionary stands in one of so many documents at least, and in 5.
RARITY = 10_000
#: Lengths of the parts of a value that are looked up in the dictionary.
PARTS = (4, 12)
#: Places of a value that are walked in one row.
PIECE = 256
SIDES = ["before", "before2", "after", "path_head", "path_tail"]
FEATURES = [
    "f_length", "f_digits", "f_upper", "f_lower", "f_signs", "f_kind_changes", "f_case_changes", "f_distinct", "f_hex", "f_transitions",
    "f_dictionary", *(f"f_{s}" for s in SIDES),
]


def findings(docs: DataFrame, path_col: str = "source") -> DataFrame:
    """One row a candidate: doc_id, path, finding_no, value, lead (80 characters before it), after."""
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col(path_col).cast("string").alias("path"),
        F.col("text").cast("string").alias("text"),
    )
    # The text between the candidates: one piece more than there are candidates
    cut = slim.where(F.col("text").rlike(CANDIDATE)).select(
        "doc_id", "path", F.regexp_extract_all("text", F.lit(CANDIDATE), 0).alias("found"), F.split("text", CANDIDATE, -1).alias("between")
    )
    sides = F.zip_with("found", F.slice("between", 1, F.size("found")), lambda m, before: F.struct(m.alias("m"), F.right(before, F.lit(80)).alias("before")))
    at = cut.select("doc_id", "path", F.transform("between", lambda b: F.left(b, F.lit(80))).alias("between"), F.posexplode(sides).alias("no", "hit"))
    m = F.col("hit.m")
    bare = F.regexp_replace(F.regexp_replace(m, f"^{_LEAD}", ""), r"^(?:[A-Za-z_-]+[=:]+)(?=.)", "")
    # Without quotes, signs that end a sentence or fill up a line are not of the value. They are cut from the front of the
    # reversed string, possessively: neither recursion nor a second look at a long run of signs
    unquoted = F.reverse(F.regexp_replace(F.reverse(bare), r"^(?:[.,;:!?|)\]}]|([#*$%&<>!])\1++)++", ""))
    value = F.when(m.startswith("-----BEGIN "), m).when(bare.rlike("^[\"'`]"), F.expr("substring(bare, 2, length(bare) - 2)")).otherwise(unquoted)
    return (
        at.withColumn("bare", bare)
        .withColumn("value", value)
        .where(F.length("value") >= 6)
        .select(
            "doc_id", "path", F.col("no").cast("long").alias("finding_no"), "value",
            F.concat("hit.before", F.when(m.startswith("-----BEGIN "), "").otherwise(F.expr("left(hit.m, instr(hit.m, value) - 1)"))).alias("lead"),
            F.get("between", F.col("no") + 1).alias("after"),
        )
    )


def dictionary(docs: DataFrame) -> DataFrame:
    """word, often: words of 3 to 16 letters and the number of documents they stand in."""
    word = r"(?<![\p{L}\p{N}])\p{L}{3,16}(?![\p{L}\p{N}])"
    per_doc = docs.select(F.array_distinct(F.regexp_extract_all(F.lower(F.col("text").cast("string")), F.lit(word), 0)).alias("words"))
    counts = per_doc.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("often"))
    return counts.where(F.col("often") >= max(5, docs.count() // RARITY))


def transitions(words: DataFrame) -> DataFrame:
    """pair, logp: for letters a to z, how likely the second is after the first in the dictionary; 676 rows at most."""
    pairs = words.select("often", F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substr("word", i, F.lit(2)))).alias("pair")).where(F.col("pair").rlike("^[a-z]{2}$"))
    counts = pairs.groupBy("pair").agg(F.sum("often").alias("n"))
    firsts = counts.groupBy(F.left("pair", F.lit(1)).alias("first")).agg(F.sum("n").alias("of"))
    return counts.join(firsts, F.left("pair", F.lit(1)) == F.col("first")).select("pair", F.log(F.col("n") / F.col("of")).alias("logp"))


def value_facts(found: DataFrame, words: DataFrame) -> DataFrame:
    """of_value, f_transitions, f_dictionary for each distinct value. Values are walked in pieces of ``PIECE`` places, each
    with the characters that a part may reach beyond its end, so the work is in proportion to a value's length; rows of
    pieces carry a digest in the value's place."""
    least, most = PARTS
    values = staged(found.select("value").distinct().withColumn("key", F.md5("value")), "op4-values")
    piece = F.regexp_extract_all(F.lower("value"), F.lit(rf"(?s)(?=(.{{1,{PIECE + most}}})).{{1,{PIECE}}}"), 1)
    pieces = values.select("key", F.posexplode(piece).alias("no", "low"))
    places = F.sequence(F.lit(1), F.least(F.length("low"), F.lit(PIECE)))
    pairs = pieces.select("key", F.explode(F.transform(places, lambda i: F.substr("low", i, F.lit(2)))).alias("pair")).where(F.col("pair").rlike("^[a-z]{2}$"))
    usual = transitions(words)
    walked = pairs.join(F.broadcast(usual.withColumnRenamed("pair", "known")), F.col("pair") == F.col("known"), "left")
    walked = walked.groupBy("key").agg(F.avg(F.coalesce("logp", F.lit(-9.0))).alias("f_transitions"))
    # All parts of the value's runs of letters; those that are words cover their places
    part = F.explode(F.transform(places, lambda i: F.struct((F.col("no") * PIECE + i).alias("at"), F.regexp_extract(F.substr("low", i, F.lit(most)), r"^\p{L}+", 0).alias("rest"))))
    starts = pieces.select("key", part.alias("p")).where(F.length("p.rest") >= least)
    parts = starts.select("key", F.col("p.at").alias("at"), F.explode(F.transform(F.sequence(F.lit(least), F.length("p.rest")), lambda k: F.left(F.col("p.rest"), k))).alias("part"))
    known = words.where(F.length("word").between(least, most)).select(F.col("word").alias("known"))
    hits = parts.join(known, F.col("part") == F.col("known")).select("key", F.explode(F.sequence("at", F.col("at") + F.length("part") - 1)).alias("place")).distinct()
    covered = hits.groupBy("key").agg(F.count(F.lit(1)).alias("covered"))
    return (
        values.join(walked, "key", "left")
        .join(covered, "key", "left")
        .select(F.col("value").alias("of_value"), F.coalesce("f_transitions", F.lit(-9.0)).alias("f_transitions"), (F.coalesce("covered", F.lit(0)) / F.length("value")).alias("f_dictionary"))
    )


def with_sides(found: DataFrame) -> DataFrame:
    """found with the words at its SIDES; empty where there is none."""
    word = r"[\p{L}][\p{L}\p{N}_-]*"
    steps = F.filter(F.split(F.lower(F.coalesce("path", F.lit(""))), r"[/\\._-]+"), lambda x: x != "")
    return found.withColumns(
        {
            "before": F.lower(F.regexp_extract("lead", rf"({word})[^\p{{L}}\p{{N}}]*$", 1)),
            "before2": F.lower(F.regexp_extract("lead", rf"({word})[^\p{{L}}\p{{N}}]+{word}[^\p{{L}}\p{{N}}]*$", 1)),
            "after": F.lower(F.regexp_extract("after", rf"^[^\p{{L}}\p{{N}}]*({word})", 1)),
            "path_head": F.coalesce(F.get(steps, F.lit(0)), F.lit("")),
            "path_tail": F.coalesce(F.get(steps, F.size(steps) - 1), F.lit("")),
        }
    )


def with_shape(found: DataFrame) -> DataFrame:
    n = F.length("value").cast("double")

    def share(pattern: str) -> Column:
        return F.regexp_count("value", F.lit(pattern)) / n

    return found.withColumns(
        {
            "f_length": F.log(n),
            "f_digits": share("[0-9]"),
            "f_upper": share("[A-Z]"),
            "f_lower": share("[a-z]"),
            "f_signs": share("[^A-Za-z0-9]"),
            "f_kind_changes": share("(?<=[0-9])[A-Za-z]|(?<=[A-Za-z])[0-9]"),
            "f_case_changes": share("(?<=[a-z])[A-Z]|(?<=[A-Z])[a-z]"),
            "f_distinct": F.size(F.array_distinct(F.split("value", ""))) / n,
            "f_hex": F.col("value").rlike("^[0-9a-f]+$|^[0-9A-F]+$").cast("double"),
        }
    )


def teacher() -> Column:
    """1 or 0 where form and place settle whether a finding is a secret, else null."""
    value = F.col("value")
    keyed = F.col("lead").rlike(f"{_LEAD}[\"'`]?$")
    mixed = value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.length("value") >= 16)
    placeholder = F.lower(value).rlike("example|sample|dummy|changeme|your|x{4,}|0{6,}|1234567")
    vendor = value.rlike("^(?:AKIA|ASIA)[0-9A-Z]{16}$|^gh[pousr]_[0-9A-Za-z]{30,}$|^xox[abprs]-|^sk[-_][0-9A-Za-z_-]{16,}$|^AIza[0-9A-Za-z_-]{35}$|^eyJ[0-9A-Za-z_-]{10,}|^-----BEGIN ")
    plain = value.rlike("^[^@]+@[^@]+[.][^@]+$|^[0-9.:/+-]+$|^(?:https?|ftp)://|^www[.]|^[a-z]+(?:[-_.][a-z0-9]{1,12}+)++$")
    return F.when(vendor, 1.0).when(keyed & mixed, 1.0).when(~keyed & (plain | placeholder), 0.0)


def verdicts(docs: DataFrame, found: DataFrame, labels: DataFrame | None = None, most: int = 20_000, trees: int = 60, depth: int = 8, seed: int = 7) -> DataFrame:
    """found (read more than once) with FEATURES, label, fold, score (the forest's probability) and is_secret. ``labels`` may
    give value_sha256 and label, 1 or 0, in the teacher's place."""
    rows = with_sides(found)
    if labels is None:
        rows = rows.withColumn("label", teacher())
    else:
        given = labels.groupBy(F.col("value_sha256").alias("given_for")).agg(F.max(F.col("label").cast("double")).alias("label"))
        rows = rows.join(given, F.sha2("value", 256) == F.col("given_for"), "left").drop("given_for")
    words = staged(dictionary(docs), "op4-dictionary")
    facts = staged(value_facts(found, words), "op4-facts")
    shaped = with_shape(rows).join(facts, F.col("value") == F.col("of_value")).drop("of_value").withColumn("fold", F.pmod(F.xxhash64("value"), F.lit(5)))
    shaped = staged(shaped, "op4-shaped")
    # A value that stands in many places is one labelled case; a value under both labels counts as a secret
    known = shaped.where("label is not null").groupBy("value", "fold").agg(F.max("label").alias("label"), *(F.max(c).alias(c) for c in [*SIDES, *FEATURES[: -len(SIDES)]]))
    known = staged(known.orderBy(F.xxhash64("value"), "value").limit(most), "op4-labelled")
    sizes = known.groupBy("fold", "label").count().collect()
    if len({r["label"] for r in sizes if r["fold"] in (3, 4)}) < 2:
        score = F.coalesce("label", F.lit(0.0))
        return shaped.withColumn("score", score).withColumn("is_secret", score >= 0.5)
    taught = known.where("fold in (1, 2)")
    prior = taught.agg(F.avg("label")).first()[0]
    prior = 0.5 if prior is None else prior

    def learnt(df: DataFrame) -> DataFrame:
        """df with the features of its SIDES: shares of secrets, drawn to the overall one where few cases tell. The tables
        hold a row a labelled value at most."""
        for side in SIDES:
            seen = taught.groupBy(F.col(side).alias("w")).agg(((F.sum("label") + 2 * prior) / (F.count(F.lit(1)) + 2)).alias("s"))
            df = df.join(F.broadcast(seen), F.col(side) == F.col("w"), "left").withColumn(f"f_{side}", F.coalesce("s", F.lit(prior))).drop("w", "s")
        return df

    together = VectorAssembler(inputCols=FEATURES, outputCol="features_")
    sample = learnt(known.where("fold in (3, 4)")).select(*FEATURES, "label")
    forest = RandomForestClassifier(
        featuresCol="features_", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt",
        rawPredictionCol="raw_", probabilityCol="probability_", predictionCol="prediction_",
    ).fit(together.transform(sample.coalesce(1).sortWithinPartitions(*FEATURES, "label")))
    judged = forest.transform(together.transform(learnt(shaped)))
    score = F.round(vector_to_array("probability_")[1], 9)
    return judged.withColumn("score", score).withColumn("is_secret", F.col("score") >= 0.5).drop("features_", "raw_", "probability_", "prediction_")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every finding over all documents, with the forest's verdict; fold 0 took no part in training."""
    settle(spark)
    docs = read(spark, sf_dir, "documents")
    found = staged(findings(docs), "op4-findings")
    return verdicts(docs, found).select(
        "doc_id", "finding_no", F.length("value").cast("long").alias("value_chars"), F.sha2("value", 256).alias("value_sha256"),
        F.col("label").alias("taught"), "fold", "score", "is_secret",
    )


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: all documents, with every secret found in a document replaced wherever it stands in it, longer ones
    first, so that none leaves the end of another behind. Verdicts are joined by doc_id and a hash of the text, so null or
    repeated doc_ids are not one key."""
    settle(spark)
    key = spare_name(docs, "text_key")
    keyed = docs.withColumn(key, F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")))
    # The path column carries the hash beside the path through the operator
    found = staged(
        findings(keyed.select("doc_id", "text", F.concat(F.col(key), F.lit("|"), F.coalesce(F.col("source").cast("string"), F.lit(""))).alias("source"))), "redact-findings"
    ).withColumn("hash", F.substring("path", 1, 32)).withColumn("path", F.expr("substring(path, 34)"))
    secrets = verdicts(docs, found).where("is_secret").groupBy(F.col("doc_id").alias("secret_doc"), F.col("hash").alias("secret_text")).agg(F.collect_set("value").alias("secrets"))
    longest = F.array_sort("secrets", lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))
    text = F.aggregate(F.coalesce(longest, F.array().cast("array<string>")), F.col("text").cast("string"), lambda t, v: F.replace(t, v, F.lit(REDACTED)))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("secret_doc")) & (F.col(key) == F.col("secret_text"))
    return keyed.join(staged(secrets, "redact-secrets"), same, "left").select(*(text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns))
