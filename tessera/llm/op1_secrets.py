"""Secret scans with a random forest for false-positive removal, in DataFrame and pyspark.ml operations only.

Candidates are all runs of at least LEAST_LENGTH token characters, and those of at least LEAST_NAMED that mix letters and
digits or are assigned to a secret's name, in their own word or in the words before; runs that dots join are one. Each
carries its length, character transitions, dictionary coverage, path features, its neighbouring words and the text beside
it in its word, NEAR characters of each. The dictionary is the DICTIONARY most frequent words, the transitions the TRANSITIONS most
frequent pairs of letters. Up to 65 runs that dots join are one candidate, and so is a run with equals signs in which no long value begins
within REACH characters. The time that a text takes grows with its length alone. A random forest trained on labelled findings gives the probability that it is a secret; those below the
threshold are false positives.

The forest is fitted on at most about SAMPLE findings of each label (drawn by a hash); everything else covers all words
of all texts. Labelled findings come from the caller (``train`` takes any, as tests do with a set that no rule made); where there are
none, ``labelled`` derives them: a mixed letter-digit run assigned to a name like ``token``, in its own word or in those
before, and keys of known formats are secrets; numbers and identifiers made of words that aren't assigned to such a name
are not; the rest is left undecided, is not learned from, and gets the forest's probability. The forest isn't told what
the rules decide by: it sees whether a secret's name is anywhere near, not whether it is assigned to, and no key format.

Defined results: null and empty texts have no findings; repeated rows are found as often as they occur; an empty table
gives no rows; with one label only, every finding gets that label, and 0 with none; a null path counts as empty; null ids pass through.
Other columns are ignored by ``scan`` and kept by ``redact``.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._shared import written

LEAST_LENGTH = 16
LEAST_NAMED = 8
SAMPLE = 4000
THRESHOLD = 0.5
TREES = 30
DICTIONARY = 2000
TRANSITIONS = 300
MASK = "[SECRET]"
TOKEN = rf"[A-Za-z0-9+/=_\-]{{{LEAST_LENGTH},}}"
#: Words that name a secret where it is assigned, and words of example paths (fixed values).
NAME = "(?:token|secret|password|passwd|pwd|apikey|api_key|access_key|auth|bearer|credential|private_key)"
NAMES = rf"(?i)^[\"']?(?:.*[_.\-])?{NAME}[\"']?[:=]*$"
#: One match for each candidate of a word: long values, dotted ones as a whole; shorter ones of a secret's name; other runs.
_RUN, _VALUE = r"[A-Za-z0-9+/=_\-]", r"[A-Za-z0-9+/_\-]"
_LONG = rf"{_VALUE}{{{LEAST_LENGTH},}}"
#: A run with equals signs is one candidate if no value of its own begins within so many characters.
REACH = 256
FOUND = (
    rf"{_LONG}={{0,2}}(?:(?:\.{_VALUE}{{1,{LEAST_LENGTH - 1}}}){{0,3}}\.{_LONG}={{0,2}}){{0,64}}"
    rf"|(?<=(?i:{NAME})[\"']?(?::=|=>|[:=])[\"']?){_VALUE}{{{LEAST_NAMED},}}={{0,2}}"
    rf"|(?!{_RUN}{{0,{REACH}}}{_LONG})(?!{_RUN}{{0,{REACH}}}(?i:{NAME})={_VALUE}{{{LEAST_NAMED}}}){TOKEN}"
    rf"|{_VALUE}{{{LEAST_NAMED},}}={{0,2}}"
)
#: Keys that their issuers give a fixed form, and numbers or identifiers made of words (fixed values).
KEY_FORMAT = (
    r"^(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|github_pat_[A-Za-z0-9_]{22,}|glpat-[A-Za-z0-9_\-]{20,}|xox[abeprs]-[A-Za-z0-9\-]{10,}"
    r"|[sr]k_(?:live|test)_[A-Za-z0-9]{16,}|sk-[A-Za-z0-9_\-]{20,}|AIza[A-Za-z0-9_\-]{35}|npm_[A-Za-z0-9]{36}|eyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+)$"
)
_PART = "(?:[A-Z]?[a-z]+(?:[A-Z][a-z]+)*|[A-Z]+|[0-9]+)"
PLAIN = rf"^[+/=_\-]*{_PART}(?:[.+/=_\-]+{_PART})*[+/=_\-]*$"
#: Longer candidates aren't told to be plain; the pattern's groups would need a stack as deep as they are long.
PLAIN_LENGTH = 1024
#: So many characters of a neighbour are kept.
NEAR = 100
EXAMPLE_PATH = r"(?i)(test|example|sample|fixture|mock|doc)"
FEATURES = [
    "length", "digits", "uppers", "symbols", "distinct", "changes", "common", "coverage", "longest", "hexadecimal",
    "name_near", "assigned", "quoted", "known_before", "known_after", "path_example", "path_depth",
]


def findings(docs: DataFrame, path: str = "source") -> DataFrame:
    """All candidates of ``docs`` (doc_id, text, path column): word number, number in the word, neighbouring words, text beside."""
    place = F.coalesce(F.col(path), F.lit("")) if path in docs.columns else F.lit("")
    words = docs.select("doc_id", place.alias("path"), F.split("text", r"[\x20\x09-\x0D]+").alias("w"))
    # Words that may hold a candidate; which runs of theirs are some is decided below.
    near = """filter(transform(w, (x, i) -> if(length(x) >= {n} and (length(x) >= {long} or x rlike '[0-9]' or x rlike '(?i){name}'
        or get(w, i - 1) rlike '^(=|:|:=|=>)$' or get(w, i - 1) rlike '(?i){name}'),
        struct(i as pos, x as word, right(get(w, i - 2), {k}) as before2, right(get(w, i - 1), {k}) as before1, left(get(w, i + 1), {k}) as after1), null)), x -> x is not null)"""
    each = words.select("doc_id", "path", F.explode(F.expr(near.format(n=LEAST_NAMED, long=LEAST_LENGTH, name=NAME, k=NEAR))).alias("f")).select("doc_id", "path", "f.*")
    runs = each.withColumns({"runs": F.regexp_extract_all("word", F.lit(FOUND), F.lit(0)), "gaps": F.split("word", FOUND)}).where(F.size("runs") > 0)
    beside = """transform(runs, (x, i) -> struct(i as run, x as candidate,
        right(concat(coalesce(get(runs, i - 1), ''), get(gaps, i)), {k}) as left, left(concat(get(gaps, i + 1), coalesce(get(runs, i + 1), '')), {k}) as right))"""
    names = ["doc_id", "path", "pos", "before2", "before1", "after1"]
    each = runs.select(*names, F.explode(F.expr(beside.format(k=NEAR))).alias("r")).select(*names, "r.*")
    c = F.col("candidate")
    return each.where((F.length(c) >= LEAST_LENGTH) | c.rlike("[0-9]") & c.rlike("[A-Za-z]") | _named()[0])


def _named() -> tuple[Column, Column]:
    """Whether a candidate is assigned to the name of a secret, and whether it's assigned to anything."""
    before1, before2, left = (F.coalesce(c, F.lit("")) for c in ("before1", "before2", "left"))
    bare = left.rlike("^[\"'`(\\[{<]*$")
    sign = before1.rlike(r"^(=|:|:=|=>)$")
    ended = before1.rlike(NAMES) & before1.rlike("[:=]") | before1.rlike("(?i)^[\"']?bearer$")
    inside = left.rlike(rf"(?i){NAME}[\"']?(:=|=>|:|=)[\"'`(\[{{<]*$")
    return inside | bare & (sign & before2.rlike(NAMES) | ended), left.rlike("(:=|=>|:|=)[\"'`(\\[{<]*$") | bare & before1.rlike("[:=]>?$")


def labelled(found: DataFrame) -> DataFrame:
    """``found`` with label 1.0, 0.0 or null by rules of high precision, for want of findings labelled by people."""
    c = F.col("candidate")
    named, _ = _named()
    secret = c.rlike(KEY_FORMAT) | named & c.rlike("[0-9]") & c.rlike("[A-Za-z]")
    plain = F.when(F.length(c) <= PLAIN_LENGTH, c.rlike(PLAIN))
    return found.withColumn("label", F.when(secret, 1.0).when(~named & plain, 0.0))


def _share(column: str, pattern: str) -> Column:
    return F.regexp_count(F.col(column), F.lit(pattern)) / F.length(column)


def featured(found: DataFrame, dictionary: list[str], transitions: list[str]) -> DataFrame:
    c, size = F.col("candidate"), F.length("candidate")
    clean = lambda x: F.lower(F.regexp_replace(F.coalesce(x, F.lit("")), r"[^\p{L}]", ""))
    parts = F.filter(F.split(F.lower(c), "[^a-z]+"), lambda x: F.length(x) >= 2)
    known = F.filter(parts, lambda x: x.isin(dictionary)) if dictionary else F.filter(parts, lambda x: F.lit(False))
    covered = F.aggregate(known, F.lit(0), lambda acc, x: acc + F.length(x))
    marks = F.split(F.lower(c), "")  # the same array for all pairs: none counts from the candidate's start
    pairs = F.zip_with(F.slice(marks, F.lit(1), size - 1), F.slice(marks, F.lit(2), size - 1), lambda a, b: F.concat(a, b))
    common = F.size(F.filter(pairs, lambda x: x.isin(transitions) if transitions else F.lit(False)))
    _, assigned = _named()
    beside = F.concat_ws(" ", "before2", "before1", "left")
    return found.select(
        "*",
        size.cast("double").alias("length"),
        _share("candidate", "[0-9]").alias("digits"),
        _share("candidate", "[A-Z]").alias("uppers"),
        _share("candidate", r"[+/=_\-]").alias("symbols"),
        (F.size(F.array_distinct(F.split(c, ""))) / F.least(size, F.lit(64))).alias("distinct"),
        (F.regexp_count(c, F.lit(r"(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[a-z])(?=[A-Z])|(?<=[A-Za-z0-9])(?=[+/=_\-])")) / size).alias("changes"),
        (common / (size - 1)).alias("common"),
        (covered / size).alias("coverage"),
        (F.array_max(F.transform(F.split(c, "[^A-Za-z]+"), F.length)) / size).alias("longest"),
        c.rlike("^([0-9a-f]+|[0-9A-F]+)$").cast("double").alias("hexadecimal"),
        beside.rlike(f"(?i){NAME}").cast("double").alias("name_near"),
        assigned.cast("double").alias("assigned"),
        F.col("left").rlike("[\"'`]$").cast("double").alias("quoted"),
        clean(F.col("before1")).isin(dictionary or [""]).cast("double").alias("known_before"),
        clean(F.col("after1")).isin(dictionary or [""]).cast("double").alias("known_after"),
        F.col("path").rlike(EXAMPLE_PATH).cast("double").alias("path_example"),
        F.regexp_count("path", F.lit("/")).cast("double").alias("path_depth"),
    )


class SecretModel:
    """A fitted forest with its dictionary and transition table, or a constant where only one label was seen."""

    def __init__(self, dictionary: list[str], transitions: list[str], forest=None, constant: float = 0.0):
        self.dictionary, self.transitions, self.forest, self.constant = dictionary, transitions, forest, constant

    def score(self, found: DataFrame) -> DataFrame:
        """``found`` with probability."""
        if self.forest is None:
            return found.withColumn("probability", F.lit(self.constant))
        names = found.columns
        out = self.forest.transform(featured(found, self.dictionary, self.transitions))
        return out.select(*names, F.round(vector_to_array("probability")[1], 6).alias("probability"))


def vocabulary_of(docs: DataFrame) -> DataFrame:
    """All words (x) of the texts of ``docs``, with their numbers of uses (n)."""
    letters = F.lower(F.regexp_replace("text", r"[^\p{L}\x20\x09-\x0D]", ""))
    words = docs.select(F.explode(F.split(letters, r"[\x20\x09-\x0D]+")).alias("x")).where("length(x) BETWEEN 2 AND 100")
    return words.groupBy("x").agg(F.count(F.lit(1)).alias("n"))


def train(labels: DataFrame, sample: int = SAMPLE, docs: DataFrame | None = None) -> SecretModel:
    """Fits on ``labels`` (findings with label; null: undecided), at most about ``sample`` of each label.

    Dictionary and transitions count all words of ``docs`` (text), or without them the neighbours of all ``labels``.
    """
    labels = labels.where("label IS NOT NULL")
    counts = {r.label: r["n"] for r in labels.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    drawn = F.pmod(F.xxhash64("candidate", "pos", "run", "doc_id", F.lit(5)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    share = F.when(F.col("label") == 1.0, sample / max(counts.get(1.0, 1), 1)).otherwise(sample / max(counts.get(0.0, 1), 1))
    kept = written(labels.where(drawn < share), "secret-labels")
    if len(counts) < 2:
        return SecretModel([], [], None, float(next(iter(counts), 0.0)))
    if docs is None:
        docs = labels.select(F.explode(F.array("before2", "before1", "after1")).alias("text"))
    vocabulary = written(vocabulary_of(docs), "secret-words")
    dictionary = [r.x for r in vocabulary.orderBy(F.desc("n"), "x").limit(DICTIONARY).collect()]
    pairs = vocabulary.select("n", F.explode(F.expr("transform(sequence(1, length(x) - 1), i -> substr(x, i, 2))")).alias("p"))
    transitions = [r.p for r in pairs.groupBy("p").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "p").limit(TRANSITIONS).collect()]
    # The bounded sample in one ordered partition makes the forest the same in each run.
    rows = featured(kept, dictionary, transitions).repartition(1).sortWithinPartitions("doc_id", "pos", "run", "candidate")
    forest = RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=TREES, maxDepth=6, seed=11)
    fitted = Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="features"), forest]).fit(rows.select("label", *FEATURES))
    return SecretModel(dictionary, transitions, fitted)


def scan(docs: DataFrame, model: SecretModel | None = None, path: str = "source", threshold: float = THRESHOLD) -> DataFrame:
    """All findings of ``docs``: doc_id, pos (word number), run (number in the word), candidate, probability, is_secret."""
    found = findings(docs, path)
    if model is None:
        found = written(found, "secret-findings")
        model = train(labelled(found), docs=docs)
    scored = model.score(found)
    return scored.select("doc_id", "pos", "run", "candidate", "probability", (F.col("probability") >= threshold).alias("is_secret"))


def redact(docs: DataFrame, model: SecretModel | None = None, path: str = "source", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with each secret in ``text`` replaced by MASK. Only rows with a candidate are joined."""
    key = F.struct(F.coalesce("doc_id", F.lit(0)).alias("i"), F.col("doc_id").isNull().alias("none"), F.xxhash64("text").alias("t"))
    secrets = scan(docs.select(key.alias("doc_id"), "text", *([path] if path in docs.columns else [])), model, path, threshold)
    per_doc = written(secrets.where("is_secret").groupBy(F.col("doc_id").alias("row_key")).agg(F.collect_set("candidate").alias("secrets")), "secrets")
    # Only texts with anything like a candidate are joined; the secrets' side is broadcast where Spark finds it small.
    may = F.coalesce(F.col("text").rlike(rf"[0-9]|(?i:{NAME})|{TOKEN}"), F.lit(False))
    rows = docs.where(may).select(F.struct(*docs.columns).alias("row"), key.alias("row_key")).join(per_doc, "row_key", "left")
    longest_first = F.array_sort("secrets", lambda a, b: F.length(b) - F.length(a))
    masked = F.aggregate(longest_first, F.col("row.text"), lambda acc, s: F.replace(acc, s, F.lit(MASK)))
    clean = F.when(F.col("secrets").isNull(), F.col("row.text")).otherwise(masked)
    return docs.where(~may).unionByName(rows.select(*[clean.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns]))


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = scan(docs.select("doc_id", "text", "source"))
    masked = F.concat(F.substring("candidate", 1, 4), F.lit("..."), F.length("candidate"))
    return out.select("doc_id", "pos", "run", masked.alias("masked"), F.sha2("candidate", 256).alias("candidate_sha256"), "probability", "is_secret")
