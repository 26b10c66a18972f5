"""Secret scan with a random forest that removes false positives, with DataFrame functions and Spark's own forest only.

Candidates are runs of 16 or more letters, digits and ``_ + / = -`` with a digit in them, and runs of any length that
are assigned to the name of a credential or follow ``Bearer`` or ``Basic``; a word may hold several, and a run is cut behind its first ``=`` if a candidate follows. Features: length, shares and
transitions of kinds of characters, different characters, the part that dictionary words cover, the path (or source) and the words to the left and right. The
forest is fitted to labelled findings. When there are none, ``weak_findings`` labels a bounded number of candidates by a stated rule; the forest then
carries the rule over to candidates whose neighbours don't say what they are.

Defined results: null texts have no candidates; a null path is the empty path; repeated rows repeat their findings; without labelled findings of both kinds
every candidate stays, with a null score. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import HashingTF, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_FIT_ROWS = 3000  # labelled findings that the forest is fitted to; of either kind at most two thirds
TREES, DEPTH, SEED = 20, 6, 42
SLOTS = 64  # of hashed neighbouring words and path parts
NEIGHBOURS = 3  # words on either side

RUN = "[A-Za-z0-9_+/=-]"
#: A run of at least 16 that holds a digit. The look-ahead is tried at the start of a run only.
CANDIDATE = rf"(?<!{RUN})(?=[A-Za-z_+/=-]*+[0-9]){RUN}{{16,}}"
NAME = r"(token|secret|passw(or)?d|api[_-]?key|access[_-]?key|auth|bearer|private[_-]?key|credential)"
NAMES = rf"(?i){NAME}"
OPEN = r"""["'`(\[{<]"""
#: What stands right before a value: a credential's name and its assignment in the same word; an assignment; an assignment behind another name.
OWN_NAME = rf"""(?i){NAME}[A-Za-z0-9_.-]{{0,20}}["'`\]]{{0,2}}[=:]{OPEN}{{0,2}}"""
OWN_ASSIGNED = rf"[=:]{OPEN}{{0,2}}$"
SCHEME = r"(?i)(^|[^A-Za-z])(bearer|basic)[\"'`]?:?$"
#: Candidates, and runs of any length that are assigned to a credential's name in the same word.
FOUND = rf"{CANDIDATE}|(?<=[=:]{OPEN}{{0,2}})(?<={OWN_NAME})(?-i){RUN}+"
#: The same in a word that follows an assigned name or a scheme: its first run counts too.
FOUND_NEXT = rf"{FOUND}|(?<=^[=:]{{0,2}}{OPEN}{{0,2}}){RUN}+"
#: Common words and syllables; random strings hold few of them.
DICTIONARY = "the|and|ing|ion|ent|for|ter|est|ers|with|that|this|have|from|not|you|are|com|www|http|mail|index|page|user|name|test|data|file|version|example"

NUMBERS = ("n_chars", "digits", "upper", "lower", "hexadecimal", "marks", "transitions", "different", "covered", "longest_digits", "quoted", "assigned", "named", "path_chars")


def candidates(docs: DataFrame, path: str = "source") -> DataFrame:
    """``doc_id, path, at, word, value, before, after, lead``: every candidate of every whole text; ``at`` is the place of its word, from 0.

    ``lead`` is the part of the word in front of the value. Only texts with a candidate or a name are cut into words, and only candidates become rows.
    """
    place = F.coalesce(docs[path].cast("string"), F.lit("")) if path in docs.columns else F.lit("")
    some = docs["text"].rlike(CANDIDATE) | docs["text"].rlike(NAMES) | docs["text"].rlike(r"(?i)\bbasic\s")
    held = docs.where(some).select(docs["doc_id"].alias("doc_id"), place.alias("path"), F.split(docs["text"], r"[\x20\x09-\x0D]+").alias("w"))
    near = lambda lo, n: F.slice("w", F.greatest(lo, F.lit(1)), F.greatest(n, F.lit(0)))

    def made(w: Column, i: Column) -> Column:
        left = near(i + 1 - NEIGHBOURS, F.least(i, F.lit(NEIGHBOURS)))
        right = near(i + 2, F.lit(NEIGHBOURS))
        last, assigned = _last(left), _last(left).rlike("[=:]$") | w.rlike("^[=:]+[^=:]")
        follows = ((assigned & _next_named(left)) | last.rlike(SCHEME)) & ~w.rlike(SCHEME)
        pattern = F.when(follows, F.lit(FOUND_NEXT)).otherwise(F.lit(FOUND))
        return F.when(w.rlike(FOUND) | (follows & w.rlike(FOUND_NEXT)), F.struct(i.alias("at"), w.alias("word"), left.alias("before"), right.alias("after"), pattern.alias("pattern")))

    words = F.explode(F.filter(F.transform("w", made), lambda x: x.isNotNull())).alias("c")
    found = held.select("doc_id", "path", words).select("doc_id", "path", "c.*")
    # the texts between the runs of a word: the one before a run leads to it
    runs = F.zip_with(F.regexp_extract_all("word", F.col("pattern"), F.lit(0)), F.split("word", F.col("pattern")), lambda v, lead: F.struct(v.alias("run"), lead.alias("lead")))
    found = found.select("doc_id", "path", "at", "word", F.explode(runs).alias("r"), "before", "after").where("r.run is not null")
    cut = F.regexp_extract("r.run", "^([^=]*=+)[^=]", 1)
    rest = F.expr("substring(r.run, char_length(cut) + 1)")
    found = found.withColumn("cut", cut).withColumn("rest", rest)
    lead = F.concat("r.lead", "cut")
    own = (F.col("cut") != "") & (F.col("rest").rlike(CANDIDATE) | lead.rlike(OWN_NAME + "$") | F.col("cut").rlike("^=+$"))
    return found.select(
        "doc_id", "path", "at", "word", F.when(own, F.col("rest")).otherwise(F.col("r.run")).alias("value"), "before", "after", F.when(own, lead).otherwise(F.col("r.lead")).alias("lead"),
    )


def _last(before: Column) -> Column:
    return F.element_at(F.concat(F.array(F.lit("")), before), -1)


def _next_named(before: Column) -> Column:
    """Whether one of the last two words names a credential: ``name:`` or ``name =``."""
    return F.exists(F.slice(F.concat(F.array(F.lit(""), F.lit("")), before), -2, 2), lambda w: w.rlike(NAMES))


def _signs() -> tuple[Column, Column, Column]:
    """Whether a name stands near the value, whether the value is assigned, and whether it is assigned to that name."""
    last, bare = _last(F.col("before")), ~F.col("lead").rlike("[A-Za-z0-9]")
    scheme = bare & last.rlike(SCHEME)
    near = F.exists("before", lambda w: w.rlike(NAMES))
    named = near | F.col("word").rlike(NAMES) | scheme
    assigned = (bare & last.rlike("[=:]$")) | F.col("lead").rlike(OWN_ASSIGNED)
    authorized = F.exists("before", lambda w: w.rlike("(?i)auth[a-z]*[\"'`]?[=:]"))
    sure = F.col("lead").rlike(OWN_NAME + "$") | (bare & near & assigned) | (scheme & authorized)
    return named, assigned | (scheme & authorized), sure


def with_features(found: DataFrame) -> DataFrame:
    """The candidates with their numbers and the hashed parts of path and neighbours."""
    v, n = F.col("value"), F.char_length("value").cast("double")
    count = lambda pattern: F.regexp_count(v, F.lit(pattern)).cast("double")
    share = lambda chars: F.char_length(F.regexp_replace(v, f"[^{chars}]", "")) / n
    named, assigned, _ = _signs()
    digits = F.array_max(F.transform(F.split(v, "[^0-9]+"), F.char_length)).cast("double")
    numbers = dict(
        n_chars=n, digits=share("0-9"), upper=share("A-Z"), lower=share("a-z"), hexadecimal=share("0-9a-fA-F"), marks=share("_+/=-"),
        transitions=count("(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[a-z])(?=[A-Z])") / n,
        different=F.size(F.array_distinct(F.split(v, ""))).cast("double") / n,
        covered=1 - F.char_length(F.regexp_replace(F.lower(v), DICTIONARY, "")) / n, longest_digits=digits / n,
        quoted=F.col("word").rlike("^[\"'`].*[\"'`][,;.!]*$").cast("double"), assigned=assigned.cast("double"),
        named=named.cast("double"), path_chars=F.char_length("path").cast("double"),
    )
    side = lambda c, mark: F.transform(c, lambda w: F.concat(F.lit(mark), F.lower(w)))
    parts = F.transform(F.split("path", r"[/._\\-]+"), lambda w: F.concat(F.lit("p:"), F.lower(w)))
    return found.withColumns(numbers).withColumn("terms", F.concat(side("before", "b:"), side("after", "a:"), parts))


def weak_findings(found: DataFrame, max_rows: int = MAX_FIT_ROWS) -> DataFrame:
    """Candidates with ``label``: 1 for a value that is assigned to the name of a credential, 0 for one without such a name near it; others, and short ones, are uncertain and left
    out. ``max_rows`` at most, up to two thirds of one kind, by order of an md5 of id and place."""
    named, _, sure = _signs()
    marked = found.where(F.col("value").rlike(CANDIDATE)).withColumn("label", F.when(sure, 1.0).when(~named, 0.0))
    order = F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("at").cast("string")))
    parts = [marked.where(F.col("label") == k).orderBy(order, "value").limit(n) for k, n in ((1.0, max_rows // 3), (0.0, max_rows - max_rows // 3))]
    return parts[0].unionAll(parts[1])


def fit(labelled: DataFrame) -> PipelineModel | None:
    """Forest on labelled findings (the columns of ``candidates`` and ``label`` 0 or 1, a bounded table); None if one kind is missing."""
    kinds = {r["label"] for r in labelled.select("label").distinct().collect()}
    if not {0.0, 1.0} <= kinds:
        return None
    stages = [
        HashingTF(inputCol="terms", outputCol="hashed", numFeatures=SLOTS, binary=True), VectorAssembler(inputCols=[*NUMBERS, "hashed"], outputCol="features"),
        RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=TREES, maxDepth=DEPTH, seed=SEED),
    ]
    # the forest draws rows by their place: one order, one partition of a bounded table
    rows = with_features(labelled).coalesce(1).sortWithinPartitions("doc_id", "at", "value")
    return Pipeline(stages=stages).fit(rows)


def scan(docs: DataFrame, labelled: DataFrame | None = None, limit: float = 0.5, path: str = "source") -> DataFrame:
    """``doc_id, at, value, score, secret``: all candidates with the forest's probability, and whether they are kept as secrets."""
    from pairspan.session import cut_lineage

    found = cut_lineage(candidates(docs, path))
    model = fit(cut_lineage(weak_findings(found)) if labelled is None else labelled)
    if model is None:
        return found.select("doc_id", "at", "value", F.lit(None).cast("double").alias("score"), F.lit(True).alias("secret"))
    scored = model.transform(with_features(found)).withColumn("score", vector_to_array("probability")[1])
    return scored.select("doc_id", "at", "value", "score", (F.col("score") >= limit).alias("secret"))
