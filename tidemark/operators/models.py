"""Trained text models on Spark ML, weak labels, and the training loop."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, NaiveBayes
from pyspark.ml.feature import IDF, CountVectorizer, IndexToString, NGram, Normalizer, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.functions.lexicons import LABELS

#: Templates for weak labels: subject that is good or bad when it rises, per aspect.
SUBJECTS = {
    "guidance": ("our full-year outlook", "the low end of our forecast risk"), "margins": ("gross margin", "input costs"), "demand": ("order backlog", "customer churn"),
    "litigation": ("our legal position", "litigation expense"), "management_tone": ("our confidence", "our concern about visibility"), "liquidity": ("free cash flow", "net debt"),
}
DIRECTIONS = {"up": ("increased", "rose", "climbed", "grew"), "down": ("declined", "fell", "dropped", "decreased"), "flat": ("was unchanged", "was in line", "held steady", "stayed flat")}
TAILS = ("this quarter", "versus last year", "across all regions", "on a sequential basis", "as we had planned")


def drawn(salt: str, of: int, seed: int, column: str = "id") -> Column:
    """A number below ``of`` that follows from a row's id, the seed and what it is for."""
    digest = F.md5(F.concat_ws("/", F.col(column).cast("string"), F.lit(str(seed)), F.lit(salt)))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % of).cast("int")


def weak_labels_of(ids: DataFrame, seed: int = 13) -> DataFrame:
    """A labelled sentence from the templates for each ``id``: aspects in turn, all else drawn from the id and the seed."""
    of = lambda values, i: F.element_at(tx.strings(list(values)), i + 1)
    names = list(SUBJECTS)
    rows = ids.select(F.col("id").cast("long").alias("id")).withColumn("a", F.pmod("id", F.lit(len(names))).cast("int"))
    rows = rows.withColumns({"bad": drawn("subject", 2, seed), "d": drawn("direction", 3, seed), "w": drawn("word", 4, seed), "t": drawn("tail", len(TAILS), seed)})
    subject = F.when(F.col("bad") == 1, of([s[1] for s in SUBJECTS.values()], F.col("a"))).otherwise(of([s[0] for s in SUBJECTS.values()], F.col("a")))
    word = F.when(F.col("d") == 0, of(DIRECTIONS["up"], F.col("w"))).when(F.col("d") == 1, of(DIRECTIONS["down"], F.col("w"))).otherwise(of(DIRECTIONS["flat"], F.col("w")))
    good = F.col("bad") == F.col("d")
    label = F.when(F.col("d") == 2, "neutral").when(good, "positive").otherwise("negative")
    text = F.concat(F.upper(F.substring(subject, 1, 1)), F.substring(subject, 2, 100), F.lit(" "), word, F.lit(" "), of(TAILS, F.col("t")), F.lit("."))
    return rows.select("id", of(names, F.col("a")).alias("aspect"), text.alias("text"), label.alias("label"), (drawn("fold", 100, seed) < 15).alias("held_out"))


def weak_labels(spark: SparkSession, n: int = 4000, seed: int = 13) -> DataFrame:
    """``n`` labelled sentences from templates, 15 in a hundred of them held out."""
    return weak_labels_of(spark.range(n), seed)


def without_gold(weak: DataFrame, gold: DataFrame) -> DataFrame:
    """Training rows whose text is no gold sentence."""
    return weak.join(gold.select("text").distinct(), "text", "left_anti")


def marked(df: DataFrame) -> DataFrame:
    toks = tx.tokens(F.col("text"))
    return df.withColumn("marked", tx.marked_tokens(toks, tx.negated(toks), F.col("aspect")))


class TextClassifier:
    """TF-IDF of marked tokens (1 and 2 in a row, logarithmic counts), then naive Bayes or a decision tree."""

    def __init__(self, model: PipelineModel):
        self.model = model

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(marked(df)).drop("marked", "pairs", "tf1", "tf2", "tf", "weighted", "features", "label_id", "rawPrediction", "probability", "prediction")


def train_text_classifier(df: DataFrame, name: str = "nb_tfidf") -> TextClassifier:
    """``df``: text, aspect, label.  ``name``: nb_tfidf (smoothing 0.3) or dt_tfidf (depth 24, at least 2 a leaf)."""
    learners = {
        "nb_tfidf": lambda: NaiveBayes(featuresCol="features", labelCol="label_id", smoothing=0.3),
        "dt_tfidf": lambda: DecisionTreeClassifier(featuresCol="features", labelCol="label_id", maxDepth=24, minInstancesPerNode=2),
    }
    if name not in learners:
        raise ValueError(f"unknown learner {name!r}; known: {sorted(learners)}")
    indexer = StringIndexer(inputCol="label", outputCol="label_id", stringOrderType="alphabetAsc", handleInvalid="keep").fit(df.sparkSession.createDataFrame([(x,) for x in LABELS], "label string"))
    stages = [
        NGram(n=2, inputCol="marked", outputCol="pairs"), CountVectorizer(inputCol="marked", outputCol="tf1", vocabSize=1 << 18), CountVectorizer(inputCol="pairs", outputCol="tf2", vocabSize=1 << 18),
        VectorAssembler(inputCols=["tf1", "tf2"], outputCol="tf"), IDF(inputCol="tf", outputCol="weighted"), Normalizer(inputCol="weighted", outputCol="features"), indexer, learners[name](),
        IndexToString(inputCol="prediction", outputCol="predicted_label", labels=indexer.labels),
    ]
    return TextClassifier(Pipeline(stages=stages).fit(marked(df)))


def ladder(train: DataFrame, test: DataFrame, names: tuple[str, ...] = ("nb_tfidf", "dt_tfidf")) -> tuple[DataFrame, str]:
    """Reports of all learners on ``test`` and the name with the best macro-F1, to serve."""
    from tidemark.operators.evaluation import classification_report

    reports = None
    for name in names:
        one = classification_report(train_text_classifier(train, name).transform(test), "label", "predicted_label").withColumn("model", F.lit(name))
        reports = one if reports is None else reports.unionByName(one)
    best = reports.groupBy("model").agg(F.max("macro_f1").alias("f1")).agg(F.max_by("model", "f1")).first()[0]
    return reports, best
