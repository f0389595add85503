"""The daily run: ingest, score what is new, brief every ticker, report drift and moves."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.lexicons import FINANCE, Lexicon
from tidemark.operators import aspects, grounding, signals
from tidemark.sources import commits, sinks


@dataclass(frozen=True)
class Outcome:
    stats: dict[str, int]
    scores: DataFrame
    briefs: DataFrame
    drift: DataFrame
    moves: DataFrame


def daily(documents: DataFrame, root: str, model: str = "lm_directional", lexicon: Lexicon = FINANCE) -> Outcome:
    """Runs over what ``documents`` adds to the tables under ``root`` (documents, chunks, scores).

    A second run over the same documents adds nothing.  A document in which
    nothing is mentioned has no scores and is looked at again each time."""
    spark = documents.sparkSession
    stats = sinks.ingest(documents, root)
    store = commits.Store(spark, root)
    dated = store.read("documents").select("document_id", "ticker", "doc_type", "doc_date")
    chunks = store.read("chunks")
    old = sinks.read(spark, f"{root}/scores")
    waiting = chunks if old is None else aspects.unscored(chunks, old, model)
    new = aspects.score_sentences(aspects.mentions(aspects.scoreable(waiting), lexicon), model, lexicon, keys=("chunk_id", "document_id", "section", "text"))
    sinks.append(new, f"{root}/scores")
    scores = spark.read.parquet(f"{root}/scores").where(F.col("model_name") == model).join(dated, "document_id").withColumn("similarity", F.lit(0.0))
    top = grounding.evidence_topk(scores)
    one = Window.partitionBy("chunk_id").orderBy(F.desc("strength"), "aspect")
    verified = grounding.verify(grounding.greedy_claims(top), top.withColumn("rn", F.row_number().over(one)).where("rn = 1"))
    briefs = grounding.assemble(verified, grounding.stance(grounding.side_counts(scores)), grounding.brief_confidence(verified, scores, len(lexicon.terms)))
    moves = signals.top_moves(signals.trajectory(scores), dated)
    return Outcome(stats, scores, briefs, signals.drift(scores, list(lexicon.terms)), moves)
