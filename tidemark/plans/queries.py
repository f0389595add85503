"""Queries over the adapters, each with DuckDB SQL where SQL can say it."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import polarity, valence
from tidemark.functions import text as tx
from tidemark.functions.lexicons import LABELS, NEGATIVE_EVENTS, POSITIVE_EVENTS, term_pattern
from tidemark.functions.text import half_up
from tidemark.operators import aspects, evaluation, grounding, models, sampling, service, signals, textbayes, transcripts, wordvectors
from tidemark.operators.scratch import scratch_dir, written
from tidemark.plans import adapters as ad
from tidemark.streaming import stateful

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r(x: str, digits: int = 4) -> str:
    return f"floor(({x}) * 1e{digits}::DOUBLE + 0.5::DOUBLE) / 1e{digits}::DOUBLE"


def rm(x: str, digits: int = 4) -> str:
    return f"floor(sum(floor({x} * 1e{digits}::DOUBLE + 0.5::DOUBLE)) / count({x}) + 0.5::DOUBLE) / 1e{digits}::DOUBLE"


_MEANS = f"""avg(score) AS m, count(*) AS n, avg(CASE WHEN section = 'prepared' THEN score END) AS p, avg(CASE WHEN section = 'qa' THEN score END) AS q,
  count(CASE WHEN section = 'prepared' THEN 1 END) AS prepared_n, count(CASE WHEN section = 'qa' THEN 1 END) AS qa_n"""
_SUMMARY = f"""summary AS (SELECT ticker, doc_date, aspect, {r('m')} AS mean, n, {r('p')} AS prepared, {r('q')} AS qa, prepared_n, qa_n, {r('q - p')} AS delta
  FROM (SELECT ticker, doc_date, aspect, {_MEANS} FROM scores GROUP BY ALL))"""
_TRAJECTORY = f"""trajectory AS (SELECT ticker, aspect, document_id, doc_type, doc_date, {r('m')} AS mean, n, {r('p')} AS prepared, {r('q')} AS qa
  FROM (SELECT ticker, aspect, document_id, doc_type, doc_date, {_MEANS} FROM scores GROUP BY ALL))"""

# --- signals ---------------------------------------------------------------


@query(f"WITH {ad.SCORES}, {_SUMMARY} SELECT * FROM summary")
def aspect_summary(spark, sf_dir):
    return signals.aspect_summary(ad.scores(spark, sf_dir))


@query(f"WITH {ad.SCORES.replace('FROM events', 'FROM events WHERE event_id % 2 = 0')}, {_SUMMARY} SELECT * FROM summary")
def aspect_summary_one_model(spark, sf_dir):
    return signals.aspect_summary(ad.scores(spark, sf_dir), "lm_directional")


@query(f"WITH {ad.SCORES}, {_SUMMARY} SELECT ticker, doc_date, {rm('delta')} AS delta FROM summary GROUP BY ALL")
def transcript_delta(spark, sf_dir):
    return signals.transcript_delta(aspect_summary(spark, sf_dir))


@query(f"WITH {ad.SCORES}, {_SUMMARY} SELECT ticker, doc_date, {rm('mean')} AS sentiment FROM summary GROUP BY ALL")
def doc_level_sentiment(spark, sf_dir):
    return signals.document_sentiment(aspect_summary(spark, sf_dir))


@query(f"WITH {ad.SCORES}, {_TRAJECTORY} SELECT * FROM trajectory")
def aspect_trajectory(spark, sf_dir):
    return signals.trajectory(ad.scores(spark, sf_dir))


@query(f"""WITH {ad.SCORES}, {_TRAJECTORY} SELECT ticker, aspect, count(*) AS n_points, min(doc_date) AS first_date, max(doc_date) AS last_date,
  arg_max(mean, doc_date) AS last_mean FROM trajectory GROUP BY ALL""")
def trajectory_last(spark, sf_dir):
    p = signals.trajectory_lists(ad.scores(spark, sf_dir))
    return p.select("ticker", "aspect", F.size("points").cast("long").alias("n_points"), F.element_at("points", 1)["doc_date"].alias("first_date"),
                    F.element_at("points", -1)["doc_date"].alias("last_date"), F.element_at("points", -1)["mean"].alias("last_mean"))


@query(f"""WITH {ad.SCORES} SELECT chunk_id, ticker, doc_date, section, {r('score')} AS score FROM scores
  WHERE ticker = 'T3' AND aspect = 'purchase' ORDER BY doc_date, chunk_id LIMIT 200""")
def points_topn(spark, sf_dir):
    s = ad.scores(spark, sf_dir)
    chunks = s.select("chunk_id", F.col("chunk_id").alias("idx"))
    return signals.drill_down(s, chunks, "T3", "purchase").select("chunk_id", "ticker", "doc_date", "section", half_up(F.col("score")).alias("score"))


@query(f"""WITH {ad.SENTENCES}, near AS (SELECT doc_id, idx AS target_idx, unnest(range(idx - 3, idx + 4)) AS idx FROM sents)
  SELECT t.doc_id AS document_id, t.target_idx, c.idx, length(c.s) AS n, c.idx = t.target_idx AS is_target FROM near t JOIN sents c ON c.doc_id = t.doc_id AND c.idx = t.idx""")
def chunk_context(spark, sf_dir):
    # of the text only its length is asked for, so only that travels
    chunks = ad.corpus_chunks(spark, sf_dir).select("document_id", "idx", F.length("text").cast("long").alias("n"))
    return signals.context(chunks, 3, F.lit(True)).select("document_id", "target_idx", "idx", "n", "is_target")


@query(f"""WITH {ad.SENTENCES} SELECT doc_id AS document_id, idx, md5(lag(s) OVER w) AS previous, md5(lead(s) OVER w) AS "next" FROM sents WINDOW w AS (PARTITION BY doc_id ORDER BY idx)""")
def sentence_neighbors(spark, sf_dir):
    return signals.neighbours(ad.corpus_chunks(spark, sf_dir)).select("document_id", "idx", F.md5("previous").alias("previous"), F.md5("next").alias("next"))


_LATEST = "row_number() OVER (PARTITION BY ticker ORDER BY (doc_type = 'transcript') DESC, doc_date DESC, document_id DESC)"


@query(f"""WITH {ad.SCORES}, {ad.SCORE_DOCS}, {_SUMMARY}, latest AS (SELECT *, {_LATEST} AS rn FROM docs)
  SELECT l.ticker, l.document_id, l.doc_type, s.aspect, s.mean, s.n, s.delta, CASE WHEN s.delta < -0.5 THEN true ELSE false END AS flagged
  FROM latest l JOIN summary s ON s.ticker = l.ticker AND s.doc_date = l.doc_date WHERE rn = 1""")
def watchlist_latest(spark, sf_dir):
    s = ad.scores(spark, sf_dir)
    got = signals.watchlist(s, ad.score_documents(s))
    return got.select("ticker", "document_id", "doc_type", "aspect", "mean", "n", "delta", F.coalesce(F.col("delta") < -0.5, F.lit(False)).alias("flagged"))


@query(f"WITH {ad.SCORES}, {ad.SCORE_DOCS} SELECT document_id, ticker, doc_type, doc_date FROM docs QUALIFY rank() OVER (PARTITION BY ticker, doc_type ORDER BY doc_date DESC) = 1")
def latest_docs_per_type(spark, sf_dir):
    return signals.latest_documents(ad.score_documents(ad.scores(spark, sf_dir)))


@query(f"""WITH {ad.SCORES}, {ad.SCORE_DOCS}, {_TRAJECTORY},
  newest AS (SELECT document_id FROM docs QUALIFY rank() OVER (PARTITION BY ticker, doc_type ORDER BY doc_date DESC) = 1),
  cur AS (SELECT * FROM trajectory WHERE n >= 3 AND document_id IN (SELECT document_id FROM newest) QUALIFY row_number() OVER (PARTITION BY ticker, aspect ORDER BY doc_date DESC, document_id DESC) = 1),
  moves AS (SELECT c.ticker, c.aspect, c.doc_date AS to_date, p.doc_date AS from_date, p.mean AS from_mean, c.mean AS to_mean, {r('c.mean - p.mean', 3)} AS change
    FROM cur c JOIN trajectory p ON p.ticker = c.ticker AND p.aspect = c.aspect AND p.doc_type = c.doc_type AND p.doc_date < c.doc_date AND p.n >= 3
    QUALIFY row_number() OVER (PARTITION BY c.ticker, c.aspect ORDER BY p.doc_date DESC, p.document_id DESC) = 1)
  SELECT * FROM moves ORDER BY abs(change) DESC, ticker, aspect LIMIT 10""")
def top_moves(spark, sf_dir):
    s = ad.scores(spark, sf_dir)
    return signals.top_moves(signals.trajectory(s), ad.score_documents(s), n=10)


@query(f"WITH {ad.SCORES} SELECT ticker, aspect, count(*) AS n, {r('count(*) / sum(count(*)) OVER (PARTITION BY ticker)', 6)} AS share FROM scores GROUP BY ticker, aspect")
def aspect_mix(spark, sf_dir):
    return signals.aspect_mix(ad.scores(spark, sf_dir)).withColumn("share", half_up(F.col("share"), 6))


_ASPECTS = ["click", "purchase", "refund", "signup", "view"]
def _drift_sql(ends: str, upto: str = "") -> str:
    """Drift reports at ``ends`` (ticker, as_of), from the rows themselves."""
    return f"""WITH {ad.SCORES}, rows AS (SELECT unnest([ticker, 'ALL']) AS ticker, aspect, doc_date, confidence FROM scores {upto}), ends AS ({ends}),
  parts AS (SELECT e.ticker, e.as_of, r.aspect, r.confidence, CASE WHEN date_diff('day', r.doc_date, e.as_of) < 7 THEN 'cur' ELSE 'base' END AS side
    FROM ends e LEFT JOIN rows r ON r.ticker = e.ticker AND date_diff('day', r.doc_date, e.as_of) BETWEEN 0 AND 34),
  per AS (SELECT ticker, as_of, count(confidence) FILTER (side = 'cur') AS cur_n, count(confidence) FILTER (side = 'base') AS base_n,
    avg(confidence) FILTER (side = 'cur') AS cm, avg(confidence) FILTER (side = 'base') AS bm, stddev_pop(confidence) FILTER (side = 'cur') AS cs, stddev_pop(confidence) FILTER (side = 'base') AS bs
    FROM parts GROUP BY ALL),
  counts AS (SELECT ticker, as_of, aspect, count(*) FILTER (side = 'cur') AS c, count(*) FILTER (side = 'base') AS b FROM parts GROUP BY ALL),
  mix AS (SELECT p.ticker, p.as_of, greatest(coalesce(x.c, 0) / p.cur_n, 1e-4) AS c, greatest(coalesce(x.b, 0) / p.base_n, 1e-4) AS b
    FROM per p CROSS JOIN (SELECT unnest({_ASPECTS}) AS aspect) a LEFT JOIN counts x ON x.ticker = p.ticker AND x.as_of = p.as_of AND x.aspect = a.aspect WHERE p.cur_n > 0 AND p.base_n > 0),
  psi AS (SELECT ticker, as_of, sum((c - b) * ln(c / b)) AS psi FROM mix GROUP BY ALL),
  done AS (SELECT ticker, as_of, cur_n, base_n, CASE WHEN cur_n >= 5 AND base_n >= 5 THEN {r('psi')} ELSE 0 END AS psi,
    CASE WHEN cur_n >= 5 AND base_n >= 5 AND sqrt((cs * cs + bs * bs) / 2) > 1e-9 THEN {r('(cm - bm) / sqrt((cs * cs + bs * bs) / 2)')} ELSE 0 END AS shift,
    CASE WHEN cur_n >= 5 AND base_n >= 5 THEN 'ok' ELSE 'insufficient_data' END AS status FROM per LEFT JOIN psi USING (ticker, as_of))
  SELECT *, psi > 0.25 OR abs(shift) > 0.8 AS alert FROM done"""


@query(_drift_sql("SELECT ticker, max(doc_date) AS as_of FROM rows GROUP BY ticker"))
def drift_reports(spark, sf_dir):
    return signals.drift(ad.scores(spark, sf_dir), _ASPECTS)


@query(_drift_sql("SELECT ticker, CASE WHEN ticker = 'ALL' THEN DATE '2024-01-25' ELSE max(doc_date) END AS as_of FROM rows GROUP BY ticker", "WHERE doc_date <= DATE '2024-01-25'"))
def drift_as_of(spark, sf_dir):
    return signals.drift(ad.scores(spark, sf_dir), _ASPECTS, "2024-01-25")


@query(_drift_sql("SELECT DISTINCT ticker, doc_date AS as_of FROM rows"))
def drift_series(spark, sf_dir):
    return signals.drift_series(ad.scores(spark, sf_dir), _ASPECTS)


def _fed(spark, live):
    """What a stream over the table gives, in a new folder of the shared one that stays."""
    root = f"{scratch_dir(spark)}/stream-{uuid.uuid4().hex}"
    stateful.run_available(live, f"{root}/out", f"{root}/checkpoint")
    return spark.read.parquet(f"{root}/out")


@query()
def live_drift(spark, sf_dir):
    return _fed(spark, stateful.live_drift(ad.live_scores(spark, sf_dir), _ASPECTS))


@query()
def live_trajectory(spark, sf_dir):
    return _fed(spark, stateful.live_trajectory(ad.live_scores(spark, sf_dir)))


@query(f"WITH {ad.SCORES} SELECT ticker, max(doc_date) - 180 AS window_start, max(doc_date) AS window_end FROM scores GROUP BY ticker")
def brief_window(spark, sf_dir):
    return signals.default_window(ad.scores(spark, sf_dir))


def _runs(spark, sf_dir):
    s = ad.table(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").cast("long").alias("run_id"), F.concat(F.lit("m"), F.col("s_nationkey") % 3).alias("name"), (F.col("s_suppkey") % 7 == 0).alias("serving"))


_RUNS = "runs AS (SELECT CAST(s_suppkey AS BIGINT) AS run_id, 'm' || (s_nationkey % 3) AS name, s_suppkey % 7 = 0 AS serving FROM supplier)"


@query(f"WITH {_RUNS} SELECT * FROM runs WHERE serving ORDER BY run_id DESC LIMIT 1")
def serving_model(spark, sf_dir):
    return signals.serving_model(_runs(spark, sf_dir))


@query(f"WITH {_RUNS} SELECT run_id, name, name = 'm1' AND run_id = max(run_id) OVER (PARTITION BY name) AS serving FROM runs")
def serving_flag_flip(spark, sf_dir):
    return signals.set_serving(_runs(spark, sf_dir), "m1")


@query(f"WITH {ad.SCORES} SELECT CASE WHEN score > 0.15 THEN 'positive' WHEN score < -0.15 THEN 'negative' ELSE 'neutral' END AS bucket, count(*) AS n, count(DISTINCT ticker) AS tickers FROM scores GROUP BY 1")
def score_buckets(spark, sf_dir):
    s = ad.scores(spark, sf_dir).withColumn("bucket", signals.score_bucket(F.col("score")))
    return s.groupBy("bucket").agg(F.count("*").alias("n"), F.count_distinct("ticker").alias("tickers"))


@query(f"""WITH {ad.SCORES} SELECT coalesce(ticker, 'ALL') AS ticker, coalesce(section, 'all') AS section, count(*) AS n, {r('avg(score)')} AS mean FROM scores GROUP BY GROUPING SETS ((ticker, section), (ticker), (section), ())""")
def section_grouping_sets(spark, sf_dir):
    ad.scores(spark, sf_dir).createOrReplaceTempView("aspect_scores")
    got = spark.sql("SELECT ticker, section, count(*) AS n, avg(score) AS m FROM aspect_scores GROUP BY GROUPING SETS ((ticker, section), (ticker), (section), ())")
    return got.select(F.coalesce("ticker", F.lit("ALL")).alias("ticker"), F.coalesce("section", F.lit("all")).alias("section"), "n", half_up(F.col("m")).alias("mean"))


# --- evidence and briefs -----------------------------------------------------

_STRENGTH = "abs(score) * (0.5::DOUBLE + confidence)"
_SIDE = "CASE WHEN score > 0.15 THEN 'bull' WHEN score < -0.15 THEN 'bear' END"
_TOP = f"""sided AS (SELECT *, {_SIDE} AS side, {_STRENGTH} AS strength FROM scores),
  top AS (SELECT *, row_number() OVER (PARTITION BY ticker, aspect, side ORDER BY strength DESC, chunk_id) AS rank FROM sided WHERE side IS NOT NULL QUALIFY rank <= 4)"""


@query(f"WITH {ad.SCORES}, {_TOP} SELECT ticker, aspect, side, rank, chunk_id, {r('strength')} AS strength FROM top")
def evidence_topk(spark, sf_dir):
    return grounding.evidence_topk(ad.scores(spark, sf_dir)).select("ticker", "aspect", "side", "rank", "chunk_id", half_up(F.col("strength")).alias("strength"))


@query(f"WITH {ad.SCORES} SELECT ticker, aspect, {r('avg(score)')} AS mean, count(*) AS n, count_if(score > 0.15) AS n_pos, count_if(score < -0.15) AS n_neg FROM scores GROUP BY ALL")
def aspect_side_counts(spark, sf_dir):
    return grounding.side_counts(ad.scores(spark, sf_dir))


@query(f"""WITH {ad.SCORES}, s AS (SELECT ticker, aspect, {r('avg(score)')} AS mean FROM scores GROUP BY ALL), net AS (SELECT ticker, round(avg(mean), 9) AS net FROM s GROUP BY ticker)
  SELECT ticker, {r('net', 3)} AS net, CASE WHEN net > 0.2 THEN 'leaning positive' WHEN net < -0.2 THEN 'leaning negative' ELSE 'mixed' END AS stance FROM net""")
def stance(spark, sf_dir):
    return grounding.stance(aspect_side_counts(spark, sf_dir))


def _claims(spark, sf_dir):
    """Verified claims made from scores: the status follows from the key."""
    s = ad.scores(spark, sf_dir)
    status = F.element_at(tx.strings(["supported", "unverified", "rejected"]), (F.col("chunk_id") % 3 + 1).cast("int"))
    return s.select("ticker", F.concat(F.lit("c"), "chunk_id").alias("claim_id"), F.when(F.col("score") > 0, "bull").otherwise("bear").alias("side"), "aspect",
                    F.array(F.col("chunk_id") % 50, F.col("chunk_id") % 7).alias("cited"), status.alias("status"), F.col("chunk_id").alias("ord"), F.lit("claim").alias("text"))


_CLAIMS = """claims AS (SELECT ticker, 'c' || chunk_id AS claim_id, CASE WHEN score > 0 THEN 'bull' ELSE 'bear' END AS side, aspect, [chunk_id % 50, chunk_id % 7] AS cited,
  ['supported', 'unverified', 'rejected'][chunk_id % 3 + 1] AS status, chunk_id AS ord FROM scores)"""


@query(f"""WITH {ad.SCORES}, {_CLAIMS}, c AS (SELECT ticker, count(*) AS total, count_if(status = 'supported') AS sup, count_if(status = 'unverified') AS unv,
    count(DISTINCT CASE WHEN status <> 'rejected' THEN aspect END) AS covered FROM claims GROUP BY ticker), e AS (SELECT ticker, avg(confidence) AS sure FROM scores GROUP BY ticker)
  SELECT ticker, total, sup, unv, covered, {r('(sup + 0.4::DOUBLE * unv) / total', 3)} AS survival,
    {r('least(1.0::DOUBLE, 0.5::DOUBLE * ((sup + 0.4::DOUBLE * unv) / total) + 0.3::DOUBLE * sure + 0.2::DOUBLE * covered / 6)', 3)} AS confidence FROM c JOIN e USING (ticker)""")
def brief_confidence(spark, sf_dir):
    return grounding.brief_confidence(_claims(spark, sf_dir), ad.scores(spark, sf_dir))


@query(f"WITH {ad.SCORES}, {_CLAIMS} SELECT ticker, side, claim_id FROM claims QUALIFY row_number() OVER (PARTITION BY ticker, side, list_sort(cited) ORDER BY ord, claim_id) = 1")
def claim_dedupe(spark, sf_dir):
    return grounding.dedupe_claims(_claims(spark, sf_dir)).select("ticker", "side", "claim_id")


@query(f"WITH {ad.SCORES}, {_CLAIMS} SELECT ticker, count_if(status = 'supported') AS supported, count_if(status = 'unverified') AS unverified, count_if(status = 'rejected') AS rejected FROM claims GROUP BY ticker")
def verdict_counts(spark, sf_dir):
    return grounding.verdict_counts(_claims(spark, sf_dir))


_LINE = "chunk_id || '|' || aspect || '|' || CAST(floor(score * 1000 + 0.5::DOUBLE) AS BIGINT) || '|' || model_name"
_PRINTS = f"prints AS (SELECT ticker, sha256(string_agg({_LINE}, chr(10) ORDER BY {_LINE})) AS fingerprint, count(*) AS n FROM scores GROUP BY ticker)"


@query(f"WITH {ad.SCORES}, {_PRINTS} SELECT * FROM prints")
def fingerprint_groups(spark, sf_dir):
    return grounding.fingerprints(ad.scores(spark, sf_dir))


@query(f"WITH {ad.SCORES}, {_PRINTS} SELECT * FROM prints WHERE ticker NOT IN ('T0', 'T1', 'T2')")
def stale_briefs(spark, sf_dir):
    p = fingerprint_groups(spark, sf_dir)
    return grounding.stale(p, p.where(F.col("ticker").isin("T0", "T1", "T2")))


@query(f"""WITH {ad.SCORES}, cited AS (SELECT ticker, unnest([chunk_id, chunk_id + 1]) AS id FROM scores)
  SELECT DISTINCT c.ticker, s.chunk_id, s.doc_date, s.aspect FROM cited c JOIN scores s ON s.chunk_id = c.id""")
def brief_citations(spark, sf_dir):
    s = ad.scores(spark, sf_dir)
    body = s.select("ticker", F.array_union(F.array("chunk_id"), F.array(F.col("chunk_id") + 1)).alias("ids"))
    cited = body.select("ticker", F.explode("ids").alias("chunk_id"))
    return cited.join(s.select("chunk_id", "doc_date", "aspect"), "chunk_id").select("ticker", "chunk_id", "doc_date", "aspect").distinct()


def _evidence(spark, sf_dir):
    """Sentences of the corpus that the syllable lexicon scores, as evidence."""
    # a text has fewer sentences than a million
    chunks = ad.corpus_chunks(spark, sf_dir).withColumn("chunk_id", F.col("document_id") * 1_000_000 + F.col("idx"))
    got = aspects.score_chunks(chunks, "lm_directional", ad.SYLLABLES, keys=("chunk_id", "ticker", "text"))
    # several branches of a brief read it: scored once and written
    return written(got.select("chunk_id", "ticker", "text", "aspect", "score", "confidence").withColumns({"similarity": F.lit(0.0), "doc_date": F.lit("2024-01-01").cast("date"), "section": F.lit("body")}))


def _top_evidence(evidence):
    """A few rows per ticker, aspect and side, which all that follows reads: drawn once from the evidence and written."""
    return written(grounding.evidence_topk(evidence))


@query()
def claim_verification(spark, sf_dir):
    top = _top_evidence(_evidence(spark, sf_dir))
    one = Window.partitionBy("chunk_id").orderBy(F.desc("strength"), "aspect")
    sources = top.withColumn("rn", F.row_number().over(one)).where("rn = 1")
    got = grounding.verify(grounding.greedy_claims(top), sources)
    return got.select("ticker", "claim_id", "status", "reason", "n_cited", "n_found", half_up(F.col("sim"), 3).alias("sim"), half_up(F.col("overlap"), 3).alias("overlap"))


@query()
def entailment_verdicts(spark, sf_dir):
    """The entailment branch, with a scorer that needs no model."""
    top = _top_evidence(_evidence(spark, sf_dir))
    one = Window.partitionBy("chunk_id").orderBy(F.desc("strength"), "aspect")
    sources = top.withColumn("rn", F.row_number().over(one)).where("rn = 1")
    got = grounding.verify(grounding.greedy_claims(top), sources, entailment=grounding.entailment_hook(grounding.shared_words))
    return got.select("ticker", "claim_id", "status", "reason", half_up(F.col("nli.entailment"), 3).alias("entailment"), half_up(F.col("nli.contradiction"), 3).alias("contradiction"))


@query()
def adversarial_catch_rates(spark, sf_dir):
    top = _top_evidence(_evidence(spark, sf_dir))
    one = Window.partitionBy("chunk_id").orderBy(F.desc("strength"), "aspect")
    sources = top.withColumn("rn", F.row_number().over(one)).where("rn = 1")
    made_up = ["A pending merger will widen the market.", "A buyback of 12 million shares was agreed.", "Supply has recovered in all regions."]
    cases = grounding.adversarial_cases(sources, made_up)
    return grounding.catch_rates(grounding.verify(cases, sources, keys=("ticker", "claim_id")))


@query()
def briefs(spark, sf_dir):
    evidence = _evidence(spark, sf_dir)
    top = _top_evidence(evidence)
    one = Window.partitionBy("chunk_id").orderBy(F.desc("strength"), "aspect")
    verified = grounding.verify(grounding.greedy_claims(top), top.withColumn("rn", F.row_number().over(one)).where("rn = 1"))
    return grounding.assemble(verified, grounding.stance(grounding.side_counts(evidence)), grounding.brief_confidence(verified, evidence)).withColumn("sections", F.to_json("sections"))


# --- text ----------------------------------------------------------------


@query("""SELECT content_hash, count(*) AS n, min(doc_id) AS first_id FROM
  (SELECT doc_id, sha256(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'), ' ')) AS content_hash FROM documents WHERE length(text) >= 20) GROUP BY content_hash""")
def content_hash_dedupe(spark, sf_dir):
    d = ad.table(spark, sf_dir, "documents").where(F.length("text") >= 20)
    return d.groupBy(tx.content_hash(F.col("text")).alias("content_hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


@query(f"WITH {ad.SENTENCES} SELECT doc_id AS document_id, idx, md5(s) AS digest FROM sents")
def sentence_split(spark, sf_dir):
    return ad.corpus_chunks(spark, sf_dir).select("document_id", "idx", F.md5("text").alias("digest"))


@query(f"WITH {ad.SENTENCES} SELECT doc_id AS document_id, count(*) AS n_sentences, CAST(sum(len({ad.TOKEN_SQL})) AS BIGINT) AS n_tokens FROM sents GROUP BY doc_id")
def token_count(spark, sf_dir):
    c = ad.corpus_chunks(spark, sf_dir)
    return c.groupBy("document_id").agg(F.count("*").alias("n_sentences"), F.sum(F.size(tx.tokens(F.col("text")))).alias("n_tokens"))


def _in(words: list[str]) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


_L = ad.SYLLABLES
_TOKENS = f"""toks AS (SELECT doc_id, idx, unnest({ad.TOKEN_SQL}) AS t, generate_subscripts({ad.TOKEN_SQL}, 1) AS i FROM sents),
  kinds AS (SELECT *, lower(t) AS w, CASE WHEN lower(t) IN {_in(_L.cues)} OR lower(t) LIKE '%n''t' THEN 1 WHEN lower(t) IN {_in(_L.breaks)} THEN 2 ELSE 0 END AS kind FROM toks),
  reach AS (SELECT *, max(CASE WHEN kind = 1 THEN i END) OVER w AS cue, coalesce(max(CASE WHEN kind = 2 THEN i END) OVER w, 0) AS stop FROM kinds WINDOW w AS (PARTITION BY doc_id, idx ORDER BY i)),
  masked AS (SELECT *, kind = 0 AND coalesce(cue > stop AND i - cue <= 4, false) AS m FROM reach)"""


@query(f"WITH {ad.SENTENCES}, {_TOKENS} SELECT doc_id AS document_id, count(*) AS n_tokens, count_if(m) AS n_negated FROM masked GROUP BY doc_id")
def negated_tokens(spark, sf_dir):
    c = ad.corpus_chunks(spark, sf_dir).withColumn("toks", tx.tokens(F.col("text")))
    masked = c.withColumn("n", F.size(F.filter(tx.negated(F.col("toks"), _L.cues, _L.breaks), lambda m: m)))
    return masked.where(F.size("toks") > 0).groupBy("document_id").agg(F.sum(F.size("toks")).alias("n_tokens"), F.sum("n").alias("n_negated"))


_V = valence.Valences({w: 1.9 for w in _L.positive} | {w: -1.7 for w in _L.negative}, {"it": valence.BOOST, "on": valence.BOOST, "la": -valence.BOOST}, tuple(_L.cues), ("or", "und"))
_VALUE = " ".join(f"WHEN '{w}' THEN {v}::DOUBLE" for w, v in _V.words.items())
_BOOSTS = " ".join(f"WHEN '{w}' THEN {v}::DOUBLE" for w, v in _V.boosters.items())
_PUNCT = valence.PUNCTUATION.replace("'", "''")


def _step(d: int, near: str, sure: str) -> str:
    """What the word d places before does to the value x."""
    raised = f"(x + CASE WHEN b{d} <> 0 THEN CASE WHEN x < 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END * (b{d} + CASE WHEN up{d} AND mixed THEN {valence.CAPITALS}::DOUBLE ELSE 0 END) * {valence.DISTANCE[d - 1]}::DOUBLE ELSE 0 END)"
    turned = f"CASE WHEN w{d} = 'never' AND ({near}) THEN {valence.NEVER_SO}::DOUBLE WHEN w{d} = 'without' AND ({sure}) THEN 1.0::DOUBLE WHEN neg{d} THEN {valence.NEGATION}::DOUBLE ELSE 1.0::DOUBLE END"
    return f"CASE WHEN i > {d} AND v{d} IS NULL THEN {raised} * {turned} ELSE x END"


_VALENCE = f"""vp AS (SELECT doc_id, idx, s, list_filter(string_split_regex(s, '[ \t\n\r\f\x0B]+'), lambda t: t <> '') AS ps FROM sents),
  vt AS (SELECT doc_id, idx, s, unnest(list_transform(ps, lambda t: CASE WHEN length(regexp_replace(t, '^{_PUNCT}+|{_PUNCT}+$', '', 'g')) <= 2 THEN t ELSE regexp_replace(t, '^{_PUNCT}+|{_PUNCT}+$', '', 'g') END)) AS t, generate_subscripts(ps, 1) AS i FROM vp),
  vi AS (SELECT *, lower(t) AS w, t = upper(t) AND t <> lower(t) AS up, CASE lower(t) {_VALUE} END AS v, CASE lower(t) {_BOOSTS} ELSE 0 END AS b, lower(t) IN {_in(list(_V.negations))} OR contains(lower(t), 'n''t') AS neg FROM vt),
  vl AS (SELECT *, count_if(up) OVER a > 0 AND count_if(up) OVER a < count(*) OVER a AS mixed, min(CASE WHEN w IN {_in(list(_V.contrast))} THEN i END) OVER a AS turn,
    {", ".join(f"lag({c}, {d}) OVER o AS {c}{d}" for d in (1, 2, 3) for c in ("w", "up", "v", "b", "neg"))} FROM vi WINDOW a AS (PARTITION BY doc_id, idx), o AS (PARTITION BY doc_id, idx ORDER BY i)),
  v0 AS (SELECT *, v + CASE WHEN up AND mixed THEN sign(v) * {valence.CAPITALS}::DOUBLE ELSE 0 END AS x FROM vl WHERE b = 0 AND v IS NOT NULL),
  v1s AS (SELECT * REPLACE ({_step(1, 'false', 'false')} AS x) FROM v0),
  v2s AS (SELECT * REPLACE ({_step(2, "w1 IN ('so', 'this')", "w1 = 'doubt'")} AS x) FROM v1s),
  v3s AS (SELECT * REPLACE ({_step(3, "w1 IN ('so', 'this') OR w2 IN ('so', 'this')", "w1 = 'doubt' OR w2 = 'doubt'")} AS x) FROM v2s),
  v4s AS (SELECT doc_id, idx, sum(x * CASE WHEN i > 1 AND w1 = 'least' AND v1 IS NULL AND (i < 3 OR w2 NOT IN ('at', 'very')) THEN {valence.NEGATION}::DOUBLE ELSE 1 END
    * CASE WHEN turn IS NULL OR i = turn THEN 1.0::DOUBLE WHEN i < turn THEN {valence.BEFORE_CONTRAST}::DOUBLE ELSE {valence.AFTER_CONTRAST}::DOUBLE END) AS x FROM v3s GROUP BY ALL),
  v5s AS (SELECT s.doc_id, s.idx, coalesce(x, 0) AS x, least(length(s) - length(replace(s, '!', '')), {valence.MOST_EXCLAMATIONS}) * {valence.EXCLAMATION}::DOUBLE
    + CASE WHEN length(s) - length(replace(s, '?', '')) > {valence.MOST_QUESTIONS} THEN {valence.MANY_QUESTIONS}::DOUBLE WHEN length(s) - length(replace(s, '?', '')) > 1 THEN (length(s) - length(replace(s, '?', ''))) * {valence.QUESTION}::DOUBLE ELSE 0 END AS e
    FROM sents s LEFT JOIN v4s USING (doc_id, idx)), v6s AS (SELECT doc_id, idx, CASE WHEN x > 0 THEN x + e WHEN x < 0 THEN x - e ELSE 0 END AS x FROM v5s)"""


@query(f"WITH {ad.SENTENCES}, {_VALENCE} SELECT doc_id AS document_id, idx, {r(f'x / sqrt(x * x + {valence.ALPHA}::DOUBLE)')} AS score FROM v6s")
def valence_scores(spark, sf_dir):
    c = ad.corpus_chunks(spark, sf_dir)
    return c.select("document_id", "idx", half_up(valence.valence_score(F.col("text"), _V)).alias("score"))


@query(f"""WITH {ad.SENTENCES}, {_TOKENS}, vocabulary AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM benchmark),
  vectors AS (SELECT w, embedding FROM vocabulary JOIN embeddings ON vec_id = ('0x' || substr(md5(w), 1, 8))::BIGINT % 500),
  uses AS (SELECT doc_id, w, m AND regexp_full_match(t, '[A-Za-z]+') AS negated, count(*) AS n FROM masked GROUP BY ALL),
  found AS (SELECT doc_id, n, n * CASE WHEN negated THEN -0.5::DOUBLE ELSE 1 END AS weight, embedding FROM uses JOIN vectors USING (w)),
  dims AS (SELECT doc_id, d, sum(weight * embedding[d]::DOUBLE) / sum(n) AS x FROM found, range(1, 65) r(d) GROUP BY ALL),
  whole AS (SELECT doc_id, max(CASE WHEN d = 1 THEN x END) AS a, max(CASE WHEN d = 64 THEN x END) AS b, sqrt(sum(x * x)) AS norm FROM dims GROUP BY ALL),
  totals AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_tokens, CAST(coalesce(sum(CASE WHEN w IN (SELECT w FROM vectors) THEN n END), 0) AS BIGINT) AS n_found FROM uses GROUP BY ALL)
  SELECT doc_id AS document_id, n_tokens, n_found, {r('a')} AS first, {r('b')} AS last, {r('norm')} AS norm FROM totals LEFT JOIN whole USING (doc_id)""")
def pooled_vectors(spark, sf_dir):
    words = ad.table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word")).distinct()
    words = words.withColumn("vec_id", F.conv(F.substring(F.md5("word"), 1, 8), 16, 10).cast("long") % 500)
    vectors = words.join(ad.table(spark, sf_dir, "embeddings"), "vec_id").select("word", F.col("embedding").alias("vector"))
    got = wordvectors.pooled_vectors(ad.corpus_chunks(spark, sf_dir), vectors, ["document_id"], _L)
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    return got.select("document_id", "n_tokens", "n_found", half_up(F.get("vector", F.lit(0))).alias("first"), half_up(F.get("vector", F.lit(63))).alias("last"), half_up(norm).alias("norm"))


@query(f"""WITH {ad.SENTENCES}, {_TOKENS}, words AS (SELECT doc_id, idx, count(*) AS n, count_if(w IN {_in(_L.hedges)}) AS hits FROM kinds WHERE regexp_full_match(t, '[A-Za-z]+') OR contains(t, '''') GROUP BY ALL)
  SELECT s.doc_id AS document_id, s.idx, {r('least(1.0::DOUBLE, coalesce(w.hits, 0) / greatest(3.0::DOUBLE, coalesce(w.n, 0) * 0.25::DOUBLE))', 6)} AS hedge FROM sents s LEFT JOIN words w USING (doc_id, idx)""")
def hedge_scores(spark, sf_dir):
    return ad.corpus_chunks(spark, sf_dir).select("document_id", "idx", half_up(tx.hedge_score(F.col("text"), _L.hedges), 6).alias("hedge"))


_CONTRAST = "|".join(_L.contrast)
_CLAUSES = rf"""parts AS (SELECT doc_id, idx, s, list_filter(list_transform(regexp_split_to_array(s, '(?i)\s*(?:;|,?\s+\b(?:{_CONTRAST})\b)\s*'), lambda p: trim(p, ' ,')), lambda p: p <> '') AS ps FROM sents),
  clauses AS (SELECT doc_id, idx, unnest(CASE WHEN len(ps) = 0 THEN [s] ELSE ps END) AS clause, generate_subscripts(CASE WHEN len(ps) = 0 THEN [s] ELSE ps END, 1) - 1 AS clause_idx FROM parts)"""


@query(f"WITH {ad.SENTENCES}, {_CLAUSES} SELECT doc_id AS document_id, idx, clause_idx, md5(clause) AS digest FROM clauses")
def clause_split(spark, sf_dir):
    c = ad.corpus_chunks(spark, sf_dir)
    parts = c.select("document_id", "idx", F.posexplode(tx.clauses(F.col("text"), _L.contrast)).alias("clause_idx", "clause"))
    return parts.select("document_id", "idx", F.col("clause_idx").cast("long").alias("clause_idx"), F.md5("clause").alias("digest"))


@query("""WITH c AS (SELECT doc_id, list_distinct(list_transform(regexp_extract_all(text, '\\d[\\d,]*(?:\\.\\d+)?'), lambda n: rtrim(replace(n, ',', ''), '.'))) AS ns FROM documents)
  SELECT doc_id, len(ns) AS n_numbers, array_to_string(list_sort(ns), ' ') AS numbers FROM c""")
def number_sets(spark, sf_dir):
    d = ad.table(spark, sf_dir, "documents").select("doc_id", tx.numbers(F.col("text")).alias("ns"))
    return d.select("doc_id", F.size("ns").cast("long").alias("n_numbers"), F.array_join(F.array_sort("ns"), " ").alias("numbers"))


_STOPPED = _in(__import__("tidemark.functions.lexicons", fromlist=["STOP_WORDS"]).STOP_WORDS)


@query(f"""SELECT doc_id, len(list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z][a-z''\\-]+')), lambda w: length(w) > 2 AND w NOT IN {_STOPPED})) AS n_words FROM documents""")
def content_word_counts(spark, sf_dir):
    return ad.table(spark, sf_dir, "documents").select("doc_id", F.size(tx.content_words(F.col("text"))).cast("long").alias("n_words"))


@query("""WITH c AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ') AS t FROM documents)
  SELECT doc_id, CASE WHEN length(t) <= 220 THEN t ELSE regexp_replace(substring(t, 1, 220), ' [^ ]*$', '') || '...' END AS quote FROM c""")
def quotes(spark, sf_dir):
    return ad.table(spark, sf_dir, "documents").select("doc_id", tx.clean_quote(F.col("text")).alias("quote"))


#: Spark's \\b sees letters and digits of all scripts, DuckDB's only ASCII ones: there the neighbours are spelled out.
_EDGE = r"[^\p{L}\p{Nd}\p{Mn}_]"


def _trigger_sql() -> str:
    def hit(aspect: str) -> str:
        term = lambda t: re.escape(t.rstrip("*")).replace(r"\ ", " ") + (r"\w*" if t.endswith("*") else f"(?:{_EDGE}|$)")
        found = lambda t: f"regexp_extract(clause, '(?i)(?:^|{_EDGE})({t})', 1)"
        # the end of a term is no part of it: the longest term that starts first is extracted, then cut from its neighbour
        whole = found("|".join(term(t) for t in sorted(_L.terms[aspect], key=len, reverse=True)))
        return f"regexp_replace({whole}, '{_EDGE}$', '')"

    return "hits AS (SELECT doc_id, idx, clause_idx, clause, unnest([" + ", ".join(f"struct_pack(aspect := '{a}', trigger := {hit(a)})" for a in _L.terms) + "], recursive := true) FROM clauses)"


@query(f"""WITH {ad.SENTENCES}, {_CLAUSES}, {_trigger_sql()} SELECT doc_id AS document_id, idx, clause_idx, aspect, trigger FROM hits WHERE trigger <> ''""")
def trigger_hits(spark, sf_dir):
    got = aspects.mentions(ad.corpus_chunks(spark, sf_dir), _L)
    return got.select("document_id", "idx", F.col("clause_idx").cast("long").alias("clause_idx"), "aspect", "trigger")


@query(f"""WITH {ad.SENTENCES}, {_TOKENS}, n AS (SELECT doc_id, idx, CAST(count_if((w IN {_in(_L.positive)} AND NOT m) OR (w NOT IN {_in(_L.positive)} AND w IN {_in(_L.negative)} AND m)) AS DOUBLE) AS p,
    CAST(count_if((w IN {_in(_L.positive)} AND m) OR (w NOT IN {_in(_L.positive)} AND w IN {_in(_L.negative)} AND NOT m)) AS DOUBLE) AS n FROM masked GROUP BY ALL),
  scored AS (SELECT doc_id, idx, (p - n) / greatest(1.0::DOUBLE, p + n) * least(1.0::DOUBLE, (p + n) / 2 + 0.2::DOUBLE) AS score FROM n)
  SELECT s.doc_id AS document_id, s.idx, {r('coalesce(score, 0)', 6)} AS score, CASE WHEN coalesce(score, 0) > 0.05 THEN 'positive' WHEN coalesce(score, 0) < -0.05 THEN 'negative' ELSE 'neutral' END AS label
  FROM sents s LEFT JOIN scored USING (doc_id, idx)""")
def lm_score(spark, sf_dir):
    p = polarity.graded(polarity.counted_score(F.col("text"), None, _L), 0.05)
    return ad.corpus_chunks(spark, sf_dir).withColumn("p", p).select("document_id", "idx", half_up(F.col("p.score"), 6).alias("score"), F.col("p.label").alias("label"))


_CLAUSE_TOKENS, _TRIGGER_TOKENS = ad.TOKEN_SQL.replace("(s,", "(clause,"), ad.TOKEN_SQL.replace("(s,", "(trigger,")
_MENTIONS = f"""own AS (SELECT *, list_transform({_CLAUSE_TOKENS}, lambda t: lower(t)) AS toks, list_transform({_TRIGGER_TOKENS}, lambda t: lower(t)) AS own,
    list_filter({_CLAUSE_TOKENS}, lambda t: regexp_full_match(t, '[A-Za-z]+') OR contains(t, '''')) AS plain FROM hits WHERE trigger <> ''),
  placed AS (SELECT *, list_filter(range(1, len(toks) + 1), lambda i: list_contains(own, toks[i])) AS hit FROM own),
  near AS (SELECT *, CASE WHEN len(hit) = 0 THEN CAST([] AS VARCHAR[]) ELSE list_filter(list_slice(toks, greatest(list_min(hit) - 6, 1), list_max(hit) + 6), lambda t: regexp_full_match(t, '[a-z]+') AND NOT list_contains(own, t)) END AS words FROM placed),
  mentioned AS (SELECT *, len(list_filter(words, lambda t: t IN {_in(_L.cues)} OR ends_with(t, 'n''t'))) > 0 AS negated,
    least(1.0::DOUBLE, len(list_filter(plain, lambda t: lower(t) IN {_in(_L.hedges)})) / greatest(3.0::DOUBLE, len(plain) * 0.25::DOUBLE)) AS hedge FROM near)"""


def _word(pattern: str, of: str = "clause") -> str:
    return f"regexp_matches({of}, '(?i)(?:^|{_EDGE})(?:{pattern})(?:{_EDGE}|$)')"


#: Each clause's words once, then every aspect that it mentions.
_BAD_UP = f"({_word(_L.bad_when_up)} AND NOT {_word(_L.good_when_up, "split_part(clause, ' and ', 1)")})"
_DIRECTIONS = f"""spoken AS (SELECT DISTINCT doc_id, idx, clause_idx, clause FROM hits WHERE trigger <> ''),
  ct AS (SELECT doc_id, idx, clause_idx, unnest({_CLAUSE_TOKENS}) AS t, generate_subscripts({_CLAUSE_TOKENS}, 1) AS i FROM spoken),
  ck AS (SELECT *, lower(t) AS w, CASE WHEN lower(t) IN {_in(_L.cues)} OR lower(t) LIKE '%n''t' THEN 1 WHEN lower(t) IN {_in(_L.breaks)} THEN 2 ELSE 0 END AS kind FROM ct),
  cr AS (SELECT *, max(CASE WHEN kind = 1 THEN i END) OVER w AS cue, coalesce(max(CASE WHEN kind = 2 THEN i END) OVER w, 0) AS stop FROM ck WINDOW w AS (PARTITION BY doc_id, idx, clause_idx ORDER BY i)),
  cm AS (SELECT *, CASE WHEN kind = 0 AND coalesce(cue > stop AND i - cue <= 4, false) THEN -1 ELSE 1 END AS sign FROM cr),
  sums AS (SELECT doc_id, idx, clause_idx, count_if(w IN {_in(_L.up)} OR w IN {_in(_L.down)}) > 0 AS moved,
    sum(CASE WHEN w IN {_in(_L.up)} THEN sign WHEN w IN {_in(_L.down)} THEN -sign ELSE 0 END) AS turns,
    sum(CASE WHEN w IN {_in(_L.up)} OR w IN {_in(_L.down)} THEN 0 WHEN w IN {_in(_L.positive)} THEN 8 * sign WHEN w IN {_in(_L.negative)} THEN -8 * sign ELSE 0 END) AS words,
    sum(CASE WHEN w IN {_in(_L.up)} OR w IN {_in(_L.down)} OR w IN {_in(_L.positive)} OR w IN {_in(_L.negative)} THEN 0 WHEN w IN {_in(_L.uncertainty)} THEN -6 * sign ELSE 0 END) AS doubt FROM cm GROUP BY ALL),
  read AS (SELECT h.doc_id, h.idx, h.clause_idx, h.clause, h.aspect, h.trigger, coalesce(moved, false) AS moved,
    (coalesce(words, 0) + CASE WHEN aspect = 'management_tone' THEN coalesce(doubt, 0) ELSE 0 END + 10 * coalesce(turns, 0) * CASE WHEN {_BAD_UP} OR (aspect = 'litigation' AND {_word('(?:legal|litigation) (?:expense|cost)s?')}) THEN -1 ELSE 1 END
    + CASE WHEN {_word(POSITIVE_EVENTS)} THEN 10 ELSE 0 END - CASE WHEN {_word(NEGATIVE_EVENTS)} THEN 10 ELSE 0 END) / 10.0::DOUBLE AS total
    FROM hits h LEFT JOIN sums USING (doc_id, idx, clause_idx) WHERE trigger <> ''),
  sure AS (SELECT *, greatest(-1.0::DOUBLE, least(1.0::DOUBLE, CASE WHEN aspect = 'litigation' AND NOT moved AND abs(total) < 0.5 THEN 0 ELSE total END / 2)) AS sc FROM read),
  labelled AS (SELECT *, CASE WHEN sc > 0.12 THEN 'positive' WHEN sc < -0.12 THEN 'negative' ELSE 'neutral' END AS lb, CASE WHEN abs(sc) > 0.12 THEN least(1.0::DOUBLE, 0.34::DOUBLE + abs(sc) * 0.66::DOUBLE) ELSE greatest(0.34::DOUBLE, 1 - abs(sc) * 6) END AS cf FROM sure),
  per AS (SELECT doc_id, idx, aspect, avg(sc) AS mean, avg(cf) AS sure FROM labelled GROUP BY ALL),
  best AS (SELECT l.*, m.words, m.negated, m.hedge FROM labelled l JOIN mentioned m USING (doc_id, idx, clause_idx, aspect) QUALIFY row_number() OVER (PARTITION BY l.doc_id, l.idx, l.aspect ORDER BY round(abs(l.sc), 9) DESC, l.clause_idx) = 1),
  scored AS (SELECT doc_id, idx, aspect, CASE WHEN round(mean, 9) > 0.15 THEN 'positive' WHEN round(mean, 9) < -0.15 THEN 'negative' WHEN abs(sc) > 0.05 THEN lb ELSE 'neutral' END AS label, {r('mean')} AS score, {r('sure')} AS confidence, trigger, clause, array_to_string(words, ' ') AS opinion_words, negated, hedge
    FROM per JOIN best USING (doc_id, idx, aspect))"""


@query(f"WITH {ad.SENTENCES}, {_CLAUSES}, {_trigger_sql()}, {_MENTIONS}, {_DIRECTIONS} SELECT doc_id AS document_id, idx, aspect, label, score, confidence, trigger, clause, opinion_words, negated, hedge, 'lm_directional' AS model_name FROM scored")
def directional_scores(spark, sf_dir):
    chunks = ad.corpus_chunks(spark, sf_dir)
    got = aspects.score_chunks(chunks, "lm_directional", _L, keys=("document_id", "idx"))
    return got.withColumn("opinion_words", F.array_join("opinion_words", " "))


_TOP_EVIDENCE = f"""evidence AS (SELECT s.doc_id * 1000000 + s.idx AS chunk_id, d.source AS ticker, s.aspect, s.score, s.confidence, t.s AS text, abs(s.score) * (0.5::DOUBLE + s.confidence) AS strength,
    CASE WHEN s.score > 0.15 THEN 'bull' WHEN s.score < -0.15 THEN 'bear' END AS side FROM scored s JOIN sents t USING (doc_id, idx) JOIN documents d USING (doc_id)),
  top AS (SELECT * FROM evidence WHERE side IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ticker, aspect, side ORDER BY strength DESC, chunk_id) <= 4)"""
#: The strongest first; one whose aspect or sentence has been used is passed over.
_GREEDY = f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY ticker, side ORDER BY strength DESC, chunk_id, aspect) AS k FROM top),
  walk AS (SELECT ticker, side, k, chunk_id, aspect, true AS taken, [aspect] AS aspects, [chunk_id] AS chunks FROM ranked WHERE k = 1 UNION ALL
    SELECT r.ticker, r.side, r.k, r.chunk_id, r.aspect, NOT (list_contains(w.aspects, r.aspect) OR list_contains(w.chunks, r.chunk_id)),
      CASE WHEN list_contains(w.aspects, r.aspect) OR list_contains(w.chunks, r.chunk_id) THEN w.aspects ELSE list_append(w.aspects, r.aspect) END,
      CASE WHEN list_contains(w.aspects, r.aspect) OR list_contains(w.chunks, r.chunk_id) THEN w.chunks ELSE list_append(w.chunks, r.chunk_id) END
    FROM walk w JOIN ranked r ON r.ticker = w.ticker AND r.side = w.side AND r.k = w.k + 1),
  picks AS (SELECT r.*, row_number() OVER (PARTITION BY r.ticker, r.side ORDER BY abs(r.score) DESC, r.strength DESC, r.chunk_id, r.aspect) - 1 AS pos FROM walk w JOIN ranked r ON r.ticker = w.ticker AND r.side = w.side AND r.k = w.k WHERE w.taken),
  quoted AS (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ') AS flat FROM picks WHERE pos < 6)"""
_NAMES = " ".join(f"WHEN '{a}' THEN '{a.replace('_', ' ').title()}'" for a in _L.terms)


@query(f"""WITH RECURSIVE {ad.SENTENCES}, {_CLAUSES}, {_trigger_sql()}, {_MENTIONS}, {_DIRECTIONS}, {_TOP_EVIDENCE}, {_GREEDY}
  SELECT ticker, side, CASE side WHEN 'bull' THEN 'bl' ELSE 'br' END || (pos + 1) AS claim_id, aspect, score, CASE aspect {_NAMES} END || ' is ' || CASE side WHEN 'bull' THEN 'supportive' ELSE 'concerning' END || ' (2024-01-01, body): "'
    || CASE WHEN length(flat) <= 220 THEN flat ELSE regexp_replace(substring(flat, 1, 220), ' [^ ]*$', '') || '...' END || '"' AS text, md5(CAST(chunk_id AS VARCHAR)) AS cited, CAST(pos AS INTEGER) AS ord FROM quoted""")
def greedy_claims(spark, sf_dir):
    got = grounding.greedy_claims(_top_evidence(_evidence(spark, sf_dir)))
    return got.withColumn("cited", F.md5(F.get("cited", F.lit(0)).cast("string")))


# --- ingestion -------------------------------------------------------------


@query("SELECT d.doc_id FROM documents d WHERE d.source NOT IN (SELECT source FROM documents WHERE doc_id % 97 = 0) ")
def unscored_documents(spark, sf_dir):
    d = ad.corpus(spark, sf_dir)
    chunks = d.select(F.col("ticker").alias("document_id"), F.col("document_id").alias("doc_id"))
    done = chunks.where(F.col("doc_id") % 97 == 0).select("document_id", F.lit("m").alias("model_name"))
    return aspects.unscored(chunks, done, "m").select("doc_id")


@query("SELECT d.doc_id FROM documents d WHERE d.doc_id % 2 = 0 AND d.doc_id IN (SELECT doc_id FROM labels)")
def embed_pending(spark, sf_dir):
    d = ad.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.when(F.col("doc_id") % 2 == 1, F.array(F.lit(0.0))).alias("embedding"))
    done = ad.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("chunk_id"))
    return aspects.embed_pending(d, done).select(F.col("chunk_id").alias("doc_id"))


_ROLE_SQL = "CASE role WHEN 'system' THEN 'Operator' WHEN 'user' THEN 'Jane (Analyst)' ELSE 'Company' END"


@query(f"""SELECT conv_id, turn FROM (SELECT *, {_ROLE_SQL} AS speaker, CASE WHEN turn > 2 THEN 'qa' ELSE 'prepared' END AS section FROM conversations)
  WHERE NOT contains(lower(speaker), 'operator') AND NOT (contains(lower(speaker), 'analyst') AND section = 'qa')""")
def scoreable_filter(spark, sf_dir):
    c = ad.table(spark, sf_dir, "conversations")
    who = F.when(F.col("role") == "system", "Operator").when(F.col("role") == "user", "Jane (Analyst)").otherwise("Company")
    return aspects.scoreable(c.withColumns({"speaker": who, "section": F.when(F.col("turn") > 2, "qa").otherwise("prepared")})).select("conv_id", "turn")


_QA = rf"""w AS (SELECT *, lower(trim(speaker)) = 'operator' AS op, max(CASE WHEN speaker <> 'Operator' THEN 1 ELSE 0 END) OVER before AS spoke, coalesce(sum(length(text)) OVER before, 0) AS passed,
    greatest(sum(length(text)) OVER (PARTITION BY document_id), 1) AS total, max(i) OVER (PARTITION BY document_id) AS last FROM segments WINDOW before AS (PARTITION BY document_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  hits AS (SELECT document_id, i, CASE WHEN op THEN i WHEN i < last THEN i + 1 END AS start FROM w WHERE spoke = 1 AND passed / total >= 0.12
    AND ((op AND regexp_matches(text, '(?i)(?:{ad.INTRO})')) OR (NOT op AND regexp_matches(right(text, 400), '(?i)(?:{ad.HANDOFF})')))),
  starts AS (SELECT d.document_id, arg_min(h.start, h.i) FILTER (h.i IS NOT NULL) AS x, min(h.i) AS first FROM (SELECT DISTINCT document_id FROM segments) d LEFT JOIN hits h USING (document_id) GROUP BY ALL),
  qa AS (SELECT s.document_id, h.start AS qa_start FROM starts s LEFT JOIN hits h ON h.document_id = s.document_id AND h.i = s.first)"""


@query(f"WITH {ad.SEGMENTS}, {_QA} SELECT * FROM qa")
def qa_start(spark, sf_dir):
    return transcripts.qa_start(ad.segments(spark, sf_dir), ad.INTRO, ad.HANDOFF)


@query(f"""WITH {ad.SEGMENTS}, {_QA}, j AS (SELECT s.*, q.qa_start, s.speaker = 'Operator' AS op, coalesce(s.i >= q.qa_start, false) AS in_qa, coalesce(lag(s.speaker) OVER (PARTITION BY s.document_id ORDER BY s.i) = 'Operator', false) AS after FROM segments s JOIN qa q USING (document_id)),
  f AS (SELECT *, bool_or(NOT op AND (NOT in_qa OR qa_start = 0)) OVER (PARTITION BY document_id, speaker) AS presented, bool_or(in_qa AND op) OVER (PARTITION BY document_id) AS led,
    bool_or(in_qa AND after) OVER (PARTITION BY document_id, speaker) AS introduced, bool_or(in_qa) OVER (PARTITION BY document_id, speaker) AS asked FROM j)
  SELECT document_id, i, CASE WHEN op THEN 'Operator' WHEN NOT coalesce(presented, false) AND CASE WHEN led THEN introduced ELSE asked END THEN 'Analyst' ELSE '' END AS role, CASE WHEN in_qa THEN 'qa' ELSE 'prepared' END AS section FROM f""")
def speaker_roles(spark, sf_dir):
    s = ad.segments(spark, sf_dir)
    return transcripts.speaker_roles(s, transcripts.qa_start(s, ad.INTRO, ad.HANDOFF)).select("document_id", "i", "role", "section")


# --- evaluation ------------------------------------------------------------

_PRED = "CASE WHEN n_chars % 7 = 0 THEN 'neutral' WHEN n_chars % 3 = 0 THEN 'negative' ELSE 'positive' END"
_GOLD = f"gold AS (SELECT d.doc_id, CASE l.quality WHEN 1 THEN 'positive' ELSE 'negative' END AS t, {_PRED} AS p, l.toxic = 1 AS trap, d.lang FROM labels l JOIN documents d USING (doc_id))"


def _gold(spark, sf_dir):
    n = F.col("n_chars")
    pred = F.when(n % 7 == 0, "neutral").when(n % 3 == 0, "negative").otherwise("positive")
    rows = ad.table(spark, sf_dir, "labels").join(ad.table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang"), "doc_id")
    return rows.select("doc_id", F.when(F.col("quality") == 1, "positive").otherwise("negative").alias("t"), pred.alias("p"), (F.col("toxic") == 1).alias("trap"), "lang")


_REPORT = f"""c AS (SELECT l.label, count_if(t = l.label AND p = l.label) AS tp, count_if(t = l.label) AS support, count_if(p = l.label) AS np, count_if(t = p) AS hit, count(*) AS total
    FROM gold CROSS JOIN (SELECT unnest({list(LABELS)}) AS label) l GROUP BY l.label),
  f AS (SELECT *, coalesce(tp / nullif(np, 0), 0) AS pr, coalesce(tp / nullif(support, 0), 0) AS rc, coalesce(2 * tp / nullif(np + support, 0), 0) AS f FROM c),
  report AS (SELECT label, {r('pr')} AS precision, {r('rc')} AS recall, {r('f')} AS f1, support, {r('hit / total')} AS accuracy, {r('sum(f) OVER () / 3')} AS macro_f1 FROM f)"""


@query(f"WITH {_GOLD}, {_REPORT} SELECT * FROM report")
def classification_report(spark, sf_dir):
    return evaluation.classification_report(_gold(spark, sf_dir), "t", "p")


@query(f"WITH {_GOLD}, {_REPORT} SELECT label, metric, value FROM (UNPIVOT (SELECT label, precision, recall, f1, accuracy, macro_f1 FROM report) ON precision, recall, f1, accuracy, macro_f1 INTO NAME metric VALUE value)")
def flat_metrics(spark, sf_dir):
    return evaluation.flat_metrics(classification_report(spark, sf_dir))


@query(f"WITH {_GOLD} SELECT t AS true_label, count_if(p = 'negative') AS pred_negative, count_if(p = 'neutral') AS pred_neutral, count_if(p = 'positive') AS pred_positive FROM gold GROUP BY t")
def confusion_matrix(spark, sf_dir):
    return evaluation.confusion_matrix(_gold(spark, sf_dir), "t", "p")


@query(f"""WITH {_GOLD} SELECT lang AS model, count(*) AS n, {r('avg(CASE WHEN t <> p THEN 1.0::DOUBLE ELSE 0 END)')} AS error_all, {r('avg(CASE WHEN t <> p THEN 1.0::DOUBLE ELSE 0 END) FILTER (trap)')} AS error_trap,
  {r('avg(CASE WHEN t <> p THEN 1.0::DOUBLE ELSE 0 END) FILTER (NOT trap)')} AS error_other FROM gold GROUP BY lang""")
def trap_error_rates(spark, sf_dir):
    return evaluation.trap_errors(_gold(spark, sf_dir).withColumnRenamed("lang", "model"), "t", "p", "trap")


@query(f"""WITH {ad.SCORES}, {_CLAIMS}, h AS (SELECT status = 'supported' AS sup, ord % 5 <> 0 AS ok FROM claims) SELECT count(*) AS n, {r('avg(CASE WHEN ok THEN 1.0::DOUBLE ELSE 0 END) FILTER (sup)')} AS precision,
  {r('avg(CASE WHEN NOT sup THEN 1.0::DOUBLE ELSE 0 END) FILTER (NOT ok)')} AS catch_rate, {r('avg(CASE WHEN sup THEN 1.0::DOUBLE ELSE 0 END)')} AS kept FROM h""")
def human_audit_scores(spark, sf_dir):
    return evaluation.audit_scores(_claims(spark, sf_dir).withColumn("human_ok", F.col("ord") % 5 != 0))


@query(f"""WITH {ad.SCORES}, {_CLAIMS} SELECT aspect AS kind, count(*) AS n, {r("avg(CASE WHEN status <> 'supported' THEN 1.0::DOUBLE ELSE 0 END)")} AS catch_rate, {r("avg(CASE WHEN status = 'rejected' THEN 1.0::DOUBLE ELSE 0 END)")} AS reject_rate FROM claims GROUP BY aspect""")
def catch_rates(spark, sf_dir):
    return grounding.catch_rates(_claims(spark, sf_dir).withColumnRenamed("aspect", "kind"))


_DAY0 = """targets AS (SELECT symbol, call_at, CAST(call_at AS DATE) + CASE WHEN hour(call_at) >= 16 THEN 1 ELSE 0 END AS target FROM calls),
  day0 AS (SELECT t.symbol, t.call_at, p.day AS day0 FROM targets t ASOF LEFT JOIN prices p ON t.symbol = p.symbol AND t.target <= p.day)"""


@query(f"WITH {ad.PRICES}, {ad.CALLS}, {_DAY0} SELECT * FROM day0")
def day0_asof(spark, sf_dir):
    return evaluation.day0(ad.calls(spark, sf_dir), ad.prices(spark, sf_dir).select("symbol", "day"))


_RETURNS = f"""both_ AS (SELECT p.symbol, p.day, p.close, m.close AS market FROM prices p JOIN market m USING (day)),
  wide AS (SELECT symbol, day, lag(close) OVER w AS c_1, lag(market) OVER w AS m_1, lead(close) OVER w AS c1, lead(market) OVER w AS m1, lead(close, 4) OVER w AS c4, lead(market, 4) OVER w AS m4, lead(close, 11) OVER w AS c11, lead(market, 11) OVER w AS m11 FROM both_ WINDOW w AS (PARTITION BY symbol ORDER BY day)),
  returns AS (SELECT d.symbol, d.call_at, d.day0, {r('c1 / c_1 - m1 / m_1', 6)} AS car_0_1, {r('c4 / c_1 - m4 / m_1', 6)} AS car_0_4, {r('c11 / c1 - m11 / m1', 6)} AS drift_2_11
    FROM day0 d JOIN wide w ON w.symbol = d.symbol AND w.day = d.day0 WHERE c_1 IS NOT NULL AND c11 IS NOT NULL)"""


@query(f"WITH {ad.PRICES}, {ad.MARKET}, {ad.CALLS}, {_DAY0}, {_RETURNS} SELECT * FROM returns")
def event_returns(spark, sf_dir):
    return evaluation.event_returns(ad.calls(spark, sf_dir), ad.prices(spark, sf_dir), ad.market(spark, sf_dir))


@query(f"""WITH {ad.PRICES}, {ad.MARKET}, {ad.CALLS}, starts AS (SELECT c.symbol, c.call_at, p.day AS day0 FROM calls c ASOF LEFT JOIN (SELECT symbol, day FROM prices) p ON c.symbol = p.symbol AND CAST(c.call_at AS DATE) <= p.day),
  paths AS (SELECT symbol, day, lead(close, 5) OVER w / close - lead(market, 5) OVER w / market AS gain FROM (SELECT p.symbol, p.day, p.close, m.close AS market FROM prices p JOIN market m USING (day)) WINDOW w AS (PARTITION BY symbol ORDER BY day))
  SELECT s.symbol, s.call_at, s.day0, {r('gain', 6)} AS return_5d FROM starts s JOIN paths p ON p.symbol = s.symbol AND p.day = s.day0 WHERE gain IS NOT NULL""")
def horizon_returns(spark, sf_dir):
    return evaluation.horizon_returns(ad.calls(spark, sf_dir), ad.prices(spark, sf_dir), ad.market(spark, sf_dir))


@query(f"WITH {ad.SCORES} SELECT chunk_id, ticker, document_id, aspect, score, model_name FROM scores WHERE ticker = 'T7' ORDER BY chunk_id DESC LIMIT 50")
def recent_scores(spark, sf_dir):
    columns = ["chunk_id", "ticker", "document_id", "aspect", "score", "model_name"]
    return signals.recent(ad.scores(spark, sf_dir), "chunk_id", 50, "T7").select(*columns)


_EST = "est AS (SELECT 'S' || (l_partkey % 20) AS symbol, CAST(l_shipdate AS DATE) AS day, avg(l_discount - 0.03::DOUBLE) AS eps FROM lineitem GROUP BY 1, 2), est4 AS (SELECT symbol, day, " + r("eps") + " AS eps FROM est)"


@query(f"WITH {_EST}, p AS (SELECT *, lag(eps) OVER (PARTITION BY symbol ORDER BY day) AS prev FROM est4) SELECT symbol, day, eps, {r('(eps - prev) / abs(prev)', 6)} AS revision FROM p WHERE prev IS NOT NULL AND prev <> 0")
def eps_revision_lag(spark, sf_dir):
    li = ad.table(spark, sf_dir, "lineitem")
    est = li.groupBy(F.concat(F.lit("S"), F.col("l_partkey") % 20).alias("symbol"), F.col("l_shipdate").cast("date").alias("day")).agg(tx.exact_mean(F.col("l_discount") - 0.03).alias("eps"))
    return evaluation.revisions(est)


_EVENTS_N = "ev AS (SELECT doc_date, ticker, mean AS x, delta AS y FROM summary WHERE delta IS NOT NULL)"


@query(f"""WITH {ad.SCORES}, {_SUMMARY}, {_EVENTS_N}, k AS (SELECT x, y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS ry FROM ev)
  SELECT 'mean' AS x, 'delta' AS y, count(*) AS n, {r('corr(x, y)')} AS pearson, {r('corr(rx, ry)')} AS spearman FROM k""")
def correlation(spark, sf_dir):
    return evaluation.correlations(aspect_summary(spark, sf_dir), [("mean", "delta")])


@query(f"""WITH k AS (SELECT event_type AS llm, value AS latency, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS m FROM events)
  SELECT llm, count(*) AS n, {r('avg(latency)')} AS mean, {r('median(latency)')} AS median, {r('max(CASE WHEN i = least(m - 1, CAST(floor(m * 0.95::DOUBLE) AS BIGINT)) THEN latency END)')} AS p95, {r('max(latency)')} AS max FROM k GROUP BY llm""")
def latency_percentiles(spark, sf_dir):
    e = ad.table(spark, sf_dir, "events").select(F.col("event_type").alias("llm"), F.col("value").alias("latency"))
    return evaluation.latency_report(e, keys=("llm",))


@query(f"""WITH u AS (SELECT CASE WHEN event_id % 2 = 0 THEN 'large' ELSE 'small' END AS llm, event_id % 1000 AS tokens_in, user_id AS tokens_out FROM events), p AS (SELECT * FROM (VALUES ('large', 3.0::DOUBLE, 15.0::DOUBLE), ('small', 1.0::DOUBLE, 5.0::DOUBLE)) v(llm, price_in, price_out))
  SELECT llm, CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out, {r('sum((tokens_in * price_in + tokens_out * price_out) / 1e6::DOUBLE)', 6)} AS usd FROM u JOIN p USING (llm) GROUP BY llm""")
def cost_by_model(spark, sf_dir):
    e = ad.table(spark, sf_dir, "events")
    use = e.select(F.when(F.col("event_id") % 2 == 0, "large").otherwise("small").alias("llm"), (F.col("event_id") % 1000).alias("tokens_in"), F.col("user_id").alias("tokens_out"))
    return evaluation.token_cost(use, spark.createDataFrame([("large", 3.0, 15.0), ("small", 1.0, 5.0)], "llm string, price_in double, price_out double"))


_TWO = """two AS (SELECT doc_id AS chunk_id, lang AS aspect, CASE WHEN n_chars % 3 = 0 THEN 'negative' ELSE 'positive' END AS pred_a, CASE WHEN n_chars % 5 = 0 THEN 'negative' ELSE 'positive' END AS pred_b, source AS ticker FROM documents)"""


def _two(spark, sf_dir):
    d = ad.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("lang").alias("aspect"), "n_chars", "source")
    one = lambda m, k: F.when(F.col("n_chars") % k == 0, "negative").otherwise("positive").alias("label")
    a = d.select("chunk_id", "aspect", one("a", 3), F.lit("a").alias("model_name"))
    b = d.select("chunk_id", "aspect", one("b", 5), F.lit("b").alias("model_name"))
    return evaluation.disagreements(a.unionByName(b), "a", "b").join(d.select("chunk_id", F.col("source").alias("ticker")), "chunk_id")


@query(f"WITH {_TWO} SELECT chunk_id, aspect, pred_a, pred_b, ticker, pred_a = pred_b AS agree FROM two")
def model_disagreement_selfjoin(spark, sf_dir):
    return _two(spark, sf_dir)


_CANDIDATES = """c AS (SELECT user_id AS chunk_id, event_type AS aspect, (count(*) % 3 = 0) = (sum(event_id) % 5 = 0) AS agree, 'T' || (user_id % 7) AS ticker FROM events GROUP BY user_id, event_type),
  d AS (SELECT *, md5('s/' || chunk_id || '/' || aspect) AS draw FROM c), used0 AS (SELECT chunk_id FROM c WHERE false)"""


def _sample_sql(per: int = 50, share: float = 0.6) -> str:
    """One aspect after the other, as the sequential sampler does."""
    parts = []
    for i, a in enumerate(_ASPECTS, 1):
        wanted = f"least((SELECT count(*) FROM d WHERE aspect = '{a}' AND NOT agree), {round(per * share)})"
        parts.append(f"""t{i} AS (SELECT *, row_number() OVER (PARTITION BY agree, ticker ORDER BY draw, chunk_id) AS turn FROM d WHERE aspect = '{a}' AND chunk_id NOT IN (SELECT chunk_id FROM used{i - 1})),
  p{i} AS (SELECT *, row_number() OVER (PARTITION BY agree ORDER BY turn, ticker) AS place FROM t{i}),
  k{i} AS (SELECT aspect, agree, ticker, chunk_id, place FROM p{i} WHERE place <= CASE WHEN agree THEN {per} - {wanted} ELSE {wanted} END),
  used{i} AS (SELECT chunk_id FROM used{i - 1} UNION ALL SELECT chunk_id FROM k{i})""")
    picks = " UNION ALL ".join(f"SELECT * FROM k{i}" for i in range(1, len(_ASPECTS) + 1))
    return f"""WITH {_CANDIDATES}, {", ".join(parts)}, picks AS ({picks}), n AS (SELECT *, row_number() OVER (ORDER BY md5('s/item/' || chunk_id || '/' || aspect), chunk_id) AS i FROM picks)
  SELECT 'S' || CASE WHEN i < 1000 THEN lpad(CAST(i AS VARCHAR), 3, '0') ELSE CAST(i AS VARCHAR) END AS item_id, CAST((i - 1) // 50 + 1 AS INTEGER) AS batch, aspect, agree, ticker, chunk_id, place FROM n"""


@query(_sample_sql())
def stratified_sample(spark, sf_dir):
    e = ad.table(spark, sf_dir, "events")
    agree = (F.count("*") % 3 == 0) == (F.sum("event_id") % 5 == 0)
    candidates = e.groupBy(F.col("user_id").alias("chunk_id"), F.col("event_type").alias("aspect")).agg(agree.alias("agree"))
    return sampling.stratified_sample(candidates.withColumn("ticker", F.concat(F.lit("T"), F.col("chunk_id") % 7)), _ASPECTS)


# --- sources -----------------------------------------------------------------


@query("""SELECT url, upper(split_part(split_part(regexp_replace(url, '^[a-z]+://', ''), '/', 1), '.', 1)) AS ticker, length(t) AS n, md5(t) AS digest
  FROM (SELECT url, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(?:script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g'), ' ') AS t FROM pages)""")
def plugin_pages(spark, sf_dir):
    """The same pages through the data source registered for them."""
    from tidemark.sources import plugins

    plugins.register(spark)
    pages = spark.read.format("tidemark_pages").option("path", f"{sf_dir}/pages.parquet").load()
    return pages.select(F.col("source_url").alias("url"), "ticker", F.length("text").cast("long").alias("n"), F.md5("text").alias("digest"))


@query("""SELECT page_id, length(t) AS n, md5(t) AS digest FROM (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(?:script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g'), ' ') AS t FROM pages)""")
def html_text(spark, sf_dir):
    from tidemark.sources.readers import strip_tags

    p = ad.table(spark, sf_dir, "pages").withColumn("t", strip_tags(F.col("html")))
    return p.select("page_id", F.length("t").cast("long").alias("n"), F.md5("t").alias("digest"))


@query("""WITH l AS (SELECT p_partkey AS word, unnest([struct_pack(category := 'negative', year := p_size - 20), struct_pack(category := 'positive', year := p_size % 7)], recursive := true) FROM part)
  SELECT category, lower('W' || word) AS word FROM l WHERE year > 0""")
def lexicon_unpivot(spark, sf_dir):
    from tidemark.sources.readers import lexicon_rows

    p = ad.table(spark, sf_dir, "part").select(F.concat(F.lit("W"), "p_partkey").alias("Word"), (F.col("p_size") - 20).cast("string").alias("Negative"), (F.col("p_size") % 7).cast("string").alias("Positive"))
    return lexicon_rows(p, ["Negative", "Positive"])


# --- star schema: joins, set operations, rollups through SQL text ---------------


def _views(spark, sf_dir):
    for name in ("lineitem", "orders", "customer", "nation", "supplier"):
        ad.table(spark, sf_dir, name).createOrReplaceTempView(name)


@query("""SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS DOUBLE) AS sum_qty, floor(sum(l_extendedprice * (1 - l_discount)) + 0.5::DOUBLE) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def pricing_summary(spark, sf_dir):
    li = ad.table(spark, sf_dir, "lineitem").where("l_shipdate <= timestamp_ntz'1998-09-02 00:00:00'")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.floor(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))) + 0.5).cast("double").alias("revenue"), F.count("*").alias("n"))


@query("""SELECT coalesce(n_name, 'ALL') AS nation, coalesce(o_orderpriority, 'all') AS priority, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_name, o_orderpriority)""")
def order_rollup(spark, sf_dir):
    _views(spark, sf_dir)
    got = spark.sql("SELECT n_name, o_orderpriority, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_name, o_orderpriority)")
    return got.select(F.coalesce("n_name", F.lit("ALL")).alias("nation"), F.coalesce("o_orderpriority", F.lit("all")).alias("priority"), "n")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) EXCEPT SELECT s_suppkey FROM supplier")
def customers_without_orders(spark, sf_dir):
    c, o, s = (ad.table(spark, sf_dir, x) for x in ("customer", "orders", "supplier"))
    idle = c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey")
    return idle.exceptAll(idle.join(s, F.col("c_custkey") == F.col("s_suppkey"), "left_semi").select("c_custkey")).distinct()


# --- vectors and models ---------------------------------------------------------


@query("""WITH q AS (SELECT label, embedding AS qv FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) = 1),
  s AS (SELECT q.label AS query_label, e.vec_id, list_sum(list_transform(list_zip(q.qv, e.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) AS sim FROM embeddings e CROSS JOIN q),
  k AS (SELECT *, row_number() OVER (PARTITION BY query_label ORDER BY floor(sim * 1e6 + 0.5::DOUBLE) DESC, vec_id) AS rank FROM s) SELECT query_label, rank, vec_id, floor(sim * 1e4::DOUBLE + 0.5::DOUBLE) / 1e4::DOUBLE AS sim FROM k WHERE rank <= 4""")
def vector_topk(spark, sf_dir):
    e = ad.table(spark, sf_dir, "embeddings")
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("qv")).select(F.col("label").alias("query_label"), "qv")
    # blocks of at most 64 queries or so meet all rows; Spark broadcasts them if they are small
    blocks = max(1, -(-first.count() // 64))
    packed = first.groupBy(F.pmod(F.xxhash64("query_label"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("query_label", "qv")).alias("queries"))
    each = e.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    s = each.join(packed, "block").select("vec_id", "embedding", F.inline("queries")).withColumn("sim", tx.dot(F.col("qv"), F.col("embedding")))
    w = Window.partitionBy("query_label").orderBy(F.floor(F.col("sim") * 1e6 + 0.5).desc(), "vec_id")
    return s.withColumn("rank", F.row_number().over(w)).where("rank <= 4").select("query_label", "rank", "vec_id", half_up(F.col("sim")).alias("sim"))


@query("""WITH w AS (SELECT item_id, list_filter(regexp_extract_all(lower(text), '[a-z0-9%]+'), lambda x: NOT list_contains(['the','a','an','of','and','to','in','on','for','is','are','was','were','we','our','that','this','it','as','at','by','be','with','from','has','have','had'], x)) AS ws FROM benchmark),
  f AS (SELECT item_id, unnest(ws || list_transform(range(1, len(ws)), lambda i: ws[i] || '_' || ws[i + 1])) AS f FROM w),
  s AS (SELECT item_id, CAST(('0x' || substr(md5(f), 1, 8)) AS BIGINT) % 384 AS d, sum(CASE WHEN substr(md5(f), 9, 1) IN ('8','9','a','b','c','d','e','f') THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) AS v FROM f GROUP BY ALL),
  n AS (SELECT *, sqrt(sum(v * v) OVER (PARTITION BY item_id)) AS norm FROM s) SELECT item_id, d, floor(CASE WHEN norm > 0 THEN v / norm ELSE 0 END * 1e6::DOUBLE + 0.5::DOUBLE) / 1e6::DOUBLE AS weight FROM n""")
def hash_embedding(spark, sf_dir):
    b = ad.table(spark, sf_dir, "benchmark")
    return b.select("item_id", F.explode(tx.hashed_embedding(F.col("text"), 384)).alias("d", "weight")).select("item_id", "d", half_up(F.col("weight"), 6).alias("weight"))


_KINDS = ["good", "poor", "toxic"]
_LABELLED = """labelled AS (SELECT d.doc_id, coalesce(text, '') AS text, CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 1 THEN 'good' ELSE 'poor' END AS label,
    ('0x' || substr(md5(CAST(d.doc_id AS VARCHAR)), 1, 8))::BIGINT % 100 < 15 AS held_out FROM documents d JOIN labels l ON l.doc_id = d.doc_id)"""
_BAYES = f"""{_LABELLED}, sents AS (SELECT doc_id, 0 AS idx, text AS s FROM labelled), {_TOKENS},
  grams AS (SELECT doc_id, i, CASE WHEN m AND regexp_full_match(t, '[A-Za-z]+') THEN 'NEG_' || w ELSE w END AS g FROM masked),
  terms AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, g AS term FROM grams UNION ALL SELECT doc_id, g || ' ' || lead(g) OVER (PARTITION BY doc_id ORDER BY i) FROM grams) WHERE term IS NOT NULL GROUP BY ALL),
  seen AS (SELECT t.*, label FROM terms t JOIN labelled USING (doc_id) WHERE NOT held_out), n AS (SELECT count(*) AS n FROM labelled WHERE NOT held_out),
  idf AS (SELECT term, ln((1 + any_value(n.n)) / (1 + count(*))) + 1 AS idf FROM seen, n GROUP BY term),
  wd AS (SELECT doc_id, label, term, (1 + ln(tf)) * idf AS w FROM seen JOIN idf USING (term)), norms AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM wd GROUP BY doc_id),
  per AS (SELECT label, term, sum(w / norm) AS s FROM wd JOIN norms USING (doc_id) GROUP BY ALL), totals AS (SELECT label, sum(s) AS total FROM per GROUP BY label),
  sizes AS (SELECT label, ln(count(*) / any_value(n.n)) AS prior FROM labelled, n WHERE NOT held_out GROUP BY label),
  vocabulary AS (SELECT count(*) AS v FROM idf),
  logs AS (SELECT i.term, i.idf, z.label, ln((coalesce(p.s, 0) + 0.3::DOUBLE) / (t.total + 0.3::DOUBLE * v)) AS lp FROM idf i CROSS JOIN sizes z JOIN totals t ON t.label = z.label CROSS JOIN vocabulary LEFT JOIN per p ON p.term = i.term AND p.label = z.label),
  asked AS (SELECT t.doc_id, t.term, (1 + ln(tf)) AS u FROM terms t JOIN labelled USING (doc_id) WHERE held_out),
  sums AS (SELECT doc_id, g.label, sum(u * idf * lp) / sqrt(sum(u * u * idf * idf)) AS x FROM asked a JOIN logs g USING (term) GROUP BY ALL),
  best AS (SELECT l.doc_id, l.label AS t, z.label AS p FROM labelled l CROSS JOIN sizes z LEFT JOIN sums s ON s.doc_id = l.doc_id AND s.label = z.label WHERE held_out QUALIFY row_number() OVER (PARTITION BY l.doc_id ORDER BY prior + coalesce(x, 0) DESC, z.label) = 1),
  gold AS (SELECT t, p FROM best)"""


def _labelled(spark, sf_dir):
    held_out = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 8), 16, 10).cast("long") % 100 < 15
    label = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").otherwise("poor")
    d = ad.spread(ad.table(spark, sf_dir, "documents").select("doc_id", "text")).join(ad.table(spark, sf_dir, "labels"), "doc_id")
    return d.select("doc_id", "text", label.alias("label"), held_out.alias("held_out"))


@query(f"WITH {_BAYES}, {_REPORT.replace(str(list(LABELS)), str(_KINDS))} SELECT * FROM report")
def nb_tfidf_report(spark, sf_dir):
    """Learns kinds of documents from their labels, and is held against those it hasn't seen."""
    rows = _labelled(spark, sf_dir)
    model = textbayes.fit(rows.where("NOT held_out"), ["doc_id"], lexicon=_L)
    return evaluation.classification_report(model.predict(rows.where("held_out"), ["doc_id"], lexicon=_L), "label", "predicted", labels=tuple(_KINDS))


_DRAW = lambda salt, of: f"('0x' || substr(md5(CAST(doc_id AS VARCHAR) || '/13/{salt}'), 1, 8))::BIGINT % {of}"


@query(f"""WITH d AS (SELECT {_DRAW('subject', 2)} AS bad, {_DRAW('direction', 3)} AS d, {_DRAW('fold', 100)} < 15 AS held_out, list_extract({list(models.SUBJECTS)}, CAST(doc_id % {len(models.SUBJECTS)} + 1 AS INTEGER)) AS aspect FROM labels)
  SELECT aspect, CASE WHEN d = 2 THEN 'neutral' WHEN bad = d THEN 'positive' ELSE 'negative' END AS label, held_out, count(*) AS n FROM d GROUP BY ALL""")
def weak_label_report(spark, sf_dir):
    """A sentence from the templates for each labelled document; counts by aspect, label and part."""
    made = models.weak_labels_of(ad.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")))
    return made.groupBy("aspect", "label", "held_out").agg(F.count("*").alias("n"))


@query(f"""SELECT vec_id, other, {r('CASE WHEN na > 0 AND nb > 0 THEN ab / sqrt(na * nb) ELSE 0 END')} AS cosine FROM (SELECT a.vec_id, b.vec_id AS other,
  list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) AS ab, list_sum(list_transform(a.embedding, lambda z: z::DOUBLE * z::DOUBLE)) AS na,
  list_sum(list_transform(b.embedding, lambda z: z::DOUBLE * z::DOUBLE)) AS nb FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)""")
def cosine_pairs(spark, sf_dir):
    e = ad.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("other"), F.col("embedding").alias("o"))
    return e.join(b, "vec_id").select("vec_id", "other", half_up(tx.cosine(F.col("embedding"), F.col("o"))).alias("cosine"))


# --- texts: replies, evidence lines, mentions ---------------------------------


@query("SELECT event_id, CASE WHEN event_id % 3 < 2 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events")
def json_blocks(spark, sf_dir):
    fence = "`" * 3
    e = ad.table(spark, sf_dir, "events")
    reply = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(f"Here: {fence}json\n"), "props", F.lit(f"\n{fence} done"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("so "), "props", F.lit(" ok"))).otherwise("no object")
    return e.select("event_id", tx.json_block(reply, "k long")["k"].alias("k"))


@query(f"""WITH {ad.SCORES} SELECT chunk_id, '[' || chunk_id || '] (' || aspect || ', ' || CAST(doc_date AS VARCHAR) || ', ' || section || ', ' || format('{{:+.2f}}', {r('score', 2)}) || ') ' || ticker AS line FROM scores""")
def evidence_lines(spark, sf_dir):
    c = F.col
    return ad.scores(spark, sf_dir).select("chunk_id", tx.evidence_line(c("chunk_id"), c("aspect"), c("doc_date"), c("section"), c("score"), c("ticker")).alias("line"))


_QUERY_VECTORS = "qv AS (SELECT aspect, e.embedding AS q FROM (SELECT aspect, row_number() OVER (ORDER BY aspect) - 1 AS i FROM (SELECT DISTINCT aspect FROM scores)) a JOIN embeddings e ON e.vec_id = a.i)"


@query(f"""WITH {ad.SCORES}, {_QUERY_VECTORS} SELECT s.chunk_id, s.ticker, s.aspect, {r('coalesce(list_sum(list_transform(list_zip(q.q, e.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)), 0)')} AS similarity
  FROM scores s LEFT JOIN qv q USING (aspect) LEFT JOIN embeddings e ON e.vec_id = s.chunk_id WHERE s.model_name = 'lm_directional' AND s.doc_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'""")
def retrieved_evidence(spark, sf_dir):
    s, e = ad.scores(spark, sf_dir), ad.table(spark, sf_dir, "embeddings")
    named = s.select("aspect").distinct().withColumn("vec_id", F.row_number().over(Window.orderBy("aspect")) - 1)  # one row an aspect
    vectors = named.join(e, "vec_id").select("aspect", F.col("embedding").alias("query_vector"))
    got = grounding.retrieve(s, e.select(F.col("vec_id").alias("chunk_id"), "embedding"), vectors, "2024-01-05", "2024-01-20", "lm_directional")
    return got.select("chunk_id", "ticker", "aspect", "similarity")


@query(f"WITH {ad.SENTENCES}, {_CLAUSES}, {_trigger_sql()}, {_MENTIONS} SELECT doc_id AS document_id, idx, CAST(clause_idx AS INTEGER) AS clause_idx, aspect, trigger, negated, {r('hedge')} AS hedge, array_to_string(words, ' ') AS opinion_words FROM mentioned")
def mention_rows(spark, sf_dir):
    got = aspects.mentions(ad.corpus_chunks(spark, sf_dir), _L)
    return got.select("document_id", "idx", "clause_idx", "aspect", "trigger", "negated", half_up(F.col("hedge")).alias("hedge"), F.array_join("opinion_words", " ").alias("opinion_words"))


@query(f"""WITH {ad.SENTENCES}, {_CLAUSES}, {_trigger_sql()}, found AS (SELECT DISTINCT doc_id, idx, aspect FROM hits WHERE trigger <> '')
  SELECT doc_id AS document_id, idx, string_agg(aspect, ',' ORDER BY list_position({list(_L.terms)}, aspect)) AS aspects FROM found GROUP BY doc_id, idx""")
def aspects_present(spark, sf_dir):
    got = aspects.present(aspects.mentions(ad.corpus_chunks(spark, sf_dir), _L), list(_L.terms), ("document_id", "idx"))
    return got.withColumn("aspects", F.array_join("aspects", ","))


_PAIRS_SQL = f"""asked AS (SELECT item_id, coalesce(text, '') AS clause, list_extract({[*_L.terms, "weather"]}, CAST(item_id % {len(_L.terms) + 1} + 1 AS INTEGER)) AS aspect FROM benchmark),
  hits AS (SELECT item_id AS doc_id, 0 AS idx, 0 AS clause_idx, clause, aspect, aspect AS trigger FROM asked WHERE aspect IN {_in(list(_L.terms))}), {_DIRECTIONS.split("  per AS (")[0].rstrip().rstrip(",")}"""


@query(f"WITH {_PAIRS_SQL} SELECT a.item_id, a.aspect, l.lb IS NOT NULL AS known, l.lb AS label, {r('l.sc')} AS score, {r('l.cf')} AS confidence FROM asked a LEFT JOIN labelled l ON l.doc_id = a.item_id")
def pair_scores(spark, sf_dir):
    named = F.element_at(F.array(*map(F.lit, [*_L.terms, "weather"])), (F.pmod("item_id", F.lit(len(_L.terms) + 1)) + 1).cast("int"))
    return aspects.score_pairs(ad.table(spark, sf_dir, "benchmark").select("item_id", "text", named.alias("aspect")), "lm_directional", _L).drop("text")


_SENSES = [("the", 1, 0.5), ("the", 2, 0.25), ("the", 3, 0.0), ("the", 4, 9.0), ("of", 1, -0.5), ("with", 1, 0.25), ("with", 2, -0.5), ("de", 1, 0.75), ("der", 1, -0.25)]


@query(f"""WITH {ad.SENTENCES}, {_TOKENS}, senses(word, rank, value) AS (VALUES {', '.join(f"('{a}', {b}, {c}::DOUBLE)" for a, b, c in _SENSES)}),
  first AS (SELECT *, CASE rank WHEN 1 THEN 1.0::DOUBLE WHEN 2 THEN 0.5::DOUBLE ELSE 0.33::DOUBLE END AS wt FROM senses WHERE rank <= 3), vals AS (SELECT word, sum(value * wt) / sum(wt) AS v FROM first GROUP BY word),
  per AS (SELECT doc_id, idx, count(*) AS n, coalesce(sum(CASE WHEN m THEN -v ELSE v END), 0) AS s FROM masked LEFT JOIN vals ON vals.word = w AND regexp_full_match(w, '[a-z][a-z][a-z]+') GROUP BY ALL)
  SELECT t.doc_id AS document_id, t.idx, {r('greatest(-1.0::DOUBLE, least(1.0::DOUBLE, 4 * coalesce(p.s, 0) / coalesce(p.n, 1)))', 6)} AS score FROM sents t LEFT JOIN per p USING (doc_id, idx)""")
def sense_scores(spark, sf_dir):
    senses = spark.createDataFrame(_SENSES, "word string, rank int, value double")
    return polarity.sense_score(ad.corpus_chunks(spark, sf_dir), senses, ("document_id", "idx"), _L).withColumn("score", half_up(F.col("score"), 6))


def _normal(source: str) -> str:
    """CTEs that end in normed (doc_id, text)."""
    return rf"""plain AS (SELECT doc_id, replace(translate(text, '‘’“”–' || chr(160), chr(39) || chr(39) || '""- '), '—', '--') AS t FROM {source}),
  cut AS (SELECT doc_id, regexp_replace(t, '(?i)\[[^\]]{{0,80}}\]|\((?:laughter|inaudible|crosstalk)\)', ' ', 'g') AS t FROM plain),
  lines AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '[ \t]+', ' ', 'g'), '\r\n?', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g') AS t FROM cut),
  normed AS (SELECT doc_id, regexp_replace(t, '^[ \t\n\v\f\r]+|[ \t\n\v\f\r]+$', '', 'g') AS text FROM lines)"""


@query(f"WITH {_normal('documents')} SELECT doc_id, CAST(length(text) AS INTEGER) AS n, md5(text) AS digest FROM normed")
def normalized_documents(spark, sf_dir):
    d = ad.table(spark, sf_dir, "documents").select("doc_id", tx.normalize(F.col("text")).alias("t"))
    return d.select("doc_id", F.length("t").alias("n"), F.md5("t").alias("digest"))


_SEGMENT_SENTENCES = f"""roles AS ({SQL['speaker_roles']}), {ad.SEGMENTS}, said AS (SELECT struct_pack(d := document_id, i := i) AS doc_id, text FROM segments),
  {_normal('said')}, {ad.SENTENCES.replace('FROM documents', 'FROM normed')}"""


@query(f"WITH {_SEGMENT_SENTENCES} SELECT r.document_id, r.i, r.role, r.section, CAST(s.idx AS INTEGER) AS pos, md5(s.s) AS text FROM sents s JOIN roles r ON r.document_id = s.doc_id.d AND r.i = s.doc_id.i")
def segment_sentences(spark, sf_dir):
    s = ad.segments(spark, sf_dir)
    roles = transcripts.speaker_roles(s, transcripts.qa_start(s, ad.INTRO, ad.HANDOFF))
    return roles.select("document_id", "i", "role", "section", F.posexplode(tx.sentences(tx.normalize(F.col("text")))).alias("pos", "text")).withColumn("text", F.md5("text"))


@query("""WITH raw AS (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(?:script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g'), ' ') AS t FROM pages),
  heads AS (SELECT page_id, t, strpos(reverse(lower(t)), 'eht') AS back FROM raw), rests AS (SELECT page_id, t, back, substr(t, length(t) - back - 1) AS rest FROM heads),
  stops AS (SELECT *, strpos(lower(substr(rest, 201)), 'and') AS stop FROM rests),
  found AS (SELECT page_id, substr(CASE WHEN back = 0 THEN t WHEN stop > 0 THEN substr(rest, 1, stop + 199) ELSE rest END, 1, 200000) AS t FROM stops) SELECT page_id, CAST(length(t) AS INTEGER) AS n, md5(t) AS digest FROM found""")
def section_extract(spark, sf_dir):
    from tidemark.sources.readers import mdna_section, strip_tags

    p = ad.table(spark, sf_dir, "pages").withColumn("t", mdna_section(strip_tags(F.col("html")), "the", "and"))
    return p.select("page_id", F.length("t").alias("n"), F.md5("t").alias("digest"))


@query()
def audit_sheet(spark, sf_dir):
    top = _top_evidence(_evidence(spark, sf_dir))
    one = Window.partitionBy("chunk_id").orderBy(F.desc("strength"), "aspect")
    sources = top.withColumn("rn", F.row_number().over(one)).where("rn = 1")
    return grounding.audit_export(grounding.verify(grounding.greedy_claims(top), sources), sources)


_SPOKEN = transcripts.SPEAKER_LINE.replace("'", "''")
_LINE_MACHINE = rf"""{ad.LINE_TEXTS}, {_normal('conv')},
  raws AS (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM normed),
  tagged AS (SELECT *, regexp_matches(line, '(?i)(?:{ad.LINE_MARKERS})') AND length(line) < {transcripts.MARKER_LINE} AS marker, trim(regexp_extract(line, '{_SPOKEN}', 1)) AS name, trim(regexp_extract(line, '{_SPOKEN}', 2)) AS role, trim(regexp_extract(line, '{_SPOKEN}', 3)) AS said FROM raws WHERE line <> ''),
  named AS (SELECT *, name <> '' AND NOT regexp_matches(lower(line), '^(http|note)') AS named FROM tagged),
  told AS (SELECT *, CASE WHEN named THEN said ELSE line END AS rest, CASE WHEN named THEN CASE WHEN role <> '' THEN name || ' (' || role || ')' ELSE name END END AS who FROM named),
  walked AS (SELECT *, max(CASE WHEN marker OR coalesce(named AND starts_with(lower(who), 'operator') AND regexp_matches(rest, '(?i)(?:{ad.LINE_MARKERS})'), false) THEN 1 ELSE 0 END) OVER w AS qa,
    sum(CASE WHEN marker OR named THEN 1 ELSE 0 END) OVER w AS block, coalesce(last_value(who IGNORE NULLS) OVER w, '') AS speaker FROM told WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
  bodies AS (SELECT struct_pack(d := doc_id, b := block) AS doc_id, string_agg(rest, ' ' ORDER BY i) AS text, max(qa) AS qa, arg_max(speaker, i) AS speaker FROM walked WHERE rest <> '' GROUP BY doc_id, block),
  {ad.SENTENCES.replace('FROM documents', 'FROM bodies')}"""


@query(f"""WITH {_LINE_MACHINE} SELECT s.doc_id.d AS document_id, CAST(row_number() OVER (PARTITION BY s.doc_id.d ORDER BY s.doc_id.b, s.idx) - 1 AS INTEGER) AS idx, CASE WHEN qa = 1 THEN 'qa' ELSE 'prepared' END AS section, speaker, md5(s.s) AS digest
  FROM sents s JOIN bodies b ON b.doc_id = s.doc_id""")
def line_transcript_sentences(spark, sf_dir):
    got = transcripts.line_chunks(ad.line_transcripts(spark, sf_dir), ad.LINE_MARKERS)
    return got.select("document_id", "idx", "section", "speaker", F.md5("text").alias("digest"))


# --- studies -----------------------------------------------------------------------


_PAIRS = [("car_0_1", "drift_2_11"), ("car_0_4", "drift_2_11")]


def _pair_sql(x: str, y: str) -> str:
    rank = lambda c: f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2"
    return f"SELECT '{x}' AS x, '{y}' AS y, count(*) AS n, {r('corr(a, b)')} AS pearson, {r('corr(ra, rb)')} AS spearman FROM (SELECT {x} AS a, {y} AS b, {rank(x)} AS ra, {rank(y)} AS rb FROM returns)"


@query(f"WITH {ad.PRICES}, {ad.MARKET}, {ad.CALLS}, {_DAY0}, {_RETURNS} " + " UNION ALL ".join(_pair_sql(*p) for p in _PAIRS))
def return_correlations(spark, sf_dir):
    return evaluation.correlations(event_returns(spark, sf_dir), _PAIRS)


@query(f"""WITH {ad.SCORES}, {_SUMMARY}, d AS (SELECT ticker, mean - avg(mean) OVER w AS x, delta - avg(delta) OVER w AS y FROM summary WHERE delta IS NOT NULL WINDOW w AS (PARTITION BY ticker)),
  b AS (SELECT sum(x * y) / sum(x * x) AS beta, sum(x * x) AS xx, count(*) AS n, count(DISTINCT ticker) AS g, sum(y * y) AS tss FROM d),
  e AS (SELECT sum(x * x * (y - beta * x) * (y - beta * x)) AS meat, sum((y - beta * x) * (y - beta * x)) AS rss FROM d, b)
  SELECT 'mean' AS x, n, {r('beta')} AS coef, {r('sqrt(meat / xx / xx * n / (n - 1 - g))')} AS error, {r('1 - rss / tss')} AS r2_within FROM b, e""")
def fixed_effects(spark, sf_dir):
    fit = evaluation.ols_fixed_effects(aspect_summary(spark, sf_dir).where("delta IS NOT NULL"), "delta", ["mean"], "ticker")
    rows = spark.createDataFrame([("mean", fit["n"], fit["coef"]["mean"], fit["error"]["mean"], fit["r2_within"])], "x string, n long, coef double, error double, r2_within double")
    return rows.select("x", "n", *[half_up(F.col(c)).alias(c) for c in ("coef", "error", "r2_within")])


_CELLS = ["model", "horizon", "predictor"]
_STUDY = f"""{ad.SCORES}, per AS (SELECT model_name AS model, ticker, doc_date AS date, aspect, {_MEANS} FROM scores GROUP BY ALL),
  rounded AS (SELECT model, ticker, date, {r('m')} AS mean, {r('q - p')} AS delta FROM per), ev AS (SELECT model, ticker, date, {rm('delta')} AS delta, {rm('mean')} AS doc_level FROM rounded GROUP BY ALL),
  daily AS (SELECT ticker, doc_date AS date, {r('avg(score)', 6)} AS v FROM scores GROUP BY ALL),
  rets AS (SELECT ticker, date, lead(v, 1) OVER w - v AS next_1, lead(v, 4) OVER w - v AS next_4 FROM daily WINDOW w AS (PARTITION BY ticker ORDER BY date)),
  wide AS (SELECT model, ticker, delta, doc_level, horizon, ret FROM (SELECT * FROM ev JOIN rets USING (ticker, date)) UNPIVOT (ret FOR horizon IN (next_1, next_4))),
  cells AS (SELECT model, horizon, 'delta' AS predictor, delta AS a, ret AS b FROM wide WHERE delta IS NOT NULL UNION ALL SELECT model, horizon, 'doc_level', doc_level, ret FROM wide WHERE doc_level IS NOT NULL),
  ranked AS (SELECT *, rank() OVER (PARTITION BY model, horizon, predictor ORDER BY a) + (count(*) OVER (PARTITION BY model, horizon, predictor, a) - 1) / 2 AS ra,
    rank() OVER (PARTITION BY model, horizon, predictor ORDER BY b) + (count(*) OVER (PARTITION BY model, horizon, predictor, b) - 1) / 2 AS rb FROM cells),
  corrs AS (SELECT model, horizon, predictor, count(*) AS n, {r('corr(a, b)')} AS pearson, {r('corr(ra, rb)')} AS spearman FROM ranked GROUP BY ALL),
  dm AS (SELECT model, horizon, ticker, delta - avg(delta) OVER w AS x, doc_level - avg(doc_level) OVER w AS z, ret - avg(ret) OVER w AS y FROM wide WHERE delta IS NOT NULL AND doc_level IS NOT NULL WINDOW w AS (PARTITION BY model, horizon, ticker)),
  s AS (SELECT model, horizon, count(*) AS n, count(DISTINCT ticker) AS g, sum(x * x) AS xx, sum(x * z) AS xz, sum(z * z) AS zz, sum(x * y) AS xy, sum(z * y) AS zy FROM dm GROUP BY ALL),
  b AS (SELECT *, xx * zz - xz * xz AS det, (zz * xy - xz * zy) / (xx * zz - xz * xz) AS bx, (xx * zy - xz * xy) / (xx * zz - xz * xz) AS bz FROM s),
  e AS (SELECT model, horizon, x, z, y - bx * x - bz * z AS u FROM dm JOIN b USING (model, horizon)), q AS (SELECT model, horizon, sum(x * x * u * u) AS mxx, sum(x * z * u * u) AS mxz, sum(z * z * u * u) AS mzz FROM e GROUP BY ALL),
  fits AS (SELECT model, horizon, n AS n_ols, unnest(['delta', 'doc_level']) AS predictor, unnest([bx, bz]) AS coef,
    unnest([sqrt((zz * zz * mxx - 2 * zz * xz * mxz + xz * xz * mzz) / det / det * n / (n - 2 - g)), sqrt((xx * xx * mzz - 2 * xx * xz * mxz + xz * xz * mxx) / det / det * n / (n - 2 - g))]) AS error FROM b JOIN q USING (model, horizon))
  SELECT model, horizon, predictor, n, pearson, spearman, n_ols, {r('coef')} AS coef, {r('error')} AS error, CAST((SELECT count(DISTINCT model) FROM ev JOIN rets USING (ticker, date)) * 2 AS INTEGER) AS n_tests FROM corrs LEFT JOIN fits USING (model, horizon, predictor)"""


def _study(spark, sf_dir):
    s = ad.scores(spark, sf_dir)
    w = Window.partitionBy("ticker").orderBy("date")
    daily = s.groupBy("ticker", F.col("doc_date").alias("date")).agg(half_up(F.avg("score"), 6).alias("v"))
    returns = daily.select("ticker", "date", *[(F.lead("v", k).over(w) - F.col("v")).alias(f"next_{k}") for k in (1, 4)])
    return evaluation.study(service.study_events(s), returns, ["next_1", "next_4"], ["delta", "doc_level"])


@query("WITH " + _STUDY)
def study(spark, sf_dir):
    rounded = [half_up(F.col(c)).alias(c) for c in ("pearson", "spearman", "coef", "error")]
    return _study(spark, sf_dir).select(*_CELLS, "n", *rounded[:2], "n_ols", *rounded[2:], "n_tests")


@query()
def study_pvalues(spark, sf_dir):
    """Without SQL, which has no normal or t distribution."""
    return _study(spark, sf_dir).select(*_CELLS, *[half_up(F.col(c)).alias(c) for c in ("spearman_p", "p", "p_bonferroni")])


@query()
def bootstrap_interval(spark, sf_dir):
    return evaluation.bootstrap_ci(event_returns(spark, sf_dir), "car_0_1", "drift_2_11")


# --- service -------------------------------------------------------------------------

_DIGESTS = f"""win AS (SELECT ticker, max(doc_date) - 14 AS window_start, max(doc_date) AS window_end FROM scores GROUP BY ticker),
  lines AS (SELECT w.*, md5({_LINE}) AS h FROM win w JOIN scores s ON s.ticker = w.ticker AND s.doc_date BETWEEN w.window_start AND w.window_end),
  sums AS (SELECT ticker, window_start, window_end, count(*) AS n, sum(('0x' || substr(h, 1, 15))::BIGINT) AS a, sum(('0x' || substr(h, 16, 15))::BIGINT) AS b FROM lines GROUP BY ALL)"""


@query(f"""WITH {ad.SCORES}, {_DIGESTS} SELECT ticker, window_start, window_end, sha256(concat_ws('|', ticker, window_start, window_end, 'rules', n, a, b)) AS fingerprint, n FROM sums""")
def brief_keys(spark, sf_dir):
    s = ad.scores(spark, sf_dir)
    return service.brief_keys(s, signals.default_window(s, 14))


@query(f"""WITH {ad.SCORES.replace('FROM events)', 'FROM events WHERE day(CAST(ts AS DATE)) % 3 <> 0)')}, {_SUMMARY}
  SELECT ticker, ticker || '/' || doc_date AS document_id, doc_date, {rm('delta')} AS delta, {rm('mean')} AS doc_level, {rm('prepared')} AS prepared FROM summary GROUP BY ticker, doc_date""")
def score_events(spark, sf_dir):
    return service.events(ad.scores(spark, sf_dir))


@query(f"WITH {_GOLD} SELECT doc_id, t, p, trap FROM gold WHERE t <> p")
def failing_rows(spark, sf_dir):
    return service.failing_rows(_gold(spark, sf_dir), "t", "p").select("doc_id", "t", "p", "trap")


@query(f"WITH {_GOLD} SELECT lang AS model, count_if(trap) AS trap_n, {r('avg(CASE WHEN t = p THEN 1.0::DOUBLE ELSE 0 END) FILTER (trap)')} AS trap_accuracy FROM gold GROUP BY lang")
def trap_accuracy(spark, sf_dir):
    return service.trap_accuracy(_gold(spark, sf_dir).withColumnRenamed("lang", "model"), "t", "p", "trap", 1.0).drop("ms_per_item")


@query(f"""WITH {ad.SCORES}, {_CLAIMS} SELECT count(*) AS corrupted, {r("avg(CASE WHEN status <> 'supported' THEN 1.0::DOUBLE ELSE 0 END)")} AS caught FROM claims WHERE aspect <> 'view'""")
def overall_catch_rate(spark, sf_dir):
    kind = F.when(F.col("aspect") == "view", "faithful").otherwise(F.col("aspect"))
    return service.overall_catch_rate(_claims(spark, sf_dir).withColumn("kind", kind))


@query(f"WITH {ad.SCORES}, {_CLAIMS}, g AS (SELECT ticker, side, list_sort(cited) AS ids, count(*) AS n FROM claims GROUP BY ALL) SELECT ticker, CAST(sum(n - 1) AS BIGINT) AS merged FROM g GROUP BY ticker")
def merged_claims(spark, sf_dir):
    return service.merged_claims(_claims(spark, sf_dir))


@query("""WITH l AS (SELECT doc_id AS item_id, CASE n_chars % 4 WHEN 0 THEN 'not about aspect' WHEN 1 THEN 'negative' WHEN 2 THEN 'neutral' ELSE 'positive' END AS label FROM documents)
  SELECT count(*) AS labelled, count_if(label <> 'not about aspect') AS kept, count_if(label = 'not about aspect') AS not_about_aspect,
    floor(avg(CASE WHEN label <> 'not about aspect' THEN 1.0::DOUBLE ELSE 0 END) * 1000 + 0.5::DOUBLE) / 1000 AS aspect_precision FROM l""")
def aspect_precision(spark, sf_dir):
    d = ad.table(spark, sf_dir, "documents")
    named = F.element_at(tx.strings(["not about aspect", "negative", "neutral", "positive"]), (F.col("n_chars") % 4 + 1).cast("int"))
    rows = d.select(F.col("doc_id").alias("item_id"), named.alias("label"))
    return service.kept_labels(rows, d.select(F.col("doc_id").alias("item_id"), "source"))[1]


@query(f"WITH {_TWO}, gold AS (SELECT m AS model, pred_a AS t, CASE m WHEN 'pred_a' THEN pred_a ELSE pred_b END AS p FROM two CROSS JOIN (SELECT unnest(['pred_a', 'pred_b']) AS m) x), " + _REPORT.replace("GROUP BY l.label", "GROUP BY model, l.label").replace("SELECT l.label,", "SELECT model, l.label,").replace("SELECT label,", "SELECT model, label,").replace("OVER ()", "OVER (PARTITION BY model)") + " SELECT * FROM report")
def stored_predictions(spark, sf_dir):
    return service.stored_against_labels(_two(spark, sf_dir).withColumn("label", F.col("pred_a")))


@query("SELECT doc_id AS item_id, CASE WHEN coalesce(length(text), 0) = 0 THEN 'empty' WHEN length(text) > 20000 THEN 'too long' END AS problem FROM documents")
def checked_texts(spark, sf_dir):
    texts = ad.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), "text")
    return service.check_texts(texts).select("item_id", "problem")
