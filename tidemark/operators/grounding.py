"""Evidence, claims, their verification, and briefs; for all tickers at once.

``evidence``: chunk_id, ticker, aspect, score, confidence, similarity, doc_date, section, text.
``claims``: ticker, claim_id, side, aspect, text, cited (array of chunk_id), ord.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.functions.lexicons import NEGATIVE_CUES, POSITIVE_CUES
from tidemark.functions.text import half_up

MIN_SIMILARITY, MIN_OVERLAP = 0.12, 0.45
ENTAILED, CONTRADICTED = 0.5, 0.6
#: Sentences of each aspect, by hash, that wrong citations are drawn from.
POOL = 1_024

#: A scorer of (premises, hypotheses): a pair of entailment and contradiction for each.
Entailment = Callable[[list[str], list[str]], list[tuple[float, float]]]


@lru_cache(maxsize=4)
def _loaded(factory: Callable[[], Entailment]) -> Entailment:
    return factory()


def entailment_hook(factory: Callable[[], Entailment]) -> Callable[[Column, Column], Column]:
    """A Column function (premise, hypothesis) to struct(entailment, contradiction), for ``verify``.

    ``factory`` is an importable function that loads a scorer; each Python worker
    calls it once, whatever the number of batches and tasks."""

    @F.pandas_udf("struct<entailment:double,contradiction:double>")
    def scored(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        scorer = _loaded(factory)
        for premise, hypothesis in batches:
            found = scorer(premise.fillna("").tolist(), hypothesis.fillna("").tolist())
            yield pd.DataFrame(found, columns=["entailment", "contradiction"], dtype=float)

    return scored


def shared_words() -> Entailment:
    """A scorer without a model: the share of the hypothesis' words that the premise has; a negation on one side alone contradicts."""

    def score(premises: list[str], hypotheses: list[str]) -> list[tuple[float, float]]:
        out = []
        for premise, hypothesis in zip(premises, hypotheses):
            a, b = ({w.strip(".,;:!?\"'()").lower() for w in x.split()} for x in (premise, hypothesis))
            share = len(a & b) / len(b) if b else 0.0
            turned = bool(a & {"not", "no", "never"}) != bool(b & {"not", "no", "never"})
            out.append((0.0, share) if turned else (share, 0.0))
        return out

    return score


def strength() -> Column:
    return F.abs("score") * (0.5 + F.col("confidence")) + 0.3 * F.coalesce("similarity", F.lit(0.0))


def evidence_topk(evidence: DataFrame, k: int = 4) -> DataFrame:
    """The k strongest sentences per ticker, aspect and side; neutral ones are left out."""
    side = F.when(F.col("score") > 0.15, "bull").when(F.col("score") < -0.15, "bear")
    sided = evidence.withColumns({"side": side, "strength": strength()}).where("side IS NOT NULL")
    w = Window.partitionBy("ticker", "aspect", "side").orderBy(F.desc("strength"), "chunk_id")
    return sided.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def side_counts(evidence: DataFrame) -> DataFrame:
    return evidence.groupBy("ticker", "aspect").agg(
        half_up(F.avg("score")).alias("mean"), F.count("*").alias("n"), F.count_if(F.col("score") > 0.15).alias("n_pos"), F.count_if(F.col("score") < -0.15).alias("n_neg")
    )


def greedy_claims(top: DataFrame, most: int = 6) -> DataFrame:
    """Per ticker and side: by strength, skipping used aspects and used sentences; then the ``most`` extreme.

    ``top`` holds k rows per aspect and side, so each array is small; the
    exclusive picks are one fold over it."""
    # array_sort orders structs by their fields: strongest first, then smaller ids
    row = F.struct((-F.col("strength")).alias("o"), "chunk_id", "aspect", "score", "doc_date", "section", "text")
    rows = top.groupBy("ticker", "side").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    kind = rows.schema["rows"].dataType.simpleString()
    none = F.array().cast(kind)
    taken = lambda picks, x: F.exists(picks, lambda p: (p["aspect"] == x["aspect"]) | (p["chunk_id"] == x["chunk_id"]))
    picks = F.aggregate("rows", none, lambda acc, x: F.when(taken(acc, x), acc).otherwise(F.concat(acc, F.array(x))))
    ranked = F.array_sort(F.transform(picks, lambda p: F.struct((-F.abs(p["score"])).alias("o"), p["o"].alias("o2"), p.alias("p"))))
    out = rows.select("ticker", "side", F.posexplode(F.slice(ranked, 1, most)).alias("pos", "x")).select("ticker", "side", "pos", "x.p.*")
    prefix = F.when(F.col("side") == "bull", "bl").otherwise("br")
    tone = F.when(F.col("side") == "bull", "supportive").otherwise("concerning")
    name = F.initcap(F.replace("aspect", F.lit("_"), F.lit(" ")))
    text = F.concat(name, F.lit(" is "), tone, F.lit(" ("), F.col("doc_date").cast("string"), F.lit(", "), F.col("section"), F.lit('): "'), tx.clean_quote(F.col("text")), F.lit('"'))
    return out.select("ticker", "side", F.concat(prefix, F.col("pos") + 1).alias("claim_id"), "aspect", "score", text.alias("text"), F.array("chunk_id").alias("cited"), F.col("pos").alias("ord"))


def verify(claims: DataFrame, evidence: DataFrame, dimensions: int = 384, negative: str = NEGATIVE_CUES, positive: str = POSITIVE_CUES, keys: tuple[str, ...] = ("ticker", "claim_id"),
           entailment: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Status and reason of each claim against the sentences that it cites.

    In this order: citations must resolve (some of them missing: at best
    unverified); numbers must stand in the cited text; a polarity that the cited
    scores contradict rejects unless the claim all but quotes its source; enough
    similarity and shared words make it supported.  With an ``entailment`` hook
    its contradiction decides instead of the scores, and only entailed claims
    are supported.  ``evidence``: chunk_id (unique), text, score."""
    body = claims.withColumns({"body": tx.claim_body(F.col("text")), "n_cited": F.coalesce(F.size("cited"), F.lit(0))})
    body = body.withColumn("n_cited", F.greatest("n_cited", F.lit(0)))
    cited = body.select(*keys, "body", F.explode("cited").alias("chunk_id")).join(evidence.select("chunk_id", F.col("text").alias("source"), F.col("score").alias("s")), "chunk_id")
    vec = lambda c: tx.hashed_embedding(F.col(c), dimensions)
    compared = cited.withColumn("sim", tx.map_dot(vec("body"), vec("source")))
    found = compared.groupBy(*keys).agg(
        F.count("*").alias("n_found"), F.max("sim").alias("sim"), F.avg("s").alias("chunk_score"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk_id", "source"))), lambda x: x["source"]), " ").alias("cited_text"),
    )
    rows = body.join(found, list(keys), "left").fillna(0, ["n_found"])
    mine, theirs = tx.content_words(F.col("body")), tx.content_words(F.coalesce("cited_text", F.lit("")))
    rows = rows.withColumns({
        "missing": F.array_except(tx.numbers(F.col("body")), tx.numbers(F.coalesce("cited_text", F.lit("")))),
        "overlap": F.coalesce(F.try_divide(F.size(F.array_intersect(mine, theirs)), F.size(mine)), F.lit(0.0)),
        "neg": F.col("body").rlike(tx.any_of(negative)), "pos": F.col("body").rlike(tx.any_of(positive)),
    })
    against = (F.col("pos") & ~F.col("neg") & (F.col("chunk_score") < -0.3)) | (F.col("neg") & ~F.col("pos") & (F.col("chunk_score") > 0.3))
    against &= ~((F.col("sim") >= 0.8) & (F.col("overlap") >= 0.9))
    entailed = F.lit(True)
    if entailment is not None:
        rows = rows.withColumn("nli", entailment(F.coalesce("cited_text", F.lit("")), F.col("body")))
        against, entailed = F.col("nli.contradiction") >= CONTRADICTED, F.col("nli.entailment") >= ENTAILED
    passed = entailed & (F.col("n_found") == F.col("n_cited")) & (F.col("sim") >= MIN_SIMILARITY) & (F.col("overlap") >= MIN_OVERLAP)
    reason = F.when(F.col("n_found") == 0, "no valid citation").when(F.size("missing") > 0, "numbers not in cited text")
    reason = reason.when(against, "contradicted by cited evidence").when(passed, "ok").otherwise("weak support")
    status = F.when(F.col("reason") == "ok", "supported").when(F.col("reason") == "weak support", "unverified").otherwise("rejected")
    return rows.withColumn("reason", reason).withColumn("status", status).drop("missing", "neg", "pos")


def verdict_counts(verified: DataFrame, keys: tuple[str, ...] = ("ticker",)) -> DataFrame:
    return verified.groupBy(*keys).agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("supported", "unverified", "rejected")])


def dedupe_claims(claims: DataFrame) -> DataFrame:
    """The first claim per side and set of cited sentences."""
    w = Window.partitionBy("ticker", "side", F.array_sort("cited")).orderBy("ord", "claim_id")
    return claims.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def stance(summary: DataFrame) -> DataFrame:
    """Net sentiment per ticker, the mean of its aspects' means, and its name."""
    # sums of doubles depend on their order; the last digits may not decide a rounding
    net = summary.groupBy("ticker").agg(F.round(F.avg("mean"), 9).alias("net"))
    name = F.when(F.col("net") > 0.2, "leaning positive").when(F.col("net") < -0.2, "leaning negative").otherwise("mixed")
    return net.select("ticker", half_up(F.col("net"), 3).alias("net"), name.alias("stance"))


def brief_confidence(verified: DataFrame, evidence: DataFrame, n_aspects: int = 6) -> DataFrame:
    """0.5 survival + 0.3 mean evidence confidence + 0.2 aspect coverage, at most 1."""
    alive = F.when(F.col("status") != "rejected", F.col("aspect"))
    counts = verified.groupBy("ticker").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "supported").alias("sup"),
                                            F.count_if(F.col("status") == "unverified").alias("unv"), F.count_distinct(alive).alias("covered"))
    sure = evidence.groupBy("ticker").agg(F.avg("confidence").alias("sure"))
    rows = counts.join(sure, "ticker", "left").fillna(0.0, ["sure"])
    survival = F.coalesce(F.try_divide(F.col("sup") + 0.4 * F.col("unv"), F.col("total")), F.lit(0.0))
    score = F.least(F.lit(1.0), 0.5 * survival + 0.3 * F.col("sure") + 0.2 * F.col("covered") / n_aspects)
    return rows.select("ticker", "total", "sup", "unv", "covered", half_up(survival, 3).alias("survival"), half_up(score, 3).alias("confidence"))


def fingerprints(scores: DataFrame) -> DataFrame:
    """SHA-256 per ticker over its sorted (sentence, aspect, rounded score, model): equal inputs, equal briefs."""
    line = F.concat_ws("|", F.col("chunk_id").cast("string"), "aspect", F.floor(F.col("score") * 1000 + 0.5).cast("long").cast("string"), "model_name")
    return scores.groupBy("ticker").agg(F.sha2(F.array_join(F.sort_array(F.collect_list(line)), "\n"), 256).alias("fingerprint"), F.count("*").alias("n"))


def stale(fingerprinted: DataFrame, briefs: DataFrame) -> DataFrame:
    """Tickers whose inputs have no brief yet."""
    return fingerprinted.join(briefs.select("ticker", "fingerprint"), ["ticker", "fingerprint"], "left_anti")


def summary_lines(verified: DataFrame, stances: DataFrame, deltas: DataFrame, per_side: int = 3) -> DataFrame:
    """Header, up to three supported claims per side, and a warning on the worst delta below -0.3, in order."""
    header = stances.select("ticker", F.lit(0).alias("pos"), F.concat("ticker", F.lit(": aspect sentiment over the period is "), "stance", F.format_string(" (net %+.2f).", F.col("net"))).alias("line"))
    w = Window.partitionBy("ticker", "side").orderBy("ord")
    best = verified.where("status = 'supported'").withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= per_side)
    verb = F.when(F.col("side") == "bull", "Supporting ").otherwise("Concerning ")
    place = F.when(F.col("side") == "bull", 0).otherwise(10) + F.col("rn")
    said = best.select("ticker", place.alias("pos"), F.concat(verb, F.replace("aspect", F.lit("_"), F.lit(" ")), F.lit(": "), F.col("text")).alias("line"))
    worst = deltas.where("delta IS NOT NULL").groupBy("ticker").agg(F.min(F.struct("delta", "doc_date")).alias("w")).where("w.delta < -0.3")
    warn = worst.select("ticker", F.lit(99).alias("pos"), F.concat(F.lit("Weaker in Q&A than in prepared remarks (transcript "), F.col("w.doc_date").cast("string"), F.format_string(": %+.2f).", F.col("w.delta"))).alias("line"))
    return header.unionByName(said).unionByName(warn)


def assemble(verified: DataFrame, stances: DataFrame, confidence: DataFrame) -> DataFrame:
    """One nested brief per ticker: aspect to bull and bear claims, rejected ones left out."""
    entry = F.struct("ord", "claim_id", "text", "cited", "status")
    shown = verified.where("status <> 'rejected'").groupBy("ticker", "aspect").agg(*[F.sort_array(F.collect_list(F.when(F.col("side") == s, entry))).alias(s) for s in ("bull", "bear")])
    body = shown.groupBy("ticker").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("aspect", F.struct("bull", "bear"))))).alias("sections"))
    return stances.join(confidence.select("ticker", "confidence"), "ticker", "left").join(body, "ticker", "left")


def adversarial_cases(evidence: DataFrame, fabrications: list[str]) -> DataFrame:
    """Faithful and corrupted claims of each evidence row: (kind, claim_id, ticker, side, aspect, text, cited).

    A wrong citation is a sentence of another aspect, drawn by hash from the
    first POOL of each by hash; only where all rows have one aspect are there no
    such cases.  ``evidence``: chunk_id unique."""
    names = sorted(r[0] for r in evidence.where("aspect IS NOT NULL").select("aspect").distinct().collect())  # one per aspect
    order = F.create_map(*[F.lit(x) for i, a in enumerate(names) for x in (a, i)]) if names else F.create_map().cast("map<string,int>")
    first = Window.partitionBy("aspect").orderBy(F.xxhash64("chunk_id", "aspect"), "chunk_id")
    pool = evidence.where("aspect IS NOT NULL").withColumn("place", F.row_number().over(first)).where(F.col("place") <= POOL)
    pools = pool.groupBy(order[F.col("aspect")].alias("theirs")).agg(F.sort_array(F.collect_list(F.struct("place", "chunk_id")))["chunk_id"].alias("pool"))
    # another aspect, then one of its pool: both follow from the row's own hash
    step = F.pmod(F.xxhash64("chunk_id", F.lit(5)), F.lit(max(len(names) - 1, 1))) + 1
    theirs = F.pmod(order[F.col("aspect")] + step, F.lit(max(len(names), 1))).cast("int")
    drawn = F.get("pool", F.pmod(F.xxhash64("chunk_id", F.lit(7)), F.size("pool")).cast("int"))
    rows = evidence.withColumn("theirs", theirs if len(names) > 1 else F.lit(None).cast("int")).join(pools, "theirs", "left")
    rows = rows.withColumn("other", F.when(F.col("pool").isNotNull(), drawn)).drop("pool", "theirs")
    invented = F.element_at(tx.strings(fabrications), (F.pmod(F.xxhash64("chunk_id"), F.lit(len(fabrications))) + 1).cast("int"))
    empty = F.array().cast("array<bigint>")
    own, wrong = F.array(F.col("chunk_id").cast("long")), F.array(F.col("other").cast("long"))
    case = lambda kind, text, cited: F.struct(F.lit(kind).alias("kind"), text.alias("text"), cited.alias("cited"))
    t, miss = F.col("text"), F.lit(None).cast("string")
    cases = F.array(
        case("faithful", t, own), case("number_swap", tx.swap_number(t), own), case("polarity_flip", tx.flip_polarity(t), own),
        case("wrong_citation", F.when(F.col("other").isNotNull(), t).otherwise(miss), wrong),
        case("fabrication", F.when(F.col("other").isNotNull(), invented).otherwise(miss), wrong), case("no_citation", t, empty),
    )
    side = F.when(F.col("score") > 0, "bull").otherwise("bear")
    made = rows.select(F.coalesce("ticker", F.lit("")).alias("ticker"), "aspect", side.alias("side"), "chunk_id", F.explode(cases).alias("c")).where("c.text IS NOT NULL")
    return made.select("ticker", "aspect", "side", F.col("c.kind").alias("kind"), F.concat(F.lit("c"), "chunk_id", F.lit("/"), "c.kind").alias("claim_id"), F.col("c.text").alias("text"), F.col("c.cited").alias("cited"))


def catch_rates(verified: DataFrame) -> DataFrame:
    """Per kind: n, share caught (not supported), share rejected; for faithful claims the catch is false."""
    return verified.groupBy("kind").agg(F.count("*").alias("n"), half_up(F.avg((F.col("status") != "supported").cast("double"))).alias("catch_rate"),
                                        half_up(F.avg((F.col("status") == "rejected").cast("double"))).alias("reject_rate"))


def retrieve(scores: DataFrame, vectors: DataFrame, queries: DataFrame, start: str | None = None, end: str | None = None, model: str | None = None) -> DataFrame:
    """Scores within the dates, each with the similarity of its sentence to its aspect's query vector.

    ``vectors``: chunk_id, embedding; ``queries``: aspect, query_vector (one row an
    aspect).  A sentence without a vector, or an aspect without a query, has
    similarity 0."""
    rows = scores.where(F.col("model_name") == model) if model else scores
    rows = rows.where(F.col("doc_date") >= F.lit(start).cast("date")) if start else rows
    rows = rows.where(F.col("doc_date") <= F.lit(end).cast("date")) if end else rows
    joined = rows.drop("similarity").join(vectors.select("chunk_id", "embedding"), "chunk_id", "left").join(queries, "aspect", "left")
    similarity = F.coalesce(half_up(tx.dot(F.col("query_vector"), F.col("embedding"))), F.lit(0.0))
    return joined.withColumn("similarity", similarity).drop("embedding", "query_vector")


def evidence_pool(scores: DataFrame, least: float = 0.15, chars: int = 25) -> DataFrame:
    """The first score (by score_id) of each sentence that is long, opinionated and sure enough."""
    fit = scores.where((F.abs("score") >= least) & (F.length("text") >= chars) & (F.col("confidence") > 0))
    w = Window.partitionBy("chunk_id").orderBy("score_id")
    return fit.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def accept_summary(summaries: DataFrame, verified: DataFrame) -> DataFrame:
    """Summaries (ticker, cited, ...) with ``accepted``: something is cited, and no cited claim was rejected or is unknown."""
    alive = verified.where("status <> 'rejected'").groupBy("ticker").agg(F.collect_set("claim_id").alias("alive"))
    known = lambda x: F.array_contains(F.coalesce("alive", tx.strings([])), x)
    return summaries.join(alive, "ticker", "left").withColumn("accepted", F.coalesce((F.size("cited") > 0) & F.forall("cited", known), F.lit(False))).drop("alive")


def audit_export(verified: DataFrame, evidence: DataFrame, n: int | None = None, seed: str = "s") -> DataFrame:
    """Claims for people to judge, with the sentences that they cite, in an order drawn by hash; the first ``n``, or all."""
    texts = evidence.groupBy("chunk_id").agg(F.min("text").alias("evidence"))
    cited = verified.select("ticker", "claim_id", F.explode("cited").alias("chunk_id")).join(texts, "chunk_id")
    joined = cited.groupBy("ticker", "claim_id").agg(F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("chunk_id", "evidence"))), lambda x: x["evidence"]), " || ").alias("evidence"))
    rows = verified.join(joined, ["ticker", "claim_id"], "left").withColumn("draw", F.md5(F.concat_ws("/", F.lit(seed), "ticker", "claim_id")))
    rows = rows.select("ticker", "claim_id", "side", "text", "evidence", "status", "draw")
    return rows.orderBy("draw", "ticker", "claim_id").limit(n) if n is not None else rows
