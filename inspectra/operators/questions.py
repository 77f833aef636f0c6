"""A closed set of questions: what may be asked, which intent a question has, passages that answer, and claims with citations."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Phrases that are refused, and the keyword groups of each intent; a group counts if all its words are there.
PROHIBITED = ["get sick", "make someone sick", "food poisoning", "negligent", "negligence", "sue", "lawsuit", "legal liability", "guarantee", "guaranteed", "promise we",
              "hide a violation", "hide the violation", "cover up", "falsify", "bribe"]
INTENTS = {
    "recurring_violations": ["recurring", "repeat", "repeated", "repeatedly"],
    "violation_history": ["violation history", "all violations"],
    "latest_inspection_summary": ["latest inspection", "most recent inspection", "last inspection"],
    "inspection_trend": ["trend", "changed over time", "history changed", "improving", "getting worse"],
    "preparation_checklist_from_official_guidance": ["prepare next inspection", "checklist", "review before"],
    "official_guidance_for_documented_codes": ["official guidance", "what guidance applies", "what does mean"],
    "explain_prediction": ["forecast", "prediction", "risk score"],
    "michelin_context": ["michelin", "star rating", "guide recognition"],
    "restaurant_identity": ["restaurant identity", "basic information", "tell me about restaurant", "cuisine type"],
}

#: English stop words of the search.
STOP = """
a about above across after afterwards again against all almost alone along already also although always am among amongst amoungst amount an and another any anyhow anyone anything anyway anywhere are around as at
back be became because become becomes becoming been before beforehand behind being below beside besides between beyond bill both bottom but by call can cannot cant co con could couldnt cry de describe detail do done down due during
each eg eight either eleven else elsewhere empty enough etc even ever every everyone everything everywhere except few fifteen fifty fill find fire first five for former formerly forty found four from front full further get give go
had has hasnt have he hence her here hereafter hereby herein hereupon hers herself him himself his how however hundred i ie if in inc indeed interest into is it its itself keep last latter latterly least less ltd
made many may me meanwhile might mill mine more moreover most mostly move much must my myself name namely neither never nevertheless next nine no nobody none noone nor not nothing now nowhere of off often on once one only onto or other others otherwise our ours ourselves out over own
part per perhaps please put rather re same see seem seemed seeming seems serious several she should show side since sincere six sixty so some somehow someone something sometime sometimes somewhere still such system
take ten than that the their them themselves then thence there thereafter thereby therefore therein thereupon these they thick thin third this those though three through throughout thru thus to together too top toward towards twelve twenty two
un under until up upon us very via was we well were what whatever when whence whenever where whereafter whereas whereby wherein whereupon wherever whether which while whither who whoever whole whom whose why will with within without would yet you your yours yourself yourselves
""".split()


def prohibited(question: Column, patterns: list[str] | None = None, *, whole_words: bool = False) -> Column:
    """Whether a question holds a refused phrase, anywhere or (``whole_words``) at word bounds."""
    q = F.lower(question)
    hit = (lambda p: q.rlike(rf"\b{p}\b")) if whole_words else (lambda p: F.contains(q, F.lit(p)))
    return reduce(lambda a, p: a | hit(p), PROHIBITED if patterns is None else patterns, F.lit(False))


def intent(question: Column, intents: dict[str, list[str]] | None = None) -> Column:
    """``struct(outcome, intent)``: matched, ambiguous (several best), unknown or prohibited. A score counts whole groups."""
    words = F.regexp_extract_all(F.lower(question), F.lit(r"([a-z0-9']+)"), F.lit(1))
    score = lambda groups: reduce(lambda a, g: a + F.when(F.size(F.array_except(F.array(*[F.lit(w) for w in g.split()]), words)) == 0, 1).otherwise(0), groups, F.lit(0))
    scores = F.array(*[F.struct(score(g).alias("n"), F.lit(k).alias("intent")) for k, g in sorted((INTENTS if intents is None else intents).items())])
    best = F.array_max(scores)["n"]
    top = F.filter(scores, lambda s: s["n"] == best)
    outcome = F.when(prohibited(question), "prohibited").when(F.coalesce(best, F.lit(0)) == 0, "unknown").when(F.size(top) > 1, "ambiguous").otherwise("matched")
    return F.struct(outcome.alias("outcome"), F.when(outcome == "matched", top[0]["intent"]).alias("intent"))


def current_passages(passages: DataFrame, jurisdiction: str, use: str | None = None) -> DataFrame:
    """Passages of one jurisdiction that are not superseded and, if asked, may be used so."""
    p = passages.where((F.col("jurisdiction") == jurisdiction) & ~F.coalesce("superseded", F.lit(False)))
    return p if use is None else p.where(F.array_contains("permitted_uses", use))


def passages_for(passages: DataFrame, column: str, wanted: list[str]) -> DataFrame:
    """Passages whose list in ``column`` shares an entry with the wanted ones, whatever the case, by id."""
    up = F.transform(F.col(column), lambda x: F.upper(x))
    return passages.where(F.arrays_overlap(up, F.array(*[F.lit(w.upper()) for w in wanted]).cast("array<string>"))).orderBy("passage_id")


def tokens(text: Column, stop: list[str] | None = None) -> Column:
    words = F.regexp_extract_all(F.lower(text), F.lit(r"\b(\w\w+)\b"), F.lit(1))
    return F.filter(words, lambda w: ~w.isin(stop)) if stop else words


def tfidf_top(documents: DataFrame, queries: DataFrame, *, doc: str, text: str, query: str, query_text: str, k: int = 5, least: float = 0.05, stop: list[str] | None = None) -> DataFrame:
    """``(query, doc, score)``: the ``k`` documents with the highest cosine to each query, at least ``least``; ties by document.

    Weights are counts times ``ln((1 + n) / (1 + df)) + 1`` over documents. A block of queries meets a block of documents as
    whole vectors in one task, which keeps the best ``k`` a query; so what is moved are vectors, never pairs. Terms go as
    64-bit hashes. Sums run in the order of the terms, so that equal texts have equal scores.
    """
    post = lambda df, i, t: df.where(F.col(i).isNotNull()).select(F.col(i).alias("id"), F.explode(F.transform(tokens(F.col(t), stop), lambda w: F.xxhash64(w))).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))
    d, q = post(documents, doc, text), post(queries, query, query_text)
    n, asked = documents.count(), queries.count()
    idf = d.groupBy("term").agg((F.log(F.lit(1.0 + n) / (1.0 + F.count("*"))) + 1.0).alias("idf"))
    rest = F.log(F.lit(1.0 + n)) + 1.0
    by = -(-max(1, n) // BLOCK)
    of = max(-(-max(1, asked) // BLOCK), documents.sparkSession.sparkContext.defaultParallelism)

    def vectors(post: DataFrame, how: str, own: int, others: int, key) -> DataFrame:
        """A row a text and block of the other side, with its terms in order."""
        v = post.join(idf, "term", how).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("term", (F.col("tf") * F.coalesce("idf", rest)).alias("w")))).alias("v"))
        v = v.select("id", F.col("v.term").alias("terms"), F.col("v.w").alias("w"), F.pmod(F.xxhash64("id"), F.lit(own)).alias("own"), F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias("other"))
        return v.select(key(F.col("own"), F.col("other")).alias("cell"), "id", "terms", "w")

    left, right = vectors(q, "left", of, by, lambda own, other: own * by + other), vectors(d, "inner", by, of, lambda own, other: other * by + own)
    types = f"q {dict(q.dtypes)['id']}, d {dict(d.dtypes)['id']}, score double"
    best = left.groupBy("cell").cogroup(right.groupBy("cell")).applyInPandas(lambda a, b: _best(a, b, k, least), types)
    win = Window.partitionBy("q").orderBy(F.desc("score"), F.asc("d"))
    return best.withColumn("_r", F.row_number().over(win)).where(F.col("_r") <= k).select(F.col("q").alias(query), F.col("d").alias(doc), "score")


#: Texts of a side that meet in one task.
BLOCK = 20_000


def _best(queries: pd.DataFrame, documents: pd.DataFrame, k: int, least: float) -> pd.DataFrame:
    """The best documents of each query, by postings of the documents; ``terms`` are in order in each row."""
    if queries.empty or documents.empty:
        return pd.DataFrame({"q": queries["id"][:0], "d": documents["id"][:0], "score": np.empty(0)})
    documents = documents.sort_values("id", ignore_index=True)
    sizes = documents["terms"].map(len).to_numpy()
    norms = np.array([np.sqrt(np.sum(w * w)) for w in documents["w"]])
    terms, weights, rows = np.concatenate(documents["terms"].to_list()), np.concatenate(documents["w"].to_list()), np.repeat(np.arange(len(documents)), sizes)
    order = np.argsort(terms, kind="stable")
    terms, weights, rows = terms[order], weights[order], rows[order]
    known, start = np.unique(terms, return_index=True)
    end = np.append(start[1:], len(terms))
    q_out, d_out, s_out = [], [], []
    for qid, q_terms, q_w in zip(queries["id"], queries["terms"], queries["w"]):
        sums = np.zeros(len(documents))
        at = np.minimum(np.searchsorted(known, q_terms), len(known) - 1)
        for j in np.flatnonzero(known[at] == q_terms):
            own = slice(start[at[j]], end[at[j]])
            sums[rows[own]] += q_w[j] * weights[own]
        scores = sums / (np.sqrt(np.sum(q_w * q_w)) * norms)
        found = np.flatnonzero((scores >= least) & (sums > 0))
        if len(found) > k:
            found = found[scores[found] >= np.partition(scores[found], len(found) - k)[len(found) - k]]
            found = found[np.argsort(-scores[found], kind="stable")][:k]
        q_out += [qid] * len(found)
        d_out.append(found)
        s_out.append(scores[found])
    return pd.DataFrame({"q": pd.Series(q_out, dtype=queries["id"].dtype), "d": documents["id"].to_numpy()[np.concatenate(d_out)], "score": np.concatenate(s_out)})


# What evidence a claim may rest on.
EVIDENCE = {
    "restaurant_identity": ["record"], "latest_inspection": ["record"], "recurring_violation": ["record"], "violation_frequency": ["record"], "history_trend": ["record"],
    "award_context": ["award"], "forecast_availability": ["model"], "guidance_for_code": ["guidance"], "guidance_for_topic": ["guidance"], "guidance_unavailable": [],
}


def unauthorized_claims(claims: DataFrame, citations: DataFrame) -> DataFrame:
    """Claims with a citation of a kind they may not use or of another jurisdiction, and guidance claims without any."""
    allowed = F.create_map(*[x for k, v in EVIDENCE.items() for x in (F.lit(k), F.array(*[F.lit(e) for e in v]).cast("array<string>"))])
    may = F.coalesce(F.try_element_at(allowed, F.col("claim_type")), F.array().cast("array<string>"))
    c = claims.join(citations.select("claim_id", "evidence", F.col("jurisdiction").alias("cited")), "claim_id", "left")
    bad = (F.col("evidence").isNotNull() & (~F.array_contains(may, F.col("evidence")) | (F.col("cited") != F.col("jurisdiction")))) | (F.col("evidence").isNull() & F.col("claim_type").isin("guidance_for_code", "guidance_for_topic"))
    return c.where(bad).select("claim_id", "claim_type").distinct()


TEMPLATES = {
    "latest_inspection": ("The latest documented inspection was on %s (%s).", ["inspection_date", "inspection_type"]),
    "recurring_violation": ("Code %s was cited on %s occasions.", ["violation_code_norm", "occurrences"]),
    "history_trend": ("%s inspections are documented from %s to %s.", ["n", "first_date", "last_date"]),
}


def rendered(facts: DataFrame, template: str) -> DataFrame:
    text, columns = TEMPLATES[template]
    return facts.withColumn("sentence", F.format_string(text, *[F.coalesce(F.col(c).cast("string"), F.lit("unknown")) for c in columns]))


def truncated_claims(claims: DataFrame, citations: DataFrame, *, max_claims: int = 20, max_citations: int = 30) -> DataFrame:
    """The first claims of each answer, by order, as long as whole groups of citations fit."""
    n = claims.join(citations.groupBy("claim_id").agg(F.count("*").alias("c")), "claim_id", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    w = Window.partitionBy("answer_id").orderBy("position", "claim_id")
    r = n.withColumns({"_n": F.row_number().over(w), "_c": F.sum("c").over(w)})
    return r.where((F.col("_n") <= max_claims) & (F.col("_c") <= max_citations)).drop("_n", "_c", "c")
