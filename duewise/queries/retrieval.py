"""Queries on texts, the case corpus and hybrid retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from duewise import params as P
from duewise.functions.text import tokens
from duewise.operators import corpus as C
from duewise.operators import features as FE
from duewise.operators import retrieval as R
from duewise.queries.registry import query
from duewise.queries.sqlviews import AS_OF, fdays, r, sql, view
from duewise.session import materialise
from duewise.sources.driver_tables import read_raw

# The checks


def _front(alias: str = "f") -> str:
    a = alias
    return f"""{a}.customer_segment || ' segment, ' || {a}.customer_industry || ' industry customer. Invoice amount Rs.' ||
      format('{{:,}}', round_even({a}.amount, 0)::BIGINT) || ', ' || {a}.payment_term_days || '-day payment terms. ' ||
      CASE WHEN {a}.prior_payment_rate IS NULL THEN 'no prior payment history' ELSE 'prior payment rate ' || round_even({a}.prior_payment_rate * 100, 0)::BIGINT || '%' END || '.'"""


view("first_actions", """SELECT invoice_id, list(action_type ORDER BY first_at, first_id) AS action_types FROM (
  SELECT invoice_id, action_type, min(timestamp) AS first_at, arg_min(id, (timestamp, id)) AS first_id FROM actions GROUP BY 1, 2) GROUP BY 1""")
view("case_rows", f"""SELECT f.invoice_id, f.customer_id, f.merchant_id, f.status, f.amount, f.customer_segment AS segment, f.customer_industry AS industry,
  CASE WHEN f.status = 'paid' THEN {fdays('f.due_date::TIMESTAMP', 'f.paid_at')} END AS delay_days, array_to_string(coalesce(a.action_types, []), ',') AS action_types,
  i.true_root_cause = 'dispute' AS is_disputed, {_front()} || ' Actions taken: ' ||
  CASE WHEN len(a.action_types) > 0 THEN array_to_string(a.action_types, ', ') ELSE 'no follow-up action taken' END || '. Outcome: ' ||
  CASE WHEN f.status <> 'paid' THEN 'written off, never recovered' WHEN {fdays('f.due_date::TIMESTAMP', 'f.paid_at')} > 0
    THEN 'paid ' || {fdays('f.due_date::TIMESTAMP', 'f.paid_at')}::BIGINT || ' days late' ELSE 'paid on time' END || '.' AS case_text
  FROM feat_recovery f JOIN invoices i ON i.id = f.invoice_id LEFT JOIN first_actions a ON a.invoice_id = f.invoice_id""")
view("live_queries", f"""SELECT f.invoice_id AS query_id, f.amount, f.customer_segment AS segment, f.customer_industry AS industry,
  i.true_root_cause = 'dispute' AS is_disputed, {_front()} || ' Currently ' || {fdays('f.due_date::TIMESTAMP', AS_OF)}::BIGINT || ' days overdue.' AS text
  FROM feat_live f JOIN invoices i ON i.id = f.invoice_id""")
view("vectors", "SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS norm FROM embeddings")


def retrieval_views(name: str, queries: str, cases: str, own: bool) -> None:
    """``queries``: query_id, text, amount, segment, industry, is_disputed, vec_id; ``cases``: doc_id, case_text and the same.

    Straight from the definition: the pool of each query, every candidate scored, three ranks, fused.
    """
    view(f"q_{name}", queries)
    view(f"c_{name}", cases)
    same_ind = "c.segment = q.segment AND c.industry = q.industry"
    levels = [f"c.is_disputed AND {same_ind}", "c.is_disputed AND c.segment = q.segment", "c.is_disputed", same_ind, "c.segment = q.segment", "true"]
    minus = "AND c.doc_id <> q.query_id" if own else ""
    counts = ", ".join(f"count(*) FILTER ({cond} {minus}) AS n{i}" for i, cond in enumerate(levels, 1))
    view(f"kinds_{name}", f"SELECT DISTINCT segment, industry, is_disputed{', query_id' if own else ''} FROM q_{name}")
    pick = " ".join(f"WHEN {'q.is_disputed AND ' if i < 4 else ''}n{i} >= {P.MIN_CANDIDATES} THEN {i}" for i in range(1, 6))
    key = ", q.query_id" if own else ""
    view(f"level_{name}", f"""SELECT q.segment, q.industry, q.is_disputed{key}, CASE {pick} ELSE 6 END AS level,
      CASE CASE {pick} ELSE 6 END {' '.join(f'WHEN {i} THEN n{i}' for i in range(1, 7))} END AS n_candidates FROM (
      SELECT q.segment, q.industry, q.is_disputed{key}, {counts} FROM kinds_{name} q, c_{name} c GROUP BY ALL) q""")
    match = " OR ".join(f"(l.level = {i} AND {cond})" for i, cond in enumerate(levels, 1))
    own_join = "AND l.query_id = q.query_id" if own else ""
    view(f"pick_{name}", f"""SELECT q.query_id, l.level, l.n_candidates FROM q_{name} q JOIN level_{name} l
      ON l.segment = q.segment AND l.industry = q.industry AND l.is_disputed = q.is_disputed {own_join}""")
    # Pools: one per query when its own case is taken out, else one per kind.
    if own:
        view(f"pool_{name}", f"SELECT l.query_id::VARCHAR AS pool, c.doc_id FROM level_{name} l JOIN q_{name} q ON q.query_id = l.query_id JOIN c_{name} c ON ({match}) AND c.doc_id <> l.query_id")
        view(f"qp_{name}", f"SELECT q.*, q.query_id::VARCHAR AS pool FROM q_{name} q")
    else:
        pool = "l.level || '|' || CASE WHEN l.level IN (3, 6) THEN '' WHEN l.level IN (2, 5) THEN l.segment ELSE l.segment || '|' || l.industry END"
        view(f"pool_{name}", f"SELECT DISTINCT {pool} AS pool, c.doc_id FROM level_{name} l JOIN c_{name} c ON ({match.replace('q.', 'l.')})")
        view(f"qp_{name}", f"SELECT q.*, {pool} AS pool FROM q_{name} q JOIN level_{name} l ON l.segment = q.segment AND l.industry = q.industry AND l.is_disputed = q.is_disputed")
    view(f"tf_{name}", f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(case_text), '[a-z0-9]+')) AS term FROM c_{name}) GROUP BY 1, 2")
    view(f"dl_{name}", f"SELECT doc_id, len(regexp_extract_all(lower(case_text), '[a-z0-9]+')) AS dl FROM c_{name}")
    view(f"ps_{name}", f"SELECT pool, count(*) AS n, avg(dl) AS avgdl FROM pool_{name} JOIN dl_{name} USING (doc_id) GROUP BY 1")
    view(f"df_{name}", f"""SELECT pool, term, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM (
      SELECT pool, term, count(*) AS df FROM pool_{name} JOIN tf_{name} USING (doc_id) GROUP BY 1, 2) JOIN ps_{name} USING (pool)""")
    view(f"idf_{name}", f"""SELECT d.pool, d.term, CASE WHEN d.idf < 0 THEN {P.BM25_EPSILON} * m.mean ELSE d.idf END AS idf
      FROM df_{name} d JOIN (SELECT pool, avg(idf) AS mean FROM df_{name} GROUP BY 1) m ON m.pool = d.pool""")
    view(f"qt_{name}", f"SELECT query_id, pool, term, count(*) AS qtf FROM (SELECT query_id, pool, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM qp_{name}) GROUP BY 1, 2, 3")
    view(f"bm_{name}", f"""SELECT q.query_id, t.doc_id, sum(q.qtf * i.idf * t.tf * {P.BM25_K1 + 1} / (t.tf + {P.BM25_K1} * (1 - {P.BM25_B} + {P.BM25_B} * d.dl / p.avgdl))) AS s
      FROM qt_{name} q JOIN idf_{name} i ON i.pool = q.pool AND i.term = q.term JOIN tf_{name} t ON t.term = q.term
      JOIN pool_{name} m ON m.pool = q.pool AND m.doc_id = t.doc_id JOIN dl_{name} d ON d.doc_id = t.doc_id JOIN ps_{name} p ON p.pool = q.pool GROUP BY 1, 2""")
    half = lambda e: f"round({e}, 9)"
    view(f"cos_{name}", f"""SELECT a.vec_id AS qv, b.vec_id AS cv, {half('list_dot_product(a.v, b.v) / (a.norm * b.norm)')} AS s FROM
      (SELECT * FROM vectors WHERE vec_id IN (SELECT vec_id FROM q_{name})) a, (SELECT * FROM vectors WHERE vec_id IN (SELECT vec_id FROM c_{name})) b""")
    view(f"scored_{name}", f"""SELECT q.query_id, c.doc_id, cs.s AS s_vector, {half('coalesce(b.s, 0)')} AS s_bm25, -{half('abs(ln(c.amount) - ln(q.amount))')} AS s_amount
      FROM qp_{name} q JOIN pool_{name} m ON m.pool = q.pool JOIN c_{name} c ON c.doc_id = m.doc_id JOIN cos_{name} cs ON cs.qv = q.vec_id AND cs.cv = c.vec_id
      LEFT JOIN bm_{name} b ON b.query_id = q.query_id AND b.doc_id = c.doc_id""")
    rank = lambda s: f"row_number() OVER (PARTITION BY query_id ORDER BY {s} DESC, doc_id)"
    view(f"ranked_{name}", f"SELECT *, {rank('s_vector')} AS r_vector, {rank('s_bm25')} AS r_bm25, {rank('s_amount')} AS r_amount FROM scored_{name}")
    view(f"top_{name}", f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, doc_id) AS rank FROM (
      SELECT *, 1.0 / (60 + r_vector) + 1.0 / (60 + r_bm25) + 1.0 / (60 + r_amount) AS rrf_score FROM ranked_{name})) WHERE rank <= {P.TOP_K}""")


_cases = "SELECT invoice_id AS doc_id, case_text, amount, segment, industry, is_disputed, invoice_id % (SELECT count(*) FROM embeddings) AS vec_id FROM case_rows"
retrieval_views("live", "SELECT *, (query_id * 7 + 3) % (SELECT count(*) FROM embeddings) AS vec_id FROM live_queries", _cases, False)
view("sample_rows", f"SELECT * FROM feat_recovery ORDER BY md5('{P.SEED}:' || invoice_id), invoice_id LIMIT 60")
retrieval_views("sample", f"""SELECT f.invoice_id AS query_id, f.amount, f.customer_segment AS segment, f.customer_industry AS industry, false AS is_disputed,
  {_front()} AS text, (f.invoice_id * 7 + 3) % (SELECT count(*) FROM embeddings) AS vec_id FROM sample_rows f""", _cases, True)
_doc_seg = "CASE item_id % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' WHEN 2 THEN 'de' ELSE 'es' END"
retrieval_views(
    "docs", f"SELECT item_id AS query_id, text, length(text)::DOUBLE AS amount, {_doc_seg} AS segment, 'src' || item_id % 20 AS industry, false AS is_disputed, item_id % (SELECT count(*) FROM embeddings) AS vec_id FROM benchmark",
    "SELECT doc_id, text AS case_text, n_chars::DOUBLE AS amount, lang AS segment, source AS industry, false AS is_disputed, doc_id % (SELECT count(*) FROM embeddings) AS vec_id FROM documents", False)

# The queries


def _with_vector(x, rows, key, mix):
    vectors = read_raw(x.spark, x.sf_dir, "embeddings").select(F.col("vec_id"), "embedding")
    n = vectors.agg(F.count(F.lit(1)).alias("n")).scalar()
    return rows.withColumn("vec_id", mix(F.col(key)) % n).join(vectors, "vec_id").drop("vec_id")


def corpus(x):
    return C.corpus_rows(FE.recovery_features(x.d), x.d.actions)


def _disputed(x, rows, key):
    flags = x.d.invoices.select(F.col("id").alias(key), F.col("true_root_cause").eqNullSafe("dispute").alias("is_disputed"))
    return rows.join(flags, key)


def corpus_vectors(x):
    """The stored case table: retrieval reads a written corpus, as it reads it several times."""
    rows = _with_vector(x, _disputed(x, corpus(x), "invoice_id"), "invoice_id", lambda k: k)
    return materialise(rows.drop("action_types", "status", "delay_days", "customer_id", "merchant_id"), "corpus")


def live_queries(x):
    rows = _disputed(x, C.case_queries(FE.live_features(x.d), x.as_of), "query_id")
    return materialise(_with_vector(x, rows, "query_id", lambda k: k * 7 + 3), "queries")


def document_corpus(x):
    rows = x.raw("documents").select(
        F.col("doc_id").alias("invoice_id"), F.col("text").alias("case_text"), F.col("n_chars").cast("double").alias("amount"),
        F.col("lang").alias("segment"), F.col("source").alias("industry"), F.lit(False).alias("is_disputed"),
    )
    return _with_vector(x, rows, "invoice_id", lambda k: k)


def document_queries(x):
    item = F.col("item_id")
    lang = F.when(item % 4 == 0, "en").when(item % 4 == 1, "fr").when(item % 4 == 2, "de").otherwise("es")
    rows = x.raw("benchmark").select(
        item.cast("bigint").alias("query_id"), "text", F.length("text").cast("double").alias("amount"), lang.alias("segment"),
        F.concat(F.lit("src"), item % 20).alias("industry"), F.lit(False).alias("is_disputed"),
    )
    return _with_vector(x, rows, "query_id", lambda k: k)


_RANKS = "r_vector, r_bm25, r_amount"


@query("O061_candidate_pool", sql("SELECT query_id, level, n_candidates FROM pick_live".replace("level,", "level::BIGINT AS level,")))
def pool(x):
    sized = R.pool_sizes(_disputed(x, corpus(x), "invoice_id"))
    asked = _disputed(x, C.case_queries(FE.live_features(x.d)), "query_id").withColumn("own_disputed", F.lit(None).cast("boolean"))
    chosen = R.choose_pools(asked, sized)
    return chosen.select("query_id", F.substring("pool", 1, 1).cast("bigint").alias("level"), "n_candidates")


@query("O110_relaxation_cascade", sql("SELECT is_disputed, level::BIGINT AS level, count(*) AS n FROM pick_live JOIN q_live USING (query_id) GROUP BY 1, 2"))
def cascade(x):
    sized = R.pool_sizes(_disputed(x, corpus(x), "invoice_id"))
    asked = _disputed(x, C.case_queries(FE.live_features(x.d)), "query_id").withColumn("own_disputed", F.lit(None).cast("boolean"))
    return R.choose_pools(asked, sized).groupBy("is_disputed", F.substring("pool", 1, 1).cast("bigint").alias("level")).agg(F.count(F.lit(1)).alias("n"))


@query("O112_ordered_actions", sql("SELECT invoice_id, array_to_string(action_types, ',') AS action_types FROM first_actions"))
def ordered(x):
    return C.ordered_actions(x.d.actions)


@query("O121_case_text", sql("SELECT invoice_id, case_text FROM case_rows"))
def texts(x):
    return corpus(x).select("invoice_id", "case_text")


@query("O122_query_text", sql("SELECT query_id, text FROM live_queries"))
def query_texts(x):
    return C.case_queries(FE.live_features(x.d), x.as_of).select("query_id", "text")


@query("O123_corpus_rows", sql(f"""SELECT invoice_id, customer_id, merchant_id, case_text, status, {r('delay_days', 2)} AS delay_days, {r('amount', 2)} AS amount,
  segment, industry, action_types FROM case_rows"""), digits=2)
def corpus_table(x):
    return corpus(x)


@query("O124_tokenise", "SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+'))::BIGINT AS n_tokens, md5(array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ')) AS tokens FROM documents")
def tokenise(x):
    t = tokens(F.col("text"))
    return x.raw("documents").select("doc_id", F.size(t).alias("n_tokens"), F.md5(F.array_join(t, " ")).alias("tokens"))


_one = "SELECT query_id, doc_id, {s} AS s_{name}, r_{name} AS rank FROM ranked_docs WHERE r_{name} <= 5"


def _single(x, name):
    found = R.hybrid_retrieve(document_queries(x), document_corpus(x), lists=(name,))
    return found.select("query_id", "doc_id", f"s_{name}", "rank")


@query("O125_bm25", sql(_one.format(name="bm25", s=r("s_bm25"))))
def bm25(x):
    return _single(x, "bm25")


@query("O126_cosine", sql(_one.format(name="vector", s=r("s_vector"))))
def cosine(x):
    return _single(x, "vector")


@query("O127_amount_closeness", sql(_one.format(name="amount", s=r("s_amount"))))
def closeness(x):
    return _single(x, "amount")


@query("O103_stable_ranks", sql(f"SELECT query_id, doc_id, {_RANKS} FROM top_docs"))
def stable_ranks(x):
    return R.hybrid_retrieve(document_queries(x), document_corpus(x)).select("query_id", "doc_id", "r_vector", "r_bm25", "r_amount")


@query("O128_rank_fusion", sql(f"SELECT query_id, doc_id, {r('rrf_score', 9)} AS rrf_score, rank FROM top_docs"), digits=9)
def fusion(x):
    return R.hybrid_retrieve(document_queries(x), document_corpus(x)).select("query_id", "doc_id", "rrf_score", "rank")


@query("O111_hybrid_retrieve", sql(f"SELECT query_id, doc_id, {_RANKS}, {r('rrf_score', 9)} AS rrf_score, rank FROM top_live"), digits=9)
def retrieve(x):
    found = R.hybrid_retrieve(live_queries(x), corpus_vectors(x))
    return found.select("query_id", "doc_id", "r_vector", "r_bm25", "r_amount", "rrf_score", "rank")


@query("O129_archetype_cohesion", sql(f"""SELECT {r('avg((a.archetype = b.archetype)::INT)')} AS observed_cohesion_rate,
  (SELECT {r('avg(s.share)')} FROM sample_rows f JOIN customers c ON c.id = f.customer_id JOIN (
    SELECT archetype, count(*) / sum(count(*)) OVER () AS share FROM past p JOIN customers c ON c.id = p.customer_id GROUP BY 1) s ON s.archetype = c.archetype) AS baseline_rate,
  (SELECT count(*) FROM sample_rows) AS n_queries, count(*) AS n_retrieved
  FROM top_sample t JOIN invoices i ON i.id = t.query_id JOIN customers a ON a.id = i.customer_id
  JOIN invoices j ON j.id = t.doc_id JOIN customers b ON b.id = j.customer_id"""))
def cohesion(x):
    features = materialise(FE.recovery_features(x.d), "features")
    order = F.md5(F.concat_ws(":", F.lit(str(P.SEED)), F.col("invoice_id").cast("string")))
    sample = features.orderBy(order, "invoice_id").limit(60)
    rows = C.case_queries(sample).withColumn("is_disputed", F.lit(False))
    rows = materialise(_with_vector(x, rows, "query_id", lambda k: k * 7 + 3), "queries")
    found = R.hybrid_retrieve(rows, corpus_vectors(x), exclude_self=True)
    truth = FE.with_archetype(features, x.d.customers).select("invoice_id", "archetype")
    return R.archetype_cohesion(found, rows, truth)
