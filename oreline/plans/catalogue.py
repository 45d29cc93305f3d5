"""Every registered query of the engine, and the same result as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lexicons, scoring
from ..operators import relational, store, topics
from ..sources import landed
from . import cards, ingest, stores, views  # noqa: F401 - these register their queries
from .registry import QUERIES, SQL, literal, n_contained, query  # noqa: F401
from .views import ITEMS, LABELS, items, labels, table


_B = "WITH " + ITEMS + ",\n" + LABELS + "\n"
_PASS = "(label IN ('PAIN', 'DISCUSSION') AND confidence >= 0.55 AND ((audience_fit IS NULL AND pain_intensity IS NULL AND actionability IS NULL) OR (coalesce(audience_fit, 0) >= 0.65 AND (coalesce(pain_intensity, 0) >= 0.5 OR coalesce(actionability, 0) >= 0.6))))"
_PENALTY = "(CASE WHEN contains(lower(title), 'show hn') AND label <> 'PAIN' THEN 0.25::DOUBLE ELSE 0 END + CASE WHEN source = 'rss' AND NOT has_spans THEN 0.25::DOUBLE ELSE 0 END + CASE WHEN excluded THEN 0.2::DOUBLE ELSE 0 END)"
_SCORE = f"greatest(0::DOUBLE, 0.35::DOUBLE * coalesce(audience_fit, 0)::DOUBLE + 0.3::DOUBLE * coalesce(pain_intensity, 0)::DOUBLE + 0.25::DOUBLE * coalesce(actionability, 0)::DOUBLE + 0.1::DOUBLE * confidence::DOUBLE - {_PENALTY})"


# ---- scores, filters, ranking


@query(_B + f"SELECT i.id, l.label, round({_SCORE}, 6) AS signal_score FROM v_items i JOIN v_labels l USING (id) WHERE {_PASS} ORDER BY {_SCORE} DESC, published_at DESC NULLS LAST, id LIMIT 20")
def rank_candidates(spark, sf):
    return relational.rank_candidates(items(spark, sf), labels(spark, sf), 20).select("id", "label", F.round("signal_score", 6).alias("signal_score"))


@query(_B + f"SELECT i.id, coalesce({_PASS}, false) AS passes FROM v_items i LEFT JOIN v_labels l USING (id)")
def candidate_filter(spark, sf):
    x = items(spark, sf).join(labels(spark, sf), "id", "left")
    return x.select("id", scoring.passes_filter(F.coalesce("label", F.lit("OTHER")), F.col("audience_fit"), F.col("pain_intensity"), F.col("actionability"), F.col("confidence")).alias("passes"))


@query(_B + f"SELECT i.id, round({_PENALTY}, 6) AS penalty FROM v_items i JOIN v_labels l USING (id)")
def noise_penalty(spark, sf):
    x = items(spark, sf).join(labels(spark, sf), "id")
    return x.select("id", F.round(scoring.noise_penalty(F.col("title"), F.col("label"), F.col("source"), F.col("evidence_spans"), F.col("exclude_reason")), 6).alias("penalty"))


@query(f"WITH {ITEMS} SELECT cluster, id, rank::INT AS rank FROM (SELECT cluster, id, row_number() OVER (PARTITION BY cluster ORDER BY id % 3 DESC, published_at DESC NULLS LAST, id) AS rank FROM v_items) WHERE rank <= 40")
def rank_ties(spark, sf):
    """The first forty of each cluster by a score of three values, so that ties are broken by newest, unknown times last, then id."""
    return relational.top_per_key(items(spark, sf), ["cluster"], [F.desc(F.col("id") % 3), F.desc_nulls_last("published_at"), F.col("id")], 40).select("cluster", "id", "rank")


_TURNS = f"(SELECT conv_id, turn, substring(text || ' ' || {views.said_sql('conv_id + turn')}, 1, 2000) AS text FROM conversations)"
_HITS = n_contained("text", lexicons.COMMENT_WORDS)


@query(f"SELECT conv_id, turn, rank::INT AS rank, score::INT AS score FROM (SELECT conv_id, turn, {_HITS} AS score, row_number() OVER (PARTITION BY conv_id ORDER BY {_HITS} DESC, length(text) DESC, turn) AS rank FROM {_TURNS} WHERE coalesce(text, '') <> '') WHERE rank <= 3")
def comment_rank_topk(spark, sf):
    turns = table(spark, sf, "conversations").withColumn("text", F.concat("text", F.lit(" "), views.said(F.col("conv_id") + F.col("turn"))))
    return landed.top_comments(turns, "conv_id", "text", "turn", 3).select("conv_id", "turn", "rank", F.col("score").cast("int").alias("score"))


@query("SELECT conv_id AS id, n::INT AS descendants, chars AS score FROM (SELECT conv_id, count(*) AS n, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY 1) ORDER BY n DESC, chars DESC, conv_id LIMIT 25")
def story_rank(spark, sf):
    posts = table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("id")).agg(F.count("*").cast("int").alias("descendants"), F.sum(F.length("text")).alias("score"))
    twice = posts.withColumn("ordinal", F.lit(0)).unionByName(posts.withColumn("ordinal", F.lit(1))).withColumn("type", F.lit("story"))
    return landed.top_stories(twice).select("id", "descendants", "score")


# ---- grades


@query(_B + "SELECT cluster, CASE WHEN n >= 5 AND (p >= 0.5 OR c >= 0.7) THEN 'High' WHEN n >= 2 OR p >= 0.4 OR c >= 0.5 THEN 'Med' ELSE 'Low' END AS strength FROM (SELECT cluster, count(*) AS n, avg(coalesce(pain_intensity, 0)::DOUBLE) AS p, avg(coalesce(confidence, 0)::DOUBLE) AS c FROM v_items LEFT JOIN v_labels USING (id) GROUP BY 1)")
def signal_strength(spark, sf):
    x = items(spark, sf).join(labels(spark, sf), "id", "left").groupBy("cluster").agg(F.count("*").alias("n"), F.avg(F.coalesce(F.col("pain_intensity").cast("double"), F.lit(0.0))).alias("p"), F.avg(F.coalesce(F.col("confidence").cast("double"), F.lit(0.0))).alias("c"))
    return x.select("cluster", scoring.signal_strength(F.col("n"), F.col("p"), F.col("c")).alias("strength"))


@query("SELECT o_orderkey, CASE WHEN (o_custkey % 4 >= 2 AND o_orderkey % 3 >= 1) OR contains(lower(o_orderpriority), 'urgent') THEN 'High' WHEN o_custkey % 4 >= 1 OR o_orderkey % 3 >= 2 THEN 'Med' ELSE 'Low' END AS impact, contains(lower(o_orderpriority), 'urgent') AS urgent FROM orders")
def impact(spark, sf):
    urgent = scoring.is_urgent(F.col("o_orderpriority"))
    return table(spark, sf, "orders").select("o_orderkey", scoring.impact(F.col("o_custkey") % 4, F.col("o_orderkey") % 3, urgent).alias("impact"), urgent.alias("urgent"))


# ---- joins, aggregates, sets

@query(
    """SELECT *, row_number() OVER (ORDER BY weight DESC, source_value, source_type) - 1 AS place FROM (SELECT lang AS source_type, trim(v) AS source_value, sum(CASE WHEN coalesce(w, 0) = 0 THEN 1 ELSE w END)::DOUBLE AS weight
 FROM (SELECT lang, CASE doc_id % 3 WHEN 0 THEN ' ' || source WHEN 1 THEN source || '  ' ELSE CASE WHEN doc_id % 7 = 0 THEN ' ' ELSE source END END AS v, CASE WHEN doc_id % 4 > 0 THEN doc_id % 4 * 0.25 - 0.25 END AS w FROM documents) WHERE trim(v) <> '' GROUP BY ALL)"""
)
def source_weights(spark, sf):
    """Documents as sources of their language with weights of which some are null or 0, and their places in the result's order."""
    k = F.col("doc_id")
    value = F.when(k % 3 == 0, F.concat(F.lit(" "), "source")).when(k % 3 == 1, F.concat("source", F.lit("  "))).otherwise(F.when(k % 7 == 0, " ").otherwise(F.col("source")))
    rows = table(spark, sf, "documents").select(F.col("lang").alias("source_type"), value.alias("source_value"), F.when(k % 4 > 0, k % 4 * 0.25 - 0.25).alias("weight"))
    return relational.source_weights(rows).coalesce(1).withColumn("place", F.monotonically_increasing_id())


@query("SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def interest_join(spark, sf):
    return table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")


@query(
    _B + """, u AS (SELECT cluster, url, min(id) AS o FROM v_items GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY o) AS k FROM u)
 SELECT c.cluster, size, pain, urls FROM (SELECT cluster, count(*) AS size, round(avg(coalesce(confidence, 0)::DOUBLE), 2) AS pain FROM v_items LEFT JOIN v_labels USING (id) GROUP BY 1) c JOIN (SELECT cluster, string_agg(url, ' ' ORDER BY k) AS urls FROM r WHERE k <= 5 GROUP BY 1) x USING (cluster)"""
)
def cluster_rollup(spark, sf):
    x = items(spark, sf).select("id", "cluster", "url").join(labels(spark, sf).select("id", "confidence"), "id", "left")
    sizes = x.groupBy("cluster").agg(F.count("*").alias("size"), F.round(F.avg(F.coalesce(F.col("confidence").cast("double"), F.lit(0.0))), 2).alias("pain"))
    urls = relational.first_distinct(x, ["cluster"], "url", "id", 5, "urls")
    return sizes.join(urls, "cluster", "left").select("cluster", "size", "pain", F.array_join("urls", " ").alias("urls"))


@query(_B + "SELECT c.cluster AS cluster_index, i.id, row_number() OVER (PARTITION BY c.cluster ORDER BY i.published_at DESC NULLS LAST, i.id)::INT AS position FROM (SELECT DISTINCT cluster FROM v_items) c JOIN v_items m ON m.cluster = c.cluster JOIN v_items i ON i.id = m.id")
def cluster_items_join(spark, sf):
    """Clusters, their members and the members' items, in order of cluster, then newest first."""
    x = items(spark, sf)
    clusters, members = x.select("cluster").distinct(), x.select("cluster", "id")
    joined = clusters.join(members, "cluster").join(x.drop("cluster"), "id")
    return joined.select(F.col("cluster").alias("cluster_index"), "id", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc_nulls_last("published_at"), "id")).cast("int").alias("position"))


@query(_B + "SELECT i.id FROM v_items i LEFT JOIN v_labels l USING (id) WHERE i.source = 'rss' OR l.label = 'NEWS'")
def catalyst_inputs(spark, sf):
    x = items(spark, sf).select("id", "source").join(labels(spark, sf).select("id", "label"), "id", "left")
    return x.where((F.col("source") == "rss") | (F.col("label") == "NEWS")).select("id")


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def labels_semi(spark, sf):
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left_semi")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def docs_anti(spark, sf):
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left_anti")


@query("SELECT doc_id FROM documents WHERE doc_id % 2 = 0 UNION SELECT doc_id FROM labels")
def set_union(spark, sf):
    return table(spark, sf, "documents").where("doc_id % 2 = 0").select("doc_id").union(table(spark, sf, "labels").select("doc_id")).distinct()


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels WHERE toxic = 1")
def set_diff(spark, sf):
    return table(spark, sf, "documents").select("doc_id").subtract(table(spark, sf, "labels").where("toxic = 1").select("doc_id"))


@query("SELECT min(doc_id) AS doc_id FROM documents GROUP BY text")
def dedupe_first(spark, sf):
    # two hashes name a text, so only narrow keys move
    return table(spark, sf, "documents").groupBy(F.xxhash64("text"), F.hash("text")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@query("SELECT lower(p_name) AS theme, min(p_partkey) AS p_partkey FROM part GROUP BY 1")
def dedupe_theme_ci(spark, sf):
    first = relational.first_per_key(table(spark, sf, "part").withColumn("theme", F.lower("p_name")), ["theme"], [F.col("p_partkey")])
    return first.select("theme", "p_partkey")


@query("SELECT l_returnflag AS source, count(*) AS n FROM lineitem GROUP BY 1")
def source_counts(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("source")).agg(F.count("*").alias("n"))


# ---- data changes

_OLD = "SELECT o_orderkey AS k, o_custkey AS url, o_totalprice AS score, o_orderstatus AS s FROM orders WHERE o_orderkey % 3 <> 0"
_NEW = "SELECT o_orderkey AS k, -o_custkey AS url, CASE WHEN o_orderkey % 5 <> 0 THEN -o_totalprice END AS score, 'N' AS s FROM orders WHERE o_orderkey % 2 = 0"


def _old_new(spark, sf):
    o = table(spark, sf, "orders")
    old = o.where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("url"), F.col("o_totalprice").alias("score"), F.col("o_orderstatus").alias("s"))
    new = o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("k"), (-F.col("o_custkey")).alias("url"), F.when(F.col("o_orderkey") % 5 != 0, -F.col("o_totalprice")).alias("score"), F.lit("N").alias("s"))
    return old, new


@query(f"WITH a AS ({_OLD}), b AS ({_NEW}) SELECT k, coalesce(a.url, b.url) AS url, CASE WHEN b.k IS NULL THEN a.score ELSE coalesce(b.score, a.score) END AS score, coalesce(b.s, a.s) AS s FROM a FULL JOIN b USING (k)")
def upsert_items(spark, sf):
    return store.upsert(*_old_new(spark, sf), ["k"], {"url": "old", "score": "coalesce", "s": "new"})


@query(f"WITH a AS ({_OLD}), b AS ({_NEW}) SELECT k, url, score, s FROM a UNION ALL SELECT k, url, score, s FROM b WHERE k NOT IN (SELECT k FROM a)")
def insert_ignore(spark, sf):
    return store.insert_ignore(*_old_new(spark, sf), ["k"])


@query(f"WITH a AS ({_OLD}), b AS ({_NEW}) SELECT k, a.url, coalesce(b.score, a.score) AS score, a.s FROM a LEFT JOIN b USING (k)")
def update_evidence(spark, sf):
    old, new = _old_new(spark, sf)
    return store.update_column(old, new, "k", "score")


@query(f"WITH a AS ({_OLD}), b AS ({_NEW}) SELECT * FROM a WHERE s <> 'O' UNION ALL SELECT k, url, score, 'O' AS s FROM b")
def replace_date(spark, sf):
    old, new = _old_new(spark, sf)
    return store.replace_partition(old, new.withColumn("s", F.lit("O")), "s", "O")


@query("SELECT event_id, value FROM events WHERE ts::DATE = (SELECT max(ts)::DATE FROM events) - 1")
def previous_day(spark, sf):
    e = table(spark, sf, "events")
    day = e.agg(F.date_sub(F.max("ts").cast("date"), 1).alias("d"))
    return e.join(F.broadcast(day), F.col("ts").cast("date") == F.col("d")).select("event_id", "value")


@query("SELECT vec_id, label FROM embeddings WHERE vec_id IN (1, 5, 9, 400, -3)")
def key_lookup(spark, sf):
    return table(spark, sf, "embeddings").where(F.col("vec_id").isin(1, 5, 9, 400, -3)).select("vec_id", "label")


# ---- topics


_STOP = topics.STOP_WORDS


@query(
    f"""WITH d AS (SELECT doc_id, (doc_id % 15)::INT AS g, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda w: NOT list_contains({literal(_STOP)}, w)) AS ws FROM documents),
 t AS (SELECT g, doc_id, unnest(ws) AS term FROM d UNION ALL SELECT g, doc_id, ws[i] || ' ' || ws[i + 1] FROM (SELECT g, doc_id, ws, unnest(range(1, len(ws))) AS i FROM d WHERE len(ws) > 1)),
 v AS (SELECT g, term FROM (SELECT g, term, row_number() OVER (PARTITION BY g ORDER BY k DESC, term) AS r FROM (SELECT g, term, count(*) AS k FROM t GROUP BY ALL)) WHERE r <= 200),
 c AS (SELECT g, doc_id, term, count(*) AS n FROM t JOIN v USING (g, term) GROUP BY ALL), f AS (SELECT g, term, count(*) AS df FROM c GROUP BY ALL), m AS (SELECT g, count(DISTINCT doc_id) AS docs FROM d GROUP BY 1),
 w AS (SELECT g, doc_id, term, n * (ln((1 + docs) / (1 + df)::DOUBLE) + 1) AS w FROM c JOIN f USING (g, term) JOIN m USING (g)),
 x AS (SELECT g, term, w / sqrt(sum(w * w) OVER (PARTITION BY g, doc_id)) AS w FROM w), s AS (SELECT g, term, round(sum(w), 6) AS score FROM x GROUP BY ALL)
 SELECT g AS cluster, term, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY score DESC, term) AS rank FROM s) WHERE rank <= 5"""
)
def tfidf_top_terms(spark, sf):
    d = table(spark, sf, "documents").withColumn("cluster", (F.col("doc_id") % 15).cast("int"))
    return topics.top_terms(d, "cluster", "doc_id", "text", stop=_STOP).select("cluster", "term", "score", "rank")


@query(
    """WITH e AS (SELECT vec_id, CASE WHEN label >= 8 THEN 100 + vec_id ELSE label END::BIGINT AS cluster, embedding FROM embeddings), l AS (SELECT vec_id, cluster, unnest(range(len(embedding))) AS dim, unnest(embedding)::DOUBLE AS x FROM e),
 c AS (SELECT cluster, dim, avg(x) AS c FROM l WHERE cluster < 100 GROUP BY ALL), k AS (SELECT vec_id, c.cluster, sum(x * c) / (sqrt(sum(x * x)) * sqrt(sum(c * c))) AS cosine FROM l JOIN c USING (dim) WHERE l.cluster >= 100 GROUP BY ALL)
 SELECT vec_id, cluster FROM e WHERE cluster < 100 UNION ALL SELECT vec_id, cluster FROM (SELECT vec_id, cluster, row_number() OVER (PARTITION BY vec_id ORDER BY cosine DESC, cluster) AS r FROM k) WHERE r = 1"""
)
def orphan_reassign(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("cluster", F.when(F.col("label") >= 8, 100 + F.col("vec_id")).otherwise(F.col("label")).cast("long"))
    return topics.reassign_orphans(e, "vec_id", "cluster", "embedding")


def _kmeans_sql(points: str, starts: int = 10, rounds: int = 20) -> str:
    """k-means over a list ``points`` (id, v) of vectors: ten starts drawn by hashes, advanced together, the cheapest one's clusters by least id, single rows placed."""
    far = "(CASE WHEN list_distance(p.v, c) < sqrt(1e-9) THEN 0 ELSE pow(list_distance(p.v, c), 2) END)"
    x = "((p.id % 2147483647 * 31 + s.start * 7919 + {step} * 104729 + 12345) % 2147483647)"
    key = f"({x} * {x} % 2147483647 * ({x} * {x} % 2147483647) % 2147483647 * {x} % 2147483647 + 0.5) / 2147483647::DOUBLE"
    near = "list_position(list_transform(ds, lambda d: round(d, 9)), round(list_min(ds), 9))"
    return f"""points AS MATERIALIZED ({points}), sized AS (SELECT least(greatest(1, count(*) // 3), count(*), 15) AS k FROM points), starts AS (SELECT unnest(range({starts})) AS start),
 seeds AS (
  SELECT s.start, 1 AS n, [arg_min(p.v, {{'key': -ln({key.format(step=0)}), 'id': p.id}})] AS cs FROM starts s, points p GROUP BY s.start
  UNION ALL
  SELECT s.start, s.n + 1, list_append(any_value(s.cs), arg_min(p.v, {{'key': CASE WHEN s.d > 0 THEN -ln({key.format(step='s.n')}) / s.d ELSE 'inf'::DOUBLE END, 'id': p.id}}))
  FROM (SELECT s.start, s.n, s.cs, p.id, list_min(list_transform(s.cs, lambda c: {far})) AS d FROM seeds s, points p, sized WHERE s.n < sized.k) s JOIN points p USING (id) GROUP BY s.start, s.n
 ), runs AS (
  SELECT start, 0 AS n, cs FROM seeds, sized WHERE n = sized.k
  UNION ALL
  (WITH own AS MATERIALIZED (SELECT start, n, cs, v, {near} AS c FROM (SELECT r.start, r.n, r.cs, p.v, list_transform(r.cs, lambda c: {far}) AS ds FROM runs r, points p WHERE r.n < {rounds})),
   means AS (SELECT start, c, list(x ORDER BY i) AS m FROM (SELECT start, c, i, avg(v[i]) AS x FROM (SELECT start, c, v, unnest(range(1, len(v) + 1)) AS i FROM own) GROUP BY ALL) GROUP BY ALL),
   each AS (SELECT DISTINCT start, n, cs FROM own)
   SELECT start, n + 1, list(coalesce(m, old) ORDER BY c) FROM (SELECT start, n, unnest(range(1, len(cs) + 1)) AS c, unnest(cs) AS old FROM each) LEFT JOIN means USING (start, c) GROUP BY start, n)
 ), last AS (SELECT start, id, v, ds, {near} AS c FROM (SELECT r.start, p.id, p.v, list_transform(r.cs, lambda c: {far}) AS ds FROM runs r, points p WHERE r.n = {rounds})),
 best AS (SELECT start FROM last GROUP BY start ORDER BY round(sum(list_min(ds)), 6), start LIMIT 1),
 found AS (SELECT id, v, dense_rank() OVER (ORDER BY first) - 1 AS cluster FROM (SELECT id, v, min(id) OVER (PARTITION BY c) AS first FROM last WHERE start = (SELECT start FROM best))),
 counted AS (SELECT *, count(*) OVER (PARTITION BY cluster) AS n FROM found),
 middle AS (SELECT cluster, list(x ORDER BY i) AS m FROM (SELECT cluster, i, avg(v[i]) AS x FROM (SELECT cluster, v, unnest(range(1, len(v) + 1)) AS i FROM counted WHERE n > 1) GROUP BY ALL) GROUP BY ALL),
 placed AS (SELECT a.id, arg_min(b.cluster, {{'far': -coalesce(list_inner_product(a.v, b.m) / nullif(sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.m, b.m)), 0), 0), 'c': b.cluster}}) AS cluster FROM counted a, middle b WHERE a.n = 1 GROUP BY a.id)
 SELECT id, cluster::INT AS cluster FROM counted WHERE n > 1 UNION ALL SELECT id, cluster::INT FROM placed"""


@query("WITH RECURSIVE " + _kmeans_sql("SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings"))
def kmeans_embeddings(spark, sf):
    return topics.kmeans(table(spark, sf, "embeddings"), "vec_id", "embedding")


_TFIDF = f"""d AS (SELECT doc_id, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda w: NOT list_contains({literal(_STOP)}, w)) AS ws FROM documents),
 t AS (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest(ws) AS term FROM d UNION ALL SELECT doc_id, ws[i] || ' ' || ws[i + 1] FROM (SELECT doc_id, ws, unnest(range(1, len(ws))) AS i FROM d WHERE len(ws) > 1)) GROUP BY ALL),
 vocabulary AS (SELECT term, row_number() OVER (ORDER BY sum(n) DESC, term) AS place, count(*) AS df FROM t GROUP BY term ORDER BY sum(n) DESC, term LIMIT 500),
 w AS (SELECT doc_id, place, n * (ln((1 + (SELECT count(*) FROM d)) / (1 + df)::DOUBLE) + 1) AS w FROM t JOIN vocabulary USING (term)),
 grid AS (SELECT doc_id, place, coalesce(w.w, 0) AS w FROM (SELECT doc_id, place FROM d, vocabulary) LEFT JOIN w USING (doc_id, place)),
 vectors AS (SELECT doc_id AS id, list(w / CASE WHEN length > 0 THEN length ELSE 1 END ORDER BY place) AS v FROM (SELECT *, sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS length FROM grid) GROUP BY doc_id)"""


@query("WITH RECURSIVE " + _TFIDF + ", " + _kmeans_sql("SELECT id, v FROM vectors"))
def kmeans_tfidf(spark, sf):
    vectors = topics.tfidf_vectors(table(spark, sf, "documents"), "doc_id", "text", stop=topics.english_stop_words())
    return topics.kmeans(vectors, "doc_id", "features")


# ---- answers, fallbacks


@query("SELECT event_id, (props::JSON ->> 'k')::INT AS k FROM events")
def json_props(spark, sf):
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query(_B + "SELECT id, coalesce(label IN ('PAIN', 'DISCUSSION') AND row_number() OVER (PARTITION BY label IN ('PAIN', 'DISCUSSION') ORDER BY id) <= 20, false) AS featured FROM v_labels")
def gate_fallback(spark, sf):
    return relational.gate_fallback(labels(spark, sf).select("id", "label", F.col("id").alias("ordinal"))).select("id", "featured")


@query(f"SELECT count(*) AS n, sum(length(title))::BIGINT AS chars FROM (WITH {ITEMS} SELECT * FROM v_items)")
def report_totals(spark, sf):
    return items(spark, sf).agg(F.count("*").alias("n"), F.sum(F.length("title")).alias("chars"))
