"""Top terms by TF-IDF, k-means clusters, and orphans moved to the nearest cluster."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import work

TOKEN = r"[\p{L}\p{N}_]{2,}"


def tokens_of(text: str, stop: list[str] | None = None) -> Column:
    """Lower-case words of two characters or more, without stop words."""
    tokens = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), 0)
    return F.filter(tokens, lambda t: ~t.isin(stop)) if stop else tokens


def pairs_of(tokens: Column) -> Column:
    """Pairs of neighbouring tokens."""
    made = F.zip_with(F.slice(tokens, 1, F.size(tokens) - 1), F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.when(F.size(tokens) > 1, made).otherwise(F.array().cast("array<string>"))


def pairs_among(tokens: str, some: list[str]) -> Column:
    """Pairs of neighbours of a column of tokens of which both are among some; as SQL text, since each literal is a call to the JVM otherwise."""
    listed = ", ".join(f"'{w}'" for w in some)  # words have no quotes
    pair = f"(a, b) -> CASE WHEN a IN ({listed}) AND b IN ({listed}) THEN concat(a, ' ', b) END"
    return F.expr(f"CASE WHEN size({tokens}) > 1 THEN array_compact(zip_with(slice({tokens}, 1, size({tokens}) - 1), slice({tokens}, 2, size({tokens}) - 1), {pair})) ELSE CAST(array() AS ARRAY<STRING>) END")


def terms_of(text: str, stop: list[str] | None = None) -> Column:
    """Words and pairs of neighbouring words; stop words go before pairs are formed."""
    tokens = tokens_of(text, stop)
    return F.concat(tokens, pairs_of(tokens))


#: Common English words, as a search engine leaves them out.
STOP_WORDS = (
    "a about above after again all also am an and any are as at be because been before being below between both but by can could did do does doing down during each else ever every few for from further get had has have having he her here hers "
    "herself him himself his how however if in into is it its itself just least less many may me might more most much must my myself neither no nor not now of off often on once one only or other others our ours ourselves out over own per "
    "perhaps please rather same seem she should since so some still such than that the their theirs them themselves then there these they this those though through thus to together too under until up upon us very via was we well were what "
    "when where whether which while who whom whose why will with within without would yet you your yours yourself yourselves"
).split()


def english_stop_words() -> list[str]:
    return STOP_WORDS


def tfidf_vectors(docs: DataFrame, doc: str, text: str, features: int = 500, stop: list[str] | None = None) -> DataFrame:
    """(doc, features): sparse vectors of the weights of ``tfidf`` over the most frequent terms of the whole table, ties to the lesser term.  Zero where a text has none of them.

    As in ``top_terms`` only pairs of words that are frequent themselves (with ties) are counted, unless ties make
    these words too many for a plan.
    """
    from pyspark.ml.feature import IDF, CountVectorizerModel, ElementwiseProduct, Normalizer
    from pyspark.ml.linalg import Vectors

    tokens = work.kept(docs.select(doc, tokens_of(text, stop).alias("_w")))  # read for words, pairs and weights
    count = lambda column: tokens.select(F.explode_outer(column).alias("term")).where("term IS NOT NULL").groupBy("term").agg(F.count("*").alias("n"))
    words = work.kept(count(F.col("_w")))
    least = words.orderBy(F.desc("n")).limit(features).agg(F.min("n").alias("n")).first()["n"]
    if least is None:
        return tokens.select(doc, F.lit(None).alias("features")).where("false")
    often = [r["term"] for r in words.where(F.col("n") >= least).select("term").limit(MOST_WORDS + 1).collect()]
    pairs = pairs_among("_w", often) if len(often) <= MOST_WORDS else pairs_of(F.col("_w"))
    vocabulary = [r["term"] for r in words.unionByName(count(pairs)).orderBy(F.desc("n"), "term").limit(features).collect()]
    counted = CountVectorizerModel.from_vocabulary(vocabulary, "_terms", "_tf")
    tf = work.kept(counted.transform(tokens.select(doc, F.concat("_w", pairs).alias("_terms"))).select(doc, "_tf"))
    idf = IDF(inputCol="_tf", outputCol="_idf").fit(tf).idf
    weighted = ElementwiseProduct(scalingVec=Vectors.dense(idf.toArray() + 1), inputCol="_tf", outputCol="_w").transform(tf)
    return Normalizer(inputCol="_w", outputCol="features").transform(weighted).select(doc, "features")


#: Frequent words written into a plan, and weights (groups times terms) that every task holds.
MOST_WORDS, MOST_WEIGHTS = 20_000, 1_000_000


def top_terms(docs: DataFrame, group: str, doc: str, text: str, k: int = 5, stop: list[str] | None = None, features: int = 200) -> DataFrame:
    """(group, term, score, rank): the k terms with the largest sum of TF-IDF weights in each group; every row is a document of its own.

    A group's vocabulary are its ``features`` most frequent terms, ties to the lesser.  Weights are
    n (ln((1 + docs) / (1 + df)) + 1), scaled to length 1 per document.

    A pair is no more frequent than its words, so only pairs of a group's ``features`` most frequent words (with
    ties) can be in its vocabulary, and only those are counted; words and these pairs move as partial sums.  With the
    vocabulary known, terms are counted and weighed inside the row.  Where the frequent words are too many for a plan,
    or the vocabularies of all groups for a task, ``top_terms_by_shuffle`` gives the same.
    """
    from pyspark.ml.feature import CountVectorizerModel

    tokens = docs.select(group, tokens_of(text, stop).alias("_w"))
    size = tokens.groupBy(group).agg(F.count("*").alias("docs"))
    # explode_outer: for explode Spark tests the size of the array first, which works it out twice
    count = lambda column: tokens.select(group, F.explode_outer(column).alias("term")).where("term IS NOT NULL").groupBy(group, "term").agg(F.count("*").alias("n"))
    often = Window.partitionBy(group).orderBy(F.desc("n"))
    frequent = work.kept(count(F.col("_w")).withColumn("place", F.rank().over(often)).where(F.col("place") <= features).drop("place"))
    words = [r["term"] for r in frequent.select("term").distinct().limit(MOST_WORDS + 1).collect()]
    if len(words) > MOST_WORDS or size.count() ** 2 * features > MOST_WEIGHTS:
        return top_terms_by_shuffle(docs, group, doc, text, k, stop, features)
    pairs = pairs_among("_w", words) if words else F.array().cast("array<string>")
    every = frequent.unionByName(count(pairs))
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), "term"))
    chosen = work.kept(every.withColumn("place", place).where(F.col("place") <= features).select(group, "term"))
    vocabulary = sorted({r["term"] for r in chosen.collect()})  # features of each group at most
    if not vocabulary:
        return chosen.select(group, "term", F.lit(0.0).alias("score"), F.lit(1).alias("rank"))
    model = CountVectorizerModel.from_vocabulary(vocabulary, "_t", "_tf")
    tf = model.transform(tokens.select(group, F.concat("_w", pairs).alias("_t"))).select(group, F.unwrap_udt("_tf").alias("v"))
    tf = work.kept(tf.select(group, F.arrays_zip(F.col("v.indices").alias("at"), F.col("v.values").alias("n")).alias("bag")))
    known = docs.sparkSession.createDataFrame(list(enumerate(vocabulary)), "at int, term string")
    places = chosen.join(F.broadcast(known), "term")
    df = tf.select(group, F.explode("bag.at").alias("at")).groupBy(group, "at").agg(F.count("*").alias("df"))
    idf = places.join(df, [group, "at"]).join(size, group).select(group, "at", (F.log((1 + F.col("docs")) / (1 + F.col("df"))) + 1).alias("idf"))
    by_place = F.map_from_entries(F.collect_list(F.struct("at", "idf")))
    dense = idf.groupBy(group).agg(by_place.alias("m")).select(group, F.transform(F.sequence(F.lit(0), F.lit(len(vocabulary) - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("idf"))
    weighed = tf.join(F.broadcast(dense), group).select(group, F.filter(F.transform("bag", lambda x: F.struct(x["at"].alias("at"), (x["n"] * F.get("idf", x["at"])).alias("w"))), lambda x: x["w"] > 0).alias("bag"))
    length = F.sqrt(F.aggregate("bag", F.lit(0.0), lambda s, x: s + x["w"] * x["w"]))
    sums = weighed.withColumn("length", length).select(group, "length", F.explode("bag").alias("x")).groupBy(group, F.col("x.at").alias("at")).agg(F.round(F.sum(F.col("x.w") / F.col("length")), 6).alias("score"))
    named = sums.join(F.broadcast(known), "at").select(group, "term", "score")
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("score"), "term"))
    return named.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k)


def top_terms_by_shuffle(docs: DataFrame, group: str, doc: str, text: str, k: int = 5, stop: list[str] | None = None, features: int = 200) -> DataFrame:
    """``top_terms`` for any number of groups, for documents with ids of their own.

    Only rows of the vocabulary are weighted; the large shuffles are the counts per document and, summed before they
    move, those per group.
    """
    size = docs.groupBy(group).agg(F.countDistinct(doc).alias("docs"))
    # counted once: both uses below read the same exchange
    every = docs.select(group, doc, F.explode(terms_of(text, stop)).alias("term")).groupBy(group, doc, "term").agg(F.count("*").alias("n"))
    often = every.groupBy(group, "term").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), "term"))
    chosen = often.withColumn("place", place).where(F.col("place") <= features).select(group, "term")
    counts = every.join(chosen, [group, "term"])
    held = counts.groupBy(group, doc).agg(F.collect_list(F.struct("term", "n")).alias("bag"))
    df = held.select(group, F.explode("bag.term").alias("term")).groupBy(group, "term").agg(F.count("*").alias("df")).join(size, group)
    weight = df.select(group, "term", (F.log((1 + F.col("docs")) / (1 + F.col("df"))) + 1).alias("idf")).groupBy(group).agg(F.map_from_entries(F.collect_list(F.struct("term", "idf"))).alias("idf"))
    weighed = held.join(weight, group).select(group, F.transform("bag", lambda x: F.struct(x["term"].alias("term"), (x["n"] * F.element_at("idf", x["term"])).alias("w"))).alias("bag"))
    length = F.sqrt(F.aggregate("bag", F.lit(0.0), lambda s, x: s + x["w"] * x["w"]))
    sums = weighed.withColumn("length", length).select(group, "length", F.explode("bag").alias("x")).groupBy(group, F.col("x.term").alias("term")).agg(F.round(F.sum(F.col("x.w") / F.col("length")), 6).alias("score"))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("score"), "term"))
    return sums.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k)


def n_clusters(rows: int, most: int = 15) -> int:
    return min(max(1, rows // 3), rows, most)


#: A prime: hashes of rows are numbers below it.  Its predecessor has no factor 5, so a fifth power keeps different numbers apart.
_RACE = 2_147_483_647


def race_key(number, start, step, far):
    """The key by which a centre is drawn: of all rows the least wins, with a chance in proportion to ``far``.  Whole numbers only, so that SQL can say the same."""
    x = (number % _RACE * 31 + start * 7919 + step * 104729 + 12345) % _RACE
    square = x * x % _RACE
    x = square * square % _RACE * x % _RACE
    with np.errstate(divide="ignore"):
        return np.where(far > 0, -np.log((x + 0.5) / _RACE) / far, np.inf)


def _distances(v: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances (start, row, centre), by products; those below 1e-9 are 0."""
    flat = centres.reshape(-1, centres.shape[-1])
    far = (v**2).sum(axis=1)[:, None] - 2 * v @ flat.T + (flat**2).sum(axis=1)[None]
    return np.where(far < 1e-9, 0, far).reshape(len(v), len(centres), -1).transpose(1, 0, 2)


def _nearest(far: np.ndarray) -> np.ndarray:
    """The nearest centre of each row, ties to the first.  Vectors without a common term are all equally far, so distances count to nine digits."""
    return np.round(far, 9).argmin(axis=-1)


def _packed(data: DataFrame) -> DataFrame:
    """The column v as the bytes of its doubles: a vector then moves to Python as one value."""

    def pack(batches):
        for batch in batches:
            flat = batch.column("v").flatten().to_numpy(zero_copy_only=False)
            rows = np.ascontiguousarray(flat.reshape(batch.num_rows, -1)) if batch.num_rows else ()
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("number"), pa.array([r.tobytes() for r in rows], pa.binary())], ["id", "number", "v"])

    return data.mapInArrow(pack, f"id {data.schema['id'].dataType.simpleString()}, number long, v binary")


def _vectors(batch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("v").to_pylist())).reshape(batch.num_rows, -1)


def _parts(batches):
    """Batches of 512 rows at most."""
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            yield batch.slice(at, 512)


def _seed(data: DataFrame, starts: int, k: int) -> np.ndarray:
    """Centres (start, centre, dimension) by k-means++: each next one is drawn with a chance in proportion to the squared distance from those before.  All starts draw together, by one aggregate a centre."""
    centres = None
    for step in range(k):

        def race(batches, centres=centres, step=step):
            best = {}
            for part in _parts(batches):
                v, number = _vectors(part), part.column("number").to_numpy()
                far = np.ones((starts, len(v))) if centres is None else _distances(v, centres).min(axis=2)
                for s in range(starts):
                    key = race_key(number, s, step, far[s])
                    least = np.flatnonzero(key == key.min())
                    i = least[number[least].argmin()]
                    if s not in best or (key[i], number[i]) < best[s][:2]:
                        best[s] = (key[i], number[i], v[i].copy())
            if best:
                yield pa.RecordBatch.from_arrays([pa.array(list(best), pa.int32())] + [pa.array([b[j] for b in best.values()], t) for j, t in ((0, pa.float64()), (1, pa.int64()), (2, pa.list_(pa.float64())))], ["start", "key", "number", "v"])

        drawn = data.mapInArrow(race, "start int, key double, number long, v array<double>").groupBy("start").agg(F.min_by("v", F.struct("key", "number")).alias("v")).collect()
        new = np.array([r["v"] for r in sorted(drawn)])[:, None, :]
        centres = new if centres is None else np.concatenate([centres, new], axis=1)
    return centres


def _advance(data: DataFrame, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The next centres and the cost of these, for all starts by one aggregate; a centre without rows stays."""
    starts, k, _ = centres.shape

    def sums(batches):
        total, n, cost = np.zeros_like(centres), np.zeros((starts, k)), np.zeros(starts)
        for part in _parts(batches):
            v = _vectors(part)
            far = _distances(v, centres)
            cost += far.min(axis=2).sum(axis=1)
            # sums of rows as a product: (start, centre) by row, 1 where the row is the centre's
            own = np.zeros((starts, k, len(v)))
            np.put_along_axis(own, _nearest(far)[:, None, :], 1, axis=1)
            total += (own.reshape(starts * k, -1) @ v).reshape(total.shape)
            n += own.sum(axis=2)
        row = np.concatenate([total, n[:, :, None], np.repeat(cost[:, None, None], k, axis=1)], axis=2)
        s, c = np.indices(row.shape[:2])
        yield pa.RecordBatch.from_arrays([pa.array(s.ravel().astype(np.int32)), pa.array(c.ravel().astype(np.int32)), pa.array([x.tobytes() for x in row.reshape(starts * k, -1)], pa.binary())], ["s", "c", "v"])

    def added(batches):
        sums_of = {}
        for batch in batches:
            for s, c, x in zip(batch.column("s").to_pylist(), batch.column("c").to_pylist(), _vectors(batch), strict=True):
                sums_of[s, c] = sums_of.get((s, c), 0) + x
        if sums_of:
            yield pa.RecordBatch.from_arrays([pa.array([key[j] for key in sums_of], pa.int32()) for j in (0, 1)] + [pa.array([x.tobytes() for x in sums_of.values()], pa.binary())], ["s", "c", "v"])

    # sums of a task, starts times k rows, meet by centre
    schema = "s int, c int, v binary"
    rows = data.mapInArrow(sums, schema).repartition("s", "c").mapInArrow(added, schema).collect()
    out = np.zeros((starts, k, centres.shape[2] + 2))
    for r in rows:
        out[r["s"], r["c"]] = np.frombuffer(r["v"])
    n = out[:, :, -2:-1]
    return np.where(n > 0, out[:, :, :-2] / np.maximum(n, 1), centres), out[:, 0, -1]


def kmeans(df: DataFrame, id_col: str, vec_col: str, k: int | None = None, starts: int = 10, rounds: int = 20, least: int = 2) -> DataFrame:
    """(id, cluster): the cheapest of several k-means runs from k-means++ centres, all advanced together until none moves, ``rounds`` at most.

    The draws are by a hash of the id, so a table gives the same clusters whatever its partitions.  Clusters are
    numbered by their least id; members of those below ``least`` rows then join the nearest kept one.  One cluster
    each if there are no more rows than clusters.  Only centres (starts times k vectors) reach the driver.
    """
    own = F.col(id_col)
    number = F.crc32(own.cast("string").cast("binary")) if df.schema[id_col].dataType.typeName() == "string" else own.cast("long")
    vector = F.col(vec_col) if df.schema[vec_col].dataType.typeName() == "array" else vector_to_array(vec_col)
    data = work.kept(_packed(df.select(own.alias("id"), F.pmod(number, F.lit(_RACE)).cast("long").alias("number"), vector.cast("array<double>").alias("v"))))
    n = data.count()
    k = k or n_clusters(n)
    if n < 2 or k >= n:
        return data.select("id", (F.row_number().over(Window.orderBy("id")) - 1).cast("int").alias("cluster"))
    centres = _seed(data, starts, k)
    for _ in range(rounds):
        moved, _ = _advance(data, centres)
        if (moved == centres).all():
            break
        centres = moved
    _, cost = _advance(data, centres)
    best = centres[int(np.argmin(np.round(cost, 6)))][None]

    def assign(batches):
        for part in _parts(batches):
            v = _vectors(part)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(list(v), pa.list_(pa.float64())), pa.array(_nearest(_distances(v, best)[0]).astype(np.int32))], ["id", "v", "found"])

    kind = data.schema["id"].dataType.simpleString()
    found = work.kept(data.mapInArrow(assign, f"id {kind}, v array<double>, found int"))
    named = found.groupBy("found").agg(F.min("id").alias("first")).select("found", (F.row_number().over(Window.orderBy("first")) - 1).cast("int").alias("cluster"))  # k rows
    out = found.join(F.broadcast(named), "found").select("id", "cluster", "v")
    return reassign_orphans(out, "id", "cluster", "v", least).select("id", F.col("cluster").cast("int").alias("cluster"))


def reassign_orphans(df: DataFrame, id_col: str, cluster: str, vec_col: str, least: int = 2, most: int = 1000) -> DataFrame:
    """(id, cluster): members of clusters below ``least`` rows move to the kept centroid of greatest cosine, ties to the smaller cluster.  With none kept all share cluster 0.

    Up to ``most`` centroids, as k-means makes them, meet the orphans as one broadcast row of arrays, so no vector is
    taken apart or moved; more of them come in blocks of that size, without a broadcast.
    """
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer

    rows = df.select(id_col, cluster, F.col(vec_col).cast("array<double>").alias("v"))
    means = rows.groupBy(cluster).agg(F.count("*").alias("n"), Summarizer.mean(array_to_vector("v")).alias("c"))
    kept = means.where(F.col("n") >= least).select(cluster, vector_to_array("c").alias("c"))
    sized = rows.join(means.select(cluster, "n"), cluster)
    orphans = sized.where(F.col("n") < least).select(id_col, "v")
    few = kept.count() <= most
    blocks = kept.withColumn("block", F.floor((F.row_number().over(Window.orderBy(cluster)) - 1) / most)).groupBy("block").agg(F.collect_list(F.struct(F.col(cluster).alias("k"), "c")).alias("all"))
    near = F.transform("all", lambda x: F.struct((-F.coalesce(cosine(F.col("v"), x["c"]), F.lit(0.0))).alias("far"), x["k"].alias("k")))
    best = orphans.join(F.broadcast(blocks) if few else blocks, how="left").select(id_col, F.array_min(near).alias("best")).groupBy(id_col).agg(F.min("best").alias("best"))
    placed = best.select(id_col, F.coalesce("best.k", F.lit(0)).alias(cluster))
    return sized.where(F.col("n") >= least).select(id_col, cluster).unionByName(placed)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def cluster_posts(posts: DataFrame, id_col: str, text: str, vectors: DataFrame | None = None, vec_col: str = "embedding") -> DataFrame:
    """(id, cluster) of posts: by their vectors if every post has one, else by TF-IDF; single rows join the nearest cluster."""
    if vectors is not None:
        both = posts.select(id_col).join(vectors.select(id_col, vec_col), id_col, "left")
        if both.where(F.col(vec_col).isNull()).limit(1).count() == 0:
            return kmeans(both, id_col, vec_col)
    return kmeans(tfidf_vectors(posts, id_col, text, stop=english_stop_words()), id_col, "features")
