"""Queries over vectors, fixed tables, synthetic data and small networks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.functions import numeric as nm
from corpusloom.operators import learning, ranks, vectors
from corpusloom.sources import static
from corpusloom.sources.tables import table

WIDTH, BYTES = 6144, 2


def nearest_vectors(spark, sf_dir):
    """The three most similar other vectors of every vector whose id 50 divides, of all."""
    return vectors.top_k(table(spark, sf_dir, "embeddings"), queries=F.col("vec_id") % 50 == 0).select("query_id", "rank", "vec_id", F.round("s", 5).alias("similarity"))


def projections(spark, sf_dir):
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(nm.first_two(e)[0], 6).alias("x"), F.round(nm.first_two(e)[1], 6).alias("y"), F.round(F.sqrt(nm.dot(e, e)), 5).alias("norm"), F.array_join(nm.one_hot(F.col("label"), 10).cast("array<string>"), "").alias("one_hot"))


def vocabulary_costs(spark, sf_dir):
    options = static.vocabulary_options(spark)
    base = F.first("fertility").over(Window.partitionBy(F.lit(0)).orderBy("vocab"))
    params = F.col("vocab").cast("bigint") * WIDTH
    verdict = F.element_at(F.create_map(*[F.lit(x) for kv in (("32K", "too small"), ("64K", "weak coverage"), ("96K", "slightly small"), ("128K", "best balance"), ("160K", "little gain"), ("256K", "costly")) for x in kv]), F.col("label"))
    return options.select("label", params.alias("params"), F.round(params / 1e6, 4).alias("params_m"), F.round(params * BYTES / 1e9, 6).alias("gb"), F.round(base / F.col("fertility") * 100, 6).alias("efficiency"), F.coalesce("recommended", F.lit(False)).alias("recommended"), verdict.alias("verdict"))


def recommended_vocabulary(spark, sf_dir):
    return static.vocabulary_options(spark).where("recommended").orderBy("vocab").limit(1)


def fertility_ranking(spark, sf_dir):
    got = static.fertility_targets(spark).withColumn("position", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("target", "ordinal")))
    return got.select("position", "domain", "category", "target", F.round(100 - (F.col("target") - 1.0) / 0.3 * 100, 6).alias("compression"))


def mix_shares(spark, sf_dir):
    mix = static.data_mix(spark)
    return mix.withColumn("labelled", F.col("share") >= 10).withColumn("total", F.sum("share").over(Window.partitionBy(F.lit(0))))


def benchmark_list(spark, sf_dir):
    return static.benchmark_groups(spark).select("title", F.posexplode("benchmarks").alias("pos", "name"))


def stage_list(spark, sf_dir):
    return static.stages(spark)


def _drawn(spark, n: int):
    """(pos, tokens) of n sentences drawn with replacement."""
    drawn = spark.range(n).select(F.col("id").alias("pos"), F.floor(nm.mulberry(3, F.col("id")) * 24).cast("int").alias("sent_id"))
    return drawn.join(F.broadcast(static.sentences(spark)), "sent_id").select("pos", "tokens")


def sentence_pairs(spark, sf_dir):
    """Token pairs of sentences drawn with replacement, with the categories of both."""
    words = _drawn(spark, 500).select(F.explode(F.arrays_zip(F.slice("tokens", 1, 2).alias("a"), F.slice("tokens", 2, 2).alias("b"))).alias("p")).select("p.a", "p.b")
    kind = static.token_categories(spark)
    out = words.groupBy("a", "b").agg(F.count("*").alias("n"))
    out = out.join(F.broadcast(kind.select(F.col("token").alias("a"), F.col("category").alias("a_kind"))), "a")
    return out.join(F.broadcast(kind.select(F.col("token").alias("b"), F.col("category").alias("b_kind"))), "b").select("a", "b", "n", "a_kind", "b_kind")


def random_draws(spark, sf_dir):
    u = nm.mulberry(1, F.col("id"))
    return spark.range(1000).select("id", F.round(u, 12).alias("u"), nm.between_int(u, 0, 9).alias("digit"))


def interpolation(spark, sf_dir):
    """Order prices through the scalar functions."""
    p = F.col("o_totalprice").cast("double")
    t = nm.clamp(nm.inverse_lerp(1000.0, 300000.0, p), 0.0, 1.0)
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.round(t, 6).alias("t"), F.round(nm.remap(t, 0.0, 1.0, -4.0, 4.0), 6).alias("remapped"), F.round(nm.sigmoid(nm.lerp(-4.0, 4.0, t)), 6).alias("sigmoid"),
        F.round(nm.ease_out(t), 6).alias("eased"), nm.progress(p, F.lit(300000.0)).alias("progress"), nm.blend(t, 20, 220).alias("channel"),
        F.round(nm.distance(F.lit(0.0), F.lit(0.0), t, 1 - t), 6).alias("distance"), F.round(F.radians(t * 360), 6).alias("radians"), nm.safe_divide(p, F.lit(0)).alias("guarded"),
    )


def ring_points(spark, sf_dir):
    return learning.rings(spark).select("id", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"), "label", "pos")


def grid(spark, sf_dir):
    """The grid that decisions are drawn over: 180 by 180 points from -2 to 2, y downwards."""
    axis = lambda c: spark.range(180).select(F.col("id").cast("int").alias(c))
    at = lambda c: nm.remap(F.col(c).cast("double"), 0.0, 179.0, -2.0, 2.0)
    return axis("col").crossJoin(axis("row")).select("col", "row", F.round(at("col"), 9).alias("x"), F.round(-at("row"), 9).alias("y"))


def decision_grid(spark, sf_dir):
    """What three nets trained on the rings make of every point of the grid, and the class of each."""
    at = grid(spark, sf_dir)
    got = learning.predictions(learning.rings(spark), at, ("linear", "relu", "deep_relu"))
    return got.select("col", "row", *(F.round(m, 6).alias(m) for m in ("linear", "relu", "deep_relu")), nm.predicted(F.col("relu"), strict=True).alias("class"))


WIDE, HIGH, REACH, NODES = 1280, 720, 150, 400


def near_nodes(spark, sf_dir):
    """Pairs of nodes of a drawing within a distance of each other: a node is compared with those of its own and the neighbouring squares only."""
    u = learning.draws(5, 2 * NODES).reshape(NODES, 2)
    nodes = spark.createDataFrame([(i, float(x * WIDE), float(y * HIGH)) for i, (x, y) in enumerate(u)], "id bigint, x double, y double")
    square = lambda c: F.floor(F.col(c) / REACH)
    own = nodes.select("id", "x", "y", square("x").alias("sx"), square("y").alias("sy"))
    step = F.sequence(F.lit(-1), F.lit(1))
    other = own.select(F.col("id").alias("j"), F.col("x").alias("u"), F.col("y").alias("v"), F.explode(F.transform(step, lambda d: F.col("sx") + d)).alias("sx"), "sy")
    other = other.select("j", "u", "v", "sx", F.explode(F.transform(step, lambda d: F.col("sy") + d)).alias("sy"))
    d = nm.distance(F.col("x"), F.col("y"), F.col("u"), F.col("v"))
    pairs = own.join(other, ["sx", "sy"]).where(F.col("id") < F.col("j")).withColumn("d", d).where(F.col("d") < REACH)
    return pairs.select(F.col("id").alias("i"), "j", F.round("d", 6).alias("distance"))


def token_vectors(spark, sf_dir):
    """The next-token net on drawn sentences: its losses by epoch, and the vectors of its tokens."""
    drawn = _drawn(spark, 90).select("pos", F.posexplode(F.arrays_zip(F.slice("tokens", 1, 2).alias("a"), F.slice("tokens", 2, 2).alias("b"))).alias("k", "p"))
    pairs = drawn.select((F.col("pos") * 2 + F.col("k")).alias("pos"), "p.a", "p.b")
    return learning.next_token_net(pairs)


def training_histories(spark, sf_dir):
    points = learning.rings(spark).withColumn("samples", F.lit(200).cast("bigint"))
    return learning.histories(points, ("linear", "relu", "deep_linear", "deep_relu"))


def generalization(spark, sf_dir):
    """The last epoch of each sample size and the gap between its accuracies; sizes without a run stay, with nulls."""
    sizes = (20, 100, 400)
    points = reduce(lambda a, b: a.unionByName(b), [learning.rings(spark, n, noise=0.3).withColumn("samples", F.lit(n).cast("bigint")) for n in sizes])
    runs = learning.histories(points, ("wide",), epochs=30).groupBy("samples").agg(F.max_by(F.struct("epoch", "train_acc", "test_acc"), "epoch").alias("r"))
    asked = spark.createDataFrame([(n,) for n in (*sizes, 1600)], "samples bigint")
    return asked.join(runs, "samples", "left").select("samples", "r.epoch", "r.train_acc", "r.test_acc", (F.col("r.train_acc") - F.col("r.test_acc")).alias("gap"))


def label_accuracy(spark, sf_dir):
    """Accuracy of 'long documents are good', split by position: the last fifth by id, one at least, is the test."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    rows = ranks.positions(rows.withColumn("g", F.lit(0)), "g", ["doc_id", "quality", "n_chars"])
    right = (nm.sigmoid((F.col("n_chars") - 500) / 200) >= 0.5).cast("int") == F.col("quality")
    part = F.when(F.col("position") >= F.col("size") - F.greatest(F.lit(1), F.floor(F.col("size") / 5)), "test").otherwise("train")
    got = rows.groupBy(part.alias("part")).agg(F.round(F.avg(right.cast("int")), 8).alias("accuracy"), F.count("*").alias("n"))
    return got.withColumn("gap", F.round(F.max(F.when(F.col("part") == "train", F.col("accuracy"))).over(Window.partitionBy(F.lit(0))) - F.max(F.when(F.col("part") == "test", F.col("accuracy"))).over(Window.partitionBy(F.lit(0))), 8))


def layer_product(spark, sf_dir):
    """Three layers' weights multiplied: a layer's rows, as many as a vector has entries, are the mean vectors of the ids it gets in turn."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.size("embedding").alias("d"), F.posexplode("embedding").alias("col", "v"))
    place = [(F.col("vec_id") % 3).cast("int").alias("layer"), (F.floor(F.col("vec_id") / 3) % F.col("d")).cast("int").alias("row"), "col"]
    layers = e.groupBy(*place).agg(F.avg(F.col("v").cast("double")).alias("v"))
    return learning.chain_product(layers).select("row", "col", (F.round("v", 5) + F.lit(0.0)).alias("v"))


QUERIES = {
    f.__name__: f
    for f in (
        nearest_vectors, projections, vocabulary_costs, recommended_vocabulary, fertility_ranking, mix_shares, benchmark_list, stage_list, sentence_pairs,
        random_draws, interpolation, ring_points, grid, decision_grid, near_nodes, token_vectors, training_histories, generalization, label_accuracy, layer_product,
    )
}


def _values(rows, names: str) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows) + f") AS t({names})"


def _draws(seed: int, n: int) -> str:
    """(d, u): the first n numbers of the seed's sequence."""
    m = 4294967296
    product = lambda a, b: f"((({a})::HUGEINT * ({b})::HUGEINT) % {m})::BIGINT"
    first = f"SELECT d, (({seed} + ((d + 1)::HUGEINT * 1831565813)) % {m})::BIGINT AS t FROM range({n}) r(d)"
    second = f"SELECT d, {product('xor(t, t >> 15)', 't | 1')} AS t FROM ({first})"
    third = f"SELECT d, xor(t, (t + {product('xor(t, t >> 7)', 't | 61')}) % {m}) AS t FROM ({second})"
    return f"SELECT d, xor(t, t >> 14) / {m}.0::DOUBLE AS u FROM ({third})"


_SENTENCES = _values([(i, *x) for i, x in enumerate((s, v, o) for v, ps in static.SENTENCES.items() for s, o in (p.split("-") for p in ps.split()))], "sent_id, s, v, o")
_KINDS = _values([(t, c) for c, ts in static.CATEGORIES.items() for t in ts.split()], "token, category")
_OPTIONS = _values([(f"{k}K", k * 1024, *v, str(True) if k == static.RECOMMENDED else None) for k, v in static.VOCABULARIES.items()], "label, vocab, fertility, train_cost, infer_cost, rec")
_T = "greatest(0.0, least(1.0, (CAST(o_totalprice AS DOUBLE) - 1000.0) / 299000.0))"
ORACLES: dict[str, str] = {
    "nearest_vectors": """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), n AS (SELECT *, sqrt(list_dot_product(e, e)) AS len FROM v)
SELECT query_id, rank::INT AS rank, vec_id, round(s, 5) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM
(SELECT a.vec_id AS query_id, b.vec_id, round(list_dot_product(a.e, b.e) / (a.len * b.len + 1e-8), 9) AS s FROM n a JOIN n b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)) WHERE rank <= 3""",
    "projections": "SELECT vec_id, round(embedding[1]::DOUBLE, 6) AS x, round(embedding[2]::DOUBLE, 6) AS y, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS norm, array_to_string(list_transform(range(10), lambda i: CASE WHEN i = label THEN '1' ELSE '0' END), '') AS one_hot FROM embeddings",
    "vocabulary_costs": f"""SELECT label, vocab::BIGINT * {WIDTH} AS params, round(vocab::BIGINT * {WIDTH} / 1e6, 4) AS params_m, round(vocab::BIGINT * {WIDTH} * {BYTES} / 1e9, 6) AS gb, round(1.42::DOUBLE / fertility::DOUBLE * 100, 6) AS efficiency, rec IS NOT NULL AS recommended,
CASE label WHEN '32K' THEN 'too small' WHEN '64K' THEN 'weak coverage' WHEN '96K' THEN 'slightly small' WHEN '128K' THEN 'best balance' WHEN '160K' THEN 'little gain' ELSE 'costly' END AS verdict FROM {_OPTIONS}""",
    "recommended_vocabulary": f"SELECT label, vocab::INT AS vocab, fertility::DOUBLE AS fertility, train_cost, infer_cost, true AS recommended FROM {_OPTIONS} WHERE rec IS NOT NULL ORDER BY vocab LIMIT 1",
    "fertility_ranking": f"""SELECT (row_number() OVER (ORDER BY target, ordinal))::INT AS position, domain, category, target::DOUBLE AS target, round(100 - (target::DOUBLE - 1.0) / 0.3::DOUBLE * 100, 6) AS compression
FROM {_values([(i, d, t, c) for i, ((c, d), t) in enumerate(static.TARGETS.items())], "ordinal, domain, target, category")}""",
    "mix_shares": f"SELECT id, share::INT AS share, share >= 10 AS labelled, (sum(share) OVER ())::BIGINT AS total FROM {_values(static.SHARES.items(), 'id, share')}",
    "benchmark_list": f"SELECT * FROM {_values([(g, i, b) for g, bs in static.BENCHMARKS.items() for i, b in enumerate(bs.split('|'))], 'title, pos, name')}",
    "stage_list": f"SELECT * FROM {_values([(kind, i, s) for kind, ids in (('data', static.PHASES), ('cleaning', static.CLEANING), ('training', static.TRAINING)) for i, s in enumerate(ids)], 'kind, ordinal, id')}",
    "interpolation": f"""SELECT o_orderkey, round(t, 6) AS t, round(-4.0 + 8.0 * t, 6) AS remapped, round(1 / (1 + exp(-(-4.0 + 8.0 * t))), 6) AS sigmoid, round(1 - pow(1 - t, 3), 6) AS eased, least(100, floor(CAST(o_totalprice AS DOUBLE) / 300000.0 * 100 + 0.5))::INT AS progress,
floor(20 * (1 - t) + 220 * t + 0.5)::INT AS channel, round(sqrt(t * t + (1 - t) * (1 - t)), 6) AS distance, round(radians(t * 360), 6) AS radians, 0.0::DOUBLE AS guarded FROM (SELECT *, {_T} AS t FROM orders)""",
    "random_draws": f"SELECT d AS id, round(u, 12) AS u, floor(u * 10)::INT AS digit FROM ({_draws(1, 1000)})",
    "sentence_pairs": f"""WITH p AS (SELECT s, v, o FROM ({_draws(3, 500)}) JOIN (SELECT * FROM {_SENTENCES}) ON floor(u * 24)::INT = sent_id), q AS (SELECT s AS a, v AS b FROM p UNION ALL SELECT v, o FROM p), k AS (SELECT * FROM {_KINDS})
SELECT a, b, count(*) AS n, any_value(ka.category) AS a_kind, any_value(kb.category) AS b_kind FROM q JOIN k ka ON ka.token = a JOIN k kb ON kb.token = b GROUP BY a, b""",
    "near_nodes": f"""WITH d AS ({_draws(5, 2 * NODES)}), n AS (SELECT a.d // 2 AS id, a.u * {WIDE} AS x, b.u * {HIGH} AS y FROM d a JOIN d b ON b.d = a.d + 1 WHERE a.d % 2 = 0)
SELECT a.id AS i, b.id AS j, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 6) AS distance FROM n a JOIN n b ON a.id < b.id WHERE sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) < {REACH}""",
    "ring_points": f"""WITH RECURSIVE d AS ({_draws(1, 800)}), f(i, a) AS (SELECT 199::BIGINT, range(200) UNION ALL
SELECT i - 1, list_transform(a, lambda x, k: CASE WHEN k - 1 = i THEN a[floor((i + 1) * u)::BIGINT + 1] WHEN k - 1 = floor((i + 1) * u)::BIGINT THEN a[i + 1] ELSE x END) FROM f JOIN d ON d.d = 600 + 199 - i WHERE i > 0),
o AS (SELECT unnest(a) AS id, unnest(range(200)) AS pos FROM f WHERE i = 0),
r AS (SELECT id, (id >= 100)::INT AS label, CASE WHEN id >= 100 THEN 1.0 ELSE 0.5 END::DOUBLE + 0.08::DOUBLE * sqrt(-2 * ln(x.u)) * cos(2 * pi() * y.u) AS r, 2 * pi() * z.u AS t FROM range(200) g(id) JOIN d x ON x.d = 3 * id JOIN d y ON y.d = 3 * id + 1 JOIN d z ON z.d = 3 * id + 2)
SELECT id, round(r * cos(t), 9) AS x, round(r * sin(t), 9) AS y, label, pos FROM r JOIN o USING (id)""",
    "grid": "SELECT c::INT AS col, r::INT AS row, round(-2.0 + 4.0 * (c / 179.0::DOUBLE), 9) AS x, round(-(-2.0 + 4.0 * (r / 179.0::DOUBLE)), 9) AS y FROM range(180) a(c), range(180) b(r)",
    "label_accuracy": """SELECT part, accuracy, n, round(max(accuracy) FILTER (part = 'train') OVER () - max(accuracy) FILTER (part = 'test') OVER (), 8) AS gap FROM (SELECT CASE WHEN p >= size - greatest(1, size // 5) THEN 'test' ELSE 'train' END AS part, round(avg(((n_chars >= 500)::INT = quality)::INT), 8) AS accuracy, count(*) AS n
FROM (SELECT quality, n_chars, row_number() OVER (ORDER BY doc_id, quality, n_chars) - 1 AS p, count(*) OVER () AS size FROM labels JOIN documents USING (doc_id)) GROUP BY 1)""",
    "layer_product": """WITH l AS (SELECT layer, r, c, avg(v) AS v FROM (SELECT vec_id % 3 AS layer, (vec_id // 3) % len(embedding) AS r, unnest(range(len(embedding))) AS c, unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY ALL)
SELECT a.r::INT AS "row", c.c::INT AS col, round(sum(a.v * b.v * c.v), 5) + 0.0 AS v FROM l a JOIN l b ON a.layer = 0 AND b.layer = 1 AND a.c = b.r JOIN l c ON c.layer = 2 AND b.c = c.r GROUP BY ALL""",
}
