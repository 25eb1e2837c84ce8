"""Neighbour graph and clustering bound to ``embeddings``.

Points: vec_id with the 64-float embedding cast to double; k = 5 (with
k >= 10 the mutual graph has one to three components, so k = 5 exercises
the outlier cut).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import cpf, graph, knn
from tidemark.operators._util import round_doubles
from tidemark.plans.registry import register
from tidemark.session import cut_lineage
from tidemark.sources import io

K = 5


def vectors(spark, sf_dir):
    return knn.as_vectors(io.load_table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


VEC_CTE = f"""
v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings
      WHERE embedding IS NOT NULL),
d AS (SELECT a.id AS src, b.id AS dst, list_distance(a.vec, b.vec) AS dist
      FROM v a CROSS JOIN v b),
knn AS (SELECT src, dst, dist, rank FROM (
          SELECT *, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS rank FROM d)
        WHERE rank <= {K}),
radius AS (SELECT src AS id, dist AS knn_radius FROM knn WHERE rank = {K}),
mutual AS (SELECT a.src, a.dst, least(a.dist, b.dist) AS dist FROM knn a
           JOIN knn b ON a.src = b.dst AND a.dst = b.src
           WHERE a.src <> a.dst AND a.dist > 0),
reach(a, b) AS (SELECT id, id FROM v
                UNION SELECT r.a, m.dst FROM reach r JOIN mutual m ON r.b = m.src),
comp0 AS (SELECT a AS id, min(b) AS component FROM reach GROUP BY a),
csize AS (SELECT component, count(*) AS n FROM comp0 GROUP BY 1),
comps AS (SELECT id, CASE WHEN n > 1 THEN component END AS component
          FROM comp0 JOIN csize USING (component))"""


@register("knn_graph", f"""
WITH RECURSIVE {VEC_CTE}
SELECT src, dst, round(dist, 6) AS dist, CAST(rank AS INTEGER) AS rank FROM knn
""")
def knn_graph(spark, sf_dir):
    """K nearest neighbours per point, self included."""
    e = knn.knn_edges(vectors(spark, sf_dir), K)
    return round_doubles(e)


@register("knn_graph_manhattan", f"""
WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings
           WHERE embedding IS NOT NULL),
x AS (SELECT id, unnest(vec) AS x, generate_subscripts(vec, 1) AS i FROM v),
d AS (SELECT a.id AS src, b.id AS dst, sum(abs(a.x - b.x)) AS dist
      FROM x a JOIN x b ON a.i = b.i GROUP BY 1, 2)
SELECT src, dst, round(dist, 6) AS dist, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS rank FROM d)
WHERE rank <= {K}
""")
def knn_graph_manhattan(spark, sf_dir):
    """C1 with another metric: sums of absolute differences."""
    return round_doubles(knn.knn_edges(vectors(spark, sf_dir), K, metric="manhattan"))


@register("knn_radius", f"""
WITH RECURSIVE {VEC_CTE}
SELECT id, round(knn_radius, 6) AS knn_radius FROM radius
""")
def knn_radius(spark, sf_dir):
    """Distance to the k-th neighbour."""
    return round_doubles(knn.knn_radius(knn.knn_edges(vectors(spark, sf_dir), K), K))


@register("knn_graph_approx")
def knn_graph_approx(spark, sf_dir):
    """C1, approximate: random-projection leaves of at most 400 points,
    10 trees (the path for point sets beyond exact search)."""
    e = knn.approx_knn_edges(vectors(spark, sf_dir), K, trees=10, leaf_rows=400)
    return round_doubles(e)


@register("mutual_graph", f"""
WITH RECURSIVE {VEC_CTE}
SELECT src, dst, round(dist, 6) AS dist FROM mutual
""")
def mutual_graph(spark, sf_dir):
    """Mutual kNN edges (both directions), no self loops."""
    return round_doubles(knn.mutual_edges(knn.knn_edges(vectors(spark, sf_dir), K)))


@register("graph_components", f"""
WITH RECURSIVE {VEC_CTE}
SELECT id, component FROM comps
""")
def graph_components(spark, sf_dir):
    """Connected components of the mutual graph, singletons -> NULL."""
    v = cut_lineage(vectors(spark, sf_dir))
    mutual = knn.mutual_edges(knn.knn_edges(v, K))
    comps = graph.connected_components(v.select("id"), mutual)
    return graph.component_outliers(comps, 1)


PARENT_CTE = """nodes AS (SELECT id, component, knn_radius FROM comps JOIN radius USING (id)
          WHERE component IS NOT NULL),
cand AS (SELECT p.id, q.id AS qid, list_distance(pv.vec, qv.vec) AS dist
         FROM nodes p JOIN nodes q ON p.component = q.component AND q.knn_radius < p.knn_radius
         JOIN v pv ON pv.id = p.id JOIN v qv ON qv.id = q.id),
best AS (SELECT id, qid AS parent, dist AS best_distance FROM (
           SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, qid) AS rn FROM cand)
         WHERE rn = 1),
cmin AS (SELECT component, min(knn_radius) AS rmin FROM nodes GROUP BY 1),
croot AS (SELECT n.component, min(n.id) AS root FROM nodes n JOIN cmin c
          ON n.component = c.component AND n.knn_radius = c.rmin GROUP BY 1),
rest AS (SELECT n.id, r.root FROM nodes n JOIN croot r USING (component)
         WHERE n.id NOT IN (SELECT id FROM best)),
par AS (SELECT * FROM best
        UNION ALL SELECT id, id, CAST('inf' AS DOUBLE) FROM rest WHERE id = root
        UNION ALL SELECT rest.id, root, list_distance(a.vec, b.vec) FROM rest
          JOIN v a ON a.id = rest.id JOIN v b ON b.id = rest.root WHERE rest.id <> root)"""


@register("denser_parent", f"""
WITH RECURSIVE {VEC_CTE},
{PARENT_CTE}
SELECT n.id, n.component, round(n.knn_radius, 6) AS knn_radius, par.parent,
       round(par.best_distance, 6) AS best_distance,
       round(CASE WHEN n.knn_radius = 0 THEN CAST('inf' AS DOUBLE)
                  ELSE par.best_distance / n.knn_radius END, 6) AS peak
FROM nodes n JOIN par USING (id)
""")
def denser_parent(spark, sf_dir):
    """C4 + C5: nearest denser point of the same component and peak score."""
    v = vectors(spark, sf_dir)
    edges, mutual, nodes = cpf.build_graph(v, K)
    par = cpf.denser_parent(v, edges, nodes)
    out = cpf.peak_score(nodes.filter(F.col("component").isNotNull()).join(par, "id"))
    return round_doubles(out.select("id", "component", "knn_radius", "parent",
                                    "best_distance", "peak"))


def _labels_truth(spark, sf_dir):
    return io.load_table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("label").cast("int").alias("label"))


@register("label_centroid_density", f"""
WITH RECURSIVE {VEC_CTE},
lab AS (SELECT vec_id AS id, CAST(label AS INTEGER) AS label FROM embeddings WHERE label <> -1),
x AS (SELECT lab.label, unnest(v.vec) AS x, unnest(range(len(v.vec))) AS dim
      FROM v JOIN lab USING (id)),
cent AS (SELECT label, dim, avg(x) AS m FROM x GROUP BY 1, 2),
c2 AS (SELECT label, max(m) FILTER (WHERE dim = 0) AS c0, max(m) FILTER (WHERE dim = 1) AS c1,
              sqrt(sum(m * m)) AS norm FROM cent GROUP BY 1),
sz AS (SELECT label, count(*) AS size FROM lab GROUP BY 1),
w AS (SELECT a.label, sum(m.dist) AS wsum FROM mutual m JOIN lab a ON a.id = m.src
      JOIN lab b ON b.id = m.dst WHERE a.label = b.label GROUP BY 1)
SELECT sz.label, sz.size, round(c0, 6) AS c0, round(c1, 6) AS c1, round(norm, 6) AS centroid_norm,
       round(coalesce(wsum, 0) / (CAST(size AS DOUBLE) * size), 6) AS density
FROM sz JOIN c2 USING (label) LEFT JOIN w USING (label)
""")
def label_centroid_density(spark, sf_dir):
    """Per-label size, centroid and mutual-graph density."""
    v = vectors(spark, sf_dir)
    mutual = knn.mutual_edges(knn.knn_edges(v, K))
    t = cpf.centroids_and_densities(v, _labels_truth(spark, sf_dir), mutual)
    out = t.select("label", "size", F.col("centroid")[0].alias("c0"),
                   F.col("centroid")[1].alias("c1"),
                   F.sqrt(F.aggregate("centroid", F.lit(0.0), lambda a, x: a + x * x))
                   .alias("centroid_norm"), "density")
    return round_doubles(out)


@register("label_calinski_harabasz", """
WITH v AS (SELECT vec_id AS id, CAST(label AS INTEGER) AS label,
                  CAST(embedding AS DOUBLE[]) AS vec FROM embeddings WHERE embedding IS NOT NULL),
x AS (SELECT label, unnest(vec) AS x, unnest(range(len(vec))) AS dim FROM v),
g AS (SELECT label, dim, sum(x) AS sx, sum(x * x) AS sxx, count(*) AS n FROM x GROUP BY 1, 2),
t AS (SELECT dim, sum(sx) / sum(n) AS gm FROM g GROUP BY 1),
per AS (SELECT label, n, sxx - sx * sx / n AS w, n * (sx / n - gm) * (sx / n - gm) AS b
        FROM g JOIN t USING (dim)),
lab AS (SELECT label, max(n) AS n, sum(w) AS w, sum(b) AS b FROM per GROUP BY 1),
one AS (SELECT count(*) AS k, sum(n) AS n, sum(w) AS ssw, sum(b) AS ssb FROM lab)
SELECT k AS n_labels, round(CASE WHEN k > 1 AND n > k THEN ssb * (n - k) / (ssw * (k - 1)) END, 4)
       AS score FROM one
""")
def label_calinski_harabasz(spark, sf_dir):
    """C11: Calinski-Harabasz index of the given labels."""
    s = cpf.calinski_harabasz(vectors(spark, sf_dir), _labels_truth(spark, sf_dir))
    return s.select(F.col("n_labels"), F.round("score", 4).alias("score"))


@register("remove_duplicate_vectors", """
SELECT min(vec_id) AS id FROM embeddings WHERE embedding IS NOT NULL
GROUP BY CAST(embedding AS DOUBLE[])
""")
def remove_duplicate_vectors(spark, sf_dir):
    """One id per distinct vector (the lowest)."""
    return knn.remove_duplicates(vectors(spark, sf_dir)).select("id")


def _fit_ctes(rho: float, alpha: float) -> str:
    """C4-C7 in SQL after ``VEC_CTE``, ending in ``labels (id, label)``: every
    candidate's piece is searched by itself, whether it is ever tested or not."""
    return f"""{PARENT_CTE},
scored AS (SELECT n.id, n.component, n.knn_radius AS r, par.parent,
                  CASE WHEN n.knn_radius = 0 THEN CAST('inf' AS DOUBLE)
                       ELSE par.best_distance / n.knn_radius END AS peak
           FROM nodes n JOIN par USING (id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY component ORDER BY peak DESC, id) - 1 AS pos FROM scored),
cuts AS (SELECT *, CASE WHEN pos > 0 THEN r / {alpha} ELSE CAST('inf' AS DOUBLE) END AS own,
                CASE WHEN r > 0 THEN r / pow({rho}, 1.0 / (SELECT max(len(vec)) FROM v)) ELSE r END AS reach
         FROM ranked),
trial AS (SELECT *, min(own) OVER w AS cut, min(own) OVER b AS cut_before,
                pos > 0 AND r > max(r) OVER b AS tops, peak = lag(peak) OVER w AS ties
         FROM cuts WINDOW w AS (PARTITION BY component ORDER BY pos),
              b AS (PARTITION BY component ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
piece(cid, id) AS (
  SELECT id, id FROM trial WHERE pos > 0
  UNION SELECT p.cid, m.dst FROM piece p JOIN trial c ON c.id = p.cid JOIN mutual m ON m.src = p.id
        JOIN scored s ON s.id = m.dst
        WHERE m.dist <= c.cut AND CASE WHEN c.r > 0 THEN s.r < c.reach ELSE s.r <= c.reach END),
level(cid, id) AS (
  SELECT id, id FROM trial WHERE tops
  UNION SELECT l.cid, m.dst FROM level l JOIN trial c ON c.id = l.cid JOIN mutual m ON m.src = l.id
        JOIN scored s ON s.id = m.dst WHERE m.dist <= c.cut_before AND s.r <= c.r),
refused AS (
  SELECT DISTINCT c.component, c.pos FROM piece p JOIN trial c ON c.id = p.cid
  JOIN trial o ON o.id = p.id AND o.pos < c.pos WHERE NOT c.ties
  UNION SELECT c.component, c.pos FROM trial c WHERE tops
    AND (SELECT count(*) FROM level l WHERE l.cid = c.id)
        = (SELECT count(*) FROM scored s WHERE s.component = c.component AND s.r <= c.r)),
stops AS (SELECT component, min(pos) AS stop FROM refused GROUP BY 1),
centres AS (SELECT c.id FROM trial c LEFT JOIN stops s USING (component) WHERE s.stop IS NULL OR c.pos < s.stop),
up(id, top) AS (
  SELECT id, id FROM scored
  UNION SELECT u.id, s.parent FROM up u JOIN scored s ON s.id = u.top
        WHERE u.top NOT IN (SELECT id FROM centres) AND s.parent <> u.top),
ends AS (SELECT u.id, u.top AS root FROM up u JOIN scored s ON s.id = u.top
         WHERE u.top IN (SELECT id FROM centres) OR s.parent = u.top),
labels AS (SELECT v.id, CAST(coalesce(dense_rank() OVER (ORDER BY s.component, e.root) - 1, -1) AS INTEGER) AS label
           FROM ends e JOIN scored s ON s.id = e.root JOIN v ON v.id = e.id
           UNION ALL SELECT id, -1 FROM v WHERE id NOT IN (SELECT id FROM ends))"""


@register("cpf_clusters", f"""
WITH RECURSIVE {VEC_CTE},
{_fit_ctes(0.4, 1.0)}
SELECT id, label FROM labels
""")
def cpf_clusters(spark, sf_dir):
    """C6 + C7: centres by the component-wise peak rule, labels by parent
    chains (rho 0.4, alpha 1)."""
    return cpf.cpf_fit(vectors(spark, sf_dir), [K], [0.4], [1.0]).select("id", "label")


@register("cpf_clusters_cut", f"""
WITH RECURSIVE {VEC_CTE},
{_fit_ctes(0.9, 1.05)}
SELECT id, label FROM labels
""")
def cpf_clusters_cut(spark, sf_dir):
    """C6 + C7 with a stricter cut of edges (rho 0.9, alpha 1.05)."""
    return cpf.cpf_fit(vectors(spark, sf_dir), [K], [0.9], [1.05]).select("id", "label")


@register("cpf_grid_merge")
def cpf_grid_merge(spark, sf_dir):
    """C10 + C8 + C9: labels for a parameter grid with cluster merging."""
    return cpf.cpf_fit(vectors(spark, sf_dir), [K], [0.4, 0.6], [1.0], merge=True,
                       merge_thresholds=[0.5], density_ratio_thresholds=[0.1])


@register("cpf_cross_validate")
def cpf_cross_validate(spark, sf_dir):
    """C11 over C10: the best combination by Calinski-Harabasz."""
    v = vectors(spark, sf_dir)
    fits = cut_lineage(cpf.cpf_fit(v, [K], [0.3, 0.5], [1.0]))
    return cpf.cross_validate(v, fits)


@register("label_cross_validate", """
WITH v AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings WHERE embedding IS NOT NULL),
runs AS (SELECT id, vec, m AS parts, CAST(label % m AS INTEGER) AS label FROM v, (SELECT unnest([1, 2, 3, 5, 10]) AS m)),
x AS (SELECT parts, label, unnest(vec) AS x, unnest(range(len(vec))) AS dim FROM runs),
g AS (SELECT parts, label, dim, sum(x) AS sx, sum(x * x) AS sxx, count(*) AS n FROM x GROUP BY ALL),
t AS (SELECT parts, dim, sum(sx) / sum(n) AS gm FROM g GROUP BY ALL),
lab AS (SELECT parts, label, max(n) AS n, sum(sxx - sx * sx / n) AS w, sum(n * (sx / n - gm) * (sx / n - gm)) AS b
        FROM g JOIN t USING (parts, dim) GROUP BY ALL),
one AS (SELECT parts, count(*) AS k, sum(n) AS n, sum(w) AS ssw, sum(b) AS ssb FROM lab GROUP BY ALL)
SELECT parts, round(ssb * (n - k) / (ssw * (k - 1)), 6) AS score FROM one WHERE k > 1 AND n > k
ORDER BY ssb * (n - k) / (ssw * (k - 1)) DESC, parts LIMIT 1
""")
def label_cross_validate(spark, sf_dir):
    """C11: the best of several groupings of the given labels, in one pass."""
    runs = _labels_truth(spark, sf_dir).withColumn(
        "parts", F.explode(F.array(*[F.lit(m) for m in (1, 2, 3, 5, 10)])))
    runs = runs.select("id", "parts", (F.col("label") % F.col("parts")).alias("label"))
    best = cpf.cross_validate(vectors(spark, sf_dir), runs, keys=["parts"])
    return best.select("parts", F.round("score", 6).alias("score"))
