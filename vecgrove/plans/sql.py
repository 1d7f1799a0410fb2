"""DuckDB SQL with the results of the engine's queries, from the same tables."""

from __future__ import annotations

import math

from vecgrove.plans.queries import BEAM, COARSE, COARSE_B, QUERY_STEP, STUDY, STUDY_OF, TREE_A, WIDE_B, B, C, K

V = """v AS (SELECT vec_id AS id, CAST(label AS BIGINT) AS image_id,
  list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 127) AS INTEGER)) AS vec FROM embeddings)"""
Q = f"q AS (SELECT id AS qid, image_id AS query_image, vec FROM v WHERE id % {QUERY_STEP} = 0)"


def leaders_of(c: int, rows: str = "v") -> str:
    return f"""leaders AS (SELECT row_number() OVER (ORDER BY md5(CAST(id AS VARCHAR)), id) - 1 AS leader_id, id, vec
  FROM {rows} QUALIFY row_number() OVER (ORDER BY md5(CAST(id AS VARCHAR)), id) <= {c})"""


LEADERS = leaders_of(C)


def l2(a: str, b: str) -> str:
    return f"CAST(list_sum(list_transform(list_zip({a}, {b}), lambda s: (s[1] - s[2]) * (s[1] - s[2]))) AS BIGINT)"


def best(rows: str, by: str, order: str, k: int, columns: str = "*") -> str:
    return f"SELECT {columns}, CAST(row_number() OVER (PARTITION BY {by} ORDER BY {order}) AS INTEGER) AS rank FROM {rows} QUALIFY rank <= {k}"


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def descent(name: str, points: str, levels: int, n: int, beam: int = 1) -> list[str]:
    """CTEs that end in ``name``: columns of ``points(id, vec)``, rank, cluster_id, cluster_dist."""
    out, at = [], f"(SELECT id, vec, CAST(-1 AS BIGINT) AS node FROM {points})"
    for level in range(1, levels + 1):
        near = f"""(SELECT {"DISTINCT" if beam > 1 else ""} p.id, p.vec, e.child, {l2("p.vec", "l.vec")} AS d FROM {at} p
  JOIN e{level} e ON e.parent = p.node JOIN leaders l ON l.leader_id = e.child)"""
        step = f"{name}_{level}"
        picked = best(near, "id", "d, child", n if level == levels else beam)
        if level == levels:
            out.append(f"{name} AS (SELECT id, vec, rank, child AS cluster_id, d AS cluster_dist FROM ({picked}))")
        else:
            out.append(f"{step} AS (SELECT id, vec, child AS node FROM ({picked}))")
            at = step
    return out


def tree(levels: int, c: int = C) -> list[str]:
    """CTEs e1 ... of the edges per level."""
    bucket = math.ceil(c ** (1 / levels))
    first = c if levels == 1 else bucket
    out = [f"e1 AS (SELECT 1 AS level, CAST(-1 AS BIGINT) AS parent, leader_id AS child FROM leaders WHERE leader_id < {first})"]
    for level in range(2, levels + 1):
        points = f"(SELECT leader_id AS id, vec FROM leaders WHERE leader_id < {min(bucket**level, c)})"
        out += descent(f"t{level}", points, level - 1, TREE_A)
        out.append(f"e{level} AS (SELECT {level} AS level, cluster_id AS parent, id AS child FROM t{level})")
    return out


EXACT_PAIRS = f"pairs AS (SELECT q.qid, q.query_image, v.id, v.image_id, {l2('q.vec', 'v.vec')} AS dist FROM q, v)"
ALL_PAIRS = f"pairs AS (SELECT a.id AS qid, b.id, {l2('a.vec', 'b.vec')} AS dist FROM v a, v b)"


def exact(k: int) -> str:
    return with_(V, Q, EXACT_PAIRS) + f"SELECT qid, rank, id, dist FROM ({best('pairs', 'qid', 'dist, id', k)})"


def setup(levels: int, b: int, c: int = C, beam: int = 1) -> list[str]:
    """CTEs v, q, leaders, edges, db(cluster_id, ...), visit(cluster_id, qid, ...)."""
    return [
        V, Q, leaders_of(c), *tree(levels, c), *descent("a", "v", levels, 1),
        "db AS (SELECT a.cluster_id, a.id, a.vec, v.image_id FROM a JOIN v USING (id))",
        *descent("s", "(SELECT qid AS id, vec FROM q)", levels, b, beam),
        "visit AS (SELECT s.cluster_id, s.id AS qid, s.vec, q.query_image FROM s JOIN q ON q.qid = s.id)",
        f"near AS (SELECT visit.qid, visit.query_image, db.cluster_id, db.id, db.image_id, {l2('visit.vec', 'db.vec')} AS dist FROM db JOIN visit USING (cluster_id))",
    ]


def approx(levels: int, b: int, k: int = K, c: int = C, beam: int = 1) -> str:
    return with_(*setup(levels, b, c, beam)) + f"SELECT qid, rank, id, dist FROM ({best('near', 'qid', 'dist, id', k)})"


def assigned(levels: int, n: int) -> str:
    return with_(V, LEADERS, *tree(levels), *descent("a", "v", levels, n)) + "SELECT id, rank, cluster_id, cluster_dist FROM a"


def edges(levels: int) -> str:
    union = " UNION ALL ".join(f"SELECT CAST(level AS INTEGER) AS level, parent, child FROM e{i}" for i in range(1, levels + 1))
    return with_(V, LEADERS, *tree(levels)) + union


HALVES = [
    V, Q, EXACT_PAIRS,
    f"x AS ({best('(SELECT * FROM pairs WHERE image_id <= 6)', 'qid', 'dist, id', 10)})",
    f"y AS ({best('(SELECT * FROM pairs WHERE image_id >= 4)', 'qid', 'dist, id', 20)})",
    "xy AS (SELECT qid, id, dist FROM x UNION ALL SELECT qid, id, dist FROM y)",
    "once AS (SELECT qid, id, min(dist) AS dist FROM xy GROUP BY qid, id)",
]


def merged(rows: str, k: int) -> str:
    return with_(*HALVES) + f"SELECT qid, id, dist, rank FROM ({best(rows, 'qid', 'dist, id', k)})"


KNN = [V, ALL_PAIRS, f"knn AS ({best('pairs', 'qid', 'dist, id', K)})", "hubs AS (SELECT id, count(*) AS hubness, max(dist) AS max_dist FROM knn GROUP BY id)"]
FEW = f"few AS (SELECT id, count(*) AS hubness, max(dist) AS max_dist FROM knn WHERE qid % {QUERY_STEP} = 0 GROUP BY id)"
VOTES = [
    *setup(1, COARSE_B, COARSE),
    f"percl AS ({best('near', 'qid, cluster_id', 'dist, image_id', K)})",
    "least AS (SELECT qid, query_image, image_id, min(dist) AS dist FROM percl GROUP BY ALL)",
    f"chosen AS ({best('least', 'qid', 'dist, image_id', K)})",
    "votes AS (SELECT query_image, image_id, count(*) AS votes FROM chosen GROUP BY ALL)",
]
WITH_HUBS = "SELECT k.qid, k.id AS nn_id, k.dist, coalesce(h.hubness, 0) AS hubness, coalesce(h.max_dist, 0) AS max_dist FROM"


def db_merge(mode: str) -> str:
    base = "base AS (SELECT * FROM db WHERE cluster_id < 40)"
    more = "more AS (SELECT cluster_id, id + 1000000 AS id, image_id FROM db WHERE cluster_id >= 20)"
    keep_more = "" if mode == "full" else " WHERE cluster_id IN (SELECT cluster_id FROM base)"
    keep_base = " WHERE cluster_id IN (SELECT cluster_id FROM more)" if mode == "inner" else ""
    return with_(*setup(2, 1), base, more) + f"SELECT cluster_id, id, image_id FROM base{keep_base} UNION ALL SELECT cluster_id, id, image_id FROM more{keep_more}"


def recalls() -> str:
    parts = setup(1, C)
    parts.append(f"truth AS ({best('(SELECT q.qid, v.id, ' + l2('q.vec', 'v.vec') + ' AS dist FROM q, v)', 'qid', 'dist, id', K)})")
    unions = []
    for b in (1, 3, 10, WIDE_B, C):
        parts.append(f"near{b} AS (SELECT near.* FROM near JOIN s ON s.id = near.qid AND s.cluster_id = near.cluster_id WHERE s.rank <= {b})")
        parts.append(f"found{b} AS ({best(f'near{b}', 'qid', 'dist, id', K)})")
        unions.append(f"SELECT CAST({b} AS INTEGER) AS b, (SELECT count(*) FROM truth JOIN found{b} USING (qid, id)) / (SELECT count(*) FROM truth) AS recall")
    return with_(*parts) + " UNION ALL ".join(unions)


def deep_recalls() -> str:
    truth = f"truth AS ({best('(SELECT q.qid, v.id, ' + l2('q.vec', 'v.vec') + ' AS dist FROM q, v)', 'qid', 'dist, id', K)})"
    parts = [*setup(2, 1), truth]
    unions = []
    for beam in (1, 3, BEAM):
        parts += descent(f"s{beam}", "(SELECT qid AS id, vec FROM q)", 2, WIDE_B, beam)
        parts.append(f"near{beam} AS (SELECT s.id AS qid, db.id, {l2('s.vec', 'db.vec')} AS dist FROM s{beam} s JOIN db USING (cluster_id))")
        parts.append(f"found{beam} AS ({best(f'near{beam}', 'qid', 'dist, id', K)})")
        unions.append(f"SELECT CAST({beam} AS INTEGER) AS beam, (SELECT count(*) FROM truth JOIN found{beam} USING (qid, id)) / (SELECT count(*) FROM truth) AS recall")
    return with_(*parts) + " UNION ALL ".join(unions)


def paths(levels: int) -> str:
    parts, at = [V, Q, LEADERS, *tree(levels)], "(SELECT qid AS id, vec, CAST(-1 AS BIGINT) AS node FROM q)"
    for level in range(1, levels + 1):
        near = f"(SELECT p.id, p.vec, e.child, {l2('p.vec', 'l.vec')} AS d FROM {at} p JOIN e{level} e ON e.parent = p.node JOIN leaders l ON l.leader_id = e.child)"
        parts.append(f"n{level} AS ({best(near, 'id', 'd, child', B + 1 if level == levels else 3)})")
        at = f"(SELECT id, vec, child AS node FROM n{level} WHERE rank = 1)"
        if level < levels:
            second = "'(' || string_agg(CASE WHEN rank > 1 THEN CAST(child AS VARCHAR) END, ',' ORDER BY rank) || ')'"
            parts.append(f"p{level} AS (SELECT id, max(CASE WHEN rank = 1 THEN CAST(child AS VARCHAR) END) || coalesce({second}, '') AS p FROM n{level} GROUP BY id)")
    score = "CASE WHEN d = 0 THEN 'nan' ELSE printf('%.6f', 0.5 - first(d) OVER (PARTITION BY id ORDER BY rank) / (2 * d)) END"
    parts.append(f"leaf AS (SELECT id, rank, CAST(child AS VARCHAR) || ':' || {score} AS item FROM n{levels})")
    parts.append(f"p{levels} AS (SELECT id, '|' || string_agg(item, ',' ORDER BY rank) AS p FROM leaf GROUP BY id)")
    joined = " ".join(f"JOIN p{i} USING (id)" for i in range(2, levels + 1))
    return with_(*parts) + f"SELECT id, {" || '->' || ".join(f'p{i}.p' for i in range(1, levels + 1))} AS path FROM p1 {joined}"


def share(key: str, seed: int = 0) -> str:
    return f"(CAST('0x' || md5('{seed}:' || CAST({key} AS VARCHAR))[1:13] AS BIGINT) / CAST({1 << 52} AS DOUBLE))"


DRAWN = f"drawn AS (SELECT DISTINCT CAST(floor({share('i')} * {STUDY_OF}) AS BIGINT) AS id FROM range({STUDY}) AS r(i))"


def kmeans(k: int, rounds: int) -> str:
    """Lloyd's iterations on rows (id, pos, x) and (cluster, pos, x)."""
    parts = [V, leaders_of(k), "x0 AS (SELECT id, unnest(range(len(vec))) AS pos, unnest(vec) AS x FROM v)"]
    parts.append("c0 AS (SELECT leader_id AS cluster, unnest(range(len(vec))) AS pos, CAST(unnest(vec) AS DOUBLE) AS x FROM leaders)")
    for i in range(rounds + 1):
        parts.append(f"d{i} AS (SELECT x0.id, c.cluster, sum((x0.x - c.x) * (x0.x - c.x)) AS d FROM x0 JOIN c{i} c USING (pos) GROUP BY ALL)")
        parts.append(f"a{i} AS (SELECT id, cluster FROM d{i} QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, cluster) = 1)")
        if i < rounds:
            parts.append(f"m{i} AS (SELECT a{i}.cluster, x0.pos, avg(x0.x) AS x FROM a{i} JOIN x0 USING (id) GROUP BY ALL)")
            parts.append(f"c{i + 1} AS (SELECT cluster, pos, coalesce(m{i}.x, c{i}.x) AS x FROM c{i} LEFT JOIN m{i} USING (cluster, pos))")
    return with_(*parts) + f"SELECT cluster, count(*) AS n FROM a{rounds} GROUP BY cluster"


ORACLE_SQL = {
    "quantize_vectors": with_(V) + "SELECT id, CAST(p - 1 AS INTEGER) AS pos, vec[p] AS x FROM (SELECT id, vec, unnest(range(1, len(vec) + 1)) AS p FROM v)",
    "quantize_sift_vectors": """SELECT id, CAST(p - 1 AS INTEGER) AS pos, CAST(((w[p] + 128) % 256 + 256) % 256 - 128 AS INTEGER) AS x FROM (
      SELECT vec_id AS id, unnest(range(1, len(embedding) + 1)) AS p,
             list_transform(embedding, lambda x: CAST(trunc(512 * CAST(abs(x) AS DOUBLE) - 128) AS INTEGER)) AS w FROM embeddings)""",
    "l2_pairs": with_(V) + f"SELECT a.id, {l2('a.vec', 'b.vec')} AS dist, {l2('a.vec[1:32]', 'b.vec[1:32]')} AS dist_half FROM v a JOIN v b ON b.id = a.id + 1",
    "exact_knn": exact(K),
    "exact_knn_by_columns": exact(K),
    "exact_knn_dedup": exact(K),
    "exact_knn_1000": exact(1000),
    "knn_min_per_image": with_(V, Q, EXACT_PAIRS) + f"SELECT qid, image_id, min(dist) AS dist FROM ({best('pairs', 'qid', 'dist, id', 50)}) GROUP BY ALL",
    "merge_topk_1000": merged("xy", 1000),
    "merge_topk_both": merged("once", 30),
    "merge_topk_larger": merged("once", 20),
    "merge_topk_size": merged("xy", 7),
    "knn_text": with_(V, Q, EXACT_PAIRS)
    + f"SELECT qid, CAST(qid AS VARCHAR) || chr(10) || chr(10) || string_agg((rank - 1) || ' ' || id || ' ' || dist, chr(10) ORDER BY rank) AS body FROM ({best('pairs', 'qid', 'dist, id', K)}) GROUP BY qid",
    "leaders": with_(V, LEADERS) + "SELECT leader_id, id FROM leaders",
    **{f"tree_edges_l{n}": edges(n) for n in (1, 2, 3)},
    "assign_1nn": assigned(2, 1),
    "assign_topb": assigned(2, B),
    "assign_1nn_l3": assigned(3, 1),
    "assign_topb_l3": assigned(3, B),
    "assign_flat": assigned(1, B),
    "assign_by_joins": assigned(2, B),
    "cluster_sizes": with_(*setup(2, 1)) + "SELECT cluster_id, count(*) AS n FROM db GROUP BY cluster_id",
    "cluster_members_sorted": with_(*setup(2, 1)) + "SELECT cluster_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids FROM db GROUP BY cluster_id",
    "cluster_path_scores": paths(2),
    "cluster_path_scores_l1": paths(1),
    "cluster_path_scores_l3": paths(3),
    "c2q_lookup": with_(*setup(2, B)) + "SELECT cluster_id, string_agg(CAST(qid AS VARCHAR), ',' ORDER BY qid) AS qids FROM visit GROUP BY cluster_id",
    "approx_knn_b1": approx(2, 1),
    "approx_knn_b3": approx(2, B),
    "approx_knn_l3": approx(3, B),
    "approx_knn_limit1000": with_(*setup(2, B), f"percl AS ({best('near', 'qid, cluster_id', 'dist, id', K)})")
    + f"SELECT qid, rank, id, dist FROM ({best('(SELECT qid, id, dist FROM percl)', 'qid', 'dist, id', 1000)})",
    "approx_knn_wide": approx(1, WIDE_B),
    "approx_recall": recalls(),
    "approx_knn_deep": approx(2, WIDE_B, beam=BEAM),
    "deep_recall": deep_recalls(),
    "approx_knn_shuffle": approx(1, WIDE_B),
    "batched_knn": approx(1, COARSE_B, K, COARSE),
    "knn_batches_saved": approx(1, COARSE_B, K, COARSE),
    "batches_hubness": with_(*setup(1, COARSE_B, COARSE), f"k AS ({best('near', 'qid', 'dist, id', K)})")
    + "SELECT id, count(*) AS hubness, max(dist) AS max_dist FROM k GROUP BY id",
    "exact_knn_shuffle": exact(K),
    "exact_knn_first_queries": with_(V, Q, "few AS (SELECT * FROM q ORDER BY qid LIMIT 10)", EXACT_PAIRS.replace("FROM q, v", "FROM few AS q, v"))
    + f"SELECT qid, rank, id, dist FROM ({best('pairs', 'qid', 'dist, id', K)})",
    "knn_nested": with_(V, Q, EXACT_PAIRS)
    + f"SELECT qid, string_agg(CAST(id AS VARCHAR), ',' ORDER BY rank) AS ids, bool_or(id = qid) AS own, bool_or(id = qid + 1) AS next FROM ({best('pairs', 'qid', 'dist, id', K)}) GROUP BY qid",
    "hubness": with_(*KNN) + "SELECT * FROM hubs",
    "hubness_merge": with_(*KNN) + "SELECT * FROM hubs",
    "hubness_topx": with_(*KNN) + "SELECT * FROM hubs ORDER BY hubness DESC, id LIMIT 20",
    "hubness_stats": with_(*KNN)
    + "SELECT max(hubness) AS max_hubness, min(hubness) AS min_hubness, CAST(sum(hubness) AS BIGINT) AS total, count(*) AS points, (SELECT id FROM hubs ORDER BY hubness, id LIMIT 1) AS min_id, count(*) FILTER (hubness = 1) AS n_equal FROM hubs",
    "hubness_filter": with_(*KNN) + f"SELECT * FROM hubs WHERE id % {QUERY_STEP} = 0",
    "inverted_knn": with_(*KNN) + "SELECT id AS nn_id, qid, dist FROM knn",
    "knn_with_hubness": with_(*KNN, FEW)
    + f"{WITH_HUBS} knn k LEFT JOIN few h ON h.id = k.id",
    "no_hub_points": with_(*KNN, FEW) + "SELECT id FROM v WHERE id NOT IN (SELECT id FROM few)",
    "hubness_study": with_(
        *KNN,
        FEW,
        DRAWN,
        "q AS (SELECT id AS qid, image_id AS query_image, vec FROM v WHERE id IN (SELECT id FROM drawn) AND id NOT IN (SELECT id FROM few))",
        *setup(1, COARSE_B, COARSE)[2:],
        f"k AS ({best('near', 'qid', 'dist, id', 100)})",
    )
    + f"{WITH_HUBS} k LEFT JOIN few h ON h.id = k.id",
    "image_votes": with_(*VOTES) + "SELECT query_image, image_id, votes FROM votes",
    "image_votes_topm": with_(*VOTES, "points AS (SELECT query_image, count(*) AS n_points FROM q GROUP BY query_image)")
    + f"SELECT t.query_image, image_id, votes, rank, n_points FROM ({best('votes', 'query_image', 'votes DESC, image_id', 4)}) t JOIN points USING (query_image)",
    "bof_db": with_(*setup(1, 1)) + "SELECT DISTINCT cluster_id, image_id FROM db",
    "bof_votes": with_(*setup(1, 1), "bags AS (SELECT DISTINCT cluster_id, image_id FROM db)")
    + "SELECT query_image, image_id, count(*) AS votes FROM bags JOIN visit USING (cluster_id) GROUP BY ALL",
    **{f"db_merge_{m}": db_merge(m) for m in ("full", "left", "inner")},
    "db_extension": with_(*setup(2, 1)) + "SELECT cluster_id, id, image_id FROM db",
    "database_saved_sorted": with_(*setup(2, 1)) + "SELECT cluster_id, id, image_id FROM db",
    "database_saved_grouped": with_(*setup(2, 1)) + "SELECT cluster_id, id, CAST(list_sum(vec) AS INTEGER) AS total FROM db",
    "database_of_several_paths": with_(*setup(2, 1)) + "SELECT cluster_id, id FROM db UNION ALL SELECT cluster_id, id FROM db WHERE image_id >= 5",
    "index_saved": edges(2),
    "index_from_saved_sample": edges(2).replace("FROM v QUALIFY", "FROM v WHERE image_id <> 3 QUALIFY"),
    "hubness_csv": with_(*KNN) + "SELECT * FROM hubs",
    "inverted_knn_csv": with_(*KNN) + f"{WITH_HUBS} knn k LEFT JOIN hubs h ON h.id = k.id",
    "knn_files": with_(V, Q, EXACT_PAIRS)
    + f"SELECT lpad(CAST(qid AS VARCHAR), CAST(greatest(3, len(CAST(qid AS VARCHAR))) AS INTEGER), '0') AS name, CAST(qid AS VARCHAR) || chr(10) || chr(10) || string_agg((rank - 1) || ' ' || id || ' ' || dist, chr(10) ORDER BY rank) || chr(10) AS body FROM ({best('pairs', 'qid', 'dist, id', K)}) GROUP BY qid",
    "knn_text_table": with_(V, Q, EXACT_PAIRS)
    + f"SELECT rank - 1 AS rank, id, CAST(sum(dist) AS BIGINT) AS dist FROM ({best('pairs', 'qid', 'dist, id', K)}) GROUP BY ALL",
    "ground_truth_text": with_(V, Q, EXACT_PAIRS) + f"SELECT CAST(qid AS INTEGER) AS query_id, CAST(id AS INTEGER) AS desc_id FROM ({best('pairs', 'qid', 'dist, id', 3)})",
    "ground_truth_saved": with_(V, Q, EXACT_PAIRS, f"one AS ({best('pairs', 'qid', 'dist, id', 1)})")
    + "SELECT one.id AS desc_id, qid AS query_id, CAST(list_sum(vec) AS INTEGER) AS total FROM one JOIN v ON v.id = one.id",
    "raw_descriptor_files": with_(V) + "SELECT image_id || '_' || (row_number() OVER (PARTITION BY image_id ORDER BY id) - 1) AS key, image_id, CAST(list_sum(vec) AS INTEGER) AS total FROM v",
    "descriptors_with_one_id": """WITH b AS (SELECT hex(encode(text))[1:32] AS h FROM documents), n AS (
      SELECT list_transform(range(16), lambda i: CAST('0x' || h[2 * i + 1:2 * i + 2] AS INTEGER)) AS x FROM b WHERE len(h) = 32)
      SELECT CAST(42 AS BIGINT) AS id, count(*) AS n, CAST(sum(list_sum(list_transform(x, lambda y: CASE WHEN y > 127 THEN y - 256 ELSE y END))) AS BIGINT) AS total FROM n""",
    "sample_batch": f"SELECT vec_id AS id FROM embeddings WHERE {share('vec_id')} < (SELECT (count(*) // 10) / count(*) FROM embeddings)",
    "random_ids": f"WITH {DRAWN} SELECT id FROM drawn",
    "batch_header_parse": """WITH p AS (SELECT o_orderkey AS n,
        CASE WHEN n % 7 = 0 THEN NULL ELSE CAST(n % 14 AS INTEGER) END AS b, CASE WHEN n % 7 = 1 THEN NULL ELSE CAST(n % 40 AS INTEGER) END AS k,
        CASE WHEN n % 7 = 2 OR n % 11 = 0 THEN NULL ELSE CAST(n % 1500 AS INTEGER) END AS m FROM orders)
      SELECT n, CASE WHEN b BETWEEN 1 AND 10 THEN b ELSE 1 END AS b, CASE WHEN k >= 5 THEN k ELSE 20 END AS k, CASE WHEN m BETWEEN 10 AND 1000 THEN m ELSE 100 END AS m FROM p""",
    "path_functions": """SELECT page_id, page_id AS image_id, '#db#' || page_id || '.jpg' AS file, '/db/' || page_id || '.jpg' AS image,
      CAST(trunc(w * f) AS INTEGER) AS w, CAST(trunc(h * f) AS INTEGER) AS h FROM (
      SELECT *, CASE WHEN w >= h AND w > 756 THEN CAST(756 AS DOUBLE) / w WHEN h > w AND h > 756 THEN CAST(756 AS DOUBLE) / h ELSE CAST(1 AS DOUBLE) END AS f
      FROM (SELECT page_id, page_id + 500 AS w, 1000 - page_id % 700 AS h FROM pages))""",
    "groundtruth_join": with_(V, Q, EXACT_PAIRS, f"one AS ({best('pairs', 'qid', 'dist, id', 1)})")
    + "SELECT one.id AS desc_id, qid AS query_id, CAST(list_sum(vec) AS INTEGER) AS total FROM one JOIN v ON v.id = one.id",
    "kmeans_sizes": kmeans(20, 3),
    "stream_search": with_(*VOTES) + "SELECT query_image, image_id, votes FROM votes QUALIFY row_number() OVER (PARTITION BY query_image ORDER BY votes DESC, image_id) <= 10",
}
ORACLE_SQL["stream_search_extended"] = ORACLE_SQL["stream_search"]
